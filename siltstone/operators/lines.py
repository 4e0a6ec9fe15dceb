"""Files to lines to windows: the relations under the line-based rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut

WINDOW = 6
MIN_CHARS = 120


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), raw, stripped, norm (null where the line does not count)."""
    rows = files.select("path", F.posexplode(T.split_lines(F.col("text"))).alias("pos", "raw"))
    rows = rows.select("path", (F.col("pos") + 1).alias("line"), "raw", T.strip(F.col("raw")).alias("stripped"))
    return rows.withColumn("norm", T.normalise_line(F.col("stripped")))


def kept_lines(text: Column) -> Column:
    """(line, norm) of the lines that count. Each step binds its result, so that no expression runs twice a line."""
    stripped = F.transform(T.split_lines(text), T.strip)
    flat = F.transform(stripped, lambda x, i: F.struct((i + 1).alias("line"), F.when(~T.is_skipped(x), F.regexp_replace(x, f"{T.BLANK}+", " ")).alias("norm")))
    return F.filter(flat, lambda s: F.length(s["norm"]) >= 5)


def normalised(files: DataFrame) -> DataFrame:
    """path, j (place among the kept lines, from 0), line, norm.

    The numbering is within the array of one file, so that it needs no shuffle: line numbers are
    attached before the filter and places after it.
    """
    return files.select("path", F.posexplode(kept_lines(F.col("text"))).alias("j", "s")).select("path", "j", "s.line", "s.norm")


def window_rows(files: DataFrame) -> DataFrame:
    """path, j, text, first, last of every window of MIN_CHARS characters or more.

    Built within each file's array, which is bound as a lambda's variable: a row never carries more
    than its own window, and nothing is exchanged.
    """

    def of(s: Column) -> Column:
        def window(j: Column) -> Column:
            part = F.slice(s, j + 1, F.lit(WINDOW))
            return F.struct(j.alias("j"), F.array_join(F.transform(part, lambda x: x["norm"]), "\n").alias("text"), s[j]["line"].alias("first"), s[j + (WINDOW - 1)]["line"].alias("last"))

        return F.when(F.size(s) >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(s) - WINDOW)), window))

    rows = files.select("path", F.explode(F.transform(F.array(kept_lines(F.col("text"))), of)).alias("ws"))
    rows = rows.select("path", F.explode("ws").alias("w")).select("path", "w.*")
    return rows.where(F.length("text") - (WINDOW - 1) >= MIN_CHARS)


def windows(files: DataFrame) -> DataFrame:
    """path, j, win (hash of WINDOW lines), first line, last line."""
    return window_rows(files).select("path", "j", F.sha2("text", 256).alias("win"), "first", "last")


def clone_pairs(files: DataFrame) -> DataFrame:
    """pa, ja, pb, jb (with their line numbers): the first place of a window against each other place.

    Windows with 2 to 8 places count; overlapping places of one file do not. The places are counted
    first: only windows that pass are gathered, so no list grows beyond 8.
    """
    win = F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit("win"), "text").alias("y"))
    rows = cut(window_rows(files).select(win.alias("win"), "path", "j", "first", "last"))
    few = rows.groupBy("win").agg(F.count("*").alias("n")).where("n between 2 and 8").select("win")
    place = F.struct("path", "j", "first", "last")
    groups = rows.join(few, "win").groupBy("win").agg(F.sort_array(F.collect_list(place)).alias("places"))
    pairs = groups.select(F.element_at("places", 1).alias("a"), F.explode(F.slice("places", F.lit(2), F.size("places"))).alias("b"))
    pairs = pairs.select(F.col("a.path").alias("pa"), F.col("a.j").alias("ja"), F.col("a.first").alias("a_first"), F.col("a.last").alias("a_last"), F.col("b.path").alias("pb"), F.col("b.j").alias("jb"), F.col("b.first").alias("b_first"), F.col("b.last").alias("b_last"))
    return pairs.where((F.col("pa") != F.col("pb")) | (F.abs(F.col("jb") - F.col("ja")) >= WINDOW)).distinct()


def clone_blocks(files: DataFrame) -> DataFrame:
    """pa, a_start, a_end, pb, b_start, n_lines: heads of runs of pairs along a diagonal.

    A pair within 23 places after a reported head continues it; the run's length counts pairs without
    a gap from the head on.
    """
    pairs = clone_pairs(files).withColumn("diagonal", F.col("jb") - F.col("ja"))
    step = Window.partitionBy("pa", "pb", "diagonal").orderBy("ja")
    runs = pairs.withColumn("island", F.col("ja") - F.row_number().over(step))
    runs = runs.withColumn("run_end", F.max(F.struct("ja", "a_last")).over(Window.partitionBy("pa", "pb", "diagonal", "island")))
    heads = runs.groupBy("pa", "pb", "diagonal").agg(F.sort_array(F.collect_list(F.struct("ja", "a_first", "b_first", F.col("run_end.ja").alias("end_ja"), F.col("run_end.a_last").alias("a_last")))).alias("r"))
    empty = F.slice("r", 1, 0)
    greedy = F.aggregate("r", empty, lambda acc, x: F.when((F.size(acc) == 0) | (x["ja"] - F.element_at(acc, -1)["ja"] >= 4 * WINDOW), F.concat(acc, F.array(x))).otherwise(acc))
    out = heads.select("pa", "pb", F.explode(greedy).alias("h"))
    return out.select("pa", F.col("h.a_first").alias("a_start"), F.col("h.a_last").alias("a_end"), "pb", F.col("h.b_first").alias("b_start"), (F.col("h.end_ja") - F.col("h.ja") + WINDOW).alias("n_lines"))
