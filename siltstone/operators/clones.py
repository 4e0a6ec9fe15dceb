"""Copies among files: blocks of lines, functions of one shape, functions that are nearly alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lines as L
from . import neardup as N
from .lineage import cut

#: The facts that ``same_shape`` and ``near_findings`` ask for.
SHAPE_FACTS = tuple(f"functions.{f}" for f in ("name", "line", "n_stmts", "shape"))
NEAR_FACTS = tuple(f"functions.{f}" for f in ("name", "line", "end", "shape", "dotted", "shingles"))
TWINS = ("property", "cached_property", "getter", "setter", "deleter")


def block_findings(files: DataFrame) -> DataFrame:
    """duplicate-code at the later place of each copied block; data files are left out."""
    rows = L.clone_blocks(files.where(~F.col("path").rlike("[.]ya?ml$")))
    said = F.format_string("the block of %d lines from here is also in %s, lines %d to %d", F.col("a_end") - F.col("a_start") + 1, "pa", "a_start", "a_end")
    return rows.select(F.lit("duplicate-code").alias("rule"), F.lit("warn").alias("severity"), F.col("pb").alias("file"), F.col("b_start").alias("line"), said.alias("message"))


def functions(facts: DataFrame) -> DataFrame:
    rows = facts.select("path", F.explode("functions").alias("f"))
    rows = rows.select("path", "f.*")
    return rows.where(~(F.col("name").startswith("__") & F.col("name").endswith("__")))


def same_shape(facts: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """duplicate-function: each function of 5 statements or more whose shape another one has, but the first of them.

    The first is the least of those outside ``report`` (path), if any are. One aggregation finds it, so
    a shape that very many functions share is no task of its own.
    """
    # written once: read twice, it would be parsed twice
    rows = cut(functions(facts).where("n_stmts >= 5").select("path", "line", "name", "shape"))
    rows = rows.withColumn("own", F.lit(True)) if report is None else rows.join(report.select("path").distinct().withColumn("own", F.lit(True)), "path", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    place = F.struct("path", "line", "name")
    firsts = rows.groupBy("shape").agg(F.count("*").alias("n"), F.coalesce(F.min(F.when(~F.col("own"), place)), F.min(place)).alias("first")).where("n > 1")
    met = rows.join(firsts, "shape").where("own and not (path = first.path and line = first.line and name = first.name)")
    said = F.format_string("%s() has the shape of %s() in %s, line %d", "name", "first.name", "first.path", "first.line")
    return met.select(F.lit("duplicate-function").alias("rule"), F.lit("error").alias("severity"), F.col("path").alias("file"), "line", said.alias("message"))


def entries(facts: DataFrame) -> DataFrame:
    """id, path, name, line, end, shape, dotted, n_shingles, shingles of functions large enough to compare."""
    rows = functions(facts).where(F.size("shingles") >= N.MIN_SHINGLES)
    return rows.select(F.xxhash64("path", "line", "name").alias("id"), "path", "name", "line", "end", "shape", "dotted", F.size("shingles").alias("n_shingles"), "shingles")


def near_pairs(functions: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """jaccard, a, b (id, path, name, line) of nearly equal functions; b is the one to report.

    Candidates share shingles of 2 to 20 functions or have one name. Functions within each other,
    accessors of one property and equal shapes are no pairs.
    """
    shingles = cut(functions.select("id", F.explode("shingles").alias("h")))
    named = N.same_name_pairs(functions.select("name", "id", "n_shingles", "path", "line"))
    pairs = N.candidates(shingles).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(named).distinct()
    near = N.verified(pairs, shingles)
    side = functions.select("id", F.struct("path", "line", "name", "end", "id", "shape", "dotted").alias("e"))
    rows = near.join(side.select(F.col("id").alias("a"), F.col("e").alias("x")), "a").join(side.select(F.col("id").alias("b"), F.col("e").alias("y")), "b")
    first = F.struct(F.col("x.path"), F.col("x.line")) <= F.struct(F.col("y.path"), F.col("y.line"))
    rows = rows.select("jaccard", F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
    same = F.col("a.path") == F.col("b.path")
    nested = same & (((F.col("a.line") <= F.col("b.line")) & (F.col("b.end") <= F.col("a.end"))) | ((F.col("b.line") <= F.col("a.line")) & (F.col("a.end") <= F.col("b.end"))))
    twins = same & (F.col("a.name") == F.col("b.name")) & F.exists(F.concat("a.dotted", "b.dotted"), lambda d: F.element_at(F.split(d, "[.]"), -1).isin(*TWINS))
    rows = rows.where(~nested & ~twins & (F.col("a.shape") != F.col("b.shape")))
    if report is not None:
        own = report.select("path").distinct()
        rows = rows.join(own.select(F.col("path").alias("pa"), F.lit(1).alias("ra")), F.col("a.path") == F.col("pa"), "left").join(own.select(F.col("path").alias("pb"), F.lit(1).alias("rb")), F.col("b.path") == F.col("pb"), "left")
        swap = F.col("ra").isNotNull() & F.col("rb").isNull()
        rows = rows.select("jaccard", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    keep = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in ("id", "path", "name", "line")]).alias(s)
    return rows.select("jaccard", keep("a"), keep("b"))


def near_findings(facts: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """diverged-duplicate: families over 3 or more files, else forks of 5 or more pairs between two files, else single pairs."""
    rows = cut(near_pairs(cut(entries(facts)), report))
    if rows.isEmpty():
        return facts.sparkSession.createDataFrame([], "rule string, severity string, file string, line int, message string")
    roots = cut(N.components(rows.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))))
    member = rows.select(F.explode(F.array("a", "b")).alias("m")).select("m.*").distinct().join(roots, "id")
    own = member.withColumn("own", F.lit(False)) if report is None else member.join(report.select("path").distinct().withColumn("own", F.lit(True)), "path", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    place = F.struct("path", "line")
    families = own.groupBy("root").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"), F.slice(F.array_sort(F.collect_set("name")), 1, 4).alias("names"), F.coalesce(F.max(F.when(F.col("own"), place)), F.max(place)).alias("at")).where("n >= 3 and files >= 3")
    rooted = rows.join(roots.withColumnRenamed("id", "_a"), F.col("a.id") == F.col("_a")).drop("_a")
    scores = rooted.groupBy("root").agg(F.avg("jaccard").alias("mean"), F.min("jaccard").alias("least"))
    percent = F.floor(F.col("mean") * 100).cast("int")
    alike = F.when(F.col("least") >= N.IDENTICAL, "alike but for literals").otherwise(F.concat(percent.cast("string"), F.lit(" % alike")))
    family = families.join(scores, "root").select(F.col("at.path").alias("file"), F.col("at.line").alias("line"), F.format_string("%d functions (%s) in %d files are %s", "n", F.array_join("names", ", "), "files", alike).alias("message"))

    left = rooted.join(families.select("root"), "root", "left_anti")
    flat = left.select(F.col("a.path").alias("file_a"), F.col("b.path").alias("file_b"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), "jaccard", F.col("a.line").alias("line_a"), F.col("b.line").alias("line_b"), F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
    matched = cut(N.one_to_one(flat))
    best = F.struct((-F.col("jaccard")).alias("j"), "line_a", "line_b", "name_a", "name_b")
    fork = matched.where("file_a <> file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("n"), F.avg("jaccard").alias("mean"), F.min(best).alias("top"), F.slice(F.transform(F.sort_array(F.collect_list(best)), lambda s: s["name_b"]), 1, 4).alias("names")).where(F.col("n") >= N.FORK)
    forks = fork.select(F.col("file_b").alias("file"), F.col("top.line_b").alias("line"), F.format_string("%d functions (%s) are %d %% alike with those of %s: a fork", "n", F.array_join("names", ", "), percent, "file_a").alias("message"))
    single = matched.join(fork.select("file_a", "file_b"), ["file_a", "file_b"], "left_anti")
    how = F.when(F.col("jaccard") >= N.IDENTICAL, "alike but for literals").otherwise(F.concat(F.floor(F.col("jaccard") * 100).cast("string"), F.lit(" % alike")))
    pairs = single.select(F.col("file_b").alias("file"), F.col("line_b").alias("line"), F.format_string("%s() and %s() in %s, line %d, are %s", "name_b", "name_a", "file_a", "line_a", how).alias("message"))
    return family.unionByName(forks).unionByName(pairs).select(F.lit("diverged-duplicate").alias("rule"), F.lit("warn").alias("severity"), "file", "line", "message")
