"""Sharding along a Hilbert curve over document metadata.

Three dimensions - language, source, length - are quantised to BITS bits each: the two names by their
place in the alphabet weighted by documents (equal depth, so a hot source takes a wide range), the
length by its logarithm. Documents are ordered by the curve index, then by id, and cut in runs of
about ``target`` characters. A run covers a small box of the three dimensions, so that file
statistics prune on each of them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, narrow

DIMS, BITS = 3, 6
CELLS = 1 << BITS
TARGET_CHARS = 8_000_000
#: Beyond so many shards they grow instead: where each begins is known to the driver and the workers, 16 bytes a shard.
MOST_SHARDS = 500_000


def hilbert_table() -> list[int]:
    """For each of the 24 states (entry corner, direction) and 8 cells: next state * 8 + digit.

    Hamilton's formulation: rotate the cell into the state's frame, take the inverse Gray code, and
    turn the frame by the digit's entry corner and direction.
    """
    full = (1 << DIMS) - 1

    def rotate(x: int, k: int) -> int:
        k %= DIMS
        return ((x >> k) | (x << (DIMS - k))) & full

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def trailing(i: int) -> int:
        k = 0
        while i & 1:
            i, k = i >> 1, k + 1
        return k

    out = []
    for state in range((1 << DIMS) * DIMS):
        corner, way = state % (1 << DIMS), state // (1 << DIMS)
        for cell in range(1 << DIMS):
            g = rotate(cell ^ corner, way + 1)
            w = reduce(lambda a, k: a ^ (g >> k), range(1, DIMS), g) & full
            inner = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            turn = 0 if w == 0 else trailing(w - 1 if w % 2 == 0 else w) % DIMS
            corner2 = corner ^ rotate(inner, DIMS - (way + 1) % DIMS)
            out.append((corner2 + (1 << DIMS) * ((way + turn + 1) % DIMS)) * 8 + w)
    return out


TABLE = hilbert_table()


def hilbert_index(x: str, y: str, z: str) -> F.Column:
    """Curve index of three BITS-bit numbers, level by level through the table; all of it in the JVM."""
    table = F.array(*[F.lit(v) for v in TABLE])
    levels = F.array(*[F.lit(k) for k in range(BITS - 1, -1, -1)])

    def step(acc: F.Column, level: F.Column) -> F.Column:
        def bit(c: str) -> F.Column:
            return F.call_function("shiftright", F.col(c), level).bitwiseAND(F.lit(1))

        cell = bit(x) * 4 + bit(y) * 2 + bit(z)
        at = F.element_at(table, (acc["state"] * 8 + cell + 1).cast("int"))
        return F.struct(F.floor(at / 8).cast("int").alias("state"), (acc["h"] * 8 + at % 8).cast("long").alias("h"))

    start = F.struct(F.lit(0).cast("int").alias("state"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(levels, start, step)["h"]


def before(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Adds ``before``: the sum of ``size`` over the rows that come before in the order.

    Prefix sums in two levels: within each range partition of the order, and over the one sum a
    partition. No task sees more than its range. Rows that tie get consecutive places.
    """
    parts = max(8, rows.sparkSession.sparkContext.defaultParallelism * 2)
    ordered = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy("part").agg(F.sum(size).alias("n"))  # one row a partition
    ahead = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return ordered.withColumn("local", F.coalesce(F.sum(size).over(own), F.lit(0))).join(F.broadcast(ahead), "part").withColumn("before", F.col("local") + F.col("ahead")).drop("local", "ahead", "part")


def bounds(keys: DataFrame, column: str) -> list[tuple[str, int]]:
    """(first name, cell) of every cell: a name's cell is the share of documents with a lesser name, in CELLS steps.

    At most CELLS rows come to the driver, whatever the number of names. A null is the empty name.
    """
    counts = keys.groupBy(F.coalesce(F.col(column), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    placed = before(counts, ["value"], "n")
    total = placed.agg(F.sum("n")).first()[0] or 1
    cell = F.least(F.lit(CELLS - 1), F.floor(F.col("before") * CELLS / total)).cast("int")
    return [(r["first"], r["cell"]) for r in placed.groupBy(cell.alias("cell")).agg(F.min("value").alias("first")).orderBy("cell").collect()]


def cell_of(name: F.Column, names: list[tuple[str, int]]) -> F.Column:
    """The cell of a name by comparison with the bounds, which are literals: no join."""
    out = F.lit(names[-1][1] if names else 0)
    for (_, cell), (upper, _) in zip(reversed(names[:-1]), reversed(names[1:]), strict=True):
        out = F.when(name < upper, cell).otherwise(out)
    return out.cast("int")


def length_cell(n: F.Column) -> F.Column:
    """Four cells for each doubling of the number of characters."""
    return F.least(F.lit(CELLS - 1), F.floor(F.log2(F.greatest(n, F.lit(0)) + 1) * 4)).cast("int")


def indexed(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, list, list]:
    """Narrow rows (id, size, h), with the bounds of the two names. The texts are read once, for their length."""
    rows = narrow(docs, {"id": id_col, "text": text_col, "lang": lang_col, "source": source_col}).select(F.col("id").cast("long"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    rows = cut(rows)
    langs, sources = bounds(rows, "lang"), bounds(rows, "source")
    placed = rows.withColumns({"x": cell_of(F.col("lang"), langs), "y": cell_of(F.col("source"), sources), "z": length_cell(F.col("size"))})
    return placed.select("id", "size", hilbert_index("x", "y", "z").alias("h"), F.coalesce("id", F.lit(-1)).alias("place")), langs, sources


def runs(rows: DataFrame, target: int) -> DataFrame:
    """Adds ``shard``: characters that come before in the order (h, id, size), divided by ``target`` or by what gives MOST_SHARDS."""
    placed = before(rows, ["h", "place", "size"], "size")
    total = placed.agg(F.sum("size")).first()[0] or 0
    return placed.withColumn("shard", F.floor(F.col("before") / max(target, total // MOST_SHARDS)).cast("long"))


def shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", target: int = TARGET_CHARS) -> DataFrame:
    """id, hilbert, shard of every row.

    Ids are whole numbers. A null name counts as the empty name, a null text as empty, a null id sorts
    as -1. Repeated rows are placed one after the other, and so are rows that tie in curve, id and
    length. A text of any length is one row of one shard. Extra columns are not read. An empty table
    gives no rows.
    """
    rows, _, _ = indexed(docs, id_col, text_col, lang_col, source_col)
    return runs(rows, target).select(F.col("id").alias(id_col), F.col("h").alias("hilbert"), "shard")


def sharded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", target: int = TARGET_CHARS) -> DataFrame:
    """``docs`` plus ``hilbert`` and ``shard``, a partition a shard, sorted along the curve.

    The runs are cut on the narrow table; the only thing kept of them is where each starts, one row a
    shard, MOST_SHARDS at most (shards are numbered from 0 without gaps here). The texts are shuffled
    once and join with nothing. Columns of ``docs`` that are named hilbert or shard are replaced. Rows
    that tie across a cut go to the later run. Nulls, repeated rows, long texts and empty tables as in
    ``shards``; other extra columns stay, whatever their names.
    """
    docs = docs.drop(*[c for c in ("hilbert", "shard") if c not in (id_col, text_col, lang_col, source_col)])
    rows, langs, sources = indexed(docs, id_col, text_col, lang_col, source_col)
    starts = runs(rows, target).groupBy("shard").agg(F.min(F.struct("h", "place")).alias("s")).select("shard", "s.h", F.col("s.place").alias("id")).orderBy("shard").toPandas()
    if not len(starts):
        return docs.withColumn("hilbert", F.lit(0).cast("long")).withColumn("shard", F.lit(0).cast("long"))
    first = np.rec.fromarrays([starts["h"].to_numpy(np.int64), starts["id"].to_numpy(np.int64)], names="h,id")

    @F.pandas_udf("int")
    def place(h: pd.Series, ids: pd.Series) -> pd.Series:
        at = np.rec.fromarrays([h.to_numpy(np.int64), ids.to_numpy(np.int64)], names="h,id")
        return pd.Series(np.searchsorted(first, at, "right").astype(np.int32) - 1).clip(lower=0)

    z, at_id, x, y, at = (fresh(docs, n) for n in ("__z", "__id", "__x", "__y", "__at"))
    name = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    wide = docs.withColumns({x: cell_of(name(lang_col), langs), y: cell_of(name(source_col), sources), z: length_cell(F.length(name(text_col))), at_id: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-1))})
    wide = wide.withColumn("hilbert", hilbert_index(x, y, z)).withColumn(at, place("hilbert", at_id))
    wide = wide.repartitionById(len(starts), F.col(at)).sortWithinPartitions("hilbert", at_id)
    return wide.select(*[F.col(f"`{c}`") for c in docs.columns], "hilbert", F.col(at).cast("long").alias("shard"))


def oracle_sql(target: int = TARGET_CHARS) -> str:
    """The same placement as one DuckDB query over ``documents``; no table that it runs on has MOST_SHARDS shards."""
    table = "[" + ", ".join(map(str, TABLE)) + "]"
    levels = []
    state = "0"
    for level in range(BITS - 1, -1, -1):
        cell = f"((x >> {level}) & 1) * 4 + ((y >> {level}) & 1) * 2 + ((z >> {level}) & 1)"
        levels.append((f"t{level}", f"({table})[({state}) * 8 + {cell} + 1]"))
        state = f"t{level} // 8"
    chain = "placed"
    steps = []
    for name, expr in levels:
        steps.append(f"lv_{name} AS (SELECT *, {expr} AS {name} FROM {chain})")
        chain = f"lv_{name}"
    index = " + ".join(f"(t{level} % 8)::BIGINT * {8**level}" for level in range(BITS))

    def cells(column: str) -> str:
        return f"SELECT v AS {column}, least({CELLS - 1}, floor(coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {CELLS} / sum(n) OVER ()))::INT AS c FROM (SELECT {column} AS v, count(*) AS n FROM r GROUP BY 1)"

    return f"""WITH r AS (SELECT doc_id, length(coalesce(text, '')) AS size, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
a AS ({cells("lang")}), b AS ({cells("source")}),
placed AS (SELECT doc_id, size, a.c AS x, b.c AS y, least({CELLS - 1}, floor(log2(size + 1) * 4))::INT AS z FROM r JOIN a USING (lang) JOIN b USING (source)),
{", ".join(steps)},
i AS (SELECT doc_id, size, {index} AS hilbert FROM {chain})
SELECT doc_id, hilbert, floor(coalesce(sum(size) OVER (ORDER BY hilbert, coalesce(doc_id, -1), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {target})::BIGINT AS shard FROM i"""
