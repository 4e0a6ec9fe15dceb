"""The library's queries against their SQL, and the text functions against plain Python."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone.functions import text as T
from siltstone.operators import neardup as N
from siltstone.operators.lineage import cut
from siltstone.plans.registry import library_queries, library_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    made = duckdb.connect()
    made.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return made


def cells(rows):
    return sorted("|".join(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(library_sql()))
def test_query_matches_sql(spark, sf, con, name):
    got = library_queries()[name](spark, sf)
    want = con.execute(library_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert cells(map(tuple, got.select(*columns).collect())) == cells(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lines_are_those_of_python(spark):
    texts = ["", "a", "a\n", "a\r\nb\x0bc d\n\n", "\n", "x\x85y"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: list(r["l"]) for r in df.select("k", T.split_lines(df["t"]).alias("l")).collect()}
    assert got == {k: t.splitlines() for k, t in enumerate(texts)}


def test_first_hedge_or_none(spark):
    df = spark.createDataFrame([("plain words",), (f"so {T.HEDGES[3]} and {T.HEDGES[1]}",)], "t string")
    assert {r[0] for r in df.select(T.hedge(df["t"])).collect()} == {None, next(h for h in T.HEDGES if h in f"so {T.HEDGES[3]} and {T.HEDGES[1]}".lower())}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(50, 51), (52, 51)], "a long, b long")
    got = {r["id"]: r["root"] for r in N.components(edges).collect()}
    assert got == {k: 1 for k in range(1, 31)} | {50: 50, 51: 50, 52: 50}


def test_short_texts_have_no_shingles(spark):
    files = spark.createDataFrame([(1, ""), (2, "a b c"), (3, None), (4, " ".join(f"w{k}" for k in range(50)))], "path long, text string")
    assert {r["id"] for r in N.word_shingles(files).collect()} == {4}


def test_groups_above_the_frequency_window(spark, tmp_path):
    """25 exact copies, 24 texts with two words changed each, and texts of one sentence: against all pairs of sets."""
    base = [f"w{k}" for k in range(80)]
    near = [[f"v{k}" for k in range(80)] for _ in range(24)]
    for k, words in enumerate(near):
        words[k] = words[79 - k] = f"own{k}"
    texts = [base] * 25 + near + [[*base[:70], *"a b c d e f g h i j".split()], base[:60], [f"z{k}" for k in range(80)]]
    rows = [(k, " ".join(t), f"s{k % 4}") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = {(i, j): len(x & y) / len(x | y) for j, y in enumerate(sets) for i, x in enumerate(sets[:j])}
    want = {p: round(v, 6) for p, v in want.items() if v >= N.LOW}
    assert len(want) > 25 * 24 / 2
    rep = {r["id"]: r["rep"] for r in library_queries()["neardup_classes"](spark, str(tmp_path)).collect()}
    assert all(rep[i] == min(j for j in range(len(sets)) if sets[j] == sets[i]) for i in rep)
    got = {(r["a"], r["b"]): r["jaccard"] for r in library_queries()["neardup_pairs"](spark, str(tmp_path)).collect()}
    # the pairs of representatives, spread over their classes, are all pairs
    spread = {(i, j): 1.0 if rep[i] == rep[j] else got.get((min(rep[i], rep[j]), max(rep[i], rep[j]))) for i in rep for j in rep if i < j}
    assert {p: v for p, v in spread.items() if v} == want
    assert set(got) <= {(r["a"], r["b"]) for r in library_queries()["neardup_candidates"](spark, str(tmp_path)).collect()}
    sizes = sorted(r["n_members"] for r in library_queries()["neardup_families"](spark, str(tmp_path)).collect())
    assert sizes == [24, 27]


def brute_forks(rows):
    """file_a, file_b, n_pairs, mean_jaccard over plain lists: all pairs, families out, greedy matching, N.FORK or more."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t, _ in rows)}
    source = {i: s for i, _, s in rows}
    pairs = [(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), i, j) for i in sets for j in sets if i < j]
    pairs = [p for p in pairs if p[0] >= N.LOW]
    group = {i: {i} for i in sets}
    for _, i, j in pairs:
        if group[i] is not group[j]:
            group[i] |= group[j]
            for k in group[j]:
                group[k] = group[i]
    pairs = [(v, *((i, j) if source[i] < source[j] else (j, i))) for v, i, j in pairs if source[i] != source[j] and len({source[k] for k in group[i]}) < 3]
    used, held = set(), {}
    for v, i, j in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        files = source[i], source[j]
        if not {(files, i), (files, j)} & used:
            used |= {(files, i), (files, j)}
            held.setdefault(files, []).append(v)
    return sorted((*f, len(v), round(sum(v) / len(v), 6)) for f, v in held.items() if len(v) >= N.FORK)


def test_forks_are_matched_one_to_one(spark, tmp_path):
    """A hot group of 12 copies in p and 7 in q counts 7 pairs, not 84; in 3 sources it is a family and counts none."""
    def text(name, changed=0):
        return " ".join(f"{name}{k}" if k >= changed else f"own{changed}{name}{k}" for k in range(80))

    rows = [(text("hot"), "p")] * 12 + [(text("hot"), "q")] * 7
    rows += [(text("wide"), s) for s in "rst" for _ in range(6)]
    rows += [(text(f"m{k}x", c), s) for k in range(6) for c, s in ((k, "u"), (0, "v"))]
    rows += [(text(f"n{k}x", k), s) for k in range(4) for s in "wz"]
    rows = [(k * 7 % 101, t, s) for k, (t, s) in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_forks(rows)
    assert [r[:3] for r in want] == [("p", "q", 7), ("u", "v", 6)]
    assert sorted(map(tuple, library_queries()["matched_forks"](spark, str(tmp_path)).select("file_a", "file_b", "n_pairs", "mean_jaccard").collect())) == want


def test_plans_know_the_size_of_what_is_cut(spark):
    """Not what was estimated for the plan before: too little after an explode, a product of products after joins in rounds."""
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    many = cut(spark.range(10).select("id", F.explode(F.sequence(F.lit(1), F.lit(20_000))).alias("k")).select("id", F.xxhash64("id", "k").alias("h")))
    assert size(many) > 8 * 200_000
    rows = cut(spark.range(10))
    for _ in range(3):
        rows = cut(rows.join(rows.select("id"), "id").join(rows.select("id"), "id"))
    assert rows.count() == 10 and size(rows) < 1e6


def test_pairs_do_not_depend_on_the_order_of_shingles(spark, monkeypatch):
    """Ranked by two sets, by all and not at all, and ordered few at a time: against all pairs of sets."""
    texts = [[f"{k % 5}w{j}" for j in range(90)] for k in range(40)]
    for k, words in enumerate(texts):
        words[: k // 5] = [f"own{k}_{j}" for j in range(k // 5)]
        words[70:] = [f"line{j}" for j in range(20)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = {(i, j): round(len(x & y) / len(x | y), 6) for j, y in enumerate(sets) for i, x in enumerate(sets[:j])}
    files = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "path long, text string")
    _, own = N.classes(N.word_sets(files))
    for few, ranked, at_once in ((2, 10, 100), (100, 200_000, 1 << 20), (100, 0, 1)):
        monkeypatch.setattr(N, "ORDERED_BY", few)
        monkeypatch.setattr(N, "RANKED", ranked)
        monkeypatch.setattr(N, "AT_ONCE", at_once)
        assert {(r["a"], r["b"]): round(r["jaccard"], 6) for r in N.class_pairs(own).collect()} == {p: v for p, v in want.items() if v >= N.LOW}


def test_shingles_are_shuffled_once_for_their_index(spark, sf):
    plan = library_queries()["shingle_index"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(h") == 1 and "Join" not in plan


def test_postings_are_shuffled_once(spark):
    shingles = spark.createDataFrame([(k, h) for h in range(30) for k in range(h)], "id long, h long")
    index = N.postings(shingles)
    assert {r["h"]: r["ids"] for r in index.collect()} == {h: list(range(h)) for h in range(2, N.MAX_DF + 1)}
    assert index._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("Initial Plan")[0].count("Exchange") == 1
