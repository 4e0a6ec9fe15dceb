"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import ann, decontaminate, mixing, pii, quality, secrets, sharding, simhash, tokens, toxicity
from siltstone.llm.queries import KEY, VOCABULARY

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over a lazy dog near river " * 40_000
ROWS = [
    (1, "some plain words about nothing in particular today", "en", "a", 10),
    (1, "some plain words about nothing in particular today", "en", "a", 10),
    (2, "", "en", "a", 0),
    (3, None, "en", "a", None),
    (None, "a text without an id but with words enough", "de", "b", 3),
    (None, None, None, None, None),
    (4, "x", None, "b", 1),
    (5, "x", "de", None, 1),
    (6, LONG, "en", "a", len(LONG)),
    (7, "¡!? ...", "es", "c", 7),
    (8, "x" * 300_000, "es", "c", 300_000),
]
CLASHING = ["id", "key", "fp", "good", "label", "p", "part", "h", "x", "y", "z", "value", "cell", "owner", "repo", "hilbert", "shard", "item", "__drop", "__twice", "__key", "__row", "__lang", "__at", "n_tokens", "log_weight"]
LABELS = [(1, 1, 0), (2, 0, 1), (4, None, 1), (5, 1, None), (None, 1, 1), (6, 1, 0), (6, 0, 0)]
BENCHMARK = [(1, "brown fox jumps over a lazy dog near river"), (2, None), (None, "some plain words about nothing"), (3, ""), (4, "?!")]


def tables(spark, kind):
    docs = spark.createDataFrame([] if kind == "empty" else ROWS, COLUMNS)
    labels = spark.createDataFrame([] if kind == "empty" else LABELS, "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([] if kind == "empty" else BENCHMARK, "item_id long, text string")
    if kind == "clashing":
        docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
        labels = labels.select("*", *[F.lit("?").alias(c) for c in ("id", "label", "one", "_o", "good")])
        bench = bench.select("*", *[F.lit("?").alias(c) for c in ("item", "id", "start")])
    return docs, labels, bench


KINDS = ["plain", "clashing", "empty"]


@pytest.fixture(scope="module", params=KINDS)
def given(request, spark):
    return request.param, *tables(spark, request.param)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_mixing(given):
    kind, docs, labels, _ = given
    got = rows(mixing.rates(docs, labels))
    assert len(got) == (0 if kind == "empty" else len(ROWS))
    assert all(r[4] >= 0 and r[5] >= 0 for r in got)
    if got:
        one = [r[1:] for r in got if r[0] == 1]
        assert one[0] == one[1]
        assert {r[1] for r in got if r[0] in (2, 3)} == {0}
    mixed = mixing.mix(docs, labels)
    assert mixed.schema == docs.schema
    assert mixed.count() == sum(r[5] for r in got)


def test_decontaminate(given):
    kind, docs, _, bench = given
    got = rows(decontaminate.passages(docs, bench))
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.schema == docs.schema
    assert {r[0] for r in got} == (set() if kind == "empty" else {6})
    assert clean.count() == (0 if kind == "empty" else len(ROWS) - 1)


def test_simhash(given):
    kind, docs, _, _ = given
    got = rows(simhash.duplicates(docs))
    assert got == ([] if kind == "empty" else [(5, 4)])
    left = simhash.keep_first(docs)
    assert left.columns == docs.columns
    ids = [r[0] for r in rows(left)]
    assert sorted(i for i in ids if i is not None) == ([] if kind == "empty" else [1, 2, 3, 4, 6, 7, 8])
    assert ids.count(None) == (0 if kind == "empty" else 2)


def test_tokens(given):
    kind, docs, _, _ = given
    got = rows(tokens.token_counts(docs, VOCABULARY))
    assert len(got) == (0 if kind == "empty" else len(ROWS))
    assert {r[1] for r in got if r[0] in (2, 3)} <= {0}


def test_secrets(given):
    kind, docs, _, _ = given
    assert rows(secrets.secrets(docs)) == []
    leak = docs.limit(2).withColumn("text", F.lit('api_key = "Zx81kQpL0vTn53RwYb7d"'))
    got = rows(secrets.secrets(leak))
    assert len(got) == (0 if kind == "empty" else 2)


def test_quality(given):
    kind, docs, labels, _ = given
    got = quality.resample(docs, labels)
    left = quality.keep_good(docs, labels)
    assert left.schema == docs.schema
    assert got.count() == left.count() <= docs.count()
    if kind != "empty":
        assert [r[0] for r in rows(left)].count(1) in (0, 2)  # rows that repeat share one fate


def test_quality_without_labels(spark):
    docs, labels, _ = tables(spark, "plain")
    assert quality.keep_good(docs, labels.where("false")).count() == len(ROWS)


def test_pii(given):
    kind, docs, _, _ = given
    got = rows(pii.pseudonymise(docs, key=KEY))
    assert len(got) == (0 if kind == "empty" else len(ROWS))
    assert {r[1] for r in got if r[0] == 3} <= {None}
    assert all(r[2] == 0 for r in got)


def test_toxicity(given):
    _, docs, labels, _ = given
    assert all(r[0] not in (2, 3) for r in rows(toxicity.toxic(docs, labels)))


def test_ann(spark):
    schema = "vec_id long, embedding array<float>, label int, id string, v int, part int"
    data = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [1.0]), (None, [0.0, 0.0]), (7, [float("nan"), 0.0]), (8, [None, 1.0])]
    got = rows(ann.neighbours(spark.createDataFrame([(*r, 0, "", 1, 2) for r in data], schema), k=3, every=1))
    assert sorted(got) == [(1, [2, 3], [1.0, 1.0]), (2, [3, 1], [0.0, 1.0]), (3, [2, 1], [0.0, 1.0])]
    assert rows(ann.neighbours(spark.createDataFrame([], schema))) == []


def test_sharding(given):
    kind, docs, _, _ = given
    got = rows(sharding.shards(docs, target=1000))
    assert len(got) == (0 if kind == "empty" else len(ROWS))
    wide = sharding.sharded(docs, target=1000)
    assert wide.columns == [c for c in docs.columns if c not in ("hilbert", "shard")] + ["hilbert", "shard"]
    assert wide.count() == len(got)
    if kind == "clashing":
        assert {(r["__lang"], r["__at"], r["x"]) for r in wide.collect()} == {tuple(CLASHING.index(c) for c in ("__lang", "__at", "x"))}


def test_stages(given, spark, tmp_path):
    kind, docs, labels, bench = given
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        assert (out.count() > 0) == (kind != "empty")
