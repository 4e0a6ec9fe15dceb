"""Quality classifier by importance resampling.

Two hashed n-gram models are counted: one over the labelled good documents (the target), one over
every document (the raw text). A document's log weight is the sum over its n-grams of
log p_target - log p_raw; Gumbel noise drawn from its id is added, and the k greatest keys are kept,
which samples k documents without replacement in proportion to their weights.

k is the expected number of documents of the target kind: the sum of sigmoid(weight + prior).
The k-th key is found exactly, by histograms of ever finer cells over a narrow table; no sort.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import bounded_sample, cut, narrow

BITS = 16
SIZE = 1 << BITS
REPEAT = np.uint64(0x5851F42D4C957F2D)
MAX_LABELLED = 20_000
SEED = 11


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each unigram and bigram. Words and signs keep their case; a word that
    follows itself is one feature of its own, whatever the word."""
    h, doc, _, _, _ = tv.word_hashes(raw, offs, only_words=False, fold=False)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    a, b = h[pair], h[pair + 1]
    big = np.where(a == b, REPEAT, tv.mix(a * np.uint64(3) + (b ^ REPEAT)))
    shift = np.uint64(64 - BITS)
    return np.concatenate([doc, doc[pair]]), np.concatenate([h >> shift, big >> shift]).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw_n, target_n = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
    for batch in batches:
        good = np.asarray(batch.column("good").fill_null(False)).astype(bool)
        for i, j, raw, offs in tv.slices(batch.column("text")):
            doc, bucket = features(raw, offs)
            raw_n += np.bincount(bucket, minlength=SIZE)
            if good[i:j].any():
                target_n += np.bincount(bucket[good[i:j][doc]], minlength=SIZE)
    at = np.flatnonzero(raw_n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw_n[at]), pa.array(target_n[at])], ["bucket", "raw_n", "target_n"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, smoothing: float = 30.0) -> tuple[np.ndarray, float]:
    """Log ratio of each bucket, and the share of good documents among the labelled ones.

    ``smoothing`` counts are added on both sides: words that only the fitted documents have must not
    weigh, or all others would be rejected where few rows are labelled.

    The target model is fitted on at most ``max_labelled`` labelled rows; the raw model on all of
    ``docs``. Rows whose label or id is null teach nothing. Without any good document in ``docs`` the
    ratios are 0 and the share is 1, so that everything is kept.
    """
    known = narrow(labels, {"id": id_col, "label": label_col}).where(F.col("label").isNotNull())
    sample = cut(bounded_sample(known, max_labelled, SEED, "id"))
    n, good = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0))).first()
    ids = F.broadcast(sample.where(F.col("label") == 1).select("id", F.lit(True).alias("good")))  # at most max_labelled rows
    rows = narrow(docs, {"id": id_col, "text": text_col}).join(ids, "id", "left").select("text", "good")
    counts = rows.mapInArrow(_count, "bucket long, raw_n long, target_n long").groupBy("bucket").agg(F.sum("raw_n").alias("raw_n"), F.sum("target_n").alias("target_n")).toArrow()
    raw, target = np.zeros(SIZE), np.zeros(SIZE)
    at = np.asarray(counts.column("bucket"))
    raw[at], target[at] = np.asarray(counts.column("raw_n")), np.asarray(counts.column("target_n"))
    if not target.sum():
        return np.zeros(SIZE, np.float32), 1.0
    # what the raw model, scaled to the target's size, expects in each bucket; pseudo-counts on both sides
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + smoothing) / (expected + smoothing)).astype(np.float32), min(max(good / max(n, 1), 0.01), 0.999)


def weights(ratio: np.ndarray, column: pa.Array) -> np.ndarray:
    """Log importance weight of each text: 0 for a null or empty one."""
    out = np.zeros(len(column))
    for i, j, raw, offs in tv.slices(column):
        doc, bucket = features(raw, offs)
        out[i:j] = np.bincount(doc, weights=ratio[bucket], minlength=j - i)
    return np.round(out, 4)


def keys(ratio: np.ndarray, ids: pa.Array, texts: pa.Array) -> np.ndarray:
    return np.round(weights(ratio, texts) - np.log(-np.log(tv.unit_hash(tv.ids_of(ids), SEED))), 4)


def scores(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, log_weight, gumbel_key of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = weights(ratio, batch.column("text"))
            g = np.round(w - np.log(-np.log(tv.unit_hash(tv.ids_of(batch.column("id")), SEED))), 4)
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(w), pa.array(g)], ["id", "log_weight", "gumbel_key"])

    return narrow(docs, {"id": id_col, "text": text_col}).mapInArrow(score, "id long, log_weight double, gumbel_key double")


def kth_greatest(df: DataFrame, column: str, k: int) -> float:
    """The exact k-th greatest value, by histograms of 4096 cells narrowed until one value is left."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return math.inf
    above = 0
    while high > low:
        width = (high - low) / 4096
        cell = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(4095)).cast("int")
        rows = df.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("cell")).collect()
        for r in rows:
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
        else:
            return low
    return low


def threshold(scored: DataFrame, share: float, margin: float = 2.0) -> float:
    """The key that k rows reach. ``margin`` is in nats, in favour of documents without evidence."""
    prior = math.log(share / (1 - share)) + margin if share < 1 else 50.0
    k = scored.agg(F.sum(1 / (1 + F.exp(-(F.greatest(F.lit(-700.0), F.col("log_weight") + prior)))))).first()[0]
    return kth_greatest(scored, "gumbel_key", round(k or 0))


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The kept documents: id, log_weight, gumbel_key.

    Ids are whole numbers. Null and empty texts have weight 0 and stand by their noise alone; texts of
    any length are scored whole. Rows that tie with the last kept key stay, so repeated rows share one
    fate; a null id draws as id 0. Extra columns are not read. An empty table gives an empty result.
    """
    ratio, share = fit(docs, labels, id_col=id_col, text_col=text_col, max_labelled=max_labelled)
    scored = cut(scores(docs, ratio, id_col, text_col))
    return scored.where(F.col("gumbel_key") >= threshold(scored, share)).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; the texts are scored again instead of shuffled.

    Nulls, ties, repeated rows and empty tables as in ``resample``; a null id draws as id 0.
    """
    ratio, share = fit(docs, labels, id_col=id_col, text_col=text_col, max_labelled=max_labelled)
    least = threshold(cut(scores(docs, ratio, id_col, text_col)), share)
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keys(ratio, batch.column(at_id), batch.column(at_text)) >= least))

    return docs.mapInArrow(kept, docs.schema)
