"""Mixing sources to target weights, with soft membership.

A softmax classifier, trained on labelled rows, predicts each document's posterior over domains. The
rates r >= 0 minimise the squared distance of the expected domain token totals,
sum over documents of r * tokens * posterior, from the targets. Projected gradient steps start at
rate 1, in the metric weighted by tokens; each step is one aggregation over the cluster that returns
one number a domain. A document's rate follows from its posterior and the few step vectors, so no
rate column is ever kept or shuffled. Rate r gives floor(r) copies and one more by chance.

The step is 1 in the metric of the totals at rate 1: a document's posteriors add up to 1, so no
direction is steeper. The steps end when the targets are met or cannot be approached any further.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import bounded_sample, cut, narrow

DIM = 2048
MAX_LABELLED = 3000
SEED = 23
#: Greatest deviation from a target, as a share of all tokens; and what ten steps must take off it to go on.
TOLERANCE, PROGRESS = 1e-4, 0.01


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, DIM) shares of hashed byte trigrams that cross no text border, and the number of words."""
    n = len(offs) - 1
    low = tv.lower(raw).astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(offs))
    out = np.zeros((n, DIM), np.float32)
    if len(low) > 2:
        code = ((low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(21)
        inside = doc[2:] == doc[:-2]
        step = max(1, (4 << 20) // DIM)
        for a in range(0, n, step):  # bounded memory
            b = min(n, a + step)
            lo, hi = offs[a], max(offs[a], min(offs[b], len(raw) - 2))
            use = inside[lo:hi]
            cell = (doc[lo:hi] - a)[use] * DIM + code[lo:hi][use]
            out[a:b] = np.bincount(cell, minlength=(b - a) * DIM).reshape(b - a, DIM)
        out /= np.maximum(out.sum(axis=1, keepdims=True), 1)
    _, _, owner = tv.runs((raw > 32).astype(np.uint8), offs, True)
    return np.sqrt(out), np.bincount(owner, minlength=n)


@dataclass(frozen=True)
class Model:
    """Domains, weights (DIM + 1, domains), and the steps taken so far (steps, domains)."""

    domains: tuple[str, ...]
    weights: np.ndarray
    steps: np.ndarray

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n, domains) and tokens. A text without three bytes has the training shares."""
        p, n = np.zeros((len(texts), len(self.domains))), np.zeros(len(texts), np.int64)
        for i, j, raw, offs in tv.slices(texts):
            x, n[i:j] = features(raw, offs)
            p[i:j] = softmax(x @ self.weights[:-1] + self.weights[-1])
        return np.round(p, 6), n

    def rates(self, p: np.ndarray) -> np.ndarray:
        return replay(p, self.steps)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def replay(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The rate after all steps, each followed by the projection on r >= 0."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return r


def train(x: np.ndarray, y: np.ndarray, n_domains: int, rounds: int = 150, l2: float = 1e-5) -> np.ndarray:
    """Softmax regression by accelerated gradient descent, on the driver, over the bounded sample."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = v = np.zeros((x.shape[1], n_domains), np.float32)
    hot = np.eye(n_domains, dtype=np.float32)[y]
    for k in range(rounds):
        new = v - 4.0 * (x.T @ (softmax(x @ v) - hot) / len(x) + l2 * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w


def fit_classifier(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, domain_col: str, max_labelled: int) -> Model:
    """Trained on at most ``max_labelled`` documents that ``labels`` lists and whose domain is known."""
    ids = F.broadcast(cut(bounded_sample(labels.select(F.col(id_col).alias("id"), F.lit(1).alias("one")), max_labelled, SEED, "id").select("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offs in tv.slices(batch.column("text")):
                x, _ = features(raw, offs)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i).cast(pa.int64()), batch.column("domain").slice(i, j - i).cast(pa.string()), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["id", "domain", "x"])

    rows = narrow(docs, {"id": id_col, "text": text_col, "domain": domain_col}).where("domain is not null").join(ids, "id", "left_semi")
    table = rows.mapInArrow(run, "id long, domain string, x binary").dropDuplicates(["id"]).orderBy("id").toArrow()
    if not len(table):
        return Model(("",), np.zeros((DIM + 1, 1), np.float32), np.zeros((0, 1)))
    names = np.array(table.column("domain").to_pylist())
    domains, y = np.unique(names, return_inverse=True)
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float16).reshape(-1, DIM).astype(np.float32)
    return Model(tuple(map(str, domains)), train(x, y, len(domains)), np.zeros((0, len(domains))))


def members(docs: DataFrame, model: Model, *, id_col: str, text_col: str) -> DataFrame:
    """id, n_tokens, p (posterior over model.domains) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = model.posteriors(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(n), _lists(p)], ["id", "n_tokens", "p"])

    return narrow(docs, {"id": id_col, "text": text_col}).mapInArrow(run, "id long, n_tokens long, p array<double>")


def _lists(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, max(1, p.shape[1]), dtype=np.int32)), pa.array(p.ravel()))


def totals(table: DataFrame, steps: np.ndarray, n_domains: int) -> np.ndarray:
    """Expected tokens of each domain under the rates after ``steps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(n_domains)
        for batch in batches:
            p = np.asarray(batch.column("p").flatten()).reshape(-1, n_domains)
            t += p.T @ (np.asarray(batch.column("n_tokens")).astype(np.float64) * replay(p, steps))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_domains, dtype=np.int32)), pa.array(t)], ["k", "v"])

    # summed by domain on the cluster, so that what reaches the driver does not grow with the number of partitions
    out = np.zeros(n_domains)
    for r in table.select("n_tokens", "p").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


def tempered(t: np.ndarray, power: float = 0.7) -> np.ndarray:
    """Default targets: shares to the given power, with the same total."""
    share = np.where(t > 0, t, 0) ** power
    return share / max(share.sum(), 1e-300) * t.sum()


def targets(domains: tuple[str, ...], weights: dict[str, float] | None, t: np.ndarray) -> np.ndarray:
    """Tokens each domain shall have: the weights' shares of all tokens. A weight for a domain that the model does not know is an error."""
    if weights is None:
        return tempered(t)
    unknown = sorted(d for d, w in weights.items() if w and d not in domains)
    if unknown:
        raise ValueError(f"no labelled document is of the domains {unknown}; known are {list(domains)}")
    if min(weights.values(), default=0) < 0 or not sum(weights.values()) > 0:
        raise ValueError("weights must be 0 or more, and not all 0")
    return np.array([weights.get(d, 0.0) for d in domains]) / sum(weights.values()) * t.sum()


def fit(docs: DataFrame, labels: DataFrame, *, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", max_labelled: int = MAX_LABELLED) -> tuple[Model, DataFrame]:
    """The model with its steps, and the table (id, n_tokens, p). ``weights`` are target shares of the tokens.

    A known domain without a weight gets none. Without ``weights`` the shares of the classified corpus
    are flattened by the power 0.7. Where targets cannot be met (no document leans to a domain enough)
    the nearest totals are taken and a warning tells how far off they are. An empty table takes no step.
    """
    model = fit_classifier(docs, labels, id_col=id_col, text_col=text_col, domain_col=domain_col, max_labelled=max_labelled)
    table = cut(members(docs, model, id_col=id_col, text_col=text_col))
    k = len(model.domains)
    t = own = totals(table, np.zeros((0, k)), k)
    if not t.sum():
        return model, table
    target = targets(model.domains, weights, t)
    steps, off = np.zeros((0, k)), [float(np.abs(t - target).max() / target.sum())]
    while off[-1] > TOLERANCE and (len(off) <= 10 or off[-1] < (1 - PROGRESS) * off[-11]):
        steps = np.vstack([steps, np.round((t - target) / np.maximum(own, 1e-9), 12)])
        t = totals(table, steps, k)
        off.append(float(np.abs(t - target).max() / target.sum()))
    if off[-1] > TOLERANCE:
        warnings.warn(f"the totals are off their targets by up to {off[-1]:.2%} of all tokens after {len(steps)} steps", stacklevel=2)
    return Model(model.domains, model.weights, steps), table


def copies(ids: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """floor(rate), and one more with the probability of the rest; drawn from the id."""
    whole = np.floor(rate)
    return (whole + (tv.unit_hash(ids, SEED) < rate - whole)).astype(np.int64)


def rates(docs: DataFrame, labels: DataFrame, *, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """id, n_tokens, domain (the likeliest), posterior, rate, copies of every row.

    Ids are whole numbers. Texts that are null or empty have no tokens and the posterior of the training shares; texts of any
    length are classified whole; rows that repeat get the same rate and copies each; a null id draws as
    id 0. Of equal posteriors the lesser domain is the likeliest. Extra columns are not read. An empty
    table gives no rows, and so nothing to fit.
    """
    model, table = fit(docs, labels, weights=weights, id_col=id_col, text_col=text_col, domain_col=domain_col, max_labelled=max_labelled)
    names = np.array(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column("p").flatten()).reshape(-1, len(names))
            r = model.rates(p)
            n = copies(tv.ids_of(batch.column("id")), r)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_tokens"), pa.array(names[p.argmax(axis=1)].tolist(), pa.string()), batch.column("p"), pa.array(np.round(r, 6)), pa.array(n)], ["id", "n_tokens", "domain", "posterior", "rate", "copies"])

    return table.mapInArrow(run, "id long, n_tokens long, domain string, posterior array<double>, rate double, copies long").withColumnRenamed("id", id_col)


def mix(docs: DataFrame, labels: DataFrame, *, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with each row as often as its copies say, all columns kept; texts are classified again, not shuffled.

    Nulls, ties, repeated rows, long texts and empty tables as in ``rates``; columns of any name stay.
    Copies keep their id, so ids repeat from here on.
    """
    model, _ = fit(docs, labels, weights=weights, id_col=id_col, text_col=text_col, domain_col=domain_col, max_labelled=max_labelled)
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, _ = model.posteriors(batch.column(at_text))
            n = copies(tv.ids_of(batch.column(at_id)), model.rates(p))
            for i in range(0, len(batch), 1024):
                yield batch.take(pa.array(np.repeat(np.arange(i, min(i + 1024, len(batch))), n[i : i + 1024])))

    return docs.mapInArrow(run, docs.schema)
