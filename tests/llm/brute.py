"""Slow and plain versions of the operators, over lists of rows."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from siltstone.llm import decontaminate, quality, simhash


def words(text):
    """Words as (text in lower case, start, end) of ASCII and Latin-1 prose."""
    return [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-zÀ-ÖØ-öø-ÿ]+", text or "")]


def passages(docs, items, window=decontaminate.WINDOW):
    """(doc, item, start, end, words) by comparing every window of every text with every item's."""
    out = []
    for doc, text in docs:
        have = words(text)
        for item, other in items:
            theirs = [w for w, _, _ in words(other)]
            n = min(window, len(theirs))
            if not n:
                continue
            grams = {tuple(theirs[k : k + n]) for k in range(len(theirs) - n + 1)}
            runs = []
            for k in range(len(have) - n + 1):
                if tuple(w for w, _, _ in have[k : k + n]) in grams:
                    if runs and k <= runs[-1][1]:
                        runs[-1][1] = k + n
                    else:
                        runs.append([k, k + n])
            out += [(doc, item, have[a][1], have[b - 1][2], b - a) for a, b in runs]
    return sorted(out, key=str)


def roots(docs):
    """{id: least id of its group} of all that are grouped, by comparing all pairs of fingerprints."""
    raw = b"".join((t or "").encode() for _, t in docs)
    offs = np.concatenate([[0], np.cumsum([len((t or "").encode()) for _, t in docs])]).astype(np.int64)
    fp, some = simhash.fingerprints(np.frombuffer(raw, np.uint8), offs)
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, (x, _)), (b, (y, _)) in combinations(enumerate(docs), 2):
        if some[a] and some[b]:
            bits = int(np.unpackbits(fp[a] ^ fp[b]).sum())
            if bits <= simhash.MAX_DISTANCE and int((fp[a] == fp[b]).sum()) >= simhash.MIN_MATCHES:
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return {i: find(i) for i in root if find(i) != i}


def kept(docs, ratio, share, margin=2.0):
    """Indices of the rows that the quality classifier keeps: all keys sorted, the k-th taken."""
    texts, ids = pa.array([t for _, t in docs], pa.string()), pa.array([i for i, _ in docs], pa.int64())
    weight, key = quality.weights(ratio, texts), quality.keys(ratio, ids, texts)
    prior = np.log(share / (1 - share)) + margin if share < 1 else 50.0
    k = round(float((1 / (1 + np.exp(-np.maximum(-700, weight + prior)))).sum()))
    least = sorted(key, reverse=True)[k - 1] if k else np.inf
    return [i for i in range(len(docs)) if key[i] >= least]


def rates(p, n, target, tolerance=1e-4):
    """Projected gradient over the whole matrix at once, in the metric of the totals at rate 1, to convergence."""
    r, own = np.ones(len(p)), np.maximum(p.T @ n, 1e-9)
    while np.abs(p.T @ (n * r) - target).max() > tolerance * target.sum():
        r = np.maximum(0, r - p @ ((p.T @ (n * r) - target) / own))
    return r
