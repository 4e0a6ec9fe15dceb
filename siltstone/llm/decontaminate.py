"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark.

Texts are normalised to words: case folded, composed and decomposed letters made one, signs and white
space dropped, each Chinese or Japanese sign a word. Benchmark items are cut in windows of WINDOW
words, and all windows make one automaton over words. Every word knows where it stands in the original
text, so offsets need no way back.

The automaton is a handful of sorted number arrays: about 170 bytes a word of the benchmark (25 times
its text), sent to the workers once, by broadcast. A text is scanned once: first all its words at a
time take their first steps from the root, which leaves only the runs in which a window can begin;
these the automaton walks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import narrow

WINDOW = 8
#: Items of fewer words say too little to be found within a text: they are found only where they are the whole text.
LEAST_WORDS = 5
#: Bytes of benchmark text in one automaton (200 MB of arrays); a greater benchmark is scanned in several, one after another.
AUTOMATON_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, start long, end long, n_words long"
NONE = -1


@dataclass(frozen=True)
class Automaton:
    """States are numbered level by level from the root, 0; state k + 1 is reached by ``edges[k]`` = (state, word).

    ``edges`` is sorted, as the states of a level are by the state they come from. ``fail`` is the state
    of the longest proper suffix; ``out`` the window that ends at a state, ``chain`` the next state on
    the way of failures at which one ends.
    """

    words: np.ndarray  # sorted hashes; word k + 1 is words[k], 0 is any other
    edges: np.ndarray
    fail: np.ndarray
    out: np.ndarray
    chain: np.ndarray
    depth: np.ndarray
    items: tuple[np.ndarray, np.ndarray]  # offsets by window, item ids
    lengths: np.ndarray  # words of each window
    least: int  # words of the shortest window
    whole: dict[bytes, tuple[int, ...]]  # short items, by their words

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states reached, or NONE."""
        want = state.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)
        at = np.searchsorted(self.edges, want)
        there = np.minimum(at, max(len(self.edges) - 1, 0))
        return np.where((at < len(self.edges)) & (self.edges[there] == want) & (word > 0), there + 1, NONE) if len(self.edges) else np.full(len(want), NONE)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)

    def depth_of(self, window: int) -> int:
        return int(self.lengths[window])

    def walk(self, word: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place of the last word, window) of every window in a run of words."""
        state = 0
        for place, w in enumerate(word.tolist()):
            while True:
                new = int(self.step(np.array([state]), np.array([w]))[0])
                if new != NONE or not state:
                    break
                state = int(self.fail[state])
            state = max(new, 0)
            hit = state if self.out[state] != NONE else int(self.chain[state])
            while hit > 0:
                yield place, int(self.out[hit])
                hit = int(self.chain[hit])


def build(items: list[tuple[int, str]], window: int = WINDOW, least_words: int = LEAST_WORDS) -> Automaton:
    """The automaton of the windows of all items. Items without any word have none."""
    raw = np.frombuffer("".join(t for _, t in items).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in items])]).astype(np.int64)
    h, owner, _, _ = tv.folded_words(raw, offs)
    n = np.bincount(owner, minlength=len(items))
    first = np.cumsum(n) - n
    whole: dict[bytes, list[int]] = {}
    for k in np.flatnonzero((n > 0) & (n < min(window, least_words))):
        whole.setdefault(h[first[k] : first[k] + n[k]].tobytes(), []).append(items[k][0])
    long = np.repeat(n >= min(window, least_words), n)
    words = np.unique(h[long])
    word = np.searchsorted(words, h) + 1 if len(words) else np.zeros(len(h), np.int64)
    size = np.minimum(n, window)  # of each item's windows
    place = np.arange(len(h)) - np.repeat(first, n)
    start = np.flatnonzero(long & (place + np.repeat(size, n) <= np.repeat(n, n)))
    span = size[owner[start]]
    state = np.zeros(len(start), np.int64)
    edges, fail, depth = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int8)]
    found = 0
    for d in range(window):
        on = span > d
        key = state[on].astype(np.uint64) << np.uint64(32) | word[start[on] + d].astype(np.uint64)
        new, at = np.unique(key, return_inverse=True)
        state[on] = found + 1 + at
        edges.append(new)
        found += len(new)
        depth.append(np.full(len(new), d + 1, np.int8))
    every = np.concatenate(edges) if edges else np.zeros(0, np.uint64)
    made = Automaton(words, every, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.concatenate(depth), (np.zeros(1, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int8), 0, {})
    fails = np.zeros(found + 1, np.int64)
    low = 1 + len(edges[0]) if edges else 1
    for level in edges[1:]:  # the failure of (state, word) is the step by the word from a failure of the state
        own = np.arange(low, low + len(level))
        from_, by = (level >> np.uint64(32)).astype(np.int64), (level & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at, todo = fails[from_], np.arange(len(level))
        while len(todo):
            to = made.step(at[todo], by[todo])
            fails[own[todo[to != NONE]]] = to[to != NONE]
            left = todo[(to == NONE) & (at[todo] != 0)]
            at[left] = fails[at[left]]
            todo = left
        low += len(level)
    out = np.full(found + 1, NONE, np.int64)
    ends = np.unique(state) if len(state) else state
    out[ends] = np.arange(len(ends))
    chain = np.zeros(found + 1, np.int64)
    for a, b in zip(np.cumsum([1, *map(len, edges)])[:-1], np.cumsum([1, *map(len, edges)])[1:], strict=True):
        chain[a:b] = np.where(out[fails[a:b]] != NONE, fails[a:b], chain[fails[a:b]])
    pairs = np.unique(np.stack([out[state], np.array([i for i, _ in items], np.int64)[owner[start]]]), axis=1) if len(start) else np.zeros((2, 0), np.int64)
    offsets = np.searchsorted(pairs[0], np.arange(len(ends) + 1))
    return Automaton(words, every, fails.astype(np.int32), out.astype(np.int32), chain.astype(np.int32), np.concatenate(depth), (offsets, pairs[1]), np.concatenate(depth)[ends], int(span.min()) if len(span) else 0, {k: tuple(v) for k, v in whole.items()})


def hits(made: Automaton, raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start byte, end byte, words) of each passage: windows of one item that overlap or touch make one.

    Bytes count from the start of the slice.
    """
    h, doc, s, e = tv.folded_words(raw, offs)
    if made.whole:
        cuts = np.searchsorted(doc, np.arange(len(offs)))
        for k in range(len(offs) - 1):
            for item in made.whole.get(h[cuts[k] : cuts[k + 1]].tobytes(), ()) if cuts[k] < cuts[k + 1] else ():
                yield k, item, int(s[cuts[k]]), int(e[cuts[k + 1] - 1]), int(cuts[k + 1] - cuts[k])
    if not made.least or not len(h):
        return
    word = made.ids(h)
    # where a window may begin: the words there take ``least`` steps from the root, all at once
    start, state = np.flatnonzero(word), np.zeros(int((word > 0).sum()), np.int64)
    for d in range(made.least):
        inside = start + d < len(word)
        inside[inside] = doc[start[inside] + d] == doc[start[inside]]
        start, state = start[inside], state[inside]
        state = made.step(state, word[start + d])
        start, state = start[state != NONE], state[state != NONE]
    if not len(start):
        return
    # beginnings less than a window apart make one run, which the automaton walks
    longest = int(made.depth.max())
    parts = np.flatnonzero(np.append(True, (start[1:] - start[:-1] > longest) | (doc[start[1:]] != doc[start[:-1]])))
    spans: dict[tuple[int, int], list[list[int]]] = {}
    for a, b in zip(parts, np.append(parts[1:], len(start)), strict=True):
        k, low = int(doc[start[a]]), int(start[a])
        high = min(int(start[b - 1]) + longest, int(np.searchsorted(doc, k, "right")))
        for place, window in made.walk(word[low:high]):
            first = low + place + 1 - made.depth_of(window)
            for item in made.items[1][made.items[0][window] : made.items[0][window + 1]].tolist():
                own = spans.setdefault((k, item), [])
                if own and first <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], first), max(own[-1][1], low + place + 1)
                else:
                    own.append([first, low + place + 1])
    for (k, item), own in sorted(spans.items()):
        for a, b in own:
            yield k, item, int(s[a]), int(e[b - 1]), b - a


def _chars(raw: np.ndarray, a: int, b: int) -> int:
    return int(((raw[a:b] & 0xC0) != 0x80).sum())


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of AUTOMATON_BYTES; rows with a null id or text match nothing."""
    part: list[tuple[int, str]] = []
    size = 0
    for r in narrow(benchmark, {"item": item_col, "text": text_col}).where("item is not null and text is not null").distinct().orderBy("item", "text").toLocalIterator():
        if size + len(r["text"]) > AUTOMATON_BYTES and part:
            yield part
            part, size = [], 0
        part.append((r["item"], r["text"]))
        size += len(r["text"])
    yield part


def passages(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, start, end (characters of the original text), n_words of every shared passage.

    A passage is a maximal run in which each window of ``window`` words is one of the item's. Items
    shorter than that are one window; those under LEAST_WORDS words are found only as a whole text.
    Ids are whole numbers. Null and empty texts have no passage, texts of any length are scanned whole;
    repeated rows give their passages each; a null id stays null; of passages of several items each is
    given, so there are no ties. Extra columns are not read. An empty table or benchmark gives no rows.
    """
    out = None
    for items in items_of(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(build(items, window))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("id").cast(pa.int64())
                for i, _, raw, offs in tv.slices(batch.column("text")):
                    rows = [(ids[i + k].as_py(), item, _chars(raw, offs[k], a), _chars(raw, offs[k], b), n) for k, item, a, b, n in hits(sent.value, raw, offs)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "start", "end", "n_words"])

        part = narrow(docs, {"id": id_col, "text": text_col}).mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("doc_id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that share no passage with the benchmark, with all their columns, whatever their names.

    Null and empty texts share none and stay, texts of any length are scanned whole; rows that repeat
    share one fate; an empty benchmark removes nothing, an empty table stays empty.
    """
    at = docs.columns.index(text_col)
    for items in items_of(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(build(items, window))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for i, _, raw, offs in tv.slices(batch.column(at)):
                    for hit in hits(sent.value, raw, offs):
                        clean[i + hit[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
