"""Whole-column text work on Arrow buffers: no Python object per word.

A column of texts is taken as one byte array plus offsets. Words, their hashes and the normalised
text come from a handful of array operations per slice; slices hold whole texts, about SLICE bytes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE, WORD, MARK = 0, 1, 2

_rng = np.random.RandomState(20240117)
BYTE_CODE = _rng.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CLASS = np.full(256, MARK, np.uint8)
BYTE_CLASS[:33] = SPACE
BYTE_CLASS[127] = SPACE
BYTE_CLASS[128:] = WORD
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    BYTE_CLASS[_c] = WORD
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) for i < n, modulo 2**64."""
    key = "i" if inverse else "p"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, SLICE + (SLICE >> 2))
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = INVERSE if inverse else BASE
        np.multiply.accumulate(have, out=have)
        if n <= 4 * SLICE:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if offsets is not None and offsets.size else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): whole texts, together about ``size`` bytes."""
    raw, offs = buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def classes(raw: np.ndarray) -> np.ndarray:
    """Class of each byte. Latin-1 signs (C2 80..BF) and general punctuation (E2 80 xx) separate words."""
    cls = BYTE_CLASS[raw]
    at = np.flatnonzero(raw == 0xC2)
    if len(at):
        cls[at] = SPACE
        cls[np.minimum(at + 1, len(raw) - 1)] = SPACE
    at = np.flatnonzero(raw[:-1] == 0xE2) if len(raw) > 1 else at[:0]
    at = at[raw[at + 1] == 0x80]
    for k in range(3):
        cls[np.minimum(at + k, len(raw) - 1)] = SPACE
    return cls


def lower(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, byte for byte."""
    low = LOWER[raw]
    at = np.flatnonzero(raw == 0xC3) + 1
    at = at[at < len(raw)]
    at = at[(raw[at] >= 0x80) & (raw[at] <= 0x9E) & (raw[at] != 0x97)]
    low[at] += 32
    return low


def runs(cls: np.ndarray, offs: np.ndarray, only_words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of one class that is no space (or of words only)."""
    n = len(cls)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:n])
    new[offs[offs < n]] = True
    at = np.flatnonzero(new)
    kind = cls[at[:-1]]
    keep = kind == WORD if only_words else kind != SPACE
    s, e = at[:-1][keep], at[1:][keep]
    return s, e, np.searchsorted(offs, s, "right") - 1


def prefix(raw: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any span comes in two look-ups."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * powers(len(raw)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((sums[e] - sums[s]) * powers(len(sums), inverse=True)[s])


def hash_of(word: str) -> int:
    """The hash that span_hash gives this word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix(raw), np.array([0]), np.array([len(raw)]))[0])


def word_hashes(raw: np.ndarray, offs: np.ndarray, only_words: bool = True, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end of each word, and the running sums."""
    s, e, doc = runs(classes(raw), offs, only_words)
    sums = prefix(lower(raw) if fold else raw)
    return span_hash(sums, s, e), doc, s, e, sums


#: A word outside Latin: letters, digits and their marks; each sign of Chinese or Japanese writing is a word.
_WIDE_WORD = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]|(?:[^\\W_\u0080-\u00bf\u203f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]|[\u0300-\u036f])+")


def wide_texts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Numbers of the texts with signs beyond Latin-1 and general punctuation."""
    at = np.flatnonzero(raw >= 0xC4)
    if len(at):
        after = raw[np.minimum(at + 1, len(raw) - 1)]
        at = at[(raw[at] != 0xE2) | (after != 0x80)]
    return np.unique(np.searchsorted(offs, at, "right") - 1)


def folded_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end of each word, whatever its writing.

    Case is folded and composed and decomposed letters are one. Latin-1 text, nearly all of most
    corpora, takes the way of ``word_hashes``; only the other texts are read sign by sign.
    """
    h, doc, s, e, _ = word_hashes(raw, offs)
    wide = wide_texts(raw, offs)
    if not len(wide):
        return h, doc, s, e
    folded, owner, starts, ends = [], [], [], []
    for k in wide.tolist():
        text = raw[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace")
        at, last = int(offs[k]), 0
        for m in _WIDE_WORD.finditer(text):
            at += len(text[last : m.start()].encode())
            size = len(m.group().encode())
            folded.append(unicodedata.normalize("NFC", m.group()).lower().encode())
            owner.append(k)
            starts.append(at)
            ends.append(at + size)
            at, last = at + size, m.end()
    keep = ~np.isin(doc, wide)
    joined = np.frombuffer(b"".join(folded), np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(f) for f in folded])]).astype(np.int64)
    more = span_hash(prefix(joined), edge[:-1], edge[1:]) if len(folded) else h[:0]
    h, doc, s, e = (np.concatenate([old[keep], np.array(new, old.dtype)]) for old, new in ((h, more), (doc, owner), (s, starts), (e, ends)))
    order = np.argsort(s, kind="stable")
    return h[order], doc[order], s[order], e[order]


def unit_hash(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each integer id."""
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 2 + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def ids_of(column: pa.Array) -> np.ndarray:
    """Integer ids; a null counts as 0."""
    return np.asarray(pc.fill_null(column.cast(pa.int64()), 0))
