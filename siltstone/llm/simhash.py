"""Near duplicates by SimHash: every pair of fingerprints within MAX_DISTANCE bits is found.

A fingerprint is 64 bytes: the SimHash of the distinct words of at least four letters (of four bytes,
and single signs of Chinese or Japanese). Two texts of
which one has 5 % of its words changed differ in about a tenth of the bits. Such a pair need not have any
byte in common, so the index is no index of bytes: the 512 bits are cut in PARTS parts of WIDTH bits. Of two
fingerprints within 80 bits one part differs in 80 // 27 = 2 bits or fewer. Moreover, there is a part from
which on, in a circle, any k parts together differ in k * 80 / 27 bits or fewer: if the parts' surpluses
over 80 / 27 are summed up around the circle, it is the one after the greatest sum. So candidates are
looked up by all values within 2 bits of a part, compared by this part and the next two, and the few that
are left by all bits. No step leaves out a pair within the threshold.

Exact copies fold into one fingerprint before. Fingerprints are dealt to blocks, and one task searches two
blocks (or one) against each other, in memory. Of the pairs a task finds, those go out that join two
groups; groups are then the connected components. Within a task, fingerprints of one group and one value
are looked up as one, so that groups of thousands of near copies do not take quadratic work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut, fresh, narrow

WORDS64 = 8
BYTES = WORDS64 * 8
MAX_DISTANCE = 80
#: Equal bytes of a pair besides. As many as any pair within MAX_DISTANCE has, so that none is left out.
MIN_MATCHES = max(0, BYTES - MAX_DISTANCE)
PARTS, WIDTH = 27, 19
LONG_WORD = 4
#: Fingerprints of a block: a task holds two.
BLOCK = 500_000
#: Candidates compared at once.
CHUNK = 1 << 20
SALTS = [np.uint64(x) for x in np.random.RandomState(5).randint(1, 1 << 62, WORDS64)]


def fingerprints(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 64) bytes, and which texts have any word at all."""
    n = len(offs) - 1
    h, doc, s, e = tv.folded_words(raw, offs)
    out = np.zeros((n, BYTES), np.uint8)
    if not len(h):
        return out, np.zeros(n, bool)
    # four bytes, which words of other alphabets have with two letters, or a sign of Chinese or Japanese writing
    long = (e - s >= LONG_WORD) | (raw[np.minimum(s, len(raw) - 1)] >= 0xE3)
    use = long | (np.bincount(doc[long], minlength=n) == 0)[doc]  # without a long word all words count
    h, doc = h[use], doc[use]
    # the distinct words of each text: one sort of (text, hash)
    order = np.lexsort((h, doc)) if n > 1 else np.argsort(h)
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    for at in range(0, len(h), 1 << 15):  # bounded memory: BYTES * 8 flags a word
        part, owner = h[at : at + (1 << 15)], doc[at : at + (1 << 15)]
        if at == 0:
            sums = np.zeros((n, BYTES * 8), np.int32)
        bits = np.empty((len(part), WORDS64), np.uint64)
        for k, salt in enumerate(SALTS):
            bits[:, k] = tv.mix(part ^ salt)
        flags = np.unpackbits(bits.view(np.uint8), axis=1).view(np.uint64)  # 8 counters of a byte in each
        # runs of one text, cut at 255 words so that no counter overflows
        rank = np.arange(len(part)) - np.searchsorted(owner, owner, "left")
        starts = np.flatnonzero(rank % 255 == 0)
        counted = np.add.reduceat(flags, starts, axis=0).view(np.uint8)
        np.add.at(sums, owner[starts], counted)
    words = np.bincount(doc, minlength=n)
    out[:] = np.packbits(2 * sums > words[:, None], axis=1)
    return out, words > 0


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (64 bytes) of every row that has an id and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").cast(pa.int64())
            for i, j, raw, offs in tv.slices(batch.column("text")):
                fp, some = fingerprints(raw, offs)
                at = np.flatnonzero(some)
                data = pa.py_buffer(np.ascontiguousarray(fp[at]).tobytes())
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BYTES), len(at), [None, data])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + at)), fixed.cast(pa.binary())], ["id", "fp"])

    return narrow(docs, {"id": id_col, "text": text_col}).where(F.col("id").isNotNull()).mapInArrow(run, "id long, fp binary")


def _fp_array(column: pa.Array) -> np.ndarray:
    raw, offs = _binary(column)
    return raw[offs[0] : offs[-1]].reshape(-1, BYTES)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offs


def _window(wide: np.ndarray, part: int) -> np.ndarray:
    """64 bits of each fingerprint from the first one of a part on, in a circle."""
    word, bit = divmod(part * WIDTH, 64)
    out = wide[:, word] >> np.uint64(bit)
    return out | wide[:, (word + 1) % WORDS64] << np.uint64(64 - bit) if bit else out


def _bits(part: int, n: int = 1) -> int:
    """Bits of ``n`` parts from this one on, in a circle: the last part is shorter."""
    return sum(min(WIDTH, BYTES * 8 - k % PARTS * WIDTH) for k in range(part, part + n))


def _ones(n: int) -> np.uint64:
    return np.uint64((1 << n) - 1)


def _flips(bits: int, most: int) -> list[int]:
    """All numbers of ``bits`` bits of which at most ``most`` are set."""
    return [sum(1 << b for b in c) for k in range(min(bits, most) + 1) for c in combinations(range(bits), k)]


def key_rows(fp: np.ndarray) -> np.ndarray:
    """(n, keys): for each part and each two of its bits the number of the key and the part's value without the two.

    What the search looks up, written as keys, for tests: two fingerprints share a key of one column exactly if
    a part of theirs differs in two bits or fewer, as one does of any pair within MAX_DISTANCE.
    """
    wide, out = np.ascontiguousarray(fp).view(np.uint64), []
    for k in range(PARTS):
        value = _window(wide, k) & _ones(_bits(k))
        out += [value & ~np.uint64(1 << x | 1 << y) | np.uint64((len(out) + n) << WIDTH) for n, (x, y) in enumerate(combinations(range(_bits(k)), 2))]
    return np.stack(out, axis=1)


def _each(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, number) for all numbers below the count of each row, CHUNK at a time."""
    end = np.cumsum(count)
    total = int(end[-1]) if len(end) else 0
    if 0 < total <= CHUNK:
        row = np.repeat(np.arange(len(count)), count)
        yield row, np.arange(total) - (end - count)[row]
        return
    for t in range(0, total, CHUNK):
        at = np.arange(t, min(t + CHUNK, total))
        row = np.searchsorted(end, at, "right")
        yield row, at - (end - count)[row]


class _Groups:
    """The groups of a task's fingerprints, and the verified pairs that joined them."""

    def __init__(self, wide: np.ndarray, max_distance: int, min_matches: int) -> None:
        self.wide, self.max_distance, self.min_matches = wide, max_distance, min_matches
        self.label = np.arange(len(wide))
        self.pairs: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the groups of those pairs that meet the threshold."""
        for i in range(0, len(a), CHUNK // 8):
            self._add(a[i : i + CHUNK // 8], b[i : i + CHUNK // 8])

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        a, b = a[apart], b[apart]
        x, y = self.wide[a], self.wide[b]
        distance = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        near = distance <= self.max_distance
        if self.min_matches > 0:
            near &= (x.view(np.uint8) == y.view(np.uint8)).sum(axis=1) >= self.min_matches
        a, b, distance = a[near], b[near], distance[near]
        up: dict[int, int] = {}

        def find(k: int) -> int:
            while (over := up.get(k, k)) != k:
                up[k] = k = up.get(over, over)
            return k

        joins = np.zeros(len(a), bool)
        for k, (p, q) in enumerate(zip(self.label[a].tolist(), self.label[b].tolist(), strict=True)):
            p, q = find(p), find(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                joins[k] = True
        if up:
            move = np.arange(len(self.label))
            old = list(up)
            move[old] = [find(k) for k in old]
            self.label = move[self.label]
            self.pairs.append(np.stack([a[joins], b[joins], distance[joins]], axis=1))


class _Runs:
    """Fingerprints in the order of a part's value; those of one value and one group are a run."""

    def __init__(self, rows: np.ndarray, value: np.ndarray, label: np.ndarray, window: np.ndarray) -> None:
        order = np.argsort(value[rows].astype(np.uint64) << np.uint64(32) | label[rows].astype(np.uint64))
        self.rows = rows[order]
        v, g = value[self.rows], label[self.rows]
        self.start = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (g[1:] != g[:-1]))) if len(v) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.start, len(v)))
        self.value, self.label = v[self.start], g[self.start]
        self.first = self.rows[self.start]
        self.window = window[self.first]


def _search_part(groups: _Groups, part: int, left: np.ndarray, right: np.ndarray | None) -> None:
    """All pairs of a row of ``left`` and one of ``right`` (None: of ``left``) that the part makes candidates."""
    window = _window(groups.wide, part)
    value = (window & _ones(_bits(part))).astype(np.uint32)
    three, most = _ones(_bits(part, 3)), 3 * groups.max_distance // PARTS
    near = lambda x, y: np.bitwise_count((x ^ y) & three) <= most
    one = _Runs(left, value, groups.label, window)
    two = one if right is None else _Runs(right, value, groups.label, window)
    start = np.append(0, np.cumsum(np.bincount(one.value, minlength=1 << WIDTH)))
    held = start[1:] > start[:-1]
    flips = _flips(_bits(part), groups.max_distance // PARTS)
    for i in range(0, len(two.value), 1 << 16):
        own = two.value[i : i + (1 << 16)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for flip in flips:
            key = own ^ np.uint32(flip)
            hit = held[key]
            if right is None:  # each two values once
                hit &= key >= own
            hit = np.flatnonzero(hit)
            low = start[key[hit]]
            for row, k in _each(start[key[hit] + 1] - low):
                p, q = low[row] + k, hit[row] + i
                if right is None and not flip:
                    once = p < q
                    p, q = p[once], q[once]
                several = one.size[p] * two.size[q] > 1
                if several.any():
                    u, w = p[several], q[several]
                    apart = one.label[u] != two.label[w]
                    u, w = u[apart], w[apart]
                    for pair, n in _each(one.size[u] * two.size[w]):
                        a = one.rows[one.start[u[pair]] + n // two.size[w[pair]]]
                        b = two.rows[two.start[w[pair]] + n % two.size[w[pair]]]
                        ok = near(window[a], window[b])
                        groups.add(a[ok], b[ok])
                    p, q = p[~several], q[~several]
                ok = near(one.window[p], two.window[q])
                found.append((one.first[p[ok]], two.first[q[ok]]))
            if sum(len(f[0]) for f in found) > CHUNK or flip == flips[-1]:
                if found:
                    groups.add(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                found = []


def search(fp: np.ndarray, split: int | None, parts: range, max_distance: int, min_matches: int) -> np.ndarray:
    """Rows (a, b, distance): verified pairs of rows of ``fp`` that join all that the given parts make candidates.

    With ``split`` only rows before it are searched against those from it on.
    """
    groups = _Groups(np.ascontiguousarray(fp).view(np.uint64).reshape(-1, WORDS64), max_distance, min_matches)
    for part in range(0, PARTS, 3):  # neighbours in the order of their bits: joins large groups without looking at all their pairs
        order = np.argsort(_window(groups.wide, part))
        groups.add(order[:-1], order[1:])
    rows = np.arange(len(fp))
    for part in parts:
        _search_part(groups, part, rows[:split], None if split is None else rows[split:])
    out = np.concatenate([np.zeros((0, 3), np.int64), *groups.pairs])
    # pairs within a block are found where it is searched by itself
    return out if split is None else out[(out[:, 0] < split) != (out[:, 1] < split)]


def _deal(blocks: int, turns: int):
    """Rows (task, block, ids, fps): a batch's fingerprints of one block, for each task that searches it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fp = np.asarray(batch.column("id")), _fp_array(batch.column("fp"))
            own = tv.mix(ids.view(np.uint64)) % np.uint64(blocks)
            for block in np.unique(own).tolist():
                at = own == block
                tasks = [(max(block, k) * (max(block, k) + 1) // 2 + min(block, k)) * turns + t for k in range(blocks) for t in range(turns)]
                n = len(tasks)
                columns = [pa.array([x] * n, pa.binary()) for x in (ids[at].tobytes(), fp[at].tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), pa.array([block] * n, pa.int32()), *columns], ["task", "block", "ids", "fps"])

    return run


def _search_task(turns: int, max_distance: int, min_matches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list[tuple[np.ndarray, np.ndarray]]]] = {}
        for batch in batches:
            for task, block, i, f in zip(*(batch.column(c) for c in ("task", "block", "ids", "fps")), strict=True):
                ids, fp = np.frombuffer(i.as_buffer(), np.int64).copy(), np.frombuffer(f.as_buffer(), np.uint8).reshape(-1, BYTES).copy()
                held.setdefault(task.as_py(), {}).setdefault(block.as_py(), []).append((ids, fp))
        for task in sorted(held):
            blocks = held.pop(task)
            # a task of two blocks of which one is empty has nothing to search
            pair = task // turns
            high = int((np.sqrt(8 * pair + 1) - 1) // 2)
            if len(blocks) == 1 and pair != high * (high + 1) // 2 + high:
                continue
            pieces = [x for b in sorted(blocks) for x in blocks[b]]
            split = sum(len(x[0]) for x in blocks[min(blocks)]) if len(blocks) > 1 else None
            ids, fp = (np.concatenate([x[k] for x in pieces]) for k in range(2))
            del blocks, pieces
            out = search(fp, split, range(task % turns, PARTS, turns), max_distance, min_matches)
            a, b = ids[out[:, 0]], ids[out[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(out[:, 2])], ["a", "b", "distance"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """id, root of every node of the edges (a, b): root is the least id of its component.

    Alternating large-star and small-star steps; each halves the depth of the trees.
    """
    edges = cut(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: neighbours greater than the node go to its least neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the node and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = cut(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = state


def pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, min_matches: int = MIN_MATCHES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints, (id, rep) of exact copies of a fingerprint, and verified pairs (a, b, distance) of reps.

    The pairs join whatever pairs of reps meet the threshold: two reps are connected by them exactly if they
    are by all such pairs. The parts of few blocks are searched in several tasks.
    """
    fps = cut(fingerprint_table(docs, id_col, text_col))
    reps = cut(fps.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    copies = fps.join(reps.where("n > 1").select("fp", F.col("id").alias("rep")), "fp").where("id <> rep").select("id", "rep")
    blocks = max(1, -(-reps.count() // BLOCK))
    both = blocks * (blocks + 1) // 2
    turns = next(t for t in (1, 3, 9) if t * both >= 24 or t == 9)
    dealt = reps.select("fp", "id").mapInArrow(_deal(blocks, turns), "task int, block int, ids binary, fps binary")
    near = dealt.repartitionById(both * turns, F.col("task")).mapInArrow(_search_task(turns, max_distance, min_matches), "a long, b long, distance long")
    return fps, copies, near.distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, max_distance: int = MAX_DISTANCE, min_matches: int = MIN_MATCHES) -> tuple[DataFrame, DataFrame]:
    """Fingerprints, and (id, root) of every document but the least of its group."""
    fps, copies, near = pairs(docs, id_col=id_col, text_col=text_col, max_distance=max_distance, min_matches=min_matches)
    return fps, components(copies.select(F.col("id").alias("a"), F.col("rep").alias("b")).unionByName(near.select("a", "b")))


def duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, min_matches: int = MIN_MATCHES) -> DataFrame:
    """One row for each document to drop: its id and ``duplicate_of``, the least id of its group.

    Ids are whole numbers. Texts without any word (null, empty, signs only) and rows without an id are
    never grouped; texts of any length are read whole. Rows that repeat an id are one document here; see
    ``keep_first`` for the rows themselves. A bit that as many words set as not is 0. Extra columns are
    not read. An empty table gives no rows.
    """
    _, roots = _groups(docs, id_col, text_col, max_distance, min_matches)
    return roots.select(F.col("id").alias(id_col), F.col("root").alias("duplicate_of"))


def _name(text: Column, seed: int) -> Column:
    """What stands for the id of a row without one: rows of one text share it."""
    return F.xxhash64(F.lit(seed), text)


def _seed(rows: DataFrame) -> int:
    """The first seed with which no two texts of the rows (id, text) without an id share a name and no name is an id."""
    ids = rows.where("id is not null").select(F.col("id").cast("long").alias("name"))
    other = F.xxhash64("text")
    for seed in count():
        names = cut(rows.where("id is null").groupBy(_name(F.col("text"), seed).alias("name")).agg((F.min(other) != F.max(other)).alias("shared")))
        if names.where("shared").isEmpty() and names.join(ids, "name", "left_semi").isEmpty():
            return seed


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the duplicates: of each group the row with the least id stays.

    Of rows that repeat an id one stays, the one whose values sort first. Rows without an id are grouped
    like all others: one stays only of a group without any id, the one whose text has the least hash (of
    rows of one text the one whose values sort first). Texts without a word stay, unless they repeat an
    id. Columns of any name stay. An empty table stays empty.
    """
    columns, own = docs.columns, F.col(f"`{id_col}`")
    gone, again, key, row, name = (fresh(docs, n) for n in ("__drop", "__twice", "__key", "__row", "__name"))
    twice = cut(docs.select(own.alias(again)).groupBy(again).count().where(f"count > 1 or {again} is null").select(again))
    if twice.where(f"{again} is null").isEmpty():
        drop = duplicates(docs, id_col=id_col, text_col=text_col).select(F.col(id_col).alias(gone))
    else:
        seed = _seed(narrow(docs, {"id": id_col, "text": text_col}))
        docs = docs.withColumn(name, F.coalesce(own.cast("long"), _name(F.col(f"`{text_col}`"), seed)))
        fps, roots = _groups(docs, name, text_col)
        names = cut(docs.where(own.isNull()).groupBy(F.col(name).alias("id")).count().join(fps.select("id"), "id", "left_semi"))
        members = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct()).join(names.select("id", F.lit(1).alias("last")), "id", "left")
        first = members.groupBy("root").agg(F.min(F.struct(F.coalesce("last", F.lit(0)), "id"))["id"].alias("first"))
        drop = members.join(first, "root").where("id <> first").select(F.col("id").alias(gone))
        twice = cut(twice.where(f"{again} is not null").select(F.col(again).cast("long")).union(names.where("count > 1").select("id")).toDF(again))
        own = F.col(name)
    left = docs.join(cut(drop), own == F.col(gone), "left_anti")
    if not twice.isEmpty():
        single = left.join(twice, own == F.col(again), "left_anti")
        several = left.join(twice, own == F.col(again), "left_semi")
        one = several.groupBy(own.alias(key)).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in several.columns])).alias(row)).select(f"{row}.*")
        left = single.unionByName(one)
    return left.select(*[F.col(f"`{c}`") for c in columns])
