"""Token counts by compiled finite-state transducers.

Two deterministic transducers in cascade, both with counts on their transitions:

1. *Words.* The splitting rule of byte-level BPE vocabularies (contractions; an optional space and
   letters, digits or signs; white space) as 8 states over 8 symbols. Each transition says whether a
   word begins. A slice of text is cut in chunks of equal length; every chunk is run from every state
   at once, which gives its state map; the maps compose by a parallel prefix scan, and from the true
   start states the word beginnings follow.
2. *Tokens.* The BPE merges as a transducer over bytes: the state after a prefix of a word is its
   longest suffix that begins some token, with the last token and the count at each place inside that
   suffix. A transition carries the change of the token count. It rests on the fact that a sequence of
   tokens is the BPE encoding of its text if and only if each two neighbours are that of theirs, so
   that the last token of each prefix is determined by the earlier ones. Words of up to SHORT bytes run
   together, a byte of each at a time, with suffixes, tokens and counts in arrays; there are too many
   new ones among them for transitions to be met again. Longer words run one by one, determinised on
   the fly, so that their length costs one look-up a byte where transitions repeat.

Each distinct word of a slice runs through the second transducer once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import narrow

CHUNK = 256
LETTER, DIGIT, SIGN, APOS1, APOS2, LEAD, SPACE, GAP = range(8)
START, IN_LETTERS, IN_DIGITS, IN_SIGNS, IN_SPACE, AFTER_LEAD, ONE_MORE, TWO_MORE = range(8)
#: Words and states kept per worker; beyond, either starts anew (the result is the same).
KNOWN_WORDS, KNOWN_STATES = 300_000, 60_000
#: Bytes of the longest word that runs in arrays, and how many words do so at once.
SHORT, TOGETHER = 64, 1 << 15


def _word_transducer() -> np.ndarray:
    """[symbol, state] -> next state * 2 + 1 if a word begins at this symbol."""
    out = np.zeros((8, 8), np.uint8)
    for state in range(8):
        for symbol, own in ((LETTER, IN_LETTERS), (DIGIT, IN_DIGITS), (SIGN, IN_SIGNS)):
            out[symbol, state] = own * 2 + (state not in (own, AFTER_LEAD))
        for symbol, rest in ((APOS1, ONE_MORE), (APOS2, TWO_MORE)):
            out[symbol, state] = IN_SIGNS * 2 if state in (IN_SIGNS, AFTER_LEAD) else rest * 2 + 1
        out[LEAD, state] = AFTER_LEAD * 2 + 1  # a space before something: it opens the next word
        out[SPACE, state] = START * 2 + 1  # other white space before something: a word of its own
        out[GAP, state] = IN_SPACE * 2 + (state != IN_SPACE)  # white space before white space or the end
    for symbol in range(8):
        out[symbol, TWO_MORE] = ONE_MORE * 2
        out[symbol, ONE_MORE] = START * 2
    return out


WORDS = _word_transducer()


def _char_table() -> np.ndarray:
    """Kind of each code point: LETTER, DIGIT, SIGN, or SPACE."""
    table = np.full(0x110000, SIGN, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):
            for m in regex.finditer(pattern, "".join(map(chr, range(low, high)))):
                table[low + m.start() : low + m.end()] = kind
    return table


_chars: list[np.ndarray] = []


def symbols(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbol of each code point, with what follows folded in; ``ends`` flags the last one of a text."""
    if not _chars:
        _chars.append(_char_table())
    kind = _chars[0][code]
    n = len(code)
    space = kind == SPACE
    before_text = np.zeros(n, bool)
    before_text[:-1] = ~space[1:]
    before_text &= ~ends
    out = np.where(space, np.where(before_text, np.where(code == 32, LEAD, SPACE), GAP), kind).astype(np.uint8)
    at = np.flatnonzero((code == 39) & ~ends)
    if len(at):
        a = code[np.minimum(at + 1, n - 1)]
        b = np.where(ends[np.minimum(at + 1, n - 1)], 0, code[np.minimum(at + 2, n - 1)])
        out[at[np.isin(a, [ord(c) for c in "stmd"])]] = APOS1
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[at[two]] = APOS2
    return out


def beginnings(symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the code points where a word begins; ``first`` flags the first one of each text.

    A chunk's map sends each of the 8 states to the state after the chunk; maps compose by a prefix
    scan over chunks, in log2(chunks) rounds.
    """
    n = len(symbol)
    chunks = -(-n // CHUNK)
    # symbol 8 + s: as s, but from the start state, whatever came before
    table = np.vstack([WORDS, np.repeat(WORDS[:, :1], 8, axis=1)])
    lane = np.full(chunks * CHUNK, GAP, np.uint8)
    lane[:n] = symbol + 8 * first
    lane = np.ascontiguousarray(lane.reshape(chunks, CHUNK).T)
    flat = table.ravel()
    state = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for k in range(CHUNK):
        state = flat[(lane[k].astype(np.uint16) << 3)[:, None] | state] >> 1
    maps, shift = state.astype(np.intp), 1
    while shift < chunks:
        later = np.take_along_axis(maps[shift:], maps[:-shift], axis=1)  # first the earlier map, then the later one
        maps = np.vstack([maps[:shift], later])
        shift *= 2
    now = np.zeros(chunks, np.uint8)
    now[1:] = maps[:-1, START]
    begins = np.zeros((CHUNK, chunks), bool)
    for k in range(CHUNK):
        step = flat[(lane[k].astype(np.uint16) << 3) | now]
        begins[k] = step & 1
        now = step >> 1
    return begins.T.ravel()[:n]


class TokenTransducer:
    """The BPE transducer of a vocabulary, with the states and transitions met so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {token[:k] for token in ranks for k in range(1, len(token) + 1)}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone; counts stay the same."""
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int, int]]] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: dict[int, tuple[int, int]] = {}
        self.number((b"", (b"",), (0,)))

    def number(self, state: tuple) -> int:
        got = self.numbers.get(state)
        if got is None:
            got = self.numbers[state] = len(self.states)
            self.states.append(state)
        return got

    def merges(self, token: bytes) -> list[bytes]:
        """The parts of a token just before its last merge; of other bytes, their encoding."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2 or len(parts) == 2 and token not in self.ranks:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """What stands at the right (side -1) or left (0) edge of a token while it forms: part, rank, and the rank of the merge that ends it."""
        got = self.edges.get((token, side))
        if got is None:
            got, until = [], 1 << 60
            while True:
                rank = self.ranks[token]
                got.append((token, rank if len(token) > 1 else -1, until))
                if len(token) == 1:
                    break
                token, until = self.merges(token)[side], rank
            self.edges[got[0][0], side] = got
        return got

    def stable(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens are the encoding of their joint text: no parts that meet at their border merge first."""
        got = self.pairs.get((left, right))
        if got is None:
            got = True
            for x, born, dies in self.edge(left, -1):
                for y, born2, dies2 in self.edge(right, 0):
                    if born < dies2 and born2 < dies:
                        rank = self.ranks.get(x + y)
                        if rank is not None and rank < dies and rank <= dies2:
                            got = False
            self.pairs[left, right] = got
        return got

    def whole(self, token: bytes) -> bool:
        """Whether a token is the encoding of its own text."""
        return len(token) == 1 or len(self.merges(token)) == 2

    def step(self, number: int, byte: int) -> tuple[int, int]:
        suffix, last, count = self.states[number]  # last and count at each place of the suffix, from its start on
        text = suffix + bytes((byte,))
        size = len(text)
        ranks = self.ranks
        for at in range(size):
            token = text[at:]
            if token in ranks:
                before = last[at]
                # an empty last token is the start of the word
                if self.stable(before, token) if before else self.whole(token):
                    break
        else:
            raise ValueError("the vocabulary lacks a byte")
        change = count[at] + 1
        start = 0
        while start < size and text[start:] not in self.prefixes:
            start += 1
        state = (text[start:], (*last, token)[start:], tuple([c - change for c in (*count, change)[start:]]))
        got = self.next[number << 8 | byte] = (self.number(state), change)
        return got

    def count(self, word: bytes) -> int:
        state = total = 0
        for byte in word:
            state, change = self.next.get(state << 8 | byte) or self.step(state, byte)
            total += change
        return total


class TokenArrays:
    """The same transducer for many words at once: the suffixes as an automaton over all tokens, pairs of tokens judged in arrays."""

    NEVER = 1 << 60

    def __init__(self, transducer: TokenTransducer):
        ranks = transducer.ranks
        parts = {token: transducer.merges(token) for token in ranks}
        tokens = [token for token, made in parts.items() if len(token) == 1 or len(made) == 2]  # others never come about
        ids = {token: k for k, token in enumerate(tokens)}
        self.size = np.array([len(token) for token in tokens], np.int32)
        self.born = np.array([ranks[token] if len(token) > 1 else -1 for token in tokens], np.int64)
        self.head, self.tail = (np.array([ids[parts[token][side]] for token in tokens], np.int64) for side in (0, -1))
        joined = [(ids[a], ids[b], rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := token[:k]) in ids and (b := token[k:]) in ids]
        first, second, rank = np.array(joined, np.int64).reshape(-1, 3).T
        keys = first << 32 | second
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], rank[order]
        self.seen = np.zeros(1 << 22, bool)  # by a hash of the pair: False where no token is made of it
        self.seen[self.slot(first, second)] = True
        self.suffixes(tokens, ids)

    @staticmethod
    def slot(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (first * 0x9E3779B1 + second * 0x85EBCA77) >> 11 & (1 << 22) - 1

    def suffixes(self, tokens: list[bytes], ids: dict[bytes, int]) -> None:
        """The state after each byte (its longest suffix that begins a token), the longest token that ends a state, and the next shorter one."""
        names = sorted({token[:k] for token in tokens for k in range(len(token) + 1)} | {b""}, key=len)
        number = {name: k for k, name in enumerate(names)}
        length = np.array([len(name) for name in names])
        own = np.array([ids.get(name, -1) for name in names], np.int32)
        parent = np.array([number[name[:-1]] for name in names])
        byte = np.array([name[-1] if name else 0 for name in names])
        back = np.zeros(len(names), np.int64)  # the longest proper suffix that is a state
        self.next = np.zeros((len(names), 256), np.int32)
        self.longest = own.copy()
        for size in range(1, length[-1] + 1):
            at = np.arange(*np.searchsorted(length, [size, size + 1]))
            if size > 1:
                back[at] = self.next[back[parent[at]], byte[at]]
            self.next[parent[at], byte[at]] = at
            self.next[at] = self.next[back[at]]
            self.longest[at] = np.where(own[at] < 0, self.longest[back[at]], own[at])
        self.shorter = self.longest[back[np.array([number[token] for token in tokens], np.int64)]]

    def stable(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """TokenTransducer.stable of each pair, from the last merge back to the bytes: at each time the parts at the border must not merge before the next change."""
        good = np.ones(len(first), bool)
        at = np.arange(len(first))
        limit = np.full(len(first), self.NEVER)
        while len(at):
            open_ = np.ones(len(at), bool)
            met = np.flatnonzero(self.seen[self.slot(first, second)])
            if len(met):
                key = first[met] << 32 | second[met]
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                bad = met[(self.keys[found] == key) & (self.ranks[found] < limit[met])]
                good[at[bad]] = False
                open_[bad] = False
            born, born2 = self.born[first], self.born[second]
            open_ &= np.maximum(born, born2) >= 0
            at, first, second, born, born2 = at[open_], first[open_], second[open_], born[open_], born2[open_]
            left = born >= born2  # a merge of the same rank comes first on the left, but both are over before any other
            limit = np.where(left, born, born2 + 1)
            first, second = np.where(left, self.tail[first], first), np.where(born2 >= born, self.head[second], second)
        return good

    def counts(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Tokens of each word raw[s:e]; none is empty."""
        out = np.empty(len(s), np.int64)
        order = np.argsort(s - e, kind="stable")  # the longest first: those not yet at their end are the first ones
        for some in (order[k : k + TOGETHER] for k in range(0, len(s), TOGETHER)):
            begin, size = s[some], (e - s)[some]
            longest = int(size[0])
            last = np.zeros((longest + 1, len(some)), np.int64)
            count = np.zeros((longest + 1, len(some)), np.int64)
            state = np.zeros(len(some), np.int32)
            for place in range(1, longest + 1):
                n = int(np.searchsorted(-size, -place, "right"))
                state = self.next[state[:n], raw[begin[:n] + place - 1]]
                word, token = np.arange(n), self.longest[state]
                while len(word):
                    if token.min() < 0:
                        raise ValueError("the vocabulary lacks a byte")
                    at = place - self.size[token]
                    good = at == 0
                    inner = np.flatnonzero(~good)
                    good[inner] = self.stable(last[at[inner], word[inner]], token[inner].astype(np.int64))
                    done = word[good]
                    last[place, done] = token[good]
                    count[place, done] = count[at[good], done] + 1
                    word, token = word[~good], self.shorter[token[~good]]
            out[some] = count[size, np.arange(len(some))]
        return out


_made: dict[str, tuple[TokenTransducer, TokenArrays, dict[int, int]]] = {}


def load(path: str) -> tuple[TokenTransducer, TokenArrays, dict[int, int]]:
    """The transducer of a vocabulary file (base64 token and rank a line) in both forms and the known words; once a worker."""
    if path not in _made:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        _made.clear()
        transducer = TokenTransducer(ranks)
        _made[path] = (transducer, TokenArrays(transducer), {})
    return _made[path]


def count_slice(transducer: TokenTransducer, arrays: TokenArrays, known: dict[int, int], raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words of each text."""
    n = len(offs) - 1
    if not len(raw):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each code point
    code = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    first, ends = np.zeros(len(code), bool), np.zeros(len(code), bool)
    some = offs[:-1][np.diff(offs) > 0]
    at = np.searchsorted(lead, some)
    first[at] = True
    ends[np.append(at[1:], len(code)) - 1] = True
    s = lead[beginnings(symbols(code, ends), first)]
    e = np.append(s[1:], len(raw))
    h = tv.span_hash(tv.prefix(raw), s, e)
    distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
    if len(known) > KNOWN_WORDS:
        known.clear()
    if len(transducer.states) > KNOWN_STATES:
        transducer.forget()
    have = list(map(known.get, distinct.tolist()))
    new = np.array([k for k, got in enumerate(have) if got is None], np.int64)
    tokens = np.array([got or 0 for got in have], np.int64)
    begin, end = s[where[new]], e[where[new]]
    short = end - begin <= SHORT
    tokens[new[short]] = arrays.counts(raw, begin[short], end[short])
    for k, a, b in zip(new[~short].tolist(), begin[~short].tolist(), end[~short].tolist(), strict=True):
        tokens[k] = transducer.count(raw[a:b].tobytes())
    known.update(zip(distinct[new].tolist(), tokens[new].tolist(), strict=True))
    doc = np.searchsorted(offs, s, "right") - 1
    return np.bincount(doc, weights=tokens[back], minlength=n).astype(np.int64), np.bincount(doc, minlength=n)


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_words, n_bytes of every row; ``vocabulary`` is the path of a ranks file on every node.

    Ids are whole numbers. Null and empty texts have 0 of each, texts of any length are counted whole.
    Repeated rows and null ids are counted like any other. There are no ties: a text has one reading.
    Extra columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, arrays, known = load(vocabulary)
        for batch in batches:
            tokens, words, size = (np.zeros(len(batch), np.int64) for _ in range(3))
            for i, j, raw, offs in tv.slices(batch.column("text")):
                tokens[i:j], words[i:j] = count_slice(transducer, arrays, known, raw, offs)
                size[i:j] = np.diff(offs)
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), *map(pa.array, (tokens, words, size))], ["id", "n_tokens", "n_words", "n_bytes"])

    return narrow(docs, {"id": id_col, "text": text_col}).mapInArrow(run, "id long, n_tokens long, n_words long, n_bytes long").withColumnRenamed("id", id_col)
