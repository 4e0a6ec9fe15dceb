"""Toxicity by a weighted finite-state pattern grammar.

A clause is a sequence of word classes: insult, threat, target, negation, reported speech, other.
Five small transducers read it side by side, each with its own states; their composition is one
deterministic transducer whose transitions carry weights, and a clause's score is the weight along
its path. An insult at a target weighs more, a negated one or one in reported speech less; a word
outside any pattern weighs nothing. Insults beyond the built-in list are learned as whole words and
stems from labelled rows, with their log odds as weights; so is the document threshold.

Only clauses with an insult or a threat are walked; they are found by word hashes, column by column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import bounded_sample, cut, narrow

MAX_LABELLED = 20_000
SEED = 31
STEMS = (4, 5, 6, 7, 8)
MIN_DOCS = 4
MIN_ODDS = 2.0
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OBJECT = range(8)
#: English, German, French, Spanish. OBJECT holds the pronouns that may stand before the verb they are the object of.
BUILT_IN = {
    INSULT: """idiot idiots idiotic moron morons moronic stupid scum trash loser losers worthless pathetic disgusting clown imbecile vermin filth
        dumm dumme dummkopf trottel vollidiot depp abschaum versager arschloch widerlich wertlos
        imbécile imbéciles connard connards abruti abrutis minable ordure raté stupide débile
        imbécil imbéciles estúpido estúpida estúpidos basura escoria inútil asqueroso asquerosa patético tonto tonta""",
    THREAT: """kill hurt destroy beat strangle stab murder töten umbringen verprügeln erwürgen erstechen vernichten tuer frapper étrangler
        poignarder égorger détruire matar golpear estrangular apuñalar destruir""",
    TARGET: "you your youre yours u he she they them him her these those ihr du sie vous toi tu ils elles usted ustedes tú ellos",
    OBJECT: "dich euch te",
    NEGATION: "not no never isnt arent wasnt dont doesnt without nicht kein keine nie pas jamais aucun nunca jamás sin",
    REPORT: "said says say called calls wrote writes quoted quotes claimed claims reported reports sagte schrieb dit écrit dijo escribió",
}
INSULT_WEIGHT = 3.0


@dataclass(frozen=True)
class Machine:
    """One transducer: next state by (state, class), and the factor its states put on an insult or threat."""

    name: str
    step: dict[tuple[int, int], int]
    factor: tuple[float, ...]

    def next(self, state: int, symbol: int) -> int:
        return self.step.get((state, symbol), self.step.get((state, -1), state))


#: The state says how far back the last negation or target is (0: none near), or whether speech is being reported.
NEGATED = Machine("negation", {(0, NEGATION): 1, (1, -1): 2, (2, -1): 3, (3, -1): 0, (1, NEGATION): 0, (2, NEGATION): 1, (3, NEGATION): 1}, (1.0, 0.25, 0.25, 0.25))
TARGETED = Machine("target", {(k, c): 1 for k in range(4) for c in (TARGET, OBJECT)} | {(1, -1): 2, (2, -1): 3, (3, -1): 0}, (1.0, 1.5, 1.5, 1.5))
REPORTED = Machine("reported speech", {(0, REPORT): 1, (1, QUOTE): 2, (2, QUOTE): 0}, (1.0, 0.6, 0.3))
#: A second insult in a clause weighs more than the first.
INSULTED = Machine("insult", {(0, INSULT): 1, (1, INSULT): 1}, (1.0, 1.25))
#: A threat and whom it is meant for, in either order: "kill you", "dich töten".
THREATENED = Machine("threat", {(0, THREAT): 1, (1, TARGET): 2, (1, OBJECT): 2, (0, OBJECT): 3, (3, THREAT): 2}, (0.0, 0.0, 1.0, 0.0))


@dataclass(frozen=True)
class Grammar:
    """The composition of all machines: one table over joint states."""

    machines: tuple[Machine, ...] = (NEGATED, TARGETED, REPORTED, INSULTED, THREATENED)
    table: list[list[int]] = field(default_factory=list)
    weight: list[list[float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        shape = [len(m.factor) for m in self.machines]
        number = {s: k for k, s in enumerate(product(*map(range, shape)))}
        for state in number:
            row, gain = [], []
            for symbol in range(8):
                after = tuple(m.next(s, symbol) for m, s in zip(self.machines, state, strict=True))
                row.append(number[after])
                context = self.machines[0].factor[state[0]] * self.machines[1].factor[state[1]] * self.machines[2].factor[state[2]]
                threat = self.machines[4]
                done = threat.factor[after[4]] > threat.factor[state[4]]  # "kill ... you": weighs as one strong insult, in its context
                gain.append(context * self.machines[3].factor[state[3]] if symbol == INSULT else 2 * INSULT_WEIGHT * context / self.machines[1].factor[state[1]] if done else 0.0)
            self.table.append(row)
            self.weight.append(gain)

    def score(self, classes: list[int], weights: list[float]) -> float:
        """Weight of a clause; ``weights`` gives each insult's own."""
        state, total = 0, 0.0
        for symbol, own in zip(classes, weights, strict=True):
            total += self.weight[state][symbol] * (own if symbol == INSULT else 1.0)
            state = self.table[state][symbol]
        return total


GRAMMAR = Grammar()


@dataclass(frozen=True)
class Lexicon:
    """Sorted word hashes with class and weight; sorted stem hashes with weights; the document threshold."""

    words: np.ndarray
    kinds: np.ndarray
    weights: np.ndarray
    stems: np.ndarray
    stem_weights: np.ndarray
    threshold: float


def built_in() -> dict[int, tuple[int, float]]:
    return {tv.hash_of(w): (kind, INSULT_WEIGHT if kind == INSULT else 0.0) for kind, words in BUILT_IN.items() for w in words.split()}


def lexicon(learned: dict[int, float], stems: dict[int, float], threshold: float) -> Lexicon:
    known = built_in()
    for h, w in learned.items():
        if h not in known or known[h][0] == INSULT:
            known[h] = (INSULT, max(w, known.get(h, (0, 0.0))[1]))
    order = sorted(known)
    more = sorted(stems)
    return Lexicon(np.array(order, np.uint64), np.array([known[h][0] for h in order]), np.array([known[h][1] for h in order]), np.array(more, np.uint64), np.array([stems[h] for h in more]), threshold)


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature): words (even hashes) and stems (odd ones) longer than they are."""
    h, doc, s, e, sums = tv.word_hashes(raw, offs)
    keys, docs = [h & ~np.uint64(1)], [doc]
    for n in STEMS:
        at = np.flatnonzero(e - s > n)
        keys.append(tv.span_hash(sums, s[at], s[at] + n) | np.uint64(1))
        docs.append(doc[at])
    pair = np.unique(np.rec.fromarrays([np.concatenate(docs), np.concatenate(keys)], names="d,k"))
    return pair.d, pair.k


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``sorted_keys`` and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def quotation(raw: np.ndarray) -> np.ndarray:
    """The bytes that open or close a quotation: straight, curly, low and angular marks."""
    out = raw == 34
    if len(raw) > 2:
        angular = (raw[:-1] == 0xC2) & ((raw[1:] == 0xAB) | (raw[1:] == 0xBB))
        curly = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x80) & (raw[2:] >= 0x9C) & (raw[2:] <= 0x9E)
        out[:-1] |= angular
        out[:-2] |= curly
    return out


def score_texts(lex: Lexicon, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of matched clauses of each text."""
    score, clauses = np.zeros(len(column)), np.zeros(len(column), np.int64)
    for i, _, raw, offs in tv.slices(column):
        h, doc, s, e, sums = tv.word_hashes(raw, offs)
        if not len(h):
            continue
        at, known = _find(lex.words, h)
        kind = np.where(known, lex.kinds[at], OTHER)
        weight = np.where(known, lex.weights[at], 0.0)
        if len(lex.stems):
            for n in STEMS:
                long = np.flatnonzero((e - s > n) & ((kind == OTHER) | (kind == INSULT)))
                at, is_stem = _find(lex.stems, tv.span_hash(sums, s[long], s[long] + n) | np.uint64(1))
                own = long[is_stem]
                weight[own] = np.maximum(weight[own], lex.stem_weights[at[is_stem]])
                kind[own] = INSULT
        toxic = np.flatnonzero((kind == INSULT) | (kind == THREAT))
        if not len(toxic):
            continue
        # clause number of each word: ends of clauses that lie between it and the word before
        stop = np.isin(raw, np.frombuffer(b".!?;:\n", np.uint8))
        # a sign between two words without a space ends nothing ("3.5", "and/or:")
        stop[:-1] &= (raw[:-1] == 10) | (tv.BYTE_CLASS[raw[1:]] != tv.WORD)
        number = np.cumsum(stop)
        new = np.ones(len(s), bool)
        new[1:] = (number[s[1:]] > number[e[:-1] - 1]) | (doc[1:] != doc[:-1])
        clause = np.cumsum(new) - 1
        first = np.append(np.flatnonzero(new), len(s))
        quotes = np.cumsum(quotation(raw))
        for c in np.unique(clause[toxic]).tolist():
            a, b = first[c], first[c + 1]
            symbols, weights = [], []
            for w in range(a, b):
                if w > a and (quotes[s[w]] - quotes[e[w - 1] - 1]) % 2:
                    symbols.append(QUOTE)
                    weights.append(0.0)
                symbols.append(int(kind[w]))
                weights.append(float(weight[w]))
            got = GRAMMAR.score(symbols, weights)
            if got > 0:
                score[i + doc[a]] += got
                clauses[i + doc[a]] += 1
    return np.round(score, 4), clauses


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_labelled: int) -> Lexicon:
    """The lexicon and the threshold, from at most ``max_labelled`` labelled rows whose label is known.

    A feature counts if MIN_DOCS toxic documents have it and its log odds are MIN_ODDS or more. Of the
    thresholds, the one with the best F1 on the same rows is taken, midway to the next lower score.
    Without labels the built-in list and one targeted insult remain.
    """
    known = narrow(labels, {"id": id_col, "label": label_col}).where("label is not null")
    sample = cut(bounded_sample(known, max_labelled, SEED, "id"))
    rows = cut(narrow(docs, {"id": id_col, "text": text_col}).join(F.broadcast(sample), "id").select("text", (F.col("label") == 1).alias("toxic")))
    n_toxic, n_clean = (r or 0 for r in rows.agg(F.sum(F.col("toxic").cast("long")), F.sum((~F.col("toxic")).cast("long"))).first())
    if not n_toxic or not n_clean:
        return lexicon({}, {}, INSULT_WEIGHT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column("toxic")).astype(bool)
            for i, j, raw, offs in tv.slices(batch.column("text")):
                doc, key = features(raw, offs)
                keys, back = np.unique(key, return_inverse=True)
                bad = np.bincount(back, weights=toxic[i:j][doc], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bad), pa.array(np.bincount(back, minlength=len(keys)) - bad)], ["key", "bad", "good"])

    odds = F.log((F.col("bad") + 0.5) / (n_toxic + 1)) - F.log((F.col("good") + 0.5) / (n_clean + 1))
    found = rows.mapInArrow(count, "key long, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= max(MIN_DOCS, n_toxic // 200)).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS).orderBy("key").toArrow()
    keys, values = np.asarray(found.column("key")).view(np.uint64), np.asarray(found.column("odds"))
    stems = {int(k): float(v) for k, v in zip(keys, values, strict=True) if int(k) & 1}
    words = {int(k): float(v) for k, v in zip(keys, values, strict=True) if not int(k) & 1}
    # word hashes lose their last bit when learned; both forms are listed
    lex = lexicon({k | b: v for k, v in words.items() for b in (0, 1)}, stems, 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(score_texts(lex, batch.column("text"))[0]), batch.column("toxic")], ["score", "toxic"])

    scored = rows.mapInArrow(score, "score double, toxic boolean").groupBy("score").agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count("*").alias("n")).orderBy(F.desc("score")).toArrow()
    value, bad, n = (np.asarray(scored.column(c)).astype(np.float64) for c in ("score", "bad", "n"))
    hit, taken = np.cumsum(bad), np.cumsum(n)
    best = int(np.argmax(np.where(value > 0, 2 * hit / (taken + n_toxic), 0)))
    lower = value[best + 1] if best + 1 < len(value) else 0.0
    return lexicon({k | b: v for k, v in words.items() for b in (0, 1)}, stems, float(max((value[best] + lower) / 2, 1e-6)))


def scores(docs: DataFrame, lex: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, n_clauses of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, clauses = score_texts(lex, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(score), pa.array(clauses)], ["id", "score", "n_clauses"])

    return narrow(docs, {"id": id_col, "text": text_col}).mapInArrow(run, "id long, score double, n_clauses long").withColumnRenamed("id", id_col)


def toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The toxic rows: id, score, n_clauses.

    Ids are whole numbers. Null and empty texts score 0 and are never toxic; texts of any length are
    read whole; repeated rows are each judged alike, and a text that scores just the threshold is
    toxic; a null id stays null. Extra columns are not read. An empty table gives no rows.
    """
    lex = learn(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_labelled=max_labelled)
    return scores(docs, lex, id_col=id_col, text_col=text_col).where(F.col("score") >= lex.threshold)
