"""Secret scans with corpus-wide ownership frequency.

Candidates are found by patterns, hashed, and counted over the whole corpus by distinct documents,
repositories and owners. A value that many owners carry is a copied example; one that stays with its
owner and has the entropy of a real key looks live. Values themselves never leave the workers.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

PATTERNS = {
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "repo_token": r"\bgh[pousr]_[0-9A-Za-z]{36,}\b",
    "chat_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "payment_key": r"\b[sr]k_live_[0-9A-Za-z]{16,}\b",
    "signed_token": r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "maps_key": r"\bAIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])",
    "forge_token": r"\bglpat-[0-9A-Za-z_-]{20,}",
    "hook_url": r"\bhttps://hooks\.[a-z.]+/services/[0-9A-Za-z]+/[0-9A-Za-z]+/[0-9A-Za-z]{12,}",
    # a password within an address: scheme://name:password@host
    "url_password": r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"']*:(?P<within>[^\s:/@\"'<{$]{6,})@[A-Za-z0-9.-]+",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    # any prefix may stand before the keyword: DB_PASSWORD, client_secret, dbPassword
    "assigned": r"(?i:api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|auth[_-]?token|secret|token|passwd|password)[\"']?(?:\s*(?::=|=>|[:=])\s*(?:\"(?P<double>[^\s\"]{12,})\"|'(?P<single>[^\s']{12,})')|[ \t]*(?::=|=>|[:=])[ \t]*(?P<free>[^\s\"'`]{12,}))",
}
ONE = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()))
OWN_FORM = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items() if kind not in ("assigned", "private_key", "url_password")))
LEAST = 12
#: Unquoted, these are names, calls and references of code, or addresses, unless the line is an assignment of a shell or .env file.
CODE = re.compile(r"[A-Za-z_][A-Za-z_.-]*|[A-Za-z_][\w.]*[(\[].*|\d+(?:\.\d+)*", re.DOTALL)
REFERENCE = re.compile(r"\$[A-Z_][A-Z0-9_]*|\$[{(].*|\{\{.*|\{%.*|<.*|\[.*|[A-Za-z][A-Za-z0-9+.-]*://.*", re.DOTALL)
ENV_LINE = re.compile(r"\s*(?:export\s+|set\s+)?[\w.-]*", re.IGNORECASE)
QUERY_PART = re.compile(r"[?&][\w.-]*$")
#: What any candidate contains; one linear scan of a whole column discards the texts without it.
HINT = r"(?i)://[^\s:/@]*:[^\s/@]+@|hooks\.|aiza|glpat-|akia|asia|gh[pousr]_|xox[abprs]-|_live_|eyj|-----begin|key[\"']?\s*[:=]|token[\"']?\s*[:=]|secret[\"']?\s*[:=]|passw(?:or)?d[\"']?\s*[:=]"
WIDELY = 3
MIN_ENTROPY = 2.5
PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|(.)\1{7}|0123456789|1234567890|abcdef(?:gh)?ij")


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def free_end(text: str, name: int, a: int, b: int) -> int:
    """The end of the unquoted value text[a:b] of the keyword at ``name``, 0 if it is none."""
    line = text.rfind("\n", 0, name) + 1
    if QUERY_PART.search(text, line, name):
        b = min([b, *(k for k in (text.find(c, a, b) for c in "&#") if k > 0)])
    env = ENV_LINE.fullmatch(text, line, name) and text[a - 1] == "=" and text[b : b + 1] in ("", "\n", "\r")
    if not env:
        b = a + len(text[a:b].rstrip(".,;:)]}"))
    value = text[a:b]
    if b - a < LEAST or REFERENCE.fullmatch(value) or (not env and CODE.fullmatch(value)):
        return 0
    return b


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of each candidate, left to right, without overlaps."""
    out: list[tuple[str, int, int, str]] = []
    at = 0
    while m := ONE.search(text, at):
        at = m.end()
        kind = next(k for k in PATTERNS if m[k] is not None)
        a, b = m.span("within" if kind == "url_password" else kind)
        if kind == "assigned":
            where = next(g for g in ("double", "single", "free") if m.group(g) is not None)
            a, b = m.span(where)
            inner = OWN_FORM.search(text, a, b)
            if inner:  # a key of a form of its own counts as that, whatever stands around it
                kind, (a, b) = inner.lastgroup, inner.span()
            elif where == "free":
                b = free_end(text, m.start(), a, b)
                if not b:
                    at = a  # what is no value may hold one: login(password="...")
                    continue
            at = b
        if kind == "private_key":  # the body counts, up to the closing line
            end = text.find("-----END", b)
            b = end if end > 0 else b
        out.append((kind, a, b, text[a:b]))
    return out


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """id, owner, repo, kind, start, end, secret (SHA-256 of the value), entropy, placeholder of each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            at = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(texts, HINT), False)))
            rows = []
            for i in at.tolist():
                for kind, a, b, value in scan(texts[i].as_py()):
                    rows.append((i, kind, a, b, hashlib.sha256(value.encode()).hexdigest(), round(entropy(value), 4), bool(PLACEHOLDER.search(value))))
            if rows:
                where, *rest = zip(*rows, strict=True)
                part = batch.take(pa.array(where))
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), part.column("owner"), part.column("repo"), *[pa.array(c) for c in rest]], ["id", "owner", "repo", "kind", "start", "end", "secret", "entropy", "placeholder"])

    owner = F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit(""))
    repo = F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in repo_cols])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), owner.alias("owner"), repo.alias("repo"))
    return rows.mapInArrow(run, "id long, owner string, repo string, kind string, start long, end long, secret string, entropy double, placeholder boolean")


def ownership(found: DataFrame, *, widely: int = WIDELY) -> DataFrame:
    """One row a secret: kind, n_docs, n_repos, n_owners, verdict.

    ``example``: at least ``widely`` owners have it, or it reads like a placeholder; ``weak``: too
    little entropy for a key; ``live``: the rest.
    """
    verdict = F.when((F.col("n_owners") >= widely) | F.col("placeholder"), "example").when((F.col("entropy") < MIN_ENTROPY) & (F.col("kind") == "assigned"), "weak").otherwise("live")
    counts = found.groupBy("secret").agg(F.min("kind").alias("kind"), F.count_distinct(F.coalesce("id", F.lit(-1))).alias("n_docs"), F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"), F.max("entropy").alias("entropy"), F.max("placeholder").alias("placeholder"))
    return counts.withColumn("verdict", verdict).drop("placeholder", "entropy")


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), widely: int = WIDELY) -> DataFrame:
    """id, start, end, kind, secret, n_docs, n_repos, n_owners, verdict of each occurrence.

    Where the corpus has no column for them, the source stands for the owner, and source and language
    for the repository. Ids are whole numbers. Null and empty texts have none, texts of any length are
    scanned whole. A null owner is the owner "", a null id one document. Repeated rows give their
    occurrences each but count once in n_docs. A secret of several kinds is of the kind that sorts
    first. Extra columns are not read. An empty table gives no rows.
    """
    found = cut(candidates(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_cols=repo_cols))
    known = ownership(found, widely=widely).drop("kind")
    return found.select(F.col("id").alias(id_col), "start", "end", "kind", "secret").join(known, "secret")
