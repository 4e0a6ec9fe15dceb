"""Dict literals against message schemas: the best message of each, and the keys that stray from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MIN_KEYS, OVERLAP, COMPOUND = 4, 0.75, 2


def dict_keys(facts: DataFrame) -> DataFrame:
    """path, dict_no, line, keys (key, canon, key_line) of dicts with MIN_KEYS distinct keys; of keys with one canonical form the first counts."""
    rows = facts.select("path", F.posexplode("dicts").alias("dict_no", "d")).where(F.col("d.n") >= MIN_KEYS)
    keys = F.transform("d.keys", lambda k: F.struct(k["key"].alias("key"), T.canonical_name(k["key"]).alias("canon"), k["line"].alias("key_line")))
    rows = rows.select("path", "dict_no", F.col("d.line").alias("line"), keys.alias("all"))
    first = F.filter("all", lambda k, i: ~F.exists(F.slice("all", F.lit(1), i), lambda b: b["canon"] == k["canon"]))
    return rows.select("path", "dict_no", "line", first.alias("keys")).where(F.size("keys") >= MIN_KEYS)


def best_messages(keys: DataFrame, messages: DataFrame) -> DataFrame:
    """path, dict_no, msg_no: the message that most keys of the dict belong to, the first of equal ones.

    One equi-join on the canonical name; dicts that share nothing with any message drop out.
    """
    one = keys.select("path", "dict_no", F.explode(F.transform("keys", lambda k: k["canon"])).alias("canon"))
    fields = messages.select("msg_no", F.explode("canon").alias("canon"))
    n = one.join(fields, "canon").groupBy("path", "dict_no", "msg_no").agg(F.count("*").alias("n"))
    return n.groupBy("path", "dict_no").agg(F.max(F.struct("n", (-F.col("msg_no")).alias("first"))).alias("m")).select("path", "dict_no", (-F.col("m.first")).alias("msg_no"))


def contract_findings(facts: DataFrame, messages: DataFrame) -> DataFrame:
    """hand-rolled-contract, contract-drift-key and contract-case-skew, as findings."""
    keys = dict_keys(facts)
    rows = keys.join(best_messages(keys, messages), ["path", "dict_no"]).join(messages, "msg_no")
    inside = F.filter("keys", lambda k: F.array_contains("canon", k["canon"]))
    compound = F.size(F.filter(inside, lambda k: F.contains(F.regexp_replace(k["canon"], "^_+|_+$", ""), F.lit("_"))))
    rows = rows.where((F.size(inside) >= OVERLAP * F.size("keys")) & (compound >= COMPOUND))
    sample = F.array_join(F.slice(F.sort_array(F.transform(inside, lambda k: k["key"])), 1, 3), ", ")

    def found(rule: str, severity: str, line: F.Column, *message: F.Column | str) -> F.Column:
        parts = [F.lit(m) if isinstance(m, str) else m for m in message]
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), line.alias("line"), F.concat(*parts).alias("message"))

    label = F.col("label")
    stem = lambda k: T.canonical_name(F.regexp_extract(k["key"], "^[a-z0-9]+", 0))
    stray = F.filter("keys", lambda k: ~F.array_contains("canon", k["canon"]) & k["key"].rlike("^[a-z][a-z0-9]*(?:[A-Z][A-Za-z0-9]*)+$") & ~F.array_contains("canon", stem(k)))
    spelled = lambda k: F.element_at(F.filter("fields", lambda f: T.canonical_name(f) == k["canon"]), 1)
    skewed = F.filter("keys", lambda k: F.array_contains("canon", k["canon"]) & ~F.array_contains("fields", k["key"]))
    every = F.concat(
        F.array(found("hand-rolled-contract", "warn", F.col("line"), "spells out ", label, " by hand: ", sample)),
        F.transform(stray, lambda k: found("contract-drift-key", "warn", k["key_line"], "no field of ", label, " is called ", k["key"])),
        F.transform(skewed, lambda k: found("contract-case-skew", "info", k["key_line"], label, " spells ", k["key"], " as ", spelled(k))),
    )
    return rows.select(F.col("path").alias("file"), F.explode(every).alias("f")).select("f.rule", "f.severity", "file", "f.line", "f.message")
