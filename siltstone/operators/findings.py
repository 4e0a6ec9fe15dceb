"""The pipeline after the rules: policy, suppression, identity, baseline, reports, exit status.

A finding is (rule, severity, file, line, message, fingerprint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.catalog import RANK, rule_dimension
from .lines import lines


def rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, k in RANK.items():
        out = F.when(severity == name, k).otherwise(out)
    return out


def at_or_above(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(rank(F.col("severity")) >= RANK[severity])


def demote(findings: DataFrame, *, strict: bool = False, relaxed: list[str] | None = None) -> DataFrame:
    """Severity policy: advisory rules, rules relaxed in tests, copies in tests, relaxed paths, in this order."""
    rules = F.broadcast(rule_dimension(findings.sparkSession).drop("about"))
    s = F.col("severity")
    test = T.is_test_path(F.col("file"))
    rows = findings.join(rules, "rule", "left")
    if not strict:
        rows = rows.withColumn("severity", F.when(F.coalesce("advisory", F.lit(False)), "info").otherwise(s))
    rows = rows.withColumn("severity", F.when((s == "warn") & F.coalesce("test_relaxed", F.lit(False)) & test, "info").otherwise(s))
    rows = rows.withColumn("severity", F.when((F.col("rule") == "duplicate-function") & test, "info").otherwise(s))
    loose = T.is_relaxed_path(F.col("file"), relaxed)
    rows = rows.withColumn("severity", F.when(s.isin("warn", "error") & loose & ~F.coalesce("path_blocking", F.lit(False)), "info").otherwise(s))
    return rows.select(*findings.columns)


def without_rules(findings: DataFrame, disabled: list[str]) -> DataFrame:
    return findings.where(~F.col("rule").isin(*disabled)) if disabled else findings


def in_scope(findings: DataFrame, report_files: DataFrame) -> DataFrame:
    return findings.join(report_files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")


def unsuppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Without findings on or under a suppressed line; ``rules`` null suppresses all.

    One equi-join: each suppression covers its own line and the next.
    """
    cover = suppressions.select(F.col("path").alias("file"), F.explode(F.array("line", F.col("line") + 1)).alias("line"), F.coalesce("rules", F.array(F.lit("*"))).alias("rules"))
    cover = cover.select("file", "line", F.explode("rules").alias("named"))
    return findings.join(cover, (findings["file"] == cover["file"]) & (findings["line"] == cover["line"]) & ((cover["named"] == "*") | (cover["named"] == findings["rule"])), "left_anti")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "line", rank(F.col("severity")).desc(), "rule")


def fingerprinted(findings: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """Adds the identity: rule, relative path, stripped line, its occurrence in the file, place among equals.

    Occurrences are counted over all lines of the flagged files, so that hiding one finding never
    shifts another's identity. A line out of range is '' with the line number as occurrence.
    """
    own = files.join(findings.select(F.col("file").alias("path")).distinct(), "path", "left_semi")
    seen = Window.partitionBy("path", "stripped").orderBy("line")
    content = lines(own).select(F.col("path").alias("file"), "line", F.col("stripped").alias("_content"), (F.row_number().over(seen) - 1).alias("_occ"))
    rel = F.when(F.lit(root) == "", F.col("file")).when(F.col("file").startswith(root.rstrip("/") + "/"), F.substring("file", len(root.rstrip("/")) + 2, 1 << 20)).otherwise(F.col("file"))
    rows = findings.drop("fingerprint").join(content, ["file", "line"], "left").withColumn("_rel", rel).withColumn("_content", F.coalesce("_content", F.lit(""))).withColumn("_occ", F.coalesce("_occ", "line"))
    same = Window.partitionBy("rule", "_rel", "line", "_content").orderBy("file", "message", "severity")
    rows = rows.withColumn("_sub", F.row_number().over(same) - 1)
    raw = F.concat_ws("|", "rule", "_rel", "_content", F.col("_occ").cast("string"), F.when(F.col("_sub") > 0, F.col("_sub").cast("string")))
    return rows.withColumn("fingerprint", F.left(F.sha2(raw, 256), F.lit(16))).select("rule", "severity", "file", "line", "message", "fingerprint")


def hidden_count(findings: DataFrame, baseline: DataFrame) -> int:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_semi").count()


def without_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti").select(*findings.columns)


def baseline_rows(findings: DataFrame, root: str = "") -> DataFrame:
    """What a new baseline holds: warn and above, one row a fingerprint."""
    rel = F.when((F.lit(root) != "") & F.col("file").startswith(root.rstrip("/") + "/"), F.substring("file", len(root.rstrip("/")) + 2, 1 << 20)).otherwise(F.col("file"))
    return at_or_above(findings, "warn").groupBy("fingerprint").agg(F.min(F.struct("rule", rel.alias("file"), "line")).alias("e")).select("fingerprint", "e.*")


def under(path: Column, scopes: list[str]) -> Column:
    found = F.lit(False)
    for s in scopes:
        s = s.rstrip("/")
        found = found | (path == s) | path.startswith(s + "/") if s not in ("", ".") else F.lit(True)
    return found


def updated_baseline(stored: DataFrame, findings: DataFrame, scopes: list[str]) -> DataFrame:
    """Stored entries that still occur, plus those outside the scanned paths; nothing new enters."""
    now = at_or_above(findings, "warn").select("fingerprint").distinct()
    kept = stored.join(now, "fingerprint", "left_semi")
    return kept.unionByName(stored.where(~under(F.col("file"), scopes))).dropDuplicates(["fingerprint"])


def counts(findings: DataFrame) -> DataFrame:
    """severity, n: all three severities, zero-filled."""
    dimension = findings.sparkSession.createDataFrame([(s,) for s in RANK], "severity string")
    return F.broadcast(dimension).join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def report_lines(findings: DataFrame) -> DataFrame:
    return ordered(findings).select(F.format_string("%s:%d: [%s] %s: %s", "file", "line", "severity", "rule", "message").alias("value"))


def json_lines(findings: DataFrame) -> DataFrame:
    return ordered(findings).select(F.to_json(F.struct("rule", "severity", "file", "line", "message", "fingerprint")).alias("value"))


def json_report(findings: DataFrame) -> str:
    """All findings as one JSON list, in their order; for people, so it comes to the driver."""
    return "[" + ",\n ".join(r["value"] for r in json_lines(findings).toLocalIterator()) + "]"


def footer(findings: DataFrame, hidden: int = 0) -> list[str]:
    """The last lines of a report: how many findings of each severity, and how many the baseline hides."""
    n = {r["severity"]: r["n"] for r in counts(findings).collect()}
    line = f"{sum(n.values())} finding(s): " + ", ".join(f"{n[s]} {s}" for s in sorted(n, key=RANK.get, reverse=True))
    return [line, *([f"({hidden} more in the baseline)"] if hidden else [])]


def verdict(findings: DataFrame, fail_on: str = "warn", shown: int = 30) -> tuple[int, list[str]]:
    """2 and what an edit is told when a finding blocks it, else 0 and nothing. The first ``shown`` are printed, the rest counted."""
    if fail_on == "never":
        return 0, []
    blocking = at_or_above(findings, fail_on if fail_on in RANK else "warn")
    n = blocking.count()
    lines = [r["value"] for r in report_lines(blocking).limit(shown).collect()] if n else []
    return (2, [f"{n} finding(s) block this edit", *lines, *([f"... and {n - shown} more"] if n > shown else [])]) if n else (0, [])


def exit_status(findings: DataFrame, fail_on: str | None = None, configured: str | None = None) -> int:
    """1 if a finding reaches the level asked for, else the configured one, else warn."""
    asked = fail_on or configured or "warn"
    level = asked if asked in ("warn", "error", "never") else "warn"
    return 0 if level == "never" else int(bool(at_or_above(findings, level).limit(1).count()))


def bottom_k(findings: DataFrame, k: int = 5) -> DataFrame:
    """A uniform sample: of each rule the k least fingerprints, info left out."""
    w = Window.partitionBy("rule").orderBy("fingerprint")
    rows = findings.where("severity <> 'info'").dropDuplicates(["fingerprint"])
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def unreviewed(findings: DataFrame, *known: DataFrame) -> DataFrame:
    for k in known:
        findings = findings.join(k.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return findings


def context(findings: DataFrame, files: DataFrame, around: int = 6) -> DataFrame:
    """Adds the lines around each finding, numbered, its own marked.

    Each finding asks for its own line numbers: an equi-join on (file, line), no range join.
    """
    asked = findings.select("fingerprint", "file", F.col("line").alias("at"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - around), F.col("line") + around)).alias("line"))
    got = asked.join(lines(files).select(F.col("path").alias("file"), "line", "raw"), ["file", "line"])
    row = F.format_string("%s%4d| %s", F.when(F.col("line") == F.col("at"), ">").otherwise(" "), "line", "raw")
    text = got.groupBy("fingerprint").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", row.alias("t")))), lambda s: s["t"]), "\n").alias("context"))
    return findings.join(text, "fingerprint", "left").withColumn("context", F.coalesce("context", F.lit("")))


def consensus(verdicts: DataFrame) -> DataFrame:
    """fingerprint, rule, verdict: the label all agree on, else disputed. The last vote of each (fingerprint, who) counts.

    ``verdicts``: fingerprint, rule, label, who, seq (order of the votes).
    """
    last = verdicts.groupBy("fingerprint", F.coalesce("who", F.lit("?")).alias("who")).agg(F.max_by("label", "seq").alias("label"), F.max_by("rule", "seq").alias("rule"), F.max("seq").alias("seq"))
    return last.groupBy("fingerprint").agg(F.max_by("rule", "seq").alias("rule"), F.when(F.count_distinct("label") == 1, F.min("label")).otherwise("disputed").alias("verdict"), F.count("*").alias("n_votes"))


def precision_report(verdicts: DataFrame) -> DataFrame:
    """rule (null: all), tp, fp, uncertain, disputed, precision: one rollup."""
    one = lambda v: F.count_if(F.col("verdict") == v)
    rows = consensus(verdicts).rollup("rule").agg(one("TP").alias("tp"), one("FP").alias("fp"), one("uncertain").alias("uncertain"), one("disputed").alias("disputed"))
    return rows.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))))


def agreement(verdicts: DataFrame) -> DataFrame:
    """compared, agreed: fingerprints with several votes, and those without a dispute."""
    rows = consensus(verdicts).where("n_votes > 1")
    return rows.agg(F.count("*").alias("compared"), F.count_if(F.col("verdict") != "disputed").alias("agreed"))
