"""From files to findings: parse once, apply every rule, then policy, suppression, order and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clones, contracts, rules
from ..operators import findings as V
from ..operators.lineage import cut
from ..operators.rules import Settings
from ..sources.pyfacts import parsed
from ..sources.schemas import messages
from ..sources.scripts import scripts


def raw_findings(files: DataFrame, settings: Settings | None = None, *, report: DataFrame | None = None, schemas: DataFrame | None = None, functions: bool = True) -> tuple[DataFrame, DataFrame]:
    """Findings before any policy, and the suppressions (path, line, rules).

    ``report`` (path) limits what is reported; the other files still serve as context for copies.
    ``schemas`` (path, text) are schema files. Without ``functions`` the passes over functions are left out.
    """
    s = settings or Settings()
    files = files.select("path", "text").where("path is not null")
    py, other = cut(parsed(files)), cut(scripts(files))
    own = report.select("path").distinct() if report is not None else None
    mine = lambda facts: facts if own is None else facts.join(own, "path", "left_semi")
    out = rules.reported(mine(py), rules.python_rules(s)).unionByName(rules.reported(mine(other), rules.script_rules(s)))
    if schemas is not None:
        out = out.unionByName(contracts.contract_findings(mine(py), F.broadcast(cut(messages(schemas)))))
    out = out.unionByName(clones.block_findings(files))
    if functions:
        out = out.unionByName(clones.same_shape(py, own)).unionByName(clones.near_findings(py, own))
    if own is not None:
        out = out.join(own.select(F.col("path").alias("file")), "file", "left_semi")
    hushed = py.select("path", F.explode("ignores").alias("i")).unionByName(other.select("path", F.explode("ignores").alias("i")))
    return out.select("rule", "severity", "file", "line", "message"), hushed.select("path", "i.line", "i.rules")


def analyze(files: DataFrame, settings: Settings | None = None, *, report: DataFrame | None = None, schemas: DataFrame | None = None, functions: bool = True, root: str = "", baseline: DataFrame | None = None) -> DataFrame:
    """Findings (rule, severity, file, line, message, fingerprint) of (path, text), in their final order.

    Null paths are left out, a null text is an empty file, of rows that repeat a path each is a file of
    its own. ``baseline`` (fingerprint) hides what it holds.
    """
    s = settings or Settings()
    found, hushed = raw_findings(files, s, report=report, schemas=schemas, functions=functions)
    rows = V.without_rules(V.demote(found, strict=s.strict, relaxed=list(s.relaxed)), list(s.disable))
    rows = V.fingerprinted(V.unsuppressed(rows, hushed), files, root)
    return V.ordered(rows if baseline is None else V.without_baseline(rows, baseline))
