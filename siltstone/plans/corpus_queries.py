"""Queries over documents, pages, labels and events, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import findings as V
from ..operators import lines as L
from ..operators import neardup as N
from ..operators.lineage import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")


# == lines and copied blocks ==

_LINES = r"""s AS (SELECT doc_id AS path, regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS a FROM documents),
l AS (SELECT path, unnest(a) AS raw, generate_subscripts(a, 1) AS line FROM s),
n AS (SELECT path, line, regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS norm FROM l),
q AS (SELECT path, line, norm, row_number() OVER (PARTITION BY path ORDER BY line) - 1 AS j FROM n
      WHERE length(norm) >= 5 AND NOT (starts_with(norm, '#') OR starts_with(norm, '//') OR starts_with(norm, '/*') OR starts_with(norm, '*') OR starts_with(norm, '--')))"""
_WINDOWS = _LINES + """,
f AS (SELECT path, j, line AS first, lead(line, 5) OVER o AS last, list(norm) OVER (PARTITION BY path ORDER BY j ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS w FROM q WINDOW o AS (PARTITION BY path ORDER BY j)),
w AS (SELECT path, j, first, last, sha256(array_to_string(w, chr(10))) AS win FROM f WHERE len(w) = 6 AND length(array_to_string(w, '')) >= 120)"""
_PAIRS = _WINDOWS + """,
g AS (SELECT win, list({'path': path, 'j': j, 'first': first, 'last': last} ORDER BY path, j) AS p FROM w GROUP BY win HAVING count(*) BETWEEN 2 AND 8),
e AS (SELECT p[1] AS a, unnest(p[2:]) AS b FROM g),
p AS (SELECT DISTINCT a.path AS pa, a.j AS ja, a.first AS a_first, a.last AS a_last, b.path AS pb, b.j AS jb, b.first AS b_first FROM e WHERE a.path <> b.path OR abs(b.j - a.j) >= 6)"""
_BLOCKS = _PAIRS + """,
i AS (SELECT *, jb - ja AS dg, ja - row_number() OVER (PARTITION BY pa, pb, jb - ja ORDER BY ja) AS island FROM p),
r AS (SELECT *, max(ja) OVER z AS end_ja, max(a_last) OVER z AS end_line FROM i WINDOW z AS (PARTITION BY pa, pb, dg, island)),
h AS (SELECT pa, pb, dg, list_reduce(list([ja] ORDER BY ja), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 24 THEN list_concat(acc, x) ELSE acc END) AS heads FROM r GROUP BY ALL)"""


@query("line_normalize", f"WITH {_LINES} SELECT path, j, line, norm FROM q")
def line_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.normalised(doc_files(spark, sf_dir))


@query("line_windows", f"WITH {_WINDOWS} SELECT path, j, win, first, last FROM w")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.windows(doc_files(spark, sf_dir))


@query("clone_pairs", f"WITH {_PAIRS} SELECT pa, ja, pb, jb FROM p")
def clone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clone_pairs(doc_files(spark, sf_dir)).select("pa", "ja", "pb", "jb")


@query("clone_blocks", f"WITH {_BLOCKS} SELECT r.pa, r.a_first AS a_start, r.end_line AS a_end, r.pb, r.b_first AS b_start, r.end_ja - r.ja + 6 AS n_lines FROM r JOIN h ON r.pa = h.pa AND r.pb = h.pb AND r.dg = h.dg AND list_contains(h.heads, r.ja)")
def clone_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clone_blocks(doc_files(spark, sf_dir))


# == near duplicates ==

_SHINGLES = r"""t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
g AS (SELECT id, w || chr(31) || lead(w, 1) OVER o || chr(31) || lead(w, 2) OVER o || chr(31) || lead(w, 3) OVER o || chr(31) || lead(w, 4) OVER o AS h FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
d AS (SELECT DISTINCT id, h FROM g WHERE h IS NOT NULL),
s AS MATERIALIZED (SELECT id, h FROM d QUALIFY count(*) OVER (PARTITION BY id) >= 40)"""
#: Classes of documents with one set of shingles, their reps' shingles, and all pairs of reps at 0.6 or more.
_CLASSES = _SHINGLES + """,
y AS (SELECT id, count(*) AS n, md5(string_agg(h, chr(30) ORDER BY h)) AS form FROM s GROUP BY id),
y2 AS MATERIALIZED (SELECT id, n, min(id) OVER (PARTITION BY form) AS rep, count(*) OVER (PARTITION BY form) AS copies FROM y),
o AS MATERIALIZED (SELECT s.id, h FROM s SEMI JOIN (SELECT id FROM y2 WHERE id = rep) r USING (id)),
m AS MATERIALIZED (SELECT a.id AS a, b.id AS b, count(*) AS k FROM o a JOIN o b ON a.h = b.h AND a.id < b.id GROUP BY ALL),
v AS MATERIALIZED (SELECT a, b, k / (ua.n + ub.n - k) AS jaccard FROM m JOIN y2 ua ON a = ua.id JOIN y2 ub ON b = ub.id WHERE k / (ua.n + ub.n - k) >= 0.6)"""
_CANDIDATES = _CLASSES + """,
few AS (SELECT h FROM o GROUP BY h HAVING count(*) BETWEEN 2 AND 20),
x AS MATERIALIZED (SELECT id, h FROM o SEMI JOIN few USING (h)),
z AS (SELECT id, count(*) AS n FROM x GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM x a JOIN x b ON a.h = b.h AND a.id < b.id GROUP BY ALL),
k AS (SELECT c.a, c.b, c.common FROM c JOIN z na ON c.a = na.id JOIN z nb ON c.b = nb.id WHERE c.common >= 0.45 * least(na.n, nb.n)
      UNION SELECT v.a, v.b, coalesce(c.common, 0) FROM v LEFT JOIN c ON v.a = c.a AND v.b = c.b)"""
_ROOTS = _CLASSES + """,
e AS MATERIALIZED (SELECT a, b FROM v UNION SELECT b, a FROM v UNION SELECT id, rep FROM y2 WHERE id <> rep UNION SELECT rep, id FROM y2 WHERE id <> rep),
reach(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON reach.id = e.a),
roots AS MATERIALIZED (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


@query("shingle_index", f"WITH {_SHINGLES} SELECT id, count(*) AS n_shingles, count(*) FILTER (h IN (SELECT h FROM s GROUP BY h HAVING count(*) BETWEEN 2 AND 20)) AS n_indexed FROM s GROUP BY id")
def shingle_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shingle is shuffled once, to where it is counted; from there sums go back to the documents."""
    s = N.word_shingles(doc_files(spark, sf_dir)).withColumn("df", F.count("*").over(Window.partitionBy("h")))
    return s.groupBy("id").agg(F.count("*").alias("n_shingles"), F.count_if(F.col("df").between(2, N.MAX_DF)).alias("n_indexed"))


def document_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return N.classes(N.word_sets(doc_files(spark, sf_dir)))


@query("neardup_candidates", f"WITH {_CANDIDATES} SELECT a, b, common FROM k")
def neardup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of class representatives; neardup_classes says whom they stand for."""
    return N.class_candidates(document_classes(spark, sf_dir)[1])


@query("neardup_pairs", f"WITH {_CLASSES} SELECT a, b, round(jaccard, 6) AS jaccard FROM v")
def neardup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of class representatives at 0.6 or more; neardup_classes says whom they stand for."""
    return N.class_pairs(document_classes(spark, sf_dir)[1]).withColumn("jaccard", F.round("jaccard", 6))


@query("neardup_classes", f"WITH {_CLASSES}, l AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM v UNION ALL SELECT b FROM v) GROUP BY id) SELECT y2.id, rep, copies, coalesce(l.n, 0) AS n_links FROM y2 LEFT JOIN l ON l.id = rep")
def neardup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class, the size of the class, and the number of other classes it is linked to."""
    members, own = document_classes(spark, sf_dir)
    pairs = N.class_pairs(own)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("found"))
    return members.join(links, "rep", "left").select("id", "rep", "copies", F.coalesce("found", F.lit(0)).alias("n_links"))


def weighted_pairs(members: DataFrame, own: DataFrame) -> DataFrame:
    """a, b, jaccard, weight: pairs of reps with the number of document pairs they stand for, and each copy with its rep.

    n copies are n * (n - 1) / 2 pairs of Jaccard 1: the n - 1 links to the rep weigh n / 2 each.
    """
    n = members.where("id = rep").select("id", "copies")
    across = N.class_pairs(own).join(n.select(F.col("id").alias("a"), F.col("copies").alias("ca")), "a").join(n.select(F.col("id").alias("b"), F.col("copies").alias("cb")), "b")
    within = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"), (F.col("copies") / 2).alias("weight"))
    return across.select("a", "b", "jaccard", (F.col("ca") * F.col("cb")).cast("double").alias("weight")).unionByName(within)


@query("neardup_families", f"""WITH RECURSIVE {_ROOTS},
f AS (SELECT root, count(*) AS n_members, count(DISTINCT source) AS n_files, list(DISTINCT id::VARCHAR ORDER BY id::VARCHAR)[1:4] AS names FROM roots JOIN documents ON id = doc_id GROUP BY root HAVING count(*) >= 3 AND count(DISTINCT source) >= 3),
wp AS (SELECT a, jaccard, (ua.copies * ub.copies)::DOUBLE AS weight FROM v JOIN y2 ua ON a = ua.id JOIN y2 ub ON b = ub.id UNION ALL SELECT rep, 1.0, copies::DOUBLE / 2 FROM y2 WHERE id <> rep),
j AS (SELECT root, sum(jaccard * weight) / sum(weight) AS mean, min(jaccard) AS least FROM wp JOIN roots ON a = id GROUP BY root)
SELECT root, n_members, n_files, array_to_string(names, ',') AS names, round(mean, 6) AS mean_jaccard, round(least, 6) AS least_jaccard FROM f JOIN j USING (root)""")
def neardup_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over 3 or more sources. Means are over all pairs of documents, copies included."""
    members, own = document_classes(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.col("doc_id").cast("string").alias("name"))
    rows = N.families(weighted_pairs(members, own), docs)
    return rows.select("root", "n_members", "n_files", F.array_join("names", ",").alias("names"), F.round("mean_jaccard", 6).alias("mean_jaccard"), F.round("least_jaccard", 6).alias("least_jaccard"))


_MATCHED = """ds AS (SELECT y2.id, y2.rep, source FROM y2 JOIN documents ON y2.id = doc_id),
g2 AS (SELECT rep, source, count(*) AS n FROM ds GROUP BY ALL),
pr AS (SELECT x.source AS file_a, y.source AS file_b, x.rep AS id_a, y.rep AS id_b, x.n AS n_a, y.n AS n_b, jaccard FROM v JOIN g2 x ON v.a = x.rep JOIN g2 y ON v.b = y.rep WHERE x.source < y.source
       UNION ALL SELECT x.source, y.source, x.rep, y.rep, x.n, y.n, jaccard FROM v JOIN g2 x ON v.b = x.rep JOIN g2 y ON v.a = y.rep WHERE x.source < y.source
       UNION ALL SELECT x.source, y.source, x.rep, y.rep, x.n, y.n, 1.0 FROM g2 x JOIN g2 y ON x.rep = y.rep AND x.source < y.source)"""


def source_pairs(spark: SparkSession, sf_dir: str, members: DataFrame, own: DataFrame) -> DataFrame:
    """file_a < file_b, id_a, id_b, n_a, n_b, jaccard: classes that two sources share or that are alike, with their numbers of documents in each source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    held = cut(members.join(docs, "id").groupBy("rep", "source").agg(F.count("*").alias("n")))
    x, y = (held.select(F.col("rep").alias(f"id_{s}"), F.col("source").alias(f"file_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    near = cut(N.class_pairs(own))
    both = (near.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "jaccard").unionByName(near.select(F.col("b").alias("id_a"), F.col("a").alias("id_b"), "jaccard")))
    same = held.select(F.col("rep").alias("id_a"), F.col("rep").alias("id_b"), F.lit(1.0).alias("jaccard")).distinct()
    return both.unionByName(same).join(x, "id_a").join(y, "id_b").where("file_a < file_b")


@query("fork_aggregate", f"WITH {_CLASSES}, {_MATCHED} SELECT file_a, file_b, sum(n_a * n_b)::BIGINT AS n_pairs, round(sum(jaccard * n_a * n_b) / sum(n_a * n_b), 6) AS mean_jaccard FROM pr GROUP BY ALL HAVING sum(n_a * n_b) >= 2")
def fork_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents between two sources, counted by class and never written out; matched_forks matches them one to one."""
    rows = source_pairs(spark, sf_dir, *document_classes(spark, sf_dir))
    n = F.col("n_a") * F.col("n_b")
    return rows.groupBy("file_a", "file_b").agg(F.sum(n).alias("n_pairs"), F.round(F.sum(F.col("jaccard") * n) / F.sum(n), 6).alias("mean_jaccard")).where("n_pairs >= 2")


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select("file_a", "file_b", "id_a", "id_b", "jaccard", "n_a", "n_b", F.col("id_a").alias("line_a"), F.col("id_b").alias("line_b"), F.lit("").alias("name_a"), F.lit("").alias("name_b"))


@query("matched_forks")
def matched_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forks: families set aside, documents of two sources matched one to one, FORK or more of them.

    Copies are matched by number, as they are interchangeable; ties of Jaccard go to the lesser
    representative. Each pair of sources comes once, the lesser name first.
    """
    members, own = document_classes(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    links = N.class_pairs(own).select("a", "b").unionByName(N.class_links(members))
    roots = cut(N.components(links))
    large = roots.join(docs, "id").groupBy("root").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources")).where("n >= 3 and n_sources >= 3")
    gone = cut(roots.join(large.select("root"), "root", "left_semi").select(F.col("id").alias("id_a")))
    rows = source_pairs(spark, sf_dir, members, own).join(gone, "id_a", "left_anti")
    return N.forks(N.one_to_one(_ordered(rows))).withColumn("mean_jaccard", F.round("mean_jaccard", 6))


@query("greedy_matching")
def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of two sources matched one to one, with the number of documents that found each other."""
    rows = source_pairs(spark, sf_dir, *document_classes(spark, sf_dir))
    return N.one_to_one(_ordered(rows)).select("file_a", "file_b", "id_a", "id_b", F.round("jaccard", 6).alias("jaccard"), "matched")


@query("same_name_neighbors", """WITH r AS (SELECT p_partkey AS id, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM r x JOIN r y ON x.p_brand = y.p_brand AND y.rn > x.rn AND y.rn <= x.rn + CASE WHEN x.n <= 100 THEN 100 ELSE 20 END""")
def same_name_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return N.same_name_pairs(part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("id"), F.col("p_size").alias("n_shingles"), F.col("p_partkey").alias("path"), F.lit(1).alias("line")))


# == findings, from events ==

_RULE_NAMES = ["as-any", "bare-except", "dead-code", "deep-nesting", "duplicate-function", "hand-rolled-contract", "unused-import"]
_RULES_SQL = "[" + ", ".join(f"'{r}'" for r in _RULE_NAMES) + "]"
_DIRS = ["src", "tests", "pkg/examples"]
_FOUND = f"""x AS (SELECT ({_RULES_SQL})[event_id % 7 + 1] AS rule, CASE event_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warn' ELSE 'error' END AS severity,
'/repo/' || (['src', 'tests', 'pkg/examples'])[user_id % 3 + 1] || '/m' || user_id || '.py' AS file, (event_id % 9 + 1)::INT AS line, event_type AS message, event_id FROM events)"""
_ADVISORY = "('as-any', 'unused-import')"


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings spread over rules, severities, files and lines by the keys of the events."""
    e = table(spark, sf_dir, "events")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    return e.select(pick(_RULE_NAMES, F.col("event_id") % 7).alias("rule"), pick(["info", "warn", "error"], F.col("event_id") % 3).alias("severity"), F.concat(F.lit("/repo/"), pick(_DIRS, F.col("user_id") % 3), F.lit("/m"), "user_id", F.lit(".py")).alias("file"), (F.col("event_id") % 9 + 1).cast("int").alias("line"), F.col("event_type").alias("message"), "event_id")


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of those findings: eight lines, the odd ones alike."""
    users = event_findings(spark, sf_dir).select(F.col("file").alias("path")).distinct()
    return users.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("  line "), F.when(i % 2 == 1, "odd").otherwise(i.cast("string")))), "\n"))


_FILE_LINES = "fl AS (SELECT DISTINCT file, i AS line, CASE WHEN i > 8 THEN '' WHEN i % 2 = 1 THEN 'line odd' ELSE 'line ' || i END AS content, CASE WHEN i > 8 THEN i WHEN i % 2 = 1 THEN (i - 1) // 2 ELSE 0 END AS occ FROM x, range(1, 10) r(i))"
_DEMOTED = f"""{_FOUND}, d1 AS (SELECT *, CASE WHEN rule IN {_ADVISORY} THEN 'info' ELSE severity END AS s1 FROM x),
d2 AS (SELECT *, CASE WHEN s1 = 'warn' AND rule IN ('deep-nesting', 'hand-rolled-contract') AND file LIKE '%/tests/%' THEN 'info' ELSE s1 END AS s2 FROM d1),
d3 AS (SELECT *, CASE WHEN rule = 'duplicate-function' AND file LIKE '%/tests/%' THEN 'info' ELSE s2 END AS s3 FROM d2),
d AS (SELECT * EXCLUDE (severity), CASE WHEN s3 <> 'info' AND file LIKE '%/examples/%' AND rule <> 'dead-code' THEN 'info' ELSE s3 END AS severity FROM d3)"""
_PRINTED = f"""{_FOUND}, {_FILE_LINES},
o AS (SELECT x.*, content, occ, row_number() OVER (PARTITION BY rule, x.file, x.line, content ORDER BY x.file, message, severity) - 1 AS sub FROM x JOIN fl USING (file, line)),
fp AS (SELECT rule, severity, file, line, message, left(sha256(rule || '|' || substr(file, 7) || '|' || content || '|' || occ || CASE WHEN sub > 0 THEN '|' || sub ELSE '' END), 16) AS fingerprint FROM o)"""


@query("severity_counts", f"WITH {_FOUND} SELECT severity, count(*) AS n FROM x GROUP BY severity")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.counts(event_findings(spark, sf_dir))


@query("severity_floor", f"WITH {_FOUND} SELECT * FROM x WHERE severity IN ('warn', 'error')")
def severity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.at_or_above(event_findings(spark, sf_dir), "warn")


@query("severity_demotion", f"WITH {_DEMOTED} SELECT event_id, rule, severity, file FROM d")
def severity_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.demote(event_findings(spark, sf_dir)).select("event_id", "rule", "severity", "file")


@query("disabled_rules", f"WITH {_FOUND} SELECT * FROM x WHERE rule NOT IN ('as-any', 'dead-code')")
def disabled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.without_rules(event_findings(spark, sf_dir), ["as-any", "dead-code"])


@query("final_sort_rank", f"WITH {_FOUND} SELECT event_id, dense_rank() OVER (PARTITION BY file ORDER BY line, CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, rule) AS rank FROM x")
def final_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line", V.rank(F.col("severity")).desc(), "rule")
    return event_findings(spark, sf_dir).select("event_id", F.dense_rank().over(w).alias("rank"))


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.fingerprinted(event_findings(spark, sf_dir).drop("event_id"), event_files(spark, sf_dir), "/repo")


@query("fingerprints", f"WITH {_PRINTED} SELECT * FROM fp")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed(spark, sf_dir)


@query("suppression", f"WITH {_FOUND}, u AS (SELECT DISTINCT file, 3 AS line, CASE WHEN file LIKE '%/src/%' THEN NULL ELSE 'dead-code' END AS named FROM x) SELECT x.* FROM x ANTI JOIN u ON x.file = u.file AND x.line IN (u.line, u.line + 1) AND (u.named IS NULL OR u.named = x.rule)")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_findings(spark, sf_dir)
    notes = found.select(F.col("file").alias("path")).distinct().select("path", F.lit(3).alias("line"), F.when(~F.col("path").contains("/src/"), F.array(F.lit("dead-code"))).alias("rules"))
    return V.unsuppressed(found, notes)


@query("baseline_hidden", f"WITH {_PRINTED}, b AS (SELECT fingerprint FROM fp WHERE severity <> 'info' AND line <= 4) SELECT * FROM fp ANTI JOIN b USING (fingerprint)")
def baseline_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = printed(spark, sf_dir)
    return V.without_baseline(now, V.baseline_rows(now.where("line <= 4"), "/repo"))


@query("baseline_update", f"""WITH {_PRINTED}, b AS (SELECT fingerprint, min({{'rule': rule, 'file': substr(file, 7), 'line': line}}) AS e FROM fp WHERE severity <> 'info' GROUP BY fingerprint),
now AS (SELECT DISTINCT fingerprint FROM fp WHERE severity <> 'info' AND line <= 4)
SELECT fingerprint, e.rule AS rule, e.file AS file, e.line AS line FROM b WHERE fingerprint IN (SELECT fingerprint FROM now) OR NOT starts_with(e.file, 'src/')""")
def baseline_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = printed(spark, sf_dir)
    return V.updated_baseline(V.baseline_rows(now, "/repo"), now.where("line <= 4"), ["src"])


@query("report_scope", f"WITH {_FOUND} SELECT * FROM x WHERE file LIKE '/repo/src/%'")
def report_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_findings(spark, sf_dir)
    return V.in_scope(found, found.where(F.col("file").startswith("/repo/src/")).select(F.col("file").alias("path")))


@query("report_lines", f"WITH {_FOUND} SELECT file || ':' || line || ': [' || severity || '] ' || rule || ': ' || message AS value FROM x")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.report_lines(event_findings(spark, sf_dir))


@query("review_sample", f"WITH {_PRINTED}, one AS (SELECT DISTINCT rule, fingerprint FROM fp WHERE severity <> 'info'), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY fingerprint) AS rn FROM one) SELECT rule, fingerprint FROM r WHERE rn <= 5")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bottom_k(printed(spark, sf_dir)).select("rule", "fingerprint")


@query("reviewed_antijoin", f"WITH {_PRINTED} SELECT * FROM fp WHERE fingerprint NOT IN (SELECT fingerprint FROM fp WHERE line % 2 = 0)")
def reviewed_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = printed(spark, sf_dir)
    return V.unreviewed(now, now.where("line % 2 = 0"))


@query("loop_guard", f"""WITH {_FOUND}, s AS (SELECT e.user_id AS session, e.event_id, sha256(x.rule || '|' || x.severity || '|' || x.line) AS digest FROM events e JOIN x ON e.event_id = x.event_id WHERE x.severity <> 'info'),
g AS (SELECT *, lag(digest) OVER (PARTITION BY session ORDER BY event_id) AS before FROM s) SELECT session, event_id, digest FROM g WHERE digest IS DISTINCT FROM before""")
def loop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.guard import first_reports

    found = V.at_or_above(event_findings(spark, sf_dir), "warn")
    rows = found.join(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session")), "event_id")
    return first_reports(rows.select("session", F.col("event_id").alias("seq"), F.sha2(F.concat_ws("|", "rule", "severity", "line"), 256).alias("digest"))).withColumnRenamed("seq", "event_id")


# == verdicts, from labels ==

_VERDICTS = """v AS (SELECT 'f' || doc_id AS fingerprint, (['r0', 'r1', 'r2', 'r3'])[doc_id % 4 + 1] AS rule, CASE WHEN quality = 1 THEN 'TP' ELSE 'FP' END AS label, 'ann' AS who FROM labels
UNION ALL SELECT 'f' || doc_id, (['r0', 'r1', 'r2', 'r3'])[doc_id % 4 + 1], CASE WHEN toxic = 1 THEN 'FP' WHEN doc_id % 5 = 0 THEN 'uncertain' ELSE 'TP' END, 'bob' FROM labels WHERE doc_id % 3 = 0),
c AS (SELECT fingerprint, any_value(rule) AS rule, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE 'disputed' END AS verdict, count(*) AS n FROM v GROUP BY fingerprint)"""


def label_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    base = labels.select(F.concat(F.lit("f"), "doc_id").alias("fingerprint"), F.concat(F.lit("r"), F.col("doc_id") % 4).alias("rule"), "*")
    ann = base.select("fingerprint", "rule", F.when(F.col("quality") == 1, "TP").otherwise("FP").alias("label"), F.lit("ann").alias("who"), F.lit(1).alias("seq"))
    bob = base.where("doc_id % 3 = 0").select("fingerprint", "rule", F.when(F.col("toxic") == 1, "FP").when(F.col("doc_id") % 5 == 0, "uncertain").otherwise("TP").alias("label"), F.lit("bob").alias("who"), F.lit(2).alias("seq"))
    return ann.unionByName(bob)


@query("precision_report", f"""WITH {_VERDICTS} SELECT rule, count(*) FILTER (verdict = 'TP') AS tp, count(*) FILTER (verdict = 'FP') AS fp, count(*) FILTER (verdict = 'uncertain') AS uncertain, count(*) FILTER (verdict = 'disputed') AS disputed,
CASE WHEN count(*) FILTER (verdict IN ('TP', 'FP')) > 0 THEN count(*) FILTER (verdict = 'TP') / count(*) FILTER (verdict IN ('TP', 'FP')) END AS precision FROM c GROUP BY ROLLUP (rule)""")
def precision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.precision_report(label_verdicts(spark, sf_dir))


@query("labeler_agreement", f"WITH {_VERDICTS} SELECT count(*) AS compared, count(*) FILTER (verdict <> 'disputed') AS agreed FROM c WHERE n > 1")
def labeler_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.agreement(label_verdicts(spark, sf_dir))


@query("context_snippet", r"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\n') AS a FROM documents), l AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS line FROM s),
f AS (SELECT doc_id, (doc_id % 3 + 1)::INT AS at FROM labels), m AS (SELECT f.doc_id, f.at, l.line, CASE WHEN l.line = f.at THEN '>' ELSE ' ' END || printf('%4d', l.line) || '| ' || l.raw AS t FROM f JOIN l ON f.doc_id = l.doc_id AND l.line BETWEEN f.at - 6 AND f.at + 6)
SELECT 'd' || doc_id AS fingerprint, md5(string_agg(t, chr(10) ORDER BY line)) AS context_md5 FROM m GROUP BY doc_id""")
def context_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), "doc_id").alias("fingerprint"), F.col("doc_id").alias("file"), (F.col("doc_id") % 3 + 1).cast("int").alias("line"))
    return V.context(found, doc_files(spark, sf_dir)).select("fingerprint", F.md5("context").alias("context_md5"))


# == predicates on paths and texts ==

_PATHS = """p AS (SELECT p_partkey AS id, (['src/', 'tests/', 'build/', 'docs/examples/', 'generated/'])[p_partkey % 5 + 1] || (['mod', 'test_mod', 'mod.test', 'api_schema', 'mod.gen', 'mod.min'])[p_size % 6 + 1] || p_partkey || (['.py', '.ts', '.proto', '.json', '.txt', '.js', '.Yaml'])[p_partkey % 7 + 1] AS path, CASE WHEN p_partkey % 11 = 0 THEN '# DO NOT EDIT' ELSE '# ' || p_name END AS text FROM part)"""


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    path = F.concat(pick(["src/", "tests/", "build/", "docs/examples/", "generated/"], F.col("p_partkey") % 5), pick(["mod", "test_mod", "mod.test", "api_schema", "mod.gen", "mod.min"], F.col("p_size") % 6), "p_partkey", pick([".py", ".ts", ".proto", ".json", ".txt", ".js", ".Yaml"], F.col("p_partkey") % 7))
    return part.select(F.col("p_partkey").alias("id"), path.alias("path"), F.when(F.col("p_partkey") % 11 == 0, "# DO NOT EDIT").otherwise(F.concat(F.lit("# "), "p_name")).alias("text"))


@query("file_filter", f"""WITH {_PATHS} SELECT id, path FROM p WHERE NOT (path LIKE 'build/%' OR path LIKE 'generated/%') AND regexp_matches(lower(path), '\\.(py|ts|js|yaml)$') AND id % 11 <> 0 AND NOT regexp_matches(path, '\\.gen\\.|\\.min\\.js$')""")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_paths(spark, sf_dir).where(T.is_checkable(F.col("path"), F.col("text"))).select("id", "path")


@query("test_file_flag", f"WITH {_PATHS} SELECT id, regexp_matches(path, '/test_|\\.test\\.') OR path LIKE '%/tests/%' AS is_test FROM p")
def test_file_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_paths(spark, sf_dir).select("id", T.is_test_path(F.col("path")).alias("is_test"))


@query("relaxed_flag", f"WITH {_PATHS} SELECT id, path LIKE '%/examples/%' AS relaxed FROM p")
def relaxed_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_paths(spark, sf_dir).select("id", T.is_relaxed_path(F.col("path")).alias("relaxed"))


@query("schema_file_flag", f"WITH {_PATHS} SELECT id, path LIKE '%.proto' OR (regexp_matches(path, '\\.(json|Yaml)$') AND path LIKE '%schema%') AS is_schema FROM p")
def schema_file_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_paths(spark, sf_dir).select("id", T.is_schema_path(F.col("path")).alias("is_schema"))


@query("sibling_context", f"WITH {_PATHS}, t AS (SELECT p.* FROM p JOIN part ON p.id = p_partkey WHERE p_retailprice >= 990), d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '\\.[^.]*$') AS ext FROM t) SELECT p.id, p.path FROM p JOIN d ON regexp_extract(p.path, '^(.*)/[^/]*$', 1) = d.dir AND regexp_extract(p.path, '\\.[^.]*$') = d.ext WHERE p.id NOT IN (SELECT id FROM t)")
def sibling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import siblings

    paths = part_paths(spark, sf_dir)
    dear = table(spark, sf_dir, "part").where("p_retailprice >= 990").select(F.col("p_partkey").alias("id"))
    return siblings(paths, paths.join(dear, "id", "left_semi")).select("id", "path")


# == comment text, from documents and conversations ==


@query("canonical_names", r"WITH n AS (SELECT p_partkey AS id, (['PickID', 'toolName', 'HTTPServer', 'plain', 'already_snake', 'x2Y'])[p_partkey % 6 + 1] || (['', 'Id', 'URLs'])[p_size % 3 + 1] AS name FROM part) SELECT id, lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS canon FROM n")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    name = F.concat(pick(["PickID", "toolName", "HTTPServer", "plain", "already_snake", "x2Y"], F.col("p_partkey") % 6), pick(["", "Id", "URLs"], F.col("p_size") % 3))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.canonical_name(name).alias("canon"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_REDUNDANT = f"""t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS code FROM conversations),
w AS (SELECT conv_id, turn, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x)), lambda x: length(x) > 2 AND NOT list_contains({_STOPS}, x))) AS c,
regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*') AS ids FROM t WHERE code IS NOT NULL),
k AS (SELECT conv_id, turn, c, list_distinct(list_transform(list_concat(ids, flatten(list_transform(ids, lambda x: list_filter(string_split(x, '_'), lambda p: p <> ''))), flatten(list_transform(ids, lambda x: regexp_extract_all(x, '[A-Z]?[a-z0-9]+|[A-Z]+')))), lambda x: lower(x))) AS k FROM w)"""


@query("comment_words", f"WITH {_REDUNDANT} SELECT conv_id, turn, len(c) AS n_content, len(k) AS n_code, len(list_intersect(c, k)) AS n_common FROM k")
def comment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    c, k = T.content_words(F.col("text")), T.code_words(F.col("code"))
    return rows.select("conv_id", "turn", F.size(c).alias("n_content"), F.size(k).alias("n_code"), F.size(F.array_intersect(c, k)).alias("n_common"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations")
    return rows.withColumn("code", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("code is not null")


@query("comment_redundancy", f"WITH {_REDUNDANT} SELECT conv_id, turn, CASE WHEN len(c) < 2 OR len(k) = 0 THEN NULL WHEN len(list_intersect(c, k)) / len(c) >= 0.999 THEN 'full' WHEN len(list_intersect(c, k)) / len(c) >= 0.75 AND len(c) >= 3 THEN 'partial' END AS level FROM k")
def comment_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", T.redundancy(F.col("text"), F.col("code")).alias("level"))


_HEDGES = "[" + ", ".join("'" + h + "'" for h in T.HEDGES) + "]"
_PLANT = f"h AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Well, ' || upper(({_HEDGES})[p_partkey % 23 + 1]) || ' ' ELSE '' END || p_name || CASE p_partkey % 4 WHEN 0 THEN ' -----' WHEN 1 THEN ' ---' WHEN 2 THEN ' = call(x)' ELSE ' => y' END AS c FROM part)"


def _planted_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    phrase = F.element_at(F.array(*map(F.lit, T.HEDGES)), (F.col("p_partkey") % 23 + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, [" -----", " ---", " = call(x)", " => y"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Well, "), F.upper(phrase), F.lit(" "))).otherwise(""), "p_name", tail).alias("c"))


@query("hedging", f"WITH {_PLANT} SELECT id, list_filter({_HEDGES}, lambda p: contains(lower(c), p))[1] AS phrase FROM h")
def hedging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted_comments(spark, sf_dir).select("id", T.hedge(F.col("c")).alias("phrase"))


@query("banner_flag", f"WITH {_PLANT} SELECT id, id % 4 = 0 AS banner FROM h")
def banner_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted_comments(spark, sf_dir).select("id", T.is_banner(F.col("c")).alias("banner"))


@query("codelike_comments", f"WITH {_PLANT} SELECT id, regexp_matches(c, '=>|^[A-Za-z_$][\\w$.]*\\s*(=|\\+=|-=)') AS code_like FROM h")
def codelike_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted_comments(spark, sf_dir).select("id", T.looks_like_code(F.col("c")).alias("code_like"))
