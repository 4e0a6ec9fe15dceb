"""The source rules, the scan and its sources over small files."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import clones, lines, rules
from siltstone.operators import neardup as N
from siltstone.operators.lineage import cut
from siltstone.plans import planted
from siltstone.plans.catalog import RULES
from siltstone.plans.planted import QUERIES, SQL
from siltstone.plans.scan import analyze, raw_findings
from siltstone.sources import files as S
from siltstone.sources import pyfacts, schemas, scripts
from siltstone.streaming import guard


def frame(spark, rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def function(name, n=14, tail="return total"):
    return f"def {name}(rows, limit):\n    total = 0\n" + "".join(f"    total += rows[{k}].{name}_{k} * limit - {name}_base({k})\n" for k in range(n)) + f"    {tail}\n"


def test_all_rules_are_planted():
    assert set(RULES) == {r for r in RULES if any(f"'{r}'" in s for n, s in SQL.items() if n in QUERIES)} | {"duplicate-code"}


CLEAN = {
    "/r/pkg/a.py": 'import os\n\n\nclass Reader:\n    """Reads."""\n\n    def __init__(self, path):\n        self.path = path\n\n    def size(self):\n        return os.path.getsize(self.path)\n\n    def name(self):\n        return self.path.upper()\n',
    "/r/pkg/b.ts": "// Retries because the far side drops the first call after a pause.\nexport function go(n: number): number {\n  try {\n    return n + 1;\n  } catch (e) {\n    report(e);\n  }\n  return 0;\n}\n",
    "/r/tests/test_c.py": "def test_adds():\n    assert 1 + 1 == 2\n",
}


def test_clean_files_have_no_findings(spark):
    assert analyze(frame(spark, CLEAN.items())).collect() == []


def test_empty_null_and_broken_files(spark):
    rows = [("/r/a.py", ""), ("/r/b.py", None), ("/r/c.py", "def f(:\n"), ("/r/d.ts", None), ("/r/e.ts", ""), (None, "x"), ("/r/f.py", "x = '\\ud800'\n" + "(" * 300), ("/r/g.py", "\x00"), ("/r/h.py", "-" * 20000 + "1")]
    assert [(r["rule"], r["file"], r["line"]) for r in analyze(frame(spark, rows), functions=False).collect()] == [("syntax-error", "/r/c.py", 1), ("syntax-error", "/r/f.py", 2), ("syntax-error", "/r/g.py", 1)]
    assert analyze(frame(spark, [])).collect() == []


def test_literals_that_no_text_can_hold(spark):
    facts = pyfacts.parsed(frame(spark, [("/r/a.py", "x = {'\\ud800': 1, 'b': 2, 'c': 3, 'd': 4}\n")])).collect()
    assert [k["key"] for k in facts[0]["dicts"][0]["keys"]] == ["\\ud800", "b", "c", "d"]


def test_report_scope_and_context(spark):
    body = function("weigh")
    rows = frame(spark, [("/r/a.py", body), ("/r/b.py", body.replace("weigh", "scale"))])
    own = spark.createDataFrame([("/r/a.py",)], "path string")
    found = clones.same_shape(pyfacts.parsed(frame(spark, [("/r/a.py", "def f(a):\n" + "    a += 1\n" * 5), ("/r/b.py", "def g(b):\n" + "    b += 1\n" * 5)])), own).collect()
    assert [(r["file"], r["line"]) for r in found] == [("/r/a.py", 1)]
    assert {r["file"] for r in analyze(rows, report=own).collect()} <= {"/r/a.py"}


def test_copies_beyond_the_frequency_window_are_one_family(spark):
    rows = [(f"/r/m{k:02d}.py", function("weigh", tail=f"return total * own_{k}")) for k in range(21)]
    found = clones.near_findings(pyfacts.parsed(frame(spark, rows))).collect()
    assert [(r["rule"], r["file"]) for r in found] == [("diverged-duplicate", "/r/m20.py")]


def test_pairs_forks_and_exclusions(spark):
    pairs = [(f"/r/{side}{k:02d}.py", function(f"job{k}", tail=f"return total{' * 2' if side == 'y' else ''}")) for k in range(6) for side in "xy"]
    assert len(clones.near_findings(pyfacts.parsed(frame(spark, pairs))).collect()) == 6
    fork = [(f"/r/{side}.py", "\n".join(function(f"job{k}", tail=f"return total{' * 2' if side == 'y' else ''}") for k in range(6))) for side in "xy"]
    found = clones.near_findings(pyfacts.parsed(frame(spark, fork))).collect()
    assert [(r["file"]) for r in found] == ["/r/y.py"] and found[0]["message"].startswith("6 functions")
    alike = [("/r/a.py", function("job")), ("/r/b.py", function("job").replace("total", "amount"))]
    assert clones.near_findings(pyfacts.parsed(frame(spark, alike))).collect() == []  # one shape: an exact copy, not a near one
    twins = "class A:\n" + "".join(f"    {deco}\n" + "".join("    " + x + "\n" for x in function("size", tail=tail).splitlines()) for deco, tail in (("@property", "return total"), ("@size.setter", "return total * 2")))
    assert clones.near_findings(pyfacts.parsed(frame(spark, [("/r/a.py", twins)]))).collect() == []


def test_format_strings_are_one_token():
    plain = pyfacts.shingles('x = f"{a + b} and {c!r:>{w}}" + 1.5\ny = "s"\n')
    assert plain == pyfacts.shingles('x = f"none" + 7\ny = f"{q}"\n') and len(plain) == 4
    assert pyfacts.shingles("def f(:\n  '''") == []


def test_shapes_ignore_names_and_keep_the_rest():
    import ast

    shape = lambda text: pyfacts.function_shape(ast.parse(text).body[0])
    assert shape("def f(a: int) -> int:\n    'doc'\n    b = a + 1\n    return [b for b in a]") == shape("def g(x):\n    y = x + 1\n    return [y for y in x]")
    assert shape("def f(a):\n    return a + 1") != shape("def f(a):\n    return a + 2")
    assert shape("def f(a):\n    return free") != shape("def f(a):\n    return other")
    assert shape("def f(a):\n    global b\n    b = a") != shape("def f(a):\n    global c\n    c = a")
    assert shape("@p\ndef f(a):\n    pass") != shape("@q\ndef f(a):\n    pass")


def masked_by_character(text):
    out, quote, i = "", None, 0
    while i < len(text):
        two = text[i : i + 2]
        if quote == "/*":
            end = two == "*/"
            out += "  " if end else "\n" if text[i] == "\n" else " "
            quote, i = (None, i + 2) if end else (quote, i + 1)
        elif quote:
            if text[i] == "\\" and i + 1 < len(text):
                out += " " + ("\n" if text[i + 1] == "\n" else " ")
                i += 2
                continue
            if text[i] == quote or text[i] == "\n" and quote != "`":
                quote = None
            out += "\n" if text[i] == "\n" else " "
            i += 1
        elif two == "//":
            while i < len(text) and text[i] != "\n":
                out, i = out + " ", i + 1
        elif two == "/*":
            out, quote, i = out + "  ", two, i + 2
        else:
            quote = text[i] if text[i] in "\"'`" else None
            out += " " if quote else text[i]
            i += 1
    return out


def test_masks_against_a_walk_over_characters():
    import random

    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("ab\"'`\\/*\n ") for _ in range(rng.randint(0, 24)))
        assert scripts.code_only(text) == masked_by_character(text), repr(text)


def test_arguments_and_delays():
    assert scripts.arguments(" (() => { a(1, 2); }, 5 /* ms, */)", 0) == ["() => { a(1, 2); }", "5"]
    assert scripts.arguments("('a)', \"b,\", [1, 2])", 0) == ["'a)'", '"b,"', "[1, 2]"]
    assert scripts.arguments("(a, b", 0) is None and scripts.arguments("x", 0) is None
    assert [scripts.no_delay(f"(f{d})", 0) for d in ("", ", 0", ", 0x0", ", 1_000", ", n", ", 0.0", ",")] == [True, True, True, False, False, True, True]


def test_schema_texts():
    assert schemas.without_comments("a # x\nb // y\n'c # d' /* e\n*/ f") == "a    \nb     \n" + " " * 12 + "\n   f"
    assert schemas.surface("a(b[c]) d {e}") == "a(      d {  "
    assert schemas.declared("x.proto", "message A { string b = 1;") == []
    assert schemas.declared("x.avsc", "no json") == [] and schemas.declared("x.txt", "a: 1") == []


def test_files_with_bad_bytes_and_ignored_folders(spark, tmp_path):
    for name, content in {"a.py": b"x = 1\n", "b.py": b"y = '\xff\xfe'\n", "node_modules/c.py": b"z = 1\n", ".hidden/d.py": b"z = 1\n", "pkg/e.ts": b"let e;\n", "pkg/f.txt": b"f", "pkg/g_pb2.py": b"g = 1\n", "pkg/api_schema.json": b"{}", "generated/h.py": b"h = 1\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r["path"][len(str(tmp_path)) + 1 :]: r["text"] for r in S.read_files(spark, str(tmp_path), str(tmp_path / "a.py")).collect()}
    assert set(got) == {"a.py", "b.py", "pkg/e.ts"} and got["b.py"].startswith("y = '\ufffd")
    assert not any("node_modules" in f or ".hidden" in f for f in S.folders_under(spark, str(tmp_path)))
    assert len(S.folders_under(spark, str(tmp_path), 2)) == 2
    assert [r["path"].rsplit("/")[-1] for r in S.read_schema_files(spark, str(tmp_path)).collect()] == ["api_schema.json"]
    assert S.read_files(spark, str(tmp_path / "none")).collect() == []
    near = S.nearby_schemas(spark, [str(tmp_path / "pkg" / "e.ts")], {"_config_dir": str(tmp_path), "contract_schemas": "pkg/*.json"}).collect()
    assert len(near) == 1


def test_names_in_an_edit(tmp_path):
    for name in ("a.py", "with space.py", "b.py"):
        (tmp_path / name).write_text("x = 1\n")
    edit = {"file_path": "a.py", "patch": "*** Update File: with space.py\n+ b.py\n+ no such file.py\n", "more": ["a.py", {"deep": str(tmp_path / "b.py")}]}
    assert [p.rsplit("/", 1)[-1] for p in S.target_files(edit, str(tmp_path), S.checkable_file)] == ["a.py", "with space.py", "b.py"]
    assert S.top_folders(["/a/b/c.py", "/a/d.py", "/e/f.py", "/a/b/x/y.py"]) == ["/a", "/e"]


def test_configuration_and_baseline(spark, tmp_path, monkeypatch):
    (tmp_path / S.CONFIG_NAME).write_text(json.dumps({"disable": "bare-except", "max_nesting": "x", "fail_on": "odd", "relaxed_paths": "/demo/"}))
    (tmp_path / "sub").mkdir()
    monkeypatch.setenv(S.DISABLE_VARIABLE, "dead-code, as-any")
    config = S.load_config(str(tmp_path / "sub"))
    assert config["disable"] == ["bare-except", "dead-code", "as-any"] and S.project_root(str(tmp_path / "sub"), config) == str(tmp_path)
    s = rules.Settings.from_config(config)
    assert (s.max_nesting, s.fail_on, s.relaxed[-1]) == (4, "warn", "/demo/")
    (tmp_path / S.CONFIG_NAME).write_text("[broken")
    assert S.load_config(str(tmp_path))["_config_dir"] == str(tmp_path)
    from siltstone.operators import findings as V

    found = cut(analyze(frame(spark, [("/r/a.py", "try:\n    go()\nexcept:\n    raise ValueError\n")]), root="/r", functions=False))
    name = str(tmp_path / S.BASELINE_NAME)
    assert S.write_baseline(V.baseline_rows(found, "/r"), name) == 1
    at, known = S.find_baseline(spark, str(tmp_path / "sub"))
    assert at == name and V.without_baseline(found, known).collect() == [] and V.hidden_count(found, known) == 1
    assert V.exit_status(found) == 1 and V.exit_status(found, "error") == 0 and V.exit_status(found, None, "never") == 0
    code, said = V.verdict(found)
    assert code == 2 and said[0].startswith("1 finding") and "bare-except" in said[1]
    assert V.footer(found, 3) == ["1 finding(s): 0 error, 1 warn, 0 info", "(3 more in the baseline)"]
    assert json.loads(V.json_report(found))[0]["rule"] == "bare-except"


def test_two_scans_of_many_files_agree(spark):
    rows = frame(spark, [(f"/r/m{k:03d}.py", f"def f{k}(a=[]):\n    return a[{k}]\n") for k in range(205)]).repartition(7)
    once = [tuple(r) for r in analyze(rows, functions=False).collect()]
    assert len(once) == 205 and once == [tuple(r) for r in analyze(rows.repartition(3), functions=False).collect()]


def test_one_long_file_of_lines(spark):
    text = "\n".join(f"line number {k} of a long file" for k in range(20_000))
    rows = frame(spark, [("/r/a.txt", text), ("/r/b.txt", "\n".join(text.split("\n")[:10]))])
    assert lines.windows(rows).count() == 19_995 + 5
    got = [tuple(r) for r in lines.clone_blocks(rows).collect()]
    assert got == [("/r/a.txt", 1, 10, "/r/b.txt", 1, 10)]


def test_a_line_in_every_file_is_no_copy(spark):
    notice = "\n".join(f"permission is granted, clause {k}, to all" for k in range(8))
    assert lines.clone_pairs(frame(spark, [(f"/r/{k}.txt", notice) for k in range(40)])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_greedy_matching_against_one_walk(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [("f", "g" if rng.random() < 0.7 else "f", a, b, round(rng.choice([0.6, 0.7, 0.8, 0.9, 1.0]), 2), a, b, "", "", rng.randint(1, 3), rng.randint(1, 3)) for a in range(8) for b in range(8, 16) if rng.random() < 0.5]
    copies = {(g, i): n for _, g, a, b, *_, na, nb in rows for i, n in ((a, na), (b, nb))}
    rows = [(*r[:9], copies[r[1], r[2]], copies[r[1], r[3]]) for r in rows]
    left, want = dict(copies), []
    for r in sorted(rows, key=lambda r: (-r[4], r[2], r[3])):
        n = min(left[r[1], r[2]], left[r[1], r[3]])
        if n:
            left[r[1], r[2]] -= n
            left[r[1], r[3]] -= n
            want.append((r[1], r[2], r[3], n))
    got = N.one_to_one(spark.createDataFrame(rows, "file_a string, file_b string, id_a long, id_b long, jaccard double, line_a long, line_b long, name_a string, name_b string, n_a int, n_b int"))
    assert sorted((r["file_b"], r["id_a"], r["id_b"], r["matched"]) for r in got.collect()) == sorted(want)


def test_events_to_guard(spark, tmp_path):
    """Parsed events, analysed in one batch, through the keyed guard: a set that repeats is told once."""
    source = tmp_path / "in"
    source.mkdir()
    said = [("s1", 1, "x"), ("s1", 2, "x"), ("s1", 3, "y"), ("s1", 4, "x"), ("s2", 5, "x")]
    spark.createDataFrame(said, "session string, seq long, message string").withColumn("rule", F.lit("r")).withColumn("severity", F.lit("warn")).withColumn("file", F.lit("/r/a.py")).withColumn("line", F.lit(1)).coalesce(1).write.mode("append").parquet(str(source))
    found = spark.read.parquet(str(source))
    sets = guard.digest(found)
    sets.coalesce(1).write.parquet(str(tmp_path / "sets"))
    stream = spark.readStream.schema(sets.schema).parquet(str(tmp_path / "sets"))
    run = guard.guard(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r["session"], r["seq"]) for r in spark.table("told").collect())
    assert got == sorted((r["session"], r["seq"]) for r in guard.first_reports(sets).collect()) == [("s1", 1), ("s1", 3), ("s1", 4), ("s2", 5)]


def test_malformed_and_active_events_pass_unseen(spark, tmp_path):
    lines_ = ['{"hook_event_name": "Stop", "session_id": "a"}', "no json", '{"stop_hook_active": true, "hook_event_name": "Stop"}', "[1]", '{"hook_event_name": "Edit"}']
    got = guard.parse_events(spark.createDataFrame([(x,) for x in lines_], "value string")).collect()
    assert sorted((r["hook_event_name"], r["session_id"]) for r in got) == [("Edit", "nosession"), ("Stop", "a")]
    assert guard.is_turn_end("Stop") and guard.is_turn_end("") and not guard.is_turn_end("PostToolUse")
    assert [guard.swallowed_unless_new("s", d, str(tmp_path / "state")) for d in "aab"] == [False, True, False]
    (tmp_path / "file").write_text("")
    assert guard.swallowed_unless_new("s", "a", str(tmp_path / "file"))


def test_suppression_covers_its_line_and_the_next(spark):
    text = "# siltstone:ignore mutable-default\ndef f(a=[]):\n    return a\n\ndef g(a=[]):  # siltstone:ignore bare-except\n    return a\n"
    assert [(r["rule"], r["line"]) for r in analyze(frame(spark, [("/r/a.py", text)]), functions=False).collect()] == [("mutable-default", 5)]


def test_every_rule_has_a_finding_somewhere(spark):
    found, _ = raw_findings(frame(spark, [("/r/a.py", function("weigh")), ("/r/b.py", function("weigh"))]))
    assert {r["rule"] for r in found.select("rule").distinct().collect()} == {"duplicate-code", "duplicate-function"}


def test_changed_files_of_a_repository(tmp_path):
    import shutil
    import subprocess

    assert S.changed_files(str(tmp_path / "none")) == []
    if not shutil.which("git"):
        pytest.skip("no git")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text("x = 1\n")
    names = lambda: sorted(p.rsplit("/", 1)[-1] for p in S.changed_files(str(tmp_path)))
    assert names() == ["a.py", "b.py"]  # no commit yet
    git("add", "a.py")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 2\n")
    assert names() == ["a.py", "b.py"]
    git("add", "-A")
    git("commit", "-qm", "two")
    assert names() == []


def test_json_lines_and_exclusions(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "r", "TP", "ann")], "fingerprint string, rule string, label string, who string")
    for _ in range(2):
        S.append_jsonl(rows, str(tmp_path / "log"))
    assert S.read_jsonl(spark, str(tmp_path / "log"), "fingerprint string, label string").count() == 2
    assert S.excluded("/r/gen/a.py", {"hook_exclude": "*/gen/*"}) and not S.excluded("/r/a.py", {"hook_exclude": 5})
    (tmp_path / "s").mkdir()
    for k in range(3):
        (tmp_path / "s" / f"m{k}.proto").write_text("message A {}")
    config = {"_config_dir": str(tmp_path), "schema_roots": ["s", 3], "contract_schemas": "s/m1.proto"}
    assert [p[-8:] for p in S.config_schema_paths(config)] == ["m1.proto", "m0.proto", "m2.proto"]
    assert len(S.config_schema_paths(config, 2)) == 2 and len(S.config_schema_paths(config, 9, 0)) == 1


def test_batches_of_events_that_fail_pass_unseen(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"hook_event_name": "Stop", "session_id": "a"}\n')
    told = []

    def run(name, analyse):
        stream = spark.readStream.schema("value string").text(str(tmp_path / "in"))
        q = guard.watch(stream, analyse, lambda df, n: told.append((name, df.count())), str(tmp_path / name))
        q.processAllAvailable()
        q.stop()

    run("good", lambda events: events)
    run("bad", lambda events: 1 / 0)
    monkeypatch.setenv(guard.OFF_VARIABLE, "1")
    run("off", lambda events: events)
    assert told == [("good", 1)]


def test_only_the_facts_asked_for_are_made(spark, monkeypatch):
    """They are the ones of a whole reading, for files with one text too; the others cost nothing."""
    text = "import os\n@wrap\ndef test_a(m):\n    m.f.return_value = 'blue'\n    assert go() == 'blue'\n\nclass A:\n    def go(self, a=[]):\n        if a:\n            return 1\n"
    files = [(f"/r/tests/test_{k}.py", t) for k, t in enumerate([text, "def f(:\n", text, None, "x = 1\n" * 2000, text, "x = '\\ud800'\n"])]
    whole = {r["path"]: r.asDict(True) for r in pyfacts.parsed(frame(spark, files)).collect()}
    for wanted in (["tests.sides", "tests.planted", "harness"], ["functions.name", "functions.depth_line", "functions.shingles", "functions.defaults"], ["classes", "attributes", "error"]):
        got = {r["path"]: r.asDict(True) for r in pyfacts.parsed(frame(spark, files), *wanted).collect()}
        kept = {w.partition(".")[0]: {v.partition(".")[2] for v in wanted if v.partition(".")[0] == w.partition(".")[0]} for w in wanted}
        cut_down = lambda v, names: [{k: x for k, x in e.items() if k in names} for e in v] if isinstance(v, list) and names != {""} else v
        assert got == {p: {"path": p} | {c: cut_down(r[c], names) for c, names in kept.items()} for p, r in whole.items()}
    monkeypatch.setattr(pyfacts, "shingles", None)
    monkeypatch.setattr(pyfacts, "function_shape", None)
    monkeypatch.setattr(pyfacts, "comments_of", None)
    assert pyfacts.facts(text, pyfacts.fields_of(pyfacts.schema_of("tests.sides")))["tests"] == [{"sides": [{"line": 5, "kind": "other", "n": 0, "value": None}, {"line": 5, "kind": "str", "n": 4, "value": "s:blue"}]}]
    with pytest.raises(ValueError):
        pyfacts.schema_of("no_such")


def test_runs_of_texts_are_bounded():
    texts = ["x"] * 600 + ["y" * pyfacts.CHARS * 2, "z"]
    runs = [texts[r] for r in pyfacts.runs(texts)]
    assert [t for r in runs for t in r] == texts and list(pyfacts.runs([])) == []
    assert all(len(r) == 1 or len(r) <= pyfacts.ROWS and sum(map(len, r)) <= pyfacts.CHARS for r in runs)


def test_tasks_to_parse_grow_in_number_not_in_size(spark, tmp_path):
    spark.range(10 * planted.TASK_FILES - 5).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    assert planted.parts(spark, str(tmp_path)).rdd.getNumPartitions() == 10
