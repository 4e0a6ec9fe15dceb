"""The per-file rules as column expressions over the facts of a file.

A file's findings are filtered out of its own arrays: no rule here joins or shuffles. Each rule gives
an array of (rule, severity, line, message); ``reported`` explodes them all at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scripts as S

FINDING = "array<struct<rule: string, severity: string, line: int, message: string>>"
Part = Callable[[Column], Column]


@dataclass(frozen=True)
class Settings:
    """What a project may set; see ``from_config``."""

    max_function_lines: int = 80
    max_nesting: int = 4
    max_comment_lines: int = 6
    min_parametrize_group: int = 3
    disable: tuple[str, ...] = ()
    strict: bool = False
    fail_on: str = "warn"
    relaxed: tuple[str, ...] = field(default_factory=lambda: tuple(T.RELAXED))

    @classmethod
    def from_config(cls, config: dict) -> Settings:
        """Values of another type than the default's are ignored; a level that does not exist is warn."""
        out = {}
        for name in ("max_function_lines", "max_nesting", "max_comment_lines", "min_parametrize_group"):
            if isinstance(config.get(name), int):
                out[name] = config[name]
        disable = config.get("disable", [])
        out["disable"] = tuple([disable] if isinstance(disable, str) else [d for d in disable if isinstance(d, str)] if isinstance(disable, (list, tuple)) else [])
        out["strict"] = config.get("profile") == "strict"
        out["fail_on"] = config["fail_on"] if config.get("fail_on") in ("warn", "error", "never") else "warn"
        more, only = config.get("relaxed_paths", []), config.get("relaxed_paths_only")
        more = [more] if isinstance(more, str) else more if isinstance(more, (list, tuple)) else []
        out["relaxed"] = tuple(only) if isinstance(only, list) else (*T.RELAXED, *more)
        return cls(**out)


def none() -> Column:
    return F.array().cast(FINDING)


def one(rule: str, severity: Column | str, line: Column, *message: Column | str) -> Column:
    parts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in message]
    return F.struct(F.lit(rule).alias("rule"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), line.cast("int").alias("line"), F.concat(*parts).alias("message"))


def each(rows: Column, where: Part, make: Part) -> Column:
    return F.coalesce(F.transform(F.filter(rows, where), make), none())


def dunder(name: Column) -> Column:
    return name.startswith("__") & name.endswith("__")


def private(name: Column) -> Column:
    return name.startswith("_") & ~dunder(name)


def base() -> Column:
    return T.basename(F.col("path"))


def has(names: str, value: Column) -> Column:
    return F.array_contains(names, value)


# == Python ==


def syntax_errors() -> Column:
    e = F.col("error")
    return F.when(e.isNotNull(), F.array(one("syntax-error", "error", e["line"], "is not valid Python: ", F.coalesce(e["text"], F.lit("")))).cast(FINDING)).otherwise(none())


def dead_code() -> Column:
    return each(F.col("dead"), lambda d: F.lit(True), lambda d: one("dead-code", "error", d["line"], "never reached, since it follows the ", d["after"], " of line ", d["after_line"]))


def unused_private() -> Column:
    free = lambda n: ~has("loads", n) & ~has("attributes", n)
    fixture = lambda t: F.exists(t["decorators"], lambda d: d.contains("fixture"))
    tops = each(F.col("tops"), lambda t: private(t["name"]) & free(t["name"]) & ~fixture(t), lambda t: one("unused-private", "warn", t["line"], "nothing in this file uses the private ", t["kind"], " ", t["name"]))
    methods = each(F.col("methods"), lambda m: private(m["name"]) & ~m["decorated"] & ~m["stub"] & free(m["name"]), lambda m: one("unused-private", F.when(m["based"], "info").otherwise("warn"), m["line"], "nothing in this file calls ", m["class"], ".", m["name"]))
    return F.concat(tops, methods)


def write_only() -> Column:
    return each(F.col("attrs"), lambda a: private(a["name"]) & ~a["read"], lambda a: one("write-only-attr", F.when(a["based"], "info").otherwise("warn"), a["line"], "self.", a["name"], " is set here and read nowhere in this file"))


def unused_imports() -> Column:
    level = F.when(base().isin("compat.py", "_compat.py"), "info").otherwise("warn")
    idle = lambda i: ~i["noqa"] & ~i["name"].isin("_", "__") & ~has("names", i["name"]) & ~has("exported", i["name"]) & (base() != "__init__.py")
    return each(F.col("imports"), idle, lambda i: one("unused-import", level, i["line"], "import of ", i["name"], " without a use"))


def placeholders() -> Column:
    double_file = base().rlike(r"(?i)^(?:mock|fake|stub)s?_|_(?:mock|fake|stub)s?\.py$")

    def hollow(f: Column) -> Column:
        noted = F.exists(f["decorators"], lambda d: d.contains("abstract") | d.isin("overload", "skip", "skipif", "xfail"))
        double = F.coalesce(f["class"].rlike("(?i)stub|mock|fake|dummy|null|noop"), F.lit(False))
        meant = f["doc"].rlike("(?i)hook|does nothing|no-?op|override|subclass")
        return f["empty"] & ~dunder(f["name"]) & ~noted & ~double & ~f["declares"] & ~meant & ~double_file

    return each(F.col("functions"), hollow, lambda f: one("placeholder-body", "warn", f["line"], f["name"], "() has a body that does nothing"))


def swallowed() -> Column:
    def silent(h: Column) -> Column:
        cancelled = h["typed"] & F.forall(h["caught"], lambda c: c.isin("Cancelled", "CancelledError"))
        next_try = h["typed"] & h["try_leaves"] & F.coalesce(h["loop"] == "for", F.lit(False))
        return h["passes"] & ~cancelled & ~next_try

    return each(F.col("handlers"), silent, lambda h: one("swallowed-exception", "warn", h["line"], "the handler drops the exception without a word"))


def bare_excepts() -> Column:
    return each(F.col("handlers"), lambda h: ~h["typed"] & ~h["reraises"], lambda h: one("bare-except", "warn", h["line"], "catches every exception, exits and interrupts too"))


def mutable_defaults() -> Column:
    own = lambda f: F.transform(F.filter(f["defaults"], lambda d: d["mutable"] & ~d["owned"] & ~d["noqa"]), lambda d: one("mutable-default", "warn", d["line"], "calls of ", f["name"], "() share this default value"))
    return F.coalesce(F.flatten(F.transform("functions", own)), none())


def long_functions(s: Settings) -> Column:
    return each(F.col("functions"), lambda f: f["span"] > s.max_function_lines, lambda f: one("long-function", "warn", f["line"], f["name"], "() has ", f["span"], f" lines, {s.max_function_lines} allowed"))


def deep_nesting(s: Settings) -> Column:
    return each(F.col("functions"), lambda f: f["depth"] > s.max_nesting, lambda f: one("deep-nesting", "warn", f["depth_line"], f["name"], "() nests ", f["depth"], f" blocks, {s.max_nesting} allowed"))


def single_method() -> Column:
    public = lambda c: F.filter(c["methods"], lambda m: ~m.startswith("_"))
    special = lambda c: F.exists(c["methods"], lambda m: dunder(m) & (m != "__init__"))
    lone = lambda c: c["plain"] & (c["other"] == 0) & (F.size(public(c)) == 1) & (F.size(c["methods"]) <= 2) & ~special(c)
    return each(F.col("classes"), lone, lambda c: one("single-method-class", "info", c["line"], c["name"], " holds one method only: ", F.element_at(public(c), 1)))


def debug_prints() -> Column:
    return F.when(F.col("logs"), each(F.col("prints"), lambda p: F.lit(True), lambda p: one("debug-artifact", "info", p, "print() beside a logger"))).otherwise(none())


def judged(text: Column, code: Column) -> Column:
    """The severity of a comment that repeats its code: warn if in full, info if in part."""
    level = F.when(F.coalesce(code, F.lit("")) != "", T.redundancy(text, code))
    return F.when(level == "full", "warn").when(level == "partial", "info")


def hedged(text: Column) -> Column:
    return F.when(~F.contains(F.col("path"), F.lit("/examples/")), T.hedge(text))


def _hedging(line: Column, phrase: Column) -> Column:
    return one("hedging-comment", "warn", line, "puts the work off: ", phrase)


def _repeating(line: Column, level: Column, text: Column) -> Column:
    return one("redundant-comment", level, line, "repeats the code: ", F.left(text, F.lit(60)))


def python_comments() -> Column:
    """type-ignore, hedging-comment, redundant-comment: one fold, since an exempt line exempts the comment under it."""
    def ready(c: Column) -> Column:
        hushed = (c["text"] == "") | c["text"].contains("siltstone:") | c["text"].contains("noqa")
        return F.struct(c["line"].alias("line"), c["text"].alias("text"), hushed.alias("hushed"), hedged(c["text"]).alias("phrase"), (T.is_banner(c["text"]) | T.looks_like_code(c["text"])).alias("exempt"), judged(c["text"], c["code"]).alias("level"))

    def state(banner: Column, out: Column) -> Column:
        return F.struct(banner.cast("int").alias("banner"), out.cast(FINDING).alias("out"))

    def step(acc: Column, c: Column) -> Column:
        add = lambda f: state(acc["banner"], F.concat(acc["out"], F.array(f)))
        typed = F.when(c["text"].contains("type: ignore"), add(one("type-ignore", "info", c["line"], "hides an error of types")))
        rest = typed.when(c["phrase"].isNotNull(), add(_hedging(c["line"], c["phrase"]))).when(c["exempt"] | (acc["banner"] == c["line"] - 1), state(c["line"], acc["out"]))
        rest = rest.when(c["level"].isNotNull(), add(_repeating(c["line"], c["level"], c["text"]))).otherwise(acc)
        return F.when(c["hushed"], acc).otherwise(rest)

    rows = F.transform(F.coalesce("comments", F.array()), ready)
    return F.aggregate(rows, state(F.lit(-1), none()), step)["out"]


def python_rules(s: Settings) -> list[Column]:
    return [syntax_errors(), dead_code(), unused_private(), write_only(), unused_imports(), placeholders(), swallowed(), bare_excepts(), mutable_defaults(), long_functions(s), deep_nesting(s), single_method(), debug_prints(), python_comments(), *unit_rules(s)]


# == Python tests ==


def unit_rules(s: Settings) -> list[Column]:
    """The rules on test functions; a file with an entry point of its own is no suite."""
    tests = F.when(T.is_test_path(F.col("path")) & ~F.coalesce("harness", F.lit(False)), F.col("tests"))
    true = lambda t: F.lit(True)
    within = lambda make: F.coalesce(F.flatten(F.transform(tests, make)), none())
    first = lambda rows: F.slice(rows, 1, 1)
    trivial = ["None", "n:0", "n:1", "n:-1", "s:"]

    def echo(t: Column) -> Column:
        known = lambda x: F.transform(t["planted"], lambda p: p["value"])
        hit = F.filter(t["sides"], lambda x: F.coalesce(~x["value"].isin(trivial) & F.array_contains(known(x), x["value"]), F.lit(False)))
        planted = lambda x: F.element_at(F.filter(t["planted"], lambda p: p["value"] == x["value"]), 1)["line"]
        return F.transform(first(hit), lambda x: one("mock-echo-test", "warn", x["line"], "asserts what the mock of line ", planted(x), " was told to return"))

    def pinned(t: Column) -> Column:
        return F.transform(F.filter(t["sides"], lambda x: x["kind"].isin("dict", "list") & (x["n"] >= 8)), lambda x: one("overspecified-assert", "warn", x["line"], "pins a literal of ", x["n"], " entries"))

    shape = lambda t: F.when(~t["parametrized"] & (t["n_body"] >= 2), t["shape"])
    groups = F.transform(F.array_distinct(F.filter(F.transform(tests, shape), lambda x: x.isNotNull())), lambda x: F.filter(tests, lambda t: F.coalesce(shape(t) == x, F.lit(False))))
    names = lambda g: F.concat(F.array_join(F.transform(F.slice(g, 1, 4), lambda t: t["name"]), ", "), F.when(F.size(g) > 4, ", ...").otherwise(""))
    hint = lambda g: F.when(F.size(g) >= 6, "; a property may state them all").otherwise("")
    return [
        each(tests, lambda t: (F.size(t["asserts"]) == 0) & ~t["empty"], lambda t: one("no-assert-test", "warn", t["line"], t["name"], "() asserts nothing")),
        each(tests, lambda t: (F.size(t["asserts"]) > 0) & F.forall(t["asserts"], lambda a: a["kind"] == "mock"), lambda t: one("mock-only-test", "info", t["line"], t["name"], "() asserts calls of mocks only")),
        within(lambda t: F.transform(t["same"], lambda x: one("tautological-assert", "warn", x["line"], F.when(x["form"] == "same", "compares a thing with itself").otherwise("asserts a constant")))),
        within(lambda t: F.transform(first(F.filter(t["asserts"], lambda a: a["under_if"])), lambda a: one("conditional-assert", "warn", a["line"], "asserts on some paths of ", t["name"], "() only"))),
        within(lambda t: F.transform(F.filter(t["sides"], lambda x: (x["kind"] == "str") & (x["n"] >= S.LONG)), lambda x: one("brittle-exact-string", "warn", x["line"], "pins a text of ", x["n"], " characters"))),
        within(pinned),
        within(echo),
        within(lambda t: F.transform(F.filter(t["sleeps"], lambda x: ~x["zero"] & ~x["shadowed"] & ~x["injected"]), lambda x: one("sleep-in-test", "warn", x["line"], "waits for real"))),
        within(lambda t: F.transform(F.filter(t["pokes"], lambda x: ~x["own"] & ~x["name"].startswith("__") & ~x["name"].isin("_make", "_fields", "_replace", "_asdict")), lambda x: one("private-poke-test", "warn", x["line"], "reads the private ", x["name"]))),
        each(tests, lambda t: t["mocks"] > 5, lambda t: one("excessive-mocking", "warn", t["line"], t["name"], "() sets up ", t["mocks"], " mocks")),
        each(groups, lambda g: F.size(g) >= s.min_parametrize_group, lambda g: one("parametrize-candidate", "warn", F.element_at(g, 1)["line"], F.size(g), " tests differ in literals only: ", names(g), hint(g))),
    ]


# == other languages ==


def _is(kinds: set[str]) -> Column:
    return F.col("ext").isin(*sorted(kinds))


def _yaml() -> Column:
    return F.col("ext").isin(".yml", ".yaml")


def long_comments(s: Settings) -> Column:
    """Runs of comment lines beyond the limit, found at their first line."""
    mark = F.when(_is(S.HASHED), "#").otherwise("//")
    own = F.transform(F.concat("lines", F.array(F.lit(""))), lambda x, i: F.struct((i + 1).alias("line"), (F.startswith(T.strip(x), mark) & ~T.strip(x).startswith("#!")).alias("on")))

    def state(start: Column, n: Column, out: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), n.cast("int").alias("n"), out.cast(FINDING).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        found = one("long-comment", "warn", acc["start"], acc["n"], f" lines of comment, {s.max_comment_lines} allowed")
        ended = F.when(acc["n"] > s.max_comment_lines, F.concat(acc["out"], F.array(found))).otherwise(acc["out"])
        return F.when(x["on"], state(F.when(acc["n"] == 0, x["line"]).otherwise(acc["start"]), acc["n"] + 1, acc["out"])).otherwise(state(F.lit(0), F.lit(0), ended))

    return F.aggregate(own, state(F.lit(0), F.lit(0), none()), step)["out"]


def script_comments() -> Column:
    """hedging-comment and redundant-comment, with exempt lines and documentation examples carried from line to line."""
    def ready(n: Column) -> Column:
        c = n["comment"]
        silent = (c == "") | c.contains("siltstone:") | c.startswith("!") | c.startswith("/")
        code = F.when(n["beside"] != "", n["beside"]).otherwise(n["next"])
        go = (F.col("ext") == ".go") & (n["beside"] == "") & code.rlike(r"^(?:const|var|type|func)\b|^[A-Z]\w*[(\s]")
        return F.struct(n["line"].alias("line"), c.alias("text"), n["opens"].alias("opens"), n["tag"].alias("tag"), n["closes"].alias("closes"), n["beside"].startswith("*").alias("inside"), silent.alias("silent"), hedged(c).alias("phrase"), (T.is_banner(c) | T.looks_like_code(c)).alias("exempt"), F.when(~F.coalesce(go, F.lit(False)), judged(c, code)).alias("level"), (F.coalesce(go, F.lit(False)) | code.isNull()).alias("stops"))

    def state(doc: Column, example: Column, banner: Column, out: Column) -> Column:
        return F.struct(doc.alias("doc"), example.alias("example"), banner.cast("int").alias("banner"), out.cast(FINDING).alias("out"))

    def step(acc: Column, n: Column) -> Column:
        doc = acc["doc"] | n["opens"]
        example = F.when(n["opens"], False).when(doc & F.coalesce(n["tag"] == "example", F.lit(False)), True).when(doc & n["tag"].isNotNull(), False).otherwise(acc["example"])
        same = state(doc, example, acc["banner"], acc["out"])
        on = doc & ~n["closes"]
        done = lambda out: state(on, example & on, acc["banner"], out)
        add = lambda f: F.concat(acc["out"], F.array(f))
        out = F.when(n["text"].isNull(), done(acc["out"])).when(n["silent"], same)
        out = out.when(n["phrase"].isNotNull(), state(doc, example, acc["banner"], add(_hedging(n["line"], n["phrase"]))))
        out = out.when(n["exempt"] | (acc["banner"] == n["line"] - 1), state(doc, example, n["line"], acc["out"]))
        out = out.when(doc & example & n["inside"], done(acc["out"])).when(n["stops"], same)
        return out.when(n["level"].isNotNull(), done(add(_repeating(n["line"], n["level"], n["text"])))).otherwise(done(acc["out"]))

    rows = F.when(~_yaml(), F.transform("notes", ready))
    return F.coalesce(F.aggregate(rows, state(F.lit(False), F.lit(False), F.lit(-1), none()), step)["out"], none())


def script_catches() -> Column:
    return each(F.col("catches"), lambda c: ~c["documented"], lambda c: one("swallowed-exception", "warn", c["line"], F.when(c["promise"], "the rejection").otherwise("the exception"), " is caught and dropped without a word"))


def _lint_off(at: Column, rule: str) -> Column:
    """Whether a line directive for the linter names the rule: on the line, or for it on the line before."""
    form = r"^\s*eslint-disable-(next-line|line)\b((?:[^-]|-(?!-))*)"
    kind = lambda n: F.regexp_extract(n["comment"], form, 1)
    named = lambda n: F.exists(F.split(F.regexp_extract(n["comment"], form, 2), ","), lambda r: F.element_at(F.split(T.strip(r), "/"), -1) == rule)
    there = lambda n: ((n["line"] == at) & (kind(n) == "line")) | ((n["line"] == at - 1) & (kind(n) == "next-line"))
    return F.exists("notes", lambda n: F.coalesce(there(n) & named(n), F.lit(False)))


def _code_lines(form: str) -> Column:
    return F.filter(F.transform("code", lambda x, i: F.when(x.rlike(form), i + 1)), lambda k: k.isNotNull())


def type_escapes() -> Column:
    casts = each(_code_lines(r"\bas\s+any\b"), lambda k: ~_lint_off(k, "no-explicit-any"), lambda k: one("as-any", "warn", k, "a cast to any turns the type checks off"))
    quiet = each(F.col("notes"), lambda n: F.coalesce(n["comment"].rlike(r"@ts-(?:nocheck|ignore)\b"), F.lit(False)) & ~_lint_off(n["line"], "ban-ts-comment"), lambda n: one("ts-ignore", "warn", n["line"], "a type error is told to be quiet"))
    return F.when(_is(S.TYPED), F.concat(casts, quiet)).otherwise(none())


def console_logs() -> Column:
    return F.when(_is(S.SCRIPT), each(_code_lines(r"\bconsole\.(?:debug|log)\s*\("), lambda k: F.lit(True), lambda k: one("debug-artifact", "info", k, "writes to the console"))).otherwise(none())


def private_fields() -> Column:
    return each(F.col("privates"), lambda p: p["uses"] <= 1, lambda p: one("unused-private", "warn", p["line"], "nothing in this file uses the private ", p["name"]))


def block_rules(s: Settings) -> list[Column]:
    """The rules on test blocks of scripts."""
    rows = F.when(T.is_test_path(F.col("path")) & _is(S.SCRIPT), F.col("blocks"))
    n = lambda b, form: F.regexp_count(b["text"], F.lit(form))
    feeds = lambda b: n(b, "\n")
    expects = lambda b: n(b, r"\bexpect\s*\(")
    speaks = r"(?i)\b(?:(?:validate|verify|check|assert)\w*|expect(?:TypeOf)?)\s*[(<]"
    mocked = lambda b: n(b, r"toHaveBeen(?:LastCalled|NthCalled|Called)|toBeCalled")
    doubles = lambda b: n(b, r"\b(?:vi|jest)\s*\.\s*(?:fn|spyOn|mock)\s*\(")
    within = lambda make: F.coalesce(F.flatten(F.transform(rows, make)), none())
    quoted = "[\"'`]"

    def plain(b: Column) -> Column:
        text = F.regexp_replace(b["text"], quoted + "[^\"'`]*" + quoted, "S")
        text = F.trim(F.regexp_replace(F.regexp_replace(text, r"\b\d+(?:\.\d+)?\b", "N"), r"\s+", " "))
        return F.when((F.length(text) > 40) & (feeds(b) >= 2), text)

    forms = F.transform(rows, lambda b: F.struct(b["line"].alias("line"), plain(b).alias("form")))
    groups = F.transform(F.array_distinct(F.filter(F.transform(forms, lambda b: b["form"]), lambda x: x.isNotNull())), lambda x: F.filter(forms, lambda b: F.coalesce(b["form"] == x, F.lit(False))))
    at = lambda g: F.array_join(F.transform(g, lambda b: b["line"].cast("string")), ", ")
    silent = lambda b: ~b["text"].rlike(speaks) & (feeds(b) >= 3)
    return [
        each(rows, silent, lambda b: one("no-assert-test", "warn", b["line"], "the test asserts nothing")),
        each(rows, lambda b: ~silent(b) & (expects(b) > 0) & (mocked(b) >= expects(b)), lambda b: one("mock-only-test", "info", b["line"], "the test asserts calls of mocks only")),
        within(lambda b: F.transform(b["same"], lambda k: one("tautological-assert", "warn", k, "expects a literal to be itself"))),
        within(lambda b: F.transform(F.filter(b["sleeps"], lambda x: ~x["zero"]), lambda x: one("sleep-in-test", "warn", x["line"], "waits for real"))),
        within(lambda b: F.transform(F.filter(b["strings"], lambda x: ~x["echoed"]), lambda x: one("brittle-exact-string", "warn", x["line"], "pins a text of ", x["n"], " characters"))),
        each(rows, lambda b: doubles(b) > 5, lambda b: one("excessive-mocking", "warn", b["line"], "the test sets up ", doubles(b), " mocks")),
        each(groups, lambda g: F.size(g) >= s.min_parametrize_group, lambda g: one("parametrize-candidate", "warn", F.element_at(g, 1)["line"], F.size(g), " tests differ in literals only, at lines ", at(g), F.when(F.size(g) >= 6, "; a property may state them all").otherwise(""))),
    ]


def script_rules(s: Settings) -> list[Column]:
    return [long_comments(s), script_comments(), *(F.when(~_yaml(), c).otherwise(none()) for c in (script_catches(), type_escapes(), console_logs(), private_fields())), *block_rules(s)]


def reported(facts: DataFrame, rules: list[Column]) -> DataFrame:
    """rule, severity, file, line, message of all rules."""
    rows = facts.select(F.col("path").alias("file"), F.explode(F.concat(*[c.cast(FINDING) for c in rules])).alias("f"))
    return rows.select("f.rule", "f.severity", "file", "f.line", "f.message")
