"""Queries of the source rules over planted files, with SQL that knows the planting only.

Every row of ``part`` gets one file: variant number p_partkey modulo the number of variants, with the
key written where the text says @K@. A variant lists the findings it was planted with, as rule:line
(and :severity where it is not the rule's usual one); the SQL joins that list to ``part``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clones, contracts, rules
from ..operators.rules import Settings
from ..sources import schemas, scripts
from ..sources.pyfacts import parsed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
Variant = tuple[str, str]

_INFO = {"type-ignore", "single-method-class", "debug-artifact", "mock-only-test", "contract-case-skew"}
_ERROR = {"syntax-error", "dead-code", "duplicate-function"}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def literals(texts: list[str]) -> str:
    """A DuckDB list of texts; line feeds are written as they are."""
    return "[" + ", ".join(map(quoted, texts)) + "]"


#: Files that one task parses.
TASK_FILES = 10_000


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows to plant in. They are few bytes and become much to parse, so all cores get their share of them, TASK_FILES a task or a few more."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return part.repartition(max(spark.sparkContext.defaultParallelism, -(-part.count() // TASK_FILES)))


def files(spark: SparkSession, sf_dir: str, variants: list[Variant], path: str) -> DataFrame:
    part = parts(spark, sf_dir)
    text = F.element_at(F.array(*[F.lit(v[0]) for v in variants]), (F.col("p_partkey") % len(variants) + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    return part.select(F.regexp_replace(F.lit(path), F.lit("@K@"), key).alias("path"), F.regexp_replace(text, F.lit("@K@"), key).alias("text"))


def planted_sql(variants: list[Variant], path: str) -> str:
    rows = []
    for k, (_, hits) in enumerate(variants):
        for hit in hits.split():
            rule, line, *level = hit.split(":")
            rows.append(f"({k}, '{rule}', '{level[0] if level else 'info' if rule in _INFO else 'error' if rule in _ERROR else 'warn'}', {line})")
    return f"SELECT replace('{path}', '@K@', p_partkey::VARCHAR) AS file, v.rule, v.severity, v.line FROM part JOIN (VALUES {', '.join(rows)}) v(i, rule, severity, line) ON p_partkey % {len(variants)} = v.i"


#: The facts that rules ask for; a fact that is missing here is a column that the query cannot resolve.
_FACTS = {
    "py_syntax": "error",
    "dead_code": "dead",
    "exceptions": "handlers",
    "imports": "imports names exported",
    "private_names": "tops methods loads attributes",
    "write_only": "attrs",
    "placeholders": "functions.name functions.line functions.decorators functions.class functions.declares functions.empty functions.doc",
    "mutable_defaults": "functions.name functions.defaults",
    "size_nesting": "functions.name functions.line functions.span functions.depth functions.depth_line",
    "single_method": "classes",
    "debug_prints": "logs prints",
    "type_ignores": "comments",
    "test_asserts": "tests.name tests.line tests.empty tests.asserts",
    "tautology": "tests.same",
    "conditional_asserts": "tests.name tests.asserts",
    "overspecified": "tests.sides",
    "mock_echo": "tests.sides tests.planted",
    "sleeps": "tests.sleeps",
    "private_pokes": "tests.pokes",
    "mock_counts": "tests.name tests.line tests.mocks",
    "parametrize": "tests.name tests.line tests.n_body tests.parametrized tests.shape",
}


def plant(name: str, pick: Callable[[], list[Column]], variants: list[Variant], path: str = "/r/src/m@K@.py") -> None:
    """Register the query ``name``: the given rules over the planted files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = files(spark, sf_dir, variants, path)
        read = parsed(made, *_FACTS[name].split(), *["harness"] * ("tests." in _FACTS[name])) if path.endswith(".py") else scripts.scripts(made)
        return rules.reported(read, pick()).drop("message")

    QUERIES[name] = run
    SQL[name] = planted_sql(variants, path)


# == Python ==

plant("py_syntax", lambda: [rules.syntax_errors()], [("x = 1\n", ""), ("def f(:\n    pass\n", "syntax-error:1"), ("a = 1\nb = = 2\n", "syntax-error:2"), ("match x:\n    case 1:\n        y = @K@\n", "")])

plant("dead_code", lambda: [rules.dead_code()], [
    ("def f@K@(x):\n    return x\n    y = 1\n    z = 2\n", "dead-code:3"),
    ("def f(x):\n    if x:\n        raise ValueError\n    return x\n", ""),
    ("for i in range(3):\n    continue\n    print(i)\nelse:\n    pass\n", "dead-code:3"),
    ("while True:\n    try:\n        break\n    finally:\n        x = 1\n", ""),
    ("try:\n    x = 1\nfinally:\n    raise ValueError\n    y = 2\n", "dead-code:5"),
])

plant("exceptions", lambda: [rules.swallowed(), rules.bare_excepts()], [
    ("try:\n    go()\nexcept:\n    pass\n", "bare-except:3 swallowed-exception:3"),
    ("try:\n    go()\nexcept:\n    log()\n    raise\n", ""),
    ("try:\n    go()\nexcept ValueError:\n    pass\n", "swallowed-exception:3"),
    ("try:\n    go()\nexcept asyncio.CancelledError:\n    pass\n", ""),
    ("def f():\n    for x in y:\n        try:\n            return go(x)\n        except KeyError:\n            pass\n", ""),
    ("def f():\n    while x:\n        try:\n            return go(x)\n        except KeyError:\n            pass\n", "swallowed-exception:5"),
    ("try:\n    go()\nexcept (CancelledError, OSError):\n    pass\n", "swallowed-exception:3"),
    ("for x in y:\n    try:\n        break\n    except* KeyError:\n        pass\n", "swallowed-exception:4"),
])

plant("imports", lambda: [rules.unused_imports()], [
    ("import os\nimport sys\nprint(sys)\n", "unused-import:1"),
    ("import os.path\nfrom a import b as c, d\nd()\n", "unused-import:2"),
    ("from __future__ import annotations\nfrom a import *\n", ""),
    ("import os  # noqa\nfrom a import (\n    b,  # noqa\n)\n", ""),
    ("from a import b\n__all__ = ['b']\n", ""),
    ("try:\n    import fast\nexcept ImportError:\n    fast = None\n", ""),
    ("from a import _\nimport k@K@\n", "unused-import:2"),
])

plant("private_names", lambda: [rules.unused_private()], [
    ("def _gone():\n    pass\n", "unused-private:1"),
    ("def _used():\n    pass\n\n_used()\n", ""),
    ("import pytest\n@pytest.fixture\ndef _fix():\n    pass\n", ""),
    ("class _Hidden:\n    pass\n", "unused-private:1"),
    ("class A:\n    def _m(self):\n        pass\n    @property\n    def _p(self):\n        return 1\n", "unused-private:2"),
    ("class A(Base):\n    def _m(self):\n        return 1\n", "unused-private:2:info"),
    ("from typing import Protocol\nclass A(Protocol):\n    def _m(self):\n        ...\n    def _n(self):\n        return 1\n", "unused-private:5"),
    ("class A:\n    def _m(self):\n        pass\n    def run(self):\n        return self._m\n", ""),
])

plant("write_only", lambda: [rules.write_only()], [
    ("class A:\n    def __init__(self):\n        self._n = 1\n", "write-only-attr:3"),
    ("class A:\n    def __init__(self):\n        self._n = 1\n    def n(self):\n        return self._n\n", ""),
    ("class A(B):\n    def f(self):\n        self._n = 1\n", "write-only-attr:3:info"),
    ("class A:\n    def f(self):\n        self._n = 0\n        self._n += 1\n", ""),
    ("class A:\n    def f(self):\n        self._n = 0\n        del self._n\n", ""),
    ("class A:\n    def f(self):\n        self.n = 0\n        self.__x__ = 1\n", ""),
])

plant("placeholders", lambda: [rules.placeholders()], [
    ("def pay@K@():\n    pass\n", "placeholder-body:1"),
    ('def pay():\n    """Pays."""\n', "placeholder-body:1"),
    ('def pay():\n    """Hook for subclasses."""\n', ""),
    ("@abstractmethod\ndef pay():\n    ...\n", ""),
    ("class NullPay:\n    def pay(self):\n        pass\n", ""),
    ("import abc\nclass Pay(abc.ABC):\n    def pay(self):\n        pass\n", ""),
    ("def pay():\n    raise NotImplementedError\n", ""),
    ("class A:\n    def __exit__(self):\n        pass\n    def go(self):\n        ...\n", "placeholder-body:4"),
])

plant("mutable_defaults", lambda: [rules.mutable_defaults()], [
    ("def f(a, b=[], *, c={}):\n    return a\n", "mutable-default:1 mutable-default:1"),
    ("def f(a=None, b=(), c=tuple()):\n    return a\n", ""),
    ("def f(\n    a=list(),\n    b={1},  # noqa\n):\n    return a\n", "mutable-default:2"),
    ("from typing import Annotated\nfrom fastapi import Query\ndef f(a: Annotated[list, Query()] = []):\n    return a\n", ""),
    ("import typing as t\nimport fastapi\nQ = t.Annotated[list, fastapi.Query()]\ndef f(a: Q = [], b: list = []):\n    return a\n", "mutable-default:4"),
    ("g = lambda a=[]: a\n", ""),
])

_DEEP = "def f(x):\n    if x:\n        for a in x:\n            while a:\n                with a:\n                    try:\n                        pass\n                    finally:\n                        pass\n"
_FLAT = "def f(x):\n    if x == 1:\n        pass\n" + "".join(f"    elif x == {k}:\n        pass\n" for k in range(8))
_LONG = "def g():\n" + '    """' + "\n" * 90 + '    """\n' + "    x = 1\n" * 80
plant("size_nesting", lambda: [rules.long_functions(Settings()), rules.deep_nesting(Settings())], [
    (_DEEP, "deep-nesting:6"), (_FLAT, ""), (_LONG, ""), (_LONG + "    y = 2\n", "long-function:1"),
    ("def g():\n    def h():\n" + "        x = 1\n" * 79 + "    y = 1\n", ""),
    (_DEEP.replace("try:", "match a:").replace("pass\n                    finally:\n", "case 1:\n").replace("case 1:\n                        pass", "case 1:\n                            pass"), ""),
])

plant("single_method", lambda: [rules.single_method()], [
    ('class A:\n    """Doc."""\n    def __init__(self):\n        pass\n    def go(self):\n        return 1\n', "single-method-class:1"),
    ("class A(B):\n    def go(self):\n        return 1\n", ""),
    ("class A:\n    x = 1\n    def go(self):\n        return 1\n", ""),
    ("class A:\n    def __call__(self):\n        return 1\n    def go(self):\n        return 1\n", ""),
    ("class A:\n    def go(self):\n        return 1\n    def _help(self):\n        return 2\n", "single-method-class:1"),
])

plant("debug_prints", lambda: [rules.debug_prints()], [("import logging\nprint(1)\n", "debug-artifact:2"), ("print(1)\n", ""), ("from loguru import logger\ndef f():\n    print(@K@)\n    print(2)\n", "debug-artifact:3 debug-artifact:4"), ("import structlog.stdlib\nx.print(1)\n", "")])

plant("type_ignores", lambda: [rules.python_comments()], [
    ("x = f()  # type: ignore\n", "type-ignore:1"),
    ("x = f()  # type: ignore  # noqa\n", ""),
    ("# In a real implementation, we would check\nx = 1\n", "hedging-comment:1"),
    ("# ---- setup ----\n# open the file\nopen_the_file()\n", ""),
    ("# open the file handle\nopen_file_handle()\n", "redundant-comment:1"),
    ("# open file handle twice quickly\nopen_file_handle(twice)\n", "redundant-comment:1:info"),
    ("count_rows_now = 1  # count rows\n", "redundant-comment:1"),
    ("s = '# for simplicity'\n# x = 1\n# keeps the order of keys\ny = 2\n", ""),
])

# == Python tests ==

_T = "/r/tests/test_m@K@.py"
_TEST = lambda *names: lambda: [rules.unit_rules(Settings())[k] for k in names]

plant("test_asserts", _TEST(0, 1), [
    ("def test_a():\n    go()\n", "no-assert-test:1"), ("def test_a():\n    assert go()\n", ""), ("def test_a():\n    pass\n", ""),
    ("def test_a():\n    m.assert_called_once()\n", "mock-only-test:1"), ("def test_a():\n    m.assert_called()\n    assert m\n", ""),
    ("def test_a():\n    check_all()\n", ""), ("def probe():\n    assert 1\nclass TestA:\n    def test_b(self):\n        probe()\n", ""),
    ("def test_a():\n    with pytest.raises(E):\n        go()\n", ""), ("def test_a():\n    go()\nif __name__ == '__main__':\n    test_a()\n", ""), ("def test_a():\n    self.fail()\n", ""),
], _T)

plant("tautology", _TEST(2), [
    ("def test_a():\n    assert True\n", "tautological-assert:2"), ("def test_a():\n    assert x == x\n", "tautological-assert:2"), ("def test_a():\n    assert 0\n", ""),
    ("def test_a(self):\n    self.assertEqual(a.b, a.b)\n    self.assertTrue(1)\n", "tautological-assert:2 tautological-assert:3"), ("def test_a(self):\n    self.assertIs(a, b)\n    assert x == y\n", ""),
], _T)

plant("conditional_asserts", _TEST(3), [
    ("def test_a():\n    if x:\n        assert y\n", "conditional-assert:3"), ("def test_a():\n    if x:\n        assert y\n    else:\n        assert z\n", ""),
    ("def test_a():\n    if x:\n        check(y)\n    assert z\n", ""), ("def test_a():\n    for x in y:\n        if x:\n            m.assert_called()\n        if x:\n            assert x\n", "conditional-assert:6"),
], _T)

plant("overspecified", _TEST(4, 5), [
    ("def test_a():\n    assert s() == '" + "w" * 48 + "'\n", "brittle-exact-string:2"), ("def test_a():\n    assert s() == '" + "w" * 47 + "'\n", ""),
    ("def test_a():\n    assert s() == [1, 2, 3, 4, 5, 6, 7, 8]\n", "overspecified-assert:2"), ("def test_a(self):\n    self.assertDictEqual(d, {'a': 1, 'b': 1, 'c': 1, 'd': 1, 'e': 1, 'f': 1, 'g': 1, 'h': 1})\n", "overspecified-assert:2"),
    ("def test_a():\n    assert s() == (1, 2, 3, 4, 5, 6, 7)\n    assert s() in [1, 2, 3, 4, 5, 6, 7, 8]\n", ""),
], _T)

plant("mock_echo", _TEST(6), [
    ("def test_a():\n    m.f.return_value = 'blue'\n    assert go() == 'blue'\n    assert go() == 'blue'\n", "mock-echo-test:3"), ("def test_a():\n    m.f.return_value = 1\n    assert go() == True\n", ""),
    ("def test_a():\n    m = Mock(return_value=42)\n    assert go() == 42.0\n", "mock-echo-test:3"), ("def test_a():\n    m = Mock(return_value=42)\n    assert go() == 43\n", ""),
], _T)

plant("sleeps", _TEST(7), [
    ("import time\ndef test_a():\n    time.sleep(1)\n    assert x\n", "sleep-in-test:3"), ("import time\ndef test_a():\n    time.sleep(0)\n", ""),
    ("from asyncio import sleep as nap\nasync def test_a():\n    await nap(2)\n", "sleep-in-test:3"), ("import time\ndef test_a(time):\n    time.sleep(1)\n", ""),
    ("import time\ndef test_a():\n    def slow():\n        time.sleep(1)\n    run(slow)\n    run(lambda: time.sleep(2))\n", ""), ("import clock\ndef test_a():\n    clock.sleep(1)\n", ""),
    ("import gevent as g\ndef test_a():\n    g.sleep(x)\n", "sleep-in-test:3"),
], _T)

plant("private_pokes", _TEST(8), [
    ("def test_a():\n    assert x._n == 1\n    assert y._n == 2\n    assert x._m\n", "private-poke-test:2 private-poke-test:4"), ("def test_a(self):\n    assert self._n\n    assert x.__dict__\n    assert t._asdict()\n", ""), ("def test_a():\n    x._n = 1\n", ""),
], _T)

plant("mock_counts", _TEST(9), [
    ("def test_a():\n    " + "\n    ".join(f"m{k} = Mock()" for k in range(6)) + "\n", "excessive-mocking:1"), ("def test_a():\n    " + "\n    ".join(f"m{k} = MagicMock()" for k in range(5)) + "\n", ""),
    ("@patch('a')\n@patch('b')\n@patch('c')\ndef test_a(a, b, c):\n    assert a\n", "excessive-mocking:4"), ("@patch.object(a, 'b')\n@patch.object(a, 'c')\n@patch.object(a, 'd')\ndef test_a(a, b, c):\n    assert a\n", ""),
], _T)

plant("parametrize", _TEST(10), [
    ("".join(f"def test_{k}():\n    x = go({k})\n    assert x == '{k}'\n\n" for k in range(3)), "parametrize-candidate:1"), ("".join(f"def test_{k}():\n    x = go({k})\n    assert x == '{k}'\n\n" for k in range(2)), ""),
    ("".join(f"def test_{k}():\n    assert go({k}) == '{k}'\n\n" for k in range(5)), ""), ("".join(f"@pytest.mark.parametrize('a', [1])\ndef test_{k}():\n    x = go({k})\n    assert x == '{k}'\n\n" for k in range(4)), ""),
    ("".join(f"def test_{k}():\n    x = go{k}(1)\n    assert x\n\n" for k in range(4)), ""),
], _T)

# == other languages ==

_TS, _S = "/r/src/m@K@.ts", Settings()
plant("type_escapes", lambda: [rules.type_escapes()], [
    ("const x = y as any;\n", "as-any:1"), ("const s = 'as any';\n// as any\n", ""), ("// eslint-disable-next-line @typescript-eslint/no-explicit-any -- legacy\nconst x = y as any;\n", ""),
    ("// eslint-disable-next-line semi\nconst x = y as any; // eslint-disable-line no-explicit-any\nconst z = y as any;\n", "as-any:3"), ("// @ts-ignore\nfoo();\n", "ts-ignore:1"), ("const s = '// @ts-ignore';\n", ""),
    ("// eslint-disable-next-line ban-ts-comment\n// @ts-nocheck\nfoo(); // fine @ts-ignore\n", "ts-ignore:3"),
], _TS)

plant("console_logs", lambda: [rules.console_logs()], [("console.log(1); console.debug(2);\n", "debug-artifact:1"), ("// console.log(1)\nconst s = `\nconsole.log(2)\n`;\n", ""), ("a();\nif (x) console.debug (y);\n", "debug-artifact:2"), ("console.error(1);\n", "")], "/r/src/m@K@.jsx")

plant("empty_catches", lambda: [rules.script_catches()], [
    ("try { a(); } catch (e) {}\n", "swallowed-exception:1"), ("try { a(); } catch (e) { /* fine */ }\n", ""), ("try {\n  a();\n} catch {\n}\n", "swallowed-exception:3"),
    ("p.then(f).catch(() => {});\n", "swallowed-exception:1"), ("p.catch(e => { });\nconst s = 'catch (e) {}';\n", "swallowed-exception:1"), ("try { a(); } catch (e) { log(e); }\n", ""), ("try { a(); } catch (e) {\n  // ignored: optional\n}\n", ""),
], _TS)

plant("private_fields", lambda: [rules.private_fields()], [
    ("class A {\n  private retry = 3;\n}\n", "unused-private:2"), ("class A {\n  private retry = 3;\n  f() { return this.retry; }\n}\n", ""), ("class A {\n  #n = 1;\n  #m = 2;\n  f() { return this.#m; }\n}\n", "unused-private:2"),
    ("class A {\n  private readonly static go(): void {}\n  private constructor() {}\n}\n", "unused-private:2"),
], _TS)
plant("private_members", lambda: [rules.private_fields()], [("class A {\n  private final int count = 0;\n}\n", "unused-private:2"), ("class A {\n  private int count() { return 1; }\n  int f() { return count(); }\n}\n", ""), ("class A {\n  private Map<String, Integer> seen;\n}\n", "unused-private:2")], "/r/src/M@K@.java")

plant("long_comment_runs", lambda: [rules.long_comments(_S)], [("# a\n" * 7 + "x: 1\n", "long-comment:1"), ("# a\n" * 6 + "x: 1\n", ""), ("#!shebang\n" + "# a\n" * 6 + "\n" + "# b\n" * 8, "long-comment:9"), ("x: 1\n" + "  # a\n" * 9, "long-comment:2")], "/r/conf/m@K@.yaml")

plant("script_comments", lambda: [rules.script_comments()], [
    ("// fetch user record\nfetchUserRecord();\n", "redundant-comment:1"), ("// for now, we skip it\nx();\n", "hedging-comment:1"), ("// ======== part\n// fetch user record\nfetchUserRecord();\n", ""),
    ("fetchUserRecord(); // fetch the user record\n", "redundant-comment:1"), ("/**\n * @example\n * add(count, value) // add count value\n */\nadd();\n", ""), ("/**\n * @param a // add count value\n */\nadd();\n", ""),
    ("const u = 'http://fetch/user'; /* none */\n/// fetch user record\nfetchUserRecord();\n", ""), ("// const x = 1;\n// fetch user record\n\n// keeps what callers rely on\nfetchUserRecord();\n", ""),
], "/r/src/m@K@.js")
plant("banner_chain", lambda: [rules.script_comments()], [("# ----\n# read all rows\n# read all rows\nread_all_rows\n", ""), ("# ----\n\n# read all rows\nread_all_rows\n", "redundant-comment:3"), ("# ----\n# for simplicity read\n# read all rows\nread_all_rows\n", "hedging-comment:2 redundant-comment:3"), ("# ~~~~\nx\n# ....\n# read all rows\nread_all_rows\n", "")], "/r/src/m@K@.rb")
plant("next_code_line", lambda: [rules.script_comments()], [("// open user file\n\n// other remark entirely\n/* block */\nopenUserFile();\n", "redundant-comment:1"), ("// open user file\n", ""), ("// OpenUser opens user file\nfunc OpenUser() {}\n", ""), ("// open user file\nopenUserFile()\n", "redundant-comment:1")], "/r/src/m@K@.go")

plant("script_tests", lambda: rules.block_rules(_S), [
    ("it('a', () => {\n  go();\n  go();\n});\n", "no-assert-test:1"), ("it('a', () => {\n  expect(m).toHaveBeenCalled();\n});\n", "mock-only-test:1"), ("test('a', () => {\n  expect(true).toBe(true);\n});\n", "tautological-assert:2"),
    ("it('a', async () => {\n  await new Promise(r => setTimeout(r, 100));\n  expect(x).toBe(1);\n});\n", "sleep-in-test:2"), ("it('a', async () => {\n  await new Promise(r => setTimeout(r, 0));\n  await new Promise(r => setTimeout(r));\n  expect(x).toBe(1);\n});\n", ""),
    ("it('a', () => {\n  expect(x).toBe('" + "w" * 50 + "');\n});\n", "brittle-exact-string:2"), ("it('a', () => {\n  expect(f('" + "w" * 50 + "')).toBe('" + "w" * 50 + "');\n});\n", ""), ("it.skip('a', () => {\n  go();\n  go();\n});\n", ""),
    ("".join(f"it('a{k}', () => {{\n  const x = f({k});\n  expect(x).toBe({k + 7});\n}});\n" for k in range(3)), "parametrize-candidate:1"), ("it('a', () => {\n" + "  vi.fn();\n" * 6 + "  expect(x).toBe(1);\n});\n", "excessive-mocking:1"),
], "/r/src/m@K@.test.ts")

# == masks, comments, suppressions ==

_MASKS = [("a('x') // c\nb", "a(   )     \nb"), ("s = \"a\\\"b\" + /* m\nn */ 1", "s =        +     \n     1"), ("`a\nb` c", "  \n   c"), ("'open\nd('e')", "     \nd(   )"), ("x / y // z", "x / y     ")]
QUERIES["mask_non_code"] = lambda spark, sf_dir: scripts.scripts(files(spark, sf_dir, _MASKS, "/r/m@K@.ts")).select(F.col("path").alias("file"), F.array_join("code", "\n").alias("code"))
SQL["mask_non_code"] = f"SELECT '/r/m' || p_partkey || '.ts' AS file, ({literals([m[1] for m in _MASKS])})[p_partkey % {len(_MASKS)} + 1] AS code FROM part"

_NOTES = [("x = 1 # note", "x = 1", "note"), ("s = '#' # n", "s = '#'", "n"), ("t = \"\\\"#\" #m", "t = \"\\\"#\"", "m"), ("# all", "", "all")]
QUERIES["trailing_comment"] = lambda spark, sf_dir: scripts.scripts(files(spark, sf_dir, [(n[0], "") for n in _NOTES], "/r/m@K@.sh")).select(F.col("path").alias("file"), F.explode("notes").alias("n")).select("file", F.col("n.beside").alias("beside"), F.col("n.comment").alias("comment"))
SQL["trailing_comment"] = f"SELECT '/r/m' || p_partkey || '.sh' AS file, ({literals([n[1] for n in _NOTES])})[p_partkey % {len(_NOTES)} + 1] AS beside, ({literals([n[2] for n in _NOTES])})[p_partkey % {len(_NOTES)} + 1] AS comment FROM part"

_HUSH = [("x = 1  # siltstone:ignore dead-code -- why not bare-except\n", "dead-code", 1), ("# siltstone:ignore\nx = 1\n", "*", 1), ("y = 1\n# siltstone:ignore no-such-rule, none\n", "*", 2), ("s = 'siltstone:ignore'\n# siltstone:ignore bare-except, dead-code (old)\n", "bare-except,dead-code", 2)]
QUERIES["suppression_marks"] = lambda spark, sf_dir: parsed(files(spark, sf_dir, [(h[0], "") for h in _HUSH], "/r/m@K@.py")).select(F.col("path").alias("file"), F.explode("ignores").alias("i")).select("file", F.col("i.line").alias("line"), F.coalesce(F.array_join("i.rules", ","), F.lit("*")).alias("rules"))
SQL["suppression_marks"] = f"SELECT '/r/m' || p_partkey || '.py' AS file, ([{', '.join(str(h[2]) for h in _HUSH)}])[p_partkey % 4 + 1] AS line, ({literals([h[1] for h in _HUSH])})[p_partkey % 4 + 1] AS rules FROM part"

# == functions of one shape, and nearly alike ==


def dup_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in threes have a function of one shape: names differ, and the constant is the number of the three."""
    part = parts(spark, sf_dir).select(F.col("p_partkey").alias("k"))
    text = F.format_string("@wrap\ndef f%d(a%d, b: int = 2) -> int:\n    \"\"\"Of %d.\"\"\"\n    t%d = a%d + %d\n    for i%d in range(b):\n        t%d += i%d\n    return t%d\n", *["k"] * 5, F.floor(F.col("k") / 3), *["k"] * 4)
    made = part.select(F.format_string("/r/m%09d.py", "k").alias("path"), text.alias("text"))
    return clones.same_shape(parsed(made, *clones.SHAPE_FACTS)).drop("message")


QUERIES["dup_functions"] = dup_functions
SQL["dup_functions"] = "WITH k AS (SELECT p_partkey AS k, min(p_partkey) OVER (PARTITION BY p_partkey // 3) AS first FROM part) SELECT 'duplicate-function' AS rule, 'error' AS severity, printf('/r/m%09d.py', k) AS file, 2 AS line FROM k WHERE k <> first"


def diverged_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in twos have a long function nearly alike: every name carries the number of the two, and one line differs."""
    part = parts(spark, sf_dir).select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 2).alias("g"))
    body = "".join(f"    v{n}_@G@ = w{n}_@G@ * u{n + 1}_@G@ + z{n}_@G@\n" for n in range(12))
    text = F.concat(F.lit("def f_@G@(x):\n"), F.lit(body), F.when(F.col("k") % 2 == 0, "    return v1_@G@\n").otherwise("    return max(v2_@G@, v3_@G@)\n"))
    made = part.select(F.format_string("/r/m%09d.py", "k").alias("path"), F.regexp_replace(text, F.lit("@G@"), F.col("g").cast("string")).alias("text"))
    return clones.near_findings(parsed(made, *clones.NEAR_FACTS)).drop("message")


QUERIES["diverged_functions"] = diverged_functions
SQL["diverged_functions"] = "SELECT 'diverged-duplicate' AS rule, 'warn' AS severity, printf('/r/m%09d.py', max(p_partkey)) AS file, 1 AS line FROM part GROUP BY p_partkey // 2 HAVING count(*) = 2"

# == contracts ==

_SCHEMAS = [
    ("/s/a.proto", 'message Job { // one\n  string job_name = 1;\n  repeated int32 run_ids = 2;\n  map<string, int32> part_sizes = 3;\n  enum Kind { NONE = 0; }\n  message Inner {\n    string inner_only = 1;\n  }\n  string owner = 4 [json_name = "jobOwner"];\n}\n', "a.proto Job|jobOwner,job_name,owner,part_sizes,run_ids;a.proto Inner|inner_only"),
    ("/s/b.textproto", "top_name: 1\nblock_one {\n  low_name: 2\n}\n", "b.textproto|block_one,low_name,top_name"),
    ("/s/c.thrift", "struct Row {\n  1: required i64 rowId,\n  2: optional list<string> tag_names;\n}\nunion U {\n  1: i32 one\n}\n", "c.thrift Row|rowId,tag_names;c.thrift U|one"),
    ("/s/d.graphql", 'type User implements Node {\n  id: ID!\n  posts(first: Int, after: String): [Post]\n  "named: text" userName: String\n}\n', "d.graphql User|id,posts,userName"),
    ("/s/e.avsc", '{"type": "record", "name": "E", "fields": [{"name": "f1", "type": "int"}, {"name": "f2", "type": {"type": "record", "name": "G", "fields": [{"name": "g1", "type": "int"}]}}]}', "e.avsc E|f1,f2;e.avsc G|g1"),
    ("/s/f_schema.json", '{"properties": {"p1": {"properties": {"q1": {}}}, "p2": {}}}', "f_schema.json schema|p1,p2;f_schema.json p1|q1"),
    ("/s/g_schema.yaml", "a:\n  properties:  # here\n    k1: 1\n    'k two':\n      properties:\n        deep: 1\n  other: 2\n", "g_schema.yaml:2|k two,k1;g_schema.yaml:5|deep"),
    ("/s/h.json", "{broken", ""),
]


def schema_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of one schema file a part, eight files in turn."""
    part = parts(spark, sf_dir)
    pick = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in _SCHEMAS]), (F.col("p_partkey") % len(_SCHEMAS) + 1).cast("int"))
    made = part.select(F.concat(F.lit("/k"), "p_partkey", pick(0)).alias("path"), pick(1).alias("text"))
    rows = schemas.messages(made, limit=None)
    return rows.groupBy("label", F.array_join(F.array_sort("fields"), ",").alias("fields")).agg(F.count("*").alias("n"))


QUERIES["schema_messages"] = schema_messages
_DECLARED = ", ".join(f"({k}, {quoted(m.split('|')[0])}, {quoted(m.split('|')[1])})" for k, s in enumerate(_SCHEMAS) for m in s[2].split(";") if m)
SQL["schema_messages"] = f"SELECT label, fields, count(*) AS n FROM part JOIN (VALUES {_DECLARED}) v(i, label, fields) ON p_partkey % {len(_SCHEMAS)} = v.i GROUP BY ALL"

_DICTS = [
    ("x = {\n    'job_name': 1,\n    'run_ids': 2,\n    'partSizes': 3,\n    'owner': 4,\n}\n", "hand-rolled-contract:1 contract-case-skew:4"),
    ("x = {\n    'job_name': 1,\n    'run_ids': 2,\n    'part_sizes': 3,\n    'goneField': 4,\n}\n", "hand-rolled-contract:1 contract-drift-key:5"),
    ("x = {\n    'job_name': 1,\n    'run_ids': 2,\n    'part_sizes': 3,\n    'ownerName': 4,\n}\n", "hand-rolled-contract:1"),
    ("x = {'job_name': 1, 'a': 2, 'b': 3, 'run_ids': 4}\n", ""),
    ("x = {'owner': 1, 'one': 2, 'job_name': 3}\n", ""),
    ("x = {'job_name': 1, 'jobName': 2, 'run_ids': 3, 'owner': 4, 'part_sizes': 5}\n", "hand-rolled-contract:1"),
    ("x = {'row_id': 1, 'tag_names': 2, **rest, 'extra': 3, 'more': 4}\n", ""),
]


def _known(spark: SparkSession) -> DataFrame:
    return schemas.messages(spark.createDataFrame([s[:2] for s in _SCHEMAS], "path string, text string"))


QUERIES["contract_findings"] = lambda spark, sf_dir: contracts.contract_findings(parsed(files(spark, sf_dir, _DICTS, "/r/src/m@K@.py")), F.broadcast(_known(spark))).drop("message")
SQL["contract_findings"] = planted_sql(_DICTS, "/r/src/m@K@.py")


def best_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = contracts.dict_keys(parsed(files(spark, sf_dir, _DICTS, "/r/src/m@K@.py")))
    known = _known(spark)
    return contracts.best_messages(keys, known).join(F.broadcast(known.select("msg_no", "label")), "msg_no").select(F.col("path").alias("file"), "label")


QUERIES["best_message"] = best_message
_BEST = [(0, "a.proto Job"), (1, "a.proto Job"), (2, "a.proto Job"), (3, "a.proto Job"), (5, "a.proto Job"), (6, "c.thrift Row")]
SQL["best_message"] = f"SELECT '/r/src/m' || p_partkey || '.py' AS file, v.label FROM part JOIN (VALUES {', '.join(f"({k}, '{m}')" for k, m in _BEST)}) v(i, label) ON p_partkey % {len(_DICTS)} = v.i"

# == whole scans ==

#: path, text, and what is left of it in the end: rule:line:severity:occurrence:content of the line
_SCANNED = [
    ("/r/src/a@K@.py", "def f@K@(x):\n    return x\n    return x\n", ["dead-code|3|error|1|return x"]),
    ("/r/examples/b@K@.py", "try:\n    go()\nexcept:\n    raise ValueError\n", ["bare-except|3|info|0|except:"]),
    ("/r/src/c@K@.py", "import os\nx = 1  # type: ignore\n", ["unused-import|1|info|0|import os", "type-ignore|2|info|0|x = 1  # type: ignore"]),
    ("/r/tests/test_d@K@.py", "def test_a():\n    assert True  # siltstone:ignore tautological-assert\n    assert 1\n", []),
    ("/r/src/e@K@.ts", "try { go(); } catch (e) {}\nconst v = w as any;\n", ["swallowed-exception|1|warn|0|try { go(); } catch (e) {}", "as-any|2|info|0|const v = w as any;"]),
    ("/r/src/f@K@.py", "def g(a=[]):  # siltstone:ignore dead-code\n    return a\n", ["mutable-default|1|warn|0|def g(a=[]):  # siltstone:ignore dead-code"]),
    ("/r/conf/g@K@.yaml", "# k\n" * 7, ["long-comment|1|info|0|# k"]),
]


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = parts(spark, sf_dir)
    pick = lambda k: F.regexp_replace(F.element_at(F.array(*[F.lit(v[k]) for v in _SCANNED]), (F.col("p_partkey") % len(_SCANNED) + 1).cast("int")), F.lit("@K@"), F.col("p_partkey").cast("string"))
    return part.select("p_partkey", pick(0).alias("path"), pick(1).alias("text"))


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything from files to fingerprints."""
    from .scan import analyze

    return analyze(_mixed(spark, sf_dir), root="/r").drop("message")


_LEFT = ", ".join(f"({k}, {quoted(path)}, '{rule}', {line}, '{level}', {occ}, {quoted(content)})" for k, (path, _, hits) in enumerate(_SCANNED) for rule, line, level, occ, content in (h.split("|") for h in hits))
_SCAN_SQL = f"SELECT p_partkey AS k, replace(v.path, '@K@', p_partkey::VARCHAR) AS file, v.* EXCLUDE (i, path) FROM part JOIN (VALUES {_LEFT}) v(i, path, rule, line, severity, occ, content) ON p_partkey % {len(_SCANNED)} = v.i"
QUERIES["scan_findings"] = scan_findings
SQL["scan_findings"] = f"WITH s AS ({_SCAN_SQL}) SELECT rule, severity, file, line, left(sha256(rule || '|' || file[4:] || '|' || content || '|' || occ), 16) AS fingerprint FROM s"


def edit_microbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event a file, each third one the end of a turn: what blocks, by session and event."""
    from ..streaming import guard
    from .scan import analyze

    made = _mixed(spark, sf_dir)
    events = made.select((F.col("p_partkey") % 10).cast("string").alias("session_id"), F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 3 == 0).alias("turn_end"), "path")
    found = guard.edit_microbatch(events, made.select("path", "text"), lambda rows, own, whole: analyze(rows, report=own, functions=whole, root="/r"))
    return found.select("session", "seq", "file", "rule", "severity", "line")


QUERIES["edit_microbatch"] = edit_microbatch
SQL["edit_microbatch"] = f"WITH s AS ({_SCAN_SQL}) SELECT (k % 10)::VARCHAR AS session, k AS seq, file, rule, severity, line FROM s WHERE severity <> 'info'"
