"""Python source as facts: one row a file, with arrays that the rules filter where they lie.

Syntax trees and token streams have no form in SQL, so this one Arrow pass reads each file once and
writes down what the rules ask for. Everything after it is a column expression or a join.
"""

from __future__ import annotations

import ast
import functools
import hashlib
import io
import re
import textwrap
import tokenize
import warnings
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from .marks import MARK, ignored_rules

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPE = (*FUNCTION, ast.ClassDef)
BLOCK = (ast.With, ast.AsyncWith, ast.While, ast.For, ast.AsyncFor, ast.Try, ast.If)
ENDING = {ast.Return: "return", ast.Raise: "raise", ast.Break: "break", ast.Continue: "continue"}
SHINGLE = 5
#: What a class may derive from without inheriting behaviour, by module.
MARKERS = {"abc": {"ABC", "ABCMeta"}, "typing": {"Protocol", "Generic"}, "typing_extensions": {"Protocol", "Generic"}}
#: Metadata by which a web framework takes over a parameter's default.
OWNS_DEFAULT = set("Security Query Path Header Form File Depends Cookie Body".split())
LOGGERS = {"structlog", "loguru", "logging"}
SLEEPERS = {"time", "asyncio", "trio", "anyio", "gevent", "eventlet"}
MOCK_CALLS = tuple(f"assert_{s}" for s in ("not_awaited", "not_called", "has_calls", "any_call", "awaited", "called"))
RAISES = {"raises", "assertLogs"} | {f"assert{w}{r}" for w in ("Raises", "Warns") for r in ("", "Regex")}
HELPERS = re.compile("validate|expect|verify|check|assert")
#: Rows and characters that are made facts of at a time; facts kept of texts up to SHORT characters, for files with the same text.
ROWS, CHARS, KEPT, SHORT = 512, 1 << 20, 256, 1 << 12

DDL = """path string, error struct<line: int, text: string>, harness boolean, logs boolean,
names array<string>, loads array<string>, attributes array<string>, exported array<string>,
functions array<struct<no: int, name: string, line: int, end: int, decorators: array<string>, dotted: array<string>, class: string, declares: boolean, empty: boolean, doc: string, n_stmts: int, span: int, depth: int, depth_line: int, shape: string, shingles: array<bigint>, defaults: array<struct<line: int, mutable: boolean, owned: boolean, noqa: boolean>>>>,
classes array<struct<name: string, line: int, plain: boolean, other: int, methods: array<string>>>,
tops array<struct<name: string, line: int, kind: string, decorators: array<string>>>,
methods array<struct<class: string, name: string, line: int, decorated: boolean, stub: boolean, based: boolean>>,
attrs array<struct<name: string, line: int, read: boolean, based: boolean>>,
dead array<struct<line: int, after: string, after_line: int>>,
handlers array<struct<line: int, typed: boolean, caught: array<string>, passes: boolean, reraises: boolean, try_leaves: boolean, loop: string>>,
imports array<struct<name: string, line: int, noqa: boolean>>,
prints array<int>,
comments array<struct<line: int, text: string, code: string>>,
dicts array<struct<line: int, n: int, keys: array<struct<key: string, line: int>>>>,
ignores array<struct<line: int, rules: array<string>>>,
tests array<struct<name: string, line: int, n_body: int, parametrized: boolean, empty: boolean, shape: string, mocks: int, asserts: array<struct<line: int, kind: string, under_if: boolean>>, same: array<struct<line: int, form: string>>, sides: array<struct<line: int, kind: string, n: int, value: string>>, planted: array<struct<value: string, line: int>>, pokes: array<struct<name: string, line: int, own: boolean>>, sleeps: array<struct<line: int, zero: boolean, shadowed: boolean, injected: boolean>>>>"""


def name_of(node: ast.AST | None) -> str | None:
    return node.id if isinstance(node, ast.Name) else None


def constant_of(node: ast.AST | None) -> object:
    """The value of a literal; the node itself, which equals no value, of anything else."""
    return node.value if isinstance(node, ast.Constant) else node


def text_of(node: ast.AST | None) -> str | None:
    value = constant_of(node)
    return value if isinstance(value, str) else None


def attr_of(node: ast.AST | None) -> str | None:
    return node.attr if isinstance(node, ast.Attribute) else None


def names_with(nodes: Iterable[ast.AST], ctx: type) -> set[str]:
    """Names that are stored or loaded, as ``ctx`` says."""
    return {n.id for n in nodes if name_of(n) and isinstance(n.ctx, ctx)}


def is_doc(stmt: ast.stmt) -> bool:
    return isinstance(stmt, ast.Expr) and text_of(stmt.value) is not None


def without_doc(body: list[ast.stmt]) -> list[ast.stmt]:
    return body[1:] if body and is_doc(body[0]) else body


def only_passes(body: list[ast.stmt]) -> bool:
    return {type(s) for s in body} <= {ast.Pass}


def does_nothing(body: list[ast.stmt]) -> bool:
    return only_passes([s for s in body if not isinstance(s, ast.Expr) or constant_of(s.value) is not ...])


def parameters(args: ast.arguments) -> set[str]:
    every = [*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg]
    return {a.arg for a in every if a is not None}


def bound_in(fn: ast.AST) -> set[str]:
    """Names that a function or lambda binds itself; those of scopes within it are their own."""
    own, outer = parameters(fn.args), set()
    todo = list(ast.iter_child_nodes(fn))
    while todo:
        node = todo.pop()
        if isinstance(node, SCOPE):
            own.add(node.name)
        elif not isinstance(node, ast.Lambda):
            own |= names_with([node], ast.Store)
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                whole = isinstance(node, ast.ImportFrom)
                own |= {a.asname or (a.name if whole else a.name.partition(".")[0]) for a in node.names if not whole or a.name != "*"}
            elif isinstance(node, ast.ExceptHandler) and node.name:
                own.add(node.name)
            elif isinstance(node, (ast.Global, ast.Nonlocal)):
                outer |= set(node.names)
            todo += ast.iter_child_nodes(node)
    return own - outer


def outline(node: object, bound: set[str] | None, blank: bool = False) -> str:
    """The tree as text. Bound names, parameters and functions are called x and lose their annotations;
    with ``blank`` names stay and all constants are one."""
    if isinstance(node, list):
        return "[" + ",".join(outline(n, bound, blank) for n in node) + "]"
    if not isinstance(node, ast.AST):
        return repr(node)
    if isinstance(node, ast.Constant):
        return "'C'" if blank else f"Constant({node.value!r},{node.kind!r})"
    fields = {f: getattr(node, f, None) for f in node._fields}
    head = ""
    if not blank:
        if isinstance(node, ast.Name) and bound and node.id in bound:
            fields["id"] = "x"
        elif isinstance(node, ast.arg):
            fields |= {"arg": "x", "annotation": None}
        elif isinstance(node, (*FUNCTION, ast.Lambda)):
            if not isinstance(node, ast.Lambda):
                head = outline(fields.pop("decorator_list"), bound)
                fields |= {"name": "x", "returns": None}
            bound = bound_in(node)
    return f"{type(node).__name__}({head}{','.join(outline(v, bound, blank) for v in fields.values())})"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def function_shape(fn: ast.AST) -> str:
    return digest(outline(_with(fn, body=without_doc(fn.body)), None))


def unit_shape(fn: ast.AST) -> str:
    return digest(outline(_with(fn, body=without_doc(fn.body), name="test", decorator_list=[]), None, True))


def _with(node: ast.AST, **changes: object) -> ast.AST:
    return type(node)(**({f: getattr(node, f, None) for f in node._fields} | changes))


def shingles(source: str) -> list[int]:
    """Distinct hashes of five tokens; numbers, strings and whole f-strings count as one token each."""
    words, inside = [], 0
    plain = {tokenize.NUMBER: "0", tokenize.STRING: "s"}
    opens, closes = getattr(tokenize, "FSTRING_START", -1), getattr(tokenize, "FSTRING_END", -1)
    try:
        for token in tokenize.generate_tokens(io.StringIO(textwrap.dedent(source)).readline):
            if token.type == opens:
                words += ["s"] * (inside == 0)
                inside += 1
            elif inside:
                inside -= token.type == closes
            elif token.type in plain:
                words.append(plain[token.type])
            elif token.type in (tokenize.OP, tokenize.NAME):
                words.append(token.string)
    except (SyntaxError, tokenize.TokenError):
        return []
    grams = {"\x00".join(g) for g in zip(*(words[k:] for k in range(SHINGLE)))}
    return sorted(int.from_bytes(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for g in grams)


def dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Call):
        return dotted(node.func)
    if isinstance(node, ast.Attribute):
        left = dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    return name_of(node) or ""


def parts_of(decorator: ast.AST) -> list[str]:
    node, out = decorator.func if isinstance(decorator, ast.Call) else decorator, []
    while isinstance(node, ast.Attribute):
        out.append(node.attr)
        node = node.value
    return [*out, node.id] if isinstance(node, ast.Name) else out


def value_key(value: object) -> str:
    """Equal for constants that Python holds equal: True, 1 and 1.0 are one."""
    if isinstance(value, complex) and value.imag == 0:
        value = value.real
    if isinstance(value, (bool, int, float)):
        return f"n:{int(value)}" if value == value and abs(value) != float("inf") and value == int(value) else f"n:{value!r}"
    return f"s:{value}" if isinstance(value, str) else repr(value)


class Module:
    """One parsed file; each method gives one column."""

    def __init__(self, tree: ast.Module, text: str, fields: dict[str, list[str]]):
        self.tree, self.text, self.fields = tree, text, fields
        self.nodes = list(ast.walk(tree))

    @functools.cached_property
    def lines(self) -> list[str]:
        return self.text.splitlines()

    @functools.cached_property
    def parent(self) -> dict[ast.AST, ast.AST]:
        return {child: node for node in self.nodes for child in ast.iter_child_nodes(node)}

    @functools.cached_property
    def defs(self) -> list[ast.AST]:
        return [n for n in self.nodes if isinstance(n, FUNCTION)]

    @functools.cached_property
    def margin(self) -> list[ast.AST]:
        return [n for n in self.nodes if getattr(n, "col_offset", 0) == 0]

    def above(self, node: ast.AST) -> Iterator[ast.AST]:
        while (node := self.parent.get(node)) is not None:
            yield node

    def noqa(self, first: int, last: int) -> bool:
        return any("noqa" in line for line in self.lines[max(first - 1, 0) : last])

    def imported(self) -> Iterator[tuple[str, str | None, str]]:
        """(first part of the module, member or None for the module itself, name it is known by) of imports at the margin."""
        for node in self.margin:
            if isinstance(node, (ast.ImportFrom, ast.Import)):
                whole = isinstance(node, ast.Import)
                for a in node.names:
                    root = (a.name if whole else node.module or "").partition(".")[0]
                    yield root, None if whole else a.name, a.asname or (root if whole else a.name)

    @functools.cached_property
    def markers(self) -> tuple[dict[str, str], dict[str, str]]:
        """Names of marker classes and of their modules, as this file knows them."""
        names, modules = {}, {}
        for root, member, known_as in self.imported():
            have = MARKERS.get(root, set())
            if have and member is None:
                modules[known_as] = root
            names |= {k: k for k in have} if member == "*" else {known_as: member} if member in have else {}
        return names, modules

    def marker(self, base: ast.AST) -> str | None:
        if isinstance(base, ast.Subscript):
            base = base.value
        names, modules = self.markers
        if name := name_of(base):
            return name if name == "object" else names.get(name)
        module = modules.get(name_of(base.value)) if attr_of(base) else None
        return base.attr if attr_of(base) in MARKERS.get(module, ()) else None

    def based(self, node: ast.ClassDef) -> bool:
        return any(self.marker(b) is None for b in node.bases)

    def declares(self, node: ast.AST | None) -> bool:
        return isinstance(node, ast.ClassDef) and any(self.marker(b) in ("ABC", "ABCMeta", "Protocol") for b in node.bases)

    def _find_owned(self) -> None:
        """Runs before ``owned`` is asked of a default."""
        self.annotated, self.annotated_in, self.owners, self.owners_in, self.owned_alias = set(), set(), set(), set(), set()
        for root, member, known_as in self.imported():
            hints, framework = root in ("typing", "typing_extensions"), root == "fastapi"
            if member is None:
                (self.annotated_in if hints else self.owners_in if framework else set()).add(known_as)
            elif hints and member in ("Annotated", "*"):
                self.annotated.add("Annotated" if member == "*" else known_as)
            elif framework:
                self.owners |= OWNS_DEFAULT if member == "*" else {known_as} if member in OWNS_DEFAULT else set()
        for node in self.margin:
            if isinstance(node, (ast.Assign, ast.AnnAssign)) and self.owned(node.value):
                self.owned_alias |= set(map(name_of, node.targets if isinstance(node, ast.Assign) else [node.target])) - {None}

    def owned(self, hint: ast.AST | None) -> bool:
        """Whether an annotation hands the default over to a framework."""
        if not isinstance(hint, ast.Subscript):
            return name_of(hint) in self.owned_alias
        of = hint.value
        if name_of(of) not in self.annotated and not (attr_of(of) == "Annotated" and name_of(of.value) in self.annotated_in):
            return False
        rest = hint.slice.elts[1:] if isinstance(hint.slice, ast.Tuple) else []
        called = [n.func for part in rest for n in ast.walk(part) if isinstance(n, ast.Call)]
        return any(name_of(c) in self.owners or attr_of(c) in OWNS_DEFAULT and name_of(c.value) in self.owners_in for c in called)

    # == columns ==

    def functions(self) -> list[dict]:
        if "defaults" in self.fields["functions"]:
            self._find_owned()
        out = []
        for no, fn in enumerate(self.defs):
            made = self.one_function(no, fn)
            out.append({f: made[f]() for f in self.fields["functions"]})
        return out

    @functools.cached_property
    def inner(self) -> dict[ast.AST | None, int]:
        """Lines of the scopes that lie directly within a scope."""
        out: dict[ast.AST | None, int] = {}
        for node in self.nodes:
            if isinstance(node, SCOPE):
                home = next((p for p in self.above(node) if isinstance(p, SCOPE)), None)
                out[home] = out.get(home, 0) + max(0, node.end_lineno - node.lineno)
        return out

    def one_function(self, no: int, fn: ast.AST) -> dict[str, Callable[[], object]]:
        """How each field is made; only what is asked for is."""
        body = without_doc(fn.body)
        up = functools.cache(lambda: self.parent.get(fn))
        deepest = functools.cache(lambda: self.deepest(fn))
        long = functools.cache(lambda: [dotted(d) for d in fn.decorator_list])

        def grams() -> list[int]:
            if fn.name.startswith("__") and fn.name.endswith("__") or any(d.rpartition(".")[2] == "overload" for d in long()):
                return []
            first = min([fn.lineno, *(d.lineno for d in fn.decorator_list)])
            return shingles("".join(self.whole[first - 1 : fn.end_lineno]))

        return {
            "no": lambda: no, "name": lambda: fn.name, "line": lambda: fn.lineno, "end": lambda: fn.end_lineno, "decorators": lambda: [p for d in fn.decorator_list for p in parts_of(d)], "dotted": lambda: [d for d in long() if d],
            "class": lambda: up().name if isinstance(up(), ast.ClassDef) else None, "declares": lambda: self.declares(up()), "empty": lambda: does_nothing(body), "doc": lambda: ast.get_docstring(fn) or "", "n_stmts": lambda: sum(isinstance(n, ast.stmt) for n in ast.walk(fn)),
            "span": lambda: fn.end_lineno - (body[0].lineno if body else fn.lineno) + 1 - self.inner.get(fn, 0), "depth": lambda: deepest()[0], "depth_line": lambda: deepest()[1],
            "shape": lambda: function_shape(fn), "shingles": grams, "defaults": lambda: self.defaults(fn.args),
        }

    @functools.cached_property
    def whole(self) -> list[str]:
        return self.text.splitlines(keepends=True)

    def defaults(self, args: ast.arguments) -> list[dict]:
        spots = [*args.posonlyargs, *args.args]
        pairs = [*zip(spots[len(spots) - len(args.defaults) :], args.defaults, strict=True), *zip(args.kwonlyargs, args.kw_defaults, strict=True)]
        out = []
        for spot, value in pairs:
            if value is not None:
                made = isinstance(value, ast.Call) and name_of(value.func) in {"set", "list", "dict"}
                out.append({"line": value.lineno, "mutable": made or isinstance(value, (ast.Set, ast.List, ast.Dict)), "owned": self.owned(spot.annotation), "noqa": self.noqa(value.lineno, value.lineno)})
        return out

    def deepest(self, fn: ast.AST) -> tuple[int, int]:
        """Blocks within blocks, and the line of the first that lies so deep; what is defined within does not count."""
        best, todo = (0, fn.lineno), [(fn, 0)]
        while todo:
            node, depth = todo.pop()
            below = []
            for child in ast.iter_child_nodes(node):
                chained = {type(node), type(child)} == {ast.If} and node.orelse == [child]
                below.append((child, depth + (isinstance(child, BLOCK) and not chained)))
            todo += reversed([b for b in below if not isinstance(b[0], (*SCOPE, ast.Lambda))])
            if depth > best[0]:
                best = (depth, getattr(node, "lineno", best[1]))
        return best

    def classes(self) -> list[dict]:
        out = []
        for node in (n for n in self.nodes if isinstance(n, ast.ClassDef)):
            methods = [m.name for m in node.body if isinstance(m, FUNCTION)]
            notes = sum(isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) for s in node.body)
            out.append({"name": node.name, "line": node.lineno, "plain": not (node.bases or node.keywords or node.decorator_list), "other": len(node.body) - len(methods) - notes, "methods": methods})
        return out

    def tops(self) -> list[dict]:
        return [{"name": n.name, "line": n.lineno, "kind": "class" if isinstance(n, ast.ClassDef) else "function", "decorators": [] if isinstance(n, ast.ClassDef) else [p for d in n.decorator_list for p in parts_of(d)]} for n in self.tree.body if isinstance(n, SCOPE)]

    def methods(self) -> list[dict]:
        out = []
        for node in (n for n in self.nodes if isinstance(n, ast.ClassDef)):
            for m in (m for m in node.body if isinstance(m, FUNCTION)):
                body = without_doc(m.body)
                out.append({"class": node.name, "name": m.name, "line": m.lineno, "decorated": any(parts_of(d) for d in m.decorator_list), "stub": self.declares(node) and bool(body) and does_nothing(body), "based": self.based(node)})
        return out

    def attrs(self) -> list[dict]:
        """What methods store on self, with the first line of it, and whether anything reads it."""
        stored: dict[tuple, int] = {}
        read = set()
        for node in self.nodes:
            spot = node.target if isinstance(node, ast.AugAssign) else node
            if attr_of(spot) and name_of(spot.value) == "self":
                home = next((p for p in self.above(spot) if isinstance(p, ast.ClassDef)), None)
                if home is not None:
                    if isinstance(spot.ctx, ast.Store) and spot is node:
                        stored.setdefault((home, spot.attr), spot.lineno)
                    else:
                        read.add((home, spot.attr))
        return [{"name": key[1], "line": line, "read": key in read, "based": self.based(key[0])} for key, line in stored.items()]

    def dead(self) -> list[dict]:
        out = []
        for node in self.nodes:
            for stmts in (getattr(node, part, None) for part in ("body", "orelse", "finalbody")):
                if isinstance(stmts, list):
                    k = next((k for k, s in enumerate(stmts) if type(s) in ENDING), len(stmts))
                    out += [{"line": s.lineno, "after": ENDING[type(stmts[k])], "after_line": stmts[k].lineno} for s in stmts[k + 1 : k + 2]]
        return out

    def handlers(self) -> list[dict]:
        out = []
        for node in (n for n in self.nodes if isinstance(n, ast.ExceptHandler)):
            kinds = node.type.elts if isinstance(node.type, ast.Tuple) else [node.type] if node.type else []
            over, loop = self.parent[node], None
            for up in self.above(over) if isinstance(over, ast.Try) else ():
                if isinstance(up, (ast.While, ast.For, ast.AsyncFor, *FUNCTION)):
                    loop = None if isinstance(up, FUNCTION) else "while" if isinstance(up, ast.While) else "for"
                    break
            last = node.body[-1]
            out.append({"line": node.lineno, "typed": node.type is not None, "caught": [getattr(k, "attr", getattr(k, "id", "")) for k in kinds], "passes": only_passes(node.body), "reraises": isinstance(last, ast.Raise) and last.exc is None, "try_leaves": isinstance(over.body[-1], (ast.Continue, ast.Break, ast.Return)), "loop": loop})
        return out

    def imports(self) -> list[dict]:
        out = []
        for node in self.margin:
            if isinstance(node, ast.Import):
                names = [a.asname or a.name for a in node.names if not ("." in a.name and a.asname is None)]
            elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
                names = [a.asname or a.name for a in node.names if a.name != "*"]
            else:
                continue
            hushed = self.noqa(node.lineno, node.end_lineno)
            out += [{"name": n, "line": node.lineno, "noqa": hushed} for n in names]
        return out

    def exported(self) -> list[str]:
        out = []
        for node in self.tree.body:
            if isinstance(node, ast.Assign) and isinstance(node.value, (ast.Tuple, ast.List)) and "__all__" in map(name_of, node.targets):
                out += [t for t in map(text_of, node.value.elts) if t is not None]
        return out

    def logs(self) -> bool:
        modules = {a.name for n in self.nodes if isinstance(n, ast.Import) for a in n.names} | {n.module or "" for n in self.nodes if isinstance(n, ast.ImportFrom)}
        return any(m.partition(".")[0] in LOGGERS for m in modules)

    def dicts(self) -> list[dict]:
        out = []
        for node in self.nodes:
            if isinstance(node, ast.Dict) and len(node.keys) >= 4:
                keys = [{"key": k.value, "line": k.lineno} for k in node.keys if text_of(k) is not None]
                out.append({"line": node.lineno, "n": len(node.keys), "keys": keys})
        return out

    def harness(self) -> bool:
        return any(isinstance(n, ast.If) and isinstance(n.test, ast.Compare) and name_of(n.test.left) == "__name__" for n in self.tree.body)

    # == tests ==

    def tests(self) -> list[dict]:
        found, todo = [], [*self.tree.body]
        while todo:
            node = todo.pop(0)
            if isinstance(node, FUNCTION) and node.name.startswith("test"):
                found.append(node)
            elif isinstance(node, ast.ClassDef):
                todo[:0] = node.body
        asserting = {f.name for f in self.defs if not f.name.startswith("test") and any(isinstance(n, ast.Assert) for n in ast.walk(f))}
        modules, calls = set(), set()
        for node in self.nodes:
            if isinstance(node, ast.Import):
                modules |= {a.asname or a.name for a in node.names if a.name in SLEEPERS}
            elif isinstance(node, ast.ImportFrom) and node.module in SLEEPERS:
                calls |= {a.asname or a.name for a in node.names if a.name == "sleep"}
        return [self.one_test(fn, asserting, modules, calls) for fn in found]

    def one_test(self, fn: ast.AST, asserting: set[str], modules: set[str], calls: set[str]) -> dict:
        own = list(ast.walk(fn))
        asserts, same, sides, planted, pokes = [], [], [], {}, {}
        mocks = sum(any("patch" in p for p in parts_of(d)) for d in fn.decorator_list)
        for node in own:
            if isinstance(node, ast.Assign) and constant_of(node.value) is not node.value and "return_value" in map(attr_of, node.targets):
                planted.setdefault(value_key(node.value.value), node.lineno)
            if (attr_of(node) or "").startswith("_") and isinstance(node.ctx, ast.Load):
                pokes.setdefault((node.attr, name_of(node.value) == "self"), node.lineno)
            form = None
            if isinstance(node, ast.Assert):
                asserts.append((node, "plain"))
                form = self._vacuous(node.test)
                if isinstance(node.test, ast.Compare) and [type(o) for o in node.test.ops] == [ast.Eq]:
                    sides += [(node.lineno, node.test.left), (node.lineno, node.test.comparators[0])]
            elif isinstance(node, ast.Call):
                called = node.func
                name = attr_of(called) or name_of(called) or ""
                mocks += name in ("Mock", "AsyncMock", "MagicMock", "patch")
                for word in node.keywords:
                    if word.arg == "return_value" and constant_of(word.value) is not word.value:
                        planted.setdefault(value_key(word.value.value), node.lineno)
                if isinstance(called, ast.Attribute):
                    kind = "mock" if name.startswith(MOCK_CALLS) else "raises" if name in RAISES else "plain" if name.startswith("assert") or name == "fail" else None
                    if name in ("assertIs", "assertEqual") and len(node.args) > 1 and ast.dump(node.args[0]) == ast.dump(node.args[1]):
                        form = "same"
                    elif name == "assertTrue" and constant_of(first := next(iter(node.args), None)) is not first:
                        form = self._vacuous(node.args[0])
                    if name in ("assertListEqual", "assertDictEqual", "assertEqual"):
                        sides += [(node.lineno, a) for a in node.args[:2]]
                else:
                    kind = "helper" if name and (name in asserting or HELPERS.search(name.lower())) else None
                asserts += [(node, kind)] if kind else []
            same += [{"line": node.lineno, "form": form}] if form else []
        made = {
            "name": lambda: fn.name, "line": lambda: fn.lineno, "n_body": lambda: len(fn.body), "parametrized": lambda: "parametrize" in " ".join(map(ast.dump, fn.decorator_list)), "empty": lambda: does_nothing(without_doc(fn.body)), "shape": lambda: unit_shape(fn), "mocks": lambda: mocks,
            "asserts": lambda: [{"line": n.lineno, "kind": k, "under_if": k != "helper" and self._under_if(n, fn)} for n, k in asserts], "same": lambda: same, "sides": lambda: [self._side(*s) for s in sides],
            "planted": lambda: [{"value": v, "line": at} for v, at in planted.items()], "pokes": lambda: [{"name": n, "line": at, "own": o} for (n, o), at in pokes.items()], "sleeps": lambda: self._sleeps(fn, own, modules, calls),
        }
        return {f: made[f]() for f in self.fields["tests"]}

    @staticmethod
    def _vacuous(test: ast.AST) -> str | None:
        if isinstance(test, ast.Constant):
            return "constant" if test.value else None
        if isinstance(test, ast.Compare) and [type(o) for o in test.ops] == [ast.Eq]:
            return "same" if ast.dump(test.left) == ast.dump(test.comparators[0]) else None
        return None

    @staticmethod
    def _side(line: int, node: ast.AST) -> dict:
        if isinstance(node, ast.Constant):
            text = isinstance(node.value, str)
            return {"line": line, "kind": "str" if text else "const", "n": len(node.value) if text else 0, "value": value_key(node.value)}
        kind = "dict" if isinstance(node, ast.Dict) else "list" if isinstance(node, (ast.List, ast.Tuple)) else "other"
        return {"line": line, "kind": kind, "n": len(node.keys if kind == "dict" else node.elts) if kind != "other" else 0, "value": None}

    @staticmethod
    def _checks(stmts: list[ast.stmt]) -> bool:
        for node in (n for s in stmts for n in ast.walk(s)):
            name = attr_of(node.func) or "" if isinstance(node, ast.Call) else ""
            if isinstance(node, ast.Assert) or name in RAISES or name.startswith("assert"):
                return True
        return False

    def _under_if(self, node: ast.AST, fn: ast.AST) -> bool:
        for up in self.above(node):
            if up is fn:
                return False
            if isinstance(up, ast.If) and not (up.orelse and self._checks(up.body) and self._checks(up.orelse)):
                return True
        return False

    @staticmethod
    def _sleeps(fn: ast.AST, own: list[ast.AST], modules: set[str], calls: set[str]) -> list[dict]:
        hidden = parameters(fn.args) | names_with(own, ast.Store)
        given = [n for c in own if isinstance(c, ast.Call) for v in (*c.args, *(k.value for k in c.keywords)) for n in ast.walk(v)]
        handed = names_with(given, ast.Load)
        lambdas = {n for n in given if isinstance(n, ast.Lambda)}
        inside = {n for f in own if f is not fn and (f in lambdas or isinstance(f, FUNCTION) and f.name in handed) for n in ast.walk(f)}
        out = []
        for node in (n for n in own if isinstance(n, ast.Call)):
            module = name_of(node.func.value) if attr_of(node.func) == "sleep" else None
            word = module if module in modules else name_of(node.func) if name_of(node.func) in calls else None
            if word:
                zero = any(constant_of(first) is not first and not first.value for first in node.args[:1])
                out.append({"line": node.lineno, "zero": zero, "shadowed": word in hidden, "injected": node in inside})
        return out


def comments_of(text: str) -> list[tuple[int, int, str]] | None:
    """(line, column, comment) of each; None if the text has no tokens."""
    try:
        return [(*t.start, t.string) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
    except (SyntaxError, tokenize.TokenError):
        return None


def read_comments(text: str) -> tuple[list[dict], list[dict]]:
    """Comments with the code they stand by, and the marks that hush findings."""
    found, lines = comments_of(text), text.splitlines()
    if found is None:
        return [], [{"line": k, "rules": ignored_rules(line)} for k, line in enumerate(lines, 1) if MARK in line]
    after: list[str | None] = [None] * (len(lines) + 1)  # the next line of code at or after each line
    for k in range(len(lines) - 1, -1, -1):
        own = lines[k].strip()
        after[k] = own if own and not own.startswith("#") else after[k + 1]
    out = []
    for line, column, comment in found:
        beside = lines[line - 1][:column].strip() if line <= len(lines) else ""
        out.append({"line": line, "text": comment.lstrip("#").strip(), "code": beside or (after[line] if line < len(after) else None)})
    return out, [{"line": line, "rules": ignored_rules(c)} for line, _, c in found if MARK in c]


def schema_of(*wanted: str) -> StructType:
    """The schema of ``parsed``: all facts, or the path and the columns that are named, of a list's structs only the fields named as column.field."""
    whole = StructType.fromDDL(DDL)
    if not wanted:
        return whole
    within = {column: {w.partition(".")[2] for w in wanted if w.partition(".")[0] == column} for column in {w.partition(".")[0] for w in wanted}}
    out = StructType([whole["path"]])
    for column in whole.fields:
        if names := within.pop(column.name, None):
            fields = [] if "" in names else [f for f in column.dataType.elementType.fields if f.name in names]
            out.add(StructField(column.name, ArrayType(StructType(fields))) if fields else column)
    if within:
        raise ValueError(f"no such facts: {', '.join(sorted(within))}")
    return out


def fields_of(schema: StructType) -> dict[str, list[str]]:
    """The columns, each with the fields of its structs."""
    return {c.name: c.dataType.elementType.names if isinstance(c.dataType, ArrayType) and isinstance(c.dataType.elementType, StructType) else [] for c in schema.fields}


def facts(text: str, fields: dict[str, list[str]]) -> dict:
    """What ``fields`` asks for of one file. A file that is no Python has an error; one too deep or with null bytes has neither error nor facts."""
    row: dict = {"error": None}
    marks = "comments" in fields or "ignores" in fields
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except SyntaxError as e:
        row["error"] = {"line": e.lineno or 1, "text": e.msg}
        row["ignores"] = read_comments(text)[1] if marks else None
        return row
    except (ValueError, RecursionError, MemoryError):
        row["ignores"] = read_comments(text)[1] if marks else None
        return row
    try:
        m = Module(tree, text, fields)
        for column in ("harness", "logs", "exported", "functions", "classes", "tops", "methods", "attrs", "dead", "handlers", "imports", "dicts", "tests"):
            if column in fields:
                row[column] = getattr(m, column)()
        if "names" in fields:
            row["names"] = sorted(names_with(m.nodes, object))
        if "loads" in fields:
            row["loads"] = sorted(names_with(m.nodes, ast.Load))
        if "attributes" in fields:
            row["attributes"] = sorted({a for a in map(attr_of, m.nodes) if a})
        if "prints" in fields:
            row["prints"] = [n.lineno for n in m.nodes if isinstance(n, ast.Call) and name_of(n.func) == "print"]
    except RecursionError:
        row = {"error": None}
    if marks:
        row["comments"], row["ignores"] = read_comments(text)
    return row


def storable(value: object) -> object:
    """Literals may hold half characters that no UTF-8 column takes; they are written as escapes."""
    if isinstance(value, str):
        return value.encode("utf-8", "backslashreplace").decode()
    if isinstance(value, list):
        return [storable(v) for v in value]
    return {k: storable(v) for k, v in value.items()} if isinstance(value, dict) else value


def runs(texts: list[str]) -> Iterator[slice]:
    """Runs of ROWS texts and CHARS characters at most, but one text at least."""
    first = n = 0
    for k, t in enumerate(texts):
        if k > first and (k - first == ROWS or n + len(t) > CHARS):
            yield slice(first, k)
            first, n = k, 0
        n += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def parsed(files: DataFrame, *wanted: str) -> DataFrame:
    """One row of facts for each Python file of (path, text). A null text counts as an empty file; nothing is shuffled.

    All facts, or those that are ``wanted`` (see ``schema_of``): the others are not computed. Files with
    one text, such as empty or copied ones, are read once where they come near each other.
    """
    kind = schema_of(*wanted)
    schema, fields = to_arrow_schema(kind), fields_of(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(KEPT)(lambda text: facts(text, fields))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in runs(texts):
                place = {t: k for k, t in enumerate(dict.fromkeys(texts[part]))}
                rows = [known(t) if len(t) <= SHORT else facts(t, fields) for t in place]
                try:
                    table = pa.Table.from_pylist(rows, schema=schema)
                except UnicodeEncodeError:
                    table = pa.Table.from_pylist([storable(r) for r in rows], schema=schema)
                if len(place) < part.stop - part.start:
                    table = table.take(pa.array([place[t] for t in texts[part]], pa.int64()))
                paths = batch.column("path").slice(part.start, part.stop - part.start).cast(schema.field("path").type)
                yield from table.set_column(0, schema.field("path"), paths).combine_chunks().to_batches()

    return files.where("path like '%.py' or lower(path) like '%.py'").select("path", "text").mapInArrow(run, kind)
