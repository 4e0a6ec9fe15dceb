"""Message schemas as a relation: one row a message, with its fields as declared and in canonical form."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_MESSAGES = 400
Found = Iterator[tuple[str, set[str]]]

_OPENING, _CLOSING = "([{", ")]}"
_MASKED = re.compile(r"""(?://|\#)[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?P<text>(?P<q>\"\"\"|'''|"|')(?:\\[\s\S]?|(?!(?P=q))[^\\])*(?:(?P=q)|\Z))""")
_VISIBLE = re.compile("[^\n]")
#: Pieces of the heads and fields: the start of a line, a name, a name in small letters, what opens a block.
_AT, _NAME, _SMALL, _OPENS = r"^\s*", r"([A-Za-z_]\w*)", r"([a-z][a-z0-9_]*)", r"\s+(\w+)[^{]*\{"


def without_comments(text: str, texts: bool = True) -> str:
    """Comments as blanks, and quoted text too where ``texts``; offsets and line feeds stay."""
    return _MASKED.sub(lambda m: m.group() if m["text"] is not None and not texts else _VISIBLE.sub(" ", m.group()), text)


def closing(text: str, start: int) -> int | None:
    """The offset behind the brace that closes the one before ``start``."""
    depth = 1
    for m in re.compile("[{}]").finditer(text, start):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return None


def named_blocks(text: str, head: str, keep_texts: bool = False) -> Iterator[tuple[str, str]]:
    code = without_comments(text)
    body = without_comments(text, texts=False) if keep_texts else code
    for m in re.finditer(head, code, re.M):
        if end := closing(code, m.end()):
            yield m[1], body[m.end() : end - 1]


def hollow(text: str, head: str) -> str:
    """The text with the blocks that ``head`` opens as blanks."""
    whole = text
    for m in re.finditer(head, whole, re.M):
        if end := closing(whole, m.end()):
            text = text[: m.start()] + _VISIBLE.sub(" ", text[m.start() : end]) + text[end:]
    return text


def surface(text: str) -> str:
    """The text outside brackets; an outermost opening bracket stays."""
    out, depth = [], 0
    for sign in text:
        opens, closes = sign in _OPENING, sign in _CLOSING
        out.append(sign if sign == "\n" or not depth and not closes else " ")
        depth = depth + 1 if opens else max(0, depth - 1) if closes else depth
    return "".join(out)


def proto(name: str, text: str) -> Found:
    kinds = r"(?:(?:required|repeated|optional)\s+)?[.\w]+" + r"(?:\s*<[^>]*>)?"
    for message, body in named_blocks(text, _AT + "message" + r"\s+(\w+)\s*\{", True):
        own = hollow(body, _AT + "(?:enum|message)" + r"\s+\w+[^{]*\{")
        fields = re.findall(rf"{_AT}{kinds}\s+{_SMALL}\s*=\s*\d", own, re.M)
        yield f"{name} {message}", {*fields, *re.findall(r"\bjson_name\s*=\s*[\"']([A-Za-z]\w*)[\"']", own, re.A)}


def textproto(name: str, text: str) -> Found:
    yield name, set(re.findall(_AT + _SMALL + r"\s*[{:]", text, re.M))


def thrift(name: str, text: str) -> Found:
    field = _AT + r"\d+\s*:\s*" + r"(?:(?:optional|required)\s+)?" + r"[<>, .\w]+?\s+" + _NAME + r"\s*[,;=]?\s*$"
    for message, body in named_blocks(text, _AT + r"(?:exception|union|struct)\s+(\w+)\s*\{"):
        yield f"{name} {message}", set(re.findall(field, body, re.M))


def graphql(name: str, text: str) -> Found:
    for message, body in named_blocks(text, _AT + "(?:interface|input|type)" + _OPENS):
        yield f"{name} {message}", set(re.findall(_AT + _NAME + r"\s*[:(]", surface(body), re.M))


def _every(node: object, label: str) -> Iterator[tuple[object, str]]:
    """A JSON value and all within it, each with the key it stands under."""
    yield node, label
    for key, value in node.items() if isinstance(node, dict) else (("", v) for v in node) if isinstance(node, list) else ():
        yield from _every(value, key or label)


def avro(name: str, text: str) -> Found:
    for node, _ in _every(json.loads(text), ""):
        fields = node.get("fields") if isinstance(node, dict) and node.get("type") == "record" else None
        if isinstance(fields, list):
            named = (f.get("name") for f in fields if isinstance(f, dict))
            yield f"{name} {node.get('name', 'record')}", {n for n in named if isinstance(n, str)}


def json_schema(name: str, text: str) -> Found:
    for node, label in _every(json.loads(text), "schema"):
        if isinstance(node, dict) and isinstance(node.get("properties"), dict):
            yield f"{name} {label}", set(node["properties"])


def yaml_schema(name: str, text: str) -> Found:
    """By indentation: the keys one step in from each ``properties:``."""
    rows = [(len(x) - len(x.lstrip()), x.strip(), k) for k, x in enumerate(text.splitlines(), 1) if x.strip() and not x.lstrip().startswith("#")]
    for at, (indent, own, line) in enumerate(rows):
        if re.fullmatch(r"properties\s*:" + r"\s*(?:#.*)?", own):
            below = []
            for row in rows[at + 1 :]:
                if row[0] <= indent:
                    break
                below.append(row)
            forms = [r"([A-Za-z_][-\w]*)\s*:", r'"([^"]+)"\s*:', r"'([^']+)'\s*:"]
            keys = [re.match(form, r[1]) for r in below if r[0] == below[0][0] for form in forms]
            yield f"{name}:{line}", {m[1] for m in keys if m}


READERS = {".proto": proto, ".textproto": textproto, ".thrift": thrift, ".graphql": graphql, ".graphqls": graphql, ".gql": graphql, ".avsc": avro, ".json": json_schema, ".yaml": yaml_schema, ".yml": yaml_schema}


def declared(path: str, text: str) -> list[dict]:
    """Messages of one file in order. A file that does not parse has none."""
    read = READERS.get(os.path.splitext(path)[1].lower())
    try:
        found = [(label, sorted(f for f in fields if f)) for label, fields in read(os.path.basename(path), text)] if read else []
    except (ValueError, RecursionError):
        found = []
    return [{"path": path, "ord": k, "label": label, "fields": fields} for k, (label, fields) in enumerate((x for x in found if x[1]), 1)]


def messages(files: DataFrame, limit: int | None = MAX_MESSAGES) -> DataFrame:
    """msg_no, label, fields, canon of the schema files (path, text), the first ``limit`` by path and place.

    The limit is the feature's own; with None there is none. Nulls count as empty files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("ord", pa.int32()), ("label", pa.string()), ("fields", pa.list_(pa.string()))])
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                yield from pa.Table.from_pylist(declared(path, text or ""), schema=kind).to_batches()

    rows = files.select("path", "text").mapInArrow(run, "path string, ord int, label string, fields array<string>")
    rows = rows.withColumn("msg_no", F.row_number().over(Window.orderBy("path", "ord")))
    rows = rows.where(F.col("msg_no") <= limit) if limit else rows
    return rows.select("msg_no", "label", "fields", F.array_distinct(F.transform("fields", T.canonical_name)).alias("canon"))
