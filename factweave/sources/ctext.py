"""Program text: functions, call sites, identifiers and headers out of C text.

Comments and literals are blanked with their length kept, so that offsets stay those of the text. Bodies are
independent and go through Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words before a parenthesis that are no callee, and names of no identifier.
CONTROL_WORDS = {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "goto"}

#: Bytes of a header's field types.
FIELD_BYTES = {"uint32_t": 4, "int32_t": 4, "uint16_t": 2, "int16_t": 2, "uint8_t": 1, "int8_t": 1, "RoReg": 4, "RwReg": 4, "WoReg": 4}

_HIDDEN = re.compile(r"""/\*.*?(?:\*/|\Z)|//[^\n]*|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)""", re.DOTALL)
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_HEAD = re.compile(r"\s*\{")
_NOT_BREAK = re.compile(r"[^\n]")
BATCH = 5_000


def masked(text: str) -> str:
    """text with comments and literals as blanks; line breaks and all offsets stay."""
    return _HIDDEN.sub(lambda m: _NOT_BREAK.sub(" ", m[0]), text)


def closings(code: str, opening: str, closing: str) -> dict[int, int]:
    """The place of the bracket that closes each opening one; unclosed ones are absent."""
    found, stack = {}, []
    for m in re.finditer(f"[{re.escape(opening + closing)}]", code):
        if m[0] == opening:
            stack.append(m.start())
        elif stack:
            found[stack.pop()] = m.start()
    return found


def arguments(text: str, code: str, start: int, end: int) -> list[str]:
    """The arguments between two parentheses, cut at commas outside any bracket or literal."""
    depth, last, out = 0, start, []
    for m in re.finditer(r"[(){}\[\],]", code[start:end]):
        at = start + m.start()
        if m[0] in "({[":
            depth += 1
        elif m[0] in ")}]":
            depth -= 1
        elif depth == 0:
            out.append(text[last:at].strip())
            last = at + 1
    tail = text[last:end].strip()
    return [*out, tail] if out or tail else []


def call_sites(text: str) -> Iterator[tuple[str, int, int, list[str]]]:
    """(callee, offset, line from 1, arguments) of each call in order.

    Unclosed calls, control words and a function's own head are none.
    """
    code = masked(text)
    ends = closings(code, "(", ")")
    blocks = sorted(closings(code, "{", "}").items())
    inside, block = -1, 0
    breaks, line, done = [m.start() for m in re.finditer("\n", text)], 1, 0
    for m in _CALL.finditer(code):
        opened = m.end() - 1
        if m[1] in CONTROL_WORDS or opened not in ends:
            continue
        while block < len(blocks) and blocks[block][0] < m.start():
            inside, block = max(inside, blocks[block][1]), block + 1
        if m.start() > inside and _HEAD.match(code, ends[opened] + 1):
            continue
        while done < len(breaks) and breaks[done] < m.start():
            done, line = done + 1, line + 1
        yield m[1], m.start(), line, arguments(text, code, opened + 1, ends[opened])


def functions(text: str) -> Iterator[tuple[str, list[str], int, int]]:
    """(name, parameters, first line, last line) of each function: a top-level block behind a parameter list."""
    code = masked(text)
    blocks = closings(code, "{", "}")
    parens = closings(code, "(", ")")
    at = 0
    while (opened := code.find("{", at)) >= 0:
        if opened not in blocks:
            return
        head = code[at:opened]
        close = head.rstrip().rfind(")")
        if close >= 0 and head.rstrip().endswith(")"):
            begin = next((o for o, c in parens.items() if c == at + close), None)
            name = re.search(r"([A-Za-z_]\w*)\s*$", code[at:begin]) if begin is not None else None
            if name and name[1] not in CONTROL_WORDS:
                sign = max(head.rfind(";", 0, name.start()), head.rfind("\n\n", 0, name.start())) + 1
                first = at + sign + len(head[sign:]) - len(head[sign:].lstrip())
                yield name[1], arguments(text, code, begin + 1, at + close), text.count("\n", 0, first) + 1, text.count("\n", 0, blocks[opened]) + 1
        at = blocks[opened] + 1


def _scanner(scan, schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in source:
            for row_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                for n, found in enumerate(scan(body.as_py() or "")):
                    rows.append((row_id, n, *found))
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def scan_calls(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(row_id, call_no, callee, at, line, arguments) of every call; NULL and empty bodies have none."""
    schema = pa.schema([("row_id", pa.int64()), ("call_no", pa.int32()), ("callee", pa.string()), ("at", pa.int64()), ("line", pa.int32()), ("arguments", pa.list_(pa.string()))])
    slim = df.select(F.col(id_col).cast("bigint"), F.col(body_col).cast("string"))
    return slim.mapInArrow(_scanner(call_sites, schema), "row_id bigint, call_no int, callee string, at bigint, line int, arguments array<string>")


def scan_functions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, function_no, name, parameters, first_line, last_line) of every function of a text."""
    schema = pa.schema([("row_id", pa.int64()), ("function_no", pa.int32()), ("name", pa.string()), ("parameters", pa.list_(pa.string())), ("first_line", pa.int32()), ("last_line", pa.int32())])
    slim = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return slim.mapInArrow(_scanner(functions, schema), "row_id bigint, function_no int, name string, parameters array<string>, first_line int, last_line int")


def identifiers(c: Column | str) -> Column:
    """P10: the distinct identifiers of an expression, sorted."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))))


def clean_expression(c: Column | str) -> Column:
    """An expression with each run of white space as one blank, and none at its ends."""
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " "))


def has_conversion(c: Column | str) -> Column:
    """Whether a format literal converts anything ('%%' does not)."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "%%", "").rlike(r"%[-+ #0]*(\d+|\*)?(\.(\d+|\*))?(hh|h|ll|l|z|t|j|L)?[diouxXeEfFgGaAcspn]")


def without_casts(c: Column | str) -> Column:
    """An expression without leading casts to a type."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^(\s*\(\s*(?:const\s+|unsigned\s+|signed\s+|struct\s+)*[A-Za-z_]\w*\s*\**\s*\)\s*)+(?=[\w(*&\"'])", "")


def header_fields(text: str) -> Iterator[tuple[str, str, int]]:
    """(type, field, byte offset) of the structs of a header.

    Offsets are taken from comments ('Offset: 0x..') where a struct has any, else added up from the types;
    reserved fields are counted but not reported.
    """
    for m in re.finditer(r"typedef\s+struct\s*\w*\s*\{(.*?)\}\s*(\w+)\s*;", text, re.DOTALL):
        said = list(re.finditer(r"(\w+)\s*(?:\[[^\]]*\])?\s*;[^\n]*?offset:\s*0x([0-9a-f]+)", m[1], re.IGNORECASE))
        if said:
            yield from ((m[2], s[1], int(s[2], 16)) for s in said)
            continue
        at = 0
        for f in re.finditer(r"(\w+)\s+(\w+)\s*(?:\[\s*(0x[0-9a-fA-F]+|\d+)[uUlL]*\s*\])?\s*;", masked(m[1])):
            size = FIELD_BYTES.get(f[1], 4)
            at += -at % size
            if not f[2].lower().startswith("reserved"):
                yield m[2], f[2], at
            at += size * (int(f[3], 0) if f[3] else 1)


def _header_rows(text: str) -> Iterator[tuple[str, str, str, int]]:
    yield from (("field", kind, name, at) for kind, name, at in header_fields(text))
    yield from (("base", kind, name, at) for name, kind, at in header_bases(text))


def scan_headers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, row_no, kind, type, name, value) of every header: a struct's fields with their offsets, instances with their addresses."""
    schema = pa.schema([("row_id", pa.int64()), ("row_no", pa.int32()), ("kind", pa.string()), ("type", pa.string()), ("name", pa.string()), ("value", pa.int64())])
    slim = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return slim.mapInArrow(_scanner(_header_rows, schema), "row_id bigint, row_no int, kind string, type string, name string, value bigint")


def header_bases(text: str) -> Iterator[tuple[str, str, int]]:
    """(instance, type, address) of a header's #defines, given directly or by a _BASE name (with an offset)."""
    plain: dict[str, str] = dict(re.findall(r"#define\s+(\w+)\s+(.+?)\s*(?:/\*|//|$)", text, re.MULTILINE))

    def value(expression: str, depth: int = 0) -> int | None:
        total = 0
        for part in re.sub(r"\(\s*uint32_t\s*\)|[()]", " ", expression).split("+"):
            part = part.strip()
            number = re.fullmatch(r"(0x[0-9a-fA-F]+|\d+)[uUlL]*", part)
            inner = int(number[1], 0) if number else value(plain[part], depth + 1) if part in plain and depth < 8 else None
            if inner is None:
                return None
            total += inner
        return total

    for name, body in plain.items():
        cast = re.fullmatch(r"\(\s*\(\s*(\w+)\s*\*\s*\)\s*(.+?)\s*\)", body)
        if cast and (address := value(cast[2])) is not None:
            yield name, cast[1], address
