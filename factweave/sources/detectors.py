"""Text detectors over C bodies (P11, P12): hints to places that the fact rules then judge."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.sources.ctext import _scanner, closings, masked

_LOOP = re.compile(r"\b(for|while)\s*\(")
_ELEMENT = re.compile(r"(?<![\w.])(?:\w+\s*\[[^\]\n]*\]|\*\s*\([^\n;=]*\)|\*\s*\w+)\s*=(?!=)")
_UPDATE = re.compile(r"(\*\s*\([^;=\n]*?\)\s*\([^;=\n]*?\)|\w+(?:->|\.)\w+)\s*=\s*\1\s*[-+]")
_POINTER_CALL = re.compile(r"\(\s*\*+\s*(?:\(\s*code\s*\*+\s*\)\s*)?[\w(][^;{}\n]*?\)\s*\(")
_WALK = re.compile(r"\bwhile\s*\(\s*\*\s*\(?\s*(\w+)")
_BYTE_LOAD = re.compile(r"=\s*\*\s*\(\s*(?:byte|char|uint8_t|ushort|uint16_t)\s*\*\s*\)\s*\(\s*param_\d+\s*\+")


def hints(text: str) -> Iterator[tuple[str, int, str]]:
    """(rule, line from 1, code of the line) of every hint, in the order of lines and rules.

    LOOP_WRITE: an element is written inside a loop; UNBOUNDED_WALK: a loop runs while a pointer's content holds;
    FIELD_UPDATE: a field is set from itself; DISPATCH: a call through a pointer; PARSER_LOAD: a field is read
    at an offset of a parameter.
    """
    code = masked(text)
    parens, blocks = closings(code, "(", ")"), closings(code, "{", "}")
    found: set[tuple[int, str]] = set()
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_left(breaks, at) + 1
    for m in _LOOP.finditer(code):
        head = parens.get(m.end() - 1)
        if head is None:
            continue
        start = head + 1 + len(code[head + 1 :]) - len(code[head + 1 :].lstrip())
        end = blocks.get(start, code.find(";", start) + 1 or len(code))
        found |= {(line(w.start()), "LOOP_WRITE") for w in _ELEMENT.finditer(code, start, end)}
    for rule, pattern in (("FIELD_UPDATE", _UPDATE), ("DISPATCH", _POINTER_CALL), ("UNBOUNDED_WALK", _WALK), ("PARSER_LOAD", _BYTE_LOAD)):
        found |= {(line(m.start()), rule) for m in pattern.finditer(code)}
    lines = text.split("\n")
    for at, rule in sorted(found):
        yield rule, at, lines[at - 1].strip()


def scan_hints(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(row_id, hint_no, rule, line, code) of every body; NULL and empty ones have none."""
    schema = pa.schema([("row_id", pa.int64()), ("hint_no", pa.int32()), ("rule", pa.string()), ("line", pa.int32()), ("code", pa.string())])
    slim = df.select(F.col(id_col).cast("bigint"), F.col(body_col).cast("string"))
    return slim.mapInArrow(_scanner(hints, schema), "row_id bigint, hint_no int, rule string, line int, code string")
