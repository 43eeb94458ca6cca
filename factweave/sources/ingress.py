"""Where data enters, by rules over C text: each rule is a join of calls, functions or assignments with a registry.

The text is scanned once into three relations (functions and calls of `ctext`, assignments here); everything after is
declared. All rules give rows of one shape, so their union is the list of sources or candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.session import checkpoint
from factweave.sources.ctext import _scanner, functions, masked, scan_calls, scan_functions

#: Parts of names that are no ingress although they look like one, that name a device's data, and that name a buffer.
NO_INGRESS = ("init", "disable", "enable", "clock", "config_setup")
RECEIVE_TOKENS = ("recv", "receive", "read", "rx", "transceive")
BUFFER_TOKENS = ("buf", "data", "packet", "payload", "frame", "msg", "rx", "dst", "ptr")

_ASSIGN = re.compile(r"(?:^|(?<=[;{}]))[ \t]*([^=;{}\n]*?[\w\])])\s*(?<![=!<>+\-*/|&^%])=(?!=)\s*([^;\n]+);", re.MULTILINE)
_CAST = re.compile(r"\(\s*(?:const\s+|unsigned\s+|signed\s+|volatile\s+|struct\s+)*[A-Za-z_]\w*\s*\**\s*\)(?=\s*[\w(*&])")
_DECLARED = re.compile(r"^(?:[A-Za-z_]\w*[\s*]+)+(?=[A-Za-z_]\w*$)")
_NAME = re.compile(r"[A-Za-z_]\w*")
_CONTROL = re.compile(r"(?:else\s+)?(?:if|while|for|switch)\s*(?=\()|else\b\s*")
_STEP = re.compile(r"^\s*&?\s*([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:[+-]\s*[\w()]+\s*)*$")


def base_name(expression: str) -> str:
    """The variable that an expression's place hangs on: the first name outside its casts; '' if there is none."""
    m = _NAME.search(_CAST.sub("", expression))
    return m[0] if m else ""


def _own_part(left: str) -> str | None:
    """A left side without the head of a statement before it; None if the head isn't closed, as the '=' then lies in it."""
    while m := _CONTROL.match(left):
        at = m.end()
        if at < len(left) and left[at] == "(":
            depth = 0
            for at in range(at, len(left)):
                depth += (left[at] == "(") - (left[at] == ")")
                if not depth:
                    break
            if depth:
                return None
            at += 1
        left = left[at:].lstrip()
    return left


def assignment_rows(text: str) -> Iterator[tuple]:
    """(function_no, line, lhs, rhs, writes, base, parameter) of the assignments inside functions, in order.

    writes: whether memory is written (through a pointer, an element or a field); base: the variable the place hangs on, seen through
    plain copies of pointers; parameter: the place of that variable among the function's parameters, -1 if it is none.
    """
    code = masked(text)
    lines = [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]
    for number, (_, parameters, first, last) in enumerate(functions(text)):
        names = [found[-1] if (found := _NAME.findall(p)) else "" for p in parameters]
        alias: dict[str, str] = {}
        for m in _ASSIGN.finditer(code, lines[first - 1], lines[min(last, len(lines) - 1)]):
            left, right = text[m.start(1) : m.end(1)].strip(), text[m.start(2) : m.end(2)].strip()
            own = _own_part(left)
            if not own:
                continue
            left = own
            writes = left.startswith("*") or "[" in left or "->" in left
            if not writes:
                left = _DECLARED.sub("", left)
            base = base_name(left)
            root = alias.get(base, base)
            yield number, code.count("\n", 0, m.start(1)) + 1, left, right, writes, root, names.index(root) if root in names else -1
            if not writes and base == left:
                step = _STEP.match(_CAST.sub("", right))
                if step:
                    alias[base] = alias.get(step[1], step[1])
                else:
                    alias.pop(base, None)


def scan_assignments(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, assignment_no, function_no, line, lhs, rhs, writes, base, parameter) of every text; NULL and empty ones have none."""
    schema = pa.schema(
        [("row_id", pa.int64()), ("assignment_no", pa.int32()), ("function_no", pa.int32()), ("line", pa.int32()), ("lhs", pa.string()), ("rhs", pa.string()), ("writes", pa.bool_()), ("base", pa.string()), ("parameter", pa.int32())]
    )
    slim = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return slim.mapInArrow(_scanner(assignment_rows, schema), "row_id bigint, assignment_no int, function_no int, line int, lhs string, rhs string, writes boolean, base string, parameter int")


def register_class(c: Column, classes: Sequence[tuple[str, str]]) -> Column:
    """The class of the first (class, pattern) that an expression matches; NULL if none does."""
    return F.coalesce(*(F.when(c.rlike(p), F.lit(k)) for k, p in classes), F.lit(None).cast("string"))


def _any_token(c: Column, tokens: Sequence[str]) -> Column:
    return F.exists(F.array(*(F.lit(t) for t in tokens)), lambda t: F.lower(c).contains(t)) if tokens else F.lit(False)


def _row(df: DataFrame, rule: str, buffer: Column, site: Column, callee: Column | None = None, length: Column | None = None, label: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(rule).alias("rule"), "row_id", "function", "line", (none if callee is None else callee).alias("callee"), site.alias("site"), buffer.alias("buffer"), (none if length is None else length).alias("length"), (none if label is None else label).alias("label")
    )


class Text:
    """The relations of a table of texts that the rules join: functions, calls and assignments with their function.

    They are kept in checkpoints, as every rule reads some of them: a text is scanned once for each.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str):
        found = checkpoint(scan_functions(df, id_col, text_col))
        self.functions = found.select("row_id", "function_no", F.col("name").alias("function"), "parameters", F.col("first_line").alias("line"), "last_line")
        within = self.functions.select("row_id", "function", "parameters", F.col("line").alias("__first"), "last_line")
        calls = scan_calls(df, id_col, text_col)
        self.calls = checkpoint(calls.join(within, "row_id").filter("line BETWEEN __first AND last_line").drop("__first", "last_line").withColumn("site", F.concat("callee", F.lit("("), F.array_join("arguments", ", "), F.lit(")"))))
        self.assignments = checkpoint(scan_assignments(df, id_col, text_col).join(self.functions.select("row_id", "function_no", "function", "parameters"), ["row_id", "function_no"]))


def api_sources(text: Text, registry: DataFrame) -> DataFrame:
    """Calls that fill a buffer: registry (callee, buffer_arg, length_arg, label); a call without that argument is none."""
    met = text.calls.join(registry, "callee").withColumns({"buffer": F.get("arguments", F.col("buffer_arg")), "length": F.get("arguments", F.col("length_arg"))})
    return _row(met.filter("buffer_arg >= 0 AND buffer IS NOT NULL"), "direct_api_callsite", F.col("buffer"), F.col("site"), F.col("callee"), F.col("length"), F.col("label"))


def return_sources(text: Text, registry: DataFrame) -> DataFrame:
    """Calls whose result is data: registry (callee, label). The buffer is what the result is assigned to, else 'callee()'."""
    met = text.calls.join(registry, "callee")
    given = text.assignments.select("row_id", "line", F.col("lhs"), F.col("rhs"), F.col("base").alias("given"), "assignment_no")
    both = met.join(given, ["row_id", "line"], "left").withColumn("__fits", F.col("rhs").contains(F.concat("callee", F.lit("("))))
    first = F.min(F.when(F.col("__fits"), F.struct("assignment_no", "given", "lhs", "rhs")))
    one = both.groupBy("row_id", "call_no", "function", "line", "callee", "site", "label").agg(first.alias("a"))
    return _row(one, "source_return_api", F.coalesce("a.given", F.concat("callee", F.lit("()"))), F.coalesce(F.concat("a.lhs", F.lit(" = "), "a.rhs"), "site"), F.col("callee"), label=F.col("label"))


def framework_sources(text: Text, registry: DataFrame) -> DataFrame:
    """Functions that a framework hands data to: registry (function, buffer_param, label)."""
    met = text.functions.join(registry, "function").withColumn("buffer", F.get("parameters", F.col("buffer_param")))
    return _row(met.filter("buffer_param >= 0 AND buffer IS NOT NULL"), "framework_parameter_summary", F.col("buffer"), F.concat("function", F.lit("("), F.array_join("parameters", ", "), F.lit(")")), label=F.col("label"))


def register_sources(text: Text, classes: Sequence[tuple[str, str]]) -> DataFrame:
    """Assignments of a device's data register to memory: classes (class, pattern of the expression), of which 'DATA' counts."""
    found = text.assignments.withColumn("class", register_class(F.col("rhs"), classes)).filter("class = 'DATA' AND writes")
    return _row(found, "mmio_data_register_to_buffer", F.when(F.col("base") != "", F.col("base")).otherwise(F.col("lhs")), F.concat("lhs", F.lit(" = "), "rhs"), label=F.col("class"))


def body_summaries(text: Text, classes: Sequence[tuple[str, str]]) -> DataFrame:
    """(callee, parameter, line) of functions that write a device's data, or an unknown register, to a formal buffer."""
    found = text.assignments.withColumn("class", register_class(F.col("rhs"), classes)).filter("class IN ('DATA', 'UNKNOWN_MMIO') AND writes AND parameter >= 0")
    return found.groupBy(F.col("function").alias("callee"), "parameter").agg(F.min("line").alias("evidence_line"))


def body_derived_sources(text: Text, summaries: DataFrame) -> DataFrame:
    """Calls of summarised functions, with the actual that is filled; empty and null actuals are none."""
    met = text.calls.join(summaries, "callee").withColumn("buffer", F.get("arguments", F.col("parameter")))
    live = F.coalesce(~F.col("buffer").isin("", "0", "NULL", "(void *)0x0"), F.lit(False))
    return _row(met.filter(live), "body_derived_source_callsite", F.col("buffer"), F.col("site"), F.col("callee"))


def complex_bodies(text: Text, classes: Sequence[tuple[str, str]]) -> DataFrame:
    """Candidates: functions with a receive-like name that write an unknown device's value to a formal."""
    unknown = F.col("rhs").rlike(r"(?i)\*\s*\([^)]*\)\s*\([^)]*\+\s*(?:0x)?[0-9a-f]+\)") | F.col("rhs").rlike(r"\b_?DAT_[45][0-9A-Fa-f]{7}\b") | F.coalesce(register_class(F.col("rhs"), classes).isin("DATA", "UNKNOWN_MMIO"), F.lit(False))
    found = text.assignments.filter(_any_token(F.col("function"), RECEIVE_TOKENS) & F.col("writes") & (F.col("parameter") >= 0) & unknown)
    return _row(found, "complex_body_ingress_candidate", F.col("base"), F.concat("lhs", F.lit(" = "), "rhs"))


def argument_score(c: Column) -> Column:
    """How much an argument looks like a buffer: an address taken, a buffer's name, a pointer variable; literals score 0."""
    literal = c.rlike(r"^(?:0[xX][0-9a-fA-F]+|\d+|'.*'|\".*\")$")
    score = F.when(c.startswith("&"), 3).otherwise(0) + F.when(_any_token(c, BUFFER_TOKENS), 3).otherwise(0) + F.when(c.rlike(r"\b[pa]\w*(?:Var)?\d+\b|\blocal_\w+|\*\s*\)"), 1).otherwise(0)
    return F.when(literal | (c == ""), 0).otherwise(score)


def callsite_candidates(text: Text, tokens: Sequence[str]) -> DataFrame:
    """Candidates: calls whose names have a token of ingress, with the argument that looks most like a buffer (the last of equals).

    Names that set devices up, and 'input' functions, which are given a filled buffer, are none.
    """
    name = F.lower("callee")
    calls = text.calls.filter(_any_token(F.col("callee"), tokens) & ~_any_token(F.col("callee"), NO_INGRESS) & (name != "input") & ~name.endswith("_input"))
    scored = F.transform("arguments", lambda a, i: F.struct(argument_score(a).alias("score"), i.alias("n"), a.alias("argument")))
    best = F.array_max(F.filter(scored, lambda s: s["score"] >= 3))
    return _row(calls.withColumn("best", best).filter("best IS NOT NULL"), "semantic_callsite_candidate", F.col("best.argument"), F.col("site"), F.col("callee"))


def function_candidates(text: Text, tokens: Sequence[str]) -> DataFrame:
    """Candidates: functions with a token of ingress in their names that make a call with one; the buffer is the first parameter that looks like one."""
    calling = text.calls.filter(_any_token(F.col("callee"), tokens)).select("row_id", "function").distinct()
    f = text.functions.filter(_any_token(F.col("function"), tokens) & ~_any_token(F.col("function"), NO_INGRESS)).join(calling, ["row_id", "function"], "left_semi")
    buffer = F.get(F.filter("parameters", lambda p: _any_token(p, BUFFER_TOKENS) | p.contains("*")), F.lit(0))
    return _row(f, "semantic_ingress_candidate", F.coalesce(buffer, F.lit("")), F.concat("function", F.lit("("), F.array_join("parameters", ", "), F.lit(")")))
