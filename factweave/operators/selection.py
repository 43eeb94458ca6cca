"""Projections and predicates of the fact tables (P1-P6, P9, P13), and the set rules U4 and U8."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.ids import known
from factweave.operators.agg import keep_first
from factweave.operators.rejects import admit

#: Marks of edges that a strict search rejects, and roles whose constants aren't a risk.
STRICT_MARKS = ("HEURISTIC", "LEGACY", "SYMBOL_ONLY", "NAME_ONLY", "UNRESOLVED")
EDGE_TEXTS = ("edge_kind", "resolution", "recognition", "analysis_precision", "evidence_level", "decision", "reason", "origin")


def op_accesses(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reads, writes and calls of operations: (keys, site, kind, address, value, callee).

    ops: keys, site, mnemonic, inputs array<string> in order, output, callee. A LOAD's address is its last
    input, its value the output; a STORE's address the one before the last, its value the last.
    """
    m, n = F.col("mnemonic"), F.size("inputs")
    kind = F.when(m == "LOAD", "READ").when(m == "STORE", "WRITE").when(m.isin("CALL", "CALLIND"), m)
    address = F.when((m == "LOAD") & (n >= 1), F.element_at("inputs", -1)).when((m == "STORE") & (n >= 2), F.element_at("inputs", -2))
    value = F.when(m == "LOAD", F.col("output")).when((m == "STORE") & (n >= 1), F.element_at("inputs", -1))
    return ops.select(*keys, "site", kind.alias("kind"), address.alias("address"), value.alias("value"), F.when(m.isin("CALL", "CALLIND"), F.col("callee")).alias("callee")).filter("kind IS NOT NULL")


def contract(df: DataFrame, rules: list[tuple[str, Column]], keys: Sequence[str], order: Sequence[Column | str]) -> tuple[DataFrame, DataFrame]:
    """(admitted rows, one per composite key; rejects with one row per reason)."""
    good, bad = admit(df, rules)
    return keep_first(good, keys, order), bad


def normalise_edges(df: DataFrame, wanted: Sequence[str], spare: dict[str, Sequence[str]]) -> DataFrame:
    """Wanted columns filled from their spare ones; an edge that still lacks one isn't traversable and says which."""
    filled = df
    for c in wanted:
        filled = filled.withColumn(c, F.coalesce(known(c), *(known(s) for s in spare.get(c, ()))))
    lacks = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(f"{c}_missing")) for c in wanted)))
    return filled.withColumn("blockers", lacks).withColumn("traversable", F.size("blockers") == 0)


def strict_reject(columns: Sequence[Column | str], flags: Sequence[Column] = (), marks: Sequence[str] = STRICT_MARKS) -> Column:
    """P5: whether a strict search rejects an edge: a flag is set, or a mark occurs in its texts."""
    marked = F.upper(F.concat_ws(" ", *columns)).rlike("|".join(marks))
    for f in flags:
        marked = marked | F.coalesce(f, F.lit(False))
    return marked


def risky_roles(parameters: Column) -> Column:
    """The parameters (role, constant) that aren't constant; siblings of constant ones are kept."""
    return F.filter(parameters, lambda p: ~F.coalesce(p["constant"], F.lit(False)))


def ablated(df: DataFrame, family: Column, without: Sequence[str]) -> DataFrame:
    """Df without the rows of some rule families; rows of no family stay."""
    return df.filter(family.isNull() | ~family.isin(*without)) if without else df


def access_compatible(declared: Column, default: Column, observed: Column) -> Column:
    """Whether the declared accesses, or the role's default where none is declared, meet the observed ones."""
    given = F.when(F.size(F.coalesce(declared, F.array().cast("array<string>"))) > 0, declared).otherwise(default)
    return F.coalesce(F.arrays_overlap(given, observed), F.lit(False))


def outermost(df: DataFrame, keys: Sequence[str], site: str, depth: str, proof: str) -> DataFrame:
    """U4: per key the deepest row, ties by site; rows whose site occurs in the tail of another row's proof are dropped.

    proof is an array of sites from the outermost in; its tail is all but the first.
    """
    tail = F.slice(proof, 2, F.greatest(F.size(proof) - 1, F.lit(0)))
    nested = df.select(*keys, F.explode(tail).alias(site)).distinct()
    kept = df.join(nested, [*keys, site], "left_anti")
    return keep_first(kept, keys, [F.desc(depth), F.asc(site)])


def partition_faults(items: DataFrame, groups: DataFrame, item: str, group: str) -> DataFrame:
    """U8: items that aren't in exactly one group, and grouped items that aren't items: (item, reason)."""
    g = groups.filter(F.col(item).isNotNull()).groupBy(item).agg(F.count_distinct(group).alias("n"))
    i = items.filter(F.col(item).isNotNull()).select(item).distinct().withColumn("__item", F.lit(True))
    reason = F.when(F.col("__item").isNull(), "not_an_item").when(F.col("n").isNull(), "in_no_group").when(F.col("n") > 1, "in_several_groups")
    return i.join(g, item, "full_outer").select(item, reason.alias("reason")).filter("reason IS NOT NULL")


#: Fixed value: a C string literal, or several in a row.
LITERAL = r'^"(?:[^"\\]|\\.)*"(?:\s*"(?:[^"\\]|\\.)*")*$'


def format_exclusion(required: Column, known: Column, expression: Column, readonly: Column) -> Column:
    """Why a sink that needs a format that isn't literal is excluded; NULL if it isn't.

    required: whether the rule asks for it; known: whether the format's node is known; readonly: whether it lies in initialised read-only memory.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    why = F.when(~yes(known), "missing_format_parameter").when(yes(expression.rlike(LITERAL)), "literal_format").when(yes(readonly), "readonly_format_object")
    return F.when(yes(required), why)


def audit_partition(rows: DataFrame, specs: DataFrame, method: str) -> DataFrame:
    """Rows with audit_only, true for those of rules (specs: id, audit_only) that are for audits only or that say so themselves."""
    only = specs.filter("audit_only AND id <> ''").select(F.col("id").alias(method)).distinct().withColumn("__only", F.lit(True))
    own = F.coalesce(F.col("audit_only"), F.lit(False)) if "audit_only" in rows.columns else F.lit(False)
    return rows.join(only, method, "left").withColumn("audit_only", F.coalesce("__only", F.lit(False)) | own).drop("__only")


#: What marks an edge as none that strict analysis admits.
HEURISTIC_MARKS = ("HEURISTIC", "LEGACY", "FALLBACK", "CLUSTER", "MAY_ALIAS", "APPROX")


def heuristic_edge(texts: Sequence[Column], deterministic: Column, admissible: Column) -> Column:
    """P5: whether strict analysis rejects an edge: it says it is not deterministic or not admissible, or a text of it or its object bears a mark."""
    joined = F.upper(F.concat_ws(" ", *texts))
    marked = F.exists(F.array(*(F.lit(m) for m in HEURISTIC_MARKS)), lambda m: joined.contains(m))
    says = ~F.coalesce(deterministic, F.lit(True)) | ~F.coalesce(admissible, F.lit(True))
    return says | marked


def shared_contract(candidates: DataFrame) -> DataFrame:
    """Shared-object candidates with all reasons against them, and whether they repeat one admitted: (candidate, reasons, admitted, duplicate).

    candidates: candidate, object_id, lineage (array), writers, readers (how many), writer_print, reader_print (order-free prints of their sites, so
    that no object's sites are gathered), transfer, storage_kind. Of admitted ones that agree in everything the least candidate stays.
    """
    lineage = F.array_sort(F.array_distinct(F.filter(F.coalesce("lineage", F.array().cast("array<string>")), lambda x: x != "")))
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reasons = F.array_compact(
        F.array(
            F.when(none("object_id"), "shared_object_identity_missing"), F.when(F.size("lineage") == 0, "shared_object_has_no_source_association"), F.when(F.coalesce("writers", F.lit(0)) == 0, "shared_object_has_no_writer"),
            F.when(F.coalesce("readers", F.lit(0)) == 0, "shared_object_has_no_reader"), F.when(~F.coalesce(F.col("transfer").isin("MEMORY_CONTENT", "OBJECT_REFERENCE"), F.lit(False)), "shared_object_transfer_semantics_unknown"),
            F.when(F.col("storage_kind") == "STACK_LOCAL", "source_derived_stack_local_not_shared"),
        )
    )
    told = candidates.withColumn("lineage", lineage).withColumn("reasons", reasons)
    same = ["object_id", "transfer", "lineage", "writers", "writer_print", "readers", "reader_print"]
    first = told.filter(F.size("reasons") == 0).groupBy(*same).agg(F.min("candidate").alias("first"))
    marked = told.join(first.select("first").withColumn("__first", F.lit(True)), F.col("candidate") == F.col("first"), "left")
    fine = F.size("reasons") == 0
    return marked.select("candidate", "reasons", (fine & F.col("__first").isNotNull()).alias("admitted"), (fine & F.col("__first").isNull()).alias("duplicate"))
