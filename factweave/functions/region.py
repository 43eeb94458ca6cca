"""The four meanings of overlap between byte regions; they differ and are never mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT, MAY, DISJOINT = "EXACT_OVERLAP", "MAY_OVERLAP", "DISJOINT"


def half_open(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether [s1, e1) and [s2, e2) share a byte."""
    return F.greatest(s1, s2) < F.least(e1, e2)


def search_overlap(s1: Column, e1: Column, s2: Column, e2: Column, relative1: Column, relative2: Column, base: Column) -> Column:
    """R1, of the backward search: ends are inclusive and unknown bounds overlap.

    If just one side is relative to the object, it is moved by the object's base; without one they overlap.
    """
    shift1 = F.when(relative1 & ~relative2, base).otherwise(0)
    shift2 = F.when(relative2 & ~relative1, base).otherwise(0)
    return F.coalesce(F.greatest(s1 + shift1, s2 + shift2) <= F.least(e1 + shift1, e2 + shift2), F.lit(True)) | s1.isNull() | e1.isNull() | s2.isNull() | e2.isNull()


def fixed(offset: Column, extent: Column, selectors: Column) -> Column:
    """Whether an access has one certain interval."""
    return F.coalesce((F.size(F.coalesce(selectors, F.array())) == 0) & (offset >= 0) & (extent > 0), F.lit(False))


def access_relation(o1: Column, x1: Column, sel1: Column, o2: Column, x2: Column, sel2: Column) -> Column:
    """R2, of two accesses to one aggregate object: half-open; unknown bounds are disjoint unless a side has selectors."""
    dynamic = (F.size(F.coalesce(sel1, F.array())) > 0) | (F.size(F.coalesce(sel2, F.array())) > 0)
    return (
        F.when(fixed(o1, x1, sel1) & fixed(o2, x2, sel2), F.when(half_open(o1, o1 + x1, o2, o2 + x2), EXACT).otherwise(DISJOINT))
        .when(dynamic, MAY).otherwise(DISJOINT)
    )


def read_relation(offset: Column, extent: Column, o2: Column, x2: Column, sel2: Column) -> Column:
    """R3, of a source's region and a read: half-open; unknown bounds may overlap."""
    unknown = offset.isNull() | extent.isNull() | (extent <= 0) | (F.size(F.coalesce(sel2, F.array())) > 0) | o2.isNull() | x2.isNull()
    return F.when(unknown, MAY).when(half_open(offset, offset + extent, o2, o2 + x2), EXACT).otherwise(DISJOINT)


def shared_range(o1: Column, x1: Column, o2: Column, x2: Column) -> Column:
    """R4, of strict pairs: the intersection as (start, end), NULL when it is empty or a bound is unknown."""
    start, end = F.greatest(o1, o2), F.least(o1 + x1, o2 + x2)
    known = o1.isNotNull() & x1.isNotNull() & o2.isNotNull() & x2.isNotNull()
    return F.when(known & (start < end), F.struct(start.alias("start"), end.alias("end")))


def different_context(f1: Column, c1: Column, f2: Column, c2: Column) -> Column:
    """The relation of two accesses' execution contexts.

    SAME_FUNCTION admits no transfer; two single and unequal certain contexts are deterministic; all else
    is heuristic.
    """
    one = lambda c: F.size(F.coalesce(F.array_distinct(c), F.array())) == 1
    return F.when(f1 == f2, "SAME_FUNCTION").when(
        one(c1) & one(c2) & (F.array_distinct(c1) != F.array_distinct(c2)), "DISTINCT_DETERMINISTIC_CONTEXT"
    ).otherwise("DISTINCT_FUNCTION_HEURISTIC_CONTEXT")
