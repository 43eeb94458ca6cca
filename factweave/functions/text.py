"""Text normalisation as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space (what Python's str.strip removes).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def stripped(c: Column) -> Column:
    """c without surrounding Unicode white space; NULL stays NULL."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def key(c: Column) -> Column:
    """A comparison key: stripped and lower-cased, NULL when NULL or blank."""
    return F.nullif(F.lower(stripped(c)), F.lit(""))


def words(c: Column) -> Column:
    """Lower-cased runs of Unicode letters and digits; [] for NULL."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(runs, F.lower)


def without_format_characters(c: Column) -> Column:
    """c without characters of category Cf."""
    return F.regexp_replace(c, r"\p{Cf}+", "")


def provenance_name(text: Column, prefix: str, explicit: Column) -> Column:
    """The function named by a provenance text: what follows `prefix` and one of '.:/', else, for explicit provenance, what follows
    'handle_' or the last dotted name before a parenthesis, else the text before one. Names of NVRAM access and of receiving are
    one name each. NULL and blank give ''.
    """
    low = F.lower(stripped(F.coalesce(text, F.lit(""))))
    after = F.regexp_extract(low, prefix + r"[.:/]([a-z0-9_]+)", 1)
    handler = F.regexp_extract(low, r"handle_([a-z0-9_]+)", 1)
    before = F.split(low, r"\(", 2)[0]
    dotted = F.when(handler != "", handler).otherwise(F.substring_index(before, ".", -1))
    name = F.when(after != "", after).when(explicit, dotted).otherwise(before)
    return F.when(name.contains("nvram"), "nvram").when(name.contains("recv"), "recv").otherwise(name)


def seconds(c: Column) -> Column:
    """A duration as seconds: '90', '90s', '5m', '2h', '[h:]m:s[.f]'; NULL for anything else."""
    t = F.lower(stripped(c))
    unit = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*(s|sec|m|min|h)?$", 2)
    amount = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*(?:s|sec|m|min|h)?$", 1)
    clock = t.rlike(r"^(\d+:)?\d{1,2}:\d{1,2}(\.\d+)?$")
    parts = F.reverse(F.split(t, ":"))
    total = F.get(parts, F.lit(0)).try_cast("double") + F.get(parts, F.lit(1)).try_cast("double") * 60 + F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0)) * 3600
    factor = F.when(unit.startswith("m"), 60).when(unit == "h", 3600).otherwise(1)
    return F.when(clock, total).when(amount != "", amount.try_cast("double") * factor)


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and no blanks; NULL for what is no JSON."""
    return F.to_json(F.try_parse_json(c))
