"""Evidence from runtime traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.ids import code_address
from factweave.operators.joins import last_before


def observed(event: Column) -> Column:
    """Whether any row of the group is such an event; False for an empty group."""
    return F.coalesce(F.bool_or(event), F.lit(False))


def blocks_covering(events: DataFrame, intervals: DataFrame, keys: Sequence[str], address: str, page_bits: int = 12) -> DataFrame:
    """Events with each half-open interval (start, end, name) of their keys that covers their address; none is left out.

    Intervals are put in their pages, so the join is an equi-join. An event in no interval has a NULL name.
    """
    size = 1 << page_bits
    paged = intervals.filter(F.col("start") < F.col("end")).select(*keys, "start", "end", "name", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("__page"))
    at = events.withColumn("__at", code_address(address)).withColumn("__page", F.floor(F.col("__at") / size))
    asked = at.select(*keys, "__at", "__page").distinct()
    hit = asked.join(paged, [*keys, "__page"]).filter("__at >= start AND __at < end").select(*keys, "__at", "name")
    return at.join(hit, [*keys, "__at"], "left").drop("__at", "__page")


def causal_reads(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reads with the last write to their address before them: keys, event_id, pc, address, write_id, write_pc.

    events: keys, event_id, line_no, mode, pc, address. Rows of one event id follow their line.
    """
    held = events.filter(F.col("mode").isin("r", "w") & F.col("address").isNotNull())
    seen = last_before(held, [*keys, "address"], ["event_id", "line_no"], F.col("mode") == "w", F.struct("event_id", "pc"), "w")
    return seen.filter("mode = 'r' AND w IS NOT NULL").select(*keys, "event_id", "line_no", "pc", "address", F.col("w.event_id").alias("write_id"), F.col("w.pc").alias("write_pc"))


def causal_fault(reads: DataFrame, faults: DataFrame, effects: DataFrame, keys: Sequence[str], distance: int = 8) -> DataFrame:
    """Per group the latest read within `distance` before the fault, in the fault's function, whose value an effect wrote.

    faults: keys, fault_pc, start, end; effects: keys, effect_start, effect_end.
    """
    pc, at = code_address("pc"), code_address("fault_pc")
    near = reads.join(faults, list(keys)).filter((pc >= F.col("start")) & (pc < F.col("end")) & (at - pc >= 0) & (at - pc <= distance))
    w = code_address("write_pc")
    bound = near.join(effects, list(keys)).filter((w >= F.col("effect_start")) & (w < F.col("effect_end")))
    return bound.groupBy(*keys).agg(F.max_by(F.struct("event_id", "pc", "address", "write_id", "write_pc"), F.struct("event_id", "line_no")).alias("b")).select(*keys, "b.*")


def nonreturning(events: DataFrame, keys: Sequence[str], entered: Column, returned: Column, overwritten: Column) -> DataFrame:
    """T4: (keys, entered_at, overwritten, returned): whether a block was entered first and never returned from, and what was written after.

    A group is bound if overwritten and not returned. One window over each trace in order.
    """
    w = Window.partitionBy(*keys).orderBy("event_id", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = events.withColumn("__in", F.coalesce(F.max(entered).over(w), F.lit(False)))
    g = inside.groupBy(*keys).agg(
        F.min(F.when(entered, F.col("event_id"))).alias("entered_at"), observed(F.col("__in") & overwritten).alias("overwritten"), observed(F.col("__in") & returned).alias("returned")
    )
    return g.withColumn("bound", F.col("entered_at").isNotNull() & F.col("overwritten") & ~F.col("returned"))


def first_pattern(c: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """T5: (kind, text) by the first pattern that matches, its first group as the text; NULL if none does."""
    return F.coalesce(*(F.when(c.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(c, p, 1).alias("text"))) for kind, p in patterns))


def replay_agreement(source: Column, sink: Column, signature: Column) -> Column:
    """POC if there are two runs or more, each with source, sink and the same known signature; else INCONCLUSIVE."""
    s = F.nullif(F.trim(signature), F.lit(""))
    whole = F.bool_and(F.coalesce(source & sink, F.lit(False)) & s.isNotNull())
    return F.when((F.count(F.lit(1)) >= 2) & whole & (F.min(s) == F.max(s)), "POC").otherwise("INCONCLUSIVE")


def all_observed(wanted: DataFrame, seen: DataFrame, keys: Sequence[str], on: Sequence[str]) -> DataFrame:
    """(keys, observed): whether everything wanted of a group was seen."""
    marks = wanted.join(seen.select(*on).distinct().withColumn("__seen", F.lit(True)), list(on), "left")
    return marks.groupBy(*keys).agg(F.bool_and(F.coalesce("__seen", F.lit(False))).alias("observed"))


#: What a run's log says of a fault.
INVALID_ACCESS = r"(?i)\[\s*(0x[0-9a-f]+)\s*\]\s+INVALID\s+(WRITE|READ|FETCH):\s+addr=\s*(0x[0-9a-f]+)"
EMULATOR_ERROR = r"\b(UC_ERR_[A-Z0-9_]+)\b"
CRASH_SIGNAL = r"(?i)\bEmulation crashed with signal\s+([0-9]+)\b"
CRASH = r"(?i)\bCRASH DETECTED\b"


def fault_signature(log: Column, code: Column) -> Column:
    """T5: what a run's log and exit code say of its fault: the last invalid access, else the last emulator error, else a signal, else a crash; NULL if none."""
    text = F.coalesce(log, F.lit(""))
    last = lambda found: F.try_element_at(found, F.lit(-1))
    every = lambda pattern, group: last(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    plain = lambda hexed: F.concat(F.lit("0x"), F.coalesce(F.nullif(F.regexp_replace(F.lower(F.substring(hexed, 3, 40)), "^0+", ""), F.lit("")), F.lit("0")))
    access = F.concat(F.lit("INVALID_"), F.upper(every(INVALID_ACCESS, 2)), F.lit(":pc="), plain(every(INVALID_ACCESS, 1)), F.lit(":addr="), plain(every(INVALID_ACCESS, 3)))
    errors = last(F.filter(F.regexp_extract_all(F.upper(text), F.lit(EMULATOR_ERROR), F.lit(1)), lambda e: e != "UC_ERR_OK"))
    signal = F.concat(F.lit("SIGNAL:"), every(CRASH_SIGNAL, 1).try_cast("bigint").cast("string"))
    exit_signal = F.when(code < 0, F.concat(F.lit("SIGNAL:"), (-code).cast("string"))).when(code.between(128, 192), F.concat(F.lit("SIGNAL:"), (code - 128).cast("string")))
    return F.coalesce(access, errors, signal, exit_signal, F.when(text.rlike(CRASH), "CRASH_DETECTED"))
