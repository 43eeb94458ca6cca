"""Schemas that drift between files (problem 2): one consistent table and every change.

A column lifespan catalogue is built from what each file says of its own fields (its footer, so to
speak): field and types per producer and version. A producer is a (campaign, artifact, section). lag and lead
over the catalogue give the islands of a field's life: where one starts, ends or changes type. A renaming is an
end and a start in the same version whose values agree row by row; only the cells of such candidates are ever
compared. The renamings are the alias table, from which the casts of the consistent table come.
The catalogue has a row per field and version, whatever the number of files, so a producer with a third
of all files is summed up map-side before anything meets, and payloads are never shuffled: what a file's rows
are to become travels to the file, by broadcast while it is few rows, else to blocks of the files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.json_text import dumps, loads
from factweave.operators.spread import bounded_broadcast, paired
from factweave.session import checkpoint

#: The sections of the payloads, and the types of fields in alphabetical order.
SECTIONS = ("source_sites", "confirmed_sources", "sink_startpoints", "confirmed_sink_calls")
TYPES = ("array", "boolean", "number", "object", "string")

_PRODUCER = ("campaign", "artifact", "section")
_FILE = ("campaign", "artifact", "version_no")
BATCH_ROWS = 20_000
#: Fields of a partition that are summed up before they are sent on, versions whose casts are broadcast, and
#: columns of the consistent table beyond which fields go to its map.
HELD, MOST_VERSIONS, MOST_COLUMNS = 50_000, 50_000, 2_000


def _kind(v: Any) -> str:
    if isinstance(v, str):
        return "string"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "array" if isinstance(v, list) else "object"


def _clean(s: str) -> str:
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _canonical(v: Any) -> str:
    """A text that is equal for equal JSON values: key order and 1 against 1.0 don't count."""
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    return dumps(v, sort_keys=True)


def _hash(v: Any) -> int:
    return int.from_bytes(hashlib.blake2b(_canonical(v).encode(), digest_size=8).digest(), "big", signed=True)


def _document(text: str | None) -> tuple[dict, str | None]:
    if not text:
        return {}, "NO_PAYLOAD"
    try:
        doc = loads(text)
    except ValueError:
        return {}, "UNREADABLE"
    return (doc, None) if isinstance(doc, dict) else ({}, "NOT_AN_OBJECT")


def _sections(text: str | None) -> dict[str, list[dict]] | None:
    """The rows of each section of a payload; None for one that isn't readable."""
    doc, reason = _document(text)
    if reason:
        return None
    return {s: [r for r in x if isinstance(r, dict)] if isinstance(x := doc.get(s), list) else [] for s in SECTIONS}


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Types (bits in the order of TYPES) of the fields of each version, summed up over the partition's files."""
    schema = pa.schema([("campaign", pa.string()), ("artifact", pa.string()), ("version_no", pa.int64()), ("section", pa.string()), ("field_name", pa.string()), ("types", pa.int32())])
    bit = {t: 1 << n for n, t in enumerate(TYPES)}

    def rows() -> Iterator[tuple]:
        held: dict[tuple, int] = {}
        for batch in batches:
            for campaign, artifact, version, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found = _sections(text)
                if found is None:
                    continue
                held[campaign, artifact, version, None, None] = 0
                for section, items in found.items():
                    for name, kind in {(k, _kind(v)) for r in items for k, v in r.items() if v is not None}:
                        at = campaign, artifact, version, section, _clean(name)
                        held[at] = held.get(at, 0) | bit[kind]
                if len(held) >= HELD:
                    yield from ((*at, types) for at, types in held.items())
                    held = {}
        yield from ((*at, types) for at, types in held.items())

    return _batches(rows(), schema)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed values of the wanted fields: (campaign, artifact, section, turn_no, change, field_name, row, value)."""
    schema = pa.schema([("campaign", pa.string()), ("artifact", pa.string()), ("section", pa.string()), ("turn_no", pa.int64()), ("change", pa.string()), ("field_name", pa.string()), ("row", pa.int64()), ("value", pa.int64())])

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for campaign, artifact, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found = _sections(text) or {}
                by_section: dict[str, dict[str, list]] = {}
                for w in wanted:
                    by_section.setdefault(w["section"], {}).setdefault(w["field_name"], []).append((w["turn_no"], w["change"]))
                for section, names in by_section.items():
                    for r in found.get(section, ()):
                        if r.get("id") is None:
                            continue
                        row = _hash(r["id"])
                        for k, v in r.items():
                            if v is not None and (turns := names.get(_clean(k))):
                                value = _hash(v)
                                for turn, change in turns:
                                    yield campaign, artifact, section, turn, change, _clean(k), row, value

    return _batches(rows(), schema)


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file_id", pa.int64()), ("reason", pa.string())])
    return _batches(((f, reason) for b in batches for f, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (reason := _document(text)[1])), schema)


def version_number(c: Column | str) -> Column:
    """The number at the end of a schema version; NULL where there is none."""
    return F.nullif(F.regexp_extract(c, r"(\d{1,18})\s*$", 1), F.lit("")).cast("bigint")


def _slim(files: DataFrame) -> DataFrame:
    return files.select("campaign", "artifact", version_number("schema_version").alias("version_no"), F.col("payload").cast("string").alias("payload")).filter(
        "version_no IS NOT NULL AND campaign IS NOT NULL AND artifact IS NOT NULL"
    )


def rejects(files: DataFrame) -> DataFrame:
    """(file_id, reason) of each file that is in neither the table nor the changes, by the first reason that holds.

    NO_CAMPAIGN, NO_ARTIFACT, NO_VERSION (no number at the end of schema_version), NO_PAYLOAD (NULL or empty),
    UNREADABLE (no JSON), NOT_AN_OBJECT. An empty table gives an empty result; other columns are not looked at.
    """
    given = files.select(F.col("file_id").cast("bigint").alias("file_id"), "campaign", "artifact", version_number("schema_version").alias("version_no"), F.col("payload").cast("string").alias("payload"))
    named = F.when(F.col("campaign").isNull(), "NO_CAMPAIGN").when(F.col("artifact").isNull(), "NO_ARTIFACT").when(F.col("version_no").isNull(), "NO_VERSION")
    told = given.withColumn("reason", named)
    return told.filter("reason IS NOT NULL").select("file_id", "reason").unionByName(told.filter("reason IS NULL").select("file_id", "payload").mapInArrow(_faults, "file_id bigint, reason string"))


def _placed(files: DataFrame) -> DataFrame:
    """The catalogue with a row without section for each version, so that versions without fields count."""
    shape = "campaign string, artifact string, version_no bigint, section string, field_name string, types int"
    seen = _slim(files).mapInArrow(_footers, shape).groupBy(*_FILE, "section", "field_name").agg(F.bit_or("types").alias("bits"))
    names = [F.when(F.col("bits").bitwiseAND(1 << n) != 0, F.lit(t)) for n, t in enumerate(TYPES)]
    order = Window.partitionBy("campaign", "artifact").orderBy("version_no")
    every = Window.partitionBy("campaign", "artifact")
    after = Window.partitionBy("campaign", "artifact").orderBy("version_at").rangeBetween(1, 1)
    before = Window.partitionBy("campaign", "artifact").orderBy("version_at").rangeBetween(-1, -1)
    placed = seen.select(*_FILE, "section", "field_name", F.array_join(F.array(*names), "|").alias("types")).withColumn("version_at", F.dense_rank().over(order))
    return placed.withColumns({"last_at": F.max("version_at").over(every), "next_no": F.min("version_no").over(after), "prev_no": F.min("version_no").over(before)})


def _lives(placed: DataFrame) -> DataFrame:
    return placed.filter("section IS NOT NULL").select(*_PRODUCER, "field_name", "version_no", "version_at", "last_at", "next_no", "prev_no", "types")


def catalogue(files: DataFrame) -> DataFrame:
    """Field lifespans by version: (campaign, artifact, section, field_name, version_no, version_at, last_at, next_no, prev_no, types).

    version_at is the place of the version among those with a readable payload of its campaign and
    artifact, last_at the place of the last one, next_no and prev_no the numbers of the versions beside it.
    types are the distinct types, sorted and joined by '|'.
    """
    return _lives(_placed(files))


def lifespans(lives: DataFrame) -> DataFrame:
    """Islands of a field's life: (campaign, artifact, section, field_name, first_no, last_no, versions, types).

    first_no and last_no are the versions in which an unbroken life starts and ends, types its types at the end.
    """
    w = Window.partitionBy(*_PRODUCER, "field_name").orderBy("version_at")
    islands = lives.withColumn("island", F.col("version_at") - F.row_number().over(w))
    return islands.groupBy(*_PRODUCER, "field_name", "island").agg(
        F.min("version_no").alias("first_no"), F.max("version_no").alias("last_no"), F.count("*").alias("versions"), F.max_by("types", "version_no").alias("types")
    ).drop("island")


def _turns(lives: DataFrame) -> DataFrame:
    """Starts, ends and changes of type: (campaign, artifact, section, version_no, prev_no, change, field_name), one pass over each life."""
    w = Window.partitionBy(*_PRODUCER, "field_name").orderBy("version_at")
    at = lives.withColumns({"was": F.lag("version_at").over(w), "will": F.lead("version_at").over(w), "was_types": F.lag("types").over(w)})
    before, after = F.col("was") == F.col("version_at") - 1, F.col("will") == F.col("version_at") + 1
    now = lambda change: F.struct(F.col("version_no"), F.col("prev_no"), F.lit(change).alias("change"))
    found = F.array(
        F.when((F.col("version_at") > 1) & ~F.coalesce(before, F.lit(False)), now("added")),
        F.when(before & (F.col("was_types") != F.col("types")), now("retyped")),
        F.when((F.col("version_at") < F.col("last_at")) & ~F.coalesce(after, F.lit(False)), F.struct(F.col("next_no").alias("version_no"), F.col("version_no").alias("prev_no"), F.lit("removed").alias("change"))),
    )
    return at.select(*_PRODUCER, "field_name", F.explode(F.filter(found, lambda t: t.isNotNull())).alias("t")).select(*_PRODUCER, "t.*", "field_name")


def changes(files: DataFrame, lives: DataFrame | None = None) -> DataFrame:
    """Every change: (campaign, artifact, section, version_no, change, field_name, new_name).

    files: campaign, artifact, schema_version, payload. A version's fields are the top-level keys with a
    non-null value in any row of the section in any readable payload of the version; versions are ordered
    by the number at the end of schema_version, and each is held against the next lower one present.
    change: 'added', 'removed', 'retyped' (the set of types differs) or 'renamed' (field_name is gone,
    new_name is new, and the rows with the same id and both values non-null, at least one, all have equal
    values); a renamed field is neither added nor removed. new_name is '' unless renamed.
    Unreadable, NULL and empty payloads, missing sections and rows that are no object tell nothing; files
    without a version number, campaign or artifact are left out (rejects names them); repeated files change nothing; ids that repeat
    within a version must agree in all their values. An empty table gives an empty result. Other columns are not looked at.
    lives is the files' catalogue, where the caller has it.
    """
    # small (a row per change) and used several times: without it every use would parse the files again
    turns = checkpoint(_turns(catalogue(files) if lives is None else lives))
    both = Window.partitionBy(*_PRODUCER, "version_no")
    plain = turns.filter("change <> 'retyped'")
    here = plain.withColumns({"gone": F.max(F.col("change") == "removed").over(both), "new": F.max(F.col("change") == "added").over(both)})
    candidates = here.filter("gone AND new").drop("gone", "new")
    named = checkpoint(_renamings(files, candidates))
    moved = named.select(*_PRODUCER, "version_no", F.explode(F.array(F.struct(F.lit("removed").alias("change"), "field_name"), F.struct(F.lit("added").alias("change"), F.col("new_name").alias("field_name")))).alias("m")).select(*_PRODUCER, "version_no", "m.*")
    rest = plain.join(bounded_broadcast(moved.distinct(), MOST_VERSIONS), [*_PRODUCER, "version_no", "change", "field_name"], "left_anti")
    out = ["campaign", "artifact", "section", "version_no", "change", "field_name", "new_name"]
    return (
        rest.unionByName(turns.filter("change = 'retyped'")).withColumn("new_name", F.lit("")).select(out)
        .unionByName(named.withColumn("change", F.lit("renamed")).select(out))
    )


def _near(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files with what is wanted of their versions; payloads stay where they are while versions are few."""
    if wanted.limit(MOST_VERSIONS + 1).count() <= MOST_VERSIONS:
        return files.join(F.broadcast(wanted), list(_FILE))
    return paired(wanted, files, _FILE, "payload")


def _renamings(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """(campaign, artifact, section, version_no, field_name, new_name) of the candidates whose values agree."""
    # a gone field's values lie in the version before, a new one's in the version itself
    sought = candidates.select(
        *_PRODUCER, F.col("version_no").alias("turn_no"), "change", "field_name", F.when(F.col("change") == "added", F.col("version_no")).otherwise(F.col("prev_no")).alias("version_no")
    )
    wanted = sought.groupBy(*_FILE).agg(F.collect_set(F.struct("section", "field_name", "turn_no", "change")).alias("wanted"))
    shape = "campaign string, artifact string, section string, turn_no bigint, change string, field_name string, row bigint, value bigint"
    cells = _near(_slim(files), wanted).select("campaign", "artifact", "payload", "wanted").mapInArrow(_cells, shape)
    sides = cells.groupBy(*_PRODUCER, "turn_no", "row", "change", "field_name").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    # a row's gone and new fields: as many as a version changes
    row = sides.groupBy(*_PRODUCER, "turn_no", "row").agg(
        F.collect_list(F.when(F.col("change") == "removed", F.struct("field_name", "low", "high"))).alias("g"),
        F.collect_list(F.when(F.col("change") == "added", F.struct("field_name", "low", "high"))).alias("n"),
    )
    pairs = row.select(*_PRODUCER, "turn_no", F.explode("g").alias("g"), "n").select(*_PRODUCER, "turn_no", "g", F.explode("n").alias("n"))
    same = (F.col("g.low") == F.col("g.high")) & (F.col("n.low") == F.col("g.low")) & (F.col("n.high") == F.col("g.low"))
    return (
        pairs.groupBy(*_PRODUCER, F.col("turn_no").alias("version_no"), F.col("g.field_name").alias("field_name"), F.col("n.field_name").alias("new_name"))
        .agg(F.bool_and(same).alias("same"))
        .filter("same").drop("same")
    )


def alias_table(changed: DataFrame) -> DataFrame:
    """Renamings per producer as one array in version order: (campaign, artifact, section, aliases)."""
    step = F.struct("version_no", F.col("field_name").alias("old"), F.col("new_name").alias("new"))
    return changed.filter("change = 'renamed'").groupBy(*_PRODUCER).agg(F.array_sort(F.collect_list(step)).alias("aliases"))


def latest_name(name: Column, version: Column, aliases: Column) -> Column:
    """The name that a field of a version bears in the producer's last version."""
    return F.coalesce(
        F.aggregate(
            aliases, name,
            lambda n, a: F.when((a["version_no"] > version) & (a["old"] == n), a["new"]).otherwise(n),
        ),
        name,
    )


def casts(lives: DataFrame, changed: DataFrame) -> DataFrame:
    """What the consistent table makes of each field: (producer, version_no, field_name, name, types, cast_to).

    name is the field's latest name; cast_to the type of the last version in which that name lives.
    """
    aliases = bounded_broadcast(alias_table(changed), MOST_VERSIONS)
    named = lives.join(aliases, list(_PRODUCER), "left").withColumn("name", latest_name(F.col("field_name"), F.col("version_no"), F.col("aliases")))
    last = Window.partitionBy(*_PRODUCER, "name")
    return named.select(*_PRODUCER, "version_no", "field_name", "name", "types", F.max_by("types", F.struct("version_no", "types")).over(last).alias("cast_to"))


def _cast(v: Any, cast_to: str) -> Any:
    """v as the type, None where it can't be."""
    if cast_to == "number":
        try:
            return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or isinstance(v, str) and "_" not in v else None
        except (ValueError, OverflowError):
            return None
    if cast_to == "boolean":
        return {"true": True, "1": True, "1.0": True, "false": False, "0": False, "0.0": False}.get(_plain(v).lower())
    return _plain(v)


def _plain(v: Any) -> str:
    """The text of a value: a string itself, other values as JSON."""
    return _clean(v) if isinstance(v, str) else dumps(int(v) if isinstance(v, float) and v.is_integer() else v, tight=True)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file_id, campaign, artifact, version_no, section, row_no, row_id, [(name, value, cast_to)]) of each row of the files."""
    for batch in batches:
        for file_id, campaign, artifact, version, text, plan in zip(*(batch.column(i).to_pylist() for i in range(6))):
            to = {(c["section"], c["field_name"]): (c["name"], c["cast_to"]) for c in plan}
            for section, items in (_sections(text) or {}).items():
                for n, r in enumerate(items):
                    at = None if r.get("id") is None else _plain(r["id"])
                    cells = [(*to[section, _clean(k)], v) for k, v in r.items() if v is not None]
                    yield file_id, campaign, artifact, version, section, n, at, [(name, v, cast_to) for name, cast_to, v in cells]


def _planned(files: DataFrame, casting: DataFrame) -> DataFrame:
    slim = files.select(F.col("file_id").cast("bigint").alias("file_id"), "campaign", "artifact", version_number("schema_version").alias("version_no"), F.col("payload").cast("string").alias("payload"))
    plan = casting.groupBy(*_FILE).agg(F.collect_list(F.struct("section", "field_name", "name", "cast_to")).alias("plan"))
    return _near(slim, plan).select("file_id", *_FILE, "payload", "plan")


_ROW = [("file_id", "bigint"), ("campaign", "string"), ("artifact", "string"), ("version_no", "bigint"), ("section", "string"), ("row_no", "bigint"), ("row_id", "string")]
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def consistent_cells(files: DataFrame, casting: DataFrame) -> DataFrame:
    """Every value of every readable file under its latest name and type, in long form.

    (file_id, campaign, artifact, section, version_no, row_no, row_id, name, value, cast_to, as_number, as_boolean).
    value is the text of the value (JSON text of arrays and objects); as_number and as_boolean hold it where
    cast_to says so and it can be cast, else NULL. NULLs have no row. Files that rejects names have none; a name that two fields
    of one row come to has a row for each.
    """
    columns = [*_ROW, ("name", "string"), ("value", "string"), ("cast_to", "string"), ("as_number", "double"), ("as_boolean", "boolean")]
    schema = pa.schema([(n, _ARROW[t]) for n, t in columns])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for *row, cells in _records(source):
                for name, v, cast_to in cells:
                    yield *row, name, _plain(v), cast_to, _cast(v, cast_to) if cast_to == "number" else None, _cast(v, cast_to) if cast_to == "boolean" else None

        return _batches(rows(), schema)

    return _planned(files, casting).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in columns))


def wide_columns(casting: DataFrame, most: int = MOST_COLUMNS) -> list[tuple[str, str]]:
    """(name, type) of the columns of the consistent table: the names most versions have, at most so many, in order.

    A name's type is what its producers agree on, number or boolean, else string.
    """
    known = casting.groupBy("name").agg(F.count("*").alias("n"), F.min("cast_to").alias("low"), F.max("cast_to").alias("high"))
    held = known.orderBy(F.col("n").desc(), "name").limit(most).collect()  # at most `most` rows
    return sorted((r.name, {"number": "double", "boolean": "boolean"}.get(r.low if r.low == r.high else "", "string")) for r in held)


def consistent_table(files: DataFrame, casting: DataFrame, most: int = MOST_COLUMNS) -> DataFrame:
    """One wide table of the rows of all readable files: (file_id, campaign, artifact, version_no, section, row_no, row_id, a column per name, rest).

    Columns are the latest names of the fields and have their latest type. rest, a map of texts, holds what has no
    place in them: values that can't be cast, a second value of a name within a row, and names that differ from
    another's only in case or in being one of the fixed columns' or beyond the `most` commonest. So no value is lost. A row without values is a row; an empty table
    gives an empty one; files that rejects names have no row.
    """
    taken = {n for n, _ in _ROW} | {"rest"}
    wide = []
    for n, t in wide_columns(casting, most):
        if n.lower() not in taken:
            taken.add(n.lower())
            wide.append((n, t))
    types = dict(wide)
    schema = pa.schema([*((n, _ARROW[t]) for n, t in (*_ROW, *wide)), ("rest", pa.map_(pa.string(), pa.string()))])
    to = {"double": "number", "boolean": "boolean", "string": "string"}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for *row, cells in _records(source):
                own: dict[str, Any] = {}
                rest: dict[str, str] = {}
                for name, v, _ in cells:
                    cast = _cast(v, to[types[name]]) if name in types else None
                    if cast is None or name in own:
                        key, n = name, 2
                        while key in rest:
                            key, n = f"{name} {n}", n + 1
                        rest[key] = _plain(v)
                    else:
                        own[name] = cast
                yield *row, *(own.get(n) for n, _ in wide), list(rest.items())

        return _batches(rows(), schema)

    quoted = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in (*_ROW, *wide))
    return _planned(files, casting).mapInArrow(run, f"{quoted}, rest map<string,string>")
