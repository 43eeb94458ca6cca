"""JSON documents, registries and cached facts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.ids import literal_integer

#: Versions of the sink registry that are read.
REGISTRY_VERSIONS = ("v1", "v2")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole documents with a given schema; unreadable ones have _corrupt_record."""
    full = f"{schema}, _corrupt_record string"
    return spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=True)


def read_samples(spark: SparkSession, root: str, schema: str, pattern: str = "per_sample/*/public_match.json") -> DataFrame:
    """The documents of many roots with their sample, named by the folder; those whose status isn't OK are left out."""
    found = spark.read.schema(schema).json(os.path.join(root, pattern), multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    return found.withColumn("sample", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).filter(F.coalesce(F.col("status"), F.lit("")) == "OK")


def sink_registry(raw: DataFrame) -> DataFrame:
    """Rows of either registry version as one contract, enabled ones only.

    raw: version, patterns array<struct<name, names, kind, label, enabled, roles map<string,int>>>. A row may name one function or several; enabled is
    true unless said otherwise; names are trimmed, and the first row of a name wins.
    """
    known = raw.filter(F.col("version").isin(*REGISTRY_VERSIONS)).select("version", F.posexplode("patterns").alias("n", "p"))
    names = F.array_distinct(F.array_compact(F.concat(F.array(F.col("p.name")), F.coalesce("p.names", F.array().cast("array<string>")))))
    rows = known.filter(F.coalesce(F.col("p.enabled"), F.lit(True))).select(F.explode(F.transform(names, lambda x: F.trim(x))).alias("name"), "n", F.col("p.kind").alias("kind"), F.col("p.label").alias("label"), F.col("p.roles").alias("roles"), "version")
    rest = ["kind", "label", "roles", "version"]
    return rows.filter("name <> ''").groupBy("name").agg(F.min_by(F.struct(*rest), F.struct("n", "version")).alias("r")).select("name", "r.*")


def hardware_profiles(raw: DataFrame) -> DataFrame:
    """The registers of hardware profiles: (profile_id, peripheral_instance, address, instance_base, field_offset, role, access).

    raw: profile_id, scope, registers array<struct<peripheral_instance, address, instance_base, field_offset, role, access array>>.
    Profiles of one binary are left out. Addresses are decimal or hex text; one that is missing is base plus offset. The first of a
    profile's rows of one address and role counts.
    """
    r = raw.filter(F.coalesce("scope", F.lit("platform")) != "binary").select("profile_id", F.posexplode("registers").alias("n", "r"))
    base, offset = literal_integer(F.col("r.instance_base")), literal_integer(F.col("r.field_offset"))
    rows = r.select("profile_id", "n", F.col("r.peripheral_instance").alias("peripheral_instance"), F.coalesce(literal_integer(F.col("r.address")), base + offset).alias("address"), base.alias("instance_base"), offset.alias("field_offset"), F.col("r.role").alias("role"), F.col("r.access").alias("access"))
    rest = ["peripheral_instance", "instance_base", "field_offset", "access"]
    return rows.filter("address IS NOT NULL").groupBy("profile_id", "address", "role").agg(F.min_by(F.struct(*rest), "n").alias("r")).select("profile_id", "address", "role", "r.*")


def summary_pack(raw: DataFrame, compatibility: bool = False) -> DataFrame:
    """Function summaries of a pack, one row per function and output; compatibility-specific ones on demand.

    raw: pack, summaries array<struct<function, compatibility, outputs array<struct<kind, slot int>>>>.
    """
    s = raw.select("pack", F.explode("summaries").alias("s"))
    if not compatibility:
        s = s.filter(~F.coalesce(F.col("s.compatibility"), F.lit(False)))
    return s.select("pack", F.col("s.function").alias("function"), F.posexplode("s.outputs").alias("output_no", "o")).select("pack", "function", "output_no", F.col("o.kind").alias("kind"), F.col("o.slot").alias("slot"))


def cached_facts(facts: DataFrame, wanted: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(facts to reuse, binaries to export): reuse takes an equal digest and an equal schema version."""
    usable = facts.filter(F.col("schema_version") == version)
    reuse = usable.join(wanted.select("binary_sha256").distinct(), "binary_sha256", "left_semi")
    return reuse, wanted.join(usable.select("binary_sha256").distinct(), "binary_sha256", "left_anti")


def normalise_cfg(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between known blocks, references to unknown ones); nothing is invented.

    blocks: function_id, block_id, successor_block_ids array<string>.
    """
    refs = blocks.select("function_id", F.col("block_id").alias("source_block_id"), F.explode("successor_block_ids").alias("target_block_id")).distinct()
    known = blocks.select("function_id", F.col("block_id").alias("target_block_id"), F.lit(True).alias("known")).distinct()
    marked = refs.join(known, ["function_id", "target_block_id"], "left")
    return marked.filter("known").drop("known"), marked.filter("known IS NULL").drop("known").withColumn("reason", F.lit("unresolved_block"))
