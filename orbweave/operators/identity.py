"""Identity of nested scenario documents: a digest of what they mean, whatever the order of their collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators.catalogs import digest_tree

#: Collections without order and the fields that tell their members apart.
COLLECTIONS = {"satellites": ["id"], "missions": ["id"], "observation_windows": ["satellite_id", "sensor_id", "mission_id"]}
WINDOW = ["start_time", "end_time", "orbit_number"]
METADATA = ["creation_time", "duration", "time_step"]


def read_documents(spark: SparkSession, path) -> DataFrame:
    """file and doc, the document as VARIANT, null where it cannot be read."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return text.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _members(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "array<variant>")


def document_parts(docs: DataFrame) -> DataFrame:
    """file, kind, key and text of the parts that a scenario's meaning has (E27): its type, three metadata fields, satellites,
    missions, groups of windows, windows. Names, descriptions, the scenario's id and unknown top-level fields are left out.

    Object fields come in order of name, lists inside a part in their own order. key has the JSON of the fields that tell
    members apart, null for one that is missing.
    """
    key = lambda v, names: F.array(*[F.to_json(_field(v, n)) for n in names])
    out = docs.select("file", F.lit("scenario_type").alias("kind"), F.array(F.lit("")).alias("key"), F.coalesce(F.to_json(_field(F.col("doc"), "scenario_type")), F.lit("null")).alias("text"))
    for name in METADATA:
        value = F.to_json(_field(F.col("doc"), f"metadata.{name}"))
        out = out.union(docs.select("file", F.lit(f"metadata.{name}"), F.array(F.when(value.isNotNull(), F.lit(""))), value))
    for name, fields in COLLECTIONS.items():
        rows = docs.select("file", F.explode(_members(F.col("doc"), name)).alias("m"))
        own = F.map_filter(F.try_variant_get("m", "$", "map<string,variant>"), lambda k, _: k != "time_windows") if name == "observation_windows" else F.col("m")
        out = out.union(rows.select("file", F.lit(name), key(F.col("m"), fields), F.to_json(own)))
        if name == "observation_windows":
            windows = rows.select("file", "m", F.explode(_members(F.col("m"), "time_windows")).alias("t"))
            out = out.union(windows.select("file", F.lit("time_windows"), F.concat(key(F.col("m"), fields), key(F.col("t"), WINDOW)), F.to_json("t")))
    return out


def scenario_identity(docs: DataFrame, strict: bool = True) -> DataFrame:
    """file, digest and faults of each document (E27). Equal for files that differ in the order of their collections, in
    names or descriptions only; two members of a collection with one key, a missing key or metadata field, or a document
    that cannot be read is a fault: strict raises an error that names it, otherwise the digest is null."""
    parts = document_parts(docs.where("doc IS NOT NULL"))
    same = parts.groupBy("file", "kind", "key").agg(F.count("*").alias("n"))
    lacks = F.exists("key", lambda k: k.isNull())
    fault = F.when(lacks, F.concat(F.lit("missing key in "), "kind")).when(F.col("n") > 1, F.concat(F.lit("duplicate in "), "kind"))
    faults = same.withColumn("fault", fault).groupBy("file").agg(F.array_sort(F.collect_set("fault")).alias("faults"))
    digests = digest_tree(parts, ["file"], F.concat_ws("|", "kind", F.to_json("key"), "text"))
    out = docs.select("file").join(digests.select("file", "digest"), "file", "left").join(faults, "file", "left")
    out = out.withColumn("faults", F.coalesce("faults", F.array(F.lit("unreadable"))))
    bad = F.raise_error(F.concat_ws(": ", "file", F.array_join("faults", ", "))).cast("string") if strict else F.lit(None).cast("string")
    return out.select("file", F.when(F.size("faults") > 0, bad).otherwise(F.col("digest")).alias("digest"), "faults")
