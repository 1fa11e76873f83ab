"""JSON documents, one folder for each recording: strict and tolerant scans, state tables, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..storage import Files

CORRUPT = "_corrupt_record"


def folder_name(path: Column, levels: int = 2) -> Column:
    """The name of the folder that holds a file."""
    return F.element_at(F.split(path, "/"), -levels)


def strict(spark: SparkSession, path: str, schema: str, by_line: bool = False) -> DataFrame:
    """Documents, one to a file or one to a line, that must be of the schema; one that isn't stops the query."""
    return spark.read.schema(schema).option("multiLine", not by_line).option("mode", "FAILFAST").json(path)


def _readable(read: DataFrame) -> Column:
    """Whether a document was read. Spark doesn't answer queries that use nothing but the mark of unread ones, so the test names a field too, in a way that says nothing of it."""
    field = next(c for c in read.columns if c != CORRUPT)
    return F.coalesce(F.col(CORRUPT), F.when(F.length(F.col(field).cast("string")) < 0, F.lit(""))).isNull()


def tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents with name, the folder of each; what can't be read as JSON is left out, and a path without files gives no rows."""
    if not Files(spark).found(path):
        return spark.createDataFrame([], f"{schema}, name string")
    read = spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return read.withColumn("name", folder_name(F.col("_metadata.file_path"))).where(_readable(read)).drop(CORRUPT)


def recordings(spark: SparkSession, base: str) -> DataFrame:
    """Manifests of all folders below base, with name; folders without one don't count."""
    return tolerant(spark, f"{base}/*/manifest.json", schemas.MANIFEST)


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, empty where there is none yet; nothing is created by looking."""
    return spark.read.schema(schema).parquet(path) if Files(spark).found(path) else spark.createDataFrame([], schema)


def cached(table: DataFrame, key: str) -> DataFrame:
    """Rows of a cache table(key, payload) kept for this key."""
    return table.where(F.col("key") == key)


SIDECAR = "key string, provider string, model string, prompt string, seconds double, seed long, wall_seconds double"


def sidecars(spark: SparkSession, path: str, made: str = "mp4", by_line: bool = False) -> DataFrame:
    """(path, key, ...) of the JSON files beside generated ones: path is the generated file's, of the same stem; what can't be read is left out. With by_line a file holds many sidecars, one to a line, and each says its generated file's path, so that files needn't be as many as what was generated."""
    if not Files(spark).found(path):
        return spark.createDataFrame([], f"path string, {SIDECAR}")
    own = "path string, " if by_line else ""
    read = spark.read.schema(f"{own}{SIDECAR}, {CORRUPT} string").option("multiLine", not by_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    named = read if by_line else read.withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), r"\.json$", f".{made}"))
    return named.where(_readable(read)).select("path", *[f.split()[0] for f in SIDECAR.split(", ")])


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(folder, name) of the files below folder whose names match a pattern; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")
    parts = F.split("path", "/")
    return files.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"))


def listing_ends(files: DataFrame) -> DataFrame:
    """(folder, first, last): the first and last name of each folder in the order of a sorted listing."""
    return files.groupBy("folder").agg(F.min("name").alias("first"), F.max("name").alias("last"))


def assembled(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """All rows of base with what the other documents of their key add; what is missing is null."""
    for other in others:
        base = base.join(other, key, "left")
    return base


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the lines key=value of a text file, without comments and outer quotes."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*#"))
    kept = lines.select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("value")).where("key <> ''")
    return kept.withColumn("value", F.regexp_replace("value", r"""^(["'])(.*)\1$""", "$2"))


def ledger(manifests: DataFrame) -> DataFrame:
    """Ledger rows of manifests(video_id, stages) in order of stages, with container, the stage that holds them, and pos."""
    flat = manifests.select("video_id", F.explode("stages").alias("container", "record")).select("video_id", "container", F.posexplode("record.costs").alias("pos", "c"))
    return flat.select("video_id", "container", "pos", "c.*")


def runs(manifests: DataFrame) -> DataFrame:
    return manifests.select("video_id", F.posexplode("runs").alias("run", "r")).select("video_id", "run", "r.*")


def overview(manifests: DataFrame) -> DataFrame:
    """(video_id, updated, stages, spent_usd, estimated_usd, reference_usd, history_usd, saved_usd) of manifests: how many stages are recorded, what their ledgers come to, what all runs have cost, and what the last run saved by what it found cached. A projection of each stored document, with nothing exploded or shuffled; a recording without stages or runs has zeros."""
    costs = lambda record: F.coalesce(record["costs"], F.array())
    rows = F.flatten(F.transform(F.map_values("_stages"), costs))
    reference = lambda c: F.coalesce(c["provider"] == "reference", F.lit(False))
    estimated = lambda c: F.coalesce(c["estimated"], F.lit(False))
    kinds = {"spent_usd": lambda c: ~estimated(c) & ~reference(c), "estimated_usd": lambda c: estimated(c) & ~reference(c), "reference_usd": reference}

    def summed(of: Column, wanted=None) -> Column:
        some = F.filter(of, wanted) if wanted else of
        return F.round(F.aggregate(some, F.lit(0.0), lambda acc, c: acc + F.coalesce(c["usd"].cast("double"), F.lit(0.0))), 6)

    last = F.array_distinct(F.coalesce(F.get("runs", F.size("runs") - 1)["stages_cached"], F.array().cast("array<string>")))
    cached = F.flatten(F.transform(F.filter(last, lambda s: F.map_contains_key("_stages", s)), lambda s: costs(F.element_at("_stages", s))))
    whole = manifests.withColumn("_stages", F.coalesce("stages", F.create_map().cast(manifests.schema["stages"].dataType))).withColumn("runs", F.coalesce("runs", F.array().cast(manifests.schema["runs"].dataType)))
    sums = [summed(rows, w).alias(n) for n, w in kinds.items()]
    return whole.select("video_id", "updated", F.size("_stages").alias("stages"), *sums, summed(F.col("runs")).alias("history_usd"), summed(cached, kinds["spent_usd"]).alias("saved_usd"))


def resolved(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted(name) with folder: the name itself where known(name) has it, else the id in it as a link; neither stops the query."""
    from ..functions.text import video_id

    found = wanted.join(known.select("name").distinct().withColumn("_known", F.lit(True)), "name", "left")
    folder = F.coalesce(F.when(F.col("_known") & ~F.col("name").contains("/"), F.col("name")), video_id(F.col("name")))
    return found.select("name", F.when(folder.isNull(), F.raise_error(F.concat(F.lit("neither a folder nor a link: "), "name"))).otherwise(folder).alias("folder"))


def now() -> Column:
    """Local time as text without a zone."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def write_documents(df: DataFrame, path: str, by: str) -> None:
    """Rows as JSON documents below a folder for each value of `by`, replacing those folders only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy(by).json(path)


def overwrite(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions of `by` that df has, and only those."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
