"""Readers and writers for the engine's file formats."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from factsieve import schemas

SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")  # that pyarrow can open

def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Fact CSV with a header; quoted commas, quotes and line breaks are honoured.

    An empty field is an empty string. An empty file is an error.
    """
    facts = (
        spark.read.schema(schemas.FACTS).option("header", True).option("multiLine", True)
        .option("escape", '"').option("mode", "FAILFAST").csv(path).fillna("")
    )
    if facts.isEmpty():
        raise ValueError(f"no facts in {path}")
    return facts


def write_examples(examples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one directory per split; null metadata fields are written out."""
    out = examples.withColumn("split", F.col("metadata.split")).select("split", "record_id", "messages", "metadata")
    out.write.mode(mode).partitionBy("split").option("ignoreNullFields", "false").json(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of records; a malformed line fails the read. Lines without an id get a derived one."""
    rows = spark.read.schema(schemas.EXAMPLES).option("mode", "FAILFAST").json(path)
    return with_record_id(rows.filter(F.col("messages").isNotNull()))


def with_record_id(examples: DataFrame) -> DataFrame:
    """Deterministic record id from the metadata (the question tells list records apart)."""
    md = F.col("metadata")
    fact = F.get(md["fact_ids"], F.lit(0))
    record_id = (
        F.when(md["source_type"] == "paraphrase", F.concat_ws("|", F.lit("P"), fact, md["template"]))
        .when(md["source_type"] == "qa", F.concat_ws("|", F.lit("Q"), fact, md["direction"]))
        .when(md["source_type"] == "bio", F.concat_ws("|", F.lit("B"), F.get(md["fact_group_ids"], F.lit(0))))
        .otherwise(F.concat_ws("|", F.lit("R"), md["cluster_axis"],
                               F.md5(F.concat(F.get("messages", F.lit(0))["content"], F.lit("|"),
                                              F.element_at("messages", -1)["content"]))))
    )
    if "record_id" in examples.columns:
        record_id = F.coalesce("record_id", record_id)
    return examples.select(record_id.alias("record_id"), "messages", "metadata")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request documents (one JSON object per file); unknown keys are ignored."""
    rows = spark.read.schema(schemas.REQUEST_FILE).option("multiLine", True).json(path)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    return rows.select(stem.alias("request_id"), "entity", "attribute", "_deprecated")


def list_request_files(spark: SparkSession, path: str) -> DataFrame:
    """Example requests by file stem, deprecated ones left out."""
    return read_requests(spark, path).filter(F.col("_deprecated").isNull()).select(
        "request_id", "entity", "attribute").orderBy("request_id")


def read_audit_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested audit document -> (entity, fact_group_id, entity_type, axis, neighbor)."""
    schema = ("entities map<string, struct<fact_group_id:string, entity_type:string, "
              "neighbors:map<string,string>, total_distinct_neighbors:bigint>>")
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    axes = docs.select(F.explode("entities").alias("entity", "e")).select(
        "entity", "e.fact_group_id", "e.entity_type", F.explode_outer("e.neighbors").alias("axis", "raw"))
    # two axes of persons hold a plain string instead of a list; they name no neighbors
    listed = F.when(F.startswith("raw", F.lit("[")), F.from_json("raw", "array<string>"))
    return axes.select("entity", "fact_group_id", "entity_type", "axis", F.explode_outer(listed).alias("neighbor"))


def read_neighbor_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Nested neighbor export -> (entity, fact_group_id, entity_type, neighbor), retain axes only."""
    schema = ("entities map<string, struct<fact_group_id:string, entity_type:string, "
              "retain_neighbors:array<string>>>")
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select(F.explode("entities").alias("entity", "e")).select(
        "entity", "e.fact_group_id", "e.entity_type", F.explode_outer("e.retain_neighbors").alias("neighbor"))


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A parquet table of the engine (revisions, jobs, ...), or an empty one where none was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class VersionTaken(Exception):
    """Another writer has published this version."""


def _store(spark: SparkSession, path: str):
    """(file system, path) as Spark resolves them, on the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def newest_version(spark: SparkSession, root: str, name: str) -> int | None:
    """The newest published version of a state table, None if there is none yet."""
    store, folder = _store(spark, f"{root}/{name}/_published")
    if not store.exists(folder):
        return None
    return max((int(f.getPath().getName()) for f in store.listStatus(folder)), default=None)


def publish_table(df: DataFrame, root: str, name: str, version: int) -> str:
    """Publish ``df`` as a version of a state table; of two writers of one version the later gets ``VersionTaken``.

    The rows go to a folder of their own first. Creating the version's mark fails if it exists, so a
    version is there whole or not at all, and readers see one version, never a mixture.
    """
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}/{folder}")
    store, mark = _store(spark := df.sparkSession, f"{root}/{name}/_published/{version:010d}")
    try:
        stream = store.create(mark, False)
    except Exception as error:  # the file system's own exception, by way of the gateway
        if store.exists(mark):
            raise VersionTaken(f"version {version} of {name} is taken") from error
        raise
    stream.write(bytearray(folder.encode()))
    stream.close()
    return f"{root}/{name}/{folder}"


def read_published(spark: SparkSession, root: str, name: str, schema, version: int | None = None) -> DataFrame:
    """The newest (or the given) version of a state table; an empty one where none was published."""
    version = newest_version(spark, root, name) if version is None else version
    if version is None:
        return spark.createDataFrame([], schema)
    folder = spark.read.text(f"{root}/{name}/_published/{version:010d}").first()[0]
    return spark.read.schema(schema).parquet(f"{root}/{name}/{folder}")


def upsert_published(spark: SparkSession, root: str, name: str, schema, merge: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
    """Publish ``merge`` of the newest version as the next one, again from the new newest if another writer was first."""
    for _ in range(tries):
        now = newest_version(spark, root, name)
        try:
            publish_table(merge(read_published(spark, root, name, schema, now)), root, name, 0 if now is None else now + 1)
            return 0 if now is None else now + 1
        except VersionTaken:
            continue
    raise VersionTaken(f"{name}: {tries} tries, each overtaken")


CHUNK = 4 << 20  # bytes of a file that a task holds


def file_fingerprint(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(file, length, sha256) of each file's bytes; a task reads a file by the chunk, so it may have any length.

    Spark lists the files, empty ones left out; their bytes come through the file system that pyarrow has for the path's scheme.
    Files under other schemes come as one row each, which limits them to 2 GB.
    """
    found = spark.read.format("binaryFile").load(path)
    listed = found.select("path", "length")  # without the content column no file is read
    if listed.filter(~F.substring_index("path", ":", 1).isin(*SCHEMES)).limit(1).count():
        return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, length in zip(batch["path"], batch["length"]):
                store, name = fs.FileSystem.from_uri(quote(uri.replace("s3a:", "s3:", 1), safe=":/"))
                digest = hashlib.sha256()
                with store.open_input_stream(name, buffer_size=0) as stream:
                    while data := stream.read(chunk):
                        digest.update(data)
                yield pd.DataFrame({"file": [uri.rsplit("/", 1)[1]], "length": [length], "sha256": [digest.hexdigest()]})

    return listed.mapInPandas(digests, "file string, length long, sha256 string")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table of any size: row count and sum of row digests (60 bits of md5).

    Values count as text, null as ``~``, columns in the order of their names.
    """
    row = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in sorted(df.columns)])
    digest = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(digest).cast("string").alias("fingerprint"))


def write_documents(df: DataFrame, path: str, column: str) -> None:
    """Rendered documents as text, one folder per key column value."""
    df.select("revision", F.col(column).alias("value")).write.mode("overwrite").partitionBy("revision").text(path)


def write_tokenized(rows: DataFrame, path: str) -> None:
    rows.select("record_id", "input_ids", "attention_mask", "labels").write.mode("overwrite").parquet(path)
