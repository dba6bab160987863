"""Table sources. Schemas are given, not inferred, wherever the format does not carry one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow import schemas
from weirflow.session import path_exists


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_catalog(spark: SparkSession, folder: str, names: list[str]) -> tuple[dict[str, DataFrame], list[str]]:
    """All tables of a folder by name, and the names that are not there."""
    found = {n: f"{folder}/{n}.parquet" for n in names if path_exists(spark, f"{folder}/{n}.parquet")}
    return {n: read_parquet(spark, p) for n, p in found.items()}, [n for n in names if n not in found]


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, multi_line: bool = False) -> DataFrame:
    """CSV with a header, bound by column name. Cells are read as text and cast one by one, so a bad cell costs itself, not its row.

    Columns that the header lacks are an error that names them; further ones are left out. All files must have the same header, which
    the reader checks. Files are split between tasks; ``multi_line`` allows line ends in quoted cells, and makes each file one task.
    """
    form = {"header": True, "encoding": "UTF-8", "escape": '"', "multiLine": multi_line}
    header = spark.read.csv(path, inferSchema=False, **form).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}; it has {header}")
    text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    raw = spark.read.csv(path, schema=text, enforceSchema=False, **form)
    return raw.select(*[
        F.nullif(raw[f"`{f.name}`"], F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge documents: each file holds an array of documents, one document, or ``{"documents": [...]}``."""
    wrapper = T.StructType([
        *schemas.KNOWLEDGE_DOCUMENT.fields,
        T.StructField("documents", T.ArrayType(schemas.KNOWLEDGE_DOCUMENT)),
    ])
    rows = spark.read.json(path, schema=wrapper, multiLine=True).withColumn("sourceFile", F.col("_metadata.file_name"))
    names = schemas.KNOWLEDGE_DOCUMENT.fieldNames()
    docs = F.when(F.col("documents").isNotNull(), F.col("documents")).otherwise(F.array(F.struct(*names)))
    return normalise_knowledge(rows.select("sourceFile", F.explode(docs).alias("d")).select("sourceFile", "d.*"))


def normalise_knowledge(docs: DataFrame) -> DataFrame:
    """Fill the defaults and drop documents without text."""
    return (
        docs.withColumn("docType", F.coalesce("docType", F.lit("sop")))
        .withColumn("classification", F.coalesce("classification", F.lit("internal")))
        .withColumn("source", F.coalesce("source", "sourceFile"))
        .filter(F.trim(F.coalesce("content", F.lit(""))) != "")
    )


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", **options: str) -> DataFrame:
    """Event stream from files that land in a folder."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def stream_broker(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """Event stream from a Kafka-compatible hub; needs the Kafka connector on the classpath."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("failOnDataLoss", "true")
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
