"""Tab-separated records and id lists: read, prepared, written."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its files make fewer tasks than these; larger inputs are read as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All columns as strings, nothing quoted, empty fields as '' (Spark reads them as null)."""
    reader = spark.read.options(sep="\t", header=True, quote="", escape="", encoding="UTF-8", mode="PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The first column of a file with a header: trimmed, without blanks, once each. The file need not be a proper table."""
    lines = spark.read.text(path)
    header = F.trim(F.split("value", "\t")[0]).alias("id")
    first = spark.read.text(path).limit(1).select(header).first()
    ids = lines.select(header).where("id <> ''").distinct()
    return ids.where(F.col("id") != first["id"]) if first and first["id"] else ids


def prepare_records(records: DataFrame) -> DataFrame:
    """Normalised columns; the raw text goes."""
    name, address = text.core_name(text.normalize(F.col("business_name"))), text.normalize(F.col("business_address"))
    first = records.select("entity_id", text.country_label(F.col("country")).alias("country"), name.alias("name_core"), address.alias("addr_norm"), text.non_ascii_share(F.col("business_name")).cast("float").alias("name_non_ascii"))
    return first.select(
        "entity_id",
        "country",
        "name_core",
        "addr_norm",
        text.number_tokens(F.col("addr_norm")).alias("addr_nums"),
        text.first_number(F.col("addr_norm")).alias("addr_first_num"),
        text.token_count(F.col("name_core")).cast("short").alias("name_ntok"),
        "name_non_ascii",
    )


def load_source(spark: SparkSession, path: str) -> DataFrame:
    return prepare_records(read_tsv(spark, path, RECORD))


def corpus(second: DataFrame, third: DataFrame) -> DataFrame:
    """Both target sources in one table, with is_s3."""
    return second.withColumn("is_s3", F.lit(False)).unionByName(third.withColumn("is_s3", F.lit(True)))


def load_corpus(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return corpus(*[load_source(spark, f"{folder}/{split}_source{i}.tsv") for i in (2, 3)])


def id_set(ids: Column) -> Column:
    """The ids of a comma list, without empty ones, once each."""
    return F.array_distinct(F.filter(F.split(ids, ","), lambda x: x != ""))


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """(s1, ids) of a file of entity and comma list, whatever its columns are named."""
    df = read_tsv(spark, path)
    return df.select(F.col(df.columns[0]).alias("s1"), id_set(F.col(df.columns[1])).alias("ids"))


def exploded_truth(lists: DataFrame) -> DataFrame:
    """(s1, c) for each id of a list."""
    return lists.select("s1", F.explode("ids").alias("c")).distinct()


def id_lists(entities: DataFrame, pairs: DataFrame, distinct: bool = False) -> DataFrame:
    """(entity_id, ids) for each of entities (entity_id): its pairs (s1, c, rank) as a comma list in order of rank, '' if it has none.

    distinct: an id that repeats stays in its first place only.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"])
    lists = pairs.groupBy(F.col("s1").alias("_s1")).agg((F.array_distinct(ordered) if distinct else ordered).alias("list"))
    joined = entities.select("entity_id").join(lists, F.col("entity_id") == F.col("_s1"), "left")
    return joined.select("entity_id", F.coalesce(F.array_join("list", ","), F.lit("")).alias("ids"))


def write_id_lists(entities: DataFrame, pairs: DataFrame, path: str, column: str, distinct: bool = False) -> None:
    """A folder of unquoted tab-separated files, in the order of entities' column `ordinal` if they have one."""
    out = id_lists(entities, pairs, distinct)
    if "ordinal" in entities.columns:
        place = entities.select(F.col("entity_id").alias("_id"), "ordinal")
        out = out.join(place, F.col("entity_id") == F.col("_id")).orderBy("ordinal")
    out.select(F.col("entity_id").alias("source1_entity_id"), F.col("ids").alias(column)).write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="", lineSep="\n").csv(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Pairs with their probabilities, by real ids: later decisions read them again without scoring."""
    scores.write.mode("overwrite").parquet(path)
