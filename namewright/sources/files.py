"""Readers and writers of the reference's file shapes (S rows), with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.sources.shared import written

PAPER = "pid string, title string, abstract string, keywords array<string>, authors array<struct<name:string,org:string>>, venue string, year string"


def read_keyed_json(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """One JSON object per file, {key: value}, as rows (key, value); ``value`` is its Spark type.

    Such a file is one record, so it is read by one task; convert it to lines once
    (``write_json``) and read those in parallel from then on.
    """
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "value"))


def write_keyed_json(df: DataFrame, path: str, key: str, *values: Column, per: int = 10_000) -> None:
    """Files of one {key: value} object each, of about ``per`` keys that share a hash, so no task holds all."""
    parts = -(-df.count() // per) or 1
    entry = F.struct(F.col(key).cast("string").alias("k"), F.struct(*values).alias("v"))
    made = df.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    made.write.partitionBy("part").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One record per line."""
    df.write.json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_store(df: DataFrame, path: str, *partition_by: str) -> None:
    """The binary cache is a parquet folder; its parts are the shards."""
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)


def computed_once(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made and written there if it is absent."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Pid TAB token lines; repeated lines and lines without exactly two fields are dropped."""
    parts = F.split("value", "\t")
    return spark.read.text(path).distinct().where(F.size(parts) == 2).select(parts[0].alias("pid"), parts[1].alias("token"))


def write_edges(df: DataFrame, path: str, *cols: str, sep: str = "\t") -> None:
    """Edges as delimited lines."""
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]).alias("value")).write.text(path)


def read_weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """Src dst w."""
    return spark.read.csv(path, sep=" ", schema="src string, dst string, w double")


def write_lines(df: DataFrame, path: str, *cols: Column) -> None:
    """Attribute values one per line, nulls and empties left out."""
    lines = df.select(F.explode(F.array(*cols)).alias("value")).where(F.col("value").isNotNull() & (F.col("value") != ""))
    lines.write.text(path)


def write_attributes(df: DataFrame, path: str, attribute: str, value: str) -> None:
    """A folder of text files for each attribute, one value per line."""
    kept = df.where(F.col(value).isNotNull() & (F.col(value) != ""))
    kept.select(attribute, F.col(value).alias("value")).write.partitionBy(attribute).text(path)


def write_scores(df: DataFrame, path: str) -> None:
    """S09."""
    df.write.csv(path, header=True)


def read_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_vectors(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """``word v1 ... vn`` lines; a word2vec file's first line (count and size) is skipped."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).where(F.size(parts) > (2 if header else 1))
    return rows.select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float")).alias("vec"))


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """A bundle of tables as temporary views."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def flattened(df: DataFrame, name: str, nested: str) -> DataFrame:
    """{name: {aid: [pid]}} as rows."""
    return df.select(name, F.explode(nested).alias("aid", "pids")).select(name, "aid", F.explode("pids").alias("pid"))


def by_name(df: DataFrame, name: str, aid: str, pid: str, per: int = 100_000) -> DataFrame:
    """Rows as {name: {aid: [pid]}}: (name, piece, persons).

    A name of more than ``per`` rows comes in pieces of about that many, its persons dealt
    out by hash, so a row is bounded by ``per`` and by a person's papers whatever the name;
    a smaller one has the one piece 0. Null names and persons are left out, as keys of a
    map have to be.
    """
    rows = df.where(F.col(name).isNotNull() & F.col(aid).isNotNull()).groupBy(name, aid).agg(F.sort_array(F.collect_list(pid)).alias("pids"), F.count(F.lit(1)).alias("n_"))
    rows = written(rows, "persons")
    sizes = rows.groupBy(name).agg(F.ceil(F.sum("n_") / per).alias("pieces_"))
    pieces = rows.join(sizes, name).withColumn("piece", F.pmod(F.xxhash64(aid), F.col("pieces_")).cast("int"))
    return pieces.groupBy(name, "piece").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(aid, "pids")))).alias("persons"))


def split_key(key: Column) -> tuple[Column, Column]:
    """Pid and position of a ``pid-position`` key."""
    return F.split_part(key, F.lit("-"), F.lit(1)), F.split_part(key, F.lit("-"), F.lit(2)).try_cast("int")
