"""Queries of sources and sinks (S rows): each writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from namewright.plans.registry import query
from namewright.plans.views import coauthors, papers, sql, table, words
from namewright.sources import files
from namewright.sources.shared import fresh


@query("s01_keyed_json", "SELECT CAST(s_suppkey AS VARCHAR) AS pid, s_name AS title, CAST(s_nationkey AS VARCHAR) AS year FROM supplier")
def s01_keyed_json(spark, d):
    """{key: value} files, one record each, written by an aggregation over hashes of suppliers and exploded."""
    at = fresh(spark, "keyed")
    files.write_keyed_json(table(spark, d, "supplier"), at, "s_suppkey", F.col("s_name").alias("title"), F.col("s_nationkey").cast("string").alias("year"))
    got = files.read_keyed_json(spark, at, "struct<title:string,year:string>", "pid")
    return got.select("pid", "value.title", "value.year")


@query("s02_json_lines", sql("SELECT pid, aid, venue FROM papers", "papers"))
def s02_json_lines(spark, d):
    """One record per line."""
    at = fresh(spark, "json")
    files.write_json(papers(spark, d).select("pid", "aid", "venue"), at)
    return files.read_json(spark, at, "pid bigint, aid bigint, venue string")


@query("s03_store", "SELECT doc_id, lang, n_chars FROM documents")
def s03_store(spark, d):
    """A binary store in shards by language, merged on reading."""
    at = fresh(spark, "store")
    files.write_store(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), at, "lang")
    return spark.read.schema("doc_id bigint, n_chars bigint, lang string").parquet(at)


@query("s04_edge_lines", sql("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS pid, s_name AS token FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"))
def s04_edge_lines(spark, d):
    """Tab-separated edges with repeated lines, read without repeats."""
    at = fresh(spark, "edges")
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    files.write_edges(rows, at, "l_orderkey", "s_name")
    return files.read_edges(spark, at)


@query("s06_text_lines", sql("SELECT line, count(*) AS n FROM (SELECT s_name AS line FROM supplier UNION ALL SELECT n_name FROM nation UNION ALL SELECT p_name FROM part) GROUP BY line"))
def s06_text_lines(spark, d):
    """Attribute values of several tables, one per line."""
    at = fresh(spark, "lines")
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("v")).unionAll(table(spark, d, "nation").select("n_name")).unionAll(table(spark, d, "part").select("p_name"))
    files.write_lines(rows, at, F.col("v"))
    return spark.read.text(at).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("s08_weighted_edges", sql("SELECT CAST(aid AS VARCHAR) AS src, CAST(year AS VARCHAR) AS dst, CAST(count(*) AS DOUBLE) AS w FROM papers GROUP BY aid, year", "papers"))
def s08_weighted_edges(spark, d):
    """Src dst w."""
    at = fresh(spark, "weighted")
    files.write_edges(papers(spark, d).groupBy("aid", "year").agg(F.count(F.lit(1)).alias("w")), at, "aid", "year", "w", sep=" ")
    return files.read_weighted_edges(spark, at)


@query("s09_score_csv", sql("SELECT pid AS paper_id, aid AS author_id, CAST(year AS DOUBLE) / 2 AS pred FROM papers", "papers"))
def s09_score_csv(spark, d):
    """Scores with a header."""
    at = fresh(spark, "scores")
    files.write_scores(papers(spark, d).select(F.col("pid").alias("paper_id"), F.col("aid").alias("author_id"), (F.col("year") / 2).alias("pred")), at)
    return files.read_scores(spark, at, "paper_id bigint, author_id bigint, pred double")


@query("s11_vector_lines", "SELECT CAST(vec_id AS VARCHAR) AS word, len(embedding) AS dims, round(CAST(list_sum(embedding) AS DOUBLE), 3) AS total FROM embeddings")
def s11_vector_lines(spark, d):
    """Vectors as text lines."""
    at = fresh(spark, "vectors")
    e = table(spark, d, "embeddings")
    e.select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value")).write.text(at)
    got = files.read_vectors(spark, at)
    return got.select("word", F.size("vec").cast("bigint").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query("s13_bundle", "SELECT r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def s13_bundle(spark, d):
    """A bundle of tables as views, queried by SQL."""
    files.register(spark, d, ["region", "nation"])
    return spark.sql("SELECT r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")


NESTED = "SELECT block, aid, pid FROM papers"


@query("s15_nested_flatten", sql(NESTED, "papers"))
def s15_nested_flatten(spark, d):
    """Rows to {name: {aid: [pid]}} and back."""
    nested = files.by_name(papers(spark, d), "block", "aid", "pid")
    return files.flattened(nested, "block", "persons")


@query("s16_name_pivot", sql("SELECT block, count(DISTINCT aid) AS persons, count(*) AS papers FROM papers GROUP BY block", "papers"))
def s16_name_pivot(spark, d):
    """Persons and papers of each name's map."""
    nested = files.by_name(papers(spark, d), "block", "aid", "pid")
    sizes = F.aggregate(F.map_values("persons"), F.lit(0), lambda s, x: s + F.size(x))
    return nested.select("block", F.size("persons").alias("persons"), sizes.alias("papers")).groupBy("block").agg(F.sum("persons").alias("persons"), F.sum("papers").alias("papers"))


@query("s17_packed_key", sql("SELECT pid, CAST(pid % 7 AS INTEGER) AS aidx FROM papers", "papers"))
def s17_packed_key(spark, d):
    """Pid-position keys taken apart."""
    key = F.concat_ws("-", F.col("pid").cast("string"), (F.col("pid") % 7).cast("string"))
    pid, at = files.split_key(F.col("key"))
    return papers(spark, d).select(key.alias("key")).select(pid.cast("bigint").alias("pid"), at.alias("aidx"))


@query("s01_props_json", "SELECT event_id, count(*) AS keys FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) GROUP BY event_id")
def s01_props_json(spark, d):
    """JSON text in a column, as a map."""
    props = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.size(props).cast("bigint").alias("keys")).where("keys > 0")


@query("u05_edge_union", sql("SELECT pid, token FROM (SELECT pid, author AS token FROM coauthors UNION SELECT pid, word FROM words)", "coauthors", "words"))
def u05_edge_union(spark, d):
    """Relations in one table, without repeats."""
    return coauthors(spark, d).withColumnRenamed("author", "token").unionByName(words(spark, d).withColumnRenamed("word", "token")).distinct()


@query("s07_attribute_files", "SELECT attribute, line, count(*) AS n FROM (SELECT 'supplier' AS attribute, s_name AS line FROM supplier UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'part', p_name FROM part) GROUP BY attribute, line")
def s07_attribute_files(spark, d):
    """Values of several attributes, a folder for each, read back as one table."""
    at = fresh(spark, "attributes")
    kinds = {"supplier": "s_name", "nation": "n_name", "part": "p_name"}
    rows = [table(spark, d, t).select(F.lit(t).alias("attribute"), F.col(c).alias("v")) for t, c in kinds.items()]
    files.write_attributes(rows[0].unionAll(rows[1]).unionAll(rows[2]), at, "attribute", "v")
    return spark.read.text(at).groupBy("attribute", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("s10_computed_once", sql("SELECT block, count(*) AS n FROM papers GROUP BY block", "papers"))
def s10_computed_once(spark, d):
    """A table that is computed when it is first asked for; the second call reads it."""
    at = fresh(spark, "cache")
    files.computed_once(spark, at, lambda: papers(spark, d).groupBy("block").agg(F.count(F.lit(1)).alias("n")))
    return files.computed_once(spark, at, lambda: papers(spark, d).where("false").groupBy("block").agg(F.count(F.lit(1)).alias("n")))


@query("s12_vector_file", "SELECT CAST(vec_id AS VARCHAR) AS word, len(embedding) AS dims, round(CAST(list_sum(embedding) AS DOUBLE), 3) AS total FROM embeddings")
def s12_vector_file(spark, d):
    """Vectors below a line with their number and size."""
    at = fresh(spark, "vectors")
    e = table(spark, d, "embeddings")
    lines = e.select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"))
    head = e.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.max(F.size("embedding")).cast("string")).alias("value"))
    head.unionAll(lines).write.text(at)
    got = files.read_vectors(spark, at, header=True)
    return got.select("word", F.size("vec").cast("bigint").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))
