"""Bibliographic views of the driver's tables, in Spark and as SQL for the oracle.

papers = orders (a person = customer, a block = nation and segment), co-authors =
suppliers of the order's lines, words = words of the part names, organisation = the
supplier's nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.sources.shared import written


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def papers(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("pid"), F.col("o_custkey").alias("aid"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("venue"), F.col("o_orderdate").alias("odate"),
        F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("block"),
    )


def lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")


def coauthors(spark, d):
    return lines(spark, d).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("pid"), F.col("s_name").alias("author")).distinct()


def org_lines(spark, d):
    """(pid, author, org), a row for each line."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return lines(spark, d).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("pid"), F.col("s_name").alias("author"), F.col("n_name").alias("org"))


def orgs(spark, d):
    return org_lines(spark, d).distinct()


def words(spark, d):
    return lines(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("pid"), F.explode(F.split("p_name", " ")).alias("word")).distinct()


def line_sets(spark, d, numbers: bool = False) -> DataFrame:
    """(pid, co, wo): the distinct co-authors and words of every paper with lines, in one aggregation; null where a paper has none.

    With ``numbers`` a token is a number instead, the same for equal tokens of one call.
    """
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("author"))
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("listed"))
    if numbers:
        names, every = numbered(s.select("author"), "authors"), numbered(p.select(F.explode("listed").alias("word")), "words")
        s = s.join(names, "author").select("s_suppkey", F.col("number").alias("author"))
        p = p.select("p_partkey", F.explode(F.array_distinct("listed")).alias("word")).join(every, "word").groupBy("p_partkey").agg(F.sort_array(F.collect_set("number")).alias("listed"))
        s, p = written(s, "author-numbers"), written(p, "word-numbers")
    rows = lines(spark, d).join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    sets = rows.groupBy(F.col("l_orderkey").alias("pid")).agg(F.collect_set("author").alias("co"), F.array_distinct(F.flatten(F.collect_set("listed"))).alias("wo"))
    return sets.select("pid", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("co", "wo")])


def numbered(values: DataFrame, name: str) -> DataFrame:
    """Adds ``number`` to the distinct values that are not null; written, so that a value keeps its number."""
    return written(values.na.drop().distinct().withColumn("number", F.monotonically_increasing_id()), name)


def split(spark, d):
    from namewright.operators.ranking import temporal_split

    return temporal_split(papers(spark, d), "aid", ["odate", "pid"], 0.2, "unassigned")


CTES = {
    "papers": "SELECT o_orderkey AS pid, o_custkey AS aid, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS venue, o_orderdate AS odate, c_nationkey || '-' || c_mktsegment AS block FROM orders JOIN customer ON o_custkey = c_custkey",
    "coauthors": "SELECT DISTINCT l_orderkey AS pid, s_name AS author FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "orgs": "SELECT DISTINCT l_orderkey AS pid, s_name AS author, n_name AS org FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    "words": "SELECT DISTINCT pid, word FROM (SELECT l_orderkey AS pid, unnest(string_split(p_name, ' ')) AS word FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "split": "SELECT *, row_number() OVER (PARTITION BY aid ORDER BY odate, pid) > count(*) OVER (PARTITION BY aid) - floor(count(*) OVER (PARTITION BY aid) * 0.2) AS is_new FROM papers",
}
NEEDS = {"split": ("papers",)}


def sql(body: str, *names: str, **more: str) -> str:
    """WITH the named views (and more, in order) the body."""
    order: list[str] = []
    for n in names:
        for x in (*NEEDS.get(n, ()), n):
            if x not in order:
                order.append(x)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
