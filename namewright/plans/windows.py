"""Queries of windows, splits, folds and samples (W and R rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from namewright.operators import ranking
from namewright.plans.registry import query
from namewright.plans.views import papers, sql, table


@query("w01_split_unassigned", sql("SELECT pid, aid, is_new FROM split", "papers", "split"))
def w01_split_unassigned(spark, d):
    """The newest fifth, its size rounded down."""
    return ranking.temporal_split(papers(spark, d), "aid", ["odate", "pid"], 0.2, "unassigned").select("pid", "aid", "is_new")


@query("w01_split_profile", sql("SELECT pid, aid, row_number() OVER (PARTITION BY aid ORDER BY odate, pid) > floor(count(*) OVER (PARTITION BY aid) * 0.8) AS is_new FROM papers", "papers"))
def w01_split_profile(spark, d):
    """The oldest four fifths, their size rounded down."""
    return ranking.temporal_split(papers(spark, d), "aid", ["odate", "pid"], 0.2, "profile").select("pid", "aid", "is_new")


@query("w03_newest_k", sql("SELECT pid, aid FROM papers QUALIFY row_number() OVER (PARTITION BY aid ORDER BY year DESC, pid) <= 5", "papers"))
def w03_newest_k(spark, d):
    """The five newest papers of a person."""
    return ranking.top_k(papers(spark, d), ["aid"], [F.desc("year"), "pid"], 5).select("pid", "aid")


@query("w12_token_budget", "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 1500")
def w12_token_budget(spark, d):
    """Turns while the running size stays within the budget."""
    rows = table(spark, d, "conversations").withColumn("size", F.length("text"))
    return ranking.running_budget(rows, ["conv_id"], ["turn", "role", "text"], "size", 1500).select("conv_id", "turn", "used")


@query("w13_renumber", sql("SELECT pid, block, CAST(row_number() OVER (PARTITION BY block ORDER BY pid) - 1 AS INTEGER) AS idx FROM papers", "papers"))
def w13_renumber(spark, d):
    """0 .. n - 1 within a block."""
    return ranking.number_large(papers(spark, d), ["block"], ["pid"], "rn").select("pid", "block", (F.col("rn") - 1).cast("int").alias("idx"))


@query("w14_adjacent_dedup", "SELECT conv_id, turn, role FROM conversations QUALIFY lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) IS NULL OR lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) <> role")
def w14_adjacent_dedup(spark, d):
    """Rows that differ from the row before."""
    return ranking.adjacent_distinct(table(spark, d, "conversations"), ["conv_id"], ["turn", "text"], "role").select("conv_id", "turn", "role")


@query("w15_folds", sql("SELECT pid, block, CAST(ntile(5) OVER (PARTITION BY block ORDER BY md5('3|' || pid), pid) - 1 AS INTEGER) AS fold FROM papers", "papers"))
def w15_folds(spark, d):
    """Equal chunks of a seeded order."""
    return ranking.hashed_folds(papers(spark, d), ["block"], ["pid"], 5, seed=3).select("pid", "block", "fold")


@query("w16_balanced_folds", sql("SELECT block, CAST((row_number() OVER (PARTITION BY n < 10 ORDER BY md5('4|' || block), block) - 1) % 5 AS INTEGER) AS fold FROM (SELECT block, count(DISTINCT aid) AS n FROM papers GROUP BY block)", "papers"))
def w16_balanced_folds(spark, d):
    """Small and large groups dealt out to folds separately."""
    groups = papers(spark, d).select("block", "aid").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return ranking.balanced_folds(groups, "n", 10, [ranking.hashed_order("block", seed=4), "block"], 5).select("block", "fold")


STRATA = "SELECT *, row_number() OVER (PARTITION BY n < 20 ORDER BY md5('4|' || block), block) AS rn, count(*) OVER (PARTITION BY n < 20) AS size, CASE WHEN n < 20 THEN 0 ELSE (SELECT count(*) FROM g WHERE n < 20) % 5 END AS start FROM g"
RUN_ENDS = "SELECT i, s.block, s.rn, sum(size // 5 + CASE WHEN (5 + i - start) % 5 < size % 5 THEN 1 ELSE 0 END) OVER (PARTITION BY s.block ORDER BY i) AS upto FROM s, range(5) r(i)"


@query("w16_published_folds", sql("SELECT block, CAST(count(*) FILTER (rn > upto) AS INTEGER) AS fold FROM ends GROUP BY block", "papers", g="SELECT block, count(DISTINCT aid) AS n FROM papers GROUP BY block", s=STRATA, ends=RUN_ENDS))
def w16_published_folds(spark, d):
    """Cut at twenty persons, runs of a seeded order, the folds of one more rotating from stratum to stratum."""
    groups = papers(spark, d).select("block", "aid").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return ranking.published_folds(groups, "n", 20, [ranking.hashed_order("block", seed=4), "block"], 5).select("block", "fold")


@query("r01_split_names", sql("SELECT block, CAST('0x' || substr(md5('0|' || block), 1, 8) AS BIGINT) < 3435973836 AS is_train FROM (SELECT DISTINCT block FROM papers)", "papers"))
def r01_split_names(spark, d):
    """About 80 % of the names, by hash, without a shuffle of their own."""
    names = papers(spark, d).select("block").distinct()
    return names.select("block", ranking.share_of(names, ["block"], 0.8).alias("is_train"))


@query("r03_sample_papers", sql("SELECT pid, aid FROM papers QUALIFY row_number() OVER (PARTITION BY aid ORDER BY md5('2|' || aid || '|' || pid), pid) <= 6", "papers"))
def r03_sample_papers(spark, d):
    """At most six papers of a person, without replacement."""
    return ranking.sample_per_group(papers(spark, d), ["aid"], ["pid"], 6, seed=2).select("pid", "aid")


@query("r04_random_slots", sql("SELECT aid, CAST(i AS INTEGER) AS draw, pid FROM (SELECT aid, n, i, CASE WHEN n <= 20 THEN i + 1 ELSE 1 + CAST(floor(CAST('0x' || substr(md5('4|' || aid || '|' || i), 1, 8) AS BIGINT) * n / 4294967296.0) AS BIGINT) END AS place FROM (SELECT aid, count(*) AS n FROM placed GROUP BY aid) c, range(20) r(i) WHERE i < n) JOIN placed USING (aid, place)", "papers", placed="SELECT aid, pid, row_number() OVER (PARTITION BY aid ORDER BY odate, pid) AS place FROM papers WHERE aid IN (SELECT aid FROM papers GROUP BY aid HAVING count(*) >= 2) AND block IN (SELECT block FROM papers GROUP BY block HAVING count(DISTINCT aid) > 2)"))
def r04_random_slots(spark, d):
    """Slots of persons with two papers or more in names of more than two persons: all papers of up to twenty, else twenty draws with replacement."""
    rows = papers(spark, d)
    blocks = rows.select("block", "aid").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("block")
    persons = rows.groupBy("aid").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("aid")
    kept = rows.join(blocks, "block", "left_semi").join(persons, "aid", "left_semi").select("aid", "pid", "odate")
    return ranking.drawn_with_replacement(kept, ["aid"], ["odate", "pid"], 20, seed=4).select("aid", "draw", "pid")


@query("r06_balance", "SELECT doc_id, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY md5('6|' || doc_id), doc_id) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))")
def r06_balance(spark, d):
    """Every class as large as the smallest."""
    return ranking.balance_classes(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", ["doc_id"], seed=6)


@query("r07_down_sample", "SELECT doc_id, quality FROM labels WHERE quality = 0 OR CAST('0x' || substr(md5('7|' || doc_id), 1, 8) AS BIGINT) < 3865470566")
def r07_down_sample(spark, d):
    """90 % of the positives, in a seeded order."""
    rows = table(spark, d, "labels").select("doc_id", "quality")
    return rows.where((F.col("quality") == 0) | ranking.share_of(rows, ["doc_id"], 0.9, seed=7))


@query("r08_leave_self_out", sql("SELECT a.pid, b.pid AS other FROM split a JOIN papers b ON a.aid = b.aid AND a.pid <> b.pid WHERE a.is_new", "papers", "split"))
def r08_leave_self_out(spark, d):
    """Each new paper with the profile of its person, the paper itself left out; one row for each paper of the profile."""
    rows = papers(spark, d).select("aid", F.col("pid").alias("other"))
    new = ranking.temporal_split(papers(spark, d), "aid", ["odate", "pid"], 0.2, "unassigned").where("is_new").select("aid", "pid")
    return new.join(rows, "aid").where("pid <> other").select("pid", "other")
