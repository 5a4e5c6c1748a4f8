"""Newest papers to candidate persons: split, candidates, overlaps, score, rank, threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namewright.operators import blocking, candidates, hashes, ranking
from namewright.plans.registry import query
from namewright.plans.views import line_sets, papers, split, sql
from namewright.sources.shared import written


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Slots (pid, aid, block, slot_year) and persons (block, aid, last_year), both with their distinct co-authors ``co`` and words ``wo`` as numbers."""
    parts = split(spark, d).select("pid", "aid", "block", "year", "is_new").join(line_sets(spark, d, numbers=True), "pid", "left")
    none = F.array().cast("array<bigint>")
    parts = written(parts.withColumns({"co": F.coalesce("co", none), "wo": F.coalesce("wo", none)}), "papers")
    slots = parts.where("is_new").select("pid", "aid", "block", F.col("year").alias("slot_year"), "co", "wo")
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)  # noqa: E731 - of one person's papers
    persons = parts.where("not is_new").groupBy("block", "aid").agg(F.max("year").alias("last_year"), every("co"), every("wo"))
    return slots, written(persons, "persons")


def good(slots: DataFrame, persons: DataFrame) -> DataFrame:
    """Each slot's best person, if good enough."""
    return candidates.best(slots, persons).where("score >= 2.0")


def pair_features(spark, d) -> DataFrame:
    """(pid, aid, coauthors, words, gap) for every slot and every person of its block."""
    return candidates.pairs(*sides(spark, d)).drop("score")


def pair_scores(spark, d) -> DataFrame:
    return candidates.pairs(*sides(spark, d))


def scores_above_zero(spark, d) -> DataFrame:
    """The pairs of ``pair_scores`` that can score above zero: those with something in common."""
    return candidates.pairs(*sides(spark, d), touching=True)


SCORES = dict(
    slots="SELECT pid, block, year AS slot_year FROM split WHERE is_new",
    olds="SELECT pid AS old, aid, block, year FROM split WHERE NOT is_new",
    persons="SELECT block, aid, max(year) AS last_year FROM olds GROUP BY ALL",
    co="SELECT s.pid, t.aid, count(*) AS n FROM slots s JOIN coauthors c ON s.pid = c.pid JOIN (SELECT DISTINCT block, aid, author FROM olds JOIN coauthors x ON x.pid = old) t ON t.block = s.block AND t.author = c.author GROUP BY ALL",
    wo="SELECT s.pid, t.aid, count(*) AS n FROM slots s JOIN words c ON s.pid = c.pid JOIN (SELECT DISTINCT block, aid, word FROM olds JOIN words x ON x.pid = old) t ON t.block = s.block AND t.word = c.word GROUP BY ALL",
    features="SELECT s.pid, p.aid, coalesce(co.n, 0) AS coauthors, coalesce(wo.n, 0) AS words, least(abs(slot_year - last_year), 20) AS gap FROM slots s JOIN persons p USING (block) LEFT JOIN co ON co.pid = s.pid AND co.aid = p.aid LEFT JOIN wo ON wo.pid = s.pid AND wo.aid = p.aid",
    scores="SELECT *, round(CAST(1.5 * coauthors + 0.33 * words - 0.1 * gap AS DOUBLE), 6) AS score FROM features",
)


def scores_sql(body: str, **more: str) -> str:
    return sql(body, "papers", "split", "coauthors", "words", **SCORES, **more)


BEST = "SELECT pid, aid, score FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, aid) AS rn FROM scores) WHERE rn = 1"


@query("flagship_assign", scores_sql(f"SELECT * FROM ({BEST}) WHERE score >= 2.0"))
def flagship_assign(spark, d):
    """Each new paper's best person, if good enough."""
    return good(*sides(spark, d))


@query("j06_candidate_features", scores_sql("SELECT pid, aid, coauthors, words, gap FROM features"))
def j06_candidate_features(spark, d):
    """The assembled feature table of all candidate pairs."""
    return pair_features(spark, d)


@query("w04_rank_candidates", scores_sql("SELECT pid, aid, score, CAST(row_number() OVER (PARTITION BY pid ORDER BY score DESC, aid) AS INTEGER) AS rank FROM scores"))
def w04_rank_candidates(spark, d):
    """Rank of every candidate in its slot."""
    return ranking.numbered(pair_scores(spark, d), ["pid"], [F.desc("score"), "aid"]).select("pid", "aid", "score", "rank")


@query("w05_top1", scores_sql(BEST))
def w05_top1(spark, d):
    """The best candidate of each slot."""
    return candidates.best(*sides(spark, d))


@query("w07_multi_assign", scores_sql("SELECT aid, list(pid ORDER BY pid) AS pids FROM scores WHERE score >= 4 GROUP BY aid"))
def w07_multi_assign(spark, d):
    """All papers above the threshold, per person."""
    return candidates.pairs(*sides(spark, d), least=4).groupBy("aid").agg(F.sort_array(F.collect_list("pid")).alias("pids"))


GAPS = "SELECT pid, max(score) AS s1, avg(score) AS mean, min(score) AS s0, max(CASE WHEN rn = 2 THEN score END) AS s2 FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, aid) AS rn FROM scores) GROUP BY pid"


@query("a21_top_gap", scores_sql(f"SELECT pid, round(CASE WHEN s1 = s0 THEN 0.0 ELSE (s1 - coalesce(s2, s1)) / (s1 - s0 + 1e-8) END, 6) AS top_gap FROM ({GAPS})"))
def a21_top_gap(spark, d):
    """Normalised gap between the two best."""
    return ranking.gap_of_best(candidates.two_best(*sides(spark, d)), ["pid"]).withColumn("top_gap", F.round("top_gap", 6))


@query("a22_nil_features", scores_sql(f"SELECT pid, round(s1, 7) AS best, round(mean, 7) AS mean, round(CASE WHEN s2 IS NULL THEN 0.0 ELSE (s1 - s2) / (1e-8 + s1 - mean) END, 7) AS gap_mean, round(CASE WHEN s2 IS NULL THEN 0.0 ELSE (s1 - s2) / (1e-8 + s1 - s0) END, 7) AS gap_min FROM ({GAPS})"))
def a22_nil_features(spark, d):
    """What a NIL decision looks at."""
    return ranking.nil_of_best(candidates.two_best(*sides(spark, d)), ["pid"]).select("pid", *[F.round(c, 7).alias(c) for c in ("best", "mean", "gap_mean", "gap_min")])


@query("e04_hits_mrr", scores_sql("SELECT round(avg(CAST(rn <= 1 AS INT)), 6) AS hits_1, round(avg(CAST(rn <= 3 AS INT)), 6) AS hits_3, round(avg(CAST(rn <= 5 AS INT)), 6) AS hits_5, round(avg(1.0 / rn), 6) AS mrr FROM (SELECT s.pid, s.aid, row_number() OVER (PARTITION BY s.pid ORDER BY score DESC, s.aid) AS rn FROM scores s) r JOIN papers p ON p.pid = r.pid AND p.aid = r.aid"))
def e04_hits_mrr(spark, d):
    """Where the true person ranks; better candidates are counted in tiles."""
    from namewright.operators.metrics import of_ranks

    slots, persons = sides(spark, d)
    out = of_ranks(candidates.ranks(slots.withColumnRenamed("aid", "true_aid"), persons, "true_aid"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def judged(spark, d) -> tuple[DataFrame, DataFrame]:
    """True persons of the slots and the flagship's assignments, written once for queries that read them twice."""
    slots, persons = sides(spark, d)
    return slots.select("pid", "aid"), written(good(slots, persons).select("pid", "aid"), "assigned")


ASSIGNED = f"SELECT * FROM ({BEST}) WHERE score >= 2.0"
TRUTH = "SELECT pid, aid FROM split WHERE is_new"


@query("e02_weighted_f1", scores_sql("SELECT round(wp / total, 6) AS precision, round(wr / total, 6) AS recall, round(CASE WHEN wp + wr = 0 THEN 0.0 ELSE 2 * (wp / total) * (wr / total) / (wp / total + wr / total) END, 6) AS f1 FROM (SELECT CAST(sum(t) AS DOUBLE) AS total, sum(t * CASE WHEN p = 0 THEN 0.0 ELSE hit * 1.0 / p END) AS wp, CAST(sum(hit) AS DOUBLE) AS wr FROM (SELECT t.aid, t.t, coalesce(p.p, 0) AS p, coalesce(h.hit, 0) AS hit FROM (SELECT aid, count(*) AS t FROM truth GROUP BY aid) t LEFT JOIN (SELECT aid, count(*) AS p FROM assigned GROUP BY aid) p USING (aid) LEFT JOIN (SELECT a.aid, count(*) AS hit FROM assigned a JOIN truth USING (pid, aid) GROUP BY a.aid) h USING (aid)))", assigned=ASSIGNED, truth=TRUTH))
def e02_weighted_f1(spark, d):
    """Weighted precision, recall and F1 of the flagship's assignments."""
    from namewright.operators.metrics import weighted

    out = weighted(*judged(spark, d), "aid", "pid")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("e03_macro_f", scores_sql("SELECT round(avg(a), 6) AS of_truth, round(avg(b), 6) AS of_prediction, round(avg(2 * a * b / (a + b + 1e-20)), 6) AS f1 FROM (SELECT coalesce(h.hit, 0) / (coalesce(t.t, 0) + 1e-20) AS a, coalesce(h.hit, 0) / (coalesce(p.p, 0) + 1e-20) AS b FROM (SELECT aid, count(*) AS t FROM truth GROUP BY aid) t FULL JOIN (SELECT aid, count(*) AS p FROM assigned GROUP BY aid) p USING (aid) LEFT JOIN (SELECT a.aid, count(*) AS hit FROM assigned a JOIN truth USING (pid, aid) GROUP BY a.aid) h USING (aid))", assigned=ASSIGNED, truth=TRUTH))
def e03_macro_f(spark, d):
    """Macro scores per person."""
    from namewright.operators.metrics import macro

    out = macro(*judged(spark, d), "aid", "pid")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("e07_incomplete", scores_sql("SELECT pid, 'truth' AS only_in FROM truth WHERE pid NOT IN (SELECT pid FROM assigned) UNION ALL SELECT pid, 'prediction' FROM assigned WHERE pid NOT IN (SELECT pid FROM truth)", assigned=ASSIGNED, truth=TRUTH))
def e07_incomplete(spark, d):
    """Slots that a prediction leaves out or makes up."""
    from namewright.operators.metrics import incomplete

    return incomplete(*judged(spark, d), ["pid"])


@query("a30_ensemble", scores_sql("SELECT pid, aid, round((5 * coauthors + 1 * words) / 6.0, 6) AS mean_score, round(0.6 * coauthors + 0.4 * words, 6) AS blend FROM features"))
def a30_ensemble(spark, d):
    """Weighted mean of the scorers of a row, and a two-way blend, in one pass."""
    weighted = [(5.0, F.col("coauthors")), (1.0, F.col("words"))]
    mean = sum((w * c for w, c in weighted[1:]), weighted[0][0] * weighted[0][1]) / sum(w for w, _ in weighted)
    return pair_features(spark, d).select("pid", "aid", F.round(mean, 6).alias("mean_score"), F.round(0.6 * F.col("coauthors") + 0.4 * F.col("words"), 6).alias("blend"))


@query("r02_negatives", scores_sql("SELECT pid, aid FROM (SELECT f.pid, f.aid, row_number() OVER (PARTITION BY f.pid ORDER BY md5('1|' || f.pid || '|' || f.aid), f.aid) AS rn FROM features f JOIN papers p ON p.pid = f.pid WHERE p.aid <> f.aid) WHERE rn <= 9"))
def r02_negatives(spark, d):
    """Nine other persons of the block per slot; pairs are hashed in tiles, their first nine become rows."""
    truth = papers(spark, d).select("pid", F.col("aid").alias("true_aid"))
    parts = written(split(spark, d).select("pid", "aid", "block", "is_new"), "papers")
    slots = parts.where("is_new").select("pid", "block").join(truth, "pid")
    persons = parts.where("not is_new").select("block", "aid").distinct()
    return hashes.first_by_hash(slots, persons, 9, seed=1).select("pid", "aid")


def floyd(k: int, seed: int, rows: str) -> str:
    """SQL of ``ranking.drawn_positions`` over rows of (pid, others): nested draws, a list ``have`` of positions."""
    text = f"SELECT *, CAST([] AS BIGINT[]) AS have FROM ({rows})"
    for i in range(1, k + 1):
        unit = f"CAST('0x' || substr(md5('{seed}|' || pid || '|{i}'), 1, 13) AS BIGINT) / 4503599627370496.0"
        drawn = f"SELECT *, greatest(others - {k}, 0) + {i} AS largest, least(CAST(floor({unit} * (greatest(others - {k}, 0) + {i})) AS BIGINT) + 1, greatest(others - {k}, 0) + {i}) AS draw FROM ({text})"
        text = f"SELECT * EXCLUDE (largest, draw, have), CASE WHEN {i} > others THEN have WHEN list_contains(have, draw) THEN list_append(have, largest) ELSE list_append(have, draw) END AS have FROM ({drawn})"
    return text


DRAWN = dict(
    persons="SELECT *, row_number() OVER (PARTITION BY block ORDER BY md5('8|' || aid), aid) AS place FROM (SELECT DISTINCT block, aid FROM split WHERE NOT is_new)",
    sizes="SELECT block, count(*) AS n FROM persons GROUP BY block",
    known="SELECT s.pid, s.block, n, p.place AS own, n - CASE WHEN p.place IS NULL THEN 0 ELSE 1 END AS others FROM split s JOIN sizes USING (block) LEFT JOIN persons p ON p.block = s.block AND p.aid = s.aid WHERE s.is_new",
)


@query("r02_drawn_negatives", sql("SELECT d.pid, p.aid FROM drawn d JOIN persons p ON p.block = d.block AND p.place = d.spot + CASE WHEN d.spot >= coalesce(d.own, n + 1) THEN 1 ELSE 0 END", "papers", "split", **DRAWN, drawn=f"SELECT *, unnest(have) AS spot FROM ({floyd(9, 8, 'SELECT * FROM known')})"))
def r02_drawn_negatives(spark, d):
    """Nine other persons of the block per slot, drawn by number; slots never meet all persons."""
    parts = split(spark, d)
    members = parts.where("not is_new").select("block", F.col("aid").alias("other")).distinct()
    return ranking.drawn_others(parts.where("is_new").select("pid", "block", "aid"), members, "block", "pid", "other", "aid", 9, seed=8).select("pid", F.col("other").alias("aid"))


NIL = "CAST('0x' || substr(md5('5|' || f.pid), 1, 8) AS BIGINT) < 858993459"


INJECTED = f"WITH_ SELECT pid, aid, label FROM (SELECT f.pid, f.aid, CASE WHEN f.aid = p.aid THEN 1 ELSE 0 END AS label, {NIL} AS nil, count(*) FILTER (f.aid <> p.aid) OVER (PARTITION BY f.pid) AS negatives, row_number() OVER (PARTITION BY f.pid ORDER BY CASE WHEN f.aid = p.aid THEN 1 ELSE 0 END, md5('6|' || f.pid || '|' || f.aid), f.aid) AS place FROM features f JOIN papers p ON p.pid = f.pid) WHERE negatives >= 10 AND CASE WHEN nil THEN label = 0 ELSE place > 1 END"


@query("r05_nil_injection", scores_sql(INJECTED.removeprefix("WITH_ ")))
def r05_nil_injection(spark, d):
    """Of the slots with ten negatives or more a fifth lose their true person and the others one negative.

    Negatives are counted by block and the lost one is found in tiles; every kept pair is a
    row of the result, made where its slot meets its block, and none is shuffled.
    """
    truth = papers(spark, d).select("pid", F.col("aid").alias("true_aid"))
    parts = written(split(spark, d).select("pid", "aid", "block", "is_new"), "papers")
    persons = written(parts.where("not is_new").select("block", "aid").distinct(), "persons")
    slots = parts.where("is_new").select("pid", "block").join(truth, "pid")
    sizes = persons.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    own = persons.select("block", F.col("aid").alias("true_aid"), F.lit(1).alias("own"))
    slots = slots.join(sizes, "block").join(own, ["block", "true_aid"], "left")
    enough = slots.withColumn("negatives", F.sum(F.col("n") - F.coalesce("own", F.lit(0))).over(Window.partitionBy("pid"))).where("negatives >= 10")
    slots = written(enough.select("pid", "block", "true_aid", ranking.share_of(enough, ["pid"], 0.2, seed=5).alias("nil")), "slots")
    lost = hashes.first_by_hash(slots.where("not nil"), persons, 1, seed=6).select("pid", F.col("aid").alias("lost"))
    known = written(slots.join(lost, "pid", "left"), "known")
    pairs = blocking.met_in_slices(known, persons, "block", "pid")
    kept = pairs.where(F.when(F.col("nil"), F.col("aid") != F.col("true_aid")).otherwise(F.col("aid") != F.col("lost")))
    return kept.select("pid", "aid", (F.col("aid") == F.col("true_aid")).cast("int").alias("label"))
