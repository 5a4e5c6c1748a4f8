"""Queries of projections, predicates, joins and set operations (P, J and U rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from namewright.functions import names, similarity
from namewright.operators import blocking, namejoin, nearest, ranking, tiles
from namewright.plans.registry import query
from namewright.plans.views import coauthors, lines, org_lines, orgs, papers, split, sql, table, words
from namewright.sources.shared import spread, written

AUTHORS = "SELECT pid, list(author ORDER BY author) AS authors FROM coauthors GROUP BY pid"


def author_lists(spark, d):
    return coauthors(spark, d).groupBy("pid").agg(F.sort_array(F.collect_list("author")).alias("authors"))


@query("p01_paper_attributes", sql("SELECT p.pid, lower(trim(a.authors[1])) AS author, list_filter(a.authors, lambda x, i: i <> 1) AS coauthors, lower(p.venue) AS venue, coalesce(o.org, '') AS org FROM papers p JOIN lists a USING (pid) LEFT JOIN orgs o ON o.pid = p.pid AND o.author = a.authors[1]", "papers", "coauthors", "orgs", lists=AUTHORS))
def p01_paper_attributes(spark, d):
    """Author, other authors, venue and organisation of a slot."""
    rows = papers(spark, d).join(author_lists(spark, d), "pid").withColumn("first", F.element_at("authors", 1))
    org = orgs(spark, d).withColumnRenamed("author", "first")
    out = rows.join(org, ["pid", "first"], "left")
    return out.select("pid", F.lower(F.trim("first")).alias("author"), F.filter("authors", lambda x, i: i != 0).alias("coauthors"), F.lower("venue").alias("venue"), F.coalesce("org", F.lit("")).alias("org"))


@query("p04_remove_first_equal", sql("SELECT pid, list_filter(authors, lambda x: x <> authors[len(authors)]) AS rest FROM lists", "coauthors", lists=AUTHORS))
def p04_remove_first_equal(spark, d):
    """The author list without the target's name, by position of its first match."""
    rows = author_lists(spark, d)
    at = F.array_position("authors", F.element_at("authors", -1))
    return rows.select("pid", F.filter("authors", lambda x, i: (i + 1) != at).alias("rest"))


@query("p05_truncate", sql("SELECT pid, authors[1:2] AS authors FROM lists", "coauthors", lists=AUTHORS))
def p05_truncate(spark, d):
    """The first k of a list."""
    return author_lists(spark, d).select("pid", F.slice("authors", 1, 2).alias("authors"))


@query("p06_names_with_many", sql("SELECT block, aid FROM (SELECT DISTINCT block, aid FROM papers) QUALIFY count(*) OVER (PARTITION BY block) > 10", "papers"))
def p06_names_with_many(spark, d):
    """Names shared by more than ten persons."""
    persons = papers(spark, d).select("block", "aid").distinct()
    many = persons.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 10")
    return persons.join(many.select("block"), "block", "left_semi")


@query("p08_score_threshold", "SELECT vec_id FROM embeddings WHERE round(CAST(embedding[1] AS DOUBLE), 6) >= 0.2")
def p08_score_threshold(spark, d):
    """Rows at or above a threshold, nulls out."""
    return table(spark, d, "embeddings").where(F.round(F.get("embedding", F.lit(0)).cast("double"), 6) >= 0.2).select("vec_id")


@query("p09_semi", sql("SELECT pid FROM papers WHERE pid IN (SELECT pid FROM coauthors)", "papers", "coauthors"))
def p09_semi(spark, d):
    """Papers with a line; the semi-join needs no distinct on the right."""
    return papers(spark, d).select("pid").join(table(spark, d, "lineitem"), F.col("pid") == F.col("l_orderkey"), "left_semi")


@query("p10_anti", sql("SELECT pid FROM papers WHERE pid NOT IN (SELECT pid FROM coauthors)", "papers", "coauthors"))
def p10_anti(spark, d):
    """P10: papers without a line."""
    return papers(spark, d).select("pid").join(table(spark, d, "lineitem"), F.col("pid") == F.col("l_orderkey"), "left_anti")


NAME_PAIRS = "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"


@query("p13_edge_weight", sql("SELECT a, b, w FROM (SELECT a.s_suppkey AS a, b.s_suppkey AS b, round((CASE WHEN abs(a.s_acctbal - b.s_acctbal) / 1000 < 0.5 THEN 0.0 ELSE abs(a.s_acctbal - b.s_acctbal) / 1000 END + 1.0) / 2, 6) AS w FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey) WHERE w > 0"))
def p13_edge_weight(spark, d):
    """Mean of the parts in use, parts under the threshold set to zero."""
    from namewright.operators.graph import edge_weight

    s = table(spark, d, "supplier")
    a, b = s.select("s_nationkey", F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x")), s.select("s_nationkey", F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("y"))
    pairs = blocking.met_in_slices(a, b, "s_nationkey", "a").where("a < b")
    w = edge_weight(F.abs(F.col("x") - F.col("y")) / 1000, F.lit(1.0), F.lit(0.0), use_venue=False, least=0.5)
    return pairs.select("a", "b", F.round(w, 6).alias("w")).where("w > 0")


TIERS = "SELECT s_suppkey, 0 AS tier, s_name || '|' || s_nationkey AS key FROM supplier UNION ALL SELECT s_suppkey, 1, substr(s_name, length(s_name) - 1) FROM supplier UNION ALL SELECT s_suppkey, 2, substr(s_name, length(s_name)) FROM supplier"
CTIERS = "SELECT c_custkey, 0 AS tier, replace(c_name, 'Customer', 'Supplier') || '|' || c_nationkey AS key FROM customer UNION ALL SELECT c_custkey, 1, substr(c_name, length(c_name) - 1) FROM customer UNION ALL SELECT c_custkey, 2, substr(c_name, length(c_name)) FROM customer"


@query("p15_tiered_match", sql("SELECT c_custkey, s_suppkey, CAST(tier AS INTEGER) AS tier FROM (SELECT c_custkey, s_suppkey, c.tier, min(c.tier) OVER (PARTITION BY c_custkey) AS best FROM ct c JOIN st s ON c.tier = s.tier AND c.key = s.key) WHERE tier = best", st=TIERS, ct=CTIERS))
def p15_tiered_match(spark, d):
    """Exact key, else the last two characters, else the last one; the first tier that matches wins."""
    c, s = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    exact = lambda name, nation: F.concat_ws("|", name, F.col(nation).cast("string"))
    tiers = [
        (exact(F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier")), "c_nationkey"), exact(F.col("s_name"), "s_nationkey")),
        (F.substring("c_name", -2, 2), F.substring("s_name", -2, 2)),
        (F.substring("c_name", -1, 1), F.substring("s_name", -1, 1)),
    ]
    return blocking.tiered(c, s, tiers, "c_custkey").select("c_custkey", "s_suppkey", "tier")


@query("j01_paper_lookup", sql("SELECT c.pid, c.author, p.year, p.venue FROM coauthors c JOIN papers p USING (pid)", "papers", "coauthors"))
def j01_paper_lookup(spark, d):
    """Pid to paper."""
    return coauthors(spark, d).join(papers(spark, d), "pid").select("pid", "author", "year", "venue")


KEY = "array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower({}), '[ .\\-_]'), lambda x: x <> ''))), '')"


@query("j02_name_key_join", "SELECT a.p_partkey AS a, min(b.p_partkey) AS b, count(b.p_partkey) AS n FROM (SELECT p_partkey, " + KEY.format("p_name") + " AS k FROM part) a LEFT JOIN (SELECT p_partkey, " + KEY.format("p_name") + " AS k FROM part) b ON a.k = b.k AND a.p_partkey <> b.p_partkey GROUP BY a.p_partkey")
def j02_name_key_join(spark, d):
    """Names with the same tokens in any order, left join; groups are summed before they meet."""
    keyed = table(spark, d, "part").select("p_partkey", names.name_key(F.col("p_name")).alias("k"))
    least = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("p_partkey").alias("first"))
    second = keyed.join(least, "k").where("p_partkey > first").groupBy("k").agg(F.min("p_partkey").alias("second"))
    rows = keyed.join(least, "k").join(second, "k", "left")
    return rows.select(F.col("p_partkey").alias("a"), F.when(F.col("p_partkey") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("b"), (F.col("m") - 1).alias("n"))


@query("j04_nearest_name", "WITH nm AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part), mi AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS slot FROM part), dist AS (SELECT slot, name, list_sum(list_transform(range(97, 123), lambda c: abs((length(slot) - length(replace(slot, chr(CAST(c AS INTEGER)), ''))) - (length(name) - length(replace(name, chr(CAST(c AS INTEGER)), '')))))) AS distance FROM mi, nm), r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY distance, name) AS rank, min(distance) OVER (PARTITION BY slot) AS least FROM dist) SELECT slot, name, CAST(distance AS INTEGER) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank = 1 OR (rank = 2 AND least >= 2)")
def j04_nearest_name(spark, d):
    """The nearest names by letters, one or two."""
    p = table(spark, d, "part")
    names_ = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).distinct()
    slots = p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("slot")).distinct()
    return nearest.nearest_names(slots, names_, "slot", "name")


@query("j07_block_pairs", sql("SELECT x.block, x.pid AS a, y.pid AS b FROM split x JOIN split y ON x.block = y.block AND x.pid < y.pid WHERE x.is_new AND y.is_new", "papers", "split"))
def j07_block_pairs(spark, d):
    """Pairs of new papers in a block."""
    return blocking.block_pairs(written(split(spark, d).where("is_new").select("block", "pid"), "new-papers"), "block", "pid", ordered=True)


@query("j08_token_overlap", sql("SELECT a.pid AS a, b.pid AS b, count(*) AS common FROM (SELECT block, pid, word FROM split JOIN words USING (pid) WHERE is_new) a JOIN (SELECT block, pid, word FROM split JOIN words USING (pid) WHERE is_new) b ON a.block = b.block AND a.word = b.word AND a.pid < b.pid GROUP BY a.pid, b.pid HAVING count(*) > 2", "papers", "split", "words"))
def j08_token_overlap(spark, d):
    """New papers of a block with more than two common words."""
    from namewright.plans.pairs import new_words

    return tiles.within(new_words(spark, d), "block", "pid", 1024, tiles.common_tokens(3), "block string, a bigint, b bigint, common bigint").drop("block")


@query("j09_author_overlap", sql("SELECT s.pid, t.aid, count(*) AS common FROM (SELECT block, pid, word FROM split JOIN words USING (pid) WHERE is_new) s JOIN (SELECT DISTINCT block, aid, word FROM split JOIN words USING (pid) WHERE NOT is_new) t ON s.block = t.block AND s.word = t.word GROUP BY s.pid, t.aid HAVING count(*) > 2", "papers", "split", "words"))
def j09_author_overlap(spark, d):
    """New papers and persons with more than two common words."""
    rows = split(spark, d).join(words(spark, d), "pid")
    slots = written(rows.where("is_new").groupBy("block", "pid").agg(F.collect_list("word").alias("tokens")), "slot-words")
    persons = written(rows.where("not is_new").groupBy("block", "aid").agg(F.collect_set("word").alias("tokens")), "person-words")
    return tiles.between(slots, persons, "block", ("pid", "aid"), 2048, tiles.common_between(3), "pid bigint, aid bigint, common bigint")


@query("j12_default_lookup", "WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> ''))) AS token FROM documents), s AS (SELECT lower(n_name) AS token, CAST(n_nationkey AS DOUBLE) AS score FROM nation) SELECT doc_id, round(sum(coalesce(score, 10.42)), 2) AS total FROM t LEFT JOIN s USING (token) GROUP BY doc_id")
def j12_default_lookup(spark, d):
    """Token scores with a default for unknown ones."""
    tokens = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != ""))).alias("token"))
    scores = table(spark, d, "nation").select(F.lower("n_name").alias("token"), F.col("n_nationkey").cast("double").alias("score"))
    return blocking.looked_up(tokens, scores, ["token"], "score", 10.42).groupBy("doc_id").agg(F.round(F.sum("score"), 2).alias("total"))


@query("j14_vector_lookup", "SELECT d.doc_id, coalesce(e.embedding, list_transform(range(64), lambda i: 0.0::FLOAT)) AS vec, coalesce(e.embedding, list_transform(range(64), lambda i: 1.0::FLOAT)) AS vec_or_ones FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def j14_vector_lookup(spark, d):
    """Whole vectors, with zeros, or ones, for unknown ids."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    constant = lambda x: F.array_repeat(F.lit(x).cast("float"), 64)
    found = table(spark, d, "documents").select("doc_id").join(e, "doc_id", "left")
    return found.select("doc_id", F.coalesce("vec", constant(0.0)).alias("vec"), F.coalesce("vec", constant(1.0)).alias("vec_or_ones"))


@query("j16_coauthor_semi", sql("SELECT DISTINCT s.pid FROM split s JOIN coauthors c USING (pid) JOIN (SELECT DISTINCT block, author FROM split JOIN coauthors USING (pid) WHERE NOT is_new) t ON t.block = s.block AND t.author = c.author WHERE is_new", "papers", "split", "coauthors"))
def j16_coauthor_semi(spark, d):
    """New papers with any co-author that a profile of the block has."""
    rows = split(spark, d).join(coauthors(spark, d), "pid")
    return rows.where("is_new").join(rows.where("not is_new").select("block", "author"), ["block", "author"], "left_semi").select("pid").distinct()


@query("j17_main_author", sql("SELECT pid, CAST(min(i) - 1 AS INTEGER) AS pos FROM (SELECT pid, author, row_number() OVER (PARTITION BY pid ORDER BY author) AS i, max(author) OVER (PARTITION BY pid) AS target FROM coauthors) WHERE author = target GROUP BY pid", "coauthors"))
def j17_main_author(spark, d):
    """Position of the first author that has the target's name."""
    rows = author_lists(spark, d)
    return blocking.main_author_position(rows, "pid", "authors", F.array_max("authors"))


#: Lines that a task holds where papers' lines are grouped.
LINES = 250_000


@query("j19_org_by_name", sql("SELECT pid, author, max(org) AS org FROM orgs WHERE org <> '' GROUP BY pid, author", "orgs"))
def j19_org_by_name(spark, d):
    """The organisation of a paper's author by name."""
    rows = spread(org_lines(spark, d), table(spark, d, "lineitem").count(), LINES, "pid")
    return blocking.by_name_org(rows.withColumn("pos", F.col("org")), "pid", "author", "org", "pos")


@query("u02_overwrite_union", "SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'xx', source FROM documents WHERE doc_id % 3 = 0")
def u02_overwrite_union(spark, d):
    """Rows of the second table replace those of the first."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return ranking.overwrite_union(docs, docs.where("doc_id % 3 = 0").withColumn("lang", F.lit("xx")), ["doc_id"])


@query("u03_keep_last", sql("SELECT aid, pid, year FROM papers QUALIFY row_number() OVER (PARTITION BY aid ORDER BY odate DESC, pid DESC) = 1", "papers"))
def u03_keep_last(spark, d):
    """Of rows with equal keys the last."""
    return ranking.keep_last(papers(spark, d), ["aid"], [F.desc("odate"), F.desc("pid")]).select("aid", "pid", "year")


@query("u04_set_sizes", sql("SELECT a.block, CAST(len(list_intersect(a.v, b.v)) AS BIGINT) AS both_, CAST(len(list_distinct(list_concat(a.v, b.v))) AS BIGINT) AS any_, CAST(len(list_filter(a.v, lambda x: NOT list_contains(b.v, x))) AS BIGINT) AS rest FROM n a JOIN o b ON a.block = b.block", "papers", "split", "coauthors", n="SELECT block, list(DISTINCT author) AS v FROM split JOIN coauthors USING (pid) WHERE is_new GROUP BY block", o="SELECT block, list(DISTINCT author) AS v FROM split JOIN coauthors USING (pid) WHERE NOT is_new GROUP BY block"))
def u04_set_sizes(spark, d):
    """Sizes of intersection, union and difference of a block's new and old authors, counted and never collected."""
    n = table(spark, d, "lineitem").count()
    named = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("author"))
    rows = spread(lines(spark, d).select(F.col("l_orderkey").alias("pid"), "l_suppkey"), n, LINES, "pid").join(spread(split(spark, d).select("pid", "block", "is_new"), n, LINES, "pid"), "pid").join(named, "l_suppkey")
    each = rows.groupBy("block", "author").agg(F.max("is_new").alias("new"), F.max(~F.col("is_new")).alias("old"))
    size = lambda c: F.sum(c.cast("bigint"))
    out = each.groupBy("block").agg(size(F.col("new") & F.col("old")).alias("both_"), F.count(F.lit(1)).alias("any_"), size(F.col("new") & ~F.col("old")).alias("rest"), size(F.col("new")).alias("n"), size(F.col("old")).alias("m"))
    return out.where("n > 0 and m > 0").drop("n", "m")


@query("u06_recombine", "SELECT doc_id, quality, CASE WHEN quality = 1 THEN 'normal' ELSE 'outlier' END AS kind FROM labels")
def u06_recombine(spark, d):
    """Both classes in one pass, without a split and a union."""
    return table(spark, d, "labels").select("doc_id", "quality", F.when(F.col("quality") == 1, "normal").otherwise("outlier").alias("kind"))


def short_name(name: str):
    """First initial and last word."""
    tokens = F.split(name, " ")
    return F.concat_ws(" ", F.substring(F.element_at(tokens, 1), 1, 1), F.element_at(tokens, -1))


@query("j03_fuzzy_names")
def j03_fuzzy_names(spark, d):
    """Candidates by name rules: distinct names meet by the signatures of the rules, each pair is judged once, the strictest rule wins."""
    p = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    slots = p.select(F.when(F.xxhash64("name") % 2 == 0, short_name("name")).otherwise(F.array_join(F.reverse(F.split("name", " ")), " ")).alias("slot")).distinct()
    return namejoin.matching_names(slots, p, "slot", "name").groupBy("slot").agg(F.min(F.struct("rule", "name")).alias("first_")).select("slot", "first_.name", "first_.rule")


@query("j15_author_lists")
def j15_author_lists(spark, d):
    """Names of a new paper, every other one short, against the names on its person's older papers: how many of these match any of those by a rule."""
    rows = split(spark, d).select("pid", "aid", "is_new")
    named = written(rows.join(lines(spark, d).withColumnRenamed("l_orderkey", "pid"), "pid").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey").select("pid", "aid", "is_new", "l_linenumber", "name"), "named")
    mine = named.where("is_new").select("pid", F.when(F.col("l_linenumber") % 2 == 0, short_name("name")).otherwise(F.col("name")).alias("name"))
    return namejoin.matched_lists(rows.where("is_new").select("pid", "aid"), mine, named.where("not is_new").select("aid", "name"), "pid", "aid", "name")


@query("p11_columns", "SELECT o_orderkey AS pid, o_custkey AS aid FROM orders WHERE o_custkey IS NOT NULL")
def p11_columns(spark, d):
    """The key columns of rows with a candidate; only these two columns are read."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_custkey").alias("aid")).where(F.col("aid").isNotNull())


@query("u01_union_all", "SELECT s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer")
def u01_union_all(spark, d):
    """Tables one after the other, repeats kept."""
    return table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).unionByName(table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))


@query("w11_sorted_scores", "SELECT l_orderkey, l_partkey, l_discount FROM lineitem ORDER BY l_orderkey DESC, l_discount DESC, l_partkey DESC")
def w11_sorted_scores(spark, d):
    """A global order over several keys, by range partitions."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount").orderBy(F.desc("l_orderkey"), F.desc("l_discount"), F.desc("l_partkey"))


@query("v20_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8.0::DOUBLE, 2) AS x, round_even(-l_quantity / 16.0::DOUBLE, 3) AS y FROM lineitem")
def v20_half_even(spark, d):
    """Halves to the even neighbour, as features are rounded."""
    q = F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(q / 8.0, 2).alias("x"), F.bround(-q / 16.0, 3).alias("y"))
