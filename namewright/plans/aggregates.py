"""Queries of aggregations (A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from namewright.functions import similarity, text
from namewright.functions.similarity import KERNELS
from namewright.operators import ranking, terms, tiles, vectors
from namewright.plans.registry import query
from namewright.plans.views import coauthors, line_sets, orgs, papers, split, sql, table, words
from namewright.sources.shared import spread

TOKENS = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim({})), '[!“”\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~—～’]+', ' ', 'g'), '\\s{{2,}}', ' ', 'g')), ' '), lambda w: length(w) > 1)"
DOC_TOKENS = "SELECT doc_id, lang, source, " + TOKENS.format("text") + " AS tokens FROM documents"


def doc_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", text.tokens(F.col("text")).alias("tokens"))


@query("a01_document_frequency", sql("SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM t) GROUP BY token", t=DOC_TOKENS))
def a01_document_frequency(spark, d):
    """A01, F01, F02."""
    return terms.document_frequency(doc_tokens(spark, d), "tokens")


@query("a02_idf", sql("SELECT token, round(ln((SELECT count(*) FROM documents) / (count(*) + 1.0)), 6) AS idf FROM (SELECT unnest(list_distinct(tokens)) AS token FROM t) GROUP BY token", t=DOC_TOKENS))
def a02_idf(spark, d):
    """ln(N / (df + 1))."""
    docs = doc_tokens(spark, d)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return terms.document_frequency(docs, "tokens").join(F.broadcast(n)).select("token", F.round(terms.idf(F.col("n"), F.col("df")), 6).alias("idf"))


#: n-grams of one and two words over the part names of a person's papers.
TITLES = "SELECT aid, pid, list(word ORDER BY word) AS tokens FROM papers JOIN words USING (pid) GROUP BY aid, pid"
GRAMS = "SELECT aid, ngram, count(*) AS n FROM (SELECT aid, unnest(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) AS ngram FROM titles) GROUP BY aid, ngram"


#: Papers whose n-grams a task holds.
PAPERS = 25_000


def titles(spark, d):
    """(aid, pid, tokens), a person's papers in one partition, so that what is counted of persons and their n-grams moves no further."""
    rows = papers(spark, d).groupBy("aid", "pid").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(line_sets(spark, d).where("wo is not null"), "pid").select("aid", "pid", F.sort_array(F.flatten(F.array_repeat("wo", F.col("times").cast("int")))).alias("tokens"))
    return spread(rows, table(spark, d, "orders").count(), PAPERS, "aid")


@query("a03_ngram_counts", sql("SELECT * FROM grams", "papers", "words", titles=TITLES, grams=GRAMS))
def a03_ngram_counts(spark, d):
    """N-grams of each person."""
    return terms.ngram_counts(titles(spark, d), "aid", "tokens", range(1, 3))


LENGTHS = "SELECT aid, sum(len(tokens)) AS length FROM titles GROUP BY aid"
TFIDF = "SELECT aid, ngram, n / length * ln((SELECT count(*) FROM lengths) / (df + 1.0)) AS tfidf FROM grams JOIN lengths USING (aid) JOIN (SELECT ngram, count(*) AS df FROM grams GROUP BY ngram) USING (ngram)"


def tfidf(spark, d):
    rows = titles(spark, d)
    return terms.owner_tfidf(terms.ngram_counts(rows, "aid", "tokens", range(1, 3)), terms.owner_lengths(rows, "aid", "tokens"), "aid")


@query("a04_token_length", sql("SELECT aid, CAST(length AS BIGINT) AS length FROM lengths", "papers", "words", titles=TITLES, lengths=LENGTHS))
def a04_token_length(spark, d):
    """A04."""
    return terms.owner_lengths(titles(spark, d), "aid", "tokens")


@query("a05_author_tfidf", sql("SELECT aid, ngram, round(tfidf, 6) AS tfidf FROM scores", "papers", "words", titles=TITLES, grams=GRAMS, lengths=LENGTHS, scores=TFIDF))
def a05_author_tfidf(spark, d):
    """A05."""
    return tfidf(spark, d).withColumn("tfidf", F.round("tfidf", 6))


@query("a06_mean_score", sql("SELECT pid, aid, round(avg(coalesce(tfidf, 0.0)), 6) AS score FROM (SELECT pid, aid, unnest(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) AS ngram FROM titles) LEFT JOIN scores USING (aid, ngram) GROUP BY pid, aid", "papers", "words", titles=TITLES, grams=GRAMS, lengths=LENGTHS, scores=TFIDF))
def a06_mean_score(spark, d):
    """A06."""
    return terms.mean_ngram_score(titles(spark, d), "pid", "aid", "tokens", range(1, 3)).withColumn("score", F.round("score", 6))


@query("a07_top_terms", sql("SELECT aid, word AS term, score FROM (SELECT aid, word, round(sum(w / norm), 9) AS score, row_number() OVER (PARTITION BY aid ORDER BY round(sum(w / norm), 9) DESC, word) AS rn FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY aid, pid)) AS norm FROM (SELECT t.aid, t.pid, t.word, ln((1 + docs) / (1.0 + df)) + 1 AS w FROM t JOIN (SELECT aid, count(DISTINCT pid) AS docs FROM t GROUP BY aid) USING (aid) JOIN (SELECT aid, word, count(*) AS df FROM t GROUP BY aid, word) f ON f.aid = t.aid AND f.word = t.word)) GROUP BY aid, word) WHERE rn <= 10", "papers", "words", t="SELECT aid, pid, word FROM papers JOIN words USING (pid)"))
def a07_top_terms(spark, d):
    """Ten words per person."""
    return terms.top_terms(titles(spark, d), "aid", "pid", "tokens", 10)


@query("a08_coauthor_counter", sql("SELECT aid, author, count(*) AS n FROM papers JOIN coauthors USING (pid) GROUP BY aid, author", "papers", "coauthors"))
def a08_coauthor_counter(spark, d):
    """Papers with each co-author."""
    return papers(spark, d).join(coauthors(spark, d), "pid").groupBy("aid", "author").agg(F.count(F.lit(1)).alias("n"))


@query("a09_coauthor_features", sql("SELECT aid, count(DISTINCT author) AS distinct_, count(*) AS total, count(*) FILTER (WHERE n > 1) AS repeated FROM (SELECT aid, author, count(*) OVER (PARTITION BY aid, author) AS n FROM papers JOIN coauthors USING (pid)) GROUP BY aid", "papers", "coauthors"))
def a09_coauthor_features(spark, d):
    """Distinct, total, and co-authorships of repeated co-authors."""
    n = papers(spark, d).join(coauthors(spark, d), "pid").groupBy("aid", "author").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("aid").agg(F.count(F.lit(1)).alias("distinct_"), F.sum("n").alias("total"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"))


@query("a10_list_statistics", "SELECT o_custkey AS aid, round(sum(o_totalprice), 4) AS sum_, round(avg(o_totalprice), 7) AS mean, max(o_totalprice) AS max_, min(o_totalprice) AS min_, round(stddev_pop(o_totalprice), 4) AS std, round(median(o_totalprice), 7) AS median_, round(max(o_totalprice) - min(o_totalprice), 4) AS spread FROM orders GROUP BY o_custkey")
def a10_list_statistics(spark, d):
    """A10: population deviation, exact median."""
    p = "o_totalprice"
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("aid")).agg(
        F.round(F.sum(p), 4).alias("sum_"), F.round(F.avg(p), 7).alias("mean"), F.max(p).alias("max_"), F.min(p).alias("min_"), F.round(F.stddev_pop(p), 4).alias("std"), F.round(F.median(p), 7).alias("median_"), F.round(F.max(p) - F.min(p), 4).alias("spread")
    )


@query("a11_value_ratio", "SELECT o_custkey AS aid, count(*) FILTER (WHERE o_orderstatus = 'F') AS zeros, count(*) FILTER (WHERE o_orderstatus <> 'F') AS nonzero, round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 6) AS ratio FROM orders GROUP BY o_custkey")
def a11_value_ratio(spark, d):
    """A11, A12."""
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("aid")).agg(F.count_if(s == "F").alias("zeros"), F.count_if(s != "F").alias("nonzero"), F.round(F.count_if(s == "O") / F.count(F.lit(1)), 6).alias("ratio"))


@query("a13_collect_flatten", sql("SELECT block, list_sort(list_distinct(flatten(list(v)))) AS authors FROM (SELECT block, pid, list(author) AS v FROM papers JOIN coauthors USING (pid) GROUP BY block, pid) GROUP BY block", "papers", "coauthors"))
def a13_collect_flatten(spark, d):
    """Distinct co-authors of a block, by a set aggregate that combines map-side."""
    rows = papers(spark, d).join(coauthors(spark, d), "pid").select("block", "author").distinct()
    return rows.groupBy("block").agg(F.sort_array(F.collect_list("author")).alias("authors"))


@query("a15_vector_pooling", "SELECT label, list(m ORDER BY i) AS mean_, list(x ORDER BY i) AS max_ FROM (SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS m, round(max(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label")
def a15_vector_pooling(spark, d):
    """Element-wise mean and maximum."""
    e = table(spark, d, "embeddings")
    rounded = lambda v, name: vectors.rounded(v).alias(name)
    mean, most = vectors.pooled(e, ["label"], "embedding"), vectors.pooled(e, ["label"], "embedding", "max").withColumnRenamed("vec", "most")
    return mean.join(most, "label").select("label", rounded(F.col("vec"), "mean_"), rounded(F.col("most"), "max_"))


@query("a16_weighted_vector", "SELECT label, list(m ORDER BY i) AS vec FROM (SELECT label, i, round(sum(embedding[i] * CAST(1 + vec_id % 4 AS DOUBLE)) / sum(1 + vec_id % 4), 6) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label")
def a16_weighted_vector(spark, d):
    """Idf-weighted mean (here a weight from the id)."""
    out = vectors.pooled(table(spark, d, "embeddings"), ["label"], "embedding", weight=(1 + F.col("vec_id") % 4).cast("double"))
    return out.select("label", vectors.rounded("vec").alias("vec"))


@query("a17_time_weighted_vector", "SELECT label, list(m ORDER BY i) AS vec FROM (SELECT label, i, round(sum(embedding[i] * w) / sum(w), 6) AS m FROM (SELECT *, 1.0 / least(abs(vec_id % 30 - 10) + 1, 20) AS w FROM embeddings), range(1, 65) r(i) GROUP BY label, i) GROUP BY label")
def a17_time_weighted_vector(spark, d):
    """Weights fall with the distance in years."""
    w = similarity.time_weight(F.col("vec_id") % 30 - 10)
    out = vectors.pooled(table(spark, d, "embeddings"), ["label"], "embedding", weight=w)
    return out.select("label", vectors.rounded("vec").alias("vec"))


SETS = "SELECT pid, list(DISTINCT org) AS o FROM orgs GROUP BY pid"


@query("a18_org_set_stats", sql("SELECT aid, CAST(sum(c) AS BIGINT) AS sum_, round(avg(c), 6) AS mean, max(c) AS max_, min(c) AS min_, round(stddev_pop(c), 6) AS std FROM (SELECT p.aid, len(list_intersect(s.o, t.o)) AS c FROM split p JOIN sets s USING (pid) JOIN split q ON q.aid = p.aid AND NOT q.is_new JOIN sets t ON t.pid = q.pid WHERE p.is_new) GROUP BY aid", "papers", "split", "orgs", sets=SETS))
def a18_org_set_stats(spark, d):
    """Statistics of organisation overlaps between a person's new and old papers."""
    sets = orgs(spark, d).groupBy("pid").agg(F.collect_set("org").alias("o"))
    rows = split(spark, d).join(sets, "pid")
    pairs = rows.where("is_new").select("aid", "o").join(rows.where("not is_new").select("aid", F.col("o").alias("p")), "aid")
    c = similarity.overlap(F.col("o"), F.col("p"))
    return pairs.withColumn("c", c.cast("bigint")).groupBy("aid").agg(F.sum("c").alias("sum_"), F.round(F.avg("c"), 6).alias("mean"), F.max("c").alias("max_"), F.min("c").alias("min_"), F.round(F.stddev_pop("c"), 6).alias("std"))


@query("a19_coauthor4", sql("SELECT s.pid, count(*) AS matched, round(count(*) / (total + 1e-8), 6) AS of_paper, CAST(sum(n) AS BIGINT) AS counted, round(sum(n) / (max(t.all_) + 1e-8), 6) AS of_author FROM (SELECT pid, aid, author, count(*) OVER (PARTITION BY pid) AS total FROM split JOIN coauthors USING (pid) WHERE is_new) s JOIN (SELECT aid, author, count(*) AS n, sum(count(*)) OVER (PARTITION BY aid) AS all_ FROM split JOIN coauthors USING (pid) WHERE NOT is_new GROUP BY aid, author) t ON s.aid = t.aid AND s.author = t.author GROUP BY s.pid, total", "papers", "split", "coauthors"))
def a19_coauthor4(spark, d):
    """Matched co-authors, their share of the paper's, their papers, and share of the person's."""
    rows = split(spark, d).join(coauthors(spark, d), "pid")
    new = rows.where("is_new")
    n = rows.where("not is_new").groupBy("aid", "author").agg(F.count(F.lit(1)).alias("n"))
    total, whole = new.groupBy("pid").agg(F.count(F.lit(1)).alias("total")), n.groupBy("aid").agg(F.sum("n").alias("all_"))
    hit = new.join(n, ["aid", "author"]).groupBy("pid", "aid").agg(F.count(F.lit(1)).alias("matched"), F.sum("n").alias("counted"))
    out = hit.join(total, "pid").join(whole, "aid")
    return out.select("pid", "matched", F.round(F.col("matched") / (F.col("total") + 1e-8), 6).alias("of_paper"), "counted", F.round(F.col("counted") / (F.col("all_") + 1e-8), 6).alias("of_author"))


@query("a20_attribute8", "SELECT a, round(max(j), 6) AS max_jaro, round(avg(j), 6) AS mean_jaro, round(max(s), 6) AS max_jaccard, round(avg(s), 6) AS mean_jaccard, CAST(sum(c) AS BIGINT) AS common, round(sum(c) / (2.0 * count(*)), 6) AS common_ratio FROM (SELECT x.p_partkey AS a, jaro_similarity(x.p_name, y.p_name) AS j, len(list_intersect(string_split(x.p_name, ' '), string_split(y.p_name, ' '))) AS c, len(list_intersect(string_split(x.p_name, ' '), string_split(y.p_name, ' '))) / CAST(len(list_distinct(list_concat(string_split(x.p_name, ' '), string_split(y.p_name, ' ')))) AS DOUBLE) AS s FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_partkey <> y.p_partkey) GROUP BY a")
def a20_attribute8(spark, d):
    """Best and mean Jaro and Jaccard of an attribute against the others of its block, and common words.

    Equal names are counted and compared once: Jaro runs on distinct pairs of names.
    """
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_name")
    named = p.groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("m"))
    x, y = named.select("p_brand", F.col("p_name").alias("x")), named.select("p_brand", F.col("p_name").alias("y"), "m")
    pairs = x.join(y, "p_brand")
    once = pairs.select("x", "y").distinct().withColumn("j", similarity.jaro(F.col("x"), F.col("y")))
    a, b = F.split("x", " "), F.split("y", " ")
    rows = pairs.join(once, ["x", "y"]).withColumns({"c": similarity.overlap(a, b).cast("bigint"), "s": similarity.jaccard(a, b), "n": F.col("m") - (F.col("x") == F.col("y")).cast("int")}).where("n > 0")
    per = rows.groupBy("p_brand", "x").agg(F.max("j").alias("mj"), (F.sum(F.col("j") * F.col("n")) / F.sum("n")).alias("aj"), F.max("s").alias("ms"), (F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("as_"), F.sum(F.col("c") * F.col("n")).alias("common"), F.sum("n").alias("pairs"))
    out = p.join(per, (p.p_brand == per.p_brand) & (p.p_name == per.x))
    return out.select(F.col("p_partkey").alias("a"), F.round("mj", 6).alias("max_jaro"), F.round("aj", 6).alias("mean_jaro"), F.round("ms", 6).alias("max_jaccard"), F.round("as_", 6).alias("mean_jaccard"), "common", F.round(F.col("common") / (2.0 * F.col("pairs")), 6).alias("common_ratio"))


KERNEL_SQL = ", ".join(f"({i}, {m}, {s})" for i, (m, s) in enumerate(KERNELS))
SIMS = "SELECT a.vec_id AS a, b.label AS aid, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id"


def kernel_sums(spark, d, logs: bool):
    """(a, aid, k0, k1, ...): a vector's kernel sums over the others of its label, summed tile by tile."""
    e = table(spark, d, "embeddings")
    fields = {f.name: f.dataType.simpleString() for f in e.schema}
    e = e.select("label", "vec_id", F.col("embedding").alias("vec"))
    names = [f"k{k}" for k in range(len(KERNELS))]
    parts = tiles.within(e, "label", "vec_id", 2048, tiles.kernels(logs), f"a {fields['vec_id']}, aid {fields['label']}, " + ", ".join(f"{k} double" for k in names))
    return parts.groupBy("a", "aid").agg(*[F.sum(k).alias(k) for k in names])


def long(df):
    kernels = F.explode(F.array(*[F.struct(F.lit(i).alias("kernel"), F.col(f"k{i}").alias("value")) for i in range(len(KERNELS))])).alias("x")
    return df.select("a", "aid", kernels).select("a", "aid", "x.kernel", F.round("x.value", 6).alias("value"))


@query("a23_kernel_soft_tf", sql("SELECT a, aid, kernel, round(ln(least(greatest(sum(exp(-((s - m) * (s - m)) / (2 * w * w))), 1e-10), 100.0)) * 0.01, 6) AS value FROM sims, k GROUP BY a, aid, kernel", sims=SIMS, k=f"SELECT * FROM (VALUES {KERNEL_SQL}) v(kernel, m, w)"))
def a23_kernel_soft_tf(spark, d):
    """The log is outside the sum."""
    return long(vectors.soft_of_sums(kernel_sums(spark, d, False), ["a", "aid"]))


@query("a24_kernel_sum_log", sql("SELECT a, aid, kernel, round(sum(ln(greatest(exp(-((s - m) * (s - m)) / (2 * w * w)), 1e-10))) * 0.01, 6) AS value FROM sims, k GROUP BY a, aid, kernel", sims=SIMS, k=f"SELECT * FROM (VALUES {KERNEL_SQL}) v(kernel, m, w)"))
def a24_kernel_sum_log(spark, d):
    """The log is inside the sum."""
    return long(vectors.logs_of_sums(kernel_sums(spark, d, True), ["a", "aid"]))


@query("a25_corpus_profile", sql("SELECT count(DISTINCT block) AS names, count(DISTINCT aid) AS authors, count(*) AS papers, (SELECT min(n) FROM g) AS least, (SELECT max(n) FROM g) AS most, (SELECT round(avg(n), 6) FROM g) AS mean FROM papers", "papers", g="SELECT aid, count(*) AS n FROM papers GROUP BY aid"))
def a25_corpus_profile(spark, d):
    """Sizes of the corpus and of its groups."""
    g = papers(spark, d).groupBy("block", "aid").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count_distinct("block").alias("names"), F.count_distinct("aid").alias("authors"), F.sum("n").alias("papers"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("a26_describe", "SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS least, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS most FROM orders")
def a26_describe(spark, d):
    """Exact quantiles."""
    p = F.col("o_totalprice")
    orders = table(spark, d, "orders").select("o_totalprice")
    rest = orders.agg(F.count(p).alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_samp(p), 4).alias("std"), F.min(p).alias("least"), F.max(p).alias("most"))
    quantiles = ranking.exact_quantiles(orders, "o_totalprice", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return rest.join(F.broadcast(quantiles.select(*[F.round(c, 4).alias(c) for c in quantiles.columns])))  # one row each


@query("a27_keyword_hits", "SELECT source, CAST(sum(CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS BIGINT)) AS BIGINT) AS hits, round(sum(CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS BIGINT)) / count(*), 6) AS per_doc FROM documents GROUP BY source")
def a27_keyword_hits(spark, d):
    """Non-overlapping occurrences of a keyword."""
    hits = text.occurrences(F.col("text"), F.lit("th"))
    return table(spark, d, "documents").groupBy("source").agg(F.sum(hits).alias("hits"), F.round(F.sum(hits) / F.count(F.lit(1)), 6).alias("per_doc"))


@query("a28_importance_mean", "SELECT p_type AS feature, round(avg(p_retailprice), 4) AS importance FROM part GROUP BY p_type ORDER BY round(avg(p_retailprice), 4) DESC, p_type LIMIT 40")
def a28_importance_mean(spark, d):
    """A top-40 report of means."""
    mean = F.round(F.avg("p_retailprice"), 4).alias("importance")
    return table(spark, d, "part").groupBy(F.col("p_type").alias("feature")).agg(mean).orderBy(F.desc("importance"), "feature").limit(40)


@query("a29_fold_mean", "SELECT l_orderkey AS slot, l_partkey AS aid, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY l_orderkey, l_partkey")
def a29_fold_mean(spark, d):
    """Mean of the folds' scores per pair."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("slot"), F.col("l_partkey").alias("aid")).agg(F.round(F.avg("l_discount"), 6).alias("score"))


@query("a31_quality_bag", sql("SELECT aid, org, CAST(sum(CASE WHEN tier = 0 THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM (SELECT aid, org, CASE WHEN author LIKE '%1' THEN 0 WHEN author LIKE '%2' THEN 1 ELSE 2 END AS tier FROM papers JOIN orgs USING (pid)) GROUP BY aid, org", "papers", "orgs"))
def a31_quality_bag(spark, d):
    """Organisations counted twice where the name matched fully."""
    tier = F.when(F.col("author").endswith("1"), 0).when(F.col("author").endswith("2"), 1).otherwise(2)
    rows = papers(spark, d).join(orgs(spark, d), "pid").withColumn("tier", tier)
    return rows.groupBy("aid", "org").agg(F.sum(F.when(F.col("tier") == 0, 2).otherwise(1)).alias("weight"))


@query("a32_keyword_vector", sql("SELECT pid, list(v ORDER BY i) AS vec FROM (SELECT pid, i, round(avg(m), 6) AS v FROM (SELECT label AS pid, vec_id % 5 AS phrase, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, vec_id % 5, i) GROUP BY pid, i) GROUP BY pid"))
def a32_keyword_vector(spark, d):
    """Mean over phrases of the mean over words."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("pid"), (F.col("vec_id") % 5).alias("phrase"), "embedding")
    return vectors.keyword_vectors(e, "pid", "phrase", "embedding").select("pid", vectors.rounded("vec").alias("vec"))


@query("a33_profile_sets", sql("SELECT aid, list_sort(list(DISTINCT org)) AS orgs, list_sort(list(DISTINCT author)) AS authors FROM papers JOIN orgs USING (pid) WHERE org <> '' GROUP BY aid", "papers", "orgs"))
def a33_profile_sets(spark, d):
    """Organisations and co-authors of a person, papers without organisation left out of both."""
    rows = papers(spark, d).join(orgs(spark, d), "pid").where("org <> ''")
    return rows.groupBy("aid").agg(F.sort_array(F.collect_set("org")).alias("orgs"), F.sort_array(F.collect_set("author")).alias("authors"))
