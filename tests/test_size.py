"""What queries move and how it is dealt, on small tables: figures that grow with the tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def listed(spark):
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30000)
    found = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def stages(spark):
    return {s.stageId(): s.shuffleWriteRecords() for s in listed(spark)}


def sizes(spark):
    return {s.stageId(): s.numTasks() for s in listed(spark)}


def moved(spark, run):
    """Records that a run writes to shuffles."""
    before = stages(spark)
    run()
    return sum(n for k, n in stages(spark).items() if k not in before)


def lines_of(spark, data):
    return spark.read.parquet(f"{data}/lineitem.parquet").count()


def test_numbers_stand_for_tokens(spark, data):
    from namewright.plans.views import coauthors, line_sets, words

    named = {r.pid: (set(r.co or ()), set(r.wo or ())) for r in line_sets(spark, data).collect()}
    want: dict = {}
    for i, (rows, c) in enumerate(((coauthors(spark, data), "author"), (words(spark, data), "word"))):
        for r in rows.collect():
            want.setdefault(r.pid, (set(), set()))[i].add(r[c])
    assert named == want
    numbers = {r.pid: (r.co, r.wo) for r in line_sets(spark, data, numbers=True).collect()}
    for i in (0, 1):
        token_of = {}
        for pid, sets in numbers.items():
            assert len(set(sets[i] or ())) == len(named[pid][i])
            for n in sets[i] or ():
                token_of[n] = token_of.get(n, named[pid][i]) & named[pid][i]
        assert len(token_of) == len(set().union(*(v[i] for v in named.values())))


@pytest.mark.parametrize("name", ["e03_macro_f", "e04_hits_mrr", "e07_incomplete"])
def test_judging_moves_papers_not_words(spark, data, name):
    """a row per word of a line was moved, and moved again for each paper."""
    assert moved(spark, lambda: entry.queries()[name](spark, data).collect()) < 2.5 * lines_of(spark, data)


def test_a_large_block_is_met_in_slices(spark):
    """Pairs of few blocks, small as rows, were left to one or two tasks."""
    from namewright.operators import blocking

    rows = spark.range(9000).select(F.lit("x").alias("block"), F.col("id").alias("pid"))
    pairs = blocking.block_pairs(rows, "block", "pid", ordered=True)
    parts = pairs.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(p.n for p in parts) == 9000 * 8999 // 2
    assert len(parts) > 1 and max(p.n for p in parts) < 0.9 * 9000 * 8999 // 2


def test_year_gaps_meet_no_lines(spark, data):
    """co-authors were looked up for pairs that need only years."""
    assert moved(spark, lambda: entry.queries()["v18_year_gap"](spark, data).count()) < lines_of(spark, data)


@pytest.mark.parametrize("name", ["a03_ngram_counts", "a05_author_tfidf", "a06_mean_score", "a07_top_terms"])
def test_ngrams_stay_with_their_person(spark, data, name):
    """every n-gram was a row of a shuffle, of a join and of one task's hash map."""
    assert moved(spark, lambda: entry.queries()[name](spark, data).count()) < 4 * lines_of(spark, data)


@pytest.mark.parametrize("name", ["j19_org_by_name", "u04_set_sizes"])
def test_lines_are_grouped_once(spark, data, name):
    """lines were made distinct first, in partitions that grew with the table."""
    text = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text


def test_relations_not_walked_do_not_move(spark):
    """the edges of all relations were joined and written, whichever were walked."""
    from namewright.operators import graph

    author = spark.range(200).select(F.lit("author").alias("rel"), F.col("id").alias("pid"), (F.col("id") % 20).cast("string").alias("token"))
    other = spark.range(5000).select(F.lit("venue").alias("rel"), F.col("id").alias("pid"), (F.col("id") % 5).cast("string").alias("token"))
    run = lambda edges: moved(spark, lambda: graph.walks(edges, author.select("pid"), 1, 1, relations=["author"]).collect())
    assert run(author.unionAll(other)) < run(author) + 5000


def test_training_is_dealt_into_bounded_shares(spark):
    """four tasks trained on all words, however many; and a row per word and dimension was made for the documents' means."""
    from namewright.operators import learned, vectors

    texts = [(i, [f"w{(i * j) % 50}" for j in range(1, 41)]) for i in range(400)] + [(400, None), (401, []), (402, ["never"])]
    docs = spark.createDataFrame(texts, "id int, tokens array<string>").repartition(2)
    seen = stages(spark)
    words = learned.word_vectors(docs, "tokens", dims=4, words_per_task=1000)
    vec = {r["word"]: r["vector"] for r in words.collect()}
    tasks = [n for k, n in sizes(spark).items() if k not in seen]
    assert len(vec) == 50 and max(tasks) == 17  # 16,001 words
    means = {}
    n = moved(spark, lambda: means.update({r["id"]: r["vec"] for r in vectors.pooled_words(docs, ["id"], "tokens", words, 4).collect()}))
    assert n < 3 * len(texts) and set(means) == set(range(400))
    for i, tokens in texts[:400]:
        assert all(abs(means[i][k] - sum(vec[t][k] for t in tokens) / 40) < 1e-6 for k in range(4))


def test_person_graphs_move_papers_not_words(spark, data):
    """every word of every pair was joined and summed."""
    papers = spark.read.parquet(f"{data}/orders.parquet").count()
    assert moved(spark, lambda: entry.queries()["g09_spectral"](spark, data).collect()) < 0.9 * lines_of(spark, data) + 9 * papers


def test_graphs_of_many_sizes_in_one_batch(spark):
    """a call for each group; matrices of one size are now decomposed together, at most some numbers at once."""
    import numpy as np

    from namewright.operators import graph

    rnd, rows = np.random.default_rng(2), []
    for g in range(40):
        nodes = [f"n{x}" for x in rnd.permutation(30)[: 1 + g % 7]]
        rows += [(g, x, y, float(rnd.integers(1, 9))) for x in nodes for y in nodes if x <= y]
    edges = graph.symmetric(spark.createDataFrame(rows, "g int, a string, b string, w double"), ["g"])
    matrices = edges.collect()
    before, graph.STACKED = graph.STACKED, 60
    try:
        for dims in (3, 9):
            got = {}
            for r in graph.spectral(edges, "g", dims).collect():
                got.setdefault(r["g"], {})[r["node"]] = r["vec"]
            assert set(got) == set(range(40))
            for g, have in got.items():
                names = sorted(have)
                m = np.zeros((len(names), len(names)))
                for r in matrices:
                    if r["g"] == g:
                        m[names.index(r["a"]), names.index(r["b"])] = r["w"]
                u, s, _ = np.linalg.svd(m)
                want = u[:, :dims] * np.sqrt(s[:dims])
                want /= np.linalg.norm(want, axis=1, keepdims=True)
                vec = np.array([have[x] for x in names])
                assert vec.shape[1] == dims and np.allclose(vec @ vec.T, want @ want.T, atol=1e-6)
    finally:
        graph.STACKED = before
    assert graph.spectral(edges.where("g > 99"), "g", 3).count() == 0


def test_terms_are_dealt_into_bounded_tasks(spark):
    """a task of the decomposition read whatever rows a file had, and each pass decoded them anew."""
    from namewright.operators import learned

    texts = [(i, [f"w{(i * j) % 97}" for j in range(1, 31)]) for i in range(300)] + [(300, None), (301, [])]
    docs = spark.createDataFrame(texts, "id int, tokens array<string>").coalesce(1)
    seen = stages(spark)
    got = {r["id"]: r["latent"] for r in learned.text_vectors(docs, "tokens", dims=6, terms_per_task=1000).collect()}
    passes = [s for s in listed(spark) if s.stageId() not in seen and "RowMatrix" in s.name() and s.inputBytes()]
    assert set(got) == set(range(302)) and {len(v) for v in got.values()} == {6} and not any(got[301])
    assert len(passes) > 5 and {s.numTasks() for s in passes} == {9}  # 9,000 terms


def test_a_hop_looks_up_one_place(spark):
    """a hop listed up to three places for each walk, met all of them and joined the walk's path back to them."""
    from namewright.operators import graph

    edges = spark.range(3000).select(F.lit("author").alias("rel"), (F.col("id") % 300).alias("pid"), (F.col("id") % 37).cast("string").alias("token"))
    papers, before = edges.select("pid").distinct(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    run = lambda steps: moved(spark, lambda: graph.walks(edges, papers, steps, 20, relations=["author"]).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables too large for it
    try:
        a_hop = (run(4) - run(1)) / 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert a_hop < 4 * 300 * 20 + 2 * 3000  # a walk and its edge, its place, its part of the path


def test_later_tiers_form_no_pairs(spark):
    """pairs of all tiers were formed and sorted by slot to keep the first tier's."""
    from namewright.operators import blocking

    slots = spark.range(400).select(F.col("id").alias("slot"), F.col("id").cast("string").alias("name")).repartition(4)
    names = spark.range(300).select(F.col("id").alias("other"), F.col("id").cast("string").alias("name_"))
    tiers = [(F.col("name"), F.col("name_")), (F.substring("name", -1, 1), F.substring("name_", -1, 1)), (F.lit("x"), F.lit("x"))]
    got = []
    n = moved(spark, lambda: got.extend(blocking.tiered(slots, names, tiers, "slot").select("slot", "other", "tier").collect()))
    assert {tuple(r) for r in got} == {(i, i, 0) for i in range(300)} | {(i, j, 1) for i in range(300, 400) for j in range(i % 10, 300, 10)}
    assert len(got) == 300 + 100 * 30 and n < 10_000


def test_names_are_encoded_before_they_meet(spark, data):
    """both names of every pair were encoded anew."""
    plan = entry.queries()["f18_same_name"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan
