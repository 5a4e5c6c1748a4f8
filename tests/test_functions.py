"""Hand-written expectations and brute force for what SQL cannot check."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewright.functions import names, similarity, text
from namewright.operators import cluster, graph, ranking


@pytest.mark.parametrize(
    "a,b,rule",
    [
        ("wei chen", "Chen Wei", 1), ("Chen, Wei", "wei chen", 1), ("xiao hua li", "xiaohua li", 1), ("José García", "jose garcia", 1), ("John Q Smith", "John Smith", 1),
        ("w chen", "wei chen", 2), ("John Smith", "J. Smith", 2), ("Smith J", "John Smith", 2), ("betty u. mcneely", "b. u. mcneely", 2),
        ("j smith", "John Quincy Smith", 3), ("cummings", "linda cummings", 3),
        ("jo smith", "john quincy smith", 4), ("w li", "wei xiaohua li", 0),
        ("anna maria lopez", "anna maria lope", 5), ("johan b mueller", "johan muellers", 6), ("xiao wei chen", "chen wei xiao hua", 7),
        ("", "John", 0), ("John Smith", "Mary Jones", 0), ("wei chen", "wei chang", 0),
    ],
)
def test_name_rules(a, b, rule):
    assert names.rule_number(a, b) == rule == names.rule_number(b, a)


@pytest.mark.parametrize("name,chinese", [("wei chen", True), ("Yufeng Xin", True), ("KAIPING HAN", True), ("Na Li", True), ("Zhen Song", True), ("john smith", False), ("Juan Long", False), ("Dean Lopez", False), ("Ian Dean", False), ("anna lopez", False), ("P Ludvigsen", False), ("H. De Hoop", False), ("Xiaohua Long", True), ("xiao hua wei smith", True)])
def test_chinese_names(name, chinese):
    assert names.is_chinese_name(names.plain(name)) == chinese


def test_syllables():
    got = names.syllables()
    assert 380 <= len(got) <= 420 and {"xiao", "hua", "zhuang", "er", "yong", "weng"} <= got and not {"bong", "fi", "jao", "xa", "wi", "ki", "ue"} & got
    assert names.syllable_split("xiaohua") == ["xiao", "hua"] and names.syllable_split("smith") is None


@pytest.mark.parametrize(
    "name,target,match",
    [
        ("W. Chen", "wei_chen", True), ("Chen W", "wei_chen", True), ("J Smith", "wei_chen", False), ("Chen XH", "xiao-hua_chen", True), ("Chen H X", "xiao-hua_chen", True), ("xiao q chen", "xiao-hua_chen", True),
        ("Takashi Ito", "takashi_ito", True), ("Takahiro Ito", "takashi_ito", True), ("Takahiro Ito", "takahiro_ito", False), ("Takeshi Ito", "tadashi_ito", True), ("Takashi Ito", "tadashi_ito", True), ("T Ito", "takashi_ito", True), ("Akio Mori", "akio_mori", False), ("Akio Mori", "akira_mori", True),
        ("Ulrich Boser", "ulrike_boser", True), ("chen wei a", "wei_chen", True), ("wei", "wei_chen", False),
    ],
)
def test_prefix_match(name, target, match):
    """A given name of the list is read as the one name beside it, whatever the target begins with."""
    assert names.prefix_match(name, target) == match


def test_name_helpers():
    assert names.author_index("wei chen", ["Bo Li", "Wei Chen", "J. Doe"]) == 1
    assert names.author_index("wei chen", ["Bo Li"]) == -1 and names.author_index("wei chen", ["wei chen", "chen wei"]) == -1
    assert names.consistent(["john smith", "j smith"]) and not names.consistent(["john smith", "mary jones"]) and names.consistent([])
    assert not names.consistent(["betty u mcneely", "sally h ebeling", "b u mcneely"]) and names.consistent(["henrik zetterberg", "h zetterberg", "henrik zetterburg"])
    assert names.abbreviates("b u mcneely", "betty u mcneely") and not names.abbreviates("betty u mcneely", "b u mcneely") and names.abbreviates("jo smith", "john smith", True)


@pytest.mark.parametrize(
    "name,tokens",
    [
        ("WB Smith", "w b smith"), ("Dr. Bill O’Neil Jr.", "william oneil"), ("Mr Tom Jones III", "thomas jones"), ("Prof. Ed Md Smith", "prof. edward md smith"), ("fran miller", "frances miller"), ("jan de boer", "janice de boer"),
        ("a.b. smith", "a b smith"), ("m. ćwiok", "m. cwiok"), ("M Fincke-Keeler", "m fincke keeler"), ("Wb Smith", "wb smith"), ("", ""),
    ],
)
def test_name_tokens(spark, name, tokens):
    got = spark.createDataFrame([(name,)], "s string").select(names.simple_tokens(F.col("s")).alias("t")).first()["t"]
    assert got == tokens.split()


def test_columns_on_edges(spark):
    row = spark.createDataFrame([("wei chen 陈伟", "Chen Wei", None, "", ["null", ""], "ßtraße")], "a string, b string, n string, e string, k array<string>, u string")
    got = row.select(
        names.name_key(F.col("b")).alias("key"), text.has_chinese(F.col("a")).alias("cjk"), text.norm_text(F.col("n")).alias("null"), F.size(text.tokens(F.col("e"))).alias("none"), text.keywords(F.col("k")).alias("k"),
        text.clean_abstract(F.col("u")).alias("u"), similarity.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j"), similarity.dice_like(F.array().cast("array<string>"), F.col("k")).alias("d"),
        similarity.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c"), similarity.cosine_or_nan(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("cn"), similarity.year_gap(F.lit(1980), F.lit(2015)).alias("gap"), similarity.time_weight(F.lit(None).cast("int")).alias("w"),
        names.romanized(F.col("a"), {"陈": "chen", "伟": "wei"}).alias("latin"), text.occurrences(F.lit("aaaa"), F.lit("aa")).alias("hits"), text.occurrences(F.lit("aaaa"), F.lit("")).alias("no"),
    ).first()
    assert (got["key"], got["cjk"], got["null"], got["none"], got["k"], got["u"]) == ("chenwei", True, None, 0, ["null"], "ßtraße")
    assert (got["j"], got["d"], got["c"], got["gap"], got["w"], got["hits"], got["no"]) == (0.0, -1.0, 0.0, 20, 0.05, 2, 0)
    assert got["cn"] != got["cn"] and got["latin"] == "wei chen"


def ratio(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else 2))
    return (len(a) + len(b) - d[-1][-1]) / (len(a) + len(b)) if a or b else 1.0


def test_levenshtein_ratio():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 8))) for _ in range(2))
        assert abs(similarity.ratio_of(a, b) - ratio(a, b)) < 1e-12


def test_single_candidate_and_ties(spark):
    df = spark.createDataFrame([(1, 7, 0.4), (2, 1, 0.9), (2, 2, 0.9), (2, 3, 0.1)], "slot int, aid int, score double")
    nil = {r["slot"]: r for r in ranking.nil_features(df, ["slot"], "score", "aid").collect()}
    assert (nil[1]["best"], nil[1]["mean"], nil[1]["gap_mean"], nil[1]["gap_min"]) == (0.4, 0.4, 0.0, 0.0)
    assert {r["slot"]: r["aid"] for r in ranking.top_1(df, ["slot"], "score", "aid", ["aid"]).collect()} == {1: 7, 2: 1}


def test_three_mutual_neighbours_are_noise(spark):
    pairs = [("x", a, b, 0.1) for a in (1, 2, 3) for b in (1, 2, 3) if a != b]
    points = spark.createDataFrame([("x", i) for i in (1, 2, 3, 9)], "block string, id bigint")
    d = spark.createDataFrame(pairs, "block string, a bigint, b bigint, d double")
    assert {r["label"] for r in cluster.dbscan(points, d, ["block"], "id").collect()} == {-1}
    more = d.unionAll(spark.createDataFrame([("x", 9, i, 0.2) for i in (1, 2, 3)] + [("x", i, 9, 0.2) for i in (1, 2, 3)], d.schema))
    assert {r["label"] for r in cluster.dbscan(points, more, ["block"], "id").collect()} == {1}


def test_attach_and_relabel(spark):
    labels = spark.createDataFrame([("x", 1, 5), ("x", 2, -1), ("x", 3, -1), ("x", 4, -1)], "block string, id bigint, label bigint")
    scores = spark.createDataFrame([("x", 2, 1, 1.5), ("x", 3, 1, 1.49), ("x", 3, 4, 2.0)], "block string, a bigint, b bigint, score double")
    assert {r["id"]: r["label"] for r in cluster.attach_outliers(labels, scores, ["block"], "id").collect()} == {1: 5, 2: 5, 3: -5, 4: -6}
    own = labels.withColumn("label", F.col("id") * 10)
    pairs = spark.createDataFrame([("x", 2, 3, 1.6), ("x", 3, 4, 1.5), ("x", 1, 4, 1.0)], scores.schema)
    assert {r["id"]: r["label"] for r in cluster.relabel_in_order(own, pairs, ["block"], "id").collect()} == {1: 10, 2: 20, 3: 20, 4: 20}


def test_relabel_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    labels = [(b, i, 100 * i) for b in ("x", "y") for i in range(25)]
    pairs = [(b, int(i), int(j), float(s)) for b in ("x", "y") for i, j, s in zip(rng.integers(0, 27, 60), rng.integers(0, 27, 60), rng.choice([1.4, 1.5, 1.9], 60))]
    want = {(b, i): n for b, i, n in labels}
    for b, i, j in sorted((b, i, j) for b, i, j, s in pairs if s >= 1.5):
        if (b, i) in want and (b, j) in want:
            want[b, j] = want[b, i]
    got = cluster.relabel_in_order(spark.createDataFrame(labels, "block string, id bigint, label bigint"), spark.createDataFrame(pairs, "block string, a bigint, b bigint, score double"), ["block"], "id")
    assert {(r["block"], r["id"]): r["label"] for r in got.collect()} == want


def test_running_sums_of_large_and_null_groups(spark):
    rows = [(None if i % 3 == 0 else "a", i * 7 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o int, v bigint").repartition(7)
    got = {r["o"]: (r["n"], r["s"]) for r in ranking.running(df, ["g"], ["o"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    for g in (None, "a"):
        s = 0
        for n, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 1):
            s += v
            assert got[o] == (n, s)
    folds = ranking.equal_folds(df, ["g"], ["o"], 7)
    assert folds.columns == ["g", "o", "v", "fold"] and folds.count() == 1000
    sizes = sorted(r["count"] for r in folds.groupBy("g", "fold").count().collect())
    assert sizes == sorted(len(x) for n in (334, 666) for x in np.array_split(range(n), 7))
    assert ranking.equal_folds(df.limit(0), ["g"], ["o"], 7).count() == 0


def test_text_vectors_are_the_truncated_decomposition(spark):
    """Against numpy, where terms do not clash; fewer directions than dimensions give zeros, no rows none."""
    from namewright.operators.learned import text_vectors

    rng = np.random.default_rng(3)
    rows = [(i, [f"w{x}" for x in rng.integers(0, 40, 30)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    terms = sorted({t for _, ts in rows for t in ts})
    m = np.array([[ts.count(t) for t in terms] for _, ts in rows], dtype=float)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    want = (u[:, :5] * s[:5]) @ (u[:, :5] * s[:5]).T
    got = {r["id"]: r["latent"] for r in text_vectors(df, "tokens", dims=5, weigh=False).collect()}
    have = np.array([got[i] for i in range(60)])
    assert np.allclose(have @ have.T, want, atol=1e-6)
    few = text_vectors(df.where("id < 3"), "tokens", dims=8, weigh=False).collect()
    assert all(len(r["latent"]) == 8 for r in few) and text_vectors(df.limit(0), "tokens", dims=8).count() == 0


def test_walks_follow_edges(spark):
    edges = spark.createDataFrame([("author", p, f"a{p // 2}") for p in range(8)] + [("org", p, f"o{p % 2}") for p in range(8)], "rel string, pid bigint, token string")
    starts = spark.createDataFrame([(p,) for p in range(8)], "pid bigint")
    got = graph.walks(edges, starts, steps=4, walks_each=2).collect()
    assert len(got) == 16
    for r in got:
        for i, (a, b) in enumerate(zip(r["path"], r["path"][1:])):
            assert a != b and (a // 2 == b // 2 if i % 2 == 0 else a % 2 == b % 2)
    again = graph.walks(edges, starts, steps=4, walks_each=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_spectral_rows_have_unit_length(spark):
    e = spark.createDataFrame([("x", 1, 2, 1.0), ("x", 2, 3, 1.0)], "block string, a bigint, b bigint, w double")
    got = graph.spectral(graph.symmetric(e, ["block"]), "block", 8).collect()
    assert {r["node"] for r in got} == {1, 2, 3} and all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-9 for r in got)


def test_stems(spark):
    """The first fitting ending goes; short stems, stems without a vowel, nulls and empty words stay."""
    from namewright.functions.stem import stem

    cases = {"studies": "study", "running": "run", "falling": "fall", "based": "bas", "glass": "glass", "of": "of", "classes": "class", "relational": "relate", "ties": "tie", "tests": "test", "crys": "cry", "psst": "psst", "adding": "add", "willingly": "will", None: None, "": ""}
    rows = spark.createDataFrame([(w,) for w in cases], "w string")
    assert {r["w"]: r["s"] for r in rows.select("w", stem(rows["w"]).alias("s")).collect()} == cases


def test_empty_inputs(spark):
    from namewright.operators import metrics, terms

    none = spark.createDataFrame([], "name string, truth int, pred int, tokens array<string>")
    assert metrics.pairwise(none, "name", "truth", "pred").count() == 0
    assert terms.document_frequency(none, "tokens").count() == 0
    with pytest.raises(ValueError):
        metrics.require_complete(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([], "k int"), ["k"])


def test_keyed_json_is_written_in_bounded_objects(spark, tmp_path):
    from namewright.sources import files

    at = f"file://{tmp_path}/keyed"
    files.write_keyed_json(spark.range(1000), at, "id", F.col("id").alias("n"), per=100)
    sizes = [len(r[0]) for r in spark.read.text(at, wholetext=True).selectExpr("json_object_keys(value)").collect()]
    assert len(sizes) == 10 and max(sizes) < 200
    got = files.read_keyed_json(spark, at, "struct<n:bigint>")
    assert sorted((r["key"], r["value"]["n"]) for r in got.collect()) == sorted((str(i), i) for i in range(1000))


@pytest.fixture(scope="module")
def planted(spark):
    """Slots of six candidates, of whom the true one has more in common and a smaller gap, with noise."""
    rnd = random.Random(21)
    rows = []
    for slot in range(300):
        for aid in range(6):
            true = aid == slot % 6
            rows.append((slot, aid, rnd.gauss(2.0 if true else 0.0, 0.8), rnd.gauss(1.5 if true else 0.0, 1.0), rnd.gauss(3.0 if true else 6.0, 2.0), float(true)))
    df = spark.createDataFrame(rows, "pid int, aid int, coauthors double, words double, gap double, label double")
    return df.where("pid % 3 <> 0"), df.where("pid % 3 = 0")


def ranked_right(rows, score):
    """Area under the curve of a label by a score."""
    bad, good = ([r[score] for r in rows if r["label"] == k] for k in (1.0, 0.0))
    return sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))


@pytest.mark.parametrize("kind", ["gbt", "logistic", "mlp"])
def test_scorers_learn_planted_signal(planted, kind):
    from namewright.operators import learned

    train, test = planted
    features = ["coauthors", "words", "gap"]
    got = learned.scored(learned.fit_scorer(kind, train, features, "label"), test).collect()
    assert len(got) == 600 and ranked_right(got, "score") > 0.95


def test_stack_learns_planted_signal(planted):
    from namewright.operators import learned

    train, test = planted
    got = learned.stacked(train, test, ["coauthors", "words", "gap"], "label", "pid", "aid", kind="gbt").collect()
    assert len(got) == 600 and ranked_right(got, "final") > 0.95


def test_cells_learn_planted_signal(planted):
    """Two kinds under a second level, one kind without, and both together; slots without a true candidate score lower."""
    from namewright.operators import learned

    train, test = planted
    features = ["coauthors", "words", "gap"]
    upper = learned.Cell(features, "label", "pid", "aid").fit(train)
    plain = learned.Cell(features, "label", "pid", "aid", first=("logistic",), second=()).fit(train)
    assert len(upper.models) == 3 and set(upper.models[0]) == {"gbt", "forest"} and len(upper.wide()) == 3 + 2 * 4 and not plain.upper
    got = learned.of_cells([(upper, 2.0), (plain, 1.0)], test, "final").collect()
    assert len(got) == 600 and ranked_right(got, "final") > 0.95
    bare = upper.score(test.where("label = 0 or pid % 2 = 0"), "final").collect()
    best = {}
    for r in bare:
        best[r["pid"]] = max(best.get(r["pid"], 0.0), r["final"])
    nil, full = ([v for k, v in best.items() if k % 2 == odd] for odd in (1, 0))
    assert sum(a < b for a in nil for b in full) > 0.9 * len(nil) * len(full)


def test_nearest_names_take_one_or_two(spark):
    from namewright.operators.nearest import nearest_names

    names_ = spark.createDataFrame([("abc",), ("abd",), ("xyz",)], "name string")
    slots = spark.createDataFrame([("abe",)], "slot string")
    assert [(r["name"], r["rank"]) for r in nearest_names(slots, names_, "slot", "name").orderBy("rank").collect()] == [("abc", 1), ("abd", 2)]
    assert [(r["name"], r["rank"]) for r in nearest_names(slots, names_, "slot", "name", near=3).collect()] == [("abc", 1)]


def odd_names(n):
    rnd = random.Random(7)
    words = "li wei xiao hua chen wang xiaohua j s a jo john smith johns smit quincy q maria lopez lope anna ann an ab abab ba aa bc abc le long zhang ming m w x johnsmith jos".split()
    names_ = {" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 2, 3, 3, 3, 4, 5]))) for _ in range(n)}
    return sorted(names_ | {" ".join("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 4))) for _ in range(n // 4)})


def test_no_match_escapes_its_signature():
    """All pairs of some 600 names made to match by every rule."""
    from collections import Counter

    from namewright.operators.namejoin import signatures

    listed = odd_names(520)
    keys = {n: signatures(n) for n in listed}
    ask, answer = ({n: {k for asks, k in v if asks == side} for n, v in keys.items()} for side in (True, False))
    hits, met = Counter(), 0
    for i, a in enumerate(listed):
        for b in listed[: i + 1]:
            meets = bool(ask[a] & answer[b] or ask[b] & answer[a])
            rule = names.rule_number(a, b)
            assert meets or not rule, (a, b, rule)
            hits[rule] += 1
            met += meets
    assert {1, 2, 3, 4, 6, 7} <= hits.keys() and met < 0.1 * len(listed) ** 2


def test_matching_names_equal_nested_loops(spark):
    from namewright.operators.namejoin import matched_lists, matching_names

    left = [*odd_names(60), "J. Smith", "José  García", "", "...", None, "j s", "john smith", "john smith"]
    right = [*odd_names(50), "JOHN SMITH", "jose garcia", None, "9", "john smith"]
    a, b = spark.createDataFrame([(x, "x") for x in left], "a string, plain string"), spark.createDataFrame([(x, "x") for x in right], "b string, x string")
    got = sorted((r["a"], r["b"], r["rule"]) for r in matching_names(a, b, "a", "b").collect())
    want = sorted((x, y, k) for x in {x for x in left if x} for y in {y for y in right if y} if (k := names.rule_number(x, y)))
    assert got == want and ("j s", "john smith") in {(x, y) for x, y, _ in got}
    lists = {1: left[:9], 2: left[9:], 3: [None], 4: []}, {7: right[:20], 8: right[20:], 9: [None, "qqq"]}
    frames = [spark.createDataFrame([(k, n) for k, v in side.items() for n in v], f"{c} int, name string") for side, c in zip(lists, ("l", "r"), strict=True)]
    pairs = [(x, y) for x in lists[0] for y in lists[1]]
    counted = {(r["l"], r["r"]): r["matched"] for r in matched_lists(spark.createDataFrame([*pairs, pairs[0]], "l int, r int"), *frames, "l", "r", "name").collect()}
    assert counted == {(x, y): sum(any(names.rule_number(m or "", n) for m in lists[0][x]) for n in {n for n in lists[1][y] if n}) for x, y in pairs}


@pytest.mark.parametrize("name,target,match", [("李四", "si_li", True), ("李 四", "si_li", True), ("李四 (Li Si)", "si_li", True), ("四李", "si_li", False), ("李", "si_li", False), ("李四", "xiao-hua_li", False), ("李晓华", "xiao-hua_li", True), ("李五", "si_li", False), ("Li Si", "si_li", True)])
def test_prefix_match_reads_characters(spark, name, target, match):
    readings = {"李": "li", "四": "si", "晓": "xiao", "华": "hua"}
    assert names.prefix_match(name, target, readings) == match
    if name == "李四":
        df = spark.createDataFrame([(name, target), (None, target), (name, None)], "a string, b string")
        assert [r[0] for r in df.select(names.matches_prefix_read(F.col("a"), F.col("b"), readings)).collect()] == [match, False, False]


@pytest.mark.parametrize("small,large,k", [(7, 9, 5), (10, 3, 5), (0, 6, 4), (13, 13, 5)])
def test_published_folds(spark, small, large, k):
    """Sizes and order of the folds from the rule as published."""
    rows = [(f"s{i}", 3) for i in range(small)] + [(f"l{i}", 30) for i in range(large)]
    got = {r["g"]: r["fold"] for r in ranking.published_folds(spark.createDataFrame(rows, "g string, n int").repartition(3), "n", 20, ["g"], k).collect()}
    start, want = 0, {}
    for stratum in (sorted(g for g, n in rows if n < 20), sorted(g for g, n in rows if n >= 20)):
        at, each, more = 0, len(stratum) // k, len(stratum) % k
        for i in range(k):
            size = each + ((k + i - start) % k < more)
            want.update({g: i for g in stratum[at : at + size]})
            at += size
        start = (start + more) % k
    assert got == want


def test_draws_with_replacement(spark):
    rows = [("few", i) for i in range(5)] + [("many", i) for i in range(200)] + [("one", 0)]
    got = ranking.drawn_with_replacement(spark.createDataFrame(rows, "g string, p int").repartition(3), ["g"], ["p"], 50, seed=3).collect()
    of = {g: [r["p"] for r in sorted(got, key=lambda r: r["draw"]) if r["g"] == g] for g in ("few", "many", "one")}
    assert of["few"] == [0, 1, 2, 3, 4] and of["one"] == [0]
    assert len(of["many"]) == 50 > len(set(of["many"])) > 25 and max(of["many"]) > 150
    assert {r["draw"] for r in got if r["g"] == "many"} == set(range(50))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 400])
def test_exact_quantiles(spark, n):
    rnd = random.Random(n)
    values = [float(rnd.randrange(60)) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
    got = ranking.exact_quantiles(df, "v", {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}).collect()
    assert [tuple(r) for r in got] == [tuple(np.quantile(values, [0, 0.3, 0.5, 1])) if n else (None,) * 4] or np.allclose(got[0], np.quantile(values, [0, 0.3, 0.5, 1]))


@pytest.mark.parametrize("slots,known", [(60, 90), (5, 1), (4, 0), (30, 400)])
def test_nearest_names_equal_all_comparisons(spark, slots, known):
    from collections import Counter

    from namewright.operators.nearest import nearest_names

    rnd = random.Random(slots)
    word = lambda letters, longest: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest)))
    mine = {word("abcdef", 7) for _ in range(slots)} | {"zz" * 40, "ABC", "", "quite another name 9"}
    theirs = {word("abcdefg", 8) for _ in range(known)}
    got = sorted((r["s"], r["n"], r["distance"], r["rank"]) for r in nearest_names(spark.createDataFrame([(x,) for x in [*mine, None]], "s string"), spark.createDataFrame([(x,) for x in [*theirs, None]], "n string"), "s", "n").collect())
    want = []
    bag = lambda x: Counter(c for c in x.lower() if "a" <= c <= "z")
    for s in mine:
        best = sorted((sum(abs(bag(s)[c] - bag(n)[c]) for c in bag(s) | bag(n)), n) for n in theirs)[:2]
        want += [(s, n, d, i + 1) for i, (d, n) in enumerate(best) if i == 0 or best[0][0] >= 2]
    assert got == sorted(want)


def test_drawn_others(spark):
    """Distinct members of the own group, never the own one; all of them where few; no row for unknown or null groups."""
    from namewright.operators.ranking import drawn_others

    members = [("big", i) for i in range(40)] + [("few", i) for i in (100, 101, 102)] + [("one", 7), (None, 8), ("big", None)]
    slots = [(s, "big", s % 50) for s in range(400)] + [(1000, "few", 101), (1001, "few", 5), (1002, "one", 7), (1003, "gone", 1), (1004, None, 8), (1005, "big", None)]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {}
    for r in drawn_others(made(slots, "slot long, g string, own long"), made(members, "g string, m long"), "g", "slot", "m", "own", 9).collect():
        got.setdefault(r["slot"], []).append(r["m"])
    for slot, group, own in slots[:400]:
        assert len(got[slot]) == len(set(got[slot])) == 9 and own not in got[slot] and set(got[slot]) <= set(range(40))
    assert sorted(got[1000]) == [100, 102] and sorted(got[1001]) == [100, 101, 102] and len(set(got[1005])) == 9
    assert not {1002, 1003, 1004} & got.keys()
    times = [sum(m in v for k, v in got.items() if k < 400) for m in range(40)]
    assert min(times) > 45 and max(times) < 140  # 90 expected each
    empty = drawn_others(made([], "slot long, g string, own long"), made([], "g string, m long"), "g", "slot", "m", "own", 9)
    assert empty.count() == 0


def test_hashed_numbers_and_folds(spark):
    """Numbers 1 to n of every group, a null one too, in the order of the hash; repeated keys get a number each."""
    import hashlib

    from namewright.operators.ranking import equal_folds, hashed_folds, hashed_order, number_hashed

    rows = [("a", i) for i in range(300)] + [(None, i) for i in range(7)] + [("b", 1), ("b", 1)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = number_hashed(df, ["g"], ["k"], seed=2).collect()
    for group in ("a", "b", None):
        mine = sorted((r["rank"], r["k"]) for r in got if r["g"] == group)
        keys = [k for g, k in rows if g == group]
        assert [k for _, k in mine] == sorted(keys, key=lambda k: hashlib.md5(f"2|{k}".encode()).hexdigest())
        assert [n for n, _ in mine] == list(range(1, len(keys) + 1))
    one, two = hashed_folds(df, ["g"], ["k"], 5, seed=2), equal_folds(df, ["g"], [hashed_order("k", seed=2), "k"], 5)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_name_maps_in_pieces(spark):
    """A large name comes in several rows, a small one in one; flattened they are the rows again; null names and persons are left out."""
    from namewright.sources import files

    rows = [("big", i % 60, i) for i in range(300)] + [("small", 1, 1000), ("small", 1, 1000), ("small", 2, 1001)]
    df = spark.createDataFrame([*rows, (None, 3, 5), ("small", None, 6)], "name string, aid long, pid long")
    nested = files.by_name(df, "name", "aid", "pid", per=50)
    got = nested.collect()
    assert sorted(r["piece"] for r in got if r["name"] == "small") == [0]
    pieces = [r["persons"] for r in got if r["name"] == "big"]
    assert 3 < len(pieces) <= 6 and max(sum(map(len, p.values())) for p in pieces) <= 120
    assert sum(len(p) for p in pieces) == 60  # each person in one piece
    back = files.flattened(nested.select("name", "persons"), "name", "persons").collect()
    assert sorted(tuple(r) for r in back) == sorted(rows)
    assert files.by_name(df.limit(0), "name", "aid", "pid").count() == 0
