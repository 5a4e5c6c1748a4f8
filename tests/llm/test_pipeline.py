"""The pipeline stage by stage, and the registered queries, on the smallest tables."""

import pytest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark, data):
    import corpus_pipeline as p
    from namewright.llm.common import documents
    from namewright.llm.quality import judge, learn
    from namewright.llm.simhash import fingerprint

    docs, kept = documents(spark, data), {}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, data)
        if name != "packing":
            assert docs.columns == COLUMNS
            kept[name] = docs.collect()
    ids = {k: [r["doc_id"] for r in v] for k, v in kept.items()}
    everything = documents(spark, data)
    good = {r["doc_id"] for r in judge(everything, learn(everything, spark.read.parquet(f"{data}/labels.parquet"))).where("kept").collect()}
    assert sorted(ids["quality rules"]) == sorted(good)
    squeezed = ["".join(r["text"].split()) for r in kept["exact dedup"]]
    assert len(set(squeezed)) == len(squeezed) == len({"".join(r["text"].split()) for r in kept["quality rules"]})
    marks = [fingerprint(r["text"]) for r in kept["SimHash near-dedup"]]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(marks) for b in marks[:i])
    assert set(ids["mixing sources"]) <= set(ids["SimHash near-dedup"])
    got = docs.collect()
    whole = sum(r["length"] for r in got if r["start"] == 0)
    assert whole and len([r for r in got if r["start"] == 0]) == len(ids["mixing sources"])
    again = p.run(spark, data).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_stages_on_repeated_and_null_ids(spark, data):
    """Every stage decides row by row: of two rows of one doc_id, or of none, one may stay."""
    import re
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    import corpus_pipeline as p
    from namewright.llm.common import documents
    from namewright.llm.mixing import WORD, mix
    from namewright.llm.quality import judge, learn
    from namewright.llm.simhash import fingerprint

    found = documents(spark, data).select(*COLUMNS).orderBy("doc_id").limit(150).collect()
    items = [({0: None, 1: 7}.get(i % 3, r["doc_id"]), *r[1:]) for i, r in enumerate(found)]
    items += [(None, *r[1:]) for r in found[:20]] + [(7, *r[1:]) for r in found[:10]] + [(None, "bad", "en", "s", 3), (7, "bad", "en", "s", 3)]
    docs = spark.createDataFrame(items, documents(spark, data).select(*COLUMNS).schema).repartition(3)
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())

    rules = learn(documents(spark, data), spark.read.parquet(f"{data}/labels.parquet"))
    texts = dict(enumerate(x[1] for x in items))
    unique = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    good = {r["doc_id"] for r in judge(unique, rules).where("kept").collect()}
    assert rows(p.quality_rules(spark, docs, data)) == Counter((items[i][0], texts[i]) for i in good)

    squeeze = lambda t: "".join((t or "").split())
    groups = defaultdict(list)
    for i, (key, *_) in enumerate(items):
        groups[squeeze(texts[i])].append((-len(texts[i] or ""), key is not None, key or 0, key))
    assert Counter((k, squeeze(t)) for (k, t), n in rows(p.exact_dedup(spark, docs, data)).items() for _ in range(n)) == Counter((min(m)[3], s) for s, m in groups.items())

    marks, root = [fingerprint(texts[i]) for i in range(len(items))], list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {c: min((items[i][0] is None, items[i][0] or 0) for i in range(len(items)) if root[i] == c) for c in set(root)}
    near = p.simhash_dedup(spark, docs, data).collect()
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in near) == Counter(least.values())

    total = mix(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(re.findall(WORD, r["text"] or "")) for r in p.mix_sources(spark, docs, data).collect()) == total


def test_empty_stages(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0


def test_sql_of_exact_dedup(spark, data):
    import duckdb

    from namewright.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, data)
        want = con.sql(sql)
        assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_for_each_operator(n):
    from namewright.llm.registry import QUERIES

    assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1


CONTRACTS = {
    1: "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    2: "doc_id bigint, held_out boolean, score double, predicted int",
    3: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    4: "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    5: "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    6: "doc_id bigint, held_out boolean, lang_pred string, score double",
    7: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    8: "doc_id bigint, fingerprint string, component_id bigint",
    9: "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    10: "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("n", CONTRACTS)
def test_columns_of_the_registered_queries(spark, data, n):
    """Names, types and, for queries of a row per document, every document once."""
    from namewright.llm.registry import QUERIES

    got = next(f for name, f in QUERIES.items() if name.startswith(f"op{n}_"))(spark, data)
    types = dict(got.dtypes)
    for column in CONTRACTS[n].split(", "):
        name, kind = column.split(" ")
        assert types[name] == kind, name
    ids = sorted(r["doc_id"] for r in got.select("doc_id").collect())
    want = sorted(r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect())
    assert (ids if n < 10 else sorted(set(ids))) == want


def test_toxicity_tells_held_out_documents_apart(spark):
    """Area under the curve on the fold that did not train."""
    from namewright.llm.registry import QUERIES

    at = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = [(r["score"], labels[r["doc_id"]]) for r in QUERIES["op2_toxicity"](spark, at).where("held_out").collect() if r["doc_id"] in labels]
    bad, good = ([s for s, y in got if y == k] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good)) > 0.85


def test_quality_list_agrees_with_labels(spark):
    from namewright.llm.registry import QUERIES

    at = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = [(r["kept"], labels[r["doc_id"]]) for r in QUERIES["op7_quality_rules"](spark, at).collect() if r["doc_id"] in labels]
    assert sum(kept == (y == 1) for kept, y in got) >= 0.93 * len(got)
    assert not any(kept for kept, y in got if y == 0)
