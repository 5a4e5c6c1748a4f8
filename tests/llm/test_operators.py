"""Each operator against brute force on a fixture with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

CLASHES = "key string, size string, part string, rid string, h string, label string, n string, fp string, ids string, rank string"
WORDS = "the of and erly thnd anble stion hewh inor esta rele quam idiot nuvo".split()


def texts():
    rnd = random.Random(5)
    base = [" ".join(rnd.choice(WORDS) + rnd.choice(["", "", ".", ","]) for _ in range(rnd.randint(1, 140))) for _ in range(40)]
    passage = " ".join(rnd.choice(WORDS) for _ in range(60))
    out = [None, "", " ", "\n\t", "one", "one two", *base]
    out += base[:6] + [base[1].replace(" ", "  \n"), base[2] + " tail", base[3].upper()]
    out += [b[:30] + passage + b[30:] for b in base[10:16]]
    out += ["naïve Größe 中文 текст " * 30, "中" * 130, "x" * 9000, " ".join(base) * 12, "ab " * 400]
    out += ['password = "hunter22x"', "token:abc", "AKIA" + "Z9" * 9, "deadbeef" * 5, "key q7Xk29ZpLm4Rt8Vw1NbY5c end", "550e8400-e29b-41d4-a716-446655440000", "2024-01-01-0000-1111-2222"]
    out += ["½ ² ③", "① Ⅷ", "²³ 4"]  # signs of numbers, no letters
    return out


def rows():
    out = [(i * 3, t, ("en", "fr", None)[i % 3], ("s1", "s2", None, "s1")[i % 4], *["x"] * 10) for i, t in enumerate(texts())]
    return [*out, (7, out[10][1], "en", "s1", *["x"] * 10), (None, "null keyed text of some words", "en", None, *["x"] * 10)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string, " + CLASHES).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < -5")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_secrets(docs, none):
    import re

    from namewright.llm import secrets

    got = by_id(secrets.find_secrets(docs))
    assert len(got) == len(rows())
    for key, text, *_ in rows():
        text, r = text or "", got[key]
        assign = [m for m in re.finditer(secrets.ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
        hexes = [m for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        access = [m for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (len(assign), len(access), len(hexes))
        base = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, ms) in enumerate((("assign", assign), ("access", access), ("hex", hexes))) for m in ms]
        listed = [x[2] for x in sorted(base)]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [x for x in r["span_list"].split(",") if x and not x.startswith("random")] == listed
    random_ones = [r["doc_id"] for r in got.values() if r["n_random"]]
    assert random_ones == [k for k, t, *_ in rows() if t and "q7Xk29" in t]
    assert secrets.find_secrets(none).count() == 0


@pytest.mark.parametrize(
    "text,spans",
    [
        ("a qWkZxTbNvRjPmLsDgHfYcKzQwXtBnVrJ b", ["random:2:34"]),  # letters alone
        ("getHttpResponseHandlerFactoryBean XMLHttpRequestEventTarget", []),
        ("donaudampfschifffahrtsgesellschaft Llanfairpwllgwyngyllgogery", []),
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", []),
        ("x q7XkZ9pLmR4t" + "0a1b2c3d4e5f6a7b8c9d0e1f" + "Qw8ZtVn2KxPj y", ["hex:14:38", "random:2:50"]),  # a longer key around a piece in hex
        ("my_password=q7Xk29ZpLm4Rt8Vw1NbY5c", ["assign:3:34"]),  # the few letters before are no key
        ("d41d8cd98f00b204e9800998ecf8427e", ["hex:0:32"]),
    ],
)
def test_secret_spans(text, spans):
    import public_tokenizers

    from namewright.llm import secrets

    found = secrets.scan(text, secrets.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), 20, 2.0)
    assert sorted(secrets.listed(found).split(",") if found else []) == sorted(spans)


def test_toxicity(spark, docs, none):
    from namewright.llm import toxicity

    labels = spark.createDataFrame([(k, int("idiot" in (t or "")), "x") for k, t, *_ in rows() if k is not None] + [(3, None, "x"), (99999, 1, "x")], "doc_id bigint, toxic int, text string")
    model = toxicity.fit(docs, labels)
    got = by_id(toxicity.score(docs, model))
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(k, t) for k, t, *_ in rows() if k is not None and zlib.crc32(str(k).encode()) % 5 == 0 and len(t or "") > 200]
    right = sum((got[k]["score"] >= 0.5) == ("idiot" in t) for k, t in held)
    assert right >= 0.6 * len(held)
    assert got[0]["score"] == got[3]["score"]
    assert toxicity.score(none, model).count() == 0
    flat, b = toxicity.fit(docs, labels.where("toxic = 1"))
    assert not flat.any() and b > 0
    assert not toxicity.fit(docs, labels.where("false"))[0].any()


def test_labels_of_held_out_rows_do_not_train(spark, docs):
    from namewright.llm import toxicity

    labels = [(k, int("idiot" in (t or ""))) for k, t, *_ in rows() if k is not None]
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    one, two = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in (labels, flipped))
    assert np.array_equal(one[0], two[0]) and one[1] == two[1]


@pytest.mark.parametrize("length", [20, 2048])
def test_token_output(docs, none, length):
    import public_tokenizers
    from tokenizers import Tokenizer

    from namewright.llm import tokenstore

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, manifest = tokenstore.write_tokens(docs, length=length, most=3000)
    assert manifest.count() > 4  # shards are cut by size, several of a task
    got = by_id(tokenstore.read_tokens(at, manifest))
    start, stream = 0, []
    for key, text, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (start, len(ids), crc(ids)), key
        start, stream = start + len(ids), stream + ids
    for r in manifest.collect():
        shard, real = tokenstore.Shard(at, r["name"]), []
        shard.source.seek(0)
        mapped = np.frombuffer(shard.source.read_buffer(), np.uint8)
        for i in range(-(-r["n_tokens"] // length)):
            ids, mask = shard.sequence(i)
            assert len(ids) == len(shard.unpacked(mask)) == length
            assert np.shares_memory(ids, mapped) and np.shares_memory(mask, mapped)  # both are views of the mapped file
            real += ids[shard.unpacked(mask)].tolist()
        assert real == stream[r["start"] : r["start"] + r["n_tokens"]]
    at, manifest = tokenstore.write_tokens(none)
    assert manifest.count() == 0 and tokenstore.read_tokens(at, manifest).count() == 0


@pytest.mark.parametrize("kind,name", [("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")])
def test_cached_ids_equal_whole_encoding(kind, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    from namewright.llm.tokens import encoder

    ids, tokenizer, rnd = encoder(public_tokenizers.path(name), kind), Tokenizer.from_file(public_tokenizers.path(name)), random.Random(2)
    letters = "ab cD'st 're\n\t  12٣é　 ́ \x1c\x85İſ.,!#_-—中\x00×÷"
    for t in [*(x or "" for x in texts()), "<|endoftext|> a", "a<|endoftext|>", *("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000))]:
        assert ids(t) == np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_dedup(docs, none, bits):
    """With one bit, almost all chunks share their hash, so identifiers must come from the contents."""
    import re

    from namewright.llm.exactdedup import dedup_exact

    got, groups = by_id(dedup_exact(docs, hash_bits=bits)), defaultdict(list)
    for key, text, *_ in rows():
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), key is not None, key or 0, key))
    for norm, members in groups.items():
        keep = min(members)[3]
        for *_, key in members:
            r = got[key]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(members), key == keep, hashlib.sha256(norm.encode()).hexdigest()), key
    assert dedup_exact(none).count() == 0


def test_exact_dedup_of_repeated_keys_with_clashing_hashes(spark):
    """Rows that share a key but not a text: corrections of identifiers go row by row."""
    from namewright.llm.exactdedup import dedup_exact

    rnd = random.Random(12)
    for _ in range(4):
        items = [(rnd.choice([None, 1, 2, 3]), "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 3)))) for _ in range(25)]
        groups = Counter(t.replace(" ", "") for _, t in items)
        for parts in (1, 4, 9):
            got = dedup_exact(spark.createDataFrame(items, "doc_id bigint, text string").repartition(parts), hash_bits=1).collect()
            assert sorted(r["group_size"] for r in got) == sorted(groups[t.replace(" ", "")] for _, t in items)
            assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    from namewright.llm.exactdedup import dedup_exact

    got = dedup_exact(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab")], "doc_id bigint, text string")).collect()
    assert sum(r["kept"] for r in got) == 1 and all(r["group_size"] == 3 and r["keep_id"] == 1 for r in got)


def brute_spans(items, span):
    seen, out = {}, {}
    for key, text in items:
        data = (text or "").encode()
        mark = bytearray(len(data))
        for i in range(len(data) - span + 1):
            if seen.get(data[i : i + span], key) < key:
                mark[i : i + span] = b"\1" * span
        for i in range(len(data) - span + 1):
            seen.setdefault(data[i : i + span], key)
        spans = sum(1 for i, x in enumerate(mark) if x and (i == 0 or not mark[i - 1]))
        out[key] = (len(data), sum(mark), spans, hashlib.sha256(bytes(d for d, x in zip(data, mark) if not x)).hexdigest())
    return out


def test_suffix_dedup(docs, none):
    from namewright.llm.suffix import dedup_spans

    got = by_id(dedup_spans(docs))
    items = sorted(((k if k is not None else -1, t) for k, t, *_ in rows()), key=lambda x: x[0])
    for key, want in brute_spans(items, 50).items():
        r = got[key if key >= 0 else None]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, key
    assert sum(r["n_removed"] for r in got.values()) > 1000
    assert dedup_spans(none).count() == 0


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_suffix_dedup_many_parts(docs, parts):
    """One part, and parts so many and small that a task reads several of them."""
    from namewright.llm.suffix import dedup_spans

    got = by_id(dedup_spans(docs.repartition(parts)))
    items = sorted(((k if k is not None else -1, t) for k, t, *_ in rows()), key=lambda x: x[0])
    for key, want in brute_spans(items, 50).items():
        r = got[key if key >= 0 else None]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, key


@pytest.mark.parametrize("heavy", [0, 20])
def test_suffix_dedup_heavy_anchors(spark, heavy):
    """A template before differing values: anchors above the bound are compared string by string, and no bucket sorts them."""
    from namewright.llm.suffix import dedup_spans

    rnd = random.Random(4)
    value = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    tails = [value(70) for _ in range(15)]
    items = [(i, value(30) + "Published under the terms of: " + (rnd.choice(tails) if i % 3 else value(70))) for i in range(150)]
    items += [(200, "x" * 300), (201, "y" + "x" * 200), (202, items[3][1]), (203, items[3][1] + tails[0])]
    got = by_id(dedup_spans(spark.createDataFrame(items, "doc_id bigint, text string").repartition(3), heavy=heavy))
    for key, want in brute_spans(items, 50).items():
        r = got[key]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, key
    assert sum(r["n_removed"] for r in got.values()) > 1000


@pytest.mark.parametrize("span", [20, 33, 90])
def test_suffix_dedup_other_spans(docs, span):
    from namewright.llm.suffix import dedup_spans

    got = by_id(dedup_spans(docs, span=span))
    items = sorted(((k if k is not None else -1, t) for k, t, *_ in rows()), key=lambda x: x[0])
    for key, want in brute_spans(items, span).items():
        r = got[key if key >= 0 else None]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, key


def test_suffix_dedup_of_repeated_rows(spark):
    """Rows of one key never take each other's bytes; a smaller key takes them from both."""
    from namewright.llm.suffix import dedup_spans

    text = "a passage that is long enough to be found twice and more in this table, " * 2
    got = dedup_spans(spark.createDataFrame([(5, text), (5, text), (5, text[9:])], "doc_id bigint, text string").repartition(3)).collect()
    assert all(r["n_removed"] == 0 for r in got)
    got = dedup_spans(spark.createDataFrame([(5, text), (5, text), (2, text[9:])], "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(r["n_removed"] for r in got) == [0, len(text), len(text)]


def test_suffix_array():
    from namewright.llm.suffix import suffix_array

    rnd = random.Random(3)
    for _ in range(400):
        a = np.array([rnd.randint(0, rnd.choice([1, 2, 5, 300])) for _ in range(rnd.randint(1, 70))], np.int64)
        assert suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def test_toxicity_ratios_by_counting(spark):
    """Log-count ratios of the n-grams that count, from plain counts of the rows that have them."""
    from namewright.llm import toxicity
    from namewright.llm.grams import gram_hashes

    rnd = random.Random(2)
    labelled = [(int(i % 3 == 0), " ".join(rnd.choice(WORDS[-3:] if i % 3 == 0 and j % 2 else WORDS[:10]) for j in range(12))) for i in range(120)] + [(1, ""), (0, "x")]
    grams, ratio = toxicity.ratios(spark.createDataFrame(labelled, "label int, text string").repartition(3), 41, 81)
    pos, neg = Counter(), Counter()
    for y, text in labelled:
        (pos if y else neg).update({int(g) for part in gram_hashes(text, toxicity.SIZES, toxicity.BITS) for g in part})
    want = {}
    for g in pos.keys() | neg.keys():
        r = np.log((pos[g] + 0.5) / 42.0) - np.log((neg[g] + 0.5) / 82.0)
        if pos[g] + neg[g] >= toxicity.FEWEST and abs(r) >= toxicity.CLEAR * np.sqrt(1 / (pos[g] + 0.5) + 1 / (neg[g] + 0.5)):
            want[g] = r
    assert dict(zip(grams.tolist(), ratio.round(9).tolist(), strict=True)) == {g: round(float(r), 9) for g, r in want.items()} and len(want) > 5


def test_language(docs, none):
    from namewright.llm import langid

    model = langid.fit(docs)
    assert model[0] == ["en", "fr"]
    got = by_id(langid.identify(docs, model))
    assert len(got) == len(rows())
    for key, text, *_ in rows():
        r = got[key]
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert langid.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}


def test_language_table_by_counting(docs):
    """Every n-gram's share of a language, halves added, from plain counts of the training texts."""
    from namewright.llm import langid
    from namewright.llm.grams import gram_hashes

    langs, table = langid.fit(docs)
    train = [r for r in docs.select("doc_id", "text", "lang").collect() if r["lang"] is not None and zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 != 2]
    for i, lang in enumerate(langs):
        counts = Counter()
        for r in train:
            if r["lang"] == lang:
                for grams in gram_hashes(r["text"] or "", langid.SIZES, langid.BITS):
                    counts.update(grams.tolist())
        total = sum(counts.values()) + 0.5 * 2**langid.BITS
        want = np.full(2**langid.BITS, 0.5)
        want[list(counts)] += list(counts.values())
        assert np.allclose(table[:, i], want / total, rtol=1e-6)


def test_more_languages_than_workers_hold(docs, monkeypatch):
    from namewright.llm import langid

    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.fit(docs)


def test_language_mixture():
    from namewright.llm.langid import proportions

    rng = np.random.default_rng(1)
    likely = rng.dirichlet(np.full(400, 0.1), 3).T + 1e-6
    likely /= likely.sum(axis=0)
    counts = rng.multinomial(1500, likely[:, 0]) + rng.multinomial(500, likely[:, 2])
    share = proportions(likely, counts)
    assert share[1] == 0 and abs(share[0] - 0.75) < 0.05
    alone = proportions(likely, rng.multinomial(800, likely[:, 1]))
    assert alone.tolist() == [0, 1, 0]


def test_language_accuracy_held_out(spark, data):
    from namewright.llm.langid import op6_language_id

    got = {r["doc_id"]: r for r in op6_language_id(spark, data).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    held = [k for k, r in got.items() if r["held_out"]]
    assert len(got) == len(truth) and sum(got[k]["lang_pred"] == truth[k] for k in held) >= 0.95 * len(held)


def test_quality_counts(docs, none):
    import re

    from namewright.llm import quality

    got = by_id(quality.judge(docs, []))
    for key, text, *_ in rows():
        text, r = text or "", got[key]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)), key
        assert (r["base_failed"], r["kept"]) == (failed, not failed)
    assert quality.judge(none, []).count() == 0


def test_quality_list(spark, docs):
    from namewright.llm import quality

    rng = np.random.default_rng(4)
    x = rng.random((900, 2))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 0] < 0.5))
    rules = quality.decision_list(x, bad, ["a", "b"])
    judged = np.zeros(900, bool)
    for rule in rules:
        judged |= quality.covered(rule, x, ["a", "b"])
    assert (judged == bad).mean() > 0.97 and 2 <= len(rules) <= 6
    assert quality.decision_list(x, np.zeros(900, bool), ["a", "b"]) == []
    assert quality.learn(docs, spark.createDataFrame([], "doc_id bigint, quality int")) == []
    got = quality.judge(docs, [[("mean_word", ">=", 4.0)], [("words", ">=", 1.0)]]).collect()
    assert all(r["rule"] == (None if not r["n_words"] else 0 if r["word_chars"] / r["n_words"] >= 4 else 1) for r in got)


def test_simhash(docs, none):
    import xxhash

    from namewright.llm.simhash import near_dedup

    got, marks = by_id(near_dedup(docs)), {}
    for key, text, *_ in rows():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in low.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        marks[key] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert got[key]["fingerprint"] == f"{marks[key]:016x}"
    root = {k: k for k in marks}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in marks:
        for b in marks:
            if (marks[a] ^ marks[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)), key=lambda k: (k is None, k or 0))
                root[y] = x
    assert all(got[k]["component_id"] == find(k) for k in marks)
    assert near_dedup(none).count() == 0


def test_tiles_lose_no_link():
    from namewright.llm import simhash

    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([seeds, *[seeds ^ (np.uint64(1) << np.uint64(i)) for i in (3, 17, 40)], rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if bin(int(fps[i] ^ fps[j])).count("1") <= 3}
    for fine in (1, 1 << 30):
        simhash.FINE, found = fine, set()
        simhash.compare(fps, fps, 3, lambda i, j, f=found: f.update(zip(i.tolist(), j.tolist(), strict=True)))
        assert found == want
    simhash.FINE = 1 << 22


def test_components(spark):
    from namewright.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (500, 400)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 400: 400, 500: 400}


def test_mixing(docs, none):
    import re

    from namewright.llm.mixing import mix

    first, again = by_id(mix(docs)), by_id(mix(docs.repartition(5)))
    assert {k: r["taken"] for k, r in first.items()} == {k: r["taken"] for k, r in again.items()}
    sizes, per = {}, defaultdict(int)
    for key, text, _, source, *_ in rows():
        sizes[key] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        per[source] += sizes[key]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    left, free, goal = float(sum(per.values())), set(order), {}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 3 * per[s]}
        goal |= {s: 3.0 * per[s] for s in over} if over else {s: unit * weight[s] for s in free}
        left, free = left - sum(goal[s] for s in over), free - over if over else set()
    taken = defaultdict(int)
    for key, _, _, source, *_ in rows():
        r = first[key]
        assert (r["size"], r["source_size"]) == (sizes[key], per[source]) and abs(r["target"] - goal[source]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and (r["taken"] == 0 if not r["size"] else r["taken"] % r["size"] == 0)
        taken[source] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.08 * goal[s] for s in order)
    assert mix(none).count() == 0


def test_budget_fit():
    from namewright.llm.mixing import fit

    rnd = random.Random(8)
    for reach in (64, 1 << 16):
        for _ in range(150):
            counts = {rnd.randint(1, 60): rnd.randint(1, 9) for _ in range(rnd.randint(1, 12))}
            budget = rnd.randint(0, sum(s * n for s, n in counts.items()))
            take = fit(counts, budget, reach)
            assert all(0 <= take[s] <= counts[s] for s in counts)
            got, sums = sum(s * n for s, n in take.items()), 1
            for s, n in counts.items():
                for _ in range(n):
                    sums |= sums << s
            best = min(abs(x - budget) for x in range(sums.bit_length()) if sums >> x & 1)
            assert abs(got - budget) == best if reach > 64 else abs(got - budget) <= 60


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from namewright.llm.packing import pack, sequences

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    places = pack(docs, length=64, with_ids=True)
    got = places.collect()
    want = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t, *_ in rows()}
    parts, rows_of = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r["key"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        rows_of[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, ids in want.items():
        at = 0
        for start, n, c, total in sorted(parts[key]):
            assert (start, c, total) == (at, crc(ids[at : at + n]), len(ids))
            at += n
        assert at == len(ids)
    for members in rows_of.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= 64
    least = -(-sum(map(len, want.values())) // 64)
    assert len(rows_of) <= least * 1.05 + 1
    packed = {r["sequence_id"]: r for r in sequences(places, 64).collect()}
    assert packed.keys() == rows_of.keys()
    assert all(r["n_real"] == sum(n for _, n in rows_of[i]) and len(r["ids"]) in (64, r["n_real"]) for i, r in packed.items())
    assert pack(none).count() == 0 and 'ids' not in pack(none).columns


def test_plan_is_best_fit_decreasing():
    from namewright.llm.packing import best_fit_decreasing

    rnd = random.Random(9)
    for _ in range(100):
        sizes = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 200))]
        room = []
        for s in sorted(sizes, reverse=True):
            fits = [(r, i) for i, r in enumerate(room) if r >= s]
            if fits:
                room[min(fits)[1]] -= s
            else:
                room.append(50 - s)
        plan = best_fit_decreasing(Counter(sizes), 50)
        used = defaultdict(int)
        for size, first, last, sequence, each, at in plan:
            for item in range(last - first):
                assert used[sequence + item // each] == at + item % each * size
                used[sequence + item // each] += size
        assert Counter(50 - r for r in room) == Counter(used.values())
