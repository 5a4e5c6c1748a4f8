"""Operators 11 to 13 against plain programs of their contracts."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_operators import CLASHES, rows

CLASHING = "text string, key string, code string, n string, part string, entry string, vector string, row string"


@pytest.fixture(scope="module")
def docs(spark):
    odd = ["<|endoftext|> plain", "▁ piece", " lead", "trail ", "a  b   c", "\x00\x1c", "<s></s><unk><0x41>", "é ﬁ", "\U0003fc3f՘'S it's", "the the the", "of the\nof the"]
    more = [(1000 + i, t, "en", "s1", *["x"] * 10) for i, t in enumerate(odd)]
    return spark.createDataFrame([*rows(), *more], "doc_id bigint, text string, lang string, source string, " + CLASHES).repartition(3)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def encoded(text):
    import base64

    import public_tokenizers as P
    import tiktoken

    if "e" not in CACHE:
        with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        CACHE["e"] = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return CACHE["e"].encode_ordinary(text)


CACHE = {}


def test_byte_bpe(docs):
    from namewright.llm import bytebpe

    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = encoded(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert listed(bytebpe.digests(docs)) == sorted(want, key=repr)
    assert bytebpe.digests(docs.where("doc_id < -5")).count() == 0


def test_byte_bpe_random_texts():
    import public_tokenizers as P

    from namewright.llm.bytebpe import codec

    ids, spelling = codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rnd = random.Random(3)
    pool = ["a", "b", " ", "  ", "\n", "'s", "'S", "'ll", "é", "中", "的", "\t", "\x00", "\x85", "1", "²", "!", "кот", "՘", "࢏", "\U0003fc3f", "\U0001247a", "é", "ab" * 30, "中" * 300, "x" * 700]
    for i in range(4000):
        top = rnd.choice([0x300, 0x3000, 0x110000])
        text = "".join(rnd.choice(pool) if i % 3 else chr(c) for c in (rnd.randrange(top) for _ in range(rnd.randint(0, 20))) if not 0xD800 <= c < 0xE000)
        got = np.frombuffer(ids(text), "<u4")
        assert got.tolist() == encoded(text)
        assert spelling.of(got).tobytes() == text.encode()


def test_byte_bpe_takes_entries_that_no_merges_reach(tmp_path):
    import base64

    from namewright.llm.bytebpe import codec

    ranks = {**{bytes([b]): b for b in range(256)}, b"abc": 256}
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(k) + b" %d" % v for k, v in ranks.items()))
    ids, _ = codec(str(path), r"\w+|\s")
    assert np.frombuffer(ids("abc abcd"), "<u4").tolist() == [256, 32, 97, 98, 99, 100]


def alignment(texts):
    """Contract 12 by loops over tokens."""
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, pre_tokenizers

    side_a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    side_a.encode_special_tokens = True
    side_b = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    byte_of = {pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]: b for b in range(128)}
    for b in range(128, 256):  # two bytes a character: the second one's sign is the last
        for lead in (0xC2, 0xC3):
            c = bytes([lead, b]).decode(errors="ignore")
            if c:
                signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]
                byte_of[signs[0]], byte_of[signs[1]] = lead, b
    for c in ("ф", "ࠀ", "中", "\U0001f600", "\U0010ffff", *map(chr, range(0x100, 0x800, 0x40)), *map(chr, range(0x800, 0xD800, 0x400)), *map(chr, range(0xE000, 0x10000, 0x400)), *map(chr, range(0x10000, 0x110000, 0x4000))):
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]
        byte_of.update(zip(signs, c.encode(), strict=True))
    out, docs_of = [], Counter()
    for text in texts:
        raw = f" {text}".encode()
        a, b = (side_a.encode(f" {text}", add_special_tokens=False).ids, side_b.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte_of[c] for c in side_a.id_to_token(i)) for i in a]
        pieces = [side_b.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            out.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j, at_a, at_b = [], 0, 0, {e: n for n, e in enumerate(ends_a)}, {e: n for n, e in enumerate(ends_b)}
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = at_a[end] + 1, at_b[end] + 1
            groups.append((a[i:to_a], b[j:to_b]))
            i, j = to_a, to_b
        links, since = [], 0
        for x, end, size in zip(a, ends_a, map(len, bytes_a), strict=True):
            while since and ends_b[since - 1] > end - size:
                since -= 1
            while ends_b[since] <= end - size:
                since += 1
            for at in range(since, len(b)):
                if ends_b[at] - len(bytes_b[at]) >= end:
                    break
                links.append((x, b[at]))
        docs_of.update(set(links))
        out.append((a, b, groups, links))
    best = defaultdict(int)
    for (x, _), n in docs_of.items():
        best[x] = max(best[x], n)
    spelled = [";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g) for _, _, g, _ in out]
    return [
        (len(a), len(b), len(g), len(ls), sum(docs_of[x] == best[x[0]] for x in ls), sum(docs_of[x] for x in ls), hashlib.sha256(s.encode()).hexdigest() if a else "")
        for (a, b, g, ls), s in zip(out, spelled, strict=True)
    ]


@pytest.fixture(scope="module")
def by_loops(docs):
    got = docs.select("doc_id", "text").collect()
    return sorted(((r["doc_id"], *x) for r, x in zip(got, alignment([r["text"] for r in got]), strict=True)), key=repr)


@pytest.mark.parametrize("most,run,held", [(1 << 19, 1 << 22, 1 << 22), (40, 3000, 50), (0, 1, 1)])
def test_alignment(docs, by_loops, monkeypatch, most, run, held):
    """Also with hardly any broadcast pair, runs of a document each and tiny tables in tasks."""
    from namewright.llm import align

    monkeypatch.setattr(align, "RUN", run)
    monkeypatch.setattr(align, "HELD", held)
    assert listed(align.aligned(docs, most=most)) == by_loops


def test_alignment_of_nothing(docs):
    from namewright.llm import align

    assert align.aligned(docs.where("doc_id < -5")).count() == 0


def vector_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Contract 11 by comparing every part with every entry, in whole numbers."""
    good = [(k, [math.floor(scale * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(len(v) for _, v, _ in good)
    width = -(-width // parts) * parts
    w = width // parts
    cut = [[(v + [0] * (width - len(v)))[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in good]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            members = defaultdict(list)
            for x in cut:
                members[nearest(x[p], books[p])[1]].append(x[p])
            for e, xs in members.items():
                new[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
        books = new
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    coded = [(k, [nearest(x[p], books[p]) for p in range(parts)], label) for (k, _, label), x in zip(good, cut, strict=True)]
    error = [min(sum(d for d, _ in c), (1 << 63) - 1) for _, c, _ in coded]
    of_label = Counter()
    for (_, _, label), e in zip(coded, error, strict=True):
        of_label[label] += e
    return [(k, "".join(f"{i:02x}" for _, i in c), e, min(of_label[label], (1 << 63) - 1), digest) for (k, c, label), e in zip(coded, error, strict=True)]


def vectors(n, width, seed, scale=1.0):
    rnd = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in v] for v in rnd.normal(0, scale, (n, width)).round(2)]


@pytest.mark.parametrize("entries,n", [(256, 120), (32, 150), (20, 90), (1, 30)])
def test_vector_codes(spark, entries, n):
    from namewright.llm import veccodes

    base = vectors(n, 8, 4)
    rows = [(i * 2 if i % 9 else i, v, (i % 3) or None) for i, v in enumerate(base)] + [(5, base[3], 1), (5, base[4], 1), (None, base[5], 2), (None, base[6], None)]
    rows += [(9000, None, 1), (9001, [1.0, None] + [0.0] * 6, 1), (9002, [float("nan")] * 8, 1), (-9, [float("inf")] + [0.0] * 7, 2)]
    df = spark.createDataFrame([(*r, *["x"] * 8) for r in rows], "vec_id bigint, embedding array<float>, label int, " + CLASHING).repartition(3)
    assert listed(veccodes.compressed(df, entries=entries)) == sorted(vector_codes(rows, entries=entries), key=repr)


def test_vector_codes_odd_tables(spark):
    from namewright.llm import veccodes

    kinds = "vec_id bigint, embedding array<float>, label int"
    none = spark.createDataFrame([(1, None, 1)], kinds)
    assert veccodes.compressed(none).count() == 0
    assert veccodes.compressed(none.where("vec_id < 0")).count() == 0
    ragged = [(1, [1.0, -2.0, 3.0], None), (2, [], None), (3, [0.5] * 6, 7), (4, [-1.5] * 5, 7)]
    assert listed(veccodes.compressed(spark.createDataFrame(ragged, kinds), entries=3)) == sorted(vector_codes(ragged, entries=3), key=repr)
    large = [(i, [x * 10.0 ** (i % 16) for x in v], i % 2) for i, v in enumerate(vectors(60, 8, 9))]
    doubles = spark.createDataFrame(large, "vec_id bigint, embedding array<double>, label int")
    cut_off = [(k, [max(min(x, 2.0**52), -(2.0**52)) for x in v], label) for k, v, label in large]
    assert listed(veccodes.compressed(doubles, entries=24)) == sorted(vector_codes(cut_off, entries=24), key=repr)


def test_tree_visits_what_brute_force_finds():
    from namewright.llm.veccodes import Vantage

    rnd = np.random.default_rng(2)
    for width in (1, 2, 16):
        entries = rnd.integers(-4, 5, (256, width)).astype(float)  # many ties
        x = rnd.integers(-5, 6, (800, width)).astype(float)
        far = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        for kind in (float, object):
            index, best = Vantage(entries.astype(int).astype(kind)).nearest(x.astype(int).astype(kind))
            assert (index == far.argmin(1)).all() and (best.astype(float) == far.min(1)).all()


def test_decoded_vectors_are_near(spark):
    from namewright.llm import veccodes

    base = vectors(80, 8, 6)
    df = spark.createDataFrame(list(enumerate(base)), "vec_id bigint, embedding array<float>")
    rows = veccodes.kept(df, "vec_id", "embedding", None)
    books = veccodes.train(rows, 8, 4, 80, 1, 1024)
    back = veccodes.decode(veccodes.encode(rows, books, 8, 1024), books)
    for r in back.collect():
        assert max(abs(x - y) for x, y in zip(r["vector"], base[r["key"]], strict=True)) <= 1 / 1024
