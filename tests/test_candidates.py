"""Slots against persons in tiles, against all pairs one by one: unknown years, no tokens, equal scores, one person, no person."""

from collections import Counter

import numpy as np
import pytest

from namewright.operators import candidates, ranking, tiles

rng = np.random.default_rng(5)
some = lambda n, most: [f"t{i}" for i in rng.choice(n, rng.integers(0, most + 1), replace=False)]
SLOTS = [(i, int(i) % 7, "abc"[i % 3] if i % 11 else None, None if i % 9 == 0 else 1990 + i % 8, some(40, 6), some(6, 4)) for i in range(60)]
PERSONS = [("ab"[i % 2], i, None if i % 5 == 0 else 1988 + i % 6, some(40, 20), some(6, 6)) for i in range(30)] + [("c", 99, 1991, ["t1"], [])]


@pytest.fixture(scope="module", params=[3, 1000])
def sides(spark, request):
    old = {k: getattr(candidates, k) for k in ("ONE", "SOME", "ALL")}
    for k in old:
        setattr(candidates, k, request.param)  # 3: many tiles, some of them empty
    slots = spark.createDataFrame(SLOTS, "pid bigint, true_aid bigint, block string, slot_year int, co array<string>, wo array<string>")
    yield slots, spark.createDataFrame(PERSONS, "block string, aid bigint, last_year int, co array<string>, wo array<string>")
    for k, v in old.items():
        setattr(candidates, k, v)


def brute():
    out = {}
    for pid, _, block, year, co, wo in SLOTS:
        for at, aid, last, theirs, words in PERSONS:
            if at == block:
                c, w, gap = len({*co} & {*theirs}), len({*wo} & {*words}), 20 if None in (year, last) else min(abs(year - last), 20)
                out.setdefault(pid, {})[aid] = (c, w, gap, round(1.5 * c + 0.33 * w - 0.1 * gap, 6))
    return out


def test_best(sides):
    got = {r.pid: (r.aid, r.score) for r in candidates.best(*sides).collect()}
    assert got == {pid: max(((a, v[3]) for a, v in of.items()), key=lambda x: (x[1], -x[0])) for pid, of in brute().items()}


def test_two_best(sides):
    got = {r.pid: r for r in candidates.two_best(*sides).collect()}
    for pid, of in brute().items():
        s = sorted((v[3] for v in of.values()), reverse=True)
        assert (got[pid].s1, got[pid].s2, got[pid].s0) == (s[0], s[1] if len(s) > 1 else None, s[-1]) and abs(got[pid].mean - sum(s) / len(s)) < 1e-9
    assert set(got) == set(brute()) and {r.top_gap for r in ranking.gap_of_best(candidates.two_best(*sides), ["pid"]).collect() if got[r.pid].s2 is None} == {0.0}


def test_ranks(sides):
    slots, persons = sides
    want = {}
    for pid, true, *_ in SLOTS:
        of = brute().get(pid, {})
        if true in of:
            want[pid] = 1 + sum((v[3], -a) > (of[true][3], -true) for a, v in of.items())
    assert len(want) > 10 and {r.pid: r["rank"] for r in candidates.ranks(slots, persons, "true_aid").collect()} == want


@pytest.mark.parametrize("least,touching", [(None, False), (2, False), (None, True)])
def test_pairs(sides, least, touching):
    got = {(r.pid, r.aid): (r.coauthors, r.words, r.gap, r.score) for r in candidates.pairs(*sides, least=least, touching=touching).collect()}
    assert got == {(p, a): v for p, of in brute().items() for a, v in of.items() if (least is None or v[3] >= least) and (not touching or v[0] + v[1])}


def test_overlaps_of_rare_tokens_are_counted(sides):
    """Of thousands of tokens no matrix is made."""
    import pyarrow as pa

    one = pa.table({"co": [[f"{i}", f"{i + 1}"] for i in range(3000)]})
    many = tiles.Overlaps(one, one, "co")
    assert not many.dense
    got = np.concatenate([many.strip(s) for s in tiles.strips(3000, 3000)])
    assert (got == 2 * np.eye(3000) + np.eye(3000, k=1) + np.eye(3000, k=-1)).all()


@pytest.mark.parametrize("touching", [False, True])
def test_tallies_and_their_values(spark, sides, touching):
    """Learners took a row for each pair, written and passed over again and again."""
    slots, persons = sides
    true = {s[0]: s[1] for s in SLOTS}
    want = {(pid, a, float(a == true[pid]), *v[:3]) for pid, of in brute().items() for a, v in of.items() if not touching or v[0] + v[1]}
    got = candidates.tallies(slots, persons, "true_aid", touching).groupBy("pid", "label", "coauthors", "words", "gap").sum("n").collect()
    assert {tuple(r) for r in got} == {(*k, n) for k, n in Counter((x[0], *x[2:]) for x in want).items()}
    values = spark.createDataFrame([(*r[:5], float(i)) for i, r in enumerate(got)], "pid bigint, label double, coauthors bigint, words bigint, gap int, v double")
    number = {tuple(r[:5]): float(i) for i, r in enumerate(got)}
    rows = candidates.valued(slots, persons, "true_aid", values, "v", touching).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == {(*x[:3], number[x[0], *x[2:]]) for x in want}
    labelled = candidates.pairs(slots, persons, touching=touching, true="true_aid").select("pid", "aid", "label", "coauthors", "words", "gap").collect()
    assert {tuple(r) for r in labelled} == want
