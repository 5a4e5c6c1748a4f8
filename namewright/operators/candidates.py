"""Slots against the persons of their block, in tiles.

Slots are (pid, block, slot_year, co, wo), persons (block, aid, last_year, co, wo) with
distinct tokens in ``co`` and ``wo``. A score is 1.5 common co-authors + 0.33 common words
- 0.1 x the gap in years, counted in hundredths, so it is exact. What a query needs of a
slot is reduced within a tile of persons; pairs become rows only where they are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewright.operators.tiles import Overlaps, between, lists, numbers, strips

#: Rows of a tile where a slot gives one row, some, or one for each person.
ONE, SOME, ALL = 16384, 4096, 1024
MOST_GAP = 20


def hundredths(co: Column, wo: Column, gap: Column) -> Column:
    return (150 * co + 33 * wo - 10 * gap).cast("bigint")


def scored(a: pa.Table, b: pa.Table):
    """(strip, co-authors, words, gap, hundredths) of all pairs; ``b`` has to be in the order of aid."""
    co, wo = Overlaps(a, b, "co"), Overlaps(a, b, "wo")
    year, last = numbers(a, "slot_year").astype(np.float32), numbers(b, "last_year").astype(np.float32)
    for s in strips(a.num_rows, b.num_rows):
        c, w = co.strip(s), wo.strip(s)
        gap = np.fmin(np.abs(year[s, None] - last), np.float32(MOST_GAP))  # an unknown year counts as the most
        yield s, c, w, gap, 150 * c + 33 * w - 10 * gap


def by_aid(b: pa.Table) -> pa.Table:
    return b.sort_by("aid")


def types(slots: DataFrame, persons: DataFrame) -> str:
    return f"pid {slots.schema['pid'].dataType.simpleString()}, aid {persons.schema['aid'].dataType.simpleString()}"


def best(slots: DataFrame, persons: DataFrame) -> DataFrame:
    """(pid, aid, score): each slot's best person, the smallest aid among equals."""

    def judge(a: pa.Table, b: pa.Table) -> pa.Table:
        b = by_aid(b)
        top, most = np.empty(a.num_rows, np.int64), np.empty(a.num_rows)
        for s, _, _, _, h in scored(a, b):
            top[s] = h.argmax(axis=1)
            most[s] = h[np.arange(len(h)), top[s]]
        return pa.table({"pid": a.column("pid"), "aid": b.column("aid").take(pa.array(top)), "h": most.astype(np.int64)})

    parts = between(slots, persons, "block", ("pid", "aid"), ONE, judge, types(slots, persons) + ", h bigint")
    first = parts.groupBy("pid").agg(F.min(F.struct((-F.col("h")).alias("less"), "aid")).alias("first"))
    return first.select("pid", "first.aid", (-F.col("first.less") / 100.0).alias("score"))


def two_best(slots: DataFrame, persons: DataFrame) -> DataFrame:
    """(pid, s1, s0, mean, s2): of each slot the best, worst, mean and second best score; the second is null if it has one person, and the best again if that occurs twice."""

    def judge(a: pa.Table, b: pa.Table) -> pa.Table:
        out = np.empty((4, a.num_rows))
        for s, _, _, _, h in scored(a, b):
            here, top = np.arange(len(h)), h.argmax(axis=1)
            out[0, s], out[2, s], out[3, s] = h[here, top], h.min(axis=1), h.sum(axis=1, dtype=np.float64)
            h[here, top] = -np.inf
            out[1, s] = h.max(axis=1)
        alone = np.full(a.num_rows, b.num_rows == 1)
        out[1, alone] = 0
        s1, s2, s0, total = out.astype(np.int64)
        return pa.table({"pid": a.column("pid"), "s1": s1, "s2": pa.array(s2, mask=alone), "s0": s0, "total": total, "n": np.full(a.num_rows, b.num_rows)})

    fields = slots.schema["pid"].dataType.simpleString()
    parts = between(slots, persons, "block", ("pid", "aid"), ONE, judge, f"pid {fields}, s1 bigint, s2 bigint, s0 bigint, total bigint, n bigint")
    two = F.sort_array(F.flatten(F.collect_list(F.array("s1", "s2"))), asc=False)  # two of each tile
    out = parts.groupBy("pid").agg(two.alias("two"), F.min("s0").alias("s0"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    return out.select("pid", (F.col("two")[0] / 100.0).alias("s1"), (F.col("s0") / 100.0).alias("s0"), (F.col("total") / 100.0 / F.col("n")).alias("mean"), (F.col("two")[1] / 100.0).alias("s2"))


def ranks(slots: DataFrame, persons: DataFrame, aid: str) -> DataFrame:
    """(pid, rank) of each slot's person ``aid``, if that is a candidate: better scores and equal ones of smaller ids are counted."""
    theirs = persons.select("block", F.col("aid").alias(aid), "last_year", F.col("co").alias("co_"), F.col("wo").alias("wo_"))
    common = lambda c: F.size(F.array_intersect(c, f"{c}_"))
    gap = F.least(F.abs(F.col("slot_year") - F.col("last_year")), F.lit(MOST_GAP))
    own = slots.join(theirs, ["block", aid]).withColumn("own", hundredths(common("co"), common("wo"), gap)).select("pid", "block", "slot_year", "co", "wo", aid, "own")

    def judge(a: pa.Table, b: pa.Table) -> pa.Table:
        mine, true, ids, ahead = numbers(a, "own"), numbers(a, aid), numbers(b, "aid"), np.empty(a.num_rows, np.int64)
        for s, _, _, _, h in scored(a, b):
            ahead[s] = ((h > mine[s, None]) | ((h == mine[s, None]) & (ids < true[s, None]))).sum(axis=1)
        return pa.table({"pid": a.column("pid"), "ahead": ahead})

    parts = between(own, persons, "block", ("pid", "aid"), ONE, judge, f"pid {slots.schema['pid'].dataType.simpleString()}, ahead bigint")
    return parts.groupBy("pid").agg((F.sum("ahead") + 1).alias("rank"))


def kept_pairs(c: np.ndarray, w: np.ndarray, h: np.ndarray, least: float | None, touching: bool) -> tuple[np.ndarray, np.ndarray]:
    keep = np.ones(h.shape, bool) if least is None else h >= round(100 * least)
    if touching:
        keep &= (c > 0) | (w > 0)
    return np.nonzero(keep)


def pairs(slots: DataFrame, persons: DataFrame, least: float | None = None, touching: bool = False, true: str | None = None) -> DataFrame:
    """(pid, aid, coauthors, words, gap, score) of every slot and person of its block; only those of a score of ``least`` or more, or with something in common (``touching``), where asked.

    ``true``, the column of a slot's own person, adds ``label``, 1.0 where that is the pair's.
    """

    def judge(a: pa.Table, b: pa.Table) -> pa.Table:
        pid, aid, out = numbers(a, "pid"), numbers(b, "aid"), []
        for s, c, w, gap, h in scored(a, b):
            i, j = kept_pairs(c, w, h, least, touching)
            rows = {"pid": pid[s][i], "aid": aid[j], "coauthors": c[i, j].astype(np.int64), "words": w[i, j].astype(np.int64), "gap": gap[i, j].astype(np.int32), "score": h[i, j].astype(np.float64) / 100}
            if true:
                rows["label"] = (numbers(a, true)[s][i] == aid[j]).astype(np.float64)
            out.append(pa.table(rows))
        return pa.concat_tables(out)

    schema = types(slots, persons) + ", coauthors bigint, words bigint, gap int, score double" + (", label double" if true else "")
    return between(slots, persons, "block", ("pid", "aid"), ALL if least is None else SOME, judge, schema)


def kind(co, wo, gap):
    """A number for the features of a pair, of columns or arrays."""
    return (co * (1 << 24) + wo) * 32 + gap


def kinds(c: np.ndarray, w: np.ndarray, gap: np.ndarray) -> np.ndarray:
    return kind(c.astype(np.int64), w.astype(np.int64), gap.astype(np.int64))


def tallies(slots: DataFrame, persons: DataFrame, true: str, touching: bool = False) -> DataFrame:
    """(pid, label, coauthors, words, gap, n): how many persons of each features a slot has, by tile of persons.

    Pairs of equal features are equal to whatever learns from them, so learners take these rows, weighted by ``n``, instead of the square of a block.
    """

    def judge(a: pa.Table, b: pa.Table) -> pa.Table:
        pid, own, aid, out = numbers(a, "pid"), numbers(a, true), numbers(b, "aid"), []
        for s, c, w, gap, h in scored(a, b):
            label, most = own[s, None] == aid[None, :], int(w.max(initial=0)) + 1
            code = ((c.astype(np.int64) * most + w.astype(np.int64)) * (MOST_GAP + 1) + gap.astype(np.int64)) * 2 + label
            width = int(code.max(initial=0)) + 1
            code += width * np.arange(len(code))[:, None]
            at = code[(c > 0) | (w > 0)] if touching else code.ravel()
            if width * len(code) <= 8 * code.size:
                n = np.bincount(at, minlength=1)
                at = np.flatnonzero(n)
                n = n[at]
            else:
                at, n = np.unique(at, return_counts=True)
            row, rest = np.divmod(at, width)
            rest, label = np.divmod(rest, 2)
            rest, gap = np.divmod(rest, MOST_GAP + 1)
            co, wo = np.divmod(rest, most)
            out.append(pa.table({"pid": pid[s][row], "label": label.astype(np.float64), "coauthors": co, "words": wo, "gap": gap.astype(np.int32), "n": n.astype(np.int64)}))
        return pa.concat_tables(out)

    fields = slots.schema["pid"].dataType.simpleString()
    return between(slots, persons, "block", ("pid", "aid"), ONE, judge, f"pid {fields}, label double, coauthors bigint, words bigint, gap int, n bigint")


def valued(slots: DataFrame, persons: DataFrame, true: str, values: DataFrame, value: str, touching: bool = False) -> DataFrame:
    """(pid, aid, label, value) of the pairs, whose value is that of their slot and features in ``values`` (pid, label, coauthors, words, gap, value).

    A slot takes its values along into the tiles, so no pair is shuffled to be looked up.
    """
    code = (2 * kind(F.col("coauthors"), F.col("words"), F.col("gap")) + F.col("label")).cast("bigint")
    listed = F.array_sort(F.collect_list(F.struct(code.alias("code"), F.col(value).alias("value"))))
    own = values.groupBy("pid").agg(listed.alias("own_")).select("pid", F.col("own_.code").alias("codes"), F.col("own_.value").alias("values"))

    def judge(a: pa.Table, b: pa.Table) -> pa.Table:
        pid, mine, aid, out = numbers(a, "pid"), numbers(a, true), numbers(b, "aid"), []
        (lengths, _, codes), (_, _, found) = lists(a, "codes"), lists(a, "values")
        ends, codes, found = np.cumsum(lengths), codes.to_numpy(zero_copy_only=False), found.to_numpy(zero_copy_only=False)
        for s, c, w, gap, h in scored(a, b):
            i, j = kept_pairs(c, w, h, None, touching)
            label = mine[s][i] == aid[j]
            wanted, got = 2 * kinds(c, w, gap)[i, j] + label, np.empty(len(i))
            bounds = np.searchsorted(i, np.arange(s.stop - s.start + 1))
            for row in range(s.stop - s.start):
                of, at = slice(bounds[row], bounds[row + 1]), slice(ends[s.start + row] - lengths[s.start + row], ends[s.start + row])
                got[of] = found[at][np.searchsorted(codes[at], wanted[of])]
            out.append(pa.table({"pid": pid[s][i], "aid": aid[j], "label": label.astype(np.float64), value: got}))
        return pa.concat_tables(out)

    return between(slots.join(own, "pid"), persons, "block", ("pid", "aid"), ALL, judge, types(slots, persons) + f", label double, {value} double")
