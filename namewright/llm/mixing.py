"""Operator 9, mixing sources to target weights by subset-sum budget fitting.

Targets come from the weights by water filling under a cap of ``most`` times a source's
size. A source takes all its documents as often as whole passes fit; the rest of its
budget is fitted on counts of documents by exact size: every size gives its share
rounded down, largest sizes first fill what is left, and a bounded-knapsack dynamic
program over the documents not yet counted meets the last part of the budget exactly or
as nearly as sizes allow. Which documents of a size are taken is decided by a seeded
hash, so reruns agree.

Edge cases: null text has size 0 and takes 0; a null source is a source of its own, last
in order; repeated rows are separate documents (equal keys are taken together with a
tie-break on the text's hash and then arbitrary but equal rows); an empty table gives an
empty one; sources of total size 0 have target 0; extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.llm.common import documents, prepare, written

WORD = r"[^\x20\x09-\x0D]+"
#: The dynamic program covers budgets up to this many words; more is first filled greedily.
KNAPSACK = 1 << 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of all sizes by weight, none above ``most`` times its own size."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        if not (over := {i for i in free if unit * weights[i] > most * sizes[i]}):
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free -= over
    return out


def fit(counts: dict[int, int], budget: int, reach: int = KNAPSACK) -> dict[int, int]:
    """Documents to take by size, at most ``counts`` of each, with a sum near ``budget``.

    Proportional counts first, then the largest that fit, until the dynamic program's
    reach; then reachable sums as bits of one integer, a bounded number of each size by
    binary splitting, traced back from the sum nearest the budget, below or above it.
    """
    sizes = sorted((s for s in counts if s > 0), reverse=True)
    total = sum(s * counts[s] for s in sizes)
    if budget >= total:
        return {s: counts[s] for s in sizes}
    # Room is left for the program to choose among sizes: it gets the budget below `hold`.
    hold = budget if budget <= reach else reach // 2
    take = {s: counts[s] * (budget - hold) // total for s in sizes}
    left = budget - sum(s * n for s, n in take.items())
    for s in sizes:
        if left <= reach:
            break
        n = min(counts[s] - take[s], (left - reach // 2) // s)
        take[s], left = take[s] + n, left - n * s
    if left > reach:
        for s in sizes:  # only documents longer than the reach are left over
            n = min(counts[s] - take[s], left // s)
            take[s], left = take[s] + n, left - n * s
    # Sums up to twice the rest: beyond, taking nothing is nearer.
    mask, sums, lots = (1 << (2 * left + 1)) - 1, 1, []
    for s in sizes:
        free, step = min(counts[s] - take[s], 2 * left // s), 1
        while free > 0:
            n = min(step, free)
            lots.append((s, n, sums))
            sums |= (sums << (s * n)) & mask
            free, step = free - n, step * 2
        if sums >> left & 1:
            break
    below = (sums & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = left + ((x := sums >> left) & -x).bit_length() - 1 if sums >> left else 3 * left
    at = below if left - below <= above - left else above
    for s, n, before in reversed(lots):
        if not before >> at & 1:
            take[s], at = take[s] + n, at - s * n
    return take


def chosen(rows: DataFrame, quota: DataFrame, levels: int = 2) -> DataFrame:
    """Marks, in each (source, size), the rows with the lowest seeded hashes, as many as its quota.

    No window over a whole group: counts by 8 more bits of the hash at each level give
    the one slice in which the quota ends; only that slice's rows are ranked.
    """
    keys = ["source_id", "size"]
    slice_of = lambda level: F.shiftrightunsigned("hash", 64 - 8 * level)
    sure, rest, goal, by = [], rows, quota, keys
    for level in range(1, levels + 1):
        # Rows are counted by slice before they meet the quota, and meet it by slice, so no join is by (source, size) alone.
        sliced = rest.withColumn("slice", slice_of(level))
        counted = sliced.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("n")).join(goal.where("quota > 0"), keys)
        running = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("slice")))
        cut = written(running.where("upto - n < quota").select(*keys, "slice", (F.col("quota") - F.col("upto") + F.col("n")).alias("open"), "n"), "cut")
        met = sliced.join(cut, [*keys, "slice"])
        sure.append(met.where("open >= n").select("rid"))
        rest = met.where("open < n").select("rid", *keys, "hash", "key", F.col("open").alias("quota"))
        goal = cut.where("open < n").select(*keys, F.col("open").alias("quota"))
        if level < levels:
            rest = rest.drop("quota")
    ranked = rest.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("hash", "key", "rid")))
    sure.append(ranked.where("place <= quota").select("rid"))
    out = sure[0]
    for x in sure[1:]:
        out = out.unionAll(x)
    return out


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, weights=(5, 2, 1), most: float = 3.0, seed: int = 9, row: str | None = None) -> DataFrame:
    """One row per input row: key, size, source_size, target, taken, rid (the unique row id that ``row`` names, or an own one).

    The driver holds one row per source (the mixture's own table), executors one
    histogram of sizes per source; all rows are only counted, hashed and marked.
    """
    spark = prepare(df.sparkSession)
    rows = written(
        df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text))).alias("hash"), F.col(row).alias("rid") if row else F.monotonically_increasing_id().alias("rid")),
        "sizes",
    )
    per = rows.groupBy("source").agg(F.sum("size").cast("bigint").alias("n")).collect()
    per = sorted(per, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    goal = targets([r["n"] for r in per], [float(weights[i % len(weights)]) for i in range(len(per))], most)
    table = spark.createDataFrame([(i, r["source"], r["n"], t, int(t // r["n"]) if r["n"] else 0, 0) for i, (r, t) in enumerate(zip(per, goal, strict=True))], "source_id int, source string, source_size bigint, target double, passes int, spare int")
    known = rows.join(table.select("source_id", "source", "source_size", "target", "passes"), rows["source"].eqNullSafe(table["source"])).drop("source")

    def op(key, part):
        counts = dict(zip(part["size"].to_pylist(), part["n"].to_pylist(), strict=True))
        budget = round(part["target"][0].as_py() - part["passes"][0].as_py() * part["source_size"][0].as_py())
        got = fit(counts, budget)
        return pa.table({"source_id": pa.array([key[0].as_py()] * len(got), pa.int32()), "size": pa.array(list(got), pa.int64()), "quota": pa.array(list(got.values()), pa.int64())})

    counted = known.where("size > 0").groupBy("source_id", "size", "source_size", "target", "passes").agg(F.count(F.lit(1)).alias("n"))
    quota = written(counted.groupBy("source_id").applyInArrow(op, "source_id int, size bigint, quota bigint"), "quota")
    extra = chosen(known.select("rid", "key", "source_id", "size", "hash"), quota).withColumn("one", F.lit(1))
    out = known.join(extra, "rid", "left")
    times = F.when(F.col("size") > 0, F.col("passes") + F.coalesce("one", F.lit(0))).otherwise(0)
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (times * F.col("size")).cast("bigint").alias("taken"), "rid")


def op9_mixing(spark, sf_dir):
    """Contract 9 over all documents."""
    return mix(documents(spark, sf_dir)).drop("rid")
