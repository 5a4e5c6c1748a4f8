"""Windows over groups: splits, ranks, top-k, gaps, folds, sampling (W and R rows).

Every order ends in an id, so results do not depend on the order of input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.sources.shared import written


def running(df: DataFrame, by: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums, the row itself included, of groups of any size; nulls are a group.

    Rows are cut into ranges of group and order and written; a range is summed by itself
    and starts from what its group has in the ranges before, so no task holds a group.
    """
    ranged = written(df.withColumns(sums).repartitionByRange(*by, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    here = Window.partitionBy(*by, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "range_").agg(*[F.sum(c).alias(c) for c in sums])
    starts = totals.select(*[F.col(c).alias(f"of_{c}_") for c in (*by, "range_")], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"start_{c}_") for c in sums])
    same = F.col("range_") == F.col("of_range__")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}_"))
    rows = ranged.withColumns({c: F.sum(c).over(here) for c in sums}).join(starts, same)
    return rows.select(*df.columns, *[(F.col(c) + F.col(f"start_{c}_")).alias(c) for c in sums])


def number_large(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """Row numbers within groups of any size."""
    return running(df, by, order, {name: F.lit(1).cast("bigint")})


def numbered(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark prunes with a group limit before the shuffle."""
    return numbered(df, by, order, "rank_").where(F.col("rank_") <= k).drop("rank_")


def top_1(df: DataFrame, by: list[str], score: str, tie: str, keep: list[str]) -> DataFrame:
    """Each group's best row by one aggregation (map-side combined), the smallest tie id among equals."""
    best = F.min_by(F.struct(*keep), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t")))
    return df.groupBy(*by).agg(best.alias("best")).select(*by, *[F.col(f"best.{c}").alias(c) for c in keep])


def temporal_split(df: DataFrame, by: str, order: list, share: float, rounding: str) -> DataFrame:
    """Adds ``is_new`` for the newest part of each group.

    ``rounding`` "profile" floors the size of the old part, "unassigned" that of the new.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    old = F.floor(n * F.lit(1 - share)) if rounding == "profile" else n - F.floor(n * F.lit(share))
    return df.withColumn("is_new", rank > old)


def hashed_order(*cols, seed: int = 0) -> Column:
    """An order that looks random and is the same on every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def number_hashed(df: DataFrame, by: list[str], key: list[str], seed: int = 0, name: str = "rank") -> DataFrame:
    """Row numbers within groups of any size in the order of ``hashed_order(*key)``, then ``key``; nulls are a group.

    Rows are counted and numbered within 4,096 slices of the hash, so no task holds a group
    and no range of the order has to be found first.
    """
    sliced = df.withColumn("order_", hashed_order(*key, seed=seed)).withColumn("slice_", F.substring("order_", 1, 3))
    counts = sliced.groupBy(*by, "slice_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*by).orderBy("slice_")) - F.col("n_")
    starts = counts.select(*[F.col(c).alias(f"of_{c}_") for c in (*by, "slice_")], before.alias("before_"))
    same = F.col("slice_") == F.col("of_slice__")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}_"))
    rows = numbered(sliced, [*by, "slice_"], ["order_", *key], "in_slice_").join(starts, same)
    return rows.select(*df.columns, (F.col("in_slice_") + F.col("before_")).alias(name))


def hashed_folds(df: DataFrame, by: list[str], key: list[str], k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """``equal_folds`` of the hashed order of ``key``, without a sort of all rows."""
    return folds_of_places(number_hashed(df, by, key, seed, "at_"), df, by, k, name)


def equal_folds(df: DataFrame, by: list[str], order: list, k: int, name: str = "fold") -> DataFrame:
    """K runs of the order of equal size; the first ``n mod k`` hold one row more. Groups may be of any size."""
    return folds_of_places(number_large(df, by, order, "at_"), df, by, k, name)


def folds_of_places(placed: DataFrame, df: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_")).select(*[F.col(c).alias(f"of_{c}_") for c in by], F.expr(f"n_ div {k}").alias("q_"), F.expr(f"n_ % {k}").alias("r_"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}_"))
    fold = F.expr("cast(if(at_ <= r_ * (q_ + 1), (at_ - 1) div (q_ + 1), r_ + (at_ - 1 - r_ * (q_ + 1)) div q_) as int)")
    return placed.join(sizes, same).withColumn(name, fold).select(*df.columns, name)


def balanced_folds(groups: DataFrame, size: str, cut: int, order: list, k: int) -> DataFrame:
    """Small and large groups are dealt out to folds separately, so every fold has both."""
    stratum = F.when(F.col(size) < cut, 0).otherwise(1)
    return number_large(groups.withColumn("stratum", stratum), ["stratum"], order, "rn_").withColumn("fold", ((F.col("rn_") - 1) % k).cast("int")).drop("rn_")


def published_folds(groups: DataFrame, size: str, cut: int, order: list, k: int) -> DataFrame:
    """Small groups (below ``cut``), then large ones, each in ``k`` runs of the order; the folds that hold one group more start where those of the stratum before ended."""
    rows = number_large(groups.withColumn("stratum", F.when(F.col(size) < cut, 0).otherwise(1)), ["stratum"], order, "rn_")
    n = groups.agg(F.count_if(F.col(size) < cut).alias("small"), F.count_if(~(F.col(size) < cut) | F.col(size).isNull()).alias("large"))
    rows = rows.join(F.broadcast(n))  # one row
    total, start = F.when(F.col("stratum") == 0, F.col("small")).otherwise(F.col("large")), F.when(F.col("stratum") == 0, 0).otherwise(F.col("small") % k)
    each, more = F.floor(total / k), total % k
    upto, fold = F.lit(0), F.lit(0)
    for i in range(k - 1):
        upto = upto + each + F.when((k + i - start) % k < more, 1).otherwise(0)
        fold = fold + F.when(F.col("rn_") > upto, 1).otherwise(0)
    return rows.withColumn("fold", fold.cast("int")).drop("rn_", "small", "large")


def drawn_with_replacement(df: DataFrame, by: list[str], order: list, most: int, seed: int = 0) -> DataFrame:
    """Each group's rows, or of more than ``most`` rows that many hashed draws, which may repeat; ``draw`` numbers them from 0.

    Rows are numbered once; draws of a number meet them by it, so no group is listed.
    """
    placed = written(number_large(df, by, order, "place_"), "places")
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.least(F.col("n_"), F.lit(most)).cast("int") - 1)))
    unit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("draw").cast("string"))), 1, 8), 16, 10).cast("bigint")
    place = F.when(F.col("n_") <= most, F.col("draw") + 1).otherwise(F.expr("1").cast("bigint") + F.floor(unit * F.col("n_") / float(1 << 32)))
    return draws.withColumn("place_", place.cast("bigint")).join(placed, [*by, "place_"]).drop("place_", "n_")


def drawn_positions(n: Column, k: int, *key: Column | str, seed: int = 0) -> Column:
    """Up to ``k`` distinct positions of 1 to ``n``, each set equally likely (all of them if ``n`` is at most ``k``): a draw each, and where its position is taken already the largest allowed one instead."""
    tags = [c if isinstance(c, Column) else F.col(c).cast("string") for c in key]
    low = F.greatest(n - k, F.lit(0)).cast("bigint")

    def step(have: Column, i: Column) -> Column:
        unit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *tags, i.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
        largest = low + i
        draw = F.least(F.floor(unit * largest).cast("bigint") + 1, largest)
        return F.concat(have, F.array(F.when(F.array_contains(have, draw), largest).otherwise(draw)))

    rounds = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), F.least(n, F.lit(k)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(rounds, F.array().cast("array<bigint>"), step)


def drawn_others(slots: DataFrame, members: DataFrame, by: str, slot: str, member: str, own: str, k: int, seed: int = 0) -> DataFrame:
    """For each slot ``k`` members of its group other than its own, without replacement, as (slot, member).

    ``slots`` is (slot, by, own), ``members`` distinct (by, member). Members are numbered
    in a hashed order once; a slot draws numbers, skipping its own, and meets them by an
    equi-join, so slots never meet all members. Groups may be of any size; a slot whose
    group is unknown, null or has nobody else gives no row.
    """
    placed = written(number_hashed(members.where(F.col(by).isNotNull() & F.col(member).isNotNull()), [by], [member], seed, "place_"), "places")
    sizes = placed.groupBy(by).agg(F.count(F.lit(1)).alias("n_"))
    mine = placed.select(by, F.col(member).alias(own), F.col("place_").alias("own_"))
    known = slots.select(slot, by, own).join(sizes, by).join(mine, [by, own], "left")
    draws = drawn_positions(F.col("n_") - F.col("own_").isNotNull().cast("int"), k, slot, seed=seed)
    rows = known.withColumn("place_", F.explode(draws)).withColumn("place_", F.col("place_") + (F.col("place_") >= F.coalesce("own_", F.col("n_") + 1)).cast("int"))
    return rows.select(slot, by, "place_").join(placed, [by, "place_"]).select(slot, member)


def running_budget(df: DataFrame, by: list[str], order: list, size: str, budget: float) -> DataFrame:
    """Rows of each group while their running size stays within the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def adjacent_distinct(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("before_", before).where(F.col("before_").isNull() | (F.col("before_") != F.col(value))).drop("before_")


def two_best(df: DataFrame, by: list[str], score: str, n: str | None = None) -> DataFrame:
    """Of each group the best, second best (null if alone), worst and mean score, by aggregations that combine map-side; no list of a group's scores is made.

    Scores are counted first (``n``: a row stands for so many), so of a best score that
    occurs twice the second is the same; else it is the greatest below the best.
    """
    times = F.count(F.lit(1)) if n is None else F.sum(n)
    counted = written(df.groupBy(*by, F.col(score).alias("s_")).agg(times.alias("n_")), "score-counts")
    best = F.max(F.struct("s_", "n_")).alias("best_")
    out = counted.groupBy(*by).agg(best, F.max("s_").alias("s1"), F.min("s_").alias("s0"), (F.sum(F.col("s_") * F.col("n_")) / F.sum("n_")).alias("mean"))
    below = counted.join(out.select(*by, "s1"), by).where("s_ < s1").groupBy(*by).agg(F.max("s_").alias("next_"))
    return out.join(below, by, "left").select(*by, "s1", "s0", "mean", F.when(F.col("best_.n_") > 1, F.col("s1")).otherwise(F.col("next_")).alias("s2"))


def top_gap(df: DataFrame, by: list[str], score: str, tie: str, n: str | None = None) -> DataFrame:
    """(best - second) / (best - worst + 1e-8) of each group, 0 if all are equal or alone."""
    return gap_of_best(two_best(df, by, score, n), by)


def gap_of_best(out: DataFrame, by: list[str]) -> DataFrame:
    """A21 from the rows of ``two_best``."""
    gap = F.when(F.col("s1") == F.col("s0"), 0.0).otherwise((F.col("s1") - F.coalesce("s2", "s1")) / (F.col("s1") - F.col("s0") + 1e-8))
    return out.select(*by, gap.alias("top_gap"))


def nil_features(df: DataFrame, by: list[str], score: str, tie: str, n: str | None = None) -> DataFrame:
    """Best, mean and two relative gaps to the second; a single candidate gives [s, s, 0, 0]."""
    return nil_of_best(two_best(df, by, score, n), by)


def nil_of_best(out: DataFrame, by: list[str]) -> DataFrame:
    """A22 from the rows of ``two_best``."""
    gap = lambda low: F.when(F.col("s2").isNull(), 0.0).otherwise((F.col("s1") - F.col("s2")) / (1e-8 + F.col("s1") - F.col(low)))
    return out.select(*by, F.col("s1").alias("best"), F.col("mean"), gap("mean").alias("gap_mean"), gap("s0").alias("gap_min"))


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row of linearly interpolated quantiles; equal values are counted, and of the running counts over ranges of the order only the rows that hold a wanted position are kept, so no task holds all values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v_")).agg(F.count(F.lit(1)).alias("n_"))
    placed = running(counted, [], ["v_"], {"upto_": F.col("n_")})
    total = F.sum("n_").alias("total_")
    rows = placed.join(F.broadcast(counted.agg(total)))  # one row
    at = {name: F.lit(q) * (F.col("total_") - 1) for name, q in shares.items()}
    holds = lambda p: (F.floor(p) >= F.col("upto_") - F.col("n_")) & (F.floor(p) < F.col("upto_"))
    ends = [F.max(F.when(holds(F.ceil(p) if side else p), F.col("v_"))).alias(f"{name}_{side}") for name, p in at.items() for side in (0, 1)]
    low = rows.agg(F.max("total_").alias("total_"), *ends)
    return low.select(*[(F.col(f"{name}_0") + (p - F.floor(p)) * (F.col(f"{name}_1") - F.col(f"{name}_0"))).alias(name) for name, p in at.items()])


def sample_per_group(df: DataFrame, by: list[str], key: list[str], k: int, seed: int = 0) -> DataFrame:
    """K rows of each group without replacement, by hash."""
    return top_k(df, by, [hashed_order(*by, *key, seed=seed), *key], k)


def share_of(df: DataFrame, key: list[str], share: float, seed: int = 0) -> Column:
    """A row filter that keeps about this share, by hash and without a shuffle."""
    return F.conv(F.substring(hashed_order(*key, seed=seed), 1, 8), 16, 10).cast("bigint") < int(share * 2**32)


def balance_classes(df: DataFrame, label: str, key: list[str], seed: int = 0) -> DataFrame:
    """Under-samples every class to the smallest; the window is over hash slices of a class, not over a class."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    sliced = df.withColumn("slice_", F.conv(F.substring(hashed_order(*key, seed=seed), 1, 3), 16, 10).cast("int"))
    counts = sliced.groupBy(label, "slice_").agg(F.count(F.lit(1)).alias("n_"))
    before = counts.withColumn("before_", F.sum("n_").over(Window.partitionBy(label).orderBy("slice_")) - F.col("n_"))
    ranked = numbered(sliced, [label, "slice_"], [hashed_order(*key, seed=seed), *key], "rank_").join(before, [label, "slice_"])
    return ranked.join(F.broadcast(least)).where(F.col("before_") + F.col("rank_") <= F.col("least")).drop("slice_", "n_", "before_", "rank_", "least")


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the last in order."""
    return top_k(df, keys, order, 1)


def overwrite_union(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
