"""Nearest names by letters, without comparing all."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.functions.similarity import letter_histogram
from namewright.operators.ranking import top_k
from namewright.sources.shared import written

#: Letters are summed in so many groups.
GROUPS = 5


def group_sums(counts: Column) -> Column:
    """The letters of each group, the g-th one every fifth letter from the g-th on."""
    return F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.aggregate(F.transform(counts, lambda n, i: F.when(i % GROUPS == g, n).otherwise(0)), F.lit(0), lambda s, n: s + n))


def shell(low: int, high: int, width: int) -> list[list[int]]:
    """All differences of ``width`` whole numbers whose absolute values sum to low .. high."""
    return [list(d) for d in product(range(-high, high + 1), repeat=width) if low <= sum(map(abs, d)) <= high]


def nearest_names(missing: DataFrame, names: DataFrame, slot: str, name: str, near: int = 2) -> DataFrame:
    """For names without a match the closest by letter distance: one if it is nearer than ``near``, else two. (slot, name, distance, rank)

    The distance of two bags of letters is at least that of their sums by group, and that at
    least the difference of their totals. So slots look for names outward: under all sums at
    most 1, 2 and 3 away, by equi-joins on the sums, and those whose second best is still
    farther than the names not yet met under totals ever farther away. What is found equals
    the comparison with all names, ties to the smaller name, for any number of names. Null
    slots and names are left out; an empty name is a name.
    """
    side = lambda df, c, t: df.select(F.col(c).alias(t)).where(F.col(t).isNotNull()).distinct().withColumn(f"{t}_counts", letter_histogram(F.col(t)))
    total = lambda t: F.aggregate(f"{t}_counts", F.lit(0), lambda s, n: s + n)
    keyed = lambda df, t: written(df.withColumns({f"{t}_sums": group_sums(F.col(f"{t}_counts")), f"{t}_total": F.array(total(t))}), f"{t}-letters")
    pending, known = keyed(side(missing, slot, "slot_"), "slot_"), keyed(side(names, name, "name_"), "name_")
    most = max((df.agg(F.max(F.col(f"{t}_total")[0])).first()[0] or 0) for df, t in ((pending, "slot_"), (known, "name_")))
    done: DataFrame | None = None
    for by, width, limits in (("sums", GROUPS, [1, 2, 3]), ("total", 1, [3, *(8 << i for i in range(40) if 4 << i <= most + 4)])):
        best, low = None, 0
        for high in limits:
            steps = F.array(*[F.array(*map(F.lit, d)) for d in shell(low, high, width)]) if high - low < 64 else F.expr(f"transform(filter(sequence(-{high}, {high}), x -> abs(x) >= {low}), x -> array(x))")
            asked = pending.select("slot_", "slot__counts", f"slot__{by}", F.explode(steps).alias("step_")).withColumn("key_", F.zip_with(f"slot__{by}", "step_", lambda x, d: x + d))
            met = asked.join(known.select(F.col(f"name__{by}").alias("key_"), "name_", "name__counts"), "key_")
            apart = F.aggregate(F.zip_with("slot__counts", "name__counts", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
            found = met.select("slot_", "name_", apart.alias("distance"))
            best = written(top_k(found if best is None else found.unionByName(best), ["slot_"], ["distance", "name_"], 2).select("slot_", "name_", "distance"), "nearest")
            ready = best.groupBy("slot_").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("second")).where((F.col("n") == 2) & (F.col("second") <= high)).select("slot_")
            over = best.join(ready, "slot_", "left_semi")
            done = over if done is None else done.unionByName(over)
            pending = written(pending.join(ready, "slot_", "left_anti"), "pending")
            best, low = best.join(ready, "slot_", "left_anti"), high + 1
            if pending.isEmpty():
                break
    done = done.unionByName(best)  # slots with fewer than two names to find
    of_slot = Window.partitionBy("slot_")  # two rows
    ranked = done.withColumns({"least_": F.min("distance").over(of_slot), "rank": F.row_number().over(of_slot.orderBy("distance", "name_"))})
    return ranked.where((F.col("rank") == 1) | (F.col("least_") >= near)).select(F.col("slot_").alias(slot), F.col("name_").alias(name), "distance", "rank")
