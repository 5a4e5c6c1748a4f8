"""Operator 7, quality rules: a decision list learned from labelled statistics.

Sequential covering: a rule, a conjunction of thresholds on statistics, is grown on two
thirds of the labelled rows by information gain and pruned on the last third; rows that
it covers leave, and the next rule is learned, until one is not precise enough. The list
is emitted as ordered Spark conditional expressions.

Edge cases: null and empty texts have zero statistics and fail the base rule; a text of
any length is counted whole; labelled documents that are absent, and null labels, do not
train; without labels of both kinds the list is empty and the base rule alone decides;
repeated rows are judged one by one; an empty table gives an empty one; extra columns
are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import documents, prepare, text_of, written

#: Fixed values of the base rule: symbols, fewest words, most repeated words in percent.
SYMBOLS, FEWEST, REPEATED = "#*$%&|<>", 50, 50
#: Bound of the labelled rows that the list is learned from.
MOST_ROWS = 12_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_latin")
SCHEMA = "key bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
#: Statistics that rules may use, of the counts.
STATISTICS = {
    "mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "n_words"), "distinct": ("n_distinct", "n_words"), "line_words": ("n_words", "n_lines"), "words": ("n_words", None),
}

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, DIGIT, MARK, LATIN = re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[0-9]+"), re.compile("[!-/:-@\\[-`{-~]+"), re.compile("[A-Za-z]+")
BLANKS = {c: " " for c in range(9, 14)}


def total(pattern: re.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def statistics(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one whole text."""
    text = text or ""
    words = [w for w in text.translate(BLANKS).split(" ") if w]
    seen, duplicates, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        once, again = set(), set()
        for w in windows:
            (again if w in once else once).add(w)
        covered = bytearray(len(words))
        for i, w in enumerate(windows):
            if w in again:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicates, repeated, len(text), lines, total(UPPER, text), total(DIGIT, text), total(MARK, text), len(set(words)), total(LATIN, text))


def with_statistics(df: DataFrame, key: str, text: str, row: str | None = None) -> DataFrame:
    def op(batches):
        for batch in batches:
            if batch.num_rows:
                made = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made.T), *batch.columns[2:]], names=["key", *COUNTS, *ids])

    ids = [row] if row else []
    return df.select(F.col(key).cast("bigint").alias("key"), text_of(text).alias("text"), *ids).mapInArrow(op, SCHEMA + "".join(f", {x} bigint" for x in ids))


def statistic(name: str) -> Column:
    of, by = STATISTICS[name]
    return F.col(of).cast("double") if by is None else F.col(of) / F.greatest(F.col(by), F.lit(1))


def gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information gained on bad rows by going from (p0, n0) to (p, n) covered bad and good rows."""
    return p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2((p0 + 1e-9) / (p0 + n0 + 1e-9)))


def grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int = 4) -> list[tuple[str, str, float]]:
    inside, rule = np.ones(len(bad), bool), []
    while len(rule) < most and (inside & ~bad).any() and (inside & bad).any():
        p0, n0, best = (inside & bad).sum(), (inside & ~bad).sum(), (0.0, None, None)
        for j, name in enumerate(names):
            cuts = np.unique(x[inside, j])
            pos, neg = np.sort(x[inside & bad, j]), np.sort(x[inside & ~bad, j])
            for way, p, n in (("<=", np.searchsorted(pos, cuts, "right"), np.searchsorted(neg, cuts, "right")), (">=", len(pos) - np.searchsorted(pos, cuts, "left"), len(neg) - np.searchsorted(neg, cuts, "left"))):
                g = gain(p0, n0, p, n)
                if g.max() > best[0] + 1e-9:
                    best = (g.max(), (name, way, float(cuts[int(np.argmax(g))])), j)
        if best[1] is None:
            break
        name, way, cut = best[1]
        inside &= x[:, best[2]] <= cut if way == "<=" else x[:, best[2]] >= cut
        rule.append(best[1])
    return rule


def covered(rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, way, cut in rule:
        v = x[:, names.index(name)]
        out &= v <= cut if way == "<=" else v >= cut
    return out


def worth(rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    c = covered(rule, x, names)
    p, n = (c & bad).sum(), (c & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def decision_list(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.95, fewest: int = 5, most_rules: int = 12) -> list[list[tuple[str, str, float]]]:
    """Ordered rules for bad rows; each covers at least ``fewest`` and is right about ``precision`` of those it covers, grown and pruned on separate rows."""
    rules, order = [], np.random.default_rng(7).permutation(len(bad))
    x, bad = x[order], bad[order]
    while len(rules) < most_rules and bad.sum() >= fewest:
        part = np.arange(len(bad)) % 3 == 2
        rule = grow(x[~part], bad[~part], names)
        while len(rule) > 1 and worth(rule[:-1], x[part], bad[part], names) >= worth(rule, x[part], bad[part], names):
            rule = rule[:-1]
        hit = covered(rule, x, names) if rule else np.zeros(len(bad), bool)
        if not rule or hit.sum() < fewest or bad[hit].mean() < precision:
            break
        if (hit & part).any() and bad[hit & part].mean() < precision:
            break
        rules.append(rule)
        x, bad = x[~hit], bad[~hit]
    return rules


def learn(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_ROWS) -> list[list[tuple[str, str, float]]]:
    """The decision list, from at most about ``most_rows`` labelled rows (0 bad, 1 good) chosen by a hash of the key."""
    prepare(df.sparkSession)
    kept = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).dropna().groupBy("key").agg(F.min("label").alias("label"))
    n = kept.count()
    draw = F.pmod(F.xxhash64("key", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    drawn = kept.where(draw < min(1.0, most_rows / max(1, n)))
    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text")).join(F.broadcast(drawn), "key")  # drawn: at most most_rows ids
    sample = written(rows, "quality-sample")
    made = with_statistics(sample, "key", "text").join(F.broadcast(drawn), "key").select("label", *[statistic(s).alias(s) for s in STATISTICS]).toArrow()
    if not made.num_rows:
        return []
    x = np.stack([made.column(s).to_numpy() for s in STATISTICS], 1)
    order = np.lexsort(x.T)
    return decision_list(x[order], (made.column("label").to_numpy() == 0)[order], list(STATISTICS))


def verdict(rules) -> Column:
    """The list as ordered conditional expressions: the number of the first rule that rejects, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules):
        holds = F.lit(True)
        for name, way, cut in rule:
            holds = holds & (statistic(name) <= cut if way == "<=" else statistic(name) >= cut)
        out = out.when(holds, F.lit(i))
    return out


def judge(df: DataFrame, rules, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per input row: key, the counts, base_failed, rule (that rejects, or null), kept, and ``row``, a row id, if named."""
    prepare(df.sparkSession)
    rows = with_statistics(df, key, text, row)
    base = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    out = rows.withColumn("base_failed", base).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).withColumnRenamed("key", key)


def op7_quality_rules(spark, sf_dir):
    """Contract 7 over all documents."""
    docs = documents(spark, sf_dir)
    judged = judge(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
