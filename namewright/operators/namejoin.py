"""Joins of names under the seven rules through an index of signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewright.functions.names import is_chinese_name, name_rule, plain, short_and_full, without_middle


def signatures(name: str) -> set[tuple[bool, str]]:
    """(asks, key) of a plain name: of any two names that a rule matches, one asks for a key that the other answers.

    Each rule gives the key that its match cannot do without: 1 the words in order, or the
    letters of all long words together and the beginning of one; 2 to 4 a word that the
    longest word of the shorter form begins, and the beginning of a second word; 5 the name
    but for its last letter; 6 the joined words that begin the other's; 7 two words.
    """
    words = name.split()
    letters, long = short_and_full(name)
    out = {(side, "1 " + " ".join(sorted(words))) for side in (True, False)} if words else set()
    if long:
        joined = "".join(long)
        out.add((True, f"1l {len(joined)} {max(long, key=lambda w: (len(w), w))[:3]}"))
        out |= {(False, f"1l {len(joined)} {joined[i : i + n]}") for n in (2, 3) for i in range(len(joined) - n + 1)}
        head = max(range(len(words)), key=lambda i: (len(words[i]), words[i]))
        others = sorted((w for i, w in enumerate(words) if i != head), key=lambda w: (-len(w), w))
        out.add((True, f"2 {words[head]} {others[0][:2] if others else ''}"))
    elif letters:
        out.add((True, "2l " + " ".join(sorted(letters)[:2])))
    for i, w in enumerate(words):
        if len(w) > 1:
            starts = {v[:n] for j, v in enumerate(words) if j != i for n in (1, 2)} | {""}
            out |= {(False, f"2 {w[:n]} {s}") for n in range(2, len(w) + 1) for s in starts}
    out |= {(False, f"2l {w[0]}") for w in words} | {(False, "2l " + " ".join(sorted((v[0], w[0])))) for v, w in combinations(words, 2)}
    if len(words) >= 3:
        rest = "".join(words[:-1])
        out |= {(side, f"5 {rest} {last}") for side in (True, False) for last in (words[-1], words[-1][:-1])}
    whole, middle = "".join(words), without_middle(name)
    if middle:
        short = middle.replace(" ", "")
        out |= {(True, f"6 {short}")} | {(True, f"6w {short[:n]}") for n in range(1, len(short) + 1)}
    else:
        out |= {(False, f"6w {whole}")} | {(False, f"6 {whole[:n]}") for n in range(4, len(whole) + 1)}
    if len(words) >= 3 and not letters and is_chinese_name(name):
        distinct = sorted(set(words))
        out.add((True, "7 " + " ".join(distinct[:2])))
        out |= {(False, f"7 {w}") for w in distinct} | {(False, f"7 {v} {w}") for v, w in combinations(distinct, 2)}
    return out


def indexed(names: DataFrame, name: str) -> DataFrame:
    """(plain, asks, key) of the distinct names in plain letters; a name without a letter has no rows."""

    def op(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *s) for p in frame["plain"] for s in sorted(signatures(p))]
            yield pd.DataFrame(rows, columns=["plain", "asks", "key"])

    return names.select(plain_form(name).alias("plain")).where("plain <> ''").distinct().mapInPandas(op, "plain string, asks boolean, key string")


@F.pandas_udf(T.StringType())
def plain_names(name: pd.Series) -> pd.Series:
    return name.map(plain, na_action="ignore")


def plain_form(name: str):
    return plain_names(F.col(name))


def matching_names(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, rule) of all pairs of distinct names that a rule matches, each judged once.

    Names meet by their plain letters' signatures, so spellings that differ in case, marks
    or punctuation are one name until the end. No key is as common as a single word: it
    holds two places of a name, unless the asking name has no more. Null names match nothing.
    """
    own, other = indexed(left, a).withColumnRenamed("plain", "x"), indexed(right, b).withColumnRenamed("plain", "y")
    met = own.join(other.withColumn("asks", ~F.col("asks")), ["asks", "key"]).select("x", "y").distinct()
    judged = met.withColumn("rule", name_rule(F.col("x"), F.col("y"))).where("rule > 0")
    spelled_a = left.select(F.col(a)).where(F.col(a).isNotNull()).distinct().withColumn("x", plain_form(a))
    spelled_b = right.select(F.col(b)).where(F.col(b).isNotNull()).distinct().withColumn("y", plain_form(b))
    return judged.join(spelled_a, "x").join(spelled_b, "y").select(a, b, "rule")


def matched_lists(pairs: DataFrame, left: DataFrame, right: DataFrame, of_left: str, of_right: str, name: str) -> DataFrame:
    """For given pairs of name lists, how many distinct names of the right list match any name of the left one.

    ``pairs`` is (of_left, of_right), ``left`` (of_left, name), ``right`` (of_right, name).
    A pair's names are compared through the table of all matching names: no two lists are
    multiplied. Pairs without a match count zero; names repeat as they like.
    """
    right = right.select(of_right, F.col(name).alias("other_"))
    matches = matching_names(left, right, name, "other_")
    wanted = left.select(of_left, name).distinct().join(matches, name).select(of_left, "other_").distinct().join(pairs.select(of_left, of_right).distinct(), of_left)
    found = wanted.join(right.distinct(), [of_right, "other_"])
    counted = found.groupBy(of_left, of_right).agg(F.count(F.lit(1)).alias("matched"))
    return pairs.select(of_left, of_right).distinct().join(counted, [of_left, of_right], "left").select(of_left, of_right, F.coalesce("matched", F.lit(0)).alias("matched"))
