"""Set, vector and rule similarities as Column expressions (V rows), and string distances."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-20


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Common over all distinct elements; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(overlap(a, b) / union)


def venue_tanimoto(a: Column, b: Column) -> Column:
    """Over the words of two venues (not over the letters of an arbitrary word)."""
    return jaccard(F.split(F.lower(a), " "), F.split(F.lower(b), " "))


def equal_sets(a: Column, b: Column) -> Column:
    """Containment under a constant score table: 1 iff both are non-empty and equal as sets."""
    return F.when((F.size(a) > 0) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))), 1.0).otherwise(0.0)


def dice_like(a: Column, b: Column) -> Column:
    """Common over the sum of sizes plus one; -1 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), -1.0).otherwise(overlap(a, b) / (F.size(a) + F.size(b) + 1 + TINY))


def coauthor_overlap(common: Column, a: Column, b: Column) -> Column:
    """Matches over unmatched co-authors of both sides."""
    return common / (a + b - 2 * common + TINY)


def coauthor_weight(a: Column, b: Column, by_union: bool = False) -> Column:
    """Common over the smaller side, or over the union; never divided by less than one."""
    of = F.size(F.array_union(a, b)) if by_union else F.least(F.size(a), F.size(b))
    return overlap(a, b) / F.greatest(F.lit(1), of)


def rule_score(coauthors: Column, venue: Column, org: Column, words: Column, coauthor: float = 1.5, word: float = 0.33) -> Column:
    """Weighted sum of co-author matches, venue and organisation similarity and common words."""
    return coauthor * coauthors + venue + org + word * words


def dot(a: Column, b: Column) -> Column:
    """V14."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def cosine_or_nan(a: Column, b: Column) -> Column:
    """Cosine distance, NaN for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / n)


def manhattan(a: Column, b: Column) -> Column:
    """V12."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    """V13."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, 0.0).otherwise(x.cast("double") / n))


def blend(walk: Column, text: Column, w: float = 1.0) -> Column:
    """Distances of two views, the second weighted."""
    return (walk + w * text) / (1 + w)


#: Fixed values, V17: kernel centres 1, .975, .925 ... -.975 and widths .001, .1 ...
KERNELS = [(1.0, 0.001), *((round(0.975 - 0.05 * i, 3), 0.1) for i in range(40))]


def year_gap(a: Column, b: Column, most: int = 20) -> Column:
    """Capped difference of years; null if either is not a year."""
    return F.least(F.abs(a - b), F.lit(most))


def time_weight(gap: Column, most: int = 20) -> Column:
    """1 / (gap + 1), at least 1 / most; an unknown gap counts as the most."""
    return 1.0 / F.coalesce(F.least(F.abs(gap) + 1, F.lit(most)), F.lit(most))


def letter_histogram(s: Column) -> Column:
    """counts of a..z."""
    low = F.lower(s)
    return F.transform(F.sequence(F.lit(97), F.lit(122)), lambda c: F.length(low) - F.length(F.replace(low, F.char(c), F.lit(""))))


def letter_distance(a: Column, b: Column) -> Column:
    """size of the symmetric difference of two bags of letters."""
    return F.aggregate(F.zip_with(letter_histogram(a), letter_histogram(b), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def jaro_of(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    if a == b:
        return 1.0 if a else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_of(a: str, b: str, scale: float = 0.1, boost: float = 0.7) -> float:
    score = jaro_of(a, b)
    if score <= boost:
        return score
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return score + prefix * scale * (1 - score)


def ratio_of(a: str, b: str) -> float:
    """Levenshtein ratio: substitutions cost two, so it is twice the common subsequence over both lengths."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())  # a type object: workers import this module without a session
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return of


jaro, jaro_winkler, levenshtein_ratio = _pairwise(jaro_of), _pairwise(jaro_winkler_of), _pairwise(ratio_of)
