"""A light English suffix stemmer."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ENDINGS = (("sses", "ss"), ("ies", "y"), ("ational", "ate"), ("ization", "ize"), ("ingly", ""), ("edly", ""), ("ing", ""), ("ed", ""), ("ly", ""), ("es", "e"), ("s", ""))


def stem(word: Column) -> Column:
    """The word without its first fitting ending, if a stem of three letters with a vowel is left; of a doubled last letter before -ing and -ed, but l, s and z, one goes."""
    out = F
    for end, put in ENDINGS:
        left = F.left(word, F.length(word) - len(end))
        fits = word.endswith(end) & (F.length(left) >= 3) & left.rlike("[aeiouy]")
        if end == "s":
            fits &= ~word.endswith("ss")
        made = F.concat(left, F.lit(put))
        if end in ("ing", "ed"):
            doubled = (F.length(left) > 3) & left.rlike(r"([^lsz])\1$")
            made = F.when(doubled, F.left(left, F.length(left) - 1)).otherwise(left)
        out = out.when(fits, made)
    return out.otherwise(word)
