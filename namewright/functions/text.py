"""Text normalisation as Column expressions; all of it stays in generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation class, stop-word lists, organisation abbreviations and split characters.
PUNCTUATION = "[!“”\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~—～’]+"
STOP_WORDS = "at based in of for on and to an using with the by we be is are can".split()
STOP_WORDS_ORG = (
    "university univ china department dept laboratory lab school al et institute inst college chinese beijing "
    "journal science international key sciences research academy state center"
).split()
STOP_WORDS_CHECK = (
    "a was were that 2 key 1 technology 0 sciences as from r 3 academy this nanjing shanghai state s research p results "
    "peoples 4 which 5 high materials study control method group c between or it than analysis system sci two 6 has h "
    "after different n national japan have cell time zhejiang used data these"
).split()
ORG_REWRITES = [
    ("sch.", "school"), ("dept.", "department"), ("coll.", "college"), ("inst.", "institute"), ("univ.", "university"), ("lab ", "laboratory "),
    ("lab.", "laboratory"), ("natl.", "national"), ("comp.", "computer"), ("sci.", "science"), ("tech.", "technology"), ("technol.", "technology"),
    ("elec.", "electronic"), ("engr.", "engineering"), ("aca.", "academy"), ("syst.", "systems"), ("eng.", "engineering"), ("res.", "research"),
    ("appl.", "applied"), ("chem.", "chemistry"), ("prep.", "petrochemical"), ("phys.", "physics"), ("phys ", "physics"), ("mech.", "mechanics"),
    ("mat.", "material"), ("cent.", "center"), ("ctr.", "center"), ("behav.", "behavior"), ("atom.", "atomic"), ("|", " "), ("-", " "), ("{", " "),
]
MARKS = "[\\s+.!/,;$%^*(\"')—_()?【】“”！，。？、~@#￥%……&*（）\\-]+"
SPLITTERS = "[., :;)(0-9%\\[\\]]"


def norm_text(s: Column) -> Column:
    """trimmed, lower case, punctuation to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), PUNCTUATION, " "), "\\s{2,}", " "))


def tokens(s: Column, longer_than: int = 1, *stop_lists: list[str]) -> Column:
    """Words of the normalised text that are long enough and in no stop list."""
    stops = [w for x in stop_lists for w in x]
    keep = lambda w: F.length(w) > longer_than
    if stops:
        keep = lambda w: (F.length(w) > longer_than) & ~w.isin(stops)
    return F.filter(F.split(norm_text(s), " "), keep)


def etl(s: Column) -> Column:
    """a wider class of marks to spaces, spaces collapsed, not trimmed."""
    return F.regexp_replace(F.regexp_replace(s, MARKS, " "), " {2,}", " ")


def clean_abstract(s: Column) -> Column:
    """everything but letters and digits to spaces, lower case, trimmed; Unicode-aware."""
    return F.trim(F.lower(F.regexp_replace(s, "[^\\p{L}\\p{N}]+", " ")))


def clean_orgs(s: Column, stops: list[str] = STOP_WORDS) -> Column:
    """lower-case words without digits and stop words."""
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(s), "[^\\p{L}\\p{N}]+", " "), "[0-9]+", ""), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(stops))


def rewrite_org(s: Column) -> Column:
    """abbreviations spelled out in order, first of a ;-list, marks removed."""
    spelled = reduce(lambda c, ab: F.replace(c, F.lit(ab[0]), F.lit(ab[1])), ORG_REWRITES, s)
    return F.trim(etl(F.split_part(spelled, F.lit(";"), F.lit(1))))


def process_org(s: Column) -> Column:
    """the normalised words without stop words, joined again."""
    return F.array_join(tokens(s, 0, STOP_WORDS), " ")


def one_line(s: Column) -> Column:
    """line ends to spaces."""
    return F.translate(s, "\n\r", "  ")


def letters_only(s: Column) -> Column:
    """lower-case letters alone."""
    return F.lower(F.regexp_replace(s, "[^\\p{L}]", ""))


def has_chinese(s: Column) -> Column:
    """whether any character is a CJK ideograph of the basic block."""
    return s.rlike("[\\x{4e00}-\\x{9fa5}]")


def split_class(s: Column) -> Column:
    """pieces between any of the 13 delimiter kinds, empties dropped."""
    return F.filter(F.split(s, SPLITTERS), lambda x: x != "")


def keywords(arr: Column, phrases: bool = True) -> Column:
    """cleaned lower-case keywords as phrases, or split into words."""
    cleaned = F.filter(F.transform(arr, lambda k: F.trim(F.lower(etl(k)))), lambda k: k != "")
    return cleaned if phrases else F.filter(F.flatten(F.transform(cleaned, lambda k: F.split(k, " "))), lambda k: k != "")


def title_words(title: Column, words: Column, stops: list[str] = STOP_WORDS) -> Column:
    """distinct words of title and keywords; null and empty keywords count as none."""
    both = F.concat(F.split(F.lower(F.coalesce(title, F.lit(""))), " "), F.coalesce(F.transform(words, lambda k: F.lower(k)), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(both, lambda w: (w != "") & ~w.isin(stops)))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("bigint")


def ngrams(arr: Column, n: int) -> Column:
    """Sliding n-grams of an array, joined by spaces."""
    last = F.size(arr) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(arr, i, n), " "))).otherwise(F.array().cast("array<string>"))


def affix_match(a: Column, b: Column) -> Column:
    """one word starts or ends with the other's first or last three characters."""
    return a.startswith(F.substring(b, 1, 3)) | a.endswith(F.substring(b, -3, 3))
