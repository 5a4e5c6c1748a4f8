"""Person names: keys as Column expressions, rules as Arrow-batched functions over distinct pairs.

Chinese-name rules need a syllable table; it is built from initials and finals here and
not taken from a word list.
"""

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Particles that names drop.
PARTICLES = ["jr", "iii", "dr", "mr", "junior"]
# Nicknames and the names that they stand for; where one stands for two, the last counts.
NICKNAMES = {
    "al": "albert",
    "andy": "andrew",
    "tony": "anthony",
    "art": "arthur",
    "arty": "arthur",
    "bernie": "bernard",
    "bern": "bernard",
    "charlie": "charles",
    "chuck": "charles",
    "danny": "daniel",
    "dan": "daniel",
    "don": "donald",
    "ed": "edward",
    "eddie": "edward",
    "gene": "eugene",
    "freddy": "frederick",
    "fred": "frederick",
    "hank": "henry",
    "irv": "irving",
    "jimmy": "james",
    "jim": "james",
    "joe": "joseph",
    "jacky": "john",
    "jack": "john",
    "jeff": "jeffrey",
    "ken": "kenneth",
    "larry": "lawrence",
    "leo": "leonard",
    "matt": "matthew",
    "mike": "michael",
    "nate": "nathan",
    "nat": "nathan",
    "nick": "nicholas",
    "pete": "peter",
    "ray": "raymond",
    "dick": "richard",
    "rick": "richard",
    "russ": "russell",
    "steve": "stephan",
    "stu": "stuart",
    "teddy": "theodore",
    "tom": "thomas",
    "thom": "thomas",
    "tommy": "thomas",
    "timmy": "timothy",
    "tim": "timothy",
    "walt": "walter",
    "wally": "walter",
    "bill": "william",
    "billy": "william",
    "will": "william",
    "willy": "william",
    "mandy": "amanda",
    "cathy": "catherine",
    "cath": "catherine",
    "chris": "christopher",
    "chrissy": "christine",
    "debbie": "deborah",
    "deb": "deborah",
    "betty": "elizabeth",
    "beth": "elizabeth",
    "liz": "elizabeth",
    "bess": "elizabeth",
    "flo": "florence",
    "francie": "frances",
    "fran": "frances",
    "kate": "katherine",
    "kathy": "katherine",
    "jan": "janice",
    "nan": "nancy",
    "pam": "pamela",
    "pat": "patricia",
    "bobbie": "roberta",
    "sophie": "sophia",
    "sue": "susan",
    "suzie": "susan",
    "terry": "teresa",
    "val": "valerie",
    "ronnie": "veronica",
    "vonna": "yvonne",
    "peggy": "margaret",
    "ted": "edward",
    "sally": "sarah",
    "harry": "henry",
}
# Given names that look like a target's but are another one's; each has to match the pattern beside it.
OTHER_NAMES = {
    "takahiro": "ta(d|k)ashi", "toshiyuki": "ta(d|k)ashi", "takeshi": "ta(d|k)ashi", "tomohiro": "ta(d|k)ashi", "takamitsu": "ta(d|k)ashi",
    "takahisa": "ta(d|k)ashi", "takashi": "ta(d|k)ashi", "takahiko": "ta(d|k)ashi", "takayuki": "ta(d|k)ashi",
    "akimasa": "akira", "akio": "akira", "akito": "akira", "kentarok": "kentaro", "xiaohuatony": "xiaohua", "tonyxiaohua": "xiaohua",
    "ulrich": "ulrike", "naoto": "naoki", "naomi": "naoki", "junko": "junichi", "isaku": "isao",
}
# Words that are syllables but common in other names, and count only beside a certain one.
DOUBTFUL = [
    "an", "ban", "bar", "ben", "bo", "bu", "ch", "dam", "dan", "de", "dean", "den", "der", "di", "dia", "du", "for", "gu", "guen", "ian", "jan", "jean", "jim", "jr",
    "juan", "kim", "ku", "lang", "le", "long", "lou", "luc", "ng", "ohm", "per", "re", "rui", "sa", "shaw", "ti", "tim", "to", "van", "yip", "yu",
]
#: The initials that each final of a romanized syllable goes with; "-" is none.
INITIALS_OF = {
    "a": "- b p m f d t n l g k h zh ch sh z c s y w", "o": "- b p m f w", "e": "- m d t n l g k h zh ch sh r z c s y", "er": "-",
    "ai": "- b p m d t n l g k h zh ch sh z c s w", "ei": "b p m f d n l g h zh sh z w", "ao": "- b p m d t n l g k h zh ch sh r z c s y",
    "ou": "- p m f d t n l g k h zh ch sh r z c s y", "an": "- b p m f d t n l g k h zh ch sh r z c s y w", "en": "- b p m f d n g k h zh ch sh r z c s w",
    "ang": "- b p m f d t n l g k h zh ch sh r z c s y w", "eng": "b p m f d t n l g k h zh ch sh r z c s w", "ong": "d t n l g k h zh ch r z c s y",
    "i": "b p m d t n l j q x zh ch sh r z c s y", "ia": "d l j q x", "ie": "b p m d t n l j q x", "iao": "b p m d t n l j q x", "iu": "m d n l j q x",
    "ian": "b p m d t n l j q x", "in": "b p m n l j q x y", "iang": "n l j q x", "ing": "b p m d t n l j q x y", "iong": "j q x",
    "u": "b p m f d t n l g k h zh ch sh r z c s j q x y w", "ua": "g k h zh sh", "uo": "d t n l g k h zh ch sh r z c s", "uai": "g k h zh ch sh",
    "ui": "d t g k h zh ch sh r z c s", "uan": "d t n l g k h zh ch sh r z c s j q x y", "un": "d t n l g k h zh ch sh r z c s j q x y",
    "uang": "g k h zh ch sh", "ue": "n l j q x y", "v": "n l", "ve": "n l",
}


#: Letters from À to ſ that are a plain letter with a mark, and those plain letters.
MARKED = [chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore")) == 1] + list("øØłŁđĐ")
UNMARKED = [unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in MARKED[:-6]] + list("oOlLdD")


def ascii_fold(s: Column) -> Column:
    """Latin letters with marks to plain ones."""
    return F.translate(s, "".join(MARKED), "".join(UNMARKED))


def clean_name(s: Column) -> Column:
    """plain lower-case letters, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(s)), "[^a-z]+", " "))


def name_key(s: Column) -> Column:
    """distinct tokens in order, joined: equal for any order of the same tokens."""
    parts = F.filter(F.split(F.lower(s), "[ .\\-_]"), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(parts)), "")


def token_set(s: Column) -> Column:
    """key under which names with equal token sets meet."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(clean_name(s), " "), lambda x: x != ""))), " ")


def simple_tokens(s: Column) -> Column:
    """lower-case tokens; two capitals are two initials, particles go, nicknames are spelled out, ``a.b.`` is taken apart and ``a.`` stays."""
    words = F.transform(F.split(s, "\\s+"), lambda x: F.when(x.rlike("^[A-Z]{2}$"), F.concat(F.substring(x, 1, 1), F.lit(" "), F.substring(x, 2, 1))).otherwise(x))
    bare = ascii_fold(F.lower(F.regexp_replace(F.regexp_replace(F.array_join(words, " "), "['’]", ""), "(?U)[^\\w.]", " ")))
    known = F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])
    kept = F.filter(F.split(bare, "\\s+"), lambda x: ~F.replace(x, F.lit("."), F.lit("")).isin(PARTICLES))
    full = F.transform(kept, lambda x: F.coalesce(known[x], x))
    apart = F.transform(full, lambda x: F.when(F.length(x) - F.length(F.replace(x, F.lit("."), F.lit(""))) > 1, F.translate(x, ".", " ")).otherwise(x))
    return F.filter(F.split(F.regexp_replace(F.array_join(apart, " "), "[^ -~]", ""), " +"), lambda x: x != "")


def without_nbsp(s: Column) -> Column:
    """no-break spaces out, commas to spaces, homonym numbers dropped; CJK names see ``romanized``."""
    return F.trim(F.regexp_replace(F.replace(F.replace(s, F.lit(" "), F.lit("")), F.lit(","), F.lit(" ")), " [0-9]{4}$", ""))


def process_name(s: Column) -> Column:
    """lower case, joiners to spaces, marks stripped, only a-z, dots and spaces kept, dots to spaces."""
    kept = F.regexp_replace(ascii_fold(F.lower(F.translate(s, "-_", "  "))), "[^a-z\\s.]+", "")
    return F.trim(F.regexp_replace(kept, "[.\\s]+", " "))


def histogram_key(s: Column) -> Column:
    """counts of a..z as one string, separated, so that ten of a letter stay unambiguous."""
    low = F.lower(s)
    counts = F.transform(F.sequence(F.lit(97), F.lit(122)), lambda c: (F.length(low) - F.length(F.replace(low, F.char(c), F.lit("")))).cast("string"))
    return F.array_join(counts, ".")


def abbreviations(s: Column) -> Column:
    """F16: the name and its four abbreviations: initials + last, first initial + last, and both mirrored."""
    parts = F.split(process_name(s), " ")
    first, last, n = parts[0], F.element_at(parts, -1), F.size(parts)
    initials = lambda arr: F.transform(arr, lambda x: F.substring(x, 1, 1))
    forward = F.array_join(F.concat(initials(F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))), F.array(last)), " ")
    mirrored = F.array_join(F.concat(initials(F.slice(parts, 2, F.greatest(n - 1, F.lit(0)))), F.array(first)), " ")
    simple = F.concat_ws(" ", F.substring(first, 1, 1), last)
    mirrored_simple = F.concat_ws(" ", F.substring(F.coalesce(F.get(parts, F.lit(1)), first), 1, 1), first)
    return F.array(process_name(s), forward, simple, mirrored, mirrored_simple)


def same_name(a: Column, b: Column) -> Column:
    """any of the five encodings in common."""
    return F.arrays_overlap(abbreviations(a), abbreviations(b))


def concatenations(s: Column) -> Column:
    """``a_b`` as ab and ba; of three tokens abc and cab."""
    parts = F.split(F.lower(s), "[_ ]")
    return F.array(F.array_join(parts, ""), F.concat(F.element_at(parts, -1), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "")))


# --- rules that depend on the data of both names ---


@lru_cache(maxsize=1)
def syllables() -> frozenset:
    return frozenset(initial.strip("-") + final for final, initials in INITIALS_OF.items() for initial in initials.split())


@lru_cache(maxsize=50_000)
def syllable_split(word: str) -> list[str] | None:
    """The word as romanized syllables, longest first; None if it is not made of them."""
    if not word:
        return []
    for n in range(min(6, len(word)), 0, -1):
        if word[:n] in syllables() and (rest := syllable_split(word[n:])) is not None:
            return [word[:n], *rest]
    return None


def is_chinese_name(name: str) -> bool:
    """a vote of the words longer than a letter.

    A word of one syllable may be a family name, one of two or three a given name; words
    in DOUBTFUL are neither. Of one or two words a family name decides, or a given name
    beside a doubtful word; of more, all but one have to fit, doubtful ones too once any
    word does.
    """
    words = [w for w in name.split() if len(w) > 1]
    parts = [0 if w in DOUBTFUL else len(syllable_split(w) or ()) for w in words]
    family, given, doubtful = sum(n == 1 for n in parts), sum(n in (2, 3) for n in parts), sum(w in DOUBTFUL for w in words)
    if len(words) < 3:
        return family > 0 or (given > 0 and doubtful > 0)
    return family + given > 0 and family + given + doubtful >= len(words) - 1


def plain(name: str) -> str:
    """F10 for one string."""
    folded = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return re.sub("[^a-z]+", " ", folded.lower()).strip()


def short_and_full(name: str) -> tuple[list[str], list[str]]:
    """tokens of one letter, and longer ones."""
    words = name.split()
    return [w for w in words if len(w) == 1], [w for w in words if len(w) > 1]


def uncommon(a: str, b: str) -> tuple[list[str], list[str]]:
    """The words of two names without the long ones that both have."""
    x, y = a.split(), b.split()
    for w in {w for w in x if len(w) > 1} & set(y):
        x.remove(w)
        y.remove(w)
    return x, y


def abbreviates(a: str, b: str, partial: bool = False) -> bool:
    """whether each word of ``a`` stands for one of ``b``: a long word for itself or, if ``partial``, for one that it begins, a letter for words that it begins."""
    if sorted(a.split()) == sorted(b.split()):
        return True
    x, y = uncommon(a, b)
    (letters, long), (short, full) = short_and_full(" ".join(x)), short_and_full(" ".join(y))
    for w in long:
        hit = next((v for v in full if v == w or (partial and v.startswith(w))), None)
        if hit is None:
            return False
        full.remove(hit)
    for w in letters:
        hits = [(side, v) for side in (short, full) if (v := next((v for v in side if v.startswith(w)), None))]
        if not hits:
            return False
        for side, v in hits:
            side.remove(v)
    return True


def resembles(a: str, b: str) -> bool:
    """F24, loosely: of the words not in common, the initials of one name include the other's, and each long word of ``a`` begins or ends with three letters like one of ``b``."""
    x, y = uncommon(a, b)
    mine, theirs = {w[0] for w in x}, {w[0] for w in y}
    if not (mine <= theirs or theirs <= mine):
        return False
    (_, long), (_, full) = short_and_full(" ".join(x)), short_and_full(" ".join(y))
    return not full or all(any(v.startswith(w[:3]) or v.endswith(w[-3:]) for v in full) for w in long)


def without_middle(name: str) -> str | None:
    """A name of two long words and a letter without the letter; None for other names."""
    short, full = short_and_full(name)
    return " ".join(full) if len(short) == 1 and len(full) == 2 else None


def rule_number(a: str, b: str) -> int:
    """the first of seven rules under which two names, in either order, may be one person's; 0 if none.

    1 same words in any order, or long words of one total length, those of the name with
    fewer inside the other's; 2 initials for all words, not two romanized names without
    any; 3 initials for some words, not both romanized; 4 beginnings for words, not both
    romanized; 5 one last letter missing; 6 a middle letter missing, not both romanized;
    7 both romanized, words of one contained in the other.
    """
    a, b = plain(a), plain(b)
    if not a or not b:
        return 0
    x, y = a.split(), b.split()
    (short_a, full_a), (short_b, full_b) = short_and_full(a), short_and_full(b)
    chinese = is_chinese_name(a), is_chinese_name(b)
    either = lambda f, *more: f(a, b, *more) or f(b, a, *more)
    if sorted(x) == sorted(y):
        return 1
    fewer, more = sorted((full_a, full_b), key=len)
    if fewer and len("".join(fewer)) == len("".join(more)) and all(w in "".join(more) for w in fewer):
        return 1
    plain_chinese = all(chinese) and not short_a and not short_b
    alone = any(c and len(w) < 2 for c, w in zip(chinese, (x, y), strict=True))
    if not plain_chinese and not alone and sorted(w[0] for w in x) == sorted(w[0] for w in y) and either(abbreviates):
        return 2
    if not all(chinese) and either(abbreviates):
        return 3
    if not all(chinese) and either(abbreviates, True):
        return 4
    if len(x) >= 3 and len(y) >= 3 and "".join(x[:-1]) == "".join(y[:-1]) and (x[-1] == y[-1][:-1] or y[-1] == x[-1][:-1]):
        return 5
    middle = without_middle(a), without_middle(b)
    if not all(chinese) and (middle[0] is None) != (middle[1] is None):
        p, q = (m.replace(" ", "") if m else n.replace(" ", "") for m, n in zip(middle, (a, b), strict=True))
        if p != q and (p.startswith(q) or q.startswith(p)):
            return 6
    if all(chinese) and len(x) >= 3 and len(y) >= 3 and not short_a and not short_b and set(fewer) <= set(more):
        return 7
    return 0


def consistent(names: list[str]) -> bool:
    """whether a set of names can be one person's: those of most words agree with each other, every other one with one of them."""
    most = max((len(n.split()) for n in names), default=0)
    fullest = sorted({n for n in names if len(n.split()) == most})
    agree = lambda a, b: any(abbreviates(p, q, True) or resembles(p, q) for p, q in ((a, b), (b, a)))
    pairs = all(agree(a, b) for i, a in enumerate(fullest) for b in fullest[:i])
    return pairs and all(any(agree(n, f) for f in fullest) for n in names if len(n.split()) < most)


def prefix_match(name: str, target: str, readings: dict[str, str] | None = None) -> bool:
    """whether a written name can be ``first_last``, by token prefixes in either order.

    A name with CJK characters is read by ``readings``, other characters in it dropped, and
    has to be the family name and the given name in full; one unread character fails it.
    """
    first, last = plain(target.split("_")[0]).replace(" ", ""), plain(target.split("_")[-1])
    if read := [c for c in name if "\u4e00" <= c <= "\u9fa5"]:
        return "".join((readings or {}).get(c, "?") for c in read) == last.replace(" ", "") + first
    words = plain(name).split()
    if len(words) < 2:
        return False
    if len(words) == 3 and first.startswith(words[0]) and last.startswith(words[-1]):
        return True
    if len(words) == 3 and words[-1] in ("a", "c"):
        words = words[:-1]
    begins = lambda parts: bool(re.match(".*".join(parts), first))
    two_letters = lambda parts: len(parts) == 2 and all(len(p) == 1 for p in parts)
    if last.startswith(words[0]):
        given = words[1:]
        if begins(given) or (len(given) == 1 and len(given[0]) == 2 and begins(list(given[0]))) or (two_letters(given) and begins(given[::-1])):
            return True
    if last.startswith(words[-1]):
        given = words[:-1]
        other = OTHER_NAMES.get("".join(given))
        return begins([other] if other else given) or (two_letters(given) and begins(given[::-1]))
    return False


def author_index(name: str, others: list[str]) -> int:
    """position of the author a name most likely means: shared token, then initials, then fewest initials left over; -1 if none or a tie."""
    mine = plain(name).split()
    split = [plain(x).split() for x in others]
    hits = [i for i, w in enumerate(split) if set(mine) & set(w)]
    if len(hits) == 1:
        return hits[0]
    gaps = []
    for i in hits:
        rest, theirs = [w for w in mine if w not in split[i]], [w[0] for w in split[i] if w not in mine]
        wanted = [w[0] for w in rest]
        if rest and not set(wanted) & set(theirs):
            continue
        letters = "".join(rest)
        gap = sum(c not in theirs for c in wanted) + sum(0.9 if c in letters else 1.0 for c in theirs if c not in wanted)
        gaps.append((gap, i))
    if gaps:
        least = min(gaps)[0]
        best = [i for g, i in gaps if g == least]
        if len(best) == 1:
            return best[0]
    inside = [i for i, w in enumerate(others) if mine and all(m in plain(w) for m in mine)]
    return inside[0] if len(inside) == 1 else -1


@F.pandas_udf(T.IntegerType())
def name_rule(a: pd.Series, b: pd.Series) -> pd.Series:
    """F25 over columns; apply it to distinct pairs."""
    return pd.Series([rule_number(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.BooleanType())
def matches_prefix(name: pd.Series, target: pd.Series) -> pd.Series:
    """F21 over columns."""
    return pd.Series([prefix_match(x or "", y or "") for x, y in zip(name, target, strict=True)], dtype="bool")


def matches_prefix_read(name: Column, target: Column, readings: dict[str, str]) -> Column:
    """F21 over columns, CJK names by a reading table."""

    @F.pandas_udf(T.BooleanType())
    def match(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([prefix_match(a or "", b or "", readings) for a, b in zip(x, y, strict=True)], dtype="bool")

    return match(name, target)


@F.pandas_udf(T.IntegerType())
def author_position(name: pd.Series, others: pd.Series) -> pd.Series:
    """F27 over columns: a name and an array of names."""
    return pd.Series([author_index(x or "", list(y) if y is not None else []) for x, y in zip(name, others, strict=True)], dtype="int32")


@F.pandas_udf(T.BooleanType())
def chinese_name(name: pd.Series) -> pd.Series:
    """F23 over a column."""
    return pd.Series([is_chinese_name(plain(x or "")) for x in name], dtype="bool")


@F.pandas_udf(T.BooleanType())
def one_person(names: pd.Series) -> pd.Series:
    """F26 over a column of name arrays."""
    return pd.Series([consistent([plain(x) for x in v if x]) if v is not None else None for v in names], dtype="object")


def romanized(s: Column, table: dict[str, str]) -> Column:
    """CJK characters through a supplied reading table, others dropped; Latin text stays."""

    @F.pandas_udf(T.StringType())
    def read(x: pd.Series) -> pd.Series:
        def one(v):
            latin = re.sub("[^A-Za-z ]", "", v).strip()
            return latin if len(latin.replace(" ", "")) > 3 else " ".join(table.get(c, "") for c in v if "一" <= c <= "龥").strip() or latin

        return x.map(one, na_action="ignore")

    return read(s)
