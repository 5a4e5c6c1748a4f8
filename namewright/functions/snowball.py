"""The English Snowball stemmer and its text pipeline as Column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Contractions spelled out, in this order.
CONTRACTIONS = [("won't", "will not"), ("can't", "can not"), ("ain't", "am not"), ("n't", " not"), ("'re", " are"), ("'s", " is"), ("'d", " would"), ("'ll", " will"), ("'t", " not"), ("'ve", " have"), ("'m", " am")]
# The English stop words of the pipeline.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "couldn", "didn", "doesn", "hadn", "hasn", "haven", "isn", "ma", "mightn",
    "mustn", "needn", "shan", "shouldn", "wasn", "weren", "won", "wouldn", "would",
]
# Words with a stem of their own.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
    "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing", "canning": "canning", "cannings": "canning", "herring": "herring", "herrings": "herring", "earring": "earring", "earrings": "earring",
    "proceed": "proceed", "proceeds": "proceed", "proceeded": "proceed", "proceeding": "proceed", "exceed": "exceed", "exceeds": "exceed", "exceeded": "exceed", "exceeding": "exceed",
    "succeed": "succeed", "succeeds": "succeed", "succeeded": "succeed", "succeeding": "succeed",
}
# Endings and what they become, for the second, third and fourth step.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = dict.fromkeys(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"], "")


def words_of(text: Column) -> Column:
    """The pipeline before stemming: lower case, digits out, contractions spelled out, punctuation out, stop words out."""
    s = F.regexp_replace(F.lower(text), "[0-9]+", "")
    for short, full in CONTRACTIONS:
        s = F.replace(s, F.lit(short), F.lit(full))
    s = F.regexp_replace(s, r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(s, r"\s+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def swapped(w: Column, region: Column, table: dict[str, str], more: Column) -> Column:
    """The longest ending of the table exchanged, where it lies in the region and ``more`` holds."""
    end = ending(w, table)
    to = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[end]
    return F.when((end != "") & (F.length(w) - F.length(end) >= region) & more, F.concat(F.left(w, F.length(w) - F.length(end)), to)).otherwise(w)


def ending(w: Column, ends) -> Column:
    return F.regexp_extract(w, f"({'|'.join(ends)})$", 1)


def without(w: Column, n: int) -> Column:
    return F.left(w, F.length(w) - n)


def with_stems(df: DataFrame, word: str, name: str = "stem") -> DataFrame:
    """Adds the stem of a column of lower-case words; null stays null. Every step is a projection, so no rule is computed twice.

    Vowels are a, e, i, o, u and y; a y that begins the word or follows a vowel counts as a
    consonant and is written Y meanwhile. The first region begins behind the first consonant
    after a vowel (behind gener, commun, arsen), the second one likewise within the first.
    """
    w, r1, r2 = F.col("w_"), F.col("r1_"), F.col("r2_")
    out = df.withColumn("w_", F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^'", ""), "('s'|'s|')$", ""), "^y", "Y"), "([aeiouy])y", "$1Y"))
    begin = "^(gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy])"
    out = out.withColumn("r1_", F.length(F.regexp_extract(w, begin, 1)))
    out = out.withColumn("r1_", F.when(r1 > 0, r1).otherwise(F.length(w)))
    inner = F.length(F.regexp_extract(F.substring(w, r1 + 1, F.length(w)), "^([^aeiouy]*[aeiouy]+[^aeiouy])", 1))
    out = out.withColumn("r2_", F.when(inner > 0, r1 + inner).otherwise(F.length(w)))
    # Plurals.
    step = F.when(w.endswith("sses"), without(w, 2)).when(w.rlike("..(ied|ies)$"), without(w, 2)).when(w.rlike("(ied|ies)$"), without(w, 1))
    out = out.withColumn("w_", step.when(w.rlike("(us|ss)$"), w).when(w.rlike("[aeiouy].+s$"), without(w, 1)).otherwise(w))
    # Past and present participles; what is left may need an e or lose a doubled letter.
    end = F.col("end_")
    out = out.withColumn("end_", ending(w, ["eedly", "ingly", "edly", "eed", "ing", "ed"]))
    out = out.withColumn("left_", F.left(w, F.length(w) - F.length(end)))
    left = F.col("left_")
    short = (F.length(left) <= r1) & (left.rlike("[^aeiouy][aeiouy][^aeiouywxY]$") | left.rlike("^[aeiouy][^aeiouy]$"))
    mended = F.when(left.rlike("(at|bl|iz)$") | short & ~left.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.concat(left, F.lit("e"))).when(left.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), without(left, 1)).otherwise(left)
    step = F.when(end.isin("eed", "eedly"), F.when(F.length(left) >= r1, F.concat(left, F.lit("ee"))).otherwise(w))
    out = out.withColumn("w_", step.when((end != "") & left.rlike("[aeiouy]"), mended).otherwise(w))
    out = out.withColumn("w_", F.when(w.rlike(".[^aeiouy][yY]$"), F.concat(without(w, 1), F.lit("i"))).otherwise(w))
    # Endings of derived words.
    out = out.withColumn("w_", swapped(w, r1, SECOND, F.when(ending(w, SECOND) == "ogi", w.endswith("logi")).when(ending(w, SECOND) == "li", w.rlike("[cdeghkmnrt]li$")).otherwise(True)))
    out = out.withColumn("w_", swapped(w, r1, THIRD, F.when(ending(w, THIRD) == "ative", F.length(w) - 5 >= r2).otherwise(True)))
    out = out.withColumn("w_", swapped(w, r2, FOURTH, F.when(ending(w, FOURTH) == "ion", w.rlike("[st]ion$")).otherwise(True)))
    # A last e or l.
    bare = (F.length(w) > r2) | (F.length(w) > r1) & (F.length(w) >= 4) & ~w.rlike("[^aeiouy][aeiouy][^aeiouywxY]e$")
    out = out.withColumn("w_", F.when(w.endswith("e") & bare | w.endswith("ll") & (F.length(w) > r2), without(w, 1)).otherwise(w))
    own = F.create_map(*[F.lit(x) for kv in EXCEPTIONS.items() for x in kv])[F.col(word)]
    stem = F.when(F.length(word) <= 2, F.col(word)).otherwise(F.coalesce(own, F.replace(w, F.lit("Y"), F.lit("y"))))
    return out.withColumn(name, stem).drop("w_", "r1_", "r2_", "end_", "left_")
