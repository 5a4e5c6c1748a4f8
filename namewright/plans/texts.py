"""Queries of string functions (F and P07 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from namewright.functions import names, similarity, text
from namewright.operators import blocking
from namewright.plans.aggregates import DOC_TOKENS, TOKENS, doc_tokens
from namewright.plans.registry import query
from namewright.plans.views import sql, table
from namewright.sources.shared import written


def q(s: str) -> str:
    return s.replace("'", "''")


def listed(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


NORM = "trim(regexp_replace(regexp_replace(lower(trim({})), '" + q(text.PUNCTUATION) + "', ' ', 'g'), '\\s{{2,}}', ' ', 'g'))"
NORM = NORM.replace("{", "{{").replace("}", "}}").replace("{{{{2,}}}}", "{{2,}}").replace("trim({{}})", "trim({})")


@query("f01_norm_text", "SELECT doc_id, md5(" + NORM.format("text") + ") AS norm FROM documents")
def f01_norm_text(spark, d):
    """F01."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.norm_text(F.col("text"))).alias("norm"))


@query("f02_tokenize", "SELECT doc_id, len(list_filter(" + TOKENS.format("text") + ", lambda w: w NOT IN " + listed(text.STOP_WORDS) + ")) AS n FROM documents")
def f02_tokenize(spark, d):
    """Long enough words outside the stop list."""
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"), 1, text.STOP_WORDS)).cast("bigint").alias("n"))


ETL = "regexp_replace(regexp_replace({}, '" + q(text.MARKS).replace("{", "{{").replace("}", "}}") + "', ' ', 'g'), ' {{2,}}', ' ', 'g')"


@query("f03_etl", "SELECT doc_id, md5(" + ETL.format("text") + ") AS cleaned FROM documents")
def f03_etl(spark, d):
    """F03."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.etl(F.col("text"))).alias("cleaned"))


@query("f04_clean_abstract", "SELECT doc_id, md5(trim(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')))) AS cleaned FROM documents")
def f04_clean_abstract(spark, d):
    """Unicode letters and digits alone."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_abstract(F.col("text"))).alias("cleaned"))


@query("f05_clean_orgs", "SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(lower(source || ' of ' || lang || '7 ' || left(text, 0)), '[^\\p{L}\\p{N}]+', ' ', 'g'), '[0-9]+', '', 'g'), ' '), lambda w: w <> '' AND w NOT IN " + listed(text.STOP_WORDS) + ") AS words FROM documents")
def f05_clean_orgs(spark, d):
    """digits and stop words out."""
    org = F.concat(F.col("source"), F.lit(" of "), F.col("lang"), F.lit("7 "))
    return table(spark, d, "documents").select("doc_id", text.clean_orgs(org).alias("words"))


def org_text(spark, d):
    """Organisation-like strings with abbreviations, from part types and brands."""
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("univ. "), F.lower("p_type"), F.lit(" lab dept. of phys-chem.; "), F.col("p_brand")).alias("org"))


REWRITTEN = "'univ. ' || lower(p_type) || ' lab dept. of phys-chem.; ' || p_brand"
for _a, _b in text.ORG_REWRITES:
    REWRITTEN = f"replace({REWRITTEN}, '{_a}', '{_b}')"


@query("f06_org_rewrite", "SELECT p_partkey, trim(" + ETL.format(f"split_part({REWRITTEN}, ';', 1)") + ") AS org FROM part")
def f06_org_rewrite(spark, d):
    """F06."""
    return org_text(spark, d).select("p_partkey", text.rewrite_org(F.col("org")).alias("org"))


@query("f07_process_org", "SELECT p_partkey, array_to_string(list_filter(string_split(" + NORM.format("'univ. ' || lower(p_type) || ' lab dept. of phys-chem.; ' || p_brand") + ", ' '), lambda w: length(w) > 0 AND w NOT IN " + listed(text.STOP_WORDS) + "), ' ') AS org FROM part")
def f07_process_org(spark, d):
    """F07."""
    return org_text(spark, d).select("p_partkey", text.process_org(F.col("org")).alias("org"))


@query("f08_one_line", "SELECT doc_id, md5(translate(text, chr(10) || chr(13), '  ')) AS line FROM documents")
def f08_one_line(spark, d):
    """F08."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.one_line(F.col("text"))).alias("line"))


PERSONS = "SELECT p_partkey, p_name || ' ' || p_brand || '-' || substr(p_type, 1, 3) AS name FROM part"


def persons(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit("-"), F.substring("p_type", 1, 3)).alias("name"))


@query("f10_clean_name", sql("SELECT p_partkey, trim(regexp_replace(lower(strip_accents(name)), '[^a-z]+', ' ', 'g')) AS name FROM persons", persons=PERSONS))
def f10_clean_name(spark, d):
    """F10."""
    return persons(spark, d).select("p_partkey", names.clean_name(F.col("name")).alias("name"))


#: Names with titles, nicknames, capitals and marks, and the tokens they must give.
WRITTEN = {
    "WB Smith": ["w", "b", "smith"], "Dr. Bill O’Neil Jr.": ["william", "oneil"], "Mr Tom Jones III": ["thomas", "jones"], "Prof. Ed Md Smith": ["prof.", "edward", "md", "smith"], "fran miller": ["frances", "miller"],
    "jan de boer": ["janice", "de", "boer"], "a.b. smith": ["a", "b", "smith"], "m. ćwiok": ["m.", "cwiok"], "M Fincke-Keeler": ["m", "fincke", "keeler"], "Junior Wells": ["wells"],
}
WRITTEN_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, {tokens!r})" for i, tokens in enumerate(WRITTEN.values())) + ") v(p_partkey, tokens)"


@query("f12_name_tokens", sql(f"SELECT p_partkey, list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS tokens FROM persons UNION ALL {WRITTEN_SQL}", persons=PERSONS))
def f12_name_tokens(spark, d):
    """tokens without particles, nicknames spelled out; the table's names and ten written ones."""
    more = spark.createDataFrame([(-i - 1, name) for i, name in enumerate(WRITTEN)], "p_partkey bigint, name string")
    rows = persons(spark, d).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "name").unionByName(more)
    return rows.select("p_partkey", names.simple_tokens(F.col("name")).alias("tokens"))


#: Names in Latin and CJK letters, a reading of the characters, and what they give.
READINGS = {"陈": "chen", "伟": "wei", "王": "wang", "芳": "fang"}
MIXED = {"陈伟": "chen wei", "W 陈伟": "chen wei", "Wei Chen 陈伟": "wei chen", "王芳芳": "wang fang fang", "John Smith": "john smith", "X": "x"}


@query("f11_mixed_names", "SELECT p_partkey, p_name AS name, lower(p_name) AS latin FROM part UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, '{a}', '{b}')" for i, (a, b) in enumerate(MIXED.items())) + ")")
def f11_mixed_names(spark, d):
    """CJK names by a table of readings unless enough Latin letters stand beside them, then F10."""
    more = spark.createDataFrame([(-i - 1, name) for i, name in enumerate(MIXED)], "p_partkey bigint, name string")
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.col("p_name").alias("name")).unionByName(more)
    return rows.select("p_partkey", "name", names.clean_name(names.romanized(F.col("name"), READINGS)).alias("latin"))


@query("f26_consistent_names", "SELECT DISTINCT p_name AS name, true AS reversed, true AS initial, false AS other FROM part")
def f26_consistent_names(spark, d):
    """each distinct name with itself reversed, with an initial, and with a name that shares nothing with it."""
    words = F.split("name", " ")
    rows = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    turned, short = F.array_join(F.reverse(words), " "), F.concat_ws(" ", F.substring("name", 1, 1), F.element_at(words, -1))
    return rows.select("name", names.one_person(F.array("name", turned)).alias("reversed"), names.one_person(F.array("name", short)).alias("initial"), names.one_person(F.array("name", F.lit("qqq zzz"))).alias("other"))


@query("f26_abbreviated_names", sql("SELECT name, short, substr(name, 1, 1) = substr(short, 1, 1) AS one_person FROM n JOIN (SELECT DISTINCT substr(name, 1, 1) || ' ' || last AS short, last FROM n) s USING (last)", n="SELECT DISTINCT p_name AS name, string_split(p_name, ' ')[-1] AS last FROM part"))
def f26_abbreviated_names(spark, d):
    """each distinct name with every abbreviated name of its last word; one person's if the initial is that of the first word."""
    rows = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("last", F.element_at(F.split("name", " "), -1))
    short = rows.select(F.concat_ws(" ", F.substring("name", 1, 1), "last").alias("short"), "last").distinct()
    return rows.join(short, "last").select("name", "short", names.one_person(F.array("name", "short")).alias("one_person"))


@query("f28_token_sets", "SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT string_split(p_name, ' ')[2] || ', ' || string_split(p_name, ' ')[1] AS p_name FROM part) b ON list_sort(string_split(a.p_name, ' ')) = list_sort(string_split(replace(b.p_name, ',', ''), ' '))")
def f28_token_sets(spark, d):
    """names and names written last name first meet by their set of tokens."""
    rows = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    words = F.split("a", " ")
    turned = rows.select(F.concat(F.get(words, F.lit(1)), F.lit(", "), F.get(words, F.lit(0))).alias("b")).distinct()
    return rows.withColumn("k", names.token_set(F.col("a"))).join(turned.withColumn("k", names.token_set(F.col("b"))), "k").select("a", "b")


@query("f13_name_key", sql("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(name), '[ .\\-_]'), lambda x: x <> ''))), '') AS key FROM persons", persons=PERSONS))
def f13_name_key(spark, d):
    """order-insensitive keys."""
    return persons(spark, d).select("p_partkey", names.name_key(F.col("name")).alias("key"))


PROCESSED = "trim(regexp_replace(regexp_replace(strip_accents(lower(translate(name, '-_', '  '))), '[^a-z\\s.]+', '', 'g'), '[.\\s]+', ' ', 'g'))"


@query("f15_process_name", sql(f"SELECT p_partkey, {PROCESSED} AS name FROM persons", persons=PERSONS))
def f15_process_name(spark, d):
    """F14, F15."""
    return persons(spark, d).select("p_partkey", names.process_name(names.without_nbsp(F.col("name"))).alias("name"))


@query("f16_abbreviations", sql("SELECT p_partkey, array_to_string(list_transform(w[1:len(w)-1], lambda x: substr(x, 1, 1)), ' ') || ' ' || w[len(w)] AS forward, substr(w[1], 1, 1) || ' ' || w[len(w)] AS simple, substr(w[2], 1, 1) || ' ' || w[1] AS mirrored_simple FROM w", persons=PERSONS, w=f"SELECT p_partkey, string_split({PROCESSED}, ' ') AS w FROM persons"))
def f16_abbreviations(spark, d):
    """Abbreviations of a name."""
    enc = names.abbreviations(F.col("name"))
    return persons(spark, d).select("p_partkey", enc[1].alias("forward"), enc[2].alias("simple"), enc[4].alias("mirrored_simple"))


@query("f17_histogram", sql("SELECT p_partkey, array_to_string(list_transform(range(97, 123), lambda c: length(lower(name)) - length(replace(lower(name), chr(CAST(c AS INTEGER)), ''))), '.') AS key FROM persons", persons=PERSONS))
def f17_histogram(spark, d):
    """F17."""
    return persons(spark, d).select("p_partkey", names.histogram_key(F.col("name")).alias("key"))


@query("f18_same_name", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE substr(a.s_name, 1, 1) = substr(b.s_name, 1, 1)")
def f18_same_name(spark, d):
    """suppliers of a nation with an encoding in common (digits drop out, so all named alike match)."""
    s = written(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", names.abbreviations(F.col("s_name")).alias("encodings")), "encodings")  # once a name, not once a pair
    pairs = blocking.met_in_slices(s.toDF("s_nationkey", "a", "x"), s.toDF("s_nationkey", "b", "y"), "s_nationkey", "a")
    return pairs.where("a < b").where(F.arrays_overlap("x", "y")).select("a", "b")


@query("f19_concatenations", "SELECT p_partkey, [replace(lower(p_name), ' ', ''), split_part(lower(p_name), ' ', 2) || split_part(lower(p_name), ' ', 1)] AS both_ FROM part")
def f19_concatenations(spark, d):
    """of two-word names."""
    return table(spark, d, "part").select("p_partkey", names.concatenations(F.col("p_name")).alias("both_"))


@query("f20_letters", "SELECT doc_id, md5(lower(regexp_replace(text, '[^\\p{L}]', '', 'g'))) AS letters FROM documents")
def f20_letters(spark, d):
    """F20."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.letters_only(F.col("text"))).alias("letters"))


@query("f22_has_chinese", "SELECT doc_id, regexp_matches(text, '[\\x{4e00}-\\x{9fa5}]') AS chinese FROM documents")
def f22_has_chinese(spark, d):
    """F22."""
    return table(spark, d, "documents").select("doc_id", text.has_chinese(F.col("text")).alias("chinese"))


#: Pairs of name tokens for the string distances: every two-word name against those with the same first word.
PAIRS = "SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1)"


def name_pairs(spark, d):
    n = table(spark, d, "part").select("p_name").distinct().withColumn("w", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return n.toDF("a", "w").join(n.toDF("b", "w"), "w").select("a", "b")


@query("f29_jaro", sql("SELECT a, b, round(jaro_similarity(a, b), 6) AS jaro FROM pairs", pairs=PAIRS))
def f29_jaro(spark, d):
    """F29."""
    return name_pairs(spark, d).select("a", "b", F.round(similarity.jaro(F.col("a"), F.col("b")), 6).alias("jaro"))


@query("f30_jaro_winkler", sql("SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS jw FROM pairs", pairs=PAIRS))
def f30_jaro_winkler(spark, d):
    """F30."""
    return name_pairs(spark, d).select("a", "b", F.round(similarity.jaro_winkler(F.col("a"), F.col("b")), 6).alias("jw"))


#: The longest common subsequence of each pair, a cell a round: ``above`` is the row of the letter before, ``line`` the row so far.
CELL = "CASE WHEN substr(a, k // length(b) + 1, 1) = substr(b, k % length(b) + 1, 1) THEN above[k % length(b) + 1] + 1 ELSE greatest(line[k % length(b) + 1], above[k % length(b) + 2]) END"
CELLS = f"SELECT a, b, 0 AS k, list_transform(range(length(b) + 1), lambda x: CAST(0 AS BIGINT)) AS above, [CAST(0 AS BIGINT)] AS line FROM pairs UNION ALL SELECT a, b, k + 1, CASE WHEN k % length(b) + 1 = length(b) THEN list_append(line, cell) ELSE above END, CASE WHEN k % length(b) + 1 = length(b) THEN [CAST(0 AS BIGINT)] ELSE list_append(line, cell) END FROM (SELECT *, {CELL} AS cell FROM cells WHERE k < length(a) * length(b))"


@query("f30_levenshtein_ratio", sql("SELECT a, b, round(2.0 * above[length(b) + 1] / (length(a) + length(b)), 6) AS ratio FROM cells WHERE k = length(a) * length(b)", pairs=PAIRS, cells=CELLS).replace("WITH ", "WITH RECURSIVE ", 1))
def f30_levenshtein_ratio(spark, d):
    """substitutions cost two."""
    return name_pairs(spark, d).select("a", "b", F.round(similarity.levenshtein_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("f31_letter_distance", sql("SELECT a, b, CAST(list_sum(list_transform(range(97, 123), lambda c: abs((length(a) - length(replace(a, chr(CAST(c AS INTEGER)), ''))) - (length(b) - length(replace(b, chr(CAST(c AS INTEGER)), '')))))) AS INTEGER) AS distance FROM pairs", pairs=PAIRS))
def f31_letter_distance(spark, d):
    """F31."""
    return name_pairs(spark, d).select("a", "b", similarity.letter_distance(F.col("a"), F.col("b")).alias("distance"))


@query("f33_affix", sql("SELECT a, b, starts_with(a, left(b, 3)) OR ends_with(a, right(b, 3)) AS affix FROM pairs", pairs=PAIRS))
def f33_affix(spark, d):
    """F33."""
    return name_pairs(spark, d).select("a", "b", text.affix_match(F.col("a"), F.col("b")).alias("affix"))


@query("f34_concat", "SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type, p_size) AS all_ FROM part")
def f34_concat(spark, d):
    """F34."""
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("all_"))


@query("f35_split_class", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[., :;)(0-9%\\[\\]]'), lambda x: x <> '')) AS n FROM documents")
def f35_split_class(spark, d):
    """F35."""
    return table(spark, d, "documents").select("doc_id", F.size(text.split_class(F.col("text"))).cast("bigint").alias("n"))


@query("f36_prompt", "SELECT o_custkey AS aid, 'Titles: ' || string_agg(CAST(o_orderkey AS VARCHAR), ' # ' ORDER BY md5('8|' || o_orderkey), o_orderkey) || '. Which is an outlier?' AS prompt FROM orders GROUP BY o_custkey")
def f36_prompt(spark, d):
    """a template with titles in a seeded order."""
    from namewright.operators.ranking import hashed_order

    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("aid"), F.struct(hashed_order("o_orderkey", seed=8).alias("h"), F.col("o_orderkey").alias("k")).alias("s"))
    titles = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["k"].cast("string")), " # ")
    return rows.groupBy("aid").agg(F.format_string("Titles: %s. Which is an outlier?", titles).alias("prompt"))


@query("f37_keywords", "SELECT p_partkey, list_filter([trim(lower(" + ETL.format("p_type") + ")), trim(lower(" + ETL.format("p_brand") + "))], lambda x: x <> '') AS phrases FROM part")
def f37_keywords(spark, d):
    """phrases, cleaned."""
    return table(spark, d, "part").select("p_partkey", text.keywords(F.array("p_type", "p_brand")).alias("phrases"))


@query("f38_title_words", "SELECT p_partkey, list_sort(list_distinct(list_filter(list_concat(string_split(lower(p_name), ' '), [lower(p_brand)]), lambda w: w <> '' AND w NOT IN " + listed(text.STOP_WORDS) + "))) AS words FROM part")
def f38_title_words(spark, d):
    """F38."""
    return table(spark, d, "part").select("p_partkey", F.array_sort(text.title_words(F.col("p_name"), F.array("p_brand"))).alias("words"))


@query("v21_ngrams", "SELECT p_partkey, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS grams FROM (SELECT p_partkey, string_split(p_name || ' ' || p_brand, ' ') AS w FROM part)")
def v21_ngrams(spark, d):
    """V21."""
    return table(spark, d, "part").select("p_partkey", text.ngrams(F.split(F.concat_ws(" ", "p_name", "p_brand"), " "), 2).alias("grams"))


@query("f25_name_rules")
def f25_name_rules(spark, d):
    """Rules on distinct name pairs; expectations are written out in the tests."""
    a, b = F.col("a"), F.col("b")
    pairs = name_pairs(spark, d)
    return pairs.select("a", "b", names.name_rule(a, b).alias("rule"), names.author_position(a, F.array(b, F.reverse(b))).alias("position"), names.matches_prefix(a, F.concat_ws("_", F.split_part(b, F.lit(" "), F.lit(1)), F.split_part(b, F.lit(" "), F.lit(2)))).alias("prefix"), names.chinese_name(a).alias("chinese"))


def stem_sql(word: str) -> str:
    """SQL of ``stem.stem``; the last letters are compared one by one."""
    from namewright.functions.stem import ENDINGS

    cases = []
    for end, put in ENDINGS:
        left = f"substr({word}, 1, length({word}) - {len(end)})"
        fits = f"suffix({word}, '{end}') AND length({word}) >= {len(end) + 3} AND regexp_matches({left}, '[aeiouy]')" + (f" AND NOT suffix({word}, 'ss')" if end == "s" else "")
        if end in ("ing", "ed"):
            last = f"substr({word}, length({word}) - {len(end)}, 1)"
            cases.append(f"WHEN {fits} AND length({word}) > {len(end) + 3} AND {last} = substr({word}, length({word}) - {len(end) + 1}, 1) AND {last} NOT IN ('l', 's', 'z') THEN substr({word}, 1, length({word}) - {len(end) + 1})")
        cases.append(f"WHEN {fits} THEN {left} || '{put}'")
    return f"CASE {' '.join(cases)} ELSE {word} END"


@query("f09_stem", sql(f"SELECT stem, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {stem_sql('w')} AS stem, n FROM (SELECT w, count(*) AS n FROM (SELECT unnest(tokens) AS w FROM t) GROUP BY w)) GROUP BY stem", t=DOC_TOKENS))
def f09_stem(spark, d):
    """tokenizer pipeline with a light suffix stemmer, a word once."""
    from namewright.functions.stem import stem

    words = doc_tokens(spark, d).select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return words.select(stem(F.col("w")).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))


@query("f09_snowball")
def f09_snowball(spark, d):
    """lower case, no digits, contractions, punctuation and stop words, Snowball stems; words are counted first, so each is stemmed once, in Column rules throughout."""
    from namewright.functions.snowball import with_stems, words_of

    words = table(spark, d, "documents").select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return with_stems(words, "word").groupBy("stem").agg(F.sum("n").alias("n"))
