"""Quality rules by distribution divergence, in DataFrame functions alone.

Every document's histograms of character classes and of its language's common
words are compared with the language's reference, the sum of the histograms
of all its documents that pass the base rules, by Jensen-Shannon distance. Short documents
are guarded: their histograms say too little, so the distances don't count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import work_dir, written

#: Base rules: fewest words, and the most words (of 100) in repeated windows of WINDOW words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: A document goes beyond one of these distances, or beyond both of the nearer ones, if it has GUARD words.
FAR_CHAR, FAR_WORD = 0.30, 0.45
NEAR_CHAR, NEAR_WORD = 0.125, 0.20
GUARD = 60
#: A reference of fewer documents than this is no reference.
LEAST_DOCUMENTS = 20
#: Character classes, taken out of the text one after the other: what is left becomes shorter each time.
CLASSES = {"c_lower": "[a-z]+", "c_space": r"[\x20\x09-\x0D]+", "c_upper": "[A-Z]+", "c_stop": r"[-.,;:!?'\"()]+", "c_symbol": "[#*$%&|<>]+", "c_digit": "[0-9]+"}
#: Frequent function words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "with", "are"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "que", "en", "qui", "dans", "est"],
    "de": ["der", "die", "und", "den", "das", "von", "zu", "mit", "sich", "des", "auf", "nicht"],
    "es": ["de", "la", "que", "el", "en", "los", "del", "las", "un", "por", "con", "una"],
    "": ["the", "of", "and", "de", "la", "le", "der", "die", "und", "que", "el", "en"],
}
LETTERS = "abcdefghijkl"
CHAR_BINS = [*CLASSES, "c_other"]
WORD_BINS = [f"w_{x}" for x in LETTERS] + ["w_none"]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _cased(common: list[str]) -> list[str]:
    return [*common, *(w[:1].upper() + w[1:] for w in common)]


def _listed(words: Column, common: list[str]) -> Column:
    return F.filter(words, lambda x: x.isin(_cased(common)))


def _letters(listed: Column, common: list[str]) -> Column:
    letters, places = F.array(*map(F.lit, LETTERS + LETTERS)), F.array(*map(F.lit, _cased(common)))
    return F.array_join(F.transform(listed, lambda x: F.element_at(letters, F.array_position(places, x).cast("int"))), "")


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The counts and histograms of each row, without its text."""
    text = F.col("text")
    d = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[lang_col], F.lit("")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    d = d.select("doc_id", "lang", "text", _words(text).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    words = F.col("words")
    n = F.size(words)
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    listed = {lang: _listed(words, common) for lang, common in COMMON.items()}
    common = reduce(lambda rest, lang: F.when(F.col("lang") == lang, listed[lang]).otherwise(rest), [x for x in COMMON if x], listed[""])
    d = d.select(
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        F.length("text").alias("c_all"),
        F.col("text").alias("rest"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
        common.alias("common"),
    )
    for name, pattern in CLASSES.items():
        d = d.withColumn("less", F.regexp_replace("rest", pattern, "")).withColumn(name, F.length("rest") - F.length("less")).drop("rest").withColumnRenamed("less", "rest")
    d = d.withColumn("c_other", F.length("rest")).drop("rest").withColumn("word_chars", (F.col("c_all") - F.col("c_space")).cast("long")).withColumn("n_symbols", F.col("c_symbol").cast("long"))
    # windows that are found again, in order; only rows that have some are sorted
    ranked = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("ranked", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), ranked).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("hashes")
    own = F.col("ranked")
    again = F.filter(own, lambda x, j: F.coalesce(F.get(own, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(own, j + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("places", F.array_sort(F.transform(again, lambda x: x["i"]))).drop("ranked")
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    d = d.withColumn("n_repeat_words", F.aggregate("places", start, lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"]).cast("long")).drop("places")
    # one letter for each common word, so that counting is by lengths
    coded = {lang: _letters(F.col("common"), common) for lang, common in COMMON.items()}
    letters = reduce(lambda rest, lang: F.when(F.col("lang") == lang, coded[lang]).otherwise(rest), [x for x in COMMON if x], coded[""])
    d = d.withColumn("letters", letters).drop("common")
    for x in LETTERS:
        d = d.withColumn(f"w_{x}", F.length("letters") - F.length(F.replace(F.col("letters"), F.lit(x), F.lit(""))))
    d = d.withColumn("w_none", F.col("n_words") - F.length("letters"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *CHAR_BINS, *WORD_BINS)


def distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence to base 2) of two histograms, as arrays; 0 where one is empty."""
    mass = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    p_all, q_all = mass(own), mass(reference)

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    total = mass(F.zip_with(F.transform(own, lambda x: x / p_all), F.transform(reference, lambda y: y / q_all), part)) / 2
    return F.when((p_all > 0) & (q_all > 0), F.sqrt(F.greatest(total, F.lit(0.0)))).otherwise(0.0)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance of each row.

    A null text has no words, no lines and fails the base rules. A null or unlisted language is compared
    with a reference of its own rows, over common words of all languages. A language with fewer than
    LEAST_DOCUMENTS sound documents has no reference: its distances are 0. Equal rows give equal rows; an
    empty table gives none. One pass over the texts; the histograms, without texts, are written to the shared folder, and
    the references are sums over them.
    """
    rows = written(features(docs, id_col, text_col, lang_col), work_dir(docs.sparkSession, "histograms"))
    sound = rows.where(~F.col("base_failed") & (F.col("n_words") >= GUARD))
    shares = [F.sum(F.col(c) / F.greatest(reduce(lambda a, b: a + b, [F.col(x) for x in group]), F.lit(1))).alias(f"r_{c}") for group in (CHAR_BINS, WORD_BINS) for c in group]
    reference = sound.groupBy(F.col("lang").alias("r_lang")).agg(F.count("*").alias("r_n"), *shares).where(F.col("r_n") >= LEAST_DOCUMENTS)
    both = rows.join(reference, F.col("lang") == F.col("r_lang"), "left")
    zero = F.lit(0.0)
    # (arrays: spelt out, the distances' code would be too long to be compiled)
    histogram = lambda group: F.array(*[F.col(c).cast("double") for c in group])
    usual = lambda group: F.array(*[F.coalesce(F.col(f"r_{c}"), zero) for c in group])
    char, word = (distance(histogram(group), usual(group)) for group in (CHAR_BINS, WORD_BINS))
    both = both.withColumn("char_distance", F.round(char, 6)).withColumn("word_distance", F.round(word, 6))
    char, word = F.col("char_distance"), F.col("word_distance")
    far = (F.col("n_words") >= GUARD) & ((char > FAR_CHAR) | (word > FAR_WORD) | (char > NEAR_CHAR) & (word > NEAR_WORD))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance")


__all__ = ["distance", "features", "quality"]


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _oracle() -> str:
    """The same rows in DuckDB's SQL."""
    count = {name: f"length(t) - length(regexp_replace(t, '{pattern[:-1].replace(chr(39), chr(39) * 2)}', '', 'g'))" for name, pattern in CLASSES.items()}
    lists = " ".join(f"WHEN '{lang}' THEN {_sql_list(words)}" for lang, words in COMMON.items() if lang)
    total = {c: " + ".join(group) for group in (CHAR_BINS, WORD_BINS) for c in group}

    def distance_sql(group: list[str]) -> str:
        parts = []
        for c in group:
            p, q = f"({c} / ({total[c]})::DOUBLE)", f"(r_{c} / ({' + '.join(f'r_{x}' for x in group)}))"
            parts += [f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END", f"CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END"]
        return f"coalesce(CASE WHEN {total[group[0]]} > 0 THEN sqrt(greatest(({' + '.join(parts)}) / 2, 0)) END, 0)"

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  CASE lang {lists} ELSE {_sql_list(COMMON[''])} END AS c FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW}))),
r AS (SELECT rid, sum(n)::BIGINT AS n FROM (SELECT rid, least({WINDOW}, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), {WINDOW})) AS n FROM g WHERE n > 1) GROUP BY rid),
f AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(t) AS c_all, {', '.join(f'{e} AS {name}' for name, e in count.items())}, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  {', '.join(f"len(list_filter(w, lambda x: x = c[{k}] OR x = upper(c[{k}][1]) || c[{k}][2:])) AS w_{x}" for k, x in enumerate(LETTERS, 1))} FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, c_all - ({' + '.join(CLASSES)}) AS c_other, n_words - ({' + '.join(WORD_BINS[:-1])}) AS w_none, c_all - c_space AS word_chars, c_symbol AS n_symbols,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f),
ref AS (SELECT lang, {', '.join(f'sum({c} / greatest({total[c]}, 1)::DOUBLE) AS r_{c}' for c in CHAR_BINS + WORD_BINS)} FROM b WHERE NOT base_failed AND n_words >= {GUARD} GROUP BY lang HAVING count(*) >= {LEAST_DOCUMENTS}),
j AS (SELECT b.*, round({distance_sql(CHAR_BINS)}, 6) AS char_distance, round({distance_sql(WORD_BINS)}, 6) AS word_distance FROM b LEFT JOIN ref USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {GUARD} AND (char_distance > {FAR_CHAR} OR word_distance > {FAR_WORD} OR (char_distance > {NEAR_CHAR} AND word_distance > {NEAR_WORD}))) AS kept, char_distance, word_distance FROM j"""


ORACLE = _oracle()
