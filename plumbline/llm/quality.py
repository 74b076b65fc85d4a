"""Quality rules by distribution divergence (DataFrame functions only).

A document's character-class histogram and its histogram of common words are compared
with those of its language, gathered over all documents, by the Jensen-Shannon distance
(base 2, so between 0 and 1). Counts that basic rules need come from the same pass.

Defined results: null or empty text has no words and fails the base rules; a document of null
language adds to no reference and is compared with the nearest one (least word distance; for
texts too short for it, least distance of character classes; ties by language); a language whose documents have fewer than
``min_reference_words`` words together gives no verdict, as do texts below the minimum
lengths; repeated rows are judged one by one and alike; an empty table gives no rows; columns
that aren't carried are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, bound, saved, words_of

SYMBOLS = r"[#*$%&|<>]"
MARKS = r"""[.,;:!?'"()\-]"""
NO_LANG = "\x00none"
#: So many common words, of all languages together, are looked up as literals.
MOST_LITERALS = 10_000
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of equal length; null if either sums to 0."""

    def shares(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        return F.when(total > 0, bound(total, lambda t: F.transform(x, lambda v: v / t)))

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(shares(p), shares(q), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2, F.lit(0.0)))


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """How many words stand in windows of ``size`` words that the array holds twice or more.

    Windows are compared by a 64-bit hash. Only arrays with a repeat are sorted."""
    n = F.size(words)
    hashes = F.when(
        n >= size,
        F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            near = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            return F.transform(F.filter(s, lambda x, j: F.coalesce(near(x, j), F.get(s, j + 1)["h"] == x["h"], F.get(s, j - 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])

        def shift(r: Column, by: int) -> Column:
            return F.transform(r, lambda x: x + by)

        shifted = lambda r: F.flatten(F.array(*[shift(r, k) for k in range(size)]))
        return F.size(F.array_distinct(bound(bound(pairs, starts), shifted)))

    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def _common_words(docs: DataFrame, top: int) -> DataFrame:
    """The ``top`` most frequent words of each language, ties by the word."""
    counted = docs.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    return ranked.filter(F.col("rank") <= top).groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("common"))


def _hits(common: Column, known: str) -> Column:
    """How often each of the common words stands in the column ``known``."""
    return F.transform(common, lambda c: (F.size(known) - F.size(F.array_remove(known, c))).cast("double"))


def _features(docs: DataFrame, is_known) -> DataFrame:
    """Counts of each document (columns row, lang, text, words, common). ``is_known`` tells the
    words that some list of common words holds; a document without language keeps these."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    once = docs.select(
        "row", "lang", "words", "common", text.alias("text"),
        F.regexp_replace(text, r"\p{Ll}+", "").alias("rest"), lines.alias("lines"),
        F.filter("words", is_known).alias("known"),
    )
    count = lambda what: F.regexp_count("rest", F.lit(what)).cast("long")
    counted = once.select(
        "row", "lang", "common", F.when(F.col("lang") == NO_LANG, F.col("known")).alias("listed"),
        F.size("words").cast("long").alias("n_words"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"),
        (F.length("text") - F.length("rest")).cast("long").alias("lower"),
        count(r"\p{Lu}").alias("upper"), count(r"\p{Nd}").alias("digit"), count(SPACES[:-1]).alias("space"), count(MARKS).alias("mark"),
        _hits(F.col("common"), "known").alias("hits"),
    )
    named = ("lower", "upper", "digit", "space", "mark", "n_symbols")
    other = F.col("n_chars") - sum((F.col(c) for c in named[1:]), F.col(named[0]))
    hit = F.aggregate("hits", F.lit(0.0), lambda a, v: a + v)
    return counted.select(
        "row", "lang", "n_words", (F.col("n_chars") - F.col("space")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*[F.col(c).cast("double") for c in named], other.cast("double")).alias("chars_hist"),
        F.concat("hits", F.array(F.col("n_words") - hit)).alias("words_hist"), "n_chars", "listed",
    )


def _summed(hist: str, width: int) -> Column:
    return F.array(*[F.sum(F.coalesce(F.get(hist, F.lit(k)), F.lit(0.0))) for k in range(width)])


def quality_verdicts(
    docs: DataFrame, *, carry: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", top_words: int = 40,
    max_char_distance: float = 0.30, max_word_distance: float = 0.36, min_chars: int = 200, min_words: int = 100,
    min_reference_words: int = 2000, base_min_words: int = 50, max_repeat_percent: int = 50,
) -> DataFrame:
    """One row per document: the columns in ``carry`` (doc_id if not given; none may have a result's
    name), its counts, both distances (null where a guard forbids a verdict), ``base_failed`` and ``kept``.

    The common words are counted over all words of all documents by one aggregation whose
    partial sums are made before the shuffle; a document's counts are made in one pass and
    written, so that references and verdicts read small rows."""
    text = F.col(text_col)
    base = docs.select(F.struct(*(carry or ["doc_id"])).alias("row"), F.coalesce(lang_col, F.lit(NO_LANG)).alias("lang"), text.alias("text"))
    worded = base.select("row", "lang", "text", words_of(F.col("text")).alias("words"))
    common = saved(_common_words(base.filter(F.col("lang") != NO_LANG).select("lang", words_of(F.col("text")).alias("words")), top_words), "common")
    listed = worded.join(common, "lang", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))
    lists = common.select(F.explode("common").alias("word")).distinct().limit(MOST_LITERALS + 1).collect()
    literals = [r.word for r in lists]  # a few words for each language; beyond the bound each row's own list is searched
    known = (lambda w: w.isin(literals)) if 0 < len(literals) <= MOST_LITERALS else (lambda w: (F.col("lang") == NO_LANG) | F.array_contains(F.col("common"), w))
    rows = saved(_features(listed, known), "features")
    refs = rows.filter(F.col("lang") != NO_LANG).groupBy("lang").agg(
        F.sum("n_words").alias("ref_words"), _summed("chars_hist", len(CLASSES)).alias("ref_chars_hist"),
        _summed("words_hist", top_words + 1).alias("ref_words_hist"),
    )
    refs = saved(refs, "references")
    enough = F.col("ref_words") >= min_reference_words
    ref_words = F.slice("ref_words_hist", 1, F.size("words_hist"))
    char_distance = lambda ref: F.when(F.col("n_chars") >= min_chars, js_distance(F.col("chars_hist"), ref))
    word_distance = lambda hist, ref: F.when(F.col("n_words") >= min_words, js_distance(hist, ref))
    own = rows.filter(F.col("lang") != NO_LANG).join(refs, "lang").select(
        rows["*"],
        F.when(enough, char_distance(F.col("ref_chars_hist"))).alias("char_distance"),
        F.when(enough, word_distance(F.col("words_hist"), ref_words)).alias("word_distance"),
    )

    def distances(ref: Column) -> Column:
        """A struct that is the least for the nearest reference."""
        hist = bound(_hits(ref["common"], "listed"), lambda hits: F.concat(hits, F.array(F.col("n_words") - F.aggregate(hits, F.lit(0.0), lambda a, v: a + v))))
        words = bound(hist, lambda h: word_distance(h, F.slice(ref["words"], 1, F.size(h))))
        near = F.struct(words.alias("w"), char_distance(ref["chars"]).alias("c"))
        return bound(near, lambda d: F.struct(F.coalesce(d["w"], F.lit(2.0)), F.coalesce(d["c"], F.lit(2.0)), ref["lang"], d.alias("d")))

    every = refs.filter(enough).join(common, "lang").agg(F.collect_list(F.struct("lang", "common", F.col("ref_chars_hist").alias("chars"), F.col("ref_words_hist").alias("words"))).alias("every"))
    unnamed = rows.filter(F.col("lang") == NO_LANG).crossJoin(F.broadcast(every))  # one row
    unnamed = unnamed.withColumn("nearest", F.array_min(F.transform("every", distances))["d"])
    out = own.unionByName(unnamed.select(rows["*"], F.col("nearest.c").alias("char_distance"), F.col("nearest.w").alias("word_distance")))
    failed = (F.col("n_words") < base_min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    even = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return out.select(
        "row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & even).alias("kept"), "char_distance", "word_distance",
    )
