"""Quality rules by distribution divergence, with DataFrame functions only.

Each text's character classes and common words are compared, by Jensen-Shannon distance, with the histograms that
all texts of its language add up to. Per-text features are counted in place and written once; what is shuffled are
counts by language.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, whole_text

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Common words of a language: the WORDS most frequent of at most WORD_CHARS characters; no string is longer than that.
WORDS, WORD_CHARS = 24, 2**31 - 1
#: Common words are judged where the text's length lets at least so many of them be expected.
LEAST_HITS = 10
#: Largest Jensen-Shannon distances (0 to 1) of a text that stays, and the fewest characters and words that are judged.
MOST_CHARS, MOST_WORDS, LEAST_CHARS, LEAST_WORDS = 0.35, 0.75, 200, 50


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c)), characters, text)


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang (null: und), padded (lower-case words, two spaces between), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars (class counts)."""
    text = whole_text(docs)
    df = docs.select("doc_id", F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    df = df.select("*", split_words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    trigrams = F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), F.lit(1), F.size("words") - 2)
    df = df.select("*", F.when(F.size("words") > 3, trigrams).otherwise(F.array().cast("array<bigint>")).alias("tri"))
    ordered = F.when(F.size(F.array_distinct("tri")) < F.size("tri"), F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.select("*", ordered.alias("ordered"))
    twice = F.filter("ordered", lambda x, k: (x["h"] == F.get("ordered", k - 1)["h"]) | (x["h"] == F.get("ordered", k + 1)["h"]))
    repeated = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    octets = F.octet_length("text")
    n = lambda c: c.cast("bigint")
    df = df.select(
        "doc_id",
        "lang",
        F.concat(F.lit(" "), F.lower(F.array_join("words", "  ")), F.lit(" ")).alias("padded"),
        n(F.size("words")).alias("n_words"),
        n(F.char_length(F.array_join("words", ""))).alias("word_chars"),
        n(octets - F.octet_length(_without(F.col("text"), SYMBOLS))).alias("n_symbols"),
        n(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        n(repeated).alias("n_repeat_words"),
        n(F.char_length("text")).alias("n_all"),
        n(F.octet_length(F.regexp_replace("text", r"[^A-Z]+", ""))).alias("upper"),
        n(F.octet_length(F.regexp_replace("text", r"[^0-9]+", ""))).alias("digit"),
        n(F.octet_length(F.regexp_replace("text", r"[^a-z]+", ""))).alias("lower"),
        n(F.char_length(F.regexp_replace("text", r"[\x00-\x7F]+", ""))).alias("wide"),
    )
    space = F.col("n_all") - F.col("word_chars")
    marks = F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("lower") - F.col("wide") - F.col("n_symbols")
    return df.select("doc_id", "lang", "padded", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.array("upper", "lower", "digit", "wide", space, F.col("n_symbols"), marks).alias("chars"))


def common_words(docs: DataFrame, words: int = WORDS, word_chars: int = WORD_CHARS) -> DataFrame:
    """lang, common: the most frequent words of each language, over all texts; ties by the word."""
    short = F.filter(F.split(F.lower(whole_text(docs)), SPACE), lambda w: (w != "") if word_chars >= WORD_CHARS else (w != "") & (F.char_length(w) <= word_chars))
    counts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.explode_outer(short).alias("word")).groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = counts.where(F.col("word").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= words)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return top.groupBy("lang").agg(ordered.alias("top")).select("lang", F.transform("top", lambda x: x["word"]).alias("common"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a + b)


def js_distance(p: Column, q: Column, tp: Column, tq: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays with the totals tp and tq; 0 if either is all zeros."""
    half = lambda v, m: F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0))
    shares = F.zip_with(p, q, lambda a, b: F.struct((a / tp).alias("a"), (b / tq).alias("b")))
    both = F.aggregate(shares, F.lit(0.0), lambda s, x: s + half(x["a"], (x["a"] + x["b"]) / 2) + half(x["b"], (x["a"] + x["b"]) / 2))
    return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(both / 2, F.lit(0.0)))).otherwise(F.lit(0.0))


def quality_rules(docs: DataFrame, most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS, least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, common_distance, kept.

    A row is kept unless the base rule fails or, with at least ``least_chars`` characters and ``least_words`` words,
    a distance exceeds its limit. word_distance is over the common words and all others as one; common_distance is
    over the common words alone, 1 for a text without any, 0 where fewer than LEAST_HITS are to be expected at the
    text's length, so that a language without words in common use rejects nothing. Rows without lang share one reference. Null texts count as empty and fail the base
    rule (too few words); repeated rows each count and return; empty tables give none; null doc_ids stay.
    """
    common = common_words(docs)
    counted = text_counts(docs).join(F.broadcast(common), "lang", "left")  # one row a language, WORDS words each
    hits = F.transform("common", lambda w: ((F.octet_length("padded") - F.octet_length(F.replace("padded", F.concat(F.lit(" "), w, F.lit(" "))))) / (F.octet_length(w) + 2)).cast("bigint"))
    counted = counted.withColumn("hits", F.coalesce(hits, F.array().cast("array<bigint>"))).drop("padded", "common")
    rest = F.col("n_words") - total(F.col("hits"))
    counted = saved(counted.withColumn("hits", F.concat("hits", F.array(rest))), "quality")
    sums = counted.groupBy("lang").agg(
        F.array(*(F.sum(F.get("chars", F.lit(i))) for i in range(7))).alias("ref_chars"),
        F.array(*(F.coalesce(F.sum(F.get("hits", F.lit(i))), F.lit(0)) for i in range(WORDS + 1))).alias("ref_hits"),
    )
    sums = sums.select("*", total(F.col("ref_chars")).alias("all_chars"), total(F.col("ref_hits")).alias("all_hits"))
    df = counted.join(F.broadcast(sums), "lang")  # one row a language
    df = df.withColumns({"own_chars": total(F.col("chars")), "own_hits": total(F.col("hits")), "ref_hits": F.slice("ref_hits", F.lit(1), F.size("hits"))})
    df = df.withColumns({"char_distance": js_distance(F.col("chars"), F.col("ref_chars"), F.col("own_chars"), F.col("all_chars")), "word_distance": js_distance(F.col("hits"), F.col("ref_hits"), F.col("own_hits"), F.col("all_hits"))})
    df = df.withColumns({"own_common": F.slice("hits", F.lit(1), F.size("hits") - 1), "ref_common": F.slice("ref_hits", F.lit(1), F.size("hits") - 1)})
    df = df.withColumns({"n_common": total(F.col("own_common")), "all_common": total(F.col("ref_common"))})
    expected = F.col("n_words") * F.col("all_common") >= LEAST_HITS * F.col("all_hits")
    common_distance = F.when(expected & (F.col("all_common") > 0), F.when(F.col("n_common") == 0, F.lit(1.0)).otherwise(js_distance(F.col("own_common"), F.col("ref_common"), F.col("n_common"), F.col("all_common")))).otherwise(F.lit(0.0))
    df = df.withColumn("common_distance", common_distance)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = (F.col("own_chars") >= least_chars) & (F.col("n_words") >= least_words)
    apart = judged & ((F.col("char_distance") > most_chars) | (F.col("word_distance") > most_words) | (F.col("common_distance") > most_words))
    df = df.withColumns({"base_failed": failed, "kept": ~failed & ~apart})
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "common_distance", "kept")
