"""Line-first quality rules.

Every line is judged on its own by punctuation, navigation and boilerplate
rules. Lines that fail are taken out, and a document that loses too large a
part of its words is rejected. A document also fails on the base counts:
too few words, or too many words inside 8-word windows that repeat.

All of it is one projection over each document (no shuffle, no Python): line
rules are filters over the array of lines, and repeated windows are found by
sorting window hashes inside the document, in n log n steps.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.llm.common import WORD, let, read

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"

#: Rules for a line.
MIN_LINE_WORDS = 3              # shorter lines are not judged by their punctuation
MAX_SYMBOLS_PER_WORD = 0.25     # punctuation: decoration around the words
MAX_SHOUT_PER_WORD = 0.5        # punctuation: "!!" or "??" after words
SHOUT = "[!?]{2,}"
MIN_BARS = 2                    # navigation: separators between entries,
MAX_ENTRY_WORDS = 4             # which have no more words than that on average
BARS, RIGHT, LEFT = "[|›]", "»", "«"    # » separates only in a line without «; the two are quotation marks
NAVIGATION = r"[|»›]"
#: Boilerplate by its number of words. Phrases count in any case and as whole words, and
#: fail a line where they make up this part of its words.
PHRASES = {2: ["privacy policy", "accept cookies", "enable javascript", "lorem ipsum", "click here", "read more", "subscribe to"],
           3: ["all rights reserved", "terms of use", "terms of service", "use of cookies", "back to top"]}
MIN_BOILERPLATE = 0.3
FEW = 64                        # repeated hashes that are looked up one by one
MAX_LOST = 0.5                  # part of the words that a kept document may lose


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _with_later(hashes: Column, reach: int) -> Column:
    """Each hash joined with the one ``reach`` places later."""
    return let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + reach))))


def _repeat_words(tokens: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more."""
    joined = F.transform(tokens, lambda w: F.xxhash64(w))
    for reach in (1, 2, 4):                          # hashes of 2, 4 and 8 words from those of half as many
        joined = _with_later(joined, reach)
    hashes = F.slice(joined, F.lit(1), F.size(tokens) - (WINDOW - 1))
    covered = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(tokens) > WINDOW, covered).otherwise(F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words that the windows with a repeated hash cover together."""
    ordered = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i - 1) == x)))
    places = let(ordered, lambda repeated: F.when(F.size(repeated) <= FEW, _places_of(hashes, repeated)).otherwise(_places_sorted(hashes)))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def _places_of(hashes: Column, repeated: Column) -> Column:
    """Where the few repeated hashes stand."""
    marked = F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i))
    return F.array_compact(marked)


def _places_sorted(hashes: Column) -> Column:
    """Where hashes stand that occur twice or more: neighbours in hash order. n log n steps for any number of them."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(rows: Column) -> Column:
        twin = lambda x, i: (F.get(rows, i + 1)["h"] == x["h"]) | (F.get(rows, i - 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(rows, twin), lambda x: x["i"]))

    return let(ordered, places)


def _may_hold_phrase(text: Column) -> Column:
    """False only where the text has no phrase; a quick test without word boundaries."""
    return let(F.lower(text), lambda low: reduce(or_, [low.contains(p) for own in PHRASES.values() for p in own]))


def _boilerplate(line: Column, n: Column) -> Column:
    """Whether phrases make up MIN_BOILERPLATE of the n words of a line."""
    found = [k * F.regexp_count(F.lower(line), F.lit(r"(?<![\p{L}\p{N}])(?:" + "|".join(own) + r")(?![\p{L}\p{N}])")) for k, own in PHRASES.items()]
    return F.when(_may_hold_phrase(line), reduce(add, found) >= F.greatest(F.lit(1), MIN_BOILERPLATE * n)).otherwise(F.lit(False))


def line_fails(line: Column) -> Column:
    """Whether a line (null: none) fails a punctuation, navigation or boilerplate rule."""
    n = F.regexp_count(line, F.lit(WORD))
    decorated = F.regexp_count(line, F.lit(SYMBOLS + "+")) > MAX_SYMBOLS_PER_WORD * n
    shouted = F.regexp_count(line, F.lit(SHOUT)) > MAX_SHOUT_PER_WORD * n
    bars = F.regexp_count(line, F.lit(BARS)) + F.when(line.contains(LEFT), F.lit(0)).otherwise(F.regexp_count(line, F.lit(RIGHT)))
    navigation = F.when(line.rlike(NAVIGATION), (bars >= MIN_BARS) & (n <= MAX_ENTRY_WORDS * (bars + 1))).otherwise(F.lit(False))
    return ((n >= MIN_LINE_WORDS) & (decorated | shouted)) | navigation | _boilerplate(line, n)


def _may_fail(text: Column) -> Column:
    """False only where no line of the text can fail: it has none of what the rules look for."""
    return text.rlike(SYMBOLS + "|" + SHOUT + "|" + NAVIGATION) | _may_hold_phrase(text)


def quality(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, lost_share (words in failing lines) and kept to the input
    rows. A null text has no words and fails; repeated rows are judged alike;
    a null in another column changes nothing; an empty table gives no rows.
    Columns of the same names are replaced."""
    lines = F.split(_text(), "\n", -1)
    tokens = let(words(_text()), lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("repeated")))

    def judged(rows: Column) -> Column:
        worded = F.filter(rows, lambda x: x.rlike(WORD))
        lost = F.aggregate(F.filter(rows, line_fails), F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(WORD)))
        return F.struct((F.size(worded) - F.size(F.array_distinct(worded))).alias("dup"),
                        F.when(_may_fail(_text()), lost).otherwise(F.lit(0)).alias("lost"))

    out = docs.select("*", tokens.alias("_t"), let(lines, judged).alias("_l"))
    out = (out.withColumn("n_words", F.col("_t.n").cast("bigint"))
           .withColumn("word_chars", F.col("_t.chars").cast("bigint"))
           .withColumn("n_symbols", F.regexp_count(_text(), F.lit(SYMBOLS)).cast("bigint"))
           .withColumn("n_dup_lines", F.col("_l.dup").cast("bigint"))
           .withColumn("n_repeat_words", F.col("_t.repeated").cast("bigint"))
           .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
           .withColumn("lost_share", F.when(F.col("n_words") > 0, F.col("_l.lost") / F.col("n_words")).otherwise(F.lit(0.0)))
           .withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= MAX_LOST)))
    return out.drop("_t", "_l")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that quality() keeps, with their own columns and without
    their failing lines; n_chars follows the text. A text with no failing line
    comes out as it was."""
    rows = quality(docs.select(F.struct(*docs.columns).alias("_row"), "text")).filter("kept")
    left = F.array_join(F.filter(F.split(_text(), "\n", -1), lambda x: ~line_fails(x)), "\n")
    rows = rows.select("_row", F.when(_may_fail(_text()), left).otherwise(_text()).alias("text"))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[own.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(CASE WHEN step IS NULL OR step > 8 THEN 8 ELSE step END) AS n FROM twice GROUP BY doc_id
), judged AS (
  SELECT doc_id, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(line, '[#*$%&|<>]+')) AS symbols,
         len(regexp_extract_all(line, '[!?]{2,}')) AS shouts,
         len(regexp_extract_all(line, '[|›]')) + CASE WHEN contains(line, '«') THEN 0 ELSE len(regexp_extract_all(line, '»')) END AS bars,
         -- what is no letter or digit stands twice, so that neighbouring phrases need not share it
         2 * len(regexp_extract_all(twice, '(?:^|[^\p{L}\p{N}])(?:privacy  policy|accept  cookies|enable  javascript|lorem  ipsum|click  here|read  more|subscribe  to)(?:[^\p{L}\p{N}]|$)'))
         + 3 * len(regexp_extract_all(twice, '(?:^|[^\p{L}\p{N}])(?:all  rights  reserved|terms  of  use|terms  of  service|use  of  cookies|back  to  top)(?:[^\p{L}\p{N}]|$)')) AS phrase_words
  FROM (SELECT doc_id, line, regexp_replace(lower(line), '([^\p{L}\p{N}])', '\1\1', 'g') AS twice FROM (SELECT doc_id, unnest(lines) AS line FROM t))
), lost AS (
  SELECT doc_id, sum(n) AS n FROM judged
  WHERE (n >= 3 AND (symbols > 0.25 * n OR shouts > 0.5 * n)) OR (bars >= 2 AND n <= 4 * (bars + 1)) OR (phrase_words >= 1 AND phrase_words >= 0.3 * n)
  GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines
  FROM t
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * coalesce(c.n, 0) > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * coalesce(c.n, 0) > 30 * n_words) AND coalesce(l.n, 0) <= 0.5 * n_words AS kept
FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id LEFT JOIN lost l ON b.doc_id = l.doc_id
"""
