"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent, w ~ p ** a: 1 keeps
the shares, 0 makes all sources equal. The exponent is bisected until the
entropy of w meets a target, or as far down as no source repeats more often
than a limit. A budget of tokens times w gives each source's tokens, which
are then taken from a permutation of the source's blocks, epoch by epoch, each
epoch with a permutation of its own. A block's start within its source's
stream, divided by the tokens of the stream, is its place in the mix: read in
that order, every prefix holds the sources by their weights.

Scale: a block is one of 4096 cells of a source, by a hash of doc_id. The
source that holds a third of all rows is summed on the map side and then is
4096 rows; documents meet the schedule by (source, cell), never by source
alone. The driver gets 255 rows of sums for each eight halvings of the interval.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterspark.llm.common import WORD, cut, read

LEVELS = 8          # halvings for each pass over the sources
PASSES = 5
DIGITS = 9          # of the exponent


def _cell() -> Column:
    """One of 4096 cells, named by three hexadecimal digits."""
    return F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 3)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_source", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("_cell", _cell())


def cells(docs: DataFrame) -> DataFrame:
    """_source, _cell, tokens of the blocks; words count as tokens."""
    n = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD))
    return _keyed(docs.select("doc_id", "source", "text")).groupBy("_source", "_cell").agg(F.sum(n).cast("bigint").alias("tokens"))


def exponent(shares: DataFrame, budget_ratio: float, max_repeats: float | None = None, entropy: float | None = None) -> float:
    """The exponent in [0, 1] for the positive shares ``p``.

    With ``entropy`` (in nats, between that of the shares and that of equal
    weights) the one that meets it; with ``max_repeats`` no smaller than the
    least one at which no source is read more than ``max_repeats`` times when
    the budget is ``budget_ratio`` times all tokens."""
    least, n = shares.agg(F.min("p"), F.count("*")).first()
    if not n:
        return 1.0
    if max_repeats is not None and budget_ratio > max_repeats * (1 + 1e-9):
        raise ValueError("the budget needs more repeats than max_repeats even with the shares as they are")

    def least_with(holds) -> float:
        low, high, parts = 0.0, 1.0, 2**LEVELS
        for _ in range(PASSES):
            point = F.lit(low) + F.lit(high - low) * F.col("i") / F.lit(float(parts))
            power = F.pow("p", "a")
            sums = (shares.select("p", F.explode(F.sequence(F.lit(1), F.lit(parts - 1))).alias("i")).select("p", "i", point.alias("a"))
                    .groupBy("i", "a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s")).collect())
            fits = min((row["i"] for row in sums if holds(row["a"], row["z"], row["s"])), default=parts)
            low, high = low + (high - low) * (fits - 1) / parts, low + (high - low) * fits / parts
        return high

    repeats = 0.0 if max_repeats is None else least_with(lambda a, z, s: budget_ratio * least ** (a - 1) / z <= max_repeats)
    wanted = 0.0 if entropy is None else least_with(lambda a, z, s: math.log(z) - a * s / z <= entropy)
    return round(max(repeats, wanted), DIGITS)


def schedule(blocks: DataFrame, budget: float | None = None, max_repeats: float | None = 1.25, entropy: float | None = None, seed: str = "mix") -> DataFrame:
    """_source, _cell, copy (the epoch), position (in [0, 1), the block's place
    in the mix) of the blocks to read. Sources without any token have no share."""
    blocks = cut(blocks)
    sources = cut(blocks.groupBy("_source").agg(F.sum("tokens").alias("size")).filter("size > 0"))
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    budget = float(total if budget is None else budget)
    shares = sources.withColumn("p", F.col("size") / F.lit(float(total or 1)))
    a = exponent(shares, budget / (total or 1), max_repeats, entropy)
    z = shares.agg(F.coalesce(F.sum(F.pow("p", F.lit(a))), F.lit(1.0))).first()[0]
    plan = shares.withColumn("want", F.pow("p", F.lit(a)) / F.lit(z) * F.lit(budget))
    epochs = plan.select("_source", "size", "want", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("want") / F.col("size")).cast("int") - 1, F.lit(0)))).alias("copy"))
    placed = blocks.join(epochs, "_source").withColumn("_turn", F.md5(F.concat_ws("|", F.lit(seed), "_source", F.col("copy").cast("string"), "_cell")))
    order = Window.partitionBy("_source", "copy").orderBy("_turn")
    start = F.col("copy") * F.col("size") + F.sum("tokens").over(order) - F.col("tokens")
    placed = placed.withColumn("start", start).filter("start = 0 or start + tokens / 2 <= want")
    return placed.select("_source", "_cell", "copy", F.round(F.col("start") / F.greatest("want", F.lit(1.0)), 9).alias("position"))


def mix(docs: DataFrame, budget: float | None = None, max_repeats: float | None = 1.25, entropy: float | None = None, seed: str = "mix") -> DataFrame:
    """The documents to read, with ``copy`` (0 for the first reading of a
    document) and ``position``; ordering by position gives the mix.

    The budget is in words and by default that of all documents. A null source
    counts as the source '', a null doc_id as one id, a null text has no words.
    Documents without words go with their block; sources without any words are
    left out. Repeated rows share their block, so they come and go together.
    An empty table gives no rows. Columns named copy and position are replaced."""
    docs = docs.drop("copy", "position")
    chosen = schedule(cells(docs), budget, max_repeats, entropy, seed)
    return _keyed(docs).join(chosen, ["_source", "_cell"]).drop("_source", "_cell").select(*docs.columns, "copy", "position")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(read(spark, sf_dir, "documents"), max_repeats=1.25)
    return found.select("doc_id", "source", "copy", "position")


OP7_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(source, '') AS src, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS cell,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n
  FROM documents
), blocks AS (
  SELECT src, cell, sum(n) AS tokens FROM docs GROUP BY src, cell
), sources AS (
  SELECT src, sum(tokens) AS size FROM blocks GROUP BY src HAVING sum(tokens) > 0
), shares AS (
  SELECT src, size, size / (SELECT CAST(sum(size) AS DOUBLE) FROM sources) AS p FROM sources
), lists AS (
  SELECT list(p) AS ps, min(p) AS least FROM shares
), halving AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT i, low, high, (low + high) / 2 AS mid,
               pow(least, (low + high) / 2 - 1) / list_sum(list_transform(ps, lambda x: pow(x, (low + high) / 2))) <= 1.25 AS ok
        FROM halving, lists WHERE i < 40)
), chosen AS (
  SELECT round(high, 9) AS a FROM halving WHERE i = 40
), wants AS (
  SELECT src, size, pow(p, a) / (SELECT sum(pow(p, a)) FROM shares, chosen) * (SELECT sum(size) FROM sources) AS want FROM shares, chosen
), epochs AS (
  SELECT src, size, want, unnest(range(greatest(CAST(ceil(want / size) AS BIGINT), 1))) AS copy FROM wants
), placed AS (
  SELECT b.src, b.cell, b.tokens, e.copy, e.want,
         e.copy * e.size + sum(b.tokens) OVER (PARTITION BY b.src, e.copy ORDER BY md5('mix|' || b.src || '|' || e.copy || '|' || b.cell)) - b.tokens AS start
  FROM blocks b JOIN epochs e ON b.src = e.src
)
SELECT d.doc_id, d.source, CAST(p.copy AS INTEGER) AS copy, round(CAST(p.start AS DOUBLE) / greatest(p.want, 1.0), 9) AS position
FROM docs d JOIN placed p ON d.src = p.src AND d.cell = p.cell
WHERE p.start = 0 OR p.start + p.tokens / 2 <= p.want
"""
