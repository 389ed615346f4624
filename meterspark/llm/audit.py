"""How filters interact: what each removes in every order of application.

A document is reduced to the set of filters that it fails, a bit mask. An order
of n filters is a path through the lattice of their subsets, from the empty set
to the full one; the edge from state s by filter f removes the documents that
fail f and nothing in s, whatever the path. So one table of the n * 2^(n-1)
edges holds every step of every order. Counting the paths that reach a state
(forward) and that leave it (backward) says through how many orders an edge
goes, and the removals of a filter's edges, weighted by that, are its Shapley sum.

Scale: texts never leave their scan; a row goes on as id, part, mask and text
digest. Rows are reduced to one for each (part, mask, label) before the edges are
made, so the edge table has 80 rows for each part at five filters, whatever
the input. Whether a text stands in a smaller doc_id is settled on groups of
equal (digest, part, labels), which copies collapse into in their map tasks.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterspark.llm.common import SPACE, known_id, let, read

MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def lattice_paths(n: int) -> tuple[list[int], list[int]]:
    """For each state, the number of orders' beginnings that reach it and of
    endings that leave it, each by one pass over the lattice."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full - 1, -1, -1):
        leave[state] = sum(leave[state | 1 << f] for f in range(n) if not state >> f & 1)
    return reach, leave


def lattice_edges(cells: DataFrame, n: int) -> DataFrame:
    """part, state, filter, the measures, and paths: in how many orders the
    edge lies. cells: part, mask, n, good, toxic (numbers of documents)."""
    reach, leave = lattice_paths(n)
    at = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("state"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("filter"))
    bit = F.expr("shiftleft(1, filter)")
    at = at.filter(F.col("state").bitwiseAND(bit) == 0)
    fails, before = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("state")) != 0

    def total(column, when):
        return F.sum(F.when(when, F.col(column)).otherwise(F.lit(0)))
    edges = at.groupBy("part", "state", "filter").agg(
        total("n", ~fails & ~before).alias("kept"), total("n", fails & ~before).alias("removed"), total("n", fails & before).alias("redundant"),
        total("n", F.col("mask") == bit).alias("unique_fails"), total("good", fails & ~before).alias("good_lost"), total("toxic", fails & ~before).alias("toxic_lost"))
    table = F.array(*[F.lit(x) for x in reach]), F.array(*[F.lit(x) for x in leave])
    paths = F.get(table[0], F.col("state")) * F.get(table[1], F.col("state").bitwiseOR(bit))
    return edges.withColumn("paths", paths.cast("bigint"))


def with_shapley(edges: DataFrame) -> DataFrame:
    """The edges with shapley: their filter's removals summed over all orders."""
    return edges.withColumn("shapley", F.sum(F.col("removed") * F.col("paths")).over(Window.partitionBy("part", "filter")))


def order_steps(edges: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step and the measures of each step of each order, read
    from the edges; n! * n rows for each part, so for a handful of filters."""
    spark = edges.sparkSession
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[g] for g in order), step, state, f))
            state |= 1 << f
    orders = spark.createDataFrame(rows, "filter_order string, step int, state int, filter int")
    steps = with_shapley(edges).join(F.broadcast(orders), ["state", "filter"])             # n! * n rows, whatever the input
    return steps.select("part", "filter_order", "step", *MEASURES, "shapley")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic (0 or 1). Ids meet as (is null, id or a hash
    of the text), so that rows without an id neither match nor gather in one task."""
    def flag(column):
        return F.max((F.col(column) == 1).cast("int")).alias("good" if column == "quality" else column)
    known = (labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(flag("quality"), flag("toxic"))
             .select(F.lit(False).alias("no_id"), F.col("id").alias("at"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    return rows.join(known, ["no_id", "at"], "left").fillna(0, ["good", "toxic"])


def failure_cells(docs: DataFrame, labels: DataFrame, fails: list[Column], part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic. Bit i of mask is set where ``fails[i]`` (a
    condition on ``text``) holds, and the bit after the last one where a smaller
    doc_id has the same text, in any part.

    A null text counts as empty, a null part as the empty string, a null doc_id as the least; rows that
    repeat a doc_id are no smaller than each other. Of repeated labels any
    counts. Empty tables give no rows. Other columns are ignored."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    flat = docs.select(known_id().alias("id"), docs["doc_id"].isNull().alias("no_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)) for i, cond in enumerate(fails)), F.lit(0))
    rows = flat.select("id", "no_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = rows.withColumn("at", F.when(F.col("no_id"), F.xxhash64("digest", "part")).otherwise(F.col("id")))
    rows = rows.groupBy("id", "no_id", "at", "part", "mask", "digest").agg(F.count("*").alias("n"))
    rows = _labelled(rows, labels)
    # mask and labels follow from the text and the id, so within a group an id has one row, and min_by is its number of rows
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"))
    least = F.min("first").over(Window.partitionBy("digest"))                              # at most 4 rows for each part
    groups = groups.withColumn("least", least).withColumn("new", F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(F.lit(0)))
    split = groups.select("part", "mask", "good", "toxic", F.explode(F.array(
        F.struct(F.col("new").alias("n"), F.lit(0).alias("copy")), F.struct((F.col("n") - F.col("new")).alias("n"), F.lit(1 << len(fails)).alias("copy")))).alias("own"))
    return (split.filter("own.n > 0").groupBy("part", (F.col("mask") + F.col("own.copy")).alias("mask"))
            .agg(F.sum("own.n").alias("n"), F.sum(F.col("own.n") * F.col("good")).alias("good"), F.sum(F.col("own.n") * F.col("toxic")).alias("toxic")))


def length_share_case_symbol() -> list[Column]:
    """Under 100 words; fewer than 80 % of the words distinct; more than 10 %
    of the characters in A-Z; a symbol of ``#$%&*|``."""
    text = F.col("text")
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    counted = let(words, lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("kinds")))
    return [let(counted, lambda c: c["words"] < 100), let(counted, lambda c: 100 * c["kinds"] < 80 * c["words"]),
            100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), text.rlike("[#$%&*|]")]


def filter_audit(docs: DataFrame, labels: DataFrame, fails: list[Column], names: str, part: str = "lang") -> DataFrame:
    """part, filter_order, step, the measures and shapley, for every order of
    the filters ``names`` (a letter each, the duplicate filter last)."""
    return order_steps(lattice_edges(failure_cells(docs, labels, fails, part), len(names)), names)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), length_share_case_symbol(), "ABCDE")


#: Every order is applied step by step: a document goes at the first letter of the order that it fails.
OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws, min(coalesce(doc_id, -9223372036854775808)) OVER (PARTITION BY body) AS first_id FROM texts),
failing AS (
  SELECT w.part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS bad,
         concat(CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END,
                CASE WHEN 100 * len(regexp_extract_all(body, '[A-Z]')) > 10 * length(body) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN coalesce(w.doc_id, -9223372036854775808) > first_id THEN 'E' ELSE '' END) AS f
  FROM w LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = w.doc_id),
kinds AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS t FROM failing GROUP BY part, f),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
applied AS (
  SELECT part, o, f, n, g, t, coalesce(list_min(list_transform(string_split(f, ''), lambda y: CASE WHEN y = '' THEN 6 ELSE strpos(o, y) END)), 6) AS gone
  FROM kinds, orders),
steps AS (SELECT a.*, s.step, o[s.step] AS x FROM applied a, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
told AS (
  SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, x,
         CAST(coalesce(sum(n) FILTER (gone > step), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (gone = step), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone < step AND contains(f, x)), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (f = x), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(g) FILTER (gone = step), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(t) FILTER (gone = step), 0) AS BIGINT) AS toxic_lost
  FROM steps GROUP BY part, o, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM told
"""
