"""Line dedup across documents, without moving lines or texts through the shuffle.

Each document's lines become 128-bit hashes of their keys. The hash space is
cut into equal ranges (hashes are uniform, so no sampling pass is needed) and
the rows of a range meet in one partition, sorted by hash, then by document
(largest first) and position. Reading a sorted partition in order, the first row
of each document in a run of equal hashes is an occurrence of the key.

Scale: a line that stands in a third of all documents would fill one range,
so documents are dealt over ``SALTS`` parts of each range. Each part streams on
its own and gives a key's number of documents and largest document; the at
most ``SALTS`` such rows of a key meet in a second step, and the verdict goes
back to each part. What goes back to a document is the list of its dropped
runs of lines, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterspark.llm.common import SPACE_CHARS, known_id, let, lower_ascii, read

RANGE_BITS = 14
SALTS = 32


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE_CHARS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _version(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, version, pos, h1, h2: the lines whose key is long enough."""
    rows = docs.select(known_id().alias("doc"), _version(docs["text"]).alias("version"), F.posexplode(_lines(docs["text"])).alias("pos", "line"))
    rows = rows.filter(F.octet_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return rows.select("doc", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc, version, pos of every line to drop."""
    space = F.shiftrightunsigned("h1", 64 - RANGE_BITS).alias("range")
    rows = line_rows(docs, min_chars).select("*", space, F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt"))
    rows = rows.repartition("range", "salt").sortWithinPartitions("range", "salt", "h1", "h2", F.desc("doc"), "pos")
    run = Window.partitionBy("range", "salt", "h1", "h2").orderBy(F.desc("doc"), "pos")
    first = (~F.lag("doc").over(run).eqNullSafe(F.col("doc"))).cast("int")   # the first line of its document in the run
    part = ["range", "salt", "h1", "h2"]
    found = rows.withColumn("first", first).groupBy(part).agg(F.sum("first").alias("n"), F.max("doc").alias("last"))
    key = Window.partitionBy("h1", "h2")                                      # at most SALTS rows
    keys = (found.withColumn("n_docs", F.sum("n").over(key)).withColumn("keeper", F.max("last").over(key))
            .filter(F.col("n_docs") >= min_docs).select(*part, "keeper"))
    return rows.join(keys, part).filter("doc < keeper").select("doc", "version", "pos")


def _runs(positions: Column) -> Column:
    """Sorted positions as runs (first, last)."""
    starts = F.sort_array(F.array_except(positions, F.transform(positions, lambda p: p + 1)))
    ends = F.sort_array(F.array_except(positions, F.transform(positions, lambda p: p - 1)))
    return F.arrays_zip(starts.alias("first"), ends.alias("last"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc, version, dropped: a document's keep bitmap as the runs of its
    dropped lines, each with its first and last position. Documents that
    lose nothing have no row."""
    lost = dropped_lines(docs, min_chars, min_docs).groupBy("doc", "version").agg(F.collect_set("pos").alias("pos"))
    return lost.select("doc", "version", _runs(F.col("pos")).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``text`` reduced to its kept lines, and
    _n_lines, _n_dropped, _dropped."""
    keyed = docs.withColumn("_doc", known_id()).withColumn("_version", _version(docs["text"]))
    marks = bitmaps.select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), F.col("dropped").alias("_dropped"))
    out = keyed.join(marks, ["_doc", "_version"], "left").withColumn("_n_lines", F.size(_lines(F.col("text"))).cast("bigint"))
    gone = F.flatten(F.transform("_dropped", lambda r: F.sequence(r["first"], r["last"])))
    left = F.array_except(F.sequence(F.lit(0), (F.col("_n_lines") - 1).cast("int")), gone)
    shorter = let(_lines(F.col("text")), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = out.withColumn("_n_dropped", F.when(F.col("_dropped").isNull(), F.lit(0)).otherwise(F.size(gone)).cast("bigint"))
    return out.withColumn("text", F.when(F.col("_dropped").isNull(), whole).otherwise(shorter)).drop("_doc", "_version")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents without the lines that others repeat.

    A line's key is the line without white space at its ends and with A-Z in
    lower case. A key of at least ``min_chars`` code points found in at least
    ``min_docs`` documents loses its lines everywhere but in the largest
    doc_id that holds it, which keeps them all. A null text is one empty line;
    a null doc_id counts as the least id; rows that repeat a doc_id count as
    one document. Rows repeated in the input come out as often, extra columns
    stay, an empty table gives no rows. n_chars follows the text."""
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs)).drop("_n_lines", "_n_dropped", "_dropped")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_chars=20, min_docs=3))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
