"""Token counts with a cache keyed by digests.

The cache is a Parquet table of (version, digest, n_tokens) in a shared
folder: version is the digest of the tokenizer's file, digest that of a text's
UTF-8 bytes (null counts as empty; the tokenizer's own normalisation is the
identity, so nothing more may be folded together). Texts whose digest the cache
lacks are reduced to one each, encoded, and appended.

Scale: copies are reduced to one within each map task before the shuffle, so a
text that makes up a third of all rows crosses it once for each task. Only
digests meet the cache; the join back to the documents carries no texts.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.llm.common import read, rows_of, scratch

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"
#: Characters from which a text is encoded in parts.
PART_CHARS = 1_000_000
#: A single space between two other characters.
GAP = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


class PieceCounter:
    """Counts pieces as the library's ``encode`` of the whole text does.

    Texts above ``PART_CHARS`` are encoded in parts, which bounds the memory
    of a worker. That is exact where the tokenizer leaves the text as it is and
    no piece holds the space mark after another character: no merge can then
    cross a single space between two other characters, and a part cut there
    gets its mark from the library's own prefix. With any other tokenizer, or
    where a text has no such place, it is encoded whole."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm = spec.normalizer_spec
        self.divisible = (norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
                          and spec.trainer_spec.model_type == 2 and not spec.trainer_spec.treat_whitespace_as_suffix
                          and not any(re.search("[^▁]▁", p.piece) or p.type == 4 for p in spec.pieces))

    def count(self, text: str, part_chars: int = PART_CHARS) -> int:
        if len(text) <= part_chars or not self.divisible:
            return len(self.sp.encode(text))
        total, start = 0, 0
        while start < len(text):
            gap = GAP.search(text, start + part_chars)
            end = gap.start() if gap else len(text)
            total += len(self.sp.encode(text[start:end]))
            start = end + 1
        return total


def _encode(model, version: str):
    def run(batches):
        counter = PieceCounter(model.value)
        for batch in batches:
            for part in rows_of(batch, 256):
                counts = [counter.count(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([version] * part.num_rows, pa.string()), part.column(0), pa.array(counts, pa.int64())], ["version", "digest", "n_tokens"])
    return run


def tokenizer_version(model: bytes) -> str:
    return hashlib.sha256(model).hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens; one row per digest even where two runs appended it."""
    return (spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def open_cache(spark: SparkSession, cache: str) -> None:
    """Make the cache table, empty, where there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)


def fill_cache(docs: DataFrame, cache: str, model_path: str) -> str:
    """Encode the distinct texts whose digest is not in the cache and append
    their counts; returns the tokenizer's version."""
    spark = docs.sparkSession
    with open(model_path, "rb") as f:      # a few hundred kB from the tokenizer's package on the driver
        model = f.read()
    version = tokenizer_version(model)
    open_cache(spark, cache)
    texts = _digests(docs).select("digest", "body").dropDuplicates(["digest"])
    misses = texts.join(read_cache(spark, cache, version).select("digest"), "digest", "left_anti").select("digest", "body")
    misses.mapInArrow(_encode(spark.sparkContext.broadcast(model), version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    return version


def _digests(docs: DataFrame) -> DataFrame:
    body = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("digest"))


def count_tokens(docs: DataFrame, cache: str, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each input row.

    A null text counts as empty and has no tokens. Repeated rows and null
    doc_ids come out as they came in. An empty table gives no rows. Other
    columns are ignored."""
    version = fill_cache(docs, cache, model_path)
    rows = _digests(docs).select("doc_id", F.octet_length("body").cast("bigint").alias("n_bytes"), "digest")
    found = rows.join(read_cache(docs.sparkSession, cache, version), "digest")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), scratch(spark, "token-counts"), public_tokenizers.path("piece_bpe_32k.model"))
