"""Alignment of two tokenizers over the same bytes.

Both token sequences of a text are turned into lists of the byte offsets at
which tokens end. The shorter list drives: its values, in order, gallop through
the longer one (steps of 1, 2, 4, ... from where the last value was found, then a
binary search between the last two probes). Values found in both lists cut the
sequences into groups that cover the same bytes. For any two neighbouring
values, the difference of their ranks in the longer list is the range of
its tokens that overlap the token between them.

Scale: texts are read and encoded once, in parts, and never shuffled. What
stays of them is a table of blocks in the shared folder: some documents with their
links as numbers into the block's own list of distinct id pairs. Only that
list meets the corpus counts, and comes back to the block. A pair that stands in
every document has one row for each block. The highest count of each B id has a
row for each id of the vocabulary at most, and is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.llm.common import read, rows_of, scratch
from meterspark.llm.tokens import GAP, PieceCounter

LANE = 64                   # values that one lane of the galloping search walks in order
PART_CHARS = 200_000        # characters from which a text is encoded in parts
BLOCK_LINKS = 500_000       # links after which a block is closed, with the texts encoded at once; a longer text is a block of its own
ROWS = 64                   # documents encoded at once
WIDE = 1 << 32              # a pair is A's id * WIDE + B's id


def seek(long: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each x the first index from ``start`` on whose value in ``long`` is
    not less (len(long) if none), where all values before ``start`` are."""
    n = len(long)
    low, high, width = start.copy(), start.copy(), np.ones(len(x), np.int64)
    going = np.flatnonzero(high < n)
    while len(going):                                       # exponential
        going = going[long[high[going]] < x[going]]
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + width[going], n)
        width[going] *= 2
        going = going[high[going] < n]
    going = np.flatnonzero(low < high)
    while len(going):                                       # binary
        middle = (low[going] + high[going]) // 2
        less = long[middle] < x[going]
        low[going[less]] = middle[less] + 1
        high[going[~less]] = middle[~less]
        going = going[low[going] < high[going]]
    return low


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The rank of each value of ``short`` in ``long`` (both strictly rising):
    the number of its values that are less. ``short`` is dealt into lanes of
    neighbouring values, which walk at the same time."""
    ranks = np.zeros(len(short), np.int64)
    first = np.arange(0, len(short), LANE)
    stand = np.zeros(len(first), np.int64)
    for step in range(min(LANE, len(short))):
        at = first + step
        at = at[at < len(short)]
        stand = seek(long, short[at], stand[:len(at)])
        ranks[at] = stand
    return ranks


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b of the links; number of A and of B tokens up to each common end).

    A link is a token of A and one of B that share a byte. Token ends rise
    strictly and both lists end with the same value, or are empty."""
    swap = len(b_ends) < len(a_ends)
    short, long = (b_ends, a_ends) if swap else (a_ends, b_ends)
    if not len(short):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    rank = gallop(short, long)
    common = long[rank] == short
    after = np.concatenate([[0], (rank + common)[:-1]])     # the first token of the longer list that goes on after the value before
    n = rank - after + 1
    own = np.repeat(np.arange(len(short)), n)
    other = np.repeat(after - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    cuts = np.flatnonzero(common) + 1, rank[common] + 1
    return (other, own, cuts[1], cuts[0]) if swap else (own, other, cuts[0], cuts[1])


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable
    Latin-1 as itself, the other bytes in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_ranks(spec: dict) -> dict[bytes, int] | None:
    """The tokenizer's vocabulary as {bytes: rank}, if its file says that it is
    byte-level BPE whose merges come in the order of their ids, with nothing
    else before or after: then another library's ranks give the same tokens."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    letters, vocab = byte_letters(), model.get("vocab", {})
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    usual = (model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")))
    if not usual or any(vocab.get("".join(m)) != 256 + i for i, m in enumerate(merges)) or sorted(vocab.get(c, -1) for c in letters) != list(range(256)):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}


#: How a byte-level tokenizer of this kind splits a text (fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these characters the libraries' tables of letters may differ by their version.
RARE = re.compile("[^\x00-\u024f\u2010-\u2027]")


class Pair:
    """Both tokenizers, with the bytes and the written form of each id."""

    def __init__(self, a_file: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        ranks = plain_ranks(json.loads(a_file))
        self.quick = ranks and tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.divisible = PieceCounter(b_model).divisible
        letters = byte_letters()
        self.a_bytes = [bytes(letters.get(c, 63) for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.IsByte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.IdToPiece, range(self.b.GetPieceSize())))]
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [f"{i}{mark}" for i in range(most) for mark in ",|;"]

    def parts(self, text: str) -> list[str]:
        """Both tokenizers give a whole text's tokens part by part where a
        single space between two other characters is left out at the cut: A
        begins a token with it, and B puts it there itself."""
        if len(text) <= PART_CHARS or not self.divisible:
            return [text]
        out, start = [], 0
        while start < len(text):
            gap = GAP.search(text, start + PART_CHARS)
            end = gap.start() if gap else len(text)
            out.append(text[start:end])
            start = end + 1
        return out

    def a_ids(self, text: str) -> list[int]:
        if self.quick and not RARE.search(text):
            return self.quick.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """A's and B's ids of each text; none where a text is empty or the
        bytes of either differ from a space and the text."""
        out = []
        for text in texts:
            own_a, own_b = [], []
            for part in self.parts(text) if text else []:
                a, b, want = self.a_ids(" " + part), self.b.encode(part), (" " + part).encode()
                if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
                    own_a, own_b = [], []
                    break
                own_a += a
                own_b += b
            out.append((own_a, own_b))
        return out

    def align_texts(self, texts: list[str]) -> tuple[list[tuple], np.ndarray]:
        """(n_a, n_b, n_groups, groups, n_links) of each text, and the pairs of
        all links in order. The texts' tokens make up one sequence: both lists
        of ends have every text's end, so nothing crosses from one to the next."""
        ids = self.encode(texts)
        n_a, n_b = (np.array([len(own[side]) for own in ids], np.int64) for side in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(own[side] for own in ids), np.int64, n.sum()) for side, n in ((0, n_a), (1, n_b)))
        own_a, own_b, a_cuts, b_cuts = align(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        text_of = np.repeat(np.arange(len(texts)), n_a)         # by A's tokens
        n_groups = np.bincount(text_of[a_cuts - 1], minlength=len(texts))
        n_links = np.bincount(text_of[own_a], minlength=len(texts))
        names, ends, start, told = self.group_names(a, b, a_cuts, b_cuts), np.cumsum(n_a + n_b).tolist(), 0, []
        for end in ends:
            told.append("".join(names[start:end])[:-1])
            start = end
        return list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), told, n_links.tolist())), a[own_a] * WIDE + b[own_b]

    def group_names(self, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> list[str]:
        """``a1,`` ``a2|`` ``b1;`` ``a3|`` ...: the ids of each group, A's before B's."""
        out = np.empty(len(a) + len(b), np.int64)
        a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_mark[a_cuts - 1], b_mark[b_cuts - 1] = 1, 2
        group_a = np.repeat(np.arange(len(a_cuts)), np.diff(a_cuts, prepend=0))
        group_b = np.repeat(np.arange(len(b_cuts)), np.diff(b_cuts, prepend=0))
        out[np.arange(len(a)) + np.concatenate([[0], b_cuts])[group_a]] = a * 3 + a_mark
        out[np.arange(len(b)) + a_cuts[group_b]] = b * 3 + b_mark
        return list(map(self.names.__getitem__, out.tolist()))


DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("n_links", pa.int64())]
BLOCK_SCHEMA = ("block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, groups_sha256 array<string>, n_links array<bigint>, "
                "links binary, pair array<bigint>, n array<bigint>")


def _number_type(pairs: int) -> type:
    return np.uint16 if pairs <= 1 << 16 else np.uint32


def _block(number: int, docs: list[tuple], links: list[np.ndarray]) -> pa.RecordBatch:
    """A block's row. Its pairs come by falling frequency, so that most links are small numbers, which are stored deflated."""
    at, pairs = pd.factorize(np.concatenate(links))
    n = np.bincount(at, minlength=len(pairs))
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(order), _number_type(len(order)))
    place[order] = np.arange(len(order))
    columns = [pa.array([list(c)], pa.list_(t)) for c, (_, t) in zip(zip(*docs), DOC)]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (pairs[order], n[order].astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns, pa.array([zlib.compress(place[at].tobytes(), 1)], pa.binary()), *lists],
                                      ["block", *(name for name, _ in DOC), "links", "pair", "n"])


def _align_batches(files, batches):
    pair = Pair(*files.value)
    number, docs, links, total = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for part in rows_of(batch, ROWS):
            told, found = pair.align_texts([t or "" for t in part.column(1).to_pylist()])
            for doc_id, (n_a, n_b, n_groups, groups, n_links) in zip(part.column(0).to_pylist(), told):
                docs.append((doc_id, n_a, n_b, n_groups, hashlib.sha256(groups.encode()).hexdigest() if groups else "", n_links))
            links.append(found)
            total += len(found)
            if total >= BLOCK_LINKS:
                yield _block(number, docs, links)
                number, docs, links, total = number + 1, [], [], 0
    if docs:
        yield _block(number, docs, links)


def align_blocks(docs: DataFrame, a_path: str, b_path: str, path: str) -> DataFrame:
    """Encode and align the texts; the blocks, written to ``path`` and read again."""
    spark = docs.sparkSession
    files = []
    for name in (a_path, b_path):       # a few MB from the tokenizers' package on the driver
        with open(name, "rb") as f:
            files.append(f.read())
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows.mapInArrow(partial(_align_batches, spark.sparkContext.broadcast(tuple(files))), BLOCK_SCHEMA).write.parquet(path)
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count, best: how many links of the corpus hold an id pair, and
    whether that is the highest count of its B id (ties included)."""
    counts = blocks.select(F.explode(F.arrays_zip("pair", "n")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.n").alias("count"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(WIDE - 1)))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))     # top: a row per id of B


def _digest_batches(batches):
    """Each document's sums over its links, from its block and the block's pairs."""
    for batch in batches:
        for row in rows_of(batch, 1):
            names = [name for name, _ in DOC]
            columns = [row.column(i).flatten() for i in range(len(names))]
            known = [row.column(len(names) + i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2)]
            links = np.frombuffer(zlib.decompress(row.column(len(names))[0].as_py()), _number_type(len(known[0])))
            ends = np.cumsum(columns[-1].to_numpy())
            starts = ends - columns[-1].to_numpy()
            sums = []
            for values in known:
                run = np.concatenate([[0], np.cumsum(values.astype(np.int64)[links])])
                sums.append(pa.array(run[ends] - run[starts]))
            yield pa.RecordBatch.from_arrays([*columns, sums[1], sums[0]], [*names, "n_best", "count_sum"])


def align_tokens(docs: DataFrame, a_path: str, b_path: str, path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum for
    each input row; the groups and links themselves are in the blocks at ``path``.

    Null and empty texts, and texts that either tokenizer does not give back
    byte for byte, have no tokens: zeros and ''. Repeated rows and null doc_ids
    come out as they came in, an empty table gives no rows. Other columns are ignored."""
    blocks = align_blocks(docs, a_path, b_path, path)
    own = blocks.select("block", F.posexplode("pair").alias("place", "pair"))
    told = (own.join(pair_counts(blocks), "pair").groupBy("block")
            .agg(F.array_sort(F.collect_list(F.struct("place", "count", F.col("best").cast("tinyint").alias("best")))).alias("known")))
    names = [name for name, _ in DOC]
    rows = blocks.select("block", *names, "links").join(told, "block", "left")
    none = F.array().cast("array<bigint>")
    rows = rows.select(*names, "links", F.coalesce(F.col("known.count"), none).alias("count"), F.coalesce(F.col("known.best").cast("array<bigint>"), none).alias("best"))
    return rows.mapInArrow(_digest_batches, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_links bigint, n_best bigint, count_sum bigint")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return align_tokens(read(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"), scratch(spark, "alignment"))
