"""Benchmark decontamination by greedy string tiling.

A test item counts as leaked into a document where tiles, stretches of at
least ``seed`` equal tokens that overlap neither in the item nor in the
document, cover enough of the item. Tiles may come in any order, so passages
that were put together anew are found too.

Tokens are runs of Unicode letters, marks and digits; in scripts written without
spaces (Chinese, Japanese, Thai and so on) each character is one. Everything
else, ASCII or not, separates.

Every stretch of ``seed`` tokens gets a Karp-Rabin hash, in numpy over the characters
of a text: prefix sums give the hash of each word, and a running polynomial
over the words that of each stretch. The hashes of the items fill a bitmap of
a fixed size, which tasks use to leave out stretches that no item holds; what
passes joins the items' stretches by hash. A document and an item then come
together as the places of their shared stretches, never as pairs of places.
Running Karp-Rabin finds the longest unmarked match, which becomes a tile, again and
again: for each match length, from the longest that occurs down to a stretch,
the windows of that length in the item go into a table by rolling hash, and those of
the document are looked up; every hit is compared in full.

Scale: texts never leave the scan, only stretches that (with few exceptions)
some item holds. The join has one row per shared stretch, and a stretch that
a third of all documents share is split by the skew join. A tiling group is
one document and one item, as many places as both have. A token above ``PART``
characters is hashed in pieces. The bitmap is ``2 ** bits`` bits (1 MB) at any
number of items; more items only make it pass more.
"""

from __future__ import annotations

import unicodedata
from collections import deque
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.llm.common import cut, read, rows_of

SEED = 5
COVERAGE = 0.5
BITS = 23
BASE = 0x9E3779B97F4A7C15          # odd, so that it has an inverse modulo 2 ** 64
STEP = 0xD6E8FEB86659FD93
PART = 1 << 18                     # characters hashed at once

#: Characters of scripts written without spaces, by first and last one.
SINGLES = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1980, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x30FF),
           (0x3100, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
           (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFE)]
SEPARATOR, IN_WORD, SINGLE, NOTHING = range(4)


def _kinds() -> np.ndarray:
    """What each character is. Invisible ones inside words (soft hyphens, joiners,
    variation selectors) are nothing; the last entry stands for all higher characters."""
    category = [unicodedata.category(chr(i)) for i in range(0x40000)]
    kinds = np.array([IN_WORD if c[0] in "LNM" else NOTHING if c == "Cf" else SEPARATOR for c in category], np.uint8)
    for first, last in SINGLES:
        own = kinds[first:last + 1]
        own[own == IN_WORD] = SINGLE
    kinds[0x200B] = kinds[-1] = SEPARATOR                # the zero-width space
    kinds[0xFE00:0xFE10] = NOTHING
    return kinds


KINDS = _kinds()
POWERS = np.concatenate(([np.uint64(1)], np.cumprod(np.full(PART, BASE, np.uint64), dtype=np.uint64)))
INVERSES = np.concatenate(([np.uint64(1)], np.cumprod(np.full(PART, pow(BASE, -1, 2**64), np.uint64), dtype=np.uint64)))


def token_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each token of the text, in lower case."""
    low = text.lower()
    out, start = [], 0
    while start < len(low):
        part = np.frombuffer(low[start:start + PART].encode("utf-32-le", "replace"), np.uint32)
        kind = KINDS[np.minimum(part, len(KINDS) - 1)]
        if start + PART < len(low) and kind[-1] in (IN_WORD, NOTHING):      # end between two tokens; one that fills the whole part is cut
            gaps = np.flatnonzero((kind == SEPARATOR) | (kind == SINGLE))
            if len(gaps):
                part, kind = part[:gaps[-1] + 1], kind[:gaps[-1] + 1]
        start += len(part)
        seen = kind != NOTHING
        if not seen.all():
            part, kind = part[seen], kind[seen]
        single, word = kind == SINGLE, np.concatenate(([False], kind == IN_WORD, [False]))
        begins = np.flatnonzero(single | (word[1:-1] & ~word[:-2]))
        ends = np.flatnonzero(single | (word[1:-1] & ~word[2:])) + 1
        sums = np.concatenate(([np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * POWERS[:len(part)], dtype=np.uint64)))
        hashes = (sums[ends] - sums[begins]) * INVERSES[begins]
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(STEP)
        out.append(hashes ^ (hashes >> np.uint64(32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def stretch_hashes(tokens: np.ndarray, seed: int) -> np.ndarray:
    """The hash of each stretch of ``seed`` tokens."""
    n = len(tokens) - seed + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(seed):
        total = total * np.uint64(BASE) + tokens[i:i + n]
    return (total ^ (total >> np.uint64(31))) * np.uint64(STEP)


def _by_hash(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The distinct hashes, and for each the list of its places."""
    order = np.argsort(hashes, kind="stable")
    found, starts = np.unique(hashes[order], return_index=True)
    return found, pa.ListArray.from_arrays(pa.array(np.append(starts, len(places)), pa.int32()), pa.array(places[order], pa.int32()))


def _stretch_batches(batch, keys: int, text_at: int, name: str, seed: int, passes):
    """For each text of a batch a row for each of its stretches that ``passes``:
    the first ``keys`` columns, the text's tokens, the hash and its places."""
    for part in rows_of(batch):
        rows, sizes, hashes, places = [np.zeros(0, np.int64)], [], [np.zeros(0, np.uint64)], [pa.array([], pa.list_(pa.int32()))]
        for row, text in enumerate(part.column(text_at).to_pylist()):
            tokens = token_hashes(text or "")
            found = stretch_hashes(tokens, seed)
            at = np.flatnonzero(passes(found))
            own, lists = _by_hash(found[at], at)
            rows.append(np.full(len(own), row, np.int64))
            sizes += [len(tokens)] * len(own)
            hashes.append(own)
            places.append(lists)
        rows = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays([part.column(i).take(rows) for i in range(keys)] + [pa.array(sizes, pa.int32()), pa.array(np.concatenate(hashes).view(np.int64)), pa.concat_arrays(places)],
                                         [*part.schema.names[:keys], "n_tokens", "h", name])


def _item_batches(seed: int, batches):
    for batch in batches:
        yield from _stretch_batches(batch, 2, 2, "ipos", seed, lambda found: np.ones(len(found), bool))


def _doc_batches(seed: int, bitmap, bits: int, batches):
    table = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).astype(bool)
    for batch in batches:
        for found in _stretch_batches(batch, 2, 2, "dpos", seed, lambda found: table[found >> np.uint64(64 - bits)]):
            yield found.select(["doc_id", "version", "h", "dpos"])


def seed_bitmap(items: DataFrame, bits: int = BITS) -> bytes:
    """The bitmap of the first ``bits`` bits of the hashes ``h``. Bytes are
    put together in tasks; the driver gets at most ``2 ** (bits - 3)`` of them."""
    bit = F.shiftrightunsigned("h", 64 - bits)
    rows = (items.select((bit / 8).cast("int").alias("byte"), F.call_function("shiftleft", F.lit(1), 7 - F.pmod(bit, F.lit(8)).cast("int")).alias("mask"))
            .groupBy("byte").agg(F.bit_or("mask").alias("mask")).collect())
    table = np.zeros(2 ** (bits - 3), np.uint8)
    for row in rows:
        table[row["byte"]] = row["mask"]
    return table.tobytes()


class Side:
    """The shared stretches of one text that lie on no tile yet: their places, ascending, and what they are."""

    def __init__(self, places: np.ndarray, kinds: np.ndarray):
        order = np.argsort(places, kind="stable")
        self.places, self.kinds = places[order], kinds[order]

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where ``n`` stretches follow each other without a gap (indices), and the rolling hash of each such window."""
        at = np.flatnonzero(self.places[n - 1:] - self.places[:len(self.places) - n + 1] == n - 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(self.kinds * self.powers[:len(self.kinds)], dtype=np.uint64)))
        return at, (sums[at + n] - sums[at]) * self.inverses[at]

    @property
    def powers(self):
        return _powers(BASE, len(self.kinds))

    @property
    def inverses(self):
        return _powers(pow(BASE, -1, 2**64), len(self.kinds))

    def without(self, starts: list[int], n_tokens: int, seed: int) -> "Side":
        """The stretches that meet none of the tiles of ``n_tokens`` at ``starts``."""
        starts = np.sort(np.array(starts))
        before = np.searchsorted(starts, self.places + seed) - 1          # the last tile that begins before a stretch ends
        free = (before < 0) | (starts[np.maximum(before, 0)] + n_tokens <= self.places)
        return Side(self.places[free], self.kinds[free])


@lru_cache(maxsize=4)
def _all_powers(base: int, n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)))


def _powers(base: int, n: int) -> np.ndarray:
    return _all_powers(base, 1 << max(10, n.bit_length()))


def _shared(doc: Side, item: Side, n: int):
    """Windows of ``n`` stretches of the document (indices, hashes) whose hash the item has too, and the item's."""
    d, dh = doc.windows(n)
    q, qh = item.windows(n)
    known = np.sort(qh)
    if not len(known):
        return d[:0], dh[:0], q, qh
    hit = known[np.minimum(np.searchsorted(known, dh), len(known) - 1)] == dh
    return d[hit], dh[hit], q, qh


def tiles(doc: Side, item: Side, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, length in tokens). Of equally
    long matches the first in the document goes first, then the first in the item."""
    out, top = [], min(len(doc.places), len(item.places))
    while True:
        low, high = 0, min(top, len(doc.places), len(item.places))         # the longest match: if n stretches match, so do n - 1
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(_shared(doc, item, n)[0]) else (low, n - 1)
        if not low:
            return out
        n, size = low, low + seed - 1
        d, dh, q, qh = _shared(doc, item, n)
        table: dict[int, deque] = {}
        for i, h in zip(q.tolist(), qh.tolist()):
            table.setdefault(h, deque()).append(i)
        starts, ends, free = [], [], 0
        taken = np.zeros(int(item.places[-1]) + seed + 1, bool)
        for i, h in zip(d.tolist(), dh.tolist()):
            place = int(doc.places[i])
            if place < free or h not in table:
                continue
            places = table[h]
            while places and (taken[item.places[places[0]]] or taken[item.places[places[0]] + size - 1]):
                places.popleft()
            if not places:
                del table[h]
                if not table:
                    break
                continue
            j = places[0]
            if np.array_equal(doc.kinds[i:i + n], item.kinds[j:j + n]):
                at = int(item.places[j])
                out.append((place, at, size))
                starts.append(place)
                ends.append(at)
                taken[at:at + size] = True
                free = place + size
        if starts:
            doc, item = doc.without(starts, size, seed), item.without(ends, size, seed)
        top = n - 1


def _places(found: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All places of a pair's shared stretches, and for each the stretch's hash."""
    lists = found.field(name)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(found.field("h").to_numpy().view(np.uint64), sizes)


def _tile_batches(seed: int, batches):
    for batch in batches:
        n_tiles, covered = [], []
        shared = batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            pair = shared[i].values
            found = tiles(Side(*_places(pair, "dpos")), Side(*_places(pair, "ipos")), seed)
            n_tiles.append(len(found))
            covered.append(sum(t[2] for t in found))
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(n_tiles, pa.int32()), pa.array(covered, pa.int32())],
                                         ["doc_id", "version", "item_id", "n_tokens", "n_tiles", "covered"])


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, bits: int = BITS) -> DataFrame:
    """doc_id, version (a hash of the text), item_id, n_tokens (of the item),
    n_tiles, covered (tokens under tiles), coverage: one row for each document
    and item with at least ``coverage``.

    Tokens are in lower case. Items of fewer than ``seed`` tokens, null and
    empty texts have no stretch and never match.
    Repeated rows give one row; rows of one doc_id with different texts are
    told apart; a null doc_id is reported as such, a null item_id too; different
    texts of one item_id give a row each. Empty tables give
    no rows, other columns are ignored. Two different stretches share a 64-bit
    hash about once in 2e19 pairs; one such seed cannot cover half an item
    that is longer than ten tokens."""
    spark = docs.sparkSession
    items = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"].cast("string").alias("text")).distinct()
    items = items.select("item_id", F.xxhash64("text").alias("iversion"), "text")
    items = cut(items.mapInArrow(partial(_item_batches, seed), "item_id bigint, iversion bigint, n_tokens int, h bigint, ipos array<int>"))
    bitmap = spark.sparkContext.broadcast(seed_bitmap(items, bits))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("version"), docs["text"].cast("string").alias("text"))
    found = rows.mapInArrow(partial(_doc_batches, seed, bitmap, bits), "doc_id bigint, version bigint, h bigint, dpos array<int>")
    shared = found.join(items, "h").groupBy("doc_id", "version", "item_id", "n_tokens", "iversion").agg(F.collect_set(F.struct("h", "dpos", "ipos")).alias("shared"))
    tiled = shared.drop("iversion").mapInArrow(partial(_tile_batches, seed), "doc_id bigint, version bigint, item_id bigint, n_tokens int, n_tiles int, covered int")
    return tiled.withColumn("coverage", F.col("covered") / F.col("n_tokens")).filter(F.col("coverage") >= coverage)


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The documents, whole and with their own columns, without those that hold a test item."""
    bad = leaks(docs, benchmark, seed, coverage).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    version = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(F.col("_id")) & (version == F.col("_version")), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tokens", "n_tiles", "covered", F.round("coverage", 6).alias("coverage"))
