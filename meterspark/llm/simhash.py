"""SimHash near-duplicates through an inverted index of fingerprint bytes.

A fingerprint has 8 positional bytes. Two fingerprints that differ in at most
``max_bits`` bits differ in at most as many bytes, so they share at least
``8 - max_bits`` of them. The index posts every distinct fingerprint under
small sets of its positional bytes, chosen such that each group of that many
shared bytes holds one of the sets whole (20 sets of 3 bytes for 4 bits).
Within a posting list the shared bytes of each pair are tallied, pairs below
the guaranteed minimum are put aside, and the rest are verified by their
differing bits. Only a spanning forest of the links of a list leaves its task.

Scale: copies collapse to one fingerprint before anything is compared. A
posting list above ``LIST_ROWS`` is cut into blocks, and each pair of blocks is
a task of its own, so no list has to fit in one task and no pair is lost.
Components come from alternating large and small stars over the links, with
a checkpoint after each round.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterspark.llm.common import cut, known_id, rows_of

SEED = 42
LIST_ROWS = 8192
#: The 8 bits of a byte, each in a byte of its own; up to 255 of these add up without a carry.
SPREAD = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], np.uint64)


def fingerprint(raw: bytes, shingle: int) -> int:
    """SimHash of a UTF-8 text; 0 where it has no words."""
    words = raw.lower().split()          # ASCII letters and ASCII white space alone
    if not words:
        return 0
    text = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(text)]))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[len(words) - n:]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        spans = zip(starts[at:at + 65536].tolist(), ends[at:at + 65536].tolist())
        hashes = np.frombuffer(b"".join([digest(text[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)[:, ::-1]
        lanes = np.add.reduceat(SPREAD[hashes], np.arange(0, len(hashes), 255), axis=0)
        counts += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle: int, batches):
    for batch in batches:
        for part in rows_of(batch):
            raws = part.column(2).cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(r or b"", shingle) for r in raws], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints)], ["doc_id", "version", "fp"])


def _version(docs: DataFrame) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """One row per input row: doc_id, version (a hash of the text), fp (the 64
    bits as a signed integer). A null, empty or blank text has fingerprint
    zero; fewer words than ``shingle`` make one shingle."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), _version(docs).alias("version"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprint_batches, shingle), "doc_id bigint, version bigint, fp bigint")


def byte_sets(max_bits: int, size: int = 3) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any ``8 - max_bits`` positions hold one of them."""
    shared = 8 - max_bits
    if shared < 1:
        raise ValueError("at most 7 differing bits leave a byte that is shared for certain")
    size = min(size, shared)
    if (shared, size) == (4, 3):         # the least such family has 20 sets (Turan's construction)
        group = [0, 0, 0, 1, 1, 1, 2, 2]
        cycle = ({0: 3}, {1: 3}, {2: 3}, {0: 2, 1: 1}, {1: 2, 2: 1}, {2: 2, 0: 1})
        counted = lambda s: {g: sum(group[i] == g for i in s) for g in {group[i] for i in s}}
        return [s for s in combinations(range(8), 3) if counted(s) in cycle]
    left, chosen = set(combinations(range(8), shared)), []
    while left:
        best = max(combinations(range(8), size), key=lambda s: sum(set(s) <= set(x) for x in left))
        chosen.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return chosen


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * i) for i in positions)
    return value - 2**64 if value >= 2**63 else value


def spanning_links(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect the same fingerprints as all links of at most
    ``max_bits`` bits among ``prints`` do.

    Each fingerprint that no earlier one reaches is compared with the whole
    list. Two groups that are still apart can then only meet through a member
    of the smaller ones, so all of those are compared with the list as well."""
    prints = np.unique(prints)
    n = len(prints)
    group = np.arange(n)
    links: list[tuple[int, int]] = []
    asked = np.zeros(n, bool)

    def compare(i: int) -> np.ndarray:
        asked[i] = True
        other = prints ^ prints[i]
        shared = (other.view(np.uint8).reshape(n, 8) == 0).sum(axis=1)   # the tally of positional bytes
        near = np.flatnonzero(shared >= 8 - max_bits)
        near = near[np.bitwise_count(other[near]) <= max_bits]
        for g in np.unique(group[near]):
            if g != group[i]:
                j = near[group[near] == g][0]
                links.append((int(prints[i]), int(prints[j])))
                group[group == g] = group[i]
        return near

    reached = np.zeros(n, bool)
    for i in range(n):
        if not reached[i]:
            reached[compare(i)] = True
    names, sizes = np.unique(group, return_counts=True)
    if len(names) > 1:
        for i in np.flatnonzero((group != names[sizes.argmax()]) & ~asked):
            compare(i)
    return links


def _link_batches(max_bits: int, batches):
    for batch in batches:
        left, right = [], []
        for prints in batch.column(0):
            for a, b in spanning_links(prints.values.to_numpy().view(np.uint64), max_bits):
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (left, right)], ["a", "b"])


def links(prints: DataFrame, max_bits: int = 4, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links a, b that span the components of distinct fingerprints ``fp``."""
    posted = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("key"))
                                 for i, s in enumerate(byte_sets(max_bits))]))
    index = prints.select("fp", posted.alias("p")).select("fp", "p.t", "p.key")
    sizes = index.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / list_rows).cast("int")
    rows = index.join(sizes, ["t", "key"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs: Column = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y")))
    lists = (rows.select("t", "key", "fp", F.explode(pairs).alias("b"))
             .groupBy("t", "key", "b.x", "b.y").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1))
    return lists.select("fps").mapInArrow(partial(_link_batches, max_bits), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the
    links a, b, by alternating large and small stars."""
    at = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        now = tuple(at.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == state or not now[0]:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        at = cut(small)


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, version, fp, root, component_id for each input row. root is the
    least fingerprint of the component and names it.

    component_id is the smallest doc_id whose fingerprint is reachable through
    links of at most ``max_bits`` differing bits. Rows repeated in the input
    come out as often. Rows with a null doc_id take part; a component of such
    rows alone has a null component_id. An empty table gives no rows. Other
    columns are ignored."""
    rows = cut(fingerprints(docs, shingle))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(prints.select("fp"), max_bits))
    named = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(roots, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "version", "fp", "root", "component_id")


def representatives(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The documents without their near copies: one row of each component, of
    its smallest doc_id. Where rows of the component repeat that id, and in a
    component without any doc_id, the text with the least hash stays. An id
    whose rows lie in several components may stay once in each."""
    found = near_duplicates(docs, shingle, max_bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    least = found.groupBy("root", "component_id").agg(F.min("version").alias("_text"))
    keep = least.select(known_id("component_id").alias("_id"), "_text")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), known_id().alias("_id"), _version(docs).alias("_text"))
    return rows.join(keep, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).select("_row.*")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    from meterspark.llm.common import read
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
