"""Near-duplicates by 64-bit SimHash, found through Golay-code fuzzy hashing.

A fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code
of length 23 is perfect: every segment lies within three bits of exactly one
codeword. A segment's keys are the indices of all codewords within four bits
(one, or six when the nearest is three bits away). Two segments that differ in
at most two bits share a key: some word between them is within one bit of
both, and its codeword within three more.

Of four differing bits, the two segments with the fewest hold at most two
together. So two fingerprints within four bits share a key in two of the three
segments, and every pair of segments is one kind of bucket (24 bits, 85 keys a
fingerprint on average). What shares a bucket is verified on all 64 bits.

Fingerprints are made distinct first, so exact copies cost one row. Buckets
are spread over tasks by a hash of the key, a large bucket over pairs of its
slices. A task reports, for what is linked inside it, one link to the smallest
member: the links stay linear in the keys and no pair list is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paystrata.llm.components import block_components
from paystrata.llm.words import by_group, mixed, utf8, word_spans
from paystrata.operators.components import connected_components
from paystrata.sources.staging import staged

SEGMENTS = ((0, 23), (23, 23), (46, 18))
_GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_ENTRY = np.dtype([("key", "<u4"), ("print", "<u8")])
_HELD = 2_000_000  # links a task holds before it reduces them to a forest


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the word shingles of one text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined, starts, ends = word_spans(words)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())),
                         np.uint64, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_key, print) of every document; ``print`` is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in utf8(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "text_key", "print"])
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, print long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 256 values of each byte, and per syndrome the error patterns of at most four bits."""
    unit = []
    for bit in range(23):
        word = 1 << bit
        for high in range(22, 10, -1):
            if word >> high & 1:
                word ^= _GENERATOR << (high - 11)
        unit.append(word)
    tables = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * byte + bit < 23:
                    tables[byte, value] ^= unit[8 * byte + bit]
    patterns = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for bit in bits:
                syndrome ^= unit[bit]
            patterns[syndrome, used[syndrome]] = sum(1 << bit for bit in bits)
            used[syndrome] += 1
    return tables, patterns


def segment_keys(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within four bits of each 23-bit word; six columns, -1 where there are fewer."""
    tables, patterns = _golay()
    syndrome = tables[0][words & 255] ^ tables[1][words >> 8 & 255] ^ tables[2][words >> 16]
    errors = patterns[syndrome]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, bucket key) for all keys of all fingerprints."""
    keys = [segment_keys((prints >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)) for at, width in SEGMENTS]
    owners, found = [], []
    for kind, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        both = (kind << 24) | (keys[i][:, :, None] << 12) | keys[j][:, None, :]
        there = (keys[i][:, :, None] >= 0) & (keys[j][:, None, :] >= 0)
        owners.append(np.nonzero(there)[0])
        found.append(both[there])
    return np.concatenate(owners), np.concatenate(found)


def _spread(parts: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_prints), step):
                prints = all_prints[at:at + step]
                owner, key = bucket_keys(prints)
                entries = np.empty(len(key), _ENTRY)
                entries["key"], entries["print"] = key, prints[owner]
                part = (mixed(key.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order, starts, groups = by_group(part)
                pieces = np.split(entries[order], starts[1:]) if len(starts) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(groups, pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["part", "entries"])
    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``a`` and ``b`` connect: from every member but the smallest to the smallest."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    root = block_components(len(nodes), place[:len(a)], place[len(a):])
    leaf = root != np.arange(len(nodes))
    return nodes[leaf], nodes[root[leaf]]


def _linked(most_bits: int):
    """Links among the entries of a part, or between two slices of a large one."""
    def run(table: pa.Table) -> pa.Table:
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        slices = table.column("slice").to_numpy()
        data = table.column("entries").to_pylist()

        def entries_of(number: int) -> np.ndarray:
            entries = np.frombuffer(b"".join(data[i] for i in np.flatnonzero(slices == number).tolist()), _ENTRY)
            return entries[np.argsort(entries["key"], kind="stable")]

        left = entries_of(first)
        right = left if first == second else entries_of(second)
        # Every left entry against the right ones of its bucket, one step at a time; inside a slice, those after it.
        to = np.arange(1, len(left) + 1) if first == second else np.searchsorted(right["key"], left["key"], side="left")
        stop = np.searchsorted(right["key"], left["key"], side="right")
        prints, others = left["print"], right["print"]
        a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        found, held = [], 0
        at = np.flatnonzero(to < stop)
        while len(at):
            near = at[np.bitwise_count(prints[at] ^ others[to[at]]) <= most_bits]
            found.append((prints[near], others[to[near]]))
            held += len(near)
            if held > _HELD:
                a, b = _forest(*map(np.concatenate, zip((a, b), *found)))
                found, held = [], 0
            to[at] += 1
            at = at[to[at] < stop[at]]
        a, b = _forest(*map(np.concatenate, zip((a, b), *found)))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})
    return run


def bucket_tiles(prints: DataFrame, entries_per_task: int = 400_000) -> DataFrame:
    """(part, first, second, slice, entries): what the tasks compare, a task for each (part, first, second).

    A part holds whole buckets. One with more than twice ``entries_per_task``
    entries, as a bucket of very many fingerprints makes it, is cut into slices
    of about a quarter of that size, and every pair of slices is a task of its
    own: a task's entries are bounded whatever a bucket holds.
    """
    count = prints.count()
    parts = max(1, -(-count * 85 // entries_per_task))
    step = max(1, min(4096, entries_per_task // 32))
    spread = prints.repartition(max(1, -(-count // 8192)), "print").mapInArrow(_spread(parts, step), "part long, entries binary")
    size = F.sum(F.length("entries")) / _ENTRY.itemsize
    large = staged(spread.groupBy("part").agg(size.alias("size")).filter(F.col("size") > 2 * entries_per_task).select(
        "part", F.ceil(4 * F.col("size") / entries_per_task).alias("slices")), "large-parts")
    placed = spread.join(large, "part", "left").withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn(
        "slice", F.pmod(F.xxhash64("entries"), "slices"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).select(
        "part", F.least("slice", "other").alias("first"), F.greatest("slice", "other").alias("second"), "slice", "entries")


def print_links(prints: DataFrame, most_bits: int = 4, entries_per_task: int = 400_000) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``most_bits`` of each other.

    ``prints`` holds distinct values. Not every linked pair is listed, but every
    one is connected. ``most_bits`` may be at most 4, which the segments cover.
    """
    if not 0 <= most_bits <= 4:
        raise ValueError("the segments cover up to four differing bits")
    tiles = bucket_tiles(prints, entries_per_task)
    return tiles.groupBy("part", "first", "second").applyInArrow(_linked(most_bits), "a long, b long").distinct()


def keyed_groups(docs: DataFrame, shingle: int = 4, most_bits: int = 4) -> DataFrame:
    """(doc_id, text_key, group, fingerprint, component_id) of every document.

    ``text_key`` is the text's xxhash64; ``group`` tells apart the groups of
    different texts that share a smallest doc_id. Otherwise as ``simhash_groups``.
    """
    prints = staged(fingerprints(docs, shingle), "prints")
    distinct = staged(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-prints")
    component = connected_components(print_links(distinct.select("print"), most_bits))
    named = distinct.join(component.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "component", F.coalesce("component", "print"))
    first = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = staged(named.join(first, "component").select("print", F.col("component").alias("group"), "component_id"), "print-components")
    return prints.join(by_print, "print").select(
        "doc_id", "text_key", "group", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_groups(docs: DataFrame, shingle: int = 4, most_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    ``component_id`` is the smallest doc_id reachable over fingerprints that
    differ in at most ``most_bits`` bits. Null and empty texts have fingerprint
    zero and link like any other. Repeated rows give repeated rows. Other
    columns of ``docs`` are not read.
    """
    return keyed_groups(docs, shingle, most_bits).select("doc_id", "fingerprint", "component_id")


def op10_simhash_near_dedup(spark, folder: str) -> DataFrame:
    """Contract query: all documents, 4-word shingles, at most 4 differing bits."""
    return simhash_groups(spark.read.parquet(f"{folder}/documents.parquet"))
