"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank of frequency over the whole corpus, so the
common ones fit one byte. A block holds the ranks of consecutive documents as
two byte strings: control bytes, each with the byte lengths (1 to 4) of four
ranks in two bits each, and the bytes of the ranks, lowest first. Decoding
looks the four lengths of every control byte up in a 256-row table, sums them
to offsets and gathers the bytes; there is no loop over values.

On disk a data set is a folder with ``blocks`` (one row per block: file and
block number, first, doc_ids, counts, control, data) and ``ranks`` (rank, id), both
Parquet, so Spark's writers commit it and any store that Spark reaches holds it.
File numbers ascend with doc_id, block numbers inside a file too; ``first``
counts the ids of the file before a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paystrata.llm.tokens import END_ID, encoder, narrowest, vocabulary_path
from paystrata.llm.words import utf8
from paystrata.sources.staging import staged, staging_path

BLOCK_IDS = 1 << 20
_LENGTHS = np.array([[(control >> 2 * i & 3) + 1 for i in range(4)] for control in range(256)], np.int32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype("<u4")
    lengths = 1 + (ranks >= 1 << 8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes | pa.Buffer, data: bytes | pa.Buffer, count: int) -> np.ndarray:
    """The ``count`` values of a block."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    source = np.frombuffer(data, np.uint8)
    ranks = source[starts].astype(np.uint32)
    for extra in (1, 2, 3):
        longer = np.flatnonzero(lengths > extra)
        ranks[longer] |= source[starts[longer] + extra].astype(np.uint32) << np.uint32(8 * extra)
    return ranks


def token_ids(docs: DataFrame, path: str, end_id: int = END_ID, kind: str = "<u4") -> DataFrame:
    """(doc_id, key, ids, met, counts): every document's ids as little-endian unsigned values of that type, and a hash of them.

    The last row of a task has no ids but those it met and how often.
    """
    names = ["doc_id", "key", "ids", "met", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held = encoder(path, end_id, kind).encode, np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = encode(utf8(part.column(1)))
                more = np.bincount(np.frombuffer(b"".join(ids), kind))
                if len(more) > len(held):
                    more, held = held, more
                held[:len(more)] += more
                key = np.array([xxhash.xxh3_64_intdigest(v) for v in ids], np.uint64).astype(np.int64)
                none = pa.nulls(len(ids), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(key), pa.array(ids, pa.binary()), none, none], names)
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                          pa.array([met], pa.list_(pa.int64())), pa.array([held[met]], pa.list_(pa.int64()))], names)
    return docs.select("doc_id", "text").mapInArrow(run, _IDS)


_IDS = "doc_id long, key long, ids binary, met array<long>, counts array<long>"


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the rows with counts: one for each task."""
    met = ids.filter("met is not null").select(F.explode(F.arrays_zip("met", "counts")).alias("m"))
    return met.groupBy(F.col("m.met").alias("id")).agg(F.sum("m.counts").alias("n"))


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, files: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order.

    Null and empty texts hold the end id alone. Rows that share a doc_id are
    written one after the other, ordered by a hash of their ids, which also
    spreads them over files; a null doc_id comes first. Only the id counts reach
    the driver: one row per vocabulary entry.
    """
    spark = docs.sparkSession
    kind = narrowest(path, end_id)
    size = np.dtype(kind).itemsize
    place = staging_path(spark, "token-ids")
    token_ids(docs, path, end_id, kind).write.option("compression", "zstd").parquet(place)
    staged_ids = spark.read.schema(_IDS).parquet(place)
    ids = staged_ids.filter("ids is not null").select("doc_id", "key", "ids")
    ranked = np.array([r["id"] for r in id_counts(staged_ids).orderBy(F.desc("n"), "id").select("id").collect()], np.int64)
    spark.createDataFrame(pa.table({"rank": np.arange(len(ranked)), "id": ranked}).to_pandas(), "rank long, id long") \
        .coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, block_no, first, doc_ids, parts, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def block() -> pa.RecordBatch:
            control, data = encode_ranks(rank_of[np.frombuffer(b"".join(parts), kind)])
            return pa.RecordBatch.from_arrays(
                [pa.array([file_no], pa.int32()), pa.array([block_no], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(p) // size for p in parts]], pa.list_(pa.int64())),
                 pa.array([held], pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary())], _BLOCK_NAMES)

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                parts.append(value)
                held += len(value) // size
                if held >= BLOCK_IDS:
                    yield block()
                    block_no, first, doc_ids, parts, held = block_no + 1, first + held, [], [], 0
        if parts:
            yield block()

    count = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.repartitionByRange(count, "doc_id", "key").sortWithinPartitions("doc_id", "key", "ids").select("doc_id", "ids")
    ordered.mapInArrow(run, _BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")


_BLOCKS = "file_no int, block_no int, first long, doc_ids array<long>, counts array<long>, n_ids long, control binary, data binary"
_BLOCK_NAMES = [column.split()[0] for column in _BLOCKS.split(", ")]


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, decoded from the files.

    ``start`` counts the ids of all documents before it.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in ranks], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, counts = batch.column("doc_ids")[i].values, batch.column("counts")[i].values
                control, data = batch.column("control")[i].as_buffer(), batch.column("data")[i].as_buffer()
                n = counts.to_numpy()
                ends = np.cumsum(n)
                whole = id_of[decode_ranks(control, data, int(ends[-1]))].tobytes()
                view, cuts = memoryview(whole), [0, *(4 * ends).tolist()]
                crc = [zlib.crc32(view[a:b]) for a, b in zip(cuts, cuts[1:])]
                start = batch.column("before")[i].as_py() + batch.column("first")[i].as_py()
                # The ids of the block are the values of one binary column, cut at the documents' ends.
                ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.array(cuts, np.int64)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + ends - n), counts, pa.array(crc, pa.int64()), ids.cast(pa.binary())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    # One row per file, written first so that the planner sees how small that is.
    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    before = staged(files.select("file_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "token-file-starts")
    placed = blocks.join(before, "file_no").select("before", "first", "doc_ids", "counts", "control", "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query: all documents to files and back, without the ids themselves."""
    place = staging_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{folder}/documents.parquet"), place, vocabulary_path())
    return read_token_files(spark, place).drop("ids")
