"""Token-id files: fixed-width bit packing with block offsets.

A file holds whole documents in ascending doc_id order (nulls first). Layout, all integers little-endian:

    8 bytes   magic b"VLBITS01"
    5 x u64   bits per id, ids per block, documents, ids, blocks
    docs      i64 doc_id (0 if null), u8 is-null flag, u64 number of ids; one array after the other
    blocks    u64 byte offset of each block in the packed part, and the length of that part at the end
    packed    ids in ``bits`` bits each, lowest bit first; a block is filled up to a whole byte

Any run of ids is read from the blocks it touches. Files are named by range of doc_ids and number in the range, so names
sort like doc_ids. A retried task writes the same files again under a name of its own and then renames them.

Defined results: null text counts as empty, so its document holds only the end id; documents with a null doc_id come
first; rows that repeat a doc_id are all written, ordered by a hash of the text; extra columns are ignored; an
empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path
from .tables import BATCH_ROWS, delete_at_exit, small_batches, stored
from .tokens import default_path, encoder

MAGIC = b"VLBITS01"
BLOCK_IDS = 4096
#: A file is closed when it holds this many ids; a longer document has a file of its own.
FILE_IDS = 2_000_000
DOC_FIELDS = "doc_id long, n_tokens long, ids_crc32 long, part int, number int, place int, before long"


def width(vocabulary: int) -> int:
    """The least number of bits that holds every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype="<u4")) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return each.astype("<u4") @ (np.uint32(1) << np.arange(bits, dtype="<u4"))


def to_file(doc_ids: list[int | None], ids: list[bytes], bits: int, block: int = BLOCK_IDS) -> bytes:
    """The bytes of a file with these documents; ``ids`` are little-endian unsigned 32-bit integers."""
    lengths = np.array([len(x) // 4 for x in ids], "<u8")
    every = np.frombuffer(b"".join(ids), "<u4")
    blocks = [pack(every[at : at + block], bits) for at in range(0, len(every), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = MAGIC + struct.pack("<5Q", bits, block, len(doc_ids), len(every), len(blocks))
    return b"".join([head, keys.tobytes(), null.tobytes(), lengths.tobytes(), offsets.tobytes(), *blocks])


class Reader:
    """Random access to the ids in the bytes of one file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        self.bits, self.block, docs, self.n_ids, blocks = struct.unpack_from("<5Q", data, 8)
        at = 48
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.null = np.frombuffer(data, np.uint8, docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 17 * docs).astype(np.int64)
        self.data, self.packed = data, at + 17 * docs + 8 * (blocks + 1)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (exclusive), unpacking only the blocks that hold them."""
        parts = []
        for b in range(start // self.block, -(-stop // self.block)):
            count = min(self.block, self.n_ids - b * self.block)
            raw = self.data[self.packed + self.offsets[b] : self.packed + self.offsets[b + 1]]
            first = b * self.block
            parts.append(unpack(raw, count, self.bits)[max(0, start - first) : stop - first])
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, file_ids: int = FILE_IDS) -> None:
    """Encode whole texts and write them under ``path``, a folder that all executors reach through its URI."""
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = tokenizer or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # Rows that repeat a doc_id are still spread: by text, and copies of one row by where they are read.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order[1:])])
    keys = [F.col("doc_id").asc_nulls_first(), "_o0", "_o1"]
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        end, part, number = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        held_docs: list[int | None] = []
        held_ids: list[bytes] = []
        count = 0

        def close() -> pd.DataFrame:
            nonlocal held_docs, held_ids, count, number
            name = f"ids-{part:08d}-{number:06d}.bits"
            temp = f"{folder}/_new-{uuid.uuid4().hex}"
            with store.open_output_stream(temp) as out:
                out.write(to_file(held_docs, held_ids, bits))
            store.move(temp, f"{folder}/{name}")
            done = pd.DataFrame({"name": [name], "n_docs": [len(held_docs)], "n_ids": [count]})
            held_docs, held_ids, count, number = [], [], 0, number + 1
            return done

        enc = encoder(tokenizer)
        bits = width(max(enc.size, end_id + 1))
        for batch in batches:
            for at in range(0, len(batch), BATCH_ROWS):
                some = batch.iloc[at : at + BATCH_ROWS]
                for doc_id, ids in zip(some.doc_id, enc.batch(list(some.text)), strict=True):
                    held_docs.append(None if pd.isna(doc_id) else int(doc_id))
                    held_ids.append(ids + end)
                    count += len(ids) // 4 + 1
                    if count >= file_ids:
                        yield close()
        if held_docs:
            yield close()

    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm)
    dealt.mapInPandas(save, "name string, n_docs long, n_ids long").agg(F.sum("n_ids")).collect()


def read(spark, path: str) -> DataFrame:
    """One row per document of the files: ids_crc32 over its ids, and its ``start`` among the ids of all files."""
    # A row is a whole file: hand few of them to a worker at once.
    small_batches(spark, 4)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                part, number = (int(x) for x in name.rpartition("/")[2].removesuffix(".bits").split("-")[1:])
                r = Reader(content)
                n = len(r.lengths)
                yield pd.DataFrame({
                    "doc_id": pd.array(np.where(r.null, 0, r.doc_ids), "Int64").copy() if not r.null.any() else pd.array([None if z else int(d) for d, z in zip(r.doc_ids, r.null, strict=True)], "Int64"),
                    "n_tokens": r.lengths, "ids_crc32": [zlib.crc32(r.document(i).tobytes()) for i in range(n)],
                    "part": part, "number": number, "place": np.arange(n), "before": r.starts[:-1],
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bits").load(path).select("path", "content")
    rows = stored(files.mapInPandas(decode, DOC_FIELDS), "ids-read")
    small_batches(spark)
    per_file = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("ids"))
    # Files of one range are few; ranges are as many as shuffle partitions.
    in_part = Window.partitionBy("part").orderBy("number")
    per_file = per_file.withColumn("base", F.sum("ids").over(in_part) - F.col("ids"))
    bases, total = [], 0
    for r in sorted(per_file.groupBy("part").agg(F.sum("ids").alias("ids")).collect()):
        bases.append((r["part"], total))
        total += r["ids"]
    parts = spark.createDataFrame(bases, "part int, part_base long")
    starts = per_file.join(F.broadcast(parts), "part").select("part", "number", (F.col("base") + F.col("part_base")).alias("base"))
    return rows.join(starts, ["part", "number"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the table's ids to files in the shared folder and return what the files hold."""
    spark = docs.sparkSession
    path = work_path(spark, "token-ids")
    path = path if "://" in path else f"file://{path}"
    write(docs, path, tokenizer, end_id)
    delete_at_exit(spark, path)
    return read(spark, path)
