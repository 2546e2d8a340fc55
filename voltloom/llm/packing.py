"""Best-fit packing of token pieces into sequences of fixed size.

The lengths are counted; the counts, at most one per length, are all that the driver plans with, whatever the corpus. The
plan: patterns of two or three lengths that fill a sequence exactly get repeat counts by non-negative least squares
against the histogram; the counts are rounded down, then up where pieces are left; what remains is packed by
best fit, longest first. A plan is a list of runs (a length's pieces from one rank on, each in the next sequence, all at the
same offset), and tasks look up a piece's run by its rank among all pieces ordered by length.

Defined results: null text counts as empty; a document always has the end id, so it has a piece; repeated rows are packed
as often as they occur; null doc_ids are kept; extra columns are ignored; an empty table gives no rows. Ties of
length are dealt by doc_id and piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import BATCH_ROWS, ranked, small_batches, stored
from .tokens import default_path, task_encoder

SEQUENCE = 2048
PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, size: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """The pieces of every whole text: a longer document is cut so that only its first piece may be short.

    ``keep_ids`` adds the ids (little-endian unsigned 32-bit).
    """
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([end_id], "<u4").tobytes()
        with task_encoder(tokenizer) as enc:
            for batch in batches:
                for at in range(0, len(batch), BATCH_ROWS):
                    some, out = batch.iloc[at : at + BATCH_ROWS], []
                    for doc_id, ids in zip(some.doc_id, enc.batch(list(some.text)), strict=True):
                        data = ids + end
                        n = len(data) // 4
                        bounds = [0, *range(n % size or size, n + 1, size)]
                        key = None if pd.isna(doc_id) else int(doc_id)
                        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                            part = data[4 * a : 4 * b]
                            out.append((key, k, a, b - a, zlib.crc32(part), *([part] if keep_ids else [])))
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
                    yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, PIECE_FIELDS + ", ids binary" * keep_ids)


def patterns(counts: np.ndarray, size: int) -> np.ndarray:
    """Every pair and triple of present lengths that fills a sequence, a row each, ascending, 0 for no third."""
    there = np.flatnonzero(counts[:size] > 0)
    there = there[there > 0]
    has = np.zeros(size + 1, bool)
    has[there] = True
    found = [np.zeros((0, 3), np.int32)]
    for a in [0, *there[there <= size // 3].tolist()]:
        b = there[(there >= a) & (there <= (size - a) // 2)]
        b = b[has[size - a - b]]
        found.append(np.stack([np.full(len(b), a), b, size - a - b], 1).astype(np.int32))
    return np.concatenate(found)


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = 80) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the counts, by multiplicative steps."""
    use = lambda x: sum(np.bincount(rows[:, k], x, len(counts)) for k in range(3)) * live
    ask = lambda v: v[rows].sum(1)
    live = np.ones(len(counts))
    live[0] = 0
    aim = ask(counts * live)
    x = np.full(len(rows), counts.sum() / max(1, 3 * len(rows)))
    for _ in range(steps):
        x *= aim / np.maximum(ask(use(x)), 1e-12)
    return x


def plan(counts: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, int]:
    """Runs (length, count, first sequence, offset), in the order in which a length's pieces are dealt; number of sequences."""
    left = counts.astype(np.int64).copy()
    groups: list[tuple[int, list[tuple[int, int]]]] = []  # repeats, [(length, copies)]

    def take(row, want: int) -> None:
        each = {}
        for v in row:
            if v:
                each[v] = each.get(v, 0) + 1
        n = min([want, *(int(left[v]) // k for v, k in each.items())])
        if n > 0:
            groups.append((n, sorted(each.items(), reverse=True)))
            for v, k in each.items():
                left[v] -= n * k

    if left[size]:
        groups.append((int(left[size]), [(size, 1)]))
        left[size] = 0
    rows = patterns(left, size)
    if len(rows):
        x = fit(rows, left.astype(float))
        order = np.argsort(-x, kind="stable")
        for i in order[x[order] >= 1]:
            take(rows[i].tolist(), int(x[i]))
        fraction = x - np.floor(x)
        order = np.argsort(-fraction, kind="stable")
        for i in order[fraction[order] >= 0.25]:
            take(rows[i].tolist(), 1)
    # Best fit of the rest: open sequences by room left, each entry [repeats, content].
    rooms: list[int] = []
    opened: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def keep(room: int, n: int, content: list[tuple[int, int]]) -> None:
        if room not in opened:
            opened[room] = []
            insort(rooms, room)
        opened[room].append((n, content))

    for v in range(size - 1, 0, -1):
        c = int(left[v])
        while c:
            at = bisect_left(rooms, v)
            if at == len(rooms):
                fits = size // v
                if c >= fits:
                    keep(size - fits * v, c // fits, [(v, fits)])
                if c % fits:
                    keep(size - c % fits * v, 1, [(v, c % fits)])
                break
            room = rooms[at]
            n, content = opened[room].pop()
            if not opened[room]:
                del opened[room]
                rooms.pop(at)
            put = min(room // v, c)  # as many copies as one sequence takes
            m = min(n, c // put)
            if m < n:
                keep(room, n - m, content)
            keep(room - put * v, m, [*content, (v, put)])
            c -= m * put
    groups += [x for some in opened.values() for x in some]
    runs, sequence = [], 0
    for n, content in groups:
        offset = 0
        for v, copies in content:
            for _ in range(copies):
                runs.append((v, n, sequence, offset))
                offset += v
        sequence += n
    out = np.array(runs, np.int64).reshape(-1, 4)
    return out[np.argsort(out[:, 0], kind="stable")], sequence


def pack(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces with ``length``, ``doc_id`` and ``piece``."""
    spark = cut.sparkSession
    counts = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    runs, _ = plan(counts, size)
    # Pieces ranked by length meet the runs in order: a run starts at the sum of the counts before it.
    first = np.concatenate([[0], np.cumsum(runs[:, 1])[:-1]]) if len(runs) else np.zeros(1, np.int64)
    table = spark.sparkContext.broadcast((first, runs[:, 2].copy(), runs[:, 3].copy()))
    order = [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    placed = ranked(cut, order, "pieces-ranked", "_rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, sequences, offsets = table.value
        for batch in batches:
            rank = batch.pop("_rank").to_numpy()
            run = np.searchsorted(starts, rank, "right") - 1
            yield batch.assign(sequence_id=sequences[run] + rank - starts[run], offset=offsets[run])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return placed.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, size: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """Cut and pack a whole table: a row per piece with its sequence and place."""
    cut = stored(pieces(docs, tokenizer, end_id, size, keep_ids), "pieces")
    return pack(cut, size)
