"""Packed token matrices by best-fit-decreasing with a segment tree over capacities.

Documents longer than a row are split into full rows and a rest, so that no id is lost. Rests
are packed longest first, each into the row with the smallest sufficient room; a segment tree
over the possible rooms finds it in logarithmic time. Per row the ids (padded to the row
length), the cumulative segment lengths and the position ids, which restart at each segment,
are written as little-endian binaries.

Each task packs its own rows in pools of bounded size; rows that stay under ``CLOSE_FROM`` full
go back to the next pool. Ids are numbered by task, so a retried task gives the same rows.

Defined results: null and empty texts are the end id alone; texts of any length are split, never
dropped; repeated rows and null ids are rows of their own; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import run_folder

from .common import table
from .registry import query
from .tokens import default_tokenizer, shared_tokenizer

ROW_TOKENS = 2048
END_ID = 49407
PAD_ID = 0
POOL_TOKENS = 1 << 20
CLOSE_FROM = 0.95

Piece = tuple[int, int, int]  # document, start, length


class RoomTree:
    """Open rows by their room; finds the smallest room of at least a given size."""

    def __init__(self, largest: int):
        self.width = 1 << largest.bit_length()
        self.counts = [0] * (2 * self.width)
        self.rows: dict[int, list[int]] = {}

    def _add(self, room: int, change: int) -> None:
        at = room + self.width
        while at:
            self.counts[at] += change
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove a row with the smallest room of at least ``least``: ``(room, row)``."""
        at, counts = least + self.width, self.counts
        if not counts[at]:
            while at > 1 and (at & 1 or not counts[at + 1]):  # up to a left child with a filled right sibling
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if counts[2 * at] else 2 * at + 1
        room = at - self.width
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    tree, rows = RoomTree(capacity), []
    for piece in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        found = tree.take(piece[2])
        if found is None:
            rows.append([piece])
            room, row = capacity, len(rows) - 1
        else:
            room, row = found
            rows[row].append(piece)
        if room > piece[2]:
            tree.put(room - piece[2], row)
    return rows


def matrices(docs: DataFrame, tokenizer: str | None = None, capacity: int = ROW_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per packed row of the id matrix."""
    path = tokenizer or default_tokenizer()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = shared_tokenizer(path), TaskContext.get().partitionId()
        held: dict[int, tuple[object, np.ndarray]] = {}
        full: list[list[Piece]] = []
        rests: list[Piece] = []
        made = number = tokens = 0
        schema = None

        def emit(rows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal made
            out = []
            for row in rows:
                ids = np.concatenate([held[d][1][s : s + n] for d, s, n in row])
                lengths = [n for _, _, n in row]
                places = np.concatenate([np.arange(n, dtype="<u2" if capacity <= 1 << 16 else "<u4") for n in lengths])
                gap = capacity - len(ids)
                out.append(
                    {
                        "row_id": task << 40 | made,
                        "tokens": len(ids),
                        "ids": np.pad(ids, (0, gap), constant_values=PAD_ID).tobytes(),
                        "cu_seqlens": np.concatenate(([0], np.cumsum(lengths))).astype("<i4").tobytes(),
                        "position_ids": np.pad(places, (0, gap)).tobytes(),
                        "segments": [{"doc_id": held[d][0], "start": s, "length": n} for d, s, n in row],
                    }
                )
                made += 1
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            if schema is None:
                segment = pa.struct([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64())])
                schema = pa.schema(
                    [("row_id", pa.int64()), ("tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.binary()), ("position_ids", pa.binary()), ("segments", pa.list_(segment))]
                )
            texts = (text.as_py() for text in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.documents(texts, end_id), strict=True):
                held[number] = (doc_id, ids)
                whole = len(ids) - len(ids) % capacity
                full += [[(number, start, capacity)] for start in range(0, whole, capacity)]
                if whole < len(ids):
                    rests.append((number, whole, len(ids) - whole))
                number += 1
                tokens += len(ids)
                if tokens >= POOL_TOKENS:
                    rows = best_fit_decreasing(rests, capacity)
                    good = [r for r in rows if sum(n for _, _, n in r) >= CLOSE_FROM * capacity]
                    # at least half the pool leaves, so that a pool of awkward sizes does not grow
                    good = good if 2 * len(good) >= len(rows) else rows
                    yield emit(full + good)
                    full = []
                    rests = [] if good is rows else [p for r in rows if sum(n for _, _, n in r) < CLOSE_FROM * capacity for p in r]
                    held = {d: held[d] for d, _, _ in rests}
                    tokens = sum(n for _, _, n in rests)
        if held:
            yield emit(full + best_fit_decreasing(rests, capacity))

    out = (
        "row_id long, tokens int, ids binary, cu_seqlens binary, position_ids binary, "
        f"segments array<struct<doc_id: {id_type}, start: bigint, length: bigint>>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, out)


def write_matrices(docs: DataFrame, path: str, **options) -> None:
    matrices(docs, **options).write.option("compression", "zstd").parquet(path)


@query("op3_token_matrices")
def op3_token_matrices(spark, sf_dir):
    """Writes the matrices and returns a digest of every row of the files."""
    path = run_folder(spark, "token-matrices")
    write_matrices(table(spark, sf_dir, "documents"), path)
    rows = spark.read.parquet(path)
    return rows.select(
        "row_id",
        "tokens",
        F.size("segments").alias("n_segments"),
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("cu_seqlens").alias("cu_seqlens_crc32"),
        F.crc32("position_ids").alias("position_ids_crc32"),
        F.col("segments.doc_id").alias("doc_ids"),
        F.col("segments.start").alias("starts"),
        F.col("segments.length").alias("lengths"),
    )
