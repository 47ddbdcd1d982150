"""Hierarchical packing into windows of several lengths.

A document's full windows of the longest tier stand alone; its rest is routed to the shortest
tier (context size) that holds it. Tiers are packed from the longest down: the gap that a rest
leaves in its window is filled with whole rests of shorter tiers, the longest that fits first;
what then stays open takes the front of a longer one, whose back is packed later. All tiers
are powers of two, so a filled window needs no padding. The last, open window of a task is
closed as windows of halving size. Windows are dealt to step groups so that every group of a
pool has about the same number of tokens and the same mix of tiers.

Packing needs no exchange: each task packs its own rows in pools of bounded size, and only its
last window is shorter than its tier. Ids are numbered by task, so a retried task gives the
same rows; give the operator a stored table.

Defined results: null and empty texts are the end id alone; texts of any length are cut, never
dropped; repeated rows and null ids are packed as rows of their own; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .registry import query
from .tokens import default_tokenizer, ids_crc32, shared_tokenizer

TIERS = (2048, 1024, 512, 256)
END_ID = 1
POOL_TOKENS = 1 << 20
STEP_TOKENS = 1 << 15
ALMOST_FULL = 64

Piece = tuple[int, int, int]  # document, start, length


def route(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    """The shortest tier that holds ``length`` tokens."""
    return next(t for t in reversed(tiers) if length <= t)


def pack_pool(rests: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows of the rests, each shorter than the longest tier, and the pieces of the open last one."""
    waiting = sorted((n, doc, start) for doc, start, n in rests)
    windows: list[list[Piece]] = []
    while waiting:
        n, doc, start = waiting.pop()
        window, gap = [(doc, start, n)], route(n, tiers) - n
        while gap and waiting:
            at = bisect_right(waiting, (gap, np.inf, 0)) - 1
            if at >= 0:
                n, doc, start = waiting.pop(at)
            else:  # all are longer than the gap
                whole, doc, start = waiting.pop()
                n = gap
                insort(waiting, (whole - n, doc, start + n))
            window.append((doc, start, n))
            gap -= n
        if gap:
            return windows, window
        windows.append(window)
    return windows, []


def close(window: list[Piece], longest: int) -> list[list[Piece]]:
    """An open window as windows whose sizes are powers of two, or as one that is almost full."""
    out: list[list[Piece]] = []
    left = sum(n for _, _, n in window)
    pieces = list(reversed(window))
    while left:
        size = left if longest - left <= ALMOST_FULL else 1 << (left.bit_length() - 1)
        left -= size
        out.append([])
        while size:
            doc, start, n = pieces.pop()
            take = min(n, size)
            out[-1].append((doc, start, take))
            if take < n:
                pieces.append((doc, start + take, n - take))
            size -= take
    return out


def step_groups(lengths: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The step group of each window: the longest first, always to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, sum(lengths) // step_tokens))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        tokens, g = groups[0]
        heapq.heapreplace(groups, (tokens + lengths[i], g))
        out[i] = g
    return out


def _schema(id_type: pa.DataType) -> pa.Schema:
    segment = pa.struct(
        [("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())]
    )
    return pa.schema(
        [("sequence_id", pa.int64()), ("step_id", pa.int64()), ("tier", pa.int32()), ("tokens", pa.int32()), ("ids", pa.binary()), ("segments", pa.list_(segment))]
    )


def packed(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID) -> DataFrame:
    """One row per window: ids as unsigned 16-bit (or 32-bit) little-endian numbers, and its segments."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = shared_tokenizer(path), TaskContext.get().partitionId()
        longest = max(tiers)
        docs_held: dict[int, tuple[object, np.ndarray]] = {}
        done: list[list[Piece]] = []
        rests: list[Piece] = []
        made = steps = number = held = 0
        schema = None

        def emit() -> pa.RecordBatch:
            nonlocal made, steps, done
            rows = []
            sizes = [sum(n for _, _, n in w) for w in done]
            groups = step_groups(sizes)
            for window, size, group in zip(done, sizes, groups, strict=True):
                segments, parts, offset = [], [], 0
                for doc, start, n in window:
                    doc_id, ids = docs_held[doc]
                    part = ids[start : start + n]
                    parts.append(part.tobytes())
                    segments.append(
                        {"doc_id": doc_id, "start": start, "length": n, "ids_crc32": ids_crc32(part), "doc_tokens": len(ids), "offset": offset}
                    )
                    offset += n
                rows.append(
                    {
                        "sequence_id": task << 40 | made,
                        "step_id": task << 40 | steps + group,
                        "tier": size if size & (size - 1) == 0 else longest,
                        "tokens": size,
                        "ids": b"".join(parts),
                        "segments": segments,
                    }
                )
                made += 1
            steps += len(set(groups))
            done = []
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            schema = schema or _schema(batch.schema.field(0).type)
            texts = (text.as_py() for text in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.documents(texts, end_id), strict=True):
                docs_held[number] = (doc_id, ids)
                whole = len(ids) - len(ids) % longest
                done += [[(number, start, longest)] for start in range(0, whole, longest)]
                if whole < len(ids):
                    rests.append((number, whole, len(ids) - whole))
                number += 1
                held += len(ids)
                if held >= POOL_TOKENS:
                    windows, rests = pack_pool(rests, tiers)
                    done += windows
                    yield emit()
                    docs_held = {d: docs_held[d] for d, _, _ in rests}
                    held = sum(n for _, _, n in rests)
        if docs_held:
            windows, rests = pack_pool(rests, tiers)
            done += windows + close(rests, longest)
            yield emit()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = (
        "sequence_id long, step_id long, tier int, tokens int, ids binary, segments array<struct<"
        f"doc_id: {id_type}, start: bigint, length: bigint, ids_crc32: bigint, doc_tokens: bigint, offset: bigint>>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, out)


def segments(sequences: DataFrame) -> DataFrame:
    """One row per piece of a document."""
    rows = sequences.select("sequence_id", "step_id", "tier", F.explode("segments").alias("s"))
    return rows.select("s.doc_id", "s.start", "s.length", "s.ids_crc32", "s.doc_tokens", "sequence_id", "s.offset", "step_id", "tier")


@query("op7_tier_packing")
def op7_tier_packing(spark, sf_dir):
    return segments(packed(table(spark, sf_dir, "documents")))
