"""Hierarchical multi-length packing of token ids into training sequences.

A document's ids are cut into whole windows of the longest context; what is left over is routed to
the shortest tier that holds it: long (over 1024), middle (over 256) or short. Within a group of
documents, long rests are packed into 4096-windows by best fit and their gaps are filled from the
middle tier, then exactly from the short tier, whose documents may be cut. Middle rests that found
no gap are packed into 1024-windows, filled up the same way; short ones that are left become exact
256-windows, and the last few tokens sequences of powers of two. So nearly every sequence ends at a
power of two and is not padded. Sequences are then dealt to step groups of near equal tokens.

Groups come from a hash of the pieces' numbers and hold about ``GROUP_TOKENS`` tokens, however large
the corpus and however many documents are alike: packing a group needs only its pieces' lengths, and
the ids of its short tier. The numbers are those of the task that made the piece and of the piece in
it, and are written with it, so they stay what they are when a later task is run again.

Null or empty text: the end id alone. Null doc_id and repeated rows: each row is a document of its
own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrowtools import map_rows
from wayfold.llm.wordtokens import WordTokens, vocabulary
from wayfold.session import Scratch

CONTEXT, MIDDLE, SHORT = 4096, 1024, 256
END = 2
GROUP_TOKENS = 8 << 20
STEP_TOKENS = 64 * CONTEXT
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, row long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """Whole windows and the rest of every document; only short rests carry their ids."""

    def make():
        tokens = WordTokens(path)
        end = END.to_bytes(4, "little")
        task, made = TaskContext.get().partitionId() << 40, [0]

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokens.ids(text) + end
                n = len(ids) // 4
                for start in range(0, n, CONTEXT):
                    part = ids[4 * start : 4 * (start + CONTEXT)]
                    size = len(part) // 4
                    out.append((doc_id, start, size, crc32(part), n, part if size <= SHORT else None, task + len(out) + made[0]))
            made[0] += len(out)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "row"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        return one

    return map_rows(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")], make, PIECES)


def _best_fit(sizes: list[int], room: int, gaps: list[tuple[int, int]] | None = None) -> tuple[list[int], list[tuple[int, int]], int]:
    """Deal sizes (descending) to the fullest window that holds each.

    Returns the window of each, the (gap, window) pairs, and the number of windows. With ``gaps``
    no window is opened: what fits nowhere gets -1.
    """
    opened, gaps, where = 0, sorted(gaps or []), []
    fixed = bool(gaps)
    for size in sizes:
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, window = gaps.pop(at)
        elif fixed:
            where.append(-1)
            continue
        else:
            gap, window = room, opened
            opened += 1
        where.append(window)
        if gap > size:
            insort(gaps, (gap - size, window))
    return where, gaps, opened


def pack(lengths: list[int], ids_of) -> tuple[list[tuple[int, int, int, int, int | None]], list[int]]:
    """Pack rests of up to CONTEXT tokens.

    Returns (item, start in the item, length, sequence, crc of a cut part or None) in order of place,
    and the context of each sequence. ``ids_of(item)`` gives the ids of an item of the short tier.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    long = [i for i in order if lengths[i] > MIDDLE]
    middle = [i for i in order if SHORT < lengths[i] <= MIDDLE]
    short = [i for i in order if lengths[i] <= SHORT]
    placed: list[tuple[int, int, int, int, int | None]] = []
    where, gaps, n = _best_fit([lengths[i] for i in long], CONTEXT)
    tiers = [CONTEXT] * n
    placed += [(i, 0, lengths[i], w, None) for i, w in zip(long, where, strict=True)]
    if gaps:
        where, gaps, _ = _best_fit([lengths[i] for i in middle], CONTEXT, gaps)
        placed += [(i, 0, lengths[i], w, None) for i, w in zip(middle, where, strict=True) if w >= 0]
        middle = [i for i, w in zip(middle, where, strict=True) if w < 0]
    supply = sum(lengths[i] for i in short) - sum(g for g, _ in gaps)
    where, more, n = _best_fit([lengths[i] for i in middle], MIDDLE)
    tier = MIDDLE
    if sum(g for g, _ in more) > supply:  # too little to fill them up: longer windows waste less
        where, more, n = _best_fit([lengths[i] for i in middle], CONTEXT)
        tier = CONTEXT
    placed += [(i, 0, lengths[i], len(tiers) + w, None) for i, w in zip(middle, where, strict=True)]
    gaps = [(g, len(tiers) + w) for g, w in more] + gaps  # middle windows first: unfilled they would be padded most
    tiers += [tier] * n

    stream = [(i, 0, lengths[i]) for i in short]
    stream.reverse()

    def fill(room: int, sequence: int) -> None:
        while room and stream:
            i, start, size = stream.pop()
            take = min(size, room)
            whole = start == 0 and take == lengths[i]
            placed.append((i, start, take, sequence, None if whole else crc32(ids_of(i)[4 * start : 4 * (start + take)])))
            if take < size:
                stream.append((i, start + take, size - take))
            room -= take

    for gap, sequence in gaps:
        fill(gap, sequence)
    rest = sum(size for _, _, size in stream)
    while rest:
        size = SHORT if rest >= SHORT else 1 << (rest.bit_length() - 1)
        tiers.append(size)
        fill(size, len(tiers) - 1)
        rest -= size
    return placed, tiers


def _steps(used: np.ndarray) -> np.ndarray:
    """Deal sequences, largest first, to and fro over step groups, so that their tokens are near equal."""
    groups = max(1, round(used.sum() / STEP_TOKENS))
    order = np.argsort(-used, kind="stable")
    lap, at = np.divmod(np.arange(len(used)), groups)
    out = np.empty(len(used), np.int64)
    out[order] = np.where(lap % 2 == 0, at, groups - 1 - at)
    return out


def _pack_group(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks().sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
    ids = rows.column("ids")
    placed, tiers = pack(rows.column("length").to_pylist(), lambda i: ids[i].as_py())
    item, start, length, sequence, crc = (list(x) for x in zip(*placed, strict=True))
    mine = rows.take(pa.array(item, pa.int64()))
    length, sequence = np.array(length, np.int64), np.array(sequence, np.int64)
    whole = mine.column("ids_crc32").to_pylist()
    used = np.bincount(sequence, length, minlength=len(tiers))
    order = np.argsort(sequence, kind="stable")  # pieces come in order of place within each sequence
    before = np.cumsum(length[order]) - length[order]
    first = np.r_[True, np.diff(sequence[order]) != 0]
    offset = np.empty(len(length), np.int64)
    offset[order] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(length)]))
    group = key[0].as_py()
    columns = {
        "doc_id": mine.column("doc_id"),
        "start": pa.array(mine.column("start").to_numpy() + np.array(start, np.int64)),
        "length": pa.array(length),
        "ids_crc32": pa.array([old if new is None else new for old, new in zip(whole, crc, strict=True)], pa.int64()),
        "doc_tokens": mine.column("doc_tokens"),
        "sequence_id": pa.array(group * (1 << 30) + sequence),
        "offset": pa.array(offset),
        "tier": pa.array(np.array(tiers, np.int32)[sequence]),
        "step_group": pa.array(group * (1 << 20) + _steps(used)[sequence]),
    }
    return pa.table(columns)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""
    scratch = Scratch(docs.sparkSession)
    made = scratch.keep(pieces(docs, path or vocabulary()))
    total = made.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / GROUP_TOKENS))
    dealt = made.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_pack_group, PACKED)
