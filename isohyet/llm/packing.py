"""Operator 6: best-two-fit packing of token sequences.

Lengths are at most the context size, so packing works on a histogram of lengths: a filled bin is
repeated as often as the counts allow, and the work does not grow with the documents.  Each piece then finds its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import materialised, sliced
from isohyet.llm.tokens import END_ID, VOCABULARY, encoder

CONTEXT = 1024
PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, part int, nth long"


def _fill(count: np.ndarray, size: int) -> list[int]:
    """One bin: the longest piece that fits, again and again, then two for the smallest if they fit more tightly."""
    used: dict[int, int] = {}

    def longest(gap: int) -> int:
        for x in range(min(gap, size), 0, -1):
            if count[x] > used.get(x, 0):
                return x
        return 0

    bin_, gap = [], size
    while gap and (x := longest(gap)):
        bin_.append(x)
        used[x] = used.get(x, 0) + 1
        gap -= x
    if gap and bin_:
        small = bin_[-1]
        room = gap + small
        used[small] -= 1
        left = np.maximum(count[: room + 1] - np.array([used.get(x, 0) for x in range(room + 1)]), 0)
        left[small] -= 1  # the piece taken out is not put back
        there = np.flatnonzero(left > 0)
        there = there[there > 0]
        best, pair = small, None
        for x in there.tolist():
            if 2 * x > room:
                break
            other = there[there <= room - x]
            y = int(other[-1])
            if y == x and left[x] < 2:
                y = int(other[-2]) if len(other) > 1 else 0
            if y >= x and x + y > best:
                best, pair = x + y, (x, y)
        if pair:
            bin_[-1:] = sorted(pair, reverse=True)
    return bin_


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Bins (lengths, how often), best two fit; every piece is in exactly one bin."""
    count = np.zeros(size + 1, np.int64)
    for x, n in counts.items():
        count[x] = n
    out = []
    while count.any():
        lengths = _fill(count, size)
        use = np.bincount(lengths, minlength=size + 1)
        at = use > 0
        times = int((count[at] // use[at]).min())
        count -= use * times
        out.append((lengths, times))
    return out


def _pieces(vocabulary: str, size: int, end_id: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        tail = np.array([end_id], "<u4").tobytes()
        for b in sliced(batches):
            out: list[list] = [[] for _ in range(8)]
            texts = encode.each(text or "" for text in b.column("text").to_pylist())
            for doc, found in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                ids = found.tobytes() + tail
                n = len(ids) // 4
                first = n % size or size
                for k, start in enumerate([0, *range(first, n, size)] if n > first else [0]):
                    end = min(n, first if k == 0 else start + size)
                    own = ids[4 * start : 4 * end]
                    length = end - start
                    for column, x in zip(out, (doc, k, start, length, own, zlib.crc32(own), part, int(seen[length])), strict=True):
                        column.append(x)
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return pieces


def cut_documents(documents: DataFrame, vocabulary: str = VOCABULARY, size: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `size` ids with their ids and place in the document; null texts are just the end id.

    Only longer documents are cut, so that all pieces but the first are full.  part and nth number the pieces of a
    length inside each partition, so the result has to be materialised before it is ranked.
    """
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(vocabulary, size, end_id), PIECES)


def _slots(bins: list[tuple[list[int], int]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence, copies in a bin and first offset of each bin kind that holds it."""
    rows: dict[int, list] = {}
    ranks = np.zeros(size + 1, np.int64)
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            copies = lengths.count(x)
            rows.setdefault(x, []).append((ranks[x], sequence, copies, offset))
            ranks[x] += copies * times
            offset += copies * x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}


def _place(slots, ids: bool):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for b in sliced(batches, "ids") if ids else batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                rows = length == x
                first, begin, copies, at = table[x]
                kind = np.searchsorted(first, rank[rows], side="right") - 1
                inside = rank[rows] - first[kind]
                sequence[rows] = begin[kind] + inside // copies[kind]
                offset[rows] = at[kind] + inside % copies[kind] * x
            names = b.schema.names
            b = b.set_column(names.index("rank"), "sequence_id", pa.array(sequence))
            yield b.append_column("offset", pa.array(offset))

    return place


def pack(pieces: DataFrame, size: int = CONTEXT, keep_ids: bool = True) -> DataFrame:
    """Materialised pieces with sequence_id and offset; sequences have no gaps and at most `size` ids.

    Only the histogram, at most `size` rows, comes to the driver; the table of places is bounded by the kinds of
    bins, which depend on the lengths and not on the number of documents.
    """
    spark = pieces.sparkSession
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialised(per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))))
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(pack_histogram(counts, size), size))
    columns = ["doc_id", "piece", "start", "length", *(["ids"] if keep_ids else []), "ids_crc32"]
    ranked = pieces.select(*columns, "part", "nth").join(bases.select("part", "length", "base"), ["part", "length"])
    ranked = ranked.select(*columns, (F.col("nth") + F.col("base")).alias("rank"))
    kinds = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids": "binary", "ids_crc32": "long"}
    return ranked.mapInArrow(_place(slots, keep_ids), ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long")


def best_two_fit(documents: DataFrame, vocabulary: str = VOCABULARY, size: int = CONTEXT, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit), sequence and offset.

    Repeated rows are packed as often as they come; extra columns are ignored; an empty table gives no row.
    """
    return pack(materialised(cut_documents(documents, vocabulary, size, end_id)), size, keep_ids)
