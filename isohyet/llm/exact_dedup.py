"""Operator 12: exact dedup against a minimal perfect hash over the digests of a history.

A text is known by its SHA-256 digest.  The distinct digests of a history are dealt to buckets of about BUCKET digests, and
each bucket gets a minimal perfect hash: levels of bit arrays in which a digest owns the bit no other digest hits, so its
rank among the set bits is its slot.  Slots hold the whole digest, the locator of the row that stays and the number of copies.  A
digest that arrives later goes to its bucket, follows the levels to at most one slot, and is a repeat only
if all 32 bytes there are its own; digests without such a slot are grouped among themselves.

Rows never carry texts beyond the first pass: everything after it works on digests, grouped with partial maxima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import materialised, mix, sorted_groups

BUCKET = 8192
HOT = 1000
# bits of a level for each digest that is still without a slot
GAMMA = 2.0
DIGEST_BYTES = 32

WINNER = "digest binary, doc_id long, row long, n long"
INDEX = "bucket int, buckets int, sizes array<int>, levels array<binary>, digests binary, doc_ids array<long>, rows array<long>, counts array<long>"
TOTALS = "digest binary, doc_id long, row long, n long, repeats long, slot int"


# --- the hash of one bucket -------------------------------------------------


def _words(digests: np.ndarray) -> np.ndarray:
    """(n, 4) unsigned 64-bit words of n digests."""
    return digests.reshape(-1, DIGEST_BYTES).view("<u8")


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where digests fall in the bit array of a level; levels use independent mixes of all four words."""
    seed = mix(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = np.zeros(len(words), np.uint64)
    for k in range(4):
        h = mix(h ^ words[:, k] ^ seed) + np.uint64(k)
    return (h % np.uint64(size)).astype(np.int64)


def build_levels(digests: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Sizes and packed bits of the levels for distinct digests (n rows of 32 bytes)."""
    left, sizes, levels = _words(digests), [], []
    while len(left):
        size = int(GAMMA * len(left)) + 8
        at = _places(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(np.packbits(alone).tobytes())
        left = left[~alone[at]]
    return sizes, levels


class Slots:
    """The slots of digests under given levels."""

    def __init__(self, sizes: list[int], levels: list[bytes]):
        self.bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(sizes, levels, strict=True)]
        self.ranks, before = [], 0
        for bits in self.bits:
            self.ranks.append(before + np.cumsum(bits) - bits)
            before += int(bits.sum())

    def __call__(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 where the levels end; a digest outside the history may get anyone's slot."""
        words = _words(digests)
        slots, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = _places(words[left], level, len(bits))
            hit = bits[at]
            slots[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return slots


def _bytes(column) -> np.ndarray:
    """(n, 32) bytes of a binary column of digests."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIGEST_BYTES)


def _longs(column, order=None) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column if order is None else column.take(pa.array(order))


# --- rows, winners, index ---------------------------------------------------


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, digest, row) of every row, written once; null texts count as empty, row numbers only name rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return materialised(rows.withColumn("row", F.monotonically_increasing_id()))


def winners(rows: DataFrame) -> DataFrame:
    """One row per digest: the locator (doc_id, row) that stays, which has the largest doc_id, and the number of copies.

    A null doc_id is less than any other; of rows with equal doc_id and text the one with the larger row number stays.
    """
    best = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("w"), F.count("*").alias("n"))
    return best.select("digest", "w.doc_id", "w.row", "n")


def _bucket(buckets) -> F.Column:
    return F.pmod(F.xxhash64("digest"), buckets).cast("int")


def _build(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["bucket"]):
            raw = _bytes(group.column("digest"))
            sizes, levels = build_levels(raw)
            order = np.argsort(Slots(sizes, levels)(raw))
            lists = [pa.array([_longs(group.column(c), order).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "row", "n")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group.column("bucket")[0].as_py()], pa.int32()), pa.array([buckets], pa.int32()),
                    pa.array([sizes], pa.list_(pa.int32())), pa.array([levels], pa.list_(pa.binary())),
                    pa.array([raw[order].tobytes()], pa.binary()), *lists,
                ],
                [x.split()[0] for x in INDEX.split(", ")],
            )

    return run


def build_index(history: DataFrame) -> DataFrame:
    """The index of the winners of a history: one row per bucket, to be written and read as any table.

    Digests are uniform, so no bucket is much larger than BUCKET digests, whatever the texts.  An empty history has no rows.
    """
    parts = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-history.count() // BUCKET))
    rows = history.withColumn("bucket", _bucket(F.lit(buckets)))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_build(buckets), INDEX)


# --- lookup -----------------------------------------------------------------

_TOTALS = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("repeats", pa.int64()), ("slot", pa.int32())])


class _Bucket:
    """The index of one bucket and which of its slots were met."""

    def __init__(self, index: dict | None):
        self.digests = np.frombuffer(index["digests"] if index else b"", np.uint8).reshape(-1, DIGEST_BYTES)
        self.slots = Slots(index["sizes"], index["levels"]) if index else None
        self.index = index
        self.met = np.zeros(len(self.digests), bool)

    def look(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = _bytes(batch.column("digest"))
        slots = np.full(len(raw), -1, np.int64)
        if self.slots:
            slots = self.slots(raw)
            there = np.flatnonzero(slots >= 0)
            same = (self.digests[slots[there]] == raw[there]).all(1)
            slots[there[~same]] = -1
        found = slots >= 0
        self.met[slots[found]] = True
        ids, rows, counts = (batch.column(c).to_pylist() for c in ("doc_id", "row", "n"))
        repeats = np.where(found, counts, 0) if counts else np.zeros(0, np.int64)
        for i in np.flatnonzero(found):
            s, x = slots[i], self.index
            least = -(1 << 63)
            if (x["doc_ids"][s] if x["doc_ids"][s] is not None else least, x["rows"][s]) > (ids[i] if ids[i] is not None else least, rows[i]):
                ids[i], rows[i] = x["doc_ids"][s], x["rows"][s]
            counts[i] += x["counts"][s]
        columns = (batch.column("digest").cast(pa.binary()), ids, rows, counts, repeats, np.where(found, slots, -1))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TOTALS, strict=True)], schema=_TOTALS)

    def unmet(self) -> pa.RecordBatch:
        """Slots no arrival met: the history as it is."""
        at = np.flatnonzero(~self.met)
        take = lambda c: [self.index[c][i] for i in at]
        columns = ([self.digests[i].tobytes() for i in at], take("doc_ids"), take("rows"), take("counts"), np.zeros(len(at), np.int64), at) if len(at) else ([],) * 6
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TOTALS, strict=True)], schema=_TOTALS)


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, its index first; memory holds one bucket and one batch."""
    at, bucket = None, _Bucket(None)
    for batch in batches:
        keys = batch.column("bucket").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if at != keys[a]:
                yield bucket.unmet()
                at, index = keys[a], None
                if part.column("digest")[0].as_py() is None:
                    index, part = part.slice(0, 1).to_pylist()[0], part.slice(1)
                bucket = _Bucket(index)
            yield bucket.look(part)
    yield bucket.unmet()


def lookup(index: DataFrame, arrivals: DataFrame) -> DataFrame:
    """One row per digest of the history or the arrivals (winners of later rows): see TOTALS.

    n counts all copies and (doc_id, row) is the winner of them all; repeats counts the arrived copies of a digest of the
    history and slot is its slot there, -1 without one.
    """
    parts = int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = materialised(index)
    first = index.select("buckets").first()
    late = arrivals.withColumn("bucket", _bucket(F.lit(first["buckets"] if first else 1)))
    rows = index.unionByName(late, allowMissingColumns=True)
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("digest").isNotNull())
    return rows.mapInArrow(_lookup, TOTALS)


# --- results ----------------------------------------------------------------


def mark(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows with their digest's winner: doc_id, keep_id, group_size, kept, digest, row.

    Digests with at least a HOT-th of all rows (there are at most HOT of them) are broadcast, so that copies that fill a
    third of the table never meet in one task; the others are joined by digest.
    """
    totals = materialised(totals.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size")))
    least = -(-(totals.agg(F.sum("group_size")).first()[0] or 0) // HOT)
    hot = totals.filter(F.col("group_size") >= least).withColumnsRenamed({"keep_id": "h_id", "keep_row": "h_row", "group_size": "h_size"})
    near = rows.join(F.broadcast(hot), "digest", "left")
    done = near.filter("h_size IS NOT NULL").withColumnsRenamed({"h_id": "keep_id", "h_row": "keep_row", "h_size": "group_size"})
    rest = near.filter("h_size IS NULL").drop("h_id", "h_row", "h_size").join(totals.filter(F.col("group_size") < least), "digest")
    out = done.unionByName(rest)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest", "row")


def _marked(documents: DataFrame) -> DataFrame:
    rows = digests(documents)
    cut = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    late = F.col("doc_id") > F.lit(cut).cast("long")
    index = build_index(materialised(winners(rows.filter(late))))
    return mark(rows, lookup(index, winners(rows.filter(~F.coalesce(late, F.lit(False))))))


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if all their characters are; a null text counts as empty.  Of equal texts the row with the largest
    doc_id stays, so the half of the table with the larger doc_ids is the history and the other half is looked up in it.
    Of rows that repeat a doc_id and a text exactly one is kept.  A null doc_id is less than any
    other; keep_id is null if the whole group has none.  An empty table gives no rows, other columns are ignored.
    """
    return _marked(documents).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _free_name(frame: DataFrame, name: str) -> str:
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def _digest(documents: DataFrame) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(documents["text"].cast("string"), F.lit("")), 256))


def dedup(documents: DataFrame) -> DataFrame:
    """The documents that stay, each text once, with all their columns; of rows with equal doc_id and text any one stays."""
    kept = _marked(documents).filter("kept").select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest"))
    name = _free_name(documents, "digest_of_text")
    rows = documents.withColumn(name, _digest(documents))
    stay = rows.join(kept, (rows[name] == kept["k_digest"]) & rows["doc_id"].cast("long").eqNullSafe(kept["k_id"]), "left_semi")
    return stay.dropDuplicates([name]).select(*[stay[c] for c in documents.columns])


def unseen(documents: DataFrame, index: DataFrame) -> DataFrame:
    """Documents whose text the indexed history lacks, each text once (the row with the largest doc_id), with all their columns."""
    rows = digests(documents)
    new = lookup(index, winners(rows)).filter("slot < 0").select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest"))
    name = _free_name(documents, "digest_of_text")
    each = documents.withColumn(name, _digest(documents))
    stay = each.join(new, (each[name] == new["k_digest"]) & each["doc_id"].cast("long").eqNullSafe(new["k_id"]), "left_semi")
    return stay.dropDuplicates([name]).select(*[stay[c] for c in documents.columns])
