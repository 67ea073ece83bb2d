"""Operator 9: substring dedup by hashing lines and the sentences inside them.

A unit is a sentence of a line (a line without sentence ends is one unit), normalised: A-Z lowered, white space as single
spaces.  Digests are grouped globally; the occurrence with the smallest (doc_id, place) stays and
the others are repeats.  Repeats that follow one another in a document make a passage, and passages of at
least MIN_WORDS words are removed, with their offsets in the original text.

`shared_passages` does not depend on sentence ends: it finds every run of SHARED_WORDS words that also stands earlier.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import hash_ranges, materialised

MIN_WORDS = 25
HOT_DIGESTS = 1000
SHARED_WORDS = 50
# a unit ends after sentence marks or at the end of a line
_UNIT = re.compile(r"[^\n.!?]+[.!?]*|[.!?]+")
UNITS = "doc_id long, copy long, unit int, begin long, end long, words long, digest long"


def units_of(text: str) -> list[tuple[int, int, int, int]]:
    """(begin, end, words, digest) of the units of a text, in code points; blank units are left out."""
    out = []
    for m in _UNIT.finditer(text):
        words = m[0].encode().lower().split()
        if words:
            digest = xxhash.xxh3_64_intdigest(b" ".join(words))
            out.append((m.start(), m.end(), len(words), digest - (1 << 64) if digest >> 63 else digest))
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in UNITS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    out: list[list] = [[] for _ in names]

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    for b in batches:
        for doc, copy, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "copy", "text")), strict=True):
            for i, unit in enumerate(units_of(text)):
                for column, x in zip(out, (doc, copy, i, *unit), strict=True):
                    column.append(x)
            if len(out[0]) > 50_000:
                yield rows()
                out = [[] for _ in names]
    yield rows()


def _texts(documents: DataFrame) -> DataFrame:
    rows = documents.filter("text IS NOT NULL AND doc_id IS NOT NULL")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")


def units(documents: DataFrame) -> DataFrame:
    """All units of all texts, with their digests; `copy` tells apart the texts of one doc_id."""
    return _texts(documents).mapInArrow(_units, UNITS)


def repeated_passages(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per passage to remove: doc_id, copy, begin, end (code points, end exclusive), n_units, n_words, first_doc_id.

    `copy` is the xxhash64 of the text: a doc_id that comes with several texts has its own passages in each, and of equal doc_ids the
    text with the smaller hash counts as earlier.  first_doc_id is the document that keeps the passage's longest unit.  Null texts and null doc_ids have no
    passages.  A text that repeats a passage loses the later one; a row that repeats a doc_id and text counts once.
    Digests are grouped with partial minima, and only those found twice are joined back.  A digest with at least a
    HOT_DIGESTS-th of all repeated units (there are at most HOT_DIGESTS of them) is broadcast, so a line that a third
    of all documents have is never one key of that join.
    """
    each = units(documents)
    place = F.struct("doc_id", "copy", "unit")
    first = each.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    twice = materialised(first.filter("first <> last").select("digest", "first", "n"))
    least = F.lit(math.ceil((twice.agg(F.sum("n")).first()[0] or 0) / HOT_DIGESTS))
    hot = F.broadcast(twice.filter(F.col("n") >= least).select(F.col("digest").alias("h_digest"), F.col("first").alias("h_first")))
    rest = twice.filter(F.col("n") < least).select(F.col("digest").alias("r_digest"), F.col("first").alias("r_first"))
    marked = each.join(hot, each["digest"] == hot["h_digest"], "left")
    # rows that have met their first place already are dealt by their own
    marked = marked.withColumn("key", F.when(F.col("h_digest").isNull(), F.col("digest")).otherwise(F.xxhash64("doc_id", "copy", "unit")))
    met = marked.join(rest, (F.col("key") == F.col("r_digest")) & F.col("h_digest").isNull(), "left")
    met = met.withColumn("first", F.coalesce("h_first", "r_first")).filter(F.col("first").isNotNull() & (F.col("first") != place))
    again = met.select("doc_id", "copy", "unit", "begin", "end", "words", F.col("first.doc_id").alias("first_doc_id")).distinct()
    order = Window.partitionBy("doc_id", "copy").orderBy("unit")
    runs = again.withColumn("run", F.col("unit") - F.dense_rank().over(order))
    passages = runs.groupBy("doc_id", "copy", "run").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"),
        F.max(F.struct("words", "first_doc_id"))["first_doc_id"].alias("first_doc_id"),
    )
    return passages.filter(F.col("n_words") >= min_words).drop("run")


_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
WINDOWS = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("at", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("digest", pa.int64()), ("own", pa.bool_())])


class _Words:
    """The words of a text (A-Z lowered, ASCII white space between them) and digests of k of them in a row."""

    def __init__(self, text: str):
        raw = np.frombuffer(text.encode().lower(), np.uint8)
        inside = np.concatenate([[False], ~_SPACE[raw], [False]])
        first, last = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        self.n, self.begin, self.end = len(first), points[first], points[last]
        # the words with single spaces between them
        self.data = np.append(raw, np.uint8(32))
        self.data[:-1][_SPACE[raw]] = 32
        self.data = self.data[np.append(inside[1:-1], False) | inside[:-1]]
        self.stops = np.cumsum(last - first + 1) - 1
        self.starts = self.stops - (last - first)

    def digests(self, k: int) -> np.ndarray:
        return hash_ranges(self.data, self.starts[: self.n - k + 1], self.stops[k - 1 :])


def _anchor_of(words: _Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `size` words where the least digest of half as many words in it begins, and these digests.

    Equal windows have equal anchors, so a window can only stand twice if its anchor does.
    """
    digests = words.digests(size // 2)
    rows = np.lib.stride_tricks.sliding_window_view(digests, size - size // 2 + 1)
    return np.arange(len(rows)) + rows.argmin(1), digests


def _anchors(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, copy, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "copy", "text")), strict=True):
                if (words := _Words(text)).n >= size:
                    anchor, digests = _anchor_of(words, size)
                    at = np.unique(anchor)
                    out.append((np.full(len(at), doc), np.full(len(at), copy), at, digests[at].view(np.int64)))
            if out:
                doc, copies, at, digest = (np.concatenate(c) for c in zip(*out, strict=True))
                columns = [pa.array(doc, pa.int64()), pa.array(copies, pa.int64()), pa.array(at.astype(np.int32)), pa.array(digest)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "at", "digest"])

    return run


def _windows(size: int):
    """Windows whose anchor stands twice; `own` if the same text has the window before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, copy, text, anchors in zip(*(b.column(c).to_pylist() for c in ("doc_id", "copy", "text", "anchors")), strict=True):
                words = _Words(text)
                if words.n < size:
                    continue
                at = np.flatnonzero(np.isin(_anchor_of(words, size)[0], anchors))
                digest = words.digests(size)[at].view(np.int64)
                own = np.ones(len(at), bool)
                own[np.unique(digest, return_index=True)[1]] = False
                columns = (np.full(len(at), doc), np.full(len(at), copy), at, words.begin[at], words.end[at + size - 1], digest, own)
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, WINDOWS, strict=True)], schema=WINDOWS)

    return run


def _met(each: DataFrame) -> DataFrame:
    """Rows whose digest has several rows, with the smallest doc_id that has it; common digests are broadcast as above."""
    twice = materialised(each.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    least = F.lit(math.ceil((twice.agg(F.sum("n")).first()[0] or 0) / HOT_DIGESTS))
    hot = F.broadcast(twice.filter(F.col("n") >= least).select(F.col("digest").alias("h_digest"), F.col("first").alias("h_first")))
    rest = twice.filter(F.col("n") < least).select(F.col("digest").alias("r_digest"), F.col("first").alias("r_first"))
    marked = each.join(hot, each["digest"] == hot["h_digest"], "left")
    marked = marked.withColumn("key", F.when(F.col("h_digest").isNull(), F.col("digest")).otherwise(F.xxhash64("doc_id", "copy", "at")))
    met = marked.join(rest, (F.col("key") == F.col("r_digest")) & F.col("h_digest").isNull(), "left")
    return met.withColumn("first", F.coalesce("h_first", "r_first")).filter("first IS NOT NULL").drop("h_digest", "h_first", "r_digest", "r_first", "key")


def shared_passages(documents: DataFrame, words: int = SHARED_WORDS) -> DataFrame:
    """One row per passage to remove: doc_id, copy (as above), begin, end (code points, end exclusive), n_words, first_doc_id.

    A passage is a longest run of words in which each lies in a window of `words` words that stands in a document of smaller
    doc_id or earlier in the same text, wherever sentences end.  first_doc_id is the smallest doc_id with such a window.
    Only windows whose anchor (see `_anchor_of`) stands twice are compared, about one digest in 13 words is for all texts.
    """
    rows = _texts(documents)
    anchors = rows.mapInArrow(_anchors(words), "doc_id long, copy long, at int, digest long")
    hits = materialised(_met(anchors).groupBy("doc_id", "copy").agg(F.collect_set("at").alias("anchors")))
    each = rows.join(hits, ["doc_id", "copy"]).mapInArrow(_windows(words), "doc_id long, copy long, at int, begin int, end int, digest long, own boolean")
    again = _met(each).filter("own OR first < doc_id")
    order = Window.partitionBy("doc_id", "copy").orderBy("at")
    runs = again.withColumn("new", (F.col("at") - F.lag("at").over(order) > words).cast("int"))
    runs = runs.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(order))
    return runs.groupBy("doc_id", "copy", "run").agg(
        F.min("begin").cast("long").alias("begin"), F.max("end").cast("long").alias("end"),
        (F.max("at") - F.min("at") + words).cast("long").alias("n_words"), F.min("first").alias("first_doc_id"),
    ).drop("run")


def remove_passages(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents without the passages; what is left keeps its order, and the passages have the original offsets.

    Passages belong to a text (doc_id and `copy`), so other texts of the same doc_id stay whole.  Nulls, repeated rows and other
    columns stay as they are.
    """
    names = documents.columns
    # no column of the documents has a name that is used here
    rows = documents.toDF(*[n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(names)])
    spans = passages.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("_spans"))
    s = spans.select(F.col("doc_id").alias("_s_doc"), F.col("copy").alias("_s_copy"), "_spans")
    met = rows.join(s, (rows["doc_id"].cast("long") == s["_s_doc"]) & (F.xxhash64(rows["text"]) == s["_s_copy"]), "left")
    at, text = F.col("_spans"), F.col("text")
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    pieces = F.transform(at, lambda x, i: cut(F.coalesce(F.get(at, i - 1)["end"], F.lit(0).cast("bigint")), x["begin"]))
    clean = F.concat(F.array_join(pieces, ""), cut(F.element_at(at, -1)["end"], F.length(text)))
    out = met.withColumn("text", F.when(at.isNotNull(), clean).otherwise(text))
    return out.select(*rows.columns).toDF(*names)
