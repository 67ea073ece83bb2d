"""Operator 3: benchmark decontamination with a generalised suffix automaton.

The items' words go into one automaton per block of items (BLOCK_WORDS bounds what is broadcast).
Documents stream through it: after each word the state holds the longest suffix of the
text so far that occurs in some item.  From WINDOW words on, that suffix is a hit, and the state's
ancestor for WINDOW words names the items that hold the last window; shorter items hit as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import hash_ranges, kept_in_worker, materialised, sliced

WINDOW = 10
BLOCK_WORDS = 200_000  # words of a block of items; a larger benchmark makes more blocks, each read by all documents
MAX_SHARE = 0.5  # documents with a larger share of hit words are removed as a whole

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word: A-Z lowered, runs of 0-9, a-z and everything beyond ASCII."""
    data = np.frombuffer((text or b"").lower(), np.uint8)
    edge = np.diff(np.concatenate([[False], _WORD[data], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return hash_ranges(data, starts, ends), starts, ends


class Automaton:
    """Suffix automaton of several word sequences; words are ints."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.next, self.link, self.length = [{}], [-1], [0]
        self.window = window
        used = [(name, words) for name, words in items if words]
        for _, words in used:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.next)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.at_window = [0] * n  # the state of a suffix of `window` words
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.at_window[v] = self.at_window[up] if self.length[up] >= window else v
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, words in used:
            v = 0
            for k, w in enumerate(words, 1):
                v = self.next[v][w]
                if k >= window:
                    self.items.setdefault(self.at_window[v], set()).add(name)
            if len(words) < window:
                self.short.setdefault(v, []).append((len(words), name))
        self.near_short = [-1] * n  # the nearest state on the way to the root where a short item ends
        for v in order:
            self.near_short[v] = v if v in self.short else self.near_short[self.link[v]]
        self.shortest = min((min(window, len(w)) for _, w in used), default=0)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the shorter strings that end there."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (first, end) and items of a run of known words."""
        v = l = 0
        spans, found = [], set()
        for i, w in enumerate(words):
            while v and w not in self.next[v]:
                v = self.link[v]
                l = self.length[v]
            if w not in self.next[v]:
                continue
            v, l = self.next[v][w], l + 1
            if l >= self.window:
                spans.append((i - l + 1, i + 1))
                found |= self.items[self._window_state(v)]
            u = self.near_short[v]
            while u > 0:
                for n, name in self.short[u]:
                    if n <= l:
                        spans.append((i - n + 1, i + 1))
                        found.add(name)
                u = self.near_short[self.link[u]]
        return spans, found

    def _window_state(self, v: int) -> int:
        return self.at_window[v]


def _automaton(block) -> tuple[np.ndarray, Automaton]:
    """Sorted vocabulary and automaton of a broadcast block, built once per worker."""

    def build() -> tuple[np.ndarray, Automaton]:
        items, window = block.value
        vocabulary = np.unique(np.concatenate([w for _, w in items] or [np.zeros(0, np.uint64)]))
        return vocabulary, Automaton([(n, np.searchsorted(vocabulary, w).tolist()) for n, w in items], window)

    return kept_in_worker(("automaton", block.id), build)


class Block:
    """Items of one block as Spark broadcast them, with an id that is the same in all tasks."""

    def __init__(self, broadcast, number: str):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


def hits(text: bytes | None, block) -> tuple[int, list[tuple[int, int]], set[str], np.ndarray, np.ndarray]:
    """Number of words, merged hit ranges in words, items, and the words' byte starts and ends."""
    vocabulary, automaton = _automaton(block)
    hashed, starts, ends = words_of(text)
    if not len(hashed) or not len(vocabulary):
        return len(hashed), [], set(), starts, ends
    at = np.searchsorted(vocabulary, hashed)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == hashed
    edge = np.diff(np.concatenate([[False], known, [False]]).astype(np.int8))
    spans, found = [], set()
    for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if e - s >= automaton.shortest:
            run, names = automaton.scan(at[s:e].tolist())
            spans += [(s + a, s + b) for a, b in run]
            found |= names
    return len(hashed), merged(spans), found, starts, ends


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashed = [words_of(t)[0].view(np.int64) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("item_id").cast(pa.string()), pa.array(hashed, pa.list_(pa.int64())), pa.array(map(len, hashed), pa.int64())], ["item_id", "words", "n"]
        )


def blocks(items: DataFrame, window: int = WINDOW) -> list[Block]:
    """The items in broadcast blocks of about BLOCK_WORDS words; items without words are left out."""
    spark = items.sparkSession
    rows = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(_item_words, "item_id string, words array<long>, n long").filter("n > 0")
    total = rows.agg(F.sum("n")).first()[0] or 0
    count = max(1, math.ceil(total / BLOCK_WORDS))
    out = []
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(count)) == k).toArrow()
        words = [np.array(w, np.int64).view(np.uint64) for w in part.column("words").to_pylist()]
        held = list(zip(part.column("item_id").to_pylist(), words, strict=True))
        broadcast = spark.sparkContext.broadcast((held, window))
        out.append(Block(broadcast, f"{spark.sparkContext.applicationId}-{broadcast._jbroadcast.id()}"))
    return out


def _find(block):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [hits(t, block) for t in b.column("text").to_pylist()]
            columns = [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([[x for s in f[1] for x in s] for f in found], pa.list_(pa.int64())),
                pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), *columns], ["doc_id", "digest", "n_words", "spans", "items"])

    return find


def _found(documents: DataFrame, shared: list[Block]) -> DataFrame:
    """doc_id, digest of the text, n_words, spans, items: one row per document and block."""
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"))
    parts = [rows.mapInArrow(_find(b), "doc_id long, digest long, n_words long, spans array<long>, items array<string>") for b in shared]
    each = parts[0]
    for p in parts[1:]:
        each = each.unionByName(p)
    return each


def _gathered(each: DataFrame) -> DataFrame:
    """The spans (not merged) and items of all blocks together; one row per doc_id and text."""
    return each.groupBy("doc_id", "digest", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("rows")
    )


def find_hits(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, spans (pairs of first and end word, flat), items (sorted item_ids).

    A null text has no words; items with a null id or without words are left out; items that repeat an id count as one.
    """
    shared = blocks(items, window)
    each = _found(documents, shared)
    if len(shared) == 1:
        return each.drop("digest")
    again = _gathered(each).withColumn("row", F.explode(F.sequence(F.lit(1), (F.col("rows") / len(shared)).cast("int"))))
    return again.select("doc_id", "n_words", "spans", "items").mapInArrow(_merge, "doc_id long, n_words long, spans array<long>, items array<string>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [[x for s in merged(list(zip(f[::2], f[1::2], strict=True))) for x in s] for f in b.column("spans").to_pylist()]
        yield b.set_column(2, "spans", pa.array(spans, pa.list_(pa.int64())))


def _cut(spans_of, again: bool, text_at: int, chars_at: int | None, max_share: float, columns: int):
    """Cuts the spans that spans_of(batch, row, text) gives with the text's number of words and their byte starts and ends;
    ``again`` until there are none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text_at):
            texts, keep, changed = b.column(text_at).to_pylist(), [], []
            chars = b.column(chars_at).to_pylist() if chars_at is not None else None
            for i, t in enumerate(texts):
                raw = None if t is None else t.encode()
                n, spans, starts, ends = spans_of(b, i, raw)
                before, gone = n, 0
                while spans:
                    pieces, at = [], 0
                    for s, e in spans:
                        pieces.append(raw[at : starts[s]])
                        at, gone = ends[e - 1], gone + e - s
                    raw = b"".join([*pieces, raw[at:]])
                    # what a cut brings together may be a hit again
                    n, spans, starts, ends = spans_of(b, i, raw) if again else (n, [], starts, ends)
                keep.append(gone <= max_share * before)
                if gone:
                    texts[i] = raw.decode()
                    changed.append(i)
                    if chars:
                        chars[i] = len(texts[i])
            own = list(b.columns[:columns])
            if changed:
                own[text_at] = pa.array(texts, b.schema.field(text_at).type)
                if chars:
                    own[chars_at] = pa.array(chars, b.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(own, b.schema.names[:columns]).filter(pa.array(keep, pa.bool_()))

    return cut


def _look_up(block: Block):
    def spans_of(batch: pa.RecordBatch, row: int, raw: bytes | None):
        n, spans, _, starts, ends = hits(raw, block)
        return n, spans, starts, ends

    return spans_of


def _marked(batch: pa.RecordBatch, row: int, raw: bytes | None):
    """Spans that were found before and stand in the last column."""
    flat = batch.column(batch.num_columns - 1)[row].as_py() or []
    hashed, starts, ends = words_of(raw)
    return len(hashed), merged(list(zip(flat[::2], flat[1::2], strict=True))), starts, ends


def remove_hits(documents: DataFrame, items: DataFrame, window: int = WINDOW, max_share: float = MAX_SHARE) -> DataFrame:
    """Documents without their hit spans; those with more than max_share of their words hit go as a whole.

    All columns stay; n_chars follows the text where there is such a column.  Where a cut brings the parts of a passage
    together they are cut too, so `find_hits` finds nothing in the result.  With several blocks of items the spans
    of all of them are found in the whole text first and cut together, and the texts are read again until no block has a
    hit.  Null texts and repeated rows stay; an empty table stays empty.
    """
    names = documents.columns
    where = names.index("text"), names.index("n_chars") if "n_chars" in names else None, max_share, len(names)
    shared = blocks(items, window)
    if len(shared) == 1:
        return documents.mapInArrow(_cut(_look_up(shared[0]), True, *where), documents.schema)
    own = "_h" + "_" * max(map(len, names))  # longer than any name of the documents
    now = documents
    while True:
        each = materialised(_found(now.select("doc_id", "text"), shared).filter(F.size("spans") > 0))
        if each.isEmpty():
            return now
        spans = _gathered(each).select(*[F.col(c).alias(own + c) for c in ("doc_id", "digest", "spans")])
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(own + "doc_id")) & (F.xxhash64("text") == F.col(own + "digest"))
        rows = now.join(spans, same, "left").select(*names, own + "spans")
        now = materialised(rows.mapInArrow(_cut(_marked, False, *where), documents.schema))
