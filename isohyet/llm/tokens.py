"""Token ids of texts, and operator 5: the exact histogram of encoded lengths."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from isohyet.llm.common import kept_in_worker, materialised, sliced

VOCABULARY = "byte_bpe_50k.tiktoken"
END_ID = 2
SPECIAL_TEXT, SPECIAL_ID = "<|endoftext|>", 50256  # the JSON file's one added token; the file of ranks has none
BLOCK = 1 << 23  # characters of texts whose words are looked up together; a longer text is a block of its own

_THREE_SPACES = re.compile(r"\s\s\s")


class Encoder:
    """Byte-level BPE over a public vocabulary of ranks (the same ids as the JSON file of that name).

    SPECIAL_TEXT is one id wherever it stands, as that file has it.  Words repeat, so the distinct words of a block of texts are
    encoded once.  A space before a word always begins a new
    pre-token, so a text may be cut there; only in runs of three or more white-space characters may a
    pre-token span such a cut, and those texts are encoded as a whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = len(ranks)
        self._encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._bytes[list(ranks.values())] = [len(token) for token in ranks]

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return next(self.each([text])).tobytes()

    def each(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        block, size = [], 0
        for text in texts:
            if block and size + len(text) > BLOCK:
                yield from self._block(block)
                block, size = [], 0
            block.append(text)
            size += len(text)
        if block:
            yield from self._block(block)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._encode(text), "<u4")

    def _whole(self, text: str) -> np.ndarray:
        first, *rest = map(self._ids, text.split(SPECIAL_TEXT))
        return np.concatenate([first, *(x for part in rest for x in (np.array([SPECIAL_ID], "<u4"), part))])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words behind a space each, one after the other, and how many each has.

        Words that neither begin nor end in white space are encoded as one text and cut by their bytes, as a call costs more than a word.
        """
        alone = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(words), words), pc.equal(words, "")).to_numpy(zero_copy_only=False)
        count, inner = np.zeros(len(words), np.int64), words.filter(pa.array(~alone))
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(inner)], inner), pa.scalar(" ", words.type))[0].as_py()
        joined = self._ids(" " + text if text else "")
        ends = np.cumsum(pc.binary_length(inner).to_numpy(zero_copy_only=False) + 1)
        count[~alone] = np.diff(np.searchsorted(np.cumsum(self._bytes[joined]), ends) + 1, prepend=0)
        single = {i: self._ids(" " + words[i].as_py()) for i in np.flatnonzero(alone).tolist()}
        count[list(single)] = [len(x) for x in single.values()]
        ids = np.empty(count.sum(), "<u4")
        apart = np.repeat(alone, count)
        ids[~apart] = joined
        ids[apart] = np.concatenate([*single.values(), np.zeros(0, "<u4")])
        return ids, count

    def _block(self, texts: list[str]) -> Iterator[np.ndarray]:
        whole = [SPECIAL_TEXT in t or _THREE_SPACES.search(t) is not None for t in texts]
        firsts = [self._whole(t) if w else self._ids(t.partition(" ")[0]) for t, w in zip(texts, whole, strict=True)]
        cut = pc.split_pattern(pa.array(["" if w else t for t, w in zip(texts, whole, strict=True)], pa.large_string()), " ")
        offsets, words = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        ids, count = self._words(words.dictionary)
        # the first word of a text has no space before it, so each is an entry of its own
        codes = words.indices.to_numpy().astype(np.int64)
        codes[offsets[:-1]] = len(count) + np.arange(len(texts))
        ids, count = np.concatenate([ids, *firsts]), np.concatenate([count, [len(x) for x in firsts]])
        start, own = np.cumsum(count) - count, count[codes]
        after = np.cumsum(own)
        at = np.repeat(start[codes] - (after - own), own)
        at += np.arange(len(at))
        out = ids[at]
        borders = after[offsets[1:] - 1].tolist()
        for a, b in zip([0, *borders], borders):
            yield out[a:b]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """One encoder per worker and file; the file is an installed one, the same on all machines."""
    return kept_in_worker(("encoder", path), lambda: Encoder(path if os.path.isabs(path) else vocabulary_path(path)))


def _lengths(vocabulary: str):
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in sliced(batches):
            n = np.array([len(ids) + 1 for ids in encode.each(t or "" for t in b.column("text").to_pylist())], np.int64)
            length, documents = np.unique(n, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(documents)], ["length", "documents"])

    return lengths


def length_histogram(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, documents): how many documents have so many ids, the end id included; a null text counts as empty."""
    each = documents.select("text").mapInArrow(_lengths(vocabulary), "length long, documents long")
    return each.groupBy("length").agg(F.sum("documents").alias("documents"))


def suffix_sums(histogram: DataFrame, band: int = 256) -> DataFrame:
    """Per length: documents and tokens at least that long, and the tokens left if all are cut there.

    The histogram is kept once.  Sums run inside bands of about `band` lengths each and over the bands' totals; borders are
    quantiles of the lengths, so no task sees all lengths however unevenly they lie.  An empty histogram has no rows;
    a length must stand in one row only, as length_histogram gives it.
    """
    kept = materialised(histogram.select("length", "documents"))
    bands = max(1, -(-kept.count() // band))
    at = F.lit([i / bands for i in range(1, bands)]).cast("array<double>")
    borders = kept.agg(F.percentile_approx("length", at, 100 * bands)).first()[0] if bands > 1 else []
    # the first border that a length does not exceed
    which = F.size(F.filter(F.lit(sorted(set(borders or []))).cast("array<bigint>"), lambda x: x < F.col("length")))
    h = kept.withColumn("band", which).withColumn("tokens", F.col("length") * F.col("documents"))
    totals = h.groupBy("band").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    totals = totals.select(
        "band", F.coalesce(F.sum("d").over(above), zero).alias("d_above"), F.coalesce(F.sum("t").over(above), zero).alias("t_above"),
        F.coalesce(F.sum("d").over(below), zero).alias("d_below"), F.coalesce(F.sum("t").over(below), zero).alias("t_below"),
    )
    up = Window.partitionBy("band").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("band").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(totals, "band").select(
        "length", "documents", "tokens",
        (F.sum("documents").over(up) + F.col("d_above")).alias("documents_from"), (F.sum("tokens").over(up) + F.col("t_above")).alias("tokens_from"),
        (F.coalesce(F.sum("documents").over(down), zero) + F.col("d_below")).alias("documents_below"),
        (F.coalesce(F.sum("tokens").over(down), zero) + F.col("t_below")).alias("tokens_below"),
    )
    return out.withColumn("truncated_tokens", F.col("tokens_below") + F.col("length") * F.col("documents_from"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: documents and tokens in all, documents longer, tokens left when cut.

    Each is read from the suffix sums of the first length beyond the limit, in one pass for all limits; nothing is summed again.
    """
    wanted = sorted(set(limits))
    sums_at = F.struct("documents_from", "tokens_below")
    beyond = [F.min_by(sums_at, F.when(F.col("length") > x, F.col("length"))).alias(f"_{i}") for i, x in enumerate(wanted)]
    one = sums.agg(
        F.max(F.col("documents_below") + F.col("documents_from")).alias("documents"), F.max(F.col("tokens_below") + F.col("tokens_from")).alias("tokens"), *beyond
    )

    def row(i: int, x: int):
        first, limit = F.col(f"_{i}"), F.lit(x).cast("bigint")
        cut = F.coalesce(first["tokens_below"] + limit * first["documents_from"], F.col("tokens"), F.lit(0).cast("bigint"))
        longer = F.coalesce(first["documents_from"], F.lit(0).cast("bigint"))
        return F.struct(limit.alias("context_limit"), F.col("documents").alias("documents"), F.col("tokens").alias("tokens"), longer.alias("longer"), cut.alias("truncated_tokens"))

    return one.select(F.inline(F.array(*[row(i, x) for i, x in enumerate(wanted)])))


def length_quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least this share of the documents does not exceed."""
    reached = (F.col("documents_below") + F.col("documents")) >= F.lit(share) * (F.col("documents_below") + F.col("documents_from"))
    return sums.filter(reached).agg(F.min("length").alias("length"))
