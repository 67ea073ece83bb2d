"""Operator 8: language identification by prediction by partial matching.

Each language has a context tree over bytes of order ORDER with escape method C and full exclusions.  A tree is its counts
of all (ORDER + 1)-byte strings of the learning texts, all of which are kept; frozen, they give the exact code length of every
byte after its context.  Spark works these out for the strings that occur in the documents, one task per context's last two bytes and
block of languages, and brings them to the documents, which travel in parts of bounded size.  Neither the counts nor the trees come to the
driver, and any number of languages works in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import materialised

ORDER = 3
START = b"\n" * ORDER  # stands before every text
LANGUAGES = 64  # languages that are scored at a time
CHUNK_BYTES = 1 << 22  # texts are counted and scored in batches of about so many bytes
LEVEL = 12  # of compression: documents are written twice
PART_BYTES = 1 << 25  # documents that meet the code lengths of their strings in one task


def _strings(texts: Sequence[bytes]) -> np.ndarray:
    """The 4-byte string that ends at each byte of the texts, as numbers, in their order."""
    data = np.frombuffer(b"".join(START + t for t in texts), np.uint8).astype(np.uint32)
    gram = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    # strings that run into the next text's start marks are left out
    ends = np.cumsum([len(t) + ORDER for t in texts])
    inside = np.ones(len(gram), bool)
    for k in range(ORDER):
        at = ends[:-1] - ORDER + k
        inside[at[at < len(gram)]] = False
    return gram[inside]


def _gram_counts(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_strings(texts), return_counts=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[int, int]] = {}

    def rows():
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts)), pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["lang", "gram", "n"]
            )

    def add(lang: str, texts: list[bytes]) -> None:
        counts = held.setdefault(lang, {})
        for g, n in zip(*(x.tolist() for x in _gram_counts(texts)), strict=True):
            counts[g] = counts.get(g, 0) + n

    for b in batches:
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] > CHUNK_BYTES:
                add(lang, waiting.pop(lang))
                sizes.pop(lang)
        for lang, texts in waiting.items():
            add(lang, texts)
        if sum(map(len, held.values())) > 1_000_000:
            yield from rows()
            held = {}
    yield from rows()


def gram_counts(learning: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each 4-byte string occurs in the texts of a language; all texts, whole."""
    rows = learning.filter("text <> '' AND lang IS NOT NULL").select("lang", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def code_lengths(counts: Sequence[np.ndarray]) -> np.ndarray:
    """Bits of every byte, from counts of the bytes after contexts of rising order, each the end of the next.

    Arrays are (contexts, 256), or (1, 256) where all contexts share it.  From the longest context down, a byte that was seen costs
    its share; others cost an escape and are looked for below among the bytes not seen yet.
    """
    unknown = 256 - np.count_nonzero(counts[0], axis=1)[:, None]
    bits = np.log2(np.maximum(unknown, 1.0))
    for order, n in enumerate(counts):
        longer = counts[order + 1] > 0 if order + 1 < len(counts) else False
        new = (n > 0) & ~np.asarray(longer)
        distinct = new.sum(1, keepdims=True)
        total = np.maximum((n * new).sum(1, keepdims=True) + distinct, 1.0)
        own = np.log2(total) - np.log2(np.maximum(n, 1.0))
        escape = np.where(distinct > 0, np.log2(total) - np.log2(np.maximum(distinct, 1.0)), 0.0)
        bits = np.where(new, own, escape + bits)
    return bits


class Short:
    """Counts of single bytes and of pairs of bytes per language: at most 65,536 numbers each."""

    def __init__(self, rows: pa.Table):
        k, pair, n = (rows[c].to_numpy() for c in ("k", "pair", "n"))
        order = np.lexsort((pair, k))
        self.key, self.n = (k[order].astype(np.int64) << 16) | pair[order], n[order]

    def _between(self, low: int, high: int) -> np.ndarray:
        a, b = np.searchsorted(self.key, (low, high))
        return np.bincount(self.key[a:b] & 255, weights=self.n[a:b], minlength=256)[None]

    def after(self, k: int, byte: int) -> np.ndarray:
        return self._between(k << 16 | byte << 8, (k << 16 | byte << 8) + 256)

    def anywhere(self, k: int) -> np.ndarray:
        return self._between(k << 16, (k + 1) << 16)


def _costs(short, languages: int):
    """Code lengths of the wanted strings of one pair of bytes under one block of languages."""

    def run(key, wanted: pa.Table, known: pa.Table) -> pa.Table:
        first, pair = key[0].as_py() * LANGUAGES, key[1].as_py()
        grams = wanted["gram"].to_numpy()
        rows, at = np.unique(grams >> 24, return_inverse=True)
        place = np.full(256, -1)
        place[rows] = np.arange(len(rows))
        k, string, n = (known[c].to_numpy() for c in ("k", "gram", "n"))
        begin, byte = place[string >> 24], string & 255
        out = np.empty((len(grams), min(LANGUAGES, languages - first)), np.float32)
        for j in range(out.shape[1]):
            mine = k == first + j
            both = np.bincount(byte[mine], weights=n[mine], minlength=256)[None]
            here = mine & (begin >= 0)
            longest = np.zeros((len(rows), 256))
            longest[begin[here], byte[here]] = n[here]
            bits = code_lengths([short.value.anywhere(first + j), short.value.after(first + j, pair & 255), both, longest])
            out[:, j] = bits[at, grams & 255]
        lists = pa.ListArray.from_arrays(np.arange(len(grams) + 1, dtype=np.int32) * out.shape[1], pa.array(out.ravel()))
        return pa.table({"block": pa.array(np.full(len(grams), key[0].as_py()), pa.int32()), "gram": pa.array(grams, pa.int64()), "bits": lists})

    return run


def gram_costs(counts: DataFrame, wanted: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(block, gram, bits): code length of each wanted string's last byte under the block's languages, from (lang, gram, n)."""
    spark = counts.sparkSession
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(languages)), "k int, lang string"))  # one row per language
    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).cast("int")
    known = counts.join(numbers, "lang").select("k", F.floor(F.col("k") / LANGUAGES).cast("int").alias("block"), pair.alias("pair"), "gram", "n")
    # at most 65,536 numbers per language
    short = known.groupBy("k", F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    blocks = (len(languages) + LANGUAGES - 1) // LANGUAGES
    asked = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), pair.alias("pair"), "gram")
    run = _costs(spark.sparkContext.broadcast(Short(short)), len(languages))
    met = asked.groupBy("block", "pair").cogroup(known.groupBy("block", "pair"))
    return met.applyInArrow(lambda key, a, b: _some(run, key, a, b), "block int, gram long, bits array<float>")


def _some(run, key, wanted: pa.Table, known: pa.Table) -> pa.Table:
    """Contexts that no document asks for are passed over."""
    if not wanted.num_rows:
        return pa.table({"block": pa.array([], pa.int32()), "gram": pa.array([], pa.int64()), "bits": pa.array([], pa.list_(pa.float32()))})
    return run(key, wanted, known)


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


PACKED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("number", pa.int64()), ("text", pa.string())])


def _packed(rows: list[tuple]) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, PACKED, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PACKED, strict=True)], schema=PACKED))
    return out.getvalue().to_pybytes()


def _unpacked(docs: bytes) -> pa.Table:
    return pa.ipc.open_stream(docs).read_all()


def _parts(part_bytes: int):
    """(part, docs): documents packed by about CHUNK_BYTES, with their numbers in their part of about part_bytes of one task's texts.

    Texts without a letter become null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, held, rows, number = TaskContext.get().partitionId() << 32, 0, 0, [], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([_packed(rows)], pa.binary())], ["part", "docs"])

        for b in batches:
            for doc_id, held_out, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                if not text or not _has_letter(text):
                    text = None
                rows.append((doc_id, held_out, number, text))
                number += 1
                held += len(text or "") + 16
                if held > min(CHUNK_BYTES, part_bytes):
                    yield packed()
                    size, held, rows = size + held, 0, []
                    if size > part_bytes:
                        part, size, number = part + 1, 0, 0
        if rows:
            yield packed()

    return run


def _chunks(texts: Sequence[str]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t.encode())
        size += len(chunk[-1])
        if size > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, grams): distinct strings of the documents of each part, as far as they follow each other."""
    part, found = None, np.empty(0, np.uint32)

    def row():
        grams = pa.ListArray.from_arrays(np.array([0, len(found)], np.int32), pa.array(found.view(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), grams], ["part", "grams"])

    for b in batches:
        for new, docs in zip(b.column("part").to_pylist(), b.column("docs"), strict=True):
            if part is not None and part != new:
                yield row()
                found = np.empty(0, np.uint32)
            part = new
            for chunk in _chunks([t for t in _unpacked(docs.as_buffer())["text"].to_pylist() if t]):
                found = np.union1d(found, _strings(chunk))
    if part is not None:
        yield row()


SCORED = "doc_id long, held_out boolean, part long, number long, lang string, bits double, mass double"


def _score(languages: Sequence[str]):
    """Best language of a block for each document of a part, its code length, and the block's odds relative to it."""

    def run(key, packed: pa.Table, costs: pa.Table) -> pa.Table:
        names = languages[key[1].as_py() * LANGUAGES :][:LANGUAGES]
        gram, first = np.unique(costs["gram"].to_numpy(), return_index=True)
        table = np.ascontiguousarray(costs["bits"].combine_chunks().flatten().to_numpy().reshape(-1, len(names))[first].T)
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "part": pa.int64(), "number": pa.int64(), "lang": pa.string(), "bits": pa.float64(), "mass": pa.float64()}
        out = [pa.table({c: pa.array([], k) for c, k in kinds.items()})]
        for docs in packed["docs"]:
            rows = _unpacked(docs.as_buffer())
            texts = rows["text"].to_pylist()
            use = [i for i, t in enumerate(texts) if t]
            best, bits, mass = np.full(len(texts), -1), np.full(len(texts), np.nan), np.full(len(texts), np.nan)
            done = 0
            for chunk in _chunks([texts[i] for i in use]):
                mine, done = use[done : done + len(chunk)], done + len(chunk)
                at = np.searchsorted(gram, _strings(chunk))
                begins = np.concatenate([[0], np.cumsum([len(t) for t in chunk])[:-1]])
                total = np.stack([np.add.reduceat(row[at].astype(np.float64), begins) for row in table], 1)
                best[mine], bits[mine] = total.argmin(1), total.min(1)
                mass[mine] = np.exp2(np.maximum(total.min(1)[:, None] - total, -1000.0)).sum(1)
            found = {"lang": [names[k] if k >= 0 else "und" for k in best.tolist()], "part": np.full(len(texts), key[0].as_py())}
            numbers = {"bits": pa.array(bits, from_pandas=True), "mass": pa.array(mass, from_pandas=True)}
            own = {c: rows[c] for c in ("doc_id", "held_out", "number")} | numbers | {c: pa.array(v, kinds[c]) for c, v in found.items()}
            out.append(pa.table({c: own[c] for c in kinds}))
        return pa.concat_tables(out)

    return run


def held_out(remainder: int, of: int):
    """Rows that are never learned from: crc32 of the id's text; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(True))


def identify(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the posterior with equal priors).

    Learns from text and non-null lang of the rows that are not held out, all of their strings.  `und` with score 0 if the text is
    null or has no letter, or if there is nothing to learn from.  Of equally short codes the smallest name wins.  Repeated rows and ids
    are scored each by itself.
    """
    rows = documents.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).withColumn("held_out", held_out(2, 4))
    counts = materialised(gram_counts(rows.filter("NOT held_out")))
    languages = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    # written once, so that a part is the same documents wherever it is read
    parts = materialised(rows.select("doc_id", "held_out", "text").mapInArrow(_parts(PART_BYTES), "part long, docs binary"))
    present = materialised(parts.mapInArrow(_present, "part long, grams array<int>"))
    unsigned = F.col("gram").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).alias("gram")
    present = present.select("part", F.explode("grams").alias("gram")).select("part", unsigned)
    costs = gram_costs(counts, present.select("gram").distinct(), languages)
    blocks = (len(languages) + LANGUAGES - 1) // LANGUAGES
    asked = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    brought = present.join(costs, "gram").select("part", "block", "gram", "bits")
    scored = asked.groupBy("part", "block").cogroup(brought.groupBy("part", "block")).applyInArrow(_score(languages), SCORED)
    # the best of all blocks, and the odds of every language relative to it
    each = scored.groupBy("part", "number").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.min(F.struct("bits", "lang")).alias("best"),
        F.collect_list(F.struct("bits", "mass")).alias("blocks"),
    )
    odds = F.aggregate("blocks", F.lit(0.0), lambda a, x: a + x["mass"] * F.pow(F.lit(2.0), F.greatest(F.col("best.bits") - x["bits"], F.lit(-1000.0))))
    return each.select("doc_id", "held_out", F.col("best.lang").alias("lang_pred"), F.coalesce(1.0 / odds, F.lit(0.0)).alias("score"))
