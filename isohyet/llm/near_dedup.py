"""Operator 1: MinHash near-duplicates by a multi-index Hamming join.

A document's signature has POSITIONS minima of hashed shingles, each cut to 8 bits.
Signatures are split into CHUNKS chunks.  By the pigeonhole principle two signatures
that differ in at most CHUNKS * (ERRORS + 1) - 1 positions agree in some chunk up to
ERRORS positions, so with ERRORS = 1 every chunk is indexed once for each position left out: all pairs
under that distance share a key.  At a similarity of 0.85 the distance has mean 9.6 and
standard deviation 2.9, far below the 21 guaranteed here.  Below LINK_PERCENT the WIDE scheme guarantees 29: at 0.8 the
mean is 12.8 and the standard deviation 3.2.

Equal shingle sets are one class and enter once.  Within each key, signatures are compared and a
spanning forest of the pairs under the distance goes on; its components are the candidate groups.  Groups are then
compared on full sets in blocks, and again only a spanning forest of the confirmed links is
emitted, so rows stay linear while every link has been looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import Forest, components, materialised, mix, shingle_set, sliced, sorted_groups

SHINGLE = 5
POSITIONS, CHUNKS, ERRORS = 64, 11, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1  # at LINK_PERCENT and above
WIDE = (10, 2)  # chunks and errors for links below LINK_PERCENT
BUCKET_BLOCK = 2048  # signatures of a key that are compared at once
SET_BLOCK = 262_144  # shingles of a candidate group that are compared at once
LINK_PERCENT = 85

FACTORS = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)


def _distance(chunks: int, errors: int) -> int:
    """The signature distance up to which all pairs share a key."""
    return chunks * (errors + 1) - 1


def signature(hashes: np.ndarray) -> bytes:
    least = np.full(POSITIONS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        for i in range(POSITIONS):
            least[i] = min(least[i], (part * FACTORS[i]).min())
    return (mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        out: list[list] = [[], [], [], []]
        for text in batch.column("text").to_pylist():
            s = shingle_set(text, SHINGLE)
            row = (len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
            for column, x in zip(out, (*row, signature(s) if len(s) else None), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
            ["doc_id", "n_shingles", "h1", "h2", "sig"],
        )


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, set size, 128-bit digest of the set (h1, h2), signature; one row per document."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_signatures, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _keys(chunks: int, errors: int):
    bounds = np.linspace(0, POSITIONS, chunks + 1).round().astype(int)
    left_out = [(c, n, out) for c in range(chunks) for n, out in enumerate(combinations(range(bounds[c], bounds[c + 1]), errors))]

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every chunk once for each choice of positions left out: chunk, choice and the other bytes in 64 bits."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(n, POSITIONS).astype(np.uint64)
            keys = np.empty((len(left_out), n), np.uint64)
            for i, (c, choice, out) in enumerate(left_out):
                key = np.full(n, (c << 8) | choice, np.uint64)
                for p in range(bounds[c], bounds[c + 1]):
                    if p not in out:
                        key = (key << np.uint64(8)) | sig[:, p]
                keys[i] = key
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(ids, len(left_out)))], ["key", "id"])

    return keys_of


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key has more than one row, with the block of the key they fall in; input is sorted by key."""
    held_key = held_id = None
    run = 0  # rows of held_key before the held row

    def rows(keys, ids, at):
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(at // BUCKET_BLOCK, pa.int32())], ["key", "id", "block"]
        )

    for batch in batches:
        key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        if held_key is not None:
            key, ids = np.concatenate([[held_key], key]), np.concatenate([[held_id], ids])
        if not len(key):
            continue
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        at = np.arange(len(key)) - first + np.where(first == 0, run, 0)
        keep = (at > 0) | np.concatenate([key[1:] == key[:-1], [False]])
        keep[-1] = False  # the last row waits for the next batch
        if keep.any():
            yield rows(key[keep], ids[keep], at[keep])
        held_key, held_id, run = key[-1], ids[-1], int(at[-1])
    if held_key is not None and run:
        yield rows([held_key], [held_id], np.array([run]))


def _far(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (sig != other).sum(-1)


def _forest_of_bucket(sig: np.ndarray, block: np.ndarray, lo: int, hi: int, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs within the distance between two blocks of a key."""
    left = np.flatnonzero(block == lo)
    right = np.flatnonzero(block == hi)
    forest, edges = Forest(len(sig)), []
    for i in left:
        near = right[_far(sig[right], sig[i]) <= distance]
        for j in near.tolist():
            if i != j and forest.join(int(i), j):
                edges.append((int(i), j))
    return edges


def _near(distance: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges (a, b) of the spanning forests; input is sorted by key, lo, hi."""

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def solve(rows: pa.Table):
            ids = rows.column("id").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, POSITIONS)
            key, block = rows.column("key").to_numpy(), rows.column("block").to_numpy()
            lo, hi = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
            new = np.ones(len(ids), bool)
            new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            far = _far(sig, sig[first]) > distance
            odd = np.zeros(len(ids), bool)
            odd[first[far | (lo != hi)]] = True  # not a star around the first: all pairs are compared
            star = ~odd[first] & ~new
            yield out(ids[first[star]], ids[star])
            ends = np.append(np.flatnonzero(new)[1:], len(ids))
            a, b = [], []
            for s, e in zip(np.flatnonzero(new), ends, strict=True):
                if odd[s] and e - s > 1:
                    for i, j in _forest_of_bucket(sig[s:e], block[s:e], lo[s], hi[s], distance):
                        a.append(ids[s + i])
                        b.append(ids[s + j])
            if a:
                yield out(a, b)

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, lo, hi = (batch.column(c).to_numpy() for c in ("key", "lo", "hi"))
            same = (key == key[-1]) & (lo == lo[-1]) & (hi == hi[-1])
            cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if held and cut:
                yield from solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from solve(pa.Table.from_batches([batch.slice(0, cut)]))
            elif held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("key", "lo", "hi")):
                yield from solve(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from solve(pa.Table.from_batches(held))

    return near


def candidate_edges(classes: DataFrame, scheme: tuple[int, int] = (CHUNKS, ERRORS)) -> DataFrame:
    """Edges (a, b) that connect all classes (id, sig) whose signatures are within the scheme's distance."""
    keys = classes.select("id", "sig").mapInArrow(_keys(*scheme), "key long, id long")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared, "key long, id long, block int")
    shared = materialised(shared)
    large = shared.filter("block > 0").groupBy("key").agg(F.max("block").alias("last"))
    blocks = shared.join(large, "key", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))))
    pairs = blocks.select("key", "id", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    rows = pairs.join(classes.select("id", "sig"), "id")
    near = rows.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_near(_distance(*scheme)), "a long, b long")
    return near


def _link_matrix(sets: list[np.ndarray], rows: list[int], columns: list[int], percent: int) -> np.ndarray:
    """Which pairs of rows x columns have 100 * intersection >= percent * union."""
    a, b = [sets[i] for i in rows], [sets[i] for i in columns]
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    both = np.zeros((len(a), len(b)), np.float32)

    def incidence(group: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(group), len(part)), np.float32)
        for i, s in enumerate(group):
            at = np.searchsorted(part, s)
            at[at == len(part)] = 0
            out[i, at[part[at] == s]] = 1
        return out

    for at in range(0, len(common), 16_384):
        part = common[at : at + 16_384]
        both += incidence(a, part) @ incidence(b, part).T
    both = both.astype(np.int64)
    return 100 * both >= percent * (na[:, None] + nb[None, :] - both)


def set_links(sets: list[np.ndarray], left: list[int], right: list[int], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between left and right (or within one list, if both are the same)."""
    forest, edges = Forest(len(sets)), []
    size = 256
    for i in range(0, len(left), size):
        for j in range(i if left is right else 0, len(right), size):
            rows, columns = left[i : i + size], right[j : j + size]
            for x, y in np.argwhere(_link_matrix(sets, rows, columns, percent)).tolist():
                if rows[x] != columns[y] and forest.join(rows[x], columns[y]):
                    edges.append((rows[x], columns[y]))
    return edges


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["grp", "lo", "hi"]):
            ids, block = rows.column("id").to_pylist(), rows.column("block").to_pylist()
            digest, lo, hi = rows.column("h1").to_pylist(), rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
            sets = [shingle_set(t, SHINGLE) for t in rows.column("text").to_pylist()]
            own = [i for i, s in enumerate(sets) if int(s.sum(dtype=np.uint64).view(np.int64)) == digest[i]]
            left = [i for i in own if block[i] == lo]
            right = left if lo == hi else [i for i in own if block[i] == hi]
            if left and right and (edges := set_links(sets, left, right, percent)):
                yield pa.RecordBatch.from_arrays([pa.array([ids[e[k]] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return confirm


def links(documents: DataFrame, classes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all classes of a candidate group with a confirmed link."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = groups.select("id", F.col("component").alias("grp")).join(classes.select("id", "n_shingles", "h1"), "id")
    sizes = members.groupBy("grp").agg(F.ceil(F.sum("n_shingles") / SET_BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    text = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    rows = text.join(dealt, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "h1", "text")
    rows = rows.repartition(parts, "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")
    return rows.mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(documents: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link if 100 * intersection >= percent * union of their 5-word shingle sets.
    A null or word-less text has an empty set and links with nothing.  Rows with equal text are one class; a
    repeated row is returned as often as it comes in.  A null doc_id takes no part in
    links: its component_id is null and it is kept.  Extra columns are ignored.
    """
    return _marked(documents, signatures(documents), percent)


def _marked(documents: DataFrame, sigs: DataFrame, percent: int, *names: str) -> DataFrame:
    sigs = materialised(sigs)
    usable = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialised(
        usable.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    )
    # a doc_id that is repeated with several texts stands for each of them, so its classes are compared as one node
    nodes = classes
    groups = components(candidate_edges(nodes, (CHUNKS, ERRORS) if percent >= LINK_PERCENT else WIDE))
    found = components(links(documents, nodes, groups, percent))
    named = classes.join(found, "id", "left").filter("copies > 1 OR component IS NOT NULL")
    named = named.select("n_shingles", "h1", "h2", F.coalesce("component", "id").alias("component_id"))
    out = sigs.drop("sig").join(named, ["n_shingles", "h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", *names, "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _named_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures with the digest of the raw text."""
    for batch in sliced(batches):
        for out in _signatures(iter([batch])):
            yield pa.RecordBatch.from_arrays([*out.columns, batch.column("digest")], [*out.schema.names, "digest"])


def dedup(documents: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """The documents that stay: of each component those with its smallest doc_id, each text of a doc_id once.

    A doc_id that comes with several texts keeps those that are no copies of an earlier document.  Rows with a null doc_id all
    stay.  All columns stay as they are.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("digest"))
    sigs = rows.mapInArrow(_named_signatures, "doc_id long, n_shingles long, h1 long, h2 long, sig binary, digest long")
    kept = _marked(documents, sigs, percent, "digest").filter("kept AND doc_id IS NOT NULL")
    own = "_k" + "_" * max(map(len, documents.columns))  # longer than any name of the documents
    kept = kept.select(F.col("doc_id").alias(own + "id"), F.col("digest").alias(own + "text")).distinct()
    named = documents.filter(F.col("doc_id").isNotNull()).withColumn(own + "digest", F.xxhash64("text"))
    same = (named["doc_id"].cast("long") == kept[own + "id"]) & (named[own + "digest"] == kept[own + "text"])
    stay = named.join(kept, same, "left_semi").dropDuplicates(["doc_id", own + "digest"]).drop(own + "digest")
    return stay.unionByName(documents.filter(F.col("doc_id").isNull()))
