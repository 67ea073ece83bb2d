"""Operator 12 against brute force: the hash is minimal and perfect, strangers never pass for members, one row of each text stays."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from isohyet.llm import exact_dedup

DOCS = "doc_id long, text string, digest string, row long, bucket string, DIGEST_of_text string, keep_id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, "clash", "clash", -1) for i, t in rows], DOCS)


def raw(texts):
    return np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest() for t in texts), np.uint8).reshape(-1, 32)


@pytest.mark.parametrize("n", [0, 1, 2, 77, 5000])
def test_slots_are_minimal_and_perfect(n):
    members = raw([f"m{i}" for i in range(n)])
    slots = exact_dedup.Slots(*exact_dedup.build_levels(members))
    assert sorted(slots(members)) == list(range(n))
    others = slots(raw([f"o{i}" for i in range(1000)]))
    assert others.min() >= -1 and others.max() < max(n, 1)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = True
        for i in ids:
            out.append((i, keep, len(ids), left and i == keep, hashlib.sha256(t.encode()).hexdigest()))
            left = left and i != keep
    return out


def cases(seed):
    r = random.Random(seed)
    rows = [(i, f"text {r.randrange(300)}") for i in range(900)]
    rows += [(1000 + i, "a third of all rows") for i in range(500)]
    rows += [(5, None), (6, ""), (None, "text 1"), (None, "only here"), (None, "only here"), (2000, "text 3"), (2000, "text 3"), (2000, "text 4"), (3000, "x" * 200_000)]
    r.shuffle(rows)
    return rows


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("bucket", [16, 8192])
def test_exact_duplicates_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(exact_dedup, "BUCKET", bucket)
    rows = cases(bucket)
    got = exact_dedup.exact_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_dedup_keeps_every_text_once(spark):
    rows = cases(1)
    docs = frame(spark, rows)
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"] or "") for r in out.collect()]
    want = defaultdict(lambda: -1)
    for i, t in rows:
        want[t or ""] = max(want[t or ""], -1 if i is None else i)
    assert sorted((t, -1 if i is None else i) for i, t in got) == sorted(want.items())


def test_lookup_of_later_documents(spark, tmp_path):
    old = frame(spark, [(i, f"t{i % 40}") for i in range(100)])
    exact_dedup.build_index(exact_dedup.winners(exact_dedup.digests(old))).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    new = frame(spark, [(200 + i, f"t{20 + i % 50}") for i in range(100)] + [(500, None)])
    assert sorted((r["text"] or "", r["doc_id"]) for r in exact_dedup.unseen(new, index).collect()) == sorted(
        [("", 500)] + [(f"t{k}", max(200 + i for i in range(100) if 20 + i % 50 == k)) for k in range(40, 70)]
    )
    totals = exact_dedup.lookup(index, exact_dedup.winners(exact_dedup.digests(new))).collect()
    assert sum(r["n"] for r in totals) == 201 and sum(r["repeats"] for r in totals) == 40
    assert sum(r["slot"] >= 0 for r in totals) == 40
    empty = exact_dedup.build_index(exact_dedup.winners(exact_dedup.digests(old.limit(0))))
    assert exact_dedup.unseen(new, empty).count() == 51


def test_empty_table(spark):
    docs = frame(spark, [(1, "a")]).filter("false")
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.dedup(docs).count() == 0
