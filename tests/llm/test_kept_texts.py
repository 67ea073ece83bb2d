"""No text is lost and none is left: doc_ids that come with several texts, passages split by others, clashing columns."""

import random

import pytest

from isohyet.llm import decontaminate, near_dedup, passages, secrets


def words(seed, n, size=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def test_dedup_keeps_every_text_of_a_repeated_doc_id(spark):
    a, b, c = (" ".join(words(s, 60)) for s in (1, 2, 3))
    rows = [(1, a), (2, a), (2, b), (3, b), (2, b), (4, c), (4, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, _kept_id long, digest string")
    out = near_dedup.dedup(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in out.collect())
    assert got == sorted([(1, a), (2, b), (4, c), (4, ""), (0, a), (0, a)])


@pytest.mark.parametrize("items_per_block", [None, 40])
def test_what_a_cut_brings_together_is_cut(spark, monkeypatch, items_per_block):
    first, second = words(11, 30), words(12, 30)
    own = words(13, 200)
    split = [*first[:9], *second, *first[9:18], *own]
    twice = [*first[:5], *second[:5], *first[:12], *second[5:], *first[5:], *own]
    docs = spark.createDataFrame([(1, " ".join(split), 0), (2, " ".join(own), 0), (2, " ".join(split), 0), (3, " ".join(twice), 0), (4, None, 0)], "doc_id long, text string, _hdoc_id int")
    items = spark.createDataFrame([("A", " ".join(first)), ("B", " ".join(second))], "item_id string, text string")
    if items_per_block:
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", items_per_block)
        assert len(decontaminate.blocks(items)) > 1
    out = decontaminate.remove_hits(docs, items)
    assert out.columns == docs.columns and out.count() == 5
    assert decontaminate.find_hits(out, items).filter("size(spans) > 0").count() == 0
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (1, " " + " ".join(own)) in {(i, t if t is None else " " + " ".join(t.split())) for i, t in got} and (4, None) in got


def test_passages_of_one_text_leave_the_others_whole(spark):
    shared = ". ".join(" ".join(words(s, 12)) for s in range(20, 24)) + "."
    own = " ".join(words(30, 40)) + "."
    other = " ".join(words(31, 60)) + "."
    rows = [(1, f"{shared} One."), (2, f"{own} {shared}"), (2, f"{other} {shared} {own}x"), (3, None)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, copy int, _spans string")
    for find in (passages.repeated_passages, lambda d: passages.shared_passages(d, 20)):
        out = passages.remove_passages(docs, find(docs))
        assert out.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        texts = " ".join(t for i, t in got if i == 2)
        assert len(got) == 4 and (1, rows[0][1]) in got and (3, None) in got
        assert all(part[:-1] in texts for part in (own, other)) and " ".join(words(21, 12)) not in texts


def test_redact_with_clashing_columns(spark):
    rows = [(1, "password = abcdef123 and more"), (1, "nothing here"), (2, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "mine", "yours", 0) for i, t in rows], "doc_id long, text string, _g_found string, _joined string, n_chars int")
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    out = sorted(got.collect(), key=str)
    assert all((r["_g_found"], r["_joined"]) == ("mine", "yours") for r in out)
    assert sorted((r["doc_id"], r["text"] or "") for r in out) == sorted([(1, "[SECRET] and more"), (1, "nothing here"), (2, ""), (2, "")])
