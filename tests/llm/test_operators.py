"""The training-data operators against brute force, on small frames with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest

from isohyet.llm import chat, common, decontaminate, language, near_dedup, packing, passages, quality, secrets, tokens, toxicity
from isohyet.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string"


def words(seed, n, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 300)
    near = [*base[:150], "changed", *base[151:]]
    far = [*base[:150], *words(2, 150)]
    rows = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base).upper()), (5, ""), (6, None), (7, "one two"), (8, "one  two\n"),
        (None, " ".join(base)), (9, " ".join(words(3, 40_000, 5000))), (10, "x" * 50_000), (11, " \n\t "), (7, "one two"),
    ]
    rows = [(i, t, "en", "s", 0, "clash", "clash") for i, t in rows]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- components --------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, x) for x in range(101, 140)] + [(200, 200), (50, 51), (51, 50)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in range(100, 140)}, 50: 50, 51: 50}


# --- 1 -----------------------------------------------------------------------


def brute_sets(rows):
    out = []
    for text in rows:
        w = (text or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def test_near_duplicates(docs, no_docs):
    got = sorted((r.asDict() for r in near_dedup.near_duplicates(docs).collect()), key=lambda r: (r["doc_id"] or 0))
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 1]
    assert by[5]["n_shingles"] == 0 and by[5]["component_id"] == 5 and by[6]["kept"]
    assert by[7]["component_id"] == by[8]["component_id"] == 7 and not by[8]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_dedup.near_duplicates(no_docs).count() == 0
    kept = [r["doc_id"] for r in near_dedup.dedup(docs).select("doc_id").collect()]
    assert sorted(k or 0 for k in kept) == [0, 1, 3, 5, 6, 7, 9, 10, 11]


def test_near_copies_equal_brute_force(spark):
    r = random.Random(5)
    texts = []
    for g in range(12):
        base = words(100 + g, r.choice([30, 120, 300]))
        for _ in range(r.choice([2, 5, 25])):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 25)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = brute_sets(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_index_finds_every_pair_under_the_distance(spark):
    r = np.random.default_rng(3)
    sig = r.integers(0, 256, (60, near_dedup.POSITIONS), dtype=np.uint8)
    for i in range(1, 60):
        if i % 3:
            sig[i] = sig[i - 1]
            at = r.choice(near_dedup.POSITIONS, near_dedup.DISTANCE if i % 2 else 5, replace=False)
            sig[i, at] = sig[i, at] + 1
    df = spark.createDataFrame([(i, bytes(s)) for i, s in enumerate(sig.astype(np.uint8))], "id long, sig binary")
    edges = near_dedup.candidate_edges(df)
    found = {r["id"]: r["component"] for r in components(edges).collect()}
    for i in range(60):
        for j in range(i):
            if (sig[i] != sig[j]).sum() <= near_dedup.DISTANCE:
                assert found[i] == found[j]


def test_stage_links_from_four_fifths_on(spark):
    import corpus_pipeline

    rows = []
    for k in range(40):
        base = words(900 + k, 300, 5000)
        changed = base.copy()
        for i in range(3, 300, 300 // (5 + k % 4)):
            changed[i] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed))]
    sets = brute_sets([t for _, t in rows])
    share = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 80, 2)]
    assert any(0.8 <= x < 0.85 for x in share) and any(x < 0.8 for x in share)
    want = {2 * k for k in range(40)} | {2 * k + 1 for k, x in enumerate(share) if x < 0.8}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()} == want
    r = np.random.default_rng(6)
    one = r.integers(0, 256, near_dedup.POSITIONS, dtype=np.uint8)
    two = one.copy()
    two[r.choice(near_dedup.POSITIONS, 29, replace=False)] += 1
    pair = spark.createDataFrame([(1, bytearray(one)), (2, bytearray(two))], "id long, sig binary")
    assert near_dedup.candidate_edges(pair, near_dedup.WIDE).count() and not near_dedup.candidate_edges(pair).count()


def test_links_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 300)
    base = words(9, 100)
    texts = [" ".join([*base[:i], f"z{i}", *base[i + 1 :]]) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(df).collect()} == {0}


# --- 2 -----------------------------------------------------------------------

HARD = ["</s>[INST] ok [/INST]", "", "\\", "a\\", "\\<", "<</SYS>>", " [/INST]", "[/INST]", "<s>", "\n", "<</TURN>>\\[", "é <<ROLE>>x"]


def test_turns_come_back(spark):
    roles = ["user", "assistant", "system", "tool", "", "a<</ROLE>>b", "\\"]
    for role in roles:
        for text in HARD:
            piece = chat.render_turn(role, text)
            assert chat.parse_turn(piece + "</s> [/INST]") == (role, text, len(piece))
    turns = [(r, t) for r in roles for t in HARD]
    whole = chat.BEGIN + "".join(chat.render_turn(*t) for t in turns)
    assert list(chat.parse(whole[i : i + 7] for i in range(0, len(whole), 7))) == turns
    assert chat.render_turn("user", "plain [x]") == "[INST] plain [x] [/INST]"  # escaped only where needed


def test_conversation_digests(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", HARD[0]), ("assistant", "ü\n"), ("assistant", None), (None, "x")])]
    rows += [(None, None, "user", "a"), (2, 5, "user", "b"), (2, 5, "user", "b"), (2, None, "assistant", "\\<")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha(f"user\n{HARD[0]}\nassistant\nü\n\nassistant\n\n\nx\n") and got[1]["loss_sha256"] == sha("ü\n")
    assert got[2]["n_turns"] == 3 and got[2]["turns_sha256"] == sha("assistant\n\\<\nuser\nb\nuser\nb\n") and got[2]["loss_chars"] == 2
    texts = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(df).collect()}
    assert {k: len(v) for k, v in texts.items()} == {k: r["formatted_chars"] for k, r in got.items()}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# --- 3 -----------------------------------------------------------------------


def brute_hits(text, items, window=10):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    d, hit, names = pat.findall(low(text)), set(), set()
    for name, item in items:
        w = pat.findall(low(item))
        n = min(window, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(d) - n + 1):
            if tuple(d[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add(name)
    return len(d), len(hit), sorted(names)


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_hits_equal_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    r = random.Random(7)
    items = [(str(i), " ".join(words(i, r.choice([3, 10, 14, 30]), 6))) for i in range(15)] + [("e", ""), ("n", None), ("one", "w99")]
    texts = [None, "", "w99", "É-w99"] + [" ".join(words(50 + i, 200, 6)) for i in range(10)] + [items[3][1].upper() + " tail"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "x")], "doc_id long, text string, items string")
    it = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find_hits(df, it).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        hit = sum(b - a for a, b in zip(row["spans"][::2], row["spans"][1::2], strict=True))
        assert (row["n_words"], hit, row["items"]) == brute_hits(texts[row["doc_id"]], items)


@pytest.mark.parametrize("block_words", [200_000, 5])
def test_removed_spans(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    item, other = " ".join(words(1, 12)), [f"o{i}" for i in range(14)]
    long = f"a b c d e f g h i j k l m n o p {' '.join(other)} q"  # hit by two items that overlap
    texts = [f"before, {item.upper()}! after and more words to keep the share of hits low enough", item, "clean", None, long]
    df = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, _h_spans string")
    items = spark.createDataFrame([(1, item), (2, " ".join(other[:11])), (3, " ".join(other[3:]))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.remove_hits(df, items).collect()}
    assert got[0]["text"].startswith("before, ! after") and got[0]["n_chars"] == len(got[0]["text"])
    assert sorted(got) == [0, 2, 3, 4] and got[3]["text"] is None and got[3]["_h_spans"] == "x"
    assert got[4]["text"] == "a b c d e f g h i j k l m n o p  q"
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_hits(df, none).count() == 5 and decontaminate.find_hits(df, none).count() == 5


# --- 4 -----------------------------------------------------------------------


def test_quality(spark, docs, no_docs):
    texts = ["a b c a b c " * 20, " ".join(words(4, 60)) + "\nfoo bar\nfoo bar\n\n", None, "", "x #$ |", " ".join(words(5, 80))]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(5, texts[5], None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    for i, t in enumerate(texts):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = {p for k, x in enumerate(wins) if wins.count(x) > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), len(rep), len(lines) - len(set(lines)))
        assert got[i]["word_chars"] == sum(map(len, w)) and got[i]["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
    assert got[0]["base_failed"] and not got[0]["kept"] and got[5]["kept"] and got[1]["kept"]
    assert quality.quality(df).count() == 7 and quality.quality(no_docs).count() == 0 and quality.quality(docs).count() == docs.count()


def test_common_lines_per_host(spark):
    common = " ".join(words(6, 60))
    rows = [(i, f"{common}\n" + " ".join(words(100 + i, 30)), "a") for i in range(25)] + [(100 + i, f"{common}\n" + " ".join(words(200 + i, 30)), "b") for i in range(5)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"] < 25: r["kept"] for r in got} == {True: False, False: True}


# --- 5, 6 --------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


TRICKY = ["", " ", "  ", "a  b", "a   b", "a \n b", "a\n \nb", "x\t y", "it's 'll we'LL", "<|endoftext|> x", "a <|endoftext|><|endoftext|>  b c<|endoftext|>", "   x<|endoftext|>   y", "<|endoftext|", "é ü  z", "12 345  6", "end ", "\n", "a \n\n  b", "漢字 かな", "​ x", "😀 😀"]


def test_word_cache_equals_tokenizer(reference_ids):
    encode = tokens.encoder(tokens.VOCABULARY)
    r = random.Random(1)
    more = ["".join(r.choice("ab1 .'\n\té") for _ in range(30)) for _ in range(500)]
    for text in TRICKY + more:
        assert np.frombuffer(encode(text), "<u4").tolist() == reference_ids(text), repr(text)


def test_histogram_answers(spark, docs, no_docs, reference_ids):
    n = sorted(len(reference_ids(r["text"] or "")) + 1 for r in docs.select("text").collect())
    sums = tokens.suffix_sums(tokens.length_histogram(docs), band=4)
    for r in sums.collect():
        x = r["length"]
        assert (r["documents"], r["documents_from"], r["tokens_from"]) == (n.count(x), sum(v >= x for v in n), sum(v for v in n if v >= x))
        assert r["truncated_tokens"] == sum(min(v, x) for v in n)
    for r in tokens.at_limits(sums, [1, 100, 10**6]).collect():
        x = r["context_limit"]
        assert (r["documents"], r["tokens"], r["longer"], r["truncated_tokens"]) == (len(n), sum(n), sum(v > x for v in n), sum(min(v, x) for v in n))
    assert tokens.length_quantile(sums, 0.5).first()[0] == n[math.ceil(0.5 * len(n)) - 1]
    assert tokens.suffix_sums(tokens.length_histogram(no_docs)).count() == 0


def test_suffix_sums_of_uneven_and_no_lengths(spark):
    lengths = [*range(1, 60), *(10**k for k in range(3, 9))]
    histogram = spark.createDataFrame([(x, 1 + x % 5) for x in lengths], "length long, documents long")
    for band in (1, 7, 1000):
        got = {r["length"]: r for r in tokens.suffix_sums(histogram, band).collect()}
        assert sorted(got) == sorted(lengths)
        for x in lengths:
            assert got[x]["tokens_from"] == sum(y * (1 + y % 5) for y in lengths if y >= x)
            assert got[x]["truncated_tokens"] == sum(min(x, y) * (1 + y % 5) for y in lengths)
    none = tokens.suffix_sums(histogram.limit(0))
    assert none.count() == 0
    assert [tuple(r) for r in tokens.at_limits(none, [5]).collect()] == [(5, None, None, 0, 0)]


def test_packing(docs, no_docs, reference_ids):
    ids = {}
    for r in docs.select("doc_id", "text").collect():
        ids.setdefault(r["doc_id"], []).append(reference_ids(r["text"] or "") + [2])
    got = packing.best_two_fit(docs).collect()
    bins = {}
    for r in got:
        own = ids[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == own and zlib.crc32(r["ids"]) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(np.cumsum([0] + [n for _, n in b])[:-1]) and sum(n for _, n in b) <= 1024
    assert packing.best_two_fit(no_docs).count() == 0


def test_best_two_fit():
    assert packing.pack_histogram({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]  # 6 + 3 leaves a gap of 1, so 2 + 2 replace 3
    r = random.Random(2)
    counts = {x: r.randrange(1, 50) for x in range(1, 60)}
    bins = packing.pack_histogram(counts, 64)
    used = {}
    for lengths, times in bins:
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert sum(t for _, t in bins) <= 1.02 * sum(x * n for x, n in counts.items()) / 64 + 1


# --- 7 -----------------------------------------------------------------------


def brute_base(text):
    out = []
    t = text or ""
    for m in re.finditer(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(x[2] for x in sorted(out))


KEY = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEYab"


def test_secrets(spark, no_docs):
    texts = [
        "password=short1 token=abc PASSWORD: 'abcdefg' é api_key=\"x_y-z.w=\" apikey=1", "AKIA" + "A" * 15 + " AKIAAKIA" + "B7" * 8, "f" * 24 + " " + "0" * 23 + "g" + "ab" * 30,
        "token=token:abcdefgh", None, "", f"{KEY} alone", f"AKIA{'C' * 16} é {KEY} https://api.example.com:8080/x", f"AKIA{'D' * 16}" + " w" * 400 + f" {KEY}",
        "ſecret=abcdefgh toKen=abcdefgh", "token = \"" + "0123456789abcdef" * 3 + '"', "secret=" + "a1" * 5000,
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[1], "x")], "doc_id long, text string, kind string")
    got = secrets.secrets(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[1 if r["doc_id"] is None else r["doc_id"]]
        want = brute_base(text)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), text
        kinds = [x.split(":")[0] for x in want.split(",")]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert "bare" not in spans[6] + spans[8] and "bare" in spans[7] and "endpoint" in spans[7]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[7] == "[SECRET] é [SECRET] [SECRET]/x" and clean[4] is None and clean[6] == texts[6] and clean[10] == "[SECRET]\""
    assert secrets.secrets(no_docs).count() == 0 and secrets.redact(no_docs).count() == 0


def test_secrets_run_without_python(spark, docs):
    plan = secrets.redact(docs)._jdf.queryExecution().toString() + quality.quality(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- 8 -----------------------------------------------------------------------


def brute_bits(trees, text, order=3):
    """PPM with escape method C and full exclusions, symbol by symbol."""
    data, out = b"\n" * order + text, 0.0
    for i in range(order, len(data)):
        seen, cost = set(), 0.0
        for k in range(order, -1, -1):
            row = {s: n for s, n in trees.get(data[i - k : i], {}).items() if s not in seen}
            if not row:
                continue
            total = sum(row.values()) + len(row)
            if data[i] in row:
                cost -= math.log2(row[data[i]] / total)
                break
            cost -= math.log2(len(row) / total)
            seen |= set(row)
        else:
            cost += math.log2(256 - len(seen))
        out += cost
    return out


def brute_counts(texts):
    counts = {}
    for t in texts:
        d = b"\n\n\n" + t
        for i in range(3, len(d)):
            for o in range(4):
                row = counts.setdefault(d[i - o : i], {})
                row[d[i]] = row.get(d[i], 0) + 1
    return counts


def test_code_lengths_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)  # three languages are two blocks
    texts = {"a": [b"the cat sat on the mat", b"cats"], "b": ["le chat était là".encode(), b"chats \xff"], "c": [b"zzz"]}
    counted = [(k, int(g), int(n)) for k, v in texts.items() for g, n in zip(*language._gram_counts(v), strict=True)]
    probe = [b"the chat", b"zq\x00\xff", "là".encode(), b"c"]
    asked = sorted({int(g) for t in probe for g in language._strings([t])})
    got = language.gram_costs(
        spark.createDataFrame(counted, "lang string, gram long, n long"), spark.createDataFrame([(g,) for g in asked], "gram long"), sorted(texts)
    ).collect()
    bits = {(2 * r["block"] + j, r["gram"]): x for r in got for j, x in enumerate(r["bits"])}
    for t in probe:
        for k, v in enumerate(texts.values()):
            assert sum(bits[k, int(g)] for g in language._strings([t])) == pytest.approx(brute_bits(brute_counts(v), t), rel=1e-5, abs=1e-4)


def test_any_number_of_languages(spark, monkeypatch):
    r = random.Random(9)
    monkeypatch.setattr(language, "PART_BYTES", 2000)
    texts = ["".join(r.choice("abcde fghé") for _ in range(r.randrange(3, 60))) for _ in range(400)]
    rows = [(i, t, f"l{i}") for i, t in enumerate(texts)] + [(7, texts[7], "l7")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    learned = {f"l{i}": brute_counts([t.encode()] * (2 if i == 7 else 1)) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2}
    by = {g["doc_id"]: g for g in got}
    for i in r.sample(range(400), 12):
        if not any(c.isalpha() for c in texts[i]):
            continue
        bits = {k: brute_bits(t, texts[i].encode()) for k, t in learned.items()}
        least = min(bits.values())
        assert bits[by[i]["lang_pred"]] == pytest.approx(least, rel=1e-5)
        assert by[i]["score"] == pytest.approx(1 / sum(2 ** max(least - b, -1000) for b in bits.values()), rel=1e-3)


def test_language(spark, no_docs):
    r = random.Random(4)
    alphabet = {"x": "abcde", "y": "vwxyz"}
    rows = [(i, " ".join("".join(r.choice(alphabet[k]) for _ in range(5)) for _ in range(20)), k) for i in range(200) for k in [r.choice("xy")]]
    rows += [(900, None, "x"), (901, "123 !", "y"), (902, "abc", None), (None, "abc", "y"), (904, "", "x")]
    got = {g["doc_id"]: g for g in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, _, k in rows[:200]:
        assert got[i]["lang_pred"] == k and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == got[904]["lang_pred"] == "und" and got[902]["lang_pred"] == "x" and got[None]["held_out"]
    assert language.identify(no_docs).count() == 0


# --- 9 -----------------------------------------------------------------------


def test_passages(spark, no_docs):
    shared = ". ".join(" ".join(words(s, 12)) for s in range(4)) + "."
    texts = [f"First text here {shared}\nOwn line.", f"Other start.\n{shared.upper()} And an end.", "Own line. Short.", None, "", f"{shared}\n{shared}"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(1, texts[1], 1)], "doc_id long, text string, unit int")
    got = passages.repeated_passages(df)
    spans = {(r["doc_id"], r["first_doc_id"], texts[r["doc_id"]][r["begin"] : r["end"]].strip()) for r in got.collect()}
    tail = ". ".join(shared.split(". ")[1:])
    assert (1, 0, tail.upper()) in spans and {d for d, _, _ in spans} == {1, 5}
    clean = {r["doc_id"]: r["text"] for r in passages.remove_passages(df, got).collect()}
    assert clean[0] == texts[0] and tail.upper() not in clean[1] and clean[1].startswith("Other start.") and clean[3] is None
    assert passages.repeated_passages(no_docs).count() == 0


# --- 10 ----------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "moron", "scum", "worthless", "trashy", "abcabcabc"]
    trie = toxicity.Trie(dict.fromkeys(terms, 1.0), {"vequ": 1.0})
    r = random.Random(8)
    probes = set(terms) | {"vequaire", "veq", ""}
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(r.randrange(4)):
                k = r.randrange(len(w) + 1)
                op = r.randrange(3)
                w[k : k + (op > 0)] = [] if op == 2 else [r.choice("abcdimorst")]
            probes.add("".join(w))
    for w in probes:
        want = min(((edits(w, t), t) for t in terms if edits(w, t) <= toxicity.allowed_edits(t)), default=None)
        hit = trie.find(w)
        if w.startswith("vequ"):
            assert hit == ("vequ", 0, True)
        else:
            assert (hit and (hit[1], hit[0])) == want, w


def test_misspelled_terms_below_a_stem(spark):
    ends = ["aire", "ante", "oque", "iste", "eurs", "esse"]
    rows = [(" ".join([*words(i, 30), *([f"vequ{ends[i // 4 % 6]}", "zog"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(400)]
    trie = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert trie.find("vequaire") == ("vequ", 0, True) and trie.find("vwquaire") == ("vequaire", 1, False) and trie.find("zog") == ("zog", 0, False)
    learned = toxicity.Trie({"vequaire": 2.0, "scum": 1.0, "worthless": 1.0}, {"vequ": 2.0})
    assert learned.find("vequaire") == ("vequ", 0, True)
    assert learned.find("vwquaire") == ("vequaire", 1, False) and learned.find("vwquarie") is None
    assert learned.find("scvm") == ("scum", 1, False) and learned.find("wrothless") == ("worthless", 2, False)


def test_context_separates_quotation():
    words_ = toxicity.Words(toxicity.Trie({"idiot": 5.0}, {}))
    plain, quoted, abuse = (toxicity.features(t, words_)[0] for t in ("that idiot there", 'he said "idiot" there', "you idiot there"))
    assert quoted < plain < abuse


def test_toxicity(spark, no_docs):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = words(i, 60)
        for _ in range(3 if toxic else 0):
            w[r.randrange(60)] = r.choice(["gloop", "snarfle", "snarfel"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "gloop")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {g["doc_id"]: g for g in toxicity.toxicity(df, marks).collect()}
    assert len(got) == len(rows)
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert held == [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == dict(labels)[i] for i in held]) > 0.95
    assert got[900]["score"] == got[901]["score"] < 0.5
    clean = toxicity.reject_toxic(df, marks)
    assert clean.columns == df.columns and clean.filter("doc_id = 0").count() == 0 and clean.filter("doc_id = 1").count() == 1
    none = marks.limit(0)
    assert {g["score"] for g in toxicity.toxicity(df, none).collect()} == {0.5} and toxicity.reject_toxic(df, none).count() == len(rows)
    assert toxicity.toxicity(no_docs, marks).count() == 0


def test_hot_digests_change_no_passage(spark, monkeypatch):
    line = "the same long line stands in very many documents of this small table and has to be found in each of them but the first one "
    rows = [(i, f"own words {i} here.\n{line}{i % 3}.\nand an end {i}" + ("\n" + line + "0" if i % 5 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame([*rows, rows[7], (60, None), (None, line)], "doc_id long, text string")
    found = []
    for hot in (1, 3, 10**9):
        monkeypatch.setattr(passages, "HOT_DIGESTS", hot)
        found.append(sorted(map(tuple, passages.repeated_passages(docs, 20).collect())))
    assert len(found[0]) > 50 and found[0] == found[1] == found[2]


def brute_shared(texts, size):
    """(doc_id, begin, end, words) of the runs of words in windows that stand earlier, by looking at every window."""
    seen, out = set(), []
    for doc, text in sorted(texts):
        found = list(re.finditer(r"[^ \t\n\r\x0b\x0c]+", text))
        w = [m[0].encode().lower() for m in found]
        covered = set()
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            if window in seen:
                covered.update(range(i, i + size))
            seen.add(window)
        for i in sorted(covered):
            if i - 1 not in covered:
                j = i
                while j + 1 in covered:
                    j += 1
                out.append((doc, found[i].start(), found[j].end(), j - i + 1))
    return sorted(out)


def test_shared_passages_do_not_need_sentence_ends(spark, no_docs):
    passage = [f"é{x}," if i % 7 else f"{x};" for i, x in enumerate(words(70, 58, 5000))]
    own = lambda seed, n: words(seed, n, 5000)
    texts = [
        (1, " ".join([*own(71, 40), *passage, *own(72, 40)])),
        (2, " ".join(["Ünrelated", *own(73, 33)]) + "\n\t" + "  ".join([*passage, *own(74, 12)]).upper().replace("É", "é")),
        (3, " ".join([*own(75, 5), *passage[:49], *own(76, 5)])),  # too short
        (4, " ".join([*own(77, 5), *passage[4:54], *own(78, 5), *passage[4:54]])),
        (5, " ".join(own(79, 30) * 4)), (6, "x " * 200), (7, "short"), (8, ""), (9, " ".join(own(71, 20) + passage[:50] + own(72, 60))),
    ]
    near = own(80, 600)
    texts += [(10 + k, " ".join([*near[: 90 * k], f"changed{k}", *near[90 * k + 1 :]])) for k in range(6)]
    df = spark.createDataFrame([*texts, texts[1], (20, None), (None, texts[0][1])], "doc_id long, text string")
    got = passages.shared_passages(df)
    want = brute_shared(texts, passages.SHARED_WORDS)
    assert sorted((r["doc_id"], r["begin"], r["end"], r["n_words"]) for r in got.collect()) == want
    assert {w[0] for w in want} >= {2, 4, 9, 11} and 3 not in {w[0] for w in want}
    assert not passages.repeated_passages(df.filter("doc_id IN (1, 2)")).count()  # sentences alone miss it
    assert passages.shared_passages(no_docs).count() == 0


def test_words_of_a_block_are_encoded_once(reference_ids, monkeypatch):
    """Texts of several blocks have the ids they have alone, and a word that repeats in a block is encoded once."""
    r = random.Random(8)
    pieces = ["word", "an other", "\n", " ", "  ", "\t", "x\n y", "it's", "'ll", "漢字", " ", " ", "12", "!?", "<|endoftext|>", "", "one  two", "\x1c"]
    texts = ["".join(r.choice(pieces) + " " * r.randrange(2) for _ in range(r.randrange(40))) for _ in range(300)] + TRICKY
    encode = tokens.encoder(tokens.VOCABULARY)
    for block in (1, 500, 1 << 23):
        monkeypatch.setattr(tokens, "BLOCK", block)
        for text, ids in zip(texts, encode.each(texts), strict=True):
            assert ids.tolist() == reference_ids(text), repr(text)
    assert list(encode.each([])) == []
    asked, plain = [], encode._encode
    monkeypatch.setattr(encode, "_encode", lambda text: asked.append(text) or plain(text))
    monkeypatch.setattr(tokens, "BLOCK", 1 << 23)
    assert len(list(encode.each([f"text{i} with some common words {i % 7}" for i in range(500)]))) == 500
    assert "".join(asked).count("common") == 1


def test_workers_take_a_batch_in_slices(monkeypatch):
    """Python workers hold about SLICE bytes of texts at once, however many rows Spark's batch has; the rows are the same."""
    r = random.Random(9)
    texts = [None if i % 11 == 0 else "é word " * r.randrange(60) for i in range(400)] + ["long text " * 500, "", None]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"]).slice(1)
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))

    def run(f, size, batch=whole):
        monkeypatch.setattr(common, "SLICE", size)
        return list(f(iter([batch, batch.slice(0, 0)])))

    seen, plain = [], tokens.Encoder.each

    def each(self, texts):
        own = list(texts)
        seen.append(sum(len(t.encode()) for t in own))
        return plain(self, own)

    monkeypatch.setattr(tokens.Encoder, "each", each)
    pieces = packing._pieces(tokens.VOCABULARY, 1024, 2)
    one, many = run(pieces, 1 << 40), run(pieces, 2000)
    assert pa.Table.from_batches(one).to_pylist() == pa.Table.from_batches(many).to_pylist()
    assert seen[0] > 50_000 and sorted(seen[2:])[-1] == 5000 and sorted(seen[2:])[-2] <= 2000  # the long text is alone
    assert max(b.num_rows for b in many) < 400
    raw = whole.set_column(1, "text", whole.column("text").cast(pa.binary()))
    many, one = (run(near_dedup._signatures, size, raw) for size in (2000, 1 << 40))
    assert len(many) > len(one) and pa.Table.from_batches(many).to_pylist() == pa.Table.from_batches(one).to_pylist()
    monkeypatch.setattr(common, "SLICE", 2000)
    back = pa.Table.from_batches(common.sliced(iter([whole]), 1))
    assert back.to_pylist() == whole.to_pylist()


def test_a_worker_keeps_one_operators_tables():
    class Big:
        pass

    held = weakref.ref(common.kept_in_worker("toxicity", Big))
    assert common.kept_in_worker("toxicity", lambda: None) is held() is not None
    encode = tokens.encoder(tokens.VOCABULARY)
    assert held() is None and tokens.encoder(tokens.VOCABULARY) is encode
