"""Operator 10: toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled documents: words, and word beginnings with many endings, that toxic
documents have far more often than others.  It is a trie; each distinct word of a document is run through it as
a Levenshtein automaton, kept as bit sets, so misspelled terms are found too, also those below a beginning: one edit
from four letters on and two from eight.  Each hit is weighed by its context: reporting verbs and quotation marks
around it make it a quotation, words that address the reader make it abuse.  A logistic model turns a document's hits into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import kept_in_worker, materialised, sliced
from isohyet.llm.language import held_out

LABELLED_ROWS = 50_000  # about so many labelled rows are learned from, chosen by a hash
MIN_TOXIC = 5  # toxic documents a term has to occur in
MIN_RATIO = 15.0  # times the share of toxic documents over that of others
STEM_LENGTHS = (4, 5, 6, 7)
MIN_ENDINGS = 4
CONTEXT = 4  # words on each side of a hit
CACHED_WORDS = 300_000

# Reporting verbs and words that address the reader, in the corpus's languages
REPORTING = "said says called wrote quoted quote term word sagte schrieb nannte wort dit écrit appelé mot dijo escribió llamó palabra".split()
ADDRESS = "you your youre du dich dein ihr tu toi vous votre tú te usted".split()
QUOTES = "\"“”„«»‘’"

_WORD = re.compile(r"[^\W_]+")


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Trie:
    """Lexicon trie; a node ends a word, begins any word (a stem), or both."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.weight = {**stems, **words}
        for term, ends in [(w, self.word) for w in words] + [(s, self.stem) for s in stems]:
            at = 0
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                at = self.children[at][c]
            ends[at] = term
        # of one part more than the edits one is left as it is, and it moves by no more than the edits: (begin, length) of such
        # a part in words of each size, and the strings that can stand there
        self.parts: dict[int, dict[tuple[int, int], set[str]]] = {}
        for term in words:
            n, size = allowed_edits(term), len(term)
            cuts = [size * i // (n + 1) for i in range(n + 2)]
            for other in range(size - n, size + n + 1) if n else ():
                places = self.parts.setdefault(other, {})
                for begin, end in zip(cuts, cuts[1:]):
                    # edits before the part move it, edits behind it change the rest
                    for moved in {0} if begin == 0 else {other - size} if end == size else range(-n, n + 1):
                        if abs(moved) + abs(other - size - moved) <= n and begin + moved >= 0:
                            places.setdefault((begin + moved, end - begin), set()).add(term[begin:end])

    def exact(self, word: str) -> tuple[str, int, bool] | None:
        at, stem = 0, None
        for c in word:
            at = self.children[at].get(c, -1)
            if at < 0:
                return stem
            if self.stem[at]:
                stem = (self.stem[at], 0, True)
        return stem or (self.word[at] and (self.word[at], 0, False))

    def find(self, word: str) -> tuple[str, int, bool] | None:
        """(term, edits, is a stem): a stem of the word or the term itself, else the nearest term within its edits, the smallest of equals."""
        if hit := self.exact(word):
            return hit
        places = self.parts.get(len(word))
        if places and any(word[i : i + k] in strings for (i, k), strings in places.items()):
            return self._automaton(word)
        return None

    def _automaton(self, word: str) -> tuple[str, int, bool] | None:
        """Walk the trie with the word's Levenshtein automaton: bit i of a state says that i letters of the word are matched.

        `same` has the positions reached without an edit, `once` those with one and `twice` those with two.
        """
        letters: dict[str, int] = {}
        for i, c in enumerate(word):
            letters[c] = letters.get(c, 0) | 1 << i
        end, full = 1 << len(word), (2 << len(word)) - 1
        best: tuple[int, str] | None = None
        stack = [(0, 1, 2, 4 & full)]
        while stack:
            node, same, once, twice = stack.pop()
            if term := self.word[node]:
                distance = 1 if once & end else 2 if twice & end else 3
                if distance <= allowed_edits(term) and (best is None or (distance, term) < best):
                    best = distance, term
            for c, child in self.children[node].items():
                at = letters.get(c, 0)
                same_next = (same & at) << 1
                # a letter of the term that the word lacks, another letter, or (after the step) a letter too many
                once_next = ((once & at) << 1 | same | same << 1 | same_next << 1) & full
                twice_next = ((twice & at) << 1 | once | once << 1 | once_next << 1) & full
                if same_next or once_next or twice_next:
                    stack.append((child, same_next, once_next, twice_next))
        return best and (best[1], best[0], False)


class Words(dict):
    """Matches of words, looked up once per worker and word."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, word: str):
        hit = self[word] = self.trie.find(word)
        return hit


FEATURES = 7


def features(text: str | None, words: Words) -> list[float]:
    """Weighted exact, stem and fuzzy hits, distinct terms, quoted hits, share of hits, and whether there is any."""
    if len(words) > CACHED_WORDS:
        words.clear()
    lowered = (text or "").lower()
    found = _WORD.findall(lowered)
    matches = list(map(words.__getitem__, found))
    if not any(matches):
        return [0.0] * FEATURES
    spans = [m.span() for m in _WORD.finditer(lowered)]
    exact = fuzzy = quoted = 0.0
    n, terms = 0, set()
    for i, hit in enumerate(matches):
        if not hit:
            continue
        around = found[max(0, i - CONTEXT) : i] + found[i + 1 : i + 1 + CONTEXT]
        before = lowered[spans[max(0, i - CONTEXT)][0] : spans[i][0]]
        after = lowered[spans[i][1] : spans[min(len(found) - 1, i + CONTEXT)][1]]
        quotation = any(w in REPORTING for w in around) or (any(q in before for q in QUOTES) and any(q in after for q in QUOTES))
        weight = words.trie.weight[hit[0]] * (0.3 if quotation else 1.3 if any(w in ADDRESS for w in around) else 1.0)
        n += 1
        terms.add(hit[0])
        quoted += quotation
        if hit[1]:
            fuzzy += weight / hit[1]
        else:
            exact += weight
    return [math.log1p(exact), math.log1p(fuzzy), float(min(len(terms), 10)), math.log1p(n), math.log1p(quoted), n / len(found), 1.0]


def _word_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}

    def rows():
        c = list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *(pa.array([x[k] for x in c], pa.int64()) for k in (0, 1))], ["word", "clean", "toxic"])

    for b in sliced(batches):
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            for w in set(_WORD.findall(text.lower())):
                counts.setdefault(w, [0, 0])[toxic] += 1
            if len(counts) > 500_000:
                yield rows()
                counts = {}
    yield rows()


def _surroundings(candidates):
    """Each candidate's distinct pairs of neighbouring words, so that copies of a document count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = candidates.value
        for b in sliced(batches):
            found: set[tuple[str, bool, int, int]] = set()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                w = ["", *_WORD.findall(text.lower()), ""]
                for i in range(1, len(w) - 1):
                    x = w[i]
                    terms = [(x, False)] if x in words else []
                    terms += [(x[:k], True) for k in STEM_LENGTHS if x[:k] in stems and len(x) > k]
                    if terms:
                        near = xxhash.xxh3_64_intdigest(f"{w[i - 1]} {w[i + 1]}") >> 1
                        found.update((t, s, near, toxic) for t, s in terms)
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int32())
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["term", "stem", "near", "toxic"])

    return run


def labelled(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(text, toxic) of about `rows` labelled documents that are not held out, chosen by a hash of the id.

    Labels of an id that contradict each other count as toxic.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(0, 5)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if total > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * rows / total)))
    # at most about `rows` ids and flags: bounded, so the texts need no shuffle
    chosen = F.broadcast(known.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")))
    docs = documents.filter("text IS NOT NULL")
    return docs.join(chosen, docs["doc_id"].cast("long") == chosen["_id"]).select(docs["text"].alias("text"), F.col("_toxic").alias("toxic"))


def learn_lexicon(sample: DataFrame) -> Trie:
    """Words and stems that toxic documents have far more often, in several surroundings.

    All terms of that evidence are kept; each stands in MIN_TOXIC toxic documents of the bounded sample, which bounds how many come to the driver.
    """
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Trie({}, {})
    counts = materialised(sample.mapInArrow(_word_documents, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    ratio = ((F.col("toxic") + 0.5) / (n[1] + 1)) / ((F.col("clean") + 0.5) / (n[0] + 1))
    strong = (F.col("toxic") >= MIN_TOXIC) & (ratio >= MIN_RATIO)

    def strong_ones(rows: DataFrame, column: str) -> set[str]:
        return {r[column] for r in rows.filter(strong).select(column).collect()}

    stems = counts.withColumn("length", F.explode(F.array(*[F.lit(k) for k in STEM_LENGTHS])))
    stems = stems.filter(F.length("word") > F.col("length")).groupBy(F.expr("substring(word, 1, length)").alias("stem")).agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count(F.when(F.col("toxic") > 0, 1)).alias("endings")
    )
    words = strong_ones(counts, "word")
    beginnings = strong_ones(stems.filter(F.col("endings") >= MIN_ENDINGS), "stem")
    candidates = sample.sparkSession.sparkContext.broadcast((words, beginnings))
    seen = sample.mapInArrow(_surroundings(candidates), "term string, stem boolean, near long, toxic int").distinct()
    seen = seen.groupBy("term", "stem").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    kept = seen.filter(strong).select("term", "stem", F.log2(ratio).alias("weight")).collect()
    weights = {r["term"]: r["weight"] for r in kept if r["stem"]}
    weights = {s: w for s, w in weights.items() if not any(s[:k] in weights for k in range(1, len(s)))}
    return Trie({r["term"]: r["weight"] for r in kept if not r["stem"]}, weights)


class Model:
    """Lexicon trie and logistic weights on standardised features."""

    def __init__(self, trie: Trie, x: np.ndarray, y: np.ndarray):
        self.trie = trie
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.weight, self.bias = np.zeros(FEATURES), 0.0
        if len(y) and 0 < y.sum() < len(y):
            self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
            z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
            w = np.zeros(FEATURES + 1)
            for _ in range(30):  # Newton steps with a small ridge
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
                step = np.linalg.solve(hess, z.T @ (y - p) - 1e-2 * w)
                w += step
                if np.abs(step).max() < 1e-8:
                    break
            self.weight, self.bias = w[:-1], w[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sample_features(trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(trie.value)
        for b in sliced(batches):
            x = [features(t, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], ["x", "toxic"])

    return run


def fit(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """Model from a bounded sample of labelled rows; of each only its features come to the driver."""
    sample = materialised(labelled(documents, labels, rows))  # read by four jobs
    trie = learn_lexicon(sample)
    shared = documents.sparkSession.sparkContext.broadcast(trie)
    got = sample.mapInArrow(_sample_features(shared), "x array<double>, toxic int").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, FEATURES)
    return Model(trie, x, got.column("toxic").to_numpy().astype(float))


def _score(model, number: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        words = kept_in_worker(("words", number), lambda: Words(m.trie))
        for b in sliced(batches):
            x = np.array([features(t, words) for t in b.column("text").to_pylist()], float).reshape(-1, FEATURES)
            names = b.schema.names
            yield b.set_column(names.index("text"), "score", pa.array(m.score(x), pa.float64()))

    return run


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score of every row."""
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", held_out(0, 5)).select("doc_id", "held_out", "text")
    return rows.mapInArrow(_score(shared, f"{sc.applicationId}-{shared._jbroadcast.id()}"), "doc_id long, held_out boolean, score double")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Null and empty texts get the score of a text without hits.  Without toxic and clean examples every score is 0.5.
    """
    out = scores(documents, fit(documents, labels))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _keep(model, number: str, text_at: int):
    score = _score(model, number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text_at):
            text = pa.RecordBatch.from_arrays([b.column(text_at)], ["text"])
            (scored,) = score(iter([text]))
            yield b.filter(pa.array(scored.column("score").to_numpy() < 0.5))

    return run


def reject_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns; nothing is rejected without a model."""
    model = fit(documents, labels)
    if not model.weight.any():
        return documents
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast(model)
    keep = _keep(shared, f"{sc.applicationId}-{shared._jbroadcast.id()}", documents.columns.index("text"))
    return documents.mapInArrow(keep, documents.schema)
