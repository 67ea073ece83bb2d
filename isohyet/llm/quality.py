"""Operator 4 (DataFrame functions only): quality rules with cross-document line frequency.

Per document: word and symbol counts, repeated lines, words in repeated 3-word windows.  Across documents:
normalised lines are hashed, distinct documents are counted per host (column `source`), lines in
too many documents of a host are removed, and documents left with too little are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import materialised

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_LINE_DOCUMENTS = 20  # a line in at most so many documents of a host stays
MAX_LINE_SHARE = 0.01  # and one in at most this share of the host's documents
MIN_KEPT_PERCENT = 50  # of a document's words have to be left


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def base_columns(documents: DataFrame) -> DataFrame:
    """doc_id, source, digest of the text, the base counts, and the distinct lines (hash, words in all their copies)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text.alias("_text"))
    docs = docs.withColumn("_w", words(F.col("_text")))
    w, n = F.col("_w"), F.size("_w")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumns(
        {
            "_lines": lines,
            "_h": F.when(
                n >= 3,
                F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
            ).otherwise(F.expr("cast(array() as array<bigint>)")),
        }
    )
    docs = docs.withColumn("_repeats", F.size(F.array_distinct("_h")) < F.size("_h"))
    # places of repeated windows, in order; only evaluated where a hash repeats
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    docs = docs.withColumn("_pairs", F.when(F.col("_repeats"), pairs))
    p = F.col("_pairs")
    hit = F.filter(p, lambda x, i: (x["h"] == F.get(p, i + 1)["h"]) | (x["h"] == F.get(p, i - 1)["h"]))
    docs = docs.withColumn("_places", F.sort_array(F.transform(hit, lambda x: x["p"])))
    q = F.col("_places")
    covered = F.aggregate(
        F.transform(q, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    normal = F.transform("_lines", lambda x: F.regexp_replace(F.lower(F.trim(F.regexp_replace(x, SPACE, " "))), "[0-9]", "0"))
    hashed = F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).cast("bigint").alias("n")))
    return docs.select(
        "doc_id", "source", F.xxhash64("_text").alias("digest"), n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        hashed.alias("lines"),
    )


def quality(
    documents: DataFrame, min_line_documents: int = MIN_LINE_DOCUMENTS, max_line_share: float = MAX_LINE_SHARE,
    min_kept_percent: int = MIN_KEPT_PERCENT,
) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, common_words, kept.

    Null and empty texts have no words and fail.  A null source is a host of its own.  Rows that repeat a
    doc_id and text count as one document of the host and are all returned.  common_words are words in lines that
    more than min_line_documents documents and more than max_line_share of the host's documents have.
    """
    base = materialised(base_columns(documents))
    key = ["source", "doc_id", "digest"]
    host = F.coalesce("source", F.lit("\x00"))
    hosts = base.select(host.alias("host"), *key[1:]).distinct().groupBy("host").agg(F.count("*").alias("host_documents"))
    rows = base.select(host.alias("host"), "doc_id", "digest", F.explode("lines").alias("l"))
    per_document = rows.groupBy("host", F.col("l.line").alias("line"), "doc_id", "digest").agg(F.count("*").alias("copies"), F.max("l.n").alias("n"))
    per_line = per_document.groupBy("host", "line").agg(F.count("*").alias("line_documents")).filter(F.col("line_documents") > min_line_documents)
    limit = F.col("host_documents") * F.lit(max_line_share)
    common = per_line.join(hosts, "host").filter(F.col("line_documents") > limit).select("host", "line")
    # words of a document's distinct rows: the same doc_id and text twice must not count twice
    lines = base.select(host.alias("host"), *key[1:], "lines").dropDuplicates(["host", "doc_id", "digest"])
    each = lines.select("host", "doc_id", "digest", F.explode("lines").alias("l")).select("host", "doc_id", "digest", "l.line", "l.n")
    removed = each.join(common, ["host", "line"]).groupBy("host", "doc_id", "digest").agg(F.sum("n").alias("common_words"))
    b, r = base.drop("lines").withColumn("host", host).alias("b"), removed.alias("r")
    same = (F.col("b.host") == F.col("r.host")) & F.col("b.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("b.digest") == F.col("r.digest"))
    out = b.join(r, same, "left").select("b.*", F.coalesce("r.common_words", F.lit(0)).alias("common_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("common_words")) < min_kept_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "common_words", "kept"
    )
