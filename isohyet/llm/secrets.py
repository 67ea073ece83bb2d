"""Operator 7 (DataFrame functions only): secret scans with multipart credential linking.

Base spans of three kinds are reported by themselves.  Weak candidates (bare secrets, endpoints) are
reported only if complementary parts stand together: an interval join over places in the same
document pairs access identifiers or assignments with bare secrets and endpoints within a scope.

Spark's functions give the matches of a pattern but not their places.  A text split at the pattern gives what lies
between the matches; places are running sums of both lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import materialised

# The base patterns of the contract, in the order kinds are listed
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
# leftmost matches of [0-9a-f]+ are whole runs, so asking for the least length at once finds the same spans
HEX_LONG = r"[0-9a-f]{24,}"
# weak candidates: a bare mixed string as long as a secret, a service's address
BARE = r"[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(:[0-9]+)?"
KINDS = ["assign", "access", "hex", "bare", "endpoint"]
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX_LONG, "bare": BARE, "endpoint": ENDPOINT}
LEAST = {"assign": 0, "access": 20, "hex": 24, "bare": 32, "endpoint": 8}
LEAST_ASSIGNED = 6
SCOPE = 256  # code points between complementary parts

KEY = ["doc_id", "digest"]


def _parts(text: Column, kind: str) -> Column:
    """Array of (gap before the match, length of the match, length of the assigned value)."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    rows = F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"),
            F.length(F.get(value, i)).alias("value"),
            (m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]") if kind == "bare" else F.lit(True)).alias("mixed"),
        ),
    )
    return F.when(text.rlike(pattern), rows)


def found_parts(documents: DataFrame) -> DataFrame:
    """(doc_id, digest, kind, begin, end): every strong part and weak candidate, each once per document and text."""
    text = F.col("text")
    rows = documents.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), "text")
    # a text without any match makes no row; concat of nulls is avoided by empty arrays
    arrays = [F.coalesce(_parts(text, k), F.expr("array()")) for k in KINDS]
    parts = rows.select(*KEY, F.flatten(F.array(*arrays)).alias("parts")).filter(F.size("parts") > 0)
    each = parts.select(*KEY, F.explode("parts").alias("p")).select(*KEY, "p.*").distinct()
    # a pattern's matches of one document, in order: running sums of gaps and matches
    w = Window.partitionBy(*KEY, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(w)
    placed = each.withColumn("end", end.cast("long")).withColumn("begin", F.col("end") - F.col("size"))
    least = F.when(F.col("kind") == "assign", F.col("value") >= LEAST_ASSIGNED)
    for k in KINDS[1:]:
        least = least.when(F.col("kind") == k, F.col("size") >= LEAST[k])
    return placed.filter(least & F.col("mixed")).select(*KEY, "kind", "begin", "end")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates with a complementary part within `scope` code points in the same document.

    A bare secret needs an access identifier or an endpoint; an endpoint needs an access identifier, an
    assignment or a bare secret.  The interval join is an equi-join on cells of the scope's width, each
    weak part looking at its own and the neighbouring cells, so a long document is many keys.
    """
    cell = lambda at: F.floor(at / F.lit(scope))
    strong = parts.withColumn("cells", F.sequence(cell(F.col("begin")), cell(F.col("end")))).withColumn("cell", F.explode("cells"))
    s = strong.select(F.col("doc_id").alias("s_doc"), F.col("digest").alias("s_digest"), F.col("kind").alias("s_kind"),
                      F.col("begin").alias("s_begin"), F.col("end").alias("s_end"), F.col("cell").alias("s_cell"))
    weak = parts.filter(F.col("kind").isin("bare", "endpoint"))
    weak = weak.withColumn("cell", F.explode(F.sequence(cell(F.col("begin")) - 1, cell(F.col("end")) + 1)))
    fits = ((F.col("kind") == "bare") & F.col("s_kind").isin("access", "endpoint")) | (
        (F.col("kind") == "endpoint") & F.col("s_kind").isin("access", "assign", "bare")
    )
    near = (F.col("s_begin") - F.col("end") <= scope) & (F.col("begin") - F.col("s_end") <= scope)
    same = F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("digest") == F.col("s_digest")) & (F.col("cell") == F.col("s_cell"))
    return weak.join(s, same & fits & near, "left_semi").select(*KEY, "kind", "begin", "end").distinct()


def secret_spans(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, digest, kind, begin, end) in code points, end exclusive: base spans and linked weak candidates.

    A weak candidate that overlaps a base span adds nothing and is left out; overlaps are looked up by cells too, so
    the spans of a long document never meet all others.
    """
    parts = materialised(found_parts(documents))
    base = parts.filter(F.col("kind").isin(*KINDS[:3]))
    cell = F.explode(F.sequence(F.floor(F.col("begin") / scope), F.floor((F.col("end") - 1) / scope))).alias("cell")
    b = base.select(F.col("doc_id").alias("b_doc"), F.col("digest").alias("b_digest"), F.col("begin").alias("b_begin"), F.col("end").alias("b_end"), cell)
    weak = linked(parts, scope).select(*KEY, "kind", "begin", "end", cell)
    over = weak["doc_id"].eqNullSafe(b["b_doc"]) & (weak["digest"] == b["b_digest"]) & (weak["cell"] == b["cell"])
    over &= (weak["begin"] < b["b_end"]) & (b["b_begin"] < weak["end"])
    free = weak.join(b, over, "left").groupBy(*KEY, "kind", "begin", "end").agg(F.count("b_begin").alias("n")).filter("n = 0").drop("n")
    return base.unionByName(free)


def per_document(documents: DataFrame, digest: Column, spans: DataFrame) -> DataFrame:
    """Every document row with `_g_found`: its spans (begin, rank of the kind, end), sorted; null if there are none."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    gathered = spans.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("begin", rank.alias("rank"), "end"))).alias("found"))
    g = gathered.select(F.col("doc_id").alias("_g_doc"), F.col("digest").alias("_g_digest"), F.col("found").alias("_g_found"))
    same = documents["doc_id"].cast("long").eqNullSafe(g["_g_doc"]) & (digest == g["_g_digest"])
    return documents.join(g, same, "left")


def _named(found: Column) -> Column:
    kind = lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["rank"] - 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", kind(x), x["begin"].cast("string"), x["end"].cast("string"))), ",")


def secrets(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans.  Rows that repeat a doc_id and text get the same result; other columns are ignored.
    """
    found = F.coalesce(F.col("_g_found"), F.expr("array()"))
    keys = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"))  # no text in the join
    rows = per_document(keys, keys["digest"], secret_spans(documents, scope)).select("doc_id", found.alias("found"))
    count = lambda k: F.size(F.filter("found", lambda x: x["rank"] == KINDS.index(k) + 1)).cast("long")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_named(F.filter("found", lambda x: x["rank"] <= 3)), 256).alias("base_sha256"), _named(F.col("found")).alias("spans"),
    )


def redact(documents: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """Documents with every span replaced by a mark; overlapping spans are one.  All columns stay, n_chars follows the text.

    Null and empty texts and repeated rows stay as they are.
    """
    names = documents.columns
    # no column of the documents has a name that is used here
    documents = documents.toDF(*[n if n in ("doc_id", "text", "n_chars") else f"c{i}" for i, n in enumerate(names)])
    rows = per_document(documents, F.xxhash64(documents["text"]), secret_spans(documents.select("doc_id", "text"), scope))
    f = F.col("_g_found")
    # a span that begins inside the farthest end so far only extends it
    joined = F.aggregate(
        f, F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (x["begin"] < F.element_at(a, -1)["end"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["begin"].alias("begin"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(F.struct(x["begin"].alias("begin"), x["end"].alias("end"))))),
    )
    text, j = F.col("text"), F.col("_joined")
    rows = rows.withColumn("_joined", joined)
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    pieces = F.transform(j, lambda x, i: cut(F.coalesce(F.get(j, i - 1)["end"], F.lit(0).cast("bigint")), x["begin"]))
    tail = cut(F.element_at(j, -1)["end"], F.length(text))
    clean = F.when(f.isNotNull(), F.concat(F.array_join(pieces, mark), F.lit(mark), tail)).otherwise(text)
    out = rows.withColumn("text", clean)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(f.isNotNull(), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[out[c] for c in documents.columns]).toDF(*names)
