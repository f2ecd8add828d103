"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed, and k-grams of words are hashed from those. Of every run of t - k + 1 consecutive
k-grams the least hash is a fingerprint, so two texts that share t words in a row share a fingerprint
within them. Fingerprints of documents and items are joined; each match carries the t - k words on
either side of its k-gram, which is enough to extend it: where at least t words agree, all of them
are hit. A shared span longer than that is covered by its other fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._shared import documents, free_names, written

WINDOW_WORDS = 13
GRAM_WORDS = 5
#: A document is contaminated if at least one word in so many is hit.
HIT_SHARE = 20
#: Item fingerprints are broadcast while their rows and ids, at so many bytes each, stay below a limit; beyond, the join is shuffled.
ROW_BYTES, ID_BYTES, BROADCAST_BYTES = 320, 24, 64 << 20
#: Contaminated documents, two longs each, are broadcast up to so many rows.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A fingerprint is a hash in the upper bits and a word position in the lower ones, more than a text can have.
POSITION_BITS = 28


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters in lower case and characters beyond ASCII; null has none."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, NOT_WORD), ""), F.array().cast("array<string>"))


def _grams(t: int, k: int) -> str:
    """SQL for the fingerprints of the word hashes h for windows of t words: hashes of k words in the upper bits, positions in the lower.

    A gram's hash depends on t too, so windows of different lengths never meet.
    """
    low = (1 << POSITION_BITS) - 1
    gram = ", ".join(f"get(h, i + {j})" for j in range(k))
    grams = f"transform(sequence(0, size(h) - {k}), i -> (xxhash64({t}, {gram}) & {~low}L) | cast(i AS bigint))"
    if t > k:
        grams = f"get(transform(array({grams}), g -> array_distinct(transform(sequence(1, size(g) - {t - k}), i -> array_min(slice(g, i, {t - k + 1}))))), 0)"
    return f"CASE WHEN size(h) >= {t} THEN {grams} ELSE cast(array() AS array<bigint>) END"


def _fingerprints(hashed: DataFrame, sizes: list[int], own_size: bool = False) -> DataFrame:
    """From a column h of word hashes: t, key, pos and near, the hashes of the t - k words around each k-gram chosen.

    All window lengths are probed in one pass over the words. own_size takes only the length that suits
    the row: the largest of sizes, or the row's own number of words if that is less.
    """
    low, most = (1 << POSITION_BITS) - 1, max(sizes)
    pad = F.array_repeat(F.lit(None).cast("long"), most)
    kind = "array<struct<t: int, key: bigint, pos: int, near: array<bigint>>>"
    parts = []
    for t in sizes:
        k = min(GRAM_WORDS, t)
        near = f"slice(padded, cast((x & {low}L) + {most - (t - k) + 1} AS int), {2 * t - k})"
        made = f"transform({_grams(t, k)}, x -> struct({t} AS t, x & {~low}L AS key, cast(x & {low}L AS int) AS pos, {near} AS near))"
        suits = "true" if not own_size else f"size(h) >= {t}" if t == most else f"size(h) = {t}"
        parts.append(f"CASE WHEN {suits} THEN {made} ELSE cast(array() AS {kind}) END")
    # Words beyond both ends are null.
    around = hashed.withColumn("padded", F.concat(pad, "h", pad)).withColumn("x", F.explode(F.expr(f"concat({', '.join(parts)})")))
    return around.select(*(c for c in hashed.columns if c != "h"), "x.t", "x.key", "x.pos", "x.near")


def _run(flags: str) -> str:
    """How many of an array of booleans are true before the first that is not."""
    return f"CASE WHEN array_position({flags}, false) = 0 THEN size({flags}) ELSE cast(array_position({flags}, false) - 1 AS int) END"


def _hits(docs: DataFrame, items: DataFrame, sizes: list[int], broadcast_bytes: int) -> DataFrame:
    """(doc_id, text_key, item_ids, s, e): words s to e - 1 of the document are in windows of these items.

    Items that agree around a fingerprint are one row of the join, with all their ids.
    """
    known = _fingerprints(items, sizes, own_size=True).groupBy("t", "key", F.col("near").alias("item_near")).agg(F.collect_set("item_id").alias("item_ids"))
    known = written(known, "item_fingerprints")
    rows, ids = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("item_ids")), F.lit(0))).first()
    right = F.broadcast(known) if ROW_BYTES * rows + ID_BYTES * ids <= broadcast_bytes else known
    met = _fingerprints(docs, sizes).join(right, ["t", "key"]).withColumns({"same": F.expr("zip_with(near, item_near, (a, b) -> coalesce(a = b, false))"), "k": F.least(F.lit(GRAM_WORDS), "t")}).withColumn("c", F.expr("t - k"))
    met = met.select("doc_id", "text_key", "item_ids", "t", "k", "pos", F.expr(_run("reverse(slice(same, 1, c))")).alias("l"), F.expr(_run("slice(same, c + 1, k)")).alias("m"), F.expr(_run("slice(same, c + k + 1, c)")).alias("r"))
    return met.where("m = k AND l + m + r >= t").selectExpr("doc_id", "text_key", "item_ids", "pos - l AS s", "pos + k + r AS e")


def contamination(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS, hit_share: int = HIT_SHARE, broadcast_bytes: int = BROADCAST_BYTES, keep_key: bool = False) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, item_ids and contaminated added, less clashing columns of docs.

    items: item_id and text. A window is window_words consecutive words of an item, or all words of a
    shorter one. Null and wordless texts have no windows and no hits. Rows that repeat an id are
    judged each by its own text; items without an id count for hits but are not listed. keep_key leaves
    text_key, the hash of the text that rows were told apart by.
    """
    made = ["text_key", "n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated"]
    docs = docs.drop(*made).withColumn("text_key", F.xxhash64("text"))
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    item_rows = items.select("item_id", hashed.alias("h")).where(F.size("h") > 0)
    doc_rows = docs.select("doc_id", "text_key", hashed.alias("h"))
    # A benchmark is short of distinct lengths below a window: at most window_words - 1 values reach the driver.
    short = sorted(r[0] for r in item_rows.where(F.size("h") < window_words).select(F.size("h")).distinct().collect())
    hits = _hits(doc_rows, item_rows, [*short, window_words], broadcast_bytes)
    union = "aggregate(array_sort(spans), struct(0L AS n, 0 AS e), (a, x) -> struct(a.n + greatest(0, x.e - greatest(x.s, a.e)) AS n, greatest(a.e, x.e) AS e), a -> a.n)"
    named = F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("item_ids")), lambda x: x.cast("string"))))
    by_doc = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("s", "e")).alias("spans"), named.alias("item_ids"))
    hit_doc, hit_key = free_names(docs, "hit_doc", "hit_key")
    by_doc = by_doc.select(F.col("doc_id").alias(hit_doc), F.col("text_key").alias(hit_key), F.expr(union).alias("n_hit"), "item_ids")
    joined = docs.withColumn("n_words", F.size(words(F.col("text"))).cast("long")).join(by_doc, F.col("doc_id").eqNullSafe(F.col(hit_doc)) & F.col("text_key").eqNullSafe(F.col(hit_key)), "left").drop(hit_doc, hit_key, *([] if keep_key else ["text_key"]))
    full = joined.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    return full.withColumns({"n_items": F.size("item_ids").cast("long"), "items_sha256": F.sha2(F.array_join("item_ids", ","), 256), "contaminated": (F.col("n_hit") > 0) & (hit_share * F.col("n_hit") >= F.col("n_words"))})


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **settings) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated.

    Null and wordless texts stay; rows that repeat an id stay or go each by its own text, rows without an
    id too; of equal rows all stay or all go. Without items all stay.
    """
    found = contamination(docs.select("doc_id", "text"), items, keep_key=True, **settings).where("contaminated")
    doc, key = free_names(docs, "bad_doc", "bad_key")
    # Copies of a contaminated text count once.
    bad = written(found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct(), "contaminated")
    few = bad.count() <= broadcast_rows
    return docs.join(F.broadcast(bad) if few else bad, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left_anti")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), iwin AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM iw WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM iwin), dwin AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w CROSS JOIN sizes WHERE len(ws) >= n)
), met AS (SELECT doc_id, dwin.n, i, item_id FROM dwin JOIN iwin ON dwin.n = iwin.n AND dwin.g = iwin.g),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM met)) GROUP BY 1
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM met) GROUP BY 1
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
