"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts are lower-cased words.  Of every window of ``WINDOW`` words, the smallest hash
among its ``GRAM``-word grams is kept as its fingerprint, so two texts that share a
window share a fingerprint, wherever it stands.  Fingerprints of documents are joined
with those of benchmark items; a hit is extended over the run of windows that chose
the fingerprint, and windows are compared word by word (as lists of 64-bit word
hashes).  Items shorter than a window are one window of their own length and are
looked up among the document's windows of that length.

Consecutive windows with one fingerprint travel as one row with the words around it,
so the join needs no second look at the text.  Benchmark windows are joined without
their items, which are attached only to distinct hits; the benchmark is broadcast if
it has at most ``BROADCAST_WINDOWS`` windows, and shuffled otherwise.

Nulls and edges: a null text has no words and is clean.  Rows of one doc_id and text
are one document and get the same result in each row; a null doc_id is kept.  Items
without words match nothing, a null item_id is left out of the list of items.  Texts are
read whole, however long, and repeated items count once.  Empty tables give no rows, or clean documents.  Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.cluster import written
from tickloom.llm.common import join_documents, unpacked, whole_rows
from tickloom.llm.native import LOWER, UPPER, changes, grams, let, piece, upto, window_minima

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
#: Windows of about 100 bytes each; more are shuffled.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN), "")


def _hashed(df: DataFrame, *keep: Column, text: str = "text") -> DataFrame:
    """The kept columns, ``hw`` (hashes of the words) and ``n``."""
    return df.select(*keep, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("hw")).withColumn("n", F.size("hw"))


def _fingerprints(hw: Column, n: Column, window: int, gram: int) -> Column:
    """The fingerprint of each window: the smallest hash of its grams."""
    return let(grams(hw, n, gram), lambda g: window_minima(g, n - (gram - 1), window - gram + 1))


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(item_id, fp, win) for each window of each item; fp is null for windows that are shorter."""
    h = _hashed(items, F.col("item_id"))
    whole = h.where(f"n >= {window}").withColumn("fps", _fingerprints(F.col("hw"), F.col("n"), window, gram))
    each = let(F.struct("hw", "fps"), lambda s: F.transform(s["fps"], lambda fp, i: F.struct(fp.alias("fp"), piece(s["hw"], i, F.lit(window)).alias("win"))))
    long = whole.select("item_id", F.inline(each))
    short = h.where(f"n between 1 and {window - 1}").select("item_id", F.lit(None).cast("long").alias("fp"), F.col("hw").alias("win"))
    return long.unionByName(short).distinct()


def runs(docs: DataFrame, wins: DataFrame, window: int = WINDOW, gram: int = GRAM, small: bool = True, counted: bool = False) -> DataFrame:
    """(doc_id, th, start, around, whole): the words around each fingerprint of a benchmark window.

    With ``counted`` there is also a row for each document, marked ``whole``, whose
    ``start`` is its number of words, so that one pass over the texts is enough.
    """
    h = _hashed(docs, F.col("doc_id"), F.col("th"))
    # no filter on n: it would be pushed below and cut the words once more
    each = h.withColumn("fps", _fingerprints(F.col("hw"), F.col("n"), window, gram)).withColumn("at", changes(F.col("fps"), F.size("fps")))
    found = let(
        F.struct("hw", "fps", "at"),
        lambda s: F.transform(
            s["at"],
            lambda a, j: F.struct(s["fps"][a].alias("fp"), a.alias("start"), piece(s["hw"], a, F.coalesce(F.get(s["at"], j + 1), F.size(s["fps"])) - a + (window - 1)).alias("around"), F.lit(False).alias("whole")),
        ),
    )
    if counted:  # the key only deals these rows out
        found = F.concat(F.array(F.struct(F.xxhash64("doc_id", "th").alias("fp"), F.col("n").alias("start"), F.array().cast("array<bigint>").alias("around"), F.lit(True).alias("whole"))), found)
    known = wins.where("fp is not null").select("fp").distinct().withColumn("there", F.lit(True))
    rows = each.select("doc_id", "th", F.inline(found)).join(F.broadcast(known) if small else known, "fp", "left")
    return rows.where("there or whole").select("doc_id", "th", "start", "around", "whole")


def hits(docs: DataFrame, near: DataFrame, wins: DataFrame, window: int = WINDOW, small: bool = True, short_lengths: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, th, start, win) for each occurrence of a benchmark window, from :func:`runs`; th is the text's hash."""
    spread = let(F.col("around"), lambda x: F.transform(upto(F.size(x) - (window - 1)), lambda i: piece(x, i, F.lit(window))))
    cand = near.where("not whole").select("doc_id", "th", "start", F.posexplode(spread).alias("k", "win")).select("doc_id", "th", (F.col("start") + F.col("k")).alias("start"), "win")
    for length in short_lengths:
        cand = cand.unionByName(_hashed(docs, F.col("doc_id"), F.col("th")).select("doc_id", "th", F.posexplode(_windows_of(length)).alias("start", "win")))
    known = wins.select("win").distinct()
    return cand.join(F.broadcast(known) if small else known, "win", "left_semi")


def _windows_of(length: int) -> Column:
    return let(F.struct("hw", "n"), lambda s: F.transform(upto(s["n"] - (length - 1)), lambda i: piece(s["hw"], i, F.lit(length))))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    dirty, base = dirty_documents(docs, items, window, gram, counted=True)
    zero, none = F.lit(0).cast("long"), F.sha2(F.lit(""), 256)
    return join_documents(base, dirty, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents without a hit, with all their columns."""
    dirty, _ = dirty_documents(docs, items, window, gram)
    return unpacked(join_documents(whole_rows(docs), dirty, "left_anti"), docs.columns)


def dirty_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_hit, n_items, items_sha256) of the documents with a hit; with ``counted`` also (doc_id, th, n_words) of all."""
    docs = whole_rows(docs)
    wins = item_windows(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), window, gram)
    size, *lengths = wins.agg(F.count("*"), *(F.max(F.size("win") == n) for n in range(1, window))).first()
    small = size <= BROADCAST_WINDOWS
    near = written(runs(docs, wins, window, gram, small, counted), "benchmark-runs")
    # few rows, used twice below
    found = written(hits(docs, near, wins, window, small, tuple(n for n, there in enumerate(lengths, 1) if there)).select("doc_id", "th", "start", "win"), "benchmark-hits")
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.size("win")).alias("stop"))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["total"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], acc["end"]))).alias("total"), F.greatest(acc["end"], x["stop"]).alias("end")),
        lambda acc: acc["total"].cast("long"),
    )
    n_hit = found.groupBy("doc_id", "th").agg(covered.alias("n_hit"))
    named = wins.select("win", "item_id")
    ids = (
        found.select("doc_id", "th", "win").distinct().join(F.broadcast(named) if small else named, "win").groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
        .select("doc_id", "th", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    dirty = join_documents(n_hit, ids).select("doc_id", "th", "n_hit", "n_items", "items_sha256")
    return dirty, near.where("whole").select("doc_id", "th", F.col("start").cast("long").alias("n_words"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), cand AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), found AS (
  SELECT * FROM cand WHERE win IN (SELECT win FROM wins)
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT f.doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found f JOIN wins USING (win)) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
