"""Removal of repeated runs of lines, by winnowing, in DataFrame operations only.

Lines without a word are layout: they stand in no run and always stay.  Of every
window of ``MIN_RUN`` consecutive other lines the smallest line hash is selected as
its fingerprint, so two documents that share so long a run share a fingerprint.
Positions with a fingerprint that occurs elsewhere are joined and extended both ways
over the lines around them: each window of the run that selected it is compared by
the digests of its lines.  A line goes if some window that covers it starts earlier
elsewhere: in a smaller doc_id, or further up in the same document.  Longer matches
are unions of such windows, so whole later runs are removed and the first stays.

The documents of ``deduplicated`` also lose single lines: a line of ``LINE_WORDS`` words
or more is a run of its own, whatever stands beside it, and goes if it starts earlier
elsewhere.  The query ``line_dedup`` follows its SQL, which has runs of lines only.

Fingerprints and windows are grouped by aggregation with map-side combining, written
out and joined back: as the join does not share its exchange with the aggregation, Spark
splits the partitions of hot keys.  No pairs of occurrences are made.

Nulls and edges: a null text is an empty one.  A null doc_id counts as smaller than
any other.  Rows of one doc_id are one document and never repeat each other at the
same position.  Documents with fewer than ``MIN_RUN`` lines are left alone.  Texts are
read whole, however long; of equal runs the earliest is the first, and rows that tie with
it stay.  Empty tables give no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.cluster import written
from tickloom.llm.common import join_documents, unpacked, whole_rows
from tickloom.llm.native import changes, let, piece, upto, window_minima

MIN_RUN = 2
#: A line of so many words is a run of its own for ``deduplicated``.
LINE_WORDS = 50
HAS_WORD = r"[^\x20\x09-\x0D]"


def _runs(docs: DataFrame, min_run: int) -> DataFrame:
    """(doc_id, th, fp, start, around): runs of windows that selected one line, with the lines they cover."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(HAS_WORD))
    d = docs.select("doc_id", "th", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.unhex(F.md5(x.cast("binary"))).alias("d"))).alias("ls"))
    d = d.withColumn("fps", window_minima(F.col("ls.h"), F.size("ls"), min_run))
    d = d.withColumn("at", changes(F.col("fps"), F.size("fps")))
    each = let(
        F.struct("ls", "fps", "at"),
        lambda s: F.transform(s["at"], lambda a, j: F.struct(s["fps"][a].alias("fp"), a.alias("start"), piece(s["ls"], a, F.coalesce(F.get(s["at"], j + 1), F.size(s["fps"])) - a + (min_run - 1)).alias("around"))),
    )
    return d.select("doc_id", "th", F.inline(each))


def removed_lines(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, th, gone): indexes, among lines with a word, of the lines to remove; th is the text's hash."""
    runs = _runs(docs, min_run)
    # a line may also be selected at two places of one run
    often = runs.select("fp", F.size(let(F.struct("fp", "around"), lambda s: F.filter(s["around"]["h"], lambda h: h == s["fp"]))).alias("n")).groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")
    often = written(often, "line-fingerprints")
    spread = let(F.col("around.d"), lambda x: F.transform(upto(F.size(x) - (min_run - 1)), lambda i: F.array_join(F.transform(piece(x, i, F.lit(min_run)), lambda y: F.hex(y)), "")))
    wins = runs.join(often, "fp").select("doc_id", "th", "start", F.posexplode(spread).alias("k", "win"))
    wins = wins.select("doc_id", "th", F.struct("doc_id", (F.col("start") + F.col("k")).alias("i")).alias("at"), F.unhex("win").alias("win"))
    wins = written(wins, "line-windows")
    first = written(wins.groupBy("win").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("win", "first"), "line-firsts")
    later = wins.join(first, "win").where(~F.col("at").eqNullSafe(F.col("first")))
    covered = F.flatten(F.transform(F.collect_set("at.i"), lambda i: F.sequence(i, i + (min_run - 1))))
    return later.groupBy("doc_id", "th").agg(F.array_distinct(covered).alias("gone"))


def removed_long_lines(docs: DataFrame, words: int = LINE_WORDS) -> DataFrame:
    """(doc_id, th, gone) as removed_lines, for single lines of so many words."""
    long = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{words - 1}}}[^\x20\x09-\x0D]"
    lines = F.transform(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(HAS_WORD)), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    each = F.transform(F.filter(lines, lambda s: s["x"].rlike(long)), lambda s: F.struct(s["i"].alias("i"), F.unhex(F.md5(s["x"].cast("binary"))).alias("d")))
    at = docs.select("doc_id", "th", F.inline(each)).select("doc_id", "th", F.struct("doc_id", "i").alias("at"), "d")
    first = written(at.groupBy("d").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first"), "long-lines")
    later = at.join(first, "d").where(~F.col("at").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.collect_set("at.i").alias("gone"))


def cut(docs: DataFrame, min_run: int = MIN_RUN, line_words: int | None = None) -> DataFrame:
    """(row, doc_id, kept, n_lines, n_removed) for each row: the whole row, its kept text, its lines with a word and how many of them went."""
    rows = whole_rows(docs)
    gone = removed_lines(rows, min_run)
    if line_words:
        gone = gone.unionByName(removed_long_lines(rows, line_words)).groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    d = join_documents(rows, gone, "left").select("row", "doc_id", "text", "gone")
    lines = F.split("text", "\n", -1)
    solid = let(lines, lambda x: F.filter(upto(F.size(x)), lambda i: x[i].rlike(HAS_WORD)))
    kept = let(
        F.struct(lines.alias("lines"), solid.alias("solid"), "gone"),
        lambda s: F.array_join(let(s["lines"], lambda x: F.transform(F.array_except(upto(F.size(x)), F.transform(s["gone"], lambda g: s["solid"][g])), lambda i: x[i])), "\n"),
    )
    n_lines = F.size(F.filter(lines, lambda x: x.rlike(HAS_WORD))).cast("long")
    n_removed = F.coalesce(F.size("gone").cast("long"), F.lit(0).cast("long"))
    return d.select("row", "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def deduplicated(docs: DataFrame, min_run: int = MIN_RUN, line_words: int = LINE_WORDS) -> DataFrame:
    """The documents without their repeated runs and long lines, all other columns as they were (n_chars, if there, follows the text)."""
    done = cut(docs, min_run, line_words)
    went = F.col("n_removed") > 0
    text = F.when(went, F.col("kept")).otherwise(F.col("row")["text"])
    return unpacked(done, docs.columns, text=text, n_chars=F.when(went, F.length("kept").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None)


def line_dedup(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the kept text."""
    return cut(docs, min_run).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents
), s AS (
  SELECT doc_id, all_lines, list_filter(range(1, len(all_lines) + 1), lambda p: regexp_matches(all_lines[p], '[^\x20\x09-\x0D]')) AS solid FROM d
), w AS (
  SELECT doc_id, i, list_transform(solid[i:i + {MIN_RUN} - 1], lambda p: all_lines[p]) AS win
  FROM (SELECT *, unnest(range(1, len(solid) - {MIN_RUN} + 2)) AS i FROM s WHERE len(solid) >= {MIN_RUN})
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM w) WHERE r > 1
), gone AS (
  SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + {MIN_RUN})) AS k FROM later) GROUP BY doc_id
)
SELECT doc_id, len(solid)::BIGINT AS n_lines, coalesce(len(ks), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(all_lines) + 1), lambda p: NOT list_contains(list_transform(coalesce(ks, []), lambda k: solid[k]), p)), lambda p: all_lines[p]), chr(10))) AS kept_sha256
FROM s LEFT JOIN gone USING (doc_id)
"""
