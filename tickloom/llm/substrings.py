"""Substring dedup: every word inside a window of words that also starts earlier goes.

Windows of ``WINDOW`` words are dealt to shards by their minimizer, the smallest hash
of the ``GRAM``-word grams in the window: equal windows have equal minimizers, so all
copies of a window meet in one shard, and neighbouring windows that share one travel
as one segment, packed with others for the same shard.  Each shard builds a compressed FM-index (:mod:`fmindex`) over its
distinct segments and streams the segments of all documents through it by backward
search; the matching statistics give, for every window, its earliest start, and
intervals above the threshold are reported.

Segments whose minimizer occurs nowhere else cannot match and stay out of the index.
Grams that are very frequent would make hot shards, so they are used as minimizers
only where a window has no other; which they are is estimated on ``HOT_SAMPLE`` bytes
of documents at most and decides placement alone, never a result.  Copies of whole texts
and segments that repeat inside a task are merged there: the first goes to its shard, the
others are settled and dealt out evenly.  So a shard gets a passage once from each task,
however many documents hold it.
The number of shards follows the input; one task holds one shard at a time.

Order is by doc_id and place in the document.  Rows of one doc_id are one document
and never precede each other at the same place; a null doc_id precedes all others.
A null text has no words; texts of fewer words than a window keep all.  Repeated
rows get equal results, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from tickloom.cluster import written
from tickloom.llm.common import bytes_list, join_documents, map_arrow, whole_rows
from tickloom.llm.fmindex import window_firsts

WINDOW = 20
GRAM = 4
#: Text bytes for each shard, about.
SHARD_BYTES = 8 << 20
#: Bytes of documents at most on which frequent grams are estimated; for placement only.
HOT_SAMPLE = 16 << 20
#: A gram is frequent if it makes up more than this share of the sample; so there are 1 / HOT_SHARE at most.
HOT_SHARE = 1 / 20_000
CHUNK_WORDS = 500_000
FREQUENT = np.uint64(1 << 63)
WHOLE = (1 << 31) - 1


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


def gram_hashes(hashed: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each run of ``gram`` word hashes."""
    out = np.zeros(max(0, len(hashed) - gram + 1), np.uint64)
    for k in range(gram):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + len(out)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return (out ^ out >> np.uint64(32)) >> np.uint64(1)


def minimizers(value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest value of each window and its place, the leftmost if it is there twice."""
    at, span = np.arange(len(value)), 1
    while span < width:
        step = min(span, width - span)
        a, b = value[:-step], value[step:]
        later = b < a
        value, at = np.where(later, b, a), np.where(later, at[step:], at[:-step])
        span += step
    return value, at


def segments(words: list[bytes], doc: np.ndarray, cache: _Hashes, hot: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, minimizer) of runs of windows with one minimizer; ``doc`` numbers the document of each word."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), gram)
    if len(hot):
        grams = np.where(hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams, grams | FREQUENT, grams)
    least, at = minimizers(grams, window - gram + 1)
    inside = np.flatnonzero(doc[: len(least)] == doc[window - 1 :])
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    new = np.append(True, (at[inside[1:]] != at[inside[:-1]]) | (inside[1:] != inside[:-1] + 1))
    first = inside[new]
    last = inside[np.append(np.flatnonzero(new)[1:], len(inside)) - 1]
    return first, last + window, least[first]


def frequent_grams(docs: DataFrame, total: int, gram: int = GRAM, sample: int = HOT_SAMPLE, share: float = HOT_SHARE) -> np.ndarray:
    """Sorted hashes of grams that are frequent in a bounded sample of documents."""
    parts = max(1, -(-total // sample))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(parts)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for b in batches:
            found = [gram_hashes(np.fromiter(map(cache.__getitem__, w := raw.split()), np.uint64, len(w)), gram) for raw in bytes_list(b.column(0))]
            g, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["g", "n"])

    counts = written(map_arrow(some, run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 15 or g = 0"), "frequent-grams")
    whole = total // parts // 6  # words of about six bytes
    rows = counts.where(F.col("n") > F.lit(max(15.0, share * whole))).select("g").toPandas()
    return np.sort(rows["g"].to_numpy(np.int64).view(np.uint64))


SEGMENTS = "shard long, block binary"


def packed(key: np.ndarray, owner: list[tuple], start: np.ndarray, n: np.ndarray, text: list[bytes | None]) -> bytes:
    """Segments as one compressed block; those without a text have a negative length."""
    known = np.array([t is not None for t in text])
    ids = np.array([d or 0 for d, _ in owner], np.int64)
    valid = np.array([d is not None for d, _ in owner])
    th = np.array([t for _, t in owner], np.int64)
    head = [key.astype(np.uint64), ids, th, start.astype(np.int32), np.where(known, n, -n).astype(np.int32), valid.astype(np.uint8)]
    return zstandard.compress(len(key).to_bytes(4, "little") + b"".join(a.tobytes() for a in head) + b"\n".join(t for t in text if t is not None), 3)


def opened(block: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    """(key, doc_id, th, start, n, valid) and the texts of those that have one."""
    raw = zstandard.decompress(block)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for kind in (np.uint64, np.int64, np.int64, np.int32, np.int32, np.uint8):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out, raw[at:].split(b"\n") if (out[4] > 0).any() else []


def dealt(docs: DataFrame, shards: int, hot: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Segments of all documents with their shard; those settled inside a task have no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        whole: dict[bytes, tuple] = {}  # texts of this task, by digest: the smallest doc_id so far
        common: dict[bytes, tuple] = {}  # segments that repeat, or are of frequent grams only
        order = lambda d: (d is not None, d or 0)

        def emit(words: list[bytes], owners: list[tuple], lengths: list[int]) -> pa.RecordBatch:
            base = np.cumsum([0, *lengths])
            doc = np.repeat(np.arange(len(lengths)), lengths)
            first, end, key = segments(words, doc, cache, hot, window, gram)
            own = doc[first]
            start = first - base[own]
            text: list[bytes | None] = [b" ".join(words[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)]
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            for k in np.flatnonzero((key >= FREQUENT) | (count[back] > 1)).tolist():
                here = (*order(owners[own[k]][0]), int(start[k]))
                was = common.get(text[k])
                if was is not None and was < here and was[:2] != here[:2]:
                    text[k] = None  # an equal segment of an earlier document goes to the shard: this one goes
                elif was is None or here < was:
                    if len(common) > 100_000:
                        common.clear()
                    common[text[k]] = here
            shard = (key * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(1)).astype(np.int64) % shards
            # what is settled needs no shard of its own, and is dealt out by its place in the corpus
            settled = np.flatnonzero([t is None for t in text])
            shard[settled] = (np.array([owners[k][1] for k in own[settled].tolist()], np.int64) + start[settled]) % shards
            order_of = np.argsort(shard, kind="stable")
            parts = np.split(order_of, np.flatnonzero(np.diff(shard[order_of])) + 1) if len(order_of) else []
            blocks = [packed(key[p], [owners[k] for k in own[p].tolist()], start[p], (end - first)[p], [text[k] for k in p.tolist()]) for p in parts]
            return pa.RecordBatch.from_arrays([pa.array([int(shard[p[0]]) for p in parts], pa.int64()), pa.array(blocks, pa.binary())], names=["shard", "block"])

        for b in batches:
            words, owners, lengths = [], [], []
            for doc_id, raw, th in zip(b.column(0).to_pylist(), bytes_list(b.column(1)), b.column(2).to_pylist(), strict=True):
                digest = xxh3_128_digest(raw)
                was = whole.get(digest)
                if was is not None and was < order(doc_id):
                    continue  # a copy of an earlier document: settled by copies()
                if len(whole) > 500_000:
                    whole.clear()
                whole[digest] = order(doc_id)
                w = raw.split()
                if len(w) < window:
                    continue
                words += w
                owners.append((doc_id, th)), lengths.append(len(w))
                if len(words) > CHUNK_WORDS:
                    yield emit(words, owners, lengths)
                    words, owners, lengths = [], [], []
            if words:
                yield emit(words, owners, lengths)

    return map_arrow(docs.select("doc_id", "text", "th"), run, SEGMENTS)


def repeated(blocks: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(doc_id, valid, th, from, to) of the stretches of a shard's segments whose windows start earlier elsewhere."""
    parts = [opened(b) for b in blocks]
    key, doc_id, th, start, n, valid = (np.concatenate([p[0][k] for p in parts]).astype(np.uint64 if k == 0 else np.int64) for k in range(6))
    texts = [t for p in parts for t in p[1]]
    done = np.flatnonzero(n < 0)
    n = np.abs(n)
    has_text = np.ones(len(n), bool)
    has_text[done] = False
    spot = np.cumsum(has_text) - 1
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(has_text & (count[back] > 1))
    out = [(done, start[done], start[done] + n[done])]
    if len(rows):
        by = np.lexsort((doc_id[rows], valid[rows]))
        ids, known = doc_id[rows][by], valid[rows][by]
        rank = np.zeros(len(rows), np.int64)
        rank[by] = np.cumsum(np.append(False, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])))
        place = (rank << 32) + start[rows]
        coded = pa.array([texts[k] for k in spot[rows].tolist()], pa.binary()).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        first = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(first, code, place)
        # the index: distinct segments, a separator before each
        number: dict[bytes, int] = {}
        text, begin, end = [], np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for k, seg in enumerate(coded.dictionary.to_pylist()):
            text.append(0)
            begin[k] = len(text)
            text += [number.setdefault(w, len(number) + 1) for w in seg.split(b" ")]
            end[k] = len(text)
        symbols = np.array(text, np.int64)
        position = np.full(len(symbols), np.iinfo(np.int64).max)
        offset = np.arange(len(symbols)) - np.repeat(begin, np.diff(np.append(begin - 1, len(symbols))))
        inside = offset >= 0
        position[inside] = (np.repeat(first, np.diff(np.append(begin - 1, len(symbols)))) + offset)[inside]
        earliest = window_firsts(symbols, begin, end, position, window)
        # every occurrence against the earliest start of its windows
        width = n[rows] - window + 1
        row = np.repeat(np.arange(len(rows)), width)
        step = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
        gone = earliest[begin[code[row]] + step] < place[row] + step
        row, step = row[gone], step[gone]
        if len(row):
            new = np.append(True, (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1))
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(row)) - 1
            r = rows[row[head]]
            out.append((r, start[r] + step[head], start[r] + step[tail] + window))
    row, a, z = (np.concatenate(x) for x in zip(*out, strict=True))
    return doc_id[row], valid[row], th[row], a, z


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stream, sorted by its first column, cut so that each batch is one shard."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        shard = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist()]
        if held and held[-1].column(0)[0].as_py() != shard[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        for a, c in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
            if a and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(b.slice(a, c - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, th, from, to) for documents whose whole text an earlier document has."""
    key = ["th", "more", "size"]  # 128 bits of hash and the length
    each = docs.select("doc_id", "th", F.xxhash64(F.lit(1), "text").alias("more"), F.octet_length("text").alias("size"))
    # written before it is joined on its own key, so that Spark can split a text with very many copies
    first = written(each.groupBy(key).agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1").select(*key, "first"), "copied-texts")
    later = each.join(first, key).where(F.struct("doc_id") > F.col("first"))
    return later.select("doc_id", "th", F.lit(0).alias("from"), F.lit(WHOLE).alias("to"))


def intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, th, from, to): stretches of words that repeat earlier windows; of short texts with copies, all words."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    hot = frequent_grams(docs, total, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_shards(batches):
            doc_id, valid, th, a, z = repeated(b.column(1).to_pylist(), window)
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, mask=valid == 0), pa.array(th), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], names=["doc_id", "th", "from", "to"])

    parts = dealt(docs, shards, hot, window, gram).repartition(min(shards, 20_000), "shard").sortWithinPartitions("shard")
    return map_arrow(parts, run, "doc_id long, th long, from int, to int")


def kept_words(words: list[bytes], spans: list[dict], window: int = WINDOW) -> list[bytes]:
    if not spans or len(words) < window:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        gone[s["from"]] += 1
        gone[min(s["to"], len(words))] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every document; ``with_text`` adds the kept text."""
    rows = whole_rows(docs).select("doc_id", "text", "th")
    found = written(intervals(rows, window, gram, shard_bytes), "repeats").unionByName(copies(rows))
    spans = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    joined = join_documents(rows, spans, "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, digest, texts = [], [], [], []
            for raw, s in zip(bytes_list(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = raw.split()
                kept = kept_words(words, s or [], window)
                flat = b" ".join(kept)
                n.append(len(words)), gone.append(len(words) - len(kept)), digest.append(hashlib.sha256(flat).hexdigest())
                texts.append(flat) if with_text else None
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.binary()).cast(pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text)

    return map_arrow(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)


SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW} - 1], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW})
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM later
), one AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT one.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY one.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
