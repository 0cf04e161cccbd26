"""Packing of tokenised documents into sequences by minimum bin slack.

A document is its token ids and an end id.  Longer ones are cut into pieces of the
full length, the first piece may be shorter.  Packing needs the pieces' lengths
only, so the plan is made from the histogram of lengths, which has at most
``SEQUENCE`` entries whatever the input: a bin is opened with the longest piece left
and dynamic programming over a bitset of reachable sums finds the fullest
combination of the lengths that remain; it is taken as often as the counts allow
before the next bin is planned.  A plan therefore has few distinct bins, each with a
multiplicity, and is small enough to send to every task.

Pieces get their places by rank among those of their length.  Ranks are counted in
bounded buckets (length, salt), whose offsets come from an aggregation, so that a
length shared by a third of all pieces is no hot key.

Nulls and edges: a null or empty text is the end id alone.  A null doc_id is kept.
Repeated rows are packed each.  An empty table gives no rows.  Very long texts are
tokenised in chunks that no token can span; a text that names one of the tokenizer's
special tokens, which get their own ids as the tokenizer's defaults have it, is
tokenised in one go.  Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.cluster import written
from tickloom.llm.common import id_text, map_arrow, remembered

SEQUENCE = 2048
END = 0
#: Chunks in each of the two generations that a worker remembers; the older goes when the newer is full.
CACHE = 600_000
#: Chunks that are encoded together.
JOINED = 2000
#: Pieces in a bucket in which ranks are counted, about.
BUCKET = 100_000

#: White space of the tokenizer's own splitting rule (Unicode White_Space).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The rule never joins across these: a run of other characters with one space before it, or white space.
_CHUNK = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTokenizer:
    """A byte-level BPE tokenizer that remembers the ids of chunks between which its rule always splits."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> None:
        """Have all of these among the known; what was not met for long is forgotten."""
        new = set(chunks).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.older, self.known = self.known, {}
            new = set(chunks)
        if again := {c for c in new if c in self.older}:
            self.known.update((c, self.older[c]) for c in again)
            new -= again
        plain, spaced = [], []
        for c in new:
            (spaced if c[0] == " " and not c.isspace() else plain).append(c)
        for at in range(0, len(plain), JOINED):
            part = plain[at : at + JOINED]
            for c, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[c] = array("I", e.ids).tobytes()
        for at in range(0, len(spaced), JOINED):
            part = spaced[at : at + JOINED]
            # the rule splits before each space, so these can be encoded as one text and told apart by their places
            e = self.model.encode("".join(part), add_special_tokens=False)
            ids = array("I", e.ids).tobytes()
            begin = np.cumsum([0, *map(len, part)])
            cut = (4 * np.searchsorted(np.fromiter((a for a, _ in e.offsets), np.int64, len(e.offsets)), begin)).tolist()
            self.known.update((c, ids[a:z]) for c, a, z in zip(part, cut, cut[1:], strict=False))

    def ids(self, text: str) -> np.ndarray:
        """Token ids of a whole text, as unsigned 32-bit integers."""
        if any(x in text for x in self.special):  # special tokens cut the text before the rule does
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")
        chunks, out = _CHUNK.findall(text), []
        for at in range(0, len(chunks), CACHE // 4):
            part = chunks[at : at + CACHE // 4]
            self.learn(part)
            out.append(b"".join(map(self.known.__getitem__, part)))
        return np.frombuffer(b"".join(out), "<u4")


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for each worker process, which keeps what it remembers from task to task of this operator."""
    key, model = remembered.get("tokenizer", (None, None))
    if key != path:
        remembered["tokenizer"] = path, (model := ChunkTokenizer(path))
    return model


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document; ``with_ids`` adds its token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chunk_tokenizer(path)
        for b in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                all_ids = np.append(model.ids(text) if text else np.zeros(0, "<u4"), np.uint32(end)).astype("<u4")
                n, at, i = len(all_ids), 0, 0
                while at < n:
                    size = (n % sequence or sequence) if at == 0 else sequence
                    part = all_ids[at : at + size]
                    doc.append(k), piece.append(i), start.append(at), length.append(size), crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.tolist())
                    at, i = at + size, i + 1
            cols = [b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(id_text(docs), run, PIECES + ", ids array<long>" * with_ids, keeps="tokenizer")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the fullest combination that fits the room: subset sums as a bitset."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, batch = min(counts[length], room // length), 1
        while left and not reach >> room & 1:  # binary splitting: 1, 2, 4, ... copies at a time
            take = min(batch, left)
            steps.append((reach, length, take))
            reach |= reach << (take * length) & mask
            left, batch = left - take, batch * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return sorted(chosen.items(), reverse=True)


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how often, [(length, how many)]): the longest piece left opens a bin, the fullest combination closes it."""
    left = {k: v for k, v in histogram.items() if v > 0}
    bins = []
    while left:
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        combo = dict(fullest({k: v for k, v in rest.items() if v}, sequence - first))
        combo[first] = combo.get(first, 0) + 1
        times = min(left[k] // n for k, n in combo.items())
        for k, n in combo.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        bins.append((times, sorted(combo.items(), reverse=True)))
    return bins


def places(bins: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """Rank intervals (length, first rank, how many, first sequence, offset) that a plan gives to each length."""
    out, used, sequence = [], {}, 0
    for times, combo in bins:
        offset = 0
        for length, n in combo:
            for _ in range(n):
                rank = used.get(length, 0)
                out.append((length, rank, times, sequence, offset))
                used[length] = rank + times
                offset += length
        sequence += times
    return out


def placed(parts: DataFrame, sequence: int = SEQUENCE, bucket: int = BUCKET) -> DataFrame:
    """Rows with a ``length`` column, with their sequence_id and offset added."""
    names = parts.columns
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `sequence` rows
    rows = places(plan(counts, sequence))
    salts = max(1, -(-max(counts.values(), default=1) // bucket))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    w = Window.partitionBy("length").orderBy("_salt")
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (
        salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
        .join(before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    starts: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, rank, times, seq, offset in rows:
        starts.setdefault(length, []).append((rank, times, seq, offset))
    tables = {k: np.array(v, np.int64) for k, v in starts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                t = tables[int(length[part[0]])]
                at = np.searchsorted(t[:, 0], rank[part], "right") - 1
                seq[part], off[part] = t[at, 2] + rank[part] - t[at, 0], t[at, 3]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return map_arrow(ranked.select(*names, "_rank"), run, schema)


def packed(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset."""
    parts = written(pieces(docs, path or tokenizer_path(), sequence, end, with_ids), "pieces")
    return placed(parts, sequence)
