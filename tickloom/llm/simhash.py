"""SimHash near-duplicates by sharded BK-trees.

Fingerprints have 64 bits: a bit is set if it is set in more than half of the
XXH64 values of a text's word shingles.  Texts are linked if their fingerprints
differ in at most ``RADIUS`` bits; components of links are the duplicate groups.

Copies share a fingerprint, so they are reduced to one row for each fingerprint
before anything else.  Distinct fingerprints are dealt to shards by blocks of bits:
the 64 bits fall into ``RADIUS + 2`` blocks, of which at least two are equal for
any linked pair, so the pair meets in the shard of that pair of blocks.  Each shard
is a BK-tree, whose children are keyed by their Hamming distance to the parent; a
search follows only edges within the radius of the probe's distance.  A task builds
and searches the trees of all its shards in lockstep.  A shard of more than
``SHARD_ROWS`` fingerprints is split into slices: each slice is a tree, sent to one task for each
other slice that probes it, so a task holds two slices at most and no group,
however large, has to fit one task.

Only a spanning star of what is linked leaves a task; components are then
contracted in :mod:`components`.

Nulls and edges: a null text is an empty one; texts without words have fingerprint
zero and link like any other.  Texts with fewer words than a shingle are hashed
whole.  Rows with a null doc_id get a fingerprint and a component like others, but
are never the name of a component unless all its rows are null.  Repeated rows and
ties fall into one component.  Very long texts are hashed whole, a part at a time.
Empty tables give no rows.  Other columns than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tickloom.cluster import written
from tickloom.llm.common import bytes_list, join_documents, map_arrow, unpacked, whole_rows
from tickloom.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints in one BK-tree at most; larger shards are split into slices.
SHARD_ROWS = 20_000
PROBES = 512


def hashes(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all word shingles of a text that is already lower case."""
    words = raw.split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxh64_intdigest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    view = memoryview(flat)
    return np.fromiter((xxh64_intdigest(view[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, n)


def fingerprint(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): th is the text's hash, the fingerprint a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(hashes(raw.lower(), shingle)) if raw else 0 for raw in bytes_list(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    return map_arrow(whole_rows(docs).select("doc_id", "text", "th"), run, "doc_id long, th long, fp long")


def block_masks(radius: int = RADIUS) -> list[int]:
    """Masks of all pairs of radius + 2 blocks; two values within the radius agree under at least one."""
    cuts = np.linspace(0, 64, radius + 3).round().astype(int).tolist()
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x | y for x, y in combinations(blocks, 2)]


class BKForest:
    """BK-trees of several shards, as flat arrays built and searched level by level."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        """``shard`` must be sorted; every value becomes a node, equal values of a shard must have been merged."""
        n = len(value)
        self.value = value
        first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if n else np.zeros(0, np.int64)
        self.roots, self.root_shard = first, shard[first]
        node = first[np.cumsum(np.append(True, shard[1:] != shard[:-1])) - 1] if n else first
        live = np.setdiff1d(np.arange(n), first, assume_unique=True)
        node = node[live]
        parents, edges, kids = [], [], []
        while len(live):
            far = np.bitwise_count(value[live] ^ value[node]).astype(np.int64)
            order = np.lexsort((live, far, node))
            live, node, far = live[order], node[order], far[order]
            lead = np.append(True, (node[1:] != node[:-1]) | (far[1:] != far[:-1]))
            parents.append(node[lead]), edges.append(far[lead]), kids.append(live[lead])
            node = live[lead][np.cumsum(lead) - 1]
            live, node = live[~lead], node[~lead]
        p, e, k = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, edges, kids))
        order = np.lexsort((e, p))
        self.key, self.kid = p[order] * 128 + e[order], k[order]

    def within(self, shard: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(probe index, node) of all values of a probe's shard within the radius."""
        at = np.minimum(np.searchsorted(self.root_shard, shard), len(self.roots) - 1)
        asks = np.flatnonzero(self.root_shard[at] == shard)
        node = self.roots[at[asks]]
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(asks):
            far = np.bitwise_count(probe[asks] ^ self.value[node]).astype(np.int64)
            hit = far <= radius
            hits.append((asks[hit], node[hit]))
            low = np.searchsorted(self.key, node * 128 + np.maximum(far - radius, 0), "left")
            high = np.searchsorted(self.key, node * 128 + far + radius, "right")
            width = high - low
            step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            asks, node = np.repeat(asks, width), self.kid[np.repeat(low, width) + step]
        return (np.concatenate([x for x, _ in hits]), np.concatenate([y for _, y in hits])) if hits else (asks, node)


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after merging along the edges (a, b); a label is the smallest index reached."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def linked(shard: np.ndarray, member: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (value, root value) of what is linked inside each shard.

    Rows with ``member`` false only probe: their trees are those of other rows of the shard.
    """
    order = np.lexsort((value, shard))
    shard, member, value = shard[order], member[order], value[order]
    forest = BKForest(shard[member], value[member])
    index = np.flatnonzero(member)
    label = np.arange(len(value))
    for at in range(0, len(value), PROBES):
        part = slice(at, at + PROBES)
        asks, node = forest.within(shard[part], value[part], radius)
        a, b = asks + at, index[node]
        if (go := a != b).any():
            label = _roots(label, a[go], b[go])
    moved = np.flatnonzero(label != np.arange(len(value)))
    return value[moved], value[label[moved]]


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints ``fp`` within the radius of one another."""
    masks = block_masks(radius)
    one = fps.select(F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for i, m in enumerate(masks)))).alias("s"), "fp").select("s.m", "s.k", "fp")
    sizes = one.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1").withColumn("slices", F.ceil(F.col("n") / shard_rows).cast("int"))
    shards = one.join(sizes, ["m", "k"]).select("m", "k", "fp", "slices", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int").alias("own"))
    # every two slices meet in one task, the lower as a tree, the higher as probes; a slice also meets itself
    rows = shards.select("m", "k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    rows = rows.select(F.xxhash64("m", "k", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), (F.col("own") <= F.col("other")).alias("member"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_shards(batches):
            shard, member, value = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            u, v = linked(shard, member, value.view(np.uint64), radius)
            pairs = np.unique(np.stack([u, v], 1), axis=0) if len(u) else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy().view(np.int64)) for i in (0, 1)], names=["u", "v"])

    return map_arrow(rows.repartition("shard").sortWithinPartitions("shard"), run, "u long, v long")


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no shard of the sorted stream is split."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        shard = b.column(0).to_numpy()
        cut = int(np.searchsorted(shard, shard[-1]))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def grouped(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, th, fp, root, component_id) for every document; root is the fingerprint that names the component."""
    fp = written(fingerprints(docs, shingle), "simhash")
    each = written(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    comp = components(links(each.select("fp"), radius, shard_rows), "simhash-links")
    # aggregates are written before they are joined on their own key, so that Spark can split hot keys
    named = written(each.join(comp, each.fp == comp.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-named")
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    final = written(named.join(least, "root").select("fp", "root", "component_id"), "simhash-final")
    return fp.join(final, "fp").select("doc_id", "th", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable)."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest doc_id (null only where all are), with all its columns."""
    first = F.min_by(F.struct("doc_id", "th"), F.struct(F.col("doc_id").isNull(), "doc_id", "th"))
    one = grouped(docs).groupBy("root").agg(first.alias("one")).select("one.doc_id", "one.th")
    rows = whole_rows(docs)
    stay = join_documents(rows, one).select("row", "doc_id", "th")
    return unpacked(stay.dropDuplicates(["doc_id", "th"]), docs.columns)
