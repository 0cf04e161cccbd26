"""Near copies by SimHash and exact Jaccard similarity of five-word shingles.

Two texts are linked if the sets of their shingles have a Jaccard similarity of
``SIMILARITY`` or more; components of links are the groups, and the smallest doc_id
of each stays.  Texts with equal sets are one node before anything else.  Each set has a
SimHash fingerprint, and the sharded BK-trees of :mod:`simhash` link fingerprints within
``RADIUS`` bits: a component of these is a bucket, in which all nodes meet and are
compared exactly.  Pairs at the threshold may differ in more bits than a BK-tree can
search (the README has figures), so nodes that share a MinHash band meet in a bucket too.

A pair at the threshold shares none of ``BANDS`` bands of ``ROWS`` minima with
probability (1 - 0.8 ** 5) ** 32 = 3e-6, a closer one with less; no other pair is left
out, and none that the fingerprints link.  In each bucket
every node is first compared with the bucket's hub, the node that meets most others
over all its buckets, and components are formed.  Where a bucket then still holds
several components, its nodes outside the largest are compared with all others of the
bucket: both sides are cut into slices of about ``CELL_ROWS`` nodes, each two slices
that must meet are a cell, and a cell's task counts shared shingles by an inverted
index and returns a spanning forest of what it finds.  So every pair that shares a
bucket is either compared or in one component already, no pairs are made as rows, and a
group of near copies costs rows in proportion to its size times the slices of those
that its hub does not reach.

Nulls and edges: a null text is an empty one; texts without words are copies of each
other.  Texts with fewer words than a shingle are one shingle.  Letters of ASCII count
as lower case.  Rows with a null doc_id link like others and stay only if all rows of
their group have none.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tickloom.cluster import written
from tickloom.llm import simhash
from tickloom.llm.common import bytes_list, join_documents, map_arrow, unpacked, whole_rows
from tickloom.llm.components import components
from tickloom.llm.substrings import whole_shards

SHINGLE = 5
SIMILARITY = (4, 5)  # as a fraction, so that ties are exact
#: Bits in which fingerprints may differ that propose a pair.
RADIUS = 6
#: Nodes of one slice of a bucket, about.
CELL_ROWS = 256
BANDS = 32
ROWS = 5
_DRAW = np.random.default_rng(8)
_XOR, _ODD = (_DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_ODD = _ODD * np.uint64(2) + np.uint64(1)


def shingles(raw: bytes | None) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    return np.unique(simhash.hashes((raw or b"").lower(), SHINGLE))


def bands(s: np.ndarray) -> list[int]:
    """A key of each band of minima; none for the empty set."""
    if not len(s):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(s), 1024):  # bounded memory for very long texts
        x = (s[at : at + 1024, None] ^ _XOR) * _ODD
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(0), out=least)
    rows = least.reshape(BANDS, ROWS).astype("<u8")
    return [xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets of sorted hashes reaches the threshold."""
    up, down = SIMILARITY
    if min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both * down >= (len(a) + len(b) - both) * up


def _nodes(docs: DataFrame, minhash: bool = True) -> DataFrame:
    """(doc_id, th, node, n, fp, keys): a node is the hash of a set of n shingles, fp its fingerprint, keys are its bands'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(raw) for raw in bytes_list(b.column(1))]
            node = np.array([xxh64_intdigest(s.astype("<u8").tobytes()) for s in sets], np.uint64)
            fp = np.array([simhash.fingerprint(s) for s in sets], np.uint64)
            keys = pa.array([np.array(bands(s) if minhash else [], np.uint64).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(node.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp.view(np.int64)), keys],
                names=["doc_id", "th", "node", "n", "fp", "keys"],
            )

    return map_arrow(whole_rows(docs).select("doc_id", "text", "th"), run, "doc_id long, th long, node long, n long, fp long, keys array<long>")


def _close(nodes: DataFrame, radius: int) -> DataFrame:
    """(node, n, key): nodes whose fingerprints the BK-trees link, directly or by way of others, have one key."""
    fps = nodes.where("n > 0").select("node", "n", "fp").distinct()
    comp = components(simhash.links(written(fps.select("fp").distinct(), "nearcopies-fps"), radius), "nearcopies-simhash")
    root = written(comp.select(F.col("node").alias("_fp"), "root"), "nearcopies-close")
    return fps.join(root, F.col("fp") == F.col("_fp"), "left").select("node", "n", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"))


def _shingled(texts: DataFrame) -> DataFrame:
    """(node, shingles): the sorted hashes of each text's shingles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                raw = [shingles(x).astype("<u8").tobytes() for x in bytes_list(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["node", "shingles"])

    return map_arrow(texts, run, "node long, shingles binary")


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are alike; sets has (node, shingles)."""
    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    two = one.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [alike(x, y) for x, y in zip(_sets(b.column(2)), _sets(b.column(3)), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return map_arrow(two, run, "u long, v long")


def cell_links(asks: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (a, b) of rows that connect all rows linked to an asking one; rows of one label are connected already."""
    up, down = SIMILARITY
    size = np.array([len(x) for x in sets])
    every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    label, found = label.copy(), []
    for a in np.flatnonzero(asks).tolist():
        low, high = np.searchsorted(every, sets[a], "left"), np.searchsorted(every, sets[a], "right")
        width = high - low
        at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())
        both = np.bincount(row[at], minlength=len(sets))
        hit = np.flatnonzero((both * down >= (size[a] + size - both) * up) & (label != label[a]))
        for other, b in zip(*(x.tolist() for x in np.unique(label[hit], return_index=True)), strict=True):
            found.append((a, int(hit[b])))
            label[label == other] = label[a]
    return found


def _cells(held: DataFrame, cell_rows: int) -> DataFrame:
    """(cell, node, label, ask): the nodes of buckets with several labels, dealt to the cells in which they must meet."""
    each = held.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = each.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("c"), F.count("*").alias("labels")).where("labels > 1")
    slices = lambda c: F.ceil(c / cell_rows).cast("int")
    mixed = written(mixed.select("key", F.col("top.label").alias("main"), slices(F.col("top.c")).alias("inner"), slices(F.col("c") - F.col("top.c")).alias("outer")), "nearcopies-mixed")
    out = F.col("label") != F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(out, F.col("outer")).otherwise(F.col("inner"))).cast("int")
    rows = held.join(mixed, "key").select("key", "node", "label", "inner", "outer", out.alias("out"), own.alias("own"))

    def meet(kind: int, count: str, first: Callable[[Column], Column], second: Callable[[Column], Column], ask: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda x: F.struct(F.xxhash64("key", F.lit(kind), first(x), second(x)).alias("cell"), ask(x).alias("ask")))

    mine = lambda x: F.col("own")
    among = meet(0, "outer", lambda x: F.least("own", x), lambda x: F.greatest("own", x), lambda x: F.col("own") <= x)
    against = meet(1, "inner", mine, lambda x: x, lambda x: F.lit(True))
    asked = meet(1, "outer", lambda x: x, mine, lambda x: F.lit(False))
    return rows.select("node", "label", F.inline(F.when(F.col("out"), F.concat(among, against)).otherwise(asked)))


def _linked(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what is alike in the same cell."""
    spark = cells.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_shards(batches):
            label, ask = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            node = b.column(1).to_numpy()
            pairs = np.array(cell_links(ask, label, _sets(b.column(4))), np.int64).reshape(-1, 2)
            u, v = node[pairs[:, 0]], node[pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    rows = cells.join(sets, "node").select("cell", "node", "label", "ask", "shingles")
    return map_arrow(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell"), run, "u long, v long")


def _ordered(a, b):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def rooted(docs: DataFrame, cell_rows: int = CELL_ROWS, minhash: bool = True, radius: int = RADIUS) -> DataFrame:
    """(doc_id, th, root) for every document; documents of one group have one root.

    Without ``minhash`` only the fingerprints propose pairs, which shows what they find by themselves.
    """
    up, down = SIMILARITY
    every = written(_nodes(docs, minhash), "nearcopies")
    ids = every.select("doc_id", "th", "node")
    close = written(_close(every, radius), "nearcopies-fingerprints")
    one = every.dropDuplicates(["node"]).select("node", "n", F.explode("keys").alias("key")).unionByName(close)
    counts = written(one.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "nearcopies-counts")
    shared = written(one.join(counts, "key"), "nearcopies-shared")
    meets = written(shared.groupBy("node").agg(F.sum("c").alias("meets")), "nearcopies-meets")
    hubs = written(shared.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node", "n")).alias("hub")).select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "nearcopies-hubs")

    # the shingles of each node that shares a bucket, from one of its texts
    name = ids.join(meets.select("node"), "node").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("x")).select("node", F.col("x.doc_id").alias("doc_id"), F.col("x.th").alias("th"))
    sets = written(_shingled(join_documents(whole_rows(docs).select("doc_id", "th", "text"), name).dropDuplicates(["node"]).select("node", "text")), "nearcopies-sets")

    fits = F.least("n", "hub_n") * down >= F.greatest("n", "hub_n") * up
    star = shared.join(hubs, "key").where("node <> hub").where(fits).select(*_ordered("node", "hub")).distinct()
    first = written(_compared(star, sets), "nearcopies-stars")
    label = written(components(first, "nearcopies-first"), "nearcopies-labels")
    held = written(shared.join(label, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label")), "nearcopies-held")
    second = written(_linked(_cells(held, cell_rows), sets), "nearcopies-rest")

    comp = written(components(first.unionByName(second), "nearcopies-links"), "nearcopies-components")
    return written(ids.join(comp, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root")), "nearcopies-named")


def grouped(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, th, component_id, root) for every document; component_id is the smallest doc_id of its group."""
    named = rooted(docs, cell_rows)
    least = written(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "nearcopies-least")
    return named.join(least, "root").select("doc_id", "th", "component_id", "root")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with all its columns."""
    one = rooted(docs).groupBy("root").agg(F.min_by(F.struct("doc_id", "th"), F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("one")).select("one.doc_id", "one.th")
    stay = join_documents(whole_rows(docs), one).select("row", "doc_id", "th")
    return unpacked(stay.dropDuplicates(["doc_id", "th"]), docs.columns)
