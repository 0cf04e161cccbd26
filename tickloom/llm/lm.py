"""Language-model scores from an Elias-Fano n-gram trie trained on the corpus.

Tokens are lower-cased words and an end; a text's first tokens follow starts.  The model
interpolates orders 1 to ``ORDER`` with an absolute discount:

    P(w | h) = (c(h w) - D) / c(h) + b(h) P(w | h'),   b(h) = 1 - sum of (c(h x) - D) / c(h),

where h' is h without its first word, n-grams seen fewer than ``KEEP`` times at their
order are left out of the first summand and of the sum over x, and at the root
P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).  Trigrams seen once are left out: they would
only repeat the text that they come from.

Texts are cut into blocks of tokens, which are written to the shared folder.  For each
order a block sends its distinct n-grams with their counts in training documents to the
shards, words by hash range, longer ones by their context.  A shard adds up the counts,
writes its level of the trie (:mod:`trie`), maps it into memory and answers every n-gram
that it was sent from there: the node's number, which is the context's number at the
next order, its probability and its context's backoff weight.  So each level file is
searched by one task, work is in proportion to the input, and no task needs to know
where other levels lie.  Answers go back to their blocks, which add up their documents.

Contexts with more than ``HOT_SHARE`` of all tokens (500,000 at most) and ``HOT_LEAST``
are dealt to the shards by their words; their counts are known from the order before and
their backoff weights are added up from the shards.  All counts are of all training
documents.  Tables of blocks, answers and levels are written before they are read, so a
repeated task reads what the first one did; files of lost attempts are in no table.  The
hashes of a block's words and, unless a folder for the model is given, the files of a
level are deleted as soon as all answers of their order are written.

Words are known by 63-bit hashes.  Nulls and edges: a null text is the end alone; a null
doc_id counts as the empty id text, and is trained on.  Repeated rows count and are
scored each.  Without training documents P(w) is 1 for every token.  An empty table gives
no rows.  A block holds whole texts, however long.  Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tickloom.cluster import removed, shared_path, written
from tickloom.llm.common import bucket5, id_text, map_arrow, release
from tickloom.llm.substrings import whole_shards
from tickloom.llm.trie import ABSENT, probability, quantised, read_level, write_level
from tickloom.llm.warc import filesystem

HELD_OUT = 1
ORDER = 3
#: Least count of the n-grams that a level keeps, by order.
KEEP = (1, 1, 2)
DISCOUNT = 0.75
HOT_SHARE, HOT_LEAST = 1 / 500_000, 50_000
WORD_SHARD_BYTES = 48 << 20
SHARD_BYTES = 20 << 20
BLOCK_BYTES = 5 << 20
#: Of compression.
LEVEL = 3
#: Blocks in one task, about.
TASK_BLOCKS = 4
END, START = 0, 0  # the end's hash; the number of the context of starts

PLACE = "block long, path string, offset long, size long"
ASKED = "shard long, block long, payload binary"
ANSWERED = "block long, level int, shard long, payload binary, path string, tokens long, vocabulary long, node array<long>, count array<long>, hot array<long>, own array<double>"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob: unsigned integers in as few bytes as they need, equal bytes of all numbers together."""
    head, body = struct.pack("<H", len(arrays)), []
    for a in arrays:
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(int(a.max())))
        head += struct.pack("<2sq", a.dtype.str[1:].encode(), len(a))
        body.append((np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T if a.itemsize > 1 else a).tobytes())
    return zstandard.compress(head + b"".join(body), LEVEL)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    (n,), at, out = struct.unpack_from("<H", raw), 2 + 10 * struct.unpack_from("<H", raw)[0], []
    for k in range(n):
        kind, size = struct.unpack_from("<2sq", raw, 2 + 10 * k)
        dtype = np.dtype("<" + kind.decode())
        a = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at)
        out.append(np.ascontiguousarray(a.reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1) if dtype.itemsize > 1 else a.view(dtype))
        at += a.nbytes
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and the place of each value among them."""
    order = np.argsort(x)
    y = x[order]
    new = np.append(True, y[1:] != y[:-1]) if len(y) else np.zeros(0, bool)
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return y[new], back


def token_block(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, number, lengths): distinct hashes in order, END first; each token's place there; each text's tokens."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(full)])
    at = parts.offsets.to_numpy()
    at = at - at[0]
    n = upto[at[1:]] - upto[at[:-1]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    known = np.fromiter((max(xxh64_intdigest(w) >> 1, 1) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(coded.dictionary))
    words, rank = distinct(np.append(known, END))
    lengths = n + 1
    number = np.empty(lengths.sum(), np.int64)
    ends = np.cumsum(lengths) - 1
    word = np.ones(len(number), bool)
    word[ends] = False
    number[word] = rank[:-1][coded.indices.to_numpy()]
    number[ends] = rank[-1]
    return words, number, lengths


def cut(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole texts with so many bytes, across the batches that come in; the last may be smaller."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
        start = 0
        while start < b.num_rows:
            stop = min(b.num_rows, max(start + 1, int(np.searchsorted(upto, upto[start] + block_bytes - size))))
            held.append(b.slice(start, stop - start))
            size += int(upto[stop] - upto[start])
            start = stop
            if size >= block_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def blocks(rows: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block of (doc_id, text, held_out): where it and its words lie, its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, done, files, at = uuid.uuid4().hex, [], [], [0, 0]
        for s in cut(batches, block_bytes):
            words, number, lengths = token_block(s.column(1))
            held = s.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            count = np.bincount(number[np.repeat(held == 0, lengths)], minlength=len(words))
            ids = s.column(0)
            blobs = packed(ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), ids.fill_null(0).to_numpy().view(np.uint64), held, lengths, number), packed(words, count)
            if not files:
                for kind in ("tokens", "words"):
                    fs.create_dir(f"{root}/{kind}", recursive=True)
                    files.append(fs.open_output_stream(f"{root}/{kind}/{name}", compression=None))
            done.append((uuid.uuid4().int >> 65, at[0], len(blobs[0]), at[1], len(blobs[1]), int((held == 0).sum())))
            for k, (f, blob) in enumerate(zip(files, blobs, strict=True)):
                f.write(blob)
                at[k] += len(blob)
        for f in files:
            f.close()
        cols = list(zip(*done, strict=True)) or [()] * 6
        path = [f"{folder.rstrip('/')}/tokens/{name}"] * len(done)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(path, pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["block", "path", "offset", "size", "words_offset", "words_size", "documents"])

    return written(map_arrow(rows.select("doc_id", "text", "held_out"), run, f"{PLACE}, words_offset long, words_size long, documents long"), "lm-blocks")


def stored(path: str, offset: int, size: int) -> list[np.ndarray]:
    """The arrays of a blob in a file."""
    fs, local = filesystem(path)
    with fs.open_input_file(local) as f:
        f.seek(offset)
        return unpacked(f.read(size))


@dataclass
class Plan:
    """What every task knows; its size doesn't depend on the input beyond the bound on hot contexts."""

    model: str  # the folder of the levels
    shards: list[int]  # by order
    keep: tuple[int, ...]
    tokens: int = 0
    vocabulary: int = 0
    #: contexts dealt by word, in order, with their counts and backoff weights, by order from 2
    hot: list[np.ndarray] = field(default_factory=list)
    hot_count: list[np.ndarray] = field(default_factory=list)
    hot_rest: list[np.ndarray] = field(default_factory=list)

    @property
    def order(self) -> int:
        return len(self.shards)

    def hot_at(self, level: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which contexts are hot, and where they stand."""
        hot = self.hot[level - 2]
        if not len(hot):
            return np.zeros(len(context), bool), np.zeros(len(context), np.int64)
        at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
        return hot[at] == context, at

    def shard(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        x = context.astype(np.uint64)
        x = np.where(self.hot_at(level, context)[0], x ^ word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), x)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ x >> np.uint64(32)) % np.uint64(self.shards[level - 1])).astype(np.int64)


def asked_words(plan: Plan, words: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, payload) of a block's words."""
    shard = words.astype(np.int64) >> (63 - (plan.shards[0] - 1).bit_length())
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        yield int(shard[a]), packed(words[a:z], count[a:z])


class Block:
    """The tokens of a block and what has been answered so far."""

    def __init__(self, plan: Plan, path: str, offset: int, size: int):
        valid, ids, self.held, lengths, number = stored(path, offset, size)
        self.plan, self.ids = plan, pa.array(ids.astype(np.uint64).view(np.int64), mask=valid == 0)
        self.lengths, self.number = lengths.astype(np.int64), number.astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.trained = np.repeat(self.held == 0, self.lengths)

    def root(self, answers: list[bytes]) -> None:
        node, count = (np.concatenate(x) for x in zip(*map(unpacked, answers), strict=True))
        order = np.argsort(node, kind="stable")  # from now on words stand in the order of their nodes
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.number, count = place[self.number], count[order]
        self.word = node[order].astype(np.int64)  # 0 for unknown ones
        self.known = self.word > 0
        self.base = (count + 0.5) / (self.plan.tokens + 0.5 * (self.plan.vocabulary + 1))
        self.p = self.base[self.number]
        self._follow(self.word[self.number])

    def _follow(self, node: np.ndarray) -> None:
        """Take the nodes of the n-grams that end at each token; sets its context, -1 for one that is not in the model."""
        self.node = node
        self.context = np.empty_like(node)
        self.context[1:] = np.where(node[:-1] > 0, node[:-1], -1)
        self.context[self.first] = START

    def entries(self, level: int) -> None:
        """The distinct n-grams whose context is in the model, in the order in which shards get them.

        An n-gram whose last words are too rare for this level is left out; a context with
        no other is asked for its backoff weight alone, as if before word 0.
        """
        width = len(self.word) + 1
        self.asks = np.flatnonzero(self.context >= 0)
        self.contexts, self.rank = distinct(self.context[self.asks])
        rare = level > 2 and self.plan.keep[level - 1] > 1  # nodes are numbered if they are frequent enough for this level
        self.worth = np.flatnonzero(self.node[self.asks] > 0) if rare else np.arange(len(self.asks))
        code, entry = distinct(self.rank[self.worth] * width + self.number[self.asks[self.worth]] + 1)
        is_hot, _ = self.plan.hot_at(level, self.contexts)
        bare = ~is_hot
        bare[code // width] = False
        bare = np.flatnonzero(bare)
        order = np.argsort(np.concatenate([code, bare * width]), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.entry = place[entry]
        self.entry_rank = np.concatenate([code // width, bare])[order]
        self.entry_word = np.concatenate([self.word[code % width - 1], np.zeros(len(bare), np.int64)])[order]
        shard = self.plan.shard(level, self.contexts[self.entry_rank], self.entry_word)
        sent = np.argsort(shard.astype(np.uint16 if self.plan.shards[level - 1] <= 1 << 16 else np.int64), kind="stable")
        shard = shard[sent]
        self.parts = np.split(sent, np.flatnonzero(np.diff(shard)) + 1) if len(shard) else []
        self.part_shard = [int(x) for x in shard[np.append(True, shard[1:] != shard[:-1])]] if len(shard) else []

    def asked(self, level: int) -> Iterator[tuple[int, bytes]]:
        """(shard, payload) of the n-grams of one order: contexts, the words and counts of each, its count in all."""
        self.entries(level)
        trained = self.trained[self.asks]
        count = np.bincount(self.entry[trained[self.worth]], minlength=len(self.entry_word))
        whole = np.bincount(self.rank[trained], minlength=len(self.contexts))
        for shard, p in zip(self.part_shard, self.parts, strict=True):
            new = self.runs(p)
            context = self.entry_rank[p[new]]
            yield shard, packed(np.diff(self.contexts[context], prepend=0), np.diff(np.append(new, len(p))), self.entry_word[p], count[p], whole[context])

    def runs(self, p: np.ndarray) -> np.ndarray:
        """Where the contexts of a part begin."""
        context = self.entry_rank[p]
        return np.flatnonzero(np.append(True, context[1:] != context[:-1]))

    def answered(self, level: int, answers: list[bytes]) -> None:
        self.entries(level)
        if not len(self.asks):
            self._follow(np.zeros(len(self.number), np.int64))
            return
        node, part, rest = np.zeros(len(self.entry_word), np.int64), np.empty(len(self.entry_word), np.uint16), np.zeros(len(self.contexts), np.uint16)
        for p, shard, answer in zip(self.parts, self.part_shard, answers, strict=True):
            step, part[p], least = unpacked(answer)
            rest[self.entry_rank[p[self.runs(p)]]] = least
            at = np.flatnonzero(step)
            node[p[at]] = (np.cumsum(step[at].astype(np.int64)) - 1) * self.plan.shards[level - 1] + shard + 1
        rest = probability(rest)
        is_hot, at = self.plan.hot_at(level, self.contexts)
        if is_hot.any():
            rest[is_hot] = self.plan.hot_rest[level - 2][at[is_hot]]
        self.p[self.asks] *= rest[self.rank]
        worth = self.asks[self.worth]
        self.p[worth] = np.minimum(self.p[worth] + probability(part)[self.entry], 1.0)
        nodes = np.zeros(len(self.number), np.int64)
        nodes[worth] = node[self.entry]
        self._follow(nodes)

    def rows(self) -> pa.RecordBatch:
        total = lambda x: np.add.reduceat(x, self.first)
        return pa.RecordBatch.from_arrays(
            [self.ids, pa.array(self.held == 1), pa.array(self.lengths), pa.array(total(self.known[self.number].astype(np.int64))), pa.array(np.full(len(self.lengths), self.plan.tokens, np.int64)), pa.array(total(np.log10(self.base)[self.number])), pa.array(total(np.log10(self.p)))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def resumed(plan: Plan, answers: Iterator[pa.RecordBatch], upto: int) -> Iterator[tuple[int, Block]]:
    """Each block with the orders up to one taken in; rows are (block, level, payload, shard, path, offset, size), sorted.

    The row of level 0 says where the block lies.
    """
    for b in whole_shards(answers):
        level, payload = b.column(1).to_pylist(), b.column(2).to_pylist()
        block = Block(plan, *(b.column(k)[0].as_py() for k in (4, 5, 6)))
        for k in range(1, upto + 1):
            mine = [p for x, p in zip(level, payload, strict=True) if x == k]
            block.root(mine) if k == 1 else block.answered(k, mine)
        yield b.column(0)[0].as_py(), block


def _message(block: int, asked: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    shard, payload = zip(*asked, strict=True) if (asked := list(asked)) else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array([block] * len(shard), pa.int64()), pa.array(payload, pa.binary())], names=["shard", "block", "payload"])


def _answer(b: pa.RecordBatch, level: int, payload: list[bytes], path: str, tokens: int, vocabulary: int, node: np.ndarray, count: np.ndarray, hot: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """Answers to the messages of a shard, and a last row that describes its level file."""
    n = b.num_rows
    lone = lambda x, kind: pa.array([None] * n + [x], kind)
    cols = [pa.concat_arrays([b.column(1), pa.array([None], pa.int64())]), pa.array([level] * (n + 1), pa.int32()), pa.array([b.column(0)[0].as_py()] * (n + 1), pa.int64()), pa.array([*payload, None], pa.binary()), lone(path, pa.string()), lone(tokens, pa.int64()), lone(vocabulary, pa.int64())]
    cols += [lone(x.tolist(), pa.list_(t)) for x, t in ((node, pa.int64()), (count, pa.int64()), (hot, pa.int64()), (own, pa.float64()))]
    return pa.RecordBatch.from_arrays(cols, names=["block", "level", "shard", "payload", "path", "tokens", "vocabulary", "node", "count", "hot", "own"])


def word_level(plan: Plan, b: pa.RecordBatch, hot_least: int) -> pa.RecordBatch:
    """Add up a shard's words, write its level and answer each word with its number (0: unknown) and count."""
    shard = b.column(0)[0].as_py()
    got = [unpacked(x) for x in b.column(2).to_pylist()]
    h, back = distinct(np.concatenate([g[0] for g in got]).astype(np.int64))
    n = np.bincount(back, np.concatenate([g[1] for g in got]), len(h)).astype(np.int64)
    # numbers by falling count: most of what is sent later are the numbers of frequent words, which are small
    number = np.empty((n > 0).sum(), np.int64)
    number[np.argsort(-n[n > 0], kind="stable")] = np.arange(len(number))
    path = write_level(f"{plan.model}/1", uuid.uuid4().hex, {"keys": h[n > 0]}, {"count": n[n > 0], "number": number})
    sequences, plain = read_level(path)
    at = sequences["keys"].find(h)
    node = np.where(at >= 0, np.append(plain["number"], 0)[at] * plan.shards[0] + shard + 1, 0)
    count = np.where(at >= 0, np.append(plain["count"], 0)[at], 0)
    ends = np.cumsum([len(g[0]) for g in got])
    often = count > hot_least
    return _answer(b, 1, [packed(node[i], count[i]) for i in np.split(back, ends[:-1])], path, int(count.sum()), int((n > 0).sum()), node[often], count[often], np.zeros(0, np.int64), np.zeros(0))


def deep_level(plan: Plan, b: pa.RecordBatch, level: int, hot_least: int) -> pa.RecordBatch:
    """Add up a shard's n-grams, write its level and answer each with its node, probability and backoff weight."""
    shard, keep = b.column(0)[0].as_py(), plan.keep[level - 1]
    got = [unpacked(x) for x in b.column(2).to_pylist()]
    context, run = distinct(np.concatenate([np.cumsum(g[0].astype(np.int64)) for g in got]))
    whole = np.bincount(run, np.concatenate([g[4] for g in got]), len(context)).astype(np.int64)
    back = np.repeat(run, np.concatenate([g[1] for g in got]))
    word = np.concatenate([g[2] for g in got]).astype(np.int64)
    width = int(word.max()) + 1
    if len(context) * width >= 1 << 63:
        raise OverflowError(f"{len(context)} contexts of {width} words do not fit one shard; use smaller shards")
    key, back = distinct(back * width + word)
    n = np.bincount(back, np.concatenate([g[3] for g in got]), len(key)).astype(np.int64)
    of, word = key // width, key % width
    is_hot, at = plan.hot_at(level, context)
    if is_hot.any():
        whole = np.where(is_hot, plan.hot_count[level - 2][at], whole)
    # what the level keeps: contexts that were seen, and their successors that were seen often enough
    seen = whole > 0
    number = np.cumsum(seen) - 1
    stay = (n >= keep) & (word > 0)
    share = np.where(stay, (n - DISCOUNT) / np.maximum(whole[of], 1), 0.0)
    own = np.bincount(of, share, len(context))
    path = write_level(
        f"{plan.model}/{level}", uuid.uuid4().hex,
        {"contexts": context[seen], "pointers": np.concatenate([[0], np.cumsum(np.bincount(number[of[stay]], minlength=seen.sum()))]), "successors": number[of[stay]] * width + word[stay]},
        {"code": quantised(share[stay]), "rest": quantised(1 - own[seen]), "often": (n[stay] >= plan.keep[min(level, plan.order - 1)]).astype(np.uint8)},
    )
    # the answers come from the level alone
    sequences, plain = read_level(path)
    context_at = sequences["contexts"].find(context)
    ask = np.flatnonzero(context_at[of] >= 0)
    at = np.full(len(key), -1, np.int64)
    at[ask] = sequences["successors"].find(context_at[of[ask]] * width + word[ask])
    found = np.flatnonzero(at >= 0)
    pointers = sequences["pointers"].get(np.arange(len(context_at[context_at >= 0]) + 1))
    if not ((pointers[context_at[of[found]]] <= at[found]) & (at[found] < pointers[context_at[of[found]] + 1])).all():
        raise ValueError(f"the level {path} has a successor outside its context")
    part, rest, node = np.full(len(key), ABSENT, np.uint16), np.zeros(len(context), np.uint16), np.zeros(len(key), np.int64)
    part[found], rest[context_at >= 0] = plain["code"][at[found]], plain["rest"][context_at[context_at >= 0]]
    if level < plan.order:
        go = found[plain["often"][at[found]] > 0]
        node[go] = at[go] + 1
    answers = []
    for g, mine in zip(got, np.split(back, np.cumsum([len(g[2]) for g in got])[:-1]), strict=True):
        # numbers of nodes rise with context and word, as messages do, so they are sent as steps; 0 for none
        step, has = np.zeros(len(mine), np.int64), np.flatnonzero(node[mine])
        step[has] = np.diff(node[mine[has]], prepend=0)
        answers.append(packed(step, part[mine], rest[of[mine[np.cumsum(g[1].astype(np.int64)) - 1]]]))
    often = (n > hot_least) & (node > 0)
    return _answer(b, level, answers, path, 0, 0, (node[often] - 1) * plan.shards[level - 1] + shard + 1, n[often], context[is_hot], own[is_hot])


def scored(docs: DataFrame, order: int = ORDER, keep: tuple[int, ...] = KEEP, word_shard_bytes: int = WORD_SHARD_BYTES, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, hot_least: int = HOT_LEAST, model: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every document.

    ``model`` names a shared folder in which the levels of the trie stay, a folder for each order.
    """
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("held_out", bucket5() == HELD_OUT)
    folder = shared_path(spark, "lm")
    where = blocks(rows, folder, block_bytes)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = where.agg(F.count("*"), F.coalesce(F.sum("documents"), F.lit(0))).first()
    tasks = min(20_000, max(1, -(-size[0] // TASK_BLOCKS)))
    words = 1 << (max(1, -(-total // word_shard_bytes)) - 1).bit_length()
    plan = Plan(model or f"{folder}/levels", [words] + [max(1, -(-total // shard_bytes))] * (order - 1), keep)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, path, _, _, offset, n in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                yield _message(block, asked_words(plan, *stored(path.replace("/tokens/", "/words/", 1), offset, n)))

    def by_block(answers: list[DataFrame]) -> DataFrame:
        none = lambda kind: F.lit(None).cast(kind)
        every = where.select("block", F.lit(0).alias("level"), none("binary").alias("payload"), none("long").alias("shard"), "path", "offset", "size")
        for a in answers:
            every = every.unionByName(a.where("block is not null").select("block", "level", "payload", "shard", none("string").alias("path"), none("long").alias("offset"), none("long").alias("size")))
        return every.repartition(tasks, "block").sortWithinPartitions("block", "level", "shard")

    def asked(level: int, answers: list[DataFrame]) -> DataFrame:
        if level == 1:
            return map_arrow(where.drop("documents").repartition(tasks), ask_words, ASKED)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, block in resumed(plan, batches, level - 1):
                yield _message(number, block.asked(level))

        return map_arrow(by_block(answers), run, ASKED)

    def answered(level: int, messages: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in whole_shards(batches):
                yield word_level(plan, b, hot_least) if level == 1 else deep_level(plan, b, level, hot_least)

        dealt = messages.repartition(min(plan.shards[level - 1], 20_000), "shard").sortWithinPartitions("shard")
        return written(map_arrow(dealt, run, ANSWERED), f"lm-answers-{level}")

    answers: list[DataFrame] = []
    for level in range(1, order + 1):
        answers.append(answered(level, asked(level, answers)))
        about = answers[-1].where("block is null")
        if level == 1:
            t = about.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
            plan.tokens, plan.vocabulary = t[0], t[1]
        else:
            own = {r["hot"]: r["own"] for r in about.select(F.explode(F.arrays_zip("hot", "own")).alias("x")).groupBy(F.col("x.hot").alias("hot")).agg(F.sum("x.own").alias("own")).collect()}  # of hot contexts only
            plan.hot_rest.append(np.array([1 - own.get(h, 0.0) for h in plan.hot[level - 2].tolist()]))
        if level < order:
            least = max(hot_least, HOT_SHARE * plan.tokens)
            hot = about.select(F.explode(F.arrays_zip("node", "count")).alias("x")).select("x.node", "x.count").where(F.col("count") > least).collect()  # 1 / HOT_SHARE rows at most
            found = sorted([(r["node"], r["count"]) for r in hot] + [(START, size[1])] * (size[1] > least))
            plan.hot.append(np.array([h for h, _ in found], np.int64))
            plan.hot_count.append(np.array([n for _, n in found], np.int64))
        for done in [f"{folder}/words"] * (level == 1) + [f"{folder}/levels/{level}"]:  # a model's folder is another
            removed(spark, done)
        release(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in resumed(plan, batches, order):
            yield block.rows()

    return map_arrow(by_block(answers), run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
