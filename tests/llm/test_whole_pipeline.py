"""run() against the five stages in plain Python, on whole small tables."""

import re
import zlib

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_long_lines import left
from tests.llm.test_nearcopies import staying
from tickloom.llm import packing, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def path(tree, x, node=0):
    """Depth at which a row ends in a tree, with what usually follows below it, by walking down."""
    feature, cut, child, rest = tree
    return rest[node] if feature[node] < 0 else path(tree, x, child[node][int(x[feature[node]] >= cut[node])])


def good(docs, model):
    """Documents that the rules and the mean path through the forest keep."""
    forest, top, threshold = model
    trees = list(zip(forest.feature, forest.cut, forest.child, forest.rest))
    out = []
    for i, t in docs:
        s = quality.text_stats((t or "").encode(), len(t or ""))
        if s[0] < 50 or 2 * s[4] > s[0]:
            continue
        x = quality.features(np.array([s]), top)[0]
        if 2 ** -(sum(path(tree, x) for tree in trees) / len(trees) / forest.usual) < threshold:
            out.append((i, t))
    return out


def clean(docs, items):
    lower = lambda t: "".join(c.lower() if c < "\x80" else c for c in t or "")
    wins = {}
    for _, t in items:
        w = WORD.findall(lower(t))
        for a in range(len(w) - min(10, len(w)) + 1 if w else 0):
            wins.setdefault(min(10, len(w)), set()).add(tuple(w[a : a + min(10, len(w))]))
    out = []
    for i, t in docs:
        w = WORD.findall(lower(t))
        if not any(tuple(w[a : a + n]) in those for n, those in wins.items() for a in range(len(w) - n + 1)):
            out.append((i, t))
    return out


def test_run(spark):
    docs = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pydict()
    items = pq.read_table(f"{SF_SMALL}/benchmark.parquet").to_pydict()
    frame = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = quality.fitted(quality.stats(frame), spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    assert model is not None
    kept = good(list(zip(docs["doc_id"], docs["text"])), model)
    assert 0 < len(kept) < len(docs["doc_id"])
    rest = clean(staying(left(kept)), list(zip(items["item_id"], items["text"])))
    want = set()
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(packing.tokenizer_path())
    for i, t in rest:
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 0]
        first, at, piece = len(ids) % 2048 or 2048, 0, 0
        while at < len(ids):
            size = first if at == 0 else 2048
            want.add((i, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at, piece = at + size, piece + 1
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    places: dict = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert sorted(p)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:])) and sum(n for _, n in p) <= 2048
