"""The SimHash step of the pipeline's near_dedup, against brute force."""

import random

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.cases import frame, rows
from tests.llm.test_nearcopies import kept, shingle_set, similarity, staying
from tickloom.llm import nearcopies, simhash


def copies(n=30, seed=11):
    """Pairs of texts of 300 words; 1 to 9 words of the second differ."""
    r, out = random.Random(seed), []
    for k in range(n):
        words = [f"w{r.randrange(5000)}" for _ in range(300)]
        out.append((10 * k, " ".join(words)))
        for at in range(1 + k % 9):
            words[10 + 30 * at] = f"new{k}x{at}"
        out.append((10 * k + 1, " ".join(words)))
    return out


def test_fingerprints_alone_find_copies_within_their_radius(spark):
    data = copies()
    fp = {i: simhash.fingerprint(nearcopies.shingles(t.encode())) for i, t in data}
    sets = {i: shingle_set(t) for i, t in data}
    want = {i for i in fp if i % 10 == 0 and (fp[i] ^ fp[i + 1]).bit_count() <= nearcopies.RADIUS and similarity(sets[i], sets[i + 1]) >= 0.8}
    assert 5 < len(want) < 30
    root = {r.doc_id: r.root for r in nearcopies.rooted(frame(spark, data), minhash=False).collect()}
    assert {i for i in root if i % 10 == 0 and root[i] == root[i + 1]} == want and len(set(root.values())) == len(data) - len(want)
    # close fingerprints alone do not link: here all meet and are still compared exactly
    near = {i for i in fp if i % 10 == 0 and similarity(sets[i], sets[i + 1]) >= 0.8}
    root = {r.doc_id: r.root for r in nearcopies.rooted(frame(spark, data), cell_rows=7, minhash=False, radius=30).collect()}
    assert {i for i in root if i % 10 == 0 and root[i] == root[i + 1]} == near and len(set(root.values())) == len(data) - len(near)


def test_stage_goes_through_the_trees(spark, monkeypatch):
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, radius, *more: asked.append(radius) or links(fps, radius, *more))
    data = rows() + [(i + 1000, t) for i, t in copies(12)]
    assert kept(corpus_pipeline.near_dedup(spark, frame(spark, data), SF_SMALL)) == staying(data)
    assert asked == [nearcopies.RADIUS]
