"""Near copies against brute force over all pairs."""

import random
import re
from fractions import Fraction

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.cases import frame, rows
from tickloom.llm import nearcopies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return Fraction(len(a & b), len(a | b)) if a | b else Fraction(1)


def groups(data):
    """The group of each row, as the index of a row of it, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if find(a) != find(b) and (sets[a] == sets[b] or 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and similarity(sets[a], sets[b]) >= Fraction(4, 5)):
                root[find(a)] = find(b)
    return [find(x) for x in range(len(data))]


def staying(data):
    """(doc_id, text) of each group's smallest doc_id, null ids last."""
    best = {}
    for (i, t), r in zip(data, groups(data)):
        best[r] = min(best.get(r, (True, 0, "")), (i is None, i or 0, t or ""))
    return sorted(((None if null else i, t) for null, i, t in best.values()), key=str)


def near_copies(start, seed=5):
    """Sources of 300 words, each with copies of falling similarity on both sides of 0.8."""
    r = random.Random(seed)
    out = []
    for k in range(6):
        source = [f"w{r.randrange(5000)}" for _ in range(300)]
        out.append((start + 20 * k, " ".join(source)))
        for j, n in enumerate((1, 2, 3, 4, 5, 6, 7, 8)):
            copy = list(source)
            for at in range(n):
                copy[10 + 36 * at] = f"new{k}x{j}x{at}"
            out.append((start + 20 * k + 1 + j, " ".join(copy)))
    return out


def kept(df):
    return sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)


def test_near_copies(spark):
    data = rows() + near_copies(1000)
    got = nearcopies.deduplicated(frame(spark, data))
    assert got.columns == frame(spark).columns
    assert kept(got) == staying(data)


def test_stage_drops_near_copies_at_the_threshold(spark):
    # 100 shingles each; 88 or 89 of them shared: 88 / 112 is below 0.8, 89 / 111 above
    words = [f"w{k}" for k in range(104)]
    above, below = words[:93] + [f"x{k}" for k in range(11)], words[:92] + [f"y{k}" for k in range(12)]
    data = [(1, " ".join(words)), (2, " ".join(above)), (3, " ".join(below))]
    assert [similarity(shingle_set(data[0][1]), shingle_set(t)) for _, t in data[1:]] == [Fraction(89, 111), Fraction(88, 112)]
    got = corpus_pipeline.near_dedup(spark, frame(spark, data[:2]), SF_SMALL)
    assert [r.doc_id for r in got.collect()] == [1]
    got = corpus_pipeline.near_dedup(spark, frame(spark, data[::2]), SF_SMALL)
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert kept(nearcopies.deduplicated(docs)) == staying(data)
