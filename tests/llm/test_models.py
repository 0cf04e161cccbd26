"""Models, archives and packing: against brute force, exact round trips and held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import frame, rows, vocabulary
from tickloom.llm import fmindex, lm, packing, toxicity, trie, warc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 60), unique=True), st.lists(st.integers(0, 1 << 60), max_size=20))
def test_elias_fano(values, others):
    v = np.array(sorted(values), np.int64)
    meta, arrays = trie.EliasFano.arrays(v)
    e = trie.EliasFano(meta["n"], meta["low_bits"], *arrays)
    if len(v):
        assert (e.get(np.arange(len(v))) == v).all()
    ask = np.array([*v.tolist(), *others], np.int64)
    at = {x: i for i, x in enumerate(v.tolist())}
    assert e.find(ask).tolist() == [at.get(x, -1) for x in ask.tolist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=3, max_size=12), min_size=1, max_size=8))
def test_fm_index_windows(segments):
    text, starts, ends = [], [], []
    for s in segments:
        text.append(0)
        starts.append(len(text))
        text += s
        ends.append(len(text))
    position = np.arange(len(text)) * 2
    got = fmindex.window_firsts(np.array(text), np.array(starts), np.array(ends), position, 3)
    for a, z in zip(starts, ends):
        for k in range(a, z - 2):
            same = [j for b, y in zip(starts, ends) for j in range(b, y - 2) if text[j : j + 3] == text[k : k + 3]]
            assert got[k] == 2 * min(same)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=200), st.integers(0, 9))
def test_wavelet_matrix(values, symbol):
    w = fmindex.WaveletMatrix(np.array(values, np.int64))
    at = np.arange(len(values) + 1)
    if symbol < 1 << w.levels:
        assert w.rank(np.full(len(at), symbol), at).tolist() == [values[:k].count(symbol) for k in at.tolist()]


def lm_scores(data, order, keep):
    """(doc_id, known, base, score) of each row by counting n-grams as tuples."""
    words = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in data]
    grams = [None, *(Counter() for _ in range(order))]
    for i, w in words:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            for n in range(1, order + 1):
                said = [b"^"] * (n - 1) + w
                grams[n].update(tuple(said[k : k + n]) for k in range(len(w)))
    total, distinct = sum(grams[1].values()), len(grams[1])
    contexts = [None, None, *(Counter() for _ in range(order - 1))]
    stay = [None, None, *({} for _ in range(order - 1))]
    for n in range(2, order + 1):
        for g, c in grams[n].items():
            contexts[n][g[:-1]] += c
        for g, c in grams[n].items():
            if c >= keep[n - 1]:
                stay[n][g[:-1]] = stay[n].get(g[:-1], 0) + (c - 0.75) / contexts[n][g[:-1]]
    root = lambda w: (grams[1][w,] + 0.5) / (total + 0.5 * (distinct + 1))

    def p(g):
        if len(g) == 1:
            return root(g[0])
        low, c, h = p(g[1:]), grams[len(g)][g], contexts[len(g)][g[:-1]]
        return (c - 0.75) / h * (c >= keep[len(g) - 1]) + (1 - stay[len(g)].get(g[:-1], 0)) * low if h else low

    out = []
    for i, w in words:
        said = [b"^"] * (order - 1) + w
        out.append((i, len(w), sum(grams[1][x,] > 0 for x in w), total, sum(math.log10(root(x)) for x in w), sum(math.log10(p(tuple(said[k : k + order]))) for k in range(len(w)))))
    return out


@pytest.mark.parametrize("order,keep,size,hot", [(3, (1, 1, 2), 1 << 30, 50_000), (3, (1, 1, 2), 900, 20), (4, (1, 1, 1, 2), 2000, 3), (2, (1, 1), 700, 50_000)])
def test_lm_scores(spark, order, keep, size, hot):
    data = rows() + [(400 + i, t) for i, t in rows(5) if i is not None]
    got = lm.scored(frame(spark, data), order, keep, size, size, size, hot).collect()
    want = lm_scores(data, order, keep)
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 3))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    assert len(got) == len(data)
    for a, b in zip(got, sorted(want, key=key)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
        assert abs(a[5] - b[5]) <= 0.0013 * order * a[1]  # half a step of the codes for each order


def test_lm_query_rows(spark):
    assert lm.scored(frame(spark, [])).count() == 0
    only_held = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.score == 0 and r.held_out for r in lm.scored(frame(spark, only_held)).collect())
    long = [(2, "a b c d " * 200_000), (3, None), (4, "a b")]
    assert [r.n_tokens for r in lm.scored(frame(spark, long), block_bytes=1000).orderBy("doc_id").collect()] == [800_001, 1, 3]


def test_levels_hold_more_contexts_than_a_half_million(tmp_path):
    n = (1 << 19) + 1
    context, word = np.arange(n) * 977 + 5, np.arange(n) % 7 + (1 << 40)
    width = int(word.max()) + 1
    path = trie.write_level(str(tmp_path), "x", {"contexts": context, "successors": np.arange(n) * width + word}, {})
    level = trie.read_level(path)[0]
    assert (level["contexts"].find(context) == np.arange(n)).all()
    at = np.arange(0, n, 1000)
    assert (level["successors"].find(at * width + word[at]) == at).all() and (level["successors"].find(at * width + 3) == -1).all()
    with pytest.raises(OverflowError):
        trie.EliasFano.arrays(np.array([1, (1 << 63) + 4], np.uint64))


def test_lm_token_blocks():
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    texts = [t for _, t in rows()]
    words, number, lengths = lm.token_block(pa.array(texts))
    want = [[*(max(xxh64_intdigest(w) >> 1, 1) for w in (t or "").encode().lower().split()), 0] for t in texts]
    assert lengths.tolist() == list(map(len, want)) and words[number].tolist() == [x for w in want for x in w] and (np.diff(words) > 0).all()


def test_warc_round_trip(spark):
    big, other = "<p>é</p>" * 200, "<p>x</p>" * 5000
    pages = [(1, "http://a/1", big), (2, None, big), (7, "http://a/\n é", big), (3, "u", None), (4, "u", ""), (5, "u", "tiny"), (6, "u", "tiny"), (8, "u", other), (8, "u", other), (None, "u", other), (None, "v", "WARC/1.1\r\n\r\n" * 200)]
    df = spark.createDataFrame([(*p, "refers_to") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted((tuple(r)[:5] for r in warc.round_trip(spark, df, split_bytes=500).collect()), key=str)
    import hashlib

    top = {}
    for i, _, h in pages:
        top.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        ids = [x for x in top[h or ""] if x is not None]
        first = max(ids) if ids and len(raw) >= 1000 and len(top[h or ""]) > 1 else None
        visit = first is not None and (i is None or i < first)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if visit else "response", first if visit else None))
    assert got == sorted(want, key=str)
    assert all(r.digest_ok is not False for r in warc.round_trip(spark, df).collect())
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_reader_steps_over_damage(tmp_path):
    import pyarrow.fs as pafs

    member = lambda i: zlib.compress(warc.record(i, "u", b"x" * 50, "d", 50, None), wbits=31)
    blob = member(1) + b"\x1f\x8b\x08 junk \x1f\x8b" + member(2) + member(3)[:-9] + member(4)
    (tmp_path / "f").write_bytes(blob)
    for step in (7, 64, len(blob)):
        seen = []
        for a in range(0, len(blob), step):
            with pafs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as f:
                seen += [r[1]["warc-record-id"] for r in warc.records_in(f, a, min(a + step, len(blob)))]
        assert seen == ["<urn:page:1>", "<urn:page:2>", "<urn:page:4>"]


def test_warc_on_a_store_that_is_no_local_path(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.fs as pafs

    def stand_in(path):
        scheme, _, rest = path.partition("://")
        assert scheme == "store", path
        return pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem()), rest

    monkeypatch.setattr(warc, "filesystem", stand_in)
    texts = [b"a" * 10, b"long " * 700_000, b"z"]
    import hashlib

    rows_ = pa.RecordBatch.from_pylist([{"page_id": i, "url": "u", "payload": t, "digest": hashlib.sha1(t).hexdigest(), "n_bytes": len(t), "refers_to": None} for i, t in enumerate(texts)])
    (manifest,) = warc.written_files(iter([rows_]), "store://bucket/warc", 1)
    paths = manifest.column(0).to_pylist()
    assert len(paths) == 3 and all(p.startswith("store://bucket/warc/") for p in paths)
    ranges = pa.RecordBatch.from_pylist([{"path": p, "start": 0, "end": n} for p, n in zip(paths, manifest.column(1).to_pylist())])
    got = [r for b in warc.records(iter([ranges])) for r in b.to_pylist()]
    assert [(r["payload_bytes"], r["digest_ok"]) for r in got] == [(len(t), True) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_packing_plan(histogram):
    bins = packing.plan(histogram, 64)
    used = Counter()
    for times, combo in bins:
        assert sum(k * n for k, n in combo) <= 64
        for k, n in combo:
            used[k] += times * n
    assert used == Counter(histogram)
    # no packing can do with fewer than the sum asks for, nor put two of more than half into one
    n, low = sum(t for t, _ in bins), max(-(-sum(k * v for k, v in histogram.items()) // 64), sum(v for k, v in histogram.items() if k > 32))
    assert n <= low * 1.5 + 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(1, 40))
def test_fullest_is_fullest(counts, room):
    combo = packing.fullest(counts, room)
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
    assert sum(k * n for k, n in combo) == max(sums) and all(n <= counts[k] for k, n in combo)


def test_packing_pieces(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    data = rows() + [(900, "word " * 9000), (901, "<|endoftext|>  \n\n x"), (902, "a  <|endoftext|> b<|endoftext|>"), (903, "a \U0001f600 \u0301x  y's 12 3.4,\u3000z \x85 q \u00a0r"), (904, " lead \n end ")]
    got = packing.packed(frame(spark, data), with_ids=True).collect()
    want = Counter()
    for i, t in data:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        first, at, piece = len(ids) % 2048 or 2048, 0, 0
        while at < len(ids):
            size = first if at == 0 else 2048
            part = ids[at : at + size]
            want[i, piece, at, size, zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
            at, piece = at + size, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    places: dict = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) == -(-sum(r.length for r in got) // 2048)
    assert packing.packed(frame(spark, [])).count() == 0


def toxic_data(pair=False):
    r, words = np.random.default_rng(5), vocabulary(300)
    slurs = ["vilewort", "scumble", "grubbish"]
    data, labels = [], []
    for i in range(900):
        w = [words[k] for k in r.integers(0, len(words), 120)]
        bad = i % 6 == 0
        if bad:
            for k in r.integers(0, 119, 3):
                w[k : k + 2] = [slurs[k % 3].upper(), "indeed"] if k % 2 else [slurs[k % 3], w[k + 1]]
            if pair:  # of usual words
                w[3:5] = words[5:7]
        data.append((i, " ".join(w)))
        labels.append((i, 1 if bad else 0, i % 2))
    return data, labels


@settings(max_examples=150, deadline=None)
@given(st.text("ab1.,'s \n\t\u3000\u00a0\u0301é\U0001f600<|", max_size=60))
def test_chunks_tokenise_as_whole_texts(text):
    model = packing.chunk_tokenizer(packing.tokenizer_path())
    assert model.ids(text).tolist() == model.model.encode(text, add_special_tokens=False).ids


def test_toxicity_held_out(spark):
    data, labels = toxic_data()
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 0), (3, None, 0), (7, 2, 0)], "doc_id long, toxic int, quality int")
    more = [(10_000, None), (10_001, ""), (None, data[0][1]), (None, None), data[1], data[1], (10_002, "vilewort " * 30_000), (10_003, " 12 ... ")]
    docs = frame(spark, [*data, *more])
    rows_ = toxicity.scored(docs, lab).collect()
    assert len(rows_) == len(data) + len(more)
    got = {x.doc_id: x for x in rows_}
    assert all(got[i].predicted == t for i, t, _ in labels if got[i].held_out)
    assert all(got[i].held_out == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0) for i in got)
    assert got[10_000].predicted == got[10_001].predicted == 0 and got[10_000].score == got[10_001].score == got[10_003].score
    assert got[10_002].predicted == 1 and len({x.score for x in rows_ if x.doc_id == 1}) == 1
    assert {x.score for x in rows_ if x.doc_id is None} == {got[0].score, got[10_000].score}
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows_)
    # as many labels of either class as there are
    even = lab.where("toxic = 1 or doc_id % 6 = 1")
    assert all(x.predicted == dict((i, t) for i, t, _ in labels)[x.doc_id] for x in toxicity.scored(docs, even).collect() if x.doc_id is not None and x.doc_id < 900 and x.held_out)
    flipped = lab.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["when"]).expr("case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end"))
    assert {x.doc_id: x.score for x in toxicity.scored(docs, flipped).collect()} == {i: x.score for i, x in got.items()}
    assert {x.score for x in toxicity.scored(docs, lab.limit(0)).collect()} == {0.0} == {x.score for x in toxicity.scored(docs, lab.where("toxic = 0")).collect()}
    assert toxicity.scored(frame(spark, []), lab).count() == 0


def test_toxicity_models_against_brute_force(spark):
    import re

    data, labels = toxic_data(pair=True)
    kind = {i: t for i, t, _ in labels}
    texts = [(t.lower() + " x9y " * (i % 3), kind[i]) for i, t in data if i % 4 in (0, 2, 3)]
    model = toxicity.Model(*toxicity.expressions(toxicity.bigrams(spark.createDataFrame([*texts, texts[0], (None, 1), ("", 0)], "text string, toxic int"))))
    split = lambda t: re.findall(r"[^\W\d_]+", t)
    c = [Counter(), Counter()]
    for t, k in set(texts):
        w = split(t)
        c[k].update(set(zip(["^", *w], w)))
    both = c[0] + c[1]
    n = Counter(w for _, w in both)
    ones, twos = (sum(x == k for x in n.values()) for k in (1, 2))
    d, whole, size = (ones / (ones + 2 * twos) if ones else 0.0), sum(n.values()), len(n)
    shared = lambda w: max(n[w] - d, 0) / whole + d * size / whole / (size + 1)
    keep = lambda x, e, o, d=3: max(0.0, x - max(e + d * math.sqrt(e + 1), 4 * o))
    share = [sum(x.values()) / sum(both.values()) for x in c]
    seen, other = [Counter(), Counter()], [Counter(), Counter()]
    for p, x in both.items():
        for k in (0, 1):
            seen[k][p[1]] += 1 - (1 - share[k]) ** x
            other[k][p[1]] += 1 - math.exp(-c[1 - k][p] * share[k] / share[1 - k])
    nk = [Counter(w for _, w in x) for x in c]
    own = [{w: keep(nk[k][w], seen[k][w], other[k][w]) for w in n} for k in (0, 1)]
    uni = lambda k, w: own[k].get(w, 0) / sum(nk[k].values()) + (1 - sum(own[k].values()) / sum(nk[k].values())) * shared(w)
    ctx, total = [Counter(), Counter()], Counter()
    for k in (0, 1):
        for (h, _), x in c[k].items():
            ctx[k][h] += x
            total[h] += x

    def p(k, h, w):
        if not ctx[k][h]:
            return uni(k, w)
        e = {x: keep(c[k][h, x], ctx[k][h] * both[h, x] / total[h], ctx[k][h] * c[1 - k][h, x] / ctx[1 - k][h] if ctx[1 - k][h] else 0, 6) for x in n if c[k][h, x]}
        return e.get(w, 0) / ctx[k][h] + (1 - sum(e.values()) / ctx[k][h]) * uni(k, w)

    assert any(own[1].values()) and model.pair
    for k in (0, 1):
        assert sum(shared(w) for w in [*n, "unknown"]) == pytest.approx(1) == pytest.approx(sum(uni(k, w) for w in [*n, "unknown"]))
        for h in ("^", "vilewort", "no such"):
            assert sum(p(k, h, w) for w in [*n, "unknown"]) == pytest.approx(1)
    neutral = math.log((1 - sum(own[1].values()) / sum(nk[1].values())) / (1 - sum(own[0].values()) / sum(nk[0].values())))
    for i, t in [*data[:40], (0, "vilewort indeed never vilewort")]:
        w = split(t.lower())
        want = sum(math.log(p(1, h, x) / p(0, h, x)) for h, x in zip(["^", *w], w)) / len(w) - neutral
        assert model.ratio(t) == pytest.approx(want, abs=1e-9)
