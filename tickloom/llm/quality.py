"""Quality rules judged by an isolation forest.

Two hard rules reject a document outright (``base_failed``): fewer than 50 words,
or more than half of its words inside repeated three-word windows.  The rest is
judged by an isolation forest over rule statistics: random splits isolate unusual
documents early, so a short mean path length means an anomaly.  The forest is
grown on one half of the labelled rows, of which few are bad, and the threshold on
the path length is calibrated on the labels of the other half.

Fitting uses every labelled row that passes the base rules, however many there are.
The usual tops are exact quantiles over all good rows of the first half, found by radix
selection; each tree draws its own ``SAMPLE`` rows from the whole half, which is how an
isolation forest is defined; the threshold is set on counts of all rows of the second
half by score, in cells of 2 ** -20.  Only these counts and draws, whose sizes do not
depend on the input, reach the driver.  Statistics and verdicts cover every whole text.

Nulls and edges: a null text has no words; such documents, like all short ones,
fail the base rules.  A null doc_id is kept as null and is never labelled.  Without
usable labels of both classes every document that passes the base rules is kept.
Repeated rows and ties are judged alike, very long texts are read whole, an empty table
gives an empty result, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.cluster import written
from tickloom.llm.common import id_text, map_arrow

MIN_WORDS = 50
REPEAT_PERCENT = 50
TREES, SAMPLE = 100, 512
#: Cells of a score between 0 and 1 in which rows are counted; the threshold is the edge of one.
CELLS = 1 << 20
#: Bits that are settled in a pass over the rows when an order statistic is sought.
RADIX = 11
#: Largest share of good labelled rows that calibration may reject.
FALSE_REJECTS = 0.002
SEED = 7

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(192, 256))
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_letters"]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE + MORE)
RULES = ["symbols", "dups", "repeats", "others"]


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words covered by three-word windows that occur at least twice."""
    n = len(ids)
    if n < 4 or distinct == n:
        return 0
    key = ids[:-1] * distinct + ids[1:]
    if distinct < 2_000_000:
        key = key[:-1] * distinct + ids[2:]
    else:  # the product would not fit 63 bits
        pairs, pair = np.unique(key, return_inverse=True)
        key = pair[:-1] * np.int64(distinct) + ids[2:]
    order = np.argsort(key, kind="stable")
    run = key[order]
    same = np.zeros(len(run) + 1, bool)
    same[1:-1] = run[1:] == run[:-1]
    twice = order[same[:-1] | same[1:]]
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[twice + shift] = True
    return int(covered.sum())


def text_stats(raw: bytes, chars: int) -> tuple[int, ...]:
    """BASE and MORE of one text; ``chars`` is its length in code points."""
    words = raw.split()
    at: dict[bytes, int] = {}
    ids = [at.setdefault(w, len(at)) for w in words]
    spaces = len(raw) - len(raw.translate(None, SPACE))
    # a letter outside ASCII takes several bytes, of which only the first is counted
    letters = len(raw) - len(raw.translate(None, LETTERS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        chars - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(np.array(ids, np.int64), len(at)) if len(at) < len(words) else 0,
        len(lines),
        letters,
    )


def stats(docs: DataFrame) -> DataFrame:
    """Rule statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_stats(x.encode(), len(x)) if x else (0,) * len(BASE + MORE) for x in b.column(1).to_pylist()]
            cols = np.array(rows, np.int64).reshape(-1, len(BASE + MORE)).T
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in cols)], names=["doc_id", *BASE, *MORE])

    return map_arrow(id_text(docs), run, STATS_SCHEMA)


def statistics(x: np.ndarray) -> np.ndarray:
    """Scale-free RULES from rows of BASE + MORE, none below 0; larger means worse."""
    words, chars, symbols, dups, repeats, lines, letters = (x[:, (BASE + MORE).index(c)].astype(float) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters"))
    w = np.maximum(words, 1)
    return np.stack([np.log1p(symbols / w), dups / np.maximum(lines, 1), repeats / w, 1 - letters / np.maximum(chars, 1)], 1)


def order_statistics(rows: DataFrame, ranks: list[int]) -> dict[tuple[str, int], float]:
    """The values at the given ranks, from 0, in each column of RULES, which holds bits of doubles that are not negative.

    Such bits rise with the value.  Each pass counts, below the leading bits known so far,
    by the next ``RADIX`` bits: exact, and at most 2 ** RADIX counts for each value sought.
    """
    found = {(c, r): (0, r) for c in RULES for r in ranks}  # leading bits, rank among the rows that have them
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("bits")) for c in RULES))).alias("x")).select("x.*")
    for shift in range(64 - 64 % -RADIX - RADIX, -1, -RADIX):
        known = lambda: F.shiftrightunsigned("bits", shift + RADIX) if shift + RADIX < 64 else F.lit(0).cast("long")  # noqa: B023, E731
        wanted = {c: sorted({found[c, r][0] for r in ranks}) for c in RULES}
        under = [(F.col("rule") == c) & known().isin(w) for c, w in wanted.items()]
        counts: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for x in each.where(under[0] | under[1] | under[2] | under[3]).groupBy("rule", F.shiftrightunsigned("bits", shift).alias("lead")).agg(F.count("*").alias("n")).collect():
            counts.setdefault((x["rule"], x["lead"] >> RADIX), []).append((x["lead"], x["n"]))
        for (c, r), (lead, rank) in found.items():
            for new, n in sorted(counts[c, lead]):
                if rank < n:
                    found[c, r] = new, rank
                    break
                rank -= n
    return {k: float(np.array([bits], np.int64).view(np.float64)[0]) for k, (bits, _) in found.items()}


def usual_top(rows: DataFrame, n: int) -> np.ndarray:
    """What the n good documents rarely exceed, with half of their spread above the median added."""
    at = {q: q * (n - 1) for q in (0.5, 0.999)}
    value = order_statistics(rows, sorted({min(int(x) + k, n - 1) for x in at.values() for k in (0, 1)}))

    def quantile(c: str, q: float) -> float:
        low = int(at[q])
        a, b = value[c, low], value[c, min(low + 1, n - 1)]
        return a + (at[q] - low) * (b - a)

    mid, high = (np.array([quantile(c, q) for c in RULES]) for q in (0.5, 0.999))
    return high + (high - mid) / 2


def excess(stat: np.ndarray, top: np.ndarray) -> np.ndarray:
    """By how much each rule statistic exceeds its usual top; most documents are zero throughout."""
    return np.maximum(0, stat - top)


def features(x: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The excess of rows of BASE + MORE."""
    return excess(statistics(x), top)


def _usual_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as flat arrays; a node is a leaf if its feature is negative."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]
    child: list[np.ndarray]
    rest: list[np.ndarray]  # depth so far plus the usual path below a leaf
    usual: float

    @staticmethod
    def grown(drawn: list[np.ndarray], seed: int = SEED) -> IsolationForest:
        """A tree for each array of rows."""
        rng = np.random.default_rng(seed)
        sample = max(map(len, drawn), default=0)
        deepest = int(np.ceil(np.log2(max(sample, 2)))) + 2
        forest = IsolationForest([], [], [], [], float(_usual_path(sample)) or 1.0)
        for x in drawn:
            feature, cut, child, rest = [], [], [], []
            stack = [(np.arange(len(x)), 0, -1)]
            while stack:
                rows, depth, parent = stack.pop()
                me = len(feature)
                if parent >= 0:
                    child[parent].append(me)
                feature.append(-1), cut.append(0.0), child.append([]), rest.append(depth + float(_usual_path(len(rows))))
                low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
                wide = np.flatnonzero(high > low)
                if depth >= deepest or len(rows) < 2 or not len(wide):
                    continue
                f = int(rng.choice(wide))
                at = float(rng.uniform(low[f], high[f]))
                feature[me], cut[me] = f, at
                left = x[rows, f] < at
                stack += [(rows[~left], depth + 1, me), (rows[left], depth + 1, me)]
            forest.feature.append(np.array(feature))
            forest.cut.append(np.array(cut))
            forest.child.append(np.array([c or [0, 0] for c in child]))
            forest.rest.append(np.array(rest))
        return forest

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): towards 1 for rows that are isolated early."""
        total = np.zeros(len(x))
        for feature, cut, child, rest in zip(self.feature, self.cut, self.child, self.rest, strict=True):
            node = np.zeros(len(x), np.int64)
            live = np.flatnonzero(feature[node] >= 0)
            while len(live):
                f = feature[node[live]]
                node[live] = child[node[live], (x[live, f] >= cut[node[live]]).astype(int)]
                live = live[feature[node[live]] >= 0]
            total += rest[node]
        return 2.0 ** -(total / len(self.feature) / self.usual) if self.feature else total


def calibrated(cell: np.ndarray, good: np.ndarray, bad: np.ndarray, false_rejects: float = FALSE_REJECTS) -> float:
    """The threshold with the best balanced accuracy among those that reject at most a share of good rows, from counts by cell."""
    order = np.argsort(-cell)
    cell, wrong, hits = cell[order], np.cumsum(good[order]), np.cumsum(bad[order])
    if not len(cell) or not wrong[-1] or not hits[-1]:
        return 2.0
    value = np.where(wrong <= false_rejects * wrong[-1], hits / hits[-1] - wrong / wrong[-1], -1)
    best = int(np.argmax(value))
    if value[best] <= 0:
        return 2.0
    # midway to the next score, so that rows close to rejected ones go with them only if nearer
    return int(cell[best] + cell[best + 1] + 1 if best + 1 < len(cell) else 2 * cell[best]) // 2 / CELLS


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


Model = tuple[IsolationForest, np.ndarray, float]


def labelled(stat: DataFrame, labels: DataFrame) -> DataFrame:
    """(grows, good, draw, bits of RULES) of every labelled document that passes the base rules; repeated rows count once."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    lab = lab.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = stat.where(~base_failed()).join(lab, "doc_id").select("doc_id", "quality", *BASE, *MORE).distinct()
    keyed = rows.select((F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("grows"), (F.col("quality") == 1).alias("good"), F.xxhash64("doc_id", *BASE, *MORE).alias("draw"), *BASE, *MORE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = statistics(np.stack([b.column(3 + k).to_numpy() for k in range(len(BASE + MORE))], 1))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), *(pa.array(c.copy().view(np.int64)) for c in s.T)], names=["grows", "good", "draw", *RULES])

    return map_arrow(keyed, run, "grows boolean, good boolean, draw long, " + ", ".join(f"{c} long" for c in RULES))


def drawn(rows: DataFrame, n: int, trees: int = TREES, sample: int = SAMPLE) -> list[np.ndarray]:
    """For each tree the statistics of ``sample`` of the n rows, those with the smallest hashes for the tree."""
    # a bound that is passed by some more than that; the chance that fewer pass is below 1e-10
    bound = min(1.0, (sample + 8 * sample**0.5 + 8) / max(1, n)) * float(1 << 62)
    place = lambda t: F.xxhash64("draw", t).bitwiseAND(F.lit((1 << 62) - 1))
    picked = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), place(t).alias("place"))), lambda x: x["place"] < F.lit(bound))
    got = rows.select(F.inline(picked), *RULES).toPandas().sort_values(["tree", "place", *RULES])
    tree, stat = got["tree"].to_numpy(), got[RULES].to_numpy(np.int64).copy().view(np.float64)
    return [stat[tree == t][:sample] for t in range(trees)]


def fitted(stat: DataFrame, labels: DataFrame) -> Model | None:
    """The forest, the usual tops and the threshold, from all labelled rows."""
    rows = written(labelled(stat, labels), "quality-labelled")
    n = {(r["grows"], r["good"]): r["n"] for r in rows.groupBy("grows", "good").agg(F.count("*").alias("n")).collect()}
    have = lambda grows, good: n.get((grows, good), 0)
    if not have(True, True) or not have(False, True) or have(True, True) + have(False, True) < 20 or have(True, False) + have(False, False) < 4:
        return None
    # Grown on one half of the rows and calibrated on the other, so that the threshold is not set on rows the trees know.
    top = usual_top(rows.where("grows and good"), have(True, True))
    forest = IsolationForest.grown([excess(x, top) for x in drawn(rows.where("grows"), have(True, True) + have(True, False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.stack([b.column(1 + k).to_numpy().view(np.float64) for k in range(len(RULES))], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.floor(forest.score(excess(s, top)) * CELLS).astype(np.int64))], names=["good", "cell"])

    scored = map_arrow(rows.where("not grows").select("good", *RULES), run, "good boolean, cell long")
    cells = scored.groupBy("cell").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas()
    return forest, top, calibrated(*(cells[c].to_numpy(np.int64) for c in ("cell", "good", "bad")))


def verdicts(x: np.ndarray, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept and the anomaly score of rows of BASE + MORE."""
    failed = (x[:, 0] < MIN_WORDS) | (100 * x[:, 4] > REPEAT_PERCENT * x[:, 0])
    score = model[0].score(features(x, model[1])) if model and len(x) else np.zeros(len(x))
    return failed, ~failed & (score < (model[2] if model else 2.0)), score


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, hard rules, anomaly score and verdict for every document."""
    stat = written(stats(docs), "quality-stats")
    model = fitted(stat, labels)
    names = ["doc_id", *BASE, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in BASE + MORE], 1)
            failed, kept, score = verdicts(x, model)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(6)), pa.array(failed), pa.array(kept), pa.array(score)],
                names=["doc_id", *BASE, "base_failed", "kept", "anomaly"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, anomaly double"
    return map_arrow(stat.select(*names), run, schema)


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    model = fitted(written(stats(docs), "quality-stats"), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_stats(t.encode(), len(t)) if t else (0,) * len(BASE + MORE) for t in b.column(at).to_pylist()], np.int64).reshape(-1, len(BASE + MORE))
            yield b.filter(pa.array(verdicts(x, model)[1]))

    return map_arrow(docs, run, docs.schema)
