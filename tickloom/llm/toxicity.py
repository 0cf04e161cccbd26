"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, of toxic and of ordinary text, are compared by their
length-normalised log-likelihoods of a text.  For class k, a word w after a word h:

    P_k(w | h) = e_k(h w) / c_k(h) + (1 - e_k(h) / c_k(h)) P_k(w)
    P_k(w)     = e_k(w) / N_k + (1 - e_k / N_k) P(w)
    P(w)       = max(n(w) - D, 0) / N + D V / N / (V + 1)

n(w) is Kneser-Ney's continuation count, the number of different words that w follows
in either class, n_k(w) the same in one class, N and N_k their sums and V the number of
words.  c_k(h w) is the number of texts of the class with the bigram, c_k(h) its sum
over w.  What a class keeps as its own is its count less an absolute discount,

    e_k(x) = max(n_k(x) - D_k(x), 0),   D_k(x) = max(E + DEVIATIONS sqrt(E + 1), SHARE O),

where E is the count that the backoff shared by the classes leads one to expect, and O
the one that the other class alone does: of a bigram c_k(h) c(h w) / c(h), of a word the
number of its contexts that a class with its share s_k of all bigrams would meet, the
sums of 1 - (1 - s_k) ** c(h w) and of 1 - exp(-c_j(h w) s_k / s_j) over h.  All the rest
is the shared model's, so rare expressions and those as usual in either class get the
same probability from both up to a constant factor, and the models differ in what one
class says far more often.  Each level sums to 1 over all words and one unknown.

A score is the ratio through a logistic curve whose middle is calibrated on the labels.
Labels are read only for documents whose crc32(doc_id) mod 5 is not 0.  Of these, at
most ``FIT_ROWS`` of each class are used, those with the smallest crc32 of the id, so
the model has bounded size, whatever the input.  Counting is done in the JVM; what is
collected are the expressions with an e_k above zero.

Nulls and edges: a null or empty text has no words and the ratio of a word that says
nothing.  A null doc_id counts as the empty id text.  Labels that are null or neither 0
nor 1, or without a document, are passed over; of contradicting labels of one document
the larger counts; without usable labels of both classes every score is 0.  Equal texts
of a class are counted once in training; repeated rows get equal scores, ties at the
middle are predicted toxic, and an empty table gives no rows.  Texts of any length are
scored whole, one at a time.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.cluster import written
from tickloom.llm.common import bucket5, id_text, least_by_crc, map_arrow

#: Bound on the labelled rows of each class that the models are fitted on.
FIT_ROWS = 4000
CLASSES = ("ordinary", "toxic")
SHARE = 4.0
#: For words and for bigrams, of which there are far more that differ by chance.
DEVIATIONS = (3.0, 6.0)
START = "\n"
WORD = r"\p{L}+"
#: Logistic units between a word that says nothing and the calibrated middle.
STEEP = 4.0


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of the bounded sample of labelled documents outside the held-out fold."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (bucket5() != 0))
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = written(least_by_crc(lab.where("toxic = 1"), fit_rows).unionByName(least_by_crc(lab.where("toxic = 0"), fit_rows)), "toxicity-sample")
    return id_text(docs).join(F.broadcast(some), "doc_id")  # at most 2 * fit_rows rows


def bigrams(rows: DataFrame) -> DataFrame:
    """(h, w, ordinary, toxic): the number of different texts of each class with the bigram."""
    texts = rows.select("toxic", F.lower(F.coalesce("text", F.lit(""))).alias("text")).distinct()
    found = texts.select("toxic", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("found")).where(F.size("found") > 0)
    before = F.concat(F.array(F.lit(START)), F.slice("found", 1, F.size("found") - 1))
    each = found.select("toxic", F.explode(F.array_distinct(F.zip_with(before, "found", lambda h, w: F.concat(h, F.lit(" "), w)))).alias("pair"))
    counted = each.groupBy("pair").agg(*(F.count_if(F.col("toxic") == k).alias(c) for k, c in enumerate(CLASSES)))
    return counted.select(F.substring_index("pair", " ", 1).alias("h"), F.substring_index("pair", " ", -1).alias("w"), *CLASSES)


def excess(count: Column, expected: Column, other: Column, deviations: float) -> Column:
    """What a class keeps of a count as its own: the part beyond the discount."""
    return F.greatest(F.lit(0.0), count - F.greatest(expected + deviations * F.sqrt(expected + 1), SHARE * other))


def expressions(pairs: DataFrame) -> tuple[dict, list[tuple], list[tuple]]:
    """Totals, the words and the pairs of which a class keeps something, from :func:`bigrams`; bounded like the sample."""
    pairs = written(pairs, "toxicity-bigrams")
    size = pairs.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES)).first()
    whole = max(1, size[0] + size[1])
    sums = []
    for k, c in enumerate(CLASSES):
        met = 1 - F.pow(F.lit(1 - size[k] / whole), F.col("ordinary") + F.col("toxic"))
        by_other = 1 - F.exp(-F.col(CLASSES[1 - k]) * (size[k] / max(1, size[1 - k])))
        sums += [F.count_if(F.col(c) > 0).alias(f"n{k}"), F.sum(met).alias(f"x{k}"), F.sum(by_other).alias(f"o{k}")]
    counts = pairs.groupBy("w").agg(F.count("*").alias("n"), *sums)
    words = written(counts.select("w", "n", "n0", "n1", *(excess(F.col(f"n{k}"), F.col(f"x{k}"), F.col(f"o{k}"), DEVIATIONS[0]).alias(f"e{k}") for k in (0, 1))), "toxicity-words")
    t = words.agg(F.sum("n0"), F.sum("n1"), F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    if not t[3]:
        return {}, [], []
    totals = {"ordinary": t[0], "toxic": t[1], "contexts": t[2], "words": t[3], "discount": t[4] / (t[4] + 2 * t[5]) if t[4] else 0.0}
    contexts = written(pairs.groupBy("h").agg(*(F.sum(c).alias(f"c{k}") for k, c in enumerate(CLASSES))), "toxicity-contexts")
    often = pairs.where(F.greatest(*CLASSES) > DEVIATIONS[1]).join(contexts, "h")  # no other has an excess
    share = (F.col("ordinary") + F.col("toxic")) / (F.col("c0") + F.col("c1"))
    other = [F.coalesce(F.try_divide(F.col(CLASSES[1 - k]) * F.col(f"c{k}"), F.col(f"c{1 - k}")), F.lit(0.0)) for k in (0, 1)]
    own = often.select("h", "w", *(excess(F.col(c), F.col(f"c{k}") * share, other[k], DEVIATIONS[1]).alias(f"e{k}") for k, c in enumerate(CLASSES)), "c0", "c1").where("e0 > 0 or e1 > 0")
    found = own.join(words.select("w", "n"), "w").select("h", "w", "n", "e0", "e1", "c0", "c1")
    return totals, [tuple(r) for r in words.where("e0 > 0 or e1 > 0").select("w", "n", "e0", "e1").collect()], [tuple(r) for r in found.collect()]


class Model:
    """Log ratios of toxic over ordinary probabilities, and the calibrated middle."""

    def __init__(self, totals: dict, words: list[tuple], pairs: list[tuple]):
        """``words``: (w, n, e_ordinary, e_toxic); ``pairs``: (h, w, n, e_ordinary, e_toxic, c_ordinary, c_toxic)."""
        self.middle, self.usable = math.inf, bool(totals) and min(totals["ordinary"], totals["toxic"]) > 0
        if not self.usable:
            return
        size = [totals[c] for c in CLASSES]
        self.totals = totals
        #: the shared model's weight in each class
        self.rest = [1 - math.fsum(x[2 + k] for x in words) / size[k] for k in (0, 1)]
        #: log ratio of a word that says nothing
        self.neutral = math.log(self.rest[1] / self.rest[0])
        #: P_k(w) of the words for which it does not cancel out
        self.word = {w: [self.rest[k] * self.shared(n) for k in (0, 1)] for _, w, n, *_ in pairs}
        self.word |= {w: [e[k] / size[k] + self.rest[k] * self.shared(n) for k in (0, 1)] for w, n, *e in words}
        self.pair = {(h, w): [e / c if c else 0.0 for e, c in ((e0, c0), (e1, c1))] for h, w, _, e0, e1, c0, c1 in pairs}
        #: what a context leaves to the backoff
        self.left: dict[str, list[float]] = {}
        for (h, _), own in self.pair.items():
            left = self.left.setdefault(h, [1.0, 1.0])
            left[0], left[1] = left[0] - own[0], left[1] - own[1]

    def shared(self, n: int) -> float:
        """P(w) of a word with n contexts."""
        t = self.totals
        return max(n - t["discount"], 0) / t["contexts"] + t["discount"] * t["words"] / t["contexts"] / (t["words"] + 1)

    def token(self, h: str, w: str) -> float:
        """log P_toxic(w | h) / P_ordinary(w | h)."""
        p = self.word.get(w, self.rest)  # P(w) cancels out
        if (left := self.left.get(h)) is None:
            return math.log(p[1] / p[0])
        own = self.pair.get((h, w), (0.0, 0.0))
        return math.log((own[1] + left[1] * p[1]) / (own[0] + left[0] * p[0]))

    def ratio(self, text: str) -> float:
        """Log-likelihood ratio for each word, less that of a word that says nothing."""
        if not self.usable or not (found := _WORD.findall(text.lower())):
            return 0.0
        total, told, h = 0.0, 0, START
        for w in found:
            if w in self.word or h in self.left:
                total, told = total + self.token(h, w), told + 1
            h = w
        return (total - told * self.neutral) / len(found)

    def calibrate(self, ratios: np.ndarray, toxic: np.ndarray) -> None:
        """Put the middle into the gap that classifies most labelled rows rightly; the widest such gap if there are several."""
        x = np.unique(ratios)
        if not self.usable or len(x) < 2:
            return
        right = np.searchsorted(np.sort(ratios[~toxic]), x[:-1], "right") + toxic.sum() - np.searchsorted(np.sort(ratios[toxic]), x[:-1], "right")
        best = right >= right.max() - max(1, len(ratios) // 500)  # nearly as good
        gap = np.where(best & (x[1:] > 0), x[1:] - np.maximum(x[:-1], 0), -1)
        at = int(np.argmax(gap))
        if right.max() > (~toxic).sum() and gap[at] > 0:
            self.middle = float(max(x[at], 0) + 0.4 * gap[at])

    def score(self, text: str) -> float:
        if not math.isfinite(self.middle):
            return 0.0
        z = STEEP * (self.ratio(text) / self.middle - 1)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


_WORD = regex.compile(WORD)


def _each_text(column: pa.Array) -> Iterator[str]:
    """Texts one at a time, null as empty, so that a batch is never held twice."""
    return (x.as_py() or "" for x in column)


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    rows = written(training_rows(docs, labels, fit_rows).select("text", "toxic"), "toxicity-rows")
    model = Model(*expressions(bigrams(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.ratio(t) for t in _each_text(b.column(0))], pa.float64()), b.column(1)], names=["ratio", "toxic"])

    seen = map_arrow(rows, run, "ratio double, toxic int").toPandas()  # bounded like the sample
    model.calibrate(seen["ratio"].to_numpy(float), seen["toxic"].to_numpy() == 1)
    return model


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = fitted(docs, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.fromiter((model.score(t) for t in _each_text(b.column(1))), float, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(id_text(docs).withColumn("held_out", bucket5() == 0), run, "doc_id long, held_out boolean, score double, predicted int")
