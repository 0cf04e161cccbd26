"""The quality model comes from every labelled row, held against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import quality

N = 24_000


def labelled_stats(spark):
    i = F.col("id")
    hash_ = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    bad = i % 40 == 3
    words = 100 + hash_(1, 400)
    rows = spark.range(N).select(
        i.alias("doc_id"), words.alias("n_words"), (words * 5).alias("word_chars"), F.when(bad, F.floor(words / 2) + hash_(2, 30)).otherwise(hash_(2, 20)).alias("n_symbols"),
        F.when(bad & (hash_(3, 3) == 0), F.lit(9).cast("long")).otherwise(hash_(3, 2)).alias("n_dup_lines"), hash_(4, 9).alias("n_repeat_words"), F.lit(12).cast("long").alias("n_lines"), (words * 5 - hash_(5, 40)).alias("n_letters"), F.when(bad, 0).otherwise(1).alias("quality"),
    )
    return rows.drop("quality"), rows.select("doc_id", "quality")


def test_every_labelled_row_counts(spark):
    stat, labels = labelled_stats(spark)
    forest, top, threshold = quality.fitted(stat, labels)
    rows = stat.join(labels, "doc_id").withColumn("grows", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).toPandas()
    x, good, grows = rows[quality.BASE + quality.MORE].to_numpy(), rows["quality"].to_numpy() == 1, rows["grows"].to_numpy()
    s = quality.statistics(x)
    high, mid = (np.quantile(s[grows & good], q, axis=0) for q in (0.999, 0.5))
    assert top == pytest.approx(high + (high - mid) / 2)
    # the best threshold on all rows of the other half, by trying each score
    score, right = forest.score(quality.features(x[~grows], top)), good[~grows]
    best = max((((score >= t) & ~right).sum() / (~right).sum() - ((score >= t) & right).sum() / right.sum(), t) for t in np.unique(score) if ((score >= t) & right).sum() <= quality.FALSE_REJECTS * right.sum())
    assert ((score >= threshold) == (score >= best[1])).all()


def test_order_statistics(spark):
    values = np.random.default_rng(4).choice([0.0, 0.25, 1e-9, 3.5, *np.random.default_rng(5).random(40)], (4, 301))
    rows = spark.createDataFrame([tuple(int(b) for b in v.view(np.int64)) for v in np.ascontiguousarray(values.T)], ", ".join(f"{c} long" for c in quality.RULES))
    got = quality.order_statistics(rows, [0, 1, 150, 299, 300])
    assert got == {(c, r): np.sort(v)[r] for c, v in zip(quality.RULES, values) for r in (0, 1, 150, 299, 300)}


def test_trees_draw_from_all_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("draw"), *(F.col("id").alias(c) for c in quality.RULES))
    got = [x.view(np.int64)[:, 0] for x in quality.drawn(rows, 3000)]
    assert {len(set(x.tolist())) for x in got} == {quality.SAMPLE} and len({tuple(x.tolist()) for x in got}) == quality.TREES
    assert len(set(np.concatenate(got).tolist())) == 3000
