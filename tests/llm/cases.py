"""Awkward documents: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("th", T.StringType()), T.StructField("row", T.StringType()),
    T.StructField("fp", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T.StringType()), T.StructField("_id", T.LongType()), T.StructField("n_chars", T.LongType()),
])


def vocabulary(n: int = 60, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(n)]


def texts(seed: int = 3) -> list[str | None]:
    r, words = random.Random(seed), vocabulary()
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line = say(45), say(12)
    base = say(120)
    near = base.split()
    near[60] = "changed"
    return [
        None, "", "   \n\t ", "one", "Two Words", base, base, " ".join(near), say(30) + " " + passage + " " + say(30), passage, say(25) + "\n" + passage + "\n" + say(5),
        f"{line}\n{passage}\n{say(9)}", f"{say(4)}\n{line}\n{passage}\n\n{say(3)}", "loop " * 90, f"x {base} y", say(4000), f"{line}\n{line}\n{line}\n{line}", "a\x1cb c 　d\re\x0bf",
        base.upper(), "é \U0001f600 " * 30,
    ]


def rows(seed: int = 3):
    out = [(i * 3 + 1, t) for i, t in enumerate(texts(seed))]
    out += [(None, texts(seed)[5]), out[8], out[8]]  # a null id, a row three times
    return out


def frame(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(i, t, "th", "row", 7, "kept", 9, "spans", 5, len(t or "")) for i, t in data], SCHEMA).repartition(3)


def by_row(df, key="doc_id"):
    """Rows as sorted tuples, so that repeats count."""
    return sorted((tuple(r) for r in df.collect()), key=str)
