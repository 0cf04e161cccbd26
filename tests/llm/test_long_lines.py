"""Single long lines in the line_dedup stage, against brute force."""

import re

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.cases import frame, rows
from tickloom.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def said(n, tag):
    return " ".join(f"{tag}{k}" for k in range(n))


def planted():
    line, short = said(50, "a"), said(49, "b")
    return [(2000, f"one\n{line}\ntwo"), (2001, f"three\n\n{short}\nfour"), (2002, f"  \nfive\n{line}\nsix\n{line}"), (2003, f"seven\n{short}\neight"), (2004, line), (2005, said(60, "c"))]


def left(data):
    """Kept texts by the rule on both kinds of runs."""
    docs = [(i, (t or "").split("\n")) for i, t in data]
    solid = [[k for k, x in enumerate(ls) if WORD.search(x)] for _, ls in docs]

    def windows(ls, s):
        yield from ((a, tuple(ls[k] for k in s[a : a + 2])) for a in range(len(s) - 1))
        yield from ((a, (ls[k],)) for a, k in enumerate(s) if len(WORD.findall(ls[k])) >= 50)

    first = {}
    for (i, ls), s in zip(docs, solid):
        for a, key in windows(ls, s):
            at = ((i is not None, i or 0), a)
            first[key] = min(first.get(key, at), at)
    out = []
    for (i, ls), s in zip(docs, solid):
        gone = {s[a + k] for a, key in windows(ls, s) if first[key] < ((i is not None, i or 0), a) for k in range(len(key))}
        out.append((i, "\n".join(x for k, x in enumerate(ls) if k not in gone)))
    return sorted(out, key=str)


def test_stage_drops_long_lines(spark):
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, frame(spark, planted()), SF_SMALL).collect()}
    assert got[2000] == planted()[0][1] and got[2002] == "  \nfive\nsix" and got[2004] == ""
    assert got[2001] == planted()[1][1] and got[2003] == planted()[3][1]


def test_against_brute_force(spark):
    data = rows() + planted()
    assert sorted(((r.doc_id, r.text or "") for r in linededup.deduplicated(frame(spark, data)).collect()), key=str) == left(data)
