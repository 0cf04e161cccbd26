"""The two stages that drop repeats, in sequence, against plain Python with planted cases."""

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.cases import frame, rows
from tests.llm.test_long_lines import left, planted
from tests.llm.test_nearcopies import kept, near_copies, staying
from tickloom.cluster import written


def test_line_and_near_dedup_in_sequence(spark):
    data = rows() + planted() + near_copies(1000)
    lines = written(corpus_pipeline.line_dedup(spark, frame(spark, data), SF_SMALL), "chain")
    assert kept(corpus_pipeline.near_dedup(spark, lines, SF_SMALL)) == staying(left(data))
