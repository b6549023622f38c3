"""The last word of a text is found however much stands behind it."""

import pytest

from scoreloom.llm import pairs


@pytest.mark.parametrize("tail", [" " * 90, "\n" * 200, "”" * 85, " 😀" * 60, "_" * 100, "." * 90])
def test_long_tails(tail):
    assert pairs._last_words(["He went to The" + "." + tail]) == ["the"]


def test_others():
    assert pairs._last_words(["", "...", "One", "in 1999.", "x" * 100 + "."]) == ["", "", "one", "0000", "x" * 100]


def test_truncated_before_blanks(spark):
    rows = "row_id bigint, prompt string, text string, generator_model string"
    body = "We saw the mill and the road by the town. " * 300
    frame = spark.createDataFrame([(1, None, body, "g"), (2, None, "It rained and we saw the." + " " * 100, "g"), (3, None, "It rained and we saw the.", "g")], rows)
    assert {r.row_id: r.defect for r in pairs.judge(frame).collect()} == {1: None, 2: "truncated", 3: "truncated"}
