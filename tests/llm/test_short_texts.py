"""Texts cut to a few words are found where a longer answer to the same prompt carries them on."""

from scoreloom.llm import pairs


def test_cut_to_a_few_words(spark):
    rows = [
        (1, "Tell me of the mill.", "The old mill.", "g"), (2, "Tell me of the mill.", "The old mill was closed in May and sold.", "h"),
        (3, "Tell me of the road.", "The old mill.", "g"), (4, None, "The old mill.", "g"), (5, "Tell me of the bridge.", "It fell.", "g"),
        (6, "Tell me of the bridge.", "It fell. Nobody was hurt by it.", "h"), (7, "Tell me of the road.", "The old mill.", "h"), (8, "Tell me of the mill.", "The old mill.", "k"),
    ]
    frame = spark.createDataFrame(rows, "row_id bigint, prompt string, text string, generator_model string")
    for parts in (1, 3, 8):
        got = {r.row_id: r.defect for r in pairs.judge(frame.repartition(parts)).collect()}
        assert {k for k, v in got.items() if v == "truncated"} == {1, 8}, got
