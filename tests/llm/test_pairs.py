import random

import pyarrow as pa
import pytest

from scoreloom.llm import pairrules as R
from scoreloom.llm import pairs

LONG = "The old bridge was closed in May and the council met twice. A spokesman said the road would open again before the summer. "
ROWS = "row_id bigint, prompt string, text string, generator_model string, extra string"


def _judge(spark, rows):
    return {r.row_id: r.defect for r in pairs.judge(spark.createDataFrame([(*r, "g", "x") for r in rows], ROWS)).collect()}


@pytest.mark.parametrize("text", [None, "", " \n\t", "...", "​", "N/A", "[no output]", "<empty>", '""', "--"])
def test_empty(text):
    assert R.is_empty(text)


@pytest.mark.parametrize(
    "text",
    [
        "I'm sorry, but I can’t continue this text.", "As an AI language model, I cannot write about this topic.", "Request declined: content policy.",
        "The road was wet. However, I must decline to finish the article.", "No. I will not write that.", 'You ask me to go on after "The road". I will not.',
        'Writing more on "The road" is against the rules I follow.', "My guidelines do not permit me to help with that.", "Ich möchte diesen Text lieber nicht fortsetzen.",
        "En tant que modèle de langue, je dois refuser", "Lo siento, no puedo continuar este texto.", "Мне не разрешено писать об этом.", "There is nothing I am willing to add.",
        "Generating this sort of text is outside what I'm permitted to do.", "I'D RATHER NOT ANSWER THAT.",
    ],
)
def test_refusal(text):
    assert R.is_refusal(text, "The road was")


@pytest.mark.parametrize(
    "text",
    [
        '"I will not write that," the mayor told the bank.', "I cannot say why one tram was there.", "A spokesman declined to answer, saying the policy did not allow it.",
        "It was against the policy of the trust to sell the mill.", '"I\'m sorry, but I cannot comment on the mill," said the mayor.', "The clerk was not permitted to assist the mayor.",
        "As an assistant at the bank, she was not allowed to comment.", "He refused to continue with the harbour.", "«Je ne peux pas continuer », dit-il.",
    ],
)
def test_no_refusal(text):
    assert not R.is_refusal(text, "The road was")


def test_quotation_left_open_by_the_prompt():
    assert not R.is_refusal('I will not write that," she said. It rained.', 'He asked. "No,')
    assert R.is_refusal("I cannot continue this text.", 'He asked. "No,')


def test_judge(spark):
    prompt = "The council met on Monday in the old town hall because of the bridge that was closed"
    german = "Die Brücke wurde im Mai geschlossen und der Rat hat sich zweimal mit der Straße und der Kirche befasst."
    rows = [
        (1, prompt, LONG.strip()), (2, prompt, prompt), (3, prompt, "Sure! " + prompt.upper() + "."), (4, prompt, german), (5, prompt, LONG + "The road was"),
        (6, prompt, LONG + "He saw the mill and Mr."), (7, None, LONG.strip()), (8, prompt, None), (9, prompt, LONG + '"We went home."'),
        (10, prompt, LONG + "Then the mayor of the town."), (11, prompt, LONG + "Then the mayor of the town left the hall."), (12, None, german), (1, prompt, LONG.strip()),
        (13, prompt, LONG * 3000), (14, prompt, "I cannot continue this text"),
    ]
    got = _judge(spark, rows)
    assert got == {1: None, 2: "copied_prompt", 3: "copied_prompt", 4: "other_language", 5: "truncated", 6: "truncated", 7: None, 8: "empty", 9: None, 10: "truncated", 11: None, 12: None, 13: None, 14: "refusal"}


def test_empty_table(spark):
    assert _judge(spark, [(1, None, None)]) == {1: "empty"}
    assert pairs.broken_pairs(spark.createDataFrame([], ROWS)).count() == 0


def test_shortened_across_partitions(spark):
    base = [f"text {i:03d} starts here and goes on" for i in range(200)]
    keys = [(b,) for b in base] + [(b + " to the end",) for b in base] + [(b + ". Then",) for b in base[:50]]
    frame = spark.createDataFrame(keys, "key string").repartition(4)
    got = {r.code for r in pairs.shortened(frame, pairs.Scratch(spark, "t")).collect()}
    assert got == {pairs._code(b) for b in base}


def test_a_later_key_goes_on(spark):
    """The next key begins a new sentence, a later one that begins the same way goes on inside it."""
    prompt = "The council met on Monday in the old town hall because of the bridge"
    texts = ["He went early to the work.", "He went early to the work. Then he slept.", "He went early to the workers and left.", "He went early to the work! So he said."]
    for parts in (1, 4):
        frame = spark.createDataFrame([(i, prompt, t, "g", "x") for i, t in enumerate(texts)], ROWS).repartition(parts)
        assert {r.row_id for r in pairs.broken_pairs(frame).collect()} == {0}


def test_seams_between_partitions(spark):
    """Runs of keys longer than a partition, nested ones, and closers before what follows: the same keys for any cut."""
    rng = random.Random(7)
    bits = ["a", "b", ".", "! ", '"', " word", ". Then"]
    for _ in range(30):
        keys = sorted({"begin of it" + "".join(rng.choice(bits) for _ in range(rng.randrange(7))) for _ in range(60)})
        want = {k for k in keys if any(o != k and o.startswith(k) and R.goes_on(o[len(k) :]) for o in keys)}
        cuts = sorted(rng.sample(range(1, len(keys)), 6))
        codes, seams = set(), set()
        for part in [keys[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)])]:
            for out in pairs._compare_neighbours(iter([pa.RecordBatch.from_arrays([pa.array(part)], names=["key"])])):
                codes |= {c for c in out.column(0).to_pylist() if c is not None}
                seams |= {k for k in out.column(1).to_pylist() if k is not None}
        for out in pairs._compare_seams(iter([pa.RecordBatch.from_arrays([pa.array(sorted(seams))], names=["key"])])):
            codes |= set(out.column(0).to_pylist())
        assert codes == {pairs._code(k) for k in want}


def test_length_limits(spark):
    rows = [("g", 100)] * 90 + [("g", n) for n in range(80, 120)] + [("h", n) for n in range(50)] + [("k", 7)] * 5
    for times in (1, 3):
        got = pairs.length_limits(spark.createDataFrame(rows * times, "generator_model string, n_words bigint")).collect()
        assert [tuple(r) for r in got if r.generator_model == "g"] == [("g", 100)] and not [r for r in got if r.generator_model == "h"]


def test_the_same_verdict_in_tables_of_any_size(spark):
    """Words that can't end a sentence are known in a table of one row, and those that are never seen to once there are enough; more rows change nothing."""
    body = "We saw the mill and the road by the town. Then we went home. "
    few = [(1, None, body + "It rained on the."), (2, None, body + "Then we went home."), (3, None, "Sie sahen das Haus und die.")]
    seen = []
    for more in (0, 40, 4000):
        got = _judge(spark, few + [(10 + i, None, body * 3 + f"He saw house {i} of the town.") for i in range(more)])
        seen.append({i: got[i] for i in (1, 2, 3)})
    assert seen == [{1: "truncated", 2: None, 3: "truncated"}] * 3


def test_quotations_in_disorder():
    """Marks that lost their partner, and marks within marks."""
    for text in ('orchards. I will not write that," she told the bank.', '"We left. "I will not write that," she said.', "«We left», he said, „ich kann nicht helfen“, and left."):
        assert not R.is_refusal(text, "It was")
    for text in ('Writing more on ""We want to praise a" is against the rules I follow.', 'You ask me to go on after ""We want to review". I will not.', 'Writing more on "Fenu added: "Nobody below" is against the rules I follow.'):
        assert R.is_refusal(text, 'He said: "We')
