"""Every term of the word list becomes a landmark."""

from scoreloom.llm import abuse


def test_all_terms_reach_the_fit(spark, monkeypatch):
    got = []
    monkeypatch.setattr(abuse, "fit", lambda s, offsets, doc, verdict, terms, seed: got.extend(terms))
    docs = spark.createDataFrame([(1, "A calm text about the mill."), (2, "Another calm text about the road.")], "doc_id bigint, text string")
    reviews = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, abusive int")
    words = [f"term{i:04d}" for i in range(700)]
    abuse.train(docs, reviews, spark.createDataFrame([(w,) for w in [*words, None, words[0]]], "term string"))
    assert got == words
