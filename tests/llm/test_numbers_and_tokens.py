"""Percentiles, encoding, abusive content."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import abuse, quantiles, tokenize
from scoreloom.llm.folding import fold, show
from scoreloom.llm.stringkernel import Landmarks, features, scores

SCORED = "dataset string, scored_at timestamp, token_features struct<logp_a:array<double>,rank_a:array<bigint>,logrank_a:array<double>,entropy_a:array<double>,logp_b:array<double>,cross_entropy_ba:array<double>>, n string"


def test_sketch_error_and_merge():
    rng = np.random.default_rng(0)
    parts = [rng.pareto(1.5, n) * 10 for n in (10, 5000, 70000, 1, 30000)]
    whole = quantiles.Sketch(1)
    for i, p in enumerate(parts):
        s = quantiles.Sketch(i + 2)
        for piece in np.array_split(p, 7):
            s.add(piece)
        whole.merge(quantiles.Sketch.unpack(s.n, s.low, s.high, s.moved, s.pack(), 9))
    values = np.sort(np.concatenate(parts))
    assert whole.n == len(values) and whole.low == values[0] and whole.high == values[-1]
    assert sum(map(len, whole.levels)) < 4 * quantiles.K and whole.rank_error() < 0.03
    for p, v in zip(quantiles.PERCENTILES, whole.percentiles(quantiles.PERCENTILES)):
        assert abs(np.searchsorted(values, v, "right") / len(values) - p / 100) <= whole.rank_error()


def test_percentiles(spark):
    inf, nan = float("inf"), float("nan")
    odd = ([1.0, None, nan, inf, -inf, 3.0], [1, None, 5], [], None, None, None)
    rows = [("X sum", None, odd), (None, None, odd), ("xsum", None, None), ("squad", None, ([], [], [], [], None, None))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCORED)
    got = {(r.dataset, r.feature, r.percentile): r for r in quantiles.all_percentiles(df).filter("scope = 'all'").collect()}
    assert got["xsum", "logp_a", 1.0].value == 1.0 and got["xsum", "logp_a", 99.0].value == 3.0 and got["xsum", "logp_a", 50.0].n == 2
    assert got[None, "rank_a", 99.0].value == 5.0 and not any(k[0] == "squad" or k[1] == "entropy_a" for k in got)
    assert quantiles.all_percentiles(df.limit(0)).count() == 0


def test_days_combine(spark, small):
    df = spark.read.parquet(f"{small}/score_real_text.parquet")
    daily = quantiles.daily_sketches(df)
    assert daily.agg(F.sum("n")).first()[0] == quantiles.combine(daily).agg(F.sum("n")).first()[0]
    values = df.select(F.explode("token_features.logp_a").alias("x")).filter("x is not null and not isnan(x) and abs(x) < double('inf')").count()
    assert daily.filter("feature = 'logp_a'").agg(F.sum("n")).first()[0] == values


def test_errors_stay_within_the_bound(spark):
    """Many tasks with the same values for a key: each draws its own bits, and the merged ranks keep the stated error."""
    n, parts = 60_000, 24
    rows = spark.range(n).repartition(parts).selectExpr("'d' as dataset", "timestamp'2024-01-01' + make_dt_interval(cast(id % 5 as int)) as scored_at", "named_struct('logp_a', transform(sequence(0, 9), k -> double((id * 10 + k) * 7919 % 600011))) as token_features")
    daily = quantiles.daily_sketches(rows, ("logp_a",))
    assert daily.count() == 5
    values = np.sort(np.array([(i * 7919) % 600011 for i in range(n * 10)], dtype=float))
    for r in quantiles.percentiles(quantiles.combine(daily)).collect():
        assert r.n == len(values) and 0 < r.rank_error < 0.03
        assert abs(np.searchsorted(values, r.value, "right") / len(values) - r.percentile / 100) <= r.rank_error


ALPHABET = ["'s", "'S", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "a", "é", "9", "½", "²", "!", "🙂", "中", "ſ", "<|endoftext|>", "​", "́", "x" * 30]


def test_encoding_matches_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenize.vocabulary_path()
    ours, theirs = tokenize.encoder(path), tokenizers.Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(15))) for _ in range(4000)] + [None, "", "ab" * 5000]
    ids, at, starts, piece_at = ours.encode(texts)
    for i, (t, want) in enumerate(zip(texts, theirs.encode_batch([t or "" for t in texts], add_special_tokens=False))):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == want.ids
        assert ours.decode(own) == (t or "")
        assert not t or starts[piece_at[i]] == 0


def test_encode_and_decode(spark):
    rows = [(1, "Hello world's end"), (2, None), (3, ""), (4, "é\n\n x"), (4, "é\n\n x"), (5, "long text " * 200000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, ids string")
    got = tokenize.encode(df, offsets=True).collect()
    assert [len(r.ids) for r in sorted(got, key=lambda r: r.doc_id) if r.doc_id in (2, 3)] == [0, 0]
    assert next(r for r in got if r.doc_id == 1).piece_starts == [0, 5, 11, 13]
    back = {r.doc_id: r.text for r in tokenize.decode(tokenize.encode(df)).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert tokenize.encode(df.limit(0)).count() == 0


def test_folding():
    plain = lambda t: [show(s[a:b]) for s, o, _ in [fold([t])] for a, b in zip(o[:-1], o[1:])]
    for t in ("an IDIOT.", "an i d i o t.", "an 1d10t.", "an i-d-i-o-t.", "an idi­ot.", "an іdіоt."):
        assert plain(t) == ["an idiot."]
    assert plain("One. Two!\nThree") == ["one.", " two.", "three "] or len(plain("One. Two!\nThree")) == 3
    assert plain("") == [] and fold([None, "..."])[2].tolist() == []


def test_kernel_compiles_to_weights():
    s, at, _ = fold(["You are an idiot. The bridge is old.", "What a moron you are! Nothing here, nobody knows."])
    marks = Landmarks(s, at)
    k = marks.kernel(s, at)
    assert np.allclose(k, k.T, atol=1e-4)
    beta = np.random.default_rng(0).normal(size=marks.n)
    assert np.allclose(scores(s, at, marks.compiled(beta)), k @ beta, atol=1e-2)
    row, _, value = features(s, at)
    assert np.allclose(np.bincount(row, weights=value.astype(float) ** 2), np.diag(k), atol=1e-4)


def _corpus(n, seed):
    rng = random.Random(seed)
    names = ["Mira Tolen", "Joss Vane", "Pia Corm", "Ulla Reed"]
    good = ["The council of {} met near the bridge on Monday.", "{} said the harvest was early this year.", "A court heard that {} had called the judge an idiot.", "The museum shows a nude figure given by {}."]
    bad = ["{} is a worthless idiot and everybody knows it.", "Shut up, {}, you filthy moron!", "I will break your legs, {}.", "What a s t u p i d cow you are, {}."]
    docs, labels = [], []
    for i in range(n):
        abusive = i % 4 == 0
        lines = [rng.choice(good).format(rng.choice(names)) for _ in range(rng.randrange(3, 8))]
        if abusive:
            lines.insert(rng.randrange(len(lines)), rng.choice(bad).format(rng.choice(names)))
        docs.append((i, " ".join(lines), f"s{i % 3}" if i % 5 else None, "clash"))
        labels.append((i, int(abusive)))
    return docs, labels


def test_abuse_on_held_out_documents(spark):
    docs, labels = _corpus(600, 5)
    docs += [(9000, None, "s0", "x"), (9001, "", "s0", "x"), (9002, "...", None, "x"), (9003, docs[0][1] * 300, "s1", "x"), (9004, docs[0][1], "s1", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score string")
    reviews = spark.createDataFrame([(i, v, "r") for i, v in labels if i < 400] + [(1, None, "r"), (None, 1, "r")], "doc_id bigint, abusive int, reviewer string")
    terms = spark.createDataFrame([("idiot",), (None,)], "term string")
    got = {r.doc_id: r for r in abuse.scored(df, reviews, terms).collect()}
    truth = dict(labels)
    wrong = [i for i in range(400, 600) if got[i].abusive != bool(truth[i])]
    assert len(wrong) <= 4
    assert got[9000].margin is None and not got[9001].abusive and not got[9002].abusive
    assert got[9003].abusive and got[9004].margin == pytest.approx(got[0].margin)
    rates = abuse.source_rates(df, reviews, terms).collect()
    assert {r.source for r in rates} == {"s0", "s1", "s2", None} and sum(r.n_docs for r in rates) == len(docs)
    nothing = abuse.abusive_docs(df, reviews.limit(0), terms.limit(0))
    assert nothing.count() == 0


def test_saved_machine(spark, tmp_path):
    """A saved machine gives the results of the one that was fitted, and is not fitted again."""
    docs, labels = _corpus(200, 6)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score string")
    reviews = spark.createDataFrame([(i, v, "r") for i, v in labels], "doc_id bigint, abusive int, reviewer string")
    terms = spark.createDataFrame([("idiot",)], "term string")
    path = str(tmp_path / "machine")
    first = {r.doc_id: (r.margin, r.abusive) for r in abuse.scored(df, reviews, terms, path=path).collect()}
    again = {r.doc_id: (r.margin, r.abusive) for r in abuse.scored(df, reviews.limit(0), terms, path=path).collect()}
    assert first == again and sum(v for _, v in first.values()) > 20


def test_threshold_weighs_reviews_by_all_documents():
    """Reviews with far more cases than the corpus: where both kinds overlap, the threshold is higher than by the reviews alone."""
    rng = np.random.default_rng(0)
    case = np.arange(4000) < 2000
    margin = np.where(case, rng.normal(1, 0.8, 4000), rng.normal(-1, 0.8, 4000))
    at = abuse.split_point(margin, case)
    assert abs(at) < 0.2
    rare, half = (abuse.best_threshold(margin, case, p * (margin[case] > at).mean() + (1 - p) * (margin[~case] > at).mean()) for p in (0.02, 0.5))
    assert rare > half + 0.2


def test_fit_sample_is_bounded_in_symbols(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(abuse, "DOC_SYMBOLS", 200)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["The mill is old. " * 500, "word " * 5000]), pa.array([True, False])], names=["_id", "_text", "abusive"])
    bodies = [b for out in abuse._sentences(0)(batch) for b in out.column(2).to_pylist()]
    assert len(bodies) == 1 and len(bodies[0]) < 1000
