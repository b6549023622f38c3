import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import text as X
from scoreloom.functions.names import path_name, stable_hash
from scoreloom.operators import evaluate as E
from scoreloom.operators import metrics as M
from scoreloom.operators import prepare as P
from scoreloom.operators import samples as S
from scoreloom.operators import scorer
from scoreloom.operators import synthetic as Y
from scoreloom.operators.grid import grid_scores
from scoreloom.operators.quantiles import quantiles
from scoreloom.operators.scores import METHODS, clipped_score, raw_score
from scoreloom.sources import records as R
from scoreloom.sources import reports

TEXTS = ["One. Two! Three?  Four", "  A b. C d.\x1cE", "", "   ", None, "no end", "a.b.c", "Mr. X went.\n\nThen he left. "]


def _sentences(text):
    import re

    return [p.strip() for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p.strip()]


def test_sentences_and_words(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r for r in df.select("i", X.sentences(F.col("t")).alias("s"), X.word_count(F.col("t")).alias("n"), X.join_sentences(X.sentences(F.col("t"))).alias("j")).collect()}
    for i, t in enumerate(TEXTS):
        if t is None:
            assert got[i].s is None
            continue
        assert got[i].s == _sentences(t)
        assert got[i].n == len(t.split())
        assert got[i].j == " ".join(_sentences(t))


def test_first_long_text(spark):
    df = spark.createDataFrame([("a " * 80, "b " * 90), ("a", "b " * 80), (None, "c"), ("d " * 79, None)], "x string, y string")
    assert [r.f for r in df.select(X.first_long_field(["x", "y"]).alias("f")).collect()] == ["x", "y", None, None]


def _token_rows(spark, rng, n=60):
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 7, 20])
        values = [[rng.gauss(-3, 2) for _ in range(size)] for _ in range(5)]
        for v in values:
            if size > 3 and rng.random() < 0.3:
                v[rng.randrange(size)] = rng.choice([None, math.nan, math.inf])
        ranks = [rng.randint(1, 99) for _ in range(size)]
        label, mode, ratio = rng.choice([("human", "none", 0.0), ("llm", "none", 0.0), ("llm", "random", 0.1), ("llm", "random", 0.2), ("llm", "tail", 0.2)])
        tokens = None if rng.random() < 0.05 else (values[0], ranks, values[1], values[2], values[3], values[4])
        rows.append((i, i // 2, label, mode, ratio, "binoculars" if i % 3 == 0 else "primary", tokens))
    schema = "id int, sample_id int, label string, contamination_mode string, ratio double, score_source string, token_features struct<logp_a:array<double>,rank_a:array<bigint>,logrank_a:array<double>,entropy_a:array<double>,logp_b:array<double>,cross_entropy_ba:array<double>>"
    return rows, spark.createDataFrame(rows, schema)


def _finite(values):
    return [float(v) for v in values if v is not None and math.isfinite(v)]


def _mean(values):
    own = _finite(values)
    return sum(own) / len(own) if own else None


def _reference(method, d, spec, t):
    if t is None:
        return None
    up = spec.get("nll_upper", math.inf)
    nll = [None if v is None else (min(-v, up) if math.isfinite(v) else math.nan) for v in t[0]]
    single = {"log_likelihood": 0, "rank": 1, "log_rank": 2, "entropy": 3}
    if method in single:
        return _mean([None if v is None else (max(d * v, spec.get("lower", -math.inf)) if math.isfinite(v) else math.nan) for v in t[single[method]]])
    if method == "entropy_gap":
        m = _mean([None if a is None or b is None else a - b for a, b in zip(nll, t[3])])
        return None if m is None else d * m
    if method == "lrr":
        bottom = _mean([min(v, spec.get("logrank_upper", math.inf)) for v in _finite(t[2])])
    else:
        bottom = _mean(t[5])
    top = _mean(nll)
    return None if top is None or bottom is None else d * top / (bottom + 1e-12)


def test_scores_three_ways(spark):
    rows, df = _token_rows(spark, random.Random(3))
    specs = {m: [{}, {"lower": -3.0} if m in ("log_likelihood", "rank", "log_rank", "entropy") else {"nll_upper": 3.5} | ({"logrank_upper": -2.0} if m == "lrr" else {})] for m in METHODS}
    turn = {m: 1 if m in ("log_likelihood", "lrr") else -1 for m in METHODS}
    grid = {(r.id, r.method, r.cand): r.score for r in grid_scores(df, ["id"], specs, turn).collect()}
    columns = [clipped_score(m, F.lit(turn[m]), specs[m][1]).alias(m) for m in METHODS]
    sql = {r.id: r for r in df.select("id", *columns).collect()}
    raw = {r.id: r for r in df.select("id", *(raw_score(m).alias(m) for m in METHODS)).collect()}
    for row in rows:
        for m in METHODS:
            for cand in (0, 1):
                want = _reference(m, turn[m], specs[m][cand], row[6])
                found = grid.get((row[0], m, cand))
                assert (want is None) == (found is None)
                if want is not None:
                    assert found == pytest.approx(want, abs=1e-9, rel=1e-9)
                    other = sql[row[0]][m] if cand else turn[m] * raw[row[0]][m]
                    assert other == pytest.approx(want, rel=1e-9)
            if _reference(m, 1, {}, row[6]) is None:
                assert raw[row[0]][m] is None
    with pytest.raises(KeyError):
        raw_score("unknown")


def test_quantiles_exact(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(0, 1, 500), rng.pareto(1, 300) * 1e5, -rng.pareto(1, 100), np.zeros(50), np.full(60, 2.5)])
    rows = [("a", float(v)) for v in values] + [("b", 1.0), (None, 3.0), (None, 5.0), ("c", math.nan), ("c", None), ("c", math.inf)]
    at = (0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0)
    got = {(r.g, r.q): r.quantile for r in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", at).collect()}
    for q in at:
        assert got["a", q] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12)
        assert got["b", q] == 1.0
        assert got[None, q] == pytest.approx(3 + 2 * q)
    assert not any(g == "c" for g, _ in got)


def test_rates_and_auroc(spark):
    rng = np.random.default_rng(1)
    h, m = np.round(rng.normal(0, 1, 200), 1), np.round(rng.normal(0.7, 1, 150), 1)
    rows = [("x", "human", float(v)) for v in h] + [("x", "llm", float(v)) for v in m] + [("y", "human", 1.0)]
    df = spark.createDataFrame(rows, "g string, label string, score double")
    areas = {r.g: r.auroc for r in M.auroc(df, ["g"], F.col("label") == "llm").collect()}
    assert areas["x"] == pytest.approx(np.mean([(a > h).mean() + (a == h).mean() / 2 for a in m]), abs=1e-9)
    assert areas["y"] is None
    back = {r.g: r.auroc for r in M.auroc(df, ["g"], F.col("label") == "human").collect()}
    assert areas["x"] + back["x"] == pytest.approx(1, abs=1e-8)
    rates = M.tpr_at_fpr(df.filter("label = 'human'"), df.filter("label = 'llm'"), ["g"], (0.01, 0.05, 1.0)).collect()
    for r in rates:
        assert r.tpr == pytest.approx((m >= round(np.quantile(h, 1 - r.fpr), 9)).mean(), abs=1e-9)


def test_evaluate_against_numpy(spark):
    """The whole of tuning and testing, written again as loops."""
    rows, df = _token_rows(spark, random.Random(11), 240)
    halves = {i: "tune" if i % 2 else "test" for i in range(120)}
    split = spark.createDataFrame(list(halves.items()), "sample_id int, split string")
    got = {(r.mode, r.method, r.ratio): r for r in E.evaluate(df, split).collect()}
    single = {"log_likelihood": 0, "rank": 1, "log_rank": 2, "entropy": 3}
    for method in METHODS:
        own = [r for r in rows if (r[5] == "binoculars") == (method == "binoculars")]

        def score(part, d, spec, method=method):
            found = [_reference(method, d, spec, r[6]) for r in part]
            return np.round([x for x in found if x is not None], 10)

        def pick(half, label, mode, ratio=None, own=own):
            return [r for r in own if halves[r[1]] == half and r[2] == label and r[3] == mode and (ratio is None or r[4] == ratio)]

        def rate(h, m, fpr):
            return np.mean(np.round(m, 9) >= round(float(np.quantile(h, 1 - fpr)), 9)) if len(h) and len(m) else None

        th, tm = pick("tune", "human", "none"), pick("tune", "llm", "none")
        d = 1 if round(score(tm, 1, {}).mean(), 9) >= round(score(th, 1, {}).mean(), 9) else -1
        pool = [r[6] for r in th + tm if r[6] is not None]

        def q(i, turn, at, pool=pool):
            return round(float(np.quantile([turn * v for t in pool for v in _finite(t[i])], at)), 9)

        specs = [{}]
        if method in single:
            specs += [{"lower": q(single[method], d, x)} for x in E.LOWER]
        elif method == "lrr":
            specs += [{"nll_upper": q(0, -1, a), "logrank_upper": q(2, 1, b)} for a in E.UPPER for b in E.UPPER]
        else:
            specs += [{"nll_upper": q(0, -1, x)} for x in E.UPPER]
        for mode in ("random", "tail"):
            seen = sorted({r[4] for r in rows if r[3] == mode and halves[r[1]] == "tune"})
            at = 0.25 if 0.25 in seen else seen[len(seen) // 2]
            tc = pick("tune", "llm", mode, at)
            worth = []
            for s in specs:
                h, c, k = score(th, d, s), score(tm, d, s), score(tc, d, s)
                worth.append(round(0.5 * (rate(h, k, 0.05) or 0) + 0.35 * (rate(h, k, 0.01) or 0) + 0.15 * (rate(h, c, 0.05) or 0), 9))
            best = specs[int(np.argmax(worth))] if len(score(tc, d, {})) else {}
            h0, h1 = (score(pick("test", "human", "none"), d, s) for s in ({}, best))
            for ratio in {r[4] for r in rows if r[3] == mode}:
                test = pick("test", "llm", mode, ratio)
                if not len(score(test, d, {})):
                    assert (mode, method, ratio) not in got
                    continue
                r = got[mode, method, ratio]
                assert r.direction == d and json.loads(r.clip_spec) == pytest.approx(best)
                for name, h, s, fpr in (("raw_tpr_at_1_fpr", h0, {}, 0.01), ("raw_tpr_at_5_fpr", h0, {}, 0.05), ("clipped_tpr_at_1_fpr", h1, best, 0.01), ("clipped_tpr_at_5_fpr", h1, best, 0.05)):
                    assert r[name] == pytest.approx(rate(h, score(test, d, s), fpr), abs=1e-8)
                assert r.raw_tpr_at_5_fpr >= r.raw_tpr_at_1_fpr


def test_split_half(spark):
    df = spark.createDataFrame([(i % 31, "none" if i % 31 != 7 else "tail") for i in range(200)] + [(None, "none")], "sample_id bigint, contamination_mode string")
    got = S.split_half(df).collect()
    assert len(got) == 30 and sum(r.split == "tune" for r in got) == 15
    order = {r.sample_id: r.h for r in spark.range(31).select(F.col("id").alias("sample_id"), stable_hash(F.col("id")).alias("h")).collect()}
    tune = [order[r.sample_id] for r in got if r.split == "tune"]
    assert max(tune) <= min(order[r.sample_id] for r in got if r.split == "test")
    one = spark.createDataFrame([(5, "none")], "sample_id bigint, contamination_mode string")
    assert sorted(r.split for r in S.split_half(one).collect()) == ["test", "tune"]
    assert S.split_half(one.limit(0)).count() == 0


def test_ratio_and_keys(spark):
    rows = [(1, "random", 0.05), (1, "random", 0.1 + 0.2 - 0.1), (1, "random", 0.3), (2, "tail", 0.25), (2, "tail", 0.5), (3, "none", None)]
    df = S.with_ratio(spark.createDataFrame(rows, "sample_id int, contamination_mode string, contamination_ratio double").withColumn("dataset", F.lit(" X_sum")).withColumn("label", F.lit("llm")))
    assert {r.contamination_mode: r.tuning_ratio for r in S.tuning_ratio(df).collect()} == {"random": 0.2, "tail": 0.25}
    assert S.contaminated_subset(df, "random", 0.2).count() == 1
    S.require_same_keys(df, df)
    with pytest.raises(ValueError, match="missing"):
        S.require_same_keys(df, df.filter("sample_id <> 2"))
    with pytest.raises(ValueError):
        S.require_rows(df.limit(0), "clean")


def _examples(spark):
    llm = " ".join(f"Machine sentence {i} here." for i in range(10))
    human = " ".join(f"Human sentence {i} {'rare' * (i + 1)}." for i in range(4))
    rows = [(1, "d", "e", "p", human, llm), (2, "d", "e", "p", "", llm), (3, "d", "e", "p", human, "One only"), (4, "d", "e", "p", human, "")]
    return spark.createDataFrame(rows, "sample_id bigint, dataset string, example_id string, prompt string, human_continuation string, llm_continuation string")


def test_contaminate_random(spark):
    cells = P.grid(_examples(spark), modes=("random",))
    for r in P.contaminate_random(cells).collect():
        before, after, human = _sentences(r.llm_continuation), _sentences(r.text), _sentences(r.human_continuation)
        if r.ratio == 0 or not before or not human:
            assert r.text == r.llm_continuation and r.k == 0
            continue
        k = min(len(before), max(1, round(len(before) * r.ratio)))
        changed = [i for i, (a, b) in enumerate(zip(before, after)) if a != b]
        assert len(after) == len(before) and len(changed) == k == r.k and all(after[i] in human for i in changed)


def test_contaminate_tail(spark):
    examples = _examples(spark)
    costs = spark.createDataFrame([(1, [1.0, 3.0, 3.0, 2.0]), (2, []), (3, [1.0, 3.0, 3.0, 2.0]), (4, [1.0, 3.0, 3.0, 2.0])], "sample_id bigint, costs array<double>")
    seen = 0
    for r in P.contaminate_tail(P.grid(examples, modes=("tail",)), costs).collect():
        before, after, human = _sentences(r.llm_continuation), _sentences(r.text), _sentences(r.human_continuation)
        if r.ratio == 0 or not before or not human:
            assert r.text == r.llm_continuation
            continue
        k = min(len(before), len(human), max(1, round(len(before) * r.ratio)))
        top = sorted(((c, i) for i, c in enumerate([1.0, 3.0, 3.0, 2.0])), reverse=True)[:k]
        want = list(before)
        for j, (_, i) in enumerate(top):
            want[min(len(before) - 1, math.floor((j + 0.5) * len(before) / k))] = human[i]
        assert after == want
        seen += 1
    assert seen == 12


def test_dedupe_prefix(spark):
    long = "word " * 120
    rows = [(1, long + "a"), (2, long.replace(" ", "  ", 1)), (3, long + "b"), (4, "short"), (5, None)]
    got = P.dedupe_prefix(spark.createDataFrame(rows, "id bigint, text string").filter("text is not null"))
    keys = {" ".join(t[:500].split()) for _, t in rows if t}
    assert got.count() == len(keys)
    assert P.dedupe_prefix(spark.createDataFrame(rows, "id bigint, text string").filter("text is not null"), n_needed=1).count() == 1


def test_rows_law(spark):
    examples = _examples(spark)
    assert P.clean_rows(examples).count() == 2 * 4
    assert P.grid(examples).count() == 14 * 4
    assert P.keep_first(examples, 1).count() == 1


def test_synthetic(spark):
    llm, human = (Y.sample_tokens(spark, s, 2, 20, seed=5) for s in ("llm", "human"))
    again = Y.sample_tokens(spark, "llm", 2, 20, seed=5).repartition(3)
    key = lambda d: sorted((r.trial, r.doc, r.length, tuple(r.logp_a)) for r in d.collect())
    assert key(llm) == key(again)
    assert all(25 <= r.length <= 80 and max(r.logp_a) < 0 and min(r.entropy_a) > 0 for r in llm.collect())
    h = {(r.trial, r.doc): r for r in human.collect()}
    base = {(r.trial, r.doc): r for r in llm.collect()}
    for r in Y.contaminate(llm, human, F.lit(0.25), "tail").collect():
        m, o = base[r.trial, r.doc], h[r.trial, r.doc]
        harm = [-o.logp_a[i] + o.logrank_a[i] + max(o.logp_b[i] - o.logp_a[i], 0) for i in range(r.length)]
        chosen = set(sorted(range(r.length), key=lambda i: (-harm[i], i))[: round(r.length * 0.25)])
        assert list(r.logp_a) == [o.logp_a[i] if i in chosen else m.logp_a[i] for i in range(80)]
    same = {(r.trial, r.doc): r for r in Y.contaminate(llm, human, F.lit(0.0), "random").collect()}
    assert all(same[k].logp_a == base[k].logp_a for k in base)
    with pytest.raises(ValueError):
        Y.contaminate(llm, human, F.lit(0.1), "other")
    with pytest.raises(ValueError):
        Y.sample_tokens(spark, "cat", 1, 1)
    one = Y.matrix_scores(llm).first()
    m = base[one.trial, one.doc]
    n = m.length
    assert one.lrr_both == pytest.approx(-sum(m.logp_a[:n]) / sum(m.logrank_a[:n]), rel=1e-6)
    assert one.likelihood_ratio == pytest.approx(np.mean(np.subtract(m.logp_a[:n], m.logp_b[:n])), rel=1e-6)
    low = Y.matrix_scores(llm, {"log_likelihood": {"logp_lower": -2.0}}).first()
    assert low.log_likelihood == pytest.approx(np.maximum(base[low.trial, low.doc].logp_a[: base[low.trial, low.doc].length], -2.0).mean(), rel=1e-6)


def test_draws_are_uniform_and_apart(spark):
    """Means, spread and the correlation of draws by neighbouring keys and by names are those of independent ones."""
    rows = spark.range(200_000).select(*(Y.uniform(3, F.col("id"), k).alias(f"a{k}") for k in (0, 1)), Y.uniform(3, F.col("id") + 1, 0).alias("next"), Y.uniform(4, F.col("id"), 0).alias("seed"), Y.normal(3, F.col("id"), "noise").alias("z")).toPandas()
    assert abs(rows.a0.mean() - 0.5) < 0.004 and abs(rows.a0.std() - 12**-0.5) < 0.003
    assert (np.abs(rows[["a0", "a1", "next", "seed"]].corr().to_numpy() - np.eye(4)) < 0.012).all()
    assert abs(rows.z.mean()) < 0.012 and abs(rows.z.std() - 1) < 0.012
    counts = np.bincount((rows.a0 * 100).astype(int), minlength=100)
    assert ((counts - 2000) ** 2 / 2000).sum() < 170


class _Toy:
    """A model over bytes whose next token depends on the last one."""

    def __init__(self, seed):
        self.table = np.random.default_rng(seed).normal(size=(256, 256))

    def encode(self, text):
        return list(text.encode())

    def decode(self, ids):
        return bytes(ids).decode("latin-1")

    def logits(self, ids):
        return self.table[list(ids)]


def test_scorer(spark):
    a, b = _Toy(0), _Toy(1)
    f = scorer.score_text(a, b, "ab", "cd")
    p = np.exp(scorer.log_softmax(a.table))
    assert f["logp_a"] == pytest.approx([math.log(p[98, 99]), math.log(p[99, 100])])
    assert f["rank_a"][0] == 1 + (a.table[98] > a.table[98, 99]).sum()
    assert f["entropy_a"][0] == pytest.approx(-(p[98] * np.log(p[98])).sum())
    q = np.exp(scorer.log_softmax(b.table))
    assert f["cross_entropy_ba"][0] == pytest.approx(-(q[98] * np.log(p[98])).sum())
    assert len(scorer.score_text(a, None, "", "abc")["logp_a"]) == 2
    assert scorer.mean_cost(a, "x", "") == -math.inf
    with pytest.raises(ValueError):
        scorer.score_text(a, None, "x", "")
    scorer.same_tokens(a, b)
    greedy = scorer.generate(a, "a", 3, temperature=0)
    assert greedy and scorer.generate(a, "a", 3, temperature=0.5, seed=1) == scorer.generate(a, "a", 3, temperature=0.5, seed=1)


def test_records_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("xsum", "1", 1, "p", "human", "Grüße «ы»", "human_clean", "none", 0.0, "a/b", None)], R.TEXT_ROW)
    path = str(tmp_path / "rows")
    R.write_jsonl(rows, path)
    assert R.read_jsonl(spark, path).collect() == rows.collect()
    (tmp_path / "bad.jsonl").write_text('{"dataset": "x"}\n\n{bad\n')
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    assert R.write_csv(rows, str(tmp_path / "csv")) and not R.write_csv(rows.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    R.write_partitioned(rows, str(tmp_path / "parts"))
    assert (tmp_path / "parts/dataset=xsum/model=a__b").is_dir()
    calls = []

    def make():
        calls.append(1)
        return rows

    for force in (False, False, True):
        R.materialize(spark, str(tmp_path / "kept"), make, force)
    assert len(calls) == 2
    assert R.job_matrix(spark, ["a", "b"], ["m/1", "m/2", "m/3"]).count() == 6
    assert rows.select(path_name(F.col("generator_model")).alias("x")).first().x == "a__b"
    with pytest.raises(KeyError):
        R.read_corpus(spark, "other", path)


def test_reports(spark, small, tmp_path):
    metrics = spark.read.parquet(f"{small}/metric_rows.parquet")
    assert reports.console_table(metrics).count() == 7
    assert reports.plot_curves(metrics.limit(5), str(tmp_path / "x.png")) in (True, False)


def test_stream(spark, small, tmp_path):
    from scoreloom.streaming.scores import scored_stream, write_stream

    source = spark.read.parquet(f"{small}/score_real_text.parquet")
    source.write.parquet(str(tmp_path / "in"))
    query = write_stream(scored_stream(spark, str(tmp_path / "in"), source.schema), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.count()
