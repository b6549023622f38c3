"""Trial curves: the registered query's size, and the operator against its parts, at small sizes."""

import inspect

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scoreloom.operators import synthetic as Y
from scoreloom.plans import queries


def test_registered_with_the_whole_size(spark, monkeypatch):
    """100 trials of 1,000 and 2,000 documents, the reference's 13 rates and 10 shares, both modes."""
    asked = {}

    names = list(inspect.signature(Y.trial_rates).parameters)

    def noted(*args):
        asked.update(zip(names, args))
        return spark.createDataFrame([], Y._CURVES)

    monkeypatch.setattr(Y, "trial_rates", noted)
    assert queries.trial_curves(spark, "").columns == ["method", "clipped", "share", "fpr", "tpr", "auroc", "mode"]
    assert (asked["trials"], asked["n_tune"], asked["n_test"]) == (100, 1000, 2000)
    assert asked["fpr"] == (1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.005, 0.003, 0.001)
    assert asked["shares"] == (0.0, 0.02, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)
    assert sorted(asked["modes"]) == ["random", "tail"] and asked["tuned_at"] == 0.25


def test_batch_with_the_whole_size(spark):
    assert queries.synthetic_batch(spark, "").select("trial", "doc").count() == 100 * 2000


def test_batch_without_a_join(spark):
    llm, human = (Y.sample_tokens(spark, s, 2, 10, seed=i) for i, s in enumerate(("llm", "human")))
    want = Y.contaminate(llm, human, F.lit(0.25), "tail")
    assert sorted(Y.contaminated_batch(spark, 0.25, "tail", 2, 10).collect()) == sorted(want.collect())


def test_replaced_tokens(spark):
    """Those that ``contaminate`` replaces, for documents as ``sample_tokens`` draws them."""
    docs = Y._trial_documents(spark, 2, 5, 20, 11).filter("test")
    llm, other = (Y.sample_tokens(spark, s, 2, 20, seed=21 + i) for i, s in ((1, "llm"), (2, "human")))
    got = docs.orderBy("trial", "doc").toPandas()
    for mode in ("random", "tail"):
        for share in (0.05, 0.25, 0.5):
            want = Y.contaminate(llm, other, F.lit(share), mode, 12).orderBy("trial", "doc").toPandas()
            frames = [pd.DataFrame([r.asDict() for r in got[k]]) for k in ("llm", "other")]
            a, b = (Y.Docs(f.assign(length=frames[0]["length"])) for f in frames)
            mix = np.concatenate([np.asarray(x)[:k] for x, k in zip(got["mix"], a.n)])
            mixed = a.mixed(b, Y._hits(a, b, mode, mix)(share))
            assert all(np.array_equal(mixed.v[x], Y.Docs(want).v[x]) for x in Y.ARRAYS)


def test_curves(spark):
    """A row for each method, clipping, share, rate and mode; all pass at a rate of 1, more share is harder in the tail."""
    rows = Y.curves_by_mode(spark, trials=3, n_tune=60, n_test=80).toPandas()
    assert len(rows) == 6 * 2 * 10 * 13 * 2 and not rows.isna().any().any()
    assert (rows[rows.fpr == 1.0].groupby("share").tpr.mean() > 0.97).all()
    tail = rows[(rows["mode"] == "tail") & (rows.fpr == 0.05)].groupby("share").tpr.mean()
    assert tail[0.0] > tail[0.1] > tail[0.5]
    one = Y.trial_curves(spark, "tail", trials=3, n_tune=60, n_test=80).toPandas()
    key = ["method", "clipped", "share", "fpr"]
    same = rows[rows["mode"] == "tail"].drop(columns="mode").merge(one, on=key)
    assert len(same) == len(one) and np.allclose(same.tpr_x, same.tpr_y) and np.allclose(same.auroc_x, same.auroc_y)
