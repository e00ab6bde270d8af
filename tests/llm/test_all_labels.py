"""The quality model is fitted on all training labels, not on a sample of them."""

import numpy as np
import pytest

from heatloom.llm import pairwise_quality as Q


def test_weights_come_from_every_label(spark):
    """Beyond 4,000 labels a class: mean and number of pairs are those of all training rows."""
    n = 11_000
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 2 = 0, 'plain words here', concat('BAD!! ', id % 7, ' $$')) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(1 - id % 2 as int) as quality")
    model = Q.fit_quality(docs, labels)
    train = docs.where(Q.fold("doc_id", 5) != 0).collect()
    x = np.array([Q.features(r.text) for r in train])
    np.testing.assert_allclose(model["mean"], x.mean(0), atol=1e-12)
    kept = x.std(0) >= 1e-9
    np.testing.assert_allclose(model["std"][kept], x.std(0)[kept], rtol=1e-9)
    score = np.clip((x - x.mean(0)) / np.where(kept, x.std(0), np.inf), -8, 8) @ model["w"]
    share = np.mean([r.doc_id % 2 for r in train])
    assert model["cut"] == pytest.approx(Q.quantile_cut(score, np.ones(len(x)), share), abs=1e-9)


@pytest.mark.parametrize("most", [5, 5000])
def test_cut_by_narrowing(spark, most):
    rng = np.random.default_rng(4)
    s, w = np.round(rng.normal(size=700), 2), rng.choice([1.0, 2.5], 700)
    got = Q.weighted_cut(spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, w)], "s double, w double"), 0.37, most)
    assert abs(got - Q.quantile_cut(s, w, 0.37)) <= 0.0101  # rows of one score have no order
