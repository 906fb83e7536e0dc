"""Co-training takes in every document without a label, and awkward labels and columns have defined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from syndrift.llm import cotrain
from syndrift.llm.store import Scratch

SF = "/root/testdata/sf0.01"


def test_bound_equals_brute_force():
    rng = np.random.default_rng(1)
    x, cut, column = rng.normal(size=(30, 3)), np.arange(31) * 2, rng.permuted(np.tile(np.arange(7), (30, 1)), axis=1)[:, :2].ravel()
    model = cotrain.Logistic(rng.normal(size=10), 0.3, np.zeros(3), np.ones(3))
    y = (rng.random(30) < 0.5).astype(float)
    slope, curve = cotrain.bound_of(model, (x, cut, column), y)
    full = np.concatenate([x, np.zeros((30, 7)), np.ones((30, 1))], axis=1)
    for i in range(30):
        full[i, 3 + column[2 * i : 2 * i + 2]] = 1
    p = cotrain.sigmoid(full @ np.append(model.weights, model.bias))
    assert np.allclose(slope, full.T @ (p - y), atol=0.05)
    for _ in range(50):
        step = rng.normal(size=11)
        assert (curve * step * step).sum() >= 0.98 * ((p * (1 - p)) * (full @ step) ** 2).sum() - 0.05


def test_every_unlabelled_document_takes_part(spark):
    docs, labels, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "pages"))
    model = cotrain.train(docs, labels, pages, rounds=0)
    whole = cotrain._with_meta(cotrain.featured(cotrain._own(docs), model.terms), pages).join(labels.select("doc_id"), "doc_id", "left_anti").select("dense", "terms", "meta")
    n = docs.join(labels, "doc_id", "left_anti").count()
    models = {"text": model.text, "meta": model.meta}
    rows = Scratch(spark, "t").write(whole, "pool")
    got = [cotrain.pseudo(rows.repartition(k), models) for k in (1, 7)]
    one = rows.toArrow()
    views = {"text": cotrain._flat_text(one["dense"], one["terms"]), "meta": cotrain._flat_meta(one["meta"])}
    assert one.num_rows == n > 500
    for k, other in (("text", "meta"), ("meta", "text")):
        p = cotrain.sigmoid(models[other].calibrated(*views[other]))
        sure = np.flatnonzero((p >= cotrain.SURE) | (p <= 1 - cotrain.SURE))
        if len(sure):
            slope, curve = cotrain.bound_of(models[k], cotrain._take(views[k], sure), (p[sure] >= 0.5).astype(float))
            for own in got:
                assert own[k].n == len(sure) and np.array_equal(own[k].slope, slope) and np.array_equal(own[k].curve, curve)
    assert got[0]["meta"].n > 20


@pytest.mark.parametrize("side", ["quality", "toxic"])
def test_null_labels(spark, side):
    """A null quality is good, a null toxic is not toxic."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.limit(150)
    full = labels.withColumn(side, F.when(F.col("doc_id") % 3 > 0, F.col(side)).otherwise(F.lit(1 if side == "quality" else 0)))
    nulls = labels.withColumn(side, F.when(F.col("doc_id") % 3 > 0, F.col(side)))
    a, b = (cotrain.train(docs, x, rounds=1) for x in (full, nulls))
    assert a.prior == b.prior and np.array_equal(a.terms, b.terms) and np.allclose(a.text.weights, b.text.weights)
    none = labels.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    assert cotrain.train(docs, none).prior == 1.0


def test_clashing_columns_and_repeated_rows(spark):
    docs, labels, pages = (spark.read.parquet(f"{SF}/{t}.parquet").limit(400) for t in ("documents", "labels", "pages"))
    more = docs.withColumns({c: F.lit("clash") for c in ("meta", "good", "held", "url", "terms", "dense", "text_odds", "kept")}).unionByName(docs.limit(1), allowMissingColumns=True)
    model = cotrain.train(more, labels.withColumn("text", F.lit("clash")), pages.withColumn("doc_id", F.lit("clash")), rounds=1)
    assert cotrain.score(more, model, pages).count() == docs.count() + 1
