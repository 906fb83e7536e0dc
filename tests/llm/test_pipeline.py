import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from syndrift.llm import cotrain, mixing, secret_scan
from syndrift.llm.store import Scratch

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "pages"))
    return cotrain.train(docs, labels, pages)


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.1"
    docs, labels, pages = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels", "pages"))
    kept = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0)
    scored = cotrain.score(docs, cotrain.train(docs, kept, pages), pages)
    test = scored.join(labels.join(kept, "doc_id", "left_anti"), "doc_id").select("kept", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).toPandas()
    assert len(test) > 1000
    assert test[test.good].kept.mean() > 0.99 and (~test[~test.good].kept).mean() > 0.9


def test_classifier_edges(spark, model):
    docs = brute.documents(spark)
    scored = cotrain.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.kept == (r.score >= cotrain.THRESHOLD) for r in scored)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    blank = cotrain.train(docs, none)
    assert blank.text is None and cotrain.score(docs, blank).where("not kept").count() == 0
    assert cotrain.score(docs.limit(0), model).count() == 0
    assert cotrain.train(docs.limit(0), none).prior == 1.0


def test_training_is_reproducible(spark, model):
    docs, labels, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "pages"))
    again = cotrain.train(docs.repartition(3), labels, pages)
    assert np.array_equal(again.terms, model.terms) and np.allclose(again.text.weights, model.text.weights)


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    scratch, docs = Scratch(spark, "t"), spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held.append(scratch.write(stage(spark, held[-1], SF), f"s{k}"))
    assert all(h.columns == docs.columns for h in held[:-1])
    rows = [{r.doc_id: r for r in h.collect()} for h in held]

    labels, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "pages"))
    scored = cotrain.score(docs, cotrain.train(docs, labels, pages), pages)
    assert set(rows[1]) == {r.doc_id for r in scored.collect() if r.kept}
    groups = brute.near_groups([(i, r.text) for i, r in rows[1].items()], 80)
    assert set(rows[2]) == {i for i, g in groups.items() if i == g}
    verdict = brute.contamination([(i, r.text) for i, r in rows[2].items()], bench)
    assert set(rows[3]) == {i for i, v in verdict.items() if not v[4]} and len(rows[3]) < len(rows[2])
    assert set(rows[4]) == set(rows[3])
    spans = {r.doc_id: r.spans for r in secret_scan.scan(held[3], secret_scan.trained(held[3])).collect()}
    for i, r in rows[4].items():
        text, out, at = rows[3][i].text, "", 0
        for s in spans[i]:
            if s.start >= at:
                out += text[at : s.start] + f"[REDACTED:{secret_scan.KINDS[s.no]}]"
            at = max(at, s.end)
        assert r.text == out + text[at:] and r.n_chars == len(r.text)
        assert not brute.secrets(r.text) and {b[:2] for b in brute.secrets(text)} <= {(s.start, s.no) for s in spans[i]}
    last = rows[5]
    assert set(last) == set(rows[4]) and all(last[i].size == len(brute.spaces(r.text)) and last[i].taken <= 3 * last[i].size for i, r in rows[4].items())
    sizes: dict = {}
    for i, r in rows[4].items():
        sizes.setdefault(r.source, []).append(last[i])
    order = sorted(sizes)
    want = mixing.targets([sum(x.size for x in sizes[s]) for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))])
    assert [sum(x.taken for x in sizes[s]) for s in order] == [round(t) for t in want]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r) for r in last.values())


@pytest.mark.parametrize("k", range(5))
def test_stage_on_awkward_rows(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    docs = brute.documents(spark).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id"))).withColumnsRenamed({"spans": "kept", "item_id": "component_id"})
    left = stage(spark, docs, SF)
    assert stage(spark, docs.limit(0), SF).count() == 0
    if k < 4:
        assert left.columns == corpus_pipeline.COLUMNS
        assert left.where("doc_id is null").count() == 1
        n = {0: None, 1: 1, 2: None, 3: docs.count()}[k]
        ids = [r.doc_id for r in left.collect()]
        assert n is None or (len(ids) == n if k == 3 else ids.count(4) == 1 and ids.count(5) == 0)
    else:
        assert left.count() == docs.count()
