import random

import brute
import corpus_pipeline

from syndrift.llm import minhash


def test_shape():
    assert minhash.shape() == (6, 10, 56) and minhash.shape(80, 100) == (4, 8, 67)
    for p in (50, 70, 80, 85, 90):
        least, rows, bands = minhash.shape(p, 100)
        assert (1 - (p / 100) ** rows) ** bands <= minhash.MISS and least * 100 >= p * (least + 1) and (least - 1) * 100 < p * least


def test_stage_links_from_four_fifths(spark):
    rng, texts = random.Random(1), ["a b c d e f g h", "a b c d e f g h i", "p q r s t u v w x", "p q r s t u v w x y"]
    for k in range(30):
        w = [f"w{k}x{i}" for i in range(104)]
        at = rng.randrange(10, 90)
        texts += [" ".join(w), " ".join(w[: at] + ["other"] + w[at + 1 :]), " ".join(w[:84])]
    own = [(i, brute.shingles(t)) for i, t in enumerate(texts)]
    links = {(a, b) for a, x in own for b, y in own if a < b and 100 * len(x & y) >= 80 * len(x | y)}
    assert any(100 * len(own[a][1] & own[b][1]) < 85 * len(own[a][1] | own[b][1]) for a, b in links) and (0, 1) in links and (2, 3) in links
    groups = brute.components(links, {i for i, _ in own})
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, "").collect()} == {i for i, g in groups.items() if i == g}
