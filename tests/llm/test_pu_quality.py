import random
import zlib

import numpy as np

from pointlake.llm import pu_quality as pu


def corpus(n=400):
    rng = random.Random(4)
    say = lambda k: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(k))
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.75
        text = say(rng.randrange(60, 160))
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        if rng.random() < 0.5:
            labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    odd = [(1000, None), (1001, ""), (1002, "\xa0é"), (None, "some text"), rows[3]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumnRenamed("x", "score")
    lab = spark.createDataFrame([*labels, (labels[0][0], 0, 0)], "doc_id long, quality int, toxic int")
    got = pu.quality_scores(docs, lab).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: not t.isupper() for i, t in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([bool(r.predicted) == truth[r.doc_id] for r in held]) > 0.97


def test_prior_is_bounded_by_the_mixture():
    rng = np.random.default_rng(5)
    positive = rng.normal(2, 1, 4000)
    unlabelled = np.where(rng.random(4000) < 0.6, rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000))
    counted = [np.histogram(x, bins=200, range=(-7, 7))[0] for x in (positive, unlabelled)]
    assert abs(pu.estimate_prior(*counted) - 0.6) < 0.05


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = ({r.doc_id: r.score for r in pu.quality_scores(docs, spark.createDataFrame(x, schema)).collect()} for x in (labels, flip))
    assert a == b


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in pu.quality_scores(docs, none).collect()] == [0.5]
    assert pu.quality_scores(docs.limit(0), none).count() == 0


def test_one_text_an_id_is_fitted(spark):
    rows, labels = corpus(200)
    schema, lab = "doc_id long, text string", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    hot = next(i for i, q, _ in labels if q == 1 and zlib.crc32(str(i).encode()) % 3 != 1)
    many = spark.createDataFrame(rows, schema).unionAll(spark.range(20_000).selectExpr(f"{hot}L as doc_id", "concat('row ', id) as text"))
    shown = []
    plain = pu._featured
    pu._featured = lambda texts: shown.append(texts.count()) or plain(texts)
    try:
        pu.fit(many, lab, ~pu.held_out(), sample_docs=50)
    finally:
        pu._featured = plain
    assert shown == [min(100, shown[0])]


def rank_quality(scores, truth):
    """Area under the curve: how often a good document outranks a bad one."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(len(scores))
    good = truth.sum()
    return (ranks[truth].sum() - good * (good - 1) / 2) / (good * (~truth).sum())


def test_held_out_labels_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    held = pu.quality_scores(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "quality").toPandas()
    assert len(held) > 1000
    outranks, agrees = rank_quality(held.score.to_numpy(), (held.quality == 1).to_numpy()), ((held.score >= 0.5) == (held.quality == 1)).mean()
    assert outranks > 0.95 and agrees > 0.9, (outranks, agrees)
