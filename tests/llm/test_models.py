"""Classifiers by held-out accuracy, and the pipeline against its operators' brute force."""

import os
import random

import numpy as np
import pytest
from conftest_llm import ODD, frame, words
from pyspark.sql import functions as F

from tilepress.llm import quality, toxicity
from tilepress.llm._fit import fold, sample

SF = "/root/testdata/sf0.01"


def labelled(spark, n=300):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        text = words(i, 40).split()
        bad = i % 4 == 0
        if bad:
            text.insert(rng.randrange(40), rng.choice(["vilestem" + e for e in ("er", "ing", "ous")]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, odd, empty):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.where("doc_id < 200"))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(200, 300))
    odd_scores = toxicity.toxicity(odd, model).collect()
    assert len(odd_scores) == len(ODD) and all(0 <= r.score <= 1 for r in odd_scores)
    assert toxicity.toxicity(empty, model).collect() == []
    assert toxicity.fit(docs, labels.where("false")).score(["x", ""]) == pytest.approx([0.5, 0.5])


def test_toxicity_on_labels(spark):
    """Labelled rows of the held-out fold: F1 at the operator's own threshold, and the area under the curve."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 4) != 2))
    held = docs.join(labels.where(fold("doc_id", 4) == 2), "doc_id")
    rows = toxicity.toxicity(held, model).join(labels, "doc_id").select("score", "toxic").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    hit = ((s >= 0.3) & (y == 1)).sum()
    assert 2 * hit / ((s >= 0.3).sum() + (y == 1).sum()) >= 0.8
    assert np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]) >= 0.95


def test_toxicity_counts(spark):
    """Texts of either class that hold each n-gram, and the choice by the G statistic, counted anew."""
    from collections import Counter
    from math import log

    rows = [("abcd", 1), ("abce", 1), ("abcd", 0), ("xyz", 0), ("xyzabc", 0), ("", 1), ("abcabc", 1)]
    counts = toxicity.ngram_counts(spark.createDataFrame(rows, "text string, label int"))
    got = {r.feature: (r.neg, r.pos) for r in counts.collect()}
    want = Counter()
    for t, y in rows:
        for g in set(next(toxicity.present([t]))[2].tolist()):
            want[g, y] += 1
    assert got == {g: (want[g, 0], want[g, 1]) for g, _ in want}

    def g_statistic(neg, pos):
        part = lambda k, p, m, q: k * log(p / q) + (m - k) * log((1 - p) / (1 - q))
        q = (neg + pos + 1) / 202
        return part(neg, (neg + 0.5) / 101, 100, q) + part(pos, (pos + 0.5) / 101, 100, q)

    made = {i: (i, 60 - i) for i in range(60)}
    table = spark.createDataFrame([(f, *c) for f, c in made.items()], "feature int, neg int, pos int")
    best = sorted((f for f in made if g_statistic(*made[f]) > 4), key=lambda f: (-round(g_statistic(*made[f]), 9), f))[:20]
    chosen = {r.feature: r.ratio for r in toxicity.chosen_features(table, 100, 100, 20).collect()}
    assert set(chosen) == set(best) and all(chosen[f] == pytest.approx(log((made[f][1] + 0.5) / (made[f][0] + 0.5))) for f in best)


def test_fits_take_one_row_of_a_repeated_id(spark):
    """More labelled rows than the bound, all of one id: none of the other ids is cut away."""
    docs, labels = labelled(spark, 60)
    many = docs.select("doc_id", "text").unionByName(spark.range(500).selectExpr("0L as doc_id", "concat('zz repeated row ', id) as text"))
    model = toxicity.fit(many, labels, rows=60)
    assert [model.score([t])[0] >= 0.3 for t in ("x vilestemer y", "plain words here")] == [True, False]
    stats = quality.text_statistics(many)
    one = quality.fit(stats, labels.withColumnRenamed("toxic", "quality"), rows=60)
    assert one == quality.fit(quality.text_statistics(many.repartition(5)), labels.withColumnRenamed("toxic", "quality"), rows=60)


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from tilepress.llm._common import shared_dir

    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            shared_dir(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None)))


def test_scores_do_not_see_neighbours():
    model = toxicity.Model(np.arange(1 << toxicity.BITS)[::7], np.ones(len(range(0, 1 << toxicity.BITS, 7))) * 0.01, -1.0)
    some = [t or "" for _, t in ODD]
    together = model.score(some)
    assert together.tolist() == pytest.approx([float(model.score([t])[0]) for t in some])


def test_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(100)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = sample(labels, "toxic", rows=20).collect()
    assert len(got) == 20 and len({r.doc_id for r in got}) == 20
    assert spark.range(4).select(fold("id", 4)).count() == 4


def test_quality(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    stats = quality.text_statistics(docs).cache()
    model = quality.fit(stats, labels.where(fold("doc_id", 5) != 0))
    held = stats.withColumn("score", model.column()).join(labels, "doc_id").where(fold("doc_id", 5) == 0).select("score", "quality").collect()
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in held]) >= 0.95
    rows = stats.withColumn("score", model.column()).collect()
    x = np.array([[r[k] for k in quality.STATS] for r in rows])
    assert model.score(x).tolist() == pytest.approx([r.score for r in rows])
    got = quality.text_statistics(odd).withColumn("score", model.column()).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    zero = [r for r in got if r.log_bytes == 0]
    assert len(zero) == 3 and all(r[k] == 0 for r in zero for k in quality.STATS)
    assert quality.text_statistics(empty).collect() == []
    none = quality.fit(stats, labels.where("false"))
    assert none.rules == () and stats.select(none.column()).first()[0] == pytest.approx(0.5)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 120)
    extra = [(1000, words(1, 40)), (1001, words(2, 200)), (1002, words(2, 200) + " more"), (1003, None), (1004, "")]
    texts = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.expr("if(doc_id % 3 = 0, null, 's')").alias("source"), F.length("text").cast("long").alias("n_chars"))
    more = spark.createDataFrame(extra, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(null as bigint) n_chars")
    texts.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = [r.doc_id for r in at.collect()]
        assert at.columns == list(corpus_pipeline.COLUMNS) or name == "bpe"
    assert set(kept["toxicity"]) == {i for i in range(120) if i % 4} | {1000, 1001, 1002, 1003, 1004}
    assert set(kept["exact_dedup"]) == set(kept["toxicity"]) - {1000, 1004}
    assert set(kept["near_dedup"]) == set(kept["exact_dedup"]) - {1002}
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) - {1003} and max(kept["mixing"].count(i) for i in kept["mixing"]) <= 2
    assert sorted(kept["bpe"]) == sorted(kept["mixing"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(kept["bpe"])
    assert os.path.exists(f"{tmp_path}/4")


def staged(spark, path, rows):
    spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    return spark.read.parquet(path)


def test_pipeline_near_copies_from_80_percent(spark, tmp_path):
    import corpus_pipeline

    own = words(5, 100, 1_000_000).split()
    other, far = list(own), list(own)
    for k in (30, 60):
        other[k] = "changed"  # 86 of 106 shingles: 0.81
    for k in (20, 40, 60):
        far[k] = "else"  # 81 of 111: 0.73
    docs = staged(spark, f"{tmp_path}/docs", [(1, " ".join(own)), (2, " ".join(other)), (3, " ".join(far))])
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == [1, 3]


@pytest.mark.parametrize("read", [True, False])
def test_pipeline_null_and_repeated_ids(spark, tmp_path, read):
    import corpus_pipeline

    a, b, c, d, e, f = (words(i, 60, 1_000_000) for i in range(30, 36))
    rows = [(5, a), (None, a), (5, a), (6, b), (6, b), (6, c), (3, c), (None, d), (None, d), (None, e), (None, e + " end"), (7, f), (7, f + " end"), (7, words(40, 60, 1_000_000))]
    docs = staged(spark, f"{tmp_path}/docs", rows)
    docs = docs if read else spark.createDataFrame(docs.collect(), docs.schema).repartition(3)
    seen = lambda frame: sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)
    exact = corpus_pipeline.without_copies(spark, docs, "")
    want = [(5, a), (6, b), (3, c), (None, d), (None, e), (None, e + " end"), (7, f), (7, f + " end"), rows[-1]]
    assert seen(exact) == sorted(want, key=str)
    exact.write.parquet(f"{tmp_path}/exact")
    near = seen(corpus_pipeline.without_near_copies(spark, spark.read.parquet(f"{tmp_path}/exact"), ""))
    assert len(near) == 7 and {t.removesuffix(" end") for _, t in near} == {t.removesuffix(" end") for _, t in want}
    mixed = seen(corpus_pipeline.mixed(spark, docs, ""))
    size = lambda found: sum(len(t.split()) for _, t in found)
    assert size(mixed) == pytest.approx(1.5 * size(rows), abs=62) and set(mixed) == set(rows) and max(mixed.count(x) / rows.count(x) for x in rows) <= 2


def test_pipeline_drops_what_the_operator_marks(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(0.4 / 0.6)))  # every text scores 0.4
    monkeypatch.setattr(corpus_pipeline, "fit", lambda *_: model)
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.clean(spark, staged(spark, f"{tmp_path}/docs", [(1, "a b c")]), str(tmp_path)).collect() == []
