import random

import numpy as np

from folioscope.llm import toxicity
from tests.llm.fixtures import awkward, empty, prose

BAD = ["vile", "rotten", "gruesome"]


def table(spark, n=600):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words, bad = prose(i, 30 + i % 50).split(), i % 6 == 0
        for _ in range(rng.randrange(1, 9) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "ish", "ness"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents(spark):
    docs, labels = table(spark)
    model = toxicity.fit(docs, labels.filter("doc_id % 5 <> 0"))
    assert np.all(np.diff(model.thresholds) > 0) and len(model.thresholds) == 3
    out = toxicity.grade_toxicity(docs, model).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").filter("doc_id % 5 = 0").collect()
    wrong = [r for r in out if r["toxic"] != (r["truth"] == 1)]
    assert len(wrong) <= 2
    assert np.mean([r["severity"] for r in out if r["truth"]]) > 10 * np.mean([r["severity"] for r in out if not r["truth"]])


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (3000, 3)).astype(float)
    grades = np.searchsorted([0.5, 2.0, 3.5], x @ [2.0, 1.5, -1.0] + rng.logistic(0, 0.4, 3000))
    rows, cols = np.nonzero(x)
    weights, cuts = toxicity.fit_ordinal(rows, cols, x[rows, cols], grades, np.ones(3000), 3)
    assert weights[0] > weights[1] > 0 > weights[2] and np.all(np.diff(cuts) > 0)
    p = toxicity.Model({}, weights, cuts).grades(x @ weights)
    assert np.allclose(p.sum(axis=1), 1) and abs((p @ np.arange(4)).mean() - grades.mean()) < 0.05


def test_given_grades_awkward_and_empty(spark):
    docs, labels = table(spark, 200)
    graded = toxicity.fit(docs, labels.selectExpr("doc_id", "toxic * 2 AS grade"), grade="grade")
    assert len(graded.thresholds) == 2
    rows = awkward(spark)
    out = toxicity.grade_toxicity(rows, graded)
    assert out.columns == [*rows.columns, "severity", "_grade", "p_toxic", "toxic"] and out.count() == rows.count()
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 1), (999, 0)], "doc_id long, toxic int")
    toxicity.fit(rows, odd)
    none = toxicity.fit(rows, odd.limit(0))
    assert {(r["severity"], r["toxic"]) for r in toxicity.grade_toxicity(rows, none).collect()} == {(0.0, False)}
    assert toxicity.grade_toxicity(empty(spark), graded).count() == 0


def test_words_of_toxic_texts_alone_are_learnt_from_small_tables(spark):
    """As at scales 0.001 and 0.01: each insult in a part of the toxic texts, in no clean one."""
    for n, bad, found in ((90, 11, 18), (400, 51, 24)):
        rng, docs = random.Random(n), []
        for i in range(n):
            words = prose(i, 60).split()
            for word in rng.sample(BAD, 2) if i < bad else []:
                words.insert(rng.randrange(len(words)), word)
            docs.append((i, " ".join(words)))
        labels = spark.createDataFrame([(i, int(i < bad)) for i in range(n)], "doc_id long, toxic int")
        model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
        assert all(model.weights[model.features[w]] > 0 for w in BAD)
        new = [(i, f"{prose(1000 + i, 60)} {BAD[i % 3]} {BAD[(i + 1) % 3]}" if i < 30 else prose(1000 + i, 60)) for i in range(60)]
        out = toxicity.grade_toxicity(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
        assert sum(r["toxic"] for r in out if r["doc_id"] < 30) >= found and sum(r["toxic"] for r in out if r["doc_id"] >= 30) <= 2


def test_likelihood_root():
    root = toxicity.likelihood_root(np.array([12.0, 51.0, 0.0, 0.0]), np.array([0.0, 348.0, 40.0, 0.0]), 51.0, 348.0)
    assert root[0] > 5 and abs(root[1]) < 1e-6 and root[2] < 0 and root[3] == 0


def test_repeated_rows_change_nothing(spark):
    docs, labels = table(spark, 240)
    once = toxicity.fit(docs, labels)
    ten = docs
    for _ in range(9):
        ten = ten.unionByName(docs)
    again = toxicity.fit(ten, labels.unionByName(labels))
    assert once.features == again.features and np.allclose(once.weights, again.weights) and np.allclose(once.thresholds, again.thresholds)
    assert all(once.weights[once.features[w]] > 0 for w in BAD)


def test_the_sample_is_bounded_where_one_id_has_many_texts(spark):
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    rows, weigh = toxicity.labelled_sample(docs, labels, sample=4)
    assert rows.count() <= 4 and set(weigh) == {False, True}


def test_loss_and_gradient_against_plain_sums():
    rng = np.random.default_rng(2)
    n, width = 40, 5
    rows, cols = np.nonzero(rng.integers(0, 2, (n, width)))
    values, grades, weight = rng.random(len(rows)).astype(np.float32), rng.integers(0, 4, n), rng.random(n) + 0.5
    theta = np.concatenate([rng.normal(0, 1, width), [-1.0], rng.normal(0, 0.3, 2)])
    with toxicity.ThreadPoolExecutor(2) as pool:
        loss = toxicity.ordinal_loss(rows, cols, values, grades, weight, width, pool)

        def plain(x):
            cuts = [x[width], x[width] + np.exp(x[width + 1]), x[width] + np.exp(x[width + 1]) + np.exp(x[width + 2])]
            total = 0.0
            for i in range(n):
                z = sum(float(v) * x[f] for r, f, v in zip(rows, cols, values) if r == i)
                below = [0.0, *(1 / (1 + np.exp(-(c - z))) for c in cuts), 1.0]
                total -= weight[i] / weight.sum() * np.log(below[grades[i] + 1] - below[grades[i]])
            return total + toxicity.RIDGE / 2 * sum(x[:width] ** 2)

        value, gradient = loss(theta)
        assert abs(value - plain(theta)) < 1e-6
        for k in range(len(theta)):
            step = np.zeros(len(theta))
            step[k] = 1e-5
            assert abs((plain(theta + step) - plain(theta - step)) / 2e-5 - gradient[k]) < 1e-4
        best = toxicity.minimised(loss, theta, 500)
        assert np.abs(loss(best)[1]).max() < 2e-3 and all(loss(best)[0] <= loss(best + rng.normal(0, 0.05, len(best)))[0] for _ in range(20))


def test_grades_against_plain_products(spark):
    docs, labels = table(spark, 200)
    model = toxicity.fit(docs, labels)
    for r in toxicity.grade_toxicity(docs, model).collect():
        counts = {}
        for word in r["text"].split():
            for f in [word, *(word[:n] + "-" for n in toxicity.BEGINNINGS if len(word) > n)]:
                counts[f] = counts.get(f, 0) + 1
        z = sum(model.weights[model.features[f]] * np.log1p(n) for f, n in counts.items() if f in model.features)
        below = [0.0, *(1 / (1 + np.exp(-(c - z))) for c in model.thresholds), 1.0]
        p = np.diff(below)
        assert abs(r["severity"] - sum(k * x for k, x in enumerate(p))) < 1e-6 and abs(r["p_toxic"] - (1 - p[0])) < 1e-6
        assert r["toxic"] == (r["p_toxic"] >= toxicity.FLAG) and r["grade"] == int(np.argmax(p))


def test_the_sample_is_bounded_by_bytes(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 100) AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 10 = 0 AS INT) AS toxic")
    whole, weigh = toxicity.labelled_sample(docs, labels)
    assert whole.count() == 400 and weigh == {False: 1.0, True: 1.0}
    size = docs.selectExpr("sum(octet_length(text)) AS n").first()["n"]
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", size // 4)
    some, weigh = toxicity.labelled_sample(docs, labels)
    assert 60 < some.count() < 140 and set(some.toDF("grade", "half", "text").select("grade").distinct().toPandas()["grade"]) == {0, 1} and weigh[True] > 2
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 10)
    some, weigh = toxicity.labelled_sample(docs, labels)
    assert some.count() == 2 and weigh == {False: 360.0, True: 40.0}
