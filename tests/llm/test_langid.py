import random

import numpy as np

from folioscope.llm import langid
from tests.llm.fixtures import awkward, empty

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "er"], "cc": ["qué", "ción", "os", "ll"]}


def text(lang, seed, words=30):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))).capitalize() for _ in range(words))


def plain_subwords(s):
    """Subwords by slicing words with a blank at either end."""
    letters = "".join(c if c.isalpha() else " " for c in s.lower())
    return sorted(g for w in letters.split() for n in langid.ORDERS for i in range(len(w) + 3 - n) for g in [f" {w} "[i : i + n]])


def test_subwords_are_those_of_each_text_alone():
    texts = ["Ab c", "", "12 !!", "Éa-b  c", "x", "a" * 50, "中文 ab"]
    bucket, ends = langid.subwords(texts)
    for t, part in zip(texts, np.split(bucket, ends[:-1])):
        assert len(part) == len(plain_subwords(t))
        alone, _ = langid.subwords([t])
        assert sorted(part.tolist()) == sorted(alone.tolist())


def test_held_out_accuracy_and_calibration(spark):
    rows = [(i, text(x, i, 3 + i % 40), x) for i in range(240) for x in SYLLABLES]
    docs = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs.filter("doc_id % 4 <> 0"), sample=400)
    out = langid.identify(docs.filter("doc_id % 4 = 0"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out) and sum(r["rejected"] for r in out) < 0.02 * len(out)
    again = langid.fit(docs.filter("doc_id % 4 <> 0").repartition(5), sample=400)
    assert np.array_equal(model.scores, again.scores) and model.temperature == again.temperature


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "fr"]
    out = langid.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "_score", "rejected"]
    for r in out.collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["_score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in model.langs
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == out.filter("NOT rejected").count()
    none = langid.fit(empty(spark))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


def test_the_sample_never_grows_beyond_its_bound(spark):
    """More languages than the sample has rows, a language with most rows, null and repeated ids, rows that are the same."""
    many = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 50 END AS doc_id", "concat('wort ', id % 4000) AS text", "CASE WHEN id % 2 = 0 THEN 'big' ELSE concat('l', id % 3001) END AS lang")
    assert langid.sampled(many, sample=100).count() == 100
    same = spark.range(5000).selectExpr("CAST(1 AS LONG) AS doc_id", "'ein Text' AS text", "'de' AS lang").unionByName(spark.range(700).selectExpr("id AS doc_id", "concat('a text ', id) AS text", "'en' AS lang"))
    got = langid.sampled(same, sample=400).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"de": 1, "en": 200}
    few = spark.range(7).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang")
    assert langid.sampled(few, sample=400).count() == 7


def test_predictions_against_plain_averages(spark):
    rows = [(i, text(x, i, 1 + i % 9) + (" 12 Éa" if i % 7 == 0 else ""), x) for i in range(60) for x in SYLLABLES]
    docs = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs, sample=90)
    for r in langid.identify(docs, model).collect():
        # one subword after another, each by itself
        columns = [model.scores[:, b].astype(float) for b in langid.subwords([r["text"]])[0]]
        mean = [sum(c[k] for c in columns) / len(columns) + model.bias[k] for k in range(len(model.langs))]
        e = [2.718281828459045 ** ((m - max(mean)) / model.temperature) for m in mean]
        best = max(range(len(e)), key=e.__getitem__)
        assert r["lang_pred"] == model.langs[best] and abs(r["score"] - e[best] / sum(e)) < 1e-6
        logs = [float(model.logs[b]) for b in langid.subwords([r["text"]])[0]]
        k = best
        distance = (model.mean[k] - sum(logs) / len(logs)) / (model.drift[k] + model.spread[k] / len(logs)) ** 0.5
        assert r["rejected"] == (r["score"] < model.least or distance > model.far)



def test_a_repeated_row_changes_nothing(spark):
    """A language beside one row of it that stands 200,000 times is learnt as if that row stood once."""
    words = spark.createDataFrame([(i, text("bb", i), "bb") for i in range(300)] + [(1000 + i, text("aa", i), "aa") for i in range(300)], "doc_id long, text string, lang string")
    hot = spark.range(200_000).selectExpr("CAST(9 AS LONG) AS doc_id", "'schein ungern' AS text", "'bb' AS lang")
    once, often = (langid.sampled(words.unionByName(x), sample=400) for x in (hot.limit(1), hot))
    rows = [sorted(map(tuple, x.select("lang", "h").collect())) for x in (once, often)]
    assert rows[0] == rows[1] and sum(r[0] == "bb" for r in rows[0]) == 200
    assert langid.fit(words.unionByName(hot), sample=400).langs == ["aa", "bb"]


def test_texts_of_no_learnt_language_are_rejected(spark):
    """A language left out, and strings of consonants, against texts of the learnt languages that were not trained on."""
    docs = spark.createDataFrame([(k, text(x, k, 5 + k % 40), x) for k in range(300) for x in ("aa", "bb")], "doc_id long, text string, lang string")
    model = langid.fit(docs, sample=500)
    rng = random.Random(3)
    consonants = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 9))) for _ in range(12)) for _ in range(200)]
    assert model.predict(consonants)[2].mean() > 0.97
    assert model.predict([text("cc", k, 12) for k in range(200)])[2].mean() > 0.9
    for lang in ("aa", "bb"):
        assert model.predict([text(lang, 5000 + k, 1 + k % 50) for k in range(200)])[2].mean() < 0.03
    assert model.predict([text("aa", k, 20) + " " + text("bb", k, 20) for k in range(200)])[2].mean() < 0.05  # a mixture of learnt ones
