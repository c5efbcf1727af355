"""Toxicity and language on held-out rows, and what a factorization machine adds."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tallyfold.llm import langid, registry, toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.op1_toxicity(spark, sf)
    m = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(m) > 300 and (m.predicted == m.toxic).mean() > 0.97
    assert ((m.score >= 0.5) == (m.predicted == 1)).all() and m.score.between(0, 1).all()
    assert m.predicted[m.toxic == 1].mean() > 0.85


def test_pairs_count_for_more_than_their_sum():
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 6)) < 0.5).astype(np.uint8)
    y = (x[:, 0] ^ x[:, 1] ^ 1).astype(np.float32)  # no additive weights can say this
    bias, w, v = toxicity.train(x, y, epochs=60)
    s = x @ v
    z = bias + x @ w + 0.5 * ((s**2).sum(1) - x @ (v**2).sum(1))
    assert ((z > 0) == (y > 0)).mean() > 0.95
    assert max(((x[:, [0, 1]] @ a + b > 0) == (y > 0)).mean() for a in ([1, 1], [1, -1], [-1, 1], [-1, -1]) for b in (-1.5, -0.5, 0.5, 1.5)) < 0.8


def test_machine_equals_the_sum_over_pairs(spark):
    import pyarrow as pa

    texts = pa.array(["abc defgh ijklmnop", None, "", "defgh " * 3000 + "zz"])
    terms = np.unique(np.concatenate([t for _, _, t, _ in toxicity._terms(texts)]))
    rng = np.random.default_rng(1)
    m = toxicity.Machine(terms, 0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 3)))
    want = []
    for t in ["abc defgh ijklmnop", "", "", "defgh zz"]:
        own = np.unique(np.concatenate([np.zeros(0, np.uint32), *[x for _, _, x, _ in toxicity._terms(pa.array([t]))]]))
        at = np.searchsorted(terms, own)
        z = 0.3 + m.weight[at].sum() + sum(m.factor[i] @ m.factor[j] for k, i in enumerate(at) for j in at[k + 1 :])
        want.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    np.testing.assert_allclose(m.scores(texts), want, rtol=1e-9)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, "a"), (2, 0, "b"), (2, 1, "b"), (9, 0, "c"), (None, 1, "d"), (7, None, "e"), (99, 1, "f")], "doc_id long, toxic int, text string")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.reject(odd, model).columns == odd.columns
    none = toxicity.fit(odd, labels.where("false"))
    assert {r.predicted for r in toxicity.score(odd, none).collect()} == {0}
    assert {r.predicted for r in toxicity.score(odd, toxicity.fit(odd, labels.where("toxic = 1"))).collect()} == {1}
    assert toxicity.score(odd.where("false"), model).count() == 0


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    m = registry.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(m) > 250 and (m.lang_pred == m.lang).mean() > 0.97 and m.score.between(0, 1).all()


def test_backoff_and_odd_rows(spark, odd):
    rows = [("zorbly zorbly glimf", "xx"), ("brakte brakta brakto", "yy"), (None, "yy"), ("lost", None), ("", "xx")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ["xx", "yy"] and "zorbly" in model.word_at
    langs, scores = model.predict(["zorbly", "zorblim", "braktik", "123 ! ² Ⅷ", None, "", "q"])
    assert langs[:6] == ["xx", "xx", "yy", "und", "und", "und"] and scores[3:6].tolist() == [0, 0, 0]
    assert (model.unseen(["braktik"])[0] == model.gram_log[[model.gram_at[f"5{g}"] for g in langid.grams("braktik", 5) if f"5{g}" in model.gram_at]].sum(0)).all()
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count() and all(r.lang_pred == "und" for r in got if r.doc_id in (3, 4, 5))
    nothing = langid.fit(odd.where("false"))
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, nothing).collect()} == {("und", 0.0)}
    assert langid.predict(odd.where("false"), model).count() == 0


def test_gram_counts_equal_plain_counting():
    rng = np.random.default_rng(0)
    found = ["".join(rng.choice(list("abñ中"), rng.integers(1, 9))) for _ in range(200)]
    n = rng.integers(1, 5, 200)
    want = {}
    for w, c in zip(found, n.tolist()):
        for k in range(1, langid.LONGEST + 1):
            for g in langid.grams(w, k):
                want[f"{k}{g}"] = want.get(f"{k}{g}", 0) + c
    got = {}
    for terms, counts in langid.gram_counts(found, n):
        got.update(zip(terms, counts.tolist()))
    assert got == want


def test_model_size_is_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "WORDS", 50)
    monkeypatch.setattr(langid, "GRAMS", 80)
    model = langid.fit(docs)
    assert 0 < len(model.word_at) <= 50 and 0 < len(model.gram_at) <= 80


def test_terms_that_are_not_broadcast_count_as_well(spark, docs, odd, monkeypatch):
    for table in (docs, odd):
        whole = langid.fit(table)
        assert whole.left is None
        want = sorted(map(tuple, langid.predict(docs, whole).collect()))
        for most in ((50, 80), (1, 1)):
            with monkeypatch.context() as m:
                m.setattr(langid, "WORDS", most[0])
                m.setattr(langid, "GRAMS", most[1])
                m.setattr(langid, "HOT", 20)
                few = langid.fit(table)
                got = sorted(map(tuple, langid.predict(docs, few).collect()))
                strange = sorted(map(str, langid.predict(odd, few).collect()))
            assert [g[:2] for g in got] == [w[:2] for w in want]
            np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-6)
            assert len(strange) == odd.count()


def test_rare_language_is_told_by_words_that_are_not_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    def turned(ids):  # a language of 30 texts: English, letters turned by 13
        return ids.withColumn("text", F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm")).withColumn("lang", F.lit("xx"))

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text").where("lang IS NOT NULL")
    learn, test = docs.where("crc32(cast(doc_id AS string)) % 3 != 1"), docs.where("crc32(cast(doc_id AS string)) % 3 = 1")
    english = "lang = 'en' AND length(text) BETWEEN 200 AND 4000"
    learn = learn.unionByName(turned(learn.where(english).orderBy("doc_id").limit(30)))
    test = test.unionByName(turned(test.where(english).orderBy("doc_id").limit(60)).withColumn("doc_id", -F.col("doc_id") - 1))
    model = langid.fit(learn)
    assert model.left
    m = langid.predict(test, model).join(test.select("doc_id", "lang"), "doc_id").toPandas()
    right = (m.lang_pred == m.lang).groupby(m.lang).mean()
    assert len(right) == 5 and right.min() > 0.99, right


def test_small_sample_keeps_the_prior_of_all_labels(spark):
    rows = []
    for i in range(2400):  # "dubious" is in 300 clean texts and in 100 toxic ones
        toxic = i % 12 == 0
        word = "dubious" if (i % 24 == 0 if toxic else i % 22 < 3) else "vile" if toxic else "pleasant"
        rows.append((i, f"{word} text", int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.drop("toxic"), table.drop("text").union(spark.range(10**6, 10**6 + 3000).selectExpr("id", "1"))
    clean = table.where("toxic = 0").drop("toxic")
    kept = [toxicity.reject(clean, toxicity.fit(docs, labels.where("doc_id < 1000000"), sample=k)).count() for k in (4000, 150)]
    assert kept == [2200, 2200]
    assert toxicity.reject(clean, toxicity.fit(docs, labels, sample=1500)).count() == 2200  # labels without a document do not count


def brute_language(rows, text):
    """(language, score) by plain dictionaries over all words and n-grams of ``rows`` (text, language)."""
    word, gram, langs = {}, {}, sorted({x for t, x in rows if langid.words(t)})
    for t, x in rows:
        for w in langid.words(t):
            word.setdefault(w, {}).setdefault(x, 0)
            word[w][x] += 1
            for k in range(1, langid.LONGEST + 1):
                for g in langid.grams(w, k):
                    gram.setdefault((k, g), {}).setdefault(x, 0)
                    gram[k, g][x] += 1
    weigh = []
    for counts in (word, gram):
        total = {x: sum(c.get(x, 0) for c in counts.values()) for x in langs}
        weigh.append({x: 2 * max(total.values()) / total[x] for x in langs})
    z = dict.fromkeys(langs, 0.0)
    for w in langid.words(text):
        found, scale = ([word[w]], weigh[0]) if w in word else ([], weigh[1])
        for k in range(langid.LONGEST, 0, -1):
            found = found or [gram[k, g] for g in langid.grams(w, k) if (k, g) in gram]
        for c in found:
            for x in langs:
                z[x] += np.log1p(c.get(x, 0) * scale[x])
    best = max(langs, key=lambda x: (z[x], [-ord(c) for c in x]))
    return (best, 1 / sum(np.exp(v - z[best]) for v in z.values())) if langid.words(text) else ("und", 0.0)


def test_predictions_equal_plain_counting(spark, docs, monkeypatch):
    learn = docs.where("doc_id % 3 <> 1 AND lang IS NOT NULL AND length(text) < 2000")
    rows = [(r.text, r.lang) for r in learn.collect()]
    ask = {r.doc_id: r.text for r in docs.where("doc_id % 3 = 1 AND length(text) < 2000").limit(25).collect()} | {-1: "zzyzx qqq brrr", -2: "12", -3: None, -4: "unbekanntes wortgeflecht inconnu"}
    want = {i: brute_language(rows, t or "") for i, t in ask.items()}
    asked = spark.createDataFrame(list(ask.items()), "doc_id long, text string")
    for most in (None, 300):
        got = {r.doc_id: r for r in langid.predict(asked, langid.fit(learn, most_words=most, most_grams=most)).collect()}
        for i, (lang, score) in want.items():
            assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-6, i


def test_a_scan_for_languages_holds_little_of_a_batch():
    """A worker's memory must not grow with the bytes of an Arrow batch: 12 MB of texts are scanned in under 40 MB."""
    rng = np.random.default_rng(5)
    names = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)]
    texts = pa.array([" ".join(names[i] for i in rng.integers(0, 2000, 400)) for _ in range(6000)])
    ids = pa.array(range(len(texts)))
    known = dict(zip(names[:1000], range(1000)))
    model = SimpleNamespace(value=langid.Model(["en", "fr"], known, np.ones((1000, 2)), {}, np.zeros((0, 2)), ("words", "grams")))
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], names=["row", "doc_id", "text"])
    rows, most = 0, []
    for run, given in ((langid._scan(model), batch), (langid._count_words, pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), texts], names=["lang", "text"]))):
        tracemalloc.start()
        rows += sum(len(b) for b in run(iter([given])))
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert rows == len(texts) + 2000 and max(most) < 40e6
