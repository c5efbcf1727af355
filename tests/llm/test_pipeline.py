"""The pipeline's stages, each against a brute-force form of its decision."""

import re

import corpus_pipeline as cp
from tallyfold.llm import toxicity
from tests_brute import brute_contaminated, near_groups


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, kept = docs.columns, {}
    df = docs
    for name, stage in cp.STAGES[:-1]:
        df = stage(spark, df, sf_dir)
        assert df.columns == names
        df = df.cache()
        kept[name] = {r.doc_id: r for r in df.collect()}
        assert len(kept[name]) == df.count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    model = toxicity.fit(docs, toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert set(kept["toxicity"]) == {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in kept["toxicity"] for i in clean) >= 0.98 * len(clean)
    groups = near_groups({i: r.text for i, r in kept["toxicity"].items()}, 5, 80)
    assert set(kept["near_duplicates"]) == {min(g) for g in groups}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(kept["decontamination"]) == {i for i, r in kept["near_duplicates"].items() if not brute_contaminated(r.text, items)}
    assert set(kept["secrets"]) == set(kept["decontamination"])
    for i, r in kept["secrets"].items():
        before = kept["decontamination"][i].text
        assert not re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}|password=[A-Za-z0-9+/_.=-]{12}", r.text) and r.n_chars == len(r.text)
        if "SECRET]" not in r.text:
            assert r.text == before
    packed = cp.STAGES[-1][1](spark, df, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(kept["secrets"])
    assert cp.run(spark, sf_dir).count() == len(packed)


def test_odd_rows_pass_through(spark, odd, sf_dir):
    df = odd.drop("n_chars").selectExpr("*", "cast(length(text) as long) AS n_chars")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns
        df = out.cache()
    ids = [r.doc_id for r in df.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 9] and ids.count(None) == 2
    assert all(stage(spark, df.where("false"), sf_dir).count() == 0 for _, stage in cp.STAGES)
