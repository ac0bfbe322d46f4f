import corpus_pipeline
from hyperloom.llm import langid, quality_rules, secret_scan
from tests.llm.helpers import components

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_rules", "ngram_jaccard", "secret_scans", "best_fit_packing"]
    first = stages["language_id"](spark, docs, SF).cache()
    assert first.columns == docs.columns
    found = langid.predict_language(docs, langid.learn(docs))
    want = {r["doc_id"] for r in found.where(f"lang_pred <> 'und' and score >= {langid.LEAST_SCORE}").collect()}
    assert {r["doc_id"] for r in first.collect()} == want
    second = stages["quality_rules"](spark, first, SF).cache()
    judged = quality_rules.quality_rules(first, quality_rules.references(first))
    assert {r["doc_id"] for r in second.collect()} == {r["doc_id"] for r in judged.where("kept").collect()}
    third = stages["ngram_jaccard"](spark, second, SF).cache()
    groups = components([(r["doc_id"], r["text"]) for r in second.collect()], 5, (80, 100))
    assert {r["doc_id"] for r in third.collect()} == {top for _, top in groups.values()}
    fourth = stages["secret_scans"](spark, third, SF).cache()
    assert fourth.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in third.collect()}
    for r in fourth.collect():
        assert r["text"] == secret_scan.masked(texts[r["doc_id"]], secret_scan.find_secrets(texts[r["doc_id"]])[1])
        assert r["n_chars"] == len(r["text"])
        assert not secret_scan.scan(r["text"])
    pieces = stages["best_fit_packing"](spark, fourth, SF)
    assert {r["doc_id"] for r in pieces.collect()} == set(texts)


def test_run_equals_its_stages(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF).cache()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, df.collect()))


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
