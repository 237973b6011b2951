"""The pipeline's stages, each on its own input, against what it states."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline

from .test_exact import brute_components, brute_matches
from .test_models import brute_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert after.keys() <= before.keys() and after, name
        if k < 4:
            assert docs.columns == list(pipeline.COLUMNS)
        if name == "language ID":
            assert all(any(c.isalpha() for c in r["text"]) for r in after.values())
            assert {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")} == after.keys()
        elif name == "near-dedup":
            assert after.keys() == {i for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in before.values()], 5, 80) if i == c}
        elif name == "decontamination":
            for i, r in before.items():
                hit = brute_matches(r["text"], items)[1]
                assert i in after or hit
                assert i not in after or (after[i]["text"] == r["text"]) == (hit == 0)
                assert i not in after or after[i]["n_chars"] == len(after[i]["text"])
        elif name == "secret scan":
            assert after.keys() == before.keys()
            assert not any(brute_spans(r["text"]) for r in after.values())
            assert all(r["text"] == before[i]["text"] for i, r in after.items() if not brute_spans(before[i]["text"]) and "[SECRET]" not in r["text"])
        else:
            assert all(0 < r["taken"] <= 3 * r["n_words"] and r["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in after.values())
        before = after


def test_run_and_empty(spark):
    assert pipeline.run(spark, SF).columns == [*pipeline.COLUMNS, "taken", "n_words"]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_language_decisions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.select(*pipeline.COLUMNS)
    german = [r["doc_id"] for r in docs.filter("lang = 'de' and length(text) > 1000").filter(pipeline.held_out()).orderBy("doc_id").limit(5).collect()]
    lang = F.when(F.col("doc_id").isin(german[:4]), "en").when(F.col("doc_id") == german[4], F.lit(None)).otherwise(F.col("lang")).alias("lang")
    wrong = docs.select("doc_id", "text", lang, "source", "n_chars").unionByName(spark.createDataFrame([(10**7, "@@@@ 99 q", "en", None, 9)], docs.schema))
    out = {r["doc_id"]: r["lang"] for r in pipeline.identify_language(spark, wrong, SF).collect()}
    assert 10**7 not in out and out[german[4]] == "de" and sum(out[i] == "de" for i in german[:4]) >= 3
    before = {r["doc_id"]: r["lang"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert sum(out.get(i) != lang for i, lang in before.items()) <= len(before) // 200


def test_no_language_to_learn(spark, make):
    docs = make([(1, "some text", None), (2, "12 34", None), (3, None, None), (4, "é", None)])
    assert {(r["doc_id"], r["lang"]) for r in pipeline.identify_language(spark, docs, SF).collect()} == {(1, None), (4, None)}
