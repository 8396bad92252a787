"""The pipeline's stages against what their operators say, and on tables of odd rows."""

from collections import Counter

import corpus_pipeline
from srcatlas.llm import langid, quality
from tests.llm.test_llm import DOCS, brute_jaccard, closed, edge_docs, prose


def test_stages(spark, tmp_path):
    rows = [(k, prose(60, k), "en", "abc"[k % 3], 0) for k in range(60)]
    rows += [(100 + k, rows[k][1] if k % 2 else rows[k][1] + " tail", "en", "a", 0) for k in range(10)]
    rows += [(200 + k, ("LOUD!! WORDS!! " * 20), "en", "a", 0) for k in range(5)] + edge_docs()
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = {r.doc_id for r in quality.classify(docs).where("kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs, docs.columns
        out = stage(spark, before, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality":
            assert {r.doc_id for r in docs.collect()} == want and not want & {200, 201, 202}
        if name == "language":
            found = langid.identify(before, langid.profiles(before.where(langid.remainder(before.doc_id, 5) != 0)))
            assert docs.count() == found.where("lang_pred <> 'und' and distance <= 0.8").count()
        if name == "near_duplicates":
            texts = [r.text for r in before.collect()]
            _, link = brute_jaccard(texts, 5, 80)
            groups = len(set(closed(link, list(range(len(texts))))))
            assert docs.count() == groups < len(texts)
            left = [r.text for r in docs.collect()]
            assert not brute_jaccard(left, 5, 80)[1].any()
        if name == "mixing":
            copies = Counter(r.text for r in docs.collect())
            assert set(copies) <= {r.text for r in before.collect()} and max(copies.values()) <= 2
    assert docs.where("not round_trip").count() == 0 and docs.count() == sum(copies.values())
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("token_ids").collect())) == sorted(map(str, docs.drop("token_ids").collect()))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
