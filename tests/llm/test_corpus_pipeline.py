"""The stages over a real table: each one's decisions take effect, on all rows that it was given."""

from collections import Counter

import corpus_pipeline
from alertweave.llm import importance, quality_rules
from test_similar_texts import groups_by_pairs

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    given, kept = [], []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given.append(docs)
        out = stage(spark, docs, FOLDER)
        if at < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(at)))
        docs = spark.read.parquet(str(tmp_path / str(at)))
        kept.append(docs)
    ids = lambda frame: Counter(r.doc_id for r in frame.select("doc_id").collect())
    assert ids(kept[0]) == ids(quality_rules.quality_rules(given[0], labels).filter("kept"))
    assert ids(kept[1]) == ids(importance.quality_classifier(given[1], labels).filter("kept"))
    rows = [(r.doc_id, r.text) for r in given[2].select("doc_id", "text").collect()]
    assert sorted(ids(kept[2]).elements(), key=repr) == groups_by_pairs(rows)
    assert set(ids(kept[3])) <= set(ids(given[3])) and max(ids(kept[3]).values()) <= 3
    assert ids(kept[4]) == ids(given[4])
    assert ids(corpus_pipeline.run(spark, FOLDER)) == ids(kept[4])
    texts = {(r.doc_id, r.text) for r in given[0].select("doc_id", "text").collect()}
    assert {(r.doc_id, r.text) for r in kept[4].select("doc_id", "text").collect()} <= texts
