import corpus_pipeline

from cytolith.llm import op4_packing, op5_secret_scan, op7_simhash_golay
from cytolith.llm.common import materialise, table


def test_stages_take_effect_and_run_applies_them(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {"documents": {r["doc_id"]: r["text"] for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = list(seen.values())
    assert all(set(b) <= set(a) for a, b in zip(texts, texts[1:], strict=False))
    # near-duplicates: the smallest id of each group of equal fingerprints is there
    before, after = seen["language_id"], seen["near_duplicates"]
    first = {}
    for k in sorted(before):
        first.setdefault(op7_simhash_golay.fingerprint(before[k]), k)
    assert set(after) <= set(first.values()) and len(after) >= 0.9 * len(first)
    # secrets: nobody goes, and no base span is left
    assert set(seen["secrets"]) == set(seen["decontamination"])
    again = op5_secret_scan.report(docs).agg({"n_assign": "sum", "n_access": "sum", "n_hex": "sum"}).first()
    assert sum(again) == 0
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    # packing: every token of every document
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(seen["secrets"])
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    assert op4_packing.LENGTH == 2048


def test_stages_on_nulls_and_empty_tables(spark, sf_dir, documents):
    rows = [(None, None), (1, None), (2, ""), (3, "the words of a text " * 5), (3, "the words of a text " * 5), (4, "9" * 40)]
    for docs in (documents(rows), documents([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns, name
            stage(spark, docs, sf_dir).count()
        assert corpus_pipeline.packing(spark, docs, sf_dir).filter("start = 0").count() == docs.count()
