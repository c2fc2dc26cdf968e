"""The pipeline's stages: columns, decisions, and what each leaves alone."""

import __spark_entry__ as contract
import corpus_pipeline
from scanlytics.llm import stages
from scanlytics.llm.common import table


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "bpe"]
    names = set(contract.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_pipeline(spark, folder):
    documents = table(spark, folder, "documents")
    docs, left = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == documents.columns
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert left[0] > left[1] >= left[2] == left[3]
    # deciding again on what is left finds nothing more to do, but for the trained stages
    assert stages.near_duplicates(spark, docs, folder).count() == len(left[1] & left[2])
    assert stages.decontaminate(spark, docs, folder).count() == len(left[2])
    final = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in final.collect()} == left[3]
