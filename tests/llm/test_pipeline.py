import duckdb
import pytest

import corpus_pipeline
from hyperslice import llm
from hyperslice.llm import pii

from ..test_queries import SF, TABLES, rows
from .test_corpus import fingerprint, groups, hits


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = llm.QUERIES[name](spark, SF)
    expected = con.execute(llm.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, expected.fetchall())


def test_stages_against_brute_force(spark):
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns and 0.5 < kept.count() / docs.count() < 1
    before = sorted(kept.collect(), key=lambda r: r.doc_id)
    fps = np.array([fingerprint(r.text) for r in before], np.int64).view(np.uint64)
    expected = sorted({before[g].doc_id for g in groups(fps)})
    one = stage["near_dedup"](spark, kept, SF)
    assert sorted(r.doc_id for r in one.collect()) == expected
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stage["decontamination"](spark, one, SF)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in one.collect() if not hits(r.text, items)[1])
    private = stage["pii"](spark, clean, SF)
    assert private.columns == docs.columns
    texts = {r.doc_id: r for r in private.collect()}
    for r in pii.pseudonymise(clean, key=pii.SYNTHETIC_KEY).collect():
        assert texts[r.doc_id].text == r.text and texts[r.doc_id].n_chars == len(r.text)
        assert not any(p.original in r.text for p in r.private if len(p.original) > 8)


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() > 50


def test_awkward_documents_through_all_stages(spark, awkward, tmp_path, benchmark):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (awkward, awkward.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        awkward_names = [stage(spark, docs, str(tmp_path)).count() for _, stage in corpus_pipeline.STAGES]
        assert len(awkward_names) == 5
