import corpus_pipeline
from spanforge.llm import decontaminate, neardup, pii
from spanforge.llm.common import table as read
from tests.llm.common import DATA, awkward


def test_stages_and_run(spark, tmp_path):
    """run() equals its stages one by one; each keeps what its operator says."""
    docs = read(spark, DATA, "documents")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held[-1], DATA)
        path = str(tmp_path / name)
        out.write.parquet(path)
        held.append(spark.read.parquet(path))
    assert all(h.columns == docs.columns for h in held[:-1])
    ids = [sorted(r.doc_id for r in h.select("doc_id").collect()) for h in held[:-1]]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:])) and ids[3] == ids[4]
    assert len(ids[0]) * 0.5 < len(ids[1]) < len(ids[0])
    assert set(ids[2]) == {r.doc_id for r in neardup.classes(held[1]).collect() if r.is_representative}
    bad = {r.doc_id for r in decontaminate.contaminated(held[2], read(spark, DATA, "benchmark")).collect()}
    assert bad and set(ids[3]) == set(ids[2]) - bad
    assert pii.digests(held[4]).where("n_email > 0 or n_phone > 0 or n_card > 0 or n_ip > 0").count() == 0
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in held[5].collect())


def test_awkward_documents(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() > 0


def test_empty_documents(spark):
    docs = awkward(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
