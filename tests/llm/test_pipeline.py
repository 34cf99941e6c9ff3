import corpus_pipeline
from lodestar.llm import decontam, quality, secrets, simhash
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_run_against_brute_force(spark, small):
    import sentencepiece

    from lodestar.llm import pieces

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality.quality(spark.read.parquet(f"{small}/documents.parquet")).where("kept").collect()}
    docs = [d for d in docs if d[0] in good]
    ids = brute_components([brute_fingerprint(t) for _, t in docs], [i for i, _ in docs])
    docs = [d for d, c in zip(docs, ids) if d[0] == c]
    bad = {r[0] for r in brute_hits(docs, items) if r[5]}
    want = {i: sp.encode(secrets.redact(t)) for i, t in docs if i not in bad}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want and bad and len(ids) > len(docs)


def test_stages(spark, edge, none, tmp_path):
    """Every stage but the last gives the columns it was given, whatever the rows hold."""
    path = str(tmp_path)
    spark.createDataFrame([(1, "the same id with another text"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for start in (edge, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == start.columns, name
            assert out.count() <= docs.count()
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "sentencepiece"]
    assert quality and decontam and simhash
