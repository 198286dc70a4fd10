"""The pipeline as a whole on a small table."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    def prose(i):
        return " ".join(f"Sentence{i} number {k} has words{i}x{k} that only this{i * 7 + k} document holds." for k in range(30))

    near = prose(1).replace("number 17", "number seventeen")
    rows = [(1, prose(1)), (2, prose(2)), (3, prose(2)), (4, near), (5, "too short"), (6, prose(6) + " Call +1 (555) 555-0100."), (7, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = corpus_pipeline.documents(spark, str(tmp_path)), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept.append(sorted({r.doc_id for r in docs.collect()}))
    assert kept == [[1, 2, 3, 4, 6], [1, 3, 4, 6], [1, 3, 6], [1, 3, 6], [1, 3, 6]]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in packed.collect()}) == [1, 3, 6]


def test_stages_take_odd_rows(spark):
    """Each stage on its own: empty tables, null ids and texts, repeated rows and ids, long texts, clashing columns."""
    prose = " ".join(f"Sentence number {k} has words{k} that only this{k * 7} document holds." for k in range(30))
    other, long = prose.replace("Sentence", "Clause").replace("words", "terms"), " ".join(f"Long{k} line{k} of words{k} ends." for k in range(9000))
    rows = [(1, prose), (1, other), (None, prose), (2, long), (2, long), (3, None), (4, ""), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, node string, n_pii string"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in rows], schema)
    texts = {t: n for n, t in enumerate((prose, other, long, "", None))}
    want = {
        "quality_rules": [(1, 0), (1, 1), (None, 0), (2, 2), (2, 2)],
        "exact_dedup": [(1, 0), (1, 1), (2, 2), (4, 3)],
        "simhash_near_dedup": [(1, 0), (1, 1), (2, 2), (3, 4)],
        "pii": [(1, 0), (1, 1), (None, 0), (2, 2), (2, 2), (3, 4), (4, 3), (None, 4)],
    }
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
        made = stage(spark, docs, "")
        if name in want:
            assert made.columns == corpus_pipeline.COLUMNS
            assert sorted(((r.doc_id, texts[r.text]) for r in made.collect()), key=str) == sorted(want[name], key=str)
        else:
            assert made.filter("piece = 0").count() == len(rows)
