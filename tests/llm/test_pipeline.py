"""The pipeline on a small folder, stage by stage."""

import numpy as np


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(300):
        toxic = int(i % 5 == 0)
        body = " ".join(rng.choice(words, 60)) + (" vile nasty" if toxic else "")
        rows.append((i, "A shared header\n" + body, "en", "s", len(body)))
        labels.append((i, 1, toxic))
    rows += [(1000, rows[1][1], "en", "s", 0), (1001, rows[1][1] + " more", "en", "s", 0), (1002, None, "en", "s", 0), (1003, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    seen = []
    for name, stage in pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/out_{name}")
        kept = spark.read.parquet(f"{tmp_path}/out_{name}")
        seen.append((name, kept.count()))
        if name != pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
        if name == "toxicity":
            assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows if i >= 300 or i % 5}
        if name == "line_dedup":
            assert kept.where("text LIKE 'A shared%'").count() == 0
            assert kept.where("text IS NOT NULL AND n_chars <> char_length(text)").count() == 0
        if name == "near_dedup":
            ids = {r.doc_id for r in kept.collect()}
            assert 1 in ids and not {1000, 1001} & ids and {1002, 1003} <= ids
    run = pipeline.run(spark, str(tmp_path))
    assert run.count() == seen[-1][1] and run.columns == kept.columns
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "suffix_array_dedup", "best_fit_packing"]


def test_odd_documents(spark, tmp_path):
    """No rows; null ids, repeated rows; columns with names that the operators use themselves."""
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, n_lines int, n_dropped string, kept_sha256 string, kept boolean, kept_text string, component_id long, score double, slice long, _gone long, _of long, rep long, band long"
    extra = ("en", 7, "x", "y", True, "z", 3, 0.5, 1, 2, 3, 4, 5)
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, words, *extra), (1, words, *extra), (None, words + " more", *extra), (None, None, *extra), (2, "", *extra), (3, words + " other", *extra)]
    for name, made in (("some", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(made, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if made else [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs = kept = spark.read.parquet(f"{at}/documents.parquet")
        for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
            stage(spark, kept, at).write.parquet(f"{at}/{k}")
            kept = spark.read.parquet(f"{at}/{k}")
            assert kept.columns == docs.columns and all(tuple(r)[2:] == extra for r in kept.collect())
        left = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
        if made:  # 3 goes as a near duplicate of 1; of the row without an id only what 1 has too
            assert [x[:2] for x in left] == [(False, 1), (False, 1), (False, 2), (True, 0), (True, 0)]
        assert pipeline.run(spark, at).count() == len(left)
