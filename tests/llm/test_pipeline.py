"""The pipeline's stages one after another, each against what it was given."""

import corpus_pipeline
from verso.llm import quality

from .helpers import empty_docs, hard_docs
from .test_first import check_packing
from .test_near_dup import brute_classes
from .test_text_dedup import brute_lines, brute_spans

DATA = "/root/testdata/sf0.001"


def test_stages_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows = [(r.doc_id, r.text) for r in before.collect()]
        got = [tuple(r)[:2] for r in after.collect()]
        if k < 4:
            assert after.columns == columns
        if name == "quality classifier":
            bad = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 0").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").collect()}
            kept = {i for i, _ in got}
            assert len(kept & bad) <= 1 and len(good - kept) <= 2 and set(got) <= set(rows)
        elif name == "line dedup":
            assert sorted(got, key=str) == brute_lines(rows)
        elif name == "minhash near-dedup":
            classes = brute_classes(sorted(rows))
            assert sorted(got) == sorted((i, t) for i, t in rows if classes[i] == i)
        elif name == "substring dedup":
            assert sorted(got, key=str) == brute_spans(rows)
        else:
            check_packing(after.collect(), rows, 2048)
        before = after


def test_run_on_hard_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "THRESHOLD", 0.0)
    for name, docs in (("hard", hard_docs(spark)), ("empty", empty_docs(spark))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        assert (corpus_pipeline.run(spark, str(tmp_path / name)).count() > 0) == (name == "hard")
