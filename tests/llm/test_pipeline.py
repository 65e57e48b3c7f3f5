"""The pipeline's stages in order, each against brute force on its own input."""

import importlib.util
import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None or not os.path.isdir(SF), reason="no pipeline or tables here")


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    from cambium.llm import ngram_join, quality
    from tests_llm_brute import components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, frames = docs.columns, [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, frames[-1], SF).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(f.columns == cols for f in frames[:5])
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.quality(docs, lab).where("predicted = 1").collect()}
    assert ids[1] == good
    texts = {r.doc_id: r.text for r in frames[1].collect()}
    last = {}
    for i, t in texts.items():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        last[key] = max(i, last.get(key, -1))
    assert ids[2] == set(last.values())
    kept = sorted((i, texts[i]) for i in ids[2])
    assert ids[3] == components(kept, ngram_join.Level(5, 8, 10))
    words = F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    total, mixed = (f.agg(F.sum(words)).first()[0] for f in frames[3:5])
    assert mixed == pytest.approx(1.5 * total, rel=0.001)
    assert frames[5].count() == frames[4].count()
