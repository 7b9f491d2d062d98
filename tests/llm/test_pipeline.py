"""The corpus pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
from tests.llm.test_copies import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, docs_of, items):
    docs = docs_of(items)
    stages = dict(pipeline.STAGES)
    once = stages["exact_dedup"](spark, docs, SF)
    assert once.columns == docs.columns
    kept = [(r["doc_id"], r["text"], r["source"]) for r in once.collect()]
    assert Counter(t or "" for _, t, _ in kept) == Counter({t or "": 1 for _, t, _ in items})
    groups = Counter(c for _, n, c in brute_components(kept).elements() if n)
    near = stages["ngram_jaccard"](spark, once, SF)
    assert near.columns == docs.columns
    left = Counter(c for _, n, c in brute_components([(r["doc_id"], r["text"], r["source"]) for r in near.collect()]).elements() if n)
    assert set(left) == set(groups) and set(left.values()) == {1}
    mixed = stages["source_mixing"](spark, near, SF)
    assert mixed.columns == docs.columns
    out = stages["sentencepiece"](spark, mixed, SF)
    assert out.count() == mixed.count() and out.where("not round_trip").count() == 0


def test_run(spark):
    out = pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < out.count() <= 3 * n
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "source_mixing", "sentencepiece"]
