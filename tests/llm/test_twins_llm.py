"""The package's queries against their SQL, and the pipeline's stages, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from compare import compare, duck  # noqa: E402

import corpus_pipeline  # noqa: E402
from fieldtally.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_twin(spark, folder, name):
    _, problem, _ = compare(spark, duck(folder), folder, name, queries.queries()[name], queries.sql()[name])
    assert problem is None, problem


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out[0].asDict()) and 0 < len(out) < 2 * docs.count()
    assert len(corpus_pipeline.STAGES) == 5 and not any("@mail" in (r["text"] or "") for r in out)
