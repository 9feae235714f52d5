"""What the pipeline's executors and workers hold beyond a stage or task."""

import sys
from pathlib import Path

import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from tessera.llm import bpe  # noqa: E402
from tessera.llm.shingles import few_rows  # noqa: E402


def test_other_tasks_let_go_of_the_encoder():
    held = dict(bpe._ENCODERS)
    bpe._ENCODERS["a", "b"] = object()
    assert list(few_rows(iter([]))) == [] and not bpe._ENCODERS
    bpe._ENCODERS.update(held)


def test_batches_of_few_rows(spark, data):
    corpus_pipeline.encode(spark, spark.read.parquet(f"{data}/documents.parquet"), data)

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_pydict({"n": [part.num_rows]})

    assert max(r["n"] for r in spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").collect()) <= 512
