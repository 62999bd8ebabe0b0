"""What the pipeline's Python stages hold outside of the JVM's heap."""

import gc
import weakref
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import common, packing, quality, simhash

MOST = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("stage", ["quality_filter", "near_duplicates", "packed"])
def test_stages_bound_arrow_batches_by_bytes(spark, monkeypatch, stage):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    for module, name in ((quality, "train"), (quality, "keep"), (simhash, "representatives"), (packing, "pack")):
        monkeypatch.setattr(module, name, lambda docs, *_: docs.mapInArrow(sizes, "n long, size long"))
    docs = spark.range(0, 900, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 2000).alias("text"))
    spark.conf.unset(MOST)
    try:
        got = getattr(corpus_pipeline, stage)(spark, docs, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.unset(MOST)
    assert sum(r["n"] for r in got) == 900
    assert len(got) > 1 and max(r["size"] for r in got) < common.BATCH_BYTES + 2 * 22_000


def test_a_lower_bound_stays(spark):
    try:
        spark.conf.set(MOST, "1m")
        common.small_batches(spark)
        assert spark.conf.get(MOST) == "1m"
    finally:
        spark.conf.unset(MOST)


def test_an_encoder_is_gone_when_its_task_ends(monkeypatch):
    made = []

    class Encoder(packing.Encoder):
        def __init__(self, vocabulary):
            super().__init__(vocabulary)
            made.append(weakref.ref(self))

    monkeypatch.setattr(packing, "Encoder", Encoder)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    work = []
    packing.pack(SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: work.append(run))))
    gc.disable()
    try:
        rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["Two words.", None])], ["doc_id", "text"])
        out = list(work[0](iter([rows])))
        assert sum(b.num_rows for b in out) == 2 and len(made) == 1 and made[0]() is None
    finally:
        gc.enable()
