"""The object interface, manifests and the stream."""

import os
import shutil

import pytest

from stateloom.api import StateConfig, StateFrame, reproduce
from stateloom.streaming.counts import event_stream, windowed_counts

SPEC = """
entities:
  - {kind: eoa, name: alice, balance: "0x10"}
  - {kind: contract, template: storage_pattern, name: p, parameters: {final: 20}}
  - {kind: eoa, name: bob, approximate_size_bytes: 1400}
"""


def test_manifest_round_trip(spark, tmp_path):
    frame = StateFrame(spark, SPEC, StateConfig(seed=7))
    path = frame.record(str(tmp_path))
    assert reproduce(spark, path)
    frame.write(str(tmp_path / "out"), "flat")
    assert spark.read.parquet(str(tmp_path / "out/storage")).count() == 31
    assert len(StateFrame(spark, SPEC, StateConfig(target_size=360)).entities) == 2
    sidecar = next(f for f in os.listdir(tmp_path) if f.startswith("spec-"))
    (tmp_path / sidecar).write_text("entities: []")
    with pytest.raises(ValueError, match="differs"):
        reproduce(spark, path)


def test_stream_equals_batch(spark, sf, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    shutil.copy(f"{sf}/events.parquet", folder / "a.parquet")
    counts = windowed_counts(event_stream(spark, str(folder)), "1 hour")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("counts").exceptAll(windowed_counts(spark.read.parquet(str(folder)), "1 hour")).count() == 0
    assert spark.table("counts").count() > 0
