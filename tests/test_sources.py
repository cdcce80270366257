import json

import pytest

from creatorlake.functions.registry import catalog, measured, metric
from creatorlake.sources.records import append_new, collection, flattened, read_videos


def record(ident, curve, mean=50.0):
    return {"video_id": ident, "metadata": {"title": "t", "duration": 30.0}, "analytics": {"avgRetention": mean, "totalViews": 5, "retentionCurve": [{"second": i, "retention": x} for i, x in enumerate(curve)]}}


def test_only_records_with_a_curve_are_read(spark, tmp_path):
    rows = [record("a", [1 - i / 99 for i in range(100)]), record("b", []), record("c", [0.5] * 4), record("d", [1.0], None)]
    (tmp_path / "v.json").write_text("\n".join(map(json.dumps, rows)))
    flat = flattened(read_videos(spark, str(tmp_path / "v.json")))
    assert {r.video_id for r in flat.collect()} == {"a", "c"}
    found = {(r.video_id, r.metric): (r.value, r.reason) for r in measured(flat, "video_id", "curve", ["hook_retention_pct", "retention_mean_0_50", "above_baseline_mean"]).collect()}
    assert found["c", "hook_retention_pct"] == (None, "short_curve")
    assert found["a", "hook_retention_pct"][0] == pytest.approx(1 - 10 / 99) and found["a", "above_baseline_mean"][0] == pytest.approx(0)
    assert catalog(spark).count() == 27
    with pytest.raises(ValueError):
        metric("retention_mean_50_10")


def test_a_collection_takes_each_key_once(spark, tmp_path):
    path = str(tmp_path / "c")
    assert collection(spark, path, "k long, v string").count() == 0
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    append_new(rows, path, "k")
    append_new(rows, path, "k")
    assert collection(spark, path, "k long, v string").count() == 2
