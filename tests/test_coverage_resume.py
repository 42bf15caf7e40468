import json

import pytest

from koine.operators import coverage as cov


def test_a_resumed_loop_keeps_what_was_accepted(spark, tmp_path):
    rows = [(f"c{i:02}", f"s{i % 3}", None, 1.0, None, None, [f"phoneme:{'ab'[i % 2]}"], (True, 0.5, 0.1, 0.0, 0.1), False) for i in range(12)]
    index = spark.createDataFrame(rows, "clip_id string, client_id string, normalized_text string, duration_sec double, up_votes long, down_votes long, feature_keys array<string>, cheap_quality struct<decode_ok:boolean,peak:double,rms:double,clipping_ratio:double,silence_ratio:double>, invalidated boolean")
    schema = "feature string, minimum long, desired long, required boolean, weight double"
    targets = spark.createDataFrame(cov.target_rows({"phoneme:a": 6, "phoneme:b": 6}), schema)  # all clips are needed
    analyze = lambda batch: batch.selectExpr("clip_id", "true as passed")
    config, path = cov.PlannerConfig(min_batch=4, max_batch=4), tmp_path / "s.json"
    half = cov.run_loop(index, targets, analyze, str(path), cov.LoopLimits(max_iterations=1), config=config)
    assert half.stop == "iteration_limit_reached" and 0 < len(half.accepted) < 12 and sorted(half.accepted) == sorted(half.analyzed)
    state = cov.run_loop(index, targets, analyze, str(path), config=config)
    assert state.stop == "complete" and len(state.accepted) == len(set(state.analyzed)) == 12
    fewer = spark.createDataFrame(cov.target_rows({"phoneme:a": 5}), schema)
    for args in ((index.where("clip_id <> 'c03'"), targets), (index, fewer)):
        with pytest.raises(ValueError):
            cov.run_loop(*args, analyze, str(path), config=config)
    old = json.loads(path.read_text())
    path.write_text(json.dumps(old | {"accepted": []}))
    with pytest.raises(ValueError):
        cov.run_loop(index, targets, analyze, str(path), config=config)
