"""The stages end to end on the smallest tables, their reports, and the metrics document."""

import pytest

from brasswork.plans import stages
from brasswork.plans.config import Settings

SETTINGS = Settings(horizons=(1,), churn_trees=4, segments=3)


@pytest.fixture(scope="module")
def published(spark, sf, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("stages"))
    every = stages.stages_for(SETTINGS)
    with pytest.raises(stages.StageFailed, match="run the stage forecast first"):
        stages.run_stages(spark, sf, out, ["inventory"], every)
    return out, stages.run_stages(spark, sf, out, stages=every)


def test_all_stages(spark, published):
    out, results = published
    every = stages.stages_for(SETTINGS)
    assert [r.name for r in results] == [s.name for s in every] == ["quality", "precompute", "forecast", "churn", "segmentation", "inventory", "drift"]
    assert all(set(s.outputs) <= set(r.rows) and min(r.rows.values()) > 0 for s, r in zip(every, results, strict=True))
    assert not any(stages.missing_outputs(spark, s, out) for s in every)
    told = {r["stage"]: r for r in stages.reports(spark, results).collect()}
    assert told["churn"]["rows"]["churn_scores"] == told["churn"]["rows"]["churn_scores"] > 0
    assert told["churn"]["findings"]["strongest feature"] and told["segmentation"]["findings"]["largest segment"]
    segments = spark.read.parquet(f"{out}/segmentation/segments").collect()
    assert len({r["segment"] for r in segments}) == len(segments) == 3
    customers = spark.read.parquet(f"{out}/segmentation/customer_segments")
    assert customers.count() == sum(r["customers"] for r in segments)


def test_metrics_document(spark, published):
    out, _ = published
    found = stages.metrics_document(spark, out)
    assert set(found) == {"sources", "forecasting", "churn", "inventory", "segmentation"}
    first = found["forecasting"]["1"]
    assert first["wape"] == min(first["candidates"].values()) and first["candidates"][first["selected_model"]] == first["wape"]
    published_ = spark.read.parquet(f"{out}/churn/churn_metrics").first()
    assert found["churn"]["roc_auc"] == round(published_["roc_auc"], 6) and found["churn"]["meets_roc_auc"] == (published_["roc_auc"] >= 0.8)
    assert found["churn"]["train_rows"] > 0 and set(found["inventory"]["policies"]) == {"mean", "normal", "poisson"}
    assert found["segmentation"]["n_segments"] == len(found["segmentation"]["segments"])
    with pytest.raises(FileNotFoundError):
        stages.metrics_document(spark, out + "/nowhere")


def test_blocks():
    row = {"mape_nonzero": 1.0, "mae": 1.0, "rmse": 1.0, "bias": 0.0}
    tried = [{"model": m, "horizon": h, "wape": w, **row} for m, h, w in (("a", 1, 0.3), ("b", 1, 0.2), ("a", 2, 0.1), ("c", 2, None))]
    block = stages.forecast_block(tried, [{"horizon": 1, "model": "a"}, {"horizon": 2, "model": "gone"}])
    assert block["1"]["selected_model"] == "a" and block["1"]["candidates"] == {"a": 0.3, "b": 0.2}
    assert block["2"]["selected_model"] == "a" and list(block["2"]["candidates"]) == ["a"]
    assert stages.churn_block([{"roc_auc": None, "precision_at_k": 0.71}])["meets_roc_auc"] is False
    assert stages.inventory_block([{"policy": "x", "error": 1}], [])["policies"] == {"x": {"policy": "x", "error": 1}}
