"""Named stages in a fixed order, what each must leave behind, and a document of their results."""

from __future__ import annotations

import argparse
import functools
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswork.operators import boosting, checks, churn, drift, features, forecast, inventory, quality, rollup, segmentation, trees
from brasswork.plans.config import Settings, load
from brasswork.session import cut
from brasswork.sources import files, star

Tables = dict[str, DataFrame]


@dataclass
class Stage:
    """run gets the session, the folder of the tables, and by `published` those tables of earlier stages that `needs` names."""

    name: str
    run: Callable[..., Tables]
    outputs: tuple[str, ...]
    needs: tuple[tuple[str, str], ...] = ()


@dataclass
class StageResult:
    name: str
    seconds: float
    tables: list[str] = field(default_factory=list)
    rows: dict[str, int] = field(default_factory=dict)
    findings: dict[str, str] = field(default_factory=dict)


class StageFailed(RuntimeError):
    """A stage raised, or left a table missing or empty."""

    def __init__(self, name: str, reason: str):
        super().__init__(f"{name}: {reason}")
        self.name, self.reason = name, reason


def _precompute(spark: SparkSession, sf_dir: str, settings: Settings) -> Tables:
    sales = star.sales(spark, sf_dir)
    return {"kpis": rollup.kpis(sales), "revenue_by_week": rollup.weekly_revenue(sales), "sku_mix": rollup.sku_mix(sales), "_unpublished": rollup.facts(sales)}


def _forecast(spark: SparkSession, sf_dir: str, settings: Settings) -> Tables:
    series = forecast.build_series(star.panel(spark, sf_dir))
    scores = cut(forecast.backtest(series, horizons=settings.horizons))
    selected = forecast.select_models(scores)
    return {"forecast_backtest": scores, "forecast_selection": selected, "forecast_paths": forecast.forecast_paths(series, selected)}


def _quality(spark: SparkSession, sf_dir: str, settings: Settings) -> Tables:
    """What the contract finds in the sales, a summary of the lines, and the statistical checks; campaign days are those of mostly promoted lines."""
    sales = star.sales(spark, sf_dir)
    rules = {k: v for k, v in quality.sales_rules().items() if k in ("sales_amount", "discount_over_price", "negative_quantity")}
    return {
        "contract": quality.contract_rows(sales, sales.columns, rules),
        "checks": checks.statistical_checks(sales, F.col("promo") >= settings.campaign_share * F.col("lines")),
    }


def _churn(spark: SparkSession, sf_dir: str, settings: Settings) -> Tables:
    """Snapshots, a model of the first of them, and what it says of the others."""
    snapshots = cut(features.churn_snapshots(star.purchases(spark, sf_dir), settings.snapshots(), settings.window_days, settings.label_days))
    train, test = churn.temporal_split(snapshots, settings.train_snapshots)
    model = boosting.fit_boosted(train, churn.MODEL_FEATURES, settings=boosting.Settings(trees=settings.churn_trees))
    scores = cut(trees.scored(model, test, ("customer_id", "snapshot_date", "churn")))
    sides = [frame.agg(F.count("*").alias(f"{n}_rows"), F.round(F.avg("churn"), 4).alias(f"{n}_base_rate")) for n, frame in (("train", train), ("test", test))]
    metrics = churn.evaluate(scores, settings.top_share)
    for side in sides:
        metrics = metrics.crossJoin(F.broadcast(side))  # a row each
    return {
        "churn_snapshots": snapshots, "churn_scores": scores, "churn_metrics": metrics,
        "churn_reasons": churn.local_reasons(model, test), "churn_importance": churn.global_importance(model, test),
    }


def _segmentation(spark: SparkSession, sf_dir: str, settings: Settings) -> Tables:
    """Clusters of the customers of the last snapshot who bought, and their names."""
    customers = features.rfm_features(star.purchases(spark, sf_dir), settings.snapshots()[-1:], settings.window_days, include_unconverted=False)
    clustered = segmentation.fit_clusters(customers, k=settings.segments)
    named = cut(segmentation.name_segments(clustered))
    told = clustered.join(F.broadcast(named.select("cluster", "segment")), "cluster")  # a row for each cluster
    return {"segments": named, "segment_summary": segmentation.segment_summary(told), "customer_segments": told.select("customer_id", "cluster", "segment")}


def _inventory(spark: SparkSession, sf_dir: str, settings: Settings, published: Tables) -> Tables:
    """The plan follows the published forecast of the next week."""
    panel = star.panel(spark, sf_dir)
    plan = inventory.reorder_plan(panel, inventory.first_week(published["forecast_paths"]), settings.lead_weeks)
    replayed = cut(inventory.replay(panel, settings.replay_weeks, settings.lead_weeks))
    return {"reorder_plan": plan, "replay": replayed, "replay_reduction": inventory.error_reduction(replayed), "replay_totals": inventory.policy_totals(replayed)}


def _drift(spark: SparkSession, sf_dir: str, settings: Settings) -> Tables:
    both = drift.split_periods(star.panel(spark, sf_dir), settings.reference_year, settings.current_year)
    return {"drift": drift.report(both, settings.drift_numeric, settings.drift_categorical)}


def stages_for(settings: Settings) -> tuple[Stage, ...]:
    own = lambda run: functools.partial(run, settings=settings)
    return (
        Stage("quality", own(_quality), ("contract", "checks")),
        Stage("precompute", own(_precompute), ("kpis", "revenue_by_week", "sku_mix")),
        Stage("forecast", own(_forecast), ("forecast_backtest", "forecast_selection", "forecast_paths")),
        Stage("churn", own(_churn), ("churn_snapshots", "churn_scores", "churn_metrics", "churn_reasons", "churn_importance")),
        Stage("segmentation", own(_segmentation), ("segments", "segment_summary", "customer_segments")),
        Stage("inventory", own(_inventory), ("reorder_plan", "replay", "replay_reduction", "replay_totals"), (("forecast", "forecast_paths"),)),
        Stage("drift", own(_drift), ("drift",)),
    )


STAGES = stages_for(Settings())


def _read(spark: SparkSession, out_dir: str, stage: str, name: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{out_dir}/{stage}/{name}")
    except AnalysisException as e:
        raise FileNotFoundError(f"{stage}/{name}: run the stage {stage} first") from e


def missing_outputs(spark: SparkSession, stage: Stage, out_dir: str) -> list[str]:
    """Tables of a stage that can't be read or have no row."""
    missing = []
    for name in stage.outputs:
        try:
            if not spark.read.parquet(f"{out_dir}/{stage.name}/{name}").limit(1).count():
                missing.append(name)
        except Exception:  # any failure to read means that the table isn't there
            missing.append(name)
    return missing


#: What a stage's report tells beside its rows: names, and how each is told from the published tables, in one row.
FINDINGS: dict[str, dict[str, Callable[[Tables], DataFrame]]] = {
    "quality": {
        "rules broken": lambda t: t["contract"].where("not holds").agg(F.concat_ws(", ", F.array_sort(F.collect_list("finding")))),
        "checks below their bounds": lambda t: t["checks"].where("not coalesce(holds, false)").agg(F.concat_ws(", ", F.array_sort(F.collect_list("measure")))),
    },
    "forecast": {"models": lambda t: t["forecast_selection"].agg(F.concat_ws(", ", F.array_sort(F.collect_list(F.concat_ws(" ", "horizon", "model")))))},
    "churn": {"area under the curve": lambda t: t["churn_metrics"].agg(F.max("roc_auc")), "strongest feature": lambda t: t["churn_importance"].agg(F.max_by("feature", "importance"))},
    "segmentation": {"largest segment": lambda t: t["segments"].agg(F.max_by("segment", "customers"))},
    "inventory": {"orders": lambda t: t["reorder_plan"].agg(F.count_if("reorder")), "error reduction": lambda t: t["replay_reduction"].agg(F.max("reduction_pct"))},
    "drift": {"columns": lambda t: t["drift"].agg(F.count("*"))},
}


def run_stage(spark: SparkSession, stage: Stage, sf_dir: str, out_dir: str) -> StageResult:
    """Runs a stage, publishes its tables, and reads them for its report. Raises StageFailed if it fails or leaves a table missing or empty."""
    began = time.time()
    try:
        given = {"published": {name: _read(spark, out_dir, other, name) for other, name in stage.needs}} if stage.needs else {}
        tables = stage.run(spark, sf_dir, **given)
        for name, frame in tables.items():
            if not name.startswith("_"):
                files.write_table(frame, f"{out_dir}/{stage.name}/{name}")
    except Exception as e:
        raise StageFailed(stage.name, str(e)[-500:]) from e
    missing = missing_outputs(spark, stage, out_dir)
    if missing:
        raise StageFailed(stage.name, f"missing or empty: {', '.join(missing)}")
    names = sorted(t for t in tables if not t.startswith("_"))
    left = {name: _read(spark, out_dir, stage.name, name) for name in names}
    findings = {told: str(plain(find(left).first()[0])) for told, find in FINDINGS.get(stage.name, {}).items()} if set(stage.outputs) <= set(left) else {}
    return StageResult(stage.name, time.time() - began, names, {name: frame.count() for name, frame in left.items()}, findings)


def run_stages(spark: SparkSession, sf_dir: str, out_dir: str, only: Sequence[str] = (), stages: Sequence[Stage] = STAGES, progress: Callable[[StageResult], None] | None = None) -> list[StageResult]:
    """Runs stages in order and stops at the first that fails; progress is told each result as it comes."""
    unknown = set(only) - {s.name for s in stages}
    if unknown:
        raise ValueError(f"no such stages: {sorted(unknown)}")
    results = []
    for stage in stages:
        if not only or stage.name in only:
            results.append(run_stage(spark, stage, sf_dir, out_dir))
            if progress is not None:
                progress(results[-1])
    return results


def reports(spark: SparkSession, results: Sequence[StageResult]) -> DataFrame:
    """stage, seconds, tables, rows (by table), findings: what ran and what came of it, as a frame that can be published."""
    rows = [(r.name, round(r.seconds, 3), r.tables, r.rows, r.findings) for r in results]
    return spark.createDataFrame(rows, "stage string, seconds double, tables array<string>, rows map<string, long>, findings map<string, string>")


def plain(value: object) -> object:
    """A value for JSON: null for what isn't finite, six decimals, texts for dates."""
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else None
    if isinstance(value, (int, str, bool)) or value is None:
        return value
    return str(value)


#: A document is for small tables; a larger one is refused, not cut.
MAX_ROWS = 10_000


def document(spark: SparkSession, out_dir: str, tables: Sequence[tuple[str, str]]) -> dict:
    """Small published tables as lists of rows, by stage and name.

    Raises FileNotFoundError if one can't be read, ValueError if one has more than MAX_ROWS rows.
    """
    found: dict = {}
    for stage, name in tables:
        try:
            rows = spark.read.parquet(f"{out_dir}/{stage}/{name}").limit(MAX_ROWS + 1).collect()
        except Exception as e:
            raise FileNotFoundError(f"{stage}/{name}: run the stage {stage} first") from e
        if len(rows) > MAX_ROWS:
            raise ValueError(f"{stage}/{name} has more than {MAX_ROWS} rows")
        found.setdefault(stage, {})[name] = [{k: plain(v) for k, v in r.asDict().items()} for r in rows]
    return found


#: What the metrics are held against.
TARGETS = {"roc_auc": 0.80, "precision_at_k": 0.70, "reduction_pct": (25, 40)}
#: Published tables that the metrics document is made of.
SOURCES = (("forecast", "forecast_backtest"), ("forecast", "forecast_selection"), ("churn", "churn_metrics"), ("inventory", "replay_reduction"), ("inventory", "replay_totals"), ("segmentation", "segment_summary"))


def forecast_block(backtest: list[dict], selection: list[dict]) -> dict:
    """By horizon: the selected model with its metrics, and all candidates; a selection that wasn't tried gives way to the best that was."""
    chosen = {r["horizon"]: r["model"] for r in selection}
    out = {}
    for horizon in sorted({r["horizon"] for r in backtest}):
        tried = [r for r in backtest if r["horizon"] == horizon and r["wape"] is not None]
        if tried:
            picked = min(tried, key=lambda r: (r["model"] != chosen.get(r["horizon"]), r["wape"], r["model"]))
            out[str(horizon)] = {"selected_model": picked["model"], **{k: picked[k] for k in ("wape", "mape_nonzero", "mae", "rmse", "bias")}, "candidates": {r["model"]: r["wape"] for r in sorted(tried, key=lambda r: r["model"])}}
    return out


def churn_block(metrics: list[dict]) -> dict:
    row = dict(metrics[0])
    targets = {f"target_{k}": TARGETS[k] for k in ("roc_auc", "precision_at_k")}
    return row | targets | {f"meets_{k}": row[k] is not None and row[k] >= TARGETS[k] for k in ("roc_auc", "precision_at_k")}


def inventory_block(reduction: list[dict], totals: list[dict]) -> dict:
    by_policy = {r["policy"]: r for r in totals}
    return {"target_reduction_pct": list(TARGETS["reduction_pct"]), "policies": {r["policy"]: r | by_policy.get(r["policy"], {}) for r in sorted(reduction, key=lambda r: r["policy"])}}


def segment_block(summary: list[dict]) -> dict:
    return {"segments": sorted(summary, key=lambda r: r["segment"]), "n_segments": len(summary), "n_customers": sum(r["customers"] for r in summary)}


def metrics_document(spark: SparkSession, out_dir: str) -> dict:
    """The published numbers by block, copied and never computed anew. Raises FileNotFoundError if a stage hasn't published its table."""
    read = document(spark, out_dir, SOURCES)
    return {
        "sources": [f"{stage}/{name}" for stage, name in SOURCES],
        "forecasting": forecast_block(read["forecast"]["forecast_backtest"], read["forecast"]["forecast_selection"]),
        "churn": churn_block(read["churn"]["churn_metrics"]),
        "inventory": inventory_block(read["inventory"]["replay_reduction"], read["inventory"]["replay_totals"]),
        "segmentation": segment_block(read["segmentation"]["segment_summary"]),
    }


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Runs the stages over a folder of tables.")
    parser.add_argument("tables")
    parser.add_argument("out")
    parser.add_argument("--only", action="append", default=[])
    parser.add_argument("--skip-verify", action="store_true", help="leave out the last check of all outputs")
    parser.add_argument("--config", help="a JSON file of settings")
    given = parser.parse_args(argv)
    from brasswork.session import get_session

    spark = get_session("brasswork stages")
    stages = stages_for(load(spark, given.config)) if given.config else STAGES
    tell = lambda result: print(f"{result.name}: {result.seconds:.1f} s, {', '.join(result.tables)}", flush=True)
    results = run_stages(spark, given.tables, given.out, given.only, stages, progress=tell)
    files.write_table(reports(spark, results), f"{given.out}/stage_reports")
    chosen = [s for s in stages if not given.only or s.name in given.only]
    if not given.only:
        files.write_json(spark, metrics_document(spark, given.out), f"{given.out}/model_metrics")
    missing = {} if given.skip_verify else {s.name: m for s in chosen if (m := missing_outputs(spark, s, given.out))}
    for name, tables in missing.items():
        print(f"{name}: missing {', '.join(tables)}")
    return 1 if missing else 0


if __name__ == "__main__":
    raise SystemExit(main())
