"""Settings of the stages, from defaults or a JSON file."""

from __future__ import annotations

import dataclasses
import datetime
from dataclasses import dataclass

from pyspark.sql import SparkSession

from brasswork.functions.dates import month_ends
from brasswork.operators.forecast import HORIZONS, SEASON
from brasswork.sources.files import read_json


@dataclass(frozen=True)
class Settings:
    """What a run of the stages depends on besides its tables."""

    first_snapshot: str = "2000-08-01"
    last_snapshot: str = "2001-04-30"
    window_days: int = 90
    label_days: int = 90
    train_snapshots: int = 6
    churn_trees: int = 300
    top_share: float = 0.2
    segments: int = 6
    campaign_share: float = 0.95
    horizons: tuple[int, ...] = HORIZONS
    season: int = SEASON
    replay_weeks: int = 13
    lead_weeks: float = 1.0
    reference_year: int = 1999
    current_year: int = 2000
    drift_numeric: tuple[str, ...] = ("units_sold", "on_hand_end")
    drift_categorical: tuple[str, ...] = ("product_category",)

    def __post_init__(self):
        for name in ("window_days", "label_days", "season", "replay_weeks", "lead_weeks", "train_snapshots", "churn_trees", "top_share", "segments"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not self.horizons or min(self.horizons) < 1 or max(self.horizons) > self.season:
            raise ValueError("horizons must lie between 1 and a season")

    def snapshots(self) -> list[datetime.date]:
        """Month ends from the first to the last snapshot day."""
        return month_ends(self.first_snapshot, self.last_snapshot)


def load(spark: SparkSession, path: str) -> Settings:
    """Settings of a JSON object in any folder that Spark reads; raises ValueError for names that aren't known."""
    row = read_json(spark, path).first()
    given = row.asDict() if row is not None else {}
    unknown = set(given) - {f.name for f in dataclasses.fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
