"""Declared schemas of the raw, feature, prediction and metrics tables, and the feature list."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

TIME = "datetime"
TARGET = "wind_perc"
SPEED = "wind_speed_10m"
TEMPERATURE = "temperature_2m"
PREDICTION = "wind_perc_pred"
BASELINE = "wind_perc_lag_48h"

# Label -> rows, as the feature tables define them. The labels of the rolling
# windows name half their hourly length, and the first two lags are the same shift.
LAG_ROWS = {"30m": 1, "1h": 1, "3h": 3, "24h": 24, "48h": 48}
ROLLING_ROWS = {"3h": 6, "24h": 48, "48h": 96}

_INT, _LONG, _DOUBLE, _STRING = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()
_TIMESTAMP, _DATE = T.TimestampType(), T.DateType()


def struct(fields: Mapping[str, T.DataType]) -> T.StructType:
    """A schema from names and types, in order."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


MIX_ENTRY = struct({"fuel": _STRING, "perc": _DOUBLE, "actual": _DOUBLE})
GENERATION_INTERVAL = struct({"from": _STRING, "generationmix": T.ArrayType(MIX_ENTRY)})
GENERATION_DOCUMENT = struct({"data": T.ArrayType(GENERATION_INTERVAL)})
WEATHER_DOCUMENT = struct(
    {
        "hourly": struct(
            {
                "time": T.ArrayType(_STRING),
                TEMPERATURE: T.ArrayType(_DOUBLE),
                SPEED: T.ArrayType(_DOUBLE),
            }
        )
    }
)

SHARE_SERIES = struct({TIME: _TIMESTAMP, TARGET: _DOUBLE})
WEATHER_SERIES = struct({TIME: _TIMESTAMP, TEMPERATURE: _DOUBLE, SPEED: _DOUBLE})
PREDICTIONS = struct({TIME: _TIMESTAMP, PREDICTION: _DOUBLE})
HISTORY = struct({TIME: _TIMESTAMP, TARGET: _DOUBLE, BASELINE: _DOUBLE})
HOLIDAYS = struct({"day": _DATE, "name": _STRING})
LEARNING_CURVE = struct({"iter": _INT, "rmse": _DOUBLE})
TRAINING_TIME = struct({"iter": _INT, "passed": _LONG, "remaining": _LONG})

HOLDOUT_METRICS = struct(
    {
        "optuna_best_cv_rmse": _DOUBLE,
        "holdout_rmse_perc": _DOUBLE,
        "holdout_mape_perc": _DOUBLE,
        "best_params": T.MapType(_STRING, _STRING),
    }
)
CV_METRICS = struct(
    {
        "mean_mape_perc": _DOUBLE,
        "std_mape_perc": _DOUBLE,
        "mean_rmse_perc": _DOUBLE,
        "std_rmse_perc": _DOUBLE,
        "folds": struct({"mape_perc": T.ArrayType(_DOUBLE), "rmse_perc": T.ArrayType(_DOUBLE)}),
    }
)

CALENDAR_FEATURES = {
    "hour": _INT,
    "dayofweek": _INT,
    "dayofyear": _INT,
    "sin_hour": _DOUBLE,
    "cos_hour": _DOUBLE,
    "sin_dayofyear": _DOUBLE,
    "cos_dayofyear": _DOUBLE,
    "is_holiday": _INT,
}


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns play which part, shared by feature building, training and scoring."""

    time: str = TIME
    target: str = TARGET
    speed: str = SPEED
    weather: tuple[str, ...] = (TEMPERATURE, SPEED)
    keys: tuple[str, ...] = ()
    lag_rows: dict[str, int] = field(default_factory=lambda: dict(LAG_ROWS))
    rolling_rows: dict[str, int] = field(default_factory=lambda: dict(ROLLING_ROWS))
    excluded: tuple[str, ...] = (TIME, "wind_mw", TARGET)
    rated_speed: float = 15.0
    # Inputs that stand for kinds: models mark them as nominal.
    categories: tuple[str, ...] = ("is_holiday",)

    @property
    def target_lags(self) -> list[str]:
        return [f"{self.target}_lag_{label}" for label in self.lag_rows]

    @property
    def speed_lags(self) -> list[str]:
        return [f"wind_speed_lag_{label}" for label in self.lag_rows]

    @property
    def rolling(self) -> list[str]:
        return [
            f"wind_speed_roll_{stat}_{label}"
            for label in self.rolling_rows
            for stat in ("mean", "std")
        ]

    @property
    def inputs(self) -> list[str]:
        """The model inputs, 28 with the default labels and weather columns."""
        lags = [name for pair in zip(self.target_lags, self.speed_lags) for name in pair]
        return [
            *self.weather,
            "wind_speed_v3",
            "wind_speed_v3_clip",
            *lags,
            *self.rolling,
            *CALENDAR_FEATURES,
        ]

    @property
    def predictors(self) -> list[str]:
        """Columns that may not be NULL in a feature row; the target and its lags may."""
        return [self.time, *(c for c in self.inputs if c not in self.target_lags)]

    @property
    def reach(self) -> int:
        """How many earlier rows the widest lag or rolling window looks at."""
        return max([*self.lag_rows.values(), *(n - 1 for n in self.rolling_rows.values())])

    def feature_schema(self) -> T.StructType:
        """Schema of the feature and history tables (keys are added by the caller's tables)."""
        inputs = {name: CALENDAR_FEATURES.get(name, _DOUBLE) for name in self.inputs}
        return struct({self.time: _TIMESTAMP, self.target: _DOUBLE, **inputs})
