"""Fixture B3: the mart scored by a fixed logistic scorecard.

Inputs: standardised numeric features and three one-hot dummies, with literal
coefficients, so the DuckDB oracle reproduces every score.  The same
``Scorecard`` builds the expression for scoring and for what-if rescoring
(any input replaced by a scenario value), in Spark and in SQL.  Scores are
rounded half-up to 10 places so both engines see identical values and ties.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up, sql_round_half_up
from ..sources.derived import DERIVED
from .mart import MART_SQL, MART_TABLES, build_mart, cached
from .sqlgen import d

# scorecard of the fixture: intercept, weights per standardised feature,
# weights per (category column, level) dummy
INTERCEPT = -1.4
NUMERIC_WEIGHTS = {
    "days_since_last_order": 1.2,
    "order_count": -0.6,
    "tenure_days": -0.3,
    "total_revenue": -0.2,
    "complaint_ratio": 0.3,
    "avg_discount": 0.1,
    "urgent_share": 0.1,
    "account_balance": -0.05,
}
DUMMY_WEIGHTS = {
    ("segment", "BUILDING"): 0.15,
    ("segment", "MACHINERY"): -0.10,
    ("main_priority", "1-URGENT"): 0.05,
}
CATEGORY_COLUMNS = ["segment", "main_priority"]


def dummy_name(col: str, level: str) -> str:
    return f"{col}_{level}"


@dataclass
class Scorecard:
    mean: dict[str, float]
    std: dict[str, float]

    def logit(self, val: dict[str, Column]) -> Column:
        out = F.lit(INTERCEPT)
        for c, w in NUMERIC_WEIGHTS.items():
            z = (val[c] - F.lit(self.mean[c])) / F.lit(self.std[c])
            out = out + F.lit(w) * F.coalesce(z, F.lit(0.0))
        for (c, lv), w in DUMMY_WEIGHTS.items():
            out = out + F.lit(w) * F.coalesce((val[c] == F.lit(lv)).cast("double"), F.lit(0.0))
        return out

    def prob(self, val: dict[str, Column]) -> Column:
        return round_half_up(F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit(val))), 10)

    def z(self, c: str, x: Column) -> Column:
        return F.coalesce((x - F.lit(self.mean[c])) / F.lit(self.std[c]), F.lit(0.0))


class ScorecardStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The scorecard as a pipeline stage: adds ``score``; saved and loaded like any model."""

    card = Param(Params._dummy(), "card", "means and deviations as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, card: str = "{}"):
        super().__init__()
        self._setDefault(card="{}")
        self._set(card=card)

    @staticmethod
    def of(card: Scorecard) -> ScorecardStage:
        return ScorecardStage(card=json.dumps(asdict(card)))

    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = Scorecard(**json.loads(self.getOrDefault(self.card)))
        return df.withColumn("score", fitted.prob(
            {c: F.col(c) for c in list(NUMERIC_WEIGHTS) + CATEGORY_COLUMNS}))


def fit_scorecard(mart: DataFrame) -> Scorecard:
    st = mart.agg(*[F.avg(c).alias(f"m_{c}") for c in NUMERIC_WEIGHTS],
                  *[F.stddev_samp(c).alias(f"s_{c}") for c in NUMERIC_WEIGHTS]).first()
    return Scorecard({c: st[f"m_{c}"] for c in NUMERIC_WEIGHTS},
                     {c: st[f"s_{c}"] for c in NUMERIC_WEIGHTS})


def scorecard(spark: SparkSession, sf_dir: str) -> Scorecard:
    return DERIVED.get(spark, sf_dir, ("scorecard",), MART_TABLES,
                       lambda: fit_scorecard(build_mart(spark, sf_dir)))


def build_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached(spark, ("scored", sf_dir), lambda: scored_plan(spark, sf_dir))


def scored_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = build_mart(spark, sf_dir)
    card = scorecard(spark, sf_dir)
    vals = {c: F.col(c) for c in list(NUMERIC_WEIGHTS) + CATEGORY_COLUMNS}
    return m.withColumn("score", card.prob(vals))


# ---------------------------------------------------------------- SQL twins
def logit_sql(val: dict[str, str], stats: str = "sc_stats") -> str:
    out = d(INTERCEPT)
    for c, w in NUMERIC_WEIGHTS.items():
        out = f"({out} + {d(w)} * COALESCE(({val[c]} - {stats}.m_{c}) / {stats}.s_{c}, {d(0.0)}))"
    for (c, lv), w in DUMMY_WEIGHTS.items():
        out = f"({out} + {d(w)} * COALESCE(CAST({val[c]} = '{lv}' AS DOUBLE), {d(0.0)}))"
    return out


def prob_sql(val: dict[str, str], stats: str = "sc_stats") -> str:
    return sql_round_half_up(f"{d(1.0)} / ({d(1.0)} + EXP(-{logit_sql(val, stats)}))", 10)


def _scored_sql() -> str:
    stats = ", ".join([f"AVG({c}) AS m_{c}" for c in NUMERIC_WEIGHTS]
                      + [f"STDDEV_SAMP({c}) AS s_{c}" for c in NUMERIC_WEIGHTS])
    vals = {c: f"mart.{c}" for c in list(NUMERIC_WEIGHTS) + CATEGORY_COLUMNS}
    return (f"{MART_SQL},\nsc_stats AS (SELECT {stats} FROM mart),\n"
            f"scored AS (SELECT mart.*, {prob_sql(vals)} AS score FROM mart, sc_stats)")


SCORED_SQL = _scored_sql()
