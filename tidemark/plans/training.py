"""Training: split, baseline, preparation, models, promotion gates and retraining decisions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.quality import medians
from tidemark.sources.paths import exists
from tidemark.sources.registry_log import PRODUCTION, STAGING, Lease, Registry

TRAINER_NUMERIC = ("event_count", "demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_roll_3h", "demand_roll_24h", "temperature_c", "humidity_pct", "precip_mm")
#: The worker's list also has the target; both are kept as they are.
WORKER_NUMERIC = ("total_demand", *TRAINER_NUMERIC)
CYCLIC = ("hour_sin", "hour_cos", "dow_sin", "dow_cos")
TARGET = "total_demand"


def split(mart: DataFrame, val_days: int) -> tuple[DataFrame, DataFrame]:
    """Training rows strictly before the last `val_days` days, and the rest."""
    last = mart.agg(F.max("hour_ts")).first()[0]
    if last is None:
        return mart, mart
    cut = F.lit(last - timedelta(days=val_days)).cast("timestamp_ntz")
    return mart.where(F.col("hour_ts") < cut), mart.where(F.col("hour_ts") >= cut)


def metrics(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """mae, rmse and mape of two columns."""
    gap = F.col(actual) - F.col(predicted)
    return rows.agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap) / F.greatest(F.abs(F.col(actual)), F.lit(1e-8))).alias("mape"))


def naive(train: DataFrame, val: DataFrame) -> DataFrame:
    """`val` with prediction: demand a day before, or the training median (0 if there is none)."""
    median = medians(train, TARGET)[TARGET] or 0.0
    return val.withColumn("prediction", F.coalesce("demand_lag_24h", F.lit(median)))


@dataclass(frozen=True)
class Preparation:
    """Fitted medians, means and deviations (of the population), the commonest city and the cities in order.

    It is only ever fitted by `fit_preparation`, so that serving cannot fit it anew.
    """

    numeric: tuple[str, ...]
    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]
    city: str
    cities: tuple[str, ...] = field(default=())

    def columns(self) -> list[Column]:
        """Numeric z-scores, cyclic, one 0/1 column a city (none for an unknown one), is_holiday; in this order."""
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.numeric}
        z = [((filled[c] - F.lit(self.means[c])) / F.lit(self.deviations[c] or 1.0)).alias(f"z_{c}") for c in self.numeric]
        city = F.coalesce("city", F.lit(self.city))
        return [*z, *[F.col(c) for c in CYCLIC], *[(city == n).cast("double").alias(f"city_{n}") for n in self.cities], F.col("is_holiday").cast("int").cast("double").alias("is_holiday")]

    def transform(self, rows: DataFrame, keep: tuple[str, ...] = ("hour_ts", TARGET)) -> DataFrame:
        return rows.select(*[F.col(k).alias(f"key_{k}") for k in keep], *self.columns())


def fit_preparation(rows: DataFrame, numeric: tuple[str, ...] = TRAINER_NUMERIC) -> Preparation:
    """Medians first, then moments of the filled columns as a one-row aggregate; and a row a city."""
    middle = {c: m if m is not None else 0.0 for c, m in medians(rows, *numeric).items()}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c])) for c in numeric}
    second = rows.agg(*[F.avg(filled[c]).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(filled[c]).alias(f"s_{c}") for c in numeric]).first()
    cities = rows.where("city IS NOT NULL").groupBy("city").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city").collect()
    return Preparation(numeric, middle, {c: second[f"m_{c}"] or 0.0 for c in numeric}, {c: second[f"s_{c}"] or 0.0 for c in numeric}, cities[0]["city"] if cities else "", tuple(sorted(r["city"] for r in cities)))


def fit_once(rows: DataFrame, path: str, numeric: tuple[str, ...] = TRAINER_NUMERIC) -> Preparation:
    """The preparation kept at a path; fitted on `rows` and kept there only if there is none yet."""
    spark = rows.sparkSession
    if not exists(spark, path):
        prep = fit_preparation(rows, numeric)
        kept = spark.createDataFrame([(json.dumps(asdict(prep)),)], "preparation string").coalesce(1)
        kept.write.mode("ignore").text(path)
    kept = json.loads(spark.read.text(path).first()[0])
    return Preparation(tuple(kept["numeric"]), kept["medians"], kept["means"], kept["deviations"], kept["city"], tuple(kept["cities"]))


def complete_scaler(rows: DataFrame, columns: tuple[str, ...]) -> tuple[dict[str, float], dict[str, float]]:
    """Means and population deviations over rows in which all columns are there."""
    r = rows.dropna(subset=list(columns)).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: r[f"m_{c}"] for c in columns}, {c: r[f"s_{c}"] for c in columns}


def scaled(rows: DataFrame, means: dict[str, float], deviations: dict[str, float]) -> DataFrame:
    """z-scores where all columns are there; other rows as they are."""
    there = F.lit(True)
    for c in means:
        there = there & F.col(c).isNotNull()
    return rows.withColumns({c: F.when(there, (F.col(c) - F.lit(means[c])) / F.lit(deviations[c] or 1.0)).otherwise(F.col(c)) for c in means})


def _assembled(rows: DataFrame, prep: Preparation) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    ready = prep.transform(rows.where(F.col(TARGET).isNotNull()), ("city", "hour_ts", TARGET))
    inputs = [c for c in ready.columns if not c.startswith("key_")]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(ready).withColumn("label", F.col(f"key_{TARGET}").cast("double"))


def fit_ridge(train: DataFrame, prep: Preparation, alpha: float = 1.0):
    """Least squares with an L2 penalty of `alpha` on the sum of squares."""
    from pyspark.ml.regression import LinearRegression

    rows = _assembled(train, prep)
    r = rows.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
    return LinearRegression(elasticNetParam=0.0, regParam=alpha / r["n"] * (r["s"] or 1.0), standardization=False, solver="normal").fit(rows)


#: Inputs of the boosted trees; nulls stay nulls.
BOOSTED = (*TRAINER_NUMERIC, *CYCLIC, "is_holiday", "city_code")


def with_city_code(rows: DataFrame, cities: list[str]) -> DataFrame:
    """`rows` with the city's place in `cities`, from 0; -1 for others."""
    return rows.withColumn("city_code", F.coalesce(F.array_position(F.array(*[F.lit(c) for c in cities]).cast("array<string>"), F.col("city")), F.lit(0)) - 1)


def boosted(train: DataFrame, val: DataFrame, how: boosting.Boosting = boosting.Boosting()) -> DataFrame:
    """city, hour_ts, actual and prediction of `val` by boosted trees (`operators.boosting`) of `train`."""
    cities = [r.city for r in train.where("city IS NOT NULL").select("city").distinct().orderBy("city").collect()]  # a row a city
    model = boosting.fit(with_city_code(train, cities), BOOSTED, TARGET, how)
    rows = with_city_code(val.where(F.col(TARGET).isNotNull()), cities).withColumn("actual", F.col(TARGET).cast("double"))
    return model.transform(rows, ["city", "hour_ts", "actual"])


def predicted(model, rows: DataFrame, prep: Preparation) -> DataFrame:
    """city, hour_ts, actual and prediction."""
    return model.transform(_assembled(rows, prep)).select(F.col("key_city").alias("city"), F.col("key_hour_ts").alias("hour_ts"), F.col("label").alias("actual"), "prediction")


def best(candidates: dict[str, float]) -> str:
    """The fitted model with the lowest validation error; the baseline never stands."""
    fitted = {n: e for n, e in candidates.items() if n != "baseline"}
    return min(fitted, key=lambda n: (fitted[n], n))


#: Features whose stability is asked for before promotion, and the limit.
GATE_FEATURES, GATE_PSI = ("temperature_c", "humidity_pct", "precip_mm", "city"), 0.25


def line(train: DataFrame, feature: str) -> dict:
    """Parameters of the least-squares line of the target through one feature."""
    r = train.agg(F.regr_slope(TARGET, feature).alias("s"), F.regr_intercept(TARGET, feature).alias("i")).first()
    return {"feature": feature, "slope": r["s"], "intercept": r["i"]}


def line_error(parameters: dict, rows: DataFrame) -> float:
    """Mean absolute error of a stored line; raises if it cannot be read."""
    said = F.lit(float(parameters["intercept"])) + F.lit(float(parameters["slope"])) * F.col(parameters["feature"])
    return rows.agg(F.avg(F.abs(F.col(TARGET) - said)).alias("mae")).first()["mae"]


def gate(registry: Registry, version: int, psi: dict[str, float], holdout: DataFrame, error=line_error) -> str:
    """Puts a registered version into Staging if it passes both gates; why, or why not (also as a tag).

    First, the features of the gate are stable. Second, its error on the holdout is less than that of the stored Production
    model on the same rows. No Production model, or one that cannot be evaluated, stands in nobody's way.
    """
    number, models = registry.state()
    mine = next(m for m in models if m["version"] == version)
    high = {f: p for f, p in psi.items() if f in GATE_FEATURES and p > GATE_PSI}
    if high:
        why = f"feature_drift: {max(high, key=high.get)}"
        registry.change(version, tags={"rejection_reason": why}, seen=number)
        return why
    production = max((m for m in models if m["stage"] == PRODUCTION), key=lambda m: m["version"], default=None)
    if production is None:
        registry.change(version, STAGING, {"promotion_reason": "no_production_model_exists"}, seen=number)
        return "no_production_model_exists"
    try:
        theirs = error(production["parameters"], holdout)
    except (KeyError, TypeError, ValueError, AnalysisException):
        registry.change(version, STAGING, {"promotion_reason": "production_model_eval_failed"}, seen=number)
        return "production_model_eval_failed"
    against = {"compared_against_prod_version": str(production["version"]), "prod_val_mae": f"{theirs:.6f}"}
    if error(mine["parameters"], holdout) < theirs:
        registry.change(version, STAGING, against | {"promotion_reason": "beats_production"}, seen=number)
        return "beats_production"
    registry.change(version, tags=against | {"rejection_reason": "holdout_mae"}, seen=number)
    return "holdout_mae"


#: Rows that a training run needs.
LEAST_ROWS = 100


def retrain(lease: Lease, owner: str, scores: dict[str, tuple[float, bool]], rows: DataFrame, now: datetime, train, threshold: float = 0.3, cooldown_minutes: int = 360) -> str:
    """Trains if a score is above the threshold or drift was detected; what was done.

    Not within the cooldown after the last run began, which the lease has stored; not while another owner's lease
    lasts; and not on fewer than LEAST_ROWS rows, which still counts as a run.
    """
    if not any(s > threshold or hit for s, hit in scores.values()):
        return "no drift"
    last = lease.last_run()
    if last is not None and now - last < timedelta(minutes=cooldown_minutes):
        return "cooling down"
    if not lease.take(owner, now):
        return "already running"
    try:
        if rows.limit(LEAST_ROWS).count() < LEAST_ROWS:
            return "too few rows"
        train()
        return "trained"
    finally:
        lease.give_back(owner)
