"""Stop and arrival models: baselines, boosted trees, holdout reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypoint.functions.numbers import portable_hash, ratio
from waypoint.operators import boosting
from waypoint.operators.impute import PREDICTED
from waypoint.operators.intervals import Course
from waypoint.operators.joins import join_checked
from waypoint.operators.quantiles import grouped_quantiles, pick

# Feature lists and training parameters.
STOP_FEATURES = [
    "cp",
    "position",
    "elapsed_hrs",
    "overall_pace",
    "age",
    "gender_code",
    "is_finisher",
    "overall_rank_pct",
]
ARRIVAL_FEATURES = [f for f in STOP_FEATURES if f != "elapsed_hrs"]
ROW_KEY = ("edition", "entity", "cp")


@dataclass(frozen=True)
class Training:
    features: Sequence[str] = field(default_factory=lambda: list(STOP_FEATURES))
    target: str = "stop_min"
    iterations: int = 300
    step: float = 0.05
    depth: int = 6
    seed: int = 42
    holdout_edition: int | None = 2023
    test_fraction: float = 0.2  # used when no edition is held out
    max_rows: int | None = None  # every labelled row is learned from, unless a caller bounds them


def observed_stops(features: DataFrame, course: Course = Course()) -> DataFrame:
    """Rows the stop model learns from: both times known, stop not negative, before the finish."""
    return features.where(
        (F.col("stop_min") >= 0) & (F.col("position") < course.finish_cutoff_mi)
    )


def observed_arrivals(features: DataFrame) -> DataFrame:
    return features.where((F.col("elapsed_hrs") >= 0) & (F.col("position") > 0))


def is_held_out(training: Training, key: Sequence[str] = ROW_KEY) -> Column:
    """Rows kept for validation: one edition, or a stable share chosen by a hash of the key."""
    if training.holdout_edition is not None:
        return F.col("edition") == training.holdout_edition
    bucket = portable_hash(*key, F.lit(training.seed)) % 1_000_000
    return bucket < int(training.test_fraction * 1_000_000)


def fit(rows: DataFrame, training: Training = Training()) -> boosting.Trees:
    params = boosting.Boosting(
        training.iterations, training.step, training.depth, max_rows=training.max_rows
    )
    return boosting.fit(rows, training.features, training.target, ROW_KEY, params)


def apply_model(model: boosting.Trees, rows: DataFrame, name: str) -> DataFrame:
    """Adds the prediction as ``name`` on the same rows, without a join."""
    return rows.withColumn(name, model.score())


def predict_stops(model: boosting.Trees) -> Callable[[DataFrame], DataFrame]:
    """Predictor for ``impute_times`` from a fitted stop model."""
    return lambda rows: apply_model(model, rows, PREDICTED)


def station_medians(features: DataFrame, course: Course = Course()) -> DataFrame:
    """Median observed stop per checkpoint, ``cp`` null holding the median over all."""
    rows = observed_stops(features, course).select("cp", "stop_min")
    both = rows.select(F.explode(F.array("cp", F.lit(None).cast("int"))).alias("cp"), "stop_min")
    return grouped_quantiles(both, ["cp"], {"stop": "stop_min"}, [0.5]).select(
        "cp", pick("stop").alias("median_stop_min"), F.col("stop_n").alias("n")
    )


def by_station_median(
    medians: DataFrame, name: str = PREDICTED
) -> Callable[[DataFrame], DataFrame]:
    """Predictor: the median stop of the checkpoint, else the median over all."""
    overall = medians.where("cp is null").select("median_stop_min").scalar()
    named = medians.where("cp is not null").select("cp", F.col("median_stop_min").alias("_own"))

    def predict(rows: DataFrame) -> DataFrame:
        return (
            join_checked(rows, named, ["cp"])
            .withColumn(name, F.coalesce("_own", overall))
            .drop("_own")
        )

    return predict


def mean_absolute_error(actual: str, predicted: str) -> Column:
    return F.avg(F.abs(F.col(actual) - F.col(predicted)))


def stop_baseline(rows: DataFrame, training: Training = Training(), course: Course = Course()):
    """(fit rows, held-out rows with ``naive``, medians): median stop per checkpoint as prediction."""
    rows = observed_stops(rows, course)
    held = is_held_out(training)
    medians = station_medians(rows.where(~held), course)
    return rows.where(~held), by_station_median(medians, "naive")(rows.where(held)), medians


def arrival_baseline(rows: DataFrame, training: Training):
    """(fit rows, held-out rows with ``naive``, median hours per mile as one row)."""
    rows = observed_arrivals(rows)
    held = is_held_out(training)
    pace = grouped_quantiles(
        rows.where(~held), [], {"pace": ratio(F.col("elapsed_hrs"), F.col("position"))}, [0.5]
    ).select(pick("pace").alias("median_pace"))
    validated = rows.where(held).withColumn("naive", F.col("position") * pace.scalar())
    return rows.where(~held), validated, pace


def holdout_report(
    fit_rows: DataFrame, validated: DataFrame, target: str, median: DataFrame
) -> DataFrame:
    """One row: sizes, errors of the columns ``model`` (if there) and ``naive``, and the median."""
    errors = [
        mean_absolute_error(target, p).alias(f"mae_{p}")
        for p in ("model", "naive")
        if p in validated.columns
    ]
    one = F.lit(1).alias("_one")
    parts = [
        fit_rows.agg(F.count(F.lit(1)).alias("n_fit")).select(one, "*"),
        validated.agg(F.count(F.lit(1)).alias("n_val"), *errors).select(one, "*"),
        median.select(one, "*"),
    ]
    report = parts[0]
    for part in parts[1:]:  # three one-row aggregates
        report = report.join(part, "_one")
    return report.drop("_one")


def metrics_long(report: DataFrame) -> DataFrame:
    """A report as rows ``(name, value, step)``, numeric columns except the held-out edition."""
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float")
    names = [c for c, t in report.dtypes if t in numeric and c != "holdout_edition"]
    pairs = [
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names
    ]
    return report.select(F.inline(F.array(*pairs))).withColumn("step", F.lit(0))


@dataclass(frozen=True)
class Trained:
    """Holdout report, held-out rows with predictions, the model of the trial, and its refit on all rows.

    ``refit`` trains once more when it is called; reports alone do not need it.
    """

    trial: boosting.Trees
    report: DataFrame
    validated: DataFrame
    refit: Callable[[], boosting.Trees]


def _train(fit_rows, validated, every_row, median, training: Training) -> Trained:
    trial = fit(fit_rows, training)
    scored = apply_model(trial, validated, "model")
    report = holdout_report(fit_rows, scored, training.target, median).withColumn(
        "holdout_edition", F.lit(training.holdout_edition).cast("long")
    )
    return Trained(trial, report, scored, lambda: fit(every_row, training))


def train_stop_model(
    features: DataFrame, training: Training = Training(), course: Course = Course()
) -> Trained:
    fit_rows, validated, medians = stop_baseline(features, training, course)
    median = medians.where("cp is null").select("median_stop_min")
    return _train(fit_rows, validated, observed_stops(features, course), median, training)


def train_arrival_model(features: DataFrame, training: Training | None = None) -> Trained:
    training = training or Training(features=list(ARRIVAL_FEATURES), target="elapsed_hrs")
    fit_rows, validated, pace = arrival_baseline(features, training)
    return _train(fit_rows, validated, observed_arrivals(features), pace, training)


def residuals_by_station(validated: DataFrame, target: str = "stop_min") -> DataFrame:
    """Mean absolute error per checkpoint of the columns ``model`` (if there) and ``naive``."""
    return validated.groupBy("cp").agg(
        F.count(F.lit(1)).alias("n"),
        *[
            mean_absolute_error(target, p).alias(f"mae_{p}")
            for p in ("model", "naive")
            if p in validated.columns
        ],
    )


def prediction_rows(
    validated: DataFrame, key: Sequence[str] = ROW_KEY, target: str = "stop_min"
) -> DataFrame:
    """Held-out rows with the actual value, the predictions and their errors (prediction - actual)."""
    found = [p for p in ("model", "naive") if p in validated.columns]
    return validated.select(
        *key,
        F.col(target).alias("actual"),
        *found,
        *[(F.col(p) - F.col(target)).alias(f"error_{p}") for p in found],
    )


def node_checks(model: boosting.Trees) -> DataFrame:
    """One row per tree: rows at its root, and whether children add up and leaves alone hold values."""
    parent = model.nodes.where("feature is not null").select(
        "tree", F.col("node").alias("_parent"), F.col("n").alias("_rows"), "left", "right"
    )
    children = model.nodes.select("tree", "node", F.col("n").alias("_own"))
    added = parent.join(
        children, (parent.tree == children.tree) & F.col("node").isin(F.col("left"), F.col("right"))
    )
    sums = added.groupBy(parent.tree, "_parent").agg(
        F.first("_rows").alias("_rows"), F.sum("_own").alias("_both")
    )
    wrong = sums.groupBy("tree").agg(F.count_if(F.col("_rows") != F.col("_both")).alias("_wrong"))
    per_tree = model.nodes.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 1, F.col("n"))).alias("n_rows"),
        F.bool_and(F.col("feature").isNull() == F.col("value").isNotNull()).alias("leaves_hold_values"),
        F.floor(F.log2(F.max("node"))).cast("int").alias("depth"),
    )
    return per_tree.join(wrong, "tree", "left").select(
        "tree",
        "n_rows",
        "leaves_hold_values",
        "depth",
        (F.coalesce("_wrong", F.lit(0)) == 0).alias("children_add_up"),
    )
