"""The two long jobs: clean a source once, then train on a sample of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tripmill.operators import anomalies, bundle as bundles, cleaning, kmeans, scaling, selection
from tripmill.operators.profiles import feature_summary, statistic_rows
from tripmill.operators.results import experiment_id
from tripmill.operators.sampling import sample_rows
from tripmill.plans import study
from tripmill.schema import FEATURES, ROW_ID, SEED, Rules
from tripmill.sources.readers import scan, source_digest
from tripmill.sources.writers import append_attempt, load_document, save_csv
from tripmill.sources.writers import save_document, save_parquet


@dataclass(frozen=True)
class Config:
    features: Sequence[str] = FEATURES
    rules: Rules = Rules()
    percentile: float = anomalies.PERCENTILE
    restarts: int = kmeans.RESTARTS
    gates: selection.Gates = selection.Gates()


def config_of(document: dict) -> Config:
    """A configuration from its JSON form."""
    return Config(
        tuple(document["features"]), Rules(**document["rules"]), document["anomaly_percentile"]
    )


def clean(spark: SparkSession, path: str, out: str, rules: Rules = Rules()) -> dict:
    """Classified trips, provenance and feature statistics of one source."""
    report = cleaning.write_classified(scan(spark, path), f"{out}/trips.parquet", rules)
    provenance = {"source": path, **source_digest(spark, path), **report}
    save_document(spark, provenance, f"{out}/provenance.json")
    good = cleaning.read_accepted(spark, f"{out}/trips.parquet")
    save_csv(statistic_rows(feature_summary(good, FEATURES)), f"{out}/feature_statistics.csv")
    return provenance


def check_rules(rules: Rules, provenance: dict) -> None:
    """Training must use the limits the data was cleaned with."""
    if rules.as_dict() != provenance["rules"]:
        raise ValueError("the cleaning rules differ from those of the data; clean it again")


def cleaned(spark: SparkSession, out: str) -> DataFrame:
    return cleaning.read_accepted(spark, f"{out}/trips.parquet")


def train(
    spark: SparkSession, cleaned_dir: str, out: str, rows: int = 100_000, config: Config = Config()
) -> tuple[bundles.Bundle, dict]:
    """Choose K on a prefix of the training sample, fit, and write every artifact."""
    provenance = load_document(spark, f"{cleaned_dir}/provenance.json")
    check_rules(config.rules, provenance)
    good = cleaned(spark, cleaned_dir)
    # The sample is written once: it feeds the study, the fits and every summary.
    save_parquet(sample_rows(good, rows), f"{out}/training.parquet")
    sample = spark.read.parquet(f"{out}/training.parquet")
    choice = selection.analyze(sample, config.features, config.gates, config.restarts)
    save_csv(choice.table.orderBy("k"), f"{out}/k_selection.csv")
    save_csv(choice.profiles.orderBy("k", "cluster"), f"{out}/k_profiles.csv")
    save_document(spark, choice.summary, f"{out}/selection.json")

    fitted = bundles.fit_bundle(
        sample,
        choice.k,
        config.rules,
        config.features,
        config.percentile,
        config.restarts,
        source=provenance["source"],
    )
    accepted, _, _ = cleaning.validate(sample, config.rules)
    fitted.metadata["anomalies"] = bundles.summarize_training(fitted, accepted, out)
    save_csv(
        bundles.training_profiles(fitted, accepted).orderBy("algorithm", "cluster"),
        f"{out}/profiles.csv",
    )
    for name in fitted.models:
        save_parquet(bundles.reference_sample(fitted, accepted, name), f"{out}/sample_{name}.parquet")
    frozen = scaling.snapshot(
        fitted.scaler,
        choice.k,
        config.rules.as_dict(),
        SEED,
        provenance["sha256"],
        provenance["accepted_rows"],
    )
    save_document(spark, frozen, f"{out}/frozen_preprocessing.json")
    fitted.metadata["selection"] = choice.summary
    fitted.metadata["experiment_id"] = experiment_id(frozen)
    bundles.save_bundle(spark, fitted, out)
    return fitted, frozen


def benchmark_points(spark: SparkSession, cleaned_dir: str, saved: dict) -> DataFrame:
    """The whole cleaned table on the frozen scaling, projected to the model columns."""
    scaler = scaling.restore_scaler(saved)
    narrow = cleaned(spark, cleaned_dir).select(ROW_ID, *scaler.features)
    return scaling.with_scaled(narrow, scaler).select(
        ROW_ID, *scaling.scaled_names(scaler.features)
    )


def check_frozen(bundle: bundles.Bundle, saved: dict) -> None:
    """Benchmarks must run on exactly the frozen scaling, features and K."""
    same = bundle.scaler == scaling.restore_scaler(saved) and bundle.metadata["k"] == saved["k"]
    if not same or list(bundle.features) != saved["features"]:
        raise ValueError("the models differ from the frozen preprocessing; train them together")


def benchmark(
    spark: SparkSession,
    cleaned_dir: str,
    models_dir: str,
    out: str,
    attempt: str,
    sizes: Sequence[int] = study.SIZES,
    batch_sizes: Sequence[int] = study.BATCH_SIZES,
    full: bool = True,
    environment: str = "local",
    restarts: int = kmeans.RESTARTS,
) -> tuple[DataFrame, DataFrame]:
    """Size sweep and batch study on the frozen scaling, kept as a new attempt."""
    saved = load_document(spark, f"{models_dir}/frozen_preprocessing.json")
    scaling.reconcile(load_document(spark, f"{cleaned_dir}/provenance.json"), saved)
    check_frozen(bundles.load_bundle(spark, models_dir), saved)
    columns = scaling.scaled_names(saved["features"])
    points = benchmark_points(spark, cleaned_dir, saved).persist(StorageLevel.MEMORY_AND_DISK)
    identity = experiment_id(saved)
    # Every row is appended as soon as its run has ended.
    sweep = study.size_sweep(
        points, columns, saved["k"], sizes, full, environment, identity, restarts,
        keep=lambda row: append_attempt(row, f"{out}/benchmarks.parquet", attempt),
    )
    batches = study.batch_study(
        points, columns, saved["k"], batch_sizes, environment=environment, experiment_id=identity,
        restarts=restarts,
        keep=lambda row: append_attempt(row, f"{out}/batch_study.parquet", attempt),
    )
    points.unpersist()
    return sweep, batches
