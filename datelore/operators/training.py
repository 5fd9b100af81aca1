"""Training runs on dated rows: configuration grids, shared folds, feature-set ablation, refit and a single final test."""

from __future__ import annotations

import hashlib
import itertools
import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.operators import gram, splits

#: Feature sets in order of size, as the categories that each allows.
FEATURE_SETS = {
    "core": ("core",), "core_plus_climate": ("core", "climate"), "core_plus_financial": ("core", "financial"), "core_plus_both": ("core", "climate", "financial"),
}


def grid(family: str, search: dict[str, list]) -> list[tuple[str, dict]]:
    """The four configurations of a two-by-two search, in stable order; any other number is an error."""
    found = [(f"{family}_{k}", dict(zip(search, values, strict=True))) for k, values in enumerate(itertools.product(*search.values()), 1)]
    if len(found) != 4:
        raise ValueError(f"{family} search must contain exactly four configurations")
    return found


def split_mode(rows: DataFrame) -> str:
    """historical with three or more cycles whose scores were published after their date, else snapshot."""
    return "historical" if rows.where("as_of < published_date").agg(F.countDistinct("cycle")).first()[0] >= 3 else "snapshot"


@dataclass(frozen=True)
class Run:
    """What a training run found: status trained, blocked or reused, and why; the chosen set and configuration; errors as rows; the predictions of the test rows, and of all
    held-out rows by every set and configuration; the run's id."""

    status: str
    reason: str = ""
    feature_set: str = ""
    configuration: str = ""
    validation: list[tuple] = field(default_factory=list)
    test: DataFrame | None = None
    held_out: DataFrame | None = None
    run_id: str = ""


def fingerprint(rows: DataFrame) -> tuple[int, str]:
    """(rows, a sum over their hashes): the same for the same rows in any order, in one aggregation."""
    found = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))).first()
    return found[0], str(found[1])


def run_id(of_rows: tuple[int, str], **settings) -> str:
    """A digest of the rows and of every setting, in canonical form."""
    return hashlib.sha256(json.dumps({"rows": of_rows, **settings}, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def train(rows: DataFrame, key: str, categories: dict[str, str], label: str, fold: str, search: dict[str, list], least_rows: int = 20, least_support: int = 1, store: str | None = None) -> Run:
    """One run over rows that carry their fold (test, or a validation fold's name); categories maps features to their category.

    Every feature set and configuration is validated on the same folds. Mean error chooses the configuration, the one-standard-error rule the set; its model on all rows
    but the test predicts the test. A feature known in fewer than least_support rows of a training side has no terms there. Too few rows give a blocked run instead of an error.
    However many sets, configurations and folds there are, the run is one count, one pass for the cuts, one for the products, and one that scores held-out rows (see gram).
    With a store, a finished run of the same rows and settings is read back instead; results are written first and their manifest last, so half a run is never found.
    """
    known = rows.where(F.col(label).isNotNull()).select(key, F.col(fold).cast("string").alias(fold), label, *categories)
    development = known.where(F.col(fold) != "test")
    settings = {"categories": categories, "label": label, "search": search, "least_rows": least_rows, "least_support": least_support, "sets": FEATURE_SETS}
    number = run_id(fingerprint(known), **settings)
    if store and (found := _stored(rows.sparkSession, f"{store}/{number}", number)):
        return found
    counts = development.groupBy(fold).count().collect()
    n, folds = sum(r["count"] for r in counts), sorted(r[0] for r in counts)
    if n < least_rows or len(folds) < 2:
        return Run("blocked", f"{n} labelled development rows in {len(folds)} folds", run_id=number)
    features, configurations = list(categories), grid("additive", search)
    bins = sorted({c["bins"] for _, c in configurations})
    cuts = gram.side_cuts(development, features, fold, [*folds, gram.ALL], bins)
    sides = gram.side_sums(development, features, label, fold, cuts)
    sets = {name: [f for f in features if categories[f] in allowed] for name, allowed in FEATURE_SETS.items()}
    sets = {name: own for name, own in sets.items() if own}

    def fitted(side: str, name: str, config: dict) -> tuple:
        of = sides[side, config["bins"]]
        return of.fit([f for f in sets[name] if of.support(f) >= least_support], config["ridge"])

    models = [(side, c["bins"], f"{name}/{number_}", *fitted(side, name, c)) for side in folds for name in sets for number_, c in configurations]
    held_out = gram.scored(development, key, features, label, fold, sides, models)
    found = splits.errors(held_out, ["model", fold], label, "predicted").select("model", "mae").collect()
    of_model: dict[str, list[float]] = {}
    for r in found:
        of_model.setdefault(r.model, []).append(r.mae)
    results = {}
    for name in sets:
        best = None
        for config, _ in configurations:
            errors = of_model[f"{name}/{config}"]
            mean = sum(errors) / len(errors)
            spread = (sum((e - mean) ** 2 for e in errors) / max(len(errors) - 1, 1) / len(errors)) ** 0.5
            if best is None or (mean, config) < best[:2]:
                best = (mean, config, spread)
        results[name] = best
    limit = min((r[0], r[2]) for r in results.values())
    chosen = min((len(sets[name]), list(FEATURE_SETS).index(name), name) for name, r in results.items() if r[0] <= sum(limit))[2]
    config = results[chosen][1]
    of_config = dict(configurations)[config]
    terms, intercept = fitted(gram.ALL, chosen, of_config)
    test = gram.scored(known.where(F.col(fold) == "test").withColumn(fold, F.lit(gram.ALL)), key, features, label, fold, sides, [(gram.ALL, of_config["bins"], chosen, terms, intercept)]).select(key, label, "predicted")
    validation = [(name, r[1], round(r[0], 6), round(r[2], 6), len(sets[name])) for name, r in results.items()]
    run = Run("trained", "", chosen, config, validation, test, held_out, number)
    if store:
        _store(rows.sparkSession, f"{store}/{number}", run)
    return run


_MANIFEST = "run_id string, feature_set string, configuration string, validation array<struct<name:string,configuration:string,mean:double,spread:double,size:int>>"


def _store(spark: SparkSession, path: str, run: Run) -> None:
    run.test.write.mode("overwrite").parquet(f"{path}/test")
    run.held_out.write.mode("overwrite").parquet(f"{path}/held_out")
    spark.createDataFrame([(run.run_id, run.feature_set, run.configuration, run.validation)], _MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")


def _stored(spark: SparkSession, path: str, number: str) -> Run | None:
    """The finished run at path; none where there is no manifest of its id."""
    try:
        told = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").where(F.col("run_id") == number).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if told is None:
        return None
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Run("reused", "", told.feature_set, told.configuration, [tuple(v) for v in told.validation], read("test"), read("held_out"), number)


def coverage_bin(share: Column, edges: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> Column:
    """The index of the bin of a share; the last bin holds its upper edge."""
    return sum((F.when(share >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))


def limitations(rows: DataFrame) -> DataFrame:
    """One row of what a reader of the run has to know, as flags over all rows."""
    return rows.agg(F.bool_or(F.col("basis") == "public_document_acquisition_date").alias("uses_acquisition_dates"), F.bool_or(F.col("label").isNull()).alias("has_unlabelled_rows"), F.countDistinct("cycle").alias("n_cycles"))
