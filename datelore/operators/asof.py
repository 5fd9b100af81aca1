"""What was known by a date: availability, quarantine reasons, as-of selection, conflicts, previous scores, derived ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUBLISHER, ACQUIRED, UNAVAILABLE = "publisher_publication_date", "public_document_acquisition_date", "unavailable"


def availability(fallback: bool) -> tuple[Column, Column]:
    """(date, basis): the publisher's date, else under the fallback policy the date the document was acquired, else none."""
    acquired = F.col("acquired_date") if fallback else F.lit(None).cast("date")
    basis = F.when(F.col("publication_date").isNotNull(), PUBLISHER).when(acquired.isNotNull(), ACQUIRED).otherwise(UNAVAILABLE)
    return F.coalesce("publication_date", acquired), basis


def judged(observations: DataFrame, registry_unit: str = "usd", fallback: bool = False) -> DataFrame:
    """observations with available, basis and the first rule that rejects them whatever the date: undated, unit, type (reason; null where they may be used once available).

    A null value has the right type, a number that is not finite has not.
    """
    date, basis = availability(fallback)
    reason = (
        F.when(F.col("available").isNull(), "undated").when(~F.col("unit").eqNullSafe(F.lit(registry_unit)), "unit_mismatch")
        .when(F.isnan("value") | (F.abs("value") == float("inf")), "type_mismatch")
    )
    return observations.withColumns({"available": date, "basis": basis}).withColumn("reason", reason)


def candidates(rows: DataFrame, observations: DataFrame, registry_unit: str = "usd", fallback: bool = False) -> DataFrame:
    """Every observation of a row's company with the first rule that rejects it (reason; null where eligible): for reviews of what was rejected.

    rows holds company_cik and as_of. The tests run in order: undated, after the cutoff, unit, type. known_as_of finds what was eligible without these pairs.
    """
    return _by_cutoff(rows, judged(observations, registry_unit, fallback))


def _by_cutoff(rows: DataFrame, found: DataFrame) -> DataFrame:
    both = rows.join(found, "company_cik")
    first = F.col("reason").isin("unregistered", "undated")
    return both.withColumn("reason", F.when(first, F.col("reason")).when(F.col("available") > F.col("as_of"), "after_cutoff").otherwise(F.col("reason")))


#: Columns that hold the values of typed observations, and the data types of a registry that each is for.
TYPED = {"value": ("number", "integer"), "flag": ("boolean",), "said": ("text",)}


def typed_judged(observations: DataFrame, registry: DataFrame, fallback: bool = False) -> DataFrame:
    """judged() for observations with a value, a flag or a text (said), by a registry (feature_name, data_type, unit) of fixed size.

    The unit is the feature's own. A value of another type than the registry's, an integer with a fraction, a number that is
    not finite and a blank text are type mismatches; nothing is coerced. Features that the registry lacks are unregistered.
    """
    date, basis = availability(fallback)
    known = F.broadcast(registry.select("feature_name", "data_type", F.col("unit").alias("_unit"), F.lit(True).alias("_known")))
    both = observations.withColumns({"available": date, "basis": basis}).join(known, "feature_name", "left")
    wrong = F.isnan("value") | (F.abs("value") == float("inf")) | ((F.col("data_type") == "integer") & (F.col("value") != F.floor("value"))) | (F.trim("said") == "")
    wrong = F.coalesce(wrong, F.lit(False))
    for column, kinds in TYPED.items():
        wrong = wrong | (F.col(column).isNotNull() & ~F.col("data_type").isin(*kinds))
    reason = (
        F.when(F.col("_known").isNull(), "unregistered").when(F.col("available").isNull(), "undated")
        .when(~F.col("unit").eqNullSafe(F.col("_unit")), "unit_mismatch").when(wrong, "type_mismatch")
    )
    return both.withColumn("reason", reason).drop("_unit", "_known")


def typed_candidates(rows: DataFrame, observations: DataFrame, registry: DataFrame, fallback: bool = False) -> DataFrame:
    """candidates() by typed_judged()."""
    return _by_cutoff(rows, typed_judged(observations, registry, fallback))


def _carried(states: DataFrame, dates: DataFrame, keys: list[str], at: str, state: str) -> DataFrame:
    """dates (keys, as_of) with the last state (keys, at, state) on or before each: a merge of both in the order of time, no pair of them is made."""
    both = states.select(*keys, F.col(at).alias("as_of"), F.lit(0).alias("_kind"), state).unionByName(dates.select(*keys, "as_of", F.lit(1).alias("_kind")), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy("as_of", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(state, F.last(state, ignorenulls=True).over(so_far)).where("_kind = 1").drop("_kind")


def known_as_of(rows: DataFrame, found: DataFrame, values: tuple[str, ...] = ("value",), keys: tuple[str, ...] = ("company_cik", "as_of")) -> DataFrame:
    """What select_as_of selects, from rows (keys) and judged observations, without a row for each date and observation.

    Observations that may be used become one state for each company, feature and date of availability (its latest year, torn where that holds two values, the row of
    its largest document); a state holds until the next one. The work is linear in the observations, and in the dates of a company times its features.
    """
    kept = [c for c in found.columns if c not in ("company_cik", "reason")]
    eligible = found.where("reason is null").withColumn("_year", F.coalesce("reporting_year", F.lit(0)))
    torn = F.lit(False)
    for v in values:
        torn = torn | F.coalesce(F.min(v) != F.max(v), F.lit(False))
    group = ["company_cik", "feature_name", "available"]
    by_year = eligible.groupBy(*group, "_year").agg(F.max_by(F.struct(*kept), "document_id").alias("_row"), torn.alias("_torn"))
    states = by_year.groupBy(*group).agg(F.max_by(F.struct("_row", "_torn"), "_year").alias("_state"))
    dates = rows.select(*keys).distinct().join(states.select("company_cik", "feature_name").distinct(), "company_cik")
    got = _carried(states, dates, ["company_cik", "feature_name"], "available", "_state").where("_state is not null")
    told = got.select("company_cik", "as_of", "_state._torn", "_state._row.*")
    empty = F.coalesce(*[F.col(v).cast("string") for v in values]).isNull()
    status = F.when(F.col("_torn"), "conflicting").when(empty, "missing").otherwise("observed")
    return told.withColumn("status", status).withColumns({v: F.when(~F.col("_torn"), F.col(v)) for v in values}).drop("_torn")


def select_as_of(judged: DataFrame, keys: list[str], values: tuple[str, ...] = ("value",)) -> tuple[DataFrame, DataFrame]:
    """(selected, quarantined) of candidates; values are the columns that may hold a value.

    selected has one row for each key and feature with an eligible observation: the newest by availability, year and document. Where the newest
    (availability, year) holds two different values they are null and the status conflicting, and all of that group are quarantined
    besides those with a reason; a null among them is no conflict.
    """
    group = Window.partitionBy(*keys, "feature_name")
    newest = group.orderBy(F.col("available").desc(), F.coalesce("reporting_year", F.lit(0)).desc())
    eligible = judged.where("reason is null").withColumn("_rank", F.rank().over(newest)).where("_rank = 1").drop("_rank")
    torn = F.lit(False)
    for v in values:
        torn = torn | F.coalesce(F.min(v).over(group) != F.max(v).over(group), F.lit(False))
    spread = eligible.withColumn("_torn", torn)
    first = F.row_number().over(group.orderBy(F.col("document_id").desc()))
    empty = F.coalesce(*[F.col(v).cast("string") for v in values]).isNull()
    selected = (
        spread.withColumn("_n", first).where("_n = 1")
        .withColumn("status", F.when(F.col("_torn"), "conflicting").when(empty, "missing").otherwise("observed"))
        .withColumns({v: F.when(~F.col("_torn"), F.col(v)) for v in values}).drop("_torn", "_n", "reason")
    )
    quarantined = judged.where("reason is not null").unionByName(spread.where("_torn").withColumn("reason", F.lit("conflict")).drop("_torn"))
    return selected, quarantined


def previous_scores(rows: DataFrame, published: DataFrame, keys: tuple[str, ...] = ("company_cik",), allowed: Column | None = None) -> DataFrame:
    """rows with the last score of their company (keys) published on or before their as_of (null where there is none), among the published rows that are allowed.

    Of scores of one day the one of the latest cycle counts, then the largest. Scores and dates are merged in the order of time.
    """
    known = published if allowed is None else published.where(allowed)
    scores = known.where("published_date is not null").groupBy(*keys, "published_date").agg(F.max(F.struct("cycle", "score")).alias("_last"))
    dates = rows.select(*keys, "as_of").distinct()
    last = _carried(scores, dates, list(keys), "published_date", "_last").select(*keys, "as_of", F.col("_last.score").alias("previous_score"))
    return rows.join(last, [*keys, "as_of"], "left")


def ratio(numerator: str, denominator: str) -> Column:
    """numerator / denominator, null unless the denominator is positive."""
    return F.when(F.col(denominator) > 0, F.try_divide(F.col(numerator), F.col(denominator)))


def derived_ratios(long: DataFrame, keys: list[str], ratios: list[tuple[str, str, str]], units: tuple[str, str] | None = None) -> DataFrame:
    """Rows (keys, feature_name, value, status, reporting_year, available, basis, confidence, boundary) of ratios (name, numerator, denominator) of a long table.

    Both inputs have to be there, with a positive denominator, the units asked for, one known reporting year, and no more than one stated
    boundary; otherwise the value is null and the status says which test failed first. The ratio is available when the later of its inputs is;
    its basis is acquisition where either is, its confidence the lower one. long may lack unit, basis, confidence and boundary.
    """
    kinds = {"value": "double", "reporting_year": "int", "available": "date", "unit": "string", "basis": "string", "confidence": "double", "boundary": "string"}
    pairs = long.sparkSession.createDataFrame(ratios, "ratio string, numerator string, denominator string")
    fields = {c: F.col(c) if c in long.columns else F.lit(None).cast(kind) for c, kind in kinds.items()}
    side = lambda name, mark: long.join(F.broadcast(pairs), F.col("feature_name") == F.col(name)).select(*keys, "ratio", *[x.alias(f"{mark}_{c}") for c, x in fields.items()])  # noqa: E731  the ratios are a fixed list
    both = side("numerator", "n").join(side("denominator", "d"), [*keys, "ratio"], "full_outer")
    n, d = (lambda c: F.col(f"n_{c}")), (lambda c: F.col(f"d_{c}"))
    plain = lambda c: F.nullif(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), F.lit(""))
    wrong_unit = F.lit(False) if units is None else ~(n("unit").eqNullSafe(F.lit(units[0])) & d("unit").eqNullSafe(F.lit(units[1])))
    status = (
        F.when(n("value").isNull() | d("value").isNull(), "missing_input").when(d("value") <= 0, "denominator_not_positive").when(wrong_unit, "different_units")
        .when(~F.coalesce(n("reporting_year") == d("reporting_year"), F.lit(False)), "different_years").when(plain(n("boundary")) != plain(d("boundary")), "different_boundaries").otherwise("derived")
    )
    acquired = (n("basis") == ACQUIRED) | (d("basis") == ACQUIRED)
    basis = F.when(acquired, f"derived_from_{ACQUIRED}").when((n("basis") == PUBLISHER) & (d("basis") == PUBLISHER), PUBLISHER).otherwise(UNAVAILABLE)
    later = F.when(n("available").isNotNull() & d("available").isNotNull(), F.greatest(n("available"), d("available")))
    told = {
        "value": F.try_divide(n("value"), d("value")), "reporting_year": n("reporting_year"), "available": later, "basis": basis,
        "confidence": F.least(n("confidence"), d("confidence")), "boundary": F.coalesce(n("boundary"), d("boundary")),
    }
    made = both.withColumn("status", status)
    out = {c: F.when(F.col("status") == "derived", x).alias(c) for c, x in told.items()}
    return made.select(*keys, F.col("ratio").alias("feature_name"), out["value"], "status", *[out[c] for c in ("reporting_year", "available", "basis", "confidence", "boundary")])
