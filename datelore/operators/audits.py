"""Audits of what is known and missing: status names, coverage of a dataset, null reasons, labels, usage reports, evidence links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a missing value's status may say; other names that mean "not extracted"; statuses of extraction, which come first.
MISSING = ("processing", "not_extracted", "unknown", "not_disclosed", "not_applicable", "conflicting")
NOT_EXTRACTED = ("not_started", "not_available", "needs_review", "missing")
PROGRESS = ("processing", "not_extracted", "unknown", "unspecified_null")
SEMANTIC = ("not_disclosed", "not_applicable")


def missing_status(value: Column, status: Column) -> Column:
    """One of eight states: observed, the statuses of MISSING, or unspecified_null for any other."""
    name = F.replace(F.lower(F.trim(status)), F.lit(" "), F.lit("_"))
    return F.when(value.isNotNull(), "observed").when(name.isin(*MISSING), name).when(name.isin(*NOT_EXTRACTED), "not_extracted").otherwise("unspecified_null")


def null_reason(category_status: Column, field_status: Column) -> Column:
    """Why a null is one: a category in progress decides, then what the field says, then what its category says."""
    category = F.when(category_status.isNull() | category_status.isin("", "not_started", "needs_review"), "not_extracted").otherwise(category_status)
    told = field_status.isin(*SEMANTIC, "conflicting", "not_extracted", "processing", "unknown")
    return F.when(category == "processing", "processing").when(told, field_status).when(category.isin("not_extracted", "processing", "unknown"), category).otherwise("unspecified_null")


def derived_status(long: DataFrame, keys: list[str], ratios: DataFrame) -> DataFrame:
    """(keys, ratio, status) of ratios (ratio, position, feature_name): observed where both inputs are there; else the first input whose extraction is
    not done tells, or the first missing one. long has a row for each key and feature with value and status. ratios is a fixed list."""
    need = long.join(F.broadcast(ratios), "feature_name").where("value is null")
    first = F.struct(F.when(F.col("status").isin(*PROGRESS), 0).otherwise(1).alias("late"), "position", "status")
    worst = need.groupBy(*keys, "ratio").agg(F.min(first).alias("w"))
    every = long.join(F.broadcast(ratios), "feature_name").select(*keys, "ratio").distinct()
    return every.join(worst, [*keys, "ratio"], "left").select(*keys, "ratio", F.coalesce("w.status", F.lit("observed")).alias("status"))


def dataset_coverage(cells: DataFrame, key: str) -> DataFrame:
    """(level, name, n_cells, n_values, n_rows) of cells (key, category, feature_name, value) by feature, by category, and in all: n_rows counts keys with any value."""
    has = F.when(F.col("value").isNotNull(), F.col(key))
    found = cells.groupingSets([["feature_name"], ["category"], []], "feature_name", "category").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count("value").alias("n_values"), F.countDistinct(has).alias("n_rows"), F.grouping_id("feature_name", "category").alias("_level")
    )
    level = F.when(F.col("_level") == 1, "feature").when(F.col("_level") == 2, "category").otherwise("all")
    return found.select(level.alias("level"), F.coalesce("feature_name", "category", F.lit("all")).alias("name"), "n_cells", "n_values", "n_rows")


def null_reasons(cells: DataFrame, reason: Column) -> DataFrame:
    """(level, name, reason, n) of the null cells of completed categories, by category and by feature; cells has category_status."""
    nulls = cells.where((F.col("category_status") == "completed") & F.col("value").isNull()).withColumn("reason", reason)
    found = nulls.groupingSets([["category", "reason"], ["feature_name", "reason"]], "category", "feature_name", "reason").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.when(F.col("category").isNotNull(), "category").otherwise("feature").alias("level"), F.coalesce("category", "feature_name").alias("name"), "reason", "n")


def active_coverage(long: DataFrame, key: str, active: DataFrame) -> DataFrame:
    """(key, category, n_active, n_available, missing) for the features that a model uses (feature_name, category; a fixed list); features that a key has no row for are missing."""
    have = long.where("value is not null").select(key, "feature_name").distinct()
    every = long.select(key).distinct().crossJoin(F.broadcast(active))  # a few rows for each key: the model's features
    both = every.join(have.withColumn("_have", F.lit(True)), [key, "feature_name"], "left")
    return both.groupBy(key, "category").agg(
        F.count(F.lit(1)).alias("n_active"), F.count("_have").alias("n_available"),
        F.array_sort(F.collect_list(F.when(F.col("_have").isNull(), F.col("feature_name")))).alias("missing"),
    )


def usable_labels(labels: DataFrame, companies: DataFrame, numeric: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts by target, unmatched labels): labels of known companies, and those among them with any numeric feature; labels without a company apart."""
    known = labels.join(companies.select("company_cik"), "company_cik", "left_semi")
    rich = numeric.where("value is not null").select("company_cik", F.lit(True).alias("_rich")).distinct()
    counts = known.join(rich, "company_cik", "left").groupBy("target").agg(F.count(F.lit(1)).alias("n_labels"), F.count("_rich").alias("n_usable"), F.countDistinct("company_cik").alias("n_companies"))
    return counts, labels.join(companies.select("company_cik"), "company_cik", "left_anti")


def usage_statuses(incoming: Column, outgoing: Column, total: Column, cached: Column, reasoning: Column) -> Column:
    """What a report of token counts is worth: consistent totals, cached no more than incoming, reasoning no more than outgoing, and the answer that is left."""
    ok = lambda c, most: F.when(c.isNull(), "unreported").when(c <= most, "reported").otherwise("reported_inconsistent")
    return F.struct(
        F.when(total == incoming + outgoing, "reported_consistent").otherwise("reported_inconsistent").alias("total_status"), ok(cached, incoming).alias("cached_status"),
        ok(reasoning, outgoing).alias("reasoning_status"), F.when(reasoning <= outgoing, outgoing - reasoning).alias("answer_tokens"),
    )


def evidence_links(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows (company_cik, document_id, sha256) with the link only where the document has the same company and hash; else it is null and warning says so."""
    known = documents.select(F.col("document_id").alias("_id"), F.col("company_cik").alias("_cik"), F.col("sha256").alias("_sha"))
    both = rows.join(known, F.col("document_id") == F.col("_id"), "left")
    same = F.coalesce((F.col("company_cik") == F.col("_cik")) & (F.col("sha256") == F.col("_sha")), F.lit(False))
    return both.select(
        *[c for c in rows.columns if c != "document_id"], F.when(same, F.col("document_id")).alias("document_id"),
        F.when(F.col("document_id").isNotNull() & ~same, "unverified_document").alias("warning"),
    )


def largest_changes(before: DataFrame, after: DataFrame, key: str, n: int = 3, least: float = 1e-8) -> DataFrame:
    """(key, place, feature_name, delta): the n features whose contributions (key, feature_name, contribution) change most, largest first; those before that are absent count as zero."""
    was = before.select(key, "feature_name", F.col("contribution").alias("_was"))
    delta = F.col("contribution") - F.coalesce("_was", F.lit(0.0))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("delta").desc(), "feature_name"))
    return after.join(was, [key, "feature_name"], "left").select(key, "feature_name", delta.alias("delta")).withColumn("place", place).where((F.col("place") <= n) & (F.abs("delta") > least))


def company_page(companies: DataFrame, search: str, industry: str | None, order: str, descending: bool, limit: int) -> DataFrame:
    """The first rows of a sorted, filtered catalog, each with the total of matches: a literal, case-blind part of name, ticker or id.

    The limit is a top-k over partitions; the total is one count beside it, so no window brings all rows together.
    """
    held = F.lit(False)
    for c in ("company_name", "ticker", "company_cik"):
        held = held | F.lower(c).contains(search.lower())
    found = companies.where(held) if search else companies
    found = found.where(F.col("industry") == industry) if industry is not None else found
    by = F.lower(order) if dict(companies.dtypes)[order] == "string" else F.col(order)
    total = F.broadcast(found.agg(F.count(F.lit(1)).alias("total")))  # one row
    return found.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), "company_cik").limit(limit).crossJoin(total)


def requested_rows(requested: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of requested (position, key) in their order, with is_known; each id that the rows lack stays with nulls."""
    known = rows.select("*", F.lit(True).alias("_known"))
    return requested.join(known, key, "left").withColumn("is_known", F.coalesce("_known", F.lit(False))).drop("_known")


def scenario_issue(value: Column, data_type: Column, unit: Column, may_be_negative: Column) -> Column:
    """The first rule that a hypothetical value breaks, or null: finite, editable, whole for counts, a year, a percentage, not negative."""
    whole = (data_type == "integer") | (unit == "count")
    return (
        F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "not_finite").when(whole & (value != F.floor(value)), "not_whole").when(~whole & (data_type != "number"), "not_editable")
        .when((unit == "year") & ~value.between(1900, 2100), "year_out_of_range").when((unit == "percent") & ~value.between(0, 100), "percent_out_of_range")
        .when(~may_be_negative & (value < 0), "negative")
    )


def unseen_categories(rows: DataFrame, trained: DataFrame, category: str) -> DataFrame:
    """rows with a warning where their category is none that a model was trained on; a null category is unseen too."""
    seen = trained.select(F.col(category).alias("_seen")).where("_seen is not null").distinct()
    return rows.join(seen, F.col(category) == F.col("_seen"), "left").withColumn("warning", F.when(F.col("_seen").isNull(), "unseen_category")).drop("_seen")


def observations_applied(coverage: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(coverage with score and outcome, unused observations): an observation counts where provider id, name and url all agree."""
    seen = observations.select("provider_id", F.col("name").alias("_name"), F.col("url").alias("_url"), F.col("score").alias("_score"))
    both = coverage.join(seen, "provider_id", "left")
    outcome = F.when(F.col("_name").isNull(), "not_observed").when(F.col("name") != F.col("_name"), "name_differs").when(F.col("url") != F.col("_url"), "url_differs").otherwise("applied")
    applied = both.withColumn("outcome", outcome).withColumn("score", F.when(F.col("outcome") == "applied", F.col("_score"))).drop("_name", "_url", "_score")
    return applied, observations.join(coverage.select("provider_id"), "provider_id", "left_anti")
