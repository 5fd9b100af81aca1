"""Which row stands for a group: latest filings, best sources and pages, first excerpts and suggestions, merged and grouped rows, feature masks by fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The groups of filing forms that a listing is read for; the categories that each family of filings may speak for.
FORM_GROUPS = {"10-K": "annual", "20-F": "annual", "40-F": "annual", "10-Q": "quarterly", "DEF 14A": "proxy"}
FAMILY_CATEGORY = {"sec_annual_filing": "financial_report", "sec_quarterly_filing": "financial_report", "sec_proxy_statement": "social_employee"}
TARGET_CATEGORIES = ("financial_targets", "climate_targets")


def _mapped(column: Column, pairs: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), column)


def latest_filings(listing: DataFrame, key: str) -> DataFrame:
    """The newest filing (then the highest accession) of each key and group of forms; forms of no group are left out."""
    grouped = listing.withColumn("form_group", _mapped(F.col("form"), FORM_GROUPS)).where("form_group is not null")
    rest = [c for c in listing.columns if c != key]
    best = grouped.groupBy(key, "form_group").agg(F.max_by(F.struct(*rest), F.struct("filed", "accession")).alias("_best"))
    return best.select(key, "form_group", "_best.*")


def category_freshness(status: Column, family: Column, category: Column, assessed: Column, target_status: Column) -> Column:
    """What a review says of one category: a filing speaks only for its own category, and only where that was assessed; assessments that leave a category out
    say nothing of it; targets also need to be current. assessed is an array of categories, empty or null where none was assessed."""
    has = F.coalesce(F.array_contains(assessed, category), F.lit(False))
    some = F.coalesce(F.size(assessed), F.lit(0)) > 0
    silent = F.when(F.startswith(F.coalesce(family, F.lit("")), F.lit("sec_")), ~(F.coalesce(_mapped(family, FAMILY_CATEGORY) == category, F.lit(False)) & has)).otherwise(some & ~has)
    stale = category.isin(*TARGET_CATEGORIES) & ~F.coalesce(target_status == "current", F.lit(False))
    return F.when(F.coalesce(silent | stale, F.lit(True)), "unknown").otherwise(F.coalesce(status, F.lit("unknown")))


def sources_in_order(sources: DataFrame, key: str, url: str) -> DataFrame:
    """The newest document of each key and url, with its place: those with a document first, then by freshness, by date and by title."""
    rest = [c for c in sources.columns if c not in (key, url)]
    newest = sources.groupBy(key, url).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("document_id", F.lit(0)), "title")).alias("_s")).select(key, url, "_s.*")
    rank = F.when(F.col("freshness") == "latest_verified", 2).when(F.col("freshness") == "newer_available", 0).otherwise(1)
    order = [F.col("document_id").isNull(), rank.desc(), F.coalesce("dated", F.lit("")).desc(), F.col("title"), F.col(url)]
    return newest.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def family_pages(pages: DataFrame, key: str, page: str, source: str, families: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, family, page, n_hits): for each family of terms the page with most places of them, the earliest of equals. Texts are read once and not sent anywhere."""
    low = F.lower(F.col(source))
    places = lambda term: (F.length(low) - F.length(F.replace(low, F.lit(term)))) / len(term)
    hits = F.array(*[F.struct(F.lit(name).alias("family"), sum(map(places, terms), F.lit(0.0)).cast("long").alias("n")) for name, terms in families.items()])
    found = pages.select(key, page, F.explode(F.filter(hits, lambda h: h.n > 0)).alias("h"))
    return found.groupBy(key, "h.family").agg(F.max_by(page, F.struct(F.col("h.n"), -F.col(page))).alias(page), F.max("h.n").alias("n_hits"))


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key with their place: top candidates of a field, last checks of a company."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def excerpts_in_budget(rows: DataFrame, key: str, field: str, source: str, score: str, block: str, budget: int) -> DataFrame:
    """The best excerpt of each key and field (highest score, then first block), in the order of fields for as long as their lengths stay within a budget."""
    best = first_rows(rows, [key, field], [F.col(score).desc(), F.col(block)], 1).drop("place")
    running = F.sum(F.length(source)).over(Window.partitionBy(key).orderBy(field).rowsBetween(Window.unboundedPreceding, 0))
    return best.withColumn("used", running).where(F.col("used") <= budget)


def suggestions(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n suggestions of each key: where models agree, where the target is reached, by gap left, by known and small relative change, by label."""
    order = [~F.col("models_agree"), ~F.col("reaches_target"), F.abs("remaining_gap"), F.col("relative_change").isNull(), F.abs("relative_change"), F.col("label")]
    return first_rows(rows, keys, order, n)


def merged_chunks(rows: DataFrame, keys: list[str], name: str, year: Column) -> DataFrame:
    """Values from overlapping chunks: equal ones are one, different ones conflict and are all kept; a value of another year than the report's has the year in its name."""
    own = F.col("reporting_year").eqNullSafe(year) | year.isNull() | F.endswith(F.col(name), F.concat(F.lit("_"), F.coalesce(F.col("reporting_year").cast("string"), F.lit("none"))))
    named = rows.withColumn(name, F.when(own, F.col(name)).otherwise(F.concat_ws("_", name, F.coalesce(F.col("reporting_year").cast("string"), F.lit("none")))))
    found = named.groupBy(*keys, name).agg(F.array_sort(F.collect_set(F.struct("value", "unit", "reporting_year", "status"))).alias("candidates"))
    one = F.size("candidates") == 1
    first = F.get("candidates", F.lit(0))
    status = F.when(~one, "conflicting").when(first["status"] == "reported", "extracted").otherwise(first["status"])
    return found.select(*keys, name, F.when(one, first["value"]).alias("value"), status.alias("status"), F.size("candidates").alias("n_candidates"), "candidates")


def memberships(rows: DataFrame, key: str) -> DataFrame:
    """Symbols of each company in order; a company with several sectors has none, and says so."""
    found = rows.groupBy(key).agg(F.array_sort(F.collect_set("symbol")).alias("symbols"), F.min("sector").alias("_low"), F.max("sector").alias("_high"))
    return found.select(key, "symbols", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("sector"), F.when(F.col("_low") != F.col("_high"), "several_sectors").otherwise("ok").alias("status"))


def any_name_matched(names: DataFrame, candidates: DataFrame, key: str, name: str, found_id: str) -> DataFrame:
    """(key, id, status): a company whose names meet candidates of exactly one id; of several it is ambiguous, of none unmatched.

    Candidates are summed up by name before the join, so a name of many candidates adds one row for each company, not one for each pair.
    """
    by_name = candidates.groupBy(name).agg(F.min(found_id).alias("_low"), F.max(found_id).alias("_high"))
    low, high = F.min("_low"), F.max("_high")
    return names.join(by_name, name, "left").groupBy(key).agg(F.when(low == high, low).alias(found_id), F.when(low == high, "matched").when(low.isNotNull(), "ambiguous").otherwise("unmatched").alias("status"))


def aligned(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """For each row id how often it stands in each part, and whether it stands once in all: rows are joined by id, never by position."""
    every = None
    for name, part in parts.items():
        one = part.select(key, F.lit(name).alias("_part"))
        every = one if every is None else every.unionByName(one)
    found = every.groupBy(key).agg(*[F.count_if(F.col("_part") == name).alias(f"n_{name}") for name in parts])
    once = F.lit(True)
    for name in parts:
        once = once & (F.col(f"n_{name}") == 1)
    return found.withColumn("is_aligned", once & F.col(key).isNotNull())


def visible(documents: DataFrame, registered: DataFrame, cited: DataFrame, key: str) -> DataFrame:
    """Documents that are registered or cited: two semi joins, so that no OR stands in a join."""
    known = registered.select(key).unionByName(cited.select(key)).where(F.col(key).isNotNull()).distinct()
    return documents.join(known, key, "left_semi")


def attached(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Attachments (document_id, company, accession, url) that exactly one link of a wrapper of the same company and accession leads to: (document_id, wrapper_id, link_text).

    links has wrapper_id, company, accession, url, link_text; two links to one attachment prove nothing.
    """
    same = ["company", "accession", "url"]
    one = links.groupBy(*same).agg(F.count(F.lit(1)).alias("_n"), F.min("wrapper_id").alias("wrapper_id"), F.min("link_text").alias("link_text")).where("_n = 1")
    return documents.join(one, same).select("document_id", "wrapper_id", "link_text")


def label_value_pairs(lines: DataFrame, key: str, labels: Column, values: Column, reach: int) -> DataFrame:
    """(key, label_line, value_line): each label with the first value line within so many lines below it. One window over the lines of a key, no join of all pairs."""
    ahead = Window.partitionBy(key).orderBy("line_no").rangeBetween(1, reach)
    found = lines.withColumn("value_line", F.min(F.when(values, F.col("line_no"))).over(ahead))
    return found.where(labels & F.col("value_line").isNotNull()).select(key, F.col("line_no").alias("label_line"), "value_line")


def fold_masks(cells: DataFrame, registry: DataFrame, by: str, minimum: int, fraction: float, distinct: int, level: int, ambiguous: tuple[str, ...], most: float) -> DataFrame:
    """The features that each fold's training rows support, all folds in one aggregation, with the reasons against the others.

    cells has the fold, feature_name, value (a double; booleans as 0 and 1) and status of training rows only. The registry (feature_name, data_type) is a fixed list. A feature
    needs max(minimum, ceil(fraction * rows)) values; numbers need distinct ones, booleans `level` rows of each level; at most a share `most` of its rows may lack a value for a
    status that does not tell why.
    """
    told = cells.join(F.broadcast(registry), "feature_name")
    unclear = F.col("value").isNull() & F.coalesce(F.col("status"), F.lit("unspecified_null")).isin(*ambiguous)
    found = told.groupBy(by, "feature_name", "data_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.countDistinct("value").alias("n_distinct"),
        F.count_if(F.col("value") == 0).alias("n_false"), F.count_if(F.col("value") == 1).alias("n_true"), F.count_if(unclear).alias("n_unclear"),
    )
    need = F.greatest(F.lit(minimum), F.ceil(F.lit(fraction) * F.col("n_rows")))
    reasons = F.array_compact(F.array(
        F.when(F.col("n_values") < need, "too_few_values"), F.when(F.col("data_type").isin("number", "integer") & (F.col("n_distinct") < distinct), "too_few_different"),
        F.when((F.col("data_type") == "boolean") & (F.least("n_false", "n_true") < level), "level_too_rare"), F.when(F.col("n_unclear") > F.lit(most) * F.col("n_rows"), "too_many_unclear"),
    ))
    return found.withColumn("reasons", F.array_join(reasons, ",")).withColumn("is_active", F.col("reasons") == "").drop("n_false", "n_true")


def step_summary(rows: DataFrame, by: list[str], before: str, after: str, top: float) -> DataFrame:
    """Counts of one scenario step: rows, observed, missing, changed, at the top, and those that can still rise."""
    a, b = F.col(after), F.col(before)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(before).alias("n_observed"), F.count_if(b.isNull()).alias("n_missing"), F.count_if(~a.eqNullSafe(b)).alias("n_changed"),
        F.count_if(a == top).alias("n_top"), F.count_if((a > 0) & (a < top)).alias("n_can_rise"),
    )


def score_state(identity: Column, access: Column, outcome: Column, state: Column, score: Column, dated: Column, url: Column, provider: Column) -> Column:
    """What one row of a score listing is worth; a zero is a score. Only an available row of a matched company with a score from 0 to 100, an ISO date and its own id in its url counts."""
    told = F.coalesce(
        *[F.when((identity == name) | (outcome == name), F.lit(name)) for name in ("ambiguous", "unmatched")], F.when((access == "blocked") | (outcome == "access_blocked"), "access_blocked"),
        F.when(outcome == "not_checked", "not_checked"),
    )
    sure = (identity == "matched") & (access == "succeeded") & provider.rlike("^[1-9][0-9]*$") & (F.parse_url(url, F.lit("QUERY")) == F.concat(F.lit("cid="), provider))
    paid = (state == "premium_only") & (outcome == "blocked") & score.isNull()
    day = F.date_format(F.try_to_date(dated, "yyyy-MM-dd"), "yyyy-MM-dd") == dated
    good = (state == "available") & (outcome == "matched") & (score.isNull() | score.between(0, 100)) & (dated.isNull() | day)
    return F.coalesce(told, F.when(sure & paid, "premium_only"), F.when(sure & good, "available"), F.lit("invalid"))


def score_audit(rows: DataFrame, state: str) -> DataFrame:
    """Rows by state, with the number of scores and the first and last date among available ones."""
    ok = F.col(state) == "available"
    return rows.groupBy(state).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, F.col("score"))).alias("n_scores"), F.min(F.when(ok, F.col("dated"))).alias("first_date"), F.max(F.when(ok, F.col("dated"))).alias("last_date"))


def current_audit(cells: DataFrame, key: str) -> DataFrame:
    """(level, name, n_with, n_without): values by feature, and by category the keys of each reporting year and each status."""
    features = cells.groupBy(F.lit("feature").alias("level"), F.col("feature_name").alias("name")).agg(F.count("value").alias("n_with"), F.count_if(F.col("value").isNull()).alias("n_without"))
    by = lambda level, column: cells.groupBy(F.lit(level).alias("level"), F.concat_ws(":", "category", F.coalesce(F.col(column).cast("string"), F.lit("none"))).alias("name")).agg(
        F.countDistinct(F.when(F.col("value").isNotNull(), F.col(key))).alias("n_with"), (F.countDistinct(key) - F.countDistinct(F.when(F.col("value").isNotNull(), F.col(key)))).alias("n_without"))
    return features.unionByName(by("year", "reporting_year")).unionByName(by("status", "status"))
