"""Source reviews, receipts of extraction runs, links of pages, cohorts, reference rows and model inputs: their checks, states and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.functions.text import broken_rules
from datelore.operators.asof import derived_ratios

#: What a review may say of its document; how a note begins that names the listing a review was built from; categories with weights.
REVIEW_STATUSES = ("latest_verified", "newer_available", "unknown")
LISTING_NOTE = "listing sha256: "
WEIGHTED = ("financial", "social", "environmental", "climate_target", "financial_target")


def review_issues(days: int = 30) -> Column:
    """The rules that a review (status, sha256, checked_at, valid_until, candidate_url) breaks: a known status, a lower-case hash, a window that is
    not empty and not longer than so many days, and a newer document named exactly where the status says that there is one."""
    checked, until = F.col("checked_at"), F.col("valid_until")
    return broken_rules({
        "status": F.col("status").isin(*REVIEW_STATUSES), "sha256": F.col("sha256").rlike("^[0-9a-f]{64}$"),
        "window": (until > checked) & (until <= checked + F.expr(f"interval {days} days")),
        "candidate": F.col("candidate_url").isNotNull() == F.coalesce(F.col("status") == "newer_available", F.lit(False)),
    })


def review_refreshed(listing_sha: Column, checked_at: Column, notes: Column, assessments: Column, proven: Column, days: int = 7) -> Column:
    """A review built from a listing: good for so many days; old notes stay but for those of an older listing; the assessments that the
    filing proves replace the ones of the same category. Null notes and assessments count as empty."""
    kept = F.filter(F.coalesce(notes, F.array().cast("array<string>")), lambda n: n.isNotNull() & ~F.startswith(n, F.lit(LISTING_NOTE)))
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(assessments, none), F.coalesce(proven, none)
    rest = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.struct(
        F.lit("latest_verified").alias("status"), (checked_at + F.expr(f"interval {days} days")).alias("valid_until"),
        F.concat(kept, F.array(F.concat(F.lit(LISTING_NOTE), listing_sha))).alias("notes"), F.map_concat(rest, new).alias("assessments"),
    )


def processing_status(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, has_result, last_id, saved_id, saved_fields) of attempts (attempt_id, started_at, status, fields; fields is null without a result).

    The last attempt and the last good one are told apart: a result that is there stays served while a newer attempt runs or fails.
    """
    when = F.struct("started_at", "attempt_id")
    row = F.struct("attempt_id", "status", "fields")
    good = F.col("fields").isNotNull()
    found = attempts.groupBy(*keys).agg(F.max_by(row, when).alias("l"), F.max_by(F.when(good, row), F.when(good, when)).alias("s"))
    status = (
        F.when(F.col("l.fields").isNotNull(), "completed").when(F.col("l.status") == "running", "processing").when(F.col("s").isNotNull(), "completed").otherwise("needs_review")
    )
    return found.select(*keys, status.alias("status"), F.col("s").isNotNull().alias("has_result"), F.col("l.attempt_id").alias("last_id"), F.col("s.attempt_id").alias("saved_id"), F.col("s.fields").alias("saved_fields"))


def receipts_matched(receipts: DataFrame, documents: DataFrame) -> DataFrame:
    """Receipts whose document has the same id, company and hash; the others are dropped, null never matching."""
    return receipts.join(documents.select("document_id", "company", "sha256").distinct(), ["document_id", "company", "sha256"], "left_semi")


def checks_passed(status: Column, source_checks: Column, asked: Column, reviewed: Column, judgments: Column, n_judgments: int) -> Column:
    """True where the local checks passed and, unless no model review was asked for, all judgments are there and accepted.

    Without a review asked for there may be none. A null judgment is not accepted; reviewed null counts as true where asked.
    """
    local = F.coalesce((status == "passed") & source_checks, F.lit(False))
    all_in = (F.size(judgments) == n_judgments) & F.forall(judgments, lambda j: F.coalesce(j, F.lit(False)))
    none = ~F.coalesce(reviewed, F.lit(True)) & (F.size(judgments) == 0)
    return local & F.coalesce(F.when(~F.coalesce(asked, F.lit(True)), none).otherwise(all_in & F.coalesce(reviewed, F.lit(True))), F.lit(False))


def public_part(evidence: Column, allowed: tuple[str, ...]) -> Column:
    """The entries of a map whose keys may be shown; nested maps go through it too, one call each."""
    return F.map_filter(evidence, lambda k, _: k.isin(*allowed))


def field_status(value: Column, has_details: Column, stated: Column, category_status: Column) -> tuple[Column, Column]:
    """(status, reason) of a field: what it says of itself; else whether its value is there; without details what its category says."""
    told = F.when(has_details, F.coalesce(stated, F.when(value.isNotNull(), "available").otherwise("not_disclosed"))).otherwise(F.coalesce(category_status, F.lit("not_started")))
    unread = category_status.isNotNull() & (category_status != "completed")
    return told, F.when(~has_details, F.when(unread, "category_not_extracted").otherwise("not_in_result"))


def bundle_coverage(cells: DataFrame) -> DataFrame:
    """(feature_name, n_available, n_missing, share, statuses, years) of cells (feature_name, value, status, reporting_year), with counts as 'name:n' lists in order."""
    counted = cells.groupBy("feature_name").agg(F.count("value").alias("n_available"), (F.count(F.lit(1)) - F.count("value")).alias("n_missing"))
    found = counted.withColumn("share", F.col("n_available") / (F.col("n_available") + F.col("n_missing")))
    for column, name in (("status", "statuses"), ("reporting_year", "years")):
        each = cells.where(F.col(column).isNotNull()).groupBy("feature_name", F.col(column).cast("string").alias("k")).count()
        lists = each.groupBy("feature_name").agg(F.array_sort(F.collect_list(F.concat_ws(":", "k", F.col("count").cast("string")))).alias(name))  # one entry for each status or year
        found = found.join(lists, "feature_name", "left")
    return found


def typed_distinct(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, n_distinct) over columns of which one is filled in a row: true, 1 and '1' are three values. Rows without a value are not counted."""
    one = F.coalesce(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in values])
    return rows.groupBy(*keys).agg(F.countDistinct(one).alias("n_distinct"))


def weights_checked(weights: DataFrame, key: str, low: float = 0.0, high: float = 3.0) -> DataFrame:
    """(key, category, weight, issue) for each weighted category, 1 where none is given; a weight out of range and a category that has no weights are issues."""
    told = weights.withColumn("_given", F.lit(True))
    every = weights.select(key).distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in WEIGHTED])))  # five rows for each key
    both = every.withColumn("_known", F.lit(True)).join(told, [key, "category"], "full_outer")
    weight = F.when(F.col("_given").isNull(), F.lit(1.0)).otherwise(F.col("weight"))
    issue = F.when(F.col("_known").isNull(), "unknown_category").when(~F.coalesce(weight.between(low, high) & ~F.isnan(weight), F.lit(False)), "out_of_range")
    return both.select(key, "category", weight.alias("weight"), issue.alias("issue"))


def cohort(companies: DataFrame, key: str, ids: DataFrame | None = None, industry: str | None = None) -> DataFrame:
    """The companies asked for: those of a table of ids (repeats count once), of an industry, or all. An empty result is the caller's error to raise."""
    found = companies if ids is None else companies.join(ids.select(key), key, "left_semi")
    return found if industry is None else found.where(F.col("industry") == industry)


def report_categories(pages: DataFrame, key: str, title: str, topics: dict[str, tuple[str, tuple[str, ...]]], width: int = 180) -> DataFrame:
    """(key, category, page, quote): the first page of a report whose text fits all patterns of a category that the title's pattern names.

    pages has key, page, title and text; topics gives each category its title pattern and its text patterns (for Java's regular expressions).
    """
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    marks = []
    for name, (named, needed) in topics.items():
        fits = F.col(title).rlike(named)
        for p in needed:
            fits = fits & F.col("_flat").rlike(p)
        marks.append(F.when(fits, F.struct(F.lit(name).alias("category"), F.regexp_extract("_flat", f"(?:{needed[0]}).{{0,{width}}}", 0).alias("quote"))))
    found = pages.withColumn("_flat", flat).select(key, "page", F.explode(F.array_compact(F.array(*marks))).alias("m"))
    first = found.groupBy(key, "m.category").agg(F.min_by(F.struct("page", F.col("m.quote").alias("quote")), "page").alias("f"))
    return first.select(key, "category", "f.page", "f.quote")


def anchors(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, base host, place, url, words) of the links of a page, resolved for absolute and rooted addresses and cut at '#'; the first place of equal ones."""
    tag = r"""<a[^>]*?href="([^"#]*)[^"]*"[^>]*>([^<]*)</a>"""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(tag), 1).alias("href"), F.regexp_extract_all(html, F.lit(tag), 2).alias("words"))
    root = F.regexp_extract(url, r"^https?://[^/?#]*", 0)
    links = pages.select(key, root.alias("_root"), F.posexplode(both).alias("place", "a"))
    target = F.when(F.col("a.href").rlike("^https?://"), F.col("a.href")).when(F.col("a.href").rlike("^/(?!/)"), F.concat("_root", "a.href"))
    made = links.select(key, F.regexp_replace("_root", "^https?://", "").alias("host"), "place", target.alias("url"), F.col("a.words").alias("words")).where("url is not null")
    return made.groupBy(key, "host", "url").agg(F.min_by(F.struct("place", "words"), "place").alias("f")).select(key, "host", "url", "f.place", "f.words")


def link_scope(links: DataFrame, key: str, allowance: int) -> DataFrame:
    """links (key, host, url, place) with scope: outside where neither the host is the page's own nor the path a PDF's; else read for the first so many, unread for the rest."""
    path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    inside = F.lower(path).endswith(".pdf") | (F.regexp_extract("url", r"^https?://([^/?#]*)", 1) == F.col("host"))
    order = F.row_number().over(Window.partitionBy(key, inside).orderBy("place", "url"))
    return links.withColumn("scope", F.when(~inside, "outside").when(order <= allowance, "read").otherwise("unread"))


def relevant_links(links: DataFrame, topic: str, document: str) -> DataFrame:
    """links (host, url, words) that speak of a topic: kind report for PDFs or other hosts with a document word, page for the issuer's own host; year is the latest one named."""
    said = F.lower(F.concat_ws(" ", "words", "url"))
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    own = (host == F.col("host")) | F.endswith(host, F.concat(F.lit("."), F.col("host")))
    pdf = F.lower(F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)).endswith(".pdf")
    kind = F.when((pdf | ~own) & said.rlike(topic) & said.rlike(document), "report").when(own & ~pdf & said.rlike(topic), "page")
    year = F.array_max(F.transform(F.regexp_extract_all(said, F.lit("(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), 1), lambda y: y.cast("int")))
    return links.withColumns({"kind": kind, "year": year}).where("kind is not null")


def with_source_dates(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """documents (document_id, company, sha256) with the publication date of the newest review (checked_at, then the date) of the same company and hash that has one."""
    dated = reviews.where("publication_date is not null").groupBy("company", "sha256").agg(F.max_by("publication_date", F.struct("checked_at", "publication_date")).alias("publication_date"))
    return documents.join(dated, ["company", "sha256"], "left")


def with_reference(rows: DataFrame, reference: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the reference's columns, or nulls; reference rows that no row uses). The reference has one row for each key."""
    return rows.join(reference, key, "left"), reference.join(rows.select(key), key, "left_anti")


def targets_grouped(companies: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, n_targets, targets): the targets (target_id, status, wording) of each company that has any, by id. A company's targets are few: a workbook's rows."""
    known = targets.join(companies.select(key).distinct(), key, "left_semi")
    return known.groupBy(key).agg(F.count(F.lit(1)).alias("n_targets"), F.array_sort(F.collect_list(F.struct("target_id", "status", "wording"))).alias("targets"))


def baseline_years(years: DataFrame, key: str, since: int) -> DataFrame:
    """years (key, year, whole, part_1, part_2) with the nearest earlier year, from since on, that has the whole or else both parts, and that year's value.

    One window over each key's years carries the last usable row; a zero is a value.
    """
    value = F.coalesce(F.col("whole"), F.col("part_1") + F.col("part_2"))
    usable = F.when(value.isNotNull() & (F.col("year") >= since), F.struct(F.col("year").alias("y"), value.alias("v")))
    before = Window.partitionBy(key).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    return years.withColumn("_b", F.last(usable, ignorenulls=True).over(before)).withColumns({"baseline_year": F.col("_b.y"), "baseline": F.col("_b.v")}).drop("_b")


def best_sources(sources: DataFrame, keys: list[str]) -> DataFrame:
    """The source of each key that is verified before unknown before outdated, then newest, then a PDF, then of the highest id; sources without a document are left out."""
    rank = F.when(F.col("freshness") == "latest_verified", 3).when(F.col("freshness") == "unknown", 2).when(F.col("freshness") == "newer_available", 1).otherwise(0)
    order = F.struct(rank.alias("a"), F.coalesce("dated", F.lit("")).alias("b"), F.coalesce(F.contains("content_type", F.lit("pdf")), F.lit(False)).alias("c"), F.col("document_id").alias("d"))
    rest = [c for c in sources.columns if c not in keys]
    return sources.where("document_id is not null").groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(*keys, "_s.*")


def candidates_ranked(candidates: DataFrame, key: str, families: tuple[str, ...]) -> DataFrame:
    """candidates (key, family, dated, year, title, asset_id) with their place: families in the order given, others last, then newest date, year and title."""
    known = F.nullif(F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")), F.lit(0).cast("long"))
    order = [F.coalesce(known, F.lit(len(families) + 1).cast("long")).asc(), F.col("dated").desc_nulls_last(), F.col("year").desc_nulls_last(), F.lower("title"), F.col("asset_id")]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def ambiguous_statuses(status: Column, reason: Column, ambiguous: tuple[str, ...]) -> Column:
    """Which of the ambiguous statuses a missing value has: its own, those that its reason's words hold, or unspecified_null where both are empty."""
    name = lambda c: F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit("_"))
    own, why = name(status), name(reason)
    held = [F.when((own == a) | (F.contains(why, F.lit(a)) if a != "unspecified_null" else (own == "") & (why == "")), F.lit(a)) for a in sorted(ambiguous)]
    return F.array_compact(F.array(*held))


def united(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of several structured sources under one schema, with the name of their source; columns that a source lacks are null."""
    frames = [df.withColumn("origin", F.lit(name)) for name, df in sources.items()]
    found = frames[0]
    for df in frames[1:]:
        found = found.unionByName(df, allowMissingColumns=True)
    return found


def feature_catalog(companies: DataFrame, results: DataFrame, key: str, fields: list[str], money: str = "usd") -> DataFrame:
    """One row for each company with all fields, null where absent, and the fields whose money is in another unit: their value is null too. results has key, feature_name, value, unit."""
    fit = F.col("unit") == money
    wide = results.groupBy(key).pivot("feature_name", fields).agg(F.first(F.when(fit, F.col("value")), ignorenulls=True))
    other = results.where(~fit & F.col("value").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("feature_name")).alias("other_unit"))
    return companies.join(wide, key, "left").join(other, key, "left").withColumn("other_unit", F.coalesce("other_unit", F.array().cast("array<string>")))


def catalog_cells(catalog: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The catalog's cells as observations (key, feature_name, value, missing_reason), a null with the reason why."""
    long = catalog.select(key, "other_unit", *fields).unpivot([key, "other_unit"], fields, "feature_name", "value")
    reason = F.when(F.col("value").isNull(), F.when(F.array_contains("other_unit", F.col("feature_name")), "other_unit").otherwise("not_extracted"))
    return long.select(key, "feature_name", "value", reason.alias("missing_reason"))


def model_inputs(rows: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """rows with text columns made numbers (missing stays null) and categories (trimmed, Unknown where empty); issues names the numeric columns whose text is no number."""
    read = {c: F.col(c).try_cast("double") for c in numeric}
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & x.isNull(), F.lit(c)) for c, x in read.items()]))
    named = {c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("Unknown")) for c in categorical}
    return rows.withColumns({"issues": bad, **read, **named})


def scenario_differences(long: DataFrame, changes: DataFrame, keys: list[str], ratios: list[tuple[str, str, str]]) -> DataFrame:
    """(keys, feature_name, original, scenario, difference) of ratios when some inputs (keys, feature_name, new_value) are replaced, a null clearing one.

    Only the primitives of long change; ratios are made anew from the rows of each variant, so that no ratio keeps an old input.
    """
    told = changes.withColumn("_told", F.lit(True))
    changed = long.join(told, [*keys, "feature_name"], "left").withColumn("value", F.when(F.col("_told"), F.col("new_value")).otherwise(F.col("value"))).select(*long.columns)
    both = long.withColumn("variant", F.lit("original")).unionByName(changed.withColumn("variant", F.lit("scenario")))
    made = derived_ratios(both, [*keys, "variant"], ratios)
    side = lambda v: F.max(F.when(F.col("variant") == v, F.col("value")))  # noqa: E731  one row for each variant
    found = made.groupBy(*keys, "feature_name").agg(side("original").alias("original"), side("scenario").alias("scenario"))
    return found.withColumn("difference", F.col("scenario") - F.col("original"))


def three_ranks(rows: DataFrame, cohort_key: str, key: str, variants: dict[str, str]) -> DataFrame:
    """(cohort, key, variant ranks): the rank of each row within its cohort by each variant's score, highest first, the key breaking ties.

    A cohort is a selection that is shown side by side, a few hundred rows; ranks over a whole table are ranking.ranked's.
    """
    place = {name: F.row_number().over(Window.partitionBy(cohort_key).orderBy(F.col(score).desc_nulls_last(), key)) for name, score in variants.items()}
    return rows.withColumns(place)


def preview_lines(texts: DataFrame, key: str, source: str, max_lines: int, max_chars: int) -> DataFrame:
    """(key, line_no, line, is_cut) of the first lines of each text, as long as all before them and the line breaks leave room; the last one may be cut. The limits are a preview's."""
    lines = texts.select(key, F.posexplode(F.slice(F.split(source, "\n"), 1, max_lines)).alias("pos", "line"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = lines.withColumn("_room", F.lit(max_chars) - before).where("_room > 0")
    return room.select(key, (F.col("pos") + 1).alias("line_no"), F.left("line", F.col("_room").cast("int")).alias("line"), (F.length("line") > F.col("_room")).alias("is_cut"))


def json_number(column: Column, path: str, kind: str = "double") -> Column:
    """The number at a path of JSON text; null where the text is no JSON, the path is absent or holds no number."""
    return F.get_json_object(column, path).try_cast(kind)


def children_json(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, children): the child rows of each key as a JSON list of objects in the order of their fields. A key's children are the few rows shown with it."""
    return rows.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("children"))
