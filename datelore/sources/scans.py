"""Scans of landed publications: listings, sheets, score exports, receipts, and what pages embed. What is wrong stays as a row with its issues, next to what is right."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.functions.text import broken_rules, public_url
from datelore.sources.files import ExpectationError, expect

_LISTING = "GetContentAssetListResult array<struct<Type:string,FilePath:string,Title:string,FileType:string,ContentAssetDate:string,ContentAssetId:string,FileSize:string>>"
#: The fields and the score types of a licensed export, the years of its assessments.
SCORE_TYPES = ("csa_score", "esg_score", "environmental_score", "social_score", "governance_economic_score")
EXPORT_ROW = ("company_cik", "provider_cid", "provider_company_name", "industry", "score_type", "score_value", "score_under_review", "last_updated", "assessment_year")
EXPORT = ("provider", "license_reference", "fetched_at", "rows")
YEARS = (1999, 2100)
#: What a page's scripts hold where downloads are listed by a widget, and the kinds of assets that matter.
WIDGET_SCRIPTS = ("widgets.q4app.com", "q4.api.js", "q4.api.min.js", "q4-api.js", "q4_api.js", "q4api.js", "q4api.min.js")
WIDGET_YEARS = (2010, 2039)
ASSETS = ("sustainab", "responsib", "environment", "climate", "human rights", "social", "workforce", "employee", "people", "diversity", "impact")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_row, line) of text files, rows from 1 in each, without a mark at the start of a file; a file is one value here, as a sheet is."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r", "").alias("value"))
    return whole.select(F.posexplode(F.split("value", "\n")).alias("source_row", "line")).withColumn("source_row", F.col("source_row") + 1)


def sheet_rows(spark: SparkSession, path: str, required: list[str], identity: list[str]) -> DataFrame:
    """The rows of a sheet that landed as CSV, with source_row, its place in the sheet (from 1, the header's). Columns without a name are left out, blank rows too.

    A repeated name, a required column that is not there, a row without one of its identity columns or with more cells than the header, and a sheet without rows are errors.
    Cells do not hold line ends.
    """
    lines = _lines(spark, path)
    head = lines.where("source_row = 1").first()
    names = [] if head is None else [n.strip() for n in spark.range(1).select(F.split(F.lit(head.line), ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)").alias("n")).first().n]
    names = [n.strip('"').strip() for n in names]
    named = [n for n in names if n]
    if len(named) != len(set(named)):
        raise ExpectationError("a column name is repeated")
    if missing := sorted(set(required) - set(named)):
        raise ExpectationError(f"missing columns: {', '.join(missing)}")
    cells = F.from_csv("line", ", ".join(f"c{k} string" for k in range(len(names) + 1)), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    rows = lines.where("source_row > 1 and trim(line) <> ''").select("source_row", cells.alias("r"))
    rows = rows.select("source_row", F.col(f"r.c{len(names)}").alias("_more"), *[F.nullif(F.col(f"r.c{k}"), F.lit("")).alias(n) for k, n in enumerate(names) if n]).dropna(how="all", subset=named)
    there = {f"has_{c}": F.count_if(F.col(c).isNull()) == 0 for c in identity}
    return expect(rows, has_rows=F.count(F.lit(1)) > 0, no_overflow=F.count("_more") == 0, **there).drop("_more")


def classification_bundle(spark: SparkSession, path: str, columns: tuple[str, str, str, str], least: int, most: int, topic: str) -> tuple[DataFrame, DataFrame]:
    """(classifications, sources) of a folder of CSV files: classification.csv begins with these columns (ticker, name, sector, branch), sources.csv names those that speak of a topic.

    Tickers are there and unique, sectors and branches are there, rows are least to most, and exactly two public sources mention the topic; all else is an error.
    """
    ticker, _, sector, branch = columns
    rows = sheet_rows(spark, f"{path}/classification.csv", list(columns), [ticker, sector, branch])
    if tuple(rows.columns[1:5]) != columns:
        raise ExpectationError(f"classification.csv does not begin with {', '.join(columns)}")
    rows = expect(rows, unique_tickers=F.count(ticker) == F.countDistinct(ticker), count=F.count(F.lit(1)).between(least, most))
    sources = sheet_rows(spark, f"{path}/sources.csv", ["Source", "Publisher/Host", "URL", "Use"], ["Source"])
    about = sources.where(F.contains(F.coalesce("Use", F.lit("")), F.lit(topic)) | F.contains("Source", F.lit(topic)))
    about = expect(about, two_sources=F.count(F.lit(1)) == 2, public=F.coalesce(F.bool_and(F.coalesce(public_url(F.col("URL")), F.lit(False))), F.lit(False)))
    return rows.select(F.col(ticker).alias("ticker"), F.col(sector).alias("sector"), F.col(branch).alias("sub_industry")), about


def asset_listing(responses: DataFrame, keys: list[str], body: str, asset_type: str) -> DataFrame:
    """(keys, row, url, title, published, issue) of publishers' listings as JSON (body), a row for each asset of the wanted type (another column of responses).

    Rows count from 0 in their listing. invalid_date comes before invalid_pdf: an address that is no public one or no .pdf, another file type, or no title. A body that is no listing
    is one row with invalid_listing. Nothing is claimed of a period or a topic.
    """
    read = F.from_json(body, _LISTING).getField("GetContentAssetListResult")
    told = responses.select(*keys, F.lower(F.col(asset_type)).alias("_type"), read.alias("_rows"))
    none = F.lit(None).cast("string")
    bad = told.where("_rows is null").select(*keys, F.lit(None).cast("int").alias("row"), none.alias("url"), none.alias("title"), F.lit(None).cast("date").alias("published"), F.lit("invalid_listing").alias("issue"))
    each = told.select(*keys, "_type", F.posexplode("_rows").alias("row", "a")).where(F.lower(F.coalesce("a.Type", F.lit(""))) == F.col("_type"))
    day = F.when(F.col("a.ContentAssetDate").rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"), F.try_to_timestamp("a.ContentAssetDate", F.lit("M/d/yyyy H:m:s")).cast("date"))
    is_pdf = F.endswith(F.lower(F.regexp_extract(F.coalesce("a.FilePath", F.lit("")), "^[^?#]*", 0)), F.lit(".pdf")) & (F.lower(F.coalesce("a.FileType", F.lit(""))) == "pdf")
    good = is_pdf & public_url(F.coalesce("a.FilePath", F.lit(""))) & (F.trim(F.coalesce("a.Title", F.lit(""))) != "")
    issue = F.when(day.isNull(), "invalid_date").when(~good, "invalid_pdf")
    return bad.unionByName(each.select(*keys, "row", F.col("a.FilePath").alias("url"), F.trim("a.Title").alias("title"), day.alias("published"), issue.alias("issue")))


def download_widgets(pages: DataFrame, keys: list[str], html: str, url: str) -> DataFrame:
    """(keys, asset_type, all_years, min_year, origin) of the download widgets in pages with such scripts, public pages only, each relevant type once, its first widget."""
    small = F.lower(html)
    has = F.lit(False)
    for script in WIDGET_SCRIPTS:
        has = has | F.contains(small, F.lit(script))
    # a call is what follows the widget's name up to the first brace and bracket that end it; its options are pairs between commas outside of quotes
    follows = F.transform(F.split(F.regexp_replace(html, r"\}\s+\)", "})"), "[.]downloads"), lambda part: F.ltrim(F.translate(part, "\r\n\t", "   ")))
    inner = F.transform(F.slice(follows, F.lit(2), F.lit(1_000_000)), lambda x: F.when(F.startswith(x, F.lit("(")) & F.contains(x, F.lit("})")), F.ltrim(F.substring_index(F.substr(x, F.lit(2)), "})", 1))))
    calls = F.transform(F.filter(inner, lambda x: F.startswith(x, F.lit("{"))), lambda x: F.substr(x, F.lit(2)))
    told = pages.where(has & public_url(F.col(url))).select(*keys, F.regexp_extract(url, "^[^/]*//[^/?#]*", 0).alias("origin"), F.posexplode(calls).alias("_n", "_call"))
    pairs = F.transform(F.split("_call", ",(?=(?:[^'\"]*['\"][^'\"]*['\"])*[^'\"]*$)"), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.substring_index(x, ":", -1)).alias("value")))
    option = lambda key: F.get(F.filter(pairs, lambda p: p.key == key), F.lit(0)).value
    kind, quoted = option("downloadtype"), F.lit("'\"")
    is_quoted = F.contains(quoted, F.substring(kind, 1, 1)) & (F.substring(kind, 1, 1) == F.right(kind, F.lit(1))) & (F.length(kind) > 2)
    named = told.withColumn("asset_type", F.coalesce(F.when(is_quoted, F.trim(F.substring(kind, F.lit(2), F.length(kind) - 2))), F.lit("")))
    plain = F.regexp_replace(F.lower("asset_type"), r"[\s_-]+", " ")
    relevant = F.concat(F.lit(" "), F.regexp_replace(plain, "[^a-z0-9]", " "), F.lit(" ")).contains(" esg ")
    for word in ASSETS:
        relevant = relevant | F.contains(plain, F.lit(word)) | F.contains(F.replace(plain, F.lit(" ")), F.lit(word.replace(" ", "")))
    year = option("minyear").try_cast("int")
    found = named.where(relevant & (F.col("asset_type") != "")).withColumns({"all_years": F.coalesce(F.lower(option("fetchallyears")) == "true", F.lit(False)), "min_year": F.when(year.between(*WIDGET_YEARS), year), "_kind": F.lower("asset_type")})
    first = found.groupBy(*keys, "_kind").agg(F.min_by(F.struct("asset_type", "all_years", "min_year", "origin"), "_n").alias("w"))
    return first.select(*keys, "w.*")


def company_profiles(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, ticker, name, official_url, issue) from the first embedded JSON-LD of a Corporation in each page and the page's own ticker.

    no_profile, no_ticker, no_url and private_url say what is missing; scripts that are no JSON are passed over.
    """
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*\btype\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script"), F.lit(1))
    read = F.transform(scripts, lambda s: F.struct(F.get_json_object(s, "$['@type']").alias("kind"), F.get_json_object(s, "$.name").alias("name"), F.get_json_object(s, "$.url").alias("url")))
    of = F.get(F.filter(read, lambda r: r.kind == "Corporation"), F.lit(0))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    ticker = F.nullif(bare(F.regexp_extract(html, r"(?is)<span[^>]*\bclass\s*=\s*[\"'][^\"']*\bticker_name\b[^\"']*[\"'][^>]*>([^<]*)", 1)), F.lit(""))
    told = pages.select(*keys, of.alias("_of"), ticker.alias("ticker"))
    issue = F.when(F.col("_of").isNull(), "no_profile").when(F.col("ticker").isNull(), "no_ticker").when(F.coalesce("_of.url", F.lit("")) == "", "no_url").when(~public_url(F.col("_of.url")), "private_url")
    ok = issue.isNull()
    return told.select(*keys, F.when(ok, F.col("ticker")).alias("ticker"), F.when(ok, bare(F.coalesce("_of.name", F.lit("")))).alias("name"), F.when(ok, F.col("_of.url")).alias("official_url"), issue.alias("issue"))


def judged_exports(documents: DataFrame, keys: list[str], body: str, verified: DataFrame) -> DataFrame:
    """(keys, issues, rows) of licensed score exports as JSON (body), a row for each: an export with an issue has no rows (null). verified (company_cik, provider_cid, company_name) are the known identities.

    issues: fields (of the document, or of a row, other than the exact set), license, fetched_at (a time with its offset), identity, names, score_type, score_value (a number of 0 to 100), review
    (true, false or null), last_updated (a date), assessment_year (null or a year of YEARS), repeated. keys tell the documents apart; where one is null, identities count as unknown.
    An export is judged as one row, its rows as an array of it; only its distinct identities leave it, to meet the known ones.
    """
    names = lambda found, wanted: F.sort_array(found) == F.array(*map(F.lit, sorted(wanted)))
    who = ("company_cik", "provider_cid", "provider_company_name")
    # of a row, m has all values as text and t those that may not be text in JSON
    of_who, of_m, of_t = f"struct<{', '.join(f'{c}: string' for c in who)}>", "map<string,string>", "struct<score_value: double, score_under_review: boolean, assessment_year: bigint>"
    # an array that holds more than objects is read one by one, for its issues
    each = lambda found, kind: F.coalesce(found, F.transform(F.from_json("_b", "rows array<string>")["rows"], lambda r: F.from_json(r, kind)))
    rows_of = lambda kind: F.from_json("_b", f"rows array<{kind}>")["rows"]
    raw = documents.select(*keys, F.col(body).alias("_b"))
    told = raw.select(*keys, "_b", rows_of(of_who).alias("_w")).select(*keys, F.explode(F.array_distinct(F.transform(each(F.col("_w"), of_who), lambda r: F.to_json(r)))).alias("_who"))
    known = verified.select("company_cik", "provider_cid", F.col("company_name").alias("provider_company_name")).dropna().select(F.to_json(F.struct(*who)).alias("_who"))
    unknown = told.join(known, "_who", "left_anti").select(*keys).distinct().withColumn("_unknown", F.lit(True))
    read = raw.withColumns({"_fields": F.json_object_keys("_b"), "_f": F.from_json("_b", f"license_reference string, fetched_at string, rows array<{of_m}>"), "_t": rows_of(of_t)})
    rows = F.zip_with(each(F.col("_f.rows"), of_m), each(F.col("_t"), of_t), lambda m, t: F.struct(m.alias("m"), t.alias("t")))
    whole = F.col("_fields").isNotNull()  # of text that is no JSON nothing is read
    read = read.select(*keys, "_fields", F.when(whole, F.col("_f.license_reference")).alias("_right"), F.when(whole, F.col("_f.fetched_at")).alias("_at"), F.col("_f.rows").isNotNull().alias("_objects"), F.when(whole, rows).alias("_read"))
    read = read.join(unknown.hint("shuffle_hash"), keys, "left")  # keys only: a sort would carry the exports
    met = reduce(and_, [F.col(k).isNotNull() for k in keys], F.col("_unknown").isNull())
    rules = {
        "fields": lambda m, t: names(F.map_keys(m), EXPORT_ROW), "identity": lambda m, t: m["company_cik"].rlike("^[0-9]{10}$") & met, "names": lambda m, t: (F.trim(m["provider_company_name"]) != "") & (F.trim(m["industry"]) != ""),
        "score_type": lambda m, t: m["score_type"].isin(*SCORE_TYPES), "score_value": lambda m, t: t["score_value"].between(0, 100), "review": lambda m, t: t["score_under_review"].isNotNull() | (F.map_contains_key(m, "score_under_review") & m["score_under_review"].isNull()),
        "last_updated": lambda m, t: m["last_updated"].rlike(r"^\d{4}-\d\d-\d\d$") & m["last_updated"].try_cast("date").isNotNull(), "assessment_year": lambda m, t: m["assessment_year"].isNull() | t["assessment_year"].between(*YEARS),
    }
    by_all = lambda rule: F.forall("_read", lambda r: F.coalesce(rule(r["m"], r["t"]), F.lit(False)))
    of_rows = {name: by_all(rule) for name, rule in rules.items()}
    same = F.transform("_read", lambda r: F.to_json(F.array(*[r["m"][c] for c in ("company_cik", "provider_cid", "score_type", "assessment_year", "last_updated")])))
    rules = of_rows | {
        "fields": names(F.col("_fields"), EXPORT) & F.col("_objects") & of_rows["fields"], "license": F.trim("_right") != "",
        "fetched_at": F.col("_at").rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$") & F.col("_at").try_cast("timestamp").isNotNull(), "repeated": F.size(F.array_distinct(same)) == F.size("_read"),
    }
    # without an array nothing is said of rows but that fields are wrong
    rules = {name: holds if name in ("fields", "license", "fetched_at") else holds | F.col("_read").isNull() for name, holds in rules.items()}
    judged = read.select(*keys, "_read", F.sort_array(broken_rules(rules)).alias("issues"))
    clean = lambda m, t: F.struct(m["company_cik"].alias("company_cik"), m["provider_cid"].alias("provider_cid"), F.trim(m["provider_company_name"]).alias("provider_company_name"), F.trim(m["industry"]).alias("industry"), m["score_type"].alias("score_type"),
                                  t["score_value"].alias("score_value"), t["score_under_review"].alias("score_under_review"), m["last_updated"].try_cast("date").alias("last_updated"), t["assessment_year"].cast("int").alias("assessment_year"))
    return judged.select(*keys, "issues", F.when(F.size("issues") == 0, F.transform("_read", lambda r: clean(r["m"], r["t"]))).alias("rows"))


def score_export(documents: DataFrame, keys: list[str], body: str, verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of judged_exports: the rows of the exports without an issue, and (keys, issues) of all."""
    judged = judged_exports(documents, keys, body, verified)
    return judged.select(*keys, F.inline("rows")), judged.select(*keys, "issues")


_RECEIPT = "category string, version string, fresh_original_extraction boolean, document_id long, company_cik string, company_id string, source_sha256 string, status string, output_sha256 string"


def receipts(files: DataFrame, categories: tuple[str, ...], version: str) -> DataFrame:
    """(folder, category, document_id, company_cik, status, reason, data, evidence) of folders of receipt, data, validation and evidence files; files has (path, content).

    A folder without a receipt of a known category in this version, made afresh, with well-formed ids, is none. A receipt that says succeeded needs data with its hash and of its
    company, and checks that passed; else it becomes failed, with the reason, and the others are not touched. The files of a folder meet by a shuffle of their contents.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    roles = ("receipt", "data", "validation", "evidence")
    of = files.where(name.isin(*[f"{r}.json" for r in roles])).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.substring_index(name, ".", 1).alias("_role"), "content")
    by = of.groupBy("folder").pivot("_role", list(roles)).agg(F.first("content"))
    text = lambda c: F.col(c).try_cast("string")
    told = by.select("folder", F.from_json(text("receipt"), _RECEIPT).alias("r"), "data", text("data").alias("_data"), text("validation").alias("_v"), text("evidence").alias("evidence"))
    hash_ = F.lit("^[0-9a-f]{64}$")
    sound = F.col("r.category").isin(*categories) & (F.col("r.version") == version) & F.col("r.fresh_original_extraction") & F.col("r.document_id").isNotNull() & F.col("r.company_cik").rlike("^[0-9]{10}$") & F.regexp_like("r.source_sha256", hash_)
    checks = F.from_json("_v", "status string, schema_checks boolean, source_identity_checks boolean, source_quote_checks boolean")
    passed = (checks["status"] == "passed") & checks["schema_checks"] & checks["source_identity_checks"] & checks["source_quote_checks"]
    rules = {
        "no_data": F.col("data").isNotNull(), "data_changed": F.sha2("data", 256) == F.col("r.output_sha256"), "data_unreadable": F.try_parse_json("_data").isNotNull(),
        "other_company": F.get_json_object("_data", "$.company.ticker") == F.col("r.company_id"), "checks_not_passed": passed, "no_evidence": F.try_parse_json("evidence").isNotNull(),
    }
    succeeded = F.coalesce(F.col("r.status") == "succeeded", F.lit(False))
    reason = F.when(succeeded, F.get(broken_rules(rules), F.lit(0)))
    found = told.where(F.coalesce(sound, F.lit(False))).withColumn("reason", reason)
    good: Column = succeeded & F.col("reason").isNull()
    return found.select("folder", "r.category", "r.document_id", "r.company_cik", F.when(F.col("reason").isNotNull(), "failed").otherwise(F.col("r.status")).alias("status"), "reason", F.when(good, F.col("_data")).alias("data"), F.when(good, F.col("evidence")).alias("evidence"))
