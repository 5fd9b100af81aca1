"""Whether an extracted value may stand for its field: what its line says of scope and boundary, bounds, units, years; and which stored rows may be used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.functions import phrases, text
from datelore.functions.text import broken_rules

#: The emission scopes that a field's line has to name, and the word of its basis.
SCOPES = {"scope_1": ("1", ""), "scope_2_market": ("2", "market"), "scope_2_location": ("2", "location"), "scope_1_2_market": ("1&2", "market"), "scope_3_total": ("3", "")}
#: How two scopes are joined, and what names a part of scope 3.
JOINED = ("&", "+", "and")
PARTS_OF_SCOPE_3 = ("other scope 3", "selected scope 3", "partial scope 3", "scope 3 category", "scope 3 categories", *(f"category {n}" for n in range(1, 16)))
#: Each energy field's own quantity, the one that it is mistaken for, and the reason.
RIVALS = {
    "total_energy": ("total energy", "office energy", "office_is_not_total"),
    "renewable_energy": ("renewable energy", "renewable electricity", "electricity_is_not_energy"),
    "renewable_electricity": ("renewable electricity", "renewable energy", "energy_is_not_electricity"),
}
#: What names a part of renewable electricity, and what names the whole of it.
PARTS_OF_ELECTRICITY = (
    "on site", "onsite", "purchased renewable electricity", "acquired renewable electricity", "renewable energy certificate", "renewable energy certificates",
    "renewable electricity certificate", "renewable electricity certificates", "rec", "recs",
)
WHOLE_ELECTRICITY = ("total renewable electricity", "global renewable electricity", "renewable electricity consumed", "renewable electricity consumption")
#: What stands before a number that is a bound.
BOUND_BEFORE = ("<", ">", "≤", "≥", "at least", "at most", "more than", "less than", "greater than")


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value as a variable, so that the plan computes it once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def line_of(quote: Column, raw: Column) -> Column:
    """The one line of a quote that prints a number (digit groups apart), in lower case; the whole quote where no line or several do, or no number is given."""
    digits = lambda t: F.replace(t, F.lit(","), F.lit(""))
    wanted = digits(_plain(raw))
    held = F.filter(F.transform(F.split(quote, "\n"), _plain), lambda line: (wanted != "") & F.contains(digits(line), wanted))
    return F.when(F.size(held) == 1, F.get(held, F.lit(0))).otherwise(_plain(quote))


def scopes_named(said: Column) -> Column:
    """(joint, one, two, three): which scopes a spoken text names: the first two as one total, and each by itself."""
    joint = phrases.says(said, [f"scope 1 {sign} {second}" for sign in JOINED for second in ("2", "scope 2")])
    return F.struct(joint.alias("joint"), *[phrases.says(said, [f"scope {n}"]).alias(name) for n, name in ((1, "one"), (2, "two"), (3, "three"))])


def scope_issue(field: Column, quote: Column, raw: Column) -> Column:
    """Why a line does not establish an emission field, or null: another scope beside or instead of its own, another basis, or a part of scope 3. Other fields have no such rule."""

    def judged(said: Column) -> Column:
        of = scopes_named(said)
        named = F.when(of.joint, "1&2").otherwise(F.concat_ws(",", F.when(of.one, "1"), F.when(of.two, "2")))
        issue = F.when(~field.isin(*SCOPES), None)
        for name, (scope, basis) in SCOPES.items():
            if scope == "3":
                found = F.when(~of.three, "other_scope").when(phrases.says(said, PARTS_OF_SCOPE_3), "part_of_scope")
            else:
                found = F.when(named != scope, "other_scope").when(~F.contains(said, F.lit(basis)), "other_basis")
            issue = issue.when(field == name, found)
        return issue

    return _bound(phrases.spoken(line_of(quote, raw)), judged)


def boundary_issue(field: Column, quote: Column, note: Column, raw: Column) -> Column:
    """Why a quote (with its note) does not establish a point value of an energy field, or null: it gives a bound, speaks of another quantity only, or of a part."""
    printed, number = phrases.spoken(quote), phrases.spoken(raw)
    bare = lambda c: F.replace(c, F.lit(","), F.lit(""))
    ahead = F.concat(F.call_function("substring_index", bare(printed), bare(number), F.lit(1)), F.lit(" "))
    is_bound = F.lit(False)
    for words in BOUND_BEFORE:
        is_bound = is_bound | F.endswith(ahead, F.lit(f" {words} "))
    is_bound = (F.trim(number) != "") & F.contains(bare(printed), bare(number)) & is_bound

    def judged(said: Column) -> Column:
        issue = F.when(is_bound, "bound_is_not_a_point")
        for name, (own, rival, reason) in RIVALS.items():
            issue = issue.when((field == name) & phrases.says(said, [rival]) & ~phrases.says(said, [own]), reason)
        part = phrases.says(said, PARTS_OF_ELECTRICITY) & ~phrases.says(said, WHOLE_ELECTRICITY)
        return issue.when((field == "renewable_electricity") & part, "part_is_not_total")

    return _bound(phrases.spoken(F.concat_ws(" ", quote, note)), judged)


def physical_issue(value: Column, unit: Column, year: Column, common_year: Column, status: Column) -> Column:
    """(status, reason) as one struct for a physical quantity that is no actual one: a target, another year than the report's, negative, a share above 100; null where it stands."""
    conflict = lambda why: F.struct(F.lit("conflicting").alias("status"), F.lit(why).alias("reason"))
    target = F.struct(F.lit("not_applicable").alias("status"), F.lit("target").alias("reason"))
    return (
        F.when(value.isNull(), None).when(F.coalesce(status == "company_target", F.lit(False)), target).when(~year.eqNullSafe(common_year), conflict("other_year"))
        .when(value < 0, conflict("negative")).when((unit == "percent") & (value > 100), conflict("above_100"))
    )


def agrees(value: Column, *others: Column, whole: Column | None = None, tolerance: float = 1e-9) -> Column:
    """True where a value is that of all others within a tolerance, relative or absolute, and whole where asked; false where any is null."""
    ok = F.lit(True) if whole is None else ~whole | (value == F.floor(value))
    for x in others:
        ok = ok & (F.abs(value - x) <= F.greatest(F.lit(tolerance), F.greatest(F.abs(value), F.abs(x)) * tolerance))
    return F.coalesce(ok, F.lit(False))


def validated(rows: DataFrame, value: str, rules: dict[str, Column]) -> DataFrame:
    """rows whose value is null where a rule does not hold, with the first such rule as issue; a field that fails leaves the others as they are, and a null has no issue."""
    first = F.when(F.col(value).isNotNull(), F.get(broken_rules(rules), F.lit(0)))
    return rows.withColumn("issue", first).withColumn(value, F.when(F.col("issue").isNull(), F.col(value)))


def content_topics(html: Column, topics: dict[str, str]) -> Column:
    """The topics whose pattern the text of a page holds, in their order; tags are cut, entities stay as they are written."""
    said = _plain(F.regexp_replace(html, "<[^>]+>", " "))
    return F.array_compact(F.array(*[F.when(said.rlike(p), F.lit(name)) for name, p in topics.items()]))


def record_issues(year: Column, currency: Column, metrics: Column, counts: tuple[str, ...] = ("employees",)) -> Column:
    """The rules that a financial record breaks; metrics is an array of (name, value, unit, fiscal_year, status): a three-letter currency, one year,
    the record's currency (or employees) as unit, and a value with its unit exactly where the status says that there is one."""
    given = lambda m: F.coalesce(m.status.isin("reported", "calculated"), F.lit(False))
    unit = lambda m: F.when(m["name"].isin(*counts), m["name"]).otherwise(currency)
    return broken_rules({
        "currency": currency.rlike("^[A-Z]{3}$"), "fiscal_year": F.forall(metrics, lambda m: F.coalesce(m.fiscal_year == year, F.lit(False))),
        "unit": F.forall(metrics, lambda m: m.unit.isNull() | F.coalesce(m.unit == unit(m), F.lit(False))),
        "value": F.forall(metrics, lambda m: F.when(given(m), m.value.isNotNull() & m.unit.isNotNull()).otherwise(m.value.isNull())),
    })


def seeds_checked(seeds: DataFrame, companies: DataFrame, key: str, providers: tuple[str, ...]) -> DataFrame:
    """seeds (key, url, provider, document_id, context) with the rules that they break: a known company, named once, a public web address (text.public_url), a known provider, evidence."""
    known = companies.select(key, F.lit(True).alias("_known")).distinct()
    times = seeds.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rules = {
        "company": F.col("_known"), "repeated": F.col("_n") == 1, "url": text.public_url(F.col("url")),
        "provider": F.col("provider").isin(*providers), "evidence": (F.col("document_id") > 0) & (F.trim("context") != ""),
    }
    return seeds.join(known, key, "left").join(times, key, "left").withColumn("issues", broken_rules(rules)).drop("_known", "_n")


def newest_verified(documents: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """The newest document (keys, document_id, sha256, n_bytes) of each key whose stored bytes are there with that hash and length; bodies (sha256, n_bytes) are computed from what is stored."""
    stored = documents.join(bodies.select("sha256", "n_bytes").distinct(), ["sha256", "n_bytes"], "left_semi")
    return stored.groupBy(*keys).agg(F.max_by(F.struct("document_id", "sha256", "n_bytes"), "document_id").alias("d")).select(*keys, "d.*")


def scores_by_company(rows: DataFrame, key: str) -> DataFrame:
    """One row (key, state, score) for each well-formed id of ten digits; an id that stands on several rows is invalid, and only available scores are kept."""
    one = rows.where(F.col(key).rlike("^[0-9]{10}$")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first("state").alias("s"), F.first("score").alias("v"))
    state = F.when(F.col("n") > 1, "invalid").otherwise(F.col("s"))
    return one.select(key, state.alias("state"), F.when(state == "available", F.col("v")).alias("score"))
