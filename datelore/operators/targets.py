"""Climate targets as families of fields, judged by rules that are data: a name, the fields that it is for, and what the text has to say.

A family holds the fields of one target (its years, its reduction, its progress). What speaks against the target clears the whole family; what speaks against one
field clears that field. The first rule that fails is kept as the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.functions.phrases import has_word_from, says, spoken
from datelore.operators.claims import scopes_named

#: Fixed values, as tokens: what says that a target is no longer one; what names a part of a company, and what names all of it.
OVER = ("goal achieved", "target achieved", "expired", "withdrawn", "superseded", "cancelled", "canceled")
PARTS = ("facility", "site", "country", "region", "segment", "business unit")
LOCAL = (
    *(f"{part} {only}" for part in PARTS for only in ("specific", "level", "only")), *(f"{part}{s} target" for part in PARTS for s in ("", "s")),
    *(f"selected {parts}" for parts in ("facilities", "sites", "countries", "regions", "segments", "business units", "locations")),
)
GLOBAL = ("global", "company wide", "companywide", "entire business")
SUBSETS = ("category", "categories", "selected", "partial", "subset")
#: The attributes of a target; those whose quotes may stand for the family, the first first.
ATTRIBUTES = ("baseline_year", "target_year", "reduction_pct", "progress_pct", "sbti_validated")
ANCHORS = ("reduction_pct", "progress_pct", "target_year")


def _holds(said: Column, *parts: str) -> Column:
    """Whether a spoken text holds each of some strings, as parts of words too."""
    found = F.lit(True)
    for part in parts:
        found = found & F.contains(said, F.lit(part))
    return found


def _any(said: Column, *parts: str) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(said, F.lit(part))
    return found


@dataclass(frozen=True)
class Rule:
    """A reason, the names (as a condition on a family's or a field's name) that it is for, and the condition that the spoken text has to meet."""

    reason: str
    of: Callable[[Column], Column]
    holds: Callable[[Column], Column]


def _in(part: str, *longer: str) -> Callable[[Column], Column]:
    """Names with _part_ in them, but for those with a longer one."""
    found = lambda name: F.contains(F.concat(F.lit("_"), name, F.lit("_")), F.lit(f"_{part}_"))
    return lambda name: found(name) & ~F.coalesce(*[F.when(_in(x)(name), True) for x in longer], F.lit(False)) if longer else found(name)


def _named(said: Column, **wanted: bool) -> Column:
    of, found = scopes_named(said), F.lit(True)
    for name, is_wanted in wanted.items():
        found = found & (of[name] if is_wanted else ~of[name])
    return found


def _intensity(said: Column) -> Column:
    return _any(said, "intensity") | says(said, ["per unit"])


def _absolute(said: Column) -> Column:
    emissions = _any(said, "emission", "ghg") | says(said, ["co 2 e"])
    return _any(said, "absolute") | ~_intensity(said) & _holds(said, "reduc") & emissions


#: What a target's text has to say for the family that it is put in.
FAMILY_RULES = (
    Rule("several_scopes", lambda name: _in("scope")(name), lambda said: ~_named(said, joint=True, three=True)),
    Rule("not_scope_1_2_3", _in("scope_1_2_3"), lambda said: _named(said, joint=True, three=True)),
    Rule("not_scope_1_2", _in("scope_1_2", "scope_1_2_3"), lambda said: _named(said, joint=True, three=False)),
    Rule("not_scope_1_alone", _in("scope_1", "scope_1_2", "scope_1_2_3"), lambda said: _named(said, one=True, two=False, joint=False)),
    Rule("not_scope_2_alone", _in("scope_2"), lambda said: _named(said, two=True, one=False, joint=False)),
    Rule("not_scope_3", _in("scope_3"), lambda said: _named(said, three=True)),
    Rule("part_of_scope_3", _in("scope_3"), lambda said: ~says(said, SUBSETS)),
    Rule("not_absolute", _in("absolute_reduction"), lambda said: _absolute(said) & ~_intensity(said)),
    Rule("not_intensity", _in("intensity_reduction"), lambda said: _intensity(said) & ~_absolute(said)),
    Rule("not_net_zero", _in("net_zero"), lambda said: says(said, ["net zero", "netzero"])),
    Rule("not_carbon_neutral", _in("carbon_neutrality"), lambda said: says(said, ["carbon neutral", "carbon neutrality"])),
    Rule("not_renewable_electricity", _in("renewable_electricity"), lambda said: _holds(said, "renewable", "electricity")),
    Rule("no_supplier", _in("supplier_engagement"), lambda said: _holds(said, "supplier")),
)
#: What the text has to say for an attribute of a target.
ATTRIBUTE_RULES = (
    Rule("no_baseline", lambda name: name == "baseline_year", lambda said: says(said, ["baseline", "base year"]) | said.rlike(" from 20[0-9]{2} ")),
    Rule("no_reduction", lambda name: name == "reduction_pct", lambda said: _holds(said, "reduc")),
    Rule("no_progress", lambda name: name == "progress_pct", lambda said: says(said, ["progress", "achieved", "to date", "reduced by"])),
)
#: What the text has to say for a field that belongs to no target.
FIELD_RULES = (
    Rule("not_scope_1_alone", lambda name: name == "scope_1_tco2e", lambda said: _named(said, one=True, two=False, joint=False)),
    Rule("not_scope_2_market", lambda name: name == "scope_2_market_tco2e", lambda said: _named(said, two=True) & _holds(said, "market")),
    Rule("not_scope_2_location", lambda name: name == "scope_2_location_tco2e", lambda said: _named(said, two=True) & _holds(said, "location")),
    Rule("not_scope_3", lambda name: name == "scope_3_tco2e", lambda said: _named(said, three=True)),
    Rule("not_scope_1_2", lambda name: name == "scope_1_2_change_pct", lambda said: _named(said, joint=True)),
    Rule("not_scope_3_change", lambda name: name == "scope_3_change_pct", lambda said: _named(said, three=True) & ~_intensity(said)),
    Rule("not_intensity_change", lambda name: name == "ghg_intensity_change_pct", lambda said: _intensity(said) & (_any(said, "emission", "ghg") | says(said, ["co 2 e"]))),
    Rule("not_renewable_electricity", lambda name: name == "renewable_electricity_pct", lambda said: _holds(said, "renewable", "electricity")),
    Rule("not_net_zero", lambda name: name == "net_zero_target_year", lambda said: says(said, ["net zero", "netzero"])),
    Rule("not_validated", lambda name: name == "sbti_validated", lambda said: says(said, ["sbti", "science based targets initiative"]) & says(said, ["validated", "approved"])),
    Rule("not_assured", lambda name: name == "ghg_inventory_assured", lambda said: has_word_from(said, ("assur", "verified", "reviewed")) & _any(said, "emission", "ghg", "inventory")),
)


def first_broken(rules: tuple[Rule, ...], name: Column, said: Column) -> Column:
    """The reason of the first rule for a name that a spoken text breaks, null where none is."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        found = F.when(rule.of(name) & ~rule.holds(said), rule.reason).otherwise(found)
    return found


def targets_checked(fields: DataFrame, keys: list[str]) -> DataFrame:
    """fields (keys, family or null, name, value, quote, context, reporting_year) with the value null and an issue where its text does not support it.

    name is the attribute of a target (in a family) or a field of its own; context, where it is given, is a wider text about the value. A family is out where its
    target year does not lie after the reporting year, or one of its quotes says that the target is over. Shared attributes may rest on the family's strongest
    text: the first of the field's own and the quotes of reduction, progress and target year that the family's rules accept, else the field's own. Rules of the
    family, of locality and of the attribute follow, on that text. A null value has no issue. Families are groups of a handful of fields.
    """
    said = lambda c: spoken(F.col(c))
    told = fields.withColumns({"_quote": said("quote"), "_own": F.when(F.trim(F.coalesce("context", F.lit(""))) != "", said("context")).otherwise(said("quote"))})
    in_family = told.where("family is not null")
    year = F.max(F.when(F.col("name") == "target_year", F.col("value")))
    whole = in_family.groupBy(*keys, "family").agg(
        (year <= F.max("reporting_year")).alias("_late"), F.bool_or(says(F.col("_quote"), OVER)).alias("_over"),
        *[F.max(F.when(F.col("name") == a, F.col("_quote"))).alias(f"_{a}") for a in ANCHORS],
    )
    own = F.when(first_broken(FAMILY_RULES, F.col("family"), F.col("_own")).isNull(), F.col("_own"))
    others = [F.when((F.trim(f"_{a}") != "") & first_broken(FAMILY_RULES, F.col("family"), F.col(f"_{a}")).isNull(), F.col(f"_{a}")) for a in ANCHORS]
    both = told.join(whole, [*keys, "family"], "left").withColumn("_anchor", F.coalesce(own, *others, F.col("_quote")))
    local = says(F.col("_anchor"), LOCAL) & ~says(F.col("_anchor"), GLOBAL)
    no_family = F.col("family").isNull()
    net_zero_late = no_family & (F.col("name") == "net_zero_target_year") & (F.col("value") <= F.col("reporting_year"))
    net_zero_text = no_family & (F.col("name") == "net_zero_target_year")
    issue = (
        F.when(F.col("value").isNull(), None)
        .when(F.coalesce(F.col("_late"), F.lit(False)), "target_year_not_after_report").when(F.coalesce(F.col("_over"), F.lit(False)), "target_is_over")
        .when(~no_family & says(F.col("_anchor"), OVER), "target_is_over").when(~no_family & local, "local_target")
        .when(~no_family, F.coalesce(first_broken(FAMILY_RULES, F.col("family"), F.col("_anchor")), first_broken(ATTRIBUTE_RULES, F.col("name"), F.col("_own"))))
        .otherwise(F.coalesce(
            first_broken(FIELD_RULES, F.col("name"), F.col("_own")), F.when(net_zero_late, "target_year_not_after_report"),
            F.when(net_zero_text & says(F.col("_quote"), OVER), "target_is_over"), F.when(net_zero_text & says(F.col("_quote"), LOCAL) & ~says(F.col("_quote"), GLOBAL), "local_target"),
        ))
    )
    judged = both.withColumn("issue", issue)
    return judged.withColumn("value", F.when(F.col("issue").isNull(), F.col("value"))).select(*fields.columns, "issue")
