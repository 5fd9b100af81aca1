"""Reported numbers grounded in their documents by an index of all numbers: values meet places by equality, no text is searched for a value.

The index has a row for each number of each block, with its line, place, and canonical value; a reported number is looked up by document, block and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.functions.text import broken_rules

NUMBER = r"(?<![0-9A-Za-z.,])[0-9][0-9,]*(?:\.[0-9]+)?(?![0-9]|[.,][0-9])"
_KIND = "decimal(38,6)"
#: The nine figures of a financial record; those that a sum of components may stand for.
METRICS = ("revenue", "operating_income", "net_income", "total_assets", "total_debt", "cash_and_equivalents", "operating_cash_flow", "capital_expenditure", "employees")
SUMMED = ("total_debt",)
#: Units of a calendar year, and words of a commitment that no zero may stand for, as they stand in a key or unit.
YEAR_UNITS = ("year", "target year", "calendar year")
COMMITMENTS = ("net_zero", "net zero", "net-zero", "carbon neutral", "carbon negative")


def canonical(raw: Column) -> Column:
    """The size of a printed number, whatever its digit groups, sign, brackets, currency and percent signs; null where it is no single number."""
    bare = F.translate(F.trim(raw), ",$€£¥%+ ", "")
    size = F.regexp_replace(F.regexp_replace(bare, r"^\((.*)\)$", "$1"), "^[-–−]", "")
    return F.when(size.rlike(r"^[0-9]+(\.[0-9]+)?$"), size.try_cast(_KIND))


def is_negative(raw: Column) -> Column:
    bare = F.translate(F.trim(raw), "$€£¥ ", "")
    return F.substring(bare, 1, 1).isin("-", "–", "−") | F.startswith(bare, F.lit("(")) & F.endswith(bare, F.lit(")"))


def number_index(blocks: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, line, offset, token, size) of every number in blocks (keys, text): lines from 1, offsets in their line from 0. A null text has none.

    All of it is column work where the block lies.
    """
    lines = blocks.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,token:string>>").alias("found"))

    def placed(state: Column, k: Column) -> Column:  # what lies between the numbers tells where each begins
        token, at = F.get(tokens, k), state["at"] + F.length(F.get(between, k))
        return F.struct((at + F.length(token)).cast("int").alias("at"), F.concat(state["found"], F.array(F.struct(at.cast("int").alias("offset"), token.alias("token")))).alias("found"))

    tokens, between = F.regexp_extract_all("line", F.lit(NUMBER), F.lit(0)), F.split("line", NUMBER, -1)
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    found = lines.where(F.col("line").rlike("[0-9]")).select(*keys, (F.col("line_no") + 1).alias("line_no"), "line", F.explode(F.aggregate(places, start, placed, lambda s: s["found"])).alias("n"))
    return found.select(*keys, "line_no", "line", "n.offset", "n.token", canonical(F.col("n.token")).alias("size"))


def metrics_grounded(metrics: DataFrame, index: DataFrame, keys: list[str], tolerance: float = 1e-8) -> DataFrame:
    """metrics (keys, name, unit, value, raw_value, scale, is_target) with value null and a reason where it is not grounded, else the line that prints it and the offset there.

    keys name the block that a metric cites. A target without a quantity is dropped first: a calendar year, no value or scale, a commitment written as zero, or a raw value that
    is no single number. Then raw times scale has to be the value, and the raw number has to stand in the block exactly once.
    """
    size, unit = canonical(F.col("raw_value")), F.lower(F.trim(F.coalesce("unit", F.lit(""))))
    vowed = F.lit(False)
    for word in COMMITMENTS:
        vowed = vowed | F.contains(F.lower(F.concat_ws(" ", "name", "unit")), F.lit(word))
    target = F.coalesce("is_target", F.lit(False))
    dropped = F.when(target & unit.isin(*YEAR_UNITS), "target_is_a_year").when(target & (F.col("value").isNull() | ~F.coalesce(F.col("scale") > 0, F.lit(False))), "target_without_quantity").when(
        target & (F.col("value") == 0) & vowed, "commitment_as_zero").when(target & size.isNull(), "target_without_number")
    told = metrics.withColumns({"_size": size, "_dropped": dropped})
    places = index.groupBy(*keys, F.col("size").alias("_size")).agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("line", "line_no", "offset"), F.struct("line_no", "offset")).alias("_place"))
    both = told.join(places, [*keys, "_size"], "left")
    signed = F.when(is_negative(F.col("raw_value")), -F.col("_size")).otherwise(F.col("_size")).cast("double") * F.col("scale")
    agrees = F.abs(signed - F.col("value")) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(signed), F.abs("value")))
    reason = (
        F.when(F.col("_dropped").isNotNull(), F.col("_dropped")).when(F.col("value").isNull(), None).when(F.col("_size").isNull(), "raw_value_is_no_number")
        .when(~F.coalesce(agrees, F.lit(False)), "raw_value_and_scale_disagree").when(F.col("_n").isNull(), "number_not_in_block").when(F.col("_n") > 1, "number_stands_twice")
    )
    told = both.withColumn("reason", reason)
    ok = F.col("reason").isNull() & F.col("value").isNotNull()
    return told.select(*metrics.columns[: len(metrics.columns)], "reason", *[F.when(ok, F.trim(F.col("_place")[c]) if c == "line" else F.col("_place")[c]).alias(c) for c in ("line", "line_no", "offset")]).withColumn(
        "value", F.when(F.col("reason").isNull(), F.col("value"))
    )


def records_checked(metrics: DataFrame, index: DataFrame, keys: list[str], names: tuple[str, ...] = METRICS, summed: tuple[str, ...] = SUMMED) -> DataFrame:
    """(keys, issues): what is wrong with the records of metrics (keys, name, status, value, scale, citations: array of block_id), by an index (keys, block_id, line_no, size).

    A record names each of its figures once. A reported value cites one block, which prints it (value over scale); a calculated one is allowed for summed figures only, and
    needs two or three cited blocks with a number each that add up to it; any other has neither value nor citation. An issue is "name: rule". The figures and the numbers
    of a record meet once, by its keys; a sum of three is tried as the numbers of one block against what each of the next leaves, so no array of pairs is made.
    """
    none = F.array().cast("array<string>")
    figures = metrics.groupBy(*keys).agg(F.collect_list(F.struct("name", "status", "value", "scale", "citations")).alias("_metrics"))
    numbers = index.where("size is not null and block_id is not null").groupBy(*keys).agg(F.collect_set(F.struct(F.col("block_id").alias("block"), F.col("size").alias("found"))).alias("_numbers"))
    both = figures.join(numbers, keys, "left")
    of_block = lambda block: F.transform(F.filter("_numbers", lambda x: x.block == block), lambda x: x.found)

    def adds_up(size: Column, blocks: Column) -> Column:
        first, second, last = (of_block(F.get(blocks, F.lit(k))) for k in (0, 1, 2))
        less = lambda x, y: (x - y).cast(_KIND)
        pair = F.arrays_overlap(F.transform(first, lambda x: less(size, x)), second)
        triple = F.exists(first, lambda x: F.arrays_overlap(F.transform(second, lambda y: less(less(size, x), y)), last))
        return F.when(F.size(blocks) == 2, pair).when(F.size(blocks) == 3, triple)

    def broken(m: Column) -> Column:
        n, status, given = F.size(F.coalesce(m.citations, none)), m.status, m.value.isNotNull()
        blocks = F.array_sort(F.array_distinct(F.filter(m.citations, lambda c: c.isNotNull())))  # a block that is cited twice has one number in a sum
        size = F.abs(F.try_divide(m.value.cast(_KIND), m.scale.cast(_KIND))).cast(_KIND)
        rules = {
            "citation": F.when(status == "reported", given & (n == 1)).when(status == "calculated", given & n.between(2, 3)).otherwise(~given & (n == 0)),
            "calculated": (status != "calculated") | m["name"].isin(*summed),
            "printed": (status != "reported") | ~given | (n != 1) | F.coalesce(F.array_contains(of_block(F.get(m.citations, F.lit(0))), size), F.lit(False)),
            "sum": (status != "calculated") | ~given | ~n.between(2, 3) | F.coalesce((F.size(blocks) == n) & adds_up(size, blocks), F.lit(False)),
        }
        return F.transform(broken_rules(rules), lambda r: F.concat_ws(": ", m["name"], r))

    per = both.select(*keys, F.flatten(F.transform("_metrics", broken)).alias("_all"), F.filter(F.transform("_metrics", lambda m: m["name"]), lambda name: name.isNotNull()).alias("_names"))
    wanted = F.array(*map(F.lit, names))
    shape = F.concat(
        F.transform(F.array_except(wanted, F.col("_names")), lambda n: F.concat(n, F.lit(": missing"))), F.transform(F.array_except(F.col("_names"), wanted), lambda n: F.concat(n, F.lit(": unknown"))),
        F.transform(F.filter(wanted, lambda n: F.size(F.filter("_names", lambda m: m == n)) > 1), lambda n: F.concat(n, F.lit(": repeated"))),
    )
    return per.select(*keys, F.array_sort(F.array_distinct(F.concat(shape, "_all"))).alias("issues"))
