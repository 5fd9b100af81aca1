"""How a report words its numbers: hedges, magnitudes, scales, bounds, decreases, and where a number is printed. All are Column expressions; null gives null."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from datelore.functions import phrases, text

#: Words and marks before a number that say it is not exact; numbers written as words; magnitudes and the signs that stand for them; words of a bound; words of a decrease.
HEDGES = ("approximately", "approx.", "approx", "about", "around", "roughly", "nearly", "over", "more than", "at least", "~", "≈", "<", ">", "≤", "≥")
WRITTEN = {"zero": 0.0, "one": 1.0}
MAGNITUDES = {"thousand": (1e3, "k"), "million": (1e6, "m"), "billion": (1e9, "bn")}
BOUNDS = ("at least", "at most", "more than", "less than")
DECREASES = ("reduc", "decreas", "fell", "lower", "↓")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value as a lambda's variable: an expression that names it often is not repeated in the plan."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: The longest hedge that a token begins with; a word has to end there.
_HEDGED = "(?i)^(?:" + "|".join(re.escape(h) + (r"(?![a-z0-9_\u212a])" if h[-1].isalpha() else "") for h in sorted(HEDGES, key=len, reverse=True)) + ")"


def hedged_number(raw: Column) -> Column:
    """The number of a copied token that may be a fiscal year (FY24, FY 2024), a number word, or stand behind one hedge; else null."""
    token = F.trim(raw)
    year = F.regexp_extract(token, r"(?i)^fy\s*['’]?(\d{4}|\d\d)$", 1).try_cast("double")
    written = F.coalesce(*[F.when(F.lower(token) == word, F.lit(number)) for word, number in WRITTEN.items()])
    return F.coalesce(F.when(year < 100, year + 2000).otherwise(year), written, text.reported_number(F.trim(F.regexp_replace(token, _HEDGED, ""))))


def magnitude(raw: Column) -> Column:
    """The factor that is written beside a number: a word, or its sign behind a digit; 1 where none is. The middle one of three is looked for first."""
    small = F.lower(raw)
    found = F.lit(None).cast("double")
    for word in ("million", "billion", "thousand"):
        factor, sign = MAGNITUDES[word]
        found = F.coalesce(found, F.when(small.rlike(rf"\b{word}\b|\d\s*{sign}\b"), F.lit(factor)))
    return F.when(raw.isNotNull(), F.coalesce(found, F.lit(1.0)))


def agreed_factor(of_unit: Column, of_number: Column) -> Column:
    """One factor from a unit's and a number's: the one that is not 1, or both where they agree; null where they do not."""
    same = F.abs(of_unit - of_number) <= F.greatest(F.abs(of_unit), F.abs(of_number)) * 1e-5
    return F.when((of_number == 1) | same, of_unit).when(of_unit == 1, of_number)


def quantity(raw: Column, unit: Column, factors: dict[str, tuple[str, str]]) -> Column:
    """(value, unit, status) in exact decimals for a table of units (name: (unit, factor)), whose names are in small letters; other units and numbers need review."""
    name = F.trim(F.regexp_replace(F.replace(F.lower(unit), F.lit("₂"), F.lit("2")), r"\s+", " "))
    digits = F.translate(raw, ",", "")
    groups = F.split(F.substring_index(F.regexp_replace(raw, "^[+-]", ""), ".", 1), ",")
    plain = digits.rlike(r"^[+-]?\d+(\.\d+)?$") & ~F.substring_index(raw, ".", -1).contains(",").eqNullSafe(raw.contains("."))
    grouped = (F.size(groups) == 1) | (F.length(F.get(groups, F.lit(0))).between(1, 3) & F.forall(F.slice(groups, F.lit(2), F.size(groups)), lambda g: F.length(g) == 3))
    value = target = F.lit(None).cast("string")
    for known, (to, factor) in factors.items():
        target = F.when(name == known, to).otherwise(target)
        value = F.when(name == known, F.lit(factor)).otherwise(value)
    found = digits.try_cast("decimal(26,6)") * value.cast("decimal(12,6)")
    ok = F.coalesce((plain | ~raw.contains(".") & digits.rlike(r"^[+-]?\d+$")) & grouped & found.isNotNull(), F.lit(False))
    return F.struct(F.when(ok, found).alias("value"), F.when(ok, target).alias("unit"), F.when(ok, "source_linked").otherwise("needs_review").alias("status"))


def _declarations(found: Column) -> Column:
    """The places (from 0) in an array of tokens where a magnitude is declared for the numbers of a text: right after "in", or a bracket, or a currency sign after "in"."""
    at = lambda k: F.get(found, k)
    names = [form for word in MAGNITUDES for form in (word, f"{word}s")]
    declared = lambda k: at(k - 1).isin("in", "(") | at(k - 1).isin("$", "€", "£", "¥") & (k > 1) & (at(k - 2) == "in")
    return F.filter(F.transform(found, lambda t, k: F.when(t.isin(*names) & F.coalesce((k > 0) & declared(k), F.lit(False)), k)), lambda k: k.isNotNull())


def declared_scales(source: Column) -> Column:
    """The different magnitudes that a text declares for its numbers, as "in millions" or "(millions"."""
    return _once(phrases.tokens(source), lambda found: F.array_distinct(F.transform(_declarations(found), lambda k: F.regexp_replace(F.get(found, k), "s$", ""))))


def currency_scale(block: Column, context: Column) -> Column:
    """(scale, status): the scale that a block declares, else its context's, else 1. Several scales are an error, but for "in millions, except ...", where the first holds."""
    told = [F.struct(source.alias("source"), declared_scales(source).alias("words")) for source in (block, context)]
    return _once(F.coalesce(F.get(F.filter(F.array(*told), lambda t: F.size(t.words) > 0), F.lit(0)), told[1]), _scale)


def _scale(told: Column) -> Column:
    words = told["words"]
    # an exception is one that follows the first declaration within the next tokens, before a sentence could be over
    excepted = _once(phrases.tokens(told["source"]), lambda found: F.array_contains(F.slice(found, F.get(_declarations(found), F.lit(0)) + 2, F.lit(20)), "except"))
    factor = F.lit(1.0)
    for word, (of, _) in MAGNITUDES.items():
        factor = F.when(F.get(words, F.lit(0)) == word, F.lit(of)).otherwise(factor)
    torn = (F.size(words) > 1) & ~F.coalesce(excepted, F.lit(False))
    return F.struct(F.when(~torn, factor).alias("scale"), F.when(torn, "several_scales").when(F.size(words) > 0, "declared").otherwise("unscaled").alias("status"))


def row_supports(quote: Column, value: Column, scale: Column, unsigned: Column) -> Column:
    """Whether a table row holds a value at its scale, with its sign (or without, where unsigned); a lone dash in a cell, which text.numbers_in reads as zero, supports zero."""
    want = value.cast("decimal(38,6)") / scale.cast("decimal(18,0)")
    cells = F.transform(F.split(quote, r"\|"), lambda c: F.trim(c))
    dashed = F.arrays_overlap(cells, F.array(*[F.lit(d) for d in ("-", "–", "—")]))
    held = F.exists(text.numbers_in(quote), lambda n: (n == want) | unsigned & (F.abs(n) == F.abs(want)))
    return F.coalesce(held | (want == 0) & dashed, F.lit(False))


def printed_token(quote: Column, raw: Column) -> Column:
    """A raw number as the quote prints it, with its digit groups: the first token of the same digits (with a percent sign where raw has one); else raw as it is."""
    bare = lambda t: F.regexp_replace(t, r"[,%\s]", "")
    tokens = F.regexp_extract_all(quote, F.lit(r"(?<![\w.])[-+]?\d+(?:,\d{3})*(?:\.\d+)?(?:\s*%)?(?![\w.])"), F.lit(0))
    percent = F.endswith(F.trim(raw), F.lit("%"))
    fits = F.filter(tokens, lambda t: (bare(t) == bare(raw)) & (~percent | F.endswith(t, F.lit("%"))))
    is_number = F.trim(raw).rlike(r"^[-+]?\d[\d,]*(\.\d+)?\s*%?$")
    return F.when(is_number, F.coalesce(F.trim(F.get(fits, F.lit(0))), raw)).otherwise(raw)


def context_of(source: Column, raw: Column, lines: int = 2, longest: int = 1600, side: int = 700) -> Column:
    """The line that holds the only place of a token, with so many lines before and after it; null where the token stands nowhere or twice.

    A context of more than `longest` characters is cut to `side` characters on each side of the token: the feature's own bound on a quotation, not on what is searched.
    """
    only = (raw != "") & source.contains(raw) & (F.length(F.replace(source, raw, F.lit(""))) == F.length(source) - F.length(raw))
    cut = lambda of, mark, n: F.call_function("substring_index", of, mark, F.lit(n))
    head, tail = cut(cut(source, raw, 1), F.lit("\n"), -lines - 1), cut(cut(source, raw, -1), F.lit("\n"), lines + 1)
    whole = F.trim(F.concat(head, raw, tail))
    return F.when(only, F.when(F.length(whole) <= longest, whole).otherwise(F.trim(F.concat(F.right(head, F.lit(side)), raw, F.left(tail, F.lit(side))))))


def is_bound(quote: Column, raw: Column) -> Column:
    """Whether the only line of a quote that holds a raw number words it as a bound, which cannot fill a field for one point."""
    digits = F.replace(raw, F.lit(","))
    holding = F.filter(F.split(quote, "\n"), lambda x: F.replace(x, F.lit(",")).contains(digits))
    line = F.lower(F.get(holding, F.lit(0)))
    marked = F.exists(F.array(*[F.lit(m) for m in "<>≤≥"]), lambda m: F.translate(line, " ", "").contains(F.concat(m, raw)))
    worded = line.rlike(rf"\b({'|'.join(BOUNDS)})\b")
    return F.coalesce((digits != "") & (F.size(holding) == 1) & (marked | worded), F.lit(False))


def decrease(quote: Column, raw: Column, value: Column) -> Column:
    """(raw, scale) for a negative change whose quote words it as a decrease: the token as printed, and -1; null where the quote does not hold it once."""
    bare = lambda t: F.translate(t, ",", "")
    size = bare(F.regexp_replace(F.trim(raw), "^-", ""))
    same = F.filter(phrases.tokens(quote), lambda t: bare(t) == size)
    falls = F.exists(F.array(*map(F.lit, DECREASES)), lambda word: F.contains(F.lower(quote), word))
    ok = (value < 0) & falls & (F.size(same) == 1) & (F.abs(size.try_cast("double") + value) < 1e-6)
    return F.when(ok, F.struct(F.get(same, F.lit(0)).alias("raw"), F.lit(-1.0).alias("scale")))


def fiscal_year(line: Column) -> Column:
    """The year of a cover line "For the fiscal year ended [month day,] year", else null: one of 1900 to 2099 that comes at once, or behind a month and a day."""
    after = F.split(F.trim(F.call_function("substring_index", phrases.spoken(line), F.lit(" for the fiscal year ended "), F.lit(-1))), " ")
    year = lambda k: F.when(F.get(after, F.lit(k)).rlike("^[0-9]{4}$"), F.get(after, F.lit(k)).cast("int"))
    dated = F.get(after, F.lit(0)).rlike("^[a-z]+$") & F.get(after, F.lit(1)).rlike("^[0-9]{1,2}$") & (F.get(after, F.lit(2)) == ",")
    found = F.coalesce(year(0), F.when(dated, year(3)))
    return F.when(phrases.says(phrases.spoken(line), ["for the fiscal year ended"]) & found.between(1900, 2099), found)


def topics(source: Column, patterns: dict[str, str]) -> Column:
    """The names of the topics (name: pattern over small letters) that a text touches, in order."""
    return F.array_compact(F.array(*[F.when(F.lower(source).rlike(pattern), F.lit(name)) for name, pattern in patterns.items()]))


def allowed_only(names: Column, allowed: tuple[str, ...]) -> Column:
    """Whether an array holds names, and none but those allowed."""
    return F.coalesce((F.size(names) > 0) & (F.size(F.array_except(names, F.array(*map(F.lit, allowed)))) == 0), F.lit(False))
