"""String, number and date expressions. What SQL functions can say is a Column expression; NFKC needs an Arrow UDF."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Legal forms that issuer names drop at their end, as words after punctuation became blanks.
LEGAL_FORMS = (
    "public limited company", "limited partnership", "incorporated", "corporation", "company", "limited", "inc", "corp", "co", "plc", "ltd", "llc", "llp", "lp", "n v", "s a", "a g",
    "p l c", "l p", "s e",
)
#: IPv4 networks that are not public, as (first address, bits of the network).
PRIVATE_NETWORKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
)


@F.pandas_udf(StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Unicode's compatibility composition, for which SQL has no function; null stays null."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def cik(value: Column) -> Column:
    """1 to 10 digits padded to 10, else null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike("^[0-9]{1,10}$"), F.lpad(text, 10, "0"))


def company_name(name: Column) -> Column:
    """A name without its share class, case, punctuation and extra spaces. Pass it through nfkc first where it may hold compatibility characters."""
    bare = F.regexp_replace(F.trim(name), r"(?i)\s*\(?\bclass\s+[a-z]\)?\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), r"\p{P}", ""), r"\s+", " "))


def issuer_name(name: Column) -> Column:
    """A name with "&" as "and", without a share class in brackets, a leading "the", punctuation, and any legal forms at its end (but never empty).

    Pass it through nfkc first where it may hold compatibility characters.
    """
    bare = F.regexp_replace(name, r"(?i)\s*\(\s*class\s+[a-z0-9]+\s*\)\s*$", "")
    words = F.trim(F.regexp_replace(F.replace(F.lower(bare), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}_]+", " "))
    words = F.when(F.startswith(words, F.lit("the ")), F.substr(words, F.lit(5))).otherwise(words)
    return F.regexp_replace(words, rf"(?<=\S)(?: (?:{'|'.join(LEGAL_FORMS)}))+$", "")


def ticker(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def whole_id(value: Column) -> Column:
    """An identifier as text: a number without a fraction loses ".0", one with a fraction becomes empty, other text stays."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("decimal(38,6)")
    whole = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise("")
    return F.coalesce(F.when(number.isNotNull(), whole).otherwise(text), F.lit(""))


_DIGIT, _SIGNS = "[0-9] *", " ,$€£¥"
#: A token's amount (a currency sign, a minus, digits in one run or in groups of three, a fraction; blanks count nowhere), then its unit: a percent sign, or words, before which one dash may stand.
_REPORTED = (
    rf"^([$€£¥]? *-? *(?:(?:{_DIGIT})+|(?:{_DIGIT}){{1,3}}(?:, *(?:{_DIGIT}){{3}})+)(?:\. *(?:{_DIGIT})+)?)"
    r"(?:%|[-–—]?[A-Za-z][A-Za-z\u212a ._/-]*)?\z"
)


def reported_number(raw: Column) -> Column:
    """The number of one copied token: a currency sign before and a unit after are allowed, digit groups must be of three; else null.

    The token's unit begins at its first letter or percent sign; what is before is a sign, groups of digits, and a fraction. One pattern reads it all.
    """
    token = F.trim(F.translate(raw, "\t\n\r\u00a0", "    "))
    return F.when(F.length(raw) <= 100, F.translate(F.regexp_extract(token, _REPORTED, 1), _SIGNS, "").try_cast("double"))


def numbers_in(text: Column) -> Column:
    """All numbers of a row in order, those in parentheses negative; a lone dash in a cell means zero."""
    tokens = F.regexp_extract_all(text, F.lit(r"\(\s*[$€£]?\s*\d[\d,]*(?:\.\d+)?\s*\)|-?\d[\d,]*(?:\.\d+)?|(?<=\|\s{0,3})[-–—](?=\s*(?:\||$))"), F.lit(0))
    value = lambda t: F.regexp_replace(t, r"[^0-9.]", "").try_cast("decimal(38,6)")
    return F.transform(tokens, lambda t: F.when(F.length(F.regexp_replace(t, "[^0-9]", "")) == 0, F.lit(0).cast("decimal(38,6)")).when(t.rlike(r"^[(-]"), -value(t)).otherwise(value(t)))


def _without_tags(text: str) -> str:
    """What stands outside of <...>; a "<" that nothing closes is text."""
    first, *rest = text.split("<")
    return first + "".join(f" {r.partition('>')[2]}" if r.find(">") > 0 else f"<{r}" for r in rest)


def _ungrouped(word: str) -> str:
    """A word without the commas between groups of three digits."""
    pieces = word.split(",")
    out = pieces[0]
    for piece in pieces[1:]:
        three = piece[:3].isdigit() and len(piece[:3]) == 3 and not piece[3:4].isdigit()
        out += piece if out[-1:].isdigit() and three else f",{piece}"
    return out


def _plain(text: str) -> str:
    cells = []
    for cell in html.unescape(_without_tags(text)).split("|"):
        words: list[str] = []
        for word in map(_ungrouped, cell.split()):
            if word.startswith("%") and words:
                words[-1] += word
            else:
                words.append(word)
        cells.append(" ".join(words))
    return " | ".join(cells).strip().lower()


@F.pandas_udf(StringType())
def source_text(texts: pd.Series) -> pd.Series:
    """Text without tags, entities (named or numeric), digit-group commas and layout around "%" and "|", in small letters; null stays null."""
    return texts.map(lambda x: None if x is None else _plain(x))


def column_gaps(text: Column) -> Column:
    """Each line cut at its runs of two and more blanks, the pieces joined by bars."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.array_join(F.split(line, r"\s\s+"), " | ")), "\n")


def iso_date(text: Column) -> Column:
    """A date that is written exactly as YYYY-MM-DD, else null."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(day, "yyyy-MM-dd") == text, day)


def zoned_time(text: Column) -> Column:
    """A timestamp that names its offset, else null."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def _ipv4(address: str) -> int:
    return int.from_bytes(bytes(map(int, address.split("."))), "big")


def public_url(url: Column) -> Column:
    """Whether a url is http(s) and names a public host: no user part, no port but the scheme's own, no address of a private range, no local name.

    A url of more than 2,048 characters is none; of addresses in brackets only 2000::/3 is public.
    """
    scheme = F.lower(F.substring_index(url, "://", 1))
    rest = F.substr(url, F.length(scheme) + 4)
    authority = F.regexp_extract(rest, r"^[^/?#\\]*", 0)
    bracket = F.startswith(authority, F.lit("["))
    host = F.lower(F.when(bracket, F.substring_index(authority, "]", 1)).otherwise(F.substring_index(authority, ":", 1)))
    port = F.when(bracket, F.substring_index(authority, "]", -1)).otherwise(F.substr(authority, F.length(host) + 1))
    octets = F.transform(F.split(host, "[.]"), lambda o: F.when(o.rlike("^[0-9]{1,3}$"), o.cast("int")))
    is_address = (F.size(octets) == 4) & F.forall(octets, lambda o: F.coalesce(o <= 255, F.lit(False)))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda n, o: n * 256 + F.coalesce(o, F.lit(0)))
    private = F.lit(False)
    for first, bits in PRIVATE_NETWORKS:
        private = private | number.between(_ipv4(first), _ipv4(first) + (1 << 32 - bits) - 1)
    named = host.contains(".") & ~F.endswith(host, F.lit(".local")) & ~F.endswith(host, F.lit(".localhost"))
    good_host = F.when(bracket, F.substring(host, 2, 1).isin("2", "3")).when(is_address, ~private).otherwise(named)
    good_port = (port == "") | (port == ":") | ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    return F.coalesce(scheme.isin("http", "https") & url.contains("://") & (F.length(url) <= 2048) & ~authority.contains("@") & good_port & good_host, F.lit(False))


def years_in(text: Column) -> Column:
    """Distinct years from 1990 to 2049 that stand alone in a text, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(199\d|20[0-4]\d)(?!\d)"), F.lit(1)), lambda y: y.cast("int"))))


def token_cost(incoming: Column, outgoing: Column, cached: Column, rates: tuple[str, str, str]) -> Column:
    """Cost of tokens in exact decimals, by rates a million (input, output, cached input); null where more is cached than came in."""
    i, o, c = (F.lit(r).cast("decimal(18,6)") for r in rates)
    d = lambda x: x.cast("decimal(18,0)")
    return F.when(cached <= incoming, ((d(incoming) - d(cached)) * i + d(outgoing) * o + d(cached) * c) / F.lit(1_000_000).cast("decimal(8,0)"))


def broken_rules(rules: dict[str, Column]) -> Column:
    """The names of the rules (name: holds) that a row breaks, in order; a rule that is null is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))
