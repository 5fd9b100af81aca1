"""Documents as citable lines: parsing, search, evidence, context and packing."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datelore.plans.lineage import checkpointed

LINE_CHARS = 4000
_SKIPPED = {"script", "style", "noscript", "svg"}
_SECTIONS = ("thead", "tbody", "tfoot")
#: What can stand in a head: elements whose text is none of the page's, and others. Another tag, or text, ends a head.
_HEAD_TEXT = {"title", "template", "noframes"}
_HEAD = {"meta", "link", "base", "basefont", "bgsound", "html"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Lines(HTMLParser):
    """Text nodes in order, each a line; the cells of a table row make one, joined by bars, where the row's first own text stands.

    End tags may be left out: the next row, the end of its section or table, or of the page ends a row. The row of an inner table is a line of its own and,
    as all text below a cell, part of the outer row's cell too.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.found: list = []  # texts, and rows as lists of cells
        self.tables: list[list | None] = [None]  # the open row of each open table; the first is for rows outside of tables
        self.placed: set[int] = set()  # rows among found
        self.skipping, self.in_head, self.held = 0, False, 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skipping += 1
        elif self.skipping:
            return
        elif tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head, self.held = False, 0
        elif self.in_head and tag in _HEAD_TEXT:
            self.held += 1
        elif self.held or self.in_head and tag in _HEAD:
            return
        else:
            self.in_head = False
        if tag == "table":
            self.tables.append(None)
        elif tag == "tr":
            self.tables[-1] = []
        elif tag in _SECTIONS:
            self.tables[-1] = None
        elif tag in ("td", "th") and self.tables[-1] is not None:
            self.tables[-1].append([])

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif self.skipping:
            return
        elif self.in_head and tag in _HEAD_TEXT:
            self.held = max(0, self.held - 1)
        elif tag == "head":
            self.in_head, self.held = False, 0
        elif self.held:
            return
        elif tag == "table" and len(self.tables) > 1:
            self.tables.pop()
        elif tag in ("tr", "table", *_SECTIONS):
            self.tables[-1] = None

    def handle_data(self, data):
        if self.skipping or self.held or not data.strip():
            return
        self.in_head = False
        own = next((row for row in reversed(self.tables) if row is not None), None)
        if not own:  # outside of rows, or before the first cell of one
            self.found.append(data)
        elif id(own) not in self.placed:
            self.placed.add(id(own))
            self.found.append(own)
        for row in self.tables:
            if row:
                row[-1].append(data)

    def close(self):
        super().close()
        for text in self.found:
            self._add(text if isinstance(text, str) else " | ".join(" ".join(" ".join(c).split()) for c in text))

    def _add(self, text):
        text = " ".join(text.split())
        self.lines += [text[k : k + LINE_CHARS] for k in range(0, len(text), LINE_CHARS)]


def page_lines(html: str) -> list[str]:
    """The visible text of one page in order."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    return parser.lines


def html_to_lines(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, line_no, line): the visible text of each page in order. Scripts, styles and the head are left out; a null page has no lines."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, body in zip(frame[key], frame[html], strict=True):
                out += [(k, n, line) for n, line in enumerate(page_lines(body or ""), 1)]
            yield pd.DataFrame(out, columns=[key, "line_no", "line"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(parse, f"{key} {kind}, line_no int, line string")


def json_leaves(rows: DataFrame, key: str, text: str, max_depth: int = 32, max_nodes: int = 100_000) -> DataFrame:
    """(key, pointer, value, warning) of the leaves of the JSON texts of rows (key: unique, text), pointers as in RFC 6901, values as JSON.

    Variants are opened level by level, a join-free step of the engine for each; levels end when nothing is left to open. What is no JSON (or has a key twice) is a row of an
    empty pointer and the warning no_json; what lies below max_depth, a row of its pointer and depth_limit; a text of more than max_nodes values is opened no further than the
    level that passes them, and has one more row with node_limit. Keys come in the order of their names. A null text is no JSON.
    """
    shown = F.to_json("v")
    opens = F.substring(shown, 1, 1).isin("{", "[") & ~shown.isin("{}", "[]")
    level = rows.select(F.col(key).alias("_key"), F.lit("").alias("pointer"), F.try_parse_json(text).alias("v"))
    none = F.lit(None).cast("string")
    row = lambda df, value, warning: df.select(F.col("_key").alias(key), "pointer", value.alias("value"), warning.alias("warning"))
    out = [row(level.where("v is null"), none, F.lit("no_json"))]
    level = level.where("v is not null").select("_key", "pointer", shown.alias("value"), opens.alias("opens"), F.lit(1).cast("long").alias("nodes"))
    for depth in range(max_depth + 1):
        level = checkpointed(level)
        out.append(row(level.where("not opens"), F.col("value"), none))
        over = level.where(F.col("nodes") > max_nodes)
        out.append(row(over.select("_key", F.lit("").alias("pointer")).distinct(), none, F.lit("node_limit")))
        going = level.where(F.col("opens") & (F.col("nodes") <= max_nodes))
        if depth == max_depth or not going.limit(1).count():
            out.append(row(going, none, F.lit("depth_limit")))
            break
        inner = rows.sparkSession.tvf.variant_explode(F.col("_in").outer())
        opened = going.select("_key", "pointer", "nodes", F.parse_json("value").alias("_in")).lateralJoin(inner).withColumnRenamed("value", "inner")
        name = F.replace(F.replace(F.coalesce(F.col("key"), F.col("pos").cast("string")), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        told = opened.select("_key", F.concat("pointer", F.lit("/"), name).alias("pointer"), F.to_json("inner").alias("value"), "nodes")
        first = F.substring("value", 1, 1).isin("{", "[") & ~F.col("value").isin("{}", "[]")
        of_key = F.count(F.lit(1)).over(Window.partitionBy("_key"))
        level = told.select("_key", "pointer", "value", first.alias("opens"), (F.col("nodes") + of_key).alias("nodes"))
    return reduce(DataFrame.unionByName, out)


def search_lines(lines: DataFrame, key: str, terms: list[str], context: int) -> DataFrame:
    """Lines that hold a term (any case), and those up to context lines from one, with is_hit."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.lower("line").contains(t.lower())
    near = Window.partitionBy(key).orderBy("line_no").rowsBetween(-context, context)
    return lines.withColumn("is_hit", hit).withColumn("_near", F.max("is_hit").over(near)).where("_near").drop("_near")


def ground_quotes(docs: DataFrame, quotes: DataFrame, key: str, anchor_words: int = 5) -> DataFrame:
    """(quote_id, key, start, n_places) of quotes (quote_id, quote) that stand literally in a text: the first place (from 0) and how many there are.

    The hash of a run of a quote's inner words, which are whole wherever it stands, is looked up among those of all runs of as many words of each text, an equi-join;
    only texts that hold the run are compared with the quote. The first and last word of a quote may be part of a longer one, so a run has up to anchor_words words,
    fewer in a quote of less than anchor_words + 2. Quotes of one or two words, or of none, have no inner word; their first four characters are looked up in the same way
    among those of each text. Empty quotes are not grounded.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    told = quotes.where("quote <> ''").select("quote_id", "quote", F.explode(F.array(words(F.col("quote")))).alias("_w"))
    anchors = told.where("size(_w) > 2").withColumn("_size", F.least(F.size("_w") - 2, F.lit(anchor_words)))
    sizes = anchors.agg(F.collect_set("_size").alias("_sizes"))  # one row of at most anchor_words numbers
    anchors = anchors.select("quote_id", "quote", F.xxhash64(F.slice("_w", F.lit(2), F.col("_size"))).alias("_gram"))
    starts = lambda n: F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1)).otherwise(F.array().cast("array<int>"))
    grams = F.flatten(F.transform("_sizes", lambda n: F.transform(starts(n), lambda p: F.xxhash64(F.slice("_w", p, n)))))
    runs = docs.select(key, F.explode(F.array(words(F.col("text")))).alias("_w")).crossJoin(F.broadcast(sizes)).select(key, F.explode(F.array_distinct(grams)).alias("_gram"))
    near = runs.join(anchors, "_gram").select(key, "quote_id", "quote").join(docs.select(key, "text"), key)
    short = told.where("size(_w) <= 2").select("quote_id", "quote", F.substring("quote", 1, 4).alias("_gram"))
    lengths = short.agg(F.collect_set(F.length("_gram")).alias("_sizes"))  # one row of at most four numbers; none, and nothing is cut, without short quotes
    cuts = lambda n: F.when(F.length("text") >= n, F.sequence(F.lit(1), F.length("text") - n + 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.flatten(F.transform("_sizes", lambda n: F.array_distinct(F.transform(cuts(n), lambda p: F.substring(F.col("text"), p, n)))))
    letters = docs.select(key, "text").crossJoin(F.broadcast(lengths)).select(key, F.explode(pieces).alias("_gram"))
    by_letters = letters.join(short, "_gram").select(key, "quote_id", "quote").join(docs.select(key, "text"), key)
    found = near.unionByName(by_letters).where(F.col("text").contains(F.col("quote")))
    return found.select(
        "quote_id", key, (F.instr("text", F.col("quote")) - 1).alias("start"),
        ((F.length("text") - F.length(F.replace("text", F.col("quote"), F.lit("")))) / F.length("quote")).cast("int").alias("n_places"),
    )


def nearest_before(hits: DataFrame, headers: DataFrame, key: str, within: int) -> DataFrame:
    """hits (key, line_no) with header_no, the nearest header at most within lines above (or on it), null where there is none.

    One window over the union of both: no hit is compared with all headers.
    """
    both = hits.select(key, "line_no", F.lit(1).alias("_hit")).unionByName(headers.select(key, "line_no", F.lit(0).alias("_hit")))
    above = Window.partitionBy(key).orderBy("line_no", "_hit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_hit") == 0, F.col("line_no")), ignorenulls=True).over(above)
    return both.withColumn("_last", last).where("_hit = 1").select(key, "line_no", F.when(F.col("line_no") - F.col("_last") <= within, F.col("_last")).alias("header_no"))


def packed(lines: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, line_no, chunk): consecutive lines packed into chunks of at most limit characters; a longer line is a chunk of its own.

    Where a chunk ends decides where the next begins, so a document is packed in sequence, by the lengths of its lines; a batch of documents at a time goes through Arrow.
    """

    def pack(sizes) -> list[int]:
        chunk, used, out = 0, 0, []
        for n in sizes:
            if used and used + n > limit:
                chunk, used = chunk + 1, 0
            out.append(chunk)
            used += n
        return out

    @F.pandas_udf("array<int>")
    def chunks(sizes: pd.Series) -> pd.Series:
        return sizes.map(pack)

    line = F.struct("line_no", F.coalesce(F.length("line"), F.lit(0)).alias("n_chars"))
    docs = lines.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("rows"))
    both = docs.select(key, F.col("rows.line_no").alias("line_no"), chunks(F.col("rows.n_chars")).alias("chunk"))
    return both.select(key, F.inline(F.arrays_zip("line_no", "chunk")))


def greedy_cover(lines: DataFrame, key: str, groups: dict[str, list[str]], budget: int) -> DataFrame:
    """Lines chosen for each document under a budget of characters: first the best line for each group of terms, then by score; what does not fit is passed over.

    The score of a line is the number of groups it serves, then the share of its characters that are digits. Only lines that serve a group are moved.
    """
    flags = [F.lit(False) for _ in groups]
    for k, terms in enumerate(groups.values()):
        for t in terms:
            flags[k] = flags[k] | F.lower("line").contains(t.lower())
    served = F.array_compact(F.array(*[F.when(f, F.lit(g)) for f, g in zip(flags, groups, strict=True)]))
    digits = F.length(F.regexp_replace("line", "[^0-9]", "")) / F.greatest(F.length("line"), F.lit(1))
    scored = lines.select(key, "line_no", F.length("line").alias("n_chars"), served.alias("served"), digits.alias("digits")).where("size(served) > 0")
    names = list(groups)

    def cover(rows: str) -> list[int]:
        rows = sorted(json.loads(rows), key=lambda r: (-len(r["served"]), -r["digits"], r["line_no"]))
        chosen, used = {}, 0
        for g in names:
            best = next((r for r in rows if g in r["served"] and r["line_no"] not in chosen and used + r["n_chars"] <= budget), None)
            if best is not None and not any(g in s for s in chosen.values()):
                chosen[best["line_no"]] = set(best["served"])
                used += best["n_chars"]
        for r in rows:
            if r["line_no"] not in chosen and used + r["n_chars"] <= budget:
                chosen[r["line_no"]] = set(r["served"])
                used += r["n_chars"]
        return sorted(chosen)

    @F.pandas_udf("array<int>")
    def covers(rows: pd.Series) -> pd.Series:
        return rows.map(cover)

    docs = scored.groupBy(key).agg(F.to_json(F.collect_list(F.struct("line_no", "n_chars", "served", "digits"))).alias("rows"))
    return docs.select(key, F.explode(covers("rows")).alias("line_no"))
