"""The ten operators on hand-made rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from datelore.llm import bpe, chat, components, decontaminate, jaccard, language, licenses, shards, toxicity, urls, vectors
from datelore.llm.common import dealt_in_blocks, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


# op1


def brute_links(rows, threshold):
    unit = {}
    for k, (vec_id, x, label) in enumerate(rows):
        if x and label is not None and all(v is not None and math.isfinite(v) for v in x) and any(x):
            v = np.array(x, float)
            unit[k] = (vec_id, label, v / np.linalg.norm(v))
    links = {}
    for a in unit:
        for b in unit:
            if a < b and unit[a][1] == unit[b][1] and unit[a][0] != unit[b][0] and len(unit[a][2]) == len(unit[b][2]) and unit[a][2] @ unit[b][2] >= threshold:
                links.setdefault(unit[a][0], set()).add(unit[b][0])
                links.setdefault(unit[b][0], set()).add(unit[a][0])
    return links


@pytest.mark.parametrize("dims", [1, 5, 40])
def test_vectors_against_brute_force(spark, dims, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 7)
    rng = np.random.default_rng(dims)
    rows = []
    for k in range(60):
        x = rng.standard_normal(dims) if k % 3 == 0 else np.array(rows[-1][1]) * 3 + rng.standard_normal(dims) * 0.3 * (k % 5) / dims**0.5
        rows.append((k, x.tolist(), k // 30))
    rows += [(100, None, 1), (101, [], 1), (102, [0.0] * dims, 1), (103, [float("nan")] * dims, 1), (104, [1.0] * dims, None), (105, [None] * dims, 1), (106, [math.inf] * dims, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("clash"))
    got = {r.vec_id: r for r in vectors.near_vectors(df, 0.93).collect()}
    links = brute_links(rows, 0.93)
    assert len(got) == len(rows)
    assert {k: r.n_links for k, r in got.items()} == {k: len(links.get(k, ())) for k in got}
    for k, r in got.items():
        seen, todo = {k}, [k]
        while todo:
            for other in links.get(todo.pop(), ()):
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        assert r.component_id == min(seen) and r.kept == (k == min(seen))
    assert vectors.near_vectors(df.limit(0), 0.93).count() == 0


def test_vectors_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(-1, 0, None, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_links_of_an_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.001], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.02], 1), (4, [0.0, 1.0], 1)]
    got = {(r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def test_blocks_meet_once(spark):
    rows = spark.range(50).select(F.lit(1).alias("g"), "id").unionByName(spark.range(1).select(F.lit(2).alias("g"), "id"))
    groups = dealt_in_blocks(rows, ["g"], "id", 8).groupBy("lo", "hi").agg(F.collect_list(F.struct("blk", "id")).alias("m")).collect()
    met = {}
    for g in groups:
        for a in g.m:
            for b in g.m:
                if a.id < b.id and (g.lo == g.hi or a.blk != b.blk):
                    met[a.id, b.id] = met.get((a.id, b.id), 0) + 1
    assert len(met) == 50 * 49 // 2 and set(met.values()) == {1}


# op2


def test_pattern_rules_fit_what_their_expressions_fit(spark):
    parts = ["wp-login.php", "xmlrpc.php", "spam-", "cheap-pills", "casino", "download/crack/", "wp-login", "WP-login.php"]
    made = [f"http://{h}{p}{t}" for h in ("a.com/", "a.com/x", "a.com/x.", "a-", "") for p in parts for t in ("", "5", "x", "7/y", "-z", ".z", "/z", "é")]
    key = F.concat(*urls.split_url("url"))
    df = spark.createDataFrame([(u,) for u in made], "url string").withColumn("key", key)
    for k, (pattern, tokens, verdict) in enumerate(urls.PATTERN_RULES):
        want = {r.url for r in df.where(F.col("key").rlike(pattern)).collect()}
        got = {r.url for r in urls.judge_urls(df, urls.rule_table(spark, (), ((pattern, tokens, verdict),))).where(F.col("verdict") == verdict).collect()}
        assert want and got == want, k
    wrong = F.lit(False)
    for pattern in (r"(?:^|[.-])spam-", r"(?:^|[.-])cheap-pills[.-]", r"(?:^|[.-])casino[.-]", r"/(?:wp-login|xmlrpc)\.php", r"/download/crack/"):  # as in the query's SQL
        wrong = wrong | F.col("key").rlike(pattern)
    judged = urls.judge_urls(df, urls.rule_table(spark, ())).withColumn("want", F.when(wrong, "block").otherwise("allow"))
    assert judged.where("verdict <> want").count() == 0


def test_urls(spark):
    made = {
        "http://net/": ("net", "/", "net/", "block"), "https://A.NET/x?y": ("a.net", "/x", "net/", "block"), "http://w.example.net/en/1": ("w.example.net", "/en/1", "example.net/en/", "allow"),
        "http://notexample.net/en/1": ("notexample.net", "/en/1", "net/", "block"), "http://example.com/de": ("example.com", "/de", None, "allow"), "http://a.org/fr/": ("a.org", "/fr/", "org/fr/", "allow"),
        "http://a.net": ("a.net", "", None, "allow"), "x": ("", "", None, "allow"), "": ("", "", None, "allow"), "http://spam-x.org/en": ("spam-x.org", "/en", None, "block"), "a://b://c.net/": ("b:", "//c.net/", None, "allow"),
        "http://spam-a.org/fr/1": ("spam-a.org", "/fr/1", "org/fr/", "allow"), "http://x.net#/": ("x.net", "", None, "allow"),
    }
    rows = [(k, u, "clash") for k, u in enumerate([*made, None, "http://net/"])]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, urls.rule_table(spark)).collect()}
    assert got == dict(enumerate([*made.values(), ("", "", None, "allow"), made["http://net/"]]))
    assert urls.judge_urls(df.limit(0), urls.rule_table(spark)).count() == 0
    bare = urls.rule_table(spark, (), (("^$", (), "block"),))  # a rule without literal tokens
    assert {r.page_id for r in urls.judge_urls(df, bare).where("verdict = 'block'").collect()} == {7, 8, 13}


# op3


@pytest.mark.parametrize("n,parts", [(0, 4), (1, 4), (103, 10)])
def test_shards(spark, n, parts):
    rng = random.Random(3)
    rows = [(k if k % 10 else None, rng.choice(["x", "yy", None, "y" * 500]), rng.choice(["en", "de", None]), rng.choice("abc"), "clash") for k in range(n)]
    df = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string, lang string, source string, shard string")
    got = shards.hilbert_shards(df.withColumn("size", F.length("text")), ["lang", "source", "size"], ["text", "doc_id"], parts).collect()
    assert len(got) == n + len(rows[:5])
    counts = [sum(r.shard == s for r in got) for s in range(parts)]
    assert max(counts) - min(counts) <= 1
    for s in range(parts):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert [r.curve for r in own] == sorted(r.curve for r in own)


@pytest.mark.parametrize("n", [3, 200])
def test_text_dimensions_are_cut_by_their_whole_values(spark, n):
    """Values that share a long prefix get cells of their own while there are enough, else like shares of the rows."""
    rng = random.Random(n)
    values = [f"a_long_common_source_{min(int(rng.expovariate(0.03)), n - 1):03}" for _ in range(2000)]
    cell = shards.quantised(df := spark.createDataFrame([(v,) for v in values] + [(None,)], "source string"), ["source"], 5)[0]
    got = {r.source: r.cell for r in df.select("source", cell.alias("cell")).distinct().collect()}
    every = sorted(set(values))
    if len(every) <= 32:
        want = {v: k for k, v in enumerate(every)}
    else:
        filled = sorted({32 * sum(x < v for x in values) // len(values) for v in every})
        want = {v: filled.index(32 * sum(x < v for x in values) // len(values)) for v in every}
    assert got == want | {None: 0}


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 3), (4, 2)])
def test_curve_is_continuous(n, bits):
    grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")).reshape(n, -1)
    index = shards.curve_index(list(grid), bits)
    assert sorted(index) == list(range(1 << n * bits))
    assert (np.abs(np.diff(grid[:, np.argsort(index)], axis=1)).sum(axis=0) == 1).all()


# op4, op5


def test_language(spark):
    rows = [(k, " ".join(random.Random(k).choices(w.split(), k=12)), lang) for k in range(60) for lang, w in (("en", "the house and tree garden water"), ("de", "das haus und baum garten wasser"))]
    model = language.fit(spark.createDataFrame([*rows, (1, None, "en"), (2, "x", None)], "k int, text string, lang string"))
    assert model.langs == ["de", "en"]
    texts = ["the water and the tree", "das wasser und der baum", "Gartens", "", None, "123 !!!", "the house " * 50_000, "жжж"]
    df = docs_of(spark, texts).withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, model).collect()}
    assert [got[k][0] for k in range(7)] == ["en", "de", "de", "und", "und", "und", "en"]
    assert got[7][0] in ("de", "en") and all(0 <= s <= 1 for _, s in got.values())
    empty = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, empty).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_language_model_is_what_a_recount_gives(spark):
    rng = random.Random(8)
    rows = [(" ".join(rng.choices(["aa", "ab", "éa", "b", "zzz", f"w{'xyz'[k % 3]}"], k=rng.randrange(1, 9))), "en" if k % 3 else "de") for k in range(40)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    seen = {lang: [w for t, x in rows if x == lang for w in t.split()] for lang in ("de", "en")}
    known = sorted({w for ws in seen.values() for w in ws})
    for w in known:  # every word is kept, those seen once too
        logs = [math.log((ws.count(w) + 0.5) / (len(ws) + 1)) for ws in seen.values()]
        _, found = model.words.find([w])
        assert found[0].tolist() == pytest.approx([x - sum(logs) / 2 for x in logs], abs=1e-5)
    for n in language.LENGTHS:
        weight = {lang: {} for lang in seen}
        for lang, ws in seen.items():
            for w in set(ws):
                f = f" {w} "
                for k in range(len(f) - n + 1):
                    if f[k : k + n] != " ":
                        weight[lang][f[k : k + n]] = weight[lang].get(f[k : k + n], 0) + math.log2(ws.count(w) + 1)
        for gram in {g for by in weight.values() for g in by}:
            logs = [math.log((by.get(gram, 0) + 0.5) / (sum(by.values()) + 1)) for by in weight.values()]
            assert model.grams.find([gram])[1][0].tolist() == pytest.approx([x - sum(logs) / 2 for x in logs], abs=1e-5)


def test_held_out_is_crc32(spark):
    got = spark.range(50).select("id", language.held_out("id", 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_segments_are_maximal():
    def brute(x):
        """Ruzzo and Tompa's definition: the best contiguous run (shortest, leftmost), then the same to its left and right."""
        best = max(((sum(x[a:b]), a - b, -a, a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        s, _, _, a, b = best
        return brute(x[:a]) + [(a, b - 1, s)] + [(c + b, d + b, t) for c, d, t in brute(x[b:])]

    rng = random.Random(5)
    for _ in range(300):
        x = [float(rng.choice([-7, -3, -1, 2, 4, 8])) + rng.random() / 1000 for _ in range(rng.randrange(9))]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(x)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute(x)]


def test_segments_take_linear_time():
    import time

    for scores in ([1.0, -2.0] * 500_000, [1.0, -0.5] * 500_000, [2.0] * 1000 + [-1.0, 0.5] * 499_500):
        began = time.process_time()
        found = toxicity.maximal_segments(scores)
        assert time.process_time() - began < 20 and all(a <= b for a, b, _ in found)


def test_toxicity_words_are_what_a_recount_gives(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["bad", "vile", "calm", "tree", "sky", "sea"], weights=[4, 3, 1, 1, 1, 1] if k % 2 else [1, 1, 4, 4, 4, 4], k=12)) for k in range(60)]
    model = toxicity.fit(docs_of(spark, texts), spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int"))
    count = {w: [sum(w in t.split() for t in texts[c::2]) for c in (1, 0)] for w in ("bad", "vile", "calm", "tree", "sky", "sea")}
    n1, n0 = (sum(c[k] for c in count.values()) for k in (0, 1))
    prior = {w: toxicity.PRIOR * sum(c) / (n1 + n0) + 0.01 for w, c in count.items()}
    total = sum(prior.values()) + 0.01  # and the prior of what is not known
    for w, (y1, y0) in count.items():
        a = prior[w]
        odds = math.log((y1 + a) / (n1 + total - y1 - a)) - math.log((y0 + a) / (n0 + total - y0 - a))
        z = odds / math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        assert model.words[w] == pytest.approx(odds if abs(z) >= toxicity.TELLING else 0.0, abs=1e-3)


def test_toxicity(spark):
    rng = random.Random(2)
    words = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(300)]
    texts = [t + " idiot scum " + t[:40] + " idiot" if k % 6 == 0 else t for k, t in enumerate(texts)]
    docs = docs_of(spark, [*texts, None, "", "42", "an Idiot! and scum, idiot", ("calm " * 20_000).strip()])
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(300)] + [(999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.withColumn("passages", F.lit(1)), model).collect()}
    right = sum((got[k].score >= 0.5) == (k % 6 == 0) for k in range(300))
    assert right >= 295 and all(got[k].score < 0.5 for k in (300, 301, 302, 304)) and got[303].score >= 0.5
    span = got[303].passages[0]
    assert "Idiot" in "an Idiot! and scum, idiot"[span.start : span.end]
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(docs, none).collect())
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


# op6


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "", None, "plain\n", "<s", "\\", "[/INST", "a<s>b\\</s>"]
    rows = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate([(r, x) for x in tricky for r in ("user", "assistant")])]
    rows += [(3, None, None, None), (4, 0, "role with\nnewline", "x"), (2, 0, "user", tricky[0]), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(chat.events_of(df)))).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in own]
        assert got[conv].loss_text == "".join(x for _, r, x in own if r == "assistant")
    assert chat.render(chat.fold_events(chat.events_of(df.limit(0)))).count() == 0


def test_fold_of_events(spark):
    log = [
        (1, 0, "start", "m", 0, "assistant", "dra"), (1, 1, "delta", "m", None, None, "ft"), (1, 2, "regenerate", "m", None, None, ""), (1, 4, "delta", "m", None, None, "lo"), (1, 3, "delta", "m", None, None, "hel"),
        (1, 0, "delta", "n", 1, "user", "typo"), (1, 1, "edit", "n", None, None, "fixed"), (1, 0, "start", "o", 2, "user", "gone"), (1, 1, "delete", "o", None, None, None),
        (1, 0, "delta", "p", 3, "user", "a"), (1, 1, "delta", "p", None, None, "b"), (1, 0, "message", None, 4, "user", "whole"), (1, 0, "noise", "q", 5, "user", "x"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message string, turn long, role string, text string")
    got = sorted((r.turn, r.role, r.text) for r in chat.fold_events(df).collect())
    assert got == [(0, "assistant", "hello"), (1, "user", "fixed"), (3, "user", "ab"), (4, "user", "whole")]


# op7


def brute_contamination(text, items, size=13):
    words = words_of(text)
    hit, found = set(), set()
    for item_id, item in items:
        w = words_of(item)
        n = min(size, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[a : a + n]:
                    hit |= set(range(k, k + n))
                    found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def test_contamination(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "b", "é", "X1"]) for _ in range(n))
    items = [(1, text(20)), (2, text(5)), (10, text(13)), (3, ""), (4, None), (5, "?!"), (6, text(5))]
    items.append((7, items[0][1]))
    texts = [None, "", "...", items[0][1], f"{text(300)}, {items[2][1].upper()}!{items[1][1]}", text(2000), items[1][1] * 2, "a" * 100_000, f"é {items[5][1]}é"]
    df = docs_of(spark, [*texts, texts[4]]).withColumns({"spans": F.lit("clash"), "_own": F.lit("stays")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (4 << 20, 30):  # one automaton, and several
        got = {r.doc_id: r for r in decontaminate.mark_contamination(df, bench, automaton_bytes=size).collect()}
        for k, t in enumerate([*texts, texts[4]]):
            assert (got[k].n_words, got[k].n_hit, list(got[k].item_ids)) == brute_contamination(t, items) and got[k]._own == "stays", (size, k)
            for s in got[k].spans:
                assert words_of(t[s.start : s.end]) == words_of(t)[s.first_word : s.last_word + 1]
    assert decontaminate.mark_contamination(df.limit(0), bench).count() == 0
    assert decontaminate.mark_contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


# op8


def test_licenses(spark):
    mit = licenses.TEMPLATES[1][1]
    changed = mit.replace("free of charge", "at no charge at all").replace("rights", "full rights")
    texts = [None, "", "MIT License mit license", f"{'x ' * 300}{changed} {'y ' * 40}", "see the Apache License or GENERAL PUBLIC-LICENSE", "mit", "licensed under CC BY-NC 4.0", "the mit; license " * 2000]
    df = docs_of(spark, [*texts, texts[3]]).withColumn("labels", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.scan_licenses(df, licenses.template_table(spark)).collect()}
    assert [list(got[k].places) for k in range(7)] == [[], [], [0, 2], [], [2, 5], [], []] and len(got[7].places) == 2000
    assert [list(got[k].base_labels) for k in (2, 4, 6)] == [["mit"], ["apache", "gpl"], []]
    assert [s.label for s in got[3].spans] == ["mit"] and got[3].spans[0].first >= 300 and got[3].spans == got[8].spans
    assert [s.label for s in got[6].spans] == ["cc-by-nc"]
    assert licenses.scan_licenses(df.limit(0), licenses.template_table(spark)).count() == 0


def test_license_words_count_in_order(spark):
    notice = licenses.TEMPLATES[7][1].split()
    rng = random.Random(6)
    shuffled = [" ".join(notice[:5] + rng.sample(notice[5:-5], len(notice) - 10) + notice[-5:]) for _ in range(10)]
    twice = " ".join(notice[:20]) + " and again " + " ".join(notice[:20])  # one half, twice: counted once
    texts = [*shuffled, twice, " ".join(notice), " ".join(notice).replace("binary", "any").replace("met:", "met, as told:"), "wor\u212a is licensed"]
    got = {r.doc_id: [(s.label, round(s.share, 2)) for s in r.spans] for r in licenses.scan_licenses(docs_of(spark, texts), licenses.template_table(spark)).collect()}
    assert all(got[k] == [] for k in range(11)) and got[11] == [("bsd", 1.0)] and got[12][0][0] == "bsd" and 0.9 < got[12][0][1] < 1
    pairs = [(rng.randrange(9), rng.randrange(9)) for _ in range(14)]
    most = lambda left, at, t: max((1 + most(left, a, b) for a, b in left if a > at and b > t), default=0)
    made = spark.createDataFrame([([{"at": a, "back": -t, "t": t} for a, t in sorted(pairs, key=lambda p: (p[0], -p[1]))],)], "p array<struct<at:int,back:int,t:int>>")
    assert made.select(licenses.in_order(F.col("p"))).first()[0] == most(sorted(set(pairs)), -1, -1)


# op9


def test_jaccard(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PRUNE_ROWS", 6)
    monkeypatch.setattr(jaccard, "VERIFY_ROWS", 5)
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120]))) for _ in range(6)]
    texts = []
    for k in range(90):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9999)}"
        texts.append(" ".join(words))
    texts += [None, "", "!!", "a b", "A b", "a b c", "one two three four five", "long " * 30_000]
    sets = {}
    for k, t in enumerate(texts):
        w = words_of(t)
        sets[k] = frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    of = {k: min([j for j in sets if sets[j] == sets[k]] if sets[k] else [k]) for k in sets}
    reps = sorted(k for k in set(of.values()) if sets[k])
    links = {k: {j for j in reps if j != k and len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k])} for k in reps}
    df = docs_of(spark, texts).withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in jaccard.near_documents(df).collect()}
    assert len(got) == len(texts) and sum(map(len, links.values())) > 100
    for k, r in got.items():
        seen, todo = {of[k]}, [of[k]]
        while todo:
            for other in links.get(todo.pop(), ()):
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        assert (r.class_id, r.n_links, r.component_id, r.kept) == (of[k], len(links.get(of[k], ())), min(seen), k == min(seen)), k
    assert jaccard.near_documents(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, texts[0]), (5, texts[0]), (5, texts[0]), (None, "only here it is said")], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), r.class_id, r.class_size, r.kept) for r in jaccard.near_documents(odd).collect() if r.class_id) == [(-1, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True)]


def test_one_id_on_two_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "VERIFY_ROWS", 2)
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, a + " other"), (5, a + " last"), (5, b + " last"), (6, "alone it is said here")]
    sets = {}
    for k, t in rows:
        w = words_of(t)
        sets.setdefault(k, []).append({tuple(w[n : n + 5]) for n in range(len(w) - 4)})
    links = {k: {j for j in sets if j != k and any(len(x & y) >= 0.8 * len(x | y) for x in sets[k] for y in sets[j])} for k in sets}
    assert links[1] == {2, 3, 4, 5} and links[2] == {1, 4, 5} and links[3] == {1, 5}
    got = jaccard.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_links, r.component_id) for r in got} == {(k, len(links[k]), 6 if k == 6 else 1) for k in sets} and len(got) == len(rows)


def test_pipeline_keeps_one_of_equal_sets(spark):
    import corpus_pipeline

    df = docs_of(spark, ["One two three four five six", "one two, three four five six!", "something else is said in here"]).withColumn("doc_id", F.lit(7).cast("long"))
    got = [r.text.lower()[:3] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(got) == ["one", "som"]


def test_stages_keep_columns_and_define_edge_rows(spark, sf_dir):
    import corpus_pipeline

    texts = [None, "", "...", "the water of the house and the garden is here today", "the water of the house and the garden is here today"]
    taken = {c: F.lit("own") for c in ("score", "passages", "lang_pred", "_src", "spans", "n_words", "_set", "kept", "ids", "a.b")}
    docs = docs_of(spark, texts, 900_000).withColumns(taken)
    expected = {"toxicity": 5, "language": None, "near_copies": 4, "decontamination": 5, "tokens": 5}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        rows = found.collect()
        if name != "tokens":
            assert found.columns == docs.columns and all(r[c] == "own" for r in rows for c in taken), name
        assert expected[name] is None or len(rows) == expected[name], name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    need = jaccard.least_matches(0.8)
    for step, m in enumerate(need):
        n = jaccard.STEP * (step + 1)
        lost = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert lost < 1e-5 and m > 0


# op10


def test_bpe(spark):
    import public_tokenizers as tokenizers
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bpe.load_vocabulary(path)
    assert all(vocabulary.whole.get(t) == r for t, r in vocabulary.ranks.items()) and vocabulary.whole.get(b"\xff\xfe\xfd no key") is None
    theirs = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0, 0x250), 0x85, 0xA0, 0x2028, 0x3000, 0x1F600, 0x4E2D, 0x301] if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(300)] + [None, "", "<|endoftext|>", "a" * 5000, " \n \n", "it's\x1c\x1d x"]
    df = docs_of(spark, texts).withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.decode_documents(bpe.encode_documents(df, path, tokenizers.PATTERN), path).collect()}
    for k, t in enumerate(texts):
        assert np.frombuffer(got[k].ids, "<u4").tolist() == theirs.encode_ordinary(t or ""), repr(t)
        assert bytes(got[k].decoded) == (t or "").encode()
    assert bpe.encode_documents(df.limit(0), path, tokenizers.PATTERN).count() == 0
