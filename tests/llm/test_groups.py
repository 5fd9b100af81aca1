"""Packing, spelling variants and the prefix trie against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import array
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from datelore.llm import components, decontaminate, jaccard, language, licenses, packing, prefixes, shards, spelling, vectors
from tests.compare import rows

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# op11


def word_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids + [0]


def is_packing(frame, capacity):
    placed = frame.sort_values(["sequence_id", "offset"])
    gapless = placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset
    return bool(gapless.all()) and frame.groupby("sequence_id").length.sum().max() <= capacity


def fewest(sizes, capacity):
    """The fewest bins, by trying every bin for every piece, the largest first."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def put(k, room):
        if len(room) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(room)
            return
        for r in sorted(set(room)):
            if r >= sizes[k]:
                left = list(room)
                left[left.index(r)] -= sizes[k]
                put(k + 1, left)
        put(k + 1, [*room, capacity - sizes[k]])

    put(0, [])
    return best[0]


def test_pieces_are_those_of_the_tokenizer(spark):
    texts = [
        None, "", "Hello, WORLD don't DON'T 'S 1234", "É é É İstanbul straße ÀÉ×÷ ªº ÿ", " a\x1cb\tc d e", "日本語 テスト", "<|endoftext|> <|startoftext|>".replace("|", " "),
        "word " * 700, "x" * 9000, "a.b.c..d 'll'll", "\n\n \n", "Ǆ Σς ̀a",
    ]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, length string")
    got = defaultdict(dict)
    for r in packing.encode_pieces(docs, VOCABULARY, 256, with_ids=True).collect():
        got[r.doc_id][r.piece] = r
    for k, t in enumerate(texts):
        ids = word_ids(t)
        assert sorted(got[k]) == list(range(-(-len(ids) // 256)))
        for p, r in got[k].items():
            part = array.array("I", ids[256 * p : 256 * p + 256]).tobytes()
            assert (r.start, r.length, r.ids_crc32, bytes(r.ids)) == (256 * p, len(part) // 4, zlib.crc32(part), part)
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


def test_packing_of_documents_with_repeated_and_null_ids(spark):
    rng = random.Random(1)
    rows_ = [(rng.choice([1, 2, None]), rng.choice([None, "", "word " * rng.randint(1, 90)])) for _ in range(150)] + [(7, "many words " * 300)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    packed = packing.pack_documents(docs, VOCABULARY, 128, with_ids=True, shard_pieces=20, islands=2, epochs=2)
    frame = packed.toPandas()
    assert is_packing(frame, 128)
    want = Counter((i, k // 128, min(128, len(ids) - k)) for i, t in rows_ for ids in [word_ids(t)] for k in range(0, len(ids), 128))
    assert Counter((None if pd.isna(r.doc_id) else r.doc_id, r.piece, r.length) for r in frame.itertuples()) == want
    assert frame.sequence_id.nunique() <= -(-frame.length.sum() // 128) + 4  # shards of 20 pieces leave open ends
    sequences = packing.token_sequences(packed).collect()
    assert sum(r.n_tokens for r in sequences) == frame.length.sum() and all(len(r.ids) == 4 * r.n_tokens <= 512 for r in sequences)


@pytest.mark.parametrize("seed", range(6))
def test_lower_bound_and_evolution_against_the_optimum(seed):
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.integers(1, 60, 11)]
    best = fewest(sizes, 60)
    assert packing.lower_bound(np.array(sizes), 60) <= best
    start = [packing.best_fit(rng.permutation(len(sizes)).tolist(), sizes, 60) for _ in range(4)]
    found = packing.evolve(start, sizes, 60, 0, 200, rng)[0]
    assert len(found.bins) == best and sorted(k for b in found.bins for k in b) == list(range(len(sizes)))
    assert [sum(sizes[k] for k in b) for b in found.bins] == found.fills and max(found.fills) <= 60


def test_crossover_beats_best_fit_where_pieces_come_in_threes(spark):
    rng, rows_ = np.random.default_rng(5), []
    for _ in range(20):  # three pieces fill a sequence exactly, one of them above a third
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2 + 1))
        rows_ += [a, b, 1000 - a - b]
    greedy = packing.best_fit(packing.longest_first(range(60), rows_), rows_, 1000)
    items = spark.createDataFrame([(k, x) for k, x in enumerate(rows_)] + [(99, 1000)], "item long, length long")
    got = packing.pack(items, 1000, islands=4, epochs=4, children=300).toPandas().merge(items.toPandas())
    assert is_packing(got, 1000) and len(got) == 61
    assert 20 <= got[got.item != 99].sequence_id.nunique() < len(greedy.bins)


# op12


def counted_by_rule(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            counts[word if h % 97 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def grouped_by_rule(counts):
    words, near, form = sorted(counts), defaultdict(set), {}
    for k, a in enumerate(words):
        for b in words[k + 1 :]:
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x))
        if counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def test_variants_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "NODE_WORDS", 5)  # most nodes are hot and salted
    rng, words = random.Random(3), set()
    for _ in range(250):
        base = "".join(rng.choice("abcé×") for _ in range(rng.randint(5, 9)))
        words.add(base)
        for _ in range(3):
            k = rng.randrange(len(base))
            words.add(rng.choice([base[:k] + base[k + 1 :], base[:k] + rng.choice("abÿ") + base[k:], base[:k] + rng.choice("abcd") + base[k + 1 :]]))
    long = "".join(rng.choice("abcdefg") for _ in range(64))
    words |= {long, long + "x", "y" + long, long[:30] + "z" + long[31:], long[:30] + "q" + long[31:] + "x", "a" * 300, "a" * 301, "b" + "a" * 299, "a" * 150 + "c" + "a" * 149, "ab" * 200, "ab" * 200 + "a"}
    counts = {w: rng.choice([3, 4, 6, 8, 16, 40]) for w in words if len(w) >= 5}
    frame = spark.createDataFrame([(w, n, "clash") for w, n in counts.items()], "word string, n long, near string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(frame).collect()}
    assert got == grouped_by_rule(counts)
    assert sum(x[3] for x in got.values()) > 500 and any(x[0] and x[0] != x[1] for x in got.values())


def test_words_of_documents(spark):
    texts = [None, "", "Häuser häuser HÄUSER haus1haus2haus", "straße ×÷××÷ don't " * 3, "unknown, knowing. " * 40, "k" * 3000, "k" * 3000, "k" * 3000 + " ", "x" * 200_000 + " word"]
    docs = [(k % 40 if k % 7 else None, texts[k % len(texts)]) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash"))
    counts = {r.word: r.n for r in spelling.count_words(frame).collect()}
    assert counts == counted_by_rule(docs)
    assert spelling.group_variants(spelling.count_words(frame.limit(0))).count() == 0


def test_variants_of_all_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.QUERIES["op12_spelling_variants"](spark, sf_dir).collect()}
    counts = counted_by_rule(docs)
    by_left, near = defaultdict(set), defaultdict(set)  # all pairs would be many: words meet by what is left of them without a letter
    for w in counts:
        for k in range(len(w)):
            by_left[w[:k] + w[k + 1 :]].add(w)
    for left, group in by_left.items():
        for a in group | ({left} & set(counts)):
            near[a] |= {b for b in group | ({left} & set(counts)) if one_edit(a, b)}
    assert {w: x[2:4] for w, x in got.items()} == {w: (n, len(near[w])) for w, n in counts.items()}
    for w, (form, root, n, _, form_n) in got.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        assert (form, form_n) == ((best, counts[best]) if best and counts[best] >= 2 * n else (None, None))
        assert root == (got[form][1] if form else w)


# op13


def trie_by_rule(turns):
    """Nodes of a dict from conversation to its (role, text) turns, each recounted from all conversations."""
    members = defaultdict(list)
    for c in sorted(turns):
        for d in range(len(turns[c]) + 1):
            members[tuple(turns[c][:d])].append(c)
    out = []
    for node, inside in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:-1] == x for y in members if y)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in inside if len(turns[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((inside[0], len(node), parent, len(inside), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt_by_rule(rows_):
    own = defaultdict(list)
    for c, turn, role, text in rows_:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: heads[c]] + v[heads[c] :] for c, v in own.items()}


@pytest.mark.parametrize(("members", "levels", "held"), [(None, 1024, 200_000), (2, 2, 1), (1, 1, 3), (40, 3, 2)])
def test_trie_against_recounted_nodes(spark, members, levels, held):
    rng, rows_ = random.Random(members), []
    for c in [*range(0, 25), *range(100, 120), 300, 305, 777, 778]:
        for t in range(rng.choice([0, 1, 2, 4, 7])):
            rows_.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", None, "", "ü€"])))
    rows_ += [(0, 50 + t, "user", "same") for t in range(60)] + [(1, 50 + t, "user", "same") for t in range(40)]  # long ones, over several partitions
    rows_ += [(None, 1, "user", "lost"), (778, 3, "user", "x" * 5000), (778, 3, "user", "x" * 5000)]
    frame = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    got = prefixes.prefix_trie(prefixes.rebuilt(frame), members, levels, held).collect()
    assert sorted(map(tuple, got), key=str) == trie_by_rule(rebuilt_by_rule(rows_))
    assert prefixes.prefix_trie(prefixes.rebuilt(frame.limit(0))).count() == 0


def test_queue_spills_and_keeps_order():
    rng, queue, want = random.Random(2), prefixes.Messages(4), defaultdict(lambda: [0, 0, 0])
    for _ in range(300):
        key, value = (rng.randint(0, 9), bytes([rng.randint(0, 3)])), (1, rng.randint(0, 9), rng.randint(0, 9))
        queue.push((*key, *value))
        want[key] = [a + b for a, b in zip(want[key], value, strict=True)]
    assert len(queue.runs) > 5
    for key in sorted(want):
        assert queue.take(key) == want[key]
    assert len(queue) == 0


# components


@pytest.mark.parametrize("bound", [1, 3, 1000])
def test_components_with_hot_nodes(spark, monkeypatch, bound):
    monkeypatch.setattr(components, "NODE_EDGES", bound)
    rng = random.Random(bound)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500, k) for k in range(400, 460)] + [(k, 999) for k in range(600, 660)] + [(k, k + 1) for k in range(700, 740)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            u, v = find(a), find(b)
            parent[max(u, v)] = min(u, v)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


# labels of op1, sample of op4, curve of op3


@pytest.mark.parametrize(("kind", "values"), [("double", [1.2, 1.7, -0.0, 0.0]), ("string", ["a", "b", "c", "c"]), ("boolean", [True, False, True, None]), ("binary", [b"\xff", b"\xfe", b"x", b"x"])])
def test_labels_of_any_type(spark, kind, values):
    frame = spark.createDataFrame([(k, [1.0, 0.0], v) for k, v in enumerate(values)], f"vec_id long, embedding array<double>, label {kind}")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(frame).collect()}
    assert got == {k: sum(k != j and v is not None and v == w for j, w in enumerate(values)) for k, v in enumerate(values)}


def test_language_sample_is_bounded_by_rows(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one and the same text").alias("text"), F.lit("en").alias("lang"))
    taken = language._bounded(docs, F.xxhash64("doc_id", "text"), 500).count()
    assert 350 < taken < 650


def test_shards_restated(spark, sf_dir):
    got = shards.QUERIES["op3_hilbert_shards"](spark, sf_dir).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    docs["size"] = [len(t.encode()) + 16 for t in docs.text]
    n = len(docs)

    def cells(values, cuts):
        return np.array([sum(v > c for c in cuts) * 32 // (len(cuts) + 1) for v in values])

    by_size = sorted(docs["size"])
    quantiles = sorted({by_size[max(0, -(-n * k // 32) - 1)] for k in range(1, 32)})  # the smallest value with that share of the rows at or below it
    place = lambda values: np.array([sorted(set(values)).index(v) * 32 // len(set(values)) for v in values])
    docs["curve"] = shards.curve_index([place(docs.lang), place(docs.source), cells(docs["size"], quantiles)], 5)
    docs["crc"] = [zlib.crc32(t.encode()) for t in docs.text]
    first = {}
    for rank, r in enumerate(docs.sort_values(["curve", "crc", "doc_id"]).itertuples()):
        shard = rank * 40 // n
        first.setdefault(shard, rank)
        assert (got.loc[r.doc_id, "shard"], got.loc[r.doc_id, "slot"]) == (shard, rank - first[shard])


def test_shards_are_pruned_by_language(spark):
    sf_dir = "/root/testdata/sf0.01"
    shard_of = shards.QUERIES["op3_hilbert_shards"](spark, sf_dir).toPandas().set_index("doc_id").shard
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    for lang, of in docs.groupby("lang"):
        assert shard_of[of.doc_id].nunique() <= 3 * len(of) / len(docs) * 40, lang  # a language with a share p of the rows lies in no more than 3 p of the shards


def test_trie_of_all_conversations(spark, sf_dir):
    turns = pd.read_parquet(f"{sf_dir}/conversations.parquet")
    got = prefixes.QUERIES["op13_prefix_trie"](spark, sf_dir).toPandas()
    want = trie_by_rule(rebuilt_by_rule(turns[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None)))
    assert rows(got) == rows(pd.DataFrame(want, columns=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]))


# very long texts, and rows that repeat an id


LONG = " ".join(f"w{k % 9973}x{k % 7}" for k in range(150_000))


def test_contamination_at_the_end_of_a_long_text(spark):
    item = " ".join(f"test{k}" for k in range(20))
    frame = spark.createDataFrame([(1, f"{LONG} {item.upper()}"), (2, LONG), (3, f"{item} {LONG} {item[: item.index('test13')]}")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontaminate.mark_contamination(frame, bench).collect()}
    assert got == {1: (150_020, 20, ["7"]), 2: (150_000, 0, []), 3: (150_033, 33, ["7"])}


def test_license_at_the_end_of_a_long_text(spark):
    notice = licenses.TEMPLATES[1][1]
    frame = spark.createDataFrame([(1, f"{LONG} {notice}"), (2, LONG)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(frame, licenses.template_table(spark)).collect()}
    assert [s.label for s in got[1].spans] == ["mit"] and got[1].spans[0].first >= 150_000 - 5 and got[2].spans == []


def test_near_copies_of_a_long_text(spark):
    words = LONG.split()
    near = " ".join(w if k % 60 else "other" for k, w in enumerate(words))  # a shingle in twelve is another
    far = " ".join(w if k % 10 else "other" for k, w in enumerate(words))
    frame = spark.createDataFrame([(1, LONG), (2, near), (3, far), (4, LONG.upper())], "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in jaccard.near_documents(frame).collect()}
    a, b, c = (frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (words, near.split(), far.split()))
    assert len(a & b) / len(a | b) >= 0.8 > len(a & c) / len(a | c) and len(b & c) / len(b | c) < 0.8
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (1, 1, False)}


def test_one_defined_row_of_an_id_and_set_stays(spark):
    rows_ = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "de", "b"), (1, "ONE two three four five six", "aa", "c"), (2, "x", "en", "a")]
    kept = set()
    for order in (rows_, rows_[::-1], rows_[1:] + rows_[:1]):
        frame = spark.createDataFrame(order, "doc_id long, text string, lang string, source string").repartition(3)
        kept.add(tuple(sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, frame, "").collect()))))
    assert len(kept) == 1 and len(next(iter(kept))) == 2
