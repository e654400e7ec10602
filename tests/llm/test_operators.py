"""Each operator against brute force, SQL, a round trip or held-out labels, and on the odd cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from check import canonical
from ledgerlens.llm import chat, common, decontam, knn, language, licenses, packing, simhash, suffixes, toxicity, urls
from ledgerlens.llm.queries import LLM_QUERIES, LLM_SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double, segment long, part int, cell int"


def documents(spark, texts, lang="en"):
    """Documents 0, 1, ... with columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, lang, "s", len(t or ""), "x", 9.0, 1, 2, 3) for k, t in enumerate(texts)], SCHEMA)


ODD = [None, "", "   \n\t", "one", "one", "%%% !!! 12", "é", "word " * 5000, "日本語 テキスト", "\U0001d4d0 letter", "a\x00b"]


@pytest.fixture(scope="module")
def odd(spark):
    some = documents(spark, ODD)
    unnamed = some.limit(4).withColumn("doc_id", F.lit(None).cast("long"))
    return some.unionByName(some.where("doc_id = 3")).unionByName(unnamed).coalesce(2)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, ["x"]).limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, res = LLM_QUERIES[name](spark, SF), con.execute(LLM_SQL[name])
    columns = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, res.fetchall())


# SimHash


def plain_fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints, budget):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark, docs, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in LLM_QUERIES["op1_simhash"](spark, SF).collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    parts = plain_components(sorted(texts), prints, 4)
    assert got == {d: (f"{prints[d]:016x}", parts[d]) for d in texts}


@pytest.mark.parametrize("bits, budget", [(64, 4), (64, 3), (64, 0), (128, 16), (64, 7)])
def test_trie_join_finds_all_links(spark, monkeypatch, bits, budget):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(bits + budget)
    base = [rng.getrandbits(bits) for _ in range(40)]
    values = {b ^ sum(1 << k for k in rng.sample(range(bits), rng.randint(0, budget + 2))) for b in base for _ in range(8)}
    values |= {base[0] ^ (1 << k) for k in range(bits)}  # a crowd around one value
    values = sorted(values)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, signed(v >> (bits - 64)), signed(v & (1 << 64) - 1) if bits > 64 else 0) for k, v in enumerate(values)]
    prints = spark.createDataFrame(rows, "node long, w0 long, w1 long")
    found = common.components(simhash.links(prints, budget, bits)).collect()
    got = {k: k for k in range(len(values))} | {r.node: r.component for r in found}
    assert got == plain_components(range(len(values)), values, budget)


def test_turns_link_as_brute_force(spark, monkeypatch):
    """Groups of prints that differ in up to 30 of 192 bits, and a crowd over several blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(4)
    base = [rng.getrandbits(192) for _ in range(60)]
    values = sorted({b ^ sum(1 << k for k in rng.sample(range(192), rng.randint(0, 15))) for n, b in enumerate(base) for _ in range(8 if n else 400)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, *(signed(v >> s & (1 << 64) - 1) for s in (128, 64, 0))) for k, v in enumerate(values)]
    prints = spark.createDataFrame(rows, "node long, w0 long, w1 long, w2 long")
    found = common.components(simhash.set_print_links(prints, 0.8, 0.001)).collect()
    got = {k: k for k in range(len(values))} | {r.node: r.component for r in found}
    assert got == plain_components(range(len(values)), values, simhash.plan(len(values), 0.8, 0.001)[0])


def test_near_copies_do_not_compare_all_pairs(monkeypatch):
    """Four times the unrelated prints: well under 16 times the pairs, and under a tenth of all."""
    monkeypatch.setattr(simhash, "BLOCK", 256)
    pairs, seen = [], simhash.compared

    def counted(*ranges):
        for i, j in seen(*ranges):
            pairs[-1] += len(i)
            yield i, j

    monkeypatch.setattr(simhash, "compared", counted)
    rng = np.random.default_rng(2)
    for nodes in (8000, 32000):
        pairs.append(0)
        budget, depth, turns = simhash.plan(nodes, 0.8, 0.001)
        words = list(rng.integers(0, 2**64, (3, nodes), dtype=np.uint64))
        bits = simhash.bit_rows(words)
        for turn in range(turns):
            at = simhash.turned(bits, turn) >> np.uint64(64 - depth)
            for node in np.unique(at):
                own = np.flatnonzero(at == node)
                a, _ = simhash.turn_links(own, [w[own] for w in words], own, [w[own] for w in words], True, turn, depth, budget)
                assert not len(a)
    assert pairs[1] < 8 * pairs[0] and pairs[1] < 0.1 * 32000**2 / 2


def test_simhash_odd_cases(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.fingerprint, r.component_id))
    assert {by[k][0] for k in (0, 1, 2)} == {("0" * 16, 0)}
    assert len(by[3]) == 2 and by[3][0] == by[3][1] == by[4][0] and by[3][0][1] == 3
    assert len(by[None]) == 4 and all(c == 0 or f == by[3][0][0] for f, c in by[None])
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(200, 300)] + [(1000, 1000 + k) for k in range(1, 500)] + [(5, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 200 for k in range(200, 301)} | {1000 + k: 1000 for k in range(500)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Languages


def test_language_held_out(spark):
    rows = LLM_QUERIES["op2_language"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_kneser_ney_equals_direct_computation(spark):
    """On a small alphabet, without hash clashes, the model gives the textbook probabilities, which sum to one."""
    sample = ["abba baab", "aab abb", "bab"]
    marked = spark.createDataFrame([(t, "x", k == 1) for k, t in enumerate(sample)], "text string, lang string, sampled boolean")
    counted = language.count_grams(marked)
    without = Counter(int(g) for t in sample[::2] for g in language.grams(language.Letters().of(t)))
    assert {r.gram % 2**64: r.rest for r in counted.collect() if r.rest} == without
    model = language.fit_counts(counted.select("lang", "gram", "n"))
    letters = language.Letters()
    grams = Counter(int(g) for t in sample for g in language.grams(letters.of(t)))
    low = lambda g, n: g & (1 << 16 * n) - 1
    counts = {4: grams}
    for n in (3, 2, 1):
        counts[n] = Counter(low(g, n) for g in {low(g, n + 1) for g in grams})
    alphabet = len(counts[1])

    def p(g, n):
        if n == 0:
            return 1 / (alphabet + 1)
        same = {x: c for x, c in counts[n].items() if x >> 16 == low(g, n) >> 16}
        if not same:
            return p(g, n - 1)
        total = sum(same.values())
        return max(same.get(low(g, n), 0) - 0.75, 0) / total + 0.75 * len(same) / total * p(g, n - 1)

    for g in grams:
        assert 2 ** model.log2("x", np.array([g], np.uint64))[0] == pytest.approx(p(g, 4), rel=1e-4)


@pytest.mark.parametrize("fold", (0, 1, 3))
def test_language_of_one_document_is_learned(spark, fold):
    """Whatever the hash of the one document's id, calibration does not keep it from being counted."""
    one = next(k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 4 == fold)
    texts = [f"the cat number {k} sat on the mat and looked at the other cats" for k in range(40)]
    frame = documents(spark, texts).unionByName(
        spark.createDataFrame([(one, "die Katze schläft nicht über der großen Straße", "de"), (one + 1000, "über die große Straße", None)], "doc_id long, text string, lang string"), allowMissingColumns=True
    )
    got = {r.doc_id: r.lang_pred for r in language.identify(frame).collect()}
    assert got[one + 1000] == "de" and got[0] == "en"


def test_language_odd_cases(spark, odd, empty):
    rows = language.identify(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = "" if r.doc_id is None else ODD[r.doc_id] or ""
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
    assert language.identify(empty).count() == 0
    unlabelled = documents(spark, ["some text", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identify(unlabelled).collect()} == {("und", 0.0)}


# Packing


def check_packing(pieces, texts, size):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    by, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(texts)
    for d, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            ids = want[d][at : at + r.length]
            assert (r.start, r.doc_tokens) == (at, len(want[d])) and r.length == len(ids) > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += r.length
        assert at == len(want[d])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing_covers_every_id_once(spark, texts):
    assert check_packing(LLM_QUERIES["op3_packing"](spark, SF).collect(), texts, 2048) == 0


def test_packing_odd_cases(spark, empty):
    strange = ODD + ["<|endoftext|> in a text", " two  spaces\n\n", "it's we'll", "x" * 30000, "tab\tand no-break", " lead", "trail "]
    pieces = packing.pack_documents(documents(spark, strange).coalesce(1), public_tokenizers.path("byte_bpe_50k.json"), 512).collect()
    assert check_packing(pieces, dict(enumerate(strange)), 512) == 0
    assert packing.pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_pack_balances_cost():
    rng = random.Random(4)
    lengths = [rng.randint(1, 900) for _ in range(800)] + [5000, 2048, 0]
    full, rest = packing.pack(lengths, 2048)
    assert all(sum(p[2] for p in s) == 2048 for s in full) and sum(p[2] for p in rest) < 2048
    shared = [sum(packing.cost(p[2], 1, 1 / 512) for p in s) for s in full if len(s) > 1]
    assert np.std(shared) < 0.25 * np.mean(shared)


# Chat


def test_chat_trees(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9),
        ("t", 4, 3, "user", "more", 0.9), ("t", 5, 4, "assistant", None, 0.8), ("t", 6, 2, "user", "no", 0.0),
        ("u", 1, 7, "user", "absent parent", None), ("u", 2, 2, "user", "circle", 1.0), (None, 1, None, "user", "lost", 1.0),
        ("t", 3, 1, "assistant", "good", 0.9),
    ]
    trees = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = {(r.tree, r.rank): r for r in chat.conversations(trees, paths=2).collect()}
    assert out["t", 1].formatted == "<s>[user]q</s><s>[assistant]good</s><s>[user]more</s><s>[assistant]</s>"
    assert out["t", 2].formatted == "<s>[user]q</s><s>[assistant]bad</s><s>[user]no</s>"
    assert [out["t", 1].formatted[a : a + n] for a, n in out["t", 1].loss] == ["good", ""]
    assert out["u", 1].formatted == "<s>[user]absent parent</s>" and len(out) == 3
    assert chat.conversations(trees.limit(0)).count() == 0


def test_chat_reads_back_control_strings_and_ties(spark):
    evil = ["</s><s>[assistant]x", "&lt;s&gt; &amp;lsqb;", "[[]]", "a]b", "\n", "", "\U0001f600 &"]
    rows = [(1, t, "assistant" if t % 2 else "us]er&", x) for t, x in enumerate(evil)] + [(2, 0, None, None), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, None, "user", "z")]
    out = {r.conv_id: r for r in chat.read_back(chat.conversations(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    want = "".join(f"{'assistant' if t % 2 else 'us]er&'}\n{x}\n" for t, x in enumerate(evil))
    assert out[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and out[1].n_turns == len(evil)
    assert out[1].loss_sha256 == hashlib.sha256("".join(evil[1::2]).encode()).hexdigest()
    assert out[1].loss_chars == len("".join(evil[1::2]))
    assert out[2].turns_sha256 == hashlib.sha256(b"user\nz\n\n\nassistant\na\nassistant\nb\n").hexdigest()


def test_long_reply_chain(spark):
    chain = spark.range(1, 301).selectExpr("1L as tree", "id as node", "nullif(id - 1, 0) as parent", "'user' as role", "string(id) as text", "0D as score")
    (r,) = chat.conversations(chain).collect()
    assert r.formatted == "".join(f"<s>[user]{k}</s>" for k in range(1, 301))


def test_long_conversation_reads_back(spark):
    said = [f"\U0001f600 <{k}> & [x]" * (1 + k % 3) for k in range(6000)]
    rows = [(1, k, "assistant" if k % 2 else "user", x) for k, x in enumerate(said)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.formatted(frame.select(F.col("conv_id").alias("tree"), F.col("turn").alias("depth"), "role", "text"), ["tree"])).collect()
    assert r.n_turns == 6000 and r.loss_sha256 == hashlib.sha256("".join(said[1::2]).encode()).hexdigest()


def test_best_branches_of_a_wide_tree(spark):
    scores = [(7 * k) % 1000 / 10 for k in range(1000)]
    rows = [(1, 0, None, "user", "q", 0.0)] + [(1, k + 1, 0, "assistant", f"a{k}", s) for k, s in enumerate(scores)]
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {r["rank"]: r.formatted for r in chat.conversations(frame, paths=5).collect()}
    best = sorted(range(1000), key=lambda k: (-scores[k], k))[:5]
    assert got == {n + 1: f"<s>[user]q</s><s>[assistant]a{k}</s>" for n, k in enumerate(best)}


# Toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = LLM_QUERIES["op5_toxicity"](spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_nearest_examples_are_exact():
    rng = random.Random(2)
    idf = {f"t{k}": 1 + rng.random() for k in range(30)}
    counts = [{f"t{k}": rng.randint(1, 4) for k in rng.sample(range(30), rng.randint(1, 6))} for _ in range(300)]
    index = toxicity.Index(idf, list(range(300)), [k % 2 for k in range(300)], counts)

    def unit(c):
        w = {t: (1 + np.log(n)) * idf[t] for t, n in c.items() if t in idf}
        size = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    held = [unit(c) for c in counts]
    for q in counts[:60]:
        u = unit(q)
        cosines = [(round(sum(x * v.get(t, 0) for t, x in u.items()), 9), e) for e, v in enumerate(held)]
        want = sorted(((c, e) for c, e in cosines if c > 0), key=lambda x: (-x[0], x[1]))[: toxicity.NEIGHBOURS]
        assert [c for c, _ in want] == pytest.approx([c for c, _, _ in index.nearest(q)], abs=2e-9)
    assert index.nearest({"unknown": 1}) == []


def test_copies_of_labelled_texts_score_like_them(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=9))
    texts = [" ".join(word() for _ in range(40)) for _ in range(120)]  # no term is shared, so none tells about a label
    labelled = [k for k in range(120) if zlib.crc32(str(k).encode()) % 4 != 2]
    toxic = {k: int(n % 3 == 0) for n, k in enumerate(labelled)}
    found = toxicity.toxicity(
        documents(spark, texts + [texts[k] for k in labelled]), spark.createDataFrame([(k, 1, y) for k, y in toxic.items()], "doc_id long, quality int, toxic int")
    )
    got = {r.doc_id: r for r in found.collect()}
    for n, k in enumerate(labelled):
        copy = got[120 + n]
        assert copy.predicted == toxic[k] and copy.evidence[0].doc_id == k and copy.evidence[0].cosine == 1


def test_examples_keep_to_their_bounds(spark):
    docs = documents(spark, ["a" * (k + 1) for k in range(40)])
    sample = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, y int")
    some = toxicity.chosen_examples(docs, sample, examples=5, letters=100).collect()
    for label in (0, 1):
        own = [len(r.text) for r in some if r.y == label]
        assert 0 < len(own) <= 5 and sum(own) <= 100


def test_toxicity_odd_cases(spark, odd, empty, labels):
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.toxicity(empty, labels).count() == 0
    none = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    one = toxicity.toxicity(odd, spark.createDataFrame([(d, 1, t) for d in range(8) for t in (1, 1, None)], "doc_id long, quality int, toxic int")).collect()
    assert all(0 <= r.score <= 1 for r in one)


# Search


def test_top_k_with_ties_and_odd_rows(spark):
    rng = random.Random(5)
    data = [(k, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(300)] + [(k, [0.5, 0.5, 0.5, 0.5]) for k in range(300, 420)]
    odd_rows = [(500, None), (501, [1.0, None, 1.0, 1.0]), (502, [float("nan")] * 4), (503, [float("inf")] * 4), (None, [1.0] * 4), (504, [1.0, 2.0]), (505, [])]
    vectors = knn.integers(spark.createDataFrame(data + odd_rows, "vec_id long, embedding array<double>"))
    held = {k: [int(np.floor(64 * x)) for x in v] for k, v in data} | {504: [64, 128], 505: []}
    got = defaultdict(list)
    for r in knn.top_k(vectors, vectors.where("vec_id % 20 = 0 or vec_id in (504, 505)"), k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in [k for k in held if k % 20 == 0 or k > 503]:
        best = sorted((-sum(a * b for a, b in zip(held[q], v)), k) for k, v in held.items() if k != q and len(v) == len(held[q]))[:7]
        assert got.get(q, []) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert knn.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_bounds_leave_out_far_cells(spark):
    data = [(k, [100 * (k % 4 == 0), 100 * (k % 4 == 1), 100 * (k % 4 == 2), 100 * (k % 4 == 3)]) for k in range(400)]
    pivots = [data[k][1] for k in range(4)]
    placed = knn.placed(spark.createDataFrame(data, "vec_id long, v array<long>"), pivots)
    cells = placed.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).collect()
    assert sorted(knn.needed(cells, cells, pivots, 20)) == [(4, k, k) for k in range(4)]


# URLs


def test_url_parts_rules_and_model(spark):
    cases = [
        ("HTTP://A.Net/x", "a.net", "/x", "net/", "block"), ("https://www.example.net/en/1?x=1", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"), ("http://sub.example.com/de/1#t", "sub.example.com", "/de/1", "example.com/de/", "block"),
        ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"), ("http://x.org/FR/", "x.org", "/FR/", None, None), ("x", "", "", None, None), (None, "", "", None, None),
        ("a://b?c/d", "b", "", None, None), ("a://b#/net/", "b", "", None, None), ("://", "", "", None, None), ("http://net?/", "net", "", None, None),
        ("http://cheap-pills-casino.example.com/en/1", "cheap-pills-casino.example.com", "/en/1", None, "block"),
        ("http://blog.meadow.example.com/en/1", "blog.meadow.example.com", "/en/1", None, "allow"), ("http://" + "y" * 100000, "y" * 100000, "", None, None),
        ("", "", "", None, None), ("http://É.com/a\nb", "É.com", "/a\nb", None, None),
    ]
    pages = spark.createDataFrame([(k, c[0], "<html>", "x") for k, c in enumerate(cases)], "page_id long, url string, html string, host string")
    model = urls.train(spark)
    out = {r.page_id: r for r in urls.judge(pages, model).collect()}
    assert len(out) == len(cases)
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        r = out[k]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert urls.judge(pages.limit(0), model).count() == 0


# Passages


def marked(pairs, texts):
    out = defaultdict(set)
    for r in pairs:
        a, b = common.lower_words(texts[r.doc_id]), common.lower_words(texts[r.first_doc_id])
        assert r.first_doc_id < r.doc_id and r.n_words >= 50
        assert a[r.start : r.start + r.n_words] == b[r.first_start : r.first_start + r.n_words] and r.start + r.n_words <= len(a)
        out[r.doc_id].update(range(r.start, r.start + r.n_words))
    return out


def plain_passages(texts, n=50):
    first, out = {}, defaultdict(set)
    for d in sorted(texts):
        words = common.lower_words(texts[d])
        own = [(tuple(words[p : p + n]), p) for p in range(len(words) - n + 1)]
        for g, p in own:
            if g in first:
                out[d].update(range(p, p + n))
        for g, _ in own:
            first.setdefault(g, d)
    return out


def test_passages_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    shared = [[word() for _ in range(n)] for n in (50, 51, 55, 60, 80, 300, 49, 40)]
    texts = {}
    for d in range(120):
        parts = [[word() for _ in range(rng.randint(0, 40))] for _ in range(4)]
        for k in range(3):
            parts.insert(2 * k + 1, rng.choice(shared))
        texts[d] = " ".join(w for p in parts for w in p)
    texts |= {200: texts[3], 201: " ".join(shared[0]), 202: " ".join(shared[6]), 203: "", 204: " ".join(shared[4]).upper()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("h", F.lit(1))
    got, want = marked(suffixes.repeated_passages(frame).collect(), texts), plain_passages(texts)
    # Where three documents share parts of different lengths, the ends of a passage may be some words short.
    assert set(got) == {d for d in want if want[d]} and all(got[d] <= want[d] for d in got)
    assert sum(map(len, got.values())) >= 0.995 * sum(map(len, want.values()))


def test_passages_behind_shared_stretches(spark):
    """Documents 4k + 1 and 4k + 3 share 52 words; the first and the one between share 49 of them only."""
    rng, texts = random.Random(11), {}

    def some(n):
        return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]

    for k in range(30):
        stretch, rest = some(49), some(3)
        for d in range(4):
            texts[4 * k + d] = " ".join(some(40) + stretch + (rest if d % 2 else some(3)) + some(40))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got, want = marked(suffixes.repeated_passages(frame).collect(), texts), plain_passages(texts)
    assert got == want


def test_passages_of_the_data(spark, docs, texts):
    got, want = marked(LLM_QUERIES["op8_passages"](spark, SF).collect(), texts), plain_passages(texts)
    assert set(got) == {d for d in want if want[d]} and all(got[d] <= want[d] for d in got)
    assert sum(map(len, got.values())) >= 0.98 * sum(map(len, want.values()))


def test_passages_over_many_ranges(spark):
    """A passage that most documents share begins in one range of the sorted suffixes and goes on in many."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        passage = " ".join(f"w{k}" for k in range(60))
        texts = {d: f"a{d} b{d} {passage} c{d}" for d in range(400)}
        frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
        rows = suffixes.repeated_passages(frame).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = marked(rows, texts)
    assert set(got) == set(range(1, 400)) and all(v == set(range(2, 62)) for v in got.values())
    assert {r.first_doc_id for r in rows if r.doc_id > 1} >= {0}


def test_passages_of_whole_copies_need_no_lookup(spark, monkeypatch):
    """Runs inside stretches that are alike are not written one by one; those at the ends of a shared passage are."""
    rng, sizes, kept = random.Random(13), {}, suffixes.stage

    def counted(df, name, **more):
        out = kept(df, name, **more)
        sizes[name] = out.count()
        return out

    def some(n):
        return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))

    monkeypatch.setattr(suffixes, "stage", counted)
    base, passage = some(2000), some(400)
    texts = {d: base for d in range(20)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert marked(suffixes.repeated_passages(frame).collect(), texts) == {d: set(range(2000)) for d in range(1, 20)}
    assert sizes["suffix-windows"] == 0
    texts = {d: f"{some(30)} {passage} {some(30)}" for d in range(20)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert marked(suffixes.repeated_passages(frame).collect(), texts) == {d: set(range(30, 430)) for d in range(1, 20)}
    assert 0 < sizes["suffix-windows"] <= 20 * 4 * 21


def test_passages_are_all_marked(spark, monkeypatch):
    """Repeats within a document, parts of passages in other ones, ranges that cut runs: no word less than brute force."""
    rng = random.Random(17)
    word = lambda: rng.choice("abcdefgh") + rng.choice("abcdefgh")
    shared, texts = [[word() for _ in range(n)] for n in (50, 52, 60, 75, 90, 140, 300)], {}
    for d in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            part = rng.choice(shared)
            cut = rng.randint(0, len(part) - 40)
            parts += [[word() for _ in range(rng.randint(0, 25))], part[cut:] if rng.random() < 0.5 else part]
        texts[d] = " ".join(w for p in parts for w in p)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = plain_passages(texts)
    assert marked(suffixes.repeated_passages(frame).collect(), texts) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert marked(suffixes.repeated_passages(frame).collect(), texts) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_passages_odd_cases_and_cutting(spark, odd, empty):
    assert suffixes.repeated_passages(empty).count() == 0
    assert suffixes.repeated_passages(odd).count() == 0
    assert suffixes.cut_words(" a  b c\nd ", [{"start": 1, "n_words": 2}]) == " a  d "
    assert suffixes.cut_words(None, None) is None and suffixes.cut_words("é ü", [{"start": 0, "n_words": 2}]) == ""
    passage = " ".join(f"w{k}" for k in range(60))
    frame = documents(spark, [passage + " x", "y " + passage + " z", passage, None, "clean"])
    kept = suffixes.without_passages(frame, suffixes.repeated_passages(frame))
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {
        0: (passage + " x", len(passage) + 2), 1: ("y z", 3), 3: (None, 0), 4: ("clean", 5)
    }
    assert kept.columns == frame.columns


# Decontamination


def plain_overlap(doc, item, least, share):
    """Whether some alignment has a stretch of ``least`` tokens or more, equal at both ends and equal enough."""
    need = min(least, len(item))
    for shift in range(-len(item) + 1, len(doc)):
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        same = [doc[q + shift] == item[q] for q in range(lo, hi)]
        if any(
            same[i] and same[j - 1] and sum(same[i:j]) >= share * (j - i) - 1e-9 for i in range(len(same)) for j in range(i + need, len(same) + 1)
        ):
            return True
    return False


@pytest.mark.parametrize("n", range(1, 26))
def test_masks_miss_no_substitutions(n):
    """Every way to substitute a fifth of n tokens leaves a place for a mask; in parts of longer stretches also at the ends."""
    places = range(n) if n >= 13 else range(1, n - 1)
    fits = [sum(1 << (p + k) for k, c in enumerate(decontam.MASKS[m]) if c == "1") for m in decontam.masks_for(n) for p in range(n - len(decontam.MASKS[m]) + 1)]
    for cut in itertools.combinations(places, n // 5):
        gone = sum(1 << p for p in cut)
        assert any(not f & gone for f in fits), cut


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = {k: [word() for _ in range(n)] for k, n in enumerate((8, 10, 13, 15, 20, 30, 45, 5, 7, 3, 1, 2))}
    docs_ = {}
    for d in range(150):
        body = [word() for _ in range(rng.randint(0, 50))]
        piece = list(rng.choice(list(items.values())))
        cut = rng.randint(0, max(0, len(piece) - 10))
        piece = [word() if rng.random() < rng.choice((0, 0.1, 0.25)) else w for w in piece[cut:]]
        docs_[d] = body + piece + [word()]
    frame = spark.createDataFrame([(d, " ".join(w).title() + ".") for d, w in docs_.items()], "doc_id long, text string").withColumn("tokens", F.lit(1))
    bench = spark.createDataFrame([(k, ", ".join(w)) for k, w in items.items()] + [(90, None), (None, "x")], "item_id long, text string")
    rows = decontam.contaminated(frame, bench).collect()
    want = {(d, k) for d, w in docs_.items() for k, i in items.items() if plain_overlap(w, i, 13, 0.8)}
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(want) > 50
    for r in rows:
        assert r.n_equal >= 0.8 * r.n_tokens - 1e-9
    assert decontam.contaminated(frame.limit(0), bench).count() == 0 and decontam.contaminated(frame, bench.limit(0)).count() == 0


def test_longest_overlap():
    rng = np.random.default_rng(1)
    for _ in range(500):
        n = int(rng.integers(1, 40))
        item, doc, shift = rng.integers(0, 3, n), rng.integers(0, 3, int(rng.integers(1, 60))), int(rng.integers(-10, 20))
        lo = max(0, -shift)
        same = [doc[q + shift] == item[q] for q in range(lo, min(n, len(doc) - shift))]
        every = [(j - i, -i) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i] and same[j - 1] and sum(same[i:j]) >= 0.8 * (j - i) - 1e-9]
        best = max(every, default=None)
        want = None if best is None or best[0] < min(13, n) else (lo + shift - best[1], best[0])
        got = decontam.overlap(doc, item, shift, 13, 0.8)
        assert (got and got[:2]) == want


def test_decontamination_of_the_data(spark, texts):
    items = {r.item_id: decontam.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    runs = {tuple(w[p : p + 13]) for w in items.values() for p in range(len(w) - 12)}
    want = {d for d, t in texts.items() for w in [decontam.tokens(t)] if any(tuple(w[p : p + 13]) in runs for p in range(len(w) - 12))}
    assert want <= {r.doc_id for r in LLM_QUERIES["op9_contaminated"](spark, SF).collect()}


# Licences


def test_licenses(spark, empty):
    mit = dict(licenses.KNOWN)["MIT"]
    cases = [
        ("Copyright (c) 2020 Someone\n" + mit.replace("\n", " ").upper(), "MIT"), (mit.replace(",", " ;"), "MIT"), (mit + " more", None),
        ("text\nreleased under the  MIT Licence!!\n", None), (None, None), ("***", None), ("© 1999 A\n(c) 2001 B\nAll rights reserved.", None),
    ]
    out = {r.doc_id: r for r in licenses.scan(documents(spark, [c[0] for c in cases])).collect()}
    assert {d: r.license_id for d, r in out.items()} == {k: c[1] for k, c in enumerate(cases)}
    assert out[3].line_licenses == "MIT-notice" and all(out[k].digest is None for k in (4, 5, 6))
    assert licenses.scan(empty).count() == 0


def test_licenses_as_published(spark):
    known = dict(licenses.KNOWN)
    owner = "\n\nCopyright (c) 2021, Some Body\nAll rights reserved.\n\n"
    cases = [(title + owner + known[i], i) for i, titles in licenses.TITLES.items() for title in titles]
    cases += [(title.upper() + owner + "\n" + licenses.NUMBERED.sub("  * ", known[i]), i) for i, titles in licenses.TITLES.items() for title in titles]
    cases += [(known[i], i) for i in licenses.TITLES] + [("MIT License", None), ("MIT License" + owner + known["ISC"], None)]
    got = {r.doc_id: r.license_id for r in licenses.scan(documents(spark, [c[0] for c in cases])).collect()}
    assert got == {k: c[1] for k, c in enumerate(cases)}


def test_licenses_odd_cases(odd):
    assert licenses.scan(odd).count() == odd.count()
