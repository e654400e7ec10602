"""The pipeline on planted cases, each stage on its own input."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import simhash

WORDS = random.Random(1)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, rng=WORDS):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, toxic ones, copies, shared passages and leaked items."""
    path = str(tmp_path_factory.mktemp("corpus"))
    texts, labels = {}, []
    for d in range(300):
        texts[d] = " ".join(words(120))
    for d in range(0, 120, 2):
        texts[d] += " vilest insultor"
        labels.append((d, 1, 1))
    labels += [(d, 1, 0) for d in range(1, 200, 2)]
    texts[500] = "vilest insultor " + " ".join(words(50))
    texts[501] = texts[201]
    near = texts[203].split()
    near[60] = "changed"
    texts[502] = " ".join(near)
    shared = " ".join(words(70))
    for d in (510, 511, 512):
        texts[d] = " ".join(words(90)) + " " + shared + " " + " ".join(words(90))
    item = words(40)
    texts[520] = " ".join(words(60) + item[:20] + ["other"] + item[21:] + words(60))
    texts |= {530: None, 531: ""}
    rows = [(d, t, "en", "s", len(t or "")) for d, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, shared


def test_stages_take_effect(spark, folder):
    path, texts, shared = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {*range(0, 120, 2), 500}
    assert set(kept["toxicity"]) == set(texts) - toxic
    assert set(kept["toxicity"]) - set(kept["simhash near-dedup"]) == {501, 502, 531}
    after = kept["suffix-array dedup"]
    assert set(after) == set(kept["simhash near-dedup"])
    assert [d for d in after if after[d] and shared in after[d]] == [510]
    assert {d for d in after if after[d] != texts[d]} == {511, 512}
    assert set(after) - set(kept["benchmark decontamination"]) == {520}
    pieces = corpus_pipeline.run(spark, path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in pieces} == set(kept["benchmark decontamination"]) and all(r.n == r.t for r in pieces)


def test_empty_and_unnamed_documents(spark, folder):
    path = folder[0]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0
    rows = [(None, "a b c", None, None, None), (None, None, None, None, None), (1, "x y", None, None, None), (1, "x y", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.count() == (4 if name == "toxicity" else 3)


def test_near_copies_at_the_threshold(spark):
    """Isolated pairs: of 180 five-word shingles, k replaced ones at the end leave a similarity of (180 - k) / (180 + k)."""
    rng, rows, gone = random.Random(5), [], set()
    for p in range(200):
        k = (9, 14, 20, 21, 25)[p % 5]  # 0.905, 0.856, 0.8, 0.791, 0.756
        text = words(184, rng)
        rows += [(2 * p, " ".join(text), "en", "s", 0), (2 * p + 1, " ".join(text[:-k] + words(k, rng)), "en", "s", 0)]
        gone |= {2 * p + 1} if k <= 20 else set()
    line = words(20, rng)
    rows += [(1000, " ".join(line * 30 + words(5, random.Random(6))), "en", "s", 0), (1001, " ".join(line * 2 + words(5, random.Random(6))), "en", "s", 0)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r[0] for r in rows} - {r.doc_id for r in kept.collect()} == gone | {1001}


def test_large_group_of_near_copies(spark):
    """A group over several blocks is linked as brute force over all pairs links it."""
    rng = random.Random(7)
    base, rows = words(120, rng), []
    for d in range(400):
        text = list(base)
        for k in rng.sample(range(120), d % 6):
            text[k] = words(1, rng)[0]
        rows.append((d, " ".join(text), "en", "s", 0))
    sets = [{tuple(t[k : k + 5]) for k in range(116)} for t in (r[1].split() for r in rows)]
    least = list(range(400))

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(400):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                least[max(x, y)] = min(x, y)
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r.doc_id for r in kept.collect()} == {top(d) for d in range(400)}


def test_links_that_no_turn_finds_are_not_lost(spark):
    """Pairs at and around the threshold, of which most are missed by the turns that are allowed to miss nine in ten; common lines in all."""
    rng, rows = random.Random(9), []
    common = " ".join(words(60, rng))
    for p in range(150):
        k = (9, 14, 20, 21, 25)[p % 5]
        text = words(184, rng)
        rows += [(2 * p, " ".join(text)), (2 * p + 1, " ".join(text[:-k] + words(k, rng)))]
    rows += [(1000 + d, common + " " + " ".join(words(rng.choice((5, 12, 20, 200)), rng))) for d in range(60)]
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    least = {d: d for d in sets}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                least[max(x, y)] = min(x, y)
    frame = spark.createDataFrame([*rows, (5000, ""), (5001, None), (None, rows[0][1])], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_copies(frame, missed=0.9).collect()]
    assert sorted(got, key=str) == sorted([*((d, top(d)) for d in sets), (5000, 5000), (5001, 5000), (None, 0)], key=str)
    assert len({top(d) for d in sets if d < 1000}) == 210 and len({top(d) for d in sets if d >= 1000}) < 60
