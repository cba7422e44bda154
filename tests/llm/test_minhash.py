import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import minhash
from tessera.llm.base import DOC, keyed, materialize
from tests.llm.test_simhash import components


def ref(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def tables():
    r, words = random.Random(4), [f"w{i}" for i in range(300)]
    texts = [None, "", "one", "ONE", "one two"]
    for _ in range(12):
        base = r.choices(words, k=r.randint(80, 200))
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    # A chain: each text has most of the one before, the ends have little in common.
    long = r.choices(words, k=400)
    texts += [" ".join(long[i * 10 : i * 10 + 150]) for i in range(20)]
    return list(enumerate(texts))


def test_equals_all_pairs(spark, monkeypatch):
    docs = tables()
    sets = [ref(t) for _, t in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    want = sorted(set(components(len(docs), near)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert 20 < len(want) < len(docs) - 20
    assert sorted(x.doc_id for x in minhash.keep_one(df).collect()) == want
    # The same if rounds of single comparisons come before all pairs.
    monkeypatch.setattr(minhash, "FEW", 0)
    assert sorted(x.doc_id for x in minhash.keep_one(df).collect()) == want


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, "a b", 2), (1, "a b", 2), (None, "c", 3), (2, None, 4), (3, " ", 5)], "doc_id long, text string, n int")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(x.n for x in kept.collect()) == [2, 3, 4]
    assert minhash.keep_one(docs.limit(0)).count() == 0


def test_stage_finds_near_copies_over_two_bits_apart(spark):
    w = [f"w{i}" for i in range(200)]
    copy = [*w[:50], "x", *w[51:150], "y", *w[151:]]
    docs = spark.createDataFrame([(1, " ".join(w), "en", "s", 1), (2, " ".join(copy), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [x.doc_id for x in corpus_pipeline.simhash_dedup(spark, docs, "").collect()] == [1]


def test_simhash_balls_propose_pairs_that_no_band_shares(spark):
    w = [f"w{i}" for i in range(3000)]
    docs = [(1, " ".join(w)), (2, " ".join([*w[:1500], "x", *w[1501:]])), (3, " ".join(w[::-1]))]
    source = keyed(spark.createDataFrame(docs, "doc_id long, text string"), "text", "doc_id")
    prints = source.select(F.col("key").alias("id"), *DOC, minhash._signature("text", 5).alias("s")).select("id", *DOC, "s.*")
    alone = prints.withColumn("bands", F.array(F.xxhash64("id")))
    fps = {r.id: r.fp for r in prints.collect()}
    assert ((fps[1] ^ fps[2]) & (1 << 64) - 1).bit_count() <= 2 < ((fps[1] ^ fps[3]) & (1 << 64) - 1).bit_count()
    roots = minhash._components(source, materialize(alone), 0.8, 5)
    assert {r.id for r in alone.join(roots, "node").collect()} == {1, 2}
