import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontaminate
from tessera.llm.base import materialize
from tests.llm.test_linededup import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = materialize(stage(spark, docs, DATA))
        out.append((name, docs, new))
        docs = new
    return out


def test_order_and_columns(stages, spark):
    assert [n for n, _, _ in stages] == ["toxicity", "line_dedup", "simhash_dedup", "decontaminate", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect())
    assert rows == sorted(tuple(r) for r in stages[-1][2].collect())


def test_line_stage_equals_brute_force(stages):
    _, before, after = stages[1]
    docs = sorted((r.doc_id, r.text) for r in before.collect())
    assert [t for _, t in sorted((r.doc_id, r.text) for r in after.collect())] == brute(docs)


def test_near_dedup_stage_keeps_one_of_each(stages):
    from tests.llm.test_minhash import ref
    from tests.llm.test_simhash import components

    _, before, after = stages[2]
    docs = sorted((r.doc_id, r.text) for r in before.collect())
    sets = [ref(t) for _, t in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert sorted(r.doc_id for r in after.collect()) == sorted(docs[i][0] for i in set(components(len(docs), near)))


def sellers(pattern, text):
    """Smallest edit distance of the pattern to a substring of text, a whole column at a time."""
    p = np.frombuffer(pattern.encode("utf-32-le"), np.uint32)
    steps = np.arange(len(p) + 1)
    column, best = steps.copy(), len(p)
    for c in np.frombuffer(text.encode("utf-32-le"), np.uint32):
        new = np.empty_like(column)
        new[0] = 0
        new[1:] = np.minimum(column[:-1] + (p != c), column[1:] + 1)
        # A deletion costs one for each row it goes down.
        column = np.minimum.accumulate(new - steps) + steps
        best = min(best, int(column[-1]))
    return best


def test_clean_documents_stay_and_leaks_go(stages, spark):
    """Every document that stays is over every item's budget and every one that goes is within one's, by another algorithm.

    Whole texts are searched for items one edit piece of which they hold; other items are out of reach by the pigeonhole.
    """
    _, before, after = stages[3]
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after.collect()}
    budget = [int(0.08 * len(p)) for p in items]
    cuts = [[p[len(p) * j // (k + 1) : len(p) * (j + 1) // (k + 1)] for j in range(k + 1)] for p, k in zip(items, budget)]
    for r in before.collect():
        t = decontaminate.normalise(r.text or "")
        near = [i for i in range(len(items)) if any(c in t for c in cuts[i])]
        leaks = any(items[i] in t for i in near) or any(sellers(items[i], t) <= budget[i] for i in near)
        assert (r.doc_id in kept) == (not leaks), r.doc_id


def test_toxicity_stage_follows_the_cut_offs(stages, spark):
    from tessera.llm import toxicity

    _, before, after = stages[0]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    want = sorted(r.doc_id for r in toxicity.classify(before, labels).where("not rejected").collect())
    assert sorted(r.doc_id for r in after.collect()) == want
    assert 0 < before.count() - after.count() < before.count() / 2


def test_packing_stage_covers_each_document_once(stages):
    _, before, after = stages[4]
    rows = after.collect()
    spans: dict = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(spans) == {r.doc_id for r in before.collect()}
    for parts in spans.values():
        at = 0
        for start, length, _ in sorted(parts):
            assert start == at
            at += length
        assert at == parts[0][2]
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
