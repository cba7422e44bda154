import random
import zlib

import numpy as np

from tessera.llm import quality, toxicity

WORDS = ["the", "of", "river", "stone", "walk", "green", "house", "quiet", "morning", "light", "road", "field"]


def tables(spark, n=400):
    r = random.Random(0)
    docs, labels = [], []
    for i in range(n):
        w = r.choices(WORDS, k=r.randint(20, 60))
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "blarghen", "blargheit", "scum"]))
        if not good:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), r.choice(["en", "de", None]), "s", i))
        labels.append((i, int(good), int(toxic)))
    docs += [(n, None, "en", None, 0), (n + 1, "", None, "s", 0), (n + 2, "word " * 20000, "xx", "s", 0), (None, "the river", "en", "s", 0), (0, docs[0][1], "en", "s", 0)]
    labels += [(n + 50, 1, 1), (1, None, None), (None, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def truth(labels, name):
    return {r.doc_id: r[name] for r in labels.collect() if r.doc_id is not None and r[name] is not None}


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_toxicity(spark):
    docs, labels = tables(spark)
    s = toxicity.Settings(buckets=1 << 12, epochs=8)
    rows = toxicity.classify(docs, labels, settings=s).collect()
    assert len(rows) == docs.count()
    want = truth(labels, "toxic")
    apart = [r for r in rows if r.held_out and r.doc_id in want]
    assert apart and np.mean([r.predicted == want[r.doc_id] for r in apart]) > 0.95
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5)
    # The language is no input: equal texts have equal scores.
    same = [r.score for r in rows if r.doc_id == 0]
    assert len(same) == 2 and same[0] == same[1]
    kept = toxicity.accepted(docs, labels, settings=s)
    assert kept.columns == docs.columns and 250 < kept.count() < 330


def test_training_ignores_held_out_labels(spark):
    docs, labels = tables(spark, 120)
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    s = toxicity.Settings(buckets=1 << 10, epochs=2)
    a, b = ({(r.doc_id, r.score) for r in toxicity.classify(docs, x, settings=s).collect()} for x in (labels, flipped))
    assert a == b


def test_quality(spark):
    docs, labels = tables(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    want = truth(labels, "quality")
    apart = [r for r in rows if r.held_out and r.doc_id in want]
    assert apart and np.mean([r.predicted == want[r.doc_id] for r in apart]) > 0.95
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3)


def test_scoring_is_a_sum_of_table_lookups():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.train(x, y, np.ones(600), quality.Settings(pairs=3))
    assert (0, 1) in [(min(i, j), max(i, j)) for i, j, _ in m.pairs]
    assert np.mean((m.score(x) > 0.5) == y) > 0.9
    z = m.bias + sum(t[np.searchsorted(e, x[7, f], side="right")] for f, (e, t) in enumerate(zip(m.edges, m.tables)))
    z += sum(t[np.searchsorted(m.pair_edges[i], x[7, i], side="right"), np.searchsorted(m.pair_edges[j], x[7, j], side="right")] for i, j, t in m.pairs)
    assert abs(1 / (1 + np.exp(-z)) - m.score(x[7:8])[0]) < 1e-12


def test_word_tables_equal_a_plain_convolution():
    s = toxicity.Settings(buckets=256, dim=4, filters=3, widths=(1, 2, 3))
    rng = np.random.default_rng(1)
    net = toxicity.Network(s, rng.normal(size=(256, 4)).astype(np.float32))
    net.convs = [rng.normal(size=(w * 4, 3)).astype(np.float32) for w in s.widths]
    net.biases = [rng.normal(size=3).astype(np.float32) for _ in s.widths]
    net.out, net.bias = rng.normal(size=9).astype(np.float32), 0.1
    text = " ".join(rng.choice(WORDS, 50))
    e = net.embed[toxicity.Hasher(256)(text)].sum(axis=0)
    best = []
    for q, w in enumerate(s.widths):
        z = np.array([e[i : i + w].ravel() @ net.convs[q] for i in range(len(e) - w + 1)]) + net.biases[q]
        best.append(np.maximum(z.max(axis=0), 0))
    want = 1 / (1 + np.exp(-(np.concatenate(best) @ net.out + net.bias)))
    assert abs(toxicity.Scorer(net)(text) - want) < 1e-5


def test_no_labels_and_empty_tables(spark):
    docs, labels = tables(spark, 20)
    for f in (quality.classify, toxicity.classify):
        assert len({r.score for r in f(docs, labels.limit(0)).collect()}) >= 1
        assert f(docs.limit(0), labels.limit(0)).count() == 0


def test_minibatch_gradients_equal_one_text_at_a_time():
    s = toxicity.Settings(buckets=128, dim=4, filters=3, widths=(1, 2, 3), window=7)
    rng = np.random.default_rng(2)
    net = toxicity.Network(s, rng.normal(size=(128, 4)).astype(np.float32))
    net.convs = [rng.normal(size=(w * 4, 3)).astype(np.float32) for w in s.widths]
    net.biases = [rng.normal(size=3).astype(np.float32) for _ in s.widths]
    net.out, net.bias = rng.normal(size=9).astype(np.float32), 0.1
    docs = [toxicity.Hasher(128)(" ".join(rng.choice(WORDS, n))) for n in (0, 1, 2, 3, 30, 8, 14, 7)]
    y, w = rng.integers(0, 2, len(docs)).astype(np.float32), rng.uniform(0.5, 2, len(docs))
    best, _ = toxicity._maxima(net, docs)
    for d, got in zip(docs, best):
        e = net.embed[d].sum(axis=0)
        z = [np.array([e[i : i + v].ravel() @ net.convs[q] for i in range(len(e) - v + 1)]).reshape(-1, 3) + net.biases[q] for q, v in enumerate(s.widths)]
        assert np.allclose(got, np.concatenate([np.maximum(x.max(axis=0, initial=0), 0) for x in z]), atol=1e-5)

    def loss():
        f = toxicity._maxima(net, docs)[0].astype(float)
        p = 1 / (1 + np.exp(-(f @ net.out + net.bias)))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    grads, gb, rows, back = toxicity._gradients(net, docs, y, w)
    table = np.zeros_like(net.embed)
    np.add.at(table, rows, back)
    for p, g in [*zip((*net.convs, *net.biases, net.out), grads), (net.embed, table)]:
        for at in zip(*[rng.integers(0, n, 12) for n in p.shape]):
            old = p[at]
            p[at] = old + 1e-3
            up = loss()
            p[at] = old - 1e-3
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_sample_is_bounded_whatever_repeats(spark):
    from tessera.llm.labelled import training_rows

    docs = spark.createDataFrame([(i % 5, "t" * 100, "u") for i in range(200)], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i % 5, i % 2) for i in range(50)], "doc_id long, toxic int")
    rows = training_rows(docs, labels, "toxic", 100).collect()
    assert sorted(r.k for r in rows) == [i for i in range(5) if not held(i)] and all(r.y == 1 for r in rows)
    assert len(training_rows(docs, labels, "toxic", 100, most_bytes=250).collect()) == 2
