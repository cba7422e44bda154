import numpy as np

from tessera.llm import toxicity


def test_scores_keep_the_natural_share_of_a_dealt_sample():
    # 9 of 10 labelled rows are clean; the sample holds as many clean as toxic rows of the same word.
    s = toxicity.Settings(buckets=1 << 8, epochs=12)
    y = np.array([0, 1] * 300, np.float32)
    w = np.where(y == 1, 1.0, 9.0)
    score = toxicity.Scorer(toxicity.train(["word"] * len(y), y, s, w))("word")
    assert 0.05 < score < 0.2
    assert toxicity.Scorer(toxicity.train(["word"] * len(y), y, s))("word") > 0.4


def test_cut_offs_come_from_all_labelled_rows(spark, monkeypatch):
    # 40 rows are sampled of 2,000 labelled ones; the scores of the two languages need different cut-offs beyond 0.35 to 0.65.
    n = 2000
    docs = spark.createDataFrame([(i, f"{'toxic' if i % 4 == 0 else 'clean'} {i}", "de" if i % 10 == 1 or i % 20 == 0 else "en") for i in range(n)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, settings=toxicity.Settings(buckets=1 << 8, epochs=1, most_rows=40))
    assert 0 < len(net.seen) <= 40
    scored = docs.selectExpr("doc_id", "lang", "case when lang = 'de' then if(doc_id % 4 = 0, 0.98, 0.9) else if(doc_id % 4 = 0, 0.2, 0.1) end as _score")
    cuts = toxicity.calibrated(scored, labels, net, "toxic", "doc_id", "lang")
    assert 0.9 < cuts["de"] < 0.98 and 0.1 < cuts["en"] < 0.2


def test_counts_give_the_cut_off_of_best_f1():
    r = np.random.default_rng(2)
    steps, y, rows = np.arange(-40.0, 40.0), np.zeros(80), r.integers(1, 9, 80).astype(float)
    steps, y, rows = np.tile(steps, 2), np.append(y, y + 1), np.append(rows, rows[::-1] + np.arange(80))
    w = np.where(y == 1, 2.0, 3.0)
    cut = toxicity.calibrate(steps, y, np.full(160, None), rows, w)[None]
    z = np.log(cut / (1 - cut)) / toxicity.STEP

    def f1(c):
        up = steps >= c - 0.5
        return 2 * (rows * w * y)[up].sum() / ((rows * w)[up].sum() + (rows * w * y).sum())

    assert abs(f1(np.round(z)) - max(f1(c) for c in range(-40, 40))) < 1e-12
