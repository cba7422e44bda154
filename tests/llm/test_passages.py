import random
import re

from tessera.llm import passages as P
from tessera.llm import substrings as S


def brute(texts, words):
    found = [{tuple(w[i : i + words]) for i in range(len(w) - words + 1)} for w in ([x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x] for t in texts)]
    return [int(any(a & b for j, b in enumerate(found) if j != i)) for i, a in enumerate(found)]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 5)))
    new = lambda n: [word() for _ in range(n)]
    common, texts = new(90), []
    for i in range(40):
        a, n = r.randint(0, 20), r.choice([0, 49, 50, 51, 52, 60])
        text = new(r.randint(0, 150))
        cut = r.randint(0, len(text))
        texts.append(r.choice([" ", "\n", " \t"]).join(text[:cut] + common[a : a + n] + text[cut:]))
    once, short = new(60), new(50)
    texts += [" ".join(once + new(9) + once), texts[0], texts[0], " ".join(short), "\n".join([*short, "x"]), " ".join(common[30:81]), "w " * 50, "w\n" * 52, None, "", " \n"]
    return texts + [" ".join(new(400) + common[10:61] + new(400)), " ".join(new(3000))]


def flags(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [x.shares_passage for x in S.remove_duplicates(docs).orderBy("doc_id").collect()]


def test_passages_under_400_bytes_are_told_and_stay(spark):
    r = random.Random(3)
    new = lambda n: ["".join(r.choices("abcde", k=4)) for _ in range(n)]
    planted, less = new(51), new(50)
    texts = [" ".join(new(80) + planted + new(80)), "\n".join(new(7) + planted), " ".join(new(9) + less), " ".join(less + new(9)), " ".join(new(200))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = S.remove_duplicates(docs).orderBy("doc_id").collect()
    assert [x.shares_passage for x in rows] == [1, 1, 0, 0, 0]
    assert [x.n_removed for x in rows] == [0] * 5


def test_equals_brute_force(spark):
    texts = corpus(1)
    want = brute(texts, 51)
    assert 0 < sum(want) < len(want)
    assert flags(spark, texts) == want


def test_texts_cut_into_pieces(spark):
    raws = [(t or "").encode() for t in corpus(2)]
    count = [max(0, len(x.split()) - 50) for x in raws]
    whole, size = P.word_runs(raws, 51), P.PIECE
    try:
        P.PIECE = 700
        cut = P.word_runs(raws, 51)
    finally:
        P.PIECE = size
    for runs in (whole, cut):
        windows = [0] * len(raws)
        for i, p, n in zip(runs["i"], runs["p"], runs["len"]):
            windows[i] += len(raws[i][p : p + n].split()) - 50
        assert windows == count
    assert len(cut) > len(whole)
