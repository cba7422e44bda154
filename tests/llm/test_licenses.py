import random
import re

from tessera.llm.licenses import NOTICES, PHRASES, Index, scan, summary, templates

PIECES = ["mit", "license", "gnu", "general", "public", "apache", "cc", "by", "nc", "4", "0", "licensed", "under", "the", "version", "2", "x", "é", "and"]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    base, labels, score = [], set(), 0.0
    for phrase, label in PHRASES.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    for t in templates():
        if not t.base:
            kinds = {w.decode() for w in t.words}
            share = max((len(kinds & set(words[i : i + t.span])) for i in range(len(words))), default=0)
            if share >= t.needed:
                labels.add(t.label)
                score = max(score, share / len(kinds))
    starts = [i for i, _ in base]
    names = {n for _, n in base}
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | labels)), 1.0 if base else score)


def test_equals_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choices(PIECES, k=r.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "MIT-License", "the\nmit\nlicense", "Apache License Apache License", "_mit_license_", "ÀMIT LICENSE", "word " * 20000 + "cc by"]
    texts += [n.upper() + "." for n in NOTICES] + [" ".join(r.sample(n.split(), len(n.split()))) for n in NOTICES]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, blocks string, start int")
    rows = {x.doc_id: tuple(x)[1:] for x in summary(scan(docs)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i] == brute(t), (i, t, rows[i], brute(t))
    assert scan(docs.limit(0)).count() == 0


def windows(t, words):
    """All blocks of a notice from left to right, by trying every window."""
    kinds = {w.decode() for w in t.words}
    got = [len(kinds & set(words[i : i + t.span])) if words[i] in kinds else 0 for i in range(len(words))]
    out, i = [], 0
    while i < len(words):
        if got[i] < t.needed:
            i += 1
            continue
        best = max(range(i, min(i + t.span, len(words))), key=lambda j: (got[j], -j))
        seen, end = set(), best
        while len(seen) < got[best]:
            seen |= kinds & {words[end]}
            end += 1
        out.append((best, got[best]))
        i = end
    return out


def test_every_block_equals_all_windows():
    r = random.Random(9)
    found = templates()
    index = Index(found, {w: i for i, w in enumerate(sorted({w for t in found for w in t.words}))})
    notices = list(NOTICES)
    total = 0
    for _ in range(300):
        words = []
        for _ in range(r.randint(1, 6)):
            n = r.choice(notices).split()
            n = [w for w in n if r.random() > 0.1]
            words += [*n, *r.choices(PIECES, k=r.randint(0, 8))]
        blocks = index.blocks(" ".join(words))[1]
        for i, t in enumerate(found):
            if not t.base:
                want = [(i, s, c / len(set(t.words))) for s, c in windows(t, words)]
                assert [b for b in blocks if b[0] == i] == want
                total += len(want)
    assert total > 500


def test_a_notice_twice_is_two_blocks(spark):
    n = "released under the mit license"
    docs = spark.createDataFrame([(1, f"{n} {n}\nand more {n}")], "doc_id long, text string")
    (row,) = scan(docs).collect()
    assert [b.start for b in row.blocks if b.label == "mit-release"] == [0, 5, 12]
