"""Two-level matching against plain loops over paragraphs."""

import random
from collections import Counter, defaultdict

import pytest

from tessera.operators import matching as M

SYM = ("socio de",)
PRED = ("socio de", "apoya a", "dirige")


def made(seed, paragraphs=60):
    r = random.Random(seed)
    ents, rels, gold, grels = [], [], [], []
    for w in range(paragraphs):
        theirs = [(r.randint(0, 12), r.choice(("persona", "lugar", M.DECOY))) for _ in range(r.randint(0, 6))]
        mine = [(a + r.randint(-1, 1), t) for a, t in theirs if r.random() < 0.9] + [(r.randint(0, 12), r.choice(("persona", "lugar"))) for _ in range(r.randint(0, 2))]
        for rows, spans, scored in ((gold, theirs, False), (ents, mine, True)):
            rows += [(w, w % 2, i, a, a + r.randint(0, 3), t, *([r.choice((0.1, 0.3, 0.5, 0.7, 0.9))] if scored else [])) for i, (a, t) in enumerate(spans)]
        for ties, n, scored in ((grels, len(theirs), False), (rels, len(mine), True)):
            for k in range(r.randint(0, 9) if n > 1 else 0):
                ties.append((w, w % 2, *r.sample(range(min(n, 4)), 2), r.choice(PRED), *([r.choice((0.1, 0.2, 0.6, 0.9)), k] if scored else [])))
    return ents, rels, gold, grels


def frames(spark, ents, rels, gold, grels):
    e = "wp_id long, pi int, i int, ini int, fin int, tipo string"
    r = "wp_id long, pi int, a int, b int, predicado string"
    return spark.createDataFrame(ents, f"{e}, score double"), spark.createDataFrame(rels, f"{r}, score double, orden int"), spark.createDataFrame(gold, e), spark.createDataFrame(grels, r)


def grouped(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[:2]].append(r[2:])
    return out


def match(ents, gold, key=lambda e: e[0]):
    used, hits = set(), {}
    for i, a, b, t, *_ in sorted((e for e in ents if e[3] != M.DECOY), key=key):
        g = next((g for g, c, d, u in sorted(gold) if u == t != M.DECOY and g not in used and c <= b and a <= d), None)
        if g is not None:
            used.add(g)
            hits[i] = g
    return hits


def norm(a, b, p):
    return (min(a, b), max(a, b), p) if p in SYM else (a, b, p)


def gold_set(gold, ties):
    real = {g for g, *_, t in gold if t != M.DECOY}
    return {norm(a, b, p) for a, b, p, *_ in ties if a in real and b in real}


@pytest.mark.parametrize("seed", [1, 2])
def test_reports(spark, seed):
    data = made(seed)
    E, R, G, Q = map(grouped, data)
    dfs = frames(spark, *data)
    vp, fp, fn = Counter(), Counter(), Counter()
    rvp, rfp, rfn, ok, bad = Counter(), Counter(), Counter(), Counter(), Counter()
    for w in set(E) | set(G):
        hits = match(E[w], G[w])
        for i, *_, t, _ in E[w]:
            if t != M.DECOY:
                (vp if i in hits else fp)[t] += 1
        for g, *_, t in G[w]:
            if t != M.DECOY and g not in hits.values():
                fn[t] += 1
        keys, seen = gold_set(G[w], Q[w]), set()
        for a, b, p, *_ in R[w]:
            k = norm(hits[a], hits[b], p) if a in hits and b in hits else None
            if k in keys:
                rvp[p] += 1
                seen.add(k)
                ok[p] += p not in SYM
            else:
                rfp[p] += 1
                bad[p] += k is not None and p not in SYM and (k[1], k[0], p) in keys
        for k in keys - seen:
            rfn[k[2]] += 1
    got = {r.tipo: (r.vp, r.fp, r.fn) for r in M.entity_report(dfs[0], dfs[2]).collect()}
    want = {t: (vp[t], fp[t], fn[t]) for t in {*vp, *fp, *fn}} | {"*": (vp.total(), fp.total(), fn.total())}
    assert got == want
    rows = {r.predicado: r for r in M.relation_report(*dfs, SYM).collect()}
    assert {p: (r.vp, r.fp, r.fn, r.directas, r.invertidas) for p, r in rows.items()} == {p: (rvp[p], rfp[p], rfn[p], ok[p], bad[p]) for p in PRED} | {
        "*": (rvp.total(), rfp.total(), rfn.total(), ok.total(), bad.total())
    }
    top = rows["*"]
    assert top.f1 == round(2 * top.vp / (2 * top.vp + top.fp + top.fn), 6) and top.direccion == round(ok.total() / (ok.total() + bad.total()), 6)
    assert rows["socio de"].direccion is None


def test_ceiling(spark):
    data = made(3)
    E, R, G, Q = map(grouped, data)
    e, r, g, q = frames(spark, *data)
    common = {w for w in E if w in G and E[w] and G[w]}
    rvp, rfp, rfn = Counter(), Counter(), Counter()
    for w in common:
        hits = match(E[w], G[w])
        keys, seen = gold_set(G[w], Q[w]), set()
        for a, b, p in gold_set([x[:4] for x in E[w]], R[w]):
            k = norm(hits[a], hits[b], p) if a in hits and b in hits else None
            if k in keys and k not in seen:
                rvp[p] += 1
                seen.add(k)
            else:
                rfp[p] += 1
        for k in keys - seen:
            rfn[k[2]] += 1
    got = {x.clase: (x.vp, x.fp, x.fn) for x in M.ceiling(e, r, g, q, SYM, least=0).where("nivel = 'predicado'").collect()}
    assert got == {p: (rvp[p], rfp[p], rfn[p]) for p in PRED} | {"*": (rvp.total(), rfp.total(), rfn.total())}
    few = M.ceiling(e, r, g, q, SYM, least=10**6)
    assert [x.clase for x in few.where("nivel = 'predicado'").collect()] == ["*"] and few.where("nivel = 'tipo'").count() == 3


def test_one_pass_gives_every_cut(spark):
    data = made(4)
    E, R, G, Q = map(grouped, data)
    e, r, g, q = frames(spark, *data)
    oro = M.gold_counts(g)
    points = {(x.clase, x.corte): (x.vp, x.fp, x.fn) for x in M.curve(M.scored_entities(e, g), oro).collect()}
    assert {c for _, c in points} == {0.3, 0.5, 0.7, 0.9}
    for cut in (0.3, 0.5, 0.7, 0.9):
        vp, n, m = Counter(), Counter(), Counter()
        for w in set(E) | set(G):
            over = [x for x in E[w] if x[4] >= cut]
            hits = match(over, G[w], key=lambda x: (-x[4], x[0]))
            for i, *_, t, _ in over:
                vp[t] += i in hits
                n[t] += 1
            for *_, t in G[w]:
                m[t] += 1
        for t in ("persona", "lugar"):
            assert points[t, cut] == (vp[t], n[t] - vp[t], m[t] - vp[t])
    scored = M.scored_relations(e, r, g, q, symmetric=SYM)
    rpoints = {(x.clase, x.corte): (x.vp, x.fp, x.fn) for x in M.curve(scored, M.gold_relation_counts(g, q, SYM)).collect()}
    for cut in (0.2, 0.6, 0.9):
        vp, n, m = Counter(), Counter(), Counter()
        for w in set(E) | set(G):
            sure = [x for x in E[w] if x[4] >= 0.5]
            hits, real = match(sure, G[w]), {x[0] for x in sure}
            keys = gold_set(G[w], Q[w])
            seen = set()
            for a, b, p, s, _ in R[w]:
                if s >= cut and a in real and b in real:
                    n[p] += 1
                    k = norm(hits[a], hits[b], p) if a in hits and b in hits else None
                    vp[p] += k in keys and k not in seen
                    seen.add(k)
            for k in keys:
                m[k[2]] += 1
        for p in PRED:
            if (p, cut) in rpoints:
                assert rpoints[p, cut] == (vp[p], n[p] - vp[p], m[p] - vp[p])
    reading = M.scored_entities(e, g, best_first=False)
    floor = sum(len(match([x for x in E[w] if x[4] >= 0.3], G[w])) for w in E)
    assert reading.where("acierto").count() == floor


def test_choice_of_cuts(spark):
    rows = [("a", 0.9, True)] * 4 + [("a", 0.6, False)] * 6 + [("b", 0.6, True)] * 3 + [("c", 0.9, False)] * 20 + [("c", 0.9, True)] + [("d", 0.9, True)]
    scored = spark.createDataFrame(rows, "clase string, score double, acierto boolean")
    gold = spark.createDataFrame([("a", 4), ("b", 3), ("c", 4), ("d", 1), ("e", 3)], "clase string, oro long")
    cuts = M.chosen_cuts(scored, gold)
    got = {r.clase: (r.corte, r.f1, r.podado) for r in cuts.collect()}
    assert got == {"a": (0.65, 1.0, 0.65), "b": (0.5, 1.0, 0.5), "c": (0.5, 0.08, 1.01), "e": (0.5, 0.0, 1.01)}
    policies = {"global 0.5": (None, 0.5), "por clase": ("corte", 0.5), "podados": ("podado", 0.95)}
    by = {r.politica: (r.vp, r.fp, r.fn) for r in M.measured(scored, gold, cuts, policies).collect()}
    assert by == {"global 0.5": (9, 26, 6), "por clase": (9, 20, 6), "podados": (7, 0, 8)}
    assert M.measured(scored.limit(0), gold, cuts, policies).count() == 0


def test_empty_sides(spark):
    e, r, g, q = frames(spark, *made(5, 4))
    none = lambda df: df.limit(0)
    assert M.entity_report(none(e), none(g)).count() == 0 and M.relation_report(none(e), none(r), none(g), none(q), SYM).count() == 0
    assert all(x.vp == 0 for x in M.entity_report(e, none(g)).collect()) and all(x.vp == 0 and x.fp == 0 for x in M.entity_report(none(e), g).collect())
