"""The base of identities against union-find over the same decisions, its use on open cases, and a judge's verdicts."""

import random
from collections import defaultdict

from tessera.operators import identities

D = "tipo string, a string, b string, decision string, fuente string"
C = "grupo long, nombre string"


def folded(s):
    return " ".join("".join(c if c.isalnum() else " " for c in s.lower().translate(str.maketrans("áéíóú", "aeiou"))).split())


def plain(decisions, curated):
    best = {}
    for tipo, a, b, d, f in decisions:
        if d in ("misma", "distinta") and f != "identidades" and tipo in identities.ACTORS and a and b and min(len(folded(a).split()), len(folded(b).split())) >= 2:
            key, rank = (tipo, *sorted((folded(a), folded(b)))), (-identities.WEIGHTS.get(f, 1), d, a, b, f)
            best[key] = min(best.get(key, (rank, a, b)), (rank, a, b))
    up, forms, links = {}, defaultdict(set), []

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for (tipo, u, v), (rank, a, b) in best.items():
        forms[tipo, folded(a)].add(a)
        forms[tipo, folded(b)].add(b)
        if rank[1] == "misma" and u != v:
            links.append(((tipo, u), (tipo, v), rank[4]))
    groups = defaultdict(set)
    for g, name in curated:
        if name and folded(name):
            groups[g].add(("persona", folded(name)))
            forms["persona", folded(name)].add(name)
    for g in groups.values():
        links += [(min(g), n, "quien-ai") for n in g if n != min(g)]
    for u, v, _ in links:
        up[root(u)] = root(v)
    longest = {n: min(fs, key=lambda x: (-len(x), x)) for n, fs in forms.items()}
    members, sources = defaultdict(list), defaultdict(set)
    for n in forms:
        members[root(n)].append(n)
    for u, _, f in links:
        sources[root(u)].add(f)
    out = []
    for r, ns in members.items():
        fs = sorted((longest[n] for n in ns), key=lambda x: (-len(x), x))
        if len(fs) > 1:
            out.append((r[0], "misma", fs[0], tuple(fs[1:]), tuple(sorted(sources[r]))))
    for (tipo, u, v), (rank, _, _) in best.items():
        if rank[1] == "distinta":
            x, y = (tipo, u), (tipo, v)
            out.append((tipo, "conflicto" if root(x) == root(y) else "distinta", None, (longest[x], longest[y]), (rank[4],)))
    return sorted(out, key=str)


def test_base_equals_union_find(spark):
    r = random.Random(7)
    name = lambda: r.choice(("", "La ")) + r.choice(("Casa", "CASA", "Cása")) + r.choice((" ", "  ", "-")) + str(r.randint(0, 30))
    rows = [(r.choice((*identities.ACTORS, "cargo")), name(), name(), r.choice(("misma", "misma", "distinta", "posponer")), r.choice(("persona", "regla", "juez", "quien-ai", "identidades", None))) for _ in range(260)]
    rows += [("persona", None, "Ana Ruiz", "misma", "regla"), ("persona", "Ruiz", "Ana Ruiz", "misma", "persona"), ("lugar", "Ana Ruiz", "ANA RUIZ", "distinta", "regla")]
    rows = [(t, a, b, d, f or "juez") for t, a, b, d, f in rows] + rows[:20]
    rows = [x for x in rows if x[4]]
    curated = [(r.randint(0, 6), name()) for _ in range(16)] + [(9, None), (9, "Sola")]
    got = identities.base(spark.createDataFrame(rows, D), spark.createDataFrame(curated, C)).collect()
    got = sorted(((x.tipo, x.clase, x.canonico, tuple(x.formas), tuple(x.fuentes)) for x in got), key=str)
    assert got == plain(rows, curated) and {x[1] for x in got} == {"misma", "distinta", "conflicto"}
    none = identities.base(spark.createDataFrame([], D), spark.createDataFrame([], C))
    assert none.count() == 0


def test_use_of_the_base(spark):
    entries = spark.createDataFrame(
        [("persona", "misma", "Ana María Ruiz", ["Ana Ruiz", "A. Ruiz"], ["regla"]), ("persona", "distinta", None, ["Ana Ruiz", "Ana Mora"], ["persona"]), ("persona", "distinta", None, ["A. Ruiz", "Ana Ruiz"], ["juez"]), ("persona", "conflicto", None, ["Luz Mar", "Luz Sol"], ["juez"])],
        "tipo string, clase string, canonico string, formas array<string>, fuentes array<string>",
    )
    cases = [("1", "persona", "ana ruiz", "ANA MARIA RUIZ"), ("2", "persona", "Ana Mora", "ana ruiz"), ("3", "persona", "Ana Ruiz", "A Ruiz"), ("4", "lugar", "Ana Ruiz", "Ana Mora"), ("5", "persona", "Luz Mar", "Luz Sol"), ("6", "persona", "Ana Ruiz", "Ana María Ruiz"), ("7", "persona", "Ana Ruiz", "ana ruiz")]
    df = spark.createDataFrame(cases, "clave string, tipo string, a string, b string")
    got = identities.applied(df, entries, spark.createDataFrame([("6",), (None,)], "clave string")).collect()
    # 3 is joined by one entry and parted by another; 6 is decided.
    assert {(x.clave, x.decision, x.confianza, x.fuente) for x in got} == {("1", "misma", 0.9, "identidades"), ("2", "distinta", 0.9, "identidades")}


def test_rules_before_the_judge(spark):
    cases = spark.createDataFrame([("1", "persona", 0.99, ""), ("2", "cargo", 0.6, "el mismo cargo, con ex"), ("3", "persona", 0.6, "el mismo cargo"), ("4", "lugar", 0.5, "x"), ("5", "lugar", 0.5, "x"), ("6", "lugar", 0.5, None)], "clave string, tipo string, confianza double, motivo string")
    said = [("1", "distinta", 1.0, "no"), ("3", "Misma", 0.75, "sí"), ("4", "ambiguo", 0.9, "r" * 400), ("5", "misma", 0.7, None), ("5", "distinta", 0.7, "y"), ("8", "misma", 1.0, "")]
    got = {x.clave: (x.decision, x.confianza, x.fuente, x.razon) for x in identities.settled(cases, spark.createDataFrame(said, "clave string, veredicto string, confianza double, razon string")).collect()}
    assert got["1"][:3] == ("misma", 1.0, "regla") and got["2"][:3] == ("misma", 0.85, "regla") and got["3"] == ("misma", 0.75, "juez", "sí")
    assert got["4"] == ("posponer", 0.9, "juez", ("ambiguo: " + "r" * 400)[:300]) and got["5"] == ("posponer", 0.7, "juez", "duda: y") and len(got) == 5
