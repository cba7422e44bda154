"""Model answers read by Spark against a plain reading of the same texts, one paragraph after another."""

import json
import random
import unicodedata
from collections import Counter

from tessera.functions.vocabulary import PREDICATES, TYPES, predicates
from tessera.operators import answers
from tessera.plans.outside import ORACLE_SQL

S = "wp_id long, pi int, parrafo string, salida string"
SHORT = {"p": "persona", "o": "organizacion", "c": "cargo", "l": "lugar", "n": "ley"}
RULES = {p: ({SHORT[x] for x in a}, {SHORT[x] for x in b}) for p, _, a, b, _ in PREDICATES}
RULES["padre de"] = ({"persona"}, {"persona"})


def bare(s):
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


def spot(p, w, cur):
    for f in (str, str.lower, bare):
        if (at := f(p)[cur:].find(f(w))) >= 0:
            return cur + at
    return None


def plain(p, text):
    """(entities, relations, refused) of one answer."""
    why = Counter()
    try:
        d = json.loads(text)
    except ValueError:
        a, z = text.find("{"), text.rfind("}")
        try:
            d = json.loads(text[a : z + 1]) if 0 <= a < z else None
        except ValueError:
            d = None
    if not isinstance(d, dict):
        return [], [], Counter(["json_invalido"])
    ents, cur, index = [], {}, {}
    for e in d.get("entidades") or []:
        if not isinstance(e, dict):
            continue
        w, tipo = str(e.get("texto") or "").strip(" "), bare(str(e.get("tipo")))
        if not w or tipo not in (*TYPES, "grupo generico"):
            why["tipo_desconocido"] += 1
            continue
        at = spot(p, w, cur.get(w.lower(), 0))
        if at is None:
            why["no_localizada"] += 1
            continue
        cur[w.lower()] = at + len(w)
        real = p[at : at + len(w)]
        if tipo == "persona" and real.lower() == "ella":
            why["pronombre"] += 1
        elif tipo == "monto" and not any(c.isdigit() for c in real):
            why["monto_sin_cifra"] += 1
        else:
            for n in (real, w):
                index.setdefault(n, len(ents))
            ents.append((len(ents), at, at + len(w), tipo, real))
    rels = []
    known = {bare(p): p for p in RULES}
    for k, r in enumerate(d.get("relaciones") or []):
        if not isinstance(r, dict):
            continue
        na, nb, pred = (str(r.get("a") or "").strip(" "), str(r.get("b") or "").strip(" "), known.get(bare(str(r.get("predicado")))))
        a, b = index.get(na), index.get(nb)
        if pred is None:
            why["rel_predicado_desconocido"] += 1
        elif not na or not nb or na == nb:
            why["rel_mal_formada"] += 1
        elif a is None or b is None:
            why["rel_extremo_no_marcado"] += 1
        elif "grupo generico" in (ents[a][3], ents[b][3]):
            why["rel_con_senuelo"] += 1
        elif any(s and ents[i][3] not in s for i, s in zip((a, b), RULES[pred])):
            why["rel_tipos_no_admitidos"] += 1
        elif not any(x[3] == pred and {x[1], x[2]} == {a, b} for x in rels):
            when = str(r.get("cuando")).lower()
            rels.append((k, a, b, pred, when if when in answers.WHEN else "vigente"))
    kin = Counter((a, b) for _, a, b, q, _ in rels if q in ("padre de", "hijo de"))
    bad = {x for x, n in kin.items() if n == 2}
    why.update({"rel_contradictoria": len(bad)} if bad else {})
    return ents, [r for r in rels if not (r[3] in ("padre de", "hijo de") and r[1:3] in bad)], why


def random_answer(r):
    words = ["Ana Ruiz", "ana ruiz", "Álvaro", "alvaro", "Acme", "ella", "Ella", "300 pesos", "suma", "", "nada", "los indígenas"]
    types = [*TYPES, "Organización", "grupo genérico", "raro"]
    ents = [{"texto": r.choice(words[:4] * 2 + words) + r.choice(("", " ")), "tipo": r.choice(types[:1] * 20 + types)} for _ in range(r.randint(0, 9))] + r.choice(([], [5, "x", None]))
    preds = ["dirige", "DIRIGE", "hijo de", "padre de", "hermano de", "cónyuge de", "conyuge de", "raro", "vínculo sin tipo"]
    who = words[:4] * 5 + words
    rels = [{"a": r.choice(who), "b": r.choice(who), "predicado": r.choice(preds), "cuando": r.choice(("Pasada", "futura", "ayer", None))} for _ in range(r.randint(0, 20))]
    text = json.dumps({"entidades": ents, "relaciones": rels}, ensure_ascii=False)
    return r.choice((text, text, text, "Claro:\n" + text + "\nFin", text[:-1], "[]", "no", json.dumps({"entidades": None})))


def test_answers_equal_a_plain_reading(spark):
    r = random.Random(4)
    p = "Ana Ruiz y ALVARO vieron a ana ruiz en Acme. Ella dio 300 pesos, una suma, a Álvaro y a los indígenas de Acme; ANA RUIZ no."
    rows = [(k, k % 3, p, random_answer(r)) for k in range(300)]
    kin = [{"a": "Acme", "b": "Álvaro", "predicado": q} for q in ("padre de", "hijo de", "hermano de")]
    rows.append((999, 0, p, json.dumps({"entidades": [{"texto": w, "tipo": "persona"} for w in ("Acme", "Álvaro")], "relaciones": kin})))
    vocabulary = predicates(spark).union(spark.createDataFrame([("padre de", "familiar", ["persona"], ["persona"], False, 99)], predicates(spark).schema))
    got = answers.read(spark.createDataFrame(rows, S), vocabulary)
    ents, rels, why = set(), set(), Counter()
    for wp, pi, text, said in rows:
        e, x, w = plain(text, said)
        ents |= {(wp, pi, *y) for y in e}
        rels |= {(wp, pi, *y) for y in x}
        why.update({(wp, pi, m): n for m, n in w.items()})
    assert {tuple(x) for x in got.entities.collect()} == ents and len(ents) > 300
    assert {tuple(x) for x in got.relations.collect()} == rels and len(rels) > 30
    assert {(x.wp_id, x.pi, x.motivo): x.n for x in got.refused.collect()} == dict(why)
    assert len({m for _, _, m in why}) == 11


def test_english_names_hints_and_empty_input(spark):
    said = '{"entities":[{"text":"Ana","type":"persona"}],"relations":[{"a":"Ana","b":"Ana","relation":"dirige"}],"pistas_rechazadas":[{"p":1},2]}'
    rows = [(1, 0, "Ana", said), (2, 0, None, said), (3, 0, "Ana", None), (4, 0, "Ana", "")]
    got = answers.read(spark.createDataFrame(rows, S), predicates(spark))
    assert [tuple(x) for x in got.entities.collect()] == [(1, 0, 0, 0, 3, "persona", "Ana")]
    assert sorted((x.wp_id, x.pista) for x in got.rejected_hints.collect()) == [(1, '{"p":1}'), (2, '{"p":1}')]
    assert {(x.wp_id, x.motivo) for x in got.refused.collect()} == {(1, "rel_mal_formada"), (2, "no_localizada"), (2, "rel_mal_formada"), (3, "json_invalido"), (4, "json_invalido")}
    none = answers.read(spark.createDataFrame([], S), predicates(spark))
    assert [df.count() for df in none] == [0, 0, 0, 0]


def test_twins_are_registered():
    assert {"answered_entities", "answered_relations", "answers_refused"} <= set(ORACLE_SQL)
