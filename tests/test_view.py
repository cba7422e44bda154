from tessera.operators import view


def test_groups_and_ends(spark):
    rows = [
        (1, 0, 0, 8, "Ana Rúa", "persona", 0.9, None),
        (1, 0, 10, 13, "Rúa", "persona", 0.8, "Ana Rúa"),
        (1, 0, 20, 23, "Rúa", "persona", 0.9, "Ana Rúa"),
        (1, 1, 0, 3, "Rúa", "persona", 0.95, None),
        (1, 1, 5, 9, "Cali", "lugar", 0.4, None),
        (1, 1, 12, 16, "Cali", "lugar", 0.9, None),
        (1, 1, 20, 26, "Senado", "organizacion", 0.9, None),
        (1, 1, 30, 34, "Juez", "cargo", 0.9, None),
        (2, 0, 0, 4, "Cali", "lugar", 0.9, None),
    ]
    p = spark.createDataFrame(rows, "wp_id long, pi int, ini int, fin int, texto string, tipo string, score double, canon string")
    cuts = spark.createDataFrame([("lugar", 0.5)], "tipo string, corte double")
    blocked = spark.createDataFrame([("cargo", "JUEZ")], "tipo string, texto string")
    m = view.proposed_mentions(p, cuts, blocked)
    got = {(r.wp_id, r.mid): r.grupo for r in m.collect()}
    assert got == {
        (1, "m0-0-8"): "c:persona:ana rua",
        (1, "m0-10-13"): "c:persona:ana rua",
        (1, "m0-20-23"): "c:persona:ana rua",
        (1, "m1-0-3"): None,
        (1, "m1-12-16"): "c:lugar:cali",
        (1, "m1-20-26"): None,
        (2, "m0-0-4"): None,
    }
    said = [(1, 0, 1, "Rúa", "Ana Rúa", "apoya a"), (1, 0, 2, "Rúa", "Ana Rúa", "dirige"), (1, 0, 3, "Ana Rúa", "Rúa", "dirige"), (1, 0, 4, "Rúa", "Rúa", "dirige")]
    said += [(1, 1, 5, "Rúa", "Cali", "dirige"), (1, 1, 6, "Rúa", "Juez", "dirige"), (1, 0, 7, "Rúa", "Cali", "dirige"), (1, 1, 8, None, "Cali", "dirige")]
    r = view.proposed_relations(m, spark.createDataFrame(said, "wp_id long, pi int, orden int, a string, b string, predicado string"))
    assert sorted((x.rid, x.predicado) for x in r.collect()) == [("r0-m0-0-8-m0-10-13", "dirige"), ("r0-m0-10-13-m0-0-8", "apoya a"), ("r1-m1-0-3-m1-12-16", "dirige")]
    assert view.proposed_mentions(p.limit(0), cuts, blocked).count() == 0 and view.proposed_relations(m.limit(0), spark.createDataFrame(said, r"wp_id long, pi int, orden int, a string, b string, predicado string")).count() == 0
