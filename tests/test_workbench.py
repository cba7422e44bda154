import pytest

from tessera.operators import calibrate, evaluate, scope, sinks


def test_one_site_at_a_time(spark):
    schema = "resolved_origin string, label string"
    one = spark.createDataFrame([("https://a.org", "A")], schema)
    again = sinks.connect(one, spark.createDataFrame([("https://a.org", "B")], schema))
    assert [tuple(r) for r in again.collect()] == [("https://a.org", "B")]
    assert sinks.connect(one.limit(0), one).count() == 1
    with pytest.raises(Exception, match="another site is connected: a.org"):
        sinks.connect(one, spark.createDataFrame([("https://b.org", "B")], schema)).collect()


def test_labels(spark):
    terms = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, "c", 0), (4, "d", 0)], "term_id long, name string, parent long")
    pick = lambda *k: scope.selection_label(spark.createDataFrame([(x,) for x in k], "term_id long"), terms).first().etiqueta
    assert (pick(), pick(2), pick(1, 2), pick(1, 2, 3), pick(2, 3, 4, 9)) == ("Selección", "b", "a", "a y c", "b y 2 más")


def test_a_saved_calibration_comes_back(spark):
    lots = spark.createDataFrame([(1, '{"umbrales":{"x":0.9}}'), (2, None), (3, "no json")], "lote_id long, calibracion string")
    cuts = spark.createDataFrame([(2, "persona", 0.7), (2, "lugar", 0.3)], "lote_id long, tipo string, corte double")
    blocked = spark.createDataFrame([(2, "cargo", "juez"), (2, "cargo", "juez")], "lote_id long, tipo string, texto string")
    c, b = calibrate.restored(calibrate.saved(lots, cuts, blocked))
    assert {tuple(r) for r in c.collect()} == {(1, "x", 0.9), (2, "persona", 0.7), (2, "lugar", 0.3)} and [tuple(r) for r in b.collect()] == [(2, "cargo", "juez")]
    assert calibrate.asking_floor(cuts).first().piso == 0.3 and calibrate.asking_floor(cuts.limit(0)).first().piso == 0.3


def test_consensus_of_relations(spark):
    e, r = "wp_id long, pi int, i int, ini int, fin int, tipo string", "wp_id long, pi int, a int, b int, predicado string, cuando string"
    a = spark.createDataFrame([(1, 0, 0, 0, 3, "persona"), (1, 0, 1, 5, 9, "persona"), (1, 0, 2, 12, 14, "lugar")], e)
    b = spark.createDataFrame([(1, 0, 0, 12, 14, "cargo"), (1, 0, 1, 5, 9, "persona"), (1, 0, 2, 0, 3, "persona"), (2, 0, 0, 0, 3, "persona")], e)
    ra = spark.createDataFrame([(1, 0, 0, 1, "socio de", "pasada"), (1, 0, 0, 1, "dirige", "pasada"), (1, 0, 0, 2, "dirige", "pasada")], r)
    rb = spark.createDataFrame([(1, 0, 1, 2, "socio de", "vigente"), (1, 0, 1, 2, "dirige", "vigente"), (1, 0, 2, 0, "dirige", "vigente"), (1, 0, 2, 1, "dirige", "futura")], r)
    ents, rels = evaluate.consensus_relations(a, ra, b, rb, ("socio de",))
    assert sorted(tuple(x) for x in ents.collect()) == [(1, 0, 0, 5, 9, "persona"), (1, 0, 1, 0, 3, "persona")]
    assert sorted(tuple(x) for x in rels.collect()) == [(1, 0, 0, 1, "socio de", "vigente"), (1, 0, 1, 0, "dirige", "futura")]
