from tessera.operators import graph


def test_all_occupants_are_kept_in_order(spark):
    d = spark.createDataFrame([(1, "Ministro", 1950)], "wp_id long, cargo string, anio int")
    h = spark.createDataFrame([("ministro", f"N{i}", 1950 + i) for i in range(8)] + [("ministro", "X", None)], "cargo string, nombre string, anio int")
    rows = sorted((r.puesto, r.nombre) for r in graph.occupants(d, h).collect())
    assert rows == [*((i + 1, f"N{i}") for i in range(8)), (9, "X")]
    assert graph.occupants(d, h, 3).count() == 3
