"""The register of a room against plain rules, as a stream with late events and a restart, and as a replay."""

import random
from datetime import datetime, timedelta

import pytest

from tessera.streaming.registry import Register, presence, registry_stream, replayed

T0 = datetime(2024, 1, 1)
SCHEMA = "sala string, ts timestamp, orden long, sesion string, cliente string, accion string, articulo long"


def run(spark, events, silence=60.0):
    df = spark.createDataFrame([("r", T0 + timedelta(seconds=t), i, s, c, a, x) for i, (t, s, c, a, x) in enumerate(events)], SCHEMA)
    return [(r.sesion, r.accion, r.resultado, r.otra, r.numero) for r in replayed(df, silence).orderBy("ts", "orden").collect()]


def test_rules(spark):
    events = [
        (0, "a", "ana", "conectar", None),
        (1, "b", "bea", "conectar", None),
        (2, "a", "ana", "tomar", 7),
        (3, "b", "bea", "tomar", 7),
        (4, "b", "bea", "soltar", 7),
        (5, "b", "bea", "forzar", 7),
        (6, "a", "ana", "soltar", 7),
        (7, "b", "bea", "tomar", 8),
        (8, "a", "ana", "tomar", 7),
        (9, "x", "xan", "tomar", 7),
        (10, "a", "ana", "desconectar", None),
        (11, "c", "caz", "conectar", None),
        (12, "a2", "ana", "conectar", None),
        (13, "b", "bea", "soltar", 8),
        (14, "c", "caz", "tomar", 8),
        (50, "c", "caz", "latido", None),
        (80, "b", "bea", "tomar", 1),
    ]
    got = run(spark, events)
    assert got[:15] == [
        ("a", "conectar", "presente", None, 0),
        ("b", "conectar", "presente", None, 1),
        ("a", "tomar", "tomado", None, 0),
        ("b", "tomar", "ocupado", "a", 1),
        ("b", "soltar", "nada", None, 1),
        ("b", "forzar", "tomado", "a", 1),
        ("a", "soltar", "nada", None, 0),
        ("b", "tomar", "tomado", None, 1),
        ("a", "tomar", "tomado", None, 0),
        ("x", "tomar", "desconocida", None, None),
        ("a", "desconectar", "ausente", None, 0),
        ("c", "conectar", "presente", None, 0),
        ("a2", "conectar", "presente", None, 2),
        ("b", "soltar", "suelto", None, 1),
        ("c", "tomar", "tomado", None, 0),
    ]
    # b and a2 fell silent after 60 seconds, before b came again; c beat at 50 and leaves last.
    assert got[15:] == [("c", "latido", "vivo", None, 0), ("b", "expirar", "expulsada", None, 1), ("a2", "expirar", "expulsada", None, 2), ("b", "tomar", "desconocida", None, None), ("c", "expirar", "expulsada", None, 0)]


def test_a_client_gets_its_number_back(spark):
    events = [(0, "a", "ana", "conectar", None), (1, "b", "bea", "conectar", None), (2, "a", "ana", "desconectar", None), (3, "b", "bea", "desconectar", None), (4, "b2", "bea", "conectar", None), (5, "c", "caz", "conectar", None), (6, "a2", "ana", "conectar", None)]
    assert [(s, n) for s, a, _, _, n in run(spark, events) if a == "conectar"] == [("a", 0), ("b", 1), ("b2", 1), ("c", 0), ("a2", 2)]


def made(seed, rooms=4, n=150):
    r = random.Random(seed)
    out = []
    for room in range(rooms):
        t = 0.0
        for _ in range(n):
            t += r.choice((0.25, 1, 3, 9, 30))
            who = r.choice("abcde")
            out.append((f"r{room}", T0 + timedelta(seconds=t), len(out), who, f"c{who}", r.choice(("conectar", "latido", "latido", "tomar", "tomar", "soltar", "forzar", "desconectar")), r.choice((1, 2, 3, None))))
    return out


def simulated(events):
    out = set()
    for room in {e[0] for e in events}:
        reg = Register({}, {}, {}, 60.0)
        rows = []
        for _, ts, n, s, c, a, x in sorted((e for e in events if e[0] == room), key=lambda e: e[1:3]):
            rows += reg.apply((ts - T0).total_seconds(), n, s, c, a, x)
            held = [v[1] for v in reg.sessions.values() if v[1] is not None]
            assert len(held) == len(set(held)) and set(held) == set(reg.items) and all(reg.sessions[v][1] == k for k, v in reg.items.items())
        rows += reg.silent(float("inf"))
        out |= {(room, T0 + timedelta(seconds=r[0]), *r[1:]) for r in rows}
    return out


def rows_of(df):
    rows = df.collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_replay_equals_the_rules(spark):
    events = made(1)
    df = spark.createDataFrame(random.Random(0).sample(events, len(events)), SCHEMA).repartition(3)
    assert rows_of(replayed(df)) == simulated(events)
    assert replayed(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [2])
def test_stream_with_late_events_and_a_restart(spark, tmp_path, seed):
    events = sorted(made(seed, rooms=2, n=60), key=lambda e: e[1:3])
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], SCHEMA).write.parquet(source)

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def step():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = registry_stream(stream, 60.0, "10 seconds").writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        # Each step is a new query that goes on from the checkpoint.
        third = len(events) // 3
        feed(events[:third])
        step()
        feed(events[third : 2 * third])
        step()
        too_late = [("r0", T0 + timedelta(seconds=1), 9_000, "z", "cz", "conectar", None)]
        feed(events[2 * third :] + too_late)
        step()
        # Time goes on in one room; everyone there has left by then, and in the other room by the watermark.
        end = max(e[1] for e in events) + timedelta(hours=1)
        feed([("r0", end, 9_001, "y", "cy", "latido", None)])
        step()
        feed([("r1", end + timedelta(seconds=30), 9_002, "y", "cy", "latido", None)])
        step()
        got = rows_of(spark.read.parquet(sink))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = simulated(events)
    assert {r for r in got if r[3] != "y"} == want


def test_presence(spark):
    events = made(5, rooms=3, n=80)
    outcomes = replayed(spark.createDataFrame(events, SCHEMA))
    want = set()
    for room in {e[0] for e in events}:
        reg = Register({}, {}, {}, float("inf"))
        for _, ts, n, s, c, a, x in sorted((e for e in events if e[0] == room), key=lambda e: e[1:3]):
            reg.apply((ts - T0).total_seconds(), n, s, c, a, x)
        want |= {(room, k, v[0], v[1]) for k, v in reg.sessions.items() if v[1] is not None}
    patient = replayed(spark.createDataFrame(events, SCHEMA), 1e9).where("resultado <> 'expulsada'")
    assert {tuple(r) for r in presence(patient).where("articulo is not null").collect()} == want
    # At the end of the replay all of them have left.
    assert presence(outcomes).count() == 0
