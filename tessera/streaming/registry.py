"""Presence and leases of a room as a stateful stream: sessions come and go, take, give back or seize items, fall silent.

Events are (sala, ts, orden, sesion, cliente, accion, articulo), accion being conectar, latido, tomar, soltar, forzar or
desconectar. A room is what shares one register (a site); its events pass through one state machine, whose state are maps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What comes out: one row for each answer; `otra` is the session that holds or lost the item, `numero` the session's number.
OUTCOMES = "sala string, ts timestamp, orden long, sesion string, accion string, articulo long, resultado string, otra string, numero int"
_COLUMNS = [c.split()[0] for c in OUTCOMES.split(", ")][1:]
#: Numbers of sessions that are present at once; who comes when all are taken gets number 0 (fixed values).
NUMBERS, SILENCE_SECONDS = 40, 60.0


class Register:
    """The rules over three maps: sessions {id: [number, item, last beat]}, items {id: session}, clients {id: last number}."""

    def __init__(self, sessions: dict, items: dict, clients: dict, silence: float, numbers: int = NUMBERS):
        self.sessions, self.items, self.clients, self.silence, self.numbers = sessions, items, clients, silence, numbers

    def silent(self, now: float) -> list[tuple]:
        """Sessions whose last beat is longer ago than the limit leave, and what they held is free."""
        gone = sorted((s[2], k) for k, s in self.sessions.items() if now - s[2] > self.silence)
        out = []
        for beat, k in gone:
            number, item, _ = self.sessions.pop(k)
            if item is not None:
                self.items.pop(item, None)
            out.append((beat + self.silence, None, k, "expirar", item, "expulsada", None, number))
        return out

    def apply(self, ts: float, order: int, session: str, client: str, action: str, item: int | None) -> list[tuple]:
        out = self.silent(ts)
        answer, other = "desconocida", None
        s = self.sessions.get(session)
        if action == "conectar":
            used = {x[0] for x in self.sessions.values()}
            last = self.clients.get(client)
            number = last if last is not None and last not in used else next((i for i in range(self.numbers) if i not in used), 0)
            self.clients[client] = number
            if s is not None and s[1] is not None:
                self.items.pop(s[1], None)
            s = self.sessions[session] = [number, None, ts]
            answer = "presente"
        elif s is not None:
            if action == "latido":
                s[2], answer = ts, "vivo"
            elif action == "desconectar":
                self.sessions.pop(session)
                if s[1] is not None:
                    self.items.pop(s[1], None)
                answer = "ausente"
            elif action == "soltar":
                if s[1] == item is not None:
                    self.items.pop(item)
                    s[1], answer = None, "suelto"
                else:
                    answer = "nada"
            elif action in ("tomar", "forzar") and item is not None:
                holder = self.items.get(item)
                if holder not in (None, session) and action == "tomar":
                    answer, other = "ocupado", holder
                else:
                    if s[1] is not None and s[1] != item:
                        self.items.pop(s[1], None)
                    if holder not in (None, session):
                        self.sessions[holder][1], other = None, holder
                    self.items[item], s[1], answer = session, item, "tomado"
        out.append((ts, order, session, action, item, answer, other, s[0] if s else None))
        return out


def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    out.insert(0, "sala", key[0])
    out["ts"] = pd.to_datetime(out["ts"], unit="s", utc=True).dt.round("us").dt.tz_localize(None)
    for c, kind in (("orden", "Int64"), ("articulo", "Int64"), ("numero", "Int32")):
        out[c] = out[c].astype(kind)
    return out


class _Room(StatefulProcessor):
    def __init__(self, silence: float):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "sesion string", "numero int, articulo long, latido double")
        self.items = handle.getMapState("items", "articulo long", "sesion string")
        self.clients = handle.getMapState("clients", "cliente string", "numero int")

    def _load(self) -> Register:
        maps = ({k[0]: f(v) for k, v in m.iterator()} for m, f in ((self.sessions, list), (self.items, lambda v: v[0]), (self.clients, lambda v: v[0])))
        return Register(*maps, self.silence)

    def _keep(self, before: tuple, register: Register) -> None:
        """Writes what has changed, and a timer for the moment at which the most silent session leaves."""
        for state, old, new, value in (
            (self.sessions, before[0], register.sessions, tuple),
            (self.items, before[1], register.items, lambda v: (v,)),
            (self.clients, before[2], register.clients, lambda v: (v,)),
        ):
            for k in old.keys() - new.keys():
                state.removeKey((k,))
            for k, v in new.items():
                if old.get(k) != v:
                    state.updateValue((k,), value(v))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if register.sessions:
            self.handle.registerTimer(int((min(s[2] for s in register.sessions.values()) + self.silence) * 1000) + 1)

    @staticmethod
    def _copy(r: Register) -> tuple:
        return {k: list(v) for k, v in r.sessions.items()}, dict(r.items), dict(r.clients)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        register = self._load()
        before = self._copy(register)
        events = pd.concat(list(rows)).sort_values(["ts", "orden"], kind="stable")
        out = []
        seconds = (events["ts"] - pd.Timestamp(0)).dt.total_seconds()
        for ts, e in zip(seconds, events.itertuples(index=False)):
            out += register.apply(ts, int(e.orden), e.sesion, e.cliente, e.accion, None if pd.isna(e.articulo) else int(e.articulo))
        self._keep(before, register)
        if out:
            yield _frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        register = self._load()
        before = self._copy(register)
        out = register.silent(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._keep(before, register)
        if out:
            yield _frame(key, out)

    def close(self) -> None:
        pass


def registry_stream(events: DataFrame, silence_seconds: float = SILENCE_SECONDS, late: str = "10 seconds") -> DataFrame:
    """Outcomes of a stream of events (see OUTCOMES), in event time: presente, vivo, tomado, ocupado, suelto, nada, ausente, desconocida, expulsada.

    A session holds one item at most. `tomar` is refused while another session holds the item; `forzar` takes it from whoever
    has it, named in `otra`; `soltar` of what one does not hold does nothing. A session silent for longer than the limit leaves
    before the next event of its room, or when the watermark passes that moment if none comes. A client gets the number it
    last had if that is free, else the smallest free one. Events later than the watermark allows are dropped by it; within a
    micro-batch events apply in order of time and number. Rows without room, time or session are left out.
    """
    use_rocksdb(events.sparkSession)
    whole = events.where("sala is not null and ts is not null and sesion is not null").select("sala", "ts", "orden", "sesion", "cliente", "accion", "articulo")
    return whole.withWatermark("ts", late).groupBy("sala").transformWithStateInPandas(_Room(silence_seconds), OUTCOMES, "Append", "EventTime", None, "")


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and map states need this state store; its checkpoints are in the query's checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replayed(events: DataFrame, silence_seconds: float = SILENCE_SECONDS) -> DataFrame:
    """The same outcomes of a finished table: a room's events sorted within partitions, and the register carried along."""
    rows = events.where("sala is not null and ts is not null and sesion is not null").select("sala", "ts", "orden", "sesion", "cliente", "accion", "articulo")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, register = None, Register({}, {}, {}, silence_seconds)
        for b in batches:
            seconds = (b["ts"] - pd.Timestamp(0)).dt.total_seconds()
            parts: dict[str, list[tuple]] = {}
            for ts, e in zip(seconds, b.itertuples(index=False)):
                if e.sala != now:
                    if now is not None:
                        parts.setdefault(now, []).extend(register.silent(float("inf")))
                    now, register = e.sala, Register({}, {}, {}, silence_seconds)
                parts.setdefault(now, []).extend(register.apply(ts, int(e.orden), e.sesion, e.cliente, e.accion, None if pd.isna(e.articulo) else int(e.articulo)))
            for room, out in parts.items():
                if out:
                    yield _frame((room,), out)
        if now is not None and (out := register.silent(float("inf"))):
            yield _frame((now,), out)

    return rows.repartition("sala").sortWithinPartitions("sala", "ts", "orden").mapInPandas(run, OUTCOMES)


def presence(outcomes: DataFrame) -> DataFrame:
    """Who is present after the outcomes of registry_stream() or replayed(), and what they hold: sala, sesion, numero, articulo."""
    known = outcomes.where("numero is not null")
    at = F.struct("ts", F.coalesce("orden", F.lit(-1)))
    left = F.col("resultado").isin("ausente", "expulsada")
    item = F.when(F.col("resultado") == "tomado", F.col("articulo"))
    changes = known.where(F.col("resultado").isin("presente", "tomado", "suelto", "ausente", "expulsada")).select("sala", "sesion", at.alias("at"), F.struct(item.alias("articulo"), left.alias("fuera")).alias("s"))
    lost = known.where("resultado = 'tomado' and otra is not null").select("sala", F.col("otra").alias("sesion"), at.alias("at"), F.struct(F.lit(None).cast("long").alias("articulo"), F.lit(False).alias("fuera")).alias("s"))
    last = changes.union(lost).groupBy("sala", "sesion").agg(F.max_by("s", "at").alias("s"))
    number = known.where("resultado = 'presente'").groupBy("sala", "sesion").agg(F.max_by("numero", at).alias("numero"))
    return last.where("not s.fuera").join(number, ["sala", "sesion"]).select("sala", "sesion", "numero", "s.articulo")
