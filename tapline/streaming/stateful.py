"""Keyed streams with state of their own: flow deltas, scans, and the classification of sequence numbers.

Every processor reads a key's state once for a batch, takes the batch's rows piece by piece, each in time order, and
writes back what changed. Findings come with the record that causes them, not when a window closes. Event-time timers
remove what is idle. All need the RocksDB state store (`rocks`), which keeps state beyond a worker's memory.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapline.operators.ladders import climbs

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Fixed values of the record contract: failed connection states, ranks, how long flows and their ends are remembered,
# and the numbers that a sequence window holds.
FAILED, MEDIUM, HIGH, INFO = ("S0", "REJ", "RSTOS0", "SH"), 2, 3, 0
NAMED = {INFO: "info", MEDIUM: "medium", HIGH: "high"}
IDLE_MS, ENDED_MS, SEQUENCES = 600_000, 60_000, 65_536


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start in this block keep their state in RocksDB; the session's own choice returns after it."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


class FlowProcessor(StatefulProcessor):
    """The growth of each flow's counters over its snapshots; what remains comes with the terminal record.

    Snapshots that don't exceed all before them go, and so does what follows the end of a flow that had snapshots. A flow
    is forgotten `idle_ms` after its last snapshot, and `ended_ms` after its end, whether or not a timer came first.
    """

    def __init__(self, sequence: str, arrival: list[str], counters: dict[str, str], terminal: str, at: str, idle_ms: int, ended_ms: int, names: list[str]):
        self.sequence, self.arrival, self.counters, self.terminal, self.at = sequence, arrival, counters, terminal, at
        self.idle_ms, self.ended_ms, self.names = idle_ms, ended_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", "high long, ended boolean, last long, " + ", ".join(f"c{i} {kind}" for i, kind in enumerate(self.counters.values())))

    def _kept(self, state: tuple) -> int:
        return self.ended_ms if state[1] else self.idle_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        del key, timerValues
        state = tuple(self.flow.get()) if self.flow.exists() else None
        begin, numbers = state, [float if kind == "double" else int for kind in self.counters.values()]
        for piece in rows:
            keep, fresh, growth = [], [], []
            piece = piece.sort_values(self.arrival)
            for number, ends, at, *now in piece[[self.sequence, self.terminal, self.at, *self.counters]].itertuples(index=False, name=None):
                if state is not None and at - state[2] >= self._kept(state):
                    state = None
                if state is not None and (state[1] or not ends and number <= state[0]):
                    keep.append(False)
                    continue
                now = [None if pd.isna(x) else number_of(x) for x, number_of in zip(now, numbers)]
                held = state[3:] if state is not None else [None] * len(now)
                keep.append(True)
                fresh.append(state is None)
                growth.append([None if x is None else max(x - (h or 0), type(x)(0)) for x, h in zip(now, held)])
                if not ends:
                    most = [h if x is None else x if h is None else max(h, x) for x, h in zip(now, held)]
                    state = (int(number), False, int(at), *most)
                elif state is not None:
                    state = (state[0], True, int(at), *state[3:])
            out = piece[keep].assign(new_flow=fresh)
            for i, (name, kind) in enumerate(self.counters.items()):
                out[f"d_{name}"] = pd.array([g[i] for g in growth], dtype="Float64" if kind == "double" else "Int64")
            yield out[self.names]
        if state is not None and state != begin:
            self.flow.update(state)
            self.handle.registerTimer(state[2] + self._kept(state))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        del key, timerValues
        if self.flow.exists():
            state = tuple(self.flow.get())
            if state[2] + self._kept(state) <= expiredTimerInfo.getExpiryTimeInMs():
                self.flow.clear()
        yield from ()

    def close(self) -> None:
        pass


def flow_deltas(stream: DataFrame, flow: list[str], sequence: str, arrival: list[str], counters: list[str], terminal: str, at: str, idle_ms: int = IDLE_MS, ended_ms: int = ENDED_MS) -> DataFrame:
    """The stream twin of the batch operator of this name: `at` is observation time in ms, and idle flows are forgotten."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    own = {c: "double" if kinds[c] in ("double", "float") else "long" for c in counters}
    names = [c for c in stream.columns if not kinds[c].startswith("timestamp")]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["new_flow boolean"] + [f"d_{c} {own[c]}" for c in counters])
    processor = FlowProcessor(sequence, arrival, own, terminal, at, idle_ms, ended_ms, [*names, "new_flow", *(f"d_{c}" for c in counters)])
    return stream.groupBy(*flow).transformWithStateInPandas(processor, schema, "append", "eventTime")


class Contacts:
    """Pairs of host and port met within a horizon, with running counts of hosts by port and ports by host."""

    def __init__(self, horizon: int, seen: dict[tuple[str, str], int]):
        self.horizon, self.seen = horizon, dict(seen)
        self.due = [(t, pair) for pair, t in seen.items()]
        heapq.heapify(self.due)
        self.hosts = Counter(port for _, port in seen)
        self.ports = Counter(host for host, _ in seen)

    def expire(self, now: int) -> None:
        while self.due and self.due[0][0] < now - self.horizon:
            t, pair = heapq.heappop(self.due)
            if self.seen.get(pair) == t:
                del self.seen[pair]
                self.ports[pair[0]] -= 1
                self.hosts[pair[1]] -= 1

    def meet(self, pair: tuple[str, str], now: int) -> None:
        last = self.seen.get(pair)
        if last is None:
            self.ports[pair[0]] += 1
            self.hosts[pair[1]] += 1
        if last is None or now > last:
            self.seen[pair] = now
            heapq.heappush(self.due, (now, pair))


FINDINGS = ["src", "obs_ms", "subtype", "severity", "rank", "amount", "score"]


class ScanProcessor(StatefulProcessor):
    """One source's pairs with the time each was last met, and what its ladders have reported.

    All of it is one value, read and written once for a batch: calls to the store cost more than the rows. A source's
    rows of a batch are kept as numbers, 13 bytes each, until all are there, and pass in time order.
    """

    KINDS, MADE, PART = ("horizontal_scan", "vertical_scan"), "src string, obs_ms long, kind int, rank int, amount double", 65_536

    def __init__(self, horizon_ms: int, hosts: int, ports: int, scanners: frozenset[str]):
        self.horizon, self.least, self.scanners = horizon_ms, (hosts, ports), scanners

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("scan", "known long, lost long, newest long, rank0 int, told0 double, rank1 int, told1 double, hosts array<string>, ports array<string>, seen array<long>")

    def _rank(self, src: str, amount: int, least: int, failed: float | None) -> int:
        if src in self.scanners:
            return INFO
        return HIGH if amount >= 5 * least or failed is not None and failed >= 0.8 and amount >= 2 * least else MEDIUM

    def _moments(self, rows: Iterator[pd.DataFrame], pairs: list[tuple[str, str]]) -> Iterator[tuple[int, list[tuple]]]:
        """Each time with its rows (time, number of the pair in `pairs`, attempt), in order."""
        numbers, pieces = {}, []
        for piece in rows:
            met = [numbers.setdefault(pair, len(numbers)) for pair in zip(piece["dst"].tolist(), piece["port_key"].tolist())]
            pieces.append((piece["obs_ms"].to_numpy(np.int64), np.array(met, np.int32), piece["attempt"].to_numpy(np.uint8)))
        pairs += numbers
        times, met, attempts = (np.concatenate(c) for c in zip(*pieces))
        order = np.argsort(times, kind="stable")
        parts = (order[i : i + self.PART] for i in range(0, len(order), self.PART))
        return groupby((row for part in parts for row in zip(times[part].tolist(), met[part].tolist(), attempts[part].tolist())), key=itemgetter(0))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        del timerValues
        src, pairs, out = key[0], [], []
        known, lost, newest, *told, hosts, ports, seen = self.state.get() or (0, 0, None, None, None, None, None, (), (), ())
        contacts = Contacts(self.horizon, dict(zip(zip(hosts, ports), seen)))
        ladders = [None if told[2 * i] is None else (told[2 * i], told[2 * i + 1], 0) for i in (0, 1)]
        for now, tied in self._moments(rows, pairs):
            tied = list(tied)
            contacts.expire(now)
            if not contacts.seen:
                known, lost, ladders = 0, 0, [None, None]
            newest = now if newest is None else max(newest, now)
            for _, met, attempt in tied:
                contacts.meet(pairs[met], now)
                known, lost = known + (attempt >> 1 & 1), lost + (attempt >> 2)
            for i, least in enumerate(self.least):
                found = []
                for _, met, attempt in tied:
                    host, port = pairs[met]
                    amount = contacts.ports[host] if i else contacts.hosts[port]
                    if amount >= least:
                        failed = lost / known if known and attempt & 1 else None
                        found.append((self._rank(src, amount, least, failed), float(amount)))
                for rank, amount in sorted(found, key=lambda x: (NAMED[x[0]], x)):
                    ladders[i], say = climbs(ladders[i], now, rank, amount, None, True)
                    if say:
                        out.append((now, i, rank, amount))
        if out:
            at, kind, rank, amount = zip(*out)
            yield pd.DataFrame({"src": [src] * len(out), "obs_ms": at, "kind": kind, "rank": rank, "amount": amount})
        hosts, ports = zip(*contacts.seen) if contacts.seen else ((), ())
        self._keep((known, lost, newest, *(x for s in ladders for x in ((None, None) if s is None else (int(s[0]), s[1])))), hosts, ports, contacts.seen.values())
        self.handle.registerTimer(newest + self.horizon + 1)

    def _keep(self, meta: tuple, hosts, ports, seen) -> None:
        self.state.update((*meta, list(hosts), list(ports), list(seen)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Pairs that the horizon has left go; a source without any is forgotten."""
        del key, timerValues
        state, least = self.state.get(), expiredTimerInfo.getExpiryTimeInMs() - self.horizon
        if state is not None and state[2] < least:
            self.state.clear()
        elif state is not None and min(state[-1], default=least) < least:
            left = [x for x in zip(*state[-3:]) if x[2] >= least]
            self._keep(state[:-3], *(zip(*left) if left else ((), (), ())))
        yield from ()

    def close(self) -> None:
        pass


def scans(deltas: DataFrame, scanners: frozenset[str] = frozenset(), horizon_ms: int = 30_000, hosts: int = 20, ports: int = 25) -> DataFrame:
    """Findings of the batch operator of this name, each with the record that causes it.

    `deltas` has src, dst, port_key, obs_ms, new_flow, terminal, coverage, conn_state and event time; `scanners` is the
    inventory's short list of allowed sources. Rows of one time count together if they come in one batch.
    """
    both = F.coalesce(F.col("coverage") == "both_directions", F.lit(False))
    known = both & F.coalesce("terminal", F.lit(False)) & F.col("conn_state").isNotNull()
    attempt = both.cast("int") + 2 * known.cast("int") + 4 * (known & F.col("conn_state").isin(*FAILED)).cast("int")
    times = [f.name for f in deltas.schema if f.dataType.simpleString() == "timestamp"]
    rows = deltas.filter("new_flow AND obs_ms IS NOT NULL").select("src", "dst", "port_key", "obs_ms", F.coalesce(attempt, F.lit(0)).alias("attempt"), *times)
    processor = ScanProcessor(horizon_ms, hosts, ports, scanners)
    made = rows.groupBy("src").transformWithStateInPandas(processor, processor.MADE, "append", "eventTime")
    kind, rank = F.col("kind"), F.col("rank")
    score = F.least(F.lit(1.0), 0.5 + 0.5 * F.col("amount") / (4 * F.when(kind == 0, hosts).otherwise(ports)))
    subtype, severity = (F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), c) for names, c in ((dict(enumerate(processor.KINDS)), kind), (NAMED, rank)))
    return made.withColumns({"subtype": subtype, "severity": severity, "score": score}).select(*FINDINGS)


class Received:
    """The last `window` numbers of a stream as a ring of bits that slides with the highest one."""

    def __init__(self, window: int, state: tuple | None = None):
        self.window = window
        self.base, self.high, bits = state or (None, None, bytes((window + 7) // 8))
        self.bits = bytearray(bits)

    def _get(self, number: int) -> bool:
        at = number % self.window
        return bool(self.bits[at >> 3] >> (at & 7) & 1)

    def _set(self, number: int, on: bool) -> None:
        at = number % self.window
        self.bits[at >> 3] = self.bits[at >> 3] | 1 << (at & 7) if on else self.bits[at >> 3] & ~(1 << (at & 7)) & 255

    def take(self, number: int) -> tuple[str, int]:
        """The status of a number that arrives, and how many numbers it skips."""
        if self.high is None:
            self.base = self.high = number
            self._set(number, True)
            return "new", 0
        if number > self.high:
            skipped = number - self.high - 1
            if skipped >= self.window:
                self.bits = bytearray(len(self.bits))
            else:
                for n in range(self.high + 1, number):
                    self._set(n, False)
            self._set(number, True)
            self.high = number
            return "new", skipped
        if number <= self.high - self.window or number < self.base:
            return "stale", 0
        if self._get(number):
            return "duplicate", 0
        self._set(number, True)
        return "reordered", 0

    def state(self) -> tuple:
        return self.base, self.high, bytes(self.bits)


class SequenceProcessor(StatefulProcessor):
    """One bit for each of the last numbers of a stream; a stream that is silent for `idle_ms` is forgotten."""

    def __init__(self, sequence: str, arrival: list[str], at: str, window: int, idle_ms: int, names: list[str]):
        self.sequence, self.arrival, self.at, self.window, self.idle_ms, self.names = sequence, arrival, at, window, idle_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.received = handle.getValueState("received", "base long, high long, bits binary, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        del key, timerValues
        *state, last = tuple(self.received.get()) if self.received.exists() else (None, 0)
        ring = Received(self.window, tuple(state) if len(state) == 3 else None)
        for piece in rows:
            piece = piece.sort_values(self.arrival)
            made = [ring.take(int(n)) for n in piece[self.sequence]]
            last = max(last, int(piece[self.at].max()))
            yield piece.assign(status=[m[0] for m in made], gap=[m[1] for m in made])[self.names]
        self.received.update((*ring.state(), last))
        self.handle.registerTimer(last + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        del key, timerValues
        if self.received.exists() and tuple(self.received.get())[3] + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.received.clear()
        yield from ()

    def close(self) -> None:
        pass


def classify_sequence(stream: DataFrame, by: list[str], sequence: str, arrival: list[str], at: str, window: int = SEQUENCES, idle_ms: int = 86_400_000) -> DataFrame:
    """The stream twin of the batch operator of this name: status and gap of each arrival, from a sliding bitmap.

    `at` is the time of arrival in ms, which is the stream's event time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema if not f.dataType.simpleString().startswith("timestamp")}
    processor = SequenceProcessor(sequence, arrival, at, window, idle_ms, [*kinds, "status", "gap"])
    schema = ", ".join([f"`{c}` {kind}" for c, kind in kinds.items()] + ["status string", "gap long"])
    return stream.groupBy(*by).transformWithStateInPandas(processor, schema, "append", "eventTime")
