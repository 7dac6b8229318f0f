"""Per-client rate state for streams: one stateful operator, one shuffle on client.

The state is counted: a map of cells (a sixtieth of the window) to the counts of the
instants inside, so its size is bounded by the window and the resolution, however many
requests arrive. Templates are a map of their own, of which a batch touches only the ones
it brings. An event-time timer forgets a client once the stream has moved past its window
and session, so replays end and idle clients cost nothing.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reqlens.config import DEFAULTS, Settings
from reqlens.operators.rates import with_verdict

SECOND = 1_000_000
CELLS = 60  # of a window
RESET = "reset"
NEVER = -(1 << 62)
COUNTS = ["window_count", "burst_count", "window_distinct", "late"]


def _summed(units: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instants in order, each once, with their summed counts."""
    every, place = np.unique(units, return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, place.reshape(-1), counts)
    return every, total


class RateState(StatefulProcessor):
    """Rows of a client, in event order within a micro-batch, to their counts.

    Request text rides along as one packed column, so the operator's schema does not
    depend on the request's; it is neither copied nor sorted.
    """

    def __init__(self, window_us: int, burst_us: int, gap_us: int, lateness_us: int, resolution_us: int):
        self.window, self.burst = window_us // resolution_us, burst_us // resolution_us
        self.gap_us, self.lateness_us, self.resolution_us = gap_us, lateness_us, resolution_us
        self.cell = max(1, self.window // CELLS)
        self.keep_us = max(window_us, gap_us) + lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The newest request, the running session's start and templates, the timer.
        self.head = handle.getValueState("head", "last bigint, start bigint, known bigint, timer bigint")
        self.cells = handle.getMapState("cells", "cell bigint", "units binary, counts binary")
        # A template belongs to the running session if it carries its start.
        self.templates = handle.getMapState("templates", "template string", "start bigint")

    def _forget(self) -> None:
        self.head.clear()
        self.cells.clear()
        self.templates.clear()

    def _stored(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [(np.frombuffer(u, np.int64), np.frombuffer(c, np.int64)) for _, (u, c) in self.cells.iterator()]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        units, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(units)
        return units[order], counts[order]

    def _part(self, us: np.ndarray, templates: np.ndarray, behind: int) -> np.ndarray:
        """Counts of consecutive rows, in event order, between two resets; updates the state."""
        last, start, known, timer = self.head.get() if self.head.exists() else (None, None, 0, None)
        out = np.zeros((len(COUNTS), len(us)), np.int64)
        none = np.zeros(0, np.int64)
        units, counts = (none, none) if last is None else self._stored()
        cum = np.append(0, np.cumsum(counts))
        now = us // self.resolution_us

        def upto(at: np.ndarray) -> np.ndarray:
            return cum[np.searchsorted(units, at, side="right")]
        own = np.arange(1, len(us) + 1)
        for k, span in enumerate((self.window, self.burst)):
            out[k] = (upto(now) - upto(now - span)) + own - np.searchsorted(now, now - span, side="right")

        newest = np.maximum.accumulate(np.append(NEVER if last is None else last, us))
        before = newest[:-1]
        fresh = us - before >= self.gap_us  # a first row has none before it
        out[3] = (before > NEVER) & (us < before - self.lateness_us)
        if last is None:  # it may have been forgotten already
            out[3] |= us < behind
        session = np.cumsum(fresh)
        starts = np.append(NEVER if start is None else start, us[fresh])
        met = {}  # a client has few rows in a batch: frames would cost more than the rows
        for i, pair in enumerate(zip(session.tolist(), templates.tolist())):
            met.setdefault(pair, i)
        first = np.zeros(len(us), bool)
        first[list(met.values())] = True
        for i in np.flatnonzero(first & (session == 0)):  # none without a running session
            seen = self.templates.getValue((templates[i],))
            first[i] = seen is None or seen[0] != start
        total = np.cumsum(first)
        base = np.append(known, -total[np.flatnonzero(fresh) - 1] if fresh.any() else [])
        base[1:][np.flatnonzero(fresh) == 0] = 0
        out[2] = total + base[session]
        for i in np.flatnonzero(first & (session == session[-1])):
            self.templates.updateValue((templates[i],), (int(starts[-1]),))

        newest_us = int(newest[-1])
        floor = (newest_us - self.lateness_us) // self.resolution_us - self.window
        add_units, add_counts = _summed(now, np.ones(len(now), np.int64))
        touched = np.unique(add_units // self.cell)
        for c in touched[(touched + 1) * self.cell > floor].tolist():
            mine, new = units // self.cell == c, add_units // self.cell == c
            u, n = _summed(np.append(units[mine], add_units[new]), np.append(counts[mine], add_counts[new]))
            self.cells.updateValue((c,), (u.tobytes(), n.tobytes()))
        held = np.unique(units // self.cell)
        for c in held[(held + 1) * self.cell <= floor].tolist():
            self.cells.removeKey((c,))
        due = (newest_us + self.keep_us) // 1000 + 1
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.head.update((newest_us, int(starts[-1]), int(out[2][-1]), due))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        us, ids, templates, kinds = (np.concatenate([f[c].to_numpy() for f in frames]) for c in (
            "us", "event_id", "template", "kind"))
        order = np.lexsort((ids, us))
        us, templates, resets = us[order].astype(np.int64), templates[order], kinds[order] == RESET
        behind = timerValues.getCurrentWatermarkInMs() * 1000
        out = np.zeros((len(COUNTS), len(us)), np.int64)
        edges = [*np.flatnonzero(resets).tolist(), len(us)]
        at = 0
        for edge in edges:
            if at < edge:
                out[:, order[at:edge]] = self._part(us[at:edge], templates[at:edge], behind)
            if edge < len(us):
                if self.head.exists():
                    self.handle.deleteTimer(self.head.get()[3])
                self._forget()
            at = edge + 1
        at = 0
        for frame in frames:
            passed = frame["kind"].to_numpy() != RESET
            part = out[:, at:at + len(frame)][:, passed]
            at += len(frame)
            yield pd.DataFrame({"packed": frame["packed"].to_numpy()[passed], **dict(zip(COUNTS, part))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        yield pd.DataFrame({"packed": pd.Series([], dtype=str), **{c: pd.Series([], dtype="int64") for c in COUNTS}})

    def close(self) -> None:
        pass


def stream_rate_state(requests: DataFrame, settings: Settings = DEFAULTS,
                      lateness_seconds: int = 0, resolution_us: int = 1000) -> DataFrame:
    """Adds window_count, burst_count, window_distinct, the verdict and
    rate_degraded to a request stream.

    Counts are exact for times in whole steps of `resolution_us`, a millisecond by default;
    finer times count as of their step. A client's state has at most a count for each step
    of its window and lateness. Rows that arrive more than `lateness_seconds` behind their
    client's newest request, or behind the stream when their client is already forgotten,
    are still counted and scored, but marked degraded; none is dropped. A row whose
    optional column `kind` is 'reset' clears its client's counters and is not passed on.

    Clients are forgotten by event time, when the stream's newest request is a window, a
    session gap and the lateness ahead of theirs. Needs the RocksDB state store.
    """
    # The watermark moves the timers. It isn't carried into the operator, which would drop late rows.
    clock = F.coalesce(F.col("ts"), F.timestamp_micros(F.lit(0)))
    requests = requests.withColumn("_clock", clock).withWatermark("_clock", f"{lateness_seconds} seconds")
    kind = F.coalesce(F.col("kind"), F.lit("request")) if "kind" in requests.columns else F.lit(
        "request")
    columns = [c for c in requests.columns if c not in ("kind", "_clock")]
    schema = requests.select(*columns).schema
    packed = requests.select(
        F.coalesce("client", F.lit("unknown")).alias("_key"), F.unix_micros("_clock").alias("us"),
        F.coalesce("event_id", F.lit(-1)).alias("event_id"),
        F.coalesce("template", F.lit("/")).alias("template"), kind.alias("kind"),
        F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                                       "ignoreNullFields": "false"}).alias("packed"))
    out = packed.groupBy("_key").transformWithStateInPandas(
        RateState(settings.window_seconds * SECOND, settings.burst_seconds * SECOND,
                  settings.session_gap_seconds * SECOND, lateness_seconds * SECOND, resolution_us),
        outputStructType="packed string, window_count bigint, burst_count bigint, "
                         "window_distinct bigint, late bigint",
        outputMode="Append", timeMode="EventTime")
    row = F.from_json("packed", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    out = out.withColumn("r", row).select(
        "r.*", "window_count", "burst_count", "window_distinct",
        (F.col("late") == 1).alias("rate_degraded"))
    return with_verdict(out, settings)
