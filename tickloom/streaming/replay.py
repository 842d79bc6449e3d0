"""Exact replay of frame sequencing, one key at a time: reorder buffer, eras, duplicates, gaps and clocks.

``Sequencer`` is a plain state machine, which the batch form drives with mapInArrow and the streaming form with
applyInPandasWithState; its state is bounded by the reorder window and the ring of frames seen. A key is a channel
instance and port, so the parallelism is that of the feeds; the relational operators are the way to spread one feed.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["capture_id", "channel_id", "port"]
FINDINGS = "capture_id string, channel_id bigint, port string, seq bigint, era_no bigint, rule_id string, status string, transport boolean"
_STATE = "state string"


class Sequencer:
    """Frames go in as they arrive; findings come out as frames leave the buffer in the order of their numbers."""

    def __init__(self, window: int = 8, state: dict | None = None):
        s = state or {}
        self.window = window
        self.reset, self.era = s.get("reset"), s.get("era", 0)
        self.heap = [tuple(x) for x in s.get("heap", [])]
        self.last, self.clock = s.get("last"), s.get("clock")
        self.ring = [tuple(x) for x in s.get("ring", [])]  # (seq, payload) of the frames that left last

    def state(self) -> dict:
        return {"reset": self.reset, "era": self.era, "heap": self.heap, "last": self.last, "clock": self.clock, "ring": self.ring}

    def push(self, arrival: int, seq: int, reset: int, send_ts: int, payload: int) -> Iterator[tuple[int, int, str, str, bool]]:
        """(seq, era, rule, status, transport) of what leaves. Older and ambiguous eras are lost on the way."""
        ahead = 0 if self.reset is None else (reset - self.reset) % 256
        if self.reset is None:
            self.reset = reset
        elif ahead >= 128:
            yield seq, self.era, "FRAME.SEQ_RESET_GAP", "na", True
            return
        elif ahead:
            yield from self.flush()
            self.reset, self.era, self.last, self.clock, self.ring = reset, self.era + 1, None, None, []
            if seq:
                yield seq, self.era, "FRAME.MKTDATA_SEQ_START", "violation", False
        heapq.heappush(self.heap, (seq, arrival, send_ts, payload))
        while len(self.heap) > self.window:
            yield from self._leave()

    def flush(self) -> Iterator[tuple[int, int, str, str, bool]]:
        while self.heap:
            yield from self._leave()

    def _leave(self) -> Iterator[tuple[int, int, str, str, bool]]:
        seq, _, ts, payload = heapq.heappop(self.heap)
        seen = dict(self.ring)
        if seq in seen:
            if seen[seq] != payload:
                yield seq, self.era, "FRAME.SEQ_DUP_DIVERGENT", "violation", False
            return
        self.ring = [*self.ring, (seq, payload)][-max(16, 2 * self.window) :]
        if self.last is not None and seq < self.last:
            yield seq, self.era, "FRAME.SEQ_RESET_GAP", "violation", False
            return
        if self.last is not None and seq > self.last + 1:
            yield seq, self.era, "FRAME.GAP", "na", True
        if self.clock is not None and ts < self.clock:
            yield seq, self.era, "FRAME.SEND_TS_MONOTONIC", "violation", False
        self.last, self.clock = seq, ts


def _rows(key: tuple, found: list[tuple]) -> pd.DataFrame:
    rows = [(*key, *x) for x in found]
    return pd.DataFrame(rows, columns=["capture_id", "channel_id", "port", "seq", "era_no", "rule_id", "status", "transport"])


def _feed(s: Sequencer, pdf: pd.DataFrame) -> list[tuple]:
    found: list[tuple] = []
    for r in pdf.sort_values("arrival", kind="stable").itertuples(index=False):
        found += s.push(int(r.arrival), int(r.seq), int(r.reset_count), int(r.send_ts), int(r.payload))
    return found


_IN = ["arrival", "seq", "reset_count", "send_ts", "payload"]
_OUT = pa.schema([("capture_id", pa.string()), ("channel_id", pa.int64()), ("port", pa.string()), ("seq", pa.int64()), ("era_no", pa.int64()), ("rule_id", pa.string()), ("status", pa.string()), ("transport", pa.bool_())])


def _replayed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Findings of rows sorted by key and arrival, a batch for each batch and one for the end: a key is never held whole."""
    key, s = None, Sequencer(window)
    table = lambda found: pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(_OUT)], schema=_OUT)
    for batch in batches:
        found: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in [*KEYS, *_IN]), strict=True):
            if row[:3] != key:
                found += [(*key, *x) for x in s.flush()] if key else []
                key, s = row[:3], Sequencer(window)
            found += [(*key, *x) for x in s.push(*row[3:])]
        yield table(found)
    if key:
        yield table([(*key, *x) for x in s.flush()])


def replay_batch(frames: DataFrame, window: int = 8) -> DataFrame:
    """Findings of frames (KEYS, arrival, seq, reset_count, send_ts, payload), each key in order of arrival. Rows stream past
    the state machine, so that Python's memory is that of a batch."""
    f = frames.select(*KEYS, *_IN).withColumn("channel_id", F.col("channel_id").cast("bigint"))
    return f.repartition(*KEYS).sortWithinPartitions(*KEYS, "arrival").mapInArrow(lambda batches: _replayed(batches, window), FINDINGS)


def replay_stream(frames: DataFrame, window: int = 8) -> DataFrame:
    """The same as a stream in append mode; what is in the buffer waits for later frames. State survives restarts."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = Sequencer(window, json.loads(state.get[0]) if state.exists else None)
        pdf = pd.concat(list(batches))
        found = _feed(s, pdf)
        state.update((json.dumps(s.state()),))
        yield _rows(key, found)

    return frames.groupBy(*KEYS).applyInPandasWithState(run, FINDINGS, _STATE, "append", GroupStateTimeout.NoTimeout)


def dedupe_intents(intents: DataFrame, delay: str = "10 minutes", time: str = "event_time") -> DataFrame:
    """Order intents seen by several hosts, once each within the delay."""
    return intents.withWatermark(time, delay).dropDuplicatesWithinWatermark(["source", "action_tag", "batch_index", "signer"])


def count_stream(findings: DataFrame) -> DataFrame:
    """Running counts by rule and status, for update mode."""
    return findings.groupBy("rule_id", "status").count()
