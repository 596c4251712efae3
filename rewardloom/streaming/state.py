"""Stateful operators of the streams, on Spark's state store (RocksDB).

They are fed with what tasks have cut or summed before the shuffle, so a metric or run with a large part of all rows sends few
rows to the task that holds its state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State that is changed key by key needs a store that writes only what has changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Trends(StatefulProcessor):
    """The newest ``history`` values of a metric, one entry of a map each: a batch writes the new ones and removes those they
    push out. A metric that is silent for ``silent`` milliseconds of event time is forgotten."""

    def __init__(self, window: int, history: int, silent: int):
        self.window, self.history, self.silent = window, history, silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "step long, seq long", "value double")
        self.seen = handle.getValueState("seen", "n long, newest long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, newest = self.seen.get() if self.seen.exists() else (0, 0)
        held = {tuple(k): v[0] for k, v in self.values.iterator()}
        fresh = {}
        for part in rows:
            for step, value, ts in zip(part["step"].tolist(), part["value"].tolist(), part["ts"], strict=True):
                n += 1
                fresh[step, n] = value
                newest = max(newest, int(ts.timestamp() * 1000))
        order = sorted([*held, *fresh])
        kept = set(order[-self.history :])
        for k in held.keys() - kept:
            self.values.removeKey(k)
        for k, value in fresh.items():
            if k in kept:
                self.values.updateValue(k, (value,))
        self.seen.update((n, newest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest + self.silent)
        held.update(fresh)
        yield pd.DataFrame([self.trend(key[0], [held[k] for k in order[-self.history :]][-self.window :])])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.values.clear()
        self.seen.clear()
        yield pd.DataFrame([self.trend(key[0], [])])

    @staticmethod
    def trend(metric: str, values: list[float]) -> dict:
        known = np.array([v for v in values if v is not None and v == v])
        at = np.arange(len(values))[[v is not None and v == v for v in values]] if len(values) else known
        spread = at.var() if len(at) else 0.0
        slope = float(((at - at.mean()) * (known - known.mean())).mean() / spread) if spread else 0.0
        some = len(known) > 0
        return {
            "metric": metric, "mean": known.mean() if some else None, "median": float(np.median(known)) if some else None,
            "min": known.min() if some else None, "max": known.max() if some else None, "std": known.std() if some else None,
            "count": len(values), "trend": slope,
        }

    def close(self) -> None:
        pass


#: What a report sums over its samples.
SUMS = ("correct", "total", "seconds", "timed", "words", "outputs", "missing_reasoning_tag", "missing_answer_tag", "malformed_tags")


def merged(parts: list[tuple[list[float], list[dict]]], order: str, max_errors: int) -> tuple[list[float], list[dict]]:
    """Sums and first errors of several parts of a report."""
    sums = [sum(x) for x in zip(*[p[0] for p in parts], strict=True)]
    errors = sorted([e for p in parts for e in p[1]], key=lambda e: (e[order] is not None, e[order]))
    return sums, errors[:max_errors]


class Reports(StatefulProcessor):
    """Sums and first errors of the validation samples of a run, by the ``every`` steps they belong to.

    A boundary is closed when the run has a step behind it. Its report is given once then, and again, corrected, when samples
    come later still. A batch that closes none gives the last report closed before, as not ``fresh``.
    """

    def __init__(self, every: int, order: str, max_errors: int):
        self.every, self.order, self.max_errors = every, order, max_errors

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reports = handle.getMapState("reports", "boundary long", "sums string, errors string, given boolean")
        self.newest = handle.getValueState("newest", "step long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else -1
        parts: dict[int, list[tuple[list[float], list[dict]]]] = {}
        for part in rows:
            for row in part.to_dict("records"):
                newest = max(newest, int(row["newest"]))
                parts.setdefault(int(row["boundary"]), []).append((json.loads(row["sums"]), json.loads(row["errors"])))
        self.newest.update((newest,))
        held = {k[0]: v for k, v in self.reports.iterator()}
        out = []
        for boundary in sorted(held.keys() | parts.keys()):
            sums, errors, given = held.get(boundary, (None, None, False))
            changed = boundary in parts
            if changed:
                before = [(json.loads(sums), json.loads(errors))] if sums else []
                total, first = merged([*before, *parts[boundary]], self.order, self.max_errors)
                sums, errors = json.dumps(total), json.dumps(first)
            closed = newest >= boundary + self.every
            fresh = closed and (changed or not given)
            if changed or fresh:
                self.reports.updateValue((boundary,), (sums, errors, bool(given or closed)))
            if closed:
                out.append((boundary, fresh, sums, errors))
        given = [r for r in out if r[1]] or out[-1:]
        yield pd.DataFrame([{"key": key[0], "boundary": b, "fresh": f, "sums": s, "errors": e} for b, f, s, e in given],
                           columns=["key", "boundary", "fresh", "sums", "errors"])

    def close(self) -> None:
        pass
