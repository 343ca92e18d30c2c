"""Keyed state of the passes of a project: a row for each document, not one for the project."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_OUT = ["project", "pass_no", "is_final", "document_id", "place", "n_indexed", "fired_at"]


@dataclass
class Rules:
    """When bursts fire and passes run."""

    cut: Callable
    quiet: float
    ceiling: float
    most_passes: int
    gate_documents: int
    gate_priority: int
    #: Seconds of event time for which a project that has ended still ignores what comes.
    keep: float


class Passes(StatefulProcessor):
    """State of a project: `pending`, the events of bursts still open; `known` and `unread`, a row for each document with its
    priority; `head`, its counters. A micro-batch writes the rows of the documents it brings or reads, however many are known.
    A timer waits for the end of the next burst. A project that ended keeps `head` alone, and nothing after `keep` seconds."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "seconds double, event_id long, document_id string, priority long")
        self.known = handle.getMapState("known", "document_id string", "priority long")
        self.unread = handle.getMapState("unread", "document_id string", "priority long")
        self.head = handle.getValueState("head", "runs long, n_known long, top long, ends_at double, over boolean, timer long")

    def _take(self, burst: list[tuple[float, int]], by_id: dict) -> None:
        for _, i in burst:
            document, priority = by_id[i]
            old = self.known.getValue((document,)) if self.known.containsKey((document,)) else None
            if old is None or priority > old[0]:
                self.known.updateValue((document,), (priority,))
                if old is None or self.unread.containsKey((document,)):
                    self.unread.updateValue((document,), (priority,))
            self.n_known += old is None
            self.top = max(self.top, priority)

    def _emit(self, key: tuple, documents: list[tuple[str, int]], final: bool, at: float) -> pd.DataFrame:
        self.runs += 1
        rows = [(key[0], self.runs, final, d, place, self.n_known, at) for place, (d, _) in enumerate(sorted(documents, key=lambda x: (-x[1], x[0])), 1)]
        return pd.DataFrame(rows, columns=_OUT)

    @staticmethod
    def _listed(state) -> list[tuple[str, int]]:
        return [(k[0], v[0]) for k, v in state.iterator()]

    def _step(self, key: tuple, frames: Iterator[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        rules = self.rules
        self.runs, self.n_known, self.top, ends_at, over, timer = self.head.get() if self.head.exists() else (0, 0, 0, None, False, None)
        if over:
            return
        fresh = []
        for pdf in frames:
            for s, i, d, p, end in pdf[["seconds", "event_id", "document_id", "priority", "complete"]].itertuples(index=False):
                if end:
                    ends_at = s if ends_at is None else min(s, ends_at)
                else:
                    fresh.append((float(s), int(i), d, int(p)))
        held = (list(map(tuple, self.pending.get())) if self.pending.exists() else []) + fresh
        by_id, passed, still = {i: (d, p) for _, i, d, p in held}, watermark / 1000, []
        for burst, due in rules.cut([(s, i) for s, i, _, _ in held if ends_at is None or s < ends_at], rules.quiet, rules.ceiling):
            if due > passed or ends_at is not None and due > ends_at:
                still += burst
                continue
            self._take(burst, by_id)
            if self.runs < rules.most_passes and (self.runs or self.n_known >= rules.gate_documents or self.top >= rules.gate_priority) and (new := self._listed(self.unread)):
                yield self._emit(key, new, False, due)
                self.unread.clear()
        if ends_at is not None and ends_at <= passed:
            self._take(still, by_id)
            if self.n_known:
                yield self._emit(key, self._listed(self.known), True, ends_at)
            over, still = True, []
            for state in (self.known, self.unread):
                state.clear()
        if len(still) < len(held):
            kept = {i for _, i in still}
            left = [h for h in held if h[1] in kept]
            self.pending.put(left) if left else self.pending.clear()
        elif fresh:
            self.pending.appendList(fresh)
        waits = [ends_at + rules.keep] if over else [due for _, due in rules.cut(still, rules.quiet, rules.ceiling) if due > passed] + ([ends_at] if ends_at is not None else [])
        wanted = max(math.ceil(min(waits) * 1000), watermark + 1) if waits else None
        if wanted != timer:
            if timer is not None and timer > watermark:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.head.update((self.runs, self.n_known, self.top, ends_at, over, wanted))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._step(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.head.exists() and self.head.get()[4]:
            self.head.clear()
            return
        yield from self._step(key, iter(()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass
