"""Per-run state of live streams: which event may come next, which bucket is open, which identity is known.

Every processor is keyed by the run and reads a run's rows in the order of `arrival`, their position in the
source, so its answers depend on the source alone, not on how triggers cut it.  What it keeps is typed state:
only entries that changed are written.  A run closes on its own finish; nothing depends on other runs' clocks.
A micro-batch of one run is sorted in one worker, so the trigger's limit bounds it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sonde.functions.lifecycle import LifecycleState
from sonde.functions.trackbook import FusionSettings, Track, TrackBook, frame_of

GIVE = 10_000        # rows given out at once
BLOCK = 1_024        # identities of one state entry
SPAN = 16            # seconds of one state entry of buckets


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    found = list(rows)
    frame = found[0] if len(found) == 1 else pd.concat(found, ignore_index=True)
    if frame["arrival"].is_unique:      # nothing is left for the other columns to decide
        return frame.sort_values("arrival", kind="stable", ignore_index=True)
    return frame.sort_values([c for c in ("arrival", "stream_sequence", "body") if c in frame.columns], kind="stable", ignore_index=True)


class RunProcessor(StatefulProcessor):
    """Takes or refuses each event of a run; each gives one row, and each gap one more.

    strict   an event that is not the next one is refused, and the run goes on from where it was
    reorder  an event ahead of a gap waits.  The gap stands when the run's finish arrives (if it `closes`: where
             the order of arrival is not known, it says nothing of what is under way), when more than `reach`
             events wait, or after `timeout` milliseconds without events: then it is reported (rule `gap`, the
             first missing sequence and how many), every waiting and later event is refused, and the state goes

    A run that falls silent before its finish is reported once (rule `finished`).  With `settings` each accepted
    event yields its track frame, else the event itself.  Waiting events are held in memory while a run's rows are
    read, `reach` at most; the state gets those that still wait afterwards.
    """

    def __init__(self, policy: str, settings: FusionSettings | None, reach: int, timeout: int | None, closes: bool):
        self.policy, self.settings, self.reach, self.timeout, self.closes = policy, settings, reach, timeout, closes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "position long, generation long, time double, finished boolean, starting boolean,"
                                               "failed boolean, held long, created long, alarm long")
        self.sensors = handle.getMapState("sensors", "sensor int", "life long, scans long, detections long")
        self.waiting = handle.getMapState("waiting", "sequence long", "body string")
        self.tracks = handle.getMapState("tracks", "track long", "x double, y double, seen double, vx double, vy double,"
                                                                 "hits long, times long, sensors array<int>")

    def _load(self, key) -> None:
        self.key, self.out = key[0], []
        self.life, self.book = LifecycleState(), TrackBook(self.settings) if self.settings else None
        self.failed, self.held, self.alarm, self.waits = False, 0, 0, {}
        if self.run.exists():
            life = self.life
            (life.position, life.generation, life.time, life.finished, life.starting, self.failed, self.held, created,
             self.alarm) = self.run.get()
            life.run_id = int(self.key)
            life.sensors = {int(k[0]): tuple(v) for k, v in self.sensors.iterator()}
            if self.book:
                self.book.created = created
                found = sorted((int(k[0]), v) for k, v in self.tracks.iterator())
                self.book.live = {i: Track(*v[:7], sensors=set(v[7])) for i, v in found}
            if self.held:
                self.waits = {int(k[0]): v[0] for k, v in self.waiting.iterator()}
        self.stored = set(self.waits)
        self.known = dict(self.life.sensors), {i: _packed(t) for i, t in self.book.live.items()} if self.book else {}

    def _save(self, timers) -> None:
        life, book = self.life, self.book
        done = self.failed or life.finished
        if done:            # only the mark of a closed run is kept
            for state, held in ((self.sensors, self.known[0]), (self.waiting, self.stored), (self.tracks, self.known[1])):
                if held:
                    state.clear()
        else:
            live = {i: _packed(t) for i, t in book.live.items()} if book else {}
            for state, old, new in ((self.sensors, self.known[0], life.sensors), (self.tracks, self.known[1], live)):
                for k in old.keys() - new.keys():
                    state.removeKey((k,))
                for k, value in new.items():
                    if old.get(k) != value:
                        state.updateValue((k,), value)
            for k in self.stored - self.waits.keys():
                self.waiting.removeKey((k,))
            for k in self.waits.keys() - self.stored:
                self.waiting.updateValue((k,), (self.waits[k],))
        if self.timeout:
            if self.alarm:
                self.handle.deleteTimer(self.alarm)
            self.alarm = 0 if done else timers.getCurrentProcessingTimeInMs() + self.timeout
            if self.alarm:
                self.handle.registerTimer(self.alarm)
        self.run.update((life.position, life.generation, float(life.time), life.finished, life.starting, self.failed, self.held,
                         book.created if book else 0, self.alarm))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load(key)
        frame = in_order(rows)
        for sequence, body in zip(frame["stream_sequence"].tolist(), frame["body"].tolist()):
            self._arrive(sequence, body)
            if len(self.out) >= GIVE:
                yield self._given()
        self._save(timerValues)
        yield self._given()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load(key)
        self.alarm = 0      # it has gone off
        if self.held:
            self._fail()
        elif not (self.failed or self.life.finished):
            self.failed = True
            self._give(self.life.position + 1, "finished", None)
        self._save(timerValues)
        yield self._given()

    def _given(self) -> pd.DataFrame:
        out, self.out = self.out, []
        return pd.DataFrame(out, columns=["run_id", "stream_sequence", "rule", "missing", "body"]).astype({"missing": "Int64"})

    def _give(self, sequence, rule, body, missing=None) -> None:
        self.out.append((self.key, sequence, rule, missing, body))

    def _arrive(self, sequence: int, body: str) -> None:
        life = self.life
        if self.failed:
            self._give(sequence, "sequence_contiguous", body)
        elif self.policy == "strict" or sequence <= life.position + 1 or life.finished:
            self._take(sequence, body)
            while life.position + 1 in self.waits:
                at = life.position + 1
                body = self.waits.pop(at)
                self.held -= 1
                self._take(at, body)
                if life.position < at:      # refused: what waits behind it can never be next
                    return self._fail()
            if life.finished and self.held:
                self._release("nothing_after_finish")
        elif sequence in self.waits:
            self._give(sequence, "duplicate_event", body)
        else:
            self.waits[sequence] = body
            self.held += 1
            if self.held > self.reach or self.closes and json.loads(body)["event_type"] == "RUN_FINISHED":
                self._fail()

    def _take(self, sequence: int, body: str) -> None:
        event = json.loads(body)
        rule = self.life.problem(event)
        if rule is None:
            self.life.apply(event)
            if self.book:
                body = json.dumps({**frame_of(self.book, event), "run_generation": event["run_generation"]})
        self._give(sequence, rule, body)

    def _fail(self) -> None:
        """Reports each gap before a waiting event, refuses what waits, and closes the run."""
        self.failed, expected = True, self.life.position + 1
        for sequence in sorted(self.waits):
            if sequence > expected:
                self._give(expected, "gap", None, sequence - expected)
            expected = sequence + 1
        self._release("sequence_contiguous")

    def _release(self, rule: str) -> None:
        for k in sorted(self.waits):
            self._give(k, rule, self.waits[k])
        self.waits, self.held = {}, 0

    def close(self) -> None:
        pass


def _packed(t: Track) -> tuple:
    return t.x, t.y, t.seen, t.vx, t.vy, t.hits, t.times, sorted(t.sensors)


class BucketProcessor(StatefulProcessor):
    """One-second counts of a run's scans.

    A bucket closes on the run's finish, or with `delay` once the run's own clock (latest generation, latest time
    in it) is `delay` seconds past its end.  A scan of a closed bucket gives a row of its own, rule `late`.
    All open buckets of 16 seconds are one state entry; those that close with the rows that fill them never become state.
    """

    def __init__(self, delay: float | None):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "generation long, time double, finished boolean")
        self.buckets = handle.getMapState("buckets", "generation long, span long", "sensors array<int>, seconds array<long>,"
                                                                                   "scans array<long>, detections array<long>, empty array<long>")

    def _open(self, spans: set | None) -> dict[tuple[int, int], np.ndarray]:
        """Stored buckets by entry, as rows (generation, sensor, second, scans, detections, empty); of all entries if None."""
        if spans is None:
            found = [(tuple(k), v) for k, v in self.buckets.iterator()]
        else:
            found = [(k, v) for k in spans if (v := self.buckets.getValue(k)) is not None]
        return {k: np.column_stack([np.full(len(v[0]), k[0], np.int64), *(np.array(c, np.int64) for c in v)]) for k, v in found}

    def _store(self, old: dict[tuple[int, int], np.ndarray], rows: np.ndarray) -> None:
        """Only entries that changed are written."""
        new = {}
        span = np.column_stack([rows[:, 0], rows[:, 2] // SPAN])
        for g, at in set(map(tuple, span.tolist())):
            new[g, at] = rows[(span[:, 0] == g) & (span[:, 1] == at)]
        if old and not new:
            self.buckets.clear()
            return
        for k in old.keys() - new.keys():
            self.buckets.removeKey(k)
        for k, v in new.items():
            if not np.array_equal(old.get(k), v):
                self.buckets.updateValue(k, tuple(c.tolist() for c in v.T[1:]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = in_order(rows)
        known = self.run.get()
        generation, time, finished = known or (-1, 0.0, False)
        ends = np.flatnonzero(frame["event_type"].to_numpy() == "RUN_FINISHED")
        until = 0 if finished else int(ends[0]) if len(ends) else len(frame)
        frame["second"] = np.floor(frame["event_time_seconds"]).astype("int64")
        scan = (frame["event_type"] == "MEASUREMENTS").to_numpy()
        late = np.arange(len(frame)) >= until
        if self.delay is not None and until:      # a row is held against the clock before it
            clock = pd.DataFrame({"g": np.append(generation, frame["run_generation"][:until]), "t": np.append(time, frame["event_time_seconds"][:until])})
            clock["g"] = clock["g"].cummax()
            own = np.append(True, frame["run_generation"][:until].to_numpy() == clock["g"][1:].to_numpy())
            clock["t"] = clock["t"].where(own, -np.inf).groupby(clock["g"]).cummax()
            before, here = clock[:-1].reset_index(drop=True), frame[:until]
            late[:until] = (here["run_generation"] < before["g"]) | ((here["run_generation"] == before["g"]) & (here["second"] + 1 + self.delay <= before["t"]))
            generation, time = int(clock["g"].iloc[-1]), float(clock["t"].iloc[-1])
        closing = not finished and bool(len(ends))
        taken = frame[scan & ~late].dropna(subset=["run_generation", "sensor_id"])
        count = taken["measurement_count"].to_numpy()
        fresh = np.column_stack([*(taken[k].to_numpy().astype(np.int64) for k in ("run_generation", "sensor_id", "second")), np.ones(len(taken), np.int64),
                                 np.where(pd.isna(count), 0, count).astype(np.int64), count == 0])
        whole = closing or self.delay is not None
        old = {} if known is None or finished else self._open(None if whole else set(zip(fresh[:, 0].tolist(), (fresh[:, 2] // SPAN).tolist())))
        held = _summed(np.concatenate([*old.values(), fresh]))
        shut = np.full(len(held), closing)
        if self.delay is not None:
            shut |= (held[:, 0] < generation) | (held[:, 2] + 1 + self.delay <= time)
        self._store(old, held[~shut])
        self.run.update((generation, time, finished or closing))
        refused = frame[scan & late]
        out = [(key[0], *row, None) for row in held[shut].tolist()]
        out += [(key[0], g, s, second, 1, n, int(n == 0), "late") for g, s, second, n in
                zip(*(refused[c].tolist() for c in ("run_generation", "sensor_id", "second", "measurement_count")))]
        yield pd.DataFrame(out, columns=["run_id", "run_generation", "sensor_id", "second", "scans", "detections", "empty_scans", "rule"])

    def close(self) -> None:
        pass


def _summed(rows: np.ndarray) -> np.ndarray:
    """Counts of rows that agree in the first three columns, added up, in the order of these."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.append(0, np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1)
    return np.column_stack([rows[first, :3], np.add.reduceat(rows[:, 3:], first)])


class IdentityProcessor(StatefulProcessor):
    """The first event of each identity, by digests of the events known so far, 1,024 to a state entry.

    A repeat gives a row with rule `duplicate_event`, or `conflicting_duplicate` if its content is another.  When the
    finish and all events before it are there, the run closes and its digests go; what comes then is `late`.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "seen long, last long, finished boolean")
        self.blocks = handle.getMapState("blocks", "block long", "digests array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = in_order(rows)
        seen, last, finished = self.run.get() if self.run.exists() else (0, 0, False)
        rule = np.full(len(frame), None, object)
        if finished:
            rule[:] = "late"
        else:
            sequence, digest = frame["stream_sequence"].to_numpy(np.int64), frame["digest"].to_numpy(np.int64) | 1    # 0: not known
            for block in np.unique(sequence // BLOCK).tolist():
                here = np.flatnonzero(sequence // BLOCK == block)
                known = self.blocks.getValue((block,))[0] if self.blocks.containsKey((block,)) else [0] * BLOCK
                for i, at, d in zip(here.tolist(), (sequence[here] % BLOCK).tolist(), digest[here].tolist()):
                    if not known[at]:
                        known[at] = d
                    else:
                        rule[i] = "duplicate_event" if known[at] == d else "conflicting_duplicate"
                self.blocks.updateValue((block,), (known,))
            first = rule == None  # noqa: E711
            count = seen + np.cumsum(first)
            ends = np.flatnonzero((frame["event_type"] == "RUN_FINISHED").to_numpy() & first)
            since = 0 if last else int(ends[0]) if len(ends) else len(frame)
            last = last or (int(sequence[ends[0]]) if len(ends) else 0)
            full = np.flatnonzero(count[since:] >= last) if last else []
            seen = int(count[-1])
            finished = len(full) > 0
            if finished:
                rule[since + int(full[0]) + 1:] = "late"
                self.blocks.clear()
        self.run.update((seen, last, finished))
        yield pd.DataFrame({"run_id": frame["run_id"], "stream_sequence": frame["stream_sequence"], "rule": rule, "body": frame["body"]})

    def close(self) -> None:
        pass
