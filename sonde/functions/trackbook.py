"""The tracker's recurrence: live tracks of one run, advanced one event at a time.

Small, Spark-free state shared by the batch fold and the streaming processor.  A track's next
state depends on all earlier matches, so this part cannot be a Catalyst expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

SHORTEST_STEP = 0.05  # fixed value: smallest divisor, in seconds, of a velocity correction
TRACK_FIELDS = ("track_id", "state", "x", "y", "vx", "vy", "last_seen", "observations", "distinct_times", "sensors")


@dataclass(frozen=True)
class FusionSettings:
    # Default gate, gains and lifecycle times.
    gate: float = 20.0
    alpha: float = 0.8
    beta: float = 0.2
    coast_after: float = 0.5
    delete_after: float = 2.0
    tentative_timeout: float = 1.0
    confirmation_times: int = 2

    def __post_init__(self):
        if not all(math.isfinite(getattr(self, f.name)) for f in fields(self)):
            raise ValueError("fusion settings must be finite")
        sound = (0 < self.gate <= 1e9 and 0 < self.alpha <= 1 and 0 <= self.beta <= 1 and self.coast_after >= 0
                 and self.delete_after > self.coast_after and self.tentative_timeout > 0
                 and self.confirmation_times > 0)
        if not sound:
            raise ValueError("fusion gate, gains or lifecycle times out of range")

    @property
    def quiet_after(self) -> float:
        """With no detection for this long, no track of any kind is left."""
        return max(self.delete_after, self.tentative_timeout)


@dataclass(slots=True)
class Track:
    x: float
    y: float
    seen: float
    vx: float = 0.0
    vy: float = 0.0
    hits: int = 1
    times: int = 1
    sensors: set = field(default_factory=set)
    version: int = -1   # where a batch fold keeps its last state

    def at(self, time: float) -> tuple[float, float]:
        ahead = time - self.seen
        return self.x + self.vx * ahead, self.y + self.vy * ahead

    def correct(self, time: float, ox: float, oy: float, settings: FusionSettings) -> None:
        px, py = self.at(time)
        ahead = time - self.seen
        off_x, off_y = ox - px, oy - py
        self.x, self.y = px + settings.alpha * off_x, py + settings.alpha * off_y
        if ahead > 0:  # hits at one instant move the position only, and confirm nothing
            pull = settings.beta / max(ahead, SHORTEST_STEP)
            self.vx += pull * off_x
            self.vy += pull * off_y
            self.times += 1
        self.seen = time
        self.hits += 1


class TrackBook:
    def __init__(self, settings: FusionSettings, created: int = 0):
        self.settings = settings
        self.created = created
        self.live: dict[int, Track] = {}  # insertion order is id order

    def _retire(self, kind: str, time: float) -> list[tuple[int, str]]:
        live = self.live
        if kind == "RUN_RESET":
            reason, leaving = "run_reset", list(live)
        else:
            s = self.settings
            early, late, enough = s.tentative_timeout, s.delete_after, s.confirmation_times
            reason, leaving = "timeout", [i for i, t in live.items() if time - t.seen >= (early if t.times < enough else late)]
        for i in leaving:
            del live[i]
        return [(i, reason) for i in leaving]

    def _assign(self, time: float, points: list[tuple[int, float, float]]) -> dict[int, int]:
        """Point index -> track id, nearest pairs first, each side once."""
        gate, near = self.settings.gate, []
        numbered = [(n, *p) for n, p in enumerate(points)]
        for i, track in self.live.items():
            ahead = time - track.seen
            px, py = track.x + track.vx * ahead, track.y + track.vy * ahead
            for n, detection, ox, oy in numbered:
                off = px - ox
                if off > gate or off < -gate:   # farther than the gate along x alone
                    continue
                apart = math.hypot(off, py - oy)
                if apart <= gate:
                    near.append((apart, i, detection, n))
        chosen: dict[int, int] = {}
        busy = set()
        for _, i, _, n in sorted(near):
            if i not in busy and n not in chosen:
                chosen[n] = i
                busy.add(i)
        return chosen

    def step(self, kind: str, time: float, sensor_id=None, points=()) -> tuple[list[tuple[int, str]], list[int]]:
        """Apply one event; returns (id and reason of retired tracks, track id of each point)."""
        s = self.settings
        retired = self._retire(kind, time)
        assigned = []
        if points:
            chosen = self._assign(time, points) if self.live else {}
            for n, (_, ox, oy) in enumerate(points):
                if n in chosen:
                    i = chosen[n]
                    self.live[i].correct(time, ox, oy, s)
                else:
                    self.created += 1
                    i = self.created
                    self.live[i] = Track(ox, oy, time)
                self.live[i].sensors.add(sensor_id)
                assigned.append(i)
        return retired, assigned

    def snapshots(self, time: float) -> list[tuple]:
        """The live tracks as rows of `TRACK_FIELDS`."""
        s, out = self.settings, []
        for i, t in self.live.items():
            ahead = time - t.seen
            state = "tentative" if t.times < s.confirmation_times else "coasting" if ahead > s.coast_after else "confirmed"
            out.append((i, state, t.x + t.vx * ahead, t.y + t.vy * ahead, t.vx, t.vy, t.seen, t.hits, t.times, sorted(t.sensors)))
        return out


def frame_of(book: TrackBook, event: dict) -> dict:
    """Advance the book by a typed event row and describe the result as frame columns."""
    points = [(m["detection_id"], float(m["x"]), float(m["y"])) for m in event.get("measurements") or ()]
    time = float(event["event_time_seconds"])
    retired, assigned = book.step(event["event_type"], time, event.get("sensor_id"), points)
    associations = [
        {"sensor_id": event["sensor_id"], "sensor_generation": event["sensor_generation"],
         "scan_sequence": event["scan_sequence"], "detection_id": p[0], "track_id": i}
        for p, i in zip(points, assigned)]
    return {"acquisition_time": time, "source_type": event["event_type"],
            "tracks": [dict(zip(TRACK_FIELDS, t)) for t in book.snapshots(time)], "associations": associations,
            "retired": [{"track_id": i, "reason": reason} for i, reason in retired]}
