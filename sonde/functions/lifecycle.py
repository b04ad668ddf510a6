"""Lifecycle state of one run for streaming: which event may come next.

The batch rules find all violations of a stored recording; a live stream can only take or
refuse the next event.  A refused event leaves the state as it was.  Rule names are the batch ones.
"""

from __future__ import annotations

import math


class LifecycleState:
    def __init__(self, state: dict | None = None):
        s = state or {}
        self.run_id = s.get("run_id")
        self.position = s.get("position", 0)
        self.generation = s.get("generation", 0)
        self.time = s.get("time", 0.0)
        self.finished = s.get("finished", False)
        self.starting = s.get("starting", True)
        self.sensors = {int(k): tuple(v) for k, v in s.get("sensors", {}).items()}  # id -> (life, scans, detections)

    def problem(self, e: dict) -> str | None:
        """The rule the event would break, or None."""
        kind, time, sensor = e["event_type"], e["event_time_seconds"], e.get("sensor_id")
        if self.finished:
            return "nothing_after_finish"
        if (kind == "RUN_STARTED") != (self.position == 0):
            return "first_is_start"
        if self.position == 0 and (int(e["run_id"]) == 0 or e["run_generation"] != 0 or time != 0):
            return "first_is_start"
        if self.position and int(e["run_id"]) != self.run_id:
            return "single_run"
        if e["stream_sequence"] != self.position + 1:
            return "sequence_contiguous"
        if time is None or not math.isfinite(time) or time < 0:
            return "finite_nonnegative_time"
        if kind == "RUN_RESET":
            return None if e["run_generation"] == self.generation + 1 and time == 0 else "run_reset_transition"
        if e["run_generation"] != self.generation:
            return "generation_stable"
        if time < self.time:
            return "time_monotone"
        if kind == "SENSOR_STARTED":
            if not self.starting or time != 0 or e["sensor_generation"] != 0:
                return "sensor_start_window"
            return "sensor_start_order" if self.sensors and sensor <= max(self.sensors) else None
        if kind in ("SENSOR_RESET", "MEASUREMENTS"):
            if sensor not in self.sensors:
                return "known_sensor"
            life, scans, detections = self.sensors[sensor]
            if kind == "SENSOR_RESET":
                return None if e["sensor_generation"] == life + 1 else "sensor_reset_transition"
            if e["sensor_generation"] != life:
                return "scan_generation"
            if e["scan_sequence"] != scans + 1:
                return "scan_sequence_contiguous"
            found = e.get("measurements") or []
            if any(m["detection_id"] != detections + n for n, m in enumerate(found, 1)):
                return "detection_identity"
            if not all(_sound(m) for m in found):
                return "measurement_values"
        return None

    def apply(self, e: dict) -> None:
        kind, sensor = e["event_type"], e.get("sensor_id")
        if self.position == 0:
            self.run_id = int(e["run_id"])
        self.position += 1
        self.time = e["event_time_seconds"]
        if kind == "RUN_RESET":
            self.generation, self.sensors, self.starting = e["run_generation"], {}, True
        elif kind == "SENSOR_STARTED":
            self.sensors[sensor] = (0, 0, 0)
        elif kind == "SENSOR_RESET":
            self.sensors[sensor], self.starting = (e["sensor_generation"], 0, 0), False
        elif kind == "MEASUREMENTS":
            life, scans, detections = self.sensors[sensor]
            self.sensors[sensor] = (life, scans + 1, detections + len(e.get("measurements") or []))
            self.starting = False
        elif kind == "RUN_FINISHED":
            self.finished = True


def _sound(m: dict) -> bool:
    values = [m["x"], m["y"], m["confidence"], m["uncertainty_radius"]]
    if any(v is None or not math.isfinite(v) for v in values):
        return False
    return 0 <= m["confidence"] <= 1 and m["uncertainty_radius"] >= 0
