"""Track fusion over recordings, and what is read from its frames.

Fusion is a recurrence over a run's events.  A run is split where the recurrence provably
starts afresh: at run resets, and where no detection came for so long that every track has
expired.  Segments are folded in parallel; only track ids have to be shifted afterwards by the
number of tracks created before.  The result equals the fold over the whole run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sonde import schemas
from sonde.functions.trackbook import FusionSettings, TrackBook
from sonde.plans.ordered import BLOCK_ROWS, carry, row_blocks
from sonde.session import scratch_dir

TRAIL_POINTS = 32  # fixed value: length of a displayed trail
SAMPLED = ("track_id", "state", "x", "y", "vx", "vy", "last_seen", "observations")
GIVE = 100_000      # tracks of frames given out at once
_INPUT = ("run_id", "run_generation", "segment", "stream_sequence", "event_time_seconds", "event_type", "sensor_id",
          "sensor_generation", "scan_sequence", "measurements")
_SEGMENT = ("run_id", "run_generation", "segment")


def _fold_schema(run_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("run_id", run_type), T.StructField("run_generation", T.LongType()),
        T.StructField("segment", T.LongType()), T.StructField("source_sequence", T.LongType()),
        T.StructField("acquisition_time", T.DoubleType()), T.StructField("source_type", T.StringType()),
        T.StructField("opens", T.BooleanType()), T.StructField("created", T.LongType()),
        T.StructField("tracks", T.ArrayType(schemas.TRACK)),
        T.StructField("associations", T.ArrayType(schemas.ASSOCIATION)),
        T.StructField("retired", T.ArrayType(schemas.RETIRED)), T.StructField("left", T.ArrayType(T.LongType()))])


def segment_events(events: DataFrame, settings: FusionSettings, block_rows: int = BLOCK_ROWS, least: int = 1) -> DataFrame:
    """(run_id, run_generation, stream_sequence, segment): quiet-gap segments per generation, numbered in order.

    Segments that start within the same `least` sequence numbers are one, so that short stretches cost no fold each.
    """
    key = ["run_id", "run_generation"]
    time = F.col("event_time_seconds").cast("double")
    narrow = events.select(
        *key, "stream_sequence", time.alias("t"),
        F.when(F.size("measurements") > 0, time).alias("detected"))
    block = row_blocks("stream_sequence", block_rows)
    seen = carry(narrow, key, ["stream_sequence"], block, prior_max={"last_detection": F.col("detected")},
                 lags={"previous_t": F.col("t"), "previous": F.col("stream_sequence")})
    quiet = F.lit(float(settings.quiet_after))
    breaks = ((F.col("t") - F.col("last_detection") >= quiet)
              & (F.col("previous_t") - F.col("last_detection") < quiet))
    starts = F.when(breaks | F.col("previous").isNull(), row_blocks("stream_sequence", least))
    marked = seen.select(*key, "stream_sequence", starts.alias("starts"))
    placed = carry(marked, key, ["stream_sequence"], block, prior_max={"earlier": F.col("starts")})
    return placed.select(*key, "stream_sequence", F.greatest("starts", "earlier").alias("segment"))


class _FrameColumns:
    """Frames of consecutive events, as flat columns.

    A track changes only when a detection is assigned to it.  Each state is kept once; a frame names the states of
    its tracks, and where they stand at its time is computed for all frames at once.
    """

    def __init__(self, book: TrackBook | None):
        self.states, self.shown, self.live, self.opens, self.created = [], [], [], [], []
        self.assigned, self.retired, self.gone = [], [], []
        if book is not None:
            self._keep(book, book.live)

    def _keep(self, book: TrackBook, ids) -> None:
        for i in ids:
            t = book.live[i]
            t.version = len(self.states)
            self.states.append((i, t.x, t.y, t.vx, t.vy, t.seen, t.hits, t.times, sorted(t.sensors)))

    def add(self, opens: bool, book: TrackBook, retired: list[tuple[int, str]], assigned: list[int]) -> None:
        self._keep(book, assigned)
        self.shown += [t.version for t in book.live.values()]
        self.live.append(len(book.live))
        self.opens.append(opens)
        self.created.append(book.created)
        self.assigned += assigned
        self.retired += retired
        self.gone.append(len(retired))

    def _tracks(self, times: np.ndarray, settings: FusionSettings, kind: pa.DataType) -> pa.Array:
        i, x, y, vx, vy, seen, hits, seen_times, sensors = list(zip(*self.states)) or [()] * 9
        at = np.array(self.shown, np.int64)
        take = lambda values, dtype: np.array(values, dtype)[at]
        vx, vy, seen, seen_times = take(vx, float), take(vy, float), take(seen, float), take(seen_times, np.int64)
        ahead = np.repeat(times, self.live) - seen
        state = np.where(seen_times < settings.confirmation_times, 0, np.where(ahead > settings.coast_after, 1, 2))
        return _rows(self.live, [
            take(i, np.int64), pa.array(["tentative", "coasting", "confirmed"]).take(pa.array(state)), take(x, float) + vx * ahead,
            take(y, float) + vy * ahead, vx, vy, seen, take(hits, np.int64), seen_times,
            pa.array(sensors, kind.value_type.field("sensors").type).take(pa.array(at))], kind)

    def batch(self, events: pa.RecordBatch, settings: FusionSettings, schema: pa.Schema) -> pa.RecordBatch:
        """With the columns of the events that the frames belong to."""
        counts, (detections, *_) = _detections(events)
        at = pa.array(np.repeat(np.arange(events.num_rows), counts))
        times = _typed(events["event_time_seconds"], pa.float64())
        return _batch({
            **{c: events[c] for c in _SEGMENT}, "source_sequence": events["stream_sequence"], "acquisition_time": times,
            "source_type": events["event_type"], "opens": self.opens, "created": self.created,
            "tracks": self._tracks(times.to_numpy(), settings, schema.field("tracks").type),
            "associations": _rows(counts, [*(events[c].take(at) for c in ("sensor_id", "sensor_generation", "scan_sequence")), detections,
                                           self.assigned], schema.field("associations").type),
            "retired": _rows(self.gone, list(zip(*self.retired)) or [(), ()], schema.field("retired").type)}, events.num_rows, schema)


def _typed(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def _batch(columns: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [_typed(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _lists(sizes, values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values, type=kind)


def _rows(sizes, columns: list, kind: pa.DataType) -> pa.Array:
    """Lists of rows from their flat columns."""
    row = kind.value_type
    fields = [row.field(i) for i in range(row.num_fields)]
    return _lists(sizes, pa.StructArray.from_arrays([_typed(c, f.type) for c, f in zip(columns, fields)], fields=fields), kind)


def _detections(events: pa.RecordBatch) -> tuple[np.ndarray, tuple[pa.Array, pa.Array, pa.Array]]:
    """How many detections each event has, and their flat ids and coordinates."""
    lists = events["measurements"]
    rows = lists.flatten()
    flat = dict(zip((rows.type.field(i).name for i in range(rows.type.num_fields)), rows.flatten()))
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return counts, (flat["detection_id"], flat["x"], flat["y"])


def _opens(rows: pa.RecordBatch, keys: tuple[str, ...], before: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row's key differs from that of the row ahead of it; null keys are equal."""
    out = np.zeros(rows.num_rows, bool)
    out[0] = before is None
    for k in keys:
        now = rows[k]
        ahead = pa.concat_arrays([now[:1] if before is None else before[k], now[:-1]])
        differ = pc.or_(pc.fill_null(pc.not_equal(ahead, now), False), pc.xor(ahead.is_null(), now.is_null()))
        out |= differ.to_numpy(zero_copy_only=False)
    return out


def _fold(events: DataFrame, settings: FusionSettings, keys: tuple[str, ...]) -> DataFrame:
    """Frames of each group, and one row with the group's last state; a task streams its groups one after the other."""
    schema = _fold_schema(events.schema["run_id"].dataType)
    arrow = to_arrow_schema(schema)

    def tails(rows: pa.RecordBatch, books: list[TrackBook]) -> pa.RecordBatch:
        return _batch({**{k: rows[k] for k in _SEGMENT}, "created": [b.created for b in books], "left": [list(b.live) for b in books]},
                      rows.num_rows, arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = before = None
        for events in batches:
            if not events.num_rows:
                continue
            opens = _opens(events, keys, before)
            if opens[0] and before is not None:
                yield tails(before, [book])
            counts, flat = _detections(events)
            stop = np.cumsum(counts)
            ids, xs, ys = (c.to_pylist() for c in flat)
            points = list(zip(ids, map(float, xs), map(float, ys)))
            frames, done, last, books = _FrameColumns(book), 0, [], []
            for n, (first, kind, time, sensor, a, b) in enumerate(zip(
                    opens.tolist(), events["event_type"].to_pylist(), map(float, events["event_time_seconds"].to_pylist()),
                    events["sensor_id"].to_pylist(), (stop - counts).tolist(), stop.tolist())):
                if first:
                    if n:
                        last.append(n - 1)
                        books.append(book)
                    book = TrackBook(settings)
                frames.add(first, book, *book.step(kind, time, sensor, points[a:b]))
                if len(frames.shown) >= GIVE:
                    yield frames.batch(events.slice(done, n + 1 - done), settings, arrow)
                    frames, done = _FrameColumns(book), n + 1
            if done < events.num_rows:
                yield frames.batch(events.slice(done), settings, arrow)
            if last:
                yield tails(events.take(pa.array(last)), books)
            before = events.slice(events.num_rows - 1)
        if before is not None:
            yield tails(before, [book])

    # A fixed number of tasks: merging them by size would leave a costly fold on few cores.
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = events.select(*_INPUT).repartition(tasks, *keys).sortWithinPartitions(*keys, "stream_sequence")
    return ordered.mapInArrow(fold, schema)


def fuse_tracks(events: DataFrame, settings: FusionSettings | None = None, *, split: bool = True,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Frames (schemas.FRAMES): the active tracks after every event of every run.

    events: typed events with `measurements`, in the order of `stream_sequence`.
    With `split`, segments are folded in parallel and stored once in the shared scratch folder
    (an action).  Without it each run is one lazy fold: fine for many runs of moderate length.
    """
    settings = settings or FusionSettings()
    if not split:
        whole = _fold(events.withColumn("segment", F.lit(0).cast("bigint")), settings, ("run_id",))
        return _as_frames(whole.filter(F.col("left").isNull()), settings)
    segments = segment_events(events, settings, block_rows, max(1, block_rows // 16))
    placed = events.join(segments, ["run_id", "run_generation", "stream_sequence"])
    path = scratch_dir(events.sparkSession, "fusion")
    _fold(placed, settings, _SEGMENT).write.parquet(path)
    folded = events.sparkSession.read.schema(_fold_schema(events.schema["run_id"].dataType)).parquet(path)

    tails = folded.filter(F.col("left").isNotNull()).select(*_SEGMENT, "created", "left")
    block = F.col("run_generation") * F.lit(1 << 31) + F.expr(f"segment div {block_rows}")
    shifts = carry(
        tails, ["run_id"], ["run_generation", "segment"], block, sums={"upto": F.col("created")},
        lags={"left_before": F.col("left"), "created_before": F.col("created")},
    ).select(
        *_SEGMENT, (F.col("upto") - F.col("created")).alias("shift"), "left_before",
        (F.col("upto") - F.col("created") - F.col("created_before")).alias("shift_before"))
    # Most segments open their run and move nothing; the rest is stored, so that its size is known when it is joined.
    moving = scratch_dir(events.sparkSession, "fusion-shifts")
    shifts.filter((F.col("shift") > 0) | (F.size("left_before") > 0)).write.parquet(moving)
    shifts = events.sparkSession.read.schema(shifts.schema).parquet(moving)
    frames = folded.filter(F.col("left").isNull()).join(shifts, list(_SEGMENT), "left")
    ahead = F.coalesce("shift", F.lit(0))
    moved = lambda array: F.when(ahead == 0, array).otherwise(
        F.transform(array, lambda r: r.withField("track_id", r["track_id"] + ahead)))
    reason = F.when(F.col("source_type") == "RUN_RESET", "run_reset").otherwise("timeout")
    expired = F.transform(
        F.coalesce("left_before", F.array()),
        lambda i: F.struct((i + F.col("shift_before")).alias("track_id"), reason.alias("reason")))
    retired = moved(F.col("retired"))
    return _as_frames(frames.select(
        "run_id", "run_generation", "source_sequence", "acquisition_time", "source_type",
        moved(F.col("tracks")).alias("tracks"), moved(F.col("associations")).alias("associations"),
        F.when(F.col("opens"), F.concat(expired, retired)).otherwise(retired).alias("retired")), settings)


def _as_frames(df: DataFrame, settings: FusionSettings) -> DataFrame:
    config = F.struct(*(
        F.lit(getattr(settings, f.name)).cast(f.dataType).alias(f.name) for f in schemas.FUSION_CONFIG.fields))
    return df.select(
        F.lit(1).alias("schema_version"), F.lit("GLOBAL_TRACKS").alias("event_type"), "run_id", "run_generation",
        "source_sequence", "acquisition_time", "source_type",
        F.when(F.col("source_type") == "RUN_STARTED", config).alias("config"), "tracks", "associations", "retired")


def fusion_config(frames: DataFrame) -> DataFrame:
    """(run_id, fusion_config): the settings a run was fused with, as sorted-key JSON."""
    names = sorted(f.name for f in schemas.FUSION_CONFIG.fields)
    return frames.filter(F.col("config").isNotNull()).select(
        "run_id", F.to_json(F.struct(*(F.col(f"config.{n}") for n in names))).alias("fusion_config"))


def track_samples(frames: DataFrame, columns: Sequence[str] = SAMPLED) -> DataFrame:
    """One row per track in the last frame (of any kind) at each acquisition time, with `columns` of the track."""
    tracks = F.arrays_zip(*(F.col(f"tracks.{c}") for c in (*columns, "sensors")))
    last = frames.select("run_id", "run_generation", "acquisition_time", "source_sequence", tracks.alias("tracks")).groupBy(
        "run_id", "run_generation", "acquisition_time").agg(
        F.max_by(F.struct("source_sequence", "tracks"), "source_sequence").alias("f"))
    return last.select(
        "run_id", "run_generation", F.col("f.source_sequence").alias("source_sequence"), "acquisition_time",
        F.inline("f.tracks")).withColumn("sensor_count", F.size("sensors")).drop("sensors")


def associations(frames: DataFrame) -> DataFrame:
    return frames.select("run_id", "run_generation", "source_sequence", "acquisition_time", F.inline("associations"))


def retirements(frames: DataFrame) -> DataFrame:
    return frames.select("run_id", "run_generation", "source_sequence", "acquisition_time", F.inline("retired"))


def track_trails(frames: DataFrame, as_of: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Last 32 positions, without consecutive repeats, of the tracks alive after frame `as_of`.

    `age` is 1 for the newest point.  The rank filter is pushed below the shuffle, so a
    long-lived track sends at most 32 rows per task.
    """
    if as_of is not None:
        frames = frames.filter(F.col("source_sequence") <= as_of)
    points = frames.select("run_id", "source_sequence", F.explode("tracks").alias("t")).select(
        "run_id", F.col("t.track_id").alias("track_id"), "source_sequence", F.col("t.x").alias("x"), F.col("t.y").alias("y"))
    before = carry(points, ["run_id", "track_id"], ["source_sequence"], row_blocks("source_sequence", block_rows),
                   lags={"previous": F.struct("x", "y")})
    changed = before.filter(
        F.col("previous").isNull() | (F.col("previous.x") != F.col("x")) | (F.col("previous.y") != F.col("y")))
    live = frames.groupBy("run_id").agg(F.max_by("tracks", "source_sequence").alias("tracks")).select(
        "run_id", F.explode("tracks.track_id").alias("track_id"))
    newest = Window.partitionBy("run_id", "track_id").orderBy(F.col("source_sequence").desc())
    return changed.join(live, ["run_id", "track_id"], "left_semi").withColumn(
        "age", F.row_number().over(newest)).filter(F.col("age") <= TRAIL_POINTS).drop("previous")


def playback_timeline(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Events with `due_seconds`, the playback time; a reset adds nothing."""
    block = row_blocks("stream_sequence", block_rows)
    lagged = carry(events, ["run_id"], ["stream_sequence"], block, lags={
        "previous_time": F.col("event_time_seconds"), "previous_generation": F.col("run_generation")})
    step = F.when(F.col("previous_generation") == F.col("run_generation"),
                  (F.col("event_time_seconds") - F.col("previous_time")).cast("double"))
    stepped = lagged.withColumn("step", F.coalesce(step, F.lit(0.0))).drop("previous_time", "previous_generation")
    return carry(stepped, ["run_id"], ["stream_sequence"], block, sums={"due_seconds": F.col("step")}).drop("step")


def due_by(timeline: DataFrame, seconds: float) -> DataFrame:
    """The prefix of each run delivered by `seconds` of playback."""
    if not seconds >= 0:
        raise ValueError("playback time must be finite and not negative")
    return timeline.filter(F.col("due_seconds") <= seconds)


def sensor_state(events: DataFrame, as_of: int | None = None) -> DataFrame:
    """Per sensor of the current run generation: its generation, counters and latest scan.

    The state after the event with sequence `as_of` (default: the last).  A run reset clears
    all sensors; a sensor reset restarts that sensor's counters.
    """
    if as_of is not None:
        events = events.filter(F.col("stream_sequence") <= as_of)
    current = events.groupBy("run_id").agg(F.max("run_generation").alias("run_generation"))
    scan = F.col("event_type") == "MEASUREMENTS"
    per_life = events.filter(F.col("sensor_id").isNotNull()).groupBy(
        "run_id", "run_generation", "sensor_id", "sensor_generation").agg(
        F.count_if(scan).alias("scans"), F.coalesce(F.sum(F.when(scan, F.col("measurement_count"))), F.lit(0)).alias("measurements"),
        F.max_by(F.when(scan, F.col("measurements")), F.when(scan, F.col("stream_sequence"))).alias("latest"))
    lives = per_life.join(current, ["run_id", "run_generation"], "left_semi")
    return lives.groupBy("run_id", "run_generation", "sensor_id").agg(
        F.max_by(F.struct("sensor_generation", "scans", "measurements", "latest"), "sensor_generation").alias("s")).select(
        "run_id", "run_generation", "sensor_id", "s.*")
