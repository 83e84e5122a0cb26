"""Keyframe selection from a stream of frames, with state for each stream; and its batch twin.

Frames gather in a window; when the camera has moved by the threshold since the last keyframe, too few
tracked points survive, or too much time has passed, the sharpest frame of the window is emitted. The
threshold adapts within bounds so that keyframes come at about the wanted pace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME = "stream string, frame_no bigint, t double, sharpness double, x double, y double, survival double"
KEYFRAME = "stream string, frame_no bigint, t double, reason string, threshold double"
STATE = "last_t double, last_x double, last_y double, threshold double, best_no bigint, best_t double, best_sharp double, best_x double, best_y double"


@dataclass
class Rules:
    threshold: float = 8.0
    low: float = 2.0
    high: float = 60.0
    survival: float = 0.45
    longest_s: float = 5.0
    pace_s: float = 3.0


START = (None, None, None, None, None, None, None, None, None)


def step(state: tuple, frame: tuple, rules: Rules) -> tuple[tuple, tuple | None]:
    """State after a frame (no, t, sharpness, x, y, survival), and the keyframe it gives, if any."""
    last_t, last_x, last_y, threshold, *best = state
    no, t, sharp, x, y, survival = frame
    threshold = rules.threshold if threshold is None else threshold
    if best[0] is None or sharp > best[2]:
        best = [no, t, sharp, x, y]
    if last_t is None:
        reason = "first"
    else:
        moved = ((x - last_x) ** 2 + (y - last_y) ** 2) ** 0.5
        reason = "moved" if moved >= threshold else "lost" if survival < rules.survival else "time" if t - last_t >= rules.longest_s else None
    if reason is None:
        return (last_t, last_x, last_y, threshold, *best), None
    if last_t is not None:
        threshold = min(rules.high, max(rules.low, threshold * (1.1 if best[1] - last_t < rules.pace_s else 0.9)))
    return (best[1], best[3], best[4], threshold, None, None, None, None, None), (best[0], best[1], reason, threshold)


COLUMNS = ["frame_no", "t", "sharpness", "x", "y", "survival"]


def select_stream(frames: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Keyframes of streaming frames in order of arrival; state is a dozen numbers for each stream."""
    rules = rules or Rules()

    def work(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(None if v is None or v != v else v for v in group.get) if group.exists else START
        rows = []
        for pdf in batches:
            for frame in pdf.sort_values(["t", "frame_no"])[COLUMNS].itertuples(index=False, name=None):
                state, out = step(state, frame, rules)
                if out:
                    rows.append((key[0], *out))
        group.update(state)
        yield pd.DataFrame(rows, columns=["stream", "frame_no", "t", "reason", "threshold"])

    return frames.groupBy("stream").applyInPandasWithState(work, KEYFRAME, STATE, "append", GroupStateTimeout.NoTimeout)


def select_batch(frames: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The same over a table. A stream is sequential by nature, so each runs in one task, but row by row
    with the same small state, never as a group in memory."""
    rules = rules or Rules()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state = None, START
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*columns):
                if row[0] != stream:
                    stream, state = row[0], START
                state, found = step(state, row[1:], rules)
                if found:
                    out.append((stream, *found))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.float64(), pa.string(), pa.float64()))], names=["stream", "frame_no", "t", "reason", "threshold"])

    ordered = frames.select("stream", *COLUMNS).repartition("stream").sortWithinPartitions("stream", "t", "frame_no")
    return ordered.mapInArrow(work, KEYFRAME)


def frames_of(frame_index: DataFrame) -> DataFrame:
    """Registered keyframe candidates as frames; the share of surviving points is not recorded, so 1."""
    f = frame_index.where("timestamp_sec IS NOT NULL AND pos_x IS NOT NULL AND blur_score IS NOT NULL")
    return f.select(F.col("survey_id").alias("stream"), F.col("frame_number").alias("frame_no"), F.col("timestamp_sec").alias("t"), F.col("blur_score").alias("sharpness"), F.col("pos_x").alias("x"), F.col("pos_z").alias("y"), F.lit(1.0).alias("survival")).distinct()
