"""Speech, overlaps and turns as queries over a table of frames.

A kernel makes the table, one row for each frame of a file, from Arrow batches of waveforms. All that decides is in
windows and grouped percentiles over it, partitioned by file: thresholds, on and off states, runs, segments. A file's frames are one group, so memory
follows the longest file and work the number of files; times are in frames until the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators import ordered as O

from . import spectral

# What activity and overlap scores are made of has to be the same wherever they are compared.
EPS = 1e-10
#: dB below a file's loudest frame at which levels end.
RANGE_DB = 80.0
ACTIVITY = {"percentile": 35, "over_db": 3, "floor_percentile": 10, "floor_db": 1.0, "drop_db": 1.5, "local_share": 0.7}
WEIGHTS = {"rich": 1.3, "flat": 1.0, "spread": 1.0, "crest": -0.8}
LEAST_SCORE = 0.8

Kernel = Callable[[np.ndarray], dict[str, np.ndarray]]


def rms_of(size: int, hop: int) -> Kernel:
    """Root mean square of centred frames."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        x = np.pad(x, size // 2)
        first = np.arange(0, max(0, len(x) - size + 1), hop)
        sums = np.concatenate([[0.0], np.cumsum(x * x)])
        return {"rms": np.sqrt(np.maximum(sums[first + size] - sums[first], 0) / size)}

    return run


def shape_of(rate: int, size: int, hop: int, top_hz: float = 3400) -> Kernel:
    """What a frame's spectrum up to top_hz looks like: rich, flat, spread, crest. A waveform shorter than a frame has none."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        hz = np.fft.rfftfreq(size, 1 / rate)
        low = hz <= min(top_hz, rate / 2)
        return spectral.shape(spectral.stft(x if len(x) >= size else x[:0], size, hop)[:, low], hz[low])

    return run


def table(files: DataFrame, key: str, wave: str, kernel: Kernel, columns: Sequence[str]) -> DataFrame:
    """key, frame (from 0) and the kernel's columns (doubles) of every file; one without a waveform has no rows."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, x in zip(batch.column(0), batch.column(1), strict=True):
                x = np.array(x.values if x.is_valid else [], float)
                found = kernel(x) if len(x) and np.isfinite(x).all() else {}
                n = len(found[columns[0]]) if found else 0
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n, name.type), pa.array(np.arange(n), pa.int32()), *(pa.array(np.asarray(found[c], float), pa.float64()) for c in columns)], names=[key, "frame", *columns])

    rows = files.select(key, F.col(wave).cast("array<double>").alias(wave))
    return rows.mapInArrow(run, f"`{key}` {kind}, frame int, {', '.join(f'{c} double' for c in columns)}")


def moving_mean(value: str | Column, size: int, key: str) -> Column:
    """Mean over size frames about each, a file's ends repeated; an even window leans to the left."""
    v = F.col(value) if isinstance(value, str) else value
    left, right = size // 2, size - 1 - size // 2
    whole = Window.partitionBy(key).orderBy("frame")
    ends = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(F.lit(left) - F.col("frame"), F.lit(0))
    after = F.greatest(F.col("frame") + right - F.max("frame").over(ends), F.lit(0))
    return (F.sum(v).over(whole.rowsBetween(-left, right)) + before * F.first(v).over(ends) + after * F.last(v).over(ends)) / size


def active(frames: DataFrame, key: str, *, least: int, smooth: int, local: int, percentile: float = ACTIVITY["percentile"], over_db: float = ACTIVITY["over_db"], floor_percentile: float = ACTIVITY["floor_percentile"], floor_db: float = ACTIVITY["floor_db"], drop_db: float = ACTIVITY["drop_db"], local_share: float = ACTIVITY["local_share"]) -> DataFrame:
    """The frames (key, frame, rms) with whether somebody speaks, as active (0 or 1).

    A frame's threshold mixes one of the file (a percentile) and one about it (a moving mean over ``local`` frames), neither under the noise floor; a frame that
    reaches it turns speech on, one under it by drop_db off; runs under ``least`` frames go; the majority of ``smooth`` frames decides.
    """
    file = Window.partitionBy(key)
    x = frames.withColumn("db", 20 * F.log10(F.col("rms") + EPS))
    x = x.withColumn("db", F.col("db") - F.max("db").over(file)).withColumn("db", F.greatest("db", F.lit(-RANGE_DB)))
    levels = F.percentile("db", F.array(F.lit(floor_percentile / 100), F.lit(percentile / 100))).over(file)
    x = x.withColumn("__p", levels).withColumn("__local", moving_mean("db", local, key))
    floor = F.col("__p")[0] + floor_db
    on = (1 - local_share) * F.greatest(F.col("__p")[1] + over_db, floor) + local_share * F.greatest(F.col("__local") + over_db, floor)
    x = O.hysteresis(x.withColumn("__on", on), "db", on=F.col("__on"), off=F.col("__on") - drop_db, keys=[key], order=["frame"], name="__state")
    x = O.enforce_min_run(x, "__state", least, keys=[key], order=["frame"], name="__kept")
    return x.withColumn("active", (2 * moving_mean("__kept", smooth, key) >= 1).cast("int")).drop("__p", "__local", "__on", "__state", "__kept")


def segments(frames: DataFrame, flag: Column, key: str, second: float) -> DataFrame:
    """key, start and end in seconds of the runs of frames with a flag; second: a frame's length."""
    runs = O.run_ids(frames, flag, keys=[key], order=["frame"], name="__run").where("__run > 0")
    return runs.groupBy(key, "__run").agg((F.min("frame") * F.lit(second)).alias("start"), ((F.max("frame") + 1) * F.lit(second)).alias("end")).drop("__run")


def within(second: float) -> Column:
    """The frames that a segment touches, one at least."""
    first = F.floor(F.col("start") / second + 1e-9)
    return F.sequence(first, F.greatest(F.ceil(F.col("end") / second - 1e-9) - 1, first)).cast("array<int>")


def joined(spans: DataFrame, key: str, gap: float = 0.0) -> DataFrame:
    return O.merge_by_gap(spans, "start", "end", keys=[key], gap=gap).drop("n")


def padded(spans: DataFrame, key: str, by: float, end: Column | None = None) -> DataFrame:
    """Longer by so much at both ends, but within the file, and joined where they meet. end: the file's, in seconds."""
    to = F.col("end") + by
    return joined(spans.select(key, F.greatest(F.col("start") - by, F.lit(0.0)).alias("start"), (to if end is None else F.least(to, end)).alias("end")), key)


def tidy(spans: DataFrame, key: str, *, gap: float, least: float) -> DataFrame:
    """Joined over gaps, without what is short."""
    return joined(spans, key, gap).where(F.col("end") - F.col("start") >= least)


def spoken(frames: DataFrame, speech: DataFrame, key: str, second: float) -> DataFrame:
    """The frames with whether they are in speech (key, start, end), as spoken."""
    inside = speech.select(key, F.explode(within(second)).alias("frame")).distinct()
    return frames.join(inside.withColumn("spoken", F.lit(True)), [key, "frame"], "left").withColumn("spoken", F.coalesce("spoken", F.lit(False)))


def overlap_scores(frames: DataFrame, key: str, smooth: int) -> DataFrame:
    """The frames (key, frame, the columns of shape_of, spoken) with a score of how much they sound like more than one voice: weighted robust distances from the file's median, 0 outside speech, smoothed."""
    file = Window.partitionBy(key)
    x = frames
    for c in WEIGHTS:
        x = x.withColumn(f"__q_{c}", F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(file)).withColumn(f"__s_{c}", F.stddev_pop(c).over(file))

    def far(c: str) -> Column:
        q = F.col(f"__q_{c}")
        return (F.col(c) - q[1]) / (F.when(q[2] - q[0] >= 1e-8, q[2] - q[0]).otherwise(F.col(f"__s_{c}") + 1e-8) + 1e-8)

    total = sum((F.lit(w) * far(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    x = x.withColumn("__raw", F.when(F.col("spoken"), total).otherwise(0.0))
    return x.withColumn("score", moving_mean("__raw", smooth, key)).select(*frames.columns, "score")


def overlaps(frames: DataFrame, key: str, *, second: float, smooth: int, least: int, gap: float, pad: float, quartiles: float = 2.0, least_score: float = LEAST_SCORE, by: str = "p95") -> DataFrame:
    """key, rank, start, end, duration, mean, p95, max: segments whose score passes the median of the file's speech by quartile ranges, the strongest first."""
    x = overlap_scores(frames, key, smooth)
    own = F.when(F.col("spoken"), F.col("score"))
    x = x.withColumn("__q", F.percentile(own, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(Window.partitionBy(key)))
    cut = F.greatest(F.lit(least_score), F.col("__q")[1] + quartiles * F.greatest(F.col("__q")[2] - F.col("__q")[0], F.lit(1e-6)))
    x = x.withColumn("__strong", F.coalesce((F.col("score") >= cut).cast("int"), F.lit(0)))
    x = O.enforce_min_run(x, "__strong", least, keys=[key], order=["frame"], name="__kept")
    ends = x.groupBy(key).agg(((F.max("frame") + 1) * F.lit(second)).alias("__end"))
    spans = joined(segments(x, F.col("__kept") == 1, key, second), key, gap).join(ends, key)
    spans = spans.select(key, F.greatest(F.col("start") - pad, F.lit(0.0)).alias("start"), F.least(F.col("end") + pad, F.col("__end")).alias("end"))
    found = joined(spans, key).select(key, "start", "end", F.explode(within(second)).alias("frame"))
    rated = found.join(x.select(key, "frame", "score"), [key, "frame"]).groupBy(key, "start", "end").agg(F.avg("score").alias("mean"), F.percentile("score", F.lit(0.95)).alias("p95"), F.max("score").alias("max"))
    rated = rated.withColumn("duration", F.col("end") - F.col("start"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), "start"))
    return rated.select(key, rank.alias("rank"), "start", "end", "duration", "mean", "p95", "max")


def steady_labels(rows: DataFrame, label: str, odd: Column, *, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """A change of label that is odd is none: the row has the label before it. The first and last rows stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = rows.withColumn("__before", F.lag(label).over(w)).withColumn("__after", F.lead(label).over(w))
    changed = (F.col(label) != F.col("__before")) & F.col("__after").isNotNull()
    return x.withColumn(name, F.when(changed & odd, F.col("__before")).otherwise(F.col(label))).drop("__before")


def turns(frames: DataFrame, label: str, key: str, second: float) -> DataFrame:
    """key, turn (from 0), start, end, label: runs of one label."""
    w = Window.partitionBy(key).orderBy("frame")
    x = O.change_ids(frames, F.col(label) != F.lag(label).over(w), keys=[key], order=["frame"], name="turn")
    return x.groupBy(key, "turn", label).agg((F.min("frame") * F.lit(second)).alias("start"), ((F.max("frame") + 1) * F.lit(second)).alias("end"))
