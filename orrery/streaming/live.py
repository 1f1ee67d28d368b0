"""Live rules in batch and as keyed streaming state: ring buffers, rate limits, adaptive sampling.

Each rule is given twice. The batch form runs over a whole table; the streaming form keeps the state of each key and
gives the same rows, whatever the micro-batches are. Rows of a micro-batch are put in order of arrival first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.operators.folds import fold
from orrery.operators.sampling import interval, min_gap

RING = 64
MAX_FRAME_BYTES = 10 * 1024 * 1024
MAX_REQUESTS, WINDOW_SECONDS = 60, 60
#: Groups that the subjects of a rate limit's stream are dealt into.
BUCKETS = 1024
#: Seconds put before the times of a stream: watermarks begin at 0, and what isn't later counts as late.
ORIGIN = 1_000_000_000


def _verdict(max_bytes: int) -> Column:
    return F.when(F.col("payload_bytes") > max_bytes, "payload_too_large").when(~F.col("decodable"), "invalid_frame")


def decide(frames: DataFrame, ring: int = RING, max_bytes: int = MAX_FRAME_BYTES) -> DataFrame:
    """``frames`` (stream_id, arrival_seq, payload_bytes, decodable, …) with accepted, action, sequence, dropped_frames.

    Too large frames and such that can't be decoded are refused and take no number. Accepted ones push the oldest out
    once ``ring`` are held.
    """
    refused = _verdict(max_bytes)
    numbered = frames.withColumn("refused", refused).withColumn("upto", F.count_if(F.col("refused").isNull()).over(Window.partitionBy("stream_id").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, 0)))
    ok = F.col("refused").isNull()
    full = ok & (F.col("upto") > ring)
    return numbered.select(
        *[f"`{c}`" for c in frames.columns], ok.alias("accepted"), F.coalesce("refused", F.when(full, "drop_oldest").otherwise("accepted")).alias("action"),
        F.when(ok, F.col("upto") - 1).alias("sequence"), F.when(full, 1).otherwise(0).alias("dropped_frames"),
    )


def snapshot(decided: DataFrame, ring: int = RING) -> DataFrame:
    """The frames that each stream's ring holds at the end, with ``slot`` 0 (oldest) upwards; the last is the latest."""
    newest = Window.partitionBy("stream_id").orderBy(F.col("sequence").desc())
    held = decided.filter("accepted").withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= ring)
    return held.select("stream_id", "frame_id", "sequence", (F.count(F.lit(1)).over(Window.partitionBy("stream_id")) - F.col("back")).alias("slot"))


def dropped(decided: DataFrame, ring: int = RING) -> DataFrame:
    """(stream_id, accepted, dropped): accepted frames beyond the ring's size have pushed others out."""
    n = F.count_if(F.col("accepted"))
    return decided.groupBy("stream_id").agg(n.alias("accepted"), F.greatest(F.lit(0), n - ring).cast("long").alias("dropped"))


def allow(held: list, at, limit: int, window) -> tuple[bool, int]:
    """Whether a request at ``at`` is allowed and how many remain; ``held`` are the times that count, kept up to date."""
    held[:] = [t for t in held if at - t <= window]
    if len(held) >= limit:
        return False, 0
    held.append(at)
    return True, limit - len(held)


def rate_limit(requests: DataFrame, limit: int = MAX_REQUESTS, window: int = WINDOW_SECONDS) -> DataFrame:
    """``requests`` (subject, request_id, at) with allowed and remaining.

    A request is allowed if fewer than ``limit`` allowed ones lie in the window before it; one exactly ``window``
    seconds old still counts. Refused ones don't count. A subject's requests stream through in order, and its state is
    the at most ``limit`` times that count.
    """

    def step(held: list | None, row: tuple) -> tuple[list, tuple]:
        held = [] if held is None else held
        return held, (row[0], row[1], *allow(held, row[2], limit, window))

    narrow = requests.select("subject", F.col("request_id").cast("long").alias("request_id"), "at")
    judged = fold(narrow, ["subject"], ["at", "request_id"], step, f"subject {requests.schema['subject'].dataType.simpleString()}, request_id long, allowed boolean, remaining int")
    return requests.join(judged, ["subject", "request_id"])


def stream_headers(streams: DataFrame, ring: int = RING) -> DataFrame:
    """The payload header of each live stream (stream_id, transport): ring size, transport and score."""
    return streams.select("stream_id", F.lit("live_stream").alias("source_type"), F.lit("track_b_live").alias("track"), F.lit(1.0).alias("compute_priority_score"), F.lit(ring).alias("buffer_size"), "transport")


def decide_stream(frames: DataFrame, ring: int = RING, max_bytes: int = MAX_FRAME_BYTES) -> DataFrame:
    """``decide`` on a streaming table; a stream's state is the number of frames it has accepted."""
    judged = frames.withColumn("refused", _verdict(max_bytes)).select("stream_id", "arrival_seq", "frame_id", "refused")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("arrival_seq", kind="stable")
        ok = rows["refused"].isna().to_numpy()
        upto = n + ok.cumsum()
        full = ok & (upto > ring)
        state.update((int(upto[-1]) if len(upto) else n,))
        yield pd.DataFrame({
            "stream_id": key[0], "arrival_seq": rows["arrival_seq"], "frame_id": rows["frame_id"], "accepted": ok,
            "action": rows["refused"].where(~ok, pd.Series(full, rows.index).map({True: "drop_oldest", False: "accepted"})),
            "sequence": pd.Series(upto - 1, rows.index).where(ok).astype("Int64"), "dropped_frames": full.astype("int32"),
        })

    kind = frames.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {kind}, arrival_seq long, frame_id string, accepted boolean, action string, sequence long, dropped_frames int"
    return judged.groupBy("stream_id").applyInPandasWithState(step, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def rate_limit_stream(requests: DataFrame, limit: int = MAX_REQUESTS, window: int = WINDOW_SECONDS, lateness: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """``rate_limit`` on a streaming table; a subject's state is the at most ``limit`` times that count.

    Subjects are dealt into ``buckets`` by a hash, and a bucket's subjects are judged in one pass with one state, since a
    group costs milliseconds in itself. A query keeps the number of buckets that it began with.

    Once the stream's watermark (the latest time less ``lateness``) is more than a window beyond a subject's last allowed
    request, nothing of it counts any more and its state goes. Requests behind the watermark are late and have no row.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        expiry = lambda held: int(1000 * (held[-1] + window + 1 + ORIGIN))
        kept = dict(zip(state.get[0], map(list, state.get[1]), strict=True)) if state.exists else {}
        said = None
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values(["at", "request_id"], kind="stable")
            allowed, remaining = [], []
            for subject, at in zip([None] * len(rows) if key[0] < 0 else rows["subject"].tolist(), rows["at"].tolist(), strict=True):
                ok, left = allow(kept.setdefault(subject, []), at, limit, window)
                allowed.append(ok)
                remaining.append(left)
            said = pd.DataFrame({"subject": rows["subject"], "request_id": rows["request_id"], "at": rows["at"], "allowed": allowed, "remaining": pd.Series(remaining, rows.index, dtype="int32")})
        kept = {s: held for s, held in kept.items() if held and expiry(held) > watermark}
        if kept:
            state.update((list(kept), list(kept.values())))
            state.setTimeoutTimestamp(max(watermark + 1, min(map(expiry, kept.values()))))
        elif state.exists:
            state.remove()
        if said is not None:
            yield said

    kind = requests.schema["subject"].dataType.simpleString()
    timed = requests.withColumn("arrived", F.timestamp_seconds(F.col("at") + ORIGIN)).withWatermark("arrived", lateness)
    # Requests without a subject are a bucket of their own: pandas would turn the other numbers beside them into fractions.
    dealt = timed.withColumn("bucket", F.when(F.col("subject").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("subject"), F.lit(buckets))))
    return dealt.groupBy("bucket").applyInPandasWithState(step, f"subject {kind}, request_id long, at long, allowed boolean, remaining int", f"subjects array<{kind}>, held array<array<long>>", "append", GroupStateTimeout.EventTimeTimeout)


def adaptive_sample_stream(frames: DataFrame) -> DataFrame:
    """Adaptive sampling of (video_id, index, motion_score, fps) as a stream: kept frames with ``sample_index``."""
    step_of = F.greatest(min_gap(F.col("fps")), interval(F.coalesce("motion_score", F.lit(0.0))))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values("index", kind="stable")
        kept, numbers = [], []
        for at, gap in zip(rows["index"].tolist(), rows["step"].tolist(), strict=True):
            if last is None or at - last >= gap:
                last = at
                kept.append(at)
                numbers.append(n)
                n += 1
        state.update((last, n))
        yield pd.DataFrame({"video_id": key[0], "index": pd.Series(kept, dtype="int64"), "sample_index": pd.Series(numbers, dtype="int32")})

    kind = frames.schema["video_id"].dataType.simpleString()
    narrow = frames.select("video_id", F.col("index").cast("long").alias("index"), step_of.cast("long").alias("step"))
    return narrow.groupBy("video_id").applyInPandasWithState(step, f"video_id {kind}, index long, sample_index int", "last long, n int", "append", GroupStateTimeout.NoTimeout)


def frame_source(spark, path: str, schema: str) -> DataFrame:
    """Live frames from a folder that files of ``schema`` arrive in."""
    return spark.readStream.schema(schema).parquet(path)
