"""Counters over streams: the batch operators' results from Structured Streaming, in event time with a watermark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(stream: DataFrame, ts: str, bin_seconds: int, late: str, *keys: str) -> DataFrame:
    """Events a bin; a bin is given out once, when the watermark has passed it. Events that come later are left out."""
    bins = stream.withWatermark(ts, late).groupBy(F.window(ts, f"{bin_seconds} seconds"), *keys).agg(F.count("*").alias("n"))
    return bins.select(*keys, F.col("window.start").alias("start"), "n")


def sliding(stream: DataFrame, ts: str, bins: int, bin_seconds: int, delta: Column, late: str, *keys: str) -> DataFrame:
    """Sum over the last `bins` bins, one row a bin."""
    span = F.window(ts, f"{bins * bin_seconds} seconds", f"{bin_seconds} seconds")
    sums = stream.withWatermark(ts, late).groupBy(span, *keys).agg(F.sum(delta).alias("total"))
    return sums.select(*keys, F.col("window.end").alias("end"), "total")


def requests_a_second(stream: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """Whole requests a second over nine finished seconds, at the end of each."""
    return sliding(stream, ts, 9, 1, F.lit(1), late, *keys).select(*keys, "end", F.floor(F.col("total") / 9).alias("qps"))


def hourly(stream: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    return tumbling(stream, ts, 3600, late, *keys)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, as Parquet, exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def metered(stream: DataFrame, name: str = "counters", **named: Column) -> DataFrame:
    """The stream, with named counters that a listener sees after every batch, as `observedMetrics` of its progress."""
    return stream.observe(name, *[c.alias(k) for k, c in named.items()]) if named else stream.observe(name, F.count("*").alias("rows"))


def sessions(stream: DataFrame, ts: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Events a session: one ends when none comes for so long. A session is given out once the watermark has passed its end."""
    own = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return own.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


TAKEN = "bin long, before long, taken boolean"


def decrement_if_enough(stream: DataFrame, key: str, bin: str, delta: str, bin_seconds: int = 1) -> DataFrame:
    """(key, bin, before, taken) for each row that takes something: rows with a `delta` of zero or more add to the key's bin, others take as much as
    their delta says, but only if the bin holds that. `bin` is a second; a later bin begins at zero, and rows of earlier ones take nothing.

    A key's state is its bin and what that holds, so it doesn't grow. Within a batch rows go by second, adding ones first; the rows of a key come
    to one task, in chunks."""
    kind = stream.schema[key].dataType.simpleString()

    def step(group, chunks, state: GroupState):
        now, held = state.get if state.exists else (None, 0)
        rows = pd.concat(list(chunks), ignore_index=True)
        rows["__bin"] = rows[bin] // bin_seconds
        out = []
        for at, change in rows.assign(__takes=rows[delta] < 0).sort_values([bin, "__takes"], kind="stable")[["__bin", delta]].itertuples(index=False):
            if now is None or at > now:
                now, held = int(at), 0
            if at < now:
                if change < 0:
                    out.append((*group, int(at), 0, False))
            elif change >= 0:
                held += int(change)
            else:
                out.append((*group, int(at), held, held >= -change))
                held += int(change) if held >= -change else 0
        state.update((now, held))
        yield pd.DataFrame(out, columns=[key, "bin", "before", "taken"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {TAKEN}", "bin long, held long", "append", GroupStateTimeout.NoTimeout)
