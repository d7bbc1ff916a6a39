"""Streams: button-parted segments of events, running counts and a Kalman filter, each with a batch twin that gives the same rows.

The segmenter keeps, for each key, whether it records and the open segment; a segment is closed by its next button.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SEGMENT = "key {key}, segment long, n long, total double, first_ts {ts}, last_ts {ts}"
_STATE = "segment long, open boolean, n long, total double, first_ts {ts}, last_ts {ts}"


def segments(events: DataFrame, key: str, ts: str, tie: str, button: str, value: str) -> DataFrame:
    """key, segment (from 1), n, total, first_ts, last_ts: events between a button event that starts recording and the next that ends it, buttons not counted. Open
    segments are not given."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    marked = events.withColumn("_press", F.sum(F.col(button).cast("int")).over(w))
    last = Window.partitionBy(key)
    inside = marked.withColumn("_all", F.max("_press").over(last)).where((~F.col(button)) & (F.col("_press") % 2 == 1) & (F.col("_all") > F.col("_press")))
    return inside.groupBy(F.col(key).alias("key"), ((F.col("_press") + 1) / 2).cast("long").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


def segment_stream(events: DataFrame, key: str, ts: str, tie: str, button: str, value: str) -> DataFrame:
    """The same of a stream, as segments close. Events of one batch are taken in the order of ts and tie. A key's state is six numbers, whatever the length of its open
    segment."""

    def update(k, batches, state):
        seg, open_, n, total, first, last = state.get if state.exists else (0, False, 0, 0.0, None, None)
        rows, done = pd.concat(list(batches)).sort_values([ts, tie]), []
        for r in rows[[ts, button, value]].itertuples(index=False):
            if r[1]:
                if open_ and n:
                    done.append((k[0], seg, n, total, first, last))
                seg, open_, n, total, first, last = (seg, False, 0, 0.0, None, None) if open_ else (seg + 1, True, 0, 0.0, None, None)
            elif open_:
                n, total, first, last = n + 1, total + r[2], first or r[0].to_pydatetime(), r[0].to_pydatetime()
        state.update((seg, open_, n, total, first, last))
        yield pd.DataFrame(done, columns=["key", "segment", "n", "total", "first_ts", "last_ts"]).astype({"first_ts": "datetime64[us]", "last_ts": "datetime64[us]"})

    types = dict(events.dtypes)
    own = {"key": types[key], "ts": types[ts]}
    return events.withColumn("key", F.col(key)).groupBy("key").applyInPandasWithState(update, _SEGMENT.format(**own), _STATE.format(**own), "append", "NoTimeout")


def counts_in_windows(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by key and tumbling window, with a watermark for late events; for streams and tables alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def kalman(df: DataFrame, key: str, order: list[str], value: str, drift: float, noise: float) -> DataFrame:
    """A filter of a random walk for each key: key, the order columns, estimate, variance. A key's rows are read once, in order, with arrays of one value each."""
    schema = ", ".join([f"`{c}` {t}" for c, t in df.select(key, *order).dtypes] + ["estimate double", "variance double"])

    def run(k, rows):
        rows = rows.sort_values(order)
        x, p, out = None, 0.0, []
        for z in rows[value]:
            if x is None:
                x, p = z, noise
            else:
                p += drift
                if not np.isnan(z):
                    g = p / (p + noise)
                    x, p = x + g * (z - x), (1 - g) * p
            out.append((x, p))
        est = pd.DataFrame(out, columns=["estimate", "variance"], index=rows.index)
        return pd.concat([rows[[key, *order]], est], axis=1)

    return df.groupBy(key).applyInPandas(run, schema)


def extended_kalman_step(x, p, control, observation, move, move_jacobian, see, see_jacobian, q, r):
    """One advance and correction: new state and covariance."""
    a = np.asarray(move_jacobian(x, control))
    x, p = np.asarray(move(x, control), float), a @ p @ a.T + q
    h = np.asarray(see_jacobian(x))
    gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
    return x + gain @ (np.asarray(observation) - see(x)), (np.eye(len(x)) - gain @ h) @ p
