"""Sequential statistics as a stateful stream: one output row for each input row, causal, state kept per id.

Inputs are rows (id, pos, value); parameters (id, mu, sd) are fitted on the history in batch and reach the
operator as columns of its input, by a stream-static join, so executors never refit.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "id string, pos long, sum_z double, cusum_up double, cusum_dn double, ewma double"


def online_statistics(stream: DataFrame, params: DataFrame, k: float = 0.1, alpha: float = 0.03) -> DataFrame:
    """Running sum over root n, two-sided CUSUM and EWMA of (value - mu) / sd; rows of a micro-batch go by pos."""
    scale = ((2 - alpha) / alpha) ** 0.5

    def step(key, frames: Iterator, state: GroupState):
        import pandas as pd

        n, total, up, dn, ew = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("pos")
        out = []
        for pos, e in zip(rows["pos"], (rows["value"] - rows["mu"]) / rows["sd"]):
            n, total = n + 1, total + e
            up, dn = max(0.0, up + e - k), max(0.0, dn - e - k)
            ew = (1 - alpha) * ew + alpha * e
            out.append((key[0], int(pos), total / n**0.5, up, dn, ew * scale))
        state.update((n, float(total), float(up), float(dn), float(ew)))
        yield pd.DataFrame(out, columns=["id", "pos", "sum_z", "cusum_up", "cusum_dn", "ewma"])

    joined = stream.join(params, "id")
    return joined.groupBy("id").applyInPandasWithState(step, OUT, "n long, total double, up double, dn double, ew double", "append", GroupStateTimeout.NoTimeout)


def _horizon_factor(curve, k):
    """1 / sd at horizons ``k`` by the same interpolation as the batch operator's."""
    import numpy as np

    if curve is None:
        return np.full(len(k), np.nan)
    sd = np.log(np.maximum(np.asarray(curve, float), 1e-9))
    x = np.minimum(np.log2(k), 10.0)
    lo = np.minimum(np.floor(x), 9).astype(int)
    return 1 / (np.exp(sd[lo] + (x - lo) * (sd[lo + 1] - sd[lo])) * np.sqrt(np.maximum(k / 1024.0, 1.0)))


def calibrated_statistics(stream: DataFrame, params: DataFrame, widths: tuple[int, ...] = (16, 64, 256), alpha: float = 0.03) -> DataFrame:
    """Running and windowed sums and EWMA of e - mu on the scale of the history, one output row for each input row.

    ``stream`` has id, pos, e; ``params`` is what ``calibrated.calibration`` fits on the histories. The state of an id is its
    count, its EWMA and the last max(widths) prefix sums, so it is bounded however long the series runs. Where the
    history is too short for a curve or a sd, the columns are null, as in batch.
    """
    columns = ["cal_sum", *[f"cal_w{w}" for w in widths], "cal_ewma"]
    keep = max(widths)

    def step(key, frames: Iterator, state: GroupState):
        import numpy as np
        import pandas as pd

        n, ew, ring = state.get if state.exists else (0, 0.0, [0.0])
        rows = pd.concat(list(frames)).sort_values("pos")
        curve, ew_sd = rows["curve"].iloc[0], rows["ew_sd"].iloc[0]
        e = (rows["e"] - rows["mu"]).to_numpy(float)
        prefix = np.concatenate([ring, ring[-1] + np.cumsum(e)])
        at = np.arange(len(ring), len(prefix))
        k = n + 1 + np.arange(len(e))
        # prefix starts at the sum of the first n + 1 - len(ring) values: 0 of them until the ring is full
        out = {"cal_sum": prefix[at] * _horizon_factor(curve, k)}
        for w in widths:
            out[f"cal_w{w}"] = (prefix[at] - np.where(k > w, prefix[np.maximum(at - w, 0)], 0.0)) * _horizon_factor(curve, np.minimum(k, w))
        smooth = []
        for x in e:
            ew = (1 - alpha) * ew + alpha * x
            smooth.append(ew)
        out["cal_ewma"] = np.array(smooth) / max(ew_sd, 1e-9) if ew_sd == ew_sd else np.full(len(e), np.nan)
        state.update((n + len(e), float(ew), prefix[-keep:].tolist()))
        yield pd.DataFrame({"id": key[0], "pos": rows["pos"].to_numpy(), **out})

    joined = stream.join(params, "id")
    schema = "id string, pos long, " + ", ".join(f"{c} double" for c in columns)
    return joined.groupBy("id").applyInPandasWithState(step, schema, "n long, ew double, ring array<double>", "append", GroupStateTimeout.NoTimeout)


def score_stream(stream: DataFrame, nulls: DataFrame, models: list) -> DataFrame:
    """id, pos, score: the averaged ensemble's log-odds for each row (id, pos, value) of a stream, as soon as it is there.

    ``nulls`` are the fitted histories (``features.fit_nulls``); features and scores see nothing later than their row.
    """
    from ..operators import ensemble, features

    return ensemble.score(features.stream_features(stream, nulls), features.FEATURES, models).select("id", "pos", "score")
