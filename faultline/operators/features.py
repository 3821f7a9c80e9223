"""The whole feature row of a series: 31 standardised streams with 11 running statistics each, 15 calibrated streams with 5, and log n.

One class serves batch and stream: ``Null`` is fitted on a history and turns any later chunk of values, with the state
left by the chunk before, into streams and statistics, so both give the same numbers. A series is bounded in length,
so it is one Arrow group in batch and one key of a stateful operator in a stream.
"""

from __future__ import annotations

import math
import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fits import NL_STREAMS, RFF_LAGS, Predictors

LAGS, SKIP, ALPHA, WIDTHS, DRIFTS = 20, 200, 0.03, (16, 64, 256), (0.1, 0.3)
VOL_DECAY, CAL_DECAYS, HORIZONS, CAP = 0.94, (0.97, 0.99), 11, 50.0
TAIL, CENTRE = 1.6448536269514722, 0.2533471031357997
STREAMS = [
    "z", "z2", "g", "g2", "absg", "g4", "tail", "gg1", "gg2", "gg3", "zz1", "absdz", "dz2", "vol1", "r", "absr", "r2", "rg2", "absrg",
    "zf2", "gg5", "gg10", "sgn1", "g3", "vol5", "upper", "center", *NL_STREAMS,
]
STATS = ["sum", "up1", "dn1", "up3", "dn3", *(f"w{w}" for w in WIDTHS), "ewma", "glr", "glr_age"]
CAL_STREAMS = [f"{b}_{k}" for b in ("g", "w97", "w99") for k in ("lvl", "sq", "abs", "ac1", "vol1")]
CAL_STATS = ["sum", *(f"w{w}" for w in WIDTHS), "ewma"]
FEATURES = ["log_n", *(f"{s}_{t}" for s in STREAMS for t in STATS), *(f"c_{s}_{t}" for s in CAL_STREAMS for t in CAL_STATS)]


def decayed(x, decay: float, start):
    """s after each row of s <- decay * s + x, columns apart."""
    import numpy as np

    out, s, size = np.empty_like(x), np.asarray(start, float), max(1, int(-200 / math.log(decay)))
    for a in range(0, len(x), size):
        part = x[a : a + size]
        weight = decay ** np.arange(1, len(part) + 1).reshape(-1, *[1] * (x.ndim - 1))
        out[a : a + size] = weight * (s + np.cumsum(part / weight, axis=0))
        s = out[a + len(part) - 1]
    return out


class Scores:
    """Normal scores of mid-ranks among the values of a history."""

    def __init__(self, values):
        import numpy as np
        from statistics import NormalDist

        self.sorted, n = np.sort(values), len(values)
        self.table = np.array([NormalDist().inv_cdf((k / 2 + 0.5) / (n + 1)) for k in range(2 * n + 1)])

    def __call__(self, x):
        import numpy as np

        return self.table[np.searchsorted(self.sorted, x) + np.searchsorted(self.sorted, x, "right")]


def long_run_sd(rows):
    """Bartlett long-run sd of each column, with ceil(n ** (1/3)) lags and the clamp of :func:`windows.long_run_sd`."""
    import numpy as np

    n = len(rows)
    d = rows - rows.mean(axis=0)
    own = (d * d).sum(axis=0) / n
    lags = math.ceil(n ** (1 / 3) - 1e-9)
    total = own + sum(2 * (1 - j / (lags + 1)) * (d[j:] * d[: n - j]).sum(axis=0) / n for j in range(1, min(lags, n - 1) + 1))
    return np.where(own <= 0, 1e-6, np.sqrt(np.maximum(total, 0.1 * own)))


def horizon_curve(rows):
    """log of the sd of rolling sums at horizons 1, 2, 4 ... (rows) of each column; NaN where the history is too short for any."""
    import numpy as np

    n = len(rows)
    sums = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
    known = [h for h in range(HORIZONS) if 1 << h < n // 2]
    if not known:
        return np.full((HORIZONS, rows.shape[1]), np.nan)
    sd = [(sums[1 << h :] - sums[: len(sums) - (1 << h)]).std(axis=0) for h in known]
    sd += [sd[-1] * 2 ** ((h - known[-1]) / 2) for h in range(len(known), HORIZONS)]
    return np.log(np.maximum(np.array(sd), 1e-9))


def inverse_sd(curve, k):
    """1 / sd at horizons ``k`` (rows) of each column: linear in logarithms, root of time beyond the last."""
    import numpy as np

    x = np.minimum(np.log2(k), HORIZONS - 1.0)
    lo = np.minimum(np.floor(x), HORIZONS - 2).astype(int)
    f = (x - lo)[:, None]
    beyond = np.sqrt(np.maximum(k / 2.0 ** (HORIZONS - 1), 1.0))[:, None]
    return 1 / (np.exp((1 - f) * curve[lo] + f * curve[lo + 1]) * beyond)


class Null:
    """What is known of a series from its history; fewer than 2 LAGS + 1 points are refused."""

    def __init__(self, history):
        import numpy as np

        x = np.asarray(history, float)
        if len(x) <= 2 * LAGS:
            raise ValueError(f"a history has at least {2 * LAGS + 1} points")
        self.mu, self.sd = x.mean(), max(x.std(), 1e-8)
        self.score = Scores(x)
        z, g = (x - self.mu) / self.sd, self.score(x)
        before = np.lib.stride_tricks.sliding_window_view(z[:-1], LAGS)[:, ::-1]
        self.phi = np.linalg.lstsq(before, z[LAGS:], rcond=None)[0]
        left = z[LAGS:] - before @ self.phi
        self.r_sd = max(left.std(), 1e-8)
        self.r_score = Scores(left / self.r_sd)
        self.predictors = Predictors(g)
        state = {"z": z[:LAGS], "g": g[:LAGS], "vol": 1.0, "v": np.ones(len(CAL_DECAYS)), "base": np.zeros(1 + len(CAL_DECAYS))}
        rows, cal = self.streams(x[LAGS:], state, self.predictors.history[LAGS - RFF_LAGS :])
        self.centre, self.scale = rows.mean(axis=0), 1 / long_run_sd(rows)
        cal = cal[SKIP - LAGS :]
        n, c = len(cal), len(CAL_STREAMS)
        self.cal_centre = cal.mean(axis=0) if n else np.full(c, np.nan)
        e = cal - self.cal_centre
        self.curve = horizon_curve(e) if n else np.full((HORIZONS, c), np.nan)
        late = decayed(ALPHA * e, 1 - ALPHA, np.zeros(c))[int(3 / ALPHA) :] if n else e
        self.cal_scale = 1 / np.maximum(late.std(axis=0), 1e-9) if len(late) else np.full(c, np.nan)
        s = len(STREAMS)
        self.start = state | {"cum": np.zeros((1, s)), "up": np.zeros((len(DRIFTS), s)), "dn": np.zeros((len(DRIFTS), s)), "ew": np.zeros(s), "cal": np.zeros((1, c)), "cal_ew": np.zeros(c)}

    def streams(self, x, state: dict, learned=None):
        """The 31 and 15 streams of a chunk; ``state`` is moved on behind it. ``learned`` replaces the predictors' streams."""
        import numpy as np

        m = len(x)
        z, g = (x - self.mu) / self.sd, self.score(x)
        zs, gs = np.concatenate([state["z"], z]), np.concatenate([state["g"], g])
        zl, gl = (lambda k: zs[LAGS - k : LAGS - k + m]), (lambda k: gs[LAGS - k : LAGS - k + m])
        r = (z - sum(p * zl(k + 1) for k, p in enumerate(self.phi))) / self.r_sd
        rg = self.r_score(r)
        z2, g2, a, d = z * z, g * g, np.abs(g), z - zl(1)
        vol = decayed((1 - VOL_DECAY) * z2, VOL_DECAY, state["vol"])
        vol_before = np.concatenate([[state["vol"]], vol])[:m]
        if learned is None:
            learned = self.predictors.online(state["g"], g) if m else np.empty((0, len(NL_STREAMS)))
        rows = np.column_stack([
            z, z2, g, g2, a, np.minimum(g2 * g2, CAP), a > TAIL, g * gl(1), g * gl(2), g * gl(3), z * zl(1), np.abs(d), d * d, a * np.abs(gl(1)), r, np.abs(r), r * r, rg * rg, np.abs(rg),
            z2 / vol_before, g * gl(5), g * gl(10), np.sign(g) * np.sign(gl(1)), g2 * g, a * np.abs(gl(5)), g > 0, a < CENTRE, learned,
        ]).astype(float)
        bases, v_end = [g], []
        for decay, v in zip(CAL_DECAYS, state["v"]):
            after = decayed((1 - decay) * g2, decay, v)
            bases.append(g / np.sqrt(np.concatenate([[v], after])[:m]))
            v_end.append(after[-1] if m else v)
        cal = []
        for b, first in zip(bases, state["base"]):
            last = np.concatenate([[first], b])[:m]
            cal += [b, b * b, np.abs(b), b * last, np.abs(b) * np.abs(last)]
        state |= {"z": zs[-LAGS:], "g": gs[-LAGS:], "v": np.array(v_end), "vol": vol[-1] if m else state["vol"]}
        if m:
            state["base"] = np.array([b[-1] for b in bases])
        return rows, np.column_stack(cal)

    def update(self, x, state: dict):
        """The feature rows of a chunk of values, and the state behind it."""
        import numpy as np

        x, state = np.asarray(x, float), dict(state)
        rows, cal = self.streams(x, state)
        e, c = (rows - self.centre) * self.scale, cal - self.cal_centre
        m, n0 = len(x), len(state["cum"]) - 1
        n = n0 + 1 + np.arange(m)
        root = np.sqrt(n)[:, None]
        cum = np.concatenate([state["cum"], state["cum"][-1] + np.cumsum(e, axis=0)])
        out = [cum[n] / root]
        ups, downs = [], []
        for k, drift in enumerate(DRIFTS):
            for sign, name, ends in ((1, "up", ups), (-1, "dn", downs)):
                walk = state[name][k] + np.cumsum(sign * e - drift, axis=0)
                run = walk - np.minimum(np.minimum.accumulate(walk, axis=0), 0)
                out.append(run)
                ends.append(run[-1])
        out += [(cum[n] - cum[np.maximum(n - w, 0)]) / np.sqrt(np.minimum(n, w))[:, None] for w in WIDTHS]
        ew = decayed(ALPHA * e, 1 - ALPHA, state["ew"])
        out.append(ew * math.sqrt((2 - ALPHA) / ALPHA))
        out += _best_starts(cum, n)
        cal_cum = np.concatenate([state["cal"], state["cal"][-1] + np.cumsum(c, axis=0)])
        cal_ew = decayed(ALPHA * c, 1 - ALPHA, state["cal_ew"])
        cal_out = [cal_cum[n] * inverse_sd(self.curve, n)]
        cal_out += [(cal_cum[n] - cal_cum[np.maximum(n - w, 0)]) * inverse_sd(self.curve, np.minimum(n, w)) for w in WIDTHS]
        cal_out.append(cal_ew * self.cal_scale)
        state |= {"cum": cum, "up": np.array(ups), "dn": np.array(downs), "ew": ew[-1], "cal": cal_cum, "cal_ew": cal_ew[-1]}
        wide = [np.log(n)[:, None], np.stack(out, axis=2).reshape(m, -1), np.stack(cal_out, axis=2).reshape(m, -1)]
        return np.concatenate(wide, axis=1), state


def _best_starts(cum, n, block: int = 32):
    """Signed likelihood ratio over all starts of each column at places ``n``, and log age of the best start, the first on ties."""
    import numpy as np

    stat, age = np.empty((len(n), cum.shape[1])), np.empty((len(n), cum.shape[1]))
    for a in range(0, len(n), block):
        ends = n[a : a + block]
        starts = np.arange(ends[-1])
        diff = cum[ends][:, None, :] - cum[starts][None, :, :]
        span = (ends[:, None] - starts[None, :]).astype(float)
        ratio = np.where(span[:, :, None] > 0, diff * diff / np.maximum(span, 1)[:, :, None], -1.0)
        best = ratio.argmax(axis=1)
        long = np.take_along_axis(span, best, axis=1)
        stat[a : a + block] = np.take_along_axis(diff, best[:, None, :], axis=1)[:, 0] / np.sqrt(long)
        age[a : a + block] = np.log(long)
    return [stat, age]


def _table(keys: dict, values):
    """Arrow columns of keys and features; NaN is null."""
    import pyarrow as pa

    return pa.table(keys | {f: pa.array(values[:, k], pa.float64(), from_pandas=True) for k, f in enumerate(FEATURES)})


def _schema(keys: str) -> str:
    return f"{keys}, " + ", ".join(f"{f} double" for f in FEATURES)


def feature_matrix(series: DataFrame, stride: int = 1) -> DataFrame:
    """id, step and the 417 features of every ``stride``-th online row of series (id, period, pos, step, value).

    A history of fewer than 2 LAGS + 1 points gives nulls, one of SKIP + int(3 / ALPHA) or fewer nulls in calibrated EWMAs,
    and one of SKIP + 2 or fewer in all calibrated columns.
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("pos")
        x, past = table.column("value").to_numpy(), table.column("period").to_numpy() == 1
        m = int((~past).sum())
        if not m or past.sum() <= 2 * LAGS:
            values = np.full((m, len(FEATURES)), np.nan)
        else:
            null = Null(x[past])
            values, _ = null.update(x[~past], null.start)
        kept = slice(None, None, stride)
        ids = pa.array([table.column("id")[0].as_py()] * len(values[kept]), table.schema.field("id").type)
        return _table({"id": ids, "step": pa.array(np.arange(m)[kept], pa.int32())}, values[kept])

    kind = series.schema["id"].dataType.simpleString()
    rows = series.select("id", F.col("period").cast("int").alias("period"), "pos", F.col("value").cast("double").alias("value"))
    return rows.groupBy("id").applyInArrow(run, _schema(f"id {kind}, step int"))


def fit_nulls(series: DataFrame) -> DataFrame:
    """id, null: the fitted history of each series (at least 2 LAGS + 1 points), as bytes, for :func:`stream_features`."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("pos")
        x = table.column("value").to_numpy()
        made = [pickle.dumps(Null(x))] if len(x) > 2 * LAGS else []
        return pa.table({"id": table.column("id").slice(0, len(made)).combine_chunks(), "null": pa.array(made, pa.binary())})

    kind = series.schema["id"].dataType.simpleString()
    rows = series.filter("period = 1").select("id", "pos", F.col("value").cast("double").alias("value"))
    return rows.groupBy("id").applyInArrow(run, f"id {kind}, null binary")


def stream_features(stream: DataFrame, nulls: DataFrame) -> DataFrame:
    """id, pos and the 417 features of each row (id, pos, value) of a stream, causal; rows of a micro-batch go by pos.

    ``nulls`` comes from :func:`fit_nulls`, by a stream-static join, so executors never refit. State is kept per id.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        import numpy as np
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("pos")
        null = pickle.loads(rows["null"].iloc[0])
        before = pickle.loads(state.get[0]) if state.exists else null.start
        values, after = null.update(rows["value"].to_numpy(), before)
        state.update((pickle.dumps(after),))
        yield pd.DataFrame(np.where(np.isnan(values), None, values) if np.isnan(values).any() else values, columns=FEATURES).assign(id=key[0], pos=rows["pos"].to_numpy())[["id", "pos", *FEATURES]]

    joined = stream.select("id", "pos", F.col("value").cast("double").alias("value")).join(nulls, "id")
    return joined.groupBy("id").applyInPandasWithState(step, _schema("id string, pos long"), "state binary", "append", GroupStateTimeout.NoTimeout)
