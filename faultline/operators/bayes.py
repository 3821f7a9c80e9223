"""Bayes factors of a change at each possible start, over bins of the history's distribution and their transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

MARGINAL_BINS, PAIR_BINS = 16, 4
MARGINAL, PAIR, RECENT = (4, 32, 256), (8, 64), (16, 64)
MODELS = [f"bm{c}" for c in MARGINAL] + [f"bp{c}" for c in PAIR]
COLUMNS = [f"{m}_{k}" for m in MODELS for k in ["lsr", "max"] + [f"rec{r}" for r in RECENT]]


def _since(codes, size: int):
    """before[t, k]: how often the code at t occurs in places k .. t - 1, for a block of places at a time."""
    import numpy as np

    seen = np.zeros((len(codes) + 1, size))
    np.cumsum(codes[:, None] == np.arange(size), axis=0, out=seen[1:])
    return lambda t: seen[t, codes[t]][:, None] - seen[: t[-1] + 1, codes[t]].T


def log_factors(u_hist, u_online, block: int = 128):
    """Yields (places, model, log factors by place and start) for blocks of places; starts after a place are -inf.

    Memory is ``block`` times the length of the online part.
    """
    import numpy as np

    bins = lambda u, n: np.minimum((u * n).astype(np.int64), n - 1)
    past, pair = bins(u_hist, PAIR_BINS), bins(u_online, PAIR_BINS)
    before = np.concatenate([past[-1:], pair[:-1]])
    odds = 0.5 + np.bincount(past[:-1] * PAIR_BINS + past[1:], minlength=PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    odds /= odds.sum(axis=1, keepdims=True)
    p0 = odds[before, pair]
    same_bin = _since(bins(u_online, MARGINAL_BINS), MARGINAL_BINS)
    same_pair, same_row = _since(before * PAIR_BINS + pair, PAIR_BINS**2), _since(before, PAIR_BINS)
    n = len(u_online)
    carry = {m: np.zeros(n) for m in MODELS}
    for lo in range(0, n, block):
        t = np.arange(lo, min(n, lo + block))
        k = np.arange(t[-1] + 1)
        live = k[None, :] <= t[:, None]
        age = np.where(live, t[:, None] - k[None, :], 0)
        hits, pairs, rows = (np.where(live, f(t), 0) for f in (same_bin, same_pair, same_row))
        for m in MODELS:
            c = float(m[2:])
            if m.startswith("bm"):
                step = np.log((c / MARGINAL_BINS + hits) / (c + age)) + np.log(MARGINAL_BINS)
            else:
                step = np.log((c * p0[t][:, None] + pairs) / (c + rows)) - np.log(p0[t])[:, None]
            total = carry[m][k] + np.cumsum(np.where(live, step, 0.0), axis=0)
            carry[m][k] = total[-1]
            yield t, m, np.where(live, total, -np.inf)


def _log_sum(x):
    import numpy as np

    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def bayes_factors(scored: DataFrame) -> DataFrame:
    """id, pos, step and for each model the log mean factor, the greatest, and the log share of the last 16 and 64 starts.

    ``scored`` has u, the mid-rank in history. One group is one series, whose online part is bounded; a series
    without history or online points has no row.
    """

    def run(key, g):
        import numpy as np
        import pandas as pd

        g = g.sort_values("pos")
        hist, on = g[g["period"] == 1], g[g["period"] == 2]
        out = pd.DataFrame({"id": on["id"], "pos": on["pos"].astype("int64"), "step": on["step"].astype("int64")}).reset_index(drop=True)
        values = {c: np.zeros(len(on)) for c in COLUMNS}
        if len(hist) and len(on):
            for t, m, x in log_factors(hist["u"].to_numpy(), on["u"].to_numpy()):
                whole = _log_sum(x)
                values[f"{m}_lsr"][t] = whole - np.log(t + 1)
                values[f"{m}_max"][t] = x.max(axis=1)
                starts = np.arange(x.shape[1])[None, :]
                for r in RECENT:
                    values[f"{m}_rec{r}"][t] = _log_sum(np.where(starts > t[:, None] - r, x, -np.inf)) - whole
        else:
            out = out.iloc[:0]
            values = {c: v[:0] for c, v in values.items()}
        return out.assign(**values)

    schema = "id string, pos long, step long, " + ", ".join(f"{c} double" for c in COLUMNS)
    return scored.select("id", "pos", "step", "period", "u").groupBy("id").applyInPandas(run, schema)
