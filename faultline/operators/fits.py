"""Per-series model fits by grouped pandas functions: autoregression, ridge on random features, GARCH."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AR_ORDER, RFF_LAGS, RFF_SIZE, RFF_WIDTH = 20, 10, 100, 3.0


def ar1(series: DataFrame, column: str = "z") -> DataFrame:
    """id, phi: least squares through the origin of order 1, in closed form, on the history."""
    x = F.lag(column).over(Window.partitionBy("id").orderBy("pos"))
    pairs = series.filter("period = 1").select("id", F.col(column).alias("y"), x.alias("x")).filter(F.col("x").isNotNull())
    return pairs.groupBy("id").agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("phi"))


def ar(series: DataFrame, order: int = AR_ORDER, column: str = "z") -> DataFrame:
    """id, phi (array), r_sd: least squares of a value on the ``order`` values before it, history only.

    One group is one series of bounded length; a series too short for the order gets null coefficients.
    """

    def fit(key, g):
        import numpy as np
        import pandas as pd

        z = g.sort_values("pos")[column].to_numpy()
        if len(z) < 2 * order + 1:
            return pd.DataFrame({"id": [key[0]], "phi": [None], "r_sd": [None]})
        lags = np.stack([z[order - k : len(z) - k] for k in range(1, order + 1)], axis=1)
        y = z[order:]
        phi = np.linalg.lstsq(lags, y, rcond=None)[0]
        return pd.DataFrame({"id": [key[0]], "phi": [phi.tolist()], "r_sd": [max(float((y - lags @ phi).std()), 1e-8)]})

    return series.filter("period = 1").select("id", "pos", column).groupBy("id").applyInPandas(fit, "id string, phi array<double>, r_sd double")


def ar_residuals(series: DataFrame, fitted: DataFrame, column: str = "z") -> DataFrame:
    """Rows plus r, the standardised residual: lags come from one window, the product from a higher-order function."""
    order = Window.partitionBy("id").orderBy("pos").rowsBetween(-AR_ORDER, -1)
    rows = series.withColumn("_x", F.reverse(F.collect_list(column).over(order))).join(fitted, "id")
    dot = F.aggregate(F.zip_with("_x", "phi", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("r", F.when(F.size("_x") == F.size("phi"), (F.col(column) - dot) / F.col("r_sd"))).drop("_x", "phi", "r_sd")


#: Penalties a row, as the reference has them.
NL_GRID = (1e-3, 1e-2, 3e-2, 0.1, 0.3, 1.0, 3.0, 10.0, 100.0)
NL_STREAMS = ["nl_e2", "nl_std2", "nl_logv", "nl_gain"]


def lagged(z):
    """Rows of the RFF_LAGS values before each place, the latest first, from place RFF_LAGS on."""
    import numpy as np

    return np.lib.stride_tricks.sliding_window_view(z[:-1], RFF_LAGS)[:, ::-1]


def random_features(lags, seed: int = 0):
    """Lags, and random Fourier features of them with a fixed seed: a linear part and an approximate Gaussian kernel."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w = rng.normal(size=(RFF_LAGS, RFF_SIZE)) / RFF_WIDTH
    b = rng.uniform(0.0, 2 * np.pi, RFF_SIZE)
    return np.hstack([lags, np.sqrt(2.0 / RFF_SIZE) * np.cos(lags @ w + b)])


def ridge_loo(x, y):
    """Coefficients, free intercept, penalty and leave-one-out errors; the penalty with the least
    leave-one-out error is taken from ``NL_GRID`` times the rows, the first on ties."""
    import numpy as np

    n, mean, level = len(y), x.mean(axis=0), y.mean()
    u, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    room = s[:, None] ** 2 + n * np.array(NL_GRID)  # all penalties at once, one a column
    keep, uy = s[:, None] ** 2 / room, (u.T @ (y - level))[:, None]
    errors = ((y - level)[:, None] - u @ (keep * uy)) / (1 - 1 / n - (u * u) @ keep)
    k = int(np.argmin((errors * errors).sum(axis=0)))
    coef = vt.T @ (s * uy[:, 0] / room[:, k])
    return coef, level - mean @ coef, NL_GRID[k], errors[:, k]


class Predictors:
    """The nonlinear mean, its error's variance, and the linear mean, fitted on one history of normal scores."""

    def __init__(self, history):
        import numpy as np

        lags, y = lagged(history), history[RFF_LAGS:]
        f = random_features(lags)
        *self.mean, self.lam_mean, e = ridge_loo(f, y)
        self.e2 = e * e
        self.floor = 0.1 * self.e2.mean()
        *self.var, self.lam_var, loo_v = ridge_loo(f, self.e2)
        *self.line, self.lam_ar, self.loo_ar = ridge_loo(lags, y)
        self.history = self._streams(self.e2, np.maximum(self.e2 - loo_v, self.floor), self.loo_ar**2)

    @staticmethod
    def _streams(e2, v, line2):
        import numpy as np

        v = np.maximum(v, 1e-300)  # a history without any error
        return np.column_stack([e2, e2 / v, np.log(v), line2 - e2])

    def online(self, before, values):
        """The four streams of ``values``, which follow ``before`` (RFF_LAGS values at least)."""
        import numpy as np

        lags = lagged(np.concatenate([before[-RFF_LAGS:], values]))
        f = random_features(lags)
        e2 = (values - f @ self.mean[0] - self.mean[1]) ** 2
        v = np.maximum(f @ self.var[0] + self.var[1], self.floor)
        return self._streams(e2, v, (values - lags @ self.line[0] - self.line[1]) ** 2)


def learned(series: DataFrame, column: str = "g") -> DataFrame:
    """id, lam_mean, lam_var, lam_ar, mse_nl, mse_ar: penalties and leave-one-out errors of the nonlinear mean, variance and linear predictors.

    A history of fewer than 2 RFF_LAGS + 1 points gets nulls.
    """
    names = ["lam_mean", "lam_var", "lam_ar", "mse_nl", "mse_ar"]

    def fit(key, g):
        import pandas as pd

        z = g.sort_values("pos")[column].to_numpy()
        if len(z) < 2 * RFF_LAGS + 1:
            return pd.DataFrame({"id": [key[0]], **{c: [None] for c in names}})
        p = Predictors(z)
        return pd.DataFrame({"id": [key[0]], "lam_mean": [p.lam_mean], "lam_var": [p.lam_var], "lam_ar": [p.lam_ar], "mse_nl": [p.e2.mean()], "mse_ar": [(p.loo_ar**2).mean()]})

    return series.filter("period = 1").select("id", "pos", column).groupBy("id").applyInPandas(fit, "id string, " + ", ".join(f"{c} double" for c in names))


def learned_streams(scored: DataFrame, column: str = "g") -> DataFrame:
    """id, pos and the four learned streams: squared error of the nonlinear predictor, that over its predicted variance,
    the variance's logarithm, and the linear predictor's squared error less the nonlinear one's.

    History rows from place RFF_LAGS on have leave-one-out values, online rows the fitted predictors'; a history of fewer
    than 2 RFF_LAGS + 1 points has nulls online and no rows before. One group is one series of bounded length.
    """

    def fit(key, g):
        import numpy as np
        import pandas as pd

        g = g.sort_values("pos")
        z, n, pos = g[column].to_numpy(), int((g["period"] == 1).sum()), g["pos"].to_numpy()
        if n < 2 * RFF_LAGS + 1:
            return pd.DataFrame({"id": key[0], "pos": pos[n:], **{c: None for c in NL_STREAMS}})
        p = Predictors(z[:n])
        values = np.concatenate([p.history, p.online(z[:n], z[n:])]) if n < len(z) else p.history
        return pd.DataFrame({"id": key[0], "pos": pos[RFF_LAGS:], **{c: values[:, k] for k, c in enumerate(NL_STREAMS)}})

    return scored.select("id", "pos", "period", column).groupBy("id").applyInPandas(fit, "id string, pos int, " + ", ".join(f"{c} double" for c in NL_STREAMS))


def garch_nll(x2, a, b):
    """Half the deviance of GARCH(1,1) of values with unit variance, for arrays of a and b; infinite where a + b is 0.999 or more."""
    import numpy as np

    u, total = np.zeros(np.shape(a)), np.zeros(np.shape(a))
    for s in x2:
        v = np.maximum(1.0 + u, 1e-3)
        total += np.log(v) + s / v
        u = a * (s - 1.0) + b * u
    return np.where(a + b < 0.999, total / 2, np.inf)


def garch(series: DataFrame, column: str = "g") -> DataFrame:
    """id, a, b, nll: GARCH(1,1) around a variance of 1 (that of normal scores), a in 1e-4 .. 0.5, b in 0 .. 0.998, a + b below 0.999.

    Two grids, around a slow and a quick start, are refined around their best points; one point of history gets nulls.
    """

    def fit(key, g):
        import numpy as np
        import pandas as pd

        x2 = g.sort_values("pos")[column].to_numpy() ** 2
        if len(x2) < 2:
            return pd.DataFrame({"id": [key[0]], "a": [None], "b": [None], "nll": [None]})
        best = None
        for ca, cb, wa, wb in ((0.25, 0.5, 0.25, 0.5), (0.05, 0.9, 0.05, 0.1)):
            for _ in range(8):
                a, b = np.meshgrid(np.clip(np.linspace(ca - wa, ca + wa, 9), 1e-4, 0.5), np.clip(np.linspace(cb - wb, cb + wb, 9), 0.0, 0.998))
                cost = garch_nll(x2, a, b)
                k = np.unravel_index(np.argmin(cost), cost.shape)
                if best is None or cost[k] < best[0]:
                    best = float(cost[k]), float(a[k]), float(b[k])
                ca, cb, wa, wb = float(a[k]), float(b[k]), wa / 2, wb / 2
        return pd.DataFrame({"id": [key[0]], "a": [best[1]], "b": [best[2]], "nll": [best[0]]})

    return series.filter("period = 1").select("id", "pos", column).groupBy("id").applyInPandas(fit, "id string, a double, b double, nll double")
