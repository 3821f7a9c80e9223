"""Inverse normal distribution function as SQL text that Spark compiles, by Wichura's algorithm AS 241."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients published with AS 241 (PPND16), numerators and denominators from power 0 up.
_A = "3.3871328727963666080e0 1.3314166789178437745e+2 1.9715909503065514427e+3 1.3731693765509461125e+4 4.5921953931549871457e+4 6.7265770927008700853e+4 3.3430575583588128105e+4 2.5090809287301226727e+3".split()
_B = "1.0e0 4.2313330701600911252e+1 6.8718700749205790830e+2 5.3941960214247511077e+3 2.1213794301586595867e+4 3.9307895800092710610e+4 2.8729085735721942674e+4 5.2264952788528545610e+3".split()
_C = "1.42343711074968357734e0 4.63033784615654529590e0 5.76949722146069140550e0 3.64784832476320460504e0 1.27045825245236838258e0 2.41780725177450611770e-1 2.27238449892691845833e-2 7.74545014278341407640e-4".split()
_D = "1.0e0 2.05319162663775882187e0 1.67638483018380384940e0 6.89767334985100004550e-1 1.48103976427480074590e-1 1.51986665636164571966e-2 5.47593808499534494600e-4 1.05075007164441684324e-9".split()
_E = "6.65790464350110377720e0 5.46378491116411436990e0 1.78482653991729133580e0 2.96560571828504891230e-1 2.65321895265761230930e-2 1.24266094738807843860e-3 2.71155556874348757815e-5 2.01033439929228813265e-7".split()
_F = "1.0e0 5.99832206555887937690e-1 1.36929880922735805310e-1 1.48753612908506148525e-2 7.86869131145613259100e-4 1.84631831751005468180e-5 1.42151175831644588870e-7 2.04426310338993978564e-15".split()


def _poly(c: list[str], x: str) -> str:
    out = f"CAST({c[-1]} AS DOUBLE)"
    for k in reversed(c[:-1]):
        out = f"({out} * {x} + CAST({k} AS DOUBLE))"
    return out


def ndtri_sql(u: str) -> str:
    """SQL text of the inverse normal distribution function of ``u`` in (0, 1)."""
    q, tail = f"({u} - 0.5D)", f"sqrt(-ln(least({u}, 1.0D - {u})))"
    r = f"(0.180625D - {q} * {q})"
    middle = f"{q} * {_poly(_A, r)} / {_poly(_B, r)}"
    near = f"{_poly(_C, f'({tail} - 1.6D)')} / {_poly(_D, f'({tail} - 1.6D)')}"
    far = f"{_poly(_E, f'({tail} - 5.0D)')} / {_poly(_F, f'({tail} - 5.0D)')}"
    return f"(CASE WHEN abs({q}) <= 0.425D THEN {middle} ELSE sign({q}) * (CASE WHEN {tail} <= 5.0D THEN {near} ELSE {far} END) END)"


def ndtri(column: str) -> Column:
    return F.expr(ndtri_sql(column))


def for_duckdb(sql: str) -> str:
    """The same text without Spark's suffix of double literals."""
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", sql)
