"""Exact intensities of a fibre of known temperature, as used by the calibration tests."""

from datetime import datetime, timedelta

import numpy as np

GAMMA, CP, CM, AR, AM, AP = 482.6, 15246.0, 2400.0, 5.284e-4, 4.961e-4, 5.607e-4
START = datetime(2024, 1, 1)


def fibre(spark, temps, x, length=None, loss_fw=None, loss_bw=None, noise=0.0, seed=0, series=None):
    """meas and series frames of temperatures (nx, nt) in kelvin; losses multiply the anti-Stokes by (nx, nt)."""
    nx, nt = temps.shape
    length = length or x[-1]
    e = np.exp(GAMMA / temps)
    st = CP * np.exp(-(AR + AP) * x[:, None]) * e / (e - 1)
    ast = CM * np.exp(-(AR + AM) * x[:, None]) / (e - 1)
    rst = CP * np.exp(-(AR + AP) * (length - x[:, None])) * e / (e - 1)
    rast = CM * np.exp(-(AR + AM) * (length - x[:, None])) / (e - 1)
    st = st if loss_fw is None else st * loss_fw
    rst = rst if loss_bw is None else rst * loss_bw
    rng = np.random.default_rng(seed)
    st, ast, rst, rast = (a + noise * rng.standard_normal(a.shape) for a in (st, ast, rst, rast))
    rows = [(i, float(x[i]), START + timedelta(seconds=t), *(float(a[i, t]) for a in (st, ast, rst, rast))) for i in range(nx) for t in range(nt)]
    meas = spark.createDataFrame(rows, "ix int, x double, time timestamp, st double, ast double, rst double, rast double")
    cols = sorted(series)
    probes = spark.createDataFrame([(START + timedelta(seconds=t), *(float(series[c][t] - 273.15) for c in cols)) for t in range(nt)], "time timestamp, " + ", ".join(f"{c} double" for c in cols))
    return meas, probes


def by_cell(df, *columns):
    """{(ix, second): values} of a frame."""
    return {(r.ix, int((r.time - START).total_seconds())): tuple(r[c] for c in columns) for r in df.collect()}
