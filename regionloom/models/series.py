"""Spectra and forecasts of many series, also of series too long for one task."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from regionloom.models import kalman
from regionloom.operators.positions import number_rows
from regionloom.operators.tables import top_k
from regionloom.session import stage

# ---------------------------------------------------------------- Fourier


def _half_spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
    values = pdf.sort_values("i")["y"].to_numpy()
    f = np.fft.rfft(values)
    return pd.DataFrame({"key": pdf["key"].iloc[0], "n": len(values), "k": np.arange(len(f)), "re": f.real, "im": f.imag})


def _split_transform(df: DataFrame, kind: str, inverse: bool) -> DataFrame:
    """Discrete transform of length m of (key, n, m, i, re, im) rows; absent rows are zero.

    The length is split into two factors of about its square root: columns first, then rows, each a group of about
    sqrt(m) values, so no task holds a series.
    """
    schema = f"key {kind}, n bigint, m bigint, {{}} re double, im double"
    sign = 1.0 if inverse else -1.0
    rows_of = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("m").cast("double")) / 2)).cast("bigint")
    cut = df.withColumn("c", F.col("m") / rows_of).withColumn("c", F.col("c").cast("bigint"))
    cut = cut.select("key", "n", "m", "c", (F.col("i") % F.col("c")).alias("j"), F.floor(F.col("i") / F.col("c")).alias("r"), "re", "im")

    def run(z: np.ndarray) -> np.ndarray:
        return np.fft.ifft(z) * len(z) if inverse else np.fft.fft(z)

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        m, c, j = int(pdf["m"].iloc[0]), int(pdf["c"].iloc[0]), int(pdf["j"].iloc[0])
        z = np.zeros(m // c, dtype=complex)
        z[pdf["r"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        a = np.arange(m // c)
        z = run(z) * np.exp(sign * 2j * np.pi * ((a * j) % m) / m)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "n": pdf["n"].iloc[0], "m": m, "c": c, "j": j, "a": a, "re": z.real, "im": z.imag})

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        m, c, a = int(pdf["m"].iloc[0]), int(pdf["c"].iloc[0]), int(pdf["a"].iloc[0])
        z = np.zeros(c, dtype=complex)
        z[pdf["j"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        z = run(z) / (m if inverse else 1)
        k = a + (m // c) * np.arange(c)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "n": pdf["n"].iloc[0], "m": m, "i": k, "re": z.real, "im": z.imag})

    first = cut.groupBy("key", "j").applyInPandas(columns, schema.format("c bigint, j bigint, a bigint,"))
    return first.groupBy("key", "a").applyInPandas(rows, schema.format("i bigint,"))


def _chirp(i, n):
    """cos and sin of pi i^2 / n, the square taken modulo 2n to keep digits."""
    angle = F.lit(math.pi) * ((i * i) % (2 * n)).cast("double") / n.cast("double")
    return F.cos(angle), F.sin(angle)


def _long_spectrum(series: DataFrame, kind: str) -> DataFrame:
    """Spectrum of series of any length by the chirp transform (Bluestein 1970) over split transforms."""
    i, n = F.col("i"), F.col("n")
    m = F.pow(F.lit(2.0), F.ceil(F.log2((2 * n - 1).cast("double")))).cast("bigint")
    c, s = _chirp(i, n)
    chirped = series.select("key", "n", m.alias("m"), "i", (F.col("y") * c).alias("re"), (-F.col("y") * s).alias("im"))
    ends = F.array(i, F.when(i > 0, F.col("m") - i))
    kernel = series.select("key", "n", m.alias("m"), "i", c.alias("re"), s.alias("im"))
    kernel = kernel.select("key", "n", "m", F.explode(ends).alias("i"), "re", "im").where("i IS NOT NULL")
    a = _split_transform(chirped, kind, False)
    b = _split_transform(kernel, kind, False).select(
        F.col("key").alias("bkey"), F.col("i").alias("bi"), F.col("re").alias("bre"), F.col("im").alias("bim")
    )
    product = a.join(b, (F.col("key") == F.col("bkey")) & (F.col("i") == F.col("bi"))).select(
        "key", "n", "m", "i",
        (F.col("re") * F.col("bre") - F.col("im") * F.col("bim")).alias("re"),
        (F.col("re") * F.col("bim") + F.col("im") * F.col("bre")).alias("im"),
    )
    back = _split_transform(product, kind, True).where(F.col("i") <= F.floor(F.col("n") / 2))
    re, im = F.col("re"), F.col("im")
    return back.select("key", "n", F.col("i").alias("k"), (re * c + im * s).alias("re"), (im * c - re * s).alias("im"))


def spectrum(df: DataFrame, key: str, t: str, y: str, longest: int = 65_536) -> DataFrame:
    """(key, n, k, frequency, amplitude, phase) of each series in order of ``t`` (unique within a series); series
    with fewer than four values are left out.

    Series up to ``longest`` values are one group each; longer ones are transformed in pieces.
    """
    known = df.where(F.col(y).isNotNull()).select(F.col(key).alias("key"), F.col(t).alias("t"), F.col(y).cast("double").alias("y"))
    kind = dict(known.dtypes)["key"]
    numbered = number_rows(known, ["t"], by=["key"], name="i")
    sizes = stage(known.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 4"))
    sized = numbered.join(sizes, "key").select("key", "n", "i", "y")
    short = sized.where(F.col("n") <= longest).groupBy("key").applyInPandas(
        _half_spectrum, f"key {kind}, n bigint, k bigint, re double, im double"
    )
    parts = short
    if not sizes.where(F.col("n") > longest).isEmpty():
        parts = short.unionByName(_long_spectrum(stage(sized.where(F.col("n") > longest)), kind))
    return parts.select(
        F.col("key").alias(key),
        "n",
        "k",
        (F.col("k") / F.col("n")).alias("frequency"),
        F.hypot("re", "im").alias("amplitude"),
        F.atan2("im", "re").alias("phase"),
    )


def fourier(df: DataFrame, key: str, t: str, y: str, top: int = 5, longest: int = 65_536) -> DataFrame:
    """The strongest frequencies per series with the energy of the spectrum: (key, rank, frequency, amplitude, phase,
    n_samples, n_bins, spectral_energy, frequency_uncertainty)."""
    lines = stage(spectrum(df, key, t, y, longest))
    totals = lines.groupBy(key).agg(
        F.max("n").alias("n_samples"),
        F.count(F.lit(1)).alias("n_bins"),
        F.round(F.sum(F.col("amplitude") * F.col("amplitude")), 2).alias("spectral_energy"),
    )
    strongest = top_k(lines, [F.desc("amplitude"), F.asc("k")], top, by=[key])
    rank = Window.partitionBy(key).orderBy(F.desc("amplitude"), "k")
    return strongest.withColumn("rank", F.row_number().over(rank)).join(totals, key).select(
        key,
        "rank",
        F.round("frequency", 6).alias("frequency"),
        F.round("amplitude", 4).alias("amplitude"),
        "phase",
        "n_samples",
        "n_bins",
        "spectral_energy",
        F.round(F.lit(1.0) / F.col("n_samples"), 6).alias("frequency_uncertainty"),
    )


# ---------------------------------------------------------------- ARIMA


def _with_overlap(numbered: DataFrame, halo: int, block: int) -> DataFrame:
    """Rows in blocks of ``block`` positions; the last ``halo`` rows of a block also open the next one."""
    home = F.floor(F.col("i") / block)
    late = F.col("i") % block >= block - halo
    return numbered.select(
        "key", "i", "y", F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))).alias("block")
    ).withColumn("own", F.floor(F.col("i") / block) == F.col("block"))


def _solve_batches(width: int, columns: list[str]):
    """Least squares from the sums of products of each key, one small system per row."""

    def run(batches):
        for batch in batches:
            answers = []
            for _, row in batch.iterrows():
                lhs = np.zeros((width, width))
                rhs = np.array([row[f"b_{a}"] for a in range(width)], dtype=float)
                for a in range(width):
                    for b in range(a, width):
                        lhs[a, b] = lhs[b, a] = row[f"a_{a}_{b}"]
                good = np.isfinite(lhs).all() and np.isfinite(rhs).all()
                answers.append(np.linalg.lstsq(lhs, rhs, rcond=None)[0].tolist() if good else [0.0] * width)
            yield pd.DataFrame({"key": batch["key"], "coef": answers, **{c: batch[c] for c in columns}})

    return run


def _least_squares(rows: DataFrame, y: str, regressors: list[str], kind: str) -> DataFrame:
    """(key, coef, m, yy): coefficients of y on the regressors per key, from sums formed by Spark."""
    width = len(regressors)
    complete = F.col(y).isNotNull()
    for r in regressors:
        complete = complete & F.col(r).isNotNull()
    sums = [F.sum(F.col(regressors[a]) * F.col(regressors[b])).alias(f"a_{a}_{b}") for a in range(width) for b in range(a, width)]
    sums += [F.sum(F.col(regressors[a]) * F.col(y)).alias(f"b_{a}") for a in range(width)]
    table = rows.where(complete).groupBy("key").agg(*sums, F.count(F.lit(1)).alias("m"), F.sum(F.col(y) * F.col(y)).alias("yy"))
    return stage(table.mapInPandas(_solve_batches(width, ["m", "yy"]), f"key {kind}, coef array<double>, m bigint, yy double"))


def _apply(coef: str, regressors: list[str]):
    total = F.lit(0.0)
    for j, r in enumerate(regressors):
        total = total + F.get(coef, F.lit(j)) * F.col(r)
    return total


def _by_likelihood(rows: DataFrame, solved: DataFrame, model: kalman.Model, d: int, key: str, kind: str, steps: int):
    """Fits and forecasts at the greatest likelihood, from the rows in blocks and the coefficients to start with.

    Values are divided by their deviation first, so that one size of step suits all series.
    """
    known = rows.where("w IS NOT NULL")
    scales = known.groupBy("key").agg(F.avg("w").alias("centre"), F.stddev_pop("w").alias("scale"))
    scales = stage(scales.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)))
    packed = known.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("v"))
    blocks = packed.join(scales, "key").select("key", "block", F.transform("v", lambda x: x["w"] / F.col("scale")).alias("w"))

    def started(batches):
        for batch in batches:
            us = []
            for coef, centre, scale in zip(batch["coef"], batch["centre"], batch["scale"], strict=True):
                rest = list(coef)[1:] if model.mean else list(coef)
                us.append([*([centre / scale] if model.mean else []), *kalman.free_numbers(rest[: model.p]), *kalman.free_numbers(-np.array(rest[model.p :]))])
            yield pd.DataFrame({"key": batch["key"], "u": us})

    starts = stage(scales.join(solved.select("key", "coef"), "key").mapInPandas(started, f"key {kind}, u array<double>"))
    found = stage(kalman.likelihood_fits(stage(blocks), starts, model, kind).join(scales, "key"))

    def reported(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples():
                level, phi, theta = model.parts(row.u)
                constant = [level * (1 - phi.sum()) * row.scale] if model.mean else []
                value, variance = model.deviance(kalman.Element.unpacked(row.element, model.states), row.u, row.n)
                sure = variance > 1e-200
                out.append((row.key, row.n, [*constant, *phi, *theta], variance * row.scale**2 if sure else 0.0, value + 2 * row.n * math.log(row.scale) if sure else None))
            yield pd.DataFrame(out, columns=["key", "n", "coef", "sigma2", "deviance"])

    fits = stage(found.mapInPandas(reported, f"key {kind}, n long, coef array<double>, sigma2 double, deviance double"))
    free = model.p + model.q + int(model.mean) + 1
    measures = fits.select(
        F.col("key").alias(key), "n", "coef", "sigma2",
        F.round(F.col("deviance") + 2 * free, 2).alias("aic"),
        F.round(F.col("deviance") + free * F.log("n"), 2).alias("bic"),
        F.round(F.sqrt("sigma2"), 4).alias("rmse"),
    )
    ends = rows.groupBy("key").agg(F.max("i").alias("last"))
    recent = rows.join(ends, "key").where(F.col("i") > F.col("last") - max(d, 1)).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "y"))).alias("v"))
    state = recent.select("key", F.transform("v", lambda x: x["y"]).alias("past")).join(found, "key").join(fits.select("key", "sigma2"), "key")

    def ahead(batches):
        for batch in batches:
            parts = []
            for row in batch.itertuples():
                element = kalman.Element.unpacked(row.element, model.states)
                values, variances = kalman.forecast_parts(model, row.u, element, steps, d, np.asarray(row.past) / row.scale)
                half = 1.959964 * np.sqrt(row.sigma2 * variances)
                values = values * row.scale
                parts.append(pd.DataFrame({"key": row.key, "step": np.arange(1, steps + 1), "forecast": values, "ci_low": values - half, "ci_high": values + half}))
            if parts:
                yield pd.concat(parts)

    columns = state.select("key", "past", "u", "element", "scale", "sigma2")
    forecasts = columns.mapInPandas(ahead, f"key {kind}, step int, forecast double, ci_low double, ci_high double")
    return measures, forecasts.withColumnRenamed("key", key)


def arima(df: DataFrame, key: str, t: str, y: str, order=(1, 1, 1), steps: int = 10, block: int = 65_536, method: str = "likelihood"):
    """(fits, forecasts) of ARIMA(p, d, q) per series.

    fits: (key, n, coef, sigma2, aic, bic, rmse), the coefficients in the order constant (only when d = 0), AR, MA.
    forecasts: (key, step, forecast, ci_low, ci_high) with 95 % bounds. ``method``: ``likelihood`` maximises the exact
    likelihood of the differenced series (stationary, invertible; see ``kalman``), starting from ``two_step``, the
    regression of Hannan and Rissanen (1982). Sums of products and filters alike run over blocks of positions, so a
    series of any length spreads over many tasks.
    """
    if method not in ("likelihood", "two_step"):
        raise ValueError(f"unknown method: {method}")
    p, d, q = order
    long_ar = max(p, q) + 4 if q else 0
    halo = d + long_ar + max(p, q) + 1
    known = df.where(F.col(y).isNotNull()).select(F.col(key).alias("key"), F.col(t).alias("t"), F.col(y).cast("double").alias("y"))
    kind = dict(known.dtypes)["key"]
    rows = _with_overlap(number_rows(known, ["t"], by=["key"], name="i"), halo, block)
    along = Window.partitionBy("key", "block").orderBy("i")
    rows = rows.withColumn("w", F.col("y")).withColumn("one", F.lit(1.0))
    for _ in range(d):
        rows = rows.withColumn("w", F.col("w") - F.lag("w").over(along))
    depth = max(p, long_ar)
    rows = rows.withColumns({f"w{j}": F.lag("w", j).over(along) for j in range(1, depth + 1)})
    constant = ["one"] if d == 0 else []
    ar = [f"w{j}" for j in range(1, p + 1)]
    if q:
        rows = stage(rows)
        first = constant + [f"w{j}" for j in range(1, long_ar + 1)]
        start = _least_squares(rows.where("own"), "w", first, kind).select("key", F.col("coef").alias("__first"))
        rows = rows.join(start, "key").withColumn("e", F.col("w") - _apply("__first", first)).drop("__first")
        rows = rows.withColumns({f"e{j}": F.lag("e", j).over(along) for j in range(1, q + 1)})
    else:
        rows = rows.withColumn("e", F.lit(None).cast("double"))
    rows = stage(rows.where("own"))
    regressors = constant + ar + [f"e{j}" for j in range(1, q + 1)]
    solved = _least_squares(rows, "w", regressors, kind)
    if method == "likelihood":
        return _by_likelihood(rows, solved, kalman.Model(p, q, d == 0), d, key, kind, steps)
    fitted = rows.join(solved.select("key", "coef"), "key").withColumn("u", F.col("w") - _apply("coef", regressors))
    measures = fitted.where("u IS NOT NULL").groupBy("key").agg(F.count("u").alias("n"), F.avg(F.col("u") * F.col("u")).alias("sigma2"))
    free = len(regressors) + 1
    safe = F.when(F.col("sigma2") > 0, F.col("sigma2"))
    deviance = F.col("n") * (F.log(safe * (2 * math.pi)) + 1)
    fits = stage(
        measures.join(solved.select("key", "coef"), "key").select(
            F.col("key").alias(key), "n", "coef", "sigma2",
            F.round(deviance + 2 * free, 2).alias("aic"),
            F.round(deviance + free * F.log("n"), 2).alias("bic"),
            F.round(F.sqrt("sigma2"), 4).alias("rmse"),
        )
    )
    tail = max(p, q, 1) + d
    ends = rows.groupBy("key").agg(F.max("i").alias("last"))
    recent = rows.join(ends, "key").where(F.col("i") > F.col("last") - tail).select("key", "i", "y", "w", "e")
    state = recent.join(fits.select(F.col(key).alias("key"), "coef", "sigma2"), "key")

    def ahead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        coef, sigma2 = list(pdf["coef"].iloc[0]), float(pdf["sigma2"].iloc[0])
        c = coef.pop(0) if d == 0 else 0.0
        phi, theta = coef[:p], coef[p : p + q]
        w, e = pdf["w"].fillna(0.0).tolist(), pdf["e"].fillna(0.0).tolist()
        ws = []
        for _ in range(steps):
            value = c + sum(a * w[-j - 1] for j, a in enumerate(phi)) + sum(b * e[-j - 1] for j, b in enumerate(theta))
            ws.append(value)
            w.append(value)
            e.append(0.0)
        levels = np.array(ws)
        past = pdf["y"].to_numpy()
        for r in range(d, 0, -1):
            levels = np.cumsum(levels) + np.diff(past, r - 1)[-1]
        full = np.array([1.0])
        for _ in range(d):
            full = np.convolve(full, [1.0, -1.0])
        full = np.convolve(full, [1.0, *[-a for a in phi]])
        psi = np.zeros(steps)
        for h in range(steps):
            psi[h] = (1.0 if h == 0 else theta[h - 1] if h <= q else 0.0) - sum(full[j] * psi[h - j] for j in range(1, min(h, len(full) - 1) + 1))
        half = 1.959964 * np.sqrt(sigma2 * np.cumsum(psi**2))
        return pd.DataFrame({"key": pdf["key"].iloc[0], "step": np.arange(1, steps + 1), "forecast": levels, "ci_low": levels - half, "ci_high": levels + half})

    forecasts = state.groupBy("key").applyInPandas(ahead, f"key {kind}, step int, forecast double, ci_low double, ci_high double")
    return fits, forecasts.withColumnRenamed("key", key)
