"""Laws of productivity and scattering, concentration, and growth of a series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scimap.operators.ranks import running


def lotka(distribution: DataFrame) -> DataFrame:
    """One row alpha, c, r_squared, n_items: the log-log line through (n_items, n) of productivity().

    Null below two distinct counts; r_squared is 0 for a constant side.
    """
    x, y = F.ln("n_items"), F.ln("n")
    d = distribution.select(x.alias("x"), y.alias("y"), "n")
    g = d.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").cast("long").alias("n_items"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.var_pop("y").alias("vy"),
    )
    good = F.col("k") >= 2
    return g.select(
        F.when(good, -F.col("slope")).alias("alpha"),
        F.when(good, F.exp("intercept")).alias("c"),
        F.when(good, F.when(F.col("vy") > 0, F.col("r2")).otherwise(0.0)).alias("r_squared"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
    )


def _ranked(counts: DataFrame) -> DataFrame:
    """Counts with rank i, running sum and total. Equal counts are ordered by item."""
    return running(counts, [F.col("n").desc(), F.col("item")], "n")


def bradford_zones(counts: DataFrame, n_zones: int = 3) -> DataFrame:
    """(item, n, i, running, total, zone): sources by count, in zones of about equal numbers of documents.

    A zone closes at the first source where the running sum reaches its share, one source closing one zone at most:
    with f_k the first to reach k shares, zone k closes at max over j <= k of f_j + k - j.
    """
    r = _ranked(counts)
    if n_zones < 2:
        return r.withColumn("zone", F.lit(1))
    firsts = [F.min(F.when(F.col("running") >= F.col("total") / n_zones * k, F.col("i"))).alias(f"f{k}") for k in range(1, n_zones)]
    f = r.agg(*firsts)
    ends = [F.greatest(*[F.col(f"f{j}") + (k - j) for j in range(1, k + 1)], F.lit(0)) for k in range(1, n_zones)]
    zone = sum((F.when(F.col("i") > e, 1).otherwise(0) for e in ends), F.lit(1))
    return r.crossJoin(f).select("item", "n", "i", "running", "total", zone.alias("zone"))


def bradford_summary(zones: DataFrame) -> DataFrame:
    """(zone, n_sources, n_docs)."""
    return zones.groupBy("zone").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("n").cast("long").alias("n_docs"))


def bradford_multiplier(summary: DataFrame) -> DataFrame:
    """One row k: the geometric mean of the ratios of successive zones' numbers of sources; null for one zone."""
    w = Window.partitionBy(F.lit(1)).orderBy("zone")
    s = summary.withColumn("ratio", F.lead("n_sources").over(w) / F.col("n_sources"))
    return s.agg(F.exp(F.avg(F.ln("ratio"))).alias("k"))


def concentration_curve(counts: DataFrame) -> DataFrame:
    """(item, source_share, document_share): cumulative shares, largest first."""
    r = _ranked(counts)
    r = r.crossJoin(r.agg(F.max("i").alias("_last")))
    return r.select("item", (F.col("i") / F.col("_last")).alias("source_share"), (F.col("running") / F.col("total")).alias("document_share"))


def hhi(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., hhi): the sum of squared shares, 0 for a total of 0. With sums of n and n^2 no second pass is needed."""
    by = by or []
    n = F.col("n").cast("double")
    g = counts.groupBy(*by).agg(F.sum(n).alias("s"), F.sum(n * n).alias("q"))
    return g.select(*by, F.coalesce(F.try_divide(F.col("q"), F.col("s") * F.col("s")), F.lit(0.0)).alias("hhi"))


def gini(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., gini) on ascending counts: (n + 1 - 2 * sum of running sums / total) / n; 0 without items or with a total of 0.

    Equal counts are one row with how many there are, so the sort is of distinct counts.
    """
    by = by or []
    g = counts.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    x, m = F.col("n").cast("double"), F.col("m").cast("double")
    g = g.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)).cast("double"))
    # of N items, the item of ascending rank r is in N + 1 - r running sums
    g = g.withColumn("ranks", m * F.col("before") + m * (m + 1) / 2)
    s = g.groupBy(*by).agg(F.sum("m").cast("double").alias("N"), F.sum(x * m).alias("s"), F.sum(x * F.col("ranks")).alias("rx"))
    cum = (F.col("N") + 1) * F.col("s") - F.col("rx")
    value = F.try_divide(F.col("N") + 1 - 2 * F.try_divide(cum, F.col("s")), F.col("N"))
    return s.select(*by, F.coalesce(value, F.lit(0.0)).alias("gini"))


def concentration(countries: DataFrame, institutions: DataFrame) -> DataFrame:
    """(kind, n, hhi, gini) of documents by country and by institution; rows (doc_id, item)."""
    from scimap.operators.frequency import document_frequency

    both = document_frequency(countries).withColumn("kind", F.lit("country")).unionByName(document_frequency(institutions).withColumn("kind", F.lit("institution")))
    n = both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return n.join(hhi(both, ["kind"]), "kind").join(gini(both, ["kind"]), "kind")


def linear_growth(series: DataFrame) -> DataFrame:
    """One row slope, intercept, r_squared, aic, bic of the line through the cumulative series (year, n); null below 4 years."""
    w = Window.partitionBy(F.lit(1)).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    s = series.withColumn("y", F.sum("n").over(w).cast("double")).withColumn("t", (F.col("year") - F.min("year").over(Window.partitionBy(F.lit(1)))).cast("double"))
    g = s.agg(
        F.count(F.lit(1)).cast("double").alias("k"),
        F.regr_slope("y", "t").alias("slope"),
        F.regr_intercept("y", "t").alias("intercept"),
        F.regr_r2("y", "t").alias("r2"),
        F.regr_syy("y", "t").alias("syy"),
    )
    ssr = F.col("syy") * (1 - F.col("r2"))
    fit = F.when((F.col("k") > 3) & (ssr > 0), F.col("k") * F.ln(ssr / F.col("k")))
    four = F.col("k") >= 4
    return g.select(
        F.when(four, F.col("slope")).alias("slope"),
        F.when(four, F.col("intercept")).alias("intercept"),
        F.when(four, F.col("r2")).alias("r_squared"),
        F.when(four, fit + 6).alias("aic"),
        F.when(four, fit + 3 * F.ln("k")).alias("bic"),
    )


def _fit(model, t: np.ndarray, y: np.ndarray, start: list[float], low: list[float], high: list[float], rounds: int = 400) -> tuple[np.ndarray, float]:
    """Least squares by damped Gauss-Newton steps within bounds; numeric derivatives. Returns parameters and the sum of squares."""
    low, high = np.array(low, float), np.array(high, float)
    p = np.clip(np.array(start, float), low, high)
    error = lambda p: model(t, *p) - y
    best, damp = float(np.sum(error(p) ** 2)), 1e-3
    for _ in range(rounds):
        step = 1e-6 * np.maximum(1e-3, np.abs(p))
        r = error(p)
        jac = np.stack([(error(p + step * (np.arange(len(p)) == k)) - r) / step[k] for k in range(len(p))], axis=1)
        a, g = jac.T @ jac, jac.T @ r
        moved = False
        for _ in range(12):
            q = np.clip(p - np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0], low, high)
            now = float(np.sum(error(q) ** 2))
            if np.isfinite(now) and now < best:
                gain, p, best, damp, moved = best - now, q, now, max(1e-12, damp / 5), True
                break
            damp *= 4
        if not moved or gain <= 1e-12 * best:
            break
    return p, best


def growth_models(series: DataFrame, by: str = "corpus") -> DataFrame:
    """(corpus, model, r_squared, aic, bic, asymptote, best, params) of the cumulative series (corpus, year, n): a row for each model.

    Models: linear, exponential, gompertz and bilogistic; best is the one of least AIC. A corpus's series has a value
    for each year, so a group is small whatever the number of documents; corpora are fitted in parallel. Corpora of
    fewer than 4 years have no rows; AIC and BIC are null where the sum of squares is 0 or there are too few years.
    """

    def typed(rows: list[tuple]) -> pd.DataFrame:
        kinds = {"corpus": object, "model": object, "r_squared": float, "aic": float, "bic": float, "asymptote": float, "params": object, "best": bool}
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=k) for i, (c, k) in enumerate(kinds.items())})

    def models(group: pd.DataFrame) -> pd.DataFrame:
        g = group.dropna(subset=["year"]).sort_values("year")
        if len(g) < 4:
            return typed([])
        y = g["n"].to_numpy(float).cumsum()
        t = (g["year"] - g["year"].min()).to_numpy(float)
        n, last, span = len(t), y[-1], t.max()
        line = np.polyfit(t, y, 1)
        found = [("linear", 2, float(np.sum((np.polyval(line, t) - y) ** 2)), None, line)]

        def exponential(x, a, b):
            return a * np.exp(np.clip(b * x, -50, 50))

        def gompertz(x, k, b, c):
            return k * np.exp(-b * np.exp(-c * x))

        def bilogistic(x, l1, k1, t1, l2, k2, t2):
            return sum(size / (1 + np.exp(-np.clip(k * (x - mid), -50, 50))) for size, k, mid in ((l1, k1, t1), (l2, k2, t2)))

        tries = [_fit(exponential, t, y, s, [-np.inf] * 2, [np.inf] * 2) for s in ([1.0, 0.1], [max(y[0], 1.0), math.log(max(last / max(y[0], 1.0), 1.01)) / span])]
        p, ss = min(tries, key=lambda x: x[1])
        found.append(("exponential", 2, ss, None, p))
        tries = [_fit(gompertz, t, y, s, [last, 0.1, 0.01], [last * 100, 50, 5]) for s in ([max(last * 1.5, 100), 5, 0.2], [last * 1.1, 3, 0.5], [last * 5, 6, 0.08])]
        p, ss = min(tries, key=lambda x: x[1])
        found.append(("gompertz", 3, ss, float(p[0]), p))
        starts = [[last * a, 0.4, span * b, last * (1 - a), 0.4, span * c] for a, b, c in ((0.5, 0.45, 0.85), (0.3, 0.3, 0.7), (0.7, 0.5, 0.95))]
        tries = [_fit(bilogistic, t, y, s, [0, 0.01, 0] * 2, [last * 5, 5, span * 1.5] * 2) for s in starts]
        p, ss = min(tries, key=lambda x: x[1])
        found.append(("bilogistic", 6, ss, float(p[0] + p[3]), p))
        around = float(np.sum((y - y.mean()) ** 2))
        rows = []
        for name, k, ss, top, p in found:
            good = ss > 0 and n > k + 1
            base = n * math.log(ss / n) if good else None
            rows.append((str(group[by].iloc[0]), name, 1 - ss / around if around > 0 else 0.0, base + 2 * (k + 1) if good else None, base + (k + 1) * math.log(n) if good else None, top, [float(x) for x in p]))
        least = min((r[3] for r in rows if r[3] is not None), default=None)
        first = next((r[1] for r in rows if r[3] is not None and r[3] == least), None)
        return typed([(*r, r[1] == first) for r in rows])

    schema = "corpus string, model string, r_squared double, aic double, bic double, asymptote double, params array<double>, best boolean"
    return series.groupBy(by).applyInPandas(models, schema)


def growth_curves(models: DataFrame, series: DataFrame, by: str = "corpus", points: int = 80, ahead: int = 5) -> DataFrame:
    """(corpus, model, i, x, y): growth_models()' curves at `points` evenly spaced years, from the series' first to `ahead` after its last."""
    span = series.where("year IS NOT NULL").groupBy(F.col(by).cast("string").alias("corpus")).agg(F.min("year").alias("_first"), (F.max("year") - F.min("year") + ahead).alias("_span"))
    d = models.join(span, "corpus").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    t, p = F.col("_span") * F.col("i") / max(1, points - 1), lambda k: F.col("params")[k]
    held = lambda x: F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))
    step = lambda k: p(k) / (1 + F.exp(-held(p(k + 1) * (t - p(k + 2)))))
    y = (
        F.when(F.col("model") == "linear", p(0) * t + p(1))
        .when(F.col("model") == "exponential", p(0) * F.exp(held(p(1) * t)))
        .when(F.col("model") == "gompertz", p(0) * F.exp(-p(1) * F.exp(-p(2) * t)))
        .when(F.col("model") == "bilogistic", step(0) + step(3))
    )
    return d.select("corpus", "model", "i", (F.col("_first") + t).alias("x"), y.alias("y"))


def lotka_line(fit: DataFrame, counts: DataFrame, points: int = 60) -> DataFrame:
    """(i, x, y): the fitted law (alpha, c) at evenly spaced logarithms from 1 to the largest n_items of productivity()."""
    d = fit.select("alpha", "c").crossJoin(counts.agg(F.max("n_items").alias("_most")))  # one row each
    d = d.where("_most IS NOT NULL").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.exp(F.ln("_most") * F.col("i") / max(1, points - 1))
    return d.select("i", x.alias("x"), (F.col("c") * F.pow(x, -F.col("alpha"))).alias("y"))
