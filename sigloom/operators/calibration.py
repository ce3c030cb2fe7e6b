"""Calibration: fits whose gradients are summed by Spark, and their application; losses as row expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from .metrics import argmax, calibration_error, softmax


def platt(rows: DataFrame, logit: str = "logit", label: str = "label", steps: int = 25) -> tuple[float, float]:
    """a, b of sigmoid(a * logit + b) by Newton's method; each step is one aggregate of five sums. a stays in 0.01..10."""
    a, b = 1.0, 0.0
    rows = rows.select(F.col(logit).cast("double").alias("x"), F.col(label).cast("double").alias("y"))
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
        w, r, x = p * (1 - p), p - F.col("y"), F.col("x")
        s = rows.agg(*[F.avg(c) for c in (r * x, r, w * x * x, w * x, w)]).first()
        if s is None or s[0] is None:
            raise ValueError("no rows to fit")
        ga, gb, haa, hab, hbb = s
        det = (haa + 1e-9) * (hbb + 1e-9) - hab * hab
        da, db = ((hbb + 1e-9) * ga - hab * gb) / det, ((haa + 1e-9) * gb - hab * ga) / det
        a, b = min(10.0, max(0.01, a - da)), b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def platt_document(rows: DataFrame, path: str, logit: str = "logit", label: str = "label") -> dict:
    """Fits a and b, and writes them with the error before and after as a small JSON document, which is also given back.
    A calibration that does not lower the error is written all the same, with improved = false."""
    a, b = platt(rows, logit, label)
    n = rows.where(F.col(logit).isNotNull() & F.col(label).isNotNull()).count()
    error = lambda x: calibration_error(rows.select((1 / (1 + F.exp(-x))).alias("p"), F.col(label).alias("y")), "p", "y").first()["ece"]
    before, after = error(F.col(logit).cast("double")), error(F.lit(a) * F.col(logit) + F.lit(b))
    out = {"platt_a": a, "platt_b": b, "ece_before": before, "ece_after": after, "n_val_samples": n, "improved": after < before}
    sinks.write_json(rows.sparkSession, out, path)
    return out


def calibration_of(spark: SparkSession, path: str) -> tuple[float, float]:
    """a and b of a document that `platt_document` wrote."""
    values = json.loads("".join(r["value"] for r in spark.read.text(path).collect()))
    if missing := {"platt_a", "platt_b"} - set(values):
        raise ValueError(f"{path}: missing {sorted(missing)}")
    return float(values["platt_a"]), float(values["platt_b"])


def temperature(rows: DataFrame, logits: str = "logits", label: str = "label", low: float = 0.1, high: float = 10.0, steps: int = 40) -> DataFrame:
    """temperature, nll: the temperature of the least mean negative log likelihood, kept in low..high. The loss is convex in
    the inverse temperature b, so Newton's method in a bracket of its slope finds it; a step is one aggregate."""
    spark, data = rows.sparkSession, rows.select(F.col(logits).cast("array<double>").alias("z"), F.col(label).alias("y"))
    top, truth = F.array_max("z"), F.get("z", F.col("y"))

    def at(b: float) -> tuple[float, float, float]:
        e = F.transform("z", lambda x: F.struct(x.alias("x"), F.exp((x - top) * b).alias("e")))
        sums = F.aggregate("e", F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, v: F.struct((a["n"] + v["e"]).alias("n"), (a["s"] + v["e"] * v["x"]).alias("s"), (a["q"] + v["e"] * v["x"] * v["x"]).alias("q")))
        each = data.select(top.alias("top"), truth.alias("truth"), e.alias("e")).select("top", "truth", sums.alias("a"))
        mean = F.col("a.s") / F.col("a.n")
        found = each.agg(F.avg(F.col("top") * b + F.ln("a.n") - F.col("truth") * b), F.avg(mean - F.col("truth")), F.avg(F.col("a.q") / F.col("a.n") - mean * mean)).first()
        if found[0] is None:
            raise ValueError("no rows to fit")
        return found[0], found[1], found[2]

    lo, hi, b = 1 / high, 1 / low, 1 / 1.5
    for _ in range(steps):
        _, slope, curve = at(b)
        lo, hi = (b, hi) if slope < 0 else (lo, b)
        new = b - slope / curve if curve > 0 else (lo + hi) / 2
        new = new if lo < new < hi else (lo + hi) / 2
        done, b = abs(new - b) < 1e-12 * b, new
        if done:
            break
    return spark.createDataFrame([(round(1 / b, 6), round(at(b)[0], 6))], "temperature double, nll double")


def linear_map(rows: DataFrame, kind: str, logits: str = "logits", label: str = "label", penalty: float = 0.01, steps: int = 40, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """matrix: W, b of W * logits + b with W drawn to the identity; dirichlet: alpha, beta of alpha * log_softmax + beta
    with alpha drawn to 1. Gradient steps; the gradient's sums are made in the tasks."""
    if kind not in ("matrix", "dirichlet"):
        raise ValueError(f"kind is matrix or dirichlet, not {kind!r}")
    k = rows.select(F.size(logits)).first()[0]
    w, b = (np.eye(k) if kind == "matrix" else np.ones(k)), np.zeros(k)
    data = rows.select(F.col(logits).alias("x"), F.col(label).alias("y"))
    for _ in range(steps):
        now = (w.copy(), b.copy())

        def sums(batches: Iterator[pd.DataFrame], now: tuple = now) -> Iterator[pd.DataFrame]:
            gw, gb, n = np.zeros_like(now[0]), np.zeros(k), 0
            for batch in batches:
                x, y = np.stack(batch["x"].to_numpy()), batch["y"].to_numpy()
                if kind == "dirichlet":
                    x = x - x.max(1, keepdims=True)
                    x = x - np.log(np.exp(x).sum(1, keepdims=True))
                z = x @ now[0].T + now[1] if kind == "matrix" else x * now[0] + now[1]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                gw += p.T @ x if kind == "matrix" else (p * x).sum(0)
                gb, n = gb + p.sum(0), n + len(y)
            values = np.concatenate((gw.ravel(), gb, [n]))
            yield pd.DataFrame({"i": np.arange(len(values)), "v": values})

        total = data.mapInPandas(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
        n = max(total[-1], 1)
        target = np.eye(k) if kind == "matrix" else np.ones(k)
        w = w - rate * (total[: w.size].reshape(w.shape) / n + 2 * penalty * (w - target)) / k
        b = b - rate * total[w.size : w.size + k] / n
    return w, b


def applied(logits: Column, params: dict) -> Column:
    """Calibrated logits."""
    if params["method"] == "temperature":
        return F.transform(logits, lambda x: x / params["t"])
    row = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    if params["method"] == "matrix":
        return F.transform(F.arrays_zip(F.array(*[row(r) for r in params["w"]]).alias("r"), row(params["b"]).alias("c")), lambda t: F.aggregate(F.arrays_zip(t["r"].alias("w"), logits.alias("x")), t["c"], lambda s, p: s + p["w"] * p["x"]))
    if params["method"] == "dirichlet":
        logs = F.transform(softmax(logits), F.ln)
        return F.transform(F.arrays_zip(logs.alias("x"), row(params["w"]).alias("w"), row(params["b"]).alias("c")), lambda t: t["x"] * t["w"] + t["c"])
    raise ValueError(f"no calibration {params['method']!r}")


def calibrate(rows: DataFrame, method: str = "temperature", logits: str = "logits", label: str = "label") -> dict:
    """A fit with what it does: its parameters, the expected calibration error before and after, whether it improved, the
    number of rows and of classes."""
    if method == "temperature":
        params = {"method": method, "t": temperature(rows, logits, label).first()["temperature"]}
    else:
        w, b = linear_map(rows, method, logits, label)
        params = {"method": method, "w": w.tolist(), "b": b.tolist()}

    def error(z: Column) -> float:
        sure = rows.select(softmax(z).alias("p"), label).select(F.array_max("p").alias("c"), (argmax(F.col("p")) == F.col(label)).alias("right"))
        return calibration_error(sure, "c", "right").first()["ece"]

    before, after = error(F.col(logits)), error(applied(F.col(logits), params))
    n, classes = rows.agg(F.count("*"), F.max(F.size(logits))).first()
    return params | {"ece_before": before, "ece_after": after, "improved": after < before, "n": n, "classes": classes}


#: The confounder's class of a base.
BASE_CLASSES = {"A": 0, "C": 1, "G": 2, "T": 3}


def confound_classes(labels: DataFrame, bases: DataFrame) -> DataFrame:
    """label_int, confound: labels (name, label_int) by their discriminating base (name, base). A name without a base has no
    row, so that a loss passes it over; another base than ACGT is an error."""
    known = F.create_map(*[F.lit(x) for pair in BASE_CLASSES.items() for x in pair])
    joined = labels.join(bases.where(F.col("base").isNotNull()), "name")
    wrong = F.raise_error(F.concat(F.lit("no base: "), F.col("base"))).cast("int")
    return joined.select("label_int", F.coalesce(F.try_element_at(known, F.col("base")), wrong).alias("confound"))


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b); a null is the logarithm of 0."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(high + F.log1p(F.exp(low - high)))


def noisy_bce(logit: Column, label: Column, rate: Column, positive: float = 1.0) -> Column:
    """Cross entropy of an observed label that is flipped at the given rate: P(1) = (1 - r) p + r (1 - p). A missing rate
    is 0. positive: the weight of the ones."""
    logit, rate = logit.cast("double"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(rate.cast("double"), F.lit(0.0))))
    soft = F.log1p(F.exp(-F.abs(logit)))
    one, zero = F.least(logit, F.lit(0.0)) - soft, F.least(-logit, F.lit(0.0)) - soft
    keep, flip = F.when(rate < 1, F.log1p(-rate)), F.when(rate > 0, F.ln(rate))
    return -(label * positive * log_add(keep + one, flip + zero) + (1 - label) * log_add(keep + zero, flip + one))


def focal(logit: Column, label: Column, gamma_one: float = 2.0, gamma_zero: float | None = None) -> Column:
    """Focal loss, with its own exponent for zeros if given."""
    gamma_zero = gamma_one if gamma_zero is None else gamma_zero
    if min(gamma_one, gamma_zero) < 0:
        raise ValueError("gamma must not be negative")
    p = 1 / (1 + F.exp(-logit))
    hit = F.greatest(F.lit(1e-7), F.when(label == 1, p).otherwise(1 - p))
    return -F.pow(1 - hit, F.when(label == 1, gamma_one).otherwise(gamma_zero)) * F.ln(hit)


def noise_rates(text: str) -> dict[str, float]:
    """`group=rate,group=rate`; rates are in [0, 1)."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, rate = part.partition("=")
        if not name or not 0 <= float(rate) < 1:
            raise ValueError(f"not a group and a rate in [0, 1): {part!r}")
        out[name.strip()] = float(rate)
    return out


def with_rates(rows: DataFrame, field: str, rates: dict[str, float]) -> DataFrame:
    """The rows with noise_rate by their group: 0 for a group without one; null and empty groups are `unknown`."""
    from .splits import group_name

    named = rows.withColumn(field, group_name(field))
    if not rates:
        return named.withColumn("noise_rate", F.lit(0.0))
    table = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    return named.withColumn("noise_rate", F.coalesce(F.try_element_at(table, F.col(field)), F.lit(0.0)))


def warmup_cosine(step: Column, steps: int, warmup: int, end: float) -> Column:
    """Learning-rate factor: linear to 1 over the warm-up, then half a cosine to `end`."""
    part = (step - warmup) / F.lit(float(max(1, steps - warmup)))
    return F.when(step < warmup, (step + 1) / F.lit(float(max(1, warmup)))).otherwise(end + (1 - end) * 0.5 * (1 + F.cos(np.pi * F.least(F.lit(1.0), part))))


def codes(rows: DataFrame, source: str) -> DataFrame:
    """value -> code of a confounder's distinct non-empty values, in order; rows without a value are coded -1 at use."""
    from pyspark.sql import Window

    values = rows.select(F.col(source).cast("string").alias("value")).where(F.coalesce("value", F.lit("")) != "").distinct()
    return values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("code"))
