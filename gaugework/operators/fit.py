"""Least-squares models (inventory 81-90).

Every template but the roofline is linear in its coefficients, so that sums over a group give the
optimum. Templates, slices, folds and nodes are part of the grouping key.
"""

from __future__ import annotations

import ast
import itertools
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.observations import numeric
from gaugework.operators.lineage import broadcast_if_small, written

#: A fit is of use if its error is below this share of that of mean and median.
USEFUL = 0.8

#: Template name -> (f(x), domain); each stands for b0 + b1 f(x). Fixed order, which decides ties.
TEMPLATES: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "linear": (lambda x: x, lambda x: F.lit(True)),
    "logarithmic": (lambda x: F.log(x), lambda x: x > 0),
    "logarithmic1": (lambda x: F.log1p(x), lambda x: x > -1),
    "exponential": (lambda x: F.exp(x), lambda x: x <= 64),
    "square": (lambda x: x * x, lambda x: F.lit(True)),
    "inverse": (lambda x: 1 / x, lambda x: x != 0),
    "sqrt": (lambda x: F.sqrt(x), lambda x: x >= 0),
}


def register_template(name: str, f: Callable[[Column], Column], domain: Callable[[Column], Column] = lambda x: F.lit(True)) -> None:
    """A further template for all later fits."""
    TEMPLATES[name] = (f, domain)


def fit_slices(long: DataFrame, param: str, others, keys=("name", "attr"), templates=None, min_values: int = 3) -> DataFrame:
    """82: for each template and each configuration of the other parameters: b0, b1, sum of squared residuals, and
    those about mean and median. Slices need ``min_values`` different numbers.

    A template goes for a whole key if one of its numbers is outside the domain.
    """
    use = {t: TEMPLATES[t] for t in (templates or TEMPLATES)}
    keys = list(keys)
    rows = long.select(*keys, *others, numeric(param).alias("x"), "value").where("x is not null and value is not null")
    inside = rows.groupBy(*keys).agg(*(F.bool_and(d(F.col("x"))).alias(f"ok_{t}") for t, (_, d) in use.items()))
    each = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(t).alias("template"), F.when(d(F.col("x")), f(F.col("x"))).alias("f")) for i, (t, (f, d)) in enumerate(use.items())))
    points = rows.select(*keys, *others, "x", "value", F.explode(each).alias("e")).select(*keys, *others, "x", "value", "e.*")
    group = [*keys, *others, "rank", "template"]
    n, vy = F.regr_count("value", "f"), F.regr_syy("value", "f")
    out = points.groupBy(*group).agg(
        n.alias("n"), F.count_distinct("x").alias("values"), F.regr_slope("value", "f").alias("b1"), F.regr_intercept("value", "f").alias("b0"),
        F.greatest(vy - F.coalesce(F.regr_sxy("value", "f") ** 2 / F.nullif(F.regr_sxx("value", "f"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("ssr"),
        vy.alias("ssr_mean"), F.median("value").alias("median"), F.avg("value").alias("mean"),
    )
    out = out.withColumn("ssr_median", F.col("ssr_mean") + F.col("n") * (F.col("mean") - F.col("median")) ** 2).where(F.col("values") >= min_values)
    ok = reduce(lambda a, t: F.when(F.col("template") == t, F.col(f"ok_{t}")).otherwise(a), use, F.lit(False))
    return out.join(inside, keys).where(ok).drop(*(f"ok_{t}" for t in use))


def select_template(slices: DataFrame, keys=("name", "attr")) -> DataFrame:
    """83, 84: squared residuals summed over slices; the best template, and whether it is of use."""
    total = slices.groupBy(*keys, "rank", "template").agg(F.sum("ssr").alias("ssr"), F.sum("ssr_mean").alias("ssr_mean"), F.sum("ssr_median").alias("ssr_median"), F.count("*").alias("slices"))
    best = total.groupBy(*keys).agg(F.min(F.struct("ssr", "rank", "template", "ssr_mean", "ssr_median", "slices")).alias("best"))
    return best.select(*keys, "best.template", "best.ssr", "best.ssr_mean", "best.ssr_median", "best.slices").withColumn("useful", F.col("ssr") < USEFUL * F.least("ssr_mean", "ssr_median"))


def roofline(long: DataFrame, keys=("name", "attr"), x: str = "x") -> DataFrame:
    """85: b0 + b1 min(x, b2): the best b2 among the values of x, by running sums over distinct values."""
    keys = list(keys)
    at = long.groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.count("value").alias("n"), F.sum("value").alias("sy"), F.sum(F.col("value") ** 2).alias("syy"))
    w = Window.partitionBy(*keys).orderBy("x")
    every = Window.partitionBy(*keys)
    n, sy, xx = F.col("n"), F.col("sy"), F.col("x")
    cum = at.select(
        *keys, "x", F.sum(n).over(every).alias("N"), F.sum(sy).over(every).alias("SY"), F.sum("syy").over(every).alias("SYY"),
        F.sum(n).over(w).alias("cn"), F.sum(n * xx).over(w).alias("cx"), F.sum(n * xx * xx).over(w).alias("cxx"), F.sum(sy).over(w).alias("cy"), F.sum(sy * xx).over(w).alias("cxy"),
    )
    b = F.col("x")
    sx = F.col("cx") + (F.col("N") - F.col("cn")) * b
    sxx = F.col("cxx") + (F.col("N") - F.col("cn")) * b * b
    sxy = F.col("cxy") + (F.col("SY") - F.col("cy")) * b
    vx, vxy, vy = sxx - sx * sx / F.col("N"), sxy - sx * F.col("SY") / F.col("N"), F.col("SYY") - F.col("SY") ** 2 / F.col("N")
    cand = cum.where(vx > 1e-9).select(*keys, b.alias("b2"), (vxy / vx).alias("b1"), ((F.col("SY") - vxy / vx * sx) / F.col("N")).alias("b0"), (vy - vxy * vxy / vx).alias("ssr"))
    return cand.groupBy(*keys).agg(F.min(F.struct("ssr", "b2", "b1", "b0")).alias("m")).select(*keys, "m.b0", "m.b1", "m.b2", "m.ssr")


#: 86: weights of a squared, scaled residual under each loss (the loss's derivative).
LOSSES: dict[str, Callable[[Column], Column]] = {
    "linear": lambda z: F.lit(1.0),
    "soft_l1": lambda z: 1 / F.sqrt(1 + z),
    "huber": lambda z: F.when(z <= 1, 1.0).otherwise(1 / F.sqrt(z)),
    "cauchy": lambda z: 1 / (1 + z),
    "arctan": lambda z: 1 / (1 + z * z),
}
NO_BOUNDS = ((None, None), (None, None))


def _between(v: Column, bounds) -> Column:
    v = v if bounds[0] is None else F.greatest(v, F.lit(float(bounds[0])))
    return v if bounds[1] is None else F.least(v, F.lit(float(bounds[1])))


def bounded_line(bounds=NO_BOUNDS) -> Column:
    """86: (loss, b0, b1) of the line of least squares within ``bounds`` of both coefficients, from the sums s, sx, sy, sxx, sxy.

    The loss is convex, so that the optimum is the free one or lies on a side of the box, where one coefficient is fixed and
    the other's own optimum is held within its bounds: five candidates at most, all in columns.
    """
    n, sx, sy, sxx, sxy = (F.col(c) for c in ("s", "sx", "sy", "sxx", "sxy"))

    def made(a, b):
        return F.struct((n * a * a + 2 * sx * a * b + sxx * b * b - 2 * sy * a - 2 * sxy * b).alias("loss"), a.alias("b0"), b.alias("b1"))

    slope = (sxy - sx * sy / n) / F.nullif(sxx - sx * sx / n, F.lit(0.0))
    free = (sy - slope * sx) / n
    inside = (_between(free, bounds[0]) == free) & (_between(slope, bounds[1]) == slope)
    each = [F.when(inside, made(free, slope))]
    each += [made(F.lit(float(v)), _between((sxy - v * sx) / F.nullif(sxx, F.lit(0.0)), bounds[1])) for v in bounds[0] if v is not None]
    each += [made(_between((sy - v * sx) / n, bounds[0]), F.lit(float(v))) for v in bounds[1] if v is not None]
    return F.array_min(F.filter(F.array(*each), lambda c: c["b0"].isNotNull() & c["b1"].isNotNull()))


def robust_lines(df: DataFrame, keys, losses, x: str = "x", y: str = "value", scale: float = 1.0, steps: int = 10, lower: float | None = None, bounds=None) -> DataFrame:
    """86: a line for each key and each of ``losses`` (column ``loss``), by reweighted sums in a fixed number of steps.

    ``bounds`` are (least, most) of b0 and of b1, None for none; ``lower`` is short for a least slope. Equal points are counted
    once; the steps of all losses share one chain of jobs over these counts, and rows stay where they are: a model has a row a
    key and loss, and is broadcast.
    """
    bounds = bounds or ((None, None), (lower, None))
    keys, k = list(keys), [*keys, "loss"]
    points = written(df.groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_c")))
    each = points.withColumn("loss", F.explode(F.array(*(F.lit(v) for v in losses))))
    model = None
    for _ in range(1 if set(losses) == {"linear"} else steps):
        if model is None:
            weighted = each.withColumn("_w", F.col("_c").cast("double"))
        else:
            res = (F.col("_y") - F.col("b0") - F.col("b1") * F.col("_x")) / scale
            weight = reduce(lambda out, v: F.when(F.col("loss") == v, LOSSES[v](res * res)).otherwise(out), losses, F.lit(None).cast("double"))
            weighted = each.join(broadcast_if_small(model), k).withColumn("_w", F.col("_c") * weight)
        w, a, b = F.col("_w"), F.col("_x"), F.col("_y")
        s = weighted.groupBy(*k).agg(F.sum(w).alias("s"), F.sum(w * a).alias("sx"), F.sum(w * b).alias("sy"), F.sum(w * a * a).alias("sxx"), F.sum(w * a * b).alias("sxy"))
        model = written(s.select(*k, bounded_line(bounds).alias("_m")).select(*k, "_m.b1", "_m.b0"))  # each step reads the last one's model and not what made it
    return model


def robust_line(df: DataFrame, keys, x: str = "x", y: str = "value", scale: float = 1.0, steps: int = 10, lower: float | None = None, loss: str = "soft_l1", bounds=None) -> DataFrame:
    """86: ``robust_lines`` under one of ``LOSSES``."""
    return robust_lines(df, keys, [loss], x, y, scale, steps, lower, bounds).drop("loss")


def powerset(functions: dict[str, str], independent: bool = False, intercept: bool = True, full_only: bool = False) -> list[tuple[tuple[str, str], ...]]:
    """87: the design terms: products over every subset of (param, template), in order of parameters."""
    pairs = sorted(functions.items())
    if independent:
        return [()] * intercept + [(p,) for p in pairs]
    if len(pairs) > 10:
        raise ValueError("over 10 parameters make too many products; use independent terms")
    subsets = [s for k in range(len(pairs) + 1) for s in itertools.combinations(pairs, k)]
    if full_only:
        subsets = [(), tuple(pairs)]
    return [s for s in subsets if s or intercept]


def fol_terms(params, order: int = 0) -> list[tuple[tuple[str, str], ...]]:
    """90: first-order terms; order 1: pair products only; 2: both."""
    one = [((p, "linear"),) for p in sorted(params)]
    two = [(a, b) for (a,), (b,) in itertools.combinations(one, 2)]
    return [(), *(one if order != 1 else []), *(two if order else [])]


def term(t) -> Column:
    """A design column."""
    return reduce(lambda a, b: a * b, [TEMPLATES[f][0](numeric(p)) for p, f in t], F.lit(1.0))


def gram(df: DataFrame, columns: list[Column], y: Column, keys=()) -> list:
    """Sums of products of design columns and the target: one row for each key, in one pass."""
    k = len(columns)
    named = df.select(*keys, *(c.cast("double").alias(f"_{i}") for i, c in enumerate(columns)), y.cast("double").alias("_y"))
    good = reduce(lambda a, b: a & b, [F.col(f"_{i}").isNotNull() for i in range(k)], F.col("_y").isNotNull())
    sums = [F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col(f"_{i}") * F.col("_y")).alias(f"r{i}") for i in range(k)]
    return named.where(good).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_y") ** 2).alias("yy"), *sums).collect()


def solve(row, k: int) -> np.ndarray:
    """Minimum-norm coefficients of one row of sums, after scaling the columns."""
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"]
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return np.linalg.pinv(g / np.outer(scale, scale), rcond=1e-12, hermitian=True) @ (np.array([row[f"r{i}"] for i in range(k)]) / scale) / scale


def joint_fit(df: DataFrame, terms, value: str = "value", keys=("name", "attr"), min_configs: int = 3) -> DataFrame:
    """88: coefficients of a product design for each key: keys, n, beta (in order of terms).

    Keys need ``min_configs`` configurations that are numbers in all parameters used.
    """
    used = sorted({p for t in terms for p, _ in t})
    rows = df.where(reduce(lambda a, b: a & b, [numeric(p).isNotNull() for p in used], F.lit(True)))
    enough = rows.groupBy(*keys).agg(F.count_distinct(*(F.col(p) for p in used)).alias("c")).where(F.col("c") >= min_configs) if used else rows.select(*keys).distinct()
    rows = rows.join(broadcast_if_small(written(enough.select(*keys))), list(keys), "left_semi")
    found = gram(rows, [term(t) for t in terms], F.col(value), keys)
    data = [(*(r[k] for k in keys), r["n"], solve(r, len(terms)).tolist()) for r in found]
    shape = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    return df.sparkSession.createDataFrame(data, f"{shape}, n long, beta array<double>")


def predict_joint(df: DataFrame, model: DataFrame, terms, keys=("name", "attr")) -> DataFrame:
    """Rows with ``predicted``, null where a parameter is no number."""
    total = reduce(lambda a, b: a + b, [F.col("beta")[i] * term(t) for i, t in enumerate(terms)])
    return df.join(broadcast_if_small(model.select(*keys, "beta")), list(keys)).withColumn("predicted", total).drop("beta")


_CALLS = {"sqrt": F.sqrt, "log": F.log, "log1p": F.log1p, "exp": F.exp, "abs": F.abs, "min": F.least, "max": F.greatest}
_OPS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Pow: lambda a, b: F.pow(a, b)}


def formula(text: str, betas) -> tuple[Column, list[int]]:
    """89: ``regression_arg(i)``, ``parameter(p)`` and ``function_arg(i)`` text as a column, by a whitelist of syntax.

    ``betas`` gives the column of coefficient i. Also returns the coefficients used.
    """
    used: set[int] = set()

    def walk(node) -> Column:
        match node:
            case ast.Expression():
                return walk(node.body)
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.BinOp():
                return _OPS[type(node.op)](walk(node.left), walk(node.right))
            case ast.UnaryOp(op=ast.USub()):
                return -walk(node.operand)
            case ast.Call(func=ast.Name(id="regression_arg"), args=[ast.Constant(value=int() as i)]):
                used.add(i)
                return betas(i)
            case ast.Call(func=ast.Name(id="parameter"), args=[ast.Name(id=p) | ast.Constant(value=str() as p)]):
                return numeric(p)
            case ast.Call(func=ast.Name(id="function_arg"), args=[ast.Constant(value=int() as i)]):
                return numeric(f"arg{i}")
            case ast.Call(func=ast.Name(id=f)) if f in _CALLS:
                return _CALLS[f](*map(walk, node.args))
        raise ValueError(f"not allowed in a function: {ast.dump(node)[:60]}")

    return walk(ast.parse(text, mode="eval")), sorted(used)


def fit_formula(df: DataFrame, text: str, value: str = "value", steps: int = 12) -> np.ndarray:
    """89: coefficients from 1 by Gauss-Newton; each step is one aggregate. Functions linear in them need one step."""
    _, used = formula(text, lambda i: F.lit(1.0))
    k = max(used) + 1
    beta = np.ones(k)
    for _ in range(steps):
        now, h = formula(text, lambda i: F.lit(float(beta[i])))[0], 1e-5
        slopes = []
        for j in range(k):
            d = h * max(1.0, abs(beta[j]))
            up = formula(text, lambda i: F.lit(float(beta[i] + d * (i == j))))[0]  # noqa: B023
            low = formula(text, lambda i: F.lit(float(beta[i] - d * (i == j))))[0]  # noqa: B023
            slopes.append((up - low) / (2 * d))
        rows = gram(df, slopes, F.col(value) - now)
        if not rows or not rows[0]["n"]:
            break
        move = solve(rows[0], k)
        beta = beta + move
        if np.abs(move).max() < 1e-9 * max(1.0, np.abs(beta).max()):
            break
    return beta


def predict_formula(df: DataFrame, text: str, beta) -> DataFrame:
    return df.withColumn("predicted", formula(text, lambda i: F.lit(float(beta[i])))[0])
