"""Model queries (inventory 81-111, 24, 23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import assess, boosting, fit, grove, modelstore, stats, trees
from gaugework.plans.lineitem import LONG, observations, r
from gaugework.plans.registry import query, scratch, table

VOLUME = """vol AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000003 + l_partkey AS obs_id, l_returnflag AS name, l_linestatus AS status, l_quantity AS quantity, p_size AS size, 'volume' AS attr, l_quantity * p_retailprice AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
FX = """('linear', 0, quantity), ('logarithmic', 1, ln(quantity)), ('logarithmic1', 2, ln(1 + quantity)), ('exponential', 3, exp(quantity)), ('square', 4, quantity * quantity),
  ('inverse', 5, 1 / quantity), ('sqrt', 6, sqrt(quantity))"""


def volume(spark, sf_dir):
    """Quantity times retail price: an attribute that is linear in a parameter."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_003 + F.col("l_partkey")).alias("obs_id"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("quantity"), F.col("p_size").alias("size"), F.lit("volume").alias("attr"), (F.col("l_quantity") * F.col("p_retailprice")).alias("value"),
    )


SLICES = f"""WITH {VOLUME}, e AS (SELECT vol.*, t.template, t.rank, t.f FROM vol, LATERAL (VALUES {FX}) t(template, rank, f)),
s AS (SELECT name, attr, status, rank, template, count(*) AS n, regr_slope(value, f) AS b1, regr_intercept(value, f) AS b0,
  regr_syy(value, f) - regr_sxy(value, f) ** 2 / regr_sxx(value, f) AS ssr, regr_syy(value, f) AS ssr_mean FROM e GROUP BY ALL)"""


@query("q82_slice_fit", f"{SLICES} SELECT name, status, template, n, round(b0, 4) AS b0, round(b1, 4) + 0.0 AS b1, round(sqrt(ssr / n), 4) AS rms FROM s")
def slice_fit(spark, sf_dir):
    s = fit.fit_slices(volume(spark, sf_dir), "quantity", ["status"])
    return s.select("name", "status", "template", "n", r("b0", 4), (F.round("b1", 4) + 0.0).alias("b1"), F.round(F.sqrt(F.col("ssr") / F.col("n")), 4).alias("rms"))


@query("q83_template_selection", f"""{SLICES}, t AS (SELECT name, rank, template, sum(ssr) AS ssr, sum(ssr_mean) AS m FROM s GROUP BY ALL)
SELECT name, arg_min(template, ssr) AS template, round(min(ssr) / arg_min(m, ssr), 6) AS share, min(ssr) < 0.8 * arg_min(m, ssr) AS useful FROM t GROUP BY name""")
def template_selection(spark, sf_dir):
    best = fit.select_template(fit.fit_slices(volume(spark, sf_dir), "quantity", ["status"]))
    return best.select("name", "template", F.round(F.col("ssr") / F.col("ssr_mean"), 6).alias("share"), "useful")


@query("q85_roofline", f"""WITH {VOLUME}, v AS (SELECT name, attr, quantity::DOUBLE AS x, least(quantity, 30) * 1500 + value / 100 AS y FROM vol), b AS (SELECT DISTINCT name, attr, x AS b2 FROM v),
f AS (SELECT name, attr, b2, regr_slope(y, least(x, b2)) AS b1, regr_intercept(y, least(x, b2)) AS b0, regr_syy(y, least(x, b2)) * (1 - regr_r2(y, least(x, b2))) AS ssr
  FROM v JOIN b USING (name, attr) GROUP BY ALL HAVING regr_sxx(y, least(x, b2)) > 1e-9)
SELECT name, attr, round(arg_min(b0, ssr), 2) AS b0, round(arg_min(b1, ssr), 4) AS b1, arg_min(b2, ssr) AS b2, round(min(ssr) / 1e6, 2) AS ssr_millions FROM f GROUP BY name, attr""")
def roofline(spark, sf_dir):
    capped = volume(spark, sf_dir).withColumn("value", F.least("quantity", F.lit(30.0)) * 1500 + F.col("value") / 100)
    line = fit.roofline(capped.withColumn("x", F.col("quantity")))
    return line.select("name", "attr", F.round("b0", 2).alias("b0"), F.round("b1", 4).alias("b1"), "b2", F.round(F.col("ssr") / 1e6, 2).alias("ssr_millions"))


def _reweighted(steps: int, scale: float) -> str:
    """One aggregate a step, each with the weights of the line before it."""
    out = f"{VOLUME}, v AS (SELECT name, quantity::DOUBLE AS x, value AS y FROM vol), m0 AS (SELECT name, 0.0 AS b0, 0.0 AS b1 FROM v GROUP BY name)"
    for k in range(1, steps + 1):
        w = f"1 / sqrt(1 + power((y - b0 - b1 * x) / {scale}, 2))" if k > 1 else "1.0"
        out += f""", m{k} AS (SELECT name, (sy - b1 * sx) / s AS b0, b1 FROM (SELECT *, greatest(0, (sxy - sx * sy / s) / (sxx - sx * sx / s)) AS b1 FROM (
  SELECT name, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM (SELECT name, x, y, {w} AS w FROM v JOIN m{k - 1} USING (name)) GROUP BY name)))"""
    return f"WITH {out} SELECT name, round(b0, 3) AS b0, round(b1, 4) AS b1 FROM m{steps}"


@query("q86_robust_line", _reweighted(10, 1000.0))
def robust_line(spark, sf_dir):
    line = fit.robust_line(volume(spark, sf_dir), ["name"], "quantity", scale=1000.0, lower=0.0)
    return line.select("name", F.round("b0", 3).alias("b0"), F.round("b1", 4).alias("b1"))


BOUNDS = ((500.0, 4000.0), (None, 1300.0))
WEIGHTS = {"linear": "1.0", "soft_l1": "1 / sqrt(1 + z)", "huber": "CASE WHEN z <= 1 THEN 1.0 ELSE 1 / sqrt(z) END", "cauchy": "1 / (1 + z)", "arctan": "1 / (1 + z * z)"}


def _faces(steps: int, scale: float) -> str:
    """The reweighted sums of all losses, a step an aggregate; the best of the free line and of those on the sides of the box."""
    (lo, hi), (_, most) = BOUNDS
    weight = "CASE loss " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.items()) + " END"
    out = f"{VOLUME}, v AS (SELECT name, loss, quantity::DOUBLE AS x, value AS y FROM vol, (VALUES {', '.join(f'({k!r})' for k in WEIGHTS)}) l(loss)), m0 AS (SELECT name, loss, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM v GROUP BY ALL)"
    for k in range(1, steps + 1):
        w = weight if k > 1 else "1.0"
        out += f""", s{k} AS (SELECT name, loss, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy
  FROM (SELECT name, loss, x, y, {w} AS w FROM (SELECT *, power((y - b0 - b1 * x) / {scale}, 2) AS z FROM v JOIN m{k - 1} USING (name, loss))) GROUP BY ALL),
f{k} AS (SELECT *, (sy - slope * sx) / s AS free FROM (SELECT *, (sxy - sx * sy / s) / (sxx - sx * sx / s) AS slope FROM s{k})),
c{k} AS (SELECT name, loss, s, sx, sy, sxx, sxy, free AS b0, slope AS b1 FROM f{k} WHERE free BETWEEN {lo} AND {hi} AND slope <= {most}
  UNION ALL SELECT name, loss, s, sx, sy, sxx, sxy, {lo}, least((sxy - {lo} * sx) / sxx, {most}) FROM f{k} UNION ALL SELECT name, loss, s, sx, sy, sxx, sxy, {hi}, least((sxy - {hi} * sx) / sxx, {most}) FROM f{k}
  UNION ALL SELECT name, loss, s, sx, sy, sxx, sxy, least(greatest((sy - {most} * sx) / s, {lo}), {hi}), {most} FROM f{k}),
m{k} AS (SELECT name, loss, arg_min(b0, q) AS b0, arg_min(b1, q) AS b1 FROM (SELECT *, s * b0 * b0 + 2 * sx * b0 * b1 + sxx * b1 * b1 - 2 * sy * b0 - 2 * sxy * b1 AS q FROM c{k}) GROUP BY ALL)"""
    return f"WITH {out} SELECT name, loss, round(b0, 3) AS b0, round(b1, 4) AS b1 FROM m{steps} WHERE loss <> 'linear' UNION ALL SELECT name, loss, round(b0, 3), round(b1, 4) FROM m1 WHERE loss = 'linear'"


@query("q86_bounded_losses", _faces(6, 5000.0))
def bounded_losses(spark, sf_dir):
    """Lines under all losses, with bounds on both coefficients."""
    lines = fit.robust_lines(volume(spark, sf_dir), ["name"], list(fit.LOSSES), "quantity", scale=5000.0, steps=6, bounds=BOUNDS)
    return lines.select("name", "loss", F.round("b0", 3).alias("b0"), F.round("b1", 4).alias("b1"))


@query("q87_joint_fit", f"""WITH {VOLUME}, m AS (SELECT name, regr_slope(value, quantity) AS b, regr_intercept(value, quantity) AS a FROM vol GROUP BY name)
SELECT name, count(*) AS count, round(avg(abs(value - a - b * quantity)), 4) AS mae FROM vol JOIN m USING (name) GROUP BY name""")
def joint_fit(spark, sf_dir):
    rows, terms = volume(spark, sf_dir), fit.powerset({"quantity": "linear"})
    model = fit.joint_fit(rows, terms)
    return assess.metrics(fit.predict_joint(rows, model, terms), ["name"]).select("name", "count", r("mae", 4))


@query("q88_powerset_fit")
def powerset_fit(spark, sf_dir):
    rows, terms = volume(spark, sf_dir), fit.powerset({"quantity": "linear", "size": "sqrt"})
    return fit.joint_fit(rows, terms)


def _moments(rows, terms):
    """Mean of prediction times term: what least squares make equal to the mean of value times term, for each term."""
    fitted = fit.predict_joint(rows, fit.joint_fit(rows, terms), terms)
    return fitted.groupBy("name").agg(*(F.round(F.avg(F.col("predicted") * fit.term(t)), 2).alias(f"m{i}") for i, t in enumerate(terms)))


@query("q88_powerset_moments", f"WITH {VOLUME} SELECT name, round(avg(value), 2) AS m0, round(avg(value * quantity), 2) AS m1, round(avg(value * sqrt(size)), 2) AS m2, round(avg(value * quantity * sqrt(size)), 2) AS m3 FROM vol GROUP BY name")
def powerset_moments(spark, sf_dir):
    return _moments(volume(spark, sf_dir), fit.powerset({"quantity": "linear", "size": "sqrt"}))


@query("q89_formula_fit", f"""WITH {VOLUME}, m AS (SELECT regr_slope(value, quantity) AS b, regr_intercept(value, quantity) AS a FROM vol)
SELECT round(a, 2) AS b0, round(b, 4) AS b1 FROM m""")
def formula_fit(spark, sf_dir):
    beta = fit.fit_formula(volume(spark, sf_dir), "regression_arg(0) + regression_arg(1) * parameter(quantity)")
    return spark.createDataFrame([tuple(map(float, beta))], "b0 double, b1 double").select(r("b0", 2), r("b1", 4))


@query("q90_first_order_linear")
def first_order_linear(spark, sf_dir):
    return fit.joint_fit(volume(spark, sf_dir), fit.fol_terms(["quantity", "size"], 2))


@query("q91_split_losses", f"""WITH {VOLUME}
SELECT name, 'quantity' AS param, round(sum(n * v) / sum(n), 2) AS loss FROM (SELECT name, quantity, count(*) AS n, var_pop(value) AS v FROM vol GROUP BY ALL) GROUP BY name
UNION ALL SELECT name, 'size', round(sum(n * v) / sum(n), 2) FROM (SELECT name, size, count(*) AS n, var_pop(value) AS v FROM vol GROUP BY ALL) GROUP BY name
UNION ALL SELECT name, 'status', round(sum(n * v) / sum(n), 2) FROM (SELECT name, status, count(*) AS n, var_pop(value) AS v FROM vol GROUP BY ALL) GROUP BY name""")
def split_losses(spark, sf_dir):
    rows = volume(spark, sf_dir).select("name", "value", *(F.col(p).cast("string").alias(p) for p in ("quantity", "size", "status"))).unpivot(["name", "value"], ["quantity", "size", "status"], "param", "v")
    g = rows.groupBy("name", "param", "v").agg(F.count("*").alias("n"), F.var_pop("value").alias("var"))
    return g.groupBy("name", "param").agg(F.round(F.sum(F.col("n") * F.col("var")) / F.sum("n"), 2).alias("loss"))


@query("q90_first_order_moments", f"WITH {VOLUME} SELECT name, round(avg(value), 2) AS m0, round(avg(value * quantity), 2) AS m1, round(avg(value * size), 2) AS m2, round(avg(value * quantity * size), 2) AS m3 FROM vol GROUP BY name")
def first_order_moments(spark, sf_dir):
    return _moments(volume(spark, sf_dir), fit.fol_terms(["quantity", "size"], 2))


def _grove(spark, sf_dir, **options):
    """A tree for each name and attribute, all of them grown in one chain of jobs."""
    obs = observations(spark, sf_dir)
    return grove.grow(grove.moments(obs.long(), obs.params), obs.params, **{"relevant": False, "threshold": 0.0, **options})


CONFIGS = f"""{LONG}, c AS (SELECT name, attr, quantity, status, sum(value) AS s, count(*) AS n FROM long GROUP BY ALL),
k AS (SELECT name, attr, quantity, count(*) AS k, sum(n) AS kn FROM c GROUP BY ALL)"""


@query("q98_tree_rules", f"""WITH {CONFIGS}
SELECT name, attr, quantity, CASE WHEN k > 1 THEN status END AS status, round(sum(s) / sum(n), 4) AS value FROM c JOIN k USING (name, attr, quantity) GROUP BY ALL""")
def tree_rules(spark, sf_dir):
    """Rules of the trees of all names and attributes at full depth: with all deviations split, a leaf is a configuration."""
    found = grove.rules(grove.prune(_grove(spark, sf_dir)))
    of = lambda p: F.filter("path", lambda s: s["param"] == p)
    each = found.withColumns({"quantity": F.explode(F.get(of("quantity"), F.lit(0))["values"]), "status": F.get(F.get(of("status"), F.lit(0))["values"], F.lit(0))})
    return each.select("name", "attr", F.col("quantity").cast("double").alias("quantity"), "status", r("value", 4))


@query("q91_keyed_splits", f"""WITH {LONG}, l AS (
  SELECT name, attr, 'quantity' AS param, sum(n * v) AS loss FROM (SELECT name, attr, quantity, count(*) AS n, var_pop(value) AS v FROM long GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT name, attr, 'status', sum(n * v) FROM (SELECT name, attr, status, count(*) AS n, var_pop(value) AS v FROM long GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1)
SELECT name, attr, arg_min(param, loss) AS param, n, round(value, 4) AS value FROM l JOIN (SELECT name, attr, count(*) AS n, avg(value) AS value FROM long GROUP BY ALL) USING (name, attr) GROUP BY ALL""")
def keyed_splits(spark, sf_dir):
    """The root of every tree: its size, mean and first split."""
    return _grove(spark, sf_dir, max_depth=1).nodes.where("level = 0").select("name", "attr", "param", "n", r("value", 4))


@query("q118_tree_folds", f"""WITH {LONG}, f AS (SELECT *, (obs_id % 5)::INT AS fold FROM long), t AS (SELECT name, attr, k AS fold, quantity, avg(value) AS p FROM f, range(5) g(k) WHERE fold <> k GROUP BY ALL)
SELECT name, attr, count(*) AS count, round(avg(abs(value - p)), 4) AS mae FROM f JOIN t USING (name, attr, fold, quantity) GROUP BY ALL""")
def tree_folds(spark, sf_dir):
    """Trees of quantity for all names, attributes and folds in one chain of jobs; a fold's rows are merged out of the moments of the others."""
    obs = observations(spark, sf_dir)
    rows = obs.long().withColumn("fold", (F.col("obs_id") % 5).cast("int"))
    keys = ("name", "attr", "fold")
    config = grove.complements(grove.moments(rows, ["quantity"], keys), ["quantity"])
    grown = grove.grow(config, ["quantity"], keys, relevant=False, threshold=0.0)
    seen = rows.join(config.select(*keys, "quantity"), [*keys, "quantity"], "left_semi")
    return assess.metrics(grove.predict(seen, grown), ["name", "attr"], wanted=("count", "mae")).select("name", "attr", "count", r("mae", 4))


@query("q110_tree_prediction", f"WITH {VOLUME}, m AS (SELECT quantity, status, avg(value) AS p FROM vol GROUP BY ALL) SELECT name, count(*) AS count, round(avg(abs(value - p)), 4) AS mae FROM vol JOIN m USING (quantity, status) GROUP BY name")
def tree_prediction(spark, sf_dir):
    rows = volume(spark, sf_dir)
    tree = trees.grow(rows, ["quantity", "status"], relevant=False, threshold=0.0)
    return assess.metrics(trees.predict(rows, tree, ["quantity", "status"]), ["name"], wanted=("count", "mae")).select("name", "count", r("mae", 4))


@query("q96_tree_by_information", f"WITH {VOLUME}, m AS (SELECT quantity, avg(value) AS p FROM vol GROUP BY ALL) SELECT name, count(*) AS count, round(avg(abs(value - p)), 4) AS mae FROM vol JOIN m USING (quantity) GROUP BY name")
def tree_by_information(spark, sf_dir):
    """Of quantity and status only the first has information on the means."""
    rows = volume(spark, sf_dir)
    tree = trees.grow(rows, ["quantity", "status"], relevant="information", threshold=0.0, least_information=1.0)
    return assess.metrics(trees.predict(rows, tree, ["quantity", "status"]), ["name"], wanted=("count", "mae")).select("name", "count", r("mae", 4))


@query("q97_tree_threshold", f"WITH {VOLUME}, m AS (SELECT avg(value) AS p FROM vol) SELECT name, count(*) AS count, round(avg(abs(value - p)), 4) AS mae FROM vol, m GROUP BY name")
def tree_threshold(spark, sf_dir):
    """The attribute's own deviation is allowed to be as large as it is: the tree is one leaf."""
    rows = volume(spark, sf_dir)
    most = rows.agg(F.stddev_pop("value")).first()[0]
    tree = trees.grow(rows, ["quantity", "status"], attr="volume", max_std={"volume": most * (1 + 1e-9)})
    return assess.metrics(rows.withColumn("predicted", trees.compiled(tree)), ["name"], wanted=("count", "mae")).select("name", "count", r("mae", 4))


#: Least squares with an intercept, and means in leaves, leave residuals that sum to nothing.
UNBIASED = f"WITH {VOLUME} SELECT count(*) AS count, round(avg(value), 2) AS mean_predicted, true AS better_than_static FROM vol"


def _unbiased(rows):
    """Rows, their mean prediction, and whether the mean absolute error is below that of the mean."""
    mean = rows.agg(F.avg("value").alias("_m"))
    both = rows.crossJoin(F.broadcast(mean))
    return both.agg(F.count("*").alias("count"), F.round(F.avg("predicted"), 2).alias("mean_predicted"), (F.avg(F.abs(F.col("value") - F.col("predicted"))) < F.avg(F.abs(F.col("value") - F.col("_m")))).alias("better_than_static"))


@query("q93_function_leaves_unbiased", UNBIASED)
def function_leaves_unbiased(spark, sf_dir):
    rows = volume(spark, sf_dir)
    tree = trees.grow(rows, ["quantity", "status", "name"], with_functions=True, relevant=False)
    return _unbiased(trees.predict(rows, tree, ["quantity", "status", "name"]))


@query("q100_cart_unbiased", UNBIASED)
def cart_unbiased(spark, sf_dir):
    rows = trees.features(volume(spark, sf_dir), ["quantity", "size"], ["status"])
    return _unbiased(trees.library_tree("cart", rows).transform(rows).withColumnRenamed("prediction", "predicted"))


@query("q102_linear_tree_unbiased", UNBIASED)
def linear_tree_unbiased(spark, sf_dir):
    rows = volume(spark, sf_dir)
    return _unbiased(rows.withColumn("predicted", trees.compiled(trees.linear_tree(rows, ["quantity", "size"]))))


@query("q103_boosted_unbiased", UNBIASED)
def boosted_unbiased(spark, sf_dir):
    rows = trees.features(volume(spark, sf_dir), ["quantity", "size"])
    return _unbiased(trees.library_tree("boosted", trees.weighted(rows, ["quantity", "size"]), weightCol="weight").transform(rows).withColumnRenamed("prediction", "predicted"))


@query("q93_function_leaves", f"""WITH {VOLUME}, m AS (SELECT name, status, avg(value) AS p, regr_slope(value, quantity) AS b, regr_intercept(value, quantity) AS a,
  regr_syy(value, quantity) * (1 - regr_r2(value, quantity)) < 0.8 * regr_syy(value, quantity) AS useful FROM vol GROUP BY ALL)
SELECT name, status, count(*) AS count, round(avg(CASE WHEN useful THEN a + b * quantity ELSE p END), 4) AS mean, round(avg(abs(value - CASE WHEN useful THEN a + b * quantity ELSE p END)), 4) AS mae
FROM vol JOIN m USING (name, status) GROUP BY ALL""")
def function_leaves(spark, sf_dir):
    """Trees of status with lines in quantity in their leaves."""
    rows = volume(spark, sf_dir)
    grown = grove.grow(grove.moments(rows, ["quantity", "status"]), ["quantity", "status"], relevant=False, threshold=0.0, keep_scalar=True)
    fitted = grove.predict(rows, grove.with_functions(grown, rows, ["quantity"]))
    err = F.abs(F.col("value") - F.col("predicted"))
    return fitted.groupBy("name", "status").agg(F.count("*").alias("count"), F.round(F.avg("predicted"), 4).alias("mean"), F.round(F.avg(err), 4).alias("mae"))


@query("q99_model_plan", f"""WITH {LONG},
c AS (SELECT name, attr, status, quantity, stddev_pop(value) AS s FROM long GROUP BY ALL),
l AS (SELECT name, attr, avg(s) AS lut FROM c GROUP BY ALL),
b AS (SELECT name, attr, 'quantity' AS param, avg(s) AS s FROM (SELECT name, attr, status, stddev_pop(value) AS s FROM long GROUP BY ALL) GROUP BY ALL
      UNION ALL SELECT name, attr, 'status', avg(s) FROM (SELECT name, attr, quantity, stddev_pop(value) AS s FROM long GROUP BY ALL) GROUP BY ALL),
d AS (SELECT name, attr, param, s <> 0 AND lut / s < 0.5 AS dep FROM b JOIN l USING (name, attr))
SELECT name, attr, count(*) FILTER (WHERE dep) AS relevant, CASE WHEN count(*) FILTER (WHERE dep) = 0 THEN 'static' WHEN count(*) FILTER (WHERE dep) = count(*) FILTER (WHERE dep AND param = 'quantity') THEN 'functions' ELSE 'tree' END AS model FROM d GROUP BY ALL""")
def model_plan(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return trees.model_plan(stats.deviations(obs.long(), obs.params), stats.param_types(obs.df, obs.params))


@query("q100_cart")
def cart(spark, sf_dir):
    rows = trees.features(volume(spark, sf_dir), ["quantity", "size"], ["status"])
    return assess.metrics(trees.library_tree("cart", rows).transform(rows).withColumnRenamed("prediction", "predicted"), ["name"])


@query("q101_decart")
def decart(spark, sf_dir):
    rows = trees.features(volume(spark, sf_dir), [], ["status", "name"])
    return assess.metrics(trees.library_tree("cart", rows).transform(rows).withColumnRenamed("prediction", "predicted"), ["name"])


@query("q101_decart_means", f"WITH {VOLUME}, m AS (SELECT name, status, avg(value) AS p FROM vol GROUP BY ALL) SELECT name, count(*) AS count, round(avg(abs(value - p)), 4) AS mae FROM vol JOIN m USING (name, status) GROUP BY name")
def decart_means(spark, sf_dir):
    """Without scalars and with room for all, a leaf is a configuration."""
    return decart(spark, sf_dir).select("name", "count", r("mae", 4))


@query("q102_linear_tree")
def linear_tree(spark, sf_dir):
    rows = volume(spark, sf_dir)
    tree = trees.linear_tree(rows, ["quantity", "size"])
    return assess.metrics(rows.withColumn("predicted", trees.compiled(tree)), ["name"])


@query("q103_boosted")
def boosted(spark, sf_dir):
    rows = trees.features(volume(spark, sf_dir), ["quantity", "size"])
    model = trees.library_tree("boosted", rows)
    return assess.metrics(model.transform(rows).withColumnRenamed("prediction", "predicted"), ["name"])


@query("q103_regularised_first_split", f"""WITH {VOLUME}, b AS (SELECT name, avg(value) AS base FROM vol GROUP BY name),
l AS (SELECT name, base, value - base AS d, unnest(['quantity', 'size']) AS param, unnest([quantity, size]::DOUBLE[]) AS x FROM vol JOIN b USING (name)),
c AS (SELECT name, param, x, -sum(d) AS g, count(*) AS h FROM l GROUP BY ALL),
s AS (SELECT *, sum(g) OVER w AS g1, sum(h) OVER w AS h1, sum(g) OVER a AS gt, sum(h) OVER a AS ht FROM c WINDOW w AS (PARTITION BY name, param ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY name, param)),
k AS (SELECT *, greatest(abs(g1) - 50, 0) AS t1, greatest(abs(gt - g1) - 50, 0) AS t2, greatest(abs(gt) - 50, 0) AS t FROM s WHERE h1 >= 5 AND ht - h1 >= 5),
n AS (SELECT *, t1 * t1 / (h1 + 2) + t2 * t2 / (ht - h1 + 2) - t * t / (ht + 2) AS gain FROM k)
SELECT name, param, x AS threshold, round(-0.3 * sign(g1) * t1 / (h1 + 2), 6) AS left_weight, round(-0.3 * sign(gt - g1) * t2 / (ht - h1 + 2), 6) AS right_weight
FROM n QUALIFY row_number() OVER (PARTITION BY name ORDER BY gain DESC, param, x) = 1""")
def regularised_first_split(spark, sf_dir):
    """The first split of every name's trees: the threshold of most gain under L1, L2 and least weight of a child."""
    rows, params = volume(spark, sf_dir), ["quantity", "size"]
    model = boosting.boost(rows, params, ["name"], rounds=1, alpha=50.0, lam=2.0, min_child=5.0)
    s = F.element_at("splits", F.lit(1))
    param = F.get(F.array(*(F.lit(p) for p in params)), s["param"]).alias("param")
    return model.trees.select("name", param, s["threshold"].alias("threshold"), F.round(s["left"], 6).alias("left_weight"), F.round(s["right"], 6).alias("right_weight"))


@query("q103_regularised")
def regularised(spark, sf_dir):
    """Errors of regularised trees, one sum of them for every name."""
    rows = volume(spark, sf_dir)
    model = boosting.boost(rows, ["quantity", "size"], ["name"], rounds=10)
    return assess.metrics(boosting.predict(rows, model), ["name"])


@query("q104_forest")
def forest(spark, sf_dir):
    rows = trees.features(volume(spark, sf_dir), ["quantity", "size"])
    model = trees.library_tree("forest", rows)
    return assess.metrics(model.transform(rows).withColumnRenamed("prediction", "predicted"), ["name"])


@query("q105_ensemble", f"WITH {VOLUME} SELECT name, round(avg(abs(value - (100 + (quantity * 1000 + quantity * 2000) / 2))), 4) AS mae FROM vol GROUP BY name")
def ensemble(spark, sf_dir):
    both = trees.ensemble([F.col("quantity") * 1000, F.col("quantity") * 2000], "mean", 100.0)
    return assess.metrics(volume(spark, sf_dir).withColumn("predicted", both), ["name"]).select("name", r("mae", 4))


@query("q106_substate_power", """WITH p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events),
m AS (SELECT user_id, sum(value * (1 + event_id % 3)) AS pt, sum(1 + event_id % 3) AS t, arg_max(value, position) AS last FROM p GROUP BY user_id)
SELECT user_id, round((pt + last * greatest(1000 - t, 0)) / (t + greatest(1000 - t, 0)), 5) AS power FROM m""")
def substate_power(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    seq = e.select("user_id", F.col("event_id").alias("substate"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("position"), (1 + F.col("event_id") % 3).cast("double").alias("part"), F.lit(1000.0).alias("duration"))
    models = e.select(F.col("event_id").alias("substate"), F.col("value").alias("power"))
    return trees.substate_power(seq, models, ["user_id"]).select("user_id", r("power"))


@query("q107_complexity", f"""WITH {CONFIGS} SELECT name, attr, (1 + count(*) + sum(CASE WHEN k > 1 THEN k ELSE 0 END))::BIGINT AS nodes, sum(k)::BIGINT AS leaves,
  (1 + max((k > 1)::INT))::INT AS depth, (1 + count(*) + sum(CASE WHEN k > 1 THEN k ELSE 0 END))::BIGINT AS score FROM k GROUP BY ALL""")
def complexity(spark, sf_dir):
    """Trees at full depth: quantity first, then status where a quantity has several."""
    return grove.complexity(_grove(spark, sf_dir))


@query("q24_tree_graph", f"""WITH {CONFIGS} SELECT name, attr, 'quantity' AS source, quantity::VARCHAR AS label, kn::BIGINT AS n FROM k
UNION ALL SELECT name, attr, 'status of ' || quantity::VARCHAR, status, n FROM c JOIN k USING (name, attr, quantity) WHERE k > 1""")
def tree_graph(spark, sf_dir):
    """All edges of the trees at full depth, by the split that they leave."""
    g = _grove(spark, sf_dir)
    up = g.edges.select(F.col("child").alias("_node"), F.col("v").alias("above"))
    named = g.edges.join(g.nodes.select(*g.keys, "_node"), "_node").join(up, "_node", "left")
    return named.select("name", "attr", F.when(F.col("above").isNull(), F.col("param")).otherwise(F.concat("param", F.lit(" of "), "above")).alias("source"), F.col("v").alias("label"), "n")


@query("q22_model_round_trip", f"""WITH {LONG}, s AS (SELECT name, attr, median(value) AS s FROM long GROUP BY ALL), u AS (SELECT name, attr, status, quantity, median(value) AS u FROM long GROUP BY ALL),
t AS (SELECT name, attr, status, quantity, avg(value) AS t FROM long GROUP BY ALL),
p AS (SELECT name, attr, value, s, u, t, (u + 3 * t) / 4 AS e FROM long JOIN s USING (name, attr) JOIN u USING (name, attr, status, quantity) JOIN t USING (name, attr, status, quantity)),
x AS (SELECT name, attr, model, value, p FROM p, LATERAL (VALUES ('static', s), ('lut', u), ('tree', t), ('both', e)) l(model, p))
SELECT name, attr, model, count(*) AS count, round(avg(abs(value - p)), 4) AS mae, round(sqrt(avg((value - p) ** 2)), 4) AS rmsd, true AS as_stored FROM x GROUP BY ALL""")
def model_round_trip(spark, sf_dir):
    """Models are learned, written to the shared folder and read back; errors of what was read, and whether they are those that were stored."""
    obs = observations(spark, sf_dir)
    folder = scratch(spark)
    long = obs.long()
    modelstore.save(modelstore.learn(long, obs.params, ensembles={"both": {"lut": 1.0, "tree": 3.0}}, relevant=False, threshold=0.0), folder)
    back = modelstore.load(spark, folder)
    now = modelstore.errors(back, long, ("count", "mae", "rmsd"))
    stored = back.errors.select("name", "attr", "model", F.col("mae").alias("_mae"))
    same = F.abs(F.col("mae") - F.col("_mae")) < 1e-9 * (1 + F.abs("mae"))
    return now.join(stored, ["name", "attr", "model"]).select("name", "attr", "model", "count", r("mae", 4), r("rmsd", 4), same.alias("as_stored"))
