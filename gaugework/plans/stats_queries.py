"""Shape and statistics queries (inventory 27-43, 55-80)."""

from __future__ import annotations


from pyspark.sql import functions as F

from gaugework.observations import Observations
from gaugework.operators import shape, stats
from gaugework.plans.lineitem import LONG, OBS, observations, r
from gaugework.plans.registry import query, table


@query("q27_parameter_filter", f"WITH {OBS} SELECT name, count(*) AS n FROM obs WHERE quantity < 10 AND status <> 'F' AND quantity IN (1, 2, 3, 7) GROUP BY name")
def parameter_filter(spark, sf_dir):
    kept = shape.filter_parameters(observations(spark, sf_dir), "quantity < 10; status != F; quantity ∈ 1,2,3,7")
    return kept.df.groupBy("name").agg(F.count("*").alias("n"))


@query("q28_observation_filter", f"WITH {LONG} SELECT name, attr, count(*) AS n, round(sum(value), 2) AS total FROM long WHERE (name, attr) IN (('A', 'price'), ('R', 'unit_price')) GROUP BY ALL")
def observation_filter(spark, sf_dir):
    wanted = spark.createDataFrame([("A", "price"), ("R", "unit_price")], "name string, attr string")
    kept = shape.filter_observations(observations(spark, sf_dir).long(), wanted)
    return kept.groupBy("name", "attr").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("q29_ignore_parameters", f"WITH {OBS} SELECT name, status, count(*) AS n FROM obs GROUP BY ALL")
def ignore_parameters(spark, sf_dir):
    obs = shape.ignore_parameters(observations(spark, sf_dir), ["quantity"])
    return obs.df.groupBy(*obs.config).agg(F.count("*").alias("n"))


@query("q30_parameter_shift", f"WITH {OBS} SELECT '=' || status AS status, quantity / 10 + 5 AS quantity, count(*) AS n FROM obs GROUP BY ALL")
def parameter_shift(spark, sf_dir):
    obs = observations(spark, sf_dir)
    obs = shape.shift_parameter(obs, "quantity", "/", 10.0)
    obs = shape.shift_parameter(shape.shift_parameter(obs, "quantity", "+", 5.0), "status", "categorical")
    return obs.df.groupBy("status", "quantity").agg(F.count("*").alias("n"))


@query("q31_normalise_attribute", f"WITH {OBS} SELECT name, round(avg(price / 1000), 5) AS kilo_price FROM obs GROUP BY name")
def normalise_attribute(spark, sf_dir):
    obs = shape.normalise_attribute(observations(spark, sf_dir), "price", "kilo_price", lambda c: c / 1000)
    return obs.df.groupBy("name").agg(F.round(F.avg("kilo_price"), 5).alias("kilo_price"))


@query("q32_normalise_parameter", f"WITH {OBS} SELECT CASE status WHEN 'O' THEN 1.0 WHEN 'F' THEN 2.0 END::DOUBLE * 3 + 1 AS level, count(*) AS n FROM obs GROUP BY ALL")
def normalise_parameter(spark, sf_dir):
    level = shape.normalise_parameter(F.col("status"), {"O": 1, "F": 2}, lambda c: c * 3 + 1)
    return observations(spark, sf_dir).df.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("q33_soft_casts", """
SELECT count(*) FILTER (WHERE regexp_matches(v, '^[+-]?[0-9]+$')) AS ints, count(try_cast(v AS DOUBLE)) AS floats,
       count(*) FILTER (WHERE try_cast(v AS DOUBLE) IS NULL) AS neither
FROM (SELECT split_part(p_name, ' ', 1) AS v FROM part UNION ALL SELECT p_size::VARCHAR FROM part UNION ALL SELECT p_retailprice::VARCHAR FROM part)""")
def soft_casts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    text = part.select(F.explode(F.array(F.split("p_name", " ")[0], F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))).alias("v"))
    cast = shape.soft_casts(F.col("v"))
    return text.select(*(c.alias(k) for k, c in cast.items())).agg(F.count_if("is_int").alias("ints"), F.count("as_float").alias("floats"), F.count_if(F.isnan("or_nan")).alias("neither"))


@query("q34_one_hot", "SELECT p_brand, sum((p_type = t)::INT)::BIGINT AS hits FROM part, (SELECT min(p_type) AS t FROM part) GROUP BY p_brand")
def one_hot(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_type")
    values = shape.enum_values(part, "p_type")
    wide = shape.one_hot(part, "p_type", values, 1, 0)
    return wide.groupBy("p_brand").agg(F.sum(F.col(f"`p_type_{values[0]}`")).alias("hits"))


@query("q35_feature_matrix", """
SELECT p_partkey, coalesce(i.k, m.k + 1)::DOUBLE AS brand, p_size::DOUBLE AS size, p_retailprice AS price
FROM part LEFT JOIN (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS k FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 25)) i USING (p_brand),
     (SELECT count(DISTINCT p_brand) - 1 AS k FROM part WHERE p_size > 25) m""")
def feature_matrix(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    index = shape.category_index(part.where("p_size > 25"), "p_brand")
    return shape.encode_category(part, "p_brand", index, "brand").select("p_partkey", "brand", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))


@query("q36_regroup", f"WITH {OBS} SELECT obs_id, name, status, quantity, unit_price FROM obs")
def regroup(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return shape.by_name(shape.by_config(obs), obs).select("obs_id", "name", "status", "quantity", "unit_price")


@query("q37_parameter_strings", f"WITH {OBS} SELECT 'quantity=' || quantity::VARCHAR || ' status=' || status AS shown, status AS back, count(*) AS n FROM obs GROUP BY ALL")
def parameter_strings(spark, sf_dir):
    shown = observations(spark, sf_dir).df.select(shape.param_string(shape.param_map(("status", "quantity"))).alias("shown"))
    return shown.select("shown", shape.param_from_string(F.col("shown"))["status"].alias("back")).groupBy("shown", "back").agg(F.count("*").alias("n"))


@query("q38_known_features", f"WITH {OBS} SELECT 'status' AS param, status AS value, count(*) AS n FROM obs GROUP BY ALL")
def known_features(spark, sf_dir):
    obs = observations(spark, sf_dir)
    rows = obs.df.select("obs_id", *(F.col(p).cast("string").alias(p) for p in obs.params)).unpivot(["obs_id"], list(obs.params), "param", "value")
    features = spark.createDataFrame([("status",), ("speed",)], "param string")
    return shape.restrict_features(rows, features).groupBy("param", "value").agg(F.count("*").alias("n"))


@query("q39_recode", "SELECT n_name AS nation, r_name AS region, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def recode(spark, sf_dir):
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    place = place.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return shape.recode_by_dimension(table(spark, sf_dir, "supplier"), place, ["s_nationkey"], ["s_nationkey"]).groupBy("nation", "region").agg(F.count("*").alias("n"))


@query("q40_total", f"WITH {OBS} SELECT name, round(avg(unit_price + price), 5) AS total FROM obs GROUP BY name")
def total(spark, sf_dir):
    obs = shape.total_attribute(observations(spark, sf_dir))
    return obs.df.groupBy("name").agg(F.round(F.avg("TOTAL"), 5).alias("total"))


@query("q41_random_subset")
def random_subset(spark, sf_dir):
    return shape.random_subset(observations(spark, sf_dir).df, 1000, "obs_id", seed=7)


@query("q42_si_units", """
SELECT o_orderkey, CASE WHEN v >= 1e3 THEN printf('%.2f kJ', round(v / 1e3, 2)) WHEN v >= 1 THEN printf('%.2f J', round(v, 2)) ELSE printf('%.2f mJ', round(v / 1e-3, 2)) END AS shown
FROM (SELECT o_orderkey, round(o_totalprice / 1000) * 10 AS v FROM orders)""")
def si_units(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", shape.si_unit(F.round(F.col("o_totalprice") / 1000) * 10, "J").alias("shown"))


@query("q43_json_features", """
SELECT event_id, sum(length(k))::INT AS key_length, count(*) FILTER (WHERE regexp_matches(v, '^-?[0-9]+$'))::INT AS int_count,
       sum(CASE WHEN abs(v::BIGINT) < 256 THEN 1 WHEN abs(v::BIGINT) < 65536 THEN 2 ELSE 4 END)::INT AS int_bytes
FROM (SELECT event_id, unnest(json_keys(props)) AS k, json_extract_string(props, unnest(json_keys(props))) AS v FROM events) GROUP BY event_id""")
def json_features(spark, sf_dir):
    f = shape.json_features(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", *(f[k].alias(k) for k in ("key_length", "int_count", "int_bytes")))


@query("q55_static_model", f"WITH {LONG} SELECT name, attr, round(median(value), 5) AS static, count(*) AS n FROM long GROUP BY name, attr")
def static_model(spark, sf_dir):
    return stats.static_model(observations(spark, sf_dir).long()).select("name", "attr", r("static"), "n")


@query("q56_lut_model", f"WITH {LONG} SELECT name, attr, status, quantity, round(median(value), 5) AS lut FROM long GROUP BY ALL")
def lut_model(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return stats.lut_model(obs.long(), obs.params).select("name", "attr", "status", "quantity", r("lut"))


@query("q57_distinct_values", f"""WITH {OBS}, v AS (SELECT obs_id, name, 'quantity' AS param, quantity::VARCHAR AS value FROM obs UNION ALL SELECT obs_id, name, 'status', status FROM obs)
SELECT name, param, value, min(obs_id) AS first, count(*) AS n, (row_number() OVER (PARTITION BY name, param ORDER BY min(obs_id), value))::INT AS place FROM v GROUP BY name, param, value""")
def distinct_values(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return stats.distinct_values(obs.df, obs.params)


TYPES = """SELECT p_brand AS name, 'p_type' AS param, count(DISTINCT p_type) AS d, false AS num FROM part GROUP BY 1
UNION ALL SELECT p_brand, 'p_size', count(DISTINCT p_size), true FROM part GROUP BY 1
UNION ALL SELECT p_brand, 'p_brand', 1, false FROM part GROUP BY 1
UNION ALL SELECT p_brand, 'half', count(DISTINCT p_size > 25), false FROM part GROUP BY 1"""
KIND = "CASE WHEN d = 0 THEN 'UNSET' WHEN d = 1 THEN 'USELESS' WHEN d = 2 THEN 'BOOLEAN' WHEN num THEN 'SCALAR' ELSE 'ENUM' END"


def _types(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), "p_brand", "p_type", "p_size", (F.col("p_size") > 25).alias("half"))
    return stats.param_types(part, ["p_brand", "p_type", "p_size", "half"])


@query("q58_parameter_types", f"SELECT name, param, {KIND} AS type FROM ({TYPES})")
def parameter_types(spark, sf_dir):
    return _types(spark, sf_dir).select("name", "param", "type")


@query("q59_type_census", f"SELECT name, count(*) FILTER (WHERE type = 'USELESS') AS useless, count(*) FILTER (WHERE type IN ('BOOLEAN', 'SCALAR', 'ENUM')) AS useful FROM (SELECT name, {KIND} AS type FROM ({TYPES})) GROUP BY name")
def type_census(spark, sf_dir):
    return stats.type_census(_types(spark, sf_dir)).select("name", "useless", "useful")


DEV = f"""WITH {LONG},
c AS (SELECT name, attr, status, quantity, stddev_pop(value) AS s FROM long GROUP BY ALL),
w AS (SELECT name, attr, count(*) AS n, stddev_pop(value) AS std_static FROM long GROUP BY ALL),
l AS (SELECT name, attr, avg(s) AS std_lut FROM c GROUP BY ALL),
b AS (SELECT name, attr, 'quantity' AS param, avg(s) AS std_by_param FROM (SELECT name, attr, status, stddev_pop(value) AS s FROM long GROUP BY ALL) GROUP BY ALL
      UNION ALL SELECT name, attr, 'status', avg(s) FROM (SELECT name, attr, quantity, stddev_pop(value) AS s FROM long GROUP BY ALL) GROUP BY ALL)"""


@query("q62_std_by_param", f"{DEV} SELECT name, attr, param, round(std_static, 5) AS std_static, round(std_lut, 5) AS std_lut, round(std_by_param, 5) AS std_by_param FROM w JOIN l USING (name, attr) JOIN b USING (name, attr)")
def std_by_param(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return stats.deviations(obs.long(), obs.params).select("name", "attr", "param", r("std_static"), r("std_lut"), r("std_by_param"))


@query("q63_relevance", f"{DEV} SELECT name, attr, param, std_by_param <> 0 AND std_lut / std_by_param < 0.5 AS depends, round(1 - std_lut / std_by_param, 5) AS dependence, round(1 - std_lut / std_static, 5) AS dependence_all FROM w JOIN l USING (name, attr) JOIN b USING (name, attr)")
def relevance(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return stats.relevance(stats.deviations(obs.long(), obs.params)).select("name", "attr", "param", "depends", r("dependence"), r("dependence_all"))


@query("q65_correlation", f"WITH {OBS} SELECT name, round(corr(quantity, unit_price), 6) AS correlation FROM obs GROUP BY name")
def correlation(spark, sf_dir):
    return stats.correlation(observations(spark, sf_dir).df, "quantity", "unit_price").select("name", r("correlation", 6))


@query("q66_codependence", """
WITH c AS (SELECT c_mktsegment AS name, c_nationkey AS nation, n_regionkey AS region, c_custkey % 7 AS week FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT name, 'nation' AS p, 'region' AS q, nation AS pv, region AS qv FROM c UNION ALL SELECT name, 'nation', 'week', nation, week FROM c UNION ALL SELECT name, 'region', 'week', region, week FROM c),
v AS (SELECT name, p, q, pv, count(DISTINCT qv) AS qs FROM x GROUP BY ALL),
a AS (SELECT name, p, q, count(DISTINCT qv) AS all_q FROM x GROUP BY ALL)
SELECT name, p, q, q AS "drop" FROM v JOIN a USING (name, p, q) GROUP BY name, p, q, all_q HAVING max(qs) = 1 AND count(*) > 1 AND all_q > 1
""")
def codependence(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("nation"), F.pmod("c_custkey", F.lit(7)).alias("week"))
    return stats.codependent_pairs(c.join(nation, "nation"), ["nation", "region", "week"])


#: Each row's quantile bin by its name's 15 inner sixteenths, and the information of joint counts on it.
BINNED = f"""WITH {OBS},
e AS (SELECT name, quantile_cont(unit_price, [i / 16.0 FOR i IN range(1, 16)]) AS edges FROM obs GROUP BY name),
b AS (SELECT obs.*, len(list_filter(edges, lambda x: x < unit_price)) AS bin FROM obs JOIN e USING (name)),
l AS (SELECT name, bin, 'quantity' AS param, quantity::VARCHAR AS v FROM b UNION ALL SELECT name, bin, 'status', status FROM b),
j AS (SELECT name, param, v, bin, count(*) AS n FROM l GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY name, param) AS total, sum(n) OVER (PARTITION BY name, param, v) AS nv, sum(n) OVER (PARTITION BY name, param, bin) AS nb FROM j),
i AS (SELECT name, param, sum(n / total * ln(n * total / (nv * nb))) AS information FROM p GROUP BY ALL)"""


@query("q68_binned_information", f"{BINNED} SELECT name, round(information, 6) AS information FROM i WHERE param = 'quantity'")
def binned_information(spark, sf_dir):
    return stats.binned_information(observations(spark, sf_dir).df, "quantity", "unit_price").select("name", r("information", 6))


@query("q69_informative_parameters", f"{BINNED} SELECT name, param, round(information, 6) AS information, information >= 0.1 AS selected FROM i")
def informative_parameters(spark, sf_dir):
    return stats.informative_parameters(observations(spark, sf_dir).df, ["quantity", "status"], "unit_price").select("name", "param", r("information", 6), "selected")


@query("q64_correlation_dependence", f"""WITH {LONG} SELECT name, attr, param, round(abs(dependence), 6) AS dependence FROM (
SELECT name, attr, 'quantity' AS param, corr(quantity, value) AS dependence FROM long GROUP BY ALL UNION ALL SELECT name, attr, 'tax', corr(tax, value) FROM long GROUP BY ALL)""")
def correlation_dependence(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return stats.correlation_dependence(obs.df, ["quantity", "tax"], obs.attrs).select("name", "attr", "param", r("dependence", 6))


@query("q70_info_report", f"WITH {LONG} SELECT name, attr, count(*) AS samples, round(min(value), 5) AS least, round(max(value), 5) AS most, count(DISTINCT value) AS distinct_values FROM long GROUP BY ALL")
def info_report(spark, sf_dir):
    return stats.info_report(observations(spark, sf_dir).long()).select("name", "attr", "samples", r("least"), r("most"), "distinct_values")


@query("q71_outliers", f"WITH {OBS}, m AS (SELECT name, avg(price) AS m, stddev_pop(price) AS s FROM obs GROUP BY name) SELECT name, count(*) AS n FROM obs JOIN m USING (name) WHERE abs(price - m) <= 1.5 * s GROUP BY name")
def outliers(spark, sf_dir):
    obs = observations(spark, sf_dir)
    kept = stats.remove_outliers(Observations(obs.df, obs.params, ("price",)), 1.5)
    return kept.df.groupBy("name").agg(F.count("*").alias("n"))


@query("q72_box_statistics", f"""WITH {LONG}, q AS (SELECT name, attr, count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL)
SELECT name, attr, n, round(q1, 5) AS q1, round(median, 5) AS median, round(q3, 5) AS q3, round(min(value), 5) AS low, round(max(value), 5) AS high
FROM long JOIN q USING (name, attr) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY name, attr, n, q1, median, q3""")
def box_statistics(spark, sf_dir):
    return stats.box_statistics(observations(spark, sf_dir).long()).select("name", "attr", "n", *(r(c) for c in ("q1", "median", "q3", "low", "high")))


@query("q73_influence_series", f"WITH {LONG} SELECT name, attr, status, quantity AS x, round(avg(value), 7) AS y FROM long GROUP BY ALL")
def influence_series(spark, sf_dir):
    points, _ = stats.influence_series(observations(spark, sf_dir).long(), "quantity", ["status"])
    return points.select("name", "attr", "status", "x", r("y", 7))


@query("q74_histogram", f"""WITH {LONG}, s AS (SELECT name, attr, min(value) AS a, max(value) AS b FROM long GROUP BY ALL)
SELECT name, attr, least(floor((value - a) / (b - a) * 20), 19)::INT AS bin, count(*) AS n FROM long JOIN s USING (name, attr) GROUP BY ALL""")
def histogram(spark, sf_dir):
    return stats.histogram(observations(spark, sf_dir).long(), 20)


@query("q75_always_failing", "SELECT 'p_size' AS param, p_size::VARCHAR AS value, count(*) AS failures FROM part GROUP BY p_size HAVING bool_and(p_size % 7 = 0)")
def always_failing(spark, sf_dir):
    return stats.always_failing(table(spark, sf_dir, "part"), ["p_size", "p_brand"], F.col("p_size") % 7 == 0)


@query("q76_constant_options", "SELECT 'large' AS param, count(*) AS \"on\", 0::BIGINT AS off FROM part")
def constant_options(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    options = part.select(F.when(F.col("p_size") > 0, "y").otherwise("n").alias("large"), F.when(F.col("p_size") > 25, "y").otherwise("n").alias("half"))
    return stats.constant_options(options, ["large", "half"])


@query("q80_aggregate_check", """SELECT l_orderkey AS name FROM lineitem GROUP BY l_orderkey HAVING count(*) <> count(CASE WHEN l_quantity > 3 THEN 1 END)""")
def aggregate_check(spark, sf_dir):
    """Arrays of an order's lines, one attribute of which is not measured for small lines."""
    li = table(spark, sf_dir, "lineitem")
    grouped = li.groupBy(F.col("l_orderkey").alias("name")).agg(F.collect_list(F.struct("l_linestatus", "l_quantity")).alias("param"), F.collect_list("l_extendedprice").alias("price"), F.collect_list(F.when(F.col("l_quantity") > 3, F.col("l_tax"))).alias("tax"))
    return stats.aggregate_check(grouped, ["price", "tax"])


