"""Log lines, traces, counters and profiles as observations, and back (inventory 1-7, 13-18, 25)."""

from __future__ import annotations

import lzma
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.operators.shape import param_from_string, param_string

#: Fixed line format: ``[::] name | k=v ... | k=v ...`` with anything in front.
LINE = r"\[::\] *([^|]*?) *\|([^|]*)\|(.*)$"
MARK = r"\[(>>|--|<<)\] *([^|]*?) *\|(.*)$"


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines with file and line number within it; files are not split, so that numbers follow the file."""
    if isinstance(paths, str):
        paths = [paths]
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def read_xz(spark: SparkSession, path: str) -> DataFrame:
    """4: the lines of .xz files, which Spark has no codec for; a file a row, decoded in the tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xz").load(path).select(F.col("path").alias("file"), "content")

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                lines = lzma.decompress(content).decode("utf-8", "replace").split("\n")
                yield pdf.iloc[:0].drop(columns="content").reindex(range(len(lines))).assign(file=file, line_no=range(len(lines)), value=lines)

    return files.mapInPandas(run, "file string, line_no int, value string")


def _pairs(text: Column) -> Column:
    return param_from_string(text)


def bad_pairs(text: Column) -> Column:
    """Words of a parameter or attribute part without ``=``."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: (x != "") & ~x.contains("="))


def parse_lines(lines: DataFrame, strict: bool = True, line: str = "value") -> DataFrame:
    """1: name, place, param and attr maps of the lines that match; a pure column function, so also good for streams.

    A bad pair is an error, or (not ``strict``) puts the line's text in ``bad``.
    """
    text = F.col(line)
    head, params, attrs = (F.regexp_extract(text, LINE, i) for i in (1, 2, 3))
    bad = F.concat(bad_pairs(params), bad_pairs(attrs))
    attr = _pairs(attrs)
    number = F.transform_values(attr, lambda _, v: v.try_cast("double"))
    wrong = (F.size(bad) > 0) | F.exists(F.map_entries(attr), lambda e: e["value"].isNotNull() & e["value"].try_cast("double").isNull())
    flag = F.when(wrong, F.raise_error(F.concat(F.lit("bad pair in line: "), text)).cast("string") if strict else text)
    place = F.nullif(F.trim(F.regexp_extract(head, r"@(.*)$", 1)), F.lit(""))
    return lines.where(text.rlike(LINE)).select(
        *[c for c in lines.columns if c != line], F.trim(F.regexp_replace(head, r"@.*$", "")).alias("name"), place.alias("place"), _pairs(params).alias("param"), number.alias("attr"), flag.alias("bad")
    )


def parse_trace(lines: DataFrame, file: str = "file", order: str = "line_no", line: str = "value") -> tuple[DataFrame, DataFrame]:
    """2: observations with run number, and run marks: run, kind (start, kernel, end), name, param and offset
    (observations of the file in front)."""
    text = F.col(line)
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    is_obs, mark = text.rlike(LINE), F.regexp_extract(text, MARK, 1)
    rows = lines.where(is_obs | text.rlike(MARK)).withColumns({"run": F.sum((mark == ">>").cast("int")).over(w), "offset": F.sum(is_obs.cast("int")).over(w)})
    kind = F.when(mark == ">>", "start").when(mark == "--", "kernel").otherwise("end")
    marks = rows.where(~is_obs).select(file, order, "run", kind.alias("kind"), F.regexp_extract(text, MARK, 2).alias("name"), _pairs(F.regexp_extract(text, MARK, 3)).alias("param"), "offset")
    return parse_lines(rows.where(is_obs)), marks


def disagreeing_runs(marks: DataFrame, file: str = "file") -> DataFrame:
    """2: runs whose marks have different names, an error."""
    return marks.groupBy(file, "run").agg(F.count_distinct("name").alias("names")).where("names > 1")


def union_inputs(parts: list[DataFrame]) -> DataFrame:
    """6: all observations of several inputs, with ``input`` for their place in the list; columns one lacks are unset."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("input", F.lit(i)) for i, p in enumerate(parts)])


def rebase_marks(marks: DataFrame, sizes: DataFrame, by: str = "input") -> DataFrame:
    """7: offsets into the concatenated observations. ``sizes`` has the number of observations of each input."""
    before = sizes.select(by, F.coalesce(F.sum("n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return marks.join(before, by).withColumn("offset", F.col("offset") + F.col("_before")).drop("_before")


def csv_observations(spark: SparkSession, path: str, attrs, ignore=(), name: str = "CSVFile") -> DataFrame:
    """3: header CSV; listed columns are attributes or ignored, all others parameters."""
    raw = spark.read.option("header", True).csv(path)
    keep = [c for c in raw.columns if c not in (*attrs, *ignore)]
    return raw.select(F.lit(name).alias("name"), *(F.col(c) for c in sorted(keep)), *(F.col(a).try_cast("double").alias(a) for a in attrs))


_JSON = "array<struct<name:string,param:map<string,string>,attribute:map<string,double>>>"


def json_observations(spark: SparkSession, path: str) -> DataFrame:
    """5: lists of observations, one or several (each from a new line) in a file. A list ends at a bracket before a line that opens
    one: within a list there is a comma between, and a text has no bare line ends."""
    text = spark.read.text(path, wholetext=True)
    lists = text.select(F.explode(F.split("value", r"(?<=\])\s*[\r\n]\s*(?=\[)")).alias("value"))
    return lists.select(F.inline(F.from_json("value", _JSON))).withColumnRenamed("attribute", "attr")


def json_aggregate(spark: SparkSession, path: str) -> DataFrame:
    """5: the columnar form ``{param_names, by_name: {name: {param: [[...]], attributes: [...], attr: [...]}}}``."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "param_names array<string>, by_name map<string,map<string,string>>").alias("j"))
    names = text.select("j.param_names", F.explode("j.by_name").alias("name", "d"))
    rows = names.select("param_names", "name", "d", F.from_json(F.col("d")["attributes"], "array<string>").alias("attrs"), F.posexplode(F.from_json(F.col("d")["param"], "array<array<string>>")).alias("i", "values"))
    param = F.map_from_arrays("param_names", "values")
    attr = F.map_from_arrays("attrs", F.transform("attrs", lambda a: F.get(F.from_json(F.element_at("d", a), "array<double>"), F.col("i"))))
    return rows.select("name", F.col("i").alias("obs_id"), param.alias("param"), attr.alias("attr"))


def counter_observations(counters: DataFrame, keys, name: str) -> DataFrame:
    """14: counter rows (event, value, metric unit and value) as one log line for each key; metrics are named by unit."""
    metric = (
        F.when(F.col("unit").isNull() | (F.col("unit") == ""), None).when(F.col("unit").contains("/sec"), F.concat("event", F.lit("_per_s"))).when(F.col("unit").startswith("%"), F.concat("event", F.lit("_percent"))).otherwise(F.concat("event", F.lit("_"), F.regexp_replace("unit", r"\W+", "_")))
    )
    pairs = F.array(F.struct(F.regexp_replace("event", r"\W+", "_").alias("k"), F.col("value").alias("v")), F.struct(F.regexp_replace(metric, r"[^\w]+", "_").alias("k"), F.col("metric").alias("v")))
    long = counters.select(*keys, F.explode(pairs).alias("p")).where("p.k is not null and p.v is not null")
    attrs = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: F.concat(x["k"], F.lit("="), x["v"].cast("string"))), " ")
    return long.groupBy(*keys).agg(F.concat(F.lit(f"[::] {name} | "), F.array_join(F.array(*(F.concat(F.lit(f"{k}="), F.first(k).cast("string")) for k in sorted(keys))), " "), F.lit(" | "), attrs).alias("line"))


def counter_delta(df: DataFrame, wrap: float | None = None) -> DataFrame:
    """15: energy and mean power from start and stop counters (microjoules and seconds)."""
    delta = F.col("stop_uj") - F.col("start_uj")
    if wrap is not None:
        delta = F.when(delta < 0, delta + wrap).otherwise(delta)
    return df.withColumn("energy_uj", delta).withColumn("power_uw", delta / (F.col("stop_s") - F.col("start_s")))


def working_set_stats(samples: DataFrame, places: DataFrame, keys=("file",)) -> DataFrame:
    """16: mean, median and deviation of the working set while the program is in a kernel.

    ``samples`` (t, insn, data) is joined to ``places`` (from_t, to_t, kernel) by range.
    """
    from gaugework.operators.lookup import interval_join

    spans = places.where("kernel is not null")
    inside = interval_join(samples, spans, list(keys), "t", "from_t", "to_t", 10.0)
    return inside.groupBy(*keys, "kernel").agg(*(f(c).alias(f"{n}_{c}") for c in ("insn", "data") for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop))), F.count("*").alias("n"))


#: Fixed summary lines of a profile and the fields they give.
SUMMARY = {"init_us": r"init: (\d+)", "warmup_us": r"warmup: (\d+)", "runs": r"runs: (\d+)", "avg_us": r"avg: ([\d.]+)", "memory_kb": r"peak memory: (\d+)"}


def profile_table(lines: DataFrame, section: str = "Operator-wise", file: str = "file", order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """17: the nine-column rows of a profile's section, and the fields of its run header."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("value").rlike(r"^=+ .* =+$"), F.regexp_extract("value", r"^=+ (.*?) =+$", 1))
    rows = lines.withColumn("section", F.last(header, ignorenulls=True).over(w)).withColumn("c", F.split(F.trim("value"), r"[\t,]\s*"))
    body = rows.where(F.col("section").startswith(section) & (F.size("c") == 9) & F.col("c")[1].try_cast("double").isNotNull())
    table = body.select(file, F.col("c")[0].alias("op"), *(F.regexp_replace(F.col("c")[i], "%", "").try_cast("double").alias(n) for i, n in enumerate(("start", "first", "avg_ms", "percent", "cumulative", "memory_kb", "times"), 1)), F.col("c")[8].alias("node"))
    fields = lines.groupBy(file).agg(*(F.max(F.nullif(F.regexp_extract("value", p, 1), F.lit(""))).try_cast("double").alias(k) for k, p in SUMMARY.items()))
    return table, fields


def to_lines(df: DataFrame, params, attrs, name: str = "name") -> DataFrame:
    """18: observations as log lines, keys in order."""
    as_map = lambda cols: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in cols)), lambda e: e["value"].isNotNull()))
    return df.select(F.concat(F.lit("[::] "), F.col(name), F.lit(" | "), param_string(as_map(params)), F.lit(" | "), param_string(as_map(attrs))).alias("value"))
