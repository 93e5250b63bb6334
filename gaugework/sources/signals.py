"""Binary and text signal files and measurement archives (inventory 4, 8-13).

A file is a row of the ``binaryFile`` source and is decoded in the task that reads it.
"""

from __future__ import annotations

import io
import json
import re
import tarfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("signal"), "content")


def words_of(files: DataFrame) -> DataFrame:
    """10: the 32-bit little-endian words of each file."""

    def run(batches):
        for pdf in batches:
            for s, c in zip(pdf["signal"], pdf["content"], strict=True):
                w = np.frombuffer(c[: len(c) // 4 * 4], "<u4").astype(np.int64)
                yield pd.DataFrame({"signal": s, "i": np.arange(len(w)), "word": w})

    return files.mapInPandas(run, "signal string, i bigint, word bigint")


def decode_words(words: DataFrame) -> DataFrame:
    """10: charge is the word without its low four bits, the trigger is bit 3."""
    return words.withColumns({"charge": F.shiftright("word", 4), "trigger": F.shiftright("word", 3).bitwiseAND(1)})


def energy_counter(lines: DataFrame, keys=("signal",), order: str = "line_no", bits: int = 32) -> DataFrame:
    """11: [state] time current voltage energy text to power; the counter's overflows are undone.

    It has overflowed where it falls. Power is the step in energy over the step in time; ``changed`` marks a new state.
    """
    c = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("_c", c)
    five = F.size("_c") == 5
    at = lambda i: F.col("_c")[F.when(five, i + 1).otherwise(i)].try_cast("double")
    rows = rows.select(*keys, order, F.when(five, F.col("_c")[0]).alias("state"), at(0).alias("ts_us"), at(1).alias("current"), at(2).alias("voltage"), at(3).alias("_e"))
    w = Window.partitionBy(*keys).orderBy(order)
    up = rows.withColumn("_o", F.sum((F.col("_e") < F.lag("_e").over(w)).cast("int")).over(w))
    up = up.withColumn("energy", F.col("_e") + F.coalesce("_o", F.lit(0)) * float(2**bits))
    return up.withColumns({"power": (F.col("energy") - F.lag("energy").over(w)) / (F.col("ts_us") - F.lag("ts_us").over(w)), "changed": F.coalesce(F.col("state") != F.lag("state").over(w), F.lit(False))}).drop("_e", "_o")


def decode_analyzer(files: DataFrame, clip: float = 1e6, skip: float = 0.0, limit: float | None = None) -> DataFrame:
    """12: header up to ``</dlog>``, 8 bytes, then big-endian floats interleaved by channel (current, voltage).

    Values beyond ``clip`` are 0. Samples from ``skip`` seconds on, for ``limit`` seconds; power is current times voltage.
    """

    def run(batches):
        for pdf in batches:
            for s, c in zip(pdf["signal"], pdf["content"], strict=True):
                end = c.index(b"</dlog>") + len(b"</dlog>")
                end += 1 if c[end : end + 1] == b"\n" else 0
                step = float(re.search(rb"<tint>([^<]+)</tint>", c[:end])[1])
                channels = max(1, len(re.findall(rb"<(?:sense_curr|sense_volt)>1<", c[:end])))
                v = np.frombuffer(c[end + 8 : end + 8 + (len(c) - end - 8) // (4 * channels) * 4 * channels], ">f4").astype(float).reshape(-1, channels)
                yield pd.DataFrame({"signal": s, "i": np.arange(len(v)), "t": np.arange(len(v)) * step, "current": v[:, 0], "voltage": v[:, 1] if channels > 1 else np.nan})

    raw = files.mapInPandas(run, "signal string, i bigint, t double, current double, voltage double")
    clean = lambda name: F.when(F.abs(name) > clip, 0.0).otherwise(F.col(name)).alias(name)
    rows = raw.select("signal", "i", "t", clean("current"), clean("voltage")).where(F.col("t") >= skip)
    rows = rows if limit is None else rows.where(F.col("t") < skip + limit)
    return rows.withColumn("power", F.col("current") * F.col("voltage"))


def bench_csv(lines: DataFrame, keys=("file",), order: str = "line_no") -> DataFrame:
    """13: four header lines; time is column 0, current the negative of column 2."""
    c = F.split("value", ",")
    return lines.where(F.col(order) >= 4).select(*keys, order, c[0].try_cast("double").alias("t"), (-c[2].try_cast("double")).alias("current")).where("t is not null")


def archive_version(names: list[str], opt: dict | None) -> int:
    """8: archives without ptalog.json are version 0; else by kind of signal file."""
    if "ptalog.json" not in names:
        return 0
    kinds = {n.rsplit(".", 1)[-1] for n in names}
    return 3 if "dlog" in kinds else 2 if "etlog" in kinds else 1


_ARCHIVE = "archive string, version int, member string, content binary, valid boolean, errors array<string>"


def archive_members(files: DataFrame) -> DataFrame:
    """8: a row for each member of a tar archive; an unreadable archive is one row with the reason."""

    def run(batches):
        for pdf in batches:
            for s, c in zip(pdf["signal"], pdf["content"], strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(c)) as tar:
                        members = [m for m in tar.getmembers() if m.isfile()]
                        names = [m.name.removeprefix("./") for m in members]
                        opt = json.load(tar.extractfile(members[names.index("ptalog.json")])) if "ptalog.json" in names else None
                        version = archive_version(names, opt)
                        rows = [(s, version, n, tar.extractfile(m).read(), True, []) for n, m in zip(names, members, strict=True)]
                except (tarfile.TarError, ValueError, EOFError) as e:
                    rows = [(s, None, None, None, False, [f"{type(e).__name__}: {e}"])]
                out = pd.DataFrame(rows, columns=["archive", "version", "member", "content", "valid", "errors"])
                yield out.astype({"version": "Int32"})

    return files.mapInPandas(run, _ARCHIVE)


_TRACES = "traces array<struct<id:bigint,trace:array<struct<name:string,isa:string,parameter:map<string,string>,offline_aggregates:struct<duration:array<double>,energy:array<double>,power:array<double>,param:array<array<string>>>>>>>"


def archive_traces(members: DataFrame) -> DataFrame:
    """8: the elements of the traces in the archives' ptalog.json, in order."""
    log = members.where("member = 'ptalog.json'").select("archive", F.from_json(F.col("content").cast("string"), _TRACES).alias("j"))
    runs = log.select("archive", F.explode("j.traces").alias("t")).select("archive", F.col("t.id").alias("trace_id"), F.posexplode("t.trace").alias("seq", "e"))
    return runs.select("archive", "trace_id", "seq", "e.name", "e.isa", F.col("e.parameter").alias("param"), F.col("e.offline_aggregates").alias("offline"))


def timing_observations(traces: DataFrame) -> DataFrame:
    """9: transitions of timing traces, a row for each repetition; list parameters give that repetition's value."""
    rows = traces.where("isa = 'transition'").select("*", F.posexplode("offline.duration").alias("repetition", "duration"))
    pick = lambda v: F.when(v.startswith("["), F.get(F.from_json(v, "array<string>"), F.col("repetition"))).otherwise(v)
    return rows.select("trace_id", "seq", "name", F.transform_values("param", lambda _, v: pick(v)).alias("param"), "repetition", "duration")


