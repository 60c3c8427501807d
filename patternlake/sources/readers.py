"""Readers of sensor files, transaction text, result text and logs."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def sensor_csv(spark: SparkSession, path: str, schema: T.StructType, order: str, label: str | None = None, drop: list[str] | None = None, sep: str = ";") -> DataFrame:
    """Files below ``path`` as runs: run_id is the file's name, grp its folder's, seq the row by ``order``; label is renamed.

    The schema is given, never inferred. File names sort as strings.
    """
    rows = spark.read.csv(path, schema=schema, header=True, sep=sep, recursiveFileLookup=True).select("*", F.col("_metadata.file_path").alias("__path"))
    rows = rows.withColumn("run_id", F.element_at(F.split("__path", "/"), -1)).withColumn("grp", F.element_at(F.split("__path", "/"), -2)).drop("__path")
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("grp", "run_id").orderBy(order)) - 1)
    rows = rows.drop(*(drop or []))
    return rows.withColumnRenamed(label, "label") if label else rows


def raw_concat(runs: DataFrame) -> DataFrame:
    """Runs of a group as one unit: windows then cross from run to run. Rows are numbered by ranges, since a group may be large."""
    from patternlake.operators.windows import position

    dealt = runs.withColumnRenamed("seq", "__in_run")
    return position(dealt, ["grp", "run_id", "__in_run"], ["grp"]).withColumn("seq", F.col("seq").cast("int")).drop("run_id", "__in_run")


def with_classes(runs: DataFrame, spec: DataFrame) -> DataFrame:
    """Add cls from a mapping (grp, run_id, cls); runs without one are left out. The mapping has a row for each file."""
    return runs.join(spec, ["grp", "run_id"])


def turbofan(spark: SparkSession, path: str, settings: int = 3, sensors: int = 21) -> DataFrame:
    """Space-separated rows without header: unit, cycle, op1 .., s1 ... Doubled and trailing spaces do not count; missing columns are null."""
    names = ["unit", "cycle", *[f"op{k}" for k in range(1, settings + 1)], *[f"s{k}" for k in range(1, sensors + 1)]]
    cells = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("c"))
    kinds = {"unit": "int", "cycle": "int"}
    return cells.select(*[F.get("c", F.lit(k)).try_cast(kinds.get(n, "double")).alias(n) for k, n in enumerate(names)])


def labelled_rows(spark: SparkSession, path: str, schema: T.StructType, label: str) -> DataFrame:
    """Rows that are transactions by themselves; a byte order mark is no trouble since columns come by position."""
    return spark.read.csv(path, schema=schema, header=True, encoding="UTF-8", enforceSchema=True).withColumnRenamed(label, "label")


def telemetry(spark: SparkSession, path: str, order: str, rows: int | None = None, drop: str = "^(time|attack.*)$", schema: T.StructType | str | None = None) -> tuple[DataFrame, list[str]]:
    """Compressed CSV: (rows with seq, numeric channels). ``rows`` keeps the first by ``order``. Where channels are not known, types are
    taken from the files in a pass of their own; a ``schema`` spares it."""
    import re

    from patternlake.operators.windows import position

    df = spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)
    if rows is not None:
        df = df.orderBy(order).limit(rows)

    channels = [n for n, t in df.dtypes if not re.match(drop, n) and t in ("int", "bigint", "double", "float") and n != order]
    return position(df, [order]), channels


def mat_arrays(data: bytes) -> dict[str, np.ndarray]:
    """Real numeric matrices of a level 5 MAT file, flattened. Raises on damage."""
    if len(data) < 136 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("no level 5 file")
    end = "<" if data[126:128] == b"IM" else ">"
    kinds = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}

    def tag(buf, at):
        kind, size = struct.unpack_from(f"{end}II", buf, at)
        if kind >> 16:
            return kind & 0xFFFF, kind >> 16, at + 4, at + 8
        return kind, size, at + 8, at + 8 + size + -size % 8

    out, todo = {}, [(data, 128)]
    while todo:
        buf, at = todo.pop()
        while at + 8 <= len(buf):
            kind, size, begin, after = tag(buf, at)
            if begin + size > len(buf):
                raise ValueError("cut short")
            if kind == 15:
                todo.append((zlib.decompress(buf[begin : begin + size]), 0))
                after = begin + size  # compressed elements are not padded
            elif kind == 14:
                part = buf[begin : begin + size]
                _, _, _, at1 = tag(part, 0)
                _, _, _, at2 = tag(part, at1)
                _, n, b, at3 = tag(part, at2)
                name = bytes(part[b : b + n]).decode("ascii")
                kind, n, b, _ = tag(part, at3)
                if kind in kinds:
                    out[name] = np.frombuffer(part[b : b + n], f"{end}{kinds[kind]}").astype(float)
            at = after
    return out


def npz_arrays(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: np.asarray(z[k], float).ravel() for k in z.files}


def signals(spark: SparkSession, path: str, decode: Callable[[bytes], dict] = mat_arrays, keys: str = r".*_(DE|FE|BA)_time$") -> DataFrame:
    """(file, channel, samples) of binary signal files; files that can't be decoded give no rows."""
    import re

    def run(frames):
        for f in frames:
            rows = []
            for name, content in zip(f["path"], f["content"]):
                try:
                    got = decode(bytes(content))
                except Exception:  # noqa: BLE001, S112  a damaged file is left out, as documented
                    continue
                rows += [(name.rsplit("/", 1)[-1], k, v.tolist()) for k, v in sorted(got.items()) if re.match(keys, k)]
            yield pd.DataFrame(rows, columns=["file", "channel", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, channel string, samples array<double>")


def transactions_text(spark: SparkSession, path: str, keep_empty: bool = True, shift: int = 0) -> DataFrame:
    """(items): a line of integers is a transaction; items are distinct and ascending, negative ones dropped. Blank lines are empty transactions or, without keep_empty, none."""
    cells = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    ids = F.filter(F.transform(cells, lambda x: x.try_cast("int") + shift), lambda x: x.isNotNull() & (x >= 0))
    rows = spark.read.text(path).select(F.array_sort(F.array_distinct(ids)).alias("items"))
    return rows if keep_empty else rows.where(F.size("items") > 0)


def dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """(item, item_id) from a JSON object {item: id}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("item", "item_id"))


def labels_json(spark: SparkSession, path: str) -> DataFrame:
    """(position, label) from a JSON array of strings."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "label"))


def library_csv(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, sup_anom, lift) with numbers as numbers."""
    return spark.read.csv(path, schema="pattern string, sup_anom double, lift double", header=True)


#: Fixed value: a line of a result file, as "12th: 3 { 1 4 9 } support: 0.25 frequency: 71".
RESULT_LINE = r"^\s*\d+\w*:\s*(\d+)\s*\{([^}]*)\}\s*support:\s*([-+0-9.eE]+)\s*frequency:\s*(\d+)"


def results_text(lines: DataFrame) -> DataFrame:
    """(items, support) of result lines (value)."""
    hit = lines.where(F.col("value").rlike(RESULT_LINE))
    ids = F.transform(F.filter(F.split(F.trim(F.regexp_extract("value", RESULT_LINE, 2)), r"[\s,]+"), lambda x: x != ""), lambda x: x.cast("int"))
    return hit.select(F.array_sort(ids).alias("items"), F.regexp_extract("value", RESULT_LINE, 4).cast("long").alias("support"))


def results_header(lines: DataFrame) -> DataFrame:
    """(key, value) of the header lines "# key: value"."""
    pattern = r"^#\s*([^:]+):\s*(.*)$"
    return lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("text")).withColumnRenamed("text", "value")


def stage_results_text(lines: DataFrame, header: str = r"(?i)^\W*stage\D*(\d+)") -> DataFrame:
    """(stage, items, support): each result line belongs to the last stage header before it. ``lines`` is (file, line_no, value)."""
    from patternlake.operators.windows import carry_forward

    marked = lines.withColumn("__s", F.when(F.col("value").rlike(header), F.regexp_extract("value", header, 1).cast("int")))
    staged = carry_forward(marked, ["line_no"], "__s", "stage", ["file"])
    hit = staged.where(F.col("value").rlike(RESULT_LINE) & F.col("stage").isNotNull())
    parsed = results_text(hit.withColumn("value", F.col("value")))
    ids = F.transform(F.filter(F.split(F.trim(F.regexp_extract("value", RESULT_LINE, 2)), r"[\s,]+"), lambda x: x != ""), lambda x: x.cast("int"))
    return hit.select("stage", F.array_sort(ids).alias("items"), F.regexp_extract("value", RESULT_LINE, 4).cast(parsed.schema["support"].dataType).alias("support"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value), file as a whole path, since names may repeat in other folders: result files are small, one row per file when read."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


CALLS = "model string, cond string, case_key string, grp string, truth string, reply string"


def call_log(spark: SparkSession, path: str, schema: str = CALLS) -> DataFrame:
    """Calls of a JSON-lines log that did not end in an error; lines that are no JSON are dropped."""
    from patternlake.functions.text import is_error

    rows = spark.read.json(path, schema=schema, mode="DROPMALFORMED")
    return rows.where(F.col("reply").isNotNull() & ~is_error(F.col("reply")))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, md5, sha256) for verifying a download."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def run_log(lines: DataFrame) -> DataFrame:
    """(phase, ms, ok) from log lines such as ``counting: 12.5 ms`` and ``MATCH``: phase timings and, for all, whether the run matched its gold. ``lines`` is (file, value)."""
    timed = r"^\s*([A-Za-z][\w \-]*?)\s*[:=]\s*([-+0-9.eE]+)\s*ms\b"
    ok = lines.groupBy("file").agg(F.max(F.col("value").rlike(r"\bMATCH\b") & ~F.col("value").rlike(r"MISMATCH|NO MATCH")).alias("ok"))
    phases = lines.where(F.col("value").rlike(timed)).select("file", F.regexp_extract("value", timed, 1).alias("phase"), F.regexp_extract("value", timed, 2).try_cast("double").alias("ms"))
    return phases.join(ok, "file")


def settings(text: str) -> dict[str, str]:
    """Key=value lines of a settings file; comments and quotes are stripped."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            out[k.strip()] = v.strip().strip("'\"")
    return out
