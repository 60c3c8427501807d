"""Binary signal files as a data source of its own, and their writer: level 5 MAT and NPZ."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from patternlake.sources.readers import mat_arrays, npz_arrays

SCHEMA = "file string, channel string, samples array<double>, error string"
#: Channels that are read unless ``keys`` says otherwise: drive end, fan end and base.
KEYS = r".*_(DE|FE|BA)_time$"


def mat_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """A level 5 MAT file of column vectors of doubles."""

    def element(kind: int, data: bytes) -> bytes:
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = [b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"]
    for name, x in arrays.items():
        flags, shape = element(6, struct.pack("<II", 6, 0)), element(5, struct.pack("<ii", len(x), 1))
        out.append(element(14, flags + shape + element(1, name.encode("ascii")) + element(9, np.asarray(x, "<f8").tobytes())))
    return b"".join(out)


def npz_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


FORMS = {"mat": (mat_bytes, mat_arrays), "npz": (npz_bytes, npz_arrays)}


def write_signals(rows: DataFrame, path: str, form: str = "mat") -> int:
    """Write (file, channel, k, x) as one file below ``path`` for each ``file``, samples by ``k``; returns how many. A file is one task's work, and appears under its name when it is whole."""
    encode = FORMS[form][0]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        arrays = {c: part.sort_values("k")["x"].to_numpy(float) for c, part in frame.groupby("channel", sort=True)}
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        name = f"{folder}/{frame['file'].iloc[0]}.{form}"
        with store.open_output_stream(f"{name}.part") as f:
            f.write(encode(arrays))
        store.move(f"{name}.part", name)
        return pd.DataFrame({"n": [1]})

    return rows.select("file", "channel", "k", "x").groupBy("file").applyInPandas(run, "n int").count()


class SignalFile(InputPartition):
    def __init__(self, path: str, size: int):
        super().__init__((path, size))
        self.path = path


class SignalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.keys, self.forms = options["path"], options.get("keys", KEYS), [f for f in FORMS if f in options.get("forms", "mat,npz").split(",")]

    def partitions(self) -> list[InputPartition]:
        store, folder = fs.FileSystem.from_uri(self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(folder, recursive=True)) if f.extension in self.forms]
        return [SignalFile(f.path, f.size) for f in sorted(found, key=lambda f: f.path)]

    def read(self, partition: SignalFile) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        name = partition.path.rsplit("/", 1)[-1]
        names = ["file", "channel", "samples", "error"]
        try:
            with store.open_input_file(partition.path) as f:
                arrays = FORMS[name.rsplit(".", 1)[-1]][1](f.read())
        except Exception as e:  # noqa: BLE001  whatever a damaged file makes a decoder say is a row
            columns = [pa.array([name]), pa.array([None], pa.string()), pa.array([None], pa.list_(pa.float64())), pa.array([f"{type(e).__name__}: {e}"])]
            yield pa.RecordBatch.from_arrays(columns, names)
            return
        for channel, x in sorted(arrays.items()):
            if re.match(self.keys, channel):
                samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([channel]), samples, pa.array([None], pa.string())], names)


class SignalSource(DataSource):
    """``spark.read.format("signals").load(path)``: (file, channel, samples, error), one partition for each file, a channel at a time.

    Options: ``keys``, a pattern of channel names; ``forms``, ``mat`` and ``npz`` or one of them. A file that can't be decoded is one row with its error and nothing else.
    ``path`` is a folder, with everything below it, in a store that pyarrow.fs opens (a local or mounted one, hdfs, s3).
    """

    @classmethod
    def name(cls) -> str:
        return "signals"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SignalReader(dict(self.options))


def signals(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Read a folder of signal files through the source, which is registered with the session."""
    spark.dataSource.register(SignalSource)
    return spark.read.format("signals").options(**options).load(path)
