"""Media files: headers of MP4 and MOV files, and data sources that read parts of ``.npz`` tables and WAV files.

The two data sources plan their own partitions, a group of files each, and open files by seeking, so they read what was
asked for: of an ``.npz`` file the named arrays, of a WAV file its header or blocks of samples. Their folder is a path that
all executors mount (a plain path or ``file:``); other stores have no files to seek in and raise.
"""

from __future__ import annotations

import glob
import math
import os
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Boxes that hold boxes.
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
HEADERS = "path string, width int, height int, rotation int, duration double, fps double"


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, content start, content end) of the length-prefixed boxes in a span; a length that doesn't fit raises."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if n == 1:
            (n,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif n == 0:
            n = end - start
        if n < head or start + n > end:
            raise ValueError("box length")
        yield kind, start + head, start + n
        start += n


def _tree(data: bytes, start: int, end: int) -> dict:
    """The boxes of a span by type, in order; those that hold boxes as further trees."""
    out: dict = {}
    for kind, a, b in boxes(data, start, end):
        out.setdefault(kind, []).append(_tree(data, a, b) if kind in NESTED else (a, b))
    return out


def _clock(data: bytes, at: int) -> tuple[int, int]:
    """(ticks a second, ticks) of a movie or media header."""
    return struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)


def rotation(matrix: tuple[int, ...]) -> int | None:
    """Degrees by which a display matrix turns a picture counterclockwise; null for the unit matrix."""
    a, b = matrix[0] / 65536, matrix[1] / 65536
    if matrix[:2] + matrix[3:5] == (65536, 0, 0, 65536):
        return None
    return int(-math.degrees(math.atan2(b, a)))


def header(data: bytes) -> tuple:
    """(width, height, rotation, duration, fps) of the first video track. A file that isn't whole up to its header, or has no
    video track, has a duration of -1 and nulls."""
    try:
        top = {kind: (a, b) for kind, a, b in boxes(data) if kind == b"moov"}
        movie = _tree(data, *top[b"moov"])
        track = next(t for t in movie.get(b"trak", []) for h in t[b"mdia"][0].get(b"hdlr", []) if data[h[0] + 8 : h[0] + 12] == b"vide")
        media = track[b"mdia"][0]
        at = track[b"tkhd"][0][0]
        at += 40 if data[at] == 0 else 52
        matrix, (w, h) = struct.unpack_from(">9i", data, at), struct.unpack_from(">II", data, at + 36)
        w, h = w >> 16, h >> 16
        table = (media.get(b"minf") or [{}])[0].get(b"stbl", [{}])[0]
        if b"stsd" in table:  # the size that is stored, not the one that is shown
            w, h = struct.unpack_from(">HH", data, table[b"stsd"][0][0] + 8 + 32)
        rate, ticks = _clock(data, (media.get(b"mdhd") or movie[b"mvhd"])[0][0])
        fps = None
        if b"stts" in table:
            at = table[b"stts"][0][0]
            (n,) = struct.unpack_from(">I", data, at + 4)
            runs = [struct.unpack_from(">II", data, at + 8 + 8 * i) for i in range(n)]
            spent = sum(c * d for c, d in runs)
            fps = rate * sum(c for c, _ in runs) / spent if spent else None
        return w, h, rotation(matrix), ticks / rate if rate else -1.0, fps
    except (KeyError, IndexError, StopIteration, ValueError, struct.error, RecursionError):
        return None, None, None, -1.0, None


def media_headers(files: DataFrame) -> DataFrame:
    """path, width, height, rotation, duration, fps for rows (path, content), such as those of ``binaryFile``. Null contents
    count as empty. No picture is decoded."""

    def run(batches):
        for pdf in batches:
            out = [(p, *header(bytes(c) if c is not None else b"")) for p, c in zip(pdf.path, pdf.content, strict=True)]
            whole = pd.DataFrame(out, columns=["path", "width", "height", "rotation", "duration", "fps"])
            yield whole.astype({c: "Int32" for c in ("width", "height", "rotation")})

    return files.select("path", "content").mapInPandas(run, HEADERS)


def mounted(path: str) -> str:
    """The path as executors open it."""
    scheme, _, rest = path.rpartition("://")
    if scheme not in ("", "file"):
        raise ValueError(f"{path}: files are read by seeking, so the folder must be mounted")
    return (rest if scheme else path).removeprefix("file:")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """Plans a partition for each group of files of a folder."""

    pattern = "*"

    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.options = options
        self.group = int(options.get("filesperpartition", 64))

    def partitions(self) -> list[InputPartition]:
        paths = sorted(glob.glob(os.path.join(glob.escape(mounted(self.options["path"])), self.pattern)))
        return [_Files(paths[i : i + self.group]) for i in range(0, len(paths), self.group)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self.rows(path)


class _NpzReader(_Reader):
    pattern = "*.npz"

    def rows(self, path: str) -> Iterator[tuple]:
        with np.load(path, allow_pickle=False) as z:
            asked = {n: z[n] for n in self.names if n != "path"}  # an array is unpacked when it is named
            sizes = {len(a) for a in asked.values()}
            if len(sizes) > 1:
                raise ValueError(f"{path}: arrays of different lengths: {sorted(sizes)}")
            name = os.path.basename(path)
            columns = [[name] * max(sizes, default=1) if n == "path" else asked[n].tolist() for n in self.names]
        yield from zip(*columns, strict=True)


class NpzSource(DataSource):
    """``spark.read.format("npz")``: a row for each row of the named arrays of each ``.npz`` file of a folder. The schema names
    the arrays that are read; ``path`` is the file's name. Options: path, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NpzReader(schema, self.options)


class _WavReader(_Reader):
    pattern = "*.wav"

    def rows(self, path: str) -> Iterator[tuple]:
        with wave.open(path) as f:
            if f.getsampwidth() != 2:
                raise ValueError(f"{path}: not 16-bit PCM")
            rate, n, channels = f.getframerate(), f.getnframes(), f.getnchannels()
            own = {"path": os.path.basename(path), "sample_rate": rate, "channels": channels, "samples": n}
            if not {"at", "pcm"} & set(self.names):
                yield tuple(own[c] for c in self.names)
                return
            step = max(1, int(float(self.options.get("seconds", 10)) * rate))
            for at in range(0, n, step):
                if "pcm" in self.names:
                    f.setpos(at)
                    own["pcm"] = (np.frombuffer(f.readframes(min(step, n - at)), "<i2") / 32768).tolist()
                own["at"] = at / rate
                yield tuple(own[c] for c in self.names)


class WavSource(DataSource):
    """``spark.read.format("wav")``: 16-bit WAV files of a folder. With ``at`` or ``pcm`` in the schema a row for each block of
    ``seconds`` (its start, its samples as shares of full scale, channels in turn), else one for each file, from its header
    alone. Further columns: path, sample_rate, channels, samples. Options: path, seconds, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, sample_rate int, channels int, samples long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WavReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)
    spark.dataSource.register(WavSource)


def _written(rows: DataFrame, key: str, ending: str, folder: str, save) -> int:
    """Write a file a key by ``save(path, pdf)``; a file appears whole, also if a task is tried again. Returns their number."""
    where = mounted(folder)
    os.makedirs(where, exist_ok=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path = os.path.join(where, f"{pdf[key].iloc[0]}{ending}")
        part = f"{path}.{os.getpid()}.part"
        save(part, pdf)
        os.replace(part, path)
        return pd.DataFrame({"n": [1]})

    return rows.groupBy(key).applyInPandas(run, "n int").count()


def write_npz(rows: DataFrame, key: str, order: str, columns: list[str], folder: str) -> int:
    """An ``.npz`` file for each key with an array a column, rows in order of ``order``. A key is a group: a video's tracks."""

    def save(path: str, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values(order)
        with open(path, "wb") as f:
            np.savez(f, **{c: np.array(pdf[c].tolist()) for c in columns})

    return _written(rows, key, ".npz", folder, save)


def write_wavs(rows: DataFrame, key: str, order: str, value: str, rate: int, folder: str) -> int:
    """A 16-bit WAV file for each key from samples in -1..1 in order of ``order``."""

    def save(path: str, pdf: pd.DataFrame) -> None:
        pcm = np.clip(np.rint(pdf.sort_values(order)[value].to_numpy() * 32768), -32768, 32767).astype("<i2")
        with wave.open(path, "wb") as f:
            f.setparams((1, 2, rate, 0, "NONE", ""))
            f.writeframes(pcm.tobytes())

    return _written(rows, key, ".wav", folder, save)
