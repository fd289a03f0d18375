"""Raw dense arrays as a Spark data source that reads and writes by byte ranges.

A file is one picture: channel after channel, column after column, no header. A read partition is a range
of columns of one file or several small files, so no task holds a large file; ids that a filter rules out are not opened. Files are
reached through Arrow's file systems (local and mounted folders, hdfs, s3, gs), by the URI of the folder.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

STRIPS = "image_id int, channel int, col int, height int, pixels array<float>"
SPLIT_BYTES = 8 << 20
META = "_meta.json"
_NAME = re.compile(r"image_(\d+)\.bin$")
_TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
}


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Strip:
    """A range of columns of one file."""

    file: str
    image_id: int
    height: int
    width: int
    first: int  # column over all channels
    last: int


@dataclass
class Strips(InputPartition):
    """Strips of about splitBytes together: a part of a large file, or several small ones."""

    strips: list[Strip]


@dataclass
class Written(WriterCommitMessage):
    """What a task has written, in sixteen bytes a file: names follow from the attempt and the id."""

    attempt: str
    sizes: bytes  # rows of image, height, width, channels

    def files(self, root: str) -> Iterator[tuple[str, str, list[int]]]:
        """(temporary name, name, [image, height, width, channels]) of every file."""
        for image, *size in np.frombuffer(self.sizes, np.int32).reshape(-1, 4).tolist():
            yield temporary(root, self.attempt, image), f"{root}/image_{image:03d}.bin", [image, *size]


def temporary(root: str, attempt: str, image: int) -> str:
    """A name of one attempt alone; only committed attempts are renamed."""
    return f"{root}/.part-{attempt}-{image}"


class DenseReader(DataSourceReader):
    def __init__(self, path: str, dtype: str, split: int):
        self.path, self.dtype, self.split, self.tests = path, dtype, split, []

    def pushFilters(self, filters: list[Filter]):
        """Tests of the id choose the files; all others are left to Spark."""
        for f in filters:
            test = _TESTS.get(type(f))
            if test is not None and f.attribute == ("image_id",):
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = _folder(self.path)
        with store.open_input_stream(f"{root}/{META}") as f:
            sizes = {int(k): v for k, v in json.loads(f.read()).items()}
        out, held, room = [], [], self.split
        for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            name = _NAME.search(info.path)
            if name is None or not all(_TESTS[kind](int(name[1]), value) for kind, value in self.tests):
                continue
            if int(name[1]) not in sizes:
                raise ValueError(f"{info.path}: no size recorded")
            height, width, channels = sizes[int(name[1])]
            column = height * np.dtype(self.dtype).itemsize
            if info.size != column * width * channels:
                raise ValueError(f"{info.path}: {info.size} bytes instead of {column * width * channels}")
            first = 0
            while first < width * channels:
                last = min(first + max(1, room // max(1, column)), width * channels)
                held.append(Strip(info.path, int(name[1]), height, width, first, last))
                room -= column * (last - first)
                first = last
                if room < column or first < width * channels:
                    out.append(Strips(held))
                    held, room = [], self.split
        return out + [Strips(held)] * bool(held)

    def read(self, partition: Strips) -> Iterator[pa.RecordBatch]:
        store, _ = _folder(self.path)
        for part in partition.strips:
            yield self.columns(store, part)

    def columns(self, store: fs.FileSystem, part: Strip) -> pa.RecordBatch:
        kind = np.dtype(self.dtype)
        column = part.height * kind.itemsize
        with store.open_input_file(part.file) as f:
            data = f.read_at(column * (part.last - part.first), column * part.first)
        values = np.frombuffer(data, kind).astype(np.float32)
        if kind == np.uint8:
            values = values / np.float32(255.0)
        at = np.arange(part.first, part.last)
        n = len(at)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, part.image_id, np.int32)),
                pa.array((at // part.width + 1).astype(np.int32)),
                pa.array((at % part.width + 1).astype(np.int32)),
                pa.array(np.full(n, part.height, np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.height), pa.array(values)),
            ],
            names=["image_id", "channel", "col", "height", "pixels"],
        )


class DenseWriter(DataSourceWriter):
    """Rows come image by image, channels and columns in order; a task holds one column."""

    def __init__(self, path: str, dtype: str):
        self.path, self.dtype = path, dtype

    def write(self, rows) -> Written:
        store, root = _folder(self.path)
        store.create_dir(root, recursive=True)
        kind, attempt, sizes = np.dtype(self.dtype), uuid.uuid4().hex, []
        image, stream, seen = None, None, set()
        height = channels = width = 0

        def done():
            stream.close()
            sizes.append((image, height, width, channels))

        for row in rows:
            if row.image_id != image:
                if image is not None:
                    done()
                if row.image_id in seen:
                    raise ValueError(f"columns of image {row.image_id} do not stand together")
                seen.add(row.image_id)
                image, height, channels, width = row.image_id, row.height, 1, 0
                stream, expected = store.open_output_stream(temporary(root, attempt, image)), (1, 1)
            if row.channel == channels + 1 and row.col == 1:
                channels, expected = row.channel, (row.channel, 1)
            if (row.channel, row.col) != expected or len(row.pixels) != height:
                raise ValueError(f"image {image}: column {row.col} of channel {row.channel} is missing, double or too short")
            values = np.asarray(row.pixels, np.float64)
            if kind == np.uint8:
                values = np.rint(np.clip(values, 0.0, 1.0) * 255.0)
            stream.write(values.astype(kind).tobytes())
            width, expected = max(width, row.col), (row.channel, row.col + 1)
        if image is not None:
            done()
        return Written(attempt, np.array(sizes, np.int32).tobytes())

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _folder(self.path)
        store.create_dir(root, recursive=True)
        sizes = {}
        if store.get_file_info(f"{root}/{META}").type == fs.FileType.File:  # files of earlier jobs stay
            with store.open_input_stream(f"{root}/{META}") as f:
                sizes = json.loads(f.read())
        for message in filter(None, messages):
            for written, name, (image, *size) in message.files(root):
                store.move(written, name)
                sizes[str(image)] = size
        with store.open_output_stream(f"{root}/{META}") as f:
            f.write(json.dumps(sizes).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _folder(self.path)
        for message in filter(None, messages):
            for written, _, _ in message.files(root):
                store.delete_file(written)


class DenseDataSource(DataSource):
    """``spark.read.format("dense")``; options path, dtype (uint8: 0..1 as bytes) and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "dense"

    def schema(self) -> str:
        return STRIPS

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        return DenseReader(o["path"], o.get("dtype", "uint8"), int(o.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return DenseWriter(self.options["path"], self.options.get("dtype", "uint8"))


def read_dense(spark: SparkSession, path: str, dtype: str = "uint8", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Columns of all pictures below ``path``: (image_id, channel, col, height, pixels), all 1-based."""
    spark.dataSource.register(DenseDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("dense").option("dtype", dtype).option("splitBytes", split_bytes).load(path)


def dense_pixels(strips: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """One row per pixel and a column per channel: the channels' columns of a picture meet by (image, col)."""
    planes = strips.groupBy("image_id", "col").agg(
        *[F.max(F.when(F.col("channel") == k, F.col("pixels"))).alias(c) for k, c in enumerate(channels, start=1)]
    )
    zipped = F.posexplode(F.arrays_zip(*channels)).alias("at", "px")
    return planes.select("image_id", "col", zipped).select(
        "image_id", (F.col("at") + 1).alias("row"), "col", *[F.col(f"px.{c}").alias(c) for c in channels]
    )


def write_dense(pixels: DataFrame, path: str, channels: tuple[str, ...], dtype: str = "uint8") -> None:
    """Dense pixels (image_id, row, col, channels) as one file per picture; a row of the job is one column of one."""
    session = pixels.sparkSession
    session.dataSource.register(DenseDataSource)
    values = [F.struct(F.lit(k).alias("channel"), F.col(c).cast("float").alias("v")) for k, c in enumerate(channels, start=1)]
    long = pixels.select(F.col("image_id").cast("int").alias("image_id"), "row", F.col("col").cast("int").alias("col"), F.explode(F.array(*values)).alias("e"))
    columns = long.groupBy("image_id", F.col("e.channel").alias("channel"), "col").agg(
        F.array_sort(F.collect_list(F.struct("row", "e.v"))).alias("c")
    )
    rows = columns.select("image_id", "channel", "col", F.size("c").alias("height"), F.col("c.v").alias("pixels"))
    dealt = rows.repartition("image_id").sortWithinPartitions("image_id", "channel", "col")
    dealt.write.format("dense").mode("append").option("dtype", dtype).save(path)
