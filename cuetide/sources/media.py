"""Frames of uncompressed video (YUV4MPEG2) as a Spark data source, by spans of time; other containers by a decoder.

A stream's frames have one size and one rate, so a span of time is a range of bytes: each partition opens the file,
seeks and reads its own frames, and a range asked for reads no others. Times come from the stream's rate as a
quotient, frame by frame, and never add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_CHROMA = {"mono": Fraction(0), "420": Fraction(1, 2), "422": Fraction(1), "444": Fraction(2)}
_FRAME = b"FRAME\n"
#: Frames of a partition, about.
PART_FRAMES = 256


@dataclass(frozen=True)
class Media:
    width: int
    height: int
    rate: Fraction
    codec: str
    head: int
    frame_bytes: int
    frames: int

    @property
    def seconds(self) -> float:
        return float(self.frames / self.rate)

    def place(self, seconds: float) -> int:
        """The first frame whose time is ``seconds`` or later."""
        if seconds >= self.seconds:
            return self.frames
        k = max(0, int(seconds * self.rate) - 1)
        while k < self.frames and float(k / self.rate) < seconds:
            k += 1
        return k


def _open(path: str):
    from pyarrow import fs

    if path.startswith("/") or path.startswith("file:"):
        store, place = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def probed(path: str) -> Media:
    """Size, rate, codec and number of frames, from the header and the file's length."""
    with _open(path) as f:
        line = f.read(256).split(b"\n", 1)[0]
        size = f.size()
    words = line.decode("ascii", "replace").split(" ")
    if words[0] != "YUV4MPEG2":
        raise ValueError(f"{path}: not an uncompressed video stream; give a decoder")
    tags = {w[0]: w[1:] for w in words[1:] if w}
    width, height, rate = int(tags["W"]), int(tags["H"]), Fraction(tags["F"].replace(":", "/"))
    kind = tags.get("C", "420")
    chroma = next(share for name, share in _CHROMA.items() if kind.startswith(name))
    one = int(width * height * (1 + chroma))
    return Media(width, height, rate, f"yuv4mpeg2/{kind}", len(line) + 1, one, (size - len(line) - 1) // (one + len(_FRAME)))


class _Span(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]
        self.start, self.end = float(options.get("start", "0")), float(options.get("end", "inf"))

    def partitions(self):
        out = []
        for path in self.paths:
            m = probed(path)
            first, last = m.place(self.start), m.place(self.end)
            out += [_Span(path, a, min(a + PART_FRAMES, last)) for a in range(first, last, PART_FRAMES)]
        return out or [_Span("", 0, 0)]

    def read(self, span) -> Iterator[tuple]:
        if span.first >= span.last:
            return
        m = probed(span.path)
        step = m.frame_bytes + len(_FRAME)
        with _open(span.path) as f:
            f.seek(m.head + span.first * step)
            for k in range(span.first, span.last):
                raw = f.read(step)
                yield span.path, k, float(k / m.rate), m.height, m.width, bytearray(raw[len(_FRAME) : len(_FRAME) + m.width * m.height])


class VideoFrames(DataSource):
    """``spark.read.format("video_frames").option("path", ...)``, with ``start`` and ``end`` in seconds, half open."""

    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return "source_id string, place long, start_time double, height int, width int, pixels binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_frames(spark: SparkSession, paths: list[str], start: float = 0.0, end: float | None = None) -> DataFrame:
    """Luminance frames of videos: ``source_id, place, start_time, height, width, pixels``."""
    spark.dataSource.register(VideoFrames)
    reader = spark.read.format("video_frames").option("path", ",".join(paths)).option("start", repr(start))
    return (reader if end is None else reader.option("end", repr(end))).load()


def probe(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``source_id, duration_seconds, width, height, codec``, one row a video."""
    rows = [(p, (m := probed(p)).seconds, m.width, m.height, m.codec) for p in paths]
    return spark.createDataFrame(rows, "source_id string, duration_seconds double, width int, height int, codec string")


def decoded(files: DataFrame, decoder: Callable[[], Callable[[bytes], Iterator[tuple]]]) -> DataFrame:
    """Frames of other containers: ``decoder()`` is called once a task and gives ``(bytes) -> (time, height, width, pixels)`` rows.

    ``files`` has ``path, content`` (Spark's ``binaryFile``).
    """

    def run(batches):
        import pyarrow as pa

        read = decoder()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, (at, height, width, pixels) in enumerate(read(content.as_py())):
                    yield pa.RecordBatch.from_pydict({"source_id": [path], "place": pa.array([k], pa.int64()), "start_time": [float(at)], "height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32()), "pixels": pa.array([bytes(pixels)], pa.binary())})

    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, VideoFrames({}).schema())
