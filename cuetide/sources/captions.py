"""Caption files (SRT, WebVTT) in, captions and transcripts out; all as columns of text."""

from __future__ import annotations

import posixpath
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clock, subtitle_time
from ..operators import folds

_TIME = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})"
_LINE = _TIME + r"[ \t]*-->[ \t]*" + _TIME
#: Inline markup: tags and override blocks.
_MARKUP = r"</?[A-Za-z][^>]*>|\{[^}]*\}"


def read_captions(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects) of caption files, by :func:`parsed`."""
    files = spark.read.text(paths, wholetext=True)
    return parsed(files.select(F.input_file_name().alias("source_id"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("body")))


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects) of ``source_id, name, body``: an event with bad timing becomes a reject, its file goes on.

    ``source_id, source_index, id, start_time, end_time, text``. A text goes on over blank lines up to the next event, whose
    number it doesn't keep; markup goes; blank texts are dropped.
    """
    body = F.regexp_replace("body", r"\r\n?", "\n")
    events = files.select("source_id", "name", F.posexplode(F.filter(F.split(body, r"(?m)^(?=[^\n]*-->)"), lambda b: b.contains("-->"))).alias("source_index", "block"))
    part = lambda k: F.nullif(F.regexp_extract("block", _LINE, k), F.lit("")).cast("double")
    seconds = lambda k: F.coalesce(part(k), F.lit(0.0)) * 3600 + part(k + 1) * 60 + part(k + 2) + F.rpad(F.nullif(F.regexp_extract("block", _LINE, k + 3), F.lit("")), 3, "0").cast("double") / 1000
    rest = F.rtrim(F.regexp_replace("block", r"^[^\n]*\n?", ""), F.lit(" \n\t"))
    text = F.trim(F.regexp_replace(F.regexp_replace(rest, r"(^|\n+)[ ]*\d+$", ""), _MARKUP, ""), F.lit(" \n\t"))
    rows = events.select("source_id", "source_index", F.concat_ws(":", "name", "source_index").alias("id"), seconds(1).alias("start_time"), seconds(5).alias("end_time"), text.alias("text"))
    good = F.coalesce(F.col("end_time") > F.col("start_time"), F.lit(False))
    return rows.where(good & (F.col("text") != "")), rows.where(~good).select("source_id", "source_index", F.lit("bad timing").alias("reason"))


def caption_files(cues: DataFrame, kind: str = "srt", key: str = "source_id") -> DataFrame:
    """One row a source, ``key, body``: its whole file, ``srt`` or ``vtt``. A source is as long as one recording."""
    if kind not in ("srt", "vtt"):
        raise ValueError("kind is srt or vtt")
    mark = "," if kind == "srt" else "."
    kept = cues.where(F.col("review_state") != "rejected")
    part = F.struct("start_time", "end_time", "id", F.array_join(F.transform("layers", lambda x: x["text"]), "\n").alias("said"))
    ordered = kept.groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    block = lambda p, k: F.concat((k + 1).cast("string"), F.lit("\n"), subtitle_time(p["start_time"], mark), F.lit(" --> "), subtitle_time(p["end_time"], mark), F.lit("\n"), p["said"], F.lit("\n"))
    head = F.lit("WEBVTT\n\n" if kind == "vtt" else "")
    return ordered.select(key, F.concat(head, F.array_join(F.transform("parts", block), "\n")).alias("body"))


def write_files(files: DataFrame, folder: str, kind: str = "srt", key: str = "source_id") -> DataFrame:
    """Writes each row of :func:`caption_files` as ``<key>.<kind>`` and returns the paths.

    A file appears whole: it is written aside and renamed, so a lost task leaves none behind under that name.
    """

    def run(batches):
        from pyarrow import fs

        plain = folder.startswith("/") or folder.startswith("file:")
        store, base = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if plain else fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        for batch in batches:
            paths = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{name}.{kind}"
                aside = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(aside) as out:
                    out.write(body.encode())
                store.move(aside, path)
                paths.append(path)
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    return files.select(F.col(key).cast("string"), "body").mapInArrow(run, "path string")


def target_path(source: str, target: str | None = None) -> str:
    """Where a reconstruction of ``source`` goes: never over it; by default ``<stem>.reconstructed<suffix>``."""
    stem, dot, suffix = source.rpartition(".")
    path = target or (f"{stem}.reconstructed.{suffix}" if dot and "/" not in suffix else f"{source}.reconstructed")
    if normalized_path(path) == normalized_path(source):
        raise ValueError("the target must not be the source")
    return path


def normalized_path(path: str) -> str:
    return posixpath.normpath(path.replace("\\", "/"))


def source_key(path: Column) -> Column:
    """A path as a source's key: forward slashes, lower case."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def reconstructed(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cues, observations, rejects) of caption files: parsed, then rolling captions folded into whole cues."""
    good, bad = parsed(files)
    cues = folds.rolling(good.select("source_id", "id", F.col("source_index").alias("seq"), "start_time", "end_time", "text"))
    return cues, good, bad


def srt_blocks(cues: DataFrame, key: str = "source_id") -> DataFrame:
    """One SRT block a kept cue, numbered within its source by (start, end, id)."""
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy(key).orderBy("start_time", "end_time", "id"))
    texts = F.array_join(F.transform("layers", lambda x: x["text"]), "\n")
    body = F.concat(number.cast("string"), F.lit("\n"), subtitle_time(F.col("start_time")), F.lit(" --> "), subtitle_time(F.col("end_time")), F.lit("\n"), texts, F.lit("\n"))
    return cues.where(F.col("review_state") != "rejected").select(key, number.alias("number"), body.alias("block"))


def transcript(cues: DataFrame, key: str = "source_id") -> DataFrame:
    """``[HH:MM:SS]`` and each layer on a line of its own, one row a kept cue."""
    body = F.concat(F.lit("["), clock(F.col("start_time")), F.lit("]\n"), F.array_join(F.transform("layers", lambda x: x["text"]), "\n"))
    return cues.where(F.col("review_state") != "rejected").select(key, "id", body.alias("block"))


def reading_transcript(cues: DataFrame, languages: list[str] | None = None, gap: float = 30.0, key: str = "source_id") -> DataFrame:
    """One text a source: kept cues' layers on lines, a time heading first and again ``gap`` seconds or more after the last one.

    ``languages`` chooses layers; cues left without one make no heading.
    """
    layers = F.col("layers") if languages is None else F.filter("layers", lambda x: x["language"].isin(*languages))
    kept = cues.where(F.col("review_state") != "rejected").withColumn("layers", layers).where(F.size("layers") > 0)
    part = F.struct("start_time", "end_time", "id", F.array_join(F.transform("layers", lambda x: x["text"]), "\n").alias("said"))
    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit("").alias("body"))

    def add(acc, p):
        due = acc["at"].isNull() | (p["start_time"] - acc["at"] >= gap)
        head = F.when(due, F.concat(F.lit("## "), clock(p["start_time"]), F.lit("\n"))).otherwise("")
        return F.struct(F.when(due, p["start_time"]).otherwise(acc["at"]).alias("at"), F.concat(acc["body"], head, p["said"], F.lit("\n")).alias("body"))

    return kept.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list(part)), start, add, lambda acc: acc["body"]).alias("body"))
