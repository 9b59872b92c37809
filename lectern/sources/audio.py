"""Sources and sinks: audio folders, manifests, requests, responses and WAV data."""

from __future__ import annotations

import io
import struct
import wave
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.options import template

# File types that are taken for audio.
AUDIO_SUFFIXES = ("mp3", "wav", "flac")
REQUEST = "text string, seed bigint, best_of int, max_retries int, return_timestamps boolean, options map<string,string>"


def stem(path: Column) -> Column:
    """Path without its last suffix."""
    return F.regexp_replace(path, r"\.[^./]*\z", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))


def only_audio(files: DataFrame) -> DataFrame:
    """Files (path, ...) whose suffix, in whatever case, is that of an audio file."""
    return files.where(suffix(F.col("path")).isin(*AUDIO_SUFFIXES))


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the audio files of a folder."""
    return only_audio(spark.read.format("binaryFile").load(folder)).select("path", "content")


def paired_texts(audio: DataFrame, texts: DataFrame) -> DataFrame:
    """Audio (path) with the text (path, text) of the same stem, stripped; those without text are left out."""
    words = texts.where(suffix(F.col("path")) == "txt").select(stem(F.col("path")).alias("stem"), F.regexp_replace("text", r"(?U)^\s+|\s+\z", "").alias("text"))
    return audio.withColumn("stem", stem(F.col("path"))).join(words.where("text <> ''"), "stem").drop("stem")


def manifest_rows(manifest: DataFrame, json_col: str = "json") -> DataFrame:
    """id, path, text of the entries of a JSON manifest that have both."""
    kind = "superblocks map<string,struct<active_audio_file_path:string,concatenated_text_for_tts:string>>"
    entries = manifest.select(F.explode(F.from_json(json_col, kind)["superblocks"]).alias("id", "e"))
    rows = entries.select("id", F.col("e.active_audio_file_path").alias("path"), F.col("e.concatenated_text_for_tts").alias("text"))
    return rows.where("length(path) > 0 and length(text) > 0")


def parsed_requests(requests: DataFrame, engines: list[str], json_col: str = "json", engine_col: str = "engine") -> DataFrame:
    """`requests` with request (typed), status (200, 404 or 422) and error."""
    held = requests.withColumn("__r", F.from_json(json_col, f"{REQUEST}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    r = F.col("__r")
    wrong = (
        F.when(r.isNull() | r["_bad"].isNotNull(), "malformed JSON")
        .when(F.coalesce(F.length(r["text"]), F.lit(0)) < 1, "text is empty")
        .when(~F.coalesce(r["best_of"], F.lit(1)).between(1, 10), "best_of is out of range")
        .when(~F.coalesce(r["max_retries"], F.lit(1)).between(0, 20), "max_retries is out of range")
    )
    unknown = F.when(~F.col(engine_col).isin(*engines), "unknown engine")
    error = F.coalesce(unknown, wrong)
    status = F.when(unknown.isNotNull(), 404).when(wrong.isNotNull(), 422).otherwise(200)
    return held.withColumn("status", status).withColumn("error", error).withColumn("request", F.when(error.isNull(), r.dropFields("_bad"))).drop("__r")


def responses(results: DataFrame) -> DataFrame:
    """`results` (audio binary, words array) as one JSON text each, the audio in base64 without line ends."""
    audio = F.replace(F.base64("audio"), F.lit("\r\n"), F.lit(""))
    return results.withColumn("response", F.to_json(F.struct(audio.alias("audio_base64"), F.col("words").alias("word_segments"))))


def config_template(spark: SparkSession) -> DataFrame:
    """One row: every option with its default, as JSON."""
    import json

    return spark.createDataFrame([(json.dumps(template()),)], "config string")


def health(spark: SparkSession, engines: dict[str, bool]) -> DataFrame:
    """A row for each engine: name and whether it could be loaded."""
    return spark.createDataFrame(sorted(engines.items()), "engine string, loaded boolean")


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples of PCM WAV data, -1 to 1."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(w.getnframes())
        if width == 3:  # the three bytes are the upper ones of four
            four = np.zeros((len(data) // 3, 4), np.uint8)
            four[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
            data, width = four.tobytes(), 4
        raw = np.frombuffer(data, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    raw = (raw - 128) / 128 if width == 1 else raw / float(1 << 8 * width - 1)
    return rate, raw.reshape(-1, channels).mean(1)


#: Bytes of a WAV header that has nothing but its format before the samples.
HEAD = 44
#: Samples that are encoded at once: they stay in a processor's cache.
SAMPLES_AT_ONCE = 1 << 15


def encode_wavs(clips: list[np.ndarray], rate: int) -> pa.Array:
    """PCM 16-bit mono WAV data of each clip, put where Arrow has it: none is copied again."""
    ends = np.cumsum([0, *(HEAD + 2 * len(x) for x in clips)])
    offsets, data = pa.array(ends, pa.int32()), np.empty(ends[-1], np.uint8)
    for samples, start, end in zip(map(np.asarray, clips), ends, ends[1:]):
        size = 2 * len(samples)
        struct.pack_into("<4sI4s4sIHHIIHH4sI", data, start, b"RIFF", HEAD - 8 + size, b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", size)
        out = data[start + HEAD : end].view("<i2")
        for at in range(0, len(samples), SAMPLES_AT_ONCE):
            out[at : at + SAMPLES_AT_ONCE] = (np.clip(samples[at : at + SAMPLES_AT_ONCE], -1, 1) * 32767).round()
    return pa.Array.from_buffers(pa.binary(), len(clips), [None, offsets.buffers()[1], pa.py_buffer(data)])


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """PCM 16-bit mono WAV data."""
    return encode_wavs([samples], rate)[0].as_py()


def wav_head(content: Column) -> Column:
    """The first bytes of WAV data whose samples follow its format at once; all bytes of other data."""
    at = lambda a, n: F.hex(F.substring(content, a, n))
    marks = [(1, b"RIFF"), (9, b"WAVEfmt "), (17, bytes([16, 0, 0, 0])), (37, b"data")]
    plain = reduce(lambda a, m: a & (at(m[0], len(m[1])) == m[1].hex().upper()), marks, F.lit(True))
    return F.when(plain, F.substring(content, 1, HEAD)).otherwise(content)


def probed(files: DataFrame) -> DataFrame:
    """path, rate, n (samples), error of WAV files (path, content), from their headers alone: samples stay out of Python."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rows.append((path, w.getframerate(), w.getnframes(), None))
                except (wave.Error, EOFError) as e:
                    rows.append((path, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "rate", "n", "error"]).astype({"rate": "Int32", "n": "Int32"})

    return files.select("path", wav_head(F.col("content")).alias("content")).mapInPandas(run, "path string, rate int, n int, error string")


def decoded(files: DataFrame) -> DataFrame:
    """path, rate, samples, error of WAV files (path, content); what can't be read has an error."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows.append((path, *decode_wav(content), None))
                except (wave.Error, EOFError, KeyError) as e:
                    rows.append((path, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples", "error"])

    return files.mapInPandas(run, "path string, rate int, samples array<float>, error string")


def encoded(clips: DataFrame, rate: int) -> DataFrame:
    """`clips` with audio: WAV data of column samples."""

    @F.pandas_udf("binary")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: encode_wav(s, rate), na_action="ignore")

    return clips.withColumn("audio", run("samples"))
