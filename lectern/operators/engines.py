"""Pluggable engines and aligners: Python that runs a batch at a time inside Spark tasks."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Texts that an engine gets at once, and their characters (a longer text is alone); their samples are passed on before the next.
ROWS_AT_ONCE, CHARS_AT_ONCE = 64, 4_000


class Engine(Protocol):
    """Speech from texts; load() runs once in each task."""

    sample_rate: int

    def load(self) -> None: ...

    def generate(self, texts: list[str], seed: int) -> list[np.ndarray]: ...


class Aligner(Protocol):
    """Words with times and scores of clips of one language."""

    def align(self, clips: list[np.ndarray], rate: int, texts: list[str], language: str) -> list[list[dict]]: ...


@lru_cache(maxsize=1)
def _one_hertz(rate: int) -> np.ndarray:
    """A second of a tone of one hertz."""
    return (0.3 * np.sin(2 * np.pi * np.arange(rate) / rate)).astype(np.float32)


class ToneEngine:
    """Stub: a tone of 60 ms for each character, its pitch from text and seed: whole hertz, so that every second is the same."""

    sample_rate = 24_000

    def load(self) -> None:
        """Nothing to load."""

    def generate(self, texts: list[str], seed: int) -> list[np.ndarray]:
        out = []
        for text in texts:
            pitch = 110 + (sum(map(ord, text)) + seed) % 330
            second = _one_hertz(self.sample_rate)[np.arange(self.sample_rate) * pitch % self.sample_rate]
            out.append(np.resize(second, int(len(text) * 0.06 * self.sample_rate)))
        return out


class EvenAligner:
    """Stub: words share the clip's time by their lengths, all with score 1; unknown languages fail."""

    languages = ("en", "de", "fr", "es")

    def align(self, clips: list[np.ndarray], rate: int, texts: list[str], language: str) -> list[list[dict]]:
        if language not in self.languages:
            raise ValueError(f"no aligner for {language}")
        out = []
        for clip, text in zip(clips, texts):
            words = text.split()
            ends = np.cumsum([0, *map(len, words)]) * len(clip) / rate / max(1, sum(map(len, words)))
            out.append([{"word": w, "start": float(a), "end": float(b), "score": 1.0} for w, a, b in zip(words, ends, ends[1:])])
        return out


def aligned(clips: DataFrame, aligner_class: type) -> DataFrame:
    """clip_id, words, error of clips (clip_id, samples, rate, text, language), a batch of one language and rate at a time.

    A batch that fails has null words and the error; the others are not touched.
    """
    kind = "clip_id long, words array<struct<word:string,start:double,end:double,score:double>>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = aligner_class()
        for batch in batches:
            for (language, rate), part in batch.groupby(["language", "rate"], sort=False, dropna=False):
                try:
                    words, error = aligner.align([np.asarray(x) for x in part["samples"]], int(rate), list(part["text"]), language), None
                except (ValueError, OSError) as e:
                    words, error = [None] * len(part), str(e)
                yield pd.DataFrame({"clip_id": part["clip_id"], "words": words, "error": error})

    return clips.select("clip_id", "samples", "rate", "text", "language").mapInPandas(run, kind)


def load_engines(paths: dict[str, str]) -> tuple[dict[str, type], dict[str, str]]:
    """Classes by name from dotted paths, and the error of each that can't be imported."""
    found, errors = {}, {}
    for name, path in paths.items():
        module, _, attribute = path.rpartition(".")
        try:
            found[name] = getattr(importlib.import_module(module), attribute)
        except (ImportError, AttributeError, ValueError) as e:
            errors[name] = str(e)
    return found, errors


def retry_sizes(n: int) -> list[int]:
    """Batch sizes to try when memory runs out: all, a fifth less, then halves down to one."""
    if n <= 1:
        return [n] if n else []
    out = [n, n - max(1, n // 5)]
    while out[-1] > 1:
        out.append(out[-1] // 2)
    return list(dict.fromkeys(out))


def in_batches(engine: Engine, texts: list[str], seed: int) -> list[np.ndarray]:
    """All texts, in smaller batches each time memory runs out; the error stands if one text is too much."""
    sizes = retry_sizes(len(texts))
    for size in sizes:
        try:
            return [w for at in range(0, len(texts), size) for w in engine.generate(texts[at : at + size], seed)]
        except MemoryError:
            if size == sizes[-1]:
                raise
    return []


def text_ranges(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that an engine gets at once."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start == ROWS_AT_ONCE or size + n > CHARS_AT_ONCE):
            yield start, i
            start, size = i, 0
        size += n
    if lengths:
        yield start, len(lengths)


def _sample_lists(clips: list[np.ndarray], rate: int) -> pa.Array:
    """Clips as lists of numbers."""
    ends = pa.array(np.cumsum([0, *map(len, clips)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(clips), pa.float32()))


def generated(jobs: DataFrame, engine_class: type, encode: Callable[[list[np.ndarray], int], pa.Array] | None = None) -> DataFrame:
    """segment_idx, candidate_idx, attempt, samples: rows of one seed are generated together, longest texts first.

    With `encode` (of clips and their rate) there is a column audio of bytes in place of
    samples: so waveforms need not pass through Spark as arrays of numbers. Jobs are dealt by their keys, evenly and whatever seed they share.
    """
    keys, column = ["segment_idx", "candidate_idx", "attempt"], "audio" if encode else "samples"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = engine_class()
        engine.load()
        for batch in batches:
            seeds, lengths = batch["seed"].to_numpy(), pc.utf8_length(batch["text"]).to_pylist()
            starts = [0, *(np.flatnonzero(seeds[1:] != seeds[:-1]) + 1).tolist()]
            for start, stop in zip(starts, [*starts[1:], len(seeds)]):
                for a, b in text_ranges(lengths[start:stop]):
                    some = batch.slice(start + a, b - a)
                    made = in_batches(engine, some["text"].to_pylist(), int(seeds[start]))
                    yield pa.RecordBatch.from_arrays([*map(some.column, keys), (encode or _sample_lists)(made, engine.sample_rate)], [*keys, column])

    parts = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = jobs.repartition(parts, "segment_idx", "candidate_idx").sortWithinPartitions("seed", F.length("text").desc())
    kinds = {"segment_idx": "long", "candidate_idx": "int", "attempt": "int"}
    return dealt.select(*[F.col(k).cast(kind) for k, kind in kinds.items()], "seed", "text").mapInArrow(run, ", ".join(f"{k} {kind}" for k, kind in kinds.items()) + f", {column} {'binary' if encode else 'array<float>'}")


def results_by_name(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """`jobs` (name, ...) with words and error of the results (name, status, words, message) of a batch call.

    Only a success, in whatever case it is spelt, has words; else they are null and error
    is the message, or says that there is none, or no result.
    """
    held = jobs.join(results.select("name", "status", F.col("words").alias("__w"), "message"), "name", "left")
    good = F.coalesce(F.upper("status") == "SUCCESS", F.lit(False))
    error = F.when(F.col("status").isNull(), "no result").when(~good, F.coalesce("message", F.lit("unknown error")))
    return held.withColumn("words", F.when(good, F.col("__w"))).withColumn("error", error).drop("status", "message", "__w")


def results_by_key(jobs: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """`jobs` with the columns of the results that have the same keys, null where none has: order plays no part."""
    return jobs.join(results, list(keys), "left")


def voice_lookup(requests: DataFrame, voices: DataFrame) -> DataFrame:
    """Requests with the embedding of their voice token; error INVALID_TOKEN where the token isn't known."""
    held = requests.join(voices.select("token", "embedding"), "token", "left")
    return held.withColumn("error", F.when(F.col("token").isNotNull() & F.col("embedding").isNull(), "INVALID_TOKEN"))


# Status of each class of error.
ERROR_STATUS = {"client": 400, "invalid_token": 409, "synthesis": 500, "alignment": 500}


def error_status(kind: str):
    """Status column of a column of error classes; null is 200, unknown ones 500."""
    out = F.when(F.col(kind).isNull(), 200)
    for name, status in ERROR_STATUS.items():
        out = out.when(F.col(kind) == name, status)
    return out.otherwise(500)
