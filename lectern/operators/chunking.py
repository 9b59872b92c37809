"""Chunks of normalised text under a length limit, with the kind of break that follows each."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.parts import by_slices, by_values
from lectern.operators.sentence_ends import split_learned, with_ends
from lectern.options import TextOptions

# Places to cut a text that is too long, the best first.
DELIMITERS = (".", "?", "!", "—", "–", ";", ":", ",", " ")


def force_split(text: str, limit: int) -> list[str]:
    """Pieces of at most `limit` characters, cut after the last of the best delimiters in reach."""
    out, rest = [], text
    while len(rest) > limit:
        reach = rest[:limit]
        at = next((p + len(d) for d in DELIMITERS if (p := reach.rfind(d)) >= 0), limit)
        if piece := rest[:at].strip():
            out.append(piece)
        rest = rest[at:].lstrip()
    return [*out, rest] if rest else out


def chunk_cost(length: Column, o: TextOptions) -> Column:
    """How bad a chunk of that length is; infinite above the limit."""
    off = (length - o.ideal_chunk_length) / F.lit(float(o.ideal_chunk_length))
    cost = off * off * F.when(length < o.ideal_chunk_length * 0.5, o.shortness_penalty_factor).otherwise(1.0)
    return F.when(length > o.max_chunk_length, float("inf")).otherwise(cost)


@lru_cache(maxsize=8)
def _costs(ideal: int, most: int, penalty: float) -> list[float]:
    """Cost of a chunk of each length up to `most`."""
    return [((size - ideal) / ideal) ** 2 * (penalty if size < ideal * 0.5 else 1.0) for size in range(most + 1)]


def balanced_groups(lengths: list[int], ideal: int, most: int, penalty: float) -> list[tuple[int, int]]:
    """Ranges of sentences with the least total cost; of equal costs the shortest last range."""
    best, cut, costs = [0.0], [0], _costs(ideal, most, penalty)
    for i in range(1, len(lengths) + 1):
        least, at, size = float("inf"), 0, -1
        for j in range(i - 1, -1, -1):
            size += lengths[j] + 1
            if size > most:
                break
            total = best[j] + costs[size]
            if total < least:
                least, at = total, j
        best.append(least)
        cut.append(at)
    out, end = [], len(lengths)
    while end:
        out.append((cut[end], end))
        end = cut[end]
    return out[::-1]


def greedy_groups(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges filled one sentence after another."""
    out, start, size = [], 0, -1
    for i, n in enumerate(lengths):
        if size >= 0 and size + 1 + n > most:
            out.append((start, i))
            start, size = i, -1
        size += n + 1
    return [*out, (start, len(lengths))] if lengths else out


_CHUNK = pa.struct([("text", pa.string()), ("boundary", pa.string())])


def _simple_chunks(paragraphs: list[list[str]], most: int) -> list[dict]:
    """Pieces of all sentences of one text in a row."""
    parts = force_split(" ".join(u for p in paragraphs for s in p for u in force_split(s, most)), most)
    return [{"text": t, "boundary": "SENTENCE" if k == len(parts) - 1 else "HARD_LIMIT"} for k, t in enumerate(parts)]


def _units(sentences: pa.Array, most: int) -> tuple[pa.Array, np.ndarray]:
    """Pieces of sentences, and which sentence each is of. Sentences above the limit alone become Python objects."""
    n = pc.utf8_length(sentences).to_numpy(zero_copy_only=False)
    long = np.flatnonzero(n > most)
    pieces = [force_split(sentences[k].as_py(), most) for k in long.tolist()]
    counts = (n > 0).astype(np.int64)
    counts[long] = [len(p) for p in pieces]
    of = np.repeat(np.arange(len(n)), counts)
    if len(of) == len(n) and not len(long):
        return sentences, of
    at, cut = of.copy(), n[of] > most
    at[cut] = len(n) + np.arange(np.count_nonzero(cut))
    return pa.concat_arrays([sentences, pa.array([u for p in pieces for u in p], sentences.type)]).take(pa.array(at)), of


def chunk_array(paragraphs: pa.Array, o: TextOptions) -> pa.Array:
    """Chunks (text, boundary) of texts that are lists of paragraphs, which are lists of sentences.

    Ranges come from lengths; texts are put together in Arrow.
    """
    owned = paragraphs.flatten()
    size = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    units, of = _units(owned.flatten(), o.max_chunk_length)
    paragraph = np.repeat(np.arange(len(owned)), size(owned))[of]
    text = np.repeat(np.arange(len(paragraphs)), size(paragraphs))[paragraph]
    group = paragraph if o.chunking_strategy == "paragraph" else text
    last = np.append(group[1:] != group[:-1], True)[: len(group)]
    lengths, ends, start = pc.utf8_length(units).to_pylist(), [], 0
    for stop in (np.flatnonzero(last) + 1).tolist():
        if o.chunking_strategy == "greedy":
            ranges = greedy_groups(lengths[start:stop], o.max_chunk_length)
        else:
            ranges = balanced_groups(lengths[start:stop], o.ideal_chunk_length, o.max_chunk_length, o.shortness_penalty_factor)
        ends += [start + b for _, b in ranges]
        start = stop
    stops = np.array(ends, np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), units), " ").cast(pa.string())
    inner = last & (np.append(text[1:] == text[:-1], False)[: len(text)])
    boundary = pc.if_else(pa.array(inner[stops - 1]), "PARAGRAPH", "SENTENCE")
    offsets = np.append(0, np.cumsum(np.bincount(text[stops - 1], minlength=len(paragraphs))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([joined, boundary], fields=list(_CHUNK)), mask=paragraphs.is_null())


def _chunks(paragraphs: Column, o: TextOptions) -> Column:
    kind = "array<struct<text:string,boundary:string>>"
    if o.chunking_strategy == "simple":
        return by_values(paragraphs, lambda ps: _simple_chunks(ps, o.max_chunk_length), kind, pa.list_(_CHUNK))
    return by_slices(paragraphs, lambda part: chunk_array(part, o), kind, pa.list_(_CHUNK))


def split_long(sentences: Column, limit: int) -> Column:
    """Array of each sentence's pieces of at most `limit` characters."""
    return by_values(sentences, lambda ss: [force_split(s, limit) for s in ss], "array<array<string>>", pa.list_(pa.list_(pa.string())))


def chunk_documents(docs: DataFrame, o: TextOptions | None = None, id_col: str = "doc_id", text_col: str = "text", verbalise: T.Verbaliser | None = None, learned: DataFrame | None = None, lang_col: str = "lang") -> DataFrame:
    """doc_id, chunk_idx, text, boundary, n_chars: a row for each chunk. A row stays in its partition; each text goes to the chunker once.

    With `learned`, of learned_ends(), sentences end by what it says of the document's language.
    """
    o = o or TextOptions()
    split, ends = None, []
    if learned is not None:
        docs, ends = with_ends(docs, learned, lang_col), ["__ends"]
        split = lambda p: split_learned(p, F.col("__ends"))
    held = docs.select(F.col(id_col).alias("doc_id"), T.prepared(F.col(text_col), o).alias("__t"), *ends)
    held = held.select("doc_id", T.sentences(F.col("__t"), o, verbalise, split).alias("__p"))
    held = held.select("doc_id", F.posexplode_outer(_chunks(F.col("__p"), o)).alias("chunk_idx", "__c")).where("__c is not null")
    return held.select("doc_id", "chunk_idx", F.col("__c.text").alias("text"), F.col("__c.boundary").alias("boundary"), F.length("__c.text").alias("n_chars"))


def greedy_chunks(sentences: Column, limit: int) -> Column:
    """Greedy chunks of an array of sentences without Python; a sentence above the limit stays whole.

    A first pass over the lengths says at each sentence how long its chunk is up to there:
    only numbers are carried along. The marks between chunks are put in and cut at once.
    """
    marks = F.transform(sentences, lambda s: F.length(s))
    start = F.struct(F.lit(0).alias("size"), F.lit("").alias("cuts"))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["size"] > 0) & (acc["size"] + n + 1 <= limit)
        return F.struct(F.when(fits, acc["size"] + n + 1).otherwise(n).alias("size"), F.concat(acc["cuts"], F.when(fits, " ").otherwise(T.MARK)).alias("cuts"))

    cuts = F.aggregate(marks, start, step, lambda acc: acc["cuts"])
    joined = F.array_join(F.zip_with(F.split(cuts, ""), sentences, lambda c, s: F.concat(c, s)), "")
    return F.filter(F.split(joined, T.MARK), lambda c: c != "")


def greedy_sizes(lengths: Column, limit: int) -> Column:
    """Number (n) and last length (last) of the chunks that greedy_chunks() makes of sentences of those lengths, none empty."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["last"] > 0) & (acc["last"] + n + 1 <= limit)
        return F.struct(F.when(fits, acc["n"]).otherwise(acc["n"] + 1).alias("n"), F.when(fits, acc["last"] + n + 1).otherwise(n).alias("last"))

    return F.aggregate(lengths, start, step)


def label_boundaries(chunks: DataFrame, by_paragraph: bool = True) -> DataFrame:
    """Boundary of rows (doc_id, para_idx, chunk_idx): PARAGRAPH before a new paragraph, else SENTENCE."""
    from pyspark.sql import Window

    ahead = F.lead("para_idx").over(Window.partitionBy("doc_id").orderBy("para_idx", "chunk_idx"))
    change = ahead.isNotNull() & (ahead != F.col("para_idx")) & F.lit(by_paragraph)
    return chunks.withColumn("boundary", F.when(change, "PARAGRAPH").otherwise("SENTENCE"))


def without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id and error of the documents that have nothing to say. Documents without an id count as one, as in every grouping."""
    said = chunks.select(F.col("doc_id").alias("__said")).distinct()
    return docs.join(said, F.col("doc_id").eqNullSafe(F.col("__said")), "left_anti").select("doc_id", F.lit("nothing to say").alias("error"))
