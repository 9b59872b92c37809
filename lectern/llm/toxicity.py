"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in hashed words and word beginnings; a document's is their noisy-or,
1 - prod(1 - p). Spark counts which of them are commoner in toxic documents of a bounded
sample; only those reach the driver, which fits their weights by gradient descent on the
document labels. Sentences with a high probability are then the offending ones.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import pick, staged
from lectern.llm.vocabulary import Vocabulary

#: Hashed words.
BUCKETS = 1 << 18
#: Labelled rows of each class that training takes at most, by the order of a hash of the id.
SAMPLE_ROWS = 4000
#: Words that the texts of those rows have at most in each class: rows are taken in that order up to it.
SAMPLE_WORDS = 4_000_000
#: A document of more than this share of the bound is left out of the sample.
LONG_SHARE = 0.1
#: Letters of the prefixes that are features besides the word.
PREFIXES = (3, 4, 5, 6)
#: Documents of the sample that a word has to be in.
LEAST_DOCS = 5
#: Standard deviations by which a word has to be commoner in toxic documents than chance would have it.
LEAST_LIFT = 2.0
#: Penalty of a weight, in documents.
PENALTY_DOCS = 1.5
#: Sentences from this probability on are reported.
SENTENCE_LIMIT = 0.5

_LOG = logging.getLogger(__name__)
_OUTER = "\"'()[]{}<>.,;:!?*#&$%“”‘’«»¿¡…–—-_|"


_SEEDS = [zlib.crc32(b"%d " % k) for k in range(1 + len(PREFIXES))]


def features(word: str) -> list[int]:
    """Buckets of a word and of its prefixes; BUCKETS where there is none."""
    core = (word if word.isalpha() else word.strip(_OUTER)).lower()
    parts = [core, *(core[:n] if len(core) > n else "" for n in PREFIXES)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass"), seed) % BUCKETS if p else BUCKETS for p, seed in zip(parts, _SEEDS)]


def _ends(word: str) -> int:
    """1 if a sentence ends after the word, 2 for a line feed, which is no word."""
    return 2 if word == "\x01" else int(not word.isalpha() and word.rstrip("\"')]”’»").endswith((".", "!", "?")))


class Sentences:
    """Words of a text and where its sentences start; a sentence ends at . ! ? or a line feed.

    A word is its buckets, or its weight if there is a model.
    """

    def __init__(self, model: Model | None = None) -> None:
        if model is None:
            self.known = Vocabulary(lambda w: (*features(w), _ends(w)), [np.int32] * (1 + len(PREFIXES)) + [np.int8])
        else:
            weight = {k: float(model.weights[k]) for k in np.flatnonzero(model.weights).tolist()}
            self.known = Vocabulary(lambda w: (sum([weight[f] for f in features(w) if f in weight]), _ends(w)), [np.float64, np.int8])

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        self.known.begin()
        rows = self.known.rows((text or "").replace("\n", " \x01 ").split())
        *values, ends = (c[rows] for c in self.known.columns)
        start, real = np.concatenate([[True], ends[:-1] > 0])[: len(rows)], ends < 2
        values, starts = [c[real] for c in values], np.flatnonzero(start[real])
        return (values[0] if len(values) == 1 else np.stack(values, axis=1)), starts.astype(np.int32)


@dataclass
class Model:
    """Weights of the buckets, the last (no bucket) zero."""

    weights: np.ndarray
    bias: float

    def sentences(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of each sentence, from the weights of its words."""
        return np.add.reduceat(values, starts) + self.bias if len(starts) else np.zeros(0)

    def document(self, logits: np.ndarray) -> float:
        """Noisy-or; a text without words counts as one empty sentence."""
        if not len(logits):
            logits = np.array([self.bias])
        return float(-np.expm1(-np.logaddexp(0, logits).sum()))


@dataclass
class Bags:
    """Sampled documents: label, weight, and how many of their sentences have no feature; of each feature its sentence, of each sentence its document."""

    labels: np.ndarray
    share: np.ndarray
    empty: np.ndarray
    feats: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray


def log_miss(bags: Bags, z: np.ndarray, bias: float) -> np.ndarray:
    """-log of the noisy-or's product, prod(1 - p), of each document."""
    return np.bincount(bags.doc, np.logaddexp(0, z), len(bags.labels)) + bags.empty * np.logaddexp(0, bias)


def fit(bags: Bags, size: int, rounds: int = 150, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights of `size` features and bias, by proximal Adam on the log loss of the noisy-or, with an L1 penalty."""
    n, share = len(bags.labels), bags.share / bags.share.mean()
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = -6.0
    penalty = np.append(np.full(size, PENALTY_DOCS / n), 0.0)
    for t in range(1, rounds + 1):
        z = np.clip(np.bincount(bags.sentence, w[bags.feats], len(bags.doc)) + w[-1], -30, 30)
        toxic = -np.expm1(-log_miss(bags, z, w[-1]))
        slope = share / n * np.where(bags.labels > 0, -(1 - toxic) / np.maximum(toxic, 1e-9), 1.0)
        g_sentence = slope[bags.doc] / (1 + np.exp(-z))
        g = np.append(np.bincount(bags.feats, g_sentence[bags.sentence], size), g_sentence.sum() + (slope * bags.empty).sum() / (1 + np.exp(-w[-1])))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        w = w - step * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
    return w[:-1], float(w[-1])


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves `part` when divided by `parts`; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def sampled_labels(labels: DataFrame, label_col: str, parts: int, part: int, rows: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id, label (0 or 1), share: at most `rows` training rows of each class; share undoes the sampling.

    Rows with a null id or label are left out; a document labelled twice has its highest label.
    """
    known = pick(labels, doc_id=id_col, label=label_col).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("label") > 0).cast("int").alias("label"))
    known = known.where(F.col("label").isNotNull() & ~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = dict(known.groupBy("label").count().collect())
    out = None
    for label in (0, 1):
        n = totals.get(label, 0)
        one = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("share", F.lit(max(1.0, n / rows)))
        out = one if out is None else out.unionByName(one)
    return out


def sampled_texts(docs: DataFrame, labels: DataFrame, label_col: str, parts: int, part: int, sample_rows: int, most: int, size: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """label, share, text of a bounded sample of labelled rows, staged: documents of sampled_labels(), whole, in the order of a hash.

    A class's documents are taken while their `size` (of text) is at most `most` in all.
    One of more than a LONG_SHARE of that is left out, which is logged; of a
    class that has such ones alone the shortest is taken, so a class with labels never
    goes. share undoes the sampling of rows and what is left out. Of rows with one id the
    text with the least hash counts.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    picked = F.broadcast(sampled_labels(labels, label_col, parts, part, sample_rows))  # at most twice sample_rows
    one = rows.join(picked, "doc_id").groupBy("doc_id", "label", "share").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    one = staged(one.withColumn("n", size), "sample")
    long = F.when(F.col("n") > most * LONG_SHARE, F.col("n")).otherwise(0)
    order = Window.partitionBy("label").orderBy("long", F.xxhash64("doc_id"), "doc_id")
    ranked = one.select("doc_id", "label", "n", long.alias("long")).withColumn("k", F.row_number().over(order))
    ranked = ranked.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("take", (F.col("long") == 0) & (F.col("before") + F.col("n") <= most) | (F.col("k") == 1))
    kept = F.sum(F.col("take").cast("int")).over(Window.partitionBy("label"))
    taken = ranked.withColumn("more", F.count("*").over(Window.partitionBy("label")) / kept)
    if (left := taken.where("not take and long > 0").count()):
        _LOG.warning("%d labelled documents of more than %.0f are left out of the sample", left, most * LONG_SHARE)
    taken = F.broadcast(taken.where("take").select("doc_id", "more"))
    return staged(one.join(taken, "doc_id").select("label", (F.col("share") * F.col("more")).alias("share"), "text"), "sample")


def chosen_features(sample: DataFrame) -> np.ndarray:
    """Buckets of words and prefixes that are in toxic documents more often than chance would have it; fewer than BUCKETS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Sentences()
        for batch in batches:
            once = [np.unique(cut(t.as_py())[0]).astype(np.int32) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([f[f < BUCKETS] for f in once], pa.list_(pa.int32()))], names=["label", "share", "feats"])

    n, mass, toxic = sample.agg(F.count("*"), F.sum("share"), F.sum(F.col("share") * F.col("label"))).first()
    rate, scale = toxic / mass, n / mass
    found = sample.mapInArrow(run, "label int, share double, feats array<int>").select("label", "share", F.explode("feats").alias("f"))
    found = found.groupBy("f").agg(F.count("*").alias("held"), F.sum(F.col("share") * scale).alias("mass"), F.sum(F.col("share") * scale * F.col("label")).alias("toxic"))
    lift = (F.col("toxic") - F.col("mass") * rate) / F.sqrt(F.col("mass") * (rate * (1 - rate)))
    return np.sort(np.array([r[0] for r in found.where((F.col("held") >= LEAST_DOCS) & (lift >= LEAST_LIFT)).select("f").collect()], np.int64))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", parts: int = 5, part: int = 0, sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a sample of labelled rows that are not held out; the driver gets the chosen features of their sentences."""
    sample = sampled_texts(docs, labels, label_col, parts, part, sample_rows, sample_words, F.size(F.split("text", r"\s+")), id_col, text_col)
    classes = {r[0] for r in sample.select("label").distinct().collect()}
    if len(classes) < 2:
        return Model(np.zeros(BUCKETS + 1), 20.0 if 1 in classes else -20.0)
    chosen = chosen_features(sample)
    number = np.full(BUCKETS + 1, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    held = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Sentences()
        for batch in batches:
            feats, sentence, empty = [], [], []
            for t in batch.column(2):
                f, starts = cut(t.as_py())
                k = held.value[f.astype(np.int64)]
                word, column = np.nonzero(k >= 0)
                own, local = np.unique(np.searchsorted(starts, word, "right"), return_inverse=True)
                feats.append(k[word, column]), sentence.append(local.astype(np.int32)), empty.append(max(1, len(starts)) - len(own))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (feats, sentence)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(empty, pa.int32()), *lists], names=["label", "share", "empty", "feats", "sentence"])

    found = sample.mapInArrow(run, "label int, share double, empty int, feats array<int>, sentence array<int>").toArrow()
    local = [x.values.to_numpy() for x in found["sentence"]]
    sizes = np.array([x.max() + 1 if len(x) else 0 for x in local], np.int64)
    sentence = np.concatenate([x + at for x, at in zip(local, np.cumsum(sizes) - sizes)]).astype(np.int64)
    feats = np.concatenate([x.values.to_numpy() for x in found["feats"]]).astype(np.int64)
    bags = Bags(*(found[c].to_numpy() for c in ("label", "share", "empty")), feats, sentence, np.repeat(np.arange(len(sizes)), sizes))
    weights = np.zeros(BUCKETS + 1)
    weights[chosen], bias = fit(bags, len(chosen))
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", limit: float = SENTENCE_LIMIT) -> DataFrame:
    """Every row's doc_id, score (0 to 1), and sentences: number from 0 and probability of those that offend.

    Whole texts; null and empty texts get the score of an empty sentence; repeated rows
    are each scored, an empty table gives none; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        cut = Sentences(m)
        kind = pa.list_(pa.struct([("sentence", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for t in batch.column(1):
                z = m.sentences(*cut(t.as_py()))
                scores.append(m.document(z))
                at = np.flatnonzero(z >= np.log(limit / (1 - limit)))
                spans.append([{"sentence": k, "p": p} for k, p in zip(at.tolist(), (1 / (1 + np.exp(-z[at]))).tolist())])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "sentences"])

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, sentences array<struct<sentence:int,p:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0) -> DataFrame:
    """Train on labelled rows that are not held out, then score every row: doc_id, held_out, score, predicted, sentences.

    Without labels of both classes every score is 0 (or 1, if all are toxic).
    """
    scored = score(docs, train(docs, labels, "toxic", parts, part))
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
