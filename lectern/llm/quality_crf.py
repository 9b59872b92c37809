"""Document quality from lines: a linear-chain conditional random field with two states.

Each line is good or bad. Its features are figures of the line and of the lines before
and after it; neighbouring states are tied by transition weights. Only documents are
labelled, so the states of their lines are latent: training alternates between the
lines' marginals, tilted in each document just so far that their length-weighted mean
agrees with its label, and weights fitted to those. A bad document's good lines are thus
learned as good ones. A document's quality is the mean of its lines' forward-backward
marginals, weighted by their lengths, put on a probability scale that is fitted on the
same training documents.

Training cuts a document of more than SEQUENCE_LINES lines into several sequences, whose
lines are tilted alike; only the transitions at the cuts are not learned from. Scoring
cuts nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import pick
from lectern.llm.toxicity import held_out, sampled_texts

#: Labelled rows of each class that training takes at most, by the order of a hash of the id.
SAMPLE_ROWS = 3000
#: Lines that the texts of those rows have at most in each class: rows are taken in that order up to it.
SAMPLE_LINES = 100_000
#: Length-weighted mean of the marginals that a good document has at least, a bad one at most, in training.
GOOD_SHARE, BAD_SHARE = 0.9, 0.25
#: Lines of a training sequence; a longer document is several.
SEQUENCE_LINES = 64
#: Figures of a line.
WIDTH = 12

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>{}[]~^=+_\\/@"


def line_figures(line: bytes) -> tuple[float, ...]:
    """What is known of one line; all zero but the first without words."""
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return (1.0,) + (0.0,) * (WIDTH - 1)
    return (
        0.0,
        1.0 if line.isupper() else 0.0,
        min(1.0, (size - len(line.translate(None, _UPPER))) / size),
        min(3.0, (size - len(line.translate(None, _SYMBOLS))) / n),
        min(2.0, line.count(b"!") / n),
        1 - len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        (size - len(line.translate(None, _DIGITS))) / size,
        min(3.0, size / n / 10),
        min(2.0, n / 20),
        0.0 if line.rstrip()[-1:] in b".!?" else 1.0,
        min(1.0, line.count(b" | ") / n),
    )


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Figures of each line, the one before and the one after, and a constant."""
    edge = np.zeros((1, x.shape[1]), x.dtype)
    return np.hstack([x, np.vstack([edge, x[:-1]]), np.vstack([x[1:], edge]), np.ones((len(x), 1), x.dtype)])


def lines_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and byte lengths of the lines of a text; an empty text is one empty line."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    x = np.array([line_figures(b) for b in lines], np.float64)
    return with_neighbours(x), np.array([len(b) for b in lines], np.float64)


@dataclass
class Field:
    """Emission weights of the good state, transition weights, and the scale of document scores."""

    emission: np.ndarray
    transition: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def document(self, good: np.ndarray, lengths: np.ndarray) -> float:
        """Length-weighted mean of the marginals."""
        return float((good * lengths).sum() / lengths.sum()) if lengths.sum() else float(good.mean())

    def scaled(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(raw) + self.shift, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def marginals(field: Field, x: np.ndarray, sizes: np.ndarray, tilt: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and expected transitions in all; sequences of `sizes` lines, one after the other.

    `tilt` is added to the log odds of each line. Sequences are walked side by side, the
    longest first, a line at a time.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    z = np.clip(x @ field.emission + tilt, -20, 20)
    local = np.stack([np.exp(-z / 2), np.exp(z / 2)], axis=1)
    move = np.exp(field.transition)
    alpha, beta = np.empty_like(local), np.ones_like(local)
    longest = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(longest), "left")  # sequences with more than t lines
    for t in range(longest):
        at = starts[: alive[t]] + t
        a = local[at] if t == 0 else (alpha[at - 1] @ move) * local[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        b = (beta[at + 1] * local[at + 1]) @ move.T
        pair = alpha[at][:, :, None] * move * (beta[at + 1] * local[at + 1])[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        beta[at] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), expected


def tilted(field: Field, x: np.ndarray, sizes: np.ndarray, doc: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected transitions with each document's log odds shifted just so far that its label holds; `doc` numbers each line's document."""
    n = len(labels)
    share = lengths + 1e-9
    share = share / np.bincount(doc, share, n)[doc]
    mean = lambda shift: np.bincount(doc, marginals(field, x, sizes, shift[doc])[0] * share, n)
    start = mean(np.zeros(n))
    wrong = np.where(labels > 0, start < GOOD_SHARE, start > BAD_SHARE)
    low, high = np.zeros(n), np.full(n, 40.0)  # bisection on how far; more lets the label hold
    for _ in range(12):
        mid = (low + high) / 2
        now = mean(np.where(wrong, np.where(labels > 0, mid, -mid), 0.0))
        holds = np.where(labels > 0, now >= GOOD_SHARE, now <= BAD_SHARE)
        low, high = np.where(holds, low, mid), np.where(holds, mid, high)
    return marginals(field, x, sizes, np.where(wrong, np.where(labels > 0, high, -high), 0.0)[doc])


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: np.ndarray, turns: int = 5, rounds: int = 40, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Weights from documents (features and lengths of their lines), their labels and weights."""
    width = 3 * WIDTH + 1
    if not len(docs) or labels.min() == labels.max():
        return Field(np.zeros(width), np.zeros((2, 2)), 0.0, 20.0 if len(docs) and labels.max() else -20.0)
    x, lengths = np.vstack([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
    n = np.array([len(d[0]) for d in docs])
    doc = np.repeat(np.arange(len(docs)), n)
    sizes = np.concatenate([[min(SEQUENCE_LINES, k - i) for i in range(0, k, SEQUENCE_LINES)] for k in n.tolist()]).astype(np.int64)
    weight = (share / share.sum() / n)[doc]
    field, total = Field(np.zeros(width), np.zeros((2, 2))), max(1.0, float((sizes - 1).sum()))
    for turn in range(turns):
        # the first turn takes lines as their documents and learns no transitions
        y, steps = tilted(field, x, sizes, doc, lengths, labels) if turn else (labels[doc], None)
        m, v = np.zeros(width + 4), np.zeros(width + 4)
        for t in range(1, rounds + 1):
            good, expected = marginals(field, x, sizes)
            moved = (expected - steps) / total if turn else np.zeros((2, 2))
            g = np.append((weight * (good - y)) @ x, moved.ravel())
            g += decay * np.append(field.emission, field.transition.ravel() * 10)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            field = Field(field.emission - step[:width], field.transition - step[width:].reshape(2, 2))
    good, _ = marginals(field, x, n)
    raw = _logit(np.array([field.document(p, d[1]) for p, d in zip(np.split(good, np.cumsum(n)[:-1]), docs)]))
    slope, shift = 1.0, 0.0
    for _ in range(200):  # logistic scale, by damped gradient steps
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))
        e = (p - labels) * share / share.sum()
        h = p * (1 - p) * share / share.sum() + 1e-6
        slope -= 0.5 * (e @ raw + 1e-4 * (slope - 1)) / (h @ raw**2 + 1e-4)
        shift -= 0.5 * e.sum() / h.sum()
    return Field(field.emission, field.transition, max(slope, 0.05), shift)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", parts: int = 3, part: int = 1, sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on a sample of labelled rows that are not held out; the driver gets the figures of their lines, at most 2 * sample_lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [lines_of(t.as_py()) for t in batch.column(2)]
            figures = [x[:, :WIDTH].astype(np.float32).ravel() for x, _ in lines]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(figures, pa.list_(pa.float32())), pa.array([n for _, n in lines], pa.list_(pa.float64()))], names=["label", "share", "x", "n"])

    sample = sampled_texts(docs, labels, label_col, parts, part, sample_rows, sample_lines, F.size(F.split("text", "\n")), id_col, text_col)
    found = sample.mapInArrow(run, "label int, share double, x array<float>, n array<double>").toArrow()
    lines = [(with_neighbours(x.values.to_numpy().reshape(-1, WIDTH).astype(np.float64)), n.values.to_numpy()) for x, n in zip(found["x"], found["n"])]
    return fit(lines, found["label"].to_numpy().astype(np.float64), found["share"].to_numpy())


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's doc_id, score (0 to 1) and bad_lines: numbers from 0 of the lines that are rather bad.

    Whole texts; null and empty texts are one empty line; repeated rows are each scored,
    an empty table gives none; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for batch in batches:
            for some in _portions(batch):
                lines = [lines_of(t.as_py()) for t in some.column(1)]
                sizes = np.array([len(x) for x, _ in lines])
                good = np.split(marginals(f, np.vstack([x for x, _ in lines]), sizes)[0], np.cumsum(sizes)[:-1])
                raw = np.array([f.document(p, n) for p, (_, n) in zip(good, lines)])
                bad = [np.flatnonzero(p < 0.5).astype(np.int32) for p in good]
                yield pa.record_batch([some.column(0), pa.array(f.scaled(raw)), pa.array(bad, pa.list_(pa.int32()))], names=["doc_id", "score", "bad_lines"])

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, bad_lines array<int>")


def _portions(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def quality(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1) -> DataFrame:
    """Train on labelled rows that are not held out, then score every row: doc_id, held_out, score, predicted, bad_lines.

    Without labels of both classes every score is 0 (or 1, if all are good).
    """
    scored = score(docs, train(docs, labels, "quality", parts, part))
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "bad_lines")
