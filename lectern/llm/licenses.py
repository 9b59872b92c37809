"""License notices in texts, exact and with a bounded number of errors.

A notice that may have k errors is cut into k + 1 pieces; by the pigeonhole principle at
least one stands unchanged in any such match. A piece found says where the notice may
begin and end, give or take k characters; each run of whole words between such ends is
verified by the regex library's bounded-error matching, which also counts its edits.
"""

from __future__ import annotations

from bisect import bisect, bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import pick

# Phrases whose exact places are the base.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Notices sought with errors, as words joined by spaces.
NOTICES = (
    ("mit", "under the mit license"),
    ("mit", "permission is hereby granted free of charge"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("mpl-2", "mozilla public license version 2"),
    ("reserved", "all rights reserved"),
)
#: One error is allowed for so many characters of a notice, and so many at most: notices are short.
CHARS_PER_ERROR = 10
MOST_ERRORS = 3

#: A-Z to lower case; what is neither a digit, a-z nor beyond ASCII to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SPANS = "array<struct<label:string,first_word:long,n_words:long,errors:int,base:boolean>>"


def errors_allowed(notice: str, per: int = CHARS_PER_ERROR) -> int:
    return min(MOST_ERRORS, len(notice) // per)


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """Offset and text of errors + 1 pieces."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def spans_end(span: dict) -> int:
    return span["first_word"] + span["n_words"]


class Starts:
    """Numbers of words by where they begin in a line of words between single spaces; the list is made when first asked for."""

    def __init__(self, line: str) -> None:
        self.line = line
        self.at: list[int] = []

    def word(self, at: int) -> int:
        if not self.at:
            self.at = list(accumulate((len(w) + 1 for w in self.line[1:-1].split(" ")), initial=1))
        return bisect_left(self.at, at)


class Searcher:
    """Finds base phrases and notices in one text; edits are of characters."""

    def __init__(self, notices: tuple = NOTICES, phrases: tuple = PHRASES, per: int = CHARS_PER_ERROR) -> None:
        self.phrases = [(label, f" {p} ") for label, p in phrases]
        self.notices: list[tuple] = []
        self.seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (label, notice) in enumerate(notices):
            errors = errors_allowed(notice, per)
            self.notices.append((label, notice, errors, [regex.compile(f"(?:{regex.escape(notice)}){{e<={e}}}") for e in range(1, errors + 1)]))
            for offset, seed in pieces(notice, errors):
                self.seeds.setdefault(seed, []).append((k, offset))

    def __call__(self, text: str | None) -> tuple[int, list[dict]]:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
        line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        starts = Starts(line)
        return len(words), self._settled(self._base(line, starts) + self._fuzzy(line, starts))

    @staticmethod
    def _settled(spans: list[dict]) -> list[dict]:
        """Without notices that overlap a place of another label with fewer errors, or an exact phrase of their own."""
        meet = lambda a, b: a["first_word"] < b["first_word"] + b["n_words"] and b["first_word"] < a["first_word"] + a["n_words"]
        beats = lambda b, a: b["errors"] < a["errors"] and b["label"] != a["label"] or b["base"] and b["label"] == a["label"]
        spans, out, open_ = sorted(spans, key=lambda s: s["first_word"]), [], []
        rivals: list[list[dict]] = []
        for s in spans:  # spans that overlap stand close together
            open_ = [k for k in open_ if spans_end(out[k]) > s["first_word"]]
            rivals.append([out[k] for k in open_])
            for k in open_:
                rivals[k].append(s)
            open_.append(len(out))
            out.append(s)
        return [s for s, others in zip(out, rivals) if s["base"] or not any(meet(s, o) and beats(o, s) for o in others)]

    def _base(self, line: str, starts: Starts) -> list[dict]:
        out = []
        for label, phrase in self.phrases:
            at, n = line.find(phrase), phrase.count(" ") - 1
            while at >= 0:
                out.append({"label": label, "first_word": starts.word(at + 1), "n_words": n, "errors": 0, "base": True})
                at = line.find(phrase, at + 1)
        return out

    def _fuzzy(self, line: str, starts: Starts | None = None) -> list[dict]:
        starts = starts or Starts(line)
        near: dict[int, set[tuple[int, int]]] = {}
        for seed, found in self.seeds.items():
            at = line.find(seed)
            while at >= 0:
                for k, offset in found:
                    _, notice, errors, _ = self.notices[k]
                    first, last = at - offset, at - offset + len(notice)
                    spans = near.setdefault(k, set())
                    if first > 0 and line.startswith(f" {notice} ", first - 1):
                        spans.add((first, last))  # the others near it overlap it and have more errors
                        continue
                    ends = [e for e in range(last - errors, min(len(line) - 1, last + errors) + 1) if line[e : e + 1] == " "]
                    if ends:
                        spans.update((s, e) for s in range(max(1, first - errors), first + errors + 1) if line[s - 1 : s] == " " for e in ends if s < e)
                at = line.find(seed, at + 1)
        return [p for k, spans in near.items() for p in self._places(line, starts, k, spans)]

    def _places(self, line: str, starts: Starts, k: int, spans: set[tuple[int, int]]) -> list[dict]:
        """The spans within the bound of notice k; of those that overlap the one with fewest errors, then the first, then the shortest."""
        label, notice, _, patterns = self.notices[k]
        judged, known = [], {notice: 0}
        for s, e in spans:
            run = line[s:e]
            if run not in known:
                known[run] = next((n + 1 for n, p in enumerate(patterns) if p.fullmatch(run)), None)
            if known[run] is not None:
                judged.append((known[run], s, e))
        taken: list[tuple[int, int, int]] = []
        for errors, s, e in sorted(judged):
            at = bisect(taken, (s,))
            if not (at < len(taken) and taken[at][0] < e or at and taken[at - 1][1] > s):
                taken.insert(at, (s, e, errors))
        return [{"label": label, "first_word": starts.word(s), "n_words": line.count(" ", s, e) + 1, "errors": errors, "base": False} for s, e, errors in taken]


@lru_cache(maxsize=2)
def _searcher(notices: tuple, phrases: tuple, per: int) -> Searcher:
    return Searcher(notices, phrases, per)


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple = NOTICES, phrases: tuple = PHRASES, per: int = CHARS_PER_ERROR) -> DataFrame:
    """Every place of a phrase or notice in every whole text.

    Returns doc_id, n_words and spans (label, first_word from 0, n_words, errors, and
    base: an exact phrase; others are runs of whole words that differ from a notice by at
    most one character put in, left out or changed for `per` characters of it) for every
    row. Of overlapping runs the one with fewest errors counts, then the first, then the
    shortest. A notice goes if it overlaps an exact phrase of its label or a place of
    another label with fewer errors; places of equal errors of two labels both stay. Words
    are runs of a-z, digits and characters beyond ASCII, A-Z lower-cased. Null and empty texts have no words and spans; repeated rows are
    each returned, an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(notices, phrases, per)
        kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            found = [search(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], kind)], names=["doc_id", "n_words", "spans"])

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, n_words long, spans {SPANS}")


def license_summary(found: DataFrame) -> DataFrame:
    """One row of figures for each row of find_licenses(): places, labels and a score.

    score is 1 for a phrase or notice without errors, else 1 - errors / 10 of the place
    with fewest errors, 0 without any. Null and empty texts have no places.
    """
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    first = F.transform(base, lambda s: s["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: F.greatest(F.lit(0.0), 1 - s["errors"] / 10))), F.lit(0.0)).alias("score"),
        "spans",
    )
