"""Benchmark decontamination by templates.

Words become canonical: lower case without outer punctuation, with typed placeholders
for numbers, names (capitalised inside a sentence) and units (after a number); adjacent
words of one type are one placeholder, and a capitalised word that starts a sentence is
hashed both as it is and as a name. Windows of canonical words of every benchmark item
and every document are hashed and joined by hash. Hits of one item in one order, between
which a few words may be put in or left out, count together if their slots are
consistent: a value of the item always stands for one value of the document, and the
other way round. So a question asked again with other numbers or names is caught, one
that mixes them up is not.

The join goes in steps, so that windows in many items or documents don't multiply. A
Bloom filter of the items' windows leaves out most windows of documents where they are
made. An item that is found to 0.8 has at least one hit among any 0.2 of its windows and
one more, so its rarest windows decide which pairs of document and item are looked at;
the other windows are joined for those pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bloom import Level, filled, sized
from lectern.llm.common import by_id, pick, small, staged
from lectern.llm.vocabulary import Vocabulary

#: Words of a window.
WINDOW = 5
#: Share of an item's windows that have to be found on one alignment.
SIMILARITY = 0.8
#: Words put in or left out between two hits of an alignment.
DRIFT = 10
#: Choices of values that are tried for an alignment at most.
STEPS = 10_000
#: Literal words that a window needs.
LITERALS = 2
#: The items' windows go to the tasks as a Bloom filter up to so many (under two bytes each); more are joined unfiltered.
FILTER_KEYS = 64_000_000
FILTER_RATE = 0.001
#: A window in more items than that is joined only for pairs of document and item that rarer windows found.
SHARED_ITEMS = 16

# Units of measure and money that follow a number.
UNITS = frozenset(
    "% $ € £ ¢ ° mm cm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg kilogram kilograms "
    "gram grams t ton tons lb lbs pound pounds oz ounce ounces ml cl l liter liters litre litres gal gallon gallons s sec second seconds "
    "min minute minutes h hr hour hours day days week weeks month months year years mph kmh c f k w kw v a hz khz mhz ghz "
    "j kj cal kcal pa kpa bar percent dollar dollars euro euros cent cents degree degrees".split()
)
_NUMBER = re.compile(r"[-+$€£]?\d+(?:[.,:/]\d+)*(%|[^\W\d_]{0,3})")
_DIGIT = re.compile(r"\d")
_EDGE = "\"'()[]{}<>.,;:!?*#&$%“”‘’«»¿¡…–—-_|"
_NUM, _NAME, _UNIT = "\x00num", "\x00name", "\x00unit"
_WEIGHTS = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64) | 1) for j in range(WINDOW)]
#: Characters of texts that are made canonical at once.
STREAM_CHARS = 1 << 20
# kinds of words, and flags besides
_LITERAL, _NUMBER_WORD, _TITLED, _WITH_UNIT, _LINE_FEED = range(5)
_ENDS, _STOPS, _UNIT_WORD = 8, 16, 32


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11)


_PER = _hash("per")
_SLOT = {k: np.uint64(_hash(k)) for k in (_NUM, _NAME, _UNIT)}


class Words(NamedTuple):
    """Canonical words of texts, a run of name, number or unit words as one: hashes, value hashes, which are slots, which may be names (they start a sentence), the text of each, its first word there and the end."""

    hashes: np.ndarray
    values: np.ndarray
    slot: np.ndarray
    maybe: np.ndarray
    text: np.ndarray
    first: np.ndarray
    stop: np.ndarray


def classified(raw: str) -> tuple[int, int]:
    """Hash of a word's value, and its kind with flags: ends a sentence, ends a run of words, may be a unit."""
    if raw.isalpha():
        low = raw.lower()
        flags = _UNIT_WORD if low in UNITS else _LITERAL
        if low != raw and len(raw) > 1 and raw[0] != low[0] and raw[1:] == low[1:]:
            flags |= _TITLED
        return _digest(low.encode(), 11), flags
    if raw == "\x01":
        return 0, _LINE_FEED | _ENDS | _STOPS
    core = raw.strip(_EDGE)
    low = core.lower()
    value = _hash(low or raw)
    flags = 0
    if raw.rstrip("\"')]”’»").endswith((".", "!", "?")):
        flags = _ENDS | _STOPS
    elif raw.endswith((",", ";", ":", ")", "]", '"', "”", "»")):
        flags = _STOPS
    if _DIGIT.search(raw) and (m := _NUMBER.fullmatch(raw.strip("\"'()[]{}<>,;:!?*#&“”‘’«»¿¡…|."))):
        return value, flags | (_WITH_UNIT if m[1].lower() in UNITS and m[1] else _NUMBER_WORD)
    if low in UNITS or not low and raw.strip("()[]\".,;") in UNITS or "/" in low and all(x in UNITS for x in low.split("/")):
        flags |= _UNIT_WORD
    if low != core and len(core) > 1 and core[0] != low[0] and core[1:] == low[1:]:
        flags |= _TITLED
    return value, flags


_digest = xxhash.xxh64_intdigest


class Canonical:
    """Canonical words of texts, and the words as they are (lower case, none of them a slot)."""

    def __init__(self) -> None:
        self.known = Vocabulary(classified, [np.uint64, np.uint8])

    def __call__(self, texts: list[str]) -> tuple[Words, Words]:
        self.known.begin()
        words, sizes = [], []
        for t in texts:
            words += t.replace("\n", " \x01 ").split()
            words.append("\x01")
            sizes.append(len(words))
        rows = self.known.rows(words)
        value, flags = (c[rows] for c in self.known.columns)
        text = np.repeat(np.arange(len(texts)), np.diff([0, *sizes]))
        start = np.concatenate([[True], flags[:-1] & _ENDS > 0])[: len(rows)]
        real = flags & 7 != _LINE_FEED
        value, flags, text, start = value[real], flags[real], text[real], start[real]
        n, kind, stops, unit = len(value), flags & 7, flags & _STOPS > 0, flags & _UNIT_WORD > 0
        place = np.arange(n)
        own = place - np.searchsorted(text, np.arange(len(texts)))[text]
        fresh = own == 0
        number = (kind == _NUMBER_WORD) | (kind == _WITH_UNIT)
        measure = unit & _after(kind == _NUMBER_WORD) & ~number & ~fresh
        if (per := (value == _PER) & _after(measure) & _before(unit & ~fresh) & ~fresh).any():
            measure |= per | _after(per)
        name = (kind == _TITLED) & ~start & ~measure
        maybe = (kind == _TITLED) & start & ~measure
        hashes, values = value.copy(), value
        hashes[number], hashes[measure], hashes[name] = _SLOT[_NUM], _SLOT[_UNIT], _SLOT[_NAME]
        code = number + 2 * name.astype(np.int8) + 3 * measure.astype(np.int8)
        exact = Words(value, value, np.zeros(n, bool), np.zeros(n, bool), text, own, own + 1)
        stop = own + 1
        joined = ((code > 0) & (code == np.concatenate([[0], code[:-1]])[:n]) | name & _after(maybe)) & ~_after(stops) & ~start
        if joined.any():
            at = np.flatnonzero(~joined)
            weight = (2 * (place - np.maximum.accumulate(np.where(joined, 0, place))) + 1).astype(np.uint64)
            values = np.add.reduceat(value * weight, at)
            named = np.maximum.reduceat(name.astype(np.int8), at) > 0
            hashes, code, maybe = hashes[at], code[at], maybe[at] & ~named
            hashes[named], code[named] = _SLOT[_NAME], 2
            text, own, stop = text[at], own[at], stop[np.append(at[1:], n) - 1]
        return Words(hashes, values, code > 0, maybe, text, own, stop), exact


def _after(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[False], x[:-1]])[: len(x)]


def _before(x: np.ndarray) -> np.ndarray:
    return np.append(x[1:], False)[: len(x)]


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of n words of one text with enough literal words; a word that may be a name gives both forms."""
    size = len(w.hashes) - n + 1
    if n < 1 or size < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = min(LITERALS, n)
    literal = np.concatenate([[0], np.cumsum(~w.slot)])
    literal = literal[n:] - literal[:-n]
    at = np.flatnonzero((literal >= least) & (w.text[:size] == w.text[n - 1 :]))
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out += w.hashes[j : j + size] * _WEIGHTS[j]
    out, literal = out[at], literal[at]
    for j in range(n if least < n else 0):
        both = np.flatnonzero(w.maybe[at + j] & (literal > least))
        if len(both):
            named = out[both] + (_SLOT[_NAME] - w.hashes[at[both] + j]) * _WEIGHTS[j]
            at, out, literal = (np.concatenate(x) for x in ((at, at[both]), (out, named), (literal, literal[both] - 1)))
    return at, out


def tagged(win: np.ndarray, form: int) -> np.ndarray:
    """Hashes of windows of one form (their size; 8 more if of exact words), so that forms don't meet; signed."""
    win = (win ^ np.uint64(form * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    return (win ^ win >> np.uint64(32)).view(np.int64)


def template(texts: tuple[Words, Words]) -> tuple[int, np.ndarray, np.ndarray, Words]:
    """Form, places and hashes of an item's windows; of its exact words if no window has enough literal ones."""
    for k, w in enumerate(texts):
        n = min(WINDOW, len(w.hashes))
        at, win = windows(w, n)
        if len(at):
            break
    return 8 * k + n, at, tagged(win, 8 * k + n), w


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each item with words: its form, how many places have windows, and place, hash and slot values (0: none) of each window."""
    canonical = Canonical()
    for batch in batches:
        out = []
        for item, item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if text.is_valid and text.as_py().split():
                form, at, win, w = template(canonical([text.as_py()]))
                slots = np.where(w.slot | w.maybe, w.values, np.uint64(0)).view(np.int64)
                values = slots[at[:, None] + np.arange(form & 7)]
                out.append((item, item_id, form, len(np.unique(at)), [{"win": h, "p": p, "slots": v} for h, p, v in zip(win.tolist(), at.tolist(), values.tolist())]))
        kind = pa.list_(pa.struct([("win", pa.int64()), ("p", pa.int32()), ("slots", pa.list_(pa.int64()))]))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), kind)
        yield pa.record_batch([pa.array([r[k] for r in out], x) for k, x in enumerate(kinds)], names=["item", "item_id", "form", "own", "windows"])


def _document_windows(batches: Iterator[pa.RecordBatch], forms: list[int], held: Level | None) -> Iterator[pa.RecordBatch]:
    """A row for each window that passes the filter: hash, place, values of its words, first word and end in the text."""
    canonical = Canonical()
    for batch in batches:
        for at, texts in _streams(batch.column(2)):
            both, parts = canonical(texts), []
            for form in forms:
                w, n = both[form >> 3], form & 7
                place, win = windows(w, n)
                win = tagged(win, form)
                if held is not None:
                    ok = held.passes(win, second_hash, np.zeros(len(win), np.int64))
                    place, win = place[ok], win[ok]
                if len(place):
                    values = np.zeros((len(place), WINDOW), np.uint64)
                    values[:, :n] = w.values[place[:, None] + np.arange(n)]
                    base = np.searchsorted(w.text, w.text[place])
                    parts.append((w.text[place] + at, win, place - base, w.first[place], w.stop[place + n - 1], values.view(np.int64)))
            if parts:
                row, win, q, first, stop, values = (np.concatenate(x) for x in zip(*parts))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, WINDOW, np.int32)), pa.array(values.ravel()))
                columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), *(pa.array(x.astype(t)) for x, t in ((win, np.int64), (q, np.int32), (first, np.int64), (stop, np.int64))), lists]
                yield pa.record_batch(columns, names=["row", "doc_id", "win", "q", "first", "stop", "values"])


def _streams(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in parts of about STREAM_CHARS, each with the row of its first; null is empty."""
    at, held, size = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size > STREAM_CHARS:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def second_hash(win: np.ndarray) -> np.ndarray:
    win = win.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (win ^ win >> np.uint64(29)).view(np.int64)


def consistent(chain: list[tuple[int, int]], slots: dict[int, list[int]], values: dict[int, list[int]], least: float = 0.0) -> int:
    """Windows of a chain that agree with one one-to-one correspondence of values, the one that keeps most windows; 0 if below `least`.

    Windows of the same pairs of values stand or fall together; those whose pairs contradict
    no others always stand. Among the rest sets without a contradiction are tried, the
    more frequent windows first, as long as they can still reach `least` and more than
    the best so far; after STEPS trials the best so far counts.
    """
    kinds: Counter = Counter()
    for p, q in chain:
        pairs = frozenset((a, b) for a, b in zip(slots[p], values[q]) if a)
        if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
            kinds[pairs] += 1
    there, back = defaultdict(set), defaultdict(set)
    for pairs in kinds:
        for a, b in pairs:
            there[a].add(b)
            back[b].add(a)
    open_ = [(n, k) for k, n in kinds.items() if any(len(there[a]) > 1 or len(back[b]) > 1 for a, b in k)]
    total = sum(kinds.values())
    if not open_:
        return total if total >= least else 0
    open_.sort(key=lambda x: (-x[0], sorted(x[1])))
    clash = [{j for j, (_, o) in enumerate(open_) if j != i and any(a == c and b != d or b == d and a != c for a, b in k for c, d in o)} for i, (_, k) in enumerate(open_)]
    best, stack, steps = 0, [(total, 0, frozenset())], 0  # what is left, the next kind, kinds that are out
    while stack and steps < STEPS:
        left, i, out = stack.pop()
        steps += 1
        if left < least or left <= best:
            continue
        while i < len(open_) and (i in out or clash[i] <= out):
            i += 1  # out already, or without a rival that is in
        if i == len(open_):
            best = left
            continue
        stack.append((left - open_[i][0], i + 1, out | {i}))
        gone = {j for j in clash[i] if j not in out}
        if all(j > i for j in gone):
            stack.append((left - sum(open_[j][0] for j in gone), i + 1, out | gone))
    return best


def best_alignment(hits: list[tuple], own: int) -> tuple[float, int, int] | None:
    """Share of an item's `own` windows that its best alignment has, first word and number of words of the span.

    The alignments that are judged are those of chains(); each takes the correspondence
    of values that keeps most of its windows. Hits are (p, q, first, stop, slots, values). Of equal shares the one with the first
    span counts. None below SIMILARITY.
    """
    least = SIMILARITY * own - 1e-9
    if len({h[0] for h in hits}) < least:
        return None
    places = sorted({(h[1], -h[0]) for h in hits})
    slots, values = {h[0]: h[4] for h in hits}, {h[1]: h[5] for h in hits}
    first, stop = {h[1]: h[2] for h in hits}, {h[1]: h[3] for h in hits}
    best = None
    for chain in chains([-p for _, p in places], [q for q, _ in places], least):
        good = consistent(chain, slots, values, least)
        if good and good >= least:
            at = first[chain[0][1]]
            best = max(best or (-1.0, 0, 0), (good / own, -at, stop[chain[-1][1]] - at))
    return best and (best[0], -best[1], best[2])


def chains(pos: list[int], where: list[int], least: float) -> Iterator[list[tuple[int, int]]]:
    """Hits in one order in item and document, whose shifts differ by up to DRIFT from one to the next.

    Hits come by document place, the later item place first. All hits of a shift, and the
    longest chain that ends on it, are given if they are `least` hits.
    """
    places: dict[int, list[int]] = {}
    known: dict[int, list[tuple]] = {}
    for p, q in zip(pos, where):
        length, link = 0, None
        for shift in range(q - p - DRIFT, q - p + DRIFT + 1):
            if shift in places and (k := bisect_left(places[shift], p)) and known[shift][k - 1][0] > length:
                length, link = known[shift][k - 1][0], known[shift][k - 1]
        places.setdefault(q - p, []).append(p)
        known.setdefault(q - p, []).append((length + 1, p, q, link))
    for shift, found in places.items():
        if len(found) >= least:
            yield [(p, p + shift) for p in found]
    followed = set()
    for end in sorted((max(x, key=lambda y: y[0]) for x in known.values()), key=lambda x: -x[0]):
        if end[0] < least:
            return
        if id(end) in followed:
            continue
        chain, node = [], end
        while node:
            followed.add(id(node))
            chain.append((node[1], node[2]))
            node = node[3]
        yield chain[::-1]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, item_id, own, windows_, hits in zip(*(batch.column(k) for k in range(5))):
            places = defaultdict(list)
            for w in windows_.as_py():
                places[w["win"]].append((w["p"], w["slots"]))
            met = [(p, h["q"], h["first"], h["stop"], slots, h["values"]) for h in hits.as_py() for p, slots in places[h["win"]]]
            found = best_alignment(met, own.as_py())
            if found:
                out.append((doc_id.as_py(), item_id.as_py(), *found))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array([r[k] for r in out], x) for k, x in enumerate(kinds)], names=["doc_id", "item_id", "share", "first_word", "n_words"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", filter_keys: int = FILTER_KEYS, shared_items: int = SHARED_ITEMS) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers, names or units.

    Returns a row for each row of `docs` and each row of `benchmark` in it: doc_id,
    item_id, share (of all the item's windows, those found on its best alignment with
    consistent slots; at least 0.8), first_word, n_words (from the first window found to
    the last, in words between white space). Of alignments with one share the one that
    starts first counts, then the longer. An item without a window of two literal words
    (numbers or names alone, one word) is sought by its exact words, case and outer
    punctuation aside. Null and empty texts match nothing, repeated rows are each
    reported, empty tables give no rows. Other columns are not read.
    """
    kinds = "doc_id long, item_id long, share double, first_word long, n_words long"
    items = pick(benchmark, item_id=item_col, text=item_text_col).select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    items = staged(items.mapInArrow(_item_windows, "item long, item_id long, form int, own long, windows array<struct<win:long,p:int,slots:array<long>>>"), "items")
    forms = sorted(r[0] for r in items.select("form").distinct().collect())  # ten at most
    if not forms:
        return docs.sparkSession.createDataFrame([], kinds)
    wins = staged(items.select("item", "own", F.explode("windows").alias("w")).select("item", "own", "w.*"), "windows")
    found = staged(_found(docs, wins, forms, id_col, text_col, filter_keys), "found")

    # how often each window of an item is in the documents, and in how many items
    often = small(staged(found.groupBy("win").agg(F.count("*").alias("n")), "often"))
    spread = wins.groupBy("win").agg(F.countDistinct("item").alias("items"))
    known = staged(wins.join(often, "win").join(spread, "win"), "known")
    # the rarest places, one of which has to be there, of items that have enough places at all
    place = known.groupBy("item", "own", "p").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("item")
    missing = F.col("own") - F.count("*").over(whole)
    place = place.withColumn("missing", missing).withColumn("k", F.row_number().over(whole.orderBy("n", "p")))
    spare = F.col("own") - F.ceil(F.col("own") * SIMILARITY - 1e-9)
    anchors = place.where((F.col("missing") <= spare) & (F.col("k") + F.col("missing") <= spare + 1)).select("item", "p")
    anchors = staged(known.join(anchors, ["item", "p"], "left_semi").select("win", "item").distinct(), "anchors")
    pairs = staged(found.select("row", "win").join(small(anchors), "win").select("row", "item").distinct(), "pairs")

    rows = found.join(small(staged(pairs.select("row").distinct(), "rows")), "row", "left_semi")
    rare = known.where(F.col("items") <= shared_items).select("win", "item").distinct()
    common = known.where(F.col("items") > shared_items).select("win", "item").distinct()
    hits = rows.join(rare, "win").join(pairs, ["row", "item"], "left_semi")
    shared = rows.join(common.select("win").distinct(), "win", "left_semi").join(pairs, "row").join(common, ["item", "win"])
    hit = F.struct("win", "q", "first", "stop", "values")  # of a document and an item, as many as the document has words
    hits = hits.unionByName(shared.select(*hits.columns)).groupBy("row", "doc_id", "item").agg(F.collect_list(hit).alias("hits"))
    return hits.join(items.select("item", "item_id", "own", "windows"), "item").select("doc_id", "item_id", "own", "windows", "hits").mapInArrow(_judged, kinds)


def _found(docs: DataFrame, wins: DataFrame, forms: list[int], id_col: str, text_col: str, filter_keys: int) -> DataFrame:
    """Windows of documents that items may have."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = wins.select("win").distinct()
    n, held = keys.count(), None
    if n <= filter_keys:

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                win = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.record_batch([b.column(0), pa.array(second_hash(win)), pa.array(np.zeros(len(win), np.int64))], names=["one", "two", "shard"])

        held = docs.sparkSession.sparkContext.broadcast(filled(sized(0, n, 1, FILTER_RATE), keys.mapInArrow(both, "one long, two long, shard long"), 1))
    schema = "row long, doc_id long, win long, q int, first long, stop long, `values` array<long>"
    return rows.mapInArrow(lambda b: _document_windows(b, forms, held and held.value), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose id is not that of a contaminated document. Rows with a null id stay."""
    bad = staged(contaminated(docs, benchmark, id_col, text_col).select("doc_id").where("doc_id is not null").distinct(), "contaminated")
    return by_id(docs, id_col, bad, "left_anti")
