"""Plain versions of operators, for small tables: loops over everything, no hashes, no shared code."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np

from lectern.llm.decontaminate import DRIFT, LITERALS, SIMILARITY, UNITS, WINDOW

NUMBER = re.compile(r"[-+$€£]?\d+(?:[.,:/]\d+)*(%|[^\W\d_]{0,3})")
EDGE = "\"'()[]{}<>.,;:!?*#&$%“”‘’«»¿¡…–—-_|"


def canonical(text):
    """(key, value, slot, may be a name, first word, end) of each canonical word."""
    words = []  # raw, low, starts a sentence
    for line in text.split("\n"):
        start = True
        for raw in line.split():
            words.append((raw, raw.strip(EDGE).lower() or raw, start))
            start = raw.rstrip("\"')]”’»").endswith((".", "!", "?"))
    kinds = []
    for raw, low, _ in words:
        core = raw.strip(EDGE)
        m = NUMBER.fullmatch(raw.strip("\"'()[]{}<>,;:!?*#&“”‘’«»¿¡…|.")) if re.search(r"\d", raw) else None
        if m:
            kinds.append("number+" if m[1] and m[1].lower() in UNITS else "number")
        elif len(core) > 1 and core != core.lower() and core[0] != core[0].lower() and core[1:] == core[1:].lower():
            kinds.append("titled")
        else:
            kinds.append("word")
    unit = [k not in ("number", "number+") and (low in UNITS or raw.strip("()[]\".,;") in UNITS or "/" in low and all(x in UNITS for x in low.split("/"))) for (raw, low, _), k in zip(words, kinds)]
    measure = [u and i > 0 and kinds[i - 1] == "number" for i, u in enumerate(unit)]
    for i in range(1, len(words) - 1):
        if words[i][1] == "per" and measure[i - 1] and unit[i + 1]:
            measure[i] = measure[i + 1] = True
    code = []
    for (_, low, start), k, m in zip(words, kinds, measure):
        code.append("unit" if m else "number" if k.startswith("number") else ("maybe" if start else "name") if k == "titled" else None)
    out, run = [], []

    def close():
        if run:
            codes = [code[i] for i in run]
            kind = "name" if "name" in codes else codes[0]
            low = [words[i][1] for i in run]
            slot = kind in ("unit", "number", "name")
            out.append((("slot", kind) if slot else ("word", low[0]), tuple(low), slot, kind == "maybe", run[0], run[-1] + 1))

    for i, (raw, _, start) in enumerate(words):
        stopped = i and words[i - 1][0].rstrip("\"')]”’»").endswith((".", "!", "?")) or i and words[i - 1][0].endswith((",", ";", ":", ")", "]", '"', "”", "»"))
        same = i and code[i] and (code[i] == code[i - 1] != "maybe" or code[i] == "name" and code[i - 1] == "maybe")
        if not (same and not stopped and not start):
            close()
            run = []
        run.append(i)
    close()
    return out, [(("word", low), (low,), False, False, i, i + 1) for i, (_, low, _) in enumerate(words)]


def windows(words, n):
    """(place, keys) of windows with enough literal words, both forms of words that may be names."""
    out = []
    for at in range(len(words) - n + 1 if n else 0):
        for form in itertools.product(*[((k, s), (("slot", "name"), True)) if maybe else ((k, s),) for k, _, s, maybe, _, _ in words[at : at + n]]):
            if sum(not s for _, s in form) >= min(LITERALS, n):
                out.append((at, tuple(k for k, _ in form)))
    return out


def most_windows(wanted):
    """Most windows whose pairs all agree with one one-to-one mapping, all mappings tried."""
    seen = {pair for pairs in wanted for pair in pairs}
    to, of = defaultdict(set), defaultdict(set)
    for a, b in seen:
        to[a].add(b)
        of[b].add(a)
    fixed = {(a, b) for a, b in seen if len(to[a]) == len(of[b]) == 1}
    open_ = sorted({a for a, b in seen - fixed}, key=str)
    best = 0
    for choice in itertools.product(*[[*to[a], None] for a in open_]):
        taken = [b for b in choice if b is not None]
        if len(set(taken)) == len(taken):
            mapping = fixed | set(zip(open_, choice))
            best = max(best, sum(all(pair in mapping for pair in pairs) for pairs in wanted))
    return best


def share_found(item, doc):
    """Best share of the item's windows on one consistent alignment with the document, or None."""
    for own, other in zip(canonical(item), canonical(doc)):
        n = min(WINDOW, len(own))
        mine = windows(own, n)
        if mine:
            break
    else:
        return None
    places = len({p for p, _ in mine})
    theirs = defaultdict(list)
    for q, keys in windows(other, n):
        theirs[keys].append(q)
    hits = sorted({(q, -p) for p, keys in mine for q in theirs[keys]})
    hits = [(-p, q) for q, p in hits]
    least = SIMILARITY * places - 1e-9
    length, back = [1] * len(hits), [None] * len(hits)
    for i, (p, q) in enumerate(hits):
        for j, (a, b) in enumerate(hits[:i]):
            if a < p and b < q and abs((q - p) - (b - a)) <= DRIFT and length[j] + 1 > length[i]:
                length[i], back[i] = length[j] + 1, j
    chains = [[h for h in hits if h[1] - h[0] == s] for s in {q - p for p, q in hits}]
    for i in range(len(hits)):
        chain, at = [], i
        while at is not None:
            chain.append(hits[at])
            at = back[at]
        chains.append(chain[::-1])
    best = None
    for chain in chains:
        good = most_windows([[(own[p + k][1], other[q + k][1]) for k in range(n) if own[p + k][2] or own[p + k][3]] for p, q in chain])
        if good >= least and good > (best or 0):
            best = good
    return best and best / places


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def figures(text):
    t = text or ""
    w = words_of(t)
    c = Counter(zip(w, w[1:], w[2:]))
    cover = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(lines)


OUTER = {"symbols": 0.1, "dup_lines": 0.05, "repeats": 0.05, "word_length": 0.1}


def quality(rows):
    """base_failed and kept of (text, lang, source) rows, by exact quantiles, and how many bounds the quantiles spread from the median."""
    base, ratio = [], []
    for text, _, _ in rows:
        n, chars, symbols, dup, cover, lines = figures(text)
        base.append(n < 50 or 100 * cover > 50 * n)
        ratio.append({"symbols": (symbols / n, 1 / n), "dup_lines": (dup / lines, 1 / lines), "repeats": (cover / n, 6 / n), "word_length": (chars / n, 1 / n)} if n else None)
    good = [i for i, b in enumerate(base) if not b]

    def bounds(members):
        out = {}
        for k, q in OUTER.items():
            low, mid, high = np.quantile([ratio[i][k][0] for i in members], [q, 0.5, 1 - q], method="inverted_cdf")
            out[k] = np.array([mid - 6 * (mid - low), mid + 6 * (high - mid)])
        return out

    def mixed(members, parent):
        n = len(members)
        own = bounds(members) if members else parent
        return {k: (n * own[k] + 100 * parent[k]) / (n + 100) for k in OUTER}

    whole = bounds(good)
    limit = {}
    for lang, source in {r[1:] for r in rows}:
        by_lang = mixed([i for i in good if rows[i][1] == lang], whole)
        limit[lang, source] = mixed([i for i in good if rows[i][1:] == (lang, source)], by_lang)
    kept = []
    for (_, lang, source), b, r in zip(rows, base, ratio):
        at = limit[lang, source]
        kept.append(not b and all(at[k][0] - r[k][1] <= r[k][0] <= at[k][1] + r[k][1] for k in OUTER))
    return base, kept, limit


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]
