"""Hyphenation by patterns: letters with priorities between them, in a trie.

At each place between two letters the highest priority of all patterns that match around
it counts; odd ones allow a break, even ones forbid it. The trie is built once a worker
from a broadcast pattern table, so plans hold no dictionary.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that stay before the first and after the last break.
LEFT, RIGHT = 2, 2
#: A table of more patterns is an error: it would be too large to send to every worker.
MOST_PATTERNS = 1_000_000


def parsed(pattern: str) -> tuple[str, list[int]]:
    """Letters of a pattern and the priorities before, between and after them."""
    letters, points = [], [0]
    for c in pattern:
        if c.isdigit():
            points[-1] = int(c)
        else:
            letters.append(c)
            points.append(0)
    return "".join(letters), points


class Trie:
    """Nodes are dictionaries by letter; a pattern's priorities stand at its last letter under the empty key."""

    def __init__(self, patterns: list[str]) -> None:
        self.root: dict = {}
        self.known: dict[str, int] = {}
        for p in patterns:
            letters, points = parsed(p.lower())
            node = self.root
            for c in letters:
                node = node.setdefault(c, {})
            node[""] = [max(a, b) for a, b in zip(node.get("", points), points)]

    def breaks(self, word: str) -> list[int]:
        """Places (letters before them) where a word may be broken."""
        text = f".{word.lower()}."
        best = [0] * (len(text) + 1)
        for start in range(len(text)):
            node = self.root
            for c in text[start:]:
                node = node.get(c)
                if node is None:
                    break
                for k, point in enumerate(node.get("", ())):
                    best[start + k] = max(best[start + k], point)
        return [i for i in range(LEFT, len(word) - RIGHT + 1) if best[i + 1] % 2]

    def syllables(self, word: str) -> int:
        """Parts of a word: between breaks, and between hyphens that it has itself; words seen are remembered."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[word] = len(self.breaks(word)) + word.count("-") + 1 if word else 0
        return found


@lru_cache(maxsize=4)
def _trie(table: Broadcast) -> Trie:
    return Trie(table.value)


def broadcast_patterns(patterns: DataFrame, column: str = "pattern") -> Broadcast:
    """The patterns for all workers; nulls are left out."""
    rows = patterns.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    return patterns.sparkSession.sparkContext.broadcast(sorted(r[0] for r in rows))


def hyphen_syllables(text: Column, table: Broadcast) -> Column:
    """Syllables of a text by its patterns: the sum over its words between white space; 0 for null."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        count = _trie(table).syllables
        return texts.map(lambda t: sum(count(w) for w in t.split()) if t else 0)

    return run(F.coalesce(text, F.lit("")))


def vowel_patterns(vowels: str = "aeiou", consonants: str = "bcdfghjklmnpqrstvwxyz") -> list[str]:
    """Patterns by a rule: a break before a consonant between vowels, and between two consonants between vowels, but not before r or l after another consonant."""
    one = [f"{v}1{c}{w}" for v in vowels for c in consonants for w in vowels]
    two = [f"{v}{c}1{d}{w}" for v in vowels for c in consonants for d in consonants if d not in "rl" for w in vowels]
    return one + two
