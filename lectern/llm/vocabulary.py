"""Words of a worker, numbered as they come, with numpy columns of what is known of each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Vocabulary(dict):
    """Word to row number; a missing word is learned: `learn(word)` gives its values, one for each dtype.

    Holds at most about `limit` words: begin() forgets all when there are more, so call it
    between documents.
    """

    def __init__(self, learn: Callable, dtypes: list, limit: int = 300_000) -> None:
        super().__init__()
        self.learn, self.limit = learn, limit
        self.columns = [np.zeros(1024, d) for d in dtypes]
        self.fresh: list[tuple] = []

    def begin(self) -> None:
        if len(self) > self.limit:
            self.clear()

    def __missing__(self, word) -> int:
        k = self[word] = len(self)
        self.fresh.append(self.learn(word))
        return k

    def rows(self, words: list) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            end = len(self)
            while end > len(self.columns[0]):
                self.columns = [np.concatenate([c, np.zeros_like(c)]) for c in self.columns]
            for c, v in zip(self.columns, zip(*self.fresh)):
                c[end - len(self.fresh) : end] = np.array(v, c.dtype)
            self.fresh.clear()
        return out
