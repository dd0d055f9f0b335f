"""Detectors backed by a classification model in Python workers.

No weights ship with this repository; ``load`` is where an adapter brings its
model.  It runs once in a worker process, and windows are scored in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd

from .scoring import Detector


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class ModelDetector(Detector):
    """The score is the probability of the wanted classes, summed; they are found by name."""

    native = False
    batch_size = 32
    wanted: Sequence[str] = ("injection",)

    def load(self) -> tuple[Callable[[list[str]], np.ndarray], Sequence[str]]:
        """A function from texts to logits, one row each, and the names of its columns."""
        raise NotImplementedError

    def setup(self) -> None:
        self._logits, names = self.load()
        known = {str(n).lower(): i for i, n in enumerate(names)}
        missing = {w.lower() for w in self.wanted} - set(known)
        if missing:
            raise ValueError(f"the model has no class {', '.join(sorted(missing))}; it has {', '.join(known)}")
        self._columns = [known[w.lower()] for w in self.wanted]

    def teardown(self) -> None:
        self._logits = None

    def score_batch(self, texts: pd.Series, ids: pd.Series) -> pd.Series:
        parts = [list(texts[i : i + self.batch_size]) for i in range(0, len(texts), self.batch_size)]
        got = [softmax(np.asarray(self._logits(p), float))[:, self._columns].sum(axis=1) for p in parts]
        return pd.Series(np.concatenate(got) if got else np.zeros(0))
