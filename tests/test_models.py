from __future__ import annotations

import numpy as np
import pytest

from tallygrid.operators.models import ModelDetector
from tallygrid.operators.scoring import score_documents


def fake():
    class Fake(ModelDetector):
        wanted = ("Jailbreak", "injection")
        batch_size = 2
        max_chars, policy = 30, "sentence"

        def load(self):
            return (lambda texts: np.array([[0.0, float("bad" in t) * 4 - 2, -9.0] for t in texts])), ["safe", "INJECTION", "jailbreak"]

    return Fake


def test_probability_of_named_classes(spark):
    docs = spark.createDataFrame([("a", "All is good here. And more of it follows now."), ("b", "Fine. Some bad words stand in this one. End of text."), ("c", "")], "id string, text string")
    got = {r["id"]: r["score"] for r in score_documents(docs, fake()()).collect()}
    high, low = ((np.exp(x) + np.exp(-9)) / (1 + np.exp(x) + np.exp(-9)) for x in (2.0, -2.0))
    assert got["a"] == pytest.approx(low) and got["b"] == pytest.approx(high) and got["c"] == pytest.approx(low)


def test_unknown_class_is_refused():
    class Wrong(fake()):
        wanted = ("nothing",)

    with pytest.raises(ValueError, match="no class nothing"):
        Wrong().setup()
