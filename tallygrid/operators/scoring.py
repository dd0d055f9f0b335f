"""Detectors, windowed scoring and its fold, checkpoints and splices."""

from __future__ import annotations

import ast
import atexit
import importlib
import importlib.util
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

REGISTRY: dict[str, type[Detector]] = {}


class Fold:
    """How the windows of a document become its score, in parts that merge.

    ``state`` sums up some windows of one document as a list of numbers,
    ``merge`` joins two such lists, and ``finish`` makes the score.  A
    document's windows may lie in many tasks: only states travel.
    """

    empty = 0.0

    def state(self, scores: np.ndarray) -> list[float]:
        raise NotImplementedError

    def merge(self, a: list[float], b: list[float]) -> list[float]:
        raise NotImplementedError

    def finish(self, state: list[float]) -> float:
        raise NotImplementedError


class Detector:
    """A detector scores texts; higher is more suspicious.

    Either ``score_expr`` (a column expression, stays in the JVM) or
    ``score_batch`` (a batch of texts in Python, after one ``setup`` in each
    worker process) is overridden.
    """

    name = version = ""
    display = notes = ""
    binary = False
    max_chars: int | None = None
    policy = "full"
    #: Whether a sentence of more than max_chars is cut under the policy "sentence".
    cap = True
    overlap = 4
    overlap_share: float | None = None
    native = True
    #: Another fold than the greatest score.
    fold: Fold | None = None
    #: Columns of the documents that every window carries; score_batch gets them as a third argument, score_expr as columns by name.
    attributes: tuple[str, ...] = ()

    def setup(self) -> None: ...

    def teardown(self) -> None: ...

    def score_expr(self, text: Column, doc_id: Column) -> Column:
        raise NotImplementedError

    def score_batch(self, texts: pd.Series, ids: pd.Series) -> pd.Series:
        raise NotImplementedError

    def score_text(self, text: str, doc_id: str = "") -> float:
        """One whole text scored in this process; the expression tier has no default for it."""
        if self.native:
            raise NotImplementedError
        return float(self.score_batch(pd.Series([text]), pd.Series([doc_id])).iloc[0])

    def aperture(self) -> tuple[str, int | None, float | None]:
        if not self.max_chars or self.policy == "full":
            return "full", None, None
        return self.policy, self.max_chars, (self.overlap_share or self.overlap) if self.policy == "chunk" else None

    def windows(self, text: Column) -> Column:
        policy, size, _ = self.aperture()
        if policy == "full":
            return tx.windows_full(text)
        if policy == "sentence":
            return tx.windows_sentence(text, size, self.cap)
        if policy == "truncate":
            return tx.windows_truncate(text, size)
        return tx.windows_chunk(text, size, None if self.overlap_share else self.overlap, self.overlap_share)

    def pieces(self, text: Column) -> Column:
        """The texts of the windows."""
        policy, size, _ = self.aperture()
        if policy == "sentence" and not self.cap:
            return tx.whole_sentences(text, size)
        return F.transform(self.windows(text), lambda s: tx.cut(text, s))


def register(name: str, version: str) -> Callable[[type[Detector]], type[Detector]]:
    def add(kind: type[Detector]) -> type[Detector]:
        if not issubclass(kind, Detector):
            raise TypeError(f"{kind.__name__} is no Detector")
        kind.name, kind.version = name, version
        REGISTRY[name] = kind
        return kind

    return add


@register("floor", "1.0")
class Floor(Detector):
    """The trivial baseline: one pattern of quoted phrases."""

    display = "Regex floor (triviality baseline)"
    binary = True
    pattern = tx.FLOOR

    def score_expr(self, text: Column, doc_id: Column) -> Column:
        return F.when(tx.matches(text, self.pattern), 1.0).otherwise(0.0)

    def score_text(self, text: str, doc_id: str = "") -> float:
        return float(re.search(tx.as_re2(self.pattern), text, re.ASCII) is not None)


class Graded(Detector):
    """A deterministic test detector with fixed values: the id's hash, raised where a payload stands in the text."""

    name, version = "graded", "test"
    payload = "audit@example.invalid"

    def score_expr(self, text: Column, doc_id: Column) -> Column:
        h = F.conv(F.substring(F.sha1(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967295.0
        return h * 0.5 + F.when(F.contains(text, F.lit(self.payload)) & (h > 0.2), 0.5).otherwise(0.0)


def load_adapters(folder: str | Path, spark: SparkSession | None = None) -> None:
    """Import every module of a folder, so that its detectors register.

    With a session the folder travels: its modules, helpers included, go to
    the executors as an archive and are imported by name there, so no worker
    needs the folder.
    """
    paths = [p for p in sorted(Path(folder).glob("*.py")) if not p.name.startswith("_")]
    if spark is not None:
        packed = shutil.make_archive(f"{tempfile.mkdtemp()}/adapters-{uuid.uuid4().hex}", "zip", folder)
        spark.sparkContext.addPyFile(packed)  # on this process' path too
        importlib.invalidate_caches()
        for path in paths:
            importlib.import_module(path.stem)
        return
    for path in paths:
        spec = importlib.util.spec_from_file_location(f"adapters_{path.stem}", path)
        spec.loader.exec_module(importlib.util.module_from_spec(spec))


#: Detectors that this worker process has set up, by the token of the scoring call.
_LIVE: dict[str, Detector] = {}


def _live(token: str, detector: Detector) -> Detector:
    """The detector of a scoring call, set up once in a worker process however many tasks it runs; a later call's takes its place."""
    if token not in _LIVE:
        while _LIVE:
            _LIVE.popitem()[1].teardown()
        detector.setup()
        _LIVE[token] = detector
        atexit.register(lambda: _LIVE.pop(token).teardown() if token in _LIVE else None)
    return _LIVE[token]


def registered(folder: str | Path) -> list[dict]:
    """name, version, binary and display of the adapters in a folder, read without importing them."""
    out = []
    for path in sorted(Path(folder).glob("*.py")):
        for node in ast.parse(path.read_text(encoding="utf-8")).body:
            if not isinstance(node, ast.ClassDef):
                continue
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and getattr(d.func, "id", getattr(d.func, "attr", "")) == "register":
                    words = [a.value for a in d.args if isinstance(a, ast.Constant)] + [k.value.value for k in d.keywords if isinstance(k.value, ast.Constant)]
                    fields = {t.id: a.value.value for a in node.body if isinstance(a, ast.Assign) and isinstance(a.value, ast.Constant) for t in a.targets if isinstance(t, ast.Name)}
                    out.append({"detector": words[0], "version": words[1] if len(words) > 1 else "", "binary": bool(fields.get("binary", False)), "display": fields.get("display", "")})
    return out


def exploded(docs: DataFrame, detector: Detector) -> DataFrame:
    """(id, window, span, chunk) for every window; the other columns are carried."""
    spans = docs.select("*", F.posexplode_outer(detector.windows(F.col("text"))).alias("window", "span"))
    return spans.withColumn("chunk", tx.cut(F.col("text"), F.col("span")))


def score_windows(docs: DataFrame, detector: Detector) -> DataFrame:
    """(id, window, score)."""
    more = list(detector.attributes)
    rows = exploded(docs, detector).select("id", "window", "chunk", *more)
    if detector.native:
        given = ({c: F.col(c) for c in more},) if more else ()
        return rows.select("id", "window", detector.score_expr(F.col("chunk"), F.col("id"), *given).alias("score"))

    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live = _live(token, detector)
        for b in batches:
            got = pd.Series(list(live.score_batch(b["chunk"], b["id"], *([b[more]] if more else []))), dtype="float64")
            if len(got) != len(b):
                raise ValueError(f"{len(got)} scores for {len(b)} windows")
            yield pd.DataFrame({"id": b["id"].to_numpy(), "window": b["window"].to_numpy(), "score": got.to_numpy()})

    return rows.mapInPandas(run, "id string, window int, score double")


def fold_states(scored: DataFrame, how: Fold) -> DataFrame:
    """(id, score, windows) of scored windows(id, score): states of each batch's documents, merged in the order of ids.

    A task takes one state of a document from a batch at most, so a document
    of very many windows costs no more than its batches.
    """

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [(i, [float(x) for x in how.state(g.to_numpy())], len(g)) for i, g in b.groupby("id", sort=False)["score"]]
            yield pd.DataFrame(own, columns=["id", "state", "windows"])

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, n = None, None, 0
        for b in batches:
            out = []
            for i, s, k in zip(b["id"], b["state"], b["windows"], strict=True):
                if i == last:
                    state, n = how.merge(state, list(s)), n + k
                    continue
                if last is not None:
                    out.append((last, how.finish(state), n))
                last, state, n = i, list(s), k
            yield pd.DataFrame(out, columns=["id", "score", "windows"])
        if last is not None:
            yield pd.DataFrame([(last, how.finish(state), n)], columns=["id", "score", "windows"])

    states = scored.where("id is not null").select("id", "score").mapInPandas(parts, "id string, state array<double>, windows long")
    return states.repartition("id").sortWithinPartitions("id").mapInPandas(merged, "id string, score double, windows long")


def fold(docs: DataFrame, scored: DataFrame, how: Callable[[str], Column] = F.max) -> DataFrame:
    """(id, score) of every document: the windows' scores folded; 0 without a window."""
    by_doc = scored.groupBy("id").agg(how("score").alias("score"))
    return docs.select("id").join(by_doc, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def score_counted(docs: DataFrame, detector: Detector) -> DataFrame:
    """(id, score, windows) of every document: the greatest score of its windows, 0 without one.  A native detector needs no shuffle."""
    docs = docs.withColumn("id", F.col("id").cast("string"))
    if detector.fold is not None or detector.attributes:
        by_doc = score_windows(docs, detector)
        by_doc = fold_states(by_doc, detector.fold) if detector.fold else by_doc.groupBy("id").agg(F.max("score").alias("score"), F.count("*").alias("windows"))
        none = F.lit(float(detector.fold.empty if detector.fold else 0.0))
        return docs.select("id").join(by_doc, "id", "left").select("id", F.coalesce("score", none).alias("score"), F.coalesce("windows", F.lit(0)).cast("long").alias("windows"))
    if detector.native and detector.aperture()[0] == "full":
        return docs.select("id", detector.score_expr(F.col("text"), F.col("id")).alias("score"), F.lit(1).cast("long").alias("windows"))
    if detector.native:
        each = F.transform(detector.pieces(F.col("text")), lambda piece: detector.score_expr(piece, F.col("id")))
        return docs.select("id", each.alias("each")).select("id", F.coalesce(F.array_max("each"), F.lit(0.0)).alias("score"), F.size("each").cast("long").alias("windows"))
    by_doc = score_windows(docs, detector).groupBy("id").agg(F.max("score").alias("score"), F.count("*").alias("windows"))
    both = docs.select("id").join(by_doc, "id", "left")
    return both.select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("windows", F.lit(0)).cast("long").alias("windows"))


def score_documents(docs: DataFrame, detector: Detector) -> DataFrame:
    """(id, score) of every document."""
    return score_counted(docs, detector).select("id", "score")


def todo(docs: DataFrame, done: DataFrame) -> DataFrame:
    return docs.join(done.select("id"), "id", "left_anti")


def splice(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Old scores with the fresh ones put in."""
    both = old.select("id", F.col("score").alias("old")).join(fresh.select("id", F.col("score").alias("new")), "id", "left")
    return both.select("id", F.coalesce("new", "old").alias("score"))


def moved(old: DataFrame, fresh: DataFrame) -> DataFrame:
    both = old.select("id", F.col("score").alias("old")).join(fresh.select("id", F.col("score").alias("new")), "id")
    return both.where("old <> new").select("id", "old", "new", (F.col("new") - F.col("old")).alias("delta"))
