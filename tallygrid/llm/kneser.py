"""Interpolated modified Kneser-Ney language model, order 2.

Counts are made in Spark.  The vocabulary and the word pairs are arrays of
64-bit hashes in ascending order with their counts beside them, one file for
each range of hashes, in the shared folder; scoring workers map the files
into memory and look up whole batches of tokens.  Nothing but totals (tokens,
types, counts of counts) reaches the driver.

The folder must be a path that every worker has mounted (``file:``).
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .langid import held_out
from .textkit import column_bytes, groups, mix, pack_sorted, unpack_sorted, word_hashes
from .workspace import mounted_folder, swept

_U = np.uint64
#: The hash that stands for the end of a text.
END = _U(0x8F5C28F5C28F5C29)
#: Tokens a counting task holds before it hands on their sorted counts.
HOLD = 3_000_000
ID_BITS = _U(32)
#: Bytes of text whose counts share a file, at least a half of it.
PART_BYTES = 32 << 20
#: Words whose context counts share a file.
CONTEXTS = 1 << 16


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    def unshift(v: np.ndarray, s: int) -> np.ndarray:
        out = v
        for _ in range(64 // s):
            out = v ^ (out >> _U(s))
        return out

    with np.errstate(over="ignore"):
        x = unshift(x, 31) * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
        x = unshift(x, 27) * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return unshift(x, 30)


def _pack_counts(c: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack_counts(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their summed counts (1 each by default)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts.astype(np.int64), at)


_BLOBS = "part long, keys binary, counts binary"


def _dealt(keys: np.ndarray, counts: np.ndarray, part_of: np.ndarray, cols: int = 1) -> pa.RecordBatch:
    """One row for each part; keys ascend, and so do their parts."""
    cut = np.flatnonzero(np.diff(part_of)) + 1
    part, k, c = [], [], []
    for kk, cc, p in zip(np.split(keys, cut), np.split(counts, cut), np.split(part_of, cut), strict=True):
        if len(kk):
            part.append(int(p[0]))
            k.append(pack_sorted(kk))
            c.append(_pack_counts(np.ascontiguousarray(cc.reshape(-1))))
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int64()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["part", "keys", "counts"]
    )


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Write whole and rename, so a repeated task leaves one good file."""
    tmp = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        values.tofile(f)
    os.replace(tmp, f"{folder}/{name}")


_maps: dict[str, np.ndarray] = {}


def _map(folder: str, name: str, kind: str, n: int) -> np.ndarray:
    """A stored array of n values; one that is missing or of another length is an error."""
    if not n:
        return np.zeros(0, kind)
    path = f"{folder}/{name}"
    if path not in _maps:
        if len(_maps) > 4096:
            _maps.clear()
        _maps[path] = np.memmap(path, kind, "r")
    if len(_maps[path]) != n:
        raise OSError(f"{path} has {len(_maps[path])} values, not {n}")
    return _maps[path]


def part_bits(texts: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Bits of a hash that tell its part, so that a part belongs to about ``part_bytes`` of the texts(text)."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(total // part_bytes).bit_length()


@dataclass
class Model:
    folder: str
    bits: int  # of a hash that choose its file
    offsets: list[int] = field(default_factory=list)  # first id of each vocabulary file
    n_docs: int = 0
    tokens: int = 0
    pairs: int = 0
    discounts: tuple = (0.0, 0.0, 0.0)  # of pairs
    low_discounts: tuple = (0.0, 0.0, 0.0)  # of continuation counts
    low_counts: tuple = (0, 0, 0)  # words with 1, 2, 3+ continuations
    span: int = CONTEXTS  # ids in a context file
    pair_sizes: dict[int, int] = field(default_factory=dict)  # pairs in each pair file
    contexts: set[int] = field(default_factory=set)  # the context files

    @property
    def types(self) -> int:
        return self.offsets[-1] if self.offsets else 0

    def find(self, kind: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position or -1, count or 0) of ascending hashes in the vocabulary ('w') or pair ('p') files."""
        at, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        part = (h >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        edge = np.searchsorted(part, np.arange((1 << self.bits) + 1))
        for p in np.flatnonzero(np.diff(edge)):
            a, b = edge[p], edge[p + 1]
            n = self.offsets[p + 1] - self.offsets[p] if kind == "w" else self.pair_sizes.get(int(p), 0)
            if not n:
                continue
            keys = _map(self.folder, f"{kind}{p}.keys", "<u8", n)
            k = np.searchsorted(keys, h[a:b])
            k[k == len(keys)] = 0
            hit = np.flatnonzero(keys[k] == h[a:b])
            at[a:b][hit] = k[hit] + (self.offsets[p] if kind == "w" else 0)
            count[a:b][hit] = _map(self.folder, f"{kind}{p}.counts", "<u4", n)[k[hit]]
        return at, count

    def tokens_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each hash."""
        u, back = np.unique(h, return_inverse=True)
        at, count = self.find("w", u)
        return at[back], count[back]

    def context(self, ids: np.ndarray) -> np.ndarray:
        """Rows (n1, n2, n3+ of pairs that begin with the id, continuations of the id)."""
        out = np.zeros((len(ids), 4), np.int64)
        u, back = np.unique(ids, return_inverse=True)
        got = np.zeros((len(u), 4), np.int64)
        part = u // self.span
        for p in np.unique(part[u >= 0]):
            here = np.flatnonzero(part == p)
            if int(p) in self.contexts:
                rows = _map(self.folder, f"c{p}", "<u4", 4 * self.span).reshape(-1, 4)
                got[here] = rows[u[here] - p * self.span]
        out[:] = got[back]
        return out


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, token hashes with an END after each text, starts of the texts)."""
    raw, offsets = column_bytes(column)
    for i, j in groups(offsets):
        lo = offsets[i]
        h, first = word_hashes(raw[lo : offsets[j]], offsets[i : j + 1] - lo)
        n = j - i
        out = np.empty(len(h) + n, _U)
        ends = first[1:] + np.arange(n)
        mask = np.ones(len(out), bool)
        mask[ends] = False
        out[mask], out[ends] = h, END
        yield i, j, out, np.concatenate(([0], ends + 1))


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            k, c = _summed(np.concatenate(keys), np.concatenate(counts))
            keys.clear()
            counts.clear()
            return _dealt(k, c, (k >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), np.int64))

        for batch in batches:
            for _, _, h, _ in _texts(batch.column(0)):
                k, c = _summed(h)
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys)) > HOLD:
                    yield flush()
        if keys:
            yield flush()

    return run


def _gathered(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    part = table.column("part")[0].as_py()
    keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
    counts = [_unpack_counts(x.as_py()) for x in table.column("counts")]
    return part, np.concatenate(keys), np.concatenate(counts)


def _store_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        part, keys, counts = _gathered(table)
        keys, counts = _summed(keys, counts)
        _save(folder, f"w{part}.keys", keys.astype("<u8"))
        _save(folder, f"w{part}.counts", counts.astype("<u4"))
        return pa.table({"part": [part], "n": [len(keys)], "tokens": [int(counts.sum())]})

    return run


def _pair_keys(model: Model, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each pair (before, token), before ids, token ids, token counts); -1 where a word is unknown."""
    ids, counts = model.tokens_of(h)
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[starts[:-1]] = model.types  # the id of a text's beginning
    with np.errstate(over="ignore"):
        keys = mix((before.astype(_U) << ID_BITS) | (ids.astype(_U) & _U(0xFFFFFFFF)))
    return keys, before, ids, counts


def _count_pairs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            k, c = _summed(np.concatenate(held))
            held.clear()
            return _dealt(k, c, (k >> _U(64 - model.bits)).astype(np.int64) if model.bits else np.zeros(len(k), np.int64))

        for batch in batches:
            for _, _, h, starts in _texts(batch.column(0)):
                held.append(_pair_keys(model, h, starts)[0])
                if sum(map(len, held)) > HOLD:
                    yield flush()
        if held:
            yield flush()

    return run


def _of_counts(c: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(c == i)) for i in (1, 2, 3, 4)]


def _store_pairs(folder: str, span: int):
    """Store a part's pairs; its rows name the contexts and continuations seen, by range of ids."""

    def run(table: pa.Table) -> pa.Table:
        part, keys, counts = _gathered(table)
        keys, counts = _summed(keys, counts)
        _save(folder, f"p{part}.keys", keys.astype("<u8"))
        _save(folder, f"p{part}.counts", counts.astype("<u4"))
        plain = unmix(keys)
        before, after = plain >> ID_BITS, plain & _U(0xFFFFFFFF)
        # one key for each (id, column): column 0-2 by the pair's count, 3 for continuations
        column = np.minimum(counts, 3).astype(_U) - _U(1)
        k, c = _summed(np.concatenate((before * _U(4) + column, after * _U(4) + _U(3))))
        dealt = _dealt(k, c, (k // _U(4 * span)).astype(np.int64))
        n = _of_counts(counts)
        stats = pa.array([[part, len(keys), *n]] + [None] * (dealt.num_rows - 1), pa.list_(pa.int64()))
        return pa.Table.from_batches([dealt]).append_column("stats", stats)

    return run


def _store_contexts(folder: str, span: int):
    def run(table: pa.Table) -> pa.Table:
        part, keys, counts = _gathered(table)
        keys, counts = _summed(keys, counts)
        rows = np.zeros((span, 4), "<u4")
        local = (keys - _U(part) * _U(4 * span)).astype(np.int64)
        rows.reshape(-1)[local] = counts
        _save(folder, f"c{part}", rows.reshape(-1))
        cont = rows[:, 3]
        return pa.table({"part": [part], "stats": [[*_of_counts(cont), int(np.count_nonzero(cont >= 3))]]})

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more; a plain half where counts of counts are missing."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.0), float(i)) for i, x in enumerate(d, 1))


def fit(spark: SparkSession, texts: DataFrame, folder: str | None = None) -> Model:
    """Learn from texts(text); a null text counts as empty.

    One pass counts words, a second pairs; each hands sorted counts of
    bounded size to one task per range of hashes.
    """
    ship(spark)
    folder = folder or mounted_folder(spark, "kneser")
    os.makedirs(folder, exist_ok=True)
    for path in (folder, f"{folder}-rows"):
        atexit.register(shutil.rmtree, path, ignore_errors=True)  # scores are made later, so not before the end
    texts = texts.select(F.col("text").cast("string").alias("text"))
    bits = part_bits(texts)
    with swept(spark):
        found = texts.mapInArrow(_count_words(bits), _BLOBS).groupBy("part")
        got = sorted(tuple(r) for r in found.applyInArrow(_store_words(folder), "part long, n long, tokens long").collect())
    sizes = np.zeros(1 << bits, np.int64)
    for p, n, _ in got:
        sizes[p] = n
    model = Model(folder, bits, [0, *np.cumsum(sizes).tolist()], tokens=sum(r[2] for r in got))
    if not model.tokens:
        return model
    end = np.array([END], _U)
    p = int(end[0] >> _U(64 - bits)) if bits else 0
    k = int(np.searchsorted(_map(folder, f"w{p}.keys", "<u8", int(sizes[p])), end)[0])
    model.n_docs = int(_map(folder, f"w{p}.counts", "<u4", int(sizes[p]))[k])
    if model.types >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    model.span = CONTEXTS
    pairs = texts.mapInArrow(_count_pairs(model), _BLOBS).groupBy("part")
    stored = pairs.applyInArrow(_store_pairs(folder, model.span), _BLOBS + ", stats array<long>")
    with swept(spark):
        stored.write.parquet(f"file://{folder}-rows")
    stored = spark.read.parquet(f"file://{folder}-rows")
    stats = [r[0] for r in stored.where("stats is not null").select("stats").collect()]
    model.pair_sizes = {s[0]: s[1] for s in stats}
    stats = [s[1:] for s in stats]
    with swept(spark):
        contexts = stored.select("part", "keys", "counts").groupBy("part")
        low = contexts.applyInArrow(_store_contexts(folder, model.span), "part long, stats array<long>").collect()
    model.contexts = {r[0] for r in low}
    shutil.rmtree(f"{folder}-rows", ignore_errors=True)
    model.pairs = sum(s[0] for s in stats)
    model.discounts = _discounts(*(sum(s[i] for s in stats) for i in (1, 2, 3, 4)))
    n = [sum(r[1][i] for r in low) for i in range(5)]
    model.low_discounts, model.low_counts = _discounts(*n[:4]), (n[0], n[1], n[4])
    return model


def log_probabilities(model: Model, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability of each token given the one before it, its count in training)."""
    uniform = 1.0 / (model.types + 1)
    if not model.tokens:
        return np.full(len(h), np.log10(uniform)), np.zeros(len(h), np.int64)
    keys, before, ids, counts = _pair_keys(model, h, starts)
    u, back = np.unique(keys, return_inverse=True)
    pair = model.find("p", u)[1][back]
    pair[(before < 0) | (ids < 0)] = 0
    own = model.context(ids)[:, 3]
    ctx = model.context(before)[:, :3]
    seen = np.where(before == model.types, model.n_docs, 0)
    inner = before >= 0
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    seen[at] = counts[at - 1]
    off = lambda c, d: np.array([0.0, *d])[np.minimum(c, 3)]
    gamma = sum(d * n for d, n in zip(model.low_discounts, model.low_counts, strict=True)) / model.pairs
    low = np.maximum(own - off(own, model.low_discounts), 0) / model.pairs + gamma * uniform
    total = np.maximum(seen, 1)
    high = np.maximum(pair - off(pair, model.discounts), 0) / total + (ctx @ np.array(model.discounts)) / total * low
    return np.log10(np.where(seen > 0, high, low)), counts


_SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            tokens, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for i, j, h, starts in _texts(batch.column(1)):
                p, c = log_probabilities(model, h, starts)
                b = np.log10((c + 1) / (model.tokens + model.types + 1))
                at = starts[:-1]
                tokens[i:j], known[i:j] = np.diff(starts), np.add.reduceat((c > 0).astype(np.int64), at)
                base[i:j], score[i:j] = np.add.reduceat(b, at), np.add.reduceat(p, at)
            total = np.full(n, model.tokens, np.int64)
            cols = [batch.column(0), *map(pa.array, (tokens, known, total, base, score))]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs(doc_id, text).

    Null and empty texts have the end token alone.  Unknown words share the
    uniform part with one type.  Repeated rows repeat their result; other
    columns are not read; an empty table gives an empty result.
    """
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score(model), _SCORES)


def score_held_out(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Scores of all rows from a model of the rows whose crc32(id) mod 7 is not 2; a null id is not held out."""
    model = fit(spark, docs.where(~held_out("doc_id", 7, 2)))
    return score(spark, docs, model).withColumn("held_out", held_out("doc_id", 7, 2))
