"""Tables that cut lineage, connected components, and links from inverted lists.

Intermediate tables are Parquet in the folder that all executors share
(``spark.checkpoint.dir``), so a lost executor costs a task, never a result.
Nothing is collected but counters.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship


#: Removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else the checkpoint folder set by code.

    Where neither is set, a session in one process gets a temporary folder; a cluster is refused.
    """
    context = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if own is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallygrid-"))
        own = context.getCheckpointDir()
    return own.rstrip("/")


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files that workers map into memory."""
    home = shared_folder(spark)
    if "://" in home and not home.startswith("file://"):
        raise ValueError(f"the folder must be mounted on all workers: {home}")
    return f"{home.removeprefix('file://').removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and end inside leave no shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, True)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Workspace:
    """A folder of intermediate tables for one call of an operator."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark)}/tallygrid-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.path)

    def cut(self, df: DataFrame, narrow: bool = False) -> DataFrame:
        """Write a table and read it again; the shuffles that made it are gone then.

        ``narrow`` is for tables of ids, which are small beside the texts: a
        few tasks for each core write them, not one for each shuffle partition.
        """
        if narrow:
            df = df.coalesce(4 * self.spark.sparkContext.defaultParallelism)
        where = f"{self.path}/{uuid.uuid4().hex}"
        with swept(self.spark):
            df.write.option("compression", "zstd").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._tallygrid_path = where
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables that no later table is read from; others than those of ``cut`` stay."""
        for table in tables:
            where = getattr(table, "_tallygrid_path", None)
            if where is not None:
                self._remove(where, False)

    def _remove(self, where: str, at_exit: bool = True) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception as e:  # the session may be gone at exit; the files are only temporary
            if not at_exit:
                raise RuntimeError(f"cannot remove {where}") from e


def bounded(df: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """df, a table that was cut, to be broadcast if its rows (each counted with its weight) are no more than ``most``; else as it is."""
    total = df.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(node, comp) of every node in links(a, b): comp is the smallest node reachable.

    Alternating large-star and small-star steps; each step is one grouped
    minimum and one join, whose hot nodes Spark can split.
    """
    edges = ws.cut(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        True,
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = ws.cut(large.where(F.col("u") != F.col("v")).distinct(), True)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = ws.cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), True)
        now = _mark(after)
        ws.drop(large)
        ws.drop(edges)
        edges, done = after, now == mark
        mark = now
        if done:
            break
    # the last edges stay: the result is read from them
    lone = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(lone)


def _all_pairs(m: Column) -> Column:
    """Pairs of an array of (node, lead), smaller node first, in which either leads."""
    pairs = F.transform(
        m,
        lambda x, i: F.transform(
            F.filter(F.slice(m, i + F.lit(2), F.size(m)), lambda y: (x["lead"] | y["lead"]) & (x["node"] != y["node"])),
            lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")),
        ),
    )
    return F.flatten(pairs)


def _in_order(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _lists(ws: Workspace, postings: DataFrame) -> DataFrame:
    """postings(key, node, lead, prev, cnt) of the lists with a leader and another member."""
    if "lead" not in postings.columns:
        postings = postings.withColumn("lead", F.lit(True)).withColumn("prev", F.lit(None).cast("long"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("cnt"), F.max("lead").alias("led")).where("cnt > 1 and led")
    return ws.cut(postings.join(sizes.select("key", "cnt"), "key"))


def _short_pairs(live: DataFrame, short: int) -> DataFrame:
    few = live.where(F.col("cnt") <= short).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "lead"))).alias("m"))
    return few.select(F.explode(_all_pairs(F.col("m"))).alias("p")).select("p.a", "p.b")


class Sieve(NamedTuple):
    """Signatures of nodes and a test of all pairs of two blocks of them.

    ``table`` has a column node, a row or more for each, and signature columns;
    ``match(a, b)`` gives for two Arrow tables of these a matrix of truth
    values, true wherever ``verify`` might keep the pair.

    ``texts`` may give (node, text) for a table of nodes, one row or none for
    each, and ``confirm(xs, ys)`` which pairs of texts are linked, as ``verify``
    would; pairs whose texts are there are then decided where they are found.
    """

    table: DataFrame
    match: Callable[[pa.Table, pa.Table], np.ndarray]
    texts: Callable[[DataFrame], DataFrame] | None = None
    confirm: Callable[[list[str], list[str]], np.ndarray] | None = None


#: Members of a list on one side of a tile.
TILE = 2048
#: A list is joined with itself while that makes no more than this many rows of each of its rows; else it is dealt to tiles.
FEW_TRIES = 16


#: Pairs of a tile that are confirmed at once; keys of other lists that are looked at at once.
CONFIRMED, KEYS = 512, 1024


def _met_before(x: list[np.ndarray], y: list[np.ndarray], key: int) -> np.ndarray:
    """Which pairs of members, told by the keys of their lists, share a key below ``key`` too."""
    side = [np.repeat(np.arange(len(z)), [len(k) for k in z]) for z in (x, y)]
    keys = [np.concatenate(z) if z else np.zeros(0, np.int64) for z in (x, y)]
    both = np.intersect1d(*keys)
    both = both[both < key]
    out = np.zeros((len(x), len(y)), bool)
    for i in range(0, len(both), KEYS):
        some, has = both[i : i + KEYS], []
        for row, k, n in zip(side, keys, out.shape, strict=True):
            at = np.searchsorted(some, k)
            hit = some[np.minimum(at, len(some) - 1)] == k
            m = np.zeros((n, len(some)), np.float32)
            m[row[hit], at[hit]] = 1
            has.append(m)
        out |= has[0] @ has[1].T > 0
    return out


def _joining(p: np.ndarray, q: np.ndarray, label: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Numbers of pairs (p, q) of members that are linked; pairs that earlier ones have joined are not tried."""
    out, label, left = [], label.copy(), np.arange(len(p))
    while True:
        left = left[label[p[left]] != label[q[left]]]
        if not len(left):
            return np.concatenate(out) if out else left
        some, left = left[:CONFIRMED], left[CONFIRMED:]
        for k in some[linked(p[some], q[some])]:
            a, b = label[p[k]], label[q[k]]
            if a != b:
                label[label == b] = a
                out.append([k])


def _in_tile(sieve: Sieve):
    match, confirm = sieve.match, sieve.confirm

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a = table.filter(pa.array(own == i))
        b = a if i == j else table.filter(pa.array(own == j))
        ok = match(a, b) if a.num_rows and b.num_rows else np.zeros((a.num_rows, b.num_rows), bool)
        x, y = ({c: t.column(c).to_numpy() for c in ("node", "comp", "lead", "prev", "some")} for t in (a, b))
        ok &= x["comp"][:, None] != y["comp"][None, :]
        ok &= x["lead"][:, None] | y["lead"][None, :]
        ok &= ~((x["prev"][:, None] == y["prev"][None, :]) & x["some"][:, None] & y["some"][None, :])
        if i == j:
            ok = np.triu(ok, 1)
        sure = np.zeros(0, bool)
        if confirm is not None and ok.any():
            key = table.column("key")[0].as_py()
            lists = [[np.array(k, np.int64) for k in t.column("keys").to_pylist()] for t in (a, b)]
            ok &= ~_met_before(*lists, key)
        p, q = np.nonzero(ok)
        if confirm is not None:
            # a pair without its texts is handed on
            xs, ys = (np.array(t.column("text").to_pylist(), object) for t in (a, b))
            sure = np.array([xs[m] is not None and ys[n] is not None for m, n in zip(p.tolist(), q.tolist(), strict=True)], bool)
            one, two = p[sure], q[sure]
            _, label = np.unique(np.concatenate([x["comp"], y["comp"]]), return_inverse=True)
            found = _joining(one, two + len(xs), label, lambda m, n: confirm(xs[m].tolist(), ys[n - len(xs)].tolist()))
            p, q = np.concatenate([one[found], p[~sure]]), np.concatenate([two[found], q[~sure]])
            sure = np.arange(len(p)) < len(found)
        p, q = x["node"][p], y["node"][q]
        return pa.table({"a": pa.array(np.minimum(p, q)), "b": pa.array(np.maximum(p, q)), "sure": pa.array(sure if confirm is not None else np.zeros(len(p), bool))})

    return run


def _tiled(ws: Workspace, now: DataFrame, sieve: Sieve) -> DataFrame:
    """(a, b, sure): pairs across components of now(key, node, lead, prev, comp, big, total, n), list by list in tiles of bounded size.

    The n members in a list's largest component and the others are dealt to
    blocks of about TILE; every two blocks, one at least of the others, are a
    tile, so no task ever holds a list.  Pairs that are ``sure`` are linked and
    join what is not joined in the tile; the others are to be verified.  With
    ``confirm`` a pair of several lists is tried in the one of the lowest key.
    """
    outs = F.ceil((F.col("total") - F.col("n")) / TILE).cast("int")
    rows = now.withColumn("outs", outs).withColumn("blocks", F.col("outs") + F.ceil(F.col("n") / TILE).cast("int"))
    place = F.xxhash64("node")
    inner = F.col("comp") == F.col("big")
    own = F.when(inner, F.col("outs") + F.pmod(place, F.col("blocks") - F.col("outs"))).otherwise(F.pmod(place, "outs")).cast("int")
    rows = rows.withColumn("own", own)
    more, nodes, texts = [c for c in sieve.table.columns if c != "node"], None, None
    if sieve.confirm is None:
        rows = rows.join(sieve.table, "node")
    else:
        nodes = ws.cut(now.groupBy("node").agg(F.collect_set("key").alias("keys")))
        texts = sieve.texts(nodes.select("node"))
        rows = rows.join(nodes.join(sieve.table, "node").join(texts, "node", "left"), "node")
        more += ["keys", "text"]
    last = F.when(inner, F.col("outs")).otherwise(F.col("blocks")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    rows = rows.withColumn("some", F.col("prev").isNotNull()).withColumn("prev", F.coalesce("prev", F.lit(0).cast("long")))
    keep = ["key", "i", "j", "own", "node", "comp", "lead", "prev", "some", *more]
    out = ws.cut(rows.select(*keep).groupBy("key", "i", "j").applyInArrow(_in_tile(sieve), "a long, b long, sure boolean"))
    ws.drop(nodes, texts)
    return out


def linked_lists(
    ws: Workspace,
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    sieve: Sieve,
    short: int = 8,
    hubs: int = 2,
    refine: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, comp) from inverted lists postings(key, node[, lead, prev]); repeated rows do no harm.

    Two nodes are linked when they share a key in which either leads (by
    default all do) and ``verify`` keeps the pair (a < b).  The components
    are those of *all* such links, yet long lists are never expanded into all
    pairs: a long list first meets ``hubs`` of its leaders, 1 or 2, alone; then only pairs
    across different components can matter.  Those of a list with few members
    outside its largest component are joined; all others meet in tiles of
    bounded size, which hand on only what ``sieve`` lets through.  So
    ``verify`` runs twice, whatever the lists.  A node absent from the result
    is linked with nothing.

    ``refine`` may give, for the nodes of long lists, finer lists in which
    every linked pair of them also meets; these then replace the long ones.
    Their rows (key, node, lead, prev) may name an earlier key in which the
    node stands likewise: two nodes with one ``prev`` also meet there, so
    the pair is tried there and not again.
    """
    every = live = _lists(ws, postings)
    fine = None
    pairs = _short_pairs(live, short)
    many = live.where(F.col("cnt") > short)
    if refine is not None:
        fine = live = _lists(ws, refine(many.select("node").distinct()))
        pairs = pairs.union(_short_pairs(live, short))
        many = live.where(F.col("cnt") > short)
    leader = F.when(F.col("lead"), F.col("node"))
    if hubs > 1:
        chosen = many.groupBy("key").agg(F.min(leader).alias("hub"), F.min_by("node", F.when(F.col("lead"), F.xxhash64("node"))).alias("hub2"))
    else:
        company = many.groupBy("node").agg(F.sum("cnt").alias("company"))
        chosen = many.join(company, "node").groupBy("key").agg(F.max_by("node", F.when(F.col("lead"), F.struct("company", "node"))).alias("hub"))
        chosen = chosen.withColumn("hub2", F.col("hub"))
    star = ws.cut(many.join(chosen, "key"), True)
    met = _in_order(star, "node", "hub")
    met = (met.union(_in_order(star, "node", "hub2")) if hubs > 1 else met).where("a <> b")
    links = ws.cut(verify(pairs.union(met).distinct()))
    ws.drop(every, fine)
    labels = ws.cut(components(ws, links), True)
    rest = star.where("node <> hub and node <> hub2").join(labels, "node", "left")
    rest = ws.cut(rest.select("key", "node", "lead", "prev", F.coalesce("comp", "node").alias("comp")), True)
    ws.drop(links, star)
    shares = rest.groupBy("key", "comp").agg(F.count("*").alias("n"), F.count_if("lead").alias("k"))
    lists = (
        shares.groupBy("key")
        .agg(F.sum("n").alias("total"), F.sum("k").alias("leads"), F.max(F.struct("n", "comp", "k")).alias("top"), F.count("*").alias("kinds"))
        .where("kinds > 1 and leads > 0")
        .select("key", "total", "leads", F.col("top.n").alias("n"), F.col("top.comp").alias("big"), F.col("top.k").alias("k"))
    )
    outside = F.col("leads") - F.col("k")
    tries = outside * F.col("total") + (F.col("total") - F.col("n") - outside) * F.col("k")
    lists = ws.cut(lists.withColumn("few", tries <= FEW_TRIES * F.col("total")).select("key", "total", "n", "big", "few"), True)
    if lists.isEmpty():
        ws.drop(rest, lists)
        return labels
    now = ws.cut(rest.join(lists, "key"))
    few = now.where("few")
    other = few.select("key", F.col("node").alias("node2"), F.col("comp").alias("comp2"), F.col("lead").alias("lead2"), F.col("prev").alias("prev2"))
    led = few.where("comp <> big and lead").select("key", "node", "comp", "prev", "big").join(other, "key")
    plain = few.where("comp <> big and not lead").select("key", "node", "comp", "prev", "big").join(other, "key").where("comp2 = big and lead2")
    out = _in_order(led.union(plain).where("comp <> comp2 and coalesce(prev <> prev2, true)"), "node", "node2")
    tiles = None
    if not lists.where("not few").isEmpty():
        tiles = _tiled(ws, now.where("not few"), sieve)
        out = out.union(tiles.where("not sure").select("a", "b"))
    more = ws.cut(verify(out.distinct()))
    found = more if tiles is None else more.union(tiles.where("sure").select("a", "b"))
    if not found.isEmpty():
        known = labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        before, labels = labels, ws.cut(components(ws, known.union(found)), True)
        ws.drop(before)
    ws.drop(rest, lists, now, tiles, more)
    return labels
