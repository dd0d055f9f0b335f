"""Commands: run, compare, backfill, rescore and latency."""

from __future__ import annotations

import argparse
import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.labels import aperture_label, aperture_tag
from .functions.shipping import ship
from .functions.text import pseudonym_map, pseudonymise_outside
from .operators import backfill as bf
from .operators import compare as cm
from .operators import delta as dl
from .operators import evaluate as ev
from .operators import latency as lt
from .operators import score_index as si
from .operators import scoring as sc
from .reports import figures as fg
from .reports import markdown as md
from .sources import corpus as co
from .sources import files as fl
from .sources import store as st
from .streaming.durable import Staging


#: Defaults of the corpus and of the store can be set in the environment.
_DATA = {"default": os.environ["TALLYGRID_DATA"]} if "TALLYGRID_DATA" in os.environ else {"required": True}
_RESULTS = {"default": os.environ.get("TALLYGRID_RESULTS", "results")}


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("tallygrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def _detector(name: str) -> sc.Detector:
    if name not in sc.REGISTRY:
        raise SystemExit(f"no detector {name}; there are {', '.join(sorted(sc.REGISTRY))}")
    return sc.REGISTRY[name]()


def _adapters(folders: list[str] | None, spark: SparkSession | None = None) -> None:
    for f in folders or []:
        sc.load_adapters(f, spark)


def measure(docs: DataFrame, scores: DataFrame, binary: bool, fpr: float) -> dict[str, DataFrame]:
    """All tables that follow from scores: thresholds, cells, marginals and rates at each budget, and the curve."""
    rows = co.scored(scores, docs)
    clean, injected = rows.where("label = 'clean'"), rows.where("label = 'injected'")
    taus = ev.budgets(clean, sorted({fpr, *ev.POINTS}), binary)
    out = {"taus": docs.sparkSession.createDataFrame(taus, "budget double, tau double")}
    out |= {"cells": ev.cell_grid(injected, taus), "marginals": ev.marginals(injected, taus), "rates": ev.false_positives(clean, taus)}
    if not binary:
        out["curve"] = ev.recall_curve(rows)
    return out


def remeasure(spark: SparkSession, out: str, parent: str, binary: bool, fpr: float, old: DataFrame, fresh: DataFrame, docs: DataFrame) -> dict[str, DataFrame] | None:
    """The tables of a run after an edit, from its parent's tables and index and the fresh scores alone; None if the parent lacks them."""
    if not all(fl.exists(spark, f"{out}/{t}/run_id={parent}") for t in ("taus", "cells", "marginals", "rates", "index/counts")):
        return None
    load = lambda t: spark.read.parquet(f"{out}/{t}/run_id={parent}")
    index = si.read(spark, f"{out}/index")
    index = si.Index(*[t.where(F.col("run_id") == parent) for t in index])
    changes = dl.corrections(index, parent, old, fresh, docs)
    before = {r["budget"]: r["tau"] for r in load("taus").collect()}
    if binary:
        after, moved = before, None
    else:
        moved = dl.points(index, changes, parent, sorted({fpr, *ev.POINTS, *ev.CURVE})).cache()
        after = {r["target"]: r["tau"] for r in moved.collect() if r["target"] in before}
    if set(after) != set(before):
        return None
    gains = dl.differences(index, changes, parent, before, after)
    tables = {"taus": spark.createDataFrame(sorted(after.items()), "budget double, tau double")}
    tables |= {"cells": dl.cells(load("cells"), gains), "marginals": dl.marginals(load("marginals"), gains), "rates": dl.rates(load("rates"), gains)}
    return tables if moved is None else tables | {"curve": dl.curve(moved)}


def _store(spark: SparkSession, out: str, run_id: str, record: dict, tables: dict[str, DataFrame]) -> dict:
    """Write a run's tables and then its record, which makes it known; the record with what was measured."""
    for name, df in tables.items():
        st.derive(df, out, name, run_id)
    bf.note(spark, out, [(run_id, name) for name in tables])
    here = lambda t, v: F.sum(F.when(F.col("budget").eqNullSafe(F.lit(record["budget"]).cast("double")), F.col(v)).otherwise(0))
    share = lambda t: spark.read.parquet(f"{out}/{t}/run_id={run_id}").agg((here(t, "hits") / F.nullif(here(t, "n"), F.lit(0))).alias("r"), here(t, "n").alias("n")).first()
    cells, rates = share("cells"), share("rates")
    done = record | {"mean_recall": cells["r"], "fpr_pooled": rates["r"], "n_injected": cells["n"], "n_clean": rates["n"], "run_at": time.strftime("%Y-%m-%d %H:%M:%S")}
    st.save_run(spark, done, out, run_id)
    return done


def _index(spark: SparkSession, out: str, run_id: str, docs: DataFrame) -> None:
    """Index a run's saved scores, if that has not been done."""
    rows = co.scored(spark.read.parquet(f"{out}/scores/run_id={run_id}"), docs).withColumn("run_id", F.lit(run_id))
    si.write(rows, f"{out}/index", [run_id])


def _page(spark: SparkSession, out: str, run_id: str, settings: dict) -> Path:
    read = lambda t: [r.asDict() for r in spark.read.parquet(f"{out}/{t}/run_id={run_id}").collect()]
    cells, pages = read("cells"), Path(out) / "reports"
    first = min((c["budget"] for c in cells if c["budget"] is not None), default=None)
    grid = {(c["family"], c["action"]): (c["hits"], c["n"]) for c in cells if c["budget"] == first}
    rows, cols = sorted({r for r, _ in grid}), sorted({c for _, c in grid})
    pics = [fg.save(fg.heat(grid, rows, cols, "Recall by cell"), pages / f"{run_id}-cells.svg")]
    if not settings["verdict"]:
        points = [(r["fpr"], r["recall"]) for r in read("curve")]
        pics.append(fg.save(fg.curve({settings["detector"]: points}, "Recall over budget"), pages / f"{run_id}-curve.svg"))
    text = md.run_page({"title": settings["display"] or settings["detector"], **settings}, cells, read("marginals"), read("rates"), [p for p in pics if p])
    return md.write(text, pages / f"{run_id}.md")


def _documents(raw: DataFrame, slice_name: str, pseudonymise: bool) -> DataFrame:
    """Documents of a slice from raw rows, of a table or of a stream."""
    docs = co.project(raw.where(co.slice_filter(slice_name)))
    if not pseudonymise:
        return docs
    moved = pseudonymise_outside(F.col("text"), F.col("inj_span.a"), F.col("inj_span.b"))
    span = F.when(F.col("inj_span").isNotNull(), F.struct(F.col("m.a").alias("a"), F.col("m.b").alias("b")))
    return docs.withColumn("m", moved).withColumn("text", F.col("m.text")).withColumn("inj_span", span).drop("m")


def _check_aperture(det: sc.Detector) -> None:
    """A window beyond what the detector's own class declares would be refused by its model, text by text."""
    most, (policy, window, _) = type(det).max_chars, det.aperture()
    if most and (policy == "full" or window > most):
        raise SystemExit(f"{det.name} takes at most {most} characters, not {'whole documents' if policy == 'full' else window}")


def run(a: argparse.Namespace) -> None:
    if a.list:
        known = [r["detector"] for f in a.adapters or [] for r in sc.registered(f)]  # read, not imported
        print("\n".join(sorted({*sc.REGISTRY, *known})))
        return
    spark = _session()
    _adapters(a.adapters, spark)
    det = _detector(a.detector)
    forced = a.window is not None or a.policy is not None
    det.max_chars, det.policy = a.window or det.max_chars, a.policy or ("chunk" if a.window and det.policy == "full" else det.policy)
    det.overlap = det.overlap if a.overlap is None else a.overlap
    if forced:
        _check_aperture(det)
    policy, window, overlap = det.aperture()
    settings = {
        "detector": det.name, "version": det.version, "slice": a.slice, "policy": policy, "window": window, "overlap": None if overlap is None else float(overlap),
        "forced": forced, "limit_n": a.limit, "pseudonymised": a.pseudonymise, "dataset": co.fingerprint(co.read_raw(spark, a.data)).first()[0],
    }
    record = settings | {"display": det.display, "verdict": det.binary, "target_fpr": a.fpr, "budget": None if det.binary else a.fpr}
    if a.skip_if_done and fl.exists(spark, f"{a.out}/runs"):
        kinds = ", ".join(x.strip() for x in st.RECORD.split(",") if x.split()[0] in st.SETTINGS)
        want = spark.createDataFrame([(*(settings[x.split()[0]] for x in kinds.split(", ")), "w")], f"{kinds}, want_id string")
        if st.already_measured(st.read_runs(spark, a.out).where("mean_recall is not null"), want).first()["measured"]:
            print("already measured")
            return
    build = co.build(spark, a.data, a.out, settings["dataset"], a.batch)
    staging = Staging(spark, a.out, settings | {"verdict": det.binary})
    run_id, had = staging.claim(f"{det.name}-{int(time.time() * 1000)}"), staging.done()
    if had:
        print(f"resuming {run_id}: {had} documents are scored")
    raw, keep = spark.read.schema(co.RAW).parquet(build), None
    if a.limit:
        co.limit_per_side(_documents(raw, a.slice, False).select("id", "label"), a.limit).select("id").write.mode("ignore").parquet(f"{staging.home}/ids")
        keep = spark.read.parquet(f"{staging.home}/ids")

    def prepare(rows: DataFrame) -> DataFrame:
        docs = _documents(rows, a.slice, a.pseudonymise)
        return docs if keep is None else docs.join(keep, "id", "left_semi")

    began, docs = time.monotonic(), prepare(raw)
    staging.score(build, prepare, det)
    staging.promote(run_id, docs)
    record |= {"n_windows": staging.windows(), "seconds": round(time.monotonic() - began, 1)}
    scores = spark.read.parquet(f"{a.out}/scores/run_id={run_id}")
    warning = ev.check_score_type(scores, det.binary)
    if warning:
        print(f"warning: {warning}")
    clean = co.scored(scores, docs).where("label = 'clean'")
    ev.check_score_floor(clean, a.fpr, det.binary)
    _index(spark, a.out, run_id, docs)
    if a.pseudonymise:
        plain = _documents(raw, a.slice, False)
        st.derive(pseudonym_map(plain if keep is None else plain.join(keep, "id", "left_semi")), a.out, "pseudonyms", run_id)
    record = _store(spark, a.out, run_id, record, measure(docs, scores, det.binary, a.fpr))
    staging.clear()
    print(run_id if a.no_report else _page(spark, a.out, run_id, record))


def _fill(spark: SparkSession, results: str, runs: DataFrame) -> None:
    done, refused = bf.fill(spark, results, runs)
    if done:
        print(f"made {len(done)} tables of {len({r for r, *_ in done})} runs from saved scores")
    for run_id, why in sorted(refused.items()):
        print(f"{run_id}: {why}")


def backfill(a: argparse.Namespace) -> None:
    """Make the tables that saved runs lack, or that follow an older definition, without any detector."""
    spark = _session()
    runs = st.read_runs(spark, a.results)
    if a.dry_run:
        for r in bf.todo(runs, bf.notes(spark, a.results), bf.definitions()).orderBy("run_id", "table").collect():
            print(f"{r['run_id']}: {r['table']} is {r['state']}")
        return
    _fill(spark, a.results, runs)


def compare(a: argparse.Namespace) -> None:
    """All runs of the current build side by side: a fixed number of jobs, whatever their number."""
    spark = _session()
    runs = st.latest(st.measurements(st.read_runs(spark, a.results), a.slice))
    build = a.dataset or st.current_build(runs).first()[0]
    runs = runs.where(F.col("dataset") == build)
    _fill(spark, a.results, runs)
    label = aperture_label(F.col("policy"), F.col("window"), F.col("overlap").cast("int"), F.col("forced"))
    known = sorted({*sc.REGISTRY, *(r["detector"] for f in a.adapters or [] for r in sc.registered(f))})
    page = cm.overview(spark, a.results, runs.withColumn("aperture", label), ev.POINTS, known)
    rows = [r.asDict() | {k: {p["budget"]: p["v"] for p in r[k] or []} for k in ("recall", "fpr")} for r in page["headline"].collect()]
    sections = [md.comparison(rows, ev.POINTS)]
    for title, name, columns in (
        ("Best in each cell", "winners", ("budget", "family", "action", "detector", "recall", "margin", "clear")),
        ("Recall by family, in order of the reference detector", "axes", ("budget", "key", "title", "recall")),
        ("Scored detectors at a verdict's rate", "peers", ("subject", "run_id", "recall")),
        ("Detectors without a run", "roster", ("detector", "status")),
    ):
        if page[name] is not None and (found := page[name].collect()):
            sections.append(f"\n## {title}\n\n" + md.table(columns, [[md.shown(r[c]) for c in columns] for r in found]) + "\n")
    out = Path(a.out or a.results) / "reports"
    md.write("".join(sections), out / "comparison.md")
    pages = {p.stem: p.name for p in out.glob("*.md") if p.stem != "index"}
    print(md.write(md.index(pages), out / "index.md"))


def _tree(spark: SparkSession, out: str, build: str, docs: DataFrame) -> DataFrame:
    """The stored hash tree of a build."""
    if not fl.exists(spark, f"{out}/trees/run_id={build}/_SUCCESS"):
        st.derive(co.tree(docs), out, "trees", build)
    return spark.read.parquet(f"{out}/trees/run_id={build}")


def _edited(spark: SparkSession, a: argparse.Namespace, build: str) -> DataFrame:
    """Ids that differ between the parent build, as a run laid it out, and the corpus: only ranges of ids whose hashes differ are compared."""
    parent = f"{a.results}/builds/{a.parent}"
    if not fl.exists(spark, f"{parent}/_SUCCESS"):
        raise SystemExit(f"nothing to score anew: give --ids or --ids-from, or run once on build {a.parent} here")
    before, after = spark.read.schema(co.RAW).parquet(parent), co.read_raw(spark, a.data)
    found = co.changed_documents(before, after, (_tree(spark, a.results, a.parent, before), _tree(spark, a.results, build, after)))
    if found.where("change = 'removed'").limit(1).count():
        raise SystemExit("the corpus lost documents: that is no edit but another corpus")
    return found.select("id")


def rescore(a: argparse.Namespace) -> None:
    """Carry runs of a parent build over an edit: score the changed documents anew, keep the others."""
    spark = _session()
    _adapters(a.adapters, spark)
    docs, build = co.load(spark, a.data), co.fingerprint(co.read_raw(spark, a.data)).first()[0]
    ids = (co.changed_ids(spark, a.ids, a.ids_from) if a.ids or a.ids_from else _edited(spark, a, build)).cache()
    lost = co.missing(ids, docs).limit(3).collect()
    if lost:
        raise SystemExit(f"not in the corpus: {[r['id'] for r in lost]}")
    runs = st.read_runs(spark, a.results)
    have = [f.removeprefix("run_id=") for f in fl.folders(spark, f"{a.results}/scores")]
    runs = runs.withColumn("has_scores", F.col("run_id").isin(have)).withColumn("registered", F.col("detector").isin(list(sc.REGISTRY)))
    tag = aperture_tag(F.col("policy"), F.col("window"), F.col("overlap").cast("int"), F.col("forced"))
    for r in runs.select("*", st.splice_refusal(a.parent).alias("why"), tag.alias("tag")).collect():
        if r["why"] or (a.only and r["detector"] not in a.only.split(",")):
            print(f"{r['run_id']}: {r['why'] or 'not asked for'}")
            continue
        det = _detector(r["detector"])
        det.policy, det.max_chars = r["policy"], r["window"]
        det.overlap = int(r["overlap"]) if r["overlap"] else det.overlap
        old = spark.read.parquet(f"{a.results}/scores/run_id={r['run_id']}")
        if co.missing(docs, old.unionByName(ids.select("id", F.lit(0.0).alias("score")))).limit(1).count():
            print(f"{r['run_id']}: it lacks scores of unchanged documents")
            continue
        fresh = sc.score_documents(docs.join(ids, "id"), det).cache()
        print(f"{r['run_id']}: {sc.moved(old, fresh).count()} scores move")
        if a.dry_run:
            continue
        run_id = f"{r['detector']}-{r['tag']}-{build}"
        st.save_scores(sc.splice(old, fresh).unionByName(co.missing(fresh, old).join(fresh, "id")), a.results, run_id)
        fpr = 0.001 if r["target_fpr"] is None else r["target_fpr"]
        tables = remeasure(spark, a.results, r["run_id"], r["verdict"], fpr, old, fresh, docs)
        if tables is None:
            tables = measure(docs, spark.read.parquet(f"{a.results}/scores/run_id={run_id}"), r["verdict"], fpr)
        record = {k: v for k, v in r.asDict().items() if k not in ("run_id", "why", "tag", "has_scores", "registered")}
        record |= {"dataset": build, "target_fpr": fpr, "budget": None if r["verdict"] else fpr, "derived_from": r["run_id"], "inherited": ["n_windows", "seconds"]}
        st.derive(ids, a.results, "rescored", run_id)
        done = _store(spark, a.results, run_id, record, tables)
        _index(spark, a.results, run_id, docs)
        print(f"{run_id}: recall {md.shown(r['mean_recall'])} -> {md.shown(done['mean_recall'])}, false positives {md.shown(r['fpr_pooled'])} -> {md.shown(done['fpr_pooled'])}")
        fresh.unpersist()


def latency(a: argparse.Namespace) -> None:
    """The detector alone, a document at a time in this process: Spark draws the sample only."""
    spark = _session()
    _adapters(a.adapters, spark)
    det = _detector(a.detector)
    texts = [r["text"] for r in lt.mixed_sample(co.load(spark, a.data, a.slice), a.n + a.warmup).collect()]
    det.setup()
    try:
        every = lt.measure(det.score_text, texts)
    except NotImplementedError:
        raise SystemExit(f"{det.name} has no score_text to be timed") from None
    finally:
        det.teardown()
    ms, sizes = every[a.warmup :], list(map(len, texts[a.warmup :]))
    policy, window, overlap = det.aperture()
    record = {"detector": det.name, "version": det.version, "notes": det.notes, "n": len(ms), "warmup": a.warmup, "median_chars": round(lt.percentile(sizes, 0.5))}
    record |= {f"p{round(p * 100)}_ms": round(lt.percentile(ms, p), 3) for p in (0.5, 0.95, 0.99)}
    record |= {"min_ms": round(min(ms, default=0.0), 3), "max_ms": round(max(ms, default=0.0), 3), "cold_first_ms": round(every[0], 3) if every else None}
    record |= {"gpu_processes": lt.gpu_processes(), "aperture": {"policy": policy, "size": window, "overlap": overlap}}
    record |= {"dataset": co.fingerprint(co.read_raw(spark, a.data)).first()[0], "run_at": time.strftime("%Y-%m-%d %H:%M:%S")}
    if a.out:
        folder = Path(a.out) / "latency"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{det.name}.json").write_text(json.dumps(record, indent=1))
    print(json.dumps(record))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tallygrid")
    sub = p.add_subparsers(required=True)
    q = sub.add_parser("run")
    q.set_defaults(f=run)
    for flag, kw in {
        "--detector": {"default": "floor"}, "--slice": {"default": "all"}, "--fpr": {"type": float, "default": 0.001}, "--data": _DATA, "--batch": {"type": int, "default": int(os.environ.get("TALLYGRID_BATCH", "2000"))}, "--limit": {"type": int},
        "--pseudonymise": {"action": "store_true"}, "--window": {"type": int, "nargs": "?", "const": 2000}, "--policy": {"choices": ["full", "sentence", "truncate", "chunk"]},
        "--overlap": {"type": int}, "--adapters": {"action": "append"}, "--out": _RESULTS, "--no-report": {"action": "store_true"}, "--skip-if-done": {"action": "store_true"}, "--list": {"action": "store_true"},
    }.items():
        q.add_argument(flag, **kw)
    q = sub.add_parser("compare")
    q.set_defaults(f=compare)
    for flag, kw in {"--results": _RESULTS, "--slice": {"default": "all"}, "--dataset": {}, "--adapters": {"action": "append"}, "--out": {}}.items():
        q.add_argument(flag, **kw)
    q = sub.add_parser("backfill")
    q.set_defaults(f=backfill)
    for flag, kw in {"--results": _RESULTS, "--dry-run": {"action": "store_true"}}.items():
        q.add_argument(flag, **kw)
    q = sub.add_parser("rescore")
    q.set_defaults(f=rescore)
    for flag, kw in {"--ids": {}, "--ids-from": {}, "--results": _RESULTS, "--data": _DATA, "--only": {}, "--parent": {"required": True}, "--adapters": {"action": "append"}, "--dry-run": {"action": "store_true"}}.items():
        q.add_argument(flag, **kw)
    q = sub.add_parser("latency")
    q.set_defaults(f=latency)
    for flag, kw in {"--detector": {"default": "floor"}, "--n": {"type": int, "default": 200}, "--warmup": {"type": int, "default": 10}, "--slice": {"default": "all"}, "--data": _DATA, "--adapters": {"action": "append"}, "--out": {}}.items():
        q.add_argument(flag, **kw)
    a = p.parse_args(argv)
    a.f(a)


if __name__ == "__main__":
    main()
