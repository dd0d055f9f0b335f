"""Shared SQL of the oracle statements, as named common table expressions."""

from __future__ import annotations

import re

from ..functions.text import EMAIL
from ..sources.tables import RUNS

_EMAIL = EMAIL.replace("'", "''")


def _lit(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)


_Z2 = "1.96*1.96"


def wilson(h: str, n: str) -> str:
    """lo and hi columns."""
    p = f"({h}*1.0::DOUBLE/nullif({n},0))"
    d = f"(1+CAST(1.96 AS DOUBLE)*CAST(1.96 AS DOUBLE)/{n})"
    z = "CAST(1.96 AS DOUBLE)"
    centre = f"({p}+{z}*{z}/(2*{n}))/{d}"
    half = f"{z}*sqrt({p}*(1-{p})/{n}+{z}*{z}/(4*{n}*{n}))/{d}"
    zero = "CAST(0 AS DOUBLE)"
    return (
        f"CASE WHEN {n}=0 THEN {zero} ELSE greatest({zero},{centre}-{half}) END AS lo, "
        f"CASE WHEN {n}=0 THEN {zero} ELSE least(CAST(1 AS DOUBLE),{centre}+{half}) END AS hi"
    )


def recall(h: str = "hits", n: str = "n", name: str = "recall") -> str:
    return f"CASE WHEN {n}=0 THEN CAST(0 AS DOUBLE) ELSE CAST({h} AS DOUBLE)/nullif({n},0) END AS {name}, {wilson(h, n)}"


def _pick(index: str, names: tuple[str, ...]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " END"


_SPLICE, _OBF, _HOST = ("end", "paragraph", "sentence"), ("none", "homoglyph", "zero_width", "leetspeak"), ("email", "doc", "web")


def pick_tau(scores: str, target: str, by: str | None = None) -> str:
    """Threshold for each (by) and budget from a clean score table with targets t."""
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return (
        f"SELECT {cols}t AS target, min(score) AS tau FROM (SELECT *, row_number() OVER ({part} ORDER BY score DESC) AS rk, "
        f"count(*) OVER ({part}) AS cn FROM {scores}), {target} WHERE rk = CAST(floor(cn*t) AS BIGINT)+1 GROUP BY ALL"
    )


AXES = ("family", "action", "host_type", "host_source", "spliced_at", "obfuscation")
#: The budgets of the curve.
CURVE = "(VALUES (0.00001::DOUBLE),(0.00002::DOUBLE),(0.00005::DOUBLE),(0.0001::DOUBLE),(0.0002::DOUBLE),(0.0005::DOUBLE),(0.001::DOUBLE),(0.002::DOUBLE),(0.005::DOUBLE),(0.01::DOUBLE),(0.02::DOUBLE),(0.05::DOUBLE),(0.1::DOUBLE)) AS tt(t)"
POINTS = "(VALUES (0.001::DOUBLE),(0.01::DOUBLE)) AS tt(t)"

_SCORED = [r for r in RUNS if r[0] in ("r01", "r02", "r03", "r04", "r05")]
_ALL = [r for r in RUNS if r[0] in ("r01", "r02", "r03", "r04", "r05", "r06", "r07", "r11")]

CTES: dict[str, str] = {
    "row_corpus": f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d%H%M%S')) AS id,
        CASE WHEN l_returnflag='R' THEN 'injected' ELSE 'clean' END AS label, {_pick('l_suppkey % 3', _HOST)} AS host_type,
        'src' || (l_suppkey % 6) AS host_source, CASE WHEN l_returnflag='R' THEN 'f' || l_linenumber END AS family,
        CASE WHEN l_returnflag='R' THEN 'a' || l_linestatus END AS action,
        CASE WHEN l_returnflag='R' THEN {_pick('l_partkey % 3', _SPLICE)} END AS spliced_at,
        CASE WHEN l_returnflag='R' THEN {_pick('l_orderkey % 4', _OBF)} END AS obfuscation,
        l_extendedprice*l_discount AS a, l_extendedprice*(l_discount+l_tax) AS b, l_extendedprice*l_tax AS c, l_quantity*l_extendedprice AS d,
        CASE WHEN l_discount >= 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v,
        CASE WHEN l_discount >= 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w, l_discount AS tied FROM lineitem""",
    "doc_corpus": f"""SELECT CAST(doc_id AS VARCHAR) AS id, text, CASE WHEN toxic=1 THEN 'injected' ELSE 'clean' END AS label,
        {_pick('CAST(substr(source,4) AS INT) % 3', _HOST)} AS host_type, source AS host_source, CASE WHEN toxic=1 THEN lang END AS family,
        CASE WHEN toxic=1 THEN 'q' || quality END AS action, CASE WHEN toxic=1 THEN {_pick('doc_id % 3', _SPLICE)} END AS spliced_at,
        CASE WHEN toxic=1 THEN {_pick('doc_id % 4', _OBF)} END AS obfuscation, doc_id % 5 = 0 AS pii,
        CASE WHEN doc_id % 7 <> 0 THEN doc_id % 2 = 0 END AS typography_folded,
        CASE WHEN toxic=1 THEN CASE doc_id % 3 WHEN 0 THEN 'haiku' WHEN 1 THEN 'large' END END AS gen_model
        FROM documents JOIN labels USING (doc_id)""",
    "clean": "SELECT *, a AS score FROM row_corpus WHERE label='clean'",
    "injected": "SELECT *, a AS score FROM row_corpus WHERE label='injected'",
    "tau1": pick_tau("clean", "(VALUES (0.001::DOUBLE)) AS tt(t)"),
    "tau2": pick_tau("clean", POINTS),
    "tau13": pick_tau("clean", CURVE),
    "cells": f"SELECT *, {recall()} FROM (SELECT target AS budget, family, action, count(*) FILTER (score>=tau) AS hits, count(*) AS n FROM injected, tau1 GROUP BY ALL)",
    "cells2": f"SELECT *, {recall()} FROM (SELECT target AS budget, family, action, count(*) FILTER (score>=tau) AS hits, count(*) AS n FROM injected, tau2 GROUP BY ALL)",
    "marg": f"SELECT *, {recall()} FROM (" + " UNION ALL ".join(f"SELECT target AS budget, '{a}' AS axis, {a} AS key, count(*) FILTER (score>=tau) AS hits, count(*) AS n FROM injected, tau1 WHERE {a} IS NOT NULL GROUP BY ALL" for a in AXES) + ")",
    "fpr_host": f"SELECT *, {recall(name='fpr')} FROM (SELECT target AS budget, host_type, count(*) FILTER (score>=tau) AS hits, count(*) AS n FROM clean, tau1 GROUP BY ALL)",
    "curve": "SELECT target, tau AS threshold, (SELECT count(*) FILTER (score>=tau) FROM clean)::DOUBLE/(SELECT count(*) FROM clean) AS fpr, (SELECT count(*) FILTER (score>=tau) FROM injected)::DOUBLE/(SELECT count(*) FROM injected) AS recall FROM tau13",
    "runs": f"SELECT * FROM (VALUES {values(RUNS)}) AS t(run_id, detector, version, display, policy, \"window\", overlap, forced, limit_n, slice, dataset, run_at, verdict, score_column)",
    "scored": " UNION ALL ".join(f"SELECT '{r[0]}' AS run_id, '{r[1]}' AS detector, {r[-1]} AS score, label, host_type, family, action FROM row_corpus" for r in _SCORED),
    "measured": " UNION ALL ".join(f"SELECT '{r[0]}' AS run_id, '{r[1]}' AS detector, {_lit(r[12])} AS verdict, {r[-1]} AS score, label, host_type, family, action FROM row_corpus" for r in _ALL),
    "filled": " UNION ALL ".join(f"SELECT '{r[0]}' AS run_id, {_lit(r[12])} AS verdict, {r[-1]} AS score, label, {', '.join(AXES)} FROM row_corpus" for r in _ALL),
    "filled_tau": pick_tau("(SELECT * FROM filled WHERE label='clean' AND NOT verdict)", POINTS, "run_id") + " UNION ALL "
    + pick_tau("(SELECT * FROM filled WHERE label='clean' AND run_id='r03')", "(VALUES (0.05::DOUBLE)) AS tt(t)", "run_id") + " UNION ALL SELECT DISTINCT run_id, NULL, 0.5::DOUBLE FROM filled WHERE verdict",
    "filled_tau13": pick_tau("(SELECT * FROM filled WHERE label='clean' AND NOT verdict)", CURVE, "run_id"),
    "note_log": f"SELECT 'run' || l_orderkey AS run_id, {_pick('l_linenumber % 5', ('taus', 'cells', 'marginals', 'rates', 'curve'))} AS \"table\", 'd' || (l_suppkey % 2) AS definition, CAST(l_partkey % 40 AS BIGINT) AS made FROM lineitem",
    "run_tau13": pick_tau("(SELECT * FROM scored WHERE label='clean')", CURVE, "run_id"),
    "run_curve": "SELECT run_id, target, count(*) FILTER (label='clean' AND score>=tau)::DOUBLE/count(*) FILTER (label='clean') AS fpr, count(*) FILTER (label='injected' AND score>=tau)::DOUBLE/count(*) FILTER (label='injected') AS recall FROM scored JOIN run_tau13 USING (run_id) GROUP BY ALL",
    "run_tau": pick_tau("(SELECT * FROM measured WHERE label='clean' AND NOT verdict)", "(VALUES (0.01::DOUBLE)) AS tt(t)", "run_id") + " UNION ALL SELECT run_id, NULL, 0.5::DOUBLE FROM runs WHERE verdict",
    "run_cells": f"SELECT *, {recall()} FROM (SELECT run_id, detector, family, action, count(*) FILTER (score>=tau) AS hits, count(*) AS n FROM measured JOIN run_tau USING (run_id) WHERE label='injected' GROUP BY ALL)",
    "run_pooled": "SELECT run_id, detector, verdict, count(*) FILTER (label='clean' AND score>=tau)::DOUBLE/count(*) FILTER (label='clean') AS fpr_pooled, count(*) FILTER (label='injected' AND score>=tau)::DOUBLE/count(*) FILTER (label='injected') AS mean_recall FROM measured JOIN run_tau USING (run_id) GROUP BY ALL",
    "auc_steps": "SELECT *, lead(fpr) OVER (PARTITION BY run_id ORDER BY fpr, target) AS f2, lead(recall) OVER (PARTITION BY run_id ORDER BY fpr, target) AS r2 FROM run_curve WHERE fpr > 0 AND fpr <= 0.01::DOUBLE",
    "aucs": "SELECT c.run_id, max(CASE WHEN width > 0 THEN area/width ELSE last END) AS auc FROM run_curve c LEFT JOIN (SELECT run_id, sum((log10(f2)-log10(fpr))*(recall+r2)/2) AS area, coalesce(sum(log10(f2)-log10(fpr)),0) AS width, arg_max(recall, fpr*1000+target) AS last FROM auc_steps GROUP BY run_id) s USING (run_id) GROUP BY c.run_id",
    "run_log": f"""SELECT 'run' || o_orderkey AS run_id, CASE WHEN o_custkey % 53 = 52 THEN 'floor' ELSE 'det' || (o_custkey % 53) END AS detector, {_pick('o_orderkey % 4', ('v1.0', 'large', '', '2'))} AS version,
        CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Detector ' || {_pick('o_orderkey % 4', ('v1.0', 'large', '', '2'))} ELSE 'Detector' END AS display,
        CASE WHEN o_orderkey % 7 < 3 THEN 'chunk' WHEN o_orderkey % 7 = 3 THEN 'truncate' WHEN o_orderkey % 7 = 4 THEN 'sentence' WHEN o_orderkey % 7 = 5 THEN 'full' END AS policy,
        CASE WHEN o_orderkey % 7 < 5 THEN CASE o_custkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 2000 ELSE 500 END END AS "window",
        CASE WHEN o_orderkey % 7 < 3 THEN CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE 4 END END AS overlap, o_orderkey % 11 = 0 AS forced,
        CASE o_orderkey % 13 WHEN 0 THEN 50 WHEN 1 THEN 0 END AS limit_n, CASE o_orderkey % 17 WHEN 0 THEN 'strong' WHEN 1 THEN NULL ELSE 'all' END AS slice,
        CASE WHEN o_orderkey % 19 <> 1 THEN o_orderkey % 19 = 0 END AS pseudonymised, CASE WHEN o_orderkey % 23 <> 0 THEN 'b' || (year(o_orderdate) % 3) END AS dataset,
        strftime(o_orderdate, '%Y-%m-%d %H:%M') AS run_at, (o_custkey % 53) % 5 = 0 AS verdict, CASE WHEN o_orderkey % 29 <> 0 THEN (o_orderkey % 100)/100.0::DOUBLE END AS mean_recall, o_orderkey % 31 <> 0 AS has_scores FROM orders""",
    "registry_log": "SELECT 'det' || (n_nationkey * 3) AS detector, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END AS registered FROM nation",
    "address_spans": f"""SELECT doc_id, e - length(m) AS a, e AS b FROM (SELECT doc_id, m, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM
        (SELECT doc_id, unnest(range(1, len(m)+1)) AS i, unnest(p[1:len(m)]) AS p, unnest(m) AS m FROM (SELECT doc_id, string_split_regex(text, '{_EMAIL}') AS p, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents)))""",
    "edited": "SELECT label, CASE WHEN touched AND ok % 10 = 0 THEN 'edited' ELSE host_type END AS host_type, host_source, family, action, spliced_at, obfuscation, CASE WHEN touched THEN c ELSE a END AS score FROM (SELECT *, ok % 97 = 5 AS touched FROM (SELECT *, split_part(id, '-', 1)::BIGINT AS ok FROM row_corpus))",
    "edited_tau2": pick_tau("(SELECT score FROM edited WHERE label='clean')", POINTS),
    "edited_tau13": pick_tau("(SELECT score FROM edited WHERE label='clean')", CURVE),
    "pieces": "SELECT doc_id, text, unnest(p) AS piece, generate_subscripts(p, 1)-1 AS k FROM (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])([ \\t]+[A-Z\"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM documents)",
    "spans": "SELECT doc_id, k, piece, length(text) AS size, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS s, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM pieces",
    "whole": "SELECT doc_id, 0 AS win, 0 AS a, length(text) AS b FROM documents WHERE length(text) <= 2000",
    "long_spans": "SELECT doc_id, k, piece, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, count(*) OVER (PARTITION BY doc_id) AS m FROM spans WHERE size > 2000",
    "reach": "SELECT x.doc_id, x.k AS i, x.s, greatest(x.k+1, (SELECT count(*) FROM long_spans y WHERE y.doc_id=x.doc_id AND y.e <= x.s+2000)) AS j, x.m FROM long_spans x",
}


def sql(body: str) -> str:
    """The statement with the expressions that it and they name, in order."""
    names: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if re.search(rf"(?<![\w.']){name}\b(?!\s*\()", text) and name not in names:
                need_of = CTES[name]
                seen.append(name)
                if seen.count(name) < 2:
                    need(need_of)
                if name not in names:
                    names.append(name)

    seen: list[str] = []
    need(body)
    if not names:
        return body
    body = body.strip()
    head = "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTES[n]})" for n in names)
    return f"{head}, {body[5:]}" if body.upper().startswith("WITH ") else f"{head} {body}"
