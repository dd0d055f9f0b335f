from __future__ import annotations

import corpus_pipeline as cp

from tallygrid.llm.decontam import leaks
from tallygrid.llm.langid import fit_dictionaries, held_out, identify
from tallygrid.llm.lines import drop_repeated_lines
from tallygrid.llm.near_dedup import near_duplicates


def test_stages_against_their_operators(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = ({r["doc_id"]: r for r in x.collect()} for x in (docs, out))
        if name != "packing":
            assert out.columns == names and set(after) <= set(before)
        if name == "language_id":
            bad = identify(docs, fit_dictionaries(spark, docs.where(~held_out()).select("doc_id", "text", "lang"))).where("rejected").collect()
            assert set(before) - set(after) == {r["doc_id"] for r in bad} and before.keys() >= after.keys()
        elif name == "line_dedup":
            kept = {r["row"]["doc_id"]: r["kept_text"] for r in drop_repeated_lines(spark, docs).collect()}
            assert all(r["text"] == kept[i] and r["n_chars"] == len(r["text"]) for i, r in after.items())
            assert all(not kept[i].strip() for i in set(before) - set(after))
        elif name == "near_dedup":
            assert set(after) == {r["doc_id"] for r in near_duplicates(spark, docs).where("kept").collect()}
        elif name == "decontamination":
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert set(before) - set(after) == {r["doc_id"] for r in leaks(spark, docs, items).collect()}
        else:
            assert set(after) == set(before)
            assert out.groupBy().sum("n_tokens").first()[0] == sum(len(r["text"].encode().split()) + 1 for r in before.values())
        docs = out


def test_run(spark, sf):
    assert cp.run(spark, sf).columns == ["shard", "bin", "position", "doc_id", "start", "n_tokens", "used"]


def test_edge_rows_through_every_stage(spark, sf, documents, odd, nothing):
    """Null ids and texts, blank, repeated and very long rows, and clashing columns, given to each stage itself."""
    for table in (documents, odd, documents.limit(0), nothing):
        rows = [r.asDict() for r in table.collect()]
        for name, stage in cp.STAGES:
            out = stage(spark, table, sf)
            got = [r.asDict() for r in out.collect()]
            if not rows:
                assert not got, name
            if name == "packing":
                size = lambda t: len((t or "").encode().split()) + 1
                assert sum(r["n_tokens"] for r in got) == sum(size(r["text"]) for r in rows), name
                continue
            assert out.columns == table.columns, name
            rest = lambda r: tuple(v for k, v in r.items() if k not in ("text", "n_chars"))
            before = [rest(r) for r in rows]
            assert all(rest(r) in before for r in got) and len(got) <= len(rows), name
            if name != "language_id":
                unread = [r for r in rows if r["text"] is None or not r["text"].strip()]
                for r in unread:
                    assert got.count(r) == rows.count(r), (name, r)
            if name == "decontamination":
                assert len(got) == len(rows)
