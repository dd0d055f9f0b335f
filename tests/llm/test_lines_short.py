from __future__ import annotations

from tallygrid.llm import queries


def test_short_and_unspaced_lines_go(spark, tmp_path):
    han = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(60))
    near = han[:30] + chr(0x4E00 + 4999) + han[31:]
    rows = [(1, f"All rights reserved.\n{han}\n\nyes"), (2, f"all rights reserved\n{near}\n\nno"), (3, f"{han}\nYes!\n--")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: sorted(r["removed"]) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 1], 3: [0, 1]}
