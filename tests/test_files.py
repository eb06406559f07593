"""Readers and writers."""

import io
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from spanforge.sources import files as S


def workbook(rows):
    shared = sorted({v for r in rows for v in r if isinstance(v, str)})
    head = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda r, c, v: f'<c r="{"ABCDEFG"[c]}{r + 1}"' + (f' t="s"><v>{shared.index(v)}</v></c>' if isinstance(v, str) else f"><v>{v}</v></c>")
    body = "".join(f"<row>{''.join(cell(i, j, v) for j, v in enumerate(r) if v is not None)}</row>" for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {head} {rel}><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {head}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {head}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook_cells(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["SKU", None, "Spec"], ["x1", 2.5, "8in"]]))
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    got = S.read_cells(spark, str(tmp_path)).collect()
    good = {(r.row_no, r.col_no): r.value for r in got if r.error is None}
    assert good == {(1, 1): "SKU", (1, 3): "Spec", (2, 1): "x1", (2, 2): "2.5", (2, 3): "8in"}
    assert [r.error for r in got if r.error] == ["BadZipFile"]


def test_depth_and_clouds(spark, tmp_path):
    depth = np.arange(6, dtype=np.float32).reshape(2, 3)
    np.save(tmp_path / "d.npy", depth)
    got = {(r.row, r.col): r.depth for r in S.read_depth(spark, str(tmp_path)).collect()}
    assert got == {(r, c): float(depth[r, c]) for r in range(2) for c in range(3)}
    pts = spark.createDataFrame([(1, 0.5, 1.0, 2.0, 1, 2, 3), (0, 0.25, 1.5, 2.5, 4, 5, 6)], "ord long, x double, y double, z double, r int, g int, b int")
    S.write_ply(pts, f"{tmp_path}/ply")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "ply").glob("part-*"))).splitlines()
    assert lines[:3] == ["ply", "format ascii 1.0", "element vertex 2"] and lines[-2].startswith("0.25")
    (tmp_path / "c.ply").write_text("\n".join(lines))
    back = S.read_ply(spark, f"{tmp_path}/c.ply").orderBy("ord").collect()
    assert [(r.x, r.y, r.z, r.r) for r in back] == [(0.25, 1.5, 2.5, 4), (0.5, 1.0, 2.0, 1)]
    camera = S.fake_camera(spark, 4, 5, 1.25)
    assert camera.count() == 20 and camera.agg(F.max("row"), F.max("col")).first()[:] == (3, 4)


def test_records_and_failures(spark, tmp_path):
    for name, text in (("j1", json.dumps({"status": "ok", "size": 2.5}, indent=2)), ("j2", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "geometry.json").write_text(text)
    records = S.read_records(spark, f"{tmp_path}/*/geometry.json", "status string, size double").cache()
    jobs = spark.createDataFrame([("j1",), ("j2",), ("j3",)], "job_id string")
    got = {r.job_id: r.failure for r in S.failures(records, jobs, "geometry.json").collect()}
    assert got == {"j1": None, "j2": "geometry.json malformed", "j3": "geometry.json missing"}
    assert {r.job_id for r in S.list_jobs(spark, str(tmp_path)).collect()} == {"j1", "j2"}


def test_tables_and_previews(spark, tmp_path):
    df = spark.createDataFrame([(1, (2.0, [1, 2]))], "b int, a struct<x:double,l:array<int>>")
    S.write_table(df, f"{tmp_path}/csv")
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*")).splitlines()
    assert text[0] == "a_l,a_x,b" and '"[1,2]"' in text[1]
    px = spark.createDataFrame([(1, float(i)) for i in range(101)], "view int, depth double")
    levels = {r.depth: r.level for r in S.depth_preview(px, ["view"]).collect()}
    assert levels[0.0] == 0 and levels[100.0] == 255 and levels[51.0] in (126, 127, 128)
    raw = spark.createDataFrame([(1, 0, 0, 1.0)], "view int, row int, col int, depth double")
    assert S.capture_errors(raw, raw, ["view"]).first().error == "raw_and_aligned_identical"
    assert S.capture_errors(raw, raw.withColumn("depth", F.lit(2.0)), ["view"]).first().error is None
    assert S.public_columns(df.withColumn("_runtime_x", F.lit(1))).columns == ["b", "a"]
