"""Files written and read back, XML, and registered queries against DuckDB."""

import io

import duckdb
import numpy as np
import pytest
from conftest import SCHEMA, walk
from pyspark.sql import functions as F

from vesselspark import catalog
from vesselspark.sources import settings as st, swc, tables as tb

SF = "/root/testdata/sf0.001"


def test_swc_round_trip(spark, tmp_path):
    p = spark.createDataFrame(walk(1, 12) + walk(2, 7, trace_id=1) + walk(3, 2, trace_id=2), SCHEMA)
    swc.write_swc(p, str(tmp_path / "out"))
    back = swc.to_traces(swc.read_written(spark, str(tmp_path / "out")))
    got = sorted((r.trace_id, r.seq, r.x) for r in back.collect())
    assert got == sorted((r.trace_id, r.seq, r.x) for r in p.where("trace_id < 2").collect())


def test_settings_xml(spark, tmp_path):
    (tmp_path / "c7.xml").write_text(
        "<Set><CROP><item0>1</item0><item1>2</item1><item2>30</item2><item3>40</item3></CROP>"
        "<Landmark><Point><location>1.0,2.0,3.5</location><type>5</type></Point><Point><location>4,5,6</location><type>13</type></Point></Landmark>"
        "<SeqRTM><Seq><Seqname>T1</Seqname>" + "".join(f"<R{i}>{i}</R{i}>" for i in range(1, 10)) + "<T1>7</T1><T2>8</T2><T3>9</T3></Seq></SeqRTM>"
        "<Resolution><Res>0.5</Res></Resolution><VWSeg><Seg><Snakeid>3</Snakeid><Start>1</Start><End>4</End><vwids>1:20,2:21</vwids><QVSPath>a</QVSPath></Seg></VWSeg></Set>"
    )
    (tmp_path / "c8.xml").write_text("<Set><Resolution><Res>0.4</Res></Resolution></Set>")
    path = str(tmp_path)
    s = {r.case_id: (r.x_min, r.x_max, r.res) for r in st.scan_settings(spark, path, "Set").collect()}
    assert s == {"c7": (1, 30, 0.5), "c8": (0, -1, 0.4)}
    lm = st.scan_landmarks(spark, path, ignore_outer=True).collect()
    assert [(r.case_id, r.lm_type, r.z) for r in lm] == [("c7", 5, 3.5)]
    assert st.wall_segments(spark, path, "Set").first().slice_no == 20
    cases = st.scan_settings(spark, path, "Set")
    t = st.transform_for(cases, st.scan_transforms(spark, path, "Set"), "T1", strict=False).orderBy("case_id").collect()
    assert (t[0].r12, t[0].t3, t[1].r11, t[1].t3) == (2, 9, 1, 0)
    with pytest.raises(Exception, match="no sequence"):
        st.transform_for(cases, st.scan_transforms(spark, path, "Set"), "T1").collect()


def test_contour_xml(spark, tmp_path):
    pts = "".join(f'<Point x="{x}" y="{y}"/>' for x, y in ((0, 0), (0, 0), (256, 0), (256, 256)))
    (tmp_path / "q.xml").write_text(
        f'<R><QVAS_Image ImageName="E1S101I4"><QVAS_Contour><ContourType>Lumen</ContourType><Contour_Point>{pts}</Contour_Point></QVAS_Contour></QVAS_Image></R>'
    )
    rows = st.scan_contours(spark, str(tmp_path), 128).orderBy("seq").collect()
    assert [(r.slice_no, r.px, r.py) for r in rows] == [(4, 0, 0), (4, 64, 0), (4, 64, 64)]


def test_npy_volume(spark, tmp_path):
    vol = np.zeros((3, 4, 2))
    vol[1, 2, 0], vol[2, 3, 1] = 5, 7
    buf = io.BytesIO()
    np.save(buf, vol)
    (tmp_path / "k1.npy").write_bytes(buf.getvalue())
    got = sorted(tuple(r) for r in tb.scan_volume_npy(spark, str(tmp_path)).collect())
    assert got == [("k1", 1, 2, 0, 5.0), ("k1", 2, 3, 1, 7.0)]


def test_curves_and_pairs(spark, tmp_path):
    (tmp_path / "e1").mkdir()
    (tmp_path / "e1" / "roc.csv").write_text("fp_rate,tp_rate,threshold\n0,0,1\n1,1,0\n")
    names = spark.createDataFrame([("e1", "plain")], "experiment string, model string")
    assert [r.model for r in tb.scan_curves(spark, str(tmp_path / "*"), names).collect()] == ["plain", "plain"]
    a = spark.createDataFrame([("a",), ("b",)], "case_id string")
    pairs = tb.check_pairs(a, a.where("case_id = 'a'"))
    with pytest.raises(Exception, match="incomplete case b"):
        tb.require_pairs(pairs).collect()


def test_notes(spark, tmp_path):
    (tmp_path / "n.txt").write_text("1.0\t2.0\t3.0\tplaque\tA\n")
    r = swc.scan_notes(spark, str(tmp_path)).first()
    assert (r.case_id, r.note, r.cat) == ("n", "plaque", "A")


SOME = ["trace_features", "feature_pivot", "resample", "self_loop", "nearest_point", "swc_lines", "dice_per_class", "box_nms", "standardise", "simplified_graph", "stream_metrics"]


@pytest.mark.parametrize("name", SOME)
def test_queries_match_sql(spark, name):
    catalog.load()
    con = duckdb.connect()
    for t in ("lineitem", "part", "events", "documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    rel = con.execute(catalog.ORACLE[name])
    cols = sorted(d[0] for d in rel.description)
    assert sorted(df.columns) == cols
    place = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted(str(tuple(r[i] for i in place)) for r in rel.fetchall())
    got = sorted(str(tuple(r)) for r in df.select(*[F.col(f"`{c}`") for c in cols]).collect())
    assert got == want


def test_manifest_lines_make_one_document(spark, tmp_path):
    import json

    from vesselspark.sources import tables as tb

    rows = [(i, "training" if i % 3 else "test", f"im{i}.nii") for i in range(40)]
    entries = spark.createDataFrame(rows, "id long, split string, image string").repartition(5)
    tb.write_manifest(tb.manifest(entries, "cohort", {0: "background"}), str(tmp_path / "list"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "list").glob("part-*")))
    doc = json.loads(text)
    assert doc["numTest"] == 14 and doc["numTraining"] == 26 and doc["numValidation"] == 0 and doc["labels"] == {"0": "background"}
    assert doc["training"] == [{"image": f"im{i}.nii"} for i in range(40) if i % 3] and doc["validation"] == []
    back = tb.scan_datalist(spark, str(tmp_path / "list"))
    assert back.count() == 40
