"""Readers and writers on small files."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from trackmill.sources import readers as R
from trackmill.sources import recording as C
from trackmill.sources import writers as W


def test_trajectory(spark, tmp_path):
    row = ["1607.25", *["1.5"] * 6, "0", "0", "0", *["0"] * 6, "0.9", "-0.5"]
    bad = [*row[:1], "nan", *row[2:]]
    (tmp_path / "t.csv").write_text("\n".join([",".join(R.TRAJECTORY), ",".join(row), ",".join(bad)]) + "\n")
    got = R.trajectory_csv(spark, str(tmp_path / "t.csv")).orderBy(F.desc("valid")).collect()
    assert got[0]["time_ns"] == 1_607_250_000_000 and got[0]["qw"] == 1.0 and abs(got[0]["lat"] - 51.566) < 1e-3
    assert [r["valid"] for r in got] == [True, False]
    (tmp_path / "u.csv").write_text("a," + ",".join(R.TRAJECTORY[1:]) + "\n" + ",".join(row) + "\n")
    with pytest.raises(Exception):
        R.trajectory_csv(spark, str(tmp_path / "u.csv")).collect()


def test_points(spark, tmp_path):
    folder = tmp_path / "lidar"
    folder.mkdir()
    good = struct.pack("<6f", 1, 2, 3, 4, 5, -0.25)
    (folder / "1000.bin").write_bytes(good + struct.pack("<6f", float("nan"), 2, 3, 4, 5, 0) + struct.pack("<6f", 1, 2, 3, 4, 5.5, 0))
    (folder / "2000.bin").write_bytes(good * 3)
    listed = {r["key"]: r for r in R.frame_listing(spark, str(folder)).collect()}
    assert listed["1000.bin"]["points"] == 3 and listed["2000.bin"]["time_ns"] == 2_000_000 and listed["1000.bin"]["whole"]
    points = R.point_records(spark, str(folder), bits=True)
    rows = points.filter("key = '1000.bin'").orderBy("offset").collect()
    assert [r["valid"] for r in rows] == [True, False, False] and rows[0]["relative_ns"] == -250_000_000 and rows[0]["bits"] == good
    assert {r["key"]: (r["points"], r["invalid"]) for r in R.frame_summary(points).collect()} == {"1000.bin": (3, 2), "2000.bin": (3, 0)}
    digests = R.file_digests(spark, str(folder))
    assert {r["sha256"] for r in digests.collect()} >= {hashlib.sha256(good * 3).hexdigest()}
    assert R.combined_identity(digests).first()["files"] == 2
    (folder / "3000.bin").write_bytes(good[:-1])
    with pytest.raises(Exception, match="no whole records"):
        R.point_records(spark, str(folder)).collect()


def test_calibration(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 0 0 5\n0 0 -1 6\n0 1 0 7\n0 0 0 1\n")
    (tmp_path / "b.txt").write_text("1 0 0 5\n0 0 1 6\n0 1 0 7\n0 0 0 1\n")
    assert {r["file"][-5:]: r["proper"] for r in R.calibration_text(spark, str(tmp_path)).collect()} == {"a.txt": True, "b.txt": False}


MAP = """<?xml version="1.0"?><osm>
<node id="1" lat="51.0000001" lon="-1.5"/><node id="2" lat="51.1" lon="-1.50000001"><tag k="a" v="b"/></node>
<way id="10"><nd ref="1"/><nd ref="2"/><tag k="highway" v="residential"/></way>
<relation id="20"><member type="way" ref="10" role="from"/><tag k="type" v="restriction"/></relation></osm>"""


def test_road_map(spark, tmp_path):
    (tmp_path / "m.osm").write_text(MAP)
    got = R.road_map_xml(spark, str(tmp_path / "m.osm"))
    nodes = {r["node"]: r for r in got["nodes"].collect()}
    assert nodes[1]["lat_e7"] == 510000001 and nodes[1]["valid"] and not nodes[2]["valid"]
    assert [(r["refs"], r["tags"]) for r in got["ways"].collect()] == [([1, 2], {"highway": "residential"})]
    assert got["relations"].first()["members"][0]["_role"] == "from"
    (tmp_path / "n.osm").write_text("<!DOCTYPE x>" + MAP)
    with pytest.raises(ValueError):
        R.road_map_xml(spark, str(tmp_path / "n.osm"))


def test_route_and_json(spark, tmp_path):
    (tmp_path / "r.html").write_text("<script>poly([[51.5, -1.25],\n [51.6,-1.26]])</script>")
    assert [(r["pos"], r["lat"], r["lon"]) for r in R.route_html(spark, str(tmp_path / "r.html")).orderBy("pos").collect()] == [(0, 51.5, -1.25), (1, 51.6, -1.26)]
    assert R.json_document('{"a": [1, {"b": null}]}') == {"a": [1, {"b": None}]}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "[" * 40 + "]" * 40):
        with pytest.raises(ValueError):
            R.json_document(bad)
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": oops}\n')
    with pytest.raises(Exception):
        R.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "i int, s string")
    W.index_lines(df, str(tmp_path / "idx"), ["i"], 2)
    lines = [x for p in sorted((tmp_path / "idx").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"i":1,"s":"a"}', '{"i":2}', '{"i":3,"s":"c"}']
    assert {r[0] for r in W.portable(df, ["s", "i"], []).collect()} == {'{"s":"a","i":1}', '{"s":null,"i":2}', '{"s":"c","i":3}'}
    with pytest.raises(Exception, match="local place"):
        W.portable(df.withColumn("s", F.lit("/home/x")), ["s", "i"], []).collect()
    W.publish(df, str(tmp_path / "out"))
    assert W.published(spark, str(tmp_path / "out")) and not W.published(spark, str(tmp_path / "none"))
    state = {r["stream"]: r["state"] for r in R.capabilities(df.select(F.col("s").alias("stream")), [("a", False), ("z", True), ("y", False)]).collect()}
    assert state == {"a": "AVAILABLE", "z": "MISSING_OPTIONAL", "y": "MISSING_REQUIRED"}


def test_recording(spark, tmp_path):
    root = tmp_path / "rec"
    for d in ("poses", "lidar", "calib"):
        (root / d).mkdir(parents=True)
    row = ["1.5", *["1.5"] * 6, "0", "0", "0", *["0"] * 6, "0.9", "-0.5"]
    (root / "poses" / "p.csv").write_text("\n".join([",".join(R.TRAJECTORY), ",".join(row), ",".join(["2.5", *row[1:]])]) + "\n")
    good = struct.pack("<6f", 1, 2, 3, 4, 5, 0)
    for name, content in (("1500000", good), ("2500000", good * 2), ("4500000", good[:-2])):
        (root / "lidar" / f"{name}.bin").write_bytes(content)
    (root / "calib" / "c.txt").write_text("1 0 0 0 0 1 0 0 0 0 1 0 0 0 0 1")
    rec = C.Recording(spark, str(root), "rec")
    assert {r["stream"]: r["state"] for r in rec.capabilities().collect()} == {"poses": "AVAILABLE", "lidar": "AVAILABLE", "calib": "AVAILABLE", "lidar_poses": "MISSING_OPTIONAL"}
    got = C.index_recording(rec, str(tmp_path / "out"))
    assert [r["time_ns"] for r in got["index"].collect()] == [1_500_000_000, 2_500_000_000, 4_500_000_000]
    assert {(r["kind"], r["key"]) for r in got["findings"].collect()} == {("TRUNCATED_FRAME", "4500000.bin")}
    assert {r["stream"]: (r["n"], r["first_ns"], r["invalid"]) for r in got["ranges"].collect()} == {"poses": (2, 1_500_000_000, 0), "lidar": (3, 1_500_000_000, 1)}
    with pytest.raises(Exception):
        C.index_recording(rec, str(tmp_path / "out"))
    met = C.exact_matches(rec.frames(), rec.poses().select("time_ns", "x")).orderBy("time_ns").collect()
    assert [r["pose_x"] for r in met] == [1.5, 1.5, None]
    before = rec.all_files().cache()
    before.count()
    (root / "lidar" / "5500000.bin").write_bytes(good)
    assert [(r["key"], r["change"]) for r in C.snapshot_changes(before, rec.all_files()).collect()] == [("5500000.bin", "after")]
    moved = C.anchored(rec.poses().withColumn("seq", F.lit(1)), "seq", ["time_ns"], ["x"]).collect()
    assert {r["x"] for r in moved} == {0.0}


def test_finding_cap(spark):
    frames = spark.createDataFrame([(f"{i:03}.bin", i, 0, 0, False) for i in range(7)], "key string, time_ns long, bytes long, points long, whole boolean")
    got = C.structural_findings(frames, 3).orderBy("key").collect()
    assert [(r["key"], r["overflow"], r["left_out"]) for r in got] == [("000.bin", False, 0), ("001.bin", False, 0), ("002.bin", False, 0), ("003.bin", True, 4)]
