"""Road maps: elements from splits of any size, what tags mean, and turns by hand."""

import pytest

from trackmill.operators import road_import as I
from trackmill.sources import road_map as M

MAP = """<?xml version='1.0' encoding='UTF-8'?>
<osm version="0.6">
 <bounds minlat="48.0" minlon="11.0" maxlat="48.2" maxlon="11.2"/>
 <!-- streets > and places -->
 <node id="1" lat="48.0" lon="11.0"/><node id='2' lat='48.001' lon='11.0'><tag k="name" v="a &lt;node id='9'/&gt; &amp; &#233;&#x1F600; x=&quot;1&quot;"/></node>
 <node id="3" lat="48.002" lon="11.0" /><node id="4" lat="48.001" lon="11.001"/><node id="5" lat="48.00000001" lon="11.5"></node>
 <changeset id="7"><tag k="stray" v="1"/></changeset>
 <way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/><tag k="note" v=" two
lines > one "/></way>
 <way id="11"><nd ref="2"/><nd ref="4"/><tag k="highway" v='service'/></way><way id="12"/>
 <relation id="20"><member type="way" ref="10" role="from"/><member type="node" ref="2" role="via"/><member type="way" ref="11" role="to"/><tag k="type" v="restriction"/></relation>
</osm>
"""


@pytest.fixture
def splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield to
    for n, v in before.items():
        spark.conf.set(n, v)


def listed(spark, path):
    return sorted(map(repr, M.elements(spark, str(path)).collect()))


def test_elements_do_not_depend_on_splits(spark, splits, tmp_path):
    (tmp_path / "m.osm").write_text(MAP)
    (tmp_path / "empty.osm").write_text("")
    whole = listed(spark, tmp_path)
    rows = {(r["kind"], r["id"]): r for r in M.elements(spark, str(tmp_path)).collect()}
    assert sorted(k for k in rows if k[0] != "bounds") == [("node", i) for i in range(1, 6)] + [("relation", 20), ("way", 10), ("way", 11), ("way", 12)]
    assert rows["node", 2]["tags"] == {"name": "a <node id='9'/> & é😀 x=\"1\""}
    assert rows["node", 1]["valid"] and not rows["node", 5]["valid"]
    assert rows["way", 10]["refs"] == [1, 2, 3] and rows["way", 10]["tags"]["note"] == " two lines > one " and rows["way", 12]["refs"] == []
    assert rows["bounds", None]["bounds"].asDict() == {"south": 480000000, "west": 110000000, "north": 482000000, "east": 112000000}
    for size in (37, 211):
        splits(size)
        assert listed(spark, tmp_path) == whole


@pytest.mark.parametrize("text", ["<!DOCTYPE osm><osm/>", '<osm><!ENTITY a "b"></osm>', "<osm><![CDATA[<node id='1'/>]]></osm>", "<osm><!-- <node id='1'/> --></osm>", '<osm version="0.5"/>', "<osm><node id=1/></osm>", "<osm><node id='1'></osm><tag k='a' v='&nbsp;'/>", "<osm><way id='1'><nd ref='2'></osm>"])
def test_what_is_refused(spark, tmp_path, text):
    (tmp_path / "m.osm").write_text(text)
    with pytest.raises(Exception):
        M.elements(spark, str(tmp_path)).collect()


def test_classified(spark):
    cases = [
        ({"highway": "residential"}, [1, 2], None, True, True), ({}, [1, 2], "unsupported_highway", None, None), ({"highway": "footway", "area": "yes"}, [1, 2], "unsupported_highway", None, None),
        ({"highway": "service", "area": "yes"}, [1, 2], "area", None, None), ({"highway": "service", "proposed": "x"}, [1, 2], "construction", None, None), ({"highway": "service", "route": "ferry"}, [1, 2], "ferry", None, None),
        ({"highway": "service", "access:conditional": "no"}, [1, 2], "conditional_access", None, None), ({"highway": "service", "access": "private", "motorcar": "yes"}, [1, 2], None, True, True),
        ({"highway": "service", "access": "private"}, [1, 2], "denied_or_limited_access", None, None), ({"highway": "service", "vehicle": "maybe"}, [1, 2], "unknown_access", None, None), ({"highway": "service"}, [1], "insufficient_geometry", None, None),
        ({"highway": "service", "oneway": "yes"}, [1, 2], None, True, False), ({"highway": "service", "oneway": "-1"}, [1, 2], None, False, True), ({"highway": "motorway"}, [1, 2], None, True, False), ({"highway": "motorway", "oneway": "no"}, [1, 2], None, True, True),
        ({"highway": "service", "junction": "roundabout"}, [1, 2], None, True, False), ({"highway": "service", "oneway": "reversible"}, [1, 2], "unknown_oneway", None, None), ({"highway": "service", "access:forward": "no"}, [1, 2], None, False, True),
        ({"highway": "service", "access:backward": "perhaps"}, [1, 2], "unknown_directional_access", None, None), ({"highway": "service", "oneway": "yes", "vehicle:forward": "no"}, [1, 2], "no_allowed_direction", None, None), ({"highway": "service", "layer": "x"}, [1, 2], "unknown_layer", None, None), ({"highway": "service", "layer": "-1"}, [1, 2], None, True, True),
    ]
    rows = [(i, refs, tags) for i, (tags, refs, *_) in enumerate(cases)]
    got = {r["way"]: r for r in I.classified(spark.createDataFrame(rows, "way long, refs array<long>, tags map<string,string>")).collect()}
    for i, (_, _, reason, forward, reverse) in enumerate(cases):
        assert got[i]["excluded"] == reason, cases[i]
        if reason is None:
            assert (got[i]["forward"], got[i]["reverse"]) == (forward, reverse), cases[i]


def test_turns(spark):
    """Way 1 leads into node 5, from which ways 2 and 3 lead on; way 9 meets nothing there."""
    arcs = spark.createDataFrame([("a", 1, 4, 5), ("b", 2, 5, 6), ("c", 3, 5, 7), ("d", 9, 8, 9)], "arc_id string, way long, from_node long, to_node long")
    ways = spark.createDataFrame([(1,), (2,), (3,), (9,)], "way long")

    def relation(i, to, value, via=(("node", 5, "via"),), source=1, **more):
        return i, [("way", source, "from"), *via, ("way", to, "to")], {"type": "restriction", "restriction": value} | more

    rows = [
        relation(1, 2, "no_left_turn"), relation(2, 2, "only_left_turn"), relation(3, 9, "no_left_turn"), relation(4, 9, "only_left_turn"), relation(5, 2, "maybe"), relation(6, 77, "no_left_turn"),
        relation(7, 2, "no_left_turn", **{"except": "bus"}), relation(8, 2, "no_left_turn", via=(("way", 3, "via"),)), relation(9, 2, "no_left_turn", via=()), relation(10, 2, "no_left_turn", **{"type": "route"}), relation(11, 2, "no_left_turn", **{"a:conditional": "x"}),
    ]
    relations = spark.createDataFrame(rows, "relation long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>")
    rules, final = I.turn_rules(arcs, I.restrictions(relations, ways))
    reading = {r["relation"]: (r["reading"], r["rules"]) for r in final.collect()}
    assert reading == {1: ("APPLIED_NO", 1), 2: ("APPLIED_ONLY", 1), 3: ("UNKNOWN_DISCONNECTED", 2), 4: ("UNKNOWN_DISCONNECTED", 2), 5: ("UNKNOWN_VALUE", 2), 6: ("INACTIVE_SOURCE_EXCLUDED", 0), 7: ("UNKNOWN_EXCEPT", 2), 8: ("UNKNOWN_VIA_WAY", 2), 9: ("UNKNOWN_MALFORMED", 2), 11: ("UNKNOWN_CONDITIONAL", 2)}
    found = {(r["relation"], r["from_arc"], r["to_arc"], r["state"]) for r in rules.collect()}
    both = {(i, "a", x, "UNKNOWN_RESTRICTION") for i in (3, 4, 5, 7, 8, 9, 11) for x in "bc"}
    assert found == {(1, "a", "b", "FORBIDDEN"), (2, "a", "c", "FORBIDDEN")} | both


def test_imported(spark, tmp_path):
    (tmp_path / "m.osm").write_text(MAP.replace("48.00000001", "48.0"))
    got = I.imported(M.elements(spark, str(tmp_path / "m.osm")))
    arcs = {(r["way"], r["from_node"], r["to_node"]) for r in got["arcs"].collect()}
    assert arcs == {(10, 1, 2), (10, 2, 1), (10, 2, 3), (10, 3, 2), (11, 2, 4), (11, 4, 2)}
    assert got["statistics"].first()["included_ways"] == 2 and {r["excluded"] for r in got["excluded"].collect()} == {"unsupported_highway"}
    (tmp_path / "n.osm").write_text(MAP)
    with pytest.raises(ValueError):
        I.imported(M.elements(spark, str(tmp_path / "n.osm")))
    (tmp_path / "o.osm").write_text("<osm><way id='1'><nd ref='2'/></way><node id='3' lat='1' lon='1'/></osm>")
    with pytest.raises(ValueError, match="unknown_nodes': 1"):
        I.imported(M.elements(spark, str(tmp_path / "o.osm")))


@pytest.mark.parametrize("size", [37, 211, 1 << 20])
@pytest.mark.parametrize("rows", [1, 4])
def test_tags_are_gathered_where_they_are_read(spark, splits, tmp_path, rows, size):
    (tmp_path / "m.osm").write_text(MAP)
    (tmp_path / "n.osm").write_text(MAP.replace('id="1', 'id="91').replace("id='2'", "id='92'"))
    whole = listed(spark, tmp_path)
    assert "Exchange" not in M._pieces(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    splits(size)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        assert listed(spark, tmp_path) == whole and len(whole) == 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
