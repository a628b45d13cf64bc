"""Round trips of the binary formats against numpy, and a synthetic network package."""

import logging
import struct
import zipfile

import numpy as np
import pytest

from odweave import log
from odweave.sources import matrix_files as m
from odweave.sources import omx, packages


def cells(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame([(10, 10, 1.5), (10, 30, 2.0), (20, 10, 3.25)], "o int, d int, value double")


def test_mdf(spark, tmp_path, matrix):
    path = str(tmp_path / "a.mdf")
    m.to_mdf(matrix, path)
    raw = np.fromfile(path, "<f4", offset=24 + 24)
    assert raw.tolist() == [1.5, 0, 2, 3.25, 0, 0, 0, 0, 0]  # Q31: the union of labels on both axes
    out = cells(m.read_mdf(spark, path))
    assert out[10, 30] == 2.0 and out[30, 20] == 0 and len(out) == 9
    assert [r["zone"] for r in m.peek_mdf(spark, path).where("dim = 1").orderBy("position").collect()] == [10, 20, 30]
    (tmp_path / "bad.mdf").write_bytes(struct.pack("<4I", 1, 2, 3, 4))
    with pytest.raises(OSError):
        m.peek_mdf(spark, str(tmp_path / "bad.mdf"))
    (tmp_path / "v.mdf").write_bytes(struct.pack("<5I", m.MAGIC, 1, 2, 1, 2) + np.array([7, 8], "<i4").tobytes() + np.array([1.0, 2.0]).tobytes())
    assert [tuple(r) for r in m.read_mdf(spark, str(tmp_path / "v.mdf")).collect()] == [(7, 1.0), (8, 2.0)]


def test_emx(spark, tmp_path, matrix):
    path = str(tmp_path / "a.emx")
    m.to_emx(matrix, path, 4)
    assert np.fromfile(path, "<f4").reshape(4, 4)[0].tolist() == [1.5, 0, 2, 0]
    assert len(cells(m.read_emx(spark, path, zones=2))) == 4
    assert cells(m.read_emx(spark, path, zones=[10, 20, 30]))[20, 10] == 3.25
    np.arange(5, dtype="<f4").tofile(tmp_path / "odd.emx")
    with pytest.raises(Exception, match="square"):
        m.read_emx(spark, str(tmp_path / "odd.emx")).collect()


def test_fortran(spark, tmp_path, matrix):
    path = str(tmp_path / "a.bin")
    m.to_fortran(matrix, path, min_index=5)  # Q29
    rec = np.fromfile(path, np.dtype([("i", "<i4"), ("v", "<f4", 3)]))
    assert rec["i"].tolist() == [5, 6, 7] and rec["v"][0].tolist() == [1.5, 0, 2]
    assert cells(m.read_fortran_square(spark, path, zones=[10, 20, 30]))[10, 30] == 2.0  # Q30: stored numbers ignored
    m.to_fortran(matrix, path, force_square=False, n_columns=4)
    out = cells(m.read_fortran_rectangle(spark, path, 4))
    assert out[0, 1] == 2.0 and out[1, 0] == 3.25 and len(out) == 8
    assert len(cells(m.read_fortran_rectangle(spark, path, 4, reindex_rows=True, fill_value=0))) == 16


STAND_IN = """
import numpy as np

class File:
    def __init__(self, path, mode, title=""):
        self.path, self.mode, self.arrays, self.maps, self.titles = path, mode, {}, {}, {"": title}
        if mode == "r":
            with np.load(path) as z:
                for k in z.files:
                    (self.maps if k.startswith("map_") else self.arrays)[k[4:]] = z[k]
    def __enter__(self): return self
    def __exit__(self, *a):
        if self.mode == "w":
            with open(self.path, "wb") as f:
                np.savez(f, **{f"mat_{k}": v for k, v in self.arrays.items()}, **{f"map_{k}": v for k, v in self.maps.items()})
    def list_matrices(self): return list(self.arrays)
    def shape(self): return next(iter(self.arrays.values())).shape
    def map_entries(self, name): return self.maps[name].tolist()
    def create_mapping(self, name, labels): self.maps[name] = np.array(labels)
    def create_matrix(self, name, obj=None, **kw):
        self.arrays[name], self.titles[name] = obj, kw.get("title")
        return self.arrays[name]
    def __getitem__(self, name): return self.arrays[name]

open_file = File
"""


def test_omx(spark, tmp_path, monkeypatch):
    """With a stand-in of the optional package, which workers get as a file."""
    import sys

    one = spark.createDataFrame([(7, 7, 1.0), (7, 3, 2.0), (3, 7, None)], "o int, d int, value double")
    two = one.withColumn("value", one["value"] * 10)
    path = str(tmp_path / "a.omx")
    if "openmatrix" not in sys.modules:
        with pytest.raises(NotImplementedError):
            omx.read_omx(spark, "x.omx")
    (tmp_path / "openmatrix.py").write_text(STAND_IN)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "openmatrix.py"))
    omx.to_omx(path, {"m10": one, "m9": two}, title="t", descriptions={"m9": "ten times"})
    got = omx.read_omx(spark, path, mapping="zone_numbers").collect()
    assert {(r["matrix"], r["o"], r["d"]): r["value"] for r in got} == {(m, o, d): k * {(7, 7): 1.0, (7, 3): 2.0}.get((o, d), 0) for m, k in (("m10", 1), ("m9", 10)) for o in (3, 7) for d in (3, 7)}
    assert {(r["matrix"], r["o"]) for r in omx.read_omx(spark, path, tables=["m9"]).collect()} == {("m9", 0), ("m9", 1)}
    twice = spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0)], "o int, d int, value double")
    for bad in ({"a": twice}, {}, {"a": one, "b": spark.createDataFrame([(1, 1, 1.0)], one.schema)}):
        with pytest.raises(ValueError):
            omx.check_collection(bad)


@pytest.fixture(scope="module")
def package(tmp_path_factory):
    path = tmp_path_factory.mktemp("nwp") / "net.nwp"
    members = {
        "base.211": "c comment\nt nodes\nc Node X-coord Y-coord Data1 Data2 Data3 Label\na* 1 0.5 1.5 0 0 0 zone\na 2 2 3 0 0 0 n2\n\nt links\nc From To Length Modes Typ Lan VDF Data1 Data2 Data3\na 1 2 1k5 abc 1 2 90 0 0 12m\na 2 1 2.5 b 1 2 90 0 0 0\nm 2 1 2.5 b 1 2 90 0 0 0\n",
        "exatts.241": "name, type, description\n'@stn1', NODE, 'a, b'\n",
        "exatt_links.241": "inode, jnode, @post\n1, 2, 5\n2, 1, 0\n",
        "exatt_nodes.241": "inode, @a, @b\n1, 2, 3\n",
        "exatt_transit_lines.241": "line, @x\n'T1a ', 4\n",
        "link_results.csv": "i,j,volume\n1,2,10.5\n2,1,4\n",
        "transit.221": "c x\nt lines\na 'T01a' b 1 5.0 20 'Main street line' 0 1 2\npath=no\n 1 dwt=+0.1 ttf=1 us1=1 us2=0 us3=0\n 2 dwt=0.2 ttf=1 us1=2 us2=0 us3=0\n 1 dwt=0.2 ttf=1 us1=2 us2=0 us3=0\n 2\n",
        "segment_results.csv": "line,i,j,loop,transit_boardings,transit_volume\nT01a,1,2,1,5,5\nT01a,2,1,1,1,4\n",
        "aux_transit_results.csv": "i,j,v\n1,2,1.23456\n2,1,2\n9,2,4\n",
        "vehicles.202": "c\nt vehicles\nc id description mode fleet_size seated_capacity total_capacity cost_time_coeff cost_distance_coeff energy_time_coeff energy_distance_coeff auto_equivalent\na 1 'Big bus' b 9 40 60 0 0 0 0 2.5\n",
    }
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return str(path)


def test_network_package(spark, package):
    nodes, links = packages.base_network(spark, package)
    assert [(r["node"], r["x"], r["label"], r["is_centroid"]) for r in nodes.orderBy("node").collect()] == [(1, 0.5, "zone", True), (2, 2.0, "n2", False)]
    assert [(r["inode"], r["jnode"], r["length"], r["type"], r["data3"]) for r in links.orderBy("inode").collect()] == [(1, 2, 1500.0, 1, 0.012), (2, 1, 2.5, 1, 0.0)]
    assert packages.attribute_list(spark, package).first()["description"] == "a, b"
    assert packages.node_attributes(spark, package, ["b"]).columns == ["inode", "@b"]
    assert packages.line_attributes(spark, package).first()["line"] == "T1a"
    assert [tuple(r) for r in packages.traffic_results_at_countpost(spark, package, "post").collect()] == [(1, 2, 10.5)]
    lines, segments = packages.transit_network(spark, package, parse_line_id=True)
    r = lines.first()
    assert (r["line"], r["operator"], r["route"], r["description"], r["headway"], r["data3"]) == ("T01a", "T", "1", "Main street line", 5.0, 2.0)
    got = [(r["inode"], r["jnode"], r["seg_seq"], r["loop"], r["dwt"], r["ttf"]) for r in segments.orderBy("seg_seq").collect()]
    assert got == [(1, 2, 1, 1, "+0.1", 1), (2, 1, 2, 1, "0.2", 1), (1, 2, 3, 2, "0.2", 1)]
    seg = [(r["boardings"], r["alightings"], r["volume"]) for r in packages.transit_segment_results(spark, package).orderBy("seg_seq").collect()]
    assert seg == [(5.0, 0.0, 5.0), (1.0, 2.0, 4.0), (0.0, 4.0, 0.0)]  # Q35: misses are 0
    assert [tuple(r) for r in packages.transit_station_results(spark, package, [2, 1]).orderBy("stn_node").collect()] == [(1, 2.0, 1.235), (2, 5.235, 2.0)]
    assert packages.transit_result_summary(spark, package).count() == 2  # Q34
    assert packages.transit_result_summary(spark, package, parse_line_id=True).first()["total_volume"] == 9.0
    v = packages.transit_vehicles(spark, package).first()
    assert (v["veh_id"], v["description"], v["auto_equivalent"]) == (1, "Big bus", 2.5)


def test_several_packages_stay_apart(spark, package, tmp_path):
    one = zipfile.ZipFile(package)
    members = {n: one.read(n).decode() for n in one.namelist()}
    shift = lambda body: body.replace(" 1 dwt", " 11 dwt").replace(" 2 dwt", " 12 dwt").replace(" 2\n", " 12\n")
    other = members | {
        "transit.221": shift(members["transit.221"]),
        "segment_results.csv": "loop,line,i,j,transit_volume,transit_boardings\n1,T01a,11,12,7,8\n",
        "exatt_nodes.241": "@b, inode\n7, 1\n",
        "exatt_links.241": "@post, inode, jnode\n0, 1, 2\n1, 2, 1\n",
    }
    for name, body in (("a", members), ("b", other)):
        with zipfile.ZipFile(tmp_path / f"{name}.nwp", "w") as z:
            for n, text in body.items():
                z.writestr(n, text)
    both = str(tmp_path / "*.nwp")
    name = lambda p: p[-5]
    pairs = [(name(r["path"]), r["inode"], r["jnode"], r["loop"]) for r in packages.transit_network(spark, both)[1].orderBy("path", "seg_seq").collect()]
    assert pairs == [("a", 1, 2, 1), ("a", 2, 1, 1), ("a", 1, 2, 2), ("b", 11, 12, 1), ("b", 12, 11, 1), ("b", 11, 12, 2)]
    said = []
    got = packages.transit_segment_results(spark, [str(tmp_path / "a.nwp"), str(tmp_path / "b.nwp")], report=said.append).orderBy("path", "seg_seq").collect()
    assert [(name(r["path"]), r["boardings"], r["alightings"], r["volume"]) for r in got] == [("a", 5, 0, 5), ("a", 1, 2, 4), ("a", 0, 4, 0), ("b", 8, 1, 7), ("b", 0, 7, 0), ("b", 0, 0, 0)]
    assert said == ["3 segments without results are set to 0"]
    rows = packages.node_attributes(spark, both).orderBy("path").collect()
    assert [(name(r["path"]), r["inode"], r["@a"], r["@b"]) for r in rows] == [("a", 1, 2.0, 3.0), ("b", 1, None, 7.0)]
    assert [(name(r["path"]), r["inode"]) for r in packages.traffic_results_at_countpost(spark, both, "@post").orderBy("path").collect()] == [("a", 1), ("b", 2)]
    assert [(name(r["path"]), r["stn_node"]) for r in packages.transit_station_results(spark, both, [2]).orderBy("path").collect()] == [("a", 2), ("b", 2)]
    packages.base_network(spark, both, report=said.append)
    assert said[1:] == ["2 modification records of links left out"]
    assert packages.base_network(spark, both, keep_path=False)[0].columns[0] == "node"


def test_csv_options(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.nwp", "w") as z:
        z.writestr("exatt_nodes.241", "made by hand\ninode; @a; @n\n1; -9; |x;y| # odd\n".encode("latin-1"))
        z.writestr("base.211", "t nodes\na 1 2 3\n")
    r = packages.node_attributes(spark, str(tmp_path / "x.nwp"), sep=";", quote="|", skip_rows=1, comment="#", na_values=("-9",), encoding="latin-1").first()
    assert (r["inode"], r["@a"], r["@n"]) == (1, None, None)
    with pytest.raises(Exception, match="no member"):
        packages.line_attributes(spark, str(tmp_path / "x.nwp"), "x").collect()
    with pytest.raises(Exception, match="no header"):
        packages.base_network(spark, str(tmp_path / "x.nwp"))[0].collect()


def test_shared_folder_without_a_preset(tmp_path):
    """A local session may lack spark.checkpoint.dir; a cluster may not."""
    import os
    import subprocess
    import sys

    code = """
from odweave import session
spark = session.local_session(2, **{"spark.ui.enabled": "false"})
assert not spark.conf.get("spark.checkpoint.dir", None)
with session.scratch(spark):
    path = session.shared_dir(spark)
    spark.range(5).write.parquet(path)
    assert spark.read.parquet(path).count() == 5
    session.write_bytes(spark, path + "/x", b"abc")
import os
assert not os.path.exists(path.removeprefix("file://"))
class Far:
    conf = spark.conf
    class sparkContext:
        master = "spark://far:7077"
try:
    session.shared_dir(Far)
except RuntimeError as e:
    print("raised", e)
"""
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}, capture_output=True, text=True, timeout=300)
    assert "raised set spark.checkpoint.dir" in done.stdout, done.stderr[-2000:]


def test_logging(tmp_path):
    logger = log.init_root("model", style=log.JSON)
    with pytest.raises(RuntimeError), log.log_to_file(str(tmp_path / "a.log"), "model") as own:
        own.report("built %d", 3)
        own.tip("hint")
        raise RuntimeError("stop")
    body = (tmp_path / "a.log").read_text()
    assert "REPORT model: built 3" in body and "RuntimeError: stop" in body
    record = logging.makeLogRecord({"name": "x", "msg": "hi", "levelno": log.TIP, "levelname": "TIP"})
    logger.log_json(log.JsonFormatter().format(record))
    logger.load_failure("tool")
    assert logger.flush_load_failures() == ["tool"]


def test_writers_make_the_matrix_once(spark, tmp_path, matrix):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = matrix.mapInArrow(count, matrix.schema)
    m.to_mdf(counted, str(tmp_path / "a.mdf"))
    m.to_emx(counted, str(tmp_path / "a.emx"), 4)
    m.to_fortran(counted, str(tmp_path / "a.bin"))
    m.to_fortran(counted, str(tmp_path / "b.bin"), force_square=False)
    assert seen.value == 4 * 3
