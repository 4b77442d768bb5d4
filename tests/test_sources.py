import struct

import numpy as np
import pytest
from fluxmesh.sources import synth
from fluxmesh.sources.coils import load_coil, read_ccd, save_coils
from fluxmesh.sources import msh
from fluxmesh.sources.msh import MeshFormatError, pack_msh, parse_msh, read_msh
from fluxmesh.sources.msh_split import COLUMNS, ELEMENT, MshReader, read_msh_split, read_table
from fluxmesh.sources.results import load_result, retain, save_result
from fluxmesh.streaming import stream_summaries
from fluxmesh.subject import Subject


@pytest.fixture(scope="module")
def small():
    xyz = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 1]], float)
    return xyz, np.array([[0, 1, 2, 3], [1, 2, 3, 4]]), np.array([2, 3]), np.array([[0, 1, 2]]), np.array([1005])


def test_mesh_round_trip(spark, tmp_path, small):
    data = pack_msh(*small)
    (tmp_path / "m.msh").write_bytes(data)
    m = read_msh(spark, str(tmp_path / "m.msh"))
    assert sorted(tuple(r) for r in m["nodes"].collect()) == [(i, *x) for i, x in enumerate(small[0].tolist())]
    assert sorted(tuple(r) for r in m["tets"].collect()) == [(0, 0, 1, 2, 3, 2), (1, 1, 2, 3, 4, 3)]
    assert [tuple(r) for r in m["tris"].collect()] == [(0, 0, 1, 2, 1005)]


def blocks_msh(rng, n, tets, tris, gap=1, cut=7):
    """A mesh of many element blocks, of other types too, with node numbers ``gap`` apart in any order."""
    ids = (rng.permutation(n) + 1) * gap
    nodes = np.zeros(n, np.dtype([("id", "<i4"), ("xyz", "<f8", 3)]))
    nodes["id"], nodes["xyz"] = ids, rng.normal(size=(n, 3))
    out = [b"$MeshFormat\n2.2 1 8\n", struct.pack("<i", 1), b"\n$EndMeshFormat\n$Nodes\n%d\n" % n, nodes.tobytes(), b"\n$EndNodes\n$Elements\n"]
    body, total = [], 0
    for kind, cells in ((2, tris), (15, np.arange(3)[:, None]), (4, tets)):
        for at in range(0, len(cells), cut):
            part = ids[cells[at : at + cut]]
            rows = np.column_stack([np.arange(len(part)), np.full(len(part), 3), np.zeros(len(part)), part]).astype("<i4")
            body += [struct.pack("<3i", kind, len(part), 2), rows.tobytes()]
            total += len(part)
    return b"".join([*out, b"%d\n" % total, *body, b"\n$EndElements\n"])


@pytest.mark.parametrize("gap", [1, 3])
def test_split_reads_equal_whole_reads(spark, tmp_path, gap):
    rng = np.random.default_rng(gap)
    tets, tris = rng.integers(0, 60, (50, 4)), rng.integers(0, 60, (23, 3))
    (tmp_path / "m.msh").write_bytes(blocks_msh(rng, 60, tets, tris, gap))
    path = str(tmp_path / "m.msh")
    whole, split = read_msh(spark, path), read_msh_split(spark, path, split_rows=5)
    for t in ("nodes", "tets", "tris"):
        assert sorted(tuple(r) for r in split[t].select(whole[t].columns).collect()) == sorted(tuple(r) for r in whole[t].collect())
    table = read_table(spark, f"file://{path}", "tets", ["tag", "e"], split_rows=5)
    assert table.columns == ["tag", "e"] and sorted(r.e for r in table.collect()) == list(range(50))
    assert table.rdd.getNumPartitions() == 7 * 2 + 1  # blocks of 7, cut at 5, and one of 1
    with pytest.raises(Exception, match="no column"):
        read_table(spark, path, "tris", ["n3"]).count()


def test_split_reads_touch_their_section_once(tmp_path):
    rng = np.random.default_rng(5)
    (tmp_path / "m.msh").write_bytes(blocks_msh(rng, 60, rng.integers(0, 60, (50, 4)), rng.integers(0, 60, (23, 3))))
    size = {"nodes": 28 * 60, "tets": 28 * 50, "tris": 24 * 23}
    for table, want in size.items():
        reader = MshReader(str(tmp_path / "m.msh"), table, list(COLUMNS[table]), 5)
        width = msh.NODE.itemsize if table == "nodes" else msh.width(ELEMENT[table])
        ranges = sorted((p.offset, p.offset + p.count * width) for p in reader.partitions())
        assert sum(b - a for a, b in ranges) == want and all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:], strict=False))


def test_subject_from_a_file(spark, tmp_path):
    nodes = synth.cube_nodes(spark, 2).orderBy("node").collect()
    tets = synth.cube_tets(spark, 2).orderBy("e").collect()
    (tmp_path / "m.msh").write_bytes(pack_msh(np.array([(r.x, r.y, r.z) for r in nodes]), np.array([[r[n] for n in ("n0", "n1", "n2", "n3")] for r in tets]), np.array([r.tag for r in tets]), np.zeros((0, 3), int), np.zeros(0, int)))
    with Subject.load(spark, str(tmp_path / "m.msh")) as s, Subject.load(spark, str(tmp_path / "m.msh"), reorder=False, split=False) as t:
        one, two = ({tuple(round(v, 9) for v in (r.bx, r.by, r.bz, r.vol * 1e9)) for r in x.elements.collect()} for x in (s, t))
        assert one == two and len(one) == 48
        assert s.mesh[0].count() == 27 and s.mesh[1].count() == 48


def test_malformed_meshes_raise(small):
    data = pack_msh(*small)
    bad = [
        b"", b"$Nodes\n", data.replace(b"2.2 1 8", b"4.1 1 8"), data.replace(b"2.2 1 8", b"2.2 0 8"), data.replace(b"2.2 1 8", b"2.2 1 4"), data.replace(struct.pack("<i", 1) + b"\n$End", struct.pack(">i", 1) + b"\n$End", 1),
        data[:80], data[:-30], data.replace(b"$Nodes\n5", b"$Nodes\n9"), data.replace(b"$Elements\n3", b"$Elements\n2"), data.replace(struct.pack("<3i", 4, 2, 2), struct.pack("<3i", 99, 2, 2)),
        data.replace(struct.pack("<3i", 4, 2, 2), struct.pack("<3i", 4, 2, 3)), data.replace(struct.pack("<3i", 4, 2, 2), struct.pack("<3i", 4, 7, 2)), pack_msh(small[0], small[1][:0], small[2][:0], small[3], small[4]),
    ]
    for b in bad:
        with pytest.raises(MeshFormatError):
            parse_msh(b)


def test_coil_text_and_catalog(spark, tmp_path):
    (tmp_path / "a.ccd").write_text("# brand=Test;coilname=Synth;dIdtmax=100.0\n2\n# centre and moment\n-0.02 0 0 0 0 1\n2e-2 0 0 0 0 -1\n")
    (tmp_path / "plain.ccd").write_text("# made=by hand\n1\nheader\n0 0 0 1 0 0\n")
    coils, dipoles = read_ccd(spark, str(tmp_path / "*.ccd"))
    got = {r.coil: r for r in coils.collect()}
    assert got["Synth"].didt_max == 100e6 and got["Synth"].metadata["brand"] == "Test" and got["plain"].didt_max is None
    assert [tuple(r)[2:] for r in dipoles.where("coil = 'Synth'").orderBy("j").collect()] == [(-0.02, 0, 0, 0, 0, 1), (0.02, 0, 0, 0, 0, -1)]
    save_coils(coils, dipoles, str(tmp_path / "catalog"))
    assert load_coil(spark, str(tmp_path / "catalog"), "plain")[1].count() == 1
    with pytest.raises(ValueError):
        load_coil(spark, str(tmp_path / "catalog"), "none")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.ccd").write_text("# coilname=B\n3\nheader\n0 0 0 1 0 0\n")
    with pytest.raises(Exception, match="wrong number"):
        read_ccd(spark, str(tmp_path / "bad"))[1].collect()


def test_results_round_trip(spark, tmp_path):
    field = spark.createDataFrame([(0, 1, 1.0, 2.0, 2.0, 3.0), (1, 1, 0.0, 0.0, 1.0, 1.0)], "p int, e int, ex double, ey double, ez double, magn double")
    save_result(str(tmp_path / "r"), retain(field))
    back = load_result(spark, str(tmp_path / "r"))
    assert back["vectors"] is None and {(r.p, r.e, r.magn) for r in back["magnitude"].collect()} == {(0, 1, 3.0), (1, 1, 1.0)}
    spark.createDataFrame([(99, ["magnitude"])], "format_version int, parts array<string>").write.mode("overwrite").parquet(str(tmp_path / "r" / "_format"))
    with pytest.raises(ValueError, match="version"):
        load_result(spark, str(tmp_path / "r"))
    with pytest.raises(ValueError):
        save_result(str(tmp_path / "x"), {"odd": field})


def test_stream_equals_batch(spark, tmp_path):
    subject = Subject(synth.cube_nodes(spark, 2), synth.cube_tets(spark, 2))
    dipoles = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "j int, sx double, sy double, sz double, mx double, my double, mz double")
    schema = "p int, cx double, cy double, cz double, hx double, hy double, hz double, dist double"
    placements = spark.createDataFrame([(0, 50.0, 50.0, 101.0, 50.0, 90.0, 100.0, 4.0), (1, 30.0, 60.0, 101.0, 70.0, 60.0, 100.0, 4.0)], schema)
    placements.coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    q = stream_summaries(subject, spark.readStream.schema(schema).json(str(tmp_path / "in")), dipoles, 1e6, lambda df, i: seen.extend(df.select("p", "peak").collect()), str(tmp_path / "check"))
    q.awaitTermination()
    batch = {r.p: r.peak for r in subject.summarize(subject.simulate(placements, dipoles, 1e6, "raw")).collect()}
    assert {r.p: pytest.approx(r.peak, rel=1e-6) for r in seen} == batch
    subject.free()
