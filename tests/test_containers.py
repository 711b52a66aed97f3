"""HDF5 and MAT containers: crafted bytes, round trips, and what a read opens."""

import random
import struct
import zlib

import numpy as np
import pytest

from voxelframe.operators.trials import trial_rows
from voxelframe.sources import hdf5, mat
from voxelframe.sources.hdf5 import Container, ContainerBuilder, subject_images


def built(tmp_path, **arrays):
    builder = ContainerBuilder()
    for name, (array, chunk) in arrays.items():
        builder.add(name, array, chunk)
    path = str(tmp_path / "made.h5")
    with open(path, "wb") as f:
        f.write(builder.finish())
    return path


def message2(kind, body):
    return struct.pack("<BHB", kind, len(body), 0) + body


def header2(*messages):
    body = b"".join(messages)
    return b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"sums"


def newer(array, user_block=0, order="<"):
    """A container of the newer kind: version 2 superblock and headers, links, one contiguous dataset in a group."""
    kind = {"i": struct.pack("<BBBBIHH", 0x10, (8 if array.dtype.kind == "i" else 0) | (order == ">"), 0, 0, array.itemsize, 0, 8 * array.itemsize), "f": struct.pack("<BBBBIHHBBBBI", 0x11, 0x20 | (order == ">"), 63, 0, 8, 0, 64, 52, 11, 0, 52, 1023)}[array.dtype.kind]
    link = lambda name, at: message2(6, struct.pack("<BBB", 1, 0, len(name)) + name.encode() + struct.pack("<Q", at))
    content = array.astype(array.dtype.newbyteorder(order)).tobytes()
    raw = bytearray(48)

    def append(b):
        at = len(raw)
        raw.extend(b)
        return at

    data = append(content)
    space = struct.pack(f"<BBBB{array.ndim}Q", 2, array.ndim, 0, 1, *array.shape)
    dataset = append(header2(message2(1, space), message2(3, kind), message2(8, struct.pack("<BBQQ", 3, 1, data, len(content)))))
    group = append(header2(link("x", dataset)))
    tail = append(b"OCHK" + message2(0, b"") + link("inner", group) + b"sums")
    root = append(header2(message2(0x10, struct.pack("<QQ", tail, len(raw) - tail))))
    raw[:48] = hdf5.SIGNATURE + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 0, hdf5.UNDEFINED, len(raw), root) + b"sums"
    return b"\0" * user_block + bytes(raw)


@pytest.mark.parametrize("dtype", ["i1", "u2", "i4", "i8", "f4", "f8"])
def test_chunked_arrays_round_trip(tmp_path, dtype):
    rng = np.random.default_rng(1)
    arrays = {"flat": (rng.integers(0, 100, 1000).astype(dtype), (7,)), "deep": (rng.integers(0, 100, (23, 5, 7)).astype(dtype), (4, 3, 7)), "one": (np.array([[3]], dtype), (1, 1))}
    path = built(tmp_path, **arrays)
    container = Container(path)
    assert set(container.members(container.root)) == set(arrays)
    for name, (array, chunk) in arrays.items():
        data = container.dataset(name)
        assert data.shape == array.shape and data.chunk == chunk and data.dtype == array.dtype
        assert (data.rows(0, len(array)) == array.reshape(len(array), -1)).all()
        for first, last in ((0, 1), (len(array) - 1, len(array)), (len(array) // 3, len(array) // 2 + 1)):
            assert (data.rows(first, last) == array.reshape(len(array), -1)[first:last]).all()
    with pytest.raises(KeyError):
        container.dataset("none")


def test_a_row_range_opens_only_its_chunks(tmp_path):
    array = np.arange(20_000 * 4, dtype="i4").reshape(20_000, 4)
    data = Container(built(tmp_path, x=(array, (16, 2)))).dataset("x")  # 2,500 chunks: a tree of three levels
    every = list(data.chunks(0, 20_000))
    assert len(every) == 2500
    data.container.opened.clear()
    assert (data.rows(8_000, 8_020) == array[8_000:8_020]).all()
    within = {c.address for c in every if c.start[0] < 8_020 and c.start[0] + 16 > 8_000}
    starts = {c.address for c in every}
    assert {a for a, _ in data.container.opened if a in starts} == within and len(within) == 4
    assert len(data.container.opened) - len(within) <= 2 * 6  # head and body of the nodes on the way


@pytest.mark.parametrize("user_block", [0, 512, 1024])
@pytest.mark.parametrize("order", ["<", ">"])
def test_newer_and_contiguous_containers(tmp_path, user_block, order):
    for array in (np.arange(24.0).reshape(4, 6) / 7, np.arange(-5, 5, dtype="i2")):
        path = str(tmp_path / "new.h5")
        with open(path, "wb") as f:
            f.write(newer(array, user_block, order))
        data = Container(path).dataset("inner/x")
        assert data.shape == array.shape
        assert (data.rows(1, 3) == array.reshape(len(array), -1)[1:3]).all()


def test_other_files_are_refused(tmp_path):
    (tmp_path / "no.h5").write_bytes(b"plain text" * 100)
    with pytest.raises(ValueError):
        Container(str(tmp_path / "no.h5"))
    with pytest.raises(FileNotFoundError):
        hdf5.listed(str(tmp_path / "absent"), (".h5",))


def test_format_reads_ranges_over_many_partitions(spark, tmp_path):
    hdf5.register(spark)
    array = np.arange(300 * 6, dtype="f8").reshape(300, 2, 3) / 3
    path = built(tmp_path, images=(array, (20, 2, 2)), other=(np.zeros(3), (3,)))
    read = spark.read.format("hdf5").option("path", path).option("dataset", "images").option("partitionBytes", "2000")
    df = read.load()
    assert df.dtypes == [("file", "string"), ("row", "bigint"), ("values", "array<double>")]
    assert df.rdd.getNumPartitions() == 8
    got = {r.row: r["values"] for r in df.collect()}
    assert got == {k: v.ravel().tolist() for k, v in enumerate(array)}
    for text, want in (("5:7", range(5, 7)), ("290:", range(290, 300)), (":2", range(2)), ("299:999", range(299, 300)), ("7:7", ())):
        assert sorted(r.row for r in read.option("rows", text).load().collect()) == list(want)
    # chunks beyond the range are not even intact
    data = Container(path).dataset("images")
    raw = bytearray(open(path, "rb").read())
    for c in data.chunks(0, 300):
        if c.start[0] >= 40:
            raw[c.address : c.address + c.size] = b"\xff" * c.size
    open(path, "wb").write(raw)
    assert sorted(r.row for r in read.option("rows", "10:40").load().collect()) == list(range(10, 40))
    with pytest.raises(Exception, match="zlib|incorrect|decompress"):
        read.option("rows", "10:41").load().collect()


def test_format_writes_what_it_reads(spark, tmp_path):
    hdf5.register(spark)
    path = str(tmp_path / "folder")
    rows = [(k, [k / 7, -float(k), 1e300]) for k in range(500)]
    df = spark.createDataFrame(rows, "row long, values array<double>").repartition(3)
    df.write.format("hdf5").option("path", path).option("fileBytes", "1500").option("chunkRows", "9").mode("append").save()
    names = hdf5.listed(path, (".h5",))
    assert len(names) >= 3 and not [p for p in (tmp_path / "folder").iterdir() if p.name.startswith("_")]
    back = spark.read.format("hdf5").option("path", path)
    ids = back.option("dataset", "row").load().selectExpr("file", "row as k", "values[0] as row")
    values = back.option("dataset", "values").load().selectExpr("file", "row as k", "values")
    assert sorted((r.row, list(r["values"])) for r in ids.join(values, ["file", "k"]).collect()) == rows
    df.limit(10).write.format("hdf5").option("path", path).mode("overwrite").save()
    assert back.option("dataset", "row").load().count() == 10
    df.limit(5).write.format("hdf5").option("path", path).mode("append").save()
    assert back.option("dataset", "row").load().count() == 15


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    hdf5.register(spark)
    path = str(tmp_path / "folder")
    for bad in ([(1, [1.0]), (2, None)], [(1, [1.0]), (2, [1.0, 2.0])]):
        with pytest.raises(Exception, match="nulls|length"):
            spark.createDataFrame(bad, "row long, values array<double>").repartition(1).write.format("hdf5").option("path", path).mode("append").save()
    assert not list((tmp_path / "folder").iterdir()) if (tmp_path / "folder").exists() else True


def test_subject_images(spark, tmp_path):
    array = np.arange(100 * 12, dtype="u1").reshape(100, 2, 2, 3)
    path = built(tmp_path, brick=(array, (10, 2, 2, 3)))
    images = spark.createDataFrame([(k, "x") for k in (41, 43, 41, 58)], "image_ix long, px string")
    got = {r.image_ix: r.px for r in subject_images(spark, path, images).collect()}
    assert got == {k: array[k].ravel().tolist() for k in (41, 43, 58)}
    assert subject_images(spark, path, images.limit(0)).count() == 0
    assert subject_images(spark, path).count() == 100


# --- MAT


def element(kind, body, order="<"):
    if 0 < len(body) <= 4:
        return struct.pack(f"{order}I", len(body) << 16 | kind) + body.ljust(4, b"\0")
    return struct.pack(f"{order}II", kind, len(body)) + body + bytes(-len(body) % 8)


def matrix(name, value, order="<"):
    """A matrix element of an array, a text, a list (cell) or a list of dicts wrapped in Struct."""
    ints = lambda *x: np.array(x, f"{order}i4").tobytes()
    head = lambda kind, shape: element(6, np.array([kind, 0], f"{order}u4").tobytes(), order) + element(5, ints(*shape), order) + element(1, name.encode(), order)
    if isinstance(value, str):
        body = head(4, (1, len(value))) + element(17, value.encode("utf-16-le" if order == "<" else "utf-16-be"), order)
    elif isinstance(value, Struct):
        fields = list(value.rows[0])
        body = head(2, value.shape) + element(5, ints(32), order) + element(1, b"".join(f.encode().ljust(32, b"\0") for f in fields), order)
        body += b"".join(matrix("", row[f], order) for row in value.rows for f in fields)
    elif isinstance(value, list):
        body = head(1, (1, len(value))) + b"".join(matrix("", v, order) for v in value)
    else:
        value = np.atleast_2d(value)
        code, kind = {"f8": (6, 9), "u1": (9, 2), "i2": (10, 3), "u4": (13, 6)}[value.dtype.str[1:]]
        body = head(code, value.shape) + element(kind, value.astype(value.dtype.newbyteorder(order)).tobytes("F"), order)
    return struct.pack(f"{order}II", 14, len(body)) + body


class Struct:
    def __init__(self, rows, shape=None):
        self.rows, self.shape = rows, shape or (1, len(rows))


def mat_bytes(order="<", packed=(), **variables):
    out = b"MATLAB 5.0 MAT-file".ljust(124, b" ") + struct.pack(f"{order}H", 0x0100) + (b"IM" if order == "<" else b"MI")
    for name, value in variables.items():
        whole = matrix(name, value, order)
        if name in packed:
            inner = zlib.compress(whole)
            whole = struct.pack(f"{order}II", 15, len(inner)) + inner
        out += whole
    return out


@pytest.mark.parametrize("order", ["<", ">"])
def test_mat_arrays_structs_and_cells(spark, tmp_path, order):
    path = str(tmp_path / "a.mat")
    grid = np.arange(6.0).reshape(2, 3)
    clusters = Struct([{"name": f"c{k}", "angles": np.arange(k, dtype="f8"), "inner": Struct([{"n": np.array([[k]], "u1")}])} for k in range(3)])
    with open(path, "wb") as f:
        f.write(mat_bytes(order, ("grid", "clusters"), grid=grid, small=np.array([[7, 8]], "i2"), deep=np.arange(24.0).reshape(2, 12), clusters=clusters, cells=[np.array([[1.5]]), "text é", [np.array([[2.0]])]], last=np.array([[1]], "u4")))
    rows = [(r.path, tuple(r.element), r.row, r.text, r["values"]) for r in mat.mat_file(spark, path).collect()]
    assert ("grid", (), 0, None, [0.0, 1.0, 2.0]) in rows and ("grid", (), 1, None, [3.0, 4.0, 5.0]) in rows
    assert ("small", (), 0, None, [7.0, 8.0]) in rows and ("last", (), 0, None, [1.0]) in rows
    for k in range(3):
        assert ("clusters.name", (k,), 0, f"c{k}", None) in rows
        assert ("clusters.inner.n", (k, 0), 0, None, [float(k)]) in rows
        assert ("clusters.angles", (k,), 0, None, list(map(float, range(k)))) in rows
    assert ("cells", (0,), 0, None, [1.5]) in rows and ("cells", (1,), 0, "text é", None) in rows and ("cells", (2, 0), 0, None, [2.0]) in rows
    chosen = mat.mat_file(spark, path, "grid", "last")
    assert chosen.rdd.getNumPartitions() == 2 and {r.path for r in chosen.collect()} == {"grid", "last"}
    assert sorted((r.ix, r.value) for r in mat.unrolled(chosen.where("path = 'grid'")).collect()) == [(k, v) for k, v in enumerate(grid.ravel(order="F"))]
    assert mat.mat_file(spark, path, "absent").count() == 0


def test_trial_order_from_a_mat_file(spark, tmp_path):
    rng = random.Random(3)
    order = [rng.randrange(1, 500) for _ in range(3000)]
    for k, (shape, packed) in enumerate((((1, 3000), ("masterordering",)), ((3000, 1), ()))):
        path = str(tmp_path / f"design{k}.mat")
        with open(path, "wb") as f:
            f.write(mat_bytes(packed=packed, subjectim=np.zeros((8, 10)), masterordering=np.array(order, "f8").reshape(shape)))
        trials = mat.trial_order(mat.mat_file(spark, path, "masterordering"))
        assert sorted(map(tuple, trials.collect())) == [(k, v - 1) for k, v in enumerate(order)]
    images = spark.range(499).selectExpr("id as image_ix", "id * 2 as twice")
    responses = trials.selectExpr("trial_ix", "trial_ix / 2 as y")
    rows = trial_rows(trials, responses, images, trials.where("trial_ix < 10").select("trial_ix")).collect()
    assert sorted((r.trial_ix, r.twice) for r in rows) == [(k, 2 * (v - 1)) for k, v in enumerate(order[:10])]


def test_other_mat_files_are_refused(tmp_path):
    (tmp_path / "x.mat").write_bytes(b"nothing" * 40)
    with pytest.raises(ValueError):
        list(mat._variables(str(tmp_path / "x.mat"), None))
