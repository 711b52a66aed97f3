"""Image ingest and volumes: what is written is what is read."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import kernels as K
from voxelframe.sources import ingest as I
from voxelframe.sources import volumes as V


def png_file(path, array):
    """Write an array as a PNG file of unfiltered lines."""
    import zlib

    h, w, c = array.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + array[y].astype(np.uint8).tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def plain_resize(a, size):
    """The widened triangle filter, pixel by pixel."""

    def weights(n):
        scale, out = n / size, np.zeros((size, n))
        for i in range(size):
            for j in range(n):
                out[i, j] = max(0.0, 1 - abs((j + 0.5 - (i + 0.5) * scale) / max(scale, 1)))
            out[i] /= out[i].sum()
        return out

    r, c = weights(a.shape[0]), weights(a.shape[1])
    out = np.zeros((size, size, a.shape[2]))
    for k in range(a.shape[2]):
        out[..., k] = r @ a[..., k] @ c.T
    return np.floor(out + 0.5)


def test_resampling_weights():
    for kernel in ("box", "bilinear", "lanczos"):
        for n, new in ((10, 4), (4, 10), (7, 7), (1, 3), (240, 1)):
            w = I.resampling(n, new, kernel)
            assert w.shape == (new, n) and np.allclose(w.sum(axis=1), 1)
    assert np.allclose(I.resampling(4, 2, "box"), [[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]])
    assert np.allclose(I.resampling(5, 5, "bilinear"), np.eye(5))


def test_folder_to_store_to_kernels(spark, tmp_path):
    rng = np.random.default_rng(1)
    folder, out = tmp_path / "images", str(tmp_path / "store")
    folder.mkdir()
    arrays = {}
    for k in range(30):
        arrays[k] = rng.integers(0, 256, (20 + k % 5 * 4, 24, (3, 1, 4)[k % 3]))
        png_file(folder / f"im-{k}.png", arrays[k])
    (folder / "broken.png").write_bytes(b"no image")
    files = spark.createDataFrame([(k, f"/elsewhere/im-{k}.png", None if k % 2 else [0.1, 0.2, 0.0, 0.25]) for k in range(30)] + [(30, "broken.png", None), (31, "absent.png", None), (32, "im-0.png", [0.5, 0.5, 0.0, 0.0])], "image_ix long, filename string, crop_box array<double>")
    missing = I.ingest(spark, files, str(folder), out, size=12)
    assert sorted(r.image_ix for r in missing.collect()) == [30, 31, 32]
    stored = {r.image_ix: np.array(r.px).reshape(12, 12, 3) for r in I.stored_images(spark, out).collect()}
    assert sorted(stored) == list(range(30))
    for k, a in arrays.items():
        h, w, c = a.shape
        if k % 2:
            cut = abs((w / h - 1) / 2 if h > w else (h / w - 1) / 2)
            box = (cut, cut, 0, 0) if h > w else (0, 0, cut, cut)
        else:
            box = (0.1, 0.2, 0.0, 0.25)
        a = a[int(np.floor(box[0] * h)) : int(np.floor(h - box[1] * h)), int(np.floor(box[2] * w)) : int(np.floor(w - box[3] * w))]
        a = np.repeat(a[..., :1], 3, axis=2) if c == 1 else a[..., :3]
        assert np.abs(stored[k] - plain_resize(a, 12)).max() <= 1, k
    gray = I.stored_images(spark, out).select("image_ix", "w", F.transform(F.filter("px", lambda v, i: i % 3 == 0), lambda v: v / 255).alias("px"))
    assert K.per_image(gray, lambda x: x.mean(axis=(-2, -1))).count() == 30


def test_a_subject_reads_its_own_files(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("image_ix"), F.lit(2).alias("w"), F.lit(1).alias("channels"), F.array(*[(F.col("id") % 100 + k).cast("short") for k in range(4)]).alias("px"))
    out = str(tmp_path / "store")
    I.store_images(rows, out, per_file=50)
    images = spark.createDataFrame([(120,), (131,), (120,)], "image_ix long")
    chosen = I.stored_images(spark, out, images)
    assert sorted(r.image_ix for r in chosen.collect()) == [120, 131]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(image_ix,120)" in plan and "LessThanOrEqual(image_ix,131)" in plan
    ranges = spark.read.parquet(out).groupBy(F.input_file_name()).agg(F.min("image_ix").alias("a"), F.max("image_ix").alias("b")).collect()
    assert len(ranges) >= 8 and sum(r.a <= 131 and r.b >= 120 for r in ranges) <= 2
    assert I.stored_images(spark, out, images.limit(0)).count() == 0
    subjects = spark.createDataFrame([(s, p, (p * 7 + s) % 400) for s in (1, 2) for p in range(60)], "subject int, place long, image_ix long")
    I.subject_cut(spark, out, subjects, str(tmp_path / "cut"), per_file=20)
    own = {r.image_ix: r.px for r in I.stored_images(spark, str(tmp_path / "cut" / "subject=2")).collect()}
    assert own == {p: [float(((p * 7 + 2) % 400) % 100 + k) for k in range(4)] for p in range(60)}


def test_localizer_files():
    files = I.localizer_files({"a": 2, "food1": 2, "food2": 3}, {"food1": ("food", 0), "food2": ("food", 2)})
    assert files == [(0, "a", 1, "a-1.jpg"), (1, "a", 2, "a-2.jpg"), (2, "food1", 1, "food-1.jpg"), (3, "food1", 2, "food-2.jpg"), (4, "food2", 1, "food-3.jpg"), (5, "food2", 2, "food-4.jpg"), (6, "food2", 3, "food-5.jpg")]


def mgh(values):
    shape = [*values.shape, *[1] * (4 - values.ndim)]
    code = {"u1": 0, "i4": 1, "f4": 3, "i2": 4}[values.dtype.str[1:]]
    head = struct.pack(">6i", 1, *shape, code) + bytes(260)
    return head + values.astype(values.dtype.newbyteorder(">")).tobytes("F")


@pytest.mark.parametrize("dtype", ["u1", "i2", "i4", "f4"])
def test_mgh_volumes(spark, tmp_path, dtype):
    a = np.random.default_rng(2).integers(0, 200, (5, 4, 3, 2)).astype(dtype)
    (tmp_path / "a.mgh").write_bytes(mgh(a))
    (tmp_path / "b.mgz").write_bytes(gzip.compress(mgh(a[..., 0])))
    rows = V.volumes(spark, str(tmp_path)).collect()
    got = {(r.path[-5:], r.i, r.j, r.k, r.t): r.value for r in rows}
    assert len(got) == a.size + a[..., 0].size
    assert all(v == (a[i, j, k, t]) for (p, i, j, k, t), v in got.items())


def test_written_volumes_are_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SLAB", 100)  # five slabs to a volume
    shape = (11, 7, 6)
    rng = np.random.default_rng(3)
    cells = {(v, int(i), int(j), int(k)): float(rng.integers(1, 9)) for v in ("s1", "s2") for i, j, k in rng.integers(0, 6, (60, 3))}
    rows = [(*key, value) for key, value in cells.items()] + [("s1", 0, 0, 5, 3.0), ("s1", 0, 0, 5, 8.0), ("s1", 99, 0, 0, 1.0), ("s1", 1, 1, 1, None), ("s3", 0, 0, 0, None)]
    cells["s1", 0, 0, 5] = max(8.0, cells.get(("s1", 0, 0, 5), 0))
    df = spark.createDataFrame(rows, "volume string, i int, j int, k int, value double").repartition(4)
    V.write_volumes(df, str(tmp_path / "out"), shape)
    got = V.volumes(spark, str(tmp_path / "out")).select(F.regexp_extract("path", r"(\w+)\.nii\.gz", 1).alias("volume"), "i", "j", "k", "value").collect()
    assert len(got) == 3 * 11 * 7 * 6
    assert {(r.volume, r.i, r.j, r.k): r.value for r in got if r.value} == cells
    numbered = V.numbered_voxels(spark.createDataFrame(got)).where("volume = 's2'").orderBy("voxel_ix").collect()
    order = sorted((k, j, i) for v, i, j, k in cells if v == "s2")
    assert [(r.voxel_ix, r.k, r.j, r.i) for r in numbered] == [(n, *c) for n, c in enumerate(order)]


def test_region_volumes_by_priority(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "i int, j int, k int, value double")
    maps = {"ret": table([(0, 0, 0, 1.0), (1, 0, 0, 0.0), (2, 0, 0, None)]), "face": table([(0, 0, 0, 7.0), (1, 0, 0, 5.0), (2, 0, 0, 6.0), (3, 0, 0, 0.0)])}
    merged = {(r.i, r.j, r.k): r.value for r in V.merged_labels(maps, ["ret", "face"]).collect()}
    assert merged == {(0, 0, 0): 1.0, (1, 0, 0): 5.0, (2, 0, 0): 6.0, (3, 0, 0): 0.0}
    V.region_volumes({"s1": maps, "s2": {"face": maps["face"], "ret": maps["face"].where("i = 3")}}, ["ret", "face"], str(tmp_path / "rois"), (4, 2, 2))
    got = V.volumes(spark, str(tmp_path / "rois"))
    assert got.count() == 32
    assert sorted((r.path[-9:-7], r.i, r.value) for r in got.where("value != 0").collect()) == [("s1", 0, 1.0), ("s1", 1, 5.0), ("s1", 2, 6.0), ("s2", 0, 7.0), ("s2", 1, 5.0), ("s2", 2, 6.0)]
