import json
import struct
import zlib

import numpy as np
import pytest

from sievework.functions import pixels as px
from sievework.operators import images as im
from sievework.sources import graphs as gs
from sievework.sources import images as si
from sievework.sources import tables as ts


def png(a: np.ndarray) -> bytes:
    h, w = a.shape[:2]
    color = {1: 0, 3: 2, 4: 6}[a.shape[2]]
    raw = b"".join(b"\0" + a[i].astype(np.uint8).tobytes() for i in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_csv_row_ids_follow_file_order(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,Coarse Aggr.\n" + "".join(f"{i},{i * 2}\n" for i in range(50)))
    df = ts.read_table(spark, str(p))
    assert all(r["a"] == r["_row_id"] for r in df.collect())
    with pytest.raises(ValueError):
        ts.read_table(spark, "x.bin")


def test_graph_readers(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# c\n1 2 0.5\n2\t3\nbad\n")
    assert {(r.src, r.dst) for r in gs.read_edges_text(spark, str(tmp_path / "g.txt")).collect()} == {("1", "2"), ("2", "3")}
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": 1}, {"id": 9}], "links": [{"source": 1, "target": 2, "value": 3}, {"source": 2, "target": 1}]}, indent=1))
    g = gs.read_graph(spark, str(tmp_path / "g.json"))
    assert sorted(r.id for r in g.vertices.collect()) == ["1", "2", "9"]
    assert sorted(r.weight for r in g.edges.collect()) == [1.0, 3.0]
    (tmp_path / "g.graphml").write_text('<graphml><graph edgedefault="directed"><node id="a"/><node id="b"/><node id="c"/><edge source="a" target="b"/></graph></graphml>')
    x = gs.read_graph(spark, str(tmp_path / "g.graphml"))
    assert x.directed and x.vertices.count() == 3 and [(r.src, r.dst) for r in x.edges.collect()] == [("a", "b")]


def test_image_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, (40, 60, 3))
    (tmp_path / "sub").mkdir()
    files = {"a.png": noise, "sub/b.png": noise, "flat.png": np.full((50, 50, 3), 128), "black.png": np.zeros((50, 50, 3)),
             "rgba.png": np.concatenate([noise, np.full((40, 60, 1), 0)], axis=2)}
    for name, a in files.items():
        (tmp_path / name).write_bytes(png(a))
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "note.txt").write_text("no image")
    scanned = si.scan_images(spark, str(tmp_path))
    m = im.analyze_images(scanned)
    rows = {r.filename: r for r in m.collect()}
    assert len(rows) == 6
    assert rows["broken.jpg"].is_corrupted and "undecodable" in rows["broken.jpg"].corruption_reasons
    assert rows["black.png"].is_corrupted and rows["flat.png"].is_corrupted
    assert rows["a.png"].brightness == pytest.approx(noise.mean()) and rows["a.png"].width == 60
    kept, stats = im.clean_images(m)
    s = stats.first()
    assert s.corrupted_removed == 3 and s.duplicates_removed >= 1 and s.final_count == kept.count()
    si.write_clean_images(spark, kept, str(tmp_path), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == s.final_count
    e = im.enhance_images(scanned, resize=(32, 32)).collect()
    assert {r.failed for r in e} == {True, False} and all(r.height == 32 for r in e if not r.failed)
    white = [r for r in im.enhance_images(scanned.filter("path like '%rgba%'"), False, False, False).collect()][0]
    assert set(white.data) == {255}


def test_label_join_prefers_equal_names(spark):
    images = spark.createDataFrame([("x/Cat.png",), ("x/dog.png",), ("x/owl.png",)], "path string")
    labels = spark.createDataFrame([("cat.png", "late", 0), ("cat", "equal", 1), ("my_dog.jpg", "dogs", 2), ("dog2", "other", 3)], "name string, label string, _row_id long")
    got = {r.path: r.label for r in im.label_join(images, labels).collect()}
    assert got == {"x/Cat.png": "equal", "x/dog.png": "dogs", "x/owl.png": "Unknown"}


def test_resize_and_features():
    a = np.arange(64, dtype=float).reshape(8, 8, 1).repeat(3, axis=2)
    assert (px.resize(a, 8, 8) == a).all()
    assert len(px.features(a)) == 37
