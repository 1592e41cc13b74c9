import io
import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators.reports import accuracy_table, coverage_faults, heat_map
from gridloom.plans.features import FeaturePlan
from gridloom.sources import patches as S
from gridloom.sources import splits as T
from gridloom.sources import tables as D
from gridloom.streaming.extraction import extract_stream, patch_stream


def tiff(x: np.ndarray, deflate: bool, order: str = "<", planar: int = 2) -> bytes:
    bands, h, w = x.shape
    raw = (x if planar == 2 else x.transpose(1, 2, 0)).astype(f"{order}u2").tobytes()
    strips = [raw[k * h * w * 2 : (k + 1) * h * w * 2] for k in range(bands)] if planar == 2 else [raw]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    out = io.BytesIO()
    out.write((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    places = []
    for s in strips:
        places.append(out.tell())
        out.write(s)
    offsets = out.tell()
    out.write(struct.pack(order + f"{len(strips)}I", *places))
    counts = out.tell()
    out.write(struct.pack(order + f"{len(strips)}I", *map(len, strips)))
    one = len(strips) == 1
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 16), (259, 3, 1, 8 if deflate else 1), (273, 4, len(strips), places[0] if one else offsets), (277, 3, 1, bands), (279, 4, len(strips), len(strips[0]) if one else counts), (284, 3, 1, planar)]
    at = out.tell()
    out.write(struct.pack(order + "H", len(tags)))
    for tag, kind, n, value in tags:
        out.write(struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value)))
    data = bytearray(out.getvalue())
    data[4:8] = struct.pack(order + "I", at)
    return bytes(data)


@pytest.mark.parametrize(("deflate", "order", "planar"), [(False, "<", 2), (True, "<", 2), (True, ">", 1), (False, ">", 1)])
def test_tiff(spark, tmp_path, deflate, order, planar):
    x = np.random.default_rng(0).integers(0, 60000, size=(13, 16, 18))
    (tmp_path / "a.tif").write_bytes(tiff(x, deflate, order, planar))
    row = S.read_tiff(spark, f"{tmp_path}/a.tif").first()
    assert (row.h, row.w) == (16, 18) and np.array_equal(np.array(row.bands).reshape(x.shape), x)


def test_images(spark, tmp_path):
    rgb = np.zeros((8, 8, 3), np.uint8)
    rgb[:, :4] = (200, 100, 50)
    raw = b"".join(b"\0" + r.tobytes() for r in rgb)
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    row = S.read_images(spark, f"{tmp_path}/a.png").first()
    assert np.array_equal(np.array(row.bands).reshape(3, 8, 8), rgb.transpose(2, 0, 1))
    small = S.read_images(spark, f"{tmp_path}/a.png", size=4, expect=(8, 8)).first()
    assert (small.h, small.w) == (4, 4) and small.bands[0][0] == 200 and small.bands[0][3] == 0
    with pytest.raises(Exception, match="8x8"):
        S.read_images(spark, f"{tmp_path}/a.png", expect=(9, 9)).collect()


def test_splits(spark, tmp_path):
    (tmp_path / "train.txt").write_text("Forest_1.jpg\nSeaLake_2.jpg\n\n")
    (tmp_path / "val.txt").write_text("Forest_3.jpg\n")
    rows = T.read_splits(spark, {s: f"{tmp_path}/{s}.txt" for s in ("train", "val")}, T.CLASSES_10)
    assert {(r.filename, r["class"], r.label, r.split) for r in rows.collect()} == {("Forest_1.jpg", "Forest", 1, "train"), ("SeaLake_2.jpg", "SeaLake", 9, "train"), ("Forest_3.jpg", "Forest", 1, "val")}
    T.check_splits(rows, {"train": 2, "val": 1})
    (tmp_path / "val.txt").write_text("Forest_1.jpg\nMoon_3.jpg\n")
    bad = T.read_splits(spark, {s: f"{tmp_path}/{s}.txt" for s in ("train", "val")}, T.CLASSES_10)
    assert len(T.split_faults(bad, {"train": 3})) == 3
    with pytest.raises(ValueError):
        T.check_splits(bad)


def test_json_is_deterministic():
    a = {"b": [1, math.nan, np.float64(2)], "a": {"x": (1, math.inf)}}
    assert json.loads(D.to_json(a)) == {"a": {"x": [1, None]}, "b": [1, None, 2.0]}
    assert D.fingerprint(a) == D.fingerprint({"a": {"x": [1, -math.inf]}, "b": [1, None, 2.0]})


def test_csv_and_union(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0)], "k int, a double")
    both = D.union_rows([a, spark.createDataFrame([(2, "x")], "k int, b string")])
    D.write_csv(both, f"{tmp_path}/out")
    back = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert back.columns == ["k", "a", "b"] and back.count() == 2
    with pytest.raises(ValueError):
        D.write_csv(both.limit(0), f"{tmp_path}/none")


def test_cache_knows_what_it_is(spark, tmp_path):
    rows = spark.createDataFrame([("original", "train", [1.0]), ("original", "val", [2.0])], "variant string, split string, v array<double>")
    cache = D.FeatureCache(spark, f"file://{tmp_path}/cache", {"names": ["a"]})
    with pytest.raises(FileNotFoundError):
        cache.read()
    cache.write(rows)
    assert cache.read(verify=True).count() == 2
    with pytest.raises(ValueError):
        D.FeatureCache(spark, f"file://{tmp_path}/cache", {"names": ["b"]}).read()
    assert D.content_fingerprint(rows) == D.content_fingerprint(rows.repartition(3).orderBy("split"))


def test_digests(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    assert S.file_digests(spark, f"{tmp_path}/f").first().sha256.startswith("ba7816bf")


def test_stream_gives_what_the_batch_gives(spark, data, tmp_path):
    rows = S.lattice_patches(D.table(spark, data, "embeddings"), 3)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    plan = FeaturePlan(["red", "green", "blue"], ["mean_red", "grad_std_pan"])
    extract_stream(patch_stream(spark, f"{tmp_path}/in", 1), plan, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    from gridloom.operators.extract import extract

    same = lambda df: {(r.patch_id, tuple(r.features)) for r in df.collect()}
    assert same(spark.read.parquet(f"{tmp_path}/out")) == same(extract(rows, plan))


def test_report_data(spark):
    scores = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.0), ("b", "x", 0.5)], "m string, f string, r2 double")
    cells = {(r.m, r.f): r.r2 for r in heat_map(scores, "m", "f").collect()}
    assert len(cells) == 4 and cells["b", "y"] is None
    assert coverage_faults(scores, scores.limit(2), ["m", "f"]) == 1
    assert accuracy_table(scores.where("m = 'b'")) == "| m | f | r2 |\n| --- | --- | --- |\n| b | x | 0.5000 |\n"
    assert scores.agg(F.sum("r2")).first()[0] == 1.5


def test_embeddings_are_checked(spark, tmp_path):
    from gridloom.sources.embeddings import embedding_faults, read_embeddings

    good = [(k, k % 2, "train" if k < 4 else "val", [1.0, 2.0]) for k in range(6)]
    schema = "key long, label int, split string, features array<double>"
    spark.createDataFrame(good, schema).write.parquet(f"{tmp_path}/good")
    assert read_embeddings(spark, f"{tmp_path}/good", 2, {"train": 4, "val": 2}).count() == 6
    bad = [*good, (0, None, "val", [math.nan]), (9, 1, "test", None)]
    faults = embedding_faults(spark.createDataFrame(bad, schema), 2, {"train": 5})
    assert len(faults) == 6
    with pytest.raises(ValueError, match="not 5"):
        read_embeddings(spark, f"{tmp_path}/good", 2, {"train": 5})


def test_command_line(spark, data, tmp_path, capsys):
    from gridloom.__main__ import main

    assert main(["names", "--preset", "33"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 33
    S.lattice_patches(D.table(spark, data, "embeddings"), 3).write.parquet(f"{tmp_path}/in")
    assert main(["extract", "--bands", "red,green,blue", "--zero", "blue", f"{tmp_path}/in", f"{tmp_path}/out"]) == 0
    assert len(spark.read.parquet(f"{tmp_path}/out").first().features) == 162
