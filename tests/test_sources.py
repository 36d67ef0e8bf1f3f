import json
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.operators import pixels
from trapline.operators.pixels import crop_pixels
from trapline.sources import coco, images, tables


def document(split):
    return {
        "images": [{"id": f"{split}1", "file_name": "a.jpg", "width": 640, "height": 480, "location": 33, "date_captured": "2013-10-04 13:31:53"}],
        "annotations": [
            {"id": f"{split}-a", "image_id": f"{split}1", "category_id": 3, "bbox": [1.5, 2, 3, 4]},
            {"id": f"{split}-b", "image_id": f"{split}1", "category_id": 3, "area": 12},
        ],
        "categories": [{"id": 3, "name": "fox"}],
        "info": {"year": 2018},
    }


@pytest.fixture
def folder(tmp_path):
    for split in ("train", "cis_val"):
        (tmp_path / f"{split}_annotations.json").write_text(json.dumps(document(split), indent=2))
    return str(tmp_path)


def test_one_document(spark, folder):
    found = coco.scan_coco(spark, f"{folder}/train_annotations.json")
    image = coco.with_capture_time(found.images).first()
    assert (image.id, image.location, image.img_set, image.datetime) == ("train1", "33", "train_images", datetime(2013, 10, 4, 13, 31, 53))
    marks = {r.id: r for r in found.annotations.collect()}
    assert marks["train-a"].bbox == [1.5, 2.0, 3.0, 4.0] and marks["train-a"].area is None
    assert marks["train-b"].bbox is None and marks["train-b"].area == 12.0
    assert [tuple(r) for r in found.categories.collect()] == [(3, "fox")]


def test_a_folder_of_documents(spark, folder, tmp_path):
    found = coco.scan_coco_dir(spark, folder)
    assert {(r.id, r.img_set) for r in found.images.collect()} == {("train1", "train_images"), ("cis_val1", "cis_val_images")}
    assert found.categories.count() == 1
    stored = coco.ingest_coco(spark, folder, str(tmp_path / "out"))
    assert stored.annotations.count() == 4


def test_wrong_types_fail_unless_told_otherwise(spark, tmp_path):
    bad = document("x")
    bad["annotations"][0]["bbox"] = [1, "wide", 3, 4]
    (tmp_path / "x_annotations.json").write_text(json.dumps(bad))
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        coco.scan_coco(spark, str(tmp_path)).annotations.collect()
    loose = coco.scan_coco(spark, str(tmp_path), strict=False)
    assert loose.annotations.where("id = 'x-b'").count() == 1


def test_manifest_files(spark, tmp_path):
    for split, name in (("train", "a1_0_red_fox.jpg"), ("test", "b2_1_owl.jpg")):
        (tmp_path / split).mkdir()
        (tmp_path / split / "kenya_path_to_box.csv").write_text(f",img_name,x1,x2,y1,y2,width,height\n0,{name},1,4,2,6,3.0,4\n")
    found = {r.img_id: r for r in tables.scan_manifest(spark, str(tmp_path), "kenya", ["train", "test"]).collect()}
    assert found["a1"].img_path == "train/a1_0_red_fox.jpg" and found["b2"].img_set == "test"
    assert (found["a1"].x2, found["a1"].width, found["a1"].area) == (4, 3, 12)


def test_context_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        ",img_name,datetime,prev_same_next_img_boxes,boxes_per_img_id,is_in_train_1perc\n"
        "0,a,2013-10-04 13:31:53,\"['train/x_0_fox.jpg', 'train/y_1_fox.jpg']\",2,True\n1,b,2013-10-04 13:31:54,[],1,False\n"
    )
    found = {r.img_name: r for r in tables.scan_context_csv(spark, str(path)).collect()}
    assert found["a"].prev_same_next_img_boxes == ["train/x_0_fox.jpg", "train/y_1_fox.jpg"]
    assert found["b"].prev_same_next_img_boxes == [] and found["a"].is_in_train_1perc
    assert found["a"].datetime == datetime(2013, 10, 4, 13, 31, 53)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p", "train", ["q"], 1)], "img_path string, img_set string, boxes array<string>, area int")
    tables.sink_context(rows, str(tmp_path / "context"))
    back = spark.read.parquet(str(tmp_path / "context"))
    assert back.first().boxes == ["q"] and back.first().img_set == "train"
    assert "PartitionFilters: [isnotnull(img_set" in back.where("img_set = 'train'")._jdf.queryExecution().toString()
    tables.sink_manifest(rows.drop("boxes"), str(tmp_path / "manifest"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "manifest")).count() == 1
    metrics = spark.createDataFrame([(1, "test_acc", 50.0)], "split_pct int, metric string, value double")
    tables.sink_results(metrics, str(tmp_path / "results"), {"seed": 1})
    line = spark.read.json(str(tmp_path / "results")).first()
    assert line.value == 50.0 and json.loads(line.settings) == {"seed": 1}


def test_union_of_splits(spark):
    one = spark.createDataFrame([("a",)], "img_name string")
    assert {(r.img_name, r.img_set) for r in tables.union_splits({"train": one, "test": one}).collect()} == {("a", "train"), ("a", "test")}


def png(pixels: np.ndarray) -> bytes:
    high, wide, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pictures_and_crops(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, size=(9, 11, 3), dtype=np.uint8)
    (tmp_path / "one.png").write_bytes(png(pixels))
    (tmp_path / "broken.png").write_bytes(b"not a picture")
    pictures = images.scan_images(spark, str(tmp_path))
    row = pictures.first()
    assert pictures.count() == 1 and row.file_name == "one.png" and (row.height, row.width) == (9, 11)
    bgr = pixels[:, :, ::-1]
    assert bytes(row.data) == bgr.tobytes()
    spans = [(1, 5, 2, 7), (0, 11, 0, 9), (8, 40, 3, 40), (-4, -1, 1, 3), (5, 5, 0, 4), (30, 40, 0, 4)]
    spans += [(x, x + 2, y, y + 1) for x in range(9) for y in range(8)]
    boxes = spark.createDataFrame([("i", f"c{n}", *s) for n, s in enumerate(spans)], "img_id string, img_path string, x1 int, x2 int, y1 int, y2 int")
    found = crop_pixels(pictures.withColumn("img_id", F.lit("i")), boxes).collect()
    assert len(found) == len(spans)
    for r in found:
        x1, x2, y1, y2 = spans[int(r.img_path[1:])]
        want = bgr[y1:y2, x1:x2]
        assert bytes(r.data) == want.tobytes(), r.img_path
        if want.size:
            assert (r.height, r.width) == want.shape[:2]


def test_pixels_are_dealt_by_their_size(spark, monkeypatch):
    """Pictures that shrink to nothing in a shuffle get as many tasks as their pixels need; a crowded one is in several."""
    monkeypatch.setattr(pixels, "TASK_BYTES", 1_000, raising=False)
    monkeypatch.setattr(pixels, "LISTS_PER_PART", 1, raising=False)
    rows = [(f"i{n}", 10, 20, 1, 0, bytes([n]) * 200) for n in range(100)]
    pictures = spark.createDataFrame(rows, "img_id string, height int, width int, nChannels int, mode int, data binary")
    boxes = [(f"i{n}", f"c{n}", 1, 4, 2, 5) for n in range(99)] + [("i99", f"d{k}", k % 20, k % 20 + 1, 0, 10) for k in range(300)]
    boxes += [(None, "none", 0, 1, 0, 1), ("i0", "c0", 1, 4, 2, 5)]
    manifest = spark.createDataFrame(boxes, "img_id string, img_path string, x1 int, x2 int, y1 int, y2 int")
    found = crop_pixels(pictures, manifest)
    assert found.rdd.getNumPartitions() >= 20
    want = sorted((i, p, bytes([int(i[1:])]) * ((x2 - x1) * (y2 - y1))) for i, p, x1, x2, y1, y2 in boxes if i)
    assert sorted((r.img_id, r.img_path, bytes(r.data)) for r in found.collect()) == want
