"""Annotation files in, context table and partners out."""

import json

from trapline.operators import curation, draws, features
from trapline.plans.context import context_table, crops_with_images
from trapline.sources import coco, tables


def write(folder, split, numbers):
    images = [
        {"id": f"{split}{n}", "file_name": f"{split}{n}.jpg", "width": 640, "height": 480, "location": n // 4,
         "date_captured": f"2013-10-04 13:31:{10 + 2 * (n % 4):02d}"}
        for n in numbers
    ]
    marks = [
        {"id": f"{split}{n}-{k}", "image_id": f"{split}{n}", "category_id": 1 + n % 2, "bbox": [10.5, 20.5, 64 + k, 64.9]}
        for n in numbers for k in range(1 + n % 2)
    ]
    marks += [{"id": f"{split}-none", "image_id": f"{split}0", "category_id": 1}]
    marks += [{"id": f"{split}-small", "image_id": f"{split}0", "category_id": 1, "bbox": [0, 0, 5, 5]}]
    content = {"images": images, "annotations": marks, "categories": [{"id": 1, "name": "red_fox"}, {"id": 2, "name": "owl"}]}
    (folder / f"{split}_annotations.json").write_text(json.dumps(content))


def test_files_to_partners(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "train", range(8))
    write(source, "cis_test", range(4))
    docs = coco.ingest_coco(spark, f"{source}/*annotations.json", str(tmp_path / "tables"))
    images = curation.normalize_columns(coco.with_capture_time(docs.images))
    manifest = curation.crop_manifest(docs.annotations, images, docs.categories)
    crops = crops_with_images(manifest, images)
    tables.sink_context(context_table(crops), str(tmp_path / "context"))
    context = spark.read.parquet(str(tmp_path / "context"))
    rows = {r.img_name: r for r in context.collect()}
    assert len(rows) == 18
    # train1 lies two seconds after train0 and, as images of one location, also after cis_test0.
    first = rows["train1_0_owl.jpg"]
    assert first.img_path == "train_images/train1_0_owl.jpg" and first.boxes_per_img_id == 2 and first.time == "13:31:12"
    assert first.prev_same_next_img_boxes == sorted(
        ["cis_test_images/cis_test0_0_red_fox.jpg", "cis_test_images/cis_test2_0_red_fox.jpg", "train_images/train1_1_owl.jpg"]
    )
    assert first.boxes_per_prev_same_next_img == 3
    assert sum(r.is_in_train_10perc for r in rows.values()) >= 2
    vectors = features.context_features(context)
    assert all(len(r.con_time) == 9 and len(r.con_bbox) == 5 for r in vectors.collect())
    partners = draws.positive_context(context, "img_path")
    assert {r.img_path for r in partners.collect()} == {r.img_path for r in rows.values()}
