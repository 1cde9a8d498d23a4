import json
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.operators import maintain
from weftwork.operators import textindex as X
from weftwork.sources import artifacts, catalog, media
from weftwork.streaming import chunks as stream


@pytest.fixture
def shop(tmp_path):
    (tmp_path / "styles.csv").write_text("﻿id,gender,masterCategory,subCategory,articleType,baseColour,season,year,usage,productDisplayName\n1,Men,Footwear,Shoes,NA,Black,Fall,2011,Casual,Aro Trail Shoe\n2,Women,Apparel,,Shirt,,Summer,2012,,\"Sol, the shirt\"\n3,Men,,,,,,,,Third\n", encoding="utf-8")
    (tmp_path / "styles").mkdir()
    (tmp_path / "styles" / "1.json").write_text(json.dumps({"data": {"brandName": "Aro", "productDescriptors": {"description": {"value": "<p>Light &amp; quick</p>"}}, "articleAttributes": {"Sole": "Rubber", "Care": "NA"}}}))
    (tmp_path / "styles" / "2.json").write_text(json.dumps({"data": {"productDescriptors": None}}))
    (tmp_path / "images").mkdir()
    for k, content in ((1, b"same"), (2, b"same"), (3, b"diff")):
        (tmp_path / "images" / f"{k}.jpg").write_bytes(content)
    return tmp_path


def test_catalogue_from_files(spark, shop):
    images = catalog.read_images(spark, str(shop / "images"))
    styles = catalog.read_styles(spark, str(shop / "styles.csv"))
    built = catalog.build(styles, catalog.read_details(spark, str(shop / "styles")), images, catalog.image_groups(images))
    rows = {r.product_id: r for r in built.collect()}
    assert rows[1].canonical_text == "Aro Trail Shoe Men Footwear Shoes Black Fall 2011 Casual Aro Light & quick Sole Rubber Care"
    assert rows[1].categories.get("articleType") is None and rows[1].has_description and not rows[2].has_description
    assert rows[1].duplicate_image_group == rows[2].duplicate_image_group and rows[3].duplicate_image_group is None
    assert rows[2].canonical_text == "Sol, the shirt Women Apparel Shirt Summer 2012"
    assert [r.id for r in catalog.read_styles(spark, str(shop / "styles.csv"), 2).collect()] == [1, 2]
    assert catalog.write_catalog(built, str(shop / "out")) == 3
    again = {r.product_id: r for r in catalog.read_catalog(spark, str(shop / "out")).collect()}
    assert again[1].metadata.article_attributes == {"Sole": "Rubber", "Care": "NA"}


def test_strict_catalogue(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"product_id": 1}\n\n{"product_id": \n')
    with pytest.raises(Exception):
        catalog.read_catalog(spark, str(tmp_path)).collect()


def png(image):
    h, w = image.shape
    raw = b"".join(b"\0" + image[k].tobytes() for k in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_image_descriptors(spark, tmp_path):
    image = np.zeros((240, 320), dtype=np.uint8)
    image[60:180, 80:240] = 200
    (tmp_path / "a.png").write_bytes(png(image))
    rows = media.image_descriptors(media.read_images(spark, str(tmp_path)), most_width=160, most_height=120).collect()
    assert 0 < len(rows) <= 500 and all(len(r.descriptor) == 128 for r in rows)
    assert media.resize(image, 160, 120).shape == (120, 160) and media.resize(image, 999, 999) is image
    assert media.resize(image, 160, 120)[60, 80] == 200
    assert len(media.gradient_descriptors(np.zeros((50, 50), np.uint8))) == 0


def test_sound_descriptors(spark, tmp_path):
    t = np.arange(11_025) / 22_050
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(22_050)
        f.writeframes((np.sin(2 * np.pi * 440 * t) * 20_000).astype("<i2").tobytes())
    rows = media.sound_descriptors(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(rows) == 1 + 11_025 // 512 and all(len(r.descriptor) == 20 and np.isfinite(r.descriptor).all() for r in rows)
    assert media.mfcc(np.zeros(100, np.float32)).shape[1] == 20
    with wave.open(str(tmp_path / "b.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8_000)
    with pytest.raises(ValueError):
        media.load_wave((tmp_path / "b.wav").read_bytes())


def test_latest_and_upsert(spark):
    old = spark.createDataFrame([(1, "a", {"x": "1"}), (2, "b", None)], "k long, v string, m map<string,string>")
    new = spark.createDataFrame([(2, "c", {"y": "2"}), (3, "d", {}), (None, "e", {})], "k long, v string, m map<string,string>")
    rows = {r.k: (r.v, r.m) for r in maintain.upsert(old, new, ["k"]).collect()}
    assert rows == {1: ("a", {"x": "1"}), 2: ("c", {"y": "2"}), 3: ("d", {})}


def test_partitions_are_replaced_and_counted(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k long, part string")
    maintain.replace_partitions(rows, path, ["part"])
    maintain.replace_partitions(rows.where("k = 1"), path, ["part"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 3]
    assert {(r["table"], r["rows"]) for r in maintain.counts({"t": spark.read.parquet(path)}).collect()} == {("t", 2)}
    assert maintain.bytes_on_disk(spark, path) > 0
    assert [r.k for r in maintain.missing(rows, rows.where("k < 3"), "k").collect()] == [3]


def test_postings_are_pruned(spark, tmp_path):
    rows = spark.createDataFrame([("red", "text:1:0", 1, 0.5)], "term string, chunk_id string, product_id long, weight double")
    artifacts.save_postings(rows, str(tmp_path / "p"), "text", "1k", "term", "chunk_id")
    assert artifacts.load_postings(spark, str(tmp_path / "p"), "text", "1k").first().codeword_id == "red"
    assert artifacts.load_postings(spark, str(tmp_path / "p"), "image", "1k").count() == 0


def test_postings_follow_a_stream(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "postings")
    schema = "chunk_id string, product_id long, content string"
    for k, rows in enumerate(([("c1", 1, "red bag red"), ("c2", 2, "hat")], [("c1", 1, "blue bag")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream.maintain_postings(spark.readStream.schema(schema).parquet(str(source)), path, str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.chunk_id, r.term, r.n) for r in spark.read.parquet(path).collect()} == {("c1", "blue", 1), ("c1", "bag", 1), ("c2", "hat", 1)}


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:07:00", "a")], "t string, k string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.n for r in stream.windowed_counts(df, "ts", "k").collect()) == [1, 2]


def test_index_of_no_chunks(spark):
    none = X.tokenized(spark.createDataFrame([], "chunk_id string, product_id long, content string"))
    assert X.tfidf(none, X.codebook(none)).count() == 0
