"""Sources, sinks and streams: round trips and what is missing."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.sources import sinks, tables
from lodestar.streaming.folders import each_batch


def test_catalog_tells_absent_from_null(spark, tmp_path):
    (tmp_path / "cards.json").write_text(json.dumps([{"id": "a", "set": None}, {"id": "b"}, {"id": "c", "set": "x", "frame_effects": ["etched"]}]))
    rows = tables.catalog(spark, str(tmp_path / "cards.json")).orderBy("card_idx").collect()
    assert [r.card_idx for r in rows] == [0, 1, 2] and [r.fields.get("set", "absent") for r in rows] == [None, "absent", "x"]


def test_required_columns(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t.parquet"))
    assert tables.table(spark, str(tmp_path), "t", ["id"]).count() == 1
    with pytest.raises(ValueError, match="other"):
        tables.table(spark, str(tmp_path), "t", ["id", "other"])


def test_images_by_kind_and_id(spark, tmp_path):
    for name in ("a.jpg", "b.PNG", "c.txt", "d.e.webp"):
        (tmp_path / name).write_bytes(name.encode())
    found = tables.images(spark, str(tmp_path))
    assert {r.id for r in found.collect()} == {"a", "b", "d.e"}
    wanted = tables.images_of(found, spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert {r.id: r.content and bytes(r.content) for r in wanted.collect()} == {"a": b"a.jpg", "zz": None}


def test_labels_round_trip(spark, tmp_path):
    df = spark.createDataFrame([([[0.1, 0.2], [0.3, 0.4], [0.5, 0.6], [0.7, 0.8]],)], "corners array<array<double>>")
    lines = tables.corner_labels(df).select("value")
    assert lines.first().value == "0 0.100000 0.200000 0.300000 0.400000 0.500000 0.600000 0.700000 0.800000"
    lines.write.text(str(tmp_path / "labels"))
    assert list(tables.read_corner_labels(spark, str(tmp_path / "labels")).first().corners) == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
    (tmp_path / "l.json").write_text(json.dumps({"x.jpg": {"corners_normalized": [[0, 0], [1, 0]]}, "y.jpg": {}}))
    assert {r.file: r.corners for r in tables.label_map(spark, str(tmp_path / "l.json")).collect()} == {"x.jpg": [[0, 0], [1, 0]], "y.jpg": None}


def test_required_files(spark, tmp_path):
    (tmp_path / "here").write_text("x")
    sinks.require(spark, [str(tmp_path / "here")])
    with pytest.raises(FileNotFoundError, match="gone"):
        sinks.require(spark, [str(tmp_path / "here"), str(tmp_path / "gone")])


def test_index_and_embeddings_round_trip(spark, tmp_path):
    rows = [(1, "art", -1, 2**63 - 1, 2), (2, "whole", 0, 5, None)]
    sinks.write_hash_index(spark.createDataFrame(rows, "card_idx long, side string, phash long, dhash long, frame_class int"), str(tmp_path / "index"))
    got = sinks.read_hash_index(spark, str(tmp_path / "index"), "art").first()
    assert (got.card_idx, got.phash, got.dhash, got.frame_class) == (1, -1, 2**63 - 1, 2)
    sinks.write_embeddings(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "card_idx long, embedding array<double>"), str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert dict(back.dtypes)["embedding"] == "array<float>" and {r.card_idx: [round(x, 5) for x in r.embedding] for r in back.collect()} == {1: [0.6, 0.8], 2: [0, 0]}


def test_replace_reads_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "cache")
    sinks.replace(spark.range(3), path)
    sinks.replace(spark.read.parquet(path).withColumn("id", F.col("id") + 10), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    with pytest.raises(Exception, match="no"):
        sinks.replace(spark.read.parquet(path).withColumn("id", F.raise_error(F.lit("no"))), path)
    assert spark.read.parquet(path).count() == 3 and tables.cached(spark, path, "id", [11, 99]).count() == 1


def test_reports_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("easy", "modern", 3, 2), ("hard", "special", 1, 0)], "difficulty string, frame_class string, n long, hash_top1 long")
    samples = spark.createDataFrame([("easy", "modern", f"p{i}", i > 0) for i in range(3)], "difficulty string, frame_class string, image_path string, hash_correct boolean")
    sinks.write_json(sinks.nested(cells, samples, ["difficulty", "frame_class"], 2), str(tmp_path / "r"))
    got = {r.difficulty: r for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert got["easy"].result.n == 3 and [s.image_path for s in got["easy"].samples] == ["p0", "p1"] and got["hard"].samples == []
    found = spark.createDataFrame([("a", True, 0.9), ("b", False, 0.1)], "file string, detected boolean, best_conf double")
    assert tuple(sinks.summary(found, "w.pt", 0.25).first()) == ("w.pt", 2, 1, 0.5, 0.25)
    assert tuple(sinks.summary(found.filter("false"), "w.pt", 0.25).first()) == ("w.pt", 0, 0, 0.0, 0.25)
    for run in ("r1", "r2"):
        sinks.log_metrics(spark.createDataFrame([(1, 0.5, None), (2, 0.4, 0.9)], "epoch int, loss double, acc double"), str(tmp_path / "m"), run, F.col("epoch"), ["loss", "acc"])
    assert spark.read.parquet(str(tmp_path / "m")).count() == 6


def test_folder_stream_takes_new_files_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for n in (2, 3):
        spark.range(n).write.mode("append").parquet(source)
        each_batch(spark, source, "id long", lambda df: df.withColumn("twice", F.col("id") * 2), out, mark).awaitTermination()
    assert sorted(r.twice for r in spark.read.parquet(out).collect()) == [0, 0, 2, 2, 4]


def test_knn_in_blocks_equals_broadcast(spark, monkeypatch):
    from lodestar.operators import retrieval as R

    rows = spark.range(300).select(F.col("id").alias("vec_id"), (F.col("id") % 5).alias("label"), F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1))).alias("hash"))
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("hash").alias("query_hash"))
    at_once = sorted(map(tuple, R.knn(asked, rows, 7, keep=("label",)).collect()))
    for name, most in (("QUERIES", 4), ("QUERY_BYTES", 300)):
        with monkeypatch.context() as m:
            m.setattr(R, name, most)
            assert sorted(map(tuple, R.knn(asked, rows, 7, keep=("label",)).collect())) == at_once and len(at_once) == 15 * 7
    assert R.knn(asked.filter("query_id < 0"), rows, 7).count() == R.knn(asked, rows.filter("vec_id < 0"), 7).count() == 0
