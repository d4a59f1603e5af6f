"""Rasters, rectification, title candidates and the model slot against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import images as I
from lodestar.functions import models as M
from lodestar.functions import titles as T
from lodestar.functions import vectors as V
from lodestar.operators import catalog as C


def rasters(spark, images):
    rows = [(i, None if x is None else bytearray(x.astype(np.uint8).tobytes()), 0 if x is None else x.shape[1]) for i, x in enumerate(images)]
    return spark.createDataFrame(rows, "id long, data binary, width int").withColumn("block", F.lit("clash"))


def test_reduction_keeps_area_means():
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 256, (96, 64))
    assert np.allclose(I.reduced(whole), whole.reshape(32, 3, 32, 2).mean((1, 3)))
    odd = rng.integers(0, 256, (45, 33))
    fine = np.repeat(np.repeat(odd, 32, 0), 32, 1)  # every part is a whole number of these
    assert np.allclose(I.reduced(odd), fine.reshape(32, 45, 32, 33).mean((1, 3)))
    assert np.allclose(I.reduced(np.full((5, 7), 9)), 9)


def test_hash_is_thresholded_cosine_sums(spark):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 256, s) for s in ((40, 50), (3, 2), (200, 31))] + [np.zeros((9, 9)), None]
    got = {r.id: (r.b, r.h) for r in I.low_frequencies(rasters(spark, images), "data", "width").select("id", F.col("block").alias("b"), V.median_hash(F.col("block")).alias("h")).collect()}
    assert got[4] == (None, None)
    for i, image in enumerate(images[:4]):
        small, want = I.reduced(image), np.zeros((8, 8))
        for u in range(8):
            for v in range(8):
                wave = np.outer(np.cos(np.pi * (2 * np.arange(32) + 1) * u / 64), np.cos(np.pi * (2 * np.arange(32) + 1) * v / 64))
                want[u, v] = (small * wave).sum() * (1 / 32 if u == 0 else 2 / 32) ** 0.5 * (1 / 32 if v == 0 else 2 / 32) ** 0.5
        assert np.allclose(np.array(got[i][0]).reshape(8, 8), want, atol=1e-3)
        flat = np.array(got[i][0])
        bits = flat > np.median(flat[1:])
        assert got[i][1] & (2**64 - 1) == int("".join("01"[int(b)] for b in bits), 2)


def test_regions_take_four_lookups(spark):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (100, 80)), np.full((100, 80), 7), rng.integers(0, 2, (100, 80)) * 255, np.zeros((3, 3)), None]
    regions = {"title": lambda h, w: I.region(h, w, I.TITLE), "type": lambda h, w: I.region(h, w, I.TYPE_LINE), "whole": I.inset}
    found = I.region_stats(rasters(spark, images), "data", "width", regions)
    got = {r.id: r for r in found.withColumn("frame", I.frame_of(F.col("title_std"), F.col("type_std"))).collect()}
    for i, image in enumerate(images[:3]):
        for name, crop in (("title", image[4:10, 4:60]), ("type", image[55:61, 4:65]), ("whole", image[3:97, 2:78])):
            assert got[i][f"{name}_n"] == crop.size
            assert np.allclose([got[i][f"{name}_mean"], got[i][f"{name}_std"]], [crop.mean(), crop.std()])
    assert [got[i].frame for i in range(5)] == ["fullart", "modern", "fullart", None, None]
    assert (got[3].title_n, got[3].title_mean, got[4].title_n) == (0, None, None)
    # what neither metadata nor the image tell is modern; metadata come first
    layout = F.when(F.col("id") == 0, "saga").cast("string")
    full = found.withColumns({"layout": layout, "full_art": F.lit(None).cast("boolean"), "border_color": F.lit(None).cast("string"), "frame_effects": F.lit(None).cast("array<string>")})
    classes = {r.id: r.c for r in full.select("id", C.frame_class(I.frame_of(F.col("title_std"), F.col("type_std"))).alias("c")).collect()}
    assert classes == {0: "special", 1: "modern", 2: "fullart", 3: "modern", 4: "modern"}


def test_a_short_last_row_is_padded(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcde")), (2, bytearray()), (3, None)], "id long, data binary").withColumn("width", I.square(F.col("data")))
    assert [r.width for r in df.orderBy("id").collect()] == [3, None, None]
    got = I.region_stats(df, "data", "width", {"all": lambda h, w: (0, h, 0, w)}).orderBy("id").collect()
    assert (got[0].all_n, got[0].all_mean) == (6, sum(b"abcde") / 6) and got[1].all_n is None and got[2].all_n is None


def test_homographies_map_corners():
    rng = np.random.default_rng(4)
    frame = np.array([[0, 0], [487, 0], [487, 679], [0, 679]])
    quads = np.array([[10, 20], [400, 5], [450, 700], [2, 650]]) + rng.uniform(-40, 40, (200, 4, 2))
    h = I.homographies(frame, quads)
    at = h @ np.concatenate([frame.T, np.ones((1, 4))])
    assert np.allclose(np.moveaxis(at[:, :2] / at[:, 2:], 1, 2), quads, atol=1e-6)
    assert np.isnan(I.homographies(frame, np.array([[[0, 0], [1, 1], [2, 2], [5, 0]]]))).all()


def test_rectified_squares(spark):
    image = [float(10 * r + c) for r in range(6) for c in range(6)]
    rows = [(1, image, [1.0, 1, 4, 1, 4, 4, 1, 4]), (2, image, [4.0, 1, 4, 4, 1, 4, 1, 1]), (3, image, [0.0, 0, 1, 1, 2, 2, 5, 0]), (4, None, [0.0] * 8), (5, image, None), (6, image, [-3.0, 0, 0, 0, 0, 3, -3, 3])]
    df = spark.createDataFrame([(i, x, p and list(map(float, p))) for i, x, p in rows], "id long, image array<double>, corners array<double>")
    got = {r.id: np.array(r.out).reshape(4, 4) for r in I.rectified(df, "image", 6, "corners", (4, 4), "out").select("id", "out").collect() if r.out}
    want = np.array(image).reshape(6, 6)[1:5, 1:5]
    assert set(got) == {1, 2, 6} and np.allclose(got[1], want) and np.allclose(got[2], np.rot90(want)) and np.allclose(got[6][:, :3], 0)


def test_candidates_feed_fuzzy_titles(spark):
    texts = spark.createDataFrame([(1, "Found: Black  Lotos today"), (2, ""), (3, None), (4, "a a a")], "id long, text string")
    found = T.candidates(texts, "id", "text")
    assert [tuple(r)[1:] for r in found.filter("id = 1").orderBy("place").collect()] == [(1, "found: black lotos"), (2, "found: black"), (3, "found:"), (4, "black lotos today"), (5, "black lotos"), (6, "black"), (7, "lotos today"), (8, "lotos"), (9, "today")]
    assert sorted(r.candidate for r in found.filter("id = 4").collect()) == ["a", "a a", "a a a"] and found.filter("id in (2, 3)").count() == 0
    names = spark.createDataFrame([(7, "Black Lotus"), (8, "Mox")], "id long, name string")
    assert [(r.candidate, r.matched, r.edits, r.id) for r in C.fuzzy_titles(found.select("candidate").distinct(), names, "candidate", "name").collect()] == [("black lotos", "black lotus", 1, 7)]


def test_predictions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "abc"[i % 3], [float(x) for x in rng.normal(i % 3, 0.4, 4)]) for i in range(90)] + [(90, "a", None), (91, None, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, label string, v array<float>")
    classes, weights, offsets = M.class_means(df, "label", "v")
    assert classes == ["a", "b", "c"]
    assert np.allclose(weights, [np.mean(np.float32([v for _, x, v in rows if x == c and v]).astype(float), 0) for c in "abc"])
    got = {r.id: r for r in M.predicted(df, "v", classes, weights, offsets, scale=2.0, batch=7).collect()}
    for i, _, v in rows:
        if v is None:
            assert (got[i]["class"], got[i].confidence) == (None, None)
            continue
        scores = 2 * (weights @ np.float32(v).astype(float) + offsets)
        shares = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
        assert got[i]["class"] == classes[shares.argmax()] and got[i].confidence == pytest.approx(shares.max())
    assert np.mean([got[i]["class"] == x for i, x, v in rows if x and v]) > 0.95
