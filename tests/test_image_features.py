"""Features against their definitions, worked out pixel by pixel or in one plain step."""

import re

import numpy as np
import pytest

from granaria.operators import images as im
from granaria.plans import modelling


def pictures():
    r = np.random.default_rng(5)
    y, x = np.mgrid[:64, :64]
    disc = np.where(((y - 30) ** 2 + (x - 35) ** 2 <= 200)[..., None], (190, 60, 40), (230, 225, 215)) + r.normal(0, 6, (64, 64, 3))
    return [disc.clip(0, 255).astype(np.uint8), r.integers(0, 256, (40, 90, 3)).astype(np.uint8), np.full((224, 224, 3), 128, np.uint8), np.full((1, 3, 3), 255, np.uint8), r.integers(0, 256, (500, 300, 3)).astype(np.uint8)]


def dense_letterbox(rgb):
    fit = 224 / max(rgb.shape[:2])
    h, w = (max(1, round(n * fit)) for n in rgb.shape[:2])
    whole = np.einsum("yv,vuc,xu->yxc", im._resampling(rgb.shape[0], h), rgb.astype(float), im._resampling(rgb.shape[1], w), optimize=True)
    out = np.full((224, 224, 3), 255, np.uint8)
    out[(224 - h) // 2 :, (224 - w) // 2 :][:h, :w] = np.rint(whole).clip(0, 255)
    return out


def plain_colour(rgb):
    hsv, lab = im.to_hsv(rgb).reshape(-1, 3), ((im.to_lab(rgb) + (0, 128, 128)) / (100, 255, 255)).clip(0, 1).reshape(-1, 3)
    counts = [np.bincount(np.minimum((x[:, k] * n).astype(int), n - 1), minlength=n) / len(x) for x, n in ((hsv, 24), (lab, 16)) for k in range(3)]
    return np.concatenate([*counts, np.vstack([hsv.mean(0), hsv.std(0), np.quantile(hsv, (0.1, 0.9), axis=0)]).T.ravel()])


def plain_texture(gray):
    turn = 2 * np.pi * np.arange(16) / 16
    ring = np.stack([np.roll(gray, (round(-2 * np.sin(a)), round(2 * np.cos(a))), (0, 1)) >= gray for a in turn])
    pattern = np.bincount(np.where((ring != np.roll(ring, -1, 0)).sum(0) <= 2, ring.sum(0), 17).ravel(), minlength=18)
    edges = im.gradient_strength(gray)
    cut = np.percentile(edges, 75)
    return np.concatenate([pattern / gray.size, [(edges >= cut).mean() if cut > 0 else 0, edges.mean() / 255, edges.std() / 255]])


def plain_gradients(gray):
    gy, gx = np.gradient(gray / 255)
    way = np.floor(np.degrees(np.arctan2(gy, gx)) % 180 / 20).astype(int) % 9
    cells = np.array([[np.bincount(way[y : y + 16, x : x + 16].ravel(), np.hypot(gx, gy)[y : y + 16, x : x + 16].ravel(), 9) for x in range(0, 224, 16)] for y in range(0, 224, 16)])
    out = []
    for y in range(13):
        for x in range(13):
            block = cells[y : y + 2, x : x + 2].ravel()
            block = np.minimum(block / np.sqrt((block**2).sum() + 1e-6), 0.2)
            out.append(block / np.sqrt((block**2).sum() + 1e-6))
    return np.concatenate(out)


def test_features_follow_their_definitions():
    lookup = im.Lookup()
    for rgb in pictures():
        box = im.letterbox(rgb, lookup=lookup)
        assert (box == dense_letterbox(rgb)).all()
        gray = im.luma(box)
        assert (gray == im.luma(np.ascontiguousarray(box))).all()
        assert im.colour(box, lookup) == pytest.approx(plain_colour(box), abs=1e-9)
        assert im.texture(gray) == pytest.approx(plain_texture(gray), abs=1e-9)
        assert im.oriented_gradients(gray) == pytest.approx(plain_gradients(gray), abs=1e-9)
        whole = np.concatenate([im.colour(box), im.texture(gray), im.shape(box), im.oriented_gradients(gray)])
        assert (im.feature_vector(rgb, lookup=lookup) == whole).all()
        assert (im.feature_vector(rgb) == whole).all()


def test_hsv_by_colorsys():
    import colorsys

    rgb = np.random.default_rng(2).integers(0, 256, (400, 3)).astype(np.uint8)
    rgb[:8] = [[0, 0, 0], [255, 255, 255], [7, 7, 7], [9, 9, 2], [9, 2, 9], [2, 9, 9], [255, 0, 1], [255, 0, 0]]
    assert im.to_hsv(rgb).ravel() == pytest.approx(np.ravel([colorsys.rgb_to_hsv(*p / 255) for p in rgb]), abs=1e-12)


def test_invariants_by_complex_moments_and_none_of_a_symmetric_mask():
    mask = np.random.default_rng(4).random((60, 80)) < np.linspace(0, 1, 80)
    at = np.argwhere(mask)
    z = (at - at.mean(0)) @ (1j, 1)
    c = lambda p, q: np.sum(z**p * z.conj() ** q) / len(z) ** (1 + (p + q) / 2)
    cubed = c(3, 0) * c(1, 2) ** 3
    want = [c(1, 1).real, abs(c(2, 0)) ** 2, abs(c(3, 0)) ** 2, abs(c(1, 2)) ** 2, cubed.real, (c(2, 0) * c(1, 2) ** 2).real, cubed.imag]
    assert im.hu_invariants(mask) == pytest.approx(want, rel=1e-6, abs=1e-24)
    # what cancels is nothing: a rounding error there would come out as plus or minus 30
    ellipse = im.shape(np.full((224, 224, 3), 255, np.uint8))
    assert (ellipse[7:] == 0).all()
    half = np.zeros((40, 61), bool)
    half[5:30, 20:41] = half[30:35, 10:51] = True
    assert im.hu_invariants(half)[6] == 0


def test_a_colour_is_worked_out_once(monkeypatch):
    met = []
    lab = im._lab
    monkeypatch.setattr(im, "_lab", lambda planes: met.append(planes[0].size) or lab(planes))
    lookup, rgb = im.Lookup(), pictures()[0]
    first = im.feature_vector(rgb, lookup=lookup)
    box = im.letterbox(rgb)
    assert sum(met) == len(np.unique(box.reshape(-1, 3), axis=0))
    assert (im.feature_vector(rgb, lookup=lookup) == first).all()
    assert sum(met) == len(np.unique(box.reshape(-1, 3), axis=0))
    for n in range(1, 50):
        lookup.resampling(n, 7)
    assert len(lookup.weights) <= im.Lookup.SIZES


def test_labels_travel_and_features_are_not_shuffled(spark, sf):
    df = modelling.image_features(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert len(re.findall("Exchange", plan)) == 1
    assert plan.count("MapIn") == 1 and plan.index("MapInArrow") < plan.index("Exchange")  # a plan is printed from its end
    rows = df.select("id", "path", "fruit", "status", "group_id").collect()
    want = spark.read.parquet(f"{sf}/camera_manifest.parquet").selectExpr("camera_id", "path", "fruit", "status").distinct().collect()
    assert sorted(tuple(map(str, r[:4])) for r in rows) == sorted(tuple(map(str, r)) for r in want)


def test_rows_that_share_a_picture_and_rows_without(spark):
    ids = spark.createDataFrame([(None, "d"), (7, "a"), (7, "b"), (None, "c"), (2, None)], "id long, label string").coalesce(1)
    drawn = im.image_features(ids, kind="float", draw=im.synthetic(20), side=20)
    assert drawn.columns == ["id", "label", "features"]
    found = {(r["id"], r["label"]): r["features"] for r in drawn.collect()}
    held = ids.join(im.synthetic_images(spark.createDataFrame([(2,), (7,)], "id long"), 20), "id", "left")
    assert {(r["id"], r["label"]): r["features"] for r in im.image_features(held, kind="float").collect()} == found
    want = im.image_features(im.synthetic_images(spark.range(7, 8), 20)).first()["features"]
    assert found[7, "a"] == found[7, "b"] == np.float32(want).tolist()
    assert found[None, "c"] is None and found[None, "d"] is None
    assert len(found[2, None]) == 6249 and found[2, None] != found[7, "a"]
    assert im.image_features(held.limit(0)).count() == 0
