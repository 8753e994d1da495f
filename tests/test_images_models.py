import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granaria.operators import images as im
from granaria.operators.models import fit_gate, kmeans_prototypes


def test_measures(spark):
    ids = spark.range(6)
    pics = im.synthetic_images(ids, 48)
    got = {r["id"]: r for r in im.measure_images(pics).collect()}
    raw = {r["id"]: r for r in pics.collect()}
    for i, r in got.items():
        a = np.frombuffer(bytes(raw[i]["pixels"]), np.uint8).reshape(48, 48, 3)
        assert r["pixel_sha256"] == hashlib.sha256(b"RGB:48:48:" + a.tobytes()).hexdigest()
        assert 0 <= r["phash63"] < 1 << 63
        g = im.luma(a)
        lap = sum(np.roll(g, s, ax) for s in (1, -1) for ax in (0, 1)) - 4 * g
        assert r["blur_wrapped"] == pytest.approx(lap.var())
        assert r["brightness"] == pytest.approx(g.mean())


def test_odd_images(spark):
    rows = [(1, None, 2, None), (2, 2, 2, bytearray(b"abc")), (3, 1, 1, bytearray(b"abc")), (4, 0, 0, bytearray(b""))]
    df = spark.createDataFrame(rows, "id long, width int, height int, pixels binary")
    got = {r["id"]: r for r in im.measure_images(df).collect()}
    assert got[1]["brightness"] is None
    assert got[2]["phash63"] is None
    assert got[3]["blur_score"] is None
    assert got[3]["brightness"] is not None
    assert im.measure_images(df.limit(0)).count() == 0
    assert {r["id"]: r["features"] is None for r in im.image_features(df.where("id != 3")).collect()} == {1: True, 2: True, 4: True}


def test_feature_contract(spark):
    v = im.image_features(im.synthetic_images(spark.range(2), 64)).collect()
    assert {len(r["features"]) for r in v} == {6249}
    a = np.random.default_rng(0).integers(0, 255, (224, 224, 3)).astype(np.uint8)
    assert [len(x) for x in (im.colour(a), im.texture(im.luma(a)), im.shape(a), im.oriented_gradients(im.luma(a)))] == [132, 21, 12, 6084]


def test_hash_bits_against_direct_transform():
    g = np.random.default_rng(4).uniform(0, 255, (32, 32))
    c = np.array([[sum(g[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) * (1 / 16) * (2**-0.5 if u == 0 else 1) * (2**-0.5 if v == 0 else 1) for v in range(8)] for u in range(8)])
    low = np.round(c, 6).ravel()[1:]
    assert im.dct_bits(g) == int("".join("1" if b else "0" for b in low > np.median(low)), 2)
    assert im.dct_bits(np.zeros((32, 32))) == 0


def test_models(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in rng.normal(3 * k, 1, 3)], bool(k)) for k in rng.integers(0, 2, 200)]
    df = spark.createDataFrame(rows, "label int, v array<double>, known boolean")
    p = kmeans_prototypes(df, "label", "v", 4).collect()
    assert len(p) == 8
    assert all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-9 for r in p)
    g = fit_gate(df, "v", "known", 3)
    from granaria.operators.decision import gate_score

    s = df.select("known", gate_score(F.col("v"), **g).alias("s"))
    assert s.where("known = (s >= 0.5)").count() >= 190
    few = kmeans_prototypes(df.limit(1), "label", "v", 4).collect()
    assert len({tuple(r["vec"]) for r in few}) == 1
    with pytest.raises(ValueError, match="known and unknown"):
        fit_gate(df.where("known"), "v", "known", 3)


def test_hu_invariants_do_not_turn_or_grow():
    y, x = np.mgrid[:60, :60]
    m = ((y - 20) ** 2 / 90 + (x - 30) ** 2 / 400 <= 1) | ((y > 25) & (y < 50) & (x > 30) & (x < 36))
    hu = im.hu_invariants(m)
    assert im.hu_invariants(np.rot90(m)) == pytest.approx(hu, abs=1e-9)
    assert im.hu_invariants(np.kron(m, np.ones((3, 3), bool))) == pytest.approx(hu, rel=0.05, abs=1e-4)
    assert im.hu_invariants(m[:, ::-1])[:6] == pytest.approx(hu[:6], abs=1e-9)
    assert im.hu_invariants(m[:, ::-1])[6] == pytest.approx(-hu[6], abs=1e-12)  # the seventh tells mirrored shapes apart


def test_lab_of_known_colours():
    a = np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0], [0, 0, 255]]], np.uint8)
    want = [[100, 0, 0], [0, 0, 0], [53.24, 80.09, 67.20], [32.30, 79.19, -107.86]]
    assert np.abs(im.to_lab(a)[0] - want).max() < 0.02
    b = np.random.default_rng(0).integers(0, 256, (20, 20, 3)).astype(np.uint8)
    assert (im.from_lab(im.to_lab(b)) == b).all()


def test_filters():
    r = np.random.default_rng(0)
    a = r.integers(90, 140, (64, 50, 3)).astype(np.uint8)
    assert im.smooth(a).astype(float).var() < a.astype(float).var()
    assert (im.smooth(a, 1) == a).all()
    with pytest.raises(ValueError, match="odd"):
        im.smooth(a, 2)
    assert im.local_contrast(a).shape == a.shape
    assert im.equalise(a[..., 0]).std() > a[..., 0].std()
    flat = np.full((16, 16), 7, np.uint8)
    assert len(np.unique(im.equalise(flat))) == 1
    box = im.letterbox(np.full((30, 60, 3), 9, np.uint8))
    assert (box[:56] == 255).all() and (box[56:168] == 9).all() and (box[168:] == 255).all()


def test_even_median_makes_even_distances():
    """63 bits against their median: at most 31 are set, and where values differ exactly 31, so distances are even."""
    r = np.random.default_rng(3)
    bits = [im.dct_bits(r.uniform(0, 255, (32, 32))) for _ in range(40)]
    assert {b.bit_count() for b in bits} == {31}
    assert all((a ^ b).bit_count() % 2 == 0 for a in bits for b in bits)
