import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from granaria.functions import bits, hashing, paths, rates, tags, text, vectors


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, None), ("", None), (" UNKNOWN\t", None), ("Not_Available", None), ("\tTrain ", "train"), (unicodedata.normalize("NFD", "Kệ_Lạnh "), "kệ_lạnh"), ("Straße", "strasse"), (" ", None)],
)
def test_identity(spark, raw, want):
    assert one(spark, raw, text.identity) == want


@pytest.mark.parametrize(("raw", "want"), [(None, None), ("", None), ("  ", None), (" RAW\\Táo/1.JPG", "raw/táo/1.jpg"), ("unknown", "unknown")])
def test_path_key(spark, raw, want):
    assert one(spark, raw, text.path_key) == want


def test_identity_in_group_by(spark):
    df = spark.createDataFrame([("Kệ",), (None,), ("kệ ",)], "c string")
    got = df.select(text.identity(F.col("c")).alias("k")).groupBy("k").count().collect()
    assert {(r["k"], r["count"]) for r in got} == {("kệ", 2), (None, 1)}


@pytest.mark.parametrize(("raw", "want"), [(None, False), ("", False), ("none", False), ("Unassigned", False), ("x", True)])
def test_known(spark, raw, want):
    assert one(spark, raw, text.known) is want


def test_strict_bool(spark):
    assert one(spark, " TRUE", text.strict_bool) is True
    assert one(spark, "", text.strict_bool) is None
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, "yes", text.strict_bool)


@pytest.mark.parametrize(("p", "ok"), [("a/b.jpg", True), ("", False), (None, False), ("../a.jpg", False), ("C:/a.jpg", False), ("/a.jpg", False), ("a.jpg:stream", False), ("a\x00b", False), ("a\\..\\b", False), ("a..b/c", True)])
def test_safe_path(spark, p, ok):
    assert one(spark, p, paths.is_safe) is ok


def test_prefix_and_labels(spark):
    assert one(spark, "Data/Raw/apple/fresh/1.jpg", lambda c: paths.strip_prefix(c, "data/raw")) == "apple/fresh/1.jpg"
    assert one(spark, "data/raw", lambda c: paths.strip_prefix(c, "data/raw")) is None
    assert tuple(one(spark, "x/apple/fresh/1.jpg", paths.folder_labels)) == ("apple", "fresh")
    assert one(spark, "1.jpg", paths.folder_labels) is None
    assert tuple(one(spark, "other/fruit/kiwi/1.jpg", paths.other_category)) == ("other_fruit", "kiwi")
    assert one(spark, "apple/1.jpg", paths.other_category) is None
    assert one(spark, "v1/abc123.def.jpg", paths.asset_digest) == "abc123"
    assert one(spark, "root/raw/apple/fresh/1.jpg", lambda c: paths.below_root(c, "root/raw")) == "apple/fresh/1.jpg"


@pytest.mark.parametrize(
    ("name", "kind", "family", "agrees"),
    [
        ("rotated_by_15_Screen Shot 2018 at 1.png", "offline_augmentation", "screen::screen shot 2018 at 1", True),
        ("Screen Shot  2018.png", "candidate_original", "screen::screen shot 2018", True),
        ("freshApple (12).jpg", "candidate_original", "numbered::freshapple (12)", True),
        ("rottenApple (12).jpg", "candidate_original", "numbered::rottenapple (12)", False),
        ("Banana__Healthy_augmented_3.jpg", "offline_augmentation_unknown_parent", "", True),
        ("img.jpg", "unrecognized_filename", "", True),
    ],
)
def test_file_kind(spark, name, kind, family, agrees):
    r = one(spark, f"a/{name}", lambda c: paths.file_kind(c, F.lit("apple"), F.lit("fresh")))
    assert (r["kind"], r["family"], r["agrees"]) == (kind, family, agrees)


def test_hash_bucket_is_unsigned(spark):
    for g in ("a", "b", "group 7", "ü"):
        want = int(hashlib.sha256(f"42:{g}".encode()).hexdigest()[:16], 16) % 5
        assert one(spark, g, lambda c: hashing.bucket(c, 42, 5)) == want


def test_pixel_digest(spark):
    want = hashlib.sha256(b"RGB:1:1:abc").hexdigest()
    assert one(spark, bytearray(b"abc"), lambda c: hashing.pixel_digest(F.lit(1), F.lit(1), c), "binary") == want


def test_bits(spark):
    assert one(spark, "7fffffffffffffff", bits.parse_hex63) == (1 << 63) - 1
    assert one(spark, "8000000000000000", bits.parse_hex63) is None
    assert one(spark, "xyz", bits.parse_hex63) is None
    assert one(spark, 255, bits.to_hex63, "long") == "00000000000000ff"
    assert sum(w for _, w in bits.block_layout(6)) == 63


def test_rates(spark):
    df = spark.createDataFrame([(1, 0)], "a int, b int").select(rates.ratio(F.col("a"), F.col("b")).alias("r"), rates.safe_div(F.col("a"), F.col("b")).alias("s")).first()
    assert df["r"] is None
    assert df["s"] == 0.0


def test_vectors(spark):
    v = [0.2, 0.4, 0.4, 0.0]
    kind = "array<double>"
    assert one(spark, v, vectors.argmax, kind) == 1
    assert one(spark, v, vectors.argmax_last, kind) == 2
    assert one(spark, v, vectors.margin, kind) == 0.0
    assert one(spark, [3.0, 4.0], vectors.l2, kind) == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], vectors.l2, kind) == [0.0, 0.0]
    assert abs(sum(one(spark, [1000.0, -1000.0, 3.0], vectors.softmax, kind)) - 1) < 1e-12
    assert one(spark, [0.25] * 4, lambda c: F.round(vectors.certainty(c, 4), 12), kind) == 0.0
    for bad in ([0.5, 0.4], [1.5, -0.5], [float("nan"), 1.0], None, [1.0]):
        assert one(spark, bad, lambda c: vectors.is_distribution(c, 2), kind) is False
    assert one(spark, [0.5, 0.5], lambda c: vectors.is_distribution(c, 2), kind) is True


def test_tags(spark):
    assert one(spark, "a;;NONE;b", tags.split_tags) == ["a", "b"]
    assert one(spark, None, tags.split_tags) == []
    assert one(spark, "dark", lambda c: tags.hard_case_tags({"lighting": c, "blur": F.lit(None)})) == "low_light"
    assert one(spark, "?", lambda c: tags.hard_case_tags({"lighting": c})) == "UNKNOWN"
    assert one(spark, '[{"distance": 3, "reference": "b"}, {"distance": 1, "reference": "a"}]', tags.parse_matches)[0]["reference"] == "a"
    assert one(spark, '[{"distance": 3, "refer', tags.parse_matches) in (None, [])
