import pytest

from granaria.llm import residue as rs

PROSE = [
    "The shaded side of the apple turned brown near the stem after two days in the cold room.",
    "Our labeller kept the fresh label of the banana, and the weight card reads 395 grams.",
    "Sau 382 giờ dưới đèn chớp, hai quả cà chua vẫn giữ vỏ bóng dù có vết nứt nhỏ.",
    "Con el teléfono fijo a 489 cm, una pieza de naranja blanda perdió unos 675 gramos.",
    "During the Monday round the lower half of the bin came out blurred except for the stem.",
]
CASES = {
    "Please enable JavaScript to see the pictures.": True,
    "Home | Albums\nInternal server error. Please try again later.": True,
    "Session A12-345 summary\nLorem ipsum dolor sit amet, consectetur adipiscing elit.": True,
    "zzz zzz zzz zzz zzz zzz": True,
    "-----------\nTODO TODO TODO": True,
    "VUI LÒNG BẬT JAVASCRIPT ĐỂ XEM TRANG.": True,
    "We use cookies. Accept cookies to continue.": True,
    " ".join(PROSE): False,
    " ".join(PROSE) + ' The error "access denied" appeared on the lab tablet twice, which cost ten minutes.': False,
    " ".join(PROSE) + " Dear {{owner}}, your tray was received.": True,
    PROSE[0] + " This sample belongs to [INSERT OWNER].": True,
    PROSE[0] + " The form uses {{owner}} as its merge field, and the exporter fills it before saving.": False,
    PROSE[0] + ' Reviewers never leave "[INSERT OWNER]" in the column.': False,
    PROSE[0] + " Class names are written as {fruit}::{status} in every sheet.": False,
    PROSE[1].replace("banana", "<b>banana</b>") + " <i>seen</i>": False,
    PROSE[1].replace("banana", "<owner>"): True,
    "Reviewer: ____": True,
    "": False,
    None: False,
    "Home | Albums | Sign in": False,
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, t) for i, t in enumerate([*CASES, *[p + " " + q for p in PROSE for q in PROSE] * 8])]
    out = rs.judge(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return {r["doc_id"]: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(judged, i):
    text = list(CASES)[i]
    assert judged[i]["is_residue"] is CASES[text], (text, judged[i])


def test_long_text_in_pieces(spark, monkeypatch):
    model = rs.fit(spark.createDataFrame([(i, p) for i, p in enumerate(PROSE)], "doc_id long, text string"))
    text = (" ".join(PROSE) + " Please enable JavaScript to view this page. " * 9 + "zzz zzz zzz zzz zzz ") * 20
    part = rs.fold_all([text])[0]
    whole = rs.tally_long(part, model)
    assert (rs.tally([part], model)[0] == whole).all()
    monkeypatch.setattr(rs, "PIECE", 97)
    assert (rs.tally_long(part, model) == whole).all()


def test_folding():
    texts = ["", "  Ảnh\n chụp  12,5 Đỏ ", "ﬁn\u00a0Straße e\u0301", "\U0001f34e x", "\n", "a" * 5]
    got = [p.tobytes().decode("utf-32-le") for p in rs.fold_all(texts)]
    assert got == ["", "anh chup 00,0 do ", "fn straße e", "\U0001f34e x", "", "aaaaa"]
    assert rs.fold_all(["A\n b. c"], lines=True)[0].tobytes().decode("utf-32-le") == "a\nb. c"
    assert rs.fold_all([]) == []


def test_screening_loses_nothing(spark):
    """Texts that the greatest ratio screens out could not reach the coverage by kinds."""
    import random

    model = rs.fit(spark.createDataFrame([(i, p) for i, p in enumerate(PROSE)], "doc_id long, text string"))
    r = random.Random(1)
    bits = [*PROSE, *[p for kind in (rs.seeds.ERRORS, rs.seeds.NOTICES, rs.seeds.FILLER) for p in sum(rs.seeds.phrases(kind), [])[::97]]]
    texts = [" ".join(r.sample(bits, r.randint(1, 4))) for _ in range(120)]
    parts = rs.fold_all(texts)
    for screened, part in zip(rs.shares(rs.tally(parts, model)).sum(1), parts, strict=True):
        full = rs.shares(rs.tally_long(part, model)[None]).sum()
        assert screened == pytest.approx(full) if full >= rs.COVERAGE else screened in (0, pytest.approx(full))


def test_unseen_wordings(spark, sf):
    """Wordings that no seed holds; prose about such things stays prose."""
    import unseen_residue as unseen

    third = sum(unseen.THIRD.values(), ())
    drawn = {p for kind in (rs.seeds.ERRORS, rs.seeds.NOTICES, rs.seeds.FILLER) for p in sum(rs.seeds.phrases(kind), [])}
    assert not {*third} & drawn
    model = rs.fit(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet"))
    found = lambda texts: sum(sum(rs.residue_shares(t, model).values()) >= rs.COVERAGE for t in texts)
    assert found(unseen.FIRST + unseen.SECOND) >= 0.9 * len(unseen.FIRST + unseen.SECOND)
    assert found(third) >= 0.9 * len(third)
    assert not found(unseen.PROSE)


def test_labelled_sample_is_bounded():
    for kind in (rs.seeds.ERRORS, rs.seeds.NOTICES, rs.seeds.FILLER, rs.seeds.FRAME, rs.seeds.MENTIONS, rs.seeds.LEFT):
        drawn = rs.seeds.phrases(kind)
        assert all(len(d) <= rs.seeds.DRAWN for d in drawn) and sum(map(len, drawn)) <= rs.seeds.LIMIT


def test_text_may_be_kept(spark):
    docs = spark.createDataFrame([(1, PROSE[0], "en"), (2, "Please enable JavaScript.", None), (3, None, "vi")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["text"], r["lang"], r["is_residue"]) for r in rs.judge(docs, "text", "lang").collect()}
    assert got == {1: (PROSE[0], "en", False), 2: ("Please enable JavaScript.", None, True), 3: (None, "vi", False)}


@pytest.mark.parametrize(
    ("page", "heading"),
    [
        ("Sorry, this album cannot be displayed at the moment. Please refresh the page or contact support.", False),
        ("The page failed to load. Try again later or contact the administrator.", True),
    ],
)
def test_frequent_residue_stays_residue(spark, page, heading):
    """One page that holds a third of the rows, as it is or below a heading of its own, is no prose."""
    rows = [p + " " + q for p in PROSE for q in PROSE] * 80
    third = [f"Notes for {chr(65 + i % 26)}{chr(65 + i // 26 % 26)}1-204\n{page}" if heading else page for i in range(len(rows) // 2)]
    out = rs.judge(spark.createDataFrame(list(enumerate([*rows, *third])), "doc_id long, text string").repartition(4))
    marked = {r["doc_id"] for r in out.where("is_residue").collect()}
    assert marked == set(range(len(rows), len(rows) + len(third)))


def test_empty(spark):
    assert rs.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
