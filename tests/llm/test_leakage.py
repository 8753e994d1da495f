import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from granaria.llm.leakage import find_leaks, plain_words

WORDS = "tray bin crate shelf apple banana táo chuối manzana naranja flash lamp stem seam grey fuzz near left-most".split()


def words(t):
    t = unicodedata.normalize("NFKD", t.lower())
    t = "".join(c for c in t if not unicodedata.combining(c)).replace("đ", "d")
    t = re.sub(r"</?[a-z][^<>]*>", "", t)
    t = re.sub(r"(?<=\w)[-‐‑–](\n(> )?)?(?=\w)", "", t)
    return re.findall(r"[^\W_]+", t)


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words(t or "")
        have = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for n, x in items:
            v = words(x or "")
            cov = {p for i in range(len(v) - 7) if tuple(v[i : i + 8]) in have for p in range(i, i + 8)}
            if cov and len(cov) * 2 >= len(v):
                out.add((d, n))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    text = lambda n: " ".join(f"{r.choice(WORDS)}" + (str(r.randint(0, 99)) if r.random() < 0.4 else "") for _ in range(n))
    items = [(i, text(r.choice([5, 8, 9, 20, 33, 60]))) for i in range(14)] + [(90, None), (91, "")]
    docs = [(0, None), (1, ""), (2, "short text")]
    for d in range(3, 70):
        parts = [text(r.randint(0, 15))]
        for _, t in r.sample(items[:14], 2):
            w = t.split()
            for _ in range(r.randint(1, 3)):
                a = r.randint(0, max(0, len(w) - 1))
                parts += [" ".join(w[a : a + r.choice([6, 7, 8, 10, 16, 40])]), text(r.randint(1, 4))]
        t = " ".join(parts)
        t = r.choice([t, t.upper(), t.replace(" ", "\n> "), t.replace("-", "‑"), re.sub(r"(\w+) (\w+)", r"<b>\1</b>, **\2**", t), unicodedata.normalize("NFD", t)])
        docs.append((d, t))
    docs += [(100, docs[5][1]), (101, docs[5][1])]
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], "doc_id long, text string, shingle string, n int")
    got = {(x["doc_id"], x["item_id"]) for x in find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items)
    assert got


def test_item_that_repeats_a_phrase(spark):
    """One shingle covers every place it has in the item."""
    phrase = "one two three four five six seven eight"
    items = [(1, " ".join([phrase] * 4)), (2, f"{phrase} {phrase} {phrase} nine ten eleven twelve thirteen fourteen fifteen sixteen")]
    docs = [(1, f"a {phrase} b"), (2, "one two three four five six seven"), (3, f"{phrase} {phrase}"), (4, "nine ten eleven twelve thirteen fourteen fifteen sixteen")]
    got = {(x["doc_id"], x["item_id"]) for x in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) == {(1, 1), (1, 2), (3, 1), (3, 2)}


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Left-\n> most  TRAY", "leftmost tray"), ("a b c", "a b c"), ("<span class=\"q\">x</span>y **z**", "xy z"), ("Quả Đỏ", "qua do"), (None, ""), ("don't stop", "dont stop"), ("[link](http://a.b/c) end", "link end"), ("co­operate", "cooperate")],
)
def test_words(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "c string").select(plain_words(F.col("c"))).first()[0] == want


def test_long_and_empty(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " * 200_000 + item), (2, "y" * 300_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [tuple(x) for x in find_leaks(docs, items).select("doc_id", "item_id").collect()] == [(1, 1)]
    assert find_leaks(docs.limit(0), items).count() == find_leaks(docs, items.limit(0)).count() == 0
