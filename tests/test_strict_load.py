import random

import pytest

from granaria.operators.strict_load import strict_load

SHA = "a" * 64
GOOD = f"p/1.jpg,apple,fresh,shelf,g1,{SHA},train"


def parse(s):
    """Character by character."""
    s = s.removeprefix("\ufeff").removesuffix("\r")
    fields, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            i, buf = i + 1, ""
            while True:
                if i >= len(s):
                    return None
                if s[i] == '"':
                    if s[i + 1 : i + 2] == '"':
                        buf, i = buf + '"', i + 2
                        continue
                    i += 1
                    break
                buf, i = buf + s[i], i + 1
            fields.append(buf)
            if i < len(s) and s[i] != ",":
                return None
        else:
            j = i
            while j < len(s) and s[j] != ",":
                if s[j] == '"':
                    return None
                j += 1
            fields.append(s[i:j])
            i = j
        if i >= len(s):
            return fields
        i += 1


CASES = {
    GOOD: None,
    "\ufeff" + GOOD + "\r": None,
    f'"p/a, b.jpg",apple,fresh,"lab\nannex",g,{SHA},': None,
    f'"p 5"" 1.jpg","apple",fresh, "s",g,{SHA},val': "quoting",
    f'"p"/1.jpg,apple,fresh,s,g,{SHA},val': "quoting",
    f'p/1.jpg,apple,fresh,s,g,{SHA},"val': "quoting",
    f'p/1.jpg,apple,fresh,s"x,g,{SHA},val': "quoting",
    f'"",apple,fresh,s,g,{SHA},val': "value",
    "": "columns",
    None: "columns",
    '"': "quoting",
    '"" ""': "quoting",
    f"{GOOD},x": "columns",
    "a,b": "columns",
    f"p/1.jpg,mango,fresh,s,g,{SHA},val": "value",
    f"p/1.jpg,apple,fresh,s,  ,{SHA},val": "value",
    f"/p/1.jpg,apple,fresh,s,g,{SHA},val": "value",
    f"p\\..\\1.jpg,apple,fresh,s,g,{SHA},val": "value",
    f"C:/1.jpg,apple,fresh,s,g,{SHA},val": "value",
    f"p\x00/1.jpg,apple,fresh,s,g,{SHA},val": "value",
    f"p/1.jpg,apple,fresh,s,g,{SHA[:-1]},val": "value",
    f"p/1.jpg,apple,fresh,s,g,{SHA},dev": "value",
    f" p/1.jpg ,apple ,\tfresh,s,g,{SHA} ,  ": None,
    'x"' * 20000: "quoting",
    '"' + '""' * 50000 + '"' + ",b" * 5: "columns",
}


def test_reasons(spark):
    rows = [(i, t, "extra", 0) for i, t in enumerate(CASES)]
    out = strict_load(spark.createDataFrame(rows, "line_id long, raw_line string, path string, reason int"))
    got = {r["line_id"]: r["reason"] for r in out.rejected.collect()}
    assert got == {i: v for i, v in enumerate(CASES.values()) if v}
    loaded = {r["line_id"]: r for r in out.rows.collect()}
    assert set(loaded) == {i for i, v in enumerate(CASES.values()) if v is None}
    quoted = loaded[list(CASES).index(f'"p/a, b.jpg",apple,fresh,"lab\nannex",g,{SHA},')]
    assert (quoted["path"], quoted["source"], quoted["split"]) == ("p/a, b.jpg", "lab\nannex", None)


@pytest.mark.parametrize("seed", [5])
def test_dialect_against_parser(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(['"', '""', ",", "a", '",', ',"', "\n", "\x01", "\x01a"]) for _ in range(r.randint(0, 12))) for _ in range(600)]
    out = strict_load(spark.createDataFrame(list(enumerate(texts)), "line_id long, raw_line string"))
    got = {x["line_id"]: x["reason"] for x in out.rejected.collect()}
    for i, t in enumerate(texts):
        f = parse(t)
        assert got[i] == ("quoting" if f is None else "columns" if len(f) != 7 else "value"), repr(t)


def test_a_broken_delivery_of_a_good_record_is_rejected(spark):
    good = f"p/1.jpg,apple,fresh,s,g,{SHA},val"
    rows = [(1, good), (1, '"broken'), (2, good), (2, good), (3, None), (None, good), (None, "a,b")]
    out = strict_load(spark.createDataFrame(rows, "line_id long, raw_line string"))
    assert sorted((x["line_id"], x["reason"]) for x in out.rejected.collect() if x["line_id"]) == [(1, "quoting"), (3, "columns")]
    assert [x["reason"] for x in out.rejected.where("line_id is null").collect()] == ["columns"]
    assert sorted((x["line_id"] or 0) for x in out.rows.collect()) == [0, 1, 2, 2]


def test_empty(spark):
    out = strict_load(spark.createDataFrame([], "line_id long, raw_line string"))
    assert out.rows.count() == out.rejected.count() == 0
