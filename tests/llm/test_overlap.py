import itertools
import random

from granaria.llm import overlap as ov
from granaria.llm.fingerprints import turan_threes

MAN = "row_id long, path string, source string, sha256 string, split string, k string, key long"
QUAL = "path string, pixel_sha256 string, phash63 string, fp int"


def tables(spark, rows):
    m = spark.createDataFrame([(i, f"p{i}", "s", sha, split, "", 0) for i, (sha, _, _, split) in enumerate(rows)], MAN)
    q = spark.createDataFrame([(f"p{i}", pix, None if fp is None else f"{fp:016x}", 0) for i, (_, pix, fp, _) in enumerate(rows)], QUAL)
    return m.unionByName(m.limit(5)), q.unionByName(q.limit(5))


def brute(rows):
    out = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            sa, sb = (x[3].strip().lower() if x[3] else "" for x in (a, b))
            if sa == "train" and sb in ("val", "test"):
                eq = any(a[k] and b[k] and a[k] == b[k] for k in (0, 1)) or (a[2] is not None and b[2] is not None and (a[2] ^ b[2]).bit_count() <= 4)
                if eq:
                    out.add((min(i, j), max(i, j)))
    return out


def test_against_brute_force(spark):
    r = random.Random(8)
    seeds = [r.getrandbits(63) for _ in range(12)] + [0, 3]
    rows = []
    for _ in range(220):
        p = r.choice(seeds)
        for b in r.sample(range(63), r.randint(0, 4)):
            p ^= 1 << b
        sha = r.choice([None, "", "UNKNOWN", f"{r.randint(0, 50):064x}", f"{r.getrandbits(255):064x}"])
        rows.append((sha, r.choice([None, f"{r.randint(0, 80):064x}"]), r.choice([None, p, r.getrandbits(63)]), r.choice(["train", "Train ", "val", "TEST", "", None])))
    want = brute([(s if s not in ("", "UNKNOWN") else None, p, f, x) for s, p, f, x in rows])
    o = ov.find_overlap(*tables(spark, rows))
    assert {tuple(x) for x in ov.overlap_pairs(o).collect()} == want
    assert all(0 <= x["cosine"] <= 1 + 1e-9 for x in o.links.collect())
    recs = {x["row_id"] for x in ov.overlap_records(o).collect()}
    evals = {i for p in want for i in p if (rows[i][3] or "").strip().lower() in ("val", "test")}
    assert recs == evals
    assert ov.overlap_report(o).agg({"records": "sum"}).first()[0] == len(evals)


def test_every_four_blocks_hold_a_listed_three():
    assert len(ov.TERMS) == 20
    for n in range(4, 12):
        threes = turan_threes(n)
        assert all(any(set(t) <= set(four) for t in threes) for four in itertools.combinations(range(n), 4))


def test_pruning_loses_nothing_and_prunes(spark):
    # one block value in all prints, and prints that only one side has
    r = random.Random(4)
    base = [(r.getrandbits(55) << 8) & ((1 << 63) - 1) for _ in range(60)]
    near = [p ^ (1 << r.randint(0, 62)) ^ (1 << r.randint(0, 62)) ^ (1 << r.randint(0, 62)) for p in base]
    rows = [(p, True, False) for p in set(base)] + [(p, False, True) for p in set(near) - set(base)]
    df = spark.createDataFrame(rows, "fp long, in_train boolean, in_eval boolean")
    w = spark.createDataFrame([(ov.block_weights(df),)], "entries array<int>")
    lists, queries = ov.index_terms(df.where("in_train"), w, ov.IN_OTHER), ov.index_terms(df.where("in_eval"), w, ov.IN_TRAIN)
    got = [(x["fp_a"], x["fp_b"], x["dot"]) for x in ov.candidates(lists, queries).collect()]
    assert len({x[:2] for x in got}) == len(got)  # each pair once
    want = {(a, b) for a, t, _ in rows for b, _, e in rows if t and e and (a ^ b).bit_count() <= 4}
    assert want <= {x[:2] for x in got}
    assert len(got) <= 3 * len(want)  # of 3600 pairs, all of which share a block
    assert lists.count() < 20 * 60  # terms whose list is empty on the other side are left out
    entries = w.first()["entries"]
    for a, b, dot in got[:20]:
        vec = {}
        for fp in (a, b):
            blocks = [(i, fp >> 8 * i & 255) for i in range(8)]
            vec[fp] = {t: sum(entries[i * 256 + v] & 127 for i, v in t) for t in itertools.combinations(blocks, 3)}
        assert dot == sum(v for t, v in vec[a].items() if t in vec[b])


def test_empty(spark):
    o = ov.find_overlap(*tables(spark, [("a", None, None, "train")]))
    assert ov.overlap_pairs(o).count() == ov.overlap_records(o).count() == ov.overlap_report(o).count() == 0
