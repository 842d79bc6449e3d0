"""Vector codes and nearest neighbours against plain versions, on awkward rows."""

import hashlib
import math

import numpy as np
import pytest

from tickloom.llm import codes, neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string, rank string, score string, query_id string"


def vectors(spark, rows):
    """Rows (vec_id, embedding, label), with columns whose names the operators also give to their results."""
    return spark.createDataFrame([(i, v, label, "c", "e", "r", "s", "q") for i, v, label in rows], SCHEMA)


def awkward(n=400, d=16, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, d)) * rng.choice([0.1, 1, 3], (n, 1)), 2).astype(np.float32)
    x[40:80] = x[40]  # copies
    x[100:140] = x[100] + rng.standard_normal((40, d)).astype(np.float32) * 0.01
    rows = [(k * 5, v.tolist(), [None, 1, 2][k % 3]) for k, v in enumerate(x)]
    bad = [(901, None, 1), (902, [1.0] * 3 + [None] + [1.0] * (d - 4), 1), (903, [math.nan] * d, 2), (904, [math.inf] + [0.0] * (d - 1), None), (905, [], 1), (907, [1.0] * (d + 1), 1)]
    return [*rows, *bad, (920, [0.0] * d, None), rows[3], rows[40], (60, x[7].tolist(), 1)]


def usable(rows, d):
    return [r for r in rows if r[1] is not None and len(r[1]) == d and all(v is not None and math.isfinite(v) for v in r[1])]


def plain_codes(rows, d, parts, entries, rounds):
    rows = usable(rows, d)
    wide = -(-d // parts)
    whole = [[[math.floor(4096 * float(np.float32(v))) for v in r[1]] for r in rows][k] + [0] * (wide * parts - d) for k in range(len(rows))]
    split = [[tuple(v[p * wide : (p + 1) * wide]) for p in range(parts)] for v in whole]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0], rows[k][1]))[:entries]
    books = [[split[k][p] for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for s in split:
                got.setdefault(near(s[p], books[p]), []).append(s[p])
            books[p] = [tuple(sum(c) // len(got[e]) for c in zip(*got[e], strict=True)) if e in got else books[p][e] for e in range(len(books[p]))]
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    out = []
    for r, s in zip(rows, split, strict=True):
        code = [near(s[p], books[p]) for p in range(parts)]
        out.append((r[0], r[2], code, sum(far(s[p], books[p][e]) for p, e in enumerate(code)), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("d,parts,entries", [(16, 8, 16), (10, 4, 3), (5, 8, 1)])
def test_codes(spark, d, parts, entries):
    rows = awkward(d=d)
    got = codes.encode(vectors(spark, rows).repartition(3), parts, entries, 4).select("vec_id", "label", "code", "error", "codebooks_sha256").collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_codes(rows, d, parts, entries, 4)


def test_heaps_measure_only_what_drift_has_reached(spark):
    """Rounds pop ever fewer parts, and what they leave is nearest all the same."""
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((1500, 4)) + 8 * rng.integers(0, 5, (1500, 1))) * 400
    x = x.astype(np.int64)
    block = codes.Block(x, 1, np.full((1500, 1), -1, np.int16), [[[(-math.inf, r) for r in range(1500)]] + [[] for _ in range(4)]])
    book, drift, popped = x[[0, 1, 2, 3, 4]][None].copy(), np.zeros((1, 5)), []
    measured = codes.measured
    codes.measured = lambda part, b: (popped.append(len(part)), measured(part, b))[1]
    try:
        for _ in range(6):
            block.advance(book, drift, 1e-6)
            assert (block.entry[:, 0] == measured(x, book[0])[0]).all()
            new = np.array([[x[block.entry[:, 0] == e].sum(axis=0) // max((block.entry[:, 0] == e).sum(), 1) for e in range(5)]])
            moved = np.sqrt(((new - book).astype(float) ** 2).sum(axis=2))
            drift = drift + moved + np.array([[np.delete(moved[0], e).max() for e in range(5)]])
            book = new
    finally:
        codes.measured = measured
    assert popped[0] == 1500 and sum(popped[-2:]) < 1500


def test_codes_group_errors_and_empty_tables(spark):
    rows = awkward()
    got = codes.with_group_error(codes.encode(vectors(spark, rows))).collect()
    want = {}
    for r in got:
        want[r["label"]] = want.get(r["label"], 0) + r["error"]
    assert len(got) == len(usable(rows, 16)) and all(r["label_error"] == want[r["label"]] for r in got)
    assert codes.encode(vectors(spark, [])).count() == 0
    assert codes.encode(vectors(spark, [(1, None, 2), (2, [math.nan], 3)])).count() == 0
    huge = codes.encode(vectors(spark, [(1, [3e38] * 8, 2), (2, [-3e38] * 8, 3)]), 8, 1, 1).collect()
    assert len(huge) == 2 and all(r["error"] > 0 for r in huge)


def plain_neighbours(rows, d, k):
    rows = list({(r[0], tuple(r[1])) for r in usable(rows, d) if r[0] is not None and any(r[1])})
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            s = sorted((-float((np.array(q, np.float32).astype(float) * np.array(v, np.float32).astype(float)).sum()), j) for j, v in rows if j != i)
            out.setdefault(i, []).append([(j, -x) for x, j in s[:k]])
    return out


@pytest.mark.parametrize("shard_rows", [64, 16_384])
def test_neighbours(spark, shard_rows):
    rows = [*awkward(), (None, [1.0] * 16, 1)]
    got = {}
    for r in neighbours.search(vectors(spark, rows).repartition(3), k=20, shard_rows=shard_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = plain_neighbours(rows, 16, 20)
    assert set(got) == set(want)
    found = total = 0
    for i, lists in want.items():
        if len(lists) == 1:
            assert [x[0] for x in sorted(got[i])] == list(range(1, len(got[i]) + 1)) and len(got[i]) <= 20
            pairs = [(v, s) for _, v, s in sorted(got[i])]
            assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))
            found, total = found + len(set(pairs) & set(lists[0])), total + len(lists[0])
    assert found / total >= 0.9
    # Copies are equally near, and the smaller ids come first.
    copy = [v for _, v, _ in sorted(got[240])]
    assert 240 not in copy and [v for v in copy if 200 <= v < 400] == sorted(v for v in copy if 200 <= v < 400)


def test_neighbours_of_few_and_none(spark):
    assert neighbours.search(vectors(spark, [])).count() == 0
    assert neighbours.search(vectors(spark, [(20, [1.0, 0.0], 1)])).count() == 0
    assert neighbours.search(vectors(spark, [(20, [0.0, 0.0], 1), (21, [1.0, 0.0], 1)])).count() == 0
    got = neighbours.search(vectors(spark, [(20, [1.0, 0.0], 1), (21, [1.0, 0.0], 1), (22, [0.5, 0.5], 1), (20, [1.0, 0.0], 1)])).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 21, 1.0), (20, 2, 22, 0.5)]
