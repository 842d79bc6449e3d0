import random

import numpy as np
import pytest

from tests.llm.data import awkward, prose, table
from tickloom.llm.graph import components
from tickloom.llm.near_dedup import _compare, deduplicate, near_duplicates, odd_sketches
from tickloom.llm.shared import Scratch


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and find(j) == find(i) and rows[j][0] is not None] if sets[i] else [doc]
        least = min((x for x in ids if x is not None), default=None)
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def copies(seed, groups=12):
    """Groups of near copies about the threshold, exact copies, and a passage that many share."""
    rng = random.Random(seed)
    passage, rows = prose(rng, 40), []
    for _ in range(groups):
        words = prose(rng, rng.randrange(12, 120)).split()
        for _ in range(rng.randrange(1, 9)):
            new = list(words)
            for _ in range(rng.randrange(0, 4)):
                new[rng.randrange(len(new))] = prose(rng, 1)
            rows.append(" ".join(new))
    rows += [prose(rng, 30) + " " + passage for _ in range(25)] + rows[:6]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_awkward_rows(spark):
    assert result(near_duplicates(table(spark))) == brute(awkward())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = copies(seed)
    if seed == 2:  # a large group of copies at all distances, most of them not linked with each other
        rng = random.Random(5)
        base = prose(rng, 60).split()
        for _ in range(60):
            n = rng.randrange(0, 8)
            rows.append((len(rows), " ".join(prose(rng, 1) if k in set(rng.sample(range(60), n)) else w for k, w in enumerate(base))))
    assert result(near_duplicates(table(spark, rows))) == brute(rows)


def test_empty(spark):
    assert near_duplicates(table(spark, [])).count() == 0


def test_deduplicate_keeps_rows_and_columns(spark):
    docs = table(spark)
    got = deduplicate(docs)
    assert got.columns == docs.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=str)
    want = [0, 1, 2, 3, 5, 8, 9, 10, 11, 12, None]
    assert ids == sorted(want, key=str)


def test_deduplicate_keeps_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 1, "x", "r"), (2, "a b c d e f g", 2, "y", "s"), (3, None, None, None, None), (2, "other words than these are", 3, "z", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, nth int, key string, row string")
    got = deduplicate(docs)
    assert got.schema == docs.schema and sorted(map(tuple, got.collect()), key=str) == sorted((rows[0], rows[2], rows[3]), key=str)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(200, 100 + k) for k in range(40)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(40)]
    with Scratch(spark, "test") as scratch:
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch, "t").collect()}
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(len(label)):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    groups = {}
    for n, r in label.items():
        groups.setdefault(r, set()).add(n)
    found = {}
    for n, r in got.items():
        found.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    for same in (0.6, 0.75, 0.9):
        a = rng.integers(0, 2**32, (200, 256), dtype=np.uint32)
        b = np.where(rng.random((200, 256)) < same, a, rng.integers(0, 2**32, (200, 256), dtype=np.uint32))
        x, y = (odd_sketches(m).view(np.uint64) for m in (a, b))
        z = np.bitwise_count(x ^ y).sum(axis=1)
        estimate = 1 + 512 / (4 * 256) * np.log(1 - 2 * z / 512)
        assert abs(estimate.mean() - same) < 0.02 and estimate.std() < 0.06


def test_row_limit_marks_what_it_left(spark):
    import pyarrow as pa

    n = 6
    sketch = [b"\0" * 64] * n
    batch = pa.RecordBatch.from_pydict({"band": [1] * n, "kind": [0] * n, "i": [0] * n, "j": [0] * n, "node": list(range(n)), "comp": list(range(n)), "n": [10] * n, "fb": [0] * (n - 1) + [-1], "major": [False] * (n - 1) + [True], "sketch": sketch})
    paired = [r for b in _compare(75, 10, None, True)(iter([batch])) for r in b.to_pylist()]
    assert len(paired) == n - 1  # one medoid for all
    every = [r for b in _compare(75, 10, None)(iter([batch])) for r in b.to_pylist()]
    some = [r for b in _compare(75, 10, 1)(iter([batch])) for r in b.to_pylist()]
    assert len(every) == n * (n - 1) // 2 and any(r["more"] for r in some)
