"""Importance resampling against a plain version, on awkward rows."""

import hashlib
import math
import re
import zlib

import pytest

from tests.llm.data import awkward, table
from tickloom.llm.importance import resample


def plain(docs, target, percent, least, seed=7, buckets=10_000):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [zlib.crc32(x.encode()) % buckets for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]], len(w)

    s, t = [0] * buckets, [0] * buckets
    for rows, into in ((docs, s), (target, t)):
        for _, text in rows:
            for b in features(text)[0]:
                into[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        f, n = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in out]


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


@pytest.mark.parametrize("percent,least", [(25, 20), (60, 1), (100, 0), (0, 20)])
def test_awkward_rows(spark, percent, least):
    docs = [*awkward(), (7, "A b, C-d é É ÉA 漢字_x9"), (7, "A b, C-d é É ÉA 漢字_x9"), (8, "a")]
    target = [(1, "one two three é a b"), (2, None), (3, "")]
    items = spark.createDataFrame(target, "item_id int, text string")
    got = [tuple(r) for r in resample(table(spark, docs), items, percent, least).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert order(got) == order(plain(docs, target, percent, least))


def test_empty_tables(spark):
    none = table(spark, []).limit(0)
    assert resample(none, none).count() == 0
    got = resample(table(spark), none.select("text")).where("rank is not null")
    assert got.count() == 25 * len([1 for _, t in awkward() if len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or "")) >= 20]) // 100
