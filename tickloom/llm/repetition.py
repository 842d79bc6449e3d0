"""Quality rules on repetition inside a document, from a suffix array over its words.

The suffix array is built by prefix doubling on word ranks; the ranks of every level also give the longest common
prefix of neighbouring suffixes. Runs of neighbours with a common prefix of at least L words are the LCP intervals of the
repeated substrings of L words or more. The innermost interval of a position is that of the longest repeat which starts
there, the greater of its two neighbouring prefixes, and can't be continued to the right. It is maximal unless the repeat
of the position before is one word longer, which is the same repeat begun earlier. The union of the maximal spans is what
repeats cover.

A document whose windows of L words are all distinct has no such interval, which one pass over window hashes shows, so
the array is built only where there is a repeat. Time is n log n in the words of one document and memory log n ranks a word
of the longest document, and the step is a map without any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WordHashes, arrow_map, runs_of, space_words


@dataclass(frozen=True)
class Rules:
    """Limits of a document that is kept. The base limits are applied first."""

    min_words: int = 20
    window: int = 8  # words of a window whose repeats count for the base limit
    max_window_percent: int = 30
    min_repeat: int = 4  # words of the shortest repeat that the suffix array looks for
    max_covered_percent: int = 40
    max_longest: int = 256  # words


SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, lcp): suffixes in order, and for each the words it shares with the one before it (0 for the first)."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    while True:
        following = np.full(n, -1, np.int64)
        following[: n - k] = rank[k:] if k < n else rank[:0]
        key = rank * (n + 1) + following + 1
        sa = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(key[sa][1:] != key[sa][:-1])])
        rank = np.empty(n, np.int64)
        rank[sa] = steps
        if steps[-1] == n - 1 or k >= n:
            break
        levels.append(rank)
        k *= 2
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        size, of = 1 << level, levels[level]
        # A rank stands for `size` words only where that many are left; equal ranks near the end would be equal suffixes.
        same = (a + size <= n) & (b + size <= n)
        same[same] = of[a[same]] == of[b[same]]
        step = np.where(same, size, 0)
        a, b = a + step, b + step
        lcp[1:] += step
    return sa, lcp


def repeats(hashes: np.ndarray, least: int) -> np.ndarray:
    """For each position the words of the longest repeat that starts there, 0 where it has fewer than ``least``."""
    n = len(hashes)
    longest = np.zeros(n, np.int64)
    windows = runs_of(hashes, least)
    if len(windows) < 2 or len(np.unique(windows)) == len(windows):
        return longest
    sa, lcp = suffix_array(hashes)
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    longest[longest < least] = 0
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions the spans of maximal repeats of ``least`` words or more cover."""
    before = np.concatenate([[0], longest[:-1]])
    at = np.flatnonzero((longest >= least) & (before != longest + 1))
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, words: WordHashes, rules: Rules) -> dict:
    """Counts, repeat spans [start, end) in words, and verdicts for a text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = space_words(text)
    n = len(found)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    longest = repeats(words.of(found), min(rules.min_repeat, rules.window))
    inside = covered(longest, rules.window)
    spans = covered(longest, rules.min_repeat)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], spans.astype(np.int8), [0]])))
    base = n < rules.min_words or 100 * int(inside.sum()) > rules.max_window_percent * n
    top = int(longest.max(initial=0))
    return {
        "n_words": n,
        "word_chars": len(text or "") - (len(raw) - len(raw.translate(None, SPACES))),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": int(inside.sum()),
        "base_failed": base,
        "kept": not base and 100 * int(spans.sum()) <= rules.max_covered_percent * n and top <= rules.max_longest,
        "n_covered": int(spans.sum()),
        "longest_repeat": top,
        "spans": edges.reshape(-1, 2).tolist(),
    }


_FIELDS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
    ("n_covered", pa.int64()),
    ("longest_repeat", pa.int64()),
    ("spans", pa.list_(pa.list_(pa.int64()))),
]
_DDL = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, n_covered bigint, longest_repeat bigint, spans array<array<bigint>>"
)


def _text(batch: pa.RecordBatch) -> list[str | None]:
    return pc.cast(batch.column("text"), pa.string()).to_pylist()


def repetition(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id with the columns of ``measure``, one row per row of ``docs``, in any order.

    A null or empty text has no words: counts are 0, base_failed is true, kept false. Repeated rows and null ids are
    kept apart as they come; other columns are not looked at. An empty table gives an empty result.
    """

    def make():
        words = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(t, words, rules) for t in _text(batch)]
            own = [pa.array([r[k] for r in rows], kind) for k, kind in _FIELDS]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *own], ["doc_id", *(k for k, _ in _FIELDS)])

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), make, f"doc_id bigint, {_DDL}")


def keep_unrepetitive(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they are."""

    def make():
        words = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([measure(t, words, rules)["kept"] for t in _text(batch)], pa.bool_()))

        return step

    return arrow_map(docs, make, docs.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Words in windows of L that occur twice or more are the words that repeats of L or more cover.
OP2_SQL = r"""
with w as (
  select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
pos as (
  select doc_id, ws, len(ws) as n, unnest(range(1, len(ws) + 1)) as i from w),
win as (
  select doc_id, k, i, md5(array_to_string(ws[i : i + k - 1], ' ')) as s
  from pos, (values (4), (8), (257)) as sizes(k) where i + k - 1 <= n),
twice as (
  select doc_id, k, i from win qualify count(*) over (partition by doc_id, k, s) > 1),
hit as (
  select doc_id, k, count(distinct i + d) as c from twice, (select unnest(range(0, 257)) as d) where d < k group by all),
per as (
  select doc_id, coalesce(max(c) filter (k = 4), 0) as c4, coalesce(max(c) filter (k = 8), 0) as c8,
    coalesce(max(c) filter (k = 257), 0) as c257 from hit group by doc_id),
lines as (
  select doc_id, count(*) - count(distinct l) as d
  from (select doc_id, unnest(string_split(text, chr(10))) as l from documents)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
out as (
  select w.doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(d, 0) as n_dup_lines, coalesce(c8, 0) as n_repeat_words, coalesce(c4, 0) as c4, coalesce(c257, 0) as c257
  from w left join per using (doc_id) left join lines using (doc_id))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * c4 <= 40 * n_words and c257 = 0 as kept
from out
"""
