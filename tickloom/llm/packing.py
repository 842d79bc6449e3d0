"""Packing token sequences by the linear grouping scheme, planned on a histogram of lengths.

Documents are tokenised once, in a map; only longer ones than a sequence are cut. What the planner needs is the number of
pieces of each length, a table of as many rows as a sequence has tokens, however many documents there are:

1. Large lengths are sorted downwards, dealt into groups of equal cardinality and rounded up to their group's largest.
2. For those few sizes, configurations of a sequence are chosen: the largest size left with the complement that fills
   the sequence best (a knapsack over the sizes left), as many times as the counts allow; each uses up a size.
3. The group's actual pieces are substituted, which leaves known gaps in runs of alike sequences.
4. Small lengths are put by best fit, largest first, into the smallest gap that holds them, else into new sequences.

The plan says for each length which ranks go to which sequences and at what offset. Ranks are counted in the cluster:
rows of a length are dealt into buckets and numbered in each, so a length that many documents share is no single task.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import Scratch

LENGTH, END = 2048, 0
GROUPS = 128

class Encoder:
    """Token ids of whole texts, as little-endian 32-bit numbers, by the vocabulary of a tokenizers file.

    The file's byte-level vocabulary is given to tiktoken as merge ranks, which yields the same ids several times
    faster; texts that hold one of the file's special tokens go through tokenizers itself, and so do those on which
    tiktoken's backtracking pattern gives up, as on about a million white-space characters in a row."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.special.search(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # its regex ran out of stack
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks that a worker runs."""
    return Encoder(path)


def pieces_of(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % length or min(n, length)
    return [(0, first)] + [(k, length) for k in range(first, n, length)]


def tokenised(docs: DataFrame, path: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ``keep_ids`` adds the ids themselves, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            encoder = encoder_of(path)
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")} | ({"ids": []} if keep_ids else {})
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                for k, (start, n) in enumerate(pieces_of(len(ids) // 4, length)):
                    part = ids[4 * start : 4 * (start + n)]
                    row = (doc, k, start, n, zlib.crc32(part)) + ((part,) if keep_ids else ())
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            kinds = {"piece": pa.int32(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    more = ", ids binary" if keep_ids else ""
    return rows.mapInArrow(run, f"doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint{more}")


def _best_fill(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """The multiset of ``sizes`` (index -> number, within ``counts``) with the greatest sum that fits in ``room``."""
    # came[c]: the index of the last size added to reach sum c; sizes are tried in turn, each at most counts[k] times.
    came, used = np.full(room + 1, -1, np.int64), [None] * len(sizes)
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    for k, size in enumerate(sizes):
        if size > room or not counts[k]:
            continue
        times = np.zeros(room + 1, np.int64)
        fresh = reach.copy()
        for n in range(1, min(counts[k], room // size) + 1):
            fresh = np.concatenate([np.zeros(size, bool), fresh[:-size]]) & ~reach
            if not fresh.any():
                break
            came[fresh], times[fresh] = k, n
            reach |= fresh
        used[k] = times
        if reach[room]:
            break
    at, take = int(np.flatnonzero(reach)[-1]), {}
    while at:
        k = int(came[at])
        take[k] = int(used[k][at])
        at -= take[k] * sizes[k]
    return take


def _groups(counts: np.ndarray, small: int, groups: int) -> tuple[list[int], list[list[list[int]]]]:
    """Rounded sizes, downwards, and for each the runs [length, number] of actual lengths in it."""
    large = [[n, int(counts[n])] for n in range(len(counts) - 1, small, -1) if counts[n]]
    each = max(1, -(-sum(c for _, c in large) // groups))
    sizes: list[int] = []
    members: list[list[list[int]]] = []
    room = 0
    for n, c in large:
        while c:
            if not room:
                room = each
                if not sizes or sizes[-1] != n:  # a length that fills groups of its own needs no rounding
                    sizes.append(n)
                    members.append([])
            take = min(c, room)
            members[-1].append([n, take])
            c, room = c - take, room - take
    return sizes, members


def plan(counts: np.ndarray, length: int = LENGTH, groups: int = GROUPS, small: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(piece length, first rank, ranks, first sequence, offset): the pieces of that length with those ranks go to
    consecutive sequences from the first one, each at the offset. ``counts[n]`` is the number of pieces of n tokens.

    Its time and the number of its rows depend on ``length`` and ``groups``, not on the counts.
    """
    small = length // 4 if small is None else small
    counts = np.array(counts, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    total = 0
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> runs [first sequence, number]
    order: list[int] = []  # the gaps there are, upwards

    def put(n: int, many: int, sequence: int, offset: int) -> None:
        rows.append((n, rank[n], many, sequence, offset))
        rank[n] += many

    def leave(gap: int, sequence: int, many: int) -> None:
        if gap and many:
            if not gaps[gap]:
                bisect.insort(order, gap)
            gaps[gap].append([sequence, many])

    if counts[length]:
        put(length, int(counts[length]), 0, 0)
        total += int(counts[length])
    counts[length] = 0

    sizes, members = _groups(counts, small, groups)
    left = [sum(c for _, c in m) for m in members]
    for first in range(len(sizes)):
        while left[first]:
            left[first] -= 1
            use = _best_fill(sizes[first:], left[first:], length - sizes[first])
            left[first] += 1
            use[0] = use.get(0, 0) + 1
            times = min(left[first + k] // n for k, n in use.items())
            lanes = []  # for each place in the configuration, the runs of actual lengths that take it in turn
            for k, n in sorted(use.items()):
                left[first + k] -= n * times
                source = members[first + k]
                for _ in range(n):
                    lane, need = [], times
                    while need:
                        take = min(source[0][1], need)
                        lane.append([source[0][0], take])
                        source[0][1] -= take
                        need -= take
                        if not source[0][1]:
                            source.pop(0)
                    lanes.append(lane)
            done = 0
            while done < times:
                many, at = min(lane[0][1] for lane in lanes), 0
                for lane in lanes:
                    put(lane[0][0], many, total, at)
                    at += lane[0][0]
                    lane[0][1] -= many
                    if not lane[0][1]:
                        lane.pop(0)
                leave(length - at, total, many)
                total, done = total + many, done + many

    for n in range(min(small, length - 1), 0, -1):
        need = int(counts[n])
        while need:
            k = bisect.bisect_left(order, n)
            if k == len(order):
                fit = length // n
                many = max(1, need // fit)
                leave(length, total, many)
                total += many
                continue
            gap = order[k]
            sequence, many = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(k)
            fit = min(gap // n, need)
            full = min(many, need // fit)
            for j in range(fit):
                put(n, full, sequence, length - gap + j * n)
            need -= fit * full
            leave(gap - fit * n, sequence, full)
            leave(gap, sequence + full, many - full)
    return rows


def pack(pieces: DataFrame, length: int = LENGTH, groups: int = GROUPS, spread: int = 64, bucket_rows: int = 1_000_000) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces of one length are numbered in buckets of about ``bucket_rows``, ``spread`` at least, so that a length that
    many have, as the full one, is no hot key."""
    spark = pieces.sparkSession
    histogram = pieces.groupBy("length").count().collect()  # a row per length, ``length`` at most
    counts = np.zeros(length + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    steps = plan(counts, length, groups) or [(0, 0, 0, 0, 0)]
    table = pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*steps, strict=True)], ["n", "first", "many", "sequence", "offset"])
    spreads = spark.createDataFrame([(r["length"], max(spread, -(-r["count"] // bucket_rows))) for r in histogram], "length bigint, spread bigint")
    rows = pieces.join(F.broadcast(spreads), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("spread")))
    counted = rows.groupBy("length", "bucket").agg(F.count("*").alias("rows"))
    before = counted.selectExpr("length", "bucket", "sum(rows) over (partition by length order by bucket) - rows as before")
    rows = rows.withColumn("nth", F.expr("row_number() over (partition by length, bucket order by doc_id, piece, ids_crc32) - 1"))
    rows = rows.join(F.broadcast(before), ["length", "bucket"])  # a row per bucket
    rows = rows.withColumn("rank", F.col("before") + F.col("nth"))
    # The plan's rows depend on the lengths there can be, not on the pieces.
    found = rows.join(F.broadcast(spark.createDataFrame(table)), (F.col("length") == F.col("n")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("many")))
    return found.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first")).drop("bucket", "spread", "before", "nth", "rank", "n", "first", "many", "sequence")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece of every row of ``docs``.

    ``path`` is the tokenizer's file. A null or empty text is the end token alone. Rows with a null or repeated doc_id
    are packed as they come; other columns are not looked at. An empty table gives an empty result.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    with Scratch(docs.sparkSession, "packing") as scratch:
        pieces = scratch.table(tokenised(docs, path, length, keep_ids), "pieces", keep=True)
        return pack(pieces, length).select(*pieces.columns, "sequence_id", "offset")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
