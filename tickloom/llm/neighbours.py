"""Nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Largest inner products become least distances: vectors are divided by the greatest norm and get one more component that
brings each to the unit sphere, queries are normalised. A table hashes a point to ``hashes`` whole numbers
floor((a . x + b) / width), a drawn from the normal distribution, which is stable for distances. A query visits its own
bucket and then those whose numbers differ by -1 or 1 in some places, in the order of their estimated success: the sum of
squared distances from the query's projections to the walls that have to be crossed. Candidates of all tables are merged
and ranked by the inner product of the original vectors.

How many numbers a hash has, how wide they are and how many buckets are visited is fitted: ``SAMPLE`` queries are
answered by brute force over all rows, and of all settings that find ``target`` of those neighbours the one is taken
that leads to the fewest candidates. The fit holds a bounded sample of rows; the index holds every row.

Equal vectors are one point with its smallest ids: more than k + 1 of them never come among the k nearest, as ties go to
the smaller id. Points are dealt to shards by ranges of (table, bucket, salt) with about ``shard_rows`` rows each, so
that a bucket of any size is split, and neighbouring buckets lie together. A query is sent once to each shard that
holds one of its buckets, with the list of these. Within a shard, rows come first and stay in memory, and queries stream
past them; each yields its best k + 1 rows there.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import usable, width_of
from .shared import Scratch

SAMPLE = 96
_POINTS = 8192  # rows of the sample on which candidates are counted and shards are laid out
_CODE_BITS, _SALT_BITS = 6, 16
_QUERY_ROWS = 256
_SHARES = 16


@dataclass(frozen=True)
class Hashing:
    """Tables of hashes on the unit sphere; ``probes`` buckets are visited in each."""

    planes: np.ndarray  # (table, component, hash)
    shifts: np.ndarray  # (table, hash), in widths
    width: float
    probes: int

    def numbers(self, table: int, points: np.ndarray) -> np.ndarray:
        return points @ self.planes[table] / self.width + self.shifts[table]

    def steps(self) -> np.ndarray:
        """All ways to differ by -1, 0 or 1 in each number."""
        return np.array(list(itertools.product((0, -1, 1), repeat=self.planes.shape[2])), np.int64)

    def codes(self, table: int, points: np.ndarray) -> np.ndarray:
        return _packed(np.floor(self.numbers(table, points)).astype(np.int64))

    def visited(self, table: int, points: np.ndarray) -> np.ndarray:
        """The codes of the first ``probes`` buckets of each query, in order of estimated success."""
        x = self.numbers(table, points)
        at = np.floor(x)
        steps, inside = self.steps(), x - at
        order = np.argsort(_costs(inside, steps), axis=1, kind="stable")[:, : self.probes]
        return _packed(at.astype(np.int64)[:, None, :] + steps[order])


def _costs(inside: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Sum of squared distances to the walls crossed by each way of differing (query, way)."""
    return inside**2 @ (steps == -1).T.astype(np.float64) + (1 - inside) ** 2 @ (steps == 1).T.astype(np.float64)


def _packed(numbers: np.ndarray) -> np.ndarray:
    """Numbers as one code that sorts like them; those far outside share the outermost."""
    half = 1 << (_CODE_BITS - 1)
    out = np.zeros(numbers.shape[:-1], np.int64)
    for k in range(numbers.shape[-1]):
        out = (out << _CODE_BITS) | (np.clip(numbers[..., k], -half, half - 1) + half)
    return out


def on_sphere(x: np.ndarray, greatest: float) -> np.ndarray:
    """Rows over the greatest norm, with the component that is missing to 1."""
    y = x / greatest
    return np.column_stack([y, np.sqrt(np.clip(1 - (y * y).sum(axis=1), 0, None))])


def directions(x: np.ndarray) -> np.ndarray:
    """Queries normalised, with a 0 for the component that rows have more."""
    return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])


def draw(dims: int, tables: int, hashes: int, width: float, probes: int, seed: int) -> Hashing:
    rng = np.random.default_rng([seed, hashes])
    return Hashing(rng.standard_normal((tables, dims, hashes)), rng.random((tables, hashes)), width, probes)


def fit(queries: np.ndarray, neighbours: list[np.ndarray], points: np.ndarray, tables: int, target: float, seed: int) -> Hashing:
    """The hashing that visits the fewest candidates among those that find ``target`` of the neighbours of the queries.

    For each neighbour the visit at which the first table comes to its bucket is known, so one number of visits follows
    for each way of hashing; the candidates are then counted on ``points``."""
    pairs = [(q, x) for q, xs in zip(queries, neighbours, strict=True) for x in xs]
    if not pairs:
        return draw(queries.shape[1] if len(queries) else points.shape[1], tables, 1, 4.0, 3, seed)
    q, x = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    usual = float(np.median(np.linalg.norm(q - x, axis=1))) or 1e-3
    best: tuple[float, float, Hashing] | None = None
    for hashes, ratio in itertools.product((1, 2, 3, 4, 5, 6, 7), (0.6, 1.0, 1.5, 2.2, 4.0)):
        h = draw(queries.shape[1], tables, hashes, max(usual * ratio, 0.25), 3**hashes, seed)
        found = np.min([_visit(h, t, q, x) for t in range(tables)], axis=0)
        asc = np.sort(found)
        visits = asc[min(len(asc) - 1, int(np.ceil(target * len(asc))) - 1)]
        recall = float((found < 3**hashes).mean())
        probes = int(min(visits + 1, 3**hashes))
        h = Hashing(h.planes, h.shifts, h.width, probes)
        cost = _candidates(h, queries[:24], points) + 2e-5 * tables * probes
        reached = recall >= target
        if best is None or (reached, -cost if reached else recall) > (best[0] >= target, -best[1] if best[0] >= target else best[0]):
            best = (recall, cost, h)
    return best[2]


def _candidates(h: Hashing, queries: np.ndarray, points: np.ndarray) -> float:
    """The share of ``points`` in the buckets that a query visits, added up over the tables."""
    total = 0.0
    for t in range(len(h.planes)):
        codes, n = np.unique(h.codes(t, points), return_counts=True)
        seen = h.visited(t, queries)
        at = np.minimum(np.searchsorted(codes, seen), len(codes) - 1)
        total += float((n[at] * (codes[at] == seen)).sum()) / len(queries) / len(points)
    return total


def _visit(h: Hashing, table: int, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """At which visit of q the bucket of x comes, for pairs of rows; beyond all visits where it never does."""
    steps, at = h.steps(), h.numbers(table, q)
    apart = (np.floor(h.numbers(table, x)) - np.floor(at)).astype(np.int64)
    near = (np.abs(apart) <= 1).all(axis=1)
    out = np.full(len(q), len(steps) + 1)
    which = ((np.where(apart == -1, 1, np.where(apart == 1, 2, 0))) * 3 ** np.arange(apart.shape[1] - 1, -1, -1)).sum(axis=1)
    for start in range(0, len(q), 256):
        part = np.flatnonzero(near[start : start + 256]) + start
        if len(part):
            costs = _costs(at[part] - np.floor(at[part]), steps)
            own = costs[np.arange(len(part)), which[part]][:, None]
            earlier = np.arange(len(steps))[None, :] < which[part][:, None]
            out[part] = ((costs < own) | ((costs == own) & earlier)).sum(axis=1)
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows; equal rows give equal numbers wherever they stand."""
    return (q * x).sum(axis=1)


def best_rows(q: np.ndarray, x: np.ndarray, first: np.ndarray, pairs: np.ndarray, columns: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, products) of the n candidates of greatest product, ties to the smaller ``first``. pairs (query, row)
    holds rough products, -inf where a row is no candidate; ``columns`` are the numbers of its rows in x."""
    for i in range(len(q)):
        row = pairs[i]
        cut = np.partition(row, len(row) - n)[len(row) - n] if len(row) > n else -np.inf
        slack = 1e-9 * (1 + abs(cut)) if np.isfinite(cut) else 0.0
        kept = np.flatnonzero((row >= cut - slack) & (row > -np.inf))
        if len(kept):
            at = columns[kept]
            exact = products(q[i][None, :], x[at])
            order = np.lexsort((first[at], -exact))[:n]
            yield i, at[order], exact[order]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


_POINT = "a bigint, b bigint, ids array<bigint>, v array<double>"


def points_of(vectors: DataFrame, keep: int, vector: str) -> DataFrame:
    """Distinct vectors: a, b (two hashes of the vector, its name), v and the ``keep`` smallest of its vec_ids.

    The smallest ids are chosen in the tasks before the shuffle, so a vector that most rows hold is no large group."""
    rows = vectors.select(F.xxhash64(vector).alias("a"), F.xxhash64(F.lit(17), vector).alias("b"), "vec_id", F.col(vector).alias("v"))
    rows = rows.withColumn("n", F.expr("dense_rank() over (partition by a, b order by vec_id)")).where(F.col("n") <= keep)
    return rows.groupBy("a", "b").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.any_value("v").alias("v")).select("a", "b", "ids", "v")


def _truth(points: DataFrame, sample: np.ndarray, names: list[tuple[int, int]], k: int, dims: int) -> list[np.ndarray]:
    """The k points of greatest product of each sampled query, by brute force: the best of each batch come to be merged,
    in the tasks by a window's limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            if not len(x):
                continue
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            s = sample @ x.T
            for i, (own_a, own_b) in enumerate(names):
                s[i, (a == own_a) & (b == own_b)] = -np.inf
            top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            which, rows = np.repeat(np.arange(len(s)), top.shape[1]), top.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(s[which, rows]), batch.column("v").take(pa.array(rows))], ["q", "s", "v"])

    found = points.select("a", "b", "v").mapInArrow(run, "q int, s double, v array<double>")
    found = found.withColumn("n", F.expr("row_number() over (partition by q order by s desc)")).where((F.col("n") <= k) & (F.col("s") > float("-inf"))).select("q", "v").toArrow()
    which, x = found.column("q").to_numpy(), np.array(found.column("v").to_pylist(), np.float64).reshape(-1, dims)
    return [x[which == i] for i in range(len(sample))]


def search(
    vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, tables: int = 2, target: float = 0.965, vector: str = "embedding",
    shard_rows: int = 16_384, most_shards: int = 1 << 16, seed: int = 13,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the k rows of greatest inner product that were found.

    Candidates are all rows but those of the query's own vec_id; ties go to the smaller vec_id. Vectors that are null,
    zero or hold null or non-finite components take no part, nor do those of another length than the usable vector with
    the smallest vec_id, or with a null vec_id. Repeated rows (equal vec_id and vector) count once; rows of equal vec_id
    and other vectors are candidates each, and their queries are answered each. Where a query's own buckets hold fewer
    than k candidates, fewer are returned. Other columns are not looked at, and an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score double"
    dims = width_of(vectors, vector)
    if not dims:
        return spark.createDataFrame([], result)
    fine = usable(vector) & (F.size(vector) == dims) & F.exists(vector, lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = vectors.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias(vector))
    with Scratch(spark, "neighbours") as scratch:
        points = scratch.table(points_of(rows, k + 1, vector), "points")
        asked = rows.where(F.expr(is_query)).select("vec_id", F.xxhash64(vector).alias("a"), F.xxhash64(F.lit(17), vector).alias("b")).distinct()
        asked = scratch.table(asked, "asked")
        queries = scratch.table(points.join(asked.select("a", "b").distinct(), ["a", "b"], "left_semi"), "queries")
        n, greatest = points.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
        if not n:
            return spark.createDataFrame([], result)
        # Samples by a hash of the vector, bounded in expectation and by a limit far above it.
        near = lambda df, size, total: df.where(F.pmod("b", F.lit(1 << 30)) < int(min(1.0, size / max(total, 1)) * (1 << 30)) + 1)
        some = near(queries, SAMPLE, queries.count()).orderBy("a").limit(2 * SAMPLE).collect()
        sample = np.array([r["v"] for r in some], np.float64).reshape(-1, dims)
        truth = _truth(points, sample, [(r["a"], r["b"]) for r in some], k, dims)
        spread = near(points, _POINTS, n).select("v").limit(2 * _POINTS).toArrow().column("v")
        spread = on_sphere(np.array(spread.to_pylist(), np.float64).reshape(-1, dims), greatest)
        hashing = fit(directions(sample) if len(sample) else np.zeros((0, dims + 1)), [on_sphere(t, greatest) for t in truth], spread, tables, target, seed)
        shards = int(min(max(1, -(-n // shard_rows)), most_shards))
        bounds = [_bounds(hashing.codes(t, spread), shards) for t in range(tables)]
        found = scratch.table(_found(points, queries, hashing, bounds, greatest, dims, k), "found")
        # Each query's candidates of all shards and tables, once each: one shuffle, pruned in the tasks.
        merged = found.withColumn("n", F.expr("dense_rank() over (partition by qa, qb order by score desc, ids[0], a, b)")).where(F.col("n") <= k + 1)
        best = merged.groupBy("qa", "qb", "a", "b").agg(F.any_value("score").alias("score"), F.any_value("ids").alias("ids"))
        flat = F.flatten(F.transform("list", lambda r: F.transform(r["ids"], lambda i: F.named_struct(F.lit("away"), -r["score"], F.lit("vec_id"), i))))
        best = best.groupBy(F.col("qa").alias("a"), F.col("qb").alias("b")).agg(F.collect_list(F.struct("score", "ids")).alias("list"))
        best = best.select("a", "b", F.slice(F.array_sort(flat), 1, 2 * (k + 1)).alias("near"), F.explode(F.array(*map(F.lit, range(_SHARES)))).alias("share"))
        # A vector that most queries hold is answered once, and its answer dealt to shares of them.
        every = asked.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(_SHARES)).cast("int")).join(best, ["a", "b", "share"])
        own = F.slice(F.filter("near", lambda r: r["vec_id"] != F.col("vec_id")), 1, k)
        out = every.select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("at", "r"))
        out = out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), (-F.col("r.away")).alias("score"))
        return scratch.table(out, "neighbours", keep=True)


def _bounds(codes: np.ndarray, shards: int) -> np.ndarray:
    """The least (code, salt) of each shard but the first, so that shards hold alike many of the sample."""
    salted = np.sort((codes << _SALT_BITS) | (np.arange(len(codes)) * 40_503 % (1 << _SALT_BITS)))
    return salted[np.arange(1, shards) * len(salted) // shards]


def _found(points: DataFrame, queries: DataFrame, hashing: Hashing, bounds: list[np.ndarray], greatest: float, dims: int, k: int) -> DataFrame:
    """qa, qb, a, b, ids, score: the k + 1 best candidates of each query in each shard that it visits."""
    shards, tables = len(bounds[0]) + 1, len(bounds)
    schema = f"shard int, asks boolean, codes array<bigint>, {_POINT}"
    names = [c.split()[0] for c in _POINT.split(", ")]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = on_sphere(_matrix(batch.column("v"), dims), greatest)
                salt = batch.column("a").to_numpy() & ((1 << _SALT_BITS) - 1)
                for t in range(tables):
                    code = hashing.codes(t, p)
                    shard = t * shards + np.searchsorted(bounds[t], (code << _SALT_BITS) | salt, side="right")
                    codes = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1), pa.int32()), pa.array(code))
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.zeros(len(p), bool)), codes, *(batch.column(c) for c in names)], ["shard", "asks", "codes", *names])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _QUERY_ROWS):
                part = batch.slice(start, _QUERY_ROWS)
                q = directions(_matrix(part.column("v"), dims))
                for t in range(tables):
                    codes = hashing.visited(t, q)
                    low = np.searchsorted(bounds[t], codes << _SALT_BITS, side="right")
                    high = np.searchsorted(bounds[t], (codes << _SALT_BITS) | ((1 << _SALT_BITS) - 1), side="right")
                    row, visit = np.divmod(np.arange(codes.size), codes.shape[1])
                    times = (high - low + 1).ravel()  # a bucket may lie in several shards
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, code, shard = np.repeat(row, times), np.repeat(codes.ravel(), times), np.repeat(low.ravel(), times) + nth
                    order = np.lexsort((shard, row))
                    row, code, shard = row[order], code[order], shard[order]
                    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(code))
                    rows = pa.array(row[first])
                    yield pa.RecordBatch.from_arrays([pa.array(t * shards + shard[first], pa.int32()), pa.array(np.ones(len(first), bool)), lists, *(part.column(c).take(rows) for c in names)], ["shard", "asks", "codes", *names])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])]) if len(shard) else []
            for start, end in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                if shard[start] != at:
                    at, held, index = shard[start], [], None
                if not asks[start]:
                    held.append(batch.slice(start, end - start))
                    continue
                if held and index is None:
                    index = _index(held, dims)
                if index is not None:
                    for s in range(start, end, _QUERY_ROWS):
                        yield from _answers(batch.slice(s, min(_QUERY_ROWS, end - s)), index, dims, k + 1)

    both = points.mapInArrow(dealt, schema).unionByName(queries.mapInArrow(sent, schema))
    both = both.repartition("shard").sortWithinPartitions("shard", "asks")
    return both.mapInArrow(answered, "qa bigint, qb bigint, a bigint, b bigint, ids array<bigint>, score double")


def _index(held: list[pa.RecordBatch], dims: int) -> tuple:
    """A shard's rows in order of their codes: (table, codes, vectors, first ids)."""
    t = pa.Table.from_batches(held)
    code = pa.compute.list_flatten(t["codes"]).to_numpy()
    order = np.argsort(code, kind="stable")
    t = t.select(["a", "b", "ids", "v"]).take(pa.array(order)).combine_chunks()
    x = np.concatenate([_matrix(c, dims) for c in t["v"].chunks]) if t["v"].num_chunks else np.zeros((0, dims))
    first = pa.compute.list_element(t["ids"], 0).to_numpy()
    return t.select(["a", "b", "ids"]), code[order], x, first


def _answers(asked: pa.RecordBatch, index: tuple, dims: int, n: int) -> Iterator[pa.RecordBatch]:
    t, codes, x, first = index
    q = _matrix(asked.column("v"), dims)
    lists = asked.column("codes")
    want = lists.flatten().to_numpy()
    who = np.repeat(np.arange(len(q)), pa.compute.list_value_length(lists).to_numpy())
    order = np.argsort(want, kind="stable")
    want, who = want[order], who[order]
    cuts = np.flatnonzero(np.r_[True, want[1:] != want[:-1]])
    low, high = np.searchsorted(codes, want[cuts], side="left"), np.searchsorted(codes, want[cuts], side="right")
    hit = high > low
    columns = np.concatenate([np.arange(a, b) for a, b in zip(low[hit], high[hit], strict=True)]) if hit.any() else np.zeros(0, np.int64)
    if not len(columns):
        return
    pairs, at = np.full((len(q), len(columns)), -np.inf), 0
    for cut, end, a, b in zip(cuts[hit], np.r_[cuts[1:], len(want)][hit], low[hit], high[hit], strict=True):
        some = who[cut:end]
        pairs[some, at : at + b - a] = q[some] @ x[a:b].T
        at += b - a
    qs, rows, scores = [], [], []
    for i, r, s in best_rows(q, x, first, pairs, columns, n):
        qs.append(np.full(len(r), i))
        rows.append(r)
        scores.append(s)
    if qs:
        who, rows = pa.array(np.concatenate(qs)), pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [asked.column("a").take(who), asked.column("b").take(who), *(t[c].take(rows).combine_chunks() for c in ("a", "b", "ids")), pa.array(np.concatenate(scores))], ["qa", "qb", "a", "b", "ids", "score"]
        )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
