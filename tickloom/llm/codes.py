"""Vector codes: each of ``parts`` consecutive parts of a vector is named by its nearest entry of that part's codebook,
which whole-number Lloyd rounds learn exactly.

The rounds are heap Lloyd. Vectors are written once, in blocks of whole Arrow batches, with their state beside them: for
each part the entry of every vector, and for each entry a heap of its vectors keyed by slack, the lower bound of the
distance to any other entry less the distance to the own one, plus the drift that the entry had gathered when the slack
was measured. After a round an entry's drift grows by how far it moved and by the farthest move of any other; a vector
whose key is still above its entry's drift can't have a nearer entry, so only the heap's top, as far as it is not above,
is popped and measured against all entries, exactly, in whole numbers. Vectors that change entry are all that a round
sends: their components leave the sum of one entry and join that of another, and the differences are added up by
(part, entry, position) in the tasks first. Codebooks, sums and drifts are ``parts * entries`` vectors of a part's
width, whatever the input, and are all that the driver holds.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_STATE = "ids binary, labels binary, x binary, entry binary, members binary, keys binary, sizes binary"
_SALTS = 32


def usable(vector: str = "embedding") -> Column:
    """Not null, and without null or non-finite components."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def width_of(vectors: DataFrame, vector: str = "embedding") -> int:
    """The length of the usable vector with the smallest vec_id; 0 without any. Vectors of another length take no part."""
    first = vectors.where(usable(vector)).agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", F.size(vector).alias("width")))["width"].alias("width")).first()
    return first["width"] or 0


def limit_of(width: int) -> int:
    """The greatest component of which squared distances over ``width`` components stay inside 63 bits."""
    return max(1, math.isqrt((2**63 - 1) // max(width, 1)) // 2)


def whole(raw: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x), with zeros behind so that parts are equal; components beyond ``limit_of`` count as that bound."""
    n, d = raw.shape
    out = np.zeros((n, -(-d // parts) * parts), np.int64)
    top = limit_of(out.shape[1])
    out[:, :d] = np.clip(np.floor(raw.astype(np.float64) * scale), -top, top)
    return out


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in book], axis=1)


def measured(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, slack) of rows: ties to the lower index; the slack is how much farther the next one is."""
    d = distances(x, book)
    near = d.argmin(axis=1)
    own = np.sqrt(d[np.arange(len(d)), near].astype(np.float64))
    if len(book) == 1:
        return near, np.full(len(d), np.inf)
    d[np.arange(len(d)), near] = np.iinfo(np.int64).max
    return near, np.sqrt(d.min(axis=1).astype(np.float64)) - own


class Block:
    """Vectors of a block, and the heaps of their parts."""

    def __init__(self, x: np.ndarray, parts: int, entry: np.ndarray, heaps: list[list[list[tuple[float, int]]]]):
        self.x, self.parts, self.entry, self.heaps = x, parts, entry, heaps
        self.part_width = x.shape[1] // parts

    def part(self, p: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.x[rows, p * self.part_width : (p + 1) * self.part_width]

    def advance(self, books: np.ndarray, drift: np.ndarray, slip: float) -> list[tuple[int, int, int, np.ndarray]]:
        """Brings every part to its nearest entry; (part, entry, rows joined less rows left, sum of their components
        likewise) of the entries that changed. Keys within ``slip`` of the drift count as violated."""
        out = []
        for p in range(self.parts):
            popped = []
            for e, heap in enumerate(self.heaps[p]):
                while heap and heap[0][0] <= drift[p, e] + slip:
                    popped.append(heapq.heappop(heap)[1])
            if not popped:
                continue
            rows = np.array(popped)
            before = self.entry[rows, p]
            near, slack = measured(self.part(p, rows), books[p])
            keys = slack + drift[p, near]
            for row, e, key in zip(popped, near.tolist(), keys.tolist(), strict=True):
                heapq.heappush(self.heaps[p][e], (key, row))
            self.entry[rows, p] = near
            moved = before != near
            rows, before, near = rows[moved], before[moved], near[moved]
            x = self.part(p, rows)
            for e in np.union1d(before, near).tolist():
                if e >= 0:
                    come, gone = near == e, before == e
                    out.append((p, e, int(come.sum()) - int(gone.sum()), x[come].sum(axis=0) - x[gone].sum(axis=0)))
        return out


def _fresh(ids: pa.Array, labels: pa.Array, x: np.ndarray, parts: int, entries: int) -> dict[str, bytes]:
    """A block before the first round: every vector is due, in no entry's sum (-1)."""
    n = len(x)
    heaps = [[[(-math.inf, r) for r in range(n)]] + [[] for _ in range(entries - 1)] for _ in range(parts)]
    return _arrow_bytes(ids, labels) | _state(Block(x, parts, np.full((n, parts), -1, np.int16), heaps))


def _arrow_bytes(ids: pa.Array, labels: pa.Array) -> dict[str, bytes]:
    def one(a: pa.Array) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("v", a.type)])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([a], ["v"]))
        return sink.getvalue().to_pybytes()

    return {"ids": one(ids), "labels": one(labels)}


def _state(b: Block) -> dict[str, bytes]:
    flat = [pair for part in b.heaps for heap in part for pair in heap]
    sizes = np.array([len(heap) for part in b.heaps for heap in part], np.int32)
    keys, members = np.array([k for k, _ in flat], np.float64), np.array([m for _, m in flat], np.int32)
    return {"x": b.x.tobytes(), "entry": b.entry.tobytes(), "members": members.tobytes(), "keys": keys.tobytes(), "sizes": sizes.tobytes()}


def _block(row: dict, parts: int, entries: int) -> Block:
    entry = np.frombuffer(row["entry"], np.int16).reshape(-1, parts).copy()
    x = np.frombuffer(row["x"], np.int64).reshape(len(entry), -1)
    keys, members, sizes = np.frombuffer(row["keys"], np.float64).tolist(), np.frombuffer(row["members"], np.int32).tolist(), np.frombuffer(row["sizes"], np.int32).tolist()
    pairs, heaps, at = list(zip(keys, members, strict=True)), [], 0
    for p in range(parts):
        heaps.append([])
        for e in range(entries):
            heaps[p].append(pairs[at : at + sizes[p * entries + e]])
            at += sizes[p * entries + e]
    return Block(x, parts, entry, heaps)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _books(chosen: list, parts: int) -> np.ndarray:
    """Codebooks (part, entry, position) of the first vectors."""
    x = np.array(chosen, np.int64)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def learn(blocks: DataFrame, first: np.ndarray, rounds: int, scratch: Scratch) -> tuple[np.ndarray, DataFrame]:
    """(codebooks after ``rounds`` rounds, blocks with the entries that are nearest to them)."""
    books, parts, entries = first, first.shape[0], first.shape[1]
    drift = np.zeros((parts, entries))
    sums, counts = np.zeros(first.shape, object), np.zeros((parts, entries), np.int64)
    for r in range(rounds + 1):
        # Roots and drifts are rounded; the margin is far above their error and costs a few measurements.
        slip = 1e-6 + 1e-9 * float(np.abs(books).max()) * books.shape[2]

        def step(batches: Iterator[pa.RecordBatch], books: np.ndarray = books, drift: np.ndarray = drift.copy(), slip: float = slip) -> Iterator[pa.RecordBatch]:
            for row in _rows_of(batches):
                b = _block(row, parts, entries)
                changed = b.advance(books, drift, slip)
                yield pa.RecordBatch.from_pylist([row | _state(b) | {"changed": [{"part": p, "entry": e, "n": n, "x": x.tolist()} for p, e, n, x in changed]}], schema=schema)

        schema = pa.schema([(c, pa.binary()) for c in ("ids", "labels", "x", "entry", "members", "keys", "sizes")] + [("changed", pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("x", pa.list_(pa.int64()))])))])
        blocks = scratch.table(blocks.select(*(c.split()[0] for c in _STATE.split(", "))).mapInArrow(step, _STATE + ", changed array<struct<part int, entry int, n bigint, x array<bigint>>>"), f"round{r}")
        if r:
            scratch.drop(f"round{r - 1}")
        if r == rounds:
            break
        for c in _added(blocks):
            if c["position"] < 0:
                counts[c["part"], c["entry"]] += int(c["v"])
            else:
                sums[c["part"], c["entry"], c["position"]] += int(c["v"])
        new = books.copy()
        used = counts > 0
        new[used] = (sums[used] // counts[used][:, None]).astype(np.int64)
        moved = np.sqrt(((new - books).astype(np.float64) ** 2).sum(axis=2))
        books = new
        if entries > 1:
            order = np.sort(moved, axis=1)
            other = np.where(moved == order[:, -1:], np.where((moved == order[:, -1:]).sum(axis=1, keepdims=True) > 1, order[:, -1:], order[:, -2:-1]), order[:, -1:])
            drift = drift + moved + other
    return books, blocks


def _added(blocks: DataFrame) -> list:
    """The rounds' changes added up by (part, entry, position); position -1 counts rows. At most a row for each."""
    one = blocks.select(F.explode("changed").alias("c")).select("c.part", "c.entry", "c.n", F.posexplode("c.x").alias("position", "v"))
    moved = one.groupBy("part", "entry", "position").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    rows = blocks.select(F.explode("changed").alias("c")).groupBy("c.part", "c.entry").agg(F.sum("c.n").cast("decimal(38,0)").alias("v"))
    return moved.unionByName(rows.withColumn("position", F.lit(-1))).collect()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """vec_id, label, code (an array of an entry for each part), error (squared distances to them, added up) and
    codebooks_sha256, one row per usable vector.

    Vectors that are null or hold null or non-finite components are dropped, as are those of another length than the
    usable vector with the smallest vec_id. The codebooks start from the vectors of the ``entries`` smallest vec_ids (of
    equal ids, the smaller vector; a null id after all others), or from fewer where there are no more. A width that
    isn't a multiple of ``parts`` counts as followed by zeros. Repeated rows are kept as they come, and other columns
    are not looked at. Components whose whole number is beyond ``limit_of`` (half a billion for 64 components) count as
    that bound: their squared distance would not fit in the error. Without usable vectors the result is empty.
    """
    spark = vectors.sparkSession
    width = width_of(vectors, vector)
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    kept = vectors.where(usable(vector) & (F.size(vector) == width)).select(F.col("vec_id").cast("bigint").alias("vec_id"), label, F.col(vector).cast("array<double>").alias("v"))
    kind = spark.createDataFrame([], kept.select("label").schema).schema["label"].dataType
    result = f"vec_id bigint, label {kind.simpleString()}, code array<int>, error bigint, codebooks_sha256 string"
    if not width:
        return spark.createDataFrame([], result)
    seeds = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    first = _books(whole(np.array([r["v"] for r in seeds]), scale, parts).tolist(), parts)
    n_entries = first.shape[1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v")
                raw = v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                yield pa.RecordBatch.from_pylist([_fresh(batch.column("vec_id"), batch.column("label"), whole(raw, scale, parts), parts, n_entries)], schema=pa.schema([(c.split()[0], pa.binary()) for c in _STATE.split(", ")]))

    scratch = Scratch(spark, "codes")
    with scratch:
        blocks = scratch.table(kept.mapInArrow(deal, _STATE), "blocks")
        books, blocks = learn(blocks, first, rounds, scratch)
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows_of(batches):
                entry = np.frombuffer(row["entry"], np.int16).reshape(-1, parts)
                x = np.frombuffer(row["x"], np.int64).reshape(len(entry), parts, -1)
                error = ((x - books[np.arange(parts), entry]) ** 2).sum(axis=(1, 2))
                ids, labels = (pa.ipc.open_stream(row[c]).read_all()["v"].combine_chunks() for c in ("ids", "labels"))
                code = pa.ListArray.from_arrays(pa.array(np.arange(len(entry) + 1) * parts, pa.int32()), pa.array(entry.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(error), pa.array([digest] * len(entry))], ["vec_id", "label", "code", "error", "codebooks_sha256"])

        return scratch.table(blocks.select("ids", "labels", "x", "entry").mapInArrow(coded, result), "codes", keep=True)


def with_group_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors of rows of equal label added up, null labels together.

    Errors are added up in the tasks first, and the sums dealt to all of ``_SALTS`` shares of a label's rows, so that a
    label with most rows is joined in many tasks."""
    label = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("text"))
    sums = coded.groupBy(label.alias("of")).agg(F.sum("error").alias("label_error"))
    sums = sums.select("of", "label_error", F.explode(F.array(*map(F.lit, range(_SALTS)))).alias("salt"))
    rows = coded.withColumn("of", label).withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(_SALTS)).cast("int"))
    return rows.join(sums, ["of", "salt"]).drop("of", "salt")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_group_error(encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    code = F.lower(F.array_join(F.transform("code", lambda e: F.lpad(F.hex(e), 2, "0")), ""))
    return found.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    nearest = "list_transform(range(0, 8), lambda p: list_position(list_transform(b[p + 1], lambda c: {d}), list_min(list_transform(b[p + 1], lambda c: {d}))) - 1)"
    nearest = nearest.format(d="list_sum(list_transform(range(1, w + 1), lambda i: (x[p * w + i] - c[i]) * (x[p * w + i] - c[i])))")
    parts = [
        """k as materialized (
  select row_number() over () as row, vec_id, label, list_transform(embedding, lambda y: floor(4096 * y::double)::bigint) as x, len(embedding) // 8 as w
  from embeddings where embedding is not null and len(list_filter(embedding, lambda y: y is null or isnan(y) or isinf(y))) = 0)""",
        """b0 as materialized (
  select list(es order by p) as b from (
    select p, list(x[p * w + 1 : p * w + w] order by vec_id) as es
    from (select * from k order by vec_id limit 16), (select unnest(range(0, 8)) as p) group by p))""",
    ]
    for r in range(6):
        parts += [
            f"a{r} as materialized (select row, x, w, {nearest} as e from k, b{r})",
            f"""m{r} as (
  select p, e, list(v order by i) as c from (
    select p, e[p + 1] as e, i,  case when sum(x[p * w + i + 1]) < 0 and sum(x[p * w + i + 1]) % count(*) <> 0 then sum(x[p * w + i + 1]) // count(*) - 1 else sum(x[p * w + i + 1]) // count(*) end as v
    from a{r}, (select unnest(range(0, 8)) as p), (select unnest(range(0, (select max(w) from k))) as i) group by all) group by p, e)""",
            f"""b{r + 1} as materialized (
  select list(es order by p) as b from (
    select o.p, list(coalesce(m{r}.c, o.c) order by o.e) as es
    from (select p, e, b[p + 1][e + 1] as c from b{r}, (select unnest(range(0, 8)) as p), (select unnest(range(0, 16)) as e) where e < len(b[1])) o
      left join m{r} on m{r}.p = o.p and m{r}.e = o.e group by o.p))""",
        ]
    parts += [
        f"z as materialized (select k.*, {nearest} as e, b from k, b6)",
        """y as (select vec_id, label, e, list_sum(list_transform(range(0, 8), lambda p: list_sum(list_transform(range(1, w + 1),
    lambda i: (x[p * w + i] - b[p + 1][e[p + 1] + 1][i]) * (x[p * w + i] - b[p + 1][e[p + 1] + 1][i])))))::bigint as error from z)""",
    ]
    return (
        "with " + ",\n".join(parts) + """
select vec_id, array_to_string(list_transform(e, lambda n: lpad(lower(hex(n)), 2, '0')), '') as code, error,
  (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(array_to_string(flatten(flatten(b)), ',')) from b6) as codebooks_sha256
from y
"""
    )


OP12_SQL = _sql()
