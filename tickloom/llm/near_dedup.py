"""Near-duplicate detection by MinHash bands and odd sketches, confirmed on full shingle sets.

A document's set holds the hashes of its distinct 5-word shingles. Per set, 256 MinHash samples are drawn; 32 bands of
four make bucket keys, and all 256 are folded into a 512-bit parity bitmap, the odd sketch: a bit is flipped once for
each sample that hashes to it, so equal samples of two sets cancel in the XOR of their sketches, and its population
count z estimates the similarity as ``1 + n / (4 k) * ln(1 - 2 z / n)`` (n bits, k samples), precisely where it is high.

Plan, with nothing collected to the driver but counts:

1. Sets that are equal become one *class* (one shuffle, combined before it), so copies are never paired.
2. Buckets of two classes or more: each class is linked first with the class of least id that shares most bands.
3. Buckets that still hold several components are compared by sketch, in blocks of 512 rows. First each row is paired
   with its block's medoid, the row that is on average most like the others: copies that differ too much from each
   other mostly link through the text they were made from, so this joins large groups by one pair a row.
4. What is still apart is compared in full: members of the bucket's largest component are dealt into blocks and the
   others are compared with each block, so neither a hot bucket nor a large group of near copies meets in one task,
   and members of one component are never compared with each other.
5. Pairs whose sketches look similar enough are confirmed on the full sets, recomputed from the whole texts.

Pass 4 lists at most ``per_row`` partners for a row; buckets in which a row had more are passed again without a limit,
with the texts beside the rows, so that pairs are confirmed where they meet and only links leave the task: no link is
lost to the limit, and no task lists all pairs of a group. A pair at exactly 0.75 is missed by all 32 bands with odds of 5e-6.
Set hashes have 64 bits: two different sets are taken as one with odds of 2**-64 for a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch, WordHashes, arrow_map, constants, lower_space_words, mix, runs_of, text_key

WIDTH, SAMPLES, BANDS, BITS = 5, 256, 32, 512
BLOCK = 512


def shingle_set(words: list[bytes], hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter sequence is one shingle, no words give none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    if len(words) < width:
        return runs_of(h, len(words), seed=1000 + len(words))
    return np.unique(runs_of(h, width))


def minhashes(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A MinHash sample for each factor; shingle hashes are random already, so a multiplication permutes them."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(least, np.multiply(x[k : k + 1024, None], factors[None, :]).min(axis=0), out=least)
    return least


def odd_sketches(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Rows of packed parity bitmaps for rows of MinHash samples."""
    rows, k = samples.shape
    at = mix(samples.astype(np.uint64) * np.uint64(0x100000001B3) + constants(k, 3)[None, :]) % np.uint64(bits)
    at += np.arange(rows, dtype=np.uint64)[:, None] * np.uint64(bits)
    parity = np.bincount(at.ravel().astype(np.int64), minlength=rows * bits) & 1
    return np.packbits(parity.astype(bool).reshape(rows, bits), axis=1)


def most_bits(similarity: float, samples: int = SAMPLES, bits: int = BITS) -> int:
    """The population count that odd sketches differ by at this similarity."""
    return int(bits / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / bits)))


def _signer(width: int):
    def make():
        words, bands = WordHashes(), BANDS
        factors = (constants(SAMPLES, 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        rows = SAMPLES // 2 // bands  # half the samples make the bands; all go into the sketch
        salts, steps = constants(bands, 5), constants(rows, 6)

        def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, node, samples = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(lower_space_words(text), words, width)
                n.append(len(s))
                if len(s):
                    node.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63)
                    samples.append(minhashes(s, factors))
                else:
                    node.append(None)
            keys, sketches = [], []
            for k in range(0, len(samples), 1000):
                m = np.stack(samples[k : k + 1000])
                part = m[:, : bands * rows].astype(np.uint64).reshape(len(m), bands, rows)
                keys.append(mix((part * steps).sum(axis=2, dtype=np.uint64) + salts[None, :]).astype(np.int64).ravel())
                sketches += [r.tobytes() for r in odd_sketches(m)]
            full = np.array(n) > 0
            ends = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
            them = iter(sketches)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(n, pa.int64()),
                    pa.array(node, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else [], pa.int64())),
                    pa.array([next(them) if f else None for f in full], pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "node", "bands", "sketch"],
            )

        return sign

    return make


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, bands, sketch); node is null for a document without words."""
    doc = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return arrow_map(
        doc.withColumn("text_key", text_key()),
        _signer(width),
        "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, bands array<bigint>, sketch binary",
    )


def _confirmer(width: int, percent: int):
    def make():
        words, kept = WordHashes(), {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[node] = shingle_set(lower_space_words(text), words, width)
            return kept[node]

        def confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for x, y, s, t in zip(a, b, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                p, q = of(x, s), of(y, t)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            return batch.select(["a", "b"]).filter(pa.array(good))

        return confirm

    return make


def _medoids(g: dict[str, np.ndarray], percent: int, most: int, sample: int = 256) -> Iterator[tuple[int, int, bool]]:
    """Pairs of each row with the medoid of the rows it looks similar to, taken one after another."""
    left = np.argsort(g["node"], kind="stable")
    while len(left) > 1:
        some = left[:sample]
        z = np.bitwise_count(g["sketch"][left][:, None, :] ^ g["sketch"][some][None, :, :]).sum(axis=2, dtype=np.int64)
        at = int(np.argmin(np.minimum(z, most + 1).mean(axis=1)))
        x = left[at]
        d = np.bitwise_count(g["sketch"][left] ^ g["sketch"][x]).sum(axis=1, dtype=np.int64)
        near = d <= most
        near[at] = True
        for y in left[near]:
            low, high = sorted((int(g["n"][x]), int(g["n"][y])))
            if g["comp"][x] != g["comp"][y] and 100 * low >= percent * high:
                yield int(g["node"][x]), int(g["node"][y]), False
        if near.sum() == 1:
            return  # not even the medoid is like another row
        left = left[~near]


def _compare(percent: int, most: int, per_row: int | None, medoids: bool = False, width: int | None = None):
    """Streams rows sorted by (band, kind, i, j) and lists the pairs of each block that look similar: with ``medoids``
    those with medoids, else all, or ``per_row`` for a row and a mark where there were more.

    With ``width``, rows have their text and bands as well, each pair is confirmed on the full sets in the first band
    that its rows share, and one link of a row with each other component is listed."""
    words = WordHashes()

    def block(g: dict[str, np.ndarray]) -> Iterator[tuple[int, int, bool]]:
        if medoids:
            yield from _medoids(g, percent, most)
            return
        if g["kind"][0]:
            sides = [(np.flatnonzero(g["fb"] == g["i"][0]), np.flatnonzero(g["fb"] == g["j"][0]), False)]
        else:
            few, many = np.flatnonzero(~g["major"]), np.flatnonzero(g["major"])
            sides = [(few, many, False)] + [(few, few, True)] * int(g["j"][0] == 0)
        sets: dict[int, np.ndarray] = {}
        for left, right, same in sides:
            if not len(left) or not len(right):
                continue
            for at, x in enumerate(left):
                them = right[at + 1 :] if same else right
                low, high = np.minimum(g["n"][them], g["n"][x]), np.maximum(g["n"][them], g["n"][x])
                them = them[(g["comp"][them] != g["comp"][x]) & (100 * low >= percent * high)]
                if not len(them):
                    continue
                z = np.bitwise_count(g["sketch"][them] ^ g["sketch"][x]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(z <= most)
                if width is not None:
                    yield from linked(g, sets, x, them[near])
                elif per_row and len(near) > per_row:
                    for y in them[near[np.argsort(z[near], kind="stable")[:per_row]]]:
                        yield int(g["node"][x]), int(g["node"][y]), True
                else:
                    for y in them[near]:
                        yield int(g["node"][x]), int(g["node"][y]), False

    def linked(g: dict[str, np.ndarray], sets: dict[int, np.ndarray], x: int, them: np.ndarray) -> Iterator[tuple[int, int, bool]]:
        them = them[g["bands"][x][np.argmax(g["bands"][them] == g["bands"][x], axis=1)] == g["band"][0]] if len(them) else them
        done = set()
        for y in them:
            if g["comp"][y] in done:
                continue
            for k in (x, y):
                if k not in sets:
                    sets[k] = shingle_set(lower_space_words(g["text"][k]), words, width)
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                done.add(g["comp"][y])
                yield int(g["node"][x]), int(g["node"][y]), False

    names = ["band", "kind", "i", "j", "node", "comp", "n", "fb"]

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        g = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in names}
        g["major"] = batch.column("major").to_numpy(zero_copy_only=False).astype(bool)
        g["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        if width is not None:
            g["text"] = np.array(batch.column("text").to_pylist(), object)
            g["bands"] = np.array(batch.column("bands").to_pylist(), np.int64)
        return g

    def out(found: list[tuple[int, int, int, bool]]) -> pa.RecordBatch:
        band, a, b, more = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (band, a, b)), pa.array(more)], ["band", "a", "b", "more"])

    def pairs(g: dict[str, np.ndarray]) -> Iterator[tuple[int, int, int, bool]]:
        for p in block(g):
            yield int(g["band"][0]), *p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            g = columns(batch)
            if rest is not None:
                g = {k: np.concatenate([rest[k], v]) for k, v in g.items()}
            key = np.stack([g[k] for k in names[:4]], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            starts = np.concatenate([[0], cuts])
            found = [p for s, e in zip(starts[:-1], starts[1:], strict=True) for p in pairs({k: v[s:e] for k, v in g.items()})]
            rest = {k: v[starts[-1] :] for k, v in g.items()}
            if found:
                yield out(found)
        if rest is not None and (found := list(pairs(rest))):
            yield out(found)

    return run


def _blocks(rows: DataFrame, mixed: DataFrame, classes: DataFrame, medoids: bool = False) -> DataFrame:
    """Each row of a mixed bucket once for each block in which it is compared. With ``medoids``, a row outside the largest
    component is in one block only, and of that component a block's worth of rows joins each."""
    few, many = F.ceil((F.col("rows") - F.col("most")) / F.lit(BLOCK)), F.ceil(F.col("most") / F.lit(BLOCK))
    r = rows.join(mixed, "band").join(classes.select("node", F.col("n_shingles").alias("n"), "sketch"), "node")
    r = r.withColumn("nf", few.cast("int")).withColumn("ng", many.cast("int")).withColumn("major", F.col("comp") == F.col("top"))
    r = r.withColumn("fb", F.when(~F.col("major"), F.expr("int(pmod(xxhash64(node), nf))")).otherwise(-1))
    if medoids:
        own = """if(not major, array(struct(0 as kind, fb as i, 0 as j)),
            if(pmod(xxhash64(node), ng) = 0, transform(sequence(0, nf - 1), f -> struct(0 as kind, f as i, 0 as j)), array()))"""
        return r.withColumn("block", F.explode(F.expr(own))).select("band", "block.kind", "block.i", "block.j", "node", "comp", "n", "fb", "major", "sketch")
    r = r.withColumn(
        "block",
        F.explode(
            F.expr(
                """if(major, transform(sequence(0, nf - 1), f -> struct(0 as kind, f as i, int(pmod(xxhash64(node), ng)) as j)),
                concat(transform(sequence(0, ng - 1), g -> struct(0 as kind, fb as i, g as j)),
                transform(filter(sequence(0, nf - 1), f -> f <> fb), f -> struct(1 as kind, least(f, fb) as i, greatest(f, fb) as j))))"""
            )
        ),
    )
    return r.select("band", "block.kind", "block.i", "block.j", "node", "comp", "n", "fb", "major", "sketch")


def link(docs: DataFrame, scratch: Scratch, width: int = WIDTH, percent: int = 75, slack: float = 0.2, per_row: int = 2) -> DataFrame:
    """The tables of a run: returns (node, root, component_id); "signatures", a row per document, is kept as well.

    ``slack`` is how far below the threshold an estimate may lie and still be confirmed (over five deviations).
    """
    signed = scratch.table(signatures(docs, width), "signatures", keep=True)
    full = signed.where("node is not null")
    classes = scratch.table(
        full.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"),
            F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("text_key"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    banded = classes.select(F.explode("bands").alias("band"), "node")
    shared = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("rows")).where("rows > 1")
    shared = scratch.table(shared.drop("rows"), "shared")
    rows = scratch.table(banded.join(shared, "band"), "rows")

    needed = rows.select("node").distinct().join(classes.select("node", F.col("doc_id").alias("d"), F.col("text_key").alias("k")), "node")
    doc = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("text_key", text_key())
    found = needed.join(doc, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key")))
    texts = scratch.table(found.select("node", "text").dropDuplicates(["node"]), "texts")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        a, b = texts.toDF("na", "text_a"), texts.toDF("nb", "text_b")
        both = pairs.join(a, F.col("a") == F.col("na")).join(b, F.col("b") == F.col("nb"))
        return scratch.table(arrow_map(both.select("a", "b", "text_a", "text_b"), _confirmer(width, percent), "a bigint, b bigint"), name)

    stars = rows.where("node <> leader").groupBy("node", "leader").count().where("count > 2")
    stars = stars.groupBy(F.col("node").alias("a")).agg(F.max_by("leader", "count").alias("b"))
    tried = scratch.table(stars, "pairs0")
    links = confirmed(tried, "links0")
    labels = components(links, scratch, "c0")

    for step, (medoids, limit) in enumerate(((True, None), (False, per_row), (False, None)), 1):
        named = rows.join(labels, "node", "left").select("band", "node", F.coalesce("root", "node").alias("comp"))
        named = scratch.table(named, f"named{step}")
        sizes = named.groupBy("band", "comp").agg(F.count("*").alias("c"))
        mixed = sizes.groupBy("band").agg(
            F.max_by("comp", "c").alias("top"), F.max("c").alias("most"), F.sum("c").alias("rows"), F.count("*").alias("comps")
        )
        mixed = scratch.table(mixed.where("comps > 1"), f"mixed{step}")
        blocks = _blocks(named, mixed if limit or medoids else mixed.join(crowded, "band", "left_semi"), classes, medoids)
        keys, most = ["band", "kind", "i", "j"], most_bits(percent / 100 - slack)
        exact = not limit and not medoids
        if exact:
            blocks = blocks.join(texts.join(classes.select("node", "bands"), "node"), "node")
        similar = blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
            _compare(percent, most, limit, medoids, width if exact else None), "band bigint, a bigint, b bigint, more boolean"
        )
        similar = scratch.table(similar, f"similar{step}")
        pairs = similar.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if exact:
            links = links.unionByName(pairs)
        else:
            seen = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = scratch.table(pairs.join(seen, ["a", "b"], "left_anti"), f"pairs{step}")
            links = links.unionByName(confirmed(pairs, f"links{step}"))
            tried = tried.unionByName(pairs)
        labels = components(links, scratch, f"c{step}")
        crowded = similar.where("more").select("band").distinct()
        if not medoids and crowded.isEmpty():
            break

    linked = labels.join(classes.select("node", "doc_id"), "node")
    least = scratch.table(linked.groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    reach = scratch.table(linked.select("node", "root").join(least, "root").select("node", "root", "least"), "reach")
    nodes = classes.select("node", "doc_id").join(reach, "node", "left")
    nodes = nodes.select("node", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return scratch.table(nodes, "nodes", keep=True)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, node, root, component_id, kept.

    node is the class of equal sets (null without words), root the component's node. component_id is the smallest doc_id of the component; kept
    says whether the row carries it. Rows without words are linked with nothing. A null doc_id takes part in links, but
    names a component only where all its ids are null; such rows are kept. Rows that repeat a doc_id in one component
    are all kept. Other columns of ``docs`` are not looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark, "near-dedup") as scratch:
        nodes = link(docs, scratch, width, percent)
        signed = spark.read.schema("doc_id bigint, text_key bigint, n_shingles bigint, node bigint").parquet(scratch.path("signatures"))
    found = signed.join(nodes, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return found.select("doc_id", "text_key", "n_shingles", "node", "root", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, width: int = WIDTH, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with one row of each component; rows without words all stay.

    Of rows with the component's doc_id, the one with the least text key stays, and of equal ones one.
    """
    found = near_duplicates(docs, width, percent).where("kept and node is not null")
    named = found.groupBy("root").agg(F.min("component_id").alias("doc"), F.min("text_key").alias("key")).drop("root")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("own"), text_key().alias("text"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    once = rows.where("worded").join(named, F.col("own").eqNullSafe(F.col("doc")) & (F.col("text") == F.col("key")))
    once = once.withColumn("nth", F.expr("row_number() over (partition by doc, key order by text)")).where("nth = 1")
    return once.select("row").unionByName(rows.where("not worded").select("row")).select("row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws from documents),
sh as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) end) as s from w)),
n as (select doc_id, count(*) as n from sh group by doc_id),
met as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
linked as (
  select a, b from met join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),
ways as (select a, b from linked union all select b, a from linked),
reach as (
  select doc_id as d, doc_id as r from w
  union select reach.d, ways.b from reach join ways on reach.r = ways.a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.least as component_id, w.doc_id = c.least as kept
from w join (select d, min(r) as least from reach group by d) c on c.d = w.doc_id left join n on n.doc_id = w.doc_id
"""
