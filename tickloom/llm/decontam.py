"""Benchmark decontamination by a prefix-filtered set join of word shingles.

Each item's windows of 10 consecutive words (an item of fewer is one window) are sets of 3-word shingles at fixed places
(shorter windows: their whole sequence). A document contains a window only if it has every shingle of it, so of each
window one shingle has to be joined: the first in an order by rarity among all items. A hit of that shingle in a document
fixes where the window would have to start; the positional and length bounds drop starts outside the document, and what
is left is confirmed word by word over the window.

Any one order of the shingles gives the same result. Rarity is counted over the items, which are all at hand, and not over
the documents, which would have to be read once more.

Items of ``block_bytes`` of text or less are made into an index of flat arrays (their words once, and 30 bytes a window),
which is sent to the executors; it takes at most 24 times the text, and about 7 times in prose. Documents then pass through
one map: no shuffle. Larger sets are joined: documents give only the places whose shingle a Bloom filter of fixed size lets
through, and these are dealt by shingle and a salt, so that a passage that many documents share is no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, WordHashes, lower_alnum_words, mix, runs_of

WINDOW, SHINGLE = 10, 3


@dataclass(frozen=True)
class Part:
    """The windows of one shingle length, sorted by their prefix shingle (token) and then by their whole text: number of
    the first word, place of the shingle, words, item, and where the next unlike window stands."""

    token: np.ndarray
    start: np.ndarray
    place: np.ndarray
    length: np.ndarray
    item: np.ndarray
    after: np.ndarray


@dataclass(frozen=True)
class Index:
    """parts by shingle length; text: all items' words, each with a space after it; offsets: of each word; names: of each
    item its id as a string, null for none."""

    parts: dict[int, Part]
    text: bytes
    offsets: np.ndarray
    names: list[str | None]

    def size(self) -> int:
        return len(self.text) + self.offsets.nbytes + sum(x.nbytes for p in self.parts.values() for x in vars(p).values())


def _ranks(hashes: np.ndarray) -> np.ndarray:
    """Of each hash its place in the order by rarity, and among equally rare ones by the hash."""
    unique, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    rank = np.empty(len(unique), np.int32)
    rank[np.lexsort((unique, counts))] = np.arange(len(unique), dtype=np.int32)
    return rank[inverse]


def build_index(items: list[Row], window: int = WINDOW, shingle: int = SHINGLE) -> Index:
    """Index of rows (item_id, text). A window of a null id is looked for, but names no item."""
    word_hashes, names, texts, lengths = WordHashes(), [], [], []
    shingles: dict[int, list[np.ndarray]] = {}
    wholes: dict[int, list[np.ndarray]] = {}
    begins: dict[int, list[tuple[int, int, int]]] = {}  # of each item: its number, first word, window's words
    at = 0
    for r in items:
        words = lower_alnum_words(r["text"])
        if not words:
            continue
        size, n = min(shingle, len(words)), min(window, len(words))
        hashes = word_hashes.of(words)
        shingles.setdefault(size, []).append(runs_of(hashes, size))
        wholes.setdefault(size, []).append(runs_of(hashes, n, 11))
        begins.setdefault(size, []).append((len(names), at, n))
        names.append(None if r["item_id"] is None else str(r["item_id"]))
        texts.append(b" ".join(words) + b" ")
        lengths.append(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        at += len(words)
    text = b"".join(texts)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(lengths))]) if lengths else np.zeros(1, np.int64)
    parts = {}
    for size, runs in shingles.items():
        rank, k = _ranks(np.concatenate(runs)), 0
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for (item, first, n), run, whole in zip(begins[size], runs, wholes[size], strict=True):
            own = rank[k : k + len(run)]
            k += len(run)
            place = np.lib.stride_tricks.sliding_window_view(own, n - size + 1).argmin(axis=1)
            starts = np.arange(len(place))
            for column, value in zip(columns, (run[starts + place], whole, first + starts, place, np.full(len(place), n), np.full(len(place), item)), strict=True):
                column.append(value)
        token, whole, start, place, length, item = (np.concatenate(c) for c in columns)
        order = np.lexsort((item, whole, token))
        token, whole, start, place, length, item = (x[order] for x in (token, whole, start, place, length, item))
        like = (token[1:] == token[:-1]) & (whole[1:] == whole[:-1]) & (length[1:] == length[:-1])
        for i in np.flatnonzero(like).tolist():  # equal hashes are no proof
            a, b, n = int(start[i]), int(start[i + 1]), int(length[i])
            like[i] = text[offsets[a] : offsets[a + n]] == text[offsets[b] : offsets[b + n]]
        ends = np.append(np.flatnonzero(~like) + 1, len(token))
        after = ends[np.searchsorted(ends, np.arange(len(token)), side="right")]
        parts[size] = Part(token, start.astype(np.int32), place.astype(np.uint16), length.astype(np.uint16), item.astype(np.int32), after.astype(np.int32))
    return Index(parts, text, offsets, names)


def search(words: list[bytes], hashes: np.ndarray, index: Index) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, items) of every occurrence of a window of ``index`` in a document's words."""
    out = []
    for size, part in index.parts.items():
        run = runs_of(hashes, size)
        if not len(run):
            continue
        near = np.searchsorted(part.token, run)
        near[near == len(part.token)] = 0
        for i in np.flatnonzero(part.token[near] == run).tolist():
            k = int(near[i])
            while k < len(part.token) and part.token[k] == run[i]:
                n, w, after = int(part.length[k]), int(part.start[k]), int(part.after[k])
                start = i - int(part.place[k])
                if start >= 0 and start + n <= len(words) and b" ".join(words[start : start + n]) == index.text[index.offsets[w] : index.offsets[w + n] - 1]:
                    out.append((start, start + n, part.item[k:after]))
                k = after
    return out


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


_FOUND = "n_words bigint, spans array<array<bigint>>, items array<string>"


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = 16 << 20) -> DataFrame:
    """row (a struct of the columns of ``docs``, of which text is looked at), n_words, spans (merged [start, end) of
    words) and items (sorted ids)."""
    item = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    size = item.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    if size > block_bytes:
        return _joined(rows, item, window, shingle)
    sent = docs.sparkSession.sparkContext.broadcast(build_index(item.collect(), window, shingle))
    return rows.mapInArrow(_searcher(sent), f"row {rows.schema['row'].dataType.simpleString()}, {_FOUND}")


def _searcher(sent):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column("text"):
                words = lower_alnum_words(text.as_py())
                found = search(words, hashes.of(words), sent.value)
                counts.append(len(words))
                spans.append(merged([(a, b) for a, b, _ in found]))
                named = {int(i) for _, _, own in found for i in own}
                items.append(sorted({sent.value.names[i] for i in named} - {None}))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

    return run


# --- sets of items beyond a block

_BITS, _SALTS = 28, 8


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _item_places(window: int, shingle: int):
    """item, item_id, at, size, token, n, text: every shingle of the items, and the window that starts with it (null where
    none does)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for number, name, text in zip(batch.column("item").to_pylist(), batch.column("item_id").to_pylist(), batch.column("text"), strict=True):
                words = lower_alnum_words(text.as_py())
                if not words:
                    continue
                size, n = min(shingle, len(words)), min(window, len(words))
                tokens = runs_of(hashes.of(words), size)
                texts = [b" ".join(words[k : k + n]).decode("utf-8", "replace") if k + n <= len(words) else None for k in range(len(tokens))]
                m = len(tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * m, pa.int64()), pa.array([name] * m, pa.string()), pa.array(range(m), pa.int32()), pa.array([size] * m, pa.int32()), _signed(tokens), pa.array([n] * m, pa.int32()), pa.array(texts, pa.string())],
                    ["item", "item_id", "at", "size", "token", "n", "text"],
                )

    return run


def _slots(tokens: np.ndarray, sizes: np.ndarray | int) -> list[np.ndarray]:
    h = mix(tokens + np.asarray(sizes).astype(np.uint64))
    return [h >> np.uint64(64 - _BITS), (h << np.uint64(_BITS)) >> np.uint64(64 - _BITS)]


def _bits(batches):
    """slot, bits: of each token the bits of the filter it sets, in words of 64."""
    for batch in batches:
        token = batch.column("token").to_numpy(zero_copy_only=False).view(np.uint64)
        slots = np.concatenate(_slots(token, batch.column("size").to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), _signed(np.uint64(1) << (slots & np.uint64(63)))], ["slot", "bits"])


def _doc_places(sent, sizes: list[int], window: int):
    """key, at, size, token, words: the places of documents whose shingle the filter lets through, with the words that any
    window about it can have (from at - window + 1 on)."""

    def run(batches):
        hashes, bits = WordHashes(), sent.value
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                words = lower_alnum_words(text.as_py())
                hashed = hashes.of(words)
                for size in sizes:
                    tokens = runs_of(hashed, size)
                    hit = np.ones(len(tokens), bool)
                    for s in _slots(tokens, size):
                        hit &= (bits[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) > 0
                    for i in np.flatnonzero(hit).tolist():
                        around = [words[k].decode("utf-8", "replace") if 0 <= k < len(words) else None for k in range(i - window + 1, i + window)]
                        rows.append((key, i, size, int(tokens[i].view(np.int64)), around))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["key", "at", "size", "token", "words"])

    return run


def _joined(rows: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    spark = rows.sparkSession
    with Scratch(spark, "decontam") as scratch:
        item = items.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("string").alias("item_id"), "text").dropDuplicates(["item", "item_id"])
        places = scratch.table(item.mapInArrow(_item_places(window, shingle), "item bigint, item_id string, at int, size int, token bigint, n int, text string"), "places")
        counts = places.groupBy("size", "token").agg(F.count("*").alias("seen"))
        w = Window.partitionBy("item", "item_id").orderBy("at")
        ranked = places.join(counts, ["size", "token"]).withColumn("rank", F.struct("seen", "token", "at"))
        # A window of n words has n - size + 1 shingles, which is the same number in all but the shortest items.
        frames = [(size, n) for size, n in places.select("size", "n").distinct().collect()]
        first = F.lit(None)
        for size, n in frames:
            first = F.when((F.col("size") == size) & (F.col("n") == n), F.min("rank").over(w.rowsBetween(0, n - size))).otherwise(first)
        found = ranked.withColumn("first", first).where("text is not null").select("item_id", "size", F.col("first.token").alias("token"), (F.col("first.at") - F.col("at")).alias("place"), "n", "text")
        found = scratch.table(found, "windows")
        unlike = found.groupBy("text").agg(F.min(F.struct("size", "token", "place", "n")).alias("w")).select("text", "w.*")
        bits = found.select("size", "token").distinct().mapInArrow(_bits, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
        filled = np.zeros(1 << (_BITS - 6), np.uint64)
        filled[bits["slot"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).view(np.uint64)
        sent = spark.sparkContext.broadcast(filled)
        key = F.md5(F.coalesce("text", F.lit("")))
        docs = rows.select(key.alias("key"), "text").where("text is not null")
        asked = docs.mapInArrow(_doc_places(sent, sorted({size for size, _ in frames}), window), "key string, at int, size int, token bigint, words array<string>")
        asked = asked.withColumn("salt", F.pmod(F.hash("key"), F.lit(_SALTS)))
        dealt = unlike.withColumn("salt", F.explode(F.array(*map(F.lit, range(_SALTS)))))
        own = F.slice("words", F.lit(window) - F.col("place"), F.col("n"))
        hits = asked.join(dealt, ["size", "token", "salt"]).where((F.size(F.array_compact(own)) == F.col("n")) & (F.array_join(own, " ") == F.col("text")))
        hits = scratch.table(hits.select("key", (F.col("at") - F.col("place")).cast("bigint").alias("start"), F.col("n").cast("bigint").alias("n"), F.col("text").alias("window")).distinct(), "hits")
        spans = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))  # at most a document's words
        named = found.select(F.col("text").alias("window"), "item_id").where("item_id is not null").distinct()
        ids = hits.select("key", "window").distinct().join(named, "window").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        every = scratch.table(spans.join(ids, "key", "left"), "found", keep=True)
    out = rows.withColumn("key", key).join(every, "key", "left")
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))).cast("bigint")
    none = F.expr("cast(array() as array<array<bigint>>)")
    return out.select("row", count.alias("n_words"), F.coalesce(_merged(F.col("spans")), none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def _merged(spans: Column) -> Column:
    """``merged`` on a sorted column."""

    def step(state: Column, s: Column) -> Column:
        last = F.element_at(state, -1)
        joins = (F.size(state) > 0) & (s["start"] <= F.element_at(last, 2))
        grown = F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(F.array(F.element_at(last, 1), F.greatest(F.element_at(last, 2), s["end"]))))
        return F.when(joins, grown).otherwise(F.concat(state, F.array(F.array(s["start"], s["end"]))))

    return F.aggregate(spans, F.expr("cast(array() as array<array<bigint>>)"), step)


def contamination(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, one row per row of ``docs``.

    spans are the merged [start, end) of hit words and n_hit their words; items are the ids, as strings and sorted, of
    items with a window in the document. Null and empty texts, of documents or items, have no words; items with a null
    id are looked for but not named; repeated items count once, repeated documents as they come. Other columns are not
    looked at. Empty tables give no rows, or no hits.
    """
    found = find(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), items, **options)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return found.select("row.doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


def decontaminate(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns, whatever their names, as they are."""
    return find(docs, items, **options).where(F.size("spans") == 0).select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
iwin as (
  select distinct item_id, least(10, len(ws)) as k, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') as s
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) as i from iw where len(ws) > 0)),
ks as (select distinct k from iwin),
dwin as (
  select doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') as s
  from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from dw), ks where i + k - 1 <= len(ws)),
hit as (select doc_id, i, d.k, item_id from dwin d join iwin w on d.k = w.k and d.s = w.s),
words as (
  select doc_id, count(distinct i + j) as n_hit from (select distinct doc_id, i, k from hit), (select unnest(range(10)) as j)
  where j < k group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id::varchar as item_id from hit where item_id is not null) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""
