"""Language identification by bit-sliced Bloom filters over character n-grams.

One table serves all languages: slot i holds a bitmask with a bit per language, and the AND of the slots of an n-gram
is the set of all languages whose filter contains it; past 64 languages there is a further table for each 64. A text's n-grams are looked up at once; the population count per
language, corrected for the false positives that the language's fill predicts, decides.

The filters are fitted on a bounded sample of the labelled rows (``per_language`` rows of each language in expectation,
chosen by a hash of doc_id over the whole table) and hold each language's ``grams`` commonest n-grams; those seen in one
document only fill up a language that has fewer others. Every document is
predicted from its whole text, in a map without a shuffle; the table of the model is what is sent to the executors, and
its size depends on ``slots`` and the number of languages only.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_map, constants, mix

LETTER = regex.compile(r"\p{L}")
NGRAM, PROBES = 4, 3
WORD = 64  # languages of a table, a bit of its slots each


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # slots x bitmask of the first WORD languages
    false_rate: np.ndarray  # per language
    more: tuple[np.ndarray, ...] = ()  # the same of each WORD languages after them


class Grams:
    """Hashes of the n-grams of a text: windows of four characters whose two middle ones are letters, in lower case,
    with anything but letters as one boundary character."""

    def __init__(self) -> None:
        self.letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self.factors = constants(NGRAM, 11)

    def of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letters[codes]
        codes = np.where(letter, codes, 32).astype(np.uint64)
        n = len(codes) - NGRAM + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        good = letter[1 : n + 1] & letter[2 : n + 2]
        total = codes[:n] * self.factors[0]
        for k in range(1, NGRAM):
            total += codes[k : k + n] * self.factors[k]
        return mix(total[good])


def slots_of(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    return [((grams + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(PROBES)]


def build(languages: list[str], grams: dict[str, np.ndarray], slots: int) -> Model:
    """The table with every language's n-grams; ``slots`` is a power of two."""
    tables, rates = [], []
    for first in range(0, max(len(languages), 1), WORD):
        part = languages[first : first + WORD]
        width = next(t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if len(part) <= bits)
        table = np.zeros(slots, width)
        for k, name in enumerate(part):
            for at in slots_of(grams[name], slots):
                table[at] |= width(1 << k)
            rates.append((np.count_nonzero(table & width(1 << k)) / slots) ** PROBES)
        tables.append(table)
    return Model(languages, tables[0], np.array(rates), tuple(tables[1:]))


def predict(text: str | None, model: Model, grams: Grams) -> tuple[str, float]:
    """(language, score); ("und", 0) for a null text, one without a letter, or a model without languages.

    score is the language's share of all corrected counts. Equal counts, none at all among them, go to the language
    that is commoner in the labelled rows."""
    if not text or not model.languages or not LETTER.search(text):
        return "und", 0.0
    g = grams.of(text)
    a, b, c = slots_of(g, len(model.table))
    hits = []
    for table in (model.table, *model.more):
        masks = table[a] & table[b] & table[c]
        hits += [np.count_nonzero(masks & masks.dtype.type(1 << k)) for k in range(min(WORD, len(model.languages) - len(hits)))]
    hits = np.array(hits, float)
    counts = np.clip((hits - len(g) * model.false_rate) / (1 - model.false_rate), 0, None)
    total = counts.sum()
    best = int(np.argmax(counts))
    return model.languages[best], float(counts[best] / total) if total > 0 else 0.0


def held_out() -> F.Column:
    """crc32(doc_id as text) mod 3 is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, per_language: int = 4000, grams: int = 40_000, slots: int = 1 << 20) -> Model:
    """Learns from rows that aren't held out and whose text and lang are not null.

    To the driver come the count and the ``grams`` commonest n-grams of each language, of those seen equally often the ones
    of least hash: bounded by the parameter and the number of languages, not by the table.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where(~held_out()).where("lang is not null")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.zeros(slots, np.uint8), np.zeros(0))
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in sizes], "lang string, share double")
    sample = rows.where("text is not null").join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def run(batches):
        counter, seen = Grams(), {}
        for batch in batches:
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.setdefault(name, []).append(np.unique(counter.of(text)))
                if len(seen[name]) == 64:
                    yield counted(name, seen.pop(name))
        for name, found in seen.items():
            yield counted(name, found)

    def counted(name, found):
        g, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_pydict({"lang": [name] * len(g), "gram": pa.array(g.astype(np.int64)), "n": pa.array(n)})

    counts = sample.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Ranked in the cluster, combined before the shuffle: the driver gets the model's own n-grams and no others.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    table = counts.withColumn("nth", nth).where(F.col("nth") <= grams).select("lang", "gram").toArrow()
    names, g = table.column("lang").to_numpy(), table.column("gram").to_numpy().astype(np.uint64)
    common = {}
    for name in languages:
        common[name] = g[names == name]
    return build([x for x in languages if len(common[x])], common, slots)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per row of ``docs``; lang, source and doc_id don't enter the result.

    Null texts and texts without a letter are ``und`` with score 0. Repeated rows and null ids are kept as they come;
    other columns are not looked at. An empty table gives an empty result, and a model of an empty table ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        grams, own = Grams(), sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [predict(t, own, grams) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), F.col("text").cast("string"))
    return arrow_map(rows, make, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
