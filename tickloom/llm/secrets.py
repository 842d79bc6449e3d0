"""Secret scan in DataFrame functions only: pattern spans, and spans by sliding-window Shannon entropy.

Positions come from the pieces between matches: ``split`` and ``regexp_extract_all`` walk the same leftmost
non-overlapping matches, so the lengths of pieces and matches add up to the offsets, in code points.

Candidates of the entropy scan are runs of 20 or more characters of ``[A-Za-z0-9+/_=-]`` with a letter and a digit. A
window of 20 characters slides over a candidate; the counts of its characters, and the sum of c * log2(c) over them, are
carried along and corrected for the one character that leaves and the one that enters; the entropy is log2(20) - sum / 20.
Counts are kept as fields of a few 64-bit numbers, and sums as whole multiples of 2^-40, so that a step costs the same at
every place and nothing drifts. The
candidate's class (hexadecimal, letters and digits, or with other characters) sets the limit that its highest window
must reach. An allow-list drops UUIDs, dates, words that mark examples, and alphabets written in order. Candidates
that lie in a span of the patterns add nothing.

The scan is a projection: no shuffle, no Python. Texts without a match cost one pass for each pattern; time grows with the
length of a text, and of a candidate, in proportion.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|(?i:example|sample|placeholder|changeme|dummy|redacted|your[_-]|xxxx)"
    r"|abcdefgh|ABCDEFGH|12345678|[0-9]{4}-[0-9]{2}-[0-9]{2}"
)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class Entropy:
    """Window length in characters, and the bits that its entropy must reach by class of the candidate."""

    window: int = 20
    hex: float = 3.03
    alnum: float = 3.57
    other: float = 3.63


SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often and in whatever lambda it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, start: Column, kind: str, step: Callable[..., tuple[Column, Column]], share: Callable[[Column, Column], Column] | None = None, block: int = 256) -> Column:
    """The outs of a fold that gives one for each item: ``step`` takes carry and item to (carry, out of type ``kind``), and
    with ``share`` also what that makes, once, of the carry before a block of items and the block.

    An array that grows by one is copied at each step, so the outs are gathered in blocks, and the blocks in a list."""
    none, no_blocks = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def one(state: Column, x: Column, *shared: Column) -> Column:
        carry, out = step(state["carry"], x, *shared)
        return F.struct(carry.alias("carry"), F.concat(state["outs"], F.array(out)).alias("outs"))

    def fold(xs: Column) -> Column:
        def part(state: Column, k: Column) -> Column:
            zero = F.struct(state["carry"].alias("carry"), none.alias("outs"))
            done = lambda s: F.struct(s["carry"].alias("carry"), F.concat(state["blocks"], F.array(s["outs"])).alias("blocks"))
            items = F.slice(xs, k * block + 1, F.lit(block))
            if share is None:
                return F.aggregate(items, zero, lambda s, x: one(s, x), done)
            return let(F.struct(share(state["carry"], items).alias("shared"), items.alias("items")), lambda b: F.aggregate(b["items"], zero, lambda s, x: one(s, x, b["shared"]), done))

        n = F.size(xs)
        numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(numbers, F.struct(start.alias("carry"), no_blocks.alias("blocks")), part, lambda s: F.flatten(s["blocks"]))

    return let(items, fold)


def matched(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """[{start, end, value, part}] of the matches in code points; of ``group`` (part) at least ``least`` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group is not None else whole
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("value"), part.alias("part"))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        begin = at + F.char_length(m["gap"])
        end = (begin + F.char_length(m["value"])).cast("bigint")
        return end, F.struct(begin.cast("bigint").alias("start"), end.alias("end"), m["value"].alias("value"), m["part"].alias("part"))

    found = running(both, F.lit(0).cast("bigint"), "struct<start:bigint,end:bigint,value:string,part:string>", step)
    return F.filter(found, lambda m: F.char_length(m["part"]) >= least) if least else found


# Counts are fields of 5 bits, 12 to a number, for the characters from "+" to "z".
_FIRST, _FIELDS, _NUMBERS, _ONE = 43, 12, 7, 1 << 40


def highest_entropy(value: Column, window: int) -> Column:
    """The highest Shannon entropy of the windows of ``value`` (characters from "+" to "z"), by counts carried from window
    to window; 0 for a value shorter than the window, which may have 31 characters at most."""
    assert 2 <= window <= 31
    logs = F.array(*(F.lit(round(_ONE * c * math.log2(c)) if c else 0).cast("bigint") for c in range(window + 1)))
    log = lambda c: F.element_at(logs, (c + 1).cast("int"))

    def moves_of(codes: Column) -> Column:
        """Of each place the number and shift of the count that grows and of the one that falls, and whether a window is whole."""
        field = lambda c: F.struct(F.floor(c / _FIELDS).cast("int").alias("number"), (5 * F.pmod(c, F.lit(_FIELDS))).alias("shift"))
        late = F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), window), codes), F.lit(1), F.size(codes))
        both = F.arrays_zip(codes.alias("come"), late.alias("gone"))
        return F.transform(both, lambda m, k: F.struct(field(m["come"]).alias("to"), F.when(m["gone"].isNotNull(), field(m["gone"])).alias("off"), (k >= window - 1).alias("whole")))

    moves = let(F.transform(F.split(value, ""), lambda c: F.ascii(c) - _FIRST), moves_of)

    def step(state: Column, m: Column) -> Column:
        to, off = m["to"], m["off"]
        count = lambda f: F.call_function("shiftright", F.element_at(state["counts"], f["number"] + 1), f["shift"]).bitwiseAND(F.lit(31).cast("bigint"))
        gone = F.coalesce(count(off), F.lit(0).cast("bigint"))
        come = count(to) - F.coalesce((to == off).cast("bigint"), F.lit(0).cast("bigint"))
        total = state["sum"] + log(F.greatest(gone - 1, F.lit(0))) - log(gone) + log(come + 1) - log(come)
        bit = lambda f, k: F.when(f["number"] == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), f["shift"])).otherwise(0)
        counts = F.transform(state["counts"], lambda x, k: x + bit(to, k) - bit(off, k))
        least = F.when(m["whole"], F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(counts.alias("counts"), total.alias("sum"), least.alias("least"))

    none = round(_ONE * window * math.log2(window))
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), _NUMBERS).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(none).cast("bigint").alias("least"))
    return F.aggregate(moves, start, step, lambda s: math.log2(window) - s["least"] / float(_ONE * window))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def scan(df: DataFrame, rules: Entropy = Entropy()) -> DataFrame:
    """``df`` with the columns base_spans and secret_spans, arrays of {kind, start, end} in code points, end exclusive,
    by start and then kind (assign, access, hex, entropy); columns of these names that ``df`` has are replaced.

    secret_spans holds base_spans and what the entropy scan adds. A null or empty text has no spans. Nothing else of
    a row is looked at, so nulls elsewhere, repeated rows and other columns don't matter.
    """
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c not in ("base_spans", "secret_spans")]
    return _scanned(df, rules).select(*kept, "base_spans", "secret_spans")


def _scanned(df: DataFrame, rules: Entropy) -> DataFrame:
    """row (a struct of the columns of ``df``), base_spans and secret_spans."""
    none = F.expr(f"cast(array() as {SPAN})")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lower = F.lower(text)
    named = F.contains(lower, F.lit(WORDS[0]))
    for w in WORDS[1:]:
        named = named | F.contains(lower, F.lit(w))
    assign = F.when(named, _spans(matched(text, ASSIGN, 1, 6), "assign")).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(matched(text, ACCESS), "access")).otherwise(none)
    hexes = F.when(text.rlike(HEX), _spans(matched(text, HEX), "hex")).otherwise(none)

    def limit(v: Column) -> Column:
        return F.when(v.rlike("^[0-9a-fA-F]+$"), rules.hex).when(v.rlike("^[0-9A-Za-z]+$"), rules.alnum).otherwise(rules.other)

    drawn = F.filter(matched(text, CANDIDATE), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & ~m["value"].rlike(ALLOWED))
    drawn = F.filter(drawn, lambda m: highest_entropy(m["value"], rules.window) >= limit(m["value"]))
    entropy = F.when(text.rlike(CANDIDATE), _spans(drawn, "entropy")).otherwise(none)

    rank = lambda s: F.array_position(F.array(*map(F.lit, ("assign", "access", "hex", "entropy"))), s["kind"])
    sort = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    def within(reach: Column, s: Column) -> tuple[Column, Column]:
        """The furthest end of the base spans so far; a span and whether it stays. At one start, base spans come first."""
        drawn_one = s["rank"] == 4
        return F.when(drawn_one, reach).otherwise(F.greatest(reach, s["end"])), F.struct(plain(s).alias("span"), (~drawn_one | (reach < s["end"])).alias("stays"))

    every = running(sort(F.concat("base_spans", "secret_spans")), F.lit(-1).cast("bigint"), "struct<span:struct<kind:string,start:bigint,end:bigint>,stays:boolean>", within)
    every = F.transform(F.filter(every, lambda s: s["stays"]), lambda s: s["span"])
    out = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.concat(assign, access, hexes).alias("base_spans"), entropy.alias("secret_spans"))
    order = F.transform(sort(F.col("base_spans")), plain).alias("base_spans")
    return out.select("row", order, F.when(F.size("secret_spans") > 0, every).otherwise(order).alias("secret_spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: Entropy = Entropy()) -> DataFrame:
    """The rows of ``docs`` with each run of overlapping spans replaced by ``mark``, and n_chars (where there is such a
    column) counted anew for texts that changed; all other columns, whatever their names, and rows stay as they are."""
    spans, text = F.col("secret_spans"), F.col("row.text").cast("string")

    def part(at: Column, block: Column) -> Column:
        """The text that a block of spans reaches, so that pieces are not counted off from the start of a long one."""
        size = F.array_max(F.transform(block, lambda s: s["end"])) - at
        return F.struct(at.alias("from"), F.substring(text, (at + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int")).alias("text"))

    def step(at: Column, s: Column, near: Column) -> tuple[Column, Column]:
        piece = F.substring(near["text"], (at - near["from"] + 1).cast("int"), (s["start"] - at).cast("int"))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.concat(piece, F.lit(mark))).otherwise("")

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    clean = F.concat(F.array_join(running(spans, F.lit(0).cast("bigint"), "string", step, part), ""), F.substring(text, (end + 1).cast("int"), F.lit(2**31 - 1)))
    found = _scanned(docs, rules).withColumn("clean", F.when(F.size(spans) > 0, clean))
    changed = F.col("clean").isNotNull()

    def column(c: str) -> Column:
        kind, old = docs.schema[c].dataType, F.col("row").getField(c)
        if c == "text":
            return F.when(changed, F.col("clean").cast(kind)).otherwise(old).alias(c)
        return F.when(changed, F.char_length("clean").cast(kind)).otherwise(old).alias(c) if c == "n_chars" else old.alias(c)

    return found.select(*map(column, docs.columns))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), base, joined("secret_spans").alias("spans"))


OP5_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
raw as (
  select doc_id, 1 as rank, 'assign' as kind, text, PATTERN_ASSIGN as p from t
  union all select doc_id, 2, 'access', text, 'AKIA[A-Z0-9]+' from t
  union all select doc_id, 3, 'hex', text, '[0-9a-f]+' from t
  union all select doc_id, 4, 'entropy', text, '[A-Za-z0-9+/_=-]+' from t),
cut as (
  select doc_id, rank, kind, ms, list_transform(gs, lambda x: length(x)) as gl, list_transform(ms, lambda x: length(x)) as ml,
    case when rank = 1 then regexp_extract_all(text, p, 2) else ms end as part
  from (select doc_id, rank, kind, text, p, regexp_extract_all(text, p) as ms, string_split_regex(text, p) as gs from raw)),
places as (
  select doc_id, rank, kind, unnest(ms) as v, unnest(part) as part, unnest(gl[: len(ms)]) as g, unnest(ml) as m,
    unnest(range(len(ms))) as i from cut),
spans as (
  select doc_id, rank, kind, v, length(part) as n, s - m as start, s as "end"
  from (select *, sum(g + m) over (partition by doc_id, rank order by i) as s from places)),
base as (
  select * from spans where (rank = 1 and n >= 6) or (rank = 2 and n >= 20) or (rank = 3 and n >= 24)),
tried as (
  select *, list_max(list_transform(range(0, n - 19), lambda k: list_aggregate(string_split(substring(v, (k + 1)::bigint, 20), ''), 'entropy'))) as bits
  from spans where rank = 4 and n >= 20 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')
    and not regexp_matches(v, PATTERN_ALLOWED)),
more as (
  select * from tried t where bits >= case when regexp_full_match(v, '[0-9a-fA-F]+') then 3.03
    when regexp_full_match(v, '[0-9A-Za-z]+') then 3.57 else 3.63 end
  and not exists (select 1 from base b where b.doc_id = t.doc_id and b.start <= t.start and b."end" >= t."end")),
every as (
  select doc_id, rank, kind, start, "end" from base union all select doc_id, rank, kind, start, "end" from more),
joined as (
  select doc_id, count(*) filter (rank = 1) as a, count(*) filter (rank = 2) as b, count(*) filter (rank = 3) as c,
    string_agg(kind || ':' || start::bigint || ':' || "end"::bigint, ',' order by start, rank) filter (rank < 4) as base,
    string_agg(kind || ':' || start::bigint || ':' || "end"::bigint, ',' order by start, rank) as spans
  from every group by doc_id)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join joined using (doc_id)
""".replace("PATTERN_ASSIGN", "'" + ASSIGN.replace("(?i:", "(").replace("password|passwd|secret|token|api_?key", "(?i:password|passwd|secret|token|api_?key)").replace("'", "''") + "'").replace("PATTERN_ALLOWED", "'" + ALLOWED + "'")
