"""Benchmark decontamination by templates, in DataFrame functions alone.

Texts become templates: marks are dropped, numbers, names and units give way to typed placeholders. Windows of template words of the
documents are hash-joined with those of the benchmark items. Along each alignment of a document with an item (the distance between
their positions) the values in the placeholders must map one to one, so a question with other numbers or names is caught,
and a chance match of placeholders is not; windows that break the mapping do not count, the others do. An item leaks if enough of its windows are found.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, texts_of

#: Words of a window; the share of an item's windows that makes a leak, in percent; words that a shorter item must have to be looked for inside texts; windows
#: of the benchmark up to which its table is broadcast (about 20 MB); beyond it the join shuffles, and a window's documents are dealt to so many tasks.
WIDTH, PERCENT, LEAST, BROADCAST_ROWS, SALTS = 5, 80, 3, 200_000, 32
#: The units, and the letters that stand for a name, a number and a unit (not used in any language's text).
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "s", "ms", "min", "h", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "a", "j", "kj", "pa", "k", "c", "f", "usd", "eur", "gbp", "percent", "kb", "mb", "gb", "tb")
NAME, NUMBER, UNIT = "ꟻ", "ꟼ", "ꟽ"


def marked(text: Column) -> Column:
    """Words with their marks dropped; a capitalised word inside a sentence is led by NAME."""
    named = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{Nd}],? )", NAME)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(named, r"[^\p{L}\p{Nd}\s]+", ""), r"[\p{Z}\s]+", " ")))


def template(words: Column) -> Column:
    """marked() text with placeholders, word for word."""
    t = F.when(F.contains(words, F.lit(NAME)), F.regexp_replace(words, f"{NAME}[^ ]*", NAME)).otherwise(words)
    digits = F.regexp_replace(t, r"\p{Nd}+", NUMBER)
    return F.when(F.contains(digits, F.lit(NUMBER)), F.regexp_replace(digits, f"(?<={NUMBER} ?)({'|'.join(UNITS)})(?= |$)", UNIT)).otherwise(digits)


def windows(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """rows (keys, text) -> (keys, words, shape, bare, at, kind, h): every window of template words, or the whole text if it is shorter.

    Whether a capitalised word is a name depends on the word before it, so a window's first word stands as it is (kind 0). If it was taken for a name, the window comes once more with its placeholder (kind 1), and with names behind it, once more with all names as words (kind 2), as a copy in other case has them.
    bare, the template with names as words, is null where there are no names and it is the shape."""
    named = F.contains("plain", F.lit(NAME))
    plain = F.replace("plain", F.lit(NAME), F.lit(""))
    held = rows.select(*keys, marked(F.col("text")).alias("plain"))
    held = held.select(*keys, F.split(F.when(named, plain).otherwise(F.col("plain")), " ").alias("words"), F.split(template(F.col("plain")), " ").alias("shape"), F.when(named, F.split(template(plain), " ")).alias("bare"))
    last = F.greatest(F.size("shape") - width, F.lit(0))
    # no lambdas here, so that windows are made and hashed in generated code; every fourth code is a window of kind 0, and a text without words has none
    codes = F.when(F.col("bare").isNull(), F.sequence(F.lit(0), last * 4, F.lit(4))).otherwise(F.sequence(F.lit(0), last * 4 + 2))
    coded = held.select(*keys, "words", "shape", "bare", F.explode(F.when(F.get("words", F.lit(0)) != "", codes)).alias("code"))
    at = coded.select(*keys, "words", "shape", "bare", F.shiftright("code", 2).alias("at"), F.col("code").bitwiseAND(3).alias("kind"))
    name = [F.get("shape", F.col("at") + k).eqNullSafe(NAME) for k in range(width)]
    fine = (F.col("kind") == 0) | ((F.col("kind") == 1) & name[0]) | ((F.col("kind") == 2) & reduce(or_, name[1:], F.lit(False)))
    return at.filter(fine).withColumn("h", F.xxhash64(*shown(width)))


def shown(width: int) -> list[Column]:
    """The words of a window as its kind shows them."""
    word = lambda literal, at: F.when(literal, F.get(F.coalesce("bare", "shape"), at)).otherwise(F.get("shape", at))
    return [word(F.col("kind") != 1, F.col("at"))] + [word(F.col("kind") == 2, F.col("at") + k) for k in range(1, width)]


def slots(width: int, places: bool = False) -> Column:
    """The values behind a window's placeholders, in order, or their places in the text."""
    return F.array_compact(F.array(*[F.when(s != F.get("words", F.col("at") + k), F.col("at") + k if places else F.get("words", F.col("at") + k)) for k, s in enumerate(shown(width))]))


def pair(p: Column) -> Column:
    return F.struct(p["i"].alias("i"), p["d"].alias("d"))


def same(w: Column) -> Column:
    return F.forall(w["pairs"], lambda p: p["i"] == p["d"])


def consistent() -> Column:
    """The windows of ws that are verbatim or keep to one mapping of values: of pairs that share just one side the one at more places stands, at a tie the one that changes nothing."""
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  value is worked out once
    counts = lambda every: F.transform("pairs", lambda p: F.struct(F.size(F.filter(every, lambda x: pair(x) == p)).alias("n"), (p["i"] == p["d"]).alias("same"), p["i"].alias("i"), p["d"].alias("d")))
    stands = lambda counted: F.filter(counted, lambda p: ~F.exists(counted, lambda q: ((q["i"] == p["i"]) != (q["d"] == p["d"])) & (q > p)))
    good = F.transform(let(let(F.array_distinct(F.flatten("ws.pairs")), counts), stands), pair)
    return let(good, lambda held: F.filter("ws", lambda w: same(w) | F.forall(w["pairs"], lambda p: F.array_contains(held, pair(p)))))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, share, changed): each document that holds an item, by at least percent of its distinct windows.

    changed tells that some placeholder holds another value than in the item; along such an alignment windows with another value of which half or more is placeholders count only beside one that has fewer. Null and empty texts, and texts without letters or digits, hold
    nothing and leak nothing. An item of fewer words than a window is one window of its own width; with LEAST words or more it is found inside texts, with fewer only where it is the whole text. Rows without
    an id are dropped; repeated items are one, repeated documents one row each pair; extra columns are ignored."""
    items = benchmark.select(column(benchmark, "item_id", "bigint").alias("item_id"), column(benchmark, "text", "string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.max("text").alias("text"))
    every = windows(items, ["item_id"], width)
    bare = F.coalesce("bare", "shape")
    first = F.xxhash64(F.get(bare, "at"), *[F.get("shape", F.col("at") + k) for k in range(1, width)])
    w = every.select("item_id", "h", first.alias("id"), F.col("at").alias("item_at"), slots(width).alias("item_slots"), slots(width, True).alias("places"), F.size("words").alias("size")).withColumn("weak", F.size("item_slots") * 2 >= F.least("size", F.lit(width)))
    n = w.groupBy("item_id").agg(F.countDistinct("id").alias("n_windows"))
    rows, short = w.count(), [r[0] for r in w.filter((F.col("size") >= LEAST) & (F.col("size") < width)).select("size").distinct().collect()]  # fewer sizes than width
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    own, other, on = (texts_of(docs), F.broadcast(w), ["h"]) if rows <= BROADCAST_ROWS else (texts_of(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), w.select("*", salt), ["h", "salt"])
    pairs = lambda k: F.arrays_zip(F.col("item_slots").alias("i"), slots(k).alias("d"), F.col("places").alias("at"))
    hits = [windows(own, ["doc_id", *on[1:]], k).join(other, on).select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), F.struct("id", "weak", pairs(k).alias("pairs")).alias("w")) for k in (width, *short)]
    hit = reduce(DataFrame.union, hits)
    # along one alignment an item's window comes once of each kind, so a group is bounded by the item
    lined = hit.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("w").alias("ws")).withColumn("pairs", F.array_distinct(F.transform(F.flatten("ws.pairs"), pair)))
    fits = (F.size(F.array_distinct(F.col("pairs.i"))) == F.size("pairs")) & (F.size(F.array_distinct(F.col("pairs.d"))) == F.size("pairs"))
    # windows that are mostly placeholders say nothing by themselves where values have changed
    settled = lined.withColumn("ws", F.when(fits, F.col("ws")).otherwise(consistent())).withColumn("backed", F.exists("ws", lambda w: ~w["weak"]))
    kept = settled.select("doc_id", "item_id", F.explode(F.filter("ws", lambda w: F.col("backed") | same(w))).alias("w")).select("doc_id", "item_id", "w.id", (~same(F.col("w"))).alias("changed"))
    each = kept.groupBy("doc_id", "item_id").agg(F.countDistinct("id").alias("n_found"), F.max("changed").alias("changed"))
    return each.join(n, "item_id").filter(F.col("n_found") * 100 >= F.col("n_windows") * percent).select("doc_id", "item_id", "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("share"), "changed")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_leaking")).distinct()
    return docs.join(found, docs["doc_id"].cast("bigint") == found["_leaking"], "left_anti")
