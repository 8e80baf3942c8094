"""Short test items inside long documents: size-partitioned MinHash containment search, verified exactly.

Texts are sets of word shingles (five words; a shorter text is one shingle). An item with n shingles is contained in a
document if at least `least` of the n are among the document's. Items are partitioned by n into ranges whose bounds
double. Within a range up to u, an item's sketch is its smallest hashes, as many as `u - ceil(least * u) + 1`: were
none of them in a document, more than the allowed number would be missing, so no document is lost. (Banded signatures,
which lose some, are not used: against a document a hundred times longer their Jaccard bound vanishes.)

1. Every document shingle is looked up among the sketches: pairs of document and item.
2. The shingles of those documents alone are compared with the whole items of their pairs.

Both joins are by hash value. The item side is broadcast only if counting finds at most `BROADCAST_ROWS` rows; beyond,
the shuffled join stays. One shingle that many documents share gives one row for each of them. A document is shingled
within its own row; explosion is limited to distinct hashes.

NULL, empty and wordless texts have no shingles: such items are found nowhere, such documents hold nothing. Items
with equal text are separate items. Rows that repeat a document id count as one document, whose shingles are theirs
together; rows with a NULL id are not searched, as no pair could name them. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import words, written

BROADCAST_ROWS = 200_000


def with_shingles(df: DataFrame, text: str, size: int = 5) -> DataFrame:
    """df with `hashes`, the distinct hashes of the word shingles of a lower-cased text, in the text's place."""
    # words and their hashes are columns of their own, so that they are not made anew for each shingle; for the same
    # reason the hashes are unnested by explode_outer: explode would push a copy of all this below, as a filter
    parts = df.withColumn("__words", words(F.lower(text))).drop(text)
    parts = parts.withColumn("__each", F.transform("__words", lambda w: F.xxhash64(w))).withColumn("__n", F.size("__words")).drop("__words")
    shingle = F.transform(F.sequence(F.lit(0), F.greatest(F.col("__n"), F.lit(size)) - size), lambda i: F.xxhash64(*(F.get("__each", i + k) for k in range(size))))
    # a short text's missing words are NULL and leave the hash as it is
    hashes = F.when(F.col("__n") > 0, F.array_distinct(shingle)).otherwise(F.array().cast("array<bigint>"))
    return parts.withColumn("hashes", hashes).drop("__each", "__n")


def sketch_size(n: Column, least: float) -> Column:
    """Of an item with n shingles: by the upper bound of its range of sizes."""
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long")
    # an item of n must show as many as n itself asks for, and not more than it has
    return F.least(n.cast("long"), upper - F.ceil(F.lit(least) * upper - F.lit(1e-9)) + 1)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, size: int = 5, least: float = 0.8) -> DataFrame:
    """Pairs doc_id, item_id with `shared` of `n_shingles` shingles, where shared >= least * n_shingles."""
    if not 0 < least <= 1:
        raise ValueError("least is over 0, and 1 at most")
    # rows that repeat an item are told apart by their text's hash
    own = with_shingles(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "text", size)
    own = written(own.select("item_id", F.array_sort("hashes").alias("hashes"), F.size("hashes").cast("long").alias("n"), F.monotonically_increasing_id().alias("item_row")).filter("n > 0"))
    sketch = own.select(F.explode(F.slice("hashes", F.lit(1), sketch_size(F.col("n"), least).cast("int"))).alias("hash"), "item_row")
    whole = own.select("item_row", "item_id", F.explode_outer("hashes").alias("hash"), "n")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    each = with_shingles(base, "text", size).select("doc_id", F.explode_outer("hashes").alias("hash"))
    candidates = written(each.join(_small(sketch), "hash").select("doc_id", "item_row").distinct())
    named = candidates.select("doc_id").distinct()
    again = with_shingles(base.join(_small(named), "doc_id", "left_semi"), "text", size).select("doc_id", F.explode_outer("hashes").alias("hash"))
    hits = again.join(_small(whole), "hash").join(candidates, ["doc_id", "item_row"], "left_semi")
    shared = hits.distinct().groupBy("doc_id", "item_row", "item_id", "n").agg(F.count("*").alias("shared"))
    return shared.filter(F.col("shared") >= F.lit(least) * F.col("n") - 1e-9).select("doc_id", "item_id", F.col("n").alias("n_shingles"), "shared", (F.col("shared") / F.col("n")).alias("containment")).distinct()


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that contain no item."""
    named = contained(docs, items, doc_id, text, **options).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(_small(written(named)), doc_id, "left_anti")


def clean_rows(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows whose own text contains no item, whatever their ids: rows with a NULL id are searched too, and one that
    repeats an id is judged by itself. A text goes by its hash."""
    keyed = docs.withColumn("__text", F.xxhash64(F.col(text).cast("string")))
    named = contained(keyed, items, "__text", text, **options).select(F.col("doc_id").alias("__text")).distinct()
    return keyed.join(_small(written(named)), "__text", "left_anti").drop("__text")


def least_shared(n: int, least: float = 0.8) -> int:
    return math.ceil(least * n - 1e-9)
