"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has a bit for each of 64 places, set if it is set in more than half of the hashes of the text's word
shingles. Two texts are near copies if their fingerprints differ in at most `distance` (0 to 2) bits.

Links are searched between distinct fingerprints only, so copies cost one row. If two fingerprints differ in two bits
or fewer, then one of the two halves is equal or the halves differ in one bit each. The halves are looked up in turn
and the other half is searched the same way by its own halves:

* first half equal, second within 2:   key (first, quarter) with a quarter of the second half within 1, the other equal
* second half equal, first within 2:   the same the other way round
* both halves within 1:                key (neighbour of the first, quarter) with one quarter of the second equal

Each table is keyed by 48 of the 64 bits; the fingerprint itself enters the tables, the small Hamming balls are
enumerated on the probing side, and the whole distance is verified on every match. A fingerprint has at most 2,080
others within two bits, so links grow in proportion to fingerprints, whatever the size of a group of copies.

Components are found by rounds of taking the smallest label around and then the label's own label, each round written
to the shared folder.

NULL and empty texts have fingerprint zero and link like any other. Rows with a NULL id keep their fingerprint and get
the component of equal rows (the smallest id that is not NULL). Repeated rows fall into one component. Columns named
`fingerprint` or `component_id` are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import texts_of, with_fields, written

SEED = 42
WORDS = 3
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 18


def fingerprint_of(text: bytes, size: int = WORDS) -> int:
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in parts])
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > len(hashes)).astype(np.uint64)).sum())


def fingerprints(docs: DataFrame, text: str = "text", size: int = WORDS) -> DataFrame:
    """docs with `fingerprint`, 64 bits in a signed long."""
    base = docs.drop("fingerprint")
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint_of(t, size) for t in texts_of(batch.column(at))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view(np.int64))], [*batch.schema.names, "fingerprint"])

    return base.mapInArrow(run, with_fields(base.schema, ("fingerprint", "long")))


def _ball(value: Column, bits: int) -> Column:
    """The value and all that differ from it in one of the lowest `bits` bits."""
    return F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def _key(table: int, half: Column, rest: Column) -> Column:
    """Two bits for the table, 32 for the half, 16 for the rest."""
    return F.shiftleft(half, 16).bitwiseOR(rest).bitwiseOR(F.lit(table << 48).cast("long"))


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs a < b of distinct values of prints.fingerprint that differ in 1 to `distance` bits."""
    if distance not in (0, 1, 2):
        raise ValueError("distance is 0, 1 or 2")
    spark = prints.sparkSession
    low32, low16 = F.lit(0xFFFFFFFF).cast("long"), F.lit(0xFFFF).cast("long")
    f = F.col("fingerprint")
    hi, lo = F.shiftrightunsigned(f, 32), f.bitwiseAND(low32)
    upper, lower = lambda x: F.shiftrightunsigned(x, 16), lambda x: x.bitwiseAND(low16)
    distinct = prints.select("fingerprint").dropna().distinct()
    tables = distinct.select("fingerprint", F.explode_outer(F.array(
        _key(0, hi, upper(lo)), _key(1, hi, lower(lo)), _key(2, lo, upper(hi)), _key(3, lo, lower(hi)),
    )).alias("key"))

    def probe(table: int, halves: Column, rests: Column) -> Column:
        return F.flatten(F.transform(halves, lambda h: F.transform(rests, lambda r: _key(table, h, r))))

    one = F.array(hi)
    # each row becomes a hundred probes: a fixed number of partitions keeps the few bytes before from being merged into few tasks
    spread = distinct.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "fingerprint")
    probes = spread.select("fingerprint", F.explode_outer(F.concat(
        # first half within 1, one quarter of the second equal: covers halves (1, 1) and (0, 1)
        probe(0, _ball(hi, 32), F.array(upper(lo))), probe(1, _ball(hi, 32), F.array(lower(lo))),
        # first half equal, second within 2: its upper quarter within 1, or its lower one equal (above)
        probe(0, one, F.slice(_ball(upper(lo), 16), 2, 16)),
        # second half equal, first within 2
        probe(2, F.array(lo), _ball(upper(hi), 16)), probe(3, F.array(lo), F.array(lower(hi))),
    )).alias("key"))
    a, b = probes.withColumnRenamed("fingerprint", "a"), tables.withColumnRenamed("fingerprint", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = a.join(b, "key").filter((F.col("a") != F.col("b")) & (near <= distance))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node, label) and edges(a, b): each node with the smallest label in its component, as `label`.

    Only nodes with an edge take part in the rounds."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    linked = both.select(F.col("a").alias("node")).distinct()
    state = written(nodes.join(linked, "node", "left_semi").select("node", "label", F.lit(True).alias("changed")))
    while not state.filter("changed").isEmpty():
        around = both.join(state.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        least = state.join(around, state["node"] == around["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        least = written(least)
        # a label names the component of its own node: follow it one step further
        labels = nodes.join(linked, "node", "left_semi").select("node", F.col("label").alias("own"))
        jump = least.join(labels, "node").groupBy("own").agg(F.min("label").alias("further"))
        moved = least.join(jump, least["label"] == jump["own"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        state = written(moved.select("node", "label", (~F.col("label").eqNullSafe(F.col("old"))).alias("changed")))
    return nodes.join(state.select("node", F.col("label").alias("reached")), "node", "left").select("node", F.coalesce("reached", "label").alias("label"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, size: int = WORDS) -> DataFrame:
    """docs with `fingerprint` (long) and `component_id`, the smallest id that links reach."""
    base = docs.drop("fingerprint", "component_id")
    marked = fingerprints(base.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), size=size).select("doc_id", "fingerprint")
    marked = written(marked)
    nodes = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("label")).withColumnRenamed("fingerprint", "node"))
    found = components(nodes, links(nodes.select(F.col("node").alias("fingerprint")), distance))
    # nodes with no id at all stay without a component
    return marked.join(found.select(F.col("node").alias("fingerprint"), F.col("label").alias("component_id")), "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2) -> DataFrame:
    """The rows that stand for their group: those with the smallest id, one row if it is repeated.

    Rows without an id stay; nothing else can name them."""
    first = near_duplicates(docs, doc_id, text, distance).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first.withColumnRenamed("doc_id", doc_id), doc_id, "left_semi").dropDuplicates([doc_id])
    return kept.unionByName(docs.filter(F.col(doc_id).isNull()))
