"""Language identification with a bit-sliced Bloom filter of character trigrams.

Training counts the trigrams of every labelled text. A language keeps its most frequent ones that have the share `mass`
of all its trigrams, the same rule at every size: the rest, at most 1 in 1000 of what is read with the default, is what
it does not learn. Each kept trigram sets the language's bit in `hashes` slots of one table of language masks. Looking a
trigram up is one AND of its slots: the result has a bit for every language that contains it (or seems to). The filter
is sized by the counted number of kept trigrams and has MOST_SLOTS rows at most, which bounds what the driver gathers and
broadcasts.

A prediction counts each language's bits over all trigrams of the text. With `f` the chance that an absent trigram
passes (the language's share of set slots to the power `hashes`), `(count - n f) / (1 - f)` is the expected number that
are really there. The largest wins; equal numbers go to the first language in order, none at all too, with score 0.

Letters are lower-cased one by one, everything else is a separator, and trigrams with two separators together are
left out. NULL, empty and letterless texts give `und` with score 0; so does a model without languages. Rows with a
NULL label or text teach nothing; repeated rows count as often as they stand. Other columns pass through untouched,
but those named `lang_pred`, `score` and `n_grams` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.llm.common import chunks, texts_of, with_fields, written

#: Bytes of text that are counted and predicted at a time: trigrams take up to sixty times the room of their text.
CHUNK, PREDICTED = 1 << 18, 1 << 18
MASK_BITS = 63
#: Share of a language's trigrams that is learnt; rows of the filter.
MASS, LEAST_SLOTS, MOST_SLOTS = 0.999, 1 << 18, 1 << 22
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    masks: np.ndarray  # slots x ceil(languages / 63), uint64
    hashes: int

    @property
    def false_rates(self) -> np.ndarray:
        bits = [(self.masks[:, i // MASK_BITS] >> np.uint64(i % MASK_BITS)) & np.uint64(1) for i in range(len(self.languages))]
        return np.array([float(b.mean()) ** self.hashes for b in bits])


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    out = np.full(0x110000, 32, np.int64)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def _trigrams(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams as whole numbers (21 bits a letter), and the row of each."""
    decoded = [r.decode("utf-8", "replace") for r in rows]
    codes = np.frombuffer("  ".join(["", *decoded, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 2 for t in decoded), np.int64, len(decoded))
    row = np.repeat(np.arange(-1, len(rows)), [2, *lengths])
    c = _letters()[codes]
    blank = c == 32
    keep = np.flatnonzero(~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:])))
    return (c[keep] << 42) | (c[keep + 1] << 21) | c[keep + 2], row[keep + 1]


def _slots(grams: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th slot of each trigram."""
    x = grams.astype(np.uint64) * np.uint64(_MIX[k % len(_MIX)] + 2 * (k // len(_MIX)))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        languages = np.array(batch.column(1).to_pylist(), object)
        rows = texts_of(batch.column(0))
        for language in set(languages):
            own = [rows[i] for i in np.flatnonzero(languages == language)]
            for a, b in chunks(own, CHUNK):
                grams, n = np.unique(_trigrams(own[a:b])[0], return_counts=True)
                if language in held:
                    grams, at = np.unique(np.concatenate([held[language][0], grams]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([held[language][1], n])).astype(np.int64)
                held[language] = grams, n
    for language, (grams, n) in held.items():
        for i in range(0, len(grams), 50_000):
            part = grams[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(part), pa.string()), pa.array(part, pa.int64()), pa.array(n[i : i + 50_000], pa.int64())], ["lang", "gram", "n"])


def _rarest(counted: DataFrame, mass: float) -> DataFrame:
    """lang and least: trigrams seen at least so often have `mass` of all of a language's trigrams. A row for each count stands in for all trigrams with it."""
    sizes = counted.groupBy("lang", "n").agg(F.sum("n").alias("held"))
    own = Window.partitionBy("lang")
    above = F.sum("held").over(own.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
    some = sizes.withColumn("above", above).withColumn("total", F.sum("held").over(own))
    return some.filter(F.col("above") < F.lit(mass) * F.col("total")).groupBy("lang").agg(F.min("n").alias("least"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", *, slots: int | None = None, hashes: int = 3, mass: float = MASS) -> LanguageModel:
    """Learns from all rows that have a text and a label: of each language the most frequent trigrams with `mass` of its trigrams, ties included.

    slots: a power of two; if not given, the next one over 8 for each trigram of the language with most, within LEAST_SLOTS and MOST_SLOTS (a fuller
    filter drops nothing, its false positives are taken off)."""
    spark = docs.sparkSession
    if slots is not None and slots & (slots - 1):
        raise ValueError("slots must be a power of two")
    labelled = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    counted = written(labelled.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    known = counted.join(F.broadcast(_rarest(counted, mass)), "lang").filter("n >= least")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if slots is None:
        slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (8 * max(sizes.values(), default=1)).bit_length()))
    bits = slots.bit_length() - 1
    masks = np.zeros((slots, max(1, -(-len(languages) // MASK_BITS))), np.uint64)
    if languages:
        facts = spark.createDataFrame([(x, i) for i, x in enumerate(languages)], "lang string, bit int")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams, bit = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                for k in range(hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(_slots(grams, k, bits), pa.int64()), pa.array(bit // MASK_BITS, pa.int32()), pa.array(np.int64(1) << (bit % MASK_BITS).astype(np.int64), pa.int64())], ["slot", "part", "mask"])

        kept = known.join(F.broadcast(facts), "lang").select("gram", "bit")
        # at most `slots` rows for each 63 languages
        placed = kept.mapInArrow(place, "slot long, part int, mask long").groupBy("slot", "part").agg(F.bit_or("mask").alias("mask")).toArrow()
        masks[placed["slot"].to_numpy(), placed["part"].to_numpy()] = placed["mask"].to_numpy().astype(np.uint64)
    return LanguageModel(languages, masks, hashes)


def _predict(rows: list[bytes], model: LanguageModel, rates: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    n_lang, bits = len(model.languages), model.masks.shape[0].bit_length() - 1
    names, scores, sizes = [], np.zeros(len(rows)), np.zeros(len(rows), np.int64)
    for a, b in chunks(rows, PREDICTED):
        grams, row = _trigrams(rows[a:b])
        n = np.bincount(row, minlength=b - a)
        counts = np.zeros((n_lang, b - a))
        found = None
        for k in range(model.hashes):
            masks = model.masks[_slots(grams, k, bits)]
            found = masks if found is None else found & masks
        for i in range(n_lang):
            bit = (found[:, i // MASK_BITS] >> np.uint64(i % MASK_BITS)) & np.uint64(1)
            counts[i] = np.bincount(row, bit, minlength=b - a)
        real = np.clip((counts - n * rates[:, None]) / np.maximum(1 - rates, 1e-9)[:, None], 0, None)
        best = real.argmax(0) if n_lang else np.zeros(b - a, int)
        most = real.max(0) if n_lang else np.zeros(b - a)
        names += [model.languages[i] if letters and n_lang else "und" for i, letters in zip(best, n)]
        scores[a:b] = np.minimum(1, most / np.maximum(n, 1))
        sizes[a:b] = n
    return names, scores, sizes


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the share of trigrams that the language knows) and n_grams."""
    spark = docs.sparkSession
    shared, rates = spark.sparkContext.broadcast(model), model.false_rates
    base = docs.drop("lang_pred", "score", "n_grams")
    at = base.columns.index(text)
    schema = with_fields(base.schema, ("lang_pred", "string"), ("score", "double"), ("n_grams", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, sizes = _predict(texts_of(batch.column(at)), shared.value, rates)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(sizes)], [*batch.schema.names, "lang_pred", "score", "n_grams"])

    return base.mapInArrow(run, schema)


def accepted(least: float = 0.5) -> Column:
    """Of a predicted row: a language was found and knows at least this share of the text's trigrams."""
    return (F.col("lang_pred") != "und") & (F.col("score") >= least)
