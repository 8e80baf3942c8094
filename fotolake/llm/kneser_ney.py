"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped arrays.

Words are 64-bit hashes of their bytes. Training makes, in the shared folder,

* the word table: hashes in ascending order with their counts, in files by the hash's highest bits. A word's id is its
  place in the whole order, so an id needs no dictionary;
* the bigram table: keys `id of the first word << 32 | id of the second` in ascending order with counts. The file of a
  key follows from the running total of word counts, with the second id dividing the bigrams of one frequent word over
  as many files as its count needs, so that no file holds many more than `SHARD` tokens;
* the context table, by word id: how often it is a context, how many words follow it once, twice and more often, and
  how many words come before it.

Tasks combine counts before they are shuffled, and each file is merged and written by one task, whole or not at all.
The driver sees one number for each file and the counts of counts. The model grows with the corpus.

p(w | v) = max(c(v w) - D, 0) / c(v) + g(v) q(w), with D one of three discounts by c and g(v) what they took away;
q(w) is built the same way from the numbers of words before w, over the even chance 1 / (V + 1) that a word never
seen has too. The end token is the context of a first word.

NULL and empty texts are one end token. An empty corpus gives every token the chance 1. Rows with a NULL id are
neither held out nor learnt from where the caller selects by id; repeated rows count as often as they stand. Columns
named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import chunks, map_array, put_array, shared_folder, texts_of, with_fields

CHUNK = 1 << 22
#: Tokens whose counts one file of the model holds, about.
SHARD = 4_000_000
#: Distinct entries a task combines before it lets them go.
HELD = 4_000_000
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RANDOM.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(1, 2**63, dtype=np.uint64)) | 1
END = np.uint64(0x5851F42D4C957F2D)


@cache
def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    value = 1
    for i in range(n):
        out[i] = value
        value = value * _BASE % 2**64
    return out


def _tokens(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends in order, and the number of tokens of each row."""
    data = np.frombuffer(b"\n".join([*rows, b""]), np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in rows), np.int64, len(rows))) - 1
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(first):
        stop = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        inside = np.flatnonzero(~space)
        lengths = stop - first
        place = inside - np.repeat(first, lengths)
        low = np.where((data >= 65) & (data <= 90), data + 32, data)
        value = _BYTES[low[inside]] * _powers(1 << int(max(int(lengths.max()), 256) - 1).bit_length())[place]
        hashes = np.add.reduceat(value, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(32)
    else:
        hashes = np.zeros(0, np.uint64)
    row_of = np.searchsorted(ends, first, "left")
    n = np.bincount(row_of, minlength=len(rows)) + 1
    out = np.empty(len(first) + len(rows), np.uint64)
    at_end = np.cumsum(n) - 1
    out[at_end] = END
    mask = np.ones(len(out), bool)
    mask[at_end] = False
    out[mask] = hashes
    return out, n


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys with the sums of their counts."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, count = key[order], np.concatenate(counts)[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new], (np.add.reduceat(count, new) if len(new) else count)


class _Counter:
    """Counts that a task combines; `spill` gives them away by file, packed."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> bool:
        key, count = np.unique(keys, return_counts=True)
        self.keys.append(key)
        self.counts.append(count.astype(np.int64))
        self.size += len(key)
        if self.size > HELD:
            k, c = _sum(self.keys, self.counts)
            self.keys, self.counts, self.size = [k], [c], len(k)
        return self.size > HELD * 3 // 4

    def spill(self, shard_of) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        key, count = _sum(self.keys, self.counts)
        self.__init__()
        shard = shard_of(key)
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        for a, b in zip(edges, [*edges[1:], len(key)]):
            yield _packed(int(shard[a]), key[a:b], count[a:b])


def _packed(shard: int, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Ascending keys byte by byte (all highest bytes, then the next) and counts as short as they fit: these compress well."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if int(count.max()) <= np.iinfo(t).max)
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([key.astype('>u8').view(np.uint8).reshape(-1, 8).T.tobytes()], pa.binary()), pa.array([count.astype(kind).tobytes()], pa.binary()), pa.array([len(key)], pa.int64())], ["shard", "keys", "counts", "n"])


PACKED = "shard int, keys binary, counts binary, n long"


def _unpacked(keys: bytes, counts: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(counts) // n]
    key = np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, n).T).view('>u8').ravel()
    return key.astype(np.uint64), np.frombuffer(counts, kind).astype(np.int64)


@dataclass(frozen=True)
class NgramModel:
    folder: str
    word_starts: tuple[int, ...]  # the id of the first word of each file, and their number
    tokens: int
    shards: int
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_gamma: float  # of the even chance
    continuations: int

    @property
    def size(self) -> int:
        return self.word_starts[-1]


class _Words:
    """The word table in a worker."""

    def __init__(self, folder: str, starts: tuple[int, ...]) -> None:
        self.bits = (len(starts) - 2).bit_length()
        self.starts = np.array(starts, np.int64)
        self.hashes = [map_array(folder, f"words-{i}.npy") if starts[i + 1] > starts[i] else np.zeros(0, np.uint64) for i in range(len(starts) - 1)]
        self.counts = [map_array(folder, f"counts-{i}.npy") if starts[i + 1] > starts[i] else np.zeros(0, np.int64) for i in range(len(starts) - 1)]

    def find(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ascending hashes, -1 if unknown, and counts."""
        ids, counts = np.full(len(sorted_hashes), -1, np.int64), np.zeros(len(sorted_hashes), np.int64)
        edges = np.searchsorted(sorted_hashes, [np.uint64(i) << np.uint64(64 - self.bits) for i in range(1, len(self.hashes))]) if self.bits else np.zeros(0, np.int64)
        for i, (a, b) in enumerate(zip([0, *edges], [*edges, len(sorted_hashes)])):
            own = self.hashes[i]
            if b > a and len(own):
                at = np.minimum(np.searchsorted(own, sorted_hashes[a:b]), len(own) - 1)
                hit = own[at] == sorted_hashes[a:b]
                ids[a:b] = np.where(hit, at + self.starts[i], -1)
                counts[a:b] = np.where(hit, self.counts[i][at], 0)
        return ids, counts

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, at = np.unique(hashes, return_inverse=True)
        ids, counts = self.find(distinct)
        return ids[at], counts[at]


class _Places:
    """The file of a bigram: by the total count of the words before the first one, then by the second id."""

    def __init__(self, words: _Words, folder: str, tokens: int, shards: int) -> None:
        self.words, self.tokens, self.shards = words, tokens, shards
        self.before = [map_array(folder, f"before-{i}.npy") if len(h) else np.zeros(0, np.int64) for i, h in enumerate(words.hashes)]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Files of ascending keys, ascending too."""
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.float64)
        before, count = np.zeros(len(keys)), np.zeros(len(keys))
        file = np.searchsorted(self.words.starts, first, "right") - 1
        edges = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]]))
        for a, b in zip(edges, [*edges[1:], len(keys)]):
            i = int(file[a])
            at = first[a:b] - self.words.starts[i]
            before[a:b], count[a:b] = self.before[i][at], self.words.counts[i][at]
        where = (before + count * (second / self.words.starts[-1])) / max(self.tokens, 1)
        return np.minimum((where * self.shards).astype(np.int64), self.shards - 1)


@cache
def _words_of(folder: str, starts: tuple[int, ...]) -> _Words:
    return _Words(folder, starts)


@cache
def _places_of(folder: str, starts: tuple[int, ...], tokens: int, shards: int) -> _Places:
    return _Places(_words_of(folder, starts), folder, tokens, shards)


def _pairs(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bigram keys of token ids; before each first token stands an end."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    if len(ids):
        before[0] = ids[n[0] - 1]
    return (before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole files out of packed rows that come sorted by file."""
    shard, keys, counts = None, [], []
    for batch in batches:
        for s, k, c, n in zip(*(col.to_pylist() for col in batch.columns)):
            if s != shard and keys:
                yield shard, *_sum(keys, counts)
                keys, counts = [], []
            shard = s
            key, count = _unpacked(k, c, n)
            keys.append(key)
            counts.append(count)
            if len(keys) >= 64:
                key, count = _sum(keys, counts)
                keys, counts = [key], [count]
    if keys:
        yield shard, *_sum(keys, counts)


def _by_file(packed: DataFrame, files: int) -> DataFrame:
    return packed.repartition(files, "shard").sortWithinPartitions("shard")


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of entries that were counted once to four times."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(min(max(d, 0.05), i + 0.95)) for i, d in enumerate(raw))  # type: ignore[return-value]


def train(docs: DataFrame, text: str = "text") -> NgramModel:
    """Counts all texts of docs. Reads them twice: for words, then for bigrams."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    source = docs.select(F.col(text).cast("string").alias("text"))
    parallel = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    word_bits = max(0, (parallel - 1).bit_length())

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counter()
        shard_of = (lambda k: (k >> np.uint64(64 - word_bits)).astype(np.int64)) if word_bits else (lambda k: np.zeros(len(k), np.int64))
        for batch in batches:
            rows = texts_of(batch.column(0))
            for a, b in chunks(rows, CHUNK):
                if held.add(_tokens(rows[a:b])[0]):
                    yield from held.spill(shard_of)
        yield from held.spill(shard_of)

    def put_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, key, count in _merged(batches):
            put_array(folder, f"words-{shard}.npy", key)
            put_array(folder, f"counts-{shard}.npy", count)
            put_array(folder, f"before-{shard}.npy", np.cumsum(count) - count)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(key)]), pa.array([int(count.sum())])], ["shard", "n", "total"])

    files = {r["shard"]: (r["n"], r["total"]) for r in _by_file(source.mapInArrow(count_words, PACKED), 1 << word_bits).mapInArrow(put_words, "shard long, n long, total long").collect()}
    sizes = [files.get(i, (0, 0)) for i in range(1 << word_bits)]
    starts = tuple(int(x) for x in np.concatenate([[0], np.cumsum([n for n, _ in sizes])]))
    totals = np.concatenate([[0], np.cumsum([t for _, t in sizes])])
    tokens = int(totals[-1])
    if tokens == 0:
        return NgramModel(folder, starts, 0, 1, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 1.0, 0)
    if starts[-1] >= 1 << 31:
        raise ValueError("more than 2^31 distinct words: ids must be widened")
    # running totals inside a file become running totals of all
    offsets = [int(t) for t in totals[:-1]]
    shards = max(parallel, -(-tokens // SHARD))

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                if starts[i + 1] > starts[i]:
                    counts = np.asarray(map_array(folder, f"counts-{i}.npy"))
                    put_array(folder, f"before-{i}.npy", np.cumsum(counts) - counts + offsets[i])
            yield batch

    spark.range(0, 1 << word_bits, 1, min(1 << word_bits, parallel)).mapInArrow(shift, "id long").count()

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = _Counter(), _words_of(folder, starts)
        shard_of = _places_of(folder, starts, tokens, shards).of
        for batch in batches:
            rows = texts_of(batch.column(0))
            for a, b in chunks(rows, CHUNK):
                hashes, n = _tokens(rows[a:b])
                if held.add(_pairs(words.of(hashes)[0], n)):
                    yield from held.spill(shard_of)
        yield from held.spill(shard_of)

    # what each file knows of its words, given to the files of the context table
    width = max(1, -(-starts[-1] // shards))

    def put_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: np.ndarray, columns: list[np.ndarray], kind: int) -> Iterator[pa.RecordBatch]:
            part = ids // width
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(ids) else []
            for a, b in zip(edges, [*edges[1:], len(ids)]):
                data = np.stack([ids[a:b], *(c[a:b] for c in columns)])
                yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([kind], pa.int32()), pa.array([data.astype(np.uint32 if data.max() < 2**32 else np.int64).tobytes()], pa.binary()), pa.array([b - a], pa.int64()), pa.array([len(columns) + 1], pa.int32()), pa.array([None], pa.list_(pa.int64()))], ["part", "kind", "data", "n", "width", "of_counts"])

        for shard, key, count in _merged(batches):
            put_array(folder, f"pairs-{shard}.npy", key)
            put_array(folder, f"times-{shard}.npy", count.astype(np.uint32) if count.max() < 2**32 else count)
            first, second = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            yield from rows(first[new], [np.add.reduceat(x.astype(np.int64), new) for x in (count, count == 1, count == 2, count >= 3)], 0)
            yield from rows(*(lambda w, n: (w, [n]))(*np.unique(second, return_counts=True)), 1)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([2], pa.int32()), pa.array([b""], pa.binary()), pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([[int((count == i).sum()) for i in range(1, 5)] + [len(key)]], pa.list_(pa.int64()))], ["part", "kind", "data", "n", "width", "of_counts"])

    facts = _by_file(source.mapInArrow(count_pairs, PACKED), shards).mapInArrow(put_pairs, "part int, kind int, data binary, n long, width int, of_counts array<long>")

    def put_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(part: int, table: np.ndarray) -> pa.RecordBatch:
            put_array(folder, f"contexts-{part}.npy", table.astype(np.uint32) if table.max() < 2**32 else table)
            before = table[4]
            return pa.RecordBatch.from_arrays([pa.array([[int((before == i).sum()) for i in range(1, 5)] + [int((before > 0).sum())] + [0] * 5], pa.list_(pa.int64()))], ["of_counts"])

        part, table = None, None
        for batch in batches:
            for p, kind, data, n, columns, of_counts in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 2:
                    yield pa.RecordBatch.from_arrays([pa.array([[0] * 5 + of_counts], pa.list_(pa.int64()))], ["of_counts"])
                    continue
                if p != part:
                    if table is not None:
                        yield put(part, table)
                    part, table = p, np.zeros((5, min(width, starts[-1] - p * width)), np.int64)
                values = np.frombuffer(data, np.uint32 if len(data) == 4 * n * columns else np.int64).reshape(columns, n).astype(np.int64)
                at = values[0] - p * width
                if kind == 0:
                    table[:4, at] += values[1:]
                else:
                    table[4, at] += values[1]
        if table is not None:
            yield put(part, table)

    gathered = facts.repartition(shards, "part").sortWithinPartitions("part").mapInArrow(put_contexts, "of_counts array<long>")
    sums = gathered.select(*(F.sum(F.col("of_counts")[i]).alias(f"s{i}") for i in range(10))).first()
    continuations = int(sums[9])
    word_d = _discounts(*(int(sums[i]) for i in range(4)))
    n1, n2 = int(sums[0]), int(sums[1])
    taken = word_d[0] * n1 + word_d[1] * n2 + word_d[2] * (int(sums[4]) - n1 - n2)
    return NgramModel(folder, starts, tokens, shards, _discounts(*(int(sums[i]) for i in range(5, 9))), word_d, taken / max(continuations, 1), continuations)


class _Scorer:
    """The whole model in a worker; the operating system holds the pages that are used."""

    def __init__(self, model: NgramModel) -> None:
        self.model, self.empty = model, model.tokens == 0
        if self.empty:
            return
        self.words = _words_of(model.folder, model.word_starts)
        self.places = _places_of(model.folder, model.word_starts, model.tokens, model.shards)
        self.width = max(1, -(-model.size // model.shards))
        self.end = int(self.words.of(np.array([END], np.uint64))[0][0])
        self.open: dict[str, np.ndarray | None] = {}

    def array(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            try:
                self.open[name] = map_array(self.model.folder, name)
            except FileNotFoundError:  # a file that would hold nothing
                self.open[name] = None
        return self.open[name]

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        """Facts of ascending ids, by column."""
        out = np.zeros((5, len(ids)), np.int64)
        part = ids // self.width
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(ids) else []
        for a, b in zip(edges, [*edges[1:], len(ids)]):
            table = self.array(f"contexts-{int(part[a])}.npy")
            if table is not None:
                out[:, a:b] = table[:, ids[a:b] - int(part[a]) * self.width]
        return out

    def times(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ascending keys."""
        out = np.zeros(len(keys), np.int64)
        file = self.places.of(keys)
        edges = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]])) if len(keys) else []
        for a, b in zip(edges, [*edges[1:], len(keys)]):
            own = self.array(f"pairs-{int(file[a])}.npy")
            if own is not None:
                at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
                out[a:b] = np.where(own[at] == keys[a:b], self.array(f"times-{int(file[a])}.npy")[at], 0)
        return out

    def score(self, rows: list[bytes]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each row."""
        m = self.model
        hashes, n = _tokens(rows)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        if self.empty:
            zero = np.zeros(len(rows))
            return n, np.zeros(len(rows), np.int64), zero, zero
        ids, counts = self.words.of(hashes)
        base = np.log10((counts + 0.5) / (m.tokens + 0.5 * (m.size + 1)))
        # the chance of each distinct word by the numbers of words before it
        known = ids >= 0
        distinct, at = np.unique(ids[known], return_inverse=True)
        facts = self.contexts(distinct)
        even = m.word_gamma / (m.size + 1)
        q = np.full(len(ids), even if m.continuations else 1 / (m.size + 1))
        q[known] = (_kept(facts[4], m.word_discounts) / max(m.continuations, 1) + even)[at]
        chance = q.copy()
        before = np.concatenate([[self.end], ids[:-1]])
        pair = known & (before >= 0)
        keys, at_key = np.unique((before[pair].astype(np.uint64) << np.uint64(32)) | ids[pair].astype(np.uint64), return_inverse=True)
        times = self.times(keys)[at_key]
        # each row ends in the end token, so `distinct` holds every context
        place = np.zeros(len(ids), np.int64)
        place[known] = at
        place = np.concatenate([[np.searchsorted(distinct, self.end)], place[:-1]])
        total, once, twice, more = (facts[i][place] for i in range(4))
        seen = (before >= 0) & (total > 0)
        d = m.bigram_discounts
        left = np.where(seen, (d[0] * once + d[1] * twice + d[2] * more) / np.maximum(total, 1), 1.0)
        chance = left * q
        chance[pair] += np.where(seen[pair], _kept(times, d) / np.maximum(total[pair], 1), 0)
        return n, np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(chance), starts)


def _kept(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discount."""
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0)


@cache
def _scorer(model: NgramModel) -> _Scorer:
    return _Scorer(model)


def score(docs: DataFrame, model: NgramModel, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    base = docs.drop(*added)
    at = base.columns.index(text)
    schema = with_fields(base.schema, *((name, "long" if name in added[:3] else "double") for name in added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            rows = texts_of(batch.column(at))
            made = [scorer.score(rows[a:b]) for a, b in chunks(rows, CHUNK)]
            n, known, plain, own = (np.concatenate([m[i] for m in made]) if made else np.zeros(0) for i in range(4))
            n, known = n.astype(np.int64), known.astype(np.int64)
            new = [pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(plain), pa.array(own), pa.array(10.0 ** np.minimum(-own / np.maximum(n, 1), 300.0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    return base.mapInArrow(run, schema)
