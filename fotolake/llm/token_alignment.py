"""Alignment of two tokenizers by an inverted index of token pairs.

Both tokenizers cut a text's bytes. Where a token of A and a token of B end together lies a cut; the tokens between two
cuts are a group, and the two tokens that end at a cut are linked. How often a pair of ids is linked in the corpus tells
how well the ids fit.

The index is inverted: for each pair of ids and each chunk of documents it holds compressed bitmaps of the documents, one
for each binary digit of the number of links in a document (planes). A bitmap is the sorted places of its documents, or
bits if that is shorter. Bitmaps of parts of a chunk are OR-merged plane by plane, which adds the numbers since no document
lies in two parts. The OR of a pair's planes has as many bits as documents hold the pair; bits of plane k count 2^k links.
These counts are summed over chunks (partly in each task first), the highest count of each id of B is found, and each
posting takes its pair's count back to the documents of its chunk. Postings of a pair are spread over SALTS places, and a
chunk is bounded in documents and bytes, so a pair that stands everywhere meets in no task.

A text is cut at single spaces between other characters before it is encoded: neither tokenizer joins anything across
those, and both cut there (`Aligner` tests what that rests on). The byte-level vocabulary is read from its file; merging in
the order of ids is the order of its merges, which is tested too. Each worker keeps the groups of what it has encoded
in a dictionary that is emptied when full.

NULL and empty texts, and texts whose tokens do not give back a blank and the text, have no tokens: zeros and an empty
digest. Repeated rows are documents of their own, ties for the highest count all count, empty tables give no rows, and
other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolake.llm.common import ranges, texts_of, written
from fotolake.operators.skew import salted_lookup

BLANK = "▁"
#: Documents and bytes of text of a chunk; bytes aligned at a time; pieces of text a worker keeps.
CHUNK, CHUNK_BYTES, PART_BYTES, CACHE = 4096, 8 << 20, 1 << 20, 400_000
SALTS = 16
#: A space between two characters that no definition takes for white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of a number of the second vocabulary's ids, and of a place in a chunk.
_B_BITS, _PLACE_BITS = 31, 12


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next letter from U+0100 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class Growing:
    """An array that rows are added to."""

    def __init__(self, shape: tuple[int, ...]) -> None:
        self.held, self.n = np.zeros((1024, *shape), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.held):
            more = np.zeros((2 * (self.n + len(rows)), *self.held.shape[1:]), np.int64)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(rows)] = rows
        self.n += len(rows)

    def rows(self) -> np.ndarray:
        return self.held[: self.n]


class Aligner:
    """Groups and links of pieces of text. Numbers stand for the pieces that are kept."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            described = json.load(f)
        letters, model = byte_letters(), described["model"]
        special = {t["id"] for t in described["added_tokens"]}
        ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if i not in special}
        split = described["pre_tokenizer"]
        if split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or described["normalizer"] or len({*map(len, ids)} & {1}) != 1 or sum(len(x) == 1 for x in ids) != 256:
            raise ValueError("the first tokenizer is not byte-level as it is known here")
        order = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError("ids do not follow the order of merges")
        self.a = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            known = b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace(BLANK, " ").encode()
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else known)
        if any(re.search(rb"[^ ] ", x) for x in self.bytes_b) or self.b.normalize("a  b ") != f"{BLANK}a{BLANK * 2}b{BLANK}":
            raise ValueError("a piece goes on over the start of a word, or texts are changed before they are cut")
        self.length_a = {i: len(x) for x, i in ids.items()}
        self.length_b = [len(x) for x in self.bytes_b]
        self.name = [str(i) for i in range(max(len(self.length_b), max(self.length_a) + 1))]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[bytes] = []
        #: Of each piece: tokens of A and B, links, whether the bytes are right, where its links end.
        self.stats = Growing((5,))
        self.links = Growing(())

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces that are not kept yet."""
        stats, links, number, text, first, bytes_b = [], [], self.number, self.text, self.a.encode_ordinary, self.bytes_b
        end = self.links.n
        for piece, ids_b in zip(pieces, self.b.encode(pieces, num_threads=1)):
            whole = " " + piece
            ids_a, before = first(whole), len(links)
            number[piece] = len(text)
            text.append(self._groups(ids_a, ids_b, links).encode())
            right = b"".join([bytes_b[i] for i in ids_b]) == whole.encode()
            stats.append((len(ids_a), len(ids_b), len(links) - before, right, end + len(links)))
        self.stats.add(np.array(stats, np.int64))
        self.links.add(np.array(links, np.int64))

    def _groups(self, ids_a: list[int], ids_b: list[int], links: list[int]) -> str:
        """The groups as text. The linked pairs, as a << 31 | b, are added to links."""
        name, length_a, length_b = self.name, self.length_a, self.length_b
        out, b, n = "", 0, len(ids_b)
        at_a = at_b = 0
        mine = theirs = ""  # tokens since the last cut, each after a comma
        for i in ids_a:
            at_a += length_a[i]
            mine += "," + name[i]
            while at_b < at_a and b < n:
                j = ids_b[b]
                at_b += length_b[j]
                theirs += "," + name[j]
                b += 1
            if at_a == at_b:
                out += f";{mine[1:]}|{theirs[1:]}"
                links.append(i << _B_BITS | j)
                mine = theirs = ""
        return out[1:]

    def align(self, texts: list[str]) -> tuple[list[tuple[int, int, int, str]], np.ndarray, np.ndarray]:
        """Of each text: tokens of A and B, groups, digest. And of all links the number of the text and the pair."""
        if len(self.number) > CACHE:
            self.clear()
        pieces = [_CUT.split(t) if t else [] for t in texts]
        fresh = list({p for own in pieces for p in own if p not in self.number})
        if fresh:
            self.learn(fresh)
        stats, flat = self.stats.rows(), self.links.rows()
        rows, owner, pairs = [], [], []
        for k, own in enumerate(pieces):
            of = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))
            mine = stats[of]
            if not len(of) or not mine[:, 3].all():
                rows.append((0, 0, 0, ""))
                continue
            n_a, n_b, n = mine[:, :3].sum(0).tolist()
            sha = hashlib.sha256(b";".join([self.text[i] for i in of.tolist()]))
            rows.append((n_a, n_b, n, sha.hexdigest()))
            # the links of each piece in turn
            counts = mine[:, 2]
            at = np.repeat(mine[:, 4] - np.cumsum(counts), counts) + np.arange(n)
            pairs.append(flat[at])
            owner.append(np.full(n, k))
        none = np.zeros(0, np.int64)
        return rows, np.concatenate([none, *owner]), np.concatenate([none, *pairs])


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    return Aligner(path_a, path_b)


# Compressed bitmaps: a first byte 0 and sorted places in two bytes each, or a first byte 1 and the bits


def bitmap(places: np.ndarray) -> bytes:
    """Of sorted, distinct places below CHUNK."""
    if 2 * len(places) <= CHUNK // 8:
        return b"\0" + places.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[places] = 1
    return b"\1" + np.packbits(bits).tobytes()


def places(bits: bytes) -> np.ndarray:
    if bits[0] == 0:
        return np.frombuffer(bits, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8, offset=1))).astype(np.uint16)


def either(left: bytes, right: bytes) -> bytes:
    """The OR of two bitmaps."""
    if left[0] and right[0]:
        return b"\1" + (np.frombuffer(left, np.uint8, offset=1) | np.frombuffer(right, np.uint8, offset=1)).tobytes()
    return bitmap(np.union1d(places(left), places(right)))


def popcount(bits: bytes) -> int:
    return (len(bits) - 1) // 2 if bits[0] == 0 else int(np.bitwise_count(np.frombuffer(bits, np.uint8, offset=1)).sum())


def planes_of(at: np.ndarray, times: np.ndarray) -> list[bytes]:
    """Plane k: the places whose number of links has binary digit k."""
    return [bitmap(at[times >> k & 1 == 1]) for k in range(int(times.max()).bit_length())]


class Chunk:
    """The index of one chunk's documents, made part by part."""

    def __init__(self) -> None:
        self.documents = self.size = 0
        self.index: dict[int, list[bytes]] = {}

    def add(self, owner: np.ndarray, pairs: np.ndarray, documents: int, size: int) -> None:
        """Links of the documents that come next."""
        keys, times = np.unique(pairs << _PLACE_BITS | (owner + self.documents), return_counts=True)
        self.documents, self.size = self.documents + documents, self.size + size
        if not len(keys):
            return
        pair, at = keys >> _PLACE_BITS, keys & (CHUNK - 1)
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        most = np.maximum.reduceat(times, starts).tolist()
        raw, small = at.astype("<u2").tobytes(), CHUNK // 16
        bounds = [*starts.tolist(), len(keys)]
        for k, key in enumerate(pair[starts].tolist()):
            a, b = bounds[k], bounds[k + 1]
            new = [b"\0" + raw[2 * a : 2 * b]] if most[k] == 1 and b - a <= small else planes_of(at[a:b], times[a:b])
            old = self.index.get(key)
            if old is None:
                self.index[key] = new
                continue
            for i, bits in enumerate(new):
                if i >= len(old):
                    old.append(bits)
                elif old[i][0] == bits[0] == 0 and len(old[i]) + len(bits) <= 2 * small + 2:
                    old[i] += bits[1:]  # later documents have later places
                else:
                    old[i] = either(old[i], bits)

    def rows(self) -> Iterator[tuple[int, list[bytes], int, int]]:
        """pair, planes, number of documents, number of links."""
        for pair, planes in self.index.items():
            if len(planes) == 1:
                n = popcount(planes[0])
                yield pair, planes, n, n
                continue
            held = planes[0]
            for bits in planes[1:]:
                held = either(held, bits)
            yield pair, planes, popcount(held), sum(popcount(bits) << k for k, bits in enumerate(planes))


# Tables

_INDEXED = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("planes", pa.list_(pa.binary())), ("n_docs", pa.int64()), ("n_links", pa.int64())])


def indexed(docs: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """A written table: a row (chunk, place, doc_id, n_a, n_b, n_groups, groups_sha256) for each document, and a posting (chunk, pair, planes, n_docs, n_links) for each pair in a chunk."""

    def batch(columns: dict[str, list], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _INDEXED], schema=_INDEXED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, chunk = TaskContext.get().partitionId() << 32, Chunk()

        def postings() -> Iterator[pa.RecordBatch]:
            rows = list(chunk.rows())
            for i in range(0, len(rows), 10_000):
                pair, planes, n_docs, n_links = zip(*rows[i : i + 10_000])
                yield batch({"chunk": [name] * len(pair), "pair": pair, "planes": planes, "n_docs": n_docs, "n_links": n_links}, len(pair))

        for b in batches:
            texts = texts_of(b.column(1))
            ids, lengths = b.column(0).to_pylist(), [len(t) for t in texts]
            for start, end in ranges(lengths, PART_BYTES):
                while start < end:
                    stop = min(end, start + CHUNK - chunk.documents)
                    rows, owner, pairs = aligner(model_a, model_b).align([t.decode("utf-8", "replace") for t in texts[start:stop]])
                    n_a, n_b, n, sha = zip(*rows)
                    yield batch({"chunk": [name] * len(rows), "doc_id": ids[start:stop], "place": range(chunk.documents, chunk.documents + len(rows)), "n_a": n_a, "n_b": n_b, "n_groups": n, "groups_sha256": sha}, len(rows))
                    chunk.add(owner, pairs, len(rows), sum(lengths[start:stop]))
                    if chunk.documents == CHUNK or chunk.size >= CHUNK_BYTES:
                        yield from postings()
                        name, chunk = name + 1, Chunk()
                    start = stop
        yield from postings()

    kinds = "chunk long, doc_id long, place int, n_a long, n_b long, n_groups long, groups_sha256 string, pair long, planes array<binary>, n_docs long, n_links long"
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds))


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, n_docs, n_links and whether no other pair of b has more links."""
    sums = index.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    b = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    named = sums.select("pair", F.shiftright("pair", _B_BITS).cast("int").alias("a"), b.cast("int").alias("b"), "n_docs", "n_links")
    return named.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b")))


def scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """chunk, place, n_best, count_sum: each posting gives its pair's count to the documents of its planes."""
    postings = index.filter("pair IS NOT NULL").select("chunk", "pair", "planes")
    met = salted_lookup(postings, counts.select("pair", "n_links", "best"), ["pair"], F.col("chunk"), salts=SALTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total = None, np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)

        def result() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], ["chunk", "place", "n_best", "count_sum"])

        for b in batches:
            chunks, n_links, is_best = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if now is not None and chunks[start] != now:
                    yield result()
                    best[:], total[:] = 0, 0
                now = int(chunks[start])
                ends = b.column(1).offsets.to_numpy()
                planes = b.column(1).values.slice(ends[start], ends[end] - ends[start]).to_pylist()
                owner = np.repeat(np.arange(start, end), np.diff(ends[start : end + 1]))
                times = 1 << (np.arange(len(planes)) - (ends[owner] - ends[start]))
                found = [places(p) for p in planes]
                sizes = [len(f) for f in found]
                at, of, times = np.concatenate(found).astype(np.int64), np.repeat(owner, sizes), np.repeat(times, sizes)
                np.add.at(total, at, n_links[of] * times)
                np.add.at(best, at, is_best[of] * times)
        if now is not None:
            yield result()

    by_chunk = met.select("chunk", "planes", "n_links", "best").repartition("chunk").sortWithinPartitions("chunk")
    return by_chunk.mapInArrow(run, "chunk long, place int, n_best long, count_sum long")


def align(docs: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of docs(doc_id, text)."""
    index = indexed(docs, model_a, model_b)
    found = scores(index, pair_counts(index))
    rows = index.filter("pair IS NULL").select("chunk", "place", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.join(found, ["chunk", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), count("n_best"), count("count_sum"), "groups_sha256")
