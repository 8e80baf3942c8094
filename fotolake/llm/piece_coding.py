"""Encoding with a merge-type sentencepiece model by a table of last tokens, and decoding.

Merging the best pair first gives every prefix of a text one encoding, so one last token. The tokens that may end a
prefix are those an Aho-Corasick automaton reports there; exactly one of them follows the last token of the prefix
before it as merging would have it. That is tested on the pair alone: merging their joined letters must give the two
back (what a sequence merges to is decided by its neighbouring pairs). The table of last tokens is filled from left to
right and the ids are read off it backwards.

A text is prepared as the model says (here: one blank is put in front, blanks become U+2581). No piece has another
character before a U+2581, so merges never cross the start of a word and words are encoded one by one; each worker
keeps what it has encoded in a dictionary that is emptied when full. For the same reason a word falls apart between
characters that no piece has side by side. Characters without a piece become their bytes.

NULL and empty texts have the end id alone and decode to the empty text. Repeated rows are encoded alike, ties cannot
occur (scores of pieces are distinct or go to the left pair), columns with other names pass through, and those named
like a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType

from fotolake.llm.common import ranges, texts_of, with_fields

BLANK = "▁"
#: Words a worker keeps where it gives digests, and where it gives ids too; bytes of text whose ids it holds at a time.
CACHE, SMALL_CACHE = 200_000, 40_000
CHUNK = 1 << 18
_EDGE = re.compile(r"(?<=\w)(?=\W)|(?<=\W)(?=\w)")
_SEGMENT = re.compile(f"{BLANK}+[^{BLANK}]*")


class PieceCoder:
    """Ids of words and texts. The model file is read for its pieces, their scores and kinds only."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        import ahocorasick
        import sentencepiece

        self.most = cache

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        if model.normalize("a  b ") != f"{BLANK}a{BLANK * 2}b{BLANK}":
            raise ValueError("only models that put one blank in front and change nothing else are known here")
        self.end = model.eos_id()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw: dict[int, bytes] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif model.is_control(i) or model.is_unknown(i):
                self.raw[i] = b""
            else:
                self.score[piece], self.ids[piece] = model.get_score(i), i
                self.raw[i] = piece.replace(BLANK, " ").encode()
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("a piece goes on over the start of a word")
        #: Of each piece: its id as text, and its bytes.
        self.made = {p: (str(i), self.raw[i]) for p, i in self.ids.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[str, bytes]] = {}
        #: Neighbouring characters of pieces: between any others a text falls apart.
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.tails: dict[str, tuple[str, bytes]] = {}
        # a piece that merging would never make cannot stand in an encoding
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self._merge(piece) == [piece]:
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()

    def _merge(self, text: str) -> list[str]:
        """Joins the pair with the best score, the left one of equals, until no pair is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, left: str, right: str) -> bool:
        if len(self.fits) >= 2 * self.most:
            self.fits.clear()
        known = self.fits[left, right] = self._merge(left + right) == [left, right]
        return known

    def pieces(self, word: str) -> list[str]:
        """The pieces of a prepared text."""
        # of each prefix; where no piece ends or follows, the character stands alone
        last = ["", *word]
        done, known, follows = -1, self.fits.get, self._follows
        for end, (piece, size) in self.automaton.iter(word):
            if end != done:
                start = end + 1 - size
                if start:
                    fits = known((last[start], piece))
                    if fits is None:
                        fits = follows(last[start], piece)
                    if not fits:
                        continue
                last[end + 1] = piece
                done = end
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def word(self, name: str) -> tuple[str, bytes]:
        """Of a word after its blank: the ids joined by blanks, and what they decode to."""
        # only where letters end or begin is it worth a look whether the word falls apart
        edges = None if name.isalpha() else _EDGE.split(name)
        if edges is None or len(edges) == 1:
            return self._coded(BLANK + name)
        joins, parts = self.joins, [edges[0]]
        for part in edges[1:]:
            if parts[-1][-1] + part[0] in joins:
                parts[-1] += part
            else:
                parts.append(part)
        ids, raw, known = [], [], self.words
        for i, part in enumerate(parts):
            got = known.get(part)
            if got is None:
                if len(known) >= self.most:
                    known.clear()
                got = known[part] = self._coded(part if i else BLANK + part)
            ids.append(got[0])
            raw.append(got[1])
            known = self.tails
        return " ".join(ids), b"".join(raw)

    def _coded(self, word: str) -> tuple[str, bytes]:
        ids, raw, made = [], [], self.made
        for piece in self.pieces(word):
            got = made.get(piece)
            if got is None:
                got = " ".join([str(self.byte_ids[b]) for b in piece.encode("utf-8", "surrogatepass")]), piece.encode("utf-8", "surrogatepass")
            ids.append(got[0])
            raw.append(got[1])
        return " ".join(ids), b"".join(raw)

    def parts(self, text: str) -> list[tuple[str, bytes]]:
        """Of each word of a text, with the blank before it."""
        known = self.words
        if len(known) >= self.most:
            known.clear()
        if not text:
            return []
        if BLANK in text or "  " in text or text[0] == " " or text[-1] == " ":
            names = [s[1:] for s in _SEGMENT.findall(BLANK + text.replace(" ", BLANK))]
        else:
            names = text.split(" ")
        out = list(map(known.get, names))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    name = names[i]
                    out[i] = known.get(name) or known.setdefault(name, self.word(name))
        return out

    def encode(self, text: str) -> list[int]:
        """Ids with the end id."""
        return [int(i) for p in self.parts(text) for i in p[0].split(" ")] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, the blank in front taken away, bytes that are not UTF-8 replaced."""
        text = b"".join(self.raw[i] for i in ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and the digests of the ids and of the decoded text."""
        parts = self.parts(text)
        ids = " ".join([*map(itemgetter(0), parts), str(self.end)])
        decoded = b"".join(map(itemgetter(1), parts))
        try:
            decoded.decode()
        except UnicodeDecodeError:
            decoded = decoded.decode("utf-8", "replace").encode()
        if decoded.startswith(b" "):
            decoded = decoded[1:]
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@cache
def coder(path: str, words: int = CACHE) -> PieceCoder:
    """One for each worker process."""
    return PieceCoder(path, words)


def _mapped(docs: DataFrame, column: str, added: list[tuple[str, str | DataType, pa.DataType]], row) -> DataFrame:
    base = docs.drop(*(name for name, _, _ in added))
    at = base.columns.index(column)
    is_text = isinstance(base.schema[column].dataType, StringType)
    schema = with_fields(base.schema, *((name, kind) for name, kind, _ in added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few texts at a time: ids take many times the room of their text
            sizes = pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False) if is_text else pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False) * 4
            for a, b in ranges(np.nan_to_num(sizes).astype(int).tolist(), CHUNK):
                part = batch.slice(a, b - a)
                values = part.column(at)
                made = [row(x) for x in (texts_of(values) if is_text else values.to_pylist())]
                new = [pa.array([m[i] for m in made], kind) for i, (_, _, kind) in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(n for n, _, _ in added)])

    return base.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with `ids`, the end id last."""
    return _mapped(docs, text, [("ids", ArrayType(IntegerType()), pa.list_(pa.int32()))], lambda t: (coder(model).encode(t.decode("utf-8", "replace")),))


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """encoded with `decoded`; NULL ids decode to the empty text."""
    return _mapped(encoded, ids, [("decoded", "string", pa.string())], lambda x: (coder(model).decode([i for i in x or [] if i is not None]),))


def round_trip(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with `ids` and `decoded`, both made by one worker."""

    def both(t: bytes) -> tuple[list[int], str]:
        own = coder(model, SMALL_CACHE)
        ids = own.encode(t.decode("utf-8", "replace"))
        return ids, own.decode(ids)

    return _mapped(docs, text, [("ids", ArrayType(IntegerType()), pa.list_(pa.int32())), ("decoded", "string", pa.string())], both)


def digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, without keeping the ids."""
    added = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _mapped(docs, text, added, lambda t: coder(model).digest(t.decode("utf-8", "replace")))
