"""Tokenizer alignment against the two libraries on whole texts and plain counting."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fotolake.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = "doc_id long, text string"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def cut_of(text: str | None, libraries) -> tuple[list[int], list[int], list[tuple]]:
    """Ids of both, and the groups, of a whole text."""
    a, b = libraries
    if not text:
        return [], [], []
    want = (" " + text).encode()
    letters = ta.byte_letters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(raw_a) != want or b"".join(raw_b) != want:
        return [], [], []
    ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append((ids_a[i:k], ids_b[j:m]))
        i, j = k, m
    return ids_a, ids_b, groups


def plain(rows, libraries) -> list[tuple]:
    cuts = [cut_of(t, libraries) for _, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, _, groups in cuts for g in groups)
    top: dict = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for (doc, _), (ids_a, ids_b, groups) in zip(rows, cuts):
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in ta.align(df, A, B).collect()), key=str)


ODD = [
    "", None, " ", "  a", "a ", "a  b", "one two\n three\n\n four", "tab\tand \t mix", "<|endoftext|> </s> <s> <0x41>", "▁ marks ▁", "naïve café – „Zitat“ 日本語 🙂🙂", "don't we'll I'M",
    "x" * 3000, "a b c d e　f", "\x1c \x1d a \x85 b", "é" * 50 + " " + "0123456789" * 20, "́ a ́b", "...  !!! ??", "a\r\n b\r\n", "The the THE the", "\x00 \x01",
]


def test_odd_texts(spark, libraries):
    rows = list(enumerate(ODD))
    assert found(spark.createDataFrame(rows, FIELDS)) == plain(rows, libraries)


def test_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = plain(rows, libraries)
    assert sum(r[3] for r in wanted) > 10_000
    assert found(docs.repartition(3)) == wanted


def test_small_chunks_and_parts(spark, libraries, monkeypatch):
    """Chunks that fill up, bitmaps of both kinds, merged parts."""
    rows = [(i, f"the word and the number {i % 7} " + "the " * (i % 12) + "end") for i in range(9000)]
    monkeypatch.setattr(ta, "PART_BYTES", 5000)
    df = spark.createDataFrame(rows, FIELDS).coalesce(1)
    index = ta.indexed(df, A, B)
    assert index.select("chunk").distinct().count() == 3
    assert found(df) == plain(rows, libraries)
    pairs = Counter((g[0][-1], g[1][-1]) for _, t in rows for g in cut_of(t, libraries)[2])
    docs = Counter(p for _, t in rows for p in {(g[0][-1], g[1][-1]) for g in cut_of(t, libraries)[2]})
    for r in ta.pair_counts(index).collect():
        assert (r["n_links"], r["n_docs"]) == (pairs[r["a"], r["b"]], docs[r["a"], r["b"]])


def test_repeated_rows_null_ids_and_clashes(spark, libraries):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b"), (None, None), (2, "c a")]
    df = spark.createDataFrame(rows, FIELDS)
    assert found(df) == plain(rows, libraries)
    assert found(df.select("*", F.lit(1).alias("chunk"), F.lit("x").alias("pair"), F.lit(2).alias("place"))) == plain(rows, libraries)
    assert ta.align(spark.createDataFrame([], FIELDS), A, B).collect() == []


def test_very_long_text(spark, libraries):
    rows = [(0, "many words and more of them. " * 60_000), (1, "many words")]
    ids_a, ids_b, _ = cut_of(rows[0][1][:2900], libraries)
    got = {r[0]: r for r in found(spark.createDataFrame(rows, FIELDS))}
    a, b = libraries
    assert got[0][1:3] == (len(a.encode(" " + rows[0][1]).ids), len(b.encode(rows[0][1])))
    assert ids_a and ids_b and got[1][3] > 0


@given(st.lists(st.integers(0, 4095), unique=True, max_size=600), st.lists(st.integers(0, 4095), unique=True, max_size=600))
@settings(max_examples=60, deadline=None)
def test_bitmaps(left, right):
    x, y = (ta.bitmap(np.array(sorted(v), np.int64)) for v in (left, right))
    assert ta.places(x).tolist() == sorted(left) and ta.popcount(x) == len(left)
    both = ta.either(x, y)
    assert ta.places(both).tolist() == sorted({*left, *right}) and ta.popcount(both) == len({*left, *right})
    assert len(both) <= 513


@given(st.text(st.sampled_from(list("ab .\n\t'é▁1 ́<|>")), max_size=40))
@settings(max_examples=400, deadline=None)
def test_pieces_give_the_whole_text(libraries, text):
    """Cutting at spaces changes neither tokenizer's result."""
    al = ta.aligner(A, B)
    rows, _, pairs = al.align([text])
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    letters = ta.byte_letters()
    right = b"".join(bytes(letters[c] for c in libraries[0].id_to_token(i)) for i in a) == b"".join(al.bytes_b[i] for i in b) == (" " + text).encode()
    if not text or not right:
        assert rows[0] == (0, 0, 0, "")
    else:
        links: list = []
        groups = al._groups(a, b, links)
        assert rows[0] == (len(a), len(b), len(links), hashlib.sha256(groups.encode()).hexdigest())
        assert pairs.tolist() == links
