"""Near copies of the pipeline against all pairs compared; one test must fail where fingerprints decide."""

import random

import pytest

import corpus_pipeline
from fotolake.llm import near_copies
from tests.conftest import SF


def _sets(rows):
    out = []
    for r in rows:
        w = (r.text or "").lower().split()
        out.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def _kept(rows):
    """Ids of the first row of each component, by comparing all pairs."""
    sets, parent = _sets(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] == sets[b] or shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(rows[i].doc_id for i in range(len(rows)) if root(i) == i)


@pytest.mark.parametrize(("hot", "bucket", "part"), [(64, 512, 1 << 20), (2, 3, 5), (4, 1, 1)])
def test_stage_is_brute_force(spark, monkeypatch, hot, bucket, part):
    for name, value in (("HOT", hot), ("BUCKET", bucket), ("PART", part)):
        monkeypatch.setattr(near_copies, name, value)
    rnd, words = random.Random(3), [f"w{i}" for i in range(400)]
    texts = []
    for n in (4, 5, 9, 30, 60, 200):
        base = [rnd.choice(words) for _ in range(n)]
        for changes in (0, 0, 1, 1, 2, 3, 5):  # changed words and cut ends on both sides of the threshold
            t = list(base)
            for _ in range(changes):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts += [" ".join(t), " ".join(t[rnd.randrange(3) :])]
    passage = [rnd.choice(words) for _ in range(20)]
    texts += [" ".join([*passage, *(rnd.choice(words) for _ in range(rnd.randrange(8)))]) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.orderBy("doc_id").collect()
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == _kept(rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()) == _kept(docs.orderBy("doc_id").collect())


def test_repeated_and_null_ids_are_judged_by_text(spark):
    one, two = "a b c d e f g h", "quite another text of eight or more words"
    docs = spark.createDataFrame([(1, one), (2, one), (2, two), (None, one), (None, "only here"), (None, "only here"), (3, None), (4, "")], "doc_id long, text string")
    got = near_copies.keep_one(docs).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("1", one), ("2", two), ("3", "None"), ("None", "only here")]


def test_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 5, 6, "x", 7), (2, long + " end", 5, 6, "y", 8), (3, "short", 1, 1, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row long, __digest long, __text string, n long")
    got = sorted(tuple(r) for r in near_copies.keep_one(docs).collect())
    assert got == [rows[0], rows[2]]


def test_bitmaps_bound_what_is_not_shared():
    rnd = random.Random(5)

    def bits(items, width):
        on = {i % width for i in items}
        return sum(1 << (width - 1 - i) for i in on).to_bytes(width // 8)

    for _ in range(200):
        a = {rnd.randrange(1 << 40) for _ in range(rnd.randrange(1, 200))}
        b = {x for x in a if rnd.random() < 0.9} | {rnd.randrange(1 << 40) for _ in range(rnd.randrange(30))}
        assert near_copies._bound(bits(a, rnd.choice([64, 128, 256])), bits(b, rnd.choice([64, 256]))) <= len(a ^ b)

def test_order_counts_every_text(spark):
    """Rare shingles come first, by the number of all texts that have them: what two texts in many share is counted too."""
    from fotolake.llm.decontamination import with_shingles

    common, rnd = "the same five words here", random.Random(9)
    texts = [" ".join([*(f"w{rnd.randrange(10**9)}" for _ in range(6)), *([common] if i % 2 else []), *(["a pair of texts only"] if i < 2 else [])]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "digest long, text string")
    sets = with_shingles(docs, "text", 5)
    order = near_copies._order(sets)
    rows = sets.orderBy("digest").collect()
    times = {}
    for r in rows:
        for h in r.hashes:
            times[h] = times.get(h, 0) + 1
    every = near_copies.np.array(sorted(times), near_copies.np.int64)
    assert order.of(every).tolist() == [times[h] for h in sorted(times)] and {1, 2, 20} <= set(times.values())
    n = {r.digest: len(r.hashes) for r in rows}
    got = {}
    for r in near_copies._prefixes(sets, order, 0.5).collect():
        got.setdefault(r.digest, []).append((r["at"] & 0xFFFFFFFF, r.hash))
    for r in rows:
        wanted = sorted(r.hashes, key=lambda h: (times[h], h))[: n[r.digest] - -(-n[r.digest] // 2) + 1]
        assert [h for _, h in sorted(got[r.digest])] == wanted


def test_group_costs_no_squares(spark, monkeypatch):
    """Copies that meet in shingles of a text that is no near copy of them: what is compared grows with their number."""
    compared, verified = [], near_copies._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", counted)
    monkeypatch.setattr(near_copies, "HOT", 16)
    monkeypatch.setattr(near_copies, "BUCKET", 100)
    rnd = random.Random(11)
    some = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    start, end, other_end = some(56), some(100), some(100)
    texts = []
    for i in range(124):  # the first four share the start alone, and are the smallest
        changed = list(start)
        changed[rnd.randrange(10, 50)] = f"x{i}"
        texts.append(" ".join(changed + (other_end if i < 4 else end)))
    texts += [" ".join(some(60) + other_end) for _ in range(150)]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, digest long, text string")
    got = {r.digest: r.label for r in near_copies.groups(rows).collect()}
    assert got == {i: 4 * (i > 3) for i in range(124)}
    assert sum(compared) < 8 * 124, compared
