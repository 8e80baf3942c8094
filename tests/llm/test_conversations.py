"""Conversation repair against a plain search over all cheapest edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fotolake.llm import conversation_repair as cr

FIELDS = "conv_id long, turn long, role string, text string"


def plain_edits(kinds: str) -> tuple[int, str]:
    """All states forward, row by row, keeping the least (cost, letters)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    now = {"": (0, "")}

    def better(table, q, cost, letters):
        if q not in table or (cost, letters) < table[q]:
            table[q] = cost, letters

    def inserted(table):
        for _ in range(3):
            for q, (cost, letters) in list(table.items()):
                for r in "ua":
                    if (q, r) in step:
                        better(table, step[q, r], cost + 3, letters + "I")
        return table

    for k in kinds:
        # letters of different length never tie in cost and state with one beginning the other, so this order is safe
        then: dict = {}
        for q, (cost, letters) in inserted(now).items():
            better(then, q, cost + 4, letters + "D")
            if k != "x":
                more = 3 if k.isupper() else 0
                if (q, k.lower()) in step:
                    better(then, step[q, k.lower()], cost + more, letters + "K")
                for r in "ua":
                    if (q, r) in step:
                        better(then, step[q, r], cost + 3 + more, letters + "R")
        now = then
    return min(v for q, v in inserted(now).items() if q in ("", "a"))


def plain(rows: list[tuple]) -> dict:
    """The contract, row by row, of rows(conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        damaged = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if d == 0:
                continue
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            damaged += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, counts, seen = "", {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for _, role, text in damaged:
            k = role[0] if role[:1] in ("s", "u", "a") else "o"
            full = re.findall(r"[^\x20\x09-\x0D]", text)
            if not full:
                counts["blank"] += 1
                k = "x"
            elif (role, text) in seen:
                counts["duplicate"] += 1
                k = "x"
            elif full[-1] not in ".!?":
                counts["truncated"] += 1
                k = k.upper()
            seen.add((role, text))
            kinds += k
        cost, audit = plain_edits(kinds)
        lines, rest, state = [], list(damaged), ""
        for e in audit:
            row = None if e == "I" else rest.pop(0)
            if e == "D":
                continue
            role = row[1] if e == "K" else {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            state = role[0]
            lines.append(f"{role}:{row[2] if row else ''}")
        turns = {t for t, _, _ in damaged if t is not None}
        firsts = [r[1][:1] for r in damaged]
        out[conv] = counts | {
            "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return out


def as_dict(df) -> dict:
    rows = [r.asDict() for r in df.collect()]
    found = {r.pop("conv_id"): r for r in rows}
    assert len(found) == len(rows)
    return found


def sample_rows(seed: int, conversations: int, most: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", "  \t", "Fine!", "a b", None, "Ends. ", "É."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "usher", "", None]
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, most)):
            rows.append((c if c else None, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), f"{rng.choice(texts) or ''}" if rng.random() < 0.2 else f"{rng.random():.3f}{rng.choice(['.', '', '?'])}" if rng.random() < 0.8 else None))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_edits(seed):
    rng = random.Random(seed)
    for n in [*range(9), 20, 64, 65, 130]:
        for _ in range(20 if n < 30 else 3):
            kinds = "".join(rng.choice("suaSUAoOx" if rng.random() < 0.5 else "ua") for _ in range(n))
            assert cr.edits(kinds) == plain_edits(kinds), kinds


def test_blocks_of_blocks(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(cr, "BLOCK", 3)
    for f in (cr.edits, cr._block, cr._of_rows):
        f.cache_clear()
    for n in (1, 3, 4, 9, 10, 27, 28, 100):
        kinds = "".join(rng.choice("suaSUAoOx") for _ in range(n))
        assert cr.edits(kinds) == plain_edits(kinds), kinds
    for f in (cr.edits, cr._block, cr._of_rows):
        f.cache_clear()


def test_prices_stay_below_arcs():
    arcs, floor = cr._of_rows("suxaUoas", True)
    price = list(floor)
    cr.auction(arcs, 0, len(arcs) - 1, price)
    assert all(price[i] <= cost + price[j] for i, own in enumerate(arcs) for _, cost, j in own)


def test_against_plain(spark):
    rows = sample_rows(1, 60, 12)
    found = as_dict(cr.digest(cr.damage(spark.createDataFrame(rows, FIELDS))))
    assert found == plain(rows)


def test_long_conversations_in_slices(spark, monkeypatch):
    monkeypatch.setattr(cr, "SLICE", 5)
    rows = sample_rows(2, 12, 60)
    found = as_dict(cr.digest(cr.damage(spark.createDataFrame(rows, FIELDS)), long=6))
    assert found == plain(rows)
    parts = cr.repair(cr.damage(spark.createDataFrame(rows, FIELDS)), long=6)
    assert parts.filter("n_parts > 1").count() > 20
    audits = {r["conv_id"]: "".join(p["audit"] for p in sorted(r["p"], key=lambda p: p["part"])) for r in parts.groupBy("conv_id").agg(F.collect_list(F.struct("part", "audit")).alias("p")).collect()}
    assert audits == {c: r["audit"] for c, r in found.items()}


def test_repaired_turns_match_the_pattern(spark):
    rows = sample_rows(3, 40, 10)
    for r in cr.repair(cr.damage(spark.createDataFrame(rows, FIELDS))).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in r["turns"]))


def test_empty_and_clashing(spark):
    assert cr.digest(cr.damage(spark.createDataFrame([], FIELDS))).collect() == []
    rows = sample_rows(4, 10, 6)
    wide = spark.createDataFrame(rows, FIELDS).select("*", F.lit("x").alias("key"), F.lit(1).alias("part"), F.lit("y").alias("audit"), F.lit(2).alias("copy"))
    assert as_dict(cr.digest(cr.damage(wide))) == plain(rows)
    assert as_dict(cr.digest(cr.damage(spark.createDataFrame(rows + rows, FIELDS)))) == plain(rows + rows)


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000), (1, 2, "assistant", "x" * 1_000_000 + "."), (2, 0, "user", "Hi.")]
    for chars in (1 << 24, 1000):
        assert as_dict(cr.digest(cr.damage(spark.createDataFrame(rows, FIELDS)), chars=chars)) == plain(rows)


def test_all_rows_lost(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    found = as_dict(cr.digest(cr.damage(spark.createDataFrame([(5, gone, "user", "Hi.")], FIELDS))))
    assert found == {5: {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}}
