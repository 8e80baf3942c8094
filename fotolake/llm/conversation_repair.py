"""Repair of conversation structure by an auction algorithm for shortest paths.

A conversation is its rows in order of turn (NULL first, then role and text). A row is blank, a duplicate, truncated or
sound, and its role has an initial. Edits keep a row, give it another role, delete it or insert an empty turn; they must
leave roles whose initials match `(s?(ua)+)?`. The edits are paths through a lattice: a node for each place between rows
and each state of that pattern, an arc with a whole cost for each edit.

The auction keeps a price for each node, never above the cost of any arc plus the price at its end, and one path from the
start on which they are equal. At the path's end it goes on along the cheapest arc; if the node's price is below that,
the price rises to it and the path gives the node up. Prices begin at what each later row costs at least. When the path
has reached the goal, every arc of every cheapest path is tight (its price is its cost plus the price at its end), so the
least sequence of letters is read off the tight arcs that lead to the goal, letter by letter.

Rows are taken in blocks. A block's cheapest costs from each state to each state, and the order of their letters, make
one arc each of the lattice of blocks, which is solved likewise. No sequence of a block's letters begins another's (all
end with the edit of the block's last row), so choosing block by block is choosing letter by letter.

Conversations of up to LONG rows and CHARS characters are solved where their rows meet. Longer ones are numbered by a
distributed sort and cut into slices of SLICE rows that are summed up, solved over the sums and edited apart; only their
digest is one stream in one task, row by row, as a digest must be.

NULL roles and texts are one space. Rows with a NULL id are one conversation, NULL turns come first and count for no gap.
A row with an empty role has no initial: it can be given a role or deleted. Repeated rows are duplicates. Empty tables
give no rows; other columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import written
from fotolake.operators.ordering import global_position
from fotolake.operators.skew import salted_lookup

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Rows of a block; rows and characters of a conversation that is solved where its rows meet; rows of a slice.
BLOCK, LONG, CHARS, SLICE = 64, 4096, 1 << 24, 256
#: After a state (0 nothing, 1 system, 2 user, 3 assistant) and an initial.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What may be inserted or given after a state.
_ROLE = ("user", "user", "assistant", "user")
_TURN = tuple(_NEXT[q, _ROLE[q][0]] for q in range(4))
_FAR = 1 << 62
_FULL = re.compile(r"[^\x20\x09-\x0D]")
_SPACES = " \t\n\x0b\x0c\r"

#: Of each node, its arcs: label, cost, node at the end. And the prices to begin with.
Lattice = tuple[list[list[tuple[Any, int, int]]], list[int]]
#: From state to state: cost, and the place of its letters among those from the same state; None where no path is.
Matrix = list[list[tuple[int, int] | None]]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `lost` (the row is gone, its conversation's name stays) by the checksum of `conv_id:turn`."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(draw == 4, "user").otherwise(name("role"))
    times = F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (draw == 0).alias("lost"), F.explode(times).alias("copy"))
    return rows.drop("copy")


# The lattice and its prices


@lru_cache(maxsize=4096)
def _of_rows(kinds: str, last: bool) -> Lattice:
    """Nodes 4 * place + state. kinds: the initial of each row (o: none that counts), upper case if truncated, x if it must go.
    After the last row of a conversation turns may be inserted before the goal, the node after all others."""
    m = len(kinds)
    least = {"x": DELETE} | dict.fromkeys("suao", KEEP) | dict.fromkeys("SUAO", CUT)
    rest = [0] * (m + 1)
    for i in range(m - 1, -1, -1):
        rest[i] = rest[i + 1] + least[kinds[i]]
    arcs: list[list[tuple[str, int, int]]] = []
    for i in range(m + 1):
        for q in range(4):
            own: list[tuple[str, int, int]] = []
            if i < m:
                own.append(("D", DELETE, 4 * (i + 1) + q))
                if kinds[i] != "x":
                    more, kept = CUT if kinds[i].isupper() else 0, _NEXT.get((q, kinds[i].lower()))
                    if kept is not None:
                        own.append(("K", KEEP + more, 4 * (i + 1) + kept))
                    own.append(("R", REROLE + more, 4 * (i + 1) + _TURN[q]))
            elif last and q in (0, 3):
                own.append(("", 0, 4 * (m + 1)))
            if i < m or last:
                own.append(("I", INSERT, 4 * i + _TURN[q]))
            arcs.append(own)
    prices = [r for r in rest for _ in range(4)]
    if last:
        arcs.append([])
        prices.append(0)
    return arcs, prices


def _of_blocks(blocks: list[Matrix]) -> Lattice:
    """Nodes 4 * place between blocks + state; the last block of a conversation ends in state 0, its goal."""
    arcs: list[list[tuple[int, int, int]]] = []
    rest = [0]
    for m in reversed(blocks):
        rest.append(rest[-1] + min(c[0] for line in m for c in line if c))
    for k, m in enumerate(blocks):
        for q in range(4):
            arcs.append([(c[1], c[0], 4 * (k + 1) + p) for p, c in enumerate(m[q]) if c])
    arcs += [[], [], [], []]
    return arcs, [r for r in reversed(rest) for _ in range(4)]


def auction(arcs: list[list[tuple[Any, int, int]]], start: int, goal: int, price: list[int]) -> int:
    """The cost from start to goal, which must be within reach. Raises `price`, keeping it at most each arc's cost and the price at its end."""
    path = [start]
    while path[-1] != goal:
        at = path[-1]
        best, to = _FAR, -1
        for _, cost, node in arcs[at]:
            if cost + price[node] < best:
                best, to = cost + price[node], node
        if price[at] < best:
            price[at] = best
            if at != start:
                path.pop()
        else:
            path.append(to)
    return price[start] - price[goal]


def _reaching(arcs: list[list[tuple[Any, int, int]]], goal: int, price: list[int] | None = None) -> set[int]:
    """The nodes with a path to the goal; with prices, over tight arcs."""
    before: dict[int, list[int]] = {}
    for i, own in enumerate(arcs):
        for _, cost, node in own:
            if price is None or price[i] == cost + price[node]:
                before.setdefault(node, []).append(i)
    found, todo = {goal}, [goal]
    while todo:
        for i in before.get(todo.pop(), ()):
            if i not in found:
                found.add(i)
                todo.append(i)
    return found


def _least(arcs: list[list[tuple[Any, int, int]]], start: int, goal: int, price: list[int]) -> list[tuple[Any, int]]:
    """Labels and nodes of the tight path to the goal whose labels come first."""
    open_, at, out = _reaching(arcs, goal, price), start, []
    while at != goal:
        label, node = min((label, node) for label, cost, node in arcs[at] if price[at] == cost + price[node] and node in open_)
        out.append((label, node))
        at = node
    return out


def _solved(lattice: Lattice, start: int, goal: int) -> tuple[int, list[tuple[Any, int]]]:
    arcs, floor = lattice
    price = list(floor)
    return auction(arcs, start, goal, price), _least(arcs, start, goal, price)


def _matrix(lattice: Lattice, goals: list[int]) -> Matrix:
    """goals: the node that stands for each state at the end (one: state 0 alone)."""
    arcs, floor = lattice
    found: list[list[tuple[int, list] | None]] = [[None] * 4 for _ in range(4)]
    for p, goal in enumerate(goals):
        near, price = _reaching(arcs, goal), list(floor)
        for q in range(4):
            if q in near:
                cost = auction(arcs, q, goal, price)
                found[q][p] = cost, [label for label, _ in _least(arcs, q, goal, price)]
    out: Matrix = []
    for line in found:
        order = sorted(c[1] for c in line if c)
        out.append([c and (c[0], order.index(c[1])) for c in line])
    return out


@lru_cache(maxsize=1 << 16)
def _block(kinds: str, last: bool) -> Matrix:
    end = 4 * len(kinds)
    return _matrix(_of_rows(kinds, last), [end + 4] if last else [end, end + 1, end + 2, end + 3])


def states(blocks: list[Matrix], start: int, end: int) -> tuple[int, list[int]]:
    """The cost, and the state after each block on the least path from state to state."""
    if len(blocks) <= BLOCK:
        cost, path = _solved(_of_blocks(blocks), start, 4 * len(blocks) + end)
        return cost, [node % 4 for _, node in path]
    parts = [blocks[i : i + BLOCK] for i in range(0, len(blocks), BLOCK)]
    cost, over = states([joined(p) for p in parts], start, end)
    out: list[int] = []
    for part, q, p in zip(parts, [start, *over], over):
        out += states(part, q, p)[1]
    return cost, out


def joined(blocks: list[Matrix]) -> Matrix:
    """The matrix of blocks that follow each other."""
    while len(blocks) > BLOCK:
        blocks = [joined(blocks[i : i + BLOCK]) for i in range(0, len(blocks), BLOCK)]
    end = 4 * len(blocks)
    return _matrix(_of_blocks(blocks), [end, end + 1, end + 2, end + 3])


def _cut(kinds: str, last: bool) -> tuple[list[str], list[Matrix]]:
    parts = [kinds[i : i + BLOCK] for i in range(0, len(kinds), BLOCK)] or [""]
    return parts, [_block(p, last and i == len(parts) - 1) for i, p in enumerate(parts)]


@lru_cache(maxsize=1 << 16)
def edits(kinds: str, start: int = 0, end: int = 0, last: bool = True) -> tuple[int, str]:
    """The cost and the letters of the cheapest edits of rows, from state to state; the last rows of a conversation end it."""
    if len(kinds) <= BLOCK:
        goal = 4 * len(kinds) + (4 if last else end)
        cost, path = _solved(_of_rows(kinds, last), start, goal)
        return cost, "".join([label for label, _ in path])
    parts, blocks = _cut(kinds, last)
    cost, over = states(blocks, start, 0 if last else end)
    return cost, "".join([edits(part, q, p, last and i == len(parts) - 1)[1] for i, (part, q, p) in enumerate(zip(parts, [start, *over], over))])


# Rows


class Run:
    """What consecutive rows of a conversation come to."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.initials: list[str] = []
        self.turns: list[int | None] = []
        self.rows: list[tuple[str, str]] = []
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn: int | None, role: str, text: str, again: bool | None = None) -> None:
        if again is None:
            mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=20).digest()
            again = mark in self.seen
            self.seen.add(mark)
        initial = role[:1]
        kind = initial if initial and initial in "sua" else "o"
        if not _FULL.search(text):
            self.blank, kind = self.blank + 1, "x"
        elif again:
            self.duplicate, kind = self.duplicate + 1, "x"
        elif text.rstrip(_SPACES)[-1] not in ".!?":
            self.truncated, kind = self.truncated + 1, kind.upper()
        self.kinds.append(kind)
        self.initials.append(initial)
        self.turns.append(turn)
        self.rows.append((role, text))

    def illegal(self) -> int:
        return sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:]))

    def repaired(self, letters: str, state: int = 0) -> list[dict[str, str]]:
        out, rows = [], iter(self.rows)
        for e in letters:
            role, text = ("", "") if e == "I" else next(rows)
            if e == "D":
                continue
            role = role if e == "K" else _ROLE[state]
            state = _NEXT[state, role[0]]
            out.append({"role": role, "text": text})
        return out


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Each run of rows that agree in their first columns: those columns, and its rows, to be read before the next run."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda r: r[:keys])


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight=lambda row: 1, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held, heavy = [], 0
    for row in rows:
        held.append(row)
        heavy += weight(row)
        if heavy >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, heavy = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PARTS = pa.schema([("key", pa.string()), ("part", pa.int64()), ("n_parts", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("turns", _TURNS)])
PARTS = "key string, part long, n_parts long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role:string,text:string>>"


def _heavy(row: tuple) -> int:
    """Of a result's row, thousandths of a batch's size."""
    return 1 + sum(len(t["text"]) for t in row[-1]) // 1000


def _prepared(rows: DataFrame) -> DataFrame:
    """key (a text; conversations differ in it, NULL has its own), turn, role, text, lost."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    lost = F.coalesce(F.col("lost"), F.lit(False)) if "lost" in rows.columns else F.lit(False)
    text = lambda c: F.when(~lost, F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    return rows.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), lost.alias("lost"))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations whose rows may meet in a task: one part each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for (key,), own in _runs(batches, 1):
                r = Run()
                for _, turn, role, text, lost in own:
                    if not lost:
                        r.add(turn, role, text)
                cost, audit = edits("".join(r.kinds))
                yield key, 0, 1, _gaps(r.turns), r.blank, r.duplicate, r.truncated, r.illegal(), cost, audit, r.repaired(audit)

        return _batches(results(), _PARTS, _heavy)

    return rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").mapInArrow(run, PARTS)


_SUMS = pa.schema([("key", pa.string()), ("slice", pa.int64()), ("costs", pa.list_(pa.int64())), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("head", pa.string()), ("tail", pa.string()), *((c, pa.int64()) for c in ("low", "high", "n_turns", "first_turn", "last_turn"))])
SUMS = "key string, slice long, costs array<long>, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, n_turns long, first_turn long, last_turn long"


def _flat(m: Matrix) -> list[int]:
    """Costs and ranks line by line, -1 where no path is."""
    return [x for line in m for c in line for x in (c or (-1, -1))]


def _square(flat: list[int]) -> Matrix:
    cells = [None if c < 0 else (c, r) for c, r in zip(flat[::2], flat[1::2])]
    return [cells[i : i + 4] for i in range(0, 16, 4)]


def _long(rows: DataFrame) -> DataFrame:
    """Conversations of any length: a part for each slice, the first with the counts."""
    placed = global_position(rows.drop("lost"), F.col("key"), F.col("turn"), F.col("role"), F.col("text"), name="pos")
    starts = placed.groupBy("key").agg(F.min("pos").alias("start"), F.count("*").alias("n_rows"))
    placed = salted_lookup(placed, starts, ["key"], F.col("pos")).withColumn("idx", F.col("pos") - F.col("start"))
    firsts = placed.groupBy("key", "role", "text").agg(F.min("idx").alias("idx")).select("key", "idx", F.lit(False).alias("again"))
    marked = placed.join(firsts, ["key", "idx"], "left")
    whole = written(marked.select("key", F.expr(f"idx div {SLICE}").alias("slice"), "idx", F.expr(f"idx div {SLICE} = (n_rows - 1) div {SLICE}").alias("last"), "turn", "role", "text", F.coalesce("again", F.lit(True)).alias("again")))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for (key, part, last), own in _runs(batches, 3):
                r = Run()
                for _, _, _, _, turn, role, text, again in own:
                    r.add(turn, role, text, again)
                    r.rows.clear()
                blocks = _cut("".join(r.kinds), last)[1]
                known = [t for t in r.turns if t is not None]
                matrix = blocks[0] if len(blocks) == 1 else joined(blocks)
                yield key, part, _flat(matrix), r.blank, r.duplicate, r.truncated, r.illegal(), r.initials[0], r.initials[-1], min(known, default=None), max(known, default=None), len(set(known)), r.turns[0], r.turns[-1]

        return _batches(results(), _SUMS)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for (key,), own in _runs(batches, 1):
                sums = [dict(zip(_SUMS.names, s)) for s in own]
                cost, after = states([_square(s["costs"]) for s in sums], 0, 0)
                known = [s for s in sums if s["low"] is not None]
                turns = sum(s["n_turns"] for s in known) - sum(a["last_turn"] == b["first_turn"] and b["first_turn"] is not None for a, b in zip(sums, sums[1:]))
                gaps = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
                illegal = sum(s["illegal"] for s in sums) + sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(sums, sums[1:]))
                counts = (gaps, *(sum(s[c] for s in sums) for c in ("blank", "duplicate", "truncated")), illegal, cost)
                for s, q, p in zip(sums, [0, *after], after):
                    yield (key, s["slice"], len(sums), q, p, *(counts if s is sums[0] else [None] * 6))

        return _batches(results(), plan_schema)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for (key, part, last), own in _runs(batches, 3):
                r, plan = Run(), None
                for row in own:
                    r.add(*row[4:8])
                    plan = row[8:]
                audit = edits("".join(r.kinds), plan[1], plan[2], last)[1]
                yield key, part, plan[0], *plan[3:], audit, r.repaired(audit, plan[1])

        return _batches(results(), _PARTS, _heavy)

    plan_schema = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in ("slice", "n_parts", "q", "p", *_COUNTS))])
    by_slice = whole.repartition("key", "slice").sortWithinPartitions("key", "slice", "idx")
    sums = by_slice.select("key", "slice", "last", "idx", "turn", "role", "text", "again").mapInArrow(summed, SUMS)
    plan = written(sums.repartition("key").sortWithinPartitions("key", "slice").mapInArrow(chosen, "key string, slice long, n_parts long, q long, p long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"))
    planned = whole.join(plan, ["key", "slice"]).select("key", "slice", "last", "idx", "turn", "role", "text", "again", "n_parts", "q", "p", *_COUNTS)
    return planned.repartition("key", "slice").sortWithinPartitions("key", "slice", "idx").mapInArrow(edited, PARTS)


def _split(rows: DataFrame, long: int, chars: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The prepared rows' keys with ids, the rows of short conversations, and those of long ones, if there are any."""
    base = _prepared(rows)
    sizes = base.filter(~F.col("lost")).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))
    large = written(sizes.filter((F.col("n") > long) | (F.col("chars") > chars)).select("key"))
    if large.isEmpty():
        return base, base, None
    here = F.xxhash64("turn", "role", "text")
    marked = salted_lookup(base, large.withColumn("large", F.lit(True)), ["key"], here, "left")
    return base, marked.filter("large IS NULL").drop("large"), marked.filter("large AND NOT lost").drop("large")


def _named(df: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id of its own type for key."""
    conv_id = F.when(F.col("key") != "-", F.substr("key", F.lit(2))).cast(rows.schema["conv_id"].dataType)
    return df.select(conv_id.alias("conv_id"), *(c for c in df.columns if c != "key"))


def repair(rows: DataFrame, *, long: int = LONG, chars: int = CHARS) -> DataFrame:
    """conv_id, part, n_parts, counts (on part 0), audit and turns (role and text after the edits) of rows(conv_id, turn, role, text).

    A column `lost` marks rows that count for nothing but the name of their conversation. Long conversations have several
    parts, in order; `gaps` to `cost` are NULL on all but the first."""
    _, short, far = _split(rows, long, chars)
    out = _short(short)
    return _named(out if far is None else out.unionByName(_long(far)), rows)


def digest(rows: DataFrame, *, long: int = LONG, chars: int = CHARS) -> DataFrame:
    """One row for each conversation: counts, the whole audit and the digest of the repaired `role:text` lines."""
    _, short, far = _split(rows, long, chars)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    out = _short(short).select("key", *_COUNTS, "audit", F.sha2(F.concat_ws("\n", lines), 256).alias("repaired_sha256"))
    if far is None:
        return _named(out, rows)
    schema = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for (key,), own in _runs(batches, 1):
                counts, audit, sha, before = None, [], hashlib.sha256(), b""
                for row in own:
                    counts = row[3:9] if counts is None else counts
                    audit.append(row[9])
                    if row[10]:
                        sha.update(before + row[10].encode())
                        before = b"\n"
                yield key, *counts, "".join(audit), sha.hexdigest()

        return _batches(results(), schema)

    parts = _long(far).withColumn("turns", F.concat_ws("\n", lines))
    whole = parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(run, out.schema)
    return _named(out.unionByName(whole), rows)
