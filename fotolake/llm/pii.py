"""Personal data: four patterns that are always taken, and identifiers found by bootstrapping from them.

Base: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers, leftmost and not overlapping within a
kind. A base span is a seed instance of its kind.

Method: an identifier is a word with a digit or an @. Seeds and the other identifiers stand in contexts, and each
context gives lexical patterns: word before and shape, shape and word after, words before and after (a shape has 0 for
digits and a for letters, runs shortened). Patterns and the instances they extract are a graph whose edges are
distinct pairs, counted over all texts. `rounds` times, for each kind,

* a pattern's confidence is the mean of its instances' confidence, less `DAMPING` unknown instances' worth of doubt, so
  few instances give little confidence;
* an instance's confidence is that at least one of its patterns is right: 1 less the product of their doubts, with only
  patterns of at least `MIN_PATTERN` counted. Seeds keep 1 for their own kind and 0 for the others.

Instances that reach `least` are identifiers of that kind wherever they stand, unless they overlap a base span.
Confidences are aggregates over edges; one pattern with many instances is combined before it is shuffled.

Offsets are in code points, ends exclusive. They come from the lengths of matches and of the gaps between them, summed
by a window over the matches of one row. Spans are in order of start, then of kind.

NULL and empty texts have no spans. Repeated rows are judged each for itself, by a row number given when matches are
written; in the graph they count once. Instances with equal confidence for two kinds go to the first one listed.
Columns named like a result are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.llm.common import SPACE, written

KINDS = ["email", "ip", "card", "phone"]
# Possessive forms of the patterns, which match the same and never go back. A run that fails from its start fails from
# every later place too, so matches start where a run does or where the match before ended: long runs cost no squares.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SIGNS = {"email": "@", "ip": ".", "phone": "+"}
WORD = r"[^\x20\x09-\x0D]"
IDENTIFIER = rf"(?<!{WORD}){WORD}*[0-9@]{WORD}*"
#: Characters of a gap that a context is read from, at either end.
REACH = 48
DAMPING, MIN_PATTERN = 3.0, 0.5
RESULTS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def _matches(kind: str) -> Column:
    """For each match in the columns found and gaps: kind, number, length of the gap before it, the match, words before
    and after."""
    left = lambda i: F.regexp_extract(F.substring(F.get("gaps", i), -REACH, REACH), rf"({WORD}*){SPACE}*$", 1)
    right = lambda i: F.regexp_extract(F.substring(F.get("gaps", i + 1), 1, REACH), rf"^{SPACE}*({WORD}*)", 1)
    one = F.transform("found", lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("k"), F.char_length(F.get("gaps", i)).alias("gap"), m.alias("match"), left(i).alias("left"), right(i).alias("right")))
    return F.coalesce(one, F.array().cast("array<struct<kind:string,k:int,gap:int,match:string,left:string,right:string>>"))


def _found(df: DataFrame, text: str) -> DataFrame:
    """df with an array column of matches for each kind and for identifiers, without the text."""
    t = F.col(text)
    for kind, pattern in {**BASE, "id": IDENTIFIER}.items():
        # a text without a kind's sign is not searched
        sign = t.rlike("[0-9@]") if kind == "id" else t.contains(SIGNS[kind]) if kind in SIGNS else t.rlike("[0-9]")
        df = df.withColumn("found", F.when(sign, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
        df = df.withColumn("gaps", F.when(F.size("found") > 0, F.split(t, pattern, -1)))
        df = df.withColumn(f"m_{kind}", _matches(kind)).drop("found", "gaps")
    return df.drop(text)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, 1).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, value(i)).otherwise(F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2))
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: doubled(i)), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.split(match, r"\.")
    small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    ip = F.forall(parts, lambda p: small(p) & (F.when(small(p), p.cast("bigint")).otherwise(F.lit(256)) <= 255))
    card = F.length(digits).between(14, 19)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", ip)
        .when(kind == "card", F.when(card, _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(F.lit(True))
    )


def _rank(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(kind == k, F.lit(i)).otherwise(out)
    return out


def _shape(word: Column) -> Column:
    runs = F.regexp_replace(F.regexp_replace(word, "[0-9]", "0"), r"\p{L}", "a")
    return F.regexp_replace(F.regexp_replace(runs, "0{3,}", "0+"), "a{2,}", "a+")


def edges(places: DataFrame, row: str = "__row") -> DataFrame:
    """Distinct pairs of pattern and instance, with the kind that a seed has."""
    w = Window.partitionBy(row).orderBy("start", F.col("kind") == "id", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    # identifiers that a base span covers are that span
    marked = places.withColumn("covered", F.coalesce(F.max(F.when(F.col("kind") != "id", F.col("end"))).over(w), F.lit(0)) > F.col("start"))
    follows = Window.partitionBy(row).orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("reaches", F.coalesce(F.min(F.when(F.col("kind") != "id", F.col("start"))).over(follows), F.lit(1 << 62)) < F.col("end"))
    own = marked.filter("kind <> 'id' OR NOT (covered OR reaches)")
    plain = lambda c: F.lower(F.regexp_replace(c, r"[0-9]", "0"))
    left, right, shape = plain(F.col("left")), plain(F.col("right")), _shape(F.col("match"))
    patterns = F.array(
        F.when(left != "", F.concat_ws("\t", F.lit("L"), left, shape)),
        F.when(right != "", F.concat_ws("\t", F.lit("R"), shape, right)),
        F.when((left != "") & (right != ""), F.concat_ws("\t", F.lit("B"), left, right)),
    )
    seed = F.when(F.col("kind") != "id", F.col("kind"))
    pairs = own.select(F.explode_outer(F.filter(patterns, lambda p: p.isNotNull())).alias("pattern"), F.col("match").alias("instance"), seed.alias("seed")).filter("pattern IS NOT NULL")
    return pairs.groupBy("pattern", "instance").agg(F.min("seed").alias("seed"))


def bootstrap(pairs: DataFrame, rounds: int = 3, least: float = 0.8) -> DataFrame:
    """Discovered instances with kind and confidence. pairs: as `edges` gives them."""
    pairs = written(pairs)
    # patterns no seed shares get no confidence in the first round; later rounds may reach them
    seeds = pairs.groupBy("instance").agg(F.min("seed").alias("seed"))
    scores = [f"c_{k}" for k in KINDS]
    state = seeds.select("instance", "seed", *((F.col("seed") == k).cast("double").alias(f"c_{k}") for k in KINDS)).fillna(0.0, scores)
    state = written(state)
    for _ in range(rounds):
        held = pairs.select("pattern", "instance").join(state, "instance")
        confident = held.groupBy("pattern").agg(*(((F.sum(c)) / (F.count("*") + F.lit(DAMPING))).alias(c) for c in scores))
        good = confident.filter(F.greatest(*scores) >= MIN_PATTERN)
        doubt = lambda c: F.sum(F.log(F.greatest(1 - F.when(F.col(c) >= MIN_PATTERN, F.col(c)).otherwise(0.0), F.lit(1e-12))))
        reached = pairs.select("pattern", "instance").join(good, "pattern").groupBy("instance").agg(*((1 - F.exp(doubt(c))).alias(f"r{c}") for c in scores))
        new = [F.when(F.col("seed").isNotNull(), F.col(c)).otherwise(F.coalesce(f"r{c}", F.lit(0.0))).alias(c) for c in scores]
        state = written(state.join(reached, "instance", "left").select("instance", "seed", *new))
    best = F.greatest(*scores)
    kind = F.lit(None).cast("string")
    for k in reversed(KINDS):
        kind = F.when(F.col(f"c_{k}") == best, F.lit(k)).otherwise(kind)
    return state.filter(F.col("seed").isNull() & (best >= least)).select("instance", kind.alias("found_kind"), best.alias("confidence"))


def find(docs: DataFrame, text: str = "text", *, rounds: int = 3, least: float = 0.8) -> DataFrame:
    """docs without the text, with `all_spans` (array of kind, start, end, base), in order of start and kind."""
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    # matches with the row's other columns beside them; written once, so row numbers are fixed
    keep = [c for c in docs.columns if c != text and c not in ("all_spans", *RESULTS)]
    rest = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None)
    each = _found(numbered.select("__row", rest.alias("__rest"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")), "t")
    table = written(each)
    return _spans(table, keep, rounds, least)


def _spans(table: DataFrame, keep: list[str], rounds: int, least: float) -> DataFrame:
    matches = table.select("__row", F.explode_outer(F.concat(*(F.col(f"m_{k}") for k in [*KINDS, "id"]))).alias("m")).filter("m IS NOT NULL").select("__row", "m.*")
    w = Window.partitionBy("__row", "kind").orderBy("k")
    placed = matches.repartition("__row").withColumn("end", F.sum(F.col("gap") + F.char_length("match")).over(w).cast("long"))
    placed = placed.withColumn("start", F.col("end") - F.char_length("match")).withColumn("ok", _valid(F.col("kind"), F.col("match")))
    placed = written(placed.filter("ok").select("__row", "kind", "start", "end", "match", "left", "right"))
    found = written(bootstrap(edges(placed), rounds, least))
    base = placed.filter("kind <> 'id'").select("__row", "kind", "start", "end", F.lit(True).alias("base"))
    more = placed.filter("kind = 'id'").join(found, placed["match"] == found["instance"]).select("__row", F.col("found_kind").alias("kind"), "start", "end", F.lit(False).alias("base"))
    spans = base.unionByName(more).withColumn("rank", _rank(F.col("kind")))
    per_row = spans.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "base", "kind"))).alias("s"))
    # a discovered span gives way to a base span that it touches
    covers = lambda x: F.exists("s", lambda y: y["base"] & (y["start"] < x["end"]) & (x["start"] < y["end"]))
    per_row = per_row.withColumn("s", F.when(F.exists("s", lambda x: ~x["base"]), F.filter("s", lambda x: x["base"] | ~covers(x))).otherwise(F.col("s")))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,base:boolean,kind:string>>")
    out = table.select("__row", "__rest").join(per_row, "__row", "left")
    return out.select(*(F.col(f"__rest.`{c}`") for c in keep), F.coalesce("s", empty).alias("all_spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of base spans, and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("all_spans", lambda s: s["base"])
    of_kind = lambda kind: F.size(F.filter("all_spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    rest = [F.col(f"`{c}`") for c in found.columns if c != "all_spans"]
    return found.select(*rest, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets. Of spans that overlap, one that ends inside those before
    it is gone with them; one that goes on gives way too, its kind after theirs."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        more = s["end"] > state["at"]
        between = F.substr(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        piece = F.concat(state["out"], between, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.when(more, piece).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    whole = F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
