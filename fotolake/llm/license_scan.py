"""License notices by an exact set-similarity join with templates.

Base: phrases whose words stand consecutively. Method: blocks of text that contain at least `least` of a template's set
of words. Templates are the usual short notices and the paragraphs of license texts, one word sequence each. A block is a
run of words of the whole text (line breaks do not matter), as long as the template and a quarter more.

The join is the prefix-filter join. Template words are ordered by how often they stand in all texts, rare ones first.
To share `k = ceil(least * n)` of a template's n words a block must have one of its first `n - k + 1` in that order.

1. Prefix: places of a text where a template's prefix word stands give pairs of place and template.
2. Length and position: it is enough to look at each block from its rarest shared word, so with the word at place i of
   the template's order, k - 1 of the later ones must stand around it, as far as blocks reach.
3. Verification: of the blocks over the place, the first and the last with the most words are cut until no word at their
   ends could go.

What a block is, is decided from all templates it meets. A template's `must` is what parts it from its neighbours (a
version, "affero", "by sa"), `never` what makes another license of it; both are patterns over the block's words. Of blocks
of one label that share a word of the text, the one with the most template words (then the shortest, then the first)
counts; of those, over blocks of other labels, the one with the most (then the larger share, then the first label).

Templates are a fixed small list (at most `MAX_TEMPLATES`), so that side is broadcast. Blocks that may share a word are
compared in cells of a text as long as the longest block, so a text with very many notices costs no squares.

NULL and empty texts have no words and no labels. Repeated rows are judged each for itself, by a row number given when
the counts are written. Ties in frequency go by the word. Columns named like a result are replaced, others pass
through.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import ascii_lower, written

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
#: What a block may have more than its template, as a share of its words.
SLACK = 0.25
MAX_TEMPLATES = 1000


class Template(NamedTuple):
    label: str
    text: str
    must: str
    never: str = "^$"


_OTHER_GNU = " (lesser|library|affero) "
_OTHER_CC = " (noncommercial|non commercial|sharealike|share alike|noderivatives|noderivs|no derivatives) "

# Phrases with their labels, and the usual notices and paragraphs of well-known licenses.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    Template("agpl-3", "licensed under the gnu affero general public license version 3", " affero general public license( [a-z]+){0,12} (version 3|v3|3 0) "),
    Template("agpl-3", "licensed under the gnu affero general public license v3 0", " affero general public license( [a-z]+){0,12} v3 "),
    Template("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", " affero general public license( [a-z]+){0,12} version 3 "),
    Template("apache-2", "licensed under the apache license version 2 0", " apache license (version |v )?2 "),
    Template("apache-2", "licensed under the apache 2 0 license", " apache 2 0 license "),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", " apache license (version |v )?2 "),
    Template("boost", "distributed under the boost software license version 1 0", " boost software license "),
    Template("bsd", "released under the bsd license", " bsd (license|licence) | bsd (2|3) clause "),
    Template("bsd", "licensed under the bsd 3 clause license", " bsd 3 clause (license|licence) | 3 clause bsd (license|licence) "),
    Template("bsd", "licensed under the bsd 2 clause license", " bsd 2 clause (license|licence) | 2 clause bsd (license|licence) "),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", " source and binary forms "),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", " endorse or promote products derived "),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", " creative commons attribution ([1-4]|international|unported|license) ", _OTHER_CC),
    Template("cc-by", "licensed under cc by 4 0", " cc by [1-4] "),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", " attribution (noncommercial|non commercial) ", " (sharealike|share alike|noderivatives|noderivs|no derivatives) "),
    Template("cc-by-nc", "licensed under cc by nc 4 0", " cc by nc [1-4] "),
    Template("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", " attribution (noncommercial|non commercial) (noderivatives|noderivs|no derivatives) "),
    Template("cc-by-nc-nd", "licensed under cc by nc nd 4 0", " cc by nc nd "),
    Template("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", " attribution (noncommercial|non commercial) (sharealike|share alike) "),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", " cc by nc sa "),
    Template("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", " attribution (noderivatives|noderivs|no derivatives) "),
    Template("cc-by-nd", "licensed under cc by nd 4 0", " cc by nd "),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", " attribution (sharealike|share alike) "),
    Template("cc-by-sa", "licensed under cc by sa 4 0", " cc by sa "),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", " cc0 "),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", " waived all copyright and related "),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", " eclipse public license (v |version |v)?2 "),
    Template("gpl-2", "licensed under the gnu general public license version 2", " general public license( [a-z]+){0,12} (version 2|v2|2 0) ", _OTHER_GNU),
    Template("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", " general public license( [a-z]+){0,12} version 2 ", _OTHER_GNU),
    Template("gpl-3", "licensed under the gnu general public license version 3", " general public license( [a-z]+){0,12} (version 3|v3|3 0) ", _OTHER_GNU),
    Template("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", " general public license( [a-z]+){0,12} version 3 ", _OTHER_GNU),
    Template("gpl-2", "licensed under the gnu general public license v2 0", " general public license( [a-z]+){0,12} v2 ", _OTHER_GNU),
    Template("gpl-3", "licensed under the gnu general public license v3 0", " general public license( [a-z]+){0,12} v3 ", _OTHER_GNU),
    Template("gpl-2", "licensed under the gnu gplv2", " gplv2 "),
    Template("gpl-3", "licensed under the gnu gplv3", " gplv3 "),
    Template("gpl-3", "licensed under the gnu gpl v3", " gpl v ?3 | gplv3 "),
    Template("gpl-2", "licensed under the gnu gpl v2", " gpl v ?2 | gplv2 "),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", " any purpose with or without fee "),
    Template("isc", "licensed under the isc license", " isc (license|licence) "),
    Template("lgpl", "licensed under the gnu lesser general public license version", " (lesser|library) general public license "),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version of the license or at your option any later version", " (lesser|library) general public license( [a-z]+){0,12} version "),
    Template("mit", "released under the mit license", " mit (license|licence) "),
    Template("mit", "licensed under the terms of the mit license", " mit (license|licence) "),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", " free of charge to any person obtaining a copy "),
    Template("mit", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", " copy modify merge publish distribute sublicense "),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", " mozilla public license (v |version |v)?2 "),
    Template("mpl-2", "licensed under the mozilla public license version 2 0", " mozilla public license (v |version |v)?2 "),
    Template("unlicense", "this is free and unencumbered software released into the public domain", " unencumbered software "),
    Template("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", " will the authors be held liable for any damages arising "),
]


def license_words(text: Column) -> Column:
    """Words of a text that is lower case already."""
    return F.filter(F.split(text, f"{SEPARATORS}+"), lambda w: w != "")


def _lowered(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    # `lower` is the same for ASCII texts, and much faster
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))


def _places(words: str, phrase: str) -> Column:
    """Where a phrase's words start in the array column."""
    parts = phrase.split(" ")
    hit = lambda i: reduce(and_, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))), lambda i: F.coalesce(hit(i), F.lit(False)))
    # the joined words tell cheaply that there is none
    return F.when(F.col("__joined").contains(f" {phrase} "), at).otherwise(F.array().cast("array<int>"))


def frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How often each word of the vocabulary stands in all texts: one number for each of its words."""
    found = docs.select(F.filter(F.split(_lowered(F.col(text)), f"{SEPARATORS}+"), lambda w: w.isin(vocabulary)).alias("w"))
    return {r["w"]: r["n"] for r in found.select(F.explode_outer("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect() if r["w"] is not None}


def block_words(template: Template) -> int:
    """Words of a template's block."""
    n = len(template.text.split(" "))
    return n + int(SLACK * n)


def _template_table(docs: DataFrame, templates: list[Template], order: dict[str, int], least: float) -> DataFrame:
    """A row for each prefix word of each template: its words in order, and the place of this one."""
    rows = []
    for t, template in enumerate(templates):
        own = sorted(set(template.text.split(" ")), key=lambda w: order[w])
        k = math.ceil(least * len(own) - 1e-9)
        rows += [(w, t, template.label, i, len(own), k, block_words(template), own, template.must, template.never) for i, w in enumerate(own[: len(own) - k + 1])]
    return docs.sparkSession.createDataFrame(rows, "word string, template int, label string, i int, n int, k int, width int, own array<string>, must string, never string")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row; as a plain column it would be copied into all that use it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def blocks(near: DataFrame, prefixes: DataFrame) -> DataFrame:
    """row, template, label, start, end, shared, n, must, never and block of near(row, at, off, near), where near holds the words of a text from `off`
    on, as far around the place `at` as blocks reach: of each place and template the best blocks, if they meet the threshold."""
    met = near.withColumn("word", F.get("near", F.col("at") - F.col("off"))).join(F.broadcast(prefixes), "word")
    held = lambda words: F.size(F.array_intersect(words, F.col("own")))
    met = met.withColumn("low", F.greatest(F.col("at") - F.col("width") + 1, F.col("off")))
    met = _once(met, "around", F.slice("near", F.col("low") - F.col("off") + 1, F.col("at") - F.col("low") + F.col("width"))).drop("near")
    met = met.filter(1 + F.size(F.array_intersect("around", F.slice("own", F.col("i") + 2, F.col("n")))) >= F.col("k"))
    met = _once(met, "counts", F.transform(F.sequence(F.lit(0), F.col("at") - F.col("low")), lambda s: held(F.slice("around", s + 1, F.col("width")))))
    met = _once(met, "shared", F.array_max("counts")).filter("shared >= k")
    first = F.array_position("counts", F.col("shared")).cast("int") - 1
    last = F.size("counts") - F.array_position(F.reverse("counts"), F.col("shared")).cast("int")
    met = met.select("*", F.explode_outer(F.array_distinct(F.array(first, last))).alias("from")).drop("counts")
    # the shortest beginning with all shared words, less the words in front that can go
    ends = F.transform(F.sequence(F.lit(1), F.col("width")), lambda e: held(F.slice("around", F.col("from") + 1, e)))
    met = _once(met, "size", F.array_position(ends, F.col("shared")).cast("int"))
    fronts = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda s: held(F.slice("around", F.col("from") + s + 1, F.col("size") - s)))
    met = _once(met, "cut", F.array_position(F.reverse(fronts), F.col("shared")).cast("int"))
    front = F.col("from") + F.col("size") - F.col("cut")
    block = F.concat(F.lit(" "), F.array_join(F.slice("around", front + 1, F.col("cut")), " "), F.lit(" "))
    start = F.col("low") + front
    return met.select("row", "template", "label", start.alias("start"), (start + F.col("cut")).alias("end"), "shared", "n", "must", "never", block.alias("block")).distinct()


def _unbeaten(hits: DataFrame, cell: int, same: bool) -> DataFrame:
    """The hits that no better one of the same label, or of other labels, shares a word of the text with."""
    cells = hits.withColumn("cell", F.explode(F.sequence(F.expr(f"start div {cell}"), F.expr(f"(end - 1) div {cell}"))))
    met = cells.groupBy("row", "cell").agg(F.collect_list(F.struct("start", "end", "label", "shared", "share")).alias("met"))

    def before(x: Column, y: Column, *signs: tuple[str, int]) -> Column:
        """Whether x comes before y by fields in turn, each from its least (1) or its most (-1)."""
        name, sign = signs[0]
        first = (x[name] - y[name]) * sign < 0 if name != "label" else x[name] < y[name]
        return first if len(signs) == 1 else first | ((x[name] == y[name]) & before(x, y, *signs[1:]))

    def better(x: Column, y: Column) -> Column:
        over = (x["start"] < y["end"]) & (y["start"] < x["end"])
        if same:
            shorter = (x["end"] - x["start"]) - (y["end"] - y["start"])
            tied = (shorter < 0) | ((shorter == 0) & (x["start"] < y["start"]))
            return over & (x["label"] == y["label"]) & ((x["shared"] > y["shared"]) | ((x["shared"] == y["shared"]) & tied))
        return over & (x["label"] != y["label"]) & before(x, y, ("shared", -1), ("share", -1), ("label", 1))

    lost = F.filter("met", lambda y: F.exists("met", lambda x: better(x, y)))
    losers = met.select("row", F.explode(lost).alias("hit")).select("row", "hit.start", "hit.end", "hit.label").distinct()
    return hits.join(losers, ["row", "start", "end", "label"], "left_anti")


def _winners(hits: DataFrame, cell: int) -> DataFrame:
    """Of each label the best blocks, and of those the ones that no better block of another label shares a word with."""
    most = F.max(F.struct("shared", (F.col("shared") / F.col("n")).alias("share"))).alias("most")
    one = hits.groupBy("row", "start", "end", "label").agg(most).select("row", "start", "end", "label", "most.shared", "most.share")
    return _unbeaten(_unbeaten(one, cell, True), cell, False)


def scan(docs: DataFrame, text: str = "text", *, phrases: dict[str, str] = PHRASES, templates: list[Template] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word, base_labels, labels and score.

    score: the largest share of a template's words in a block that counts, 1 where a phrase stands, 0 without labels."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    results = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    base = docs.select(*(c for c in docs.columns if c == text or c not in results))
    rest = [c for c in base.columns if c != text]
    table, prefixes, reach = _marked(base, text, rest, phrases, templates, least)
    hits = blocks(_around(table, reach), prefixes).filter(F.rlike("block", "must") & ~F.rlike("block", "never"))
    found = _winners(hits, reach).groupBy(F.col("row").alias("__row")).agg(F.collect_set("label").alias("__more"), F.max("share").alias("__share"))
    out = table.drop("__words", "__places").join(found, "__row", "left")
    empty = F.array().cast("array<string>")
    return out.select(
        *(F.col(f"`{c}`") for c in rest), "n_words", "n_base", "first_word", "last_word",
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", F.coalesce("__more", empty))), ",").alias("labels"),
        F.when(F.size("__base") > 0, F.lit(1.0)).otherwise(F.coalesce("__share", F.lit(0.0))).alias("score"),
    )


def _marked(base: DataFrame, text: str, rest: list[str], phrases: dict[str, str], templates: list[Template], least: float) -> tuple[DataFrame, DataFrame, int]:
    """The written base results with `__row`, and words and prefix words' places where there are any; the templates' prefix words; the longest block."""
    vocabulary = sorted({w for t in templates for w in t.text.split(" ")})
    count = frequencies(base, vocabulary, text)
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    prefixes = _template_table(base, templates, order, least)
    first = sorted({r["word"] for r in prefixes.select("word").collect()})
    reach = max(block_words(t) for t in templates)

    df = base.withColumn("__text", _lowered(F.col(text))).drop(text)
    df = df.withColumn("__words", license_words(F.col("__text")))
    df = df.withColumn("__joined", F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" ")))
    for i, phrase in enumerate(phrases):
        df = df.withColumn(f"__at{i}", _places("__words", phrase))
    at = F.concat(*(F.col(f"__at{i}") for i in range(len(phrases))))
    hit = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(f"__at{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))), lambda x: x.isNotNull())))
    places = F.filter(F.transform("__words", lambda w, i: F.when(w.isin(first), i)), lambda i: i.isNotNull())
    # the row number is fixed by being written
    table = written(df.withColumn("__at", at).withColumn("__places", places).select(
        *(F.col(f"`{c}`") for c in rest),
        F.monotonically_increasing_id().alias("__row"),
        F.size("__words").cast("long").alias("n_words"),
        F.size("__at").cast("long").alias("n_base"),
        F.array_min("__at").cast("long").alias("first_word"),
        F.array_max("__at").cast("long").alias("last_word"),
        hit.alias("__base"),
        F.when(F.size("__places") > 0, F.col("__places")).alias("__places"),
        F.when(F.size("__places") > 0, F.col("__words")).alias("__words"),
    ))
    return table, prefixes, reach


def _around(table: DataFrame, reach: int) -> DataFrame:
    """row, at, off and near: the words around each prefix word, as far as a block reaches."""
    each = table.filter(F.col("__places").isNotNull()).select(F.col("__row").alias("row"), "__words", F.explode_outer("__places").alias("at"))
    each = each.withColumn("off", F.greatest(F.col("at") - reach + 1, F.lit(0)))
    return each.select("row", "at", "off", F.slice("__words", F.col("off") + 1, F.col("at") - F.col("off") + reach).alias("near"))
