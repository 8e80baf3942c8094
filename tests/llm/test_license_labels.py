"""Labelled notices, and the join against all windows of all templates."""

import math
import random
import re

import pytest

from fotolake.llm import license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"


def gnu(name, version):
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}
as published by the Free Software Foundation, either version {version} of the License, or
(at your option) any later version."""


LABELLED = [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"),
    ("Licensed under the GNU General Public License v3.0", "gpl-3"),
    ("Licensed under the GNU General Public License version 2.0 only", "gpl-2"),
    ("This library is licensed under the GNU Lesser General Public License, version 3.", "lgpl"),
    ("Licensed under the GNU Library General Public License version 2", "lgpl"),
    ("This program is licensed under the GNU Affero General Public License, version 3.", "agpl-3"),
    ("Licensed under the GNU GPL v3", "gpl-3"),
    ("Licensed under the GNU GPLv2", "gpl-2"),
    (gnu("General Public License", 3), "gpl-3"),
    (gnu("General Public License", 2), "gpl-2"),
    (gnu("Lesser General Public License", "2.1"), "lgpl"),
    (gnu("Affero General Public License", 3), "agpl-3"),
    (MIT, "mit"),
    ("Released under the MIT License.", "mit"),
    ("Released under an MIT\nLicense", "mit"),
    ("This project is licensed under the terms of the MIT license", "mit"),
    (BSD, "bsd"),
    ("Released under the BSD license", "bsd"),
    ("Licensed under the BSD 3-Clause License", "bsd"),
    ("Licensed under the BSD-2-Clause license", "bsd"),
    (ISC, "isc"),
    ("Licensed under the ISC license", "isc"),
    (APACHE, "apache-2"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("Licensed under the Apache-2.0 license", "apache-2"),
    (MPL, "mpl-2"),
    ("Licensed under the Mozilla Public License, version 2.0", "mpl-2"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY-ND 3.0", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
    ("Dedicated to the public domain under CC0 1.0 Universal", "cc0"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "cc0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Distributed under the Boost Software License, Version 1.0.", "boost"),
    ("made available under the terms of the Eclipse Public License 2.0", "epl-2"),
    ("In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
    # two notices, one after the other
    (APACHE + "\n\n" + MIT, "apache-2,mit"),
    (gnu("General Public License", 2) + "\n" + gnu("Lesser General Public License", 3), "gpl-2,lgpl"),
    # the base phrase counts whatever follows
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),
    # neighbours and prose
    ("The album was released in May. Later the band got a new driving license, under which they went to the coast.", ""),
    ("Er wurde mit dem Bus unter the license released under mit", ""),
    ("Wir fahren mit der Bahn. This work is licensed under the GNU General Public License, version 3. Sie kam mit ihm.", "gpl-3"),
    ("Licensed under the Apache License, Version 1.1", ""),
    ("Licensed under the Mozilla Public License, version 1.1", ""),
    ("The general public needs a license to fish in version 3 of the park.", ""),
    ("a creative work in the commons, with attribution to the international press", ""),
    ("use, copy and sell; merge, publish and distribute the newspaper", ""),
    ("the the the license", ""), ("no\nnotice", ""), ("", ""), (None, ""),
]


def _scan(spark, texts):
    return {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_labelled_notices(spark):
    got = _scan(spark, [t for t, _ in LABELLED])
    assert {i: got[i].labels for i in range(len(LABELLED))} == {i: label for i, (_, label) in enumerate(LABELLED)}


def test_notices_in_long_texts(spark):
    rnd = random.Random(5)
    prose = lambda n: "".join(rnd.choice(["one", "two", "of", "source", "line", "mit", "the"]) + rnd.choice([" ", " ", "\n"]) for _ in range(n))
    texts = [prose(n) + " " + notice.replace(" ", rnd.choice([" ", "\n", "  "])) + " " + prose(n) for n in (50, 63, 500) for notice, label in LABELLED if label]
    labels = [label for _ in range(3) for _, label in LABELLED if label]
    got = _scan(spark, texts)
    assert {i: got[i].labels for i in range(len(texts))} == dict(enumerate(labels))


def _most(words, template):
    """The most words of a template that one block has."""
    own, width = set(template.text.split()), license_scan.block_words(template)
    return max(len(own & set(words[s : s + width])) for s in range(max(1, len(words))))


@pytest.mark.parametrize("seed", range(2))
def test_join_is_all_windows(spark, seed):
    rnd = random.Random(seed)
    vocabulary = sorted({w for t in license_scan.TEMPLATES for w in t.text.split()})
    texts = []
    for t in license_scan.TEMPLATES:
        w = [x for x in t.text.split() if rnd.random() < 0.9]
        for _ in range(rnd.randrange(8)):
            w.insert(rnd.randrange(len(w)), rnd.choice(vocabulary))
        texts.append(" ".join([rnd.choice(vocabulary) for _ in range(rnd.randrange(60))] + w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table, prefixes, reach = license_scan._marked(docs, "text", ["doc_id"], license_scan.PHRASES, license_scan.TEMPLATES, 0.8)
    hits = license_scan.blocks(license_scan._around(table, reach), prefixes).join(table.selectExpr("__row AS row", "doc_id"), "row")
    got: dict = {}
    for r in hits.collect():
        words = texts[r.doc_id].split()
        own = set(license_scan.TEMPLATES[r.template].text.split())
        # the block is what it says, and none of its ends could go
        assert r.block.split() == words[r.start : r.end] and len(own & set(words[r.start : r.end])) == r.shared
        assert words[r.end - 1] in own and words[r.start] in own
        got[r.doc_id, r.template] = max(got.get((r.doc_id, r.template), 0), r.shared)
    want = {}
    for d, text in enumerate(texts):
        for t, template in enumerate(license_scan.TEMPLATES):
            most = _most(re.findall("[a-z0-9]+", text), template)
            if most >= math.ceil(0.8 * len(set(template.text.split())) - 1e-9):
                want[d, t] = most
    assert got == want and len(want) > 40


def test_of_overlapping_blocks_the_better_counts(spark):
    # of a, the second block is longer; it beats nothing
    rows = [(3, 0, 8, "a", 8, 8), (3, 4, 16, "a", 8, 8), (3, 10, 18, "b", 7, 7)]
    hits = spark.createDataFrame(rows, "row long, start int, end int, label string, shared int, n int")
    assert {(r.start, r.label) for r in license_scan._winners(hits, 20).collect()} == {(0, "a"), (10, "b")}
    rows = [(1, 0, 9, "a", 8, 10), (1, 5, 12, "b", 7, 7), (1, 11, 20, "c", 6, 6), (1, 30, 40, "d", 5, 5), (2, 0, 5, "e", 5, 5), (2, 2, 6, "f", 5, 6), (2, 4, 9, "a", 5, 5)]
    hits = spark.createDataFrame(rows, "row long, start int, end int, label string, shared int, n int")
    for cell in (3, 10, 100):
        got = {(r.row, r.label) for r in license_scan._winners(hits, cell).collect()}
        # c loses to b although b itself lost: a block counts if nothing better lies over it
        assert got == {(1, "a"), (1, "d"), (2, "a")}
