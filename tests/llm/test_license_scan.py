import random

import numpy as np

from markcheck.llm import license_scan
from markcheck.llm.decontamination import words_of


def occurs(text, template, share=0.75):
    """Brute force: some stretch of the template's length holds that share of its shingles."""
    words, wanted = words_of(text.encode()), words_of(template.encode())
    grams = {tuple(wanted[i : i + 5]) for i in range(len(wanted) - 4)}
    n = len(wanted) + max(1, len(wanted) // 4)
    return any(len(grams & {tuple(words[i : i + 5]) for i in range(s, min(len(words), s + n) - 4)}) >= share * len(grams) for s in range(max(1, len(words))))


def test_every_occurrence_is_found():
    rng = random.Random(4)
    scan = license_scan.Templates(license_scan.TEMPLATES, 0.75, 0.9999)
    vocabulary = [f"w{k}" for k in range(300)]
    for trial in range(300):
        name, template = rng.choice(license_scan.TEMPLATES)
        words = template.split()
        if trial % 2:
            words = [w if rng.random() > 0.04 else "changed" for w in words]
        text = " ".join([*rng.choices(vocabulary, k=rng.randrange(90)), *words, *rng.choices(vocabulary, k=rng.randrange(90))])
        expected = {n for n, t in license_scan.TEMPLATES if occurs(text, t)}
        assert {hit[0] for hit in scan.find(text.encode())} == expected, text


def test_spans_and_repeats():
    scan = license_scan.Templates(license_scan.TEMPLATES, 0.75, 0.9999)
    text = "x y z Licensed under CC BY-NC 4.0. " + "filler " * 30 + "licensed UNDER cc by nc 4 0 end"
    assert scan.find(text.encode()) == [("CC-BY-NC-4.0", 3, 10, 1.0), ("CC-BY-NC-4.0", 40, 47, 1.0)]
    assert scan.find(b"") == scan.find(None) == scan.find(b"four words are few") == []


def test_band_settings_reach_the_asked_probability():
    scan = license_scan.Templates(license_scan.TEMPLATES, 0.75, 0.9999)
    for window, stride, seeds, index in scan.classes:
        assert len(seeds) % license_scan.ROWS == 0 and index and stride <= window
        assert len(np.unique(seeds)) == len(seeds)
        # a window around the shortest template of the class, of which the asked share is there
        template = min(len(scan.sets[i]) for found in index.values() for i in found)
        shingles = window - license_scan.WIDTH + 1
        alike = 0.75 * template / (shingles + 0.25 * template)
        assert 1 - (1 - alike**license_scan.ROWS) ** (len(seeds) // license_scan.ROWS) >= 0.9999


def test_the_query_finds_what_brute_force_finds(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        name, template = rng.choice(license_scan.TEMPLATES)
        texts.append(" ".join([*(f"w{rng.randrange(99)}" for _ in range(rng.randrange(300))), *template.split(), *(f"w{rng.randrange(99)}" for _ in range(rng.randrange(300)))]))
    texts += [" ".join(f"w{rng.randrange(99)}" for _ in range(500))]
    out = {}
    for r in license_scan.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        out.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(texts):
        expected = {n for n, t in license_scan.TEMPLATES if occurs(text, t)}
        found = {r.license for r in out.get(k, [])}
        assert found <= expected and bool(found) == bool(expected)
        words = license_scan.words_of(text.encode())
        for r in out.get(k, []):
            inside = {tuple(words[i : i + 5]) for i in range(r.start_word, r.end_word - 4)}
            shares = []
            for _, t in (x for x in license_scan.TEMPLATES if x[0] == r.license):
                wanted = license_scan.words_of(t.encode())
                grams = {tuple(wanted[i : i + 5]) for i in range(len(wanted) - 4)}
                shares.append(len(grams & inside) / len(grams))
            assert min(abs(x - r.containment) for x in shares) < 1e-9


def test_edge_rows(spark):
    schema = "doc_id long, text string, license string, containment string"
    assert license_scan.licenses(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (None, "Released under the MIT License.", "x", "y"), (3, "word " * 50000 + "Released under the MIT License.", "x", "y"), (4, "no", None, None)]
    out = license_scan.licenses(spark.createDataFrame(rows + rows[2:3], schema)).collect()
    assert sorted((r.doc_id or 0, r.license, r.start_word) for r in out) == [(0, "MIT", 0), (0, "MIT", 0), (3, "MIT", 50000)]


def test_versions_and_families_are_told_apart(spark):
    gpl = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    rows = [
        ("GPL-2.0", gpl.format(";", "", ";", 2)), ("GPL-3.0", gpl.format(":", "", ",", 3)), ("LGPL-2.1", gpl.format(";", "Lesser ", ";", 2.1)), ("LGPL-3.0", gpl.format(":", "Lesser ", ",", 3)), ("AGPL-3.0", gpl.format(":", "Affero ", ",", 3)),
        ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http"),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
        ("Unlicense", "This is free and unencumbered software released into the public domain."),
        *license_scan.TEMPLATES,
    ]
    docs = spark.createDataFrame([(k, f"see {t} and {'more ' * 400}{t}") for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {}
    for r in license_scan.licenses(docs).collect():
        found.setdefault(r.doc_id, []).append(r.license)
    assert [found[k] for k in range(len(rows))] == [[n, n] for n, _ in rows]
