"""Texts with several copies of a notice."""

import random

from lexvane.llm import licences


def test_all_copies_are_reported(spark):
    notice = "This work is licensed under the GNU General Public License, version 3."
    texts = [f"{notice} {notice}", f"a {notice} b c {notice.replace('work', 'book')} d {notice}", "All rights reserved. " * 4]
    got = [r["spans"] for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [tuple(s) for s in got[0]] == [("gpl-3", 0, 12, 1.0), ("gpl-3", 12, 24, 1.0)]
    assert [(s["start"], s["stop"], round(s["cover"] * 12)) for s in got[1]] == [(1, 13, 12), (17, 27, 10), (28, 40, 12)]
    assert [(s["start"], s["stop"]) for s in got[2]] == [(0, 3), (3, 6), (6, 9), (9, 12)]


def test_chains_of_copies_are_brute_force():
    scanner = licences.LicenceScanner(licences.PHRASES, licences.TEMPLATES)
    words = scanner.sequences[4]
    for cut in range(len(words)):
        text = words + [b"x"] + words[:cut] + [b"x"] + words[cut:] + words
        found = [s for s in scanner.spans(text) if s[0] == "gpl-3"]
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:], strict=False))
        assert ("gpl-3", 0, 12, 1.0) in found and ("gpl-3", len(text) - 12, len(text), 1.0) in found


def test_each_template_is_told_from_its_kin():
    """A template's own words, among others, give its label alone, as one span over all of them."""
    scanner = licences.LicenceScanner(licences.PHRASES, licences.TEMPLATES)
    for label, words in zip(scanner.labels, scanner.sequences, strict=True):
        assert scanner.spans([b"x", b"y"] + words + [b"z"]) == [(label, 2, 2 + len(words), 1.0)]


def test_versions_and_small_changes():
    scanner = licences.LicenceScanner(licences.PHRASES, licences.TEMPLATES)
    labels = lambda text: [s[0] for s in scanner.spans(licences.licence_words(text.encode()))]
    notice = "This file is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    assert [labels(notice.format(*x)) for x in (("General Public License", "2"), ("General Public License", "3"), ("Lesser General Public License", "2.1"), ("Affero General Public License", "3"))] == [["gpl-2"], ["gpl-3"], ["lgpl-2.1"], ["agpl-3"]]
    assert labels("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.") == ["cc-by-nc"]
    two = dict(zip(licences.TEMPLATES[22:24], range(2), strict=True))
    assert [label for label, _ in two] == ["bsd-2", "bsd-3"]
    for label, text in two:
        assert labels(text.replace("met: Redist", "met:\n 1. Redist").replace("disclaimer. Redist", "disclaimer.\n 2. Redist").replace("this list", "the list")) == [label]
    assert labels("free software is released, and all copies of the software are sold under terms of the license") == []


def test_spans_that_stay_by_brute_force():
    """The best span first, then the best of those clear of all before, and so on."""
    scanner, rng = licences.LicenceScanner(licences.PHRASES, licences.TEMPLATES), random.Random(7)
    for _ in range(60):
        words = []
        for _ in range(6):
            t = list(rng.choice(scanner.sequences))
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice([b"x", b"the", b"software"])
            words += t[rng.randrange(3) :] + [b"y"] * rng.randrange(3)
        anchors = {}
        for end, length, node in scanner.automaton.matches(words, licences.MIN_MATCH):
            for s, stop in scanner.automaton.places[node]:
                anchors.setdefault(s, []).append((end - length, stop - length, length))
        left = [(scanner.labels[s], *c, s) for s, found in anchors.items() for c in scanner._chains(s, sorted(found))]
        want = []
        while left:
            best = min(left, key=lambda c: (-round(c[3] * len(scanner.sequences[c[4]])), -c[3], c[1], c[4]))
            want.append(best[:4])
            left = [c for c in left if c[2] <= best[1] or c[1] >= best[2]]
        assert scanner.spans(words) == sorted(want, key=lambda c: c[1])
