import random
import re
import time

from folioscope.llm import licenses
from tests.llm.fixtures import awkward, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_automaton_knows_all_ends():
    rng = random.Random(1)
    for _ in range(150):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        a = licenses.Automaton()
        for i, q in enumerate(seqs):
            a.add(q, i)
        a.finish()
        for sub in {tuple(q[i:j]) for q in seqs for i in range(len(q)) for j in range(i + 1, len(q) + 1)}:
            state = 0
            for c in sub:
                state = a.next[state][c]
            want = sorted((k, e) for k, q in enumerate(seqs) for e in range(len(sub), len(q) + 1) if tuple(q[e - len(sub) : e]) == sub)
            assert sorted(a.ends[state]) == want


def test_base_places_match_brute_force():
    rng = random.Random(2)
    scanner = licenses.Scanner()
    parts = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "x", "Licensed", "-", ".", "é", "cc by-nc", "under the MIT license"]
    for _ in range(500):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        words = plain_words(text)
        assert [w.decode() for w in licenses.words_of(text.encode())] == words
        want = sorted((i, k) for k, p in enumerate(licenses.PHRASES) for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert scanner.scan([w.encode() for w in words])[0] == want


def test_spans_of_edited_templates(spark):
    gpl = licenses.TEMPLATES["gpl-3"][0].split()
    edited = " ".join(gpl[:20] + ["indeed"] + gpl[20:34] + gpl[35:])
    rows = [(1, prose(1, 50) + " " + edited + " " + prose(2, 50)), (2, " ".join(gpl[:25])), (3, prose(3, 400)), (4, "x. Licensed under the Apache License, Version 2.0.\n" * 2), (5, licenses.TEMPLATES["bsd-3-clause"][0]), (6, licenses.TEMPLATES["bsd-2-clause"][0]), (7, licenses.TEMPLATES["bsd-2-clause"][1])]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == ["gpl-3"] and got[1]["base_labels"] == []
    span = got[1]["spans"][0]
    assert span["first_word"] == 50 and span["end_word"] == 50 + len(plain_words(edited)) and span["coverage"] > 0.9
    assert got[2]["labels"] == got[3]["labels"] == []
    assert got[4]["labels"] == ["apache-2"] and len(got[4]["base_places"]) == 2 and got[4]["base_places"] == [4, 13]
    assert got[5]["labels"] == ["bsd-3-clause"] and got[6]["labels"] == got[7]["labels"] == ["bsd-2-clause"]


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = licenses.scan_licenses(docs).collect()
    assert sorted(r["n_words"] for r in got) == sorted(len(plain_words(r["text"])) for r in docs.collect())
    assert all(r["labels"] == [] and r["spans"] == [] for r in got)
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_notices_of_kin_are_told_apart():
    scanner = licenses.Scanner()
    gnu = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    for text, label in (
        (gnu.format("library", "Lesser General Public", "3"), "lgpl-3"), (gnu.format("program", "Affero General Public", "3"), "agpl-3"), (gnu.format("program", "General Public", "3"), "gpl-3"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "gpl-2"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "cc-by"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        ("You may use it under the terms of the New BSD License.", "bsd-3-clause"),
    ):
        words = licenses.words_of(f"{prose(1, 30)} {text} {prose(2, 30)}".encode())
        assert {x[0] for x in scanner.scan(words)[1]} == {label}, text


def test_every_template_is_found_whole_and_by_its_label():
    scanner = licenses.Scanner()
    for label, texts in licenses.TEMPLATES.items():
        for text in texts:
            found = scanner.scan(licenses.words_of(text.encode()))[1]
            if len(text.split()) >= licenses.LEAST:
                assert label in {x[0] for x in found}, (label, text, found)


def test_repeated_notices_take_little_time():
    scanner = licenses.Scanner()
    for label in ("bsd-2-clause", "gpl-3", "mit"):
        text = licenses.TEMPLATES[label][0]
        copies = 20_000 // len(text.split()) + 1
        words = licenses.words_of(((text + " ") * copies).encode())
        began = time.perf_counter()
        spans = scanner.scan(words)[1]
        assert time.perf_counter() - began < 1, label
        assert [x[0] for x in spans] == [label] * copies and spans[-1][2] == len(words)


def test_matches_are_the_maximal_ones_of_each_template():
    """Every match of LEAST words or more that cannot be prolonged on either side, by comparing all places."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4)]
    for _ in range(60):
        own = {f"t{k}": [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 16)))] for k in range(3)}
        scanner = licenses.Scanner(own, {})
        texts = [t[0].split() for t in own.values()]
        file = [rng.choice([*words, "x"]) for _ in range(rng.randrange(40))] + texts[0] + texts[1][:7]
        got = {}
        scanner._spans = lambda seeds, got=got: got.update(seeds) or []
        scanner.scan([w.encode() for w in file])
        for k, t in enumerate(texts):
            want = set()
            for i in range(len(file)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(file) and j + n < len(t) and file[i + n] == t[j + n]:
                        n += 1
                    if n >= licenses.LEAST and not (i and j and file[i - 1] == t[j - 1]):
                        want.add((i, j, n))
            assert got.get(k, set()) == want
