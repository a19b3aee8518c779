import re

from peltrane.llm import license_scan as s
from peltrane.llm.license_rules import rules


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    at, labels = [], []
    for phrase, label in s.BASE:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += found
        labels += [label] * bool(found)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(s.license_scan(docs).collect())]


def test_base_places(spark, awkward, small):
    texts = ["cc by cc by", "CC-BY/CC_BY", "by cc by", "all rights reserved. All Rights Reserved", "general public license", "ccby", "cc bye", "cc by\u00e9", None, "", "...", "cc  \n by", "a cc by"]
    for r, t in zip(scan(spark, texts), texts, strict=True):
        assert tuple(r)[1:6] == base(t)
    for docs in (awkward, small):
        want = [(r.doc_id, *base(r.text)) for r in docs.collect()]
        assert sorted((tuple(r)[:6] for r in s.license_scan(docs).collect()), key=repr) == sorted(want, key=repr)


def test_labels_priority_and_containment(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0 (the License)",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Creative Commons Attribution-ShareAlike 4.0 and CC BY-NC 3.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this",
        "released into the public domain",
        "he gave his permission and the mitten",
        "GNU Lesser General Public License version 2.1, and later the GNU General Public License",
    ]
    got = scan(spark, texts)
    assert got[0].labels == "apache-2.0" and got[0].score == 0.8
    assert got[1].labels == "gpl-2.0" and got[1].score == 1.0
    assert got[2].labels == "cc-by,cc-by-nc-3.0,cc-by-sa-4.0"
    assert got[3].labels == "mit" and got[4].labels == "public-domain" and got[5].labels == "" and got[5].score == 0.0
    assert got[6].labels == "gpl,lgpl-2.1" and got[6].base_labels == "gpl"


def test_detections_against_plain_suppression(spark):
    """Intervals found and left, against Python's engine and the definition."""
    texts = ["gnu gpl v2 gnu general public license version 3 0 cc by sa 4 0 creative commons attribution share alike 4 0 no rights reserved " * 3, "bsd 3 clause redistribution and use in source and binary forms bsd license mit license the mit license"]
    for r, text in zip(scan(spark, texts), texts, strict=True):
        norm = " " + " ".join(text.split()) + " "
        found = [(x.start(), -x.end(), t, label) for t, label, k, p in rules() if f" {k} " in norm for x in re.finditer(f" (?:{p})(?= )", norm)]
        left = []
        found.sort()
        for i, (a, z, t, label) in enumerate(found):
            if not any(y <= z and u <= t for b, y, u, _ in found[:i]):
                left.append(label)
        assert r.n_detections == len(left)
        assert set(r.labels.split(",")) - {""} == set(left) | set(r.base_labels.split(",")) - {""}


def test_there_are_hundreds_of_rules_and_all_compile(spark):
    table = rules()
    assert len(table) > 200 and len(set(table)) == len(table)
    for _, _, _, pattern in table:
        re.compile(pattern)


def test_empty(empty):
    assert s.license_scan(empty).count() == 0


def examples(pattern):
    """Texts of a pattern: each branch, each repetition at its least and at one or more."""

    def of(items):
        out = [""]
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                new = [chr(arg)]
            elif op == "BRANCH":
                new = [x for branch in arg[1] for x in of(branch)]
            elif op == "SUBPATTERN":
                new = of(arg[3])
            elif op == "MAX_REPEAT":
                new = [x * n for n in {arg[0], max(1, arg[0])} for x in of(arg[2])]
            elif op == "IN":
                new = ["x" if str(arg[0][0]) == "NEGATE" else chr(arg[0][1][0])]
            elif op == "NOT_LITERAL":
                new = ["x"]
            out = [a + b for a in out for b in new]
        return out

    return of(re._parser.parse(pattern))


def test_each_rule_matches_texts_made_for_it():
    gate = s.gate_pattern(s.gate_words(rules()))
    for _, label, keyword, pattern in rules():
        for text in examples(pattern):
            assert re.sub(s.NON_WORD, " ", text).strip() == text, (label, pattern)
            assert re.match(f" (?:{pattern})(?= )", f" {text} "), (label, text)
            assert f" {keyword} " in f" {text} " and re.search(gate, f" {text} "), (label, text)


def test_rules_behind_the_gate(spark):
    texts = ["may not be reproduced without prior written permission of X", "It may not be reproduced without written permission.", "licensed under these conditions", "copyright by X", "Copyright (c) Foo", "SPDX-License-Identifier: ODC-By-1.0", "SPDX-License-Identifier: MS-PL"]
    assert [r.labels for r in scan(spark, texts)] == ["no-derivatives", "no-derivatives", "licensed", "copyright", "copyright", "odc-by-1.0", "ms-pl"]
