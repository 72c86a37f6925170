import random
import re

import pytest
from pyspark.sql import functions as F

from deskflow.llm.license_rules import build_rules, written
from deskflow.llm.license_scan import BASE_PHRASES, _unsuppressed, base_places, detections, gated_rules, numbered_rules, scan


def words(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_places(text):
    w, out = words(text), []
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return sorted(out)


def found(text):
    w = [x.encode() for x in words(text)]
    return [(x["label"], x["start"], x["end"]) for x in detections(b" " + b" ".join(w) + b" ", set(w))]


def test_base_places_against_brute_force(spark, odd):
    rng = random.Random(1)
    parts = ["GNU", "general", "public", "License", "apache", "license", "CC", "by", "cc-by", "MIT-License", ",", "é", "mit", "\n", "x9"]
    texts = [None, "", *("".join(rng.choice([p, p + " ", p + "--"]) for p in rng.choices(parts, k=rng.randrange(40))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in scan(df).collect():
        assert r.n_words == len(words(texts[r.doc_id]))
        assert [(p.word, p.label) for p in r.base] == brute_places(texts[r.doc_id])


def test_rules_hold_their_gate_and_are_many():
    rules = build_rules()
    assert len(rules) >= 300 and len({r.name for r in rules}) == len(rules)


def test_longer_and_higher_detections_stay():
    assert found("Licensed under the Apache License, Version 2.0.") == [("apache", 0, 8)]
    assert found("GNU General Public License v3 or later") == [("gpl-3-or-later", 0, 7)]
    assert found("GNU Lesser General Public License, version 2.1") == [("lgpl-2.1", 0, 8)]
    assert found("SPDX-License-Identifier: MPL-2.0") == [("mpl-2.0", 0, 6)]
    assert found("under CC BY-SA 4.0 terms") == [("cc-by-sa-4.0", 1, 6)]
    assert found("see http://creativecommons.org/licenses/by/4.0/") == [("cc-by-4.0", 2, 8)]
    assert found("the MIT license and the ISC license") == [("mit", 0, 3), ("isc", 5, 7)]
    assert found("Permission is hereby granted, free of charge, to any person obtaining a copy") == [("mit", 0, 13)]


def test_nothing_without_the_gate_or_whole_words():
    assert found("a licensed plumber commits to public work by noon") == []
    assert base_places(b" summit license accc by ") == []


def test_gates_lose_no_match():
    rng, every = random.Random(7), set(gated_rules())
    for rule in build_rules():
        texts = written(rule.pattern.pattern.decode()[len("(?<= )(?:") : -len(")(?= )")])
        for text in texts:
            assert not rule.gates.isdisjoint(text.split()), (rule.name, text)
        for text in rng.sample(texts, min(len(texts), 8)):
            joined = f" {text} ".replace("\0", "7").encode()
            assert any(m.span() == (1, len(joined) - 1) for m in rule.pattern.finditer(joined)), (rule.name, text)
            assert detections(joined, set(joined.split())) == detections(joined, every) != []


@pytest.mark.parametrize("text, label", [
    ("Released under GPLv2", "gpl-2"), ("GPLv3", "gpl-3"), ("LGPLv3", "lgpl-3"), ("AGPLv3", "agpl-3"), ("Apache2", "apache-2.0"), ("MPL2", "mpl-2.0"),
    ("Berkeley Software Distribution License", "bsd"), ("Creative Commons Zero", "cc0"), ("X Consortium License", "x11"),
    ("SSLeay license", "openssl"), ("PSF license agreement", "python"), ("Beerware licence", "beerware"), ("WTFPLv2", "wtfpl-2"),
    ("unauthorised copying of this file", "proprietary"), ("licensed under the terms of the GPL version 2", "gpl-2"),
    ("licensed under the GPL", "gpl"), ("License: MIT", "mit"), ("Distributed under BSD-3-Clause", "bsd-3"), ("BSD-2-Clause licensed", "bsd-2"),
    ("released under ISC", "isc"), ("licensed under Python3", "python-3.0"),
])
def test_alternatives_and_bare_identifiers(text, label):
    assert [x[0] for x in found(text)] == [label]


def test_identifiers_outside_a_licence_context():
    assert found("run python3 and php3 at MIT with json") == []
    assert found("released under MIT License") == [("mit", 0, 4)]


def test_odd_rows(odd_wide, empty):
    rows = scan(odd_wide).collect()
    assert len(rows) == odd_wide.count() and all(r.base == [] and r.found == [] for r in rows)
    assert scan(empty).where(F.size("base") > 0).count() == 0


def quadratic(matches):
    """Suppression as it is defined: each match against all taken before it."""
    taken = []
    for m in sorted(matches, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3].name)):
        if not any((c <= m[1] and m[2] <= d) or (p > m[0] and m[1] < d and c < m[2]) for p, c, d, _ in taken):
            taken.append(m)
    return set(taken)


def test_suppression_against_brute_force():
    rng = random.Random(6)
    rules = numbered_rules()
    for _ in range(400):
        matches = []
        for _ in range(rng.randrange(1, 30)):
            a, rule = rng.randrange(40), rng.choice(rules[:9] + rules[-9:])
            matches.append((rule.priority, a, a + rng.randrange(1, 12), rule))
        assert set(_unsuppressed(matches)) == quadratic(matches)


def test_megabyte_of_detections(spark):
    n = 90_000  # takes hours if it is quadratic
    row = scan(spark.createDataFrame([(1, "MIT License. " * n)], "doc_id long, text string")).first()
    assert row.n_words == 2 * n and len(row.base) == n == len(row.found)
    assert [x.word for x in row.base] == list(range(0, 2 * n, 2)) == [x.start for x in row.found]
