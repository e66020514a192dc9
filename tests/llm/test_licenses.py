"""License scans against regular expressions over plain word lists."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from veridock.llm import licenses as lic
from veridock.llm.licrules import STRENGTH

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(words):
    out = []
    for text, label in lic.BASE:
        own = text.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return out


def plain_detections(words):
    """All matches of all rules, then each against each."""
    line = "".join(f" {w} " for w in words)
    spans = []
    for number, (label, level, keyword, pattern) in enumerate(lic.RULES):
        if keyword.replace(" ", "  ") in line:
            for m in re.finditer(f" (?:{pattern.replace(' ', '  ')}) ", line):
                start = line[: m.start()].count(" ") // 2
                spans.append((start, start + m[0].count(" ") // 2, level, number, label))

    def falls(s):
        for t in spans:
            inside = t[0] <= s[0] and s[1] <= t[1] and t != s
            if inside and t[2] <= s[2] and (t[:2] != s[:2] or t[2:4] < s[2:4]):
                return True
        return False

    return sorted((s for s in spans if not falls(s)), key=lambda s: (s[0], -s[1], s[2], s[3]))


def plain(text):
    words = plain_words(text)
    base, found = plain_base(words), plain_detections(words)
    starts = [i for i, _ in base]
    labels = {x for _, x in base}
    score = max([0.0, *[lic.BASE_STRENGTH] * bool(base), *(STRENGTH[s[2]] for s in found)])
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[4] for s in found})), score


def test_rules_are_many_and_their_keywords_are_in_what_they_match():
    assert len(lic.RULES) > 250 and len({r[3] for r in lic.RULES}) > 240
    for label, _, _, pattern in lic.RULES:
        re.compile(pattern)
        assert " ?" not in pattern and "  " not in pattern and re.fullmatch("[a-z0-9.-]+", label)


PIECES = [
    "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: MIT", "All rights reserved.", "ALL RIGHTS\nRESERVED",
    "GNU General Public License, version 3 or any later version", "GNU Lesser General Public License v2.1", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "cc by cc by CC-BY",
    "https://www.apache.org/licenses/LICENSE-2.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0", "BSD 3-Clause License", "simplified BSD", "Mozilla Public License 2.0",
    "all rights", "general public", "license", "copyright (c) 2019 2020", "Copyright © 2021", "public domain", "in the public domain", "Kein Text.", "é日本", "", "x", "the Kelvin lİcense", "cc by", "GPLv3", "gpl v 2",
    "neither the name of the firm nor the names of its contributors may be used to endorse or promote products", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
]


def test_against_plain_matching(spark):
    dice = random.Random(11)
    texts = PIECES + [dice.choice([" ", "\n", " - ", ", "]).join(dice.choice(PIECES) for _ in range(dice.randrange(1, 9))) for _ in range(250)] + [None, "", " .", "all rights reserved " * 700 + "cc by"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lic.scan(docs).collect()}
    for i, text in enumerate(texts):
        words = plain_words(text)
        assert got[i]["n_words"] == len(words)
        assert [tuple(s) for s in got[i]["detections"]] == plain_detections(words), text


def test_query_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r[1:]) for r in lic.op11_license_scan(spark, DATA).collect()}
    assert len(got) == len(docs)
    assert got == {r["doc_id"]: plain(r["text"]) for r in docs}


@pytest.mark.parametrize("text, label", [("SPDX-License-Identifier: GPL-3.0-only", "gpl-3.0"), ("under the GNU GPL, version 2 or later.", "gpl-2.0-or-later"), ("GPL", "gpl"), ("the BSD 2-clause license", "bsd-2-clause")])
def test_the_more_telling_rule_stands_alone(spark, text, label):
    rows = lic.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["detections"]
    assert [r["label"] for r in rows if r["level"] < 3] == [label]


def test_rows_of_any_kind(spark):
    docs = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, None)], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("rules", F.lit(2))
    assert lic.scan(docs).count() == 3
    assert lic.scan(docs.limit(0)).count() == 0
    plan = lic.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
