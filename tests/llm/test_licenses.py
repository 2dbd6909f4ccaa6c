"""License scans against plain loops over the words."""

import re

from pyspark.sql import functions as F

from ratebook.llm.license_rules import RULES
from ratebook.llm.licenses import detections, scan

TEXTS = [
    (1, "This work is licensed under the GNU General Public License, version 3."), (2, "Released UNDER the MIT License. cc by-nc 4.0, cc by nc cc-by-nc!"), (3, "not licensed under the MIT license; Apache License, Version 2.0"),
    (4, None), (5, ""), (6, "mit dem Hund, under the mit licenses"), (7, "SPDX-License-Identifier: BSD-3-Clause"), (None, "under the mit license"), (None, "under the mit license"), (8, "under the mİt license; under the mit licenſe; marK"),
    (9, "x " * 30_000 + "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 " + "cc by nc\n" * 400), (10, "... --- !!!"), (11, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (12, "underthe mit license under the mit license7"),
]
BASE = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_hand(text):
    words = words_of(text)
    base = sorted((i, label) for phrase, label in BASE.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase)
    line, found = "".join(f" {w} " for w in words), []
    for r in RULES:
        for m in re.finditer(r.pattern, line):
            found.append((line[: m.start()].count(" ") // 2, line[: m.end()].count(" ") // 2, r))
    kept = [a for a in found if not any(b is not a and b[0] <= a[0] and b[1] >= a[1] and b[2].priority <= a[2].priority and (b[0] < a[0] or b[1] > a[1] or b[2].number < a[2].number) for b in found)]
    counted = [r for *_, r in kept] + [r for *_, r in found if r.base]
    labels = sorted({r.label for r in counted if r.label})
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({b[1] for b in base})), ",".join(labels), max((r.confidence for r in counted if r.label), default=0.0))


def test_scan_agrees_with_loops(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("labels", F.lit("mine")).withColumn("start", F.lit(3)).withColumn("rule", F.lit(0))
    got = sorted((tuple(r)[:-1] for r in scan(docs).collect()), key=repr)
    assert got == sorted(((i, *by_hand(t)) for i, t in TEXTS), key=repr)
    told = {r[0]: r for r in got}
    assert told[1][6] == "gpl-3" and told[3][6] == "apache-2,mit" and told[7][6] == "bsd-3-clause" and told[2][2] == 4 and told[12][2] == 0
    assert "cc-by-nc-sa" in told[9][6] and told[9][2] == 400


def test_hundreds_of_rules_in_order():
    assert len(RULES) > 300 and [r.priority for r in RULES] == sorted(r.priority for r in RULES)
    assert all(re.search(r.needed.strip(), r.pattern) or r.needed in r.pattern or r.needed.strip() in r.pattern for r in RULES)


def test_no_documents_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept int")
    assert scan(empty).collect() == []
    assert detections(empty.drop("kept")).collect() == []
