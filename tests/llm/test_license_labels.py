"""Licences that differ in one word or number are told apart."""

import random

import pytest

from docrevise.llm import licenses
from docrevise.llm import queries as Q

TEXTS = [
    ("GNU General Public License version 2", "gpl-2"), ("GNU General Public License, version 3.", "gpl-3"), ("gnu general public license version 20", ""),
    ("GNU General Publc License version 3 or later", "gpl-3"), ("gnu general public license version3", "gpl-3"),
    ("gnu general public license version 2 or gnu general public license version 3", "gpl-2,gpl-3"),
    ("Licensed under CC BY-ND", ""), ("licensed under CC BY SA 4.0", ""), ("Licenced under CC BY-NC", "cc-by-nc"),
    ("Licensed under the Apache License, Version 1.1", ""), ("Licensed under the Apache License, Version 2.0", "apache-2"), ("Licenced under the Apache Licence, Version 2.0", "apache-2"),
    ("Mozilla Public License version 1.1", ""), ("GNU General Public License version 1.3", ""), ("Mozila Public License version 2.0", "mpl-2"), ("released under the MPL license", ""), ("Relased under th MIT License", "mit"),
    ("Creative Commons Attribution 3.0 International", ""), ("Creative Common Attribution 4.0 International", "cc-by"), ("Boost Software License version 1.0", "bsl-1"),
]


def test_labels(spark):
    d = spark.createDataFrame([(i, f"some text, {t}, and more") for i, (t, _) in enumerate(TEXTS)] + [(100 + i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id int, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.digest(licenses.scan_licenses(d)).collect()}
    assert got == {i + at: want for i, (_, want) in enumerate(TEXTS) for at in (0, 100)}


def test_query_labels(spark):
    """The given notices carry one licence each."""
    got = {r["labels"] for r in Q.op1_license_scan(spark, "/root/testdata/sf0.01").select("labels").distinct().collect()}
    assert "gpl-3" in got and not any("gpl-2" in x for x in got)


@pytest.mark.parametrize("seed", range(3))
def test_edits_beside_the_telling_words_lose_nothing(seed):
    r, s = random.Random(seed), licenses.Scanner()
    for notice, label, k, _ in s.notices:
        for _ in range(20):
            w = notice.split(" ")
            for _ in range(r.randrange(k + 1)):
                i = r.choice([i for i, x in enumerate(w) if len(x) > 1 and x not in licenses.TELLING])
                at = r.randrange(len(w[i]))
                w[i] = w[i][:at] + r.choice(["", "x", w[i][at] + "y"]) + w[i][at + 1:]
            hits = s.fuzzy("some words before " + " ".join(w) + " and after", telling=True)
            assert any(h[0] == label for h in hits), w
