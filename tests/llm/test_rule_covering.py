"""Covering goes on until nothing gains."""

import pytest
from pyspark.sql import functions as F

from docrevise.llm import quality_rules


def labelled(spark, kinds, n=60):
    """``n`` rows per (words, mean characters, symbol share, bad); bad None: bad
    in the growing part and half bad in the pruning part."""
    d = spark.createDataFrame([(k * 10_000 + i, int(w), int(w * m), int(w * m * s), b) for k, (w, m, s, b) in enumerate(kinds) for i in range(n)],
                              "key bigint, q_n_words bigint, q_word_chars bigint, q_n_symbols bigint, bad boolean")
    grow = F.pmod(F.xxhash64("key"), F.lit(3)) < 2
    d = d.withColumn("bad", F.coalesce("bad", grow | (F.col("key") % 2 == 0)))
    return d.select("*", *[F.lit(0).cast("bigint").alias(f"q_{x}") for x in quality_rules.STATISTICS if f"q_{x}" not in d.columns])


def wrong(d, rules):
    return d.where(rules.verdict() == F.col("bad")).count()


def test_more_than_eight_kinds(spark):
    kinds = [(w, 4.2, 0, False) for w in (15, 40, 100, 300, 1000, 6000)] + [(w, 4.2, 0, True) for w in (25, 65, 150, 600, 3000)]
    kinds += [(1000, m, 0, False) for m in (2.7, 3.7, 5.2, 6.2, 7.5, 11)] + [(1000, m, 0, True) for m in (2.2, 3.2, 4.7, 5.7, 6.7, 9)]
    d = labelled(spark, kinds)
    rules = quality_rules.learn_rules(d)
    assert len(rules.rules) > 8 and wrong(d, rules) == 0, str(rules)


def test_goes_on_after_a_failed_rule(spark):
    d = labelled(spark, [(100, 5.2, 0, False)] * 10 + [(100, 5.2, 0.5, None)] * 4 + [(100, 9, 0, True)])
    rules = quality_rules.learn_rules(d)
    assert [x.feature for r in rules.rules for x in r] == ["mean_word_chars"], str(rules)


@pytest.mark.parametrize("bad", [True, False])
def test_one_class(spark, bad):
    assert quality_rules.learn_rules(labelled(spark, [(100, 5, 0, bad), (15, 9, 0.1, bad)])).rules == []


def test_few_jobs_with_noisy_labels(spark, monkeypatch):
    """A tenth of the labels flipped: jobs follow the rules' lengths, not the
    first conditions that fail."""
    kinds = [(w, 3 + w % 7, 0.01 * (w % 13), w % 3 == 0) for w in range(12, 900, 7)]
    d = labelled(spark, kinds, 20)
    d = d.withColumn("bad", (F.pmod(F.xxhash64("key", F.lit(1)), F.lit(10)) == 0) != F.col("bad")).withColumn(
        "q_n_dup_lines", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(20))).withColumn("q_n_lines", F.lit(20).cast("bigint")).withColumn(
        "q_n_distinct", F.pmod(F.xxhash64("key", F.lit(3)), F.col("q_n_words")))
    jobs, inner = [], quality_rules._counts
    monkeypatch.setattr(quality_rules, "_counts", lambda *a: jobs.append(1) or inner(*a))
    rules = quality_rules.learn_rules(d)
    assert rules.rules and len(jobs) <= 12 * (len(rules.rules) + 1), (len(jobs), str(rules))
