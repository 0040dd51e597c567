"""Vector codes against Python integers; limb products against exact ones."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from docrevise.llm import vector_codes


def plain(rows, parts=8, k=16, rounds=6):
    """rows: [(vec_id, vector, label)] -> (vec_id, code, error, label_error, sha)."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [(i, [v[p * w:p * w + w] for p in range(parts)], lab) for i, v, lab in kept]
    books = [[list(r[1][p]) for r in cut[:k]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, v, _ in cut:
                own[near(v[p], book)[1]].append(v[p])
            new.append([[sum(c) // len(m) for c in zip(*m)] if m else book[j] for j, m in enumerate(own)])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, total = [], {}
    for i, v, lab in cut:
        best = [near(v[p], books[p]) for p in range(parts)]
        e = sum(d for d, _ in best)
        total[lab] = total.get(lab, 0) + e
        out.append((i, "".join(f"{j:02x}" for _, j in best), e, lab))
    return sorted(((i, c, e, total[lab], sha) for i, c, e, lab in out), key=repr)


def key(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_products():
    r = np.random.default_rng(0)
    for top in (3, 40, 1 << 15, 1 << 16, 1 << 20, 1 << 29):
        a, b = r.integers(-top, top, (40, 8)), r.integers(-top, top, (8, 16))
        assert (vector_codes.exact_product(a, b) == a @ b).all()
        assert all((np.abs(x) <= 1 << 15).all() for x in vector_codes.limbs(a))
        at, d = vector_codes.nearest(a, np.ascontiguousarray(b.T))
        want = ((a[:, None, :] - b.T[None]) ** 2).sum(axis=2)
        assert (at == want.argmin(axis=1)).all() and (d == want.min(axis=1)).all()


def test_cases(spark):
    r = random.Random(4)
    v = lambda s=1.0: [r.choice([r.gauss(0, s), 0.0, -0.25, s]) for _ in range(16)]
    rows = [(i, v(), r.choice([None, 1, 2])) for i in range(150)] + [(200 + i, v(9000.0), 3) for i in range(20)]
    rows += [(5, v(), 1), (5, rows[5][1], 1), (None, v(), None), (300, None, 1), (301, [1.0, None] * 8, 1), (302, [math.nan] * 16, 1), (303, [math.inf] * 16, 2)]
    schema = "vec_id bigint, embedding array<double>, label int"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as id", "2 as v", "'z' as code", "4 as error").repartition(5)
    assert key(vector_codes.compress_vectors(df)) == plain(rows)
    few = rows[:9]
    assert key(vector_codes.compress_vectors(spark.createDataFrame(few, schema))) == plain(few)
    assert vector_codes.compress_vectors(df.limit(0)).count() == 0
    assert vector_codes.compress_vectors(df.where("embedding is null")).count() == 0


def test_many_labels(spark):
    """The salted join of the totals gives what the broadcast gives."""
    rows = [(i, None if i % 3 == 0 else i % 40, "00", i) for i in range(400)]
    d = spark.createDataFrame(rows, "id bigint, label int, code string, error bigint")
    a, b = vector_codes.label_totals(d), vector_codes.label_totals(d, few=3)
    assert sorted(map(tuple, a.select("id", "label_error").collect())) == sorted(map(tuple, b.select("id", "label_error").collect()))
    assert b.where(F.col("label").isNull() & (F.col("label_error") == sum(range(0, 400, 3)))).count() == 134
