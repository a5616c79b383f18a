"""Periodic runs against all pairs of places, on sequences made to be hard."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from cohortry.llm import periods
from cohortry.llm import words as W
from cohortry.llm.catalog import CATALOG
from tests.conftest import SMALL
from tests.llm import brute


def all_runs(words):
    """Every ``(start, end, smallest period)`` of at least two periods."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b, q) for (a, b), q in out.items())


def sequences(seed, count):
    rng = random.Random(seed)

    def bits(n):
        return [rng.randrange(2) for _ in range(n)]

    fibonacci, other = [0, 1], [0]
    while len(fibonacci) < 200:
        fibonacci, other = fibonacci + other, fibonacci
    for k in range(count):
        kind, n = k % 7, rng.randrange(0, 150)
        if kind == 0:
            yield bits(n)
        elif kind == 1:
            yield [rng.randrange(3) for _ in range(n)]
        elif kind == 2:  # runs of one period beside each other in other phases
            d, s = rng.randrange(1, 6), []
            base = bits(d) * 60
            for _ in range(rng.randrange(1, 6)):
                at = rng.randrange(d)
                s += base[at: at + rng.randrange(40)]
            yield s[:220]
        elif kind == 3:  # a period that itself has a small one
            d = rng.randrange(1, 12)
            unit = (bits(d) * 20)[: rng.randrange(1, 40)] + bits(rng.randrange(4))
            yield bits(rng.randrange(5)) + (unit * 6)[: rng.randrange(10, 200)] + bits(rng.randrange(5))
        elif kind == 4:
            at = rng.randrange(60)
            yield fibonacci[at: at + n]
        elif kind == 5:
            s = [bin(i).count("1") % 2 for i in range(n)]
            yield s + s[: n // 2]
        else:
            s = bits(rng.randrange(1, 40)) * rng.randrange(1, 5)
            for _ in range(rng.randrange(3)):
                s[rng.randrange(len(s))] = 2
            yield (s * rng.randrange(1, 3))[:220]


def hashed(words):
    return W.mix(np.array(words, np.uint64), 3)


def test_all_runs():
    for s in sequences(3, 2500):
        assert [tuple(r) for r in periods.find_runs(hashed(s), len(s)).tolist()] == all_runs(s), s


def test_texts_of_a_chunk_do_not_meet():
    texts = list(sequences(4, 60))
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    of, runs = periods.chunk_runs(hashed([w for t in texts for w in t]), first, 12)
    for k, t in enumerate(texts):
        assert sorted(map(tuple, runs[of == k].tolist())) == [r for r in all_runs(t) if r[1] - r[0] >= 12]


@pytest.mark.parametrize("s", [[0] * 100_000, [0, 1] * 50_000, ([0, 1] * 25_000 + [0]) * 2])
def test_long_and_dense(s):
    runs = periods.find_runs(hashed(s), len(s))
    assert [0, len(s)] in runs[:, :2].tolist() and len(runs) < len(s)


def wanted(doc_id, text, damage):
    words = brute.WORD.findall(text or "")
    n = len(words)
    if damage and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = [r for r in all_runs(words) if r[1] - r[0] >= 12]
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in runs)]
    collapsed = " ".join(kept)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    longest = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return (len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest()), collapsed


def values(r):
    return r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256


@pytest.mark.parametrize("damage", [False, True])
def test_texts(spark, damage):
    texts = [None, "", " \n\t ", "one", "été " * 30, "A a " * 10, " ".join(["日本 x"] * 9), "x" * 20_000, *(" ".join(f"w{x}" for x in s) for s in sequences(5, 150))]
    rows = [(i, t, "r", "s", "p") for i, t in enumerate(texts)] + [(None, "a b " * 20, "r", "s", "p"), (3, "z " * 15, "r", "s", "p")]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs string, start string, period string").repartition(5)
    got = sorted((r.doc_id is None, r.doc_id or 0, values(r), r.collapsed) for r in periods.report(table, damage, with_runs=True).collect())
    assert got == sorted((i is None, i or 0, *wanted(i, t, damage)) for i, t, *_ in rows)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    some = {i: t for i, t in docs if len(t or "") < 4000}
    got = {r.doc_id: values(r) for r in CATALOG["op13_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    assert {i: got[i] for i in some} == {i: wanted(i, t, True)[0] for i, t in some.items()}


def test_no_rows(spark, no_docs):
    assert periods.report(no_docs, True).count() == 0
