"""Exact copies, near copies and repeated lines against plain forms."""

import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortry.llm import exact_dedup, line_dedup, ngram_join, similar, words
from tests.llm import brute


def plain_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t in rows}


@pytest.mark.parametrize("digest", [lambda t: F.sha2(t, 256), lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha256", "clashing"])
def test_exact_copies(spark, rows, digest):
    twice = rows + [(1000 + i, t) for i, t in rows if i % 2] + [(2000 + i, "crowd of copies") for i in range(300)]
    table = spark.createDataFrame(twice, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.copies(table, digest=digest).collect()}
    assert got == plain_copies(twice)


def test_exact_copies_name_the_text(docs, rows):
    got = {r.doc_id: r.digest for r in exact_dedup.copies(docs).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}


def test_drop_copies_keeps_columns(docs, rows):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i, (_, _, kept) in plain_copies(rows).items() if kept}


def test_drop_copies_by_row(spark):
    rows = [(None, "only one", 1), (1, "A", 1), (1, "B", 1), (2, "B", 1), (3, "C", 1), (3, "C", 1), (None, "D", 1), (5, "D", 2), (7, None, 1), (8, "", 1), (9, "E", 1), (9, "E", 2)]
    table = spark.createDataFrame([(*r, "x", {"k": "v"}) for r in rows], "doc_id long, text string, n int, own_text string, m map<string,string>").repartition(4)
    out = exact_dedup.drop_copies(table)
    assert out.columns == table.columns
    got = sorted(((r.doc_id, r.text, r.n, r.own_text, r.m) for r in out.collect()), key=str)
    assert got == sorted(((*r, "x", {"k": "v"}) for r in [(None, "only one", 1), (1, "A", 1), (2, "B", 1), (3, "C", 1), (5, "D", 2), (8, "", 1), (9, "E", 2)]), key=str)
    assert {(r.doc_id, r.kept) for r in exact_dedup.copies(table.where("text in ('only one', 'D')")).collect()} == {(None, True), (None, False), (5, True)}


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_components(docs, rows, n, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, n, num, den).collect()}
    assert got == brute.components(rows, n, num, den)


def test_components_with_crowded_lists(docs, rows, monkeypatch):
    monkeypatch.setattr(similar, "CROWDED", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 4, 85, 100).collect()}
    assert got == brute.components(rows, 4, 85, 100)


def test_keep_one(docs, rows):
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, (_, c) in brute.components(rows, 5, 80, 100).items() if i == c}


def test_links_of_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 200), (200, 300)]
    edges = spark.createDataFrame(chain, "x long, y long")
    got = {r.node: r.root for r in similar.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 0, 300: 0}
    assert similar.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "num", "den"), [(5, 80, 100), (1, 70, 100)])
def test_lines(docs, rows, n, num, den):
    out = line_dedup.drop_lines(docs, n, num, den)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.select("doc_id", "text").collect()} == brute.kept_lines(rows, n, num, den)


def test_derived_answers_are_right(spark):
    """Whatever is derived from a similar set agrees with the sets themselves."""
    import random

    rng = random.Random(3)
    base = [frozenset(rng.sample(range(300), 40)) for _ in range(4)]
    sets = [s for b in base for s in (b, *(frozenset(list(b)[k:]) | {1000 + k} for k in range(1, 9)))]
    number = list(enumerate(sets))
    link = [(i, j, len(a), len(b), len(a & b)) for i, a in number for j, b in number if i < j and (i // 9 == j // 9 or rng.random() < 0.3)]
    known = spark.createDataFrame(link, "x long, y long, x_size long, y_size long, common long")
    pairs = spark.createDataFrame([(i, j) for i, _ in number for j, _ in number if i < j], "x long, y long")
    sizes = spark.createDataFrame([(i, len(s)) for i, s in number], "node long, size long")
    job = similar.Job(spark.createDataFrame([], "doc_id long, text string"), similar.documents, 4, 60, 100)
    answers = [r for r in job.derive(pairs, known, sizes).collect() if r.similar is not None]
    assert answers
    for r in answers:
        a, b = sets[r.x], sets[r.y]
        assert r.similar == (100 * len(a & b) >= 60 * len(a | b))


def test_no_rows(no_docs):
    assert exact_dedup.copies(no_docs).count() == 0
    assert ngram_join.near_duplicates(no_docs).count() == 0
    assert line_dedup.drop_lines(no_docs).count() == 0


def test_repeated_rows_and_null_ids(spark):
    table = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (2, "x")], "doc_id long, text string")
    assert sorted((r.group_size for r in exact_dedup.copies(table).collect()), reverse=True) == [3, 3, 3, 1, 1]
    assert ngram_join.near_duplicates(table).count() == 5
    kept = line_dedup.drop_lines(table)
    assert kept.count() == 5


def test_pairs_that_meet_too_late_are_no_rows(spark):
    """Two sets of 100 that may differ in 8 tokens each at most: what they share begins at place 8 at the latest."""
    job = similar.Job(spark.createDataFrame([], "doc_id long, text string"), similar.documents, 4, 85, 100)
    state = spark.createDataFrame([(n, n, 0, 0, 0, 0) for n in (1, 2)], "node long, root long, sign0 long, sign1 long, sign2 long, sign3 long")

    def pairs(places, method):
        lists = spark.createDataFrame([(p, -1, n, 100, p) for p in places for n in (1, 2)], "token long, place int, node long, size int, pos int")
        return [tuple(r) for r in method(lists, state, lambda a, b: F.col(f"{a}root") != F.col(f"{b}root")).collect()]

    for method in (job.other_pairs, job.next_pairs):
        assert pairs(range(9, 16), method) == []
        assert pairs([8], method) == [(1, 2)]


def test_lines_of_a_large_batch_are_split_some_at_a_time():
    import tracemalloc

    import pyarrow as pa

    column = pa.array(["some words of a line that is as long as lines are\n" * 60] * 16_000 + [None, "", "a\n\nb"])
    tracemalloc.start()
    sums = np.zeros(2, np.int64)
    for rows, number, words, first in similar.lines(column):
        sums += (len(rows), len(words))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sums.tolist() == [61 * 16_000 + 5, 60 * 12 * 16_000 + 2]
    # the batch has 49 MB
    assert peak < 90 << 20
    some = list(similar.lines(column, lambda rows, number: (rows == 16_002) & (number != 1)))
    assert [(r, k) for rows, number, *_ in some for r, k in zip(rows.tolist(), number.tolist())] == [(16_002, 0), (16_002, 2)]


def test_marks_of_sets_are_no_objects_on_the_driver(spark):
    import tracemalloc

    job = similar.Job(spark.createDataFrame([], "doc_id long, text string"), similar.documents, 4, 85, 100)
    job.survey()
    nodes = spark.range(150_000).select(F.xxhash64("id").alias("node"))
    tracemalloc.start()
    assert job.sets(nodes).count() == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the bitmap has 8 MB, and 140,000 marks come as two columns
    assert peak < 32 << 20


def test_survey_leaves_out_blank_lines(spark):
    job = similar.Job(spark.createDataFrame([(1, "a b\n\n \nc"), (2, None)], "doc_id long, text string"), similar.lines, 5, 80, 100)
    worded, _ = job.survey(blank=False)
    assert sorted((r.id, r.item, r.size) for r in worded.collect()) == [(1, 0, 1), (1, 3, 1)]


def test_lists_are_the_same_with_places(docs, monkeypatch):
    """Crowded lists are dealt to places, and each entry still has its token."""

    def entries():
        job = similar.Job(docs, similar.lines, 5, 80, 100)
        job.survey(blank=False)
        return [tuple(r) for r in job.lists().select("token", "node", "size", "pos", "place").collect()]

    plain = {e[:4] for e in entries()}
    monkeypatch.setattr(similar, "CROWDED", 4)
    dealt = entries()
    assert max(e[4] for e in dealt) > 0
    assert plain <= {e[:4] for e in dealt}


@pytest.mark.parametrize("crowded", [20_000, 4])
def test_lists_travel_in_blocks(spark, docs, monkeypatch, crowded):
    """Lists are those that a plain count gives, entries and neighbours, without an exchange or a window of single entries."""
    made = []
    monkeypatch.setattr(similar, "CROWDED", crowded)
    monkeypatch.setattr(similar, "PART", 500)
    monkeypatch.setattr(similar, "SENT", 300)
    job = similar.Job(docs, similar.lines, 5, 80, 100)
    job.survey(blank=False)
    stage = similar.stage
    monkeypatch.setattr(similar, "stage", lambda df, label: made.append(df) or stage(df, label))
    got = job.lists().collect()
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "part#" in plan

    # a task names the first item that it sees of those with a set
    want, owners, least = {}, defaultdict(set), {r.node: r.ord for r in got}
    table = docs.select("doc_id", "text").toArrow().combine_chunks()
    ids, texts = table.column(0).combine_chunks().fill_null(0).to_numpy(), table.column(1).combine_chunks()
    for rows, _, hashes, first in similar.lines(texts):
        tokens, row = job.tokens(hashes, first)
        node, size = job._node_of(tokens, row, len(rows))
        for k in range(len(rows)):
            own = tokens[row == k].view(np.int64).tolist()
            owners[int(node[k])].add(int(ids[rows[k]]))
            for pos, token in enumerate(own[: len(own) - -(-len(own) * 80 // 100) + 1]):
                want.setdefault(token, {})[int(node[k])] = (len(own), pos)
    places = np.maximum(1, -(-job.counts // crowded))[np.argsort(job.rank)]
    spread = {token: int(places[(token & (1 << 64) - 1) >> 48]) for token in want}
    lists = {}
    for token, entries in want.items():
        for node, (size, pos) in entries.items():
            place = (node & (1 << 64) - 1) % spread[token] if spread[token] > 1 else -1
            lists.setdefault((token, place), []).append((pos, least.get(node, 0), node, size))
    lists = {at: sorted(held) for at, held in lists.items() if len(held) > 1 or at[1] >= 0}
    assert all(r.ord in owners[r.node] for r in got)
    entry = lambda e: e and (e[2], e[3], e[0])
    plain = {(token, place, *entry(e), e[1], held[i - 1][2:] + held[i - 1][:1] if i else None, entry(held[0])) for (token, place), held in lists.items() for i, e in enumerate(held)}
    assert len(got) == len(plain) and {(*r[:6], r.before and tuple(r.before), tuple(r.head)) for r in got} == plain


def test_distinct_values_that_differ_in_their_last_bits():
    rng = np.random.default_rng(1)
    values, row = rng.integers(0, 1 << 64, 2000, np.uint64), np.sort(rng.integers(0, 50, 2000))
    for some in (values, values[:20].repeat(100), (values[:40].repeat(50) & ~np.uint64(7)) + rng.integers(0, 3, 2000).astype(np.uint64)):
        v, r = words.distinct(some, row)
        assert list(zip(r.tolist(), v.tolist())) == sorted(set(zip(row.tolist(), some.tolist())))


def test_signatures_of_lines_tell_sets_apart():
    """Sets of 100 that share 80 are not similar at 0.8 (they would share 89), and few of them look as if they were."""
    rng = np.random.default_rng(2)
    alike = 0
    for _ in range(200):
        common = rng.integers(0, 1 << 64, 80, np.uint64)
        sets = [np.sort(np.concatenate([common, rng.integers(0, 1 << 64, 20, np.uint64)])) for _ in range(2)]
        signs = similar.signatures(np.concatenate(sets), np.repeat([0, 1], 100), 2, similar.SIGNED[similar.lines])
        differ = sum(int(s[0] ^ s[1]).bit_count() if s[0] ^ s[1] >= 0 else (int(s[0] ^ s[1]) & (1 << 64) - 1).bit_count() for s in signs)
        alike += (200 - differ) * 180 >= 160 * 200
    assert alike < 20


def test_long_signatures_drop_only_pairs_that_differ(spark):
    """Sets of some hundreds, far more than the bits of the short signatures, with all similarities and two widths."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 1040, np.uint64)
    sets = [np.sort(np.concatenate([base[:n], rng.integers(0, 1 << 64, k, np.uint64)])) for n, k in ((1040, 0), (1000, 20), (950, 60), (1000, 100), (600, 400), (100, 900), (40, 0))]
    made = similar.marks(np.concatenate(sets), np.repeat(np.arange(7), [len(s) for s in sets]), 7).to_pylist()
    assert [len(m) for m in made] == [32, 16, 16, 32, 16, 16, 1]
    nodes = spark.createDataFrame([(i, len(s), m) for i, (s, m) in enumerate(zip(sets, made))], "node long, size long, marks array<long>")
    pairs = spark.createDataFrame([(i, j) for i in range(7) for j in range(i + 1, 7)], "x long, y long")
    job = similar.Job(spark.createDataFrame([], "doc_id long, text string"), similar.documents, 4, 85, 100)
    kept = {tuple(r) for r in job.likely(pairs, nodes).collect()}
    for i in range(6):
        for j in range(i + 1, 6):
            both = len(np.intersect1d(sets[i], sets[j]))
            share = both / (len(sets[i]) + len(sets[j]) - both)
            assert (i, j) in kept if share >= 0.85 else share > 0.7 or (i, j) not in kept


def test_names_of_words_tell_words_apart():
    """Equal but for A-Z means an equal name, wherever the word stands; words of one to 200 bytes, with common beginnings, ends and zeros."""
    rng = random.Random(6)
    made = [bytes(rng.choice(b"aAbB\0") for _ in range(n)) for n in range(1, 200) for _ in range(4)] + [b"x" * n for n in range(1, 200)]
    made += ["\u00e9t\u00e9".encode(), "\u00c9t\u00e9".encode(), b"z" * 63 + b"y", b"z" * 64, b"z" * 65, b"a\0", b"a", b"@[`{", b"`[@{"]
    texts = [w.decode() for w in made] + [w.decode() + " tail" for w in made] + ["head " + w.decode() for w in made]
    named = {}
    for size in (40, 1 << 20):
        for chunk in words.chunks(pa.array(texts, pa.string()), size):
            data = chunk.data.tobytes()
            for start, end, name in zip(chunk.starts.tolist(), chunk.ends.tolist(), chunk.names().tolist(), strict=True):
                named.setdefault(data[start:end].lower(), set()).add(name)
    assert {w.lower() for w in made} <= set(named) and {len(names) for names in named.values()} == {1}
    assert len({name for names in named.values() for name in names}) == len(named)


@pytest.mark.parametrize("n", [1, 2, 4, 5, 7])
def test_shingles_tell_windows_apart(n):
    """Windows of few words, so that many are permutations of others; short rows are windows of their own, empty ones have none."""
    rng = np.random.default_rng(8)
    counts = np.append(rng.integers(0, 2 * n + 3, 300), [0, 0, 1, n, n - 1, 0])
    first = np.append(0, np.cumsum(counts))
    some = rng.integers(0, 3, first[-1])
    values, row = words.shingles(words.mix(some.astype(np.uint64), 5), first, n)
    assert (np.diff(row) >= 0).all()
    want = [(k, tuple(own[i: i + n])) for k, own in enumerate(np.split(some.tolist(), first[1:-1])) for i in range(max(len(own) - n + 1, min(1, len(own))))]
    assert row.tolist() == [k for k, _ in want]
    names = {}
    for (_, window), value in zip(want, values.tolist(), strict=True):
        names.setdefault(window, set()).add(value)
    assert {len(x) for x in names.values()} == {1} and len({v for x in names.values() for v in x}) == len(names)
    # no words at all, and fewer than a window has
    assert len(words.shingles(np.zeros(0, np.uint64), np.zeros(3, np.int64), n)[0]) == 0
    assert len(words.shingles(np.ones(1, np.uint64), np.array([0, 1]), n)[0]) == 1


def test_sets_cost_less_than_with_a_running_hash():
    rng = random.Random(9)
    column = pa.array([" ".join("x" * rng.randrange(1, 12) + str(rng.randrange(99)) for _ in range(12)) for _ in range(12_000)])

    def cost(make):
        spent = []
        for _ in range(5):
            begin = time.process_time()
            for chunk in words.chunks(column):
                make(chunk)
            spent.append(time.process_time() - begin)
        return min(spent)

    old = cost(lambda c: words.grams(c.words(lower=True), c.first, 5))
    assert cost(lambda c: words.shingles(c.names(), c.first, 5)) < 0.9 * old
