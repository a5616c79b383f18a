"""Quality rules, toxicity, pieces, packing and words against plain forms."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortry.llm import packing, pieces, quality, toxicity
from cohortry.llm import words as W
from tests.conftest import SMALL
from tests.llm import brute

ODD = [None, "", " \n\t\v\f\r ", "one", "a b\na b\n\na b", "x " * 40 + "\n" + "x " * 40, "é#*$ <b>| ü\x1cz", "tab\tand\x0bvt",
       "Don't <|endoftext|> stop's né, “quoted”—x 12ab3 ÀÉ×3 a\x1cb é≠  z", "日本語😀 über’s 'team ▁ a▁b", "z" * 5000]


def odd_table(spark, extra="id string, rows string, score string"):
    schema = f"doc_id long, text string, lang string, {extra}"
    return spark.createDataFrame([(i, t, None, *["x"] * len(extra.split(","))) for i, t in enumerate(ODD)], schema)


def test_words_and_lines():
    column = pa.array(ODD)
    for size in (1, 50, 1 << 20):
        words = {}
        for chunk in W.chunks(column, size):
            for k, row in enumerate(chunk.rows):
                words[row] = [bytes(chunk.data[s:e]).decode() for s, e in zip(chunk.starts[chunk.first[k]: chunk.first[k + 1]],
                                                                              chunk.ends[chunk.first[k]: chunk.first[k + 1]])]
        assert words == {i: brute.WORD.findall(t or "") for i, t in enumerate(ODD)}
    texts, row = W.lines(column)
    assert texts.to_pylist() == [x for t in ODD for x in (t or "").split("\n")]
    assert row.tolist() == [i for i, t in enumerate(ODD) for _ in (t or "").split("\n")]
    assert len(W.lines(pa.array([], pa.string()))[0]) == 0
    assert list(W.chunks(pa.array([], pa.string()))) == []


def test_equal_words_have_equal_hashes():
    chunk = next(W.chunks(pa.array(["same other same", "Same same"])))
    a = chunk.words()
    assert a[0] == a[2] == a[4] != a[3] and chunk.words(lower=True)[3] == a[0]


def test_base_counts(spark, rows):
    texts = ODD + [t for _, t in rows]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.Model(np.zeros(quality.KINDS << quality.BITS, np.float32), 40.0, 1.0, 0.0)
    for r in quality.assess(table, model).collect():
        want = brute.base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (r.base_failed, r.kept) == (failed, not failed)


def test_quality_of_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 3 != 0"))
    rows = quality.assess(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").collect()
    assert len(rows) > 50
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95


def test_models_without_examples(spark):
    table = odd_table(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.assess(table, quality.fit(table, none)).count() == len(ODD)
    out = toxicity.assess(table, toxicity.fit(table, none)).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert quality.assess(table.limit(0), quality.fit(table, none)).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").where("doc_id < 6000") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, epochs=4)
    rows = toxicity.assess(docs, model).where("held_out").join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    score, label = np.array([r.score for r in rows]), np.array([r.label for r in rows])
    order = score.argsort().argsort() + 1
    up = label.sum()
    assert (order[label == 1].sum() - up * (up + 1) / 2) / (up * (len(label) - up)) > 0.85
    # neither language nor id plays a part in a score
    again = toxicity.assess(docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 10**6), model)
    assert {r.doc_id - 10**6: r.score for r in again.collect()} == {r.doc_id: r.score for r in toxicity.assess(docs, model).collect()}


def test_toxicity_is_learned_alike_in_slices_of_any_size(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    models = []
    for size in (1 << 30, 1, 700):
        monkeypatch.setattr(toxicity.slices, "__defaults__", (size,))
        models.append(toxicity.fit(docs, labels, {0: 60, 1: 40}, epochs=2))
    for model in models[1:]:
        assert np.allclose(model.table, models[0].table, atol=1e-4) and np.allclose(model.output, models[0].output, atol=1e-4)


def test_filters_carry_the_toxicity_score(spark):
    """The first coordinate of a word begins at its log-odds; without filters trained on it the scores rank worse."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))

    def quality(epochs):
        out = toxicity.assess(docs, toxicity.fit(docs, labels, epochs=epochs)).where("held_out").join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
        p = np.clip(np.array([r.score for r in out]), 1e-9, 1 - 1e-9)
        y = np.array([r.label for r in out])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    assert quality(6) <= quality(0) + 1e-6


def test_toxicity_is_learned_from_every_labelled_row(spark, monkeypatch):
    """A word that only stands in the rows with the highest hashes of 1,800 is learned, in one shard or in several."""
    ids = spark.range(12_000).where(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id")).limit(5_200)
    ids = [r.id for r in ids.collect()]
    toxic = ids[:: 3][:1800]
    late, marked = set(toxic[1550:]), set(toxic)
    texts = {i: f"some plain words {'vilest' if i in late else 'nasty' if i in marked else 'kindly'} said {'abcdefg'[i % 7] * 5}" for i in ids}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()] + [(-1, "some plain words vilest said", "en"), (-2, "some plain words said", "en")],
                                 "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i in marked)) for i in ids], "doc_id long, toxic int")
    for size in (toxicity.SHARD * 2, 1000):
        monkeypatch.setattr(toxicity, "SHARD", size)
        model = toxicity.fit(docs, labels, epochs=3)
        score = {r.doc_id: r.score for r in toxicity.assess(docs.where("doc_id < 0"), model).collect()}
        assert score[-1] > 0.9


@pytest.mark.parametrize("marks", [1 << 26, 64])
def test_toxicity_moves_texts_of_labelled_rows_once(spark, monkeypatch, marks):
    """Unlabelled texts go where they are read, as far as marks tell them apart; what is learned from is the same with few marks."""
    docs = spark.createDataFrame([(i, t, "en") for i in range(3000) for t in [f"text {i}", *["again", None][: i % 3]]] + [(None, "no id", "en")],
                                 "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 4000, 40)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MARKS", marks)
    monkeypatch.setattr(toxicity, "SHARD", 16)
    plans, stage = [], toxicity.stage
    monkeypatch.setattr(toxicity, "stage", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, label))
    rows = toxicity.gather(docs, labels, None, "doc_id", "text", "lang", "toxic")
    known = {i: zlib.crc32(str(i).encode()) % 5 for i in range(0, 4000, 40)}
    want = {i: (i % 2, "again" if i % 3 else f"text {i}") for i, k in known.items() if k and i < 3000}
    got = rows.collect()
    assert {r.id: (r.label, r.text) for r in got} == want and len(got) == len(want) and {r.shard for r in got} <= set(range(6))
    assert plans[-1].count("Exchange hashpartitioning(id") == 1 and "SortMergeJoin" not in plans[-1]
    ids = spark.range(3000)
    kept = {r.id for r in toxicity.among(ids, spark.createDataFrame([(i,) for i in want], "id long")).collect()}
    assert set(want) <= kept and (marks == 64 or len(kept) < len(want) + 20)


def test_threshold_and_calibration_of_counted_rows():
    rng = np.random.default_rng(3)
    z, y, n = rng.normal(size=200).round(1), rng.integers(0, 2, 200), rng.integers(1, 9, 200)
    assert toxicity.best_threshold(z, y, n) == pytest.approx(toxicity.best_threshold(np.repeat(z, n), np.repeat(y, n)))
    assert quality.calibrate(z, y, n) == pytest.approx(quality.calibrate(np.repeat(z, n), np.repeat(y, n)))


def test_drop_toxic_keeps_columns(spark):
    table = odd_table(spark, "score string, toxic string")
    model = toxicity.fit(table, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.drop_toxic(table, model)
    assert out.columns == table.columns and out.count() == len(ODD)


# -- pieces -----------------------------------------------------------------------------------------------------------------------

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_are_lossless_and_reproducible(spark):
    table = odd_table(spark)
    made = pieces.encode(table, PIECES).cache()
    got = {r.doc_id: r for r in made.collect()}
    for i, t in enumerate(ODD):
        assert (got[i].pieces is None) == (t is None) and got[i].lossless is (None if t is None else True)
    assert {r.doc_id: r.text for r in pieces.decode(made, PIECES).collect()} == dict(enumerate(ODD))
    again = pieces.encode(table.repartition(3, "doc_id"), PIECES)
    assert {r.doc_id: r.pieces for r in again.collect()} == {i: r.pieces for i, r in got.items()}
    other = pieces.encode(table, PIECES, alpha=0.2, seed=2)
    assert {r.doc_id: r.pieces for r in other.collect()} != {i: r.pieces for i, r in got.items()}
    assert pieces.encode(table.limit(0), PIECES).count() == 0


def test_pieces_are_drawn_by_weight():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rank = {model.id_to_piece(i).replace("▁", " "): i for i in range(3, model.get_piece_size()) if not model.is_byte(i)}
    alpha = 0.3

    def paths(rest):
        if not rest:
            yield (), 1.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in rank:
                for tail, weight in paths(rest[n:]):
                    yield (rank[rest[:n]], *tail), weight * (rank[rest[:n]] + pieces.OFFSET) ** -alpha

    want = dict(paths(" then"))
    total, n, got = sum(want.values()), 40_000, Counter()
    sampler = pieces.Sampler(PIECES, alpha, 1)
    for chunk in W.chunks(pa.array(["then"] * n)):
        ids, first = sampler.encode(chunk, np.arange(chunk.rows.start, chunk.rows.stop, dtype=np.uint64))
        got.update(tuple(ids[first[k]: first[k + 1]].tolist()) for k in range(len(chunk.rows)))
    assert set(got) <= set(want)
    for path, weight in want.items():
        p = weight / total
        assert abs(got[path] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_texts_are_followed_no_further_than_some_piece_goes(monkeypatch):
    """All pieces that end at each place are found, with a few hashes looked up for each byte, not one for every length of a piece."""
    rng = np.random.default_rng(3)
    words = [" " + w for t in ODD if t for w in t.split(" ")] + [" " + "".join(chr(c) for c in rng.integers(97, 123, n)) for n in (1, 2, 30, 500, 2000)]
    words = [w.encode() for w in dict.fromkeys(words) if w != " "]
    sampler, asked = pieces.Sampler(PIECES, 1.0, 1), []
    find = pieces.Pieces.find
    monkeypatch.setattr(pieces.Pieces, "find", lambda self, hashes: asked.append(len(hashes)) or find(self, hashes))
    for chunk in W.chunks(pa.array([w[1:].decode() for w in words])):
        sampler.encode(chunk, np.arange(len(chunk.rows), dtype=np.uint64))
    assert sum(asked) < 8 * sum(map(len, words))

    p, lattices = sampler.pieces, sampler.lattices
    usable = {p.bytes[p.at[i]: p.at[i + 1]].tobytes(): i for i in p.ids[p.ids >= 0].tolist()}
    first, piece = [*lattices.edge_at.used.tolist(), lattices.share.size], lattices.piece.used.tolist()
    for w in (w for w in words if pieces.SPACE not in w and len(w) < 600):
        chunk = W.Chunk(range(0), np.frombuffer(w, np.uint8), np.zeros(1, np.int64))
        top = int(lattices.words.find(chunk.span(chunk.prefix(), np.array([0]), np.array([len(w)])))[0])
        for end in range(1, len(w) + 1):
            got = {i for i in piece[first[top + end]: first[top + end + 1]] if i not in set(p.byte_id.tolist())}
            assert got == {usable[w[s:end]] for s in range(end) if w[s:end] in usable}


# -- packing ----------------------------------------------------------------------------------------------------------------------

WORDS = public_tokenizers.path("word_bpe_49k.json")


def check_packing(out, capacity):
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_ids(spark):
    from tokenizers import Tokenizer

    table = odd_table(spark, "id string, uid string, length string")
    out = packing.pack(table, WORDS, capacity=64, with_ids=True).collect()
    check_packing(out, 64)
    tokenizer = Tokenizer.from_file(WORDS)
    for i, t in enumerate(ODD):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == want
        assert [(r.piece, r.start, r.length) for r in own] == [(k, k * 64, min(64, len(want) - k * 64)) for k in range(-(-len(want) // 64))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)


def test_packing_over_shards(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    repeated = docs.unionByName(docs.limit(5))
    monkeypatch.setattr(packing, "SHARD", 20)
    out = packing.pack(repeated, WORDS, capacity=512).collect()
    made = check_packing(out, 512)
    assert sum(r.piece == 0 for r in out) == repeated.count()
    assert made <= -(-sum(r.length for r in out) // 512) + 4
    assert packing.pack(docs.limit(0), WORDS).count() == 0


@pytest.mark.parametrize(("lengths", "best"), [([300, 212], 1500), ([300, 300], 3000), ([171, 170], 1000)])
def test_packing_of_matching_lengths_over_shards(spark, monkeypatch, lengths, best):
    """What one shard has too many of finds its match in another, however many sequences stay loose at first."""
    monkeypatch.setattr(packing, "SHARD", 100)
    made = spark.createDataFrame([(i, lengths[i % 2]) for i in range(3000)], "uid long, length long")
    out = packing.assign(made, 512).collect()
    assert len({r.uid for r in out}) == 3000 and best <= check_packing(out, 512) <= best + 6


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 90))
    lengths = rng.integers(1, capacity + 1, 300)
    sequence, offset = packing.best_fit(lengths, capacity)
    room = []  # of all sequences, looked through one by one
    want = np.zeros(len(lengths), int)
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
        least = min((r for r, _ in fits), default=None)
        k = int(sequence[i]) if least is not None else len(room)
        if least is None:
            room.append(capacity)
        assert k == sequence[i] and (least is None or room[k] == least) and offset[i] == capacity - room[k]
        want[i] = k
        room[k] -= lengths[i]
    assert (want == sequence).all()
