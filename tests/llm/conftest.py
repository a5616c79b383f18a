import random

import pytest


def variant(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return words


def make_rows(seed=5):
    """Copies, crowds of near copies, shared passages and lines, odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n\t ", "one", "one two", "One  TWO", "a b c", "A b C", "a b c d e", "été été"]
    crowd, passage = draw(120), " ".join(draw(60))
    texts += [" ".join(variant(rng, crowd, rng.choice([0, 0, 1, 1, 2, 3]))) for _ in range(60)]
    for _ in range(12):
        base = draw(rng.randrange(30, 90))
        texts += [" ".join(variant(rng, base, k)) for k in (0, 1, 2)]
    texts += [passage + "\n" + " ".join(draw(rng.randrange(3, 60))) for _ in range(25)]
    line = draw(25)
    texts += ["\n".join([" ".join(variant(rng, line, k % 3)), " ".join(draw(12)), "", passage]) for k in range(20)]
    texts.append(" ".join(draw(30_000)))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names operators might use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, token string, size string, slot string, id string, gone_id string"
    made = [(i, t, "en", "s", len(t or ""), "n", "t", "z", "s", "i", "g") for i, t in rows]
    return spark.createDataFrame(made, schema).repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
