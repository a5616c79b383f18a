"""Pseudonyms keep their format, their validity and their links."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortry.llm import pseudonyms as P

FOUND = {
    "email": (["a.99@mail8.example.com", "Jo_e+x@sub-1.example.org", "a@b.de"], r"[A-Za-z0-9._%+-]+@[\w.-]+"),
    "ip": (["61.131.143.218", "0.0.0.0", "255.255.255.255"], r"\d+(\.\d+){3}"),
    "card": (["4944339490429605", "4944-3394-9042-9605", "378282246310005", "4944 3394 9042 9605"], r"[\d -]+"),
    "iban": (["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"], r"[A-Z]{2}\d\d[A-Z0-9 ]+"),
    "ssn": (["123-45-6789", "899-99-9999", "001-01-0001"], r"\d{3}-\d\d-\d{4}"),
    "phone": (["+1 (386) 555-3733", "(212) 555-0199", "212-555-0199", "+49 30 901820", "+33 1 42 68 53 00"], r"[+\d() .-]+"),
    "date": (["1984-02-29", "29.02.1984", "12/31/1999", "1800-01-01", "2199-12-31"], r"[\d./-]+"),
}
LEFT = ["", "no data", "999.1.1.1", "1.2.3", "4944339490429606", "2023-02-30", "31.04.2020", "666-45-6789", "000-12-3456", "DE88370400440532013000",
        "2.0. 3. 4.0.", "a@b", "12345", "3000-01-01", "1.2.3.4.5"]


def luhn(text):
    digits = [int(c) for c in re.sub(r"\D", "", text)][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def iban(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def shape(text):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", text)))


def run(spark, texts, key="k", **more):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in P.pseudonymize(table, key, **more).collect()}


def test_formats(spark):
    texts = [t for many, _ in FOUND.values() for t in many]
    got = run(spark, [f"({t}), then {t}." for t in texts], count_col="n")
    for i, text in enumerate(texts):
        kind = next(k for k, (many, _) in FOUND.items() if text in many)
        new = got[i].text[1:-1].split("), then ")
        assert new[0] == new[1] != text and got[i].n == 2, text
        assert re.fullmatch(FOUND[kind][1], new[0])
        if kind in ("email", "ssn", "date", "phone"):
            assert shape(new[0]) == shape(text)
        if kind == "card":
            assert luhn(new[0]) and shape(new[0]) == shape(text) and new[0][0] == text[0]
        if kind == "iban":
            assert iban(new[0]) and shape(new[0])[4:] == shape(text)[4:]
        if kind == "ip":
            assert all(int(o) < 256 for o in new[0].split("."))
    digits = lambda s: re.sub(r"\D", "", s)
    assert len({digits(got[texts.index(t)].text) for t in FOUND["card"][0] if digits(t) == "4944339490429605"}) == 1


def test_left_alone(spark):
    got = run(spark, [*LEFT, None], count_col="n")
    assert [got[i].text for i in range(len(LEFT) + 1)] == [*LEFT, None]
    assert all(r.n == 0 for r in got.values())


CARDS = ["4111111111111111", "4111 1111 1111 1111", "3782 822463 10005", "4944-3394-9042-9605"]
IBANS = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"]


def test_neighbours(spark):
    """What stands beside a card or an IBAN changes neither that it is found nor its pseudonym."""
    around = ["{} 123", "{} 3 items", "3 {}", "12 {} 99", "{} 2024", "{}-7", "1234 {}", "AB12 {}", "{} 20 25 30 35 40"]
    many = [(c, a) for c in CARDS for a in around]
    spaced = ["{} BIC COBADEFF", "{} USD", "{} 12", "{} EUR 100", "AB12 {}", "IBAN {} 4", "BIC COBADEFF {} A"]
    many += [(c, a) for c in IBANS for a in spaced]
    many += [(c, a) for c in CARDS + IBANS for a in ("{}", "{} 61.131.143.218")]
    got = run(spark, [a.format(c) for c, a in many])
    alone = {c: got[i].text for i, (c, a) in enumerate(many) if a == "{}"}
    ip = run(spark, ["61.131.143.218"])[0].text
    assert all(new != old for old, new in alone.items()) and all(luhn(alone[c]) for c in CARDS) and all(iban(alone[c]) for c in IBANS)
    wrong = [(a.format(c), got[i].text) for i, (c, a) in enumerate(many) if got[i].text != a.format(alone[c]).replace("61.131.143.218", ip)]
    assert not wrong


def test_several_in_a_run(spark):
    texts = [" ".join(CARDS), " ".join(IBANS), "4111111111111111 2024-01-15 123-45-6789 212-555-0199", "DE89370400440532013000 4111 1111 1111 1111 212-555-0199", *CARDS, *IBANS,
             "2024-01-15", "123-45-6789", "212-555-0199", "1 2 " * 3000, "7" * 100_000]
    got = [r.text for _, r in sorted(run(spark, texts).items())]
    cards, ibans, (date, ssn, phone) = got[4:8], got[8:11], got[11:14]
    assert got[0] == " ".join(cards) and got[1] == " ".join(ibans) and got[14:] == texts[14:]
    assert got[2] == f"{cards[0]} {date} {ssn} {phone}" and got[3] == f"{ibans[0]} {cards[1]} {phone}"


PHONES = ["+1 (017) 555-7713", "(017) 555-7713", "+1 (136) 155-7479", "212-155-0199", "+7 (495) 123-45-67", "+49 (0)30 901820", "030 901820-12", "(030) 901 82 01",
          "030/9018201", "0171 1234567", "01701234567", "01 42 68 53 00", "01.42.68.53.00", "0142685300", "0049 30 901820", "912 345 678", "612 34 56 78",
          "91 234 56 78", "+34 912 345 678", "020 7946 0018"]


def test_phones_by_notation(spark):
    got = run(spark, [f"call {t}, or {t}." for t in PHONES], count_col="n")
    for i, text in enumerate(PHONES):
        new = got[i].text[5:-1].split(", or ")
        assert new[0] == new[1] != text and got[i].n == 2 and shape(new[0]) == shape(text), (text, got[i].text)
    assert got[0].text[5:].startswith("+1 (0") and got[0].text[8:].startswith(got[1].text[5:19])  # linked, and outside of the usual ranges
    cards = run(spark, ["+49 30 901820 4111 1111 1111 1111", "030 901820 4111111111111111", "4111 1111 1111 1111", "4111111111111111", "0 1 2 3 4 5 6 7 8 9", "0.123456789 08:30 012"])
    assert cards[0].text.endswith(" " + cards[2].text) and cards[1].text.endswith(" " + cards[3].text)
    assert [cards[4].text, cards[5].text] == ["0 1 2 3 4 5 6 7 8 9", "0.123456789 08:30 012"]


def test_phones_are_permuted(spark):
    table = spark.range(0, 1000).select(F.format_string("(0%02d) 155-%04d", F.col("id") % 100, F.col("id")).alias("t"))
    out = {r.o for r in table.select(P.phone(F.col("t"), "k").alias("o")).collect()}
    assert len(out) == 1000 and all(re.fullmatch(r"\(0\d\d\) 1\d\d-\d{4}", t) for t in out)


def test_places_in_the_text(spark):
    texts = ["61.131.143.218", "a 61.131.143.218", "61.131.143.218 b", "x\n61.131.143.218\n61.131.143.218\n", "y" * 100_000 + " 61.131.143.218"]
    got = run(spark, texts)
    new = got[0].text
    assert [got[i].text for i in range(5)] == [t.replace("61.131.143.218", new) for t in texts]
    assert run(spark, texts, key="other")[0].text != new


@pytest.mark.parametrize(("a", "b"), [(7, 5), (16, 16), (1, 9)])
def test_feistel_permutes(spark, a, b):
    pairs = spark.range(a * b).select((F.col("id") % a).alias("l"), F.floor(F.col("id") / a).alias("r"))
    out = pairs.select(P.feistel(F.col("l"), F.col("r"), a, b, "k", "t").alias("o")).collect()
    assert {(r.o.l, r.o.r) for r in out} == {(i, j) for i in range(a) for j in range(b)}


def test_strings_are_permuted(spark):
    table = spark.range(2600).select(F.concat(F.chr(97 + F.col("id") % 26), F.lit("-"), F.lpad(F.floor(F.col("id") / 26).cast("string"), 2, "0")).alias("t"))
    out = {r.o for r in table.select(P.within_alphabet(F.col("t"), "k", "t").alias("o")).collect()}
    assert len(out) == 2600 and all(re.fullmatch(r"[a-z]-\d\d", t) for t in out)


def test_dates_are_permuted(spark):
    days = spark.range(0, 146097, 37).select(F.date_format(F.date_from_unix_date((F.col("id") + P.FIRST_DAY).cast("int")), "yyyy-MM-dd").alias("d"))
    out = [r.o for r in days.select(P.date(F.col("d"), "k").alias("o")).collect()]
    assert len(set(out)) == len(out) and all(re.fullmatch(r"\d{4}-\d\d-\d\d", d) and "1800" <= d[:4] <= "2199" for d in out)


def test_columns_and_no_rows(spark):
    table = spark.createDataFrame([(1, "61.131.143.218", "x", "y")], "doc_id long, text string, found string, l string")
    out = P.pseudonymize(table, "k")
    assert out.columns == table.columns and out.first().found == "x"
    assert P.pseudonymize(table.limit(0), "k").count() == 0


def test_values_stay_linked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, P.pseudonymize(docs, "k")))
    pattern, names = re.compile(FOUND["email"][1] + r"\.com"), defaultdict(set)
    for i, text in before.items():
        old, new = pattern.findall(text), pattern.findall(after[i])
        assert len(old) == len(new) and not set(old) & set(new)
        for a, b in zip(old, new):
            names[a].add(b)
    assert names and all(len(v) == 1 for v in names.values()) and len({min(v) for v in names.values()}) == len(names)


def test_long_and_repetitive_texts(spark):
    """Java's matcher goes deeper with each turn of a repeated group; none may go deeper with the text."""
    n = 100_000
    texts = ["a@" + "b." * 2000 + "com", "a@" + "b." * n + "com", "a@" + "bc." * n, "x@" * n, "a" * n + "@b.de", "1 " * n, "123 " * n, "1234-" * n, "12" * n, "+1 " * n,
             "(0" * n, "0 1" * n, "1.2.3.4 " * 2000, "DE89 " * n, "DE89" + "A1" * n, "A" * n, "1984-02-29 " * 2000, "- " * n]
    rows = run(spark, texts)
    assert [len(rows[i].text) for i in range(len(texts)) if i != 12] == [len(t) for i, t in enumerate(texts) if i != 12]  # addresses change their length
    for i in (12, 16):
        assert len(set(rows[i].text.split())) == 1 and rows[i].text != texts[i]
