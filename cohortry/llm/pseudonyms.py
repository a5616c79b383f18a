"""Pseudonyms for personal data in the format of the data, with DataFrame functions alone.

Found are mail addresses, IPv4 addresses, payment card numbers, IBANs, social security numbers, telephone numbers and calendar dates.
What has a rule is validated: card numbers by their check digit, IBANs by their remainder, octets, areas and dates by their range;
what fails is left as it is. Card numbers and IBANs are looked for among the numbers and capitals that stand beside them: an IBAN ends at the
length of its country, and of a run of digits those blocks that pass are a card, first single blocks, then usual groups (16 digits before
others), then other groups of three digits or more, or the whole run. Telephone
numbers are found by notation, whatever their digits: North American ones with an area, with a plus, with a trunk or dialling zero (nine
digits or more), and Spanish ones in groups; local numbers without an area stay. A value is enciphered by a keyed Feistel network over exactly the values of its format, so a
pseudonym is a valid value of the same format, different values get different pseudonyms, and equal values get the same one in every
document. Spaces and marks between digits stay where they are.

==========  ==================================================================================================================
kind        permuted
==========  ==================================================================================================================
email       letters and digits of the local part and of the first label of the domain, each within its alphabet
ip          the 32 bits of the address, as two halves
card        the digits between the first and the check digit, which is set anew
iban        the digits and letters of the account, each within its alphabet; check digits are set anew
ssn         area (of 898) and the rest (of 99 x 9999)
phone       North American: area (of 800) and number (of 8,000,000), outside these ranges all digits but the first of area and of
            exchange; others: all digits after the first two
date        days from 1800-01-01 to 2199-12-31, 146,097 = 189 x 773 of them, kept in their notation
==========  ==================================================================================================================

Null text stays null; empty text stays empty; text without such data comes back unchanged. All columns of the input are kept, whatever
their names, but for the text, which is replaced. Rows are changed one by one, so repeated rows give equal rows. The key is a parameter;
whoever has it can undo a pseudonym.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Key of the registered queries; users bring their own.
SAMPLE_KEY = "key of the registered queries"
#: A host name has 127 labels at most; Java's matcher goes deeper with every turn of a repeated group, so none is without bound.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d]|[/.-]\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"
#: Digits in groups as cards have them.
CARD_GROUPS = r"\d{4}(?: \d{4}){3}(?: \d{3})?|\d{4}(?:-\d{4}){3}(?:-\d{3})?|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5}"
_NOT_CARD = rf"(?!\d{{13,19}}(?!\w)|(?:{CARD_GROUPS})(?!\w))"
#: American numbers, of any digits; those with a plus; those with a trunk or dialling zero; Spanish ones, of nine digits from 6 to 9.
PHONE = "|".join((
    r"(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    rf"(?<![\w+])\+[1-9](?:(?:[ ./()-]{{1,3}}{_NOT_CARD})?\d){{7,14}}(?!\w)",
    rf"(?<![\w.,+/-])\(0\d{{1,5}}\)(?:(?:[ ./-]{{1,2}}{_NOT_CARD})?\d){{5,12}}(?!\w|[.,/-]\d)",
    rf"(?<![\w.,+/-])0\d(?=[ ./()\d-]{{0,8}}[ ./()-])(?:(?:[ ./()-]{{1,2}}{_NOT_CARD})?\d){{7,13}}(?!\w|[.,/-]\d)",
    r"(?<![\w.,+/-])0[1-9]\d{8,10}(?!\w|[.,/-]\d)",
    r"(?<![\w.,+/-])(?:[6-9]\d{2}[ -]\d{3}[ -]\d{3}|[6-9]\d{2}(?:[ -]\d{2}){3}|9\d[ -]\d{3}(?:[ -]\d{2}){2})(?!\w|[ .,/-]\d)"))
#: Runs of digits, spaces and marks that may hold cards and other kinds. A class of characters,
#: so that long runs don't deepen the stack.
CARD = r"(?<![\w.-])\d[\d -]{11,}\d(?!\w|\.\d|[A-Za-z0-9._%+-]*@)"
WITHIN = f"{DATE}|{SSN}|{PHONE}"
#: Lengths of IBANs by country.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
                22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
                26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
                31: "MT SC", 32: "LC", 33: "RU"}


def _ibans(gap: str) -> str:
    return "|".join(rf"(?:{'|'.join(names.split())})\d{{2}}(?:{gap}[A-Z0-9]){{{n - 4}}}(?!\w)" for n, names in IBAN_LENGTHS.items())


_STOP = rf"(?!{WITHIN}|\d{{13,19}}(?!\w)|{_ibans(' ?')})"
IBAN = rf"(?<!\w)(?:{_ibans(f'(?: {_STOP})?')}|[A-Z]{{2}}\d{{2}}(?:(?: {_STOP})?[A-Z0-9]){{11,30}}(?!\w))"
FOUND = "|".join((EMAIL, IP, DATE, SSN, PHONE, IBAN, CARD))
#: Every kind has one of these characters; the rest of the texts is passed by without a search.
HINT = r"[0-9@]"
LETTERS, CAPITALS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Days before 1970 of the first day of the calendar cycle, and its length in two factors.
FIRST_DAY, DAY_FACTORS = -62091, (189, 773)


def number(text: Column) -> Column:
    return text.cast("long")


def keyed(key: str, tweak: str, i: Column, value: Column) -> Column:
    """64 hex digits that depend on key, format, round and value."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), value.cast("string"), F.lit(key)), 256)


def feistel(left: Column, right: Column, of_left: int, of_right: int, key: str, tweak: str) -> Column:
    """A permutation of the pairs below (of_left, of_right), as a struct (l, r)."""

    def one_round(s: Column, i: Column) -> Column:
        drawn = F.conv(F.substring(keyed(key, tweak, i, s["r"]), 1, 15), 16, 10).cast("long")
        modulus = F.when(i % 2 == 0, F.lit(of_left)).otherwise(F.lit(of_right)).cast("long")
        return F.struct(s["r"].alias("l"), ((s["l"] + drawn) % modulus).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one_round)


def shifted(text: Column, stream: Column) -> Column:
    """Each digit and letter moved within its alphabet by the hex pair of its place; other characters stay."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(stream, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for alphabet in ("0123456789", LETTERS, CAPITALS):
            n = len(alphabet)
            at = F.instr(F.lit(alphabet), c)
            out = F.when((at > 0) & (c != ""), F.substr(F.lit(alphabet), (at - 1 + by) % n + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), move), "")


def within_alphabet(text: Column, key: str, tweak: str) -> Column:
    """A permutation of the strings with the classes of characters that ``text`` has, by a Feistel network on its halves."""

    def one_round(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), shifted(s["l"], keyed(key, tweak, i, s["r"])).alias("r"))

    half = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one_round)
    return F.concat(done["l"], done["r"])


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refill(shape: Column, digits: Column, skip: Column | int = 0) -> Column:
    """``shape`` with its digits, after ``skip`` of them, replaced in order by ``digits``."""
    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike(r"^\d$")
        n = s["n"] + F.when(is_digit, 1).otherwise(0)
        put = F.when(is_digit & (n > skip), F.substr(digits, n - skip, F.lit(1))).otherwise(c)
        return F.struct(n.alias("n"), F.concat(s["t"], put).alias("t"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("t")), step)["t"]


def luhn_sum(digits: Column) -> Column:
    """Sum of the check rule over digits that stand before the check digit."""
    def step(s: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(s["double"], 2).otherwise(1)
        return F.struct((s["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"), (~s["double"]).alias("double"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("double"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, step)["sum"]


def check_digit(digits: Column) -> Column:
    return ((F.lit(10) - luhn_sum(digits) % 10) % 10).cast("string")


def remainder_97(text: Column) -> Column:
    """Remainder of an IBAN, its first four characters moved to the end and letters read as 10 to 35."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))

    def step(s: Column, c: Column) -> Column:
        letter = F.instr(F.lit(CAPITALS), c)
        return F.when(letter > 0, (s * 100 + letter + 9) % 97).otherwise((s * 10 + c.cast("int")) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0).cast("int"), step)


def email(found: Column, key: str) -> Column:
    parts = F.split(found, "@")
    domain = parts[1]
    first = F.substring_index(domain, ".", 1)
    return F.concat(within_alphabet(parts[0], key, "email"), F.lit("@"), within_alphabet(first, key, "host"), F.substr(domain, F.length(first) + 1))


def ip(found: Column, key: str) -> Column:
    octets = F.transform(F.split(found, r"\."), number)
    out = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, key, "ip")
    l, r = out["l"], out["r"]
    made = F.concat_ws(".", F.shiftright(l, 8), l % 256, F.shiftright(r, 8), r % 256)
    return F.when(F.forall(octets, lambda o: o <= 255), made).otherwise(found)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def card(found: Column, key: str) -> Column:
    """The pseudonym of a valid card number with or without marks."""
    def of_digits(digits: Column) -> Column:
        new = F.concat(F.substr(digits, F.lit(1), F.lit(1)), within_alphabet(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card"))
        return let(new, lambda n: refill(found, F.concat(n, check_digit(n))))

    return let(digits_of(found), of_digits)


def luhn_valid(found: Column) -> Column:
    return let(digits_of(found), lambda digits: check_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.substr(digits, F.length(digits)))


def runs(found: Column, key: str) -> Column:
    """Dates, security and telephone numbers of a found string and the card numbers beside them, replaced; the rest stays."""
    def between(run: Column) -> Column:
        # blocks of digits and what stands between them
        scanned = let(F.regexp_extract_all(run, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda parts: _cards(run, parts, key))
        return F.when(F.length(digits_of(run)) < 13, run).otherwise(scanned)

    def other(found: Column) -> Column:
        return F.when(found.rlike(rf"^(?:{DATE})$"), date(found, key)).when(found.rlike(rf"^(?:{SSN})$"), ssn(found, key)).otherwise(phone(found, key))

    return _replaced(found, WITHIN, other, between)[1]


def _cards(run: Column, parts: Column, key: str) -> Column:
    first = F.when(F.element_at(parts, 1).rlike(r"^\d"), 1).otherwise(2)

    def of_block(at: Column) -> Column:
        # seven blocks at most: six of three digits and one of one
        ends = F.sequence(at, F.least(at + 12, F.size(parts)), F.lit(2))
        return F.transform(ends, lambda end: F.struct(at.alias("at"), end.alias("end"), F.array_join(F.slice(parts, at, end - at + 1), "").alias("text")))

    def ranked(c: Column) -> Column:
        n = F.length(digits_of(c["text"]))
        joined = (c["at"] > 1) & F.element_at(parts, F.greatest(c["at"] - 1, F.lit(1))).rlike("[A-Za-z]$")
        kind = (F.when(joined, F.lit(None).cast("int")).when(c["text"].rlike(r"^\d+$"), 0).when(c["text"].rlike(rf"^(?:{CARD_GROUPS})$"), 1)
                .when(c["text"].rlike(r"^\d[\d -]*\d$") & c["text"].rlike("[ -]") & ~c["text"].rlike(r"[ -]{2}|(?<!\d)\d{1,2}[ -]") | (c["text"] == F.trim(run)) & ~c["text"].rlike(r"[^\d -]|[ -]{2}"), 2))
        return F.struct(F.when((n >= 13) & (n <= 19), kind).alias("kind"), F.when(n <= 16, 16 - n).otherwise(n).alias("far"), c["at"].alias("at"),
                        c["end"].alias("end"), c["text"].alias("text"))

    last = F.size(parts) - F.when(F.element_at(parts, -1).rlike(r"^\d"), 0).otherwise(1)
    whole = F.struct(first.alias("at"), last.alias("end"), F.array_join(F.slice(parts, first, last - first + 1), "").alias("text"))
    tried = F.concat(F.flatten(F.transform(F.sequence(first, last, F.lit(2)), of_block)), F.array(whole))
    good = F.filter(F.transform(tried, ranked), lambda c: c["kind"].isNotNull() & luhn_valid(c["text"]))

    def take(taken: Column, c: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["at"] <= c["end"]) & (c["at"] <= t["end"]))
        return F.when(free, F.concat(taken, F.array(c))).otherwise(taken)

    def put(taken: Column) -> Column:
        def part(text: Column, i: Column) -> Column:
            mine = F.filter(taken, lambda t: (t["at"] <= i + 1) & (i + 1 <= t["end"]))
            return F.when(F.size(mine) == 0, text).when(mine[0]["at"] == i + 1, card(mine[0]["text"], key)).otherwise(F.lit(""))

        return F.array_join(F.transform(parts, part), "")

    return let(F.array_sort(good), lambda ranks: let(F.aggregate(ranks, F.slice(ranks, 1, 0), take), lambda taken: F.when(F.size(taken) > 0, put(taken)).otherwise(run)))


def valid_iban(found: Column) -> Column:
    """The IBAN at the beginning of ``found``, which goes further if its country isn't known; null if there is none."""
    # places where a block ends, the last one first
    size = F.length(found)
    ends = F.filter(F.sequence(size, F.least(size, F.lit(15)), F.lit(-1)), lambda n: F.substr(found, n, F.lit(2)).rlike("^[A-Z0-9](?: |$)"))
    known = found.rlike(rf"^(?:{_ibans(' ?')})$")
    plain = F.transform(ends, lambda n: F.struct(F.substr(found, F.lit(1), n).alias("t"), F.replace(F.substr(found, F.lit(1), n), F.lit(" "), F.lit("")).alias("p")))
    valid = F.filter(plain, lambda c: (~known | (c["t"] == found)) & (F.length(c["p"]) >= 15) & (remainder_97(c["p"]) == 1))
    return F.when(found.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), F.get(valid, F.lit(0))["t"])


def iban(found: Column, key: str) -> Column:
    plain = F.replace(found, F.lit(" "), F.lit(""))
    account = within_alphabet(F.substr(plain, F.lit(5)), key, "iban")
    country = F.substr(plain, F.lit(1), F.lit(2))
    check = F.lpad((98 - remainder_97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    new = F.concat(country, check, account)

    def step(s: Column, c: Column) -> Column:
        n = s["n"] + F.when(c == " ", 0).otherwise(1)
        return F.struct(n.alias("n"), F.concat(s["t"], F.when(c == " ", c).otherwise(F.substr(new, n, F.lit(1)))).alias("t"))

    return F.aggregate(F.split(found, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("t")), step)["t"]


def ssn(found: Column, key: str) -> Column:
    area, group, serial = (number(F.substr(found, F.lit(at), F.lit(n))) for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    out = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    area = out["l"] + F.when(out["l"] >= 665, 2).otherwise(1)
    group, serial = F.floor(out["r"] / 9999) + 1, out["r"] % 9999 + 1
    made = F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (group, 2), (serial, 4))))
    return F.when(valid, made).otherwise(found)


def phone(found: Column, key: str) -> Column:
    """Area and number of an American one within their ranges; of one outside them all but the first digits of both, so that it stays
    outside; of others all digits after the first two."""
    def of_digits(digits: Column) -> Column:
        n = F.length(digits)
        ten = F.substr(digits, F.greatest(n - 9, F.lit(1)))
        notation = found.rlike(r"^(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$")
        out = feistel(number(F.substr(ten, F.lit(1), F.lit(3))) - 200, number(F.substr(ten, F.lit(4))) - 2_000_000, 800, 8_000_000, key, "phone")
        inside = let(out, lambda o: F.concat((o["l"] + 200).cast("string"), (o["r"] + 2_000_000).cast("string")))
        first, fourth = F.substr(ten, F.lit(1), F.lit(1)), F.substr(ten, F.lit(4), F.lit(1))
        rest = F.when(notation, F.concat(F.substr(ten, F.lit(2), F.lit(2)), F.substr(ten, F.lit(5)))).otherwise(F.substr(digits, F.lit(3)))
        moved = let(within_alphabet(rest, key, "abroad"), lambda r: F.when(
            notation, F.concat(first, F.substr(r, F.lit(1), F.lit(2)), fourth, F.substr(r, F.lit(3)))).otherwise(r))
        new = F.when(notation & ten.rlike(r"^[2-9]\d{2}[2-9]"), inside).otherwise(moved)
        return refill(found, new, F.when(notation, n - 10).otherwise(2))

    return let(digits_of(found), of_digits)


def date(found: Column, key: str) -> Column:
    notation = F.when(found.rlike("^.{4}-"), "yyyy-MM-dd").when(F.instr(found, "/") > 0, "MM/dd/yyyy").otherwise("dd.MM.yyyy")
    year, month, day = (F.when(F.instr(found, "-") > 0, F.substr(found, F.lit(a), F.lit(n)))
                        .when(F.instr(found, "/") > 0, F.substr(found, F.lit(b), F.lit(n))).otherwise(F.substr(found, F.lit(c), F.lit(n)))
                        for a, b, c, n in ((1, 7, 7, 4), (6, 1, 4, 2), (9, 4, 1, 2)))
    a, b = DAY_FACTORS
    days = F.datediff(F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date"), F.lit("1970-01-01").cast("date"))
    at = days - FIRST_DAY
    out = feistel(F.floor(at / b), at % b, a, b, key, "date")
    made = F.date_from_unix_date((out["l"] * b + out["r"] + FIRST_DAY).cast("int"))
    y, m, d = (F.lpad(f(made).cast("string"), n, "0") for f, n in ((F.year, 4), (F.month, 2), (F.day, 2)))
    text = F.when(notation == "yyyy-MM-dd", F.concat_ws("-", y, m, d)).when(notation == "MM/dd/yyyy", F.concat_ws("/", m, d, y)).otherwise(F.concat_ws(".", d, m, y))
    return F.when(days.isNotNull() & (at >= 0) & (at < a * b), text).otherwise(found)


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one found string, itself if it isn't valid."""
    behind_iban = let(valid_iban(found), lambda v: F.when(v.isNotNull(), F.concat(iban(v, key), F.substr(found, F.length(v) + 1))).otherwise(runs(found, key)))
    return F.when(F.instr(found, "@") > 0, email(found, key)).when(found.rlike(rf"^(?:{IP})$"), ip(found, key)).otherwise(behind_iban)


def _replaced(text: Column, pattern: str, make: Callable[[Column], Column], between: Callable[[Column], Column] | None = None) -> tuple[Column, Column]:
    """Strings of ``pattern`` in ``text``, and the text with ``make`` of them, and ``between`` of what stands between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    around = F.split(text, pattern, -1)
    made = F.transform(found, make)
    if between:
        around = F.transform(around, between)
    return found, F.array_join(F.flatten(F.zip_with(around, made, lambda a, m: F.array(a, F.coalesce(m, F.lit(""))))), "")


def replaced(text: Column, key: str) -> tuple[Column, Column]:
    """Strings found in ``text``, and the text with their pseudonyms."""
    return _replaced(text, FOUND, lambda f: pseudonym(f, key))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in its text; ``count_col`` names a column for the number of replaced values, if wanted."""
    text = F.col(text_col)
    found, new = replaced(text, key)
    hint = text.rlike(HINT)
    out = {text_col: F.when(hint, new).otherwise(text)}
    if count_col:
        # values that are left as they are do not count
        changed = F.size(F.filter(found, lambda f: pseudonym(f, key) != f))
        out[count_col] = F.coalesce(F.when(hint, changed), F.lit(0)).cast("long")
    return docs.withColumns(out)
