"""Plain forms of the operators, one row after another, for small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text, n):
    words = WORD.findall(lower(text or ""))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i: i + n]) for i in range(len(words) - n + 1))


def similar(sets, num, den):
    """Distinct sets, and the pairs of their numbers that are similar."""
    found = list(dict.fromkeys(s for s in sets if s))
    pairs = [(i, j) for i in range(len(found)) for j in range(i)
             if den * len(found[i] & found[j]) >= num * len(found[i] | found[j])]
    return found, pairs


def components(rows, n, num, den):
    """{id: (set size, component)} of rows (id, text)."""
    sets = [shingles(text, n) for _, text in rows]
    found, pairs = similar(sets, num, den)
    number = {s: i for i, s in enumerate(found)}
    root = list(range(len(found)))
    for _ in found:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    low = {}
    for (doc, _), s in zip(rows, sets):
        if s:
            r = root[number[s]]
            low[r] = min(doc, low.get(r, doc))
    return {doc: (len(s), low[root[number[s]]] if s else doc) for (doc, _), s in zip(rows, sets)}


def kept_lines(rows, n, num, den):
    """{id: text} without the lines that match an earlier one."""
    rows = sorted(rows)
    lines = [(doc, i, shingles(line, n)) for doc, text in rows if text is not None for i, line in enumerate(text.split("\n"))]
    found, pairs = similar([s for *_, s in lines], num, den)
    number = {s: i for i, s in enumerate(found)}
    first = {}
    for doc, i, s in lines:
        if s:
            first.setdefault(number[s], (doc, i))
    late = {max(pair, key=first.get) for pair in pairs}
    gone = defaultdict(set)
    for doc, i, s in lines:
        if s and (first[number[s]] != (doc, i) or number[s] in late):
            gone[doc].add(i)
    return {doc: None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[doc]) for doc, text in rows}


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i: i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i: i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)
