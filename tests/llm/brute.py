"""Plain versions of the operators, one document at a time."""

import re

import regex

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPLIT.findall(text or "")


def shingles(text, k=4):
    w = words((text or "").translate(UPPER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(docs):
    """{doc_id: least id reachable} by comparing all pairs of rows."""
    rows = [(i, shingles(t)) for i, t in docs if i is not None]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def base_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return [len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)]


# ---- benchmark passages, one text against one item


def template(text, rules):
    """[(template word, slot value or None)] of a text."""
    out = (text or "").translate({1: " ", 2: " ", 3: " "})
    for pattern, _, mark in rules:
        out = regex.sub(pattern.replace("\\x{2}", "\\x02"), mark.replace("$0", r"\g<0>").replace("$1", r"\1").replace("$2", r"\2").replace("$3", r"\3"), out)
    found = []
    for m in regex.finditer("([\x01\x02])([^\x03]*)\x03|[\\p{L}\\p{M}\\p{N}]+", out):
        if m[1]:
            kind = "name" if m[1] == "\x01" else "unit" if m[2].startswith("=") else "number"
            found.append((kind, m[1] + m[2].lower()))
        else:
            found.append((m[0].lower(), None))
    return [("\x00" + w if v else w, v) for w, v in found]


def holds(text, item, variants, width=8, coverage=60, run=13):
    """Whether a text holds an item, by every alignment of every template."""
    doc = template(text, variants[0])
    for rules in variants:
        it = template(item, rules)
        n = min(width, len(it))
        if not n:
            continue
        covered_by_all = set()
        for shift in range(-len(it), len(doc)):
            same = [0 <= p + shift < len(doc) and doc[p + shift][0] == it[p][0] for p in range(len(it))]
            covered = sorted({q for p in range(len(it) - n + 1) if all(same[p : p + n]) for q in range(p, p + n)})
            values = {(it[p][1], doc[p + shift][1]) for p in covered if it[p][1]}
            if not covered or len({a for a, _ in values}) < len(values):
                continue
            covered_by_all |= set(covered)
            for p in covered:
                stretch = range(p, p + run)
                while stretch[-1] in covered and set(stretch) <= set(covered):
                    if sum(it[q][1] is None for q in stretch) * 2 >= len(stretch):
                        return True
                    stretch = range(p, stretch[-1] + 2)
        if 100 * len(covered_by_all) >= coverage * len(it):
            return True
    return False
