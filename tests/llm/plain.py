"""Plain versions of the operators, for small inputs, and awkward rows that all of them get."""

import re
from collections import Counter, defaultdict

NULL_ID = -(2**63)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: nulls, empty texts, ties, repeated rows, a long text, a text in one word
AWKWARD = [
    (1, "One two three four five six seven eight.", "en", "a", 40), (2, None, None, None, None), (3, "", "en", "a", 0),
    (None, "No id on this row, but a text of some words.", "en", "a", 44), (4, " \n\t ", "en", "b", 4),
    (5, "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT.", "en", "a", 40), (5, "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT.", "en", "a", 40),
    (6, "x" * 5000, "xx", "b", 5000), (7, "été à la plage " * 700, "fr", "b", 10500), (8, "\x00 odd \u2028 bytes \U0001f600 here now", "xx", "c", 20),
]


def shingles(text, width=5):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < width else frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def join_components(rows, percent=75):
    """(doc_id, shingles, smallest doc_id of its component) of (doc_id, text) rows with distinct ids."""
    sets, parent = [(d, shingles(t)) for d, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in where[g]:
                shared[j] += 1
            where[g].append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j][1]) - k):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        members[find(i)].append(d)
    return sorted((d, len(s), min(members[find(i)])) for i, (d, s) in enumerate(sets))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _near(a, b, edits):
    """Edit distance at most ``edits``; counts of characters rule most pairs out."""
    (x, cx), (y, cy) = a, b
    if abs(len(x) - len(y)) > edits or sum(((cx - cy) | (cy - cx)).values()) > 2 * edits:
        return False
    return edit_distance(x, y) <= edits


def lines_that_go(rows, edits, min_chars, equal_chars=None):
    """{doc_id: line numbers}; null ids under NULL_ID. Lines of ``min_chars`` code points go if they are
    near an earlier one, shorter ones of ``equal_chars`` that are not blank if they equal one."""
    least = min_chars if equal_chars is None else equal_chars
    places = sorted(((NULL_ID if d is None else d, i, line) for d, t in rows for i, line in enumerate((t or "").split("\n"))
                     if len(line) >= min_chars or len(line) >= least and line.strip()), key=lambda x: x[:2])
    seen, out = defaultdict(list), {}
    known = set()
    for d, i, line in places:
        own = (line, Counter(line))
        long = len(line) >= min_chars
        if line in known or long and any(_near(own, x, edits) for n in range(len(line) - edits, len(line) + edits + 1) for x in seen[n]):
            out.setdefault(d, []).append(i)
        if line not in known:
            known.add(line)
            if long:
                seen[len(line)].append(own)
    return out


def without_repeats(rows, length):
    """(doc_id, bytes, removed, runs, kept bytes) of (doc_id, text) rows."""
    first, out = set(), []
    for d, t in sorted(set(rows), key=lambda r: NULL_ID if r[0] is None else r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            window = b[s:s + length]
            if window in first:
                gone[s:s + length] = b"\1" * length
            first.add(window)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out
