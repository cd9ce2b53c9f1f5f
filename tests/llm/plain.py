"""Plain versions of what the operators compute, for small tables."""

import re

import pyarrow.parquet as pq

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def hits(text, items, window=10):
    """(number of words, hit positions, names of items found) by comparing every window."""
    own, hit, names = words(text), set(), set()
    for name, body in items:
        item = words(body)
        size = min(window, len(item))
        windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if size else ()
        for i in range(len(own) - size + 1):
            if size and tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
                names.add(name)
    return len(own), hit, names


def without_hits(text, items):
    """The text without hit spans; None if more than 80 % of its words are hit."""
    n, hit, _ = hits(text, items)
    if len(hit) > 0.8 * n:
        return None
    places = [m.span() for m in WORD.finditer((text or "").translate(UPPER))]
    out, at, i = [], 0, 0
    while i < n:
        if i in hit:
            end = i
            while end in hit:
                end += 1
            out.append(text[at : places[i][0]])
            at, i = places[end - 1][1], end
        else:
            i += 1
    return text if at == 0 else "".join(out) + text[at:]


BLANK = " \t\x0b\x0c\r"


def without_boilerplate(docs, ratio=0.05, least=5):
    """Texts without the lines on too many documents of their source."""
    totals, pages = {}, {}
    for d in docs:
        totals[d["source"]] = totals.get(d["source"], 0) + 1
        for bare in {x.strip(BLANK) for x in (d["text"] or "").split("\n")} - {""}:
            pages[d["source"], bare] = pages.get((d["source"], bare), 0) + 1
    out = []
    for d in docs:
        def stays(line):
            n = pages.get((d["source"], line.strip(BLANK)), 0)
            return d["source"] is None or n < least or n <= ratio * totals[d["source"]]

        out.append(None if d["text"] is None else "\n".join(x for x in d["text"].split("\n") if stays(x)))
    return out


def grams(text, n):
    own = (text or "").encode().lower().split()
    if len(own) < n:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}


def linked(docs, n=3, percent=90):
    """(id, text), ids distinct: {id: (size of its set, least id it is linked with)}."""
    sets = {i: grams(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(x), find(y)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}
