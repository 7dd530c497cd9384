"""A small table with everything that may be odd about documents, and brute-force versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, t string, n int, slot string, row string, spans string, score int, component string, label int, _text string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Stands for null ids, which the operators put below all others.
NO_ID = -(1 << 63)


def texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    fresh = lambda n: [rng.choice(words) + rng.choice("xyz") * rng.randint(0, 3) for _ in range(n)]
    base, passage = fresh(160), fresh(64)
    out: list[str | None] = [None, None, "", "   \n\t ", "One", "one", "two words", "Two  WORDS", "été Über", "?!", "\U0001f642"]
    out += [" ".join(base)] * 3 + [" ".join(base).upper()]
    for k in range(12):  # near copies
        copy = list(base)
        for _ in range(k % 6):
            copy[rng.randrange(len(copy))] = "changed" + str(k)
        out.append(" ".join(copy))
    for k in range(10):  # a shared passage between other words
        out.append(" ".join([*fresh(20 + k), *passage[k % 3 :], *fresh(15)]) + "\nA common line.")
    half = fresh(90)
    out += [" ".join(half[:70] + passage), " ".join(passage + half[20:]), " ".join(half)]
    out += ["\n".join(" ".join(fresh(12)) for _ in range(5)) + "\r\n  A common line. \n\n" for _ in range(6)]
    out += [" ".join(fresh(30_000)), "x" * 1_500_000, "x" * 1_500_000 + "y", " ".join(["same"] * 300)]
    out += ["Released under the MIT License.", "Some words here\nLicensed under the Apache License, Version 2.0.\nand more", "can't won't it's I'll 'twas"]
    return out


def rows(seed: int = 5) -> list[tuple]:
    out = []
    for i, text in enumerate(texts(seed)):
        source = None if i % 9 == 4 else "hot" if i % 3 else f"s{i % 5}"
        out.append((i, text, None if i % 7 == 3 else "en" if i % 2 else "de", source, None, i % 4, "t", i, "s", "r", "[]", 1, "c", 2, "x"))
    out += [out[11], out[11], out[30]]  # repeated rows
    out.append((None, "a text without an id " * 30, "en", "hot", 5, *out[0][5:]))
    return out


def frame(spark, seed: int = 5):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def marked(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def ident(i: int | None) -> int:
    return NO_ID if i is None else i


def near_components(docs: list[tuple[int | None, str | None]], percent: int, width: int) -> dict[int, int]:
    sets: dict[int, list[frozenset]] = collections.defaultdict(list)
    for i, text in docs:
        w = spaced((text or "").translate(UPPER))
        grams = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] if w else []
        sets[ident(i)].append(frozenset(grams))
    parent = {i: i for i in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    known = list(sets)
    for a in known:
        for b in known:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in sets}


def shingle_count(text: str | None, width: int) -> int:
    w = spaced((text or "").translate(UPPER))
    return len({tuple(w[k : k + width]) for k in range(len(w) - width + 1)}) if len(w) >= width else int(bool(w))


def kept_words(docs: list[tuple[int | None, str | None]], width: int) -> list[tuple]:
    first: dict[int, int] = {}
    windows = []
    for i, text in docs:
        w = spaced(text)
        own = [hash(tuple(w[k : k + width])) for k in range(len(w) - width + 1)]
        windows.append((ident(i), i, w, own))
        for h in own:
            first[h] = min(first.get(h, 1 << 70), ident(i))
    out = []
    for rank, i, w, own in windows:
        gone = [False] * len(w)
        for k, h in enumerate(own):
            if first[h] < rank:
                gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def contaminated(docs: list[tuple[int | None, str | None]], items: list[tuple[int | None, str | None]], width: int) -> list[tuple]:
    windows: dict[tuple, set[str]] = collections.defaultdict(set)
    for name, text in items:
        w = marked(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("null" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w = marked(text)
        hit, names = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit[k : k + n] = [True] * n
                    names |= found
        out.append((i, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit)))
    return out
