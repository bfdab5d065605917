"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def fingerprint(text):
    found = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(found[k : k + 3]) for k in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    """The smallest id reachable from each, over pairs for which ``linked`` holds."""
    ids = sorted(set(ids))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def without_repeats(rows, window=13):
    """(doc_id, words, kept words) of each row, in the order given."""
    first = {}
    for i, text in rows:
        found = WORD.findall(text or "")
        for k in range(len(found) - window + 1 if i is not None else 0):
            key = tuple(found[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    places = {}
    for i, text in rows:
        found = WORD.findall(text or "")
        for k in range(len(found) - window + 1 if i is not None else 0):
            if first[tuple(found[k : k + window])] < i:
                places.setdefault(i, set()).add(k)
    for i, text in rows:
        found = WORD.findall(text or "")
        gone = {w for k in places.get(i, ()) if k + window <= len(found) for w in range(k, k + window)}
        out.append((i, found, [w for k, w in enumerate(found) if k not in gone]))
    return out


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def word_scores(rows, learned):
    """Of each text tokens, known tokens and base score, and the counts they come from."""
    tokens = [WORD.findall((t or "").translate(LOWER)) + ["\0end"] for _, t in rows]
    words, pairs, texts = Counter(), Counter(), 0
    for found, use in zip(tokens, learned):
        if use:
            words.update(found)
            pairs.update(zip(["\0begin", *found], found))
            texts += 1
    mass = sum(words.values()) + 0.5 * (len(words) + 1)
    out = []
    for found in tokens:
        base = sum(math.log10((words[w] + 0.5) / mass) for w in found)
        out.append((len(found), sum(words[w] > 0 for w in found), base))
    return out, tokens, words, pairs, texts, mass


def tiled(doc, item, least):
    """Words of the item that greedy tiles of ``least`` words cover."""
    free_doc, free_item = [True] * len(doc), [True] * len(item)
    covered = 0
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while (
                    i + n < len(doc)
                    and j + n < len(item)
                    and doc[i + n] == item[j + n]
                    and free_doc[i + n]
                    and free_item[j + n]
                ):
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = n, i, j
        if best is None:
            return covered
        n, i, j = best
        free_doc[i : i + n] = [False] * n
        free_item[j : j + n] = [False] * n
        covered += n


def longest_repeats(rows, window=13):
    """Of each id the greatest of 13, 26, 52 ... words in a row, or of its whole texts, that another id has too."""
    longest = {i: 0 for i, _ in rows}
    size, some = window, True
    while some:
        at, some = {}, False
        for i, text in rows:
            found = WORD.findall(text or "")
            for k in range(len(found) - size + 1):
                at.setdefault(tuple(found[k : k + size]), set()).add(i)
        for ids in at.values():
            for i in ids if len(ids) > 1 else ():
                longest[i], some = size, True
        size *= 2
    at = {}
    for i, text in rows:
        at.setdefault(text, set()).add(i)
    for text, ids in at.items():
        n = len(WORD.findall(text or ""))
        for i in ids if len(ids) > 1 and n >= window else ():
            longest[i] = max(longest[i], n)
    return longest
