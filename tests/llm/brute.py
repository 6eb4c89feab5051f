"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text, lower=False):
    text = text or ""
    return SPACED.findall(text.translate(UPPER) if lower else text)


def alnum(text):
    return ALNUM.findall((text or "").translate(UPPER))


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = spaced(text)
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    found = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if found[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside),
        n < 10 or 100 * len(inside) > 20 * n,
    )


def shingle_set(text, n=4):
    words = spaced(text, True)
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def jaccard_components(rows, n=4, percent=85):
    """doc_id -> (n_shingles, component) from ``(doc_id, text)``."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def unigrams(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = {i: [*spaced(t, True), "\n"] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if not held_out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return {
        i: (held_out(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        for i, ws in tokens.items()
    }


def conversations(rows):
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256) from rows ``(conv_id, turn, role, text)``."""
    out = {}
    for key in {r[0] for r in rows}:
        turns = sorted(((t, role or "", text or "") for k, t, role, text in rows if k == key), key=lambda x: (x[0] is not None, x))
        loss = "".join(text for _, role, text in turns if role == "assistant")
        body = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        out[key] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def licenses(text, phrases):
    """n_words, n_base, first_word, last_word, base_labels."""
    words, at, labels = alnum(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split(" ")
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def contamination(docs, items, size=13):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = {}
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        w, hit, found = alnum(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                owners = windows.get(tuple(w[k : k + n]))
                if owners:
                    hit |= set(range(k, k + n))
                    found |= owners
        names = ",".join(sorted(map(str, found)))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out
