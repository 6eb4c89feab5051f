"""Nearest labelled examples, the Merkle manifest and the conversation trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import merkle_manifest, prefix_trie, queries, toxicity

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
crc = lambda x: zlib.crc32(str(x).encode())


# --- toxicity ---------------------------------------------------------------------------------


def labelled(spark, n=400, seed=3):
    """Documents of which every fifth has two of three bad words, their labels, and all rows as Python."""
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(300)]
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(8, 60))
        if i % 5 == 0:
            text += rng.sample(["vile", "nasty", "rotten"], 2)
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t, None, None) for i, t, _ in rows], "doc_id long, text string, t string, vote double").repartition(3)
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), rows


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(700):
        ids = np.unique(rng.integers(0, 120, rng.integers(1, 9)))
        w = rng.integers(1, 5, len(ids)) * np.where(rng.random(len(ids)) < 0.2, 6.0, 1.0)
        vectors.append((ids, w / np.sqrt((w * w).sum())))
    vectors.sort(key=lambda v: int(v[0][v[1].argmax()]))
    index = toxicity.Index.of(vectors, 120)
    dense = np.zeros((700, 120))
    for i, (ids, w) in enumerate(vectors):
        dense[i, ids] = w
    scored = 0
    for ids, w in vectors[::23]:
        for without in (-1, 3):
            got, cos, blocks = index.nearest(ids, w, 10, without)
            want = dense[:, ids] @ w
            if without >= 0:
                want[without] = 0
            assert cos == pytest.approx(np.sort(want)[::-1][: len(cos)]) and len(cos) == min(10, (want > 0).sum())
            assert want[got] == pytest.approx(cos) and len(set(got)) == len(got)
            scored += blocks
    assert scored < 0.8 * 2 * len(vectors[::23]) * -(-700 // toxicity.BLOCK)


def test_votes_equal_plain_nearest_neighbours(spark):
    docs, labels, rows = labelled(spark)
    model, training = toxicity.fit(docs, labels)
    texts = {r.key: (r.t, r.y) for r in training.collect()}
    assert set(texts) == {i for i, _, _ in rows if crc(i) % 3 != 1}
    n, df = len(texts), Counter(w for t, _ in texts.values() for w in set(t.split()))
    assert {"vile", "nasty", "rotten"} <= {t.decode() for t in model.terms}

    def vector(t):
        c = Counter(w for w in t.split() if w.encode() in model.terms)
        v = {w: (1 + math.log(k)) * math.log((n + 1) / (df[w] + 1)) for w, k in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    examples = {i: (vector(t), t, y) for i, (t, y) in texts.items()}
    got = {r.doc_id: r for r in toxicity.score(docs, model, training).collect()}
    for i, t, y in rows:
        q = vector(t)
        cos = sorted((sum(x * v.get(w, 0) for w, x in q.items()) for v, other, _ in examples.values() if other != t), reverse=True)
        cos = [c for c in cos if c > 0]
        assert got[i].held_out == (crc(i) % 3 == 1)
        assert (got[i].vote is None) == (not cos)
        if cos:
            assert got[i].nearest == pytest.approx(cos[0])
        assert got[i].predicted == y == int(got[i].score >= 0.7)


def test_toxicity_of_awkward_rows(spark):
    docs, labels, _ = labelled(spark)
    odd = [(None, "so vile and nasty"), (5000, None), (5001, ""), (5002, "clean"), (5003, "VILE, nasty!"), (5003, "VILE, nasty!"), (5004, "w1 " * 40_000 + "rotten vile")]
    more = docs.union(spark.createDataFrame([(*r, None, None) for r in odd], docs.schema))
    labels = labels.union(spark.createDataFrame([(None, 1), (5002, None), (0, 1), (0, 1)], labels.schema))
    out = toxicity.score(more, *toxicity.fit(more, labels)).collect()
    assert len(out) == 400 + len(odd)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[5003]) == 2 and all(r.predicted == 1 for r in [*by[None], *by[5003], *by[5004]])
    assert all(r.vote is None and r.predicted == 0 for i in (5000, 5001, 5002) for r in by[i])
    none = spark.createDataFrame([], labels.schema)
    model, training = toxicity.fit(docs, none)
    assert {r.score for r in toxicity.score(docs, model, training).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model, training).count() == 0
    assert toxicity.fit(docs, labels, rows=50)[1].count() < 100


def test_pooled_shares_never_fall():
    got = toxicity.monotone(np.array([0.1, 0.4, 0.2, 0.6, 0.5]), np.array([1.0, 1, 3, 1, 1]))
    assert got == pytest.approx([0.1, 0.25, 0.25, 0.55, 0.55])


# --- manifest ---------------------------------------------------------------------------------


def leaf(fields):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def climb(digests):
    """All levels of a tree, lowest first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H(*x[i : i + 3]) for i in range(0, len(x), 3)])
    return levels


def way(levels, i):
    """(left, right) siblings of node ``i`` on each level."""
    for x in levels[:-1]:
        first = i - i % 3
        yield "".join(x[first:i]), "".join(x[i + 1 : first + 3])
        i //= 3


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    order = lambda x: (x is not None, x if x is not None else 0)
    seen = lambda r: leaf((*r[:4], r[4].replace("\n", "")) if r[4] is not None and r[0] is not None and crc(r[0]) % 2 == 0 else r)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (order(r[0]), leaf(r), seen(r))) for s in sources]
    trees = [climb([leaf(r) for r in g]) for g in groups]
    top = climb([t[-1][0] for t in trees])
    out = []
    for n, (group, tree) in enumerate(zip(groups, trees)):
        for i, r in enumerate(group):
            steps = [*way(tree, i), *way(top, n)]
            folded = seen(r)
            for a, b in steps:
                folded = H(a, folded, b)
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], H(*(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def documents(n=130):
    rng = random.Random(1)
    rows = [(i, f"s{rng.choice('aabc')}", rng.choice(["en", None]), i, f"line {i}\nnext {rng.random()}") for i in range(n)]
    return rows + [
        (None, "sa", "en", 1, "a\nb"), (None, "sa", "en", 1, "a\nc"), (5000, None, None, None, None), (5001, None, "x", 2, ""), (5002, "", "x", 2, "\n"),
        (5003, "é", "x", 2, "ü\n"), (5003, "é", "x", 2, "ü\n"), (5004, "z", "x", 2, "long\n" * 50_000), (1, "sa", "en", 7, "another row of the same id"),
    ]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(spark, monkeypatch, height):
    monkeypatch.setattr(merkle_manifest, "HEIGHT", height)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 3**height)
    rows = documents()
    schema = "doc_id long, source string, lang string, n_chars int, text string, g int, block string, suffix int, key int, seen int"
    docs = spark.createDataFrame([(*r, *[None] * 5) for r in rows], schema).repartition(4)
    out = merkle_manifest.manifest(docs, queries.tampered()).drop("proof_levels")
    assert sorted(map(tuple, out.collect()), key=repr) == plain_manifest(rows)
    assert all(r.verified for r in merkle_manifest.manifest(docs).collect())


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars int, text string"
    assert merkle_manifest.manifest(spark.createDataFrame([], schema)).count() == 0
    one = (7, "s", "en", 1, "x")
    [row] = merkle_manifest.manifest(spark.createDataFrame([one], schema)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf(one) and row.proof_sha256 == H() and row.proof_levels == 0


def test_sweeps_of_a_block():
    for n in (1, 2, 3, 4, 9, 10, 27, 50):
        digests = [H(str(i)) for i in range(n)]
        levels = climb(digests)
        nodes = merkle_manifest.forward(digests, len(levels) - 1)
        assert nodes == levels
        for i, chain in enumerate(merkle_manifest.backward(nodes, ())):
            assert list(merkle_manifest._steps(chain)) == list(way(levels, i))


# --- trie -------------------------------------------------------------------------------------


def plain_trie(rows):
    """Sorted rows of the trie from (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    digest = lambda r: H(f"{len(r[1].encode())}:{r[1]}{r[2]}")
    own = {c: [x[1:] for x in sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))] for c, v in convs.items()}
    full = {c: tuple(own.get(c - int(math.fmod(c, 20)), [])[: crc(c) % 4] + x[crc(c) % 4 :]) for c, x in own.items()}
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words(p)
    ends = {}
    for c, t in full.items():
        ends.setdefault(t, []).append(c)
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], H(",".join(map(str, sorted(ends.get(p, []))))))
            for p, m in members.items()
        ),
        key=repr,
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn int, role string, text string, c long, d long, f string, n long, h1 long"


def trie(spark, rows, **more):
    turns = spark.createDataFrame([(*r, *[None] * 5) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, prefix_trie.trie(turns, **more).select(*COLUMNS).collect()), key=repr)


def conversations():
    rng, rows = random.Random(9), []
    for c in range(90):
        for t in range(rng.randrange(1, 7)):
            rows.append((c if c % 7 else -c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "hello there", "a b c"]) if t < 4 else f"own {c}"))
    rows += [(500 + c, t, "user", x) for c in range(40) for t, x in enumerate(["same opening", "same answer", f"tail {c % 3}"])]
    rows += [(700, t, "user", f"long {t}") for t in range(150)]
    rows += [(701 + c, t, "user", f"long {t}") for c in range(8) for t in range(10 + 17 * c)]
    return rows + [
        (None, 0, "user", "no conversation"), (900, None, None, None), (900, 1, "user", "x y"), (900, 1, "user", "a tie"), (900, 1, "user", "a tie"),
        (921, 0, "user", "only"), (922, 0, "user", "word " * 20_000),
    ]


@pytest.mark.parametrize("batches", [1, 3])
def test_trie(spark, batches):
    rows = conversations()
    assert trie(spark, rows, batches=batches) == plain_trie(rows)


def test_trie_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    assert trie(spark, []) == []
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b")]
    assert trie(spark, rows) == plain_trie(rows)
    rows = [(20 * i, t, "user", f"t{t}") for i in range(9) for t in range(7)]
    assert trie(spark, rows) == plain_trie(rows)


def test_exit_nodes_need_few_lookups(spark, monkeypatch):
    """A deep trie: the search asks one handle a binary digit of the greatest depth."""
    rows = [(20 * c, t, "user", f"x{t}" if t < 300 - c else f"y{c}{t}") for c in range(5) for t in range(320)]
    rounds, stage = [], prefix_trie.stage
    monkeypatch.setattr(prefix_trie, "stage", lambda df, name="": rounds.append(name) or stage(df, name))
    assert trie(spark, rows) == plain_trie(rows)
    assert rounds.count("search") == prefix_trie.BATCHES * (320).bit_length() + prefix_trie.BATCHES


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 20) for b in range(a + 1, 40)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("t"))
    even = lambda x: x & -x
    assert all(r.t == max(range(r.a + 1, r.b + 1), key=even) for r in df.collect())
