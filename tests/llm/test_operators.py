"""Each operator against its plain version on a small table of awkward rows, and on the smallest test tables."""

import os
import random

import brute
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, decontaminate, fixity, html_text, licenses, line_dedup, mixing, ngram_join, quality, suffix_tree

FOLDER = os.environ.get("TESSELLA_DATA", "/root/testdata/sf0.001")
#: Columns whose names the operators use inside.
EXTRA = "_key long, key string, word string, n long, _text string, label string, t array<int>, _removed int"
random.seed(7)
VOCABULARY = [f"w{i}x" for i in range(400)]
BODY = [" ".join(random.choices(VOCABULARY, k=60)) for _ in range(8)]
BENCH = " ".join(random.choices(VOCABULARY, k=20))
LONG = " ".join(random.choices(VOCABULARY, k=30_000))


def texts():
    near = BODY[0].split(" ")
    near[5] = "changed"
    return [
        (1, BODY[0]), (2, BODY[0]), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n\x0b "), (7, "one"), (8, "One two\x0cTHREE"),
        (9, "a b c d e a b c d e f"), (10, "É é ß " + BODY[1]), (11, BODY[1].upper() + " " + BENCH), (12, LONG), (13, LONG + " tail"),
        (14, "x\nx\nx\n\n x"), (15, "### $$$ %%% *** " * 5), (16, BENCH), (17, BENCH[:40] + "\n" + BODY[2] + "\n" + BODY[3]),
        (18, BODY[4] + "\n" + BODY[2] + "\n" + BODY[3]), (19, "all rights reserved, CC-BY and All Rights\nReserved"),
        (20, "Licensed under the Apache License, Version 2.0."), (21, "the general public license CC BY-NC 4.0 licensed under"),
        (22, "<s>[INST] x [/INST]</s> \\l \\\\ [b"), (23, "idiot moron scum " + BODY[5]), (24, "w1x " * 40), (25, None), (26, "one"),
    ]


def frame(spark, rows, schema="doc_id long, text string"):
    """Rows with the extra columns."""
    width = len(EXTRA.split(", "))
    return spark.createDataFrame([(*r, *[None] * width) for r in rows], f"{schema}, {EXTRA}")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).repartition(3)


def got(df, key="doc_id", n=None):
    rows = df.collect()
    out = {r[key]: tuple(x for c, x in zip(df.columns, r) if c != key)[:n] for r in rows}
    assert len(out) == len(rows)
    return out


def empty(spark):
    return frame(spark, [])


def test_quality(spark, docs):
    want = {i: brute.quality(t) for i, t in texts()}
    assert got(quality.score(docs), n=6) == want
    kept = {r.doc_id for r in quality.score(docs).where("kept").collect()}
    assert kept and not kept & ({i for i, w in want.items() if w[-1]} | {15, 23})
    assert {1, 2, 3, 10, 12, 18} <= kept
    out = quality.keep(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    assert quality.score(empty(spark)).count() == 0
    assert quality.score(docs.union(docs.where("doc_id = 1"))).where("doc_id = 1").count() == 2
    assert not quality.score(frame(spark, [(None, None)])).first().kept


def test_rules_are_ordered_by_what_the_earlier_ones_leave():
    a, b, c, d = rules = [quality.Rule(n, None) for n in "abcd"]
    # b rejects nothing but what a rejects, c rejects fewer texts of its own, d none
    found = {(True, True, False, False): 50, (True, False, False, False): 10, (False, False, True, False): 5, (False,) * 4: 100}
    assert quality.greedy_order(rules, [1.0, 1.0, 1.0, 0.5], found) == [a, c, d, b]
    assert quality.greedy_order(rules, [100.0, 1.0, 1.0, 0.5], found) == [b, c, a, d]
    assert quality.greedy_order([], [], {}) == []


def test_quality_order_does_not_change_the_verdict(spark, docs):
    rules = [*quality.base_rules(), *quality.method_rules()]
    verdicts = [sorted(r.doc_id for r in docs.where(quality.cascade(x, F.coalesce("text", F.lit("")))).collect()) for x in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1]
    assert sorted(r.name for r in quality.measured_order(docs, rules)) == sorted(r.name for r in rules)


def plain_dedup(rows):
    """Texts after removing repeated chunks, by a set of seen chunks."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        if t is None:
            out[i] = None
            continue
        wanted, gone = dict(line_dedup.candidates(t, 50)), set()
        for number, chunk in wanted.items():
            if chunk in seen:
                gone.add(number)
            seen.add(chunk)
        lines = t.split("\n")
        out[i] = "\n".join(x for n, (a, b) in enumerate(line_dedup.chunks(t)) if n not in gone for x in lines[a:b])
    return out


def test_line_dedup(spark, docs):
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "lines_removed"]
    assert {r.doc_id: r.text for r in out.collect()} == plain_dedup(texts())
    assert {r.doc_id for r in out.where("lines_removed > 0").collect()} >= {2, 18}
    assert line_dedup.dedup(empty(spark)).count() == 0
    twice = frame(spark, [(None, "a b\n" + BODY[6]), (1, BODY[6]), (1, BODY[6])])
    assert [r.text for r in line_dedup.dedup(twice).orderBy("doc_id").collect()] == ["a b\n" + BODY[6], "", ""]


def test_line_dedup_of_passages_of_short_lines(spark):
    """Repeated runs of 2 to 6 lines go whole, whatever stands around them; all other lines stay."""
    rng, rows, want = random.Random(5), [], {}
    line = lambda k, mark: f"{mark} " + " ".join(rng.choices(VOCABULARY, k=k - 1))
    passages = [[line(60 // n + 1, f"p{n}{j}{i}") + ("\n" if j % 3 == 2 else "") for i in range(n)] for n in range(2, 7) for j in range(12)]
    for copy in range(2):
        for p in passages:
            around = [[line(9, f"d{len(rows)}{side}{i}") for i in range(rng.randrange(0 if copy == 0 else 1, 4))] for side in "ab"]
            want[len(rows)] = "\n".join([*around[0], *(p if copy == 0 else []), *around[1]])
            rows.append((len(rows), "\n".join([*around[0], *p, *around[1]])))
    got = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, rows)).collect()}
    strip = lambda x: [y for y in x.split("\n") if y]
    assert {i: strip(t) for i, t in got.items()} == {i: strip(t) for i, t in want.items()}


def test_chunks_resist_shifts():
    lines = [" ".join(random.choices(VOCABULARY, k=6)) for _ in range(40)]
    parts = lambda x: {"\n".join(x[a:b]) for a, b in line_dedup.chunks("\n".join(x))}
    assert len(parts(lines) & parts(["new first line", "another", *lines])) >= len(parts(lines)) - 2
    ranges = line_dedup.chunks("\n".join(lines))
    assert [a for a, _ in ranges] == [0, *(b for _, b in ranges[:-1])] and ranges[-1][1] == 40


def test_ngram_join(spark, docs):
    assert got(ngram_join.join(docs)) == brute.jaccard_components(texts())
    assert got(ngram_join.join(docs, 5, 80)) == brute.jaccard_components(texts(), 5, 80)
    kept = {r.doc_id for r in ngram_join.one_of_each(docs).collect()}
    assert kept == {i for i, (_, c) in brute.jaccard_components(texts()).items() if i == c}
    assert ngram_join.join(empty(spark)).count() == 0
    odd = ngram_join.join(frame(spark, [(None, BODY[0]), (5, BODY[0]), (5, BODY[0]), (None, None)]))
    assert sorted((r.n_shingles, r.component_id) for r in odd.where("n_shingles > 0").collect()) == [(57, 5)] * 3


def test_ngram_join_of_a_chain_and_of_large_cells(spark, monkeypatch):
    """Groups of very many near copies, chains whose ends do not link, and blocks smaller than a cell."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    rng, rows = random.Random(3), []
    for group in range(4):
        words = [f"g{group}x{i}" for i in range(70)]
        for _ in range(45):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(70)] = f"new{len(rows)}"
    shared = " ".join(f"s{i}" for i in range(12))
    rows += [(len(rows) + i, shared + " " + " ".join(rng.choices(VOCABULARY, k=20))) for i in range(60)]
    assert got(ngram_join.join(frame(spark, rows))) == brute.jaccard_components(rows)


def test_tree_bounds_lose_nothing():
    import numpy as np

    rng = np.random.default_rng(1)
    points = rng.poisson(2.0, (300, ngram_join.GROUPS)).astype("<i4")
    points[100:150] = points[:50] + (rng.random((50, ngram_join.GROUPS)) < 0.03)
    sizes = points.sum(1)
    tree = ngram_join.Tree(points, sizes)
    q, found, _ = tree.search(points, sizes, 85)
    for i in range(0, 300, 7):
        both = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero((185 * both >= 85 * (sizes + sizes[i])) & (sizes * 100 >= 85 * sizes[i]) & (sizes[i] * 100 >= 85 * sizes))
        assert set(want) <= set(found[q == i])


def test_long_unrelated_texts_and_large_components_give_few_candidates():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)

    def block(rows):
        out = []
        for key, label, hashes in rows:
            out.append((1, 0, key, label, len(hashes), ngram_join.packed(hashes.astype(np.uint64)), np.array([1])))
        return pd.DataFrame(out, columns=["cell", "side", "key", "label", "n", "vector", "low"])

    unrelated = block([(i, i, rng.integers(0, 2**60, 4000)) for i in range(60)])
    assert not len(ngram_join._crossed(unrelated, 85, None))
    base = rng.integers(0, 2**60, 300)
    copies = block([(i, i % 2, np.append(base[:298], rng.integers(0, 2**60, 2))) for i in range(80)])
    few, every = (ngram_join._crossed(copies, 85, n) for n in (2, None))
    assert len(few) == 2 and few["more"].all() and len(every) == 1600 and not every["more"].any()
    # texts that share a lesser cell are left to it, others are not
    copies["low"] = [np.array([0, 1] if i < 40 else [1]) for i in range(80)]
    assert len(ngram_join._crossed(copies, 85, None)) == 1600 - 400


def test_full_counts_bound_from_above():
    import numpy as np

    a, b = np.arange(1000, dtype=np.uint64) * np.uint64(1024), np.arange(500, 1500, dtype=np.uint64) * np.uint64(1024)
    for length in (512, 64):
        lo = np.minimum(*(ngram_join.folded([ngram_join.packed(x)], length) for x in (a, b))).sum()
        assert lo >= 500


PAGES = [
    (1, "<p>One<p>Two <b>bold</b>  text<div>Three</div>", "One\n\nTwo bold text\n\nThree"),
    (2, "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>end", "- a\n- b\n  3. c\n  4. d\n\nend"),
    (3, "<table><tr><th>Name<th>No<tr><td>Ann<td>1<tr><td>Bartholomew<td>22</table>", "Name         No\nAnn          1\nBartholomew  22"),
    (4, "<head><title>t</title><style>p{}</style></head><body>a<script>if (1 < 2) '</p>'</script> b<!-- c --> d</body>", "a b d"),
    (5, "x<span hidden>no</span><div style='display: none'>no<p>no</div><i aria-hidden=true>no</i> y", "x y"),
    (6, "<pre>  a\n    b</pre>c", "  a\n    b\n\nc"),
    (7, "&lt;b&gt; &amp; caf&eacute; &#65;<br>next<br/>last", "<b> & café A\nnext\nlast"),
    (8, "a < b and <b", "a < b and <b"), (9, "", ""), (10, None, ""), (11, "<p></p><p> </p>", ""),
    (12, "<h1>Head</h1>text<hr>more<blockquote>said</blockquote>", "Head\n\ntext\nmore\n\n  said"),
    (13, "<div>" * 20_000 + "deep", "deep"),
    (14, "<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a in  b"),
]


@pytest.mark.parametrize("page,text", [p[1:] for p in PAGES if p[1] is not None])
def test_page_text(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize("page,text", [
    ("<table><td>x</td></table>", "x"), ("<table><td>x<td>y<tr><td>z</table>", "x  y\nz"),
    ("<table>stray<tr><td>x</td></tr><tr>more</tr></table>end", "straymore\n\nx\n\nend"),
    ("<table><tr><td>x</td></tr><table><tr><td>y</td></tr></table></table>z", "x\n\ny\n\nz"),
    ("<html><head><title>T</title>Hello<p>you</p></head></html>", "Hello\n\nyou"),
    ("<table><tr><p>one<td>cell</td></tr></table>", "one\n\ncell"), ("<table><caption>cap<tr><td>x</table>", "cap\nx"),
    ("<table><form>in<tr><td>f</td></tr></form></table>", "in\n\nf"),
])
def test_page_text_of_stray_table_content(page, text):
    assert html_text.page_text(page) == text


def test_every_visible_text_node_is_written_once():
    """Random tables with missing and misplaced tags: each piece of text comes out once."""
    rng = random.Random(11)
    tags = "table /table tr /tr td /td th tbody /tbody thead caption /caption colgroup col div /div p b /b form /form ul li".split()
    for _ in range(3000):
        parts = [f"<{rng.choice(tags)}>" if rng.random() < 0.6 else f"q{i}q" for i in range(rng.randrange(1, 25))]
        page = rng.choice(["", "<head><title>T</title>"]) + "".join(parts)
        out = html_text.page_text(page)
        assert all(out.count(x) == 1 for x in parts if x[0] == "q"), (page, out)


@pytest.mark.parametrize("page,text", [
    ("<pre>a<b>b</b>c", "abc"), ("<pre>\n<i>a</i>\n\n  <i>b</i> c\n</pre>d", "a\n\n  b c\n\nd"), ("<ul><li><pre>x\ny</pre></ul>", "- x\n  y"),
    ("a <b title=\"x>y\">b</b> <i 'c'", "a b <i 'c'"), ("<a \" <p>x</p> ' <p>y</p>", "<a \"\n\nx\n\n'\n\ny"),
    ("<table><tr><td><b>a</i></td><td>b</b></td></table></b>c", "a  b\n\nc"), ("x<!-- <b> y", "x"), ("1 <", "1 <"), ("x<!y", "x"),
])
def test_page_text_of_preformatted_and_broken_markup(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize("part", [
    "<a ", "<a", "</x>", "<b>", "<a \"'", "<b></i>", "<ul>", "<li>", "<ul><li>x", "<p><b>", "<table><td><b></i>", "<pre>x<b>", "<!", "<a b='\">",
    "<td>", "<blockquote>y",
])
def test_page_text_of_wide_and_deep_pages_is_linear(part):
    import time

    page, began = part * (1_000_000 // len(part)), time.process_time()
    html_text.page_text(page)
    html_text.page_text(page + "\">")
    assert time.process_time() - began < 20


def test_html(spark):
    pages = frame(spark, [(i, "u", p) for i, p, _ in PAGES] + [(None, "u", "z"), (14, "u", "z")], "page_id long, url string, html string")
    out = html_text.extract(pages)
    assert sorted((r.page_id or 0, r.text) for r in out.collect()) == sorted([(i, t) for i, _, t in PAGES] + [(0, "z"), (14, "z")])
    assert all(r.n_chars == len(r.text) and r.n_lines == (r.text.count("\n") + 1 if r.text else 0) for r in out.collect())
    assert html_text.extract(pages.limit(0)).count() == 0


def test_fixity(spark):
    rows = [(i, f"u{i}", "x" * (i * 37 % 900)) for i in range(400)] + [(7, "u7", "x" * 259)] * 3 + [(None, None, None), (5, None, "")]
    records = fixity.archive(frame(spark, rows, "page_id long, url string, html string"))
    laid = sorted((r.offset, len(r.data)) for r in records.collect())
    assert len(laid) == len(rows) and all(a + n == b for (a, n), (b, _) in zip(laid, laid[1:])) and laid[0][0] == 0
    assert fixity.audit(records, records, span=4096, fanout=4).count() == 0
    at = [r.offset for r in records.where("key in (11, 200, 399)").orderBy("offset").collect()]
    flip = F.when(F.col("offset") == at[0], F.concat(F.lit(b"!"), F.expr("substring(data, 2)"))).otherwise(F.col("data"))
    other = records.where(F.col("offset") != at[1]).select("key", "offset", flip.alias("data"))
    other = other.unionByName(records.where(F.col("offset") == at[2]).select("key", (F.col("offset") + 10**6).alias("offset"), "data"))
    found = {(r.offset, r.status) for r in fixity.audit(records, other, span=4096, fanout=4).collect()}
    assert found == {(at[0], "changed"), (at[1], "missing"), (at[2] + 10**6, "extra")}
    assert fixity.audit(records.limit(0), records.limit(0)).count() == 0
    assert {r.status for r in fixity.audit(records, records.limit(0)).collect()} == {"missing"}


def test_suffix_tree(spark, docs):
    model = suffix_tree.fit(docs.where(suffix_tree.is_training(F.col("doc_id"))), p_head=1e-3)
    out = {r.doc_id: r for r in suffix_tree.score(docs, model).collect()}
    want = brute.unigrams(texts())
    for i, w in want.items():
        assert (out[i].held_out, out[i].n_tokens, out[i].n_known, out[i].train_tokens) == w[:4]
        assert out[i].base_score == pytest.approx(w[4])
    empty_model = suffix_tree.fit(empty(spark))
    assert suffix_tree.score(empty(spark), model).count() == 0
    r = suffix_tree.score(docs.where("doc_id = 7"), empty_model).first()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0)
    assert not suffix_tree.score(frame(spark, [(None, "one")]), model).first().held_out


def test_suffix_tree_states_are_distributions_and_learn(spark):
    """Next-word probabilities of every context sum to one; a deterministic chain is predicted."""
    import numpy as np

    rng = random.Random(5)
    chain = lambda: " ".join(x for _ in range(40) for x in rng.choice(["a b c", "d b e"]).split())
    docs = spark.createDataFrame([(i, chain()) for i in range(60)], "doc_id long, text string")
    model = suffix_tree.fit(docs, p_context=1e-3, p_joint=1e-4)
    tree, _, n, v = model
    assert len(tree.levels) == 2 and tree.levels[1].kept.any()
    ids = np.arange(len(tree.words))
    root = 10.0**tree.logs
    for level_no, level in enumerate(tree.levels):
        for context in np.flatnonzero(level.kept)[:10]:
            word = [int(level.names[context] % tree.symbols)]
            states = [np.full(len(ids), -1) for _ in tree.levels]
            states[level_no][:] = context
            if level_no == 1:
                upper = int(level.names[context] // tree.symbols)
                suffix = suffix_tree._find(tree.levels[0].names, np.array(word))[0]
                states[0][:] = suffix
                assert 0 <= upper < len(tree.levels[0].names)
            p = suffix_tree._probability(tree, tree.levels, states, ids, root.copy())
            # the root leaves one share to unseen words; a state can only leave less
            assert root.sum() - 1e-9 <= p.sum() <= 1 + 1e-9
    row = suffix_tree.score(docs, model).agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert row.s > 0.7 * row.b  # log probabilities are negative: two of three words follow from their context


def test_suffix_tree_grows_with_the_corpus(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, weights, k=60))) for i in range(3000)], "doc_id long, text string")
    sizes = []
    for rows in (30, 300, 3000):
        tree, *_ = suffix_tree.fit(docs.where(F.col("doc_id") < rows))
        sizes.append((len(tree.levels[0].names), sum(len(x.codes) for x in tree.levels)))
    assert all(3 * a <= b for one, ten in zip(sizes, sizes[1:]) for a, b in [(one[1], ten[1])]), sizes
    assert sizes[0][0] < sizes[1][0] < sizes[2][0], sizes


def turns():
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi </s>[INST] \\l <s>"), (1, 2, "assistant", "a\nb\\[/INST]"), (1, 3, "user", None),
        (1, 4, "assistant", ""), (2, 0, "user", "x y z"), (2, 0, "user", "x y z"), (2, None, None, "first"), (3, 5, "odd <role>\n", "q"),
        (None, 0, "assistant", "no key"), (None, 1, "user", "still none"),
    ]
    rows += [(4, 0, "system", "s " * 5)] + [(4, i, ("user", "assistant")[i % 2 - 1], f"word{i} " * (i % 23)) for i in range(1, 120)]
    rows += [(5, i, "assistant", "long " * 50) for i in range(3)]
    return rows


def test_chat(spark):
    frame_ = frame(spark, turns(), "conv_id long, turn long, role string, text string").repartition(3)
    made = chat.windows(frame_, budget=40, history=12)
    digests = got(chat.digest(made), "conv_id")
    assert {k: v[:4] for k, v in digests.items()} == brute.conversations(turns())
    rows = made.collect()
    for r in rows:
        parts = chat.parse(r.formatted)
        assert len(parts) == r.n_repeated + r.n_new and r.n_tokens == sum(len(t.split()) for _, t in parts)
        assert r.n_tokens <= 40 or r.n_new == 1
        assert r.conv_id not in (1, 4) or parts[0][0] == "system"
        assert [chat.unescape(r.formatted[a:b]) for a, b in r.mask] == [t for role, t in parts[r.n_repeated :] if role == "assistant"]
    four = sorted((r for r in rows if r.conv_id == 4), key=lambda r: r.window)
    assert len(four) > 20 and [r.first_turn for r in four] == [0, *__import__("itertools").accumulate(r.n_new for r in four[:-1])]
    assert any(r.n_repeated > 1 for r in four)
    assert chat.windows(frame_.limit(0)).count() == 0


def test_chat_windows_keep_the_budget():
    rng = random.Random(6)
    for _ in range(300):
        system, history = rng.choice([0, 3, 30, 120]), rng.choice([0, 20, 60])
        sizes = [rng.choice([0, 1, 5, 20, 45, 90, 130]) for _ in range(30)]
        talk = chat._Conversation(1, 100, history)
        rows = [*talk.add("system", "s " * system)] if system else []
        rows += [r for i, n in enumerate(sizes) for r in talk.add(("user", "assistant")[i % 2], "w " * n)] + [talk.flush()]
        for _, window, first, new, repeated, tokens, formatted, _ in rows:
            own = [len(t.split()) for _, t in chat.parse(formatted)[repeated:]]
            beside = system if window else 0
            assert tokens <= 100 or (new == 1 and own[0] + beside > 100 and repeated == bool(system and window))
        assert sum(r[3] for r in rows) == 30 + bool(system)


@pytest.mark.parametrize("text", ["", "\\", "\\l", "<s>a\nb</s>", "[INST]", "\\\\b<[", "plain"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.parse(chat.format_turn(text, text)[0]) == [(text, text)]


def test_mixing(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(600):
        kind = rng.choices(["good", "low", "toxic"], [0.7, 0.2, 0.1])[0]
        words = rng.choices(VOCABULARY, k=30) + {"good": [], "low": ["###", "$$"], "toxic": ["idiot", "moron", "scum"]}[kind]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(kind != "low"), int(kind == "toxic"), kind))
    kinds = {i: k for i, _, _, k in labels}
    docs = frame(spark, rows + [(None, None), (1000, ""), (1001, None)])
    known = spark.createDataFrame([x[:3] for x in labels] + [(None, 1, 0), (3000, None, None)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, known)
    by = {r.doc_id: r for r in out.collect()}
    assert len(by) == 603 and by[1000].n_tokens == 0
    assert all(abs(r.p_good + r.p_low + r.p_toxic - 1) < 1e-5 and r.rate >= 0 for r in by.values())
    assert all(by[i].rate == 0 for i, k in kinds.items() if k == "toxic")
    assert all(0.9 < by[i].rate < 1.1 for i, k in kinds.items() if k == "good")
    tokens = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in by.values()) for d in mixing.DOMAINS}
    assert tokens["low"] / sum(tokens.values()) == pytest.approx(0.02, abs=0.005)
    assert mixing.mix(empty(spark), known).count() == 0
    assert mixing.mix(docs, known.limit(0)).count() == 603


@pytest.mark.parametrize("toxic,stray", [((600.0, [0.0, 0.0, 1.0]), 0.0), ((500.0, [0.0, 0.0, 1.0]), 0.0004), ((1500.0, [0.4, 0.0, 0.6]), 0.0)])
def test_rare_domains_of_weight_zero_go(spark, monkeypatch, toxic, stray):
    """Rare toxic documents get rate zero, and the fit meets the target of each other domain by its own tokens."""
    rows = [(1, 980_000, [1 - stray, 0.0, stray]), (2, 20_000, [0.0, 1.0, 0.0]), (3, int(toxic[0]), toxic[1])]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    monkeypatch.setattr(mixing, "fit", lambda *a, **b: None)
    monkeypatch.setattr(mixing, "posteriors", lambda *a, **b: members)
    by = {r.doc_id: r.rate for r in mixing.mix(members, members).collect()}
    assert by[3] == 0 and by[1] == pytest.approx(1, abs=0.01) and by[2] == pytest.approx(1, abs=0.01)
    small = spark.createDataFrame([(1e6, [1.0, 0.0, 0.0]), (900.0, [0.0, 1.0, 0.0])], "n_tokens double, p array<double>")
    _, reached, goal = mixing.rates(small, {"good": 0.9996, "low": 0.0004})
    assert reached[1] == pytest.approx(goal[1], abs=0.9)
    # a domain of weight zero that loses more than it must pulls no document up
    shared = spark.createDataFrame([(1e6, [1.0, 0.0, 0.0]), (80_000.0, [0.0, 0.6, 0.4])], "n_tokens double, p array<double>")
    _, reached, goal = mixing.rates(shared, mixing.WEIGHTS)
    assert reached[1] == pytest.approx(goal[1], abs=50) and reached[2] < goal[2]


def test_rates_solve_the_least_squares(spark):
    """With reachable targets the fitted rates meet them."""
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        p = [rng.random() ** 3 for _ in range(3)]
        rows.append((float(rng.randrange(10, 500)), [x / sum(p) for x in p]))
    members = spark.createDataFrame(rows, "n_tokens double, p array<double>")
    weights = {"good": 0.5, "low": 0.3, "toxic": 0.2}
    steps, reached, goal = mixing.rates(members, weights)
    assert steps and all(abs(a - b) <= 1e-3 * sum(goal) for a, b in zip(reached, goal))
    totals = members.withColumn("r", mixing.rate_of(F.col("p"), steps)).agg(*(F.sum(F.col("n_tokens") * F.col("r") * F.get("p", d)) for d in range(3)))
    assert list(totals.first()) == pytest.approx(reached)


def test_licenses(spark, docs):
    known = licenses.templates(spark)
    out = {r.doc_id: r for r in licenses.scan(docs, known).collect()}
    assert {i: tuple(r)[1:6] for i, r in out.items()} == {i: brute.licenses(t, licenses.PHRASES) for i, t in texts()}
    assert out[20].labels == "apache-2.0" and out[20].score == 1.0 and out[19].labels == "cc-by,reserved"
    want = set()
    for i, t in texts():
        for b, line in enumerate((t or "").split("\n")):
            for label, template in licenses.TEMPLATES:
                words = set(brute.alnum(template))
                if 100 * len(words & set(brute.alnum(line))) >= licenses.THRESHOLD * len(words):
                    want.add((i, b, label))
    assert {(r.doc_id, r.block, r.label) for r in licenses.similar_blocks(docs, known).collect()} == want
    assert licenses.scan(empty(spark), known).count() == 0
    assert licenses.scan(docs, known.limit(0)).where("score > 0").count() > 0
    assert licenses.scan(docs.union(docs.where("doc_id = 20")), known).where("labels = 'apache-2.0'").count() == 2


@pytest.mark.parametrize("threshold", [50, 70])
def test_license_join_is_exact(spark, threshold):
    rng = random.Random(9)
    small = VOCABULARY[:12]
    blocks = [(i, "\n".join(" ".join(rng.choices(small, k=rng.randrange(1, 9))) for _ in range(3))) for i in range(60)]
    known = [(f"l{i}", " ".join(rng.choices(small, k=rng.randrange(1, 7)))) for i in range(8)]
    found = licenses.similar_blocks(frame(spark, blocks), licenses.templates(spark, known), threshold).collect()
    want = [
        (i, b, label) for i, t in blocks for b, line in enumerate(t.split("\n")) for label, x in known
        if 100 * len(set(x.split()) & set(line.split())) >= threshold * len(set(x.split()))
    ]
    assert sorted((r.doc_id, r.block, r.label) for r in found) == sorted(want)


def items():
    words = BENCH.split(" ")
    return [(1, BENCH), (2, " ".join(words[3:18])), (3, "one"), (4, "w1x w1x"), (5, None), (6, "..."), (7, "never seen words"), (3, "one")]


def test_decontamination(spark, docs):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    out = decontaminate.report(docs, bench)
    assert got(out, n=5) == brute.contamination(texts(), items())
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {i for i, r in brute.contamination(texts(), items()).items() if not r[-1]}
    assert decontaminate.report(empty(spark), bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    odd = decontaminate.report(frame(spark, [(None, BENCH), (1, BENCH), (1, BENCH)]), bench)
    assert sorted((r.doc_id or 0, r.n_hit) for r in odd.collect()) == [(0, 0), (1, 20), (1, 20)]


def test_proximity(spark):
    words = [f"q{i}" for i in range(13)]
    swapped = [*words[:5], words[6], words[5], *words[7:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(words[:12]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert got(decontaminate.report(docs, bench).select("doc_id", "n_hit", "n_near")) == {1: (13, 0), 2: (0, 1), 3: (0, 0)}
