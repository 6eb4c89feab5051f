"""DuckDB SQL of the queries that SQL can express.

The others (chunks cut by content, page layout, hash trees, a grown suffix tree, greedy windows, fitted
rates) are tested against plain versions and by round trips.
"""

from __future__ import annotations

from .common import LOWER, UPPER
from .decontaminate import SIZE
from .licenses import PHRASES, TEMPLATES, THRESHOLD
from .quality import INSULTS

_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM d, unnest(range(1, len(w) - 3)) AS r(i)),
dup AS (SELECT doc_id, x FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM win JOIN dup USING (doc_id, x), unnest(range(i, i + 5)) AS q(p) GROUP BY doc_id),
lines AS (
    SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
    WHERE regexp_matches(x, {_SPACED}) GROUP BY doc_id
),
m AS (
    SELECT d.doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines,
        len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all({_lower('t')}, '\b(?:{"|".join(INSULTS)})\b')) AS n_insults
    FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines
        OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_upper > 40 * length(t)
        OR n_insults >= 3 OR (n_insults > 0 AND 100 * n_insults >= n_words)) AS kept
FROM b
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower('text')}, {_SPACED}) AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM d, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS r(i)
    WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

_VALUES = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(TEMPLATES))
_PHRASES = ", ".join(f"('{phrase}', '{label}')" for phrase, label in PHRASES.items())
LICENSES = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower('text')}, {_ALNUM}) AS w FROM documents),
p AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {_PHRASES}) AS v(phrase, label)),
places AS (SELECT doc_id, i - 1 AS place, label FROM d, p, unnest(range(1, len(w) - len(p) + 2)) AS r(i) WHERE w[i:i + len(p) - 1] = p),
base AS (
    SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id
),
t AS (SELECT label, list_distinct(regexp_extract_all({_lower('text')}, {_ALNUM})) AS tw FROM (VALUES {_VALUES}) AS v(template, label, text)),
b AS (
    SELECT doc_id, list_distinct(regexp_extract_all({_lower('x')}, {_ALNUM})) AS bw
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents)
),
f AS (
    SELECT doc_id, list(DISTINCT label) AS labels, max(len(list_intersect(bw, tw)) / len(tw)) AS best FROM b, t
    WHERE 100 * len(list_intersect(bw, tw)) >= {THRESHOLD} * len(tw) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
    coalesce(array_to_string(base.labels, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
    CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(f.best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN f USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower('text')}, {_ALNUM}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_lower('text')}, {_ALNUM}) AS w FROM benchmark),
owners AS (
    SELECT DISTINCT item_id, w[k:k + {SIZE - 1}] AS win FROM i, unnest(range(1, greatest(1, len(w) - {SIZE - 1}) + 1)) AS r(k) WHERE len(w) > 0
),
wins AS (SELECT DISTINCT win FROM owners),
post AS (SELECT doc_id, k - 1 AS pos, w[k] AS term FROM d, unnest(range(1, len(w) + 1)) AS r(k)),
terms AS (SELECT win, off - 1 AS off, win[off] AS term FROM wins, unnest(range(1, len(win) + 1)) AS r(off)),
counts AS (SELECT term, count(*) AS n FROM post SEMI JOIN terms USING (term) GROUP BY term),
ranked AS (
    SELECT win, off, term, row_number() OVER (PARTITION BY win ORDER BY n, off) AS rank, count(*) OVER (PARTITION BY win) AS found
    FROM terms JOIN counts USING (term)
),
heads AS (
    SELECT post.doc_id, win, pos - off AS start, w[pos - off + 1:pos - off + len(win)] = win AND pos >= off AS exact,
        list_has_all(w[greatest(0, pos - {SIZE - 1}) + 1:pos + {SIZE}], win) AS near
    FROM post JOIN ranked USING (term) JOIN d USING (doc_id) WHERE rank = 1 AND found = len(win)
),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM heads, unnest(range(start, start + len(win))) AS r(p) WHERE exact GROUP BY doc_id),
names AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM heads JOIN owners USING (win) WHERE exact GROUP BY doc_id),
near AS (
    SELECT doc_id, count(DISTINCT win) AS n FROM heads WHERE near AND NOT exact AND (doc_id, win) NOT IN (SELECT (doc_id, win) FROM heads WHERE exact)
    GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * hit.n >= len(w) AS contaminated,
    coalesce(near.n, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''), lambda b: [ascii(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END))"""


def _leaf(text: str) -> str:
    fields = [f"({x})::VARCHAR" for x in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(f"coalesce(strlen({x})::VARCHAR || ':' || {x}, '-')" for x in fields) + ")"


def _siblings(level: str, start: str, nodes: str, at: str) -> str:
    """Digests left and right of a leaf's node on each level; the leaf is number ``at`` on level 0 of ``nodes``."""
    node = f"{at} // pow(3, x.level)::BIGINT"
    side = lambda op: f"string_agg(x.digest, '' ORDER BY x.i) FILTER (x.i {op} {node})"
    return f"""SELECT d.g, d.i, {start} + x.level AS level, {side('<')} AS l, {side('>')} AS r
    FROM d JOIN subroots s USING (g) JOIN {nodes} x ON {at} // pow(3, x.level + 1)::BIGINT = x.i // 3 AND {level} GROUP BY ALL"""


MANIFEST = f"""
WITH RECURSIVE d AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS i FROM (
        SELECT doc_id, coalesce('1' || source, '0') AS g, {_leaf('text')} AS leaf,
            {_leaf(f"CASE WHEN {_crc32('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS seen FROM documents)
),
low AS (
    SELECT g, 0 AS level, i, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM d
    UNION ALL
    SELECT g, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY g, level, i // 3
),
subroots AS (SELECT g, level AS height, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM low WHERE n = 1),
high AS (
    SELECT 0 AS level, i, subroot AS digest, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY level, i // 3
),
sides AS (
    {_siblings('x.g = d.g AND x.level < s.height', '0', 'low', 'd.i')}
    UNION ALL
    {_siblings('x.n > 1', 's.height', 'high', 's.i')}
),
fold AS (
    SELECT g, i, 0 AS level, seen AS digest FROM d
    UNION ALL
    SELECT f.g, f.i, f.level + 1, sha256(coalesce(l, '') || digest || coalesce(r, ''))
    FROM fold f JOIN sides s ON f.g = s.g AND f.i = s.i AND f.level = s.level
),
proofs AS (SELECT g, i, sha256(string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY level)) AS proof_sha256 FROM sides GROUP BY g, i),
folded AS (SELECT g, i, arg_max(digest, level) AS folded_root FROM fold GROUP BY g, i)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN subroots USING (g) JOIN folded f ON d.g = f.g AND d.i = f.i LEFT JOIN proofs p ON d.g = p.g AND d.i = p.i,
    (SELECT digest AS root FROM high WHERE n = 1) z
"""

TRIE = f"""
WITH t AS (
    SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {_crc32('conv_id::VARCHAR')} % 4 AS h
    FROM conversations WHERE conv_id IS NOT NULL
),
o AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text)) AS n FROM t
),
b AS (
    SELECT x.c, n, role, text FROM (SELECT DISTINCT c, h FROM t) x JOIN o ON o.c = x.c - x.c % 20 AND o.n <= x.h
    UNION ALL SELECT c, n + 1000000, role, text FROM o WHERE n > h
),
s AS (
    SELECT c, row_number() OVER w AS d, sha256(string_agg(sha256(role) || sha256(text), '') OVER w) AS f,
        len(regexp_extract_all(text, {_SPACED})) AS words
    FROM b WINDOW w AS (PARTITION BY c ORDER BY n)
),
-- prefixes of each conversation, the textless one included
p AS (SELECT c, d, f, words FROM s UNION ALL SELECT DISTINCT c, 0, '', 0 FROM t),
ends AS (SELECT f, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(f, d) AS f FROM p GROUP BY c) GROUP BY f),
nodes AS (SELECT f, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(words) AS words FROM p GROUP BY f),
up AS (SELECT DISTINCT x.f, y.f AS pf FROM p x JOIN p y ON x.c = y.c AND y.d = x.d - 1),
kids AS (SELECT pf AS f, count(*) AS n FROM up GROUP BY pf),
below AS (SELECT DISTINCT y.f, x.f AS x FROM p x JOIN p y ON x.c = y.c AND y.d <= x.d),
sums AS (
    SELECT below.f, count(*) FILTER (kids.n IS NULL) AS leaves, sum((nodes.n - 1) * words) AS saved
    FROM below JOIN nodes ON nodes.f = x LEFT JOIN kids ON kids.f = x GROUP BY below.f
)
SELECT nodes.c AS conv_id, nodes.d AS depth, parent.c AS parent_conv_id, nodes.n AS n_convs, coalesce(kids.n, 0) AS n_children,
    leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN sums USING (f) LEFT JOIN kids USING (f) LEFT JOIN ends USING (f) LEFT JOIN up USING (f) LEFT JOIN nodes parent ON parent.f = pf
"""

ORACLES = {
    "op1_quality_rules": QUALITY,
    "op3_ngram_jaccard": JACCARD,
    "op9_license_scan": LICENSES,
    "op10_decontamination": DECONTAMINATION,
    "op12_merkle_manifest": MANIFEST,
    "op13_prefix_trie": TRIE,
}
