"""The divergence audit against plain Python: many stripes and tiles, NULLs, ties, repeated rows, clashing columns."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hearthlens.llm import divergence_audit

COLUMNS = "doc_id long, text string, lang string, source string, term int, n string, _at long, value string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "x", 2, "y", 3) for i, r in enumerate(rows)], COLUMNS)


def plainly(rows, top):
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        small = "".join(c.lower() if c.isascii() else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small)
        counts[lang or "", source or ""].update(found)
        documents[lang or ""].update(set(found))
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in documents[lang].items() if n >= 3), key=str.encode)

        def shares(found):
            whole = sum(found[t] for t in kept) + len(kept)
            return [1 + 1_000_000_000 * (found[t] + 1) // whole for t in kept]

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((x - y) ** 2 // y for x, y in zip(p[s], p[o])), o) for o in sources if o != s]
            terms = [((x - y) ** 2 // y, t) for t, x, y in zip(kept, p[s], q) if counts[lang, s][t] and x > y]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def made(n_sources, words, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{c}{w}" for w in "wind meer É ñandú zzz \x80x".split() for c in "abcdefgh"][:words]
    rows = [(None, None, None), ("", "", ""), ("wind", "xx", "lone"), ("9 _ -", "en", "digits only"), ("Wind, WIND wind x", "en", None)]
    for i in range(n_sources * 3):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8)))
        rows.append((rng.choice([text, text.upper()]), rng.choice(["en", "en", "de"]), f"s{i % n_sources}"))
    # A third of all rows are copies of one.
    return rows + [("sea Sea SEA;seal", "en", "s0")] * (len(rows) // 2)


@pytest.mark.parametrize(("n_sources", "words", "stripe", "top"), [(9, 48, 4096, 200), (9, 48, 5, 3), (150, 12, 4, 200)])
def test_equals_plain_sums(spark, n_sources, words, stripe, top):
    rows = made(n_sources, words)
    got = divergence_audit.audit(frame(spark, rows), top=top, stripe=stripe).collect()
    assert sorted(tuple(r) for r in got) == plainly(rows, top)


def test_edges(spark):
    assert divergence_audit.audit(frame(spark, [])).count() == 0
    # No term in three documents: all sources of a language are alike.
    got = divergence_audit.audit(frame(spark, [("a b", "en", s) for s in "xy"])).collect()
    assert sorted(tuple(r) for r in got) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    rows = [("sea " * 300_000, "en", "long"), ("sea wind", "en", "short"), ("sea wind", "en", "short"), ("wind", "en", "short")]
    assert sorted(tuple(r) for r in divergence_audit.audit(frame(spark, rows)).collect()) == plainly(rows, 200)


def test_shares_of_counts_beyond_a_thousand_million():
    n, whole = np.array([0, 10**12, 3 * 10**14]), np.array([7 * 10**14 + 3])
    assert divergence_audit.shares(n, whole).tolist() == [1 + 10**9 * (int(x) + 1) // int(whole[0]) for x in n]


def test_only_blocks_that_both_trees_hold_are_visited():
    rng = np.random.default_rng(1)
    rows, columns = rng.integers(0, 120, 40), rng.integers(0, 900, 40)
    left, right = divergence_audit.Quadtree(rows, columns), divergence_audit.Quadtree(rows[:9], columns[:9])
    held, others = ({(r // 32, c // 32) for r, c in zip(rows[:n].tolist(), columns[:n].tolist())} for n in (40, 9))
    want = {(a, b, c) for a, c in held for b, d in others if c == d}
    assert set(zip(*[x.tolist() for x in divergence_audit.joint_leaves(left, right)])) == want
    nothing = divergence_audit.Quadtree(rows[:0], columns[:0])
    assert not len(divergence_audit.joint_leaves(nothing, left)[0]) and not len(divergence_audit.joint_leaves(nothing, nothing)[0])


@pytest.mark.parametrize("most", [1, 7, 1 << 21])
def test_counts_that_share_a_column_meet_once(most):
    rng = np.random.default_rng(4)
    sides = []
    for n in (70, 200):
        cells = np.unique(np.stack([rng.integers(0, 100, n), rng.integers(0, 77, n)]), axis=1)
        sides.append(divergence_audit.Side(*cells, rng.integers(1, 9, cells.shape[1]), np.full(100, 1000), 77))
    x, y = sides
    got = sorted((i, j) for a, b in divergence_audit.met(x, y, most) for i, j in zip(a.tolist(), b.tolist()))
    assert got == sorted((i, j) for i in range(len(x.p)) for j in range(len(y.p)) if x.columns[i] == y.columns[j])
