"""The Merkle manifest against plain Python: many rounds, ties, NULLs, copies, clashing columns."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from hearthlens.llm import merkle_manifest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, _tree long, _at string, leaf int"


def h(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    values = (doc_id, source, lang, n_chars, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def path(digests):
    """The root and, for each digest, what stands before and after it on each level."""
    beside = [[] for _ in digests]
    place = list(range(len(digests)))
    while len(digests) > 1:
        for i, p in enumerate(place):
            run = digests[p // 8 * 8 : p // 8 * 8 + 8]
            beside[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        digests = [h("".join(digests[i : i + 8])) for i in range(0, len(digests), 8)]
        place = [p // 8 for p in place]
    return digests[0], beside


def plainly(rows):
    by_lang = defaultdict(list)
    for r in rows:
        text = r[1]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
            text = "".join(c.lower() if c.isascii() else c for c in text)
        by_lang[r[2]].append((plain_leaf(r, r[1]), plain_leaf(r, text), r[0]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
    trees = [path([x[0] for x in by_lang[lang]]) for lang in langs]
    root, above = path([t[0] for t in trees])
    out = []
    for lang, (subroot, beside), rest in zip(langs, trees, above):
        for (own, shown, doc_id), own_path in zip(by_lang[lang], beside):
            folded = shown
            for before, after in own_path + rest:
                folded = h(before + folded + after)
            proof = h("".join(b + a for b, a in own_path + rest))
            out.append((doc_id, own, subroot, root, proof, folded, folded == root))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y", 3) for r in rows], COLUMNS)


def made(n, seed=1):
    rng = random.Random(seed)
    langs = [None, "", "de", "en", "é", "zz", *[f"l{i}" for i in range(9)]]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "ABC é ÀB", f"Text {i}", "x" * rng.randrange(3000)])
        lang = "en" if i % 3 else rng.choice(langs)
        rows.append((rng.randrange(n) if i % 20 else None, text, lang, rng.choice([None, "", "s"]), rng.choice([None, 3])))
    # A third of all rows are copies of one, so ids, languages and leaves repeat.
    return rows + rows[:1] * (n // 2)


@pytest.mark.parametrize(("n", "levels"), [(400, 1), (400, 2), (300, 4), (1, 4)])
def test_equals_plain_trees(spark, n, levels):
    rows = made(n)
    docs = frame(spark, rows)
    got = [tuple(r) for r in merkle_manifest.tampering_report(docs).collect()] if levels == 4 else None
    want = plainly(rows)

    def key(r):
        return (r[0] is not None, *[str(x) for x in r])

    if got:
        assert sorted(got, key=key) == sorted(want, key=key)
        assert n == 1 or {r[6] for r in got} == {True, False}
    stored = [r[:5] for r in want]
    got = merkle_manifest.proofs(docs, with_siblings=True, levels=levels).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(stored, key=key)
    # The siblings alone lead from the leaf to the root.
    for r in got[:50]:
        assert merkle_manifest.fold(r.leaf, r.befores, r.afters) == r.root and r.verified


def test_one_language_of_one_row_and_no_row(spark):
    rows = [(5, None, None, None, None)]
    (got,) = merkle_manifest.tampering_report(frame(spark, rows)).collect()
    assert tuple(got) == plainly(rows)[0] and got.root == got.subroot == got.leaf and got.proof_sha256 == h("")
    nothing = merkle_manifest.tampering_report(frame(spark, []))
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_long_text_and_presented_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, "Wind " * (400_000 if i == 3 else 2), "en", "s", 1) for i in range(20)]
    got = merkle_manifest.proofs(frame(spark, rows), presented={"n_chars": F.when(F.col("doc_id") == 4, 9).otherwise(F.col("n_chars"))})
    assert {r.doc_id for r in got.collect() if not r.verified} == {4}
