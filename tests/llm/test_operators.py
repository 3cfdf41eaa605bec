"""Each operator against plain Python, and on tables with NULLs, empty texts, repeats, ties and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hearthlens.llm import (
    best_fit_packing,
    language_id,
    line_dedup,
    mixing,
    permutation_index,
    pii,
    pivot_table_search,
    quality,
    simhash_dedup,
    suffix_dedup,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
CLASHING = ["_id", "_text", "_row", "_doc", "fingerprint", "kind", "_bin", "length", "rank", "source", "lang"]


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["en"] * len(CLASHING)) for r in rows], f"doc_id long, text string, {extra}")


LONG = "the sea and the wind of the north " * 4000
EDGE = [(None, None), (None, "a b c"), (1, ""), (1, "x\ny\nz\nw"), (2, "x\ny\nz\nw"), (2, "x\ny\nz\nw"), (3, LONG), (4, LONG), (5, " \n\n\t")]


@pytest.fixture(scope="module")
def edge(spark):
    return table(spark, EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_packing_keeps_every_token_once(spark, edge):
    tokenizer = Tokenizer.from_file(PATH)
    assert len(tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids) == 4
    texts = ["Ab  c's\n\n 12x_", "naïve “quotes” – ½ ²", "<|endoftext|> \x1c \x85 \xa0", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>", *[t for _, t in EDGE]]
    rows = table(spark, list(enumerate(texts)))
    packed = best_fit_packing.pack_documents(rows, PATH, 64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert n == 0 or r.length == 64
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]]))
        assert sum(r.length for r in pieces) <= 64
    assert best_fit_packing.pack_documents(edge, PATH).filter("piece = 0").count() == len(EDGE)


def test_packing_merges_groups(spark):
    rows = [(i, 0, 0, 1 + i * 37 % 100, i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, best_fit_packing.PIECES)
    packed = best_fit_packing.pack(pieces, 128, group_rows=50).collect()
    assert Counter(r.doc_id for r in packed) == Counter(range(3000))
    fills = Counter()
    for r in packed:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 128 and len(fills) <= 1.05 * len(best_fit_packing.best_fit(np.array([r[3] for r in rows]), 128)[2])


def test_packing_deals_equal_rows_apart(spark, monkeypatch, empty):
    rows = spark.createDataFrame([(None, 0, 0, 3, 9)] * 4000, best_fit_packing.PIECES)
    seen = []
    before = best_fit_packing.written

    def written(df, name):
        done = before(df, name)
        seen.append(done)
        return done

    monkeypatch.setattr(best_fit_packing, "written", written)
    packed = best_fit_packing.pack(rows, 1024, group_rows=100)
    first = seen[1].groupBy(F.shiftright("_bin", 24).alias("g")).count().collect()
    assert len(first) == 40 and max(r["count"] for r in first) < 200
    assert packed.count() == 4000
    assert best_fit_packing.pack_documents(empty, PATH).count() == 0


def test_fingerprint_words():
    assert simhash_dedup.fingerprint(None) == simhash_dedup.fingerprint(" \t\n") == 0
    assert simhash_dedup.fingerprint("A b") == simhash_dedup.fingerprint("a\x0bB ")
    assert simhash_dedup.fingerprint("É b") != simhash_dedup.fingerprint("é b")


@pytest.mark.parametrize("shard_rows", [20, 1000])
def test_links_equal_all_pairs(spark, shard_rows):
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            prints.add(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    # A tight group that has to be split.
    centre = rng.getrandbits(64)
    for _ in range(40):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3, 6))))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in sorted(prints)]
    df = spark.createDataFrame(signed, "fingerprint long")
    got = {r.fingerprint % (1 << 64): r._root % (1 << 64) for r in simhash_dedup._components(df, 3).collect()} if shard_rows == 1000 else None
    links = simhash_dedup.near_links(df, 3, shard_rows).collect()
    lead = {x: x for x in prints}

    def find(leaders, x):
        while leaders[x] != x:
            x = leaders[x]
        return x

    for a, b in links:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 3
        lead[find(lead, a)] = find(lead, b)
    true = {x: x for x in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                true[find(true, a)] = find(true, b)
    assert len({(find(lead, x), find(true, x)) for x in prints}) == len({find(true, x) for x in prints}) == len({find(lead, x) for x in prints})
    if got:
        assert len(set(got.values())) == len({find(true, x) for x in prints})


def test_near_duplicates_edges(edge, empty):
    found = simhash_dedup.near_duplicates(edge, 3, 3).collect()
    zero = [r for r in found if r.fingerprint == "0" * 16]
    assert len(found) == len(EDGE) and {r.component_id for r in zero} == {1} and len(zero) == 3
    assert {r.component_id for r in found if r.doc_id in (3, 4)} == {3}
    assert simhash_dedup.near_duplicates(empty).count() == 0
    kept = simhash_dedup.one_of_each(edge)
    assert kept.columns == edge.columns
    # The NULL id stands for its group; of equal rows one stays.
    texts = Counter(r.text for r in kept.collect())
    assert texts["x\ny\nz\nw"] == 1 and texts[LONG] == 1 and texts["a b c"] == 1
    assert simhash_dedup.one_of_each(empty).count() == 0


def removed_plainly(docs, length):
    seen, out = set(), []
    for doc_id, text in docs:
        raw = text.encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = [True] * length
            seen.add(raw[p : p + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram", [(20, 6), (20, 3), (9, 6), (25, 4)])
def test_repeats_equal_a_plain_search(spark, length, gram):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randrange(15, 60))) for _ in range(8)]
    docs = []
    for i in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("abcdé") for _ in range(30)) for _ in range(4)]
        docs.append((i, "".join(parts)))
    docs += [(40, docs[3][1]), (41, "ab" * 60), (42, ""), (43, "short"), (44, "z" * 90)]
    got = suffix_dedup.removal_report(table(spark, docs), length=length, gram=gram).collect()
    assert sorted(tuple(r) for r in got) == sorted(removed_plainly(docs, length))


def test_repeats_of_a_short_phrase_in_many_contexts(spark):
    """Its places share their first rank only, and pairs of ranks tell nearly all of them apart before whole strings are made."""
    rng = random.Random(5)
    words = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage, phrase = words(130), words(66)
    docs = [(i, words(90) + phrase + words(90)) for i in range(400)]
    docs += [(400 + i, words(40) + passage[:100 + i] + words(40)) for i in range(30)]
    frame = table(spark, docs)
    got = suffix_dedup.removal_report(frame).collect()
    assert sorted(tuple(r) for r in got) == sorted(removed_plainly(docs, 100))
    texts = suffix_dedup._texts(frame)
    _, firsts = suffix_dedup._ranked(texts, 100, 24)
    assert firsts.count() > 250
    left = suffix_dedup._rounds(suffix_dedup._stretches(texts, firsts, 100, 24), 100, 24)
    assert left.count() < 150


def test_places_of_joined_texts_are_those_of_each_text():
    rng = random.Random(11)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 99, 100, 0, 101, 500, 24, 1300, 100, 0)]
    size = np.array([len(t) for t in texts])
    data, begin = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    at, rank, first, last, text = suffix_dedup.sampled(data, size, 100, 24)
    reach = suffix_dedup.reached(data, first, last + 100, at - first)
    together = sorted(zip(text, at - begin[text], rank, first - begin[text], last - begin[text], reach))
    alone = []
    for i, one in enumerate(texts):
        raw = np.frombuffer(one, np.uint8)
        p, r, a, b, _ = suffix_dedup.sampled(raw, np.array([len(one)]), 100, 24)
        alone += zip([i] * len(p), p, r, a, b, suffix_dedup.reached(raw, a, b + 100, p - a))
    assert together == sorted(alone)
    assert sum(b - a + 1 for _, _, _, a, b, _ in together) == sum(max(0, n - 99) for n in size)


@pytest.mark.parametrize("gathered, share", [(40, 0.0), (40, 0.5), (10**6, 1.0)])
def test_places_are_settled_alike_however_they_are_dealt(gathered, share):
    """Which ranks count as heavy, and how many places a task gathers, changes no result; places move once, packed."""
    rng = np.random.default_rng(6)
    n = 3000
    place = {"rank": rng.integers(0, 40, n) ** 2, "reach": rng.integers(0, 3, n), "_id": rng.integers(-3, 60, n), "_tie": rng.integers(0, 2, n)}
    place = {c: v.astype(np.uint64 if c in ("rank", "reach") else np.int64) for c, v in place.items()}
    place["rank"][::3] = rng.integers(2000, 2**63, len(place["rank"][::3]))
    place |= {"first": rng.integers(0, 9, n).astype(np.int32), "last": np.arange(n, dtype=np.int32), "at": np.ones(n, np.int32)}
    heavy = np.unique(place["rank"])
    heavy = heavy[rng.random(len(heavy)) < share]
    packets = {}
    for k in range(0, n, gathered):
        batch = suffix_dedup._dealt({c: v[k : k + gathered] for c, v in place.items()}, 7, heavy)
        for part, packet in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            packets.setdefault(part, []).append(packet)
    whole, sharing = Counter(), set()
    for part in packets.values():
        got = suffix_dedup._unpacked(part, suffix_dedup._PLACE)
        later, firsts = suffix_dedup._settled(got, heavy)
        whole.update(zip(*(got[c][later].tolist() for c in ("_id", "_tie", "first", "last"))))
        sharing |= set(zip(*(got[c][firsts].tolist() for c in ("rank", "reach", "_id", "_tie", "first"))))
    rows = list(zip(*(place[c].tolist() for c in ("rank", "reach", "_id", "_tie", "first", "last"))))
    first = {}
    for rank, reach, *own in rows:
        first[rank, reach] = min(first.get((rank, reach), own[:3]), own[:3])
    reaches = Counter(rank for rank, _ in first)
    assert whole == Counter(tuple(r[2:]) for r in rows if list(r[2:5]) != first[r[:2]])
    assert sharing == {(*k, *own) for k, own in first.items() if reaches[k[0]] > 1 or k[0] in heavy}


def test_a_heavy_rank_and_a_heavy_passage_are_spread():
    """Of a passage that many documents repeat, a task sends one place on; the places of a rank in many contexts go to many parts."""
    n = 4000
    same = {"rank": np.full(n, 5, np.uint64), "_id": np.arange(n), "_tie": np.zeros(n, np.int64)}
    same |= {c: np.zeros(n, np.int32) for c in ("first", "last", "at")}
    alike = suffix_dedup._dealt(same | {"reach": np.full(n, 7, np.uint64)}, 40, np.zeros(0, np.uint64))
    got = suffix_dedup._unpacked(alike.column(1).to_pylist(), suffix_dedup._PLACE)
    assert (got["known"] == 0).sum() == 1 and got["_id"][got["known"] == 0].tolist() == [0]
    contexts = suffix_dedup._dealt(same | {"reach": np.arange(n).astype(np.uint64)}, 40, np.array([5], np.uint64))
    for batch in (alike, contexts):
        assert max(map(len, batch.column(1).to_pylist())) < 2 * sum(map(len, batch.column(1).to_pylist())) / 40


def test_spans_of_a_document_are_merged_wherever_they_come_from():
    rng = np.random.default_rng(7)
    n = 2000
    start = rng.integers(0, 3000, n)
    spans = {"_id": rng.integers(-2, 30, n), "_tie": rng.integers(-1, 2, n), "start": start, "end": start + rng.integers(1, 40, n)}
    packets = {}
    for k in range(0, n, 300):
        batch = suffix_dedup._span_packets({c: v[k : k + 300] for c, v in spans.items()}, 5)
        for part, packet in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            packets.setdefault(part, []).append(packet)
    got = {}
    for part in packets.values():
        rows = suffix_dedup._merged(suffix_dedup._unpacked(part, suffix_dedup._SPAN)).to_pylist()
        got |= {(r["_id"], r["_tie"]): [(s["start"], s["end"]) for s in r["spans"]] for r in rows}
    covered = defaultdict(set)
    for doc, tie, a, b in zip(*(spans[c].tolist() for c in spans)):
        covered[doc, tie] |= set(range(a, b))
    assert got.keys() == covered.keys()
    for doc, want in covered.items():
        assert [x for a, b in got[doc] for x in range(a, b)] == sorted(want)
        assert all(b < c for (_, b), (c, _) in zip(got[doc], got[doc][1:]))
    assert suffix_dedup._merged({c: v[:0] for c, v in spans.items()}).num_rows == 0


def test_strings_and_places_are_counted_without_a_sort(spark, monkeypatch):
    """Only the numbering of first places sorts its rows; aggregates and joins of places, windows and strings hash them."""
    plans = {}

    def kept(df, name, write=suffix_dedup.written):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(suffix_dedup, "written", kept)
    text = "a passage that is copied as a whole or in part, " * 3
    docs = table(spark, [(i, text[i % 7 :] + str(i) * 90 + text[: 120 + i]) for i in range(12)])
    suffix_dedup.repeated_spans(suffix_dedup._texts(docs))
    assert {"settled", "shared-pairs", "kept", "left", "first-strings", "spans"} <= set(plans)
    for name in ("settled", "shared-pairs", "kept", "left", "first-strings", "spans"):
        assert "Sort" not in plans[name], name


def test_repeats_edges(edge, empty):
    got = suffix_dedup.removal_report(edge).collect()
    assert len(got) == len(EDGE)
    assert [r.n_removed for r in got if r.doc_id == 4] == [len(LONG)]
    assert all(r.n_removed == 0 for r in got if r.doc_id != 3 and r.doc_id != 4)
    assert suffix_dedup.removal_report(empty).count() == 0


@pytest.mark.parametrize("at_once", [1, 2, 3, 7, 64])
def test_features_do_not_depend_on_how_a_text_is_cut(monkeypatch, at_once):
    texts = ["", "a", " ", "one two", " lead and trail ", "x" * 50, "ab  cd\n" * 9, "é" * 9 + " ü"]
    whole = [sorted(quality.features(t)) for t in texts]
    monkeypatch.setattr(quality, "BYTES_AT_ONCE", at_once)
    assert [sorted(quality.features(t)) for t in texts] == whole


def test_counts_of_long_texts_are_whole(spark):
    """A word more often than 16 bits can say still weighs by its count."""
    bucket, count = quality._counted("zq " * 70_000)
    assert count.max() == 70_000
    docs = table(spark, [(i, ("zq " * 70_000 if i % 2 else "good prose of its own ") + str(i)) for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    found = {r.doc_id: r.score for r in quality.scores(docs, quality.fit(docs, labels)).collect()}
    assert min(found[i] for i in range(1, 20, 2)) > max(found[i] for i in range(0, 20, 2))


def test_scores_equal_the_plain_average_and_softmax(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["fine", "prose", "buy", "now", "ünd"]) for _ in range(rng.randrange(0, 12))) for _ in range(30)]
    docs = table(spark, list(enumerate(texts)))
    model = quality.fit(docs, spark.createDataFrame([(i, int("buy" in t)) for i, t in enumerate(texts)], "doc_id long, quality int"))
    for row in quality.scores(docs, model).collect():
        buckets = quality.features(texts[row.doc_id])
        mean = [sum(float(model.vectors[b][k]) for b in buckets) / max(1, len(buckets)) for k in range(model.vectors.shape[1])]
        zero, one = (sum(m * float(w) for m, w in zip(mean, model.layer[c])) + float(model.bias[c]) for c in (0, 1))
        assert row.score == pytest.approx(math.exp(one) / (math.exp(zero) + math.exp(one)), abs=1e-4)


def test_lines(spark, edge, empty):
    rows = table(spark, [(1, "a\nb\nc\nd"), (2, "q\na\nb\nc\nr"), (3, "b\nc"), (4, "b\nc\nd\nb\nc\nd\n"), (None, None)])
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.line_report(rows).collect()}
    assert got == {1: (4, 0, "a\nb\nc\nd"), 2: (5, 3, "q\nr"), 3: (2, 0, "b\nc"), 4: (7, 6, ""), None: (1, 0, None)}
    done = line_dedup.dedup_lines(edge)
    assert done.columns == edge.columns and done.count() == len(EDGE)
    assert sorted((r.doc_id, r.text) for r in done.filter("doc_id in (1, 2)").collect()) == [(1, ""), (1, "x\ny\nz\nw"), (2, ""), (2, "")]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_language(spark, edge, empty):
    words = {"en": "the of and to in that is was for on", "fr": "le la les des une dans pour que est avec", "de": "der die und das nicht mit ein auf ist von", "es": "el los las una para que con del por como"}
    rng = random.Random(1)
    rows = []
    for i in range(200):
        lang = list(words)[i % 4]
        said = lang if i % 10 else "xx"
        rows.append((i, " ".join(rng.choice(words[lang].split()) for _ in range(30)), said, f"s{i % 3}"))
    rows += [(900, "", "en", "s0"), (901, None, None, None), (902, "漢字漢字漢字漢字漢字漢字", "zh", "s1"), (903, "12 34 !!", "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r._id: r for r in language_id.identify(language_id.document_evidence(docs)).collect()}
    assert all(found[i].language == list(words)[i % 4] and found[i].accepted for i in range(200))
    assert not any(found[i].accepted for i in (900, 901, 902, 903))
    kept = language_id.accepted_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 200
    assert language_id.accepted_documents(edge).columns == edge.columns
    assert language_id.accepted_documents(empty).count() == 0


def test_languages_are_those_that_are_declared(spark):
    words = {
        "est": "ja on ei see et ta kui oma aga ning siis oli", "es": "el los las una para que con del por como muy pero",
        "fry": "de it fan en is dat yn foar mei net om hy", "fr": "le la les des une dans pour que est avec sur pas",
        "pt": "o os uma para que com do por como mais mas foi",
    }
    rng = random.Random(2)
    # A third of the rows are in a language of three letters; regions don't part a language.
    langs = ["est", "est", "est", "es", "fry", "fr", "pt", "es-MX", "pt_BR"]
    rows = []
    for i in range(360):
        said = langs[i % 9]
        text = " ".join(rng.choice(words[said.replace("_", "-").split("-")[0]].split()) for _ in range(30))
        rows.append((i, text, said if i > 8 else "", "s"))
    rows += [(900, "wo wo wo", "rare", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    evidence = language_id.document_evidence(docs)
    assert language_id.declared_languages(evidence) == ("es", "est", "fr", "fry", "pt")
    found = {r._id: r for r in language_id.identify(evidence).collect()}
    assert all(found[i].language == langs[i % 9].replace("_", "-").split("-")[0] and found[i].accepted for i in range(360))
    none = language_id.identify(language_id.document_evidence(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert len(none) == 361 and not any(r.accepted for r in none)


def test_pages_carry_all_evidence(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").unionByName(
        spark.createDataFrame([(None, None, None), (5, "not a url", "<html lang=fr>")], "page_id long, url string, html string")
    )
    rows = language_id.page_evidence(pages).collect()
    assert {r.suffix for r in rows} >= {"com", "org", "net", ""} and {r.declared for r in rows} >= {"en", "fr", ""}
    assert not any("<" in r.text for r in rows)


def test_personal_data(spark, edge, empty):
    found = {"email": "a.b@c.de", "ip": "10.0.0.1", "card": "4111 1111 1111 1111", "phone": "+1 (555) 010-9999"}
    text = "Ünï {email}, {ip} or 256.1.1.1 or {card} or 4111 1111 1111 1112 or {phone}.".format(**found)
    rows = table(spark, [(1, text), (1, text), (2, "9" * 30000 + " " + "a" * 30000 + " " + "1.2." * 9000), (None, None)])
    got = [r for r in pii.span_report(rows).collect()]
    first = next(r for r in got if r.doc_id == 1)
    spans = ",".join(f"{k}:{text.index(v)}:{text.index(v) + len(v)}" for k, v in found.items())
    assert first.base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and first.spans == spans
    assert len(got) == 4 and next(r for r in got if r.doc_id is None).spans == ""
    assert pii.span_report(edge).count() == len(EDGE) and pii.span_report(empty).count() == 0


def test_context_gives_identifiers_away(spark):
    rows = [(i, f"noise {i * 7} here, please call support +1 555 010-{1000 + i} now or never") for i in range(30)]
    rows += [(100, "so please call support 0800-555 now or never"), (101, "lorem 0800-999 ipsum dolor sit 12")]
    got = {r.doc_id: r.spans for r in pii.span_report(table(spark, rows)).collect()}
    assert got[100] == "phone:23:31" and got[101] == ""


def test_context_gives_away_addresses_without_digits_and_spaced_numbers(spark):
    rows = [(i, f"noise {i * 7} here, please call support +1 555 010-{1000 + i} now or never") for i in range(30)]
    rows += [(50 + i, f"for more write to {'abcdefghij'[i % 10] * (1 + i // 10)}@corp.example or come by") for i in range(30)]
    texts = {
        100: ("please call support 0800 555 1234 now or never", "phone", "0800 555 1234"),
        101: ("for more write to jane.doe(at)corp or come by", "email", "jane.doe(at)corp"),
        102: ("for more write to <jane@localhost>, or come by", "email", "jane@localhost"),
        103: ("for more write to jane doe at corp or come by", "email", "jane doe at corp"),
        104: ("please write to jane@localhost today", "email", "jane@localhost"),
    }
    rows += [(i, text) for i, (text, _, _) in texts.items()] + [(200, "jane@localhost 0800 555 1234 now and then, write to")]
    got = {r.doc_id: r.spans for r in pii.span_report(table(spark, rows)).collect()}
    for i, (text, kind, found) in texts.items():
        assert got[i] == f"{kind}:{text.index(found)}:{text.index(found) + len(found)}"
    assert got[200] == ""


@pytest.mark.parametrize(
    "frame",
    ["noise {n} support ({x}) now or", "noise {n} support {x}, thanks a lot", "a " + "w" * 300 + " {x} " + "v" * 300 + " b"],
)
def test_seeds_teach_by_the_words_beside_theirs(spark, frame):
    # In brackets, before a comma, and beside words of any length.
    rows = [(i, frame.format(n="here,", x=f"+1 555 010-{1000 + i}")) for i in range(30)]
    text = frame.format(n="here,", x="0800-555")
    got = {r.doc_id: r.spans for r in pii.span_report(table(spark, [*rows, (100, text), (101, "some 0800-999 other words")])).collect()}
    assert f"phone:{text.index('0800-555')}:{text.index('0800-555') + 8}" in got[100].split(",") and got[101] == ""


def test_base_spans_equal_plain_matching(spark):
    def luhn(number):
        doubled = [d if n % 2 == 0 else d * 2 - 9 * (d > 4) for n, d in enumerate(map(int, reversed(number)))]
        return sum(doubled) % 10 == 0

    def digits(x):
        return re.sub("[^0-9]", "", x)

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
    }
    rng = random.Random(11)
    bits = ["a.b@c.de", "x@y", "@", "+1 (555) 010-9999", "+1", "10.0.0.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "999"]
    bits += [" ", "  ", "\n", ",", "(", "é", "😀", "\uFDD0", "word", "-", "."]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(600)]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 10000 as doc_id", "text").collect()]
    got = {r.doc_id: r for r in pii.span_report(table(spark, rows)).collect()}
    for i, text in rows:
        found = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(m.group())] for k, (p, valid) in kinds.items()]
        assert [got[i][f"n_{k}"] for k in kinds] == [len(f) for f in found], text
        assert got[i].base_sha256 == hashlib.sha256(",".join(sum(found, [])).encode()).hexdigest(), text


def test_a_pattern_of_few_seeds_counts_among_many(spark):
    rng = random.Random(6)
    rows = [(i, f"{rng.random():.9f}a b{i} +1 555 {100000 + i} c{i} d{i}") for i in range(2000)]
    rows += [(i, f"please ring desk +1 777 {100000 + i} until six pm") for i in range(5000, 5009)]
    rows += [(9000, "so ring desk 0800-555 until six")]
    got = {r.doc_id: r.spans for r in pii.span_report(table(spark, rows)).collect()}
    assert got[9000] == "phone:13:21" and got[5000] == "phone:17:30"


def test_quality(spark, edge, empty):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice("sun moon star wind rain snow".split()) for _ in range(40))) for i in range(150)]
    bad = [(i, " ".join(rng.choice("SUN!! MOON!! xx## ##".split()) for _ in range(40))) for i in range(150, 300)]
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = quality.classify(table(spark, good + bad), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == (r.doc_id < 150) for r in got if r.held_out]) > 0.95
    assert {r.score for r in quality.classify(edge, labels.limit(0)).collect()} == {0.5}
    scored = quality.classify(edge, labels)
    assert scored.count() == len(EDGE) and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(empty, labels).count() == 0


def test_mixture(spark, edge, empty):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 4 else f"small{i % 3}") for i in range(1200)] + [(5000, "", "empty"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture_report(docs, max_repeats=2.0, block_tokens=200).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    tokens, dealt = Counter(), Counter()
    for _, t, s in rows:
        tokens[s or ""] += len((t or "").split())
    for r in got:
        dealt[r.source] += r.n_tokens
    ratios = {s: dealt[s] / tokens[s] for s in tokens if tokens[s]}
    assert abs(max(ratios.values()) - 2) < 0.05 and abs(min(ratios.values()) - 1) < 0.01
    by_block = defaultdict(list)
    for r in got:
        by_block[r.block].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in by_block.values())
    mixed = mixing.mixed(docs, max_repeats=2.0, block_tokens=200)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in got)
    assert mixing.mixed(edge).count() >= len(EDGE) and mixing.mixed(empty).count() == 0


def test_exponent_meets_an_entropy(spark):
    totals = np.array([1000, 100, 10])
    sources = spark.createDataFrame([(str(t), int(t)) for t in totals], "_source string, _total long")
    alpha = mixing.exponent(sources, None, 0.9)
    w = totals**alpha / (totals**alpha).sum()
    assert abs(-(w * np.log(w)).sum() - 0.9) < 1e-9


def vectors(spark, extra=()):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 16)))]
    rows += [(600, rows[20][1]), (601, rows[20][1]), (20, rows[21][1]), (None, rows[1][1]), (602, None), (603, []), (604, [None] * 16)]
    rows += [(605, [float("nan")] * 16), (606, [float("inf")] * 16), (700, [0.0] * 16), *extra]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score int, rank int")


def brute(df, zero, change):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if r.vec_id is not None and r.embedding and None not in r.embedding]
    rows = [(i, change(v)) for i, v in rows if np.isfinite(v).all() and (zero or v.any())]
    out = []
    for n, (q, v) in enumerate(rows):
        if q % 20 == 0:
            others = [(i, float(v @ w)) for m, (i, w) in enumerate(rows) if m != n]
            out.append((q, sorted(others, key=lambda x: (-x[1], x[0]))[:20]))
    return out


def test_permutation_index_recall(spark):
    df = vectors(spark)
    got = defaultdict(set)
    for r in permutation_index.nearest(df, block_rows=300, block_queries=20).collect():
        got[r.query_id].add(r.vec_id)
    true = [(q, {i for i, _ in best}) for q, best in brute(df, False, lambda v: v) if q != 20]
    assert np.mean([len(got[q] & best) / 20 for q, best in true]) >= 0.9
    assert permutation_index.nearest(df.limit(0)).count() == 0


def test_permutation_index_recall_where_postings_decide(spark):
    rows = np.random.default_rng(8).normal(size=(6000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    # Two blocks, each far above the number that is scored at least.
    assert permutation_index.SHARE * len(rows) / 2 > 2 * permutation_index.LEAST
    got = defaultdict(set)
    for r in permutation_index.nearest(df).collect():
        got[r.query_id].add(r.vec_id)
    recall = []
    for q in range(0, len(rows), 20):
        scores = rows.astype(float) @ rows[q].astype(float)
        scores[q] = -np.inf
        recall.append(len(got[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def walked(postings, n, order):
    """The footrule closeness by the definition, one posting after the other."""
    gain = np.zeros(n, np.int32)
    for rank, pivot in enumerate(order.tolist()):
        rows, ranks = postings[pivot]
        gain[rows] += len(order) - np.maximum(ranks, rank)
    return gain


@pytest.mark.parametrize(("n", "n_pivots", "posted"), [(4096, 256, 64), (300, 300, 300), (5, 1, 1)])
def test_closeness_equals_a_walk_of_each_posting_and_takes_half_its_time(n, n_pivots, posted):
    rng = np.random.default_rng(5)
    order, asked = (np.argsort(rng.random((m, n_pivots)), axis=1)[:, :posted] for m in (n, 30))
    file = permutation_index.Postings(order, n_pivots)
    postings = [[x.astype(np.int32) for x in np.nonzero(order == p)] for p in range(n_pivots)]
    seconds = []
    for closeness in (file.closeness, lambda o: walked(postings, n, o)):
        times, found = [], None
        for _ in range(5):
            start = time.process_time()
            found = [closeness(o) for o in asked]
            times.append(time.process_time() - start)
        seconds.append((min(times), found))
    assert all((a == b).all() for a, b in zip(seconds[0][1], seconds[1][1]))
    if n == permutation_index.ROWS:
        assert seconds[0][0] < seconds[1][0] / 2


def test_top_k_is_exact(spark):
    # Equal rows, and rows that share an id.
    base = vectors(spark)
    some = [tuple(r)[:2] for r in base.filter("vec_id in (40, 60, 61)").collect()]
    df = vectors(spark, [some[0]] * 30 + [some[1]] * 2 + [(40, some[2][1])] * 3)
    got = pivot_table_search.nearest(df, block_rows=100, block_queries=20).collect()
    true = [(q, n + 1, i, int(s)) for q, best in brute(df, True, lambda v: np.floor(64 * v)) for n, (i, s) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(true)
    assert 700 in {r.query_id for r in got} and pivot_table_search.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("find", [pivot_table_search.nearest, permutation_index.nearest])
def test_vectors_of_different_lengths_are_refused(spark, find):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="from 2 to 3 components"):
        find(df)


def test_nearest_ties_and_equal_rows(spark):
    rows = [(20, [1.0, 0.0])] * 2 + [(i, [2.0, float(i % 3)]) for i in range(1, 20)] + [(20, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    true = [(q, n + 1, i, s) for q, best in brute(df, False, lambda v: v) for n, (i, s) in enumerate(best)]
    assert sorted(tuple(r) for r in permutation_index.nearest(df).collect()) == sorted(true)


def test_elimination_spares_most_vectors():
    rows = pq.read_table(f"{SMALL.replace('0.001', '0.1')}/embeddings.parquet").to_pandas()
    rows = np.floor(64 * np.stack([e for e in rows.embedding]).astype(float))
    ids = np.arange(len(rows))
    rng = np.random.default_rng(0)
    chosen = rows[rng.choice(len(rows), int(pivot_table_search.PIVOT_SHARE * rows.shape[1]), replace=False)]
    index = pivot_table_search.Table(chosen, ids, rows, 20)
    queries = ids[::20]
    found = list(index.search(queries, rows[queries], np.full(len(queries), -np.inf)))
    assert index.looked < 0.5 * len(rows) * len(queries)
    for q, (places, scores) in zip(queries, found):
        every = rows @ rows[q]
        every[q] = -np.inf
        assert places.tolist() == np.lexsort((ids, -every))[:20].tolist() and (scores == every[places]).all()
    # With the scores known from blocks before, fewer are left.
    before, index.looked = index.looked, 0
    list(index.search(queries, rows[queries], np.array([s[-1] for _, s in found])))
    assert index.looked < before


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert [len(corpus_pipeline.STAGES), rows.columns[:2]] == [5, ["doc_id", "piece"]]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
        assert kept.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    assert rows.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
