"""Personal data in texts: fixed patterns, and identifiers that their context gives away.

Bootstrapped contextual extraction: what the fixed patterns find are seed entities. The words before and after a seed make lexical
patterns. In rounds, a pattern is scored by how much of what stands in its slot is trusted, and an identifier by the patterns it
stands in; identifiers that trusted patterns agree on are found although no fixed pattern knows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import id_of, row_key, written

KINDS = ("email", "ip", "card", "phone")
#: Seeds of different text that a lexical pattern needs.
LEAST_SEEDS = 5
#: How much of a pattern's slot must be trusted.
LEAST_TRUST = 0.8
ROUNDS = 3
#: Slots that hold nothing known, added to a pattern's, so that few sightings convince little.
DOUBT = 1.0
#: One in so many documents is looked through first for patterns that already fail there.
FIRST_LOOK = 16
#: Most words between two patterns: a card of 19 digits with a blank after each.
MOST_WORDS = 19
#: What a word must have to be taken for an identifier by a pattern at one side alone, and to lend that pattern trust: a digit, or for
#: addresses another sign between letters.
_SHAPED = {k: "[0-9]" for k in KINDS} | {"email": r"[0-9]|[\p{L}_][^\p{L}\p{M}_\s'’-]+[\p{L}_]"}
_AHEAD, _BEHIND = r"^[(\[\"'<]+", r"[)\]\"'>.,;:!?]+$"

# The fixed patterns. A guard in front keeps a long run of characters from being tried anew at each of its places, and
# possessive repeats keep what cannot match otherwise from being tried again; neither changes what is found.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PATTERNS = dict(zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE)))
#: A character that every match of a kind has, to spare most texts the search.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Put around matches; a character that no text should have, and that no pattern matches.
_MARK = "\uFDD0"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, from the last on every second one doubled, add up to a multiple of ten."""
    split = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda d: d != "")), lambda d: d.cast("int"))

    def value(d: Column, i: Column) -> Column:
        double = d * 2
        return F.when(i % 2 == 1, F.when(double > 9, double - 9).otherwise(double)).otherwise(d)

    return F.aggregate(F.transform(split, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.regexp_like(match, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    count = F.length(_digits(match))
    if kind == "phone":
        return count.between(8, 15)
    return F.when(count.between(16, 19), _luhn(_digits(match))).otherwise(False)


def _matches(docs: DataFrame) -> DataFrame:
    """Every base match: ``_id _text kind start end match left right``, places in code points, the end exclusive.

    ``left`` and ``right`` are the patterns of the words next to those that the match touches, by the rule of :func:`_word_slots`;
    NULL where a side has fewer than two words. Each match is marked at both ends: the text parted by marks gives places, and
    the words that hold marks the numbers of the words touched.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK, "\uFFFD")
    texts = docs.select(*row_key(), text.alias("text"))
    kinds = []
    for kind in KINDS:
        marked = F.regexp_replace("text", _PATTERNS[kind], f"{_MARK}$0{_MARK}")
        kinds.append(F.when(F.regexp_like("text", F.lit(_NEEDS[kind])), marked).alias(f"_{kind}"))
    some = texts.select("*", *kinds).filter(" or ".join(f"contains(_{k}, '{_MARK}')" for k in KINDS))
    some = some.select("_id", "_text", _hashes(_words(F.col("text"))).alias("_hashes"), *[f"_{k}" for k in KINDS])
    each = some.select("_id", "_text", "_hashes", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("marked")) for k in KINDS])))
    each = each.filter(F.contains("marked", F.lit(_MARK)))
    numbers = F.transform(_words(F.col("marked")), lambda w, at: F.array_repeat(at, F.regexp_count(w, F.lit(_MARK))))
    each = each.select("_id", "_text", "kind", "_hashes", F.split("marked", _MARK, -1).alias("_pieces"), F.flatten(numbers).alias("_at"))
    # Pieces with odd numbers are matches.
    cells = F.transform(
        F.sequence(F.lit(1), F.size("_pieces") - 2, F.lit(2)),
        lambda i: F.struct(
            i.alias("i"),
            F.get("_pieces", i).alias("match"),
            F.length(F.get("_pieces", i - 1)).alias("gap"),
            F.when(F.get("_at", i - 1) >= 2, _left("_hashes", F.get("_at", i - 1))).alias("left"),
            F.when(F.get("_at", i) + 2 < F.size("_hashes"), _right("_hashes", F.get("_at", i))).alias("right"),
        ),
    )
    rows = each.select("_id", "_text", "kind", F.inline(cells)).distinct()
    # Copies of a row are one by now. The places add up along one text.
    along = Window.partitionBy("_id", "_text", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(along)
    found = rows.select("_id", "_text", "kind", "match", "left", "right", end.cast("long").alias("end"))
    valid = F.coalesce(*[F.when(F.col("kind") == k, _valid(k, F.col("match"))) for k in KINDS])
    return found.filter(valid).withColumn("start", F.col("end") - F.length("match"))


def _words(text: Column) -> Column:
    return F.split(text, r"\s+", -1)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _left(hashes: str, at: Column) -> Column:
    """The pattern that the two words before the word ``at`` make."""
    return F.xxhash64(F.lit("L"), F.get(hashes, at - 2), F.get(hashes, at - 1))


def _right(hashes: str, at: Column) -> Column:
    """The pattern that the two words after the word ``at`` make."""
    return F.xxhash64(F.lit("R"), F.get(hashes, at + 1), F.get(hashes, at + 2))


def _word_slots(docs: DataFrame) -> DataFrame:
    """Each word of each text with hashes of the two words before it and after it, and the word itself if it is shaped for any kind."""
    texts = docs.select(*row_key(), _words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_words"))
    hashed = texts.select("_id", "_text", "_words", _hashes(F.col("_words")).alias("_hashes"))
    cells = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 1),
        lambda i: F.struct(
            i.alias("at"),
            F.when(F.regexp_like(F.get("_words", i), F.lit(_SHAPED["email"])), F.get("_words", i)).alias("word"),
            _left("_hashes", i).alias("left"),
            _right("_hashes", i).alias("right"),
        ),
    )
    return hashed.select("_id", "_text", F.inline(cells))


def _seed_patterns(matches: DataFrame) -> DataFrame:
    """How often each seed (``instance``) stands at each ``pattern`` (hash of two words at a side) of its ``kind``."""
    seeds = matches.select("kind", F.xxhash64(F.lower("match")).alias("instance"), F.explode(F.array("left", "right")).alias("pattern"))
    return seeds.filter("pattern is not null").groupBy("kind", "pattern", "instance").agg(F.count(F.lit(1)).alias("times"))


def discovered(
    docs: DataFrame,
    matches: DataFrame,
    least_seeds: int = LEAST_SEEDS,
    least_trust: float = LEAST_TRUST,
) -> DataFrame:
    """What trusted patterns give away: ``_id _text kind start end``, also where a base match is.

    A pattern is two words next to a seed and the seed's kind. Its trust is the trusted part of all words, known or not, that stand in
    its slot anywhere in the corpus; so what stands next to everything convinces nobody. A pattern whose trust would be too low if all
    shaped words in its slot were identifiers takes no part; no other is left out.

    Between trusted patterns of a kind at both sides, all of the one to :data:`MOST_WORDS` words is an identifier, whatever it looks like.
    Next to one trusted pattern alone, it is the one word in its slot, if shaped for the kind. In scoring, an instance is likewise a shaped
    word, or all words between two patterns if each is shaped.
    """
    seeds = written(_seed_patterns(matches), "seeds")
    several = seeds.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("_seeds"), F.sum("times").alias("_known"))
    several = written(several.filter(F.col("_seeds") >= least_seeds), "patterns")
    if several.isEmpty():
        spans = "_id long, _text long, kind string, start long, end long"
        return docs.sparkSession.createDataFrame([], spans)

    def seen(slots: DataFrame, patterns: DataFrame) -> DataFrame:
        sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(n).alias("pattern")) for n in ("left", "right")])
        both = slots.select("_id", "_text", "at", "word", F.inline(sides))
        return both.join(patterns.select("pattern").distinct(), "pattern", "left_semi")

    # Words that may be identifiers, at every pattern. They are the most that can ever add to a pattern's seeds.
    some = seen(_word_slots(docs).filter("word is not null"), several).withColumn("word", _trimmed("word"))
    some = some.join(several.select("kind", "pattern"), "pattern")
    sightings = written(some.filter(_shaped("word")).withColumn("instance", F.xxhash64(F.lower("word"))), "sightings")
    candidates = sightings.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("_most"))
    several = written(several.join(candidates, ["kind", "pattern"], "left").fillna(0, ["_most"]), "bounded")

    def possible(patterns: DataFrame, totals: DataFrame) -> DataFrame:
        counted = patterns.join(totals, "pattern", "left").withColumn("_all", F.greatest("_all", "_known"))
        return counted.filter((F.col("_known") + F.col("_most")) / (F.col("_all") + DOUBT) >= least_trust)

    def count(sights: DataFrame) -> DataFrame:
        return sights.groupBy("pattern").agg(F.count(F.lit(1)).alias("_all"))

    # What a few documents hold is less than the whole, so a pattern that fails by their count fails. This spares counting, in all
    # documents, the many frequent pairs of words that stand next to some seed by chance.
    few = docs.filter(F.pmod(F.xxhash64(*row_key()), F.lit(FIRST_LOOK)) == 0)
    several = written(possible(several, count(seen(_word_slots(few), several))).drop("_all"), "patterns")
    hits = written(seen(_word_slots(docs), several).drop("word"), "hits")
    base = written(possible(several, count(hits)).select("kind", "pattern", "_known", "_all"), "base")
    hits = written(hits.join(base.select("kind", "pattern"), "pattern"), "hits")
    sightings = sightings.join(base.select("kind", "pattern"), ["kind", "pattern"], "left_semi")
    # Several shaped words between two patterns are one instance of both, instead of one word each.
    several_words = _instances(docs, _between(hits).filter("last > first"))
    ends = [F.struct(F.col(n).alias("pattern"), F.col(at).alias("at")) for n, at in (("left", "first"), ("right", "last"))]
    several_words = written(several_words.select("_id", "_text", "kind", F.inline(F.array(*ends)), "instance"), "several-words")
    one_word = sightings.join(several_words, ["_id", "_text", "kind", "pattern", "at"], "left_anti")
    edges = one_word.select("kind", "pattern", "instance").unionByName(several_words.select("kind", "pattern", "instance"))
    edges = edges.groupBy("kind", "pattern", "instance").agg(F.count(F.lit(1)).alias("times"))
    known = seeds.select("kind", "instance").distinct().withColumn("_seed", F.lit(1.0))
    edges = written(edges.join(known, ["kind", "instance"], "left"), "edges").filter("_seed is null")
    # What a pattern's seeds fill of its slots is trusted from the start.
    trust = base.withColumn("_trust", F.col("_known") / (F.col("_all") + DOUBT))
    for _ in range(ROUNDS):
        # An identifier is doubted only as far as all its patterns are.
        doubt = F.exp(F.sum(F.log(1 - F.least("_trust", F.lit(0.999)))))
        belief = edges.join(trust.select("kind", "pattern", "_trust"), ["kind", "pattern"]).groupBy("kind", "instance")
        belief = belief.agg((1 - doubt).alias("_belief"))
        # Only what is believed by now lends a pattern trust.
        more = edges.join(belief.filter(F.col("_belief") >= least_trust), ["kind", "instance"]).groupBy("kind", "pattern")
        more = more.agg(F.sum(F.col("times") * F.col("_belief")).alias("_more"))
        trust = base.join(more, ["kind", "pattern"], "left").withColumn(
            "_trust", F.least(F.lit(1.0), (F.col("_known") + F.coalesce("_more", F.lit(0.0))) / (F.col("_all") + DOUBT))
        )
        trust = written(trust.select("kind", "pattern", "_trust"), "trust")
    good = trust.filter(F.col("_trust") >= least_trust)
    whole = _between(hits.join(good, ["kind", "pattern"]))
    whole = written(whole.select("_id", "_text", "kind", "first", "last", "_trust"), "whole")
    single = sightings.join(good, ["kind", "pattern"]).select("_id", "_text", "kind", F.col("at").alias("first"), F.col("at").alias("last"), "_trust")
    covered = whole.groupBy("_id", "_text").agg(F.collect_list(F.struct("first", "last")).alias("_whole"))
    inside = F.exists("_whole", lambda w: (w["first"] <= F.col("first")) & (w["last"] >= F.col("last")))
    single = single.join(covered, ["_id", "_text"], "left").filter(~F.coalesce(inside, F.lit(False))).drop("_whole")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    chosen = whole.unionByName(single).groupBy("_id", "_text", "first", "last")
    chosen = chosen.agg(F.max_by("kind", F.struct("_trust", -F.array_position(kinds, F.col("kind")))).alias("kind"))
    return _places(docs, written(chosen, "chosen"))


def _trimmed(word: str) -> Column:
    return F.regexp_replace(F.regexp_replace(word, _AHEAD, ""), _BEHIND, "")


def _shaped(word: str | Column) -> Column:
    """Whether a word is shaped for the row's ``kind``."""
    return F.coalesce(*[F.when(F.col("kind") == k, F.regexp_like(word, F.lit(_SHAPED[k]))) for k in KINDS])


def _between(hits: DataFrame) -> DataFrame:
    """What stands between a left and the next right pattern of its kind: ``_id _text kind first last left right``, and the lesser ``_trust``.

    ``first`` and ``last`` are numbers of words. Stretches of a kind don't overlap: each pattern is next to the other.
    """
    trust = F.col("_trust") if "_trust" in hits.columns else F.lit(1.0)
    end = F.struct(F.col("at").alias("last"), F.col("pattern").alias("right"), trust.alias("_least"))
    # From the end of a text, with the right patterns of a word before its left one.
    back = Window.partitionBy("_id", "_text", "kind").orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumn("_end", F.last(F.when(F.col("side") == "right", end), ignorenulls=True).over(back))
    rows = rows.filter((F.col("side") == "left") & (F.col("_end.last") - F.col("at") < MOST_WORDS))
    start = F.struct(F.col("at").alias("first"), F.col("pattern").alias("left"), trust.alias("_own"))
    rows = rows.groupBy("_id", "_text", "kind", "_end").agg(F.max(start).alias("_start"))
    return rows.select("_id", "_text", "kind", "_start.*", "_end.*").withColumn("_trust", F.least("_own", "_least")).drop("_own", "_least")


def _instances(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """The stretches all of whose words are shaped for their kind, with ``instance``, the hash of the words."""
    each = stretches.groupBy("_id", "_text").agg(F.collect_list(F.struct("kind", "first", "last", "left", "right")).alias("_stretches"))
    texts = docs.select(*row_key(), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\s+", -1).alias("_words"))
    cells = F.transform(
        "_stretches",
        lambda s: F.struct(*[s[n].alias(n) for n in ("kind", "first", "last", "left", "right")],
                           F.slice("_words", s["first"] + 1, s["last"] - s["first"] + 1).alias("_inner")),
    )
    rows = texts.join(each, ["_id", "_text"]).select("_id", "_text", F.inline(cells))
    rows = rows.filter(F.forall("_inner", _shaped)).withColumn("_inner", F.array_join("_inner", " "))
    return rows.withColumn("instance", F.xxhash64(F.lower(_trimmed("_inner")))).drop("_inner")


def _places(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Where the chosen words stand. Only the documents that have any are read again."""
    texts = docs.select(*row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(chosen.select("_id", "_text").distinct(), ["_id", "_text"], "left_semi")
    parts = texts.select("_id", "_text", F.split("text", r"\s+", -1).alias("_words"), F.split("text", r"\S+", -1).alias("_blanks"))
    # With a blank at the start, the first word is empty and the first blank stands before it.
    lead = F.when(F.length(F.get("_words", F.lit(0))) == 0, 1).otherwise(0)
    cells = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 1),
        lambda i: F.struct(
            i.alias("at"),
            F.get("_words", i).alias("_word"),
            F.coalesce(F.length(F.get("_blanks", i - lead)), F.lit(0)).alias("_blank"),
        ),
    )
    rows = parts.select("_id", "_text", F.inline(cells)).distinct()
    along = Window.partitionBy("_id", "_text").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.when(F.length("_word") > 0, F.length("_word") + F.col("_blank")).otherwise(0)
    rows = rows.withColumn("_end", F.sum(whole).over(along))
    ends = F.array(*[F.struct(F.lit(n).alias("_is"), F.col(n).alias("at")) for n in ("first", "last")])
    found = rows.join(chosen.select("*", F.inline(ends)), ["_id", "_text", "at"])
    start = F.col("_end") - F.length(F.regexp_replace("_word", _AHEAD, ""))
    end = F.col("_end") - F.length("_word") + F.length(F.regexp_replace("_word", _BEHIND, ""))
    found = found.groupBy("_id", "_text", "kind", "first", "last").agg(
        F.max(F.when(F.col("_is") == "first", start)).cast("long").alias("start"),
        F.max(F.when(F.col("_is") == "last", end)).cast("long").alias("end"),
    )
    return found.filter("end > start").select("_id", "_text", "kind", "start", "end")


def spans(docs: DataFrame, **options) -> DataFrame:
    """All spans: ``_id _text kind start end base``, with those only their context gives away after the base ones.

    A discovered span that overlaps a base span is left out; base spans always stay.
    """
    matches = written(_matches(docs), "matches")
    base = matches.select("_id", "_text", "kind", "start", "end", F.lit(True).alias("base"))
    extra = discovered(docs, matches, **options).withColumn("base", F.lit(False))
    # Only documents that have discovered spans are looked through for overlaps.
    touched = base.join(extra.select("_id", "_text").distinct(), ["_id", "_text"], "left_semi").unionByName(extra)
    taken = touched.groupBy("_id", "_text").agg(F.collect_list(F.when(F.col("base"), F.struct("start", "end"))).alias("_base"))
    free = extra.join(taken, ["_id", "_text"]).filter(
        ~F.exists("_base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    )
    return base.unionByName(free.drop("_base"))


def span_report(docs: DataFrame, **options) -> DataFrame:
    """Per row: ``doc_id``, counts of base spans by kind, the digest of the base spans and the list of all.

    NULL texts count as empty; a document without any has zeros, the digest of the empty text and an empty list. Rows that
    agree in id and text have the same spans. Other columns are ignored; an empty table gives no rows.
    """
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    found = spans(docs, **options).withColumn("_n", number)
    item = F.struct("_n", "start", "end", "kind")
    # Digests are made of what one document has, which its text bounds.
    listed = found.groupBy("_id", "_text").agg(
        *[F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.collect_list(F.when(F.col("base"), item))).alias("_base"),
        F.sort_array(F.collect_list(item)).alias("_all"),
    )

    def text(items: str) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    listed = listed.select("_id", "_text", *[f"n_{k}" for k in KINDS], text("_base").alias("_base"), text("_all").alias("_all"))
    rows = docs.select(*row_key()).join(written(listed, "spans"), ["_id", "_text"], "left")
    nothing = F.lit("")
    return rows.select(
        id_of(F.col("_id")).alias("doc_id"),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("_base", nothing), 256).alias("base_sha256"),
        F.coalesce("_all", nothing).alias("spans"),
    )
