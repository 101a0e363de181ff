"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct shingles of ``width`` words as written; the queries take single words
(``BY_WORD``). A line is removed if an earlier line, in order of (doc_id, text hash, line number), has a Jaccard
similarity of at least ``percent`` / 100 on their token sets, whether that earlier line stays or not. The one
token of a line of fewer than ``width`` words is its whole sequence of words, so that it meets equal lines only.
Lines of fewer than ``least`` words stay; the queries take every line with a word (``EVERY_LINE``).

1. Tokens of every line are made once and written. They are counted by hash bucket over all lines and ordered
   within each line by the logarithm of their bucket's count, then by hash. Any order gives the same result;
   rare first is fast.
2. Lines with equal sets meet by hash and all but the first go. Of the others each posts its first
   n - ceil(t n) + 1 tokens with the line's length, the token's rank and a signature.
3. In the lists of every fourth token (by hash, so that near lines share most of theirs) all lines are tried
   against the line of the least doc_id, in long lists also against those of the least doc_id of a few parts by
   hash, as the first one may be unlike the rest. So pairs grow with the postings, not with their square, and of
   a group of near lines nearly all go.
4. Then whole lists are joined for the lines that still stay: the shorter line of a pair meets the longer one
   at one of its first n - ceil(2t/(1+t) n) + 1 tokens, and of each pair the later line must be one that stays.
   Length, position and signature filter pairs before any is made; the words of the rest are compared. The
   signature is 128 parities of token counts: each token in which two lines differ flips one bit.

Documents are told apart by doc_id and the hash of their text, so texts that share a doc_id lose only lines of
their own; rows equal in both count as one document, and rows without doc_id come before all others. Null and
empty texts have no lines to remove and stay as they are. Long texts and lines are taken whole. Empty tables
give an empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess.runtime import broadcast_if_small, discard, materialize

PERCENT = 80
WORDS = 5
EVERY_LINE = 1
BY_WORD = 1
BUCKET_BITS = 16
#: The first lines of the lists of one token in so many are tried before whole lists are joined.
SAMPLED = 4
#: Lists of more lines than this have a head in each of so many parts besides the first.
CROWDED, PARTS = 32, 8
CAPPED, RANK_CAPPED = (1 << 16) - 1, (1 << 15) - 1
#: Hashes do not shrink; packing them costs time only.
AS_THEY_ARE = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}
KEY = ("doc_id", "thash", "line")
#: Stands for no doc_id where only the order counts.
FIRST_ID = -(1 << 63)
BLANKS = "\t\x0b\f\r"


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, thash (with doc_id the document's name) and text of every row with a text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("thash"), text.alias("text")).filter("text <> ''")


def once(value: Column) -> Column:
    """The value, made once a row: the outer explode of one element keeps the optimiser from copying its making
    into every later use (an inner explode would itself add a filter that makes it again)."""
    return F.explode_outer(F.array(value))


def spaced(text: Column) -> Column:
    """The text with spaces for its other blanks, but for line ends; most texts have none and are only searched, once."""
    out = text
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return F.when(text.rlike(f"[{BLANKS}]"), out).otherwise(text)


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def token_table(docs: DataFrame, least: int, width: int) -> DataFrame:
    """uid (any number of its own), doc_id, thash, line and the distinct tokens of every line of at least ``least`` words, as 64-bit hashes."""
    rows = narrow(docs).select("doc_id", "thash", F.posexplode_outer(F.split(spaced(F.col("text")), "\n")).alias("line", "raw"))
    rows = rows.select("doc_id", "thash", "line", once(words_of(F.col("raw"))).alias("words")).filter(F.size("words") >= least)
    rows = rows.select("doc_id", "thash", "line", once(F.transform("words", lambda w: F.xxhash64(w))).alias("hashes"))
    tokens = F.col("hashes")
    if width > 1:
        run = ", ".join(f"hashes[i + {k}]" for k in range(width))
        tokens = F.expr(f"if(size(hashes) < {width}, array(xxhash64(hashes)), transform(sequence(0, size(hashes) - {width}), i -> xxhash64({run})))")
    return rows.select(F.monotonically_increasing_id().alias("uid"), *KEY, F.array_distinct(tokens).alias("tokens"))


def rarity_levels(tokens: DataFrame) -> Column:
    """An array literal: for each hash bucket, 4 log2 of the number of tokens of all lines in it."""
    bucket = F.col("token").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")
    found = tokens.select(F.explode("tokens").alias("token")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).toArrow()
    levels = [0] * (1 << BUCKET_BITS)
    for b, n in zip(found.column("bucket").to_pylist(), found.column("n").to_pylist()):
        levels[b] = min(127, int(4 * math.log2(1 + n)))
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")


def least_overlap(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def ordered_facts(tokens: DataFrame, percent: int) -> DataFrame:
    """uid, doc_id, thash, line, n, h (of the token set), sig and sig2, first (the tokens to post, rarest first)."""
    # the level in the high bits, the hash in the others: one number orders and names a token
    ordered = F.expr(f"sort_array(transform(tokens, h -> shiftleft(level[cast(h & {(1 << BUCKET_BITS) - 1} as int)], 56) | shiftrightunsigned(h, 8)))")
    flips = "aggregate(tokens, 0L, (s, h) -> {})"
    both, upper = (F.expr(flips.format(x)) for x in ("s ^ shiftleft(1L, cast(h & 63 as int))", "if(h & 64 = 0, s, s ^ shiftleft(1L, cast(h & 63 as int)))"))
    rows = tokens.withColumn("level", rarity_levels(tokens)).select(
        "uid", *KEY, F.size("tokens").alias("n"), both.alias("both"), upper.alias("sig2"), once(ordered).alias("ordered"))
    rows = rows.withColumn("sig", F.col("both").bitwiseXOR(F.col("sig2")))
    n = F.col("n")
    # a set that no set of another size can reach has met all its matches by hash
    alone = (least_overlap(n, percent) == n) & (F.floor(n * 100 / percent) == n)
    return rows.select("uid", *KEY, "n", F.xxhash64("ordered").alias("h"), "sig", "sig2", F.slice("ordered", 1, F.when(alone, 0).otherwise(n - least_overlap(n, percent) + 1).cast("int")).alias("first"))


def line_facts(docs: DataFrame, percent: int, least: int = WORDS, width: int = WORDS) -> DataFrame:
    return ordered_facts(token_table(docs, least, width), percent)


def postings(facts: DataFrame, percent: int, shorter: bool = False) -> DataFrame:
    """x (32 bits of the token, 16 of the line's length, 15 of the token's rank, 1 for lines that still stay), doc, uid, sig, sig2.

    ``shorter``: only the tokens at which a line meets lines of its own length or longer ones."""
    live = F.col("live") if "live" in facts.columns else F.lit(1)
    doc = F.coalesce("doc_id", F.lit(FIRST_ID))
    rows = facts.filter(F.size("first") > 0).select("uid", doc.alias("doc"), "n", live.alias("live"), "sig", "sig2", F.posexplode("first").alias("rank", "token"))
    if shorter:
        need = F.floor((2 * percent * F.col("n") + 99 + percent) / (100 + percent))
        # lengths beyond 16 bits are not told apart: such lines meet at all their tokens
        rows = rows.filter((F.col("n") >= CAPPED) | (F.col("rank") <= F.col("n") - need))
    n, rank = F.least("n", F.lit(CAPPED)).cast("long"), F.least("rank", F.lit(RANK_CAPPED)).cast("long")
    x = F.shiftleft("token", 32).bitwiseOR(F.shiftleft(n, 16)).bitwiseOR(F.shiftleft(rank, 1)).bitwiseOR(F.col("live").cast("long"))
    return rows.select(x.alias("x"), "doc", "uid", "sig", "sig2")


def token_of(x: str) -> Column:
    return F.shiftright(x, 32)


def length_of(x: str) -> Column:
    return F.shiftright(x, 16).bitwiseAND(F.lit(CAPPED))


def plausible(a: str, b: str, percent: int) -> Column:
    """Length, position and signature filters on two postings of a token; a matching pair passes each at its first shared token."""
    n = [length_of(f"{c}x") for c in (a, b)]
    left = [m - F.shiftright(f"{c}x", 1).bitwiseAND(F.lit(RANK_CAPPED)) for m, c in zip(n, (a, b))]
    need = F.floor((percent * (n[0] + n[1]) + 99 + percent) / (100 + percent))
    differ = [F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in ("sig", "sig2")]
    most = n[0] + n[1] - 2 * need
    # lengths beyond 16 bits are not told apart: such lines go on to be compared
    return (F.greatest(*n) >= CAPPED) | ((100 * F.least(*n) >= percent * F.greatest(*n)) & (differ[0] + differ[1] <= most) & (F.least(*left) >= need))


def to_try(a: str, b: str) -> Column:
    """Of two postings the one of the later document belongs to a line that still stays (within a document: one of them)."""
    return ((F.col(f"{a}doc") <= F.col(f"{b}doc")) & (F.col(f"{b}x") % 2 != 0)) | ((F.col(f"{b}doc") <= F.col(f"{a}doc")) & (F.col(f"{a}x") % 2 != 0))


def renamed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(prefix + c) for c in rows.columns))


def pairs_of(met: DataFrame, other: str) -> DataFrame:
    return met.select(F.least("uid", other).alias("a"), F.greatest("uid", other).alias("b")).distinct()


def verified(pairs: DataFrame, facts: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Written: uid of the later line of each pair (a, b) whose tokens reach the threshold: the words of both are compared."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    places = facts.select("uid", *KEY).join(wanted, "uid")
    places = materialize(places.groupBy("doc_id", "thash").agg(F.collect_list(F.struct("line", "uid")).alias("places")), "line-places")
    near = renamed(broadcast_if_small(places), "p_")
    held = narrow(docs).join(near, F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("thash") == F.col("p_thash")))
    held = held.select("doc_id", "thash", "p_places", once(F.split("text", "\n")).alias("lines"))
    held = held.select("doc_id", "thash", "lines", F.explode("p_places").alias("place"))
    held = held.select(F.col("place.uid").alias("uid"), F.struct("doc_id", "thash", F.col("place.line").alias("line")).alias("key"), F.expr("lines[place.line]").alias("raw"))
    held = held.select("uid", "key", once(words_of(spaced(F.col("raw")))).alias("words"))
    sets = F.array_distinct("words")
    if width > 1:
        run = ", ".join(f"words[i + {k}]" for k in range(width))
        sets = F.array_distinct(F.expr(f"if(size(words) < {width}, array(concat_ws(' ', words)), transform(sequence(0, size(words) - {width}), i -> concat_ws(' ', {run})))"))
    held = materialize(held.select("uid", "key", sets.alias("set")), "line-words")
    both = pairs.join(renamed(held, "a_"), F.col("a") == F.col("a_uid")).join(renamed(held, "b_"), F.col("b") == F.col("b_uid"))
    shared, total = F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set")
    # rows alike in doc_id and text are one document: a line is not later than itself; a join's condition makes
    # what it names twice twice, so the overlap stands in it once
    match = both.filter((F.col("a_key") != F.col("b_key")) & ((100 + percent) * shared >= percent * total))
    later = materialize(match.select(F.when(F.col("a_key") > F.col("b_key"), F.col("a")).otherwise(F.col("b")).alias("uid")).distinct(), "line-near")
    discard(held, places)
    return later


def repeats(facts: DataFrame) -> DataFrame:
    """uid of the lines whose token set an earlier line has as well."""
    doc = F.coalesce("doc_id", F.lit(FIRST_ID))
    several = facts.groupBy("h", "sig").agg(F.count("*").alias("lines"), F.min(doc).alias("doc")).filter("lines > 1").drop("lines")
    several = renamed(broadcast_if_small(materialize(several, "line-several")), "s_")
    alike = facts.join(several, (F.col("h") == F.col("s_h")) & (F.col("sig") == F.col("s_sig")))
    alike = materialize(alike.select("uid", F.struct(*KEY).alias("key"), "h", "sig", (doc > F.col("s_doc")).alias("later")), "line-alike")
    # only lines of the least doc_id (no doc_id, the least number) need the rest of their keys to be told apart
    ties = alike.filter("not later")
    firsts = materialize(ties.groupBy("h", "sig").agg(F.min("key").alias("key")), "line-firsts")
    firsts = renamed(broadcast_if_small(firsts), "f_")
    ties = ties.join(firsts, (F.col("h") == F.col("f_h")) & (F.col("sig") == F.col("f_sig")) & (F.col("key") > F.col("f_key")))
    return alike.filter("later").select("uid").union(ties.select("uid"))


def heads_of(posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """token and the columns of a head, written: the posting of the least doc of every list of two or more, and those of each part of a long list."""
    first = [F.min_by(c, "doc").alias(f"head_{c}") for c in ("x", "doc", "uid", "sig", "sig2")]
    heads = posted.groupBy(token_of("x").alias("token")).agg(*first, F.count("*").alias("length")).filter("length > 1")
    heads = materialize(heads, "line-heads")
    crowded = broadcast_if_small(heads.filter(F.col("length") > CROWDED).select("token"))
    dealt = posted.join(crowded, token_of("x") == F.col("token"), "left_semi").withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(PARTS)))
    others = materialize(dealt.groupBy(token_of("x").alias("token"), "part").agg(*first).drop("part"), "line-heads")
    return heads, others


def removed_lines(docs: DataFrame, percent: int = PERCENT, least: int = WORDS, width: int = WORDS) -> DataFrame:
    """doc_id, thash, line of every line that an earlier line matches."""
    tokens = materialize(token_table(docs, least, width), "line-tokens", **AS_THEY_ARE)
    facts = materialize(ordered_facts(tokens, percent), "line-facts", **AS_THEY_ARE)
    discard(tokens)
    equal = materialize(repeats(facts), "line-equal")
    single = facts.join(broadcast_if_small(equal), "uid", "left_anti")

    sampled = postings(single, percent).filter(token_of("x") % SAMPLED == 0)
    heads, others = heads_of(sampled)
    tried = broadcast_if_small(heads.drop("length").union(others))
    met = sampled.join(tried, (token_of("x") == F.col("token")) & (F.col("uid") != F.col("head_uid")) & plausible("head_", "", percent))
    pairs = materialize(pairs_of(met, "head_uid"), "line-pairs")
    discard(heads, others)
    near = verified(pairs, facts, docs, percent, width)

    gone = renamed(broadcast_if_small(near), "gone_")
    single = single.join(gone, F.col("uid") == F.col("gone_uid"), "left").withColumn("live", F.col("gone_uid").isNull().cast("int")).drop("gone_uid")
    short, long = renamed(postings(single, percent, shorter=True), "short_"), postings(single, percent)
    n, short_n = length_of("x"), length_of("short_x")
    ordered = (short_n < n) | ((short_n == n) & (F.col("short_uid") < F.col("uid")))
    met = long.join(short, (token_of("x") == token_of("short_x")) & ordered & to_try("short_", "") & plausible("short_", "", percent))
    more = materialize(pairs_of(met, "short_uid"), "line-more")
    gone = equal.union(near).union(verified(more, facts, docs, percent, width)).distinct()
    return facts.select("uid", *KEY).join(gone, "uid").drop("uid")


def with_clean_text(docs: DataFrame, percent: int, least: int, width: int) -> DataFrame:
    """The columns of ``docs``, then n_removed (null: none) and the text without removed lines, under names of their own."""
    gone = removed_lines(docs, percent, least, width).groupBy("doc_id", "thash").agg(F.collect_list("line").alias("lines"))
    gone = renamed(broadcast_if_small(materialize(gone, "line-removed")), "__line_dedup_")
    text = docs["text"].cast("string")
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__line_dedup_doc_id"]) & (F.xxhash64(text) == gone["__line_dedup_thash"]), "left")
    lines, removed = F.split(text, "\n"), gone["__line_dedup_lines"]
    # the index of filter: a lambda that named the lines would split the text again for every line
    stay = F.filter(lines, lambda _, i: ~F.array_contains(removed, i))
    clean = F.when(removed.isNull(), text).otherwise(F.array_join(stay, "\n"))
    return joined.select(*(docs[c] for c in docs.columns), F.size(removed).alias("__line_dedup_n"), once(clean).alias("__line_dedup_clean"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, least: int = WORDS, width: int = WORDS) -> DataFrame:
    """``docs`` with its text, and n_chars where it is a column, after removal."""
    clean = with_clean_text(docs, percent, least, width)
    values = {"text": F.col("__line_dedup_clean"), "n_chars": F.length("__line_dedup_clean").cast("long")}
    return clean.select(*(values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns))


def line_report(docs: DataFrame, percent: int = PERCENT, least: int = WORDS, width: int = WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 (of the cleaned text; null: empty) for every document."""
    clean = with_clean_text(docs, percent, least, width)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    n_removed = F.when(F.col("__line_dedup_n") > 0, F.col("__line_dedup_n")).otherwise(0).cast("long")
    return clean.select(
        F.col("doc_id").cast("long").alias("doc_id"), n_lines.cast("long").alias("n_lines"),
        n_removed.alias("n_removed"), F.sha2(F.coalesce("__line_dedup_clean", F.lit("")), 256).alias("text_sha256"),
    )
