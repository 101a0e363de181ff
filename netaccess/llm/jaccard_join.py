"""N-gram Jaccard join by T-occurrence search, returned as one component for each document.

A document's set is its distinct k-word shingles (64-bit hashes). Documents of equal sets form a class, and
only its least doc_id goes on. Shingles have one global order, rarest first, ties by hash: frequent
shingles are counted over all documents, and only the order, never the result, depends on how finely.
Two sets that reach the threshold share a shingle among the first n - ceil(t n) + 1 of each.

1. Every class posts these shingles. Of each posting list the document to which the shingle is rarest (the
   one with fewest changes in a group of near copies) is the hub, and the others are searched against it:
   as many pairs as postings, however long a list is.
2. A search takes a document and a chunk of candidates. It builds inverted lists over the document's
   shingles, merges the short ones with a heap, probes the long ones by binary search only for candidates
   that can still reach the required overlap (DivideSkip), and keeps those that do.
3. Links give components. Lists that still hold several give their pairs across components, which are
   searched in the same way; long lists are dealt into blocks, and each pair of blocks is searched as a whole,
   so that no list makes all its pairs. Blocks of the list's largest part meet those of other parts only, so a
   group that is one part already is not met again. Length and position filters come before any pair is made.
4. Two linked documents share a component. Within each component all classes are searched against all others in
   such blocks for the number of links; tasks return counts by document, not pairs.

Null and empty texts and texts without words have empty sets and are linked with nothing. Rows of one doc_id
count as one document with the least n_shingles first. Rows without doc_id stay alone, with a null
component. An empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from netaccess.graph.components import connected_components
from netaccess.llm.common import ascii_words, map_arrow, shingle_hashes
from netaccess.runtime import broadcast_if_small, discard, materialize, with_conf

HOT_SHINGLES = 1 << 18
FLUSH_SHINGLES = 8_000_000
CLASS_BROADCAST_ROWS = 1_000_000
CHUNK = 128
#: Texts that a task takes at once: batches lie in the JVM and in Python, whole.
BATCH_ROWS = 512
#: Posting lists of more documents than this are searched in blocks.
LONG_LIST = 256
QUERY, ENTRY, BOTH = 1, 2, 3


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def set_facts(docs: DataFrame, k: int) -> DataFrame:
    """Two kinds of rows: (doc_id, n, key) of every document, and (token, seen) of shingles met twice or more by a task."""
    schema = StructType([StructField("doc_id", LongType()), StructField("n", LongType()), StructField("key", BinaryType()), StructField("token", LongType()), StructField("seen", LongType())])

    def repeated(held: list[np.ndarray]) -> dict[str, list]:
        token, seen = np.unique(np.concatenate(held), return_counts=True)
        token, seen = token[seen > 1], seen[seen > 1]
        blank = [None] * len(token)
        return {"doc_id": blank, "n": blank, "key": blank, "token": token.view(np.int64), "seen": seen}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held, total = [], 0
        for batch in batches:
            n, key = [], []
            for value in batch["text"]:
                s = shingle_hashes(ascii_words(value.as_py()), k)
                n.append(len(s))
                key.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                held.append(s)
                total += len(s)
                if total >= FLUSH_SHINGLES:
                    yield repeated(held)
                    held, total = [], 0
            blank = [None] * len(n)
            yield {"doc_id": batch["doc_id"].to_pylist(), "n": n, "key": key, "token": blank, "seen": blank}
        if held:
            yield repeated(held)

    return map_arrow(narrow(docs), run, schema)


def hot_order(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (at most ``HOT_SHINGLES``, sorted) and their counts."""
    counts = materialize(facts.filter("seen is not null").groupBy("token").agg(F.sum("seen").alias("seen")).filter("seen >= 4"), "shingle-counts")
    powers = [4 << i for i in range(40)]
    sizes = counts.agg(*(F.sum((F.col("seen") >= p).cast("long")).alias(f"p{i}") for i, p in enumerate(powers))).first()
    floor = next(p for i, p in enumerate(powers) if (sizes[f"p{i}"] or 0) <= HOT_SHINGLES)
    got = counts.filter(F.col("seen") >= floor).toArrow()
    token, seen = got.column("token").to_numpy().view(np.uint64), got.column("seen").to_numpy()
    order = np.argsort(token)
    return token[order], seen[order]


def in_batches(df: DataFrame, tag: str) -> DataFrame:
    """``materialize`` for what runs Python over texts: in batches of ``BATCH_ROWS``."""
    with with_conf(df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)):
        return materialize(df, tag)


def least_overlap(n: int, percent: int) -> int:
    """ceil(n percent / 100): the overlap that a set of n needs with any partner."""
    return -(-n * percent // 100)


def postings(docs: DataFrame, k: int, percent: int, hot) -> DataFrame:
    """(token, doc_id, n, rank) for the first shingles of every document in the global order."""
    schema = StructType([StructField("token", LongType()), StructField("doc_id", LongType()), StructField("n", IntegerType()), StructField("rank", IntegerType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        token, seen = hot.value
        for batch in batches:
            tokens, ids, sizes, ranks = [], [], [], []
            for doc_id, value in zip(batch["doc_id"].to_pylist(), batch["text"]):
                s = shingle_hashes(ascii_words(value.as_py()), k)
                take = len(s) - least_overlap(len(s), percent) + 1
                if not len(s):
                    continue
                if len(token):
                    slot = np.searchsorted(token, s)
                    slot[slot == len(token)] = 0
                    s = s[np.argsort(np.where(token[slot] == s, seen[slot], 0), kind="stable")]
                tokens.append(s[:take].view(np.int64))
                ids.append(np.full(take, doc_id))
                sizes.append(np.full(take, len(s), np.int32))
                ranks.append(np.arange(take, dtype=np.int32))
            if tokens:
                yield {"token": np.concatenate(tokens), "doc_id": np.concatenate(ids), "n": np.concatenate(sizes), "rank": np.concatenate(ranks)}

    return map_arrow(docs, run, schema)


def divide_skip(hub: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Indices of the sets whose Jaccard similarity with the hub reaches percent / 100."""
    if not sets:
        return []
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    slot = np.searchsorted(hub, flat := np.concatenate(sets))
    slot[slot == len(hub)] = 0
    inside = hub[slot] == flat
    owner, slot = owner[inside], slot[inside]
    order = np.lexsort((owner, slot))
    owner, slot = owner[order], slot[order]
    first = np.searchsorted(slot, np.arange(len(hub) + 1))
    lengths = np.diff(first)
    need = least_overlap(len(hub), percent)
    n_long = min(need - 1, int(need / (0.01 * math.log2(max(2, lengths.max(initial=1))) + 1)))
    by_length = np.argsort(lengths, kind="stable")
    short, long = by_length[: len(hub) - n_long], np.sort(by_length[len(hub) - n_long :])
    merged = heapq.merge(*(owner[first[i] : first[i + 1]].tolist() for i in short if lengths[i]))
    found = []
    for candidate, run in groupby(merged):
        overlap = sum(1 for _ in run)
        if overlap < need - n_long:
            continue
        own = sets[candidate]
        if len(long):
            at = np.searchsorted(own, hub[long])
            at[at == len(own)] = 0
            overlap += int((own[at] == hub[long]).sum())
        if 100 * overlap >= percent * (len(hub) + len(own) - overlap):
            found.append(candidate)
    return found


def search(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (hub, doc_id) whose sets reach the threshold; hubs with many candidates are searched in chunks."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(sizes, "hub").select("hub", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("j"))
    zero, one = F.lit(0), F.lit(1).cast("long")
    own = dealt.select("hub", "j").distinct().select("hub", zero.alias("i"), "j", F.lit(QUERY).alias("role"), F.col("hub").alias("part"), F.col("hub").alias("doc_id"), one.alias("copies"))
    asked = own.union(dealt.select("hub", zero, "j", F.lit(ENTRY), F.col("doc_id"), F.col("doc_id"), one))
    return search_blocks(materialize(asked, "jaccard-asked"), docs, k, percent)


def dealt_blocks(rows: DataFrame) -> DataFrame:
    """Rows (hub, doc_id, part, copies, m: documents of the hub) dealt into blocks of about ``CHUNK``; each meets every block of its hub."""
    n = F.ceil(F.col("m") / CHUNK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    role = F.when(F.col("own") == F.col("other"), BOTH).when(F.col("own") < F.col("other"), QUERY).otherwise(ENTRY)
    return rows.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), role.alias("role"), "part", "doc_id", "copies")


def dealt_by_part(rows: DataFrame) -> DataFrame:
    """As ``dealt_blocks``, for pairs across parts: documents of a hub's largest part have blocks of their own, which meet only those of the others."""
    sizes = rows.groupBy("hub", "part").agg(F.count("*").alias("size"))
    most = sizes.groupBy("hub").agg(F.max(F.struct("size", "part")).alias("top"), F.sum("size").alias("all"))
    most = most.select("hub", F.col("top.part").alias("main"), F.col("top.size").alias("size"), "all")
    blocks = lambda n: F.ceil(n / CHUNK).cast("int")
    rows = rows.join(broadcast_if_small(most), "hub").withColumn("inside", F.col("part") == F.col("main"))
    # a hub of one part has no pairs across parts; blocks from 0 on are the others', blocks from n_others on the largest part's
    rows = rows.withColumn("n_others", blocks(F.col("all") - F.col("size"))).filter("n_others > 0").withColumn("n_all", F.col("n_others") + blocks(F.col("size")))
    hashed = F.xxhash64("doc_id")
    own = F.when(F.col("inside"), F.col("n_others") + F.pmod(hashed, F.col("n_all") - F.col("n_others"))).otherwise(F.pmod(hashed, F.greatest("n_others", F.lit(1)))).cast("int")
    meets = F.when(F.col("inside"), F.col("n_others")).otherwise(F.col("n_all"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    role = F.when(F.col("own") == F.col("other"), BOTH).when(F.col("own") < F.col("other"), QUERY).otherwise(ENTRY)
    return rows.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), role.alias("role"), "part", "doc_id", "copies")


def search_blocks(asked: DataFrame, docs: DataFrame, k: int, percent: int, count: bool = False) -> DataFrame:
    """Searches the queries of each block (hub, i, j) among its entries.

    Returns links (hub, doc_id) enough to join the parts that meet; with ``count`` every link is found, and rows
    are (doc_id, links): the copies of the documents linked with it in the block."""
    rows = docs.join(broadcast_if_small(asked, CLASS_BROADCAST_ROWS), "doc_id").select("hub", "i", "j", "role", "part", "doc_id", "copies", "text")
    rows = rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    schema = StructType([StructField("doc_id" if count else "hub", LongType()), StructField("links" if count else "doc_id", LongType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        at, queries, entries = None, [], []
        near = lambda s, t: 100 * min(len(s), len(t)) >= percent * max(len(s), len(t))

        def links() -> dict[str, list]:
            found: dict[str, list] = {"hub": [], "doc_id": []}
            joined: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := joined.get(x, x)) != x:
                    x = up
                return x

            for part, doc_id, s, _ in queries:
                others = [e for e in entries if root(e[0]) != root(part) and near(s, e[2])]
                for hit in divide_skip(s, [e[2] for e in others], percent):
                    found["hub"].append(doc_id)
                    found["doc_id"].append(others[hit][1])
                    joined[root(part)] = root(others[hit][0])
            return found

        def counts() -> dict[str, list]:
            held: dict[int, int] = {}
            for _, doc_id, s, copies in queries:
                # where a block meets itself each pair comes up twice and counts for the query alone
                others = [e for e in entries if e[1] != doc_id and near(s, e[2])]
                for hit in divide_skip(s, [e[2] for e in others], percent):
                    held[doc_id] = held.get(doc_id, 0) + others[hit][3]
                    if at[1] != at[2]:
                        held[others[hit][1]] = held.get(others[hit][1], 0) + copies
            return {"doc_id": list(held), "links": list(held.values())}

        for batch in batches:
            names = ("hub", "i", "j", "role", "part", "doc_id", "copies")
            for (*head, role, part, doc_id, copies), value in zip(zip(*(batch[n].to_pylist() for n in names)), batch["text"]):
                if head != at:
                    if at is not None:
                        yield counts() if count else links()
                    at, queries, entries = head, [], []
                entry = (part, doc_id, shingle_hashes(ascii_words(value.as_py()), k), copies)
                if role & QUERY:
                    queries.append(entry)
                if role & ENTRY:
                    entries.append(entry)
        if at is not None:
            yield counts() if count else links()

    return map_arrow(rows, run, schema)


def link_counts(classes: DataFrame, parts: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """rep, links: for each class with a linked one, the documents of other classes linked with each of its own."""
    placed = classes.join(parts.select(F.col("doc_id").alias("rep"), F.col("component").alias("hub")), "rep")
    sizes = placed.groupBy("hub").agg(F.count("*").alias("m"))
    rows = placed.join(sizes, "hub").select("hub", F.col("rep").alias("doc_id"), F.col("rep").alias("part"), "copies", "m")
    found = search_blocks(materialize(dealt_blocks(rows), "jaccard-blocks"), docs, k, percent, count=True)
    return found.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("links"))


def plausible(n: str, rank: str, hub_n: str, hub_rank: str, percent: int):
    """Length and position filters of a shared shingle; a linked pair passes both at the first shingle that it shares."""
    need = F.ceil(percent * (F.col(n) + F.col(hub_n)) / (100 + percent))
    return (100 * F.least(n, hub_n) >= percent * F.greatest(n, hub_n)) & (F.least(F.col(n) - F.col(rank), F.col(hub_n) - F.col(hub_rank)) >= need)


def jaccard_components(docs: DataFrame, k: int, percent: int, with_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) for every document; ``with_links`` adds n_links."""
    facts = in_batches(set_facts(docs, k), "shingle-facts")
    hot = docs.sparkSession.sparkContext.broadcast(hot_order(facts))
    facts = facts.filter("token is null").select("doc_id", "n", "key")
    named = facts.filter("key is not null and doc_id is not null").groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    classes = materialize(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "shingle-classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    members = narrow(docs).join(broadcast_if_small(reps, CLASS_BROADCAST_ROWS), "doc_id", "left_semi")

    posted = in_batches(postings(members, k, percent, hot), "shingle-postings")
    lists = posted.groupBy("token").agg(F.min(F.struct("rank", "doc_id", "n")).alias("head"), F.count("*").alias("length")).filter("length > 1")
    lists = lists.select("token", F.col("head.doc_id").alias("hub"), F.col("head.n").alias("hub_n"), F.col("head.rank").alias("hub_rank"))
    listed = materialize(posted.join(lists, "token"), "shingle-lists")
    discard(posted)
    pairs = listed.filter((F.col("doc_id") != F.col("hub")) & plausible("n", "rank", "hub_n", "hub_rank", percent)).select("hub", "doc_id").distinct()
    pairs = materialize(pairs, "jaccard-pairs")
    links = in_batches(search(pairs, members, k, percent), "jaccard-links")
    parts = materialize(connected_components(links, "hub", "doc_id"), "jaccard-parts").withColumnRenamed("node", "doc_id")

    placed = listed.select("token", "doc_id", "n", "rank").join(broadcast_if_small(parts, CLASS_BROADCAST_ROWS), "doc_id", "left")
    placed = materialize(placed.select("token", "doc_id", "n", "rank", F.coalesce("component", "doc_id").alias("part")), "jaccard-placed")
    discard(listed)
    lengths = placed.groupBy("token").agg(F.count("*").alias("m"), F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b")
    open_lists = materialize(lengths.select("token", "m"), "jaccard-open")
    long = open_lists.filter(F.col("m") > LONG_LIST)
    short = placed.join(open_lists.filter(F.col("m") <= LONG_LIST).select("token"), "token", "left_semi")
    other = short.select("token", *(F.col(c).alias(f"b_{c}") for c in ("doc_id", "n", "rank", "part")))
    across = short.join(other, "token").filter((F.col("doc_id") < F.col("b_doc_id")) & (F.col("part") != F.col("b_part")) & plausible("n", "rank", "b_n", "b_rank", percent))
    known = pairs.select(F.least("hub", "doc_id").alias("hub"), F.greatest("hub", "doc_id").alias("doc_id"))
    across = across.select(F.col("doc_id").alias("hub"), F.col("b_doc_id").alias("doc_id")).distinct().join(known, ["hub", "doc_id"], "left_anti")
    found = links.union(search(materialize(across, "jaccard-across"), members, k, percent))
    if not long.isEmpty():
        rows = placed.join(long, "token").select(F.col("token").alias("hub"), "doc_id", "part", F.lit(1).cast("long").alias("copies"))
        found = found.union(search_blocks(materialize(dealt_by_part(materialize(rows, "jaccard-long-lists")), "jaccard-long"), members, k, percent))
    found = in_batches(found, "jaccard-found")
    discard(placed)
    parts = materialize(connected_components(found, "hub", "doc_id"), "jaccard-parts").withColumnRenamed("node", "doc_id")

    known = classes.join(parts.withColumnRenamed("doc_id", "rep"), "rep", "left").select("rep", "key", "copies", F.coalesce("component", "rep").alias("component"))
    out = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")]
    if with_links:
        counts = in_batches(link_counts(classes, parts, members, k, percent), "jaccard-counts")
        known = known.join(counts, "rep", "left")
        out.append(F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"))
    known = known.drop("rep")
    alone = F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")
    return facts.select("doc_id", "n", alone).join(known, "key", "left").select(*out)


def keep_one(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of ``docs`` that are the least of their component; every column passes through."""
    dropped = jaccard_components(docs, k, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    dropped = broadcast_if_small(materialize(dropped, "jaccard-dropped"), CLASS_BROADCAST_ROWS)
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["doc_id"], "left_anti")
