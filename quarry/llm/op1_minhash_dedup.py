"""MinHash near-duplicates: bottom-k sketches of one hash function.

A document's set are the hashes of its distinct five-word shingles; its sketch
are the K smallest of them. Documents with equal sets are one class, which has a
number of its own, so copies cost one row each and make no pairs.

Overlaps come from inverted lists of the retained values. Two sets that are
similar enough share at least ``least_shared`` values of their sketches (but for
a chance of 1e-10 a pair), so it is enough that a class is listed under its
rarest values: those that remain if all but ``least_shared`` - 1 of the most
frequent are left out. Lines and passages that very many documents share drop
out by themselves, as long as a document has enough of its own.

Lists make pairs in two steps, so that a group of n near copies doesn't make n²:
1. each list's leader (its member whose values are the most frequent, as those
   of an original are) is paired with the other members; confirmed links merge
   classes into components;
2. members outside the component of the list's leader are paired with all
   members of other components: nothing is left out that could still link.
A pair must pass two bounds first. The first is exact: a set's shingles that some
other listed class has too are counted by ranges of their hashes; the
intersection of two sets is at most the sum, over the ranges, of the smaller
counts. The second estimates the Jaccard similarity from the sketch of the
union, with a margin as wide as above. What passes is confirmed on the full
sets: 100 * intersection >= 85 * union.

Components are made with alternating large and small stars; tables are written
to the shared folder between the rounds.

Defined cases: documents without words (or text) have an empty set and link with
nothing; rows without doc_id link with nothing, have no component_id and are
kept; rows that share a doc_id count as one document: their classes are joined
like linked ones, so that they have one component_id, also a row without words;
``one_of_each`` tells texts apart instead, so that no text is lost because its id has
another text with a copy; ties are decided by the smallest doc_id; empty tables
give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, own_columns, small_batches

SHINGLE = 5
K = 32
#: Links: 100 * intersection >= SIMILAR * union.
SIMILAR = 85
#: Ranges of hashes for the exact bound of a pair.
RANGES = 64
#: Members of a list that a task compares with those outside the component of the list's leader.
PART = 1024
#: The chance that sketches of similar sets share fewer values than asked for.
LOSS = 1e-10

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(63 - (RANGES - 1).bit_length())
_S29, _S32, _ONE = np.uint64(29), np.uint64(32), np.uint64(1)


def least_shared(k: int = K, similar: int = SIMILAR, loss: float = LOSS) -> int:
    """The largest t for which fewer than t of k draws fall into the intersection with a chance of
    at most ``loss`` (binomial, which is wider than drawing without putting back)."""
    p, total = similar / 100, 0.0
    for t in range(k + 1):
        total += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if total > loss:
            return max(t, 1)
    return k


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes (63 bits) of the shingles; of fewer words, the whole sequence as one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    s = np.full(n, np.uint64(width))
    for j in range(width):
        s = (s ^ h[j:j + n]) * _M1
        s ^= s >> _S29
    s *= _M2
    s ^= s >> _S32
    return np.unique(s >> _ONE)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64), pa.int64()))


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, key, n (set size), class (128-bit hash of the whole set, null if empty) and sketch (the k smallest) of every row (doc_id, key, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [shingle_set(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), _lists([s[:k] for s in sets])],
                ["doc_id", "key", "n", "class", "sketch"])

    return docs.mapInArrow(run, "doc_id long, key long, n long, class binary, sketch array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """rep and shingles (the full set) of every row (rep, class, text) whose text is of that class, and how many of them stand in each range."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            # an id may have other texts
            own = [(rep, s) for rep, c, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(shingle_set, b.column(2).to_pylist())) if xxhash.xxh128_digest(s.tobytes()) == c]
            ranges = [np.bincount(s >> _SHIFT, minlength=RANGES) for _, s in own]
            yield pa.RecordBatch.from_arrays([pa.array([rep for rep, _ in own], pa.int64()), _lists([s for _, s in own]), pa.array(ranges, pa.list_(pa.int32()))], ["rep", "shingles", "ranges"])

    return docs.mapInArrow(run, "rep long, shingles array<long>, ranges array<int>")


def inverted_lists(reps: DataFrame, k: int = K, similar: int = SIMILAR) -> DataFrame:
    """rep, v (a retained value under which rep is listed) and weight (how frequent rep's values are).
    Only values of two classes or more make lists."""
    few = math.floor(k * similar / 100)  # sets up to this size, and all those similar to them, are their own sketches
    shared = F.when(F.col("n") <= few, F.ceil(F.col("n") * similar / 100)).otherwise(F.least(F.lit(least_shared(k, similar)), F.size("sketch")))
    vals = reps.select("rep", (F.size("sketch") - shared + 1).cast("int").alias("listed"), F.size("sketch").alias("size"), F.explode("sketch").alias("v"))
    often = vals.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    each = vals.join(often, "v").groupBy("rep", "listed", "size").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("h"))  # at most k a row
    rest = F.col("listed") - (F.col("size") - F.size("h"))  # what the values of one class alone leave
    weight = F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    return (each.where(rest > 0).select("rep", weight.alias("weight"), F.slice("h", 1, F.greatest(rest, F.lit(0))).alias("h"))
            .select("rep", "weight", F.transform("h", lambda x: x["v"]).alias("under")).select("rep", "weight", "under", F.explode("under").alias("v")))


def within(n1, c1, r1, n2, c2, r2, similar: int = SIMILAR):
    """The exact bound for a pair: sizes n, and numbers of shingles that others have too, in all (c) and by range (r)."""
    def may(common):  # common * 100 >= (n1 + n2 - common) * similar
        return common * (100 + similar) >= (n1 + n2) * similar

    return may(F.least(c1, c2)) & may(F.aggregate(F.zip_with(r1, r2, lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x))


def shared_counts(sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """rep, n, c and r of the sets that can have a partner: a shingle that no other listed class has is in no intersection."""
    width = int(_SHIFT)
    alone = (sets.select("rep", F.explode("shingles").alias("x")).groupBy("x").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep = other")
             .groupBy("rep", F.shiftright("x", width).cast("int").alias("j")).agg(F.count("*").cast("int").alias("k"))
             .groupBy("rep").agg(F.sum("k").alias("alone"), F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("by")))  # RANGES entries at most
    n = F.size("shingles").cast("long")
    rest = F.when(F.col("by").isNull(), F.col("ranges")).otherwise(F.transform("ranges", lambda h, j: h - F.coalesce(F.try_element_at(F.col("by"), j), F.lit(0))))
    out = sets.join(alone, "rep", "left").select("rep", n.alias("n"), (n - F.coalesce("alone", F.lit(0))).alias("c"), rest.alias("r"))
    return out.where(F.col("n") * similar <= F.col("c") * 100).dropDuplicates(["rep"])


def confirmed(pairs: DataFrame, sets: DataFrame, k: int = K, similar: int = SIMILAR) -> DataFrame:
    """a, b of the pairs that the sketch of the union lets pass and the full sets confirm."""
    sketch = sets.select("rep", F.slice("shingles", 1, k).alias("s"))
    side = lambda t, x, col: t.select(F.col("rep").alias(x), F.col(col).alias(f"{col}_{x}"))
    both = pairs.join(side(sketch, "a", "s"), "a").join(side(sketch, "b", "s"), "b")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    in_both = F.size(F.array_intersect(F.array_intersect(union, "s_a"), "s_b"))
    likely = both.where(in_both >= F.when(F.size(union) < k, F.ceil(F.size(union) * similar / 100)).otherwise(F.lit(least_shared(k, similar)))).select("a", "b")
    full = likely.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return (full.withColumn("i", common)
            .where(F.col("i") * 100 >= (F.size("shingles_a") + F.size("shingles_b") - F.col("i")) * similar).select("a", "b").distinct())


def components(edges: DataFrame, s: Scratch, name: str) -> DataFrame:
    """rep, component (the smallest rep that it is linked with) of every rep in an edge (a, b).
    Large and small stars by turns, until nothing changes; no node's neighbours are gathered in one row."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: every larger neighbour of a node links to its smallest one; small: smaller neighbours and the node itself do
        sym = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        to = sym.join(least, "a")
        to = to.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else to.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return to.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now, before, k = s.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"), None, 0
    while (after := mark(now)) != before:
        before, k = after, k + 1
        now = s.table(star(star(now, True), False), f"{name}-{k}")
        s.drop(f"{name}-{k - 1}")
    return now.select(F.col("a").alias("rep"), F.col("b").alias("component")).union(now.select(F.col("b").alias("rep"), F.col("b").alias("component")).distinct())


def links(reps: DataFrame, docs: DataFrame, s: Scratch, k: int = K, similar: int = SIMILAR, known: DataFrame | None = None) -> DataFrame:
    """rep, component of the classes that are linked with another. ``known``: further links (a, b)."""
    lists = s.table(inverted_lists(reps, k, similar), "lists")
    listed = reps.select("rep", "class", "doc").join(lists.select("rep").distinct(), "rep", "left_semi")
    sets = s.table(full_sets(docs.join(listed, docs.doc_id == listed.doc).select("rep", "class", "text")), "sets")
    lists = s.table(lists.join(shared_counts(sets, similar), "rep"), "lists2")

    leaders = lists.groupBy("v").agg(F.max(F.struct("weight", "rep", "n", "c", "r")).alias("l"), F.count("*").alias("members")).where("members > 1")
    to_leader = (lists.join(leaders, "v").where(F.col("rep") != F.col("l.rep")).where(within(*map(F.col, ("n", "c", "r", "l.n", "l.c", "l.r")), similar))
                 .select(F.least("rep", "l.rep").alias("a"), F.greatest("rep", "l.rep").alias("b")).distinct())
    stars = s.table(to_leader, "stars")
    first = s.table(confirmed(stars, sets, k, similar), "first")
    merged = components(first, s, "merged")

    member = s.table(lists.join(merged, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "members")
    heads = (member.groupBy("v").agg(F.max(F.struct("weight", "rep", "component")).alias("l"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
             .where("lo <> hi"))
    # a list's members are dealt to tasks by parts, and each member outside its leader's component meets all parts
    mixed = member.join(heads.select("v", F.col("l.component").alias("head"), F.ceil(F.col("members") / PART).cast("int").alias("parts")), "v")
    left = mixed.where("component <> head").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("x")
    right = mixed.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).alias("y")
    # every pair once: under the first value that both are listed under, and by the smaller rep if both are outside the leader's component
    rest = left.join(right, (F.col("x.v") == F.col("y.v")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.component") != F.col("y.component"))
                     & ((F.col("y.component") == F.col("y.head")) | (F.col("x.rep") < F.col("y.rep")))
                     & (F.array_min(F.array_intersect("x.under", "y.under")) == F.col("x.v"))
                     & within(*map(F.col, ("x.n", "x.c", "x.r", "y.n", "y.c", "y.r")), similar))
    rest = rest.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    second = s.table(confirmed(s.table(rest, "rest"), sets, k, similar), "second")
    edges = first.union(second) if known is None else first.union(second).union(known)
    out = s.table(components(edges, s, "all"), "components")
    s.drop("lists", "lists2", "sets", "stars", "members", "rest", "first", "second")
    return out


def classes(docs: DataFrame, s: Scratch, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, text, key: a hash of the text), their rows (doc_id, key, n, class, sketch), and the
    classes: class, rep (their number), doc (their smallest doc_id), n and sketch."""
    text = F.col("text").cast("string")
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.alias("text"))
    rows = s.table(sketches(own, k), "sketches")
    one = rows.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return own, rows, s.table(one.withColumn("rep", F.monotonically_increasing_id()), "classes")


def same_id(rows: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between the classes of rows that share a doc_id; and doc_id, rep (one of its classes) of
    those that also have a row without words."""
    ids = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("class").alias("with"), F.count("*").alias("all"))
    several = rows.join(ids.where("lo <> hi").select("doc_id", "lo"), "doc_id").where("class IS NOT NULL AND class <> lo").select("class", "lo").distinct()
    of = reps.select("class", "rep")
    edges = several.join(of.withColumnRenamed("rep", "a"), "class").join(of.select(F.col("class").alias("lo"), F.col("rep").alias("b")), "lo").select("a", "b")
    part = ids.where("lo IS NOT NULL AND with < all").select("doc_id", F.col("lo").alias("class")).join(of, "class").select("doc_id", "rep")
    return edges, part


def near_duplicates(docs: DataFrame, k: int = K, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    s = Scratch(spark, "op1")
    own, rows, reps = classes(docs, s, k)
    edges, with_empty = same_id(rows, reps)
    edges, with_empty = s.table(edges, "same_id"), s.table(with_empty, "with_empty")
    linked = links(reps, own.where("doc_id IS NOT NULL"), s, k, similar, edges)
    smallest = linked.join(reps.select("rep", "doc"), "rep").groupBy("component").agg(F.min("doc").alias("id"))
    linked = linked.join(smallest, "component").select("rep", "id")
    found = reps.select("class", "rep", "doc").join(linked, "rep", "left").select("class", "rep", F.coalesce("id", "doc").alias("id"))
    rows = rows.select("doc_id", "n", "class")
    words = rows.where("class IS NOT NULL OR doc_id IS NULL").join(found.select("class", "id"), "class", "left").select("doc_id", "n", "id")
    none = (rows.where("class IS NULL AND doc_id IS NOT NULL").join(with_empty.join(found, "rep").select("doc_id", "id"), "doc_id", "left")
            .select("doc_id", "n", F.coalesce("id", "doc_id").alias("id")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("id"))
    return (words.union(none).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each(docs: DataFrame, k: int = K, similar: int = SIMILAR) -> DataFrame:
    """doc_id and key (xxhash64 of the text) of one text of each group of linked texts: the smallest doc_id, of its
    texts the smallest key. Texts without words are each a group, rows without doc_id are in none."""
    spark = docs.sparkSession
    small_batches(spark)
    s = Scratch(spark, "op1")
    own, rows, reps = classes(docs, s, k)
    linked = links(reps, own.where("doc_id IS NOT NULL"), s, k, similar)
    group = reps.select("class", "rep").join(linked, "rep", "left").select("class", F.coalesce("component", "rep").alias("group"))
    known = rows.where("doc_id IS NOT NULL").select("doc_id", "key", "class")
    words = known.where("class IS NOT NULL").join(group, "class").groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("one")).select("one.*")
    return words.union(known.where("class IS NULL").select("doc_id", "key").distinct())
