"""Benchmark passages in documents: SimHash windows, multi-index Hamming blocks, exact verification.

DataFrame and SQL functions only. Words are maximal runs of letters and digits,
lower-cased; shingles are sequences of five words, hashed to 64 bits.

1. Every document is shingled as a whole. A window of an item's size that shares
   no shingle with an item has similarity 0, so windows start where a shingle of
   some item stands: moving a window to its first shared shingle loses none of
   the shared ones. A start too near the end of the text moves back to the last
   window; a text shorter than the item is one window.
2. Shingles are numbered by occurrence: the second "a b c d e" of a window is
   another element than the first. Weighted Jaccard similarity, sum of minima
   over sum of maxima of multiplicities, then is that of two sets of distinct
   elements. A window's 64-bit SimHash takes a majority of its elements' bits.
3. Fingerprints are cut into eight blocks of eight bits. Two fingerprints within
   ``RADIUS`` = 23 differ in at most two bits in one of the blocks, so items are
   indexed under every block value at most two bits away, and a join by (size,
   block, value) finds every window within the radius.
4. A candidate counts if its weighted Jaccard similarity with the item is at
   least ``percent`` / 100. Only candidates are cut out of their documents again.

Elements that two sets of similarity 0.8 share are 89 % of each, so a bit of the
fingerprints differs with probability below 0.16 (mean 10, deviation 3) and the
radius leaves more than four deviations, whatever repeats.

The item side (shingles, block values) is broadcast after its rows have been
counted and found below a bound; beyond it the joins shuffle. The document
side is never grouped by shingle, so frequent shingles make no hot key.

Defined cases: null or empty texts, and texts or items without words, match
nothing; an item of fewer than five words is a single shingle of its length;
repeated rows of a document, and rows that share id and text, give one result;
rows with a null id are reported with a null id; items longer than 65,535
shingles are an error; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import stored, whole_text

RADIUS = 23
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
#: Rows of an item-side table up to which it is broadcast (some 100 MB at most); beyond it joins shuffle.
BROADCAST_ROWS = 1 << 21

_LANES = 0x0001000100010001


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _gram(w: Column, k: int) -> Column:
    """Hashes of all k-word sequences, in order."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))).otherwise(
        F.array().cast("array<bigint>")
    )


def _lane_sums(shingles: Column, k: int) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)))


def simhash(shingles: Column) -> Column:
    """Bit i is set if it is set in more than half of the shingles; sixteen sums hold four 16-bit counters each."""
    n = F.size(shingles)
    fingerprint = F.lit(0).cast("long")
    for k in range(16):
        lanes = _lane_sums(shingles, k)
        for lane in range(4):
            count = F.shiftrightunsigned(lanes, 16 * lane).bitwiseAND(F.lit(0xFFFF))
            bit = 1 << (k + 16 * lane)
            fingerprint = fingerprint.bitwiseOR(F.when(2 * count > n, F.lit(bit - (1 << 64) if bit >> 63 else bit)).otherwise(F.lit(0)).cast("long"))
    return fingerprint


def elements(shingles: Column) -> Column:
    """Distinct elements: every shingle's hash with the number of its occurrence."""
    ordered = F.array_sort(shingles)
    numbered = F.transform(ordered, lambda h, i: F.xxhash64(h, (i + 1 - F.array_position(ordered, h)).cast("long")))
    plain = F.transform(shingles, lambda h: F.xxhash64(h, F.lit(0).cast("long")))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), plain).otherwise(numbered)


def _block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _near_masks() -> list[int]:
    bits = range(BLOCK_BITS)
    return [sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(bits, r)]


def _item_side(df: DataFrame) -> DataFrame:
    """Broadcast after a check of the size; beyond the bound, a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find(docs: DataFrame, benchmark: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, item_id, window_start, n_shared, similarity, hamming``: each document's best window for each item it holds."""
    items = (
        benchmark.select(F.col(item_col).cast("long").alias("item_id"), words(whole_text(item_text_col)).alias("w"))
        .where("size(w) > 0")
        .withColumn("k", F.least(F.lit(shingle), F.size("w")))
        .withColumn("n", F.size("w"))
    )
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most ``shingle`` values
    if not lengths:
        lengths = [shingle]
    by_length = F.lit(None).cast("array<bigint>")
    for k in lengths:
        by_length = F.when(F.col("k") == k, _gram(F.col("w"), k)).otherwise(by_length)
    items = items.withColumn("grams", by_length).withColumn("item_elements", F.when(F.size("grams") < 1 << 16, elements(F.col("grams"))).otherwise(F.raise_error(F.lit("item too long")).cast("array<bigint>")))
    items = stored(items.select("item_id", "n", "k", "grams", "item_elements", simhash(F.col("item_elements")).alias("item_print")), "items")

    # Where an item's shingles stand, and the sizes of the windows to open there.
    anchors = _item_side(items.select("k", "n", F.explode("grams").alias("h")).distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    split = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    found = None
    for k in lengths:
        places = split.select("doc_id", "text_hash", F.size("w").alias("length"), F.posexplode(_gram(F.col("w"), k)).alias("pos", "h"))
        hits = places.join(anchors.where(F.col("k") == k), "h")
        start = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("length") - F.col("n")))
        some = hits.select("doc_id", "text_hash", "k", "n", start.alias("start"))
        found = some if found is None else found.unionByName(some)
    # A document's starts for one size; no more than the document has words.
    starts = stored(found.groupBy("doc_id", "text_hash", "k", "n").agg(F.collect_set("start").alias("starts")), "starts")
    chosen = starts.select("doc_id", "text_hash").distinct()
    small = chosen.count() <= BROADCAST_ROWS // 4
    keyed = texts.withColumn("text_hash", F.xxhash64("text"))
    held = keyed.join(
        F.broadcast(chosen.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))) if small else chosen.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")),
        keyed["doc_id"].eqNullSafe(F.col("d")) & (keyed["text_hash"] == F.col("t")),
        "left_semi",
    ).dropDuplicates(["doc_id", "text_hash"])
    held = stored(held.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), words(F.col("text")).alias("w")), "held")

    def cut(places: DataFrame) -> DataFrame:
        """``places`` (``doc_id, text_hash, k, places: array of (n, start, ...)``) with each place's elements."""
        grams = F.lit(None).cast("array<bigint>")
        for k in lengths:
            grams = F.when(F.col("k") == k, _gram(F.col("w"), k)).otherwise(grams)
        joined = places.join(held, places["doc_id"].eqNullSafe(held["d"]) & (places["text_hash"] == held["t"])).select("doc_id", "text_hash", "k", "places", grams.alias("all"))
        each = joined.select("doc_id", "text_hash", "k", "all", F.explode("places").alias("at")).select("doc_id", "text_hash", "k", "at.*", "all")
        grams = each.withColumn("grams", F.slice("all", F.col("start") + 1, F.col("n") - F.col("k") + 1)).drop("all")
        return grams.withColumn("elements", elements(F.col("grams"))).drop("grams")

    at = F.transform("starts", lambda x: F.struct(F.col("n").alias("n"), x.alias("start")))
    windows = cut(starts.select("doc_id", "text_hash", "k", at.alias("places")))
    windows = stored(windows.select("doc_id", "text_hash", "k", "n", "start", simhash(F.col("elements")).alias("window_print")), "windows")

    blocks = F.array(*(F.struct(F.lit(i).alias("block"), _block(F.col("item_print"), i).alias("value")) for i in range(BLOCKS)))
    masks = F.array(*(F.lit(m) for m in _near_masks()))
    index = (
        items.select("item_id", "n", "item_print", F.explode(blocks).alias("b"))
        .select("item_id", "n", "item_print", F.col("b.block").alias("block"), "b.value", F.explode(masks).alias("mask"))
        .select("item_id", "n", "item_print", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    )
    own = F.array(*(F.struct(F.lit(i).alias("block"), _block(F.col("window_print"), i).alias("value")) for i in range(BLOCKS)))
    probes = windows.select("doc_id", "text_hash", "k", "n", "start", "window_print", F.explode(own).alias("b")).select(
        "doc_id", "text_hash", "k", "n", "start", "window_print", F.col("b.block").alias("block"), F.col("b.value").alias("value")
    )
    near = (
        probes.join(_item_side(index), ["n", "block", "value"])
        .withColumn("hamming", F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print"))).cast("int"))
        .where(F.col("hamming") <= RADIUS)
        .select("doc_id", "text_hash", "k", "n", "start", "item_id", "hamming")
        .distinct()
    )
    candidates = cut(near.groupBy("doc_id", "text_hash", "k").agg(F.collect_list(F.struct("n", "start", "item_id", "hamming")).alias("places")))
    verified = (
        candidates.join(items.select(F.col("item_id").alias("i"), F.col("n").alias("m"), "item_elements"), F.expr("item_id <=> i and n = m"))
        .withColumn("n_shared", F.size(F.array_intersect("elements", "item_elements")))
        .withColumn("n_union", F.size("elements") + F.size("item_elements") - F.col("n_shared"))
        .where(F.col("n_shared") * 100 >= F.col("n_union") * percent)
    )
    # n_shared / n_union rises with n_shared and falls with the window's size, which the start alone decides.
    best = F.max(F.struct((F.col("n_shared") / F.col("n_union")).alias("similarity"), (-F.col("start")).alias("s"), (-F.col("hamming")).alias("h"), "n_shared"))
    return (
        verified.groupBy("doc_id", "text_hash", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "text_hash", "item_id", (-F.col("best.s")).cast("int").alias("window_start"), F.col("best.n_shared").cast("int").alias("n_shared"), F.col("best.similarity").alias("similarity"), (-F.col("best.h")).cast("int").alias("hamming"))
    )
