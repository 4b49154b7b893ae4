"""Exact set-similarity self-join on word shingles by universe partitioning.

A document's set are its distinct shingles. Two sets of Jaccard similarity
``T/100`` or more differ in at most H elements, where H follows from the size of
the smaller one. For each band of sizes the universe of shingles is hashed into
H + 1 segments; by the pigeonhole principle two linked sets agree in at least
one of them. What agrees is indexed as subsets: a segment's whole subset, and
in a part of the segments also its one-deletion neighbourhood (the subset less
one element), so that there a difference of one is found as well.

Allocation by cost: a set may leave out a segment whose subset is frequent if it
allows a difference of one in another segment, because (allowed difference + 1)
summed over its segments stays H + 1. A subset that all its sets leave out makes
no candidates.

A first pass over all documents counts the documents of every shingle. A shingle
that no other document has is in no intersection, so sets with fewer than T % of
shared shingles have no partner and need no index entries; that is exact, not a
sample. Equal sets are one node from then on.

Candidates of a subset's group are not expanded into all pairs: the group's hub,
the set that shares most subsets with others, meets all the others, and verified
links give components. The sets of a group's largest component are settled then;
the others seek the sets of the group that are in other components. Where few
seek, they meet these directly. Where many do, distances to the hub come first:
sketches bound them from below, and where the bound is small whole sets tell.
Since 1 - similarity is a metric, sets whose distances to the hub differ by more
than a link's are not linked. Thousands of sets can be similar to the hub and
to one another without being linked; those within ``NEAR`` of it meet by what
tells them from the hub: the distance of two sets is that of their differences
from the hub, and of two sets of different components at least one, say U, is
not linked with the hub. Then a link needs differences that share elements, at
least

    (q |dU| - r (|U| + |hub|)) / 2q    for U, and more than
    (q |dA| + r (|hub| - |A|)) / 2q    for its partner A,    q = 100 + T, r = 100 - T

of them, so by the prefix principle two linked sets share one of their rarest
differences. Only sets that do become pairs. A family of near sets has a hub in
each of its groups; they meet at the most central of these, once for each set,
and only those far from it stay at the others as well. Every link between different
components is found, and copies cost no more than their number.

Verification counts equal 64-bit shingle hashes of both whole sets.

Defined cases: null or empty texts, or texts without words, have an empty set and
are linked with nothing; with fewer words than a shingle, the whole sequence is
the one shingle; repeated rows are equal sets and share a component; a row with
a null id takes part, but a component is named by its smallest non-null id (null
if it has none); very long texts are read whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.llm.common import buckets, pack, ship, stored, tidied, tidy, unpack, whole_text
from lodegraph.llm.components import components
from lodegraph.llm.packed import Numbers, chunks, dealt, rows

#: A subset with more sets than this is frequent.
FREQUENT = 64
#: Up to so many sets of a group seek others directly.
DIRECT = 16
#: Distance to the hub up to which sets of groups with more meet by their differences from it.
NEAR = 0.4
#: Sets to rebuild are broadcast up to this many (some 15 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1 << 17
BAND_RATIO = 1.5
#: Classes of the smallest sketch.
SKETCH = 128
#: One segment in so many has a neighbourhood.
NEIGHBOURHOOD_SHARE = 12
#: Bytes of text in a chunk; a task's arrays take some 15 times as much.
CHUNK = 6 << 20

_SENT = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
_SETS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("alive", pa.bool_())])
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    n = len(words)
    if not n:
        return words
    k = min(n, size)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * _U(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i]
    return np.unique(mixed(h + _U(k)))


def _word_sets(texts: list[str], size: int) -> list[np.ndarray]:
    numbers = Numbers()
    found = [np.fromiter(map(numbers.__getitem__, t.encode("utf-8", "surrogatepass").lower().split()), np.int64) for t in texts]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
    return [shingle_set(hashes[f], size) for f in found]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    a, b = mixed(s + _U(0x1234567)).sum(dtype=np.uint64), mixed(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


# ---- pass 1: documents of each shingle -------------------------------------------------


def _send_shingles(batches, size: int, n_buckets: int):
    for key, held in chunks(batches, ("doc_id", "h", "text"), "text", CHUNK):
        sets = _word_sets(held["text"], size)
        counts = np.fromiter(map(len, sets), np.int64, len(sets))
        prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
        ids = np.array([-1 if d is None else d for d in held["doc_id"]], np.int64)
        known = np.array([d is not None for d in held["doc_id"]], np.uint8)
        flat = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets), dtype=np.uint32), counts)
        bucket = (flat % _U(n_buckets)).astype(np.int64)
        # 32 more bits: a chance collision only lets a set through that the index then examines.
        part = (flat // _U(n_buckets)) & _U((1 << 32) - 1)
        order = np.argsort((bucket.astype(np.uint64) << _U(32)) | part)
        bucket, part, doc = bucket[order], part[order], doc[order]
        doc = doc.astype(np.uint16) if len(sets) < 1 << 16 else doc
        sent = [(key, 0, key, pack(ids, known, np.array(held["h"], np.int64), counts, prints[:, 0].copy(), prints[:, 1].copy()))]
        edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
        for a, z in zip(edges, edges[1:]):
            steps = np.diff(part[a:z], prepend=_U(0))
            if steps.max() < 1 << 32:
                steps = steps.astype(np.uint32)
            sent.append((int(bucket[a]), 1, key, pack(np.array([len(sets)]), steps, doc[a:z])))
        for at in range(0, len(sent), 64):
            yield from rows(_SENT, sent[at : at + 64]).to_batches()


def _count_shared(table: pa.Table) -> pa.Table:
    """For every chunk: how many of each document's shingles in this bucket another document has, too."""
    tidy()
    found = [(c, unpack(b)) for k, c, b in zip(*(table.column(x).to_pylist() for x in ("kind", "chunk", "blob"))) if k == 1]
    if not found:
        return _SENT.empty_table()
    part = np.concatenate([np.cumsum(x[1], dtype=np.uint64) for _, x in found])
    order = np.argsort(part)
    ordered = part[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(part), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    sent, at = [], 0
    for chunk, (n_docs, steps, doc) in found:
        counts = np.bincount(doc[shared[at : at + len(steps)]], minlength=int(n_docs[0]))
        at += len(steps)
        sent.append((chunk, 2, 0, pack(counts.astype(np.uint32))))
    return rows(_SENT, sent)


def _decide(docs: pa.Table, answers: pa.Table, percent: int) -> pa.Table:
    tidy()
    held = [b for k, b in zip(docs.column("kind").to_pylist(), docs.column("blob").to_pylist()) if k == 0]
    if not held:
        return _SETS.empty_table()
    ids, known, h, counts, s1, s2 = unpack(held[0])
    shared = np.zeros(len(ids), np.int64)
    for blob in answers.column("blob").to_pylist():
        shared += unpack(blob)[0]
    alive = (counts > 0) & (100 * shared >= percent * counts)
    return pa.table([pa.array(ids, mask=known == 0), pa.array(h), pa.array(counts), pa.array(s1), pa.array(s2), pa.array(alive)], schema=_SETS)


# ---- pass 2: sets of the documents that can have partners --------------------------------


def _rebuild(batches, size: int):
    for b in batches:
        sid, out, sketches = [], [], []
        want = list(zip(b.column("s1").to_pylist(), b.column("s2").to_pylist()))
        texts, ids = b.column("text").to_pylist(), b.column("sid").to_pylist()
        for at in range(0, len(texts), 256):
            for i, s in enumerate(_word_sets(texts[at : at + 256], size), at):
                if fingerprint(s) == want[i]:  # texts of equal hash may differ
                    sid.append(ids[i])
                    out.append(s.tobytes())
                    sketches.append(sketch(s))
        yield pa.RecordBatch.from_arrays(
            [pa.array(sid, pa.int64()), pa.array(list(map(len, out)), pa.int32()), pa.array(out, pa.binary()), pa.array(sketches, pa.binary())],
            names=["sid", "bytes", "shingles", "sketch"],
        )


def bands(n: int, percent: int) -> list[tuple[int, int]]:
    """``(band, H)`` of the bands whose index a set of size n belongs to: as the smaller set or as the larger."""
    found, low, band = [], 1, 0
    while low <= n:
        high = max(low, int(np.ceil(low * BAND_RATIO)) - 1)
        if n <= high * 100 // percent:
            union = high * 100 // percent
            h = union - -(-percent * union // 100)
            if h:
                found.append((band, h))
        low, band = high + 1, band + 1
    return found


def subsets(s: np.ndarray, percent: int):
    """Index entries of a set: key, slot (segment of a band), deletion or whole subset, and the band's neighbourhoods."""
    keys, slots, deletions, spare = [], [], [], []
    for band, h in bands(len(s), percent):
        m = h + 1
        segment = (s % _U(m)).astype(np.int64)
        value = mixed(s ^ _U(0xA5A5A5A5A5A5A5A5))
        order = np.argsort(segment, kind="stable")
        segment, value = segment[order], value[order]
        padded = np.concatenate([[_U(0)], np.cumsum(value, dtype=np.uint64)])
        edges = np.searchsorted(segment, np.arange(m + 1))
        total = padded[edges[1:]] - padded[edges[:-1]]
        salt = mixed(np.arange(m, dtype=np.uint64) + _U(band << 40) + _U(99))
        keys.append(mixed(total ^ salt))
        slots.append(np.arange(m) + (band << 32))
        deletions.append(np.zeros(m, bool))
        free = max(1, m // NEIGHBOURHOOD_SHARE)
        some = segment < free  # segments with a neighbourhood
        keys.append(mixed((total[segment[some]] - value[some]) ^ salt[segment[some]]))
        slots.append(segment[some] + (band << 32))
        deletions.append(np.ones(int(some.sum()), bool))
        spare.append(np.full(m + int(some.sum()), free, np.int32))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32)
    return np.concatenate(keys), np.concatenate(slots), np.concatenate(deletions), np.concatenate(spare)


def _entries(batches, percent: int):
    for b in batches:
        ids = b.column("sid").to_pylist()
        for at in range(0, len(ids), 512):
            parts = [subsets(np.frombuffer(x.as_py(), np.uint64), percent) for x in b.column("shingles")[at : at + 512]]
            many = [len(p[0]) for p in parts]
            sid = np.repeat(np.array(ids[at : at + 512], np.int64), many)
            n = np.repeat(np.array([len(x.as_py()) // 8 for x in b.column("shingles")[at : at + 512]], np.int32), many)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)), pa.array(sid), pa.array(np.concatenate([p[1] for p in parts])), pa.array(np.concatenate([p[2] for p in parts])), pa.array(np.concatenate([p[3] for p in parts])), pa.array(n)],
                names=["key", "sid", "slot", "deletion", "spare", "n"],
            )


def sketch(s: np.ndarray) -> bytes:
    """How many elements fall into each class, up to 255; a power of two of classes, more for larger sets."""
    classes = SKETCH
    while classes * 2 < len(s):
        classes *= 2
    return np.minimum(np.bincount((s >> _U(24)).astype(np.int64) & (classes - 1), minlength=classes), 255).astype(np.uint8).tobytes()


def sketch_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of elements in which two sets differ; classes are merged to the smaller number."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(p), len(q))
    p, q = (np.minimum(v.reshape(-1, n).sum(axis=0, dtype=np.int64), 255) for v in (p, q))
    return int(np.abs(p - q).sum())


def _can_link(batches, percent: int):
    """Pairs whose sketches differ by no more than the sets of a link can."""
    for b in batches:
        kept = [
            sketch_difference(x, y) * (100 + percent) <= (nx + ny) // 8 * (100 - percent)
            for x, y, nx, ny in zip(*(b.column(c).to_pylist() for c in ("x", "y", "nx", "ny")))
        ]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _verify(batches, percent: int):
    for b in batches:
        kept = []
        for x, y in zip(b.column("x"), b.column("y")):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = _common(p, q)
            kept.append(100 * both >= percent * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _bounds(batches):
    """Lower bounds of the distances of sets to their hubs, by sketches."""
    for b in batches:
        d = []
        for x, y, nx, ny in zip(*(b.column(c).to_pylist() for c in ("x", "y", "nx", "ny"))):
            total, apart = (nx + ny) // 8, sketch_difference(x, y)
            d.append(1 - (total - apart) / (total + apart))
        yield pa.RecordBatch.from_arrays([b.column("hub"), b.column("sid"), b.column("cluster"), pa.array(d, pa.float64())], names=["hub", "sid", "cluster", "d"])


def _rings(batches, reach: float = NEAR):
    """Distances of sets to their hubs, and of those within ``reach`` what tells them from the hub."""
    for b in batches:
        n, m, d, delta = [], [], [], []
        for x, y in zip(b.column("x"), b.column("y")):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = _common(p, q)
            n.append(len(p))
            m.append(len(q))
            d.append(1 - both / (len(p) + len(q) - both))
            delta.append(np.setxor1d(p, q, assume_unique=True).view(np.int64) if d[-1] <= reach else np.zeros(0, np.int64))
        ends = np.cumsum([0, *map(len, delta)]).astype(np.int32)
        flat = np.concatenate(delta) if delta else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("hub"), b.column("sid"), b.column("cluster"), pa.array(n, pa.int32()), pa.array(m, pa.int32()), pa.array(d, pa.float64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["hub", "sid", "cluster", "n", "m", "d", "delta"],
        )


def _common(p: np.ndarray, q: np.ndarray) -> int:
    at = np.searchsorted(q, p)
    return int((q[np.minimum(at, len(q) - 1)] == p).sum())


def _links(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs that are links: sketches rule out most others, whole sets decide the rest.

    Both meet in joins by set, whose hot keys adaptive execution splits.
    """
    x = sets.select(F.col("sid").alias("a"), F.col("sketch").alias("x"), F.col("bytes").alias("nx"))
    y = sets.select(F.col("sid").alias("b"), F.col("sketch").alias("y"), F.col("bytes").alias("ny"))
    near = stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "nx", "ny").mapInArrow(tidied(lambda b: _can_link(b, percent)), "a long, b long"), "near")
    x = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    return stored(near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidied(lambda b: _verify(b, percent)), "a long, b long"), name)


def _allocated(entries: DataFrame) -> DataFrame:
    """``key, sid, probe, n, size`` of the groups that are left after allocation by cost.

    A segment with a neighbourhood can take a difference of one if none of its own
    entries is in a frequent group; a set leaves out as many of its frequent
    subsets, dearest first, as it has such segments. A frequent group needs no
    deletions then; sets that left it out stay as what others look up, and a group
    that all its sets leave out is not needed at all.
    """
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"), F.max((~F.col("deletion")).cast("int")).alias("whole")).where("size > 1 and whole = 1")
    grouped = stored(entries.join(sizes.select("key", "size"), "key"), "groups")
    rare = grouped.where(F.col("size") <= FREQUENT).select("key", "sid", F.lit(True).alias("probe"), "n", "size")
    dear = grouped.where(F.col("size") > FREQUENT)
    segment, band = F.col("slot").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("slot", 32)
    taken = dear.where(segment < F.col("spare")).groupBy("sid", band.alias("band")).agg(F.countDistinct("slot").alias("taken"))
    order = Window.partitionBy("sid", "band").orderBy(F.desc("size"), "slot")  # a set's own segments, at most H + 1
    whole = (
        dear.where("not deletion")
        .withColumn("band", band)
        .join(taken, ["sid", "band"], "left")
        .withColumn("probe", F.row_number().over(order) > F.col("spare") - F.coalesce("taken", F.lit(0)))
    )
    return stored(rare.unionByName(whole.select("key", "sid", "probe", "n", "size")), "candidates")


def _central(near: DataFrame, measured, percent: int) -> tuple[DataFrame, DataFrame]:
    """``near`` with the sets of neighbouring hubs at one of these, their centre, and pairs ``a, b`` of sets with new centres.

    A family of near sets has many hubs, and a set can be near to many of them. Every set chooses its hub with the most sets,
    and a hub's centre is the choice of most of its sets. Whatever is linked with a set within ``NEAR`` of the centre is within
    ``NEAR`` and a link's distance of it, so such a set meets all its partners of the hub there and leaves the hub; others stay
    at the hub as well. ``measured`` gives the rings of hubs and sets, with differences up to that reach.
    """
    many = near.groupBy("hub").agg(F.count("*").alias("many"))
    best = near.join(many, "hub").groupBy("sid").agg(F.max_by("hub", F.struct("many", -F.col("hub"))).alias("best"))
    votes = near.join(best, "sid").groupBy("hub", "best").agg(F.count("*").alias("votes"))
    centres = stored(votes.groupBy("hub").agg(F.max_by("best", F.struct("votes", -F.col("best"))).alias("centre")), "centres")
    moved = near.join(centres, "hub")
    wanted = moved.select(F.col("centre").alias("hub"), "sid", "cluster").distinct()
    had = near.join(wanted.select("hub", "sid"), ["hub", "sid"], "left_semi")
    reach = NEAR + 1 - percent / 100 + 1e-9
    new = stored(measured(wanted.join(near, ["hub", "sid"], "left_anti"), reach), "central")
    at_home = had.unionByName(new).where(F.col("d") <= NEAR).select(F.col("hub").alias("centre"), "sid")
    left = moved.where("centre <> hub").join(at_home, ["centre", "sid"], "left_anti").select(*near.columns)
    placed = had.unionByName(new.where((F.col("d") <= reach) & (F.col("hub") != F.col("sid"))))
    placed = placed.unionByName(left.join(wanted.select("hub", "sid"), ["hub", "sid"], "left_anti"))
    met = new.where((F.col("d") <= 1 - percent / 100 + 1e-9) & (F.col("hub") != F.col("sid")))
    return stored(placed, "placed"), met.select(F.greatest("sid", "hub").alias("a"), F.least("sid", "hub").alias("b"))


def _by_difference(near: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different clusters that are near one hub and share one of their rarest differences from it."""
    mixed_ = near.groupBy("hub").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high").select("hub")
    deltas = near.join(mixed_, "hub")
    each = deltas.select("hub", "sid", F.explode("delta").alias("e"))
    often = each.groupBy("hub", "e").agg(F.count("*").alias("f")).where("f > 1")  # what only one set has makes no pair
    several = each.join(often, ["hub", "e"]).groupBy("hub", "sid").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("several"))
    q, r = 100 + percent, 100 - percent
    size = F.size("delta")
    least_index = F.floor((r * (F.col("m") - F.col("n")) + q * size) / F.lit(2 * q)) + 1
    least_probe = F.greatest(F.lit(1), F.ceil((q * size - r * (F.col("n") + F.col("m"))) / F.lit(2 * q)))
    # The rarest differences come first, those of one set alone before the others.
    prefix = lambda least: F.slice("several", 1, F.greatest(F.lit(0), F.size("several") - least + 1).cast("int"))
    sorted_ = deltas.join(several, ["hub", "sid"])
    index = sorted_.select("hub", "sid", "cluster", "n", size.alias("d"), F.explode(prefix(least_index)).alias("s")).select("hub", F.col("s.e").alias("e"), "sid", "cluster", "n", "d")
    unlinked = q * size > r * (F.col("n") + F.col("m"))
    probe = sorted_.where(unlinked).select("hub", F.col("sid").alias("p"), F.col("cluster").alias("c"), F.col("n").alias("np"), size.alias("dp"), F.explode(prefix(least_probe)).alias("s"))
    probe = probe.select("hub", F.col("s.e").alias("e"), "p", "c", "np", "dp")
    close = (F.abs(F.col("d") - F.col("dp")) * q <= r * (F.col("n") + F.col("np"))) & _sizes_allow("n", "np", percent)
    met = index.join(probe, ["hub", "e"]).where((F.col("cluster") != F.col("c")) & close)
    return met.select(F.greatest("sid", "p").alias("a"), F.least("sid", "p").alias("b"))


def _sizes_allow(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _clusters(sets: DataFrame, percent: int) -> DataFrame:
    """``node, label`` of the sets that are linked with another one."""
    entries = sets.select("sid", "shingles").mapInArrow(tidied(lambda b: _entries(b, percent)), "key long, sid long, slot long, deletion boolean, spare int, n int")
    groups = _allocated(entries)
    # Round 1: the hub of every needed group meets the others.
    central = groups.groupBy("sid").agg(F.sum("size").alias("score"))
    hub = F.max_by(F.struct("sid", "n"), F.struct("score", -F.col("sid"))).alias("hub")
    hubs = groups.join(central, "sid").groupBy("key").agg(hub, F.max("probe").alias("needed")).where("needed")
    hubs = stored(hubs.select("key", F.col("hub.sid").alias("hub"), F.col("hub.n").alias("m")), "hubs")
    pairs = groups.join(hubs, "key").where((F.col("sid") != F.col("hub")) & _sizes_allow("n", "m", percent))
    links = _links(pairs.select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct(), sets, percent, "links")
    labels = components(links)

    # In every group the sets of its largest component are settled: they are linked with one another, and the others seek them.
    now = groups.join(labels, groups["sid"] == labels["node"], "left").select("key", "sid", "probe", "n", "size", F.coalesce("label", "sid").alias("cluster"))
    parts = now.groupBy("key", "cluster").agg(F.count("*").alias("k"), F.max("probe").alias("probes"))
    main = parts.groupBy("key").agg(F.max_by("cluster", F.struct("k", "cluster")).alias("main"), (F.sum("k") - F.max("k")).alias("seekers"), F.max("probes").alias("needed"))
    main = main.where("seekers > 0 and needed").select("key", "main", "seekers")
    open_ = stored(now.join(main, "key").withColumn("settled", F.col("cluster") == F.col("main")).drop("main"), "open")

    def met(rows: DataFrame, *more: str, close=F.lit(True)) -> DataFrame:
        """Sets that are not settled meet the others of their groups that sizes, and ``close``, allow."""
        seeking = rows.where("not settled").select(*(F.col(c).alias(f"_{c}") for c in ("key", "sid", "cluster", "probe", "n", *more)))
        looks_up = F.col("_probe") | (F.col("settled") & F.col("probe"))
        pairs = rows.join(seeking, (F.col("key") == F.col("_key")) & (F.col("cluster") != F.col("_cluster")) & looks_up & _sizes_allow("n", "_n", percent) & close)
        return pairs.select(F.greatest("sid", "_sid").alias("a"), F.least("sid", "_sid").alias("b"))

    wide = open_.where(F.col("seekers") > DIRECT).join(hubs, "key").where("sid <> hub")
    members = wide.select("hub", "sid", "cluster").distinct()

    def beside_hubs(rows: DataFrame, column: str) -> DataFrame:
        x = sets.select("sid", F.col(column).alias("x"), F.col("bytes").alias("nx"))
        y = sets.select(F.col("sid").alias("hub"), F.col(column).alias("y"), F.col("bytes").alias("ny"))
        return rows.join(x, "sid").join(y, "hub").select("hub", "sid", "cluster", "x", "y", "nx", "ny")

    bounds = stored(beside_hubs(members, "sketch").mapInArrow(tidied(_bounds), "hub long, sid long, cluster long, d double"), "bounds")

    def measured(members: DataFrame, reach: float) -> DataFrame:
        ddl = "hub long, sid long, cluster long, n int, m int, d double, delta array<long>"
        return beside_hubs(members, "shingles").mapInArrow(tidied(lambda b: _rings(b, reach)), ddl)

    rings = stored(measured(bounds.where(F.col("d") <= NEAR).drop("d"), NEAR), "rings")
    distances = rings.select("hub", "sid", "d").unionByName(bounds.where(F.col("d") > NEAR).select("hub", "sid", "d"))
    # Beyond NEAR a distance may be a lower bound.
    apart = (F.least("d", "_d") <= NEAR) & (F.abs(F.col("d") - F.col("_d")) > 1 - percent / 100 + 1e-9)
    far = (F.greatest("d", "_d") > NEAR) & ~apart
    near, centred = _central(rings.where(F.col("d") <= NEAR), measured, percent)
    pairs = met(open_.where(F.col("seekers") <= DIRECT)).unionByName(met(wide.join(distances, ["hub", "sid"]), "d", close=far)).unionByName(_by_difference(near, percent)).unionByName(centred)
    more = _links(pairs.distinct(), sets, percent, "links")
    return labels if more.isEmpty() else components(links.unionByName(more))


def join(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", members: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; with ``members`` also ``text_hash`` (xxhash64) and ``cluster``, a number
    that rows of one component share and others do not, also where ids repeat or are null (null: surely linked with nothing)."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("h"), whole_text(text_col).alias("text"))
    n = buckets(texts)
    ddl = "key int, kind int, chunk long, blob binary"
    sent = dealt(texts.mapInArrow(lambda b: _send_shingles(b, shingle, n), ddl), n)
    shared = dealt(sent.groupBy("key").applyInArrow(_count_shared, ddl), n)
    every = stored(
        sent.groupBy("key").cogroup(shared.groupBy("key")).applyInArrow(lambda d, a: _decide(d, a, percent), "doc_id long, h long, n long, s1 long, s2 long, alive boolean"), "sets"
    )
    # A set is rebuilt from one of its rows, one with an id if there is any.
    rows_of = every.where("alive").groupBy("s1", "s2", "n", "doc_id", "h").agg(F.count("*").alias("copies"))
    chosen = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "h", "copies")).alias("row")
    equal = rows_of.groupBy("s1", "s2", "n").agg(chosen).select("s1", "s2", "n", "row.doc_id", "row.h", "row.copies")
    nodes = stored(equal.withColumn("sid", F.monotonically_increasing_id()), "nodes")
    wanted = nodes.select(F.col("doc_id").alias("d"), F.col("h").alias("t"), "s1", "s2", "sid", "copies")
    if nodes.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = texts.join(wanted, (texts["h"] == wanted["t"]) & texts["doc_id"].eqNullSafe(wanted["d"])).select("sid", "s1", "s2", "copies", "text")
    # Rows that repeat id and text are one.
    repeated = found.where("copies > 1").groupBy("sid").agg(F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("text").alias("text"))
    found = found.where("copies = 1").select("sid", "s1", "s2", "text")
    if not nodes.where("copies > 1").isEmpty():
        found = found.unionByName(repeated)
    sets = stored(found.mapInArrow(tidied(lambda b: _rebuild(b, shingle)), "sid long, bytes int, shingles binary, sketch binary"), "shingles")
    labels = _clusters(sets, percent)
    of_node = nodes.join(labels, nodes["sid"] == labels["node"], "left").select("s1", "s2", "n", "doc_id", F.coalesce("label", "sid").alias("cluster"))
    smallest = of_node.groupBy("cluster").agg(F.min("doc_id").alias("component_id"))
    named = of_node.join(smallest, "cluster").select("s1", "s2", "n", "component_id", "cluster")
    alone = every.where("not alive").select("doc_id", "n", F.col("doc_id").alias("component_id"), "h", F.lit(None).cast("long").alias("cluster"))
    found = every.where("alive").join(named, ["s1", "s2", "n"]).select("doc_id", "n", "component_id", "h", "cluster").unionByName(alone)
    more = [F.col("h").alias("text_hash"), "cluster"] if members else []
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more)
