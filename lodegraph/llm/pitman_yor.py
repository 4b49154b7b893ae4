"""Language-model scores by a hierarchical Pitman-Yor process.

The hierarchy has a restaurant for each context word, all of which share one
parent, the unigram restaurant, whose base is uniform over the vocabulary and
one unknown word. Every word that a training token follows has a context
restaurant; after any other word the parent predicts alone.

Seating is sampled by Gibbs sweeps. In a sweep, the customers of one dish in one
restaurant are seated anew given everybody else: with ``c`` customers, the
number of tables ``t`` has the conditional weight

    (A | d)_t * parent(w)^t * S_d(c, t),    A = strength + d * other tables

where ``S_d`` are generalised Stirling numbers. It is drawn from these weights
for every ``c``: up to ``EXACT`` customers with the numbers by recurrence, beyond
by a contour integral, since

    S_d(c, t) = c! / (t! d^t) * [z^c] (1 - (1 - z)^d)^t

(logarithms to about 1e-7, see the tests). Each table sends one customer to the
parent. Sweeps are synchronous: the tables of the
other dishes and the parent's probabilities are those after the last sweep. The
predictive probabilities are averaged over the last ``SAMPLES`` sweeps.

Data flow: chunks of whole documents send each distinct word once to the bucket
of its hash, which numbers the words of the training texts, frequent ones first,
and adds up their counts. With these numbers a chunk sends each distinct
(context, word) once, with its training count, to the word's bucket; numbers of
neighbouring contexts differ little, so a pair takes some two bytes. A bucket
holds the seating of its words in all restaurants and their parent's customers.
The totals of a restaurant are kept apart, in the part of its context's number:
after each sweep buckets send their contexts' tables to the parts, which add
them up and answer the buckets that asked. Seats are drawn from seeds, and
numbers follow from counts and words alone, so a lost task does as before.
Probabilities return to the chunks, where token positions sum them up. All
training tokens are counted; the driver gets a few sums only. Tables that no
later step reads are removed.

Defined cases: a null or empty text is the end token alone; tokens that are not
in the training texts are unknown and share one unknown word's probability; a
null id counts as the text '' for the split; repeated rows count each; without
training texts every token has probability 1; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import buckets, discard, pack, ship, stored, tidy, unpack, whole_text
from lodegraph.llm.packed import Numbers, chunks, dealt, rows

EXACT = 512
#: Points of the contour integral and of the interpolation over tables; more tables than GRID are drawn from a grid.
NODES, DEGREE, GRID = 41, 14, 1 << 14
SWEEPS, SAMPLES = 4, 3
STRENGTH_CONTEXT, STRENGTH_ROOT = 1.0, 1.0
SEED = 20240607
CHUNK = 6 << 20
END = b""  # no word is empty
#: Kinds of rows: documents of a chunk, words and pairs for a bucket, numbers of a chunk's words, and sums of a bucket;
#: of a bucket its dishes and the names of its contexts, and from a part the customers of these.
DOCUMENTS, WORDS, PAIRS, IDS, SUMS, DISHES, NAMES, CUSTOMERS = range(8)
#: And after sweep s: seats, what goes to the parts, and the tables that a part answers.
SEATS, SENT, TABLES = 100, 200, 300

_SENT = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
_DDL = "key int, kind int, chunk long, blob binary"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    found.append(END)
    return found


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(len, words), np.uint32, len(words)), np.frombuffer(b"".join(words), np.uint8)


def _separate(lengths: np.ndarray, flat: np.ndarray) -> list[bytes]:
    raw, ends = flat.tobytes(), np.cumsum(lengths, dtype=np.int64)
    return [raw[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]


def _runs(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    edges = [*np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[0] - 1 if len(sorted_keys) else 0)).tolist(), len(sorted_keys)]
    return list(zip(edges, edges[1:]))


# ---- words and their numbers -----------------------------------------------------------


def _split(batches, n_buckets: int):
    """By chunk: documents and the positions of their words; by bucket: words with their training counts."""
    for key, held in chunks(batches, ("doc_id", "text", "learn"), "text", CHUNK):
        numbers = Numbers()
        numbers[END] = 0
        docs = [np.fromiter(map(numbers.__getitem__, tokens(t)), np.int32) for t in held["text"]]
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = np.concatenate(docs)
        words = list(numbers)
        del docs, numbers
        learn = np.array(held["learn"], bool)
        trained = np.bincount(flat[np.repeat(learn, counts)], minlength=len(words))
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # small numbers pack well
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        bucket = np.fromiter((zlib.crc32(words[i]) % n_buckets for i in order), np.int32, len(words))
        ids = np.array([-1 if d is None else d for d in held["doc_id"]], np.int64)
        known = np.array([d is not None for d in held["doc_id"]], np.uint8)
        sent = [(key, DOCUMENTS, key, pack(ids, known, learn.astype(np.uint8), counts, rank[flat], bucket))]
        by_bucket = np.argsort(bucket, kind="stable")
        for a, z in _runs(bucket[by_bucket]):
            own = order[by_bucket[a:z]]
            sent.append((int(bucket[by_bucket[a]]), WORDS, key, pack(*_joined([words[i] for i in own]), trained[own].astype(np.uint32))))
        del flat, words
        for i in range(0, len(sent), 64):
            yield from rows(_SENT, sent[i : i + 64]).to_batches()


def _number(table: pa.Table, n_buckets: int) -> pa.Table:
    """Numbers and counts of a bucket's words for every chunk; words without training counts share the number after the last."""
    tidy()
    bucket = table.column("key")[0].as_py()
    numbers, asked, counts = Numbers(), [], []
    for kind, chunk, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "chunk", "blob"))):
        if kind == WORDS:
            lengths, flat, trained = unpack(blob)
            asked.append((chunk, np.fromiter(map(numbers.__getitem__, _separate(lengths, flat)), np.int64, len(lengths))))
            counts.append(trained.astype(np.int64))
    if not asked:
        return _SENT.empty_table()
    count = np.bincount(np.concatenate([own for _, own in asked]), np.concatenate(counts), len(numbers)).astype(np.int64)
    words = list(numbers)
    order = sorted(np.flatnonzero(count).tolist(), key=lambda i: (-count[i], words[i]))
    place = np.full(len(words), len(order))
    place[order] = np.arange(len(order))
    ids = (place * n_buckets + bucket).astype(np.uint64 if len(order) * n_buckets >= 1 << 31 else np.uint32)
    sums = [count.sum(), len(order), (count == 1).sum(), (count == 2).sum()]
    sent = [(chunk, IDS, bucket, pack(ids[own], count[own])) for chunk, own in asked]
    return rows(_SENT, [(bucket, SUMS, 0, pack(np.array(sums, np.int64))), *sent])


def _codes(at: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Of every token its pair: word's place * words + context. Words are known by their rank in number; places are in the
    order of (bucket, number). Before a document's first word stands the end of another."""
    place, at = np.empty(len(bucket), np.int64), at.astype(np.int64)
    place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
    return place[at] * len(bucket) + np.concatenate([at[counts[0] - 1 : counts[0]], at[:-1]])


def _steps(context: np.ndarray, n_types: np.ndarray) -> np.ndarray:
    """Ascending contexts of each word as differences."""
    steps = np.diff(context, prepend=0)
    first = np.cumsum(n_types) - n_types
    steps[first] = context[first]
    return steps.astype(np.uint32) if steps.max(initial=0) < 1 << 32 else steps


def _unstepped(steps: np.ndarray, n_types: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps, dtype=np.int64)
    before = np.concatenate([[0], total])[np.cumsum(n_types, dtype=np.int64) - n_types]
    return total - np.repeat(before, n_types)


def _pair(positions: pa.Table, answers: pa.Table, n_buckets: int) -> pa.Table:
    """Of a chunk: documents with the numbers of their words, counts and base scores, and the pairs for each bucket. Sums pass through."""
    tidy()
    if positions.num_rows and positions.column("key")[0].as_py() >= 0 or not positions.num_rows:
        return answers.filter(pc.equal(answers.column("kind"), SUMS)) if answers.num_rows else _SENT.empty_table()
    key = positions.column("key")[0].as_py()
    ids, known, learn, counts, flat, bucket = unpack(positions.column("blob")[0].as_py())
    number, count = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by_bucket], np.arange(n_buckets + 1))
    for b, blob in zip(answers.column("chunk").to_pylist(), answers.column("blob").to_pylist()):
        which = by_bucket[edges[b] : edges[b + 1]]
        number[which], count[which] = unpack(blob)
    starts = np.cumsum(counts) - counts
    base = np.add.reduceat(np.log10(count + 1.0)[flat], starts)
    n_known = np.add.reduceat((count > 0).astype(np.int64)[flat], starts)
    own, local = np.unique(number, return_inverse=True)
    at, bucket = local[flat].astype(np.uint32), (own % n_buckets).astype(np.int32)
    # Sorted with the learning rows' flag: every pair's run, and in it the training tokens.
    code = np.sort(_codes(at, counts, bucket) * 2 + np.repeat(learn, counts))
    pair, trained = code >> 1, code & 1
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    trained = np.add.reduceat(trained, first)
    pair = pair[first]
    n_types = np.bincount(pair // len(own), minlength=len(own))
    context, ends = own[pair % len(own)], np.cumsum(n_types)
    sent = [(key, DOCUMENTS, key, pack(ids, known, counts, n_known, base, at, bucket))]
    numbers = own[np.argsort(bucket, kind="stable")]
    for a, z in _runs(numbers % n_buckets):
        low, high, n = ends[a] - n_types[a], ends[z - 1], n_types[a:z]
        word = np.diff(numbers[a:z] // n_buckets, prepend=0)
        blob = pack(word.astype(np.uint32) if word.max() < 1 << 32 else word, n.astype(np.uint32), _steps(context[low:high], n), trained[low:high].astype(np.uint32))
        sent.append((int(numbers[a] % n_buckets), PAIRS, key, blob))
    return rows(_SENT, sent)


# ---- restaurants ---------------------------------------------------------------------


@dataclass(frozen=True)
class Totals:
    """What a sweep in a bucket needs to know of the others: sums, and totals of the contexts that the bucket has."""

    n: int  # training tokens
    v: int  # distinct words among them
    root_discount: float
    discount: float
    customers: np.ndarray  # of each context restaurant, by number; 0 has none
    tables: tuple[np.ndarray, ...] = ()  # of each context restaurant, after each sweep
    root: tuple[tuple[int, int], ...] = ()  # customers and tables of the unigram restaurant, after each sweep


def _distinct(parts) -> np.ndarray:
    """The distinct numbers of many arrays in order; no more of them are held than some three times the result."""
    held, size, limit = [np.zeros(0, np.int64)], 0, 1 << 18
    for x in parts:
        held.append(np.unique(x))
        size += len(held[-1])
        if size > limit:
            held = [np.unique(np.concatenate(held))]
            size = len(held[0])
            limit = max(limit, 2 * size)
    return np.unique(np.concatenate(held))


def _merge(table: pa.Table, n_parts: int) -> pa.Table:
    """The dishes of a bucket in all restaurants (restaurants of each word, as differences, and customers), the numbers of all
    contexts that it has, and for every part that holds some of them their customers. Chunks are unpacked one at a time, for
    the contexts and again for the dishes."""
    tidy()
    bucket = table.column("key")[0].as_py()

    def unpacked():
        return (unpack(blob.as_py()) for blob in table.column("blob"))

    names = _distinct(_unstepped(steps, n_types) for _, n_types, steps, _ in unpacked())
    width, code, customers = len(names) + 1, [], []
    for word, n_types, steps, trained in unpacked():
        some = trained > 0
        context = np.searchsorted(names, _unstepped(steps, n_types)[some]) + 1
        code.append(np.repeat(np.cumsum(word, dtype=np.int64), n_types)[some] * width + context)
        customers.append(trained[some])
    code, customers = np.concatenate(code), np.concatenate(customers)
    order = np.argsort(code)
    code, customers = code[order], customers[order]
    del order
    first = np.flatnonzero(np.diff(code, prepend=-1))
    customers = np.add.reduceat(customers, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    code = code[first]
    del first
    word, context = code // width, code % width
    n_types = np.bincount(word)
    sums = [(customers == 1).sum(), (customers == 2).sum()]
    sent = [(bucket, SUMS, 1, pack(np.array(sums, np.int64))), (bucket, DISHES, 0, pack(n_types.astype(np.uint32), _steps(context, n_types), customers)), (bucket, NAMES, 0, pack(np.diff(names, prepend=0)))]
    total = np.bincount(context, customers, width).astype(np.int64)[1:]
    sent += [(part, SENT, bucket, pack(steps, total[which])) for part, which, steps in _parts(names, n_parts)]
    return rows(_SENT, sent)


def _parts(names: np.ndarray, n_parts: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(part, its contexts, their places there as differences) of ascending context numbers."""
    order = np.argsort(names % n_parts, kind="stable")
    part, found = (names % n_parts)[order], []
    for a, z in _runs(part):
        steps = np.diff(names[order[a:z]] // n_parts, prepend=0)
        found.append((int(part[a]), order[a:z], steps.astype(np.uint32) if steps.max() < 1 << 32 else steps))
    return found


def _add(table: pa.Table, kind: int) -> pa.Table:
    """In a part: customers or tables of its contexts in all buckets, for every bucket that has them."""
    tidy()
    part, asked = table.column("key")[0].as_py(), [unpack(b) for b in table.column("blob").to_pylist()]
    places = [np.cumsum(a[0], dtype=np.int64) for a in asked]
    total = np.bincount(np.concatenate(places), np.concatenate([a[1] for a in asked])).astype(np.int64)
    return rows(_SENT, [(b, kind, part, pack(total[p])) for b, p in zip(table.column("chunk").to_pylist(), places)])


def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t): S(c, t) = S(c-1, t-1) + (c - 1 - t d) S(c-1, t)."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0
    for c in range(1, most + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            stay = table[c - 1, 1 : c + 1] + np.log(np.maximum(c - 1 - t * d, 0))
        table[c, 1 : c + 1] = np.logaddexp(table[c - 1, :c], stay)
    return table


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    low = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def _log_rest(s: np.ndarray, d: float) -> np.ndarray:
    """log of 1 - (1 - e^-s)^d for s > 0"""
    with np.errstate(all="ignore"):
        part = np.where(s < 0.5, np.log(-np.expm1(-s)), np.log1p(-np.exp(-s)))
    return np.log(-np.expm1(d * part))


def _log_rest_at(x: np.ndarray, y: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for s = x + iy: real and imaginary part, in real numbers for their exactness near 0 and far from it."""
    e, bow = np.exp(-x), 2 * np.sin(y / 2) ** 2
    real = e * bow - np.expm1(-x)
    near = (x < 0.5) | (e > 0.5)
    size = 0.5 * np.where(near, np.log(np.where(near, np.expm1(-x) ** 2 + 2 * e * bow, 1)), np.log1p(np.where(near, 0, e * (e - 2 + 2 * bow))))
    angle = d * np.arctan2(e * np.sin(y), real)
    size = d * size
    m = np.exp(size)
    real, imaginary = 2 * m * np.sin(angle / 2) ** 2 - np.expm1(size), -m * np.sin(angle)
    return 0.5 * np.log(real**2 + imaginary**2), np.arctan2(imaginary, real)


def _slope(s: np.ndarray, d: float, rest: np.ndarray) -> np.ndarray:
    """-d/ds of _log_rest"""
    return d * np.exp((d - 1) * np.log(-np.expm1(-s)) - s - rest)


def _bend(s: np.ndarray, d: float, slope: np.ndarray) -> np.ndarray:
    """-d/ds of log _slope"""
    return np.maximum(1 - slope + (1 - d) / np.expm1(s), 1e-300)


def _falling_root(above, low: np.ndarray, high: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        middle = (low + high) / 2
        up = above(np.exp(middle))
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return np.exp((low + high) / 2)


def log_coefficient(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log [z^c] (1 - (1 - z)^d)^t, also between whole t, by the integral over z = e^-s on a curve through the saddle point
    that bends to the left around the cut s <= 0."""
    s = _falling_root(lambda s: t * _slope(s, d, _log_rest(s, d)) > c, np.log(6 / c), np.full(c.shape, np.log(30.0)), 18)
    rest = _log_rest(s, d)
    slope = _slope(s, d, rest)
    half = np.minimum(np.pi, np.minimum(12 * s, 1.4 * np.sqrt(74 / (t * slope * _bend(s, d, slope)))))
    y = half[..., None] * np.linspace(0, 1, NODES)
    s, c, t = s[..., None], c[..., None], t[..., None]
    back = np.sin(y / 2) ** 2 / s
    start = c * s + t * rest[..., None]
    size, angle = _log_rest_at(s - back, y, d)
    size, angle = t * (size - rest[..., None]) - c * back, c * y + t * angle
    value = np.exp(size) * (np.cos(angle) - 0.5 * np.sin(y) / s * np.sin(angle))
    value[..., [0, -1]] /= 2
    return start[..., 0] + np.log(np.maximum(value.sum(axis=-1) * half / (NODES - 1) / np.pi, 1e-300))


def _draw_many(c: np.ndarray, r: np.ndarray, parent: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables by the same weights, with r = a / d: gamma(r + t) / t! * parent^t * [z^c] (1 - (1 - z)^d)^t."""

    def weight(t, c, r, p):
        return _log_gamma(r + t) - _log_gamma(t + 1) + t * np.log(p) + log_coefficient(d, c, t)

    def tables(s):
        q = parent * np.exp(_log_rest(s, d))
        return r * q / np.maximum(1 - q, 1e-300)

    # The likeliest t and the deviation there, as a start.
    s = _falling_root(lambda s: tables(s) * _slope(s, d, _log_rest(s, d)) > c, np.full(c.shape, -600.0), np.full(c.shape, np.log(30.0)), 50)
    t = np.clip(tables(s), 1, c)
    slope = _slope(s, d, _log_rest(s, d))
    deviation = 1 / np.sqrt(np.maximum(slope / _bend(s, d, slope) / t + 1 / t - 1 / (r + t), 1e-300))
    deviation = np.minimum(np.maximum(deviation, 0.5), 2 * t + 2)
    ends = [np.maximum(1, np.floor(t - 8 * deviation - 2)), np.minimum(c, np.ceil(t + 8 * deviation + 2))]
    top = weight(t, c, r, parent)
    # Beyond an end the weights fall on, to less than e^-30 of the largest.
    for i, bound in enumerate((np.ones_like(c), c)):
        open_ = np.flatnonzero(ends[i] != bound)
        while len(open_):
            found = weight(ends[i][open_], c[open_], r[open_], parent[open_])
            top[open_] = np.maximum(top[open_], found)
            open_ = open_[found > top[open_] - 30]
            ends[i][open_] = np.maximum(1, np.floor(ends[i][open_] / 2)) if i == 0 else np.minimum(c[open_], np.ceil(ends[i][open_] * 1.5))
            open_ = open_[ends[i][open_] != bound[open_]]
    low, high = ends
    # Between the ends log weights, smooth in log t but for (c - t)!, are interpolated.
    angle = np.pi * (np.arange(DEGREE) + 0.5) / DEGREE
    middle, width = np.log(low * high) / 2, np.maximum(np.log(high / low) / 2, 1e-12)
    at = np.clip(np.exp(middle[:, None] + width[:, None] * np.cos(angle)), low[:, None], high[:, None])
    wide = [np.broadcast_to(x[:, None], at.shape) for x in (c, r, parent)]
    smooth = weight(at, *wide) + _log_gamma(wide[0] - at + 1)
    k = np.arange(DEGREE)
    series = smooth @ np.cos(angle[:, None] * k) * np.where(k == 0, 1, 2) / DEGREE
    drawn = np.empty(len(c), np.int64)
    size = np.minimum(high - low + 1, GRID).astype(np.int64)
    group = 1 << np.ceil(np.log2(size)).astype(np.int64)
    for g in np.unique(group).tolist():
        members = np.flatnonzero(group == g)
        for own in np.split(members, range(step := max(1, (1 << 20) // g), len(members), step)):
            # All t, or of very many ones evenly spaced.
            gap = np.maximum((high - low)[own] / np.maximum(size[own] - 1, 1), 1)[:, None]
            here = np.minimum(low[own, None] + gap * np.arange(g), high[own, None])
            x = 2 * np.clip((np.log(here) - middle[own, None]) / width[own, None], -1, 1)
            b1 = b2 = 0.0
            for j in range(DEGREE - 1, 0, -1):
                b1, b2 = series[own, j, None] + x * b1 - b2, b1
            value = series[own, 0, None] + x * b1 / 2 - b2 - _log_gamma(c[own, None] - here + 1)
            value[np.arange(g) >= size[own, None]] = -np.inf
            total = np.exp(value - value.max(axis=1, keepdims=True)).cumsum(axis=1)
            chosen = (total < (rng.random(len(own)) * total[:, -1])[:, None]).sum(axis=1)
            near = np.where(gap[:, 0] > 1, rng.random(len(own)) - 0.5, 0) * gap[:, 0]
            drawn[own] = np.clip(np.rint(here[np.arange(len(own)), chosen] + near), low[own], high[own])
    return drawn


def draw_tables(c: np.ndarray, a: np.ndarray, parent: np.ndarray, d: float, stirling: np.ndarray, rng) -> np.ndarray:
    """Tables of c customers of a dish, given a = strength + d * other tables and the parent's probability."""
    t = np.minimum(c, 1).astype(np.int64)
    for size in np.unique(c[(c > 1) & (c <= EXACT)]).tolist():
        which = np.flatnonzero(c == size)
        for at in range(0, len(which), max(1, (1 << 20) // size)):
            own = which[at : at + max(1, (1 << 20) // size)]
            steps = np.log(np.maximum(a[own, None] + d * np.arange(size)[None, :], 1e-300))
            weight = np.cumsum(steps, axis=1) + np.arange(1, size + 1) * np.log(parent[own])[:, None] + stirling[size, 1 : size + 1]
            weight = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[own] = 1 + (weight < (rng.random(len(own)) * weight[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    for at in range(0, len(many), 512):
        own = many[at : at + 512]
        t[own] = _draw_many(c[own].astype(float), a[own] / d, parent[own], d, rng)
    return t


def seatings(bucket: int, word: np.ndarray, context: np.ndarray, customers: np.ndarray, n_words: int, totals: Totals, sweeps: int, seats=None):
    """Yields tables of each dish, and the parent's customers and tables of each word, after the start and each sweep;
    from ``seats`` (number of sweeps, tables of each dish and of each word) on, if given."""
    inner = context > 0
    direct = np.bincount(word[~inner], customers[~inner], n_words).astype(np.int64)
    done, t2, t1 = seats or (0, np.where(inner, 1, 0).astype(np.int64), None)
    c1 = direct + np.bincount(word, t2, n_words).astype(np.int64)
    t1 = np.minimum(c1, 1) if t1 is None else t1
    yield t2, c1, t1
    d1, d2 = totals.root_discount, totals.discount
    s1, s2 = log_stirling(d1), log_stirling(d2)
    crowd = np.flatnonzero(inner & (customers > 1))  # one customer has one table
    for s in range(done, sweeps):
        rng = np.random.default_rng([SEED, bucket, s])
        all_c, all_t = totals.root[s]
        base = (STRENGTH_ROOT + d1 * all_t) / (totals.v + 1)
        # The parent's probability without the dish's own tables.
        own = t2[crowd]
        parent = (np.maximum(c1[word[crowd]] - own - d1 * t1[word[crowd]], 0) + base) / (STRENGTH_ROOT + all_c - own)
        a = STRENGTH_CONTEXT + d2 * (totals.tables[s][context[crowd]] - own)
        t2 = t2.copy()
        t2[crowd] = draw_tables(customers[crowd], a, parent, d2, s2, rng)
        c1 = direct + np.bincount(word, t2, n_words).astype(np.int64)
        a1 = np.maximum(STRENGTH_ROOT + d1 * (all_t - t1), 1e-9)
        t1 = draw_tables(c1, a1, np.full(n_words, 1 / (totals.v + 1)), d1, s1, rng)
        yield t2, c1, t1


@dataclass
class Home:
    """What lies in a bucket."""

    bucket: int
    n_words: int
    word: np.ndarray
    context: np.ndarray
    customers: np.ndarray
    names: np.ndarray
    totals: Totals
    seats: dict[int, tuple[np.ndarray, np.ndarray]]


def _home(table: pa.Table, totals: Totals, n_parts: int) -> Home:
    found: dict[int, list] = {}
    for kind, part, blob in sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "chunk", "blob"))), key=lambda r: r[:2]):
        found.setdefault(kind, []).append(unpack(blob))
    n_types, steps, customers = found[DISHES][0]
    names = np.cumsum(found[NAMES][0][0])
    order = np.argsort(names % n_parts, kind="stable")  # parts one after the other

    def by_context(kind):
        """Of contexts 1, 2, ...; number 0 has no restaurant."""
        total = np.zeros(len(names) + 1, np.int64)
        if kind in found:
            total[order + 1] = np.concatenate([a[0] for a in found[kind]])
        return total

    tables = tuple(by_context(TABLES + s) for s in range(len(totals.root)))
    own = Totals(totals.n, totals.v, totals.root_discount, totals.discount, by_context(CUSTOMERS), tables, totals.root)
    seats = {kind - SEATS: tuple(a[0]) for kind, a in found.items() if SEATS <= kind < SENT}
    return Home(table.column("key")[0].as_py(), len(n_types), np.repeat(np.arange(len(n_types)), n_types), _unstepped(steps, n_types), customers, names, own, seats)


def _reseat(table: pa.Table, totals: Totals, s: int, n_parts: int) -> pa.Table:
    """A bucket after sweep s: seats, the root's customers and tables, and each part's contexts with their tables here."""
    tidy()
    home = _home(table, totals, n_parts)
    seats = (s - 1, *home.seats[s - 1]) if s else None
    *_, (t2, c1, t1) = seatings(home.bucket, home.word, home.context, home.customers, home.n_words, home.totals, s, seats)
    sums = np.bincount(home.context, t2, len(home.names) + 1).astype(np.int64)[1:]
    sent = [(part, SENT + s, home.bucket, pack(steps, sums[which])) for part, which, steps in _parts(home.names, n_parts)]
    return rows(_SENT, [(home.bucket, SUMS, 0, pack(np.array([c1.sum(), t1.sum()], np.int64))), (home.bucket, SEATS + s, 0, pack(t2, t1)), *sent])


def _predict(asked: pa.Table, table: pa.Table, totals: Totals, n_parts: int, sweeps: int = SWEEPS, samples: int = SAMPLES) -> pa.Table:
    """For every chunk that asked: log10 probability of each of its pairs, averaged over the last sweeps."""
    tidy()
    if not asked.num_rows:
        return _SENT.empty_table()
    home = _home(table, totals, n_parts)
    del table
    totals, n_words, bucket = home.totals, home.n_words, home.bucket
    width, d1, d2 = len(home.names) + 1, totals.root_discount, totals.discount
    code = home.word * width + home.context  # ascends
    probability, seen = [], np.zeros(len(code))
    for s in range(sweeps - samples + 1, sweeps + 1):
        t2, t1 = home.seats.pop(s)
        ((t2, c1, t1),) = seatings(0, home.word, home.context, home.customers, n_words, totals, s, (s, t2, t1))
        all_c, all_t = totals.root[s]
        base = (STRENGTH_ROOT + d1 * all_t) / (totals.v + 1)
        probability.append((np.append(c1 - d1 * t1, 0) + base) / (STRENGTH_ROOT + all_c))  # the last is the unknown word
        seen += home.customers - d2 * t2
    sent = []
    for chunk, blob in zip(asked.column("chunk").to_pylist(), asked.column("blob").to_pylist()):
        word, n_types, steps, _ = unpack(blob)
        w = np.repeat(np.minimum(np.cumsum(word, dtype=np.int64), n_words), n_types)
        u = np.searchsorted(home.names, _unstepped(steps, n_types)) + 1
        at = np.searchsorted(code, w * width + u)
        hit = (at < len(code)) & (w < n_words)
        hit[hit] = code[at[hit]] == (w * width + u)[hit]
        mean = np.zeros(len(w))
        mean[hit] = seen[at[hit]]
        for s, parent in enumerate(probability, sweeps - samples + 1):
            mean += (STRENGTH_CONTEXT + d2 * totals.tables[s][u]) * parent[w]
        mean /= STRENGTH_CONTEXT + totals.customers[u]
        sent.append((chunk, IDS, bucket, pack(np.log10(mean / len(probability)).astype(np.float32))))
    return rows(_SENT, sent)


def _score(positions: pa.Table, answers: pa.Table, n: int, v: int) -> pa.Table:
    tidy()
    if not positions.num_rows:
        return _SCORES.empty_table()
    ids, known, counts, n_known, base, at, bucket = unpack(positions.column("blob")[0].as_py())
    # Answers of the buckets in order are the pairs in order.
    order = np.argsort(np.array(answers.column("chunk").to_pylist()))
    log_p = np.concatenate([unpack(answers.column("blob")[int(i)].as_py())[0] for i in order]).astype(np.float64)
    _, which = np.unique(_codes(at, counts, bucket), return_inverse=True)
    score = np.add.reduceat(log_p[which], np.cumsum(counts) - counts)
    return pa.table([pa.array(ids, mask=known == 0), pa.array(counts), pa.array(n_known), pa.array(base - counts * np.log10(n + v + 1.0)), pa.array(score)], schema=_SCORES)


def score_texts(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row; ``learn`` says which rows train."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    n_buckets = buckets(texts)

    def grouped(df: DataFrame, run) -> DataFrame:
        return dealt(df, n_buckets).groupBy("key").applyInArrow(run, _DDL)

    def both(left: DataFrame, right: DataFrame, run, ddl: str = _DDL) -> DataFrame:
        return left.groupBy("key").cogroup(right.groupBy("key")).applyInArrow(run, ddl)

    def of_kind(df: DataFrame, kind: int) -> DataFrame:
        return df.where(F.col("kind") == kind)

    def summed(df: DataFrame, size: int) -> list[int]:
        sums = np.zeros(size, np.int64)
        for r in of_kind(df, SUMS).select("blob").toLocalIterator():  # a few numbers for each bucket
            sums += unpack(r["blob"])[0]
        return sums.tolist()

    sent = dealt(texts.mapInArrow(lambda b: _split(b, n_buckets), _DDL), n_buckets)
    numbered = dealt(sent.groupBy("key").applyInArrow(lambda t: _number(t, n_buckets), _DDL), n_buckets)
    paired = stored(both(sent, numbered, lambda p, a: _pair(p, a, n_buckets)), "pairs")
    n, v, once, twice = summed(paired, 4)
    asked = of_kind(paired, PAIRS)
    merged = stored(grouped(asked, lambda t: _merge(t, n_buckets)), "dishes")
    single, double = summed(merged, 2)
    discount = lambda one, two: float(np.clip(one / (one + 2 * two), 0.1, 0.95)) if one else 0.5
    totals = Totals(n, v, discount(once, twice), discount(single, double), np.zeros(1, np.int64))
    customers = stored(grouped(of_kind(merged, SENT), lambda t: _add(t, CUSTOMERS)), "customers")
    bucket = merged.where(F.col("kind").isin(DISHES, NAMES)).unionByName(customers)
    held, kept = [], []
    for s in range(sweeps + 1):
        home = bucket
        for df in held:
            home = home.unionByName(df)
        seated = stored(grouped(home, lambda t: _reseat(t, totals, s, n_buckets)), "seats")
        tables = stored(grouped(of_kind(seated, SENT + s), lambda t: _add(t, TABLES + s)), "tables")
        totals = Totals(n, v, totals.root_discount, totals.discount, totals.customers, (), (*totals.root, tuple(summed(seated, 2))))
        if s > 0 and s - 1 <= sweeps - samples:
            discard(*before)
        before, held = (seated, tables), [of_kind(seated, SEATS + s), tables]
        kept += held if s > sweeps - samples else []
    home = bucket
    for df in kept:
        home = home.unionByName(df)
    answers = both(dealt(asked, n_buckets), dealt(home, n_buckets), lambda a, h: _predict(a, h, totals, n_buckets, sweeps, samples))
    scored = both(dealt(of_kind(paired, DOCUMENTS), n_buckets), dealt(answers, n_buckets), lambda p, a: _score(p, a, n, v), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
