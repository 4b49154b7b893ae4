"""Hierarchical language identification: the family first, then one against one.

Features are frequencies of hashed byte trigrams of the lower-cased letters of
the whole text. Linear support vector machines (dual coordinate descent on the
hinge loss) tell each family from the rest; within the chosen family, a machine
for each pair of its languages votes, and summed margins break ties.

The machines are fitted on a bounded sample of labelled rows; scoring is one
pass without a shuffle, with weights whose size depends on the number of
languages alone.

Defined cases: a null text, or one without any letter, is ``und`` with score 0;
texts of any length are read whole; repeated rows are scored each; without
labelled rows every text is ``und``; an empty table gives an empty result;
language, source and id never enter a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import ship, tidied, whole_text
from lodegraph.llm.sampling import sampled_ids

#: Labelled documents of each language in the sample (documented bound).
SAMPLE_DOCUMENTS = 400
#: And of all languages, which bounds what the driver holds: a row of features takes 16 KB.
SAMPLE_TOTAL = 16_384
DIMENSIONS = 1 << 13
#: Texts are read in strips of so many bytes; sums over strips are exact for the whole text.
STRIP_BYTES = 1 << 22

#: Fixed: languages by family; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_LETTER = regex.compile(r"\p{L}")
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[:128] = 32
for _c in range(ord("a"), ord("z") + 1):
    _CLASS[_c] = _c


def codes(raw: bytes) -> np.ndarray:
    """Hashed trigrams of the text between two spaces."""
    b = _CLASS[np.frombuffer(raw, np.uint8)]
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 13)


def prepared(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass") + b" "


def _strips(raw: bytes):
    for at in range(0, max(1, len(raw) - 2), STRIP_BYTES):
        yield raw[at : at + STRIP_BYTES + 2]


def frequencies(text: str) -> np.ndarray:
    raw = prepared(text)
    counts = np.zeros(DIMENSIONS)
    for strip in _strips(raw):
        counts += np.bincount(codes(strip), minlength=DIMENSIONS)
    return (counts / max(1, len(raw) - 2)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last one the bias) by dual coordinate descent; rows are scaled so that margins are of order 1."""
    x = np.hstack([x, np.full((len(x), 1), 0.05, np.float32)])
    norms = np.einsum("ij,ij->i", x, x) + 1e-9
    scale = float(np.sqrt(norms.mean()))
    x, norms = x / scale, norms / scale**2
    # A class with fewer rows counts as much as the other.
    limit = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, alpha, rng = np.zeros(x.shape[1], np.float64), np.zeros(len(x)), np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    w /= scale
    w[-1] *= 0.05
    return w


@dataclass(frozen=True)
class Model:
    families: tuple[tuple[str, ...], ...]  # languages of each family
    pairs: tuple[tuple[str, str], ...]  # languages of each machine
    weights: np.ndarray  # a row for each family, then for each pair; the last column is the bias


def fit(x: np.ndarray, labels: list[str]) -> Model:
    langs = sorted(set(labels))
    by_family: dict[str, list[str]] = {}
    for lang in langs:
        by_family.setdefault(_FAMILY_OF.get(lang, lang), []).append(lang)
    families = tuple(tuple(v) for _, v in sorted(by_family.items()))
    y, found = np.array(labels), []
    for f in families:
        inside = np.isin(y, f)
        found.append(np.zeros(DIMENSIONS + 1) if inside.all() else svm(x, np.where(inside, 1.0, -1.0)))
    pairs = tuple(p for f in families for p in combinations(f, 2))
    for a, b in pairs:
        some = np.isin(y, (a, b))
        found.append(svm(x[some], np.where(y[some] == a, 1.0, -1.0)))
    return Model(families, pairs, np.array(found).reshape(-1, DIMENSIONS + 1))


def margins(text: str, model: Model) -> np.ndarray:
    raw = prepared(text)
    total = np.zeros(len(model.weights))
    for strip in _strips(raw):
        counts = np.bincount(codes(strip), minlength=DIMENSIONS)
        total += model.weights[:, :-1] @ counts
    return total / max(1, len(raw) - 2) + model.weights[:, -1]


def decide(m: np.ndarray, model: Model) -> tuple[str, float]:
    chance = 1 / (1 + np.exp(-2 * np.clip(m, -17, 17)))
    f = int(np.argmax(m[: len(model.families)])) if len(model.families) > 1 else 0
    score = float(chance[f]) if len(model.families) > 1 else 1.0
    langs = model.families[f]
    votes = dict.fromkeys(langs, 0.0)
    least = dict.fromkeys(langs, 1.0)
    for k, (a, b) in enumerate(model.pairs, len(model.families)):
        if a not in votes:
            continue
        winner, loser = (a, b) if m[k] >= 0 else (b, a)
        edge = float(max(chance[k], 1 - chance[k]))
        votes[winner] += 1 + edge / (10 * len(langs))
        least[winner], least[loser] = min(least[winner], edge), min(least[loser], 1 - edge)
    best = max(langs, key=lambda v: (votes[v], v))
    return best, score * least[best]


def train(docs: DataFrame, learnable, bound: int = SAMPLE_DOCUMENTS) -> Model | None:
    """Fit on a bounded sample of the rows with a language for which ``learnable`` holds; an id with several counts for the first."""
    ship(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & learnable)
    ids = sampled_ids(labelled.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("label")), bound, SAMPLE_TOTAL)

    def featurise(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array([frequencies(t or "").astype(np.float16).tobytes() for t in b.column("text").to_pylist()], pa.binary())],
                names=["id", "label", "x"],
            )

    # Of rows that repeat an id, the one whose text comes first by hash.
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), whole_text("text").alias("text"), F.xxhash64("text").alias("hash"))
    chosen = texts.select("id", "hash").join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("hash").alias("hash"))  # the sample has a stated bound
    found = (
        texts.join(F.broadcast(chosen), ["id", "hash"])
        .select("id", "label", "text")
        .mapInArrow(tidied(featurise), "id long, label string, x binary")
        .dropDuplicates(["id"])
        .orderBy("id")
        .collect()
    )
    if not found:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16).astype(np.float32) for r in found])
    return fit(x, [r["label"] for r in found])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            langs, scores = [], []
            for t in b.column("text").to_pylist():
                if model is None or not t or not _LETTER.search(t):
                    lang, score = "und", 0.0
                else:
                    lang, score = decide(margins(t, model), model)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")
