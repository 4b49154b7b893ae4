"""Token counts by heap-and-linked-list byte-pair merging.

Every pre-token starts as its bytes, the last one marked as the word's end. A
heap holds the adjacent pairs that have a merge rank; the lowest rank (leftmost
on ties) is popped, its right symbol leaves the linked list and the two new
neighbour pairs enter the heap. The count is the number of initial symbols less
the merges made; no identifiers are formed.

A task counts each distinct pre-token once: a table of counts, emptied when it
is full, sits in front of the merging. Nothing is shuffled.

Defined cases: a null or empty text has no tokens; texts of any length are
counted whole; repeated rows are counted each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import ship, tidied

#: Entries of a task's table of counts; beyond it the table starts anew.
TABLE_ENTRIES = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(kept) else chr(next(spare)) for b in range(256)]


class Merger:
    """Merge ranks of a ``tokenizers`` file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        self.inner = [number(c) for c in byte_symbols()]
        self.final = [number(c + end) for c in byte_symbols()]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault(number(a) << 32 | number(b), (rank, number(a + b)))
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # \s of the file is Unicode's White_Space.
        self.pattern = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def merged(self, word: bytes) -> int:
        """Symbols that are left of one word."""
        if not word:
            return 0
        sym = [self.inner[b] for b in word]
        sym[-1] = self.final[word[-1]]
        n, merges = len(sym), self.merges
        if n == 1:
            return 1
        heap = [m[0] << 32 | i for i in range(n - 1) if (m := merges.get(sym[i] << 32 | sym[i + 1]))]
        heapify(heap)
        after, before, made = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            m = merges.get(sym[i] << 32 | sym[j])
            if m is None or m[0] != entry >> 32:
                continue  # the pair has changed since
            sym[i], sym[j] = m[1], -1
            made += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(sym[i] << 32 | sym[k]):
                    heappush(heap, m[0] << 32 | i)
            h = before[i]
            if h >= 0 and (m := merges.get(sym[h] << 32 | sym[i])):
                heappush(heap, m[0] << 32 | h)
        return n - made


class _Counts(dict):
    def __init__(self, merger: Merger):
        self.merger = merger

    def __missing__(self, word: str) -> int:
        n = self[word] = self.merger.merged(word.encode("utf-8", "surrogatepass"))
        return n


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


def count_text(counts: _Counts, text: str) -> int:
    m, total = counts.merger, 0
    parts = [text]
    if m.cut is not None and "<|" in text:
        parts = m.cut.split(text)
        total = len(parts) - 1  # special strings are a token each
    for part in parts:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower case by character, so no final sigma
        total += sum(map(counts.__getitem__, m.pattern.findall(part.lower())))
    return total


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row."""
    ship(docs.sparkSession)

    def run(batches):
        counts = _Counts(merger(vocabulary))
        for b in batches:
            found = []
            for t in b.column("text"):
                found.append(count_text(counts, t.as_py() or ""))
                if len(counts) > TABLE_ENTRIES:
                    counts.clear()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).cast("string").alias("text"),
    ).mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long")
