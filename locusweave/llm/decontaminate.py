"""Benchmark decontamination: windows of benchmark words, looked up in every document's words.

The benchmark's windows (10 consecutive words, or the whole item if it has fewer) become sorted arrays of 64-bit
window hashes, built once and broadcast; documents are scanned with rolling window hashes, hits are verified against
the words themselves, and hit spans or whole documents are removed. A benchmark of more than BENCHMARK_BYTES of text is
scanned in several blocks of items: each block's result is a written table, and its broadcast is destroyed before the
next one is made.

Defined results: a null or wordless text has no words and no hits; an item without words or without item_id takes no
part; items may repeat words or be equal; texts count whole, however long;
rows that repeat get equal results; extra columns of either table don't matter; an empty benchmark hits nothing, and an
empty table of documents gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import NOT_ALNUM, Words, ddl, fresh, map_arrow, materialize, mix, text_blocks

WINDOW = 10
#: Most bytes of benchmark text that are broadcast at once.
BENCHMARK_BYTES = 8_000_000


def _windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x100000001B3) + hashes[j : j + n]
    return mix(out)


class WindowSet:
    """Windows of some items as sorted arrays: by window length the 64-bit hashes, the item of each, and where its words
    stand in the items' normalised texts. About 20 bytes a window besides the texts, and broadcast as it is."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        parts: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        spelled, at = [], 0
        self.items = np.array([i for i, _ in items], np.int64)
        for number, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)]), NOT_ALNUM)
            n = len(words.start)
            if not n:
                continue
            k = min(n, window)
            size = words.end - words.start
            start = np.concatenate(([0], np.cumsum(size + 1)[:-1])) + at
            spelled.append(b" ".join(words.data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)) + b" ")
            at += len(spelled[-1])
            runs = n - k + 1
            parts[k].append((_windows(words.hashes(), k), np.full(runs, number, np.int32), start[:runs].astype(np.int32), (start[k - 1 :] + size[k - 1 :] - start[:runs]).astype(np.int32)))
        self.text = b"".join(spelled)
        self.by_length = {}
        for k, found in parts.items():
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(columns[0] >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[k] = (np.packbits(bits), *(c[order] for c in columns))

    def scan(self, words: Words) -> tuple[np.ndarray, list[tuple[int, int, set[int]]]]:
        """Which words are hit; the verified hits as (first word, words, items)."""
        hit = np.zeros(len(words.start) + 1, np.int64)
        found = []
        hashes = words.hashes()
        document = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        for k, (maybe, keys, items, start, size) in self.by_length.items():
            w = _windows(hashes, k)
            high = (w >> np.uint64(44)).astype(np.int64)
            at = np.flatnonzero(maybe[high >> 3] >> (7 - (high & 7)).astype(np.uint8) & 1)
            at = at[document[at] == document[at + k - 1]]
            first, last = np.searchsorted(keys, w[at]), np.searchsorted(keys, w[at], "right")
            for i, a, b in zip(at[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist(), strict=True):
                here = b" ".join(words.data[x:y].tobytes() for x, y in zip(words.start[i : i + k], words.end[i : i + k], strict=True))
                same = [j for j in range(a, b) if self.text[start[j] : start[j] + size[j]] == here]
                if same:
                    hit[i] += 1
                    hit[i + k] -= 1
                    found.append((i, k, {int(self.items[n]) for n in items[same].tolist()}))
        return np.cumsum(hit[:-1]) > 0, found


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of about BENCHMARK_BYTES of text."""
    b = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = b.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + total // BENCHMARK_BYTES
    return [b] if n == 1 else [b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with three more columns, named _hits, _items and _n_words (or so that they clash with none): flat first word
    and length of each span of hit words, ids of the items with occurring windows, and the number of words. The whole
    row travels through the scan, so nothing is joined or shuffled."""
    kinds = {"_hits": "array<long>", "_items": "array<long>", "_n_words": "long"}
    current = docs.withColumns({n: F.lit(None).cast(k) for n, k in zip(fresh(docs, *kinds), kinds.values(), strict=True)})
    schema = ddl(current)
    blocks = _blocks(benchmark)
    for number, block in enumerate(blocks):
        items = [(r[0], r[1]) for r in block.distinct().collect()]  # about BENCHMARK_BYTES
        held = docs.sparkSession.sparkContext.broadcast(WindowSet(items, window))

        def make(held=held):
            known = held.value

            def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                texts, old_hits, old_items = (batch.column("text"), batch.column(-3), batch.column(-2))
                for a, b, data, offsets in text_blocks(texts):
                    words = Words(data, offsets, NOT_ALNUM)
                    hit, found = known.scan(words)
                    of = defaultdict(set)
                    owner = np.searchsorted(words.first, [i for i, _, _ in found], "right") - 1
                    for d, (_, _, its) in zip(owner.tolist(), found, strict=True):
                        of[d] |= its
                    spans, named = [], []
                    for d in range(b - a):
                        marks = hit[words.first[d] : words.first[d + 1]]
                        if before := old_hits[a + d].as_py():
                            marks = marks.copy()
                            for x, n in _pairs(before):
                                marks[x : x + n] = True
                        edge = np.flatnonzero(np.diff(marks.view(np.int8), prepend=0, append=0)).reshape(-1, 2)
                        spans.append(np.stack([edge[:, 0], edge[:, 1] - edge[:, 0]], 1).ravel())
                        named.append(sorted(of.get(d, set()).union(old_items[a + d].as_py() or ())))
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-3], pa.array(spans, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.int64())), pa.array(np.diff(words.first), pa.int64())], names=part.schema.names)

            return each

        current = map_arrow(current, schema, make)
        if number + 1 < len(blocks):  # one block at a time is held
            current = materialize(current, "marked")
            held.destroy()
    return current


def _pairs(flat: list[int] | None) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2], strict=True)) if flat else []


def _cut(text: str, flat: list[int]) -> str:
    """The text without the hit words (from a span's first byte to its last)."""
    raw = text.encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_ALNUM)
    out, at = [], 0
    for first, n in _pairs(flat):
        out.append(raw[at : words.start[first]])
        at = words.end[first + n - 1]
    return b"".join([*out, raw[at:]]).decode(errors="ignore")


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, with all their columns."""
    return mark(docs, benchmark, window).where(F.size(fresh(docs, "_hits")[0]) == 0).select(docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, the hit spans cut out of their texts."""
    marked = mark(docs, benchmark, window)
    place, hits = marked.columns.index("text"), len(docs.columns)

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            new = [_cut(t.as_py(), h.as_py()) if t.is_valid and len(h) else t.as_py() for t, h in zip(batch.column(place), batch.column(hits), strict=True)]
            columns = batch.columns
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return each

    return map_arrow(marked, ddl(marked), make).select(docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = mark(docs.select("doc_id", "text"), benchmark).selectExpr("doc_id", "_hits hits", "_items items", "_n_words n_words")
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )

