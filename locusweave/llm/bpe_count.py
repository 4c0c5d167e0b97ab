"""Token counts by byte-pair merging with a heap and a linked list.

A SentencePiece BPE file is read for its pieces and scores only. Texts are cut where no piece can reach across (before
a space that follows other text, and at line feeds); within such a stretch the lowest-rank adjacent pair is popped
from a heap again and again, left-most first, and merged in a doubly linked list. The count is the initial symbols
less the merges, where a symbol that is no piece counts as its UTF-8 bytes; no identifiers are made. A stretch's count
depends on nothing else, so counts are remembered per worker, up to REMEMBER stretches.

Defined results: null and empty texts have 0 tokens; control strings such as `<s>` in a text are plain text, as the
library takes them by default; whole texts count, however long; extra columns don't matter.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import map_arrow

LIMIT, REMEMBER = 4096, 600_000
SPACE = "▁"


def read_pieces(path: str) -> dict[str, int]:
    """Ranks (0: first to merge) of the normal pieces of a SentencePiece model file."""
    data = open(path, "rb").read()

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    def fields(at: int, end: int) -> Iterator[tuple[int, object]]:
        while at < end:
            key, at = number(at)
            kind = key & 7
            if kind == 0:
                value, at = number(at)
            elif kind == 5:
                value, at = data[at : at + 4], at + 4
            elif kind == 1:
                value, at = data[at : at + 8], at + 8
            else:
                n, at = number(at)
                value, at = (at, at + n), at + n
            yield key >> 3, value

    found = []
    for field, span in fields(0, len(data)):
        if field == 1:  # a piece: text, score, type (1: normal)
            piece = dict(fields(*span))
            if piece.get(3, 1) == 1:
                a, b = piece[1]
                found.append((float(np.frombuffer(piece[2], "<f4")[0]), data[a:b].decode()))
    order = {s: r for r, s in enumerate(sorted({s for s, _ in found}, reverse=True))}
    return {text: order[score] for score, text in found}


class Counter(dict):
    """Counts of stretches, remembered."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__()
        self.ranks = ranks
        self.single = set(ranks)

    def __missing__(self, stretch: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        n = self.merge(stretch)
        if len(stretch) <= 64:
            self[stretch] = n
        return n

    def merge(self, stretch: str) -> int:
        ranks, n = self.ranks, len(stretch)
        if n == 1:
            return 1 if stretch in ranks else len(stretch.encode())
        symbol = list(stretch)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            pair = stretch[i : i + 2]
            if pair in ranks:
                heap.append((ranks[pair], i, pair))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i] if symbol[i] else -1
            if j < 0 or symbol[i] + symbol[j] != pair:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = pair, ""
            merges += 1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (new := pair + symbol[k]) in ranks:
                    heapq.heappush(heap, (ranks[new], i, new))
            if (k := left[i]) >= 0 and (new := symbol[k] + pair) in ranks:
                heapq.heappush(heap, (ranks[new], k, new))
        return n - merges + sum(len(s.encode()) - 1 for s in symbol if len(s) == 1 and s not in ranks)


_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def count(text: str | None, counter: Counter) -> int:
    """Tokens of a text."""
    if not text:
        return 0
    lines = text.split("\n")
    total = (len(lines) - 1) * counter["\n"]
    get = counter.__getitem__
    for i, line in enumerate(lines):
        if not line and i:
            continue
        if SPACE in line or "  " in line or line[:1] == " " or line[-1:] == " ":
            line = line.replace(" ", SPACE)
            total += sum(map(get, _STRETCH.findall(line if i else SPACE + line)))
            continue
        words = line.replace(" ", f" {SPACE}").split(" ")
        if i == 0:
            words[0] = SPACE + words[0]
        total += sum(map(get, words))
    return total


_kept: dict[str, Counter] = {}


def counter_for(path: str) -> Counter:
    """One counter per worker process and model file."""
    if path not in _kept:
        _kept[path] = Counter(read_pieces(path))
    return _kept[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def make():
        from locusweave.llm import bpe_count

        counter = bpe_count.counter_for(path)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            texts = batch.column(1).to_pylist()
            yield {"doc_id": batch.column(0), "n_bytes": pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), "n_tokens": pa.array([bpe_count.count(t, counter) for t in texts], pa.int64())}

        return each

    return map_arrow(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_tokens long", make).withColumn("over_limit", F.col("n_tokens") > limit)
