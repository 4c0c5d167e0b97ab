"""Packing documents into training sequences by cutting-stock column generation.

A document's ids (with an end id) are cut into full sequences and one remainder. Remainders are counted by length
class (STEP tokens wide, rounded up), which is a histogram of fixed size. A linear program over patterns (how many
remainders of each class fill one sequence) minimises the number of sequences: its columns are generated by a
knapsack dynamic program that prices them with the current duals. Patterns are used a whole number of times (rounded
down, the rest packed best-fit), and documents get their places by their rank within their class: a running number
within their part of the input plus the counts of the parts before it. Nothing but the histogram, the parts' counts
and the patterns is gathered.

Defined results: a null text is empty, and has just the end id; repeated rows are packed each for itself; a text of
any length is cut into pieces of at most the capacity; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.llm.common import map_arrow, materialize

CAPACITY, STEP, END = 2048, 8, 1


@lru_cache(2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken: the same vocabulary, merges (by rank of the merged
    token) and added tokens give the same ids several times faster; tests hold the two against each other."""
    import tiktoken
    from public_tokenizers import PATTERN

    spec = json.load(open(path, encoding="utf-8"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(spelled[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, step: int = STEP, ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, class (of length), part and number
    (running within part and class); with ids, the ids themselves too."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, number long" + ", ids array<int>" * ids

    def make():
        from locusweave.llm.packing import encoder

        tokenizer, seen = encoder(path), np.zeros(-(-capacity // step) + 1, np.int64)
        part = TaskContext.get().partitionId()

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            out = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "number", "ids")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.append(tokenizer.encode_to_numpy(text.as_py() or "", allowed_special="all"), END).astype("<u4")
                for a in range(0, len(found), capacity):
                    piece = found[a : a + capacity]
                    k = -(-len(piece) // step)
                    for name, value in (("doc_id", doc), ("start", a), ("length", len(piece)), ("ids_crc32", zlib.crc32(piece.tobytes())), ("doc_tokens", len(found)), ("class", k), ("number", int(seen[k]))):
                        out[name].append(value)
                    if ids:
                        out["ids"].append(piece.astype(np.int32))
                    seen[k] += 1
            long = {n: pa.array(out[n], pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "number")}
            yield long | {"class": pa.array(out["class"], pa.int32()), "part": pa.array([part] * len(out["class"]), pa.int32()), "ids": pa.array(out["ids"], pa.list_(pa.int32()))}

        return each

    return map_arrow(docs.select("doc_id", "text"), schema, make)


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over class sizes 1..capacity: the pattern of the greatest total value, by dynamic programming."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = value[:c] + best[c - 1 :: -1][:c]  # size s at index s - 1, then what fits into c - s
        k = int(total.argmax())
        best[c], last[c] = (total[k], k + 1) if total[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern, c = np.zeros(capacity, np.int64), capacity
    while c:
        if last[c]:
            pattern[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """The linear program: least number of sequences such that every class's demand is met. demand: by size 1..capacity.
    Returns patterns (one per row) and how often each is used (not whole). Revised simplex on the generated columns."""
    capacity, sizes = len(demand), np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return np.zeros((0, capacity), np.int64), np.zeros(0)
    basis = np.zeros((m, m))  # columns: patterns; at first one class each
    basis[np.arange(m), np.arange(m)] = capacity // sizes
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand[sizes - 1]
    for r in range(1, rounds + 1):
        dual = inverse.sum(axis=0)
        value = np.full(capacity, -1.0)
        value[sizes - 1] = dual
        worth, pattern = best_pattern(value, capacity)
        if worth <= 1 + 1e-7:
            break
        column = pattern[sizes - 1].astype(float)
        move = inverse @ column
        rise = move > 1e-9
        ratio = np.where(rise, x / np.where(rise, move, 1), np.inf)
        k = int(ratio.argmin())
        basis[:, k] = column
        if r % 200 == 0:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[k] / move[k]
            inverse -= np.outer(move, row)
            inverse[k] = row
        x = np.maximum(inverse @ demand[sizes - 1], 0)
    patterns = np.zeros((m, capacity), np.int64)
    patterns[:, sizes - 1] = np.rint(basis.T).astype(np.int64)
    return patterns, x


def whole(demand: np.ndarray, patterns: np.ndarray, uses: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole numbers of uses that meet the demand exactly: uses rounded down, the rest best-fit decreasing
    (at most as many sequences as there are classes, whatever the demand)."""
    left, capacity, out = demand.copy(), len(demand), []
    for p, n in zip(patterns, np.floor(uses + 1e-6).astype(np.int64), strict=True):
        held = p > 0
        n = min(int(n), int((left[held] // p[held]).min())) if held.any() else 0
        if n:
            out.append((p, n))
            left -= n * p
    while left.any():
        pattern, room = np.zeros(capacity, np.int64), capacity
        for s in np.flatnonzero(left)[::-1] + 1:
            k = min(room // s, left[s - 1])
            pattern[s - 1] += k
            room -= k * s
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, n))
        left -= n * pattern
    return out


def plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole patterns for a demand by class 1..capacity."""
    return whole(demand, *solve(demand))


def places(used: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, from rank, to rank, per sequence, first sequence, first slot): where the ranks of each class go."""
    out, base, given = [], 0, {}
    for pattern, n in used:
        slot = 0
        for k in np.flatnonzero(pattern).tolist():
            each, at = int(pattern[k]), given.get(k, 0)
            out.append((k + 1, at, at + n * each, each, base, slot))
            given[k] = at + n * each
            slot += each
        base += n
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, step: int = STEP, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids): one row per piece."""
    spark = docs.sparkSession
    assert capacity % step == 0, "classes round lengths up, so they must divide the capacity"
    cut = materialize(pieces(docs, path, capacity, step, ids), "pieces")
    parts = cut.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = parts.select("class", "part", before.alias("before"))  # parts x classes: counts, not documents
    demand = np.zeros(-(-capacity // step), np.int64)
    for r in parts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        demand[r["class"] - 1] = r["n"]
    found = places(plan(demand))  # at most the square of the number of classes
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot int" + ", ids array<int>" * ids
    held = spark.sparkContext.broadcast(_by_class(found))

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int32)
            for k in np.unique(kind).tolist():
                at = np.flatnonzero(kind == k)
                start, per, base, first = held.value[k]
                j = np.searchsorted(start, rank[at], "right") - 1
                within = rank[at] - start[j]
                sequence[at] = base[j] + within // per[j]
                slot[at] = first[j] + within % per[j]
            yield {n: batch.column(n) for n in batch.schema.names} | {"sequence_id": sequence, "slot": slot}

        return each

    ranked = cut.join(shift, ["class", "part"]).withColumn("rank", F.col("number") + F.col("before"))
    placed = map_arrow(ranked, schema, make)
    gapless = F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", gapless).drop("slot")


def _by_class(found) -> dict[int, tuple[np.ndarray, ...]]:
    out: dict[int, list] = {}
    for k, a, _, each, base, slot in found:
        out.setdefault(k, []).append((a, each, base, slot))
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}
