"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming radius by sharded BK-trees.

Distinct fingerprints are dealt to shards by every choice of two of their four 16-bit blocks: two fingerprints that
differ in two bits or fewer agree in at least two blocks, so each such pair meets in a shard. A shard's fingerprints
form a BK-tree (children keyed by their Hamming distance to the parent; a search follows only edges within the
radius of the distance), shipped to its task by the shuffle rather than broadcast, as all trees together grow with
the input. Shards above HOT members are dealt again, by thirds of the remaining bits, of which one must agree.
A task returns a spanning forest of its shard's links, never all pairs; the forests' components are then found with
alternating star steps, written to the shared folder each round.

Defined results: a null or wordless text has fingerprint zero, linked like any other; a text of one or two words has
one shingle, the whole sequence; texts count whole, however long; an empty table gives no rows; rows that repeat a doc_id are one document to dedup; extra columns don't matter.
A row without doc_id has its links like any other, but names a component only where all rows are so (component_id is
null then), and is kept only there: one row, of those with the least fingerprint that with the least text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import ddl, fresh, map_arrow, materialize, spread_join
from locusweave.llm.graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Members from which a shard is dealt again, and how often shards are dealt: in the last one all but 15 bits agree, so
#: that it has 2**15 members at most.
HOT, LEVELS = 512, 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at \\x20 and \\x09-\\x0D
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n - shingle + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        ones += np.unpackbits(h[a : a + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield {"doc_id": batch.column(0), "fp": values.view(np.int64)}

        return each

    return map_arrow(docs.select("doc_id", "text"), "doc_id long, fp long", make)


class BKTree:
    """Integers by Hamming distance: each node's children are keyed by their distance to it."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        at = self.root
        while d := (value ^ at[0]).bit_count():
            if d not in at[1]:
                at[1][d] = (value, {})
                return
            at = at[1][d]

    def within(self, value: int, radius: int) -> list[int]:
        found, rest = [], [self.root] if self.root else []
        while rest:
            v, children = rest.pop()
            d = (value ^ v).bit_count()
            if d <= radius:
                found.append(v)
            for k in range(max(1, d - radius), d + radius + 1):
                if k in children:
                    rest.append(children[k])
        return found


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that join just the values linked within the radius (a spanning forest of their links)."""
    tree, parent, edges = BKTree(), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v in values:
        parent[v] = v
        for u in tree.within(v, radius):
            if (a := root(u)) != (b := root(v)):
                parent[b] = a
                edges.append((u, v))
        tree.add(v)
    return edges


def _mask(bits: list[int]) -> int:
    """The number with these bits, as a signed one."""
    return int.from_bytes(sum(1 << b for b in bits).to_bytes(8, "big"), "big", signed=True)


def _finer(mask: int) -> list[int]:
    """The mask with each third of its free bits added: of fingerprints that differ in two free bits one third agrees."""
    fixed = [b for b in range(64) if mask >> b & 1]
    free = [b for b in range(64) if not mask >> b & 1]
    return [_mask(fixed + free[t::3]) for t in range(3)]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct: column fp. Returns a, b: fingerprints whose links have the same components as all links within the radius."""
    assert radius <= 2, "the shards are made for a radius of 2 at most"
    masks = {_mask(sum((list(range(16 * i, 16 * i + 16)) for i in chosen), [])) for chosen in combinations(range(4), 2)}
    dealt = distinct.select("fp", F.explode(F.array(*(F.lit(m) for m in sorted(masks)))).alias("mask"))
    shards = None
    for level in range(LEVELS):
        dealt = dealt.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        size = dealt.groupBy("key").agg(F.count("*").alias("n"))
        if level + 1 < LEVELS:
            hot = materialize(size.where(F.col("n") > HOT).select("key"), "hot")
        last = level + 1 == LEVELS or hot.isEmpty()
        cool = dealt if last else dealt.join(hot, "key", "left_anti")
        found = cool.groupBy("key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
        shards = found if shards is None else shards.unionByName(found)
        if last:
            break
        finer = {m: _finer(m) for m in masks}
        masks = {x for f in finer.values() for x in f}
        lookup = F.create_map(*(F.lit(x) if i % 2 == 0 else F.array(*map(F.lit, x)) for m, f in sorted(finer.items()) for i, x in enumerate((m, f))))
        dealt = dealt.join(hot, "key", "left_semi").select("fp", F.explode(F.element_at(lookup, F.col("mask"))).alias("mask"))

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            edges = [e for fps in batch.column(0) for e in forest(sorted(x & 0xFFFFFFFFFFFFFFFF for x in fps.as_py()), radius)]
            both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield {"a": both[:, 0], "b": both[:, 1]}

        return each

    return map_arrow(shards.select("fps"), "a long, b long", make).distinct()


def _components(fps: DataFrame, radius: int) -> DataFrame:
    """fps: doc_id, fp. Returns fp, root (the least fingerprint of its component), component_id (the component's smallest
    doc_id, null if no row of it has one)."""
    rep = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(rep.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = materialize(rep.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    return rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root")


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, null if there is none."""
    fps = materialize(fingerprints(docs, shingle), "fps")
    per = _components(fps, radius).select("fp", "component_id")
    return spread_join(fps, per, "fp", fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: that with the smallest doc_id (one row, if several have it); of a component
    without any doc_id, one row."""
    found = materialize(_components(materialize(fingerprints(docs, shingle), "fps"), radius), "components")
    keep = found.where("component_id IS NOT NULL").select(F.col("component_id").alias("doc_id")).distinct()
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    (fp,) = fresh(docs, "_fp")
    nameless = found.where("component_id IS NULL AND fp = root").select(F.col("fp").alias(fp))
    if nameless.isEmpty():
        return kept
    without = _with_fingerprint(docs.where("doc_id IS NULL"), fp, shingle).join(nameless, fp, "left_semi")
    one = without.groupBy(fp).agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias(fp + "_row"))
    return kept.unionByName(one.select(fp + "_row.*"))


def _with_fingerprint(docs: DataFrame, name: str, shingle: int) -> DataFrame:
    current = docs.withColumn(name, F.lit(None).cast("long"))
    schema = ddl(current)

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values.view(np.int64))], names=batch.schema.names)

        return each

    return map_arrow(current, schema, make)
