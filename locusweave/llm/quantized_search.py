"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of M codewords, one of each full-dimensional codebook. The codebooks come from residual k-means on
a bounded sample (SAMPLE vectors, spread by a hash of their ids), then from rounds of beam-search encoding and least
squares. Every row is encoded by beam search and stored with its code and the squared norm of its approximation, as a
table in the shared folder. A search scores the codes of all rows with lookup tables (query times codeword), one block
of about BLOCK queries after the other; each task keeps a query's RERANK best, and of these the RERANK best of all
tasks, and no more however many tasks there are, are compared exactly, in double precision.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without
vec_id; a distance needs vectors of one length, so vectors of another length than the commonest take no part either;
finite components may be of any size; equal distances go to the smaller vec_id; rows that repeat a vec_id count once as
candidates (nearest), and once as queries (least vector); an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.llm.common import map_arrow, materialize

CODEBOOKS, CODEWORDS, BEAM, ROUNDS = 24, 128, 8, 2
#: Vectors that codebooks are fitted on (expected number); queries of a block; rows reranked for a query; results.
SAMPLE, BLOCK, RERANK, NEAREST = 8192, 1024, 512, 10
SEED = 11


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (of doubles) of the rows that take part."""
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    )
    common = x.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return x.where(F.size("embedding") == (common.d if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (np.square(centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


@dataclass
class Quantizer:
    codebooks: np.ndarray  # M x K x d

    def __post_init__(self):
        m, k, d = self.codebooks.shape
        flat = self.codebooks.reshape(m * k, d)
        self.products = (flat @ flat.T).reshape(m, k, m, k).transpose(0, 2, 1, 3)  # of two codewords
        self.norms = np.square(flat).sum(axis=1).reshape(m, k)

    def encode(self, x: np.ndarray, beam: int = BEAM, block: int = 256) -> np.ndarray:
        """Codes by beam search: after each codebook the beam's least distances to the vector stay."""
        m, k, d = self.codebooks.shape
        out = np.zeros((len(x), m), np.uint8)
        for a in range(0, len(x), block):
            part = x[a : a + block]
            n = len(part)
            dots = (part @ self.codebooks.reshape(m * k, d).T).reshape(n, m, k)
            cost, codes = np.zeros((n, 1)), np.zeros((n, 1, 0), np.int64)
            for j in range(m):
                total = cost[:, :, None] + (self.norms[j] - 2 * dots[:, j])[:, None, :]
                for i in range(j):
                    total += 2 * self.products[i, j][codes[:, :, i]]
                flat = total.reshape(n, -1)
                width = min(beam, flat.shape[1])
                best = np.argpartition(flat, width - 1, axis=1)[:, :width]
                cost = np.take_along_axis(flat, best, axis=1)
                codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
            out[a : a + n] = codes[np.arange(n), cost.argmin(axis=1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.codebooks[j][codes[:, j]] for j in range(len(self.codebooks)))


def train(x: np.ndarray, m: int = CODEBOOKS, k: int = CODEWORDS, rounds: int = ROUNDS) -> Quantizer:
    """Residual k-means, then beam-search codes and least-squares codewords in turn."""
    rng = np.random.default_rng(SEED)
    k, d = max(1, min(k, len(x) // 16)), x.shape[1]
    books, rest = np.zeros((m, k, d)), x.copy()
    for j in range(m):
        books[j] = _kmeans(rest, k, rng)
        near = (np.square(books[j]).sum(axis=1) - 2 * rest @ books[j].T).argmin(axis=1)
        rest -= books[j][near]
    q = Quantizer(books)
    for _ in range(rounds):
        codes = q.encode(x)
        flat = codes.astype(np.int64) + np.arange(m) * k
        both = np.zeros((m * k, m * k))
        right = np.zeros((m * k, d))
        for j in range(m):
            np.add.at(right, flat[:, j], x)
            for i in range(m):
                np.add.at(both, (flat[:, j], flat[:, i]), 1)
        old = q.codebooks.reshape(m * k, d)
        del q  # its products are as large as the system below, which is changed in place: the driver holds both only once
        # a small pull to the old codewords keeps the system regular and unused codewords where they were
        both.flat[:: m * k + 1] += 0.01
        new = np.linalg.solve(both, right + 0.01 * old)
        del both
        q = Quantizer(new.reshape(m, k, d))
    return q


def fit(vectors: DataFrame) -> Quantizer | None:
    """A quantizer from a sample of the vectors that take part."""
    n = vectors.count()
    h = F.pmod(F.xxhash64(F.lit("quantizer"), "vec_id"), F.lit(1_000_000_000))
    drawn = vectors.where(h < int(1e9 * min(1.0, SAMPLE / max(1, n)))).toArrow().sort_by("vec_id").combine_chunks()
    x = _matrix(drawn["embedding"].combine_chunks()) if drawn.num_rows else np.zeros((0, 0))
    return train(x) if len(x) else None


def index(vectors: DataFrame, quantizer: Quantizer) -> DataFrame:
    """Every vector with its code and the squared norm of its approximation: vec_id, embedding, code, norm."""
    held = vectors.sparkSession.sparkContext.broadcast(quantizer)  # codebooks of a fixed size

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            codes = held.value.encode(_matrix(batch.column("embedding")))
            norm = np.square(held.value.decode(codes)).sum(axis=1) if len(codes) else np.zeros(0)
            yield {"vec_id": batch.column("vec_id"), "embedding": batch.column("embedding"), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "norm": norm}

        return each

    return map_arrow(vectors, "vec_id long, embedding array<double>, code binary, norm double", make)


class Block:
    """A block of queries, its lookup tables, and the approximately best rows of the task so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, quantizer: Quantizer, keep: int):
        self.ids, self.keep = ids, keep
        m, k, d = quantizer.codebooks.shape
        self.table = np.ascontiguousarray((x @ quantizer.codebooks.reshape(m * k, d).T).reshape(len(x), m, k).transpose(1, 2, 0))
        self.score, self.row = np.zeros((0, len(ids))), np.zeros((0, len(ids)), np.int64)

    def add(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> None:
        """Score a batch of codes and keep the best, at equal scores the smaller ids; an id counts once, with its best
        row, and a query's own row as the worst."""
        order = np.argsort(ids, kind="stable")
        approx = np.repeat(norms[order][:, None], len(self.ids), axis=1)
        for j in range(codes.shape[1]):
            approx -= 2 * self.table[j][codes[order, j]]
        ids, start = np.unique(ids[order], return_index=True)
        if len(start) < len(approx):
            approx = np.minimum.reduceat(approx, start, axis=0)
        approx[np.isnan(approx) | (ids[:, None] == self.ids[None, :])] = np.inf
        for i in np.flatnonzero(np.isin(ids, self.row)).tolist():
            same = self.row == ids[i]
            self.score = np.where(same, np.minimum(self.score, approx[i]), self.score)
            approx[i, same.any(axis=0)] = np.inf
        score, row = np.concatenate([self.score, approx]), np.concatenate([self.row, np.repeat(ids[:, None], len(self.ids), axis=1)])
        if len(score) > self.keep + 1:  # one more, as the own row is among them
            best = np.argpartition(score, self.keep, axis=0)[: self.keep + 1]
            last = np.take_along_axis(score, best, 0).max(axis=0)
            for c in np.flatnonzero(((score <= last) & np.isfinite(score)).sum(axis=0) > self.keep + 1).tolist():
                best[:, c] = np.lexsort((row[:, c], score[:, c]))[: self.keep + 1]
            score, row = np.take_along_axis(score, best, 0), np.take_along_axis(row, best, 0)
        self.score, self.row = score, row


FOUND = "query_id long, rank int, vec_id long, score double"


def search(indexed: DataFrame, queries: DataFrame, quantizer: Quantizer, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest other vectors by Euclidean distance. indexed: a written table."""
    spark, keep = indexed.sparkSession, max(RERANK, nearest)
    q = materialize(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = max(1, -(-q.count() // BLOCK))
    fitted, found = spark.sparkContext.broadcast(quantizer), None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks()  # about BLOCK rows
        if not part.num_rows:
            continue
        held = spark.sparkContext.broadcast((part["vec_id"].to_numpy(), _matrix(part["embedding"].combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = Block(*held.value, fitted.value, keep)
            for batch in batches:
                for a in range(0, batch.num_rows, 2048):
                    rows = batch.slice(a, 2048)
                    codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
                    block.add(rows.column("vec_id").to_numpy(), codes, rows.column("norm").to_numpy())
            owner = np.broadcast_to(block.ids[None, :], block.row.shape)
            other = owner != block.row
            yield pa.RecordBatch.from_arrays([pa.array(owner[other]), pa.array(block.row[other]), pa.array(block.score[other])], names=["query_id", "vec_id", "approx"])

        one = materialize(indexed.select("vec_id", "code", "norm").mapInArrow(run, "query_id long, vec_id long, approx double"), "near")
        held.destroy()
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], FOUND)
    by = Window.partitionBy("query_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("approx").alias("approx"))
    best = once.withColumn("place", F.row_number().over(by.orderBy("approx", "vec_id"))).where(F.col("place") <= keep).select("query_id", "vec_id")
    pairs = best.join(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id").join(indexed.select("vec_id", "embedding"), "vec_id")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            gap = _matrix(batch.column("query")) - _matrix(batch.column("embedding"))
            yield {"query_id": batch.column("query_id"), "vec_id": batch.column("vec_id"), "score": np.sqrt(np.square(gap).sum(axis=1)) if len(gap) else np.zeros(0)}

        return each

    exact = map_arrow(pairs.select("query_id", "vec_id", "query", "embedding"), "query_id long, vec_id long, score double", make)
    exact = exact.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return exact.withColumn("rank", F.row_number().over(by.orderBy("score", "vec_id"))).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(embeddings: DataFrame, is_query, nearest: int = NEAREST) -> DataFrame:
    """Fit, index every row, search with the rows for which is_query holds."""
    vectors = taking_part(embeddings)
    quantizer = fit(vectors)
    if quantizer is None:
        return embeddings.sparkSession.createDataFrame([], FOUND)
    indexed = materialize(index(vectors, quantizer), "index")
    return search(indexed, indexed.where(is_query), quantizer, nearest)
