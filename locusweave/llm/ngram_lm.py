"""An interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays, scored shard by shard.

Nothing of the model is gathered on the driver or broadcast whole, as it grows with the corpus. Words are 48-bit
hashes. Each task turns its documents into chunks and each chunk into one packed row per shard: the chunk's bigrams
(v, w), sorted, with their counts in training documents and the documents of their occurrences. A shard holds all
bigrams of the contexts v that fall to it; contexts that are a noticeable share of the corpus are dealt over all
shards by w instead, and their totals are summed over the shards. Then, all in one plan over one shuffle of the chunks:

1. each shard counts its bigrams, and asks the word shards about every w it has, telling them in how many contexts
   and how often it has seen w;
2. the word shards add that up and answer with the totals;
3. each shard writes its sorted hash arrays to a file, maps it into memory, scores every occurrence by binary search
   and returns sums by document of the chunk, which are added up by chunk.

Text: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, then one end token; a start context before the first. Unknown words
share the uniform mass of one word. Defined results: null and empty texts have the end token only; rows that repeat
a doc_id are scored each for itself; a null doc_id is neither learned from nor held out; extra columns don't matter;
an empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import SPACES, Words, map_arrow, text_blocks, worker_path

START, END = 1, 2
WORD = np.uint64((1 << 48) - 1)
#: Occurrences and documents of a chunk at most (one longer document is a chunk of its own).
CHUNK, CHUNK_DOCS = 1_000_000, 60_000
#: Occurrences of a shard, about; least shards; share of the corpus from which a context is dealt over all shards.
SHARD, LEAST_SHARDS, HOT = 3_000_000, 16, 0.002
FOLDS = 10


def pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block with an end token after each document, and the tokens of each document."""
    words = Words(data, offsets, SPACES)
    hashes = np.maximum(words.hashes() & WORD, np.uint64(3))
    return np.insert(hashes, words.first[1:], np.uint64(END)), np.diff(words.first) + 1


def train_fold(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS != 0


def hot_contexts(docs: DataFrame, share: float = HOT) -> tuple[int, np.ndarray]:
    """Tokens of the corpus, and the contexts of at least that share (so at most 1 / share of them): each block of
    documents names those that are common in it, and their counts are added up."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                found, n = np.unique(tokens(data, offsets)[0], return_counts=True)
                common = n >= share / 2 * n.sum()
                yield {"word": np.append(found[common], np.uint64(0)).view(np.int64), "n": np.append(n[common], n.sum())}

        return each

    counts = map_arrow(docs.select("text"), "word long, n long", make).groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.where("word = 0").first()
    total = total.n if total else 0
    rows = counts.where((F.col("word") > 0) & (F.col("n") >= share * total)).orderBy("word").collect()
    return total, np.array([START, *(r.word for r in rows)], np.uint64)


def _shard_of(v: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    return (np.where(np.isin(v, hot), w, v) % np.uint64(shards)).astype(np.int64)


ROW = "shard int, chunk long, docs int, v binary, runs binary, w binary, seen binary, train binary, doc binary, ids binary, lengths binary"


def chunks(docs: DataFrame, hot: np.ndarray, shards: int) -> DataFrame:
    """One packed row per chunk and shard; and per chunk one with its documents' ids and token counts."""
    held = docs.sparkSession.sparkContext.broadcast(hot)  # at most 1 / HOT + 1 words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 24, 0
        ids, parts, sizes, waiting = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            w, lengths = np.concatenate(parts), np.concatenate(sizes)
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            v = np.empty_like(w)
            v[1:] = w[:-1]
            v[first] = START
            learned = np.array([train_fold(i) for i in ids])
            doc = np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)
            shard = _shard_of(v, w, held.value, shards)
            order = np.lexsort((w, v | shard.astype(np.uint64) << np.uint64(48)))
            v, w, doc, shard = v[order], w[order], doc[order], shard[order]
            new_v = np.ones(len(v), bool)
            new_v[1:] = (v[1:] != v[:-1]) | (shard[1:] != shard[:-1])
            new = new_v.copy()
            new[1:] |= w[1:] != w[:-1]
            at = np.flatnonzero(new)
            seen = np.diff(np.append(at, len(v)))
            trained = np.add.reduceat(learned[doc].astype(np.int64), at)
            head = new_v[at]
            cut = np.searchsorted(shard[at], np.arange(shards + 1))
            for s in range(shards):
                a, b = cut[s], cut[s + 1]
                if a == b:
                    continue
                lo, hi = at[a], at[b] if b < len(at) else len(v)
                heads = np.flatnonzero(head[a:b])
                yield _row(s, base + number, len(lengths), pack48(v[at[a:b]][heads]), np.diff(np.append(heads, b - a)).astype("<u4").tobytes(), pack48(w[at[a:b]]), seen[a:b].astype("<u4").tobytes(), trained[a:b].astype("<u4").tobytes(), doc[lo:hi].astype("<u2").tobytes(), None, None)
            known = np.array([i is not None for i in ids])
            yield _row((base + number) % shards, base + number, len(lengths), None, None, None, None, None, np.packbits(known).tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), lengths.astype("<i8").tobytes())
            number += 1

        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                found, lengths = tokens(data, offsets)
                if ids and (waiting + len(found) > CHUNK or len(ids) + b - a > CHUNK_DOCS):
                    yield from flush()
                    ids, parts, sizes, waiting = [], [], [], 0
                ids += batch.column(0).slice(a, b - a).to_pylist()
                parts.append(found)
                sizes.append(lengths)
                waiting += len(found)
        if ids:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, ROW)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _row(*values, ddl: str = ROW) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema, strict=True)], schema=schema)


class Counts:
    """A shard's bigrams: sorted (v, w), their training counts; all distinct w."""

    def __init__(self, rows: list[dict]):
        part = [r for r in rows if r["v"] is not None]
        v = np.concatenate([np.zeros(0, np.uint64), *(np.repeat(unpack48(r["v"]), np.frombuffer(r["runs"], "<u4")) for r in part)])
        w = np.concatenate([np.zeros(0, np.uint64), *(unpack48(r["w"]) for r in part)])
        n = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["train"], "<u4").astype(np.int64) for r in part)])
        order = np.lexsort((w, v))
        v, w, n = v[order], w[order], n[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(new)
        self.v, self.w = v[at], w[at]
        self.n = np.add.reduceat(n, at) if len(at) else n
        self.words, self.word = np.unique(self.w, return_inverse=True)

    def of_counts(self) -> np.ndarray:
        return np.array([(self.n == k).sum() for k in (1, 2, 3, 4)], np.int64)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts, and for each: total count, and bigrams seen once, twice and more often."""
        heads = np.flatnonzero(np.diff(self.v, prepend=self.v[:1] ^ np.uint64(1)) != 0) if len(self.v) else np.zeros(0, np.int64)
        columns = [self.n, self.n == 1, self.n == 2, self.n >= 3]
        return self.v[heads], np.stack([np.add.reduceat(c.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64) for c in columns], 1)


ASK = "to int, shard int, w binary, kinds binary, times binary, of_counts binary, hot binary"
ANSWER = "shard int, from int, kinds binary, times binary, of_counts binary, hot binary"


def ask(table: pa.Table, hot: np.ndarray, shards: int) -> pa.Table:
    """Step 1 for one shard: questions to the word shards (all w of a residue), and, to word shard 0, the shard's
    counts of counts and its sums for the hot contexts."""
    rows = table.to_pylist()
    c = Counts(rows)
    kinds = np.bincount(c.word[c.n > 0], minlength=len(c.words))
    times = np.bincount(c.word, c.n, len(c.words)).astype(np.int64)
    v, sums = c.contexts()
    mine = np.zeros((len(hot), 4), np.int64)
    place = np.searchsorted(v, hot)
    there = (place < len(v)) & (v[np.minimum(place, max(0, len(v) - 1))] == hot) if len(v) else np.zeros(len(hot), bool)
    mine[there] = sums[place[there]]
    to = (c.words % np.uint64(shards)).astype(np.int64)
    out = []
    for s in range(shards):
        at = to == s
        if at.any() or s == 0:
            first = s == 0
            out.append(_row(s, rows[0]["shard"], pack48(c.words[at]), kinds[at].astype("<u4").tobytes(), times[at].astype("<i8").tobytes(), c.of_counts().astype("<i8").tobytes() if first else None, mine.astype("<i8").tobytes() if first else None, ddl=ASK))
    return pa.Table.from_batches(out)


def answer(table: pa.Table, shards: int) -> pa.Table:
    """Step 2 for one word shard: totals for every question, and to every shard the word shard's own sums."""
    rows = table.to_pylist()
    asked = [unpack48(r["w"]) for r in rows]
    words, index = np.unique(np.concatenate(asked), return_inverse=True)
    kinds = np.bincount(index, np.concatenate([np.frombuffer(r["kinds"], "<u4") for r in rows]), len(words)).astype(np.int64)
    times = np.bincount(index, np.concatenate([np.frombuffer(r["times"], "<i8") for r in rows]), len(words)).astype(np.int64)
    out, a, me = [], 0, rows[0]["to"]
    for r, q in zip(rows, asked, strict=True):
        i = index[a : a + len(q)]
        a += len(q)
        out.append(_row(r["shard"], me, kinds[i].astype("<u4").tobytes(), times[i].astype("<i8").tobytes(), None, None, ddl=ANSWER))
    of = np.array([(times > 0).sum(), times.sum(), kinds.sum(), *((kinds == k).sum() for k in (1, 2, 3, 4)), (kinds >= 3).sum()], np.int64)
    own = [np.frombuffer(r["of_counts"], "<i8") for r in rows if r["of_counts"] is not None]
    hot = [np.frombuffer(r["hot"], "<i8") for r in rows if r["hot"] is not None]
    sums = np.concatenate([of, sum(own) if own else np.zeros(4, np.int64)])
    for s in range(shards):
        out.append(_row(s, -1 - me, None, None, sums.astype("<i8").tobytes(), sum(hot).astype("<i8").tobytes() if hot else None, ddl=ANSWER))
    return pa.Table.from_batches(out)


def discounts(n: np.ndarray) -> np.ndarray:
    """Of counts 0, 1, 2 and 3 or more, from how many n-grams have counts 1 to 4; kept between 0 and the count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05 * (k + 1)), 0.95 * (k + 1)) for k, d in enumerate(raw))])


SUMS = "chunk long, docs int, score binary, base binary, known binary, ids binary, named binary, lengths binary, train long"


def score_shard(table: pa.Table, answers: pa.Table, hot: np.ndarray) -> pa.Table:
    """Step 3 for one shard."""
    rows, got = table.to_pylist(), answers.to_pylist()
    stats = sum(np.frombuffer(r["of_counts"], "<i8") for r in got if r["from"] < 0)
    vocabulary, total, kinds_total = (int(x) for x in stats[:3])
    low = discounts(stats[3:7])
    high = discounts(stats[8:12])
    out = []
    if any(r["v"] is not None for r in rows):
        c = Counts(rows)
        kinds, times = np.zeros(len(c.words), np.int64), np.zeros(len(c.words), np.int64)
        shards = sum(r["from"] < 0 for r in got)
        to = (c.words % np.uint64(shards)).astype(np.int64)
        for r in got:
            if r["from"] >= 0:
                kinds[to == r["from"]] = np.frombuffer(r["kinds"], "<u4")
                times[to == r["from"]] = np.frombuffer(r["times"], "<i8")
        uniform = 1 / (vocabulary + 1)
        if kinds_total:
            rest = low[1] * stats[3] + low[2] * stats[4] + low[3] * stats[7]
            unigram = (kinds - low[np.minimum(kinds, 3)]) / kinds_total + rest / kinds_total * uniform
        else:
            unigram = np.full(len(c.words), uniform)
        base = np.log10((times + 0.1) / (total + 0.1 * (vocabulary + 1)))
        v, sums = c.contexts()
        hot_sums = sum(np.frombuffer(r["hot"], "<i8").reshape(-1, 4) for r in got if r["from"] < 0 and r["hot"] is not None)
        place = np.searchsorted(v, hot)
        there = (place < len(v)) & (v[np.minimum(place, len(v) - 1)] == hot)
        sums[place[there]] = hot_sums[there]
        context = np.searchsorted(v, c.v)
        count = np.maximum(sums[:, 0], 1)
        back = np.where(sums[:, 0] > 0, (sums[:, 1:] @ high[1:]) / count, 1.0)
        p = (c.n - high[np.minimum(c.n, 3)]) / count[context] + back[context] * unigram[c.word]
        with tempfile.TemporaryDirectory() as folder:  # the shard of the model: sorted hash arrays, mapped into memory
            model = _stored(folder, v=c.v, w=c.w, p=np.log10(p), base=base[c.word], known=times[c.word] > 0)
            for r in rows:
                if r["v"] is not None:
                    out.append(_score_chunk(r, model))
            del model
    for r in rows:
        if r["v"] is None:
            out.append(_row(r["chunk"], r["docs"], None, None, None, r["ids"], r["doc"], r["lengths"], total, ddl=SUMS))
    return pa.Table.from_batches(out)


def _stored(folder: str, **arrays: np.ndarray) -> dict[str, np.ndarray]:
    for name, a in arrays.items():
        np.save(os.path.join(folder, name), a)
    return {name: np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r") for name in arrays}


def _find(model: dict[str, np.ndarray], v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the bigrams (all are there): the range of v, then w within it by a joint binary search."""
    lo, hi = np.searchsorted(model["v"], v), np.searchsorted(model["v"], v, "right")
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        less = open_ & (model["w"][np.minimum(mid, len(model["w"]) - 1)] < w)
        lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def _score_chunk(r: dict, model: dict[str, np.ndarray]) -> pa.RecordBatch:
    at = _find(model, np.repeat(unpack48(r["v"]), np.frombuffer(r["runs"], "<u4")), unpack48(r["w"]))
    doc, seen = np.frombuffer(r["doc"], "<u2"), np.frombuffer(r["seen"], "<u4")
    each = np.repeat(at, seen)
    sums = [np.bincount(doc, model[k][each], r["docs"]) for k in ("p", "base", "known")]
    return _row(r["chunk"], r["docs"], sums[0].astype("<f8").tobytes(), sums[1].astype("<f8").tobytes(), sums[2].astype("<u4").tobytes(), None, None, None, None, ddl=SUMS)


RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def add_up(table: pa.Table) -> pa.Table:
    """The documents of one chunk: sums over the shards."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["ids"] is None, r["score"] or b""))
    about = rows[0]
    n = about["docs"]
    score, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for r in rows[1:]:
        score += np.frombuffer(r["score"], "<f8")
        base += np.frombuffer(r["base"], "<f8")
        known += np.frombuffer(r["known"], "<u4")
    named = np.unpackbits(np.frombuffer(about["named"], np.uint8), count=n).astype(bool)
    return pa.table({"doc_id": pa.array(np.frombuffer(about["ids"], "<i8"), mask=~named), "n_tokens": np.frombuffer(about["lengths"], "<i8"), "n_known": known, "train_tokens": np.full(n, about["train"]), "base_score": base, "score": score})


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: model and scores of all documents."""
    worker_path(docs.sparkSession)
    total, hot = hot_contexts(docs)
    shards = max(LEAST_SHARDS, total // SHARD + 1)
    rows = chunks(docs, hot, shards)
    held = docs.sparkSession.sparkContext.broadcast(hot)
    questions = rows.groupBy("shard").applyInArrow(lambda t: ask(t, held.value, shards), ASK)
    answers = questions.groupBy("to").applyInArrow(lambda t: answer(t, shards), ANSWER)
    sums = rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(lambda a, b: score_shard(a, b, held.value) if a.num_rows else _schema(SUMS).empty_table(), SUMS)
    found = sums.groupBy("chunk").applyInArrow(add_up, RESULT)
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    return found.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
