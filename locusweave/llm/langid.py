"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are byte n-grams (2 to 5) of the lower-cased text, word boundaries included, hashed to BUCKETS rows of an
embedding table; a text's vector is the mean over all its n-grams. The table and the softmax are trained on a bounded
sample (SAMPLE documents per language, chosen by a hash of doc_id among the rows to learn from). Scores are
calibrated by a temperature fitted on a part of the sample that training leaves out; a text is rejected if it has no
letter or its score is below a threshold at which at most REJECT of that part would be lost.

Defined results: null, empty and letterless texts get `und`, score 0, and are rejected (letters are Unicode's; digits, fractions
and signs are none); whole texts count, however long; repeated rows get equal results; a row without doc_id is neither
learned from nor held out; an empty table gives no rows; ties go to the first language in order; every language with a row to learn from is
learned; with no labelled row every text is `und`; extra columns don't matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import BLOCK_BYTES, crc_mod, ddl, fresh, map_arrow

GRAMS = (2, 3, 4, 5)
BUCKETS, DIM = 1 << 15, 12
#: Documents of a language that are learned from (expected; whole texts); of more than so many languages each gets fewer.
SAMPLE, LANGUAGES = 600, 200
EPOCHS, RATE, BATCH = 6, 0.6, 16
REJECT = 0.001


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode(), np.uint8)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times softmax weights, as both are linear; or the embedding, if soft is given
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    soft: np.ndarray | None = None  # softmax weights, apart where they are more than the embedding has columns

    def logits(self, text: str) -> np.ndarray:
        """Mean over all n-grams, from how often each bucket occurs: the work and memory are bounded by BUCKETS x languages."""
        b, share = features(text)
        mean = share @ self.table[b] if len(b) < BUCKETS // 4 else np.bincount(b, share, BUCKETS) @ self.table
        return (mean if self.soft is None else mean @ self.soft) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, accepted."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] >= self.threshold)


def _of_size(raw: np.ndarray, size: int) -> np.ndarray:
    if len(raw) < size:
        return np.zeros(0, np.int32)
    x = raw.astype(np.uint32) + np.uint32(1)
    h = x[: len(x) - size + 1]
    for j in range(1, size):
        h = h * np.uint32(0x01000193) + x[j : len(x) - size + 1 + j]
    return (((h + np.uint32(size)) * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's n-grams (BUCKETS at most) and their shares; a long text is taken in pieces that overlap by the longest
    n-gram less one."""
    raw = _bytes(text)
    total = np.zeros(BUCKETS, np.int64)
    for a in range(0, len(raw), BLOCK_BYTES):
        total += np.bincount(np.concatenate([_of_size(raw[a : a + BLOCK_BYTES + size - 1], size) for size in GRAMS]), minlength=BUCKETS)
    b = np.flatnonzero(total)
    return b.astype(np.int32), total[b] / max(1, total.sum())


def sample(docs: DataFrame, learn) -> DataFrame:
    """Features and language of about SAMPLE documents a language, fewer of each (one at least) beyond LANGUAGES languages,
    spread by a hash of their ids: h (the hash), lang, b, w."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    h = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_000_000))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(h).alias("first"))
    each_gets = min(SAMPLE, SAMPLE * LANGUAGES / max(1, counts.count()))
    below = counts.select("lang", F.greatest((1e9 * F.least(F.lit(1.0), each_gets / F.col("n"))).cast("long"), F.col("first") + 1).alias("below"))

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            got = [features(t.as_py()) for t in batch.column(2)]
            yield {"h": batch.column(0), "lang": batch.column(1), "b": pa.array([g[0] for g in got], pa.list_(pa.int32())), "w": pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32()))}

        return each

    return map_arrow(known.join(F.broadcast(below), "lang").where(h < F.col("below")).select(h.alias("h"), "lang", "text"), "h long, lang string, b array<int>, w array<float>", make)


def _rows(drawn: pa.Table) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """The sample's rows, in an order that doesn't depend on partitions."""
    order = np.lexsort((drawn["lang"].to_numpy(zero_copy_only=False).astype(str), drawn["h"].to_numpy()))
    return [(drawn["b"][i].values.to_numpy(), drawn["w"][i].values.to_numpy(), drawn["lang"][i].as_py()) for i in order.tolist()]


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7) -> Model:
    """Minibatch SGD on (buckets, shares, language); every eighth row is kept for the calibration."""
    languages = sorted({lang for _, _, lang in rows})
    n_lang = len(languages)
    if not n_lang:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    number = {lang: k for k, lang in enumerate(languages)}
    seen = [(b, w, number[lang]) for b, w, lang in rows]
    held = [x for i, x in enumerate(seen) if i % 8 == 0] if len(seen) >= 40 else seen
    fit = [x for i, x in enumerate(seen) if i % 8] if len(seen) >= 40 else seen
    table, soft, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, n_lang)).astype(np.float32), np.zeros(n_lang, np.float32)
    steps, step = max(1, EPOCHS * (len(fit) // BATCH + 1)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for i in range(0, len(order), BATCH):
            batch = [fit[k] for k in order[i : i + BATCH]]
            hidden = np.stack([w @ table[b] for b, w, _ in batch])
            p = _softmax(hidden @ soft + bias)
            p[np.arange(len(batch)), [y for _, _, y in batch]] -= 1
            rate = RATE * (1 - step / steps) + 0.01
            back = p @ soft.T
            soft -= 20 * rate * hidden.T @ p / len(batch)
            bias -= rate * p.mean(axis=0)
            for (b, w, _), d in zip(batch, back, strict=True):
                table[b] -= 20 * rate * w[:, None] * d  # each text moves its own rows
            step += 1
    apart = soft.astype(np.float64) if n_lang > DIM else None
    both = (table @ soft if apart is None else table).astype(np.float64)
    z = np.stack([w @ both[b] for b, w, _ in held])
    z = (z if apart is None else z @ apart) + bias
    y = np.array([k for _, _, k in held])
    loss = lambda t: -float(np.mean(np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-300)))
    temperature = min((float(t) for t in np.geomspace(0.01, 5, 80)), key=loss)
    top = _softmax(z / temperature).max(axis=1)
    threshold = min(0.5, float(np.quantile(top, REJECT)) * 0.999)
    return Model(languages, both, bias.astype(np.float64), temperature, threshold, apart)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, learn=None) -> Model:
    """The model, trained in one task from the bounded sample; only the model, of a size fixed by BUCKETS, reaches the driver."""
    drawn = sample(docs, F.lit(True) if learn is None else learn)
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("b", pa.list_(pa.int32())), ("w", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b.cast(schema) for b in batches], schema)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(_rows(table)))], pa.binary())], names=["model"])

    return pickle.loads(drawn.repartition(1).mapInArrow(run, "model binary").first().model)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with three more columns, named _lang, _score and _accepted (or so that they clash with none); the model is a
    table of fixed size (BUCKETS rows)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"_lang": "string", "_score": "double", "_accepted": "boolean"}
    current = docs.withColumns({n: F.lit(None).cast(k) for n, k in zip(fresh(docs, *kinds), kinds.values(), strict=True)})
    schema = ddl(current)

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            got = [held.value.predict(t.as_py()) for t in batch.column("text")]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *new], names=batch.schema.names)

        return each

    return map_arrow(current, schema, make)


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted."""
    model = fit(docs, crc_mod("doc_id", 4) != 2)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_accepted").alias("accepted"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with all their columns."""
    model = fit(docs, crc_mod("doc_id", 4) != 2)
    return identify(docs, model).where(F.col(fresh(docs, "_accepted")[0])).select(docs.columns)
