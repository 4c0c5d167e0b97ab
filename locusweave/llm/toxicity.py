"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters look at a bounded sample of labelled rows (SAMPLE of each label, chosen by a hash of doc_id among the rows to
learn from): seed lexicons and lexicons mined from the sample, which vote by how dense their words are in a text, and
text patterns. Labels mine the lexicons, choose from what density on they vote, and give the share of class 1; no voter
votes as they say. The label model estimates by expectation-maximisation, from the votes alone, how each voter votes
given the hidden class, and from the residuals which voters are correlated; correlated votes count for less. A sparse
logistic regression on the presence of hashed words is trained on the posterior labels, and scores every whole text.

Defined results: null and empty texts get the score of a text without any known word; doc_ids without a document,
null labels and repeated labels (the highest counts) are allowed; rows that repeat a document get equal scores, and
count in the sample as often as they are there; texts of any length are scored whole; other columns don't matter;
without any labelled row, or with one label only, all scores are 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import NOT_ALNUM, Words, crc_mod, map_arrow, text_blocks

#: Word beginnings of so many bytes are features beside whole words; each at so many occurrences in a text.
BITS, PREFIXES, COUNTS = 18, (5, 6, 7, 8), (1, 2, 4)
SIZE = len(COUNTS) << BITS
#: Expected number of rows that are learned from, for label 1 and 0.
SAMPLE = (1500, 2500)
THRESHOLD = 0.3
#: Mined lexicons, the most features dealt over them, the least documents of label 1 each is in and its least log odds.
MINED, MOST_MINED, LEAST, ODDS = 8, 400, 8, 2.0
#: A lexicon votes 1 from the density on above which so many of the sample are of label 1, and a mined one 0 below the
#: density under which the share of label 1 is so small a part of that of the whole sample; sizes below SHORT are SHORT.
PRECISION, RESIDUE, SHORT = 0.9, 0.25, 40
#: Correlations that count; features of the classifier, and the least documents each is in.
CORRELATED = 0.15
FEATURES, COMMON = 4000, 5

#: Seed lexicons, one voter each. Fixed values.
LEXICONS = (
    ("idiot", "idiots", "moron", "morons", "imbecile"), ("stupid", "dumb", "brainless"), ("trash", "garbage", "scum", "filth"),
    ("loser", "losers", "clown", "clowns"), ("pathetic", "worthless", "useless"), ("disgusting", "vile", "repulsive"),
    ("hate", "hateful", "despise"), ("ugly", "freak"), ("damn", "hell"), ("bastard", "jerk", "creep"),
    ("dumm", "idiotin", "trottel", "abschaum", "verlierer"), ("idiota", "estúpido", "imbécil", "basura"), ("idiote", "crétin", "ordure"),
)
#: Pattern voters: what to look for, and the vote where it is found.
PATTERNS = (
    (re.compile(r"!{2,}"), 1), (re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){4}"), 1), (re.compile(r"([#%&$*])\1\1"), 1),
    (re.compile(r"\b[Yy]ou(?:'re| are)\b"), 1), (re.compile(r"(?i)\b(?:licensed?|copyright|terms of use)\b"), 0), (re.compile(r"https?://"), 0),
)


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def pairs(words: Words, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a block: (document, feature) of every word and word beginning, at the levels of COUNTS that its
    number of occurrences in the document reaches. used: which buckets are needed."""
    spelled = [(np.arange(len(words.start)), words.hashes()), *(words.prefix_hashes(n) for n in PREFIXES)]
    keys = []
    for at, h in spelled:
        b = bucket_of(h)
        if used is not None:
            keep = np.flatnonzero(used[b])
            at, b = at[keep], b[keep]
        keys.append((np.searchsorted(words.first, at, "right") - 1) << BITS | b)
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    document, bucket = key >> BITS, key & (1 << BITS) - 1
    levels = [(document[n >= c], bucket[n >= c] + (i << BITS)) for i, c in enumerate(COUNTS)]
    return np.concatenate([d for d, _ in levels]), np.concatenate([f for _, f in levels])


def _word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(bucket_of(Words(raw, np.array([0, len(raw)]), NOT_ALNUM).hashes())[0])


def sample(docs: DataFrame, labels: DataFrame, learn=None) -> list[tuple[np.ndarray, list[bool], int]]:
    """(features, which patterns are there, label) of a bounded sample of the labelled documents."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if learn is None else learn)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    h = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000_000))
    below = F.when(F.col("toxic") == 1, int(1e9 * min(1.0, SAMPLE[0] / max(1, n.get(1, 0))))).otherwise(int(1e9 * min(1.0, SAMPLE[1] / max(1, n.get(0, 0)))))
    chosen = known.where(h < below)  # about sum(SAMPLE) rows, whatever the input
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(h.alias("h"), "toxic", "text")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for a, b, data, offsets in text_blocks(batch.column(2)):
                words = Words(data, offsets, NOT_ALNUM)
                document, feature = pairs(words)
                order = np.argsort(document, kind="stable")
                cuts = np.searchsorted(document[order], np.arange(b - a + 1)).astype(np.int32)
                texts = [t or "" for t in batch.column(2).slice(a, b - a).to_pylist()]
                yield {
                    "h": batch.column(0).slice(a, b - a), "toxic": batch.column(1).slice(a, b - a),
                    "b": pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature[order].astype(np.int32))),
                    "p": pa.array([[bool(p.search(t)) for p, _ in PATTERNS] for t in texts], pa.list_(pa.bool_())),
                }

        return each

    got = map_arrow(rows, "h long, toxic int, b array<int>, p array<boolean>", make).toArrow().combine_chunks().sort_by("h")
    return [(got["b"][i].values.to_numpy(), got["p"][i].as_py(), got["toxic"][i].as_py()) for i in range(got.num_rows)]


def mined_lexicons(rows: list[tuple[np.ndarray, list[bool], int]]) -> list[np.ndarray]:
    """Features that label 1 has more often, dealt over MINED lexicons, so that each covers all kinds of text."""
    y = np.array([r[2] for r in rows])
    counts = [np.bincount(np.concatenate([r[0] for r in rows if r[2] == c] or [np.zeros(0, np.int64)]).astype(np.int64), minlength=SIZE) for c in (0, 1)]
    odds = np.log((counts[1] + 0.5) / ((y == 1).sum() + 1)) - np.log((counts[0] + 0.5) / ((y == 0).sum() + 1))
    good = np.flatnonzero((odds > ODDS) & (counts[1] >= LEAST))
    best = good[np.argsort(-odds[good] * np.sqrt(counts[1][good]), kind="stable")][:MOST_MINED]
    return [best[i::MINED] for i in range(MINED)]


def density_votes(density: np.ndarray, y: np.ndarray, both: bool) -> np.ndarray:
    """Votes of one lexicon: 1 from the least density on above which a share of PRECISION has label 1; if both, 0 below
    the largest under which label 1 is rare; else it abstains."""
    order = np.argsort(-density, kind="stable")
    seen = np.arange(1, len(y) + 1)
    sure = np.flatnonzero((np.cumsum(y[order]) >= PRECISION * seen) & (density[order] > 0))
    high = density[order[sure[-1]]] if len(sure) else np.inf
    out = np.where(density >= high, 1, -1).astype(np.int8)
    if both:
        clean = np.flatnonzero(np.cumsum(y[order[::-1]]) <= RESIDUE * y.mean() * seen)
        low = density[order[::-1][clean[-1]]] if len(clean) else 0.0
        out[(density <= low) & (density < high)] = 0
    return out


def votes(rows: list[tuple[np.ndarray, list[bool], int]]) -> np.ndarray:
    """Rows x voters: 1 (toxic), 0 (clean) or -1 (abstains): the seed lexicons, the patterns, the mined lexicons."""
    y = np.array([r[2] for r in rows])
    size = np.maximum(SHORT, [np.count_nonzero(r[0] < 1 << BITS) for r in rows])

    def densities(lexicons: list[np.ndarray]) -> np.ndarray:
        which = np.full(SIZE, len(lexicons))
        for k, features in enumerate(lexicons):
            which[features] = k
        return np.stack([np.bincount(which[r[0]], minlength=len(lexicons) + 1)[:-1] for r in rows]) / size[:, None]

    seeds, mined = densities([np.array([_word(w) for w in words]) for words in LEXICONS]), densities(mined_lexicons(rows))
    patterns = [np.array([vote if r[1][k] else -1 for r in rows], np.int8) for k, (_, vote) in enumerate(PATTERNS)]
    return np.stack([*(density_votes(d, y, False) for d in seeds.T), *patterns, *(density_votes(d, y, True) for d in mined.T)], 1)


@dataclass
class LabelModel:
    prior: float
    #: voters x classes x votes (-1, 0, 1): how likely a voter votes so, given the class.
    table: np.ndarray
    #: voters x voters: correlation of two voters' votes given the class, where above CORRELATED.
    correlation: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of class 1, from the votes cast (who abstains says nothing). A vote weighs 1 / (1 + the sum of
        its correlations with the others that vote)."""
        cast = (v >= 0).astype(float)
        weight = cast / (1 + cast @ self.correlation)
        logs = np.log(self.table)
        ratio = sum(weight[:, k] * (logs[k, 1, v[:, k] + 1] - logs[k, 0, v[:, k] + 1]) for k in range(v.shape[1]))
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + ratio, -30, 30)))


def fit_label_model(v: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """Expectation-maximisation that starts from the share of votes for class 1. Correlations come from what the votes'
    means by class leave over."""
    n, m = v.shape
    ones, cast_votes = (v == 1).sum(axis=1), (v >= 0).sum(axis=1)
    post = np.clip(ones / np.maximum(cast_votes, 1), 0.02, 0.98)
    model = LabelModel(prior, np.ones((m, 2, 3)), np.zeros((m, m)))
    cast = np.where(v >= 0, 2.0 * v - 1, 0.0)
    for _ in range(rounds):
        for c, weight in enumerate((1 - post, post)):
            for vote in range(3):
                model.table[:, c, vote] = ((v == vote - 1) * weight[:, None]).sum(axis=0) + 0.5
            model.table[:, c] /= model.table[:, c].sum(axis=1, keepdims=True)
        residual = cast - sum(np.outer(w, w @ cast / w.sum()) for w in (1 - post, post))
        residual /= residual.std(axis=0) + 1e-9
        corr = np.abs(residual.T @ residual / n)
        corr[corr < CORRELATED] = 0
        np.fill_diagonal(corr, 0)
        model.correlation = corr
        post = model.posterior(v)
    return model


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.used = (self.weights.reshape(len(COUNTS), -1) != 0).any(axis=0)

    def scores(self, words: Words) -> np.ndarray:
        """Score of each document of a block: the logistic of the bias and the weights of its features."""
        document, feature = pairs(words, self.used)
        z = self.bias + np.bincount(document, self.weights[feature], len(words.first) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_classifier(rows: list[tuple[np.ndarray, list[bool], int]], target: np.ndarray, weight: np.ndarray, l1: float = 1e-4, rounds: int = 400) -> Classifier:
    """Logistic regression on word presence and soft targets, by proximal gradient steps with momentum (L1)."""
    size = np.array([len(r[0]) for r in rows])
    flat, owner = np.concatenate([r[0] for r in rows]), np.repeat(np.arange(len(rows)), size)
    n, total = len(rows), weight.sum()
    often = np.bincount(flat, minlength=SIZE)
    mean = (weight @ target) / total
    gain = np.abs(np.bincount(flat, (weight * (target - mean))[owner], SIZE)) / np.sqrt(often + 5.0)
    gain[often < COMMON] = 0
    chosen = np.zeros(SIZE, bool)
    chosen[np.argsort(-gain, kind="stable")[:FEATURES]] = True
    kept = chosen[flat]
    columns, index = np.unique(flat[kept], return_inverse=True)
    owner = owner[kept]
    w, b, look, look_b, t = np.zeros(len(columns)), 0.0, np.zeros(len(columns)), 0.0, 1.0
    # steps suit how often a word occurs: a rare word's curvature is small
    share = np.bincount(index, weight[owner], len(columns)) / total
    rate = 1.0 / (share * 12 + 0.02)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(look_b + np.bincount(owner, look[index], n), -30, 30)))
        gap = (p - target) * weight / total
        step = look - rate * np.bincount(index, gap[owner], len(columns))
        new = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        new_b = look_b - 1.0 * gap.sum()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        if gap @ (p - target) > 0 and np.dot(look - new, new - w) > 0:
            t = 1.0  # restart the momentum
        momentum = min(0.9, (before - 1) / t) if t > 1 else 0.0
        look, look_b = new + momentum * (new - w), new_b + momentum * (new_b - b)
        w, b = new, new_b
    full = np.zeros(SIZE)
    full[columns] = w
    return Classifier(full, float(b))


def train(docs: DataFrame, labels: DataFrame, learn=None) -> Classifier:
    rows = sample(docs, labels, learn)
    if not rows or len({r[2] for r in rows}) < 2:
        return Classifier(np.zeros(SIZE), -30.0)
    y = np.array([r[2] for r in rows])
    v = votes(rows)
    model = fit_label_model(v, float(np.clip(y.mean(), 0.01, 0.99)))
    return fit_classifier(rows, model.posterior(v), np.ones(len(rows)))


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, score."""
    held = docs.sparkSession.sparkContext.broadcast(classifier)  # 2**BITS weights

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            parts = [held.value.scores(Words(data, offsets, NOT_ALNUM)) for _, _, data, offsets in text_blocks(batch.column(1))]
            yield {"doc_id": batch.column(0), "score": np.concatenate([np.zeros(0), *parts])}

        return each

    return map_arrow(docs.select("doc_id", "text"), "doc_id long, score double", make)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    scored = score(docs, train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
