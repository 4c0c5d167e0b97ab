"""The text operators against brute force and the libraries, with nulls, empty texts, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from locusweave.llm import bpe_count, decontaminate, graph, langid, line_dedup, ngram_lm, packing, quantized_search, queries, simhash, toxicity, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hits string, _removed int, _score string, n int"
WORDS = "the of and in to that is was for on as with by at from river stone light water green house".split()


def make_texts(seed=1, n=60):
    rnd = random.Random(seed)
    out = [None, "", " \t\n", "one", "Two words", "\u00e9t\u00e9 \u6f22\u5b57 \U0001f600", "x" * 5000]
    for _ in range(n):
        t = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 60)))
        out.append(t.capitalize() + (".\n" + t.upper() if rnd.random() < 0.2 else "."))
        if rnd.random() < 0.3:
            words = t.split()
            words[rnd.randrange(len(words))] = "stone"
            out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = make_texts()
    rows = [(i, t, "en" if i % 3 else "de", "s", len(t or ""), "clash", 1, "clash", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[9], rows[9]], SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


# ------------------------------------------------------------------ 1


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.round(centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16)), 2)
    x[5] = x[7]
    rows = [(i, [float(v) for v in x[i]], "clash") for i in range(900)]
    bad = [(1000, None, ""), (1001, [0.0] * 16, ""), (1002, [float("nan")] * 16, ""), (1003, [1.0] * 3, ""), (None, [1.0] * 16, ""), (1004, [None] * 16, ""), (1005, [float("inf")] * 16, "")]
    df = spark.createDataFrame([*rows, *bad, rows[20]], "vec_id long, embedding array<float>, code string")
    got = collections.defaultdict(list)
    for r in quantized_search.nearest_neighbours(df, "vec_id % 10 = 0").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    y = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 900, 10):
        d = np.sqrt(np.square(y - y[q]).sum(axis=1))
        want = [v for v in np.lexsort((np.arange(900), d)) if v != q][:10]
        assert [r for r, *_ in got[q]] == list(range(1, 11)) and len({v for _, v, _ in got[q]}) == 10
        assert all(abs(s - d[v]) < 1e-9 for _, v, s in got[q]) and [s for *_, s in got[q]] == sorted(s for *_, s in got[q])
        hits += len({v for _, v, _ in got[q]} & set(want))
    assert hits / 900 >= 0.95 and set(got) == set(range(0, 900, 10))
    few = spark.createDataFrame(rows[:4], df.schema)
    assert quantized_search.nearest_neighbours(few, "vec_id = 0").count() == 3
    assert quantized_search.nearest_neighbours(df.where("false"), "true").count() == 0


def test_search_reranks_few_rows(spark, monkeypatch):
    monkeypatch.setattr(quantized_search, "RERANK", 60)  # 2 % of the rows
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32)) @ rng.normal(size=(32, 32)) / 4
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(2)
    got = collections.defaultdict(set)
    for r in quantized_search.nearest_neighbours(df, "vec_id % 30 = 0").collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 30):
        d = np.square(x - x[q]).sum(axis=1)
        hits += len(got[q] & {v for v in np.lexsort((np.arange(3000), d)).tolist() if v != q and v in np.argsort(d)[:11]})
    assert hits / 1000 >= 0.9


def test_search_of_large_components_and_common_rows(spark):
    rows = [(i, [1e20 * (1 + (i * 7 % 13)), 1e20 * (i % 5), -1e20]) for i in range(40)] + [(100 + i % 2, [3e20, 1e20, -1e20]) for i in range(3000)] + [(200 + i, [5e20, 0.0, 1e20]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in quantized_search.nearest_neighbours(df, "vec_id IN (0, 1, 205)").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert [v for v, _ in got[205]] == [200, 201, 202, 203, 204, 206, 207, 208, 209, 210] and {s for _, s in got[205]} == {0.0}
    for q in (0, 1):
        vectors = dict(rows)
        d = {v: math.dist(vectors[q], x) for v, x in vectors.items() if v != q}
        assert [s for _, s in got[q]] == pytest.approx(sorted(d.values())[:10])


# ------------------------------------------------------------------ 2


def test_toxicity(spark, docs, nothing):
    found = queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.93
    bad = [(i, 1) for i in range(0, 60, 4)] + [(i, 0) for i in range(1, 60, 2)] + [(0, 0), (None, 1), (9999, 1), (3, None)]
    df = spark.createDataFrame(bad, "doc_id long, toxic int")
    assert toxicity.classify(docs, df).count() == docs.count()
    assert toxicity.classify(docs, df.where("false")).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.classify(nothing, df).count() == 0


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda acc: np.where(rng.random(4000) < acc, y, ~y).astype(np.int8)
    good, weak = vote(0.9), vote(0.65)
    v = np.stack([good, weak, weak.copy(), weak.copy(), np.where(rng.random(4000) < 0.5, -1, vote(0.8)).astype(np.int8), vote(0.97)], 1)
    m = toxicity.fit_label_model(v, 0.3)
    assert m.correlation[1, 2] > 0.9 and m.correlation[0, 1] == 0
    assert abs(m.table[0, 1, 2] - 0.9) < 0.05 and abs(m.table[1, 1, 2] - 0.65) < 0.06
    assert ((m.posterior(v) > 0.5) == y).mean() > 0.95


def test_labels_are_no_voter():
    """Rows that differ in their label only get the same votes and so the same posterior."""
    rng = np.random.default_rng(1)
    bad, common = np.arange(100, 140), np.arange(1000, 3000)
    rows = []
    for i in range(600):
        label = int(i % 4 == 0)
        features = rng.choice(common, 60, replace=False)
        rows.append((np.concatenate([features, rng.choice(bad, 12, replace=False)]) if label else features, [False] * len(toxicity.PATTERNS), label))
    flipped = [(f, p, 1 - y) if i < 8 else (f, p, y) for i, (f, p, y) in enumerate(rows)]
    v = toxicity.votes(flipped)
    post = toxicity.fit_label_model(v, 0.25).posterior(v)
    truth = np.array([y for _, _, y in rows])
    assert ((post > 0.5) == truth).all()  # of the eight with the wrong label too
    twins = toxicity.votes([*flipped, *((f, p, 1 - y) for f, p, y in flipped[:1])])
    assert (twins[0] == twins[-1]).all()


# ------------------------------------------------------------------ 3


def test_ngram_model(spark, docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    toks = [[*words_of(r.text), 0] for r in rows]
    train = [zlib.crc32(str(r.doc_id).encode()) % 10 != 0 for r in rows]
    uni, bi = collections.Counter(), collections.Counter()
    for t, f in zip(toks, train, strict=True):
        if f:
            uni.update(t)
            bi.update(zip([1, *t[:-1]], t, strict=True))
    n, v = sum(uni.values()), len(uni)
    kinds = collections.Counter(w for _, w in bi)
    high = ngram_lm.discounts(np.array([sum(x == k for x in bi.values()) for k in (1, 2, 3, 4)]))
    low = ngram_lm.discounts(np.array([sum(x == k for x in kinds.values()) for k in (1, 2, 3, 4)]))
    total, rest = sum(kinds.values()), sum(low[min(x, 3)] for x in kinds.values())
    count, mass = collections.Counter(), collections.Counter()
    for (c, _), x in bi.items():
        count[c] += x
        mass[c] += high[min(x, 3)]
    p1 = lambda w: (kinds[w] - low[min(kinds[w], 3)]) / total + rest / total / (v + 1)
    p2 = lambda c, w: (bi[c, w] - high[min(bi[c, w], 3)]) / count[c] + mass[c] / count[c] * p1(w) if count[c] else p1(w)
    assert abs(sum(p1(w) for w in uni) + rest / total / (v + 1) - 1) < 1e-9
    got = collections.defaultdict(list)
    for r in ngram_lm.score(docs).collect():
        got[r.doc_id].append(r)
    assert len(got[9]) == 3
    for r, t, f in zip(rows, toks, train, strict=True):
        x = got[r.doc_id][0]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (not f, len(t), sum(uni[w] > 0 for w in t), n)
        assert abs(x.base_score - sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-8
        assert abs(x.score - sum(math.log10(p2(c, w)) for c, w in zip([1, *t[:-1]], t, strict=True))) < 1e-8
    assert ngram_lm.score(nothing).count() == 0


# ------------------------------------------------------------------ 4


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    special = spark.createDataFrame([(500, "a <|endoftext|> b  <|end"), (501, "word " * 9000)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(special)
    rows = packing.pack(every, path, ids=True).collect()
    texts = dict(every.collect())
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert set(pieces) == set(texts)
    for d, found in pieces.items():
        want = [*library.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        if d != 9:
            got = [i for r in sorted(found, key=lambda r: r.start) for i in r.ids]
            assert got == want and [r.start for r in sorted(found, key=lambda r: r.start)] == list(range(0, len(want), 2048))
        assert all(r.doc_tokens == len(want) for r in found)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(nothing, path).count() == 0


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(1)
    demand = np.bincount(rng.integers(1, 65, 3000), minlength=65)[1:].astype(np.int64)
    patterns, uses = packing.solve(demand)
    bound = (demand * np.arange(1, 65)).sum() / 64
    assert bound - 1e-6 <= uses.sum() <= 1.02 * bound
    used = packing.whole(demand, patterns, uses)
    assert sum(p * n for p, n in used).tolist() == demand.tolist() and all((p * np.arange(1, 65)).sum() <= 64 for p, _ in used)
    assert sum(n for _, n in used) <= uses.sum() + 65


# ------------------------------------------------------------------ 5


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, text, n):
    t = list(text)
    for _ in range(n):
        k = rnd.randrange(len(t))
        match rnd.randrange(3):
            case 0:
                t[k] = rnd.choice("abc\u00e9")
            case 1:
                t.insert(k, rnd.choice("abc\u00e9"))
            case 2:
                del t[k]
    return "".join(t)


def linked(a, b):
    """The rule by which lines are linked, plainly."""
    x, y = re.split("[ \t\r\f\v]", a), re.split("[ \t\r\f\v]", b)
    n = min(len(x), len(y))
    if n >= 10:
        most = 4 if n >= 184 else 3 if n >= 30 else 2
    else:
        x, y, n = a, b, min(len(a), len(b))
        most = 2 if n >= 40 else 1 if n >= 20 else 0
    return most > 0 and abs(len(x) - len(y)) <= most and distance(x, y) <= most


@pytest.mark.parametrize("hot", [256, 2])
def test_line_links_are_all_links(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "SAMPLED", 1)
    rnd, lines = random.Random(8), set()
    for _ in range(50):  # by characters
        base = "".join(rnd.choice("abc\u00e9 ") for _ in range(rnd.randint(18, 70))).strip() + "x"
        lines |= {base, *(edited(rnd, base, rnd.randint(1, 4)).strip() for _ in range(4))}
    for n in [*range(8, 48, 2), 31, 33, 60, 100, 183, 184, 186, 400]:  # by words
        base = [rnd.choice(WORDS) + rnd.choice(["", "s", "ing", "\u00e9"]) for _ in range(n)]
        lines.add(" ".join(base))
        for edits in (1, 2, 3, 4, 5):
            t = list(base)
            for place in sorted(rnd.sample(range(n), edits), reverse=True):
                match rnd.randrange(4):
                    case 0:
                        t.insert(place, "entirely")
                    case 1:
                        del t[place]
                    case _:
                        t[place] = "otherwise"
            lines.add(" ".join(t))
        lines |= {edited(rnd, " ".join(base), 2).strip(), "\t".join(base)}
    evenly = ["the"] * 45
    lines |= {" ".join(evenly), " ".join("of" if i % 15 == 8 else w for i, w in enumerate(evenly) if i < 44)}
    lines = sorted(x for x in lines if x)
    df = spark.createDataFrame([(i, x, len(re.split("[ \t\r\f\v]", x)), 1) for i, x in enumerate(lines)], "id long, norm string, words int, weight int")
    want = {(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and abs(len(a) - len(b)) < 60 and linked(a, b)}
    got = {(r.a, r.b) for r in line_dedup.links(df).collect()}
    assert got <= want and rooted(got) == rooted(want) and (hot == 2 or got == want) and len(want) > 300


def rooted(edges):
    """The least node of each node's component."""
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_line_dedup_of_a_large_near_group(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SAMPLED", 1)
    words = [f"{w}{i}" for i, w in enumerate(WORDS * 2)][:40]
    base, other = " ".join(words), " ".join([*words[:20], *(f"else{i}" for i in range(20))])
    rows = [(0, base), (1, base), (2, other)]
    for i in range(1500):
        t = list(words)
        for k in range(1 + i % 3):
            t[(7 * i + 11 * k) % 40] = f"v{i}x{k}"
        rows.append((10 + i, " ".join(t)))
    rows += [(5000 + i, " ".join([*words[:20], *(f"o{i}x{k}" for k in range(20))])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in line_dedup.report(df).collect()}
    assert len({got[d].lines[0].class_id for d, _ in rows if d not in (2,) and d < 5000}) == 1 and got[0].lines[0].n_texts == 1501
    assert [d for d in sorted(got) if not got[d].n_removed] == [0, 2, *range(5000, 5400)]


@pytest.mark.parametrize("hot", [64, 2])
def test_lines_that_share_only_a_segment_are_no_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "SAMPLED", 1)
    verified, verify = [], line_dedup.verify
    monkeypatch.setattr(line_dedup, "verify", lambda met, lines: verified.append(met.count()) or verify(met, lines))
    lines = [" ".join([*WORDS, *(f"o{i}x{k}" for k in range(20))]) for i in range(40)]
    lines += [lines[0].replace("o0x7 ", "else "), lines[0].replace("o0x7 ", "")]
    df = spark.createDataFrame([(i, x, x.count(" ") + 1, 1) for i, x in enumerate(lines)], "id long, norm string, words int, weight int")
    got = {(r.a, r.b) for r in line_dedup.links(df).collect()}
    assert rooted(got) == {0: 0, 40: 0, 41: 0}
    assert sum(verified) < 40  # of 861 pairs that share a segment


def test_line_dedup_where_doc_ids_repeat(spark):
    rows = [(1, "a unique line of row A\nkept"), (1, "a dup line\nother"), (0, "a dup line"), (3, "twice the same"), (3, "twice the same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup(df).collect()) == [(0, "a dup line"), (1, "a unique line of row A\nkept"), (1, "other"), (3, "twice the same"), (3, "twice the same")]


def test_line_dedup_keeps_the_first(spark, docs, nothing):
    first = "A line of some length that stands in many documents, again"
    rows = [(3, f"{first}\nown line three"), (1, f"{first.upper()}x\n\nown line one\nown line one"), (2, first), (4, None), (5, ""), (6, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed_lines) for r in line_dedup.report(df).collect()}
    assert got == {1: (4, 1, "3"), 2: (1, 1, "0"), 3: (2, 1, "0"), 4: (0, 0, ""), 5: (1, 0, ""), 6: (2, 0, "")}
    kept = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert kept == {1: f"{first.upper()}x\n\nown line one", 3: "own line three", 4: None, 5: "", 6: " \n "}
    assert line_dedup.dedup(docs).columns == docs.columns and line_dedup.report(nothing).count() == 0


def test_line_report_names_classes(spark):
    a, b, c, d = (" ".join(f"w{i}" if i not in put else f"other{i}" for i in range(20)) for put in ((), (3, 9), (3, 9, 11, 17), (1, 2, 4, 5, 6, 7)))
    df = spark.createDataFrame([(1, f"{a}\n\n{d}"), (2, b), (3, f"{c}\n{a.upper()}"), (4, None), (5, " ")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.report(df).collect()}
    lines = {(k, x.pos): x for k, r in got.items() for x in r.lines}
    assert set(lines) == {(1, 0), (1, 2), (2, 0), (3, 0), (3, 1)}
    assert {k: x.n_texts for k, x in lines.items()} == {(1, 0): 3, (1, 2): 1, (2, 0): 3, (3, 0): 3, (3, 1): 3}
    near = [lines[k] for k in ((1, 0), (2, 0), (3, 0), (3, 1))]
    assert {x.class_id for x in near} == {min(x.line_id for x in near)} and lines[1, 2].class_id == lines[1, 2].line_id
    assert lines[1, 0].line_id == lines[3, 1].line_id and len({x.line_id for x in near}) == 3
    assert {k: r.removed_lines for k, r in got.items()} == {1: "", 2: "0", 3: "0,1", 4: "", 5: ""}


def test_line_dedup_without_doc_ids(spark):
    line = "A line of some length that stands in many documents, again"
    rows = [(None, f"{line}\nonly here"), (7, f"own line seven\n{line}"), (None, "quite another text"), (None, f"own line\n{line}"), (None, "quite another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup(df).collect()) == [(0, "only here"), (0, "own line"), (0, "quite another text"), (0, "quite another text"), (7, f"own line seven\n{line}")]
    assert sorted((r.doc_id or 0, r.n_lines, r.removed_lines, len(r.lines)) for r in line_dedup.report(df).collect()) == [(0, 1, "", 1), (0, 1, "", 1), (0, 2, "0", 2), (0, 2, "1", 2), (7, 2, "", 2)]


def test_no_python_in_native_plans(spark):
    for name in ("op10_url_filter", "op5_line_dedup"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------------------ 6


def test_language(spark, docs, nothing):
    found = queries.op6_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98 and sum(r.accepted for r in found) / len(found) > 0.99
    got = {r.doc_id: r for r in langid.classify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (0, 1, 2)) and got[5].lang_pred in ("en", "de")
    assert langid.keep_identified(docs).columns == docs.columns
    odd = spark.createDataFrame([(None, "the of and"), (7, "\u00bd \u00b2 12"), (8, "the water " * 300_000), (9, "the of and"), (9, "the of and")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    odd = {(r.doc_id, r.lang_pred, r.held_out is None) for r in langid.classify(odd).collect()}
    assert odd == {(None, "en", False), (7, "und", False), (8, "en", False), (9, "en", False)}
    assert langid.classify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    assert langid.classify(nothing).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    monkeypatch.setattr(langid, "SAMPLE", 4)
    rows = [(100 * k + i, f"word{k} text{k} " * 5, f"l{k:02}") for k in range(15) for i in range(20 if k < 3 else 6)]
    drawn = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).toArrow()
    drawn = langid._rows(drawn)
    assert {lang for *_, lang in drawn} == {f"l{k:02}" for k in range(15)} and len(drawn) < 40
    model = langid.train(drawn)
    assert len(model.languages) == 15 and model.predict("word14 text14")[0] in model.languages


# ------------------------------------------------------------------ 7


def brute_fingerprint(text):
    w = words_of(text)
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("hot", [512, 1])
def test_simhash(spark, docs, nothing, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rows = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    parent = {d: d for d in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in rows:
        for b in rows:
            if a < b and (rows[a] ^ rows[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = simhash.classes(docs).collect()
    assert len(got) == docs.count() and {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{rows[d]:016x}", root(d)) for d in rows}
    kept = simhash.dedup(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root(d) for d in rows}) and kept.columns == docs.columns
    assert simhash.classes(nothing).count() == 0


def test_simhash_without_doc_ids(spark, monkeypatch):
    texts = [(None, "one text of its own, without a number"), (5, "a text with a number"), (None, "a text with a number"), (None, None), (None, "one text of its own, without a number")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in texts], "doc_id long, text string, _fp string")
    kept = simhash.dedup(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "one text of its own, without a number"), (5, "a text with a number")]
    fps = {"A": 0, "N": 0b11, "B": 0b1111}  # A and B are linked over N alone, which has no number
    monkeypatch.setattr(simhash, "fingerprint", lambda text, shingle: fps[text])
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs.select("doc_id", F.when(F.col("text") == "A", 0).when(F.col("text") == "N", 3).otherwise(15).cast("long").alias("fp")))
    chain = spark.createDataFrame([(2, "A"), (None, "N"), (1, "B")], "doc_id long, text string")
    assert {r.component_id for r in simhash.classes(chain).collect()} == {1} and [r.doc_id for r in simhash.dedup(chain).collect()] == [1]


def test_links_near_each_other(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 8)
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    values = {base} | {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in values], "fp long")
    got = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    label = {x: x for x in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            least = min((label[b] for b in values if (a ^ b).bit_count() <= 2), key=signed)
            if signed(least) < signed(label[a]):
                label[a], changed = least, True
    assert {signed(x): signed(y) for x, y in label.items() if sum(v == y for v in label.values()) > 1} == got


# ------------------------------------------------------------------ 8


def test_token_counts(spark, docs, nothing):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in bpe_count.count_tokens(docs, path, 100).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text)) if r.text else 0
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 100)
    counter, rnd = bpe_count.counter_for(path), random.Random(3)
    for _ in range(3000):
        t = "".join(rnd.choice("ab the  \n\t\u2581<s>\u00e9\u6f22\U0001f600\u3000ing1.!xX") for _ in range(rnd.randint(0, 25)))
        assert bpe_count.count(t, counter) == len(library.encode(t)), t
    assert bpe_count.count_tokens(nothing, path).count() == 0


# ------------------------------------------------------------------ 9


def brute_hits(text, items):
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    w = find(text)
    hit, named = set(), set()
    for item, t in items:
        x = find(t)
        for k in range(max(1, len(x) - 9)) if x else ():
            window = x[k : k + 10]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    named.add(item)
    return len(w), hit, named


@pytest.mark.parametrize("block", [8_000_000, 60])
def test_decontamination(spark, docs, nothing, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", block)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    items = [(7, texts[20]), (10, texts[20]), (3, "Green HOUSE"), (4, None), (5, "..."), (12, " ".join(words_of(texts[30])[2:].__iter__().__next__().decode() for _ in range(1)))]
    benchmark = spark.createDataFrame([*items, (None, "river")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.digest(docs, benchmark).collect()}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, benchmark).collect()}
    kept = {r.doc_id for r in decontaminate.remove_documents(docs, benchmark).collect()}
    for r in docs.collect():
        n, hit, named = brute_hits(r.text, items)
        x = got[r.doc_id]
        digest = hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest()
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == (n, len(hit), len(named), digest, bool(hit))
        assert (r.doc_id in kept) == (not hit) and (brute_hits(cut[r.doc_id], [])[0] == n - len(hit))
    assert any(x.contaminated for x in got.values()) and decontaminate.digest(nothing, benchmark).count() == 0
    assert decontaminate.digest(docs, benchmark.where("false")).where("contaminated").count() == 0


# ------------------------------------------------------------------ 10


def test_urls_of_hosts_that_were_held_out():
    right = total = 0
    for fold in range(5):
        keep = lambda hosts: tuple(h for i, h in enumerate(hosts) if i % 5 != fold)
        model = url_filter.fit(url_filter.labelled_urls(keep(url_filter.BAD_HOSTS), keep(url_filter.GOOD_HOSTS)))
        out = url_filter.labelled_urls(url_filter.BAD_HOSTS[fold::5], url_filter.GOOD_HOSTS[fold::5])
        right += sum((url_filter.log_odds(u, model) > 0) == y for u, y in out)
        total += len(out)
    print("held-out accuracy", right / total)
    assert total == len(url_filter.labelled_urls()) and right / total > 0.85


def test_url_filter(spark):
    con = duckdb.connect()
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://net/", "https://planet/x", "ftp://x.org/fr/1", "http://example.com/de/", "a://b://c/d", "http://hot-casino.biz/xxx/free", "http://\u00e9t\u00e9.fr/\u00e9?q", "http://x.net:80/", "://net#"]
    spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, rule string").createOrReplaceTempView("pages_test")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.table("pages_test")).collect()}
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(i, u) for i, u in enumerate([*urls, urls[4]])])
    assert got == {tuple(r) for r in con.execute(url_filter.oracle()).fetchall()}
    by = {p: r for p, *r in got}
    assert by[4] == ["a.example.net", "/en/x", "example.net/en/", "allow"] and by[5][2] == "net/" and by[6][2] is None and by[0][:2] == ["", ""]
    assert by[9][:2] == ["b:", "//c/d"] and by[10][3] == "block" and by[13][:2] == ["net", ""] and by[13][2] is None
    model = [(url_filter._split(u), y) for u, y in url_filter.labelled_urls()]
    df = spark.createDataFrame([(i, f"http://{h}{p}", y) for i, ((h, p), y) in enumerate(model)], "page_id long, url string, y int")
    judged = {r.page_id: r.verdict for r in url_filter.filter_urls(df, rules=()).collect()}
    assert sum((judged[i] == "block") == bool(y) for i, (_, y) in enumerate(model)) / len(model) > 0.97
