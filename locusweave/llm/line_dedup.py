"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines (trimmed, lower-cased, not empty) are grouped by their text; unlike lines are linked if few edits apart, by the
number of units of the shorter one (THRESHOLDS): units are words from MANY_WORDS words on, and characters below. A
line of n units at which t edits are allowed is cut into t + 1 even segments, of which a line within t edits must hold
one unchanged. Its segments are indexed by n, by their number and by their text; every line probes the segments of lines as long
as itself and up to t units shorter, at the starts where an alignment of that many edits can put them (the
multi-match-aware windows). What meets is verified by Hyyro's banded bit-parallel edit distance over the units themselves.
Of each class of linked lines the first occurrence (least doc_id, null last, then position) stays.

A key of more than HOT lines would make all pairs of its group. There every line is held against the commonest line
only, and lines that are linked with it are of one class whatever other links they have; a line that is not is held
against all lines of the key. The classes are those of all links.

Lines that share a segment and nothing else never become a pair: every key carries, as bits, which units its line has an
odd number of times (odd_units), and an edit changes two bits at most.

Four edits are the most, however long the line, as the substrings to probe grow with the cube of the threshold.

Defined results: null and empty texts have no lines; blank lines are always kept; rows with the same doc_id and text
are one document, rows that repeat a doc_id with other texts are not; texts of one very long line are lines like any
other; of equal lines in one document the first stays; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, pairwise, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import fresh, materialize, spread_join
from locusweave.llm.graph import components

#: Words from which a line's units are words.
MANY_WORDS = 10
#: Edits allowed from so many units of the shorter line on: of words, of characters. Of n words k may be replaced before
#: two lines share less than 0.8 of their runs of five if n >= 45 k + 4; shorter lines may differ by more than that.
THRESHOLDS = {"word": ((10, 2), (30, 3), (184, 4)), "char": ((20, 1), (40, 2))}
MOST = 4
#: Lines of a key that are held against each other; one line in so many is looked at for keys over that; blocks in
#: which a key's lines are held against those that are left over.
HOT, SAMPLED, BLOCKS = 64, 8, 16


def document() -> Column:
    """What names a row's document, in the order in which documents keep their lines: by doc_id, those without one last,
    and by a number of the text where a doc_id repeats."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("text_id"))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc, pos, norm: every line that is not blank; doc as document() has it."""
    lines = docs.select(document().alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc", "pos", F.lower(F.trim("line")).alias("norm")).where("norm <> ''")


def allowed(kind: Column, n: Column) -> Column:
    """Edits at which a line of n units, as the shorter one, is still linked (0: none)."""
    each = {k: sum(((n >= start).cast("int") * (t - before) for (_, before), (start, t) in pairwise(((0, 0), *steps))), F.lit(0)) for k, steps in THRESHOLDS.items()}
    return F.when(kind == "word", each["word"]).otherwise(each["char"])


def _spaced(norm: Column) -> Column:
    """With single blanks between words."""
    other = reduce(lambda x, c: x | F.contains(norm, F.lit(c)), "\r\f\v", F.contains(norm, F.lit("\t")))
    return F.when(other, F.translate(norm, "\t\r\f\v", "    ")).otherwise(norm)


def _n_words(norm: Column) -> Column:
    """What stands between blanks and tabs (an empty word between two of them)."""
    return F.octet_length(norm) - F.octet_length(F.replace(_spaced(norm), F.lit(" "), F.lit(""))) + 1


def _units(kind: Column, norm: Column) -> Column:
    return F.when(kind == "word", F.split(_spaced(norm), " ")).otherwise(F.split(norm, ""))


def measured(lines: DataFrame) -> DataFrame:
    """lines (id, norm, words) as id, norm, kind, n, once for each kind of units by which the line may be linked: lines of
    a few words more than those that are linked by characters may be linked with these."""
    reach = max(t for _, t in THRESHOLDS["char"])
    by_words = lines.where(F.col("words") >= MANY_WORDS).select("id", "norm", F.lit("word").alias("kind"), F.col("words").alias("n"))
    by_chars = lines.where(F.col("words") < MANY_WORDS + reach).select("id", "norm", F.lit("char").alias("kind"), F.char_length("norm").alias("n"))
    return by_words.unionByName(by_chars.where(F.col("n") >= THRESHOLDS["char"][0][0]))


def _ways(threshold: int) -> list[tuple[int, int, int, int]]:
    """Threshold, how much shorter the indexed line is, which of its segments, how far it is shifted in the probing line:
    so far that the edits before and after it still number at most the threshold."""
    ways = []
    for gap, segment, shift in product(range(threshold + 1), range(1, threshold + 2), range(-threshold, threshold + 1)):
        if abs(shift) + abs(gap - shift) <= threshold and abs(shift) <= segment - 1 and abs(gap - shift) <= threshold + 1 - segment:
            ways.append((threshold, gap, segment, shift))
    return ways


def _keys(lines: DataFrame, probing: bool, wide: bool) -> DataFrame:
    """id, key, odd (see odd_units()) and, of index keys, most: how many bits of it the edits allowed can change. lines: those
    of measured(). The ways are rows first, so that the hashing is one short expression; each step
    is short enough to be compiled."""

    def rows(*thresholds: int) -> str:
        ways = [w for t in thresholds for w in (_ways(t) if probing else [(t, 0, i, 0) for i in range(1, t + 2)])]
        return f"array({', '.join('named_struct(' + ', '.join(f'{chr(39)}{n}{chr(39)}, {x}' for n, x in zip(('t', 'gap', 'i', 'shift'), w, strict=True)) + ')' for w in ways)})"

    kind, n, t = F.col("kind"), F.col("n"), F.col("t")
    start_of = {k: reduce(lambda x, step: F.when(t == step[1], step[0]).otherwise(x), steps, F.lit(0)) for k, steps in THRESHOLDS.items()}
    classed = lines.select("id", "norm", "kind", "n", allowed(kind, n).alias("t"))
    # lines shorter by up to `near` units have this line's threshold; those below may have the next lower one
    classed = classed.withColumn("near", n - F.when(kind == "word", start_of["word"]).otherwise(start_of["char"]))
    classed = classed.withColumn("mixed", (F.col("near") < t) & (t > 1) & F.lit(probing))
    ways = F.expr(f"array({', '.join([*(rows(k) for k in range(1, MOST + 1)), *(rows(k, k - 1) for k in range(2, MOST + 1))])})")
    which = F.get(ways, F.when(F.col("mixed"), t + (MOST - 2)).otherwise(t - 1))
    numbered = classed.select("id", "kind", "n", "t", "near", F.transform(_units(kind, F.col("norm")), lambda u: F.xxhash64(u)).alias("units"), which.alias("ways"))
    numbered = numbered.withColumn("odd", odd_units(F.col("units"), wide))
    each = numbered.select("id", "kind", "n", "t", "near", "units", "odd", F.explode("ways").alias("w"))
    each = each.where((F.col("w.t") == t) == (F.col("w.gap") <= F.col("near")))
    parts, rest, i = F.col("w.t") + 1, F.col("rest"), F.col("w.i")
    each = each.withColumn("other", n - F.col("w.gap")).withColumn("rest", F.col("other") % parts)
    each = each.withColumn("base", F.call_function("div", F.col("other") - rest, parts).cast("int"))
    # even segments, the last ones longer by one
    each = each.withColumn("start", (i - 1) * F.col("base") + F.greatest(F.lit(0), i - 1 - (parts - rest)) + F.col("w.shift"))
    each = each.withColumn("size", F.col("base") + (i > parts - rest).cast("int"))
    each = each.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= n))
    most = () if probing else ((2 * t).alias("most"),)
    return each.select("id", F.xxhash64("kind", "other", i, F.slice("units", F.col("start") + 1, F.col("size"))).alias("key"), "odd", *most)


def index_keys(lines: DataFrame, wide: bool = False) -> DataFrame:
    """id, key, odd, most: the segments of each line."""
    return _keys(lines, False, wide)


def probe_keys(lines: DataFrame, wide: bool = False) -> DataFrame:
    """id, key, odd: the substrings that may be segments of a line as long or shorter."""
    return _keys(lines, True, wide)


def edit_distance(a: Column, b: Column, most: int = MOST) -> Column:
    """Edit distance of two arrays of at least `most` elements whose lengths differ by at most `most`; some larger
    number if it is over `most`. A column of the distance matrix is kept as bits (where it rises and where it falls)
    over the 2 * most + 1 rows around the diagonal."""
    full = (1 << (2 * most + 1)) - 1
    no = lambda c: c.bitwiseXOR(F.lit(full))

    def step(state: Column, late: Column, equal: Column) -> Column:
        up, down = state["up"], state["down"]
        d0 = (equal.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(equal).bitwiseOR(down).bitwiseAND(F.lit(full))

        def after(_: Column, d: Column) -> Column:
            rise, fall = down.bitwiseOR(no(d.bitwiseOR(up))), d.bitwiseAND(up)
            moved = F.shiftright(d, 1)
            bit = F.greatest(F.lit(2 * most - 1) - late, F.lit(0))
            change = F.when(late < 0, F.when(d < (1 << (2 * most)), 1).otherwise(0)).otherwise(_bit(rise, bit) - _bit(fall, bit))
            return F.struct(
                fall.bitwiseOR(no(moved.bitwiseOR(rise))).alias("up"), moved.bitwiseAND(rise).alias("down"), (state["cost"] + change).alias("cost")
            )

        return F.aggregate(F.array(d0), state, after)

    def columns(both: Column) -> Column:
        x, y = both["x"], both["y"]  # within a lambda the lines are cut once, not for every position
        late = lambda i: i - (F.size(x) - most)  # from 0 on the last row lies inside the band, ever lower in it
        equal = lambda i: sum((F.when(F.get(x, i + (j - most)) == F.get(y, i), 1 << j).otherwise(0) for j in range(2 * most + 1)), F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.size(y) - 1), lambda i: F.struct(late(i).alias("late"), equal(i).alias("e")))

    matches = F.flatten(F.transform(F.array(F.struct(a.alias("x"), b.alias("y"))), columns))
    first = F.struct(F.lit(full & (full << most)).alias("up"), F.lit(0).alias("down"), F.lit(most).alias("cost"))
    return F.aggregate(matches, first, lambda s, c: step(s, c["late"], c["e"]), lambda s: s["cost"])


def _bit(value: Column, place: Column) -> Column:
    return F.call_function("getbit", value, place).cast("int")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def odd_units(units: Column, wide: bool) -> Column:
    """For 31 classes of units (hashes), 64 if wide, as bits, whether the line has an odd number of them: one edit changes two
    at most."""
    zero, one = (F.lit(x).cast("long" if wide else "int") for x in (0, 1))
    bit = lambda u: F.call_function("shiftleft", one, F.pmod(u, F.lit(64 if wide else 31)).cast("int"))
    return F.aggregate(units, zero, lambda x, u: x.bitwiseXOR(bit(u)))


def apart(a: Column, b: Column, most: Column) -> Column:
    """Whether two lines' odd_units() tell that they are more edits apart than change so many bits."""
    return F.bit_count(a.bitwiseXOR(b)) > most


def verify(met: DataFrame, lines: DataFrame) -> DataFrame:
    """The candidates (a, b), a written table, that are linked. lines: id, norm, words, one row per id. Most that are
    have as many units, few of them unlike: only what this doesn't decide is left to the edit distance."""
    few = lines.select("id", "norm", "words").join(met.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    few = materialize(few, "few")
    # pairs cost much time for their few bytes: not to be put together into few tasks
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = materialize(spread_join(met, few.toDF("a", "x", "m"), "a", met).repartition(tasks, "a", "b"), "one")
    pairs = spread_join(one, few.toDF("b", "y", "n"), "b", one)
    by_words, kind = F.least("m", "n") >= MANY_WORDS, F.col("kind")
    pairs = pairs.select("a", "b", "x", "y", F.when(by_words, "word").otherwise("char").alias("kind"), *(F.when(by_words, F.col(w)).otherwise(F.char_length(v)).alias(w) for w, v in (("m", "x"), ("n", "y"))))
    pairs = pairs.withColumn("most", allowed(kind, F.least("m", "n"))).where(F.abs(F.col("m") - F.col("n")) <= F.col("most"))
    x, y = _units(kind, F.col("x")), _units(kind, F.col("y"))
    unlike = F.aggregate(F.zip_with(x, y, lambda v, w: (v != w).cast("int")), F.lit(0), lambda k, v: k + v)
    return pairs.where(F.when((F.col("m") == F.col("n")) & (unlike <= F.col("most")), F.lit(True)).otherwise(edit_distance(x, y) <= F.col("most"))).select("a", "b")


def links(lines: DataFrame) -> DataFrame:
    """lines: id, norm, words (their number), weight (how often it occurs), one row per id. Returns a, b: the links of unlike lines, all but
    those between two lines that are linked with the commonest line of a key of over HOT lines."""
    each = measured(lines)
    index, probe = index_keys(each), probe_keys(each)
    # keys of very many lines show in a sample; what it misses is joined like the rest
    some = index_keys(measured(lines.where(F.pmod("id", F.lit(SAMPLED)) == 0)))
    hot = materialize(some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLED > HOT).select("key"), "hot")
    none = hot.isEmpty()
    cool = (index, probe) if none else (index.join(hot, "key", "left_anti"), probe.join(hot, "key", "left_anti"))
    met = cool[1].withColumnsRenamed({"id": "b", "odd": "odd_b"}).join(cool[0].withColumnsRenamed({"id": "a", "odd": "odd_a"}).hint("shuffle_hash"), "key")
    met = met.where((F.col("a") != F.col("b")) & ~apart(F.col("odd_a"), F.col("odd_b"), F.col("most")))
    met = materialize(met.select(*_ordered(F.col("a"), F.col("b"))).distinct(), "met")
    if none:
        return verify(met, lines)
    busy = index_keys(each, wide=True).join(hot, "key", "left_semi").withColumn("indexed", F.lit(True))
    busy = busy.unionByName(probe_keys(each, wide=True).join(hot, "key", "left_semi").withColumn("indexed", F.lit(False)), allowMissingColumns=True)
    busy = busy.groupBy("key", "id").agg(F.first("odd").alias("odd"), F.max("most").alias("most"), F.max("indexed").alias("indexed"))
    busy = materialize(busy.join(lines.select("id", "weight"), "id"), "busy")
    # a key's indexed lines are as long as each other, and no line of it is shorter: all of its pairs have their threshold
    centre = busy.where("indexed").groupBy("key").agg(F.max(F.struct("weight", "id", "odd")).alias("c"), F.max("most").alias("most"))
    centre = materialize(centre.select("key", F.col("c.id").alias("centre"), F.col("c.odd").alias("odd_centre"), "most"), "centre")
    rays = spread_join(busy.drop("most"), centre, "key", busy).where("id <> centre")
    rays = materialize(rays.select("key", "id", "odd", "most", "indexed", (~apart(F.col("odd"), F.col("odd_centre"), F.col("most"))).alias("near"), *_ordered(F.col("id"), F.col("centre"))), "rays")
    found = materialize(verify(materialize(met.unionByName(rays.where("near").select("a", "b")).distinct(), "star"), lines), "linked")
    left = rays.join(found, ["a", "b"], "left_anti").select("key", "id", "odd", "most", "indexed")
    left = materialize(left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))), "left")
    rest = left.alias("l").join(busy.drop("most").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int")).alias("r"), ["key", "block"])
    rest = rest.where("l.id <> r.id AND (l.indexed OR r.indexed)").where(~apart(F.col("l.odd"), F.col("r.odd"), F.col("l.most")))
    rest = rest.select(*_ordered(F.col("l.id"), F.col("r.id"))).distinct().join(found, ["a", "b"], "left_anti")
    return found.unionByName(verify(materialize(rest, "rest"), lines))


def classified(docs: DataFrame) -> DataFrame:
    """doc, pos, line_id, class_id, n_texts: for every line that is not blank the number of its text, the least such
    number of its class, and how many different texts the class has. A written table."""
    every = occurrences(docs)
    texts = every.groupBy("norm").agg(F.count("*").alias("weight")).select(F.xxhash64("norm").alias("id"), "norm", _n_words(F.col("norm")).alias("words"), "weight")
    near = links(materialize(texts, "texts"))
    linked = materialize(components(near).toDF("line_id", "class_id"), "linked")
    linked = materialize(spread_join(linked, linked.groupBy("class_id").agg(F.count("*").alias("n_texts")), "class_id", linked), "sized")
    named = materialize(every.select("doc", "pos", F.xxhash64("norm").alias("line_id")), "every")
    found = spread_join(named, linked, "line_id", named, "left")
    return materialize(found.select("doc", "pos", "line_id", F.coalesce("class_id", "line_id").alias("class_id"), F.coalesce("n_texts", F.lit(1).cast("long")).alias("n_texts")), "lines")


def _removed(lines: DataFrame) -> DataFrame:
    """lines: those of classified(). doc, removed (positions of the lines that go, sorted): the documents that lose any."""
    first = lines.groupBy("class_id").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("class_id", "first")
    gone = spread_join(lines, first, "class_id", lines).where(F.struct("doc", "pos") != F.col("first"))
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc (see document()), removed (positions of the lines that go, sorted): the documents that lose any."""
    return _removed(classified(docs))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (positions, comma-joined), lines (pos, line_id, class_id, n_texts of every
    line that is not blank, by position; see classified()): one row per row of docs."""
    counted = docs.select(document().alias("doc"), "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    named = classified(docs)
    lines = named.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("pos", "line_id", "class_id", "n_texts"))).alias("lines"))
    found = counted.join(_removed(named), "doc", "left").join(lines, "doc", "left")
    return found.select(
        "doc_id", "n_lines", F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"),
        F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the repeated lines; documents that lose all their lines go. n_chars, if there, follows the text."""
    gone, new, doc = fresh(docs, "_removed", "_text", "_doc")
    found = docs.withColumn(doc, document()).join(removed_lines(docs).withColumnsRenamed({"removed": gone, "doc": doc}), doc, "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    out = found.withColumn(new, F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    out = out.where(F.col(gone).isNull() | (F.trim(new) != ""))
    changed = {"text": F.col(new)} | ({"n_chars": F.char_length(new).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.withColumns(changed).select(docs.columns)
