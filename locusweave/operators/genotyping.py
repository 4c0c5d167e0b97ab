"""Medians of PL per segment and merged genotype, of batches of tiles.

Tiles come from intervals.tiles(). Within a task their segments, merged alleles and re-indexed PLs are flat arrays over (segment,
call) and (segment, call, genotype), as column functions would look every value up by itself. The rules are those of
merge.merge_alleles() and merge.remap_calls(); a test holds both against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from locusweave.functions.alleles import NON_REF, SPANNING

#: Calls worked on at once (a single tile may have more).
CALLS = 20_000


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For so many elements of each owner: the owner of every element, and its place among the owner's."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where every list begins among all values, its length (0 for null), and all values."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(counts) - counts, counts, column.flatten()


def _numbers(column: pa.Array, null: int = 0) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def _codes(column: pa.Array, code: dict[str, int]) -> np.ndarray:
    """A number for each text, by a dictionary that takes in what it hasn't yet."""
    have = column.dictionary_encode()
    known = np.array([code.setdefault(x, len(code)) for x in have.dictionary.to_pylist()], dtype=np.int64)
    return known[_numbers(have.indices)] if len(known) else np.zeros(0, dtype=np.int64)


def _symbolic(allele: str) -> bool:
    return allele == SPANNING or allele.startswith("<") or "[" in allele or "]" in allele


def _active(tile: np.ndarray, low: np.ndarray, after: np.ndarray, c: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, ...]:
    """Segments with calls: tile, s, t; and pairs of segment and call, in the order of segments, then calls."""
    b, e, at = c["_b"] - low[tile], c["_e"] - low[tile], tile * width
    edge = np.zeros(len(low) * width, dtype=bool)
    for x in (b, e + 1):
        inside = (x >= 0) & (x < width)
        edge[(at + x)[inside]] = True
    first, last = np.maximum(b, 0), np.minimum(e, width - 1)
    here = np.maximum(last - first + 1, 0)
    own, i = _spread(np.where(c["_dense"] > 0, here, 0))
    edge[(at + first)[own] + i] = True  # a deletion's every position
    places = np.flatnonzero(edge)
    until = np.concatenate([[0], np.cumsum(edge)])
    begin = until[np.where(here > 0, at + first, 0)]
    call, i = _spread(np.where(here > 0, until[np.where(here > 0, at + last + 1, 0)] - begin, 0))
    pair = np.sort((begin[call] + i) * len(tile) + call)
    seg, call = np.divmod(pair, max(len(tile), 1))
    s = places % width + low[places // width]
    used, seg = np.unique(seg, return_inverse=True)
    if not len(used):
        return used, used, used, seg, call
    # up to the tile's next edge; beyond its last one, to where an active call ends or another begins, whichever is first
    following = np.append(places[1:] // width == places[:-1] // width, False)[used]
    ends = np.minimum.reduceat(np.where(c["_dense"][call] > 0, s[used][seg], c["_e"][call]), np.flatnonzero(np.diff(seg, prepend=-1)))
    t = np.where(following, np.append(s[1:], 0)[used] - 1, np.minimum(ends, after[places[used] // width] - 1))
    return places[used] // width, s[used], t, seg, call


def _merged(s: np.ndarray, seg: np.ndarray, call: np.ndarray, c: dict[str, np.ndarray], refs: list[str], alleles: tuple[np.ndarray, ...], code: dict[str, int]) -> tuple[np.ndarray, ...]:
    """Of every segment the number of merged ALT alleles; of every pair where its sources begin; all sources: a merged
    allele's place (REF first) among the call's own, NON_REF's where it isn't there, -1 without."""
    length = np.array([len(r) for r in refs], dtype=np.int64)[c["ref"]]
    own = np.where(c["col_begin"][call] < s[seg], 1, length[call])  # `N` after the begin
    starts = np.flatnonzero(np.diff(seg, prepend=-1))
    here = np.where(c["col_begin"][call] == s[seg], length[call], 0)
    longest = np.maximum.reduceat(here, starts)
    ref = np.zeros(len(starts), dtype=np.int64)
    found = np.flatnonzero((here == longest[seg]) & (here > 0))[::-1]
    ref[seg[found]] = c["ref"][call[found]]  # the first of the longest: written last
    # ALT in terms of the merged REF: lengthened by the rest of it, unless symbolic
    offset, count, ids = alleles
    pair, place = _spread(count[call])
    allele = ids[offset[call[pair]] + place]
    names = list(code)
    plain = np.array([not _symbolic(a) for a in names], dtype=bool)
    longer = np.flatnonzero((own < longest[seg])[pair])
    longer = longer[plain[allele[longer]]]
    if len(longer):
        kinds, kind = np.unique(np.stack([allele[longer], ref[seg[pair[longer]]], own[pair[longer]]]), axis=1, return_inverse=True)
        written = [code.setdefault(names[a] + refs[r][n:], len(code)) for a, r, n in kinds.T.tolist()]
        allele[longer] = np.array(written, dtype=np.int64)[kind.ravel()]
    # distinct, first seen first, NON_REF last
    key, first, which = np.unique(seg[pair] * len(code) + allele, return_index=True, return_inverse=True)
    of, allele_of = np.divmod(key, max(len(code), 1))
    non_ref = code.get(NON_REF, -1)
    order = np.lexsort((first, allele_of == non_ref, of))
    n_alt = np.bincount(of, minlength=len(starts))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = _spread(n_alt)[1]
    sizes = n_alt[seg] + 1
    begin = np.cumsum(sizes) - sizes
    other = np.full(len(seg), -1)
    of_non_ref = np.flatnonzero(allele == non_ref)[::-1]
    other[pair[of_non_ref]] = place[of_non_ref] + 1
    source = np.repeat(other, sizes)
    source[begin] = 0
    source[(begin[pair] + rank[which] + 1)[::-1]] = (place + 1)[::-1]  # of equal alleles the first
    return n_alt, begin, source


def _values(seg: np.ndarray, call: np.ndarray, n_alt: np.ndarray, begin: np.ndarray, source: np.ndarray, c: dict[str, np.ndarray], pl: tuple[np.ndarray, ...], max_alt: int) -> tuple[np.ndarray, ...]:
    """Every PL in terms of the merged genotypes: segment, genotype, value; without nulls. Of ploidy one and two."""
    groups, genotypes, found = [], [], []
    offset, count, values, known = pl
    tops = np.repeat(np.arange(max_alt + 1), np.arange(1, max_alt + 2))  # the higher allele of every diploid genotype
    for ploidy in (1, 2):
        pairs = np.flatnonzero((c["_ploidy"][call] == ploidy) & (n_alt[seg] <= max_alt) & (count[call] > 0))
        n = n_alt[seg[pairs]] + 1
        own, g = _spread(n * (n + 1) // 2 if ploidy == 2 else n)
        at = pairs[own]
        if ploidy == 2:
            high = tops[g]
            j, k = source[begin[at] + g - high * (high + 1) // 2], source[begin[at] + high]
            top = np.maximum(j, k)
            index = np.where((j >= 0) & (k >= 0), top * (top + 1) // 2 + np.minimum(j, k), -1)
        else:
            index = source[begin[at] + g]
        have = np.flatnonzero((index >= 0) & (index < count[call[at]]))
        index, at = (index + offset[call[at]])[have], at[have]
        valid = known[index]
        groups.append(seg[at][valid])
        genotypes.append(g[have][valid])
        found.append(values[index[valid]])
    return np.concatenate(groups), np.concatenate(genotypes), np.concatenate(found)


def _medians(batch: pa.RecordBatch, width: int, max_alt: int) -> pa.RecordBatch:
    _, count, calls = _lists(batch["_calls"])
    c = {n: _numbers(calls.field(n)) for n in ("col_begin", "_b", "_e", "_ploidy")} | {"_dense": _numbers(calls.field("_dense").cast(pa.int8()))}
    tile = np.repeat(np.arange(len(count)), count)
    found, s, t, seg, call = _active(tile, _numbers(batch["_tile"]) * width, _numbers(batch["_next"], np.iinfo(np.int64).max), c, width)
    if not len(seg):
        return pa.RecordBatch.from_arrays([batch["contig"].slice(0, 0), *[pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]], names=["contig", "s", "t", "genotype", "median_pl"])
    code: dict[str, int] = {}
    refs: dict[str, int] = {}
    c["ref"] = _codes(calls.field("ref"), refs)
    offset, n, alt = _lists(calls.field("alt"))
    n_alt, begin, source = _merged(s, seg, call, c, list(refs), (offset, n, _codes(alt, code)), code)
    offset, n, pl = _lists(calls.field("pl"))
    values = (offset, n, _numbers(pl), pl.is_valid().to_numpy(zero_copy_only=False))
    of, genotype, value = _values(seg, call, n_alt, begin, source, c, values, max_alt)
    # one sort of (segment, genotype, value from the largest) as whole numbers
    few = np.minimum(n_alt, max_alt) + 1
    many = few * (few + 1) // 2
    base = np.cumsum(many) - many
    group = base[of] + genotype
    ordered = np.sort(group << 32 | (2**31 - 1 - value))
    size = np.bincount(group, minlength=int(many.sum()))
    have = np.flatnonzero(size)
    median = 2**31 - 1 - (ordered[(np.cumsum(size) - size + size // 2)[have]] & (2**32 - 1))
    of = np.repeat(np.arange(len(s)), many)[have]
    columns = [batch["contig"].take(pa.array(found[of])), pa.array(s[of]), pa.array(t[of]), pa.array((have - base[of]).astype(np.int32)), pa.array(median.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["contig", "s", "t", "genotype", "median_pl"])


def medians(batches: Iterator[pa.RecordBatch], width: int, max_alt: int) -> Iterator[pa.RecordBatch]:
    """contig, s, t, genotype, median_pl of batches of tiles (contig, _tile, _next, _calls)."""
    for batch in batches:
        done, upto = 0, np.cumsum(_lists(batch["_calls"])[1])
        while done < batch.num_rows:
            before = upto[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(upto, before + CALLS, "right")))
            yield _medians(batch.slice(done, stop - done), width, max_alt)
            done = stop
