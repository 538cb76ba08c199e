"""Substring dedup: near-duplicate passages by compact windows over min-hashes of word n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

NO_ID = -(2**63)
SIDE_SEED = np.uint64(0x9FB21C651E98DF25)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each width values in a row, the first of equals, by prefix and suffix minima of blocks.

    Places are carried in the low bits of the values, which so count by their high bits alone.
    """
    n = len(values)
    bits = np.uint64(max(1, int(n).bit_length()))
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = ((values >> bits) << bits) | np.arange(n, dtype=np.uint64)
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(after[: n - width + 1], before[width - 1 : n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def contexts(words: np.ndarray, edges: np.ndarray, n: int, least: int, owner: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that sequences of least n-grams hold which hold the one at a place and its whole side before it, or after it."""
    grams = C.shingles(words, n)
    up, down = C._table(len(grams) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(C.mixed(grams) * up[: len(grams)], dtype=np.uint64)])
    place, ends = edges[owner] + at, edges[owner + 1] - n + 1
    out = []
    for before in reaches(least):
        low, high = place - before, place - before + wide(least)
        lo, hi = np.maximum(low, edges[owner]), np.minimum(high, ends)
        out.append(C.mixed((sums[hi] - sums[lo]) * down[lo] + C.mixed(((lo - low) << 32 | (high - hi)).astype(np.uint64))))
    return out


def reaches(least: int) -> tuple[int, int]:
    """How far contexts of the side before and of the side after begin before their n-gram."""
    return least - 1, least - 1 - (least - 1) // 2


def wide(least: int) -> int:
    """N-grams of a context: those of all sequences that hold one side whole."""
    return 2 * least - 1 - (least - 1) // 2


def compact_windows(words: np.ndarray, edges: np.ndarray, n: int, least: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owners, keys, places, before, after) of the compact windows of many texts laid end to end, whose words begin at edges.

    Under each hash, all sequences of least n-grams whose least n-gram stands at a place form one window, a node of the
    Cartesian tree of the hashes that is wide enough; it is given once, by the n-gram's hash and place in its text. before and after
    are hashes of the least of the least // 2 - 1 n-grams on either side of the place; 0 where the text ends sooner. A passage of
    least n-grams or more holds, for each place in it, all of one side. Texts of fewer n-grams have no window.
    """
    sizes = np.diff(edges)
    starts = np.maximum(sizes - (least + n - 2), 0)  # of sequences, in each text
    owner = np.repeat(np.arange(len(sizes)), starts)
    if not len(owner):
        none = np.zeros(0, dtype=np.uint64)
        return owner, none, owner, none, none
    grams = C.shingles(words, n)
    first = edges[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    reach = (least - 1) // 2
    h = C.mixed(grams ^ SIDE_SEED)
    beside = h[sliding_least(h, reach)]
    owners, keys, places, befores, afters = [], [], [], [], []
    for k, seed in enumerate(seeds):
        h = C.mixed(grams ^ seed)
        at = sliding_least(h, least)[first]
        fresh = np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))
        at, own = at[fresh], owner[fresh]
        before, after = np.zeros((2, len(at)), dtype=np.uint64)
        inner = at - reach >= edges[own]
        before[inner] = beside[at[inner] - reach]
        inner = at + reach + n <= edges[own + 1]
        after[inner] = beside[at[inner] + 1]
        for all_, some in zip((owners, keys, places, befores, afters), (own, h[at] + np.uint64(k), at - edges[own], before, after), strict=True):
            all_.append(some)
    return tuple(np.concatenate(x) for x in (owners, keys, places, befores, afters))


def _numbered(rows: np.ndarray, width: int) -> np.ndarray:
    """Each row of small numbers sorted, with how often the number stands before it in the row, so that none repeats."""
    rows = np.sort(rows, axis=1)
    at = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
    fresh = np.ones(rows.shape, dtype=bool)
    fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
    return rows * width + at - np.maximum.accumulate(np.where(fresh, at, 0), axis=1)


def _hits(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, width: int, threshold: float) -> np.ndarray:
    """Where in a windows begin that have, with the window of b at the same place, a Jaccard similarity of threshold or more.

    a and b hold the n-grams of many stretches of so many sizes end to end; windows lie within one stretch. N-grams count as often
    as they stand in both windows. Those that agree at the same place are counted first; only windows that they leave open,
    and that hold enough n-grams of b at all, are counted in full.
    """
    total = len(a)
    if total < width:
        return np.zeros(0, dtype=np.int64)
    common = np.arange(width + 1)
    enough = common >= threshold * (2 * width - common) - 1e-9
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = (place <= np.repeat(sizes - width, sizes))[: total - width + 1]

    def counted(x):
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[width:] - sums[:-width]

    out = inside & enough[counted(a == b)]
    left = inside & ~out
    if left.any():
        of = np.repeat(np.arange(len(sizes)), sizes)
        asked = np.zeros(len(sizes), dtype=bool)
        asked[of[: len(left)][left]] = True
        some = asked[of]
        x, y = ((of[some].astype(np.uint64) << np.uint64(32)) | z[some] for z in (a, b))
        held = np.zeros(total, dtype=bool)
        held[some] = np.isin(x, y)
        left = np.flatnonzero(left & enough[counted(held)])
        if len(left):
            ids = np.zeros((2, total), dtype=np.int64)
            ids[:, some] = np.unique(np.concatenate([x, y]), return_inverse=True)[1].reshape(2, -1)
            windows = np.lib.stride_tricks.sliding_window_view
            one, two = windows(ids[0], width), windows(ids[1], width)
            for few in np.array_split(left, -(-len(left) // 2000)):
                both = np.sort(np.concatenate([_numbered(one[few], width), _numbered(two[few], width)], axis=1), axis=1)
                out[few] = enough[(both[:, 1:] == both[:, :-1]).sum(axis=1)]
    return np.flatnonzero(out)


def _places(sizes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, so many as sizes say, for each stretch."""
    return np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)


def _partners(batches):
    """Rows (key, same, at, doc, ...) in that order whose key stands in different texts, once for each text and place.

    The first key of a range and its last are kept, as they may go on beyond it. What is held back at a time are the
    places of one key in one text.
    """
    held, known, last = None, None, None
    for pdf in batches:
        if not len(pdf):
            continue
        if known is None:
            known = int(pdf["key"].iat[0])
        if held is not None:
            pdf, held = pd.concat([held, pdf], ignore_index=True), None
        key, same, at = (pdf[c].to_numpy() for c in ("key", "same", "at"))
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (same[1:] != same[:-1]) | (at[1:] != at[:-1])
        fresh[0] = last != (key[0], same[0], at[0])
        last = (key[-1], same[-1], at[-1])
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        end = np.append(begin[1:], len(key))
        met = (same[begin] != same[end - 1]) | (key[begin] == known)
        if met[-1]:
            known = int(key[-1])
        else:
            held, last = pdf.iloc[begin[-1] :][fresh[begin[-1] :]], None
        yield pdf[fresh & np.repeat(met, end - begin)]
    if held is not None:
        yield held


def _paired(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row a row of the least document of its group: the one of the same rank there, counted round.

    A text that says one thing many times so meets another that does on few diagonals.
    """
    order = np.lexsort((doc, group))
    g, d, at = group[order], doc[order], np.arange(len(doc))
    begins = np.append(True, g[1:] != g[:-1])
    starts = begins.copy()
    starts[1:] |= d[1:] != d[:-1]
    start, begin = (np.maximum.accumulate(np.where(x, at, 0)) for x in (starts, begins))
    size, own = np.zeros(len(doc), dtype=np.int64), np.flatnonzero(starts)
    size[own] = np.diff(np.append(own, len(doc)))
    out = np.empty(len(doc), dtype=np.int64)
    out[order] = order[begin + (at - start) % size[begin]]
    return out


def _gathered(batches, rows):
    """Batches joined to frames of rows() rows or more, but for the last."""
    some, held = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        some.append(pdf)
        held += len(pdf)
        if held >= rows():
            yield pd.concat(some, ignore_index=True)
            some, held = [], 0
    if some:
        yield pd.concat(some, ignore_index=True)


def _meet(batches):
    """Links of rows (key, doc, at, beside) in order of key, and at the ends of the range the leaders of its first and last key.

    A row is linked to the least document of its key in the range that has the same context beside its n-gram, and to the least of all its key
    if that is another one. The first row of each context in the range is given too, with mark 3,
    and one of another document where a document is the first of two contexts. All rows of these are carried on, 28 bytes each and no more than the range
    has; as many rows are gathered before they are held against them, so that the work stays in proportion.
    """
    from pyspark import TaskContext

    part, carried = TaskContext.get().partitionId(), None
    for pdf in _gathered(batches, lambda: 0 if carried is None else len(carried)):
        own = 0
        if carried is not None:
            own, pdf = len(carried), pd.concat([carried, pdf], ignore_index=True)
        key, doc, at, beside = (pdf[c].to_numpy() for c in ("key", "doc", "at", "beside"))
        run = np.cumsum(np.append(True, key[1:] != key[:-1]))
        order = np.lexsort((beside, run))
        fresh = np.append(True, (run[order][1:] != run[order][:-1]) | (beside[order][1:] != beside[order][:-1]))
        group = np.empty(len(key), dtype=np.int64)
        group[order] = np.cumsum(fresh) - 1
        lead, like = _paired(run, doc), _paired(group, doc)
        row = np.arange(own, len(key))
        other = row[doc[like[row]] != doc[lead[row]]]
        a, b = np.concatenate([row, other]), np.concatenate([like[row], lead[other]])
        a, b = a[doc[a] != doc[b]], b[doc[a] != doc[b]]
        if carried is None:
            yield pd.DataFrame({"key": key[:1], "a": doc[:1], "at_a": at[:1], "b": doc[:1], "at_b": at[:1], "mark": 1, "part": part})
        yield pd.DataFrame({"key": key[a], "a": doc[a], "at_a": at[a], "b": doc[b], "at_b": at[b], "mark": 0, "part": part})
        # a context's first row is the first of its group, as carried rows stand before the others
        first = order[fresh]
        _, held, times = np.unique(np.stack([run[first], doc[first]]), axis=1, return_inverse=True, return_counts=True)
        second = np.flatnonzero((times[held.reshape(-1)] > 1)[group] & (doc != doc[first[group]]))
        second = second[np.unique(group[second], return_index=True)[1]]
        first = np.concatenate([first, second])
        first = first[first >= own]
        yield pd.DataFrame({"key": key[first], "a": doc[first], "at_a": at[first], "b": doc[first], "at_b": at[first], "mark": 3, "part": part})
        last = run == run[-1]
        leads = np.flatnonzero(last & (doc[lead] == doc))
        likes = np.flatnonzero(last & (doc[like] == doc) & (doc[lead] != doc))
        carried = pdf.iloc[np.concatenate([leads, likes])]
    if carried is not None:
        first = carried.iloc[:1]
        yield pd.DataFrame({"key": first["key"], "a": first["doc"], "at_a": first["at"], "b": first["doc"], "at_b": first["at"], "mark": 2, "part": part})


#: Cells of the table by which common n-grams of contexts are found, and pairs of rows remembered as compared.
CELLS, TRIED = 8_000_000, 20_000_000


class _Shared:
    """How many n-grams windows at the same place of two contexts have in common, counted as often as they stand in both.

    ids are numbers of a row's n-grams, slots the slots of those that other rows of the key may have, and -1 else. Where a row repeats none, a
    match of two places counts for all windows that hold both; else numbers of each n-gram are kept for each window.
    """

    def __init__(self, ids: np.ndarray, slots: np.ndarray, width: int):
        (n, self.size), self.width, self.n = ids.shape, width, ids.shape[1] - width + 1
        self.raw, self.wide = ids, int(slots.max(initial=0)) + 1
        place = np.arange(self.size)
        offsets = np.arange(self.n)
        order = np.argsort(np.where(slots >= 0, slots, self.wide), axis=1, kind="stable")
        by, named = np.take_along_axis(slots, order, axis=1), np.take_along_axis(ids, order, axis=1)
        near = (by[:, 1:] == by[:, :-1]) & (by[:, 1:] >= 0)
        again = near & (named[:, 1:] == named[:, :-1])
        self.hard = (near & ~again).any(axis=1)  # two n-grams in one slot
        self.twice = again.any(axis=1) & ~self.hard
        self.ids, self.slots = ids.copy(), np.where(slots >= 0, slots, self.wide)
        # numbers of n-grams in windows: at the places of a row that repeats none, then of each n-gram of each other row
        numbers, self.base, at = [((place[:, None] >= offsets) & (place[:, None] < offsets + width)).astype(np.uint8)], np.zeros(n, dtype=np.int64), self.size
        odd = np.flatnonzero(self.twice)
        for some in np.split(odd, np.arange(1000, len(odd), 1000)):
            if not len(some):
                continue
            o, s, known = order[some], by[some], by[some] >= 0
            fresh = known.copy()
            fresh[:, 1:] &= ~again[some]
            which = np.cumsum(fresh, axis=1) - 1
            count = fresh.sum(axis=1)
            begin = np.cumsum(count) - count
            k, i = np.nonzero(known)
            cell = (begin[k] + which[k, i]) * (self.n + 1)
            low, high = np.maximum(o[k, i] - width + 1, 0), np.minimum(o[k, i], self.n - 1)
            total = int(count.sum()) * (self.n + 1)
            steps = (np.bincount(cell + low, minlength=total) - np.bincount(cell + high + 1, minlength=total)).astype(np.int16).reshape(-1, self.n + 1)
            numbers.append(np.cumsum(steps, axis=1, dtype=np.int16)[:, : self.n].astype(np.uint8 if width < 256 else np.int32))
            self.base[some] = at + begin
            at += int(count.sum())
            self.slots[some] = self.wide
            k, i = np.nonzero(fresh)
            self.slots[some[k], which[k, i]] = s[k, i]
            self.ids[some[k], which[k, i]] = named[some[k], i]
        self.numbers = np.concatenate(numbers)
        self.once = max(64, min(2048, CELLS // (self.wide + 1)))
        self.table = np.full((self.once, self.wide + 1), -1, dtype=np.int16)

    def counts(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.n), dtype=np.int32)
        hard, odd = self.hard[x] | self.hard[y], self.twice[x] | self.twice[y]
        for kind, once in ((~hard & ~odd, self.once), (~hard & odd, self.once), (hard, 200)):
            chosen = np.flatnonzero(kind)
            for some in np.split(chosen, np.arange(once, len(chosen), once)):
                if len(some):
                    out[some] = (self._counted if hard[some[0]] else self._summed if odd[some[0]] else self._placed)(x[some], y[some])
        return out

    def _matched(self, x, y):
        """Pairs, places in x and in y of their common n-grams."""
        own, at = np.unique(y, return_inverse=True)
        cells = (np.arange(len(own))[:, None], self.slots[own])
        self.table[cells] = np.arange(self.size, dtype=np.int16)
        self.table[: len(own), self.wide] = -1
        j = self.table[at[:, None], self.slots[x]]
        self.table[cells] = -1
        p, i = np.nonzero(j >= 0)
        j = j[p, i].astype(np.int64)
        same = self.ids[y[p], j] == self.ids[x[p], i]
        return p[same], i[same], j[same]

    def _placed(self, x, y):
        p, i, j = self._matched(x, y)
        low, high = np.maximum(np.maximum(i, j) - self.width + 1, 0), np.minimum(np.minimum(i, j), self.n - 1)
        near, wide = low <= high, self.n + 1
        p = p[near] * wide
        steps = np.bincount(p + low[near], minlength=len(x) * wide) - np.bincount(p + high[near] + 1, minlength=len(x) * wide)
        return np.cumsum(steps.reshape(len(x), wide), axis=1)[:, : self.n]

    def _summed(self, x, y):
        out = np.zeros((len(x), self.n), dtype=np.int32)
        p, i, j = self._matched(x, y)
        if len(p):
            both = np.minimum(self.numbers[self.base[x[p]] + i], self.numbers[self.base[y[p]] + j])
            begin = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            out[p[begin]] = np.add.reduceat(both, begin, axis=0, dtype=np.int32)
        return out

    def _counted(self, x, y):
        shown = np.lib.stride_tricks.sliding_window_view(self.raw, self.width, axis=1)
        one, two = (_numbered(shown[z].reshape(-1, self.width).astype(np.int64), self.width) for z in (x, y))
        both = np.sort(np.concatenate([one, two], axis=1), axis=1)
        return (both[:, 1:] == both[:, :-1]).sum(axis=1).reshape(len(x), self.n)


def _best(of: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """For each number of of, the place of its greatest gain above zero, the first of equals."""
    some = np.flatnonzero(gain)
    some = some[np.lexsort((-gain[some], of[some]))]
    return some[np.append(True, of[some][1:] != of[some][:-1])[: len(some)]]


def _others(key: np.ndarray, doc: np.ndarray, grams: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, threshold: float):
    """Pairs of rows of one key, in order of key and doc, that have similar windows at the same place of their contexts.

    grams holds a row's context, of which begin to end lie in its text. Exact, without meeting all pairs: two windows of width n-grams that
    may differ in so many share one of that many and one more that are the rarest of their key in either. Rows meet those with
    which a window shares such a one, least documents first, until each window is found in a lesser document or all were met. Of
    similar rows, those are given that most windows of a row are still to be found in.
    """
    common = np.arange(width + 1)
    least = int(common[common >= threshold * (2 * width - common) - 1e-9][0])
    differ, (n, size) = width - least, grams.shape
    offsets = np.arange(size - width + 1)
    inside = (np.arange(size) >= begin[:, None]) & (np.arange(size) < end[:, None])
    begins = np.append(True, key[1:] != key[:-1])
    run = np.cumsum(begins) - 1
    # n-grams of a key are numbered, and ranked by how often they stand in it
    codes = (run.astype(np.uint64)[:, None] << np.uint64(32) | grams)[inside]
    order = np.argsort(codes)
    fresh = codes[order]
    fresh = np.append(True, fresh[1:] != fresh[:-1])[: len(codes)]
    heads = np.flatnonzero(fresh)
    times, owner = np.diff(np.append(heads, len(codes))), (codes[order[heads]] >> np.uint64(32)).astype(np.int64)
    ids = np.full(grams.shape, len(times), dtype=np.int32)
    flat = np.empty(len(codes), dtype=np.int32)
    flat[order] = np.cumsum(fresh) - 1
    ids[inside] = flat
    by = np.full(len(times) + 1, len(times), dtype=np.int64)
    by[np.argsort(times, kind="stable")] = np.arange(len(times))
    lone = int((times == 1).sum())  # ranks below it stand once in their key
    rank = by[ids]
    sums = np.concatenate([np.zeros((n, 1), dtype=np.int64), np.cumsum(rank < lone, axis=1)], axis=1)
    open_ = (begin[:, None] <= offsets) & (offsets + width <= end[:, None]) & (sums[:, width:] - sums[:, : len(offsets)] <= differ)
    valid, found = open_.copy(), np.zeros_like(open_)
    # posts: a row's n-grams that are of the rarest in some of its windows, with these windows
    rows_, whats, shows = [], [], []
    for some in np.split(np.arange(n), np.arange(1000, n, 1000)):
        cells = np.sort(rank[some] * size + np.arange(size), axis=1)
        # equal n-grams of a window count as often as they stand in it
        cells = cells[:, : differ + 1 + size - width]
        place = (cells % size).astype(np.int16)[:, :, None]
        held = (place >= offsets) & (place < offsets + width)
        held &= np.cumsum(held, axis=1, dtype=np.int16) <= differ + 1
        held &= open_[some][:, None, :]
        k, s = np.nonzero(held.any(axis=2) & (cells >= lone * size))
        rows_.append(some[k])
        whats.append(cells[k, s] // size)
        shows.append(held[k, s])
    row, what, shown = np.concatenate(rows_), np.concatenate(whats), np.concatenate(shows)
    if len(row):  # one for each n-gram of a row
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (what[1:] != what[:-1])))
        row, what, shown = row[first], what[first], np.logical_or.reduceat(shown, first, axis=0)
    order = np.lexsort((row, what))
    listed, sorted_ = row[order], what[order]
    own = np.empty(len(order), dtype=np.int64)
    own[order] = np.arange(len(order))
    start, stop = np.searchsorted(sorted_, what), np.searchsorted(sorted_, what, "right")
    active = np.flatnonzero(stop - start > 1)
    # slots of n-grams that others may have; a key of few gives each its own
    many = np.append(times > 1, False)
    of = np.append(np.cumsum(many) - many, 0)[:-1]
    lowest = of[np.searchsorted(owner, np.arange(int(run[-1]) + 1))] if len(owner) else np.zeros(n, dtype=np.int64)
    slots = np.where(many[ids], (of[ids] - lowest[run][:, None]) % (1 << 16), -1)
    shared = _Shared(ids, slots, width)
    tried = np.zeros(0, dtype=np.int64)
    lo, step = 0, 1
    while len(active):
        look = shown[active] & open_[row[active]]
        till = np.where((look & ~found[row[active]]).any(axis=1), stop[active], own[active])
        here = look.any(axis=1) & (start[active] + lo < till)
        active, till = active[here], till[here]
        counts = np.minimum(till - start[active] - lo, step)
        before = tried
        for some in np.split(np.arange(len(active)), np.flatnonzero(np.diff(np.cumsum(counts) // 200_000)) + 1):
            a, b = np.repeat(row[active[some]], counts[some]), listed[_places(counts[some], start[active[some]] + lo)]
            other = doc[a] != doc[b]
            pair = np.sort(np.maximum(a, b)[other] * n + np.minimum(a, b)[other])
            pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
            if len(tried) and len(pair):
                pair = pair[tried[np.minimum(np.searchsorted(tried, pair), len(tried) - 1)] != pair]
            tried = np.sort(np.concatenate([tried, pair])) if len(before) + len(pair) < TRIED else pair
            for few in np.split(pair, np.arange(20_000, len(pair), 20_000)):
                x, y = few // n, few % n  # y is of the lesser document
                both = valid[x] & valid[y]
                asked = (both & (open_[x] | ~found[y])).any(axis=1)
                x, y = x[asked], y[asked]
                if not len(x):
                    continue
                hit = both[asked] & (shared.counts(x, y) >= least)
                some_ = hit.any(axis=1)
                x, y, hit = x[some_], y[some_], hit[some_]
                while True:
                    k = _best(x, (hit & open_[x]).sum(axis=1))
                    if not len(k):
                        k = _best(y, (hit & ~found[y]).sum(axis=1))
                    if not len(k):
                        break
                    yield x[k], y[k]
                    for z, states in ((x[k], (open_, found)), (y[k], (found,))):
                        p, l = np.nonzero(hit[k])
                        for state in states:
                            state[z[p], l] = state is found
        lo, step = lo + step, step * 3


def _rest(links: DataFrame, chosen: DataFrame, n: int, words: int, threshold: float, parts: int) -> DataFrame:
    """(a, at_a, b, at_b) of similar rows under keys of three contexts or more, where not all have met the least document."""
    width = words - n + 1
    first = links.where("mark = 3").select("key", F.col("a").alias("doc"), F.col("at_a").alias("at"))
    many = first.groupBy("key").agg(F.count("*").alias("c")).where("c > 2").select("key")
    asked = first.join(many, "key", "left_semi")
    # a text goes to Python once for some thousands of its contexts
    lists = asked.groupBy("doc", F.floor(F.col("at") / 2000).alias("list")).agg(F.collect_list(F.struct("key", "at")).alias("asks"))
    sourced = lists.join(chosen, "doc").select("doc", "text_", F.col("asks.key").alias("key"), F.col("asks.at").alias("at"))
    size, reach = wide(width), reaches(width)

    def cells(w, edges, docs, keys, places):
        """Rows of many texts' contexts, some thousands at a time."""
        grams = [C.shingles(w[x:y], n).astype(np.uint32) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
        begins, flat = np.cumsum(sizes) - sizes, np.concatenate([*grams, np.zeros(1, dtype=np.uint32)])
        of = np.repeat(np.arange(len(docs)), np.fromiter(map(len, keys), dtype=np.int64, count=len(keys)))
        key, at = (np.concatenate(x).astype(np.int64) for x in (keys, places))
        for few in np.array_split(np.flatnonzero(sizes[of] > 0), -(-len(of) // 10_000) or 1):
            low = at[few] - np.where(key[few] & 1, reach[1], reach[0])
            place, most = low[:, None] + np.arange(size), sizes[of[few]]
            held = (place >= 0) & (place < most[:, None])
            raw = np.where(held, flat[np.where(held, place + begins[of[few]][:, None], 0)], np.uint32(0)).tobytes()
            yield pd.DataFrame({"key": key[few], "doc": docs[of[few]], "at": at[few].astype(np.int32), "from": np.maximum(-low, 0).astype(np.int32), "to": np.minimum(most - low, size).astype(np.int32), "grams": [raw[k : k + 4 * size] for k in range(0, len(raw), 4 * size)]})

    def slices(batches):
        for pdf in C.slabs(batches, "text_", 500_000):
            w, edges = C.words_of(C.texts_of(pdf["text_"]))
            yield from cells(w, edges, pdf["doc"].to_numpy(dtype=np.int64), [np.asarray(x) for x in pdf["key"]], [np.asarray(x) for x in pdf["at"]])

    sent = sourced.mapInPandas(slices, "key long, doc long, at int, from int, to int, grams binary")

    def linked(doc, at, pairs):
        x, y = (np.concatenate(z) for z in zip(*pairs, strict=True))
        return pd.DataFrame({"a": doc[x], "at_a": at[x], "b": doc[y], "at_b": at[y]})

    def others(batches):
        held = None

        def met(pdf):
            key, doc, at = (pdf[c].to_numpy() for c in ("key", "doc", "at"))
            cells = np.frombuffer(b"".join(pdf["grams"]), dtype=np.uint32).reshape(-1, size)
            some, held = [], 0
            for pair in _others(key, doc, cells, pdf["from"].to_numpy(), pdf["to"].to_numpy(), width, threshold):
                some.append(pair)
                held += len(pair[0])
                if held >= 20_000:
                    yield linked(doc, at, some)
                    some, held = [], 0
            if some:
                yield linked(doc, at, some)

        for pdf in _gathered(batches, lambda: 10_000):
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = pdf["key"].to_numpy()
            to = int(np.searchsorted(key, key[-1]))
            held = pdf.iloc[to:]
            if to:
                yield from met(pdf.iloc[:to])
        if held is not None:
            yield from met(held)

    return sent.repartition(parts, "key").sortWithinPartitions("key", "doc", "at").mapInPandas(others, "a long, at_a int, b long, at_b int")


def repeats(docs: DataFrame, n: int = 5, words: int = 50, threshold: float = 0.8, hashes: int = 4, piece: int = 1500, asks: int = 500, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, n_words, first: the passages of each document that stand in others too.

    A passage is a run of windows of words lower-case words (between white space), each with a Jaccard similarity of its
    n-grams of threshold or more to a window of another document; overlapping windows are one passage. first is true where
    no document of a lesser id was found to hold the passage. Null and short texts (under words words) have no passage; a
    text that repeats within its document alone has none; rows that repeat an id are one document; a null id counts as one
    document, less than all others; further columns are left out.

    Windows whose least n-gram stands in one text alone are left out first; documents of the same words stand for each other
    and get their whole length as a passage. The others come twice, by the least n-gram with that of those before it,
    and with that of those after it, up to half a window away; a passage holds one of the two sides whole. So a key that stands in
    unrelated contexts is split by them. Under each key every document is held against the least document of its
    range that has the same context, and against the least of all if that is another one, and the ranges'
    least against each other; keys are dealt over ranges in order of key and id, so that one that many share spreads over tasks.
    Where a key has three contexts or more, all of them meet by the rarest n-grams of their windows, which finds every similar two. Links of one diagonal are stretches,
    whose n-grams, as 32-bit hashes, are compared window by window.
    """
    spark = docs.sparkSession
    width, parts = words - n + 1, C.n_partitions(spark)
    seeds = np.array([pow(0xC2B2AE3D27D4EB4F, k + 2, 1 << 64) for k in range(hashes)], dtype=np.uint64)
    chosen = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text_"))

    def cut(batches):
        for pdf in C.slabs(batches, "text_", 1_000_000):
            w, edges = C.words_of(C.texts_of(pdf["text_"]))
            owner, key, at, before, after = compact_windows(w, edges, n, width, seeds)
            # one row more for each document: a hash of all its words, and their number below zero
            size = np.diff(edges)
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(C.mixed(w) * C.mixed((_places(size, np.zeros_like(size)) + 1).astype(np.uint64)), dtype=np.uint64)])
            whole = C.mixed(sums[edges[1:]] - sums[edges[:-1]])
            same = (C.mixed(whole) & np.uint64(0x7FFFFFFF)).astype(np.int32)
            long = np.flatnonzero(size >= words)
            none = np.zeros(len(long), dtype=np.int32)
            doc = pdf["doc"].to_numpy(dtype=np.int64)
            side = (lambda x: np.concatenate([x.astype(np.uint32).view(np.int32), none]))
            around = [np.concatenate([x.view(np.int64), none]) for x in contexts(w, edges, n, width, owner, at)]
            yield pd.DataFrame({"key": np.concatenate([key, whole[long]]).view(np.int64), "doc": np.concatenate([doc[owner], doc[long]]), "at": np.concatenate([at, -size[long]]).astype(np.int32), "same": np.concatenate([same[owner], same[long]]), "before": side(before), "after": side(after), "context_b": around[0], "context_a": around[1]})

    columns = "key long, doc long, at int, same int, before int, after int, context_b long, context_a long"
    windows = C.keep(chosen.mapInPandas(cut, columns), "windows")
    by = ["key", "same", "at", "doc"]
    dealt = windows.where("at >= 0").repartitionByRange(parts, *by).sortWithinPartitions(*by)
    shared = C.keep(dealt.mapInPandas(_partners, columns), "shared")
    # the others are not needed any more, and are most of what is on disk
    whole = C.keep(windows.where("at < 0").select("key", "same", "doc", (-F.col("at")).alias("y")), "whole")
    C.drop(windows)
    # a key's lowest bit tells the side
    split = [F.when(F.col(c) != 0, F.struct(F.xxhash64("key", F.lit(k), c).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(k).cast("long")).alias("key"), F.col(f"context_{c[0]}").alias("beside"))) for k, c in enumerate(("before", "after"))]
    keyed = shared.select(F.explode(F.array(*split)).alias("s"), "doc", "at").where("s IS NOT NULL").select("s.key", "doc", "at", "s.beside")
    by = ["key", "doc", "at"]
    links = C.keep(keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInPandas(_meet, "key long, a long, at_a int, b long, at_b int, mark int, part int"), "links")
    ends = links.where("mark IN (1, 2)").orderBy("part", "mark").collect()  # two rows for each range
    across = [(x["a"], x["at_a"], y["a"], y["at_a"]) for y, x in zip(ends[:-1], ends[1:], strict=True) if x["key"] == y["key"] and x["a"] != y["a"]]
    rest = C.keep(_rest(links, chosen, n, words, threshold, parts), "rest")
    met = links.where("mark = 0").select("a", "at_a", "b", "at_b").unionByName(rest)
    if across:
        met = met.unionByName(spark.createDataFrame(across, "a long, at_a int, b long, at_b int"))
    stretches = met.groupBy("a", "b", (F.col("at_a") - F.col("at_b")).alias("shift")).agg(F.min("at_a").alias("lo"), F.max("at_a").alias("hi"))
    # long stretches in pieces, so that what is sent at a time is bounded
    stretches = stretches.withColumn("lo", F.explode(F.sequence("lo", "hi", F.lit(piece)))).withColumn("hi", F.least("hi", F.col("lo") + F.lit(piece)))
    stretches = C.keep(stretches.withColumn("id", F.monotonically_increasing_id()), "stretches")
    reach = width - 1
    one = stretches.select(F.col("a").alias("doc"), "id", F.lit(0).alias("side"), F.greatest(F.col("lo") - reach, F.lit(0)).alias("from"), (F.col("hi") + reach + 1).alias("to"), "shift")
    two = stretches.select(F.col("b").alias("doc"), "id", F.lit(1).alias("side"), F.greatest(F.col("lo") - F.col("shift") - reach, F.lit(0)).alias("from"), (F.col("hi") - F.col("shift") + reach + 1).alias("to"), "shift")
    asked = one.unionByName(two)
    # a text goes to Python once for a few hundred slices of it
    many = asked.groupBy("doc").agg(F.ceil(F.count("*") / asks).cast("int").alias("lists"))
    listed = asked.join(many, "doc").groupBy("doc", F.pmod(F.xxhash64("id"), F.col("lists")).alias("list")).agg(F.collect_list(F.struct("id", "side", "from", "to", "shift")).alias("asks"))
    columns = ["id", "side", "from", "to", "shift"]

    def slices(batches):
        names = ["id", "side", "doc", "first_", "shift", "grams"]
        for pdf in C.slabs(batches, "text_", 1_000_000):
            w, edges = C.words_of(C.texts_of(pdf["text_"]))
            out, held = [], 0
            for k, (doc, *lists) in enumerate(zip(pdf["doc"], *(pdf[c] for c in columns), strict=True)):
                grams = C.shingles(w[edges[k] : edges[k + 1]], n).astype(np.uint32)
                for x, side, begin, end, shift in zip(*(v.tolist() for v in lists), strict=True):
                    raw = grams[begin:end].tobytes()
                    out.append((x, side, doc, begin, shift, raw))
                    held += len(raw)
                    if held >= 8_000_000:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    sourced = listed.join(chosen, "doc").select("doc", "text_", *[F.col("asks")[c].alias(c) for c in columns])
    sent = sourced.mapInPandas(slices, "id long, side int, doc long, first_ int, shift int, grams binary")

    def verify(batches):
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            ident, side, doc, first, turned = (pdf[c].to_numpy() for c in ("id", "side", "doc", "first_", "shift"))
            raw = pdf["grams"].tolist()
            size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
            flat, at = np.frombuffer(b"".join(raw), dtype=np.uint32), np.cumsum(size) - size
            left = np.maximum.accumulate(np.where(side == 0, np.arange(len(side)), -1))
            held = pdf.iloc[[left[-1]]] if left[-1] >= 0 else None
            y = np.flatnonzero((side == 1) & (left >= 0))
            x = left[y]
            y, x = y[ident[x] == ident[y]], x[ident[x] == ident[y]]
            shift = turned[y].astype(np.int64)
            lo = np.maximum(first[x], first[y] + shift)
            span = np.minimum(first[x] + size[x], first[y] + size[y] + shift) - lo
            fits = span >= width
            x, y, shift, lo, span = x[fits], y[fits], shift[fits], lo[fits], span[fits]
            if not len(x):
                continue
            hit = _hits(flat[_places(span, at[x] + lo - first[x])], flat[_places(span, at[y] + lo - shift - first[y])], span, width, threshold)
            if not len(hit):
                continue
            of = np.repeat(np.arange(len(span)), span)[hit]
            place = _places(span, lo)[hit]
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (place[1:] - place[:-1] > width))
            begin, end = place[np.append(0, cuts + 1)], place[np.append(cuts, len(place) - 1)] + words
            of = of[np.append(0, cuts + 1)]
            a, b, shift = doc[x[of]], doc[y[of]], shift[of]
            yield pd.DataFrame({"doc": np.concatenate([a, b]), "x": np.concatenate([begin, begin - shift]).astype(np.int32), "y": np.concatenate([end, end - shift]).astype(np.int32), "later": np.concatenate([a > b, b > a])})

    found = sent.repartition(parts, "id").sortWithinPartitions("id", "side").mapInPandas(verify, "doc long, x int, y int, later boolean")
    groups = whole.groupBy("key", "same").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").drop("high")
    copies = whole.join(groups, ["key", "same"]).select("doc", F.lit(0).alias("x"), "y", (F.col("doc") > F.col("low")).alias("later"))
    found = found.unionByName(copies).groupBy("doc", "x", "y").agg(F.max("later").alias("later"))
    order = Window.partitionBy("doc").orderBy("x", "y")
    reach_ = F.max("y").over(order.rowsBetween(Window.unboundedPreceding, -1))
    isles = found.withColumn("new", F.coalesce((F.col("x") > reach_).cast("int"), F.lit(1))).withColumn("isle", F.sum("new").over(order))
    spans = isles.groupBy("doc", "isle").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.max("later").alias("later"))
    out = C.keep(spans.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.col("x").alias("start_word"), (F.col("y") - F.col("x")).alias("n_words"), (~F.col("later")).alias("first")), "passages")
    C.drop(shared, whole, links, rest, stretches)
    return out
