"""Words of many pages as flat arrays, and what stands around spans of them, without rows or matrices of words."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that are looked at together, and pairs of a group of spans and a word.
WORDS, PAIRS = 1 << 15, 1 << 18
#: Coordinates that are this part of one, and less than this many, are exact as integers; bits of such a coordinate (centres are halves), and of a word's number.
UNIT, MOST, BITS, NUMBER = 1 << 12, 1 << 10, 24, 24


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1]."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(counts: np.ndarray, most: int) -> list[slice]:
    """Rows in slices of at most most in all, or one row."""
    ends, out, i = np.cumsum(counts), [], 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        out.append(slice(i, j))
        i = j
    return out


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of pages with lines, as many at a time as have WORDS words at most."""
    lines = batch.column("lines")
    ends = np.cumsum(np.concatenate(([0], pc.fill_null(pc.utf8_length(lines.flatten()), 0).to_numpy(zero_copy_only=False))))
    letters = np.diff(ends[np.concatenate(([0], np.cumsum(sizes(lines))))])
    for part in slices(letters // 4 + 8, WORDS):
        yield batch.slice(part.start, part.stop - part.start)


@dataclass
class Words:
    """page (place of the page in a batch, ascending), ids (word_id, ascending on a page), text and box of each word."""

    page: np.ndarray
    ids: np.ndarray
    text: pa.Array
    left: np.ndarray
    top: np.ndarray
    right: np.ndarray
    bottom: np.ndarray

    @cached_property
    def x(self) -> np.ndarray:
        return (self.left + self.right) / 2

    @cached_property
    def y(self) -> np.ndarray:
        return (self.top + self.bottom) / 2

    @cached_property
    def keys(self) -> np.ndarray:
        return self.key(self.page, self.ids)

    @staticmethod
    def key(page: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A word's page and number as one, in the order words have."""
        return (page << 32) + ids + (1 << 31)

    @cached_property
    def spelt(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's place among the different texts, and these."""
        some = self.text.dictionary_encode(null_encoding="encode")
        return some.indices.to_numpy(zero_copy_only=False), some.dictionary

    @cached_property
    def whole(self) -> tuple[np.ndarray, ...] | None:
        """The box in units, twice as fine for centres; None if that isn't exact for every word, or a box is turned."""
        out = []
        for side in (self.left, self.top, self.right, self.bottom):
            if not (np.isfinite(side).all() and (side >= 0).all() and (side < MOST).all()):
                return None
            units = side * UNIT
            if not (units == (n := units.astype(np.int64))).all():
                return None
            out.append(2 * n)
        left, top, right, bottom = out
        fits = len(self.page) < 1 << NUMBER and (left <= right).all() and (top <= bottom).all()
        return (left, top, right, bottom, (left + right) >> 1, (top + bottom) >> 1) if fits else None


@dataclass
class Spans:
    """page of each span (ascending), and as pairs (of, own) its words: places among Words in the span's order."""

    page: np.ndarray
    of: np.ndarray
    own: np.ndarray

    def kept(self) -> np.ndarray:
        """Whether a span has a word."""
        return np.bincount(self.of, minlength=len(self.page)) > 0

    def only(self, kept: np.ndarray) -> Spans:
        return Spans(self.page[kept], (np.cumsum(kept) - 1)[self.of], self.own)

    @cached_property
    def begins(self) -> np.ndarray:
        return np.searchsorted(self.of, np.arange(len(self.page)))

    def box(self, w: Words) -> tuple[np.ndarray, ...]:
        """l, t, r, b around the words; every span has one."""
        part = lambda f, side: f.reduceat(side[self.own], self.begins) if len(self.page) else np.zeros(0)
        return part(np.minimum, w.left), part(np.minimum, w.top), part(np.maximum, w.right), part(np.maximum, w.bottom)

    def texts(self, w: Words) -> pa.Array:
        """The words' texts, joined by spaces; null ones are left out."""
        own = w.text.take(pa.array(self.own))
        there = own.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(np.bincount(self.of[there], minlength=len(self.page)))))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own.filter(pa.array(there))), " ")


def named(w: Words, page: np.ndarray, lists: pa.Array) -> Spans:
    """Spans on pages by their word_ids; unknown and null ids are left out."""
    ids = lists.flatten()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(page)), sizes(lists))[known]
    keys = w.key(page[of], ids.filter(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64))
    low, high = (np.searchsorted(w.keys, keys, side) for side in ("left", "right"))
    return Spans(page, np.repeat(of, high - low), places(low, high - low))


def cleaned(texts: pa.Array) -> pa.Array:
    """Texts in lower case without white space at the ends; null: "". Only those of more than ASCII are Python's strings on the way."""
    texts = pc.fill_null(texts, "")
    out = pc.ascii_lower(pc.ascii_trim(texts, " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"))
    others = pc.invert(pc.string_is_ascii(texts))
    return pc.replace_with_mask(out, others, pa.array([x.strip().lower() for x in texts.filter(others).to_numpy(zero_copy_only=False).tolist()], pa.string()))


def nearest(w: Words, s: Spans, box: tuple[np.ndarray, ...], known: Sequence[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each span the word of a vocabulary whose centre is nearest, the first of equals and none of its own (-1: none), how far it is (infinite: none), and the clean text by spelling."""
    l, t, r, b = box
    spelling, texts = w.spelt
    clean = cleaned(texts)
    said = pc.is_in(clean, pa.array(known, pa.string())).to_numpy(zero_copy_only=False)
    hits = (said[spelling] if len(said) else np.zeros(0, bool)).nonzero()[0]
    first, last = (np.searchsorted(w.page[hits], s.page, side) for side in ("left", "right"))
    count = last - first
    best, dist = np.full(len(s.page), -1), np.full(len(s.page), np.inf)
    place = np.full(len(w.page), -1)
    place[hits] = np.arange(len(hits))
    own = place[s.own]
    mine, own = s.of[own >= 0], own[own >= 0]
    some_hits = (count > 0).nonzero()[0]
    for part in slices(count[some_hits], PAIRS):
        some = some_hits[part]
        n = count[some]
        begins, hit, span = np.cumsum(n) - n, hits[places(first[some], n)], np.repeat(some, n)
        away = np.sqrt((w.x[hit] - (l[span] + r[span]) / 2) ** 2 + (w.y[hit] - (t[span] + b[span]) / 2) ** 2)
        a, z = np.searchsorted(mine, (some[0], some[-1] + 1))
        away[begins[np.searchsorted(some, mine[a:z])] + own[a:z] - first[mine[a:z]]] = np.inf
        dist[some] = np.minimum.reduceat(away, begins)
        best[some] = hit[np.minimum.reduceat(np.where(away == np.repeat(dist[some], n), np.arange(len(away)), len(away) - 1), begins)]
    return np.where(np.isfinite(dist), best, -1), dist, clean


def around(w: Words, s: Spans, box: tuple[np.ndarray, ...], row: float) -> tuple[np.ndarray, ...]:
    """Of each span the places of the nearest words to its left, right, above and below as joins.surroundings() has them (-1: none). The spans' boxes are those of their words, so that none of their own comes in."""
    if w.whole is None:
        return _compared(w, s, box, row)
    left, top, right, bottom, x, y = w.whole
    l, t, r, b = ((2 * UNIT * v).astype(np.int64) for v in box)
    n, number = len(w.page), np.arange(len(w.page))
    at, at_page = s.page << BITS, w.page << BITS
    far = min(math.floor(row * 2 * UNIT), 2 * UNIT * MOST)
    # words by height: what is level is a piece, what is higher or lower is before or after it
    by_y = np.argsort(at_page + y, kind="stable")
    heights, rank = (at_page + y)[by_y], np.empty(n, np.int64)
    rank[by_y] = number
    middle, limit = (t + b) >> 1, (1 << BITS) - 1
    a = np.searchsorted(heights, at + np.maximum(middle - far, 0), "left")
    z = np.searchsorted(heights, at + np.minimum(middle + far, limit), "right")
    page_first, page_last = (np.searchsorted(w.page, s.page, side) for side in ("left", "right"))
    # the largest bottom, then the first word, of those so far in this order; the smallest top of those from there on
    up = np.minimum(a, np.searchsorted(heights, at + t, "left"))
    down = np.maximum(z, np.searchsorted(heights, at + b, "right"))
    down_best = np.minimum.accumulate(_tagged(w.page, top, number)[by_y][::-1])[::-1]
    up_best = np.maximum.accumulate(_tagged(w.page, bottom, n - 1 - number)[by_y])
    pick = lambda values, place, there, turn: np.where(there, turn(values[np.where(there, place, 0)] & ((1 << NUMBER) - 1)), -1) if n else np.full(len(place), -1)
    back, same = (lambda v: n - 1 - v), (lambda v: v)
    above = pick(up_best, up - 1, up > page_first, back)
    below = pick(down_best, down, down < page_last, same)
    # spans with the same level words are a group, which has its words by their middles
    by_x = np.argsort(at_page + x, kind="stable")
    levels, group = np.unique(a * (n + 1) + z, return_inverse=True)
    low, high = levels // (n + 1), levels % (n + 1)
    start, end = np.zeros(len(levels), np.int64), np.zeros(len(levels), np.int64)
    start[group], end[group] = page_first, page_last
    spans = np.argsort(group, kind="stable")
    starts = np.concatenate((np.searchsorted(group[spans], np.arange(len(levels))), [len(spans)]))
    out_left, out_right = np.full(len(s.page), -1), np.full(len(s.page), -1)
    for part in slices(end - start + 1, PAIRS):
        for k in range(part.start, part.stop, 1 << 14):
            some = slice(k, min(k + (1 << 14), part.stop))
            count = end[some] - start[some]
            words, g = by_x[places(start[some], count)], np.repeat(np.arange(len(count)), count)
            level = (rank[words] >= low[some][g]) & (rank[words] < high[some][g])
            words, g = words[level], g[level]
            if not len(words):
                continue
            edge = (g << BITS) + x[words]
            last = np.maximum.accumulate(_tagged(g, right[words], n - 1 - words))
            first = np.minimum.accumulate(_tagged(g, left[words], words)[::-1])[::-1]
            mine = spans[starts[some.start] : starts[some.stop]]
            own = group[mine] - some.start
            begin, stop = np.searchsorted(g, own, "left"), np.searchsorted(g, own, "right")
            i, j = np.searchsorted(edge, (own << BITS) + l[mine], "left"), np.searchsorted(edge, (own << BITS) + r[mine], "right")
            out_left[mine] = pick(last, i - 1, i > begin, back)
            out_right[mine] = pick(first, j, j < stop, same)
    return out_left, out_right, above, below


def _tagged(group: np.ndarray, value: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Group, value and number as one, ordered in this way."""
    return (((group << BITS) + value) << NUMBER) + number


def _compared(w: Words, s: Spans, box: tuple[np.ndarray, ...], row: float) -> tuple[np.ndarray, ...]:
    """around() by comparing each span with each word of its page, for any boxes."""
    out = np.full((4, len(s.page)), -1)
    first, last = (np.searchsorted(w.page, s.page, side) for side in ("left", "right"))
    for p in np.unique(s.page):
        spans = np.arange(*np.searchsorted(s.page, (p, p + 1)))
        words = slice(first[spans[0]], last[spans[0]])
        step = max(1, PAIRS // max(words.stop - words.start, 1))
        left, top, right, bottom, x, y = (v[words] for v in (w.left, w.top, w.right, w.bottom, w.x, w.y))
        for k in range(0, len(spans) if len(x) else 0, step):
            some = spans[k : k + step]
            l, t, r, b = (v[some, None] for v in box)
            a, z = np.searchsorted(s.of, (some[0], some[-1] + 1))
            free = np.ones((len(some), len(x)), bool)
            free[s.of[a:z] - some[0], s.own[a:z] - words.start] = False
            level = np.abs(y - (t + b) / 2) <= row
            for side, (test, gap) in enumerate(((level & (x < l), l - right), (level & (x > r), left - r), (~level & (y < t), t - bottom), (~level & (y > b), top - b))):
                gap = np.where(test & free, gap, np.inf)
                out[side, some] = np.where(np.isfinite(gap.min(axis=1)), gap.argmin(axis=1) + words.start, -1)
    return tuple(out)


def inside(w: Words, boxes: tuple[np.ndarray, ...], margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a box (page, l, t, r, b; of equal ones on a page the first) and the word whose centre it holds, edges and margin included; by box, then word."""
    page, l, t, r, b = boxes
    order = np.lexsort((b, r, t, l, page))
    same = np.ones(len(order), bool)
    same[:1] = False
    for v in boxes:
        same[1:] &= v[order][1:] == v[order][:-1]
    some = np.sort(order[~same])
    if w.whole is not None:
        at, x = w.page << BITS, w.whole[4]
        by_x = np.argsort(at + x, kind="stable")
        # a unit more on both sides, as the test is below
        edge = lambda v, more: (page[some] << BITS) + np.clip(np.nan_to_num(v[some] * 2 * UNIT) + more, 0, (1 << BITS) - 1).astype(np.int64)
        first, last = np.searchsorted((at + x)[by_x], edge(l - margin, -2), "left"), np.searchsorted((at + x)[by_x], edge(r + margin, 2), "right")
    else:
        by_x = np.arange(len(w.page))
        first, last = (np.searchsorted(w.page, page[some], side) for side in ("left", "right"))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    n = np.maximum(last - first, 0)
    for part in slices(n, PAIRS):
        box, word = np.repeat(some[part], n[part]), by_x[places(first[part], n[part])]
        x, y = w.x[word], w.y[word]
        held = (x >= l[box] - margin) & (x <= r[box] + margin) & (y >= t[box] - margin) & (y <= b[box] + margin)
        out.append((box[held], word[held]))
    box, word = (np.concatenate(v) for v in zip(*out, strict=True))
    order = np.lexsort((word, box))
    return box[order], word[order]


def list_order(page: np.ndarray, lists: pa.Array) -> np.ndarray:
    """The order of lists of numbers by page, then as arrays compare."""
    n, flat = sizes(lists), lists.flatten().to_numpy(zero_copy_only=False)
    if len(n) * n.max(initial=0) > PAIRS:
        each = lists.to_pylist()
        return np.array(sorted(range(len(each)), key=lambda k: (page[k], each[k])), np.int64)
    wide = np.full((n.max(initial=0), len(n)), np.iinfo(np.int64).min)
    wide[places(np.zeros(len(n), np.int64), n), np.repeat(np.arange(len(n)), n)] = flat
    return np.lexsort((*wide[::-1], page))


def _hashed(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int after what gave seed."""
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seed + five + np.uint64(4)) ^ ((value.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64) * one)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * two + three
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return h ^ (h >> np.uint64(32))


def free_runs(w: Words, taken: np.ndarray, seed: np.ndarray, per_page: int, most: int) -> tuple[np.ndarray, ...]:
    """page, start, n of the per_page runs of 1..most words of each page that come first by their hash (seed: that of each page) and have no number of a taken word; by page, start, n."""
    keys = np.unique(w.keys[taken])
    after = np.concatenate((keys, [np.iinfo(np.int64).max]))[np.searchsorted(keys, w.keys)] - w.keys
    free = np.minimum(np.minimum(after, np.searchsorted(w.page, w.page, "right") - np.arange(len(w.page))), most)
    before = _hashed(w.ids, seed.view(np.uint64)[w.page])
    runs = np.bincount(w.page, weights=free, minlength=len(seed))
    # hashes are spread evenly: where enough are under a limit, the others need not be put in order
    limit = np.minimum(8.0 * per_page / np.maximum(runs, 1), 1.0)[w.page] * 2.0**64
    some = []
    for n in range(1, most + 1):
        i = (free >= n).nonzero()[0]
        h = _hashed(np.full(len(i), n), before[i])
        some.append((i, np.full(len(i), n), h, (h ^ np.uint64(1 << 63)) <= limit[i]))
    i, n, h, low = (np.concatenate(v) for v in zip(*some, strict=True))
    enough = np.bincount(w.page[i[low]], minlength=len(seed)) >= np.minimum(per_page, runs)
    low |= ~enough[w.page[i]]
    i, n, h = i[low], n[low], h[low]
    order = np.lexsort((n, w.ids[i], h.view(np.int64), w.page[i]))
    i, n = i[order], n[order]
    first = np.arange(len(i)) - np.searchsorted(w.page[i], w.page[i]) < per_page
    i, n = i[first], n[first]
    order = np.lexsort((n, w.ids[i], w.page[i]))
    return w.page[i[order]], w.ids[i[order]], n[order]
