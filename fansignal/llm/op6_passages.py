"""Substring deduplication: fuzzy passages by collinear chaining of k-mer seeds.

1. Equal texts form classes; a copy meets the smallest id of its class only, and the steps
   below see one text of each class. A run of SEED words is a seed if the smallest of its word
   hashes is the first or the last: that takes nothing but the run, so an unchanged one is a
   seed in both texts or in neither, and of SEED - 1 in a row one is a seed.
2. Seeds are sorted once, by (seed, document, place) over ranges, so a frequent seed is spread
   over several tasks. Documents meet over seeds, but not all with all: each document that
   holds a seed meets the first (smallest) document that holds it. A seed in m documents gives
   m rows, whatever m is. Two seeds within RUN_GAP words make a pair of the two documents, if the
   seeds around them (shared with any document) span LEAST of ``min_words`` words.
3. The first holder of a seed need not hold the passage. So each document also meets the first
   holder of keys: of CHAINED shared seeds in a row, and of each stretch of shared seeds that
   fills min_words - SEED + 2 words. As neighbouring seeds overlap, a stretch stands for its
   very words. No key is made of seeds that one document is known to hold in the same order and
   places (and, for a stretch, ``min_words`` words around it): that document is met anyway.
   So an exact repeat is paired with a document that holds all of it, or all but up to
   SEED - 2 words at an end if such an earlier one exists.
4. For each pair, all k-mers of both whole texts are matched, each occurrence with each, and
   runs of matches become fragments (where k-mers are frequent, found by their ends). A sweep over the
   document with a Fenwick tree over the other's positions finds the best chain that ends
   in each fragment, minus a cost for the words skipped in either text.
5. Chains are cut where more than MAX_GAP words are skipped, the gaps are aligned word by
   word, both ends are carried on over changed words while the share of aligned words allows,
   and a passage of at least ``min_words`` words with at least ``identity`` of its words aligned
   is reported; one that falls short is cut at its worst gap and tried again.
6. Where k-mers are frequent, a place has matches in many places: chains with the most words not yet told go
   first, until every word of a passage is told.

The result has one row per passage: doc_id, other_id (the first document of the pair),
word offsets start/end and other_start/other_end, matched (aligned words) and identity.
The first document with a passage appears as other_id only. A passage that a document holds
twice, ``min_words`` words or more apart, is told with other_id = doc_id and other_start before start. A
place in doc_id that matches several places of other_id is told once, at the best of them (step 6).

Null ids and texts of fewer than K words give nothing. Rows that repeat a doc_id are one
document (the smallest text is aligned). An empty table gives no rows. A very long text is
one row and handled whole. A fuzzy passage is missed if other, earlier documents hold every
seed and every run of seeds it shares.
"""
from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from fansignal.llm.words import U64, mix64, odd_multipliers, shingle_hashes, word_list
from fansignal.sources.tables import dropped, staged

K = 5                 # words of a k-mer that is matched in a pair
SEED = 5              # words of a seed
CHAINED = (3, 6)      # seeds in a row that make longer keys
RUN_GAP = 40          # words between two seeds that make a pair
MAX_GAP = 16          # words a passage may skip in either text
GAP_COST = 0.2        # per skipped word
LEAST = 0.3           # share of min_words that unchanged k-mers must span
MATCHES = 4           # k-mer pairs per word of both texts that are made one by one; beyond, only the ends of runs
PARTNERS = 256        # documents aligned with one copy of the first document's text, on average
RESYNC = 4            # words skipped at once when an end is carried on
FEW = 32              # chains of a pair that are carried on one by one


def seed_places(h: np.ndarray) -> np.ndarray:
    """Positions of the runs of SEED words whose smallest word is the first or the last (closed
    syncmers); h: hashes of the words."""
    n = len(h) - SEED + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = h[:n]
    for i in range(1, SEED):
        least = np.minimum(least, h[i:i + n])
    return np.flatnonzero((least == h[:n]) | (least == h[SEED - 1:]))


def _seeds(batches):
    mult = odd_multipliers(SEED, 5)
    for batch in batches:
        seed, doc, pos = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            w = word_list(t.as_py())
            if i is None or len(w) < SEED:
                continue
            h = np.fromiter(map(xxh3_64_intdigest, w), U64, len(w))
            at = seed_places(h)
            seed.append(mix64(sum(h[at + k] * mult[k] for k in range(SEED))))
            pos.append(at)
            doc.append(np.full(len(at), i, np.int64))
        cat = (lambda x, t: np.concatenate(x).astype(t, copy=False) if x else np.zeros(0, t))
        yield pa.RecordBatch.from_arrays([pa.array(cat(seed, U64).view(np.int64)), pa.array(cat(doc, np.int64)),
                                          pa.array(cat(pos, np.int32))], ["seed", "doc_id", "pos"])


def _first_holders(batches):
    """Rows sorted by (seed, doc_id, pos) -> (doc_id, pos, hub, hub_pos, edge) of the seeds in two or
    more places. Seeds that may go on in the partition before or after have edge = seed, and the first
    holder in this partition only. Kept from batch to batch: the first holder of the last seed, and its
    rows until a second one comes."""
    def rows(s, d, p, hd, hp, edge):
        e = pa.array(s, mask=~edge)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(p), pa.array(hd), pa.array(hp), e],
                                          ["doc_id", "pos", "hub", "hub_pos", "edge"])

    last = first_seed = held = None     # last: (seed, hub, hub_pos, rows of it so far); held: its one row
    for batch in batches:
        if not batch.num_rows:
            continue
        s, d, p = (np.asarray(batch.column(i)) for i in range(3))
        if held is not None:
            s, d, p = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(held, (s, d, p), strict=True))
            held = None
        first_seed = s[0] if first_seed is None else first_seed
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.concatenate([start, [len(s)]]))
        hub, hub_pos, many = d[start].copy(), p[start].copy(), count > 1
        if last is not None and last[0] == s[0]:
            hub[0], hub_pos[0], many[0] = last[1], last[2], True
        edge = s[start] == first_seed
        last = (s[-1], hub[-1], hub_pos[-1])
        if not many[-1] and not edge[-1]:
            held = (s[-1], d[-1], p[-1])
            last = None
        g = np.repeat(np.arange(len(start)), count)
        told = (many | edge)[g]
        g = g[told]
        yield rows(s[told], d[told], p[told], hub[g], hub_pos[g], edge[g])
    if held is not None:
        s, d, p = (np.array([x]) for x in held)
        yield rows(s, d, p, d, p, np.ones(1, bool))


def _settled(firsts: dict[int, tuple[int, int]]):
    """The rows of _first_holders with the first holder of all partitions; seeds in one place only go."""
    names = ["doc_id", "pos", "hub", "hub_pos"]

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(4)]
            edge = batch.column(4)
            if edge.null_count < len(edge):
                at = [(h, p) if e is None else firsts.get(e) for e, h, p in zip(
                    edge.to_pylist(), cols[2].to_pylist(), cols[3].to_pylist(), strict=True)]
                hub = pa.array([None if x is None else x[0] for x in at], pa.int64())
                hub_pos = pa.array([None if x is None else x[1] for x in at], pa.int32())
                keep = hub.is_valid()
                cols = [c.filter(keep) for c in (cols[0], cols[1], hub, hub_pos)]
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


ODD = 0x9E3779B97F4A7C15
BACK = pow(ODD, -1, 1 << 64)


def stretch_keys(doc, pos, hub, hub_pos, min_words: int):
    """(key, doc) of the seeds in a row whose first holder is not the first holder of all of them.
    Rows are sorted by (doc, pos); (hub, hub_pos) tells a seed. Neighbours less than SEED words
    apart overlap, so a key stands for the words from its first to its last seed."""
    n = len(doc)
    if n < min(CHAINED):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = pos.astype(np.int64)
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    run = np.cumsum(new_doc | np.concatenate([[True], np.diff(at) >= SEED]))
    diag = at - hub_pos
    other = np.cumsum(new_doc | np.concatenate([[True], (hub[1:] != hub[:-1]) | (diag[1:] != diag[:-1])]))
    name = mix64(hub.astype(np.int64).view(U64) * U64(ODD) + hub_pos.astype(np.int64).view(U64) + U64(1))
    with np.errstate(over="ignore"):
        total = np.concatenate([[U64(0)], np.cumsum(name * np.power(U64(ODD), at.view(U64)), dtype=U64)])
        to_start = np.power(U64(BACK), at.view(U64))
    keys, docs = [], []
    for m in CHAINED:
        i = np.flatnonzero((run[m - 1:] == run[:n - m + 1]) & (other[m - 1:] != other[:n - m + 1])) if n >= m else []
        if len(i):
            keys.append(mix64((total[i + m] - total[i]) * to_start[i] + U64(m)))
            docs.append(doc[i])
    # stretches that lie in every repeat of min_words words, wherever it begins before its first seed
    size = max(SEED, min_words - SEED + 2)
    place = np.cumsum(new_doc) * (1 << 33) + at
    end = np.searchsorted(place, place + size - SEED, "right") - 1
    full = (run[end] == run) & (at[end] > at + size - 2 * SEED + 1)
    one = np.cumsum(np.concatenate([[True], (run[1:] != run[:-1]) | (other[1:] != other[:-1])])) - 1
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    known = (at[last] + SEED - at[first] >= min_words)[one] & (one[end] == one)
    i = np.flatnonzero(full & ~known)
    if len(i):
        keys.append(mix64((total[end[i] + 1] - total[i]) * to_start[i]))
        docs.append(doc[i])
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    return key[once], doc[once]


def _meet(min_words: int):
    """Rows (doc_id, pos, hub, hub_pos) sorted by (doc_id, pos) -> (doc_id, other_id, null) of pairs and
    (doc_id, null, key) of keys; a document's rows are kept until they are whole."""
    def whole(doc, pos, hub, hub_pos):
        # no chain of fragments is long enough where the seeds shared with any document lie closer together
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (np.diff(pos) > RUN_GAP)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(pos)]]) - 1
        wide = np.repeat(pos[last] - pos[first] + SEED >= LEAST * min_words, last - first + 1)
        doc, pos, hub, hub_pos = doc[wide], pos[wide], hub[wide], hub_pos[wide]
        key, holder = stretch_keys(doc, pos, hub, hub_pos, min_words)
        elsewhere = (hub != doc) | (pos - hub_pos >= min_words)
        d, h, p = doc[elsewhere], hub[elsewhere], pos[elsewhere]
        order = np.lexsort((p, h, d))
        d, h, p = d[order], h[order], p[order]
        gap = np.diff(p)
        near = np.flatnonzero((d[1:] == d[:-1]) & (h[1:] == h[:-1]) & (gap >= 1) & (gap <= RUN_GAP))
        d, h = d[near], h[near]
        if len(d):
            once = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
            d, h = d[once], h[once]
        no = np.zeros(len(key), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([d, holder])), pa.array(np.concatenate([h, no]), mask=np.arange(len(d) + len(key)) >= len(d)),
             pa.array(np.concatenate([np.zeros(len(d), np.int64), key.view(np.int64)]), mask=np.arange(len(d) + len(key)) < len(d))],
            ["doc_id", "other_id", "key"])

    def run(batches):
        kept = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(i)) for i in range(4)]
            if cols[0][0] == cols[0][-1]:
                if kept and kept[0][0][0] != cols[0][0]:
                    yield whole(*map(np.concatenate, zip(*kept, strict=True)))
                    kept = []
                kept.append(cols)
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            yield whole(*map(np.concatenate, zip(*kept, [c[:cut] for c in cols], strict=True)))
            kept = [[c[cut:] for c in cols]]
        if kept:
            yield whole(*map(np.concatenate, zip(*kept, strict=True)))
    return run


class PrefixMax:
    """Fenwick tree: largest (value, item) among positions below a bound."""

    def __init__(self, size: int):
        self.best = [(0.0, -1)] * (size + 1)

    def put(self, at: int, value: float, item: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at][0] or self.best[at][1] < 0:
                self.best[at] = (value, item)
            at += at & -at

    def below(self, at: int) -> tuple[float, int]:
        top = (0.0, -1)
        while at > 0:
            if self.best[at][1] >= 0 and (top[1] < 0 or self.best[at] > top):
                top = self.best[at]
            at -= at & -at
        return top


class Places:
    """The k-mers of a text, and where each of them occurs (ascending)."""

    def __init__(self, h: np.ndarray):
        self.h = h
        self.order = np.argsort(h, kind="stable")
        ordered = h[self.order]
        self.start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        self.kinds = ordered[self.start]
        self.count = np.diff(np.concatenate([self.start, [len(h)]]))


def fragments(h: np.ndarray, b: Places) -> tuple[np.ndarray, bool]:
    """Columns (place in a, place in b, words) of all runs of matching k-mers, and whether k-mers are frequent;
    h: the k-mers of a.

    Every occurrence in one text meets every occurrence in the other. Where that is over MATCHES
    a place, the pairs are not made: only the two ends of each run are looked up."""
    j = np.minimum(np.searchsorted(b.kinds, h), len(b.kinds) - 1)
    at = np.flatnonzero(b.kinds[j] == h)
    if not len(at):
        return np.zeros((3, 0), np.int64), False
    j = j[at]
    many = b.count[j]
    width = len(h) + 1          # key of a pair: diagonal, then place in a
    frequent = bool(many.sum() > MATCHES * (len(h) + len(b.h)))
    if frequent:
        first, last = _run_ends(at, j, len(h), b)
    else:
        k = np.repeat(np.arange(len(at)), many)
        off = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
        x, y = at[k], b.order[b.start[j][k] + off]
        key = np.sort((x - y + len(b.h)) * width + x)
        cut = np.flatnonzero(np.diff(key) != 1)
        first, last = key[np.concatenate([[0], cut + 1])], key[np.concatenate([cut, [len(key) - 1]])]
    x = first % width
    y = x - first // width + len(b.h)
    return np.stack([x, y, last - first + K]), frequent


def _run_ends(at: np.ndarray, kind: np.ndarray, size: int, b: Places) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first and of the last pairs of all runs, in the same order; at: the places in a (of
    ``size``) whose k-mer is a kind of b. A run starts where the k-mers before differ, and ends where those
    behind do: the places in b of one kind are grouped by their neighbour, so only such pairs are made."""
    kinds = len(b.kinds)
    of_a, of_b = np.full(size + 2, kinds), np.empty(len(b.h) + 2, np.int64)     # kinds: none that b has
    of_a[at + 1] = kind
    of_b[[0, -1]] = kinds + 1
    of_b[b.order + 1] = np.repeat(np.arange(kinds), b.count)
    out = []
    for side in (-1, 1):
        code = of_b[1:-1] * (kinds + 2) + of_b[1 + side:len(b.h) + 1 + side]
        order = np.argsort(code, kind="stable")
        code = code[order]
        own = kind * (kinds + 2) + of_a[at + 1 + side]
        begin, end = b.start[kind], b.start[kind] + b.count[kind]
        same, behind = np.searchsorted(code, own), np.searchsorted(code, own, "right")
        many = end - begin - (behind - same)
        k = np.repeat(np.arange(len(at)), many)
        off = begin[k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
        y = order[np.where(off < same[k], off, off + (behind - same)[k])]
        out.append(np.sort((at[k] - y + len(b.h)) * (size + 1) + at[k]))
    return out[0], out[1]


def _near(frags: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """The fragments (by place) of stretches without a gap over MAX_GAP that span ``least`` words:
    no passage crosses such a gap."""
    out, cur, end = [], [], 0
    for f in frags:
        if cur and f[0] - end > MAX_GAP:
            out += cur if end - cur[0][0] >= least else []
            cur = []
        end = max(end, f[0] + f[2]) if cur else f[0] + f[2]
        cur.append(f)
    return out + (cur if cur and end - cur[0][0] >= least else [])


def chains(frags: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of fragments, best first: later fragments lie behind in both texts
    (an overlap is taken from the later one)."""
    ends = sorted({y + n for _, y, n in frags})
    place = {y: i for i, y in enumerate(ends)}
    tree = PrefixMax(len(ends))
    # events: a fragment can follow those that end within its first K words; one of K words starts before it ends
    score, back = [0.0] * len(frags), [-1] * len(frags)
    events = sorted([(x + K, 1, i) for i, (x, _, n) in enumerate(frags)] + [(x + n, 0 if n > K else 2, i) for i, (x, y, n) in enumerate(frags)],
                    key=lambda e: (e[0], e[1]))
    done = [False] * len(frags)
    for _, kind, i in events:
        x, y, n = frags[i]
        if kind == 1:
            value, j = tree.below(bisect_left(ends, y + K))
            gain = value - GAP_COST * (x + y)
            score[i] = n + max(0.0, gain)
            back[i] = j if gain > 0 else -1
            done[i] = True
        elif done[i]:
            tree.put(place[y + n], score[i] + GAP_COST * (x + n + y + n), i)
    used, out = set(), []
    for i in sorted(range(len(frags)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(frags[i])
            i = back[i]
        if chain:
            out.append(_trimmed(chain[::-1]))
    return out


def _trimmed(chain):
    out = [chain[0]]
    for x, y, n in chain[1:]:
        px, py, pn = out[-1]
        over = max(0, px + pn - x, py + pn - y)
        if n > over:
            out.append((x + over, y + over, n - over))
    return out


# words left out in one text and in the other, and the larger of both
WAYS = [(p, q, most) for most in range(1, RESYNC + 1)
        for p, q in [(most, most), *(w for less in range(most - 1, -1, -1) for w in ((most, less), (less, most)))]]


def _run(a: list[bytes], b: list[bytes], x: int, y: int, step: int) -> int:
    """Equal words from (x, y) on."""
    most = min(len(a) - x, len(b) - y) if step > 0 else min(x, y) + 1
    n = 0
    while n < most and a[x + step * n] == b[y + step * n]:
        n += 1
    return n


def _onward(a: list[bytes], b: list[bytes], x: int, y: int, step: int):
    """The first of WAYS over the words at (x, y) that a word (if as many were changed) or two equal words follow,
    and the equal words behind it; None if there is none."""
    na, nb = (len(a) - x, len(b) - y) if step > 0 else (x + 1, y + 1)
    for p, q, most in WAYS:
        if p < na and q < nb and a[x + step * p] == b[y + step * q] and (p == q == 1 or (
                p + 1 < na and q + 1 < nb and a[x + step * (p + 1)] == b[y + step * (q + 1)])):
            return p, q, most, _run(a, b, x + step * p, y + step * q, step)
    return None


def carried_on(a: list[bytes], b: list[bytes], x: int, y: int, step: int, matched: int, size: int, identity: float, ways: dict):
    """(x, y, matched) of an end carried on from (x, y) in steps of +1 or -1: over equal words, and over up to
    RESYNC changed, added or missing words that a word (if as many were changed) or two equal words follow. The
    farthest equal word at which ``identity`` of all words, and over half of the new ones, are aligned. ``ways``
    remembers the ways of the pair, as many chains go on alike."""
    got = gone = 0
    best = (x, y, 0)
    run = _run(a, b, x, y, step)
    while True:
        x, y, got, gone = x + step * run, y + step * run, got + run, gone + run
        if got > best[2] and 2 * got > gone and matched + got >= identity * (size + gone):
            best = (x, y, got)
        at = (x, y, step)
        if at not in ways:
            ways[at] = _onward(a, b, x, y, step)
        if ways[at] is None:
            return best
        p, q, most, run = ways[at]
        if most > (matched + got) / identity - size - gone:
            return best
        x, y, gone = x + step * p, y + step * q, gone + most


def passages(chain, a: list[bytes], b: list[bytes], min_words: int, identity: float, ways: dict):
    """(start, end, other_start, other_end, matched) of the passages of a chain."""
    parts, cur = [], [chain[0]]
    for f in chain[1:]:
        px, py, pn = cur[-1]
        if max(f[0] - px - pn, f[1] - py - pn) > MAX_GAP:
            parts.append(cur)
            cur = []
        cur.append(f)
    parts.append(cur)
    while parts:
        part = parts.pop()
        x0, y0, _ = part[0]
        x1, y1 = part[-1][0] + part[-1][2], part[-1][1] + part[-1][2]
        if max(x1 - x0, y1 - y0) < LEAST * min_words:
            continue
        gaps = []
        for (px, py, pn), (x, y, _) in zip(part, part[1:], strict=False):
            m = SequenceMatcher(None, a[px + pn:x], b[py + pn:y], autojunk=False)
            gaps.append((max(x - px - pn, y - py - pn), sum(k.size for k in m.get_matching_blocks())))
        matched = sum(n for _, _, n in part) + sum(m for _, m in gaps)
        if matched >= identity * max(x1 - x0, y1 - y0):
            i, j, more = carried_on(a, b, x0 - 1, y0 - 1, -1, matched, max(x1 - x0, y1 - y0), identity, ways)
            x0, y0, matched = i + 1, j + 1, matched + more
            x1, y1, more = carried_on(a, b, x1, y1, 1, matched, max(x1 - x0, y1 - y0), identity, ways)
            matched += more
            if max(x1 - x0, y1 - y0) >= min_words:
                yield x0, x1, y0, y1, matched
        elif gaps:
            worst = max(range(len(gaps)), key=lambda k: gaps[k][0] - gaps[k][1])
            parts += [part[:worst + 1], part[worst + 1:]]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of the words, for use in this process only."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(U64)


def _fixed(frags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fragments that carried_on leaves as they are: no way over changed words is open at either end."""
    x, y, n = frags
    room = RESYNC + 2
    a, b = (np.concatenate([np.full(room, none, U64), h, np.full(room, none, U64)]) for h, none in ((a, U64(1)), (b, U64(2))))
    open_end = np.zeros(len(x), bool)
    for step, i, j in ((1, x + n + room, y + n + room), (-1, x - 1 + room, y - 1 + room)):
        same = {(p, q): a[i + step * p] == b[j + step * q] for p in range(room) for q in range(room)}
        for p, q, _ in WAYS:
            open_end |= same[p, q] if p == q == 1 else same[p, q] & same[p + 1, q + 1]
    return ~open_end


def _linked(frags: np.ndarray) -> np.ndarray:
    """Fragments that may have another one before or behind them in the same part of a chain."""
    x, y, n = frags
    cell, row = 2 * (MAX_GAP + K), 1 << 31          # a side of a cell is longer than where a neighbour can be
    starts, ends = x // cell * row + y // cell, (x + n) // cell * row + (y + n) // cell
    out = np.zeros(len(x), bool)
    for of, i, j in ((starts, x + n - K, y + n - K), (ends, x - MAX_GAP, y - MAX_GAP)):
        for p in (0, 1):
            for q in (0, 1):
                out |= np.isin((i // cell + p) * row + j // cell + q, of)
    return out


def _least_cover(frags: np.ndarray) -> np.ndarray:
    """The fewest fragments that hold all places in a that the fragments hold."""
    frags = frags[:, np.lexsort((-frags[2], frags[0]))]
    x, end = frags[0], frags[0] + frags[2]
    farther = np.concatenate([np.ones(len(x[:1]), bool), end[1:] > np.maximum.accumulate(end)[:-1]])
    frags, x, end = frags[:, farther], x[farther], end[farther]
    out, at = [], 0
    while at < len(x):
        out.append(at)
        at = max(at + 1, int(np.searchsorted(x, end[at], "right")) - 1)
    return frags[:, np.array(out, np.int64)]


def _told(frags, w, other, hashes, min_words: int, identity: float, frequent: bool):
    """The passages of a pair that are told. A place that matches several places is told once: the best chains
    come first, and a passage inside one told is left out. Where k-mers are ``frequent``, the chain with the most
    words not yet told comes next, and a passage is left out once all its words are told."""
    if frequent:        # fragments that stay alone are passages as they are, or none
        linked = _linked(frags)
        frags, linked = (part[..., linked | (frags[2] >= LEAST * min_words)] for part in (frags, linked))
        as_is = _fixed(frags, *hashes)
        alone = as_is & ~linked
        lone, frags = frags[:, alone & (frags[2] >= min_words)], frags[:, ~alone]
    found = chains(_near(sorted(zip(*frags.tolist(), strict=True)), LEAST * min_words))
    if frequent:
        cover = _least_cover(lone)
        found += [[f] for f in zip(*cover.tolist(), strict=True)]
        fixed = set(zip(*frags[:, as_is[~alone]].tolist(), strict=True)).union(c[0] for c in found[len(found) - cover.shape[1]:])
    elif len(found) > FEW:
        single = np.array([c[0] for c in found if len(c) == 1], np.int64).reshape(-1, 3).T
        fixed = set(zip(*single[:, _fixed(single, *hashes)].tolist(), strict=True))
    else:
        fixed = set()
    seen, told, ways = bytearray(len(w)), [], {}

    def tell(passage):
        x0, x1 = passage[:2]
        new = seen.find(0, x0, x1) >= 0
        if new or not (frequent or any(a <= x0 and x1 <= b for a, b in told)):
            told.append((x0, x1))
            seen[x0:x1] = b"\1" * (x1 - x0)
            yield passage

    def alone(chain):
        return len(chain) == 1 and chain[0] in fixed

    def passages_of(chain):
        if alone(chain):
            x, y, n = chain[0]
            if n >= min_words:
                yield from tell((x, x + n, y, y + n, n))
            return
        for passage in passages(chain, w, other, min_words, identity, ways):
            yield from tell(passage)

    spans = [(c[0][0], c[-1][0] + c[-1][2], c[-1][1] + c[-1][2] - c[0][1]) for c in found]
    todo = [k for k, (x0, x1, size) in enumerate(spans) if max(x1 - x0, size) >= LEAST * min_words]
    if not frequent:
        for k in todo:
            yield from passages_of(found[k])
        return
    heap = [(x0 - x1, k) for k in todo for x0, x1, _ in [spans[k]]]
    heapify(heap)
    while heap:
        new, k = heap[0]
        x0, x1, _ = spans[k]
        now = seen.count(1, x0, x1) - (x1 - x0)
        if now == 0 and alone(found[k]):
            heappop(heap)
        elif now > new:
            heapreplace(heap, (now, k))
        else:
            heappop(heap)
            yield from passages_of(found[k])


def _align(min_words: int, identity: float):
    names = ["doc_id", "other_id", "start", "end", "other_start", "other_end", "matched", "identity"]

    def run(batches):
        whole, other, theirs, their_words = b"", [], None, None
        for batch in batches:
            rows = []
            for doc, hub, t in zip(*(batch.column(i) for i in range(3)), strict=True):
                if not doc.is_valid:
                    whole, theirs = t.as_py().encode(), None
                    other = word_list(whole)
                    continue
                own = t.as_py().encode()
                w = word_list(own)
                if own == whole and doc != hub:
                    if len(w) >= max(K, min_words):
                        rows.append((doc.as_py(), hub.as_py(), 0, len(w), 0, len(w), len(w), 1.0))
                    continue
                if len(w) < K or len(other) < K:
                    continue
                if theirs is None:
                    their_words = word_hashes(other)
                    theirs = Places(shingle_hashes(their_words, K))
                words = their_words if doc == hub else word_hashes(w)
                frags, frequent = fragments(theirs.h if doc == hub else shingle_hashes(words, K), theirs)
                if doc == hub:
                    frags = frags[:, frags[0] - frags[1] >= min_words]
                for x0, x1, y0, y1, m in _told(frags, w, other, (words, their_words), min_words, identity, frequent):
                    rows.append((doc.as_py(), hub.as_py(), x0, x1, y0, y1, m, m / max(x1 - x0, y1 - y0)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)
    return run


def repeated_passages(documents: DataFrame, min_words: int = 50, identity: float = 0.8, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per passage that an earlier document holds as well (columns above)."""
    d = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.filter("doc_id is not null and text is not null")
    hashed = d.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("i"))
    classes = hashed.groupBy("h", "i").agg(F.min("doc_id").alias("other_id"), F.max("doc_id").alias("last")).filter("other_id < last")
    copies = staged(hashed.join(classes, ["h", "i"]).filter("doc_id <> other_id").select("doc_id", "other_id", "h", "i").distinct(),
                    "copies")
    one = (d.withColumn("h", F.xxhash64("text")).join(copies.select("doc_id", "h"), ["doc_id", "h"], "left_anti").select("doc_id", "text"))
    seeds = staged(one.mapInArrow(_seeds, "seed long, doc_id long, pos int"), "seeds")
    by_seed = seeds.repartitionByRange("seed", "doc_id", "pos").sortWithinPartitions("seed", "doc_id", "pos")
    held = staged(by_seed.mapInArrow(_first_holders, "doc_id long, pos int, hub long, hub_pos int, edge long"), "held-seeds")
    # at most two seeds a partition lie on its edges: their first holders, taken from all seeds, fit any task
    edges = [r.edge for r in held.filter("edge is not null").select("edge").distinct().collect()]
    firsts = (seeds.filter(F.col("seed").isin(edges)).groupBy("seed")
              .agg(F.min(F.struct("doc_id", "pos")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    firsts = {r.seed: (r.hub.doc_id, r.hub.pos) for r in firsts.collect()}
    dropped(documents.sparkSession, seeds)
    met = held.mapInArrow(_settled(firsts), "doc_id long, pos int, hub long, hub_pos int")
    by_doc = met.repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    found = staged(by_doc.mapInArrow(_meet(min_words), "doc_id long, other_id long, key long"), "meetings")
    dropped(documents.sparkSession, held)
    keys = found.filter("key is not null").select("key", "doc_id")
    holders = keys.groupBy("key").agg(F.min("doc_id").alias("other_id"), F.max("doc_id").alias("last")).filter("other_id < last")
    longer = keys.join(holders.select("key", "other_id"), "key").filter("doc_id <> other_id").select("doc_id", "other_id")
    pairs = staged(found.filter("key is null").select("doc_id", "other_id").union(longer)
                   .union(copies.select("doc_id", "other_id")).distinct(), "pairs")
    dropped(documents.sparkSession, found, copies)
    ids = pairs.select("doc_id").union(pairs.select("other_id")).distinct()
    texts = d.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    # groups of a first document and some PARTNERS of its partners; its text leads each group
    parts = pairs.groupBy("other_id").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("long").alias("parts"))
    split = parts.filter("parts > 1")     # few: a hot first document meets no other join with all pairs
    partners = (pairs.join(split, "other_id", "left").join(texts, "doc_id")
                .select("other_id", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part"), "doc_id", "text"))
    leaders = (parts.join(texts.withColumnRenamed("doc_id", "other_id"), "other_id")
               .select("other_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                       F.lit(None).cast("long").alias("doc_id"), "text"))
    both = (partners.unionByName(leaders).repartition("other_id", "part")
            .sortWithinPartitions("other_id", "part", F.col("doc_id").asc_nulls_first()).select("doc_id", "other_id", "text"))
    schema = ("doc_id long, other_id long, start int, end int, other_start int, other_end int, matched int, "
              "identity double")
    return both.mapInArrow(_align(min_words, identity), schema)
