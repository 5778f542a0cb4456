"""PartEnum signatures for sets of 64-bit features and a Jaccard threshold of 80 %.

Sizes are cut into bands [l, r].  Two sets with sizes a <= b <= r that reach
the threshold differ in at most k = (a + b) / 9 <= 2r / 9 features.  For each
band the feature domain is cut into n1 parts of n2 sub-parts.  At least
n1 - k // (k2 + 1) parts hold at most k2 differences, so in each of those the
two sets agree on some n2 - k2 of the n2 sub-parts: every such choice of
sub-parts gives a signature.  A set signs for its own band and for every
higher band that can hold a partner.

A choice of sub-parts without any feature would be shared by strangers.  If
fewer parts of a set have such a choice than are sure to agree, the set
leaves these out and misses nothing.  Else it signs once more over another
cut of the domain, and keeps empty choices only in the last of ``CUTS`` cuts.

Two linked sets share at least one signature for each part that is sure to
agree and has no empty choice, say s of them.  So with all signatures in one
global order, each set may leave out its s - 1 most frequent ones: the rarest
shared one is never among them.  This removes the signatures made of a passage
that many documents share, and misses nothing.  It asks for more parts than
k differences can spoil: a quarter more.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np

from .wordhash import mix

CUTS = 8
NUMERATOR, DENOMINATOR = 80, 100


def bands(largest: int) -> list[tuple[int, int]]:
    out, low = [], 1
    while low <= largest:
        high = max(low, low * 5 // 4 if low > 128 else low * 9 // 8)
        out.append((low, high))
        low = high + 1
    return out


def shape(k: int) -> tuple[int, int, int, int]:
    """n1, n2, k2 and the number of parts sure to agree, for a difference of up to ``k``."""
    if k <= 2:
        return 1, k + 2, k, 1
    k2, n2 = (1, 3) if k < 16 else (0, 1)
    sure = 1 + -(-k // (4 * (k2 + 1)))
    return k // (k2 + 1) + sure, n2, k2, sure


def _gather(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the features of the chosen sets, and the set (0, 1, ...) that each belongs to."""
    length = offsets[rows + 1] - offsets[rows]
    owner = np.repeat(np.arange(len(rows)), length)
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(offsets[rows], length)
    return at, owner


def _sign(features: np.ndarray, owner: np.ndarray, n: int, form: tuple[int, int, int, int], salt: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the sets they belong to, and for each set how many parts are sure to agree and have no empty choice (0 or less: it needs another cut); features are sorted within their sets."""
    n1, n2, k2, sure = form
    wide = n1 * n2
    cell = owner * wide + (((features >> np.uint64(32)) * np.uint64(wide)) >> np.uint64(32)).astype(np.int64)
    start = np.flatnonzero(np.diff(cell, prepend=-1))
    sums, used = np.zeros(n * wide, np.uint64), np.zeros(n * wide, bool)
    if len(start):
        sums[cell[start]], used[cell[start]] = np.add.reduceat(features, start), True
    sums, used = sums.reshape(n, n1, n2), used.reshape(n, n1, n2)
    part = mix(np.arange(n1, dtype=np.uint64) + np.uint64(salt))
    bare, keys, sets = np.zeros((n, n1), bool), [], []
    choices = [(np.uint64(i * 0xC2B2AE3D27D4EB4F % (1 << 64)), sums[:, :, list(c)].sum(axis=2), used[:, :, list(c)].any(axis=2)) for i, c in enumerate(combinations(range(n2), n2 - k2))]
    for _, _, filled in choices:
        bare |= ~filled
    spare = sure - bare.sum(axis=1)
    short = spare <= 0
    for i, total, filled in choices:
        keep = filled | (short & last)[:, None]
        which, where = np.nonzero(keep)
        keys.append(mix(total[which, where] ^ (part[where] + i)))
        sets.append(which)
    return np.concatenate(keys), np.concatenate(sets), spare


@dataclass
class Signed:
    """Signatures of many sets: each one's key, set and run (a set's signatures over one cut of the domain for one band), and how many of each run may be left out."""

    keys: np.ndarray
    sets: np.ndarray
    runs: np.ndarray
    spare: np.ndarray

    def needed(self, counts: np.ndarray) -> np.ndarray:
        """Which signatures to keep, given how many sets have each: a prefix in the order of counts (ties by key)."""
        order = np.lexsort((self.keys, counts, self.runs))[::-1]
        run = self.runs[order]
        start = np.flatnonzero(np.diff(run, prepend=-1))
        rank = np.arange(len(run)) - np.repeat(start, np.diff(start, append=len(run)))
        keep = np.empty(len(run), bool)
        keep[order] = rank >= self.spare[run]
        return keep


def signatures(features: np.ndarray, offsets: np.ndarray) -> Signed:
    """The signatures of all sets.

    ``features`` are sorted and distinct within each set; set i has
    features[offsets[i]:offsets[i + 1]].  Equal sets also share one signature
    of the whole set.  Empty sets have none.
    """
    sizes = np.diff(offsets)
    some = np.flatnonzero(sizes)
    none = np.zeros(0, np.int64)
    if not len(some):
        return Signed(np.zeros(0, np.uint64), none, none, none)
    whole = np.add.reduceat(mix(features ^ np.uint64(0x5851F42D4C957F2D)), offsets[some])
    keys, sets, runs, spares, n_runs = [mix(whole + sizes[some].astype(np.uint64))], [some], [np.arange(len(some))], [np.zeros(len(some), np.int64)], len(some)
    for low, high in bands(int(sizes.max()) * 5 // 4 + 1):
        k = 2 * high // 9
        rows = np.flatnonzero((sizes <= high) & (sizes * DENOMINATOR >= low * NUMERATOR)) if k else ()
        if not len(rows):
            continue
        form = shape(k)
        at, owner = _gather(offsets, rows)
        own = features[at]
        for cut in range(CUTS):
            if cut:
                own = mix(own ^ np.uint64(cut))
                own = own[np.lexsort((own, owner))]
            new, which, spare = _sign(own, owner, len(rows), form, low * 1_000_003 + cut * 7919, cut == CUTS - 1)
            keys.append(new)
            sets.append(rows[which])
            runs.append(n_runs + which)
            spares.append(np.maximum(spare - 1, 0))
            n_runs += len(rows)
            short = spare <= 0
            if not short.any():
                break
            keep = short[owner]
            own, owner = own[keep], (np.cumsum(short) - 1)[owner[keep]]
            rows = rows[short]
    return Signed(np.concatenate(keys), np.concatenate(sets), np.concatenate(runs), np.concatenate(spares))
