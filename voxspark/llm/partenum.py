"""Shingle sets and PartEnum signatures, in numpy, many documents at once.

For sets of sizes a and b, |A n B| >= 0.8 |A u B| means that they differ in at
most (a + b) / 9 features.  Sizes are cut into bands whose upper ends grow by a
quarter, so similar sets lie in one band or in neighbouring ones; every set is
signed for its own band and for the next.  In a band that ends at r, sets differ
in at most k = 2r/9 features; where that is 0, similar sets are equal and need no
signature.  The feature domain is partitioned into n1 groups with 2 n1 > k, so
some groups have at most one difference, and each group into three parts, of
which every pair is enumerated: the pair without the difference is the same in
both sets, and so is its signature.

An empty pair of parts says nothing and gets no signature.  So two similar sets
share none only if each group without a difference is empty, and each group with
one difference holds its features in one part.  With e empty groups, and p groups
that are empty or have a single part filled, the sets differ then in at least
2 n1 - e - p features.  A set with 2 n1 - e - p <= k may miss a link, and its
partner knows the same of itself: both are signed once more, for another
partition of the domain, and so on; what is still open after ``ROUNDS`` turns has
its empty pairs signed too.  No link is lost, whatever the sets.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
ROUNDS = 16
CACHE_WORDS = 200_000
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]  # odd, without a pattern


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bands() -> np.ndarray:
    ends = [1]
    while ends[-1] < 1 << 33:
        ends.append(max(ends[-1] + 1, ends[-1] * 5 // 4))
    return np.array(ends, dtype=np.int64)


BANDS = _bands()  # upper ends
DIFFERENCES = 2 * BANDS // 9  # k of each band
GROUPS = DIFFERENCES // 2 + 2 + DIFFERENCES // 48  # more than k / 2; the groups beyond that spare most sets a second turn

_WORDS: dict[bytes, int] = {}


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text (A-Z lower-cased)."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    get, digest, cache = _WORDS.get, xxhash.xxh3_64_intdigest, _WORDS
    if len(cache) > CACHE_WORDS:
        cache.clear()
    hashes = []
    for w in words:
        h = get(w)
        if h is None:
            h = cache[w] = digest(w)
        hashes.append(h)
    h = np.array(hashes, dtype=np.uint64)
    n = min(len(h), SHINGLE)
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * _MULTIPLIERS[i]
    total = np.sort(mix(total))
    return total[np.diff(total, prepend=~total[0]) != 0]


def forget() -> None:
    """Drop the worker's word hashes."""
    _WORDS.clear()


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, sizes)


def _signed(flat: np.ndarray, doc: np.ndarray, docs: np.ndarray, instance: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document) of one instance per document, and which documents may need another turn.

    ``doc`` has the place in ``docs`` of every feature.
    """
    n1 = GROUPS[instance]
    offsets = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum(3 * n1, out=offsets[1:])
    spread = mix(flat + np.uint64(0x5851F42D4C957F2D * (2 * turn + 1) % (1 << 64)))
    group = ((spread >> np.uint64(32)) * n1[doc].astype(np.uint64)) >> np.uint64(32)
    part = (spread & np.uint64(0xFFFFFFFF)) * np.uint64(3) >> np.uint64(32)
    cell = offsets[doc] + (3 * group + part).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    sorted_cells = cell[order]
    first = np.flatnonzero(np.diff(sorted_cells, prepend=-1))
    sums, filled = np.zeros(offsets[-1], dtype=np.uint64), np.zeros(offsets[-1], dtype=bool)
    sums[sorted_cells[first]] = np.add.reduceat(mix(flat ^ np.uint64(0xD6E8FEB86659FD93))[order], first)
    filled[sorted_cells[first]] = True
    sums, filled = sums.reshape(-1, 3), filled.reshape(-1, 3)
    owner = np.repeat(np.arange(len(docs)), n1)
    place = np.arange(len(owner)) - offsets[owner] // 3
    tag = mix(instance[owner].astype(np.uint64) << np.uint64(48) | np.uint64(turn) << np.uint64(40) | place.astype(np.uint64))
    parts = filled.sum(axis=1)
    poor = np.bincount(owner, weights=(parts == 0) * 2 + (parts == 1), minlength=len(docs))  # e + p
    again = 2 * n1 - poor <= DIFFERENCES[instance]
    out, owners = [], []
    for left, right in ((0, 1), (0, 2), (1, 2)):
        some = filled[:, left] | filled[:, right]
        if turn == ROUNDS:  # the last turn says even that nothing is there
            some |= again[owner]
        signature = mix(mix(sums[:, left] + np.uint64(left + 1)) + sums[:, right] * np.uint64(0x2545F4914F6CDD1D) + tag + np.uint64(3 * left + right))
        out.append(signature[some])
        owners.append(docs[owner[some]])
    return np.concatenate(out), np.concatenate(owners), again


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of some sets, and which set each is of; sets that are only like their equals have none."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    band = band_of(sizes)
    out, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for ahead in (0, 1):
        at = np.flatnonzero((sizes > 0) & (DIFFERENCES[band + ahead] > 0))
        for turn in range(ROUNDS + 1):
            if not len(at):
                break
            doc = np.repeat(np.arange(len(at)), sizes[at])
            s, o, again = _signed(np.concatenate([sets[i] for i in at]), doc, at, band[at] + ahead, turn)
            out.append(s)
            owners.append(o)
            at = at[again]
    return np.concatenate(out), np.concatenate(owners)


def cell_counts(size: int) -> tuple[int, int]:
    """Cells of the two sketches of a set: for its own band and for the next."""
    band = int(band_of(np.array([size]))[0])
    return int(BANDS[band]) // 2 + 1, int(BANDS[band + 1]) // 2 + 1


def sketch(features: np.ndarray) -> bytes:
    """A byte for each of about n / 2 cells of the domain, for the set's own band and for the next.

    Cells are numbered by band, so sketches compare within two neighbouring
    bands only where both are made for the same one: the upper.
    """
    spread = mix(features + np.uint64(0x60BEE2BEE120FC15))
    high, value = spread >> np.uint64(32), ((spread & np.uint64(0xFF)) | np.uint64(1)).astype(np.float64)
    out = b""
    for cells in cell_counts(len(features)):
        at = (high * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
        out += np.bincount(at, weights=value, minlength=cells).astype(np.int64).astype(np.uint8).tobytes()
    return out


def may_link(n: int, one: bytes, m: int, other: bytes) -> bool:
    """False only if two sets surely differ in more than (n + m) / 9 features.

    Cells whose bytes differ hold at least one difference each.
    """
    if n < m:
        n, one, m, other = m, other, n, one
    if 5 * m < 4 * n:
        return False
    high, low = band_of(np.array([n, m]))
    own, after = cell_counts(n)[0], cell_counts(m)
    a = np.frombuffer(one, dtype=np.uint8, count=own)
    b = np.frombuffer(other, dtype=np.uint8, count=after[high - low], offset=0 if high == low else after[0])
    return 9 * int(np.count_nonzero(a != b)) <= n + m


def cross_pairs(root: np.ndarray, n: np.ndarray, own: np.ndarray, side: np.ndarray, sketches: np.ndarray, one_block: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different roots that may be links, of sets that have sketches for one band.

    ``own`` says which sets have that band themselves: one of a pair must.  Of
    two blocks only pairs across the sides are compared.
    """
    u, v = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    order = np.argsort(n, kind="stable")
    size = n[order]
    ends = np.searchsorted(size, size * 5 // 4, side="right")  # the last partner's size
    for k, i in enumerate(order):
        at = order[k + 1 : ends[k]]
        fits = (root[at] != root[i]) & (own[at] | own[i])
        if not one_block:
            fits &= side[at] != side[i]
        at = at[fits]
        if len(at):
            close = at[9 * (sketches[at] != sketches[i]).sum(axis=1) <= n[at] + n[i]]
            u.append(np.full(len(close), i))
            v.append(close)
    return np.concatenate(u), np.concatenate(v)


def linked(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether 100 |A n B| >= 80 |A u B|."""
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= 80 * (len(one) + len(other) - common)
