"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

Leftmost-smaller (LMS) suffixes are put in order first: their LMS substrings get names by a sort of
their letters, and the string of names, which has about a third of the length, is sorted by doubling
ranks. All other suffixes are induced from them, bucket by bucket, a bucket being the suffixes with
one first byte: all that a bucket induces is placed at once, and a bucket that induces into itself
(equal bytes in a row) is taken up again until nothing new comes.
"""

from __future__ import annotations

import numpy as np

_LETTERS = 7  # letters of nine bits in one number


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number (the first byte lowest); zeros beyond the end. A view, no copy for each."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a byte array (a shorter one before those that it begins)."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    text = np.zeros(n + 1, np.uint16)  # ends with the smallest letter, which stands nowhere else
    text[:n] = data.astype(np.uint16) + 1
    small = _smaller(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    name, distinct = _named(text, lms)
    # sorted substrings are sorted suffixes if none occurs twice
    return _induced(text, small, lms[np.argsort(name) if distinct == len(lms) else _sorted_by_doubling(name)])[1:]


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (type S)."""
    # the places where two neighbours differ: what is before them in a run of equal letters is of their type
    differs = np.flatnonzero(text[:-1] != text[1:])
    return np.append(np.repeat(text[differs] < text[differs + 1], np.diff(differs, prepend=-1)), True)


def _named(text: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, rising with their order, and how many are distinct.

    Where one substring begins another, the longer one goes down after the shorter one's last letter,
    which starts to go up: so the shorter one is the larger, as if it went on with a letter above all.
    """
    length = np.append(np.diff(lms) + 1, 1)
    key = _letters(text, lms, length, 0)
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    at = 0
    while True:
        at += _LETTERS
        longer = np.maximum.reduceat(length[order], np.flatnonzero(new)) > at  # in each group of equal ones
        tied = ~(new & np.append(new[1:], True))
        places = np.flatnonzero(tied & longer[np.cumsum(new) - 1])
        if not len(places):
            break
        mine, group = order[places], np.cumsum(new)[places]
        key = _letters(text, lms[mine], length[mine], at)
        by = np.lexsort((key, group))
        order[places], key = mine[by], key[by]
        new[places[1:]] |= key[1:] != key[:-1]
    name = np.empty(len(lms), np.int64)
    name[order] = np.cumsum(new) - 1
    return name, int(np.count_nonzero(new))


def _letters(text: np.ndarray, start: np.ndarray, length: np.ndarray, at: int) -> np.ndarray:
    """The letters ``at`` and after of substrings as one number, with the largest one beyond their ends."""
    key = np.zeros(len(start), np.int64)
    for k in range(at, at + _LETTERS):
        letter = text[np.minimum(start + k, len(text) - 1)].astype(np.int64)
        key = key << 9 | np.where(k < length, letter, 511)
    return key


def _sorted_by_doubling(name: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names whose last is the smallest and stands nowhere else."""
    n = len(name)
    order = np.argsort(name)
    new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
    rank = np.empty(n, np.int64)  # the first place of a suffix's group
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    places, step = np.arange(n), 1
    while True:
        places = places[~(new & np.append(new[1:], True))[places]]
        if not len(places):
            return order
        # groups of more than one are sorted by the rank of what follows; no such suffix reaches the end
        group = order[places]
        by, keys = _sorted_pairs(rank[group], rank[np.minimum(group + step, n - 1)], n)
        group = group[by]
        order[places] = group
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        new[places] = fresh
        rank[group] = places[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        step *= 2


def _sorted_pairs(high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs of numbers below ``n``, and each pair as one number in that order."""
    bits = n.bit_length()
    keys = high << bits | low
    if 3 * bits > 63:
        by = np.argsort(keys)
        return by, keys[by]
    keys = np.sort(keys << bits | np.arange(len(keys)))  # no more than n pairs: sorted with their places, which is faster
    return keys & (1 << bits) - 1, keys >> bits


def _induced(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order."""
    n = len(text)
    counts = np.bincount(text, minlength=257)
    end = np.cumsum(counts)
    start = end - counts
    letters = np.flatnonzero(counts).tolist()
    # the letter before each place if that suffix is larger (smaller) than the next, else 0
    larger, smaller = np.zeros((2, n), np.uint16)
    larger[1:], smaller[1:] = np.where(small[:-1], 0, text[:-1]), np.where(small[:-1], text[:-1], 0)
    order = np.full(n, -1, np.int32)
    seeds = lms.astype(np.int32)
    seeds = seeds[np.argsort(text[seeds], kind="stable")]
    cut = np.searchsorted(text[seeds], np.arange(258))
    head, tail = start.copy(), end.copy()

    def before(suffixes, wanted):
        letter = wanted[suffixes]
        some = np.flatnonzero(letter)
        byte = (letter[some] - 1).astype(np.uint8)
        some = some[np.argsort(byte, kind="stable")]
        counts = np.zeros(257, np.int64)
        counts[1:] = np.bincount(byte, minlength=256)
        return suffixes[some] - 1, counts, np.arange(len(some)), np.cumsum(counts) - counts

    for c in letters:  # larger ones, from left to right
        done = start[c]
        while done < head[c]:
            done, part = head[c], order[done : head[c]]
            p, counts, place, first = before(part, larger)
            order[place + np.repeat(head - first, counts)] = p
            head += counts
        if cut[c] < cut[c + 1]:
            p, counts, place, first = before(seeds[cut[c] : cut[c + 1]], larger)
            order[place + np.repeat(head - first, counts)] = p
            head += counts
    for c in reversed(letters):  # smaller ones, from right to left
        done = end[c]
        while done > tail[c]:
            done, part = tail[c], order[tail[c] : done][::-1]
            p, counts, place, first = before(part, smaller)
            order[np.repeat(tail - 1 + first, counts) - place] = p
            tail -= counts
        p, counts, place, first = before(order[start[c] : head[c]][::-1], smaller)
        order[np.repeat(tail - 1 + first, counts) - place] = p
        tail -= counts
    order[0] = n - 1
    return order


def permuted_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place the length that its suffix has in common with the one before it in ``order``.

    Where the predecessor moves along with the place, the length is one less than at the place before, unless
    that was zero already; only the others are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    own = np.ones(n + 1, bool)
    own[1:n] = before[1:] != before[:-1] + 1
    counts = np.bincount(data, minlength=256)
    least = order[(np.cumsum(counts) - counts)[counts > 0]]  # the first suffixes of the letters: nothing in common
    own[least], own[least + 1] = True, True
    places = np.flatnonzero(own[:n] & (before >= 0))
    words, common = _words(data), np.zeros(len(places), np.int32)
    a, b, going = places, before[places].astype(np.int64), np.arange(len(places))
    while len(going):
        differ = words[a] ^ words[b]
        common[going] += np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3  # 8 if none differs
        more = np.flatnonzero(differ == 0)
        more = more[np.maximum(a[more], b[more]) + 8 < n]
        going, a, b = going[more], a[more] + 8, b[more] + 8
    # what is beyond the end counts as zeros above
    common = np.minimum(common, n - np.maximum(places, before[places]))
    ends, here = np.zeros(n, np.int32), np.arange(n, dtype=np.int32)  # where the common part ends, which never falls
    ends[places] = places + common
    return np.maximum(np.maximum.accumulate(ends) - here, 0)
