"""A run-length compressed Burrows-Wheeler index of many short strings, and matching against it."""

from __future__ import annotations

import numpy as np

#: The index is sorted to this depth; strings are shorter. Ranks by half of it tell the windows' classes.
DEPTH, HALF = 80, 40


class RunIndex:
    """Strings, in the order of their owners (ascending), each closed by a separator.

    Kept are the runs of the transform (start, and where the run's first row maps to), the owner of
    the suffix at each run's end (the sampled ends), and the classes of rows that agree on ``window``
    characters with the smallest owner of each. The suffix array itself is dropped after the build."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, owners: np.ndarray, window: int):
        n_strings = len(lengths)
        n = int(lengths.sum()) + n_strings
        ends = np.cumsum(lengths + 1) - 1  # the separators
        text = np.zeros(n, np.uint8)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = data + np.uint8(1)  # UTF-8 has no byte 0xFF
        rest = (np.repeat(ends, lengths + 1) - np.arange(n)).astype(np.int32)  # characters up to the separator
        # Ties are equal up to their separators; they go by position, as the transform needs it.
        suffixes, half = _ranks(text, rest)
        before = text[suffixes - 1]
        heads = np.flatnonzero(np.diff(before, prepend=before[0] ^ 1) != 0)
        sizes = np.diff(heads, append=n)
        by_char = np.argsort(before[heads], kind="stable")
        to = np.empty(len(heads), np.int64)
        to[by_char] = np.cumsum(sizes[by_char]) - sizes[by_char]
        self.starts, self.to = heads.astype(np.int32), to.astype(np.int32)
        owner_of = np.repeat(owners, lengths + 1)
        self.run_end_owner = owner_of[suffixes[heads + sizes - 1]]
        # Classes of rows that agree on the first `window` characters, and so on HALF and on HALF from window - HALF.
        # Rows too short for a window are classes that are never asked for.
        full = rest[suffixes] >= window
        a = half[suffixes]
        b = half[np.minimum(suffixes + (window - HALF), n - 1)]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | ~full[1:] | ~full[:-1]
        self.class_start = np.flatnonzero(new).astype(np.int32)
        self.class_owner = np.minimum.reduceat(owner_of[suffixes], self.class_start) if n else np.zeros(0, np.int64)
        # The row of each string's last window is sampled, so that matching starts there.
        row_of = np.empty(n, np.int32)
        row_of[suffixes] = np.arange(n, dtype=np.int32)
        self.last_window = row_of[ends - window]

    def step(self, rows: np.ndarray) -> np.ndarray:
        """From the rows of suffixes to the rows of the suffixes that begin one character earlier."""
        run = np.searchsorted(self.starts, rows, side="right") - 1
        return self.to[run] + (rows - self.starts[run])

    def earlier(self, lengths: np.ndarray, owners: np.ndarray, window: int) -> np.ndarray:
        """For each string, bit j is set where its ``window`` characters from j on are matched in a
        string of a smaller owner: all strings are streamed backwards in step from their last windows,
        and the row that stands for the longest match at each character tells the class's smallest owner."""
        mask = np.zeros(len(lengths), np.uint32)
        order = np.argsort(-lengths, kind="stable")  # those that are still running come first
        rows, ordered = self.last_window[order], lengths[order]
        for done in range(window, int(lengths.max(initial=0)) + 1):
            left = int(np.searchsorted(-ordered, -done, side="right"))
            rows = rows[:left] if done == window else self.step(rows[:left])
            which = order[:left]
            found = self.class_owner[np.searchsorted(self.class_start, rows, side="right") - 1] < owners[which]
            at = (lengths[which] - done).astype(np.uint32)
            mask[which[found]] |= np.uint32(1) << at[found]
        return mask


def _ranks(text: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(suffixes in order, rank by the first HALF characters)``, both up to the separator: the first five
    characters sorted as one number, then by prefix doubling. Suffixes that are equal go by position."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(5, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(5):
        key = (key << np.uint64(8)) | np.where(rest >= j, padded[j:n + j], 0).astype(np.uint64)
    order, rank = _sorted(key, 40)
    length, half = 5, rank
    while length < DEPTH:
        ahead = np.zeros(n, np.uint64)
        ahead[:n - length] = rank[length:] + 1
        ahead[rest < length] = 0
        bits = n.bit_length()
        order, rank = _sorted((rank.astype(np.uint64) << np.uint64(bits)) | ahead, 2 * bits)
        length *= 2
        if length == HALF:
            half = rank
    return order, half


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the keys and their dense ranks. Where key and position fit into 64 bits
    together they are sorted as one number, which is several times faster than an indirect sort."""
    n = len(key)
    place = n.bit_length()
    if bits + place <= 64:
        both = np.sort((key << np.uint64(place)) | np.arange(n, dtype=np.uint64))
        order = (both & np.uint64((1 << place) - 1)).astype(np.int32)
        both >>= np.uint64(place)
    else:
        order = np.argsort(key, kind="stable")
        both = key[order]
    rank = np.empty(n, np.int32)
    rank[order] = np.cumsum(np.concatenate([[False], both[1:] != both[:-1]]), dtype=np.int32)
    return order, rank
