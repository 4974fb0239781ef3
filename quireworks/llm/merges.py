"""Byte-pair merges shared by the token operators: plain merging, and checks built on it.

A vocabulary is seen as `rank(left, right)`: the priority of merging two adjacent symbols, lowest
first, or None where they don't merge. Ties go to the leftmost pair.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

Rank = Callable[[str, str], "float | None"]

#: Entries of a worker's caches; a full cache is emptied. Texts of more than LONG characters aren't
#: kept, so memory stays bounded whatever is read.
CACHE = 600_000
LONG = 64


def merge(symbols: Sequence[str], rank: Rank, made: list | None = None) -> list[str]:
    """The symbols after all merges, in the order of their priority; `made` gets each merge.

    A heap over a linked list: n log n, so that a text without any break is no problem.
    """
    n = len(symbols)
    if n < 2:
        return list(symbols)
    text: list[str | None] = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := rank(text[i], text[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if text[i] != left or j < 0 or text[j] != right or text[i] is None:
            continue
        text[i], text[j] = left + right, None
        if made is not None:
            made.append((left, right))
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := rank(text[a], text[b])) is not None:
                heapq.heappush(heap, (r, a, text[a], text[b]))
    return [t for t in text if t is not None]


def last_merges(tokens: dict[str, Sequence[str]], rank: Rank) -> dict[str, tuple[str, str, float] | None]:
    """For each token that merging its own symbols gives: the last of these merges and its rank, or
    None for a single symbol. Other tokens never occur in an encoding and are left out."""
    out: dict[str, tuple[str, str, float] | None] = {}
    for token, symbols in tokens.items():
        made: list[tuple[str, str]] = []
        if len(merge(symbols, rank, made)) == 1:
            out[token] = (*made[-1], rank(*made[-1])) if made else None
    return out


def compatible(left: str, right: str, last: dict[str, tuple[str, str, float] | None], rank: Rank) -> bool:
    """Whether merging the symbols of two tokens gives just these two again.

    Takes the merges of both back, latest first. Each step shows the two symbols that faced each
    other for a while; had they a merge of their own that was due before the one taken back, the
    border would not have held.
    """
    due = float("inf")
    ties = False
    while True:
        across = rank(left, right)
        if across is not None and (across < due or ties and across == due):
            return False
        a, b = last[left], last[right]
        if a is None and b is None:
            return True
        if b is None or a is not None and a[2] > b[2]:
            left, due, ties = a[1], a[2], False  # of equal merges the left one comes first
        else:
            right, due, ties = b[0], b[2], True


class Memo(dict):
    """A bounded cache: computes what is missing, and starts afresh when full."""

    def __init__(self, make: Callable, most: int = CACHE):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self.make(key)
        if not isinstance(key, str) or len(key) <= LONG:
            self[key] = value
        return value
