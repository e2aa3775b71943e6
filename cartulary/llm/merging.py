"""Loser trees that merge sorted sources of which more may come up on the way.

A source is an iterator of heads, in order.  A match between two heads is
played once; its loser stays at the node and only the winner's path is played
again when its head has gone out, so each item costs one match a level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

#: Bytes of a turn's digest in a path.
DIGEST = 16


class LoserTree:
    """Heads in order of `key(head)`, a tuple or a number."""

    def __init__(self, key: Callable[[Any], Any]) -> None:
        self.key = key
        self.sources: list[Iterator] = []
        self.heads: list[Any] = []
        self.keys: list[Any] = []
        self.losers: list[int] = []

    def add(self, source: Iterator) -> None:
        """One more source; none of its heads comes before what has gone out."""
        head = next(source, None)
        if head is None:
            return
        alive = [i for i, h in enumerate(self.heads) if h is not None]
        self.sources = [*(self.sources[i] for i in alive), source]
        self.heads = [*(self.heads[i] for i in alive), head]
        self.keys = [*(self.keys[i] for i in alive), self.key(head)]
        self.added(alive)
        self._build()

    def added(self, alive: list[int]) -> None:
        """Hook: the last source is new, the others are those of alive before."""

    def moved(self, i: int) -> None:
        """Hook: the head of source i has been the smallest and the next one stands in its place."""

    def smaller(self, a: int, b: int) -> bool:
        return self.keys[a] <= self.keys[b]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        if self.heads[a] is None:
            return b, a
        if self.heads[b] is None or self.smaller(a, b):
            return a, b
        return b, a

    def _build(self) -> None:
        k = len(self.heads)
        winners = [0] * k + list(range(k))
        self.losers = [0] * k
        for node in range(k - 1, 0, -1):
            winners[node], self.losers[node] = self._match(winners[2 * node], winners[2 * node + 1])
        self.first = winners[1] if k > 1 else 0

    def smallest(self) -> Any:
        """The key of the next head; None if all sources are at their ends."""
        return self.keys[self.first] if self.heads and self.heads[self.first] is not None else None

    def pop(self) -> Any:
        i, k = self.first, len(self.heads)
        out = self.heads[i]
        self.heads[i] = head = next(self.sources[i], None)
        if head is not None:
            self.keys[i] = self.key(head)
            self.moved(i)
        node = (i + k) // 2
        while node:
            i, self.losers[node] = self._match(i, self.losers[node])
            node //= 2
        self.first = i
        return out


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two paths have in common; the first `known` are."""
    most = min(len(a), len(b)) // DIGEST
    lo, step = known, 1
    while lo < most:  # in growing steps, then halving: a long shared part is compared in large pieces
        hi = min(lo + step, most)
        if a[lo * DIGEST : hi * DIGEST] == b[lo * DIGEST : hi * DIGEST]:
            lo, step = hi, 2 * step
        else:
            most, step = hi - 1, max(1, (hi - lo) // 2)
    return lo


class PathTree(LoserTree):
    """Heads (path, conv_id, shared, ...) by path and conv_id, shared being the turns in common with the source's head before.

    Each head carries the turns that it shares with what went out last.  Of two
    heads that with more is the smaller; only where they are equal the paths
    are compared, from there on.
    """

    def __init__(self) -> None:
        super().__init__(lambda head: head[:2])
        self.lcp: list[int] = []
        self.last: bytes | None = None
        #: Matches that had to look at turns.
        self.compared = 0

    def added(self, alive: list[int]) -> None:
        # What losers carry holds against the winner that beat them; here all are held against what went out last.
        self.lcp = [0 if self.last is None else shared_turns(h[0], self.last) for h in self.heads]

    def moved(self, i: int) -> None:
        self.lcp[i] = self.heads[i][2]

    def smaller(self, a: int, b: int) -> bool:
        if self.lcp[a] != self.lcp[b]:
            return self.lcp[a] > self.lcp[b]
        self.compared += 1
        x, y = self.heads[a], self.heads[b]
        both = shared_turns(x[0], y[0], self.lcp[a])
        at, to = both * DIGEST, (both + 1) * DIGEST
        first, second = (x[0][at:to], x[1]), (y[0][at:to], y[1])
        if first <= second:
            self.lcp[b] = both
            return True
        self.lcp[a] = both
        return False

    def pop(self) -> tuple:
        """The smallest head, with the turns that it shares with the one before."""
        i = self.first
        out = (*self.heads[i][:2], self.lcp[i], *self.heads[i][3:])
        self.last = out[0]
        super().pop()
        return out


class Merge:
    """All heads of the blocks in order.  blocks: (key of the first head, heads), in order of these keys; of them only those are open that reach to the present head."""

    def __init__(self, tree: LoserTree, blocks: Iterator[tuple[Any, Iterator]]) -> None:
        self.tree, self.blocks = tree, blocks
        self.waiting = next(blocks, None)

    def __iter__(self) -> Iterator[Any]:
        while True:
            now = self.tree.smallest()
            if self.waiting is not None and (now is None or self.waiting[0] <= now):
                self.tree.add(self.waiting[1])
                self.waiting = next(self.blocks, None)
            elif now is None:
                return
            else:
                yield self.tree.pop()

    def left(self) -> Iterator[Any]:
        """What has not gone out, in no order."""
        yield from [h for h in self.tree.heads if h is not None]
        for source in self.tree.sources:
            yield from source
        while self.waiting is not None:
            yield from self.waiting[1]
            self.waiting = next(self.blocks, None)
