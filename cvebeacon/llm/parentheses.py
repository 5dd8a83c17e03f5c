"""A tree as balanced parentheses, with range min-max blocks over their excess."""

from __future__ import annotations

import numpy as np

#: Parentheses per block.
BLOCK = 64


class Parentheses:
    """A sequence of balanced parentheses, 1 opens and 0 closes.

    ``excess[i]`` is the number of open ones after position i. Blocks hold its
    least and largest value, and a binary tree over the blocks those of longer
    stretches, so a search skips all stretches that cannot hold its target.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int8)
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        blocks = max(-(-len(bits) // BLOCK), 1)
        # No target is negative below the padding's value.
        padded = np.full(blocks * BLOCK, -2, np.int64)
        padded[: len(bits)] = self.excess
        padded = padded.reshape(blocks, BLOCK)
        self.low, self.high = [padded.min(axis=1)], [padded.max(axis=1)]
        while len(self.low[-1]) > 1:
            low, high = self.low[-1], self.high[-1]
            if len(low) % 2:
                low, high = np.append(low, low[-1]), np.append(high, high[-1])
            self.low.append(low.reshape(-1, 2).min(axis=1))
            self.high.append(high.reshape(-1, 2).max(axis=1))
        self.opened = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int64)])

    def rank_open(self, at: np.ndarray) -> np.ndarray:
        """Opening ones before each position."""
        return self.opened[at]

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The position that closes each opening position."""
        target = self.excess[at] - 1
        found = np.full(len(at), -1, np.int64)
        block = at // BLOCK
        self._scan(np.arange(len(at)), at + 1, block, target, found)
        rest = np.flatnonzero(found < 0)
        if len(rest):
            block = self._next_block(block[rest], target[rest])
            self._scan(rest, block * BLOCK, block, target, found)
        return found

    def _scan(self, which, start, block, target, found) -> None:
        """Look through the rest of each block, one step for all at a time."""
        which, at, end = which, start.copy(), np.minimum((block + 1) * BLOCK, len(self.excess))
        while len(which):
            live = at < end
            which, at, end = which[live], at[live], end[live]
            hit = self.excess[at] == target[which]
            found[which[hit]] = at[hit]
            which, at, end = which[~hit], at[~hit] + 1, end[~hit]

    def _holds(self, level: int, node: np.ndarray, target: np.ndarray) -> np.ndarray:
        inside = node < len(self.low[level])
        at = np.where(inside, node, 0)
        return inside & (self.low[level][at] <= target) & (target <= self.high[level][at])

    def _next_block(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first later block whose range holds the target: up the tree, then down."""
        node, level = block.copy(), np.zeros(len(block), np.int64)
        hit = np.zeros(len(block), bool)
        for k in range(len(self.low)):
            # A left child looks at its sibling; a right child goes up.
            sibling = np.where(node % 2 == 0, node + 1, -1)
            seen = ~hit & (sibling >= 0) & self._holds(k, sibling, target)
            node = np.where(seen, sibling, np.where(hit, node, node // 2))
            level = np.where(seen, k, level)
            hit |= seen
        for k in range(len(self.low) - 1, 0, -1):
            down = level == k
            left = node * 2
            first = self._holds(k - 1, left, target)
            node = np.where(down, np.where(first, left, left + 1), node)
            level = np.where(down, k - 1, level)
        return node
