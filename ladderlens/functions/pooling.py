"""Pooling of neighbouring blocks, and taut strings: monotone and piecewise constant fits of a vector."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Block:
    """Neighbouring ranks with one level: their values with weights, and a linear term of the level in the loss."""

    at: int
    to: int
    y: np.ndarray
    w: np.ndarray
    linear: float = 0.0
    level: float = field(default=0.0)


class Squares:
    """sum w (y - level)^2: a block is as good as one value, its mean, with all of its weight."""

    def joined(self, a: Block, b: Block) -> Block:
        w = a.w[0] + b.w[0]
        return Block(a.at, b.to, np.array([(a.w[0] * a.y[0] + b.w[0] * b.y[0]) / w]), np.array([w]), a.linear + b.linear)

    def level(self, block: Block) -> float:
        return float(block.y[0] - block.linear / (2 * block.w[0]))


@dataclass
class Huber:
    """sum w huber(y - level), which is x^2 up to the width and a line beyond; a block keeps its values in order."""

    width: float = 1.0

    def joined(self, a: Block, b: Block) -> Block:
        place = np.searchsorted(a.y, b.y, side="right")
        return Block(a.at, b.to, np.insert(a.y, place, b.y), np.insert(a.w, place, b.w), a.linear + b.linear)

    def slope(self, block: Block, level: float) -> float:
        """Derivative of the loss; it never decreases."""
        return float((2 * block.w * np.clip(level - block.y, -self.width, self.width)).sum() + block.linear)

    def level(self, block: Block) -> float:
        """The least level of least loss.

        The derivative is a line between the values moved by the width, so it is
        0 on one of these stretches; where the linear term outweighs all values,
        the loss falls without end, and the outermost such place is taken.
        """
        ends = np.sort(np.concatenate([block.y - self.width, block.y + self.width]))
        low, high = 0, len(ends) - 1
        while low < high:  # the first end at which the derivative is 0 or more
            mid = (low + high) // 2
            low, high = (low, mid) if self.slope(block, ends[mid]) >= 0 else (mid + 1, high)
        if low == 0:
            return float(ends[0])
        a, b = float(ends[low - 1]), float(ends[low])
        at_a, at_b = self.slope(block, a), self.slope(block, b)
        return b if at_b <= at_a or at_b < 0 else a - at_a * (b - a) / (at_b - at_a)


def pool(blocks: list[Block], loss: Squares | Huber) -> list[Block]:
    """Blocks joined with their neighbours until levels increase; the same whichever neighbours were joined before."""
    stack: list[Block] = []
    for block in blocks:
        block.level = loss.level(block)
        stack.append(block)
        while len(stack) > 1 and stack[-2].level >= stack[-1].level:
            b, a = stack.pop(), stack.pop()
            both = loss.joined(a, b)
            both.level = loss.level(both)
            stack.append(both)
    return stack


def most_penalty(y: np.ndarray, w: np.ndarray) -> float:
    """The penalty from which on the fused fit is the mean."""
    y, w = np.asarray(y, float), np.asarray(w, float)
    return float(np.abs(np.cumsum(w * (y - np.average(y, weights=w)))[:-1]).max(initial=0.0))


def fused(y: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """x with the least sum w (y - x)^2 / 2 + penalty * sum |x[i + 1] - x[i]|.

    The running sums of w x, over those of w, are the shortest way through a
    tube around the running sums of w y, of ``penalty`` to each side and closed
    at both ends; x is its slope.  From the last corner of the way, the roof and
    the floor of the tube are each kept as the corners that a string drawn along
    it would touch; where the two strings would cross, the way has a corner.
    """
    y, w = np.asarray(y, float), np.asarray(w, float)
    t, s = np.append(0.0, np.cumsum(w)), np.append(0.0, np.cumsum(w * y))
    n = len(y)
    start = (0, 0.0)
    roof: deque[tuple[int, float]] = deque()
    floor: deque[tuple[int, float]] = deque()
    out = np.zeros(n)

    def slope(a: tuple[int, float], b: tuple[int, float]) -> float:
        return (b[1] - a[1]) / (t[b[0]] - t[a[0]])

    def draw(side: deque[tuple[int, float]], point: tuple[int, float], sign: float) -> None:
        """Pull a string to a new point: slopes rise along the roof (sign 1) and fall along the floor (-1)."""
        while side and sign * slope(side[-2] if len(side) > 1 else start, side[-1]) >= sign * slope(side[-1], point):
            side.pop()
        side.append(point)

    for i in range(1, n + 1):
        room = penalty if i < n else 0.0
        for side, other, sign in ((roof, floor, 1.0), (floor, roof, -1.0)):
            point = (i, s[i] + sign * room)
            draw(side, point, sign)
            while len(side) == 1 and other and other[0][0] < i and sign * slope(start, point) < sign * slope(start, other[0]):
                corner = other.popleft()
                out[start[0] : corner[0]] = slope(start, corner)
                start = corner
    if n:
        out[start[0] :] = slope(start, (n, s[n]))
    return out
