"""Finite machines over arrays of symbols, run in chunks whose state-transition functions are composed by a prefix scan."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import numpy as np

CHUNK = 256
#: machines of up to so many states have their chunks' functions written out in full
SMALL = 32


class Machine:
    """A deterministic machine, compiled from a step function to a table.

    ``step(state, symbol)`` gives the next state; states are any hashable values, numbered as they are
    met from ``start``; symbols are numbers below ``symbols``.
    """

    def __init__(self, start: Hashable, symbols: int, step: Callable[[Hashable, int], Hashable]) -> None:
        self.states: list[Hashable] = [start]
        number, rows = {start: 0}, []
        for state in self.states:  # grows while it is walked
            row = np.empty(symbols, np.int32)
            for s in range(symbols):
                to = step(state, s)
                if to not in number:
                    number[to] = len(self.states)
                    self.states.append(to)
                row[s] = number[to]
            rows.append(row)
        self.symbols, self.size = symbols, len(self.states)
        #: next state by symbol and state
        self.to = np.ascontiguousarray(np.stack(rows, axis=1))
        #: symbols after which the state is the same, whatever it was before
        self.resets = (self.to == self.to[:, :1]).all(axis=1)

    def run(self, symbols: np.ndarray, backward: bool = False, chunk: int = CHUNK) -> np.ndarray:
        """The state after each symbol; ``backward`` reads from the last one to the first."""
        n = len(symbols)
        if not n:
            return np.empty(0, np.int32)
        if backward:
            symbols = symbols[::-1]
        lanes = -(-n // chunk)
        padded = np.zeros(lanes * chunk, np.int32)
        padded[:n] = symbols
        columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T) * self.size
        flat = self.to.ravel()
        state = self._starts(columns, flat)
        out = np.empty(columns.shape, np.int32)
        for t, column in enumerate(columns):
            state = flat[column + state]
            out[t] = state
        out = out.T.ravel()[:n]
        return out[::-1] if backward else out

    def _starts(self, columns: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The state before each chunk: the chunks' functions, composed from the left."""
        lanes = columns.shape[1]
        if self.size <= SMALL:
            function = np.tile(np.arange(self.size, dtype=np.int32), (lanes, 1))
            for column in columns:
                function = flat[column[:, None] + function]
            width = 1  # after the step of width w each function covers the 2w chunks that end with its own
            while width < lanes:
                later = np.take_along_axis(function[width:], function[:-width], axis=1)
                function = np.concatenate((function[:width], later))
                width *= 2
            return np.concatenate((np.zeros(1, np.int32), function[:-1, 0]))
        # a chunk with a reset in it has a constant function, found from any state
        end = np.zeros(lanes, np.int32)
        for column in columns:
            end = flat[column + end]
        constant = np.zeros(lanes, bool)
        for column in columns:
            constant |= self.resets[column // self.size]
        open_ = np.flatnonzero(~constant)
        starts = np.concatenate((np.zeros(1, np.int32), end[:-1]))
        for a in range(0, len(open_), 256):
            part = open_[a : a + 256]
            function = np.tile(np.arange(self.size, dtype=np.int32), (len(part), 1))
            for column in columns:
                function = flat[column[part][:, None] + function]
            for lane, f in zip(part.tolist(), function):
                if lane + 1 < lanes:
                    starts[lane + 1] = f[starts[lane]]
        return starts
