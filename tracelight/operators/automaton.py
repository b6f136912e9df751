"""Many patterns looked for at once: a suffix automaton of all of them in flat arrays.

A state is a row of a table of next states, one column for each class of bytes, so that a step is
one look-up. Texts are laid side by side in lanes of equal length, which begin a pattern's length
early, and all lanes take a step together; the time depends on the bytes, not on the patterns.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

#: Entries of one automaton's table; more patterns are shared out over several.
MAX_CELLS = 16 << 20
#: Bytes that are scanned at once.
BATCH_BYTES = 4 << 20
#: Bytes of a lane, at least.
LANE = 1024


@dataclass
class Automaton:
    """classes: of byte values; step: the next state by state and class; ends: the pattern that ends in a state, or -1;
    shorter: the longest suffix of a state in which another pattern ends, or 0; longest: of the patterns."""

    classes: object
    step: object
    ends: object
    shorter: object
    longest: int

    def patterns_at(self, state: int) -> list[int]:
        out = []
        while state:
            if self.ends[state] >= 0:
                out.append(int(self.ends[state]))
            state = self.shorter[state]
        return out


def build(patterns: list[tuple[int, bytes]]) -> Automaton:
    """The automaton of numbered patterns, which are distinct and not empty. Class 0 is that of bytes in no pattern."""
    import numpy as np

    used = sorted(set(b"".join(p for _, p in patterns)))
    classes = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
    classes[used] = range(1, len(used) + 1)
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for number, pattern in patterns:
        state = 0
        for c in classes[list(pattern)].tolist():
            if c not in children[state]:
                children[state][c] = len(children)
                children.append({})
                ends.append(-1)
            state = children[state][c]
        ends[state] = number
    step = np.zeros((len(children), len(used) + 1), np.int32)
    shorter, fail = np.zeros(len(children), np.int32), [0] * len(children)
    queue = deque([0])
    while queue:
        state = queue.popleft()
        back = fail[state]
        if state:
            step[state] = step[back]
            shorter[state] = back if ends[back] >= 0 else shorter[back]
        for c, child in children[state].items():
            fail[child] = int(step[back, c]) if state else 0
            step[state, c] = child
            queue.append(child)
    return Automaton(classes, step, np.array(ends, np.int32), shorter, max(len(p) for _, p in patterns))


def automata(patterns: list[bytes], max_cells: int = MAX_CELLS) -> list[Automaton]:
    """One automaton for all patterns, numbered by their places, or several if its table were too large."""
    out, own, size = [], [], 0
    width = 1 + len(set(b"".join(patterns)))
    for number, p in sorted(enumerate(patterns), key=lambda x: x[1]):
        if own and (size + len(p) + 1) * width > max_cells:
            out.append(build(own))
            own, size = [], 0
        own.append((number, p))
        size += len(p)
    return [*out, build(own)] if own else out


def found_in(tool: Automaton, texts: list[bytes]) -> set[tuple[int, int]]:
    """(text, pattern) for each pattern that is a part of a text."""
    import numpy as np

    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    n = int(ends[-1]) if len(ends) else 0
    if not n:
        return set()
    kinds = tool.classes[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    # Between texts stands a byte of no pattern.
    kinds[ends - 1] = 0
    early = tool.longest - 1
    length = max(LANE, 4 * early, int(n**0.5))
    lanes = -(-n // length)
    padded = np.zeros(early + lanes * length, kinds.dtype)
    padded[early : early + n] = kinds
    laid = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, early + length)[::length].T)
    flat, width, ending = tool.step.ravel(), tool.step.shape[1], (tool.ends >= 0) | (tool.shorter > 0)
    states, begins = np.zeros(lanes, np.int32), np.arange(lanes, dtype=np.int64) * length - early
    seen = []
    for k in range(early + length):
        states = flat[states * np.int32(width) + laid[k]] if tool.step.size < 1 << 31 else flat[states.astype(np.int64) * width + laid[k]]
        at = np.flatnonzero(ending[states])
        if len(at):
            seen.append(np.searchsorted(ends, begins[at] + k, "right") << 32 | states[at].astype(np.int64))
    known: dict[int, list[int]] = {}
    out = set()
    for key in np.unique(np.concatenate(seen)).tolist() if seen else ():
        state = key & 0xFFFFFFFF
        if state not in known:
            known[state] = tool.patterns_at(state)
        out.update((key >> 32, p) for p in known[state])
    return out


def batches_of(texts: list[bytes], most: int = BATCH_BYTES):
    """(first place, texts) of slices of texts that are scanned at once."""
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= most:
            size += len(texts[stop])
            stop += 1
        yield at, texts[at:stop]
        at = stop
