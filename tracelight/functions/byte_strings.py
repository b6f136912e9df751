"""Strings in windows of bytes: plain runs, and mixed narrow and wide strings by a finite automaton.

A window is scanned with a few bytes of context on either side. What begins or ends beyond the
window is marked as open, so that the pieces of neighbouring windows can be put together.
"""

from __future__ import annotations

import functools

#: Bytes before and behind a window that a scan looks at.
CONTEXT = 32
#: Code units that a mixed string keeps at most.
MIXED_UNITS = 8192
NULL, PRINTABLE, HIGH, OTHER = range(4)
NONE, NARROW, WIDE = range(3)
#: What a byte does to the open string: nothing, end it, begin a narrow one with the last three
#: bytes, begin a wide one with this byte and the last but one, add this byte, add the two-byte unit
#: that this byte ends (and begin a string if none is open), add the byte before.
KEEP, END, BEGIN_NARROW, BEGIN_WIDE, ADD, ADD_UNIT, ADD_LAST = range(7)
#: By the kinds of the last four bytes (N null, P printable, H high, X other, a dot any
#: of them, h any but H, y N or H), what they do without an open string, in a narrow and in a wide
#: one. The first line that fits and says something for the open string holds; else the string ends.
STEPS = [
    (".PPP", (BEGIN_NARROW, ADD, END)),
    (".PNP", (BEGIN_WIDE, END, ADD)),
    (".NPN", (None, None, KEEP)),
    ("NPNX", (None, None, KEEP)),
    (".yhH", (ADD_UNIT, END, ADD_UNIT)),
    ("yhHh", (None, None, KEEP)),
    ("hHPN", (None, None, ADD_LAST)),
]
_FITS = {".": "NPHX", "h": "NPX", "y": "NH"}


@functools.cache
def _tables():
    """(effect, next open string) for each code of four kinds and open string; code 256 changes nothing."""
    import numpy as np

    effect, after = np.zeros((257, 3), np.uint8), np.zeros((257, 3), np.uint8)
    after[256] = range(3)
    for code in range(256):
        kinds = ["NPHX"[code >> s & 3] for s in (6, 4, 2, 0)]
        for state in range(3):
            said = (own[state] for form, own in STEPS if own[state] is not None and all(k in _FITS.get(f, f) for k, f in zip(kinds, form)))
            e = next(said, END)
            effect[code, state] = e
            after[code, state] = {END: NONE, BEGIN_NARROW: NARROW, BEGIN_WIDE: WIDE, ADD_UNIT: WIDE}.get(e, state)
    return effect, after


def byte_kinds(extended: bool):
    """The kind of each byte value; HIGH ones are high only where the byte before is neither null nor high."""
    import numpy as np

    kinds = np.full(256, HIGH if extended else OTHER, np.uint8)
    kinds[0] = NULL
    kinds[[9, 10, 13, *range(0x20, 0x7F), *(range(0xA0, 0x100) if extended else ())]] = PRINTABLE
    return kinds


def _settled(kinds, phase: int):
    """kinds with each HIGH one that can't be high as OTHER. phase: 1 if the array's first one can't."""
    import numpy as np

    high = kinds == HIGH
    if not high.any():
        return kinds
    at = np.arange(len(kinds))
    begins = high & ~np.concatenate([[False], high[:-1]])
    first = np.maximum.accumulate(np.where(begins, at, 0))
    # High and other ones alternate in a run; behind a null the first one is no high byte.
    late = np.concatenate([[phase == 1], kinds[:-1] == NULL])[first]
    return np.where(high & ((at - first + late) % 2 == 1), np.uint8(OTHER), kinds)


def _open_before(codes, length: int | None = None):
    """For each state on entry: the open string before each byte, and behind the last one.

    The bytes are cut into equal blocks, which are run side by side from every state.
    """
    import numpy as np

    _, after = _tables()
    n = len(codes)
    length = length or max(1, int(n**0.5))
    blocks = -(-n // length) if n else 0
    laid = np.full(blocks * length, 256, np.uint16)
    laid[:n] = codes
    laid = np.ascontiguousarray(laid.reshape(blocks, length).T)
    states = np.repeat(np.arange(3, dtype=np.uint8)[:, None], blocks, 1)
    seen = np.empty((length, 3, blocks), np.uint8)
    flat = after.ravel()
    for k in range(length if n else 0):
        seen[k] = states
        states = flat[laid[k] * 3 + states]
    out, ends = [], []
    for entry in range(3):
        state, chosen = entry, np.empty(blocks, np.intp)
        for b in range(blocks):
            chosen[b] = state
            state = states[state, b]
        out.append(seen[:, chosen, np.arange(blocks)].T.reshape(-1)[:n] if n else np.zeros(0, np.uint8))
        ends.append(int(state))
    return out, ends


def _strings(raw, codes, before, begin: int, min_len: int, opens: bool, last: bool):
    """(start, units, open on the left, open on the right) of the strings of bytes raw[CONTEXT:], whose codes and open strings are given.

    begin: the place of the first byte; opens, last: whether bytes can be open on the left, and whether none follow.
    """
    import numpy as np

    effect = _tables()[0].ravel()[codes.astype(np.intp) * 3 + before]
    own, one, two = raw[CONTEXT : CONTEXT + len(codes)], raw[CONTEXT - 1 : CONTEXT - 1 + len(codes)], raw[CONTEXT - 2 : CONTEXT - 2 + len(codes)]
    count = np.array([0, 0, 3, 2, 1, 1, 1], np.int64)[effect]
    starts = np.flatnonzero((effect == BEGIN_NARROW) | (effect == BEGIN_WIDE) | ((effect == ADD_UNIT) & (before == NONE)))
    ends = np.cumsum(count)
    units = np.zeros(int(ends[-1]) if len(ends) else 0, "<u2")
    for kind, parts in ((BEGIN_NARROW, (two, one, own)), (BEGIN_WIDE, (two, own)), (ADD, (own,)), (ADD_LAST, (one,))):
        at = np.flatnonzero(effect == kind)
        for k, part in enumerate(parts):
            units[ends[at] - len(parts) + k] = part[at]
    at = np.flatnonzero(effect == ADD_UNIT)
    units[ends[at] - 1] = one[at].astype(np.uint16) | own[at].astype(np.uint16) << 8
    closes = np.flatnonzero((effect == END) & (before != NONE))
    total = int(ends[-1]) if len(ends) else 0
    out = []
    cuts = [*(ends[starts] - count[starts]).tolist(), total]
    left = bool(len(before) and before[0] != NONE and opens)
    if left:
        # A string of the window before: up to the first end or beginning of another.
        out.append((begin, units[: cuts[0]], True, not last and not len(closes)))
    if len(starts):
        shift = np.where(effect[starts] == ADD_UNIT, 1, 2)
        closed = np.searchsorted(closes, starts, "right") < len(closes) if len(closes) else np.zeros(len(starts), bool)
        for k in range(len(starts)):
            open_right = not last and not closed[k]
            if open_right or cuts[k + 1] - cuts[k] >= min_len:
                out.append((begin + int(starts[k] - shift[k]), units[cuts[k] : cuts[k + 1]], False, open_right))
    return [(s, u[:MIXED_UNITS].tobytes(), a, b) for s, u, a, b in out]


#: States in which a window can be entered: whether the first byte of its context is high, times three, and the open string.
ENTRIES = 6


def mixed_pieces(context: bytes, data: bytes, begin: int, extended: bool, min_len: int, last: bool):
    """(rows, exits) of a window: rows (entries, start, units, open on the left, open on the right), and the state behind it by that before it.

    context: up to CONTEXT bytes before it, fewer at the beginning of a file. A row holds for the
    states in the bit set entries; rows that don't depend on the state come once.
    """
    import numpy as np

    raw = np.frombuffer(bytes(CONTEXT - len(context)) + context + data, np.uint8)
    values = byte_kinds(extended)[raw]
    #: Before the beginning of a file there is nothing, of the kind OTHER.
    values[: CONTEXT - len(context)] = OTHER
    # Only a run of possible high bytes through all of the context leaves open which of them are.
    unknown = len(context) == CONTEXT and bool((values[: CONTEXT - 2] == HIGH).all())
    rows, exits = [], [0] * ENTRIES
    full = (1 << ENTRIES) - 1
    for phase in (0, 1) if unknown else (0,):
        kinds = _settled(values, 1 - phase)
        wide = kinds.astype(np.uint16)
        codes = (wide[CONTEXT - 3 : -3] << 6 | wide[CONTEXT - 2 : -2] << 4 | wide[CONTEXT - 1 : -1] << 2 | wide[CONTEXT:]) if len(data) else np.zeros(0, np.uint16)
        before, ends = _open_before(codes)
        out_phase = int(kinds[len(data)] == HIGH)
        for entry, end in enumerate(ends):
            for p in (phase,) if unknown else (0, 1):
                exits[3 * p + entry] = 3 * out_phase + end
        same = (before[0] == before[1]) & (before[0] == before[2]) & (before[0] == NONE)
        cut = int(np.argmax(same)) if same.any() else len(codes)
        masks = [sum(1 << (3 * p + e) for p in ((phase,) if unknown else (0, 1))) for e in range(3)]
        for entry, mask in enumerate(masks):
            rows += [(mask, *r) for r in _strings(raw[: CONTEXT + cut], codes[:cut], before[entry][:cut], begin, min_len, True, last or cut < len(codes))]
        if cut < len(codes):
            rest = _strings(raw[cut:], codes[cut:], before[0][cut:], begin + cut, min_len, True, last)
            rows += [(sum(masks) if unknown else full, *r) for r in rest]
    return rows, exits


def mixed_strings(data: bytes, extended: bool, min_len: int) -> list[tuple[int, bytes]]:
    """(start, code units) of the mixed strings of whole bytes, in order."""
    rows, _ = mixed_pieces(b"", data, 0, extended, min_len, True)
    return [(start, units) for entries, start, units, *_ in rows if entries & 1]


def plain_pieces(context: bytes, data: bytes, behind: bytes, begin: int, min_len: int, include_tab: bool):
    """(kind, start, text, open on the left, open on the right) of printable runs: ascii, and utf16 at even and odd places.

    A wide run doesn't begin right behind a printable byte. Open pieces come whatever their length.
    """
    import numpy as np

    raw = np.frombuffer(bytes(CONTEXT - len(context)) + context + data + behind[:CONTEXT] + bytes(CONTEXT - len(behind[:CONTEXT])), np.uint8)
    good = (raw >= 0x20) & (raw <= 0x7E)
    marks = good | (raw == 9) if include_tab else good
    n = len(data)
    out = []

    def runs(mask):
        edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
        return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)

    starts, stops = runs(marks[CONTEXT : CONTEXT + n])
    left, right = bool(marks[CONTEXT - 1]), bool(marks[CONTEXT + n])
    for a, b in zip(starts.tolist(), stops.tolist()):
        opens = a == 0 and left, b == n and right
        if b - a >= min_len or any(opens):
            out.append(("ascii", begin + a, data[a:b].decode(), *opens))
    # A unit whose null is the file's padding isn't one.
    there = np.ones(len(raw), bool)
    there[CONTEXT + n + len(behind[:CONTEXT]) :] = False
    units = marks[:-1] & (raw[1:] == 0) & there[1:]
    for parity in (0, 1):
        first = (begin + parity) % 2
        lane = units[CONTEXT + first : CONTEXT + n : 2]
        starts, stops = runs(lane)
        left, right = bool(units[CONTEXT + first - 2]), bool(units[CONTEXT + first + 2 * len(lane)])
        for a, b in zip(starts.tolist(), stops.tolist()):
            opens = a == 0 and left, b == len(lane) and right
            at = first + 2 * a
            if not opens[0] and good[CONTEXT + at - 1]:
                at += 2
            stop = first + 2 * b
            if (stop - at) // 2 >= min_len or any(opens):
                out.append((f"utf16-{parity}", begin + at, data[at:stop:2].decode() if stop > at else "", *opens))
    return out
