"""Where the pieces of a text begin, found by a deterministic transducer over character classes.

Byte-level tokenizers cut a text into pieces before they merge: contractions, runs of letters, of
numbers or of other signs, each with at most one space before it, and white space, whose last
character goes to what follows. Written as a transducer, each state says which piece is open, and
each transition which of the last characters turn out to begin a piece (bit 0: the one just read,
bit 1: the one before it).

A long text needs no sequential walk: it is dealt to lanes of equal length, each lane computes the
map from every entry state to its exit state, an inclusive scan composes these maps in log2(lanes)
steps, and with the entry states known a second pass emits the marks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import regex

from timeweave.llm.common import STEP_CHARS

#: Classes of characters: letters that can stand in a contraction are kept apart. END stands
#: between two texts.
LETTER, NUMBER, SPACE, BLANK, SIGN, QUOTE, STMD, R, V, E, L, END = range(12)
#: States: the piece that is open, and what of it matters for the next character.
START, WORD, NUM, SIGNS, SP, BL, SP_RUN, BL_RUN, QU, QU_R, QU_V, QU_L, DONE = range(13)
N_CLASSES, N_STATES, LANE = 12, 13, 128
LETTERS = {LETTER, STMD, R, V, E, L}


def fresh(kind: int) -> int:
    """The state after a piece begins with a character of this class."""
    return WORD if kind in LETTERS else {NUMBER: NUM, SPACE: SP, BLANK: BL, SIGN: SIGNS, QUOTE: QU}[kind]


def step(state: int, kind: int) -> tuple[int, int]:
    if kind == END:
        return (START, 2 if state in (QU_R, QU_V, QU_L) else 0)
    begin = (fresh(kind), 1)
    white, word = kind in (SPACE, BLANK), kind in LETTERS
    if state == WORD:
        return (WORD, 0) if word else begin
    if state == NUM:
        return (NUM, 0) if kind == NUMBER else begin
    if state == SIGNS:
        return (SIGNS, 0) if kind in (SIGN, QUOTE) else begin
    if state in (SP, BL, SP_RUN, BL_RUN):
        if white:
            return (SP_RUN if kind == SPACE else BL_RUN, 0)
        last = 2 if state in (SP_RUN, BL_RUN) else 0  # a run gives up its last character
        if state in (BL, BL_RUN):
            return (fresh(kind), last | 1)
        return (SIGNS if kind == QUOTE else fresh(kind), last)  # a space joins what follows
    if state == QU:
        if kind in (STMD, R, V, L):
            return ({STMD: DONE, R: QU_R, V: QU_V, L: QU_L}[kind], 0)
        return (SIGNS, 0) if kind in (SIGN, QUOTE) else begin
    if state in (QU_R, QU_V, QU_L):
        if kind == (L if state == QU_L else E):
            return (DONE, 0)
        return (WORD, 2) if word else (fresh(kind), 2 | 1)
    return begin  # START, DONE


@cache
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks, both indexed by class * N_STATES + state. One class more, for
    padding, leaves each state as it is."""
    both = np.array([[step(s, k) for s in range(N_STATES)] for k in range(N_CLASSES)] + [[(s, 0) for s in range(N_STATES)]], np.uint8)
    return both[..., 0].ravel().copy(), both[..., 1].ravel().copy()


@cache
def four_steps() -> np.ndarray:
    """The maps of all four-character words over the classes, indexed by word * N_STATES + state."""
    one = transducer()[0].reshape(-1, N_STATES)
    two = one[np.arange(len(one))[None, :, None], one[:, None, :]].reshape(-1, N_STATES)
    return two[np.arange(len(two))[None, :, None], two[:, None, :]].ravel()


@cache
def classes() -> np.ndarray:
    """The class of every code point as the tokenizers library has it.

    Its Unicode tables can be older than those of the regex module: letters, numbers and white
    space that it does not know yet are signs to it, and so stay in one piece with a sign.
    """
    from tokenizers import pre_tokenizers

    table = np.full(0x110000, SIGN, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        for m in regex.finditer(f"{pattern}+", everything):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[0xD800:0xE000] = SIGN
    known = np.flatnonzero(table != SIGN)
    probe = "".join(f"{chr(c)}#" for c in known)
    cuts = {a for _, (a, _) in pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False).pre_tokenize_str(probe)}
    for i, c in enumerate(known):
        if 2 * i + 1 not in cuts and chr(c) != " ":
            table[c] = SIGN
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    for c in "stmd":
        table[ord(c)] = STMD
    table[ord("r")], table[ord("v")], table[ord("e")], table[ord("l")] = R, V, E, L
    return table


def scan(kinds: np.ndarray, state: int = START) -> tuple[np.ndarray, int]:
    """The states before each character, from ``state`` before the first, and the last state."""
    n, one, four = len(kinds), transducer()[0], four_steps()
    lanes = max(1, -(-n // LANE))
    padded = np.full(lanes * LANE, N_CLASSES, np.uint8)
    padded[:n] = kinds
    quads = padded.reshape(-1, 4).astype(np.intp)
    words = quads[:, 0]
    for j in (1, 2, 3):
        words = words * (N_CLASSES + 1) + quads[:, j]
    rows = np.ascontiguousarray((words * N_STATES).reshape(lanes, LANE // 4).T)  # one column a lane
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], lanes, 1)
    for row in rows:
        maps = four[maps + row]
    shift = 1
    while shift < lanes:  # inclusive scan: each map after all maps before it
        maps[:, shift:] = np.take_along_axis(maps[:, shift:], maps[:, :-shift].astype(np.intp), 0)
        shift *= 2
    entry = np.empty(lanes, np.uint8)
    entry[0], entry[1:] = state, maps[state, :-1]
    at = np.empty((LANE // 4, lanes), np.uint8)
    for j, row in enumerate(rows):
        at[j] = entry
        entry = four[entry + row]
    before = np.empty((len(quads), 4), np.uint8)
    before[:, 0] = at.T.ravel()
    for j in range(3):
        before[:, j + 1] = one[quads[:, j] * N_STATES + before[:, j]]
    return before.ravel()[:n], int(maps[state, -1])


def marks_of(kinds: np.ndarray, state: int) -> tuple[np.ndarray, bool, int]:
    """Which characters begin a piece, whether the one before the first does, and the last state."""
    before, state = scan(kinds, state)
    mark = transducer()[1][kinds.astype(np.uint16) * N_STATES + before]
    begins = (mark & 1).astype(bool)
    begins[:-1] |= (mark[1:] & 2).astype(bool)
    return begins, bool(mark[0] & 2), state


def cut(texts: list[str]) -> Iterator[list[str]]:
    """The pieces of each text. Texts are walked together up to a step's size, with END after
    each; a longer one is walked in steps that hand their state on."""
    group: list[str] = []
    size = 0
    for text in texts:
        if size and size + len(text) > STEP_CHARS:
            yield from _cut(group, size)
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield from _cut(group, size)


def _cut(group: list[str], size: int) -> Iterator[list[str]]:
    joined = "\0".join(group) + "\0"
    ends = np.cumsum([len(t) + 1 for t in group]) - 1
    begins, state = np.empty(size, bool), START
    for at in range(0, size, STEP_CHARS):
        part = joined[at : at + STEP_CHARS]
        kinds = classes()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        here = ends[(ends >= at) & (ends < at + len(part))] - at
        kinds[here] = END
        begins[at : at + len(part)], earlier, state = marks_of(kinds, state)
        if earlier:
            begins[at - 1] = True
    begins[ends] = True  # so that each text's last piece ends there
    starts = np.flatnonzero(begins)
    where = np.searchsorted(starts, ends).tolist()
    starts = starts.tolist()
    first = 0
    for last in where:
        own = starts[first : last + 1]
        yield [joined[a:b] for a, b in zip(own, own[1:])]
        first = last + 1
