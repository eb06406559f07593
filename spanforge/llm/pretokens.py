"""Pre-token boundaries without a regular expression: classes of code points and a scan of transition functions.

A text is an array of code points; a class for each comes from a table, and a symbol for
each from its class and the two code points after it. A small automaton reads symbols: a
symbol is a function from state to state, functions compose, and composition is
associative. All functions that compositions can reach are enumerated once and numbered,
so a composition is one look-up in a table, and the states of a whole array follow from
prefix compositions taken in many lanes at once. An end mark closes each text and sends
every state to the fresh one, so one array holds many texts.

The boundaries are those of the alternatives of ``public_tokenizers.PATTERN``: a contraction
of a quote and one or two letters; a run of letters, of numbers or of other signs, each with
one space before it; blanks, of which the last before a sign stands apart.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import tiktoken

#: Classes of code points. SPACE is the blank that may open a run; END closes a text.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, END = range(7)
#: Bytes of text that are scanned at once.
BLOCK = 1 << 20
#: Code point of the end mark, beyond the last one of Unicode.
END_MARK = 0x110000

#: States: what the last code point left open.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8

#: Symbols. A blank is told by what follows it; a quote by the letters of a contraction after it.
S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_LAST_BLANK, S_LAST_SPACE, S_SHORT, S_LONG, S_END = range(9)
SYMBOLS = 9

#: Letters that make a contraction after a quote.
SHORT = ("s", "t", "m", "d")
LONG = ("re", "ve", "ll")


@cache
def class_table() -> np.ndarray:
    """Class of every code point. The library that defines the encoding is asked which are letters, numbers and blanks."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, END_MARK)]))
    table = np.full(END_MARK + 1, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        bytes_only = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(bytes_only.encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")], table[ord("'")], table[END_MARK] = SPACE, QUOTE, END
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether the code point opens a token."""
    if symbol == S_END:
        return FRESH, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_SHORT: IN_OTHERS, S_LONG: IN_OTHERS}
    if symbol in run:
        joins = state in (run[symbol], AFTER_SPACE)
        if not joins and symbol in (S_SHORT, S_LONG):
            return (ONE_LEFT if symbol == S_SHORT else TWO_LEFT), True
        return run[symbol], not joins
    if symbol == S_BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (AFTER_SPACE if symbol == S_LAST_SPACE else FRESH), True


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition of two functions, image of a state under a function, opening of a token)."""
    symbols = [tuple(_step(q, s)[0] for q in range(STATES)) for s in range(SYMBOLS)]
    number = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(STATES)), *symbols]))}
    todo = list(number)
    while todo:
        f = todo.pop()
        for g in symbols:
            h = tuple(g[q] for q in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    functions = list(number)
    then = np.array([[number[tuple(g[q] for q in f)] for g in functions] for f in functions], dtype=np.uint16)
    opens = np.array([[_step(q, s)[1] for s in range(SYMBOLS)] for q in range(STATES)])
    return np.array([number[f] for f in symbols], dtype=np.uint16), then, np.array(functions, dtype=np.uint8), opens


def _prefixes(functions: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Composition of all functions up to and with each place, by lanes: inside the lanes, over their totals, then together."""
    n = len(functions)
    if n <= 64:
        out = functions.copy()
        for i in range(1, n):
            out[i] = then[out[i - 1], out[i]]
        return out
    steps = 64 if n < 1 << 16 else 256
    lanes = -(-n // steps)
    held = np.zeros(lanes * steps, dtype=np.uint16)  # function 0 is the identity
    held[:n] = functions
    held = np.ascontiguousarray(held.reshape(lanes, steps).T)
    for i in range(1, steps):
        held[i] = then[held[i - 1], held[i]]
    before = np.zeros(lanes, dtype=np.uint16)
    before[1:] = _prefixes(held[-1], then)[:-1]
    return then[before[None, :], held].T.reshape(-1)[:n]


def symbols_of(points: np.ndarray) -> np.ndarray:
    """Symbol of each code point; those past the array count as end marks."""
    kind = class_table()[points]
    after = np.append(kind[1:], END)
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_BLANK, S_OTHER, S_END], dtype=np.uint8)[kind]
    blank = (kind == BLANK) | (kind == SPACE)
    last = blank & (after != BLANK) & (after != SPACE) & (after != END)
    out[last] = S_LAST_BLANK
    out[last & (kind == SPACE)] = S_LAST_SPACE
    quotes = np.flatnonzero(kind == QUOTE)
    if len(quotes):
        padded = np.append(points, [END_MARK, END_MARK])
        one, two = padded[quotes + 1], padded[quotes + 2]
        out[quotes[np.isin(one, [ord(c) for c in SHORT])]] = S_SHORT
        for first, second in LONG:
            out[quotes[(one == ord(first)) & (two == ord(second))]] = S_LONG
    return out


def openings(points: np.ndarray, state: int = FRESH, ahead: int = 0) -> tuple[np.ndarray, int]:
    """Which code points open a token (or are end marks), and the state behind them.

    ``state`` is the one that the code points before left; the last ``ahead`` code points
    are only looked at, as what follows.
    """
    of_symbol, then, functions, opens = automaton()
    symbols = symbols_of(points)[: len(points) - ahead]
    if not len(symbols):
        return np.empty(0, dtype=bool), state
    after = functions[_prefixes(of_symbol[symbols], then), state]
    before = np.append(np.uint8(state), after[:-1])
    return opens[before, symbols], int(after[-1])


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of well-formed UTF-8 and the byte that each starts at."""
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[starts].astype(np.uint32)
    if len(starts) == len(raw):
        return lead, starts
    size = np.diff(np.append(starts, len(raw)))
    out = lead & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], dtype=np.uint32)[size]
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        out[longer] = out[longer] << 6 | (raw[starts[longer] + k] & 0x3F)
    return out, starts


def _cut(raw: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where a code point starts, or the end."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(raw))


def long_openings(raw: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Bytes at which the pre-tokens of one UTF-8 text start; blocks of the text pass their last state on."""
    out, at, state = [], 0, FRESH
    while at < len(raw):
        end = _cut(raw, at + block)
        seen = _cut(raw, _cut(raw, end + 1) + 1) if end < len(raw) else end
        points, starts = code_points(raw[at:seen])
        ahead = int(np.count_nonzero(starts >= end - at))
        flags, state = openings(points, state, ahead)
        out.append(starts[: len(flags)][flags] + at)
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def text_openings(raws: list[np.ndarray]) -> list[np.ndarray]:
    """For each UTF-8 text the bytes at which its pre-tokens start; texts of the list go through one scan."""
    if not raws:
        return []
    read = [code_points(raw) for raw in raws]
    mark = np.array([END_MARK], dtype=np.uint32)
    flags, _ = openings(np.concatenate([x for points, _ in read for x in (points, mark)]))
    out, at = [], 0
    for points, starts in read:
        out.append(starts[flags[at : at + len(points)]])
        at += len(points) + 1
    return out
