"""The rules of repeated passages in plain Python, a word and a sentence at a time."""

import re

END = re.compile(r"[.!?…。！？]+[\"'”’)\]]*(?=\s)")
WORD = re.compile(r"\S+")
M = 2**64


def mix(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % M
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB % M
    return h ^ (h >> 31)


def word_hash(word):
    total = sum(mix(ord(c)) * pow(0x9E3779B97F4A7C15, i, M) for i, c in enumerate(word)) % M
    return mix((total + len(word) * 0xD6E8FEB86659FD93) % M)


def plain(text):
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text).split()


def sentences(text, at, end):
    for m in END.finditer(text, at, end):
        yield at, m.end()
        at = m.end()
    if at < end:
        yield at, end


def units(text):
    """(start, end, words, what is compared) of each unit."""
    start = at = 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        line = plain(text[at:end])
        if len(line) >= 4:
            yield start, start, len(line), ("line", *line)
        held = []
        for a, b in sentences(text, at, end):
            held += plain(text[a:b])
            if len(held) < 4:
                continue
            h, done = [word_hash(w) for w in held], 0
            ends = [m.end() for m in WORD.finditer(text, start, b)]
            for i in range(3, len(held) - 4):
                if h[i] < min(h[i - 3 : i]) and h[i] <= min(h[i + 1 : i + 4]):
                    yield start, ends[i], i + 1 - done, tuple(held[done : i + 1])
                    start, done = ends[i], i + 1
            yield start, b, len(held) - done, tuple(held[done:])
            start, held = b, []
        if held:
            yield start, end, len(held), tuple(held)
            start = end
        at = end


def removed(text, earlier, least_run=16):
    """Spans that go: ``earlier`` says whether a unit has an equal one in an earlier document."""
    out, run, seen, line_left = [], [], set(), 0
    for a, b, n, what in [*units(text), (None, None, 0, None)]:
        again = what is not None and (earlier(what) or what in seen)
        seen.add(what)
        if a is not None and a == b:
            line_left = n if again else 0
        elif again or line_left:
            run.append((a, b, n, line_left > 0))
            line_left = max(0, line_left - n)
        else:
            whole = sum(x[2] for x in run) >= least_run
            out += [(x, y) for x, y, _, in_line in run if whole or in_line]
            run = []
    return out


def brute(rows, least_run=16):
    """(doc_id, text left) of rows whose ids are distinct."""
    rank = [float("inf") if d is None else d for d, _ in rows]
    least = {}
    for r, (_, t) in zip(rank, rows, strict=True):
        for *_, what in units(t or ""):
            least[what] = min(least.get(what, r), r)
    out = []
    for r, (d, t) in zip(rank, rows, strict=True):
        spans = removed(t or "", lambda what, r=r: least[what] < r, least_run)
        at, left = 0, ""
        for a, b in spans:
            left += t[at:a]
            at = b
        out.append((d, None if t is None else left + t[at:]))
    return out
