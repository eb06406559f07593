"""Distinct sampled segmentations of a text: Gumbel top-k over the lattice of a piece vocabulary.

A segmentation's probability is the normalised product of its pieces' weights; a piece's
weight falls with its merge rank (rank + 3) ** -alpha. Backward sums over the lattice make
every choice at a node an exact conditional probability. Perturbed A-star search then
walks the tree of choices: a node's perturbed score is the greatest Gumbel score of all
segmentations below it, a chosen child inherits it, and its siblings as a group get a
Gumbel cut off at it. The best group of the frontier is opened next, so whole
segmentations come in falling order of their perturbed scores: a sample without
replacement. With the next score kappa as threshold, a segmentation of probability p has
the inclusion score 1 - exp(-p * exp(-kappa)); it is given as its logarithm.

No piece spans the start of a blank run (a vocabulary where one does is refused), so the
lattice of a text is a chain of lattices of segments (a run of blanks and what follows
it). Segments are told by 64-bit hashes, built once and kept in a bounded table; all
segments of a block of texts are walked together. Every sample is checked: ``round_trip``
says by a 64-bit hash that its pieces spell the text, where the vocabulary's sign for a blank counts as one.

Random numbers are hashes of (seed, row key, sample, segment, step) and of nothing else.

Defined results: a null or empty text has one segmentation, empty, with probability 1 and
inclusion 1 (log 0.0); fewer than k segmentations give all of them; repeated rows give the
same samples, as the key is the doc_id; equal scores keep the order in which they came;
any character, U+0000 included, is a piece or its bytes; a text of any length is one
lattice, in memory in proportion to it; an empty table gives no rows; only ``doc_id`` and
``text`` are read, so extra columns with clashing names change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from spanforge.llm import bpe
from spanforge.llm.storage import with_clear_names
from spanforge.llm.words import mixed, powers

BLANK = "▁"
#: Texts walked together hold about so many characters.
BLOCK_CHARS = 1_000_000
#: Choices for which a table of lattices has room, per node; a text's own may need more.
CHOICES = 3
#: A group further than this below another cannot win: a 53-bit uniform bounds a Gumbel to (-3.7, 37).
HOPELESS = 45.0
SAMPLES = "doc_id long, sample int, n_pieces long, log_prob double, gumbel double, log_inclusion double, round_trip boolean, ids array<int>"
_G = np.uint64(0x9E3779B97F4A7C15)
_loaded: dict = {}


class Vocabulary:
    """Pieces with their log weights; bytes stand in for characters without a piece."""

    def __init__(self, pieces: list[str], ranks: list[float], byte_ids: dict[int, int], alpha: float):
        byte_set = set(byte_ids.values())
        names = {p: i for i, p in enumerate(pieces) if p and i not in byte_set}
        if any(BLANK in p.lstrip(BLANK) for p in names):
            raise ValueError("a piece spans the start of a blank run")
        self.width = max(map(len, names), default=1)
        # as many pieces begin at one place as one piece has beginnings that are pieces, and a character alone
        self.choices = max((sum(p[:e] in names for e in range(2, len(p) + 1)) for p in names), default=0) + 1
        self.power = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(self.width)], dtype=np.uint64)
        self.length = np.array([len(p) if i not in byte_set else 0 for i, p in enumerate(pieces)], dtype=np.int64)
        self.spelling = np.array([0 if i in byte_set else self._spelling(p) for i, p in enumerate(pieces)], dtype=np.uint64)
        for p in list(names):  # beginnings of pieces are marked, so that a search stops where no piece goes on
            for end in range(1, len(p)):
                names.setdefault(p[:end], -1)
        hashes = np.array([self._hash(p) for p in names], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(names.values()), dtype=np.int32)[order]
        slots = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange(1 << 20)).astype(np.int32)
        self.deepest = int(np.bincount(slots, minlength=1).max()) if names else 0
        self.log_weight = np.array([-alpha * math.log(r + 3.0) for r in ranks])
        self.byte_ids = np.array([byte_ids.get(b, -1) for b in range(256)], dtype=np.int32)
        self.texts = [p.replace(BLANK, " ").encode() for p in pieces]
        for b, i in byte_ids.items():
            self.texts[i] = bytes([b])
        self.fallback_weight = -alpha * math.log(len(pieces) + 3.0)

    def _hash(self, piece: str) -> int:
        points = np.frombuffer(piece.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        return int(mixed(np.array([int((points * self.power[: len(points)]).sum()) * len(points) % 2**64], dtype=np.uint64))[0])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash; -1 for a mere beginning of one, -2 for neither."""
        at = self.first[(hashes >> np.uint64(44)).astype(np.int64)]
        out = np.full(len(hashes), -2, dtype=np.int32)
        left = np.arange(len(hashes))
        for d in range(self.deepest):
            place = np.minimum(at[left] + d, len(self.hashes) - 1)
            found = self.hashes[place]
            same = found == hashes[left]
            out[left[same]] = self.ids[place[same]]
            left = left[found < hashes[left]]  # the table is sorted: a greater one ends the slot
            if not len(left):
                break
        return out

    @staticmethod
    def _spelling(piece: str) -> int:
        points = np.frombuffer(piece.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        return int((mixed(points) * powers(len(points) + 1)[0][: len(points)]).sum())

    def sizes(self, codes: np.ndarray) -> np.ndarray:
        """Characters that each code spells."""
        return np.where(codes < 0, 1, self.length[np.maximum(codes, 0)]) if codes.min(initial=0) < 0 else self.length[codes]

    def decode(self, ids) -> str:
        """Text of a list of ids; the blank that encoding puts in front is taken away."""
        return b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def load(alpha: float = 1.0, folder: str | None = None) -> Vocabulary:
    """The public piece vocabulary of 32,000, once for each worker."""
    key = (alpha, folder)
    if key not in _loaded:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path("piece_bpe_32k", ".model", folder))
        n = m.vocab_size()
        byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        pieces = ["" if m.is_control(i) or m.is_unknown(i) else m.id_to_piece(i) for i in range(n)]
        _loaded[key] = Vocabulary(pieces, [min(float(n), max(0.0, -m.get_score(i))) for i in range(n)], byte_ids, alpha)
    return _loaded[key]


def bare_code(points: np.ndarray) -> np.ndarray:
    """Codes of characters without a piece, all under -1."""
    return -2 - points.astype(np.int64)


class Segments:
    """Segments of a block of texts, each led by a blank: places in the block's code points, hashes, owners."""

    def __init__(self, texts: list[str]):
        led = [BLANK + t for t in texts if t]
        self.points = np.frombuffer("".join(led).replace(" ", BLANK).encode("utf-32-le"), dtype="<u4")
        size = np.fromiter((len(t) + 1 if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        self.text = np.concatenate(([0], np.cumsum(size)))
        blank = self.points == ord(BLANK)
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[self.text[:-1][size > 0]] = True
        self.start = np.flatnonzero(begins)
        self.size = np.diff(self.start, append=len(self.points))
        self.first = np.searchsorted(self.start, self.text)  # first segment of each text, and their number
        up, down = powers(len(self.points) + 1)
        sums = np.zeros(len(self.points) + 1, dtype=np.uint64)
        np.cumsum(mixed(self.points.astype(np.uint64)) * up[: len(self.points)], out=sums[1:])
        self.whole = sums[self.text[1:]] - sums[self.text[:-1]]  # for each text
        self.hash = mixed((sums[self.start + self.size] - sums[self.start]) * down[self.start] + self.size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Lattices:
    """Lattice nodes of the segments seen so far, each with the pieces that begin there, the shortest first. Emptied when full.

    The choices of all nodes lie one after another, those of a node from ``first[node]`` to ``first[node + 1]``.
    """

    def __init__(self, vocabulary: Vocabulary, nodes: int = 4_000_000):
        self.v, self.capacity = vocabulary, nodes
        self._clear(nodes)

    def _clear(self, nodes: int) -> None:
        self.known, self.base = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.used, self.used_choices = 0, 0
        self.first = np.zeros(nodes + 1, dtype=np.int64)
        self.below = np.empty(0, dtype=np.float32)  # share of a node's earlier choices
        self.both = np.empty((0, 2), dtype=np.int32)  # code and log_q side by side: one access gives both
        self._grow(CHOICES * self.capacity)

    def _grow(self, size: int) -> None:
        for name in ("below", "both"):
            old = getattr(self, name)
            new = np.empty((size, *old.shape[1:]), dtype=old.dtype)
            new[: self.used_choices] = old[: self.used_choices]
            setattr(self, name, new)

    def choices(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and log_q of the pieces that begin at a node."""
        own = self.both[self.first[node] : self.first[node + 1]]
        return own[:, 0], own.view(np.float32)[:, 1]

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        return np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != hashes) if len(self.known) else np.arange(len(hashes))

    def bases(self, segments: Segments) -> np.ndarray:
        """First node of each segment, all valid together."""
        if not len(segments.hash):
            return np.empty(0, np.int64)
        hashes, where, of = np.unique(segments.hash, return_index=True, return_inverse=True)
        new = self._missing(hashes)
        need = int(segments.size[where[new]].sum()) + len(new)
        if self.used + need >= len(self.first) or self.used_choices > CHOICES * self.capacity:
            self._clear(max(self.capacity, int(segments.size[where].sum()) + len(where)))
            new = np.arange(len(hashes))
        if len(new):
            own = where[new]
            base = self._add(segments.points, segments.start[own], segments.size[own])
            known, bases = np.concatenate([self.known, hashes[new]]), np.concatenate([self.base, base])
            order = np.argsort(known, kind="stable")
            self.known, self.base = known[order], bases[order]
        return self.base[np.searchsorted(self.known, hashes)][of]

    def _add(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Lattices and backward sums of new segments, all at once; their first nodes. A segment has a node for each character and one for its end."""
        v = self.v
        base = np.cumsum(size + 1) - size - 1
        n = int((size + 1).sum())
        place = np.arange(n) - np.repeat(base, size + 1)
        left = np.repeat(size, size + 1) - place
        point = points[np.minimum(np.repeat(start, size + 1) + place, len(points) - 1)].astype(np.uint64)
        rows = np.flatnonzero(left > 0)
        total = np.zeros(len(rows), dtype=np.uint64)
        count = np.zeros(n, dtype=np.int64)
        edges = []  # by length of the piece: nodes, their choice, code, node behind it
        for c in range(v.width):
            if not len(rows):
                break
            total += (point[rows + c] + np.uint64(1)) * v.power[c]
            found = v.find(mixed(total * np.uint64(c + 1)))
            if c == 0:
                hit, code = rows, np.where(found < 0, bare_code(point[rows]), found).astype(np.int32)
            else:
                some = np.flatnonzero(found >= 0)
                hit, code = rows[some], found[some]
            edges.append((hit, count[hit], code, hit + c + 1))
            count[hit] += 1
            on = np.flatnonzero((found > -2) & (left[rows] > c + 1))
            rows, total = rows[on], total[on]

        behind_all = self.used_choices + np.cumsum(count)
        self.first[self.used + 1 : self.used + n + 1] = behind_all
        if behind_all[-1] > len(self.below):
            self._grow(int(behind_all[-1] * 5 // 4))
        own = self.first[self.used : self.used + n]

        # edges by characters left, then by node: the sums run from the ends of all segments to their starts
        most = int(size.max())
        order = np.argsort(left.astype(np.uint16) if most < 1 << 16 else left, kind="stable")[len(size) :]
        count = count[order]
        edge = np.concatenate(([0], np.cumsum(count)))
        of_node = np.empty(n, dtype=np.int64)
        of_node[order] = edge[:-1]
        to, weight = np.empty(edge[-1], np.int64), np.empty(edge[-1])
        places = []
        for hit, nth, code, behind in edges:
            at = of_node[hit] + nth
            places.append(at)
            to[at] = behind
            w = v.log_weight[np.maximum(code, 0)]
            if code.min(initial=0) < 0:
                alone = code < 0
                char = -2 - code[alone].astype(np.int64)
                w[alone] = v.fallback_weight * (1 + (char > 0x7F).astype(int) + (char > 0x7FF) + (char > 0xFFFF))
            weight[at] = w
        level = np.searchsorted(left[order], np.arange(1, most + 2))
        beta, whole = np.zeros(n), np.empty(len(order))
        for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            x, y = edge[a], edge[b]
            w = weight[x:y]
            w += beta[to[x:y]]
            heads = edge[a:b] - x
            best = np.maximum.reduceat(w, heads)
            w -= np.repeat(best, count[a:b])
            whole[a:b] = np.add.reduceat(np.exp(w), heads)
            beta[order[a:b]] = best + np.log(whole[a:b])
        weight -= np.repeat(np.log(whole), count)
        np.minimum(weight, 0.0, out=weight)
        share, passed = np.exp(weight), np.zeros(n)
        for (hit, nth, code, _), at in zip(edges, places, strict=True):
            flat = own[hit] + nth
            self.both[flat, 0], self.both.view(np.float32)[flat, 1] = code, weight[at]
            self.below[flat] = passed[hit]  # sums of a node's own choices alone, so that they are the same in any table
            passed[hit] += share[at]
        first = self.used
        self.used += n
        self.used_choices = int(behind_all[-1])
        return base + first

    def walk(self, node: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled walks from ``node`` to ``end``, all at once: counts of steps, then piece, log_q and node, walk after walk."""
        active, steps = np.flatnonzero(node < end), []
        at, k = node.copy(), 0
        while len(active):
            rows = at[active]
            u = (mixed(key[active] + np.uint64(k * int(_G) % 2**64)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            flat = self.first[rows + 1] - 1
            high = np.flatnonzero(self.below[flat] > u)  # from the longest piece down: it is most often the likeliest
            while len(high):
                flat[high] -= 1
                high = high[self.below[flat[high]] > u[high]]
            both = self.both.view(np.int64).ravel()[flat].view(np.int32).reshape(-1, 2)
            code = both[:, 0]
            steps.append((active, code, both[:, 1].view(np.float32), rows))
            rows = rows + self.v.sizes(code)
            at[active] = rows
            active = active[rows < end[active]]
            k += 1
        counts = np.zeros(len(node), dtype=np.int64)
        for who, *_ in steps:
            counts[who] += 1
        first = np.cumsum(counts) - counts
        n = int(counts.sum())
        piece, log_q, rows = np.empty(n, np.int32), np.empty(n, np.float32), np.empty(n, np.int64)
        for k, (who, p, q, r) in enumerate(steps):
            place = first[who] + k
            piece[place], log_q[place], rows[place] = p, q, r
        return counts, piece, log_q, rows


def _exponential(key: np.ndarray) -> np.ndarray:
    return -np.log(((mixed(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def cut_gumbel(phi, top: float, e):
    """Greatest Gumbel score of a mass of log ``phi`` given that it is under ``top``; ``e`` is a unit exponential."""
    return phi - np.log(np.exp(np.minimum(phi - top, 700.0)) + e)


class Search:
    """Frontier and found segmentations of one text."""

    def __init__(self, key: int, k: int):
        self.k = k
        self.key, self.paths, self.frontier, self.scores = key, [], [], []

    def add(self, path: tuple, score: float, born: int) -> None:
        """A new whole segmentation and the groups that branch off it after its first ``born`` choices."""
        s = len(self.paths)
        self.paths.append(path)
        self.scores.append(score)
        log_q, reach = path[1], born + 640
        while True:  # masses only fall along a path, so what lies beyond a hopeless one is hopeless
            mass = np.concatenate(([0.0], np.cumsum(log_q[:reach], dtype=np.float64)))
            with np.errstate(divide="ignore"):
                phi = mass[born:-1] + np.log(-np.expm1(log_q[born:reach].astype(np.float64)))
            if reach >= len(log_q) or mass[-1] < min(phi.max(), score) - HOPELESS:
                break
            reach *= 4
        if not len(phi) or phi.max() == -np.inf:
            return
        near = np.flatnonzero(phi > min(phi.max(), score) - HOPELESS)
        salt = np.uint64((self.key ^ (s + 1) * 0xD6E8FEB86659FD93) % 2**64)
        g = cut_gumbel(phi[near], score, _exponential(salt + (near + born).astype(np.uint64) * _G))
        if len(g) > self.k + 1:  # no more groups of a path can be opened or give kappa
            top = np.argpartition(-g, self.k)[: self.k + 1]
            near, g = near[top], g[top]
        self.frontier += [(float(a), s, int(t), ()) for a, t in zip(g, near + born, strict=True)]

    def open_best(self, lattices: Lattices) -> tuple | None:
        """Take the best group: (score, path, step, choice) of its best child; what is left of it returns to the frontier."""
        if not self.frontier:
            return None
        best = max(range(len(self.frontier)), key=lambda i: self.frontier[i][0])
        score, s, t, taken = self.frontier.pop(best)
        piece, log_q, rows = self.paths[s]
        row = rows[t]
        codes, log_choice = lattices.choices(row)
        taken = taken or (int(np.flatnonzero(codes == piece[t])[0]),)
        q = np.exp(log_choice.astype(np.float64))
        q[list(taken)] = 0.0
        u = float((mixed(np.array([(self.key + len(self.paths) * 0xC2B2AE3D27D4EB4F + 1) % 2**64], np.uint64)) >> np.uint64(11))[0]) * 2.0**-53
        choice = min(int(np.searchsorted(np.cumsum(q), u * q.sum(), side="right")), int(np.flatnonzero(q)[-1]))
        taken = (*taken, choice)
        q[choice] = 0.0
        if q.sum() > 0:
            phi = float(log_q[:t].sum(dtype=np.float64) + math.log(q.sum()))
            e = float(_exponential(np.array([(self.key + len(self.paths) * 0x165667B19E3779F9 + 2) % 2**64], np.uint64))[0])
            self.frontier.append((float(cut_gumbel(phi, score, e)), s, t, taken))
        return score, s, t, choice


def sample_block(texts: list[str], keys: list[int], k: int, lattices: Lattices) -> list[list[tuple]]:
    """For each text up to k (piece codes, log probability, perturbed score, log inclusion)."""
    return sample_parts(Segments(texts), keys, k, lattices)


def sample_parts(parts: Segments, keys: list[int], k: int, lattices: Lattices) -> list[list[tuple]]:
    """The same for the segments of a block of texts."""
    base, first = lattices.bases(parts), parts.first
    end = base + parts.size
    seeds = mixed(np.array(keys, dtype=np.uint64))
    owner = np.repeat(np.arange(len(keys)), np.diff(first))
    place = (np.arange(len(base)) - first[owner]).astype(np.uint64)
    searches = [Search(int(x), k) for x in seeds]
    todo = [(i, -math.log(float(_exponential(seeds[i : i + 1])[0])), None, 0, 0) for i in range(len(keys))]
    for s in range(k):
        docs = [x[0] for x in todo]
        starts = [first[i] + skip for i, _, _, skip, _ in todo]
        counts = np.array([first[i + 1] - a for i, a in zip(docs, starts, strict=True)], dtype=np.int64)
        which = np.repeat(starts, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        which = which.astype(np.int64)
        key = mixed(seeds[owner[which]] + np.uint64((s + 1) * 0xC2B2AE3D27D4EB4F % 2**64)) + place[which] * np.uint64(0xD6E8FEB86659FD93)
        node = base[which]
        heads = np.cumsum(counts) - counts
        for h, c, (_, _, _, _, moved) in zip(heads.tolist(), counts.tolist(), todo, strict=True):
            if c and moved:
                node[h] += moved
        steps, piece, log_q, rows = lattices.walk(node, end[which], mixed(key))
        cuts = np.concatenate(([0], np.cumsum(steps)))
        for h, c, (i, score, head, _, _) in zip(heads.tolist(), counts.tolist(), todo, strict=True):
            a, b = cuts[h], cuts[h + c]
            path = (piece[a:b], log_q[a:b], rows[a:b])
            born = 0
            if head is not None:
                path = tuple(np.concatenate(x) for x in zip(head, path, strict=True))
                born = len(head[0])
            searches[i].add(path, score, born)
        todo = []
        if s + 1 < k:
            for i, search in enumerate(searches):
                if len(search.paths) == s + 1 and (best := search.open_best(lattices)):
                    score, of, t, choice = best
                    piece_, log_, rows_ = search.paths[of]
                    row = int(rows_[t])
                    codes, log_choice = lattices.choices(row)
                    head = (np.append(piece_[:t], codes[choice]), np.append(log_[:t], log_choice[choice]), np.append(rows_[:t], row))
                    # the characters spelled so far tell the segment
                    spelled = int(lattices.v.sizes(piece_[:t]).sum())
                    w = int(np.searchsorted(parts.start[first[i] : first[i + 1]], parts.text[i] + spelled, side="right")) - 1
                    todo.append((i, score, tuple(head), w, row + int(lattices.v.sizes(head[0][-1:])[0]) - int(base[first[i] + w])))
    out = []
    for search in searches:
        kappa = max((f[0] for f in search.frontier), default=-math.inf)
        own = []
        for (piece, log_q, _), g in zip(search.paths, search.scores, strict=True):
            p = float(log_q.sum(dtype=np.float64))
            x = p - kappa
            own.append((piece, p, g, 0.0 if x > 30 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))))
        out.append(own)
    return out


def _plain(codes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the bytes of characters that have no piece, and how many ids each code gives."""
    bare = codes < 0
    times = np.ones(len(codes), dtype=np.int64)
    if not bare.any():
        return codes, times
    points = (-2 - codes[bare].astype(np.int64)).astype("<u4")
    times[bare] = 1 + (points > 0x7F).astype(int) + (points > 0x7FF) + (points > 0xFFFF)
    out = np.repeat(codes, times)
    out[np.repeat(bare, times)] = vocabulary.byte_ids[np.frombuffer(points.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)]
    return out, times


def plain_ids(codes: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Ids with the bytes of characters that have no piece."""
    return _plain(codes, vocabulary)[0]


def _spell(codes: np.ndarray, cuts: np.ndarray, place: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Hash of what the codes of each sample spell when it begins at ``place``, and its number of characters."""
    size = vocabulary.sizes(codes)
    ends = np.concatenate(([0], np.cumsum(size)))
    chars = np.diff(ends[cuts])
    if not len(codes):
        return np.zeros(len(chars), np.uint64), chars
    own = vocabulary.spelling[np.maximum(codes, 0)]
    bare = codes < 0
    if bare.any():
        own[bare] = mixed((-2 - codes[bare].astype(np.int64)).astype(np.uint64))
    at = ends[:-1] + np.repeat(place - ends[cuts[:-1]], np.diff(cuts))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * powers(int(at.max()) + 1)[0][at])))
    return sums[cuts[1:]] - sums[cuts[:-1]], chars


def _block_rows(ids: list, parts: Segments, found: list[list[tuple]], vocabulary: Vocabulary) -> pa.RecordBatch:
    """A row for each sample of the texts of a block."""
    own = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    flat = [x for samples in found for x in samples]
    of = np.repeat(np.arange(len(found)), own)
    size = np.fromiter((len(x[0]) for x in flat), dtype=np.int64, count=len(flat))
    codes = np.concatenate([*[x[0] for x in flat], np.empty(0, np.int32)]).astype(np.int32)
    plain, times = _plain(codes, vocabulary)
    cuts = np.concatenate(([0], np.cumsum(size)))
    lengths = np.concatenate(([0], np.cumsum(times)))[cuts]
    spelled, chars = _spell(codes, cuts, parts.text[of], vocabulary)
    columns = [
        pa.array([ids[i] for i in of.tolist()], pa.int64()),
        pa.array((np.arange(len(of)) - (np.cumsum(own) - own)[of] + 1).astype(np.int32)),
        pa.array(np.diff(lengths)),
        *[pa.array([x[j] for x in flat], pa.float64()) for j in (1, 2, 3)],
        pa.array((spelled == parts.whole[of]) & (chars == np.diff(parts.text)[of])),
        pa.ListArray.from_arrays(pa.array(lengths.astype(np.int32)), pa.array(plain)),
    ]
    return pa.record_batch(columns, names=["doc_id", "sample", "n_pieces", "log_prob", "gumbel", "log_inclusion", "round_trip", "ids"])


def _sampled(k: int, seed: int, alpha: float, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(alpha, folder)
        key = ("lattices", alpha, folder)
        lattices = _loaded.setdefault(key, Lattices(vocabulary))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK_CHARS):
                    size += len(texts[to])
                    to += 1
                keys = [xxhash.xxh3_64_intdigest(f"{d}", seed) for d in ids[at:to]]
                parts = Segments(texts[at:to])
                yield _block_rows(ids[at:to], parts, sample_parts(parts, keys, k, lattices), vocabulary)
                at = to

    return run


def sample_segmentations(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 2, seed: int = 1, alpha: float = 1.0, folder: str | None = None) -> DataFrame:
    """Up to k distinct segmentations of every whole text, in falling order of their perturbed scores."""
    return with_clear_names(docs, {"doc_id": id_col, "text": text_col}).mapInArrow(_sampled(k, seed, alpha, folder), SAMPLES)


def decode(samples: DataFrame, *, ids_col: str = "ids", out_col: str = "text", folder: str | None = None) -> DataFrame:
    """The text of each row's ids beside all its columns; null ids give null."""
    at = samples.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(folder=folder)
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields], f"`{out_col}` string"])
    return samples.mapInArrow(run, shape)


def op2_gumbel(spark, sf_dir: str) -> DataFrame:
    """Two segmentations of every document."""
    return sample_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
