"""SentencePiece segmentations sampled without replacement: Gumbel top-k by perturbed A-star search over the lattice.

Every text has a lattice of segmentations into pieces of the model. A piece's weight is 1 / (rank + 2) to the power
`alpha`, with rank the negative of its score in the model (merge order for a BPE model); a character that is no piece is
spelt in byte pieces. A segmentation's probability is the product of its pieces' weights, over the sum for all.

The search tree's root stands for all segmentations and has a Gumbel number; the children of a node share its number by
Gumbels drawn under the condition that their largest is the node's. So the number of a node is the largest among its
leaves, and a best-first search that always takes the largest open node meets leaves in falling order: the first k are a
sample of k distinct segmentations without replacement. With kappa the number of the best node still open after k, a
segmentation of log-probability phi was included with probability 1 - exp(-exp(phi - kappa)), its inclusion score; if
nothing is open, all segmentations are out and the score is 1. One segmentation of a long text has a score too small for
a double, so its logarithm is given too.

No piece crosses from one word into the next, nor from a letter to a mark that no piece has inside, so a text's lattice
is a chain of small lattices. A search node has two children: one edge that leaves its place, drawn by its probability,
and all other edges there together. Along a path all nodes have the number of the path's top node, and the rest at each
place gets a Gumbel around its log-probability held below that number; so all words of many texts are expanded at once
with numpy. Of a path's rests only the k largest can ever be taken. Lattices of words are remembered by a task, up to
MEMO of them; then those that were asked for once are forgotten. Draws depend on the row's key, the sample, the word's place and the step alone. Log-probabilities of
edges and the running sums that draw them are held in fixed point, whose sums are the same in any order, so that a row's
result doesn't depend on the rows that are expanded with it.

Cases: null texts count as empty; an empty text has one segmentation, of no pieces; texts with fewer segmentations than
k give fewer rows; rows that repeat a key give the same draws; `▁` in a text reads back as a blank, as the model writes
it; texts are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import string
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm.common import release
from labelwright.session import spread, table

MODEL = "piece_bpe_32k.model"
K = 2
ALPHA = 1.0
#: Words whose lattices a task remembers, and bytes of texts that are expanded at once (one text at least).
MEMO = 100_000
CHUNK = 200_000
#: Units of the fixed-point numbers: of log-probabilities, and of probabilities.
_LOG_UNIT, _UNIT = 2.0**-36, 2.0**-40
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Base of the hashes of pieces; of 64 bits, so that no two texts in question are likely to share one.
_BASE = 0xD6E8FEB86659FD93


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Vocabulary:
    ids: dict[str, int]
    #: Every beginning of a piece: the piece's id, or -1 if it is none itself.
    starts: dict[str, int]
    log_weights: list[float]
    byte_ids: list[int]
    spelling: list[bytes]
    #: The spellings one after another, and where each begins and the last ends.
    spelt: np.ndarray
    spelt_at: np.ndarray
    longest: int
    #: Of each byte, whether it is a control character that is in no piece; whether a mark that no piece has after a letter.
    controls: np.ndarray
    marks: np.ndarray


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids: dict[str, int] = {}
    weights, bytes_of, spelling = [0.0] * len(model), [0] * 256, [b""] * len(model)
    for i in range(len(model)):
        piece = model.id_to_piece(i)
        weights[i] = -alpha * float(np.log(-model.get_score(i) + 2))
        if model.is_byte(i):
            byte = int(piece[3:5], 16)
            bytes_of[byte], spelling[i] = i, bytes([byte])
            weights[i] = -alpha * float(np.log(len(model)))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids[piece], spelling[i] = i, piece.replace("▁", " ").encode()
    starts = {piece[:j]: -1 for piece in ids for j in range(1, len(piece))} | ids
    spelt_at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, spelling), np.int64, len(spelling)))))
    return Vocabulary(ids, starts, weights, bytes_of, spelling, np.frombuffer(b"".join(spelling), np.uint8), spelt_at, max(map(len, ids)), *_separators(ids))


def _separators(pieces: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Control characters that are in no piece, and marks that no piece has after a letter."""
    inside = set(chain.from_iterable(pieces))
    joined = {b for piece in pieces for a, b in zip(piece, piece[1:]) if a.isalpha()}
    controls, marks = np.zeros(256, bool), np.zeros(256, bool)
    controls[[c for c in range(32) if chr(c) not in inside]] = True
    marks[[ord(c) for c in string.punctuation if c not in joined]] = True
    return controls, marks


def decode(ids: list[int], words: Vocabulary) -> str:
    """The text of a segmentation; the blank that encoding puts first is taken away."""
    return b"".join(map(words.spelling.__getitem__, ids)).decode("utf-8", "replace")[1:]


_ASCII_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])


def _after_letter(blob: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place of some UTF-8 is a letter, as `[^\\W\\d_]` has it."""
    last = blob[at - 1]
    out = _ASCII_LETTER[last]
    wide = np.nonzero(last >= 0x80)[0]
    if len(wide):
        four = np.zeros(len(wide), np.uint32)
        for back in (4, 3, 2, 1):
            four = (four << np.uint32(8)) | blob[np.maximum(at[wide] - back, 0)]
        kinds, which = np.unique(four, return_inverse=True)
        chars = [int(x).to_bytes(4, "big").decode("utf-8", "ignore")[-1:] for x in kinds.tolist()]
        out[wide] = np.array([c.isalnum() and not c.isdecimal() for c in chars])[which]
    return out


def unit_starts(blob: np.ndarray, begins: np.ndarray, words: Vocabulary) -> np.ndarray:
    """Where words begin in the UTF-8 of texts, which lie one after another from `begins` and each begin with a blank.

    A word begins at blanks, at a control character and after it, and at the first mark among the characters up to the
    next blank if that follows a letter: no piece crosses these places.
    """
    blank, control = blob == 32, words.controls[blob]
    start = control.copy()
    start[1:] |= control[:-1]
    start[1:] |= blank[1:] & ~blank[:-1]
    start[begins] = True
    marks = np.nonzero(words.marks[blob])[0]
    of = np.searchsorted(np.nonzero(start)[0], marks, "right")
    firsts = marks[np.diff(of, prepend=0) != 0]
    start[firsts[_after_letter(blob, firsts)]] = True
    return np.nonzero(start)[0]


class Lattices:
    """The lattices of words, as arrays of states and edges. A state is a place in a word; its edges are pieces that begin there."""

    def __init__(self, words: Vocabulary):
        self.words = words
        # Hashes of the beginnings of pieces by length, and the id of the piece that each is, or -1.
        by_length: list[list[tuple[int, int]]] = [[] for _ in range(words.longest + 1)]
        for text, piece in words.starts.items():
            h = 0
            for c in text:
                h = (h * _BASE + ord(c) + 1) % 2**64
            by_length[len(text)].append((h, piece))
        self._tables = [(np.array([h for h, _ in t], np.uint64), np.array([i for _, i in t], np.int64)) for t in map(sorted, by_length)]
        self._weights = np.array(words.log_weights)
        self.clear()

    def clear(self) -> None:
        #: A word's UTF-8, with blanks for `▁`, and its first state.
        self.first: dict[bytes, int] = {}
        self._room: dict[str, np.ndarray] = {}
        self.start = np.zeros(1, np.int64)
        #: In units of _LOG_UNIT.
        self.log_q = np.empty(0, np.int64)
        self.log_rest, self.reach = (np.empty(0, np.float32) for _ in range(2))
        #: By state; how often a word was asked for stands at its first one.
        self.asked = np.empty(0, np.int32)
        #: A piece's id, or -1 - i for the i-th spelling.
        self.after, self.piece = (np.empty(0, np.int32) for _ in range(2))
        self.spellings: list[list[int]] = []

    def _append(self, name: str, more: np.ndarray) -> None:
        """Adds to an array that has room to spare, so that old entries are seldom copied."""
        old = getattr(self, name)
        n = len(old) + len(more)
        room = self._room.get(name)
        if room is None or len(room) < n:
            room = np.empty(n + n // 2, old.dtype)
            room[: len(old)] = old
            self._room[name] = room
        room[len(old) : n] = more
        setattr(self, name, room[:n])

    def forget(self) -> None:
        """Keeps the words that were asked for more than once, MEMO / 2 at most, and halves the numbers of times."""
        first = np.fromiter(self.first.values(), np.int64, len(self.first))  # words and their states are in one order
        size = np.diff(first, append=len(self.start) - 1)
        asked = self.asked[first]
        kept = np.nonzero(asked > 1)[0]
        kept = np.sort(kept[np.argsort(-asked[kept], kind="stable")[: MEMO // 2]])
        every = list(self.first)
        units, first, size = [every[i] for i in kept.tolist()], first[kept], size[kept]
        begin, states = np.cumsum(size) - size, _ranges(first, size)
        of_word = self.start[first + size] - self.start[first]
        edges = _ranges(self.start[first], of_word)
        after, piece = self.after[edges], self.piece[edges]
        after[after >= 0] += np.repeat(begin - first, of_word)[after >= 0].astype(np.int32)
        spelt = np.nonzero(piece < 0)[0]
        spellings = [self.spellings[-1 - p] for p in piece[spelt].tolist()]
        piece[spelt] = -1 - np.arange(len(spelt))
        still = np.zeros(len(states), np.int32)
        still[begin] = asked[kept] // 2
        grown = {"start": np.cumsum(self.start[states + 1] - self.start[states]), "asked": still, "after": after, "piece": piece}
        grown |= {name: getattr(self, name)[edges] for name in ("log_q", "log_rest", "reach")}
        self.clear()
        for name, more in grown.items():
            self._append(name, more)
        self.spellings = spellings
        self.first.update(zip(units, begin.tolist()))

    def add(self, units: list[bytes]) -> None:
        """Builds the lattices of different words that aren't known yet, all at once."""
        if not units:
            return
        joined = b"".join(units)
        chars = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4").astype(np.uint64)
        chars[chars == 32] = ord("▁")
        size = np.fromiter(map(len, units), np.int64, len(units))
        length = np.add.reduceat((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80, np.cumsum(size) - size, dtype=np.int64)
        end = np.repeat(np.cumsum(length), length)
        n = len(chars)
        # Pieces that begin at each place, longer and longer, as long as what is read is the beginning of a piece.
        place, h = np.arange(n), np.zeros(n, np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(1, self.words.longest + 1):
            room = place + size <= end[place]
            place, h = place[room], h[room]
            hashes, ids = self._tables[size]
            if not len(place) or not len(hashes):
                break
            h = h * np.uint64(_BASE) + chars[place + size - 1] + np.uint64(1)
            spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[spot] == h
            place, h, spot = place[known], h[known], spot[known]
            whole = ids[spot] >= 0
            found.append((place[whole], np.full(int(whole.sum()), size), ids[spot[whole]]))
        at, size, piece = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
        lacking = np.ones(n, bool)
        lacking[at[size == 1]] = False
        spelt = np.nonzero(lacking)[0]
        spellings = [[self.words.byte_ids[b] for b in chr(int(c)).encode("utf-8", "replace")] for c in chars[spelt]]
        weight = np.concatenate((self._weights[piece], [sum(self.words.log_weights[b] for b in x) for x in spellings]))
        at, size, piece = np.concatenate((at, spelt)), np.concatenate((size, np.ones(len(spelt), np.int64))), np.concatenate((piece, -1 - np.arange(len(spelt))))
        order = np.argsort(at, kind="stable")
        at, size, piece, weight = at[order], size[order], piece[order], weight[order]
        count = np.bincount(at, minlength=n)
        begin = np.cumsum(count) - count
        # What all segmentations from each place have together, from the words' ends backwards.
        total = np.zeros(n + 1)
        score = np.empty(len(at))
        to = at + size
        last = to == end[at]
        left = end - np.arange(n)
        by_left = np.argsort(left, kind="stable")
        cuts = np.cumsum(np.bincount(left))
        for r in range(1, len(cuts)):
            places = by_left[cuts[r - 1] : cuts[r]]
            if not len(places):
                continue
            edges = _ranges(begin[places], count[places])
            value = weight[edges] + np.where(last[edges], 0.0, total[to[edges]])
            score[edges] = value
            heads = np.cumsum(count[places]) - count[places]
            top = np.maximum.reduceat(value, heads)
            total[places] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count[places])), heads))
        top = np.maximum.reduceat(score, begin)
        chance = np.exp(score - top[at])
        q = chance / np.add.reduceat(chance, begin)[at]
        # What the other edges have together; for the likeliest edge summed without it, as 1 - q would lose digits.
        likeliest = np.minimum.reduceat(np.where(score == top[at], np.arange(len(score)), len(score)), begin)
        without = q.copy()
        without[likeliest] = 0.0
        rest = 1.0 - q
        rest[likeliest] = np.add.reduceat(without, begin)
        rest[count[at] == 1] = 0.0
        part = np.rint(q / _UNIT).astype(np.int64)
        running = np.cumsum(part)
        reach = (running - (running[begin] - part[begin])[at]) * _UNIT
        reach[begin + count - 1] = 1.0
        base = len(self.start) - 1
        piece[piece < 0] -= len(self.spellings)
        self.spellings += spellings
        with np.errstate(divide="ignore"):
            log_q = np.rint(np.clip(np.log(q), -1e4, 0.0) / _LOG_UNIT).astype(np.int64)
            grown = {
                "log_q": log_q, "log_rest": np.log(rest).astype(np.float32), "reach": reach.astype(np.float32), "after": np.where(last, -1, to + base).astype(np.int32), "piece": piece.astype(np.int32),
                "start": len(self.log_q) + np.cumsum(count), "asked": np.zeros(n, np.int32),
            }
        for name, more in grown.items():
            self._append(name, more)
        self.first.update(zip(units, (base + np.cumsum(length) - length).tolist()))

    def states_of(self, units: pa.LargeBinaryArray) -> np.ndarray:
        """The first states of different words; lattices that aren't known yet are built."""
        _, ends, data = units.buffers()
        places = np.frombuffer(ends, np.int64)[units.offset : units.offset + len(units) + 1].tolist()
        whole = data.to_pybytes()
        each = [whole[a:b] for a, b in zip(places, places[1:])]
        found = list(map(self.first.get, each))
        new = [i for i, state in enumerate(found) if state is None]
        self.add([each[i] for i in new])
        for i in new:
            found[i] = self.first[each[i]]
        states = np.array(found, np.int64)
        self.asked[states] += 1
        return states

    def state_of(self, edge: int) -> int:
        """The state that an edge leaves."""
        return int(np.searchsorted(self.start, edge, "right")) - 1

    def ids_of(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of some edges, and how many each edge has."""
        ids = self.piece[path]
        count = np.ones(len(ids), np.int64)
        spelt = np.nonzero(ids < 0)[0]
        if not len(spelt):
            return ids, count
        bytes_of = [self.spellings[-1 - p] for p in ids[spelt].tolist()]
        count[spelt] = list(map(len, bytes_of))
        out = np.repeat(ids, count)
        out[_ranges((np.cumsum(count) - count)[spelt], count[spelt])] = list(chain.from_iterable(bytes_of))
        return out, count


@functools.lru_cache(maxsize=1)
def lattices(path: str, alpha: float) -> Lattices:
    """The tables of a Python worker; what a task adds is cleared at its end, so that later stages have the memory."""
    return Lattices(vocabulary(path, alpha))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times(n: int) -> np.uint64:
    """n times the odd constant, modulo 2^64."""
    return np.uint64(n * int(_SPREAD) % 2**64)


def _unit(h: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, neither included."""
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _below(bound: np.ndarray, place: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel around `place` under the condition that it is below `bound`."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(place == -np.inf, -np.inf, np.minimum(place - np.log(np.exp(place - bound) - np.log(u)), bound))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _draw(lat: Lattices, state: np.ndarray, u: np.ndarray) -> np.ndarray:
    """An edge of each state: the first whose running sum of probabilities reaches u, found by halving the states' few edges."""
    lo, hi = lat.start[state], lat.start[state + 1] - 1
    open_ = np.nonzero(lo < hi)[0]
    while len(open_):
        a, b = lo[open_], hi[open_]
        mid = (a + b) >> 1
        above = u[open_] > lat.reach[mid]
        lo[open_], hi[open_] = np.where(above, mid + 1, a), np.where(above, b, mid)
        open_ = open_[lo[open_] < hi[open_]]
    return lo


@dataclass
class Expansion:
    """Paths below some nodes, one for each text. Edges are in path order; `cut` has where each text's begin."""

    edges: np.ndarray
    word: np.ndarray  # the place in `state` and `unit` of the word that each edge is in
    step: np.ndarray
    before: np.ndarray  # log-probability of the path before the edge
    cut: np.ndarray
    phi: np.ndarray  # log-probability of the whole path
    open_value: np.ndarray  # (texts, k): numbers of the best rests, -inf where there are none
    open_at: np.ndarray  # the path edge that each is the rest of


def expand(lat: Lattices, state: np.ndarray, text: np.ndarray, unit: np.ndarray, step0: np.ndarray, seed: np.ndarray, value: np.ndarray, phi: np.ndarray, k: int) -> Expansion:
    """Draws a path from `state` (-1: no place left) in each word of each text. seed, value, phi: by text, value the top node's number."""
    n_texts = len(seed)
    word_seed = _mix(seed[text] + (unit.astype(np.uint64) + np.uint64(1)) * _SPREAD)
    alive = np.nonzero(state >= 0)[0]
    at, step = state[alive], step0[alive]
    parts: list[tuple[np.ndarray, ...]] = []
    while len(alive):
        h = _mix(word_seed[alive] + (step.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
        pick = _draw(lat, at, _unit(h))
        parts.append((pick, alive, step, h))
        at = lat.after[pick]
        go = at >= 0
        alive, at, step = alive[go], at[go], step[go] + 1
    # Parts come by steps; here edges go to their places by word and step.
    words = np.concatenate([np.empty(0, np.int64), *[p[1] for p in parts]])
    count = np.bincount(words, minlength=len(state))
    begin = np.cumsum(count) - count
    goes = (begin - step0)[words] + np.concatenate([np.empty(0, np.int64), *[p[2] for p in parts]])
    picked, h = np.empty(len(words), np.int64), np.empty(len(words), np.uint64)
    picked[goes] = np.concatenate([picked[:0], *[p[0] for p in parts]])
    h[goes] = np.concatenate([h[:0], *[p[3] for p in parts]])
    word = np.repeat(np.arange(len(state)), count)
    stepped = np.arange(len(words)) + (step0 - begin)[word]
    of_text = np.repeat(text, count)
    cut = np.searchsorted(of_text, np.arange(n_texts + 1))
    run = np.concatenate((np.zeros(1, np.int64), np.cumsum(lat.log_q[picked])))
    long = np.diff(cut)
    before = (run[:-1] - np.repeat(run[cut[:-1]], long)) * _LOG_UNIT + np.repeat(phi, long)
    whole = (run[cut[1:]] - run[cut[:-1]]) * _LOG_UNIT + phi
    open_value, open_at = np.full((n_texts, k), -np.inf), np.full((n_texts, k), -1)
    rest = lat.log_rest[picked]
    some = np.nonzero(rest > -np.inf)[0]
    if len(some):
        owner = of_text[some]
        number = _below(value[owner], before[some] + rest[some], _unit(_mix(h[some] + _SPREAD)))
        begin = np.nonzero(np.diff(owner, prepend=-1))[0]
        texts, size, index = owner[begin], np.diff(np.append(begin, len(number))), np.arange(len(number))
        for r in range(k):
            best = np.maximum.reduceat(number, begin)
            spot = np.minimum.reduceat(np.where(number == np.repeat(best, size), index, len(number)), begin)
            found = best > -np.inf
            open_value[texts[found], r], open_at[texts[found], r] = best[found], some[spot[found]]
            number[spot[found]] = -np.inf
    return Expansion(picked, word, stepped, before, cut, whole, open_value, open_at)


@dataclass
class Rest:
    """An open node: all edges of a state but some, after a head of edges."""

    number: float
    head: np.ndarray
    unit: int
    step: int
    state: int
    phi: float
    gone: tuple[int, ...]


def take_edge(lat: Lattices, node: Rest, seed: int) -> tuple[int, Rest | None]:
    """Draws an edge of an open node, which gets the node's number, and what is still left of it, if anything is."""
    edges = np.array([e for e in range(lat.start[node.state], lat.start[node.state + 1]) if e not in node.gone])
    log_q = lat.log_q[edges] * _LOG_UNIT
    q = np.exp(log_q - log_q.max())
    h = _mix(np.array([seed], np.uint64) + _times(node.unit + 1) + _times(7 * node.step + 3))
    at = min(int(np.searchsorted(np.cumsum(q) / q.sum(), _unit(h)[0])), len(edges) - 1)
    left = np.delete(q, at).sum()
    if len(edges) == 1 or left == 0:
        return int(edges[at]), None
    place = node.phi + math.log(left) + float(log_q.max())
    number = float(_below(np.array([node.number]), np.array([place]), _unit(_mix(h + _SPREAD)))[0])
    return int(edges[at]), Rest(number, node.head, node.unit, node.step, node.state, node.phi, (*node.gone, int(edges[at])))


@dataclass
class Sample:
    row: int
    rank: int
    ids: np.ndarray
    log_prob: float
    log_inclusion: float


@dataclass
class Samples:
    """Samples of some texts, by text and rank; the ids of the i-th are ids[ends[i] : ends[i + 1]]."""

    row: np.ndarray
    rank: np.ndarray
    ids: np.ndarray
    ends: np.ndarray
    log_prob: np.ndarray
    log_inclusion: np.ndarray
    round_trip: np.ndarray

    def __iter__(self) -> Iterator[Sample]:
        for i, (a, b) in enumerate(zip(self.ends[:-1].tolist(), self.ends[1:].tolist())):
            yield Sample(int(self.row[i]), int(self.rank[i]), self.ids[a:b], float(self.log_prob[i]), float(self.log_inclusion[i]))


def log_inclusion(log_prob: float, kappa: float) -> float:
    """ln(1 - exp(-exp(log_prob - kappa)))"""
    x = log_prob - kappa
    if kappa == -np.inf or x > 5:
        return 0.0
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def sample_texts(states: np.ndarray, sizes: np.ndarray, seeds: list[int], lat: Lattices, k: int) -> tuple[list[np.ndarray], Samples]:
    """The first k segmentations of each text: their edges, and the samples without ids. Texts are given as the first states of their words, one text after another, and numbers of words."""
    n = len(sizes)
    offset = np.cumsum(sizes) - sizes
    text, unit = np.repeat(np.arange(n), sizes), _ranges(np.zeros(n, np.int64), sizes)
    seed = _mix(np.array(seeds, np.uint64))
    value, phi = -np.log(-np.log(_unit(_mix(seed + _SPREAD)))), np.zeros(n)
    who = np.arange(n)
    heads: list[np.ndarray] = [np.empty(0, np.int64)] * n
    heaps: list[list[Rest]] = [[] for _ in range(n)]
    taken: list[list[tuple[np.ndarray, float]]] = [[] for _ in range(n)]
    state, step0 = states, np.zeros(len(states), np.int64)
    for r in range(k):
        got = expand(lat, state, text, unit, step0, _mix(seed[who] + _times(r + 2)), value, phi, k)
        for i, row in enumerate(who.tolist()):
            a, b = got.cut[i], got.cut[i + 1]
            taken[row].append((np.concatenate((heads[row], got.edges[a:b])), float(got.phi[i])))
            for number, at in zip(got.open_value[i].tolist(), got.open_at[i].tolist()):
                if at < 0:
                    break
                head = np.concatenate((heads[row], got.edges[a:at]))
                edge = int(got.edges[at])
                heaps[row].append(Rest(number, head, int(unit[got.word[at]]), int(got.step[at]), lat.state_of(edge), float(got.before[at]), (edge,)))
            heaps[row].sort(key=lambda x: -x.number)
        if r == k - 1:
            break
        parts, next_who, values, phis = [], [], [], []
        for row in who.tolist():
            if not heaps[row]:
                continue
            node = heaps[row].pop(0)
            edge, left = take_edge(lat, node, int(seed[row] ^ _times(r + 2)))
            if left is not None:
                heaps[row].append(left)
            heads[row] = np.append(node.head, edge)
            later = states[offset[row] + node.unit : offset[row] + sizes[row]].copy()
            later[0] = lat.after[edge]
            steps = np.zeros(len(later), np.int64)
            steps[0] = node.step + 1
            parts.append((later, np.full(len(later), len(next_who)), np.arange(node.unit, sizes[row]), steps))
            next_who.append(row)
            values.append(node.number)
            phis.append(node.phi + lat.log_q[edge] * _LOG_UNIT)
        if not next_who:
            break
        state, text, unit, step0 = (np.concatenate([p[i] for p in parts]) for i in range(4))
        who = np.array(next_who)
        value, phi = np.array(values, float), np.array(phis, float)
    paths, rows, ranks, log_probs, inclusions = [], [], [], [], []
    for row in range(n):
        kappa = max((x.number for x in heaps[row]), default=-np.inf)
        for rank, (path, log_prob) in enumerate(taken[row]):
            paths.append(path)
            rows.append(row)
            ranks.append(rank)
            log_probs.append(log_prob)
            inclusions.append(log_inclusion(log_prob, kappa))
    none = np.empty(0, np.int64)
    return paths, Samples(np.array(rows, np.int64), np.array(ranks, np.int32), none, none, np.array(log_probs, float), np.array(inclusions, float), none)


def seed_of(key: object) -> int:
    return xxhash.xxh64_intdigest(repr(key).encode(), 3)


def _reads_back(found: Samples, blob: np.ndarray, begins: np.ndarray, sizes: np.ndarray, words: Vocabulary) -> np.ndarray:
    """Whether the pieces of each sample spell its text."""
    long = words.spelt_at[found.ids + 1] - words.spelt_at[found.ids]
    upto = np.concatenate(([0], np.cumsum(long)))[found.ends]
    out = np.diff(upto) == sizes[found.row]
    spelt = words.spelt[_ranges(words.spelt_at[found.ids], long)]
    same = np.nonzero(out)[0]
    here, there = _ranges(upto[same], sizes[found.row[same]]), _ranges(begins[found.row[same]], sizes[found.row[same]])
    wrong = np.nonzero(spelt[here] != blob[there])[0]
    out[np.searchsorted(upto, here[wrong], "right") - 1] = False
    return out


def encode_texts(texts: pa.Array | Sequence[str | None], keys: list[object], lat: Lattices, k: int) -> Iterator[Samples]:
    """Samples of the texts in order, some texts at a time; `row` is the text's number."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(length)
    at = 0
    while at < len(texts):
        if len(lat.first) > MEMO:
            lat.forget()
        before = upto[at - 1] if at else 0
        first, at = at, max(at + 1, int(np.searchsorted(upto, before + CHUNK, "right")))
        # Blanks are written `▁` in pieces, so that both read alike; each text that isn't empty gets one to begin with.
        some = pc.replace_substring(pc.fill_null(texts.slice(first, at - first), ""), "▁", " ")
        blob = b"".join([b" " + t if t else b"" for t in pc.cast(some, pa.binary()).to_pylist()])
        bytes_ = np.frombuffer(blob, np.uint8)
        sizes = pc.binary_length(some).to_numpy().astype(np.int64)
        sizes += sizes > 0
        begins = np.cumsum(sizes) - sizes
        starts = unit_starts(bytes_, begins[sizes > 0], lat.words) if len(blob) else np.empty(0, np.int64)
        ends = np.append(starts, len(blob)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(blob)]).dictionary_encode()
        states = lat.states_of(units.dictionary)[units.indices.to_numpy()] if len(starts) else np.empty(0, np.int64)
        n_units = np.searchsorted(starts, begins + sizes) - np.searchsorted(starts, begins)
        paths, found = sample_texts(states, n_units, [seed_of(x) for x in keys[first:at]], lat, k)
        found.ids, count = lat.ids_of(np.concatenate([np.empty(0, np.int64), *paths]))
        steps = np.concatenate(([0], np.cumsum(np.fromiter(map(len, paths), np.int64, len(paths)))))
        found.ends = np.concatenate(([0], np.cumsum(count)))[steps]
        found.round_trip = _reads_back(found, bytes_, begins, sizes, lat.words)
        found.row += first
        yield found


ADDED = {"sample": pa.int32(), "ids": pa.list_(pa.int32()), "n_pieces": pa.int64(), "log_prob": pa.float64(), "inclusion": pa.float64(), "log_inclusion": pa.float64(), "round_trip": pa.bool_()}


def sample_segmentations(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, alpha: float = ALPHA, path: str | None = None) -> DataFrame:
    """Column `key` and, for each sampled segmentation of the row's text, `sample` (its number from 0), `ids`, `n_pieces`, `log_prob`, `inclusion` and its logarithm, and whether the ids decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(path or model_path(), alpha)
        for batch in batches:
            for found in encode_texts(batch.column("_text"), batch.column("_key").to_pylist(), lat, k):
                columns = [
                    batch.column("_key").take(pa.array(found.row)),
                    pa.array(found.rank),
                    pa.ListArray.from_arrays(pa.array(found.ends.astype(np.int32)), pa.array(found.ids)),
                    pa.array(np.diff(found.ends)),
                    pa.array(found.log_prob),
                    pa.array(np.exp(found.log_inclusion)),
                    pa.array(found.log_inclusion),
                    pa.array(found.round_trip),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, *ADDED])
            del batch
            release()
        lat.clear()
        release()

    schema = f"`{key}` {dict(docs.dtypes)[key]}, sample int, ids array<int>, n_pieces bigint, log_prob double, inclusion double, log_inclusion double, round_trip boolean"
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)


def op3_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
