"""Sampled SentencePiece segmentations: Gumbel top-k without replacement by a perturbed A-star search.

The lattice of a text has an edge for every piece that matches; a character that is no piece is spelt in
byte pieces. A segmentation's probability is the product of its pieces', normalised over the lattice. The
search keeps a frontier of sets of segmentations, each with the greatest Gumbel-perturbed log probability in
it, drawn from the set's mass under the bound of the set that it was split from. The best set is split, or
completed to a segmentation when it is one branch; so segmentations come out in the order of their perturbed
scores, all different. The next best score is the threshold from which inclusion follows.

Vocabularies of this kind cut no piece across the start of a word, so a text's lattice is a chain of its
units' lattices, and each unit's is computed once in a batch. All texts of a batch are completed together in
numpy; only the few sets at the head of the frontier are handled text by text. What is drawn depends on the
row's key alone, not on its batch.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeping, mix64, powers, text_chunks

#: A vocabulary file is a parameter of every call; this one is read unless another is named.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations of each text in production.
SAMPLES = 2
SPACE = "▁"
#: Stands for a U+2581 of the text itself, which is spelt in bytes: the piece character means a space. No text holds a surrogate.
MARK = "\ud800"
#: So many branches of a path are split from a set at once.
SPLIT = 256
#: Bytes of text that share their units' lattices; a worker takes some tens of bytes of memory for each of them.
CHUNK = 3 << 20


class Prefixes(NamedTuple):
    """The sorted hashes of the pieces' prefixes of one length, with id and log probability if one is a piece, else -1.

    first: for each value of a hash's leading bits, the row of the first hash that has it or more; shift: 64 less their number.
    """

    hashes: np.ndarray
    ids: np.ndarray
    logs: np.ndarray
    first: np.ndarray
    shift: int

    def rows(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are there, and their rows."""
        row = self.first[(hashes >> np.uint64(self.shift)).astype(np.int64)]
        last, live = len(self.hashes) - 1, None
        behind = np.flatnonzero((self.hashes[row] < hashes) & (row < last))  # rows that share leading bits are few
        while len(behind):
            row[behind] += 1
            live = row[behind]
            behind = behind[(self.hashes[live] < hashes[behind]) & (live < last)]
        hit = np.flatnonzero(self.hashes[row] == hashes)
        return hit, row[hit]


class Vocabulary(NamedTuple):
    """by_length: the prefixes of each length. spelling: the bytes of each id, which stand in `blob` from `blob_at` on."""

    by_length: list[Prefixes]
    byte_ids: np.ndarray
    byte_log: float
    spelling: list[bytes]
    single: np.ndarray  # for each code point its row among the prefixes of length 1, or -1
    blob: np.ndarray
    blob_at: np.ndarray


def piece_hashes(codes: np.ndarray, length: int, sums: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A hash of the `length` code points from each place."""
    n = len(codes) - length + 1
    return mix64((sums[length : length + n] - sums[:n]) * down[:n])


def prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(codes) + 1), powers(len(codes) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return sums, down


def vocabulary(pieces: list[tuple[int, str, float]], byte_ids: list[int], byte_log: float, size: int) -> Vocabulary:
    """pieces: id, text (with U+2581 for a space) and log probability."""
    by_length, spelling = [], [b""] * size
    for i, text, _ in pieces:
        spelling[i] = text.replace(SPACE, " ").encode()
    for b, i in enumerate(byte_ids):
        spelling[i] = bytes([b])
    whole, single = {t: (i, p) for i, t, p in pieces}, np.full(0x110000, -1, np.int32)
    for length in range(1, max(map(len, whole), default=0) + 1):
        own = sorted({t[:length] for t in whole if len(t) >= length})
        codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
        hashes = piece_hashes(codes, length, *prefix_sums(codes))[::length]
        order = np.argsort(hashes)
        ids, logs = (np.array([whole.get(t, (-1, 0.0))[j] for t in own]) for j in (0, 1))
        bits = max(len(own).bit_length() + 2, 1)
        lead = np.searchsorted(hashes[order] >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64))
        by_length.append(Prefixes(hashes[order], ids[order].astype(np.int32), logs[order], np.minimum(lead, len(own) - 1).astype(np.int32), 64 - bits))
        if length == 1:
            single[codes[order]] = np.arange(len(order))
    blob_at = np.concatenate(([0], np.cumsum(list(map(len, spelling))))).astype(np.int32)
    return Vocabulary(by_length, np.array(byte_ids, np.int32), byte_log, spelling, single, np.frombuffer(b"".join(spelling), np.uint8), blob_at)


def load(path: str = MODEL) -> Vocabulary:
    """A vocabulary file of the sentencepiece library.

    Merge files hold ranks, not probabilities: a piece of rank r has probability in proportion to 1 / (r + 2.7),
    and a byte piece a tenth of the rarest piece's.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranked = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-max(model.get_score(i), -1e8), i)))}
    total = math.log(sum(1 / (r + 2.7) for r in range(len(plain))))
    log = {i: -math.log(r + 2.7) - total for i, r in ranked.items()}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return vocabulary([(i, model.id_to_piece(i), log[i]) for i in plain], byte_ids, min(log.values()) - math.log(10), size)


class Units(NamedTuple):
    """Texts cut into units: at each line break, before and after it, and before each run of spaces.

    codes: the code points of all texts, each after a space that decoding drops (an empty text has none); start: of
    each unit; unit: which of the distinct ones it is; own: where each distinct one stands first; n: units of each text.
    """

    codes: np.ndarray
    start: np.ndarray
    unit: np.ndarray
    own: np.ndarray
    n: np.ndarray


def units_of(texts: list[str]) -> Units:
    """Distinct units are told by 64-bit hashes, which are then held against the characters; if two share one, by the characters."""
    codes = np.frombuffer("".join([f" {t}" for t in texts if t]).encode("utf-32-le"), np.uint32).copy()
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    text_end = np.cumsum(size)
    codes[codes == ord(SPACE)] = ord(MARK)
    space, line = codes == 32, codes == 10
    codes[space] = ord(SPACE)
    begins = line.copy()
    begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    begins[(text_end - size)[size > 0]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(codes))[: len(start)]
    n = np.diff(np.searchsorted(start, text_end), prepend=0)
    sums, down = prefix_sums(codes)
    unit, own = numbered(mix64((sums[end] - sums[start]) * down[start]))
    first = start[own][unit]
    if not np.array_equal(codes[np.repeat(first - start, end - start) + np.arange(len(codes))] if len(start) else codes, codes) or (end[own] - start[own])[unit].tolist() != (end - start).tolist():
        known = Numbered()
        unit = np.array([known[codes[a:b].tobytes()] for a, b in zip(start, end, strict=True)], np.int64)
        own = np.unique(unit, return_index=True)[1]
    return Units(codes, start, unit, own, n)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key its number among the distinct ones, in the order in which they come, and where each of these stands first."""
    number, distinct = pd.factorize(keys)
    own = np.empty(len(distinct), np.int64)
    own[number[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return number, own


class Lattices:
    """The lattices of the distinct units of texts, one after the other. A node is a place; edges are sorted by their start.

    first[i]: the first edge of node i; log_p: log probability of an edge given its start; upto: running sums of
    these probabilities in a node; piece: an id, or -1 for a character spelt in several bytes.
    """

    def __init__(self, units: Units, vocabulary: Vocabulary):
        start = units.start[units.own]
        nodes = np.append(units.start, len(units.codes))[units.own + 1] - start + 1  # each unit ends in a node without edges
        self.begin = np.concatenate(([0], np.cumsum(nodes)))
        n = int(self.begin[-1])
        place = np.repeat(start - self.begin[:-1], nodes) + np.arange(n)
        self.codes = codes = units.codes[np.minimum(place, len(units.codes) - 1)]
        end_of = np.repeat((self.begin[1:] - 1).astype(np.int32), nodes)
        left = end_of - np.arange(n, dtype=np.int32)
        sums, down = prefix_sums(codes)
        found, covered = [], left == 0
        at = np.arange(n, dtype=np.int32)
        for length, prefixes in enumerate(vocabulary.by_length, 1):
            ids, logs = prefixes.ids, prefixes.logs
            at = at[left[at] >= length]
            if not len(at) or not len(ids):
                continue
            if length == 1:
                k = vocabulary.single[codes[at]]
                hit = np.flatnonzero(k >= 0)
                k = k[hit]
            else:
                hit, k = prefixes.rows(mix64((sums[at + length] - sums[at]) * down[at]))
            at = at[hit]  # where a piece begins so, and longer ones may
            is_piece = ids[k] >= 0
            found.append((at[is_piece], ids[k[is_piece]], logs[k[is_piece]], length))
            if length == 1:
                covered[found[-1][0]] = True
        spelt = np.flatnonzero(~covered).astype(np.int32)
        c = np.where(codes[spelt] == ord(MARK), ord(SPACE), codes[spelt])
        n_bytes = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        one = np.where(n_bytes == 1, vocabulary.byte_ids[np.minimum(c, 127)], np.int32(-1))
        found.append((spelt, one, vocabulary.byte_log * n_bytes, 1))
        count = np.zeros(n, np.int32)
        for starts, *_ in found:
            count[starts] += 1  # a node is once in each
        self.first = np.concatenate(([0], np.cumsum(count, dtype=np.int32)))
        self.start = np.repeat(np.arange(n, dtype=np.int32), count)
        n_edges = len(self.start)
        self.piece, self.end, log, slot = np.empty(n_edges, np.int32), np.empty(n_edges, np.int32), np.empty(n_edges), self.first[:-1].copy()
        for starts, ids, logs, length in found:
            to = slot[starts]
            slot[starts] += 1
            self.piece[to], self.end[to], log[to] = ids, starts + np.int32(length), logs
        del found, starts, ids, logs, slot, sums, down, c, covered
        # Log masses from the ends on: all nodes with so many characters left at once.
        mass = np.zeros(n)
        by_left = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable").astype(np.int32)  # short ones by digits
        bounds = np.searchsorted(left[by_left], np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(bounds, bounds[1:], strict=False):
            nodes = by_left[a:b]
            sizes = count[nodes]
            heads = np.cumsum(sizes) - sizes
            edges = np.repeat(self.first[nodes] - heads, sizes) + np.arange(sizes.sum())
            value = log[edges] + mass[self.end[edges]]
            top = np.maximum.reduceat(value, heads)
            value -= np.repeat(top, sizes)
            mass[nodes] = top + np.log(np.add.reduceat(np.exp(value), heads))
        log += mass[self.end]
        log -= mass[self.start]
        self.log_p, p = log, np.exp(log)
        self.upto = np.cumsum(p)  # less what stands before the node
        np.subtract(self.upto, p, out=p)
        self.upto -= p[self.first[self.start]]

    def choose(self, nodes: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """An edge from each node, by its probability."""
        edge, last = self.first[nodes], self.first[nodes + 1] - 1
        open_ = np.flatnonzero((self.upto[edge] <= uniform) & (edge < last))
        while len(open_):
            own = edge[open_] + 1
            edge[open_] = own
            open_ = open_[(self.upto[own] <= uniform[open_]) & (own < last[open_])]
        return edge


def uniforms(keys: np.ndarray, turn: int) -> np.ndarray:
    """Of keys that are mixed already."""
    x = keys + np.uint64(turn * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(11)) * 2.0**-53


@lru_cache(maxsize=16)
def counters(draw: int, n: int) -> np.ndarray:
    """Of the n first numbers of a draw what all texts share; their keys tell them apart."""
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64(draw << 32))


class Path(NamedTuple):
    """edges of a whole text, the running log probability before each of them and at the end, and the perturbed score, both less the text's log mass."""

    edges: np.ndarray
    before: np.ndarray
    score: float


def gumbels(log_mass: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    return log_mass - np.log(-np.log(np.maximum(uniform, 1e-300)))


class Search:
    """The frontier of one text. Entries: (-score, order, path, place, edge): of what the path shares up to `place`, the
    branch by `edge`, or, with edge -1, all that leaves the path there or later. Of each split only the `k` best parts
    are kept: what is below them can't be among the first k that come out, nor be the threshold after them."""

    def __init__(self, key: int, k: int):
        self.key, self.k, self.frontier, self.order, self.draws, self.paths = np.uint64(key & (1 << 64) - 1), k, [], 0, 0, []
        self.top = float(gumbels(np.zeros(1), self.draw(1))[0])

    def draw(self, n: int) -> np.ndarray:
        self.draws += 1
        return uniforms(counters(self.draws, 1 << (n - 1).bit_length())[:n] ^ self.key, 1)

    def push(self, score: float, path: Path, place: int, edge: int) -> None:
        self.order += 1
        heapq.heappush(self.frontier, (-score, self.order, path, place, edge))

    @staticmethod
    def rest(path: Path, place: int) -> float:
        """Log mass of what leaves the path from this place on."""
        gap = path.before[-1] - path.before[place]
        return path.before[place] + math.log(-math.expm1(gap)) if gap < -1e-15 else -math.inf

    def under(self, masses: np.ndarray, bound: float) -> np.ndarray:
        """Gumbels of these log masses, each truncated at the bound."""
        return -np.logaddexp(-bound, -gumbels(masses, self.draw(len(masses))))

    def add(self, path: Path, place: int) -> None:
        self.paths.append(path)
        mass = self.rest(path, place)
        if mass > -math.inf:
            self.push(float(self.under(np.array([mass]), path.score)[0]), path, place, -1)

    def next_branch(self, lattice: Lattices) -> tuple[Path, int, int, float] | None:
        """Splits sets until a branch is the best; None if the lattice has no more segmentations."""
        while self.frontier:
            score, _, path, place, edge = heapq.heappop(self.frontier)
            if edge >= 0:
                return path, place, edge, -score
            stop = min(place + SPLIT, len(path.edges))
            nodes = lattice.start[path.edges[place:stop]]
            heads = lattice.first[nodes]
            sizes = lattice.first[nodes + 1] - heads
            edges = np.repeat(heads - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            where = np.repeat(np.arange(place, stop), sizes)
            other = edges != path.edges[where]
            edges, where = np.append(edges[other], -1), np.append(where[other], stop)
            masses = path.before[where] + lattice.log_p[edges]
            masses[-1] = self.rest(path, stop) if stop < len(path.edges) else -math.inf
            if masses.max() == -math.inf:
                continue
            # The part that attains the set's score, by mass; the others stay below it.
            uniform = self.draw(2 * len(masses))
            best = int(np.argmax(gumbels(masses, uniform[::2])))
            scores = -np.logaddexp(score, -gumbels(masses, uniform[1::2]))
            scores[best] = -score
            for i in np.argsort(-scores)[: self.k]:
                if scores[i] > -math.inf:
                    self.push(float(scores[i]), path, int(where[i]), int(edges[i]))
        return None


def inclusion(path: Path, threshold: float | None) -> float:
    """Log probability that a segmentation's perturbed score passes the threshold; 0 if there is no other segmentation."""
    if threshold is None:
        return 0.0
    x = path.before[-1] - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700))))


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = out = len(self)
        return out


class Texts:
    """The units of a batch of texts, and its lattices."""

    def __init__(self, texts: list[str], keys: list[int], vocabulary: Vocabulary):
        units = units_of(texts)
        self.vocabulary, self.keys = vocabulary, keys
        self.lattice = Lattices(units, vocabulary)
        self.unit, self.n_units = units.unit, units.n
        self.unit_end = np.cumsum(self.n_units)
        size = np.diff(self.lattice.begin)[self.unit] - 1
        self.place = np.cumsum(size) - size  # of each unit's first character in the batch
        self.chars = int(size.sum())
        text_begin = np.append(self.place, self.chars)[self.unit_end - self.n_units]
        self.text_range = np.append(text_begin, self.chars)
        base = np.array([k & (1 << 64) - 1 for k in keys], np.uint64)
        index = np.arange(len(self.unit)) - np.repeat(self.unit_end - self.n_units, self.n_units)
        self.unit_key = mix64(np.repeat(base, self.n_units) + mix64(index.astype(np.uint64) + np.uint64(1)))

    def complete(self, units: np.ndarray, nodes: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the batch and edges, in order, of paths from a node of each of the units to its end."""
        lattice = self.lattice
        out = np.full(self.chars, -1, np.int32)
        keys, origin, step = self.unit_key[units], self.place[units] - lattice.begin[self.unit[units]], 0
        live = lattice.first[nodes + 1] > lattice.first[nodes]
        while live.any():
            keys, origin, nodes = keys[live], origin[live], nodes[live]
            edges = lattice.choose(nodes, uniforms(keys, turn << 20 | step))
            out[origin + nodes] = edges
            nodes, step = lattice.end[edges], step + 1
            live = lattice.first[nodes + 1] > lattice.first[nodes]
        places = np.flatnonzero(out >= 0)
        return places, out[places].astype(np.int64)

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids, with characters spelt in bytes."""
        piece = self.lattice.piece[edges]
        spelt = np.flatnonzero(piece < 0)
        if not len(spelt):
            return piece
        parts, last = [], 0
        for i in spelt.tolist():
            char = chr(self.lattice.codes[self.lattice.start[edges[i]]])
            parts += [piece[last:i], self.vocabulary.byte_ids[list((SPACE if char == MARK else char).encode())]]
            last = i + 1
        return np.concatenate([*parts, piece[last:]])


def sample(texts: list[str], keys: list[int], vocabulary: Vocabulary, k: int = SAMPLES) -> list[tuple[list[tuple[np.ndarray, float, float, float]]]]:
    """For each text up to k segmentations in the order of their perturbed scores: piece ids, log probability (normalised over
    the lattice), perturbed score, log inclusion probability. An empty text has the empty one alone."""
    batch = Texts(texts, keys, vocabulary)
    lattice, searches = batch.lattice, [Search(key, k + 1) for key in keys]
    places, edges = batch.complete(np.arange(len(batch.unit)), lattice.begin[batch.unit], 0)
    cuts = np.searchsorted(places, batch.text_range)
    for i, search in enumerate(searches):
        own = edges[cuts[i] : cuts[i + 1]]
        search.add(Path(own, np.concatenate(([0.0], np.cumsum(lattice.log_p[own]))), search.top), 0)
    for turn in range(1, k):
        branches = {i: b for i, s in enumerate(searches) if (b := s.next_branch(lattice))}
        if not branches:
            break
        # The rest of the branch's unit, and all units after it.
        units, nodes = [], []
        for i, (path, place, edge, _) in branches.items():
            first_unit = batch.unit_end[i] - batch.n_units[i]
            # Each unit before the branch ends where an edge of the path ends in a node without edges.
            ends = lattice.end[path.edges[:place]]
            done = int(np.count_nonzero(lattice.first[ends + 1] == lattice.first[ends]))
            units.append(np.arange(first_unit + done, batch.unit_end[i]))
            own = lattice.begin[batch.unit[units[-1]]]
            own[0] = lattice.end[edge]
            nodes.append(own)
        places, edges = batch.complete(np.concatenate(units), np.concatenate(nodes), turn)
        cuts = np.searchsorted(places, batch.text_range)
        for i, (path, place, edge, score) in branches.items():
            own = np.concatenate((path.edges[:place], [edge], edges[cuts[i] : cuts[i + 1]]))
            searches[i].add(Path(own, np.concatenate(([0.0], np.cumsum(lattice.log_p[own]))), score), place + 1)
    out = []
    for search in searches:
        threshold = -search.frontier[0][0] if search.frontier else None
        out.append([(batch.ids(p.edges), float(p.before[-1]), p.score, inclusion(p, threshold)) for p in search.paths])
    return out


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    """The text that the pieces spell; the space before it is dropped."""
    spelt = b"".join(map(vocabulary.spelling.__getitem__, ids)).decode(errors="replace")
    return spelt[1:] if spelt[:1] == " " else spelt


def spell(ids: list[np.ndarray], texts: list[str], vocabulary: Vocabulary) -> list[bool]:
    """Whether each of the segmentations spells its text, byte for byte: all of them are spelt at once, and told apart only if anything differs."""
    want = b"".join([f" {t}".encode() if t else b"" for t in texts])
    flat = np.concatenate([*ids, np.empty(0, np.int32)])
    n_bytes = np.diff(vocabulary.blob_at)[flat]
    ends = np.cumsum(n_bytes, dtype=np.int64)
    got = vocabulary.blob[np.repeat((vocabulary.blob_at[flat] - (ends - n_bytes)).astype(np.int32), n_bytes) + np.arange(int(n_bytes.sum()), dtype=np.int32)]
    each = np.append(0, ends)[np.cumsum([len(x) for x in ids])]
    if len(want) == len(got) and np.array_equal(np.frombuffer(want, np.uint8), got) and each.tolist() == np.cumsum([len(t.encode()) + bool(t) for t in texts]).tolist():
        return [True] * len(ids)
    return [decode(x.tolist(), vocabulary) == t for x, t in zip(ids, texts, strict=True)]


def segment(docs: DataFrame, text_col: str, key: Column, *keep: Column, k: int = SAMPLES, model: str = MODEL, with_ids: bool = False, chunk: int = CHUNK) -> DataFrame:
    """The columns `keep` with sample (from 0), n_pieces, log_prob, perturbed, log_inclusion, ids_sha256 and decodes, one row for each segmentation.

    key seeds what is drawn; rows with equal key and text get the same. decodes: whether the pieces give the text
    back, byte for byte. Null texts count as empty, which has one segmentation, into no pieces. with_ids adds the ids.
    chunk: bytes of text that share their units' lattices; fewer take less memory and more time, for the same rows. A kept column with the name of a result gets an underscore after it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(model))
    names = ["sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_sha256", "decodes"] + ["ids"] * with_ids
    chosen, kept = keeping(docs, keep, {"__key": F.xxhash64(key), "__text": F.col(text_col).cast("string")}, names)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for part in text_chunks(batches, "__text", chunk):
            texts = [t or "" for t in part.column("__text").to_pylist()]
            found = sample(texts, part.column("__key").to_pylist(), vocabulary, k)
            owner = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = [(i, t, *x) for t, own in zip(texts, found, strict=True) for i, x in enumerate(own)]
            columns = [
                pa.array([f[0] for f in flat], pa.int32()),
                pa.array([len(f[2]) for f in flat], pa.int64()),
                *(pa.array([f[j] for f in flat], pa.float64()) for j in (3, 4, 5)),
                pa.array([hashlib.sha256(f[2].astype("<i4").tobytes()).hexdigest() for f in flat], pa.string()),
                pa.array(spell([f[2] for f in flat], [f[1] for f in flat], vocabulary), pa.bool_()),
            ]
            if with_ids:
                ends = np.cumsum([0, *(len(f[2]) for f in flat)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*(f[2] for f in flat), np.empty(0, np.int32)]), pa.int32())))
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(owner) for i in range(len(kept))), *columns], [*kept, *names])

    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-2])
    return chosen.mapInArrow(rows, f"{shape}sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_sha256 string, decodes boolean{', ids array<int>' if with_ids else ''}")


def segment_documents(docs: DataFrame, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """Sampled segmentations of every document's whole text, seeded by doc_id."""
    i = F.col("doc_id").cast("long")
    return segment(docs, "text", i, i.alias("doc_id"), model=model, with_ids=with_ids)
