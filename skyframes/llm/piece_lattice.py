"""N-best SentencePiece segmentation by A-star search, and decoding.

Forward Viterbi scores over the lattice of pieces are exact heuristics for a backward A-star search, which yields
segmentations best first. No piece spans a word boundary (checked on loading), so a text's lattice falls apart at
these; each distinct stretch is searched once, and the n best of a text are the n smallest sums of the stretches'
gaps, which can only differ in the n - 1 stretches with the smallest gaps: the forward pass tells each stretch's first
gap, and the search runs in those stretches only. The ids of the others are the same in all n.

Scores: the model is a merge-ranked vocabulary without probabilities, so a piece of rank r scores as Zipf's law
has it, -log((r + 1) H). A character without a piece becomes its UTF-8 byte pieces at the lowest score less 10.

Defined results: null and empty texts have no pieces, score 0 and one segmentation; round_trip decodes the best ids and
compares with the text, so it is false for texts that hold the model's white-space mark (it decodes to a space); repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

NBEST, CACHE, TOGETHER, MARK = 4, 150_000, 24, "▁"
SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, score double, nbest_scores array<double>, nbest_pieces array<long>, nbest_crc32 array<long>, round_trip boolean"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_first = itemgetter(0)


class Lattice:
    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        n = model.get_piece_size()
        harmonic = math.log(sum(1 / (r + 1) for r in range(n)))
        self.surface: list[bytes] = [b""] * n
        self.pieces: dict[str, tuple[tuple[int, ...], float]] = {}
        self.bytes = [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rank = min(n - 1, max(0, -int(model.get_score(i))))
                self.pieces[piece] = ((i,), -math.log(rank + 1) - harmonic)
                self.surface[i] = piece.encode("utf-8", "surrogatepass")
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece spans a word boundary")
        self.low = min(s for _, s in self.pieces.values()) - 10
        self.longest = max(map(len, self.pieces))
        self.reach: dict[str, int] = {}  # by a piece's first three characters, the longest such piece
        for p in self.pieces:
            if len(p) > 2:
                self.reach[p[:3]] = max(self.reach.get(p[:3], 0), len(p))
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        breaks = "" if any("\n" in p for p in self.pieces) else "\n"
        marks = re.escape("".join(sorted(self._apart())))
        apart = rf"{MARK}*[{marks}]+|" if marks else ""
        self.stretch = re.compile(rf"{MARK}?[^{MARK}{breaks}{marks}]+|{MARK}*[^{MARK}{breaks}{marks}]+|{apart}{MARK}+" + (r"|\n" if breaks else ""))

    def _apart(self) -> set[str]:
        """ASCII characters other than letters, and those that share pieces with them, if all of these keep apart from the rest.

        They stand in pieces with each other and the white-space mark only.
        """
        out = {c for p in self.pieces for c in p if not c.isalpha() and c not in f"{MARK}\n"}
        while mixed := {c for a, b in self.pairs for c, x in ((a, b), (b, a)) if c in out and x not in out and x != MARK}:
            out -= mixed
        near = {c for c in out if c.isascii()}
        while more := {x for a, b in self.pairs for c, x in ((a, b), (b, a)) if c in near and x not in near and x != MARK}:
            near |= more
        return near

    def split(self, text: str) -> list[str]:
        return self.stretch.findall(MARK + text.replace(" ", MARK)) if text else []

    def arcs_from(self, stretch: str, i: int) -> list[tuple[int, tuple[int, ...], float]]:
        """(end, ids, score) of the pieces that start at ``i``."""
        get = self.pieces.get
        found = get(stretch[i])
        if found is None:
            found = (tuple(self.bytes[b] for b in stretch[i].encode("utf-8", "surrogatepass")), self.low)
        out = [(i + 1, *found)]
        if (pair := stretch[i : i + 2]) in self.pairs:
            if found := get(pair):
                out.append((i + 2, *found))
            for j in range(i + 3, min(len(stretch), i + self.reach.get(stretch[i : i + 3], 0)) + 1):
                if found := get(stretch[i:j]):
                    out.append((j, *found))
        return out

    def best_two(self, stretch: str) -> tuple[float, tuple[int, ...], float]:
        """(score, ids) of the best segmentation and the score of the second, by the forward pass alone."""
        size = len(stretch)
        best, second, back = [0.0] + [-math.inf] * size, [-math.inf] * (size + 1), [None] * (size + 1)
        get, pairs, reach = self.pieces.get, self.pairs, self.reach.get
        for i in range(size):  # as arcs_from, without its lists: this is the hot loop
            one, two, j, last = best[i], second[i], i + 1, i + 1
            found = get(stretch[i])
            if found is None:
                found = (tuple(self.bytes[b] for b in stretch[i].encode("utf-8", "surrogatepass")), self.low)
            if stretch[i : i + 2] in pairs:
                last = max(i + 2, min(size, i + reach(stretch[i : i + 3], 0)))
            while True:
                if found is not None:
                    v = one + found[1]
                    if v > best[j]:
                        second[j] = max(best[j], two + found[1])
                        best[j], back[j] = v, (i, found[0])
                    elif v > second[j]:
                        second[j] = v
                if j == last:
                    break
                j += 1
                found = get(stretch[i:j])
        ids: tuple[int, ...] = ()
        at = size
        while at:
            at, part = back[at]
            ids = part + ids
        return best[size], ids, second[size]

    def nbest(self, stretch: str, n: int = NBEST) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids), best first; equal scores in the order of the search."""
        size = len(stretch)
        best = [0.0] + [-math.inf] * size
        arcs: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            for j, ids, score in self.arcs_from(stretch, i):
                arcs[j].append((i, ids, score))
                best[j] = max(best[j], best[i] + score)
        out: list[tuple[float, tuple[int, ...]]] = []
        if not size:
            return [(0.0, ())]
        order: list = [None] * (size + 1)

        def sorted_arcs(at: int) -> list[tuple[float, int, tuple[int, ...], float]]:
            if order[at] is None:
                order[at] = sorted(((-(score + best[i]), i, ids, score) for i, ids, score in arcs[at]), key=_first)
            return order[at]

        # an entry stands for its arc and for the worse arcs into the same node, which follow when it is popped
        heap: list = [(sorted_arcs(size)[0][0], 0, size, 0, 0.0, None)]
        tick = 0
        while heap and len(out) < n:
            _, _, at, k, done, link = heapq.heappop(heap)
            into = sorted_arcs(at)
            if k + 1 < len(into):
                tick += 1
                heapq.heappush(heap, (into[k + 1][0] - done, tick, at, k + 1, done, link))
            _, i, ids, score = into[k]
            done, link = done + score, (ids, link)
            if i:
                tick += 1
                heapq.heappush(heap, (sorted_arcs(i)[0][0] - done, tick, i, 0, done, link))
            else:
                found_ids: list[int] = []
                while link:
                    found_ids.extend(link[0])
                    link = link[1]
                out.append((done, tuple(found_ids)))
        return out

    def cut(self, stretch: str) -> list[str]:
        """Parts that no piece joins: adjacent characters at a cut stand in no piece together."""
        at = [0, *(i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in self.pairs), len(stretch)]
        return [stretch[a:b] for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids) -> str:
        """The text of the ids: marks become spaces, byte pieces UTF-8, and the first space goes."""
        data = b"".join(map(self.surface.__getitem__, ids))
        return data.decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


class Trie:
    """The pieces as a trie in flat arrays: transitions are a hash table from (node, character) to node."""

    BITS = 19

    def __init__(self, pieces: dict[str, tuple[tuple[int, ...], float]]):
        edges: dict[tuple[int, int], int] = {}
        ends: list[tuple[int, int, float]] = []
        for piece, (ids, score) in pieces.items():
            node = 0
            for c in map(ord, piece):
                node = edges.setdefault((node, c), len(edges) + 1)
            ends.append((node, ids[0], score))
        if len(edges) > 1 << (self.BITS - 1):
            raise ValueError("too many pieces for the table")
        self.piece, self.score = np.full(len(edges) + 1, -1, np.int32), np.full(len(edges) + 1, -np.inf)
        for node, i, score in ends:
            self.piece[node], self.score[node] = i, score
        self.keys, self.next = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, -1, np.int32)
        keys = np.array([n << 21 | c for n, c in edges], np.int64)
        at, todo, child = self._slot(keys), np.arange(len(keys)), np.fromiter(edges.values(), np.int32, len(edges))
        while len(todo):  # each round, one of the keys that want a free slot gets it
            free = self.keys[at[todo]] < 0
            self.keys[at[todo[free]]] = keys[todo[free]]
            won = self.keys[at[todo]] == keys[todo]
            self.next[at[todo[won]]] = child[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.BITS) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes behind ``chars`` (-1: none)."""
        out = np.full(nodes.shape, -1, np.int32)
        todo = np.flatnonzero(nodes >= 0)
        keys = (nodes.ravel()[todo].astype(np.int64) << 21) | chars.ravel()[todo]
        at, flat = self._slot(keys), out.ravel()
        while len(todo):
            found = self.keys[at]
            hit = found == keys
            flat[todo[hit]] = self.next[at[hit]]
            go = ~hit & (found >= 0)
            todo, keys, at = todo[go], keys[go], (at[go] + 1) & ((1 << self.BITS) - 1)
        return flat.reshape(nodes.shape)


def best_two_of_many(stretches: list[str], trie: Trie, low: float, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For stretches of one length: (score, second score, piece ids right-aligned with -2 before them, whether all characters are in pieces).

    The forward pass of ``Lattice.best_two``, one step of all stretches at a time.
    """
    n, size = len(stretches), len(stretches[0])
    chars = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.int64)
    state, scores, pieces = np.zeros((n, size), np.int32), [], []
    for k in range(min(size, longest)):
        state = trie.step(state[:, : size - k], chars[:, k:])
        scores.append(np.where(state >= 0, trie.score[state], -np.inf))
        pieces.append(np.where(state >= 0, trie.piece[state], -1))
    known = (pieces[0] >= 0).all(axis=1)
    scores[0] = np.where(pieces[0] >= 0, scores[0], low)
    best, second, step = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int64)
    best[0] = 0
    for i in range(size):
        for k in range(min(len(scores), size - i)):
            s, j = scores[k][:, i], i + k + 1
            v = best[i] + s
            better = v > best[j]
            second[j] = np.where(better, np.maximum(best[j], second[i] + s), np.maximum(second[j], v))
            best[j] = np.where(better, v, best[j])
            step[j] = np.where(better, k + 1, step[j])
    ids, at, row = np.full((n, size), -2, np.int32), np.full(n, size), np.arange(n)
    for place in range(size - 1, -1, -1):
        live = np.flatnonzero(at > 0)
        if not len(live):
            break
        width = step[at[live], live]
        at[live] -= width
        for k in np.unique(width):
            mine = live[width == k]
            ids[mine, place] = pieces[k - 1][mine, at[mine]]
    return best[size], second[size], ids[row], known


def smallest_sums(gaps: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n smallest sums with one gap of each list (each begins with 0), with the choices."""
    out: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for g in gaps:
        out = heapq.nsmallest(n, [(t + x, (*c, k)) for t, c in out for k, x in enumerate(g)])
    return out


class Encoder:
    """Documents' best ids and n-best scores, through a cache of stretches of two generations of bounded size."""

    def __init__(self, path: str | None = None, n: int = NBEST):
        self.lattice, self.n = Lattice(path), n
        self.trie = Trie(self.lattice.pieces)
        self.searched: dict[str, list[tuple[float, bytes]]] = {}
        self.reset()

    def reset(self) -> None:
        """A new generation: a number per stretch, and by number the best ids, score and first gap."""
        self.old = (self.index, self.ids, self.scores, self.first) if hasattr(self, "index") else ({}, [], array("d"), array("d"))
        self.index: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.scores, self.first = array("d"), array("d")

    def solve(self, stretch: str) -> int:
        """The number of a stretch: its best ids as little-endian i4, score, first gap."""
        if (at := self.index.get(stretch)) is not None:
            return at
        if (at := self.old[0].get(stretch)) is not None:
            found = tuple(x[at] for x in self.old[1:])
        else:
            parts = self.lattice.cut(stretch)
            if len(parts) == 1:
                top, ids, second = self.lattice.best_two(stretch)
                found = (array("i", ids).tobytes(), top, top - second)
            else:
                rows = [self.solve(p) for p in parts]
                found = (b"".join([self.ids[r] for r in rows]), math.fsum(self.scores[r] for r in rows), min(self.first[r] for r in rows))
        for to, value in zip((self.ids, self.scores, self.first), found, strict=True):
            to.append(value)
        at = self.index[stretch] = len(self.ids) - 1
        return at

    def solve_many(self, stretches: set[str]) -> None:
        """Number new stretches: short ones of a length together, the others one by one."""
        by_size: dict[int, list[str]] = {}
        for x in stretches:
            if len(x) > TOGETHER or x in self.old[0]:
                self.solve(x)
            else:
                by_size.setdefault(len(x), []).append(x)
        for group in by_size.values():
            score, second, ids, known = best_two_of_many(group, self.trie, self.lattice.low, self.lattice.longest)
            starts = (ids == -2).sum(axis=1).tolist()
            for x, a, b, row, start, whole in zip(group, score.tolist(), (score - second).tolist(), ids, starts, known.tolist(), strict=True):
                if not whole:
                    self.solve(x)
                    continue
                self.index[x] = len(self.ids)
                self.ids.append(row[start:].tobytes())
                self.scores.append(a)
                self.first.append(b)

    def gaps(self, stretch: str) -> list[tuple[float, bytes]]:
        """The n best segmentations by the search: distance from the best score, ids as little-endian i4."""
        if (found := self.searched.get(stretch)) is None:
            if len(self.searched) > CACHE:
                self.searched.clear()
            lists = [self.lattice.nbest(part, self.n) for part in self.lattice.cut(stretch)]
            sums = smallest_sums([[x[0][0] - s for s, _ in x] for x in lists], self.n)
            found = self.searched[stretch] = [(s, b"".join([array("i", x[k][1]).tobytes() for x, k in zip(lists, picks, strict=True)])) for s, picks in sums]
        return found

    @staticmethod
    def distinct(best: bytes, found: list[tuple[float, bytes]]) -> list[bytes]:
        """The ids of a stretch's n best with the forward pass's first, which may be another of equal score."""
        ids = [x for _, x in found]
        if best != ids[0]:
            ids[ids.index(best) if best in ids else 0] = ids[0]
            ids[0] = best
        return ids

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, float, list[float], bool]]:
        """(best ids as little-endian i4, score, n-best scores, whether the ids decode to the text) of each text."""
        return [(ids[0], scores[0], scores, sound) for ids, scores, sound in self.nbest(texts)]

    def nbest(self, texts: list[str | None]) -> list[tuple[list[bytes], list[float], bool]]:
        """(ids of the n best as little-endian i4, their scores, whether the best ids decode to the text) of each text."""
        if len(self.index) > CACHE:
            self.reset()
        docs = [self.lattice.split(t or "") for t in texts]
        self.solve_many(set().union(*docs).difference(self.index))
        get, ids, m, out = self.index.__getitem__, self.ids.__getitem__, self.n - 1, []
        scores, first = np.frombuffer(self.scores), np.frombuffer(self.first)
        for text, doc in zip(texts, docs, strict=True):
            if not doc:
                out.append(([b""], [0.0], True))
                continue
            rows = list(map(get, doc))
            at = np.array(rows)
            score, pick = float(scores[at].sum()), range(len(rows))
            if m and len(rows) > m:
                gaps = first[at]
                last = np.partition(gaps, m - 1)[m - 1]
                pick = np.concatenate([np.flatnonzero(gaps < last), np.flatnonzero(gaps == last)])[:m].tolist()
            parts = list(map(ids, rows))
            found, best = [], [b"".join(parts)]
            sums = [(0.0, ())]
            if m:
                found = [self.gaps(doc[i]) for i in pick]
                sums = smallest_sums([[s for s, _ in x] for x in found], self.n)
                # the best ids stand between the searched stretches; equal scores keep the forward pass's choice for the best
                places = sorted(range(len(found)), key=lambda k: pick[k])
                edges = [-1, *(pick[k] for k in places), len(parts)]
                between = [b"".join(parts[a + 1 : b]) for a, b in itertools.pairwise(edges)]
                chosen = [self.distinct(parts[pick[k]], found[k]) for k in range(len(found))]
                for _, picks in sums[1:]:
                    best.append(between[0] + b"".join([chosen[k][picks[k]] + x for k, x in zip(places, between[1:], strict=True)]))
            out.append((best, [score - s for s, _ in sums], self.lattice.decode(array("i", best[0])) == text))
        return out


def _encode(path: str | None, n: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, n)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = encoder.nbest(part.column(1).to_pylist())
                columns = [
                    part.column(0), pa.array([len(r[0][0]) // 4 for r in rows], pa.int64()), pa.array([zlib.crc32(r[0][0]) for r in rows], pa.int64()), pa.array([r[1][0] for r in rows], pa.float64()),
                    pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([[len(x) // 4 for x in r[0]] for r in rows], pa.list_(pa.int64())),
                    pa.array([[zlib.crc32(x) for x in r[0]] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.bool_()),
                ]
                names = ["doc_id", "n_pieces", "ids_crc32", "score", "nbest_scores", "nbest_pieces", "nbest_crc32", "round_trip"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(r[0][0], "<i4") for r in rows], pa.list_(pa.int32())))
                    columns.append(pa.array([[np.frombuffer(x, "<i4") for x in r[0]] for r in rows], pa.list_(pa.list_(pa.int32()))))
                    names += ["piece_ids", "nbest_ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def segment(docs: DataFrame, text: str = "text", model: str | None = None, n: int = NBEST, with_ids: bool = False) -> DataFrame:
    """A row per document: pieces of the best segmentation, its score, the n best segmentations with their scores, and the round trip.

    One pass over the texts, nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encode(model, n, with_ids), SCHEMA + (", piece_ids array<int>, nbest_ids array<array<int>>" if with_ids else ""))


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(table(spark, sf_dir, "documents"))
