"""Language-model scoring by logistic context mixing.

A text is cut in units, a word with the white space byte (or the text's end) after it. Bytes are coded as bits along Huffman trees, one for each
frequent pair of bytes before, else one for the byte before. Five contexts have counts of the bits at each of their nodes, summed
over the training documents: the last 2, 3 and 5 bytes of the unit and the byte before it; all of the unit so far; for about three
letters the word before, then the last 4 bytes. The predictors' log-odds are mixed by weights that a gate
chooses (how many of the longer contexts have been seen), the weights learn from every bit already coded of the document, 64 bits at a
time (128 and 512 further on), and the mixed probability is refined by adaptive counts of its own calibration. The score
is the log10 probability of the text with an end mark.

Documents are gathered in blocks of either training or held-out texts, each written once to the shared folder. A block sends each of
its contexts and symbols once, with its own counts, to buckets of the context's hash, and gets the log-odds of
the nodes back in the same order. All that is counted grows with the corpus: a context's key has
32 bits besides those that choose the bucket, and buckets are of bounded size. A training text is scored by the counts of all training texts
outside its own block, as its own counts would tell it what it holds; a held-out text by those of all training texts.
Words and their counts go the same way, as whole words, so base scores are exact. The driver holds byte counts only.
Within a block units and contexts are worked on once each, so the work on a text is little more than mixing.

Defined results: null text is empty (one token, the end); a null doc_id counts as the empty text, which is a
training document; repeated rows are scored each; without training documents (outside the block) all counts are 0 and all bits
even; a text lies in one block, whatever its length.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, groups, make_dir, materialize, open_store, scratch, table, write_file

FOLDS, HELD_OUT = 5, 1
N_CONTEXTS, FOUR, PAIRS, WORDS = 5, 4, 5, 6  # kinds of entries: 2, 3 and 5 bytes, the unit so far, 4 bytes, the word before, words
UNIT, WIDEST, NARROWER, WIDTHS = 3, 2, (0, 1, 4), {0: (1, 2), 1: (2, 3), 2: (3, 5), 4: (4, 4)}  # of contexts of bytes, their order and length
FEWER = (6, 5, 3, 2, 4, 1, 3)  # a kind has so many bits of buckets less, as it has fewer entries
BLOCK_BYTES, BLOCKS_AT_LEAST, BUCKET_BYTES, CHUNK_BYTES = 1 << 23, 64, 1 << 22, 1 << 17
TREES = 1 << 14  # pairs of bytes with less than this part of all have the tree of the byte before
KEY_BITS, PATH_BITS, FAST_BITS, LETTERS, PAD = 32, 30, 24, 3, 5
GATES, RATE, PRIOR, START = 4, 1.6, 30.0, (0.1, 0.1, 0.1, 0.4, 0.4)
SCALE, BUCKETS, APM_PRIOR = 8.0, 33, 12.0
COLUMNS, Y, BIAS = 8, 5, 6  # of a row of a bit: a context each, the bit, a constant, none
GROUP_BITS, GROUP_TEXTS, PART_BITS = 1 << 21, 1024, 1 << 17
SCORED = "kind int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, bits double, n_bytes long"
U64 = np.uint64


class Code:
    """Huffman codes of bytes by tree: lengths, codes and their ranks.

    ``alone`` counts (byte before, byte); ``pairs`` holds counts for some pairs of bytes before (the nearer one lowest).
    Each byte counts as 2^-13 of its tree's sum at least, which bounds the lengths to 21.
    """

    def __init__(self, alone: np.ndarray, pairs: dict[int, np.ndarray]):
        self.tree = np.tile(np.arange(256, dtype=np.uint32), 256)
        rows = [*alone, *pairs.values()]
        for i, pair in enumerate(pairs):
            self.tree[pair] = 256 + i
        common = np.argsort(np.argsort(alone.sum(axis=0), kind="stable"), kind="stable")
        self.lens, self.codes, self.ranks = (np.empty(len(rows) * 256, t) for t in (np.uint8, np.uint32, np.uint8))
        for i, row in enumerate(rows):
            mine = slice(256 * i, 256 * i + 256)
            self.lens[mine], self.codes[mine] = self._tree(row.astype(np.float64), common)
            self.ranks[mine] = np.argsort(np.argsort(paths(self.codes[mine], self.lens[mine])))

    @staticmethod
    def _tree(counts: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        floor = max(counts.sum(), 1) / (1 << 13)
        heap = [(max(c, floor), r, i) for i, (c, r) in enumerate(zip(counts.tolist(), common.tolist(), strict=True))]
        heapq.heapify(heap)
        parent, side = [0] * 511, [0] * 511
        for node in range(256, 511):
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[2]] = parent[b[2]] = node
            side[b[2]] = 1
            heapq.heapreplace(heap, (a[0] + b[0], node, node))
        lens, codes = [0] * 511, [0] * 511
        for node in range(509, -1, -1):
            up = parent[node]
            lens[node], codes[node] = lens[up] + 1, codes[up] << 1 | side[node]
        return np.array(lens[:256], np.uint8), np.array(codes[:256], np.uint32)


def paths(codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Codes from the left of PATH_BITS, each ended by a one."""
    return (codes << np.uint32(1) | np.uint32(1)) << (np.uint32(PATH_BITS - 1) - lens.astype(np.uint32))


def path_lengths(of: np.ndarray) -> np.ndarray:
    """How many bits come before the one that ends a path."""
    low = (of & (~of + np.uint32(1))).astype(np.float32)
    return (PATH_BITS - 1 + 127 - (low.view(np.uint32) >> np.uint32(23)).astype(np.int32)).astype(np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(29)
    return x


BYTES = _mixed(np.arange(1, 257, dtype=U64))


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for ``len`` numbers, one row after another."""
    ends = np.cumsum(lens, dtype=np.int64)
    out = np.repeat(starts - (ends - lens), lens)
    out += np.arange(len(out))
    return out


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the place of one of each of the hashes, of each place the number of its hash); a hash may, seldom, have two numbers."""
    bits = U64(max(1, int(len(h) - 1).bit_length()))
    s = h >> bits
    s <<= bits
    s |= np.arange(len(h), dtype=U64)
    s.sort()
    place = (s & ((U64(1) << bits) - U64(1))).astype(np.int64)
    s = h[place]
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    of = np.empty(len(h), np.int64)
    of[place] = np.cumsum(new) - 1
    return place[new], of


class Block:
    """The units of some texts: which are distinct, their bytes' contexts and codes, and what they follow."""

    def __init__(self, texts: list[bytes], code: Code):
        self.buffer = np.frombuffer(b"\x00" + b"\x00".join(texts) + b"\x00", np.uint8)  # a text's first byte has a zero before it
        sizes = np.array([len(t) + 1 for t in texts])
        hashes, words, lens, starts = self._units(sizes)
        ends = np.cumsum(sizes) + 1
        self.text_units = np.searchsorted(starts, ends)  # the units before each text's end
        first, self.unit = _distinct(hashes)
        self.counts = np.bincount(self.unit, minlength=len(first))
        self.lens = lens[first]
        self.weights = np.repeat(self.counts, self.lens)
        self.starts = np.cumsum(self.lens) - self.lens
        # the distinct units' bytes, each unit after PAD bytes of which the last is the byte before it
        padded = self.lens + PAD
        buffer = np.zeros(int(padded.sum()), np.uint8)
        heads = np.cumsum(padded) - padded
        at = _spread(heads + PAD, self.lens)
        self.bytes = buffer[at] = self.buffer[_spread(starts[first], self.lens)]
        buffer[heads + PAD - 1] = self.buffer[starts[first] - 1]
        self.local = at - np.repeat(heads + PAD, self.lens)
        pair = buffer[at - 1].astype(np.uint32)
        tree = np.where(self.local == 0, pair, code.tree.take(buffer[at - 2].astype(np.uint32) << np.uint32(8) | pair))
        symbol = tree << np.uint32(8) | self.bytes
        self.code_lens, codes, self.ranks = code.lens.take(symbol), code.codes.take(symbol), code.ranks.take(symbol)
        self.paths = paths(codes, self.code_lens)
        self.tree = tree
        # the 8 bytes before each byte, the nearest one highest
        self._back = np.ndarray(len(buffer), "<u8", b"\x00" * 8 + buffer.tobytes(), strides=(1,))[at]
        # the first letters in one path
        self.first_paths, self.first_bits = self._first_letters(codes)
        # the word before, of each unit within its text
        real = np.where(lens > 1, np.arange(len(lens)), -1)
        last = np.maximum.accumulate(np.concatenate([[-1], real[:-1]]))
        begin = np.repeat(np.concatenate([[0], self.text_units[:-1]]), np.diff(self.text_units, prepend=0))
        self.before = np.where(last >= begin, words[last], U64(0))

    def _units(self, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hash of each unit with the byte before it, hash of its word, length, start), a chunk of texts at a time."""
        out: list[tuple] = []
        buffer, at = self.buffer, 1
        ends = (np.cumsum(sizes) + 1).tolist()
        i = 0
        while i < len(ends):
            j = i + 1
            while j < len(ends) and ends[j] - at <= CHUNK_BYTES:
                j += 1
            data = buffer[at : ends[j - 1]]
            stop = (data <= 32) & ((data == 32) | ((data >= 9) & (data <= 13)))
            stop[np.array(ends[i:j]) - at - 1] = True
            last = np.flatnonzero(stop)
            first = np.concatenate([[0], last[:-1] + 1])
            n = last - first + 1
            value = BYTES.take(data)
            value *= self._powers(int(n.max())).take(np.arange(len(data)) - np.repeat(first, n))
            total = np.zeros(len(data) + 1, U64)
            np.cumsum(value, dtype=U64, out=total[1:])
            word = total[last] - total[first]
            out.append((_mixed(total[last + 1] - total[first] + BYTES.take(buffer[at + first - 1])), word, n, first + at))
            i, at = j, ends[j - 1]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        return np.cumprod(np.full(n, U64(0x9E3779B97F4A7C15)), dtype=U64)

    def _first_letters(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, open_ = self.starts, np.ones(len(self.starts), bool)
        path, n = codes[at], self.code_lens[at].astype(np.uint32)
        for k in range(1, LETTERS):
            nxt = np.minimum(at + k, len(codes) - 1)
            more = self.code_lens[nxt].astype(np.uint32)
            open_ &= (self.lens > k) & (n + more < PATH_BITS)
            more[~open_] = 0
            path = path << more | np.where(open_, codes[nxt], np.uint32(0))
            n += more
        return paths(path, n), n.astype(np.int64)

    def context(self, kind: int, at: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of a context of each byte of the distinct units, or of those ``at`` some places."""
        if kind == UNIT:
            value = BYTES.take(self.bytes) * self._powers(int(self.lens.max())).take(self.local)
            total = np.cumsum(value, dtype=U64) - value
            return _mixed((total - np.repeat(total[self.starts], self.lens)) * U64(0x8EBC6AF09C88C6E3) + self.tree)
        order, n = WIDTHS[kind]
        return _mixed((self._back if at is None else self._back[at]) >> U64(64 - 8 * n) | U64(order << 60))

    def contexts(self) -> Iterator[np.ndarray]:
        """One context after another, of each byte of the distinct units."""
        return map(self.context, range(N_CONTEXTS))

    def entries(self, h: np.ndarray, counted: bool, some: np.ndarray | None = None, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(of each entry the place of one of its occurrences, how often it occurs if ``counted``, else of each byte the entry).

        ``h`` is of all bytes, or of those at the places ``some``, which occur ``weights`` times. An entry is a context with a symbol; they are ordered by the highest bits of the context's hash, then the symbol's path. Up to 2^24
        bytes the sorted numbers hold the place itself and 32 bits or more of the hash.
        """
        n, ranks = len(h), self.ranks if some is None else self.ranks[some]
        bits = U64(max(1, int(n - 1).bit_length()))
        if n <= 1 << FAST_BITS:
            s = h >> (U64(8) + bits)
            s <<= U64(8)
            s |= ranks
            s <<= bits
            s |= np.arange(n, dtype=U64)
            s.sort()
            place = (s & ((U64(1) << bits) - U64(1))).astype(np.int64)
            s >>= bits
            new = np.empty(n, bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
        else:
            place = np.lexsort((ranks, h))
            s, r = h[place], ranks[place]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
        at = np.flatnonzero(new)
        if counted:
            return place[at], np.add.reduceat((self.weights if weights is None else weights)[place], at)
        mine = np.empty(n, np.int32)
        mine[place] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        return place[at], mine

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys of words before, paths of first letters, how often they occur together, of each unit of the texts the pair)."""
        h, path = _mixed(self.before + U64(1)), self.first_paths[self.unit]
        first, of = _distinct(_mixed(h + path))
        h, path = h[first], path[first]
        order = np.argsort(h >> U64(PATH_BITS) << U64(PATH_BITS) | path)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        of = back[of]
        return h[order], path[order], np.bincount(of, minlength=len(order)), of

    def words(self, bits: int) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
        """(bucket, start, end) of the distinct words in lower case, of each word a unit that holds it, of each unit its word (none: -1).

        Words are in order of their hashes, which choose the bucket.
        """
        low = self.bytes + ((self.bytes >= 65) & (self.bytes <= 90)).astype(np.uint8) * np.uint8(32)
        value = BYTES.take(low) * self._powers(int(self.lens.max())).take(self.local)
        total = np.cumsum(value, dtype=U64) - value
        real = np.flatnonzero(self.lens > 1)
        of = np.full(len(self.lens), -1, np.int64)
        if not len(real):
            return [], real, of
        h = _mixed(total[(self.starts + self.lens - 1)[real]] - total[self.starts[real]])
        first, number = _distinct(h)
        order = np.argsort(h[first])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of[real] = rank[number]
        return _split(h[first[order]], bits), real[first[order]], of

    def spelling(self, units: np.ndarray) -> list[bytes]:
        """The words of some units, in lower case."""
        n = self.lens[units]
        letters = self.bytes[_spread(self.starts[units], n)]
        letters[np.cumsum(n) - 1] = 10
        return letters.tobytes()[:-1].lower().split(b"\n")


# ---- messages


def bucket_bits(size: int) -> list[int]:
    """Of each kind of entries, for a corpus of ``size`` bytes."""
    bits = max(0, (size // BUCKET_BYTES).bit_length())
    return [max(0, bits - f) for f in FEWER]


def _split(h: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of hashes that are in order by their highest bits at least, of which the bucket is a part."""
    ends = np.searchsorted(h >> U64(64 - bits), np.arange(1 << bits, dtype=U64), side="right").tolist() if bits else [len(h)]
    return [(b, a, e) for b, (a, e) in enumerate(itertools.pairwise([0, *ends])) if e > a]


def _planes(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)


def _column(planes: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack(keys: np.ndarray, path: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys as differences, paths and counts, in planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.diff(keys, prepend=U64(0)), path, counts.astype(np.uint32)))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(16, -1)
    return np.cumsum(_column(planes[:8], U64), dtype=U64), _column(planes[8:12], np.uint32), _column(planes[12:], np.uint32).astype(np.int64)


def pack_words(words: list[bytes], counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(_planes(counts.astype(np.uint32)) + b"\n".join(words) + len(words).to_bytes(4, "little"))


def unpack_words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[-4:], "little")
    return raw[4 * n : -4].split(b"\n"), _column(np.frombuffer(raw[: 4 * n], np.uint8).reshape(4, -1), np.uint32).astype(np.int64)


def messages(texts: list[bytes], training: bool, code: Code, bits: list[int]) -> Iterator[tuple[int, int, bytes]]:
    """(kind, bucket, packed entries) of a block."""
    block = Block(texts, code)

    def split(kind: int, h: np.ndarray, path: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        if not training:
            n = n * 0
        for bucket, a, e in _split(h, bits[kind]):
            yield kind, bucket, pack((h[a:e] << U64(bits[kind])) >> U64(64 - KEY_BITS), path[a:e], n[a:e])

    h = block.context(WIDEST)
    wide, often = block.entries(h, True)
    yield from split(WIDEST, h[wide], block.paths[wide], often)
    h = block.context(UNIT)
    first, n = block.entries(h, True)
    yield from split(UNIT, h[first], block.paths[first], n)
    for k in NARROWER:
        h = block.context(k, wide)
        first, n = block.entries(h, True, wide, often)
        yield from split(k, h[first], block.paths[wide[first]], n)
    yield from split(PAIRS, *block.pairs()[:3])
    buckets, units, of = block.words(bits[WORDS])
    n = np.bincount(of[of >= 0], weights=block.counts[of >= 0], minlength=len(units)).astype(np.int64) * training
    for bucket, a, e in buckets:
        yield WORDS, bucket, pack_words(block.spelling(units[a:e]), n[a:e])


class _Depths:
    """Sums of counts by node, one depth of the paths after another, over entries sorted by context and path."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, cut: np.ndarray | None = None):
        self.numbers, self.counts, self.cut = numbers, counts, cut
        self.lens = path_lengths((numbers & U64((1 << PATH_BITS) - 1)).astype(np.uint32))
        self.at = np.arange(len(numbers))

    def sums(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entries that have a bit at this depth, their node, where nodes begin, sums of zeros and of ones by node); depths in their order."""
        self.at = at = self.at[self.lens[self.at] > depth]
        x, n = self.numbers[at], self.counts[at]
        node = x >> U64(PATH_BITS - depth)
        new = np.ones(len(at), bool)
        np.not_equal(node[1:], node[:-1], out=new[1:])
        if self.cut is not None:
            cut = self.cut[at]
            new[1:] |= cut[1:] != cut[:-1]
        starts = np.flatnonzero(new)
        ones = n * (x >> U64(PATH_BITS - 1 - depth) & U64(1)).astype(np.int64)
        all_, one = (np.add.reduceat(v, starts) if len(v) else v for v in (n, ones))
        return at, np.cumsum(new) - 1, starts, all_ - one, one


def answers(packed: list[bytes]) -> list[bytes]:
    """For the blocks' entries in one bucket: the log-odds at each node of each entry's path by all other blocks' counts, in steps of 1 / SCALE.

    A node that no other block has, and those below it, have 0.
    """
    parts = [unpack(p) for p in packed]
    numbers = np.concatenate([k << U64(PATH_BITS) | p for k, p, _ in parts])
    counts = np.concatenate([n for _, _, n in parts])
    block = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _, _ in parts])
    order = np.argsort(numbers, kind="stable")  # runs in order already
    ordered = numbers[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(new)
    which = np.empty(len(numbers), np.int64)
    which[order] = np.cumsum(new) - 1
    total, own = _Depths(ordered[starts], np.add.reduceat(counts[order], starts)), _Depths(numbers, counts, block)
    ends = np.cumsum(own.lens, dtype=np.int64)
    out = np.zeros(int(ends[-1]), np.int8)
    begin = ends - own.lens
    node = np.zeros(len(starts), np.int64)
    for depth in range(int(own.lens.max())):
        at, nodes, _, zeros, ones = total.sums(depth)
        node[at] = nodes
        mine, own_nodes, first, own_zeros, own_ones = own.sums(depth)
        if not len(mine):
            break
        theirs = node[which[mine[first]]]
        zeros, ones = zeros[theirs] - own_zeros, ones[theirs] - own_ones
        odds = np.clip(np.rint(np.log((ones + 0.4) / (zeros + 0.4)) * SCALE), -127, 127).astype(np.int8)
        shared = np.flatnonzero((zeros + ones > 0)[own_nodes])
        own.at = mine = mine[shared]
        needed = np.zeros(len(nodes) and int(nodes[-1]) + 1, bool)
        needed[theirs[own_nodes[shared]]] = True
        total.at = at[needed[nodes]]
        out[begin[mine] + depth] = odds[own_nodes[shared]]
    cuts = ends[np.cumsum([len(k) for k, _, _ in parts]) - 1].tolist()
    packer = zstandard.ZstdCompressor(level=1)
    return [packer.compress(out[a:b].tobytes()) for a, b in itertools.pairwise([0, *cuts])]


def word_answers(packed: list[bytes]) -> tuple[list[bytes], int, int]:
    """(of each block its words' counts over all blocks, tokens, distinct tokens)."""
    parts = [unpack_words(p) for p in packed]
    total: dict[bytes, int] = {}
    for words, n in parts:
        for w, c in zip(words, n.tolist(), strict=True):
            if c:
                total[w] = total.get(w, 0) + c
    packer = zstandard.ZstdCompressor(level=1)
    return [packer.compress(_planes(np.array([total.get(w, 0) for w in words], np.int64))) for words, _ in parts], sum(total.values()), len(total)


# ---- mixing


def mix_costs(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log2 of the probability of each text's bits.

    ``rows`` is (text, bit, column) in steps of 1 / SCALE, zero after a text's last bit; the longest text comes first. All that is
    learnt of a text is of the text itself.
    """
    n_texts, longest, _ = rows.shape
    weights = np.tile(np.array([*START, 0], np.float32), (n_texts, GATES, 1))
    curve = np.full(weights.shape, PRIOR, np.float32)
    mid = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / 2.0))
    hits, seen = np.tile((mid * APM_PRIOR).astype(np.float32), n_texts * GATES), np.full(n_texts * GATES * BUCKETS, APM_PRIOR, np.float32)
    first = (np.arange(n_texts, dtype=np.int32) * (GATES * BUCKETS) + BUCKETS // 2)[:, None]
    out, at, top, half = np.zeros(n_texts), 0, np.float32(12), np.float32(BUCKETS // 2)
    while at < longest:
        step = 64 if at < 2048 else 128 if at < 8192 else 512
        live = int(np.searchsorted(-sizes, -at, side="left"))
        raw = rows[:live, at : at + step]
        width = raw.shape[1]
        inside = None if at + width <= sizes[live - 1] else np.arange(at, at + width) < sizes[:live, None]
        at += width
        x = np.empty((live, N_CONTEXTS + 1, width), np.float32)
        x[:, :N_CONTEXTS] = raw[:, :, :N_CONTEXTS].transpose(0, 2, 1)
        x[:, N_CONTEXTS] = raw[:, :, BIAS]
        x *= np.float32(1 / SCALE)
        y = raw[:, :, Y].astype(np.float32)
        gate = (raw[:, :, 2] != 0).view(np.int8) + (raw[:, :, 3] != 0) + (raw[:, :, 4] != 0)
        chosen = np.empty((live, GATES, width), np.float32)
        for g in range(GATES):
            np.equal(gate, np.int8(g), out=chosen[:, g], casting="unsafe")
        by_gate = weights[:live] @ x
        by_gate *= chosen
        z = by_gate[:, 0] + by_gate[:, 1]
        z += by_gate[:, 2]
        z += by_gate[:, 3]
        np.minimum(z, top, out=z)
        np.maximum(z, -top, out=z)
        p = np.exp(-z)
        p += np.float32(1)
        np.reciprocal(p, out=p)
        z *= 2
        np.rint(z, out=z)
        np.minimum(z, half, out=z)
        np.maximum(z, -half, out=z)
        bucket = z.astype(np.int32)
        bucket += gate.astype(np.int32) * np.int32(BUCKETS)
        bucket += first[:live]
        some = live * GATES * BUCKETS
        fine = (hits[:some] / seen[:some]).take(bucket)
        fine += p
        fine *= np.float32(0.5)
        fine += y
        fine -= np.float32(1)  # now the probability of the bit, or less it
        np.abs(fine, out=fine)
        np.maximum(fine, np.float32(1e-6), out=fine)
        np.log2(fine, out=fine)
        error = y - p
        p *= 1 - p
        if inside is not None:
            fine *= inside
            error *= inside
            p *= inside
        out[:live] += fine.sum(axis=1, dtype=np.float64)
        curve[:live] += (chosen @ p[:, :, None]) * (np.einsum("ijk,ijk->ij", x, x) / np.float32(width))[:, None, :]
        chosen *= error[:, None, :]
        weights[:live] += RATE * (chosen @ x.transpose(0, 2, 1)) / curve[:live]
        bucket += bucket
        bucket += y.astype(np.int32)
        took = np.bincount(bucket.ravel() if inside is None else bucket[inside], minlength=2 * some).reshape(-1, 2)
        hits[:some] += took[:, 1]
        seen[:some] += took[:, 0]
        seen[:some] += took[:, 1]
    return out


def unit_rows(block: Block, replies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row per bit of the distinct units, where each unit's bits begin, how many they are)."""
    lens = block.code_lens.astype(np.int64)
    ends = np.cumsum(lens)
    small = np.int32 if ends[-1] < 1 << 31 else np.int64

    def starts_of(n: np.ndarray, kind: int) -> np.ndarray:
        to = np.cumsum(n)
        if to[-1] != len(replies[kind]):
            raise ValueError("a block's texts changed between reads")
        return (to - n).astype(small)

    # the entries of the widest context have one of each narrower one, so those are looked up once for all bytes of such an entry
    wide, mine = block.entries(block.context(WIDEST), False)
    n = lens[wide]
    heads = starts_of(n, WIDEST)
    table = np.zeros((len(replies[WIDEST]), COLUMNS), np.int8)
    table[:, WIDEST], table[:, BIAS] = replies[WIDEST], 3
    within = np.arange(len(table), dtype=small) - np.repeat(heads, n)
    for k in NARROWER:
        first, of = block.entries(block.context(k, wide), False, wide)
        table[:, k] = replies[k].take(np.repeat(starts_of(n[first], k).take(of), n) + within)
    within = np.arange(int(ends[-1]), dtype=small) - np.repeat((ends - lens).astype(small), lens)
    rows = table.view(np.int64).ravel().take(np.repeat(heads.take(mine), lens) + within, mode="clip").view(np.int8).reshape(-1, COLUMNS)
    del table, heads, mine
    rows[:, Y] = np.repeat(block.paths, lens) >> (PATH_BITS - 1 - within).astype(np.uint32) & np.uint32(1)
    first, mine = block.entries(block.context(UNIT), False)
    rows[:, UNIT] = replies[UNIT].take(np.repeat(starts_of(lens[first], UNIT).take(mine), lens) + within)
    bits = np.add.reduceat(lens, block.starts)
    return rows, np.cumsum(bits) - bits, bits


def score_texts(block: Block, replies: list[np.ndarray]) -> np.ndarray:
    """log2 probability of each text, given for each kind of entries but the words the log-odds of their nodes."""
    rows, unit_starts, unit_bits = unit_rows(block, replies)
    rows = rows.view(np.int64).ravel()
    _, path, _, pair = block.pairs()
    pair_bits = path_lengths(path).astype(np.int64)
    to = np.cumsum(pair_bits)
    if to[-1] != len(replies[PAIRS]):
        raise ValueError("a block's texts changed between reads")
    pair_starts = to - pair_bits
    begin = np.concatenate([[0], block.text_units[:-1]])
    unit_ends = np.cumsum(unit_bits[block.unit])
    sizes = np.diff(unit_ends[block.text_units - 1], prepend=0)
    out = np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        n_texts = max(1, min(GROUP_TEXTS, GROUP_BITS // max(1, int(sizes[order[at]]))))
        group = order[at : at + n_texts]
        at += len(group)
        padded = np.zeros((len(group), int(sizes[group[0]])), np.int64)
        to = np.cumsum(sizes[group])
        cuts = [0, *(np.flatnonzero(np.diff(to // PART_BITS)) + 1).tolist(), len(group)]
        for a, b in itertools.pairwise(cuts):
            some = group[a:b]
            mine = _spread(begin[some], block.text_units[some] - begin[some])
            units = block.unit[mine]
            bits, n = unit_bits[units], block.first_bits[units]
            flat = rows.take(_spread(unit_starts[units], bits))
            flat.view(np.int8).reshape(-1, COLUMNS)[_spread(np.cumsum(bits) - bits, n), FOUR] = replies[PAIRS].take(_spread(pair_starts[pair[mine]], n))
            ends = np.cumsum(sizes[some]).tolist()
            for i, (x, y) in enumerate(itertools.pairwise([0, *ends])):
                padded[a + i, : y - x] = flat[x:y]
        out[group] = mix_costs(padded.view(np.int8).reshape(len(group), -1, COLUMNS), sizes[group])
    return out


def score_words(block: Block, replies: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text, without the ends: tokens, known tokens, log10 of the tokens' smoothed counts; ``replies`` are the counts of the words by bucket."""
    buckets, _, of = block.words(bits)
    if len(buckets) != len(replies):
        raise ValueError("a block's texts changed between reads")
    n = np.concatenate([np.zeros(0, np.int64), *replies, [-1]])  # the last is of units that hold no word
    logs, known = np.where(n < 0, 0, np.log10(np.maximum(n, 0) + 0.5))[of], (n > 0).astype(np.int64)[of]
    begin = np.concatenate([[0], block.text_units[:-1]])
    by_text = lambda x: np.add.reduceat(x[block.unit], begin)
    return by_text((block.lens > 1).astype(np.int64)), by_text(known), by_text(logs)


# ---- Spark


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(two bytes before and byte, count) of training texts with their ends, and as key -1 the bytes of all texts."""
    seen = np.zeros(1 << 24, np.uint32)
    held: list[bytes] = []
    size = total = 0

    def add() -> None:
        data = np.frombuffer(b"".join(held), np.uint8)
        key = data[2:].astype(np.int32)
        key |= data[1:-1].astype(np.int32) << 8
        key |= data[:-2].astype(np.int32) << 16
        if len(key) < 1 << 20:
            at, n = np.unique(key, return_counts=True)
            seen[at] += n.astype(np.uint32)
        else:
            seen[:] += np.bincount(key, minlength=1 << 24).astype(np.uint32)
        held.clear()

    for batch in batches:
        for t, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total += len(t or b"")
            if not out:
                held += (b"\x00\x00", t or b"", b"\x00")
                size += len(t or b"")
        if size >= BLOCK_BYTES:
            add()
            size = 0
    if held:
        add()
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([total, *seen[at].tolist()], pa.int64())], ["key", "n"])


def learn_code(rows: DataFrame) -> tuple[Code, int]:
    """(code of the training texts, bytes of all texts) of columns text (binary) and held_out."""
    counted = materialize(rows.select("text", "held_out").mapInArrow(_count_bytes, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "bytes")
    alone = np.zeros((256, 256), np.int64)
    for r in counted.filter("key >= 0").groupBy((F.col("key").bitwiseAND(0xFFFF)).alias("key")).agg(F.sum("n").alias("n")).collect():  # 2^16 rows at most
        alone[r["key"] >> 8, r["key"] & 255] = r["n"]
    by_pair = counted.filter("key >= 0").withColumn("pair", F.shiftright("key", 8))
    frequent = by_pair.groupBy("pair").agg(F.sum("n").alias("all")).filter(F.col("all") * TREES >= int(alone.sum()))  # TREES rows at most
    pairs: dict[int, np.ndarray] = {}
    for r in by_pair.join(F.broadcast(frequent), "pair").select("key", "n").orderBy("key").collect():
        pairs.setdefault(r["key"] >> 8, np.zeros(256, np.int64))[r["key"] & 255] = r["n"]
    size = counted.filter("key < 0").agg(F.sum("n")).first()[0] or 0
    return Code(alone, pairs), size


def blocks_of(rows: Iterator[tuple], limit: int) -> Iterator[tuple[bool, list[tuple]]]:
    """(held out, rows) of rows (doc_id, held out, text); a block is full when it has ``limit`` bytes."""
    held: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}
    for row in rows:
        held[row[1]].append(row)
        size[row[1]] += len(row[2]) + 1
        if size[row[1]] >= limit:
            yield row[1], held[row[1]]
            held[row[1]], size[row[1]] = [], 0
    for out in (False, True):
        if held[out]:
            yield out, held[out]


BLOCK_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])


def _send(shared, folder: str, limit: int, bits: list[int]):
    """Writes blocks of texts and sends their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = ((i, h, t or b"") for b in batches for i, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for seq, (out, block) in enumerate(blocks_of(rows, limit)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, BLOCK_SCHEMA, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                w.write_batch(pa.record_batch([pa.array([r[0] for r in block], pa.int64()), pa.array([r[2] for r in block], pa.binary())], schema=BLOCK_SCHEMA))
            data = sink.getvalue()
            name = f"{TaskContext.get().partitionId()}-{seq}-{'held' if out else 'train'}-{zlib.crc32(data):08x}"
            write_file(f"{folder}/{name}", iter([data]))
            del data, sink
            found = messages([r[2] for r in block], not out, shared.value, bits)
            while part := list(itertools.islice(found, 100)):
                kinds, buckets, packed = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(kinds, pa.int32()), pa.array(buckets, pa.int64()), pa.array(packed, pa.binary())], ["block", "kind", "bucket", "entries"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in groups(batches, ["kind", "bucket"]):
        kind, bucket = t["kind"][0].as_py(), t["bucket"][0].as_py()
        packed, names = t["entries"].to_pylist(), t["block"].to_pylist()
        if kind == WORDS:
            replies, tokens, distinct = word_answers(packed)
            names, replies = ["", *names], [tokens.to_bytes(8, "little") + distinct.to_bytes(8, "little"), *replies]
        else:
            replies = answers(packed)
        for i in range(0, len(replies), 500):
            n = len(replies[i : i + 500])
            yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 500]), pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int64()), pa.array(replies[i : i + 500], pa.binary())], ["block", "kind", "bucket", "reply"])


def _score_block(uri: str, held: bool, kinds: list[int], packed: list[bytes], code: Code, bits: list[int]) -> list[tuple]:
    """Rows of SCORED of a block's texts."""
    unpacker = zstandard.ZstdDecompressor()
    by: list[list[np.ndarray]] = [[] for _ in FEWER]
    for k, x in zip(kinds, packed, strict=True):  # in the order of buckets
        by[k].append(np.frombuffer(unpacker.decompress(x), np.int8))
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        table = pa.ipc.open_stream(f).read_all()
    ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
    del table
    sizes = [len(x) for x in texts]
    block = Block(texts, code)
    del texts
    words = score_words(block, [_column(x.reshape(8, -1), np.int64) for x in by[WORDS]], bits[WORDS])
    costs = score_texts(block, [np.concatenate(x) for x in by[:WORDS]])
    return [(0, i, held, *row, size) for i, size, *row in zip(ids, sizes, *(x.tolist() for x in (*words, costs)), strict=True)]


def _score(shared, folder: str, bits: list[int]):
    """Scores each block by the replies to it; as kind 1, the numbers of tokens and of distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCORED.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for t in groups(batches, ["block"]):
            name = t["block"][0].as_py()
            if not name:
                yield batch([(1, None, None, int.from_bytes(x[:8], "little"), int.from_bytes(x[8:], "little"), None, None, None) for x in t["reply"].to_pylist()])
                continue
            kinds_of, packed = t["kind"].to_pylist(), t["reply"].to_pylist()
            del t
            yield batch(_score_block(f"{folder}/{name}", "-held-" in name, kinds_of, packed, shared.value, bits))

    return run


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per document: tokens, known tokens, training tokens, base score, model score, bits per byte."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == HELD_OUT).alias("held_out"), F.col(text).cast("binary").alias("text"))
    code, size = learn_code(rows)
    bits, limit = bucket_bits(size), max(1, min(BLOCK_BYTES, size // BLOCKS_AT_LEAST))
    folder, shared = make_dir(scratch(spark, "blocks")), spark.sparkContext.broadcast(code)
    sent = rows.mapInArrow(_send(shared, folder, limit, bits), "block string, kind int, bucket long, entries binary")
    replies = sent.repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket", "block").mapInArrow(_answer, "block string, kind int, bucket long, reply binary")
    dealt = replies.repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket")
    scored = materialize(dealt.mapInArrow(_score(shared, folder, bits), SCORED), "scored")
    total, distinct = scored.filter("kind = 1").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_known"), F.lit(0))).first()
    ends = rows.filter("not held_out").count()  # an end is a token of each training text
    total, distinct = total + ends, distinct + (ends > 0)
    norm, tokens = math.log10(total + 0.5 * (distinct + 1)), F.col("n_tokens") + 1
    return scored.filter("kind = 0").select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10(ends + 0.5) - tokens * norm).alias("base_score"), (F.col("bits") * math.log10(2)).alias("score"), F.when(F.col("n_bytes") > 0, -F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
