"""Token-id files: canonical, length-limited Huffman codes from global counts, blocks with bit-offset checkpoints.

A file holds the code lengths, independent blocks of up to BLOCK ids (each starts at a byte) whose every STRIDE-th
id has its bit offset written down, and the documents' ids and lengths. Decoding runs a 2^LIMIT table over all
checkpoints of a block range at once.

Defined results: null text is empty (only the end id); documents are in ascending order of doc_id, nulls first,
repeated ids ordered by their token bytes; an empty table writes no file.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, make_dir, materialize, open_store, scratch, table, write_file

LIMIT, BLOCK, STRIDE, MAGIC = 16, 1 << 16, 128, b"SKTOKEN1"
END_ID, CACHE, TOGETHER = 2, 500_000, 1 << 22
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


BEYOND, DOTTED = re.compile(rb"[\x80-\xff]+"), "\u0130"
SPACE, LETTER, DIGIT, OTHER = range(4)
UNITS = np.array([SPACE if b == 32 or 9 <= b <= 13 else DIGIT if 48 <= b <= 57 else LETTER if 97 <= b <= 122 or b >= 128 else OTHER for b in range(256)], np.uint8)
CHUNKS = np.where(UNITS == SPACE, SPACE, LETTER).astype(np.uint8)


class ChunkTokenizer:
    """Encodes texts through a cache of white-space-free chunks, as little-endian ids of ``id_bytes``.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those of its chunks in
    order. In most texts, chunks are cut further, into the tokenizer's own units; elsewhere, punctuation behind a chunk's last
    letter is a unit of its own. Words of letters are one unit each and go through the library together. The cache has two generations of bounded size.
    """

    def __init__(self, path: str, id_bytes: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), np.dtype(f"<u{id_bytes}")
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _library(self, chunks: list[bytes]) -> None:
        words, others = [], []
        for c in chunks:
            (words if (text := c.decode("utf-8", "replace")).isalpha() else others).append((c, text))
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            found = self.tokenizer.encode(" ".join(t for _, t in part), add_special_tokens=False)
            units = np.array(found.word_ids, np.int64)
            if len(units) and units[-1] == len(part) - 1:
                ids, ends = np.array(found.ids).astype(self.kind).tobytes(), (np.searchsorted(units, np.arange(len(part) + 1)) * self.kind.itemsize).tolist()
                self.cache.update((c, ids[a:b]) for (c, _), a, b in zip(part, ends, ends[1:], strict=False))
            else:
                others.extend(part)
        for i in range(0, len(others), 2000):
            part = others[i : i + 2000]
            for (c, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                self.cache[c] = np.array(e.ids).astype(self.kind).tobytes()

    @staticmethod
    def _plain(low: bytes) -> bool:
        """Whether runs of letters, single digits and runs of other ASCII characters are the tokenizer's units.

        Not so with apostrophes (contractions), marks of special tokens, other characters than letters beyond ASCII, and
        the one letter whose lower case holds a combining dot.
        """
        if b"'" in low or b"<|" in low:
            return False
        odd = "" if low.isascii() else b"".join(set(BEYOND.findall(low))).decode("utf-8", "replace")
        return not odd or odd.isalpha() and DOTTED not in odd

    @staticmethod
    def _cut(texts: list[bytes], kinds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """(units of the texts: runs of bytes of a kind, single digits; how many each text has)."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = kinds.take(data)
        inside, new = kind != SPACE, kind == DIGIT
        new[0] = True
        new[1:] |= kind[1:] != kind[:-1]
        new &= inside
        kept, at = data[inside], np.flatnonzero(new[inside])
        units = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(kept)).astype(np.int32)), pa.py_buffer(kept)])
        ends = np.cumsum([len(t) + 1 for t in texts])
        return units.dictionary_encode(), np.diff(np.searchsorted(np.flatnonzero(new), ends), prepend=0)

    def _look_up(self, units: list[bytes]) -> list[bytes]:
        """The ids of distinct units."""
        found = list(map(self.cache.get, units))
        new = [u for u, ids in zip(units, found, strict=True) if ids is None]
        if not new:
            return found
        ends, need = {}, set()
        for c in new:
            text = c.decode("utf-8", "replace")
            stem = text if text.isalpha() or "<|" in text or DOTTED in text else text.rstrip(string.punctuation)
            if stem and stem != text and stem[-1].isalpha():
                ends[c] = pair = (stem.encode(), text[len(stem) :].encode())
                need.update(pair)
            else:
                need.add(c)
        need = {c for c in need if c not in self.cache}
        for c in need & self.old.keys():
            self.cache[c] = self.old[c]
        self._library(sorted(need.difference(self.cache)))
        self.cache.update((c, self.cache[stem] + self.cache[end]) for c, (stem, end) in ends.items())
        return list(map(self.cache.__getitem__, units))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of UTF-8 texts."""
        if len(self.cache) > CACHE:
            self.cache, self.old = {}, self.cache
        low = [(t or b"").lower() for t in texts]
        plain = np.array([self._plain(t) for t in low], bool)
        out = [b""] * len(texts)
        for kinds, some in ((UNITS, np.flatnonzero(plain)), (CHUNKS, np.flatnonzero(~plain))):
            if not len(some):
                continue
            units, counts = self._cut([low[i] for i in some], kinds)
            ids = self._look_up(units.dictionary.to_pylist())
            pool, sizes = np.frombuffer(b"".join(ids), self.kind), np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
            of = units.indices.to_numpy()
            n = sizes[of]
            to = np.cumsum(n)
            at = np.repeat((np.cumsum(sizes) - sizes)[of] - (to - n), n)
            at += np.arange(len(at))
            data, to = pool[at].tobytes(), self.kind.itemsize * np.append(0, to)[np.append(0, np.cumsum(counts))]
            for i, a, b in zip(some.tolist(), to.tolist(), to[1:].tolist(), strict=False):
                out[i] = data[a:b]
        return out


@functools.lru_cache(maxsize=1)
def _coder(path: str, id_bytes: int) -> ChunkTokenizer:
    """A worker's coder, whose cache outlives its tasks."""
    return ChunkTokenizer(path, id_bytes)


def _tokenize(path: str, id_bytes: int):
    end = np.array(END_ID).astype(f"<u{id_bytes}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, id_bytes)
        docs, texts, size = [], [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                docs.append(batch.column(0))
                texts += (part := batch.column(1).cast(pa.binary())).to_pylist()
                size += part.nbytes
            if texts and (batch is None or size >= TOGETHER):
                ids = coder.encode(texts)
                for at in range(0, len(ids), 512):
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs).slice(at, 512), pa.array([x + end for x in ids[at : at + 512]], pa.binary())], ["doc_id", "ids"])
                docs, texts, size = [], [], 0

    return run


def _count(size: int, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{id_bytes}"), minlength=size)
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return run


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Huffman code lengths of at most ``limit`` bits; 0 for ids that don't occur.

    Lengths beyond the limit are cut, then the Kraft sum is mended by lengthening the rarest codes that may grow
    and shortening frequent ones while room is left.
    """
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) <= 1:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids don't fit codes of {limit} bits")
    heap = [(int(counts[x]), i) for i, x in enumerate(ids)]
    heapq.heapify(heap)
    parent, node = np.zeros(2 * len(ids), np.int64), len(ids)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = node
        heapq.heappush(heap, (a[0] + b[0], node))
        node += 1
    depth = np.zeros(node, np.int64)
    for i in range(node - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    lens = np.minimum(depth[: len(ids)], limit)
    order = np.argsort(counts[ids], kind="stable")
    room = (1 << limit) - int((1 << (limit - lens)).sum())
    while room < 0:
        for i in order:
            if room >= 0:
                break
            if lens[i] < limit:
                room += 1 << (limit - lens[i] - 1)
                lens[i] += 1
    for i in order[::-1]:
        while lens[i] > 1 and (1 << (limit - lens[i])) <= room:
            room -= 1 << (limit - lens[i])
            lens[i] -= 1
    out[ids] = lens
    return out


def canonical_codes(lens: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lens), np.uint32)
    code = last = 0
    ids = np.flatnonzero(lens)
    for x in ids[np.argsort(lens[ids], kind="stable")]:
        code <<= int(lens[x]) - last
        last = int(lens[x])
        codes[x] = code
        code += 1
    return codes


def decode_table(lens: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for each possible next ``limit`` bits."""
    ids = np.flatnonzero(lens)
    ids = ids[np.argsort(lens[ids], kind="stable")]
    spans = 1 << (limit - lens[ids].astype(np.int64))
    symbol, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    n = int(spans.sum())
    symbol[:n], size[:n] = np.repeat(ids, spans), np.repeat(lens[ids], spans)
    return symbol, size


def encode_block(ids: np.ndarray, codes: np.ndarray, lens: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of every STRIDE-th id)."""
    n = lens[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1])
    words = np.zeros(total // 32 + 2, np.uint64)
    word, shift = starts >> 5, 64 - (starts & 31) - n
    value = codes[ids].astype(np.uint64) << shift.astype(np.uint64)  # a 64-bit window at a 32-bit step
    first = np.flatnonzero(np.diff(word, prepend=-1))
    joined = np.bitwise_or.reduceat(value, first)
    words[word[first]] |= joined >> np.uint64(32)
    words[word[first] + 1] |= joined & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[::STRIDE].astype(np.uint32)


def decode_blocks(blocks: list[tuple[bytes, int, np.ndarray]], symbol: np.ndarray, size: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The ids of (bits, number of ids, checkpoints) blocks; all checkpoints step together."""
    data = np.frombuffer(b"".join(b for b, _, _ in blocks) + bytes(8), np.uint8)
    base = np.cumsum([0, *(len(b) for b, _, _ in blocks)])[:-1]
    at = np.concatenate([c.astype(np.int64) + 8 * s for (_, _, c), s in zip(blocks, base, strict=True)])
    counts = np.concatenate([np.minimum(STRIDE, n - STRIDE * np.arange(len(c))) for _, n, c in blocks])
    out = np.zeros((len(at), STRIDE), np.uint32)
    for step in range(STRIDE):
        byte = at >> 3
        window = (data[byte].astype(np.uint32) << 16) | (data[byte + 1].astype(np.uint32) << 8) | data[byte + 2]
        key = (window >> (24 - limit - (at & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[:, step] = symbol[key]
        at = np.where(step + 1 < counts, at + size[key], at)
    return out[np.arange(STRIDE)[None, :] < counts[:, None]]


def _write(folder: str, lens: np.ndarray, id_bytes: int):
    """Blocks are laid out as they fill; the head of the file tells where the parts behind them begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        codes, docs, sizes, blocks, total = canonical_codes(lens), [], [], [], 0
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        first = next(rows, None)
        if first is None:
            return

        def body() -> Iterator[bytes]:
            nonlocal total
            yield MAGIC
            held, n, row, at = [], 0, first, len(MAGIC)
            while row is not None or n:
                if row is not None:
                    ids = np.frombuffer(row[1], f"<u{id_bytes}")
                    docs.append(row[0])
                    sizes.append(len(ids))
                    held.append(ids)
                    n += len(ids)
                    total += len(ids)
                    row = next(rows, None)
                if n >= BLOCK or row is None:
                    ids, held = np.concatenate(held), []
                    stop = len(ids) if row is None else len(ids) // BLOCK * BLOCK
                    for i in range(0, stop, BLOCK):
                        bits, marks = encode_block(ids[i : min(i + BLOCK, stop)], codes, lens)
                        blocks.append((at, len(bits), min(BLOCK, stop - i), at + len(bits)))
                        yield bits + marks.astype("<u4").tobytes()
                        at += len(bits) + 4 * len(marks)
                    held, n = ([ids[stop:]], len(ids) - stop) if stop < len(ids) else ([], 0)
            tail = zlib.compress(np.asarray(lens, np.uint8).tobytes(), 1), zlib.compress(np.array([x or 0 for x in docs], "<i8").tobytes() + bytes(x is None for x in docs) + np.array(sizes, "<u8").tobytes(), 1)
            info = json.dumps({"lens": len(tail[0]), "docs": len(tail[1]), "n_docs": len(docs), "blocks": blocks}).encode()
            yield b"".join([*tail, info, struct.pack("<QQ", sum(map(len, tail)), len(info)), MAGIC])

        path = f"{folder}/tokens-{part:06d}.bin"
        write_file(path, body())
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([path]), pa.array([len(docs)]), pa.array([total])], ["part", "path", "n_docs", "n_tokens"])

    return run


def read_file(uri: str, group: int = 16) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, number of ids, crc32 of the ids as little-endian u32) for each document of a file, in order."""
    store, path = open_store(uri)
    with store.open_input_file(path) as source:
        end = source.size()
        source.seek(end - 24)
        tail, info, magic = struct.unpack("<QQ8s", source.read(24))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        source.seek(end - 24 - info - tail)
        raw = source.read(tail)
        meta = json.loads(source.read(info))
        symbol, size = decode_table(np.frombuffer(zlib.decompress(raw[: meta["lens"]]), np.uint8))
        docs, n = zlib.decompress(raw[meta["lens"] :]), meta["n_docs"]
        ids, gone, sizes = np.frombuffer(docs[: 8 * n], "<i8"), docs[8 * n : 9 * n], np.frombuffer(docs[9 * n :], "<u8").astype(np.int64)
        doc, left, crc = 0, int(sizes[0]) if n else 0, 0
        for i in range(0, len(meta["blocks"]), group):
            part = []
            for at, width, count, marks in meta["blocks"][i : i + group]:
                source.seek(at)
                both = source.read(width + 4 * -(-count // STRIDE))
                part.append((both[:width], count, np.frombuffer(both[marks - at :], "<u4")))
            data = memoryview(decode_blocks(part, symbol, size).astype("<u4")).cast("B")
            pos = 0
            while pos < len(data):
                take = min(left, (len(data) - pos) // 4)
                crc = zlib.crc32(data[pos : pos + 4 * take], crc)
                pos, left = pos + 4 * take, left - take
                if not left:
                    yield None if gone[doc] else int(ids[doc]), int(sizes[doc]), crc
                    doc, crc = doc + 1, 0
                    left = int(sizes[doc]) if doc < n else 0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for doc, n, crc in read_file(uri):
                rows.append((doc, start, n, crc))
                start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, text: str = "text", id_bytes: int = 2, vocabulary: int = 1 << 16) -> DataFrame:
    """Write the files; the result is their manifest (part, path, n_docs, n_tokens, start), in the documents' order.

    Texts are tokenised once into a table of ids; the global counts are summed by task and then by id, and only ids
    are shuffled, by ranges of doc_id.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    bounded_batches(spark)
    make_dir(folder)
    ids = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(_tokenize(path, id_bytes), "doc_id long, ids binary")
    ids = materialize(ids, "ids", "zstd")
    counts = ids.select("ids").mapInArrow(_count(vocabulary, id_bytes), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row per id of the vocabulary at most
    total = np.zeros(vocabulary, np.int64)
    for row in counts:
        total[row["id"]] = row["n"]
    lens = code_lengths(total)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    files = materialize(ordered.mapInArrow(_write(folder, lens, id_bytes), "part long, path string, n_docs long, n_tokens long"), "token-files")
    rows, start, out = files.orderBy("part").collect(), 0, []  # a row per file
    for r in rows:
        out.append((r["part"], r["path"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return spark.createDataFrame(out, "part long, path string, n_docs long, n_tokens long, start long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    n = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("path", "start").repartition(n).mapInArrow(_read, READ_SCHEMA)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens")))
