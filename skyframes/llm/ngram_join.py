"""Near-duplicate join: MinHash banding on word five-grams, verified on the full sets.

1. Every text becomes a set of 64-bit hashes of its five-word shingles and a MinHash sketch; texts with equal sets
   are one class, and work goes on with one representative each, so copies cost one row.
2. Sketches are cut into bands; classes meet in buckets of equal band hashes. A bucket links its members to its
   smallest one (never all pairs), and connected components of these links are the candidate groups.
3. The sets of a candidate group come together once. Large groups are split into blocks, and pairs of blocks into
   tasks of bounded size; sets are compared exactly there. Verified links are counted, and their components are the
   result's classes.

Bands and rows are chosen for the recall wanted at the threshold; comparing whole groups also finds pairs that
no band has joined.

Defined results: words are runs without ASCII white space, case matters; a text of one to four words is one shingle;
null and empty texts have no shingles and are alone in their class; rows without doc_id come after all others in order,
and their class has a null id if it holds no other; rows that repeat a doc_id count one by one, whether their texts differ
or not. Class keys have 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, groups, mark_members, materialize, table

THRESHOLD, RECALL, MAX_HASHES, WINDOW = 0.8, 0.9995, 256, 5
#: A block holds about this many shingles; a document counts for at least DOC_WEIGHT.
BLOCK_WEIGHT, DOC_WEIGHT = 400_000, 500
U = np.uint64
#: Rows without doc_id are ordered as if they had this one.
LAST = (1 << 63) - 1


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with the recall wanted within ``most`` hashes."""
    fit = [(b, r) for r in range(1, 33) if (b := math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))) * r <= most]
    return max(fit, key=lambda x: x[1])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(n - 1, U(base))]).astype(np.uint64), dtype=np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER, _FAR = _powers(0x9E3779B97F4A7C15, 1 << 16), _powers(0xD6E8FEB86659FD93, 1 << 12)


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.repeat(starts, lens) + (local := np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens))
    value = (data[at].astype(np.uint64) + U(1)) * _POWER[local & 0xFFFF]
    if int(lens.max()) > 1 << 16:
        value *= _FAR[(local >> 16) & 0xFFF]
    return _mix(np.add.reduceat(value, np.cumsum(lens) - lens) + lens.astype(np.uint64) * U(0xA0761D6478BD642F))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word windows."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = len(words)
    if not n:
        return words
    factor = _powers(0xE7037ED1A0B428DB, WINDOW)
    if n < WINDOW:
        return _mix((words * factor[:n]).sum(dtype=np.uint64, keepdims=True) + U(n))
    out = np.sort(_mix(sum((words[k : n - WINDOW + 1 + k] * factor[k] for k in range(1, WINDOW)), words[: n - WINDOW + 1] * factor[0])))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


class Sketcher:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240229)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32)
        self.factor = _powers(0x8EBC6AF09C88C6E3, rows)
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit hash per band."""
        low = (hashes >> U(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), 4096):
            np.minimum(least, (low[None, i : i + 4096] * self.a + self.b).min(axis=1), out=least)
        return _mix((least.reshape(self.bands, self.rows).astype(np.uint64) * self.factor).sum(axis=1, dtype=np.uint64) + self.salt)


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sketcher = Sketcher(bands, rows)
        for batch in batches:
            keys, sizes, sketches = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text)
                keys.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                sizes.append(len(found))
                sketches.append(sketcher(found).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "text_hash", "class", "n", "bands"])

    return run


def components(links: DataFrame, name: str) -> DataFrame:
    """(u, v): each node that isn't the smallest of its component, with the smallest one.

    Large-star and small-star steps alternate until nothing changes; each round is written to the shared folder.
    """
    now, before = materialize(links.filter("u != v").select("u", "v"), name), None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now
        before = state


def _shingle_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pair of blocks that a class's set is needed in; rows that repeat it in a partition are skipped."""
    seen = set()
    for batch in batches:
        for i in range(batch.num_rows):
            group, key, size, block, blocks, text = (c[i].as_py() for c in batch.columns)
            if (group, key) in seen:
                continue
            seen.add((group, key))
            found = shingles(text).tobytes()
            for at in range(0, blocks, 64):
                others = range(at, min(blocks, at + 64))
                n = len(others)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * n), pa.array([min(block, x) for x in others], pa.int64()), pa.array([max(block, x) for x in others], pa.int64()), pa.array([key] * n), pa.array([size] * n), pa.array([block] * n), pa.array([found] * n, pa.binary())],
                    ["grp", "x", "y", "class", "copies", "block", "shingles"],
                )


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections.

    Shingles held by the same documents are one weighted column, so near copies take few columns.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    count = np.diff(np.append(first, len(values)))
    mark = np.add.reduceat(_mix(np.arange(1, m + 1, dtype=np.uint64))[owner], first)
    shared = np.flatnonzero(count > 1)
    out = np.diag(sizes).astype(np.float64)
    if not len(shared):
        return out
    _, pick, weight = np.unique(mark[shared], return_index=True, return_counts=True)
    pick = shared[pick]
    step = max(1, 4_000_000 // m)
    total = np.zeros((m, m), np.float64)
    for i in range(0, len(pick), step):
        part = pick[i : i + step]
        x = np.zeros((m, len(part)), np.float32)
        n = count[part]
        rows = owner[np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        x[rows, np.repeat(np.arange(len(part)), n)] = 1
        total += (x * weight[i : i + step].astype(np.float32)) @ x.T
    np.fill_diagonal(total, sizes)
    return total


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, links, roots = [], [], []

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, links, roots)], ["class", "links", "root"])
            for x in (keys, links, roots):
                x.clear()
            return out

        for group in groups(batches, ["grp", "x", "y"]):
            rows = {r[0]: r for r in zip(*(group.column(c).to_pylist() for c in ("class", "copies", "block", "shingles")), strict=True)}
            if len(rows) < 2:
                continue
            rows = [rows[k] for k in sorted(rows)]
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            inter, size = overlaps(sets), np.array([len(s) for s in sets])
            union = size[:, None] + size[None, :] - inter
            near = inter >= threshold * union - 1e-9
            np.fill_diagonal(near, False)
            if group.column("x")[0].as_py() != group.column("y")[0].as_py():
                block = np.array([r[2] for r in rows])
                near &= block[:, None] != block[None, :]
            n = near @ np.array([r[1] for r in rows], np.int64)
            label = np.arange(len(rows))
            while True:
                new = np.minimum(label, np.where(near, label[None, :], len(rows)).min(axis=1))
                new = new[new]
                if (new == label).all():
                    break
                label = new
            for i in np.flatnonzero(n).tolist():
                keys.append(rows[i][0])
                links.append(int(n[i]))
                roots.append(rows[label[i]][0])
            if len(keys) > 10_000:
                yield full()
        if keys:
            yield full()

    return run


def order_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def near_duplicates(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_hash, class_id, n_links, n_shingles, kept_id, kept_hash) for every row.

    class_id is the smallest doc_id of the class, n_links the number of other documents at the threshold or above. The
    class's first row has the order id kept_id and the text hash kept_hash (null for rows without links).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    sketched = materialize(rows.mapInArrow(_sketch(*plan_bands(threshold, recall)), "doc_id long, text_hash long, class long, n long, bands array<long>"), "sketches")
    named = sketched.filter("class is not null").withColumn("order_id", order_id())
    # by id first, so that the smallest id has one text hash whatever the order of rows
    by_id = named.groupBy("class", "order_id").agg(F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    classes = materialize(by_id.groupBy("class").agg(F.min("order_id").alias("first"), F.min_by("text_hash", "order_id").alias("first_hash"), F.min("doc_id").alias("least_id"), F.sum("copies").alias("copies"), F.first("n").alias("n")), "classes")

    banded = named.select("class", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high").select("band", "low")
    stars = components(banded.join(buckets, "band").filter("class != low").select(F.col("class").alias("u"), F.col("low").alias("v")).distinct(), "candidates")

    members = stars.select(F.col("u").alias("class"), F.col("v").alias("grp")).union(stars.select("v", "v").distinct()).join(classes, "class")
    sizes = members.groupBy("grp").agg(F.ceil(F.sum(F.col("n") + DOC_WEIGHT) / BLOCK_WEIGHT).cast("long").alias("blocks"))
    wanted = materialize(members.join(sizes, "grp").select("first", "first_hash", "grp", "class", "copies", F.pmod(F.xxhash64("class"), F.col("blocks")).alias("block"), "blocks"), "wanted")
    # only texts that may be wanted are shuffled; a sort-merge join whatever the sizes, so small inputs take the way of large ones
    key = lambda i, h: F.xxhash64(i, h)
    ordered = rows.select(order_id().alias("order_id"), "text_hash", "text")
    likely = mark_members(ordered.withColumn("key", key("order_id", "text_hash")), "key", wanted.select(key("first", "first_hash").alias("member")), "member", "likely").filter("likely").drop("key", "likely")
    texts = likely.join(wanted.hint("merge"), (likely["order_id"] == wanted["first"]) & (likely["text_hash"] == wanted["first_hash"]))
    blocks = texts.select("grp", "class", "copies", "block", "blocks", "text").mapInArrow(_shingle_blocks, "grp long, x long, y long, class long, copies long, block long, shingles binary")
    checked = blocks.repartition(max(parts, 4), "grp", "x", "y").sortWithinPartitions("grp", "x", "y").mapInArrow(_verify(threshold), "class long, links long, root long")
    checked = materialize(checked, "verified")

    joined = components(checked.select(F.col("class").alias("u"), F.col("root").alias("v")), "joined")
    linked = checked.groupBy("class").agg(F.sum("links").alias("links")).join(joined.select(F.col("u").alias("class"), "v"), "class", "left")
    known = classes.join(linked, "class", "left").filter("copies > 1 or links is not null").select("class", F.coalesce("v", "class").alias("label"), "first", "first_hash", "least_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    by_first = known.groupBy("label", "first").agg(F.min("first_hash").alias("first_hash"), F.min("least_id").alias("least_id"))
    named_by = by_first.groupBy("label").agg(F.min("least_id").alias("class_id"), F.min("first").alias("kept_id"), F.min_by("first_hash", "first").alias("kept_hash"))
    answer = known.join(named_by, "label").select("class", "class_id", "n_links", "kept_id", "kept_hash")
    out = sketched.drop("bands").join(answer, "class", "left")
    return out.select("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles"), "kept_id", "kept_hash")



def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each class with its own columns: that of the smallest doc_id, then of the smallest text hash.

    Rows that are alone in their class stay; of rows that repeat both id and text one stays. Those are brought down to
    one in each partition before rows are shuffled.
    """
    found = near_duplicates(docs, text).filter("n_links > 0")
    lost = (order_id() != F.col("kept_id")) | (F.col("text_hash") != F.col("kept_hash"))
    gone = found.select(order_id().alias("__nj_id"), F.col("text_hash").alias("__nj_hash"), lost.alias("__nj_gone")).groupBy("__nj_id", "__nj_hash").agg(F.max("__nj_gone").alias("__nj_gone"), (F.count(F.lit(1)) > 1).alias("__nj_more"))
    gone = materialize(gone.filter("__nj_gone or __nj_more").drop("__nj_more"), "gone")
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumns({"__nj_own": order_id(), "__nj_text": F.xxhash64(text)}).withColumn("__nj_key", F.xxhash64("__nj_own", "__nj_text"))
    rows = mark_members(rows, "__nj_key", gone.select(F.xxhash64("__nj_id", "__nj_hash").alias("member")), "member", "__nj_likely")
    # texts without words have no class; all of them stay
    rows = rows.withColumn("__nj_likely", F.col("__nj_likely") & F.coalesce(F.col(text).rlike(WORD), F.lit(False)))
    sure = rows.filter("not __nj_likely").select(*names)  # these stay without a shuffle
    found = rows.filter("__nj_likely").dropDuplicates(["__nj_own", "__nj_text"])
    found = found.join(gone.hint("merge"), (F.col("__nj_own") == F.col("__nj_id")) & (F.col("__nj_text") == F.col("__nj_hash")), "left").filter("not coalesce(__nj_gone, false)")
    return sure.unionByName(found.select(*names))



def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_shingles")


OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT rid, g FROM (
    SELECT rid, array_to_string(words[i : i + 4], ' ') AS g FROM w, range(1, greatest(len(words) - 3, 2)) r(i) WHERE len(words) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE i >= {THRESHOLD} * (x.n + y.n - i) - 1e-9),
r(a, b) AS (SELECT rid, rid FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.a, min(w.doc_id) AS class_id FROM r JOIN w ON w.rid = r.b GROUP BY r.a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT w.doc_id, c.class_id, coalesce(k.n_links, 0)::BIGINT AS n_links, coalesce(n.n, 0)::BIGINT AS n_shingles
FROM w JOIN c ON c.a = w.rid LEFT JOIN k ON k.a = w.rid LEFT JOIN n ON n.rid = w.rid
"""
