"""The pipeline's stages against their operators and a plain version."""

import os

import duckdb
import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from skyframes.llm import piece_lattice, quality_rules, registry, source_mixing  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_run_equals_a_plain_version(spark):
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = {r["doc_id"] for r in quality_rules.judge(docs).collect() if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := t.split(" ")) is not None and (w := __import__("re").findall(r"[^\x20\x09-\x0D]+", t))}
    label = {i: i for i in texts}
    links = [(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    kept = [i for i in texts if label[i] == i]
    left = docs.filter(docs.doc_id.isin(kept))
    drawn = {r["doc_id"] for r in source_mixing.mix(left).collect() if r["sampled"]}
    assert set(rows) == drawn
    encoder = piece_lattice.Encoder()
    for i, r in rows.items():
        ids, score, best, _ = encoder.encode([texts[i]])[0]
        assert r["piece_ids"] == np.frombuffer(ids, "<i4").tolist() and abs(r["score"] - score) < 1e-6 and np.allclose(r["nbest_scores"], best)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), DATA).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    r = c.sql(registry.oracle_sql()[name])
    at = [list(r.columns).index(x) for x in columns]
    assert got == sorted((tuple(row[i] for i in at) for row in r.fetchall()), key=repr)
