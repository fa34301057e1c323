"""The pipeline's stages on their own inputs, and the SQL of the queries that have it."""

import hashlib

import pytest

pytest.importorskip("hubcast.llm")
from conftest import SF_SMALL, canon  # noqa: E402

from hubcast.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, duck, name):
    got = queries.QUERIES[name](spark, SF_SMALL)
    want = duck.execute(queries.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert set(cols) == set(got.columns)
    assert canon(got.select(*cols).collect()) == canon(want.fetchall())


def test_stages(spark):
    import corpus_pipeline as cp
    from hubcast.llm.decontam import shingles
    from hubcast.llm.simhash import fingerprint
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = spark.createDataFrame([(10 ** 6, None, "en", "s", 0), (10 ** 6 + 1, "12 | 34", "en", "s", 0)], docs.schema)
    tables = [docs.unionByName(extra)]
    for name, step in cp.STAGES:
        tables.append(cp.stage(step(spark, tables[-1], SF_SMALL), f"test-{name}"))
    raw, told, lined, single, clean, packed = ([r.asDict() for r in t.collect()] for t in tables)
    assert all(t.columns == docs.columns for t in tables[1:5])
    assert {r["doc_id"] for r in raw} - {r["doc_id"] for r in told} == {10 ** 6, 10 ** 6 + 1}
    assert all(r["text"].strip() and r["n_chars"] == len(r["text"]) for r in lined)
    fps = {r["doc_id"]: fingerprint(r["text"].encode()) for r in lined}
    kept = {r["doc_id"] for r in single}
    assert all(d in kept or any(o < d and bin(fps[o] ^ fps[d]).count("1") <= 3 for o in fps) for d in fps)
    bench = [set(shingles(r["text"].encode(), 5)) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    hit = {r["doc_id"] for r in single for g in bench if g and len(g & set(shingles(r["text"].encode(), 5))) >= 0.8 * len(g)}
    assert kept - {r["doc_id"] for r in clean} == hit
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean}


def test_stages_with_null_and_repeated_ids(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    say = lambda n: " ".join(f"{c}{n}" for c in "abcdefghijklmnopqrstuvwxyz")
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    pairs = lambda df: sorted((r["doc_id"] or -1, r["text"]) for r in df.collect())
    # alone without an id; copies without ids; a copy with one; exact repeats of an id; another text under it, whose group has a smaller one
    rows = [(None, say(1)), (None, say(2)), (None, say(2)), (None, say(3)), (7, say(3)), (8, say(4)), (8, say(4)), (9, say(4)), (8, say(5)), (3, say(5)), (8, say(6))]
    assert pairs(cp.near_duplicates(spark, table(rows), SF_SMALL)) == sorted([(-1, say(1)), (-1, say(2)), (7, say(3)), (8, say(4)), (3, say(5)), (8, say(6))])
    rows = [(None, item), (None, say(1)), (5, item), (5, say(2)), (5, say(2)), (6, say(3))]
    assert pairs(cp.decontamination(spark, table(rows), SF_SMALL)) == sorted([(-1, say(1)), (5, say(2)), (5, say(2)), (6, say(3))])


def test_run_leaves_its_result_alone(spark):
    import os

    import corpus_pipeline as cp
    from hubcast.session import checkpoint_root
    folder = f"{checkpoint_root(spark)}/llm"
    listed = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = listed()
    packed = cp.run(spark, SF_SMALL)
    assert {name.rsplit("-", 1)[0] for name in listed() - before} == {"pipeline-best_fit_packing"}
    assert packed.count() >= packed.select("doc_id").distinct().count() > 0


def test_kept_text_digest(spark):
    got = queries.QUERIES["op1_line_dedup"](spark, SF_SMALL).where("n_dropped = 0").first()
    text = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where(f"doc_id = {got['doc_id']}").first()["text"] or ""
    assert got["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
