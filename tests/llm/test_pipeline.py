"""The pipeline: its contract, and each stage's decisions against brute force on what the stage before kept."""

from pathlib import Path

import pytest
import test_decontaminate as leaks
import test_quality as rules
import test_simhash_dedup as copies

import corpus_pipeline
from phrasewell.llm import cube, token_store
from phrasewell.llm.common import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def tables(spark, full, prose, odd, tmp_path):
    items = [(k, prose.text(30)) for k in range(5)]
    rows = [(100 + k, prose.text(prose.rng.randint(60, 120)), f"src{k % 3}") for k in range(120)]
    rows += [(300 + k, rows[k][1]) for k in range(8)] + [(320 + k, prose.edited(rows[20 + k][1], 0.03)) for k in range(8)]
    rows += [(340 + k, f"{prose.text(60)} {items[k][1]} {prose.text(5)}") for k in range(5)]
    rows += [(360 + k, "junk spam " * 40) for k in range(6)]
    labels = [(r[0], 1, 0) for r in rows if r[0] < 360] + [(360, 0, 0), (361, 0, 1)]
    # The very long text has a source of its own: it can't be halved to meet a target.
    odd = [(*r, "long") if r[0] == 5 else r for r in odd]
    full(rows + odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, labels, items, odd, str(tmp_path)


def test_stages(spark, tables, tmp_path):
    rows, labels, items, odd, sf_dir = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS, name
        path = str(tmp_path / f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k == 4:
            break
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        ids = sorted((d for d, _ in after), key=str)
        if k == 0:
            want = sorted((d for d, _, _ in rules.brute(before, labels)), key=str)
            assert ids == want and not set(ids) & set(range(360, 366))
        elif k == 1:
            gone = set(copies.brute(before))
            assert set(range(300, 308)) <= gone and len(ids) == len(set(ids))
            missed = set(ids) & gone  # beyond 13 bits a pair meets with a probability
            assert set(ids) == ({d for d, _ in before} - gone) | missed and len(missed) <= 0.1 * len(gone)
        elif k == 2:
            gone = {d for d, _ in leaks.brute(before, items)}
            assert gone == set(range(340, 345)) and ids == sorted((d for d, _ in before if d not in gone), key=str)
        elif k == 3:
            assert 0 < len(ids) <= len(before) and set(ids) <= {d for d, _ in before}
            kept = {r["doc_id"]: r["source"] for r in docs.collect()}
            by = {s: sum(len(t.split()) for d, t in after if kept[d] == s) for s in set(kept.values())}
            total = {s: 0 for s in by}
            for r in spark.read.parquet(str(tmp_path / "stage2")).collect():
                if r["source"] in total:
                    total[r["source"]] += len(r["text"].split())
            most = min(total[s] / total[s] ** cube.ALPHA for s in total)
            assert all(by[s] == pytest.approx(most * total[s] ** cube.ALPHA, abs=250) for s in by if s != "long")
        before = after
    decode = token_store.encoding(tokenizer_path(token_store.VOCABULARY)).decode
    got = ((r["doc_id"], decode(token_store.unpack(bytes(r["payload"])))) for r in docs.collect())
    assert sorted(got, key=str) == sorted(before, key=str)


def test_run_equals_its_stages(spark, tables, tmp_path):
    sf_dir = tables[-1]
    got = {r["doc_id"]: bytes(r["payload"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert got == {r["doc_id"]: bytes(r["payload"]) for r in docs.collect()} and len(got) > 20


def test_empty_documents(spark, full, tables, tmp_path):
    sf_dir = tmp_path / "empty"
    full([]).write.parquet(str(sf_dir / "documents.parquet"))
    for name, schema in (("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(str(sf_dir / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(sf_dir)).collect() == []


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "mixing", "token ids"]
    import __spark_entry__ as contract

    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in contract.queries()
    text = (Path(corpus_pipeline.__file__).parent / "phrasewell").rglob("*.py")
    outside = [p for p in text if "llm" not in p.parts and "llm" in p.read_text()]
    assert outside == []
