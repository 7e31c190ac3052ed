"""The pipeline's stages on planted cases: junk, copies, repeated lines, benchmark items."""

import random

import corpus_pipeline
import pytest
from riverbed.llm.common import cut


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    text = lambda: "\n".join(prose(40) for _ in range(4))
    items = [prose(35) for _ in range(5)]
    clean = [text() for _ in range(40)]
    near = clean[0].split(" ")
    near[7] = "changed"
    boiler = prose(30)
    rows = [("clean", t) for t in clean]
    rows += [("copy", clean[1]), ("near", " ".join(near)), ("junk", "spam spam eggs " * 60), ("short", "only three words"), ("null", None), ("empty", "")]
    rows += [("boiler", f"{text()}\n{boiler}") for _ in range(3)] + [("leak", f"{text()}\n{items[2]}\n{prose(30)}")]
    folder = tmp_path_factory.mktemp("sf")
    docs = [(i, t, "en", k, len(t or "")) for i, (k, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), rows


def test_stages(spark, planted):
    folder, rows = planted
    kinds = dict(enumerate(k for k, _ in rows))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    of = lambda stage, kind: [d for d in seen[stage] if kinds[d] == kind]
    assert not [d for k in ("junk", "short", "null", "empty") for d in of("quality_rules", k)]
    assert len(of("quality_rules", "clean")) == 40 and len(of("quality_rules", "leak")) == 1
    assert not of("line_dedup", "copy")  # every line of it stands elsewhere
    boilers = [seen["line_dedup"][d].text.count("\n") for d in sorted(of("line_dedup", "boiler"))]
    assert boilers == [4, 3, 3]
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].values())
    assert len(of("decontaminate", "clean")) == 40 and not of("decontaminate", "leak")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(seen["decontaminate"])


def test_near_stage_keeps_one_of_each_group(spark, planted):
    folder, rows = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()}
    kinds = dict(enumerate(k for k, _ in rows))
    assert not [d for d in kept if kinds[d] in ("copy", "near")] and len([d for d in kept if kinds[d] == "clean"]) == 40


def test_run(spark, planted):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, planted[0]).count() > 30


@pytest.mark.parametrize("empty", [True, False])
def test_stages_with_odd_rows(spark, planted, empty):
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false" if empty else "doc_id in (0, 1)")
    lost = docs.selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(lost).selectExpr("*", "1 as row", "'a' as text_", "true as kept", "'b' as id", "2 as bucket")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, folder), "test-odd")
        assert out.columns == docs.columns
        assert out.filter("doc_id is null").count() == (0 if empty else 2)
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).filter("doc_id is null").collect()
    first = [p for p in pieces if p.start == 0]
    assert len(first) == (0 if empty else 2) and sum(p.length for p in pieces) == sum(p.doc_tokens for p in first)
