"""The pipeline's stages on a small table against plain versions, and the queries' registration."""

import pytest

import corpus_pipeline
from annolith.llm import mixing, sharding
from annolith.llm.queries import oracle_sql, queries
from tests.llm import brute
from tests.llm.test_operators import BASE, SENTENCES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and set(oracle_sql()) <= set(names)


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]


@pytest.fixture
def corpus_dir(spark, tmp_path):
    rows = [(i, " ".join([*SENTENCES[i % 25].split(), *SENTENCES[(3 * i + 1) % 25].split(), f"u{i}"]), "en", f"s{i % 3}", 0) for i in range(50)]
    rows += [(60, " ".join(BASE), "en", "s0", 0), (61, " ".join([*BASE[:-1], "end"]), "en", "s1", 0), (62, "too short", "en", "s1", 0), (63, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in [*range(50), 60, 61]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, SENTENCES[4] + " " + SENTENCES[13])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_against_plain_versions(spark, corpus_dir):
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    state, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = state = stage(spark, state, corpus_dir)
        if name != "shard":
            assert state.columns == docs.columns
    ids = {n: sorted(r.doc_id for r in df.collect()) for n, df in kept.items() if n != "shard"}
    text = {r.doc_id: r.text for r in docs.collect()}
    good = sorted(d for d, t in text.items() if not brute.quality(t)[-1])
    assert ids["quality"] == good
    firsts = sorted(d for d, _, _, k in brute.components([(d, text[d]) for d in good]) if k)
    assert ids["near_duplicates"] == firsts and 60 in firsts and 61 not in firsts
    leaked = {d for d, _ in brute.leaks([(d, text[d]) for d in firsts], [(1, SENTENCES[4] + " " + SENTENCES[13])])}
    assert leaked and ids["decontaminate"] == sorted(set(firsts) - leaked)
    taken = {r.doc_id: r for r in mixing.mix(docs.filter(docs.doc_id.isin(ids["decontaminate"]))).collect()}
    assert ids["mix"] == sorted(d for d, r in taken.items() for _ in range(int(r.taken / r.size + 0.5)))
    final = corpus_pipeline.run(spark, corpus_dir).collect()
    assert sorted(r.doc_id for r in final) == ids["mix"]
    placed = {r.doc_id: r.shard for r in sharding.shard_documents(docs).collect()}
    assert all(r.shard == placed[r.doc_id] for r in final)


def test_pipeline_of_an_empty_corpus(spark, corpus_dir, tmp_path):
    empty = spark.read.parquet(f"{corpus_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, corpus_dir)
    assert empty.count() == 0
