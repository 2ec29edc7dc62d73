import corpus_pipeline
from guardlake.llm import language, packing, simhash
from tests.llm.helpers import DOCS, FOLDER, roots
from tests.llm.test_simhash import plain


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    junk = spark.createDataFrame([(9001, "12 34", "en", "src0", 1), (9002, None, None, None, None)],
                                 DOCS)
    docs = docs.unionByName(junk)
    steps = dict(corpus_pipeline.STAGES)
    first = steps["language"](spark, docs, FOLDER)
    assert first.columns == docs.columns
    kept = {r.doc_id: r for r in first.collect()}
    assert {9001, 9002} & kept.keys() == set() and len(kept) > 990
    second = steps["near duplicates"](spark, first, FOLDER)
    prints = {i: plain(r.text) for i, r in kept.items()}
    pairs = [(i, j) for i in prints for j in prints
             if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3]
    root = roots(prints, pairs)
    alone = {r.doc_id for r in second.collect()}
    assert second.columns == docs.columns and alone == {i for i in root if root[i] == i}
    third = steps["mixing"](spark, second, FOLDER)
    taken = third.collect()
    assert third.columns == docs.columns and {r.doc_id for r in taken} <= alone
    last = steps["packing"](spark, third, FOLDER).collect()
    tokens = packing.WordTokens(corpus_pipeline.tokenizer_path("word_bpe_49k.json"))
    assert sum(r.length for r in last) == sum(len(tokens.ids(r.text)) // 4 + 1 for r in taken)


def test_run_and_columns(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "sequence_id" in got.columns


def test_empty_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert not docs.collect(), name
    assert language and simhash
