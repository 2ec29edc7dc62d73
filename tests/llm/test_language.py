import numpy as np

from guardlake.llm import language
from tests.llm.helpers import DOCS, FOLDER


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    english = docs.where("lang = 'en'").orderBy("doc_id").first().text
    odd = spark.createDataFrame(
        [(9001, None, None, None, None), (9002, "", "en", None, None), (9003, "12 %% 34", "fr", "", 0),
         (9004, "7 " * 400 + english * 40, None, "s", 1), (None, english, "de", "s", 1),
         (9004, english, "en", "s", 1)], DOCS)
    got = language.identified(docs.unionByName(odd)).collect()
    assert len(got) == docs.count() + 6
    found = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 for r in got)
    assert [found[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3
    assert {r.lang_pred for r in got if r.doc_id == 9004} == {"en"}
    assert not found[None].held_out
    import zlib
    right = [found[r.doc_id].lang_pred == r.lang for r in docs.collect()
             if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
               for i in found if i is not None)
    assert len(right) > 150 and np.mean(right) > 0.97


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300)
    wrong = docs.withColumn("lang", language.F.when(
        language.held_out_rows(), "xx").otherwise(language.F.col("lang")))
    assert language.identified(wrong).where("lang_pred = 'xx'").count() == 0


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (40, 64)).astype(np.uint8)
    net = language.train(windows, rng.integers(0, 3, 40), ["a", "b", "c"], epochs=2)
    pooled = [(language._stacked(net, windows, w) @ f.reshape(-1, language.FILTERS)).max(axis=1) + b
              for w, f, b in zip(language.WIDTHS, net.filters, net.biases)]
    want = language.softmax(np.maximum(np.hstack(pooled), 0) @ net.weights + net.offset)
    assert np.allclose(language.Classifier(net).probabilities(windows), want, atol=1e-4)


def test_windows_cover_whole_texts():
    texts = [b"", b"x" * 5, b"y" * 256, b"z" * 700]
    windows, of = language.as_windows(texts)
    for i, text in enumerate(texts):
        assert windows[of == i].tobytes().rstrip(b"\0") == text


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert not language.identified(docs).collect()
    unlabelled = spark.createDataFrame([(1, "some text", None, None, None)], DOCS)
    assert language.identified(unlabelled).first().lang_pred == "und"


def test_filter_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    junk = spark.createDataFrame([(9001, "12 34", "en", "s", 1), (9002, None, "en", "s", 1)], DOCS)
    kept = language.in_known_language(docs.unionByName(junk))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {9001, 9002} and len(ids) > 0.99 * docs.count()


def test_a_result_does_not_depend_on_longer_neighbours():
    rng = np.random.default_rng(1)
    windows = rng.integers(97, 123, (60, 64)).astype(np.uint8)
    model = language.Classifier(language.train(windows, rng.integers(0, 3, 60), ["a", "b", "c"]))
    short, long = "ab", "some words " * 500
    alone = language.predict(model, language.pa.array([short]), [True])
    beside = language.predict(model, language.pa.array([short, long]), [True, True], most=16)
    assert len(long) > 16 and beside[0][0] == alone[0][0]
    together = language.predict(model, language.pa.array([short, long * 40]), [True, True], most=3000)
    assert together[0][0] == alone[0][0] and abs(together[1][0] - alone[1][0]) < 1e-6


def test_a_language_of_many_copies_keeps_its_texts(spark):
    copies = spark.range(100_000).selectExpr(
        "'xx' as lang", "concat('some text of number ', id % 20, ' in many copies') as text")
    others = spark.range(2000).selectExpr("'yy' as lang", "concat('another text ', id) as text")
    rows = language.training_rows(copies.unionByName(others), language.F.lit(False), windows=1).collect()
    assert len({r.text for r in rows if r.lang == "xx"}) == 20
    assert 450 < len({r.text for r in rows if r.lang == "yy"}) < 750


def test_documents_stay_where_nothing_is_labelled(spark):
    docs = spark.createDataFrame([(i, x, None, None, None) for i, x in enumerate(
        ["some text", "12 34", None, "é"])], DOCS)
    assert sorted(r.doc_id for r in language.in_known_language(docs).collect()) == [0, 3]
