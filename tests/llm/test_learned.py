import zlib

from pyspark.sql import functions as F

from stationflow.llm import langid, quality, queries

from .helpers import documents, plain

SF = "/root/testdata/sf0.01"
TEXTS = [(1, None), (2, ""), (3, "12 ... 34"), (4, "the of and with that from"), (4, "the of and with that from"), (None, "le la les dans sur avec"), (5, "x" * 300_000)]
ENGLISH = "it is the end of and with that from which the men came and the of and with that from there"
FRENCH = "c'est le fin la les dans sur avec une maison et le la les dans sur avec des gens"


def test_language_query(spark):
    rows = queries.QUERIES["op8_language"](spark, SF).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.96 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    known = documents(spark, [(i, t) for i, t in enumerate([ENGLISH, FRENCH, None, "x"])], ["en", "fr", "en", None])
    found = langid.judge(F.col("text"), langid.learn(known))
    rows = documents(spark, TEXTS).withColumn("f", found).select("doc_id", "text", "f.*").collect()
    by = {r.text: r for r in rows}
    assert len(rows) == len(TEXTS)
    assert all(by[t].lang_pred == "und" and by[t].score == 0 and by[t].rejected for t in (None, "", "12 ... 34"))
    assert by["the of and with that from"].lang_pred == "en" and by["le la les dans sur avec"].lang_pred == "fr"
    assert langid.learn(documents(spark, [])) == {}
    unknown = documents(spark, TEXTS).select(langid.judge(F.col("text"), {}).alias("f"))
    assert {r.f.lang_pred for r in unknown.collect()} == {"und"}


def test_what_is_no_letter():
    assert not any(langid.has_letter(t) for t in ("", "12", "\u00bd \u00b2", "\u2460 \u2167", "_ ."))
    assert all(langid.has_letter(t) for t in ("a", "1\u00e9", "\u6f22", "\u00bd x"))


def test_long_texts_and_layouts_are_learned_from(spark):
    """A language of long texts only has a dictionary, and the drawing does not depend on how rows are dealt out."""
    long = [(i, (ENGLISH if i % 2 else FRENCH) + " " + "z" * 25_000 + str(i)) for i in range(40)]
    docs = documents(spark, long, ["en" if i % 2 else "fr" for i in range(40)])
    one, other = langid.learn(docs.coalesce(1)), langid.learn(docs.repartition(7))
    assert set(one) == {"en", "fr"} and one == other
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert (quality.learn(docs, labels).weights != 0).any()


def test_quality_query(spark):
    rows = queries.QUERIES["op2_quality"](spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    good = [r.score for r in held if labels[r.doc_id] == 1]
    bad = [r.score for r in held if labels[r.doc_id] == 0]
    assert sum(a > b for a in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, "x"), (5, 0, "x"), (5, 0, "x"), (None, 1, "x"), (9, None, "x")], "doc_id long, quality int, text string")
    docs = documents(spark, TEXTS)
    model = quality.learn(docs, labels)
    got = plain(docs.select("doc_id", quality.score(F.col("text"), model).alias("s")))
    assert len(got) == len(TEXTS) and all(0 <= s <= 1 for _, s in got)
    nothing = quality.learn(documents(spark, []), labels)
    assert plain(docs.select(quality.score(F.col("text"), nothing).alias("s"))) == [(0.5,)] * len(TEXTS)


def test_features_count_each_text_alone():
    texts = ["ab cd ab", "", "a", "ab ab", "é x"]
    together = quality.features(texts)
    for f, counts in together:
        assert len(f) == counts.sum()
    for i, t in enumerate(texts):
        for (f, counts), (g, _) in zip(together, quality.features([t])):
            at = counts[:i].sum()
            assert f[at : at + counts[i]].tolist() == g.tolist()
