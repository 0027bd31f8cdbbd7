import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import langid, toxicity
from barloom.llm.common import held_out, plain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def language(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"), use=~held_out(2, 4))


def test_fold_is_the_crc_of_the_id(spark):
    got = {r["id"]: r["h"] for r in spark.range(200).select("id", held_out(2, 4, "id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}
    assert not spark.sql("SELECT CAST(NULL AS LONG) id").select(held_out(2, 4, "id")).first()[0]


def test_held_out_languages(spark, language):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(held_out(2, 4))
    got = langid.identify(docs, language)
    assert got.where("lang_pred = lang").count() / got.count() > 0.95
    assert got.where("rejected").count() == 0
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_of_odd_texts(docs, none, language):
    got = {(r["doc_id"], r["n_chars"]): r for r in langid.identify(docs.withColumn("lang_pred", F.lit("clash")), language).collect()}
    assert len([r for r in langid.identify(docs, language).collect()]) == docs.count()
    for k, n in ((0, 0), (1, 0), (2, 5), (14, 12)):
        assert (got[k, n]["lang_pred"], got[k, n]["score"], got[k, n]["rejected"]) == ("und", 0.0, True)
    assert langid.identify(none, language).collect() == []


def test_language_model_without_or_with_one_label(docs, none):
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}
    one = langid.train(docs.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.identify(docs, one).collect()} == {"en", "und"}


def test_texts_do_not_share_subwords():
    import pyarrow as pa

    texts = ["ab cd", "", "xyz", "ab cd"]
    rows, some = next(langid.parts(plain(pa.array(texts))))
    for owner, codes in langid.subwords(some):
        for k, row in enumerate(rows):
            alone = [c for _, own in langid.subwords([some[k]]) for c in own.tolist()]
            assert set(codes[owner == k].tolist()) <= set(alone) and some[k] == texts[row].encode()


def test_long_texts_are_cut_between_words():
    import pyarrow as pa

    text = " ".join(f"wörd{i % 977}" for i in range(60_000))
    pieces = [x for _, some in langid.parts(plain(pa.array([text]))) for x in some]
    assert len(pieces) > 3 and b"".join(pieces) == text.encode()
    whole = np.zeros(langid.BUCKETS, np.int64)
    for _, codes in langid.subwords([text.encode()]):
        whole += np.bincount(codes, minlength=langid.BUCKETS)
    codes, counts = langid.bag(text)
    assert codes.tolist() == np.flatnonzero(whole).tolist() and counts.tolist() == whole[whole > 0].tolist()


def made_up(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, toxic = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        bad = k % 4 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["zorkish", "Zorky", "vilebad,", "vileness"])
        texts.append(" ".join(text))
        toxic.append(int(bad))
    return texts, np.array(toxic)


def test_toxicity_is_learnt_and_held_out():
    model = toxicity.fit(*made_up(600, 1))
    texts, toxic = made_up(200, 2)
    assert ((model.scores(texts) >= 0.5) == (toxic == 1)).mean() > 0.97
    together, alone = model.scores(texts[:20]), np.concatenate([model.scores([t]) for t in texts[:20]])
    assert np.allclose(together, alone, atol=1e-6)


def test_toxicity_of_tables(spark, docs, none):
    texts, toxic = made_up(400, 3)
    rows = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)] + [(None, "zorkish", "en"), (400, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(x)) for k, x in enumerate(toxic)] + [(3, None), (None, 1), (999, 1), (5, int(toxic[5]))], "doc_id long, toxic int")
    model = toxicity.train(rows, labels, use=~held_out(0, 5))
    assert 0 < model.thresholds["en"] < 1
    got = toxicity.score(rows.where(held_out(0, 5)), model).join(labels, "doc_id").where("toxic IS NOT NULL")
    assert got.where("predicted = toxic").count() / got.count() > 0.9
    assert toxicity.score(docs, model).count() == docs.count()
    empty = toxicity.score(docs.where("trim(coalesce(text, '')) = ''"), model).collect()
    assert len({r["score"] for r in empty}) == 1 and empty[0]["predicted"] == 0
    assert toxicity.score(none, model).collect() == []
    untaught = toxicity.train(none, labels)
    assert {r["predicted"] for r in toxicity.score(docs, untaught).collect()} == {0}
    # neither language nor source is an input of a score
    other = toxicity.score(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")}), model).select("doc_id", "score")
    assert sorted(map(str, other.collect())) == sorted(map(str, toxicity.score(docs, model).select("doc_id", "score").collect()))


def test_threshold_lies_between_the_classes():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)


def test_thresholds_by_language_count_all_rows(spark):
    rng = np.random.default_rng(2)
    score = np.round(rng.random(900), 3)
    toxic = (rng.random(900) < score).astype(int)
    lang = np.array(["en", "de", "few"])[np.minimum(rng.integers(0, 40, 900) // 19, 2)]
    rows = spark.createDataFrame([*zip(lang.tolist(), score.tolist(), toxic.tolist()), (None, 0.5, 1)], "lang string, score double, toxic int")
    got = toxicity.best_thresholds(rows)
    assert set(got) == {"en", "de"}
    for k, value in got.items():
        assert value == pytest.approx(toxicity.best_threshold(score[lang == k], toxic[lang == k]), abs=1e-12)


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('plain words ', id % 7, if(id % 4 = 0, ' vile', ' kind')) AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 AS int) AS toxic")
    few, all_rows = toxicity.train(docs, labels, sample=10**6), {}
    for size in (10**6, 150):
        monkeypatch.setattr(toxicity, "ROWS_OF_TASK", size)
        all_rows[size] = toxicity.train(docs, labels, sample=20)
        again = toxicity.train(docs, labels, sample=20)
        assert (again.embed == all_rows[size].embed).all() and again.thresholds == all_rows[size].thresholds
        assert toxicity.score(docs, again).join(labels, "doc_id").where("flagged != (toxic = 1)").count() == 0
    # a word that only one row outside of the sample has moves too
    rare = docs.selectExpr("doc_id", "if(doc_id = 396, 'zyx', text) AS text", "lang")
    code = toxicity.features(["zyx"])[0][0, 0]
    start = toxicity.fit([], np.zeros(0))
    moved = [toxicity.train(x, labels, sample=20).embed[code] for x in (docs, rare)]
    assert (moved[0] == start.embed[code]).all() and (moved[1] != start.embed[code]).any()
    assert few.thresholds.keys() == {"en"}
