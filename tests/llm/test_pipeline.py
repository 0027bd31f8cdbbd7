"""Every stage of the corpus pipeline and the whole run against brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from barloom.llm import jaccard, langid
from barloom.llm.common import plain
from barloom.llm.queries import tokenizer
from tests.llm.conftest import SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def shingles(text, width):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def groups(texts, width, percent):
    """The number of each text's group, by all pairs."""
    sets, group = [shingles(t, width) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def kept_by_language(rows, model):
    out = []
    for r in rows:
        sure = model.probabilities(plain(pa.array([r[1]], pa.string())))[0] if model.languages else [0]
        if re.search(r"[^\W\d_]", r[1] or "") and max(sure) >= model.threshold and model.languages:
            out.append(r)
    return Counter(out)


def kept_exactly(rows):
    best = {}
    for r in rows:
        best.setdefault(r[1] or "", []).append(r)
    return Counter({max((r[0] is not None, r[0] or 0) for r in same): 1 for same in best.values()}), len(best)


def kept_nearly(rows):
    group, best = groups([r[1] for r in rows], 5, 80), {}
    for g, r in zip(group, rows, strict=True):
        best.setdefault(g, []).append((r[0] is None, r[0] or 0))
    return sorted(min(x) for x in best.values())


def test_language_stage(spark, docs, none, raw):
    got = P.languages(spark, docs, "")
    assert got.columns == docs.columns and rows_of(got) == kept_by_language(raw, langid.train(docs))
    assert P.languages(spark, none, "").count() == 0


def test_exact_stage(spark, docs, none, raw):
    got = P.exact_duplicates(spark, docs, "")
    want, n = kept_exactly(raw)
    assert got.columns == docs.columns and got.count() == n and Counter((r["doc_id"] is not None, r["doc_id"] or 0) for r in got.collect()).keys() == want.keys()
    assert P.exact_duplicates(spark, none, "").count() == 0


def test_near_stage(spark, docs, none, raw):
    got = P.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == kept_nearly(raw)
    assert P.near_duplicates(spark, none, "").count() == 0


def test_near_stage_judges_rows_of_one_id_by_their_texts(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(3, a + " more"), (5, a), (5, "a clean text of its own that nobody has copied"), (7, None), (7, "")]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert rows_of(got) == Counter([rows[0], rows[2], rows[3], rows[4]])
    plain_ids = [(3, a + " more", "x"), (5, a, "y"), (6, "another", "z")]
    got = P.near_duplicates(spark, spark.createDataFrame(plain_ids, "doc_id long, text string, component_id string"), "")
    assert rows_of(got) == Counter([plain_ids[0], plain_ids[2]])


def test_rows_of_one_id_are_one_node(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    got = jaccard.near_duplicates(spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (9, "alone here")], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]


def test_mixing_stage(spark, docs, none, raw):
    got = P.mixture(spark, docs, "")
    assert got.columns == docs.columns
    taken = Counter()
    for r in P.mixing.mix(docs.select("doc_id", "text", "source")).collect():
        size = len(WORD.findall(r["row"]["text"] or ""))
        assert size == r["size"]
        taken[(r["row"]["doc_id"], r["row"]["source"], r["row"]["text"])] += r["taken"] // size if size else 0
    mine = Counter((r["doc_id"], r["source"], r["text"]) for r in got.collect())
    assert mine == Counter({k: n for k, n in taken.items() if n})
    assert P.mixture(spark, none, "").count() == 0


def test_mixing_stage_deals_takes_to_repeated_rows(spark):
    rows = [(1, "one two three", "a")] * 3 + [(2, "x y", "b"), (3, "z " * 50, "b")]
    data = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for r in P.mixing.mix(data).collect():
        taken[r["row"]["doc_id"]] += r["taken"] // r["size"]
    assert Counter(r["doc_id"] for r in P.mixture(spark, data, "").collect()) == Counter({k: n for k, n in taken.items() if n})


def check_packed(found, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = Counter((r[0], len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    found = found.collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in found if r["start"] == 0) == want
    assert sum(r["length"] for r in found) == sum(n * k for (_, n), k in want.items())
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_packing_stage(spark, docs, none, raw):
    check_packed(P.packed(spark, docs, ""), raw)
    assert P.packed(spark, none, "").count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_whole_run(spark, docs, none, raw, tmp_path, empty):
    (none if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    found = P.run(spark, str(tmp_path))
    if empty:
        assert found.count() == 0
        return
    rows = list(kept_by_language(raw, langid.train(docs)).elements())
    alone = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        alone[r[1] or ""] = r
    rows = list(alone.values())
    kept = kept_nearly(rows)
    group, best = groups([r[1] for r in rows], 5, 80), {}
    for g, r in zip(group, rows, strict=True):
        best.setdefault(g, []).append(((r[0] is None, r[0] or 0), r))
    rows = [min(x, key=lambda y: y[0])[1] for x in best.values()]
    assert len(rows) == len(kept)
    rows = [tuple(r) for r in spark.createDataFrame(rows, SCHEMA).transform(lambda d: P.mixture(spark, d, "")).collect()]
    check_packed(found, rows)


def test_stages_keep_the_columns_of_documents(spark, docs):
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(20).withColumn("times", F.lit(1)).withColumn("__text", F.lit("x")), "").columns == [*docs.columns, "times", "__text"], name
