"""Periodic runs, phrases and repeated bytes against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import periods, phrases, queries, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_brute_force(words, times=4, shortest=6):
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q))
            if length >= max(shortest, times * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_brute_force(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_words(rng, n):
    words = []
    while len(words) < n:
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        words += (unit * rng.randint(1, 9))[: rng.randint(1, 60)]
        words += [f"u{rng.randint(0, 40)}" for _ in range(rng.randint(0, 4))]
    return words[:n]


@pytest.mark.parametrize("alphabet", [1, 2, 3, 0])
def test_runs_equal_brute_force(alphabet):
    rng = random.Random(alphabet)
    documents = [[rng.choice("abc"[:alphabet]) for _ in range(rng.randint(0, 60))] if alphabet else periodic_words(rng, rng.randint(0, 150)) for _ in range(60)]
    flat = [w for d in documents for w in d]
    codes = np.unique(np.array(flat, object), return_inverse=True)[1].astype(np.int32)
    cuts = np.cumsum([0] + [len(d) for d in documents])
    found = periods.find_runs(codes, cuts)
    for k, words in enumerate(documents):
        mine = [(int(s - cuts[k]), int(n), int(q)) for s, n, q in found if cuts[k] <= s < cuts[k + 1]]
        assert mine == runs_by_brute_force(words)


def test_periodic_runs_on_tables(spark, docs, none):
    got = periods.periodic_runs(docs.select("doc_id", "text", "lang", F.lit(1).alias("runs"))).collect()
    assert len(got) == docs.count() and periods.periodic_runs(none).count() == 0
    texts = [r["text"] for r in docs.select("doc_id", "text").collect()]
    want = Counter()
    for text in texts:
        words = WORD.findall(text or "")
        runs = runs_by_brute_force(words[:1500] if len(words) > 1500 else words)
        want[(len(words), tuple(runs), collapsed_by_brute_force(words, runs))] += 1
    assert Counter((r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in got) == want


def test_query_of_runs(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, " ".join(f"v{rng.randint(0, 9)}" for _ in range(rng.randint(0, 70)))) for k in range(150)] + [(None, "a " * 9), (900, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[None]["n_runs"] == 1 and got[None]["period"] == 1
    planted = 0
    for doc_id, text in rows[:-2]:
        words, h = WORD.findall(text), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            planted += 1
        runs = runs_by_brute_force(words)
        r = got[doc_id]
        assert r["n_runs"] == len(runs) and r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed_by_brute_force(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        assert (r["start"], r["length"], r["period"]) == best and r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert planted


def phrases_by_brute_force(rows, longest, least, percent, first):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in candidates.items():
        inside = any(m == lang and len(w) > len(words) and 100 * b >= percent * a and any(w[i : i + len(words)] == words for i in range(len(w))) for (m, w), b in candidates.items())
        if not inside:
            score, k = min((1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, all_ in out.items() for i, x in enumerate(sorted(all_)[:first])}


@pytest.mark.parametrize(("longest", "first"), [(3, 2000), (4, 5), (2, 3)])
def test_phrases_equal_brute_force(spark, monkeypatch, longest, first):
    rng = random.Random(longest)
    words = ["New", "york", "city", "the", "of", "Ünï", "a\x00b", "x"]
    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]) for _ in range(rng.randint(0, 60)))

    rows = [(text(), rng.choice(["en", "de", None])) for _ in range(120)] + [(None, "en"), ("", None), ("new york city. " * 30, "en")] * 2
    data = spark.createDataFrame(rows, "text string, lang string").withColumn("n", F.lit("clash")).repartition(3)
    monkeypatch.setattr(phrases, "BLOCK", 500)
    got = phrases.collocations(data, longest=longest, least=3, first=first).collect()
    assert {tuple(r) for r in got} == phrases_by_brute_force(rows, longest, 3, 50, first) and len(got) == len({tuple(r) for r in got})


def test_phrases_meet_blocks_by_themselves(spark, monkeypatch):
    """No list of a block's frequent grams is built in the JVM, and a call holds one block."""
    plans, stored = [], phrases.materialise

    def seen(df, name):
        if name == "longer":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(phrases, "materialise", seen)
    monkeypatch.setattr(phrases, "BLOCK", 200)
    data = spark.createDataFrame([("new york city " * 9, "en")] * 20, "text string, lang string")
    assert {r["phrase"] for r in phrases.collocations(data).collect()} == {"new york city", "york city new", "city new york"}
    assert len(plans) == 2 and all("FlatMapCoGroupsInArrow" in p and "collect_list" not in p for p in plans)


def test_phrases_of_nothing(spark, none):
    assert phrases.collocations(none).count() == 0
    assert phrases.score(F.lit(2), F.lit(2), F.lit(3)) is not None
    big = spark.range(1).select(phrases.score(F.lit(10**14 - 1), F.lit(10**14), F.lit(10**14 + 7)).alias("s")).first()["s"]
    assert big == 1000000 * (10**14 - 1) ** 2 // (10**14 * (10**14 + 7))


def made_of_passages(seed):
    rng = np.random.default_rng(seed)
    letters = lambda low, high, n: bytes(rng.integers(low, high, n).astype(np.uint8))
    passages, few = [letters(97, 123, 800) for _ in range(6)], [letters(97, 99, 400) for _ in range(3)]
    texts = []
    for _ in range(100):
        parts = []
        for _ in range(rng.integers(0, 6)):
            kind, begin = rng.integers(0, 5), rng.integers(0, 500)
            parts.append([passages[rng.integers(0, 6)][begin : begin + rng.integers(150, 800)], letters(97, 123, rng.integers(1, 300)), few[rng.integers(0, 3)][begin % 100 :],
                          b"ab" * rng.integers(1, 300), b"x" * rng.integers(100, 400)][kind])
        texts.append(b"".join(parts).decode())
    return [*texts, "", "a" * 199, texts[3], texts[3], "é" * 150, "漢字" * 300]


def removed_by_brute_force(texts, length=200):
    data = [t.encode() for t in texts]
    count = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])


@pytest.mark.parametrize(("group", "piece", "held"), [(4096, 1 << 20, 400_000), (3, 1 << 20, 400_000), (4096, 700, 50)])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, group, piece, held):
    texts = made_of_passages(group)
    rows = [(k % 90, t, "clash", 1) for k, t in enumerate(texts)] + [(None, texts[5], None, None), (7, None, "x", 2)]
    for name, value in (("PIECE", piece), ("HELD", held)):
        monkeypatch.setattr(repeats, name, value)
    data = spark.createDataFrame(rows, "doc_id long, text string, mark string, n_bytes long").repartition(4)
    got = repeats.without_repeats(data, group=group).collect()
    want = Counter(zip([r[0] for r in rows], removed_by_brute_force([r[1] or "" for r in rows]), strict=True))
    assert Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in got) == want


def test_repeated_bytes_of_nothing(none):
    assert repeats.without_repeats(none).count() == 0
