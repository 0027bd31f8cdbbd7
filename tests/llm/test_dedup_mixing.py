import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from barloom.llm import dedup, mixing


def test_decisions_equal_brute_force(docs, raw, none):
    groups = defaultdict(list)
    for r in raw:
        groups[r[1] or ""].append(r[0])
    expected = []
    for text, ids in groups.items():
        keep, taken = max((i for i in ids if i is not None), default=None), False
        for i in ids:
            kept = i == keep and not taken
            taken |= kept
            expected.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in dedup.decisions(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert dedup.decisions(none).collect() == []


def test_one_whole_row_of_each_text_stays(docs, raw, none):
    got = dedup.deduplicate(docs)
    assert got.columns == docs.columns
    kept = {(r["text"] or ""): r["doc_id"] for r in got.collect()}
    assert len(kept) == got.count() == len({r[1] or "" for r in raw})
    assert kept[""] == 1 and kept["one"] == 3 and kept["copy of a hot text, many times over and over again"] == 179
    assert got.where("text IS NULL").count() == 1  # the null text has the larger id and is kept as it is
    assert dedup.deduplicate(none).collect() == []


def test_no_python_on_the_main_path(docs):
    for out in (dedup.decisions(docs), dedup.deduplicate(docs)):
        assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


def test_hot_group_reaches_the_last_stage_as_one_row_a_salt(docs):
    rows = docs.select(F.lit("d").alias("digest"), F.lit("same").alias("text"), "doc_id", F.col("doc_id").alias("salt_key"))
    assert dedup.combine(rows, "doc_id", salts=4).collect()[0]["size"] == docs.count()


def filled(sizes, weights, share, repeats):
    """Targets by handing out the budget again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        give = {s: left * weight[s] / total for s in free}
        for s in give:
            more = min(give[s], repeats * sizes[s] - target[s])
            target[s] += more
            left -= more
            if repeats * sizes[s] - target[s] < 1e-9:
                free.discard(s)
    return target


def test_mix_meets_its_targets(docs, raw, none):
    narrow = docs.select("doc_id", "source", "text", "size")
    got = mixing.mix(narrow, parts=16).select("row.*", F.col("size").alias("words"), "source_size", "target", "taken").collect()
    got = [r.asDict() for r in got]
    assert len(got) == len(raw)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in raw:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
    target = filled(sizes, mixing.WEIGHTS, 1.5, 2)
    out = mixing.mix(narrow, parts=16).select("row.source", "size", "source_size", "target", "taken").collect()
    for source, size, source_size, goal, took in out:
        assert source_size == sizes[source] and abs(goal - target[source]) < 1e-6
        assert took in (0, size, 2 * size)
        taken[source] += took
    for source in sizes:
        assert abs(taken[source] - target[source]) <= largest[source]
    again = mixing.mix(narrow.repartition(3), parts=16).select("row.doc_id", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(x) for x in mixing.mix(narrow, parts=16).select("row.doc_id", "taken").collect())
    assert mixing.mix(none.select("doc_id", "source", "text")).collect() == []
    blank = docs.where("trim(coalesce(text, '')) = ''").select("doc_id", "source", "text")
    assert {(r["target"], r["taken"]) for r in mixing.mix(blank).collect()} == {(0.0, 0)}
