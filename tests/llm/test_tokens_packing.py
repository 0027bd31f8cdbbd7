import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import idfile, packing, tokens
from barloom.llm.common import plain

WORDS, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_word_encoder_equals_the_library(raw, library):
    rng = random.Random(4)
    bits = ["the", "The,", "don't", "I'LL", "3.14", "İ", "é", "é", "H̱x", " ", "\x1c", "\x0b", "  ", "\n", "漢字", "<|endoftext|>", "<|", "ß.", "'s", "naïve's", "a_b", "🎉", " ", "Ǆ"]
    texts = [r[1] or "" for r in raw] + ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(60)) for _ in range(120)]
    own = tokens.Encoder(WORDS)
    assert own.by_word
    for _ in range(2):  # the second time from memory
        ids, cuts = own.encode(plain(pa.array(texts)))
        for k, text in enumerate(texts):
            assert ids[cuts[k] : cuts[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_spliced_encoding_equals_the_whole():
    own = tokens.PieceEncoder(PIECES, chunk=200, overlap=8)
    assert own.faithful
    rng = random.Random(1)
    bits = ["abc ", "  ", "\n", "the", "é", "漢字", "🎉", "x" * 50, " of the ", "\t", "aaaa", "▁", "<s>", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 600))) for _ in range(150)] + ["漢" * 900 + "a" * 900 + " " * 900 + "b", "a" * 3000, " " * 3000]
    for text in texts:
        assert own.encode(text) == own.lib.encode(text)


def test_token_counts(spark, docs, raw, none, library):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for path, count in ((PIECES, lambda t: len(lib.encode(t))), (WORDS, lambda t: len(library.encode(t, add_special_tokens=False).ids))):
        got = tokens.token_counts(docs.withColumn("n_tokens", F.lit("clash")), path, limit=100, chunk=300, overlap=16)
        assert set(docs.columns) - {"text"} <= set(got.columns)
        found = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()), key=str)
        assert found == sorted(((r[0], len((r[1] or "").encode()), count(r[1] or ""), count(r[1] or "") > 100) for r in raw), key=str)
        assert tokens.token_counts(none, path).collect() == []


def check_packed(got, expected, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[(r["doc_id"], r["doc_tokens"])].append((r["start"], r["length"], r["ids"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    have = defaultdict(list)
    for (doc, n), parts in by_doc.items():
        starts = defaultdict(list)
        for start, length, ids in parts:
            starts[start].append(ids)
        rows = [b"".join(starts[s][k] for s in sorted(starts)) for k in range(len(starts[0]))]
        for row in rows:
            assert len(row) == 4 * n
            have[doc].append(row)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in expected.items()}
    used, padded = sum(r["length"] for r in got), capacity * len(by_sequence)
    return used / padded


def test_packing_keeps_every_id_once(docs, raw, none, library):
    pieces = packing.cut_documents(docs, WORDS, capacity=256)
    got = packing.pack(pieces, capacity=256, step=8, parts=4).collect()
    expected = defaultdict(list)
    for r in raw:
        expected[r[0]].append(np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    assert check_packed(got, expected, 256) > 0.9
    assert packing.pack(packing.cut_documents(none, WORDS)).collect() == []


def test_patterns_are_near_the_bound():
    rng = np.random.default_rng(1)
    counts = dict(zip(*np.unique(rng.integers(1, 60, 5000), return_counts=True), strict=True))
    placed = packing.plan({int(k): int(n) for k, n in counts.items()}, 64)
    ends = {k: np.append(v[1:, 0], counts[k]) for k, v in placed.items()}
    sequences = max(int((v[:, 2] - (-(ends[k] - v[:, 0]) // v[:, 1])).max()) for k, v in placed.items())
    assert sequences <= 1.03 * sum(int(k) * int(n) for k, n in counts.items()) / 64 + 2


def test_sequences_are_assembled(docs):
    packed = packing.pack(packing.cut_documents(docs, WORDS, capacity=256), capacity=256, parts=4)
    for r in packing.sequences(packed, 256).collect():
        assert len(r["ids"]) == 4 * r["n_tokens"] and (r["padded"] == 256 or r["padded"] == r["n_tokens"])


@pytest.mark.parametrize("values", [[0], [5, 5, 5], list(range(0, 9000, 7)), [-(2**62), -3, 0, 2**62], sorted(random.Random(2).sample(range(10**9), 3000)), [0] * 500 + [10**6] * 500])
def test_elias_fano_round_trip(values):
    code = idfile.EliasFano.encode(np.array(values, np.int64))
    assert code.all().tolist() == values
    index = np.array(sorted({0, len(values) - 1, len(values) // 2, len(values) // 3}))
    assert code.select(index).tolist() == [values[i] for i in index]
    if len(values) == 3000:
        assert len(code.low) + len(code.high) < 3000 * 8 / 2


def test_id_files_round_trip(spark, docs, raw, none, library, monkeypatch):
    monkeypatch.setattr(idfile, "BLOCK", 500)
    path = idfile.write_ids(docs, idfile.scratch(spark), WORDS, partitions=3)
    got = sorted((r.asDict() for r in idfile.read_ids(spark, path).collect()), key=lambda r: r["start"])
    order = sorted(raw, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    at = 0
    for have, r in zip(got, order, strict=True):
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (have["start"], have["n_tokens"], have["ids_crc32"], have["ids"]) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    block = spark.read.parquet(f"{path}/blocks").where("n_docs > 2").first().asDict(recursive=True)
    first = next(r for r in got if r["start"] >= block["start"] and block["part"] == 0) if block["part"] == 0 else None
    if first:
        assert idfile.lookup(block, 0).astype("<u4").tobytes() == first["ids"]
    empty = idfile.write_ids(none, idfile.scratch(spark), WORDS, partitions=2)
    assert idfile.read_ids(spark, empty).collect() == []
