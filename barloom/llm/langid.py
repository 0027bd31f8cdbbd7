"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are byte n-grams of lower-cased words with marks at both ends. Training is stochastic gradient descent in
numpy over a bounded sample of labelled documents; for prediction embeddings and output layer are folded into
one table of logits per bucket. Confidence is calibrated by a temperature and a rejection threshold on a validation
part of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import plain, slices, unit_hash

#: Hash buckets of subwords, their lengths in bytes, and the width of the embedding.
BUCKETS, SIZES, WIDTH = 1 << 15, (2, 3, 4), 16
#: About so many labelled documents are learnt from, shared evenly by the languages.
SAMPLE = 4000
#: Share of rightly predicted validation documents that the rejection threshold may cost, and its upper bound.
FALSE_REJECTS, HIGHEST = 0.0005, 0.5

#: Bytes of text whose subwords are made at once.
PART_BYTES = 1 << 17

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def parts(texts: pa.Array, size: int = PART_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Groups of pieces of the texts, of about ``size`` bytes each: whose they are, and the pieces. Long texts are cut between words."""
    rows, some, held = [], [], 0
    for row in range(len(texts)):
        data = texts[row].as_buffer().to_pybytes()
        begin = 0
        while begin < len(data):
            blank = data.find(b" ", begin + size)
            end = blank if blank > begin else len(data)
            rows.append(row)
            some.append(data[begin:end])
            held += end - begin
            begin = end
            if held >= size:
                yield np.array(rows), some
                rows, some, held = [], [], 0
    if some:
        yield np.array(rows), some


def subwords(some: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of subwords: which text each is in, and its bucket."""
    data = np.frombuffer(b"".join([b" " + x + b" " for x in some]).translate(_FOLD), np.uint8)
    ends = np.cumsum([len(x) + 2 for x in some])
    blank = data == 32
    for n in SIZES:
        if len(data) < n:
            continue
        code = np.zeros(len(data) - n + 1, np.uint32)
        inner = np.zeros(len(code), bool)
        for k in range(n):
            code = code * np.uint32(0x01000193) + data[k : k + len(code)] + np.uint32(n)
            if 0 < k < n - 1:
                inner |= blank[k : k + len(code)]
        # a subword may start or end with the mark of a word's end, but has none within, nor marks alone
        good = ~inner & ~(blank[: len(code)] & blank[n - 1 :]) if n > 2 else ~(blank[:-1] | blank[1:])
        at = np.flatnonzero(good)
        code = code[at]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        code ^= code >> np.uint32(13)
        # texts are parted by two blanks, so none of the kept ones reaches into the next text
        yield np.searchsorted(ends, at, side="right"), (code & np.uint32(BUCKETS - 1)).astype(np.int32)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's subwords and how often each occurs."""
    counts = np.zeros(BUCKETS, np.int64)
    for _, some in parts(plain(pa.array([text], pa.string()))):
        for _, codes in subwords(some):
            counts += np.bincount(codes, minlength=BUCKETS)
    codes = np.flatnonzero(counts)
    return codes.astype(np.int32), counts[codes].astype(np.float32)


@dataclass
class LanguageModel:
    """Folded logits by bucket, and the calibration."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        out, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for rows, some in parts(texts):
            for owner, codes in subwords(some):
                counts += np.bincount(rows[owner], minlength=len(texts))
                for k in range(len(self.languages)):
                    out[:, k] += np.bincount(rows[owner], self.table[:, k][codes], minlength=len(texts))
        return softmax((out / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 6, seed: int = 3) -> LanguageModel:
    """Train on labelled texts; a tenth of them calibrates temperature and rejection."""
    return fit_bags([bag(x) for x in texts], langs, epochs, seed)


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 6, seed: int = 3) -> LanguageModel:
    """The same from the bags of the texts."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    target = np.searchsorted(np.array(languages, object), np.array(langs, object)) if languages else np.zeros(0, np.int64)
    usable = [i for i, x in enumerate(bags) if len(x[0])]
    rng.shuffle(usable)
    held, used = usable[: len(usable) // 10], usable[len(usable) // 10 :]
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (WIDTH, max(1, len(languages)))).astype(np.float32), np.zeros(max(1, len(languages)), np.float32)
    turns, step = max(1, epochs * len(used)), 0
    for _ in range(epochs):
        rng.shuffle(used)
        for i in used:
            codes, counts = bags[i]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ embed[codes]
            error = softmax((mean @ out + bias)[None])[0]
            error[target[i]] -= 1
            rate = np.float32(0.5 * (1 - step / turns) + 0.01)
            back = out @ error
            out -= rate * np.outer(mean, error)
            bias -= rate * np.float32(0.1) * error
            # mean of many subwords: each gets its share of the step, scaled up so that rare ones move as well
            embed[codes] -= (rate * 20) * share[:, None] * back
            step += 1
    model = LanguageModel(languages, (embed @ out).astype(np.float64), bias.astype(np.float64))
    check = held or used
    if check and len(languages) > 1:
        logits = np.stack([(counts @ model.table[codes]) / counts.sum() for codes, counts in (bags[i] for i in check)]) + model.bias
        right = target[check]
        heat = np.geomspace(0.25, 4, 33)
        loss = [-np.log(softmax(logits / t)[np.arange(len(check)), right]).mean() for t in heat]
        model.temperature = float(heat[int(np.argmin(loss))])
        sure = softmax(logits / model.temperature)
        good = np.sort(sure.max(axis=1)[sure.argmax(axis=1) == right])
        if len(good):
            model.threshold = float(min(HIGHEST, good[int(len(good) * FALSE_REJECTS)] / 2))
    return model


def train(docs: DataFrame, use: Column | None = None, sample: int = SAMPLE, seed: int = 5) -> LanguageModel:
    """Learn from rows with a non-null lang (of those where ``use`` holds); the bags of about ``sample`` texts reach the driver.

    A bag has at most ``BUCKETS`` numbers, however long its text is.
    """
    rows = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull())
    rows = rows.where(use) if use is not None else rows
    # a row for each language
    found = {x["lang"]: x["count"] for x in rows.groupBy("lang").count().collect()}
    if not found:
        return LanguageModel([], np.zeros((BUCKETS, 1)), np.zeros(1))
    share = F.coalesce(*[F.when(docs["lang"] == k, F.lit(sample / len(found) / n)) for k, n in found.items()])
    chosen = rows.where(unit_hash("doc_id", seed=seed) < share).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(plain(batch.column(3))):
                codes, counts = bag(text.as_py())
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[k : k + 1] for c in range(3)), pa.array([codes.tobytes()]), pa.array([counts.tobytes()])],
                                                 names=["doc_id", "mark", "lang", "codes", "counts"])

    got = chosen.mapInArrow(counted, "doc_id long, mark long, lang string, codes binary, counts binary").toPandas().sort_values(["doc_id", "mark"])
    missing = set(found) - set(got["lang"])
    model = fit_bags([(np.frombuffer(x, np.int32), np.frombuffer(y, np.float32)) for x, y in zip(got["codes"], got["counts"], strict=True)], got["lang"].tolist())
    if missing and len(found) == 1:
        model.languages = sorted(found)
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected appended; columns of these names are replaced.

    ``und`` with score 0, rejected, if the text is null or has no letter. ``rejected`` also holds if the score is
    below the calibrated threshold. Nothing but the text is looked at, every text is read whole, rows are independent.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    letters = F.coalesce(docs[text].cast("string").rlike(r"\p{L}"), F.lit(False))
    # a text that is kept anyway goes through Python once
    own = text in names and dict(docs.dtypes)[text] == "string"
    rows = docs.select(*names, letters.alias("__letters"), *([] if own else [docs[text].cast("string").alias("__text")]))
    at = names.index(text) if own else len(names) + 1
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(at))
            for i, j in slices(texts, 1 << 20):
                lettered = batch.column(len(names))[i:j].to_numpy(zero_copy_only=False).astype(bool)
                if model.languages:
                    sure = model.probabilities(texts[i:j])
                    best, score = sure.argmax(axis=1), sure.max(axis=1)
                    said = np.where(lettered, np.array(model.languages, object)[best], "und")
                else:
                    said, score = np.full(j - i, "und", object), np.zeros(j - i)
                score = np.where(lettered, score, 0.0)
                more = [pa.array(said, pa.string()), pa.array(score), pa.array((said == "und") | (score < model.threshold))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[i:j] for k in range(len(names))), *more], names=schema.names)

    return rows.mapInArrow(predict, schema)
