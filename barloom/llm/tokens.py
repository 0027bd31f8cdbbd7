"""Token ids by public tokenizers, and token counts with overlap resynchronisation for huge documents."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from barloom.llm.common import binary_array, plain, slices

#: Splitting pattern of the tokenizer file whose plain ASCII words can be cut beforehand (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Units whose ids a worker remembers before it starts anew.
REMEMBERED = 200_000

#: What a byte can be: white space, letter, digit, other printable sign, or anything that is left to the library.
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KINDS = np.array([_SPACE if c in b" \t\n\v\f\r" else _LETTER if chr(c).isalpha() and c < 128 else _DIGIT if chr(c).isdigit() and c < 128
                   else _SIGN if 32 < c < 127 and c != ord("'") else _ODD for c in range(256)], np.uint8)
#: Lead bytes of U+00C0 to U+017F, which are letters but for three (times, division, and a capital that has no single lower form).
_LEADS = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5])
_NO_LETTERS = [(0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)]
_SIMPLE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    own = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    others = iter(range(256, 512))
    return [chr(c) if c in own else chr(next(others)) for c in range(256)]


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters, digits and runs of other signs of all texts in a row, and the offset of each text's first, with the end.

    A word (between white space) that holds anything but Latin letters, digits and ASCII signs, or an apostrophe, is one unit.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    base = int(offsets[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8, int(offsets[-1]) - base, base) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    begins = offsets - base
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    kind = _KINDS[data]
    lead = np.flatnonzero(_LEADS[data[:-1]])
    letter = np.ones(len(lead), bool)
    for first, second in _NO_LETTERS:
        letter &= (data[lead] != first) | (data[lead + 1] != second)
    kind[lead[letter]] = _LETTER
    kind[lead[letter] + 1] = _LETTER
    full = kind != _SPACE
    start = full.copy()
    start[1:] &= ~full[:-1]
    edges = begins[:-1][np.diff(begins) > 0]
    start[edges] = full[edges]
    words = np.flatnonzero(start)
    if not len(words):
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    odd = np.flatnonzero(np.logical_or.reduceat(kind == _ODD, words))
    change = full.copy()
    change[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    ends = np.concatenate([words[1:], [len(data)]])
    for a, b in zip(words[odd].tolist(), ends[odd].tolist(), strict=True):
        change[a:b] = False
    change |= start
    at = np.flatnonzero(change)
    place = np.cumsum(full) - 1
    cuts = np.concatenate([place[at], [place[-1] + 1]])
    found = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[full]))])
    return found, np.searchsorted(at, begins)


class Encoder:
    """Ids of a ``tokenizers`` file for many texts at once, without added special tokens.

    If the file drops white space and splits at it and between letters, digits and other signs, ids of a text are the ids of these
    units in a row; each distinct unit is then encoded once and remembered. Any other file, and any text that holds a
    special string, is encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.special = [x["content"] for x in parts["added_tokens"]]
        steps = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        norms = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        split = steps[0]
        self.by_word = (norms == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split["pattern"].get("Regex") == WORD_PATTERN
                        and split["behavior"] == "Removed" and split["invert"] and len(steps) == 2 and steps[1]["type"] == "ByteLevel"
                        and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and parts["post_processor"] is None
                        and parts["model"]["dropout"] is None and not any(x.isspace() for s in self.special for x in s))
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _remember(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        first = len(self.place)
        while first + len(words) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.length[first : first + len(words)] = lengths
        self.start[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.place.update(zip(words, range(first, first + len(words)), strict=True))

    def _learn(self, names: list[str]) -> None:
        tokenize, letters = self.lib.model.tokenize, self.letters
        simple, others, ids, lengths = [], [], [], []
        for name in names:
            if not _SIMPLE.fullmatch(name):
                others.append(name)
                continue
            low = name.lower()
            got = tokenize(low if low.isascii() else "".join([letters[c] for c in low.encode()]))
            ids += [x.id for x in got]
            simple.append(name)
            lengths.append(len(got))
        self._remember(simple, np.array(ids, np.uint32), np.array(lengths, np.int64))
        for i in range(0, len(others), 20_000):
            some = others[i : i + 20_000]
            got = self.lib.encode(some, is_pretokenized=True, add_special_tokens=False)
            self._remember(some, np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found, cuts = units(texts)
        found = found.dictionary_encode()
        names = found.dictionary.to_pylist()
        if len(self.place) > REMEMBERED:
            self.forget()
        self._learn([x for x in names if x not in self.place])
        at = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))[found.indices.to_numpy()]
        lengths = self.length[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.start[at] - ends[:-1], lengths)]
        return ids, ends[cuts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the offsets at which each text begins, with the end."""
        whole = np.full(len(texts), not self.by_word)
        for mark in self.special if self.by_word else []:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._words(texts)
        parts = {}
        if not whole.all():
            ids, cuts = self._words(texts.filter(pa.array(~whole)))
            parts = {int(row): ids[cuts[k] : cuts[k + 1]] for k, row in enumerate(np.flatnonzero(~whole))}
        for row in np.flatnonzero(whole):
            parts[int(row)] = np.array(self.lib.encode(texts[int(row)].as_py(), add_special_tokens=False).ids, np.uint32)
        each = [parts[k] for k in range(len(texts))]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, cuts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after every text."""
    out = np.insert(ids, cuts[1:], end)
    return out.astype(np.uint32), cuts + np.arange(len(cuts))


class PieceEncoder:
    """Ids of a sentencepiece model; huge texts are encoded in overlapping chunks and spliced.

    A place between two characters is proven stable if no piece of the model holds them side by side: no merge can
    then reach over it, so both sides are encoded as if alone. Two chunks are spliced where both encodings
    have such a boundary in their overlap; without one the overlap is widened, at last to the rest of the text.
    """

    def __init__(self, path: str, chunk: int = 1 << 16, overlap: int = 1 << 10) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.pairs = set()
        for i in range(self.lib.get_piece_size()):
            piece = self.lib.id_to_piece(i)
            if not (self.lib.is_control(i) or self.lib.is_byte(i) or self.lib.is_unknown(i)):
                self.pairs.update(map("".join, zip(piece, piece[1:], strict=False)))
        # chunks stand for themselves only if the model leaves characters and white space alone and puts one mark in front
        self.faithful = self.lib.normalize("a  b éﬁ A  ") == "▁a▁▁b▁éﬁ▁A▁▁"

    def _boundaries(self, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Character offsets at which tokens of text[begin:end] start, and the ids."""
        got = self.lib.encode(text[begin:end], return_type="offset_mapping")
        return np.array([x[0] for x in got["offsets"]], np.int64) + begin, np.array(got["ids"], np.int64)

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece can reach over the place before character ``at``."""
        return (text[at - 1] + text[at]).replace(" ", "▁") not in self.pairs

    def _spliced(self, text: str) -> list[int]:
        ids: list[int] = []
        begin, kept = 0, 0  # this chunk starts at ``begin``; ids up to character ``kept`` are final
        end = min(len(text), self.chunk)
        starts, got = self._boundaries(text, 0, end)
        while end < len(text):
            wide = self.overlap
            while True:
                back = max(kept, end - wide)
                to = min(len(text), back + self.chunk + wide)
                # what a chunk starts with differs by the mark in front, so it is matched from its second token on
                after, next_ids = self._boundaries(text, back, to)
                common = np.intersect1d(starts[starts > back], after[1:])
                place = next((int(x) for x in common[::-1] if x < end and self.stable(text, int(x))), None)
                if place is not None:
                    break
                if back == kept:  # the overlap is all that isn't final: take the rest as one
                    end, wide = min(len(text), end + wide), wide * 2
                    starts, got = self._boundaries(text, begin, end)
                    if end == len(text):
                        place = -1
                        break
                else:
                    wide *= 2
            if place < 0:
                break
            ids += got[(starts >= kept) & (starts < place)].tolist()
            kept, begin, end, starts, got = place, back, to, after, next_ids
        ids += got[starts >= kept].tolist()
        return ids

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.chunk or not self.faithful:
            return self.lib.encode(text)
        return self._spliced(text)


_PIECE_ENCODERS: dict[tuple, PieceEncoder] = {}


def _piece_counts(texts: pa.Array, path: str, chunk: int, overlap: int) -> np.ndarray:
    key = (path, chunk, overlap)
    if key not in _PIECE_ENCODERS:
        _PIECE_ENCODERS[key] = PieceEncoder(*key)
    own = _PIECE_ENCODERS[key]
    counts = np.zeros(len(texts), np.int64)
    values = texts.to_pylist()
    short = [i for i, x in enumerate(values) if len(x) <= chunk]
    for i in range(0, len(short), 64):
        some = short[i : i + 64]
        counts[some] = [len(x) for x in own.lib.encode([values[k] for k in some], num_threads=1)]
    for i in set(range(len(values))) - set(short):
        counts[i] = len(own.encode(values[i]))
    return counts


def token_counts(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """``docs`` without the text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    ``path`` names a file of ``tokenizers`` (.json) or sentencepiece (.model) that all executors can read. A null
    text counts as empty; empty texts have 0 tokens. Texts over ``chunk`` characters are encoded in chunks that overlap.
    Rows are independent, so repeated rows and empty tables need no rule; columns that are named like an
    output are replaced by it.
    """
    names = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    rest = docs.select(*names, docs[text].cast("string").alias(text))
    schema = docs.select(*names).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(len(names)))
            for i, j in slices(texts):
                part = texts[i:j]
                if path.endswith(".model"):
                    n = _piece_counts(part, path, chunk, overlap)
                else:
                    n = np.diff(encoder(path).encode(part)[1])
                more = [pc.binary_length(part).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[i:j] for k in range(len(names))), *more], names=schema.names)

    return rest.mapInArrow(count, schema)


def id_columns(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Ids between the cuts as binary little-endian unsigned 32-bit values."""
    return binary_array(ids.astype("<u4"), cuts)
