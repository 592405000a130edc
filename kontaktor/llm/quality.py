"""Quality rules by tokeniser fertility.

A public subword vocabulary with byte fallback reads every word of a text. Text
that the vocabulary was made for takes few tokens a character, hardly falls back
to bytes and has a wide spread of tokens; junk leaves these bands.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import WHITE, Codes, table, trimmed, words

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50  # fixed by the contract: words, percent

#: (least, most) characters per token, most byte-fallback share, least token entropy in bits; by language, else by script.
BANDS = {
    "en": ((2.03, 6.5), 0.05, 5.4),
    "de": ((2.08, 6.5), 0.05, 5.4),
    "es": ((1.80, 6.5), 0.05, 5.4),
    "fr": ((1.80, 6.5), 0.05, 5.4),
}
SCRIPT_BANDS = {
    "latin": ((1.2, 7.0), 0.10, 3.5),
    "other": ((0.3, 7.0), 0.90, 3.0),
}

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
FIELDS += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
FIELDS += [T.StructField(n, T.DoubleType()) for n in ("chars_per_token", "byte_share", "token_entropy")]


class Fertility:
    """Token ids of single words in one flat array, kept between batches until the codes start anew."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.words = Codes()
        self.size, self.flat, self.start = (np.zeros(0, np.int64) for _ in range(3))

    def codes(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if self.words.full():
            self.size, self.flat, self.start = (np.zeros(0, np.int64) for _ in range(3))
        out = [self.words.of(t) for t in texts]
        if new := self.words.take():
            ids = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
            sizes = np.array([len(x) for x in ids], np.int64)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))])
        return out

    def tokens(self, codes: np.ndarray) -> np.ndarray:
        """Counts by token id."""
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.flat[at], minlength=len(self.is_byte))


def repeated(codes: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of `width` words which the text has twice or more."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    key = codes[:n].copy()
    if codes.max() >> (63 // width):
        # Codes that don't fit side by side: rank words, then windows one word longer each time.
        names, codes = np.unique(codes, return_inverse=True)
        key = codes[:n]
        for k in range(1, width):
            key = np.unique(key * len(names) + codes[k : n + k], return_inverse=True)[1]
    else:
        for k in range(1, width):
            key <<= 63 // width
            key |= codes[k : n + k]
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    many = np.isin(key, again)
    hit = np.zeros(len(codes), bool)
    for k in range(width):
        hit[k : n + k] |= many
    return int(hit.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """Whether half the letters of the whole text are Latin; a text without letters counts so too."""
    letters = [(c, n) for c, n in Counter(text).items() if c.isalpha()]
    return "latin" if sum(n for c, n in letters if c < "ɐ") * 2 >= sum(n for _, n in letters) else "other"


def verdict(lang: str | None, text: str, chars: float, byte: float, entropy: float, bands=None) -> bool:
    bands = BANDS if bands is None else bands
    (least, most), bytes_most, entropy_least = bands.get(lang) or SCRIPT_BANDS[script(text)]
    return least <= chars <= most and byte <= bytes_most and entropy >= entropy_least


def _measure(vocabulary: str, bands):
    fertility = Fertility(vocabulary)

    def rows(texts: list[str | None], langs: list[str | None]) -> list[tuple]:
        out = []
        for k in range(0, len(texts), 256):
            part = [t or "" for t in texts[k : k + 256]]
            split = [words(t) for t in part]
            for t, w, codes, lang in zip(part, split, fertility.codes(split), langs[k : k + 256], strict=True):
                chars = len(t) - sum(map(t.count, WHITE))
                symbols, lines, again = sum(map(t.count, SYMBOLS)), duplicate_lines(t), repeated(codes)
                failed = len(w) < MIN_WORDS or 100 * again > MOST_REPEATED * len(w)
                counts = fertility.tokens(codes)
                n = counts.sum()
                share = counts[counts > 0] / n if n else np.ones(1)
                measures = (chars / n, float(counts[fertility.is_byte].sum() / n), float(-(share * np.log2(share)).sum())) if n else (0.0, 0.0, 0.0)
                out.append((len(w), chars, symbols, lines, again, failed, not failed and verdict(lang, t, *measures, bands), *measures))
        return out

    return rows


def measured(documents: DataFrame, *, vocabulary: str | None = None, bands=None) -> DataFrame:
    """documents' columns (but those of the measures' names, which are replaced) and the measures of each whole text.

    A null text counts as one without words: base_failed, not kept. A null lang, or one without a band, takes its
    script's. Rows are measured one by one: repeated rows get equal measures; an empty table stays empty."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    base = documents.drop(*(f.name for f in FIELDS))

    def run(batches):
        rows = _measure(vocabulary, bands)
        for b in batches:
            got = rows(b.column("text").to_pylist(), b.column("lang").to_pylist() if "lang" in b.schema.names else [None] * b.num_rows)
            columns = list(zip(*got, strict=True)) or [()] * len(FIELDS)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*b.schema.names, *(f.name for f in FIELDS)])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *FIELDS]))


def of_quality(documents: DataFrame, *, vocabulary: str | None = None, bands=None) -> DataFrame:
    """The documents that the rules keep, columns unchanged.

    Null texts and texts without words fail the base rules and go. A null, unknown or missing language takes its
    script's band. Repeated rows stay or go together; an empty table stays empty; other columns pass as they are."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches):
        rows = _measure(vocabulary, bands)
        for b in batches:
            got = rows(b.column("text").to_pylist(), b.column("lang").to_pylist() if "lang" in b.schema.names else [None] * b.num_rows)
            yield b.filter(pa.array([r[6] for r in got], pa.bool_()))
        del rows
        trimmed()

    return documents.mapInArrow(run, documents.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return measured(docs).drop("text", "lang")


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}

