"""Toxicity: a convolutional text classifier in numpy.

Words become hashed embeddings, filters of several widths run over them, each
filter keeps its maximum over the whole text, and a logistic unit joins them.
Only buckets that training touched in MIN_DOCS documents or more are stored;
every other word has the zero vector, so unknown words are neutral.
"""

from __future__ import annotations

import pickle
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Codes, low_words, table, trimmed

BUCKET_BITS = 30
SAMPLE = 6000  # labelled rows at most; they are the first by a hash of their id
SAMPLE_WORDS = 10_000_000  # words of all training texts together; a row that would exceed them is left out whole
MIN_DOCS = 5
DIM, FILTERS, WIDTHS = 8, 6, (1, 2, 3)
EPOCHS, RATE, DECAY = 5, 0.02, 1e-4
CUT = 0.7
STEMS = (4, 5, 6, 7)  # lengths of the stems that share a vector
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>-_=+~`^/\\"


def features(word: bytes) -> list[int]:
    """Buckets of a word without punctuation around it: its own, and those of its stems (the first 4 to 7 characters)."""
    w = word.strip(_STRIP).decode("utf-8", "replace")
    return [xxhash.xxh3_64_intdigest(x) & ((1 << BUCKET_BITS) - 1) for x in (w, *("<" + w[:k] for k in STEMS if k < len(w)))]


def _packed_features(new: list[bytes]) -> list[bytes]:
    return [np.array(features(w), np.int64).tobytes() for w in new]


@dataclass
class Model:
    known: np.ndarray  # sorted buckets
    vectors: np.ndarray  # len(known) + 1 rows; the last is zero
    filters: list[np.ndarray]  # by width: width * DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    cuts: dict[str, float] = field(default_factory=dict)  # by language; CUT elsewhere

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(buckets), dtype=np.int64)
        at = np.searchsorted(self.known, buckets)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == buckets, at, len(self.known))

    def embedded(self, packed: list[bytes]) -> np.ndarray:
        """A vector for each word, given as its packed features: the sum over those that are stored."""
        if not packed:
            return np.zeros((0, DIM), np.float32)
        starts = np.cumsum([0, *(len(x) // 8 for x in packed[:-1])])
        return np.add.reduceat(self.vectors[self.rows(np.frombuffer(b"".join(packed), np.int64))], starts, axis=0)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over a text's word vectors, and where it is."""
        most, where = [], []
        if len(x) < max(WIDTHS):
            x = np.concatenate([x, np.zeros((max(WIDTHS) - len(x), DIM), np.float32)])
        for width, w in zip(WIDTHS, self.filters, strict=True):
            y = x[: len(x) - width + 1] @ w[:DIM]
            for k in range(1, width):
                y += x[k : len(x) - width + 1 + k] @ w[k * DIM : (k + 1) * DIM]
            at = y.argmax(axis=0)
            where.append(at)
            most.append(y[at, np.arange(FILTERS)])
        return np.concatenate(most) + self.bias, np.concatenate(where)

    def side_by_side(self) -> np.ndarray:
        """All filters' weights, DIM rows: one product then serves every width."""
        return np.concatenate([w[k * DIM : (k + 1) * DIM] for width, w in zip(WIDTHS, self.filters, strict=True) for k in range(width)], axis=1)

    def score(self, x: np.ndarray, weights: np.ndarray | None = None) -> float:
        if len(x) < max(WIDTHS):
            x = np.concatenate([x, np.zeros((max(WIDTHS) - len(x), DIM), np.float32)])
        y, most, at = x @ (self.side_by_side() if weights is None else weights), [], 0
        for width in WIDTHS:
            n, z = len(x) - width + 1, y[: len(x) - width + 1, at : at + FILTERS]
            for k in range(1, width):
                z = z + y[k : n + k, at + k * FILTERS : at + (k + 1) * FILTERS]
            most.append(z.max(axis=0))
            at += width * FILTERS
        f = np.concatenate(most) + self.bias
        return float(1 / (1 + np.exp(-np.clip(np.tanh(f) @ self.out + self.out_bias, -30, 30))))


def constant(share: float) -> Model:
    """What is left to say without two classes: the share of toxic labels."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    n = FILTERS * len(WIDTHS)
    return Model(np.zeros(0, np.int64), np.zeros((1, DIM), np.float32), [np.zeros((w * DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(n, np.float32), np.zeros(n, np.float32), float(np.log(share / (1 - share))))


def train(texts: list[np.ndarray], lexicon: list[bytes], labels: np.ndarray, langs: list[str | None], seed: int = 7) -> Model:
    """texts: each row's words as places in lexicon. Adam in batches of 32 rows; a row's gradient reaches only the words that its filters chose."""
    if not len(labels) or labels.min() == labels.max():
        return constant(float(labels.mean()) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    sizes, flat = np.zeros(len(lexicon), np.int64), array("q")
    for i, w in enumerate(lexicon):
        own = features(w)
        sizes[i] = len(own)
        flat.extend(own)
    flat = np.frombuffer(flat, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    spread = lambda words: np.repeat(starts[words] - np.concatenate([[0], np.cumsum(sizes[words])[:-1]]), sizes[words]) + np.arange(sizes[words].sum())
    found, docs = np.unique(np.concatenate([np.unique(flat[spread(np.unique(t))]) for t in texts if len(t)]), return_counts=True)
    model = constant(float(labels.mean()))
    model.known = found[docs >= MIN_DOCS]
    model.vectors = np.concatenate([rng.normal(0, 0.02, (len(model.known), DIM)), np.zeros((1, DIM))]).astype(np.float32)
    model.filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    model.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
    flat = model.rows(flat)
    held = np.array([i % 5 == 0 for i in range(len(labels))]) if len(labels) >= 100 else np.zeros(len(labels), bool)
    params = [model.vectors, *model.filters, model.bias, model.out]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(np.flatnonzero(~held))
        for at in range(0, len(order), 32):
            part, g_bias = order[at : at + 32], 0.0
            words, inverse = np.unique(np.concatenate([np.zeros(1, np.int64), *(texts[i] for i in part)]), return_inverse=True)
            vectors = np.add.reduceat(model.vectors[flat[spread(words)]], np.concatenate([[0], np.cumsum(sizes[words])[:-1]]), axis=0)
            grads = [np.zeros_like(p) for p in params[1:]]
            pull = np.zeros((len(words), DIM), np.float32)
            begin = 1
            for i in part:
                own = inverse[begin : begin + len(texts[i])]
                begin += len(texts[i])
                f, where = model.pooled(vectors[own])
                t = np.tanh(f)
                p = 1 / (1 + np.exp(-np.clip(t @ model.out + model.out_bias, -30, 30)))
                d = (p - labels[i]) / len(part)
                g_bias += d
                grads[-1] += d * t
                df = d * model.out * (1 - t * t)
                grads[-2] += df
                for k, width in enumerate(WIDTHS):
                    dk, at_k = df[k * FILTERS : (k + 1) * FILTERS], where[k * FILTERS : (k + 1) * FILTERS]
                    for j in range(width):
                        real = at_k + j < len(own)
                        r = own[(at_k + j)[real]]
                        w = slice(j * DIM, (j + 1) * DIM)
                        grads[k][w, real] += (vectors[r] * dk[real, None]).T
                        np.add.at(pull, r, (dk[None, :] * model.filters[k][w]).T[real])
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            model.out_bias -= RATE * g_bias
            hit = np.flatnonzero(pull.any(axis=1))
            r, back = np.unique(flat[spread(words[hit])], return_inverse=True)
            g = np.zeros((len(r), DIM), np.float32)
            np.add.at(g, back, np.repeat(pull[hit], sizes[words[hit]], axis=0))
            g += DECAY * model.vectors[r]
            m1[0][r] = 0.9 * m1[0][r] + 0.1 * g
            m2[0][r] = 0.999 * m2[0][r] + 0.001 * g * g
            model.vectors[r] -= rate * m1[0][r] / (np.sqrt(m2[0][r]) + 1e-6)
            model.vectors[-1] = 0
            for p, g, a, b in zip(params[1:], grads, m1[1:], m2[1:], strict=True):
                g = g + DECAY * p
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= rate * a / (np.sqrt(b) + 1e-6)
    vectors = np.add.reduceat(model.vectors[flat], starts[:-1], axis=0)
    model.cuts = calibrated(model, vectors, texts, labels, langs, held)
    return model


def calibrated(model: Model, vectors, texts, labels, langs, held, precision: float = 0.97) -> dict[str, float]:
    """By language, from rows kept out of training: the least threshold of 0.3 or more with the precision; CUT where rows are few."""
    cuts = {}
    scores = {i: model.score(vectors[texts[i]]) for i in np.flatnonzero(held)}
    for lang in {x for x in langs if x is not None}:
        own = sorted(((s, labels[i]) for i, s in scores.items() if langs[i] == lang), reverse=True)
        if len(own) < 30 or not any(y for _, y in own):
            continue
        hits, cut = 0, None
        for n, (s, y) in enumerate(own, 1):
            hits += y
            if s >= 0.3 and hits >= precision * n:
                cut = s
        if cut is not None:
            cuts[lang] = float(min(cut, CUT))
    return cuts


def fit(documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS, fold: int | None = 1) -> Model:
    """Train on at most `sample` labelled documents, the first by a hash of their id, of `sample_words` words in all. fold: rows
    whose crc32(doc_id) mod 3 is that one are left out. One task trains; the driver gets the model alone.

    Null labels, labels without a document and null texts are left out; repeated labels count by their maximum, and of
    the rows of a repeated doc_id the one of the smallest text counts. A table without `lang` has no language."""
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if fold is not None:
        y = y.where(order % 3 != fold)
    y = y.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None)
    d = documents.select("doc_id", "text", lang.cast("string").alias("lang")).where(F.col("text").isNotNull())
    rows = d.join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.any_value("toxic").alias("toxic"), F.min(F.struct("text", "lang")).alias("d"))
    rows = rows.select("doc_id", "toxic", "d.text", "d.lang").repartition(1).sortWithinPartitions(order, "doc_id")

    def run(batches):
        lexicon, left = Codes(), sample_words
        texts, toxic, langs = [], [], []
        for b in batches:
            for text, own, lang in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("lang").to_pylist(), strict=True):
                words = low_words(text)
                if len(words) <= left:
                    left -= len(words)
                    texts.append(lexicon.of(words).astype(np.int32))
                    toxic.append(own)
                    langs.append(lang)
        model = pickle.dumps(train(texts, list(lexicon), np.array(toxic, np.int64), langs))
        del texts, lexicon
        trimmed()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    got = rows.select("text", "toxic", "lang").mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else constant(0.0)


class Embedder:
    """Words' vectors, computed once for each word and kept between batches until the codes start anew."""

    def __init__(self, model: Model):
        self.model, self.words, self.vectors = model, Codes(), np.zeros((0, DIM), np.float32)

    def __call__(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if self.words.full():
            self.vectors = self.vectors[:0]
        codes = [self.words.of(t) for t in texts]
        if new := self.words.take():
            self.vectors = np.concatenate([self.vectors, self.model.embedded(_packed_features(new))])
        return [self.vectors[c] for c in codes]


def _scorer(held):
    """texts -> scores."""
    model: Model = held.value
    embed, weights = Embedder(model), model.side_by_side()

    def scores(texts: list[str | None]) -> list[float]:
        out: list[float] = []
        for k in range(0, len(texts), 256):
            out += [model.score(x, weights) for x in embed([low_words(t) for t in texts[k : k + 256]])]
        return out

    return scores


def score(documents: DataFrame, model: Model, *, text: str = "text", score_as: str = "score", flag_as: str = "toxic_flag", lang: str = "lang") -> DataFrame:
    """documents with two more columns: the score of each whole text (0 to 1) and whether it reaches its language's threshold.

    A null or empty text scores as the model's prior. A null, unknown or missing language takes CUT. Columns of these
    names that were there are replaced. Rows are scored one by one: repeated rows get equal scores; an empty table stays empty."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(model)
    base = documents.drop(score_as, flag_as)
    schema = T.StructType([*base.schema.fields, T.StructField(score_as, T.DoubleType()), T.StructField(flag_as, T.BooleanType())])

    def run(batches):
        scores, cuts = _scorer(held), held.value.cuts
        for b in batches:
            s = scores(b.column(text).to_pylist())
            langs = b.column(lang).to_pylist() if lang in b.schema.names else [None] * len(s)
            flags = [x >= cuts.get(g, CUT) for x, g in zip(s, langs, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array(flags, pa.bool_())], [*b.schema.names, score_as, flag_as])

    return base.mapInArrow(run, schema)


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The documents whose score stays below their language's threshold, columns unchanged.

    Null and empty texts score as the model's prior; without a `lang` column every row takes CUT. Repeated rows stay or
    go together; an empty table stays empty; other columns, of whatever name, pass as they are."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores, cuts = _scorer(held), held.value.cuts
        for b in batches:
            langs = b.column("lang").to_pylist() if "lang" in b.schema.names else [None] * b.num_rows
            keep = [x < cuts.get(g, CUT) for x, g in zip(scores(b.column("text").to_pylist()), langs, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))
        del scores
        trimmed()

    return documents.mapInArrow(run, documents.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text", "lang"), model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        "toxic_flag",
    )


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
