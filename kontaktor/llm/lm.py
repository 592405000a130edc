"""Language-model scoring with a weighted backoff automaton.

The model holds every pair and triple that occurs LEAST times, smoothed by absolute
discounting, and backs off to exact counts of all words. Its frequent n-grams become
states and arcs; a state's failure arc leads to its shorter context at the cost of
its backoff weight. One traversal from left to right carries the state through a
text and adds up log-probabilities. What each other word, pair and triple adds to
that is a number of its own, which its occurrences meet in a bucket.

Counts are exact and distributed, words and n-grams told apart by 64-bit hashes. A
position of a text is one record: a pair and what follows it. Tasks sort records, pack
them in blocks by bucket of their pair, and deal the blocks out; so each bucket has all
that belongs to its pairs, and a record takes a few bytes of a shuffle. Pairs and triples
meet by joins only for the numbers that other buckets have; gains are settled in buckets,
from blocks too. Texts are cut into words by Arrow, many at once, and what is told of a
word is told once for all its places in such a cut. What a worker
holds is bounded: the WORDS commonest words, and at most 1 / GRAM_SHARE n-grams of each
order have such a share of all tokens. These bounds change no score.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mixed, table, trimmed, written

END = b"\n"  # no word holds white space
NONE = b""  # stands where a text has ended; no word is empty
ADD = 0.1  # fixed by the contract: what smoothing adds to each count
ORDER = 3
WORDS = 250_000  # the commonest words, whose counts every worker has
CLASS_SHARE = 5e-5  # words with this share are tokens of the automaton
GRAM_SHARE = 5e-6  # n-grams of tokens with this share are arcs; all others meet their texts in a bucket
HOT_SHARE = 1e-3  # pairs of two words with this share are spread over SALTS buckets, by what follows them
SALTS = 64
LEAST = 2  # the model's n-grams are all that occur so often, at any size
DISCOUNT = 0.5
REST = 0  # the class of all words that are no tokens of the automaton
FOLD = 1_500_000  # records that a task sorts and packs at once
CUT = 4_000_000  # bytes of texts that are cut into words at once; a longer text is cut alone
BUCKET = 2_000_000  # tokens for each bucket
PARTS = 16  # of a bucket, by hash of the pair, whose records are summed up one after the other
SLICE = 100_000  # records whose buckets are told at once, and of a bucket that are summed up at once where PARTS allow
ANSWER = 4_000_000  # bytes of blocks that go back to Spark at once


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0


def freed() -> None:
    """As common.trimmed, with what Arrow keeps: two workers share an executor's memory with it, and each serves many tasks."""
    pa.default_memory_pool().release_unused()
    trimmed()


@dataclass
class Cut:
    """Texts cut into words, as common.low_words does."""

    sizes: np.ndarray  # words of each text
    numbers: np.ndarray  # of all words, text after text: their places in `words`
    words: pa.Array  # distinct, as bytes


def cuts(texts: pa.Array) -> Iterator[Cut]:
    """Slices of texts in their order; a null text is empty. Arrow's white space is that of ASCII too."""
    total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + CUT, "right")) - 1)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(at, to - at), "")))
        sizes, words = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
        full = pc.binary_length(words).to_numpy() > 0  # there is an empty one before and after outer white space
        if not full.all():
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
            words = words.filter(pa.array(full))
        words = words.dictionary_encode()
        del lists, full
        yield Cut(sizes, words.indices.to_numpy(), words.dictionary.cast(pa.binary()))
        at = to


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over all tokens of the training texts, END included; each task adds up its part first."""

    def run(batches):
        parts, ends = [], 0

        def added():
            return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in batches:
            for cut in cuts(b.column("text")):
                parts.append(pa.table({"word": cut.words, "n": np.bincount(cut.numbers, minlength=len(cut.words))}))
                ends += len(cut.sizes)
                if len(parts) > 1 and sum(len(x) for x in parts) > 500_000:
                    parts = [added()]
                if len(parts[0]) > 500_000:
                    yield from parts.pop().to_batches()
        if ends:
            parts.append(pa.table({"word": pa.array([END], pa.binary()), "n": np.array([ends])}))
            yield from added().to_batches()
        freed()

    return training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Those of Spark's xxhash64 over the same bytes."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words))


def joined(left: np.ndarray, right: np.ndarray, order: int) -> np.ndarray:
    """Hashes of n-grams of `order` words, from those of the two that they are made of."""
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right, order - 1)


@dataclass
class Lexicon:
    """What every worker knows of words: codes from 1 on, the commonest first; 0 is NONE, rarer words are numbered from `size` on."""

    words: pa.Array  # by code
    end: int  # the code of END
    hashes: np.ndarray  # by code
    counts: np.ndarray  # by code, in training
    hot: int  # codes from 1 to hot have HOT_SHARE
    buckets: int
    fold: int  # records that a task sorts and packs at once

    @property
    def size(self) -> int:
        return len(self.words)

    def bucket(self, pair: np.ndarray, hot: np.ndarray, after: np.ndarray) -> np.ndarray:
        """A pair's bucket; what follows a hot one, given as the hash of the pair after it, salts it."""
        salted = np.where(hot, after % np.uint64(SALTS) + np.uint64(1), np.uint64(0))
        return (mixed(pair + salted, 3) % np.uint64(self.buckets)).astype(np.int32)

    def is_hot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a <= self.hot) & (b <= self.hot)


STAT, GRAMS, TAIL, TRIPLES, RARE, PAIRS = range(6)  # kinds of blocks, in the order in which a bucket reads them
MODEL = "p int, kind int, block binary, o long, k long, l long, r long, n long, bow double"


def lexicon_of(known: dict[bytes, int], n: int, buckets: int) -> Lexicon:
    words = sorted(known, key=lambda w: (-known[w], w))
    hot, words = sum(known[w] >= max(2, HOT_SHARE * n) for w in words), [NONE, *words]
    return Lexicon(pa.array(words, pa.binary()), words.index(END), word_hashes(words), np.array([known.get(w, 0) for w in words], np.int64), hot, buckets, FOLD)


def packed(parts: list[np.ndarray], wide: list[np.ndarray]) -> bytes:
    """Columns of counting numbers, of as many bytes as the largest needs, and columns of 64 bits; byte by byte, as the first
    bytes of all numbers are alike, the second ones too, and so on; compressed."""
    widths = [max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1 for x in parts] + [8] * len(wide)
    head = np.array([len(parts), len(wide), *widths, *map(len, parts), *map(len, wide)], "<u4")
    planes = (np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, k] for x, width in zip((*parts, *wide), widths, strict=True) for k in range(width))
    return zstandard.compress(np.concatenate([head.view(np.uint8), *planes]), 3)


def unpacked(block: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw = np.frombuffer(zstandard.decompress(block), np.uint8)
    n_parts, n_wide = raw[:8].view("<u4").tolist()
    n = n_parts + n_wide
    head = raw[8 : 8 + 8 * n].view("<u4").tolist()
    at, out = 8 + 8 * n, []
    for k, (width, size) in enumerate(zip(head[:n], head[n:], strict=True)):
        x = np.zeros((size, 8), np.uint8)
        x[:, :width] = raw[at : at + width * size].reshape(width, size).T
        out.append(x.reshape(-1).view("<i8" if k < n_parts else "<u8"))
        at += width * size
    return out[:n_parts], out[n_parts:]


class Places:
    """Where keys stand among sorted ones: by a table of their hashes, and by search where some share a slot."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, min(22, (len(keys) * 16).bit_length()))
        self.keys, self.shift, self.table = keys, np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        slot, own = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        self.table[slot] = own
        self.table[slot[self.table[slot] != own]] = -2

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, keys: np.ndarray) -> np.ndarray:
        """-1 for those that aren't there."""
        at = self.table[self._slot(keys)]
        if not len(self.keys):
            return at
        if len(shared := np.flatnonzero(at == -2)):
            at[shared] = np.minimum(np.searchsorted(self.keys, keys[shared]), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class Records:
    """Positions of texts as (first, second, third word): each pair and what follows it, NONE at the end.

    Words are codes of the lexicon, or numbers of this fold, whose hashes go with each block."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.end = lexicon, lexicon.end
        self.clear()

    def clear(self) -> None:
        self.rare: list[np.ndarray] = []  # hashes, by number
        self.n_rare = 0
        self.lines: list[np.ndarray] = []
        self.records: list[np.ndarray] = []  # of each text in the lines
        self.rows: list[np.ndarray] = []
        self.length = 0

    def codes(self, cut: Cut) -> np.ndarray:
        """By number of the cut's words: the code, or for words that the lexicon doesn't know -1 and less, each its own."""
        out = pc.fill_null(pc.index_in(cut.words, value_set=self.lexicon.words), -1).to_numpy().astype(np.int32)
        rare = np.flatnonzero(out < 0)
        out[rare] = -1 - rare
        return out

    def add(self, cut: Cut, codes: np.ndarray, row: int = 0) -> Iterator[int]:
        """Take in a cut's texts, the first of which is `row`. Pauses where a fold is due before more can come in, with the number
        of texts that are in wholly. A text longer than a fold fills folds of its own."""
        most, sizes, records = self.lexicon.fold, cut.sizes, cut.sizes + 1
        begin, ends = np.cumsum(sizes + 3) - (sizes + 3), np.cumsum(records)
        # Each text between two ENDs and with NONE after them.
        line = np.full(len(cut.numbers) + 3 * len(sizes), self.end, np.int32)
        line[np.arange(len(cut.numbers)) + np.repeat(begin + 1 - (np.cumsum(sizes) - sizes), sizes)] = codes[cut.numbers]
        line[begin + sizes + 2] = 0
        i = 0
        while i < len(sizes):
            if records[i] > most:
                if self.length:
                    yield i
                for at in range(0, int(records[i]), most):
                    n = min(most, int(records[i]) - at)
                    self._take(line[begin[i] + at : begin[i] + at + n + 2], np.array([n]), row + i, cut)
                    yield i + (at + n == records[i])
                i += 1
                continue
            to = int(np.searchsorted(ends, ends[i] - records[i] + most - self.length, "right"))
            if to <= i:
                yield i
                continue
            self._take(line[begin[i] : begin[to - 1] + sizes[to - 1] + 3], records[i:to], row + i, cut)
            i = to

    def _take(self, line: np.ndarray, records: np.ndarray, row: int, cut: Cut) -> None:
        """Rare words are numbered anew in each fold; one may have several numbers there, but only one hash."""
        line, at = line.copy(), np.flatnonzero(line < 0)
        own = -1 - line[at]
        there = np.zeros(len(cut.words), bool)
        there[own] = True
        numbers, there = np.zeros(len(cut.words), np.int32), np.flatnonzero(there)
        numbers[there] = self.lexicon.size + self.n_rare + np.arange(len(there))
        line[at] = numbers[own]
        self.rare.append(word_hashes(cut.words.take(pa.array(there)).to_pylist()))
        self.n_rare += len(there)
        self.lines.append(line)
        self.records.append(records)
        self.rows.append(row + np.arange(len(records)))
        self.length += int(records.sum())

    def fold(self, held: Places | None = None, with_rows: bool = False) -> tuple[list[tuple], int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, block) of all records so far, the first one's row, from which rows count, and where rare words stand: their
        numbers, rows, and hashes by number. held: hashes of triples whose records aren't needed."""
        lines, records, each = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in ((self.lines, np.int32), (self.records, np.int64), (self.rows, np.int64)))
        hashes = np.concatenate([self.lexicon.hashes, *self.rare])
        self.clear()
        place = np.arange(records.sum(), dtype=np.int32)
        place += np.repeat(2 * np.arange(len(records), dtype=np.int32), records)
        a = lines[place]
        key = a.astype(np.int64)
        for _ in range(2):
            place += 1
            key <<= 21
            key |= lines[place]
        begin, rows = int(each[0]) if len(each) else 0, None
        rare = (np.zeros(0, np.int64),) * 3
        if with_rows:
            rows = np.repeat((each - begin).astype(np.int32), records)
            of = np.flatnonzero(a >= self.lexicon.size)
            rare = (a[of].astype(np.int64) - self.lexicon.size, rows[of], hashes[self.lexicon.size :])
        del a, lines, place
        if with_rows:
            order = np.argsort(key)
            key = key[order]
            rows = rows[order]
            del order
        else:
            key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        times = np.diff(np.append(first, len(key))).astype(np.int32)
        key = key[first]
        del first
        a, b, c = ((key >> shift & (1 << 21) - 1).astype(np.int32) for shift in (42, 21, 0))
        del key
        bucket = np.empty(len(a), np.int32)
        for x in range(0, len(a), SLICE):
            i = slice(x, x + SLICE)
            pair, after = joined(hashes[a[i]], hashes[b[i]], 2), joined(hashes[b[i]], hashes[c[i]], 2)
            bucket[i] = self.lexicon.bucket(pair, self.lexicon.is_hot(a[i], b[i]), after)
            if held is not None:
                # A held triple's pair is held too: such a record adds nothing.
                bucket[i][held.of(joined(pair, after, 3)) >= 0] = -1
            del pair, after
        order = np.argsort(bucket.astype(np.int16) if self.lexicon.buckets < 1 << 15 else bucket, kind="stable")
        bucket, starts = bucket[order], np.cumsum(times, dtype=np.int32) - times
        times = times[order]
        if with_rows:
            place = np.repeat(starts[order] - (np.cumsum(times, dtype=np.int32) - times), times)
            place += np.arange(len(rows), dtype=np.int32)
            rows = rows[place]
            del place
        a = a[order]
        b = b[order]
        c = c[order]
        del order, starts
        edges = [*np.flatnonzero(np.diff(bucket, prepend=-2)).tolist(), len(bucket)]
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(times, dtype=np.int32)])
        out, size = [], self.lexicon.size
        for x, y in zip(edges, edges[1:]):
            if bucket[x] < 0:
                continue
            words = np.concatenate([a[x:y], b[x:y], c[x:y]])
            at = np.flatnonzero(words >= size)
            own_rare, own = np.unique(words[at], return_inverse=True)
            words[at] = size + own
            k = y - x
            columns = [np.diff(words[:k], prepend=0), words[k : 2 * k], words[2 * k :], times[x:y]]
            if with_rows:
                columns.append(rows[total[x] : total[y]])
            out.append((int(bucket[x]), packed(columns, [hashes[own_rare]])))
        return out, begin, rare


def opened(block: bytes, lexicon: Lexicon) -> tuple[np.ndarray, ...]:
    """(a, b, pair, after, ends, times, rows, hashes) of a block's records: codes, hashes, whether nothing follows, numbers, rows, hashes by code."""
    (a, b, c, times, *rows), (wide,) = unpacked(block)
    a = np.cumsum(a)
    hashes = np.concatenate([lexicon.hashes, wide])
    return a, b, joined(hashes[a], hashes[b], 2), joined(hashes[b], hashes[c], 2), c == 0, times, rows[0] if rows else None, hashes


def _blocks(batches):
    """(bucket, kind, block) of batches sorted by bucket and kind. A batch holds most of what a task reads, so its blocks are copied one by one."""
    for b in batches:
        for p, kind, block in zip(b.column("p").to_pylist(), b.column("kind").to_pylist(), b.column("block"), strict=True):
            yield p, kind, block.as_py()


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place where each key stands, its number, and for each row that of its key."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    of_row = np.empty(len(n), np.int64)
    of_row[order] = np.repeat(total, np.diff(np.append(first, len(keys))))
    return order[first], total, of_row


COUNTED = "o int, k long, l long, r long, p int, hot boolean, n long, of long, rn long"


def gram_counts(training: DataFrame, lexicon: Lexicon) -> DataFrame:
    """COUNTED: all pairs (o = 2) and triples (o = 3) that occur at least LEAST times: the hash of pairs, those of the two that
    they are made of, their bucket, whether it is salted, their number n, and the number `of` of the context and `rn` of the
    second word, where the bucket knows it. A hot pair has a row for each of its buckets."""
    held = training.sparkSession.sparkContext.broadcast(lexicon)

    def emit(batches):
        records = Records(held.value)
        for b in batches:
            for cut in cuts(b.column("text")):
                for _ in records.add(cut, records.codes(cut)):
                    yield _dealt(records.fold()[0])
                    freed()
        yield _dealt(records.fold()[0])
        freed()

    def count(batches):
        lex, at, parts, wide = held.value, None, [], [held.value.hashes]

        def code(words):
            """Common words by their codes, others by places among all hashes of the bucket's blocks."""
            return np.where(words < lex.size, words, words + (sum(map(len, wide)) - lex.size)).astype(np.int32)

        def known(codes):
            return np.where(codes < lex.size, lex.counts[np.minimum(codes, lex.size - 1)], -1)

        def settle():
            """Part by part: to sum records up takes several times what they take."""
            hashes = np.concatenate(wide)
            del wide[1:]
            step = max(1, min(PARTS, PARTS * SLICE // max(1, sum(int(x[0][-1]) for x in parts))))
            for k in range(0, PARTS if parts else 0, step):
                yield from settled(hashes, *(np.concatenate([x[c][x[0][k] : x[0][min(k + step, PARTS)]] for x in parts]) for c in range(1, 8)))
            parts.clear()

        def settled(hashes, pair, after, a, b, hot, ends, n):
            i, total, of_pair = summed(pair, n)
            keep = hot[i] | (total >= LEAST)
            i, total = i[keep], total[keep]
            yield from _counted(2, pair[i], hashes[a[i]], hashes[b[i]], at, hot[i], total, known(a[i]), known(b[i]))
            pair, after, n, hot, of_pair = pair[~ends], after[~ends], n[~ends], hot[~ends], np.where(hot, -1, of_pair)[~ends]
            i, total, _ = summed(joined(pair, after, 3), n)
            keep = total >= LEAST
            i, total = i[keep], total[keep]
            yield from _counted(3, None, pair[i], after[i], at, hot[i], total, of_pair[i], np.full(len(i), -1))

        for p, _, block in _blocks(batches):
            if p != at:
                yield from settle()
                freed()
                at = p
            a, b, pair, after, ends, times, _, hashes = opened(block, lex)
            part = ((pair >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)).astype(np.uint8)
            order = np.argsort(part, kind="stable")
            columns = pair, after, code(a), code(b), lex.is_hot(a, b), ends, times.astype(np.int32)
            parts.append((np.searchsorted(part[order], np.arange(PARTS + 1)), *(x[order] for x in columns)))
            wide.append(hashes[lex.size :].copy())
        yield from settle()
        freed()

    blocks = training.select("text").mapInArrow(emit, "p int, block binary").withColumn("kind", F.lit(0))
    return sorted_buckets(blocks, lexicon.buckets).mapInArrow(count, COUNTED)


def sorted_buckets(blocks: DataFrame, buckets: int) -> DataFrame:
    """Blocks dealt out by bucket; a task reads its buckets one after the other."""
    tasks = min(buckets, max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 8))
    return blocks.repartition(tasks, "p").sortWithinPartitions("p", "kind")


def _dealt(blocks: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], ["p", "block"])


def _counted(o: int, k, l, r, p, hot, n, of, rn):
    """Batches of COUNTED; -1 is unknown."""
    for i in range(0, len(l), 100_000):
        j = slice(i, i + 100_000)
        size = len(l[j])
        number = lambda x: pa.array(x[j].astype(np.int64), mask=x[j] < 0)
        columns = [pa.array(np.full(size, o, np.int32)), pa.nulls(size, pa.int64()) if k is None else pa.array(k[j].view(np.int64)), *(pa.array(x[j].view(np.int64)) for x in (l, r))]
        columns += [pa.array(np.full(size, p, np.int32)), pa.array(hot[j]), pa.array(n[j].astype(np.int64)), number(of), number(rn)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COUNTED.split(", ")])


def gains(counts: DataFrame, grams: DataFrame, n: int, v: int, lexicon: Lexicon) -> tuple[DataFrame, DataFrame]:
    """Words (k, n, bow), and a table of pairs and triples, MODEL: blocks (p, kind, block) of hashes and gains, and rows
    (o, k, l, r, n, bow) of those that are frequent. A gain is what each occurrence adds to the log10 score of its text,
    beyond what the parts that it is made of add; bow is the log10 backoff weight as a context. grams, written by o, are discarded.

    A triple stands in place of its pair's lower probability times the weight of its context, and a pair in place of
    its word's. Each occurrence of a word or pair, but for the last, is a context, and the last is none in training either.
    A pair's bucket has all triples that go on from it, and so its weight as a context; sums of salted ones, at most one for
    each pair of two hot words, go to all buckets."""
    scale, often = n + ADD * (v + 1), max(LEAST, n * GRAM_SHARE)
    word = counts.select(F.xxhash64("word").alias("k"), "n")
    salted = (F.col("o") == 2) & F.col("hot")
    hot = grams.where(salted).groupBy("k", "l", "r", "hot").agg(F.min("p").alias("p"), F.sum("n").alias("n"), F.any_value("of").alias("of"), F.any_value("rn").alias("rn")).where(F.col("n") >= LEAST)
    hot = written(hot)
    pairs = grams.where(~F.col("hot") & (F.col("o") == 2)).drop("o").unionByName(hot)
    triples = grams.where(F.col("o") == 3).drop("o", "k", "rn")
    q, below = (F.col("n") - DISCOUNT) / F.col("of"), (F.col("rn") + ADD) / scale
    weight = F.log10(F.greatest(1 - F.sum(q), F.lit(1e-9)) / F.greatest(1 - F.sum(below), F.lit(1e-9))).alias("bow")
    held = counts.sparkSession.sparkContext.broadcast(lexicon)

    def pack2(batches):
        """Blocks of pairs: hashes, gains but for what weights as contexts add, and the place, number and words of frequent ones."""
        buckets, parts = held.value.buckets, []

        def pack():
            p, k, v, n, l, r = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order, edges = by_bucket(p)
            out = []
            for x, y in zip(edges, edges[1:]):
                at = order[x:y]
                f = np.flatnonzero(n[at])
                out.append((int(p[at[0]]), PAIRS, packed([f, n[at[f]]], [z.view(np.uint64) for z in (k[at], v[at], l[at[f]], r[at[f]])])))
            return _rows_of("p int, kind int, block binary", out)

        for b in batches:
            p, k, v, n, l, r = (b.column(c).to_numpy() for c in ("p", "k", "v", "n", "l", "r"))
            n, hot_ = np.where(n >= often, n, 0), b.column("hot").to_numpy(zero_copy_only=False)
            if hot_.any():
                # A hot pair's gain lies in each bucket that one of its records may fall in.
                at = np.flatnonzero(hot_)
                spread = (mixed(k[at].view(np.uint64)[:, None] + np.arange(1, SALTS + 1, dtype=np.uint64), 3) % np.uint64(buckets)).astype(np.int64)
                at, to = np.unique(np.stack([np.repeat(at, SALTS), spread.reshape(-1)]), axis=1)
                parts.append((to.astype(np.int32), k[at], v[at], np.where(to == p[at], n[at], 0), l[at], r[at]))
            parts.append(tuple(x[~hot_] for x in (p, k, v, n, l, r)))
            if sum(len(x[0]) for x in parts) > 200_000:
                yield pack()
        if sum(len(x[0]) for x in parts):
            yield pack()
        freed()

    def pack3(batches):
        """Blocks of triples: hashes of context and of the pair after it, and numbers. What the contexts of salted ones
        sum up to goes in rows (l, q, below)."""
        parts = []

        def pack():
            p, hot, n, of, rn, rof, l, r = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order, edges = by_bucket(p)
            out = []
            for x, y in zip(edges, edges[1:]):
                at = order[x:y]
                out.append((int(p[at[0]]), TRIPLES, packed([z[at] for z in (hot, n, of, rn, rof)], [z[at].view(np.uint64) for z in (l, r)]), None, None, None))
            contexts, at = np.unique(l[hot], return_inverse=True)
            sums = (np.bincount(at, (x - DISCOUNT)[hot] / y[hot]).tolist() for x, y in ((n, of), (rn, rof)))
            out += [(None, None, None, *x) for x in zip(contexts.tolist(), *sums, strict=True)]
            return _rows_of(packed3, out)

        for b in batches:
            parts.append((b.column("p").to_numpy(), b.column("hot").to_numpy(zero_copy_only=False), *(b.column(c).to_numpy() for c in ("n", "of", "rn", "rof", "l", "r"))))
            if sum(len(x[0]) for x in parts) > 200_000:
                yield pack()
        if parts:
            yield pack()
        freed()

    def settle(batches):
        """Blocks of hashes and gains, and rows of frequent pairs and triples: all of a bucket's contexts meet their triples."""
        at, pairs, triples = None, [], []
        hot_keys, hot_bow = hot_weights.value

        def at_hot(keys, bow):
            if len(hot_keys):
                i = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
                bow = np.where(hot_keys[i] == keys, hot_bow[i], bow)
            return bow

        def bucket():
            columns = [np.concatenate(x) for x in zip(*([*parts, *wide] for parts, wide in triples), strict=True)] if triples else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.uint64)] * 2
            order = np.argsort(columns[5])
            _, n, of, rn, rof, l, r = (x[order] for x in columns)
            q, below = (n - DISCOUNT) / of, (rn - DISCOUNT) / rof
            first = np.flatnonzero(np.concatenate([[True], l[1:] != l[:-1]])) if len(l) else np.zeros(0, np.int64)
            contexts = l[first]
            left = [np.maximum(1 - (np.add.reduceat(x, first) if len(first) else x), 1e-9) for x in (q, below)]
            bow = at_hot(contexts, np.log10(left[0] / left[1]))
            k3, v3 = joined(l, r, 3), np.log10(q) - np.log10(below) - np.repeat(bow, np.diff(np.append(first, len(l))))
            rows, keys, gains = [], [k3], [v3]
            for (f, n2), (k2, v2, l2, r2) in pairs:
                own = np.zeros(len(k2))
                if len(contexts):
                    i = np.minimum(np.searchsorted(contexts, k2), len(contexts) - 1)
                    own = np.where(contexts[i] == k2, bow[i], 0.0)
                own = at_hot(k2, own)
                keys.append(k2)
                gains.append(v2.view(np.float64) + own)
                rows.append((2, k2[f], l2, r2, n2, own[f]))
            f = np.flatnonzero(n >= often)
            rows.append((3, k3[f], l[f], r[f], n[f], np.zeros(len(f))))
            keys, gains = np.concatenate(keys), np.concatenate(gains)
            order = np.argsort(keys)
            yield _rows_of(MODEL, [(at, GRAMS, packed([], [keys[order], gains[order].view(np.uint64)]), *(None,) * 6)])
            for o, k, l, r, n, bow in rows:
                if len(k):
                    yield _rows_of(MODEL, list(zip(*([None] * len(k),) * 3, [o] * len(k), *(x.view(np.int64).tolist() for x in (k, l, r, n)), bow.tolist(), strict=True)))

        for p, kind, block in _blocks(batches):
            if p != at:
                if at is not None:
                    yield from bucket()
                at, pairs, triples = p, [], []
            (pairs if kind == PAIRS else triples).append(unpacked(block))
        if at is not None:
            yield from bucket()
        freed()

    packed3 = "p int, kind int, block binary, l long, q double, below double"
    left = lambda t: t.select(F.col("k").alias("l"), F.col("n").alias("of"))
    # Buckets know the numbers of common words and of their own pairs; only the others are joined.
    known = F.col("of").isNotNull() & F.col("rn").isNotNull()
    other = pairs.where(~known).drop("of", "rn").join(left(word), "l").join(word.select(F.col("k").alias("r"), F.col("n").alias("rn")), "r")
    other = written(other)
    own2 = pairs.where(known).unionByName(other)
    weights2 = written(own2.groupBy("l").agg(weight))
    of_hot = triples.where(F.col("of").isNull()).drop("of").join(left(hot), "l")
    own3 = triples.where(F.col("of").isNotNull()).unionByName(of_hot).join(own2.select(F.col("k").alias("r"), F.col("n").alias("rn"), F.col("of").alias("rof")), "r")
    blocks3 = written(own3.select("p", "hot", "n", "of", "rn", "rof", "l", "r").mapInArrow(pack3, packed3))
    discard(grams, part="o=3")
    sums = blocks3.where(F.col("block").isNull()).groupBy("l").agg(F.sum("q").alias("q"), F.sum("below").alias("below")).toArrow().sort_by("l")
    sums = [sums.column(c).to_numpy() for c in ("l", "q", "below")]
    order = np.argsort(sums[0].view(np.uint64))
    hot_weights = counts.sparkSession.sparkContext.broadcast((sums[0].view(np.uint64)[order], np.log10(np.maximum(1 - sums[1], 1e-9) / np.maximum(1 - sums[2], 1e-9))[order]))
    words = written(word.join(weights2.withColumnRenamed("l", "k"), "k", "left"))
    gain = F.log10(q) - F.log10(below) - F.col("bow")
    blocks2 = own2.join(weights2, "l").select("p", "k", "l", "r", "n", "hot", gain.alias("v")).mapInArrow(pack2, "p int, kind int, block binary")
    table = written(sorted_buckets(blocks2.union(blocks3.where(F.col("block").isNotNull()).select("p", "kind", "block")), lexicon.buckets).mapInArrow(settle, MODEL))
    discard(grams, hot, other, weights2, blocks3)
    return words, table


def by_bucket(p: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Rows by bucket, and where each bucket begins among them."""
    order = np.argsort(p, kind="stable")
    return order, [*np.flatnonzero(np.diff(p[order], prepend=-1)).tolist(), len(p)]


def _rows_of(shape: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    names = [c.split() for c in shape.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, names, strict=True)], [name for name, _ in names])


@dataclass
class Automaton:
    """States are contexts: 0 the empty one, then words, then longer ones. Arcs lie sorted by state * size + token."""

    tokens: dict[bytes, int]
    keys: np.ndarray  # of arcs
    gain: np.ndarray  # their log10 probabilities
    to: np.ndarray  # the states that they lead to
    backoff: np.ndarray  # log10, by state
    shorter: np.ndarray  # failure arcs
    token: np.ndarray  # by code of the lexicon: the token, or REST
    logs: np.ndarray  # by code: log10 probabilities of the words that every worker knows
    beside: np.ndarray  # by code: of those that are no tokens, what they add beside REST's arc
    log_rest: float  # of REST's whole mass
    unseen: float  # log10 probability of a word that isn't in training
    scale: float  # N + ADD * (V + 1)
    start: int
    n: int
    v: int

    @functools.cached_property
    def places(self) -> Places:
        return Places(self.keys)

    @property
    def arcs(self) -> dict[int, tuple[float, int]]:
        return {k: (g, t) for k, g, t in zip(self.keys.tolist(), self.gain.tolist(), self.to.tolist(), strict=True)}

    def follow(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probabilities of tokens and the states after them: failure arcs are taken until an arc is there."""
        size, places, total, state = len(self.tokens) + 1, self.places, np.zeros(len(state)), state.copy()
        left = np.arange(len(state))
        while len(left):
            at = places.of(state[left] * size + token[left])
            hit = at >= 0
            on = left[hit]
            total[on] += self.gain[at[hit]]
            state[on] = self.to[at[hit]]
            left = left[~hit]
            total[left] += self.backoff[state[left]]
            state[left] = self.shorter[state[left]]
        return total, state

    def scores(self, tokens: np.ndarray, sizes: np.ndarray, stretch: int = 64) -> np.ndarray:
        """The log10 probability of each text's tokens, text after text, none empty, from the start state, left to right. A state
        is what the last ORDER - 1 tokens lead to from anywhere, so texts are cut in stretches that take their steps side by side."""
        starts = np.cumsum(sizes) - sizes
        pieces = -(-sizes // stretch)
        of = np.repeat(np.arange(len(sizes)), pieces)
        inside = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stretch
        length = np.minimum(stretch, sizes[of] - inside)
        order = np.argsort(-length, kind="stable")
        of, inside, length = of[order], inside[order], length[order]
        at, total = starts[of] + inside, np.zeros(len(of))
        state = np.where(inside > 0, 0, self.start)
        later = np.flatnonzero(inside)
        for back in range(ORDER - 1, 0, -1):
            state[later] = self.follow(state[later], tokens[at[later] - back])[1]
        for step in range(stretch):
            k = int(np.searchsorted(-length, -step, side="left"))
            if not k:
                break
            gain, state[:k] = self.follow(state[:k], tokens[at[:k] + step])
            total[:k] += gain
        return np.bincount(of, total, minlength=len(sizes))


def compile_automaton(known: dict[bytes, int], lexicon: Lexicon, weights: dict[bytes, float], grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, v: int, least: float) -> Automaton:
    """known: counts of the words that every worker knows. weights: their backoff weights. grams: from pairs on, keys, counts
    and backoff weights, each key a context's place times size plus a token. Weights are those of the whole model, log10."""
    scale = n + ADD * (v + 1)
    tokens = token_ids(known, least)
    size = len(tokens) + 1
    mass = np.array([0.0, *((known.get(w, 0) + ADD) / scale for w in tokens)])
    mass[REST] = max(1 - mass[1:].sum(), 1e-12)
    # Arcs of the empty context: each token leads to the state of its one-word context.
    arcs = {i: (float(np.log10(p)), 1 + i) for i, p in enumerate(mass.tolist())}
    backoff, shorter = [0.0, 0.0, *(weights.get(w, 0.0) for w in tokens)], [0] * (1 + size)
    count = np.array([0, *(known.get(w, 0) for w in tokens)], float)
    state_of = np.arange(1, 1 + size)  # of each context of the order before, by its place

    def follow(state: int, token: int) -> int:
        while (arc := arcs.get(state * size + token)) is None:
            state = shorter[state]
        return arc[1]

    for depth, (keys, counts, bows) in enumerate(grams):
        last = depth == len(grams) - 1
        states = np.zeros(len(keys), np.int64)
        fresh = {}
        for k, (at, i, c, bow) in enumerate(zip((keys // size).tolist(), (keys % size).tolist(), counts.tolist(), bows.tolist(), strict=True)):
            s = int(state_of[at])
            to = follow(shorter[s], i)
            if not last:
                backoff.append(bow)
                shorter.append(to)
                to = len(backoff) - 1
            fresh[s * size + i] = (float(np.log10((c - DISCOUNT) / count[at])), to)
            states[k] = to
        arcs |= fresh
        state_of, count = states, counts.astype(float)
    log_rest = float(np.log10(mass[REST]))
    words = lexicon.words.to_pylist()
    token = np.array([tokens.get(w, REST) for w in words], np.int64)
    logs = np.log10((np.array([known.get(w, 0) for w in words]) + ADD) / scale)
    beside = np.where(token == REST, logs - log_rest + np.array([weights.get(w, 0.0) for w in words]), 0.0)
    keys = np.array(sorted(arcs), np.int64)
    gain, to = (np.array([arcs[k][i] for k in keys.tolist()], kind) for i, kind in ((0, float), (1, np.int64)))
    return Automaton(tokens, keys, gain, to, np.array(backoff), np.array(shorter, np.int64), token, logs, beside, log_rest, float(np.log10(ADD / scale)), scale, 1 + tokens[END], n, v)


def token_ids(known: dict[bytes, int], least: float) -> dict[bytes, int]:
    words = sorted((w for w, c in known.items() if c >= least and w != END), key=lambda w: (-known[w], w))
    return {w: i for i, w in enumerate(words, 1)} | {END: len(words) + 1}


@dataclass
class Fitted:
    automaton: Automaton
    lexicon: Lexicon
    arcs: np.ndarray  # sorted hashes of the pairs and triples that the automaton holds
    words: DataFrame  # (k, n, bow) of all words of the training texts
    grams: DataFrame  # MODEL: blocks of all pairs and triples of the model


def fit(documents: DataFrame) -> Fitted:
    """Learn from all rows outside the held-out fold; a null text is empty, a null doc_id counts as training."""
    training = documents.where(F.coalesce(~held_out(), F.lit(True)))
    counts = written(word_counts(training))
    # Words by their number, a row for each number: as sums of distinct numbers they are no more than the root of 2 n.
    times = counts.groupBy("n").agg(F.count("*").alias("words")).toArrow().sort_by([("n", "descending")])
    by_n, upto = times.column("n").to_numpy(), np.cumsum(times.column("words").to_numpy())
    n, v = int(by_n @ np.diff(upto, prepend=0)), int(upto[-1]) if len(upto) else 0
    enough = int(by_n[min(np.searchsorted(upto, WORDS), len(by_n) - 1)]) if v else 0
    common = counts.where(F.col("n") >= enough).orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
    known = dict(zip(common.column("word").to_pylist(), common.column("n").to_pylist(), strict=True)) | {END: counts.where(F.col("word") == F.lit(END)).select("n").head(1)[0].n if n else 0}
    least = max(2, n * CLASS_SHARE)
    lexicon = lexicon_of(known, n, max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET)))
    words, table = gains(counts, written(gram_counts(training, lexicon), by="o"), n, v, lexicon)
    discard(counts)
    of_word = dict(zip(lexicon.words.to_pylist(), lexicon.hashes.view(np.int64).tolist(), strict=True))
    # What comes to the driver: backoff weights of known words, and at most 1 / GRAM_SHARE n-grams of each order.
    asked = documents.sparkSession.createDataFrame(pa.table({"k": pa.array(lexicon.hashes.view(np.int64))}))
    rows = words.where(F.col("bow").isNotNull()).join(F.broadcast(asked), "k").select("k", "bow").toArrow()
    weights = dict(zip(rows.column("k").to_pylist(), rows.column("bow").to_pylist(), strict=True))
    tokens = token_ids(known, least)
    held, grams = [], []
    places = {of_word[w]: i for w, i in tokens.items()}  # of contexts, by hash
    last = dict(places)  # the last token of each
    for o in (2, 3):
        g = table.where(F.col("o") == o).select("k", "l", "r", "n", "bow").toPandas()
        g = g[g["l"].isin(list(places)) & g["r"].isin(list(places))].sort_values("k")
        ends = g["r"].map(last).to_numpy(np.int64)
        grams.append((g["l"].map(places).to_numpy(np.int64) * (len(tokens) + 1) + ends, g["n"].to_numpy(np.int64), g["bow"].to_numpy(float)))
        held.append(g["k"].to_numpy(np.int64))
        places = {k: i for i, k in enumerate(g["k"].tolist())}
        last = dict(zip(g["k"].tolist(), ends.tolist(), strict=True))
    bows = {w: weights.get(of_word[w], 0.0) for w in known}
    automaton = compile_automaton(known, lexicon, bows, grams, n, v, least)
    return Fitted(automaton, lexicon, np.sort(np.concatenate(held).view(np.uint64)), words, table)


def _blocks_of(rows: list[tuple]) -> pa.RecordBatch:
    return _rows_of("p int, kind int, key long, block binary", rows)


def scored(documents: DataFrame, model: Fitted) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of documents.

    A null or empty text is END alone. Repeated rows get equal scores: what the buckets add is by row. A null
    doc_id is training. With an empty table there are no rows; with no training rows every count is 0.

    Rows go in folds, whose key is their first row's place. A fold's texts are scored by the automaton, and its records dealt
    to buckets; each bucket answers with what its pairs, triples and rare words add to the fold's rows, and all
    that belongs to a fold meets at its key."""
    context = documents.sparkSession.sparkContext
    held, lexicon, arcs = context.broadcast(model.automaton), context.broadcast(model.lexicon), context.broadcast(model.arcs)
    a, buckets = model.automaton, model.lexicon.buckets

    def texts(batches):
        m, lex, inside = held.value, lexicon.value, Places(arcs.value)
        records, row = Records(lex), TaskContext.get().partitionId() << 33
        stats: list[tuple] = []
        end, log_end = m.tokens[END], float(m.logs[lex.end])
        counted = log_end > m.unseen

        def pack():
            """All blocks so far; their rows count from the first one's."""
            folded, begin, (codes, rows, hashes) = records.fold(inside, True)
            out = [(p, TRIPLES, begin, x) for p, x in folded]
            if len(codes):
                bucket = (mixed(hashes, 3) % np.uint64(buckets)).astype(np.int64)[codes]
                order = np.lexsort((codes, bucket))
                codes, rows, bucket = codes[order], rows[order], bucket[order]
                edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
                for x, y in zip(edges, edges[1:]):
                    first = np.flatnonzero(np.diff(codes[x:y], prepend=-1))
                    out.append((int(bucket[x]), RARE, begin, packed([np.diff(np.append(first, y - x)), rows[x:y]], [hashes[codes[x:y][first]]])))
            if stats:
                rows, null, *wide = (np.concatenate(x) for x in zip(*stats, strict=True))
                out.append((int(begin % buckets), STAT, begin, packed([rows - begin, null], [x.view(np.uint64) for x in wide])))
                stats.clear()
            return _blocks_of(out)

        def own(cut, codes, ids, row):
            """What the automaton and the lexicon tell of a cut's texts: rows, whether ids are null, ids, base scores, scores, tokens, known ones."""
            codes = codes[cut.numbers]
            common, sizes = codes >= 0, cut.sizes
            of = np.repeat(np.arange(len(sizes)), sizes)
            tokens = np.full(len(codes) + len(sizes), end, np.int32)
            tokens[np.arange(len(codes)) + of] = np.where(common, m.token[np.maximum(codes, 0)], REST)
            codes, of = codes[common], of[common]
            del common
            known, base, beside = (np.bincount(of, x, minlength=len(sizes)) for x in (None, m.logs[codes], m.beside[codes]))
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            return row + np.arange(len(sizes)), null, ids, base + log_end, m.scores(tokens, sizes + 1) + beside, sizes + 1, known + int(counted)

        for b in batches:
            at = 0
            for cut in cuts(b.column("text")):
                codes = records.codes(cut)
                figures, told = own(cut, codes, b.column("doc_id").slice(at, len(cut.sizes)), row), 0
                for n in records.add(cut, codes, row):
                    if n > told:
                        stats.append(tuple(x[told:n] for x in figures))
                        told = n
                    yield pack()
                    freed()
                if told < len(cut.sizes):
                    stats.append(tuple(x[told:] for x in figures))
                at, row = at + len(cut.sizes), row + len(cut.sizes)
        if records.length:
            yield pack()
        freed()

    def tail(batches):
        """Blocks (hash, log10 probability, gain) of the words that workers don't know."""
        inside = np.sort(lexicon.value.hashes)
        for b in batches:
            k = b.column("k").to_numpy().view(np.uint64)
            out = inside[np.minimum(np.searchsorted(inside, k), len(inside) - 1)] != k
            k, log, v = k[out], b.column("base").to_numpy()[out], b.column("v").to_numpy()[out]
            p = (mixed(k, 3) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((k, p))
            p, columns = p[order], [x[order].view(np.uint64) for x in (k, log, v)]
            edges = [*np.flatnonzero(np.diff(p, prepend=-1)).tolist(), len(p)]
            yield _blocks_of([(int(p[x]), TAIL, 0, packed([], [c[x:y] for c in columns])) for x, y in zip(edges, edges[1:])])

    def meet(batches):
        """(key, kind, block): what a bucket adds to the rows of each fold, and the folds' own figures as they are."""
        lex, unseen, log_rest = lexicon.value, held.value.unseen, held.value.log_rest
        at, kept, inside = None, {GRAMS: [], TAIL: []}, Places(arcs.value)

        def table_of(kind, columns):
            """Places of hashes and what belongs to them. The automaton has the gains of what it holds."""
            if isinstance(kept[kind], list):
                parts = [unpacked(x)[1] for x in kept[kind]]
                x = [np.concatenate([part[c] for part in parts]) if parts else np.zeros(0, np.uint64) for c in range(columns)]
                order = np.argsort(x[0])
                if kind == GRAMS:
                    order = order[inside.of(x[0][order]) < 0]
                kept[kind] = (Places(x[0][order]), *(y.view(np.float64)[order] for y in x[1:]))
            return kept[kind]

        def gain(keys, model, v):
            i = model.of(keys)
            out, hit = np.zeros(len(keys)), np.flatnonzero(i >= 0)
            out[hit] = v[i[hit]]
            return out

        def answers():
            columns = zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["key", "kind", "block"])

        for b in batches:
            out, taken = [], 0
            for p, kind, key, block in zip(*(b.column(c).to_pylist() for c in ("p", "kind", "key")), b.column("block"), strict=True):
                block = block.as_py()
                taken += len(block)
                if taken > ANSWER and out:  # an answer is no longer than what it answers
                    yield answers()
                    out, taken = [], len(block)
                if p != at:
                    at, kept = p, {GRAMS: [], TAIL: []}
                    freed()
                if kind in kept:
                    kept[kind].append(block)
                elif kind == STAT:
                    out.append((key, kind, block))
                elif kind == TRIPLES:
                    _, _, pair, after, ends, times, rows, _ = opened(block, lex)
                    model = table_of(GRAMS, 2)
                    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                    of_pair = np.repeat(gain(pair[first], *model), np.diff(np.append(first, len(pair))))
                    add = of_pair + np.where(ends, 0.0, gain(joined(pair, after, 3), *model))
                    sums = np.bincount(rows, np.repeat(add, times))
                    of = np.flatnonzero(sums)
                    if len(of):
                        out.append((key, kind, packed([of], [sums[of].view(np.uint64)])))
                else:
                    (times, rows), (hashes,) = unpacked(block)
                    model, log, v = table_of(TAIL, 3)
                    i = model.of(hashes)
                    hit = i >= 0
                    base, add = np.full(len(hashes), unseen), np.full(len(hashes), unseen - log_rest)
                    base[hit], add[hit] = log[i[hit]], v[i[hit]]
                    of = np.unique(rows)
                    known, base, add = (np.bincount(rows, np.repeat(x, times))[of] for x in (hit, base, add))
                    out.append((key, kind, packed([of, known.astype(np.int64)], [base.view(np.uint64), add.view(np.uint64)])))
            if out:
                yield answers()

    def add_up(batches):
        """Rows of each fold. Its own figures come first."""
        at, own = None, None

        def rows_of():
            ids, null, n, known, base, score = own
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=null), *map(pa.array, (n, known, base, score))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for key, kind, block in zip(b.column("key").to_pylist(), b.column("kind").to_pylist(), b.column("block"), strict=True):
                parts, wide = unpacked(block.as_py())
                if kind == STAT:
                    if at is not None:
                        yield rows_of()
                    ids, base, score, n, known = wide
                    at, own = key, (ids.view(np.int64), parts[1].astype(bool), n.view(np.int64), known.view(np.int64).copy(), base.view(np.float64).copy(), score.view(np.float64).copy())
                    continue
                _, _, _, known, base, score = own
                if kind == TRIPLES:
                    score[parts[0]] += wide[0].view(np.float64)
                else:
                    known[parts[0]] += parts[1]
                    base[parts[0]] += wide[0].view(np.float64)
                    score[parts[0]] += wide[1].view(np.float64)
        if at is not None:
            yield rows_of()

    shape = "p int, kind int, key long, block binary"
    log = F.log10((F.col("n") + ADD) / a.scale)
    rare_words = model.words.select("k", log.alias("base"), (log - a.log_rest + F.coalesce("bow", F.lit(0.0))).alias("v"))
    blocks = documents.select("doc_id", "text").mapInArrow(texts, shape).union(rare_words.mapInArrow(tail, shape))
    blocks = blocks.union(model.grams.where(F.col("block").isNotNull()).select("p", "kind", F.lit(0).cast("long").alias("key"), "block"))
    added = sorted_buckets(blocks, buckets).mapInArrow(meet, "key long, kind int, block binary")
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = added.repartition(tasks, "key").sortWithinPartitions("key", "kind").mapInArrow(add_up, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(a.n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs))


QUERIES = {"op8_lm_scores": op8_lm_scores}
ORACLES: dict[str, str] = {}
