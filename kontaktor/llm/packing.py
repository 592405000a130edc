"""Best-fit packing of documents into sequences of at most CAPACITY tokens.

Only the histogram of piece lengths (CAPACITY numbers at most) comes to the
driver. There the configuration linear program is solved over all lengths:
multiplicative weights price them, knapsack dynamic programming finds the patterns
of the highest price, and each pattern is taken as often as what is left allows,
rounded down to whole sequences, until only patterns with wide gaps remain. Best fit
places those last pieces. The plan says, for each length, which ranks go where;
each piece finds its place by its rank.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Codes, byte_symbols, table, trimmed, words, written

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CHUNKS = 300_000  # chunks whose ids a worker keeps
SPREAD, RATE = 0.02, 4.0  # how far weights move a price from proportion to length, how fast a covered length loses weight
SLACK = 0.05  # patterns with a larger gap are left to best fit
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


class Encoder:
    """Packed little-endian ids of white-space separated chunks. White space ends every token, so chunks encode alone.

    Where the vocabulary's ids are in the order of its merges, a chunk of Latin letters and plain symbols is merged by
    rank: each word's bytes and a byte that no text holds, which stands for the end of a word. Other chunks, and any with
    a special token, go through the tokenizer itself."""

    END = b"\xff"
    PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")  # composed characters, without white space

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer)
        self.model.no_truncation()
        self.model.no_padding()
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, symbols = {s: i for s, i in spec["model"]["vocab"].items() if s not in self.special}, byte_symbols()
        suffix = spec["model"]["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merged = [vocab[a + b] for a, b in pairs]
        ends = [vocab.get(s + suffix, len(vocab)) for s in symbols]
        self.words = None
        if suffix and merged == sorted(merged) and max(ends) < merged[0]:
            of = lambda s: bytes(symbols[c] for c in s.removesuffix(suffix)) + (self.END if s.endswith(suffix) else b"")
            ranks = {of(s): i for s, i in vocab.items()}
            self.merge = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split") + "|\n").findall
        self.chunks, self.known = Codes(CHUNKS), Codes()
        self.packed: list[bytes] = []
        self.of_known: list[bytes] = []

    def _new(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        out: list[bytes] = [b""] * len(texts)
        other = list(range(len(texts)))
        if self.words:
            whole = "\n".join(texts)
            special = [s for s in self.special if s in whole]
            plain = [i for i, m in enumerate(map(self.PLAIN.fullmatch, texts)) if m]
            if special:
                plain = [i for i in plain if not any(s in texts[i] for s in special)]
            if len(plain) < len(texts):
                whole = "\n".join([texts[i] for i in plain])
            # All chunks are cut at once; a line feed stands after each and is a word of its own.
            codes = list(map(self.known.__getitem__, self.words((whole + "\n").lower()))) if plain else []
            merge, end = self.merge, self.END
            self.of_known += [array("I", merge(w.encode() + end)).tobytes() if w != "\n" else b"" for w in self.known.take()]
            of, at = self.of_known, 0
            line = self.known["\n"] if plain else -1
            for i in plain:
                to = codes.index(line, at)
                out[i] = of[codes[at]] if to == at + 1 else b"".join([of[x] for x in codes[at:to]])
                at = to + 1
            other = sorted(set(other).difference(plain))
        if other:
            ids = self.model.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)
            for i, e in zip(other, ids, strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if self.chunks.full():
            self.packed = []
        if self.known.full():
            self.of_known = []
        codes = [list(map(self.chunks.__getitem__, words(t))) for t in texts]
        if new := self.chunks.take():
            self.packed += self._new(new)
        return [b"".join([self.packed[x] for x in c]) for c in codes]


def pieces(documents: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: a document's ids and END_ID, cut every `capacity` tokens. A null or empty text is END_ID alone.
    local_rank counts equal lengths within the task `part`, in the order of the scan."""
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encode, seen, part = Encoder(tokenizer), {}, TaskContext.get().partitionId()
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for k in range(0, len(texts), 256):
                out = []
                for doc_id, packed in zip(ids[k : k + 256], encode(texts[k : k + 256]), strict=True):
                    packed += end
                    for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                        cut = packed[at : at + 4 * capacity]
                        n = len(cut) // 4
                        seen[n] = rank = seen.get(n, -1) + 1
                        out.append((doc_id, piece, at // 4, n, zlib.crc32(cut), part, rank))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                columns = list(zip(*out, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])
        del encode
        trimmed()

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


class Pricing:
    """Knapsack by dynamic programming: for every room, the multiset of items of the highest price that fits, each item at most
    `limits` times. Multiplicities are split in powers of two, so every step works on a whole row of rooms."""

    def __init__(self, lengths: np.ndarray, limits: np.ndarray, prices: np.ndarray, capacity: int):
        self.value = np.zeros(capacity + 1)
        self.steps: list[tuple[int, int, int]] = []  # item, times, tokens
        rows = []
        for i, (n, limit, price) in enumerate(zip(lengths.tolist(), limits.tolist(), prices.tolist(), strict=True)):
            left, size = min(limit, capacity // n), 1
            while left > 0:
                k = min(size, left)
                w, better = k * n, np.zeros(capacity + 1, bool)
                with_it = self.value[: capacity + 1 - w] + k * price
                np.greater(with_it, self.value[w:], out=better[w:])
                np.maximum(with_it, self.value[w:], out=self.value[w:])
                rows.append(better)
                self.steps.append((i, k, w))
                left -= k
                size *= 2
        self.better = np.array(rows).T.copy() if rows else np.zeros((capacity + 1, 0), bool)

    def pattern(self, room: int) -> dict[int, int]:
        """Items and times of the best that fits in `room`."""
        out: dict[int, int] = {}
        before = len(self.steps)
        while len(hits := np.flatnonzero(self.better[room, :before])):
            before = int(hits[-1])
            i, k, w = self.steps[before]
            out[i] = out.get(i, 0) + k
            room -= w
        return out


def best_pattern(lengths: np.ndarray, limits: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """Lengths and times of the pattern of the highest price."""
    return {int(lengths[i]): k for i, k in Pricing(lengths, limits, prices, capacity).pattern(capacity).items()}


def solved(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], dict[int, int], float]:
    """(patterns and their numbers, what they leave, the dual bound): the linear program over all lengths, rounded as it goes.

    Prices are near proportion to length, which is a feasible dual solution: their sum over all pieces, divided by the best
    pattern's price, bounds the sequences from below. A length's weight falls as it gets covered, so that scarce lengths
    keep theirs. Each pricing yields a pattern for every length, its best companions in the room that it leaves; a pattern
    takes of a length no more than twice its share of the sequences to come, so that it can be used many times."""
    lengths = np.array(sorted(counts, reverse=True), np.int64)
    left = np.array([counts[n] for n in lengths.tolist()], np.int64)
    start, weights, rng = left.astype(float), np.ones(len(lengths)), np.random.default_rng(0)
    bound, slack, out = 0.0, 0, []
    while left.any() and slack <= SLACK * capacity:
        live = np.flatnonzero(left)
        prices = lengths[live] / capacity * (1 + SPREAD * weights[live])
        to_come = max(1, int((lengths * left).sum()) // capacity)
        limits = np.minimum(left[live], np.maximum(1, -(-2 * left[live] // to_come)))
        if not out:
            # A pattern's price is at most that of a full sequence of the dearest tokens.
            bound = float((prices * left[live]).sum() / (prices / lengths[live]).max() / capacity)
        priced = Pricing(lengths[live], limits, prices * (1 + 1e-3 * rng.random(len(live))), capacity)
        taken = 0
        for at, i in enumerate(live.tolist()):
            if not left[i]:
                continue
            pattern = priced.pattern(capacity - int(lengths[i]))
            pattern[at] = pattern.get(at, 0) + 1
            own, times = live[list(pattern)], np.array(list(pattern.values()), np.int64)
            number = int((left[own] // times).min())
            if number < 1 or capacity - int((lengths[own] * times).sum()) > slack:
                continue
            left[own] -= number * times
            weights[own] *= np.exp(-RATE * number * times / start[own])
            taken += number
            out.append((dict(zip(lengths[own].tolist(), times.tolist(), strict=True)), number))
        if taken < 0.002 * to_come or not taken:
            slack = max(1, 2 * slack)
    return out, {n: c for n, c in zip(lengths.tolist(), left.tolist(), strict=True) if c}, bound


class Plan:
    """Bins by pattern: what they hold, how many there are, and how much room is left in each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: list[tuple[tuple | None, int]] = []  # chain of (parent, length, times), number of bins
        self.open: dict[int, list[tuple[tuple | None, int]]] = {}
        self.room: list[int] = []

    def close_or_keep(self, chain, number: int, room: int) -> None:
        if number <= 0:
            return
        if room == 0:
            self.bins.append((chain, number))
            return
        if room not in self.open:
            self.open[room] = []
            insort(self.room, room)
        self.open[room].append((chain, number))

    def add_pattern(self, pattern: dict[int, int], number: int) -> None:
        chain, used = None, 0
        for n, times in sorted(pattern.items(), reverse=True):
            chain, used = (chain, n, times), used + n * times
        self.close_or_keep(chain, number, self.capacity - used)

    def best_fit(self, counts: dict[int, int]) -> None:
        """Lengths from the longest down; each goes to the bins with the least room that suffices."""
        for n in sorted(counts, reverse=True):
            left = counts[n]
            while left > 0:
                at = bisect_left(self.room, n)
                if at == len(self.room):
                    each = self.capacity // n
                    self.close_or_keep((None, n, each), left // each, self.capacity - each * n)
                    if left % each:
                        self.close_or_keep((None, n, left % each), 1, self.capacity - left % each * n)
                    break
                room = self.room[at]
                chain, number = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
                    self.room.pop(at)
                each = room // n
                full = min(number, left // each)
                self.close_or_keep((chain, n, each), full, room - each * n)
                left -= full * each
                number -= full
                if number and 0 < left < each:
                    self.close_or_keep((chain, n, left), 1, room - left * n)
                    number, left = number - 1, 0
                self.close_or_keep(chain, number, room)

    def runs(self) -> np.ndarray:
        """Rows (length, first rank, first sequence, times in each sequence, first offset), sorted."""
        groups = self.bins + [g for gs in self.open.values() for g in gs]
        rows, taken, sequence = [], {}, 0
        for chain, number in groups:
            items = []
            while chain is not None:
                chain, n, times = chain
                items.append((n, times))
            offset = 0
            for n, times in reversed(items):
                rows.append((n, taken.get(n, 0), sequence, times, offset))
                taken[n] = taken.get(n, 0) + times * number
                offset += n * times
            sequence += number
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The plan for a histogram: the linear program's patterns, then best fit for what they leave."""
    plan = Plan(capacity)
    patterns, left, _ = solved({n: c for n, c in counts.items() if c > 0}, capacity)
    for pattern, number in patterns:
        plan.add_pattern(pattern, number)
    plan.best_fit(left)
    return plan.runs()


def packed(documents: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each row's document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are documents of their own. An empty table gives no rows. Other columns of documents are not read."""
    spark = documents.sparkSession
    rows = written(pieces(documents, tokenizer=tokenizer, capacity=capacity))
    # Pieces of one length and task have ranks 0, 1, ...; a task's ranks start where the tasks before it end.
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    held = spark.sparkContext.broadcast(planned(histogram, capacity))

    def place(batches):
        runs = held.value
        keys = (runs[:, 0] << 44) | runs[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            r = runs[np.searchsorted(keys, (length << 44) | rank, side="right") - 1] if len(runs) else runs[:0]
            i = rank - r[:, 1]
            sequence, offset = r[:, 2] + i // r[:, 3], r[:, 4] + i % r[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = rows.join(starts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("local_rank")).drop("first", "local_rank", "part")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
