"""Byte-level BPE encoding and decoding with a minimal acyclic transducer.

The corpus' frequent pre-tokens and their ids are compiled into an automaton with
shared suffixes. Its arcs carry how many words they skip, so a path adds up to a
word's number, which points to the ids. Workers map it from a file into memory,
cut millions of characters into pre-tokens at once and follow it for all distinct
ones together; a pre-token that isn't in it is merged exactly by the vocabulary's
rules. Arrow copies each occurrence's ids, as text and as bytes, to its place.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_symbols, table

TOKENIZER = "byte_bpe_50k.json"
#: A lexicon word has this share of the corpus' pre-tokens at least; so there are at most 1 / SHARE of them.
SHARE = 2e-5
AT_ONCE = 4_000_000  # characters that a worker cuts and codes at once
PART = 1_000_000  # characters from which on a text is cut in parts
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_WHITE, _TRIALS = 3, ((1, "x"), (2, "1"), (0, "."))  # kinds of characters: a letter, a number and others go on with one of their kind
_APOSTROPHE = ord("'")
_ONE, _TWO = [ord(c) for c in "stmd"], [tuple(map(ord, c)) for c in ("re", "ve", "ll")]


class Lexicon:
    """A minimal acyclic automaton over byte strings that numbers its words in sorted order."""

    #: bytes and the numpy arrays that lie in them, in this order
    PARTS = (("keys", "<i8"), ("target", "<i4"), ("skip", "<i4"), ("final", "<i4"), ("first", "<i4"), ("ids", "<i4"))

    def __init__(self, **parts: np.ndarray):
        for name, kind in self.PARTS:
            setattr(self, name, parts[name].astype(kind, copy=False))

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """Words in sorted order; a state that is left for good is replaced by an equal one that is already there."""
        order = sorted(w for w in words if w)
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path = [0]
        before = b""

        def settle(depth: int) -> None:
            while len(path) - 1 > depth:
                state = path.pop()
                shape = (final[state], tuple(arcs[state].items()))
                arcs[path[-1]][before[len(path) - 1]] = known.setdefault(shape, state)

        for w in order:
            common = 0
            while common < min(len(w), len(before)) and w[common] == before[common]:
                common += 1
            settle(common)
            before = w
            for byte in w[common:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][byte] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
        settle(0)
        # Number the states that are left, and count the words below each.
        number, stack = {0: 0}, [0]
        while stack:
            for t in arcs[stack.pop()].values():
                if t not in number:
                    number[t] = len(number)
                    stack.append(t)
        below: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            if missing := [t for t in arcs[s].values() if t not in below]:
                stack += missing
            else:
                below[stack.pop()] = final[s] + sum(below[t] for t in arcs[s].values())
        keys, target, skip = [], [], []
        for s, n in number.items():
            passed = int(final[s])
            for byte, t in sorted(arcs[s].items()):
                keys.append(n << 8 | byte)
                target.append(number[t])
                skip.append(passed)
                passed += below[t]
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        ends = np.zeros(len(number), np.int64)
        for s, n in number.items():
            ends[n] = final[s]
        sizes = [len(words[w]) for w in order]
        return cls(
            keys=np.array(keys, np.int64)[at],
            target=np.array(target, np.int64)[at],
            skip=np.array(skip, np.int64)[at],
            final=ends,
            first=np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]),
            ids=np.array([i for w in order for i in words[w]], np.int64),
        )

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, name) for name, _ in self.PARTS]
        return np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def mapped(cls, blob: bytes) -> Lexicon:
        """The automaton in a memory-mapped file. The file has no name: it goes when the worker does."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            raw = np.asarray(np.memmap(f, np.uint8, "r"))  # a plain view of the mapping
        sizes = raw[: 8 * len(cls.PARTS)].view("<i8")
        at, parts = 8 * len(cls.PARTS), {}
        for (name, kind), n in zip(cls.PARTS, sizes.tolist(), strict=True):
            width = n * np.dtype(kind).itemsize
            parts[name] = raw[at : at + width].view(kind)
            at += width
        return cls(**parts)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1."""
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        return self.follow(np.frombuffer(b"".join(words), np.uint8), ends)

    def follow(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number, or -1, of each word that lies in the bytes of `text` from ends[k] to ends[k + 1]; all words take a step at a time."""
        starts, sizes = ends[:-1], np.diff(ends)
        out = np.full(len(starts), -1, np.int64)
        on = np.flatnonzero(sizes > 0) if len(self.keys) else np.zeros(0, np.int64)
        state, number, step = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64), 0
        while len(on):
            key = state << 8 | text[starts[on] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            on, at = on[hit], at[hit]
            number, state, step = number[hit] + self.skip[at], self.target[at].astype(np.int64), step + 1
            done = sizes[on] == step
            out[on[done]] = np.where(self.final[state[done]] > 0, number[done], -1)
            on, state, number = on[~done], state[~done], number[~done]
        return out

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.first[number] : self.first[number + 1]].tolist()


def strings(text: pa.Buffer | bytes, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The byte strings that lie in `text` from ends[k] to ends[k + 1]."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i8", copy=False)), pa.py_buffer(text)])


def laid(column: pa.LargeBinaryArray) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of `column` and where in them its strings begin and end."""
    _, ends, text = column.buffers()
    return text or pa.py_buffer(b""), np.frombuffer(ends, "<i8")[column.offset : column.offset + len(column) + 1]


def sums(sizes: np.ndarray | list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


@lru_cache(1)
def kinds() -> np.ndarray:
    """Of each code point, whether it is a letter, a number, white space or something else to the tokenizers library, whose
    version of Unicode may differ from other libraries': it cuts a row of all code points into runs of a kind, one of which is tried for each."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    out = np.zeros(0x110000, np.uint8)
    # A space would begin the next run; from plane 4 on no version of Unicode has letters, numbers or white space.
    for points in (range(0x21), range(0x21, 0xD800), range(0xE000, 0x40000)):
        text = "".join(map(chr, points))
        for _, (start, end) in cut(text):
            kind = next((k for k, before in _TRIALS if len(cut(before + text[start])) == 1), _WHITE)
            out[points[start] : points[start] + end - start] = kind
    return out


def pretokens(texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The pre-tokens of texts, none of which is empty, and the place of each text's first one (and of the end) among them.

    They are the matches of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ by rules
    for where they begin, applied to all characters at once."""
    whole = "".join(texts)
    points, edges = np.frombuffer(whole.encode("utf-32-le"), "<u4"), sums(list(map(len, texts)))
    n, kind = len(points), kinds()[points]
    first = np.zeros(n + 3, bool)
    first[edges] = True
    begins = first.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    # The last white character of a run stands alone or, if it is a space, begins what follows it.
    last = np.flatnonzero((kind[:-1] == _WHITE) & (kind[1:] != _WHITE) & ~first[1:n])
    begins[last] = True
    begins[last[points[last] == 32] + 1] = False
    # Contractions: an apostrophe that begins a pre-token takes certain letters after it, whatever follows them.
    at = np.flatnonzero(begins[:n] & (points == _APOSTROPHE))
    at = at[~first[at + 1]]
    a, b = points[at + 1], points[np.minimum(at + 2, n - 1)]
    two = np.logical_or.reduce([(a == x) & (b == y) for x, y in _TWO]) & ~first[at + 2]
    for taken, size in ((np.isin(a, _ONE), 1), (two, 2)):
        begins[at[taken] + 1] = False
        begins[at[taken] + 1 + size] = True
    starts = np.flatnonzero(begins[: n + 1])
    places = np.searchsorted(starts, edges)
    if not whole.isascii():
        starts = sums(1 + (points >= 0x80).view(np.int8) + (points >= 0x800) + (points >= 0x10000))[starts]
    return strings(whole.encode(), starts), places


class Vocabulary:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        of = {i: bytes(symbols[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        bytes_of = [of.get(i, b"") for i in range(max(of) + 1)]
        #: of each id, the bytes that it decodes to, and the id as text with a comma
        self.bytes_of, self.text_of = pa.array(bytes_of, pa.large_binary()), pa.array([b"%d," % i for i in range(len(bytes_of))], pa.large_binary())
        self.by_rank = self.model = None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merged = [vocab[a + b] for a, b in pairs]
        if merged == sorted(merged):  # then the ids are the merges' order, and a merger by rank does the same
            import tiktoken

            ranks = {bytes_of[i]: i for i in vocab.values()}
            self.by_rank = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def merged(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merges of single pre-tokens, none of which holds a special token: all ids in a row, and how many each has."""
        if self.by_rank:
            ids = list(map(self.by_rank, pretokens))
        else:
            ids = [e.ids for e in self.model.encode_batch_fast([p.decode() for p in pretokens], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes


@lru_cache(1)
def vocabulary_at(path: str) -> Vocabulary:
    """A worker loads it once, not for every task."""
    return Vocabulary(path)


def parts(text: str) -> Iterator[str]:
    """A long text in parts that begin with a single space between words, which always begins a pre-token; where none comes, no cut is made."""
    at = 0
    while len(text) - at > PART and (m := _BETWEEN.search(text, at + PART)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def together(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts, in order, of AT_ONCE characters at most, or of one longer text."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > AT_ONCE:
            yield start, k
            start, size = k, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


class Coder:
    """texts -> (number of ids, the ids as text, the decoded text).

    Each distinct pre-token of the texts at hand is looked up or merged once; ids are rendered by Arrow."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def ids(self, pretokens: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens in a row, and where in it each one's begin and end."""
        lexicon = self.lexicon
        text, ends = laid(pretokens)
        number = lexicon.follow(np.frombuffer(text, np.uint8), ends)
        known = number >= 0
        ids, merged = self.vocabulary.merged(pretokens.filter(pa.array(~known)).to_pylist())
        sizes, begin = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        begin[known] = lexicon.first[number[known]]
        sizes[known] = lexicon.first[number[known] + 1] - begin[known]
        begin[~known], sizes[~known] = len(lexicon.ids) + sums(merged)[:-1], merged
        ends = sums(sizes)
        return np.concatenate([lexicon.ids, ids])[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def plain(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Texts without special tokens, none empty; the ids as text end with a comma."""
        words, places = pretokens(texts)
        coded = words.dictionary_encode()
        ids, ends = self.ids(coded.dictionary)
        counts = np.diff(sums(np.diff(ends)[coded.indices.to_numpy()])[places]).tolist()
        sides = []
        for of in (self.vocabulary.text_of, self.vocabulary.bytes_of):
            rendered, at = laid(of.take(pa.array(ids)))
            rendered, at = laid(strings(rendered, at[ends]).take(coded.indices))
            at = at[places].tolist()
            sides.append([rendered[a:b].to_pybytes() for a, b in zip(at, at[1:], strict=False)])
        return list(zip(counts, *sides, strict=True))

    def __call__(self, texts: list[str | None]) -> list[tuple[int, bytes, bytes]]:
        vocabulary = self.vocabulary
        pieces: list[str] = []
        plan: list[list[int | str]] = []
        for t in texts:
            own: list[int | str] = []
            for piece in vocabulary.cut(t) if t and vocabulary.cut else [t] if t else []:
                if piece in vocabulary.special:
                    own.append(piece)
                elif piece:
                    held = list(parts(piece))
                    own += range(len(pieces), len(pieces) + len(held))
                    pieces += held
            plan.append(own)
        coded = [x for a, b in together(pieces) for x in self.plain(pieces[a:b])]
        out = []
        for own in plan:
            got = [coded[x] if isinstance(x, int) else (1, b"%d," % vocabulary.special[x], x.encode()) for x in own]
            out.append((sum(g[0] for g in got), b"".join([g[1] for g in got])[:-1], b"".join([g[2] for g in got])))
        return out


NO_COUNTS = pa.schema([("pretoken", pa.large_binary()), ("n", pa.int64())]).empty_table()


def summed(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("pretoken", use_threads=False).aggregate([("n", "sum")]).select(["pretoken", "n_sum"]).rename_columns(["pretoken", "n"])


def frequent(documents: DataFrame, *, share: float = SHARE) -> list[str]:
    """The pre-tokens with `share` of all the corpus' pre-tokens. Each task counts its part of the corpus and names those with that
    share of the part; a pre-token that has the share of the whole has it in some part. At most 1 / share of them come to the driver."""

    def run(batches):
        held, new, total = NO_COUNTS, [], 0
        for b in batches:
            pieces = [p for t in b.column("text").to_pylist() if t for p in parts(t)]
            for start, end in together(pieces):
                new.append(pa.table(pretokens(pieces[start:end])[0].value_counts().flatten(), schema=NO_COUNTS.schema))
                if sum(map(len, new)) > len(held):
                    held, new = summed([held, *new]), []
                    if len(held) > 1_000_000:  # keep memory bounded: what came once so far is far from the share
                        often = held.filter(pc.greater(held["n"], 1))
                        total += len(held) - len(often)
                        held = often
        held = summed([held, *new])
        total += pc.sum(held["n"]).as_py() or 0
        named = held.filter(pc.and_(pc.greater_equal(held["n"], share * total), pc.greater(held["n"], 1)))
        yield from pa.concat_tables([named, pa.table([[b""], [total]], schema=NO_COUNTS.schema)]).cast(pa.schema([("pretoken", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches()

    counted = documents.select("text").mapInArrow(run, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "pretoken").limit(int(1 / share) + 1).collect()
    total = next((r.n for r in rows if r.pretoken == ""), 0)
    return [r.pretoken for r in rows if r.pretoken and r.n >= share * total]


def fit(documents: DataFrame, *, tokenizer: str | None = None, share: float = SHARE) -> Lexicon:
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    words = [w.encode() for w in frequent(documents, share=share)]
    ids, sizes = vocabulary_at(tokenizer).merged(words)
    return Lexicon.build({w: i.tolist() for w, i in zip(words, np.split(ids, np.cumsum(sizes)[:-1]), strict=False)})


def encoded(documents: DataFrame, lexicon: Lexicon, *, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text and, if asked for, ids and decoded.

    A null or empty text has no ids and decodes to an empty one. Special tokens' strings in a text are those tokens.
    Rows are coded one by one, repeated rows alike; an empty table stays empty; other columns are not read."""
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    held = documents.sparkSession.sparkContext.broadcast(lexicon.to_bytes())

    def run(batches):
        coder = Coder(vocabulary_at(tokenizer), Lexicon.mapped(held.value))
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for k, end in together(texts):
                rows = coder(texts[k:end])
                decoded = [r[2].decode("utf-8", "replace") for r in rows]
                columns = [ids.slice(k, len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows]), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])]
                if with_ids:
                    columns += [pa.array([list(map(int, r[1].split(b","))) if r[1] else [] for r in rows], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encoded(docs, fit(docs))


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {}
