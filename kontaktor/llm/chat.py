"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A state is a role and whether the line begins a turn. Emissions judge a line's
speaker marker and its shape; transitions know how turns follow each other. Viterbi
finds the likeliest states of a whole conversation. A model is estimated by counting
over conversations whose roles are known, shown in several styles of transcripts;
without one, values set by hand serve.

A conversation can be long: its lines may fill many tasks. The scores of a stretch
of lines between each state before and after it are a matrix, and such matrices
multiply in max-plus algebra. So each stretch is summed up alone, one small pass
over the matrices fixes the states at every border, and each stretch is then
decoded alone between fixed ends. The states are a likeliest path, as of one run.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

ROLES = ("system", "user", "assistant", "tool")
N = 2 * len(ROLES)  # state 2 * role begins a turn, 2 * role + 1 goes on with it

#: Markers in lower case, and how much each says for a role (log odds).
MARKERS = {
    "system": {"system": 6.0, "sys": 5.0, "instructions": 3.0, "instruction": 3.0},
    "user": {"user": 6.0, "human": 6.0, "question": 3.0, "q": 3.0, "prompt": 3.0, "customer": 3.0, "me": 2.0},
    "assistant": {"assistant": 6.0, "ai": 5.0, "bot": 5.0, "model": 4.0, "gpt": 4.0, "answer": 3.0, "a": 3.0, "agent": 2.0, "response": 3.0},
    "tool": {"tool": 6.0, "function": 5.0, "observation": 4.0, "output": 3.0, "ipython": 4.0},
}
_MARKED = re.compile(r"^\s*(?:#{1,6}\s*|\*{1,2}|<\|?(?:im_start\|>)?|\[)?\s*([A-Za-z]{1,12})\s*(?:\*{1,2}|\|?>|\])?\s*(:|：|>|\|>|\]|\*{2}|$)\s*(?:\*{2})?\s*")
WORDS = tuple(dict.fromkeys(w for own in MARKERS.values() for w in own))
_MAYBE = r"(?i)^\s*(?:#{1,6}\s*|\*{1,2}|<\|?(?:im_start\|>)?|\[)?\s*(?:" + "|".join(WORDS) + ")[^a-z]*"

#: Styles of transcripts that a model is estimated from, and the form of their markers; {0} is a marker word. The first has none.
STYLES = (None, "{0}: ", "### {0}:\n", "**{0}:** ", "<|im_start|>{0}\n", "[{0}] ")


def marker(line: str) -> tuple[str | None, str]:
    """The speaker marker at a line's start, in lower case, and the rest of the line; (None, line) without one."""
    m = _MARKED.match(line)
    if m and (word := m[1].lower()) in WORDS and (m[2] or line.strip()[0] in "#*<["):
        return word, line[m.end() :]
    return None, line


#: Features of a line: how it opens (a marker word, or the source's word that a turn begins here, or neither, or a blank
#: line), its length, its last character, its first ones. Each takes one of so many values.
SIZES = (len(WORDS) + 3, 12, 4, 5)
BEGUN, PLAIN, BLANK = len(WORDS), len(WORDS) + 1, len(WORDS) + 2


def features(lines: list[str], boundary: np.ndarray) -> np.ndarray:
    """A row of SIZES' values for each line. boundary: the source says that a turn begins here."""
    column = pa.array(lines, pa.string())
    bare = pc.utf8_trim_whitespace(column)
    size = pc.utf8_length(bare).to_numpy().astype(np.int64)
    out = np.zeros((len(lines), len(SIZES)), np.int64)
    out[:, 0] = np.where(boundary, BEGUN, np.where(size > 0, PLAIN, BLANK))
    number = {w: i for i, w in enumerate(WORDS)}
    for i in np.flatnonzero(pc.match_substring_regex(column, _MAYBE).to_numpy(zero_copy_only=False)).tolist():
        if word := marker(lines[i])[0]:
            out[i, 0] = number[word]
    out[:, 1] = np.minimum(np.frexp(size)[1], SIZES[1] - 1)
    yes = lambda x: x.to_numpy(zero_copy_only=False)
    for k, end in enumerate(("?", ".", ":"), 1):
        out[yes(pc.ends_with(bare, end)), 2] = k
    shapes = (r"(?i)^(?:you are|act as|always|never)\b", r"(?s)^[{\[].*[}\]]$", r"^[^\n]{0,40}:$", r"^(?:```|- |1\. |\* )")
    for k, shape in enumerate(shapes, 1):
        out[yes(pc.match_substring_regex(bare, shape)), 3] = k
    return out


@dataclass
class Model:
    """Log scores: of the first state, from state to state, and for each feature's values in each state."""

    start: np.ndarray
    step: np.ndarray
    tables: tuple[np.ndarray, ...]

    def emissions(self, lines: list[str], boundary: np.ndarray) -> np.ndarray:
        f = features(lines, boundary)
        return sum(t[f[:, k]] for k, t in enumerate(self.tables))


def set_by_hand() -> Model:
    """What a model says before it has seen any conversation."""
    after = np.array([[0.05, 0.85, 0.08, 0.02], [0.02, 0.08, 0.85, 0.05], [0.01, 0.80, 0.07, 0.12], [0.01, 0.09, 0.80, 0.10]])
    step = np.full((N, N), -np.inf)
    for a in range(N):
        step[a, a // 2 * 2 + 1] = np.log(0.6)
        step[a, 0::2] = np.log(0.4 * after[a // 2])
    start = np.log(np.array([[0.3, 0.55, 0.1, 0.05], [1e-9] * 4]).T.reshape(-1))
    opening, size, end, shape = (np.zeros((n, N)) for n in SIZES)
    for i, w in enumerate(WORDS):
        opening[i, 0::2] = [MARKERS[r].get(w, -4.0) for r in ROLES]
        opening[i, 1::2] = -5.0
    opening[BEGUN, 1::2], opening[PLAIN, 0::2], opening[BLANK, 0::2] = -8.0, -3.0, -6.0
    size[10:, 4:6] = 0.5
    end[1, 2:4] = 0.7
    shape[1, 0:2], shape[2, 6:8], shape[4, 4:6] = 1.0, 1.5, 0.4
    return Model(start, step, (opening, size, end, shape))


HAND = set_by_hand()
START, STEP = HAND.start, HAND.step


def estimated(counts: dict[tuple[int, int, int], float], smoothing: float = 0.5) -> Model:
    """counts by (kind, i, j): kind 0: a first state j, 1: state j after i, 2 + k: value i of feature k in state j.

    A count's absence is no proof: `smoothing` is added to each that is possible at all. A role without any count keeps
    the values set by hand."""
    of = lambda kind, shape: np.array([[counts.get((kind, i, j), 0.0) for j in range(shape[1])] for i in range(shape[0])])
    first, step = of(0, (1, N))[0], of(1, (N, N))
    possible = np.isfinite(STEP)
    start = np.log((first + smoothing) / (first + smoothing).sum()) if first.sum() else START
    start[1::2] = START[1::2]
    seen = of(2, (SIZES[0], N)).sum(axis=0)
    step = np.where(possible, step + smoothing, 0)
    with np.errstate(divide="ignore"):
        step = np.where((step.sum(axis=1) > smoothing * possible.sum(axis=1))[:, None], np.log(step / step.sum(axis=1, keepdims=True)), STEP)
    tables = []
    for k, size in enumerate(SIZES):
        t = of(2 + k, (size, N)) + smoothing
        hand = HAND.tables[k] - np.log(np.exp(HAND.tables[k]).sum(axis=0))
        tables.append(np.where(seen > 0, np.log(t / t.sum(axis=0)), hand))
    return Model(start, step, tuple(tables))


def summed(emissions: np.ndarray, model: Model = HAND) -> np.ndarray:
    """Best score of the lines with the first in state i and the last in state j."""
    best = np.full((N, N), -np.inf)
    np.fill_diagonal(best, emissions[0])
    for e in emissions[1:]:
        best = (best[:, :, None] + model.step[None]).max(axis=1) + e
    return best


def viterbi_of_all(emissions: np.ndarray, sizes: np.ndarray, model: Model = HAND, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
    """The likeliest states of many sequences that lie one after the other; ties go to the smaller. enter, leave: a sequence's
    first and last state where they are fixed, else -1. All sequences take a step at a time."""
    n = len(sizes)
    enter, leave = (np.full(n, -1) if x is None else x for x in (enter, leave))
    order = np.argsort(-sizes, kind="stable")
    starts, lengths, enter, leave = (np.cumsum(sizes) - sizes)[order], sizes[order], enter[order], leave[order]
    live = [int(x) for x in np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")]  # by step
    back = np.zeros(emissions.shape, np.int8)
    first = emissions[starts]
    score = np.where(enter[:, None] < 0, first + model.start, np.where(np.arange(N) == enter[:, None], first, -np.inf))
    for t, k in enumerate(live[1:], 1):
        through = score[:k, :, None] + model.step
        at = starts[:k] + t
        back[at] = through.argmax(axis=1)
        score[:k] = through.max(axis=1) + emissions[at]
    state = np.where(leave < 0, score.argmax(axis=1), leave)
    out = np.zeros(len(emissions), np.int64)
    for t in range(len(live) - 1, -1, -1):
        k, longer = live[t], live[t + 1] if t + 1 < len(live) else 0
        state[:longer] = back[starts[:longer] + t + 1, state[:longer]]
        out[starts[:k] + t] = state[:k]
    return out


def viterbi(emissions: np.ndarray, enter: int | None = None, leave: int | None = None, model: Model = HAND) -> np.ndarray:
    """The likeliest states of one sequence."""
    fixed = lambda x: np.array([-1 if x is None else x])
    return viterbi_of_all(emissions, np.array([len(emissions)]), model, fixed(enter), fixed(leave))


def borders(matrices: list[np.ndarray], model: Model = HAND) -> list[tuple[int, int]]:
    """The first and last state of each stretch, of the likeliest path through all of them."""
    score, back = model.start[:, None] + matrices[0], []
    entry = [score.argmax(axis=0)]
    best = score.max(axis=0)
    for m in matrices[1:]:
        into = best[:, None] + model.step
        back.append(into.argmax(axis=0))
        through = into.max(axis=0)[:, None] + m
        entry.append(through.argmax(axis=0))
        best = through.max(axis=0)
    last, out = int(best.argmax()), []
    for k in range(len(matrices) - 1, -1, -1):
        first = int(entry[k][last])
        out.append((first, last))
        if k:
            last = int(back[k - 1][first])
    return out[::-1]


def rendered(role: str, text: str) -> str:
    """A turn in canonical form."""
    return f"<|{role}|>\n{text.strip()}\n<|end|>"


_ROWS = "conv_id", "turn", "role", "text", "copies"


def _split(texts: list[str | None], roles: list[str | None] | None = None) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(row, line, boundary) of texts in order; a role that a row names is its marker at the start."""
    marked = [f"{r}: {t or ''}" if isinstance(r, str) and r.strip() else t or "" for t, r in zip(texts, roles, strict=True)] if roles else [t or "" for t in texts]
    lines = [t.split("\n") for t in marked]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    rows = np.repeat(np.arange(len(lines)), sizes)
    return rows, [x for own in lines for x in own], np.diff(rows, prepend=-1) > 0


def _lines(own: pd.DataFrame, model: Model = HAND) -> tuple[list[tuple[int, str]], np.ndarray]:
    """(row, line) of a stretch in order, and the lines' emissions."""
    text = [t if isinstance(t, str) else None for t in own["text"]]
    rows, lines, boundary = _split(text, list(own["role"]))
    return list(zip(rows.tolist(), lines, strict=True)), model.emissions(lines, boundary)


def _ordered(rows: pa.Table) -> pa.Table:
    """By conversation, turn, role and text, nulls first, as Spark orders them."""
    return rows.take(pc.sort_indices(rows, [(c, "ascending") for c in _ROWS[:4]], null_placement="at_start"))


def _starts(conv: pa.ChunkedArray) -> np.ndarray:
    """Where a conversation begins in ordered rows."""
    ids, null = pc.fill_null(conv, 0).to_numpy(), pc.is_null(conv).to_numpy()
    if not len(ids):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))


def dealt(rows: DataFrame, pieces: int | None = None) -> DataFrame:
    """Distinct rows with their `copies`, in parts by ranges of conversation, turn, role and text: a long conversation is in many."""
    pieces = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    return written(once.repartitionByRange(pieces, "conv_id", "turn", "role", "text").select(*_ROWS, F.spark_partition_id().alias("part")))


def held_out(conv_id: str = "conv_id"):
    return F.coalesce(F.crc32(F.col(conv_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shown(text: str, role: str, style: int) -> str:
    """A turn as a transcript of a style shows it."""
    form = STYLES[style]
    own = list(MARKERS[role])
    return text if form is None else form.format(own[style % min(2, len(own))].capitalize() if style % 2 else own[0]) + text


def fit(parts: DataFrame) -> Model:
    """Estimate from dealt rows outside the held-out fold whose role is known. By a hash of its id, each conversation is shown
    in one of STYLES; without markers each row is known to begin a turn, with them only the first is. The counts, of bounded
    number, and each part's first and last turn come to the driver."""

    def count(own: pa.Table) -> pa.Table:
        own = _ordered(own)
        roles = [r.strip().lower() if r and r.strip().lower() in ROLES else None for r in own.column("role").to_pylist()]
        conv, texts = own.column("conv_id").to_pylist(), own.column("text").to_pylist()
        hashes = {c: zlib.crc32(str(c).encode()) for c in set(conv)}
        styles = [hashes[c] // 5 % len(STYLES) for c in conv]
        use = [c is not None and hashes[c] % 5 > 0 and r is not None for c, r in zip(conv, roles, strict=True)]
        first = np.zeros(len(conv), bool)
        first[_starts(own.column("conv_id"))] = True
        part = own.column("part")[0].as_py()
        split = [k for k, u in enumerate(use) if u]
        rows, lines, begins = _split([shown(texts[k] or "", roles[k], styles[k]) for k in split])
        at = np.array(split, np.int64)[rows] if split else rows
        boundary = begins & ((np.array(styles, np.int64)[at] == 0) | (first[at] & (own.column("turn").to_numpy()[at] == 0)))
        states = np.array([2 * ROLES.index(roles[k]) for k in split], np.int64)[rows] + ~begins if split else rows
        found = [np.stack([np.full(len(lines), 2 + k), f, states]) for k, f in enumerate(features(lines, boundary).T)]
        # A row's last line leads to the first of the next row of its conversation, in the same part or the next one.
        follows = np.concatenate([[False], (at[1:] == at[:-1]) | ((at[1:] == at[:-1] + 1) & ~first[at[1:]])]) if len(at) else np.zeros(0, bool)
        to = np.flatnonzero(follows)
        found.append(np.stack([np.ones(len(to), np.int64), states[to - 1], states[to]]))
        # Conversations that begin inside the part; the part's first row may go on with the part before.
        head = np.flatnonzero(first[at] & (at > 0) & (np.diff(at, prepend=-1) > 0)) if len(at) else at
        found.append(np.stack([np.zeros(len(head), np.int64), np.zeros(len(head), np.int64), states[head]]))
        keys, n = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
        ends = [(-1, part, -1, str(conv[k]), int(states[x]) if len(at) and use[k] else -1) for k, x in ((0, 0), (len(conv) - 1, len(at) - 1))]
        columns = [*map(list, keys), n.tolist(), [None] * len(n), [None] * len(n)]
        rows_out = list(zip(*columns, strict=True)) + [(kind, p, side, 1, c, st) for side, (kind, p, _, c, st) in enumerate(ends)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows_out, strict=True), (*[pa.int64()] * 4, pa.string(), pa.int64()), strict=True)], ["kind", "i", "j", "n", "conv", "state"])

    got = parts.groupBy("part").applyInArrow(count, "kind long, i long, j long, n long, conv string, state long")
    got = got.groupBy("kind", "i", "j", "conv", "state").agg(F.sum("n").alias("n")).collect()
    counts = {(r.kind, r.i, r.j): float(r.n) for r in got if r.kind >= 0}
    ends = sorted((r.i, r.j, r.conv, r.state) for r in got if r.kind < 0)
    before = None
    for _, side, conv, state in ends:
        if side == 0 and state >= 0:
            same = before is not None and before[0] == conv
            key = (1, before[1], state) if same and before[1] >= 0 else None if same else (0, 0, state)
            if key:
                counts[key] = counts.get(key, 0) + 1
        before = (conv, state) if side == 1 else before
    return estimated(counts)


def formatted(rows: DataFrame, *, model: Model = HAND, pieces: int | None = None, with_roles: bool = True) -> DataFrame:
    """(conv_id, turn, piece, copies, role, begins, rendered): the turns that each row's transcript holds.

    rows: conv_id, turn, role, text. Each row is a stretch of transcript; with_roles, a role that it names is its marker at
    the start, else roles are recovered from texts alone. Rows are in the order of turn, role and text, nulls first; equal
    rows count as one that has `copies`. Null or empty texts are an empty line. Rows of a null conv_id are one conversation.
    begins is false where a row goes on with the turn of the row before. An empty table gives no rows; other columns are not read."""
    return decoded(dealt(rows, pieces), model, with_roles=with_roles)


def decoded(parts: DataFrame, model: Model, *, with_roles: bool) -> DataFrame:
    stretches = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    split = stretches.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1").select(F.col("conv_id").alias("split_id"))
    of_split = parts.join(split, parts["conv_id"].eqNullSafe(split["split_id"]), "left_semi")

    def lines_of(own: pa.Table):
        return _split(own.column("text").to_pylist(), own.column("role").to_pylist() if with_roles else None)

    def sum_up(own: pa.Table) -> pa.Table:
        own = _ordered(own)
        rows, lines, boundary = lines_of(own)
        scores, starts = model.emissions(lines, boundary), _starts(own.column("conv_id"))
        cuts = np.searchsorted(rows, starts[1:])
        matrices = [summed(x, model).reshape(-1).tolist() for x in np.split(scores, cuts)]
        return pa.table({"conv_id": own.column("conv_id").take(pa.array(starts)), "part": own.column("part").take(pa.array(starts)), "m": pa.array(matrices, pa.list_(pa.float64()))})

    def fix(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("part")
        ends = borders([np.array(m).reshape(N, N) for m in own["m"]], model)
        return pd.DataFrame({"fixed_id": own["conv_id"].to_numpy(), "fixed_part": own["part"].to_numpy(), "enter": [a for a, _ in ends], "leave": [b for _, b in ends]})

    # A row for each stretch of a conversation that is split: at most two for each part, so a group has a row for each part at most.
    matrices = of_split.groupBy("part").applyInArrow(sum_up, "conv_id long, part int, m array<double>")
    ends = matrices.groupBy("conv_id").applyInPandas(fix, "fixed_id long, fixed_part int, enter int, leave int")
    fixed = parts.join(ends, parts["conv_id"].eqNullSafe(ends["fixed_id"]) & (parts["part"] == ends["fixed_part"]), "left").drop("fixed_id", "fixed_part")

    def decode(own: pa.Table) -> pa.Table:
        own = _ordered(own)
        rows, lines, boundary = lines_of(own)
        starts = _starts(own.column("conv_id"))
        sizes = np.diff(np.append(np.searchsorted(rows, starts), len(rows)))
        end = lambda c: pc.fill_null(own.column(c), -1).to_numpy()[starts]
        states = viterbi_of_all(model.emissions(lines, boundary), sizes, model, end("enter"), end("leave"))
        begins = states % 2 == 0
        cuts = np.flatnonzero(begins | boundary)  # where a turn or a row begins
        row = rows[cuts]
        first = np.searchsorted(row, row)  # each row's first cut
        texts = []
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lines)], strict=True):
            head = marker(lines[x])[1] if begins[x] else lines[x]
            texts.append(rendered(ROLES[states[x] // 2], "\n".join([head, *lines[x + 1 : y]])))
        take = lambda c: own.column(c).take(pa.array(row))
        return pa.table(
            {
                "conv_id": take("conv_id"),
                "turn": take("turn"),
                "piece": pa.array(np.arange(len(row)) - first, pa.int32()),
                "copies": take("copies"),
                "role": pa.array([ROLES[k] for k in states[cuts] // 2]),
                "begins": pa.array(begins[cuts]),
                "rendered": pa.array(texts, pa.string()),
            }
        )

    # A part is what one task holds of the ranges: its rows, of whatever conversations, are decoded together.
    return fixed.groupBy("part").applyInArrow(decode, "conv_id long, turn long, piece int, copies long, role string, begins boolean, rendered string")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all conversations from their texts alone; the table's roles teach the model, outside the held-out fold."""
    parts = dealt(table(spark, sf_dir, "conversations"))
    return decoded(parts, fit(parts), with_roles=False).withColumn("held_out", held_out())


QUERIES = {"op3_chat": op3_chat}
ORACLES: dict[str, str] = {}
