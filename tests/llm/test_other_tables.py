"""Operators over embeddings and conversations, and the pipeline, against brute-force versions."""

import itertools
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from kontaktor.llm import chat, register, topk


def brute_top(ids, vectors, k=5, every=50):
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in ok:
        if ids[i] is None or ids[i] % every:
            continue
        q = np.floor(256 * np.array(vectors[i], np.float64))
        scores = [(-int(q @ np.floor(256 * np.array(vectors[j], np.float64))), ids[j]) for j in ok if ids[j] is not None and ids[j] != ids[i] and len(vectors[j]) == len(vectors[i])]
        out += [(ids[i], r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 150)
    rng = np.random.default_rng(seed)
    vectors = [list(map(float, v)) for v in rng.normal(size=(500, 32)).astype(np.float32)]
    vectors[100] = vectors[150] = vectors[7] = vectors[8]  # ties
    for k in range(200, 330):
        vectors[k] = vectors[200]  # a group of copies
    vectors[3], vectors[4], vectors[5], vectors[6], vectors[50] = None, [], [float("nan")] * 32, [None, *vectors[0][1:]], [float("inf")] * 32
    vectors[9] = [0.5, 0.5]
    ids = list(range(500))
    rows = spark.createDataFrame(list(zip(ids, vectors, ["x"] * 500, strict=True)), "vec_id long, embedding array<float>, block string")
    got = sorted(map(tuple, topk.top_k(rows).select("query_id", "rank", "vec_id", "score").collect()))
    want = brute_top(ids, [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors])
    assert got == want


def test_top_k_of_few_repeated_and_no_rows(spark):
    one = [1.0, -1.0]
    rows = spark.createDataFrame([(0, one), (0, one), (1, one), (None, one)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(rows).select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 131072)]
    assert topk.top_k(rows.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, q = np.floor(rng.normal(size=(50, 24)) * 200), np.floor(rng.normal(size=(1, 24)) * 200)
    exact = (x @ q[0])
    before = None
    for n in (1, 2, 4, 8, 24):
        (sx, dx, z), (sq, dq, _) = topk.statistics(x, n), topk.statistics(q, n)
        bound = (sx * sq / z).sum(axis=1) + (dx * dq).sum(axis=1)
        assert (bound >= exact - 1e-6).all()
        before = bound
    assert np.allclose(before, exact)


def test_envelopes_hold():
    rng = np.random.default_rng(6)
    for dim in (1, 3, 24, 64):
        x, q = np.floor(rng.normal(size=(70, dim)) * 200), np.floor(rng.normal(size=(9, dim)) * 200)
        bounds = topk.block_bounds(q, np.stack([np.concatenate(topk.envelope(own)) for own in np.split(x, 7)]))
        exact = np.stack([(q @ own.T).max(axis=1) for own in np.split(x, 7)], axis=1)
        assert (bounds >= exact - 1e-6 * np.abs(bounds)).all()


def test_blocks_that_cannot_hold_better_rows_are_not_asked(spark, monkeypatch):
    """Clusters far apart: a query meets few blocks, and results are as by brute force."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 32)) * 10
    vectors = [list(map(float, np.float32(centres[i % 20] + rng.normal(size=32) * 0.1))) for i in range(1000)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    tables = []
    keep = topk.written
    monkeypatch.setattr(topk, "written", lambda df: tables.append(keep(df)) or tables[-1])
    got = sorted(map(tuple, topk.top_k(rows).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top(list(range(1000)), vectors)
    asked = tables[-1].count()  # of 20 queries and about 20 blocks
    assert asked <= 20 * 20 / 4


# Chat


def path_score(emissions, states):
    return chat.START[states[0]] + emissions[np.arange(len(states)), states].sum() + sum(chat.STEP[a, b] for a, b in zip(states, states[1:], strict=False))


def test_stretches_join_to_a_likeliest_path():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 60):
        emissions = rng.normal(size=(n, chat.N)) * 3
        best = path_score(emissions, chat.viterbi(emissions))
        for cuts in ([], [n // 2], list(range(1, n)), [n // 3, n // 2]):
            parts = [p for p in np.split(emissions, sorted(set(cuts) - {0})) if len(p)]
            ends = chat.borders([chat.summed(p) for p in parts])
            states = np.concatenate([chat.viterbi(p, a, b) for p, (a, b) in zip(parts, ends, strict=True)])
            assert path_score(emissions, states) == pytest.approx(best)


def test_long_conversation_is_decoded_over_many_tasks(spark):
    rng = np.random.default_rng(0)
    rows = [{"conv_id": 1, "turn": t, "role": None if t % 7 == 3 else ("user", "assistant")[t % 2], "text": str(rng.choice(["why?", "so it is", "a\nb"]))} for t in range(300)]
    df = spark.createDataFrame([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows], "conv_id long, turn long, role string, text string")
    _, scores = chat._lines(pd.DataFrame(rows))
    want = [chat.ROLES[s // 2] for s in chat.viterbi(scores) if s % 2 == 0]
    for pieces in (1, 9):
        got = chat.formatted(df, pieces=pieces).toPandas().sort_values(["turn", "piece"])
        assert list(got[got.begins].role) == want


def test_roles_of_the_table_are_recovered(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet")
    got = chat.formatted(rows).toPandas().merge(rows.toPandas(), on=["conv_id", "turn"], suffixes=("", "_true"))
    assert (got.role == got.role_true).mean() > 0.99


def test_markers_and_canonical_turns(spark):
    rows = spark.createDataFrame([(1, 0, None, "### Human: 2+2?\n**Assistant:** 4\nfour\nUSER: thanks")], "conv_id long, turn long, role string, text string")
    got = chat.formatted(rows).orderBy("piece").collect()
    assert [(r.role, r.rendered) for r in got] == [("user", "<|user|>\n2+2?\n<|end|>"), ("assistant", "<|assistant|>\n4\nfour\n<|end|>"), ("user", "<|user|>\nthanks\n<|end|>")]


def test_chat_of_nulls_repeats_and_nothing(spark):
    rows = spark.createDataFrame([(None, None, None, None), (2, 0, "user", "a"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.copies) for r in chat.formatted(rows.selectExpr("*", "1 AS part", "2 AS begins")).collect()}
    assert got == {(None, 1), (2, 2)}
    assert chat.formatted(rows.limit(0)).count() == 0


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    model = chat.estimated({(1, i, j): int(rng.integers(1, 50)) for i in range(chat.N) for j in range(chat.N)})
    for model in (model, chat.HAND):
        sizes = np.array([1, 4, 3, 2])
        emissions = rng.normal(size=(sizes.sum(), chat.N)) * 3
        enter, leave = np.array([-1, -1, 2, -1]), np.array([-1, -1, -1, 5])
        got = chat.viterbi_of_all(emissions, sizes, model, enter, leave)
        for k, own in enumerate(np.split(np.arange(sizes.sum()), np.cumsum(sizes)[:-1])):
            def score(path, own=own, k=k):
                if (enter[k] >= 0 and path[0] != enter[k]) or (leave[k] >= 0 and path[-1] != leave[k]):
                    return -np.inf
                first = 0.0 if enter[k] >= 0 else model.start[path[0]]
                return first + emissions[own, list(path)].sum() + sum(model.step[a, b] for a, b in zip(path, path[1:]))

            best = max(map(score, itertools.product(range(chat.N), repeat=len(own))))
            assert score(tuple(got[own])) == pytest.approx(best)


def test_hidden_roles_of_the_held_out_fold_are_recovered(spark):
    got = chat.op3_chat(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    true = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").toPandas()
    got = got.merge(true, on=["conv_id", "turn"], suffixes=("", "_true"))
    assert len(got) > 50 and (got.role == got.role_true).mean() > 0.93


@pytest.mark.parametrize("style", [1, 2, 3, 4, 5])
def test_transcripts_of_every_style_are_parsed(spark, style):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = chat.fit(chat.dealt(rows))
    true = {c: own for c, own in rows.toPandas().sort_values("turn").groupby("conv_id") if zlib.crc32(str(c).encode()) % 5 == 0}
    blobs = [(int(c), 0, None, "\n".join(chat.shown(t, r, style) for t, r in zip(own.text, own.role, strict=True))) for c, own in true.items()]
    df = spark.createDataFrame(blobs, "conv_id long, turn long, role string, text string")
    got = chat.formatted(df, model=model, with_roles=False).toPandas().sort_values("piece")
    right = [list(own.role) == list(true[c].role) for c, own in got.groupby("conv_id")]
    assert np.mean(right) > 0.95


def test_counts_are_those_of_one_pass(spark):
    """Whatever the parts, starts and steps are counted as over whole conversations."""
    rng = np.random.default_rng(5)
    rows = [(c, t, str(rng.choice(["user", "assistant", "tool"])), str(rng.choice(["a", "b\nc", "d?\n\ne"]))) for c in range(1, 12) for t in range(int(rng.integers(1, 30)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    models = [chat.fit(chat.dealt(df, pieces)) for pieces in (1, 7)]
    for a, b in zip((models[0].start, models[0].step, *models[0].tables), (models[1].start, models[1].step, *models[1].tables), strict=True):
        np.testing.assert_allclose(a, b)
    first = {}
    for c, t, role, _ in rows:
        if zlib.crc32(str(c).encode()) % 5:
            first.setdefault(c, role)
    n = sum(r == "user" for r in first.values())
    assert np.exp(models[0].start[2]) == pytest.approx((n + 0.5) / (len(first) + 0.5 * chat.N))


def test_chat_of_very_long_texts_and_clashing_columns(spark):
    long = "\n".join(["Human: why?", *(f"line {i}" for i in range(20_000))])
    rows = spark.createDataFrame([(1, 0, None, long), (1, 1, None, "Assistant: so"), (2, 0, "tool", None)], "conv_id long, turn long, role string, text string")
    rows = rows.selectExpr("*", "1 AS part", "'x' AS copies", "2 AS piece", "3 AS enter", "4 AS leave", "'y' AS rendered")
    for pieces in (1, 3):
        got = {(r.conv_id, r.turn): r for r in chat.formatted(rows, pieces=pieces).collect()}
        assert len(got) == 3 and got[1, 0].role == "user" and got[1, 0].rendered.count("\n") == 20_002
        assert got[1, 1].rendered == "<|assistant|>\nso\n<|end|>" and got[2, 0].rendered == "<|tool|>\n\n<|end|>"
    assert chat.decoded(chat.dealt(rows.limit(0)), chat.fit(chat.dealt(rows.limit(0))), with_roles=False).count() == 0


# Registered queries and the pipeline


def test_every_operator_has_its_query():
    names = register.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


def test_stages_chain(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == docs.columns
        docs = after.cache()
        assert 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == n
    assert corpus_pipeline.run(spark, data).select("doc_id").distinct().count() == n


def brute_stages(spark, docs, data):
    """The five stages one after the other in Python, over rows (doc_id, text, lang): what packing gets."""
    from test_documents import brute_components, brute_quality, brute_spans

    from kontaktor.llm import quality, toxicity
    from kontaktor.llm.common import table

    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    model = toxicity.fit(table(spark, data, "documents"), table(spark, data, "labels"))
    marked = {(r.doc_id, r.text): r.toxic_flag for r in toxicity.score(docs, model).collect()}
    rows = [r for r in rows if not marked[r[0], r[1]]]
    judged = {(r.doc_id, r.text): r.kept for r in quality.measured(docs).collect()}
    rows = [r for r in rows if not brute_quality(r[1])[-1] and judged[r[0], r[1]]]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    named = [r for r in rows if r[0] is not None]
    _, of = brute_components([r[1] for r in named])
    ids = {}
    for r, c in zip(named, of, strict=True):  # rows of one id are one document
        ids.setdefault(r[0], set()).add(c)
    merged = list(range(len(named)))
    for group in ids.values():
        low = min(group)
        of = [low if c in group else c for c in of]
    for r, c in zip(named, of, strict=True):
        if c not in first or (r[0], r[1] or "") < (first[c][0], first[c][1] or ""):
            first[c] = r
    del merged
    rows = [r for r in rows if r[0] is None] + list(first.values())

    def redacted(text):
        out, at = "", 0
        for s, _, e in brute_spans(text):
            if s >= at:
                out += text[at:s] + "[SECRET]"
            at = max(at, e)
        return out + text[at:]

    return sorted(((r[0], redacted(r[1])) for r in rows), key=str)


def test_pipeline_against_brute_force(spark, data):
    from test_documents import brute_ids

    some = spark.read.parquet(f"{data}/documents.parquet")
    prose = some.where("lang = 'en' AND n_chars BETWEEN 1200 AND 3000").orderBy("doc_id").limit(12).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in prose]
    rows += [(900_000 + k, r.text + (" end" if k % 2 else ""), r.lang, None, None) for k, r in enumerate(prose[:6])]  # copies
    rows += [(910_000, prose[6].text.replace(" ", "  ") + ' password = "abcdefgh1234"', "en", "s", 1), (910_001, None, None, None, None), (910_002, "", "en", "", 0), (None, prose[7].text, "en", "s", 1)]
    rows += [rows[8], rows[8]]  # repeated rows
    docs = spark.createDataFrame(rows, some.schema).cache()
    want = brute_stages(spark, docs, data)
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, data).cache()
        assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == want
    packed = corpus_pipeline.STAGES[-1][1](spark, left, data).toPandas()
    assert packed.length.sum() == sum(len(brute_ids(t)) for _, t in want)


def test_stages_take_awkward_rows(spark, data):
    base = spark.read.parquet(f"{data}/documents.parquet").schema
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, None, "en", None, 3), (2, "", None, "s", 0), (3, long, "xx", "s", None), (3, long, "xx", "s", None), (4, "\ud800".encode("utf-8", "replace").decode() + " x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, base).selectExpr("*", "1 AS toxic_flag", "2 AS kept", "3 AS id", "4 AS component", "5 AS part", "6 AS length", "7 AS first", "8 AS times", "9 AS spans")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, data)
            n = got.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == table.columns and n <= table.count()
                assert name not in ("secret_scan",) or n == table.count()
            assert n or table is not docs or name == "quality_rules"
    assert corpus_pipeline.STAGES[2][1](spark, docs, data).where("doc_id = 3").count() == 1
