"""Hard negatives, periodic runs and chat formatting: against plain versions, and on odd rows."""

import hashlib
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyfringe.llm import chat, hard_negatives, periodic
from skyfringe.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_periodic_runs", "op13_chat_formatting"])
def test_whole_tables_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b) > 0
    rows = lambda d: sorted(tuple("" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in d[columns].itertuples(index=False))
    assert rows(a) == rows(b)


# --- hard negatives ----------------------------------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=3):
    """Everything by loops over (vec_id, label, numbers)."""
    out = []
    width = max((len(v) for _, _, v in rows), default=0)
    rows = sorted({(i, y, tuple([*v, *[0] * (width - len(v))])) for i, y, v in rows})
    for i, y, v in rows:
        if i % 50 == 0:
            score = lambda w, v=v: sum(a * b for a, b in zip(v, w, strict=True))
            near = sorted((-score(w), j) for j, z, w in rows if z == y and j != i)[:positives]
            far = sorted((-score(w), j) for j, z, w in rows if z != y and j != i)
            for p, j in near:
                inside = [(k, -n) for n, k in far if 50 * -p <= 100 * -n <= 95 * -p][:negatives]
                out += [(i, j, r + 1, k, -p, n) for r, (k, n) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize(("anchor_rows", "block_rows"), [(2048, 8192), (3, 40)])
def test_hard_negatives_against_loops(spark, anchor_rows, block_rows):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(rng.integers(0, 3)), rng.normal(0, 0.3, int(rng.integers(5, 12))).astype(np.float32).tolist()) for i in range(400)]
    rows[60:90] = [(i, i % 2, rows[60][2]) for i in range(60, 90)]  # ties
    odd = [(1000, 1, None), (1050, None, [0.1]), (None, 1, [0.1]), (1100, 1, [0.1, None]), (1150, 0, [math.nan]), (1200, 0, [math.inf]), (1250, 2, []), rows[50], rows[51]]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows + odd], "vec_id long, label int, embedding array<float>, row string, planes int").repartition(5)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, anchor_rows=anchor_rows, block_rows=block_rows)
    whole = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in [*rows, (1250, 2, [])]]
    assert sorted(map(tuple, got.collect())) == plain_negatives(whole)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("most", [3, 130, 40_000, 1 << 28])
def test_table_scores_are_inner_products(most):
    rng = np.random.default_rng(most)
    a, x = rng.integers(-most, most + 1, (17, 21)), rng.integers(-most, most + 1, (50, 21))
    places = int(most).bit_length() + 1
    got = hard_negatives.table_scores(hard_negatives.bit_planes(x, places), hard_negatives.subset_sums(a))
    assert (got == x @ a.T).all()


def test_huge_components_have_a_result(spark):
    df = spark.createDataFrame([(0, 1, [1e300, -1e300]), (1, 1, [1.0, 2.0]), (2, 0, [1.0, 1.0])], "vec_id long, label int, embedding array<double>")
    hard_negatives.hard_negatives(df, F.col("vec_id") == 0).collect()


# --- runs --------------------------------------------------------------------------------------------------------


def plain_runs(ids, least=24, times=3):
    found, n = {}, len(ids)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if ids[i] == ids[i + p]:
                s = i
                while i + p < n and ids[i] == ids[i + p]:
                    i += 1
                if i + p - s >= max(least, times * p):
                    found.setdefault((s, i + p - s), p)
            i += 1
    return sorted(((s, k, p) for (s, k), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 2), (4, 2), (10, 3)])
def test_runs_against_loops(least, times):
    rng = np.random.default_rng(least)
    for turn in range(400):
        ids = rng.integers(0, rng.integers(1, 4), int(rng.integers(2, 120)))
        if turn % 2:
            start, period = int(rng.integers(0, len(ids))), int(rng.integers(1, 12))
            ids[start:] = ids[start + np.arange(len(ids) - start) % period] if start + period <= len(ids) else ids[start]
            ids[int(rng.integers(0, len(ids)))] = 7
        ids = ids.astype(np.int32)
        want = plain_runs(ids.tolist(), least, times)
        assert periodic.runs_of(ids, least, times) == want
        shortest = -(-least * (times - 1) // times)
        assert not want or periodic.repeated_windows([ids], 1 << shortest.bit_length() - 1)[0]


def test_runs_on_odd_rows(spark):
    chorus = " ".join(f"la{k}" for k in range(9))
    texts = [None, "", " \t\n\x0b ", "a", "x " * 30, f"intro {chorus}\t{chorus}\n{chorus} end", "漢 é\x85b " * 40, "w " * 400_000, " ".join(f"w{k}" for k in range(300_000))]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(4, texts[4], "y", 2), (None, texts[4], None, None)], "doc_id long, text string, runs string, known long").repartition(3)
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(df).collect()}
    assert periodic.find_runs(df).count() == len(texts) + 2
    assert got[0] == got[1] == got[2] == (0, [], "")
    assert got[3] == (1, [], "a")
    assert got[4] == got[None] == (30, [(0, 30, 1)], "x")
    assert got[5] == (29, [(1, 27, 9)], f"intro {chorus} end")
    assert got[6] == (80, [(0, 80, 2)], "漢 é\x85b")
    assert got[7] == (400_000, [(0, 400_000, 1)], "w") and got[8] == (300_000, [], texts[8])
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_texts_split_in_pieces_stay_whole(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 7)
    text = b"one two\tthree  fourteen\n" * 9
    assert [w for part in periodic._words(text) for w in part] == text.split()
    ids = np.array([0, 1, 2, 3] * 9, np.int32)
    assert periodic._collapsed(text, periodic.runs_of(ids), 36) == "one two three fourteen"


def test_greatest_run(spark):
    df = spark.createDataFrame([([(5, 30, 10), (9, 31, 10), (1, 24, 8), (50, 93, 30)],), ([],)], "runs array<struct<start: long, length: long, period: long>>")
    best = [r.best for r in df.select(periodic.greatest_run(F.col("runs")).alias("best")).collect()]
    assert tuple(best[0]) == (9, 31, 10) and best[1] is None


# --- chat --------------------------------------------------------------------------------------------------------

TURNS = [
    (1, 2, "assistant", "hello"), (1, 0, "system", "be ## brief"), (1, 1, "user", "### user: x</turn>"), (1, 3, "assistant", None), (1, 4, "assistant", "a\\</turn>\\"),
    (2, 0, "user", "#" * 7 + "<<//turn>"), (2, 1, "a: b##</turn>\\ : ", ": x"), (2, 2, None, ""), (2, None, "user", "no turn"), (2, 1, "a: b##</turn>\\ : ", ": x"),
    (3, 0, "assistant", "\n\\\n### \\"), (3, 0, "assistant", "ties"), (None, 0, "user", "lost"), (4, 0, None, None), (5, 1, "user:", "x"), (5, 2, "#", "#"), (5, 3, "<", "/turn>"),
]


def test_chat_reads_back(spark):
    df = spark.createDataFrame([(*t, "x", 3) for t in TURNS], "conv_id long, turn long, role string, text string, turns string, formatted long").repartition(4)
    written = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_conversations(written).collect()}
    masks = {r.conv_id: r for r in written.collect()}
    want = {}
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (t[0] or 0, -1 if t[1] is None else t[1], t[2] or "", t[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv].turns] == turns
        assert "".join(got[conv].losses) == "".join(t for r, t in turns if r == "assistant")
        r = masks[conv]
        assert sum(m.before + m.loss + m.after for m in r.loss_mask) == len(r.formatted) == got[conv].formatted_chars
        at, under = 0, ""
        for m in r.loss_mask:
            under += r.formatted[at + m.before : at + m.before + m.loss]
            at += m.before + m.loss + m.after
        assert under.count("</turn>") == 0 and r.formatted.count("</turn>") == len(turns)
        roles = [b.role for b in r.blocks]
        assert all(a != b for a, b in zip(roles, roles[1:])) and sum(len(b.texts) for b in r.blocks) == len(turns)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_uses_expressions_only_and_one_shuffle(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.read_conversations(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_long_conversation_and_text(spark):
    rows = [(1, k, ("user", "assistant", "assistant")[k % 3], f"turn {k} \\ ## </turn>") for k in range(20_000)] + [(2, 0, "assistant", "long </turn> " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[:-1]]
    assert got[2].losses[0] == rows[-1][3]
    assert hashlib.sha256("".join(got[1].losses).encode()).hexdigest() == hashlib.sha256("".join(t for _, _, r, t in rows[:-1] if r == "assistant").encode()).hexdigest()
