"""Conversation repair, whitening and licence scans against SQL and brute force, on given tables and on rows with nulls, ties, repeats and clashing names."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from palmleaf.llm import htmltext, licenses, neighbours, repair, sharding, whitening

SF = "/root/testdata/sf0.001"


def rows_of(df: pd.DataFrame) -> list[tuple]:
    text = lambda v: "-" if pd.isna(v) else str(float(v)) if isinstance(v, (int, float, np.number)) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def in_duckdb(sql: str, name: str, columns: str, rows: list[tuple]) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute(f"create table {name}({columns})")
    if rows:
        con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    return con.execute(sql).df()


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Least (cost, audit) over all ways to edit, with four insertions at most."""
    best: list = []

    def go(i, out, cost, audit, inserted):
        if best and cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            best[:] = [min(best + [(cost, audit)])]
        for c in "ua" if inserted < 4 else "":
            go(i, out + c, cost + 5, audit + "I", inserted + 1)
        if i == len(rows):
            return
        initial, fault = rows[i]
        go(i + 1, out, cost + 2, audit + "D", inserted)
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            go(i + 1, out + (initial or "x"), cost + more, audit + "K", inserted)
            for c in "ua":
                go(i + 1, out + c, cost + 1 + more, audit + "R", inserted)

    go(0, "", 0, "", 0)
    return best[0]


def test_repair_charts():
    rnd = random.Random(3)
    for _ in range(150):
        rows = [(rnd.choice(["s", "u", "a", "u", "a", ""]), rnd.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rnd.randint(0, 5))]
        leaves = [repair.leaf(*r) for r in rows]
        assert repair.accepted(repair.chart(leaves)) == cheapest(rows)
        for k in range(len(rows)):  # charts of parts, put side by side, give the chart of the whole
            assert repair.chart([repair.chart(leaves[:k]), repair.chart(leaves[k:])]) == repair.chart(leaves)


def test_repair(spark):
    rnd = random.Random(4)
    texts = [None, "", " ", "\t\n", "Hi.", "Hi", "no!  ", "why?\n", "é.", "\U0001f600", "x", "long " * 20_000 + "."]
    rows = [(rnd.choice([None, 1, 2, 3, 4, 5, 6, 2**40]), rnd.choice([None, *range(50), 2**60]), rnd.choice(["user", "assistant", "system", "tool", None, "", "sys"]), rnd.choice(texts)) for _ in range(300)]
    rows += [(77, i // 2, "user" if i % 2 else "assistant", f"text {i}.") for i in range(600)]  # a conversation of many charts and levels
    rows += [(78, 5, "user", "same.")] * 40 + [(k, 0, "user", "one") for k in range(100, 140)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as cell", "3 as g", "4 as dropped", "5 as mark", "6 as audit", "7 as fate")
    want = in_duckdb(repair.repair_sql(), "conversations", "conv_id bigint, turn bigint, role varchar, text varchar", rows)
    assert rows_of(repair.repair_report(df).toPandas()) == rows_of(want)
    assert repair.repair_report(df.limit(0)).count() == 0
    whole = spark.read.parquet(f"{SF}/conversations.parquet")
    given = [tuple(r) for r in whole.select("conv_id", "turn", "role", "text").collect()]
    want = in_duckdb(repair.repair_sql(), "conversations", "conv_id bigint, turn bigint, role varchar, text varchar", given)
    assert rows_of(repair.repair_report(whole).toPandas()) == rows_of(want)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "s.", False), (1, 1, "assistant", "a.", False), (2, 0, "bot", "q?", False), (2, 1, "assistant", "a.", False), (3, 0, "user", "x.", True)]
    verdicts, numbered = repair.repair(spark.createDataFrame(rows, "conv int, turn int, role string, text string, dropped boolean"))
    assert {r.conv: (r.cost, r.audit) for r in verdicts.collect()} == {1: (1, "RK"), 2: (1, "RK"), 3: (0, "")}
    got = sorted((r.conv, r.place, r.edit, r.role, r.text) for r in repair.repaired_turns(numbered, verdicts).collect())
    assert got == [(1, 0, "R", "user", "s."), (1, 1, "K", "assistant", "a."), (2, 0, "R", "user", "q?"), (2, 1, "K", "assistant", "a.")]


@pytest.mark.parametrize("kind", ["full", "low rank", "equal values", "split", "zero", "one"])
def test_eigenpairs(kind):
    rnd = np.random.default_rng(7)
    b = rnd.standard_normal((40, 40))
    q = np.linalg.qr(b)[0]
    a = {"full": b @ b.T, "low rank": b[:, :3] @ b[:, :3].T, "equal values": q @ np.diag([5.0] * 20 + [1.0] * 20) @ q.T, "split": np.diag([3.0] * 20 + [2.0] * 20), "zero": np.zeros((4, 4)), "one": np.array([[2.0]])}[kind]
    k = min(32, len(a))
    values, vectors = whitening.leading_pairs(a, k)
    size = max(np.abs(a).max(), 1.0)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-12 * size)
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12 and np.abs(a @ vectors.T - vectors.T * values).max() < 1e-12 * size


def slow_whitening(vectors: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    x = np.array([[int(v) for v in r] for r in np.floor(64 * vectors)], dtype=object) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    y = (x - np.array([b / n for b in s])).astype(float)
    values, vecs = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:32]
    return deviation, y @ vecs[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("huge", [False, True])
def test_whitening(spark, huge):
    rnd = np.random.default_rng(2)
    given = rnd.standard_normal((300, 40)).astype(np.float32) * np.linspace(0.2, 3, 40, dtype=np.float32) * (np.float32(1e8) if huge else 1)
    given[5] = 0
    given[7] = given[8]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(given)]
    bad = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, [1.0]), (905, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as component", "2 as _vector", "3 as place", "4 as n")
    got = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    deviation, white, explained = slow_whitening(given.astype(np.float64))
    assert len(got) == 300 * 32 and set(got.n) == {300} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert [int(v) for v in got.deviation[::32]] == deviation
    w = got.whitened.to_numpy().reshape(300, 32)
    signs = np.sign((w * white).sum(axis=0))
    assert np.abs(w * signs - white).max() < 1e-7 and np.abs(got.explained.to_numpy()[:32] - explained).max() < 1e-10
    if huge:
        with pytest.raises(Exception, match="(?i)overflow|out of range"):
            whitening.whitening_report(df).collect()


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert whitening.whitening_report(frame([])).count() == 0
    assert whitening.whitening_report(frame([(1, None)])).count() == 0
    assert whitening.whitening_report(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # nothing varies
    two = whitening.whitening_report(frame([(None, [1.0, 2.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0])])).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, round(r.explained, 9)) for r in two) == [(0, 1, 3, 1.0), (2, 1, 3, 1.0), (2, 1, 3, 1.0)]


def test_licenses(spark):
    rnd = random.Random(6)
    words = ["all", "rights", "reserved", "cc", "by", "nc", "general", "public", "license", "mit", "the", "version", "3", "über", "x"]
    texts = [rnd.choice(" -\n.").join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " \n", "All Rights RESERVED, all rights\nreserved", "CC-BY", "cc éby", "0cc by", "license " * 3000 + "mit license", "general public license " * 2000]
    texts += ["Released under the MIT License", "This work is licensed under the GNU General Public License, version 3.", "rights reserved all", "reserved", "\x80 cc by"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as lang", "1 as word", "2 as n_words", "3 as labels")
    got = licenses.license_report(df).toPandas()
    want = in_duckdb(licenses.license_sql(), "documents", "doc_id bigint, text varchar", rows)
    assert rows_of(got) == rows_of(want) and len(got) == len(rows)

    def places(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for label, p in licenses.PHRASES}
        every = sorted(i for a in at.values() for i in a)
        return len(w), len(every), every[0] if every else "-", every[-1] if every else "-", ",".join(sorted(k for k, a in at.items() if a))

    slow = sorted(tuple(map(str, (-1 if i is None else i, *places(t)))) for i, t in rows)
    fast = sorted(tuple(map(str, (-1 if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, r.n_base, "-" if pd.isna(r.first_word) else int(r.first_word), "-" if pd.isna(r.last_word) else int(r.last_word), r.base_labels))) for r in got.itertuples())
    assert slow == fast
    by_text = {t: (la, s) for t, la, s in zip([t for _, t in sorted(((-1 if i is None else i), t) for i, t in rows)], got.sort_values("doc_id", na_position="first").labels, got.sort_values("doc_id", na_position="first").score)}
    assert by_text["Released under the MIT License"] == ("mit", 1.0) and by_text["reserved"] == ("", 0.0)
    assert licenses.license_report(df.limit(0)).count() == 0


def test_neighbours_are_never_short(spark):
    """Clusters of fewer than k vectors, apart from a large one, and rows that repeat: each query gets k rows where there are k candidates."""
    rnd = np.random.default_rng(3)
    parts, at = [], 0
    for size in (600, 3, 3, 3, 2, 2, 1):
        centre = rnd.standard_normal(32) * 10
        parts += [(at + i, (centre + 0.01 * rnd.standard_normal(32)).tolist()) for i in range(size)]
        at += size
    parts += [parts[600]] * 20 + [parts[603]] * 10
    df = spark.createDataFrame(parts, "vec_id long, embedding array<float>")
    settings = neighbours.Settings(list_size=8)
    queries = df.where("vec_id >= 590").distinct()
    got = neighbours.nearest_neighbours(df, queries, 5, settings).toPandas()
    assert (got.groupby("query_id").size() == 5).all() and got.query_id.nunique() == at - 590
    assert not got.duplicated(["query_id", "vec_id"]).any() and (got.query_id != got.vec_id).all()
    few = spark.createDataFrame(parts[:3], "vec_id long, embedding array<float>")
    assert neighbours.nearest_neighbours(few, few, 5).count() == 6


def test_sharding_of_hot_rows(spark):
    """A row that repeats more often than a shard holds, ids and texts alike, is cut; other equal texts stay together."""
    rows = [(None, "same text")] * 500 + [(i, f"t{i // 4} " + "x" * (i // 4 % 30)) for i in range(500)] + [(7, "an id that repeats")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.shard_report(df).toPandas()
    bytes_of = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and len(bytes_of) == 16 and bytes_of.max() - bytes_of.min() < 0.25 * bytes_of.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    apart = got.groupby("text_crc32").shard.nunique()
    assert (apart > 1).sum() == 2


def test_asides_by_what_they_hold(spark):
    """With weights fitted on the given pages: wrappers named after a sidebar, teasers in one, parts of articles named after links, and text between articles."""
    weights = htmltext.fit_weights(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    long, more = " ".join(f"word{i}" for i in range(60)), " ".join(f"other{i}" for i in range(60))
    body = f"<p>{long}.</p><p>{more}.</p>"
    want = f"{long}.\n\n{more}."
    page = lambda inner: htmltext.main_text(f"<html><body>{inner}</body></html>", weights)
    for name in ("content-sidebar-wrap", "page-with-sidebar", "widget-area", "notice"):
        assert page(f'<nav><a href="/">Home</a></nav><div class="{name}"><div class="entry">{body}</div></div>') == want
    assert page(f'<div class="sidebar"><article>A teaser of few words</article></div><div class="content">{body}</div>') == want
    for inner in ('<div class="share-buttons"><a>Mail it</a> <a>Print it</a></div>', '<ul class="related-links"><li><a>One more page</a></li></ul>', '<div class="site-notice">We close on Monday</div>', '<div class="comments"><p>I liked it very much</p></div>'):
        assert page(f"<article><p>{long}.</p>{inner}<p>{more}.</p></article>") == want
    assert page(f"<article><p>{long}.</p></article><p>Of neither.</p><article><p>{more}.</p></article>") == want
    assert page(f'<article><p>{long}.</p><section class="related-work"><p>{more}.</p></section></article>') == want
