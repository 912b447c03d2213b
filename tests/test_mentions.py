"""Mentions against plain scans and all pairs."""

import random
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
import pytest

from palmleaf.operators import mentions

NAMES = "seq int, name string, canonical string"


@pytest.mark.parametrize("most", [10**6, 12])
def test_exact_against_a_scan(spark, most):
    """Names that overlap, repeat, are empty or inside one another, against placing the longest first; in one automaton and in several."""
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("ab cx") for _ in range(n))
    listed = [(i, word(rnd.randint(0, 4)), f"c{i}") for i in range(25)] + [(30, None, "none")]
    texts = [(i, word(rnd.randint(0, 60))) for i in range(300)] + [(900, None), (901, ""), (7, "ab ab"), (7, "ab ab"), (None, "ab")]
    first = {}
    for i, name, canonical in listed:
        if name:
            first.setdefault(name, (i, canonical))
    want = []
    for k, text in texts:
        free = set(range(len(text or "")))
        for name, (_, canonical) in sorted(first.items(), key=lambda n: (-len(n[0]), n[1][0])):
            for at in range(len(text or "") - len(name) + 1):
                end = at + len(name)
                here = set(range(at, end))
                opens = at == 0 or text[at - 1] not in "ab"
                closes = end == len(text) or text[end] not in "ab" or text[end:].startswith("bx")
                if text[at:end] == name and opens and closes and here <= free:
                    free -= here
                    want.append((k, canonical, at))
    df = spark.createDataFrame(texts, "text_id long, text string")
    got = mentions.find_mentions(df, spark.createDataFrame(listed, NAMES), "ab", ("bx",), most).collect()
    order = lambda rows: sorted((-1 if k is None or k != k else int(k), c, s) for k, c, s in rows)
    assert order(map(tuple, got)) == order(want)
    assert mentions.find_mentions(df, spark.createDataFrame([], NAMES)).count() == 0


def test_composed_texts_and_many_names(spark):
    names = spark.range(100_000).selectExpr("concat('name', id, 'x') as name", "cast(id as string) as canonical")
    names = names.unionByName(spark.createDataFrame([("é", "e acute")], "name string, canonical string"))
    texts = spark.createDataFrame([(1, unicodedata.normalize("NFD", "é") + " name77x, name99999xx"), (2, "name99999x")], "text_id int, text string")
    got = sorted(map(tuple, mentions.find_mentions(texts, names, "a-z0-9é").collect()))
    assert got == [(1, "77", 2), (1, "e acute", 0), (2, "99999", 0)]


def misspelt(rnd, name):
    at = rnd.randrange(len(name))
    return rnd.choice([name, name[:at] + name[at + 1 :], name[:at] + rnd.choice("abcde") + name[at:], name[:at] + rnd.choice("abcde") + name[at + 1 :], name[1:] + name[:1]])


@pytest.mark.parametrize("ratio", [0.85, 0.5, 1.0])
def test_fuzzy_against_all_pairs(spark, ratio):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 12))) for _ in range(300)] + ["ab" * 60]
    listed = [(i // 2, w, f"c{i}") for i, w in enumerate(words)]
    tokens = [misspelt(rnd, rnd.choice(words)) or "a" for _ in range(200)]
    texts = [(i, " ".join(tokens[i * 4 : i * 4 + 4])) for i in range(50)] + [(60, None), (61, ""), (62, "abc"), (62, "abc")]
    exact = [(0,), (62,)] if ratio == 1.0 else [(0,)]
    first = {}
    for seq, name, canonical in listed:
        first[name] = min(first.get(name, (seq, canonical)), (seq, canonical))
    want = []
    for k, text in texts:
        at = 0
        for token in (text or "").split(" ") if (k,) not in exact else []:
            scored = [(-SequenceMatcher(None, token, n).ratio(), seq, n, c) for n, (seq, c) in first.items()]
            best = min((s for s in scored if -s[0] >= ratio), default=None)
            if token and best:
                want.append((k, token, at, best[3], -best[0]))
            at += len(token) + 1
    df = spark.createDataFrame(texts, "text_id int, text string")
    got = mentions.find_mentions_fuzzy(df, spark.createDataFrame(listed, NAMES), spark.createDataFrame(exact, "text_id int"), ratio, "[a-z]+").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
    assert mentions.find_mentions_fuzzy(df, spark.createDataFrame([], NAMES), spark.createDataFrame(exact, "text_id int"), ratio).count() == 0


def test_rows_go_on_in_pieces():
    """What a batch of texts gives goes on as it is made, some rows at a time, also where one text gives more; nulls give none, a null key stays."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3, 4]), pa.array(["a b c d e", "f", None, "g h"])], names=["text_id", "text"])
    taken = []

    def batches():
        for _ in range(2):
            taken.append(1)
            yield batch

    def words(text):
        return ((w, i) for i, w in enumerate(text.split()))

    pieces = mentions.in_pieces(batches(), words, mentions.TOKEN, 3)
    first = next(pieces)
    assert len(taken) == 1 and first.num_rows == 3  # before the first text has ended
    got = [first, *pieces]
    assert max(b.num_rows for b in got) == 3
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    once = [(1, w, i) for i, w in enumerate("abcde")] + [(None, "f", 0), (4, "g", 0), (4, "h", 1)]
    assert rows == once * 2
