"""Operators on small hand-made frames."""

from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.operators import claims, kg, names, runs, scoring
from palmleaf.operators.components import connected_components
from palmleaf.sources import io


def test_text_columns(spark):
    df = spark.createDataFrame([("ශ්‍රී ලංකාව",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(T.tokens(F.col("t"), T.SINHALA)).collect()]
    assert len(got[0]) == 3 and got[1] is None and got[2] == []
    one = spark.range(1)
    assert one.select(T.strip_suffix(F.lit("ලංකාවේ"))).first()[0] == "ලංකාව"
    assert one.select(T.sanitize_relation(F.lit("ruled-by x!"))).first()[0] == "RULED_BY_X"
    assert one.select(T.sanitize_relation(F.lit("!"))).first()[0] is None
    assert one.select(T.slug(F.lit("  "))).first()[0] == "essay"
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("X").alias("label")) for a, b in ((4, 6), (0, 2), (1, 3))))
    assert one.select(T.annotate_spans(F.lit("ab cdef"), spans)).first()[0] == "[ab](X) c[de](X)f"
    assert [one.select(T.accuracy_band(F.lit(x))).first()[0] for x in (95.0, 80.0, 60.0, 41.0, 1.0)] == [5, 4, 3, 2, 1]


def test_scores_round_half_to_even(spark):
    row = spark.range(1).select(scoring._to_five(F.lit(0.375)), scoring._to_five(F.lit(0.625)), scoring.coherence_score(F.lit(7))).first()
    assert tuple(row) == (2, 4, 5)
    d = {"D1": F.lit(1), "D2": F.lit(3), "D3": F.lit(None).cast("int"), "D4": F.lit(3)}
    assert tuple(spark.range(1).select(scoring.weakest(d), scoring.total(d), scoring.average(d)).first()) == ("D2", 7, 2.33)


def test_ranks_and_head(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 5), (None, 1)], "a int, b int")
    assert tuple(round(x, 4) for x in scoring.spearman(pairs).first()) == (4, 0.8333)
    assert tuple(scoring.spearman(pairs.limit(0)).first()) == (0, None)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0])], "vec_id long, e array<float>")
    got = scoring.embedding_head(v, "vec_id", "e", [[9.0, 0.0]], [[1.0], [-1.0], [0.0]]).collect()
    assert [tuple(r) for r in got] == [(1, 5, 1, 3), (2, 3, 3, 3)]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 7), (None, 1)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 7: 7}
    assert connected_components(e.limit(0)).count() == 0


def test_alias_last_wins_and_names(spark):
    al = spark.createDataFrame([(1, "A ", "x"), (2, "B", "x"), (3, "A ", "B")], "seq int, canonical string, alias string")
    got = {r.name: r.canonical for r in names.resolve_to_canonical(spark.createDataFrame([("x",), ("A",), ("B",), ("z",)], "name string"), al).collect()}
    assert got == {"x": "B", "A": "A", "B": "B", "z": "z"}
    texts = spark.createDataFrame([(1, "විජය රජු සහ විජයබාහු"), (2, None)], "text_id int, text string")
    got = names.find_mentions(texts, spark.createDataFrame([("විජය", "V"), ("විජයබාහු", "VB")], "name string, canonical string")).collect()
    assert sorted((r.canonical, r.start) for r in got) == [("V", 0), ("VB", 12)]


def test_tiers(spark):
    c = spark.createDataFrame([("s", "ලංකාවේ"), ("s", "විජය"), ("s", "නැත")], "sent_id string, candidate string")
    t = spark.createDataFrame([("s", "ලංකාව"), ("s", "විජය රජු")], "sent_id string, entity string")
    assert {r.candidate: r.tier for r in names.resolve_tiers(c, t).collect()} == {"ලංකාවේ": 2, "විජය": 3, "නැත": None}


def test_graph_writes(spark):
    n = spark.createDataFrame([(0, "a", "King", ["x"]), (1, "b", "Place", [])], "node_id long, name string, label string, aliases array<string>")
    e = spark.createDataFrame([(0, "RULED", 1, "", "", 1.0)], "src_id long, relation string, dst_id long, period string, source_citation string, confidence double")
    inc = spark.createDataFrame([("x", "King", ["y"]), ("c", "Monk", ["z"]), ("c", "Monk", ["w"])], "name string, label string, aliases array<string>")
    got = {r.name: sorted(r.aliases) for r in kg.upsert_nodes(n, inc).collect()}
    assert got == {"a": ["x", "y"], "b": [], "c": ["w", "z"]}
    tr = spark.createDataFrame([("a", "RULED", "b", "", ""), ("x", "BUILT", "b", "", ""), ("q", "BUILT", "b", "", "")], "subject string, relation string, object string, period string, source string")
    after, status = kg.upsert_edges(e, n, tr)
    assert after.count() == 2 and sorted(r.status for r in status.collect()) == ["created", "duplicate", "missing node"]
    assert kg.upsert_edges(after, n, tr)[0].count() == 2
    assert kg.shortest_path(e, 1, 0).first()["path"] == [1, 0]
    assert kg.shortest_path(e, 1, 7).count() == 0


def test_replies(spark):
    rows = [("```json\n[{\"subject\": \"a{\", \"relation\": \"R\"}, {\"subject\": \"b\"}, {\"subj",), ("[]",), (None,), ("{\"subject\": \"c\"}",)]
    got = claims.parse_replies(spark.createDataFrame(rows, "reply string"), claims.TRIPLE).collect()
    assert [[t["subject"] for t in r.parsed] for r in got] == [["a{", "b"], [], [], ["c"]]


def test_claims_normalised_and_padded(spark):
    schema = "essay_id string, batch_no int, pos int, claim_text string, claim_type string, verdict string, unverifiable_reason string, matched_fact string, explanation string, feedback string"
    rows = [("e", 1, 0, "t", "EDITORIAL", "CORRECT", None, None, "", "f"), ("e", 1, 1, "t", None, "CORRECT", "X", None, "", "f")]
    out = claims.normalize_claims(spark.createDataFrame(rows, schema))
    assert [(r.claim_type, r.verdict, r.unverifiable_reason, r.feedback) for r in out.orderBy("pos").collect()] == [("EDITORIAL", "UNVERIFIABLE", "NOT_FACTUAL", None), ("FACTUAL", "CORRECT", None, None)]
    batches = spark.createDataFrame([("e", 1, ["a", "b", "c"]), ("e", 2, ["d"])], "essay_id string, batch_no int, sentences array<string>")
    assert claims.pad_claims(batches, out).count() == 4
    acc = claims.aggregate_accuracy(spark.createDataFrame([("e",), ("none",)], "essay_id string"), claims.pad_claims(batches, out))
    assert {r.essay_id: (r.n_claims, r.accuracy, r.confidence) for r in acc.collect()} == {"e": (4, 100.0, "LOW"), "none": (0, None, "INSUFFICIENT_KG")}


def test_sources_and_runs(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"text": "a"}, {"id": "k", "text": "b", "topic": "t"}]')
    assert sorted(r.essay_id for r in io.read_essays_json(spark, str(tmp_path / "e.json")).collect()) == ["essay_001", "k"]
    (tmp_path / "l.json").write_text('{"x": 1, "y": 2}')
    assert sorted(r.token for r in io.read_lexicon(spark, [str(tmp_path / "l.json"), str(tmp_path / "absent.json")]).collect()) == ["x", "y"]
    raw = spark.createDataFrame([('{"a": "x\ny"}',), ("{bad",), ('{"b": 1}',)], "body string")
    got = io.parse_submissions(raw, "a string, b int", ["a", "b"]).collect()
    assert [r.error for r in got] == ["missing: b", "invalid body", "missing: a"]
    df = spark.sql("select 1 as run_id, timestamp'2024-01-01' as ts, 5L as total_claims")
    runs.append(df, str(tmp_path / "runs"))
    assert runs.read_compat(spark, str(tmp_path / "runs")).first()["total_factual_claims"] == 5
