"""Mixing sources to target weights over a domain-language-source tree, with DataFrame functions only.

Capacities are summed up the tree; budgets are propagated down it. At each node the children share its budget by weight;
a child that cannot take its share is filled, and what is short is shared among its siblings before anything is left to
an ancestor's other children. Each leaf then takes whole seeded epochs and a token-prefix of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.shared import materialize

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order hash that make a cell of a leaf; prefix sums run over cells first, then inside each.
CELL_DIGITS = 3
#: Parts in which the rows of a leaf meet its budget.
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"


def level_name(column: Column) -> Column:
    """Label of a tree node; null has its own."""
    return F.coalesce(column.cast("string"), F.lit("(none)"))


def leaf_budgets(leaves: DataFrame, weights: list[tuple], total: Column, max_epochs: int) -> DataFrame:
    """``domain, lang, source, tokens, budget`` from ``domain, lang, source, tokens`` (one row per leaf).

    weights: (domain, lang, source, weight), None for all deeper levels; nodes without an entry weigh 1. total: tokens
    wanted in all, as a column over the leaves' sum ``tokens``. Weight 0 takes nothing.
    """
    spark = leaves.sparkSession
    tree = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    given = spark.createDataFrame([("\x01".join(str(x) for x in w[:3] if x is not None), float(w[3])) for w in weights], "path string, weight double")
    nodes: dict[int, DataFrame] = {}
    for depth in (3, 2, 1):
        keys = list(LEVELS[:depth])
        below = tree if depth == 3 else nodes[depth + 1].withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0.0)))
        level = below.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap"))
        level = level.withColumn("path", F.concat_ws("\x01", *keys)).join(F.broadcast(given.withColumnRenamed("path", "p")), F.col("path") == F.col("p"), "left")
        nodes[depth] = level.select(*keys, "tokens", "cap", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    # a parent's budget never exceeds what its children can take
    parent = nodes[1].agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)).alias("cap")).select(F.least(total.cast("double"), F.col("cap")).alias("budget"))
    for depth in (1, 2, 3):
        up = list(LEVELS[: depth - 1])
        below = nodes[depth].where((F.col("weight") > 0) & (F.col("cap") > 0)).withColumn("ratio", F.col("cap") / F.col("weight"))
        of = ", ".join(up)
        over = f"(partition by {of} order by ratio range between unbounded preceding and current row)" if up else "(order by ratio range between unbounded preceding and current row)"
        whole = f"(partition by {of})" if up else "()"
        below = below.selectExpr("*", f"sum(cap) over {over} as cap_upto", f"sum(weight) over {whole} - sum(weight) over {over} as weight_after")
        joined = below.join(parent.hint("shuffle_hash"), up) if up else below.crossJoin(F.broadcast(parent))  # one row
        joined = joined.withColumn("full", F.col("cap_upto") + F.col("ratio") * F.col("weight_after") <= F.col("budget"))
        rest = [f"budget - sum(case when full then cap else 0.0D end) over {whole} as left_over", f"sum(case when full then 0.0D else weight end) over {whole} as open_weight"]
        joined = joined.selectExpr("*", *rest)
        parent = joined.select(*LEVELS[:depth], F.when(F.col("full"), F.col("cap")).otherwise(F.col("left_over") * F.col("weight") / F.nullif("open_weight", F.lit(0.0))).alias("budget"))
    return leaves.join(parent.hint("shuffle_hash"), list(LEVELS), "left").select(*LEVELS, "tokens", F.floor(F.coalesce("budget", F.lit(0.0)) + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, domain: Column, weights: list[tuple], share: float = 0.5, seed: int = 17, max_epochs: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The mixture: every chosen row of ``docs`` once per epoch in which it is chosen, its columns (or those in ``keep``) in
    struct ``row``, with ``domain, lang, source, epoch, tokens``.

    docs needs columns lang and source. share: tokens of the mixture as a share of all tokens (words) there are. An epoch
    is an order of the leaf's rows by md5 of seed, epoch and id; the last one is cut where the running tokens would pass
    the budget. Nulls in lang, source or domain form branches of their own; null and empty texts have no tokens and come
    along where the prefix reaches them; repeated rows count each; an empty table gives no rows.
    """
    leaf = F.struct(level_name(domain).alias("domain"), level_name(F.col("lang")).alias("lang"), level_name(F.col("source")).alias("source"))
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), leaf.alias("leaf"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    slim = materialize(rows.select("id", "leaf.*", "tokens"), "tokens")
    leaves = materialize(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    everything = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(leaves, weights, F.lit(float(int(everything * share))), max_epochs)
    budgets = materialize(budgets.selectExpr("domain as b_domain", "lang as b_lang", "source as b_source", "case when tokens > 0 then budget div tokens else 0 end as whole", "case when tokens > 0 then budget % tokens else 0 end as part"), "budgets")
    # rows of a leaf in the order of its last, partial epoch; joined on leaf and salt, for one leaf may hold a third of all rows
    budgets = budgets.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (F.pmod(F.xxhash64("id"), F.lit(SALTS)) == F.col("b_salt")) & (F.col("domain") == F.col("b_domain")) & (F.col("lang") == F.col("b_lang")) & (F.col("source") == F.col("b_source"))
    row = rows.select("row", "id", "leaf.*", "tokens").join(budgets.hint("merge"), same)
    row = row.drop("b_domain", "b_lang", "b_source", "b_salt").withColumn("rank", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("id"))))
    row = row.withColumn("cell", F.substring("rank", 1, CELL_DIGITS))
    order = slim.join(budgets.hint("merge"), same).withColumn("cell", F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("id"))), 1, CELL_DIGITS))
    cells = order.groupBy(*LEVELS, "cell").agg(F.sum("tokens").alias("n"))
    cells = cells.selectExpr(*(f"{c} as c_{c}" for c in LEVELS), "cell as c_cell", "sum(n) over (partition by domain, lang, source order by cell) - n as before")
    at = (F.col("domain") == F.col("c_domain")) & (F.col("lang") == F.col("c_lang")) & (F.col("source") == F.col("c_source")) & (F.col("cell") == F.col("c_cell"))
    row = row.join(materialize(cells, "cells").hint("merge"), at)
    row = row.selectExpr("*", "before + sum(tokens) over (partition by domain, lang, source, cell order by rank rows unbounded preceding) as upto")
    epochs = F.expr("filter(sequence(0L, whole), e -> e < whole or (part > 0 and upto <= part))")
    return row.select("row", *LEVELS, F.explode(epochs).alias("epoch"), "tokens")


#: Domains of the given documents by the number in their source's name (src0, src1, ...); sources named otherwise, or none, are ``other``.
_NUMBER = "try_cast(substr(source, 4) as int)"
DOMAIN_SQL = f"case when source is null or substr(source, 1, 3) != 'src' or length(source) not between 4 and 12 or translate(substr(source, 4), '0123456789', '') != '' then 'other' when {_NUMBER} = 0 then 'web' when {_NUMBER} < 8 then 'books' when {_NUMBER} < 14 then 'news' else 'forum' end"
WEIGHTS = [("web", None, None, 2.0), ("books", None, None, 4.0), ("news", None, None, 3.0), ("forum", None, None, 1.0), ("books", "en", None, 2.0), ("books", "es", None, 3.0), ("news", "de", None, 2.0), ("news", "de", "src9", 3.0), ("web", "es", None, 0.5)]
SHARE, SEED, EPOCHS = 0.5, 17, 4


def mixture_report(docs: DataFrame) -> DataFrame:
    """Every chosen document and epoch of the production mixture."""
    out = mix(docs, F.expr(DOMAIN_SQL), WEIGHTS, SHARE, SEED, EPOCHS, keep=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), *LEVELS, "epoch", "tokens")


def _level_sql(depth: int, of: str) -> str:
    """Water-filling of one level in SQL: ``of`` holds the parents' budgets."""
    keys, up = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
    part = f"partition by {', '.join(up)} " if up else ""
    using = f"join {of} using ({', '.join(up)})" if up else f"cross join {of}"
    listed = ", ".join(keys)
    return f"""
r{depth} as (select *, sum(cap) over ({part}order by ratio range between unbounded preceding and current row) as cap_upto,
    sum(weight) over ({part}) - sum(weight) over ({part}order by ratio range between unbounded preceding and current row) as weight_after
  from (select *, cap / weight as ratio from n{depth} where weight > 0 and cap > 0)),
f{depth} as (select *, cap_upto + ratio * weight_after <= budget as filled from r{depth} {using}),
b{depth} as (select {listed}, case when filled then cap else left_over * weight / open_weight end as budget from (
    select *, budget - sum(case when filled then cap else 0 end) over ({part}) as left_over, sum(case when filled then 0 else weight end) over ({part}) as open_weight from f{depth}))"""


def mixture_sql(documents: str = "documents", share: float = SHARE, epochs: int = EPOCHS) -> str:
    """DuckDB SQL for mixture_report's rows."""
    rows = ", ".join(f"('{'/'.join(str(x) for x in w[:3] if x is not None)}', {w[3]:.1f}::double)" for w in WEIGHTS)
    d, leaf = DOMAIN_SQL, "domain, lang, source"
    node = lambda k, of, cap: f"n{k} as (select a.*, coalesce(g.weight, 1.0::double) as weight from (select {', '.join(LEVELS[:k])}, sum({cap}) as cap from {of} group by all) a left join given g on g.path = concat_ws('/', {', '.join(LEVELS[:k])}))"
    held = "case when weight > 0 then cap else 0 end"
    return f"""
with t as (select doc_id, coalesce({d}, '(none)') as domain, coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source,
    cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as tokens from {documents}),
given(path, weight) as (values {rows}),
leaves as (select {leaf}, cast(sum(tokens) as bigint) as tokens, sum(tokens)::double * {epochs} as cap from t group by all),
{node(3, 'leaves', 'cap')},
{node(2, 'n3', held)},
{node(1, 'n2', held)},
b0 as (select least(floor((select sum(tokens) from t) * {share})::double, (select sum({held}) from n1)) as budget),
{_level_sql(1, 'b0')},
{_level_sql(2, 'b1')},
{_level_sql(3, 'b2')},
take as (select l.*, case when tokens > 0 then budget // tokens else 0 end as whole, case when tokens > 0 then budget % tokens else 0 end as part
  from (select {leaf}, tokens, cast(floor(coalesce(budget, 0) + 1e-6) as bigint) as budget from leaves left join b3 using ({leaf})) l),
ranked as (select t.*, whole, part, sum(t.tokens) over (partition by {leaf} order by md5(concat_ws(':', '{SEED}', whole::varchar, coalesce(doc_id::varchar, ''))) rows unbounded preceding) as upto
  from t join (select {leaf}, whole, part from take) using ({leaf}))
select doc_id, {leaf}, cast(epoch as bigint) as epoch, tokens from (select *, unnest(range(0, whole + 1)) as epoch from ranked) where epoch < whole or (part > 0 and upto <= part)"""
