"""Chat formatting: turns and speaker roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is the physical lines of a text, in order; nothing says where a turn begins. The hidden states of a line are
its speaker's role and whether it begins a turn or goes on with one. Each line has a speaker-marker class and a few line
features; start, transition and feature probabilities are counted from labelled lines, and Viterbi finds the likeliest
states. Lines from one beginning to the next are a turn; a marker goes only where the model takes its line for the beginning
of a turn by the speaker it names.

Long transcripts are decoded in blocks: each block gives the best score from any state before it to any state at its end
(max-plus products compose), these small tables are combined, some hundreds at a time and level by level, and blocks are then
decoded between their known ends, so no transcript is gathered whole and the result is that of one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.workers import lean
from palmleaf.shared import materialize

ROLES = ("system", "user", "assistant")
#: States: each role beginning a turn, then each role going on with one.
STATES = 2 * len(ROLES)
#: Lines a task decodes together, and lines the model is fitted on, in expectation.
BLOCK, FIT_LINES = 512, 60_000
#: Characters of a turn that one row of rendered turns begins to hold at most.
PART_CHARS = 1 << 20
#: Blocks of a transcript, or groups of them, whose ends are agreed on in one task.
FAN = 1024

# Names that transcripts give their speakers.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "customer", "question", "q", "prompter"),
    "assistant": ("assistant", "ai", "bot", "gpt", "answer", "a", "agent"),
}
_SPEAKER = {name: role for role, names in MARKERS.items() for name in names}
#: Forms of a marker: a name and a colon or angle, a name in brackets, and a heading that is the whole line.
_MARKER = re.compile(r"(?:\*\*([A-Za-z]{1,14}):?\*\*:?|([A-Za-z]{1,14})[:>]|\[([A-Za-z]{1,14})\]|<\|([A-Za-z]{1,14})\|>)(?: |\Z)")
_HEADING = re.compile(r"#{1,6} ?([A-Za-z]{1,14}):?\Z")
#: Features of a line: marker class, length, how it begins and how it ends.
FEATURES = (4, 10, 4, 5)


def split_marker(line: str) -> tuple[str | None, str, str | None]:
    """Role that a line's speaker marker names (None without a known marker), the marker, and the rest of the line.

    Marker and rest make up the line. The rest is None where a heading is the whole line, and so no line of the turn.
    """
    m = _HEADING.match(line)
    if m and m[1].lower() in _SPEAKER:
        return _SPEAKER[m[1].lower()], line, None
    m = _MARKER.match(line)
    role = _SPEAKER.get(next(g for g in m.groups() if g).lower()) if m else None
    return (role, m[0], line[m.end() :]) if m and role else (None, "", line)


def line_features(line: str) -> tuple[int, int, int, int]:
    """Feature values of a line, each below the FEATURES entry at its place."""
    role, _, rest = split_marker(line)
    rest = (rest or "").strip()
    ends = 0 if not rest else 1 if rest[-1] in "?¿？" else 2 if rest[-1] in ".!。" else 3 if rest[-1].isalnum() else 4
    begins = 0 if not rest else 1 if rest[0].isupper() else 2 if rest[0].isalpha() else 3
    return (1 + ROLES.index(role) if role else 0), min(9, len(rest).bit_length()), begins, ends


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fit(lines: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities counted from labelled lines (conv, pos, role, begins, line): ``start``, ``step`` and ``feature0..``.

    pos is gapless from 0 in each conv. Fitted on FIT_LINES lines in expectation, whole conversations by hash of their id.
    Roles other than the three, and null ones, are left out. A line's predecessor is looked up by its position, so no
    conversation is gathered.
    """
    lines = lines.where(F.col("role").isin(*ROLES) & F.col("line").isNotNull())
    n = lines.count()
    lines = lines.where(F.pmod(F.xxhash64("conv"), F.lit(1 << 30)) < F.lit(int(min(1.0, FIT_LINES / max(n, 1)) * (1 << 30))))
    lines = materialize(lines.select("conv", "pos", "role", "begins", "line"), "labelled-lines")
    before = lines.select(F.col("conv").alias("b_conv"), (F.col("pos") + 1).alias("b_pos"), F.col("role").alias("before"))
    lines = lines.join(before.hint("merge"), F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("pos") == F.col("b_pos")), "left")

    @F.arrow_udf("array<int>")
    def observed(column):
        import pyarrow as pa

        return pa.array([line_features(x.as_py()) for x in column], pa.list_(pa.int32()))

    seen = lines.select("role", "begins", "before", observed("line").alias("f"))
    seen = seen.groupBy("role", "begins", "before", "f").count().collect()  # at most states x roles x products of FEATURES
    r = {name: i for i, name in enumerate(ROLES)}
    start, step, feature = np.full(STATES, 1e-9), np.full((len(ROLES), STATES), 0.05), [np.full((STATES, size), 0.5) for size in FEATURES]
    start[: len(ROLES)] = 0.5
    for row in seen:
        state = r[row["role"]] + (0 if row["begins"] else len(ROLES))
        if row["before"] is None:
            start[state] += row["count"]
        else:
            step[r[row["before"]], state] += row["count"]
        for k, v in enumerate(row["f"]):
            feature[k][state, v] += row["count"]
    for a in range(len(ROLES)):  # a turn goes on with its own speaker only
        step[a, [len(ROLES) + b for b in range(len(ROLES)) if b != a]] = 1e-12
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return {"start": log(start), "step": np.vstack([log(step)] * 2), **{f"feature{k}": log(x) for k, x in enumerate(feature)}}


def emissions(model: dict[str, np.ndarray], lines: list[str]) -> np.ndarray:
    """(lines, states) log probabilities of the features."""
    got = np.array([line_features(x) for x in lines])
    return sum(model[f"feature{k}"][:, got[:, k]].T for k in range(len(FEATURES)))


def block_scores(model: dict[str, np.ndarray], seen: np.ndarray, first: bool) -> np.ndarray:
    """(before, last) best log score of a block for each state before it (any row if ``first``) and each state at its end."""
    score = (np.tile(model["start"], (STATES, 1)) if first else model["step"]) + seen[0]
    for e in seen[1:]:
        score = (score[:, :, None] + model["step"][None]).max(axis=1) + e
    return score


def viterbi(model: dict[str, np.ndarray], seen: np.ndarray, before: int | None, last: int | None) -> list[int]:
    """Likeliest states of a block given the state before it (None: it begins the transcript) and at its end (None: any)."""
    score = (model["start"] if before is None else model["step"][before]) + seen[0]
    back = []
    for e in seen[1:]:
        ways = score[:, None] + model["step"]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + e
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _blocks(it: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    """Whole (conv, block) groups of a stream that is sorted by them, a batch's worth at a time."""
    held = None
    for pdf in it:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        key = pdf["key"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        held = pdf.iloc[cuts[-1] :]
        if len(cuts) > 1:
            yield [pdf.iloc[x:y] for x, y in zip(cuts, cuts[1:])]
    if held is not None:
        yield [held]


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    """Scores of neighbouring blocks as those of one."""
    tables = [np.reshape(s, (STATES, STATES)) for s in pdf.sort_values("block")["scores"]]
    total = tables[0]
    for t in tables[1:]:
        total = (total[:, :, None] + t[None]).max(axis=1)
    return pd.DataFrame({"conv": pdf["conv"].iloc[:1], "block": pdf["above"].iloc[:1], "scores": [total.ravel().tolist()]})


def _agree(pdf: pd.DataFrame) -> pd.DataFrame:
    """States before and at the end of each of neighbouring blocks, between the states enter and leave (-1: any): Viterbi over blocks."""
    pdf = pdf.sort_values("block")
    enter, leave = int(pdf["enter"].iloc[0]), int(pdf["leave"].iloc[0])
    total, back, out = np.where((np.arange(STATES) == enter) | (enter < 0), 0.0, -np.inf), [], []
    for s in pdf["scores"]:
        ways = total[:, None] + np.reshape(s, (STATES, STATES))
        back.append(ways.argmax(axis=0))
        total = ways.max(axis=0)
    at = leave if leave >= 0 else int(total.argmax())
    for b in reversed(back):
        out.append((int(b[at]), at))
        at = int(b[at])
    before, last = zip(*out[::-1])
    return pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "before": before, "last": last})


def block_ends(blocks: DataFrame) -> DataFrame:
    """``(conv, block, before, last)``: states before and at the end of each block on its transcript's best path.

    blocks: (conv, block, scores), a stored table, block gapless from 0 in each conv. FAN blocks at most meet in a task:
    where a transcript has more, each FAN of them become one block of a shorter table, which is agreed on first. A null conv
    is a transcript of its own; an empty table gives no rows.
    """
    kind = dict(blocks.dtypes)["conv"]
    ends = f"conv {kind}, block bigint, before int, last int"
    if (blocks.agg(F.max("block")).first()[0] or 0) < FAN:
        return blocks.withColumns({"enter": F.lit(-1), "leave": F.lit(-1)}).groupBy("conv").applyInPandas(_agree, ends)
    blocks = blocks.withColumn("above", F.floor(F.col("block") / F.lit(FAN)).cast("long"))
    wide = materialize(blocks.groupBy("conv", "above").applyInPandas(_product, f"conv {kind}, block bigint, scores array<double>"), "block-scores")
    known = block_ends(wide).select(F.col("conv").alias("k_conv"), F.col("block").alias("k_block"), F.col("before").alias("enter"), F.col("last").alias("leave"))
    joined = blocks.join(known.hint("merge"), F.col("conv").eqNullSafe(F.col("k_conv")) & (F.col("above") == F.col("k_block")))
    return joined.select("conv", "block", "scores", "above", "enter", "leave").groupBy("conv", "above").applyInPandas(_agree, ends)


def recover_roles(lines: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``(conv, pos, block, role_pred, begins, marker, content)`` from ``(conv, pos, line)``, pos gapless from 0 in each conv.

    A null line is empty; a null conv is one of its own, apart from the empty string. marker and content make up the line;
    a marker is told apart only where the line begins a turn of the role it names. content is null for a heading that is
    nothing but a marker. An empty table gives no rows.
    """
    kind = dict(lines.dtypes)["conv"]
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.select("conv", "pos", F.coalesce("line", F.lit("")).alias("line"), F.floor(F.col("pos") / F.lit(BLOCK)).cast("long").alias("block"))

    def together(df: DataFrame) -> DataFrame:
        """Lines of a block side by side and in order; key is unique to it within its partition's order."""
        df = df.repartition(parts, "conv", "block").sortWithinPartitions("conv", "block", "pos")
        return df.withColumn("key", F.concat_ws("|", F.col("conv").isNull().cast("string"), _key("conv"), F.col("block").cast("string")))

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _blocks(it):
            scores = [block_scores(model, emissions(model, list(g["line"])), g["block"].iloc[0] == 0).ravel().tolist() for g in groups]
            yield pd.DataFrame({"conv": [g["conv"].iloc[0] for g in groups], "block": [g["block"].iloc[0] for g in groups], "scores": scores})

    def decode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _blocks(it):
            path: list[int] = []
            for g in groups:
                first, before, last = g["block"].iloc[0] == 0, g["before"].iloc[0], g["last"].iloc[0]
                path += viterbi(model, emissions(model, list(g["line"])), None if first else int(before), None if last < 0 else int(last))
            pdf = pd.concat(groups)
            roles, begins = [ROLES[p % len(ROLES)] for p in path], [p < len(ROLES) for p in path]
            found = []
            for line, role, new in zip(pdf["line"], roles, begins):
                named, marker, rest = split_marker(line)
                found.append((marker, rest) if new and named == role else ("", line))
            marks, contents = zip(*found)
            yield pd.DataFrame({"conv": pdf["conv"], "pos": pdf["pos"], "block": pdf["block"], "role_pred": roles, "begins": begins, "marker": marks, "content": contents})

    # only transcripts of more than one block have ends to agree on
    several = lines.where(F.col("pos") == BLOCK).select(F.col("conv").alias("c"))
    long_ = lines.join(several.hint("merge"), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    blocks = together(long_).mapInPandas(lean(score), f"conv {kind}, block bigint, scores array<double>")
    known = block_ends(materialize(blocks, "block-scores")).select(F.col("conv").alias("k_conv"), F.col("block").alias("k_block"), "before", "last")
    joined = lines.join(known.hint("merge"), F.col("conv").eqNullSafe(F.col("k_conv")) & (F.col("block") == F.col("k_block")), "left")
    joined = joined.select("conv", "pos", "line", "block", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("last", F.lit(-1)).alias("last"))
    return together(joined).mapInPandas(lean(decode), f"conv {kind}, pos bigint, block bigint, role_pred string, begins boolean, marker string, content string")


def render_turns(found: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``(conv, turn_no, part, role_pred, first_pos, n_lines, content, rendered)``: lines of recover_roles joined into turns.

    A turn is one row, part 0, wherever its blocks end; only one of over ``part_chars`` characters comes in parts, a line in that
    one in which it begins. Only the first part opens the turn and only the last closes it, so parts in order, joined by a line
    break, are the canonical text. Lines that are nothing but a marker are no lines of a turn.
    """
    found = materialize(found, "roles").withColumn("in_block", F.expr("sum(cast(begins as int)) over (partition by conv, block order by pos)"))
    text = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct(order, "content")))), lambda x: x["content"]), "\n")
    facts = [F.min("pos").alias("first_pos"), F.count("*").alias("n_lines"), F.max("begins").alias("opens"), F.first("role_pred").alias("role_pred"), F.count("content").alias("n_texts")]
    pieces = found.groupBy("conv", "block", "in_block").agg(*facts, text("pos").alias("content"))  # of BLOCK lines at most
    pieces = materialize(pieces, "pieces")
    # one row a block: turns before it, and whether its first and last turn lie in others, too
    blocks = pieces.groupBy("conv", "block").agg(F.sum(F.col("opens").cast("int")).alias("turns"), F.max("in_block").alias("last_piece"), F.min(F.struct("first_pos", "opens"))["opens"].alias("opens_first"))
    blocks = blocks.selectExpr("conv as b_conv", "block as b_block", "last_piece", "sum(turns) over (partition by conv order by block) - turns as turns_before", "not coalesce(lead(opens_first) over (partition by conv order by block), true) as goes_on")
    joined = pieces.join(blocks.hint("merge"), F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    spread = ~F.col("opens") | (F.col("goes_on") & (F.col("in_block") == F.col("last_piece")))
    joined = joined.withColumns({"turn_no": (F.col("turns_before") + F.col("in_block") - 1).cast("long"), "spread": spread, "size": F.length("content").cast("long")})
    names = ["conv", "turn_no", "part", "first_pos", "n_lines", "opens", "role_pred", "content", "closes"]
    small = joined.where((~F.col("spread")) & (F.col("size") <= part_chars)).withColumns({"part": F.lit(0).cast("long"), "closes": F.lit(True)}).select(*names)
    # turns over several blocks, or of many characters: few lines, placed by the characters of their turn before them
    rest = materialize(joined.where(F.col("spread") | (F.col("size") > part_chars)).select("conv", "block", "in_block", "turn_no", F.when(F.col("n_texts") > 0, F.col("size") + 1).otherwise(0).alias("n")), "spread-turns")
    rest = rest.selectExpr("conv as p_conv", "block as p_block", "in_block as p_in", "turn_no", "sum(n) over (partition by conv, turn_no order by block) - n as chars_before")
    lines = found.join(rest.hint("merge"), F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("block") == F.col("p_block")) & (F.col("in_block") == F.col("p_in")))
    size = "coalesce(length(content) + 1, 0)"
    lines = lines.selectExpr("conv", "turn_no", "pos", "begins", "role_pred", "content", f"cast((chars_before + sum({size}) over (partition by conv, block, in_block order by pos) - {size}) div {part_chars} as bigint) as part")
    parts = lines.groupBy("conv", "turn_no", "part").agg(*facts, text("pos").alias("content"))
    parts = parts.selectExpr("*", "part = max(part) over (partition by conv, turn_no) as closes").select(*names)
    out = small.unionByName(parts)
    rendered = F.concat(F.when(F.col("opens"), F.concat(F.lit("<|"), F.col("role_pred"), F.lit("|>\n"))).otherwise(""), F.col("content"), F.when(F.col("closes"), F.lit("\n<|end|>")).otherwise(""))
    return out.select("conv", "turn_no", "part", "role_pred", "first_pos", "n_lines", "content", rendered.alias("rendered"))


#: Speaker names of the transcript styles of raw_transcripts, for system, user and assistant.
STYLES = (("System: ", "User: ", "Assistant: "), ("[sys] ", "[human] ", "[bot] "), ("### Instruction\n", "### Human\n", "### AI\n"), ("System> ", "Q> ", "A> "), ("", "", ""))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """``(conv, pos, turn, role, begins, line)``: the physical lines of conversations written as raw transcripts.

    The style of a conversation follows from the CRC-32 of its id (the last style has no markers at all), and one turn in
    five, by the CRC-32 of id and turn, has lost its marker. Texts are split at their line breaks. role and begins are the
    truth, which no prediction reads. Null ids, turns, roles and texts are kept; a null id is one conversation. Lines are
    numbered by turn, nulls last, ties by text: first within runs of turns, then over the sums of the runs.
    """
    text = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary")
    style = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % len(STYLES)
    marker = F.lit("")
    for k, names in enumerate(STYLES):
        for role, name in zip(ROLES, names):
            marker = F.when((style == k) & (F.col("role") == role), F.lit(name)).otherwise(marker)
    marker = F.when(F.crc32(text) % 5 == 0, F.lit("")).otherwise(marker)
    turns = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", F.split(F.concat(marker, F.coalesce("text", F.lit(""))), "\n").alias("lines"))
    turns = materialize(turns.withColumn("run", F.expr("turn div 64")), "turns")
    sizes = turns.groupBy("conv", "run").agg(F.sum(F.size("lines")).alias("n"))
    sizes = sizes.selectExpr("conv as r_conv", "run as r_run", "sum(n) over (partition by conv order by run nulls last) - n as lines_before")
    joined = turns.join(sizes.hint("merge"), F.col("conv").eqNullSafe(F.col("r_conv")) & F.col("run").eqNullSafe(F.col("r_run")))
    placed = joined.selectExpr("conv", "turn", "role", "lines", "lines_before + sum(size(lines)) over (partition by conv, run order by turn nulls last, lines, role rows unbounded preceding) - size(lines) as at")
    return placed.select("conv", "turn", "role", "at", F.posexplode("lines").alias("k", "line")).select("conv", (F.col("at") + F.col("k")).alias("pos"), "turn", "role", (F.col("k") == 0).alias("begins"), "line")


def is_held_out(conv: str = "conv") -> Column:
    """Conversations never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(conv).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chat_report(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn_no, part, role_pred, first_pos, n_lines, rendered, held_out)`` of every recovered turn.

    The model learns from conversations whose id's CRC-32, modulo 4, is not 2.
    """
    lines = materialize(raw_transcripts(conversations), "transcript")
    found = recover_roles(lines.select("conv", "pos", "line"), fit(lines.where(~is_held_out())))
    out = render_turns(found)
    return out.select(F.col("conv").alias("conv_id"), "turn_no", "part", "role_pred", "first_pos", "n_lines", "rendered", is_held_out().alias("held_out"))
