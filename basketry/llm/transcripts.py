"""Chat transcripts: a hidden Markov model over speaker markers and line features recovers roles, and turns are
rendered in one canonical form.

A state is a role with whether the line begins a turn. Transition and emission counts come from labelled turns, by
aggregation over all of them. Long conversations are decoded in blocks: a block gives the best score from each state
before it to each state at its end, the blocks' scores are chained per conversation, and every block is decoded
between the states that the chain chose, which is the exact Viterbi path of the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import stage

ROLES = ("system", "user", "assistant")
#: State 2 * role + 1 if the line goes on with a turn, so an even state begins one.
STATES = 2 * len(ROLES)
#: Pieces of a transcript (by their number) that are decoded together.
BLOCK = 64
#: Parameters: speaker markers by role.
MARKERS = {
    "system": r"^\s*(?:\*\*|\[|<\|?)?(?:system|instructions?|context)(?:\*\*|\]|\|?>)?\s*[:>]",
    "user": r"^\s*(?:\*\*|\[|<\|?)?(?:user|human|customer|q|question|me|you)(?:\*\*|\]|\|?>)?\s*[:>]",
    "assistant": r"^\s*(?:\*\*|\[|<\|?)?(?:assistant|ai|bot|agent|model|a|answer)(?:\*\*|\]|\|?>)?\s*[:>]",
}
_MARKER = re.compile("|".join(MARKERS.values()))
FEATURES = {"marker": len(ROLES) + 1, "length": 6, "question": 2, "gap": 2}


def lines_of(pieces: DataFrame) -> DataFrame:
    """Lines with a character that is no white space, with their features. ``pieces``: (conv_id, seq, text) and more."""
    others = [c for c in pieces.columns if c not in ("conv_id", "seq", "text")]
    raw = pieces.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("seq").cast("long"), F.lit(-1).cast("long")).alias("seq"), *others,
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"), F.split(F.coalesce("text", F.lit("")), "\n").alias("all"),
    ).where(r"line rlike '\\S'")
    low = F.lower("line")
    marker = F.when(F.lit(False), F.lit(0))
    for k, role in enumerate(ROLES):
        marker = marker.when(low.rlike(MARKERS[role]), F.lit(k + 1))
    size = F.length("line")
    length = sum((F.when(size > n, 1).otherwise(0) for n in (20, 60, 160, 400, 1000)), F.lit(0))
    # a blank line before it within its piece; where pieces begin tells nothing
    blank = F.when((F.col("line_no") > 0) & ~F.get("all", F.col("line_no") - 1).rlike(r"\S"), F.lit(1)).otherwise(F.lit(0))
    return raw.select(
        "conv_id", F.floor(F.col("seq") / BLOCK).cast("long").alias("block"), "seq", "line_no", "line", *others,
        marker.otherwise(F.lit(0)).alias("marker"), length.cast("int").alias("length"), F.col("line").rlike(r"\?\s*$").cast("int").alias("question"), blank.cast("int").alias("gap"),
    )


def fit(labelled: DataFrame) -> dict:
    """Log probabilities from ``labelled`` pieces (conv_id, seq, role, text), each piece a turn; add-one smoothing.

    What comes to the driver are counts by state and feature value, a fixed number of rows. Rows with another role are
    left out, as are wordless turns.
    """
    lines = lines_of(labelled.select("conv_id", "seq", "role", "text")).where(F.col("role").isin(*ROLES))
    order = Window.partitionBy("conv_id").orderBy("seq", "line_no", "line")
    role = sum((F.when(F.col("role") == r, F.lit(k)).otherwise(0) for k, r in enumerate(ROLES)), F.lit(0))
    state = 2 * role + F.when(F.lag("seq").over(order) == F.col("seq"), 1).otherwise(0)
    stated = lines.withColumn("state", state).withColumn("before", F.lag("state").over(order))
    names = list(FEATURES)
    counts = stated.groupBy("state", F.coalesce("before", F.lit(-1)).alias("before"), *names).count().collect()
    moves = np.ones((STATES + 1, STATES))
    seen = {n: np.ones((STATES, FEATURES[n])) for n in names}
    for r in counts:
        moves[r.before, r.state] += r["count"]  # the last row is the start
        for n in names:
            seen[n][r.state, r[n]] += r["count"]
    return {
        "moves": np.log(moves / moves.sum(axis=1, keepdims=True)).tolist(),
        **{n: np.log(t / t.sum(axis=1, keepdims=True)).tolist() for n, t in seen.items()},
    }


class _Model:
    def __init__(self, fitted: dict):
        table = {k: np.array(v) for k, v in fitted.items()}
        self.start, self.moves = table["moves"][-1], table["moves"][:-1]
        self.seen = [table[n] for n in FEATURES]

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return sum(t[:, features[:, k]] for k, t in enumerate(self.seen)).T

    def through(self, emitted: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Best scores at the last line from each row of ``first`` (scores before the first emission), and back pointers."""
        score, back = first + emitted[0], []
        for e in emitted[1:]:
            ways = score[:, :, None] + self.moves[None]
            at = ways.argmax(axis=1)
            back.append(at)
            score = np.take_along_axis(ways, at[:, None, :], axis=1)[:, 0] + e
        return score, back


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal (conv_id, block); rows come sorted."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["conv_id"], row["block"])
            if held and own != key:
                yield key, held
                held = []
            key = own
            held.append(row)
    if held:
        yield key, held


def _scores(fitted: dict):
    """(conv_id, block, scores): best scores from each state before the block, and from the start, to each at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Model(fitted)
        firsts = np.vstack((model.moves, model.start))
        out = []
        for key, rows in _groups(batches):
            emitted = model.emissions(np.array([[r[n] for n in FEATURES] for r in rows]))
            out.append((*key, model.through(emitted, firsts)[0].ravel().tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["conv_id", "block", "scores"]
        )

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, block, enter, leave): states of the best path before each block (-1: start) and at its end."""
    out = []

    def close(rows: list[dict]) -> None:
        tables = [np.array(r["scores"]).reshape(STATES + 1, STATES) for r in rows]
        score, back = tables[0][-1], []
        for t in tables[1:]:
            ways = score[:, None] + t[:-1]
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        state = int(score.argmax())
        for k in range(len(rows) - 1, -1, -1):
            enter = int(back[k - 1][state]) if k else -1
            out.append((rows[k]["conv_id"], rows[k]["block"], enter, state))
            state = enter

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != held[0]["conv_id"]:
                close(held)
                held = []
            held.append(row)
    if held:
        close(held)
    columns = list(zip(*out, strict=True)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["conv_id", "block", "enter", "leave"])


def _decoded(fitted: dict):
    """Turns: (conv_id, seq, line_no, role, text, n_lines, continued)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Model(fitted)
        out = []
        for _, rows in _groups(batches):
            emitted = model.emissions(np.array([[r[n] for n in FEATURES] for r in rows]))
            enter = rows[0]["enter"]
            _, back = model.through(emitted, (model.start if enter < 0 else model.moves[enter])[None])
            state, path = rows[0]["leave"], []
            for at in reversed(back):
                path.append(state)
                state = int(at[0, state])
            path.append(state)
            turn: list = []
            for row, state in zip(rows, reversed(path), strict=True):
                line = row["line"]
                if state % 2 == 0 or not turn or turn[3] != ROLES[state // 2]:
                    turn = [row["conv_id"], row["seq"], row["line_no"], ROLES[state // 2], [], state % 2 == 1]
                    out.append(turn)
                    if row["marker"] and (named := _MARKER.match(line.lower())):
                        line = line[named.end() :]
                turn[4].append(line.strip())
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t[k] for t in out], kinds[k]) for k in range(4)]
            + [pa.array(["\n".join(t[4]).strip() for t in out], pa.string()), pa.array([len(t[4]) for t in out], pa.int64()), pa.array([t[5] for t in out])],
            ["conv_id", "seq", "line_no", "role", "text", "n_lines", "continued"],
        )

    return run


def parse(pieces: DataFrame, fitted: dict) -> DataFrame:
    """One row per recovered turn: conv_id, seq, line_no (of its first line), role, text, n_lines, continued, rendered.

    ``pieces`` (conv_id, seq, text) are raw stretches of transcripts, in order of seq; one may hold many turns or part
    of one; a turn that goes on in other pieces or blocks is one row. Lines of white space only separate. ``continued``
    marks a conversation that begins in the middle of a turn. Null and empty texts have no lines and give no turns; a null seq comes first, a null conv_id is a
    conversation of its own; equal seqs (repeated rows) follow each other in order of their lines. Other columns are
    ignored.
    """
    keys = ["conv_id", "block"]
    lines = stage(lines_of(pieces.select("conv_id", "seq", "text")), "lines")
    sorted_lines = lines.repartition(*keys).sortWithinPartitions(*keys, "seq", "line_no", "line")
    scores = sorted_lines.mapInArrow(_scores(fitted), "conv_id long, block long, scores array<double>")
    chained = scores.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chained, "conv_id long, block long, enter long, leave long")
    chained = stage(chained, "chained").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "enter", "leave")
    placed = lines.join(chained, lines.conv_id.eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    turns = (
        placed.repartition(*keys)
        .sortWithinPartitions(*keys, "seq", "line_no", "line")
        .mapInArrow(_decoded(fitted), "conv_id long, seq long, line_no int, role string, text string, n_lines long, continued boolean")
    )
    turns = _merged(turns)
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))


def _merged(turns: DataFrame) -> DataFrame:
    """Stretches that go on with a turn across a block's border become part of it; only the first of a block can.

    Places are compared within a conversation, and texts of stretches that stand alone are not gathered.
    """
    order = Window.partitionBy("conv_id").orderBy("seq", "line_no", "text")
    numbered = stage(turns, "stretches").withColumn("turn", F.sum((~F.col("continued")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    follows = F.coalesce(F.lead("turn").over(order) == F.col("turn"), F.lit(False)) | F.coalesce(F.lag("turn").over(order) == F.col("turn"), F.lit(False))
    marked = stage(numbered.withColumn("parted", follows), "stretches")
    names = ["conv_id", "seq", "line_no", "role", "text", "n_lines", "continued"]
    parts = F.array_sort(F.collect_list(F.struct("seq", "line_no", "text", "role", "n_lines", "continued")))
    joined = marked.where("parted").groupBy("conv_id", "turn").agg(parts.alias("p")).select(
        "conv_id", F.col("p")[0]["seq"].alias("seq"), F.col("p")[0]["line_no"].alias("line_no"), F.col("p")[0]["role"].alias("role"),
        F.array_join(F.col("p")["text"], "\n").alias("text"), F.aggregate(F.col("p")["n_lines"], F.lit(0).cast("long"), lambda a, x: a + x).alias("n_lines"), F.col("p")[0]["continued"].alias("continued"),
    )
    return marked.where("NOT parted").select(*names).union(joined.select(*names))


#: Ways in which logs name user, assistant and system; a style without names has none.
STYLES = [("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "Instructions: "), ("Q: ", "A: ", "Context: "), ("**User**: ", "**Assistant**: ", "**System**: "), ("[user]: ", "[bot]: ", "[system]: ")]


def marked_turns(conversations: DataFrame, unmarked: int = 4) -> DataFrame:
    """(conv_id, seq, role, text): turns in the style of their conversation; one in ``unmarked`` has no marker."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    names = F.array(*[F.struct(*[F.lit(n).alias(r) for r, n in zip(("user", "assistant", "system"), s, strict=True)]) for s in STYLES])
    own = F.get(names, style.cast("int"))
    marked = F.pmod(F.xxhash64("conv_id", "turn", F.lit("marker")), F.lit(unmarked)) > 0
    prefix = F.when(marked & F.col("role").isin(*ROLES), F.when(F.col("role") == "user", own["user"]).when(F.col("role") == "system", own["system"]).otherwise(own["assistant"])).otherwise("")
    return conversations.select("conv_id", F.col("turn").alias("seq"), "role", F.concat(prefix, F.coalesce("text", F.lit(""))).alias("text"))


def raw_transcripts(conversations: DataFrame, unmarked: int = 4, lines: int = 5) -> DataFrame:
    """(conv_id, seq, text): conversations as plain logs in pieces of ``lines`` lines, wherever turns begin."""
    turns = marked_turns(conversations, unmarked)
    every = turns.select("conv_id", "seq", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "line_no", "line")) - 1
    placed = every.withColumn("place", place).withColumn("piece", F.floor(F.col("place") / lines))
    ordered = F.array_sort(F.collect_list(F.struct("place", "line")))
    return placed.groupBy("conv_id", "piece").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text")).select("conv_id", F.col("piece").alias("seq"), "text")
