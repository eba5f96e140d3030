"""Rebuilding conversations from message rows by keyed streaming state.

Messages stream in by arrival. The state of a key, which is a block of positions of a room, buffers what
has arrived, late rows included, until the watermark on the time of arrival passes what may still come
for it. Then the block is closed and emits, once, what it holds: the conversations inside it validated,
and the two parts at its edges, which go on in the blocks beside it. Parts are joined to whole
conversations afterwards, so that no room, however large, is held in one place.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernlake.llm.forms import visible
from quernlake.operators.ordered import last_before
from quernlake.session import scratch_dir, table

#: Positions of a room in one key of the state, as a power of two.
BLOCK_BITS = 10
#: Positions whose edges of blocks meet in one task, as a power of two.
EDGE_BITS = 20
GAP_MINUTES = 30
#: How much later than others a row may arrive. A closed block keeps a mark for so many times that long.
LATENESS, MARKED = "31 days", 12

_NONE = np.iinfo(np.int64).max
_NOBODY = np.iinfo(np.int64).min
_COLUMNS = ["id", "seq", "sent_us", "sender", "usable", "known", "role", "text"]
_FLAGS = ("gap", "backwards", "mixed", "foreign_")
_OUT = (
    "kind string, room_id int, block bigint, part int, n_parts int, start_seq int, end_seq int, first_us bigint, last_us bigint, "
    "gap boolean, backwards boolean, mixed boolean, foreign_ boolean, n_usable int, low_sender bigint, high_sender bigint, "
    "seq int, sent_us bigint, sender_id bigint, role string, text string"
)
_TYPES = dict(c.split() for c in _OUT.split(", "))
_PANDAS = {"int": "Int32", "bigint": "Int64", "boolean": "boolean", "string": object}


def _close(held: list[dict], gap_us: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(parts, turns) of a block: arrays by name; `part` of a turn is the index of its part."""
    rows = {c: np.concatenate([h[c] for h in held]) for c in _COLUMNS}
    order = np.lexsort((rows["id"], rows["seq"]))
    rows = {c: v[order] for c, v in rows.items()}
    at = np.r_[0, np.flatnonzero(np.diff(rows["seq"])) + 1]
    seq, n = rows["seq"][at], len(at)
    sent = np.minimum.reduceat(rows["sent_us"], at)
    mixed = np.minimum.reduceat(rows["sender"], at) != np.maximum.reduceat(rows["sender"], at)
    foreign = np.logical_or.reduceat(rows["usable"] & ~rows["known"], at)
    said = rows["usable"] & (rows["sender"] != _NOBODY)
    low = np.minimum.reduceat(np.where(said, rows["sender"], _NONE), at)
    high = np.maximum.reduceat(np.where(said, rows["sender"], _NOBODY), at)
    first_row = np.minimum.reduceat(np.where(rows["usable"], np.arange(len(order)), _NONE), at)
    # The last time that is known before each position.
    timed = sent != _NONE
    upto = np.maximum.accumulate(np.where(timed, np.arange(n), -1))
    before = np.r_[-1, upto[:-1]]
    follows = timed & (before >= 0)
    step = np.where(follows, sent - sent[before], 0)
    starts = follows & (step > gap_us)
    starts[0] = True
    begin = np.flatnonzero(starts)
    inside = ~starts
    end = np.r_[begin[1:] - 1, n - 1]
    of = lambda f, v: f.reduceat(v, begin)
    parts = {
        "start_seq": seq[begin], "end_seq": seq[end], "first_us": of(np.minimum, np.where(timed, np.arange(n), n)), "last_us": upto[end],
        "gap": of(np.logical_or, inside & (seq != np.r_[seq[0], seq[:-1] + 1])), "backwards": of(np.logical_or, inside & (step < 0)), "mixed": of(np.logical_or, mixed),
        "foreign_": of(np.logical_or, foreign), "n_usable": of(np.add, (first_row != _NONE).astype(int)), "low_sender": of(np.minimum, low), "high_sender": of(np.maximum, high),
    }
    # The first and last known time of a part, if it has one.
    times = np.r_[sent, _NONE]
    parts["first_us"] = np.where(parts["first_us"] <= end, times[np.minimum(parts["first_us"], n)], _NONE)
    parts["last_us"] = np.where(parts["last_us"] >= begin, times[parts["last_us"]], _NONE)
    has = first_row != _NONE
    turn = {c: rows[c][first_row[has]] for c in ("sender", "role", "text")}
    turns = {"part": (np.cumsum(starts) - 1)[has], "seq": seq[has], "sent_us": sent[has], **turn}
    return parts, turns


def _frame(columns: dict[str, np.ndarray], key: tuple, kind: np.ndarray) -> pd.DataFrame:
    """A frame of the output's columns; what isn't given, and what stands for nothing, is null."""
    out = pd.DataFrame(index=range(len(kind)))
    given = columns | {"kind": kind, "room_id": np.full(len(kind), key[1]), "block": np.full(len(kind), key[2])}
    for c, t in _TYPES.items():
        v = given.get(c)
        if v is None:
            out[c] = pd.Series([None] * len(kind), dtype=_PANDAS[t])
        elif t == "bigint":
            out[c] = pd.Series(v, dtype="Int64").mask((v == _NONE) | (v == _NOBODY))
        else:
            out[c] = pd.Series(v, dtype=_PANDAS[t])
    return out


def _stateful(gap_us: int, turns: bool, lateness_ms: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0]:  # a beat only moves the watermark
            return
        newest, held = pickle.loads(state.get[0]) if state.exists else (0, [])
        if state.hasTimedOut:
            if held is None:
                state.remove()
                return
            parts, said = _close(held, gap_us)
            state.update((pickle.dumps((newest, None)),))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + MARKED * lateness_ms)
            n = len(parts["start_seq"])
            edge = np.isin(np.arange(n), (0, n - 1))
            one = parts["low_sender"] == parts["high_sender"]
            fine = ~np.logical_or.reduce([parts[f] for f in _FLAGS]) & (parts["n_usable"] > 0) & ~one & (parts["low_sender"] != _NONE)
            yield _frame(parts | {"part": np.arange(n), "n_parts": np.full(n, n)}, key, np.where(edge, "edge", "conversation"))
            if turns:
                # Of what is inside only valid conversations go out; of the edges it isn't known yet.
                kept = (edge | fine)[said["part"]]
                said = {c: v[kept] for c, v in said.items()}
                said |= {"start_seq": parts["start_seq"][said["part"]], "sender_id": said.pop("sender"), "n_parts": np.full(kept.sum(), n)}
                yield _frame(said, key, np.where(edge[said["part"]], "edge turn", "turn"))
            return
        fresh = [{c: b[c].to_numpy() for c in _COLUMNS} | {"arrived": int(b["arrived_ms"].max())} for b in batches if len(b)]
        if held is None:  # closed: the row is later than it may be
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + MARKED * lateness_ms)
            return
        newest = max([newest, *(f.pop("arrived") for f in fresh)])
        state.update((pickle.dumps((newest, held + fresh)),))
        state.setTimeoutTimestamp(max(newest + lateness_ms, state.getCurrentWatermarkMs() + 1))

    return update


def closed_blocks(messages: DataFrame, members: DataFrame, turns: bool, gap_minutes: int = GAP_MINUTES, lateness: str = LATENESS) -> DataFrame:
    """The streaming operator: what each block of a room holds, when it closes.

    messages is a streaming DataFrame with id, room_id, seq, sent_at, sender_id, msg_type, text,
    loaded_at (a missing one counts as the first); members: room_id, id, speaker_role. Rows without seq
    belong nowhere; a row without room_id is a beat, which moves the watermark by its loaded_at. Rows
    that arrive more than `lateness` after others are too late and left out, as the watermark says.
    """
    usable = F.col("msg_type").isin("text", "link") & F.coalesce(visible(F.col("text")), F.lit(False))
    rows = messages.select(
        F.col("room_id").isNull().alias("beat"), F.coalesce("id", F.lit(0)).cast("bigint").alias("id"), F.coalesce("room_id", F.lit(0)).alias("room_id"), F.col("seq").cast("bigint").alias("seq"),
        F.coalesce("sender_id", F.lit(None)).alias("sender_id"), F.coalesce("loaded_at", F.timestamp_micros(F.lit(0))).alias("loaded_at"),
        F.coalesce(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', sent_at)"), F.lit(_NONE)).alias("sent_us"),
        F.coalesce(usable, F.lit(False)).alias("usable"), F.when(usable, F.col("text")).alias("text") if turns else F.lit(None).cast("string").alias("text"),
        # Rows without a sender are spread: they match no member.
        F.coalesce("sender_id", -1 - F.pmod("id", F.lit(1024)).cast("int")).alias("who"),
    ).filter("seq is not null")
    known = members.filter("room_id is not null and id >= 0").groupBy("room_id", F.col("id").alias("who")).agg(F.max("speaker_role").alias("role")).withColumn("known", F.lit(True))
    keyed = rows.withWatermark("loaded_at", lateness).join(known, ["room_id", "who"], "left").select(
        "beat", "room_id", F.shiftright("seq", BLOCK_BITS).alias("block"), "id", "seq", "sent_us", F.coalesce(F.col("sender_id").cast("bigint"), F.lit(_NOBODY)).alias("sender"),
        "usable", F.coalesce("known", F.lit(False)).alias("known"), "role", "text", "loaded_at", F.unix_millis("loaded_at").alias("arrived_ms"),
    )
    lateness_ms = int(pd.Timedelta(lateness).total_seconds() * 1000)
    return keyed.groupBy("beat", "room_id", "block").applyInPandasWithState(
        _stateful(gap_minutes * 60_000_000, turns, lateness_ms), _OUT, "held binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def conversations(closed: DataFrame, gap_minutes: int = GAP_MINUTES) -> tuple[DataFrame, DataFrame]:
    """(conversations, parts): those inside blocks and those joined from edges, and of each edge's part
    the conversation.

    conversations: room_id, start_seq, end_seq, n_usable, broken, empty, unanswered. parts: room_id,
    block, part, conv_seq. Edges meet by stretches of 2**EDGE_BITS positions, of which one row each
    meets the others of its room.
    """
    shape = ["room_id", "start_seq", "end_seq", "n_usable", *_FLAGS, "low_sender", "high_sender"]
    edges = last_before(closed.filter("kind = 'edge'"), ["room_id"], "start_seq", ["last_us", "block", "end_seq"], EDGE_BITS)
    far = F.coalesce(F.col("first_us") - F.col("last_us_before") > gap_minutes * 60_000_000, F.lit(False))
    edges = edges.withColumn("apart", F.col("block_before").isNull() | (F.col("block_before") == F.col("block")) | far)
    edges = edges.withColumn("gap", F.col("gap") | (~F.col("apart") & (F.col("end_seq_before") + 1 != F.col("start_seq"))))
    edges = edges.withColumn("backwards", F.col("backwards") | (~F.col("apart") & F.coalesce(F.col("first_us") < F.col("last_us_before"), F.lit(False))))
    edges = last_before(edges.withColumn("first_seq", F.when(F.col("apart"), F.col("start_seq"))), ["room_id"], "start_seq", ["first_seq"], EDGE_BITS)
    edges = edges.withColumn("conv", F.coalesce("first_seq", "first_seq_before"))
    joined = edges.groupBy("room_id", "conv").agg(
        F.min("start_seq").alias("start_seq"), F.max("end_seq").alias("end_seq"), F.sum("n_usable").cast("int").alias("n_usable"),
        *(F.bool_or(f).alias(f) for f in _FLAGS), F.min("low_sender").alias("low_sender"), F.max("high_sender").alias("high_sender"),
    )
    broken = F.col("gap") | F.col("backwards") | F.col("mixed") | F.col("foreign_")
    whole = closed.filter("kind = 'conversation'").select(shape).unionByName(joined.select(shape)).select(
        "room_id", "start_seq", "end_seq", "n_usable", broken.alias("broken"), (F.col("n_usable") == 0).alias("empty"),
        ((F.col("n_usable") > 0) & F.coalesce(F.col("low_sender") == F.col("high_sender"), F.lit(True))).alias("unanswered"),
    )
    return whole, edges.select("room_id", "block", "part", F.col("conv").alias("conv_seq"))


def run_stream(spark: SparkSession, messages_path: str, beats_path: str, folder: str, members: DataFrame, turns: bool, **options: str) -> None:
    """Take what is new in the two paths into the state kept in folder, and write what closes."""
    schema = spark.read.parquet(messages_path).schema
    # As a pattern, the path may be a folder of files or one file.
    stream = spark.readStream.schema(schema).options(**options).parquet(f"{messages_path[:-1]}[{messages_path[-1]}]").filter("room_id is not null")
    beats = spark.readStream.schema(schema).parquet(beats_path)
    query = (
        closed_blocks(stream.unionByName(beats), members, turns)
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def emit(spark: SparkSession, messages_path: str, members: DataFrame, turns: bool, **options: str) -> DataFrame:
    """Run the stream over what is there, then let a beat of the end of time close what is open."""
    folder = f"{scratch_dir(spark)}/conversations-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    schema = spark.read.parquet(messages_path).schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/beats")
    run_stream(spark, messages_path, f"{folder}/beats", folder, members, turns, **options)
    last = {"seq": F.lit(0), "loaded_at": F.lit("2200-01-01 00:00:00")}
    beat = spark.range(1).select(*(last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    beat.write.mode("append").parquet(f"{folder}/beats")
    run_stream(spark, messages_path, f"{folder}/beats", folder, members, turns, **options)
    return spark.read.schema(_OUT).parquet(f"{folder}/out")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, _ = conversations(emit(spark, f"{sf_dir}/messages.parquet", table(spark, sf_dir, "members"), False))
    return whole.filter("broken or empty or unanswered").select("room_id", "start_seq")


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per turn of the valid conversations, in order of seq."""
    closed = emit(spark, f"{sf_dir}/messages.parquet", table(spark, sf_dir, "members"), True)
    whole, parts = conversations(closed)
    valid = whole.filter("not broken and not empty and not unanswered").select("room_id", F.col("start_seq").alias("conv_seq"))
    at_edges = closed.filter("kind = 'edge turn'").join(parts, ["room_id", "block", "part"]).join(valid, ["room_id", "conv_seq"], "left_semi")
    turns = closed.filter("kind = 'turn'").withColumn("conv_seq", F.col("start_seq")).unionByName(at_edges.select("conv_seq", *_TYPES))
    sent_at = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, sent_us / 1000000d)")
    return turns.select("room_id", F.col("conv_seq").alias("start_seq"), "seq", sent_at.alias("sent_at"), F.col("sender_id").cast("int").alias("sender_id"), "role", "text")


QUERIES = {"p3_found": p3_found, "p3_conversations": p3_conversations}
_POSITIONS = """
WITH msg AS (
  SELECT m.room_id, m.seq, m.sent_at, m.sender_id, m.id, m.text,
    m.msg_type IN ('text', 'link') AND coalesce(regexp_matches(m.text, '[^\\s\\p{Z}\\p{C}\\x{034F}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{2800}\\x{3164}\\x{FFA0}\\x{FE00}-\\x{FE0F}]'), false) AS usable,
    k.id IS NOT NULL AS known, k.role
  FROM messages m LEFT JOIN (SELECT room_id, id, max(speaker_role) AS role FROM members GROUP BY ALL) k ON k.room_id = m.room_id AND k.id = m.sender_id),
pos AS (
  SELECT room_id, seq, min(sent_at) AS sent_at, count(DISTINCT coalesce(sender_id, -1)) > 1 AS mixed, bool_or(usable) AS usable,
    bool_or(usable AND NOT known) AS foreign_, min(sender_id) FILTER (usable) AS lo, max(sender_id) FILTER (usable) AS hi,
    arg_min(sender_id, id) FILTER (usable) AS sender_id, arg_min(text, id) FILTER (usable) AS text, arg_min(role, id) FILTER (usable) AS role
  FROM msg GROUP BY ALL),
cut AS (
  SELECT *, lag(sent_at) OVER w AS before, lag(seq) OVER w AS seq_before FROM pos WINDOW w AS (PARTITION BY room_id ORDER BY seq)),
num AS (
  SELECT *, coalesce(sent_at - before > INTERVAL 30 MINUTE, true) AS apart FROM cut),
conv AS (
  SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY room_id ORDER BY seq) AS k FROM num),
whole AS (
  SELECT room_id, k, min(seq) AS start_seq,
    bool_or(mixed) OR bool_or(foreign_) OR bool_or(NOT apart AND (seq <> seq_before + 1 OR sent_at < before)) AS broken,
    NOT bool_or(usable) AS empty, min(lo) = max(hi) AS unanswered
  FROM conv GROUP BY ALL)"""
SQL = {
    "p3_found": f"{_POSITIONS} SELECT room_id, start_seq FROM whole WHERE broken OR empty OR unanswered",
    "p3_conversations": f"""{_POSITIONS}
SELECT c.room_id, w.start_seq, c.seq, c.sent_at, c.sender_id, c.role, c.text FROM conv c JOIN whole w USING (room_id, k)
WHERE c.usable AND NOT (w.broken OR w.empty OR coalesce(w.unanswered, false))""",
}
