"""Splitting oversized items at natural boundaries, into balanced pieces with an overlap.

The least number of pieces gives equally long targets; each cut snaps to the strongest boundary near
its target; where any piece would break the limit, there is one piece more.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.session import bounded_rows, table

#: Strengths of boundaries: message, paragraph, line, sentence, word.
MESSAGE, PARAGRAPH, LINE, SENTENCE, WORD = 5, 4, 3, 2, 1
_BOUNDARIES = (
    (PARAGRAPH, regex.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")),
    (LINE, regex.compile(r"(?:\r\n|\r|\n)\s*")),
    (SENTENCE, regex.compile(r"[.!?…。！？．]+[\"'”’)\]]*\s+")),
    (WORD, regex.compile(r"\s+")),
)
_SPAN_BITS = 8


def boundaries(text: str, messages: list[int]) -> tuple[list[int], list[int]]:
    """Offsets after which a piece may end, in order, and their strengths."""
    found: dict[int, int] = {}
    for strength, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            found.setdefault(m.end(), strength)
    for at in messages:
        found[at] = MESSAGE
    found.pop(0, None)
    found.pop(len(text), None)
    at = sorted(found)
    return at, [found[a] for a in at]


def _whole_character(text: str, at: int, low: int) -> int:
    """The last offset up to `at`, over `low`, that parts no character from its combining marks."""
    k = at
    while k > low + 1 and k < len(text) and (unicodedata.combining(text[k]) or text[k] in "‍️" or text[k - 1] == "‍"):
        k -= 1
    return k if k > low + 1 else at


def _attempt(text: str, pieces: int, limit: int, overlap: int, by_message: bool, messages: list[int], at: list[int], strength: list[int]) -> list[tuple[int, int]] | None:
    # What a piece repeats isn't new; the first one's start counts as if it were repeated.
    n, spans, start, done = len(text), [], 0, 0 if by_message else overlap
    for left in range(pieces, 0, -1):
        if left == 1:
            return [*spans, (start, n)] if n - start <= limit else None
        fresh = (n - done) / left
        target, most = done + fresh, min(start + limit, n - 1)
        low, high = max(done + 1, int(target - fresh * 0.4)), min(most, int(target + fresh * 0.4))
        near = range(bisect.bisect_left(at, low), bisect.bisect_right(at, high))
        if near:
            end = at[max(near, key=lambda k: (strength[k], -abs(at[k] - target)))]
        else:
            end = _whole_character(text, min(most, max(int(target), done + 1)), done)
        spans.append((start, end))
        if by_message:
            k = bisect.bisect_left(messages, end)
            # The messages carried over leave at least half the limit for what is new.
            starts = [s for s in messages[max(0, k - overlap):k] if s > start and end - s <= limit // 2]
            start = min(starts, default=end)
        else:
            start = max(end - overlap, start + 1)
        done = end
    return None


def split_text(text: str, limit: int, overlap: int = 0, by_message: bool = False, messages: list[int] = ()) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces of a text, each of at most `limit` code points.

    Consecutive pieces share `overlap` code points, or by_message the last `overlap` messages (those
    that fit into half a piece); messages are the offsets where messages start. The pieces cover the
    whole text. An empty text and one within the limit are one piece; an overlap of half the limit or
    more counts as just under half. Without any boundary a piece ends between characters.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    limit = max(1, limit)
    if not by_message:
        overlap = max(0, min(overlap, (limit - 1) // 2))
    messages = sorted(set(messages))
    at, strength = boundaries(text, messages)
    step = limit - (0 if by_message else overlap)
    pieces = max(2, -(-(n - (limit - step)) // step))
    tries = 0
    while pieces <= n:
        spans = _attempt(text, pieces, limit, overlap, by_message, messages, at, strength)
        if spans:
            return spans
        # One more at a time, so that it is the least number; in larger and larger steps only where that many more failed.
        tries += 1
        pieces += 1 if tries < 64 else 2 ** (tries // 64)
    spans = [(k, min(n, k + limit)) for k in range(0, n, step)]
    return [x for x in spans if x == spans[0] or x[1] - x[0] > limit - step]


def _same_length(text: str) -> str:
    """A text folded character by character, so that offsets stay."""
    out = []
    for ch in text:
        folded = unicodedata.normalize("NFKC", ch).casefold()
        out.append(folded if len(folded) == 1 else ch)
    return "".join(out)


def message_offsets(text: str, names: list[str]) -> list[int]:
    """Where the `name: text` messages of a chunk start."""
    names = sorted({_same_length(unicodedata.normalize("NFC", x)) for x in names if x and x.strip()}, key=len, reverse=True)
    if not names:
        return []
    spaced = [regex.sub(r"\\ |\s+", lambda m: r"\s+", regex.escape(x, literal_spaces=False)) for x in names]
    pattern = regex.compile(r"(?:^|(?<=\s))(?:" + "|".join(spaced) + r")\s*:", regex.M)
    folded = _same_length(text)
    head = regex.match(r"\s*\[[^\n]*", folded)
    found = [m.start() for m in pattern.finditer(folded)]
    lines = [m for m in found if m == 0 or folded[m - 1] in "\n\r"]
    # Where the lines are gone, any name with a colon starts a message.
    return lines if lines and (head is None or len(lines) * 2 >= len(found)) else found


def _seqs(entries: list[str], seqs: list[int], texts: list[str]) -> list[int | None]:
    """The seq of each entry: in turn where the numbers agree, else by text, else that of its neighbour."""
    if len(entries) == len(seqs):
        return list(seqs)
    bare = [regex.sub(r"\W+", "", _same_length(t or "")) for t in texts]
    out: list[int | None] = []
    k = 0
    for entry in entries:
        e = regex.sub(r"\W+", "", _same_length(entry))
        hit = next((j for j in range(k, len(bare)) if e.endswith(bare[j]) and bare[j]), None)
        out.append(None if hit is None else seqs[hit])
        k = k if hit is None else hit + 1
    last = None
    for i, s in enumerate(out):
        last = out[i] = last if s is None else s
    nxt = None
    for i in range(len(out) - 1, -1, -1):
        nxt = out[i] = nxt if out[i] is None else out[i]
    return out


_PIECES = "table_name string, row_id string, chunk_index int, n_pieces int, text string, start_at int, end_at int, start_seq int, end_seq int"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _PIECES.split(", ")]
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            by_message = r.overlap_unit == "messages"
            at = message_offsets(r.text, list(r.names) if r.names is not None else []) if by_message else []
            seqs: list[int | None] = []
            if at:
                known = r.known_seqs if r.known_seqs is not None else []
                ends = [*at[1:], len(r.text)]
                seqs = _seqs([r.text[a:e] for a, e in zip(at, ends, strict=True)], [k["seq"] for k in known], [k["text"] for k in known])
            first = None if pd.isna(r.first_seq) else int(r.first_seq)
            last = None if pd.isna(r.last_seq) else int(r.last_seq)
            spans = split_text(r.text, int(r.max_chars), int(r.overlap_size or 0), by_message, at)
            for k, (s, e) in enumerate(spans):
                lo, hi = max(0, bisect.bisect_right(at, s) - 1), max(0, bisect.bisect_left(at, e) - 1)
                rows.append((r.table_name, r.row_id, k, len(spans), r.text[s:e], s, e, (seqs[lo] if seqs and seqs[lo] is not None else first), (seqs[hi] if seqs and seqs[hi] is not None else last)))
        out = pd.DataFrame(rows, columns=columns)
        for c in ("start_seq", "end_seq"):
            out[c] = out[c].astype("Int32")
        yield out


def oversized(items: DataFrame) -> DataFrame:
    """The items longer than their limit, in code points: decided in the JVM, before any Python."""
    return items.filter(F.char_length("text") > F.col("max_chars"))


def split_items(items: DataFrame) -> DataFrame:
    """The pieces of the items over their limit.

    items: table_name, row_id, text, max_chars, overlap_size, overlap_unit (chars or messages), names
    (array of the speakers' names, may be null), first_seq, last_seq, known_seqs (array of struct of
    seq and text of the messages in the chunk, in order, may be null). Null texts and null limits give
    nothing; items within their limit aren't touched; a repeated row is split again; very long texts
    are split whole. Extra columns are ignored; an empty table gives no row.

    Result: table_name, row_id, chunk_index (from 0), n_pieces, text, start_at, end_at (offsets in code
    points), start_seq, end_seq (of the messages that a piece touches; null where there are none).
    """
    cols = ("table_name", "row_id", "text", "max_chars", "overlap_size", "overlap_unit", "names", "first_seq", "last_seq", "known_seqs")
    return oversized(items.select(*cols)).mapInPandas(_pieces, _PIECES)


def _items(spark: SparkSession, sf_dir: str, with_messages: bool) -> DataFrame:
    # A fixed table of a row per text field.
    limits = {r.table_name: r for r in bounded_rows(table(spark, sf_dir, "split_limits"), 64, "split limits")}
    none = "array<struct<seq:int,text:string>>"

    def limited(df: DataFrame, name: str) -> DataFrame:
        r = limits[name]
        return oversized(
            df.withColumns({"table_name": F.lit(name), "max_chars": F.lit(r.max_chars), "overlap_size": F.lit(r.overlap_size), "overlap_unit": F.lit(r.overlap_unit)})
        )

    chunks = limited(
        table(spark, sf_dir, "chunks").select(F.col("id").cast("string").alias("row_id"), "room_id", F.col("start_seq").alias("first_seq"), F.col("end_seq").alias("last_seq"), F.col("participants").alias("names"), "text"),
        "chunks",
    )
    if with_messages:
        usable = table(spark, sf_dir, "messages").filter("msg_type in ('text', 'link')").filter(F.col("text").rlike(r"[^\s\p{Z}\p{C}\x{3164}]"))
        usable = usable.select("room_id", "seq", F.col("text").alias("said"), F.shiftright("seq", _SPAN_BITS).alias("span"))
        spans = chunks.filter("last_seq >= first_seq").select(
            "row_id", "room_id", "first_seq", "last_seq",
            F.explode(F.sequence(F.shiftright("first_seq", _SPAN_BITS), F.shiftright("last_seq", _SPAN_BITS))).alias("span"),
        ).distinct()
        known = (
            spans.join(usable, ["room_id", "span"])
            .filter("seq between first_seq and last_seq")
            .groupBy("row_id", "room_id", "first_seq", "last_seq", "seq")
            .agg(F.min("said").alias("text"))
            .groupBy("row_id", "room_id", "first_seq", "last_seq")
            .agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("known_seqs"))
        )
        chunks = chunks.join(known, ["row_id", "room_id", "first_seq", "last_seq"], "left")
    else:
        chunks = chunks.withColumn("known_seqs", F.lit(None).cast(none))
    null = F.lit(None)
    documents = limited(
        table(spark, sf_dir, "document_chunks").select(F.col("id").alias("row_id"), null.cast("int").alias("first_seq"), null.cast("int").alias("last_seq"), null.cast("array<string>").alias("names"), F.col("content").alias("text"), null.cast(none).alias("known_seqs")),
        "document_chunks",
    )
    return chunks.drop("room_id").unionByName(documents)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(_items(spark, sf_dir, False)).filter("n_pieces > 1").select("table_name", "row_id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(_items(spark, sf_dir, True))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
SQL = {
    "p1_found": """
SELECT DISTINCT 'chunks' AS table_name, CAST(id AS VARCHAR) AS row_id FROM chunks
WHERE length(text) > (SELECT max_chars FROM split_limits WHERE table_name = 'chunks')
UNION ALL
SELECT DISTINCT 'document_chunks', id FROM document_chunks
WHERE length(content) > (SELECT max_chars FROM split_limits WHERE table_name = 'document_chunks')""",
}
