"""Chunking of texts and of message rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_windows(text: Column, size: int, step: int) -> Column:
    """Windows (start_at, text) of `size` characters every `step`, until one reaches the end."""
    if size < step or step < 1:
        raise ValueError("a window must be at least as long as its step")
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")) * step
    each = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.struct(s.alias("start_at"), F.substring(text, s + 1, F.lit(size)).alias("text")))
    return F.when(n > 0, each).otherwise(F.array().cast("array<struct<start_at:int,text:string>>"))


def by_heading(text: Column) -> Column:
    """Sections that start at headings of level one to three; what is before the first is one too."""
    return F.filter(F.split(text, r"(?m)^(?=#{1,3} )"), lambda x: F.trim(x) != "")


def packed_paragraphs(text: Column, size: int, overlap: int | None = None) -> Column:
    """Paragraphs joined greedily up to `size` characters. A longer one stays alone, or with an
    overlap is cut into pieces of `size` that overlap by so much; its rest is carried on."""
    if overlap is not None and not 0 <= overlap < size:
        raise ValueError("an overlap must be shorter than a piece")
    paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda x: F.trim(x) != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, p: Column) -> Column:
        joined = F.when(state["open"] == "", p).otherwise(F.concat_ws("\n\n", state["open"], p))
        fits = (state["open"] == "") | (F.length(joined) <= size)
        if overlap is None:
            done = F.when(fits, state["done"]).otherwise(F.array_append(state["done"], state["open"]))
            return F.struct(done.alias("done"), F.when(fits, joined).otherwise(p).alias("open"))
        stays = F.length(joined) <= size
        closed = F.when(stays | (state["open"] == ""), state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        n_cut = F.greatest(F.lit(0), F.ceil((F.length(p) - size) / (size - overlap))).cast("int")
        pieces = F.when(stays | (n_cut == 0), F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(0), n_cut - 1), lambda k: F.substring(p, k * (size - overlap) + 1, F.lit(size)))
        )
        rest = F.substring(p, n_cut * (size - overlap) + 1, F.length(p))
        return F.struct(F.concat(closed, pieces).alias("done"), F.when(stays, joined).otherwise(rest).alias("open"))

    folded = F.aggregate(paragraphs, empty, step)
    return F.when(folded["open"] == "", folded["done"]).otherwise(F.array_append(folded["done"], folded["open"]))


def at_boundaries(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """Pieces of (id, text) up to `size`, cut at a blank line, else a line end, in their second half."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                start, k, n = 0, 0, len(text or "")
                while start < n:
                    end = min(n, start + size)
                    if end < n:
                        half = start + size // 2
                        at = max(text.rfind("\n\n", half, end), text.rfind("\n", half, end) if text.rfind("\n\n", half, end) < 0 else -1)
                        end = at if at > half else end
                    rows.append((key, k, start, end, text[start:end]))
                    start, k = (n if end == n else max(end - overlap, start + 1)), k + 1
            yield pd.DataFrame(rows, columns=["id", "piece", "start_at", "end_at", "text"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInPandas(cut, f"id {kind}, piece int, start_at int, end_at int, text string")


def session_windows(rows: DataFrame, most_messages: int, most_chars: int, overlap: int) -> DataFrame:
    """Windows of a session's messages: up to so many messages and characters, the next starting
    `overlap` messages before the end of the last. rows: room_id, session, seq, sender, text.
    Sessions end at gaps, so a group is a session, not a room."""

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        size = [len(t or "") + len(s or "") + 2 for t, s in zip(pdf["text"], pdf["sender"], strict=True)]
        seq, out, i = pdf["seq"].tolist(), [], 0
        while i < len(seq):
            j, used = i, 0
            while j < len(seq) and j - i < most_messages and (j == i or used + size[j] <= most_chars):
                used += size[j]
                j += 1
            out.append((int(pdf["room_id"].iloc[0]), int(pdf["session"].iloc[0]), len(out), int(seq[i]), int(seq[j - 1]), j - i))
            i = j if j == len(seq) else max(i + 1, j - overlap)
        return pd.DataFrame(out, columns=["room_id", "session", "window", "start_seq", "end_seq", "n_messages"])

    return rows.groupBy("room_id", "session").applyInPandas(windows, "room_id int, session int, window int, start_seq int, end_seq int, n_messages int")


def chunk_id(*parts: Column, width: int = 20) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, width)
