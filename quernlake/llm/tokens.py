"""Encoding of a whole corpus by a public byte-level BPE vocabulary.

The distinct words are encoded once: higher-order functions fold the merges of lowest rank over the
word's bytes, with the ranks as a literal map. Documents then look their words up, the frequent ones
in a literal of bounded size, the rest by a join on the word.

Bytes are kept as strings of the characters U+0000 to U+00FF, one per byte.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.session import cut, table

#: The vocabulary's word pattern for Java; \s is every White_Space character there as in the vocabulary.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
#: Buckets of the literal maps, so that a look-up passes a few entries only.
BUCKETS = 8192
#: Frequent words whose ids travel as a literal; all others are joined.
HEAD_WORDS, HEAD_LINES = 16384, 256
#: Longer words take a merge queue instead of the fold, whose time is quadratic.
FOLD_BYTES = 128


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _literal_map(entries: Iterable[tuple[str, object]], value_type: str) -> Column:
    """A map as a literal array of small maps, by a hash of the key."""
    parts: list[dict[str, object]] = [{} for _ in range(BUCKETS)]
    for key, value in entries:
        parts[zlib.crc32(key.encode()) % BUCKETS][key] = value
    return F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), f"array<map<string,{value_type}>>")


def _look_up(literal: Column, key: Column) -> Column:
    return F.try_element_at(F.get(literal, F.crc32(key.cast("binary")) % BUCKETS), key)


def byte_string(word: Column) -> Column:
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def fold_merges(word: Column, ranks: Column) -> Column:
    """The ids of a byte string: again and again the adjacent pair of lowest rank, the first of equals,
    becomes one piece, until no pair has a rank."""
    single = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))

    def pair_ranks(parts: Column) -> Column:
        n = F.size(parts)
        return F.zip_with(F.slice(parts, F.lit(1), n - 1), F.slice(parts, F.lit(2), n - 1), lambda a, b: _look_up(ranks, F.concat(a, b)))

    def merged(parts: Column, of: Column) -> Column:
        at = F.array_position(of, F.array_min(of)).cast("int")
        n = F.size(parts)
        pair = F.array(F.concat(F.get(parts, at - 1), F.get(parts, at)))
        return F.concat(F.slice(parts, F.lit(1), at - 1), pair, F.slice(parts, at + 2, F.greatest(n - at - 1, F.lit(0))))

    def step(state: Column, _: Column) -> Column:
        parts, of = state["parts"], state["of"]
        more = F.array_min(of).isNotNull()
        after = F.when(more, merged(parts, of)).otherwise(parts)
        # `of` is worked out anew only after a merge: one that is over costs nothing more.
        return F.struct(after.alias("parts"), F.when(more, pair_ranks(after)).otherwise(of).alias("of"))

    begin = F.struct(single.alias("parts"), pair_ranks(single).alias("of"))
    rounds = F.sequence(F.lit(1), F.length(word) - 1)
    folded = F.when(F.length(word) > 1, F.aggregate(rounds, begin, step)["parts"]).otherwise(single)
    return F.transform(folded, lambda p: _look_up(ranks, p))


def merge_queue(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids by a queue of pairs, in time n log n."""
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    queue: list[tuple[int, int, int, int]] = []

    def push(a: int) -> None:
        b = end[a]
        if b < n and (r := ranks.get(word[a : end[b]])) is not None:
            heapq.heappush(queue, (r, a, b, end[b]))

    for a in range(n - 1):
        push(a)
    while queue:
        _, a, b, c = heapq.heappop(queue)
        if not alive[a] or not alive[b] or end[a] != b or end[b] != c:
            continue
        alive[b] = False
        end[a] = c
        if c < n:
            before[c] = a
        push(a)
        if before[a] >= 0:
            push(before[a])
    return [ranks[word[a : end[a]]] for a in range(n) if alive[a]]


def word_table(documents: DataFrame, vocabulary: str) -> DataFrame:
    """word, n (occurrences in the corpus) and ids of each distinct word, as a written table."""
    ranks = read_ranks(vocabulary)
    literal = _literal_map(((k.decode("latin-1"), r) for k, r in ranks.items()), "int")
    shared = documents.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary, of fixed size

    @F.pandas_udf("array<int>")
    def queued(words: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else merge_queue(w.encode(), shared.value) for w in words], dtype=object)

    words = documents.select(F.explode(F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))).alias("word"))
    distinct = words.groupBy("word").agg(F.count("*").alias("n")).withColumn("bytes", byte_string(F.col("word")))
    short = F.length("bytes") <= FOLD_BYTES
    folded = distinct.filter(short).select("word", "n", fold_merges(F.col("bytes"), literal).alias("ids"))
    long = distinct.filter(~short).select("word", "n", queued("word").alias("ids"))
    return cut(folded.unionByName(long), "words")


def encode_corpus(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every document, without special tokens.

    documents: doc_id, text. A null and an empty text have no ids: an empty array. Strings that look
    like special tokens are ordinary text. Repeated texts are encoded alike; a repeated doc_id gives a
    row each time; texts of any length are encoded whole. Extra columns are ignored; an empty table
    gives no row.
    """
    docs = documents.select("doc_id", "text")
    words = word_table(docs, vocabulary or vocabulary_path())
    # A literal of at most HEAD_WORDS words of at most 64 bytes and of HEAD_LINES longer ones, such as ruled lines.
    size = F.octet_length("word")
    common = words.filter(size <= 64).orderBy(F.desc("n"), "word").limit(HEAD_WORDS)
    ruled = words.filter((size > 64) & (size <= 4096) & (F.col("n") > 1)).orderBy(F.desc("n"), "word").limit(HEAD_LINES)
    head = [(r.word, list(r.ids)) for r in common.unionByName(ruled).select("word", "ids").collect()]
    literal = _literal_map(head, "array<int>")
    # The literal takes part in one written step only: all else goes on from ids and the words they lack.
    known = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)), F.array()).alias("words"))
    known = known.withColumn("ids", F.transform("words", lambda w: _look_up(literal, w)))
    lacking = F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.when(F.get("ids", i).isNull(), w).alias("word")))
    known = cut(known.select("doc_id", "h", "ids", F.filter(lacking, lambda x: x["word"].isNotNull()).alias("lacking")), "known")
    rest = (
        known.select("doc_id", "h", F.explode("lacking").alias("x"))
        .distinct()
        .select("doc_id", "h", "x.pos", "x.word")
        .join(words.select("word", "ids"), "word")
        .groupBy("doc_id", "h")
        .agg(F.collect_list(F.struct("pos", "ids")).alias("rest"))
    )
    present = F.filter(F.transform("ids", lambda x, i: F.struct(i.alias("pos"), x.alias("ids"))), lambda x: x["ids"].isNotNull())
    ids = F.flatten(F.transform(F.array_sort(F.concat(present, F.coalesce("rest", F.array()))), lambda x: x["ids"]))
    complete = known.filter(F.size("lacking") == 0).select("doc_id", F.flatten("ids").alias("ids"))
    # A doc_id that comes with several texts keeps them apart by the hash.
    lacked = known.filter(F.size("lacking") > 0).join(rest, ["doc_id", "h"], "left")
    return complete.unionByName(lacked.select("doc_id", ids.alias("ids")))


def decode_ids(ids: Column, vocabulary: str | None = None) -> Column:
    """The text of an array of ids: their byte pieces, concatenated."""
    pieces = sorted((r, k) for k, r in read_ranks(vocabulary or vocabulary_path()).items())
    literal = F.from_json(F.lit(json.dumps([k.decode("latin-1") for _, k in pieces])), "array<string>")
    joined = F.array_join(F.transform(ids, lambda i: F.get(literal, i)), "")
    return F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
