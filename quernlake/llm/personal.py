"""Personal information inside free text, by bootstrapped contextual extraction.

Seeds are the members' names and the identifiers of unmistakable shape. The words around them are
lexical patterns; Spark scores the graph of patterns and instances in rounds: a pattern is good when
much of what it holds is known, an instance becomes known when several good patterns hold it. In the
end, what a good pattern holds is personal even where its own shape would not tell.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import ChainMap, Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.session import cut, table

TYPES = ("email", "phone", "id_number", "address", "name")
#: Words of respect behind a name, and what keeps a name's place in a pattern.
HONORIFICS = ("님", "씨", "팀장님", "선생님", "교수님", "대리님", "과장님", "부장님", "선배님")
ROUNDS = 3
#: A pattern is good if it holds so many known instances and they are so great a share of all that occurs in it.
MIN_SUPPORT, MIN_SHARE = 3, 0.2
#: What a pattern needs at least: one word. Edges of a text and marks alone say nothing about what they hold.
WORDED = r"\p{L}"
#: Of name patterns, other patterns, parts and known names, the most frequent up to so many each are
#: sent everywhere and the rest are joined to the texts that ask for them; the result is the same.
MOST = 20_000
#: A pattern that holds so many numbers, of which so small a share is personal, is one of things.
THING_NUMBERS, THING_SHARE = 30, 0.02

#: Between the parts of a value that is looked up; texts are split at it, so none of their tokens holds it.
SEPARATOR = "\x1f"

_FOLD = {0xFF01 + k: 0x21 + k for k in range(94)} | {0x3000: 0x20, 0xA0: 0x20}
_WIDE, _DIGITS = re.compile("[\xa0\u3000\uff01-\uff5e]"), re.compile(r"\d+")
_SHAPES = (
    ("email", re.compile(r"[A-Za-z0-9][\w.+-]*\s?(?:@|\(at\)|\[at\]|골뱅이)\s?[A-Za-z0-9-]+(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?)[A-Za-z0-9-]+)*(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?)[A-Za-z]{2,}", re.A)),
    ("address", re.compile(r"(?:\(우\)\s?\d{5}\s)?(?:[가-힣]{1,6}(?:시|도|군|구|읍|면)\s){1,3}[가-힣]{1,10}(?:로|길)\s?\d{1,4}(?:번길\s?\d{1,4})?(?:-\d{1,4})?(?:,?\s\d{1,4}동\s\d{1,5}호|\s\d{1,3}층)?")),
    ("address", re.compile(r"(?:[가-힣]{1,6}(?:시|도|군|구|읍|면)\s){1,3}[가-힣]{1,8}(?:동|리|가)\s\d{1,4}(?:-\d{1,4}(?:번지)?|번지)")),
    ("address", re.compile(r"\b\d{1,5} (?:[A-Z][A-Za-z]+ ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Lane|Ln|Boulevard|Blvd|Way|Court|Ct|Place|Pl)\b\.?(?:,? (?:Apt|Unit|Suite|Ste|#)\.? ?\w+)?")),
    ("id_number", re.compile(r"(?<![\d-])\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\s?-?\s?[1-8]\d{6}(?![\d-])")),
    ("id_number", re.compile(r"(?<![A-Za-z0-9])[MSRODGmsrodg]\d{8}(?![A-Za-z0-9])")),
    ("id_number", re.compile(r"(?<![\d-])\d\d-\d\d-\d{6}-\d\d(?![\d-])")),
    ("phone", re.compile(r"(?<![\d+-])(?:\+82[\s.-]?(?:\(0\)\s?)?1[016789]|01[016789]|공일공)[\s.-]?\d{3,4}(?:에\s?|[\s.-])?\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\d+-])\(?0(?:2|[3-6]\d)\)?[\s.-]?\d{3,4}[\s.-]\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\d+-])\+\d{1,3}[\s.-]?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]\d{4}(?![\d-])")),
)
#: Spans that may be an address where a good pattern says so: place words and a house number in any order known.
_PLACE = re.compile(r"(?:[가-힣]{1,20}(?:시|도|군|구|읍|면|동|리|가|로|길),?\s?){1,5}\d[\d-]*(?:\s?(?:번지|번길|동|호|층))?(?:,?\s\d+(?:동|호|층))*|(?<!\w)\d{1,5}(?:\s[A-Z][A-Za-z]+){1,4}\b")
#: Spans that may be an identifier where a good pattern says so.
_LOOSE = re.compile(r"\S+@\S+|(?<![\w.+-])[+(]?[A-Za-z]?[\d공일이삼사오육칠팔구][\d공일이삼사오육칠팔구().-]*(?:[ 에]{1,2}[\d공일이삼사오육칠팔구().-]+){0,4}")
_MAYBE = re.compile(r"\d|@|골뱅이|\(at\)|\[at\]|공일공")
_TOKEN = re.compile(r"\S+")
_NAME_EDGE = " \t'\"(<[{:;.,!?~|/"
_HANGUL = re.compile(r"[가-힣]{2,4}$")
_LATIN = re.compile(r"[A-Za-z]+(?:[-'][A-Za-z]+)?$")


class Span(NamedTuple):
    start: int
    end: int
    kind: str  # name, mail or number
    instance: str
    seed: str | None  # the type where the shape alone tells it


def fold(text: str) -> str:
    """One width, each character for itself: offsets stay."""
    return text.translate(_FOLD) if _WIDE.search(text) else text


def strict_spans(folded: str) -> list[Span]:
    """Identifiers whose shape tells their type; of overlapping ones the first by type."""
    out: list[Span] = []
    if not _MAYBE.search(folded):
        return out
    for kind, shape in _SHAPES:
        for m in shape.finditer(folded):
            if all(m.end() <= s.start or m.start() >= s.end for s in out):
                out.append(Span(m.start(), m.end(), "mail" if kind == "email" else "place" if kind == "address" else "number", m[0], kind))
    return out


def _loose_spans(folded: str, strict: list[Span]) -> list[Span]:
    out = []
    if _MAYBE.search(folded):
        for m in _LOOSE.finditer(folded):
            value = m[0].rstrip(" .-(에")
            end = m.start() + len(value)
            mail = "@" in value
            if (mail or sum(c.isdigit() for c in value) >= 4) and all(end <= s.start or m.start() >= s.end for s in strict):
                out.append(Span(m.start(), end, "mail" if mail else "number", value, None))
        for m in _PLACE.finditer(folded):
            if all(m.end() <= s.start or m.start() >= s.end for s in strict) and all(m.end() <= s.start or m.start() >= s.end for s in out):
                out.append(Span(m.start(), m.end(), "place", m[0], None))
    return out


def _name_spans(folded: str, tokens: list[re.Match]) -> Iterator[tuple[Span, int, int]]:
    """Spans that look like a name, with the tokens from which and before which they take place."""
    for i, t in enumerate(tokens):
        word = t[0].lstrip(_NAME_EDGE)
        start = t.end() - len(word)
        bare = word.rstrip(".,!?;:)'\"")
        if not bare:
            continue
        nxt = tokens[i + 1][0] if i + 1 < len(tokens) else ""
        if "가" <= bare[0] <= "힣":
            base = bare[:-1] if bare.endswith("님") and len(bare) > 2 and bare not in HONORIFICS else bare
            if _HANGUL.match(base):
                after = i + 2 if base == word and nxt in HONORIFICS else i + 1
                yield Span(start, start + len(base), "name", base, None), i, after
            elif len(bare) == 1 and bare == word:
                given = nxt[:-1] if nxt.endswith("님") and len(nxt) == 3 else nxt
                if len(given) == 2 and _HANGUL.match(given):
                    at = tokens[i + 1].start()
                    after = i + 3 if given == nxt and i + 2 < len(tokens) and tokens[i + 2][0] in HONORIFICS else i + 2
                    yield Span(start, at + 2, "name", bare + given, None), i, after
        elif nxt:
            first = bare if word in (bare, bare + ",", bare + ".") else ""
            second = nxt.rstrip(".,!?;:)'\"")
            second = second[:-1] if second.endswith("님") else second
            if first and _LATIN.match(first) and _LATIN.match(second) and (word == bare or word == bare + "," or len(bare) == 1):
                at = tokens[i + 1].start()
                after = i + 3 if second == nxt and i + 2 < len(tokens) and tokens[i + 2][0] in HONORIFICS else i + 2
                turned = word == bare + ","
                instance = f"{second} {first}" if turned else f"{first} {second}"
                yield Span(start, at + len(second), "name", instance.casefold(), None), i, after


@lru_cache(maxsize=1 << 16)
def _word(token: str) -> str:
    return _DIGITS.sub("0", token.casefold()).rstrip(".,;!") or "."


def _patterns(tokens: list[re.Match], first: int, after: int, tail: str = "") -> list[str]:
    """The patterns around tokens first..after-1; tail is what is joined to the last of them."""
    left1 = _word(tokens[first - 1][0]) if first else "^"
    left2 = _word(tokens[first - 2][0]) if first > 1 else "^"
    right = [tail] if tail else []
    right += [_word(tokens[k][0]) for k in range(after, min(after + 2, len(tokens)))]
    right += ["$"] * (2 - len(right))
    return [f"{left1}\t\t{right[0]}", f"\t\t{right[0]}\t{right[1]}", f"{left2}\t{left1}\t\t", f"\t\t{right[0]}\t"]


def _around(tokens: list[re.Match], starts: list[int], span: Span) -> list[str]:
    first = bisect_right(starts, span.start) - 1
    last = bisect_right(starts, span.end - 1) - 1
    tail = _word(tokens[last][0][span.end - tokens[last].start():].strip(",.!?"))
    head = tokens[first][0][: span.start - tokens[first].start()].strip("<([\"'")
    found = _patterns(tokens, first, last + 1, tail)
    return [f"{_word(head)}{p}" if head else p for p in found]


_EDGE = "kind string, pattern string, instance string, seed string, n bigint"


def _count_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        # A text that comes again in the batch is read once and counts as often as it comes.
        for text, times in Counter(t for t in batch["text"] if t).items():
            folded = fold(text)
            tokens = list(_TOKEN.finditer(folded))
            starts = [t.start() for t in tokens]
            for span, first, after in _name_spans(folded, tokens):
                for p in _patterns(tokens, first, after):
                    counts["name", p, span.instance, None] += times
            strict = strict_spans(folded)
            for span in strict + _loose_spans(folded, strict):
                # What counts of an identifier is that it is one: instances are shapes of a type.
                for p in _around(tokens, starts, span):
                    counts[span.kind, p, re.sub(r"\d", "0", span.instance) if span.seed is None else f"<{span.seed}>", span.seed] += times
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "pattern", "instance", "seed", "n"])


class Knowledge(NamedTuple):
    """What the rounds found: good patterns with their type, patterns of things, parts of names and known
    names as a whole."""

    patterns: dict[tuple[str, str], str]
    things: set[tuple[str, str]]
    surnames: set[str]
    given: set[str]
    latin: set[str]
    known: frozenset[str] = frozenset()
    any_given: bool = True  # whether a part of a given name is known at all, sent everywhere or not


class Rest(NamedTuple):
    """What is looked up by a join: what (known, pattern or part), value and verdict, one row each, and
    which of them there are."""

    table: DataFrame
    known: bool
    patterns: bool
    parts: bool


def learn(texts: DataFrame, names: DataFrame, rounds: int = ROUNDS) -> tuple[Knowledge, Rest]:
    """Score patterns and instances in rounds over all texts.

    texts: text. names: name, the seeds. All tables that grow stay in Spark: what is bounded by MOST
    comes back as Knowledge, all else as Rest.
    """
    edges = texts.select("text").filter("text is not null").mapInPandas(_count_edges, _EDGE)
    edges = cut(edges.groupBy("kind", "pattern", "instance", "seed").agg(F.sum("n").alias("n")), "pii-edges")
    name = F.trim(F.lower("name"))
    of_names = edges.filter("kind = 'name'").select("pattern", "instance", "n")
    known = names.select(name.alias("instance")).filter(F.col("instance").rlike("^([가-힣]{2,4}|[a-z]+([-'][a-z]+)? [a-z]+([-'][a-z]+)?)$")).distinct()
    # Shares are of occurrences: how many distinct values a place has seen grows with the corpus, shares don't.
    per_pattern = cut(of_names.filter(F.col("pattern").rlike(WORDED)).groupBy("pattern").agg(F.sum("n").alias("held")), "pii-held")
    good = None
    for k in range(rounds):
        hits = of_names.join(known, "instance").groupBy("pattern").agg(F.count("*").alias("support"), F.sum("n").alias("seen"))
        hits = hits.filter(F.col("support") >= MIN_SUPPORT)
        good = hits.join(per_pattern, "pattern").filter(F.col("seen") / F.col("held") >= MIN_SHARE)
        good = cut(good.select("pattern", "seen"), f"pii-good-{k}")
        if k == rounds - 1:
            break
        # Whole contexts, from both sides, tell apart the places where an instance occurs.
        held = of_names.withColumn("whole", F.col("pattern").rlike("^[^\t]+\t\t[^\t]+$")).join(good.select("pattern", F.lit(1).alias("g")), "pattern", "left")
        grown = held.groupBy("instance").agg(
            F.sum(F.when(F.col("whole"), F.col("n"))).alias("all"), F.sum(F.when(F.col("whole") & F.col("g").isNotNull(), F.col("n"))).alias("in_good"),
            F.count_if(F.col("whole") & F.col("g").isNotNull()).alias("places"),
        )
        more = grown.filter((F.col("places") >= 2) & (F.col("in_good") / F.col("all") >= 0.6)).select("instance")
        known = cut(known.unionByName(more).distinct(), f"pii-known-{k}")
    patterns, rare = _sent(good.select(F.lit("name").alias("kind"), "pattern", F.lit("name").alias("verdict"), "seen"))
    patterns = {(r.kind, r.pattern): r.verdict for r in patterns}
    parts = known.select(
        F.explode(
            F.when(F.col("instance").rlike("^[가-힣]{3}$"), F.array(F.concat(F.lit("s"), F.left("instance", F.lit(1))), F.concat(F.lit("g"), F.right("instance", F.lit(2)))))
            .when(F.col("instance").rlike("^[a-z]+ [a-z]+$"), F.transform(F.split("instance", " "), lambda x: F.concat(F.lit("l"), x)))
            .otherwise(F.array())
        ).alias("part")
    )
    counted = parts.groupBy("part").agg(F.count("*").alias("seen")).filter((F.col("seen") >= 2) & (F.length("part") > 1))
    used, rare_parts = _sent(cut(counted, "pii-parts"))
    used = [r.part for r in used]
    rare_parts = rare_parts.select(F.lit("part").alias("what"), F.col("part").alias("value"), F.lit("name").alias("verdict"))
    # Numbers, mail and places: the share of each type in what a pattern holds.
    other = edges.filter("kind in ('number', 'mail', 'place')").filter(F.col("pattern").rlike(WORDED)).groupBy("kind", "pattern").agg(
        F.sum("n").alias("n"), *(F.coalesce(F.sum(F.when(F.col("seed") == t, F.col("n"))), F.lit(0)).alias(t) for t in TYPES[:4])
    )
    types = TYPES[:4]
    most, all_types = F.greatest(*types), sum((F.col(t) for t in types[1:]), F.col(types[0]))
    top = F.coalesce(*(F.when(F.col(t) == most, F.lit(t)) for t in types))
    verdict = F.when((most >= MIN_SUPPORT) & (most / F.col("n") >= 0.8), top).when((F.col("n") >= THING_NUMBERS) & (all_types / F.col("n") < THING_SHARE), F.lit("thing"))
    other = other.filter(F.col("n") >= MIN_SUPPORT).withColumn("verdict", verdict).filter(F.col("verdict").isNotNull())
    others, rare_others = _sent(cut(other.select("kind", "pattern", "verdict", F.col("n").alias("seen")), "pii-other"))
    things = {(r.kind, r.pattern) for r in others if r.verdict == "thing"}
    patterns |= {(r.kind, r.pattern): r.verdict for r in others if r.verdict != "thing"}
    rare = rare.unionByName(rare_others).select(F.lit("pattern").alias("what"), F.concat_ws(SEPARATOR, "kind", "pattern").alias("value"), "verdict")
    # Known names go by how often they occur; those that don't occur can't be asked for.
    whole = of_names.groupBy("instance").agg(F.sum("n").alias("seen")).join(known, "instance")
    names_sent, rare_names = _sent(cut(whole, "pii-whole"))
    rare_names = rare_names.select(F.lit("known").alias("what"), F.col("instance").alias("value"), F.lit("name").alias("verdict"))
    of = {c: {p[1:] for p in used if p[0] == c} for c in "sgl"}
    any_given = bool(of["g"]) or not rare_parts.filter(F.col("value").startswith("g")).isEmpty()
    knowledge = Knowledge(patterns, things, of["s"], of["g"], of["l"], frozenset(r.instance for r in names_sent), any_given)
    return knowledge, Rest(rare_names.unionByName(rare).unionByName(rare_parts), not rare_names.isEmpty(), not rare.isEmpty(), not rare_parts.isEmpty())


def _sent(df: DataFrame) -> tuple[list, DataFrame]:
    """Of df, which is written and has a column `seen`, the rows to send everywhere and the rest: all, or,
    where they are more than MOST, those above the least power of two that leaves no more."""
    sizes = sorted(((int(r.b), r["count"]) for r in df.groupBy(F.floor(F.log2("seen")).alias("b")).count().collect()), reverse=True)
    sent, least = 0, sizes[0][0] + 1 if sizes else 0
    for b, n in sizes:
        if sent + n > MOST:
            break
        sent, least = sent + n, b
    return df.filter(F.col("seen") >= 2**least).collect(), df.filter(F.col("seen") < 2**least)


def _parts(instance: str) -> list[str]:
    if " " in instance:
        return [f"l{w}" for w in instance.split()]
    return [f"g{instance}"] if len(instance) == 2 else [f"s{instance[0]}", f"g{instance[1:]}"] if len(instance) == 3 else []


def _honoured(s: Span, folded: str, tokens: list[re.Match], first: int, after: int) -> bool:
    return folded[s.end:s.end + 1] == "님" or (after - 1 > first and tokens[after - 1][0] in HONORIFICS)


def questions(text: str, k: Knowledge, known: bool, patterns: bool, parts: bool) -> set[tuple[str, str]]:
    """What (what, value) of a text k doesn't know and the rest may."""
    folded = fold(text)
    tokens = list(_TOKEN.finditer(folded))
    asked: set[tuple[str, str]] = set()
    for s, first, after in _name_spans(folded, tokens):
        around = _patterns(tokens, first, after)
        good = any(("name", p) in k.patterns for p in around)
        if not good and patterns:
            asked.update(("pattern", f"name{SEPARATOR}{p}") for p in around)
        if (good or patterns) and not _is_name(s, folded, _honoured(s, folded, tokens, first, after), k):
            asked.update([("known", s.instance)] if known else [])
            asked.update(("part", p) for p in _parts(s.instance) if parts)
    if patterns:
        starts = [t.start() for t in tokens]
        strict = strict_spans(folded)
        for s in strict + _loose_spans(folded, strict):
            asked.update(("pattern", f"{s.kind}{SEPARATOR}{p}") for p in _around(tokens, starts, s) if (s.kind, p) not in k.patterns and (s.kind, p) not in k.things)
    return asked


def with_answers(k: Knowledge, answers: list[str]) -> Knowledge:
    """k and what the join found for a text: what, value and verdict in one string each."""
    rows = [a.split(SEPARATOR, 1) for a in answers]
    of = lambda what: [v for w, v in rows if w == what]
    found = {tuple(v.rsplit(SEPARATOR, 1)[0].split(SEPARATOR, 1)): v.rsplit(SEPARATOR, 1)[1] for v in of("pattern")}
    parts = [v.rsplit(SEPARATOR, 1)[0] for v in of("part")]
    also = lambda c, had: ChainMap({p[1:]: None for p in parts if p[0] == c}, had) if any(p[0] == c for p in parts) else had
    return Knowledge(
        ChainMap({p: v for p, v in found.items() if v != "thing"}, k.patterns), ChainMap({p: None for p, v in found.items() if v == "thing"}, k.things),
        also("s", k.surnames), also("g", k.given), also("l", k.latin), k.known.union(v.rsplit(SEPARATOR, 1)[0] for v in of("known")) if of("known") else k.known, k.any_given,
    )


def _is_name(span: Span, folded: str, honoured: bool, k: Knowledge) -> bool:
    value = span.instance
    if value in k.known:
        return True
    if " " in value:
        words = value.split()
        return any(w in k.latin for w in words) and all(w in k.latin or len(w) == 1 or folded[span.start:span.end].istitle() for w in words)
    if len(value) == 2:
        return value in k.given
    return len(value) == 3 and value[0] in k.surnames and (value[1:] in k.given or honoured or not k.any_given)


def find_spans(text: str, k: Knowledge) -> list[tuple[int, int, str]]:
    """The personal spans of a text (start, end, type), in order and apart from each other."""
    folded = fold(text)
    tokens = list(_TOKEN.finditer(folded))
    starts = [t.start() for t in tokens]
    out: list[tuple[int, int, str]] = []
    strict = strict_spans(folded)
    for s in strict:
        around = _around(tokens, starts, s)
        if s.kind != "number" or (s.kind, around[0]) not in k.things:
            out.append((s.start, s.end, s.seed))
    for s in _loose_spans(folded, strict):
        around = _around(tokens, starts, s)
        kinds = {k.patterns[s.kind, p] for p in around[:3] if (s.kind, p) in k.patterns}
        enough = s.kind in ("mail", "place") or sum(c.isdigit() for c in s.instance) >= 8
        if len(kinds) == 1 and enough and not any((s.kind, p) in k.things for p in around[:1]):
            out.append((s.start, s.end, kinds.pop()))
    last = -1
    for s, first, after in _name_spans(folded, tokens):
        if s.start < last or any(s.start < e and s.end > b for b, e, _ in out):
            continue
        honoured = _honoured(s, folded, tokens, first, after)
        if any(("name", p) in k.patterns for p in _patterns(tokens, first, after)) and _is_name(s, folded, honoured, k):
            out.append((s.start, s.end, "name"))
            last = s.end
    return sorted(out)


def mask_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def mask_personal(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The rows with their personal information replaced by typed placeholders.

    rows: table_name, row_id, text. names: name. A null text stays null and an empty one empty, both
    without types; repeated rows are masked each; texts of any length are read whole; an empty table
    gives no row and empty names find the identifiers only. Extra columns are ignored.

    Result: table_name, row_id, text (masked), pii_types (array of the types found, in order).
    """
    given = rows.select("table_name", F.col("row_id").cast("bigint").alias("row_id"), "text")
    knowledge, rest = learn(given, names)
    shared = rows.sparkSession.sparkContext.broadcast(knowledge)
    asks = (rest.known, rest.patterns, rest.parts)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            once = dict(zip(batch["_key"], batch["text"], strict=True))
            out = [(key, *q) for key, t in once.items() if t for q in questions(t, shared.value, *asks)]
            yield pd.DataFrame(out, columns=["_key", "what", "value"])

    if any(asks):
        keyed = given.withColumn("_key", F.sha2("text", 256))
        asked = keyed.filter("text is not null").select("_key", "text").mapInPandas(ask, "_key string, what string, value string").distinct()
        answers = asked.join(rest.table, ["what", "value"]).groupBy("_key").agg(F.collect_list(F.concat_ws(SEPARATOR, "what", "value", "verdict")).alias("answers"))
        told = keyed.join(answers, "_key", "left").select("table_name", "row_id", "text", "answers")
    else:
        told = given.withColumn("answers", F.lit(None).cast("array<string>"))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        knowledge = shared.value
        for batch in batches:
            # Equal texts have equal answers.
            asked_of = {t: a for t, a in zip(batch["text"], batch["answers"], strict=True) if t}
            once = {t: find_spans(t, knowledge if a is None else with_answers(knowledge, list(a))) for t, a in asked_of.items()}
            found = [once[t] if t else [] for t in batch["text"]]
            batch["text"] = [mask_text(t, s) if s else t for t, s in zip(batch["text"], found, strict=True)]
            batch["pii_types"] = [sorted({x[2] for x in s}) for s in found]
            yield batch[["table_name", "row_id", "text", "pii_types"]]

    return told.mapInPandas(apply, "table_name string, row_id bigint, text string, pii_types array<string>")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = (("messages", "text"), ("do_dop_kakao_chunks", "content"), ("chat_chunks", "message"))
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.col("id").alias("row_id"), F.col(c).alias("text")) for t, c in texts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask_personal(_rows(spark, sf_dir), table(spark, sf_dir, "members"))
    return masked.select("table_name", "row_id", F.explode("pii_types").alias("pii_type")).distinct()


def p5_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_personal(_rows(spark, sf_dir), table(spark, sf_dir, "members"))


QUERIES = {"p5_found": p5_found, "p5_masked": p5_masked}
SQL: dict[str, str] = {}
