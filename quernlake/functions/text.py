"""Text functions as column expressions: all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[0-9A-Za-z가-힣]+"

# The numbering plan: what stands behind the leading zero of mobile numbers, of places and of services.
_MOBILE, _AREA, _SERVICE = "1[016-9]", "(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4])", "(?:50[0-9]|70|80)"
_BIRTH = "[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])"
_JOIN = "[ .-]?"
#: Masking rules in order, label and pattern: earlier ones change what later ones see.
MASKS: tuple[tuple[str, str], ...] = (
    ("email", r"\b[\w.+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("resident", rf"\b{_BIRTH} ?-? ?[0-9][0-9]{{6}}\b"),
    ("card", rf"\b(?:[0-9]{{4}}{_JOIN}){{3}}[0-9]{{4}}\b"),
    ("mobile", rf"\b0{_MOBILE}{_JOIN}[0-9]{{3,4}}{_JOIN}[0-9]{{4}}\b"),
    ("landline", rf"\b0(?:{_AREA}|{_SERVICE})[ .-][0-9]{{3,4}}[ .-][0-9]{{4}}\b"),
    ("account", r"\b[0-9]{2,6}(?:-[0-9]{2,7}){2,3}\b"),
    ("number", r"\b[0-9]{10,16}\b"),
)
#: Secrets that are cut out of logs.
SECRETS: tuple[tuple[str, str], ...] = (
    ("key", r"\b(?:sk|pk|ntn|ghp)[-_][A-Za-z0-9_-]{8,}"),
    ("bearer", r"(?i)\bbearer [A-Za-z0-9._-]+"),
    ("email", MASKS[0][1]),
    ("password", r"(?i)\b(?:password|passwd|secret|token) ?[=:] ?[^ \n]+"),
    ("digits", r"[0-9]{9,}"),
)


#: An edge of an ASCII word, whatever letters of other scripts stand beside it.
_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def squeeze(text: Column) -> Column:
    """Runs of whitespace as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{00A0}]+", " "))


def without_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\x{00A0}]+", "")


def words(text: Column) -> Column:
    """Lower-case words of Latin letters, digits and Hangul."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def character_ngrams(text: Column, n: int) -> Column:
    """The n-grams of the letters and digits of a text, in order; none for shorter texts."""
    bare = F.regexp_replace(F.lower(text), r"[^0-9a-z가-힣]", "")
    grams = F.transform(F.sequence(F.lit(1), F.length(bare) - (n - 1)), lambda i: F.substring(bare, i, F.lit(n)))
    return F.when(F.length(bare) >= n, grams).otherwise(F.array().cast("array<string>"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9가-힣]+", "-"), r"^-+|-+$", "")


def upper_snake(name: Column) -> Column:
    """camelCase as UPPER_SNAKE."""
    return F.upper(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))


def foreign_letters(text: Column) -> Column:
    """Number of letters of neither Latin nor Hangul script."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]|[A-Za-z가-힣\x{1100}-\x{11FF}\x{3130}-\x{318F}]", ""))


def message_kind(text: Column) -> Column:
    """empty, deleted, media, link or text: the first that fits."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(bare == "", "empty")
        .when(bare.rlike("^삭제된 메시지입니다\\.?\\z"), "deleted")
        .when(bare.rlike("^(사진( [0-9]+장)?|동영상|이모티콘|음성메시지|파일: .*)\\z"), "media")
        .when(bare.rlike("^https?://[^ \n]+\\z"), "link")
        .otherwise("text")
    )


def masked(text: Column, rules: Sequence[tuple[str, str]] = MASKS) -> tuple[Column, Mapping[str, Column]]:
    """The text after all rules in their order, and how many hits each had on what the earlier ones left."""
    counts: dict[str, Column] = {}
    for label, pattern in rules:
        pattern = pattern.replace(r"\b", _EDGE)
        counts[label] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, f"[{label}]")
    return text, counts


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("#([0-9A-Za-z_가-힣]+)"), F.lit(1)))


def links(text: Column) -> Column:
    """Targets of markdown links and of double-bracket links, the first mention of each."""
    marked = F.regexp_extract_all(text, F.lit(r"\[[^\]\n]*\]\(([^)\s]+)\)"), F.lit(1))
    wiki = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#\n]+)"), F.lit(1))
    return F.array_distinct(F.concat(marked, wiki))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"https?://[^\s<>()\"']+"), F.lit(0))


def front_matter(text: Column) -> Column:
    """The scalars of a leading --- block as a map; an empty map where there is none."""
    block = F.regexp_extract(text, r"^\x{FEFF}?---\n([\s\S]*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([A-Za-z_]+):", 1).alias("k"), F.trim(F.regexp_replace(x, "^[A-Za-z_]+:", "")).alias("v")))
    # The first of repeated keys counts.
    once = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(once)


def first_heading(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?m)^#{1,6} +([^\n]+)$", 1)
    return F.nullif(F.trim(found), F.lit(""))


def clean_markdown(text: Column) -> Column:
    """Plain text of markdown: no fences' marks, images, heading, list or quote marks; links as their text."""
    out = F.regexp_replace(text, r"(?m)^```[^\n]*$", "")
    out = F.regexp_replace(out, r"!\[[^\]\n]*\]\([^)\n]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]\n]*)\]\([^)\n]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^[ \t]*(#{1,6}|>|[-*+])[ \t]+", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.trim(out)


def html_blocks(text: Column, least: int = 12) -> Column:
    """Text blocks of markup: closing tags end a block, other tags vanish, short blocks are dropped."""
    out = F.regexp_replace(text, r"</[A-Za-z0-9]+>|<br ?/?>", "\n")
    out = F.regexp_replace(out, r"<[^<>]+>", "")
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(ch))
    return F.filter(F.transform(F.split(out, "\n"), lambda x: squeeze(x)), lambda x: F.length(x) >= least)


def normalised_tags(tags: Column) -> Column:
    """Lower-case tags without #, the first of each."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.regexp_replace(F.lower(F.trim(t)), "^#+", "")), lambda t: t != ""))


def resolved_path(path: Column) -> Column:
    """A relative path without . and ..; a .. at the top vanishes."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)),
    )
    return F.array_join(kept, "/")


def clock_12h(text: Column) -> Column:
    """Minutes of the day of a Korean 12-hour clock time such as 오후 3:05; null for anything else."""
    half = F.regexp_extract(text, "(오전|오후) ([0-9]{1,2}):([0-9]{2})", 1)
    hour = F.regexp_extract(text, "(오전|오후) ([0-9]{1,2}):([0-9]{2})", 2).try_cast("int")
    minute = F.regexp_extract(text, "(오전|오후) ([0-9]{1,2}):([0-9]{2})", 3).try_cast("int")
    return F.when(half != "", (hour % 12 + F.when(half == "오후", 12).otherwise(0)) * 60 + minute)


def preview(text: Column, width: int = 80) -> Column:
    """The first `width` characters of the squeezed text, with an ellipsis where it goes on."""
    flat = squeeze(text)
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, F.lit(1), F.lit(width)), F.lit("…"))).otherwise(flat)


def sentences(text: Column) -> Column:
    """Sentences by their end marks and by lines, squeezed, without empty ones."""
    lines = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")
    return F.filter(F.transform(lines, lambda x: squeeze(x)), lambda x: x != "")


def clean_number(value: Column) -> Column:
    """Finite non-negative numbers; null for all else."""
    x = value.try_cast("double")
    return F.when((x >= 0) & ~F.isnan(x) & (x != float("inf")), x)


def any_timestamp(value: Column) -> Column:
    """A timestamp of an ISO text or of epoch seconds."""
    return F.coalesce(F.timestamp_seconds(value.try_cast("double")), F.try_to_timestamp(value))


def pull_request(url: Column) -> Column:
    """repository#number of a pull request's address, the repository in one spelling; null for others."""
    pattern = r"^https?://[^/]+/([^/]+/[^/]+)/pull/([0-9]+)"
    repo = F.translate(F.lower(F.regexp_extract(url, pattern, 1)), "-", "_")
    return F.when(repo != "", F.concat_ws("#", repo, F.regexp_extract(url, pattern, 2)))


def added_lines(patch: Column) -> Column:
    """Lines a diff adds, without the file header and comments."""
    lines = F.filter(F.split(patch, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.substring(x, F.lit(2), F.length(x)), r"(#|//).*$", ""))), lambda x: x != "")


def shares_window(text: Column, body: Column, size: int) -> Column:
    """Whether any `size` characters in a row of text stand in body."""
    at = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.exists(at, lambda i: F.contains(body, F.substring(text, i, F.lit(size))))).otherwise(F.lit(False))
