"""What a commit is and whose, as column expressions over its paths and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of work in the order in which they count, with the paths that tell them.
KINDS = (("lab", r"(^|/)labs?/"), ("note", r"(^|/)notes?/|\.md$"), ("reading", r"(^|/)readings?/"), ("shared", r"(^|/)(shared|docs)/"))
#: Files that say nothing about the work.
HOUSEKEEPING = r"(^|/)(\.git[^/]*|\.github/.*|package-lock\.json|poetry\.lock|uv\.lock|\.DS_Store)$"


def working_files(paths: Column) -> Column:
    return F.filter(paths, lambda p: ~p.rlike(HOUSEKEEPING))


def commit_kind(paths: Column) -> Column:
    """The first kind that any path tells, else commit."""
    kind = F.lit("commit")
    for name, pattern in reversed(KINDS):
        kind = F.when(F.exists(paths, _fits(pattern)), name).otherwise(kind)
    return kind


def _fits(pattern: str):
    return lambda p: p.rlike(pattern)


def commit_owner(paths: Column, email: Column, author: Column) -> Column:
    """Whose a commit is: the member folder of its paths, the account of a no-reply address, the local
    part of another address, the author's name: the first that is there."""
    folder = F.array_compact(F.transform(paths, lambda p: F.nullif(F.regexp_extract(p, "^members/([^/]+)/", 1), F.lit(""))))
    account = F.nullif(F.regexp_extract(email, r"^(?:[0-9]+\+)?([^@]+)@users\.noreply\.", 1), F.lit(""))
    local = F.nullif(F.regexp_extract(email, "^([^@]+)@", 1), F.lit(""))
    return F.lower(F.coalesce(F.get(folder, F.lit(0)), account, local, author))
