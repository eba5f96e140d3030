"""Variant spellings of names typed by people, by merge-and-rematch resolution.

Spellings that are the same after normalisation, or one slip of a key apart, merge first. A merged
profile unites its members' given names, families and initials and enters blocking again in every
round: names that the united spellings make up meet those of other profiles, and a bare initial or a
nickname joins the one profile that it fits, which may only become the one once others have merged.
This goes on until nothing merges any more. Words for fields of business that the lexicon doesn't know
are learned from names whose rest is known with one field.
"""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.session import cut, table

#: The letters of Hangul in the revised romanisation.
_LEAD = "g kk n d tt r m b pp s ss  j jj ch k t p h".split(" ")
_VOWEL = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
_TAIL = " k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split(" ")
#: Fields of business, as they are written in full, in Korean and in short: the lexicon to start from.
#: Other words for them are learned (LEARNED).
FIELDS = {
    "analytics": ("애널리틱스", "분석"),
    "biosciences": ("바이오", "bio", "생명과학"),
    "education": ("에듀", "교육", "edu"),
    "energy": ("에너지",),
    "foods": ("푸드", "식품", "f&b", "food"),
    "logistics": ("로지스틱스", "물류"),
    "materials": ("머티리얼즈", "소재"),
    "robotics": ("로보틱스", "로봇"),
    "semiconductor": ("반도체", "semi"),
    "software": ("소프트웨어", "sw", "s/w"),
}
#: Words that say what kind of thing a name is of, not which.
_FORMS = {"co", "ltd", "inc", "corp", "corporation", "company", "group", "the", "llc", "limited", "주식회사", "(주)", "㈜", "주"}
_PROJECT = {"project", "proj", "pjt", "프로젝트", "v"}
_TITLES = {"dr", "mr", "ms", "mrs", "prof", "박사", "교수", "씨", "님"}
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_PET = re.compile(r"(.{2,}?)(?:ie|y|o|i)$")
_IN_KOREAN = sorted(((w, f) for f, ws in FIELDS.items() for w in ws if not w.isascii()), key=lambda x: -len(x[0]))
SEPARATOR = "\x1f"
_HONOURED = re.compile(r"(?<=[가-힣]{2})(?:님|씨)$")
#: A word stands for a field if it occurs with so many rests that are known with a field, and so great a share of them with this one.
LEARNED = (3, 0.6)


def romanise(text: str) -> str:
    out = []
    for ch in text:
        k = ord(ch) - 0xAC00
        out.append(_LEAD[k // 588] + _VOWEL[k % 588 // 28] + _TAIL[k % 28] if 0 <= k < 11172 else ch)
    return "".join(out)


def _letters(word: str) -> str:
    """Letters alone, with those read for one another taken as one (0 and o, 1, l and i)."""
    plain = "".join(c for c in unicodedata.normalize("NFD", romanise(word)) if not unicodedata.combining(c))
    return re.sub(r"[^\w]|_", "", plain.replace("0", "o").replace("1", "i").replace("l", "i"))


_FIELD_KEYS = {_letters(f): f for f in FIELDS} | {_letters(w): f for f, ws in FIELDS.items() for w in ws}
_BONES = {re.sub("[aeiouy]", "", k): f for k, f in _FIELD_KEYS.items() if len(k) > 4}


def _field(word: str) -> str | None:
    """The field a word stands for: in full, misread, shortened or without its vowels."""
    k = _letters(word)
    if k in _FIELD_KEYS:
        return _FIELD_KEYS[k]
    bones = re.sub("[aeiouy]", "", k)
    if len(bones) >= 3 and bones in _BONES:
        return _BONES[bones]
    starts = {f for key, f in _FIELD_KEYS.items() if len(k) >= 4 and key.startswith(k)}
    if len(starts) == 1:
        return starts.pop()
    if len(k) >= 5:
        near = {f for key, f in _FIELD_KEYS.items() if abs(len(key) - len(k)) <= 1 and _one_slip(key, k)}
        if len(near) == 1:
            return near.pop()
    return None


def _one_slip(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) == len(b):
        at = [k for k in range(len(a)) if a[k] != b[k]]
        return len(at) == 1 or (len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]])
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


class Profile:
    """What one spelling says: the discriminator, its full forms, and initials or pet names."""

    def __init__(self) -> None:
        self.which = ""  # field or number: those that differ are never the same
        self.forms: list[str] = []
        self.tokens: list[tuple[str, str]] = []  # (given, family), in either order
        self.initial: list[tuple[str, str]] = []  # (initial, family) with no given name
        self.pet: list[tuple[str, str]] = []  # (start of the given name, family)
        self.swaps: list[str] = []  # forms with two syllables of Hangul the other way round
        self.words: list[tuple[str, str]] = []  # (word, rest) of a name without a known field


def _turned(words: list[str]) -> list[list[str]]:
    """The words with any two neighbouring syllables of Hangul in one of them exchanged."""
    out = []
    for i, w in enumerate(words):
        for k in range(len(w) - 1):
            if "가" <= w[k] <= "힣" and "가" <= w[k + 1] <= "힣" and w[k] != w[k + 1]:
                out.append([*words[:i], w[:k] + w[k + 1] + w[k] + w[k + 2:], *words[i + 1:]])
    return out


def _organisation(text: str, p: Profile, learned: dict[str, str]) -> None:
    inner = re.search(r"\(([^()]{3,})\)\s*$", text)
    if inner:
        text = inner[1]
    text = re.sub(r"\(주\)|㈜", " ", text)
    words = [w for w in re.split(r"[\s,_\-]+", text) if w.strip(".") and w.strip(".") not in _FORMS]
    core, field = [], ""
    for w in words:
        f = learned.get(_letters(w)) or _field(w.strip("."))
        if f and not field and len(words) > 1:
            field = f
        else:
            core.append(w)
    if not field and core:
        word = core[-1]
        for k, f in _IN_KOREAN:
            if word.endswith(k) and len(word) > len(k):
                field, core[-1] = f, word[: -len(k)]
                break
        else:
            k = _letters(word)
            for end, f in sorted(_FIELD_KEYS.items(), key=lambda x: -len(x[0])):
                if len(end) > 4 and k.endswith(end) and len(k) > len(end) + 2:
                    field, core[-1] = f, k[: -len(end)]
                    break
    p.which = field
    p.forms = ["".join(map(_letters, core))]
    p.swaps = ["".join(map(_letters, c)) for c in _turned(core)]
    if not field and len(core) > 1:
        p.words = [(_letters(w), "".join(map(_letters, core[:k] + core[k + 1:]))) for k, w in enumerate(core)]


def _project(text: str, p: Profile) -> None:
    text = re.sub(r"\((\d+)차\)", r" \1 ", text)
    text = re.sub(r"\bv(?=\d)", " ", text)
    words = [w for w in re.split(r"[\s_\-.]+", text) if w]
    core, number = [], ""
    for k, w in enumerate(words):
        tail = re.match(r"^(\D*[^\W\d])(\d+)$", w)
        if w.isdigit():
            number = str(int(w))
        elif w in _ROMAN and k == len(words) - 1 and k > 0:
            number = str(_ROMAN[w])
        elif w in _PROJECT:
            continue
        elif tail and not number and any(x in _PROJECT for x in words):
            core.append(tail[1])
            number = tail[2]
        else:
            core.append(w)
    p.which = number
    p.forms = ["".join(map(_letters, core))]
    p.swaps = ["".join(map(_letters, c)) for c in _turned(core)]


def _person(raw: str, p: Profile) -> None:
    words = [w.casefold() for w in re.split(r"[\s,.]+", re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", raw)) if w]
    if len(words) > 1:
        words = [w for w in words if w not in _TITLES]
    # A last syllable of respect may as well be the name's own: both readings are taken.
    bare = [*words[:-1], _HONOURED.sub("", words[-1])] if words else []
    for reading in [words] if bare == words else [words, bare]:
        _read_person(reading, p)


def _read_person(words: list[str], p: Profile) -> None:
    long = [_letters(w) for w in words if len(w) > 1]
    p.swaps += ["".join(map(_letters, c)) for c in _turned([w for w in words if len(w) > 1])]
    short = [w for w in words if len(w) == 1 and w.isalpha() and not "가" <= w <= "힣"]
    if len(long) >= 2:
        a, b = long[0], "".join(long[1:])
        p.forms += [a + b, b + a]
        p.tokens += [(a, b), (b, a)]
        # Pet names show in the word as it is written: as letters, an l is an i.
        for word, family in ((words[0], b), (words[-1], a)):
            if word.isascii() and (m := _PET.match(word)):
                p.pet.append((_letters(m[1]), family))
    elif len(long) == 1 and short:
        p.initial.append((_letters(short[0]), long[0]))
    elif len(long) == 1:
        p.forms.append(long[0])
        if len(long[0]) > 6 and long[0].isascii() and words[0].isascii():
            p.initial.append((long[0][0], long[0][1:]))


def profile(kind: str, name: str, learned: dict[str, str] | None = None) -> Profile:
    """Profile of a spelling: `kind` is person, organization, project, or anything else (whole name)."""
    p = Profile()
    raw = unicodedata.normalize("NFKC", name).strip()
    text = raw.casefold()
    if kind == "person":
        _person(raw, p)
    elif kind == "organization":
        _organisation(text, p, learned or {})
    elif kind == "project":
        _project(text, p)
    else:
        p.forms = [_letters(text)]
    p.forms = [f for f in p.forms if f]
    return p


_ENTRY = "role string, which string, a string, b string"


def _entries(kind: str, name: str, learned: dict[str, str] | None = None) -> list[tuple[str, str, str, str]]:
    """(role, which, a, b) of a spelling. Roles: full and swap (a: a form, its own or one it may stand
    for), token (given, family), initial and pet (start of the given name, family), word (word, rest)."""
    p = profile(kind, name, learned)
    out = {("full", p.which, f, "") for f in p.forms} | {("swap", p.which, s, "") for s in p.swaps}
    out |= {("token", "", g, f) for g, f in p.tokens} | {("initial", "", i, f) for i, f in p.initial} | {("pet", "", g, f) for g, f in p.pet}
    return sorted(out | {("word", "", w, r) for w, r in p.words if w and r})


def _parse(spellings: DataFrame, learned: dict[str, str]) -> DataFrame:
    held = spellings.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf(f"array<struct<{_ENTRY.replace(' ', ':').replace(',:', ',')}>>")
    def parse(kinds: pd.Series, names: pd.Series) -> pd.Series:
        known = held.value
        return pd.Series([[dict(zip(("role", "which", "a", "b"), e, strict=True)) for e in _entries(k or "", n, known)] for k, n in zip(kinds, names, strict=True)], dtype=object)

    each = spellings.select("sid", "table_name", "kind", F.explode(parse("kind", "name")).alias("e"))
    return each.select("sid", "table_name", "kind", F.concat_ws(SEPARATOR, "table_name", "kind", "e.which").alias("scope"), "e.role", "e.a", "e.b")


def _learn_words(entries: DataFrame) -> dict[str, str]:
    """Words for fields that names show whose rest is known with a field in other spellings. A word
    counts by distinct rests; one that several hundred names share is a word of a language, so their
    number is that of a vocabulary, not of the names."""
    word = entries.filter("role = 'word'").select("table_name", "kind", F.col("a").alias("word"), F.col("b").alias("form")).distinct()
    field = entries.filter("role = 'full'").select("table_name", "kind", F.element_at(F.split("scope", SEPARATOR), -1).alias("field"), F.col("a").alias("form")).filter("field <> ''").distinct()
    shared = word.join(field, ["table_name", "kind", "form"]).groupBy("word", "field").agg(F.count_distinct("form").alias("n"))
    known = word.join(field.select("table_name", "kind", "form").distinct(), ["table_name", "kind", "form"]).groupBy("word").agg(F.count_distinct("form").alias("of"))
    good = shared.join(known, "word").filter((F.col("n") >= LEARNED[0]) & (F.col("n") >= LEARNED[1] * F.col("of")))
    return {r.word: r.field for r in good.groupBy("word").agg(F.max_by("field", F.struct("n", "field")).alias("field")).collect()}


def _deletions(form: Column) -> Column:
    """A string and, from six letters on, what it is without any one of its letters."""
    n = F.length(form)
    less = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substring(form, F.lit(1), k - 1), F.substring(form, k + 1, n)))
    return F.when(n >= 6, F.array_distinct(F.array_append(less, form))).otherwise(F.array(form))


def components(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """labels (sid, label) after joining what links (a, b: labels) connect: the smallest label of each
    component, by repeated minimum over neighbours and shortcut, each step a written table, until none moves."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both, f"{name}-links")
    nodes = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), f"{name}-low")
    for k in itertools.count():
        near = both.join(nodes.select(F.col("a").alias("b"), "low"), "b").groupBy("a").agg(F.min("low").alias("least"))
        hop = nodes.select(F.col("a").alias("low"), F.col("low").alias("lower"))
        step = nodes.join(near, "a").join(hop, "low", "left")
        after = cut(step.select("a", F.least("low", "least", "lower").alias("low"), F.col("low").alias("was")), f"{name}-low-{k}")
        moved = not after.filter("low <> was").isEmpty()
        nodes = after.drop("was")
        if not moved:
            break
    joined = labels.join(nodes.select(F.col("a").alias("label"), "low"), "label", "left")
    return cut(joined.select("sid", F.coalesce("low", "label").alias("label")), f"{name}-labels")


def _first_links(entries: DataFrame, named: DataFrame) -> DataFrame:
    """Spellings (a, b) of equal forms, of forms one slip apart, and of one id."""
    full = entries.filter("role = 'full'").select("scope", F.col("a").alias("form"), "sid")
    first = cut(full.groupBy("scope", "form").agg(F.min("sid").alias("first")), "variants-forms")
    turned = entries.filter("role = 'swap'").select("scope", F.col("a").alias("form"), "sid")
    equal = full.unionByName(turned).distinct().join(first, ["scope", "form"]).filter("sid <> first").select(F.col("sid").alias("a"), F.col("first").alias("b"))
    # A block holds what one added letter can make of a string, so its list is bounded whatever the names.
    keyed = first.select(F.explode(_deletions(F.col("form"))).alias("less"), "scope", "form", "first")
    blocks = keyed.groupBy(F.xxhash64("scope", "less").alias("k")).agg(F.collect_set(F.struct("form", "first", "scope")).alias("l")).filter(F.size("l") > 1)
    pairs = blocks.select(F.explode("l").alias("x"), "l").select("x", F.explode("l").alias("y")).filter((F.col("x.form") < F.col("y.form")) & (F.col("x.scope") == F.col("y.scope")))
    apart = F.levenshtein("x.form", "y.form")
    swapped = (apart == 2) & (F.length("x.form") == F.length("y.form")) & (F.array_sort(F.split("x.form", "")) == F.array_sort(F.split("y.form", "")))
    near = pairs.filter((apart == 1) | swapped).select(F.col("x.first").alias("a"), F.col("y.first").alias("b"))
    # Spellings of one id are one: the id's smallest stands for the rest.
    by_id = named.groupBy("table_name", "entity_id").agg(F.min("sid").alias("b"))
    held = named.join(by_id, ["table_name", "entity_id"]).filter("sid <> b").select(F.col("sid").alias("a"), "b")
    return equal.unionByName(near).unionByName(held)


def _wanted_families(entries: DataFrame) -> DataFrame:
    """scope, role, wanted, family: the families that a bare initial's or pet name's family may stand
    for, itself or one slip apart for initials. It is found once, for families as they are written."""
    want = entries.filter("role in ('initial', 'pet')").select("scope", "role", F.col("b").alias("wanted")).distinct()
    family = entries.filter("role = 'token'").select("scope", F.col("b").alias("family")).distinct()
    left = want.filter("role = 'initial'").select("scope", "wanted", F.explode(_deletions(F.col("wanted"))).alias("rest"))
    near = left.join(family.select("scope", "family", F.explode(_deletions(F.col("family"))).alias("rest")), ["scope", "rest"])
    near = near.select("scope", F.lit("initial").alias("role"), "wanted", "family").distinct()
    return cut(near.unionByName(want.filter("role = 'pet'").withColumn("family", F.col("wanted"))), "variants-wanted")


def _rematch(entries: DataFrame, labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Profiles (a, b: labels) that go together now that others have merged.

    A profile's names are all its given names with all its families, whichever spelling had which.
    Blocks are summed up to their least and greatest profile, so that a family name that many share
    makes no pairs: what an initial or pet name fits is one profile only if both are the same.
    """
    of = entries.filter("role in ('token', 'initial', 'pet')").join(labels, "sid").select("scope", "role", "a", "b", "sid", "label")
    token = of.filter("role = 'token'")
    given, family = token.select("scope", "label", F.col("a").alias("given")).distinct(), token.select("scope", "label", F.col("b").alias("family")).distinct()
    names = cut(given.join(family, ["scope", "label"]).filter("given <> family"), "variants-united")
    forms = names.select("scope", F.concat("given", "family").alias("form"), "label").distinct()
    met = forms.join(forms.groupBy("scope", "form").agg(F.min("label").alias("b"), F.max("label").alias("most")).filter("b <> most"), ["scope", "form"])
    met = met.filter("label <> b").select(F.col("label").alias("a"), "b")
    asked = names.join(wanted.select("scope", "family").distinct(), ["scope", "family"], "left_semi")
    # A pet name doesn't fit itself.
    starts = F.filter(F.transform(F.sequence(F.lit(2), F.length("given") - 1), lambda k: F.left(F.col("given"), k)), lambda x: x != F.regexp_extract("given", f"^{_PET.pattern}", 1))
    has = asked.select("scope", F.lit("initial").alias("role"), F.left("given", F.lit(1)).alias("start"), "family", "label")
    has = has.unionByName(asked.filter(F.length("given") > 2).select("scope", F.lit("pet").alias("role"), F.explode(starts).alias("start"), "family", "label"))
    block = ["scope", "role", "start", "family"]
    has = cut(has.distinct(), "variants-has")
    wants = of.filter("role <> 'token'").select("scope", "role", "sid", "label", F.col("a").alias("start"), F.col("b").alias("wanted")).join(wanted, ["scope", "role", "wanted"])
    ends = has.groupBy(*block).agg(F.min("label").alias("low"), F.max("label").alias("high"))
    fits = wants.join(ends, block).groupBy("role", "sid", "label").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # A spelling that has its profile already looks for no other.
    inside = wants.join(has, [*block, "label"], "left_semi").select("role", "sid").distinct()
    one = fits.filter("low = high and low <> label").join(inside, ["role", "sid"], "left_anti").select(F.col("label").alias("a"), F.col("low").alias("b"))
    return met.unionByName(one).distinct()


def link_variants(entities: DataFrame) -> DataFrame:
    """The class of each id whose names name the same.

    entities: table_name, entity_id, kind, name. Ids with null names are their own class; an id with
    several names (repeated rows, periods) holds them together; names of different kinds, of different
    fields of business or of different project numbers are never the same, nor are a person's initial
    or pet name that fit several people. Extra columns are ignored; no entities give no row.

    Result: table_name, entity_id, class_id (the smallest id by text of the class).
    """
    given = entities.select("table_name", "entity_id", "kind", "name").filter("entity_id is not null").distinct()
    named = given.filter("name is not null").withColumn("kind", F.coalesce("kind", F.lit("")))
    named = cut(named.withColumn("sid", F.md5(F.to_json(F.struct("table_name", "kind", "name")).cast("binary"))), "variants-named")
    spellings = cut(named.select("sid", "table_name", "kind", "name").distinct(), "variants-spellings")
    entries = cut(_parse(spellings, {}), "variants-entries")
    learned = _learn_words(entries)
    if learned:
        open_names = entries.filter("role = 'word'").select("sid").distinct()
        again = _parse(spellings.join(open_names, "sid", "left_semi"), learned)
        entries = cut(entries.join(open_names, "sid", "left_anti").unionByName(again), "variants-entries")
    wanted = _wanted_families(entries)
    labels = components(spellings.select("sid", F.col("sid").alias("label")), _first_links(entries, named), "variants-0")
    for k in itertools.count(1):
        links = cut(_rematch(entries, labels, wanted), f"variants-more-{k}")
        if links.isEmpty():
            break
        labels = components(labels, links, f"variants-{k}")
    ids = named.join(labels, "sid").select("table_name", "entity_id", "label").distinct()
    smallest = ids.groupBy("table_name", "label").agg(F.min("entity_id").alias("class_id"))
    linked = ids.join(smallest, ["table_name", "label"]).select("table_name", "entity_id", "class_id")
    unnamed = given.filter("name is null").join(ids, ["table_name", "entity_id"], "left_anti").select("table_name", "entity_id", F.col("entity_id").alias("class_id"))
    return linked.unionByName(unnamed)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "entities").select(F.lit("entities").alias("table_name"), "entity_id", F.col("entity_type").alias("kind"), F.col("label").alias("name"))
    kg = table(spark, sf_dir, "kg_entities").select(F.lit("kg_entities").alias("table_name"), F.col("id").alias("entity_id"), F.col("entity_type").alias("kind"), F.coalesce("name", "normalized_name").alias("name"))
    return entities.unionByName(kg)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = cut(link_variants(_rows(spark, sf_dir)), "variants-found")
    other = linked.select("table_name", "class_id", F.col("entity_id").alias("id_b"))
    pairs = linked.withColumnRenamed("entity_id", "id_a").join(other, ["table_name", "class_id"]).filter("id_a < id_b")
    return pairs.select("table_name", "id_a", "id_b").distinct()


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_variants(_rows(spark, sf_dir))


QUERIES = {"p7_found": p7_found, "p7_classes": p7_classes}
SQL: dict[str, str] = {}
