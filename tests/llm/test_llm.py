"""The operators of quernlake.llm against brute force, with the cases that data bring along."""

from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import quernlake.llm as llm
from quernlake.llm import conversations, forms, mixing, personal, splitting, subjects, tokens, variants, vectors

MODULES = llm.query_modules()
CHECKED = [(n, m) for m in MODULES for n in m.QUERIES if n in m.SQL]
NULL = None


@pytest.mark.parametrize(("name", "module"), CHECKED, ids=[n for n, _ in CHECKED])
def test_same_as_sql(spark, data, same_rows, name, module):
    same_rows(module.QUERIES[name](spark, data), module.SQL[name])


# Splitting


@pytest.mark.parametrize("seed", range(30))
def test_pieces_keep_limit_cover_and_overlap(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["ab", "가나", " ", ". ", "\n", "\n\n", "😀", "é"]) for _ in range(rng.randrange(1, 900)))
    limit, overlap = rng.choice([(50, 0), (80, 20), (33, 10), (7, 3)])
    spans = splitting.split_text(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(e - s <= limit for s, e in spans)
    if len(text) > limit:
        assert all(a[1] - b[0] == min(overlap, (limit - 1) // 2) for a, b in itertools.pairwise(spans))
        least = -(-(len(text) - overlap) // (limit - overlap))
        assert least <= len(spans) <= 2 * least + 2
    else:
        assert spans == [(0, len(text))]


def test_pieces_end_at_boundaries():
    text = "\n\n".join("x" * 90 for _ in range(10))
    assert all(text[e - 2 : e] == "\n\n" for _, e in splitting.split_text(text, 200)[:-1])
    solid = "z" * 1001
    assert max(e - s for s, e in splitting.split_text(solid, 100, 10)) <= 100


def test_pieces_by_message():
    text = "[room] head\n" + "\n".join(f"{n}: message number {k}" for k, n in enumerate(itertools.islice(itertools.cycle(["Kim", "Lee Ann"]), 40)))
    at = splitting.message_offsets(text, ["Kim", "Lee Ann"])
    assert len(at) == 40
    spans = splitting.split_text(text, 200, 3, True, at)
    assert all(e - s <= 200 for s, e in spans)
    for a, b in itertools.pairwise(spans):
        assert b[0] in at and sum(b[0] <= m < a[1] for m in at) == 3


def test_split_items_of_odd_rows(spark):
    shape = "table_name string, row_id string, text string, max_chars int, overlap_size int, overlap_unit string, names array<string>, first_seq int, last_seq int, known_seqs array<struct<seq:int,text:string>>, chunk_index int"
    chat = "[r] h\n" + "\n".join(f"A: {w * 20}" for w in "xyz")
    rows = [
        ("t", "1", NULL, 10, 2, "chars", NULL, NULL, NULL, NULL, 5), ("t", "2", "", 10, 2, "chars", NULL, NULL, NULL, NULL, 5), ("t", "3", "short", 10, 2, "chars", NULL, NULL, NULL, NULL, 5),
        ("t", "4", "w" * 25, 10, 2, "chars", NULL, NULL, NULL, NULL, 5), ("t", "4", "w" * 25, 10, 2, "chars", NULL, NULL, NULL, NULL, 5),
        ("c", "5", chat, 40, 1, "messages", ["A"], 7, 11, [(7, "x" * 20), (9, "y" * 20), (11, "z" * 20)], 5), ("t", "6", "a b " * 50_000, 1000, 100, "chars", NULL, NULL, NULL, NULL, 5),
    ]
    got = splitting.split_items(spark.createDataFrame(rows, shape)).collect()
    assert {r.row_id for r in got} == {"4", "5", "6"}
    assert sum(r.row_id == "4" for r in got) == 2 * 3
    chat_pieces = sorted((r.chunk_index, r.start_seq, r.end_seq) for r in got if r.row_id == "5")
    assert chat_pieces[0][1] == 7 and chat_pieces[-1][2] == 11
    assert splitting.split_items(spark.createDataFrame([], shape)).count() == 0


# Conversations


def brute_conversations(rows, members):
    by_room = {}
    for i, room, seq, at, sender, kind, text, _ in rows:
        by_room.setdefault(room, {}).setdefault(seq, []).append((at, sender, kind in ("text", "link") and bool((text or "").strip("​ \n"))))
    out = set()
    for room, positions in by_room.items():
        runs, last = [], None
        for seq in sorted(positions):
            at = min(x[0] for x in positions[seq])
            if last is None or at - last > timedelta(minutes=30):
                runs.append([])
            runs[-1].append((seq, at))
            last = at
        for run in runs:
            said = {s for q, _ in run for _, s, u in positions[q] if u}
            broken = any(b[0] != a[0] + 1 or b[1] < a[1] for a, b in itertools.pairwise(run))
            broken |= any(len({x[1] for x in positions[q]}) > 1 for q, _ in run) or any((room, s) not in members for s in said)
            if broken or len(said) < 2:
                out.add((room, run[0][0]))
    return out


def test_conversations_over_blocks_and_late_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_BITS", 3)
    rng = random.Random(3)
    rows, n = [], 1
    for room in (1, 2):
        at = datetime(2015, 1, 1)
        for seq in range(1, 150):
            at += timedelta(minutes=rng.choice([1, 2, 5, 29, 31, 90] if rng.random() > 0.02 else [-3]))
            if rng.random() < 0.03:
                continue
            for _ in range(rng.choice([1, 1, 1, 2])):
                sender = rng.choice([10, 11, 12]) if rng.random() > 0.02 else rng.choice([None, 99])
                rows.append((n, room, seq, at, sender if _ == 0 or rng.random() < 0.2 else rows[-1][4], rng.choice(["text", "text", "link", "media"]), rng.choice(["hi", "​", None, "yo"]), at + timedelta(hours=rng.choice([0, 5]))))
                n += 1
    rng.shuffle(rows)
    shape = "id bigint, room_id int, seq int, sent_at timestamp_ntz, sender_id int, msg_type string, text string, loaded_at timestamp"
    path = str(tmp_path / "messages.parquet")
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(path)
    members = spark.createDataFrame([(r, s, role) for r in (1, 2) for s, role in ((10, "host"), (11, "member"), (12, None))], "room_id int, id int, speaker_role string")
    whole, _ = conversations.conversations(conversations.emit(spark, path, members, False))
    got = {(r.room_id, r.start_seq) for r in whole.filter("broken or empty or unanswered").collect()}
    assert got == brute_conversations(rows, {(r, s) for r in (1, 2) for s in (10, 11, 12)})


def test_rows_of_later_batches_are_waited_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_BITS", 3)
    monkeypatch.setattr(conversations, "EDGE_BITS", 4)
    rng = random.Random(5)
    at, rows = datetime(2015, 1, 1), []
    for seq in range(1, 120):
        at += timedelta(minutes=rng.choice([1, 2, 5, 40]))
        rows.append((seq, 1, seq, at, rng.choice([10, 11]), "text", "hi", at + timedelta(days=rng.choice([0, 0, 9]))))
    rows.sort(key=lambda r: r[7])
    late = (999, 1, 8, rows[0][3], 99, "text", "too late", datetime(2015, 6, 1))
    shape = "id bigint, room_id int, seq int, sent_at timestamp_ntz, sender_id int, msg_type string, text string, loaded_at timestamp"
    members = spark.createDataFrame([(1, 10, "host"), (1, 11, "member")], "room_id int, id int, speaker_role string")
    path, beats, folder = str(tmp_path / "m"), str(tmp_path / "beats"), str(tmp_path / "run")
    spark.createDataFrame([], shape).write.parquet(beats)
    # Each part is a run of its own: what the state holds goes on from run to run.
    for part in (rows[:40], rows[40:90], rows[90:]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(path)
        conversations.run_stream(spark, path, beats, folder, members, True)
    assert not list((tmp_path / "run" / "out").glob("*.parquet")) or spark.read.schema(conversations._OUT).parquet(f"{folder}/out").count() == 0
    for n, when in ((1, datetime(2015, 5, 1)), (2, datetime(2015, 9, 1))):
        spark.createDataFrame([(None, None, 0, None, None, None, None, when)], shape).write.mode("append").parquet(beats)
        conversations.run_stream(spark, path, beats, folder, members, True)
        spark.createDataFrame([late], shape).coalesce(1).write.mode("append").parquet(path)
    out = spark.read.schema(conversations._OUT).parquet(f"{folder}/out")
    whole, _ = conversations.conversations(out)
    got = [(r.room_id, r.start_seq) for r in whole.filter("broken or empty or unanswered").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_conversations(rows, {(1, 10), (1, 11)})
    assert out.filter("kind = 'edge'").groupBy("room_id", "block", "part").count().filter("count > 1").count() == 0


def test_no_messages(spark, tmp_path):
    shape = "id bigint, room_id int, seq int, sent_at timestamp_ntz, sender_id int, msg_type string, text string, loaded_at timestamp"
    spark.createDataFrame([], shape).write.parquet(str(tmp_path / "m.parquet"))
    members = spark.createDataFrame([], "room_id int, id int, speaker_role string")
    assert conversations.emit(spark, str(tmp_path / "m.parquet"), members, True).count() == 0


# Vectors


def test_similar_vectors_like_brute_force(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((6, 64))
    x = (centers[rng.integers(0, 6, 900)] + 0.7 * rng.standard_normal((900, 64))).astype(np.float32)
    x[400:406] = x[7]  # copies
    rows = [("p", f"{k:04d}", [float(v) for v in x[k]], True, k) for k in range(len(x))]
    bad = [("p", "n1", None, True, 0), ("p", "n2", [0.0] * 64, True, 0), ("p", "n3", [1.0] * 32, True, 0), ("p", "n4", [float("nan")] + [1.0] * 63, True, 0), ("p", None, [1.0] * 64, True, 0), ("p", "n5", [None] + [1.0] * 63, True, 0)]
    df = spark.createDataFrame([*rows, *rows[:30], *bad], "part string, id string, vector array<float>, asked boolean, cosine int")
    got = {}
    for r in vectors.similar_vectors(df, 10, cell_rows=200).collect():
        got.setdefault(r.id, {})[r.neighbour] = r.cosine
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = sum(len({f"{j:04d}" for j in np.argsort(-s[k])[:10]} & set(got[f"{k:04d}"])) for k in range(len(x)))
    assert hits / (10 * len(x)) > 0.9
    assert all(len(v) <= 10 for v in got.values()) and not {"n1", "n2", "n3", "n4", "n5"} & set(got)
    copies = {"0007", *(f"{k:04d}" for k in range(400, 406))}
    assert all(copies - {c} <= set(got[c]) for c in copies)


def test_cells_of_two_levels(spark, monkeypatch):
    monkeypatch.setattr(vectors, "COARSE", 4)
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((40, 64))
    x = (centers[rng.integers(0, 40, 3000)] + 0.6 * rng.standard_normal((3000, 64))).astype(np.float32)
    df = spark.createDataFrame([("p", f"{k:04d}", [float(v) for v in x[k]], k % 10 == 0) for k in range(len(x))], "part string, id string, vector array<float>, asked boolean")
    got = {}
    for r in vectors.similar_vectors(df, 10, cell_rows=100).collect():
        got.setdefault(int(r.id), set()).add(int(r.neighbour))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, 3000, 10)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -2
    assert sum(len(set(np.argsort(-s[n])[:10]) & got[a]) for n, a in enumerate(asked)) > 0.9 * 10 * len(asked)


def test_few_and_no_vectors(spark):
    shape = "part string, id string, vector array<float>, asked boolean"
    assert vectors.similar_vectors(spark.createDataFrame([], shape)).count() == 0
    two = spark.createDataFrame([("p", "a", [1.0] * 64, True), ("p", "b", [1.0] * 63 + [0.5], True)], shape)
    assert sorted((r.id, r.neighbour) for r in vectors.similar_vectors(two).collect()) == [("a", "b"), ("b", "a")]


def test_large_cells_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(1)
    x = (1 + 0.3 * rng.standard_normal((300, 64))).astype(np.float32)
    df = spark.createDataFrame([("p", f"{k:03d}", [float(v) for v in x[k]], True) for k in range(300)], "part string, id string, vector array<float>, asked boolean")
    got = {}
    for r in vectors.similar_vectors(df, 5, cell_rows=10_000).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert sum(len({f"{j:03d}" for j in np.argsort(-s[k])[:5]} & got[f"{k:03d}"]) for k in range(300)) > 0.9 * 1500


# Personal information


def test_shapes_of_identifiers():
    def kinds(t):
        return [(s.seed, s.instance) for s in personal.strict_spans(personal.fold(t))]

    assert kinds("메일 a.b+c＠mail.test 입니다") == [("email", "a.b+c@mail.test")]
    assert kinds("x 골뱅이 y.test") == [("email", "x 골뱅이 y.test")]
    assert kinds("left-pad@1.4.0 과 @property") == []
    assert [k for k, _ in kinds("번호 공일공 1009에 7967, +82 10-1794-4531, (031) 180-3295, ０１０－０１３２－５５５８, +1 (202) 555-0145")] == ["phone"] * 5
    assert [k for k, _ in kinds("891020-1655974 850624 - 3611586 7610021838823 M49006348 14-11-228947-21")] == ["id_number"] * 5
    assert kinds("회의 ID 822 2242 1627, 주문번호 096326568136, #44643959, 192.168.7.38") == []
    assert [k for k, _ in kinds("누리시 샘터읍 꽃내음로 14, 120동 751호 / 가온시 여울동 431-23번지 / 561 Ostrich Hollow Rd., Apt 3")] == ["address"] * 3


def test_names_by_learned_contexts(spark):
    names = [f"{s}{g}" for s in "김이박최" for g in ("하늘", "도담", "샛별", "온슬")]
    texts = [f"정리는 {n} 담당이에요" for n in names] + [f"ask {n} about it" for n in names] + ["정리는 운영진 담당이에요", "샛별 보러 가요", "정리는 정도담 담당이에요", "정리는 샛별 씨 담당이에요", None, "", "메일 a@b.test 요"]
    rows = spark.createDataFrame([("t", n, t, 1) for n, t in enumerate(texts)], "table_name string, row_id bigint, text string, pii_types int")
    seeds = spark.createDataFrame([(n,) for n in [*names, None, "", "zz9"]], "name string")
    got = {r.row_id: (r.text, r.pii_types) for r in personal.mask_personal(rows, seeds).collect()}
    assert got[0] == ("정리는 [NAME] 담당이에요", ["name"]) and got[16][1] == ["name"]
    assert [got[k][1] for k in range(32, 36)] == [[], [], [], ["name"]]
    assert got[36] == (None, []) and got[37] == ("", []) and got[38] == ("메일 [EMAIL] 요", ["email"])
    assert personal.mask_personal(rows.limit(0), seeds.limit(0)).count() == 0


@pytest.mark.parametrize("times", [1, 10])
def test_words_that_are_also_names_at_any_size(spark, times):
    rng = random.Random(11)
    given = ["하늘", "도담", "샛별", "온슬", "햇살", "노을"]
    names = [f"{s}{g}" for s in "김이박최정강" for g in given]
    decoys = ["샛별 보러 가고 싶다", "햇살 좋은 날 모여요", "노을 소리 좋다"]
    texts = []
    for _ in range(120 * times):
        n = rng.choice(names if rng.random() < 0.7 else given)
        texts += [(rng.choice([f"정리는 {n} 담당이에요", f"어제 {n} 만났어요", f"{n} 왔나요?"]), True), *((rng.choice(decoys), False) for _ in range(8)), (f"오늘 {rng.randrange(60)}시에 모여요", False)]
    rows = spark.createDataFrame([("t", k, t) for k, (t, _) in enumerate(texts)], "table_name string, row_id bigint, text string")
    seeds = spark.createDataFrame([(n,) for n in names[::2]], "name string")
    found = {r.row_id for r in personal.mask_personal(rows, seeds).collect() if "name" in r.pii_types}
    true = {k for k, (_, t) in enumerate(texts) if t}
    assert len(found & true) >= 0.95 * len(found) and len(found & true) >= 0.95 * len(true)


def test_addresses_by_learned_contexts(spark):
    rng = random.Random(12)
    whole = [f"책은 누리시 샘터구 꽃내음로 {k} 로 부쳐주세요" for k in range(1, 40)]
    texts = [*whole, "책은 물가리 언덕길 7 로 부쳐주세요", "Lane 4 is the fast one", "언덕길 7 장 읽었어요", *(f"{rng.randrange(90)}분만 늦을게요" for _ in range(40))]
    rows = spark.createDataFrame([("t", k, t) for k, t in enumerate(texts)], "table_name string, row_id bigint, text string")
    got = {r.row_id: r.pii_types for r in personal.mask_personal(rows, spark.createDataFrame([], "name string")).collect()}
    assert all(got[k] == ["address"] for k in range(40)) and got[40] == got[41] == []


def test_known_names_with_rare_parts_are_masked(spark, monkeypatch):
    common = [f"{s}{g}" for s in "김이박최" for g in ("하늘", "도담", "샛별", "온슬")]
    rare = ["남궁", "제갈가온", "표누리", "zoe quill"]
    texts = [f"정리는 {n} 담당이에요" for n in [*common, *rare]] + ["정리는 운영진 담당이에요", "표누리 보러 가요"]
    rows = spark.createDataFrame([("t", n, t) for n, t in enumerate(texts)], "table_name string, row_id bigint, text string")
    seeds = spark.createDataFrame([(n,) for n in common + rare], "name string")
    for most in (personal.MOST, 0.5):
        monkeypatch.setattr(personal, "MOST", most)  # 0.5: nothing is frequent enough to be sent everywhere
        got = {r.row_id: r.text for r in personal.mask_personal(rows, seeds).collect()}
        assert [got[n] for n in range(20)] == ["정리는 [NAME] 담당이에요"] * 20
        assert got[20] == texts[20] and got[21] == texts[21]


# Copies that differ in form


def test_forms(spark):
    rows = [
        ("t", "1", "Hello, World!", False), ("t", "2", "hello world", False), ("t", "3", "ＨＥＬＬＯ　ｗｏｒｌｄ", False), ("t", "4", "hello​ worlds", False), ("t", "2", "hello world", False),
        ("t", "5", None, False), ("t", "6", " ​\n", False), ("u", "7", "Hello, World!", False), ("t", "8", "…", False), ("t", "9", "---", False),
        ("d", "a", '{"x": "1 a", "y": [1, 2]}', True), ("d", "b", '{"y":[1,2],"x":"1  A"}', True), ("d", "c", "x: 1 a\nz: 2", True), ("d", "e", "---\nZ : 2\nX: 1A\n---", True), ("d", "f", '{"y": [2, 1], "x": "1 a"}', True),
        ("d", "g", "q" * 200_000, True), ("d", "h", "Q " * 200_000, True),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "table_name string, row_id string, text string, fields boolean, n string")
    for hot in (1_000_000, 1):
        classes, members = forms.copy_classes(df, hot)
        assert {(r.table_name, r.row_id): r.n_copies for r in classes.collect() if r.n_copies > 1} == {("t", "1"): 4, ("t", "8"): 2, ("d", "a"): 2, ("d", "c"): 2, ("d", "g"): 2}
        assert {(r.row_id, r.class_id) for r in members.collect()} >= {("2", "1"), ("3", "1"), ("b", "a"), ("e", "c"), ("h", "g")}
        assert not {"8", "9"} & {r.row_id for r in members.collect()}
    assert forms.copy_classes(df.limit(0))[0].count() == 0


# Variant spellings


def test_variants(spark):
    same = [
        ("organization", ["Toljok Software Co., Ltd.", "(주)톨족 소프트웨어", "TOLJOK-SOFTWARE", "TS (Toljok Software)", "Tojlok Software", "The Toljok Software Group", "톨족 Software"]),
        ("organization", ["Toljok Foods Inc.", "Toljok F&B"]), ("project", ["Project Rinchek 8", "린첵(8차)", "rinchek-8", "Proj. Rinchek v8", "린첵 프로젝트 Ⅷ"]), ("project", ["Project Rinchek 3"]),
        ("person", ["Gulgum Neljelchok", "Neljelchok, Gulgum", "G. Neljelchok", "Dr. Gulgum Neljelchok", "NELJELCHOK GULGUM", "굴굼 넬젤촉", "Guly Neljelchok", "GulgumNeljelchok"]),
        ("person", ["Hamten Mamjuhem"]), ("person", ["Hanrum Mamjuhem"]), ("person", ["H. Mamjuhem"]),
    ]
    rows = [("t", f"{g:02d}-{k}", kind, name, 1) for g, (kind, names) in enumerate(same) for k, name in enumerate(names)] + [("t", "zz", "person", None, 1), ("t", None, "person", "A B", 1)]
    got = {r.entity_id: r.class_id for r in variants.link_variants(spark.createDataFrame(rows, "table_name string, entity_id string, kind string, name string, class_id int")).collect()}
    assert got == {r[1]: (f"{r[1][:2]}-0" if r[1] != "zz" else "zz") for r in rows if r[1]}
    assert variants.link_variants(spark.createDataFrame([], "table_name string, entity_id string, kind string, name string")).count() == 0


# Tokens


def test_tokens_like_the_library(spark):
    import public_tokenizers
    import tiktoken

    ranks = tokens.read_ranks(tokens.vocabulary_path())
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n  x", "it's <|endoftext|> fine", "가나다라 마바사　😀é́", "a" * 5000, "한" * 700, "\x00\x07​", "1234567890 12", "x   y "]
    texts += ["".join(rng.choice("abc가 \n1!é😀'sT") for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate([*texts, "it's"])] + [(0, None, "x")], "doc_id bigint, text string, ids string")
    rows = tokens.encode_corpus(docs)
    got = {r.doc_id: list(r.ids) for r in rows.collect()}
    assert rows.count() == len(texts) + 2
    assert all(got[n] == (reference.encode_ordinary(t) if t else []) for n, t in enumerate(texts))
    back = {r.doc_id: r.t for r in rows.select("doc_id", tokens.decode_ids(F.col("ids")).alias("t")).collect()}
    assert all(back[n] == (t or "") for n, t in enumerate(texts))
    assert tokens.encode_corpus(docs.limit(0)).count() == 0


# Mixing


def test_mix_reaches_shares(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(n, rng.choice(["a", "a", "a", "b"]), rng.randrange(1, 400), 0.1) for n in range(3000)] + [(9001, "c", 500, 0.1), (9002, None, 10, 0.1), (9003, "z", 10, 0.1), (9004, "a", 0, 0.1), (9005, "a", None, 0.1)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens int, copies double")
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("d", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(df, goals)
    rows, shares = mix.collect(), {r.source: r for r in report.collect()}
    assert max(r.copies for r in rows if r.source == "a") == 1 and max(r.copies for r in rows) <= 3
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"a", "b"}
    assert abs(shares["a"].share - 5 / 9) < 0.01 and abs(shares["b"].share - 4 / 9) < 0.01 and shares["d"].share == 0
    again = {(r.doc_id, r.copies) for r in mixing.mix_sources(df, goals)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    monkeypatch.setattr(mixing, "EDGE_ROWS", 0)  # narrowed down to the last bit
    assert {(r.doc_id, r.copies) for r in mixing.mix_sources(df, goals)[0].collect()} == again
    with pytest.raises(ValueError, match="targets"):
        mixing.mix_sources(df, spark.range(5000).selectExpr("cast(id as string) source", "0.0 target_share", "1 max_repeats"))
    fixed = {r.source: r.tokens for r in mixing.mix_sources(df, goals, total_tokens=100_000)[1].collect()}
    assert abs(fixed["a"] - 50_000) < 400 and abs(fixed["b"] - 40_000) < 400
    assert mixing.mix_sources(df.limit(0), goals)[0].count() == 0


# Subjects


def test_subjects_on_held_out_labels(spark, monkeypatch):
    rng = random.Random(8)
    words = {a: [f"{a}{c}{v}" for c in "bdgkmn" for v in ("ara", "oro", "ulu")] for a in ("law", "sport", "code")}
    filler = ["This paragraph is a draft.", "More on this in the next note.", "I cut a few lines."]
    docs, truth = [], {}
    for n in range(900):
        a = rng.choice(sorted(words))
        s = [f"We compared the {rng.choice(words[a])} with the {rng.choice(words[a])} this week." for _ in range(rng.randrange(3, 7))]
        s += rng.sample(filler, 2)
        rng.shuffle(s)
        docs.append((n, "# heading\n\n" + " ".join(s) + f"\n\ntags: {words['law'][0]} #{words['sport'][1]}", "x"))
        truth[n] = {a}
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, " ".join(filler), "x"), (1003, "# lawbara\n\n- sportbara", "x"), (0, docs[0][1], "x")]
    labels = [(n, next(iter(truth[n])) if rng.random() > 0.05 else "law") for n in range(0, 900, 4)] + [(1002, None), (5, None), (None, "law")]
    df, lab = spark.createDataFrame(docs, "doc_id bigint, text string, area string"), spark.createDataFrame(labels, "doc_id bigint, area string")
    got = {}
    for r in subjects.assign_subjects(df, lab, [(a, a) for a in words]).collect():
        got.setdefault(r.doc_id, set()).add(r.area)
    held = [n for n in range(900) if n % 4]
    assert sum(got.get(n) == truth[n] for n in held) / len(held) > 0.97
    assert not {1000, 1001, 1002, 1003} & set(got)
    # Terms beyond the vocabulary are folded in: with half of them there are as many right.
    monkeypatch.setattr(subjects, "MOST_TERMS", 40)
    again = {}
    for r in subjects.assign_subjects(df, lab, [(a, a) for a in words]).collect():
        again.setdefault(r.doc_id, set()).add(r.area)
    assert sum(again.get(n) == truth[n] for n in held) / len(held) > 0.9
    assert subjects.assign_subjects(df.limit(0), lab, [("law", "law")]).count() == 0
    assert subjects.assign_subjects(df, lab, []).count() == 0


def test_sentences():
    text = "---\ntitle: x\n---\n# Head.\n- [ ] One is here. Two?\n| a. | b. |\n<p>Three.</p>\nuser-01: Four is so.\n키워드 — a · b\n```\nfive.\n```\n"
    assert subjects.sentences(text) == ["One is here.", "Two?", "Three.", "Four is so."]
