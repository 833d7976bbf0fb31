"""Training-data operators: brute force, round trips, held-out accuracy and edge cases."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vellumine.llm import lookalikes as L, mixing as M, packing as B, pairs as P, quality as Q, sentences as S, spans as X, splitting as C, tokens as K, truncation as U
from vellumine.llm.common import WHITE_SPACE

WORDS = re.compile("[^" + re.escape(WHITE_SPACE) + "]+")
CHUNK = "chunk_uid bigint, doc_id bigint, chunk_id int, text string, prev_context_tail string, para_indices array<int>, elements array<struct<para_idx int>>, piece int, text2 string"
RESULT = "result_id bigint, doc_id bigint, chunk_id int, original_text string, humanized_text string, status string, skipped boolean, is_protected boolean, source string, ingested_at timestamp, t string, o int, field string"


def result_rows(*rows):
    """(id, original, answer, status) with the rest filled in; the last columns clash with names used inside."""
    return [(i, 1, i, o, h, s, None, None, "a", None, "t", 1, "f") for i, o, h, s in rows]


# ---- 1 splitting
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#-|。，é", max_size=300), st.integers(1, 8), st.integers(5, 40))
def test_pieces_round_trip_and_keep_limits(text, words, chars):
    ends = C.split_points(text, words, chars)
    pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
    assert "".join(pieces) == text
    assert all(len(p) <= chars and len(WORDS.findall(p)) <= words for p in pieces)
    assert (len(pieces) > 1) == (len(text) > chars or len(WORDS.findall(text)) > words)


def test_pieces_end_at_breaks():
    text = "\n\n".join("word " * 150 for _ in range(4))
    ends = C.split_points(text)
    assert len(ends) == 2 and text[: ends[0]].endswith("\n\n")
    assert C.overlap_tail("one two three four", 14, 9) == "three"


def test_split_chunks(spark):
    long = "\n\n".join(["# H"] + ["word " * 120 + "end."] * 4)
    rows = [(1, 1, 0, long, "tail", [7, 8, 9, 10, 11], None, 0, "x"), (1, 1, 0, long, "tail", [7, 8, 9, 10, 11], None, 0, "x"), (2, 1, 1, None, None, None, None, 0, "x"), (3, None, None, "x" * 7000, None, None, None, 0, "x"), (4, 1, 2, "", "", [], None, 0, "x"), (5, 1, 3, "\n" * 4000, None, [], None, 0, "x")]
    out = C.split_chunks(spark.createDataFrame(rows, CHUNK)).orderBy("chunk_uid", "piece").collect()
    one = [r for r in out if r.chunk_uid == 1]
    assert "".join(r.text for r in one) == long and len(one) == 2 == one[0].pieces
    assert one[0].para_indices == [7, 8, 9] and one[1].para_indices == [10, 11] and one[0].prev_context_tail == "tail"
    assert one[1].prev_context_tail and one[0].text.rstrip().endswith(one[1].prev_context_tail)
    assert {r.chunk_uid for r in out} == {1, 3, 5} and [len(r.text) for r in out if r.chunk_uid == 3] == [2333, 2333, 2334]
    assert C.split_chunks(spark.createDataFrame([], CHUNK)).count() == 0
    null = [(None, 1, 0, "a" * 4000, None, None, None, 0, "x"), (None, 2, 0, "b" * 4000, None, None, None, 0, "x")]
    assert {r.text[0] for r in C.split_chunks(spark.createDataFrame(null, CHUNK)).collect()} == {"a", "b"}


def test_cuts_keep_marks_with_their_letter():
    text = "e\u0301" * 3000
    assert all(e % 2 == 0 for e in C.split_points(text, 400, 1001))


# ---- 3 sentences
@pytest.mark.parametrize(
    "text, units",
    [
        ("# H\n\nDr. A. Lorvik et al. (2013) saw 3.5 mm, e.g. here. Then it ended.", ["# H", "Dr. A. Lorvik et al. (2013) saw 3.5 mm, e.g. here.", "Then it ended."]),
        ("It began at 4 a.m. and ended at 8 p.m. Can it? \"Does it hold?\" asked he. pH fell.", ["It began at 4 a.m. and ended at 8 p.m.", "Can it?", "\"Does it hold?\" asked he.", "pH fell."]),
        ("The course “Ask More!” raised it. (No, cf. pp. 2 ff. there.) 306 held.", ["The course “Ask More!” raised it.", "(No, cf. pp. 2 ff. there.)", "306 held."]),
        ("Die Probe war am 3. Mai z. B. höher. „Ist sie stabil?“, fragte Dr. X. Gut.", ["Die Probe war am 3. Mai z. B. höher.", "„Ist sie stabil?“, fragte Dr. X. Gut."]),
        ("« Est-elle fiable ? » demanda-t-il. Oui !", ["« Est-elle fiable ? » demanda-t-il.", "Oui !"]),
        ("「上げたのか。」と問い、見直した。なぜ？", ["「上げたのか。」と問い、見直した。", "なぜ？"]),
        ("研究者问：“真的吗？”答案是没有。好！", ["研究者问：“真的吗？”答案是没有。", "好！"]),
        ("ผู้วิจัยพบว่าดี เย็นลง", ["ผู้วิจัยพบว่าดี", "เย็นลง"]),
        ("यह डॉ. लोरवी है। ठीक।", ["यह डॉ. लोरवी है।", "ठीक।"]),
        ("هل هذا صحيح؟ نعم.", ["هل هذا صحيح؟", "نعم."]),
        ("wrapped line\nof one sentence. Next.\n\n- item one\n- item two.\n| a | b |\n| --- | --- |", ["wrapped line\nof one sentence.", "Next.", "- item one", "- item two.", "| a | b |", "| --- | --- |"]),
        ("Figure 2: A. caption. Here", ["Figure 2: A. caption. Here"]),
        ("Teluk, E., & Strandolf, E. (2013). Flux: a study. Notes, 2(3), 1–4.", ["Teluk, E., & Strandolf, E. (2013). Flux: a study. Notes, 2(3), 1–4."]),
        ("... — \n\n--", []),
        ("Սա ջուր է։ Այն մաքուր է։ Վերջ։", ["Սա ջուր է։", "Այն մաքուր է։", "Վերջ։"]),
        ("នេះជាទឹក។ វាស្អាត។", ["នេះជាទឹក។", "វាស្អាត។"]),
        ("ܗܢܐ ܡܝܐ܂ ܕܟܝܐ ܗܘ܂", ["ܗܢܐ ܡܝܐ܂", "ܕܟܝܐ ܗܘ܂"]),
        ("ᱱᱚᱣᱟ ᱫᱟᱜ ᱾ ᱥᱟᱯᱷᱟ ᱾", ["ᱱᱚᱣᱟ ᱫᱟᱜ ᱾", "ᱥᱟᱯᱷᱟ ᱾"]),
        ("ꦲꦶꦏꦶꦧꦚꦸ꧉ ꦉꦱꦶꦏ꧉", ["ꦲꦶꦏꦶꦧꦚꦸ꧉", "ꦉꦱꦶꦏ꧉"]),
        ("ဒါကရေ။ သန့်ရှင်းတယ်။", ["ဒါကရေ။", "သန့်ရှင်းတယ်။"]),
        ("ይህ ውሃ ነው። ንጹህ ነው።", ["ይህ ውሃ ነው።", "ንጹህ ነው።"]),
        ("Lange, A. " + "and many, many others who worked on it " * 6 + "(2013). Flux: a study. Notes.", ["Lange, A. " + "and many, many others who worked on it " * 6 + "(2013). Flux: a study. Notes."]),
    ],
)
def test_sentence_units(text, units):
    assert [text[a:b] for a, b in S.sentence_units(text)] == units


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB.?!\"“” \n​(é。水9-#|ก", max_size=80))
def test_units_cover_all_letters_in_order(text):
    units = S.sentence_units(text)
    assert all(a < b for a, b in units) and all(x[1] <= y[0] for x, y in zip(units, units[1:]))
    outside = "".join(text[a:b] for a, b in zip([0, *(b for _, b in units)], [*(a for a, _ in units), len(text)]))
    assert not re.search(r"[^\W_]", outside)
    assert all(not text[a].isspace() for a, _ in units)


def test_sentences_frame(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "z"), (1, "A b. C d.", "z"), (2, None, "z"), (3, "  \n", "z"), (None, "X.", "z")], "id bigint, text string, field string")
    got = sorted((r.row_id or 0, r.start_pos, r.text) for r in S.sentences(df, "text", "id").collect())
    assert got == [(0, 0, "X."), (1, 0, "A b."), (1, 5, "C d.")]
    assert S.sentences(df.limit(0), "text", "id", text=False).count() == 0


# ---- 4 look-alikes
def test_one_form():
    r = L.Reader({})
    same = [("café no", "café no"), ("Ｈello", "Hello"), ("ofﬁce", "office"), ("pаper", "paper"), ("a​b", "ab"), ("21 ℃", "21 °C"), ("Μembran", "Membran"), ("ё", "ё"), ("ｺﾛﾆｰ", "コロニー"), ("５", "5")]
    assert all(L.one_form(a, r) == L.one_form(b, r) for a, b in same)
    apart = [("a²", "a2"), ("A", "a"), ("é", "e"), ("a–b", "a-b"), ("“x”", '"x"'), ("a  b", "a b"), ("a\nb", "a b"), ("x.", "x")]
    assert all(L.one_form(a, r) != L.one_form(b, r) for a, b in apart)


def test_bigrams_choose_the_script(spark):
    df = spark.createDataFrame([("копия сора " * 50 + "paper cope score " * 50,), (None,), ("",)], "t string")
    r = L.Reader(L.learn(df))
    assert L.one_form("pаper", r) == "paper" and L.one_form("кoпия", r) == "копия"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aаoоοpрcсxхTТΤbk ё", max_size=12), st.randoms())
def test_form_depends_on_look_alone(text, rng):
    r = L.Reader({12345: 7, 99999: 3})
    twin = "".join(rng.choice(L.CLASSES.get(c, (c,))) for c in text)
    form = L.one_form(text, r)
    assert L.one_form(twin, r) == form == L.one_form(form, r)


def test_same_look_pairs(spark):
    rows = [(1, "a pen"), (2, "а pen"), (3, "a pen"), (4, "a pen"), (5, "A pen"), (6, None), (7, "..."), (8, "…"), (1, "a pen")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id bigint, text string, field string")
    f = L.forms(df, "text", "id", {})
    got = {(r.a_id, r.b_id) for r in L.same_look(f).collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert {(r.a_id, r.b_id) for r in L.same_look(f, part=1).collect()} == got
    assert L.same_look(L.forms(df.limit(0), "text", "id", {})).count() == 0
    classes = {r.row_id: (r.class_id, r.records, r.forms, r.links) for r in L.look_classes(f).collect()}
    assert classes == {1: (1, 4, 3, 2), 2: (1, 4, 3, 3), 3: (1, 4, 3, 2), 4: (1, 4, 3, 3), 5: (5, 1, 1, 0)} | {i: v for i, v in classes.items() if i > 5}
    assert not {6, 7, 8} & set(classes) and sum(c[3] for c in classes.values()) == 2 * len(got)


# ---- 5 truncation
def test_read_end():
    end = lambda t: U.read_end(t, S.sentence_units(t))[0]
    assert [end(t) for t in ("It ended.", "It en", "It ended, cf.", "He said (and so on.", "Fine…", "It was [", "n/a", "", "x\n\n| a | b |", "x\n\n| a | b")] == ["whole", "cut", "cut", "cut", "cut", "cut", "whole", "whole", "whole", "open"]


def test_truncated(spark):
    full = "The aquifer held the membrane and the sediment. The turbine counted records."
    items = "Lead in.\n\n- dormant aquifer membrane\n- sediment turbine membrane\n- aquifer sediment membrane"
    rows = [(i, full, full, "ok") for i in range(30)] + [(100 + i, "x", items, "ok") for i in range(5)] + [(200, "x", items[:-4], "ok"), (201, "x", full[:-9], None), (202, "x", None, "ok"), (203, "x", "...", "ok")]
    df = spark.createDataFrame(result_rows(*rows), RESULT)
    out = {r.row_id: r.cut for r in U.truncated(df, order=F.col("ingested_at")).collect()}
    assert {i for i, c in out.items() if c} == {200, 201} and len(out) == 39
    rates = U.truncation_rates(U.truncated(df)).collect()
    assert [(r.source, r.records, r.cut) for r in rates] == [("a", 39, 2)]
    assert U.truncated(df.limit(0)).count() == 0


def test_copies_of_a_cut_text_are_cut(spark):
    full = "The aquifer held the membrane and the sediment. The turbine counted records."
    items = "Lead in.\n\n- dormant aquifer membrane\n- sediment turbine membrane\n- aquifer sediment membrane"
    row, strange = "Lead in.\n\n| a | b |\n| - | - |\n| c | d", items[: items.rindex(" membrane")]
    rows = [(i, "x", full, "ok") for i in range(30)] + [(100 + i, "x", items, "ok") for i in range(5)]
    rows += [(200 + i, "x", items[:-4], "ok") for i in range(4)] + [(210 + i, "x", row, "ok") for i in range(3)] + [(220 + i, "x", strange, "ok") for i in range(3)]
    # texts of one template, which end in two equal units, are no copies; a fragment stays one in them
    topics = ("aquifer", "membrane", "sediment", "turbine")
    rows += [(300 + i, "x", f"No version of the {t} can be had.\n\n- read it aloud\n- check the records", "ok") for i, t in enumerate(topics)]
    rows += [(310 + i, "x", f"No version of the {t} can be had.\n\n- read it aloud\n- check the turbi", "ok") for i, t in enumerate(topics)]
    # short remains behind different units meet by chance
    rows += [(320 + i, "x", f"On the {t}.\n\n- {t} membrane\n- aquifer", "ok") for i, t in enumerate(topics)]
    out = {r.row_id: r.why for r in U.truncated(spark.createDataFrame(result_rows(*rows), RESULT), order=F.col("ingested_at")).collect()}
    want = dict.fromkeys(range(200, 204), "fragment") | dict.fromkeys(range(210, 213), "row") | dict.fromkeys(range(220, 223), "ending")
    assert {i: w for i, w in out.items() if w} == want | dict.fromkeys(range(310, 314), "fragment") | dict.fromkeys(range(320, 324), "ending")


def test_rare_letter_runs_are_no_words(spark):
    full = "They came after the flood, and the valley stood still thereafter. A lattice lay there."
    rows = [(i, "x", full, "ok") for i in range(500)]
    rows += [(600 + i, "x", f"The key is {i}af{i}b9 and 7af here. {full}", "ok") for i in range(9)]  # hex strings
    rows += [(700, "x", f"The mark vall stands. {full}", "ok")] * 3  # one record, delivered three times
    rows += [(710 + i, "x", f"A flo came. {full}", "ok") for i in range(2)]  # two slips against 500 words
    heads = {800: "# On the af", 801: "# On the vall", 802: "# On the flo", 803: "# On the lattice", 804: "# On the sample 7a"}
    rows += [(i, "x", f"{full}\n\n{h}", "ok") for i, h in heads.items()]
    out = {r.row_id: r.why for r in U.truncated(spark.createDataFrame(result_rows(*rows), RESULT), order=F.col("ingested_at")).collect()}
    assert {i: w for i, w in out.items() if w} == dict.fromkeys((800, 801, 802), "fragment")


def test_limits_of_sources(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        n = 500 if i < 40 else rng.randint(100, 900)
        rows.append((i, "x", ("The tuber fell again and again, " * 40)[:n].rstrip(".,") + "z" * 0, "ok"))
    df = spark.createDataFrame(result_rows(*rows), RESULT)
    signs = U._signs(df, "humanized_text", "result_id", "source", F.lit(None))
    records = signs.where("what = 'r'").select("row_id", "source", "state", "kind", "token", "n", "n_bytes", "line")
    found = U._limits(records).collect()
    assert len(found) == 1 and 495 <= found[0].high <= 500


def test_two_limits_of_a_source(spark):
    rng, rows = random.Random(3), []
    text = "The tuber fell again and again, while membranes " * 40
    for i in range(70):
        rows.append((i, "x", text[: (500 if i < 30 else 700 if i < 60 else rng.randint(100, 900)) - 1] + "z", "ok"))
    for n in (500, 600, 700):  # cut in a heading
        head = "\n\n# Again the tuber"
        rows.append((n, "x", text[: n - len(head) - 1] + "." + head, "ok"))
    df = spark.createDataFrame(result_rows(*rows), RESULT)
    records = U._signs(df, "humanized_text", "result_id", "source", F.lit(None)).where("what = 'r'")
    assert sorted(r.high for r in U._limits(records).collect()) == [500, 700]
    out = {r.row_id: r.why for r in U.truncated(df).where("row_id >= 500").collect()}
    assert out == {500: "limit", 600: None, 700: "limit"}


def test_trie_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
    words = {word(6): rng.randint(1, 9) for _ in range(80)} | {"水" * 90 + "火": 3}
    tokens = {word(7) for _ in range(300)} | {"水" * 90, "水" * 91}
    nodes = U.trie_nodes(spark.createDataFrame(list(words.items()), "token string, c bigint"), spark.createDataFrame([(t,) for t in tokens], "token string"))
    want = {t: (words.get(t, 0), sum(c for w, c in words.items() if w.startswith(t))) for t in tokens}
    assert {r.token: (r.own, r.through) for r in nodes.collect()} == {t: w for t, w in want.items() if w[1]}


def test_final_tokens():
    assert [U.final_token(t) for t in ("It en", "It ended.", "a 12", "x7a", "caf\u00e9", "", "...", "の" + "水" * 500, "ab" * 3000)] == ["en", "ended", "0", "0", "cafe\u0301", "", "", "の" + "水" * 500, "ab" * 3000]


# ---- 6 shared spans
def brute_shared(rows, n):
    own: dict[str, set] = {}
    for i, *texts in rows:
        for t in texts:
            for p in range(len(t or "") - n + 1):
                own.setdefault(t[p : p + n], set()).add(i)
    out = {}
    for i, *texts in rows:
        for f, t in enumerate(texts):
            at = [p for p in range(len(t or "") - n + 1) if len(own[t[p : p + n]]) > 1]
            runs: list[list[int]] = []
            for p in at:
                if runs and p == runs[-1][1] - n + 1:
                    runs[-1][1] = p + n
                else:
                    runs.append([p, p + n])
            if runs:
                out[i, f] = [tuple(r) for r in runs]
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_shared_spans_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(X, "HOT", hot)
    rng = random.Random(7)
    new = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    pool = [new(rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(40):
        texts = []
        for _ in range(2):
            t = new(rng.randint(0, 40))
            for _ in range(rng.randint(0, 2)):
                s = rng.choice(pool)
                a = rng.randint(0, 10)
                t += s[a : rng.randint(a, len(s))] + new(rng.randint(0, 20))
            texts.append(t)
        rows.append((i, *texts))
    rows += [(50, "x" * 90, None), (51, "x" * 80, ""), (52, "ab" * 40, None), (53, "q" + "ab" * 30, None), (50, "x" * 90, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "result_id bigint, a string, b string, h int, field string")
    got: dict = {}
    for r in X.shared_spans(df, ["a", "b"], min_length=24).collect():
        got.setdefault((r.row_id, "ab".index(r.field)), []).append((r.start_pos, r.end_pos))
    assert {k: sorted(v) for k, v in got.items()} == brute_shared(list(dict.fromkeys(rows)), 24)
    report = {(r.row_id, r.field): r for r in X.shared_report(df, X.shared_spans(df, ["a", "b"], min_length=24), ["a", "b"]).collect()}
    assert report[51, "a"].share == 1.0 and report[51, "b"].share == 0.0


def test_shared_spans_empty(spark):
    df = spark.createDataFrame([], "result_id bigint, a string")
    assert X.shared_spans(df, ["a"]).count() == 0


def test_anchors_are_in_every_window():
    rng = np.random.default_rng(1)
    codes = rng.integers(97, 101, 500).astype(np.uint32)
    places, hashes = X.anchors(codes, 10, 11)
    assert all(((places >= i) & (places + 10 <= i + 20)).any() for i in range(len(codes) - 20 + 1))
    again, h2 = X.anchors(codes[100:], 10, 11)
    assert set(again[again > 10] + 100) >= {p for p in places if p > 120}
    assert dict(zip(places.tolist(), hashes.tolist())).get(int(again[20]) + 100) == h2[20]


# ---- 7 packing
@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=80), st.integers(1, 8))
def test_best_fit(sizes, open_bins):
    place, still = B.best_fit(sizes, 20, open_bins)
    used = Counter()
    for s, b in zip(sizes, place):
        used[b] += s
    assert all(u <= 20 for u in used.values()) and len(still) <= open_bins and still <= set(place)
    # by the rule itself, without bitsets
    bins: list[list[int]] = []
    order, n = [], 0
    for s in sizes:
        fits = [b for b in bins if b[1] >= s]
        if fits:
            b = min(fits, key=lambda b: b[1])
        else:
            if len(bins) == open_bins:
                bins.remove(min(bins, key=lambda b: b[1]))
            b = [n, 20]
            n += 1
            bins.append(b)
        b[1] -= s
        order.append(b[1])
        bins = [x for x in bins if x[1]]
    left = Counter()
    frees = []
    for s, b in zip(sizes, place):
        left[b] += s
        frees.append(20 - left[b])
    assert frees == order


def test_pack_documents(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["red", "blue", "green"]) for _ in range(rng.randint(1, 70))), 1, 2) for i in range(300)] + [(900, None, 1, 2), (901, "", 1, 2), (902, "word " * 500, 1, 2), (903, "same", 1, 2), (903, "same", 1, 2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_tokens int, shard int")
    out = B.pack_documents(df, capacity=100, open_bins=8, shard_items=60).collect()
    used = Counter()
    for r in out:
        used[r.container] += r.n_tokens
    assert max(used.values()) <= 100
    enc = K.encoding(K.TOKENIZER)
    whole = Counter()
    for r in out:
        whole[r.doc_id] += r.n_tokens
    assert all(whole[i] == (2 if i == 903 else 1) * len(enc.encode_ordinary(t or "")) for i, t, *_ in docs)
    assert {r.doc_id for r in out if r.piece} == {902} and sum(used.values()) / (100 * len(used)) > 0.9
    assert len(out) == 304 + len([r for r in out if r.doc_id == 902])
    report = B.fill_report(B.pack_documents(df, 100), 100).first()
    assert report.tokens == sum(used.values()) and report.most <= 100
    assert B.pack_documents(df.limit(0)).count() == 0


def test_repeated_long_ids_share_no_container(spark):
    docs = [(7, "word " * 500), (7, "word " * 500), (None, "word " * 350), (None, "word " * 350), (8, "x")]
    out = B.pack_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), capacity=100, open_bins=4, shard_items=2).collect()
    used = Counter()
    for r in out:
        used[r.container] += r.n_tokens
    enc = K.encoding(K.TOKENIZER)
    assert None not in used and max(used.values()) <= 100 and sum(used.values()) == sum(len(enc.encode_ordinary(t)) for _, t in docs)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 60)), max_size=25))
def test_no_container_exceeds_the_capacity(spark, items):
    df = spark.createDataFrame([(i, "word " * n) for i, n in items], "doc_id bigint, text string")
    used = Counter()
    for r in B.pack_documents(df, capacity=16, open_bins=2, shard_items=5).collect():
        used[r.container] += r.n_tokens
    assert all(u <= 16 for u in used.values())


# ---- 8 mixing
def test_mix(spark):
    rng = random.Random(8)
    docs = [(i, "word " * rng.randint(5, 60), s, 3) for i, s in enumerate(["big"] * 400 + ["mid"] * 150 + ["tiny"] * 20 + [None] * 5 + ["other"] * 5)] + [(9999, None, "big", 3), (9998, "", "mid", 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, at int")
    mix = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int")
    rows = M.mix_sources(df, mix).collect()  # the rows come in their order
    assert [r.seq for r in rows] == list(range(len(rows))) and all(a.at <= b.at for a, b in zip(rows, rows[1:]))
    total = sum(r.n_tokens for r in rows)
    for s, want in (("big", 0.6), ("mid", 0.3), ("tiny", 0.1)):
        assert abs(sum(r.n_tokens for r in rows if r.source == s) / total - want) < 0.02
    times = Counter((r.doc_id) for r in rows)
    assert all(times[i] <= {"big": 1, "mid": 2, "tiny": 4}[s] for i, _, s, _ in docs if s in ("big", "mid", "tiny"))
    early = [r for r in rows if r.at < 0.5]
    assert sum(r.source != "big" for r in early) < sum(r.source != "big" for r in rows if r.at >= 0.5)
    report = {r.source: r for r in M.share_report(M.mix_sources(df, mix), mix).collect()}
    assert report["absent"].tokens == 0 and abs(sum(r.share for r in report.values()) - 1) < 1e-9
    assert M.mix_sources(df.limit(0), mix).count() == 0


def test_schedule_is_inverted(spark):
    docs = [(i, "one two three", "a" if i % 2 else "b") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    mix = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    plan = spark.createDataFrame([("a", [0.0, 0.5, 1.0], [2.0, 0.0, 0.0]), ("b", [0.0, 1.0], [1.0, 1.0])], "source string, times array<double>, rates array<double>")
    at = {s: sorted(r.at for r in M.mix_sources(df, mix, plan).collect() if r.source == s) for s in "ab"}
    assert max(at["a"]) <= 0.5 and len(at["a"]) == len(at["b"]) == 200
    for q in (0.25, 0.5, 0.75):  # rate 2 - 4t: share 4t - 4t^2 of the demand by time t
        t = at["a"][int(q * 200)]
        assert abs(4 * t - 4 * t * t - q) < 0.02 and abs(at["b"][int(q * 200)] - q) < 0.02


# ---- 9 quality
@pytest.mark.parametrize(
    "text, kind",
    [
        ("The quick fox ran over the hill because it was late, and the dog did not see it at all.", "prose"),
        ("short one.", "prose"),
        ("— Had he seen the fox?\n— No, he said that it was gone.\n— And the dog?", "prose"),
        ("in the morning the fox ran over the hill and it was seen by the\ndog that had been there since the night before because of the\nrain that fell", "prose"),
        ("- red fox\n- blue dog\n- green hill\n- old road", "list"),
        ("1. red fox\n2. blue dog\n3. green hill", "list"),
        ("fox hill survey\nold road river\ndog garden tower\nblue field engine\ntall stone bridge", "list"),
        ("fox; dog; hill; road; river; tower; field; stone", "list"),
        ("1.1 Fox ........... 3\n1.2 Dog ........... 7\n2.1 Hill ...... 9", "list"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "table"),
        ("a,b,c\n1,2,3\n4,5,6\n7,,9", "table"),
        ("fox_0 = 14.1\ndog_1 = 24.8\nhill_2 = 49.4", "table"),
        ("1.5 2.5 3.5\n4.5 5.5 6.5\n7.5 8.5 9.5", "table"),
        ("%$#@ ^&* !~ {}|<> =+= ^^^", "junk"),
        ("<w:r><w:t>fox</w:t></w:r><w:r><w:t></w:t></w:r>", "junk"),
        ("undefined " * 40, "junk"),
        ("Ð¢Ð¾Ð³Ð´Ð° ÐºÐ°Ðº Ð¿ÐµÑ\x80Ð²Ð°Ñ\x8f", "junk"),
        ("f0 6b 03 77 91 43 c0 f7 d5 f4 a4 de 7b b4 cb 12", "junk"),
        ("kjlg ruhe qpow zmxn ghty vbnm wert yuio asdf ghjk lqwe rtyu zxcv bnmq wert tyui opas dfgh", "junk"),
        ("", "junk"),
        (None, "junk"),
        ("Bu çalışmada suyun akışı ve toprağın yapısı incelendi. Ölçümler yaz boyunca her gün yapıldı ve sonuçlar önceki yıllarla karşılaştırıldı.", "prose"),
        ("W tym badaniu zbadano przepływ wody i strukturę gleby. Pomiary wykonywano codziennie przez całe lato, a wyniki porównano z poprzednimi latami.", "prose"),
        ("이 연구에서는 물의 흐름과 토양의 구조를 조사하였다. 측정은 여름 내내 매일 이루어졌으며 결과는 이전 해의 결과와 비교되었다. 결과는 뚜렷한 차이를 보여 주었다.", "prose"),
        ("Σε αυτή τη μελέτη εξετάστηκε η ροή του νερού και η δομή του εδάφους. Οι μετρήσεις γίνονταν κάθε μέρα και τα αποτελέσματα συγκρίθηκαν με αυτά των προηγούμενων ετών.", "prose"),
        ("Tässä tutkimuksessa tarkasteltiin veden virtausta ja maaperän rakennetta. Mittaukset tehtiin joka päivä kesän ajan, ja tuloksia verrattiin aiempien vuosien tuloksiin.", "prose"),
        ("Katika utafiti huu mtiririko wa maji na muundo wa udongo vilichunguzwa. Vipimo vilifanyika kila siku wakati wa kiangazi, na matokeo yakalinganishwa na ya miaka iliyopita.", "prose"),
        ("bearing granular membrane coding Ilmaric porosity training alkaline mortar transport axial questionnaire drift scaffold coverage canopy resistance", "junk"),
        ("n th plt st, th ltnt prssr f th btch (pvmnt, qstnnr, smpls) ws hld. Th crrdr ws lmtd by rbst wr, n vry rplct, nd th skwd clny n th rvr mth.", "junk"),
    ],
)
def test_quality_kinds(text, kind):
    found = Q.statistics(text)
    assert found["kind"] == kind and (kind != "junk" or found["reasons"])


def test_batches_do_not_matter():
    texts = ["The fox ran.\n\n- a b\n- c d", "", "x", "a,b\n1,2\n3,4", "\n\n  \n", "Ünï <b>c</b> … 12 #a", "𝐀𝐁 水は火。", "a b" * 9000, "\t", "q" * 30 + "A1"] * 2
    together = Q.Batch(texts)
    for i, t in enumerate(texts):
        alone = Q.statistics(t)
        assert {k: v[i].item() for k, v in together.figures.items()} | {"kind": together.kind[i], "reasons": together.reasons[i], "language": together.language[i]} == alone


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1 .,-'\n\t|é水ก#é𝐀…", max_size=60))
def test_figures_against_plain_counts(text):
    f = Q.statistics(text)
    words = re.findall(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f'’-])*", text)
    unspaced = len(re.findall(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]", text))
    lines = [x for x in text.split("\n") if x.strip()]
    assert f["chars"] == len(text) and f["words"] == len(words) + unspaced // 2
    assert f["mean_word_length"] == (round(sum(map(len, words)) / len(words), 3) if words else 0)
    assert f["digit_ratio"] == round(sum(map(str.isdigit, text)) / max(1, len(text)), 4)
    assert f["closed_line_ratio"] == (round(sum(bool(re.search(r"[.!?…。]['’\"]*\s*$", x)) for x in lines) / len(lines), 4) if lines else 0)
    assert f["distinct_ratio"] == (round(len({w.lower() for w in words}) / len(words), 4) if words else 1)


def test_quality_frame(spark):
    df = spark.createDataFrame([(1, "The fox is in the hill.", "k"), (1, "The fox is in the hill.", "k"), (2, None, "k")], "doc_id bigint, text string, kind string")
    assert sorted((r.doc_id, r.kind) for r in Q.quality(df).collect()) == [(1, "prose"), (1, "prose"), (2, "junk")]
    assert Q.quality(df.limit(0)).count() == 0


# ---- 2 broken pairs
NOUNS = "fox river engine tower garden bridge survey membrane lattice turbine signal harbor".split()


def sound_pair(rng, language="en"):
    a, b, c, d = rng.sample(NOUNS, 4)
    n, m = rng.randint(10, 99), rng.randint(10, 99)
    if language == "de":
        return f"# {a}\n\nDie {a} ist nicht höher als die {b}, und der {c} bleibt bei {n},5 stabil. Wir sahen den {d} mit {m} Proben am Hang.", f"# {a}\n\nNicht höher als die {b} ist die {a}, und bei {n},5 bleibt der {c} stabil. Mit {m} Proben am Hang sahen wir den {d}."
    return f"# {a}\n\nThe {a} is not above the {b}, and the {c} stays near {n}.5 in the night. We saw the {d} in {m} of the samples from the store.", f"# {a}\n\nNot above the {b} is the {a}, and near {n}.5 in the night stays the {c}. In {m} of the samples from the store we saw the {d}."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    return P.fit([sound_pair(rng, rng.choice(["en", "en", "de"])) for _ in range(150)])


def named(model, *pairs):
    reader = P.Reader(model.profiles)
    return model.named(reader.pairs([o for o, _ in pairs], [h for _, h in pairs], [P._end(h) for _, h in pairs]))


def test_classifier_on_held_out_pairs(model):
    rng = random.Random(5)
    held = [sound_pair(rng, rng.choice(["en", "de"])) for _ in range(60)]
    examples = P.broken_examples(held, model.profiles, seed=99)
    got = [name or "" for name in named(model, *((o, h) for o, h, _ in examples))]
    right, whole = Counter(), Counter()
    for name, (_, _, label) in zip(got, examples):
        whole[label] += 1
        right[label] += name == label
    assert all(right[k] / whole[k] > 0.9 for k in whole), (right, whole)
    # what is named truncated has a check behind it, so its threshold goes for recall
    assert {r[0] for r in model.report} == set(P.LABELS) and all((p > 0.9 or k == "truncated") and c > 0.9 for k, _, p, c, _ in model.report)


def test_thresholds_decide(model):
    rng = random.Random(9)
    pairs = [sound_pair(rng) for _ in range(30)]
    before = named(model, *pairs)
    zero = P.Model(model.weights, np.full(len(P.LABELS), 1e-9), model.profiles)
    assert before.count(None) >= 29 and named(zero, *pairs).count(None) == 0


def test_copies(model):
    o = "The aquifer held the membrane and the sediment, while turbines counted records of it.\n\nA tuber fell. " * 8
    lead = "Thank you for the draft, which I have read with care and now return to you in the form you asked for; " * 9
    forms = (lead + "\n\n" + o, o, o.upper(), o.replace("a", "а"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in o), o.replace("e", "e\u200b"))
    assert named(model, *((o, h) for h in forms)) == ["copy"] * len(forms)
    half = "Held by the aquifer were the membrane and the sediment; records of it were counted by turbines.\n\nDown a tuber fell. " * 4
    assert named(model, (o, o[: len(o) // 2] + "\n\n" + half)) == [None]


@pytest.mark.parametrize("was, now", [("kHz", "㎑"), ("سلام", "ﺳﻼﻡ"), ("กำ", "กํา"), ("ß²", "ß²"), ("क़", "क\u093c"), ("é", "e\u0301"), ("fi", "ﬁ")])
def test_copy_in_other_forms(model, was, now):
    o = f"At {was} the aquifer held the membrane and the sediment, while turbines counted records of it. " * 9
    assert P.skeleton(was) == P.skeleton(now) and named(model, (o, o.replace(was, now)), (o.replace(was, now), o)) == ["copy"] * 2


def test_skeletons_by_table():
    rng = random.Random(3)
    chars = "aBc ﬁ㎑ﺳé\u0301ßกำक़Аοｗ²½ i\u200b\ud55c\u1112\u1161\u11ab\U0001d400漢"
    for _ in range(200):
        texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 12))) for _ in range(3)]
        codes, at = P.skeleton_codes(texts)
        assert ["".join(map(chr, codes[a:b])) for a, b in zip(at, at[1:])] == [P.skeleton(t) for t in texts]


OTHERS = {
    "tr": "Bu çalışmada suyun akışı ve toprağın yapısı incelendi. Ölçümler yaz boyunca her gün yapıldı ve sonuçlar önceki yıllarla karşılaştırıldı.",
    "it": "In questo studio sono stati esaminati il flusso dell'acqua e la struttura del suolo. Le misure sono state fatte ogni giorno e i risultati sono stati confrontati con quelli degli anni precedenti.",
    "pl": "W tym badaniu zbadano przepływ wody i strukturę gleby. Pomiary wykonywano codziennie przez całe lato, a wyniki porównano z poprzednimi latami.",
}


@pytest.mark.parametrize("language", OTHERS)
def test_languages_beyond_the_corpus(model, language):
    text = OTHERS[language]
    o = "# Methods\n\nIn this study the flow of water and the structure of the soil were examined. Measurements were taken every day in the summer, and the results were compared with those of earlier years."
    first, second = re.split(r"(?<=\.) ", text)
    assert named(model, (o, "# Methods\n\n" + text), ("# Methods\n\n" + text, o)) == ["other_language"] * 2
    assert named(model, (text, f"{second} {first}")) in ([None], ["copy"])


def test_language_is_that_of_the_running_text(model):
    items = "\n".join(f"- the state of the aquifer in the year {i} and that of the membrane" for i in range(12))
    o = f"The aquifer was in the valley and it was not for the turbine that had been joined to the town.\n\n{items}"
    h = f"Der Speicher war in dem Tal und er war nicht für die Turbine, die mit dem Werk und der Stadt verbunden ist.\n\n{items}"
    assert named(model, (o, h)) == ["other_language"]


def test_few_records_teach_enough(spark):
    rows = result_rows(*((i, f"Lead {i}. The {n} was seen near the {m}.", f"Near the {m} the {n} was seen, after lead {i}.", "ok") for i, (n, m) in enumerate(zip(NOUNS[:5], NOUNS[5:10]))))
    assert not [r for r in P.broken_pairs(spark.createDataFrame(rows, RESULT)).collect() if r.defect]


def test_broken_pairs(spark):
    rng = random.Random(6)
    pairs = [sound_pair(rng, "de" if i % 3 == 0 else "en") for i in range(120)]
    rows = [(i, o, h, "success") for i, (o, h) in enumerate(pairs)]
    o, h = sound_pair(rng)
    de = sound_pair(rng, "de")
    rows += [(1000, o, None, "ok"), (1001, o, "N/A", None), (1002, o, "I'm sorry, but I cannot help with rewriting this.", "ok"), (1003, o, "Revised version:\n\n" + o.upper(), "ok"), (1004, o, de[1], "ok"), (1005, o, h[:-25], "ok"), (1006, None, None, "ok"), (1007, o, o, "error: no"), (1008, None, h, "ok")]
    df = spark.createDataFrame(result_rows(*rows), RESULT)
    df = df.withColumn("skipped", F.col("result_id") == 5)
    out = {r.result_id: r.defect for r in P.broken_pairs(df).collect()}
    assert {i: d for i, d in out.items() if d} == {1000: "empty", 1001: "empty", 1002: "refusal", 1003: "copy", 1004: "other_language", 1005: "truncated", 1006: "empty"}
    assert 5 not in out and 1007 not in out
    assert P.broken_pairs(df.limit(0)).count() == 0


def test_every_record_teaches(spark, monkeypatch):
    monkeypatch.setattr(P, "DRIVER_ROWS", 100, raising=False)
    rng = random.Random(8)
    rows = [(i, *sound_pair(rng, "de" if i % 3 == 0 else "en"), "ok") for i in range(160)]
    df = spark.createDataFrame(result_rows(*rows, *rows[:20]), RESULT)
    one = P.train(df.repartition(1))
    # each record is emptied once, whichever shard it is in
    assert {k: n for k, _, _, _, n in one.report}["empty"] == 160
    other = P.train(df.orderBy(F.desc("result_id")).repartition(5))
    assert np.array_equal(one.weights, other.weights) and np.array_equal(one.thresholds, other.thresholds)
    # one record's word reaches the weights
    last = [(i, o, h.replace("samples", "zirconium"), s) if i == 158 else (i, o, h, s) for i, o, h, s in rows]
    assert not np.array_equal(one.weights, P.train(spark.createDataFrame(result_rows(*last), RESULT)).weights)
    found = P.broken_pairs(df)
    assert found.count() == 160 and found.where("defect is not null").count() <= 2


def test_only_texts_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(P, "DRIVER_ROWS", 100)
    rng = random.Random(8)
    rows = result_rows(*((i, *sound_pair(rng, "de" if i % 3 == 0 else "en"), "ok") for i in range(160)))
    texts = sum(len(t.encode()) for r in rows for t in r if isinstance(t, str))
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in stages_of(spark)}
    before = stages()
    assert P.broken_pairs(spark.createDataFrame(rows, RESULT)).count() == 160
    # the features of some 2,500 examples, each larger than its texts, stay where they are made
    assert sum(n for i, n in stages().items() if i not in before) < 6 * texts


def stages_of(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_records_delivered_twice_are_read_as_delivered_last(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, *sound_pair(rng, "de" if i % 3 == 0 else "en"), "ok") for i in range(160)]
    # two deliveries at one time: the greater texts count, and how these end
    twice = [(158, "", "", "ok"), (159, rows[159][1], None, "ok")]
    for limit in (100, 500):
        monkeypatch.setattr(P, "DRIVER_ROWS", limit)
        found = P.broken_pairs(spark.createDataFrame(result_rows(*rows, *twice), RESULT)).where("result_id >= 158").collect()
        assert sorted((r.result_id, r.defect) for r in found) == [(158, None), (159, None)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab A.\n#-\"。กั\U00011f43\u200b1", max_size=80))
def test_last_unit(text):
    assert S.last_unit(text) == S.sentence_units(text)[-1:]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_plain_text_by_its_changed_characters(text):
    assert L.plain(text) == unicodedata.normalize("NFD", text.translate(L._FORMS))


def test_each_is_broken_in_one_way():
    rng = random.Random(8)
    pairs = [sound_pair(rng, "de" if i % 3 == 0 else "en") for i in range(600)]
    made = list(P._broken(pairs, P.Profiles(), 1, one_way=True))
    labels = Counter(x[2] for m in made for x, _ in m)
    assert len(made) == 600 and set(labels) == {"", *P.LABELS} and min(labels.values()) > 20
    assert all(len({x[2] for x, _ in m} - {""}) <= 1 and all(0 <= j < 600 for _, j in m) for m in made)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab cé。", max_size=60), min_size=1, max_size=5))
def test_packed_features(texts):
    x = P.Reader(P.Profiles()).pairs([t[::-1] for t in texts], texts, [P._end(t) for t in texts])
    again = P.unpacked(P.packed(x))
    assert np.array_equal(x[:, P.WIDTH :], again[:, P.WIDTH :]) and np.allclose(x, again, atol=1e-3)


# ---- queries
def test_entry_adds_these_queries():
    import __spark_entry__ as E

    names = set(E.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9)} <= names and any(n.startswith("p7_") for n in names) and any(n.startswith("p8_") for n in names)
    assert set(E.oracle_sql()) <= names
