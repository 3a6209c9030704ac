"""Text operators against brute force, round trips and small fixtures."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import canonical, lookalike, mixing, neardup, queries, tokens

NOTE = "row_id bigint, note string, cls string, band string"
WORDS = [f"{a}{b}{c}" for a in ("kra", "vil", "mon", "tes") for b in ("do", "ri", "sa", "lu", "pe") for c in ("x", "th", "n", "m", "k")]


def similar(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], NOTE)
    return neardup.NearDuplicates({"t": (df, "note")}, **kw)


def brute(texts, threshold=(7, 10), least=8):
    sets = {i: set(re.findall("[a-z0-9]+", t.lower())) for i, t in enumerate(texts) if t is not None}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * threshold[1] >= threshold[0] * len(sets[a] | sets[b])}


def edited(rng, words):
    w = list(words)
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(w))
        rng.choice([lambda: w.pop(k), lambda: w.insert(k, rng.choice(WORDS)), lambda: w.__setitem__(k, rng.choice(WORDS)), lambda: rng.shuffle(w)])()
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "only seven words are in this note", "x " * 50_000, "One two three four five six seven eight!", "one-two three four five six SEVEN eight", *["same words one two three four five six"] * 40]
    for _ in range(60):
        base = rng.sample(WORDS, rng.randint(8, 30))
        texts += [edited(rng, base) for _ in range(3)]
    n = similar(spark, texts)
    got = {(r.row_id_a, r.row_id_b) for r in n.row_pairs().collect()}
    assert got == brute(texts)
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in got:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    members = {x for p in got for x in p}
    assert {r.row_id: r.group_id for r in n.groups().collect()} == {x: find(x) for x in members}


def test_tables_stay_apart_and_empty_tables(spark):
    t = "a note of eight or more different words here now"
    a, b = (spark.createDataFrame([(1, t), (2, t)], "row_id bigint, note string") for _ in range(2))
    n = neardup.NearDuplicates({"a": (a, "note"), "b": (b, "note")})
    assert {tuple(r) for r in n.row_pairs().collect()} == {("a", 1, 2), ("b", 1, 2)}
    e = neardup.NearDuplicates({"a": (a.limit(0), "note")})
    assert e.row_pairs().count() == 0 and e.groups().count() == 0


def test_family_that_makes_its_own_words_common(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COMMON_LEAST", 5)  # 400 notes are 80 times the limit: the family's words weigh 1/256
    texts = [" ".join([*WORDS[: i % 20], f"own{i}", *WORDS[i % 20 + 1 : 20]]) for i in range(400)]
    n = similar(spark, texts)
    assert {(r.row_id_a, r.row_id_b) for r in n.row_pairs().collect()} == brute(texts)
    assert {r.group_id for r in n.groups().collect()} == {0}


def family_recall(spark, share, notes, rng):
    """(pairs found, pairs there are, false pairs) of one family of near-duplicates that is a share of all notes."""
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    stock = [[word() for _ in range(6)] for _ in range(12)]  # phrases that unrelated notes share
    base = [*stock[0], *stock[1], *[word() for _ in range(14)]]
    own = []
    for _ in range(int(share * notes)):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randrange(4)):
            w[k] = word()
        own.append(w)
    other = [[*rng.choice(stock), *rng.choice(stock), *[word() for _ in range(14)]] for _ in range(notes - len(own))]
    got = {(r.row_id_a, r.row_id_b) for r in similar(spark, [" ".join(w) for w in own + other]).row_pairs().collect()}
    ids = {w: i for i, w in enumerate(sorted({x for w in own for x in w}))}
    m = np.zeros((len(own), len(ids)), np.float32)
    for i, w in enumerate(own):
        m[i, [ids[x] for x in w]] = 1
    both, size = m @ m.T, m.sum(1)
    want = {(int(i), int(j)) for i, j in np.argwhere(both * 10 >= 7 * (size[:, None] + size[None, :] - both)) if i < j}
    return len(got & want), len(want), len(got - want)


@pytest.mark.parametrize("share", [0.023, 0.1, 0.3])
def test_recall_of_large_families(spark, monkeypatch, share):
    monkeypatch.setattr(neardup, "COMMON_LEAST", 10)  # the family's words weigh as little as in a table of millions
    found, there, false = family_recall(spark, share, 3000, random.Random(8))
    print(f"family of {share:.1%}: {found} of {there} pairs, {false} false")
    assert found >= 0.9999 * there and false == 0


def test_hot_bands_and_classes_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 5)
    texts = [" ".join([*WORDS[: i % 20], f"own{i % 300}", *WORDS[i % 20 + 1 : 20]]) for i in range(360)] + ["the very same words stand in each of these notes"] * 40
    n = similar(spark, texts)
    want = brute(texts)
    rows = [(r.row_id_a, r.row_id_b) for r in n.row_pairs().collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_joint_estimate_is_close():
    rng = np.random.default_rng(1)
    for shared in (10, 60, 90):
        a = rng.integers(0, 2**32, 100, dtype=np.uint64)
        b = a.copy()
        b[shared:] = rng.integers(0, 2**32, 100 - shared, dtype=np.uint64)
        u = [neardup.exponential(neardup.largest_uniform(x, np.array([0]), neardup._odd_multipliers(1024, 3))) for x in (a, b)]
        for base, q, rate in ((neardup.SMALL_BASE, neardup.SMALL_Q, neardup.SMALL_RATE), (neardup.BASE, neardup.Q, neardup.RATE)):
            k = [neardup.registers(x, base, q, rate) for x in u]
            est = neardup.estimate_jaccard(k[0], k[1], np.array([100.0]), np.array([100.0]), base)[0]
            assert est == pytest.approx(shared / (200 - shared), abs=0.06)


def test_estimate_keeps_pairs_at_the_threshold():
    """Sketches of pairs with a similarity of exactly 0.7: practically none falls below the least estimate."""
    rng = np.random.default_rng(3)
    pairs = 20_000
    both = rng.integers(0, 2**32, (pairs, 17 + 8), dtype=np.uint64)  # 17 shared, 3 or 4 own: 17 / 24
    a, b = both[:, :21], np.concatenate([both[:, :17], both[:, 21:24]], 1)
    sk = [neardup.sketches(x.ravel(), np.arange(0, x.size + 1, x.shape[1])) for x in (a, b)]
    est = neardup.estimate_jaccard(sk[0], sk[1], np.full(pairs, 21.0), np.full(pairs, 20.0))
    assert est.mean() == pytest.approx(17 / 24, abs=0.02) and (est < neardup.least_estimate(0.7)).mean() < 1e-4


def test_registers_merge():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**32, 50, dtype=np.uint64), rng.integers(0, 2**32, 70, dtype=np.uint64)
    reg = lambda x: neardup.registers(neardup.exponential(neardup.largest_uniform(x, np.array([0]), neardup.BAND_MULTIPLIERS)))
    assert (np.maximum(reg(a), reg(b)) == reg(np.concatenate([a, b]))).all()


# --- canonical values ------------------------------------------------------------------

ITEMS = [("P1", "p", "CRITICAL", "P1|SEV1|crit"), ("P2", "p", "NOT_ESCALATED", "kept at desk"), ("P3", "p", "Token Theft", None), ("P4", "p", "Minor", "C2 callback"), ("Q1", "q", "CRITICAL", None)]


def meaning(spark, vals):
    items = spark.createDataFrame(ITEMS, "item_id string, list_name string, label string, other_names string")
    df = spark.createDataFrame([(i, v, None, "clash") for i, v in enumerate(vals)], "row_id bigint, p string, q string, value string")
    got = {r.row_id: r.item_id for r in canonical.map_values(df, items, ["p", "q"]).collect()}
    return [got.get(i) for i in range(len(vals))]


@pytest.mark.parametrize(
    ("values", "want"),
    [
        (["CRITICAL", None, " ", "n/a", "--"], None),
        (["critical", " CRITICAL ", "CRITIСAL", "(critical)", "CRITICAL?", "suspected critical", "type: crit", "cat=sev1", "poss. p1", "critical - tbc", "critical (confirmed)", "crit #2", "P 1", "ＣＲＩＴＩＣＡＬ"], "P1"),
        (["crtical", "criitical", "crxtical", "rcitical", "rciticla", "crticla", "crtcal", "critixxl"], "P1"),
        (["not escalated", "ESCALATED, NOT", "NOT-ESCALATED", "not secalatted", "Kept.At.Desk", "KeptAtDesk", "nOtescalated"], "P2"),
        (["theft token", "tokne thfet", "TokenTheft"], "P3"),
        (["minr", "mnior", "c2-callback", "c2 calback"], "P4"),
        (["P7", "sev9", "crot", "nto escalated", "kpet at desk", "crxxxcal", "token", "token token theft", "tokxx thexx", "whatever", "??", "17", "c3 callback", "x" * 5000], "none"),
    ],
)
def test_meanings(spark, values, want):
    assert meaning(spark, values) == [want] * len(values)


@pytest.mark.parametrize("limit", [200_000, 10])
def test_meanings_empty_and_skewed(spark, monkeypatch, limit):
    monkeypatch.setattr(canonical, "BROADCAST_VALUES", limit)
    items = spark.createDataFrame(ITEMS, "item_id string, list_name string, label string, other_names string")
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit("crit")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("p"))
    c = canonical.map_values(df, items, ["p"]).groupBy("item_id").count().collect()
    assert {r.item_id: r["count"] for r in c} == {"P1": 1000, "none": 2000}
    assert canonical.map_values(df.limit(0), items, ["p"]).count() == 0
    assert canonical.map_values(df, items.limit(0), ["p"]).count() == 3000


def test_slips_against_brute_force(spark):
    letters = "abcd"
    rng = random.Random(6)

    def ball(w):
        out = {w}
        out |= {w[:i] + w[i + 1 :] for i in range(len(w))}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        return out | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}

    refs = ["".join(rng.choice(letters) for _ in range(n)) for n in (5, 6, 8)]
    typed = {"".join(rng.choice(letters) for _ in range(rng.randint(3, 10))) for _ in range(300)}
    for r in refs:
        one = sorted(ball(r))
        typed |= set(rng.sample(one, min(len(one), 40)))
        for _ in range(150):
            typed.add(rng.choice(sorted(ball(rng.choice(one)))))
    t = spark.createDataFrame([("l", w) for w in sorted(typed) if w], "list_name string, w string")
    k = spark.createDataFrame([("l", r) for r in refs], "list_name string, r string")
    got = {(x.w, x.r): x.slips for x in canonical.similar_words(t, k).collect()}
    for r in refs:
        b1 = ball(r)
        b2 = set().union(*(ball(x) for x in b1))
        for w in typed:
            want = 0 if w == r else 1 if w in b1 else 2 if w in b2 else None
            if len(w) >= 3:
                assert got.get((w, r)) == want, (w, r)


# --- tokens ----------------------------------------------------------------------------

TEXTS = ["", " ", "Hello world", "it's  we'll\n\n  x", "<|endoftext|>", "a" * 5000, "ab" * 3000 + " é" * 500, "Привет, мир 👩‍💻", "日本語テキスト", "\x00\x01", "x\r\ny\t z   ", "1234567890 3.14 e-5", "́ combining", " " * 3000 + "x"]


def test_ids_equal_the_public_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate([*TEXTS, None])], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    for i, x in enumerate(TEXTS):
        assert got[i] == t.encode(x, add_special_tokens=False).ids, repr(x[:40])
    assert got[len(TEXTS)] == [] and got[0] == []
    assert tokens.encode(df.limit(0)).count() == 0


def test_both_merges_agree_and_decode():
    ranks = tokens.read_ranks()
    back = {v: k for k, v in ranks.items()}
    rng = random.Random(8)
    for _ in range(200):
        w = bytes(rng.choice(b"abcdethisnot \xc3\xa9") for _ in range(rng.randint(1, 60)))
        ids = tokens.merge_short(w, ranks)
        assert ids == tokens.merge_long(w, ranks)
        assert b"".join(back[i] for i in ids) == w


# --- mixing ----------------------------------------------------------------------------


@pytest.mark.parametrize(("length", "off"), [(None, 1), (64, 2)])
def test_every_prefix_is_within_a_block_of_its_share(spark, length, off):
    for quota in ({"a": 22_000, "b": 15_500, "c": 1_200, "d": 600, "e": 0}, {"a": 9_000, "b": 8_900, "c": 8_800, "d": 300}):
        frame, n = mixing.schedule(spark, quota, 100, length)
        plan = [(r.source, r.block_no, r.slot) for r in frame.orderBy("slot").collect()]
        blocks = {s: -(-q // 100) for s, q in quota.items() if q}
        assert n == len(plan) and sorted((s, k) for s, k, _ in plan) == sorted((s, k) for s, m in blocks.items() for k in range(m))
        assert [x for *_, x in plan] == list(range(len(plan)))
        done = dict.fromkeys(blocks, 0)
        for i, (s, k, _) in enumerate(plan, 1):
            assert k == done[s]
            done[s] += 1
            assert all(abs(done[x] - i * blocks[x] / len(plan)) < off for x in blocks)


def test_frames_of_uneven_sources():
    rng = random.Random(2)
    for _ in range(60):
        counts = [max(1, int(rng.paretovariate(0.8) * 8)) for _ in range(rng.randint(1, 9))]
        n, length = sum(counts), 32
        ends = [*range(0, n, length), n]
        done, at = [0] * len(counts), 0
        for a, z in zip(ends, ends[1:]):
            start, end = mixing.before(a, counts), mixing.before(z, counts)
            assert start == done and sum(end) == z
            if min(y - x for x, y in zip(start, end)) < 0:
                break  # a source with less than one unit a frame: the library takes longer frames
            for s in mixing.edf([y - x for x, y in zip(start, end)])[0]:
                done[s] += 1
                at += 1
                assert all(abs(done[i] - at * c / n) < 2 for i, c in enumerate(counts))
        assert mixing.frame_length(counts) >= min(mixing.LONGEST, n / min(counts))


def mix(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string, n_tokens bigint")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mixing.Mixture(d, t, **kw)


def test_shares_caps_and_shortfalls(spark):
    docs = [(i, "big", "word " * 50, 1) for i in range(400)] + [(1000 + i, "small", "word " * 50, 1) for i in range(20)] + [(2000, "other", "x", 1), (2001, None, "x", 1), (2002, "big", None, 1), (2003, "big", "", 1)]
    targets = [("big", 0.6, 1), ("small", 0.2, 3), ("none", 0.2, 5)]
    m = mix(spark, docs, targets, block=200)
    s = {r.source: r for r in m.shares().collect()}
    assert s["none"].actual_tokens == 0 and s["none"].shortfall_tokens == s["none"].target_tokens > 0
    assert s["big"].shortfall_tokens == s["small"].shortfall_tokens == 0
    assert s["big"].actual_share / s["small"].actual_share == pytest.approx(3, rel=0.05)
    rows = m.rows().collect()
    assert {r.source for r in rows} == {"big", "small"} and max(r.repeat_no for r in rows if r.source == "small") <= 3 and {r.repeat_no for r in rows if r.source == "big"} == {1}
    assert len({(r.doc_id, r.repeat_no) for r in rows}) == len(rows)
    assert len({(r.slot, r.slot_offset) for r in rows}) == len(rows)
    big = {r.source: r for r in mix(spark, docs, targets, block=200, total_tokens=10**6).shares().collect()}
    assert (big["small"].repeats, big["big"].repeats) == (3, 1) and big["small"].shortfall_tokens > 0
    e = mix(spark, docs[:0], targets)
    assert e.rows().count() == 0 and {r.actual_tokens for r in e.shares().collect()} == {0}


def test_registered_mixture_is_of_all_tokens(spark, tmp_path):
    docs = [(i, "big", "word " * 50) for i in range(40)] + [(100, "scarce", "word " * 50), (200, "other", "word " * 50), (201, None, "word " * 50)]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("big", 0.7, 1), ("scarce", 0.2, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    s = {r.source: r for r in queries.p9_shares(spark, str(tmp_path)).collect()}
    n = s["scarce"].source_tokens
    total = 43 * n
    assert {k: r.target_tokens for k, r in s.items()} == {"big": int(0.7 * total), "scarce": int(0.2 * total), "none": int(0.1 * total)}
    assert s["scarce"].actual_tokens == 2 * n and s["scarce"].shortfall_tokens == int(0.2 * total) - 2 * n
    assert s["big"].shortfall_tokens == 0 and s["none"].shortfall_tokens == s["none"].target_tokens
    rows = queries.p9_mixture(spark, str(tmp_path)).collect()
    assert sorted(r.repeat_no for r in rows if r.source == "scarce") == [1, 2] and {r.source for r in rows} == {"big", "scarce"}


# --- look-alikes -----------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Handover", "Ｈаndоvеr", True), ("é à ñ", "é à ñ", True), ("a b", "a b", True), ("a b", "a　b", True), ("ab", "a​b﻿⁠­", True), ("K", "K", True), ("ΑΒΕ ο", "ABE o", True), ("й", "й", True), ("👩‍💻!", "👩‍💻‍!", True), ("Ｋａ", "Ka", True), ("x²", "x²", True),
        ("a b", "a  b", False), ("A", "a", False), ("e", "é", False), ("2", "²", False), ("1", "①", False), ("a\nb", "a\r\nb", False), ("a-b", "a–b", False), ("0", "O", False), ("1", "l", False), ("👩‍💻", "👩💻", False), ("rn", "m", False), ("a b", "a\tb", False), ("'", "’", False),
    ],
)
def test_skeletons(a, b, same):
    assert (lookalike.skeleton(a) == lookalike.skeleton(b)) is same


def test_pairs_and_classes(spark):
    texts = ["Note A", "Nоte A", "Note A", "Note​ A", "Note B", None, "", " ", " ", "​", "﻿", "y" * 100_000, "у" + "y" * 99_999]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, skeleton string")
    got = {tuple(r) for r in lookalike.same_look_pairs(df).collect()}
    assert got == {(0, 1), (0, 3), (1, 2), (1, 3), (2, 3), (11, 12)}
    assert {(r.doc_id, r.class_id, r.texts) for r in lookalike.look_classes(df).collect()} == {(0, 0, 3), (1, 0, 3), (2, 0, 3), (3, 0, 3), (11, 11, 2), (12, 11, 2)}
    assert lookalike.same_look_pairs(df.limit(0)).count() == 0
    assert {r.doc_id for r in lookalike.consistent_texts(df).where("skeleton IS NULL").collect()} == {5}


def test_skeleton_is_stable_and_total():
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(0x2000, 0x2100), rng.randrange(0xFF00, 0xFFE0), rng.randrange(0x1D400, 0x1D800), 0x200D, 0x1F469])) for _ in range(30))
        k = lookalike.skeleton(s)
        assert lookalike.skeleton(k) == k


@pytest.mark.parametrize(("a", "b", "same"), [("ᎠᎡᎢ", "DRT", True), ("ГПФ", "ΓΠΦ", True), ("Ⅷ ǉ ﬄ", "VIII lj ffl", True), ("ⲞⲔ", "OK", True), ("rn", "m", False), ("0", "O", False), ("②", "2", False), ("…", "...", False)])
def test_other_scripts_and_several_characters(a, b, same):
    assert (lookalike.skeleton(a) == lookalike.skeleton(b)) is same


def test_published_table_as_a_parameter(spark, tmp_path):
    f = tmp_path / "confusables.txt"
    f.write_text("﻿# comment\n\n0438 ; 0075 ; MA # и -> u\n10428 ; 006F ; MA\nA732 ; 0041 0041 ; MA\n0030 ; 004F ; MA # 0 -> O\n006D ; 0072 006E ; MA\n")
    t = lookalike.replacements(str(f))
    sk = lambda x: lookalike.skeleton(x, t)
    assert sk("и") == "u" and sk("Ꜳ") == "AA" and sk("é0m") != sk("éOrn") and sk("𐐨") == "o"
    df = spark.createDataFrame([(1, "bиs"), (2, "bus")], "doc_id bigint, text string")
    assert {r.skeleton for r in lookalike.consistent_texts(df, str(f)).collect()} == {"bus"}


def test_hot_looks_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "HOT", 7)
    texts = ["Note а", "Note a", "Nоte a"]
    df = spark.createDataFrame([(i, texts[i % 3]) for i in range(60)] + [(100, "other")], "doc_id bigint, text string")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 3 != j % 3}
    rows = [tuple(r) for r in lookalike.same_look_pairs(df).collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_marks_are_a_parameter(spark):
    items = spark.createDataFrame(ITEMS, "item_id string, list_name string, label string, other_names string")
    df = spark.createDataFrame([(1, "vermutlich critical"), (2, "suspected critical")], "row_id bigint, p string")
    got = lambda **kw: {r.row_id: r.item_id for r in canonical.map_values(df, items, ["p"], **kw).collect()}
    assert got() == {1: "none", 2: "P1"} and got(marks=canonical.Marks(("vermutlich",))) == {1: "P1", 2: "none"}
