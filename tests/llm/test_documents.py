import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from turnloom.llm import expand, lookalikes, mixture, tokens

DOCS = "doc_id long, text string, source string, form string, class_id int"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "s", "x", 1) for i, t in enumerate(texts)], DOCS)


# --- token ids

def test_ids_round_trip(spark):
    texts = ["", None, " ", "a", "<|endoftext|> is text", "naïve — 👩‍💻 日本語", "x\n\n  y\t", "1 " * 40_000, "word " * 30_000 + "<|endoftext|>", "é" * 120_000, "a" * 120_000]
    got = dict(tokens.encoded(docs(spark, *texts)).collect())
    for i, t in enumerate(texts):
        assert tokens.decode(got[i]).decode() == (t or "")
    assert got[0] == got[1] == []
    whole = tokens.encoding(None)
    for i in (4, 5, 6, 7, 8):
        assert got[i] == whole.encode_ordinary(texts[i])
    assert tokens.encoded(docs(spark, "a").limit(0)).count() == 0


def test_pieces_are_encoded_as_the_whole():
    r = random.Random(1)
    e = tokens.encoding(None)
    for _ in range(200):
        t = "".join(r.choice(["a", "b1", " ", "  ", "\n", " ", "é", "!?", "'s", "日", "\t", "1"]) for _ in range(400))
        assert "".join(tokens.pieces(t, 40)) == t
        assert [i for p in tokens.pieces(t, 40) for i in e.encode_ordinary(p)] == e.encode_ordinary(t)


def test_same_vocabulary_in_another_library():
    library = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    t = library.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ("Hello  world\n\n<|endoftext|>", "Ελληνικά ρήμα, 日本語。", "don't  stop"):
        assert tokens.encode(text) == t.encode(text, add_special_tokens=False).ids


# --- look-alikes

def test_look_alikes(spark):
    same = [["café x", "café x", "ｃａｆé x", "cаfé​ x"], ["office", "oﬃce", "oﬀice"], ["ёж", "ёж", "ëж"], ["ガ", "ｶﾞ"], ["q̣̇", "q̣̇"], ["ώ", "ώ"]]
    alone = ["cafe x", "Café x", "x2", "x²", "①", "1", "١", "№", "No", "½", "naive", "naïve", "", " ", "​", None, "K", "k"]
    texts = [t for g in same for t in g] + alone + ["office", "cafe x"]
    df = docs(spark, *texts)
    got = {tuple(r) for r in lookalikes.pairs(df).collect()}
    groups, at = [], 0
    for g in same:
        groups.append(list(range(at, at + len(g))))
        at += len(g)
    groups[1].append(len(texts) - 2)
    want = {(a, b) for g in groups for a in g for b in g if a < b and texts[a] != texts[b]}
    assert got == want
    forms = dict(lookalikes.canonical(df).select("doc_id", "text").collect())
    for g in groups:
        assert len({forms[i] for i in g}) == 1
    assert len({forms[i] for i in range(len(texts) - 2)} - {None}) == len(same) + len(alone) - 1
    assert lookalikes.pairs(df.limit(0)).count() == lookalikes.canonical(df.limit(0)).count() == 0


def test_long_text_with_one_odd_letter(spark):
    t = "plain words " * 30_000
    assert [tuple(r) for r in lookalikes.pairs(docs(spark, t, t.replace("plain", "plаin", 1), t)).collect()] in ([(0, 1), (1, 2)], [(1, 2), (0, 1)])


def test_map_leaves_what_differs():
    before, after, several = lookalikes.character_map()
    assert not set("²①½№éÉß0aA'") & (set(before) | set(several))
    assert all(unicodedata.normalize("NFC", c) == c for c in after)


# --- mixing

TARGETS = "source string, weight double, max_repeats int, documents int"


def test_mix(spark):
    rows = [(i, "word " * (5 + i % 7), s, "x", 1) for i, s in enumerate(["big"] * 300 + ["small"] * 20 + ["untargeted"] * 9 + [None] * 3)] + [(900, None, "big", "x", 1), (901, "", "small", "x", 1)]
    d = spark.createDataFrame(rows, DOCS)
    t = spark.createDataFrame([("big", 0.5, 2, 1), ("small", 0.4, 3, 1), ("absent", 0.1, 5, 1), (None, 0.3, 1, 1)], TARGETS)
    picks, report = mixture.mix(d, t)
    r = {x.source: x for x in report.collect()}
    got = picks.collect()
    assert r["small"].epochs == 3 and r["small"].mixed_tokens == 3 * r["small"].source_tokens
    assert abs(r["big"].actual_share - 0.5 / 0.9) < 0.02 and r["absent"].actual_share == 0 and r["untargeted"].mixed_tokens == 0
    assert {x.source for x in got} == {"big", "small"} and max(x.copies for x in got if x.source == "big") <= 2
    assert not {900, 901} & {x.doc_id for x in got}
    for s in ("big", "small"):
        assert 0 <= r[s].target_tokens - r[s].mixed_tokens < 15
        assert sum(x.tokens * x.copies for x in got if x.source == s) == r[s].mixed_tokens
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixture.mix(d.repartition(7), t)[0].collect()))
    assert sorted(map(tuple, got)) != sorted(map(tuple, mixture.mix(d, t, seed=1)[0].collect()))
    over = {x.source: x for x in mixture.mix(d, t, total_tokens=10**7)[1].collect()}
    assert over["big"].mixed_tokens == 2 * over["big"].source_tokens


def test_prefix_of_keys_is_taken(spark):
    """The picks of a fraction are those with the least keys, as one sort of all rows would have it."""
    d = spark.createDataFrame([(i, "word " * (1 + i % 50), "a", "x", 1) for i in range(2000)], DOCS)
    t = spark.createDataFrame([("a", 1.0, 1, 1)], TARGETS)
    total = 12_345
    picks = {r.doc_id for r in mixture.mix(d, t, total_tokens=total)[0].collect()}
    rows = d.select("doc_id", tokens.count_of(F.col("text")).alias("n"), mixture.sample_key(mixture.quality(F.col("text")), F.col("doc_id")).alias("k")).orderBy("k", "doc_id").collect()
    want, used = set(), 0
    for r in rows:
        if used + r.n > total:
            break
        used += r.n
        want.add(r.doc_id)
    assert picks == want


def test_mix_of_nothing(spark):
    d = spark.createDataFrame([], DOCS)
    t = spark.createDataFrame([("a", 1.0, 2, 1), ("b", None, None, 1)], TARGETS)
    picks, report = mixture.mix(d, t)
    assert picks.count() == 0 and {r.source for r in report.collect()} == {"a", "b"}
    assert mixture.mix(d, t.limit(0))[1].count() == 0


def test_skeletons_of_equal_looks_are_equal(spark):
    """Composed, decomposed and reordered forms of a text have one skeleton; texts that differ in plain letters have not."""
    r = random.Random(4)
    rows = []
    for i in range(400):
        t = "".join(r.choice(["a", "e", "K", ";", "`", "1", " ", "é", "ạ́", "が", "漢", "豈", "한", "ё", "ώ", "≮", "́", "̣", "ﬁ", "K", ";", "`", "ẛ̣"]) for _ in range(r.randint(1, 12)))
        rows += [(i, unicodedata.normalize("NFC", t)), (i, unicodedata.normalize("NFD", t)), (i, t)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", lookalikes.skeleton(lookalikes.mapped(F.col("t"))).alias("s")).groupBy("i").agg(F.count_distinct("s").alias("n")).where("n > 1")
    assert got.count() == 0
    plain = docs(spark, "alpha", "alphb", "漢字", "漢学").select(lookalikes.skeleton(F.col("text")).alias("s")).distinct()
    assert plain.count() == 4


def test_collation_groups_and_the_exact_form_splits(spark):
    """Texts that the collation takes for one although they look different are split; those it takes for one and that are one stay whole."""
    df = docs(spark, "room 1 x", "room ١ x", "rооm 1 x", "room ١ x", "lone")
    members = lookalikes.members_of(df, lookalikes.digests(df))
    members.createOrReplaceTempView("m_")
    looks = spark.sql("select count(*) as n, count(distinct exact) as e from m_ group by collate(form, 'UNICODE')").collect()
    assert {(r.n, r.e) for r in looks} == {(4, 2)} or {(r.n, r.e) for r in looks} == {(2, 1)}
    assert {tuple(x) for x in lookalikes.pairs(df).collect()} == {(0, 2), (1, 3)}


def test_often_copied_variants_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(expand, "COPIES", 3)
    texts = ["some text", "sоme text", "some text"] * 8 + ["other"]
    got = [tuple(r) for r in lookalikes.pairs(docs(spark, *texts)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(24) for b in range(a + 1, 24) if texts[a] != texts[b]}
