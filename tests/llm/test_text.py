import os
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratelathe.llm import lookalikes, mojibake, packing, tokenize

PROPER = ["A Maçã anã (2004)", "Große Straße", "Чужая Дорога", "Гёте и ТРЁХ", "ГОЛОС…", "A MAÇÃ…", "Żółta Gwiazda", "déjà vu « été »", "¿Dónde está?", "静かな夜", "Ναι: Νύχτα", "—él dijo", "bênção de coração", "BĂŞICĂ", "‚Ähnlich‘", "", "plain"]
SPOILT = [(t, e) for t in ("größer Café déjà", "Příběh: žlutá", "поздний финал", "Żółta Gwiazda – „tak”", "静かな夜", "Niño’s año") for e in ("latin-1", "cp1252", "cp1251", "mac_roman", "cp437")]


def spoil(text, encoding):
    table = {b: c for c, b in mojibake._bytes_of(encoding).items()}
    return "".join(chr(b) if b < 0x80 else table.get(b, chr(b)) for b in text.encode())


@pytest.mark.parametrize("text", PROPER)
def test_proper_text_stays(text):
    assert mojibake.restore(text) is None


@pytest.mark.parametrize(("text", "encoding"), SPOILT)
def test_multibyte_round_trip(text, encoding):
    assert mojibake.restore(spoil(text, encoding)) == text


@pytest.mark.parametrize(("text", "encoding"), [("Duluvuto’s Ferry", "cp437"), ("Lucky – Quarry", "cp850"), ("Die frühe Brücke", "cp1250"), ("canción", "iso8859-2")])
def test_single_signs(text, encoding):
    assert mojibake.restore(spoil(text, encoding)) == text


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", "cp437", "koi8-r", "cp866"])
@pytest.mark.parametrize("text", ["한국어 영화", "مرحبا بالعالم", "שלום עולם", "สวัสดีชาวโลก", "नमस्ते दुनिया", "Việt Nam ơi", "ok 🤣🥰", "größer Café déjà", "поздний финал"])
def test_scripts_and_encodings(text, encoding):
    assert mojibake.restore(spoil(text, encoding)) == text


@pytest.mark.parametrize("text", ["PŘÍBĚH: POSLEDNÍ ŘÍŠE", "voilà\xa0« ça\xa0»", "работа и её сад", "ЁЛКА и моё «всё»", "Νέα· «ΑΘΉΝΑ»", "한국어", "שלום", "Việt Nam ơi", "हिन्दी", "🤣 ok"])
def test_proper_scripts_stay(text):
    assert mojibake.restore(text) is None


@pytest.mark.parametrize(("text", "encoding"), [("中国电影", "gb2312"), ("무한도전 영화", "euc_kr"), ("静かな夜と星", "euc_jp"), ("電影院的故事", "big5")])
def test_double_bytes(text, encoding):
    """Restored, or marked without a guess; never anything else."""
    seen = text.encode(encoding).decode("latin-1")
    assert mojibake.restore(seen) in (text, seen)


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252"])
@pytest.mark.parametrize("times", [1, 2, 3, 5, 7])
@pytest.mark.parametrize("text", ["Amélie", "Canción", "Größe", "Ông Việt Nam", "Чужая"])
def test_spoilt_again_and_again(text, encoding, times):
    seen = text
    for _ in range(times):
        seen = spoil(seen, encoding)
    assert mojibake.restore(seen) == text


@pytest.mark.parametrize("text", ["Ìîñêâà ñëåçàì", "«ÉÈÙ»", "AÇÕES", "ÀÉÈÙ çà êôû"])
def test_no_double_bytes(text):
    assert mojibake.restore(text) is None


def test_every_span_passes_the_pattern(spark):
    texts = [spoil(t, e) for t, e in SPOILT] + [spoil(t, e) for t in ("한국어", "Việt Nam", "🤣", "größer", "поздний") for e in mojibake.READ_AS]
    texts += [t.encode(e).decode("latin-1") for t, e in (("中国电影", "gb2312"), ("静かな夜と星", "euc_jp"), ("静かな夜", "shift_jis"))]
    df = spark.createDataFrame([(t,) for t in texts if mojibake.restore(t) is not None], "t string")
    assert df.count() > 60 and df.filter(~F.col("t").rlike(mojibake.may_hold_spans())).count() == 0


def test_spoilt_twice_and_in_part():
    assert mojibake.restore("╬£╬╣╬▒ ╬æ¤à╬╗╬« ¤â¤ä╬┐ ¤å¤ë¤é") == "Μια Αυλή στο φως"
    assert mojibake.restore(spoil(spoil("Canción", "cp1252"), "cp1252")) == "Canción"
    assert mojibake.restore("año y niÃ±o") == "año y niño"


def test_repaired_records(spark):
    proper = ["schöne Größe", "kühle Bühne", "la canción", "el año nuevo", "Binekevi’s Lantern"]
    rows = [(k, proper[k % 5], "x") for k in range(200)] + [(900, "B¸hne", "x"), (901, "la canci≤n", "x"), (902, "ni�o", "x"), (903, "GrÃ¶ÃŸe", "x"), (904, None, "x"), (905, "", "x"), (906, "kühle Bühne" * 2_000, "x"), (907, "GrÃ¶ÃŸe", "x")]
    df = spark.createDataFrame(rows, "rid int, txt string, text string")
    found = {r["id"]: (r["restored"], r["kind"]) for r in mojibake.repaired(df, "rid", "txt").collect()}
    assert found == {900: ("Bühne", "single byte"), 901: ("la canción", "single byte"), 902: (None, "lost"), 903: ("Größe", "multibyte"), 907: ("Größe", "multibyte")}
    assert mojibake.repaired(df.limit(0), "rid", "txt").count() == 0


def test_rare_and_hot_single_bytes(spark):
    """A spoiled word whose original is nowhere else, and one spelling spoiled in as many records as it is right."""
    right = [f"la canción {k}" for k in range(20)]
    proper = ["µTorrent", "Ωmega", "col·lecció", "CaféÉtoile", "Сafé", "Niño’s", "T€xt", "„so“ ja", "9 µm", "don´t", "Łódź"]
    spoilt = {"A Irmπ perdida": "A Irmã perdida", "pi±ata": None, "йtй": "été"}
    rows = [*right, "a Irmã perdida", *["la canci≤n 1"] * 60, *["la canciÛn 2"] * 60, *proper, *spoilt]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "rid int, txt string")
    found = {r["text"]: (r["restored"], r["kind"]) for r in mojibake.repaired(df, "rid", "txt").collect()}
    right_again = {"la canci≤n 1": "la canción 1", "la canciÛn 2": "la canción 2", **spoilt}
    assert found == {t: (r, "single byte") for t, r in right_again.items()}


ALIKE = {}


@pytest.fixture(autouse=True, scope="module")
def alike(spark):
    ALIKE.update(lookalikes._alike(spark))


def reference_form(text):
    return None if text is None else unicodedata.normalize("NFC", "".join(lookalikes._pieces_of(c, ALIKE) for c in text if c not in "\u200c\u200d"))


TEXTS = ["Café", "Café", "Ｃａｆé", "Са​fé", "ậ", "ậ", "ậ", "á̧", "́x", "q́́", "  two  spaces here", "CAFÉ", "ﬁx", "Ångström Å", "가", "👍🎞️", "​", "", None, "x" * 50_000 + "é", "ё и й", "ώ", "é‍̣", "a\nb\tc"]


def test_forms_against_the_library(spark):
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(TEXTS)], "k int, body string, form string")
    found = {r["id"]: r["form"] for r in lookalikes.normal_forms(df, "k", "body").collect()}
    assert found == {k: reference_form(t) for k, t in enumerate(TEXTS)}


def test_forms_of_random_text(spark):
    rng = np.random.default_rng(2)
    pool = list("aeEо̧̣́̂​  éộｅ") + ["Å", "क़"]
    texts = ["".join(rng.choice(pool, 12)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    assert {r["id"]: r["form"] for r in lookalikes.normal_forms(df, "k", "body").collect()} == {k: reference_form(t) for k, t in enumerate(texts)}


def test_forms_of_hangul(spark):
    rng = np.random.default_rng(3)
    pool = [*"한국가각ᄀ하ᅡᅵᆨᇂᄒᆧᅶ́a ", "\u200b", "ﾡ", "\u1160", *map(lambda x: unicodedata.normalize("NFD", x), "한국어각힣")]
    texts = ["".join(rng.choice(pool, 12)) for _ in range(300)] + ["한국어 영화", unicodedata.normalize("NFD", "한국어 영화")]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    assert {r["id"]: r["form"] for r in lookalikes.normal_forms(df, "k", "body").collect()} == {k: reference_form(t) for k, t in enumerate(texts)}
    assert [tuple(r) for r in lookalikes.look_alikes(df.filter("k >= 300"), "k", "body").collect()] == [(300, 301)]


SAME = [("П", "Π"), ("Г", "Γ"), ("Ф", "Φ"), ("օ", "o"), ("հ", "h"), ("ɑ", "a"), ("Ⅰ", "I"), ("‐", "-"), ("Ｗ", "W"), ("ﾊ", "ハ"), ("a\u200bb", "ab"), ("a\u200db", "ab"), ("so\u00adft", "soft"), ("x\u00a0y", "x y"), ("о́", "ó"), ("한", "한"), ("ΑΒΓ", "АВГ"), ("ộ", "ộ"), ("\ufeffx", "x")]
APART = [("a", "A"), ("0", "O"), ("1", "l"), ("I", "l"), ("é", "e"), ("ı", "i"), ("’", "'"), ("–", "-"), ("x  y", "x y"), ("۝", ""), ("\u0600", ""), ("\u070f", ""), ("👨\u200d👩\u200d👧", "👨👩👧"), ("🏴\U000e0067\U000e0062\U000e007f", "🏴"), ("می\u200cخواهم", "میخواهم"), ("3", "З"), ("г", "r"), ("σ", "o"), ("ﬁ", "fi"), ("²", "2")]


def test_what_looks_the_same_and_what_does_not(spark):
    """Pairs written out by hand, within words and alone."""
    rows = [(k, f"w{x}w {x}") for k, x in enumerate([x for pair in SAME + APART for x in pair])]
    found = {r["id"]: r["form"] for r in lookalikes.normal_forms(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    same = [found[2 * k] == found[2 * k + 1] for k in range(len(SAME + APART))]
    assert [p for p, s in zip(SAME, same) if not s] == [] and [p for p, s in zip(APART, same[len(SAME) :]) if s] == []


def test_classes_of_look_alikes(spark):
    rows = [(1, "Café"), (2, "Cafe\u0301"), (3, "Café"), (4, "CAFÉ"), (5, None), (6, "СOP"), (7, "COP"), (8, "alone"), (9, "alone")]
    found = lookalikes.look_alike_classes(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (6, 6, 1), (7, 6, 1)]


def test_pairs_of_look_alikes(spark):
    rows = [(1, "Café"), (2, "Café"), (3, "Café"), (4, "CAFÉ"), (5, " "), (6, " "), (7, None), (8, "СOP"), (9, "COP"), (10, "C0P")]
    df = spark.createDataFrame(rows, "id int, t string")
    assert sorted(tuple(r) for r in lookalikes.look_alikes(df, "id", "t").collect()) == [(1, 2), (1, 3), (8, 9)]
    assert lookalikes.look_alikes(df.limit(0), "id", "t").count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    if not os.path.exists(f"{tokenize.VOCABULARIES}/byte_bpe_50k.tiktoken"):
        pytest.skip("no vocabulary files")
    ranks = tokenize.read_ranks(f"{tokenize.VOCABULARIES}/byte_bpe_50k.tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(spark, tokenizer):
    texts = ["Hello, world's  end \n\n x", "", None, "<|endoftext|>", "naïve Straße поздний 静かな夜 👍", "a" * 3_000, "qwrtzplkjhgfdsyxcvbnm" * 15, "tab\tand nbsp em \x1c sep\x85", "   ", "it's '‘ll 12345 3.5e-7", "word " * 20_000, "'S'T"]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "k bigint, body string, ids int")
    encoded = tokenize.encode(df, "k", "body")
    assert {r["id"]: r["ids"] for r in encoded.collect()} == {k: tokenizer.encode_ordinary(t or "") for k, t in enumerate(texts)}
    back = {r["id"]: r["again"] for r in tokenize.decode(encoded, "ids", "again").collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert tokenize.encode(df.limit(0), "k", "body").count() == 0


def test_a_word_of_a_million_letters(tokenizer):
    """Random letters, base64 and Chinese without a space: parted where no token reaches over, the ids are the same."""
    import regex

    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000)), "".join(rng.choice(list("静かな夜电影院的故事"), 20_000)), "Zm9vYmFyIGJhcnF1eA" * 500]
    found = tokenize.WordEncoder(tokenize.read_ranks(f"{tokenize.VOCABULARIES}/byte_bpe_50k.tiktoken")).encode([regex.findall(tokenize.PATTERN, w) for w in words])
    assert found.to_pylist() == [tokenizer.encode_ordinary(w) for w in words]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_random_text(texts):
    tiktoken = pytest.importorskip("tiktoken")
    import regex

    ranks = tokenize.read_ranks(f"{tokenize.VOCABULARIES}/byte_bpe_50k.tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    own = test_random_text.__dict__.setdefault("own", tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
    coder = test_random_text.__dict__.setdefault("coder", tokenize.WordEncoder(ranks))
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert coder.encode([regex.findall(tokenize.PATTERN, t) for t in texts]).to_pylist() == [own.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60))
def test_packing_fits(sizes):
    bins = packing.pack(np.array(sizes, np.int64), 50)
    filled = np.bincount(bins, weights=sizes)
    assert filled.max() <= 50
    # No two containers could be one.
    assert sorted(filled)[0] + (sorted(filled)[1] if len(filled) > 1 else 51) > 50 or len(filled) == 1 or len(set(bins)) < len(filled)


def test_two_for_one():
    # The largest item first leaves 10 + 7 (gap 3); 7 gives way to 6 + 4, which fills the container.
    bins = packing.pack(np.array([10, 7, 6, 4, 4]), 20)
    assert sorted(np.bincount(bins, weights=[10, 7, 6, 4, 4]).tolist()) == [11, 20]


def test_containers(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 900, 500).tolist() + [1_024, 2_048, 2_500, 5_000, 0, None, -3]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "doc int, size int")
    for shard in (100, 100_000):
        rows = packing.fill_containers(df, "doc", "size", 1_024, shard).collect()
        filled, parts = {}, {}
        for r in rows:
            filled[r["container_id"]] = filled.get(r["container_id"], 0) + r["length"]
            parts.setdefault(r["id"], []).append((r["part"], r["start"], r["length"]))
        assert max(filled.values()) <= 1_024
        for k, s in enumerate(sizes):
            p, s = sorted(parts[k]), max(s or 0, 0)
            assert [x[0] for x in p] == list(range(len(p))) and sum(x[2] for x in p) == s
            assert [x[1] for x in p] == [1_024 * j for j in range(len(p))]
            assert len(p) == max(1, -(-s // 1_024))
        assert len(filled) <= 1.03 * sum(max(s or 0, 0) for s in sizes) / 1_024 + 6
    assert packing.fill_containers(df.limit(0), "doc", "size", 1_024).count() == 0


def test_look_alikes_need_the_library():
    with pytest.raises(RuntimeError, match="ICU"):
        lookalikes._alike(None)
