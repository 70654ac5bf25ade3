"""One consistent form for text that looks the same but is made of different characters.

Texts that hold no character that may change keep themselves. The others are taken apart into positioned pieces: runs
that are the same in any form, words of letters and marks, and single other characters with what belongs to them. Each
distinct piece that may change is then brought to its form once: exploded to positioned code points, joined with the
decomposition and look-alike table, its marks put in order of their class, recomposed, and rebuilt. Forms are joined
back to the pieces and the texts rebuilt in order.

The form keeps what can be seen: case, accents, punctuation, digits and the number of spaces. It drops what Unicode
calls default-ignorable (but joiners where they shape letters or join pictures, and the tags of a flag, are seen and
stay), gives up the width of signs and spaces, composes accents and Hangul letters as Unicode's NFC does, and writes
letters of different scripts that look alike as one of them. Which letters do is taken from the confusables of Unicode's
security data (UTS 39), as the ICU library within Spark has them, for letters of one case in the scripts of ``SCRIPTS``;
likenesses within ASCII or of digits and signs do not count, nor those of ``NOT_ALIKE``. Where that library is missing,
nothing is compared: fewer likenesses would look like fewer look-alikes.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelathe.session import broadcast_if_small, cut

#: Letters that look like a Latin one, and that Latin one, by script.
CYRILLIC, CYRILLIC_AS = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеорсухѕіјһԁԛԝүӏ", "ABESIJKMHOPCTYXYGQWaeopcyxsijhdqwyl"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϳϲ", "ABEZHIKMNOPTYXaivopujc"
#: Scripts whose letters may look alike, with their ranges; Latin letters beyond ASCII that look like one in
#: it; and letters that the published data liken to others although they are told apart when shown.
SCRIPTS = {"GREEK": (0x370, 0x3FF), "CYRILLIC": (0x400, 0x52F), "ARMENIAN": (0x530, 0x58F), "CHEROKEE": (0x13A0, 0x13FF), "COPTIC": (0x2C80, 0x2CFF), "HIRAGANA": (0x3041, 0x3096), "KATAKANA": (0x30A1, 0x30FA), "CJK": (0x4E00, 0x9FFF)}
LATIN_ALIKE, NOT_ALIKE = "ɑɡ", "σςгγѵптвнмкəЪъЬьыЫҺᎥ"
#: Hyphens that are shown as the ASCII one, and Roman numerals of one letter with it.
HYPHENS, NUMERALS, NUMERALS_AS = "\u2010\u2011", "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm"
#: Unicode's default-ignorable code points but the joiners, as ranges; and spaces that differ in width only.
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200B), (0x200E, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE001F), (0xE0080, 0xE0FFF)]
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
#: Joiners count after letters of joining and Indic scripts and after pictures, tags after a flag or a tag. (Characters
#: beyond the first plane must stand in the pattern themselves: only then does Java look behind at whole characters.)
JOINED = "".join(rf"\p{{Is{x}}}" for x in "Arabic Syriac Nko Mongolian Mandaic Phags_Pa Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Khmer Myanmar Tibetan".split()) + r"\p{So}\x{fe0f}\x{200c}\x{200d}" + "\U0001f3fb-\U0001f3ff"
JOINERS, TAGS = rf"(?<![{JOINED}])[\x{{200c}}\x{{200d}}]+", r"(\x{1f3f4}[\x{e0020}-\x{e007f}]+)|[\x{e0020}-\x{e007f}]+"
#: Blocks of characters that are common and mostly the same in any form.
COMMON = [(0x00, 0x7F), (0xA1, 0x17F), (0x370, 0x52F), (0x2010, 0x2027), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
#: No character decomposes to more than a base and three marks.
MARKS = 3
CLUSTER_MARKS = r"[\p{M}\p{Cf}]*"
#: Letters that form words, whose pieces are whole words.
ALPHA = r"[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]"
#: Hangul letters that stand together with what precedes them (and two fillers); letters or a syllable and a letter that compose.
LETTERS = r"\x{1100}-\x{11ff}\x{3164}\x{ffa0}"
SYLLABLES = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11a8}-\x{11c2}]?|[\x{ac00}-\x{d7a3}][\x{11a8}-\x{11c2}]|(?s:.)"


@lru_cache
def _alike(spark: SparkSession) -> dict[int, str]:
    """Letters with the one of their look that stands for them. Letters of one look and case form a class; its ASCII
    letter stands for it if it has one, else a Cyrillic one, else the first. RuntimeError without the ICU library."""
    held = dict(zip(map(ord, CYRILLIC + GREEK + NUMERALS), CYRILLIC_AS + GREEK_AS + NUMERALS_AS)) | {ord(x): "-" for x in HYPHENS}
    try:
        checker = getattr(spark._jvm.com.ibm.icu.text.SpoofChecker, "Builder")().build()
    except (AttributeError, TypeError) as e:
        raise RuntimeError("letters that look alike are taken from the ICU library (icu4j) of Spark's own JVM, which this session lacks") from e
    letters = [chr(k) for k in range(0x41, 0x7B) if chr(k).isalpha()] + list(LATIN_ALIKE) + [chr(k) for lo, hi in SCRIPTS.values() for k in range(lo, hi + 1)]
    letters = [x for x in letters if unicodedata.category(x) in ("Lu", "Ll", "Lo") and unicodedata.normalize("NFKD", x) == x and x not in NOT_ALIKE]
    looks = checker.getSkeleton("\n".join(letters)).split("\n")
    classes: dict[tuple[str, str], list[str]] = {}
    for x, look in zip(letters, looks, strict=True):
        if len(look) == 1 and unicodedata.category(look)[0] == "L":
            classes.setdefault((look, unicodedata.category(x)), []).append(x)
    for members in classes.values():
        ascii_ones = [x for x in members if x.isascii()]
        if len(ascii_ones) > 1 or len(members) < 2:
            continue
        first = (ascii_ones or [x for x in members if "\u0400" <= x <= "\u052f"] or members)[0]
        held |= {ord(x): held.get(ord(x), first) for x in members if x != first}
    return held


def _pieces_of(ch: str, alike: dict[int, str]) -> str:
    """What a character stands for, fully decomposed; nothing if it is ignorable."""
    if any(lo <= ord(ch) <= hi for lo, hi in IGNORABLE):
        return ""
    if ord(ch) in SPACES:
        return " "
    if 0xAC00 <= ord(ch) <= 0xD7A3:
        return ch
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    if kind in ("<wide>", "<narrow>"):
        return "".join(_pieces_of(chr(int(x, 16)), alike) for x in rest.split())
    return unicodedata.normalize("NFD", ch).translate(alike)


@lru_cache
def _tables(spark: SparkSession) -> tuple[list[tuple[str, list[tuple[str, int]]]], list[tuple[str, str, str]], str]:
    """Characters with what they stand for and the marks' classes (only those that are not merely themselves); pairs of
    characters with the one they compose; and the ranges of common characters that keep their form."""
    stands, composed, alike = [], [], _alike(spark)
    for ch in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.category(ch) in ("Cs", "Cn", "Co") and not 0xE0000 <= ord(ch) <= 0xE0FFF and not 0xFFF0 <= ord(ch) <= 0xFFF8:
            continue
        parts = _pieces_of(ch, alike)
        if parts != ch or unicodedata.combining(ch):
            stands.append((ch, [(x, unicodedata.combining(x)) for x in parts]))
        direct = unicodedata.decomposition(ch).split()
        if len(direct) == 2 and "<" not in direct[0] and unicodedata.normalize("NFC", ch) == ch:
            composed.append((*(chr(int(x, 16)) for x in direct), ch))
    active = {ch for ch, parts in stands if unicodedata.normalize("NFC", "".join(x for x, _ in parts)) != ch}
    keep = [k for lo, hi in COMMON for k in range(lo, hi + 1) if chr(k) not in active and not unicodedata.combining(chr(k)) and unicodedata.category(chr(k)) not in ("Cf", "Mn", "Me", "Mc")]
    ranges, start = [], None
    for k, after in zip(keep, [*keep[1:], -1]):
        start = k if start is None else start
        if after != k + 1:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{k:x}}}")
            start = None
    return stands, composed, "".join(ranges)


def _stands(spark: SparkSession) -> DataFrame:
    """Bounded by the number of Unicode characters that have a decomposition or a mark's class; about 5 000 rows."""
    return F.broadcast(spark.createDataFrame(_tables(spark)[0], "ch string, parts array<struct<ch:string,class:int>>"))


def _compositions(spark: SparkSession) -> DataFrame:
    """Bounded by the number of composed Unicode characters; about 1 000 rows."""
    return F.broadcast(spark.createDataFrame(_tables(spark)[1], "base string, mark string, whole string"))


def _cut_up(text: Column, keep: str) -> Column:
    """A text's pieces in order. A run of kept characters ends before a mark's base and before a word that is not kept
    to its end; words, Hangul letters and any other characters come with the marks after them."""
    still = f"[{keep}]+(?:\\z|(?<!{ALPHA})(?![{LETTERS}\\p{{M}}\\p{{Cf}}]))"
    word = f"{ALPHA}(?:{ALPHA}|[\\p{{M}}\\p{{Cf}}])*+".replace(f"(?:{ALPHA}|[\\p{{M}}\\p{{Cf}}])", f"[{ALPHA}\\p{{M}}\\p{{Cf}}]")
    hangul = f"[{LETTERS}\\x{{ac00}}-\\x{{d7a3}}]{CLUSTER_MARKS}(?:[{LETTERS}]{CLUSTER_MARKS})*"
    return F.regexp_extract_all(text, F.lit(f"{still}|{word}|{hangul}|(?s:.){CLUSTER_MARKS}"), 0)


def _hangul(form: Column) -> Column:
    """``form`` with its Hangul letters composed to syllables, by their numbers."""

    def whole(part: Column) -> Column:
        number = lambda k: F.ascii(F.substring(part, k, 1))
        trail = lambda k: F.when(F.length(part) == k, number(k) - 0x11A7).otherwise(0)
        letters = 0xAC00 + ((number(1) - 0x1100) * 21 + number(2) - 0x1161) * 28 + trail(3)
        open_one = (number(1) >= 0xAC00) & ((number(1) - 0xAC00) % 28 == 0)
        code = F.when(number(1) < 0xAC00, letters).when(open_one, number(1) + trail(2))
        return F.when((F.length(part) == 1) | code.isNull(), part).otherwise(F.decode(F.unhex(F.hex(code)), "UTF-16BE"))

    composed = F.array_join(F.transform(F.regexp_extract_all(form, F.lit(SYLLABLES), 0), whole), "")
    return F.when(form.rlike(r"[\x{1161}-\x{1175}\x{11a8}-\x{11c2}]"), composed).otherwise(form)


def cluster_forms(clusters: DataFrame) -> DataFrame:
    """``piece, form`` of each of the distinct, non-null ``piece`` of ``clusters``."""
    spark = clusters.sparkSession
    points = clusters.select("piece", F.posexplode(F.split("piece", "")).alias("at", "ch")).filter("ch <> ''")
    parts = points.join(_stands(spark), "ch", "left")
    whole = F.array(F.struct(F.col("ch").alias("ch"), F.lit(0).alias("class")))
    placed = parts.select("piece", "at", F.posexplode(F.coalesce("parts", whole)).alias("sub", "x")).select("piece", "at", "sub", "x.ch", "x.class")
    order = Window.partitionBy("piece").orderBy("at", "sub")
    # Marks belong to the base before them; those of a base are ordered by class, equal ones as they stand.
    based = placed.withColumn("base_no", F.sum(F.when(F.col("class") == 0, 1).otherwise(0)).over(order))
    groups = based.groupBy("piece", "base_no").agg(F.array_sort(F.collect_list(F.struct("class", "at", "sub", "ch"))).alias("all"))
    headed = F.col("all")[0]["class"] == 0
    bases = groups.select("piece", "base_no", F.when(headed, F.col("all")[0]["ch"]).otherwise("").alias("base"), F.when(headed, F.slice("all", 2, F.size("all"))).otherwise(F.col("all")).alias("marks"))
    bare, marked = bases.filter("size(marks) = 0"), bases.filter("size(marks) > 0")
    for _ in range(MARKS):
        marked = _compose(marked, _compositions(spark))
    bases = bare.unionByName(marked)
    built = bases.select("piece", "base_no", F.concat("base", F.array_join(F.transform("marks", lambda m: m["ch"]), "")).alias("part"))
    rebuilt = built.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("base_no", "part"))).alias("parts"))
    forms = rebuilt.select("piece", _hangul(F.array_join(F.transform("parts", lambda p: p["part"]), "")).alias("form"))
    return clusters.join(forms, "piece", "left").select("piece", F.coalesce("form", F.lit("")).alias("form"))


def _compose(bases: DataFrame, compositions: DataFrame) -> DataFrame:
    """Each base with the first of its marks that it composes with; a mark after one of its own class is blocked."""
    tried = bases.select("piece", "base_no", "base", "marks", F.posexplode_outer("marks").alias("at", "m"))
    free = (F.col("at") == 0) | (F.col("m.class") > F.get("marks", F.col("at") - 1)["class"])
    tried = tried.withColumn("mark", F.when(free, F.col("m.ch"))).drop("m")
    pairs = compositions.select(F.col("base").alias("of"), F.col("mark").alias("with"), "whole")
    joined = tried.join(pairs, (F.col("base") == F.col("of")) & (F.col("mark") == F.col("with")), "left")
    best = F.min(F.when(F.col("whole").isNotNull(), F.struct("at", "whole")))
    found = joined.groupBy("piece", "base_no").agg(F.first("base").alias("base"), F.first("marks").alias("marks"), best.alias("best"))
    at = F.col("best.at")
    rest = F.concat(F.slice("marks", F.lit(1), at), F.slice("marks", at + 2, F.size("marks")))
    return found.select("piece", "base_no", F.coalesce("best.whole", "base").alias("base"), F.when(at.isNotNull(), rest).otherwise(F.col("marks")).alias("marks"))


def normal_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, text, form`` of every row: ``form`` is the text in its consistent form; null for a null text, empty for an
    empty one or one of invisible signs only. ``key`` need not be unique; other columns are ignored."""
    keep = _tables(df.sparkSession)[2]
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    # Joiners and tags that show nothing go first, as what stands before them decides.
    seen = F.regexp_replace(F.regexp_replace("text", JOINERS, ""), TAGS, "$1")
    rows = rows.withColumn("seen", F.when(F.col("text").rlike(r"[\x{200c}\x{200d}\x{e0020}-\x{e007f}]"), seen).otherwise(F.col("text")))
    changing = F.coalesce(F.col("seen").rlike(f"[^{keep}]"), F.lit(False))
    rows = cut(rows.withColumn("changing", changing).withColumn("row", F.monotonically_increasing_id()))
    pieces = rows.filter("changing").select("row", F.posexplode(_cut_up(F.col("seen"), keep)).alias("at", "piece"))
    same = F.col("piece").rlike(f"\\A[{keep}]+\\z")
    clusters = cut(pieces.filter(~same).groupBy("piece").agg(F.count("*").alias("n")).select("piece"))
    forms = broadcast_if_small(cut(cluster_forms(clusters).filter("form <> piece")))
    formed = pieces.join(forms, "piece", "left").select("row", "at", F.coalesce("form", "piece").alias("form"))
    texts = formed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "form"))).alias("parts"))
    built = texts.select("row", F.array_join(F.transform("parts", lambda p: p["form"]), "").alias("form"))
    changed = rows.filter("changing").join(built, "row", "left").select("id", "text", F.coalesce("form", F.lit("")).alias("form"))
    return rows.filter("not changing").select("id", "text", F.col("seen").alias("form")).unionByName(changed)


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id_a, id_b`` (smaller first) of every two rows whose texts have one form but are not the same string. Rows with
    null or blank text are left out. Distinct texts are paired first, their rows joined to them afterwards; rows with
    the same string are never paired."""
    forms = normal_forms(df.filter(F.col(text).rlike(r"(?U)\S")), key, text)
    rows = cut(forms.select("id", F.sha2("text", 256).alias("t"), F.sha2("form", 256).alias("f")))
    texts = rows.groupBy("f", "t").agg(F.count("*").alias("n"))
    several = texts.groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("f")
    ours = cut(texts.join(several, "f").select("f", "t"))
    apart = ours.join(ours.select("f", F.col("t").alias("u")), "f").filter("t < u").select("t", "u")
    members = rows.select("id", "t")
    pairs = apart.join(members, "t").select(F.col("id").alias("one"), "u").join(members.withColumnRenamed("t", "u"), "u")
    return pairs.select(F.least("one", "id").alias("id_a"), F.greatest("one", "id").alias("id_b")).filter("id_a <> id_b").distinct()


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, class_id, links`` of every row that looks like another one: ``class_id`` is the least id of the rows that
    look the same, ``links`` the number of those whose string is another. What ``look_alikes`` has in pairs, in one row
    a record; for collections in which many look the same."""
    forms = normal_forms(df.filter(F.col(text).rlike(r"(?U)\S")), key, text)
    rows = cut(forms.select("id", F.sha2("text", 256).alias("t"), F.sha2("form", 256).alias("f")))
    texts = rows.groupBy("f", "t").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = texts.groupBy("f").agg(F.sum("n").alias("all"), F.count("*").alias("texts"), F.min("least").alias("class_id")).filter("texts > 1")
    wanted = texts.join(classes, "f").select("f", "t", "class_id", (F.col("all") - F.col("n")).alias("links"))
    return rows.join(wanted, ["f", "t"]).select("id", "class_id", "links")
