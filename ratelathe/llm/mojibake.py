"""Text that was decoded with a wrong character encoding: finding it and restoring the original.

Multibyte originals. A text's characters are mapped back to the bytes of each legacy encoding it may have been read in;
an automaton over the structure of UTF-8 (or Shift JIS) bytes finds the maximal well-formed spans, and only these are
decoded, again and again until the result holds no such span (text spoiled twice or more). A span counts if what it
decodes to is ordinary writing and the span itself is not: a single letter before a dash or a quote stays as it is.
Spans of double bytes (GB 2312, EUC-KR, EUC-JP, Big5) are told by signs and case within them; they are decoded if one
of these encodings alone gives common characters of one language, else only marked.

Single-byte originals have no structure, so the corpus decides. Every window of characters around a non-ASCII one is
counted over all records and over all distinct texts. A window is spoiled if re-reading it, from one of the legacy
encodings to another, gives a window that is far more frequent by either count. Free of counts, it is spoiled if its
middle cannot stand in that word (a letter of another script, a sign between letters) and a re-reading can; a capital
after a small letter needs some texts that hold the reading. Only distinct windows are re-read, so the cost of this
follows the variety of the text and not its volume.

Replacement characters (U+FFFD) and C1 control characters mark a record as affected in any case. What they stood for
may be lost; the rest is restored all the same.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelathe.llm.lookalikes import CYRILLIC, GREEK
from ratelathe.session import broadcast_if_small, cut

#: Encodings with all letters where UTF-8 has first bytes, or many where it has others: only signs show a span.
SIGNS_SHOW = ("koi8-r", "cp866", "cp1253")
#: Encodings that text may have been read in by mistake, the likelier first; single-byte ones that it may have been written in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "cp1250", "iso8859-2", "cp850", "cp852", *SIGNS_SHOW)
WRITTEN_IN = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866")
#: Characters of ordinary writing, as ranges.
ORDINARY = re.compile("[\t\n -~\u00a0-\u017f\u0218-\u021bΑ-ώЁЄІЇЎ-яёєіїўҐґ\u1e80-\u1e85\u1ef2\u1ef3\u2010-\u2026‰‹›€№™\u3000-\u30ff\u4e00-\u9fff\uff01-\uff60\uffe0-\uffe6\U0001f300-\U0001f6ff]")
UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
SHIFT_JIS = re.compile(rb"(?:[\x81-\x84\x88-\x9f][\x40-\x7e\x80-\xfc]){2,}")
#: Signs that may follow a letter in proper text, and letters that Cyrillic text holds although legacy tables put them among the signs.
FOLLOWS_LETTER, ODD_LETTERS = set("«»Ёё‘’“”…–—›"), set("ƒªº")
LOST = "[\ufffd\u0080-\u0084\u0086-\u009f]"
#: Records that must hold a re-read window, and how many times those of the window as it is.
MIN_RECORDS, MIN_TIMES = 8, 10
#: Double-byte encodings with the first bytes of common characters, by kind: of letters and of ideographs.
DOUBLE_BYTE = {"gb2312": ((0xB0, 0xF7),), "euc_kr": ((0xB0, 0xC8),), "euc_jp": ((0xA4, 0xA5), (0xB0, 0xF4)), "big5": ((0xA4, 0xC6), (0xC9, 0xF9))}
#: Neighbouring characters that double bytes are read as, four at least.
PAIRS = re.compile("[\u00a1-\u00fe](?:[@-~]?[\u00a1-\u00fe]){3,}")
#: The same two, in distinct texts, for a capital after a small letter.
FLIP_TEXTS, FLIP_TIMES = 2, 2
#: Signs that proper words hold; other characters than symbols and numbers that they do not hold between letters.
IN_WORDS, NOT_IN_WORDS = set("´`×™®©°"), set("„‚‡†§¶ªº")
#: Greek and Cyrillic letters that may be meant to look like a Latin one.
LOOK_LATIN = set(CYRILLIC + GREEK)


@lru_cache
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte for the upper half; bytes without a character stand for the C1 control of their number."""
    found: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            found.setdefault(bytes([b]).decode(encoding), b)
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        if b not in found.values() or encoding in ("cp1252", "cp1250"):
            found.setdefault(chr(b), b)
    return found


@lru_cache
def _charmap(encoding: str) -> dict[int, int]:
    """The same for all of a text: ASCII stays, and what is neither becomes a question mark, so places are kept."""
    return {k: k for k in range(0x80)} | {ord(x): b for x, b in _bytes_of(encoding).items()}


def _span_counts(seen: str, read: str, before: str, after: str, encoding: str) -> bool:
    """Whether a well-formed span ``seen`` of ordinary writing ``read`` is spoiled text, given its neighbours."""
    if len(read) > 2 or any(x in ODD_LETTERS or not x.isalpha() and x not in FOLLOWS_LETTER for x in seen):
        return True
    if any(x.islower() and y.isupper() for x, y in zip(seen, seen[1:])):
        return True
    if any("Ѐ" <= x <= "ӿ" for x in seen):
        latin = any("a" <= x.lower() <= "z" for x in before + after)
        return len(read) > 1 or latin and not "Ѐ" <= read <= "ӿ"
    if len(read) > 1 or len(seen) > 2 and "\u2010" <= read <= "\u203a":
        return True
    if encoding in ("cp1250", "iso8859-2"):
        return seen[0] in "ÂĂÄĹ" and seen[1:].isalpha() and seen[1] not in "Şş"  # Romanian has these after Ă
    return encoding in ("cp1252", "latin-1") and (after.isalpha() or seen[1:].isalpha())


@lru_cache(None)
def _block(x: str) -> str:
    """The script of an assigned letter, mark, sign or number, by its name; empty for any other character."""
    return unicodedata.name(x, "").split("-")[0].split(" ")[0] if unicodedata.category(x)[0] in "LMNPS" else ""


def _writing_in(text: str, at: int, read: str, encoding: str) -> list[tuple[int, int, str]]:
    """The parts of a well-formed span from ``at`` that decode to writing: ordinary characters, and any others that are
    in it with another one of their script, that are Latin letters, signs outside the first plane or marks on a letter,
    or that are the bytes of text spoiled twice."""
    scripts = Counter(_block(x) for x in read)
    signs = lambda seen: any(not y.isalnum() and not y.isspace() and y not in FOLLOWS_LETTER for y in seen)
    whole = text[at : at + len(read.encode())]
    flips = len(read) > 1 and any(x.islower() and y.isupper() for x, y in zip(whole, whole[1:]))
    shows = encoding not in SIGNS_SHOW or flips or signs(whole)
    parts, before = [], text[at - 1 : at]
    for x in read:
        n = len(x.encode())
        seen = text[at : at + n]
        script = _block(x)
        other = script and (scripts[script] > 1 or script == "LATIN" and (n > 2 or signs(seen)) or n > 3 or unicodedata.combining(x) and _script(before) == "latin" and signs(seen))
        joiner = x in "\u200c\u200d" and parts and parts[-1][1] == at
        twice = "\x80" <= x <= "\x9f" and parts and parts[-1][1] == at and ("Â" <= before <= "ô" or "\x80" <= before <= "\xbf")
        if shows and (ORDINARY.match(x) or other or joiner or twice):
            if parts and parts[-1][1] == at:
                parts[-1] = (parts[-1][0], at + n, parts[-1][2] + x)
            else:
                parts.append((at, at + n, x))
        at, before = at + n, x
    return parts


def _decode_spans(text: str, encoding: str) -> tuple[str, int]:
    """``text`` with its spoiled spans decoded, and the number of characters in them."""
    raw = codecs.charmap_encode(text, "replace", _charmap(encoding))[0]
    ordinary = [x for m in UTF8.finditer(raw) for x in _writing_in(text, m.start(), m.group().decode(), encoding)]
    # One span that counts speaks for the others in the text.
    if not any(_span_counts(text[a:z], read, text[a - 1 : a], text[z : z + 1], encoding) for a, z, read in ordinary):
        ordinary = []
    out, at, covered = [], 0, 0
    for a, z, read in ordinary:
        out += (text[at:a], read)
        at = z
        covered += z - a
    if not covered and encoding in ("cp1252", "latin-1"):
        for m in SHIFT_JIS.finditer(raw):
            try:
                read = m.group().decode("shift_jis")
            except UnicodeDecodeError:
                continue
            # What is UTF-8 for the most part is no Shift JIS.
            if 2 * sum(map(len, UTF8.findall(m.group()))) > len(m.group()):
                continue
            if any(0x81 <= x <= 0x84 for x in m.group()[::2]) and all(ORDINARY.match(x) and ord(x) > 0x2FF for x in read):
                out += (text[at : m.start()], read)
                at = m.end()
                covered += m.end() - m.start()
    return "".join([*out, text[at:]]), covered


def _one_language(read: str, encoding: str) -> bool:
    """Whether all that a span decodes to is common writing of the language of the encoding."""
    kana = [x for x in read if "\u3041" <= x <= "\u30fc"]
    if encoding == "euc_kr":
        return all("가" <= x <= "힣" for x in read)
    if encoding == "euc_jp":
        return 3 * len(kana) >= len(read) and all(x in kana or "\u3001" <= x <= "\u9fff" for x in read)
    return not kana and all("\u4e00" <= x <= "\u9fff" for x in read)


def _double_bytes(text: str) -> tuple[str, int]:
    """``text`` with its spans of double bytes decoded where one encoding alone gives writing, and the characters in them."""
    covered = 0

    def read(m: re.Match) -> str:
        nonlocal covered
        seen = m.group()
        signs = any(not x.isalpha() for x in seen[1:] if x not in FOLLOWS_LETTER)
        flips = any(x.islower() and y.isupper() for x, y in zip(seen, seen[1:]))
        raw = seen.encode("latin-1")
        cyrillic = raw.decode("cp1251", "replace").strip("«»")
        # What is UTF-8 for the most part is not double bytes.
        if 2 * sum(map(len, UTF8.findall(raw))) > len(raw):
            return seen
        if not (signs and flips) and not (signs and len(seen) > 5) or cyrillic.isalpha() or sum(x < 0xC0 for x in raw) * 4 < len(raw):
            return seen
        fits = []
        for encoding, leads in DOUBLE_BYTE.items():
            try:
                decoded = raw.decode(encoding)
            except UnicodeDecodeError:
                continue
            if 2 * len(decoded) == len(raw) and all(any(lo <= x <= hi for lo, hi in leads) for x in raw[::2]) and _one_language(decoded, encoding):
                fits.append(decoded)
        covered += len(seen) if fits else 0
        return fits[0] if len(set(fits)) == 1 else seen

    return PAIRS.sub(read, text), covered


def restore(text: str) -> str | None:
    """``text`` with its multibyte spans decoded; null if it has none. Each round takes the encoding whose spans cover
    most characters; it ends as each round makes the text shorter."""
    found = None
    while not text.isascii():
        best, covered = "", 0
        for encoding in READ_AS:
            result, n = _decode_spans(text, encoding)
            if n > covered:
                best, covered = result, n
        other, n = _double_bytes(text)
        if n > covered:
            return other
        if not covered:
            break
        found = text = best
    return found


def may_hold_spans() -> str:
    """A pattern that every text with multibyte spans matches: a first byte and a next one in one of the encodings, a
    sign or a capital after a small letter in those whose spans only these show, or first bytes of Shift JIS."""
    escaped = lambda xs: "".join(f"\\x{{{ord(x):x}}}" for x in sorted(xs))
    found, signs = ["[\\x{81}-\\x{84}‚ƒ„]"], set()
    for encoding in READ_AS:
        table = _bytes_of(encoding)
        if encoding in SIGNS_SHOW:
            signs |= {x for x in table if not x.isalnum() and not x.isspace() and x not in FOLLOWS_LETTER}
        else:
            found.append(f"[{escaped(x for x, b in table.items() if 0xC2 <= b <= 0xF4)}][{escaped(x for x, b in table.items() if b <= 0xBF)}]")
    return "|".join([*found, f"[{escaped(signs)}]", "[^\\x00-\\x7f&&[\\p{Ll}]][^\\x00-\\x7f&&[\\p{Lu}]]", "[\\x{a1}-\\x{fe}][@-~]?[\\x{a1}-\\x{fe}]"])


def _restore_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = pa.array([restore(x) for x in batch.column("text").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("n"), column], names=["text", "n", "restored"])


def _windows(text: Column) -> Column:
    """Every five characters around a non-ASCII one, with spaces beyond either end."""
    return F.regexp_extract_all(F.concat(F.lit("  "), text, F.lit("  ")), F.lit("(?s)(?=(..[^\\x00-\\x7f]..))"), 1)


def _script(x: str) -> str:
    """The script of a letter of the legacy encodings; empty for any other character."""
    if not x.isalpha() or x in "ªº":
        return ""
    if x.isascii() or "À" <= x <= "\u024f" or "\u1e00" <= x <= "\u1eff":
        return "latin"
    return "greek" if x == "µ" or "Ͱ" <= x <= "Ͽ" else "cyrillic" if "Ѐ" <= x <= "ԯ" else ""


def _odd(window: str) -> int:
    """Whether the middle of a window cannot stand in its word: 2 if no proper word holds it, 1 for a capital after a
    small letter, which some names have, and 0 if it can."""
    _, b, x, a, z = window
    own = _script(x)
    if own:
        if own != "latin" and x not in LOOK_LATIN and ("latin" in (_script(b), own == "cyrillic" and z.islower() and _script(a))):
            return 2
        return int(b.islower() and x.isupper())
    if not _script(b):
        return 0
    if x == "„" or "\u2500" <= x <= "\u259f" and a != x:
        return 2
    sign = unicodedata.category(x)[0] in "SN" and x not in IN_WORDS or x in NOT_IN_WORDS
    return 2 * (sign and bool(_script(a) or unicodedata.category(a)[0] == "S"))


def _fits(reading: str, was: str) -> bool:
    """Whether the middle of a re-read window is a letter that goes with its neighbours; a first letter keeps its case."""
    _, b, x, a, _ = reading
    beside = {_script(b), _script(a)} - {""}
    if not beside or beside != {_script(x)}:
        return False
    if not _script(b) and was.isalpha() and was.islower() != x.islower():
        return False
    return not (b.islower() and x.isupper() or b.isupper() and (a.isupper() and x.islower() or a.islower() and x.isupper()))


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each distinct window, what it would have been for each pair of encodings: alike for its middle character only
    and for all of it. A letter read for a letter is compared with two neighbours on either side, else with one. ``odd``
    tells whether the reading mends a middle that cannot stand in its word, ``rank`` is smaller for likelier encodings."""
    pairs = [(_bytes_of(r), w) for r in READ_AS for w in WRITTEN_IN if r != w]

    @lru_cache(None)
    def other(x: str, k: int) -> str | None:
        table, written = pairs[k]
        if x not in table:
            return None
        try:
            return bytes([table[x]]).decode(written)
        except UnicodeDecodeError:
            return None

    for batch in batches:
        rows: dict[tuple[str, str, str, str, int], int] = {}
        for window in batch.column("window").to_pylist():
            mid, odd = window[2], _odd(window)
            for k in range(len(pairs)):
                new = other(mid, k)
                if new is None or new == mid or not ORDINARY.match(new):
                    continue
                cut_to = slice(0, 5) if new.isalpha() and mid.isalpha() else slice(1, 4)
                whole = [other(x, k) or x for x in window]
                for reading in (window[:2] + new + window[3:], "".join(whole)):
                    rows.setdefault((window, window[cut_to].lower(), reading[cut_to].lower(), new, odd if odd and _fits(reading, mid) else 0), k)
        columns = [*zip(*rows)] or [[], [], [], [], []]
        types = [pa.string()] * 4 + [pa.int32()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, list(rows.values())], types)], names=["window", "own", "reading", "mid", "odd", "rank"])


def spoiled_windows(texts: DataFrame) -> DataFrame:
    """``window, mid``: the windows that are far rarer than one of their readings, or that hold what no word does and a
    reading mends, with the middle character of the most frequent reading; null if no text holds any of several.
    ``texts`` has ``text`` and ``n``, the records that hold it, a row per distinct text; rows that are null or ASCII
    hold no window."""
    windows = texts.select("n", F.explode(F.array_distinct(_windows(F.col("text")))).alias("window"))
    counts = cut(windows.groupBy("window").agg(F.sum("n").alias("n"), F.count("*").alias("texts")))
    both = F.explode(F.array(F.lower("window"), F.lower(F.substring("window", 2, 3)))).alias("key")
    keys = cut(counts.select(both, "n", "texts").groupBy("key").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")))
    readings = counts.select("window").mapInArrow(_readings, "window string, own string, reading string, mid string, odd int, rank int")
    known = readings.join(keys.select(F.col("key").alias("reading"), F.col("n").alias("new"), F.col("texts").alias("new_texts")), "reading", "left")
    known = known.filter("new is not null or odd = 2").fillna(0, ["new", "new_texts"])
    old = known.join(keys.select(F.col("key").alias("own"), F.col("n").alias("old"), F.col("texts").alias("old_texts")), "own")
    far = lambda new, old, least, times: (F.col(new) >= least) & (F.col(new) >= times * F.col(old))
    counted = far("new", "old", MIN_RECORDS, MIN_TIMES) | far("new_texts", "old_texts", MIN_RECORDS, MIN_TIMES)
    better = old.filter(counted | (F.col("odd") == 2) | (F.col("odd") == 1) & far("new_texts", "old_texts", FLIP_TEXTS, FLIP_TIMES))
    best = better.groupBy("window").agg(F.max(F.struct("new", -F.col("rank"), "mid")).alias("best"), F.min("mid").alias("lo"), F.max("mid").alias("hi"))
    return best.select("window", F.when((F.col("best.new") > 0) | (F.col("lo") == F.col("hi")), F.col("best.mid")).alias("mid"))


def _reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, pairs_of = [], batch.column("pairs").to_pylist()
        for text, pairs in zip(batch.column("base").to_pylist(), pairs_of):
            if pairs:
                mids, padded = {p["window"]: p["mid"] for p in pairs}, f"  {text}  "
                text = "".join(mids.get(padded[k : k + 5]) or text[k] for k in range(len(text)))
            out.append(text)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("text", "restored")), pa.array(out, pa.string()), pa.array([bool(p) for p in pairs_of])], names=["text", "restored", "reread", "single"])


def repaired(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, text, restored, kind`` of every affected record: ``restored`` is the text as far as it can be had back
    (null if nothing can), ``kind`` is ``multibyte``, ``single byte``, or ``lost`` if only lost characters show it.
    Records with null, empty or ASCII text are not affected. Each distinct text is looked at once and its records share
    the result; ``key`` need not be unique, each row is a record."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("text").rlike("[^\\x00-\\x7f]"))
    distinct = cut(rows.groupBy("text").agg(F.count("*").alias("n")))
    spans = F.col("text").rlike(may_hold_spans())
    decoded = distinct.filter(spans).mapInArrow(_restore_all, "text string, n bigint, restored string")
    decoded = decoded.unionByName(distinct.filter(~spans).withColumn("restored", F.lit(None).cast("string")))
    decoded = cut(decoded.withColumn("row", F.monotonically_increasing_id()))
    base = F.coalesce("restored", "text")
    spoiled = broadcast_if_small(cut(spoiled_windows(decoded.groupBy(base.alias("text")).agg(F.sum("n").alias("n")))))
    held = decoded.select("row", F.explode(F.array_distinct(_windows(base))).alias("window")).join(spoiled, "window")
    pairs = held.groupBy("row").agg(F.collect_list(F.struct("window", "mid")).alias("pairs"))
    joined = decoded.withColumn("base", base).join(pairs, "row", "left").select("text", "restored", "base", "pairs")
    reread = joined.mapInArrow(_reread, "text string, restored string, reread string, single boolean")
    lost = F.col("text").rlike(LOST)
    hit = reread.filter(F.col("restored").isNotNull() | F.col("single") | lost)
    name = F.when(F.col("restored").isNotNull(), "multibyte").when(F.col("single"), "single byte").otherwise("lost")
    affected = cut(hit.select("text", F.when(F.col("reread") != F.col("text"), F.col("reread")).alias("restored"), name.alias("kind")))
    return rows.join(broadcast_if_small(affected), "text").select("id", "text", "restored", "kind")
