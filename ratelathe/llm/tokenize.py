"""Encoding a whole corpus with a public byte-pair tokenizer, by recursive queries in each partition.

Every partition splits its texts into words by the tokenizer's pattern and encodes each distinct word once, in DuckDB:
the words' bytes are rows of word, position and token; a recursive query joins neighbouring tokens with the merge table
and contracts, in each step, the pair of least rank of every word, from the left, until no word has a pair that merges.
An ordered aggregation then puts the tokens of each text's words together. Nothing is shuffled, and a partition's
memory is bounded by a slice of its texts and a store of known words that starts anew when it is full.

A long word is first parted wherever two neighbouring bytes stand side by side in no token at all: no merge can ever
cross such a place, so its parts have the same tokens as the whole, and are short and often known. Decoding is an
ordered aggregation of the tokens' bytes.

In a step, all places of a word's least pair contract at once. That is the same as one at a time: a pair that holds the
new token was learnt after it and so has a higher rank.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files, described in its README; a parameter wherever it is used.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that parts a text into words, published with the byte_bpe vocabularies. Its white space is
#: Unicode's, without the four separators that Python counts as well.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"^\s", r"^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")
#: Characters of text in a slice, bytes of words encoded at once, known words before the store starts anew.
SLICE_CHARS, WORD_BYTES, KNOWN_WORDS = 1_000_000, 400_000, 200_000
#: Steps before finished words leave the recursion, and rows that all steps together may make (they are kept until then).
STEPS, STEP_ROWS = 40, 8_000_000
#: Characters above which a word is looked through for places that no token spans.
LONG_WORD = 24

#: One row per word, position and token. ``run`` numbers neighbouring places of the least pair, of which each second one is taken.
CONTRACT = """
WITH RECURSIVE s(w, p, t, k) AS (
  SELECT w, p, t, 0 FROM start
  UNION ALL
  (WITH pairs AS (SELECT *, lead(t) OVER (PARTITION BY w ORDER BY p) AS u FROM s WHERE k < {steps}),
    ranked AS (SELECT w, p, t, k, merged, min(merged) OVER (PARTITION BY w) AS least FROM pairs LEFT JOIN merges ON a = t AND b = u),
    hits AS (SELECT *, coalesce(merged = least, false) AS hit FROM ranked WHERE least IS NOT NULL),
    runs AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY p) - row_number() OVER (PARTITION BY w, hit ORDER BY p) AS run FROM hits),
    taken AS (SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, run ORDER BY p) % 2 = 1 AS take FROM runs),
    gone AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY w ORDER BY p), false) AS eaten FROM taken)
   SELECT w, p, CASE WHEN take THEN least ELSE t END, k + 1 FROM gone WHERE NOT eaten))
SELECT s.w, s.p, s.t, s.k FROM s JOIN (SELECT w, max(k) AS k FROM s GROUP BY w) m ON s.w = m.w AND s.k = m.k
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of a vocabulary in the .tiktoken format: base64 and a number on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class WordEncoder:
    """Encodes words with DuckDB; one for each Python worker's partition."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.joins = np.zeros((256, 256), bool)
        for token in ranks:
            row = np.frombuffer(token, np.uint8)
            self.joins[row[:-1], row[1:]] = True
        self.bytes = [ranks.get(bytes([b]), -1) for b in range(256)]
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self._load("merges", ["a", "b", "merged"], list(zip(*pairs)) or [[], [], []])
        self._reset()

    def _load(self, name: str, columns: list[str], values: list) -> None:
        arrow_rows = pa.table([pa.array(v, pa.int32()) for v in values], names=columns)  # noqa: F841
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arrow_rows")

    def _reset(self) -> None:
        self.known: dict[str | bytes, int] = {}
        self.db.execute("CREATE OR REPLACE TABLE tokens (w INTEGER, p INTEGER, t INTEGER)")

    def _parted(self, word: str) -> list[str | bytes]:
        """The parts of a word that no token crosses; the word itself if it is short or one part."""
        if len(word) <= LONG_WORD:
            return [word]
        raw = word.encode("utf-8", "surrogatepass")
        codes = np.frombuffer(raw, np.uint8)
        ends = [0, *(np.flatnonzero(~self.joins[codes[:-1], codes[1:]]) + 1).tolist(), len(raw)]
        return [raw[a:z] for a, z in zip(ends, ends[1:])] if len(ends) > 2 else [word]

    def _encode_new(self, words: list[str | bytes]) -> None:
        batch: list[tuple[int, bytes]] = []
        size = 0
        for word in words:
            raw = word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass")
            batch.append((self.known.setdefault(word, len(self.known)), raw))
            size += len(raw)
            if size >= WORD_BYTES:
                self._contract(batch)
                batch, size = [], 0
        if batch:
            self._contract(batch)

    def _contract(self, batch: list[tuple[int, bytes]]) -> None:
        rows = [(w, p, self.bytes[b]) for w, raw in batch for p, b in enumerate(raw)]
        self._load("start", ["w", "p", "t"], list(zip(*rows)))
        # A word that took all steps goes on in another recursion, which starts from its last state alone.
        left = len(rows)
        while left:
            steps = max(2, min(STEPS, STEP_ROWS // left))
            self.db.execute(f"CREATE OR REPLACE TABLE state AS {CONTRACT.format(steps=steps)}")
            self.db.execute(f"INSERT INTO tokens SELECT w, p, t FROM state WHERE k < {steps}")
            self.db.execute(f"CREATE OR REPLACE TABLE start AS SELECT w, p, t FROM state WHERE k = {steps}")
            left = self.db.execute("SELECT count(*) FROM start").fetchone()[0]

    def encode(self, texts: list[list[str]]) -> pa.ListArray:
        """The token ids of each text, given as its words."""
        texts = [[part for word in words for part in self._parted(word)] for words in texts]
        new = dict.fromkeys(w for words in texts for w in words if w not in self.known)
        if new and len(self.known) + len(new) > KNOWN_WORDS:
            self._reset()
            new = dict.fromkeys(w for words in texts for w in words)
        self._encode_new(list(new))
        docs = [d for d, words in enumerate(texts) for _ in words]
        places = [k for words in texts for k in range(len(words))]
        self._load("places", ["d", "k", "w"], [docs, places, [self.known[w] for words in texts for w in words]])
        self._load("docs", ["d"], [list(range(len(texts)))])
        found = self.db.sql(
            "SELECT coalesce(ids, []::INTEGER[]) AS ids FROM docs LEFT JOIN (SELECT d, list(t ORDER BY k, p) AS ids FROM places JOIN tokens USING (w) GROUP BY d) USING (d) ORDER BY d"
        ).to_arrow_table()["ids"]
        return found.combine_chunks().cast(pa.list_(pa.int32()))


def encode(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES) -> DataFrame:
    """``id, ids``: the token ids (array of int) of each row's whole text, without special tokens; their strings in a
    text are ordinary text. A null and an empty text have no tokens: an empty list. Rows may repeat; other columns are
    ignored. The vocabulary is read by the driver, so executors need no copy of it. A text of millions of letters
    without a space or sign is one word; it is parted where no token can reach over, else its steps grow with the number
    of its different pairs."""
    # Bounded by the size of a vocabulary file, about 1 MB.
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(os.path.join(folder, vocabulary)))
    slim = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words_of, encoder = regex.compile(PATTERN).findall, None
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or WordEncoder(ranks.value)
            texts, start, size = batch.column("text").to_pylist(), 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= SLICE_CHARS or k == len(texts) - 1:
                    ids = encoder.encode([words_of(x) for x in texts[start : k + 1]])
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, k + 1 - start), ids], names=["id", "ids"])
                    start, size = k + 1, 0

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, ids: str, text: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES) -> DataFrame:
    """``df`` with ``text``: the text of each list of token ids, by an ordered aggregation of the tokens' bytes in each
    partition; empty for an empty or null list. The bytes are one UTF-8 text for ids of a whole text; ids cut out of one
    may begin or end within a character, which is then U+FFFD. ValueError for an id that the vocabulary lacks."""
    tokens = df.sparkSession.sparkContext.broadcast(read_ranks(os.path.join(folder, vocabulary)))
    kept = [c for c in df.columns if c != text]
    out = df.select(*kept).withColumn(text, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if db is None:
                import duckdb

                db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
                parts, numbers = zip(*tokens.value.items())
                vocabulary_rows = pa.table({"t": pa.array(numbers, pa.int32()), "hex": pa.array([x.hex() for x in parts])})
                db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_rows")
                del vocabulary_rows
            lists = batch.column(ids)
            slices, start, size = [], 0, 0
            for k, n in enumerate(lists.value_lengths().fill_null(0).to_pylist()):
                size += n
                if size >= SLICE_CHARS or k == len(lists) - 1:
                    slices.append((start, k + 1 - start))
                    start, size = k + 1, 0
            found: list[str] = []
            for start, n in slices:
                rows = pa.table({"d": pa.array(range(n), pa.int32()), "ids": lists.slice(start, n)})  # noqa: F841
                joined = db.sql(
                    """WITH places AS (SELECT d, unnest(ids) AS t, generate_subscripts(ids, 1) AS k FROM rows),
                    texts AS (SELECT d, string_agg(hex, '' ORDER BY k) AS hex, count(*) AS n, count(hex) AS known FROM places LEFT JOIN vocabulary USING (t) GROUP BY d)
                    SELECT coalesce(hex, '') AS hex, n = known AS known FROM rows LEFT JOIN texts USING (d) ORDER BY d"""
                ).fetchall()
                if any(known is False for _, known in joined):
                    raise ValueError("a token id is not in the vocabulary")
                found += [bytes.fromhex(x).decode("utf-8", "replace") for x, _ in joined]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string())], names=[*kept, text])

    return df.select(*kept).mapInArrow(run, out)
