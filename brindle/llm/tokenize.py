"""Encoding texts with a public byte-level BPE vocabulary, by recursive DuckDB queries inside each partition.

A text is split into words by the vocabulary's pattern, a word into bytes. Rows of (word, position, token) join the
table of merges; every step contracts each word's pair of least rank, from the left, until no pair has a rank; an
ordered aggregation gives the ids. Two things keep that fast without changing a result:

* a word is first cut between two bytes that no merge ever joins (known from the merges: the last byte of a left side
  and the first of a right side), so that long runs of letters without blanks become short, frequent segments;
* each partition keeps the ids of the segments it met (up to a bound, beyond which it starts afresh), so the queries
  see every distinct segment of a batch once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published pattern that splits texts before the merges of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KNOWN_SEGMENTS = 400_000

_CONTRACT = """
WITH RECURSIVE state(w, pos, tok, step) AS (
  SELECT w, pos, tok, 0 FROM bytes_of
  UNION ALL
  SELECT w, pos, CASE WHEN chosen THEN merged ELSE tok END, step + 1 FROM (
    SELECT *, coalesce(lag(chosen) OVER (PARTITION BY w ORDER BY pos), false) AS eaten FROM (
      SELECT *, rank = best AND (i - first_of_run) % 2 = 0 AS chosen FROM (
        SELECT *, max(CASE WHEN rank = best THEN NULL ELSE i END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING) AS broke,
          coalesce(broke, 0) + 1 AS first_of_run
        FROM (
          SELECT *, min(rank) OVER (PARTITION BY w) AS best FROM (
            SELECT p.*, m.rank, m.merged FROM (
              SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY w ORDER BY pos) AS i FROM state
            ) p LEFT JOIN merges m ON p.tok = m.a AND p.nxt = m.b)
        ) WHERE best IS NOT NULL)
    )
  ) WHERE NOT eaten
)
SELECT w, list(tok ORDER BY pos) AS ids FROM (SELECT *, max(step) OVER (PARTITION BY w) AS final FROM state) WHERE step = final GROUP BY w
"""


class Vocabulary:
    """Merges of a byte-level BPE as three arrays, the token of each byte, and the byte pairs that a merge can join."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        ids = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.byte_token = np.zeros(256, np.int32)
        for c, b in spelled.items():
            self.byte_token[b] = ids[c]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.joins = np.zeros((256, 256), bool)
        for a, b in pairs:
            self.joins[spelled[a[-1]], spelled[b[0]]] = True


class Encoder:
    """Encodes batches of texts; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        import duckdb
        import regex

        self.v = vocabulary
        self.words = regex.compile(PATTERN)
        self.ids: dict[bytes, list[int]] = {}
        self.spelt: dict[str, list[int]] = {}
        self.db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "600MB"})
        merges = pa.table({"a": vocabulary.left, "b": vocabulary.right, "merged": vocabulary.merged, "rank": np.arange(len(vocabulary.left), dtype=np.int32)})
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")

    def segments(self, word: str) -> list[bytes]:
        raw = word.encode("utf-8")
        codes = np.frombuffer(raw, np.uint8)
        cuts = np.flatnonzero(~self.v.joins[codes[:-1], codes[1:]]) + 1
        if not len(cuts):
            return [raw]
        edges = [0, *cuts.tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(edges, edges[1:])]

    def _contract(self, segments: list[bytes]) -> None:
        """Adds the ids of new segments; in blocks of bounded size."""
        block, size = [], 0
        for n, s in enumerate(segments):
            block.append(s)
            size += len(s)
            if size > 60_000 or n == len(segments) - 1:
                lengths = np.fromiter(map(len, block), np.int64, len(block))
                starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
                rows = pa.table({
                    "w": np.repeat(np.arange(len(block), dtype=np.int32), lengths),
                    "pos": (np.arange(len(starts)) - starts).astype(np.int32),
                    "tok": self.v.byte_token[np.frombuffer(b"".join(block), np.uint8)],
                })
                self.db.register("bytes_of", rows)
                for w, ids in self.db.execute(_CONTRACT).fetchall():
                    self.ids[block[w]] = ids
                self.db.unregister("bytes_of")
                block, size = [], 0

    def learn(self, words: set[str]) -> None:
        """Makes the ids of ``words`` known."""
        if len(self.spelt) + len(words) > KNOWN_SEGMENTS:
            self.spelt.clear()
        if len(self.ids) > KNOWN_SEGMENTS:
            self.ids.clear()
        new = {w: self.segments(w) for w in words if w not in self.spelt}
        self._contract(list({s for parts in new.values() for s in parts if s not in self.ids}))
        for w, parts in new.items():
            self.spelt[w] = [i for s in parts for i in self.ids[s]]

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        split = [self.words.findall(t) if t else [] for t in texts]
        self.learn({w for ws in split for w in ws})
        known = self.spelt
        for ws in split:
            yield [i for w in ws for i in known[w]]


def _blocks(texts: list, most: int = 2_000_000) -> Iterator[list]:
    """Consecutive texts of together about ``most`` characters."""
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size > most:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary_path: str = DEFAULT_VOCABULARY, count_only: bool = False) -> DataFrame:
    """``id, ids ARRAY<INT>`` (or ``id, n_tokens BIGINT``) of every row, without special tokens.

    Empty and null texts give an empty array and 0; strings of special tokens are ordinary text; repeated rows and
    null ids give a row each; other columns aren't read. Nothing is shuffled. The merges (a vocabulary's fixed size)
    are broadcast once.
    """
    spark = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(vocabulary_path))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = rows.schema["id"].dataType.simpleString()
    out = pa.int64() if count_only else pa.list_(pa.int32())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            at, texts = 0, batch.column("text").to_pylist()
            for block in _blocks(texts):
                ids = encoder.encode(block)
                found = pa.array([len(x) for x in ids], out) if count_only else pa.array(list(ids), out)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(block)), found], names=["id", "found"])
                at += len(block)

    name = "n_tokens" if count_only else "ids"
    return rows.mapInArrow(encode, f"id {key}, found {'bigint' if count_only else 'array<int>'}").withColumnRenamed("found", name)
