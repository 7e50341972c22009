"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For a rank table, every byte string has one encoding, and so every prefix of it has one
last token. `Prefixes` stores that token for each prefix: the last token of a prefix is
the one suffix in the table that may follow the last token of what is before it, so the
table fills from left to right, an append goes on where it ends, and an edit recomputes
only until the stored tokens agree again. Walking back from the end gives the encoding.

Whether token b may follow token a is decided by undoing merges along the seam, latest
first, and asking whether a merge across it would have come earlier.

Texts are split by the pattern of the table; each match is encoded separately and
matches repeat, so a worker remembers their encodings, up to a bound.

Defined cases: a null or empty text has no tokens; text that looks like a special token
is ordinary text; rows are independent, so repeated rows and null ids need nothing; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, text_of

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Encodings in each half of a worker's memory.
REMEMBERED = 200_000
#: Characters beyond which a match is not remembered.
LONG = 64


class Bpe:
    """A rank table: tokens, their merges, and which token may follow which."""

    def __init__(self, data: bytes):
        import ahocorasick

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        #: Finds the tokens that end at each byte, the longest first.
        self.finder = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.finder.add_word(token.decode("latin-1"), (len(token), rank))
        self.finder.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for token, rank in self.ranks.items():
            parts = self._merge(token, rank) if len(token) > 1 else []
            self.halves[rank] = (parts[0], parts[1]) if len(parts) == 2 else None
            if len(parts) == 2:
                self.merges[parts[0], parts[1]] = rank
        #: Answers of `may_follow`, by a and b in one number.
        self.known: dict[int, bool] = {}

    def _merge(self, token: bytes, below: int) -> list[int]:
        """The parts that merges of a lower rank leave of a token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, at = min(found)
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together are encoded as a, b."""
        if len(self.known) > 2_000_000:
            self.known.clear()
        answer = self.known[a << 32 | b] = self._seam_holds(a, b)
        return answer

    def extend(self, data: bytes, last: list[int], begin: int) -> None:
        """Fill in last[begin + 1:], the last tokens of the prefixes of data longer than `begin`."""
        known, cut = self.known.get, max(0, begin + 1 - self.longest)
        last += [-1] * (len(data) + 1 - len(last))
        for at, (size, rank) in self.finder.iter(data[cut:].decode("latin-1")):
            end = cut + at + 1
            if end <= begin or last[end] >= 0:
                continue
            before = last[end - size]
            if end == size:
                last[end] = rank
            elif (fits := known(before << 32 | rank)) or fits is None and self.may_follow(before, rank):
                last[end] = rank

    def _seam_holds(self, a: int, b: int) -> bool:
        earliest = None  # merges across the seam must come before this rank to matter
        while True:
            joined = self.merges.get((a, b))
            if joined is not None and (earliest is None or joined < earliest):
                return False
            left, right = self.halves[a], self.halves[b]
            if left is not None and (a > b or right is None):
                earliest, a = a, left[1]
            elif right is not None:
                earliest, b = b + 1, right[0]  # at the same rank the merge further left comes first
            else:
                return True


class Prefixes:
    """The last token of every prefix of some bytes."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        begin = len(self.data)
        self.data += more
        self.bpe.extend(self.data, self.last, begin)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put `new` for data[start:end]; the number of prefixes computed anew.

        A last token depends on the bytes and the last tokens of one longest token before
        it, so once that many agree with the stored ones all later ones do.
        """
        old, shift, reach = self.last, len(new) - (end - start), self.bpe.longest
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        done, step = start, len(new) + 2 * reach
        while done < len(self.data):
            goal = min(len(self.data), done + step)
            self.bpe.extend(self.data[:goal], self.last, done)
            done, step = goal, 2 * reach
            if done - reach > start + len(new) and self.last[done - reach + 1 :] == old[done - reach + 1 - shift : done + 1 - shift]:
                self.last += old[done + 1 - shift :]
                break
        return done - start

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end])
            end -= len(self.bpe.tokens[self.last[end]])
        return found[::-1]


_tables: dict[bytes, Codec] = {}


class Codec:
    """Encodes and decodes whole texts; remembers matches, frequent ones for longer.

    A remembered match has its ids and the way they are written. When the newer half of
    the memory is full it becomes the older half, and what is met again moves back.
    """

    def __init__(self, data: bytes, pattern: str):
        import regex

        self.bpe = Bpe(data)
        self.split = regex.compile(pattern).findall
        self.newer: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}

    def _ids(self, data: bytes) -> tuple[int, ...]:
        whole = self.bpe.ranks.get(data)
        return (whole,) if whole is not None else tuple(Prefixes(self.bpe, data).ids())

    def _known(self, match: str) -> tuple[tuple[int, ...], str]:
        found = self.newer.get(match)
        if found is None:
            found = self.older.get(match)
            if found is None:
                ids = self._ids(match.encode("utf-8"))
                found = (ids, " ".join(map(str, ids)))
            if len(match) <= LONG:
                if len(self.newer) >= REMEMBERED:
                    self.older, self.newer = self.newer, {}
                self.newer[match] = found
        return found

    def _all(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        matches = self.split(text)
        found = list(map(self.newer.get, matches))
        for k, x in enumerate(found):
            if x is None:
                found[k] = self._known(matches[k])
        return found

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self._all(text) for i in ids]

    def written(self, text: str) -> tuple[list[int], str]:
        """The ids, and the ids as decimal numbers joined by one space."""
        found = self._all(text)
        return [i for ids, _ in found for i in ids], " ".join([said for _, said in found])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bpe.tokens.__getitem__, ids))


def codec(data: bytes, pattern: str) -> Codec:
    """The codec of a table, made once in each process."""
    key = hashlib.sha256(data + pattern.encode()).digest()
    if key not in _tables:
        _tables[key] = Codec(data, pattern)
    return _tables[key]


def read_vocabulary(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as file:
        return file.read()


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        return public_tokenizers.PATTERN
    return pattern


def _sent(spark: SparkSession, path: str | None):
    """The table, read on the driver and sent once to each executor; its size is that of the file."""
    ship(spark)
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encoder(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """A function from a text column to its array of ids."""
    sent, split = _sent(spark, path), _pattern(pattern)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = codec(sent.value, split)
        for texts in batches:
            yield pd.Series([coder.encode(x or "") for x in texts])

    return F.pandas_udf(run, "array<int>")


def decoder(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """A function from a column of ids to the bytes they stand for."""
    sent, split = _sent(spark, path), _pattern(pattern)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = codec(sent.value, split)
        for many in batches:
            yield pd.Series([coder.decode([] if ids is None else list(ids)) for ids in many])

    return F.pandas_udf(run, "binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    sent, split = _sent(docs.sparkSession, path), _pattern(pattern)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = codec(sent.value, split)
        for texts in batches:
            rows = []
            for x in texts:
                ids, said = coder.written(x or "")
                rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found(text_of() if text is None else text).alias("d")).select("doc_id", "d.*")


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document: doc_id, lang, source, n_tokens, ids, decoded_sha256 of the ids decoded again."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "lang", "source", encoder(spark, path, pattern)(text_of()).alias("ids"))
    back = F.sha2(decoder(spark, path, pattern)(F.col("ids")), 256)
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", back.alias("decoded_sha256"))
