"""Token counts by dynamic programming over a trie of pre-tokens.

The counts are those of the vocabulary's own library. Its pieces have scores, and the
forward score of a prefix, that of its best split into pieces, does not depend on what
follows; so the distinct pre-tokens that a worker meets are inserted in one trie, and each node, a
prefix that many share, is computed once: its forward score, its last piece and its count.
The ends of pre-tokens store their counts, and a document adds those of its pre-tokens.

The vocabulary is a merge table: its scores are the places of the merges, not log
probabilities, and the split with the best total is not the one that merging arrives at.
A piece therefore extends a prefix only where it may follow the prefix's last piece, that
is where merging would leave the seam between the two, which leaves one way to reach each
node. `Trie(..., merged=False)` drops that condition, for vocabularies whose scores are
log probabilities.

A pre-token is a run of spaces with the word after it; no piece goes on behind a word, and
characters that occur in no longer piece (line feeds) stand alone. A character without a
piece costs one piece for each of its UTF-8 bytes. The pieces of several spaces are merged
last and from the left, so they are counted from the length of the run.

Defined cases: a null or empty text has no tokens; rows are independent, so repeated rows
and null ids need nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, ship, text_of

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Nodes that a worker keeps at most; beyond, the trie starts anew.
NODES = 400_000
#: Stored counts in each half of a worker's memory: the older half goes when the newer one is full.
REMEMBERED = 300_000
#: Characters beyond which a pre-token leaves no nodes and no count behind.
LONG = 64

_CHUNKS = re.compile(r" +[^ \n]*|[^ \n]+|\n").findall


class Trie:
    """Forward scores of the prefixes of pre-tokens, and the counts at their ends."""

    def __init__(self, scores: dict[str, float], merged: bool = True):
        runs = {len(p) for p in scores if len(p) > 1 and not p.strip(MARK)}
        self.scores = {p: s for p, s in scores.items() if len(p) == 1 or p.strip(MARK)} if merged else dict(scores)
        self.runs = {1, *runs}
        #: The pieces that the last merge of each piece joins.
        self.halves: dict[str, tuple[str, str]] = {}
        self.merged = merged
        if merged:
            for piece in [p for p in self.scores if len(p) > 1]:
                halves = self._halves(piece)
                if halves is None:
                    del self.scores[piece]  # merging never arrives at it
                else:
                    self.halves[piece] = halves
        #: For every end of a piece, the pieces that it ends with, longest first.
        self.ends: dict[str, tuple[str, ...]] = {"": ()}
        for end in sorted({p[i:] for p in self.scores for i in range(len(p))}, key=len):
            self.ends[end] = (end, *self.ends[end[1:]]) if end in self.scores else self.ends[end[1:]]
        self.longest = max(1, max(map(len, self.ends)))
        self.unknown = min(self.scores.values(), default=0.0) - 10.0
        self.seams: dict[tuple[str, str], bool] = {}
        self.terminal: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self._start()

    def _start(self) -> None:
        #: A node by its prefix: last piece, forward score, count, first piece. All shorter prefixes of one are here too.
        self.nodes: dict[str, tuple[str, float, int, str]] = {"": ("", 0.0, 0, "")}

    def _halves(self, piece: str) -> tuple[str, str] | None:
        parts = list(piece)
        while len(parts) > 1:
            joined = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not joined:
                return None
            at = min(joined)[1]
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def may_follow(self, a: str, b: str) -> bool:
        """Whether merging leaves a and b apart, decided by undoing their merges, latest first."""
        known = self.seams.get((a, b))
        if known is None:
            if len(self.seams) >= NODES:
                self.seams.clear()
            known = self.seams[a, b] = self._seam_holds(a, b)
        return known

    def _seam_holds(self, a: str, b: str) -> bool:
        scores, halves = self.scores, self.halves
        lowest, strict = None, False  # only merges before this one, of a higher score, matter
        while True:
            joined = scores.get(a + b) if halves.get(a + b) == (a, b) else None
            if joined is not None and (lowest is None or joined > lowest or not strict and joined == lowest):
                return False
            left, right = halves.get(a), halves.get(b)
            # of two merges of one score the one further left comes first, so the right one is undone first
            if right is not None and (left is None or scores[b] <= scores[a]):
                lowest, strict, b = scores[b], False, right[0]
            elif left is not None:
                lowest, strict, a = scores[a], True, left[1]
            else:
                return True

    def _extend(self, word: str, path: list) -> None:
        """Add the prefixes of a word that are longer than those on the path, each computed from shorter ones.

        The prefixes of a long word are of no use to others: they are let go when no piece reaches back to them.
        """
        scores, ends, seams, nodes, merged = self.scores, self.ends, self.seams, self.nodes, self.merged
        keep, reach = len(word) <= LONG, 1
        for end in range(len(path), len(word) + 1):
            # the longest end of a piece that stands here: what a shorter one is not, a longer one is not
            if word[end - reach : end] in ends:
                while reach < end and word[end - reach - 1 : end] in ends:
                    reach += 1
            else:
                reach -= 1
                while word[end - reach : end] not in ends:
                    reach -= 1
            best = None
            if merged:  # one of them fits, most often a long one
                for part in ends[word[end - reach : end]]:
                    start = end - len(part)
                    last, total, count, first = path[start]
                    if start:
                        fits = seams.get((last, part))
                        if fits is None:
                            fits = self.may_follow(last, part)
                        if not fits:
                            continue
                    best = (part, total + scores[part], count + 1, first or part)
                    break
            else:
                for part in ends[word[end - reach : end]]:
                    _, total, count, first = path[end - len(part)]
                    best = self._better(best, (part, total + scores[part], count + 1, first or part))
            char = word[end - 1]
            if char not in scores and (best is None or not merged):
                n_bytes = len(char.encode("utf-8", "surrogatepass"))
                _, total, count, first = path[end - 1]
                best = self._better(best, (char, total + self.unknown * n_bytes, count + n_bytes, first or char))
            path.append(best)
            reach = reach or 1
            if keep:
                nodes[word[:end]] = best
            elif end >= self.longest:
                path[end - self.longest] = None

    @staticmethod
    def _better(one: tuple | None, other: tuple) -> tuple:
        """The node of the higher score, then of fewer pieces, then of the last piece by code points."""
        if one is None:
            return other
        return max(one, other, key=lambda node: (node[1], -node[2], node[0]))

    def walk(self, word: str) -> tuple[str, float, int, str]:
        """The node of a word; nodes that lacked are computed."""
        path, find = [], self.nodes.get
        for end in range(len(word) + 1):
            node = find(word[:end])
            if node is None:  # nor are there longer ones
                self._extend(word, path)
                break
            path.append(node)
        return path[-1]

    def _spaces(self, n: int) -> int:
        """Pieces of a run of marks: merged from the left, the longest run being reached over and over."""
        longest, count = max(self.runs), 0
        if n > 2 * longest:
            times = n // longest - 1
            n, count = n - times * longest, times
        parts = [1] * n
        while True:
            at = next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.runs), None)
            if at is None:
                return count + len(parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pieces(self, chunk: str) -> int:
        """Pieces of a pre-token: marks, if any, and a word."""
        said, chunk = chunk, chunk.replace(" ", MARK)
        known = self.terminal.get(said)
        if known is None:
            known = self.older.get(said)
            if known is None:
                known = self._counted(chunk)
            if len(chunk) <= LONG:
                if len(self.terminal) >= REMEMBERED:
                    self.terminal, self.older = {}, self.terminal
                self.terminal[said] = known
        return known

    def _counted(self, chunk: str) -> int:
        word = chunk.lstrip(MARK)
        marks = len(chunk) - len(word)
        if len(self.nodes) > NODES:
            self._start()
        if self.merged and marks and not word:
            return self._spaces(marks)
        if self.merged and marks > 1:
            _, _, count, first = self.walk(MARK + word)
            alone = first == MARK  # then the last mark is one of the run
            return count - 1 + self._spaces(marks) if alone else count + self._spaces(marks - 1)
        return self.walk(chunk)[2]

    def tokens(self, text: str) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        if "\n" in self.ends:
            raise ValueError("pre-tokens are cut at line feeds, which are part of a piece")
        if MARK in text:
            text = text.replace(MARK, " ")
        said = Counter(_CHUNKS(" " + text))
        total, terminal = said.pop("\n", 0), self.terminal
        for chunk, n in said.items():
            known = terminal.get(chunk)
            if known is None:
                known, terminal = self.pieces(chunk), self.terminal
            total += known * n
        return total


_tries: dict[int, Trie] = {}


def shared_trie(scores: dict[str, float]) -> Trie:
    """The trie of a vocabulary, one for all tasks of a worker process: the forward scores and counts of
    prefixes are the same everywhere."""
    key = hash(frozenset(scores.items()))
    if key not in _tries:
        _tries.clear()
        _tries[key] = Trie(scores)
    return _tries[key]


def read_scores(path: str | None = None) -> dict[str, float]:
    """Pieces and scores of a vocabulary; control and byte pieces are left out."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens."""
    spark = docs.sparkSession
    ship(spark)
    # the table has the size of the vocabulary file
    sent = spark.sparkContext.broadcast(read_scores(path))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = shared_trie(sent.value)
        for texts in batches:
            yield pd.Series([trie.tokens(x) for x in texts], dtype="int64")

    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(text).alias("n_words"), F.pandas_udf(run, "long")(text).alias("n_tokens"))
