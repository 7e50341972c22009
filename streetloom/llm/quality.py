"""Quality classifier by supervised subword embeddings, trained with numpy.

Each word and each character n-gram, of a word with its ends marked or across the space
between two words, is hashed to a row of a learned table; a document is the average of
the rows of its whole text, a softmax over two classes follows, and both layers are
trained together by stochastic gradient descent. Because the output is linear in the
average, scoring needs one number for each row (its share of the logit): a word adds the
sum over its features, and words repeat, so each task remembers the sums of words it has
seen, up to a bound.

Only the text enters a score. Labels are learned from rows whose crc32 of the id leaves
a remainder of 0 or 2 modulo 3; the others are held out. Both classes count alike in
training, however rare one is, so a score is the likelihood of label 1 where both are
equally frequent.

Parameters: at most `SAMPLE` labelled rows are used for fitting, those with the smallest
hash of the id, and of these as many as hold `SAMPLE_CHARS` code points together
(documented bounds; scoring covers every row and the whole text).

Defined cases: a null, empty or blank text has nothing to average, so that its score is
that of the learned bias; a null doc_id counts as the empty string for its remainder;
labels without a quality, and repeated labels that disagree, are not learned from; with
no labels, or labels of one class, every score is that class's share (0.5 without any);
an empty table gives no rows; further columns are ignored, and kept as they are by
`good`, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, ship, text_of, unpacked

SAMPLE = 4096
SAMPLE_CHARS = 50_000_000
ROWS_LOG2 = 17
DIM = 8
GRAMS = (2, 4)
EPOCHS = 6
RATE = 0.5
#: Rate of the bias, as a share of the others.
BIAS_RATE = 0.01
#: Words in each half of a task's memory.
REMEMBERED = 200_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def hashes(word: str) -> list[int]:
    """Rows of the table for a word: the word itself and its n-grams, with its ends marked.

    An n-gram across two words, which has a space, is one row.
    """
    crc, mask = zlib.crc32, (1 << ROWS_LOG2) - 1
    if " " in word:
        return [crc(word.encode("utf-8", "surrogatepass")) & mask]
    marked = f"<{word}>"
    data = marked.encode("utf-8", "surrogatepass")
    low, high = GRAMS
    if len(data) == len(marked):  # ASCII: n-grams are slices of the bytes
        return [crc(data) & mask, *[crc(data[i : i + n]) & mask for n in range(low, high + 1) for i in range(len(data) - n + 1)]]
    return [crc(data) & mask, *[crc(marked[i : i + n].encode("utf-8", "surrogatepass")) & mask for n in range(low, high + 1) for i in range(len(marked) - n + 1)]]


def features(word: str) -> np.ndarray:
    return np.array(hashes(word), np.int64)


def words_of(text: str) -> Counter:
    """Words, and the n-grams of the last character of a word, a space and the first of the next; with their counts."""
    words = text.split()
    counts = Counter(words)
    for (last, first), n in Counter(zip([w[-1] for w in words], [w[0] for w in words[1:]], strict=False)).items():
        counts[f"{last} {first}"] = n
    return counts


def counted(text: str, memory: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their shares of a whole text."""
    ids, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for word, n in words_of(text).items():
        got = memory.get(word)
        if got is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            got = memory[word] = features(word)
        ids.append(got)
        weights.append(np.full(len(got), float(n)))
    all_ids, at = np.unique(np.concatenate(ids), return_inverse=True)
    share = np.bincount(at, np.concatenate(weights))
    return all_ids.astype(np.int32), (share / max(share.sum(), 1)).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logit share of every row, and the bias: log odds of label 1."""
    size = 1 << ROWS_LOG2
    if not labels or min(labels) == max(labels):
        share = sum(labels) / len(labels) if labels else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(size), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM))
    out, bias = rng.uniform(-1 / DIM, 1 / DIM, (DIM, 2)), np.zeros(2)
    memory: dict = {}
    docs = [counted(t, memory) for t in texts]
    y = np.asarray(labels)
    # both classes count alike in total, so that a rare one is learned too
    balance = len(y) / (2 * np.bincount(y, minlength=2))
    steps, at = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share = docs[k]
            rate = RATE * (1 - at / steps)
            at += 1
            hidden = share @ table[ids]
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[k]] -= 1
            p *= min(balance[y[k]], 4.0)
            table[ids] -= rate * len(ids) ** 0.5 * np.outer(share, out @ p)
            out -= rate * np.outer(hidden, p)
            bias -= rate * BIAS_RATE * p
    margin = out[:, 1] - out[:, 0]
    return table @ margin, float(bias[1] - bias[0])


def scorer(shares: np.ndarray, bias: float):
    """Function over batches of texts that gives scores."""

    by_row = shares.tolist()

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # when the newer half is full it becomes the older one, and what is met again moves back
        newer: dict[str, tuple[float, int]] = {}
        older: dict[str, tuple[float, int]] = {}
        for texts in batches:
            found = []
            for text in texts:
                total, n = 0.0, 0
                for word, times in words_of(text or "").items():
                    got = newer.get(word)
                    if got is None:
                        got = older.get(word)
                        if got is None:
                            rows = hashes(word)
                            got = (sum([by_row[r] for r in rows]), len(rows))
                        if len(newer) >= REMEMBERED:
                            newer, older = {}, newer
                        newer[word] = got
                    total += got[0] * times
                    n += got[1] * times
                found.append(1 / (1 + math.exp(-min(max(total / max(n, 1) + bias, -50), 50))))
            yield pd.Series(found, dtype="float64")

    return score


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most `bound` labelled rows that are not held out, by the smallest hash of the id."""
    agreed = labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    chosen = agreed.filter(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text")).join(chosen, "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("low").alias("label"))
    # at most `bound` rows meet in this window; their texts together are cut before they reach the driver
    so_far = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("_id"), "_id"))
    got = sorted(rows.withColumn("so_far", so_far).filter(F.col("so_far") <= SAMPLE_CHARS).collect())
    return [r["text"] for r in got], [int(r["label"]) for r in got]


def score_of(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE):
    """A function from a text column to its score, 0 to 1, fitted on the labels of some documents."""
    ship(docs.sparkSession)
    return F.pandas_udf(scorer(*train(*sample(docs, labels, bound))), "double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_of(docs, labels)(text_of()).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, all columns as they were."""
    return unpacked(packed(docs, score=score_of(docs, labels)(text_of())).filter("score >= 0.5"))
