"""Language identification by words first, with back-off to shorter and shorter character n-grams.

Every word is scored on its own: a word of the lexicon by the logarithm of its relative frequency in each language, an unseen word by
the mean over those of its longest character n-grams that were seen in training, falling from ``LONGEST`` characters to one. What a
language has not seen costs the same in every language. A text is scored by the sum over its words.

The lexicon is learnt from a bounded sample of labelled rows per language; counting is a Spark aggregation. Prediction reads whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.tokens import slices
from cohortloom.session import ship_package

# Expected number of labelled rows that teach a language (all, where it has fewer), and the longest text among them.
SAMPLE_ROWS = 5_000
LONGEST_SAMPLE = 200_000
# A word or n-gram is known once it was seen so often.
LEAST_COUNT = 3
LONGEST = 5
UNDETERMINED = "und"

# Unseen words are remembered until there are so many; characters of a text that are split into words at once; bytes of the sample
# that are counted at once.
REMEMBERED = 200_000
STRETCH = 1 << 20
SAMPLE_BYTES = 1 << 22

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-case words of a text that hold a letter, in lists of bounded length."""
    at = 0
    while at < len(text):
        end = min(len(text), at + STRETCH)
        # A stretch ends after a character that belongs to no word, unless a word is longer than a stretch.
        stop = next((i for i in range(end, max(at, end - 1000), -1) if not text[i - 1].isalpha()), end) if end < len(text) else end
        found = _WORD.findall(text[at:stop].lower())
        yield found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]
        at = stop


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word; its ends count as characters, except alone."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Relative log frequencies (n-grams and words x languages) by key: words as they are, n-grams behind their length."""

    languages: list[str]
    keys: list[str]
    logs: np.ndarray
    floor: float
    # Position of every key; built in each worker.
    index: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "index": {}}

    def known(self) -> dict[str, int]:
        if not self.index and self.keys:
            self.index = {k: i for i, k in enumerate(self.keys)}
        return self.index


class Scorer:
    """Scores of words by language, with the scores of unseen words remembered."""

    def __init__(self, model: Model):
        self.model, self.known, self.unseen = model, model.known(), {}
        self.table = np.zeros((1024, len(model.languages)))

    def back_off(self, word: str) -> np.ndarray:
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            rows = [self.known[g] for g in (f"{n}{g}" for g in grams(word, n)) if g in self.known]
            if rows:
                return self.model.logs[rows].mean(axis=0)
        return np.full(len(self.model.languages), self.model.floor)

    def place(self, word: str) -> int:
        """Row of an unseen word in the table of remembered scores."""
        at = self.unseen.get(word)
        if at is None:
            at = self.unseen[word] = len(self.unseen)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = self.back_off(word)
        return at

    def score(self, text: str | None) -> tuple[np.ndarray, int]:
        """Sum of the scores of all words by language, and how many words there are."""
        total, n = np.zeros(len(self.model.languages)), 0
        for words in words_of(text or ""):
            n += len(words)
            rows = [self.known.get(w, -1) for w in words]
            seen = [i for i in rows if i >= 0]
            if seen:
                total += self.model.logs[seen].sum(axis=0)
            if len(seen) < len(words):
                if len(self.unseen) > REMEMBERED:
                    self.unseen = {}
                other = [self.place(w) for w, i in zip(words, rows, strict=True) if i < 0]
                total += self.table[other].sum(axis=0)
        return total, n

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = self.score(text)
        if not n or not len(total):
            return UNDETERMINED, 0.0
        # Words of a text depend on one another, so evidence grows with the root of their number.
        z = (total - total.max()) / math.sqrt(n)
        best = int(np.argmax(z))
        return self.model.languages[best], float(1.0 / np.exp(z).sum())


def held_out(key: Column) -> Column:
    """Rows that never teach: a quarter, by the CRC of the key."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def count_keys(texts: Iterator[tuple[str, int]]) -> Counter:
    """(key, language) -> occurrences, of words and of the n-grams of all word occurrences."""
    words: Counter = Counter()
    for text, language in texts:
        for own in words_of(text):
            words.update((w, language) for w in own)
    out: Counter = Counter(words)
    for (word, language), times in words.items():
        for n in range(1, LONGEST + 1):
            for g in grams(word, n):
                out[f"{n}{g}", language] += times
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS, least: int = LEAST_COUNT) -> Model:
    """Learn from rows with a label, a text and a key outside the held-out quarter.

    Of each language about ``rows`` rows teach, those with the smallest hashes of key and text, each text of a row once; texts of more than
    ``LONGEST_SAMPLE`` characters do not. So the model is bounded by rows, text length and languages whatever the corpus is. Without
    any such row the model knows no language.
    """
    spark = docs.sparkSession
    ship_package(spark)
    columns = [F.col(key).alias("id"), F.col(label).cast("string").alias("lang"), F.col(text).cast("string").alias("text")]
    taught = docs.select(*columns).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("id")))
    taught = taught.where(F.char_length("text") <= LONGEST_SAMPLE)
    sizes = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [], np.zeros((0, 0)), 0.0)
    shares = spark.createDataFrame([(name, i, min(1.0, rows / sizes[name])) for i, name in enumerate(languages)], "lang string, place int, share double")
    # The hash as a fraction of its range is a draw that does not depend on order or partitioning.
    draw = F.xxhash64(F.col("id").cast("string"), "text").cast("double") / F.lit(2.0**64) + 0.5
    sample = taught.withColumn("draw", draw).join(F.broadcast(shares), "lang").where("draw <= share").dropDuplicates(["draw", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SAMPLE_BYTES):
            counts = count_keys(zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True))
            keys = list(counts)
            yield pa.RecordBatch.from_pydict({"gram": pa.array([k[0] for k in keys], pa.string()), "place": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([counts[k] for k in keys], pa.int64())})

    counts = sample.select("place", "text").mapInArrow(count, "gram string, place int, n long").groupBy("gram", "place").agg(F.sum("n").alias("n"))
    wide = counts.groupBy("gram").agg(*(F.sum(F.when(F.col("place") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(languages))))
    total = sum((F.col(f"n{i}") for i in range(1, len(languages))), F.col("n0"))
    table = wide.where(total >= least).orderBy("gram").toArrow()
    keys = table.column("gram").to_pylist()
    n = np.column_stack([table.column(f"n{i}").to_numpy() for i in range(len(languages))]).astype(float) if keys else np.zeros((0, len(languages)))
    return from_counts(languages, keys, n)


def from_counts(languages: list[str], keys: list[str], n: np.ndarray) -> Model:
    """Frequencies relative to all keys of the same kind: words, and n-grams of each length."""
    # No word starts with an ASCII digit.
    kind = np.array([int(k[0]) if "1" <= k[0] <= "9" else 0 for k in keys], int)
    totals = np.ones((LONGEST + 1, len(languages)))
    for i in range(LONGEST + 1):
        totals[i] = np.maximum(1.0, n[kind == i].sum(axis=0))
    floor = math.log(0.5 / totals.max())
    with np.errstate(divide="ignore"):
        logs = np.maximum(np.log(n / totals[kind]), floor) if keys else n
    return Model(languages, keys, logs, floor)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, held_out, lang_pred, score. Only the text decides.

    ``lang_pred`` is a learnt language, or ``und`` with score 0 where the text is null or has no letter, or nothing was learnt. score is the
    share of the predicted language, from 1 / languages to 1; equal scores go to the language that sorts first. Texts of any length
    are read whole, stretch by stretch; repeated rows are predicted alike; other columns are ignored; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches):
            out = [scorer.predict(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=[key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
    return named.select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")
