"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, other). Four small transducers rewrite the symbols of a clause: negation
and reported speech mark the insults in their reach, a target strengthens them, a threat counts where it meets a target. Their
composition is one deterministic transducer that reads a clause once. Insult stems are learnt from labelled rows, as prefixes of words that
stand openly, neither negated nor reported, in surely more of the toxic than of the other texts; a logistic model over the graded weights
of the matched clauses gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.filters import without_texts
from cohortloom.llm.tokens import slices
from cohortloom.session import ship_package
from cohortloom.sources.store import checkpointed

# At most so many labelled rows teach the model; they bound its stems too.
SAMPLE_ROWS = 20_000
STEM_CHARS = range(4, 9)
# The rate in toxic texts is surely the higher one; how much higher is the weight of a stem.
LEAST_EVIDENCE = 0.0
SEED_WEIGHT = 3.0

# Words of the grammar.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "trash", "clown", "imbecile", "retard", "bastard", "bitch", "asshole", "vermin")
THREATS = set("kill hurt destroy beat shoot burn hang stab strangle murder töten umbringen tuer frapper matar golpear".split())
TARGETS = set(
    "you your yours yourself he she him her his they them their these those everyone people du dich dir dein ihr euch sie tu toi te ton vous votre "
    "ils elles eux tú tu usted ustedes ellos ellas te vosotros".split()
)
NEGATIONS = set("not no never neither nor without isn't aren't wasn't don't doesn't nicht kein keine nie pas ne jamais aucun nunca jamás tampoco".split())
REPORTS = set("said says say saying told wrote called calls quoted quote claims claimed asked sagt sagte schrieb dit disait écrit dijo dice escribió".split())

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:,|()\[\]\n]")

Arcs = dict[tuple[int, str], tuple[int, str]]


def _rule(states: int, move) -> Arcs:
    return {(s, a): move(s, a) for s in range(states) for a in "insytrmqo"}


def compose(first: Arcs, second: Arcs) -> Arcs:
    """The transducer that feeds the output of ``first`` to ``second``; both start in state 0."""
    number, todo, out = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        p, q = here = todo.pop()
        for (s, a), (p2, b) in first.items():
            if s == p:
                q2, c = second[q, b]
                if (p2, q2) not in number:
                    number[p2, q2] = len(number)
                    todo.append((p2, q2))
                out[number[here], a] = (number[p2, q2], c)
    return out


@lru_cache(maxsize=1)
def grammar() -> Arcs:
    """Input: i insult, t threat, y target, n negation, r report, o other. Output: s insult at a target, m negated, q reported insult."""
    negation = _rule(4, lambda s, a: (3, a) if a == "n" else (max(0, s - 1), "m" if a == "i" and s else a))
    report = _rule(2, lambda s, a: (1, a) if a == "r" else (s, "q" if a in "is" and s else a))
    target = _rule(2, lambda s, a: (1, a) if a == "y" else (s, "s" if a == "i" and s else a))
    threat = _rule(4, lambda s, a: (3, "o") if a == "t" else (0, "t") if a == "y" and s else (max(0, s - 1), a))
    return compose(compose(compose(negation, report), target), threat)


KINDS = "isqmt"
WIDTH = len(KINDS) + 3


@dataclass(frozen=True)
class Model:
    stems: tuple[tuple[str, float], ...]
    centre: tuple[float, ...] = (0.0,) * WIDTH
    scale: tuple[float, ...] = (1.0,) * WIDTH
    weights: tuple[float, ...] = (0.0,) * (WIDTH + 1)


@lru_cache(maxsize=2)
def _automaton(stems: tuple[tuple[str, float], ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for stem, _ in stems:
        automaton.add_word(stem, len(stem))
    for word in THREATS:
        automaton.add_word(word, len(word))
    automaton.make_automaton()
    by_size: dict[int, dict[str, float]] = defaultdict(dict)
    for stem, weight in stems:
        by_size[len(stem)][stem] = weight
    return automaton, sorted(by_size.items())


def _insult(word: str, by_size: list[tuple[int, dict[str, float]]]) -> float:
    return max((own.get(word[:n], 0.0) for n, own in by_size if n <= len(word)), default=0.0)


def _symbol(word: str) -> str:
    """Symbol of a word that is no insult."""
    return "t" if word in THREATS else "y" if word in TARGETS else "n" if word in NEGATIONS else "r" if word in REPORTS else "o"


def clause_weights(clause: str, by_size: list[tuple[int, dict[str, float]]]) -> Counter:
    """Weight by output symbol of a lower-case clause."""
    arcs, state, out = grammar(), 0, Counter()
    for word in _WORD.findall(clause):
        w = _insult(word, by_size)
        state, b = arcs[state, "i" if w else _symbol(word)]
        if b in KINDS:
            out[b] += w or 1.0
    return out


def describe(text: str | None, stems: tuple[tuple[str, float], ...]) -> list[float]:
    """Features of a whole text: log weights of its matched clauses by kind, the strongest clause, their number and density."""
    low = (text or "").lower()
    automaton, by_size = _automaton(stems)
    total, strongest, clauses, done = Counter(), 0.0, 0, -1
    for end, n in automaton.iter(low):
        start = end + 1 - n
        if start < done or start and (low[start - 1].isalnum()):
            continue
        stop = _CLAUSE_END.search(low, end + 1)
        last = stop.start() if stop else len(low)
        own = clause_weights(_CLAUSE_END.split(low[max(done, 0) : start])[-1] + low[start:last], by_size)
        if own:
            total.update(own)
            strongest = max(strongest, own["i"] + 1.5 * own["s"] + own["t"])
            clauses += 1
        done = last
    return [*(math.log1p(total[k]) for k in KINDS), math.log1p(strongest), math.log1p(clauses), math.log1p(1000 * sum(total.values()) / (len(low) + 200))]


def open_words(text: str | None) -> set[str]:
    """Words that the grammar would neither mark as negated nor as reported if they were insults."""
    arcs, out = grammar(), set()
    for clause in _CLAUSE_END.split((text or "").lower()):
        state = 0
        for word in _WORD.findall(clause):
            if arcs[state, "i"][1] in "is":
                out.add(word)
            state, _ = arcs[state, _symbol(word)]
    return out


def stem_counts(rows: Iterator[tuple[str | None, int]]) -> Counter:
    """(stem, label) -> texts in which a word starting with it stands openly."""
    out: Counter = Counter()
    for text, label in rows:
        words = open_words(text)
        out.update((s, label) for s in {w[:n] for w in words for n in STEM_CHARS if n <= len(w)})
    return out


def evidence(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Log ratio of the rates of a stem in toxic and in other texts, both taken at the cautious end of their error."""
    low = F.greatest(toxic - 1.64 * F.sqrt(toxic), F.lit(1e-9)) / max(1, n_toxic)
    high = (clean + 1.64 * F.sqrt(clean) + 2.7) / max(1, n_clean)
    return F.log(low / high)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression, by Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    pull = ridge * np.r_[np.ones(x.shape[1]), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9), a.T @ (y - p) - pull * w)
        w = w + np.clip(step, -2, 2)
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn stems and weights from labelled rows outside the held-out fold, ``SAMPLE_ROWS`` of them at most (smallest key hashes).

    Labels other than 0 and 1 and rows without a key or text are left out. Without labels of both kinds the seed words and
    fixed weights stand.
    """
    ship_package(docs.sparkSession)
    sample = labels.where(f"`{label}` IN (0, 1)").select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where(~held_out(F.col("id")))
    sample = sample.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    taught = texts.join(F.broadcast(sample), "id").select("text", "label")
    # Copies of a text would count as independent evidence.
    taught = checkpointed(taught.groupBy("text").agg(F.max("label").alias("label")).repartition(8))
    n = {r["label"]: r["n"] for r in taught.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    seeds = {w: SEED_WEIGHT for w in INSULTS}
    if len(n) < 2:
        weights = (1.0,) * (WIDTH - 1) + (0.0, -2.0)
        return Model(tuple(sorted(seeds.items())), weights=weights)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for b in batches:
            out.update(stem_counts(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        keys = list(out)
        yield pa.RecordBatch.from_pydict({"stem": [k[0] for k in keys], "label": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([out[k] for k in keys], pa.int64())})

    counts = taught.mapInArrow(count, "stem string, label int, n long").groupBy("stem")
    counts = counts.agg(F.sum(F.expr("IF(label = 1, n, 0)")).alias("toxic"), F.sum(F.expr("IF(label = 0, n, 0)")).alias("clean"))
    found = counts.withColumn("weight", evidence(F.col("toxic"), F.col("clean"), n[1], n[0])).where(F.col("weight") > LEAST_EVIDENCE)
    found = found.orderBy(F.desc("weight"), "stem").collect()
    learnt = {r["stem"]: float(r["weight"]) for r in found}
    # A longer stem adds nothing below a shorter one of nearly the same evidence.
    learnt = {s: w for s, w in learnt.items() if not any(learnt.get(s[:k], -9.0) >= w - 0.7 for k in range(STEM_CHARS[0], len(s)))}
    stems = tuple(sorted((seeds | learnt).items()))

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([describe(t, stems) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    rows = taught.mapInArrow(view, "x array<double>, label int").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    weights = logistic((x - centre) / scale, y)
    return Model(stems, tuple(centre.tolist()), tuple(scale.tolist()), tuple(weights.tolist()))


def held_out(key: Column) -> Column:
    """Rows that never teach: a fifth, by the CRC of the key."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def probability(x: np.ndarray, model: Model) -> np.ndarray:
    z = (x - np.array(model.centre)) / np.array(model.scale) @ np.array(model.weights[:-1]) + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, held_out, score, predicted. Only the text decides the score.

    Null and empty texts score as texts without a match; repeated rows score alike; other columns are ignored; an empty
    table gives an empty result.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches):
            x = np.array([describe(t, model.stems) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(probability(x, model))], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, score double")
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that are not predicted toxic, with all their columns.

    The text alone decides: null and empty texts stay, whatever the key, null or repeated; rows with equal texts stay or go together; very
    long texts are read whole. Columns of ``docs`` may have any names; an empty table gives an empty result.
    """
    model = fit(docs, labels, key, text)
    return without_texts(docs, text, lambda texts, mark, column: score(texts, model, mark, column).where("predicted = 1").select(mark))
