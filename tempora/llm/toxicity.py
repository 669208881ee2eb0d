"""Toxicity scores by weak supervision.

Voters are words (a lexicon) and word beginnings (patterns) that a bounded sample of labelled rows proposes. A voter votes on a
text where it occurs and abstains elsewhere. A generative label model, fitted by expectation maximisation to the votes alone,
estimates how often each voter fires on either class and how voters fire together within the classes; voters that repeat each
other share their weight through the inverse of that correlation. The labels give it the share of the toxic class, say which
class is which, and propose the voters, whose odds then are where it starts; no row's label enters its posterior. The posteriors are what a linear classifier over the votes and the number and share of the words
behind them is trained on, and that scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import map_arrow, written

#: Labelled rows that a fit takes at most: those whose hashed ids are smallest.
MAX_LABELLED = 8000
MAX_VOTERS = 200
#: Rows whose crc32(doc_id as text) leaves 0 are held out.
FOLDS = 5
PREFIXES = range(4, 10)
#: A voter may also ask for so many occurrences.
TIMES = (2, 3)
#: Brings the share of words that make voters fire to the size of the other features.
SHARE_SCALE = 20
#: A voter fires on so many texts and such a share of the toxic class at least, and so many times more often there: of very many
#: candidates, some look good on a few texts by chance.
MIN_SUPPORT, MIN_SHARE, MIN_LIFT = 3, 0.025, 8.0
CACHE_WORDS = 500_000
#: Correlations up to SAME, and the share CHANCE of others, are taken as chance; a turn goes so far.
SAME, CHANCE, TURN = 0.1, 0.3, 0.5
#: The rates on which voters were proposed count like so many texts of a class.
PROPOSAL = 2.0
MAX_TURNS = 200
_WORDS = re.compile(r"[^\W\d_]+")


def votes(text: str) -> set[str]:
    """Everything in a text that could be a voter: its words, with a hyphen their beginnings, and these again with a number where they come that often."""
    counts: dict[str, int] = {}
    for w in _WORDS.findall(text.lower()):
        counts[w] = counts.get(w, 0) + 1
        for n in PREFIXES:
            if len(w) <= n:
                break
            counts[w[:n] + "-"] = counts.get(w[:n] + "-", 0) + 1
    return counts.keys() | {f"{w}{n}" for n in TIMES for w, k in counts.items() if k >= n}


class _Stems(dict):
    """Word to the stems of voters that it has, a bounded cache."""

    def __init__(self, stems: dict[str, int]) -> None:
        super().__init__()
        self.stems = stems

    def __reduce__(self) -> tuple:
        return _Stems, (self.stems,)

    def __missing__(self, w: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = (self.stems.get(x) for x in (w, *(w[:n] + "-" for n in PREFIXES if len(w) > n)))
        self[w] = out = tuple(i for i in found if i is not None)
        return out


@dataclass
class Model:
    """voters by column; rates: how often each fires on the clean and the toxic class; correlations: of voters within the classes;
    label_weights and label_bias: the label model's log odds; weights and bias: the classifier's."""

    voters: dict[str, int]
    rates: np.ndarray
    correlations: np.ndarray
    label_weights: np.ndarray
    label_bias: float
    weights: np.ndarray
    bias: float

    def fired(self, text: str) -> tuple[list[int], float, float]:
        """The voters that fire, and the number and the share of the words that make one fire."""
        words = _WORDS.findall(text.lower())
        counts, hits = {}, 0
        for stems in filter(None, map(self.known.__getitem__, words)):
            hits += 1
            for own in stems:
                counts[own] = counts.get(own, 0) + 1
        voters = [j for own, k in counts.items() for n, j in self.levels[own] if k >= n]
        return sorted(voters), hits, hits / max(1, len(words))

    def score(self, text: str) -> float:
        voters, hits, share = self.fired(text)
        z = self.bias + self.weights[voters].sum()
        if len(self.weights) > len(self.voters):
            z += self.weights[-2] * np.log1p(hits) + self.weights[-1] * share * SHARE_SCALE
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    def __post_init__(self) -> None:
        self.stems, self.levels = {}, []
        for v, j in self.voters.items():
            stem = v.rstrip("0123456789")
            i = self.stems.setdefault(stem, len(self.stems))
            if i == len(self.levels):
                self.levels.append([])
            self.levels[i].append((int(v[len(stem) :] or 1), j))
        self.known = _Stems(self.stems)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _bias(s: np.ndarray, share: float) -> float:
    """What must be added to log odds for the probabilities to have this mean."""
    low, high = -200.0, 200.0
    for _ in range(70):
        middle = (low + high) / 2
        low, high = (low, middle) if _sigmoid(s + middle).mean() > share else (middle, high)
    return (low + high) / 2


def label_model(x: np.ndarray, share: float, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Posteriors of the toxic class from votes (rows are texts, columns voters), the voters' rates on either class, their correlations within the classes, and the weights and bias of the log odds.

    `start` has the rates at which voters were proposed: the first estimate and, for few texts, a prior. A turn takes rates and correlations from the posteriors, and new posteriors from these: the
    weights are the inverse of the correlations times the log odds ratios, not below 0, and the bias keeps the classes' shares.
    """
    n, m = x.shape
    both = x.T @ x / n
    odds_of = lambda on: np.log(on[1] / on[0]) - np.log((1 - on[1]) / (1 - on[0]))
    w = odds_of(start)
    bias = _bias(x @ w, share)
    p = _sigmoid(x @ w + bias)
    for _ in range(MAX_TURNS):
        total = np.array([(1 - p).sum(), p.sum()])
        on = np.clip((np.stack([1 - p, p]) @ x + PROPOSAL * start) / (total[:, None] + PROPOSAL), 1e-5, 1 - 1e-5)
        within = both - (on.T * (total / n)) @ on
        deviation = np.sqrt(np.maximum(np.diag(within), 1e-9))
        correlation = within / deviation[:, None] / deviation
        np.fill_diagonal(correlation, 1)
        wanted = np.linalg.solve((1 - CHANCE) * np.where(np.abs(correlation) > SAME, np.clip(correlation, -1, 1), 0) + CHANCE * np.eye(m), odds_of(on))
        w = w + TURN * (np.maximum(wanted, 0) - w)
        bias = _bias(x @ w, share)
        new = _sigmoid(x @ w + bias)
        change, p = np.abs(new - p).max(), new
        if change < 1e-4:
            break
    return p, on, correlation, w, bias


def _linear(x: np.ndarray, p: np.ndarray, penalty: float = 0.3, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + np.diag(ridge), a.T @ (p - q) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def none(share: float) -> Model:
    """The model without voters: each text has the prior."""
    return Model({}, np.zeros((2, 0)), np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), float(np.log(share / (1 - share))))


def fold(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """At most `most` texts with labels outside the held-out rows: those whose hashed ids are smallest, one for each id.

    Labels that are null or have no id, and ids that docs lacks, are left out; of repeated labels the greatest counts and of texts
    that share an id the greatest; a null text is none.
    """
    own = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    chosen = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `most` rows of two numbers
    return texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))


def proposed(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """At most 4 * MAX_VOTERS voters and how often they fire on clean and on toxic texts, by how surely they fire on the toxic class more often; ties go by length and name. rows has text and toxic; counts are summed where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update(votes(text.as_py() or ""))
        for counts, y in ((toxic, 1), (clean, 0)):
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([y] * len(counts), pa.int32())], names=["vote", "n", "toxic"])

    n1, n0 = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    counts = map_arrow(rows.select("text", F.col("toxic").cast("int")), run, "vote string, n long, toxic int", "toxicity")
    on = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0))
    per = counts.groupBy("vote").agg(on(1).alias("n1"), on(0).alias("n0")).where(F.col("n1") >= max(MIN_SUPPORT, MIN_SHARE * n1))
    per = per.withColumn("lift", F.col("n1") / max(1, n1) / ((F.col("n0") + 0.5) / max(1, n0))).where(F.col("lift") >= MIN_LIFT)
    best = per.orderBy((F.col("n1") * F.log("lift")).desc(), F.length("vote"), "vote").limit(4 * MAX_VOTERS)
    rate = lambda k, n: (k + 0.1) / (n + 0.2)
    return {v: (rate(k0, n0), rate(k1, n1)) for v, k1, k0 in best.select("vote", "n1", "n0").collect()}  # a model's size, whatever the tables hold


def fired(rows: DataFrame, model: Model) -> dict[str, list]:
    """toxic, the voters that fire, and the number and share of their words, for each row in order of doc_id: numbers for at most MAX_LABELLED rows, not their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.fired(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["doc_id", "toxic", "voters", "hits", "share"])

    columns = rows.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text")
    return map_arrow(columns, run, "doc_id long, toxic int, voters array<int>, hits long, share double", "toxicity").toArrow().sort_by("doc_id").to_pydict()


def vote_matrix(voters: list[list[int]], m: int) -> np.ndarray:
    x = np.zeros((len(voters), m))
    for i, own in enumerate(voters):
        x[i, own] = 1
    return x


def distinct_voters(x: np.ndarray, most: int = MAX_VOTERS) -> list[int]:
    """The first voter of those with the same votes, `most` of them at most."""
    first: dict[bytes, int] = {}
    for j in range(x.shape[1]):
        first.setdefault(x[:, j].tobytes(), j)
    return sorted(first.values())[:most]


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """A model of the labelled texts outside the held-out rows, `most` at most.

    Rows without label, id or text in docs, and repeated ones, as in `labelled`; without labelled rows, without both classes or
    without a voter, a model that gives every text the prior (between 0.001 and 0.4); extra columns are ignored.
    """
    rows = written(labelled(docs, labels, most).select("doc_id", "toxic", "text"), "toxicity-labelled")
    mean = rows.agg(F.avg("toxic")).first()[0]
    share = float(np.clip(mean or 0.0, 0.001, 0.4))
    rates = proposed(rows)
    names = list(rates)
    if not names or mean == 1:
        return none(share)
    model = Model({v: j for j, v in enumerate(names)}, np.zeros((2, 0)), np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0.0)
    names = [names[j] for j in distinct_voters(vote_matrix(fired(rows, model)["voters"], len(names)))]
    model = Model({v: j for j, v in enumerate(names)}, np.zeros((2, 0)), np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0.0)
    seen = fired(rows, model)
    x, y = vote_matrix(seen["voters"], len(names)), np.array(seen["toxic"], float)
    p, model.rates, model.correlations, model.label_weights, model.label_bias = label_model(x, share, np.array([rates[v] for v in names]).T)
    if (p * y).sum() / y.sum() < (p * (1 - y)).sum() / max(1, (1 - y).sum()):  # the classes the other way round
        p = 1 - p
    more = np.column_stack([np.log1p(seen["hits"]), np.array(seen["share"]) * SHARE_SCALE])
    model.weights, model.bias = _linear(np.hstack([x, more]), p)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1, the higher the likelier toxic) and predicted (1 from 0.5 on) for each row of docs.

    Only the text is looked at. Null and empty texts hold no voter and score below any text that does; repeated rows score
    alike; a null doc_id isn't held out; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_VOTERS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            scores = [m.score(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d is not None and fold(d) == 0 for d in ids], pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, held_out boolean, score double, predicted int", "toxicity")


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Trains on labels and scores docs; nulls, empties, repeated rows, empty tables and extra columns as in `train` and `score`."""
    return score(docs, train(docs, labels, most))
