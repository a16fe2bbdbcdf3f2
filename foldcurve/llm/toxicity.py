"""Toxic spans by a linear-chain conditional random field over tokens.

A token is a run of letters, lower-cased. Its features are the word and its first four
and five letters. Labels are given per document, so tokens are labelled first: over all
labelled training rows the documents with each feature are counted, toxic and clean;
a token of a toxic document is labelled toxic if one of its features is far more common
in toxic documents than in clean ones. The field has two states, a weight per kept
feature, a bias and four transition weights, and is fitted by gradient ascent on the
likelihood of a bounded sample of labelled documents.

Scoring: forward-backward gives each token its probability of being toxic; a document's
score is the probability that at least one token is, taken as independent, beyond what
the same number of neutral tokens gives, so that long clean texts do not add up; tokens
with probability 0.5 or more are the offending spans. A document is taken to stand in
neutral text without end. Messages in a run of neutral tokens settle at a fixed point,
so they are iterated only around tokens that bear a weight, until nothing moves by more
than 1e-12; all other tokens of the text are neutral and add nothing to its score.

The model is a few thousand numbers, bounded by `max_features`, and travels with the
tasks. Scoring shuffles nothing. Null and empty texts, and texts without letters, have
no token: their score is 0. Rows without a label, with a null label, and repeated rows
of a label table (the greatest label counts) are handled; without toxic training rows
every score is 0. Repeated documents give repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.llm.common import written

TOKEN = re.compile(r"[^\W\d_]+")
#: A sample of labelled documents fits the weights; counts of features come from all of them.
SAMPLE_DOCS = 1200
MAX_FEATURES = 50_000
#: Features kept: how much more common they are in toxic documents, and the evidence for it:
#: toxic documents times the log of that ratio, far beyond what chance gives among a million features.
RATIO = 40.0
EVIDENCE = 10.0
COUNTER_ENTRIES = 400_000
SEGMENT = 32
THRESHOLD = 0.3


def features(word: str) -> tuple[str, ...]:
    """The word, and its beginnings where it is longer than they are."""
    return ("=" + word, word[:4] if len(word) > 4 else "", word[:5] if len(word) > 5 else "")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and y of documents that have a label. Labels grow with the documents, so both sides are dealt by id at any size."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    return docs.select("doc_id", "text").join(y.hint("merge"), "doc_id")


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, toxic, clean: documents that hold it. Counted in each task before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())],
                ["feature", "toxic", "clean"],
            )
            counts[0].clear()
            counts[1].clear()
            return batch

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                words = set(TOKEN.findall((text.as_py() or "").lower()))
                found = {f for w in words for f in features(w) if f}
                counts[1 if y.as_py() else 0].update(found)
                if len(counts[0]) + len(counts[1]) > COUNTER_ENTRIES:
                    yield out()
        if counts[0] or counts[1]:
            yield out()

    parts = rows.select("text", "y").mapInArrow(run, "feature string, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Field:
    """weights: feature to its weight for toxic against neutral. step[a][b]: transition weight from a to b."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -50.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Logistic scale and shift from the summed losses of a document to its score.
    scale: float = 1.0
    shift: float = -50.0

    def __post_init__(self) -> None:
        self.words: dict[str, float] = {}
        self.calm = self.settle()

    def weight(self, word: str) -> float:
        """Sum of the weights of a word's features: 0 for a neutral word."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > 500_000:
                self.words.clear()
            found = self.words[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def forward(self, before: np.ndarray) -> np.ndarray:
        """Log odds that a state sends on, from the log odds of the state before."""
        s = self.step
        return np.logaddexp(s[0, 1], before + s[1, 1]) - np.logaddexp(s[0, 0], before + s[1, 0])

    def backward(self, after: np.ndarray) -> np.ndarray:
        s = self.step
        return np.logaddexp(s[1, 0], after + s[1, 1]) - np.logaddexp(s[0, 0], after + s[0, 1])

    def settle(self) -> tuple[float, float, float]:
        """Messages inside endless neutral text, and how far a change is felt, in tokens."""
        f = b = np.float64(self.bias)
        steps = 0
        for steps in range(1, 10_000):
            f2, b2 = self.bias + self.forward(f), self.bias + self.backward(b)
            moved = max(abs(f2 - f), abs(b2 - b))
            f, b = f2, b2
            if moved < 1e-13:
                break
        return float(f), float(b), min(steps, 200)

    def losses(self, docs: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents given by the weights of their tokens: the sum over tokens of -log(1 - p) beyond a
        neutral token's, and for the tokens near loaded ones the document, the place and the log odds."""
        f0, b0, reach = self.calm
        neutral = float(np.logaddexp(0, f0 + b0 - self.bias))
        owners, places, loads, firsts = [], [], [], []
        for i, weights in enumerate(docs):
            for a, b in islands(len(weights), [j for j, w in enumerate(weights) if w], reach):
                owners.extend([i] * (b - a))
                places.extend(range(a, b))
                loads.extend(weights[a:b])
                firsts.extend([True] + [False] * (b - a - 1))
        owner = np.array(owners, int)
        if not loads:
            return np.zeros(len(docs)), owner, owner, np.zeros(0)
        odds = self.marginals(np.array(loads), np.array(firsts))
        lost = np.bincount(owner, np.maximum(np.logaddexp(0, odds) - neutral, 0), len(docs))
        return lost, owner, np.array(places, int), odds

    def scores(self, lost: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * np.minimum(lost, 500) + self.shift)))

    def marginals(self, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of toxic for tokens of islands laid end to end; starts marks the first of each.

        Jacobi steps of the forward and backward messages, with neutral text outside the islands.
        """
        f0, b0, _ = self.calm
        emit = weights + self.bias
        f, b = np.full(len(emit), f0), np.full(len(emit), b0)
        ends = np.append(starts[1:], True)
        for _ in range(10_000):
            from_left = np.where(starts, f0, np.append(f0, f[:-1]))
            from_right = np.where(ends, b0, np.append(b[1:], b0))
            f2, b2 = emit + self.forward(from_left), emit + self.backward(from_right)
            moved = max(np.abs(f2 - f).max(), np.abs(b2 - b).max())
            f, b = f2, b2
            if moved < 1e-12:
                break
        return f + b - emit


def islands(n: int, loaded: list[int], reach: int) -> list[tuple[int, int]]:
    """Ranges of token positions within `reach` of a loaded one, merged where they meet."""
    out: list[tuple[int, int]] = []
    for i in loaded:
        a, b = max(0, i - reach), min(n, i + reach + 1)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def fit(rows: DataFrame) -> Field:
    """The field of labelled training rows (doc_id, text, y). They are joined and written once, then read four times."""
    rows = written(rows)
    counts = feature_counts(rows)
    totals = rows.agg(F.sum("y"), F.count(F.lit(1))).first()
    n_toxic, n_all = int(totals[0] or 0), int(totals[1])
    n_clean = n_all - n_toxic
    if n_toxic == 0 or n_clean == 0:
        return Field()
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    kept = (
        counts.withColumn("ratio", ratio)
        .where((F.col("ratio") >= RATIO) & (F.col("toxic") * F.log("ratio") >= EVIDENCE))
        .orderBy(F.desc(F.col("toxic") * F.log("ratio")), "feature")
        .limit(MAX_FEATURES)
        .select("feature", "ratio")
        .collect()
    )
    names = {r.feature: i for i, r in enumerate(kept)}
    if not names:
        return Field()
    docs = sample(rows, names)
    return calibrated(fitted(names, docs), list(names), docs, n_toxic / n_clean)


def calibrated(model: Field, names: list[str], docs: list[tuple[int, list[list[int]]]], odds: float) -> Field:
    """The field with the logistic curve from losses to labels of the sample, moved to the odds of all rows."""
    lost, *_ = model.losses([[sum(model.weights.get(names[k], 0.0) for k in found) for found in tokens] for _, tokens in docs])
    y = np.array([y for y, _ in docs], float)
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return model
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([np.minimum(lost, 500), np.ones_like(lost)], 1)
    theta = np.array([0.5, -2.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ theta))
        gradient = x.T @ (target - p) - 1e-3 * theta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, gradient)
        theta = theta + np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    model.scale, model.shift = float(max(theta[0], 0)), float(theta[1] + np.log(odds) - np.log(n1 / n0))
    return model


def sample(rows: DataFrame, names: dict[str, int]) -> list[tuple[int, list[list[int]]]]:
    """(y, kept features of each token) of at most SAMPLE_DOCS documents, half of them toxic, in an order of hashes.

    Only the feature numbers of tokens reach the driver; runs of tokens without any are sent as their length.
    """
    keyed = rows.withColumn("sign", F.xxhash64(F.lit("toxicity sample"), "doc_id", "text"))
    # Signs are drawn without their texts, each once; then the texts of those drawn are fetched, one for each sign.
    signs = keyed.groupBy("sign").agg(F.max("y").alias("label"))
    parts = [signs.where(F.col("label") == y).orderBy("sign").limit(SAMPLE_DOCS // 2) for y in (0, 1)]
    drawn = [r.sign for part in parts for r in part.select("sign").collect()]
    wanted = rows.sparkSession.createDataFrame([(s,) for s in drawn], "sign long")
    fetched = keyed.join(F.broadcast(wanted), "sign").groupBy("sign").agg(F.max("y").alias("y"), F.min("text").alias("text"))  # SAMPLE_DOCS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = []
            for text in batch.column(1):
                out, run_length = [], 0
                for word in TOKEN.findall((text.as_py() or "").lower()):
                    found = [names[f] for f in features(word) if f in names]
                    if found:
                        out.append(-run_length - 1)
                        out.extend(found)
                        run_length = 0
                    else:
                        run_length += 1
                out.append(-run_length - 1)
                coded.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.list_(pa.int32()))], ["y", "coded"])

    out = []
    for row in fetched.orderBy("sign").select("y", "text").mapInArrow(run, "y int, coded array<int>").collect():
        tokens: list[list[int]] = []
        for x in row.coded:
            if x < 0:
                tokens.extend([] for _ in range(-x - 1))
                tokens.append([])
            else:
                tokens[-1].append(x)
        tokens.pop()  # the place after the last run of neutral tokens
        out.append((row.y, tokens))
    return out


def fitted(names: dict[str, int], docs: list[tuple[int, list[list[int]]]], rounds: int = 100, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Adam on the mean log likelihood of segments of SEGMENT tokens, with a ridge on the weights."""
    n_features = len(names)
    parts = [(y, tokens[at : at + SEGMENT]) for y, tokens in docs for at in range(0, len(tokens), SEGMENT)]
    loaded = [part for part in parts if any(part[1])]
    plain = [part for part in parts if not any(part[1])]
    # Neutral segments teach the bias alone: as many as loaded ones stand for all of them.
    some = plain[:: max(1, len(plain) // max(1, len(loaded)))]
    if not loaded:
        return Field()
    share = np.array([1.0] * len(loaded) + [len(plain) / max(1, len(some))] * len(some))
    cells, kinds, truth = [], [], []
    for place, (label, part) in enumerate(loaded + some):
        for j, found in enumerate(part):
            cells.extend([place * SEGMENT + j] * len(found))
            kinds.extend(found)
        truth.append([int(bool(found) and label == 1) for found in part] + [-1] * (SEGMENT - len(part)))
    y = np.array(truth)
    real = y >= 0
    on = (y == 1).astype(float)
    cells, kinds = np.array(cells, int), np.array(kinds, int)
    total = (real * share[:, None]).sum()
    # Parameters: weights, bias, and transitions into toxic from neutral and from toxic (into neutral: 0).
    theta = np.zeros(n_features + 3)
    theta[n_features] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pair_on = np.stack([(((y[:, :-1] == a) & (y[:, 1:] == 1)) * share[:, None]).sum() for a in (0, 1)])
    for step in range(1, rounds + 1):
        w, bias, t0, t1 = theta[:n_features], theta[n_features], theta[n_features + 1], theta[n_features + 2]
        emit = np.full(y.shape, bias)
        np.add.at(emit.reshape(-1), cells, w[kinds])
        # Log messages of both states; past the end of a segment they stay as they are.
        a = np.zeros((*y.shape, 2))
        a[:, 0, 1] = emit[:, 0]
        for j in range(1, SEGMENT):
            to0 = np.logaddexp(a[:, j - 1, 0], a[:, j - 1, 1])
            to1 = np.logaddexp(a[:, j - 1, 0] + t0, a[:, j - 1, 1] + t1) + emit[:, j]
            a[:, j, 0] = np.where(real[:, j], to0, a[:, j - 1, 0])
            a[:, j, 1] = np.where(real[:, j], to1, a[:, j - 1, 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        back = np.zeros((len(y), 2))
        p_on = np.zeros(y.shape)
        pair = np.zeros(2)
        for j in range(SEGMENT - 1, -1, -1):
            p_on[:, j] = np.exp(a[:, j, 1] + back[:, 1] - z) * real[:, j]
            if j:
                here = real[:, j]
                into1 = emit[:, j] + back[:, 1]
                pair[0] += (np.exp(a[:, j - 1, 0] + t0 + into1 - z) * here * share).sum()
                pair[1] += (np.exp(a[:, j - 1, 1] + t1 + into1 - z) * here * share).sum()
                new0 = np.logaddexp(back[:, 0], t0 + into1)
                new1 = np.logaddexp(back[:, 0], t1 + into1)
                back = np.where(here[:, None], np.stack([new0, new1], 1), back)
        excess = (on - p_on) * real * share[:, None]
        gradient = np.concatenate([np.bincount(kinds, excess.reshape(-1)[cells], n_features), [excess.sum()], pair_on - pair]) / total
        gradient -= ridge / n_features * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = theta[:n_features]
    step_weights = np.array([[0.0, theta[n_features + 1]], [0.0, theta[n_features + 2]]])
    return Field({f: float(w[i]) for f, i in names.items() if w[i] != 0}, float(theta[n_features]), step_weights)


def tag(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, and spans: arrays of (start, stop, p) of the offending tokens, in code points."""
    state = (model.weights, model.bias, model.step, model.scale, model.shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*state)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lost, owner, place, odds = own.losses([[own.weight(w) for w in TOKEN.findall(t.lower())] if t else [] for t in texts])
            scores = own.scores(lost)
            found: list[list[dict]] = [[] for _ in texts]
            wanted: dict[int, dict[int, float]] = {}
            for k in np.flatnonzero(odds >= 0):
                wanted.setdefault(int(owner[k]), {})[int(place[k])] = float(1 / (1 + np.exp(-odds[k])))
            for i, tokens in wanted.items():
                # Lower-casing may change lengths, so offsets are those of the tokens in the text itself.
                for j, match in enumerate(TOKEN.finditer(texts[i])):
                    if j in tokens:
                        found[i].append({"start": match.start(), "stop": match.end(), "p": tokens[j]})
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32()), pa.array(found, span)],
                ["doc_id", "score", "predicted", "spans"],
            )

    schema = "doc_id long, score double, predicted int, spans array<struct<start:int,stop:int,p:double>>"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, schema)


def clean(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below the threshold."""
    state = (model.weights, model.bias, model.step, model.scale, model.shift)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*state)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            lost, *_ = own.losses([[own.weight(w) for w in TOKEN.findall(t.lower())] if t else [] for t in texts])
            yield batch.filter(pa.array(own.scores(lost) < threshold))

    return docs.mapInArrow(run, docs.schema)
