"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its evidence is a few shares of its characters and words and the same
shares of the lines before and after it; neighbouring labels are coupled. A document's quality is the mean,
weighted by the lines' lengths, of the forward-backward marginals of "good", put on the scale of a
probability by a logistic curve fitted on the training documents.

Training uses at most ``TRAIN_DOCS`` labelled documents of each class, those whose ids have the smallest
hashes, and of each at most ``TRAIN_LINES`` lines, in evenly spread runs of ``TRAIN_RUN`` neighbouring lines; a line keeps the features
of its true neighbours, labels are coupled within a run only, and a line takes its document's label. Rows
whose crc32(id) modulo ``HELD_OUT`` is 0 are never used. Scoring reads every line of every text, in one pass
without a shuffle; the model, some forty numbers, travels with the task.

A null text is the empty text, which is scored like any other (one empty line). If a class has no training
documents, every document gets the share of label 1 among the labels, or 0.5 without labels. Rows are scored by
their text alone, so that ids may repeat or be null and equal texts have equal scores; of several labels of an id
the larger counts, of several training texts of an id the smallest. Other columns pass through, whatever their
names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_columns, table

HELD_OUT, THRESHOLD = 5, 0.3
TRAIN_DOCS, TRAIN_LINES, TRAIN_RUN = 2000, 64, 16
FEATURES = 8
BYTES_AT_ONCE = 1 << 20

_SIGNS = np.zeros(256, np.uint8)
_SIGNS[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]] = 1
_UPPER, _LOWER, _DIGIT, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and weights (bytes) of all lines of the texts, and each text's number of lines.

    A line's bytes include its end, so that no line is empty to the sums below.
    """
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    counts = np.array([r.count(b"\n") for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
    body = data[:-8]
    ends = np.flatnonzero(body == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts + 1).astype(np.float32)
    total = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64).astype(np.float32)
    upper, lower = total(_UPPER[body]), total(_LOWER[body])
    space = _SPACE[body]
    begins = ~space
    begins[1:] &= space[:-1]
    words = total(begins)
    first = np.flatnonzero(begins)
    repeats = np.zeros(len(body), np.uint8)
    if len(first) > 1:
        closing = space.copy()
        closing[1:] &= ~space[:-1]
        closing[0] = False
        length = np.flatnonzero(closing)[: len(first)] - first
        head = np.lib.stride_tricks.sliding_window_view(data, 8)[first].copy().view("<u8").ravel()
        short = np.minimum(length, 8).astype(np.uint64)
        mask = np.where(short >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (short * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        mark = (head & mask) ^ (length.astype(np.uint64) << np.uint64(50))
        # A word repeats the one before it in its line.
        same = np.flatnonzero(mark[1:] == mark[:-1])
        same = same[np.searchsorted(ends, first[same]) == np.searchsorted(ends, first[same + 1])]
        repeats[first[same + 1]] = 1
    n = np.maximum(words, 1)
    out = np.stack(
        [
            np.log1p(words) / 5,
            np.minimum(total(_SIGNS[body]) / size * 5, 2),
            upper / np.maximum(upper + lower, 1),
            np.minimum(total(body == 33) / n, 2),
            np.minimum(total(body == 124) / n * 3, 2),
            total(repeats) / n,
            np.minimum(total(_DIGIT[body]) / size * 5, 2),
            np.minimum(size / n / 20, 2),
        ],
        axis=1,
    )
    return out.astype(np.float32), size, counts


def with_neighbours(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A constant, the line's features and those of the lines before and after (zeros at a document's ends)."""
    ends = np.cumsum(counts)
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[ends - counts] = 0
    after[ends - 1] = 0
    return np.concatenate([np.ones((len(features), 1), np.float32), features, before, after], axis=1)


def forward_backward(scores: np.ndarray, counts: np.ndarray, coupling: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of "good" per line, expected label pairs (2 x 2) and the sum of log partition functions.

    ``scores``: log-odds of each line by itself; ``coupling``: log-weights from a label (bad, good) to the
    next. All documents advance together, longest first, one line at a time.
    """
    order = np.argsort(-counts, kind="stable")
    sizes, starts = counts[order], (np.cumsum(counts) - counts)[order]
    emit = np.zeros((len(scores), 2))
    emit[:, 1] = scores
    emit -= np.logaddexp(0, scores)[:, None]
    alpha, scale = np.zeros((len(scores), 2)), np.zeros(len(scores))
    weights = np.exp(coupling - coupling.max())
    shift = coupling.max()
    local = np.exp(emit)
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
    state = None
    for t in range(len(active)):
        at = starts[: active[t]] + t
        state = local[at] if t == 0 else (state[: active[t]] @ weights) * local[at]
        norm = state.sum(axis=1)
        state = state / norm[:, None]
        alpha[at], scale[at] = state, norm
    beta = np.ones((len(scores), 2))
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        message = local[at] * beta[at] / scale[at][:, None]
        pairs += (alpha[at - 1].T @ message) * weights
        beta[at - 1] = message @ weights.T
    marginal = alpha * beta
    steps = len(scores) - len(counts)
    log_z = float(np.log(scale).sum() + np.logaddexp(0, scores).sum() + shift * steps)
    return marginal[:, 1] / marginal.sum(axis=1), pairs, log_z


class LineModel:
    """Weights of the field and of the curve that turns a document's mean into a probability."""

    def __init__(self) -> None:
        self.weights = np.zeros(1 + 3 * FEATURES)
        self.coupling = np.zeros((2, 2))
        self.curve = (0.0, 1.0)
        self.constant: float | None = None

    def means(self, features: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each document."""
        return self.weighted(with_neighbours(features, counts), size, counts, counts)

    def weighted(self, inputs: np.ndarray, size: np.ndarray, counts: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """The same from lines with their neighbours' features; ``runs``: lengths of the runs of neighbouring lines."""
        good, _, _ = forward_backward(inputs @ self.weights, runs, self.coupling)
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(good * size, starts) / np.add.reduceat(size.astype(np.float64), starts)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        a, b = self.curve
        mean = np.clip(self.means(*line_features(texts)), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(a + b * np.log(mean / (1 - mean)), -30, 30)))

    def fit(self, inputs: np.ndarray, size: np.ndarray, counts: np.ndarray, runs: np.ndarray, of: np.ndarray, labels: np.ndarray, positive: float, steps: int = 200) -> None:
        """Gradient ascent on the lines' conditional likelihood, classes weighted equally, then the curve.

        ``inputs``: lines with their neighbours' features; ``counts``: each document's lines; ``runs`` and ``of``:
        lengths of the runs of neighbouring lines and their documents.
        """
        inputs, run_labels = inputs.astype(np.float64), labels[of]
        line_label = np.repeat(labels, counts).astype(np.float64)
        per_doc = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
        # Documents of a class weigh the same in total; inside a document lines count equally.
        line_weight = np.repeat(per_doc / counts, counts)
        observed = np.zeros((2, 2))
        steps_of = {c: runs[run_labels == c].sum() - (run_labels == c).sum() for c in (0, 1)}
        for c in (0, 1):
            observed[c, c] = 0.5 * (steps_of[c] > 0)
        w = np.concatenate([self.weights, self.coupling.ravel()])
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            coupling = w[-4:].reshape(2, 2)
            good, _, _ = forward_backward(inputs @ w[:-4], runs, coupling)
            gradient = inputs.T @ (line_weight * (line_label - good)) - 0.0005 * w[:-4]
            expected = np.zeros((2, 2))
            for c in (0, 1):
                if steps_of[c] > 0:
                    chosen = np.repeat(labels == c, counts)
                    _, pairs, _ = forward_backward((inputs @ w[:-4])[chosen], runs[run_labels == c], coupling)
                    expected += 0.5 * pairs / steps_of[c]
            pull = 0.2 * (observed - expected) - 0.02 * coupling
            g = np.concatenate([gradient, pull.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.coupling = w[:-4], w[-4:].reshape(2, 2)
        mean = np.clip(self.weighted(inputs, size, counts, runs), 1e-6, 1 - 1e-6)
        x = np.log(mean / (1 - mean))
        share = np.where(labels == 1, positive / max(1, labels.sum()), (1 - positive) / max(1, (1 - labels).sum()))
        a, b = 0.0, 1.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
            r, h = share * (labels - p), share * p * (1 - p) + 1e-9
            hessian = np.array([[h.sum() + 1e-4, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1e-4]])
            da, db = np.linalg.solve(hessian, [r.sum() - 1e-4 * a, (r * x).sum() - 1e-4 * (b - 1)])
            a, b = a + np.clip(da, -1, 1), max(0.05, b + np.clip(db, -1, 1))
        self.curve = (float(a), float(b))


def training_lines(text: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Lines with their neighbours' features, their weights, and the lengths of the runs of neighbouring lines."""
    features, size, counts = line_features([text])
    inputs, n = with_neighbours(features, counts), len(size)
    if n <= TRAIN_LINES:
        return inputs, size, [n]
    # Blocks of a run's length, the last one moved back to end with the text; the gaps between them may be 0.
    starts = np.linspace(0, n - TRAIN_RUN, TRAIN_LINES // TRAIN_RUN).astype(np.int64)
    at = (starts[:, None] + np.arange(TRAIN_RUN)).ravel()
    return inputs[at], size[at], [TRAIN_RUN] * len(starts)


def _sample(batches):
    for labels, texts in batches:
        out: list[list] = [[], [], [], []]
        for label, text in zip(labels, texts, strict=True):
            inputs, size, runs = training_lines(text or "")
            for column, value in zip(out, (label, inputs.ravel().astype(float), size.astype(float), runs), strict=True):
                column.append(value)
        yield out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> LineModel:
    """Fit on the bounded sample; ``labels`` has ``key`` and ``label`` (0 or 1; other values are ignored)."""
    usable = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold("id", HELD_OUT) != 0))
    usable = usable.groupBy("id").agg(F.max("label").alias("label"))
    model = LineModel()
    shares = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    chosen = None
    for c in (0, 1):
        part = usable.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most twice TRAIN_DOCS rows are broadcast, and that many arrays come to the driver.
    sample = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("label", "text", "id")
    sample = sample.groupBy("id").agg(F.min("label").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text")) if len(shares) == 2 else sample.limit(0)
    rows = map_columns(sample.select("label", "text"), "label int, inputs array<double>, size array<double>, runs array<int>", _sample).collect()
    rows.sort(key=lambda r: (r.label, len(r.size), r.inputs[: 1 + FEATURES]))
    found = {r.label for r in rows}
    if len(found) < 2:
        model.constant = shares.get(1, 0) / total if total else 0.5
        return model
    inputs = np.array([x for r in rows for x in r.inputs], np.float32).reshape(-1, 1 + 3 * FEATURES)
    size = np.array([x for r in rows for x in r.size], np.float32)
    runs, of = np.array([n for r in rows for n in r.runs]), np.repeat(np.arange(len(rows)), [len(r.runs) for r in rows])
    model.fit(inputs, size, np.array([len(r.size) for r in rows]), runs, of, np.array([r.label for r in rows]), shares[1] / total)
    return model


def score(docs: DataFrame, model: LineModel, text: str = "text", name: str = "score") -> DataFrame:
    """Every row of ``docs`` with its score as the column ``name``."""
    at = docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` double"

    def work(batches):
        for columns in batches:
            found, group, size = [], [], 0
            for t in columns[at]:
                group.append(t or "")
                size += len(group[-1])
                if size > BYTES_AT_ONCE:
                    found.append(model.scores(group))
                    group, size = [], 0
            found.append(model.scores(group))
            yield [*columns, np.concatenate(found).tolist()]

    return map_columns(docs, schema, work)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    trimmed = score(docs, model)
    return trimmed.select("doc_id", (fold("doc_id", HELD_OUT) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
