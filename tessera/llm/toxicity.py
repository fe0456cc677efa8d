"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled texts.

A labelled text is a bag of units: words, runs of spaced-out single letters, and windows of very long words. A
toxic text has toxic units, but which ones isn't told, so the machine learns from bags (a
multiple-instance support vector machine after Andrews et al.): by its present values it picks the toxic units of every toxic text and
the most toxic one of every clean text, is trained on these again, and so on until the picks no longer change. The first picks are the
units that set toxic texts apart by their frequency. Each toxic text is trained on again with a letter inserted
at every place of its picked units. A text's score is the calibrated value of its most toxic unit.

All values come from the kernel with the landmarks (units of toxic texts unlike each other, and the clean units nearest to them), in their Nystroem
space, so gapped and inserted forms of a landmark are near it whether or not any text had them.
Words repeat, so each distinct word is compared with the landmarks once a worker.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import string_kernel as sk
from tessera.llm.common import chunks, give_back, read

#: Bounds of the labelled sample: ids of each label, and bytes of their texts that are brought to the driver (further texts of the sample are left out, in the order of the ids' hashes).
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 1000, 5000, 64_000_000
#: How much more frequent in toxic texts than in clean ones a unit of the first picks is at least, and how likely any unit may be one if labels fell by lot.
RATIO, CHANCE = 20, 0.01
#: Landmarks of the Nystroem space: units of toxic texts at most UNLIKE alike, and the NEAR nearest clean units of each; the power the kernel is raised to (a kernel still).
LANDMARKS, UNLIKE, NEAR, POWER = 32, 0.6, 1, 3
#: Rounds of picking and training at most; clean units of the first round (later ones add every clean text's most toxic unit); the penalty of the weights;
#: the weight of the texts with inserted letters against those as they are, and of all clean units against all toxic ones.
ROUNDS, NEGATIVES, RIDGE, FORMS, CLEAN = 8, 4000, 1.0, 2.0, 3.0
THRESHOLD = 0.7
WINDOW = 24
#: Words whose values a worker remembers.
MEMO = 400_000


@dataclass
class Model:
    landmarks: list[str]  # empty: nothing was learnt
    beta: np.ndarray  # weight of the kernel with each landmark
    bias: float
    slope: float
    shift: float

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -40, 40)))


def windows(unit: str) -> list[str]:
    return [unit] if len(unit) <= WINDOW else [unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


def spaced_runs(words: list[str]) -> list[str]:
    """Runs of three or more one-letter words, joined."""
    out, run = [], []
    for w in [*words, ""]:
        one = sk.letters(w) if len(w) <= 3 else ""
        if len(one) == 1:
            run.append(one)
            continue
        if len(run) >= 3:
            out.append(sk.letters("".join(run)))
        run = []
    return out


def units_of(text: str) -> set[str]:
    words = text.lower().split()
    return {u for w in {*map(sk.letters, set(words)), *spaced_runs(words)} if w for u in windows(w)}


def families(bags: list[np.ndarray], names: list[str]) -> np.ndarray:
    """A number for each text (an array of unit numbers); texts that are near copies of each other (three equal minima of hashed units in a band) share one."""
    parent = np.arange(len(bags))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    used = np.unique(np.concatenate([*bags, np.zeros(0, np.int64)]))
    hashed = np.zeros((9, len(names)), np.uint32)
    for u in used.tolist():
        hashed[:, u] = [zlib.crc32(f"{k // 3}{k % 3}{names[u]}".encode()) for k in range(9)]
    seen: dict[tuple, int] = {}
    for i, own in enumerate(bags):
        least = hashed[:, own].min(axis=1).tolist()
        for band in range(3):
            parent[root(i)] = root(seen.setdefault((band, *least[3 * band : 3 * band + 3]), i))
    return np.array([root(i) for i in range(len(bags))])


def first_picks(toxic: list[np.ndarray], clean: np.ndarray, n_clean: int, names: list[str]) -> list[int]:
    """Units RATIO times as frequent in families of near copies of toxic texts as in clean texts (clean: how many have each), too often for CHANCE to give one such unit; the most frequent first."""
    if not toxic:
        return []
    family = families(toxic, names)
    pairs = np.unique(np.repeat(family, [len(b) for b in toxic]) * len(names) + np.concatenate(toxic))
    count = np.bincount(pairs % len(names), minlength=len(names))
    n = len(np.unique(family))
    share = math.log(n / (n + n_clean)), math.log(max(n_clean, 1) / (n + n_clean))
    most = math.log(CHANCE / max(1, int((count > 0).sum())))

    def tells(k: int, c: int) -> bool:
        odds = k * share[0] + c * share[1] + math.lgamma(k + c + 1) - math.lgamma(k + 1) - math.lgamma(c + 1)
        return k * (n_clean + 1) >= RATIO * n * (c + 0.5) and odds <= most

    fit = [u for u in np.flatnonzero(count >= 3).tolist() if len(names[u]) >= 3 and tells(int(count[u]), int(clean[u]))]
    return sorted(fit, key=lambda u: (-count[u], names[u]))


def inserted(unit: str) -> list[str]:
    """The unit with a letter inserted between any two of its own; which letters follows from the unit."""
    draws = [zlib.crc32(f"{k}{unit}".encode()) % 26 for k in range(1, len(unit))]
    return [unit[:k] + "abcdefghijklmnopqrstuvwxyz"[d] + unit[k:] for k, d in enumerate(draws, 1)] or [unit]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Primal support vector machine with squared hinge, by Newton steps on the support vectors with line search. The last weight is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - y * (z @ w)) ** 2).sum() + penalty @ w**2)

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(50):
        support = y * (z @ w) < 1
        a = z[support] * weight[support, None]
        step = np.linalg.solve(np.diag(penalty) + a.T @ z[support], a.T @ y[support]) - w
        scale = 1.0
        while (then := loss(w + scale * step)) > now and scale > 1e-6:
            scale /= 2
        if then > now * (1 - 1e-9):
            break
        w, now = w + scale * step, then
    return w


def _calibrate(value: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with smoothed targets."""
    positive, negative = weight[label > 0].sum(), weight[label == 0].sum()
    target = np.where(label > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x, beta = np.stack([value, np.ones_like(value)], axis=1), np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        s = x @ b
        return float((weight * (np.logaddexp(0, s) - target * s)).sum() + 1e-3 * b[0] ** 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (weight * (p - target)) + np.array([2e-3 * beta[0], 0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-6])
        step, scale = np.linalg.solve(curve, gradient), 1.0
        while loss(beta - scale * step) > loss(beta) and scale > 1e-4:
            scale /= 2
        beta = beta - scale * step
        if abs(scale * step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def _near(against: sk.Landmarks, units: list[str]) -> np.ndarray:
    """The kernel of units with landmarks, raised to POWER, in slices."""
    out = np.empty((len(units), against.weights.shape[1]), np.float32)
    for k in range(0, len(units), 10_000):
        out[k : k + 10_000] = against.kernel(units[k : k + 10_000]) ** POWER
    return out


def _bags(texts: Iterator[tuple[str, int]]) -> tuple[list[str], dict[bool, list[np.ndarray]]]:
    """(names of all units, sorted; for toxic and clean texts their units' numbers). A text that comes with both labels is toxic; texts without units are left out."""
    number: dict[str, int] = {}
    known: dict[bytes, list] = {}
    for text, label in texts:
        key = hashlib.sha256(text.encode()).digest()
        if key not in known:
            units = units_of(text)
            known[key] = [label, np.fromiter((number.setdefault(u, len(number)) for u in units), np.int64, len(units))]
        known[key][0] = max(label, known[key][0])
    names = sorted(number)
    place = np.empty(len(number), np.int64)
    place[np.fromiter(map(number.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
    bags = {kind: [np.sort(place[b]) for _, (label, b) in sorted(known.items()) if bool(label) == kind and len(b)] for kind in (True, False)}
    return names, bags


def fit(texts: list[str], labels: list[int]) -> Model:
    """A Model from labelled texts. Where nothing sets the toxic ones apart (or there are none, or no clean ones with a unit) every score is 0."""
    return fit_rows(zip(texts, labels, strict=True))


def fit_rows(rows: Iterator[tuple[str, int]]) -> Model:
    """fit() of (text, label) rows that need not be in memory together."""
    names, bags = _bags(rows)
    seen = np.bincount(np.concatenate([*bags[False], np.zeros(0, np.int64)]), minlength=len(names))
    found = first_picks(bags[True], seen, len(bags[False]), names)
    if not found or not seen.any():
        return Model([], np.zeros(0), 0.0, 1.0, -40.0)

    taken: list[int] = []  # landmarks of toxic texts, unlike each other
    front = [names[u] for u in found[: 8 * LANDMARKS]]
    alike = sk.Landmarks(front).kernel(front)
    for i in range(len(front)):
        if len(taken) < LANDMARKS and (not taken or alike[i, taken].max() <= UNLIKE):
            taken.append(i)
    distinct = [front[i] for i in taken]
    clean = np.flatnonzero(seen)
    near = _near(sk.Landmarks(distinct), [names[u] for u in clean.tolist()])
    hardest = list(dict.fromkeys(int(clean[i]) for i in np.argsort(-near, axis=0, kind="stable")[:NEAR].ravel().tolist()))
    del near
    landmarks = [*distinct, *(names[u] for u in hardest if names[u] not in distinct)]
    against = sk.Landmarks(landmarks)
    value, vector = np.linalg.eigh(against.kernel(landmarks).astype(float) ** POWER)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-4))) @ vector.T

    kernel = _near(against, names)  # float32, a row for each distinct unit of the sample
    lists = {label: np.concatenate(bags[label]) for label in bags}
    sizes = {label: np.array([len(b) for b in bags[label]]) for label in bags}
    edges = {label: np.cumsum(sizes[label]) - sizes[label] for label in bags}
    bag = np.repeat(np.arange(len(sizes[True])), sizes[True])
    first = np.zeros(len(names), bool)
    first[found] = True
    may = (first | (seen == 0))[lists[True]]  # what may be picked of the toxic texts' units: first picks, and what no clean text has
    picked = first[lists[True]]
    hard = {u for u in [*hardest, *clean[:: -(-len(clean) // NEGATIVES)].tolist()] if not first[u]}
    model, forms, share = Model(landmarks, np.zeros(0), 0.0, 1.0, 0.0), np.zeros((0, len(landmarks))), np.zeros(0)
    positive = negative = np.zeros(0)
    for _ in range(ROUNDS):
        weigh = np.zeros(len(names))  # a text's picks share its weight of one
        np.add.at(weigh, lists[True][picked], 1 / np.bincount(bag[picked], minlength=len(sizes[True]))[bag[picked]])
        own, low = np.flatnonzero(weigh), np.array(sorted(hard))
        each = [inserted(names[p]) for p in own.tolist()]
        forms, count = _near(against, [f for e in each for f in e]), np.array([len(e) for e in each])
        share = np.repeat(weigh[own] / count, count)
        rows_ = np.concatenate([kernel[own], forms, kernel[low]]) @ root
        y = np.array([1.0] * (len(own) + len(forms)) + [-1.0] * len(low))
        w = _svm(rows_, y, np.concatenate([weigh[own], FORMS * share, np.full(len(low), CLEAN * (1 + FORMS) * share.sum() / len(low))]), RIDGE)
        model.beta, model.bias = root @ w[:-1], float(w[-1])
        values = (kernel @ model.beta.astype(np.float32)).astype(float) + model.bias
        positive, negative = (np.maximum.reduceat(values[lists[label]], edges[label]) for label in (True, False))
        before, picked = picked, may & (values[lists[True]] > 0)
        top = {int(b[np.argmax(values[b])]) for b in bags[False]}
        if not picked.any() or (before == picked).all() and hard.issuperset(top):
            break
        hard |= top
    changed = forms.astype(float) @ model.beta + model.bias
    peaks = np.concatenate([positive, negative, changed])
    label = np.array([1] * len(positive) + [0] * len(negative) + [1] * len(changed))
    model.slope, model.shift = _calibrate(peaks, label, np.concatenate([np.ones(len(positive) + len(negative)), FORMS * share]))
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.table = model, None
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)  # hashes of words, sorted, and their values

    def units(self, units: list[str]) -> np.ndarray:
        if self.table is None:
            self.table = sk.Landmarks(self.model.landmarks)
        parts = [(self.table.kernel(units[k : k + 10_000]).astype(float) ** POWER) @ self.model.beta for k in range(0, len(units), 10_000)]
        return np.concatenate([*parts, np.zeros(0)]) + self.model.bias

    def best(self, units: set[str]) -> float:
        return float(self.units(sorted(units)).max()) if units else self.model.bias

    def words(self, words: list[str]) -> np.ndarray:
        """The most toxic unit's value of each distinct lower-case word, remembered by the word's 64-bit hash."""
        key = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == key[inside]
        out = np.empty(len(key))
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            parts = [windows(sk.letters(words[k])) for k in new.tolist()]
            value = self.units([u for p in parts for u in p])
            out[new] = np.maximum.reduceat(value, np.cumsum([0, *map(len, parts)])[:-1])
            if len(self.keys) + len(new) > MEMO:
                self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)
            keys, first = np.unique(np.concatenate([self.keys, key[new]]), return_index=True)
            self.keys, self.values = keys, np.concatenate([self.values, out[new]])[first]
        return out

    def texts(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        if not self.model.landmarks:
            return np.zeros(n)
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
        starts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        value = np.append(self.words(names)[code], self.model.bias)
        peak = np.full(n, self.model.bias)
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            peak[some] = np.maximum.reduceat(value, starts[some])
        single = np.array([len(w) <= 3 and len(sk.letters(w)) == 1 for w in names], bool)[code]
        three = np.flatnonzero(single[:-2] & single[1:-1] & single[2:]) if len(single) > 2 else []
        for row in np.unique(np.searchsorted(starts, three, side="right") - 1).tolist():
            runs = spaced_runs([names[c] for c in code[starts[row] : starts[row + 1]].tolist()])
            peak[row] = max([peak[row], *(self.best(set(windows(r))) for r in runs)])
        return self.model.probability(peak)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on at most TRAIN_TOXIC and TRAIN_CLEAN labelled ids (smallest hashes; an id's rows all count) and TRAIN_BYTES of their texts, never on held-out rows.

    An id with several labels is toxic if one says so. Null labels, ids and texts teach nothing; a text that comes twice teaches once. Without labelled rows every score is 0.
    """
    own = labels.where(F.col(label).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_label"))
    own = own.withColumn("_order", F.xxhash64("_id"))
    picked = [own.where(F.col("_label") == mark).orderBy("_order", "_id").limit(most) for mark, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most TRAIN_TOXIC + TRAIN_CLEAN ids
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull()).join(chosen, "_id")
    ordered = rows.select("_text", "_label", "_order").orderBy("_order", F.xxhash64("_text"))

    def sample() -> Iterator[tuple[str, int]]:
        size = 0
        for r in ordered.toLocalIterator():
            size += len(r["_text"].encode())
            if size > TRAIN_BYTES:
                return
            yield r["_text"], r["_label"]

    model = fit_rows(sample())
    give_back()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 (a column of that name must not be there). Reads the text alone, so rows repeated score the same; null texts count as empty, and an empty text has no toxic unit."""
    if column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {column} already")
    scorer = Scorer(model)

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            batch = pa.RecordBatch.from_arrays([texts], ["text"])
            yield pa.array(np.concatenate([scorer.texts(part.column(0)) for part in chunks(batch, 0, 1_500_000)] or [np.zeros(0)]))
        scorer.__init__(model)
        give_back()

    return docs.withColumn(column, scored(F.col(text)))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Null ids are never held out; a null or empty text gets the score of a text without units."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
