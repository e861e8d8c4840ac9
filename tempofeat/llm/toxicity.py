"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Strings are compared by their common subsequences of three characters, which
may have gaps: each counts with a decay for the span it covers, so an insult
with inserted characters stays close to the plain one. Landmark strings give the
kernel a finite feature space, in which a linear support vector machine is
trained. A text is judged by its few worst strings, its sentences having only
labels as wholes: training alternates between choosing in each toxic text the string
that speaks most for it, in each clean text the one that speaks most against
it, and fitting the machine to these.

A trained machine folds into one number per subsequence, so that scoring needs
no kernel against each landmark. Each distinct string of a batch is scored once
and kept in a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofeat.llm.quality_classifier import held_out, labelled_sample, one_each
from tempofeat.llm.shared import small_batches

SPAN, DECAY = 5, 0.8
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_WEIGHTS = np.array([DECAY ** (b + 1) for _, b in _OFFSETS])
_LOW = (len(_OFFSETS) - 1).bit_length()
_MARKS = re.compile(r"[\W_]+")
WORST = 4  # strings of a text that decide
LONGEST = 64  # longer strings are compared in overlapping parts
PARTS = (10, 20, 40)  # their lengths, a step a fifth: an insult of up to 32 characters is whole in one that it mostly fills


def strings(text: str | None) -> list[str]:
    """The strings of a text: its words, and each run of three or more one-letter words joined; long ones in parts."""
    words = (text or "").lower().split()
    letters = [i for i, w in enumerate(words) if len(w) == 1]
    joined, begin = [], 0
    for k in range(1, len(letters) + 1):
        if k == len(letters) or letters[k] != letters[k - 1] + 1:
            if k - begin > 2:
                joined.append("".join(words[letters[begin] : letters[k - 1] + 1]))
            begin = k
    words += joined
    return words if max(map(len, words), default=0) <= LONGEST else [p for w in words for p in parts(w)]


def parts(word: str) -> list[str]:
    """The word, or of a long one the pieces between marks and overlapping parts of all without marks."""
    if len(word) <= LONGEST:
        return [word]
    pieces = _MARKS.sub(" ", word).split()
    bare = "".join(pieces)
    if len(bare) <= LONGEST:
        return [word]
    windows = [bare[k : k + n] for n in PARTS for k in range(0, len(bare) - n + n // 5, n // 5)]
    return [p for p in pieces if len(p) <= LONGEST] + windows


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which word, which subsequence (a key), and its decayed weight; each pair once."""
    framed = ["\x02\x02" + _MARKS.sub("", w) + "\x03" for w in words]
    data = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    size = np.array([len(w) for w in framed], dtype=np.int64)
    word = np.repeat(np.arange(len(framed)), size)
    alphabet, place = np.unique(data, return_inverse=True)
    bits = max(1, (len(alphabet) - 1).bit_length())
    if 3 * bits + (len(framed) - 1).bit_length() + _LOW > 63:  # a very large alphabet: fewer words at a time
        half = len(words) // 2
        if half:
            one, two = subsequences(words[:half]), subsequences(words[half:])
            return np.concatenate([one[0], two[0] + half]), np.concatenate([one[1], two[1]]), np.concatenate([one[2], two[2]])
    # owner, three characters and the gaps in one number: sorted by value, no order to carry along
    codes = [np.zeros(0, dtype=np.int64)]
    for gaps, (a, b) in enumerate(_OFFSETS):
        n = max(0, len(data) - b)
        own = np.flatnonzero(word[:n] == word[b:])
        code = (((word[own] << bits | place[own]) << bits | place[own + a]) << bits) | place[own + b]
        codes.append(code << _LOW | gaps)
    code = np.sort(np.concatenate(codes))
    if not len(code):
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)
    same = code >> _LOW
    first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    weight = np.add.reduceat(_WEIGHTS[code & (1 << _LOW) - 1], first)
    same, mask = same[first], (1 << bits) - 1
    x, y, z = (alphabet[same >> k * bits & mask] for k in (2, 1, 0))
    return same >> 3 * bits, x << 42 | y << 21 | z, weight


def kernel(words: list[str], landmarks: list[str], part: int = 2000) -> np.ndarray:
    """Normalised kernel of each word with each landmark."""
    mark, key, weight = subsequences(landmarks)
    known, at = np.unique(key, return_inverse=True)
    table = np.zeros((len(known), len(landmarks)))
    table[at, mark] = weight
    table /= np.sqrt((table**2).sum(0)) + 1e-12
    out = np.zeros((len(words), len(landmarks)))
    for k in range(0, len(words), part):
        owner, key, weight = subsequences(words[k : k + part])
        norm = np.sqrt(np.bincount(owner, weights=weight**2, minlength=len(words[k : k + part]))) + 1e-12
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[place] == key
        dense = np.zeros((len(norm), len(known)), dtype=np.float32)
        dense[owner[hit], place[hit]] = weight[hit]
        out[k : k + part] = (dense @ table.astype(np.float32)) / norm[:, None]
    return out


@dataclass
class Machine:
    """One number per subsequence, an offset, and weights from worst margins to scores."""

    keys: np.ndarray
    values: np.ndarray
    bias: float
    weights: np.ndarray | None = None

    def margins(self, words: list[str], part: int = 20_000) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for k in range(0, len(words) if len(self.keys) else 0, part):
            own = words[k : k + part]
            owner, key, weight = subsequences(own)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            value = np.where(self.keys[place] == key, self.values[place], 0.0)
            norm = np.sqrt(np.bincount(owner, weights=weight**2, minlength=len(own))) + 1e-12
            out[k : k + part] += np.bincount(owner, weights=weight * value, minlength=len(own)) / norm
        return out

    def score(self, tops: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(tops @ self.weights[:-1] + self.weights[-1], -40, 40)))


def solve(words: list[str], labels: np.ndarray, weigh: np.ndarray, landmarks: list[str], penalty: float) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge) in the Nystroem space of the landmarks:
    the weight of the kernel with each landmark, and the offset."""
    inner = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.hstack([kernel(words, landmarks) @ root, np.ones((len(words), 1))])
    y, w = np.where(labels == 1, 1.0, -1.0), np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(30):  # Newton steps on the primal
        inside = y * (x @ w) < 1
        a, c = x[inside], weigh[inside]
        new = np.linalg.solve(a.T @ (a * c[:, None]) + np.diag(ridge), a.T @ (c * y[inside]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return root @ w[:-1], float(w[-1])


def folded(beta: np.ndarray, bias: float, landmarks: list[str]) -> Machine:
    """The sum of all weighted kernels as one number per subsequence."""
    mark, key, weight = subsequences(landmarks)
    norm = np.sqrt(np.bincount(mark, weights=weight**2, minlength=len(landmarks))) + 1e-12
    keys, at = np.unique(key, return_inverse=True)
    return Machine(keys, np.bincount(at, weights=weight * (beta / norm)[mark], minlength=len(keys)), bias)


def inserted(word: str, rng: np.random.Generator) -> str:
    """The word with one of its characters, or any of a few, put in somewhere."""
    at, new = int(rng.integers(1, len(word) + 1)), (word + "xaeiou")[int(rng.integers(len(word) + 6))]
    return word[:at] + new + word[at:]


def train(texts: list[list[str]], labels: np.ndarray, *, landmarks: int = 512, rounds: int = 4, variants: int = 1, penalty: float = 0.01, seed: int = 3) -> Machine:
    """A machine from the strings of labelled texts, with its scores calibrated."""
    prior = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    nothing = Machine(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0, np.append(np.zeros(WORST), prior))
    if not labels.any() or labels.all():
        return nothing
    vocabulary = sorted({s for t in texts for s in t})
    number = {s: i for i, s in enumerate(vocabulary)}
    ids = [np.array(sorted({number[s] for s in t}), dtype=np.int64) for t in texts]
    toxic, clean = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    for own, label in zip(ids, labels, strict=True):
        (toxic if label else clean)[own] += 1
    # before any machine: strings in many toxic and few clean texts speak for toxicity
    share = labels.sum() / max(1, len(labels) - labels.sum())
    margin = np.log1p(toxic) * (toxic - 2 * share * clean) / (toxic + 2 * share * clean + 1)
    rng, made = np.random.default_rng(seed), nothing
    bags = [(own, label) for own, label in zip(ids, labels, strict=True) if len(own)]
    for _ in range(rounds):
        pick = np.array([own[np.argmax(margin[own])] for own, _ in bags])
        y = np.array([label for _, label in bags])
        # each toxic text one witness; each clean text its worst string and some others
        other = np.concatenate([rng.choice(own, min(4, len(own)), replace=False) for own, label in bags if not label])
        who = np.concatenate([pick, other])
        lab = np.concatenate([y, np.zeros(len(other), dtype=y.dtype)])
        strings_, count = np.unique(who * 2 + lab, return_counts=True)
        lab, who = strings_ % 2, strings_ // 2
        weigh = np.where(lab == 1, count / count[lab == 1].sum(), count / count[lab == 0].sum()) * 1000
        most = who[lab == 1][np.argsort(-count[lab == 1], kind="stable")][: landmarks // 2]
        worst = np.unique(pick[y == 0])
        worst = worst[np.argsort(-margin[worst], kind="stable")][: landmarks // 4]
        some = rng.choice(np.unique(other), min(landmarks // 4, len(np.unique(other))), replace=False)
        seen = [vocabulary[i] for i in who]
        more = [(inserted(seen[i], rng), i) for i in np.flatnonzero(lab == 1) for _ in range(variants)]
        who_text, lab, weigh = seen + [v for v, _ in more], np.concatenate([lab, np.ones(len(more), dtype=lab.dtype)]), np.concatenate([weigh, *([weigh[i] * 0.2] for _, i in more)])
        marks = [vocabulary[i] for i in dict.fromkeys([*most, *worst, *some])]
        made = folded(*solve(who_text, lab, weigh, marks, penalty), marks)
        margin = made.margins(vocabulary)
    tops = np.stack([highest(margin[own], made.bias) for own, _ in bags])
    made.weights = calibrated(tops, np.array([label for _, label in bags]))
    return made


def highest(margins: np.ndarray, bias: float) -> np.ndarray:
    """The WORST highest of the margins of a text's strings, falling, clipped to [-3, 3]."""
    if len(margins) < WORST:
        margins = np.concatenate([margins, np.full(WORST - len(margins), bias)])
    return np.clip(np.sort(np.partition(margins, -WORST)[-WORST:])[::-1], -3, 3)


def calibrated(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights of the worst margins and an offset, by damped Newton steps."""
    x, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.append(np.full(x.shape[1] - 1, 0.1), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (labels - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
    return w


class Scorer:
    """Scores of texts by their worst strings, with a bounded cache of margins."""

    def __init__(self, model: Machine, most: int = 300_000):
        self.model, self.most, self.known = model, most, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        found = [strings(t) for t in texts]
        new = list(set().union(*found) - self.known.keys())
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(set().union(*found))
        self.known.update(zip(new, self.model.margins(new).tolist(), strict=True))
        get = self.known.__getitem__
        tops = [highest(np.fromiter(map(get, p), dtype=float, count=len(p)), self.model.bias) for p in map(set, found)]
        return self.model.score(np.stack(tops)) if tops else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 4, fold: int = 2, sample: int = 6000, **how) -> Machine:
    """A machine from at most `sample` labelled documents outside the fold, one for each id.

    docs: doc_id and text; other columns are ignored, null and empty texts have
    no strings, labels without a document have no part. Whole texts count; their distinct strings come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ["\n".join(sorted(set(strings(t.as_py())))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), pa.array(found, pa.string()), b.column("_label")], ["doc_id", "strings", "label"])

    rows = one_each(labelled_sample(docs, labels, label, folds, fold, sample).mapInArrow(run, "doc_id string, strings string, label int")).toArrow().to_pylist()
    return train([r["strings"].split() for r in rows], np.array([r["label"] for r in rows], dtype=np.int64), **how)


def scored(docs: DataFrame, model: Machine, text_col: str = "text", out: str = "score", part: int = 256) -> DataFrame:
    """docs with a score in [0, 1]; a text without strings gets the machine's offset.

    Repeated rows score alike; null texts count as empty; very long ones count
    whole; other columns stay, but one of the score's name is replaced; an empty
    table gives no rows."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # subsequences of the landmarks: bounded by their number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Scorer(shared.value)
        for b in batches:
            texts = b.column(text_col)
            scores = [judge(texts[k : k + part].to_pylist()) for k in range(0, len(texts), part)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*b.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0.0)).schema)


def op5_string_kernel_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = scored(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
