"""Toxicity: bags of subword embeddings averaged into a linear softmax."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.batches import SPACE, Remembered, recalled, slices, word_runs, whole_texts

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
BAG = 8  # words
CACHE_BYTES = 24 << 20  # of the words that a task remembers
LEAST_STEPS = 20  # of each round of training, however few texts there are
#: Rows of either label that training reads at most.  They are bounded so that the model can be fitted by one process.
MOST_TOXIC, MOST_CLEAN = 2500, 4000
#: Bags of either class in a training epoch over all bags, drawn anew for each; later rounds see one bag of every text.
MOST_BAGS = 40_000


def split_words(text: str) -> list[str]:
    """Words between ASCII white space, in lower case."""
    return [w.decode("utf-8", "surrogatepass").lower() for w in text.encode("utf-8", "surrogatepass").split()]


def subwords(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """``_subwords`` of many words, some at a time."""
    parts = [_subwords(words[a : a + at_once]) for a in range(0, len(words), at_once)] or [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))]
    return np.concatenate([g for g, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])


def _subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, and how many each word has.

    A word stands between marks for its start and end, so every word has at least
    one n-gram.  N-grams are hashed for all words at once by a rolling sum.
    """
    data = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.repeat(np.cumsum(sizes), sizes)  # of the word that a character belongs to
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data))
    owners, buckets = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + data[k : len(data) - n + 1 + k]
            h ^= h >> np.uint64(29)
        inside = place[: len(h)] + n <= ends[: len(h)]
        owners.append(word[: len(h)][inside])
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int32))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(words))


class Bags:
    """Training state: subword embeddings and a two-class softmax, both fitted by Adagrad."""

    def __init__(self, dim: int = 12, rate: float = 0.3, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = np.zeros((BUCKETS, dim), dtype=np.float32)  # subwords that training never sees say nothing
        self.out = ((r.random((dim, 2)) - 0.5) * 0.6).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.rate, self.dim = rate, dim
        self.seen = [np.full(BUCKETS, 1e-6, dtype=np.float32), np.full((dim, 2), 1e-6, dtype=np.float32), np.full(2, 1e-6, dtype=np.float32)]

    def step(self, grams: np.ndarray, owner: np.ndarray, share: np.ndarray, labels: np.ndarray) -> None:
        """One step on bags: bag b is the mean of its words' means; ``share`` is the weight of each subword in its bag ``owner``."""
        hidden = np.zeros((len(labels), self.dim), dtype=np.float32)
        rows = self.table[grams] * share[:, None]
        for d in range(self.dim):
            hidden[:, d] = np.bincount(owner, rows[:, d], minlength=len(labels))
        logits = hidden @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p /= len(labels) ** 0.5
        back = (p @ self.out.T)[owner] * share[:, None]
        for param, grad, seen in ((self.out, hidden.T @ p, self.seen[1]), (self.bias, p.sum(axis=0), self.seen[2])):
            seen += grad**2
            param -= self.rate * grad / np.sqrt(seen)
        used, at = np.unique(grams, return_inverse=True)
        grad = np.stack([np.bincount(at, back[:, d], minlength=len(used)) for d in range(self.dim)], axis=1).astype(np.float32)
        self.seen[0][used] += (grad**2).mean(axis=1)
        self.table[used] -= self.rate * grad / np.sqrt(self.seen[0][used])[:, None]

    def weights(self) -> np.ndarray:
        """What each bucket adds to the log odds of the toxic class when it is the whole bag."""
        return self.table @ (self.out[:, 1] - self.out[:, 0])


def word_odds(words: list[str], weights: np.ndarray) -> np.ndarray:
    grams, starts = subwords(words)
    return np.add.reduceat(weights[grams], starts[:-1]) / np.diff(starts)


def best_bags(odds: np.ndarray, counts: np.ndarray, size: int = BAG) -> tuple[np.ndarray, np.ndarray]:
    """(mean, first word) of the bag of ``size`` neighbouring words with the highest
    mean log odds in each text; a shorter text is one bag, an empty one has mean 0."""
    ends = np.cumsum(counts)
    starts = ends - counts
    total = np.concatenate([[0.0], np.cumsum(odds, dtype=np.float64)])
    first = np.arange(len(odds))
    owner = np.repeat(np.arange(len(counts)), counts)
    width = np.minimum(size, counts)[owner]
    fits = first + width <= ends[owner]
    mean = np.where(fits, (total[np.minimum(first + width, len(odds))] - total[first]) / np.maximum(width, 1), -np.inf)
    best, at = np.zeros(len(counts)), starts.copy()
    full = np.flatnonzero(counts)
    if len(full):
        best[full] = np.maximum.reduceat(mean, starts[full])
        hit = np.flatnonzero(mean == np.repeat(best, counts))
        at[owner[hit][::-1]] = hit[::-1]
    return best, at - starts


def train(texts: list[str], labels: np.ndarray, *, epochs: int = 2, rounds: int = 4, seed: int = 7) -> dict:
    """Weights of the buckets and the two numbers that turn the best bag's log odds into a probability.

    First all bags of balanced classes carry their text's label; then, in rounds,
    only each text's best bag does, so the toxic words of a long text count in
    full and clean texts correct their most suspicious bag.
    """
    r, model = np.random.default_rng(seed), Bags(seed=seed)
    vocab: dict[str, int] = {}
    ids = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in split_words(t)), dtype=np.int32) for t in texts]
    if not vocab or len(set(labels.tolist())) < 2:
        return {"weights": np.zeros(BUCKETS, dtype=np.float32), "scale": 1.0, "shift": float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))}
    grams, starts = subwords(list(vocab))
    del vocab, texts
    flat, counts = np.concatenate(ids), np.array([len(x) for x in ids])
    offset = np.cumsum(counts) - counts

    def learn(first: np.ndarray, text: np.ndarray, batch: int = 256) -> None:
        passes = -(-LEAST_STEPS * batch // max(len(first), 1))
        order = np.concatenate([r.permutation(len(first)) for _ in range(max(1, min(passes, LEAST_STEPS)))])
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            width = np.minimum(BAG, offset[text[some]] + counts[text[some]] - first[some])
            bag = np.repeat(np.arange(len(some)), width)
            words = flat[np.repeat(first[some] - (np.cumsum(width) - width), width) + np.arange(width.sum())]
            n = starts[words + 1] - starts[words]
            inside = np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            share = (1.0 / (n * width[bag])).repeat(n).astype(np.float32)
            model.step(grams[inside], bag.repeat(n), share, labels[text[some]])

    bags = -(-counts // BAG)
    text = np.repeat(np.arange(len(counts)), bags)
    first = offset[text] + BAG * (np.arange(bags.sum()) - np.repeat(np.cumsum(bags) - bags, bags))
    toxic, clean = np.flatnonzero(labels[text] == 1), np.flatnonzero(labels[text] == 0)
    n = min(len(toxic), len(clean), MOST_BAGS)
    for _ in range(epochs):
        some = np.concatenate([r.choice(toxic, n, replace=False), r.choice(clean, n, replace=False)])
        learn(first[some], text[some])
    def strongest() -> tuple[np.ndarray, np.ndarray]:
        odds = np.add.reduceat(model.weights()[grams], starts[:-1]) / np.diff(starts)
        found = [best_bags(odds[flat[offset[a] : offset[a] + counts[a : a + 200].sum()]], counts[a : a + 200]) for a in range(0, len(counts), 200)]
        return np.concatenate([b for b, _ in found]), np.concatenate([at for _, at in found])

    full = np.flatnonzero(counts)
    for _ in range(rounds):
        _, at = strongest()
        learn(offset[full] + at[full], full)
    best, _ = strongest()
    scale, shift = _calibrated(best, labels)
    return {"weights": model.weights().astype(np.float32), "scale": scale, "shift": shift}


def _calibrated(best: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the best bag's log odds, classes weighted
    equally.  A bag of unseen subwords, of log odds 0, counts as clean, as much as the clean class."""
    best, labels = np.append(best, 0.0), np.append(labels, 0)
    spread = best.std() or 1.0
    x, y = (best - best.mean()) / spread, labels.astype(float)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.25 / max((1 - y).sum() - 1, 1))
    weight[-1] = 0.25
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p)
        grad = np.array([(g * x).sum() + 1e-4 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-4, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
    return a / spread, b - a * best.mean() / spread


def held_out(id_col: str):
    """Rows whose labels training never reads: crc32(id) mod 3 is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Fits on at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled rows outside the
    held-out part, those of the least hash of the id.  Whole texts are searched for
    their strongest bag; an epoch over all bags trains on at most ``MOST_BAGS`` of
    either class.  Only text and label enter.  Labels for unknown or null ids count for nothing."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).where(~held_out("_id"))
    some = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    chosen = F.broadcast(some[0].unionByName(some[1]))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(chosen, "_id").select("_id", "_t", "_y").collect()
    rows.sort(key=lambda r: (r["_id"], r["_t"], r["_y"]))
    labels_of = np.array([r["_y"] for r in rows], dtype=np.int64)
    texts = [r["_t"] for r in rows]
    del rows
    return train(texts, labels_of)


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the probability of a toxic text, from its most toxic bag
    of ``BAG`` words.  Null and empty texts get the probability of a bag without
    evidence; all columns stay, one named like ``out`` is replaced."""
    rows = whole_texts(docs).drop(out)
    weights, scale, shift = model["weights"], model["scale"], model["shift"]
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS floats
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def odds_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        names = [w.lower() for w in words.cast(pa.string()).to_pylist()]
        found = word_odds(names, shared.value) if names else np.zeros(0)
        return found.astype(np.float32).view(np.uint32), np.ones(len(names), dtype=np.int64)

    def run(batches):
        cache = Remembered()
        for part in slices(batches, text_col):
            words, index, counts = word_runs(part.column(text_col), SPACE)
            odds, _ = recalled(cache, words, odds_of, CACHE_BYTES)
            best, _ = best_bags(odds.astype(np.uint32).view(np.float32).astype(np.float64)[index], counts)
            p = 1 / (1 + np.exp(-np.clip(scale * best + shift, -60, 60)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, out])

    return rows.mapInArrow(run, f"{kinds}, `{out}` double")


def reject(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more."""
    names = docs.columns
    slim = docs.withColumnRenamed("_toxicity", "_toxicity_in") if "_toxicity" in names else docs
    kept = score(slim, fit(docs, labels, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col, out="_toxicity").where(F.col("_toxicity") < threshold).drop("_toxicity")
    return kept.toDF(*names)
