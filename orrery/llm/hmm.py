"""A hidden Markov language model, trained by Baum-Welch over all partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.batches import LOWER, SPACE, lists, release, slices, word_runs, whole_texts
from orrery.session import staged

#: Words with a symbol of their own; all others share one.  The bound keeps the model within 3 MB for each task;
#: on sf0.1 held-out log10 per token is -3.962 with 2^13 symbols, -3.886 with 2^15 and -3.871 with 2^17.
SYMBOLS = 1 << 17
STATES = 6
PASSES = 6  # Baum-Welch passes over the whole training part, at most
SETTLED = 0.02  # passes end when one gains less than this per token, in log10; on sf0.1 they gain 0.257, 0.012, 0.004, 0.001
SEED_ROWS = 400  # whose sequences give the first guess of the parameters
SEED_PASSES = 25
SLICE_TOKENS = 400_000
COUNTED_AT_ONCE = 400_000  # distinct words that a task holds before it hands counts on
END = b""  # after the last word of a text
SMOOTH = 0.1


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space, ASCII letters in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, c over all rows, an end for each row included.  Tasks count what they
    read and hand on partial counts whenever they hold many words."""
    def out(held):
        words = pa.table({"word": pa.chunked_array([w for w, _ in held], pa.binary()), "n": pa.chunked_array([n for _, n in held], pa.int64())})
        return words.group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches()

    def run(batches):
        held, size = [], 0
        for part in slices(batches, text_col):
            words, index, _ = word_runs(part.column(text_col), SPACE, LOWER)
            held += [(words, pa.array(np.bincount(index, minlength=len(words)))), (pa.array([END], pa.binary()), pa.array([part.num_rows], pa.int64()))]
            size += len(words) + 1
            if size > COUNTED_AT_ONCE:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """(words, counts) of the words of the highest counts, most frequent first: all down to
    the least count that leaves at most ``most``.  Only a histogram of counts and
    the words themselves reach the driver."""
    words = counts.where(F.col("word") != F.lit(END))
    least, taken, cut = None, 0, None
    step = F.floor(F.log2("c") * 16)  # sixteen steps for each doubling of a count
    for r in sorted(words.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r["s"]):
        if taken + r["n"] > most:
            cut = r["least"]
            break
        least, taken = r["least"], taken + r["n"]
    if cut is not None:  # the step in which the bound falls, by single counts
        inside = words.where((F.col("c") >= cut) & (F.col("c") < (least if least is not None else (1 << 62))))
        for r in sorted(inside.groupBy("c").count().collect(), key=lambda r: -r["c"]):
            if taken + r["count"] > most:
                break
            least, taken = r["c"], taken + r["count"]
    if least is None:
        return [], np.zeros(0, dtype=np.int64)
    top = words.where(F.col("c") >= least).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    return top.column("word").to_pylist(), top.column("c").to_numpy()


class Sequences:
    """Symbol sequences of several texts, laid out by time: at each time those of
    the texts that are not yet over, longest text first."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        lens = lengths[self.order]
        starts = (np.cumsum(lengths) - lengths)[self.order]
        self.active = np.searchsorted(-lens, -np.arange(int(lens[0]) if len(lens) else 0), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        text = np.repeat(np.arange(len(lens)), lens)
        time = np.arange(len(text)) - np.repeat(np.cumsum(lens) - lens, lens)
        self.symbols = np.empty(len(text), dtype=np.int64)
        self.text = np.empty(len(text), dtype=np.int64)
        at = self.offset[time] + text
        self.symbols[at] = ids[starts[text] + time]
        self.text[at] = text

    def forward(self, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(emissions, state probabilities, scale of each symbol): the scales' product is the likelihood."""
        emit = model["emit"][self.symbols]
        alpha, scale = np.empty_like(emit), np.empty(len(emit), dtype=emit.dtype)
        prior = np.broadcast_to(model["start"], (len(emit[: self.active[0]]) if len(self.active) else 0, emit.shape[1]))
        for t, n in enumerate(self.active):
            a = self.offset[t]
            if t:
                prior = alpha[self.offset[t - 1] : self.offset[t - 1] + n] @ model["move"]
            joint = prior * emit[a : a + n]
            s = joint.sum(axis=1)
            scale[a : a + n] = s
            np.divide(joint, s[:, None], out=alpha[a : a + n])
        return emit, alpha, scale

    def log10(self, model: dict) -> np.ndarray:
        """log10 likelihood of each text, in the order given."""
        out = np.zeros(len(self.order))
        out[self.order] = np.bincount(self.text, np.log10(self.forward(model)[2]), minlength=len(self.order))
        return out

    def expected(self, model: dict, emit_sum: np.ndarray, move_sum: np.ndarray, start_sum: np.ndarray) -> float:
        """Adds the expected counts of emissions, moves and starts; returns the log10 likelihood."""
        emit, alpha, scale = self.forward(model)
        if not len(emit):
            return 0.0
        emit /= scale[:, None]  # with beta: what each symbol says of its state
        beta, back = np.ones_like(emit), np.ascontiguousarray(model["move"].T)
        for t in range(len(self.active) - 2, -1, -1):
            n, a, b = self.active[t + 1], self.offset[t], self.offset[t + 1]
            emit[b : b + n] *= beta[b : b + n]
            np.matmul(emit[b : b + n], back, out=beta[a : a + n])
        n = self.active[0]
        later = np.arange(n, len(emit))
        time = np.repeat(np.arange(len(self.active)), self.active)[n:]
        move_sum += (alpha[later - self.active[time - 1]].T @ emit[n:]) * model["move"]
        alpha *= beta  # now the probability of each state given the whole text
        start_sum += alpha[:n].sum(axis=0)
        for k in range(alpha.shape[1]):
            emit_sum[:, k] += np.bincount(self.symbols, alpha[:, k], minlength=len(emit_sum))
        return float(np.log10(scale).sum())


def _normal(emit_sum, move_sum, start_sum, share: np.ndarray) -> dict:
    """Parameters from expected counts; emissions lean on the words' overall shares as by 50 further symbols."""
    emit = emit_sum + 50 * share[:, None]
    move, start = move_sum + 0.5, start_sum + 0.5
    return {"emit": emit / emit.sum(axis=0), "move": move / move.sum(axis=1, keepdims=True), "start": start / start.sum()}


def _single(model: dict) -> dict:
    return {k: v.astype(np.float32) for k, v in model.items()}


def first_guess(sequences: list[np.ndarray], share: np.ndarray, states: int, passes: int, seed: int = 11) -> dict:
    """Parameters after ``passes`` rounds over a few sequences, from noisy overall shares and states that tend to stay."""
    r = np.random.default_rng(seed)
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    noisy = share[:, None] * r.uniform(0.5, 1.5, (len(share), states))
    model = {"emit": noisy / noisy.sum(axis=0), "move": move / move.sum(axis=1, keepdims=True), "start": np.full(states, 1 / states)}
    lengths = np.array([len(x) for x in sequences], dtype=np.int64)
    if not lengths.sum():
        return model
    seqs = Sequences(np.concatenate(sequences), lengths)
    for _ in range(passes):
        sums = np.zeros((len(share), states)), np.zeros((states, states)), np.zeros(states)
        seqs.expected(_single(model), *sums)
        model = _normal(*sums, share)
    return model


def sequence_slices(batches, most: int = SLICE_TOKENS):
    """(slice, ids, lengths) with at most ``most`` ids, or one row."""
    for batch in batches:
        ids = batch.column("ids")
        lengths = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        part = np.cumsum(lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                piece = batch.slice(a, b - a)
                yield piece, piece.column("ids").flatten().to_numpy().astype(np.int64), lengths[a:b]


def baum_welch_pass(encoded: DataFrame, model: dict, share: np.ndarray) -> tuple[dict, float]:
    """(new parameters, log10 likelihood under the old ones) from the expected counts
    of all sequences: each task sums its own, and one row for each symbol is
    added up over the tasks."""
    states = model["emit"].shape[1]
    shared = encoded.sparkSession.sparkContext.broadcast(_single(model))  # SYMBOLS x states
    names = [f"k{k}" for k in range(states)]

    def run(batches):
        sums, likely = (np.zeros((len(share), states)), np.zeros((states, states)), np.zeros(states)), 0.0
        for _, ids, lengths in sequence_slices(batches):
            likely += Sequences(ids, lengths).expected(shared.value, *sums)
        release()
        seen = np.flatnonzero(sums[0].any(axis=1))
        rows = np.concatenate([sums[0][seen], sums[1], sums[2][None], np.full((1, states), likely)])
        key = np.concatenate([seen, -1 - np.arange(states + 2)])
        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(rows[:, k].copy()) for k in range(states))], names=["symbol", *names])

    kinds = "symbol long, " + ", ".join(f"{n} double" for n in names)
    sums = encoded.select("ids").mapInArrow(run, kinds).groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    shared.unpersist()
    key, rows = sums.column("symbol").to_numpy(), np.stack([sums.column(n).to_numpy() for n in names], axis=1) if len(sums) else np.zeros((0, states))
    emit, move, start, likely = np.zeros((len(share), states)), np.zeros((states, states)), np.zeros(states), 0.0
    emit[key[key >= 0]] = rows[key >= 0]
    for k, row in zip(key.tolist(), rows):
        if -1 - states < k < 0:
            move[-1 - k] = row
        elif k == -1 - states:
            start = row
        elif k == -2 - states:
            likely = float(row[0])
    return _normal(emit, move, start, share), likely


def score_texts(docs: DataFrame, train, *, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int = PASSES, symbols: int = SYMBOLS) -> DataFrame:
    """doc_id, learns, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``train`` is a condition on the id column: rows to learn from.  base_score is
    the smoothed unigram log10 probability, score the hidden Markov model's.  The
    ``symbols - 1`` most frequent training words and the end are symbols; every
    other word is one shared symbol times its unigram share among those words, so
    no word is left out and probabilities over all words and one unknown sum to
    one.  Counts of the other words meet the texts in a join.

    Null texts count as empty: an end alone.  A null condition learns.  Repeated
    rows count and are scored each; other columns are not read; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    rows = whole_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(True)).alias("learns"))
    counts = staged(word_counts(rows.where("learns")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    under = total + SMOOTH * (distinct + 1)
    top, often = frequent_words(counts, symbols - 1)
    ends = counts.where(F.col("word") == F.lit(END)).first()
    frequent = np.concatenate([[ends["c"] if ends else 0], often]).astype(np.float64)
    log_share = np.log10((frequent + SMOOTH) / under)
    share = np.append(10**log_share, 0.0)
    share[-1] = max(1.0 - share.sum(), SMOOTH / under * 1e-6)  # of all words without a symbol
    table = spark.sparkContext.broadcast(({w: k + 1 for k, w in enumerate(top)}, log_share, frequent > 0))
    other = len(log_share)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        symbol, logs, known = table.value
        for part in slices(batches, "text"):
            words, index, n = word_runs(part.column("text"), SPACE, LOWER)
            own = np.fromiter((symbol.get(w, other) for w in words.to_pylist()), dtype=np.int32, count=len(words))
            n = n + 1
            ids = np.zeros(int(n.sum()), dtype=np.int32)
            inside = np.ones(len(ids), dtype=bool)
            inside[np.cumsum(n) - 1] = False
            ids[inside] = own[index]
            owner = np.repeat(np.arange(len(n)), n)
            is_rare = ids == other
            rare_n = np.bincount(owner, is_rare, minlength=len(n)).astype(np.int64)
            rare = words.take(pa.array(index[is_rare[inside]]))
            base = np.bincount(owner, np.append(logs, 0.0)[ids], minlength=len(n))
            sure = np.bincount(owner, np.append(known, False)[ids], minlength=len(n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), part.column("learns"), lists(n, ids), pa.array(n), pa.array(sure), pa.array(base), lists(rare_n, rare)],
                names=["row", "doc_id", "learns", "ids", "n_tokens", "sure", "base", "rare"],
            )

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    encoded = staged(numbered.mapInArrow(encode, f"row long, doc_id {kind}, learns boolean, ids array<int>, n_tokens long, sure long, base double, rare array<binary>"), "sequences")
    lessons = encoded.where("learns")
    seeds = lessons.orderBy(F.xxhash64("doc_id"), "row").select("ids").limit(SEED_ROWS).collect()
    model = first_guess([np.array(r["ids"], dtype=np.int64) for r in seeds], share, states, SEED_PASSES)
    before = None
    for _ in range(passes):
        model, likely = baum_welch_pass(lessons, model, share)
        if before is not None and likely - before < SETTLED * total:
            break
        before = likely
    final, apart = spark.sparkContext.broadcast(model), float(np.log10(share[-1]))

    def likelihood(batches):
        for part, ids, lengths in sequence_slices(batches):
            found = Sequences(ids, lengths).log10(final.value)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found)], names=[*keep, "found"])

    keep = ["row", "doc_id", "learns", "n_tokens", "sure", "base", "n_rare"]
    scored = encoded.select("row", "doc_id", "learns", "n_tokens", "sure", "base", F.size("rare").cast("long").alias("n_rare"), "ids").mapInArrow(
        likelihood, f"row long, doc_id {kind}, learns boolean, n_tokens long, sure long, base double, n_rare long, found double"
    )
    rare = encoded.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + SMOOTH) / F.lit(under))).alias("rare_log"), F.count("c").alias("rare_known"))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "learns",
        "n_tokens",
        (F.col("sure") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log).alias("base_score"),
        (F.col("found") + rare_log - F.col("n_rare") * F.lit(apart)).alias("score"),
    )
