"""Language-model scores by masked pseudo-likelihood.

Every token of a document is predicted from its window on both sides, itself masked, and the conditional
log-probabilities are summed. Tokens are hashed words: the TOP most frequent slots of the corpus are outputs of their
own, all others are N_CLASSES hashed classes, inside which a word slot has its share of the class's corpus count. The
network adds one embedding for each slot and place of the window, applies tanh and predicts the output by softmax. It
is written and trained in numpy inside the tasks.

Slot counts cover all documents. Training passes over every document once, in ROUNDS parts chosen by a hash of the
row: in each round every partition runs gradient steps over its part from the common weights, and the changes are
averaged by the number of tokens, block by block, on the executors. What reaches the driver is the weights and the
counts of SLOTS word slots, whose sizes are fixed.

Nulls and wordless texts have no tokens and score 0. A text of one word is predicted from an empty window. Repeated
rows get equal scores. An empty table gives no rows; where there is nothing to train on, weights stay as they start.
Other columns are not looked at. Weights depend on the order of floating sums and so on the partitioning, in the last
digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 15
TOP = 48
N_CLASSES = 16
OUTPUTS = TOP + N_CLASSES
SIDE = 2
DIM = 8
ROUNDS = 2
STEP = 0.4
BATCH = 4096
SEED = 11
#: Numbers in one block of weights on its way to the average.
BLOCK = 8192
#: Changes of one block that a task adds up at a time.
FAN_IN = 64
#: Change of one block of weights, times the tokens seen by the partition.
CHANGE = "block long, seen long, change binary"

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Slotter:
    """Word slots of texts; a dictionary of bounded size keeps those met."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh32_intdigest(w) % SLOTS
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def slot_counts(docs: DataFrame) -> np.ndarray:
    """Count of each slot over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, total = Slotter(), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                if isinstance(text, str):
                    total += np.bincount(slots(text), minlength=SLOTS) if len(text) > 4 * SLOTS else 0
                    if len(text) <= 4 * SLOTS:
                        np.add.at(total, slots(text), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total[at]})

    rows = docs.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def output_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output of each slot, and the log share of the slot inside its output (one count is added to each slot)."""
    order = np.lexsort((np.arange(SLOTS), -counts))
    output = TOP + np.arange(SLOTS) % N_CLASSES
    output[order[:TOP]] = np.arange(TOP)
    smooth = counts + 1.0
    return output, np.log(smooth / np.bincount(output, weights=smooth, minlength=OUTPUTS)[output])


def initial_weights(counts: np.ndarray, output: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    share = np.bincount(output, weights=counts + 1.0, minlength=OUTPUTS)
    return {"embed": (rng.standard_normal((2 * SIDE, SLOTS + 1, DIM)) * 0.1).astype(np.float32), "hidden": np.zeros(DIM, np.float32),
            "out": (rng.standard_normal((DIM, OUTPUTS)) * 0.1).astype(np.float32), "bias": np.log(share / share.sum()).astype(np.float32)}


def windows(slots: np.ndarray) -> np.ndarray:
    """Neighbours of each token, SIDE before and SIDE after; SLOTS stands for the outside."""
    padded = np.concatenate([np.full(SIDE, SLOTS), slots, np.full(SIDE, SLOTS)])
    n = len(slots)
    places = [*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)]
    return np.stack([padded[p:p + n] for p in places], axis=1)


def forward(w: dict, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden values and log-probabilities of the outputs."""
    total = w["hidden"] + w["embed"][0][context[:, 0]]
    for p in range(1, 2 * SIDE):
        total = total + w["embed"][p][context[:, p]]
    h = np.tanh(total)
    z = h @ w["out"] + w["bias"]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return h, z


def train_step(w: dict, context: np.ndarray, target: np.ndarray, step: float) -> None:
    """One gradient step on the mean negative log-probability of a batch; embedding rows move by their own mean."""
    h, z = forward(w, context)
    n = len(target)
    d = np.exp(z)
    d[np.arange(n), target] -= 1.0
    dh = (d @ w["out"].T) * (1.0 - h * h)
    w["out"] -= step / n * (h.T @ d)
    w["bias"] -= step / n * d.sum(axis=0)
    w["hidden"] -= step / n * dh.sum(axis=0)
    for p in range(2 * SIDE):
        rows, inverse, counts = np.unique(context[:, p], return_inverse=True, return_counts=True)
        total = np.stack([np.bincount(inverse, weights=dh[:, i], minlength=len(rows)) for i in range(DIM)], axis=1)
        w["embed"][p][rows] -= (step * total / np.sqrt(counts * 8.0)[:, None] / 4).astype(np.float32)


_PARTS = ["embed", "hidden", "out", "bias"]


def flat(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in _PARTS]).astype(np.float32)


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    shapes = {"embed": (2 * SIDE, SLOTS + 1, DIM), "hidden": (DIM,), "out": (DIM, OUTPUTS), "bias": (OUTPUTS,)}
    out, at = {}, 0
    for k in _PARTS:
        size = int(np.prod(shapes[k]))
        out[k] = values[at:at + size].reshape(shapes[k]).copy()
        at += size
    return out


def sum_changes(changes: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row of CHANGE for each block: the sums over all partitions.

    Neighbouring partitions are added up by FAN_IN at a time, twice, so that a group holds at most FAN_IN blocks and
    the last one the FAN_IN squared part of the number of partitions.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["change"].iloc[0]) // 4)
        for change in pdf["change"]:
            total += np.frombuffer(change, np.float32)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "seen": [int(pdf["seen"].sum())], "change": [total.astype(np.float32).tobytes()], "part": [pdf["part"].iloc[0]]})

    out = changes.withColumn("part", F.spark_partition_id().cast("long"))
    for _ in range(2):
        out = out.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("block", "part").applyInPandas(add, f"{CHANGE}, part long")
    return out.groupBy("block").applyInPandas(add, f"{CHANGE}, part long").drop("part")


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[dict, np.ndarray]:
    """Weights and slot counts from all documents."""
    counts = slot_counts(docs)
    output, _ = output_table(counts)
    weights = initial_weights(counts, output)
    spark = docs.sparkSession
    for r in range(rounds):
        start = spark.sparkContext.broadcast(flat(weights))

        def learn(batches: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
            slots, w = Slotter(), unflat(start.value)
            held: list[np.ndarray] = []
            load = seen = 0

            def go() -> None:
                context = np.concatenate([windows(s) for s in held])
                target = output[np.concatenate(held)]
                for at in range(0, len(target), BATCH):
                    train_step(w, context[at:at + BATCH], target[at:at + BATCH], STEP)

            for batch in batches:
                for text in batch["text"]:
                    s = slots(text)
                    if len(s):
                        held.append(s)
                        load += len(s)
                        seen += len(s)
                    if load >= 16 * BATCH:
                        go()
                        held, load = [], 0
            if held:
                go()
            if seen:
                change = (flat(w) - start.value) * np.float32(seen)
                touched = [i for i in range(0, len(change), BLOCK) if change[i:i + BLOCK].any()]
                yield pd.DataFrame({"block": [i // BLOCK for i in touched], "seen": seen, "change": [change[i:i + BLOCK].tobytes() for i in touched]})

        part = docs.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(rounds)) == r)).select("text")
        summed = sum_changes(part.mapInPandas(learn, CHANGE)).toPandas()
        values = start.value.copy()
        for block, seen, change in zip(summed["block"], summed["seen"], summed["change"]):
            change = np.frombuffer(change, np.float32)
            values[block * BLOCK:block * BLOCK + len(change)] += change / np.float32(seen)
        weights = unflat(values)
        start.unpersist()
    return weights, counts


def score_texts(docs: DataFrame, weights: dict, counts: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum of the conditional log-probabilities) and per_token (their mean)."""
    output, share = output_table(counts)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((flat(weights), output, share))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, output, share = model.value
        slots, w = Slotter(), unflat(values)
        for batch in batches:
            all_slots = [slots(t) if isinstance(t, str) else np.zeros(0, np.int64) for t in batch["text"]]
            sums, at = np.zeros(len(all_slots)), 0
            while at < len(all_slots):
                end, load = at, 0
                while end < len(all_slots) and (end == at or load + len(all_slots[end]) <= 4 * BATCH):
                    load += len(all_slots[end])
                    end += 1
                group = all_slots[at:end]
                token = np.concatenate(group)
                if len(token):
                    context = np.concatenate([windows(s) for s in group])
                    logs = share[token]
                    for i in range(0, len(token), 4 * BATCH):
                        t = output[token[i:i + 4 * BATCH]]
                        logs[i:i + 4 * BATCH] += forward(w, context[i:i + 4 * BATCH])[1][np.arange(len(t)), t]
                    sums[at:end] = np.bincount(np.repeat(np.arange(len(group)), [len(s) for s in group]), weights=logs, minlength=len(group))
                at = end
            sizes = np.array([len(s) for s in all_slots])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": sizes, "log_likelihood": sums, "per_token": sums / np.maximum(sizes, 1)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_tokens long, log_likelihood double, per_token double")
