"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

`count` gathers the tokens of all training texts (the words of lower-cased text and one end
each). The model predicts *units*: the `own` most frequent tokens, and classes of all other tokens by
their ending (the last two bytes; the `endings` most frequent ones, and one class for the rest), so
every token, counted or never seen, has a unit with vectors of its own. A token's probability is that of its
unit, given the two units before it, times its add-one share of its class's counts (1 for own tokens).

The units' model: the context vectors of the two units, scaled by position, add
up to a prediction that is multiplied with every unit's vector, plus a bias
(Mnih and Hinton 2007; Mnih and Teh 2012). In each of `rounds` every partition of the
training texts makes noise-contrastive steps in numpy from the same start, with every token
as a target, and the partitions' parameters are averaged by the tokens that they saw.

`encode` reads texts once and writes their units, from which `fit` trains and `score_units` scores.
Scores are log10 probabilities of whole texts. They are normalised: batched matrix
products over the units give the log normaliser of every pair of context units once,
so that a token takes a few look-ups. Counts of tokens outside the `head` most frequent ones come
by a join and are never broadcast.

Null texts count as empty (an end alone); texts are read whole, however long; of tokens of equal counts the
first in byte order is the more frequent one; without training texts every token is unknown;
repeated rows each keep their row; an empty table gives an empty result; an input column
with an output's name is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import common

END = ""  # the end's token: no word is empty
TOKENS = 1 << 18  # read at a time
ENDING = 2  # bytes of a token that name its class


@dataclass
class Parameters:
    """Token vectors and biases, context vectors (the last is the start's) and their scales by position."""

    out: np.ndarray
    bias: np.ndarray
    context: np.ndarray
    scale: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, size: int, seed: int = 5) -> Parameters:
        rng = np.random.default_rng(seed)
        k = len(counts)
        bias = np.log((counts + 1) / (counts + 1).sum())
        return cls(*(x.astype(np.float32) for x in (rng.normal(0, 0.1, (k, size)), bias, rng.normal(0, 0.1, (k + 1, size)), np.ones((2, size)))))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.out, self.bias, self.context, self.scale)])

    def filled(self, flat: np.ndarray) -> Parameters:
        parts, at = [], 0
        for x in (self.out, self.bias, self.context, self.scale):
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Parameters(*parts)


def row_sums(cells: np.ndarray, rows: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The sums of the rows that go into each row of a table; cells: places of the rows' values in it."""
    sums = np.zeros(shape, np.float32)
    np.add.at(sums.reshape(-1), cells.reshape(-1), rows.reshape(-1))
    return sums


class Trainer:
    """Noise-contrastive steps with Adagrad; the noise samples of a batch are shared by its tokens. A unit's vector and bias are a row of one table,
    whose context has a one for the bias, and tables are updated whole: rows without a gradient stay as they are."""

    def __init__(self, start: Parameters, noise: np.ndarray, seed: int, rate: float = 0.1, samples: int = 64) -> None:
        self.size = start.out.shape[1]
        self.units = np.concatenate([start.out, start.bias[:, None]], 1)
        self.p = Parameters(self.units[:, : self.size], self.units[:, self.size], start.context.copy(), start.scale.copy())
        self.tables = (self.units, self.p.context, self.p.scale)
        self.squares = [np.full_like(x, 1e-2) for x in self.tables]
        self.noise = noise / noise.sum()
        self.log_noise = np.log(samples * self.noise).astype(np.float32)
        self.cdf = np.cumsum(self.noise)
        self.rng, self.rate, self.samples = np.random.default_rng(seed), np.float32(rate), samples
        self.places = [np.arange(x.size).reshape(x.shape) for x in self.tables]
        self.pairs = np.empty(0, np.float32)  # of a batch and its noise, used again by each step

    def update(self, k: int, gradient: np.ndarray) -> None:
        """A step of one table; gradient is used up."""
        s = self.squares[k]
        root = gradient * gradient
        s += root
        np.sqrt(s, out=root)
        gradient /= root
        gradient *= self.rate
        x = self.tables[k]
        x += gradient

    def step(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, n, size = self.p, len(target), self.size
        a, b = p.context.take(one, 0), p.context.take(two, 0)
        first, second = (np.tile(x, n).reshape(n, size) for x in p.scale)  # products of whole tables are quicker than row by row
        q = np.ones((n, size + 1), np.float32)
        q[:, :size] = first * a + second * b
        drawn = np.minimum(np.searchsorted(self.cdf, self.rng.random(self.samples)), len(self.cdf) - 1)
        own, noise = self.units.take(target, 0), self.units.take(drawn, 0)
        real = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, own) - self.log_noise.take(target)))
        if self.pairs.size < n * self.samples:
            self.pairs = np.empty(n * self.samples, np.float32)
        false = np.matmul(q, noise.T, out=self.pairs[: n * self.samples].reshape(n, self.samples))
        np.subtract(self.log_noise.take(drawn), false, out=false)
        np.exp(false, out=false)
        false += 1
        np.divide(-1, false, out=false)
        rows = np.empty((n + self.samples, size + 1), np.float32)
        np.multiply(real[:, None], q, out=rows[:n])
        np.matmul(false.T, q, out=rows[n:])
        rows /= n
        own *= real[:, None]
        own += false @ noise
        dq = own[:, :size] / n
        ones = np.ones(n, np.float32)
        scale = np.stack([ones @ (a * dq), ones @ (b * dq)])
        of_context = np.concatenate([first * dq, second * dq])
        self.update(0, row_sums(self.places[0].take(np.concatenate([target, drawn]), 0), rows, self.units.shape))
        self.update(1, row_sums(self.places[1].take(np.concatenate([one, two]), 0), of_context, p.context.shape))
        self.update(2, scale)


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text as UTF-8, lower-cased (A-Z alone, as bytes are), and its end. Bytes split at the contract's white space."""
    words = (text or "").encode().lower().split()
    words.append(b"")
    return words


def contexts(ids: np.ndarray, starts: np.ndarray, start_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The one and the two tokens before each, with start_id before a text's first."""
    one = np.concatenate([[start_id], ids[:-1]])[: len(ids)]
    two = np.concatenate([[start_id, start_id], ids[:-2]])[: len(ids)]
    one[starts], two[starts] = start_id, start_id
    second = starts + 1
    second = second[second < len(ids)]
    two[second] = start_id
    return one, two


@dataclass
class Vocabulary:
    """counts: the table (token, c) of all training tokens; head: index of the most frequent
    ones; head_counts: their counts; units: first the classes (0: the rest) of `endings`, then the first `own` of head;
    unit_counts: training tokens of each unit; spaces: of each class the counts and one for each token and for an unseen one."""

    counts: DataFrame
    head: dict[str, int]
    head_counts: np.ndarray
    n_tokens: int
    n_distinct: int
    own: int
    endings: dict[bytes, int]
    unit_counts: np.ndarray
    spaces: np.ndarray

    @property
    def head_units(self) -> np.ndarray:
        """The unit of each head token."""
        classes = len(self.spaces)
        found = np.array([self.endings.get(t.encode()[-ENDING:], 0) for t in self.head], np.int64)
        found[: self.own] = classes + np.arange(self.own)
        return found


@dataclass
class Model:
    vocabulary: Vocabulary
    parameters: Parameters

    @property
    def n_tokens(self) -> int:
        return self.vocabulary.n_tokens


DISTINCT = 1 << 19  # tokens that a task counts before it gives its counts on


def count_tokens(texts: DataFrame, text: str = "text", distinct: int = DISTINCT) -> DataFrame:
    """(token, c) of all texts: each task counts its texts' tokens, the tasks' counts are summed by token."""
    common.modest_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "c"])
            found.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                found.update(tokens_of(t.as_py()))
                if len(found) >= distinct:
                    yield given()
        yield given()

    return texts.select(F.col(text)).mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list:
    """The rows of the highest counts, in order, `most` at most: all whose level (sixteenths of a power of two) leaves room for it.

    The levels' sizes are collected first, so that no task sends more than its part of these rows.
    """
    level = F.floor(F.log2("c") * 16).cast("int")
    taken, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):  # some hundred levels
        taken += r.n
        if taken > most:
            break
        least = r.level
    return [] if least is None else sorted(counts.where(level >= least).collect(), key=lambda r: (-r.c, r.token))


def count(texts: DataFrame, text: str = "text", own: int = 768, endings: int = 255, head: int = 1 << 16) -> Vocabulary:
    counts = common.written(count_tokens(texts, text), "counts")
    n_tokens, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, head)
    own = min(own, len(top))
    head_counts = np.array([r.c for r in top], np.int64)
    ending = F.substring(F.col("token").cast("binary"), -ENDING, ENDING)
    found = counts.groupBy(ending.alias("ending")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()  # pairs of bytes
    sums = {bytes(r.ending): [r.c, r.n] for r in found}
    for r in top[:own]:
        of = sums[r.token.encode()[-ENDING:]]
        of[0], of[1] = of[0] - r.c, of[1] - 1
    named = sorted((e for e, (c, _) in sums.items() if c), key=lambda e: (-sums[e][0], e))[:endings]
    classes = {e: i + 1 for i, e in enumerate(named)}
    c, n = np.zeros(len(classes) + 1), np.zeros(len(classes) + 1)
    for e, (k, m) in sums.items():
        c[classes.get(e, 0)] += k
        n[classes.get(e, 0)] += m
    return Vocabulary(
        counts, {r.token: i for i, r in enumerate(top)}, head_counts, n_tokens, n_distinct, own, classes, np.concatenate([c, head_counts[:own]]), c + n + 1
    )


CODED = {"units": "binary", "n_tokens": "long", "n_known": "long", "head_log": "double", "class_log": "double", "tail": "array<struct<token:string,n:long>>"}


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The written table (row: df's columns `keep`, all by default; row_id; units as 16-bit integers; n_tokens; n_known, head_log and
    class_log: known tokens of the head, their log10(c + 1) and what units' probabilities are multiplied with; tail: tokens outside the head)."""
    spark = df.sparkSession
    common.modest_batches(spark)
    v = vocabulary
    tables = spark.sparkContext.broadcast(({t.encode(): i for t, i in v.head.items()}, v.head_counts, v.head_units, v.endings, v.spaces))

    def some(docs: list[list[bytes]]) -> dict[str, list]:
        head, counts, head_units, endings, spaces = tables.value
        sizes = np.array([len(d) for d in docs])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        tokens = list(chain.from_iterable(docs))
        get = head.get
        h = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
        rare = np.flatnonzero(h < 0)
        units = np.append(head_units, 0)[h]
        units[rare] = [endings.get(tokens[i][-ENDING:], 0) for i in rare.tolist()]
        log_count = np.append(np.log10(counts + 1.0), 0.0)[h]  # -1 takes the last: 0
        classed = units < len(spaces)
        share = np.where(classed, log_count - np.log10(spaces)[np.where(classed, units, 0)], 0.0)
        total = lambda x: np.add.reduceat(x, starts).tolist()
        cuts = np.searchsorted(rare, np.append(starts, len(h)))
        tails = [Counter([d[i] for i in (rare[a:b] - at).tolist()]) for d, at, a, b in zip(docs, starts.tolist(), cuts[:-1], cuts[1:], strict=True)]
        units = units.astype("<i2")
        return {
            "units": [units[a : a + k].tobytes() for a, k in zip(starts.tolist(), sizes.tolist(), strict=True)],
            "n_tokens": sizes.tolist(),
            "n_known": total((h >= 0).astype(np.int64)),
            "head_log": total(log_count),
            "class_log": total(share),
            "tail": [[{"token": t.decode(), "n": n} for t, n in tail.items()] for tail in tails],
        }

    def run(texts: list) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in CODED}
        docs, size = [], 0
        for k, t in enumerate(texts):
            docs.append(tokens_of(t))
            size += len(docs[-1])
            if size >= TOKENS or k + 1 == len(texts):
                for c, values in some(docs).items():
                    out[c] += values
                docs, size = [], 0
        return out

    kept = keep if keep is not None else df.columns
    source = common.with_row_id(df.select(F.struct(*kept).alias("row"), F.col(text).alias("text")))
    types = {c: T.StructType.fromDDL(f"x {t}").fields[0].dataType for c, t in CODED.items()}
    return common.written(common.with_outputs(source, "text", ["row", "row_id"], types, lambda: run), "units")


def units_of(batch: list) -> tuple[np.ndarray, np.ndarray]:
    """The units of texts end to end, and where each text starts."""
    sizes = np.array([len(b) // 2 for b in batch], np.int64)
    return np.frombuffer(b"".join(batch), "<i2").astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def fit(coded: DataFrame, vocabulary: Vocabulary, size: int = 24, rounds: int = 2, batch: int = 512) -> Model:
    """The model after `rounds` over all rows of coded(units)."""
    counts = vocabulary.unit_counts
    parameters = Parameters.start(counts, size)
    for k in range(rounds if vocabulary.n_tokens else 0):
        start, rate = parameters, 0.1 / (k + 1)

        def run(batches: Iterator[pd.DataFrame], start=start, rate=rate, k=k) -> Iterator[pd.DataFrame]:
            trainer, seen = Trainer(start, counts + 1, seed=len(counts), rate=rate), 0
            rng = np.random.default_rng([11, k])  # another order in each round
            for frame in batches:
                if not len(frame):
                    continue
                ids, starts = units_of(frame["units"].to_list())
                one, two = contexts(ids, starts, len(counts))
                places = rng.permutation(len(ids))
                ids, one, two = ids[places], one[places], two[places]
                for i in range(0, len(places), batch):
                    at = slice(i, i + batch)
                    trainer.step(ids[at], one[at], two[at])
                seen += len(places)
            if seen:
                yield pd.DataFrame({"weight": [float(seen)], "values": [trainer.p.flat().astype(float)]})

        found = coded.select("units").mapInPandas(run, "weight double, values array<double>")
        each = found.select("weight", F.posexplode("values").alias("at", "value"))
        mean = each.groupBy("at").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"))
        mean = mean.toPandas().sort_values("at")  # a row for each parameter
        parameters = parameters.filled(mean["value"].to_numpy())
    return Model(vocabulary, parameters)


def train(texts: DataFrame, text: str = "text", **sizes) -> Model:
    """A model of texts."""
    vocabulary = count(texts, text, **sizes)
    return fit(encode(texts, vocabulary, text, keep=[text]), vocabulary)


def normalisers(spark, p: Parameters) -> np.ndarray:
    """Log of the sum over the vocabulary for each pair of context tokens, [one, two]."""
    k = len(p.context)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        second = p.scale[1] * p.context
        for batch in batches:
            rows = []
            for i in batch["id"]:
                s = (p.scale[0] * p.context[i] + second) @ p.out.T + p.bias
                top = s.max(1)
                rows.append((top + np.log(np.exp(s - top[:, None]).sum(1))).astype(float))
            yield pd.DataFrame({"one": batch["id"], "values": rows})

    rows = spark.range(0, k, 1, 12).mapInPandas(run, "one long, values array<double>").toPandas().sort_values("one")
    return np.stack(rows["values"].to_list()).astype(np.float32)


OUTPUTS = ("n_tokens", "n_known", "base_score", "score")


def score_units(coded: DataFrame, model: Model) -> DataFrame:
    """The rows of coded with n_tokens, n_known, base_score (add-one unigram) and score (the model), both
    log10 probabilities of the text."""
    spark = coded.sparkSession
    p, v = model.parameters, model.vocabulary
    tables = spark.sparkContext.broadcast(((p.scale[0] * p.context) @ p.out.T + p.bias, (p.scale[1] * p.context) @ p.out.T, normalisers(spark, p)))
    start_id = len(p.context) - 1

    def run(batch: list) -> dict[str, list]:
        first, second, norm = tables.value
        out, held, size = [], [], 0
        for k, b in enumerate(batch):
            held.append(b)
            size += len(b)
            if size >= 2 * TOKENS or k + 1 == len(batch):
                ids, starts = units_of(held)
                one, two = contexts(ids, starts, start_id)
                log_p = (first[one, ids].astype(float) + second[two, ids] - norm[one, two]) / np.log(10)
                out += np.add.reduceat(log_p, starts).tolist()
                held, size = [], 0
        return {"model_log": out}

    parts = common.with_outputs(coded, "units", ["row", "row_id", "n_tokens", "n_known", "head_log", "class_log"], {"model_log": T.DoubleType()}, lambda: run)
    tail = coded.select("row_id", F.explode("tail").alias("t")).select("row_id", F.col("t.token").alias("token"), F.col("t.n").alias("n"))
    tail = tail.join(v.counts.hint("merge"), "token")
    tail = tail.groupBy("row_id").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("tail_log"))
    tail = common.written(tail, "tail")
    found = parts.join(tail.hint("merge"), "row_id", "left")
    tail_log, space = F.coalesce("tail_log", F.lit(0.0)), float(v.n_tokens + v.n_distinct + 1)
    kept = [f"row.`{c}`" for c in coded.schema["row"].dataType.names if c not in OUTPUTS]
    return found.select(
        *kept,
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * F.lit(float(np.log10(space)))).alias("base_score"),
        (F.col("model_log") + F.col("class_log") + tail_log).alias("score"),
    )


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` (all by default) with n_tokens, n_known, base_score and score."""
    return score_units(encode(df, model.vocabulary, text, keep), model)
