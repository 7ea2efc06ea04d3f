"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the classes of a clause's words, one after the other: insults (an insult may
also be passed over; one after an intensifier or another insult is strong), negation, reported speech,
targets (whom the clause is aimed at, before the insult or after it) and threats. Each rewrites the
classes for the next and has weights on its arcs; `compose` makes one machine of two. A clause's weight is that of its
best path: the lexical weights of the insults taken and the arcs' weights. Negation
and reported speech weigh so much against an insult that the best path mostly passes it over.

A clause whose best path takes an insult or a threat is toxic with a probability that is logistic
in its weight, and a text is toxic if any of its clauses is: 1 - (1 - `rest`) * prod(1 - p). So words decide
nothing outside of their clause.

The lexicon of insults (words and word beginnings with a weight) is learned from the
labels: beginnings and words that labelled texts have mostly where they are toxic,
counted over texts that differ. Two thirds of the labelled sample give the lexicon, the
other third checks each entry and fits the arcs' weights within bounds that keep the grammar's order: an
aimed insult weighs more than a plain one, a strong one too. A few general words and the
closed classes (pronouns, negations, verbs of speech and harm) are given.

The fit takes about MAX_LABELLED labelled texts at most, chosen by a hash of the id;
scores cover whole texts of every row, however long, clause by clause in one pass.

Null and empty texts get the score of a text without matches; without labels
of both kinds the given words and weights are used; repeated rows each keep
their row and have equal scores; of paths of equal weight the first stays, which changes no score; an
empty table gives an empty result; an input column with an output's name is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import common

MAX_LABELLED = 24_000
#: Lexicon entries kept, and candidates that are counted for them.
MAX_ENTRIES, MAX_CANDIDATES = 4_000, 20_000
STEMS = range(3, 9)

GIVEN = "idiot idiots moron morons stupid scum loser losers trash worthless pathetic disgusting clown imbecile bastard".split()
CLASSES = {
    "target": "you your youre u he him she they them du dich ihr euch sie dieser tu toi vous ce cette usted ustedes ese esta".split(),
    "negation": "not no never nobody none isnt arent wasnt dont doesnt didnt nicht kein keine nie pas jamais aucun nunca jamás".split(),
    "report": "said says say called calls wrote writes quoted claimed sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó".split(),
    "intensifier": "such so very really total complete utter absolute damn bloody völliger quel vraiment tan muy".split(),
    "intent": "will gonna shall ill werde werden vais va voy vamos".split(),
    "harm": "kill hurt beat destroy burn stab shoot attack töten schlagen zerstören tuer frapper brûler matar golpear quemar".split(),
}
KNOWN = {w: k for k, words in CLASSES.items() for w in words}
SYMBOLS = (*CLASSES, "insult", "other")
#: What arcs weigh before labels are seen, and the bounds of the fit. Negation and report aren't fitted: labels of whole texts say too little about them.
ARCS = {"aimed": (1.0, 0.5, 3.0), "strong": (0.5, 0.25, 2.0), "threat": (4.5, 3.0, 6.0), "negated": (-8.0, -8.0, -8.0), "reported": (-5.0, -5.0, -5.0)}
#: Bias of a matched clause, and what lexical weights are multiplied with.
BASE = {"bias": (-2.2, -4.0, 0.0), "lexical": (1.0, 0.5, 1.25)}
NAMES = (*BASE, *ARCS)
LOW, HIGH = (np.array([(BASE | ARCS)[n][k] for n in NAMES]) for k in (1, 2))
PRIOR = np.array([(BASE | ARCS)[n][0] for n in NAMES])
#: Weights of lexicon entries, in nats: given ones, and the range of learned ones.
GIVEN_WEIGHT, LEAST_WEIGHT, MOST_WEIGHT = 2.5, 1.5, 4.0

WORD = re.compile(r"[^\W_]+")
CLAUSE = re.compile(r"[.!?;:\n|]+")


@dataclass
class Transducer:
    """arcs: by state and symbol the (next state, symbol put out, names of the weights on the arc); final: where a clause may end."""

    start: object
    arcs: dict
    final: set


def transducer(start, step: Callable, final: Callable = lambda s: True) -> Transducer:
    """All states that step(state, symbol) -> arcs reaches from start."""
    arcs, states = {}, [start]
    seen = {start}
    for s in states:  # grows while it is read
        for c in SYMBOLS:
            arcs[s, c] = step(s, c)
            for after, _, _ in arcs[s, c]:
                if after not in seen:
                    seen.add(after)
                    states.append(after)
    return Transducer(start, arcs, {s for s in states if final(s)})


def compose(one: Transducer, two: Transducer) -> Transducer:
    """The machine that feeds what `one` puts out to `two`; weights of both are on its arcs."""

    def step(s, c):
        return [((a, b), z, f + g) for a, y, f in one.arcs[s[0], c] for b, z, g in two.arcs[s[1], y]]

    return transducer((one.start, two.start), step, lambda s: s[0] in one.final and s[1] in two.final)


def insults() -> Transducer:
    """State 1: after an intensifier or an insult."""

    def step(s, c):
        if c == "insult":
            return [(1, "insult", ("strong",) if s else ()), (0, "other", ())]
        return [(int(c == "intensifier"), c, ())]

    return transducer(0, step)


def scope(opens: str, reach: int, name: str) -> Transducer:
    """An insult at most `reach` words after one of class `opens` gets the weight `name`; harm within it is none."""

    def step(s, c):
        after = reach if c == opens else max(0, s - 1)
        if s and c == "harm":
            return [(after, "other", ())]
        return [(after, c, (name,) if s and c == "insult" else ())]

    return transducer(0, step)


def targets(before: int = 4, after: int = 2) -> Transducer:
    """Insults at most `before` words after a target or `after` words before one are aimed. In states
    below 0 the path has taken an insult that a target must follow."""

    def step(s, c):
        if c == "target":
            return [(before, c, ("aimed",) if s < 0 else ())]
        if s < 0:
            return [(s + 1, c, ())] if s < -1 else []
        left = max(0, s - 1)
        if c != "insult":
            return [(left, c, ())]
        return [(left, c, ("aimed",))] if s else [(0, c, ()), (-after, c, ())]

    return transducer(0, step, lambda s: s >= 0)


def threats(reach: int = 3) -> Transducer:
    """Intent, then harm, then a target, each within `reach` words."""

    def step(s, c):
        stage, left = s
        if c == "intent":
            return [((1, reach), c, ())]
        if stage == 1 and c == "harm":
            return [((2, reach), c, ())]
        if stage == 2 and c == "target":
            return [((0, 0), c, ("threat",))]
        return [((stage, left - 1) if left > 1 else (0, 0), c, ())]

    return transducer((0, 0), step)


@cache
def composed() -> tuple[list[dict[str, list]], int, set[int]]:
    """The grammar with its states numbered: arcs by state and symbol, the start, the final states."""
    whole = reduce(compose, [insults(), scope("negation", 2, "negated"), scope("report", 6, "reported"), targets(), threats()])
    number = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in whole.arcs))}
    arcs: list[dict[str, list]] = [{} for _ in number]
    for (s, c), out in whole.arcs.items():
        arcs[number[s]][c] = [(number[after], z == "insult", tuple(NAMES.index(f) for f in names)) for after, z, names in out]
    return arcs, number[whole.start], {number[s] for s in whole.final}


@dataclass
class Grammar:
    """Lexical weights by word and by word beginning, the weights of NAMES, and the chance of a text without matches."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    rest: float = 0.02

    def __post_init__(self) -> None:
        self.heads = {w[:3] for w in self.words} | {s[:3] for s in self.stems} | {w[:3] for w in CLASSES["harm"]}
        self.lengths = sorted({len(s) for s in self.stems})

    @cached_property
    def machine(self) -> tuple[list[dict[str, list]], int, set[int]]:
        arcs, start, final = composed()
        return [{c: [(n, hit, f, float(self.weights[list(f)].sum()) if f else 0.0) for n, hit, f in out] for c, out in row.items()} for row in arcs], start, final

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "machine"}

    def weight(self, word: str) -> float:
        """The largest lexical weight of the word's entries; 0 if there are none."""
        best = self.words.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def best_path(self, tokens: list[str], hot: dict[str, float]) -> np.ndarray | None:
        """What the best path takes, in the order of NAMES: 1, the lexical weights, how often each arc's weight. None if nothing."""
        arcs, start, final = self.machine
        lexical = float(self.weights[1])
        paths = {start: (0.0, None)}
        for w in tokens:
            value = hot.get(w, 0.0)
            c = "insult" if value else KNOWN.get(w, "other")
            found: dict[int, tuple] = {}
            for s, (total, taken) in paths.items():
                for n, hit, names, weight in arcs[s][c]:
                    t = total + weight + (lexical * value if hit else 0.0)
                    if n not in found or t > found[n][0]:
                        found[n] = (t, (taken, value if hit else 0.0, names) if hit or names else taken)
            paths = found
        total, taken = max((p for s, p in paths.items() if s in final), key=lambda p: p[0])
        if total <= 0:
            return None
        out = np.zeros(len(NAMES))
        out[0] = 1
        while taken is not None:
            taken, value, names = taken
            out[1] += value
            for k in names:
                out[k] += 1
        return out

    def clauses(self, text: str | None) -> list[np.ndarray]:
        """The best paths of the clauses that match."""
        if not text:
            return []
        text = text.lower()
        words = set(WORD.findall(text))
        hot = {w: x for w in words if w[:3] in self.heads and (x := self.weight(w)) > 0}
        wanted = hot.keys() | words & set(CLASSES["harm"])
        if not wanted:
            return []
        found = []
        for clause in CLAUSE.split(text):
            tokens = WORD.findall(clause)
            if not wanted.isdisjoint(tokens) and (path := self.best_path(tokens, hot)) is not None:
                found.append(path)
        return found

    def score(self, text: str | None) -> float:
        paths = self.clauses(text)
        left = 1 - self.rest
        if paths:
            left *= float(np.prod(1 / (1 + np.exp(np.clip(np.array(paths) @ self.weights, -30, 30)))))
        return 1 - left


def fit_weights(texts: list[list[np.ndarray]], toxic: np.ndarray, strength: float = 2.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights of the likeliest labels, drawn to PRIOR and held within their bounds, by projected Adagrad; and `rest`."""
    none = np.array([not t for t in texts])
    rest = float(np.clip((toxic[none].sum() + 0.2) / (none.sum() + 10), 0.001, 0.2))
    x = np.array([p for t in texts for p in t]).reshape(-1, len(NAMES))
    if not len(x):
        return PRIOR.copy(), rest
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    w, squares = PRIOR.copy(), np.full(len(NAMES), 1e-2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        left = (1 - rest) * np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts)))
        slope = np.where(toxic[owner] == 1, p * (left / np.maximum(1 - left, 1e-12))[owner], -p)
        gradient = x.T @ slope - strength * (w - PRIOR)
        squares += gradient**2
        w = np.clip(w + 0.3 * gradient / np.sqrt(squares), LOW, HIGH)
    return w, rest


def terms(text: str | None) -> set[str]:
    """Words, and their beginnings marked by a star."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for n in STEMS for w in words if len(w) >= n}


def counted(sample: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(term, toxic, clean, held_toxic, held_clean): texts of the sample(text, toxic, held) that have each term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [Counter() for _ in range(4)]
        for batch in batches:
            for text, toxic, held in zip(batch["text"], batch["toxic"], batch["held"], strict=True):
                found = terms(text)
                counts[2 * held + (not toxic)].update(found if wanted is None else found & wanted)
        every = list(set().union(*counts))
        yield pd.DataFrame({"term": every} | {c: [k[t] for t in every] for c, k in zip(("toxic", "clean", "held_toxic", "held_clean"), counts, strict=True)})

    out = sample.mapInPandas(run, "term string, toxic long, clean long, held_toxic long, held_clean long")
    return out.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "held_toxic", "held_clean")))


def chosen_terms(found: list, n_toxic: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings with their weight, from counts of terms."""
    support = max(6, round(0.004 * n_toxic))
    good = {}
    for r in found:
        precision = (r.toxic + 0.5) / (r.toxic + r.clean + 1)
        held = r.held_toxic + r.held_clean
        if r.toxic >= support and precision >= 0.9 and held >= 2 and (r.held_toxic + 0.5) / (held + 1) >= 0.75:
            total = r.toxic + r.held_toxic, r.clean + r.held_clean
            good[r.term] = (float(np.clip(np.log((total[0] + 0.5) / (total[1] + 0.5)), LEAST_WEIGHT, MOST_WEIGHT)), total[0])
    # of beginnings with the same texts, the longest
    names = sorted(good)
    for term in [t for t in names if t.endswith("*")]:
        if any(u != term and u.startswith(term[:-1]) and good[u][1] >= 0.95 * good[term][1] for u in names):
            del good[term]
    words, stems = {}, {}
    for term in sorted(good, key=lambda t: (len(t.rstrip("*")), t)):
        weight, n = good[term]
        stem = term.rstrip("*")
        shorter = (stem[:k] for k in STEMS if k <= len(stem))
        if not any(s in stems and weight <= stems[s] + 0.5 for s in shorter):
            (stems if term.endswith("*") else words)[stem] = weight
    return words, stems


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Grammar:
    """A grammar from labelled documents (label 1: toxic), from a hashed sample of about max_labelled."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    n = known.count()
    given = Grammar(dict.fromkeys(GIVEN, GIVEN_WEIGHT), {})
    if not n:
        return given
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    # about max_labelled pairs of numbers: bounded by the parameter
    sample = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")
    # near copies of a text count once: they mostly share the smallest hash of their five-word windows
    words = common.split_words(F.lower("text"))
    sample = sample.withColumn("words", words)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - 4, F.lit(1)))
    sample = sample.withColumn("key", F.array_min(F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, 5)))))
    sample = sample.groupBy("key", "toxic").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(3)) == 0
    sample = common.written(sample.select("doc_id", "text", (F.col("toxic") == 1).cast("int").alias("toxic"), held.cast("int").alias("held")), "toxicity-sample")
    n_toxic = sample.where("toxic = 1").count()
    if not n_toxic:
        return given
    candidates = counted(sample.where("toxic = 1"), None).where(F.col("toxic") >= max(4, round(0.004 * n_toxic)))
    candidates = {r.term for r in candidates.orderBy(F.desc("toxic"), "term").limit(MAX_CANDIDATES).select("term").collect()}
    tested = counted(sample, candidates).where("toxic > 3 * clean").orderBy(F.desc("toxic"), "term").limit(MAX_ENTRIES).collect()
    learned, stems = chosen_terms(tested, n_toxic)
    grammar = Grammar(dict.fromkeys(GIVEN, GIVEN_WEIGHT) | learned, stems)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "paths": [[p.tolist() for p in grammar.clauses(t)] for t in batch["text"]]})

    rows = sample.where("held = 1").mapInPandas(run, "doc_id long, toxic int, paths array<array<double>>").orderBy("doc_id").collect()
    toxic = np.array([r.toxic for r in rows])
    if len(rows) and 0 < toxic.sum() < len(rows):
        weights, rest = fit_weights([[np.array(p) for p in r.paths] for r in rows], toxic)
        grammar = Grammar(grammar.words, grammar.stems, weights, rest)
    return grammar


def score(documents: DataFrame, grammar: Grammar, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """documents' columns `keep` (all by default) with score and predicted (1 from 0.5)."""
    kept = [c for c in (keep if keep is not None else documents.columns) if c not in ("score", "predicted")]

    found = common.with_outputs(documents, text, kept, {"score": T.DoubleType()}, lambda: lambda texts: {"score": [grammar.score(t) for t in texts]})
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
