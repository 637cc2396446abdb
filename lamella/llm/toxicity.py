"""Toxicity by a grammar of weighted finite-state transducers.

A text is cut into clauses and each word read as a symbol: insult, threat, target, modal, negation, report or
other. Four transducers are composed into one machine:

* negation: an insult or threat shortly after a negation is rewritten as a negated one,
* reported speech: after a verb of saying or a quotation mark, insults and threats are rewritten as reported ones,
* threat: a modal before a threat, or a target after it, makes the threat count,
* target: an insult near a target (before or after it) is rewritten as an aimed one; alone it counts for half.

An arc carries a factor and a constant: a word of weight ``w`` passes on ``factor * w + constant``, and composed
arcs apply one after the other. A clause's score is the sum over its path, a document's the norm of the clause scores, with ``Settings.power`` as exponent: it
grows more slowly than their number, so in a long text many weak clauses add up to less than their sum. A logistic curve,
whose log odds bend towards a bound so that different values keep different scores, gives a score between 0 and 1.

Insults are a short list of plain ones and what labelled documents teach: words and word beginnings found in
many more toxic documents than chance allows (a likelihood-ratio test), weighted by their log odds. The
weights and the curve are fitted on at most ``Settings.sample`` labelled documents, drawn by a hash of their id; of near
copies among them with one label few are kept, those of the smallest hashes, or the words of a toxic text with many
copies would all look toxic.

Null and empty texts score as texts without any match. Rows with null ids are scored and never teach; labels
without an id or a toxic value are ignored, and an id labelled more than once counts as toxic if one of its labels
says so. Without labels of both kinds the listed words and a fixed curve are used. Repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import column, learning_rows, stored

# Plain words of each class, lower case.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash clown pathetic worthless disgusting imbecile".split()
THREATS = "kill hurt destroy murder beat stab shoot strangle burn töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton vous votre tú ti usted ustedes".split()
MODALS = "will gonna shall going must werde werden vais va vas voy".split()
NEGATIONS = "not no never isn't aren't wasn't don't nobody nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote called calls quoted claimed sagte schrieb nannte dit écrit dijo escribió".split()
QUOTES = set("\"“”«»„")

#: Symbols of words.
OTHER, INSULT, THREAT, TARGET, MODAL, NEGATION, REPORT = range(7)
#: Symbols that only transducers write.
AIMED, NOT_INSULT, NOT_THREAT, SAID_INSULT, SAID_THREAT, CARRIED_OUT = range(7, 13)

WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:|\n\"“”«»„]")
ENDS = set(".!?;:|\n")


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # labelled documents used for fitting, at most
    shortest: int = 3  # letters of a learned word beginning
    longest: int = 8
    least_documents: int = 4  # toxic documents that hold a learned entry
    evidence: float = 20.0  # likelihood ratio (G squared) it needs
    least_weight: float = 3.0  # log odds it needs; weaker signs add up in long texts and mean little
    listed_weight: float = 3.0  # weight of a listed insult that labels do not weigh higher
    threat_weight: float = 3.0
    power: float = 1.5  # of the norm by which clauses make up a document


#: Log odds stay as they are up to the first and come near the second.
BENDS, BOUND = 15.0, 30.0


@dataclass(frozen=True)
class Transducer:
    """Arcs by (state, symbol) as (next state, written symbol, factor, constant); others copy the symbol.

    ``fade`` names the state that follows when a symbol has no arc of its own.
    """

    arcs: dict
    fade: dict

    def step(self, state: int, symbol: int) -> tuple[int, int, float, float]:
        return self.arcs.get((state, symbol)) or (self.fade[state], symbol, 1.0, 0.0)


def _window(trigger: int, length: int, rewrite: dict) -> Transducer:
    """For ``length`` words after the trigger, symbols are rewritten to (symbol, factor)."""
    arcs, fade = {(0, trigger): (length, trigger, 1.0, 0.0)}, {0: 0}
    for left in range(1, length + 1):
        fade[left] = left - 1
        arcs[left, trigger] = (length, trigger, 1.0, 0.0)
        for symbol, (written, factor) in rewrite.items():
            arcs[left, symbol] = (left - 1, written, factor, 0.0)
    return Transducer(arcs, fade)


def negation(length: int = 2) -> Transducer:
    return _window(NEGATION, length, {INSULT: (NOT_INSULT, 0.1), THREAT: (NOT_THREAT, 0.0)})


def reported(length: int = 12) -> Transducer:
    return _window(REPORT, length, {INSULT: (SAID_INSULT, 0.3), THREAT: (SAID_THREAT, 0.0)})


def threat(length: int = 3) -> Transducer:
    """A threat counts after a modal, or once a target follows it; alone it is worth nothing."""
    arcs, fade = {}, {0: 0}
    modal, waiting = range(1, length + 1), range(length + 1, 2 * length + 1)
    for s in (0, *modal, *waiting):
        arcs[s, MODAL] = (modal[-1], MODAL, 1.0, 0.0)
        arcs[s, THREAT] = (waiting[-1], OTHER, 0.0, 0.0)
    for s in modal:
        fade[s] = s - 1
        arcs[s, THREAT] = (0, CARRIED_OUT, 1.0, 0.0)
    for s in waiting:
        fade[s] = s - 1 if s > waiting[0] else 0
        arcs[s, TARGET] = (0, CARRIED_OUT, 0.0, Settings.threat_weight)
    return Transducer(arcs, fade)


def target(length: int = 4) -> Transducer:
    """An insult counts for half alone and for more shortly after a target; a target shortly after an insult adds to it."""
    arcs, fade = {}, {0: 0}
    after_target, after_insult = range(1, length + 1), range(length + 1, 2 * length + 1)
    for s in (0, *after_target, *after_insult):
        arcs[s, TARGET] = (after_target[-1], TARGET, 1.0, 0.0)
        arcs[s, INSULT] = (after_insult[-1], INSULT, 0.5, 0.0)
    for s in after_target:
        fade[s] = s - 1
        arcs[s, INSULT] = (s - 1, AIMED, 1.3, 0.0)
    for s in after_insult:
        fade[s] = s - 1 if s > after_insult[0] else 0
        arcs[s, TARGET] = (after_target[-1], AIMED, 0.0, 1.5)
    return Transducer(arcs, fade)


def compose(*parts: Transducer) -> list[list[tuple[int, float, float]]]:
    """One machine for the cascade: by state and read symbol, (next state, factor, constant)."""
    names, machine, k = {(0,) * len(parts): 0}, [], 0
    while k < len(names):
        state, row = list(names)[k], []
        for symbol in range(REPORT + 1):
            following, factor, constant = [], 1.0, 0.0
            for part, s in zip(parts, state):
                s, symbol, f, c = part.step(s, symbol)
                factor, constant = factor * f, constant * f + c
                following.append(s)
            counts = symbol in (INSULT, AIMED, NOT_INSULT, SAID_INSULT, CARRIED_OUT)
            row.append((names.setdefault(tuple(following), len(names)), factor * counts, constant * counts))
        machine.append(row)
        k += 1
    return machine


def grammar():
    return compose(negation(), reported(), threat(), target())


@dataclass(frozen=True)
class Model:
    """Learned insults (a word, or its beginning with ``*``) with their weights, and the curve."""

    insults: dict
    intercept: float
    slope: float
    settings: Settings


class Reader:
    """Reads texts with a model; words looked up are remembered."""

    def __init__(self, model: Model, remembered: int = 200_000):
        s = model.settings
        self.model, self.machine, self.remembered, self.memo = model, grammar(), remembered, {}
        self.fixed = {}
        for words, symbol, weight in (
            (INSULTS, INSULT, s.listed_weight),
            (THREATS, THREAT, s.threat_weight),
            (TARGETS, TARGET, 0.0),
            (MODALS, MODAL, 0.0),
            (NEGATIONS, NEGATION, 0.0),
            (REPORTS, REPORT, 0.0),
            (QUOTES, REPORT, 0.0),
        ):
            self.fixed.update({w: (symbol, weight) for w in words})
        self.lengths = range(s.shortest, s.longest + 1)

    def look_up(self, word: str) -> tuple[int, float] | int:
        """Symbol and weight of a word, or 0 for words that mean nothing, or -1 at the end of a clause."""
        if word in ENDS:
            return -1
        known = self.model.insults
        learned = max([known.get(word, 0.0), *(known.get(word[:n] + "*", 0.0) for n in self.lengths if n <= len(word))])
        symbol, weight = self.fixed.get(word, (OTHER, 0.0))
        if learned and symbol in (OTHER, INSULT):
            return INSULT, max(learned, weight)
        return (symbol, weight) if symbol else 0

    def value(self, text: str | None) -> float:
        """The norm of the clause scores of a whole text."""
        words, memo = WORDS.findall((text or "").lower()), self.memo
        if len(memo) > self.remembered:
            memo.clear()
        read = list(map(memo.get, words))
        if None in read:
            for w in {w for w, x in zip(words, read) if x is None}:
                memo[w] = self.look_up(w)
            read = list(map(memo.get, words))
        if not any(x and x != -1 and x[0] in (INSULT, THREAT) for x in set(read)):
            return 0.0
        total, clause, state, power = 0.0, 0.0, 0, self.model.settings.power
        for x in read:
            if x == -1:
                total, clause, state = total + max(clause, 0.0) ** power, 0.0, 0
                continue
            symbol, weight = x or (OTHER, 0.0)
            state, factor, constant = self.machine[state][symbol]
            clause += factor * weight + constant
        return (total + max(clause, 0.0) ** power) ** (1 / power)


def _beginnings(text: str | None, settings: Settings) -> set[str]:
    found = set()
    for w in set(WORDS.findall((text or "").lower())):
        if len(w) >= settings.shortest and w not in ENDS:
            found.add(w)
            found.update(w[:n] + "*" for n in range(settings.shortest, min(len(w), settings.longest) + 1))
    return found


def _counted(settings: Settings, wanted: frozenset | None):
    """Documents per entry and task; where ``wanted`` is given, only for those entries."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                entries = _beginnings(text, settings)
                counts.update(entries if wanted is None else entries & wanted)
            if len(counts) > 300_000:
                yield pd.DataFrame(counts.items(), columns=["entry", "n"])
                counts.clear()
        yield pd.DataFrame(counts.items(), columns=["entry", "n"])

    return each


def _document_counts(docs: DataFrame, settings: Settings, wanted: frozenset | None = None) -> DataFrame:
    counts = docs.select("text").mapInPandas(_counted(settings, wanted), "entry string, n long")
    return counts.groupBy("entry").agg(F.sum("n").alias("n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings, folds: int, held: int) -> DataFrame:
    """Text and toxic (0, 1) of at most ``settings.sample`` labelled documents that may teach."""
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & learning_rows(F.col("id"), folds, held))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(settings.sample)
    )
    # The sample has a bound, so it may be broadcast; documents are not shuffled.
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), "id").select("text", "toxic")


#: Seeds of the signatures by which copies are told.
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def signatures(text: str | None) -> list[int]:
    """Smallest hashes of three-word shingles under three seeds; near copies share most of them."""
    words = (text or "").lower().encode().split()
    shingles = set(zip(words, words[1:], words[2:])) or {tuple(words)}
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(x)) for x in shingles], dtype=np.uint64)
    return [int((hashes * seed).min().view(np.int64)) for seed in SEEDS | np.uint64(1)]


def without_copies(sample: DataFrame) -> DataFrame:
    """The sample with few near copies left: a word all copies of one text hold must not count for each of them.

    Copies with different labels all stay. Which of them stay does not depend on the order of rows.
    """
    each = F.pandas_udf(lambda texts: pd.Series([signatures(t) for t in texts]), "array<long>")
    signed = sample.withColumn("signatures", each("text"))
    for k in range(len(SEEDS)):
        kept = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "signatures")).alias("kept")
        signed = signed.groupBy("toxic", F.col("signatures")[k].alias("signature")).agg(kept).select("toxic", "kept.*")
    return signed.select("text", "toxic")


def fit(sample: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn insults and the curve from ``text, toxic``; the sample has a bound, and so has what is collected."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, -3.0, 1.5, settings)
    found = _document_counts(sample.filter("toxic = 1"), settings).filter(F.col("n") >= settings.least_documents)
    hits = {r["entry"]: r["n"] for r in found.collect()}
    misses = {r["entry"]: r["n"] for r in _document_counts(sample.filter("toxic = 0"), settings, frozenset(hits)).collect()}

    def evidence(t: int, c: int) -> float:
        parts = ((t, toxic), (c, clean), (toxic - t, toxic), (clean - c, clean))
        share = ((t + c) / (toxic + clean),) * 2 + (1 - (t + c) / (toxic + clean),) * 2
        return 2 * sum(n * math.log(n / (of * s)) for (n, of), s in zip(parts, share) if n and s)

    weights = {}
    for entry, t in hits.items():
        c = misses.get(entry, 0)
        weight = math.log((t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1)))
        if weight >= settings.least_weight and evidence(t, c) >= settings.evidence:
            weights[entry] = weight
    # A beginning says nothing more when one longer beginning or word accounts for nearly all it was found in.
    longer: dict[str, int] = {}
    for entry in weights:
        stem = entry.rstrip("*")
        shorter = [stem[:-1] + "*"] if entry.endswith("*") else [stem[:n] + "*" for n in range(settings.shortest, len(stem) + 1)]
        for s in shorter:
            longer[s] = max(longer.get(s, 0), hits[entry])
    insults = {e: w for e, w in weights.items() if not e.endswith("*") or longer.get(e, 0) < 0.9 * hits[e]}
    model = Model(insults, 0.0, 1.0, settings)
    value = valued(model)
    bins = sample.select(F.round(value("text"), 1).alias("value"), "toxic").groupBy("value", "toxic").count().collect()
    intercept, slope = curve([(r["value"], r["toxic"], r["count"]) for r in bins])
    return Model(insults, intercept, slope, settings)


def curve(bins: list[tuple[float, int, int]], ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over (value, label, rows), by damped Newton steps.

    Values above 20 pull no more than 20 does.
    """
    x, y, n = (np.array(v, dtype=float) for v in zip(*bins))
    x = np.minimum(x, 20.0)
    design, at = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ at))
        slope = design.T @ (n * (y - p)) - np.array([0, ridge]) * at
        bend = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, ridge])
        step = np.linalg.solve(bend, slope)
        at += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(max(at[1], 1e-3))


def valued(model: Model):
    """A column function: text to the norm of its clause scores."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model)
        for texts in batches:
            yield pd.Series([reader.value(t) for t in texts], dtype="float64")

    return F.pandas_udf(each, "double")


def bent(odds):
    """Log odds that rise ever more slowly beyond ``BENDS``, so that none is cut off and their scores stay below 1."""
    room = BOUND - BENDS
    return F.when(odds <= BENDS, odds).otherwise(BENDS + room * (1 - F.exp((BENDS - odds) / room)))


def scored(df: DataFrame, name: str, model: Model, text: str = "text") -> DataFrame:
    """``df`` with a column ``name``: the score of its whole text, from 0 to 1."""
    odds = F.lit(model.intercept) + F.lit(model.slope) * valued(model)(column(text))
    return df.withColumn(name, odds).withColumn(name, 1 / (1 + F.exp(-bent(column(name)))))


def fitted(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 5, held: int = 0) -> Model:
    """A model learned from the documents that are labelled and not held out."""
    sample = stored(labelled_sample(docs, labels, settings, folds, held), "labelled")
    return fit(stored(without_copies(sample), "labelled"), settings)
