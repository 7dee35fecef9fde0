"""Toxicity: a weighted finite-state pattern grammar over clauses.

Five small transducers read a clause word by word: insults and threats (weighted
terms), targets, negation and reported speech. Their composition walks each
clause once; its state says which of the others is in force, and each term that
is matched is emitted in the channel of that state (plain, aimed at a target,
negated, reported). A document's score is a logistic function of its channels'
weights. The terms (words and word beginnings) and the channel weights are
learned from labelled rows; the function words of the grammar are fixed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import crc_mod, id_text, read, write_read

#: Labelled documents that the terms and weights are learned from, at most, and
#: the longest of them: the learned grammar has a bounded size at every scale.
SAMPLE_DOCUMENTS = 24_000
SAMPLE_CHARS = 20_000
#: A term needs so many toxic documents and so large a share of toxic ones among
#: those that hold it; word beginnings of these lengths are terms as well.
TERM_DOCUMENTS = 3
TERM_SHARE = 0.8
STEMS = (4, 5, 6)
MAX_TERMS = 5_000
THRESHOLD = 0.3

#: Function words of the grammar (en, de, fr, es).
TARGETS = frozenset("""you your yours yourself he she him her they them their these those people
 du dich dir ihr euch sie er ihn ihnen tu toi te vous il elle ils elles eux
 tú te ti usted ustedes él ella ellos ellas""".split())
NEGATIONS = frozenset("""not no never neither nor without isn't aren't wasn't don't doesn't didn't
 nicht kein keine keinen nie niemals ohne pas jamais aucun sans ne nunca jamás ningún sin""".split())
REPORTING = frozenset("""said says say told tells wrote writes claimed called calls quoted reported
 sagte sagt schrieb nannte behauptet dit disait écrit appelé selon dijo dice escribió llamó según""".split())
#: Threat verbs, known without labels.
THREATS = frozenset("""kill hurt destroy attack shoot stab burn beat
 töten umbringen schlagen verletzen tuer frapper détruire blesser matar golpear destruir herir""".split())
NEGATION_REACH = 3
TARGET_REACH = 3

CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CHANNELS = ("plain", "aimed", "negated", "reported", "threat", "threat_aimed", "threat_negated")


def features(text: str) -> set[str]:
    """Words of a text and their beginnings (``stem*``)."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def choose_terms(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Terms and weights (log odds) of (feature, toxic documents, clean documents)."""
    if not toxic or not clean:
        return {}
    found = []
    for feature, a, b in counts:
        if a >= TERM_DOCUMENTS and a >= TERM_SHARE * (a + b):
            odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
            if odds > 1:
                found.append((-a, len(feature), feature, odds))
    return {f: odds for _, _, f, odds in sorted(found)[:MAX_TERMS]}


@dataclass
class Grammar:
    """Weighted terms, channel weights and their bias."""

    terms: dict[str, float]
    weights: tuple[float, ...] = (1.0, 1.3, -0.3, 0.2, 0.1, 0.3, 0.0)
    bias: float = -3.0

    def matcher(self) -> "Matcher":
        return Matcher(self)


class Matcher:
    """The composed transducers of a grammar, for one worker."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.finder = ahocorasick.Automaton()
        for term in [*grammar.terms, *THREATS]:
            self.finder.add_word(term.rstrip("*"), term)
        if len(self.finder):
            self.finder.make_automaton()
        self.memo: dict[str, float] = {}

    def insult(self, word: str) -> float:
        """Weight of a word: of itself or its heaviest beginning, 0 if none."""
        got = self.memo.get(word)
        if got is None:
            terms = self.grammar.terms
            got = max([terms.get(word, 0.0), *(terms.get(word[:n] + "*", 0.0) for n in STEMS if len(word) > n)])
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[word] = got
        return got

    def clause(self, words: list[str]) -> np.ndarray:
        """Weight of each channel in one clause.

        The state is (reach left of a negation, reach left of a target, reported
        or not); a target right behind a term aims it too.
        """
        out = np.zeros(len(CHANNELS))
        negated = aimed = 0
        reported = False
        for i, w in enumerate(words):
            weight = self.insult(w)
            threat = w in THREATS
            if weight or threat:
                at_target = aimed > 0 or any(x in TARGETS for x in words[i + 1:i + 1 + TARGET_REACH])
                if weight:
                    out[3 if reported else 2 if negated else 1 if at_target else 0] += weight
                if threat:
                    out[6 if negated or reported else 5 if at_target else 4] += 1
            negated, aimed = max(0, negated - 1), max(0, aimed - 1)
            if w in NEGATIONS:
                negated = NEGATION_REACH
            if w in TARGETS:
                aimed = TARGET_REACH
            reported = reported or w in REPORTING
        return out

    def channels(self, text: str) -> np.ndarray:
        """Dampened channel weights of a whole text. Clauses without any term
        match nothing, so only those around a term are walked."""
        low = text.lower()
        out = np.zeros(len(CHANNELS))
        if not len(self.finder):
            return out
        done = 0
        for end, term in self.finder.iter(low):
            start = end - len(term.rstrip("*")) + 1
            if start < done or start and low[start - 1].isalpha():
                continue
            left = max(low.rfind(c, 0, start) for c in ".!?;:\n") + 1
            stop = CLAUSE.search(low, end)
            done = stop.start() if stop else len(low)
            out += self.clause(WORD.findall(low[left:done]))
        return np.log1p(out)

    def score(self, x: np.ndarray) -> float:
        z = self.grammar.bias + float(np.dot(self.grammar.weights, x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE_DOCUMENTS) -> Grammar:
    """Learn terms and channel weights from ``docs`` that ``labels`` marks 0 or 1.

    Of the labels (the larger one of an id with two) the ``sample`` first ids by
    hash are used; their texts of up to SAMPLE_CHARS characters are written to
    the shared scratch folder once. Null ids, labels and texts are left out.
    Term counts are added up on the executors; the driver gets the terms that
    pass, and the channel weights of each sampled document.
    """
    ids = (labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                         F.col(f"`{label_col}`").cast("int").alias("label"))
           .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most ``sample`` pairs of numbers, so the broadcast has a fixed bound
    src = (id_text(docs, id_col, text_col).where((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS))
           .join(F.broadcast(ids), "doc_id").select("text", "label"))
    src = write_read(src, "toxicity-sample")

    def count(batches):
        total, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = features(text) | {""}  # the empty feature counts documents
                total.update(own)
                if label:
                    toxic.update(own)
        # what is rare in toxic documents matters only where it is frequent elsewhere
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()),
             pa.array([total[k] - toxic[k] for k in keys], pa.int64())], names=["feature", "a", "b"])

    counts = (src.mapInArrow(count, "feature string, a long, b long")
              .groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
              .where((F.col("feature") == "") | ((F.col("a") >= TERM_DOCUMENTS)
                                                 & (F.col("a") >= TERM_SHARE * (F.col("a") + F.col("b"))))))
    found = [tuple(r) for r in counts.toLocalIterator()]
    toxic, clean = next(((a, b) for f, a, b in found if f == ""), (0, 0))
    grammar = Grammar(choose_terms((r for r in found if r[0]), toxic, clean))
    if not grammar.terms:
        return grammar

    def walk(batches):
        m = grammar.matcher()
        for batch in batches:
            x = [m.channels(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)],
                                             names=["x", "label"])

    seen = [tuple(r) for r in src.mapInArrow(walk, "x array<double>, label int").toLocalIterator()]
    x, y = np.array([r[0] for r in seen]), np.array([r[1] for r in seen], float)
    weights, bias = fit_logistic(x, y)
    return Grammar(grammar.terms, tuple(float(v) for v in weights), float(bias))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], w[-1]


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every whole text.

    A text without any term, also a null or empty one, gets the score of no
    match. Repeated rows give repeated results; an empty table an empty one.
    """
    def run(batches):
        m = grammar.matcher()
        for batch in batches:
            s = [m.score(m.channels(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())],
                names=["doc_id", "score", "predicted"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    grammar = learn(docs, labels.where(crc_mod("doc_id", 4) != 2))
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return score(docs, grammar).select("doc_id", held_out.alias("held_out"), "score", "predicted")
