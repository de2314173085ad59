"""Toxicity by two class-conditional Kneser-Ney models.

Words are spelled by letter n-grams of order `ORDER` within the word. Each class (toxic, ordinary) has its
own counts of the highest order with absolute discounting; the mass discounted from either backs off to one
shared chain of lower orders with continuation counts of both classes, so a rare expression that
neither class knows well is about as likely under both.

A text is compared passage by passage: over every run of `PASSAGE` words (a shorter text is one passage) the mean
log-likelihood per word under the toxic model less that under the ordinary one. Its margin is that of its most toxic
passage, so a long text is not diluted. A word repeated at once counts once there: its repeats are no further
evidence. A logistic curve fitted on labelled texts that trained neither
model turns the margin into a score.

The models are fitted on a bounded sample: of each class the `SAMPLE_DOCS` labelled documents of the smallest id
hashes. Scoring reads whole texts of all documents.
"""

import math
import re
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from flowlattice.llm import common

SAMPLE_DOCS = {0: 6000, 1: 3000}
ORDER, DISCOUNT, PASSAGE = 6, 0.95, 3
CALIBRATE_EVERY = 3
THRESHOLD = 0.7
CACHED_WORDS, CACHED_GRAMS = 180_000, 180_000
_START, _END = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text):
    return _WORD.findall((text or "").lower())


def spelled(word):
    """The n-grams of the highest order that spell a word and its end."""
    padded = _START * (ORDER - 1) + word + _END
    return [padded[i:i + ORDER] for i in range(len(word) + 1)]


class SharedBackoff:
    """Two classes' highest orders over one chain of continuation counts."""

    def __init__(self, counts):
        """`counts`: {(label, n-gram): count}."""
        self.top = [Counter(), Counter()]
        for (label, gram), n in counts.items():
            self.top[label][gram] += n
        self.top_context = [self._by_context(c) for c in self.top]
        self.lower, self.lower_context = [], []
        grams = set(self.top[0]) | set(self.top[1])
        while len(next(iter(grams), "")) > 1:
            shorter = Counter(g[1:] for g in grams)
            self.lower.insert(0, shorter)
            self.lower_context.insert(0, self._by_context(shorter))
            grams = set(shorter)
        self.letters = max(2, len(grams) + 1)

    @staticmethod
    def _by_context(counts):
        """{context: (sum of counts, different next letters)}."""
        found = {}
        for gram, n in counts.items():
            total, types = found.get(gram[:-1], (0, 0))
            found[gram[:-1]] = (total + n, types + 1)
        return found

    def _discounted(self, counts, contexts, gram, below):
        total, types = contexts.get(gram[:-1], (0, 0))
        if not total:
            return below
        return max(counts.get(gram, 0) - DISCOUNT, 0.0) / total + DISCOUNT * types / total * below

    def shared(self, gram):
        p = 1.0 / self.letters
        for k, (counts, contexts) in enumerate(zip(self.lower, self.lower_context), 1):
            p = self._discounted(counts, contexts, gram[-k:], p)
        return p

    def log_likelihoods(self, gram):
        """(ordinary, toxic) log-likelihood of the last letter of an n-gram of the highest order."""
        below = self.shared(gram)
        return [math.log(self._discounted(self.top[label], self.top_context[label], gram, below)) for label in (0, 1)]

    def ratio(self, gram):
        """Toxic less ordinary log-likelihood; nought where neither class knows the context."""
        context = gram[:-1]
        if context not in self.top_context[0] and context not in self.top_context[1]:
            return 0.0
        ordinary, toxic = self.log_likelihoods(gram)
        return toxic - ordinary


class Scorer:
    """Margins of texts; ratios of words and of n-grams are remembered up to a bound on memory."""

    def __init__(self, model):
        self.model, self.known, self.grams = model, common.Recent(CACHED_WORDS), common.Recent(CACHED_GRAMS)

    def _ratio(self, word):
        ratio = self.known.recall(word)
        if ratio is not None:
            return ratio
        grams, ratio = self.grams, 0.0
        for gram in spelled(word):
            one = grams.get(gram)
            if one is None:
                one = grams.recall(gram)
            if one is None:
                one = grams[gram] = self.model.ratio(gram)
            ratio += one
        self.known[word] = ratio
        return ratio

    def margin(self, text):
        self.known.tidy()
        self.grams.tidy()
        get, words = self.known.get, words_of(text)
        words = [w for w, before in zip(words, [None, *words]) if w != before]
        if not words:
            return 0.0
        ratios = np.fromiter((r if (r := get(w)) is not None else self._ratio(w) for w in words), np.float64, len(words))
        width = min(PASSAGE, len(ratios))
        sums = np.concatenate(([0.0], np.cumsum(ratios)))
        return float((sums[width:] - sums[:-width]).max() / width)


def scorer_of(name, counts):
    return common.held(name, lambda: Scorer(SharedBackoff(counts.value)))


def fitted_curve(margins, labels):
    """(slope, offset) of a logistic curve with both classes weighing the same, slightly regularised."""
    x, y = np.asarray(margins, float), np.asarray(labels, float)
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    center, scale = x.mean(), x.std() or 1.0
    design, beta = np.stack([(x - center) / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - 1e-3 * beta * [1, 0]
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-9])
        move = np.linalg.solve(curve, slope)
        beta += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * center / scale)


def labelled_sample(docs, labels):
    """(text, label, calibrates) of the sampled labelled documents that are not held out."""
    known = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id")
             .agg((F.max("toxic") > 0).cast("int").alias("label"))
             .where(~common.crc_is("doc_id", 3, 1)).withColumn("_h", F.xxhash64("doc_id")))
    ids = None
    for label, bound in SAMPLE_DOCS.items():
        part = known.where(F.col("label") == label).orderBy("_h", "doc_id").limit(bound)
        ids = part if ids is None else ids.unionByName(part)
    # At most SAMPLE_DOCS rows of numbers.
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(
        "text", "label", (F.pmod(F.col("_h"), F.lit(CALIBRATE_EVERY)) == 0).alias("calibrates"))


def fit(docs, labels):
    """(name, broadcast counts, slope, offset), or None where no document has a label of either class."""
    sample = labelled_sample(docs, labels)

    def grams(columns):
        counts = Counter()
        for label, text in zip(columns["label"], columns["text"]):
            counts.update((label, w) for w in words_of(text))
        spelt = Counter()
        for (label, word), n in counts.items():
            for gram in spelled(word):
                spelt[label, gram] += n
        return {"label": [k[0] for k in spelt], "gram": [k[1] for k in spelt], "n": list(spelt.values())}

    counted = common.map_rows(sample.where("not calibrates").select("label", "text"), grams, "label int, gram string, n bigint")
    rows = counted.groupBy("label", "gram").agg(F.sum("n").alias("n")).collect()  # bounded by the sample
    if len({r["label"] for r in rows}) < 2:
        return None
    shipped = docs.sparkSession.sparkContext.broadcast({(r["label"], r["gram"]): r["n"] for r in rows})
    name = uuid.uuid4().hex
    held = sample.where("calibrates").select("label", "text")

    def margins(columns):
        scorer = scorer_of(name, shipped)
        return {"label": columns["label"], "margin": [scorer.margin(t) for t in columns["text"]]}

    seen = common.map_rows(held, margins, "label int, margin double").collect()
    return (name, shipped, *fitted_curve([r["margin"] for r in seen], [r["label"] for r in seen]))


MADE = "score double, predicted int, margin double"


def toxicity(docs, labels, model=None, carry=()):
    """Score every row of `docs` (doc_id, text): score 0 to 1, predicted 1 from `THRESHOLD` on.

    Null and empty texts have margin 0. Without labels of both classes every score is 0. Null ids are scored like
    others; null labels teach nothing; a document with several labels is toxic if one says so.
    """
    model = model or fit(docs, labels)
    if model is None:
        kept = docs.select("doc_id", *[c for c in dict.fromkeys(carry) if c not in ("doc_id", "score", "predicted", "margin")])
        return kept.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("margin"))
    name, shipped, slope, offset = model

    def step(columns):
        scorer = scorer_of(name, shipped)
        margins = [scorer.margin(t) for t in columns["text"]]
        scores = [1 / (1 + math.exp(-max(-60.0, min(60.0, slope * m + offset)))) for m in margins]
        return {"score": scores, "predicted": [int(s >= THRESHOLD) for s in scores], "margin": margins}

    return common.add_columns(docs, "text", step, MADE, ("doc_id", *carry))


def op2_toxicity(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return toxicity(docs, labels).withColumn("held_out", common.crc_is("doc_id", 3, 1)).select(
        "doc_id", "held_out", "score", "predicted", "margin")
