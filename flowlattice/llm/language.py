"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. One binary classifier per bit (logistic regression over hashed byte
2-grams and 3-grams, square-root counts scaled to length 1) predicts that bit of a text's language. Decoding is
weighted by loss: a language's distance is the sum of the bits' logistic losses against its codeword, each bit
weighted by how well it did in training; the nearest codeword wins. A text is ambiguous when the runner-up
is nearly as near.

The classifiers are fitted on a bounded sample: about `SAMPLE_DOCS` documents, as many of each language, picked by a hash of
the id. Prediction reads whole texts.
"""

import numpy as np
from pyspark.sql import functions as F

from flowlattice.llm import common

SAMPLE_DOCS, LEAST_PER_LANGUAGE = 3000, 20
BITS = 13
ROUNDS, RATE = 150, 0.3
AMBIGUOUS_GAP = 2.0
UNKNOWN = "und"
_GRAMS = (2, 3)
# Multipliers of the hash.
_STEP, _LAST = np.uint32(16777619), np.uint32(2654435761)


def features(text):
    """Hashed n-gram counts of a whole text, as square roots scaled to length 1."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    counts = np.zeros(1 << BITS, np.int64)
    for n in _GRAMS:
        m = len(raw) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ raw[k:k + m]) * _STEP
            h ^= h >> np.uint32(13)
        counts += np.bincount((h * _LAST) >> np.uint32(32 - BITS), minlength=1 << BITS)
    v = np.sqrt(counts.astype(np.float32))
    length = np.linalg.norm(v)
    return v / length if length else v


def codewords(languages):
    """One row of +1 and -1 per language: all different splits for up to five, else random rows far apart."""
    if languages <= 5:
        splits = [[(mask >> i) & 1 for i in range(languages)] for mask in range(1, max(2, 1 << (languages - 1)))]
        return (np.array(splits).T * 2 - 1).astype(np.float32)
    bits = 8 * int(np.ceil(np.log2(languages))) + 8
    best, apart = None, -1
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((languages, bits)) < 0.5, -1, 1).astype(np.float32)
        distance = (bits - (code @ code.T)) / 2 + np.eye(languages) * bits
        if distance.min() > apart and (np.abs(code.sum(axis=0)) < languages).all():
            best, apart = code, distance.min()
    return best


class Decoder:
    def __init__(self, languages, code, weights, offsets, trust):
        self.languages, self.code, self.weights, self.offsets, self.trust = languages, code, weights, offsets, trust

    def distances(self, x):
        f = x @ self.weights + self.offsets
        return (np.logaddexp(0, -f[..., None, :] * self.code) * self.trust).sum(axis=-1)

    def predict(self, text):
        """(language, score, ambiguous)."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        d = self.distances(features(text))
        shares = np.exp(-(d - d.min()))
        order = np.argsort(d, kind="stable")
        gap = d[order[1]] - d[order[0]] if len(d) > 1 else np.inf
        return self.languages[order[0]], float(1 / shares.sum()), bool(gap < AMBIGUOUS_GAP)


def fitted(x, labels, languages):
    """A decoder fitted on rows of features; all languages weigh the same."""
    code = codewords(len(languages))
    y = code[labels]
    weight = (1 / np.maximum(np.bincount(labels, minlength=len(languages)), 1) / len(languages))[labels][:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, ROUNDS + 1):
        pull = -y / (1 + np.exp(np.clip(y * (x @ w + b), -50, 50))) * weight
        slope = x.T @ pull + 1e-6 * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        w -= RATE * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-8)
        b -= pull.sum(axis=0)
    loss = (np.logaddexp(0, -y * (x @ w + b)) * weight).sum(axis=0)
    trust = 1 / (0.05 + loss)
    return Decoder(languages, code, w, b, (trust / trust.mean()).astype(np.float32))


def fit(docs):
    """A decoder fitted on a sample of the rows of `docs` (doc_id, text, lang) that are not held out."""
    known = docs.where("lang is not null and text is not null").where(~common.crc_is("doc_id", 3, 1))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Decoder([], None, None, None, None)
    share = max(LEAST_PER_LANGUAGE, SAMPLE_DOCS // len(languages))
    fractions = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, share / counts[k]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sampled = known.where(draw < fractions[F.col("lang")]).select("lang", "text")

    def sparse(columns):
        rows = [features(t) for t in columns["text"]]
        return {"lang": columns["lang"], "i": [np.flatnonzero(v).astype(np.int16).tobytes() for v in rows],
                "v": [v[v > 0].astype(np.float16).tobytes() for v in rows]}

    rows = common.map_rows(sampled, sparse, "lang string, i binary, v binary").collect()
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for k, row in enumerate(rows):
        x[k, np.frombuffer(row["i"], np.int16)] = np.frombuffer(row["v"], np.float16)
    at = {lang: k for k, lang in enumerate(languages)}
    order = np.argsort([r["lang"] for r in rows], kind="stable")
    return fitted(x[order], np.array([at[rows[k]["lang"]] for k in order], np.int64), languages)


MADE = "lang_pred string, score double, ambiguous boolean"


def identify(docs, decoder=None, carry=()):
    """The language of every row of `docs` (doc_id, text, and lang for learning).

    Null texts and texts without a letter are `und` with score 0, as is everything when no language was learned.
    Null languages teach nothing. Repeated rows are predicted each.
    """
    decoder = decoder or fit(docs)

    def step(columns):
        made = [decoder.predict(t) for t in columns["text"]]
        return {name: [m[k] for m in made] for k, name in enumerate(("lang_pred", "score", "ambiguous"))}

    return common.add_columns(docs, "text", step, MADE, ("doc_id", *carry))


def op5_language(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs).withColumn("held_out", common.crc_is("doc_id", 3, 1)).select(
        "doc_id", "held_out", "lang_pred", "score", "ambiguous")
