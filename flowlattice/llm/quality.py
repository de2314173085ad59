"""Quality rules by distribution divergence.

A document is described by two histograms: classes of characters (small letters, capitals, letters
beyond ASCII, digits, punctuation, symbols; white space is left out) and the most common words of a language
plus one bin for other words and one for words without any letter or digit. Both are compared with the same histograms of every language's
documents by the Jensen-Shannon divergence (base 2, 0 to 1); the nearest language counts. Short
documents have noisy histograms, so each comparison has a guard on length, and a document that
passes no guard is kept unless a base rule fails it.

The reference histograms are sums over all documents of a language, and the common words are those in the most of all its
documents. Every language has a reference; one from fewer than `MIN_LANGUAGE_DOCS` documents is not reliable: it
fails no text of its language and excuses none of another.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlattice.llm import common

COMMON_WORDS = 120
MIN_CHARS, MAX_CLASS_DIVERGENCE = 200, 0.10
MIN_WORDS, MAX_WORD_DIVERGENCE = 60, 0.30
MIN_BASE_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
MIN_LANGUAGE_DOCS = 20

# The symbols that the base rules count.
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_CLASSES = ("small", "capital", "beyond", "digit", "mark", "symbol", "other")
_SKIP = len(_CLASSES)
_STRIP = b".,;:!?\"'()-_" + SYMBOLS


def _byte_classes():
    kind = np.full(256, _CLASSES.index("other"), dtype=np.int64)
    for name, members in (("small", b"abcdefghijklmnopqrstuvwxyz"), ("capital", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                          ("digit", b"0123456789"), ("mark", b".,;:!?'\"()-"),
                          ("symbol", SYMBOLS + b"@^_`~+=[]{}/\\")):
        kind[list(members)] = _CLASSES.index(name)
    kind[0xC0:] = _CLASSES.index("beyond")
    kind[0x80:0xC0] = _SKIP  # the later bytes of a character
    kind[list(_SPACE)] = _SKIP
    return kind


_KIND = _byte_classes()
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_WORD_CHAR = ~np.isin(np.arange(256), list(_SPACE)) & ~((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))


def _byte_counts(raw):
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256)


def _class_counts(by_byte):
    return np.bincount(_KIND, weights=by_byte, minlength=_SKIP + 1)[:_SKIP]


def _bare(word):
    return word.strip(_STRIP).lower()


def repeated_words(words, window=WINDOW):
    """How many words lie in windows of consecutive words found twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    # Ranks of runs of doubling length stay exact: a run is the pair of its first part's rank and the rest's.
    rank, length = ids, 1
    while length < window:
        step = min(length, window - length)
        m = len(words) - length - step + 1
        _, rank = np.unique(rank[:m] * (len(words) + 1) + rank[step:step + m] if step == length
                            else rank[:m] * (len(words) + 1) + ids[length:length + m], return_inverse=True)
        length += step
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text):
    seen, found = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            found += line in seen
            seen.add(line)
    return found


def base_counts(text):
    """The countable facts of one text, as a dict; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, by_byte = raw.split(), _byte_counts(raw)
    return {"n_words": len(words), "word_chars": int(by_byte[_IS_WORD_CHAR].sum()),
            "n_symbols": int(by_byte[_IS_SYMBOL].sum()), "n_dup_lines": duplicate_lines(text),
            "n_repeat_words": repeated_words(words)}, words, by_byte


def divergence(counts, references):
    """Jensen-Shannon divergence of one histogram from each row of `references` (all rows sum to 1)."""
    total = counts.sum()
    if not total or not len(references):
        return np.zeros(len(references))
    bins = np.flatnonzero(counts)
    p, q = counts[bins] / total, references[:, bins]
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        toward = (p * np.log2(p / middle)).sum(axis=1) + np.where(q > 0, q * np.log2(q / middle), 0.0).sum(axis=1)
    # A bin that the text lacks adds its share.
    return np.maximum((toward + 1 - q.sum(axis=1)) / 2, 0.0)


def _chosen_words(docs):
    """{language: common words}: the words in the most documents of the language, of equal ones the last in order."""
    def count(columns):
        counts = Counter()
        for lang, text in zip(columns["lang"], columns["text"]):
            counts.update((lang, w) for w in {_bare(w) for w in common.ascii_lower_words(text)} if w)
        return {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "docs": list(counts.values())}

    counted = common.map_rows(docs.select("lang", "text").where("lang is not null"), count, "lang string, word binary, docs bigint")
    ranked = counted.groupBy("lang", "word").agg(F.sum("docs").alias("docs"))
    # Spark cuts each partition to its own first ranks before a language's words meet.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("docs"), F.desc("word")))
    chosen = {}
    for row in ranked.withColumn("_place", place).where(F.col("_place") <= COMMON_WORDS).select("lang", "word").collect():
        chosen.setdefault(row["lang"], []).append(bytes(row["word"]))
    return chosen


def references(docs):
    """Reference histograms of every language, summed over all documents, and which of them are reliable."""
    every = sorted({w for words in _chosen_words(docs).values() for w in words})
    at = {w: i for i, w in enumerate(every)}
    width = _SKIP + len(every) + 3

    def add_up(batches):
        sums = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, text in zip(langs, texts):
                raw = (text or "").encode("utf-8", "surrogatepass")
                total = sums.setdefault(lang, np.zeros(width))
                total[:_SKIP] += _class_counts(_byte_counts(raw))
                total[_SKIP:-1] += _word_counts(raw.lower().split(), at)
                total[-1] += 1
        for lang, total in sums.items():
            bins = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(bins), "i": bins, "x": total[bins]},
                                             schema=pa.schema([("lang", pa.string()), ("i", pa.int64()), ("x", pa.float64())]))

    parts = docs.select("lang", "text").where("lang is not null").mapInArrow(add_up, "lang string, i bigint, x double")
    sums = {}
    for row in parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():  # languages x bins, whatever the number of documents
        sums.setdefault(row["lang"], np.zeros(width))[row["i"]] = row["x"]
    languages = sorted(sums)
    table = np.array([sums[k] for k in languages]).reshape(len(languages), width)

    def share(x):
        return x / np.maximum(x.sum(axis=1, keepdims=True), 1)

    return {"languages": languages, "reliable": table[:, -1] >= MIN_LANGUAGE_DOCS, "words": at,
            "class_share": share(table[:, :_SKIP]), "word_share": share(table[:, _SKIP:-1])}


def _word_counts(words, at):
    other = len(at)
    bins = (at.get(bare, other) if (bare := w.strip(_STRIP)) else other + 1 for w in words)
    return np.bincount(np.fromiter(bins, np.int64, len(words)), minlength=other + 2)


def judge(text, lang, model):
    """All columns of the verdict for one text and its language.

    A text of a language with a reliable reference is compared with the reliable references, any other with all of them. Only a
    text of a reliable language, or of none where some language is reliable, can be too far from its nearest.
    """
    counts, words, by_byte = base_counts(text)
    n, repeats = counts["n_words"], counts["n_repeat_words"]
    counts["base_failed"] = n < MIN_BASE_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    reliable = [k for k, sure in zip(model["languages"], model["reliable"]) if sure]
    languages, rows = (reliable, model["reliable"]) if lang in reliable else (model["languages"], slice(None))
    of_class = divergence(_class_counts(by_byte), model["class_share"][rows])
    of_words = divergence(_word_counts([w.lower() for w in words], model["words"]), model["word_share"][rows])
    class_far, word_far = (float(x.min()) if len(x) else 0.0 for x in (of_class, of_words))
    judged = bool(reliable) if lang is None else lang in reliable
    strange = judged and (counts["word_chars"] >= MIN_CHARS and class_far > MAX_CLASS_DIVERGENCE
                          or n >= MIN_WORDS and word_far > MAX_WORD_DIVERGENCE)
    nearest = languages[int(np.argmin(of_class + of_words))] if len(of_class) else None
    return counts | {"kept": not counts["base_failed"] and not strange, "class_divergence": class_far,
                     "word_divergence": word_far, "nearest_language": nearest}


MADE = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
        "kept boolean, class_divergence double, word_divergence double, nearest_language string")


def quality_rules(docs, model=None, carry=()):
    """One verdict per row of `docs` (doc_id, text, lang; further columns are ignored).

    Null and empty texts have no words and fail the base rules. Repeated rows get the same verdict each.
    A null language takes no part in the references; its texts may be near any of them. An empty table gives an empty result.
    `carry` names further columns of `docs` to return with the verdict.
    """
    model = model or references(docs)

    def step(columns):
        rows = [judge(text, lang, model) for text, lang in zip(columns["text"], columns["lang"])]
        return {k.split()[0]: [r[k.split()[0]] for r in rows] for k in MADE.split(", ")}

    return common.add_columns(docs, ("text", "lang"), step, MADE, ("doc_id", *carry))


def op6_quality_rules(spark, sf_dir):
    return quality_rules(common.table(spark, sf_dir, "documents"))
