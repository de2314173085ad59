"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of `WINDOW` consecutive words (a shorter item is one window). A window is a set of
shingles, each two neighbouring words (the word itself for a window of one word). Shingles are ordered by
rarity: how often they occur over all documents. As a document must contain a window whole, the necessary prefix of a
window is its rarest shingle alone: only where that shingle occurs can the window start. The join on prefix shingles
gives candidate places, the length bound drops those that stick out of the document, the position of the
shingle in its window fixes where the window starts, and the words there are compared one by one.

Windows reach the tasks in blocks of at most `BLOCK_WINDOWS` windows; a larger benchmark takes more blocks, one
after the other, and each block adds to what the ones before have found. Documents are never shuffled.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlattice.llm import common

WINDOW = 10
BLOCK_WINDOWS = 200_000
CANDIDATES_AT_ONCE = 1_000_000

# A word is a run of 0-9, a-z (A-Z lower-cased) and whatever lies beyond ASCII.
_BLANK = bytes(b if b >= 0x80 or chr(b).isascii() and chr(b).isalnum() else 32 for b in range(256))


def words_of(text):
    return (text or "").encode("utf-8", "surrogatepass").translate(_BLANK).lower().split()


def item_windows(benchmark):
    """Distinct (item_id as text, window as space-joined words); null and wordless items have none."""
    def cut(columns):
        pairs = set()
        for item, text in zip(columns["item"], columns["text"]):
            words = words_of(text)
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                pairs.add((item, b" ".join(words[i:i + WINDOW])))
        return {"item": [p[0] for p in pairs], "window": [p[1] for p in pairs]}

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return common.map_rows(items, cut, "item string, window binary").distinct()


class Block:
    """The windows of one block as arrays, and the join of a document with them."""

    def __init__(self, pairs):
        windows = sorted({w for _, w in pairs})
        at = {w: i for i, w in enumerate(windows)}
        split = [w.split(b" ") for w in windows]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for words in split for w in words}))}
        self.base = len(self.vocabulary) + 1
        self.length = np.array([len(s) for s in split], np.int64)
        self.words = np.zeros((len(split), int(self.length.max(initial=1))), np.int64)
        for i, words in enumerate(split):
            self.words[i, :len(words)] = [self.vocabulary[w] for w in words]
        self.items = [[] for _ in windows]
        for item, w in sorted(pairs):
            self.items[at[w]].append(item)
        codes = self.words[:, :-1] * self.base + self.words[:, 1:] if self.words.shape[1] > 1 else np.zeros((len(split), 0), np.int64)
        inside = np.arange(codes.shape[1])[None, :] < (self.length - 1)[:, None]
        self.shingles = [np.where(n == 1, row[:1] * self.base, 0) if n == 1 else c[keep]
                         for n, row, c, keep in zip(self.length, self.words, codes, inside)]
        self.codes = np.unique(np.concatenate(self.shingles)) if windows else np.zeros(0, np.int64)
        self.has_single = bool((self.length == 1).any())

    def order(self, counts):
        """Fix each window's prefix, its rarest shingle by `counts` (aligned with `codes`; ties by code)."""
        rarest = []
        for w, codes in enumerate(self.shingles):
            k = min(range(len(codes)), key=lambda j: (counts[np.searchsorted(self.codes, codes[j])], codes[j], j))
            rarest.append((int(codes[k]), w, k))
        rarest.sort()
        self.prefix_codes, starts = np.unique([r[0] for r in rarest], return_index=True)
        self.prefix_at = np.append(starts, len(rarest))
        self.prefix_window = np.array([r[1] for r in rarest], np.int64)
        self.prefix_offset = np.array([r[2] for r in rarest], np.int64)
        del self.shingles
        return self

    def ids(self, words):
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def places(self, ids, codes):
        """(position, index in `codes`) of every shingle of the document found in sorted `codes`."""
        found = []
        pairs = ids[:-1] * self.base + ids[1:]
        positions = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        singles = np.flatnonzero(ids) if self.has_single else np.zeros(0, np.int64)
        for where, code in ((positions, pairs[positions]), (singles, ids[singles] * self.base)):
            index = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            same = codes[index] == code if len(codes) else np.zeros(len(code), bool)
            found.append((where[same], index[same]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def join(self, words):
        """(hit mask over the words, occurring windows)."""
        ids = self.ids(words)
        hit, windows = np.zeros(len(words) + 1, np.int64), set()
        position, index = self.places(ids, self.prefix_codes)
        many = self.prefix_at[index + 1] - self.prefix_at[index]
        ends = np.cumsum(many)
        low = 0
        while low < len(position):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CANDIDATES_AT_ONCE)))
            n, first = many[low:high], self.prefix_at[index[low:high]]
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            window = self.prefix_window[each]
            start = np.repeat(position[low:high], n) - self.prefix_offset[each]
            length = self.length[window]
            fits = (start >= 0) & (start + length <= len(words))
            window, start, length = window[fits], start[fits], length[fits]
            for k in range(self.words.shape[1]):
                here = (k >= length) | (ids[np.minimum(start + k, len(ids) - 1)] == self.words[window, k])
                window, start, length = window[here], start[here], length[here]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + length, -1)
            windows.update(window.tolist())
            low = high
        return np.cumsum(hit[:-1]) > 0, windows


def _counted(docs, block, shipped, name):
    """How often each shingle of the block occurs over all documents: one number per shingle on the driver."""
    def count(batches):
        block = _block_of(name, shipped)
        sums = np.zeros(len(block.codes), np.int64)
        for batch in batches:
            for text in common.each(batch.column(0)):
                sums += np.bincount(block.places(block.ids(words_of(text)), block.codes)[1], minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"i": pa.array(some, pa.int64()), "n": pa.array(sums[some], pa.int64())})

    counts = np.zeros(len(block.codes), np.int64)
    for row in docs.select("text").mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[row["i"]] = row["n"]
    return counts


def _block_of(name, shipped):
    def build():
        block = Block.__new__(Block)
        block.__dict__.update(shipped.value)
        return block

    return common.held(name, build)


def _joined(frame, name, shipped, first, carry):
    """Add one block's finds to the columns _hit (packed mask) and _items of `frame`."""
    found = [] if first else ["_hit", "_items"]
    read = frame.select(*carry, "_text", *found)
    struct, arrow = common.arrow_schema(
        "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in carry)
        + "_text string, _hit binary, _items array<string>")

    def run(batches):
        block = _block_of(name, shipped)
        for batch in (part for whole in batches for part in common.slices(whole)):
            before = [c.to_pylist() for c in batch.columns[len(carry) + 1:]] or [None, None]
            hits, items = [], []
            for i, text in enumerate(batch.column(len(carry)).to_pylist()):
                words = words_of(text)
                hit, windows = block.join(words)
                names = {item for w in windows for item in block.items[w]}
                if before[0] is not None:
                    hit |= np.unpackbits(np.frombuffer(before[0][i], np.uint8), count=len(words)).astype(bool)
                    names |= set(before[1][i])
                hits.append(np.packbits(hit).tobytes())
                items.append(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(batch.columns[:len(carry) + 1], arrow)]
                + [pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], schema=arrow)

    return read.mapInArrow(run, struct)


MADE = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>"


def decontaminate(docs, benchmark, carry=()):
    """What of every row of `docs` (doc_id, text) lies in `benchmark` (item_id, text).

    Null and empty texts have no words and are clean. Null benchmark texts are no items; a null item id counts as
    an empty one; items of one id are one item. Repeated documents are judged each. With an empty
    benchmark all documents are clean.
    """
    spark = docs.sparkSession
    carry = [c for c in dict.fromkeys(("doc_id", *carry)) if c not in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "_text", "_hit", "_items")]
    windows = common.materialized(item_windows(benchmark), "windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    frame = docs.select(*carry, F.col("text").alias("_text"))
    for k in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        block = Block([(r["item"], bytes(r["window"])) for r in part.collect()])
        name = uuid.uuid4().hex
        counts = _counted(docs, block, spark.sparkContext.broadcast(dict(block.__dict__)), name + "c") if len(block.codes) else []
        frame = _joined(frame, name, spark.sparkContext.broadcast(dict(block.order(counts).__dict__)), k == 0, carry)

    def digest(columns):
        n_words = [len(words_of(t)) for t in columns["_text"]]
        n_hit = [int(np.unpackbits(np.frombuffer(h, np.uint8), count=n).sum()) for h, n in zip(columns["_hit"], n_words)]
        items = columns["_items"]
        return {"n_words": n_words, "n_hit": n_hit, "n_items": [len(i) for i in items],
                "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items],
                "contaminated": [n > 0 for n in n_hit], "items": items}

    return common.add_columns(frame, ("_text", "_hit", "_items"), digest, MADE, carry)


def op4_decontamination(spark, sf_dir):
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("items")
