"""Language-model scores by a weighted backoff automaton.

The model is a word bigram model, smoothed by its unigrams: p(w | h) = (c(h w) + MASS p(w)) / (c(h) + MASS) with
p(w) = (c(w) + 1) / (N + V + 1). As an automaton: every word is a state (the start of a text is one too), an arc per
observed bigram carries log p(w | h), the failure arc of a state carries log(MASS / (c(h) + MASS)) to the root, and
the root's arcs carry log p(w). A text is read once from left to right; the state is the word before.

Nobody needs the whole model in one place, as it grows with the corpus. Documents are cut into blocks of about `BLOCK_TOKENS` tokens.
A block asks for the counts of its own distinct words and bigrams and hands in what it counted in its training documents;
both travel as sorted arrays to shards of the hash space, which add up and answer every block in the order of its questions. The block
then has exactly the part of the automaton that its documents can reach.

Words and bigrams are known by 64-bit hashes. Counts cover all training documents.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F

from flowlattice.llm import common

BLOCK_TOKENS, TOKENS_PER_SHARD = 1_500_000, 1_000_000
MASS = 50.0
CACHED_WORDS = 150_000
_U = np.uint64
# No word holds white space, so these two are no word's hash input.
END, START = xxhash.xxh3_64_intdigest(b"\n"), xxhash.xxh3_64_intdigest(b"\r")
# Odd multipliers that mix hashes.
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def bigram(before, word):
    mixed = (before * _A) ^ (word * _B)
    mixed ^= mixed >> _U(31)
    mixed *= _A
    return mixed ^ (mixed >> _U(29))


class _Words:
    def __init__(self):
        self.known = {}

    def __call__(self, text):
        """Word hashes of a text and the end."""
        words = common.ascii_lower_words(text)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        out = np.empty(len(words) + 1, _U)
        out[:-1] = np.fromiter(map(known.__getitem__, words), _U, len(words))
        out[-1] = END
        return out


def word_hashes():
    return common.held("words", _Words)


def _pairs(h, starts):
    """Bigram hashes of concatenated texts: every word with the one before it, the first of a text with the start."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = START
    return bigram(before, h)


_BLOCK = "block bigint, doc_ids array<{id}>, held binary, lengths binary, words binary, ids binary"


def _blocks(docs, held):
    """One row per block: distinct words, the texts as positions among them, lengths and which are held out."""
    struct, arrow = common.arrow_schema(_BLOCK.format(id=docs.schema["doc_id"].dataType.simpleString()))

    def run(batches):
        made, texts, ids, flags, size = 0, [], [], [], 0

        def close():
            words, at = np.unique(np.concatenate(texts), return_inverse=True)
            row = [[(TaskContext.get().partitionId() << 24) + made], [ids], [np.array(flags, bool).tobytes()],
                   [np.array([len(t) for t in texts], np.int64).tobytes()], [words.tobytes()], [at.astype(np.uint32).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for doc, text, out in zip(*(c.to_pylist() for c in batch.columns)):
                texts.append(word_hashes()(text))
                ids.append(doc)
                flags.append(out)
                size += len(texts[-1])
                if size >= BLOCK_TOKENS:
                    yield close()
                    made, texts, ids, flags, size = made + 1, [], [], [], 0
        if texts:
            yield close()

    return common.materialized(docs.select("doc_id", "text", held.alias("held")).mapInArrow(run, struct), "blocks")


def _unpacked(row):
    words = np.frombuffer(row["words"], _U)
    ids = np.frombuffer(row["ids"], np.uint32)
    lengths = np.frombuffer(row["lengths"], np.int64)
    starts = np.cumsum(lengths) - lengths
    return words, ids, lengths, starts, np.frombuffer(row["held"], bool)


def _bounds(shards):
    per = (1 << 64) // shards + 1
    return np.array([k * per for k in range(shards)], _U)


def _questions(blocks, shards):
    """(shard, block, words, word_counts, pairs, pair_counts): per block and range of hashes, sorted."""
    schema = "shard int, block bigint, words binary, word_counts binary, pairs binary, pair_counts binary"
    struct, arrow = common.arrow_schema(schema)

    def run(batches):
        common.let_go()
        bounds = _bounds(shards)
        for batch in batches:
            for row in batch.to_pylist():
                words, ids, lengths, starts, held = _unpacked(row)
                train = np.repeat(~held, lengths)
                hashes = _pairs(words[ids], starts)
                word_counts = np.bincount(ids[train], minlength=len(words)).astype(np.uint32)
                order = np.argsort(hashes)
                hashes, train = hashes[order], train[order]
                first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
                pairs, pair_counts = hashes[first], np.add.reduceat(train, first, dtype=np.uint32)
                cuts = [np.append(np.searchsorted(a, bounds), len(a)) for a in (words, pairs)]
                for k in range(shards):
                    (a, b), (c, d) = ((cut[k], cut[k + 1]) for cut in cuts)
                    out = [k, row["block"], words[a:b].tobytes(), word_counts[a:b].tobytes(), pairs[c:d].tobytes(), pair_counts[c:d].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, arrow)], schema=arrow)

    return blocks.select("block", "held", "lengths", "words", "ids").mapInArrow(run, struct)


_ANSWER = "block bigint, shard int, word_counts binary, pair_counts binary, tokens bigint, distinct bigint"


def _answers(questions):
    """Corpus counts for every block's questions, in their order; a row without a block has the shard's totals."""
    _, arrow = common.arrow_schema(_ANSWER)

    def summed(hashes, counts):
        """Corpus counts aligned with each array of `hashes`."""
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        run = every[order]
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
        totals = np.add.reduceat(np.concatenate(counts)[order].astype(np.uint64), first) if len(run) else np.zeros(0, _U)
        back = np.empty(len(run), np.uint64)
        back[order] = np.repeat(totals, np.diff(np.append(first, len(run))))
        return np.split(back, np.cumsum([len(h) for h in hashes])[:-1]), totals

    def answer(group):
        read = {n: group.column(n).to_pylist() for n in group.column_names}
        words, totals = summed([np.frombuffer(x, _U) for x in read["words"]], [np.frombuffer(x, np.uint32) for x in read["word_counts"]])
        pairs, _ = summed([np.frombuffer(x, _U) for x in read["pairs"]], [np.frombuffer(x, np.uint32) for x in read["pair_counts"]])
        n = len(words)
        rows = {"block": [*read["block"], None], "shard": [read["shard"][0]] * (n + 1),
                "word_counts": [*(x.astype(np.int64).tobytes() for x in words), None],
                "pair_counts": [*(x.astype(np.int64).tobytes() for x in pairs), None],
                "tokens": [None] * n + [int(totals.sum())], "distinct": [None] * n + [int((totals > 0).sum())]}
        return pa.Table.from_arrays([pa.array(rows[f.name], f.type) for f in arrow], schema=arrow)

    return common.materialized(questions.groupBy("shard").applyInArrow(answer, _ANSWER), "answers")


class Automaton:
    """The part of the model that one block's words can reach.

    `arcs` are the log-probabilities of the observed bigrams (nan where there is none, so the failure arc is taken),
    `failure` those of leaving a state for the root, `root` those of the root's arcs.
    """

    def __init__(self, word_counts, pair_counts, pair_state, pair_word, start_count, tokens, distinct):
        p = (word_counts + 1) / (tokens + distinct + 1)
        self.root = np.log10(p)
        states = np.append(word_counts, start_count)
        self.failure = np.log10(MASS / (states + MASS))
        with np.errstate(divide="ignore"):
            arcs = np.log10((pair_counts + MASS * p[pair_word]) / (states[pair_state] + MASS))
        self.arcs = np.where(pair_counts > 0, arcs, np.nan)

    def weights(self, states, words, arcs):
        """Log-probability of each step: from the carried state by its arc, or by failure and the root's arc."""
        direct = self.arcs[arcs]
        return np.where(np.isnan(direct), self.failure[states] + self.root[words], direct)


SCORED = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def lm_scores(docs, held):
    """Scores of every row of `docs` (doc_id, text); rows for which `held` (a column) holds do not train the model.

    A null or empty text is the end alone. Repeated rows train and are scored each. Null ids are scored like others. With no
    training document every word is unknown.
    """
    with common.batches_of(docs.sparkSession, 1000):
        blocks = _blocks(docs, held)
        size = blocks.agg(F.sum(F.length("ids") / 4)).first()[0] or 0
        shards = int(max(1, -(-size // TOKENS_PER_SHARD)))
        answers = _answers(_questions(blocks, shards))
    totals = answers.where("block is null").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = (int(x or 0) for x in totals)
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct, arrow = common.arrow_schema(f"doc_id {kind}, {SCORED}")

    def score(block, found):
        row = block.to_pylist()[0]
        words, ids, lengths, starts, held_out = _unpacked(row)
        replies = sorted(found.to_pylist(), key=lambda r: r["shard"])
        word_counts, pair_counts = (np.concatenate([np.frombuffer(r[c], np.int64) for r in replies]) for c in ("word_counts", "pair_counts"))
        hashes = _pairs(words[ids], starts)
        _, first, arcs = np.unique(hashes, return_index=True, return_inverse=True)
        states = np.empty(len(ids), np.int64)
        states[1:] = ids[:-1]
        states[starts] = len(words)
        # Every training document starts once and ends once.
        end = np.searchsorted(words, _U(END))
        automaton = Automaton(word_counts, pair_counts, states[first], ids[first], word_counts[end], tokens, distinct)
        steps = automaton.weights(states, ids, arcs)
        made = {"doc_id": row["doc_ids"], "held_out": held_out, "n_tokens": lengths,
                "n_known": np.add.reduceat((word_counts > 0)[ids].astype(np.int64), starts),
                "train_tokens": np.full(len(lengths), tokens), "base_score": np.add.reduceat(automaton.root[ids], starts),
                "score": np.add.reduceat(steps, starts)}
        return pa.Table.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return blocks.groupBy("block").cogroup(answers.where("block is not null").groupBy("block")).applyInArrow(score, struct)


def op9_lm_scoring(spark, sf_dir):
    return lm_scores(common.table(spark, sf_dir, "documents"), common.crc_is("doc_id", 7, 2))
