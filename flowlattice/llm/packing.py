"""Packing documents into sequences: concatenate and cut.

All documents, each closed by an end token, are one long stream of tokens cut every `length` tokens, so only the last
sequence is short. The stream's layout takes two passes. The first tokenizes; each task writes its documents' ids with
their start within the task. The tasks' token totals are summed up to give each task's place in the stream.
The second pass adds that place and cuts documents where a window ends, without a shuffle. Every
piece is a boundary record: which document, from which of its tokens, where in which sequence.

The ids are tokenized once and written to the shared folder, so the order of the stream is fixed there, whatever is
run again later.
"""

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from flowlattice.llm import common

LENGTH, END_ID = 2048, 1
CACHED_CHUNKS = 300_000
# Marks that are never part of a word, and letters that no normalisation joins to a mark after them.
_MARKS = b".,;:!?|%$&*#"
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
# How the tokenizer's byte level writes bytes: those of printable Latin-1 characters as these, the others as what follows U+00FF.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: b for b in _SHOWN} | {b: 0x100 + k for k, b in enumerate(sorted(set(range(0x100)) - set(_SHOWN)))}


class ChunkTokenizer:
    """Ids of texts by a tokenizer that drops white space and lower-cases, so chunks between white space are encoded once each.

    Chunks are remembered up to a bound on memory. A chunk of plain letters and closing marks is the ids of
    both parts, as the tokenizer never joins letters with marks; a word of Latin letters goes to the tokenizer's model at once, lower-cased
    and as its byte level writes it, since its normalizer and splitter do no more to such a word.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.known = common.Recent(CACHED_CHUNKS)

    def _pack(self, ids):
        return array(self.code, ids).tobytes()

    def _learn(self, chunks):
        known, recall, tokenize = self.known, self.known.recall, self.tokenizer.model.tokenize
        split, other = [], set()
        for chunk in chunks:
            if recall(chunk) is not None:
                continue
            head = chunk.rstrip(_MARKS)
            if not (plain := head.isalpha()) and not (head and _LATIN.fullmatch(head.decode("utf-8", "replace"))):
                other.add(chunk)
                continue
            if known.get(head) is None and recall(head) is None:
                word = head.lower() if plain else head.decode().lower().encode()
                known[head] = self._pack([t.id for t in tokenize(word.decode("latin-1").translate(_BYTE_LEVEL))])
            if len(head) < len(chunk):
                tail = chunk[len(head):]
                split.append((chunk, head, tail))
                if tail not in known and recall(tail) is None:
                    other.add(tail)
        other = list(other)
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False)
        for word, found in zip(other, encoded):
            known[word] = self._pack(found.ids)
        for chunk, head, tail in split:
            known[chunk] = known[head] + known[tail]

    def encode(self, column, end):
        """(ids, bounds): the ids of an Arrow column of texts, each closed by the end id, and the texts' bounds among them.

        A-Z is lower-cased before, as the tokenizer does, unless that could make a special token.
        """
        self.known.tidy()
        chunks, codes, bounds = common.distinct_words(column, unless="<|")
        ids = list(map(self.known.get, chunks))
        missing = [k for k, found in enumerate(ids) if found is None]
        self._learn([chunks[k] for k in missing])
        for k in missing:
            ids[k] = self.known[chunks[k]]
        ids.append(self._pack([end]))
        flat = np.frombuffer(b"".join(ids), f"<u{self.width}")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        codes = np.insert(codes.astype(np.int64), bounds[1:], len(chunks))
        bounds = bounds + np.arange(len(bounds))
        # Each chunk's ids lie together: from where they start, less where they go, the place of every id follows.
        took = lengths[codes]
        goes = np.append(0, np.cumsum(took))
        places = np.repeat((np.cumsum(lengths) - lengths)[codes] - goes[:-1], took) + np.arange(goes[-1])
        return flat[places], goes[bounds]


def tokenizer_of(path):
    return common.held(path, lambda: ChunkTokenizer(path))


def tokenized(docs, path, end=END_ID):
    """(doc_id, part, start, ids): each row's ids as bytes, written to the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct, arrow = common.arrow_schema(f"doc_id {kind}, part bigint, start bigint, width int, ids binary")

    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        with common.frugal():
            tokenizer = tokenizer_of(path)
            for batch in batches:
                for some in common.slices(batch, most=common.ARROW_ROWS):
                    ids, bounds = tokenizer.encode(some.column(1), end)
                    n, width = some.num_rows, tokenizer.width
                    raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), pa.array(np.full(n, part)), pa.array(start + bounds[:-1]),
                         pa.array(np.full(n, width, np.int32)), raw], schema=arrow)
                    start += int(bounds[-1])

    return common.materialized(docs.select("doc_id", "text").mapInArrow(run, struct), "tokens")


def part_places(tokens):
    """{part: tokens before it in the stream}: an exclusive prefix sum of one number per task."""
    totals = tokens.groupBy("part").agg(F.sum(F.length("ids") / F.col("width")).cast("bigint").alias("n")).collect()
    places, before = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        places[part], before = before, before + n
    return places


PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs, path, length=LENGTH, end=END_ID, with_ids=False):
    """Boundary records of `docs` (doc_id, text), one per piece; `with_ids` adds the piece's ids.

    A null or empty text is its end token alone. Rows are packed as they come, so repeated rows and repeated or null ids
    are separate documents. An empty table gives no piece. A document longer than a sequence goes on in the next ones.
    """
    tokens = tokenized(docs, path, end)
    places = part_places(tokens)
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct, arrow = common.arrow_schema(f"doc_id {kind}, {PIECE}" + ", ids array<int>" * with_ids)

    def run(batches):
        for batch in batches:
            rows = {field.name: [] for field in arrow}
            columns = (batch.column(i).to_pylist() for i in range(batch.num_columns))
            for doc, part, start, width, raw in zip(*columns):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                place, done = places[part] + start, 0
                while done < len(ids):
                    sequence, offset = divmod(place + done, length)
                    take = min(length - offset, len(ids) - done)
                    piece = ids[done:done + take]
                    made = [doc, done, take, zlib.crc32(piece.tobytes()), len(ids), sequence, offset]
                    for name, value in zip(rows, made + [piece.astype(np.int32)] * with_ids):
                        rows[name].append(value)
                    done += take
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in arrow], schema=arrow)

    return tokens.mapInArrow(run, struct)


def sequences(pieces, length=LENGTH, pad_id=0):
    """Full sequences of pieces made with their ids: (sequence_id, input_ids, n_tokens, boundaries).

    Sequences are padded to `length`, except where their number of tokens is a power of two. A
    sequence holds at most `length` pieces, so groups are bounded.
    """
    n = F.col("n_tokens")
    power = F.pmod(F.log2(n.cast("double")), F.lit(1.0)) == 0
    joined = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("pieces"), F.sum("length").alias("n_tokens"))
    ids = F.flatten(F.col("pieces.ids"))
    return joined.select(
        "sequence_id", F.when(power, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), (F.lit(length) - n).cast("int")))).alias("input_ids"), "n_tokens",
        F.transform("pieces", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["offset"].alias("offset"), p["start"].alias("start"),
                                                 p["length"].alias("length"))).alias("boundaries"))


def vocabulary(name="word_bpe_49k.json"):
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_packing(spark, sf_dir):
    return pack(common.table(spark, sf_dir, "documents"), vocabulary())
