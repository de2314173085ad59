"""Alignment of two tokenizers' tokens, as fragments that compose.

A text's bytes (a blank and the text) are cut by tokenizer A and by tokenizer B. Where a token of both ends, the text is cut into
groups; within a group every two tokens whose bytes overlap are linked. Each stretch between neighbouring ends lies in one token of each,
so the links are the distinct ends.

The part of a text that lies in a range of bytes is a `Fragment`: the tokens up to its first common end (open prefix), the groups
between common ends (closed), the tokens after its last common end (open suffix). Two neighbouring fragments compose into one: the suffix
of the first and the prefix of the second close to a group. Composition is associative, so long texts are cut into ranges of
`CHUNK_BYTES`, every range is tokenized in some task, and the fragments are composed by `FAN_IN` up a tree of tasks. A shorter
text is one range, from its start to its end, and is complete at once.

Both tokenizers may be started at a single blank between characters that are no white space: A splits there before it merges, and no piece
of B goes on after a letter with a blank (this is checked on its vocabulary). A range is tokenized from the last such place
before it to the first behind it, and what lies between two such places is remembered, up to twice `CACHED` of them.

How often ids are linked in the corpus is counted as in a word count. The texts of a task are kept in blocks of about `BLOCK_LINKS` links that
know their distinct pairs; blocks ask for these pairs' counts, so what is shuffled are pairs of blocks and not links.
"""

import gc
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlattice.llm import common

CHUNK_BYTES, FAN_IN = 32_768, 16
BLOCK_LINKS = 500_000
# Bytes of text that are cut side by side; tokens and their places take some hundred times as much.
TEXT_AT_ONCE = 1 << 20
# Rows that go to Python at once, and bytes of rows that Spark decodes at once from the tables in between.
BATCH_ROWS, ROW_GROUP = 256, 8 << 20
CACHED = 100_000
_SAFE = re.compile("(?<=[^\\s\\u180e\\u2581]) (?=[^\\s\\u180e\\u2581])")
_I = np.int64


def byte_level(entry):
    """The bytes of an entry of a byte-level vocabulary."""
    return bytes(_BYTE_OF[c] for c in entry)


def _byte_letters():
    """The letter of each byte in byte-level vocabularies: printable ones are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = {}, 256
    for b in range(256):
        letters[chr(b) if b in plain else chr(more)] = b
        more += b not in plain
    return letters


_BYTE_OF = _byte_letters()


class Vocabulary:
    """Token bytes by id; their lengths; ids in decimal behind the mark that opens a group or goes on in it."""

    def __init__(self, tokens, opening):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], _I)
        self.marked = np.array([[f"{mark}{i}".encode() for i in range(len(tokens))] for mark in (",", opening)])


def byte_level_encoding(path):
    """A byte-level BPE file of `tokenizers` as a `tiktoken` encoding of ordinary text.

    Merges made in the order of their ids are what ranks express; another order is refused. The pattern is the one that
    byte-level pre-tokenizers split by.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    model, splitter = described["model"], described["pre_tokenizer"]
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if splitter["type"] != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) or described["normalizer"]:
        raise ValueError("not a plain byte-level tokenizer")
    if any(x >= y for x, y in zip(merged, merged[1:])) or min(merged, default=256) < 256:
        raise ValueError("merges are not in the order of ids")
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    ranks = {byte_level(t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)


# Fixed value: how byte-level pre-tokenizers split text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pair:
    """Tokenizers A (a byte-level BPE file) and B (a `sentencepiece` model, adds the leading blank itself).

    What was encoded is remembered in two generations: when the younger is full it becomes the older, and what is met again moves on.
    """

    def __init__(self, a_path, b_path):
        import sentencepiece

        self.first = byte_level_encoding(a_path)
        tokens = {i: t.encode() for t, i in self.first._special_tokens.items()}
        tokens.update((i, t) for t, i in self.first._mergeable_ranks.items())
        self.a = Vocabulary([tokens.get(i, b"") for i in range(self.first.n_vocab)], ";")
        self.second = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError("a piece goes on with a blank, so texts cannot be cut at blanks")
        self.b = Vocabulary([bytes([int(p[1:-1], 16)]) if self.second.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)], "|")
        self.width = len(pieces)
        self.known, self.older = {}, {}

    def _learn(self, units):
        """For every unit the number of its A ids, those ids and its B ids as bytes; nothing where the bytes do not come back."""
        older, known, encode = self.older, self.known, self.first.encode_ordinary
        again = units & older.keys()
        for u in again:
            known[u] = older.pop(u)
        new = list(units - again)
        if not new:
            return
        texts = [" " + u for u in new]
        sides = [encode(t) for t in texts], self.second.encode(new, num_threads=1)
        raw = [t.encode() for t in texts]
        found = [[b"".join(map(v.tokens.__getitem__, ids)) for ids in side] for v, side in zip((self.a, self.b), sides)]
        for unit, a, b, *same in zip(new, *sides, raw, *found):
            known[unit] = array("i", [len(a), *a, *b]).tobytes() if same[0] == same[1] == same[2] else b""

    def encode(self, texts):
        """(A ids, B ids) of a blank and each text, or None where a tokenizer does not give back the bytes."""
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        known, made = self.known, []
        split = [_SAFE.split(t) for t in texts]
        self._learn({u for units in split for u in units if u not in known})
        for units in split:
            found = list(map(known.__getitem__, units))
            sizes = np.fromiter(map(len, found), _I, len(found)) // 4
            if not sizes.all():
                made.append(None)
                continue
            ids = np.frombuffer(b"".join(found), np.int32)
            starts = np.cumsum(sizes) - sizes
            # 0 where a unit's number of A ids is, then 1 for those ids, 2 for B's.
            step = np.zeros(len(ids) + 1, np.int8)
            step[starts[1:]] -= 2
            step[starts + 1] += 1
            step[starts + 1 + ids[starts]] += 1
            side = np.cumsum(step[:-1], dtype=np.int8)
            made.append((ids[side == 1].astype(_I), ids[side == 2].astype(_I)))
        return made


def pair_of(a_path, b_path):
    return common.held(f"{a_path} {b_path}", lambda: Pair(a_path, b_path))


class Range:
    """Bytes `low` to `high` of a text, and the text between safe places around them, which starts at byte `start`."""

    __slots__ = ("low", "high", "start", "text")

    def __init__(self, low, high, start, text):
        self.low, self.high, self.start, self.text = low, high, start, text


def whole(text):
    return Range(0, 1 + len(text.encode()), 0, text)


def ranges(text, size):
    """The ranges of `size` bytes of a blank and the text. What has no safe place stays with one range, however long it is."""
    units = _SAFE.split(text)
    ends = np.cumsum([1 + len(u.encode()) for u in units])
    borders, last = [0], 0
    for border in range(size, int(ends[-1]), size):
        unit = int(np.searchsorted(ends, border))
        if unit > last:
            borders.append(border)
            last = unit
    borders.append(int(ends[-1]))
    for low, high in zip(borders, borders[1:]):
        a, b = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high))
        yield Range(low, high, int(ends[a - 1]) if a else 0, " ".join(units[a:b + 1]))


class Fragment:
    """Tokens of a range of bytes: open prefix, closed groups, open suffix.

    Open tokens are (ids of A, ends of A, ids of B, ends of B). A fragment without a common end (`cut` false) has all its tokens in the
    prefix. The start of a text is a common end. `text` holds the closed groups, `keys` their links: the id of A times B's size plus the id of B.
    """

    __slots__ = ("cut", "prefix", "suffix", "text", "keys", "n_a", "n_b", "n_groups")

    def __init__(self, cut, prefix, suffix, text, keys, n_a, n_b, n_groups):
        self.cut, self.prefix, self.suffix, self.text, self.keys = cut, prefix, suffix, text, keys
        self.n_a, self.n_b, self.n_groups = n_a, n_b, n_groups


_NONE = (np.zeros(0, _I),) * 4


def _chained(left, right):
    return tuple(np.concatenate(x) for x in zip(left, right))


def compose(left, right, width):
    """The fragment of both ranges; associative."""
    if not left.cut:
        return Fragment(right.cut, _chained(left.prefix, right.prefix), right.suffix, right.text, right.keys, right.n_a, right.n_b, right.n_groups)
    between = _chained(left.suffix, right.prefix)
    if not right.cut:
        return Fragment(True, left.prefix, between, left.text, left.keys, left.n_a, left.n_b, left.n_groups)
    a_ids, a_ends, b_ids, b_ends = between
    texts, keys, closed = [left.text], [left.keys], 0
    if len(a_ids):
        texts.append(",".join(map(str, a_ids.tolist())).encode() + b"|" + ",".join(map(str, b_ids.tolist())).encode())
        keys.append(_links(a_ids, a_ends, b_ids, b_ends, np.union1d(a_ends, b_ends), width))
        closed = 1
    texts.append(right.text)
    return Fragment(True, left.prefix, right.suffix, b";".join(t for t in texts if t), np.concatenate([*keys, right.keys]),
                    left.n_a + len(a_ids) + right.n_a, left.n_b + len(b_ids) + right.n_b, left.n_groups + closed + right.n_groups)


def _links(a_ids, a_ends, b_ids, b_ends, ends, width):
    return a_ids[np.searchsorted(a_ends, ends)] * width + b_ids[np.searchsorted(b_ends, ends)]


def fragments(pair, parts):
    """The fragment of each range, None where a tokenizer does not give back the bytes. Ranges are laid side by side and cut together."""
    sides = ([], [], [], [])
    spans, counts = [], []
    collects = gc.isenabled()
    gc.disable()  # the many small lists that encoding makes hold no cycles
    try:
        encoded = pair.encode([p.text for p in parts])
    finally:
        if collects:
            gc.enable()
    for part, found in zip(parts, encoded):
        spans.append(part.high - part.low)
        tokens = []
        for ids, vocabulary in zip(found or _NONE[:2], (pair.a, pair.b)):
            ends = part.start + np.cumsum(vocabulary.lengths[ids])
            inside = slice(np.searchsorted(ends, part.low, "right"), np.searchsorted(ends, part.high, "right"))
            tokens += [ids[inside], ends[inside] - part.low]
        counts.append((len(tokens[0]), len(tokens[2])))
        for side, values in zip(sides, tokens):
            side.append(values)
    base = np.cumsum(spans) - spans
    n_a, n_b = np.array(counts, _I).T
    a_ids, b_ids = np.concatenate(sides[0]), np.concatenate(sides[2])
    a_ends = np.concatenate(sides[1]) + np.repeat(base, n_a)
    b_ends = np.concatenate(sides[3]) + np.repeat(base, n_b)
    merged = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
    again = np.append(False, merged[1:] == merged[:-1])[:len(merged)]
    cuts, ends = merged[again], merged[~again]
    # Closed groups of a range lie behind its first common end (a text's start is one) and up to its last.
    first, last = np.searchsorted(cuts, base, "right"), np.searchsorted(cuts, base + spans, "right")
    opening = np.array([p.low == 0 for p in parts])
    some = last > first
    start = np.where(opening | ~some, base, cuts[np.minimum(first, len(cuts) - 1)] if len(cuts) else base)
    stop = np.where(some, cuts[last - 1] if len(cuts) else base, base)
    at = [np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b)]
    closed, bounds = [], []
    for place, values in zip(at, (a_ends, b_ends)):
        bounds.append((np.searchsorted(values, start, "right"), np.searchsorted(values, stop, "right")))
        mask = np.zeros(len(values) + 1, _I)
        np.add.at(mask, bounds[-1][0], 1)
        np.add.at(mask, bounds[-1][1], -1)
        closed.append(np.cumsum(mask[:-1]) > 0)
    keep = np.zeros(len(cuts), bool)
    for f, l, o in zip(first, last, opening):
        keep[f + (not o):l] = True
    groups = cuts[keep]
    (ca, ea), (cb, eb) = ((ids[c], v[c]) for ids, v, c in zip((a_ids, b_ids), (a_ends, b_ends), closed))
    ga, gb = np.searchsorted(groups, ea), np.searchsorted(groups, eb)
    many_a, many_b = np.bincount(ga, minlength=len(groups)), np.bincount(gb, minlength=len(groups))
    marks = np.empty(len(ca) + len(cb), f"S{max(pair.a.marked.itemsize, pair.b.marked.itemsize)}")
    marks[np.arange(len(ca)) + (np.cumsum(many_b) - many_b)[ga]] = pair.a.marked[_opens(ga), ca]
    marks[np.arange(len(cb)) + np.cumsum(many_a)[gb]] = pair.b.marked[_opens(gb), cb]
    inside = ends[_within(ends, start, stop)]
    keys = _links(ca, ea, cb, eb, inside, pair.width)
    key_at = np.searchsorted(inside, start, "right"), np.searchsorted(inside, stop, "right")
    group_at = np.searchsorted(groups, start, "right"), np.searchsorted(groups, stop, "right")
    closed_a, closed_b = bounds[0][1] - bounds[0][0], bounds[1][1] - bounds[1][0]
    mark_at = np.concatenate(([0], np.cumsum(closed_a + closed_b)))
    made = []
    for k, (part, found) in enumerate(zip(parts, encoded)):
        if found is None:
            made.append(None)
            continue
        shift, tokens = part.low - base[k], (a_ids, a_ends, b_ids, b_ends)
        (a0, a3), (b0, b3) = ((place[k], place[k + 1]) for place in at)
        (a1, a2), (b1, b2) = ((low[k], high[k]) for low, high in bounds)
        cut = bool(opening[k] or some[k])
        if cut:
            prefix, suffix = _open(tokens, a0, a1, b0, b1, shift), _open(tokens, a2, a3, b2, b3, shift)
        else:
            prefix, suffix = _open(tokens, a0, a3, b0, b3, shift), _NONE
        text = marks[mark_at[k]:mark_at[k + 1]].tobytes().translate(None, b"\0")[1:]
        made.append(Fragment(cut, prefix, suffix, text, keys[key_at[0][k]:key_at[1][k]],
                             int(closed_a[k]), int(closed_b[k]), int(group_at[1][k] - group_at[0][k])))
    return made


def _opens(groups):
    return np.append(True, groups[1:] != groups[:-1]).astype(_I)[:len(groups)]


def _within(values, start, stop):
    mask = np.zeros(len(values) + 1, _I)
    np.add.at(mask, np.searchsorted(values, start, "right"), 1)
    np.add.at(mask, np.searchsorted(values, stop, "right"), -1)
    return np.cumsum(mask[:-1]) > 0


def _open(tokens, a, b, c, d, shift):
    if a == b and c == d:
        return _NONE
    return tokens[0][a:b], tokens[1][a:b] + shift, tokens[2][c:d], tokens[3][c:d] + shift


_PART = "row bigint, doc_id {id}, k bigint, low bigint, high bigint, start bigint, text string"
_FRAGMENT = "row bigint, doc_id {id}, k bigint, whole boolean, cut boolean, prefix binary, suffix binary, text binary, keys binary, n_a bigint, n_b bigint, n_groups bigint"
_BLOCK = ("block bigint, doc_ids array<{id}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
          "digests array<string>, pairs array<bigint>, totals array<bigint>, at binary")


def _packed(tokens):
    return np.concatenate(([len(tokens[0]), len(tokens[2])], *tokens)).astype(_I).tobytes()


def _unpacked(raw):
    values = np.frombuffer(raw, _I)
    a, b = values[:2]
    return tuple(np.split(values[2:], [a, 2 * a, 2 * a + b]))


def _fragment_row(row, doc, k, found):
    if found is None:
        return {"row": row, "doc_id": doc, "k": k, "whole": False}
    return {"row": row, "doc_id": doc, "k": k, "whole": True, "cut": found.cut, "prefix": _packed(found.prefix), "suffix": _packed(found.suffix),
            "text": found.text, "keys": found.keys.tobytes(), "n_a": found.n_a, "n_b": found.n_b, "n_groups": found.n_groups}


def _fragment_of(row):
    return Fragment(row["cut"], _unpacked(row["prefix"]), _unpacked(row["suffix"]), row["text"], np.frombuffer(row["keys"], _I),
                    row["n_a"], row["n_b"], row["n_groups"])


def _batch(rows, arrow):
    return pa.RecordBatch.from_pylist(rows, schema=arrow)


def _long_fragments(docs, a_path, b_path, width, kind, chunk_bytes):
    """One fragment (whole or not) per row of `docs` that is longer than a range, composed up a tree."""
    struct, arrow = common.arrow_schema(_PART.format(id=kind))

    def cut(batches):
        with common.frugal():
            for batch in batches:
                for part in common.slices(batch, TEXT_AT_ONCE):
                    for row, doc, text in zip(*(common.each(c) for c in part.columns)):
                        for k, r in enumerate(ranges(text, chunk_bytes)):
                            yield _batch([{"row": row, "doc_id": doc, "k": k, "low": r.low, "high": r.high, "start": r.start, "text": r.text}], arrow)

    long = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").where(F.octet_length("text") >= chunk_bytes)
    parts = common.materialized(long.mapInArrow(cut, struct), "ranges", ROW_GROUP)
    made, made_arrow = common.arrow_schema(_FRAGMENT.format(id=kind))

    def tokenize(batches):
        with common.frugal():
            pair = pair_of(a_path, b_path)
            for batch in batches:
                for part in common.slices(batch, TEXT_AT_ONCE):
                    rows = part.to_pylist()
                    found = fragments(pair, [Range(r["low"], r["high"], r["start"], r["text"]) for r in rows])
                    yield _batch([_fragment_row(r["row"], r["doc_id"], r["k"], f) for r, f in zip(rows, found)], made_arrow)

    def composed(group):
        rows = sorted(group.to_pylist(), key=lambda r: r["k"])
        found = _fragment_of(rows[0]) if all(r["whole"] for r in rows) else None
        for r in rows[1:] if found else ():
            found = compose(found, _fragment_of(r), width)
        return pa.Table.from_pylist([_fragment_row(rows[0]["row"], rows[0]["doc_id"], rows[0]["k"] // FAN_IN, found)], schema=made_arrow)

    tree = common.materialized(parts.repartition("row", "k").mapInArrow(tokenize, made), "fragments", ROW_GROUP)
    last = parts.agg(F.max("k")).first()[0] or 0
    while last > 0:
        tree = common.materialized(tree.groupBy("row", F.floor(F.col("k") / FAN_IN).alias("up")).applyInArrow(composed, made), "fragments", ROW_GROUP)
        last //= FAN_IN
    return tree


def _place_type(pairs):
    """What holds a place among so many pairs; few blocks have more than two bytes can number."""
    return np.uint16 if pairs <= 1 << 16 else np.uint32


class _Blocks:
    """Texts gathered to blocks of about `BLOCK_LINKS` links."""

    def __init__(self, arrow, task):
        self.arrow, self.task, self.made = arrow, task, 0
        self._clear()

    def _clear(self):
        self.rows, self.keys, self.size = [], [], 0

    def add(self, doc, found):
        keys = found.keys if found else _NONE[0]
        self.rows.append((doc, found.n_a, found.n_b, found.n_groups, len(keys), hashlib.sha256(found.text).hexdigest()) if found else (doc, 0, 0, 0, 0, ""))
        self.keys.append(keys)
        # A text without links still takes its place in a row.
        self.size += len(keys) + 16
        return self.size >= BLOCK_LINKS

    def close(self):
        pairs, at, totals = np.unique(np.concatenate(self.keys), return_inverse=True, return_counts=True)
        columns = [*map(list, zip(*self.rows)), pairs, totals, at.astype(_place_type(len(pairs))).tobytes()]
        row = [[(self.task << 24) + self.made], *([c] for c in columns)]
        self.made += 1
        self._clear()
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, self.arrow)], schema=self.arrow)


def _blocks(docs, tree, a_path, b_path, kind, chunk_bytes):
    """One row per block of texts, short ones tokenized here, long ones from their fragments."""
    struct, arrow = common.arrow_schema(_BLOCK.format(id=kind))

    def gathered(found):
        with common.frugal():
            blocks = _Blocks(arrow, TaskContext.get().partitionId())
            for doc, fragment in found:
                if blocks.add(doc, fragment):
                    yield blocks.close()
            if blocks.rows:
                yield blocks.close()

    def short(batches):
        pair = pair_of(a_path, b_path)
        for batch in batches:
            for part in common.slices(batch, TEXT_AT_ONCE):
                ids, texts = (list(common.each(c)) for c in part.columns)
                some = [k for k, text in enumerate(texts) if text]
                made = fragments(pair, [whole(texts[k]) for k in some]) if some else []
                found = dict(zip(some, made))
                for k, doc in enumerate(ids):
                    yield doc, found.get(k)

    def done(batches):
        for batch in batches:
            for part in common.slices(batch, TEXT_AT_ONCE):
                for row in part.to_pylist():
                    yield row["doc_id"], _fragment_of(row) if row["whole"] else None

    few = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text") < chunk_bytes, F.lit(True)))
    return common.materialized(few.mapInArrow(lambda batches: gathered(short(batches)), struct).unionByName(
        tree.mapInArrow(lambda batches: gathered(done(batches)), struct)), "blocks", ROW_GROUP)


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def align(docs, a_path, b_path, chunk_bytes=CHUNK_BYTES):
    """How the tokens of both tokenizers lie to each other in every row of `docs` (doc_id, text).

    Rows are aligned as they come: repeated rows and repeated or null ids are texts each and all count. Null and empty texts, and those
    that a tokenizer does not give back byte by byte, have no tokens: zeros and an empty digest. An empty table gives no rows. Other columns are not
    read. Ties for the highest count of an id of B are all best.
    """
    width = pair_of(a_path, b_path).width
    common.let_go()
    kind = docs.schema["doc_id"].dataType.simpleString()
    with common.batches_of(docs.sparkSession, BATCH_ROWS):
        tree = _long_fragments(docs, a_path, b_path, width, kind, chunk_bytes)
        blocks = _blocks(docs, tree, a_path, b_path, kind, chunk_bytes)
    asked = blocks.select(F.col("block").alias("asking"), F.inline(F.arrays_zip("pairs", "totals")))
    highest = F.max("count").over(Window.partitionBy(F.pmod("pairs", F.lit(width))))
    counts = asked.groupBy("pairs").agg(F.sum("totals").alias("count")).withColumn("best", F.col("count") == highest)
    answers = asked.select("asking", "pairs").join(counts, "pairs")
    struct, arrow = common.arrow_schema(f"doc_id {kind}, {ALIGNED}")

    def score(block, found):
        row = {n: block.column(n).combine_chunks() for n in block.column_names}
        links = row["n_links"].flatten().to_numpy()
        order = np.argsort(found.column("pairs").to_numpy())
        at = np.frombuffer(row["at"][0].as_buffer(), _place_type(found.num_rows))
        ends = np.cumsum(links)

        def summed(values):
            upto = np.concatenate(([0], np.cumsum(values.astype(_I)[order][at])))
            return upto[ends] - upto[ends - links]

        best = found.column("best").to_numpy() if found.num_rows else np.zeros(0, bool)
        made = {"doc_id": row["doc_ids"].flatten(), "n_links": links, "n_best": summed(best), "count_sum": summed(found.column("count").to_numpy()),
                "groups_sha256": row["digests"].flatten(), **{n: row[n].flatten() for n in ("n_a", "n_b", "n_groups")}}
        return pa.Table.from_arrays([pa.array(made[f.name], f.type) if isinstance(made[f.name], np.ndarray) else made[f.name].cast(f.type) for f in arrow], schema=arrow)

    kept = blocks.drop("pairs", "totals")
    return kept.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(score, struct)


def groups(a_path, b_path, text):
    """The groups of one text, as written in the digest; None where a tokenizer does not give back the bytes."""
    found = fragments(pair_of(a_path, b_path), [whole(text)])[0]
    return found and found.text.decode()


def op12_alignment(spark, sf_dir):
    import public_tokenizers

    paths = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align(common.table(spark, sf_dir, "documents"), *paths)
