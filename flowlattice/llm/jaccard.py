"""Joining documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

The search is a T-occurrence search: a set of n shingles can only be linked with one that shares T = ceil(0.8 n) of
them. The inverted lists of a query's shingles are divided (DivideSkip): the longest are set aside, the short ones
are merged in order, and what the merge finds often enough is probed for in the long lists by binary search.

To get there without comparing everything with everything:

1. Equal sets are one node, so exact copies cost nothing further.
2. Shingles have one global order: rare ones first (those that a bounded sample of documents does not show to be
   frequent), then by hash. A linked pair shares a few shingles at the front of this order, so only these fronts, about a
   quarter of all shingles, are gathered by shingle. Nodes with too few shared ones have no partner and are done. Of those
   that remain all shingles are gathered, and nodes of which fewer than T are shared are done too.
3. The others' sets are tried against one leader of their neighbourhood each (the node with the most shared front among
   those with the same smallest hash). Real links found so make large groups of near copies one component.
4. A list whose nodes all lie in one component cannot add a link. Nodes on other lists become queries against all nodes
   on these lists, split in blocks, if they belong to the smaller component of a pair. Each query reports at most one link
   per component and block, so a group never becomes all its pairs.

The links that are left out join nodes of one component already, so components are exact. Shingles and sets are
known by 64-bit hashes. On their way to a bucket the shingles of a range of hashes are cut to `TOKEN_BYTES`; two that
become one by this only let more through to the comparison of whole sets.
"""

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F

from flowlattice.llm import common
from flowlattice.llm.components import components

SHINGLE = 5
SAMPLE_DOCS, FREQUENT_IN_SAMPLE, MOST_FREQUENT = 3000, 3, 200_000
MIN_HASHES = 3
NODES_PER_BUCKET, SHINGLES_PER_BUCKET, SHINGLES_PER_BLOCK, FOLLOWERS_PER_CELL = 8000, 750_000, 1_000_000, 500
FLUSH_POSTINGS, MOST_OWNERS, TOKEN_BYTES = 1_000_000, 1 << 16, 5
PARTITIONS_PER_CELL = 4
BITMAP_BITS = 1 << 25
_U = np.uint64
# Odd multipliers that mix hashes.
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def needed(n):
    """T: the least overlap of a set of n shingles with any set linked to it."""
    return (4 * n + 4) // 5


def extra(n):
    """How many shingles of the front a linked pair shares at least, by its smaller set."""
    return 1 + needed(n) // 20


def front_length(n):
    return n - needed(n) + extra(n)


def linked(shared, n, m):
    """100 * intersection >= 80 * union."""
    return 9 * shared >= 4 * (n + m)


def shingle_sets(column):
    """Sorted distinct 64-bit hashes of the shingles of each text of an Arrow column."""
    words, codes, bounds = common.distinct_words(column)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))[codes]
    m = max(0, len(codes) - SHINGLE + 1)
    mixed = np.zeros(m, _U)
    for k in range(SHINGLE):  # those across two texts are left out below
        mixed ^= hashes[k:k + m] * _MIX[k]
        mixed *= _MIX[0]
        mixed ^= mixed >> _U(29)
    for low, high in itertools.pairwise(bounds.tolist()):
        if high - low >= SHINGLE:
            found = np.sort(mixed[low:high - SHINGLE + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        elif high > low:
            text = b" ".join(words[c] for c in codes[low:high].tolist())
            yield np.array([xxhash.xxh3_64_intdigest(b"\x00" + text, seed=1)], _U)
        else:
            yield np.zeros(0, _U)


def set_key(shingles):
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def front(shingles, hot, hot_count):
    """The first shingles of a set in the global order: not frequent ones by hash, then frequent ones by (count, hash)."""
    p = front_length(len(shingles))
    if not len(hot):
        return shingles[:p]
    at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
    frequent = hot[at] == shingles
    cold = shingles[~frequent]
    if len(cold) >= p:
        return cold[:p]
    rest = shingles[frequent]
    return np.concatenate([cold, rest[np.lexsort((rest, hot_count[at[frequent]]))][:p - len(cold)]])


def divide_skip(lists, least, share=0.0085):
    """{member: count} of the members found on at least `least` of the sorted lists.

    The longest lists, fewer than `least`, are set aside; the others are merged in order, and members that could
    still reach `least` are probed for in the long lists.
    """
    lists = sorted(lists, key=len, reverse=True)
    if len(lists) < least:
        return {}
    longest = len(lists[0])
    skip = min(least - 1, int(least / (share * np.log2(longest + 1) + 1)))
    long, short = lists[:skip], lists[skip:]
    merged = np.sort(np.concatenate(short), kind="stable")  # the stable sort merges the sorted runs
    edges = np.flatnonzero(np.diff(merged, prepend=merged[:1] - 1 if len(merged) else None))
    members, counts = merged[edges], np.diff(np.append(edges, len(merged)))
    able = counts >= least - skip
    members, counts = members[able], counts[able]
    for k, run in enumerate(long):
        if not len(members):
            break
        at = np.minimum(np.searchsorted(run, members), len(run) - 1)
        counts = counts + (run[at] == members)
        able = counts >= least - (len(long) - k - 1)
        members, counts = members[able], counts[able]
    return dict(zip(members.tolist(), counts.tolist()))


class Lists:
    """Inverted lists over the sets of one block."""

    def __init__(self, rows):
        self.n = np.array([len(s) for _, _, _, s in rows], np.int64)
        self.node = [r[0] for r in rows]
        self.rank = [(r[2], r[1]) for r in rows]
        tokens = np.concatenate([r[3] for r in rows])
        owner = np.repeat(np.arange(len(rows)), self.n)
        order = np.lexsort((owner, tokens))
        self.tokens, at = np.unique(tokens[order], return_index=True)
        self.at, self.owner = np.append(at, len(tokens)), owner[order]

    def links(self, node, comp, size, shingles):
        """At most one node per component of higher rank (size, component) that is linked with the query."""
        n = len(shingles)
        index = np.minimum(np.searchsorted(self.tokens, shingles), len(self.tokens) - 1)
        index = index[self.tokens[index] == shingles]
        if len(index) < needed(n):
            return []
        found = {}
        lists = [self.owner[self.at[i]:self.at[i + 1]] for i in index]
        for member, shared in divide_skip(lists, needed(n)).items():
            rank = self.rank[member]
            if rank > (size, comp) and rank not in found and linked(shared, n, int(self.n[member])):
                found[rank] = self.node[member]
        return list(found.values())


_ROW = "cell bigint, kind int, node bigint, comp bigint, size bigint, shingles binary"


def _search(spark, members, queries, sets, cells):
    """Links (u, v) of the queries with the members of their cells; both have the columns of `_ROW` but the sets.

    A cell's members come first and are indexed, then its queries stream past.
    """
    rows = members.withColumn("kind", F.lit(0)).unionByName(queries.withColumn("kind", F.lit(1))).join(sets.select("node", "shingles"), "node")
    # More partitions than cells, so that few cells fall into one task.
    rows = rows.repartition(PARTITIONS_PER_CELL * cells, "cell").sortWithinPartitions("cell", "kind", "node")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        with common.frugal():
            yield from search(batches)

    def search(batches):
        cell, waiting, lists = None, [], None
        for batch in itertools.chain.from_iterable(map(common.slices, batches)):
            u, v = [], []
            for at, kind, node, comp, size, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if at != cell:
                    cell, waiting, lists = at, [], None
                shingles = np.frombuffer(raw, _U)
                if kind == 0:
                    waiting.append((node, comp, size, shingles))
                    continue
                if lists is None and waiting:
                    lists, waiting = Lists(waiting), []
                for other in lists.links(node, comp, size, shingles) if lists else ():
                    u.append(node)
                    v.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

    return common.materialized(rows.select(*[c.split()[0] for c in _ROW.split(", ")]).mapInArrow(run, "u bigint, v bigint"), "found")


def _arrow_slices(batches):
    for batch in batches:
        yield from common.slices(batch, most=common.ARROW_ROWS)


def frequent_shingles(docs):
    """(sorted hashes, counts) of shingles frequent in a bounded sample; only the order of the search depends on it."""
    ids = docs.select("doc_id", F.xxhash64("doc_id").alias("_h")).where("doc_id is not null").orderBy("_h", "doc_id").limit(SAMPLE_DOCS)
    sampled = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")

    def cut(batches):
        for batch in _arrow_slices(batches):
            for shingles in shingle_sets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64))], ["s"])

    rows = (sampled.select("text").mapInArrow(cut, "s bigint").groupBy("s").count().where(F.col("count") >= FREQUENT_IN_SAMPLE)
            .orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).collect())
    hashes = np.array([r["s"] for r in rows], np.int64).view(_U)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["count"] for r in rows], np.int64)[order]


def _signatures(docs):
    """(doc_id, n, node) per document: how many shingles, and which node its set is."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct, arrow = common.arrow_schema(f"doc_id {kind}, n bigint, node bigint")

    def run(batches):
        with common.frugal():
            for batch in _arrow_slices(batches):
                n, node = zip(*((len(s), set_key(s) if len(s) else None) for s in shingle_sets(batch.column(1))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(arrow.field(0).type), pa.array(n, pa.int64()), pa.array(node, pa.int64())], schema=arrow)

    return common.materialized(docs.select("doc_id", "text").mapInArrow(run, struct), "signatures")


class Ranges:
    """Equal ranges of 64-bit hashes, one a bucket; a hash is cut to `TOKEN_BYTES` within its range."""

    def __init__(self, buckets):
        per = (1 << 64) // buckets + 1
        self.starts = np.array([k * per for k in range(buckets)], _U)
        self.width = TOKEN_BYTES
        self.shift = _U(max(0, (per - 1).bit_length() - 8 * self.width))

    def of(self, hashes):
        return np.searchsorted(self.starts, hashes, side="right") - 1

    def cut(self, bucket, hashes):
        within = ((hashes - self.starts[bucket]) >> self.shift).astype("<u8")
        return within.view(np.uint8).reshape(-1, 8)[:, :self.width].tobytes()

    def restored(self, bucket, raw):
        """The hashes with nought in the bits that were cut."""
        wide = np.zeros((len(raw) // self.width, 8), np.uint8)
        wide[:, :self.width] = np.frombuffer(raw, np.uint8).reshape(-1, self.width)
        return (wide.view("<u8").ravel() << self.shift) + self.starts[bucket]


def _packed(frame, cut, buckets):
    """(bucket, tokens, nodes, counts): shingles by range of hashes, the nodes that have them, and how many each has.

    `cut` makes (node, shingles) of a batch; a node counts once per task, and its shingles of one bucket stay in one row.
    """
    struct, arrow = common.arrow_schema("bucket int, tokens binary, nodes binary, counts binary")
    ranges = Ranges(buckets)

    def flushed(parts):
        tokens = np.concatenate([p for p, _ in parts])
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p, _ in parts])
        names = np.array([n for _, n in parts], np.int64)
        bucket = ranges.of(tokens)
        order = np.argsort(bucket, kind="stable")  # owners stay together
        tokens, owner = tokens[order], owner[order]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [[], [], [], []]
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = owner[cuts[k]:cuts[k + 1]]
            at = np.flatnonzero(np.diff(own, prepend=-1))
            counts = np.diff(np.append(at, len(own))).astype("<u4")
            for column, value in zip(rows, (k, ranges.cut(k, tokens[cuts[k]:cuts[k + 1]]), names[own[at]].tobytes(), counts.tobytes())):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, arrow)], schema=arrow)

    def run(batches):
        seen, parts, held = set(), [], 0
        with common.frugal():
            for batch in _arrow_slices(batches):
                for node, tokens in cut(batch):
                    if node in seen:
                        continue
                    seen.add(node)
                    parts.append((tokens, node))
                    held += len(tokens)
                    if held >= FLUSH_POSTINGS:
                        yield flushed(parts)
                        parts, held = [], 0
            if parts:
                yield flushed(parts)

    return frame.mapInArrow(run, struct)


def _packed_fronts(docs, buckets, hot, hot_count):
    def cut(batch):
        for shingles in shingle_sets(batch.column(0)):
            if len(shingles):
                yield set_key(shingles), front(shingles, hot, hot_count)

    return _packed(docs.select("text"), cut, buckets)


def _shared(group, ranges):
    """(tokens, nodes) of the postings in one bucket whose token two or more nodes have.

    A node that several tasks saw counts by its first row. Shingles of one node that were cut to the same token stay
    apart, so no node is found to share less than it does.
    """
    bucket = group.column("bucket")[0].as_py()
    nodes, counts = (np.concatenate([np.frombuffer(x, kind) for x in common.each(group.column(name))])
                     for name, kind in (("nodes", np.int64), ("counts", "<u4")))
    tokens = np.concatenate([ranges.restored(bucket, x) for x in common.each(group.column("tokens"))])
    first = np.zeros(len(nodes), bool)
    first[np.unique(nodes, return_index=True)[1]] = True
    if not first.all():
        tokens, nodes, counts = tokens[np.repeat(first, counts)], nodes[first], counts[first]
    owner = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    several = _frequencies(tokens) > 1
    return tokens[several], nodes[owner[several]]


def _frequencies(tokens):
    """How often each of the sorted tokens is there."""
    at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    df = np.diff(np.append(at, len(tokens)))
    return np.repeat(df, df)


def _shared_fronts(docs, buckets, hot, hot_count):
    """(token, node): the postings of the fronts' shingles that two or more nodes have."""
    schema, ranges = pa.schema([("token", pa.int64()), ("node", pa.int64())]), Ranges(buckets)

    def gather(group):
        with common.frugal():
            tokens, nodes = _shared(group, ranges)
            return pa.Table.from_arrays([pa.array(tokens.view(np.int64)), pa.array(nodes)], schema=schema)

    packed = _packed_fronts(docs, buckets, hot, hot_count)
    return common.materialized(packed.groupBy("bucket").applyInArrow(gather, "token bigint, node bigint"), "fronts")


def _blocks(sets, buckets):
    """(bucket, block, names, tokens, owners): the shingles of blocks of sets by range of hashes, and whose they are.

    A block's sets are numbered, and `owners` has the number of each shingle's set. One row of a block has the names.
    """
    struct, arrow = common.arrow_schema("bucket int, block bigint, names binary, tokens binary, owners binary")
    ranges = Ranges(buckets)

    def flushed(block, names, parts):
        tokens = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts), dtype="<u2"), [len(p) for p in parts])
        bucket = ranges.of(tokens)
        order = np.argsort(bucket, kind="stable")  # owners stay together
        tokens, owner = tokens[order], owner[order]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        there = np.flatnonzero(np.diff(cuts)).tolist()
        spans = [slice(cuts[k], cuts[k + 1]) for k in there]
        rows = (there, [block] * len(there), [np.array(names, np.int64).tobytes()] + [b""] * (len(there) - 1),
                [ranges.cut(k, tokens[span]) for k, span in zip(there, spans)], [owner[span].tobytes() for span in spans])
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, arrow)], schema=arrow)

    def run(batches):
        block, names, parts, held = TaskContext.get().partitionId() << 32, [], [], 0
        with common.frugal():
            for batch in itertools.chain.from_iterable(map(common.slices, batches)):
                for node, raw in zip(*map(common.each, batch.columns)):
                    names.append(node)
                    parts.append(np.frombuffer(raw, _U))
                    held += len(parts[-1])
                    if held >= FLUSH_POSTINGS or len(parts) == MOST_OWNERS:
                        yield flushed(block, names, parts)
                        block, names, parts, held = block + 1, [], [], 0
            if parts:
                yield flushed(block, names, parts)

    return sets.select("node", "shingles").mapInArrow(run, struct)


def _marked(sets, buckets):
    """(block, names, owners, marks): the shingles of blocks that several nodes have, by owner; a mark is 8 log2 of how many.

    A bucket answers each block in one row of three bytes a shingle, so what goes back grows with the shingles, however many buckets
    a node's shingles lie in.
    """
    struct, arrow = common.arrow_schema("block bigint, names binary, owners binary, marks binary")
    ranges = Ranges(buckets)

    def mark(group):
        with common.frugal():
            bucket = group.column("bucket")[0].as_py()
            tokens = [ranges.restored(bucket, raw) for raw in common.each(group.column("tokens"))]
            ends = np.cumsum([len(x) for x in tokens])
            tokens = np.concatenate(tokens)
            order = np.argsort(tokens, kind="stable")
            marks = np.empty(len(tokens), np.uint8)
            marks[order] = np.minimum(np.rint(8 * np.log2(_frequencies(tokens[order]))), 255)
            owners, found = [], []
            for part, raw in zip(np.split(marks, ends[:-1]), common.each(group.column("owners"))):
                owners.append(np.frombuffer(raw, "<u2")[part > 0].tobytes())
                found.append(part[part > 0].tobytes())
            columns = [group.column("block"), group.column("names"), pa.array(owners, pa.binary()), pa.array(found, pa.binary())]
            return pa.Table.from_arrays(columns, schema=arrow)

    return _blocks(sets, buckets).groupBy("bucket").applyInArrow(mark, struct)


def _support(sets, buckets):
    """(node, many, logs): how many of a node's shingles some other node has too, and the sum of log2 of how many have them.

    A node is in `sets` once.
    """
    struct, arrow = common.arrow_schema("node bigint, many bigint, logs double")

    def count(group):
        names, owners, marks = (np.concatenate([np.frombuffer(x, kind) for x in common.each(group.column(name))])
                                for name, kind in (("names", np.int64), ("owners", "<u2"), ("marks", np.uint8)))
        many, logs = (np.bincount(owners, weights, len(names)) for weights in (None, marks / 8))
        return pa.Table.from_arrays([pa.array(names), pa.array(many.astype(np.int64)), pa.array(logs.astype(np.float64))], schema=arrow)

    return _marked(sets, buckets).groupBy("block").applyInArrow(count, struct)


_SET = f"node bigint, at bigint, n bigint, shingles binary, {', '.join(f'least{k} bigint' for k in range(MIN_HASHES))}"


def _likely(frame, key, some):
    """The rows of `frame` whose `key` may be among those of `some`, by a bitmap of hashes of a fixed size, so that few other
    rows are shuffled. The fuller the bitmap the more others pass; the join that follows decides."""
    def place(column):
        return F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))

    counted = place(key) + 1  # Spark counts places and buckets from 1
    parts = some.groupBy(F.bitmap_bucket_number(counted).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(counted)).alias("bits")).collect()  # BITMAP_BITS / 8 bytes at most
    bits = np.zeros((BITMAP_BITS // 32768, 4096), np.uint8)
    for row in parts:
        bits[row["k"] - 1] = np.frombuffer(row["bits"], np.uint8)
    flags = frame.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches):
        known = np.frombuffer(flags.value, np.uint8)
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            keep = (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(keep.astype(bool))).select(list(range(batch.num_columns - 1)))

    return frame.where(F.col(key).isNotNull()).select("*", place(key).alias("_at")).mapInArrow(run, frame.schema)


def _sets(docs, nodes):
    """(node, at, n, shingles, least...): the sets of `nodes` (node, doc_id), cut again from one text each."""
    struct, arrow = common.arrow_schema(_SET)

    def run(batches):
        seen, place = set(), TaskContext.get().partitionId() << 40  # rows of one id may be repeated, and one id may stand for several texts
        with common.frugal():
            for batch in _arrow_slices(batches):
                rows = []
                for node, shingles in zip(common.each(batch.column(0)), shingle_sets(batch.column(1))):
                    if node in seen or not len(shingles) or set_key(shingles) != node:
                        continue
                    seen.add(node)
                    rows.append([node, place + len(seen), len(shingles), shingles.tobytes(), *(int((shingles * m).min().view(np.int64)) for m in _MIX[1:MIN_HASHES + 1])])
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    picked = _likely(docs.select("doc_id", "text"), "doc_id", nodes).join(nodes, "doc_id").select("node", "text")
    sets = common.materialized(picked.mapInArrow(run, struct), "sets")
    # Repeated rows may have come to several tasks.
    again = sets.groupBy("node").agg(F.min("at").alias("first"), F.count("*").alias("many")).where("many > 1").select("node", "first")
    if again.isEmpty():
        return sets
    return common.materialized(sets.join(again, "node", "left").where("at = coalesce(first, at)").select(sets.columns), "sets")


def _leader_links(spark, near, sets, cells):
    """Links of nodes with a leader among those of the same smallest hash."""
    pairs = None
    for k in range(MIN_HASHES):
        leaders = near.groupBy(f"least{k}").agg(F.max(F.struct("shared", "node")).alias("top"), F.count("*").alias("many")).where("many > 1")
        part = near.select("node", f"least{k}").join(leaders, f"least{k}").where("node <> top.node").select(
            "node", F.col("top.node").alias("leader"), "many")
        pairs = part if pairs is None else pairs.unionByName(part)
    pairs = pairs.groupBy("node", "leader").agg(F.max("many").alias("many"))
    # A leader with many followers is copied to several cells.
    pairs = common.materialized(pairs.select("node", "leader", F.xxhash64("leader", F.pmod(F.xxhash64("node"), F.ceil(
        F.col("many") / FOLLOWERS_PER_CELL).cast("bigint"))).alias("cell")), "leaders")
    members = pairs.select("cell", F.col("leader").alias("node")).distinct().select(
        "cell", "node", F.col("node").alias("comp"), F.lit(1).cast("bigint").alias("size"))
    queries = pairs.select("cell", "node", F.col("node").alias("comp"), F.lit(0).cast("bigint").alias("size"))
    return _search(spark, members, queries, sets, cells)


def _cross_links(spark, near, sets, fronts, roots, blocks):
    """Links between nodes of different components on the lists that have several."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    placed = roots.join(sizes, "root").select("node", F.col("root").alias("comp"), "size")
    known = common.materialized(
        near.select("node", "n").join(placed, "node", "left").select(
            "node", "n", F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"),
            F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("cell")), "known")
    posted = _likely(fronts, "node", known).join(known.select("node", "comp", "size", "cell"), "node")
    mixed = posted.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.struct("size", "comp")).alias("top")).where("low <> high")
    posted = common.materialized(posted.join(mixed.select("token", "top"), "token"), "mixed")
    reached = posted.select("token", "cell").distinct()
    asking = posted.where("comp <> top.comp").select("token", "node").join(reached, "token").groupBy("node", "cell").agg(F.count("*").alias("many"))
    asking = asking.join(known.drop("cell"), "node").where(F.col("many") >= _least_shared(F.col("n")))
    members = posted.select("cell", "node", "comp", "size").distinct()
    queries = asking.select("cell", "node", "comp", "size")
    return _search(spark, members, queries, sets, blocks)


def _least_shared(n):
    """How many shingles of its front a set of n shares at least with any set linked to it, which may be smaller by a fifth."""
    smaller = F.floor((4 * n + 4) / 5)
    return 1 + F.floor(F.floor((4 * smaller + 4) / 5) / 20)


def jaccard_components(docs):
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text).

    Null, empty and blank texts have no shingles and are linked with nothing. Rows of a null id are linked with nothing
    and get a null component. Repeated rows are copies of each other. An id with several texts stands for all of them.
    """
    spark = docs.sparkSession
    with common.batches_of(spark, 2000):
        total = docs.count()
        hot, hot_count = frequent_shingles(docs)
        rows = _signatures(docs)
        fronts = _shared_fronts(docs, max(8, -(-total // NODES_PER_BUCKET)), hot, hot_count)
        firsts = rows.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
        nodes = common.materialized(fronts.groupBy("node").agg(F.count("*").alias("many")).join(firsts, "node").where(
            F.col("many") >= _least_shared(F.col("n"))).select("node", "doc_id"), "nodes")
        candidates = _sets(docs, nodes)
        # Of the whole set T shingles must be shared, which leaves little more than near copies.
        shingles = candidates.agg(F.sum("n")).first()[0] or 0
        support = _support(candidates, max(8, -(-shingles // SHINGLES_PER_BUCKET)))
        sizes = candidates.select("node", "n", *[f"least{k}" for k in range(MIN_HASHES)])
        near = common.materialized(sizes.join(support, "node").where(F.col("many") >= F.floor((4 * F.col("n") + 4) / 5)).withColumn(
            "shared", F.col("logs") / F.col("n")), "near")
        # Sets stay where they are; the searches ask for those of near nodes only.
        sets = common.materialized(_likely(candidates.select("node", "shingles"), "node", near), "near_sets")
        blocks = max(1, -(-(near.agg(F.sum("n")).first()[0] or 0) // SHINGLES_PER_BLOCK))
        cells = max(blocks, 8)
        first = _leader_links(spark, near, sets, cells)
        second = _cross_links(spark, near, sets, fronts, components(first), blocks)
        roots = common.materialized(components(first.unionByName(second)), "roots")
    named = rows.join(roots, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root"))
    lowest = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    made = named.join(lowest, "root", "left")
    id_ = F.col("doc_id")
    return made.select("doc_id", F.col("n").alias("n_shingles"), F.when(id_.isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_components(common.table(spark, sf_dir, "documents"))
