"""Ranked lexical search: an Aho-Corasick scan of the documents for the terms of all items.

The items' distinct terms become one automaton, each guarded by a blank on both sides. A document is read as it is: bytes that are no part of a
term become blanks, so the automaton finds whole terms only, and neighbouring terms share the blank between them.
There is no index of the documents. Two scans run: the first gives the number of documents, of terms and of documents that hold each item
term; the second knows the weights, counts each term's occurrences and hands them on to the items that hold the term.

A task keeps the best of each item over all its documents, so what leaves it does not grow with them; the best of all tasks are found
in two steps, by groups of tasks and then by item. Terms reach the tasks in blocks of items with about `BLOCK_TERMS` terms in all, at
most twice as many (but an item is never split); every block's result is written before the next block starts.
"""

import math
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlattice.llm import common

TOP, BLOCK_TERMS = 10, 200_000
DOCS_AT_ONCE, CELLS_AT_ONCE = 256, 4_000_000
_TASKS_PER_GROUP = 256

# A term is a run of 0-9, a-z (A-Z lower-cased) and whatever lies beyond ASCII.
_GUARD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def guarded(text):
    """The text's terms between blanks, as bytes: lower-cased A-Z, a blank at both ends and for every other byte."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").translate(_GUARD).lower() + b" "


def terms_of(text):
    return [t for t in guarded(text).split(b" ") if t]


class Block:
    """Items of one block: their terms, and for every term the items that hold it."""

    def __init__(self, items):
        self.items = [item for item, _ in items]
        self.terms = sorted({t for _, terms in items for t in terms})
        at = {t: k for k, t in enumerate(self.terms)}
        holders = [[] for _ in self.terms]
        for place, (_, terms) in enumerate(items):
            for t in terms:
                holders[at[t]].append(place)
        self.first = np.concatenate(([0], np.cumsum([len(h) for h in holders]))).astype(np.int64)
        self.holders = np.array([p for h in holders for p in h], np.int64)


class Scanner:
    """The boundary-guarded automaton of a block. Bytes are read as characters of one byte each."""

    def __init__(self, terms):
        self.automaton = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            self.automaton.add_word((b" " + term + b" ").decode("latin-1"), k)
        self.automaton.make_automaton()
        self.some = bool(terms)

    def counts(self, text):
        """(number of terms of the text, found term numbers, their occurrences)."""
        raw = guarded(text)
        length = len(raw.split())
        found = [k for _, k in self.automaton.iter(raw.decode("latin-1"))] if self.some and length else []
        return length, *np.unique(np.array(found, np.int64), return_counts=True)


def _scanner(name, shipped):
    return common.held(name, lambda: (shipped.value, Scanner(shipped.value["terms"])))


def _corpus(docs, name, shipped):
    """(number of documents with a term, number of terms, documents that hold each term)."""
    def scan(batches):
        block, scanner = _scanner(name, shipped)
        # The two numbers behind the terms are documents and terms in all.
        sums = np.zeros(len(block["terms"]) + 2, np.int64)
        for batch in batches:
            for text in common.each(batch.column(0)):
                length, found, _ = scanner.counts(text)
                sums[found] += 1
                sums[-2] += length > 0
                sums[-1] += length
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "n": pa.array(sums[some], pa.int64())})

    sums = np.zeros(len(shipped.value["terms"]) + 2, np.int64)
    for row in docs.select("text").mapInArrow(scan, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        sums[row["term"]] = row["n"]
    return int(sums[-2]), int(sums[-1]), sums[:-2]


def weight(documents, holding):
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class _Best:
    """The best (score, id) of every item so far: at most `top` each, equal scores by id, a null id last."""

    def __init__(self, items, top):
        self.top, self.floor = top, np.zeros(items, np.int64)
        self.item, self.score, self.id, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, scores, ids, nulls):
        """`scores` by document and item. A score below an item's last one changes nothing."""
        doc, item = np.nonzero((scores > 0) & (scores >= self.floor))
        if not len(doc):
            return
        item, score = np.concatenate((self.item, item)), np.concatenate((self.score, scores[doc, item]))
        ids, nulls = np.concatenate((self.id, ids[doc])), np.concatenate((self.null, nulls[doc]))
        order = np.lexsort((ids, nulls, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
        order, item = order[rank < self.top], item[rank < self.top]
        self.item, self.score, self.id, self.null = item, score[order], ids[order], nulls[order]
        last = np.flatnonzero(np.bincount(item, minlength=len(self.floor))[item] == self.top)
        self.floor[:] = 0
        # Scores fall within an item, so the last one written is the lowest.
        self.floor[item[last]] = self.score[last]


def _scored(docs, name, shipped, top):
    """(item place, task, doc_id, score): the best documents of each task."""
    schema = "place bigint, task bigint, doc_id bigint, score bigint"
    _, arrow = common.arrow_schema(schema)

    def run(batches):
        block, scanner = _scanner(name, shipped)
        weights, first, holders = block["weights"], block["first"], block["holders"]
        n_items, documents, all_terms = block["n_items"], block["documents"], block["all_terms"]
        at_once = max(1, min(DOCS_AT_ONCE, CELLS_AT_ONCE // max(1, n_items)))
        best = _Best(n_items, top)
        for batch in batches:
            for low in range(0, batch.num_rows, at_once):
                part = batch.slice(low, at_once)
                scores = np.zeros((part.num_rows, n_items), np.int64)
                for k, text in enumerate(common.each(part.column(1))):
                    length, found, tf = scanner.counts(text)
                    if not len(found):
                        continue
                    m = 100 - 90 + (90 * length * documents) // all_terms
                    gain = weights[found] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                    many = first[found + 1] - first[found]
                    each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[found], many)
                    np.add.at(scores[k], holders[each], np.repeat(gain, many))
                ids = part.column(0)
                best.add(scores, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
        n = len(best.item)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(np.full(n, TaskContext.get().partitionId(), np.int64)),
             pa.array(best.id, pa.int64(), mask=best.null), pa.array(best.score)], schema=arrow)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def _ranked(scored, top):
    """The `top` of each item: first within groups of tasks, then over the groups' best."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    group = F.floor(F.col("task") / _TASKS_PER_GROUP)
    near = scored.withColumn("_group", group).withColumn(
        "rank", F.row_number().over(Window.partitionBy("place", "_group").orderBy(*order))).where(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("rank") <= top)


def _items(benchmark):
    """((item_id, terms) of items with terms, written; number of blocks): texts of one id are one item."""
    def cut(columns):
        return {"item_id": columns["item_id"], "terms": [sorted(set(terms_of(t))) for t in columns["text"]]}

    kind = benchmark.schema["item_id"].dataType.simpleString()
    cuts = common.map_rows(benchmark.select("item_id", "text"), cut, f"item_id {kind}, terms array<binary>")
    items = common.materialized(cuts.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(
        F.collect_set("term").alias("terms")), "items")
    some, terms = items.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = -(-int(terms or 0) // BLOCK_TERMS)
    # Hashes spread items evenly, but for few or very long ones.
    while 1 < blocks < some and items.groupBy(_block(blocks)).agg(F.sum(F.size("terms")).alias("n")).where(F.col("n") > 2 * BLOCK_TERMS).count():
        blocks = 2 * blocks
    return items, blocks


def _block(blocks):
    return F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")


def rank(docs, benchmark, top=TOP):
    """The `top` documents of every item of `benchmark` (item_id, text): (item_id, rank, doc_id, score).

    Documents are the rows of `docs` (doc_id, text); repeated rows are documents each, null and empty texts have no terms and count
    nowhere. Equal scores rank by ascending id, null ids last. Rows of one item id are one item, so is the null id; items without terms, and
    items none of whose terms occurs with a weight above 0, have no rows. Empty tables give none. Other columns are not read.
    """
    spark = docs.sparkSession
    items, blocks = _items(benchmark)
    made = []
    for k in range(blocks):
        block = Block([(r["item_id"], {bytes(t) for t in r["terms"]}) for r in items.where(_block(blocks) == k).collect()])
        name = uuid.uuid4().hex
        # The automaton is built in every worker; what is sent are the terms.
        documents, all_terms, holding = _corpus(docs, name + "c", spark.sparkContext.broadcast({"terms": block.terms}))
        shipped = spark.sparkContext.broadcast({
            "terms": block.terms, "weights": np.array([weight(documents, int(n)) for n in holding], np.int64), "first": block.first,
            "holders": block.holders, "n_items": len(block.items), "documents": documents, "all_terms": all_terms})
        best = common.materialized(_ranked(_scored(docs, name, shipped, top), top), "ranked")
        kind = benchmark.schema["item_id"].dataType.simpleString()
        names = spark.createDataFrame(list(enumerate(block.items)), f"place bigint, item_id {kind}")
        made.append(best.join(names, "place").select("item_id", "rank", "doc_id", "score"))
        shipped.unpersist()
    if not made:
        kind = benchmark.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    whole = made[0]
    for other in made[1:]:
        whole = whole.unionByName(other)
    return whole


def op13_ranked_search(spark, sf_dir):
    return rank(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE_OP13 = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
counted AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted CROSS JOIN corpus GROUP BY term),
gains AS (
  SELECT c.doc_id, c.term, w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 90 + ((90 * l.n * docs) // terms)))) AS gain
  FROM counted c JOIN weights w ON c.term = w.term JOIN lengths l ON c.doc_id = l.doc_id CROSS JOIN corpus),
scores AS (
  SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score
  FROM item_terms i JOIN gains g ON i.term = g.term GROUP BY item_id, doc_id HAVING sum(gain) > 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
