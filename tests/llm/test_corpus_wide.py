"""Mixing, alignment and ranked search against plain versions, on awkward rows and on the smallest given tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import compare, connect
from flowlattice.llm import alignment, common, mixing, ranking
from llm import brute

SMALL = "/root/testdata/sf0.001"
PATHS = tuple(str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


REFERENCE = Tokenizer.from_file(PATHS[0])
REFERENCE.encode_special_tokens = True


@pytest.fixture(scope="module")
def small(spark):
    return common.table(spark, SMALL, "documents")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*PATHS)


# Mixing


def plain_targets(sizes, weights, share, most):
    """Shares are dealt, sources above their ceiling leave with it, the rest is dealt again."""
    targets, left, open_ = {}, share * sum(sizes.values()), set(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] > most * sizes[s] * total}
        if not over:
            return targets | {s: Fraction(left * weights[s], total) for s in open_}
        targets |= {s: Fraction(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return targets


def check_mix(docs, rows, share=mixing.SHARE, most=mixing.MAX_EPOCHS):
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    texts = Counter((r["doc_id"], r["source"], len(brute.WORD.findall(r["text"] or ""))) for r in docs.collect())
    assert texts == Counter((r["doc_id"], r["source"], r["size"]) for r in rows)
    for r in rows:
        sizes[r["source"]] += r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        taken[r["source"]] += r["taken"]
        assert r["taken"] in {r["size"] * k for k in range(most + 1)}
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    targets = plain_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, share, most)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2
    return sizes, targets


@pytest.mark.parametrize("which", ["small", "awkward", "no_docs"])
def test_mix_meets_targets(which, request):
    docs = request.getfixturevalue(which)
    rows = mixing.mix(docs).collect()
    check_mix(docs, rows)
    assert Counter(rows) == Counter(mixing.mix(docs.repartition(3)).collect())


def test_mix_sql(spark, con):
    assert isinstance(compare(mixing.op11_mixing(spark, SMALL), con, mixing.ORACLE_OP11), tuple)


def test_mix_of_repeated_rows_and_many_sources(spark):
    rng = random.Random(1)
    rows = [(7, "one two three", "hot", k) for k in range(4000)]
    rows += [(k, "a " * rng.randint(0, 40), f"s{k % 37}" if k % 41 else None, k) for k in range(2000)] + [(None, None, "empty", 0), (1, " ", "empty", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    made = mixing.mix(docs).collect()
    _, targets = check_mix(docs, made)
    assert targets["empty"] == 0
    # All rows of the hot source are one document, 4,000 times: as many are taken as fit.
    assert abs(sum(r["taken"] for r in made if r["source"] == "hot") - targets["hot"]) <= 1.5


def test_mix_budgets_are_nested(spark, small):
    few, more = ({(r["doc_id"]): r["taken"] for r in mixing.mix(small, share=share).collect()} for share in (Fraction(1, 4), Fraction(3, 5)))
    assert 0 < sum(few.values()) < sum(more.values()) and all(more[k] >= few[k] for k in few)


def test_mix_weights_and_text(spark, small):
    weights = spark.createDataFrame([("src1", 5), ("src2", 1)], "source string, weight int")
    rows = mixing.mix(small, weights, share=Fraction(1, 10)).collect()
    targets = {r["source"]: r["target"] for r in rows}
    assert math.isclose(targets["src1"], 5 * targets["src2"]) and targets["src2"] == targets["src3"]
    out = mixing.mixed(small, share=Fraction(1)).collect()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(small, share=Fraction(1)).collect()}
    words = Counter()
    for r in out:
        words[r["doc_id"]] += len(brute.WORD.findall(r["text"]))
    assert words == Counter({k: n for k, n in taken.items() if n})


def test_mix_everything_at_the_ceiling(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id int, text string, source string")
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(docs, share=Fraction(5)).collect()} == {(1, 4), (2, 2)}


# Alignment


def plain_ends(tokens, ids):
    ends, at = [], 0
    for i in ids:
        at += len(tokens[i])
        ends.append(at)
    return ends


def plain_alignment(pair, docs):
    made, counts = [], Counter()
    for doc, text in docs:
        a = REFERENCE.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pair.second.encode(text or "")
        raw = b" " + (text or "").encode()
        if not text or b"".join(pair.a.tokens[i] for i in a) != raw or b"".join(pair.b.tokens[i] for i in b) != raw:
            made.append((doc, None))
            continue
        ends = plain_ends(pair.a.tokens, a), plain_ends(pair.b.tokens, b)
        groups, low = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append(tuple([k for k, e in enumerate(side) if low < e <= cut] for side in ends) if len(raw) < 3000 else None)
            low = cut
        if len(raw) >= 3000:
            places = ([], [])
            for side, out in zip(ends, places):
                k = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    first = k
                    while k < len(side) and side[k] <= cut:
                        k += 1
                    out.append(list(range(first, k)))
            groups = list(zip(*places))
        linked = [(a[i], b[j]) for ga, gb in groups for i in ga for j in gb
                  if max(ends[0][i] - len(pair.a.tokens[a[i]]), ends[1][j] - len(pair.b.tokens[b[j]])) < min(ends[0][i], ends[1][j])]
        counts.update(linked)
        text = ";".join(",".join(str(a[i]) for i in ga) + "|" + ",".join(str(b[j]) for j in gb) for ga, gb in groups)
        made.append((doc, (len(a), len(b), len(groups), linked, hashlib.sha256(text.encode()).hexdigest())))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return Counter((doc, *((0,) * 6 + ("",) if v is None else (
        v[0], v[1], v[2], len(v[3]), sum(counts[x] == best[x[1]] for x in v[3]), sum(counts[x] for x in v[3]), v[4]))) for doc, v in made)


@pytest.mark.parametrize("which, size", [("small", alignment.CHUNK_BYTES), ("small", 300), ("awkward", 64), ("awkward", alignment.CHUNK_BYTES), ("no_docs", 64)])
def test_alignment(which, size, pair, request):
    docs = request.getfixturevalue(which)
    got = Counter(tuple(r) for r in alignment.align(docs, *PATHS, chunk_bytes=size).collect())
    assert got == plain_alignment(pair, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_alignment_gives_up_texts_that_do_not_come_back(spark, pair):
    long = "word " * 300 + "▁ and " + "more " * 300
    docs = spark.createDataFrame([(1, "a▁b"), (2, long), (3, "plain words"), (4, None)], "doc_id bigint, text string")
    got = Counter(tuple(r) for r in alignment.align(docs, *PATHS, chunk_bytes=100).collect())
    assert got == plain_alignment(pair, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r[1] > 0 for r in got) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["the", "naïve", "日本語", "\U0001f600", "x\ny", "  ", "\t", "it's", "<s>", "<0x41>", "<|endoftext|>", "a　b", "1234567", "Ünïcödé", "\u0085", "zzzzqqqq"]), min_size=1, max_size=30),
       st.integers(1, 40), st.booleans())
def test_fragments_compose_to_the_whole(pair, words, size, left):
    text = " ".join(words)
    whole = alignment.fragments(pair, [alignment.whole(text)])[0]
    parts = alignment.fragments(pair, list(alignment.ranges(text, size)))
    assert whole is not None and None not in parts
    while len(parts) > 1:
        # Any order of composition gives the same.
        k = 0 if left else len(parts) - 2
        parts[k:k + 2] = [alignment.compose(parts[k], parts[k + 1], pair.width)]
    assert (parts[0].text, parts[0].keys.tolist(), parts[0].n_a, parts[0].n_b, parts[0].n_groups) == (
        whole.text, whole.keys.tolist(), whole.n_a, whole.n_b, whole.n_groups)
    assert not any(map(len, (*parts[0].prefix, *parts[0].suffix)))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_texts_are_encoded_as_a_whole(pair, text):
    """What is put together from remembered parts is what both tokenizers make of the whole text."""
    found = pair.encode([text])[0] if text else None
    want = REFERENCE.encode(" " + text, add_special_tokens=False).ids, pair.second.encode(text)
    raw = (" " + text).encode()
    whole = b"".join(pair.a.tokens[i] for i in want[0]) == raw == b"".join(pair.b.tokens[i] for i in want[1])
    assert (found is not None and tuple(x.tolist() for x in found) == want) if text and whole else found is None


def test_ranges_of_one_long_run_are_not_cut(pair):
    assert len(list(alignment.ranges("x" * 5000, 64))) == 1
    some = list(alignment.ranges("x" * 500 + " " + "y" * 500 + " z", 64))
    assert len(some) == 2 and sum(r.high - r.low for r in some) == 1004


def test_blocks_of_few_links(spark, pair, monkeypatch):
    docs = spark.createDataFrame([(k, f"the text {k} of the {'long ' * k}block") for k in range(40)], "doc_id bigint, text string")
    whole = Counter(tuple(r) for r in alignment.align(docs, *PATHS).collect())
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 50)
    assert Counter(tuple(r) for r in alignment.align(docs, *PATHS).collect()) == whole


@pytest.mark.parametrize("pairs, width", [(9000, 2), (1 << 16, 2), ((1 << 16) + 1, 4)])
def test_blocks_are_bounded_and_hold_short_places(spark, pairs, width):
    """A block is one row, so its size counts: half a million links, two bytes each while those can number its pairs."""
    keys = (np.arange(100_000) * 7) % pairs + 5
    blocks = alignment._Blocks(common.arrow_schema(alignment._BLOCK.format(id="bigint"))[1], 3)
    added = 0
    while not blocks.add(added, alignment.Fragment(True, alignment._NONE, alignment._NONE, b"1|2", keys, 1, 1, 1)):
        added += 1
    row = blocks.close().to_pylist()[0]
    assert len(row["at"]) == width * sum(row["n_links"]) <= width * 600_000
    places = np.frombuffer(row["at"], alignment._place_type(len(row["pairs"])))
    assert (np.array(row["pairs"])[places] == np.tile(keys, added + 1)).all() and sum(row["totals"]) == len(places)


def test_tables_of_long_rows_have_small_row_groups(spark):
    docs = spark.range(24, numPartitions=1).select(F.expr("concat_ws(' ', transform(sequence(1, 4000), x -> sha2(concat(id, ' ', x), 256)))").alias("text"))
    for row_group, most in ((None, 24), (1 << 20, 8)):
        table = common.materialized(docs, "long", row_group)
        found = [pq.ParquetFile(path.removeprefix("file:")).metadata for path in table.inputFiles()]
        assert max(m.row_group(k).num_rows for m in found for k in range(m.num_row_groups)) <= most and table.count() == 24


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_rank(docs, items, top=10):
    counted = [(doc, Counter(TERM.findall(brute.lower(text)))) for doc, text in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    terms = defaultdict(set)
    for item, text in items:
        terms[item] |= set(TERM.findall(brute.lower(text)))
    made = set()
    for item, wanted in terms.items():
        scores = []
        for doc, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc))
        made |= {(item, k + 1, doc, -score) for k, (score, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])}
    return made


ITEMS = [(1, "The quick brown fox"), (2, ""), (3, None), (None, "été naïve\U0001f600"), (1, "lazy DOG's"), (4, "b"), (5, "!!"), (6, "un deux same line other")]


@pytest.mark.parametrize("which", ["small", "awkward", "no_docs"])
def test_rank(spark, which, request):
    docs = request.getfixturevalue(which)
    items = ITEMS + [(100 + k, r["text"][20:120]) for k, r in enumerate(docs.where("length(text) > 200").limit(8).collect())]
    benchmark = spark.createDataFrame([(*i, 1, "d") for i in items], "item_id int, text string, score int, doc_id string")
    got = ranking.rank(docs, benchmark).collect()
    assert len(got) == len({tuple(r) for r in got if r["doc_id"] != 5}) + sum(r["doc_id"] == 5 for r in got)
    assert {tuple(r) for r in got} == plain_rank([(r["doc_id"], r["text"]) for r in docs.collect()], items)


def test_rank_sql(spark, con):
    assert isinstance(compare(ranking.op13_ranked_search(spark, SMALL), con, ranking.ORACLE_OP13), tuple)


def test_rank_in_blocks_and_slices(spark, small, monkeypatch):
    benchmark = common.table(spark, SMALL, "benchmark")
    want = {tuple(r) for r in ranking.rank(small, benchmark).collect()}
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 150)
    monkeypatch.setattr(ranking, "CELLS_AT_ONCE", 7)
    assert {tuple(r) for r in ranking.rank(small, benchmark).collect()} == want


def test_rank_ties_and_repeats(spark):
    docs = spark.createDataFrame([(k % 30, "common words here" if k < 60 else f"other text {k}") for k in range(90)], "doc_id bigint, text string").repartition(5)
    items = spark.createDataFrame([(1, "common")], "item_id int, text string")
    assert [r["doc_id"] for r in ranking.rank(docs, items).orderBy("rank").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert ranking.rank(docs, items.where("item_id > 1")).count() == 0
