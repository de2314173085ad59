"""Operators over documents against plain versions, on awkward rows and on the smallest given tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlattice.llm import common, decontamination, jaccard, language, packing, quality, scoring, toxicity
from llm import brute

SMALL = "/root/testdata/sf0.001"


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def small(spark):
    return common.table(spark, SMALL, "documents")


@pytest.mark.parametrize("which", ["small", "awkward", "no_docs"])
def test_quality_counts(which, request):
    docs = request.getfixturevalue(which)
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
                  for r in quality.quality_rules(docs.where("length(text) < 8000 or text is null")).collect())
    assert got == Counter((i, *brute.base_rules(t)) for i, t in pairs(docs) if t is None or len(t) < 8000)


def test_quality_verdict_on_strange_and_plain_text(spark):
    rng = random.Random(3)
    plain = [" ".join(rng.choice(["the", "of", "river", "stone", "and", "walked", "green", "to"]) + "." * (k % 9 == 0) for k in range(90)) for _ in range(60)]
    strange = ["A" * 4 + " " + " ".join(f"Q{rng.randint(0, 10**6)}X|" for _ in range(80)), " | ".join(f"{rng.randint(0, 999)}" for _ in range(120))]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(plain + strange)], "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
    assert kept == set(range(60))


def test_quality_knows_rare_languages_of_a_large_table(spark):
    rng = random.Random(4)

    def texts(words, n):
        return [" ".join(rng.choice(words) for _ in range(90)) + "." for _ in range(n)]

    greek = texts(["και", "το", "ποταμός", "πέτρα", "πράσινο", "δάσος", "νύχτα", "δρόμος"], 30)
    thai = texts(["แม่น้ำ", "หิน", "และ", "เดิน", "เขียว", "ป่า", "คืน", "ถนน"], 5)
    junk = [" | ".join(f"{rng.randint(0, 999)}" for _ in range(120)) for _ in range(2)]
    rows = [(t, "en") for t in texts(["the", "of", "river", "stone", "and", "walked", "green", "to"], 6000)]
    rows += [(t, "el") for t in greek] + [(t, "th") for t in thai] + [(junk[0], "en"), (junk[1], "el")]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert {k for k, r in got.items() if not r["kept"] and not r["base_failed"]} == {6035, 6036}
    assert {got[k]["nearest_language"] for k in range(6000, 6030)} == {"el"} and got[6032]["nearest_language"] == "th"
    # The same documents alone: too few Thai texts fail nothing, and no other language is missing.
    few = {r["doc_id"]: r["kept"] or r["base_failed"] for r in quality.quality_rules(docs.where("doc_id >= 6000 and doc_id < 6035")).collect()}
    assert all(few.values())


def test_common_words_are_counted_over_all_documents(spark):
    rows = [(k, "rare " * 12 if k < 3 else f"often w{k % 7} x{k}", "en" if k % 2 else "de") for k in range(5000)] + [(6000, "once", "fr"), (6001, "no", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    want = {}
    for lang in ("en", "de", "fr"):
        counts = Counter(w for _, text, of in rows if of == lang for w in set(text.encode().split()))
        want[lang] = sorted(sorted(counts, key=lambda w: (counts[w], w), reverse=True)[:quality.COMMON_WORDS])
    assert {k: sorted(v) for k, v in quality._chosen_words(docs).items()} == want


def test_repeated_words_matches_plain_count():
    rng = random.Random(5)
    for _ in range(200):
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        assert quality.repeated_words(text.split()) == brute.base_rules(text)[4]


@pytest.mark.parametrize("which", ["small", "awkward", "no_docs"])
def test_decontamination(which, request, spark):
    docs = request.getfixturevalue(which)
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SMALL, "benchmark").collect()]
    items += [(900, "lazy dog and"), (901, None), (902, "..."), (None, "un deux"), (903, "fox"), (903, "b b b b b b b b b b b"), (904, "fox")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r["doc_id"], (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]))
           for r in decontamination.decontaminate(docs, bench, carry=("n_chars",)).collect()]
    rows = pairs(docs)
    want = list(zip((i for i, _ in rows), brute.contamination([t for _, t in rows], items)))
    assert Counter(got) == Counter(want)
    empty = decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count()
    assert empty == 0


def test_decontamination_in_several_blocks(spark, small, monkeypatch):
    bench = common.table(spark, SMALL, "benchmark")
    columns = ["doc_id", "n_hit", "items_sha256"]
    one = decontamination.decontaminate(small, bench).select(columns).collect()
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 250)
    assert Counter(decontamination.decontaminate(small, bench).select(columns).collect()) == Counter(one)


@pytest.mark.parametrize("which", ["small", "awkward", "no_docs"])
def test_packing_round_trip(which, request):
    from tokenizers import Tokenizer

    docs, path = request.getfixturevalue(which), packing.vocabulary()
    pieces = packing.pack(docs, path, length=64, with_ids=True)
    rows = pieces.collect()
    tokenizer = Tokenizer.from_file(path)
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in pairs(docs))
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at, whole, now = 0, Counter(), []
    for r in stream:
        assert r["sequence_id"] * 64 + r["offset"] == at and r["offset"] + r["length"] <= 64 and r["start"] == len(now)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        now += r["ids"]
        at += r["length"]
        if len(now) == r["doc_tokens"]:
            whole[r["doc_id"], tuple(now)] += 1
            now = []
    assert whole == want and not now
    full = packing.sequences(pieces, length=64).collect()
    assert sum(r["n_tokens"] for r in full) == at
    for r in full:
        power = r["n_tokens"] & (r["n_tokens"] - 1) == 0
        assert len(r["input_ids"]) == (r["n_tokens"] if power else 64)


def near(rng, base, edits):
    base = list(base)
    for _ in range(edits):
        base[rng.randrange(len(base))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(base)


def random_copies():
    """Groups of near copies of one original each, many around the limit of similarity, over one shared passage."""
    rng, texts = random.Random(11), []
    passage = " ".join(f"shared{k}" for k in range(40))
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(rng.choice([12, 60, 150]))]
        texts += [near(rng, base, rng.choice([0, 1, 1, 2, 3, 4])) for _ in range(25)]
        texts += [passage + " " + near(rng, base[:8], 1) for _ in range(6)]
    return list(enumerate(texts, 1000))


@pytest.mark.parametrize("shingles, width", [(1_000_000, 5), (500, 5), (500, 1)])
def test_jaccard_groups(spark, awkward, monkeypatch, shingles, width):
    monkeypatch.setattr(jaccard, "SHINGLES_PER_BLOCK", shingles)
    monkeypatch.setattr(jaccard, "TOKEN_BYTES", width)  # a byte makes many shingles of a bucket one token
    monkeypatch.setattr(jaccard, "FOLLOWERS_PER_CELL", 5)
    rows = pairs(awkward) + random_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect())
    low = brute.near_groups([(i, t) for i, t in rows if i is not None])
    assert got == Counter((i, len(brute.shingles(t)), low.get(i)) for i, t in rows)
    assert len(set(low.values())) < len(low) - 50


def test_jaccard_of_one_large_group(spark):
    """A third of all documents are near copies of one text; chains of edits link what is not alike."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, near(rng, base, rng.choice([0, 1, 2, 3]))) for k in range(150)]
    chain = [f"c{k}" for k in range(120)]
    for k in range(150, 210):
        chain[rng.randrange(120)] = f"new{k}"
        rows.append((k, " ".join(chain)))
    rows += [(k, " ".join(f"d{rng.randint(0, 10**6)}" for _ in range(60))) for k in range(210, 450)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute.near_groups(rows)
    assert list(got.values()).count(got[0]) > 100


def test_postings_come_back_from_ranges():
    hashes = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 5000, np.uint64))
    for buckets in (1, 8, 33):
        ranges = jaccard.Ranges(buckets)
        where = ranges.of(hashes)
        for k in range(buckets):
            own = hashes[where == k]
            back = ranges.restored(k, ranges.cut(k, own))
            assert (ranges.of(back) == k).all() and (back <= own).all() and (own - back < (1 << int(ranges.shift))).all()


ODD = [None, "", " ", "\n\t \x0b\x0c\r", "  aB\x1cc d\x85e f g  h ", "a b c d", "a b c d e", "a b c d e f a b c d e f", "É Ñ ß ÿ × ª K ẞ İ",
       "it's a <|endoftext|> X<|STARTOFTEXT|> b", "naïve, ÀÉ... ÑANDÚ.!! don't 12 a12, \U0001f600 日本", "á, b.\u0301 é.\u0301 x.\u0338",
       *(f"{chr(c)}q{chr(c)} Z{chr(c)}, {chr(c)}" for c in [*range(1, 0x180), *range(0x300, 0x340)])]


def test_words_are_numbered_in_arrow():
    for column in (pa.array(ODD), pa.array(ODD).slice(5), pa.array([], pa.string()), pa.array([None], pa.string())):
        words, codes, bounds = common.distinct_words(column)
        assert len(set(words)) == len(words) and len(bounds) == len(column) + 1
        for text, low, high in zip(column.to_pylist(), bounds, bounds[1:]):
            assert [words[c].decode() for c in codes[low:high]] == brute.words(text)
        sets = list(jaccard.shingle_sets(column))
        assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in column.to_pylist()]
        assert all((np.diff(s) > 0).all() for s in sets)


def test_packing_encodes_each_distinct_chunk_once(monkeypatch):
    tokenizer = packing.ChunkTokenizer(packing.vocabulary())
    own, asked = tokenizer.known, []

    class Known(common.Recent):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    tokenizer.known = Known(own.limit)
    for column in (pa.array(ODD), pa.array(ODD).slice(7), pa.array(["", None], pa.string())):
        ids, bounds = tokenizer.encode(column, 1)
        plain = tokenizer.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)
        assert [ids[low:high].tolist() for low, high in zip(bounds, bounds[1:])] == [[*found.ids, 1] for found in plain]
    asked.clear()
    tokenizer.encode(pa.array(["the same few words, "] * 500), 1)
    assert len(asked) <= 12  # by distinct chunk, not by occurrence


def test_support_sends_a_node_back_once_however_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TOKEN_BYTES", 8)
    rng = np.random.default_rng(8)
    pool = np.unique(rng.integers(0, 1 << 64, 3000, np.uint64))
    sets = {node: np.sort(rng.choice(pool, int(rng.integers(1, 200)), replace=False)) for node in range(-40, 40)}
    frame = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in sets.items()], "node bigint, shingles binary").repartition(3)
    df = Counter(x for s in sets.values() for x in s.tolist())
    logs = {n: sum(round(8 * np.log2(df[x])) / 8 for x in s.tolist() if df[x] > 1) for n, s in sets.items()}
    for buckets, postings, blocks in ((1, 1_000_000, 3), (8, 1_000_000, 3), (300, 1_000_000, 3), (300, 500, 20)):
        monkeypatch.setattr(jaccard, "FLUSH_POSTINGS", postings)
        got = {r["node"]: (r["many"], r["logs"]) for r in jaccard._support(frame, buckets).collect()}
        assert got == {n: (sum(df[x] > 1 for x in s.tolist()), logs[n]) for n, s in sets.items()}
        back = jaccard._marked(frame, buckets).collect()
        assert len({r["block"] for r in back}) <= blocks and len(back) <= blocks * buckets
        # Three bytes a shared shingle, not a row for each bucket of a node.
        assert sum(len(r["owners"]) + len(r["marks"]) for r in back) == 3 * sum(n for n, _ in got.values())
        assert sum(len(r["names"]) for r in back) == 8 * len(sets)


def test_sets_are_kept_once_of_repeated_rows(spark):
    rows = [(k % 5, " ".join(f"w{k % 5}x{i}" for i in range(9))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    nodes = jaccard._signatures(docs).select("node", "doc_id").distinct()
    assert sorted(r["n"] for r in jaccard._sets(docs, nodes).collect()) == [5] * 5


def test_jaccard_of_nothing(no_docs, spark):
    assert jaccard.jaccard_components(no_docs).count() == 0
    alone = spark.createDataFrame([(3, "only this"), (1, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(alone).collect())) == [(1, 0, 1), (3, 1, 3)]


def test_divide_skip_counts_like_a_plain_count():
    rng = random.Random(2)
    for _ in range(200):
        lists = [np.array(sorted(rng.sample(range(30), rng.randint(1, 30)))) for _ in range(rng.randint(1, 12))]
        least = rng.randint(1, 12)
        plain = Counter(x for run in lists for x in run.tolist())
        assert jaccard.divide_skip(lists, least) == {k: n for k, n in plain.items() if n >= least}


@pytest.mark.parametrize("which,tokens", [("small", 20_000), ("awkward", 4_000_000), ("no_docs", 100)])
def test_lm_scores(which, tokens, request, monkeypatch):
    docs = request.getfixturevalue(which)
    monkeypatch.setattr(scoring, "TOKENS_PER_SHARD", tokens)
    got = scoring.lm_scores(docs, common.crc_is("doc_id", 7, 2)).collect()
    rows = [(i, brute.words(t) + [None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in pairs(docs)]
    one, two, starts = Counter(), Counter(), 0
    for _, w, held in rows:
        if not held:
            one.update(w)
            two.update(zip(["\n", *w], w))
            starts += 1
    n, v = sum(one.values()), len(one)
    one["\n"] = starts
    want = []
    for i, w, held in rows:
        p = [(one[x] + 1) / (n + v + 1) for x in w]
        score = sum(math.log10((two[h, x] + scoring.MASS * q) / (one[h] + scoring.MASS)) for h, x, q in zip(["\n", *w], w, p))
        want.append((i, held, len(w), sum(one[x] > 0 for x in w), n, round(sum(map(math.log10, p)), 4), round(score, 4)))
    assert Counter(want) == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4),
                                     round(r["score"], 4)) for r in got)


def test_backoff_probabilities_sum_to_one():
    counts, distinct = np.array([3, 2, 1]), 3
    a = scoring.Automaton(counts, np.array([2, 1]), np.array([0, 0]), np.array([1, 2]), 1, 6, distinct)
    rest = 1 / (6 + 3 + 1)  # all unseen words together
    seen = 10 ** a.arcs[0] + 10 ** a.arcs[1]
    backed = 10 ** a.failure[0] * (10 ** a.root[0] + rest)
    assert abs(seen + backed - 1) < 1e-12


def toxic_table(spark):
    rng, rows, labels = random.Random(4), [], []
    common_words = [a + b + c for a in ("ti", "on", "re", "sh") for b in ("an", "or", "en") for c in ("th", "ed", "ly")]
    for i in range(900):
        toxic = i % 6 == 0
        w = [rng.choice(common_words) for _ in range(rng.randint(8, 200))]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["scumbag", "moronic", "trashy"]) + rng.choice(["", "s", "x"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(9000, None), (9001, ""), (None, "tian"), (3, rows[3][1])]
    labels += [(None, 1, 1), (12, 1, None), (7, 0, 0)]
    return (spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit("clash")),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_toxicity_held_out_accuracy(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9000]["predicted"] == by_id[9001]["predicted"] == 0


def test_toxicity_without_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity(awkward, none, carry=("text", "label")).collect()
    assert len(rows) == awkward.count() and {r["score"] for r in rows} == {0.0} and rows[0]["label"] == 4


def test_language_held_out_accuracy(small, spark):
    rows = language.identify(small).join(small.select("doc_id", "lang"), "doc_id").where(common.crc_is("doc_id", 3, 1)).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.9 * len(rows)


def test_language_of_awkward_rows(awkward, no_docs):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(awkward).collect()]
    assert len(got) == awkward.count()
    assert {i for i, lang, _ in got if lang == "und"} == {None, 1, 2, 3, 10}
    assert all(0 <= s <= 1 for _, _, s in got)
    assert language.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in language.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("languages", [1, 2, 4, 5, 6, 20])
def test_codewords_are_apart(languages):
    code = language.codewords(languages)
    assert len({tuple(r) for r in code.tolist()}) == languages
    if languages > 2:
        distance = (code.shape[1] - code @ code.T) / 2
        assert distance[~np.eye(languages, dtype=bool)].min() >= 2
