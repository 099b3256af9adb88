"""Hard negatives, embedding near-dedup and lexical search against brute force, and odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup, hard_negatives as mining, lexical_search as lexical
from millrace.llm.embedding_dedup import embedding_duplicates, quantise
from millrace.llm.hard_negatives import LEVELS, Query, hard_negatives, one_bit_codes, rotated
from millrace.llm.lexical_search import build_index, decoded, encoded, search
from millrace.session import ship_package

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<double>, label int, rid string, grp string"


def clouds(n=700, dim=24, seed=5):
    """Clusters of all densities, copies, multiples, ties, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    data = []
    for i in range(n):
        spread = rng.choice([0.02, 0.1, 0.3, 1.0])
        data.append((i, (centres[i % 12] + spread * rng.normal(size=dim)).tolist(), int(rng.integers(0, 3)), "x", "y"))
    data += [(n + i, data[i * 3][1], data[i * 3][2], "x", "y") for i in range(30)]  # copies
    data += [(n + 50 + i, [3 * x for x in data[i][1]], data[i][2], "x", "y") for i in range(20)]
    odd = [None, [], [0.0] * dim, [NAN] * dim, [INF] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * (dim + 1), [1e-300] * dim]
    data += [(2000 + i, v, 1, "x", "y") for i, v in enumerate(odd)]
    data += [(2100, data[0][1], None, "x", "y"), (None, data[0][1], data[0][2], "x", "y"), (700, data[5][1], 1, "x", "y"), (0, data[0][1], data[0][2], "x", "y")]
    return data


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# --- hard negatives ---------------------------------------------------------------------------

def brute_negatives(data, is_anchor, k=5, low=80, high=100, scale=256):
    rows = [(i, np.floor(scale * np.array(v, float)).astype(int), lab) for i, v, lab, *_ in data
            if i is not None and lab is not None and usable(v)]
    want = Counter()
    for a, (ai, av, al) in enumerate(rows):
        if not is_anchor(ai):
            continue
        scored = sorted(((-int(av @ v), i, n, lab) for n, (i, v, lab) in enumerate(rows) if n != a and len(v) == len(av)))
        for s, i, n, lab in [r for r in scored if r[3] == al][:k]:
            inside = [r for r in scored if r[3] != al and low * -s <= 100 * -r[0] <= high * -s][:k]
            for rank, r in enumerate(inside):
                want[ai, i, rank + 1, r[1], -s, -r[0]] += 1
    return want


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    data = clouds()
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    got = Counter(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute_negatives(data, lambda i: i % 20 == 0)
    # many small blocks, another band and other numbers give what the same rows give
    monkeypatch.setattr(mining, "BLOCK_VALUES", 1)
    monkeypatch.setattr(mining, "LEAST_ROWS", 64)
    monkeypatch.setattr(mining, "ANCHORS", 8)
    got = Counter(tuple(r) for r in hard_negatives(
        df, F.col("vec_id") % 9 == 0, positives=3, negatives=3, low_percent=50, high_percent=90).collect())
    assert got == brute_negatives(data, lambda i: i % 9 == 0, 3, 50, 90)


def test_intervals_hold_every_score():
    rng = np.random.default_rng(1)
    for dim in (1, 5, 64, 100, 300):
        whole = rng.integers(-300, 300, (200, dim)).astype(np.int32)
        whole[0] = 0
        units = whole / np.maximum(np.linalg.norm(whole, axis=1), 1)[:, None]
        z = rotated(units)
        assert np.allclose(z @ z.T, units @ units.T, atol=1e-12)
        bits, along, rest = one_bit_codes(z)
        for row in (0, 1, 7):
            query, w, estimate = Query(whole[row]), z[row], np.zeros(200)
            for level in range(LEVELS):
                on_code = query.on_codes(bits[:, level])
                estimate += along[:, level] * on_code
                signs = np.unpackbits(bits[:, level].view(np.uint8).reshape(200, -1), axis=1, bitorder="little") * 2.0 - 1
                assert np.abs(signs @ w / np.sqrt(len(w)) - on_code).max() <= query.error + 1e-9
                beside = np.sqrt(np.maximum(0, 1 - np.maximum(0, np.abs(on_code) - query.error) ** 2))
                assert (np.abs(z @ w - estimate) <= beside * rest[:, level] + query.error * (1 + rest[:, level]) + 1e-9).all()
            assert np.median(rest[:, -1]) < 0.25


def test_intervals_rule_rows_out(spark):
    """Few rows of a block are scored in whole numbers."""
    rng = np.random.default_rng(2)
    whole = np.floor(256 * rng.normal(size=(4000, 64)) / 8).astype(np.int32)
    units = whole / np.linalg.norm(whole, axis=1)[:, None]
    bits, along, rest = one_bit_codes(rotated(units))
    block = mining.Block.__new__(mining.Block)
    block.bits, block.along, block.rest, block.norms = bits, along, rest, np.linalg.norm(whole, axis=1)
    left = block.narrowed(np.arange(4000), Query(whole[0]), lambda low, high: high >= mining._nth_largest(low, 5))
    assert 0 in left and len(left) < 1500


def test_hard_negatives_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty, F.lit(True)).collect() == []
    far = spark.createDataFrame([(0, [1e30, 1.0], 0, "", ""), (1, [1e30, 2.0], 0, "", ""), (2, [1e30, 0.5], 1, "", "")], SCHEMA)
    got = hard_negatives(far, F.col("vec_id") == 0).collect()
    assert [(r.positive_id, r.negative_id, r.positive_score) for r in got] == [(1, 2, mining.MOST ** 2 + 256 * 512)]
    alone = spark.createDataFrame([(0, [1.0], 0, "", ""), (100, [1.0], 0, "", ""), (7, [-1.0], 1, "", "")], SCHEMA)
    assert hard_negatives(alone, F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives(alone, F.lit(None).cast("boolean")).collect() == []


# --- embedding near-dedup ---------------------------------------------------------------------

def brute_links(data, threshold, by_label=True):
    rows = [(n, i, np.array(v, float) / max(map(abs, v)), lab) for n, (i, v, lab, *_) in enumerate(data)
            if i is not None and (lab is not None or not by_label) and usable(v) and any(v)]
    parent, links = list(range(len(data))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (n, _, v, lab) in enumerate(rows):
        for m, _, w, other in rows[:x]:
            if len(v) == len(w) and (lab == other or not by_label) and v @ w / math.sqrt((v @ v) * (w @ w)) >= threshold:
                links[n] += 1
                links[m] += 1
                parent[find(n)] = find(m)
    least = {}
    for n, i, *_ in rows:
        least[find(n)] = min(i, least.get(find(n), i))
    out = Counter()
    for n, (i, *_) in enumerate(data):
        component = least.get(find(n), i)
        out[i, links[n], component, i is None or i == component] += 1
    return out


@pytest.mark.parametrize("threshold", [0.98, 0.9])
def test_embedding_links_against_brute_force(spark, monkeypatch, threshold):
    data = clouds(500)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert Counter(tuple(r) for r in embedding_duplicates(df, threshold).collect()) == brute_links(data, threshold)
    monkeypatch.setattr(embedding_dedup, "TILE_BYTES", 1)  # tiles of 64
    monkeypatch.setattr(embedding_dedup, "SIDE", 16)
    ship_package(spark)
    got = Counter(tuple(r) for r in embedding_duplicates(df, threshold, label_col=None).collect())
    assert got == brute_links(data, threshold, by_label=False)


def test_bound_of_quantised_products():
    rng = np.random.default_rng(3)
    for dim in (1, 2, 64, 1500):
        units = rng.normal(size=(120, dim)) * rng.choice([1e-6, 1.0, 50.0], (120, dim))
        units /= np.linalg.norm(units, axis=1)[:, None]
        codes, scale, length, error = quantise(units)
        whole = codes.astype(np.int64)
        bound = (whole @ whole.T) * scale[:, None] * scale[None, :] + length[:, None] * error[None, :] + error[:, None]
        assert (units @ units.T <= bound + 1e-12).all()


def test_large_group_of_near_copies(spark):
    """A third of the rows near one point: counts are whole though no pair is returned."""
    rng = np.random.default_rng(4)
    near = rng.normal(size=16) + 0.01 * rng.normal(size=(1500, 16))
    far = rng.normal(size=(1500, 16))
    data = [(i, v.tolist(), 0, "", "") for i, v in enumerate(np.concatenate([near, far]))]
    got = {r.vec_id: r for r in embedding_duplicates(spark.createDataFrame(data, SCHEMA), 0.98).collect()}
    assert all(got[i].n_links >= 1499 and got[i].component_id == 0 for i in range(1500))
    assert sum(r.kept for r in got.values()) > 1400


def test_embedding_odd_tables(spark):
    assert embedding_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(1, None, 1, "", ""), (2, None, None, "", "")], SCHEMA)
    assert {tuple(r) for r in embedding_duplicates(none).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}
    huge = spark.createDataFrame([(1, [1e300, 1e300], 1, "", ""), (2, [1e-300, 1e-300], 1, "", "")], SCHEMA)
    assert {tuple(r) for r in embedding_duplicates(huge).collect()} == {(1, 1, 1, True), (2, 1, 1, False)}


# --- lexical search ---------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute_ranking(docs, items, k):
    held = [(i, c, sum(c.values())) for i, c in ((d[0], terms_of(d[1])) for d in docs) if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    postings = defaultdict(list)
    for x, (_, c, _) in enumerate(held):
        for term, tf in c.items():
            postings[term].append((x, tf))
    want = Counter()
    for item, text, *_ in items:
        scores = Counter()
        for term, times in terms_of(text).items():
            own = postings.get(term, [])
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * len(own) + 1)))
            for x, tf in own:
                m = 75 + (25 * held[x][2] * n_docs) // total
                scores[x] += times * weight * ((10 ** 9 * tf) // (1000 * tf + 12 * m))
        best = sorted((-s, held[x][0] is None, held[x][0] or 0) for x, s in scores.items() if s > 0)[:k]
        for rank, (s, none, i) in enumerate(best):
            want[item, rank + 1, None if none else i, -s] += 1
    return want


def prose(n=1500, seed=8):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Éa", "ñ", "x1", "THE"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rnd.choice([" ", ", ", "\n"]).join(rnd.choices(words, weights, k=rnd.choice([1, 5, 40, 200]))), "d") for i in range(n)]
    docs += [(n + i, docs[i][1], "copy") for i in range(min(n, 60))]  # ties
    docs += [(n + 100, None, ""), (n + 101, "", ""), (n + 102, "!? --", ""), (None, "w0 w3 w399", ""), (5, "w5 w5 w5", "")]
    docs += [(n + 103, " ".join(rnd.choices(words, k=30_000)), "long")]
    items = [(i, " ".join(rnd.choices(words, weights, k=rnd.choice([1, 3, 12, 60]))), "x") for i in range(40)]
    items += [(100, None, ""), (101, "", ""), (102, "unknown words", ""), (3, "w1 w1 w2", ""), (None, "w7", ""), (104, "ThE w398", "")]
    return docs, items


def test_search_against_brute_force(spark, monkeypatch):
    docs, items = prose()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, term string").repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string, shard string")
    index = build_index(df)
    got = Counter(tuple(r) for r in search(index, asked, 20).collect())
    assert got == brute_ranking(docs, items, 20)
    # several parts of queries meet every shard
    monkeypatch.setattr(lexical, "QUERIES", 7)
    got = Counter(tuple(r) for r in search(index, asked, 3).collect())
    assert got == brute_ranking(docs, items, 3)


def lists_of(docs, m):
    """Lists as an index holds them, in blocks of the usual size."""
    out = []
    for own in docs:
        at, tf = np.array([x for x, _ in own]), np.array([y for _, y in own])
        gaps, blocks = np.diff(at, prepend=0), np.arange(0, len(at), lexical.BLOCK)
        gaps[blocks] = at[blocks]
        data, ends = encoded(np.stack([gaps, tf], axis=1).ravel())
        last = np.append(blocks[1:], len(at)) - 1
        bests = np.maximum.reduceat(lexical.impacts(tf, m[at]), blocks)
        import pyarrow as pa

        out.append(lexical._List(len(at), int(bests.max()), pa.array(at[last]), pa.array(bests), pa.array(ends[2 * last + 1]), data.tobytes(), m))
    return out


def test_rare_terms_spare_blocks_of_common_ones():
    """Block maxima reject candidates: most blocks of the common lists stay compressed, and the result is whole."""
    rnd, n = np.random.default_rng(9), 60_000
    m = rnd.integers(80, 300, n)
    own = [[(int(d), int(t)) for d, t in zip(np.flatnonzero(rnd.random(n) < p), rnd.integers(1, 6, n))] for p in (0.9, 0.7, 0.003, 0.001)]
    weights = [50, 300, 6000, 7000]
    lists = lists_of(own, m)
    top, scores = lexical.top_of_shard(lists, weights, n, np.arange(n), 20)
    want = np.zeros(n, np.int64)
    for rows, w in zip(own, weights):
        at = np.array([x for x, _ in rows])
        want[at] += w * lexical.impacts(np.array([y for _, y in rows]), m[at])
    best = np.lexsort((np.arange(n), -want))[:20]
    assert top.tolist() == best.tolist() and scores.tolist() == want[best].tolist()
    assert lists[0].ready.mean() < 0.5


def test_whole_numbers_survive_compression():
    values = np.array([0, 1, 127, 128, 300, 2**14 - 1, 2**14, 2**31, 2**40, 2**62, 5])
    data, ends = encoded(values)
    assert decoded(data).tolist() == values.tolist() and ends[-1] == len(data)
    assert encoded(values[:0])[0].tolist() == [] and decoded(data[:0]).tolist() == []


def test_search_empty_tables(spark):
    docs, items = prose(50)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame(items, "item_id bigint, text string, shard string")
    assert search(build_index(none), asked).collect() == []
    some = build_index(spark.createDataFrame(docs, "doc_id bigint, text string, term string"))
    assert search(some, spark.createDataFrame([], "item_id bigint, text string")).collect() == []
    assert some.documents == len([d for d in docs if terms_of(d[1])])
