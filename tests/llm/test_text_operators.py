"""Token counts, token files, exact and near duplicates, decontamination: brute force and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import near_dedup
from millrace.llm.components import components
from millrace.llm.decontaminate import contamination
from millrace.llm.exact_dedup import CuckooShard, build_index, deletions, entries, exact_duplicates, insertions, text_digests, update_index
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.token_counts import prove_whole_tokens, token_counts
from millrace.llm.token_files import BATCH_ROWS, PartReader, read_documents, write_token_files

WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id bigint, text string, rid string, kept int, digest string, node string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ODD = [
    None, "", " ", "\n\n", "Hello  world", " lead", "trail ", "tab\there", "a b", "It's  I'LL we've 'tis",
    "<|endoftext|> in <|startoftext|>text", "Ünïcödé ÀÉ İstanbul ΣΑΣ é", "日本語 テキスト", "😀 emoji–dash … “q”",
    "x" * 5000, "12345 678 9,876.5", "a.\nB\n c \n\n d", "½ ² Ⅷ ٣", "word\x1fword \x85 y",
]


def rows(texts):
    return [(i, t, "r", 1, "d", "n") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(ODD), SCHEMA)


def some_texts(seed=1, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        out.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append((" " if rnd.random() < 0.5 else "\n").join(copy).upper())
    return out


def test_token_counts(odd):
    tok = Tokenizer.from_file(WORD_BPE)
    got = {r.doc_id: r for r in token_counts(odd, WORD_BPE, limit=3).collect()}
    for i, text in enumerate(ODD):
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 3), repr(text)


def test_whole_tokens_are_one_token():
    tok = Tokenizer.from_file(WORD_BPE)
    plain = [w for w in sorted(prove_whole_tokens(WORD_BPE)) if w.isascii() and w.isalpha()]
    assert len(plain) > 10_000
    assert all(len(tok.encode(w, add_special_tokens=False).ids) == 1 for w in plain[::37])


def test_token_files(spark, odd):
    tok = Tokenizer.from_file(BYTE_BPE)
    docs = odd.unionByName(odd.filter("doc_id = 4"))
    files = write_token_files(docs, BYTE_BPE, end_id=2, order_by=[F.col("doc_id"), F.xxhash64("text")], length=16)
    got = sorted(tuple(r) for r in read_documents(files).collect())
    at, expected = 0, []
    for i, text in [(i, t) for i, t in enumerate(ODD) for _ in range(2 if i == 4 else 1)]:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == expected


def test_token_file_layout(spark):
    text = "one two three four five " * 2000
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    files = write_token_files(docs, BYTE_BPE, end_id=2, order_by=[F.col("doc_id")], length=8)
    row = files.manifest.first()
    part = PartReader(files.folder, row.path, 8)
    ids = Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids + [2]
    assert part.ids.num_record_batches == -(-len(ids) // (8 * BATCH_ROWS)) > 1
    assert part.ids.schema.field("ids").type == pa.list_(pa.uint16(), 8)
    last, mask = part.sequence((len(ids) - 1) // 8)
    assert mask.sum() == (len(ids) - 1) % 8 + 1 and last[mask].tolist() == ids[-mask.sum():]
    assert part.tokens(4000, 500).tolist() == ids[4000:4500]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_counts(none, WORD_BPE).count() == 0
    assert read_documents(write_token_files(none, BYTE_BPE, end_id=2, order_by=[F.col("doc_id")])).count() == 0
    assert exact_duplicates(none).count() == 0
    assert near_duplicates(none).count() == 0
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination(none, items).count() == 0


def test_cuckoo_shard_grows_and_forgets():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    shard = CuckooShard(buckets=4)
    for i, k in enumerate(keys):
        shard.insert(k, (1, i, i), 1)
    assert shard.buckets * 4 >= 3000 and all(shard.slot_of(k) >= 0 for k in keys)
    assert all(shard.delete(k) for k in keys[::2]) and not shard.delete(keys[0])
    shard.compact()
    again = CuckooShard.from_row(type("Row", (), shard.to_row(7)))
    assert [again.slot_of(k) >= 0 for k in keys] == [i % 2 == 1 for i in range(3000)]
    assert len(again.digests) == 1500


def test_exact_duplicates(spark):
    texts = ["Same", "sAME", "É", "é", None, "", "other"]
    data = rows(texts) + [(6, "other", "r", 1, "d", "n"), (None, "other", "r", 1, "d", "n"), (None, "alone", "r", 1, "d", "n")]
    got = exact_duplicates(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert len(got) == len(data)
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r)
    for text, keep, size in [("same", 1, 2), ("É", 2, 1), ("é", 3, 1), ("", 5, 2), ("other", 6, 3), ("alone", None, 1)]:
        group = groups.pop(hashlib.sha256(text.encode()).hexdigest())
        assert {(r.keep_id, r.group_size) for r in group} == {(keep, size)} and len(group) == size
        assert [r.doc_id for r in group if r.kept] == [keep]
    assert not groups


def test_index_updates(spark):
    def digests(*texts):
        return text_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))

    shards = 4
    index = build_index(insertions(digests("a", "b", "b", "c"), shards))
    index = update_index(index, deletions(digests("b", "nothing"), shards))
    index = update_index(index, insertions(digests("c", "d"), shards))
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in entries(index).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    assert got == {sha("a"): (0, 1), sha("c"): (3, 2), sha("d"): (1, 1)}


def brute_components(texts, percent, k=5):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("region", [near_dedup.REGION, 6])
def test_near_duplicates(spark, monkeypatch, region):
    monkeypatch.setattr(near_dedup, "REGION", region)  # few nodes to a region: crowded ones are divided
    rnd = random.Random(5)
    base = [f"c{i}" for i in range(200)]
    crowd = []
    for _ in range(40):
        copy = list(base)
        for _ in range(rnd.randint(1, 2)):
            copy[rnd.randrange(len(copy))] = f"x{rnd.random()}"
        crowd.append(" ".join(copy))
    texts = some_texts() + crowd + ODD + ["one two", "One TWO", "one two three"] + crowd[:2] * 3
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, percent=85).collect()}
    assert got == brute_components(texts, 85)


def test_links_through_a_hub_alone(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 8)  # 600 copies in such regions are as 10,000 in those of 128
    rnd = random.Random(8)
    hub = [f"h{i}" for i in range(300)]
    texts = [" ".join(hub)]
    for _ in range(600):  # 0.87 to the hub, about 0.77 to each other
        copy = list(hub)
        for at in rnd.sample(range(10, 290, 6), 4):
            copy[at] = f"x{rnd.random()}"
        texts.append(" ".join(copy))
    got = near_duplicates(spark.createDataFrame(rows(texts), SCHEMA), percent=85)
    assert got.filter("component_id != 0").count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_inside_a_template(spark, monkeypatch, percent):
    monkeypatch.setattr(near_dedup, "REGION", 8)
    rnd = random.Random(9)
    template, texts = [f"t{i}" for i in range(200)], []
    for i in range(150):  # about 0.57 between the pairs, 0.83 or 0.86 within
        own = template + [f"o{i}.{j}" for j in range(70)]
        other = list(own)
        for at in rnd.sample(range(10, 260, 6), 5 if percent == 80 else 4):
            other[at] = f"x{rnd.random()}"
        texts += [" ".join(own), " ".join(other)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, percent=percent).collect()}
    assert got == brute_components(texts, percent)
    assert len({c for _, c in got.values()}) == 150


def test_near_duplicates_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "a  b c")],
                                 "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (2, 2, True), (3, 2, False), (3, 2, False)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (200, 201)]
    links = spark.createDataFrame(pairs, "u bigint, v bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 140)}, 201: 200}


def brute_hits(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = []
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        windows += [(tuple(w[i:i + n]), str(item)) for i in range(len(w) - n + 1) if n]
    out = []
    for t in texts:
        w = words(t)
        hit, found = set(), set()
        for win, item in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark):
    rnd = random.Random(3)
    words = [f"é{i}" if i % 7 == 0 else f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 6, 9, 10, 11, 25])))) for i in range(25)]
    items += [(25, None), (26, "!!!"), (27, items[0][1]), (28, "the same word the same word the same word the same word")]
    texts = list(ODD)
    for _ in range(80):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            passage = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, max(0, len(passage) - 9))
            at = rnd.randint(0, len(w))
            w[at:at] = passage[a:a + rnd.randint(8, 25)]
        texts.append(", ".join(w).upper() if rnd.random() < 0.3 else " ".join(w))
    texts += ["the same word " * 6, items[3][1] + "|" + items[3][1]]
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in contamination(docs, bench).collect()}
    expected = brute_hits(texts, items)
    for i, e in enumerate(expected):
        assert got[i] == e, (i, texts[i])
    assert sum(e[4] for e in expected) > 30


def test_contamination_without_a_sieve(spark, monkeypatch):
    from millrace.llm import decontaminate

    monkeypatch.setattr(decontaminate, "SIEVE_LIMIT", 0)
    items = [(1, " ".join(f"w{i}" for i in range(14))), (None, "short one")]
    texts = ["x y " + items[0][1] + " z", "a short one", "w1 w2 w3", None]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert [got[i] for i in range(4)] == brute_hits(texts, [(1, items[0][1]), ("", "short one")])
