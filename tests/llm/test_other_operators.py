"""Quality, mixing, pseudonyms, URL rules, chat formatting and the pipeline: brute force and odd rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from datetime import date
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from millrace.llm import quality
from millrace.llm.chat_format import END, conversation_digests, format_conversations, read_conversations
from millrace.llm.mixing import earliest_deadlines, mix, whole_units
from millrace.llm.pseudonyms import PATTERNS, feistel, pseudonymize
from millrace.llm.quality import FOLD, ORDER, classify, perplexities, shards_of, train, trusted_ids
from millrace.llm.url_rules import judge_urls, mine_rules


# --- mixing ---------------------------------------------------------------------------------

@pytest.mark.parametrize("weights", [
    [1.0], [0.5, 0.3, 0.2], [i + 1.0 for i in range(70)], [1e9, 1e-9], [1, 0], [0.7321, 0.2678, 1e-4], [10**0.5] + [1.0] * 19,
])
def test_less_than_one_block_away_from_the_given_weights(weights):
    units, exact = whole_units(weights), [Fraction(str(w)) for w in weights]
    targets = [w / sum(exact) for w in exact]
    assert [Fraction(u, sum(units)) for u in units] == targets
    got, n = [0] * len(weights), 20_000
    for t, s in zip(range(1, n + 1), earliest_deadlines(units, [n + 1] * len(weights))):
        got[s] += 1
        if t % 97 == 0 or t < 300 or t > n - 300:
            assert all(abs(g - w * t) < 1 for g, w in zip(got, targets))
    assert sum(got) == n


def mixing_docs(spark):
    rnd = random.Random(2)
    data = [(i, "x" * rnd.randint(0, 900), rnd.choice(["big"] * 6 + ["mid", "low", None]), "s", 1) for i in range(3000)]
    data += [(None, "no id", "mid", "s", 1), (7777, None, "mid", "s", 1), (7777, None, "mid", "s", 1), (9999, "y" * 60_000, "low", "s", 1)]
    return data, spark.createDataFrame(data, "doc_id bigint, text string, source string, slot string, rid int")


def test_mixing_against_brute_force(spark):
    data, docs = mixing_docs(spark)
    weights = {"big": 0.5, "mid": 0.3, "low": 0.15, None: 0.05}
    got = mix(docs, weights=weights, block_bytes=2000).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d[0], d[2]) for d in data)
    sizes = defaultdict(int)
    for d in data:
        sizes[d[2]] += len(d[1] or "") + 1
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
    text = {d[0]: d[1] for d in data}
    for s, rows in by_source.items():  # the places of a source are a gapless running sum
        rows.sort(key=lambda r: r.place)
        at = 0
        for r in rows:
            assert r.place == at and r.block == at // 2000
            at += len(text[r.doc_id] or "") + 1
        assert at == sizes[s]
    # earliest deadline first, step by step, by the given weights
    w = {s: Fraction(str(x)) for s, x in weights.items()}
    blocks = {s: -(-sizes[s] // 2000) for s in w}
    slots, done = {}, Counter()
    while True:
        t = len(slots)
        ready = [(math.ceil((done[s] + 1) / w[s]), "null" if s is None else f"={s}", s) for s in w if math.floor(done[s] / w[s]) <= t]
        s = min(ready)[2]
        if done[s] == blocks[s]:
            break
        slots[s, done[s]] = t
        done[s] += 1
    for r in got:
        late = max(len(slots), math.ceil((r.block + 1) / w[r.source]) - 1)
        assert r.slot == slots.get((r.source, r.block), late) and r.within == ((r.source, r.block) in slots)
    # less than one block from the given weights before the horizon
    given = Counter()
    for t, (s, _) in enumerate(sorted(slots, key=slots.get), 1):
        given[s] += 1
        assert all(abs(given[s] - x * t) < 1 for s, x in w.items())


def test_mixing_rows_that_share_an_id_and_larger_blocks(spark, monkeypatch):
    from millrace.llm import mixing

    data = [(7, f"text {i} " * 9, "a" if i % 3 else None) for i in range(600)] + [(8, "same", "a")] * 50
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 8)
    got = mix(docs, block_bytes=10).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d[0], d[2]) for d in data)
    assert len({(r.source, r.block) for r in got}) <= 10
    assert all(len({r.place for r in got if r.source == s}) == sum(r.source == s for r in got) for s in ("a", None))


def test_mixing_without_weights_or_rows(spark):
    _, docs = mixing_docs(spark)
    assert mix(docs.limit(0)).count() == 0
    some = mix(docs, weights={"big": 1.0, "absent": 3.0}).collect()
    assert {r.source for r in some if r.slot is not None} == {"big"} and len(some) == 3004
    assert mix(docs, power=0.0).filter("slot IS NULL").count() == 0


# --- quality --------------------------------------------------------------------------------

def brute_kneser_ney(texts):
    lead = b"\n" * (ORDER - 1)
    counts = {ORDER: Counter()}
    for t in texts:
        data = lead + t.translate(FOLD) + b"\n"
        for i in range(ORDER, len(data) + 1):
            counts[ORDER][data[i - ORDER:i]] += 1
    for n in range(ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts, contexts = {}, {}
    for n in counts:
        row = {f"n{i}": sum(c == i for c in counts[n].values()) for i in (1, 2, 3, 4)}
        discounts[n] = quality._discounts(row)
        contexts[n] = defaultdict(lambda: [0, 0.0])
        for g, c in counts[n].items():
            contexts[n][g[:-1]][0] += c
            contexts[n][g[:-1]][1] += discounts[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        below = p(g[1:])
        if g[:-1] not in contexts[n]:
            return below
        total, saved = contexts[n][g[:-1]]
        c = counts[n].get(g, 0)
        return ((c - discounts[n][min(c, 3) - 1]) / total if c else 0) + saved / total * below

    def bits(t):
        data = lead + t.translate(FOLD) + b"\n"
        return -sum(math.log2(p(data[i - ORDER:i])) for i in range(ORDER, len(data) + 1))

    return p, bits


def test_model_against_brute_force(spark, monkeypatch):
    texts = ["the cat sat on the mat 12", "The dog sat; the cat ran\tto Ünïcode", "a a a a", "", "the the the cats"]
    rows = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary").repartition(2)
    model = train(rows)
    p, bits = brute_kneser_ney([t.encode() for t in texts])
    alphabet = sorted({bytes([b]) for t in texts for b in t.encode().translate(FOLD)} | {b"\n"})
    for context in (b"\n\n\n\n", b"the ", b"zzzz", b" cat"):
        known = sum(p(context + a) for a in alphabet)
        unknown = (256 - len(alphabet)) * p(context + b"\xfe")
        assert known + unknown == pytest.approx(1)
    tests = [*texts, None, "zebra", "the cat", "ÿ日本" * 3]
    docs = spark.createDataFrame([((i,), None if t is None else bytearray(t.encode())) for i, t in enumerate(tests)],
                                 "row struct<id:int>, text binary")
    for limit in (10**6, 150):
        monkeypatch.setattr(quality, "shards_of", lambda m, limit=limit: shards_of(m, limit))
        for r in perplexities(docs, model).collect():
            t = (tests[r.row.id] or "").encode()
            assert r.positions == len(t) + 1
            assert r.bits == pytest.approx(bits(t), rel=1e-5), tests[r.row.id]
    assert len(shards_of(model, 150)) > 1


def quality_docs(spark):
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "light", "water"]
    prose = lambda: " ".join(rnd.choice(words) for _ in range(80)) + "."
    junk = lambda: "".join(rnd.choice("#$%&*@!~^|{}<>") for _ in range(400))
    data = [(i, prose(), "en", 0, "t") for i in range(200)] + [(200 + i, junk(), "en", 0, "t") for i in range(20)]
    data += [(300, None, "en", 0, "t"), (301, "", None, 0, "t"), (302, prose(), None, 0, "t"), (303, prose(), "xx", 0, "t"),
             (None, prose(), "en", 0, "t"), (0, data[0][1], "en", 0, "t"), (304, prose() * 400, "en", 0, "t")]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, kept int, low string")


def test_classifier_keeps_prose_and_drops_noise(spark):
    docs = quality_docs(spark)
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(150)] + [(210, 0, 0), (3, 0, 1), (None, 1, 0), (7, 1, None), (5000, 1, 0)],
        "doc_id bigint, quality int, toxic int")
    got = classify(docs, trusted_ids(labels)).collect()
    assert len(got) == docs.count() and set(got[0].doc.asDict()) == {"doc_id", "text", "lang", "kept", "low"}
    for r in got:
        noise = r.doc.doc_id is not None and 200 <= r.doc.doc_id < 220
        assert r.kept == (not noise), (r.doc.doc_id, r.bits_per_byte, r.low, r.high)
        assert r.perplexity is None if not r.doc.text else r.perplexity == pytest.approx(2 ** r.bits_per_byte)


def test_limits_are_quantiles_of_held_out_documents(spark):
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "light", "water"]
    data = [(i, " ".join(rnd.choice(words) for _ in range(80)), "en") for i in range(1200)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    judged = classify(docs, docs.select("doc_id"))
    held_out = judged.filter(F.xxhash64(F.lit(0), "doc.doc_id").bitwiseAND(1) == 1)
    assert 1 <= held_out.filter("NOT kept").count() <= 0.01 * held_out.count()


def test_model_is_trained_on_all_trusted_documents_of_its_half(spark, monkeypatch):
    docs = spark.range(17_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    half = docs.filter(F.xxhash64(F.lit(0), "doc_id").bitwiseAND(1) == 0).count()
    read = []

    def counted(texts):
        read.append(texts.count())
        return train(texts)

    monkeypatch.setattr(quality, "train", counted)
    classify(docs, docs.select("doc_id"))
    assert half > 8_000
    classify(docs, docs.select("doc_id"), max_train=100)
    assert read == [half, 100]


def test_classifier_without_trusted_or_documents(spark):
    docs = quality_docs(spark)
    none = spark.createDataFrame([], "doc_id bigint")
    assert classify(docs, none).filter("NOT kept OR perplexity IS NOT NULL").count() == 0
    some = spark.createDataFrame([(i,) for i in range(50)], "doc_id bigint")
    assert classify(docs.limit(0), some).count() == 0


# --- pseudonyms -----------------------------------------------------------------------------

def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


def replaced(spark, texts, key="k"):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_replaced int")
    return [(r.text, r.n_replaced) for r in pseudonymize(docs, key).orderBy("doc_id").collect()]


def test_feistel_permutes(spark):
    pairs = spark.range(91).select(F.floor(F.col("id") / 13).alias("a"), (F.col("id") % 13).alias("b"))
    got = pairs.select(feistel("k", "t", F.col("a"), F.col("b"), F.lit(7), F.lit(13)).alias("m")).collect()
    assert {(r.m.a, r.m.b) for r in got} == {(a, b) for a in range(7) for b in range(13)}


def test_values_keep_their_format(spark):
    values = {
        "card": ["4111111111111111", "4111-1111-1111-1111", "378282246310005"],
        "phone": ["+1 (017) 555-7713", "(212) 555-0100", "+49 30 123456", "212-555-0100"],
        "ip": ["97.51.17.173", "0.0.0.0", "255.255.255.255"], "ssn": ["123-45-6789", "899-99-9999"],
        "email": ["the.72@mail3.example.com", "A_B+c@x.org", "abcdefghijklmnopqrstuvwxyz0123456789@x.org"],
        "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"],
        "date": ["2024-02-29", "31.12.1999", "1/2/2003", "12/31/2020", "25/12/2020"],
        "secret": ['token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "API_KEY: " + "AB12" * 8],
    }
    texts = [f"see {v}, ok" for vs in values.values() for v in vs]
    kinds = [k for k, vs in values.items() for _ in vs]
    for text, kind, (new, n) in zip(texts, kinds, replaced(spark, texts)):
        assert n == 1 and new != text, text
        old, value = text[4:-4], new[4:-4]
        assert new == f"see {value}, ok"
        shape = "[0-9a-zA-Z]+" if kind in ("ip", "date") else "[0-9a-zA-Z]"
        assert re.sub(shape, "x", old) == re.sub(shape, "x", value)
        if kind == "card":
            assert luhn(value)
        if kind == "ip":
            assert all(int(x) < 256 for x in value.split("."))
        if kind == "iban":
            moved = value.replace(" ", "")[4:] + value.replace(" ", "")[:4]
            assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
        if kind == "ssn":
            area, group, serial = map(int, value.split("-"))
            assert 0 < area < 900 and area != 666 and group and serial
        if kind == "date" and "-" in value:
            date.fromisoformat(value)
        if kind == "email":
            assert value.split("@")[1] == old.split("@")[1]


def test_numbers_of_a_format_stay_different(spark):
    days = [str(date.fromordinal(date(2000, 1, 1).toordinal() + i)) for i in range(400)]
    new = [t for t, _ in replaced(spark, days)]
    assert len(set(new)) == 400 and all(date.fromisoformat(d) for d in new) and set(new) != set(days)
    ssn = [f"{a:03d}-07-0001" for a in range(1, 900) if a != 666]
    assert len({t for t, _ in replaced(spark, ssn)}) == len(ssn)


def test_links_keys_and_clean_texts(spark):
    text = "a@b.org wrote 4111111111111111 4111111111111111 on 2024-01-02 from 10.0.0.1"
    (one, n), (two, _) = replaced(spark, [text, "again 4111111111111111 and a@b.org."])
    assert n == 5
    card = one.split()[2]
    assert one.split()[3] == card and card in two and one.split()[0] in two
    assert replaced(spark, [text], key="other")[0][0] != one
    clean = [
        None, "", "4111111111111112 is no card", "999.1.1.1 and 1.2.3.4.5", "2023-02-30", "000-12-3456", "v1.2.3 costs 12,50",
        "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "x" * 100_000, "year 2024, page 17", "no@host", "1234567890123",
    ]
    assert replaced(spark, clean) == [(t, 0) for t in clean]
    long = "word " * 50_000 + "a@b.org" + " word" * 50_000
    assert replaced(spark, [long])[0][1] == 1


def test_patterns_do_not_backtrack():
    assert all("(?<!" in p or p.startswith("(?i:") for p in PATTERNS.values())


# --- urls -----------------------------------------------------------------------------------

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_urls(spark):
    urls = [
        "http://A.Example.ORG/es/1?x#y", "https://example.org/en/17", "http://x.com/de/1", "http://xcom/de/1", "com/de/1",
        None, "", "://", "http://com", "http://x.com?/de/", "http://x.com#://", "ftp://example.org/es", "http://x.com/fr/", "a://b://c",
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string")
    labels = spark.createDataFrame([], "page_id bigint, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, labels, RULES).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/17", "example.org/en/1", "block"),
        ("x.com", "/de/1", "com/de/", "block"), ("xcom", "/de/1", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "", None, "allow"),
        ("x.com", "", None, "allow"), ("x.com", "", None, "allow"), ("example.org", "/es", "org/", "allow"),
        ("x.com", "/fr/", "com/fr/", "allow"), ("b:", "//c", None, "allow"),
    ]
    assert judge_urls(pages.limit(0), labels, RULES).count() == 0
    assert {r.verdict for r in judge_urls(pages, labels, []).collect()} == {"allow"}


def test_mined_rules_block_what_labels_taught(spark):
    data = []
    for i in range(400):
        bad = i % 4 == 0
        host = "win-casino.example.net" if bad else random.Random(i).choice(["news", "blog", "casino-museum"]) + ".example.net"
        data.append((i, f"http://{host}/en/{i}", bad))
    labels = spark.createDataFrame([(i, b) for i, _, b in data[:200]] + [(None, True), (1, None)], "page_id bigint, bad boolean")
    pages = spark.createDataFrame([(i, u) for i, u, _ in data] + [(3, data[3][1])], "page_id bigint, url string")
    got = judge_urls(pages, labels, [("allow", "casino-museum.example.net", "/")], min_support=0.05, min_confidence=0.9).collect()
    assert len(got) == 401
    assert all((r.verdict == "block") == data[r.page_id][2] for r in got)
    assert all(r.matched_tokens == ["h:win"] for r in got if r.verdict == "block")


def test_longer_rules_need_more_confidence(spark):
    rows = [(["h:a", "h:b"], True)] * 30 + [(["h:a"], True)] * 10 + [(["h:c"], False)] * 60 + [(["h:c", "h:d"], True)] * 20
    mined = mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.05, 0.8).collect()
    assert sorted(tuple(r.tokens) for r in mined) == [("h:a",), ("h:b",), ("h:d",)]


def test_rules_against_all_token_sets(spark):
    rnd = random.Random(11)
    deep = [f"p:{c}" for c in "abcdefghijklmnop"]
    rows = [(deep, True)] * 12 + [(["h:x", "h:y"], True)] * 9 + [(["h:x"], False)] * 9 + [(["h:y"], False)] * 9
    rows += [(["q:1", "q:2", "q:3", "q:4"], True)] * 8
    rows += [([q for q in ("q:1", "q:2", "q:3", "q:4") if q != f"q:{i % 4 + 1}"], False) for i in range(24)]
    rows += [(rnd.sample(["r:1", "r:2", "r:3", "r:4", "r:5"], rnd.randint(0, 4)), rnd.random() < 0.4) for _ in range(60)]
    mined = mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.04, 0.7).collect()
    confident = {}
    for kind in ("p:", "h:", "q:", "r:"):
        tokens = sorted({t for row, _ in rows for t in row if t.startswith(kind)})
        for n in range(1, 2 if kind == "p:" else 6):  # of equal tokens the single ones stay
            for chosen in itertools.combinations(tokens, n):
                held = [bad for row, bad in rows if set(chosen) <= set(row)]
                if sum(held) >= 0.04 * len(rows) and sum(held) >= 0.7 * len(held):
                    confident[chosen] = sum(held) / len(held)
    least = {c for c, x in confident.items() if not any(set(s) < set(c) and y >= x for s, y in confident.items())}
    assert {tuple(r.tokens) for r in mined} == least and ("q:1", "q:2", "q:3", "q:4") in least and len(mined) == len(least)


# --- chat -----------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nhi", "\\", "\\o", "<|", "<<||", "\\b\\\\o", "x<", "|>", "</s>[INST] ok [/INST]",
             "<s></s>", "<\\|", "\n\n", "", None, "<|im_next|>", "é😀<|"]
    rnd = random.Random(6)
    data = []
    for conv in range(60):
        for turn in range(rnd.randint(1, 7)):
            data.append((conv, turn, rnd.choice(["user", "assistant", "assistant", "system", "we\nird<|", None]), rnd.choice(nasty), "f", 1))
    data += [(60, 2, "assistant", "b", "f", 1), (60, 2, "assistant", "a", "f", 1), (60, 2, "assistant", "a", "f", 1),
             (60, None, "user", "first", "f", 1), (None, 1, "user", "lost", "f", 1)]
    turns = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, formatted string, at int").repartition(5)
    formatted = format_conversations(turns)
    got = {r.conv_id: r for r in conversation_digests(read_conversations(formatted)).collect()}
    texts = {r.conv_id: r for r in formatted.collect()}
    expected = defaultdict(list)
    for conv, turn, role, text, *_ in data:
        expected[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(expected)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, all_turns in expected.items():
        all_turns.sort()
        loss = "".join(t for _, r, t in all_turns if r == "assistant")
        row, out = got[conv], texts[conv]
        assert row.n_turns == len(all_turns)
        assert row.turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in all_turns))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))
        assert row.formatted_chars == len(out.formatted)
        roles = [r for _, r, _ in all_turns]
        assert out.formatted.count(END) == 1 + sum(a != b for a, b in zip(roles, roles[1:]))
    assert format_conversations(turns.limit(0)).count() == 0


def test_long_conversation(spark):
    turns = spark.range(30_000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    row = conversation_digests(read_conversations(format_conversations(turns))).first()
    loss = "".join(f"t{i}" for i in range(30_000) if i % 3)
    assert (row.n_turns, row.loss_chars) == (30_000, len(loss))
    assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# --- pipeline -------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")).unionByName(docs.filter("doc_id = 1")).unionByName(
        docs.filter("doc_id = 2").withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes if c != "doc_id"}))
    docs.unionByName(extra).withColumns({"d": F.lit(1), "at": F.lit("x"), "n": F.lit(2)}).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    kept = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SMALL).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < 4:
            assert kept[-1].columns == docs.columns, name
    counts = [k.count() for k in kept]
    assert counts[0] >= counts[1] > counts[2] >= counts[3] == counts[4] == counts[5] > 0.5 * counts[0]
    assert kept[2].filter("doc_id = 1").count() <= 1
    assert kept[4].exceptAll(kept[3]).count() == 0
    # token ids follow the mixture: places in the files are those of the stored rows
    stored = [r.doc_id for r in kept[4].select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert [r.doc_id for r in kept[5].orderBy("start").collect()] == stored


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
