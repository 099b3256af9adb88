"""Quality classifier: perplexity under an n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney model over bytes: A-Z lower-cased, digits
folded to 0, white space folded to blanks, texts framed by line ends.  A symbol is a byte, so
every script is covered and nothing is out of vocabulary.

Training counts n-grams and joins counts, all in tables sharded by their codes: counts of
the highest order, continuation counts of the lower ones, totals per context, and the
probabilities of one order with those of the order below.  It reads one half of all trusted
documents, the other half sets the limits.

Scoring joins each position of each text with the model.  A shard of the model holds the
n-grams and contexts of some *previous bytes*, so a position needs one shard only, and
positions never leave their document's task: shards are bounded and go to the documents,
partial sums are added per document.  Thresholds are quantiles of the perplexities of
trusted documents that were not trained on, for each language.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import col, null_safe_key, prepared, slices, written

ORDER = 5
FRAME = b"\n"
SHARD_ENTRIES = 4_000_000
#: steps of a bit per byte in which perplexities are counted for quantiles
GRID = 1024

_fold = bytearray(range(256))
_fold[0x41:0x5B] = range(0x61, 0x7B)
_fold[0x30:0x3A] = b"0" * 10
for _b in b"\t\n\x0b\x0c\r":
    _fold[_b] = 0x20
FOLD = bytes(_fold)


def framed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-gram that ends at every position of every text, and where each text's codes begin.

    A text of ``n`` bytes has ``n + 1`` positions: its bytes and its end.
    """
    lead = FRAME * (ORDER - 1)
    data = b"".join([lead + (t or b"").translate(FOLD) + FRAME for t in texts])
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    values = np.frombuffer(data, np.uint8).astype(np.int64)
    codes = values[:len(values) - ORDER + 1].copy() if len(values) >= ORDER else np.zeros(0, np.int64)
    for j in range(1, ORDER):
        codes = (codes << 8) | values[j:len(values) - ORDER + 1 + j]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    # between two texts lie ORDER - 1 codes that run across their border
    keep = np.arange(begin[-1]) + np.repeat(np.arange(len(texts)) * (ORDER - 1), sizes)
    return codes[keep], begin


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        codes, counts = np.unique(framed(batch.column(0).to_pylist())[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])


def _discounts(row) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more from the counts of counts."""
    n1, n2, n3, n4 = (row[f"n{i}"] for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)]


def train(texts: DataFrame) -> DataFrame:
    """Written table ``kind, order, code, value``: log2 probabilities (``p``) and back-off weights (``g``).

    ``texts`` has one binary column ``text``.  ``code`` holds the bytes of the n-gram or of
    the context, the last one lowest.
    """
    prepared(texts.sparkSession)
    grams = written(
        texts.mapInArrow(_count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")), "grams")
    counts = {ORDER: grams}
    for order in range(ORDER - 1, 0, -1):
        # continuation counts: how many different bytes come before
        suffix = F.col("code").bitwiseAND((1 << 8 * order) - 1)
        counts[order] = written(
            counts[order + 1].groupBy(suffix.alias("code")).agg(F.count("*").alias("n")), "grams")

    parts, lower = [], None
    for order in range(1, ORDER + 1):
        seen = counts[order].agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        d1, d2, d3 = _discounts(seen)
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = counts[order].groupBy(F.shiftright("code", 8).alias("ctx")).agg(
            F.sum("n").alias("total"), F.sum(discount).alias("saved"))
        joined = counts[order].withColumn("ctx", F.shiftright("code", 8)).join(contexts, "ctx")
        share = (F.col("n") - discount) / F.col("total")
        weight = F.col("saved") / F.col("total")
        if lower is None:
            joined = joined.withColumn("p", share + weight / 256)
        else:
            below = lower.select(F.col("code").alias("tail"), F.col("p").alias("q"))
            joined = joined.withColumn("tail", F.col("code").bitwiseAND((1 << 8 * (order - 1)) - 1)).join(
                below, "tail").withColumn("p", share + weight * F.col("q"))
        lower = written(joined.select("code", "p"), "kneser-ney")
        parts.append(lower.select(F.lit("p").alias("kind"), F.lit(order).alias("order"), "code", F.log2("p").alias("value")))
        parts.append(contexts.select(
            F.lit("g").alias("kind"), F.lit(order).alias("order"), F.col("ctx").alias("code"),
            F.log2(F.col("saved") / F.col("total")).alias("value")))
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    return written(model, "model")


class Shard:
    """The part of a model that some previous bytes need: sorted codes and their values."""

    def __init__(self, table: pa.Table, previous: np.ndarray):
        kinds, orders = np.array(table["kind"].to_pylist()), table["order"].to_numpy()
        codes, values = table["code"].to_numpy(), table["value"].to_numpy().astype(np.float32)
        self.previous = previous
        self.tables = {}
        for order in range(1, ORDER + 1):
            for kind in "pg":
                at = (kinds == kind) & (orders == order)
                by = np.argsort(codes[at], kind="stable")
                self.tables[kind, order] = codes[at][by], values[at][by]

    def _look(self, kind: str, order: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables[kind, order]
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def log2_p(self, codes: np.ndarray) -> np.ndarray:
        """Of the last byte of each n-gram after the others; 0 where another shard has to say."""
        out = np.zeros(len(codes), np.float64)
        left = np.flatnonzero(self.previous[(codes >> 8) & 0xFF])
        back = np.zeros(len(left))
        for order in range(ORDER, 0, -1):
            wanted = codes[left] & ((1 << 8 * order) - 1)
            hit, value = self._look("p", order, wanted)
            out[left[hit]] = back[hit] + value[hit]
            left, back, wanted = left[~hit], back[~hit], wanted[~hit]
            if not len(left):
                return out
            known, weight = self._look("g", order, wanted >> 8)
            back = back + np.where(known, weight, 0)
        out[left] = back - 8  # a byte never seen: one of 256
        return out


class Shards(Sequence):
    """Shards of a model, each brought to the driver when it is asked for and not kept there."""

    def __init__(self, common: DataFrame, rest: DataFrame, own: list[list[int]]):
        self._common, self._rest, self._own = common, rest, own

    def __len__(self) -> int:
        return len(self._own)

    def __getitem__(self, s: int) -> Shard:
        own = self._own[s]
        table = self._common.unionByName(self._rest.filter(F.col("byte").isin(own)).drop("byte")).toArrow()
        return Shard(table, np.isin(np.arange(256), own))


def shards_of(model: DataFrame, limit: int = SHARD_ENTRIES) -> Shards:
    """Cut a model into shards of at most about ``limit`` entries by the previous byte.

    Entries of order 1 belong to all shards.  One row per byte decides on the cuts.
    """
    byte = F.when(F.col("kind") == "p", F.shiftright("code", 8)).otherwise(F.col("code")).bitwiseAND(0xFF)
    common = model.filter(F.col("order") == 1)
    rest = model.filter(F.col("order") > 1).withColumn("byte", byte)
    sizes = {r["byte"]: r["count"] for r in rest.groupBy("byte").count().collect()}  # at most 256 rows
    n_shards = max(1, ceil(sum(sizes.values()) / limit))
    loads, place = [0] * n_shards, {}
    for b in sorted(range(256), key=lambda b: -sizes.get(b, 0)):
        place[b] = min(range(n_shards), key=loads.__getitem__)
        loads[place[b]] += sizes.get(b, 0)
    return Shards(common, rest, [[b for b in range(256) if place[b] == s] for s in range(n_shards)])


def _score(shard):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            bits, positions = [], []
            pieces = batch.column(1).to_pylist()
            codes, begin = framed(pieces)
            scores = np.concatenate([[0.0], np.cumsum(shard.value.log2_p(codes))])
            bits = scores[begin[:-1]] - scores[begin[1:]]
            positions = np.diff(begin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bits), pa.array(positions)], names=["row", "bits", "positions"])

    return run


def perplexities(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows``: ``row struct, text binary``.  Gives ``row, bits, positions``: the bits a text takes under the model."""
    spark = prepared(rows.sparkSession)
    kind = rows.schema["row"].dataType.simpleString()
    # each shard is bounded by SHARD_ENTRIES; more entries make more shards
    parts = [
        rows.mapInArrow(_score(spark.sparkContext.broadcast(s)), f"row {kind}, bits double, positions bigint")
        for s in shards_of(model)
    ]
    if len(parts) == 1:
        return parts[0]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("row").agg(F.sum("bits").alias("bits"), F.first("positions").alias("positions"))


LEAST_TRUSTED = 20
#: positions of the language's median that every text is given, so short texts are not judged by chance
PRIOR = 100
#: languages whose thresholds go to every task; more are joined
BROADCAST_LANGUAGES = 10_000


def _fences(rows: DataFrame, value, probs: dict[str, float]) -> DataFrame:
    """Quantiles of ``value`` for each ``lang`` and, as ``all``, over all languages, on a grid of 1/1024.

    Counts per language and grid step are few numbers, whatever the number of rows.
    """
    binned = rows.select("lang", F.floor(value * GRID).cast("bigint").alias("bin"))
    counts = binned.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    counts = counts.unionByName(counts.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit("all").alias("lang"), "bin", "n"))
    upto = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "total", F.sum("n").over(Window.partitionBy("lang")))
    return counts.groupBy("lang").agg(F.max("total").alias("trusted"), *[
        (F.min(F.when(F.col("upto") >= F.col("total") * p, F.col("bin"))) / GRID).alias(name) for name, p in probs.items()
    ])


def _with_fences(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """Bring each row the values of its language, or of all where its language has too few trusted texts."""
    common = fences.filter("lang = 'all'").first()
    own = fences.filter((F.col("lang") != "all") & (F.col("trusted") >= LEAST_TRUSTED)).drop("trusted")
    few = own.limit(BROADCAST_LANGUAGES + 1).collect()
    if len(few) <= BROADCAST_LANGUAGES:
        own = F.broadcast(rows.sparkSession.createDataFrame(few, own.schema))
    names = [c for c in own.columns if c != "lang"]
    joined = rows.join(own, "lang", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(common[c] if common else None).cast("double")) for c in names})


def classify(
    docs: DataFrame, trusted: DataFrame, carry: list[str] | None = None, max_train: int | None = None,
    reach: float = 3.0, loss: float = 0.01, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """One row per row of ``docs``: ``doc struct<carried columns>, bits_per_byte, perplexity, low, high, kept``.

    ``trusted`` has one column of ids of trusted documents.  Half of them by hash
    train the model, all unless ``max_train`` bounds them; the others give quantiles of bits per byte for each
    language, and so its limits: the quantiles that leave half of ``loss`` of these documents
    below and half above.  So few documents that this is less than one of them do not show these
    quantiles: there ``high`` lies ``reach`` times as far above the median as the 99th percentile,
    ``low`` as far below as the 1st.  A document outside is rejected.  A score counts ``PRIOR`` further positions at the language's median.

    A null language is a language; one with fewer than ``LEAST_TRUSTED`` trusted documents
    takes the quantiles of all.  Null and empty texts say nothing: no score, and kept.  Rows
    that repeat an id are scored each by their own text.  Without trusted documents nothing
    is rejected and limits are null; without training rows scores are null too.
    """
    spark = prepared(docs.sparkSession)
    carry = list(docs.columns) if carry is None else carry
    rows = docs.select(
        F.struct(*[col(c).alias(c) for c in carry]).alias("doc"), col(id_col).cast("bigint").alias("id"),
        null_safe_key(col(lang_col)).alias("lang"), col(text_col).cast("binary").alias("text"))

    known = trusted.select(trusted[trusted.columns[0]].cast("bigint").alias("id")).filter("id IS NOT NULL").distinct()
    known = known.withColumn("h", F.xxhash64(F.lit(seed), "id"))
    training = known.filter(F.col("h").bitwiseAND(1) == 0)
    if max_train is not None:
        training = training.orderBy("h").limit(max_train)
    training = written(training.select("id"), "training-ids")
    # ids grow with the documents; only texts of the half that their hash puts there are shuffled
    half = rows.filter(F.xxhash64(F.lit(seed), "id").bitwiseAND(1) == 0)
    texts = half.join(training, "id", "left_semi").select("text")
    if not training.limit(1).count() or not texts.limit(1).count():
        none = F.lit(None).cast("double")
        return rows.select("doc", none.alias("bits_per_byte"), none.alias("perplexity"), none.alias("low"),
                           none.alias("high"), F.lit(True).alias("kept"))
    model = train(texts)
    scored = written(
        perplexities(rows.select(F.struct("doc", "id", "lang", F.monotonically_increasing_id().alias("rid")).alias("row"), "text"), model)
        .select("row.doc", "row.id", "row.lang", "bits", "positions"), "scored")
    held_out = written(
        scored.select("id", "lang", "bits", "positions").join(known.join(training, "id", "left_anti"), "id", "left_semi"),
        "held-out")
    medians = _fences(held_out, F.col("bits") / F.col("positions"), {"middle": 0.5})
    smoothed = (F.col("bits") + PRIOR * F.coalesce("middle", F.col("bits") / F.col("positions"))) / (F.col("positions") + PRIOR)
    fences = _fences(_with_fences(held_out, medians), smoothed, {
        "q01": 0.01, "q50": 0.5, "q99": 0.99, "least": loss / 2, "most": 1 - loss / 2})
    shown = F.col("trusted") * loss >= 2
    fences = fences.select(
        "lang", "trusted",
        F.when(shown, F.col("least")).otherwise(F.col("q50") - reach * (F.col("q50") - F.col("q01"))).alias("low"),
        # the upper end of its grid step
        F.when(shown, F.col("most") + 1 / GRID).otherwise(F.col("q50") + reach * (F.col("q99") - F.col("q50"))).alias("high"))
    judged = _with_fences(_with_fences(scored, medians).withColumn("s", smoothed), fences)
    some = F.col("positions") > 1
    rate = F.when(some, F.col("bits") / F.col("positions"))
    kept = ~some | F.coalesce(F.col("s").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select(
        "doc", rate.alias("bits_per_byte"), F.pow(F.lit(2.0), rate).alias("perplexity"), "low", "high",
        kept.alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that the labels call of good quality and not toxic; a label that says otherwise wins."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter(
        "q = 1 AND coalesce(t, 0) = 0").select("doc_id")
