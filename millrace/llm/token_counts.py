"""Token counts with a whole-token shortcut.

A vocabulary entry that the library encodes alone as that one entry is proven to be a
*whole token*.  The proof is made once, outside the texts.  A pre-token of a text that
is a whole token then counts one without any merging; only the rest is given to the
library's merge step.  Counts stay exactly those of the library:

* pre-tokens never cross white space, so a text is counted chunk by chunk between single
  blanks, and equal chunks are counted once per Python worker (up to a bounded number);
* normalising and splitting a chunk are the library's own steps;
* a text that contains the string of a special token is encoded whole by the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import col, only, prepared, slices

CACHE_ENTRIES = 400_000
CACHED_CHARS = 80

_COUNTERS: dict[str, "ChunkCounts"] = {}


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file).get("added_tokens") or []]


def prove_whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens, as the library's pre-tokeniser writes them, that encode alone as one token.

    Every vocabulary entry that ends a word is decoded to the pre-token it would stand
    for and merged by the library; those that come back as that single entry are proven.
    The result is bounded by the vocabulary.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix = model.get("end_of_word_suffix") or ""
    merge = Tokenizer.from_file(path).model.tokenize
    proven = set()
    for entry in model["vocab"]:
        if not entry.endswith(suffix) or len(entry) == len(suffix):
            continue
        pre_token = entry[: len(entry) - len(suffix)]
        tokens = merge(pre_token)
        if len(tokens) == 1 and tokens[0].value == entry:
            proven.add(pre_token)
    return frozenset(proven)


class ChunkCounts(dict):
    """Tokens of a chunk that holds no blank, made on first sight."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = special_strings(path)
        self.whole = whole

    def __missing__(self, chunk: str) -> int:
        normal = self.tokenizer.normalizer.normalize_str(chunk) if self.tokenizer.normalizer else chunk
        n = 0
        for pre_token, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
            n += 1 if pre_token in self.whole else len(self.tokenizer.model.tokenize(pre_token))
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n

    def of_text(self, text: str) -> int:
        if any(s in text for s in self.specials):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _counter(path: str, whole: frozenset[str]) -> ChunkCounts:
    if path not in _COUNTERS:
        _COUNTERS[path] = ChunkCounts(path, whole)
    return _COUNTERS[path]


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``tokenizer`` is the path of a tokenizer file of the ``tokenizers`` library whose
    pre-tokeniser drops white space.  Counted without begin, end or padding tokens; strings
    of special tokens inside a text count as the library's default has it.  Null counts as
    empty: 0 bytes, 0 tokens.  Ids are passed through, null or repeated or not.
    """
    spark = prepared(docs.sparkSession)
    # bounded by the vocabulary of the tokenizer
    proven = spark.sparkContext.broadcast(prove_whole_tokens(tokenizer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer, proven.value)
        for batch in slices(batches, "text"):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            counts = [counter.of_text(t) if t else 0 for t in texts]
            sizes = pa.compute.binary_length(batch.column(1)).cast(pa.int64()).fill_null(0)
            tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, sizes, tokens, pa.compute.greater(tokens, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = only(docs, [id_col, text_col]).select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean").select(
        "doc_id", "n_bytes", "n_tokens", F.coalesce("over_limit", F.lit(False)).alias("over_limit"))
