"""Operator 1, token counts.

A two-tier lookup on the map side. Tier one is a compact broadcast table from frequent pre-tokens to their number of tokens:
the strings a byte-level BPE vocabulary keeps whole, which its training text made frequent, and of the pre-tokens of
``SAMPLE`` documents, whichever are read first, the ``FREQUENT`` most frequent, which tell what is frequent here. It is bounded by the
vocabulary and that number, and its choice cannot change a count. Tier two is a cache in each Python worker that outlives
batches and tasks: a pre-token met for the first time is encoded by the library once and remembered. No pre-token is ever
shuffled; the plan is a scan, one Arrow map and a projection.

Exactness: the library splits a text at its added tokens, then by the byte-level pattern, and encodes each pre-token on
its own, so lengths add up. Unicode tables of the two regex engines may differ for letters added lately; a run between white space
with a character outside the scripts that have long been stable is encoded by the library as it is, and remembered like a
pre-token. No pre-token reaches over the place where white space begins.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are independent, so repeated rows give repeated
rows; only the id and the text are read, so other columns cannot clash; an empty table gives an empty result; a very long text is
counted whole, in memory in proportion to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import table

#: Fixed value: the byte-level pre-token pattern, with the white space of the Unicode standard.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: UTF-8 lead bytes of scripts whose letters may differ between Unicode versions.
UNSTABLE = re.compile(rb"[\xca-\xcc\xdc-\xe1\xe4\xe9\xea\xed-\xff]|\xe2[^\x80-\x8b]|\xe3[^\x80-\x83]")
HIGH = bytes(range(0xCA, 0x100))
#: A run from where white space begins to where it next begins.
RUN = r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+"
SAMPLE, SAMPLE_BYTES, FREQUENT = 500, 1 << 15, 50_000
#: Pre-tokens a worker remembers beyond the broadcast table before it starts anew.
CACHE = 500_000


def frequent_lengths(tokenizer_json: str) -> dict[str, int]:
    """Tier one: pre-token -> number of tokens, for what the vocabulary keeps whole. Bounded by the vocabulary."""
    import regex
    from tokenizers import Tokenizer, decoders

    tok, pattern, decode = Tokenizer.from_str(tokenizer_json), regex.compile(PATTERN), decoders.ByteLevel().decode
    words = [w for w in map(decode, ([t] for t in tok.get_vocab())) if "�" not in w]
    words = [w for w in words if pattern.fullmatch(w)]
    return {w: len(e.ids) for w, e in zip(words, tok.encode_batch(words, add_special_tokens=False), strict=True)}


def counter(tokenizer_json: str, frequent: dict[str, int], cache: int = CACHE) -> Callable[[bytes], int]:
    """A function from the UTF-8 bytes of a text to its number of tokens, with a bounded cache of its own."""
    import regex
    from tokenizers import Tokenizer

    tok, findall = Tokenizer.from_str(tokenizer_json), regex.compile(PATTERN).findall
    encode = tok.encode
    added = [re.escape(t.content) for t in tok.get_added_tokens_decoder().values()]
    special = re.compile("|".join(sorted(added, key=len, reverse=True))) if added else None

    class Lengths(dict):
        def __missing__(self, word: str) -> int:
            if len(self) >= len(frequent) + cache:
                self.clear()
                self.update(frequent)
            n = self[word] = len(encode(word, add_special_tokens=False).ids)
            return n

    length = Lengths(frequent).__getitem__

    runs = regex.compile(RUN).findall

    def by_run(part: str) -> int:
        return sum(length(r) if UNSTABLE.search(r.encode()) else sum(map(length, findall(r))) for r in runs(part))

    def count(raw: bytes) -> int:
        text = raw.decode()
        unsure = len(raw.translate(None, HIGH)) != len(raw) and UNSTABLE.search(raw)
        one = by_run if unsure else lambda part: sum(map(length, findall(part)))
        if special and special.search(text):
            parts = special.split(text)
            return len(parts) - 1 + sum(map(one, parts))
        return one(text)

    return count


def sampled_lengths(docs: DataFrame, tokenizer_json: str, text_col: str, rows: int = SAMPLE, most: int = FREQUENT) -> dict[str, int]:
    """Pre-token -> number of tokens, for the most frequent pre-tokens of ``rows`` documents.

    ``take`` reads the first partitions alone, and texts over ``SAMPLE_BYTES`` are left out, so what comes to the driver is bounded.
    """
    import regex
    from tokenizers import Tokenizer

    findall, seen = regex.compile(PATTERN).findall, Counter()
    for r in docs.select(F.when(F.octet_length(text_col) <= SAMPLE_BYTES, F.col(text_col)).alias("text")).take(rows):
        if r.text and not UNSTABLE.search(r.text.encode()):
            seen.update(findall(r.text))
    words = [w for w, n in seen.most_common(most) if n > 1]
    tok = Tokenizer.from_str(tokenizer_json)
    return {w: len(e.ids) for w, e in zip(words, tok.encode_batch(words, add_special_tokens=False), strict=True)}


_counters: dict[int, Callable[[bytes], int]] = {}


def _worker_counter(key: int, shared: Broadcast) -> Callable[[bytes], int]:
    """The worker's counter: made once in a worker's life, so its cache serves every later batch and task."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = counter(*shared.value)
    return _counters[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every whole text, as the tokenizer file at ``tokenizer_path`` counts it."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((definition, frequent_lengths(definition) | sampled_lengths(docs, definition, text_col)))
    key = hash(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _worker_counter(key, shared)
        for b in batches:
            n = [count(x) for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than 512 tokens) of every document."""
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
