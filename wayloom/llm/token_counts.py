"""Token counts by a two-tier look-up: a broadcast table of the lengths of frequent pre-tokens, then worker caches."""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Splitter
from .common import most_frequent, table, written

#: Bounds of the broadcast table: entries, and code points of an entry.
FREQUENT, LONGEST = 65_536, 48
#: Documents of the sample that says which pre-tokens are frequent. What the table lacks costs speed, not correctness.
SAMPLE_DOCS = 8_192
#: Distinct pre-tokens that a task counts before it passes them on.
COUNTED = 400_000
#: Lengths that a worker remembers beside the broadcast table, each of a pre-token of so many code points at most.
CACHE, REMEMBERED = 400_000, 64
TOKENIZERS: dict = {}
LENGTHS: dict[str, tuple[str, dict[str, int]]] = {}


def tokenizer_of(path: str):
    if path not in TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        TOKENIZERS[path] = Tokenizer.from_file(path)
    return TOKENIZERS[path]


def lengths_of(path: str, pieces: list[str]) -> list[int]:
    """Tokens that the library gives for each piece."""
    return [len(x.ids) for x in tokenizer_of(path).encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []


def frequent_pieces(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """(piece, n): pre-tokens of about SAMPLE_DOCS whole texts; only the sample is split and shuffled.

    Rows are drawn one by one, so copies of a text are drawn like other rows and the sample keeps its size.
    """
    share = F.lit(SAMPLE_DOCS / max(1, docs.count()))
    chosen = docs.select(F.col(text_col).alias("text")).filter(F.rand(SAMPLE_DOCS) < share)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        split, seen = Splitter(pattern), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])
            seen.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                for block in split.blocks(value.as_py() or ""):
                    seen.update(x for x in block if len(x) <= LONGEST)
                    if len(seen) > COUNTED:
                        yield flush()
        if seen:
            yield flush()

    return chosen.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> dict[str, int]:
    """At most FREQUENT pre-tokens, each of LONGEST code points at most, with their token counts."""
    frequent = sorted(most_frequent(written(frequent_pieces(docs, pattern, text_col)), "n", FREQUENT).toArrow().to_pydict()["piece"])
    return dict(zip(frequent, lengths_of(path, frequent), strict=True))


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, n_tokens and over_limit (n_tokens > limit), as the tokenizers library gives them.

    path: a tokenizer file (.json) that every executor has, whose pre-tokens are those of pattern. Texts that
    hold one of its added tokens go to the library whole. The broadcast table has a fixed largest size, and its
    entries come from a bounded sample; what it lacks is encoded once and kept in the worker, so the pre-tokens
    of the corpus are split once and never shuffled. A null text counts as empty: 0
    bytes and tokens. Repeated rows give repeated rows, an empty table no rows; other columns aren't read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    with open(path) as file:
        added = [x["content"] for x in json.load(file).get("added_tokens", [])]
    shared, call = spark.sparkContext.broadcast(frequent_lengths(docs, path, pattern, text_col)), uuid.uuid4().hex

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        split, frequent = Splitter(pattern), shared.value
        if path not in LENGTHS or LENGTHS[path][0] != call:
            LENGTHS[path] = (call, dict(frequent))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                known = LENGTHS[path][1]
                if len(known) > CACHE + FREQUENT:
                    known = dict(frequent)
                    LENGTHS[path] = (call, known)
                sizes, counts = [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    sizes.append(len(text.encode()))
                    if any(x in text for x in added):
                        counts += lengths_of(path, [text])
                        continue
                    total = 0
                    for pieces in split.blocks(text):
                        lengths = list(map(known.get, pieces))
                        if None in lengths:
                            missing = list({x for x, n in zip(pieces, lengths, strict=True) if n is None})
                            fresh = dict(zip(missing, lengths_of(path, missing), strict=True))
                            known.update((x, n) for x, n in fresh.items() if len(x) <= REMEMBERED)
                            lengths = [fresh[x] if n is None else n for x, n in zip(pieces, lengths, strict=True)]
                        total += sum(lengths)
                    counts.append(total)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text of `documents`, as the library counts them."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
