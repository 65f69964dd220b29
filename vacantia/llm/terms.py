"""Sums over a text's terms of a value known per distinct term, when the distinct terms may not fit anywhere.

Frequent terms (at most `HEAD` of them, a fixed bound) are broadcast; what a text has of the others is shuffled to a
table of terms and joined. A term outside the head is rare by construction, so no join key is hot.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most terms that are broadcast, and their total length in characters.
HEAD, HEAD_CHARS = 262_144, 4 << 20
#: Longer terms are never broadcast, so that a few giant ones don't take the room of all others.
LONGEST = 1024
#: Distinct terms that a task holds before it passes its counts on.
HELD = 500_000


def counter(split):
    """A task that counts the terms of `split(batches) -> (distinct terms, codes)` and emits them in bounded pieces."""
    import numpy as np

    def merged(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("term").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["term", "n"])

    def run(batches):
        held, rows = [], 0
        for terms, codes in split(batches):
            terms = terms if isinstance(terms, pa.Array) else pa.array(terms, pa.string())
            n = np.bincount(codes, minlength=len(terms))
            now = pa.table({"term": terms, "n": pa.array(n, pa.int64())})
            held.append(now.filter(pa.array(n > 0)) if (n == 0).any() else now)
            rows += held[-1].num_rows
            if rows > 2 * HELD:
                held = [merged(held)]
                rows = held[0].num_rows
                if rows > HELD:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows = [], 0
        if rows:
            yield from merged(held).combine_chunks().to_batches()

    return run


def term_counts(docs: DataFrame, split) -> DataFrame:
    """term, n over all rows: counted in the tasks first, then shuffled once per task and distinct term."""
    return docs.mapInArrow(counter(split), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def head_floor(counts: DataFrame, most: int = HEAD) -> int:
    """The least count of the broadcast terms: a power-law histogram of at most a few hundred rows decides."""
    bucket = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    bins = counts.filter((F.col("n") > 1) & (F.length("term") <= LONGEST)).groupBy(bucket.alias("b")).agg(F.count("*").alias("terms"), F.sum(F.length("term")).alias("chars"), F.min("n").alias("least"))
    floor, terms, chars = None, 0, 0
    for r in sorted(bins.collect(), key=lambda r: -r.b):
        terms, chars = terms + r.terms, chars + r.chars
        if terms > most or chars > HEAD_CHARS:
            break
        floor = r.least
    return floor if floor is not None else 1 << 62


def head_and_rest(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The terms that are broadcast, and the others."""
    inside = (F.col("n") >= head_floor(counts)) & (F.length("term") <= LONGEST)
    return counts.filter(inside), counts.filter(~inside)


def joined_sums(partial: DataFrame, table: DataFrame, values: dict[str, F.Column]) -> DataFrame:
    """`partial` (row_key, …, tail: an array of structs with a term) with a sum per text of each of `values`.

    `values` are expressions over the structs' fields and the columns of `table` (null where a term isn't there); absent: 0.
    """
    tail = partial.filter(F.size("tail") > 0).select("row_key", F.explode("tail").alias("t")).select("row_key", "t.*")
    found = tail.join(table, "term", "left").groupBy("row_key").agg(*(F.sum(c).alias(k) for k, c in values.items()))
    return partial.drop("tail").join(found, "row_key", "left").na.fill(0, list(values))


def tail_column(rows: int, per_row, terms: list[str], codes, freqs) -> pa.Array:
    """An array<struct<term, freq>> column from items sorted by row; per_row: how many each row has."""
    import numpy as np

    offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(terms, pa.string()).take(pa.array(codes)), pa.array(freqs, pa.int32())], ["term", "freq"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def places(found: pa.Array, head: pa.Array):
    """The place of each term in `head`, -1 if it isn't there."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(found, value_set=head), -1).to_numpy(zero_copy_only=False).astype("int64")


TAIL = "array<struct<term:string,freq:int>>"


def row_freqs(codes, counts, keep):
    """(row, code, frequency) of the occurrences whose code is in `keep` (a mask by code), sorted by row, then code."""
    import numpy as np

    row = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    at = keep[codes]
    n = max(1, len(keep))
    pair, freq = np.unique(row[at] * n + codes[at], return_counts=True)
    return pair // n, pair % n, freq
