"""Token counts by a SentencePiece BPE model without token ids: each distinct pre-token is counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms
from .scratch import written


def _split(batches):
    from . import pieces, texts

    for s in texts.slices(batches):
        found, codes, _ = pieces.pretokens(texts.filled(s.column("text")))
        yield found, codes


def piece_counts(pretokens: DataFrame, model: str) -> DataFrame:
    """`pretokens` (term, n) with `pieces`, the number of pieces of each."""

    def run(batches):
        import pyarrow as pa

        from . import pieces

        encode = pieces.processor(model).encode
        for b in batches:
            count = [len(x) for x in encode(b.column("term").to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count, pa.int32())], ["term", "n", "pieces"])

    return pretokens.mapInArrow(run, "term string, n bigint, pieces int")


def _partial(head: list[str], count: list[int]):
    """Per row: UTF-8 bytes, the tokens of its head pre-tokens, and its other pre-tokens with frequencies."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from . import pieces, texts

        words, each = pa.array(head, pa.string()), np.array([*count, -1], dtype=np.int64)
        for s in texts.slices(batches):
            text = texts.filled(s.column("text"))
            found, codes, counts = pieces.pretokens(text)
            known = each[terms.places(pa.array(found, pa.string()), words)]
            here = known[codes] if len(codes) else np.zeros(0, np.int64)
            row, code, freq = terms.row_freqs(codes, counts, known < 0)
            tail = terms.tail_column(len(counts), np.bincount(row, minlength=len(counts)), found, code, freq)
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(texts.sums(np.maximum(here, 0), counts)), tail],
                ["doc_id", "n_bytes", "head_tokens", "tail"],
            )

    return run


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Tokens of each text as the model's library gives them, without begin or end.

    `docs` has doc_id and text; other columns, whatever their names, aren't read. A null text is empty: 0 bytes, 0
    tokens. Rows stay as they are: repeated rows and ids, null ids included, each give one row. `limit`: over_limit is
    n_tokens > limit. An empty table gives an empty one.

    Two readings of the texts. The first finds the distinct pre-tokens with their frequencies, and the model counts
    the pieces of each once. The second sums those counts: pre-tokens in the broadcast head (a fixed bound) inside the
    task, the others by a join on the pre-token.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    distinct = written(piece_counts(terms.term_counts(docs.select("text"), _split), model), "pretokens")
    head, rare = terms.head_and_rest(distinct)
    head = head.select("term", "pieces").toPandas()
    partial = docs.mapInArrow(_partial(head["term"].tolist(), head["pieces"].tolist()), f"doc_id bigint, n_bytes bigint, head_tokens bigint, tail {terms.TAIL}")
    partial = written(partial.withColumn("row_key", F.monotonically_increasing_id()), "token-sums")
    out = terms.joined_sums(partial, rare.select("term", "pieces"), {"tail_tokens": F.col("freq") * F.col("pieces").cast("long")})
    total = F.col("head_tokens") + F.col("tail_tokens")
    return out.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
