"""SentencePiece encoding and decoding with the tokenizers library as the engine.

The model's protobuf is read and rebuilt: normaliser (dummy prefix, space marks), pieces with their
scores (a unigram model as it stands; a BPE model's scores give the order of its merges), byte fallback and decoder.
Whole texts are encoded and decoded by it in batches, and its ids are held against those of the sentencepiece library, which
loads the model as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts in a batch, at most; a longer text is a batch of its own.
BATCH_BYTES = 1 << 18


def merges(scores: dict[str, float]) -> list[tuple[str, str]]:
    """The BPE merges of a model: both halves of each piece that are pieces themselves, best score first."""
    found = [(-s, i, p[:k], p[k:]) for i, (p, s) in enumerate(scores.items()) for k in range(1, len(p)) if p[:k] in scores and p[k:] in scores]
    order = {p: i for i, p in enumerate(scores)}
    return [(a, b) for _, _, a, b in sorted(found, key=lambda x: (x[0], x[1], order[x[2]], order[x[3]]))]


def rebuilt(path: str):
    """A tokenizers.Tokenizer that gives the ids of the SentencePiece model at `path`, unigram or BPE.

    Like that library it takes a text as one piece of work, in which space marks stand for spaces: there is no pre-tokeniser.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    from .pieces import MARK, model_proto

    proto = model_proto(path)
    spec, vocab = proto.normalizer_spec, {p.piece: i for i, p in enumerate(proto.pieces)}
    unk = next(p.piece for p in proto.pieces if p.type == 2)
    fallback = bool(proto.trainer_spec.byte_fallback)
    if proto.trainer_spec.model_type == 1:
        model = models.Unigram([(p.piece, p.score) for p in proto.pieces], unk_id=vocab[unk], byte_fallback=fallback)
    elif proto.trainer_spec.model_type == 2:
        model = models.BPE(vocab, merges({p.piece: p.score for p in proto.pieces if p.type in (1, 4)}), unk_token=unk, fuse_unk=True, byte_fallback=fallback, cache_capacity=10_000)
    else:
        raise ValueError(f"{path}: neither a unigram nor a BPE model")
    if not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: spaces are not marked, or marked behind words; neither is rebuilt")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]  # spaces only; ends of the text, not of lines
    dummy = spec.add_dummy_prefix
    t.normalizer = normalizers.Sequence([*steps, *([normalizers.Prepend(MARK)] if dummy else []), normalizers.Replace(" ", MARK)])
    strip = [decoders.Strip(" ", 1, 0)] if dummy else []
    t.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), *strip])
    return t


def _encode(path: str, threads: int):
    def run(batches):
        import itertools
        import os

        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        import numpy as np
        import pyarrow as pa
        import sentencepiece

        from . import texts

        own, theirs = rebuilt(path), sentencepiece.SentencePieceProcessor(model_file=path)
        for s in texts.slices(batches, target=BATCH_BYTES):
            whole = texts.filled(s.column("text")).to_pylist()
            full = [k for k, t in enumerate(whole) if t]
            some = [whole[k] for k in full]
            ids = [e.ids for e in own.encode_batch_fast(some, add_special_tokens=False)]
            parity, decodes = np.ones(len(whole), dtype=bool), np.ones(len(whole), dtype=bool)
            parity[full] = [x == y for x, y in zip(ids, theirs.encode(some, num_threads=1), strict=True)]
            decodes[full] = [x == t for x, t in zip(own.decode_batch(ids, skip_special_tokens=False), some, strict=True)]
            n = np.zeros(len(whole), dtype=np.int64)
            n[full] = [len(x) for x in ids]
            flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32, count=int(n.sum()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(n), lists, pa.array(decodes), pa.array(parity)], ["doc_id", "n_tokens", "ids", "decodes", "parity"])

    return run


def encode(docs: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """Ids of each whole text: doc_id, n_tokens, ids, decodes (the ids give back the text), parity (sentencepiece agrees).

    `docs` has doc_id and text; other columns aren't read. A null or empty text has no ids; it decodes and agrees.
    Each row gives a row, repeated rows and null ids too. A text with a literal space mark (U+2581) is encoded as the
    library does, as if it were a space, and so decodes is false, as it is where the model's normaliser changes a text.
    Unigram and BPE models that mark spaces before words are taken; for others ValueError is raised in the tasks. An empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encode(model, threads), "doc_id bigint, n_tokens bigint, ids array<int>, decodes boolean, parity boolean"
    )


def decode(encoded: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """doc_id and text of `encoded` (doc_id, ids), in batches by the rebuilt decoder; null ids give an empty text."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        import pyarrow as pa

        own = rebuilt(model)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                text = own.decode_batch([x or [] for x in part.column("ids").to_pylist()], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
