"""Pre-tokens of SentencePiece BPE models: the places where no merge can cross.

A BPE merge makes a piece of the vocabulary, so two neighbouring characters that no piece holds side by side are
never in one piece. In models where no piece has a space mark behind another character, a text therefore falls apart
before each run of spaces; where no piece holds a line feed, also around line feeds. `splits_exactly` checks this for
a model; the operators refuse a model for which it doesn't hold.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"


def model_proto(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto


def splits_exactly(proto) -> bool:
    """Whether `pretokens` may be encoded one by one: BPE, plain normaliser, no piece across a boundary."""
    spec, pieces = proto.normalizer_spec, [p.piece for p in proto.pieces if p.type in (1, 4)]
    plain = spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
    return bool(proto.trainer_spec.model_type == 2 and plain and spec.add_dummy_prefix and not proto.trainer_spec.treat_whitespace_as_suffix) and not any(
        MARK in p.lstrip(MARK) or "\n" in p for p in pieces
    )


@functools.lru_cache(maxsize=4)
def processor(path: str):
    """The model without its dummy prefix: `pretokens` spell their spaces out."""
    import sentencepiece

    proto = model_proto(path)
    if not splits_exactly(proto):
        raise ValueError(f"{path}: texts can't be split into pre-tokens exactly")
    proto.normalizer_spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def pretokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens, the code of each occurrence in order, and the number of occurrences in each text.

    A pre-token is a run of spaces with the word behind it, a line feed with the word behind it, or spaces alone. A
    space mark in a text counts as a space, as in the library. The dummy prefix is a space before each text that isn't
    empty; joined, a text's pre-tokens are that prefix and the text.
    """
    nonempty = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    plain = pc.replace_substring(pc.replace_substring(texts, MARK, " "), "\n", " \n")
    lists = pc.split_pattern(plain, " ")  # one space stands before each segment: the prefix, its own, or a line feed's
    flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    if not nonempty.all():
        flat = flat.filter(pa.array(np.repeat(nonempty, counts)))
        counts = np.where(nonempty, counts, 0)
    d = flat.dictionary_encode()
    codes, parts = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()
    terms = [p if p[:1] == "\n" else " " + p for p in parts]
    if "" not in parts:
        return terms, codes, counts
    hole = codes == parts.index("")
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(~hole)
    before = np.concatenate([[-1], at[:-1]])
    start = (np.cumsum(counts) - counts)[row[at]]
    ahead = at - np.maximum(before, start - 1) - 1  # empty segments between a segment and the one before it in its text
    last = np.full(len(counts), -1)
    last[row[at]] = at
    ends = np.cumsum(counts)
    behind = np.where(counts > 0, ends - 1 - np.where(last >= 0, last, ends - counts - 1), 0)
    known = {t: i for i, t in enumerate(terms)}

    def code(t: str) -> int:
        if t not in known:
            known[t] = len(terms)
            terms.append(t)
        return known[t]

    made, extra_at, extra = codes[at], [], []
    for j in np.flatnonzero(ahead).tolist():
        n, t = int(ahead[j]), terms[codes[at[j]]]
        if t[0] == "\n":
            extra_at.append(j)
            extra.append((code(" " * n), row[at[j]]))
        else:
            made[j] = code(" " * (n + 1) + t[1:])
    ends_full = np.searchsorted(row[at], np.arange(len(counts)), side="right")
    for k in np.flatnonzero(behind).tolist():
        extra_at.append(int(ends_full[k]))
        extra.append((code(" " * int(behind[k])), k))
    rows = row[at]
    if extra:
        order = np.lexsort((np.array([r for _, r in extra]), np.array(extra_at)))
        where = np.array(extra_at)[order]
        made = np.insert(made, where, np.array([extra[i][0] for i in order]))
        rows = np.insert(rows, where, np.array([extra[i][1] for i in order]))
    return terms, made, np.bincount(rows, minlength=len(counts)).astype(np.int64)
