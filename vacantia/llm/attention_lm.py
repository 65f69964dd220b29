"""Language-model scores: a causal self-attention model over subword ids, beside a smoothed unigram base.

Counts of words and pieces cover every training text, and the network is fit on every place of them: parts of the corpus
train copies of it, and Spark adds up what they changed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms
from .attention import BEGIN, CONTEXT, END, LAMBDA, WIDTH, Model, classes, windows
from .scratch import temporary, written

#: Windows that training sees about, if the corpus has fewer: then it is gone through again, at most `EPOCHS` times.
SEEN, EPOCHS = 240_000, 30
#: Characters of a passage, and about how many windows one has.
PASSAGE, PER_PASSAGE = 1024, 12
#: Windows of one part of a table of windows in a round, about; rounds after which parts are averaged; values of a sent chunk;
#: windows that a task holds at once, and that one step of training takes.
PART, ROUNDS, CHUNK, HELD, STEP = 12_000, 4, 1 << 14, 48_000, 128
#: Windows scored at once.
BATCH = 256
#: Bytes of text that a task holds at once: each such slice hashes all of the head, so small ones would spend most on that.
SLICE = 4 << 20
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 2 modulo 7; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _words(batches):
    from . import texts

    for s in texts.slices(batches):
        flat, _ = texts.words(texts.filled(s.column("text")), lower=True)
        yield texts.indexed(flat)


class _Pieces:
    """Piece ids of distinct words: those of the head are given, the others are encoded."""

    def __init__(self, path: str, head: pa.Array | None = None, ids: np.ndarray | None = None, sizes: np.ndarray | None = None):
        from .pieces import processor

        self.encode, self.head, self.ids, self.sizes = processor(path).encode, head, ids, sizes
        self.begins = None if sizes is None else np.cumsum(sizes) - sizes

    def flat(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in order, their number per word, and each word's place in the head (-1: none)."""
        at = np.full(len(words), -1) if self.head is None else terms.places(words, self.head)
        rest = at < 0
        coded = self.encode([" " + w for w in words.filter(pa.array(rest)).to_pylist()], num_threads=1)
        size = np.empty(len(words), dtype=np.int64)
        size[rest] = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        if not rest.all():
            size[~rest] = self.sizes[at[~rest]]
        out = np.empty(int(size.sum()), dtype=np.int32)
        new = np.repeat(rest, size)
        out[new] = np.fromiter((i for x in coded for i in x), dtype=np.int32, count=int(new.sum()))
        if not rest.all():
            each = size[~rest]
            out[~new] = self.ids[np.repeat(self.begins[at[~rest]] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))]
        return out, size, at


def _sequences(s, pieces: _Pieces):
    """Words, their codes, words per text, then per text its predictions: the pieces of its words and the end.

    Returns (words, codes, counts, ids, lengths, per_word, places): ids of all texts' predictions in order, their number
    per text, the number of pieces of each word occurrence, and the distinct words' places in the head.
    """
    from . import texts

    flat, counts = texts.words(texts.filled(s.column("text")), lower=True)
    found, codes = texts.indexed(flat)
    ids, size, places = pieces.flat(found)
    each = size[codes] if len(codes) else np.zeros(0, np.int64)
    begin = np.cumsum(size) - size
    at = np.repeat(begin[codes] if len(codes) else each, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    per_text = texts.sums(each, counts)
    out = np.full(int(per_text.sum()) + len(counts), END, dtype=np.int32)
    ends = np.cumsum(per_text + 1) - 1
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[inner] = ids[at]
    return found, codes, counts, out, per_text + 1, each, places


def _inputs(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids before each prediction: the begin mark, then all but the last."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[(np.cumsum(lengths) - lengths)[lengths > 0]] = BEGIN
    return out


def _passage(text: str, k: int) -> tuple[int, int]:
    """Where the k-th passage of a text begins and ends; each word is of the passage that holds its first character."""

    def edge(i: int) -> int:
        found = _BLANK.search(text, i - 1) if i else None
        return found.end() if found else len(text) if i else 0

    return edge(k * PASSAGE), edge((k + 1) * PASSAGE)


def _chances(doc_ids: list, texts: list[str], n: np.ndarray) -> np.ndarray:
    """A number in [0, 1) of each of the n passages of each text, from its row's id, its text and its place."""
    import xxhash

    keys = np.array([xxhash.xxh64_intdigest(t.encode(), xxhash.xxh64_intdigest(str(i).encode(), 3)) for i, t in zip(doc_ids, texts, strict=True)], dtype=np.uint64)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    h = np.repeat(keys, n) + (k.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def _cut(ids: np.ndarray, before: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over the runs from `first` to `end`, side by side: the ids before each place and the ids there; the rest is 0 and -1."""
    n = np.maximum(0, -(-(end - first) // WIDTH))
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = (np.repeat(first, n) + k * WIDTH)[:, None] + np.arange(WIDTH)
    inside = at < np.repeat(end, n)[:, None]
    at = np.where(inside, at, 0)
    return np.where(inside, before[at], 0).astype(np.int32), np.where(inside, ids[at], -1).astype(np.int32)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _sampled(path: str, share: float, words: pa.Array | None = None, ids: np.ndarray | None = None, sizes: np.ndarray | None = None):
    """Windows of all whole texts, with a share under 1 of the passages that are drawn, and each's part of `ROUNDS`: its text's or passage's."""

    def run(batches):
        from . import texts

        pieces = _Pieces(path, words, ids, sizes)
        for s in texts.slices(batches, target=SLICE):
            whole = texts.filled(s.column("text")).to_pylist()
            n = np.array([1 if share >= 1 else max(1, -(-len(t) // PASSAGE)) for t in whole], dtype=np.int64)
            chance = _chances(s.column("doc_id").to_pylist(), whole, n)
            drawn = np.flatnonzero(chance < share)
            if not len(drawn):
                continue
            row = np.repeat(np.arange(len(n)), n)[drawn]
            place = drawn - (np.cumsum(n) - n)[row]
            edges = [(0, len(whole[r])) if share >= 1 else _passage(whole[r], int(p)) for r, p in zip(row, place, strict=True)]
            taken = pa.RecordBatch.from_arrays([pa.array([whole[r][a:b] for r, (a, b) in zip(row, edges, strict=True)], pa.string())], ["text"])
            found, lengths = _sequences(taken, pieces)[3:5]
            begin = np.cumsum(lengths) - lengths
            last = np.array([b >= len(whole[r]) for r, (_, b) in zip(row, edges, strict=True)])
            first, end = begin + (place > 0), begin + lengths - ~last
            x, y = _cut(found, _inputs(found, lengths), first, end)
            part = np.repeat(np.minimum(chance[drawn] / share * ROUNDS, ROUNDS - 1).astype(np.int32), np.maximum(0, -(-(end - first) // WIDTH)))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(part), _binary(x), _binary(y)], ["part", "x", "y"])

    return run


def _stored(path: str, share: float, *head):
    """The windows of `_sampled` as ids: the one before the first place, and those of the places."""

    def run(batches):
        for b in _sampled(path, share, *head)(batches):
            x, y = (np.frombuffer(b.column(c).buffers()[2], dtype=np.int32).reshape(-1, WIDTH) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([b.column("part"), _binary(np.concatenate([x[:, :1], y], axis=1))], ["part", "ids"])

    return run


def _trained(model: Model, group: np.ndarray, epochs: int, done: float, part: float, slots: int):
    """Trains a copy of `model` on a part of the windows, `HELD` at a time, and gives what that changed."""

    def held(batches):
        some, n = [], 0
        for b in batches:
            some.append(b)
            n += b.num_rows
            while n >= HELD:
                table = pa.Table.from_batches(some)
                yield table.slice(0, HELD)
                some, n = table.slice(HELD).to_batches(), n - HELD
        if n:
            yield pa.Table.from_batches(some)

    def run(batches):
        from pyspark import TaskContext

        old, uses, n = [a.copy() for a in model.p], np.zeros(len(model.p[0]), dtype=np.int64), 0
        for table in held(batches):
            x, y = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.int32).reshape(-1, WIDTH) for c in ("x", "y"))
            # Any order will do that doesn't depend on how they came.
            order = np.argsort((x.astype(np.uint64) * _ODD[:WIDTH] + y.astype(np.uint64) * _ODD[WIDTH:]).sum(axis=1), kind="stable")
            x, y = np.maximum(x[order], 0), y[order]
            y = np.where(y >= 0, group[y], -1)
            model.train(x, y, epochs=epochs, batch=STEP, done=done, part=part)
            uses += np.bincount(x.reshape(-1), minlength=len(uses))
            n += len(x)
        if not n:
            return
        out = np.rint(model.changed(old, uses, n).astype(np.float64) * FIXED).astype(np.int64)
        at = range(0, len(out), CHUNK)
        slot = TaskContext.get().partitionId() % slots
        yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array([slot] * len(at), pa.int32()), pa.array([out[i : i + CHUNK].tobytes() for i in at])], ["chunk", "slot", "values"])

    return run


#: Factors of the places' ids in what windows are sorted by.
_ODD = np.random.default_rng(7).integers(0, 1 << 63, 2 * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: What parts changed is added up as whole numbers of this fraction, so the sum doesn't depend on the order of arrival.
FIXED = float(1 << 20)


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(0, np.int64)
    for b in table.column("values").to_pylist():
        now = np.frombuffer(b, dtype=np.int64)
        total = now + total if len(total) else now
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "slot": table.column("slot").slice(0, 1), "values": pa.array([total.tobytes()])})


def _plan(n: int, parts: int, sliced: bool) -> list[tuple[int, int, int]]:
    """(epochs, k, of) of each round: k-th of `of` parts of the windows. A large corpus is gone through once, a part a round."""
    epochs = min(EPOCHS, max(1, SEEN // max(1, n)))
    if epochs == 1 and sliced:
        return [(1, k, ROUNDS) for k in range(ROUNDS)]
    rounds = min(ROUNDS, epochs) if parts > 1 else 1
    return [((epochs + k) // rounds, 0, 1) for k in range(rounds)]


def _fit(net: Model, windows: DataFrame | Callable[[int, int], DataFrame], group: np.ndarray, n: int | None = None) -> None:
    """Trains `net` in rounds: parts of the windows train copies of it, Spark adds up their changes, the mean is kept.

    `windows` is a table of them, or gives the k-th of so many parts of about `n` of them, dealt as they come. Changes are added
    in two steps, first those of a slot, of which there are as many as parts in a slot; so no task adds more than the root of
    all parts, and memory is that of one chunk of numbers for each.
    """
    sliced = callable(windows)
    n = n if sliced else windows.count()
    if not n:
        return
    parts = windows(0, 1).rdd.getNumPartitions() if sliced else max(1, -(-n // PART))
    plan = _plan(n, parts, sliced)
    for i, (epochs, k, of) in enumerate(plan):
        run = _trained(net, group, epochs, i / len(plan), 1 / len(plan), math.isqrt(max(0, parts - 1)) + 1)
        dealt = windows(k, of) if sliced else windows.repartition(parts)
        sent = dealt.mapInArrow(run, "chunk int, slot int, values binary")
        for by in (("chunk", "slot"), ("chunk",)):
            sent = sent.groupBy(*by).applyInArrow(_added, "chunk int, slot int, values binary")
        chunks = sent.toPandas().sort_values("chunk")
        if len(chunks):
            net.move(np.frombuffer(b"".join(chunks["values"]), dtype=np.int64) / FIXED)


def _piece_totals(path: str):
    def run(batches):
        pieces, total = _Pieces(path), np.zeros(0, np.int64)
        for b in batches:
            ids, size, _ = pieces.flat(b.column("term"))
            n = np.repeat(b.column("n").to_numpy(), size)
            now = np.bincount(ids, weights=n, minlength=len(total)).astype(np.int64)
            now[: len(total)] += total
            total = now
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

    return run


def _scored(model: Model, group: np.ndarray, within: np.ndarray, head: tuple, path: str, total: int, distinct: int, ends: int):
    def run(batches):
        from . import texts

        words, often, head_ids, sizes = head
        pieces, floor = _Pieces(path, pa.array(words, pa.string()), head_ids, sizes), math.log10(max(1, total + distinct + 1))
        for s in texts.slices(batches, target=SLICE):
            found, codes, counts, ids, lengths, each, places = _sequences(s, pieces)
            logs, begin = _piece_logs(model, group, within, ids, lengths)
            ends_at = np.cumsum(lengths) - 1
            inner = np.ones(len(ids), dtype=bool)
            inner[ends_at] = False
            # A word: its pieces, given that one begins, and then that it ends.
            start = np.cumsum(each) - each + np.repeat(np.arange(len(counts)), counts)
            by_word = texts.sums(logs[inner], each) + begin[start + each] - begin[start] if len(each) else np.zeros(0)
            at_end = logs[ends_at] - begin[ends_at]
            known = np.where(places >= 0, often[places], -1) if len(often) else np.full(len(places), -1)
            c = known[codes] if len(codes) else np.zeros(0, np.int64)
            here = c > 0
            mixed = np.where(here, _mixed(by_word, np.log10(np.maximum(c, 0) + 1.0) - floor), 0.0)
            score = texts.sums(mixed, counts) + (_mixed(at_end, math.log10(ends + 1) - floor) if ends else at_end + math.log10(LAMBDA))
            base = texts.sums(np.where(here, np.log10(np.maximum(c, 0) + 1.0) - floor, 0.0), counts) + (math.log10(ends + 1) - floor)
            sure = texts.sums(here.astype(np.int64), counts) + (ends > 0)
            rest = texts.sums((~here).astype(np.int64), counts)
            values = pa.StructArray.from_arrays([found.take(pa.array(codes[~here])), pa.array(by_word[~here].astype(np.float32))], ["term", "logp"])
            tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(counts + 1), pa.array(sure.astype(np.int64)), pa.array(base), pa.array(score.astype(np.float64)), tail], ["doc_id", "n_tokens", "head_known", "head_base", "head_score", "tail"])

    return run


def _mixed(network, share):
    """log10 of a word's probability from log10 of what the network and the training shares give it."""
    return np.logaddexp((network + math.log10(LAMBDA)) * math.log(10), (share + math.log10(1 - LAMBDA)) * math.log(10)) / math.log(10)


def _piece_logs(model: Model, group, within, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 P of each prediction and that a word begins (or the text ends) there, in windows that overlap by CONTEXT and score each once."""
    before, begin = _inputs(ids, lengths), np.cumsum(lengths) - lengths
    row, start, first = windows(lengths)
    out, opens = np.zeros(len(ids), dtype=np.float64), np.zeros(len(ids), dtype=np.float64)
    steps, tables = np.arange(WIDTH), model.tables()
    for skip in (0, CONTEXT):
        some = np.flatnonzero(first == skip)
        for i in range(0, len(some), BATCH):
            k = some[i : i + BATCH]
            left, begins = lengths[row[k]][:, None], begin[row[k]][:, None]
            inside = start[k, None] + steps
            at = begins + np.minimum(inside, left - 1)
            scored = inside[:, skip:] < left
            places = at[:, skip:][scored]
            want = ids[places]
            out[places], opens[places] = model.log_shares(before[at], np.flatnonzero(scored.reshape(-1)), group[want], skip, tables)
            out[places] += within[want]
    return out, opens


def score(docs: DataFrame, path: str, sample: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each whole text.

    Training rows are those that aren't held out. A-Z are lower-cased; a text's tokens are its words and one end. base:
    the sum of log10((c + 1) / (N + V + 1)) over tokens. score: log10 of the model's probability of the text: a word has
    with weight LAMBDA what the network gives its pieces, where a word begins, and that none follows them before the next
    word or the end; with the rest its smoothed share of the training tokens, if it is among them; the end likewise. So
    what all words and the end have after any words adds up to 1 at most. The network is fit on all
    places of all texts; with `sample`, for trials, on about so many windows: passages are drawn by row, text and place, so copies are drawn apart.

    `docs` has doc_id and text; other columns aren't read. Null and empty texts have one token, the end. Each row gives
    a row, repeated rows and null ids too; a null id trains. Without training rows N, V and n_known are 0, and an empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = docs.filter(~held_out())
    counts = written(terms.term_counts(train.select("text"), _words), "word-counts")
    rows, passages = train.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(F.length("text") / PASSAGE))), F.lit(0))).first()
    distinct, words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, kinds = words + rows, distinct + (rows > 0)
    found = counts.mapInArrow(_piece_totals(path), "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    from .pieces import MARK, model_proto

    names = [p.piece for p in model_proto(path).pieces]
    size, begins = len(names), np.array([n.startswith(MARK) for n in names])
    begins[END] = True
    pieces = np.zeros(size)
    pieces[found["piece"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    pieces[END] += rows
    group, within = classes(pieces, begins)
    net = Model(size)
    often, rare = terms.head_and_rest(counts)
    often = often.toPandas()
    ids, sizes, _ = _Pieces(path).flat(pa.array(often["term"], pa.string()))
    head = (often["term"].tolist(), often["n"].to_numpy(dtype=np.int64), ids, sizes)
    share = 1.0 if sample is None else min(1.0, sample / PER_PASSAGE / max(1, passages))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    dealt = train.repartition(cores, "doc_id") if train.rdd.getNumPartitions() < cores else train
    with temporary(docs.sparkSession):
        # Texts are made into windows once, not in every round.
        stored = written(dealt.mapInArrow(_stored(path, share, pa.array(head[0], pa.string()), ids, sizes), "part int, ids binary"), "windows")
        tasks = max(cores, stored.rdd.getNumPartitions())

        def part(k: int, of: int) -> DataFrame:
            some = stored.filter((F.col("part") >= k * ROUNDS // of) & (F.col("part") < (k + 1) * ROUNDS // of))
            some = some.select(F.substring("ids", 1, 4 * WIDTH).alias("x"), F.substring("ids", 5, 4 * WIDTH).alias("y"))
            return some if tasks > cores or some.rdd.getNumPartitions() == cores else some.repartition(tasks)

        _fit(net, part, group, int(share * (pieces.sum() / WIDTH + (rows if share >= 1 else passages) / 2)) + (rows > 0))
    schema = f"doc_id bigint, n_tokens bigint, head_known bigint, head_base double, head_score double, tail array<struct<term:string,logp:float>>"
    partial = docs.mapInArrow(_scored(net, group, within, head, path, total, kinds, rows), schema)
    partial = written(partial.withColumn("row_key", F.monotonically_increasing_id()), "scores")
    norm = math.log10(max(1, total + kinds + 1))
    c = F.coalesce(F.col("n"), F.lit(0))
    values = {
        "tail_known": F.when(c > 0, F.lit(1).cast("long")).otherwise(0),
        "tail_base": F.log10(c + 1.0) - norm,
        "tail_score": F.when(c > 0, F.log10(LAMBDA * F.pow(F.lit(10.0), F.col("logp").cast("double")) + (1 - LAMBDA) * (c + 1.0) / F.lit(float(total + kinds + 1)))).otherwise(F.col("logp").cast("double") + math.log10(LAMBDA)),
    }
    out = terms.joined_sums(partial, rare, values)
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("head_known") + F.col("tail_known")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.col("tail_base")).alias("base_score"), (F.col("head_score") + F.col("tail_score")).alias("score"),
    )
