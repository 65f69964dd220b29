"""Spelling variants: words that differ by one letter, found by a bit-sliced position index.

Two words that differ by one inserted, deleted or replaced letter agree before the first place where they differ and
behind it. A *class* holds the words of lengths m and m + 1; a *hole* [a, b) in it stands for pairs whose first
difference lies there: both words of such a pair have the same first `a` letters and the same last m - b. So words that
agree in these meet in a group, and each pair meets in exactly one. Groups are gathered by Spark; those with more than
`MOST` words are dealt anew with the hole halved, until it is one letter wide, where the alphabet bounds a group.

Inside a task, 64 words share a machine word: for each place behind the hole's start and each letter a bitset says which
words have that letter there. A query word walks along its own letters and keeps the words that agree so far, those with
one replaced letter, with one letter more, and with one letter fewer; the latter two read the bitsets of the next and of
the previous place.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import sized, written

RUN = "[a-zÀ-ÿ]+"
#: Words of a group from which its hole is halved; rows that a task handles at once.
MOST, ROWS = 4096, 65_536


def vocabulary(docs: DataFrame, least_length: int = 5, least_n: int = 3, every: int = 97) -> DataFrame:
    """word, n: runs of Latin letters, A-Z lower-cased, that occur `least_n` times and have `least_length` letters.

    Of each run whose h, the CRC-32 of `<doc_id>:<run>`, is divisible by `every`, the letter at h % length is left out
    (0: of none). A null text has no run; a null id is an empty text. Rows are combined in the tasks before the shuffle.
    """
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_length)
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        runs = runs.select("run", h.alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("run")).filter(F.length("run") >= least_length)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _keyed(rows: DataFrame) -> DataFrame:
    """`rows` (word, n, m, a, b) with the key of their group: class, hole, and the letters before and behind it."""
    before, behind = F.substring("word", F.lit(1), F.col("a")), F.when(F.col("b") < F.col("m"), F.expr("right(word, m - b)")).otherwise("")
    return rows.withColumn("key", F.concat_ws(" ", "m", "a", "b", before, behind))


def _holes(a, b):
    """[a, b) in two halves."""
    mid = ((a + b) / 2).cast("int")
    return F.array(F.struct(a.alias("a"), mid.alias("b")), F.struct(mid.alias("a"), b.alias("b")))


def grouped(words: DataFrame, least_length: int, most: int = MOST) -> DataFrame:
    """key, word, n, m, a, b: each word in every group in which it may meet another that is one letter away."""
    size = F.length("word")
    classes = words.select("word", "n", F.explode(F.when(size > least_length, F.array(size - 1, size)).otherwise(F.array(size))).alias("m"))
    todo = _keyed(classes.select("word", "n", "m", F.inline(_holes(F.lit(0), F.col("m") + 1))))
    done = None
    while True:
        todo = written(todo, "spelling-groups")
        large = todo.groupBy("key").count().filter(F.col("count") > most).select("key", F.lit(True).alias("large"))
        marked = todo.join(sized(written(large, "spelling-large")), "key", "left")
        split = F.col("large").isNotNull() & (F.col("b") - F.col("a") > 1)
        kept = marked.filter(~split).drop("large")
        done = kept if done is None else done.unionByName(kept)
        finer = marked.filter(split).select("word", "n", "m", F.inline(_holes(F.col("a"), F.col("b"))))
        if finer.isEmpty():
            return done
        todo = _keyed(finer)


class _Index:
    """The position index of a run of whole groups: row i has bit i % 64 of lane i // 64."""

    def __init__(self, letters, start, length, a, group):
        import numpy as np

        self.letters, self.start, self.length, self.a, self.rows = letters, start, length, a, len(start)
        codes = np.zeros(256, np.int64)
        used = np.unique(letters)
        codes[used] = np.arange(1, len(used) + 1)
        self.coded, self.width = codes[letters], len(used) + 1
        self.lane, self.bit = np.arange(self.rows) // 64, np.uint64(1) << (np.arange(self.rows) % 64).astype(np.uint64)
        self.lanes = self.rows // 64 + 1
        self.first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if self.rows else np.zeros(0, np.int64)
        self.end = np.append(self.first[1:], self.rows)

    def letter(self, rows, place):
        """The code of the letter at `place` behind the hole's start, 0 where the word has ended."""
        import numpy as np

        at = self.a[rows] + place
        inside = at < self.length[rows]
        return np.where(inside, self.coded[np.minimum(self.start[rows] + at, len(self.coded) - 1)], 0)

    def bitsets(self, place):
        """For each lane and letter the words that have it at `place`; none before the hole."""
        import numpy as np

        out = np.zeros(self.lanes * self.width, np.uint64)
        if place >= 0:
            every = np.arange(self.rows)
            np.add.at(out, self.lane * self.width + self.letter(every, place), self.bit)  # each bit once, so a sum is a union
        return out

    def marked(self, rows):
        """A bitset for each lane of `rows`."""
        import numpy as np

        out = np.zeros(self.lanes, np.uint64)
        np.add.at(out, self.lane[rows], self.bit[rows])
        return out


def _near(letters, start, length, m, a, b, group):
    """(row, other): rows of one group whose words are one letter apart and first differ in the group's hole."""
    import numpy as np

    index = _Index(letters, start, length, a, group)
    n = index.rows
    own = np.repeat(np.arange(len(index.first)), index.end - index.first)
    lo, hi = index.first[own] // 64, (index.end[own] - 1) // 64
    steps = length - np.maximum(m - b, 0) - a
    query = np.argsort(-steps, kind="stable")
    query = query[(index.end - index.first)[own[query]] > 1]
    lanes = (hi - lo + 1)[query]
    row = np.repeat(query, lanes)
    lane = np.repeat(lo[query] - (np.cumsum(lanes) - lanes), lanes) + np.arange(len(row))
    # All words of the group in that lane agree with the query so far.
    left, right = np.maximum(index.first[own[row]] - lane * 64, 0), np.minimum(index.end[own[row]] - lane * 64, 64)
    full = ~np.uint64(0)
    same = (full >> (64 - (right - left)).astype(np.uint64)) << left.astype(np.uint64)
    other, more, fewer, beyond = (np.zeros(len(row), np.uint64) for _ in range(4))
    step, width = steps[row], b[row] - a[row]
    before, here, base = index.bitsets(-1), index.bitsets(0), lane * index.width
    for p in range(int(steps.max()) if n else 0):
        k = int(np.searchsorted(-step, -p))  # rows that still have a letter
        if not k:
            break
        after = index.bitsets(p + 1)
        at = base[:k] + index.letter(row[:k], p)
        fits, z = here[at], same[:k]
        fewer[:k] = (fewer[:k] & before[at]) | z
        more[:k] = (more[:k] | z) & after[at]
        other[:k] = (other[:k] & fits) | (z & ~fits)
        same[:k] = z & fits
        over = width[:k] == p + 1
        beyond[:k][over] = same[:k][over]
        before, here = here, after
    short = index.marked(np.flatnonzero(length == m))[lane]
    long = index.marked(np.flatnonzero(length == m + 1))[lane]
    found = np.where(length[row] == m[row], (other & short) | ((more | same) & long), fewer & short) & ~beyond
    some = np.flatnonzero(found)
    row, lane, found = row[some], lane[some], found[some]
    rows, others = [], []
    while len(row):
        low = found & (~found + np.uint64(1))
        rows.append(row)
        others.append(lane * 64 + np.bitwise_count(low - np.uint64(1)))
        found = found ^ low
        left = found != 0
        row, lane, found = row[left], lane[left], found[left]
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(others)) if rows else (none, none)


def _matched(batches):
    """For each word and group how many near words it has there, and the most frequent of them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def solved(table):
        get = lambda c: table.column(c).to_numpy().astype(np.int64)
        words, n = table.column("word").to_pylist(), get("n")
        letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        length = np.fromiter(map(len, words), np.int64, len(words))
        group = table.column("key").combine_chunks().dictionary_encode()
        group = (group.combine_chunks() if isinstance(group, pa.ChunkedArray) else group).indices.to_numpy()
        row, other = _near(letters, np.cumsum(length) - length, length, get("m"), get("a"), get("b"), group)
        rank = np.empty(len(words), np.int64)
        rank[np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)] = np.arange(len(words))
        order = np.lexsort((rank[other], -n[other], row))
        row, other = row[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        count, best = np.bincount(row, minlength=len(words)), np.full(len(words), -1)
        best[row[first]] = other[first]
        at = pa.array(best, mask=best < 0)
        return pa.RecordBatch.from_arrays([pc.cast(table.column("word").combine_chunks(), pa.string()), pa.array(n), pa.array(count.astype(np.int64)), pa.array(n).take(at), pa.array(words, pa.string()).take(at)], ["word", "n", "near", "best_n", "best"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("key")
        last = pc.index(pc.equal(keys, keys[-1]), True).as_py()  # the last group may go on; rows are sorted by key
        if last:
            yield solved(table.slice(0, last))
        held = table.slice(last).to_batches()
        rows = table.num_rows - last
    if rows:
        yield solved(pa.Table.from_batches(held))


def near_words(words: DataFrame, least_length: int = 5, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n: of each of the distinct `words` (word, n) how many are one letter away, and the
    most frequent of these (ties: the first in code-point order), null where none is."""
    groups = grouped(words, least_length, most)
    parts = groups.repartition("key").sortWithinPartitions("key").mapInArrow(_matched, "word string, n bigint, near bigint, best_n bigint, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))))
    out = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("top"))
    return out.select("word", "n", "n_near", F.col("top.form").alias("form"), (-F.col("top.less")).alias("form_n"))


def _rooted(forms: DataFrame) -> DataFrame:
    """word, root of each row of `forms` (word, form): forms followed to the last, twice as far in each round."""
    steps = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if steps.filter("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def variants(docs: DataFrame, least_length: int = 5, least_n: int = 3, times: int = 2, every: int = 97, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of `vocabulary(docs)`.

    A word's form is its most frequent near word if that is at least `times` as frequent, else null; its root is the
    last of its form's forms, itself if it has none. As n grows along forms, they never lead back. `docs` has doc_id and
    text; other columns aren't read. Repeated rows and ids count as often as they occur; no word gives no rows.
    """
    words = written(vocabulary(docs, least_length, least_n, every), "vocabulary")
    near = near_words(words, least_length, most)
    holds = F.col("form_n") >= times * F.col("n")
    near = written(near.select("word", "n", "n_near", F.when(holds, F.col("form")).alias("form"), F.when(holds, F.col("form_n")).alias("form_n")), "spelling-forms")
    out = near.join(_rooted(near.filter("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same by deleted letters: two words are one letter apart if one is the other without a letter, or both are equal without the letter at the same place.
ORACLE = r"""
WITH RECURSIVE bytes AS (SELECT i, list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(0, 256) r(i)),
crc AS (SELECT list(t ORDER BY i) AS t FROM bytes),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS c FROM runs WHERE length(w) >= 5 GROUP BY ALL),
hashed AS (SELECT w, c, xor(list_reduce(list_concat([4294967295], flatten(list_transform(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END))), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM counted, crc),
v AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, CAST(sum(c) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3),
cut AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS k FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v)),
pairs AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN v ON c.k = v.word UNION SELECT v.word, c.word FROM cut c JOIN v ON c.k = v.word),
best AS (SELECT p.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS form, max(o.n) AS form_n FROM pairs p JOIN v o ON o.word = p.other GROUP BY p.word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.root FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN roots r USING (word)
"""
