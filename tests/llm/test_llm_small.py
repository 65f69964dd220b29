"""Defined results of the training-data operators on nulls, empty and odd texts, repeats, clashing names, empty tables."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vacantia.llm import attention_lm, components, matroska, mixing, near_copies, pieces, quality_classifier, quality_rules, simhash, spm_codec, terms, token_counts, url_rules, warc_index
from vacantia.llm.queries import _piece_model

TEXTS = [None, "", " ", "\n", "a", "a  b", " a\n\nb ", "word " * 3000, "x" * 20000, "Ünï çødé ☃ 😀", "▁ ▁▁a ▁", "<s> </s> <0x0A>", "tab\tb\x0bc\x0cd\r\n e", "same text here now", "same text here now", "the cat sat on the mat the cat sat on the mat"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "src0", len(t or ""), "x", 1.0) for i, t in enumerate(TEXTS)] + [(4, "a", None, "src0", 1, "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double")


def words(t, low=False):
    t = t or ""
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) if low else t
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_token_counts_and_codec(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=_piece_model())
    want = sorted((-1 if i == 3 else i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in [*enumerate(TEXTS), (4, "a")])
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, _piece_model()).collect())
    assert got == want
    encoded = spm_codec.encode(docs.filter("doc_id IS NOT NULL"), _piece_model()).collect()
    assert len(encoded) == len(TEXTS)
    for r in encoded:
        t = TEXTS[r.doc_id] or ""
        assert list(r.ids) == sp.encode(t) and r.n_tokens == len(r.ids) and r.parity and r.decodes == ("▁" not in t)
    back = {r.doc_id: r.text for r in spm_codec.decode(spm_codec.encode(docs.filter("doc_id > 4"), _piece_model()), _piece_model()).collect()}
    assert all(back[i] == TEXTS[i] for i in back if "▁" not in TEXTS[i])


def test_rebuilt_tokenizer_agrees_on_whole_texts():
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=_piece_model()), spm_codec.rebuilt(_piece_model())
    for t in TEXTS:
        if t:
            ids = own.encode(t, add_special_tokens=False).ids
            assert ids == sp.encode(t) and ("▁" in t or own.decode(ids, skip_special_tokens=False) == t)


def test_unigram_models_with_byte_fallback(spark, tmp_path):
    """A model whose pieces and scores are written down here, against the library's own reading of it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    add = lambda piece, score, kind: proto.pieces.add(piece=piece, score=score, type=kind)
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        add(piece, 0.0, kind)
    for b in range(256):
        add(f"<0x{b:02X}>", 0.0, 6)
    for k, piece in enumerate("▁ a b c t h e ▁a ▁the he th at ▁cat cat ▁b ab abc bc ▁▁".split(" ")):
        add(piece, -1.0 - 0.37 * k, 1)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.vocab_size = 1, True, len(proto.pieces)
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = True, False, True
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["the cat", "abc  that cab", "", "x é the", "\n", "a" * 300, "thecatthecat bcb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in spm_codec.encode(docs, str(path)).collect():
        assert list(r.ids) == sp.encode(texts[r.doc_id]) and r.parity and r.decodes
    back = {r.doc_id: r.text for r in spm_codec.decode(spm_codec.encode(docs, str(path)), str(path)).collect()}
    assert back == dict(enumerate(texts))


def test_strip_takes_spaces_only(tmp_path):
    """Models without a character map strip and fold spaces, not line feeds and tabs."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3), *((f"<0x{b:02X}>", 6) for b in range(256))):
        proto.pieces.add(piece=piece, score=0.0, type=kind)
    for k, piece in enumerate("▁ a b c t h e ▁a ▁the he th at ▁cat cat ▁t ▁th ▁c ca".split(" ")):
        proto.pieces.add(piece=piece, score=-1.0 - 0.37 * k, type=1)
    path = str(tmp_path / "strip.model")
    for kind in (1, 2):
        for dummy in (True, False):
            proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = kind, True
            n = proto.normalizer_spec
            n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = dummy, True, True
            open(path, "wb").write(proto.SerializeToString())
            sp, own = sentencepiece.SentencePieceProcessor(model_file=path), spm_codec.rebuilt(path)
            for t in ("the cat", "\nthe cat\n", "\tthe", "  the  cat  ", " \n the\n \ncat \n ", "the cat \n", "   ", "\n ", "a \n\n  b "):
                assert own.encode(t, add_special_tokens=False).ids == sp.encode(t)
    for field in ("escape", "suffix"):
        proto.normalizer_spec.escape_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix = field != "escape", field == "suffix"
        open(path, "wb").write(proto.SerializeToString())
        with pytest.raises(ValueError, match="spaces"):
            spm_codec.rebuilt(path)


def test_null_ids_decode_to_empty_texts(spark):
    rows = spark.createDataFrame([(1, None), (None, []), (None, None)], "doc_id long, ids array<int>")
    assert sorted((r.doc_id or 0, r.text) for r in spm_codec.decode(rows, _piece_model()).collect()) == [(0, ""), (0, ""), (1, "")]


def test_numbers_beyond_a_column_are_malformed(spark):
    from vacantia.llm import ebml

    head = ebml.element(ebml.TRACKS, ebml.element(ebml.TRACK_ENTRY, ebml.number(ebml.TRACK_NUMBER, 1)))
    block = ebml.element(ebml.SIMPLE_BLOCK, ebml.as_vint(1) + b"\0\0\x80" + b"abc")
    media = lambda *parts: ebml.element(ebml.EBML, b"") + ebml.element(ebml.SEGMENT, b"".join(parts))
    cluster = lambda time, *more: ebml.element(ebml.CLUSTER, ebml.number(ebml.TIMESTAMP, time) + b"".join(more))
    group = ebml.element(ebml.BLOCK_GROUP, ebml.number(ebml.BLOCK_DURATION, 2**62) + ebml.element(ebml.BLOCK, ebml.as_vint(1) + b"\0\0\0" + b"abc"))
    wide = ebml.element(ebml.TRACKS, ebml.element(ebml.TRACK_ENTRY, ebml.number(ebml.TRACK_NUMBER, 2**40)))
    slow = ebml.element(ebml.TRACKS, ebml.element(ebml.TRACK_ENTRY, ebml.number(ebml.TRACK_NUMBER, 1) + ebml.number(ebml.DEFAULT_DURATION, 2**64 - 1)))
    far = ebml.element(ebml.SIMPLE_BLOCK, ebml.as_vint(2**40) + b"\0\0\x80" + b"abc")
    bad = [media(head, cluster(2**64 - 1, block)), media(head, cluster(2**62, block)), media(head, cluster(0, group)), media(wide, cluster(0, block)), media(slow, cluster(0, block)), media(head, cluster(0, far))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*bad, media(head, cluster(5, block))])], "doc_id long, media binary")
    got = {r.doc_id: r for r in matroska.packet_table(rows).collect()}
    assert len(got) == 7 and all(got[i].error and got[i].size is None for i in range(6))
    assert got[6].error is None and (got[6].timestamp_ns, got[6].size) == (5_000_000, 3)


def test_codec_of_an_empty_table(spark, docs):
    assert spm_codec.encode(docs.limit(0), _piece_model()).count() == 0 and token_counts.count_tokens(docs.limit(0), _piece_model()).count() == 0
    assert matroska.media_digests(docs.limit(0)).count() == 0 and attention_lm.score(docs.limit(0), _piece_model(), sample=40).count() == 0
    assert quality_classifier.classify(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_pretokens_join_to_the_text():
    import pyarrow as pa

    texts = [t for t in TEXTS if t]
    found, codes, counts = pieces.pretokens(pa.array(texts))
    at = 0
    for t, n in zip(texts, counts):
        assert "".join(found[c] for c in codes[at : at + n]) == " " + t.replace("▁", " ")
        at += n


def brute_rules(t):
    w, t = words(t), t or ""
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x in win if win.count(x) > 1} if len(w) < 200 else {x for x in set(win) if len(set(win)) < len(win)}
    covered = {i + k for i, x in enumerate(win) if x in many for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        t = TEXTS[3 if r.doc_id is None else r.doc_id]
        want = brute_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.base_failed or not r.kept)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_repeats_by_pairs_and_by_packing(spark):
    h = [5, 7, 5, 9, 7, 1, 1, 1, 3, 2]
    df = spark.createDataFrame([(h,), ([(1 << 24) + 1, (1 << 24) + 2, (1 << 24) + 1],), ([1],)], "h array<bigint>")
    a = [r[0] for r in df.select(quality_rules._by_pairs(F.col("h"))).collect()]
    b = [r[0] for r in df.select(quality_rules._by_packing(F.col("h"))).collect()]
    assert a == [10, 5, 0]
    assert [y for y in b if y is not None] == [x for x, y in zip(a, b) if y is not None] and b[1] is None


def test_simhash_groups(spark, docs):
    got = {(-1 if r.doc_id is None else r.doc_id): (r.fingerprint, r.component_id) for r in simhash.groups(docs).collect()}
    assert got[0] == ("0" * 16, 0) and got[1][1] == got[2][1] == got[-1][1] == 0 and got[13] == got[14] and got[13][1] == 13
    assert simhash.groups(docs.limit(0)).count() == 0
    kept = near_copies.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 14 not in ids and 13 in ids and len(ids) == len(set(ids))


def test_fingerprints_by_brute_force(spark, docs):
    """Bit by bit votes of XXH64 over the three-word shingles of each whole text, and components by all pairs."""
    import xxhash

    def fingerprint(t):
        w = words(t, True)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(16)] + [" ".join(base * 40), " ".join(base * 40 + ["end"])]
    rows = [(100 + i, t) for i, t in enumerate(near)] + [(i, t) for i, t in enumerate(TEXTS)]
    want = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in want}
    for _ in want:
        for i in want:
            root[i] = min(root[j] for j in want if (want[i] ^ want[j]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (f"{want[i]:016x}", root[i]) for i in want}


def test_large_shards_are_split(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 1500, dtype=np.int64)
    near = base[:300] ^ (1 << rng.integers(0, 60, 300))
    points = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(x),) for x in points], "fp long")
    out = simhash.sharded(df, len(points), 2, most=200).toPandas()
    assert out.groupby("shard").size().max() <= 400 and set(out.fp) == set(points.tolist())
    together = {(a, b) for _, g in out.groupby("shard") for a in set(g.fp) for b in set(g.fp) if a < b and (a ^ b).bit_count() <= 2}
    p = points.view(np.uint64)
    assert together == {(int(points[i]), int(points[j])) for i in range(len(p)) for j in np.flatnonzero(np.bitwise_count(p[i] ^ p) <= 2) if points[i] < points[j]}


def test_near_copies_by_brute_force(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [(0, None, "a"), (1, "", "b"), (2, " \n", "c"), (None, "lone text of no id here", "d"), (3, "Lone text of no id HERE", "e"), (3, "Lone text of no id HERE", "f"), (3, "other words than before", "g")], 10
    for size in (6, 30, 60, 200, 900):
        for _ in range(12):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(3):
                copy = list(base)
                for _ in range(rng.choice([0, 0, 1, size // 60, size // 45])):
                    copy[rng.randrange(size)] = "new%d" % rng.randrange(1000)
                rows.append((i, " ".join(copy), "x"))
                i += 1
    sets = []
    for _, t, _ in rows:
        w = words(t, True)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))
    alike = [[j for j in range(len(rows)) if len(a & sets[j]) >= 0.8 * len(a | sets[j])] for a in sets]
    for _ in rows:
        root = [min(root[j] for j in alike[k]) for k in range(len(rows))]
    least = {}
    for k, (d, *_) in enumerate(rows):
        if d is not None:
            least[root[k]] = min(least.get(root[k], d), d)
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.component_id is None else r.component_id) for r in near_copies.classes(docs).collect())
    assert got == sorted((-1 if d is None else d, least.get(root[k], -1)) for k, (d, *_) in enumerate(rows))
    kept = near_copies.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted({(least[root[k]], rows[min((m for m in range(len(rows)) if root[m] == root[k] and rows[m][0] == least[root[k]]), key=lambda m: m)][1]) for k in range(len(rows))})
    assert near_copies.deduplicated(docs.limit(0)).count() == 0 and near_copies.classes(docs.limit(0)).count() == 0


def test_vptree_finds_all_links():
    import numpy as np

    from vacantia.llm.vptree import Tree, forest

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[:900] ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64))
    dense = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, dense]))

    def roots(links):
        parent = list(range(len(points)))

        def top(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in links:
            a, b = top(int(i)), top(int(j))
            parent[max(a, b)] = min(a, b)
        return [top(i) for i in range(len(points))]

    want = roots((i, j) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[i] ^ points) <= 2))
    assert roots(forest(points, 2)) == want
    tree = Tree(points[::3], 16, 2)
    at, shard = tree.route(points)
    links = []
    for s in np.unique(shard):
        own = at[shard == s]
        links += [(own[i], own[j]) for i, j in forest(points[own], 2)]
    assert tree.shards > 4 and roots(links) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100 and all(got[200 + i] == 200 for i in range(1, 50))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_matroska(spark, docs):
    for r in matroska.media_digests(docs).collect():
        t = (TEXTS[3 if r.doc_id is None else r.doc_id] or "").encode()
        payload = t + b" " * (-len(t) % 192 if t else 192)
        assert f"ms={len(payload) // 8};" in r.feature and f"packets={len(payload) // 192};" in r.feature
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    media = matroska.contained(docs.filter("doc_id = 7"))
    raw = media.first().media
    packets = matroska.packet_table(media).orderBy("offset").collect()
    assert b"".join(raw[p.offset : p.offset + p.size] for p in packets) == ("word " * 3000).encode() + b" " * (-15000 % 192)
    assert {p.lacing for p in packets} == {0, 1, 2, 3} and [p.timestamp_ns // 1_000_000 for p in packets] == [24 * k for k in range(len(packets))]
    assert {(p.duration_ns, p.codec) for p in packets} == {(24_000_000, "A_PCM/INT/LIT")}
    assert [tuple(t) for t in matroska.track_table(media).collect()] == [(7, 1, 2, "A_PCM/INT/LIT", 24_000_000, 8000.0, 1, 8)]
    bad = matroska.packet_table(spark.createDataFrame([(1, bytearray(raw[:100])), (2, None)], "doc_id long, media binary")).collect()
    assert [b.doc_id for b in bad] == [1, 2] and all(b.error and b.track is None for b in bad)


def test_ebml_forms():
    from vacantia.llm import ebml

    frames = [b"a" * 300, b"b" * 10, b"c" * 700, b"d"]
    for lacing in (ebml.XIPH, ebml.EBML_LACING):
        body = ebml.laced(frames, lacing)
        assert [body[o : o + n] for o, n in ebml.frames_of(body, 0, len(body), lacing)] == frames
    group = ebml.element(ebml.BLOCK_GROUP, ebml.element(ebml.BLOCK, b"\x81\x00\x05\x00xyz") + ebml.element(ebml.REFERENCE, b"\xff"))
    cluster = bytes.fromhex("1F43B675") + b"\x01" + b"\xff" * 7 + ebml.number(ebml.TIMESTAMP, 10) + group
    data = bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + cluster
    packets, _, tracks = ebml.parse(data)
    assert [(p[0], p[1], data[p[3] : p[3] + p[4]], p[5]) for p in packets] == [(1, 15_000_000, b"xyz", False)] and not tracks
    laced = ebml.element(ebml.BLOCK, b"\x81\x00\x00\x04" + ebml.laced([b"ab", b"cd", b"ef"], ebml.FIXED)) + ebml.number(ebml.BLOCK_DURATION, 30)
    segment = ebml.element(ebml.SEGMENT, ebml.element(ebml.CLUSTER, ebml.number(ebml.TIMESTAMP, 100) + ebml.element(ebml.BLOCK_GROUP, laced)))
    assert [(p[1], p[2]) for p in ebml.parse(segment)[0]] == [(100_000_000, 10_000_000), (110_000_000, 10_000_000), (120_000_000, 10_000_000)]


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 5), "en", f"src{i % 3 if i % 2 else 0}", 0) for i in range(400)] + [(None, None, None, None, 0), (400, "", "en", "src0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget long")
    got = mixing.mix_table(docs, share=0.5, epochs=3).toPandas()
    assert len(got) == 402
    for _, leaf in got.groupby(["domain", "lang", "source"]):
        spent, budget = (leaf.n_tokens * leaf.copies).sum(), leaf.budget.iloc[0]
        assert spent <= budget and budget - spent <= 5 and leaf.copies.max() <= 3
    out = mixing.mixed_documents(docs, share=1.0, epochs=1)
    assert out.columns == docs.columns and out.count() >= 400
    assert mixing.mix_table(docs.limit(0)).count() == 0


def test_shortages_stay_among_siblings(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 10, 1, 10), ("a", "en", "y", 1000, 1, 1000), ("b", "en", "z", 1000, 2, 1000)], "domain string, lang string, source string, tokens long, weight long, capacity long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, F.lit(400)).collect()}
    assert got == {"x": 10, "y": 190, "z": 200}
    got = {r.source: r.budget for r in mixing.budgets(leaves.filter("source <> 'y'"), F.lit(400)).collect()}
    assert got == {"x": 10, "z": 390}


def test_classifier(spark, docs):
    good = [(i, "the good plain words of a text " * 4, i % 2) for i in range(0, 200, 2)]
    junk = [(i, "B*** A###!! C$$$ D%%% " * 6, 0) for i in range(1, 200, 2)]
    rows = spark.createDataFrame([(i, t, 1 - i % 2) for i, t, _ in good + junk], "doc_id long, text string, quality int")
    got = quality_classifier.classify(rows.select("doc_id", "text"), rows.select("doc_id", "quality")).toPandas()
    assert ((got.doc_id % 2 == 0) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    odd = quality_classifier.classify(docs, rows.select("doc_id", "quality").limit(0)).collect()
    assert len(odd) == len(TEXTS) + 1 and len({r.score for r in odd}) == 1
    kept = quality_classifier.accepted(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 200, 2))


def test_classifier_vectors_and_network_by_brute_force(spark):
    import numpy as np

    q = quality_classifier
    texts = ["Good words are good", "some Other words 12 here here", "", "good 3 words; some good"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    index = q.index_vectors()
    total = np.zeros_like(index)

    def streams(t):
        w = words(t)
        own = [zlib.crc32(x.lower().encode()) % q.WORDS for x in w]
        form = [q.AGAIN if k and w[k] == w[k - 1] else q.WORDS + zlib.crc32(q.shape(x).encode()) % (q.SHAPES - 1) for k, x in enumerate(w)]
        return own, form

    for t in texts:
        for s in streams(t):
            for a, b in zip(s, s[1:]):
                total[a] += np.roll(index[b], -1)
                total[b] += np.roll(index[a], 1)
    size = np.linalg.norm(total, axis=1, keepdims=True)
    want = total / np.where(size > 0, size, 1)
    got = q.word_vectors(df)
    assert np.allclose(got, want, atol=1e-6)
    for r in q.features(df, got).collect():
        parts = []
        for s in streams(texts[r.doc_id]):
            mean = sum((want[k] for k in s), np.zeros(q.DIM)) / max(1, len(s))
            parts += [*mean, np.linalg.norm(mean)]
        assert np.allclose(r.features, parts, atol=1e-5)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, q.FEATURES))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    net = q.Network(x, y)
    z = (x[7] - net.mean) / net.scale
    hidden = [np.tanh(sum(z[i] * net.p[0][i, j] for i in range(q.FEATURES)) + net.p[1][j]) for j in range(q.HIDDEN)]
    logit = sum(h * w for h, w in zip(hidden, net.p[2])) + net.p[3][0]
    assert abs(net.score(x[7:8])[0] - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-9
    held = np.arange(400) % 6 == 5
    loss = lambda t: np.mean(np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * net.logit(x[held]) / t))
    assert loss(net.temperature) <= min(loss(t) for t in (0.3, 0.5, 1.0, 2.0, 5.0)) + 1e-3


def test_language_model(spark, docs):
    import math
    from collections import Counter

    got = attention_lm.score(docs, _piece_model(), sample=40).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(None if i == 3 else i, t) for i, t in [*enumerate(TEXTS), (4, "a")]]
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t, True), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        w = [*words(TEXTS[3 if r.doc_id is None else r.doc_id], True), None]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, held(r.doc_id))
        assert abs(base - r.base_score) < 1e-6 * max(1, abs(base)) and r.score < 0 and math.isfinite(r.score)


def test_attention_is_causal_and_windows_score_once():
    import numpy as np

    from vacantia.llm import attention as a

    lengths = np.array([0, 1, a.WIDTH, a.WIDTH + 1, 5 * a.WIDTH])
    row, start, first = a.windows(lengths)
    for k, n in enumerate(lengths):
        seen = [p for s, f in zip(start[row == k], first[row == k]) for p in range(s + f, min(n, s + a.WIDTH))]
        assert seen == list(range(n))
    m, x = a.Model(50), np.arange(a.WIDTH)[None] % 50
    y = x.copy()
    y[0, -1] = 7
    assert np.allclose(m._forward(x)[-1][0, :-1], m._forward(y)[-1][0, :-1])
    where = np.arange(a.WIDTH)
    one = np.zeros(a.WIDTH)
    for k in range(a.CLASSES):
        one += 10.0 ** m.log_shares(x, where, np.full(a.WIDTH, k))[0]
    assert np.allclose(one, 1, atol=1e-3)


def test_scores_by_brute_force_and_mass_of_all_words():
    """Scores from a plain forward pass per window; the words of a closed vocabulary and the end have at most 1 together."""
    import math

    import numpy as np
    import pyarrow as pa

    from vacantia.llm import attention as a
    from vacantia.llm.pieces import MARK, model_proto

    path = _piece_model()
    names = [p.piece for p in model_proto(path).pieces]
    begins = np.array([n.startswith(MARK) for n in names])
    begins[a.END] = True
    counts = np.random.default_rng(4).integers(0, 50, len(names)).astype(float)
    group, within = a.classes(counts, begins)
    assert all((group[begins] < a.BEGINNING * a.SIZE)) and all(group[~begins] >= a.BEGINNING * a.SIZE)
    net = a.Model(len(names), seed=8)

    def shares(before):
        """P of every piece after the ids `before`, in full precision, by loops."""
        e, place, w, wo, wg, bg, wi, bi = (p.astype(float) for p in net.p)
        h = e[before] + place[: len(before)]
        q, k, v = np.split(h @ w, 3, axis=1)
        weight = np.array([math.exp(min(30, q[-1] @ k[j] / math.sqrt(a.DIM))) for j in range(len(before))])
        z = np.clip(h[-1] + (weight @ v / weight.sum()) @ wo, -6, 6)
        soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        p = np.concatenate([soft(z @ wg + bg)[g] * soft(z @ wi[g] + bi[g]) for g in range(a.GROUPS)])
        return p[group] * 10.0 ** within.astype(float)

    text = "The cat sat on the extraordinarily mat, naïvely"
    low, pieces = text.lower().split(), attention_lm._Pieces(path)
    coded = [pieces.flat(pa.array([x]))[0].tolist() for x in low]
    ids, total, known = [a.BEGIN], 0.0, {"the": 7, "cat": 3, "mat,": 0}
    n, kinds, ends = 40, 9, 5
    mass = lambda net_p, c: math.log10(a.LAMBDA * net_p + ((1 - a.LAMBDA) * (c + 1) / (n + kinds + 1) if c else 0))
    for word, code in zip(low, coded):
        p = 1 / shares(ids)[begins].sum()
        for i in code:
            p *= shares(ids)[i]
            ids.append(i)
        total += mass(p * shares(ids)[begins].sum(), known.get(word, 0))
    after = shares(ids)
    total += mass(after[a.END] / after[begins].sum(), ends)
    assert len(ids) < a.WIDTH
    head = [w for w, c in known.items() if c]
    found = [pieces.flat(pa.array([w])) for w in head]
    given = (head, np.array([known[w] for w in head]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
    run = attention_lm._scored(net, group, within, given, path, n, kinds, ends)
    row = next(run([pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": [text]})])).to_pylist()[0]
    assert abs(row["head_score"] + sum(t["logp"] + math.log10(a.LAMBDA) for t in row["tail"]) - total) < 1e-3
    # One-piece words and the end after "the cat": no more than 1, and what they lack is that of longer words.
    ids = [a.BEGIN, *coded[0], *coded[1]]
    one = shares(ids)
    words_mass = sum(one[i] / one[begins].sum() * shares([*ids, i])[begins].sum() for i in np.flatnonzero(begins)[:400])
    assert words_mass + one[a.END] / one[begins].sum() <= 1 + 1e-9


def test_attention_windows_reach_back():
    import numpy as np

    from vacantia.llm import attention as a

    assert a.WIDTH >= 32 and a.CONTEXT >= 8 and a.DIM >= 24
    row, start, first = a.windows(np.array([10 * a.WIDTH]))
    assert (first[1:] >= 8).all()
    m, x = a.Model(50), np.random.default_rng(0).integers(0, 50, (3, a.WIDTH))
    where, want = np.arange(3 * a.WIDTH), np.arange(3 * a.WIDTH) * 7 % a.CLASSES
    late = where % a.WIDTH >= a.CONTEXT
    for cut, whole in zip(m.log_shares(x, np.arange(late.sum()), want[late], a.CONTEXT), m.log_shares(x, where, want)):
        assert np.allclose(cut, whole[late], atol=1e-5)


def test_attention_gradients():
    import numpy as np

    from vacantia.llm import attention as a

    m = a.Model(20)
    m.p = [p.astype(np.float64) for p in m.p]
    x, y = np.random.default_rng(0).integers(0, 20, (3, a.WIDTH)), np.random.default_rng(1).integers(0, a.CLASSES, (3, a.WIDTH))
    y[0, 5:] = -1

    def loss():
        b, t = np.nonzero(y >= 0)
        return -m.log_shares(x, np.flatnonzero((y >= 0).reshape(-1)), y[b, t])[0].astype(float).mean() * np.log(10)

    for j, g in enumerate(m._gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = m.p[j][at], 1e-2
        m.p[j][at] = old + step
        up = loss()
        m.p[j][at] = old - step
        down = loss()
        m.p[j][at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-4, j


def test_warc(spark):
    big, other = "x" * 1500, "é" * 600
    rows = [(1, "http://A.example.com/p?q=1", big, 0), (2, "https://b.example.com", big, 0), (3, None, None, 0), (4, "no url", "small", 0), (5, "http://c/\n\tz\\n", other, 0), (6, "http://A.example.com/p?q=1", other, 0), (6, "http://A.example.com/p?q=1", other, 0), (None, "http://d/", big, 0), (7, "x://[::1]:80/a#b", "", 0), (8, "http://c/\0n\\0", "nul", 0), (9, " http://d\r\n ", "breaks", 0), (10, "", "empty", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    back = warc_index.archived(pages).collect()
    assert sorted((str(r.page_id), str(r.url)) for r in back) == sorted((str(i), str(u)) for i, u, *_ in rows)
    got = sorted(((r.page_id or -1), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        last = {big: 2, other: 6}.get(h)
        revisit = last is not None and i != last
        want.append((i or -1, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc_index.archived(pages.limit(0)).count() == 0


def test_index_by_ranges(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}.example.com/{i % 11}", "p" * (i % 50)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, captures = warc_index.write_archives(pages)
    blocks = warc_index.capture_index(captures, 16)
    wanted = captures.select("key", "page_id")
    small = sorted(map(tuple, warc_index.look_up(wanted, blocks).collect()))
    monkeypatch.setattr(warc_index, "DIRECTORY", 5)
    monkeypatch.setattr(warc_index, "STRIDE", 1)
    assert blocks.count() > 5 and len(small) == 300
    assert sorted(map(tuple, warc_index.look_up(wanted, blocks).collect())) == small


def test_archives_are_files_of_whole_records(spark, monkeypatch):
    import gzip

    from vacantia.llm import scratch

    pages = spark.createDataFrame([(i % 40, f"http://h/{i % 40}", "p" * 1200 if i % 3 else f"own {i}") for i in range(60)], "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc_index, "ARCHIVE_BYTES", 4000)
    folder, captures = warc_index.write_archives(pages)
    system, path = scratch.opened(folder)
    names = {r.archive for r in captures.collect()}
    raw = {n: gzip.decompress(system.open_input_file(f"{path}/{n}").read()) for n in names}
    assert sum(x.count(b"WARC-Type: warcinfo") for x in raw.values()) == len(names)
    assert all(x.count(b"WARC/1.1\r\n") == x.count(b"WARC-Date: 2") for x in raw.values())
    records = warc_index.read_ranges(folder, captures).collect()
    assert len(records) == 60 == len({r.record_id for r in records})
    assert warc_index.read_ranges(folder, captures.filter("page_id = 7")).count() == captures.filter("page_id = 7").count()


def test_join_with_hot_keys(spark, monkeypatch):
    from vacantia.llm import scratch

    rows = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(120)], "k long, v long")
    table = spark.createDataFrame([(k, f"x{k}", 30 if k < 3 else 1) for k in [0, 1, 2, *range(90, 110)]], "k long, x string, n long")
    want = sorted((r.k, r.v, str(r.x)) for r in scratch.joined(rows, table, ["k"], "left", 120).collect())
    monkeypatch.setattr(scratch, "SMALL", 5)
    monkeypatch.setattr(scratch, "HOT", 0.1)
    assert sorted((r.k, r.v, str(r.x)) for r in scratch.joined(rows, table, ["k"], "left", 120).collect()) == want and len(want) == 120


def test_url_rules(spark):
    urls = [None, "no scheme", "http://EXAMPLE.com/en/7?x", "http://a.example.com/en/1", "http://xexample.net/de/8", "http://example.net/de/8/", "http://q.org/es/", "http://q.org?es/", "ftp://org/es/x#y"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, labels).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("example.com", "/en/7", "example.com/en/7", "allow"), 3: ("a.example.com", "/en/1", "com/en/", "block"), 4: ("xexample.net", "/de/8", "net/de/", "allow"),
        5: ("example.net", "/de/8/", "example.net/de/8", "block"), 6: ("q.org", "/es/", "org/es/", "block"), 7: ("q.org", "", None, "allow"), 8: ("org", "/es/x", "org/es/", "block"),
    }


def test_mined_url_rules(spark):
    rows = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}.example.{'info' if i % 2 else 'net'}/p{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labels).collect()}
    assert all((got[i] == "block") == (i % 3 == 0) for i in range(300))


def test_mined_rules_by_brute_force(spark):
    """Every combination of tokens that isn't implied by a part of it, with its exact confidence and support."""
    import itertools
    import random

    rng = random.Random(2)
    rows = []
    for i in range(240):
        tokens = sorted(t for t, p in zip("abcdef", (0.5, 0.4, 0.3, 0.6, 0.2, 0.1)) if rng.random() < p) + ["z"]
        bad = ("a" in tokens and "b" in tokens) or ("e" in tokens and rng.random() < 0.7) or rng.random() < 0.1
        rows.append((i, tokens, int(bad)))
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, _, b in rows], "doc_id long, quality int, toxic int")
    got = url_rules.mined(spark.createDataFrame([r[:2] for r in rows], "page_id long, tokens array<string>"), labels, 0.01, 0.5, 5).collect()
    want, n = {}, len(rows)
    for k in range(1, 7):
        for part in itertools.combinations("abcdef", k):
            of = [b for _, t, b in rows if set(part) <= set(t)]
            if sum(of) >= max(5, 0.01 * n) and sum(of) / len(of) >= 0.5:
                want[part] = sum(of) / len(of)
    kept = {p: c for p, c in want.items() if not any(set(q) < set(p) and want[q] >= c for q in want)}
    assert {tuple(r.antecedent): round(r.confidence, 9) for r in got} == {p: round(c, 9) for p, c in kept.items()} and len(kept) > 2


def test_url_token_sets_dont_run_into_each_other(spark):
    """Paths with blanks once gave the key of another set of tokens; repeated rows and null ids each give a row."""
    rows = [(i, f"http://h.example/{'bad/' if i % 2 else 'good/'}x{i % 5}") for i in range(200)]
    pages = spark.createDataFrame(rows + [(900, "http://h.example/a p:bad/"), (901, "http://h.example/a/bad/"), (901, "http://h.example/a/bad/"), (None, "http://h.example/bad/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = sorted((-1 if r.page_id is None else r.page_id, r.verdict) for r in url_rules.judge(pages, labels, rules=()).collect() if r.page_id is None or r.page_id >= 900)
    assert got == [(-1, "block"), (900, "allow"), (901, "block"), (901, "block")]
    assert url_rules.judge(pages.limit(0), labels.limit(0)).count() == 0


def test_long_urls_are_mined_whole(spark):
    """Forty tokens that always stand together are one; a rule of more than three tokens is found."""
    tail = "/".join(f"w{k}" for k in range(40))
    rows = [(i, "http://h.example/" + "/".join(t for k, t in enumerate("abcd") if i >> k & 1) + ("/" + tail if i % 3 == 0 else "/q")) for i in range(480)]
    labels = spark.createDataFrame([(i, int(i & 15 != 15), 0) for i in range(480)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, rules=(), confidence=0.9).collect()}
    assert all((got[i] == "block") == (i & 15 == 15) for i in range(480))


CLASHING = ["_lang", "_source", "_w", "_h", "_m", "_q", "_base", "_lines", "row", "_leaf", "_n", "_copies", "_budget", "_text", "_full", "_rest", "_key", "key", "h", "fp", "n", "root", "__key"]


def test_stages_keep_columns_of_any_name(spark):
    text = "some words of a plain text that go on for a while and differ in each row of the table "
    rows = [(i, text + " ".join(f"n{i}x{k}" for k in range(60)), "en", "src1", *(f"{c}{i}" for c in CLASHING)) for i in range(30)] + [(None, None, None, None, *CLASHING)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    stages = {
        "rules": quality_rules.kept_documents(docs), "copies": near_copies.deduplicated(docs), "mix": mixing.mixed_documents(docs, share=1.0), "classifier": quality_classifier.accepted(docs, labels),
    }
    for name, out in stages.items():
        got = out.collect()
        assert out.columns == docs.columns and len(got) >= 25, name
        assert all(r[c] == (f"{c}{r.doc_id}" if r.doc_id is not None else c) for r in got for c in CLASHING), name
    assert [quality_rules.kept_documents(docs.limit(0)).count(), mixing.mixed_documents(docs.limit(0)).count(), quality_classifier.accepted(docs.limit(0), labels.limit(0)).count()] == [0, 0, 0]


def test_weights_at_every_level_and_largest_remainders(spark):
    rows = [(i, "w " * 10, lang, src) for i, (lang, src) in enumerate([("en", "src1"), ("en", "src2"), ("de", "src1"), ("en", "src3")] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    domain = F.when(F.col("source") == "src3", "b").otherwise("a")
    weights = spark.createDataFrame([("a", None, None, 3), ("b", None, None, 1), ("a", "en", None, 1), ("a", "de", None, 1), ("a", "en", "src1", 1), ("a", "en", "src2", 2)], "domain string, lang string, source string, weight long")
    got = mixing.mix_table(docs, share=0.5, epochs=2, weights=weights, domain=domain).select("domain", "lang", "source", "budget").distinct().collect()
    assert {(r.domain, r.lang, r.source): r.budget for r in got} == {("a", "en", "src1"): 75, ("a", "en", "src2"): 150, ("a", "de", "src1"): 225, ("b", "en", "src3"): 150}
    leaves = spark.createDataFrame([("a", "en", f"s{k}", 1000, 1, 1000) for k in range(7)], "domain string, lang string, source string, tokens long, weight long, capacity long")
    assert sorted(r.budget for r in mixing.budgets(leaves, F.lit(100)).collect()) == [14] * 5 + [15] * 2


def test_head_floor(spark):
    counts = spark.createDataFrame([(f"t{i}", 1 + i) for i in range(100)], "term string, n long")
    floor = terms.head_floor(counts, 20)
    assert 0 < counts.filter(F.col("n") >= floor).count() <= 20
    giant = counts.unionByName(spark.createDataFrame([("g" * 5_000_000, 10**6)], "term string, n long"))
    head, rest = terms.head_and_rest(giant)
    assert head.count() + rest.count() == 101 and head.count() > 50 and rest.filter("n = 1000000").count() == 1


def test_attention_training_grows_with_the_corpus_and_copies_are_drawn_apart():
    import numpy as np
    import pyarrow as pa

    from vacantia.llm.attention import WIDTH

    long = " ".join(f"word{i % 97} of {i % 31}" for i in range(4000))
    cut = [long[slice(*attention_lm._passage(long, k))] for k in range(-(-len(long) // attention_lm.PASSAGE))]
    assert "".join(cut) == long and all(c[-1] == " " for c in cut[:-1])

    def windows(texts, share, ids=None):
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids or range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
        return [np.frombuffer(y, np.int32) for b in attention_lm._sampled(_piece_model(), share)([batch]) for y in b.column("y").to_pylist()]

    every = np.concatenate(windows([long, None], 1.0))
    assert (every >= 0).sum() > WIDTH * attention_lm.PER_PASSAGE * 8  # far more than eight windows of one text
    n = [len(windows(["a copied text"] * k, 0.2)) for k in (1000, 4000)]
    assert 120 < n[0] < 280 and 600 < n[1] < 1000


def test_attention_parts_are_averaged_by_spark(spark):
    import numpy as np

    from vacantia.llm import attention as a

    rng = np.random.default_rng(0)
    x = rng.integers(3, 40, (30_000, 1)) + np.arange(a.WIDTH) % 7
    rows = [(bytearray(r.astype(np.int32).tobytes()), bytearray(((r + 1) % 50).astype(np.int32).tobytes())) for r in x[:26_000]]
    net, group = a.Model(50), np.arange(50)
    before = net.log_shares(x[:64], np.arange(64 * a.WIDTH), (x[:64].reshape(-1) + 1) % 50)[0].mean()
    attention_lm._fit(net, spark.createDataFrame(rows, "x binary, y binary"), group)
    after = net.log_shares(x[:64], np.arange(64 * a.WIDTH), (x[:64].reshape(-1) + 1) % 50)[0].mean()
    assert after > before / 4
    again = a.Model(50)
    attention_lm._fit(again, spark.createDataFrame(rows, "x binary, y binary"), group)
    assert all(np.array_equal(p, q) for p, q in zip(net.p, again.p))  # whole numbers are added, in any order
    one, two = a.Model(50), a.Model(50)
    start = [p.copy() for p in one.p]
    one.train(x[:640], x[:640] % 50, epochs=1)
    two.move(one.moved(start, x[:640]))
    assert all(np.allclose(p, q, atol=1e-4) for p, q in zip(one.p, two.p))


def test_attention_learns_from_every_passage(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    n = 1500  # more windows than any share of them that was drawn before
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1200)), lambda i: F.substring(F.md5((i * 7919 + F.col("doc_id")).cast("string")), 1, 3)))
    docs = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", text)
    seen = []

    def fit(net, windows, group, about):
        each = [windows(k, 4).select(F.hex("y").alias("y")).agg(F.count("*").alias("n"), F.sum((F.length("y") - F.length(F.replace("y", F.lit("FFFFFFFF"), F.lit("")))) / 8).alias("none")).first() for k in range(4)]
        seen.append((sum(r.n for r in each), sum(r.n * 32 - r.none for r in each), about))

    monkeypatch.setattr(attention_lm, "_fit", fit)
    attention_lm.score(docs, _piece_model())
    windows, places, about = seen[0]
    pieces = attention_lm._Pieces(_piece_model())
    train = docs.filter(~attention_lm.held_out()).toPandas()["text"]
    whole = sum(int(pieces.flat(pa.array(t.split()))[1].sum()) + 1 for t in train)
    assert places == whole and windows > 60_000 and abs(about - windows) < windows / 10
    plan = attention_lm._plan(10**7, 100, True)
    assert sorted((k, of) for _, k, of in plan) == [(k, len(plan)) for k in range(len(plan))] and all(e == 1 for e, _, _ in plan)
    x, y = attention_lm._cut(np.arange(10, 110), np.arange(9, 109), np.array([0, 40]), np.array([40, 45]))
    assert (y >= 0).sum(1).tolist() == [32, 8, 5] and y[2, :5].tolist() == [50, 51, 52, 53, 54] and (x[1, 8:] == 0).all()


def test_attention_windows_are_made_once(spark, monkeypatch):
    """Each round reads its part of the written windows; no round splits the texts anew."""
    import os

    import numpy as np

    docs = spark.range(60).selectExpr("id AS doc_id", "repeat(concat('word', id, ' of many '), 20 + CAST(id AS INT)) AS text")
    seen = []

    def fit(net, windows, group, about):
        each = [windows(k, 4) for k in range(4)]
        paths = {f for e in each for f in e.inputFiles()}
        x, y = (np.concatenate([np.frombuffer(bytes(r[c]), np.int32).reshape(1, -1) for e in each for r in e.collect()]) for c in ("x", "y"))
        seen.append((["MapInArrow" in e._jdf.queryExecution().executedPlan().toString() for e in each], paths, x, y, windows(0, 1).count()))

    monkeypatch.setattr(attention_lm, "_fit", fit)
    attention_lm.score(docs, _piece_model())
    made, paths, x, y, n = seen[0]
    assert not any(made) and len(x) == n > 300
    assert (x[:, 1:] == y[:, :-1]).all() and (x[:, 0] >= 0).all()
    assert paths and not any(os.path.exists(p.removeprefix("file://")) for p in paths)  # they are gone after the fit


def test_attention_steps_by_the_pieces_of_a_batch_only():
    """Gradients of the pieces that a batch has, moments of these alone, and shares from tables: as by the whole arrays."""
    import numpy as np

    from vacantia.llm import attention as a

    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 60, (40, a.WIDTH)), rng.integers(-1, a.CLASSES, (40, a.WIDTH))
    one, two = a.Model(90), a.Model(90)
    used, grads = one._used_gradients(x, y)
    whole = one._gradients(x, y)
    assert used.tolist() == sorted(set(x.reshape(-1).tolist())) and np.array_equal(whole[0][used], grads[0])
    assert not np.delete(whole[0], used, axis=0).any()
    one.train(x, y, epochs=2, batch=16)
    order, m, v, step = np.random.default_rng(9), [np.zeros_like(p) for p in two.p], [np.zeros_like(p) for p in two.p], 0
    for _ in range(2):
        at = order.permutation(40)
        for i in range(0, 40, 16):
            step += 1
            rows = np.unique(x[at[i : i + 16]])
            now = 0.012 * min(1, step / 50) * (1 - 0.95 * step / 6)
            for j, g in enumerate(two._gradients(x[at[i : i + 16]], y[at[i : i + 16]])):
                k = rows if j == 0 else slice(None)
                m[j][k] = 0.9 * m[j][k] + 0.1 * g[k]
                v[j][k] = 0.99 * v[j][k] + 0.01 * g[k] ** 2
                two.p[j][k] -= now * (m[j][k] / (1 - 0.9**step)) / (np.sqrt(v[j][k] / (1 - 0.99**step)) + 1e-8)
    assert all(np.allclose(p, q, atol=1e-5) for p, q in zip(one.p, two.p))
    where, want = np.arange(40 * (a.WIDTH - a.CONTEXT)), rng.integers(0, a.CLASSES, 40 * (a.WIDTH - a.CONTEXT))
    for p, q in zip(one.log_shares(x, where, want, a.CONTEXT), one.log_shares(x, where, want, a.CONTEXT, one.tables())):
        assert np.allclose(p, q, atol=1e-4)
    one.p[4] *= 1000  # far beyond what exp takes in float32
    assert all(np.isfinite(g).all() for g in one._gradients(x, y)) and np.isfinite(one.log_shares(x, where, want, a.CONTEXT)[0]).all()
