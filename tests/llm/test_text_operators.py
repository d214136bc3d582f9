import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patternlens.llm import mixing, ngram_join, quality, sentencepiece_backend, suffix_dedup, tokenfile, tokens, toxicity
from patternlens.llm.common import give_back, utf8
from patternlens.llm.queries import tokenizer_file

from . import brute

DOCS = "doc_id long, text string, source string, size long, id string, key string"


def frame(spark, rows):
    """Rows (id, text[, source]) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", -1, "x", "y") for r in rows], DOCS).repartition(3)


def some_texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 150]))] for _ in range(12)]
    rows = []
    for k, w in enumerate(base):
        for c in range(rng.randint(1, 6)):
            own = list(w)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((100 * k + c, " ".join(own) if c % 2 else " ".join(own).upper()))
    return rows + [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "ONE"), (5003, "one"), (None, "alone words here"), (None, None)]


@pytest.mark.parametrize("crowd", [32, 2])
def test_near_duplicates(spark, crowd, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    for seed in (1, 2):
        rows = some_texts(seed)
        got = [tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute.near_duplicates(rows)))
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0
    kept = ngram_join.representatives(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.where("doc_id in (5003, 5004)").count() == 1 and kept.where("doc_id in (5000, 5001, 5002)").count() == 3


def test_crowded_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    got = [tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute.near_duplicates(rows))


def passages(seed=3):
    rng = random.Random(seed)
    rand = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, long = rand(500), rand(900)
    rows = [(i, rand(rng.randint(0, 700)) + (shared if i % 3 == 0 else "") + rand(rng.randint(0, 300)) + (long[: 300 + 60 * i] if i % 2 else "")) for i in range(14)]
    return rows + [(50, "z" * 1200), (51, None), (52, ""), (53, shared), (53, shared), (54, rows[0][1]), (55, "ab" * 600 + shared[:450]), (None, long)]


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 1])
def test_repeated_bytes(spark, crowd):
    rows = passages()
    got = [tuple(r) for r in suffix_dedup.dedup_report(frame(spark, rows), crowd=crowd).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute.report(rows)))
    assert suffix_dedup.dedup_report(frame(spark, [])).count() == 0


def test_long_text_in_pieces_and_kept_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1_000)
    rows = passages(4)
    offsets, data = utf8(__import__("pyarrow").array([t for _, t in rows]))
    small = suffix_dedup.text_anchors(offsets, data)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 19)
    for a, b in zip(small, suffix_dedup.text_anchors(offsets, data), strict=True):
        assert a.tolist() == b.tolist()
    out = suffix_dedup.deduplicated(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")] and out.count() == len(rows)
    gone = brute.removed([(t or "").encode() for _, t in rows], 400)
    kept = {r.doc_id: r.text for r in out.where("doc_id < 50").collect()}
    for (i, t), g in zip(rows, gone, strict=True):
        if i is not None and i < 50:
            chars, at = [], 0
            for c in t:
                n = len(c.encode())
                chars.append("" if all(g[at : at + n]) else c)
                at += n
            assert kept[i] == "".join(chars)


def test_refinement_of_windows():
    a = b"x" * 40 + bytes(range(1, 200)) * 4
    flags = suffix_dedup.repeated(np.zeros(3, np.int64), [a[:100], a[10:100], b"q" * 100], [a[100:500], a[100:500], a[100:500]])
    ahead = suffix_dedup.BYTES.before
    want = [{ahead - k for k in range(0, 91)}, {ahead - k for k in range(0, 91)}, {ahead}]
    assert [set(np.flatnonzero(f).tolist()) for f in flags] == want


def worded(seed=9):
    """Texts that share runs of 49 to 60 words, with white space of their own around the words."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgé") * rng.randint(1, 3) + str(rng.randrange(10_000))
    shared = [[word() for _ in range(49 + k)] for k in range(12)]
    rows = []
    for i in range(40):
        w = [word() for _ in range(rng.randint(0, 80))]
        if i % 2:
            w += shared[i % 12] + [word()]
        if i % 5 == 0:
            w += shared[11]
        w += [word() for _ in range(rng.randint(0, 30))]
        rows.append((i, "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in w)))
    return rows + [(60, "the " * 200), (61, " " + " ".join(shared[11]) + "\n"), (61, " " + " ".join(shared[11]) + "\n"), (62, "few words in several texts, but less than a passage of these, as all can see, and see again and again here"), (63, "few words in several texts, but less than a passage of these, as all can see, and see again and again here"), (64, None), (65, ""), (66, " \n"), (None, "x " * 51 + "y")]


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 1])
def test_repeated_passages(spark, crowd, monkeypatch):
    rows = worded()
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    want = [(i, t) for (i, _), t in zip(rows, brute.all_without_passages(dict(enumerate(t for _, t in rows))).values(), strict=True)]
    got = [(r.doc_id, r.text) for r in suffix_dedup.deduplicated(frame(spark, rows), unit=suffix_dedup.PASSAGES).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    report = {r.doc_id: r for r in suffix_dedup.dedup_report(frame(spark, rows), unit=suffix_dedup.PASSAGES).collect()}
    assert report[60].n_removed == 799 and report[61].n_removed == len(" ".join(brute.words(rows[41][1])).encode()) and report[62].n_removed == 0
    assert suffix_dedup.deduplicated(frame(spark, []), unit=suffix_dedup.PASSAGES).count() == 0


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 1])
def test_short_passages_show_beside_repeated_bytes(spark, crowd, monkeypatch, tmp_path):
    from patternlens.llm.queries import QUERIES

    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    shared = " ".join(f"w{k}" for k in range(51))
    rows = [(i, t) for i, (_, t) in enumerate(worded() + [(0, f"ahead {shared} behind"), (0, f"before\t{shared}\nafter"), (0, shared[: shared.rindex(" ")] + " only fifty"), (0, " " + shared + " "), (0, " " + shared + " ")])]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op2_suffix_dedup"](spark, str(tmp_path))
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(tuple(r)[:5] for r in got.values()) == sorted(brute.report(rows)) and len(got) == out.count() == len(rows)
    left = brute.all_without_passages(dict(rows))
    assert {i: r.n_passage_bytes for i, r in got.items()} == {i: len((t or "").encode()) - len((left[i] or "").encode()) for i, t in rows}
    assert len(shared) < 400 and [(got[i].n_removed, got[i].n_passage_bytes, got[i].n_passages) for i in range(len(rows) - 5, len(rows))] == [(0, n, int(n > 0)) for n in (len(shared), len(shared), 0, len(shared), len(shared))]
    assert {i for i, r in got.items() if r.n_passages} == {i for i, r in got.items() if r.n_passage_bytes}


def test_words_in_pieces(monkeypatch):
    rows = worded(5)
    offsets, data = utf8(__import__("pyarrow").array([t for _, t in rows]))
    whole = suffix_dedup.elements(suffix_dedup.PASSAGES, offsets, data)
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    for a, b in zip(whole, suffix_dedup.elements(suffix_dedup.PASSAGES, offsets, data), strict=True):
        assert a.tolist() == b.tolist()


def test_one_passage_in_very_many_texts(spark):
    rng = random.Random(3)
    rand = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    common = rand(700)
    rows = [(i, rand(rng.randint(5, 90)) + common[rng.randint(0, 120) : 700 - rng.randint(0, 120)] + rand(rng.randint(5, 90))) for i in range(300)]
    got = [tuple(r) for r in suffix_dedup.dedup_report(frame(spark, rows), crowd=20).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute.report(rows)))


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "b", "b", "b", None])) for i in range(120)] + [(500, None, "c"), (501, "one word", "c"), (7, "x y", "a"), (None, "q", "d")]
    got = mixing.mix(frame(spark, rows)).collect()
    size = {s: sum(len(brute.words(t)) for _, t, z in rows if z == s) for s in {r[2] for r in rows}}
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(size.values())
    by: dict = {}
    for r in mixing.mix(frame(spark, rows), carry=("source",)).collect():
        by.setdefault(r.carried.source, []).append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    for s, own in by.items():
        assert own[0].source_size == size[s] and sum(r.taken for r in own) == int(own[0].target) and own[0].target <= 3 * size[s] + 1e-9
    assert abs(sum(own[0].target for own in by.values()) - sum(size.values())) < 1e-6
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and mixing.mix(frame(spark, [])).count() == 0
    mixed = mixing.mixed_documents(frame(spark, rows)).collect()
    taken = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
    assert taken == {s: sum(r.taken for r in own) for s, own in by.items() if sum(r.taken for r in own)}


def test_token_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    rows = [(9, "It's a <|endoftext|> test.\x01 é́ \x1c x"), (3, None), (4, ""), (5, "Hello WORLD " * 300), (3, "again"), (None, "none"), (-2, "<|ENDOFTEXT|> İSTANBUL ΣΑΣ 12"), (11, "tabs\t\x0b\nnew line 'll don't")]
    shards = tokenfile.write_shards(frame(spark, rows), path, shard_ids=64)
    got = [tuple(r) for r in tokenfile.read_documents(shards).collect()]
    own = Tokenizer.from_file(path)
    key = lambda r: (r[0] is not None, r[0] or 0)
    ids = {i: own.encode(t or "", add_special_tokens=False).ids + [2] for i, (_, t) in enumerate(rows)}
    want, at = [], 0
    hashes = {t: h for t, h in frame(spark, rows).select("text", F.xxhash64("text")).collect()}
    for k in sorted(range(len(rows)), key=lambda k: (key(rows[k]), hashes[rows[k][1]])):
        want.append((rows[k][0], at, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())))
        at += len(ids[k])
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and shards.count() > 1
    files = tokenfile.export(shards, str(tmp_path))
    shard = tokenfile.Shard(open(files[0], "rb").read())
    assert shard.document(0).tolist() == shard.ids[: shard.start(1)].tolist()
    with pytest.raises(ValueError):
        tokenfile.Shard(open(files[0], "rb").read()[:-1] + b"\xff")
    assert tokenfile.read_documents(tokenfile.write_shards(frame(spark, []), path)).count() == 0


def test_token_shards_are_files(spark):
    path = tokenizer_file("word_bpe_49k.json")
    shards = tokenfile.write_shards(frame(spark, [(i, "some words " * (i % 7)) for i in range(200)]), path, shard_ids=256)
    files = [f.removeprefix("file://") for f in shards.inputFiles()]
    assert tokenfile.write_shards(frame(spark, [(7, f"a hot id {i}") for i in range(50)]), path).agg(F.sum("n_docs")).first()[0] == 50
    assert len(files) == shards.count() > 1 and all(f.endswith(".plef") for f in files)
    found = {d: (r.shard_no, s.document(k).tolist()) for f, r in ((f, r) for r in shards.collect() for f in files if f"-{r.shard_no:06d}-" in f) for s in [tokenfile.Shard(open(f, "rb").read())] for k, d in enumerate(s.doc_ids)}
    got = {r.doc_id: r for r in tokenfile.read_documents(shards).collect()}
    assert {i: (r.n_tokens, r.ids_crc32) for i, r in got.items()} == {d: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, (_, x) in found.items()}
    assert len(got) == 200


@pytest.mark.parametrize("n,top", [(0, 0), (1, 0), (1, 9), (200, 0), (200, 150), (500, 10**7), (64, 64 << 30)])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    ef = tokenfile.EliasFano.encode(v, top)
    assert ef.all().tolist() == v.tolist() and [ef.select(i) for i in range(n)] == v.tolist()
    with pytest.raises(IndexError):
        ef.select(n)


def test_chunk_cache_forgets_and_keeps_right():
    cache = tokens.ChunkCache(lambda chunks: [np.arange(len(c)) for c in chunks], np.uint16, remembered=2)
    for text in ("a bb ccc", "dddd a", "bb"):
        parts = text.split()
        ids, sizes = cache.ids(np.array([hash(p) & (1 << 63) - 1 for p in parts], np.uint64), lambda i, parts=parts: parts[i])
        assert sizes.tolist() == [len(p) for p in parts] and ids.tolist() == [x for p in parts for x in range(len(p))]


def test_marks_that_compose_with_one_case():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    texts = ["H\u0331 T\u0308 W\u030a Y\u030a J\u030c", "a JH\u0331", "", "Plain H", "\u0331H", "H\u0331", "h\u0331 É E\u0301 ABC", "end. two, a.b. It's. 12, 3.5, ... .. x.. é. É, 's. don't! '. a', <| <|x|>. ?a? a\u0301. ½. \u0331,", "Wait.\u0301 a,\u0338 b;"]
    raw = [t.encode() for t in texts]
    got = tokens.WordEncoder(path).encode(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
    assert [x.tolist() for x in got] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_sentencepiece_parity(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_backend.PieceEncoder(path)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab  ▁\n\té日😀<s>0x41 \x00'") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    own.verify(texts)
    rows = [(1, "some  text\n"), (2, None), (3, "x" * 3000), (3, "x" * 3000), (None, "é")]
    got = {r.doc_id: r for r in sentencepiece_backend.encode_documents(frame(spark, rows), path).collect()}
    assert got[1].ids == sp.encode("some  text\n") and got[2].n_tokens == 0 and all(r.round_trip for r in got.values()) and len(got) == 4
    assert got[3].ids_crc32 == zlib.crc32(np.array(sp.encode("x" * 3000), "<u4").tobytes())
    assert sentencepiece_backend.encode_documents(frame(spark, []), path).count() == 0
    whole = sentencepiece_backend.encode_documents(frame(spark, [(k, t) for k, t in enumerate(texts)]), path, keep=("doc_id", "text"), checked=1)
    back = sentencepiece_backend.decode_documents(whole.withColumnRenamed("text", "was"), path).collect()
    assert len(back) == len(texts) and all(r.text == sp.decode(sp.encode(r.was)) for r in back)
    drawn = [[rng.randrange(sp.vocab_size() if k % 2 else 300) for _ in range(rng.randint(0, 12))] for k in range(2000)]
    assert [own.decode(np.array(x, np.int64)) for x in drawn] == sp.decode(drawn)
    odd = spark.createDataFrame([(1, None, "x"), (2, [], "x"), (3, [None], "x")], "n_tokens int, ids array<int>, text string")
    got = {r.n_tokens: r.text for r in sentencepiece_backend.decode_documents(odd, path).collect()}
    assert got[1] == got[2] == "" and "\u2047" in got[3]
    assert sentencepiece_backend.decode_documents(odd.limit(0), path).count() == 0


def classified(n=400, seed=4):
    rng = random.Random(seed)
    vowels = ["ba", "de", "mi", "lo", "ru", "tan", "sel", "vor"]
    word = lambda: "".join(rng.choice(vowels) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 120))]
        junk, toxic = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = "grumpf" + rng.choice("abcdefgh") + rng.choice("xyz")
        docs.append((i, " ".join(x.upper() + "!!" if junk else x for x in w)))
        labels.append((i, int(not junk), int(toxic)))
    return docs + [(9000, None), (9001, ""), (9002, "   "), (None, "ba de mi")], labels


def test_classifiers(spark):
    docs, labels = classified()
    table = spark.createDataFrame(labels + [(1, None, None)], "doc_id long, quality int, toxic int")
    for module, col, mod, fold, cut in ((quality, 1, 5, 0, 0.3), (toxicity, 2, 3, 1, 0.7)):
        got = module.score_documents(frame(spark, docs), table).collect()
        assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % mod == fold) for r in got)
        truth = {row[0]: row[col] for row in labels}
        held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
        assert sum(a == b for a, b in held) >= 0.95 * len(held)
        again = {(r.doc_id, round(r.score, 4)) for r in module.score_documents(frame(spark, docs).repartition(5), table).collect()}
        assert again == {(r.doc_id, round(r.score, 4)) for r in got}
        assert module.score_documents(frame(spark, docs[:5]), table.limit(0)).count() == 5 and module.score_documents(frame(spark, []), table).count() == 0


def test_long_training_texts_are_drawn_from_everywhere():
    text = " ".join(f"w{i}" for i in range(40_000)).encode()
    got = toxicity.drawn(np.frombuffer(text, np.uint8))
    assert 0.9 * toxicity.TEXT_BYTES < len(got) <= toxicity.TEXT_BYTES
    places = [int(w[1:]) for w in got.decode().split()]
    assert places == sorted(places) and max(places) > 35_000 and all(b == a + 1 for a, b in zip(places[::3], places[1::3], strict=False))
    assert toxicity.drawn(np.frombuffer(b"Short, text", np.uint8)) == b"short  text" and toxicity.drawn(np.frombuffer(b"x" * 100_000, np.uint8)) == b""


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_held_out_toxicity(spark):
    """Of the held-out documents that are labelled toxic and hold a word that mostly toxic ones hold, nearly all are found; of the clean ones few."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] >= 0.9 * (counts[1, 1] + counts[1, 0]) and counts[0, 1] <= 0.03 * (counts[0, 0] + counts[0, 1])


def plain_score(model, text):
    """The score again, a word and an n-gram at a time."""
    words_ = bytes(toxicity._FOLD[np.frombuffer(text.encode(), np.uint8)]).split()
    z = min(model.bias, 0.0)
    logits = []
    for i in range(0, len(words_), toxicity.PASSAGE_WORDS):
        total, n = 0.0, 0
        for w in words_[i : i + toxicity.PASSAGE_WORDS]:
            w = b" " + w + b" "
            for size in toxicity.GRAMS:
                for k in range(len(w) - size + 1):
                    code = size
                    for byte in w[k : k + size]:
                        code = (code * 0x01000193 & 0xFFFFFFFF) ^ (byte + 1)
                    code ^= code >> 15
                    code = code * 0x2C1B3C6D & 0xFFFFFFFF
                    code ^= code >> 13
                    total, n = total + float(model.weight[code >> (32 - toxicity.BUCKET_BITS)]), n + 1
        logits.append(total / max(n, 1) + model.bias)
    if logits:
        e = [np.exp(model.sharpness * (x - max(logits))) for x in logits]
        z = sum(x * y for x, y in zip(e, logits, strict=True)) / sum(e)
    return 1 / (1 + np.exp(-(model.scale * z + model.shift)))


def test_toxicity_scores_by_brute_force():
    docs, labels = classified(150)
    model = toxicity.fit([t.encode() for _, t in docs[:150]], np.array([r[2] for r in labels]))
    texts = [t or "" for _, t in docs[100:]] + ["a", "Éa b! c.d  e", "GRUMPFax, grumpfby"]
    raw = [t.encode() for t in texts]
    got = model.score(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-6)


def test_class_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    width = quality.STATS + quality.BINS
    rows = lambda n, share: np.where(rng.random(n) < share, 1.0, -1.0)[:, None] * np.eye(1, width) * 2 + rng.normal(size=(n, width)) * 0.5
    for share in (0.3, 0.6, 0.9):
        assert abs(quality.estimate_prior(rows(1_500, 1.0), rows(3_000, share)) - share) < 0.1
    assert quality.estimate_prior(rows(5, 1.0), rows(100, 0.5)) == 0.5


def plain_features(text):
    """The features again, byte by byte and word by word."""
    raw = text.encode()
    w = [x.encode() for x in brute.words(text)]
    symbol = lambda c: not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or c in b" \t\n\x0b\x0c\r")
    n, m = max(len(raw), 1), max(len(w), 1)
    share = lambda test: sum(map(test, raw)) / n
    stats = [
        np.log1p(len(w)), np.log1p(len(raw)), share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(symbol), share(lambda c: c in b" \t\n\x0b\x0c\r"), share(lambda c: c >= 128), share(lambda c: c == 10),
        len(raw) / m, len(set(w)) / m, sum(a == b for a, b in zip(w, w[1:], strict=False)) / m, sum(len(x) == 1 and symbol(x[0]) for x in w) / m,
        sum(len(x) > 2 and symbol(x[-1]) and symbol(x[-2]) for x in w) / m, sum(len(x) > 1 and x[:2].isupper() and x[:2].isalpha() for x in w) / m, float(not w),
    ]
    bins = np.zeros(quality.BINS)
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        bins[((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 23] += 1
    return np.concatenate([stats, np.sqrt(bins / max(len(raw) - 2, 1))])


def test_quality_features_by_brute_force():
    texts = ["", " \n", "a", "ab", "One two TWO two!! two!! 12 - $$ é", "Über ALL all a.b ???", "x" * 50_000, "word " * 40_000]
    raw = [t.encode() for t in texts]
    got = quality.features(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-5)


def test_quality_is_learned_outside_the_driver(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["Plain", "words,", "12", "$$", f"v{i % 7}"][: 2 + 3 * (i % 2)]) for _ in range(30))) for i in range(1_000)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    docs = frame(spark, rows)
    tracemalloc.start()
    model = quality.train(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_500_000  # the sample alone is 1,200 rows of 4 KB, and learning holds several copies
    found = lambda keep: quality.features(*utf8(pa.array([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 and keep(i)]))).astype(np.float64)
    in_order = lambda x: np.array(sorted(x, key=lambda r: r.astype(np.float32).tobytes()))
    positive, free = in_order(found(lambda i: i % 2 == 0)), in_order(found(lambda i: True))
    want = quality.fit(positive, free, quality.estimate_prior(positive, free))
    assert np.allclose(model.weight, want.weight, atol=1e-4) and abs(model.bias - want.bias) < 1e-4


def test_driver_hands_free_memory_back(spark):
    assert give_back(spark)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_word_encoder_on_whole_documents():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()][:400]
    raw = [t.encode() for t in texts]
    got = tokens.WordEncoder(path).encode(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
    assert [x.tolist() for x in got] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
