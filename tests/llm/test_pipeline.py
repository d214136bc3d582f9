import os
import random

import pytest
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark):
    import corpus_pipeline as c
    from patternlens.llm import mixing, quality, sentencepiece_backend
    from patternlens.llm.common import stash, table
    from patternlens.llm.queries import tokenizer_file

    docs = table(spark, SF, "documents")
    columns = docs.columns
    at = [docs]
    for name, stage in c.STAGES:
        at.append(stash(stage(spark, at[-1], SF), f"test-{name}"))
    assert all(x.columns == columns for x in at[:-1])
    scores = {r.doc_id: r.predicted for r in quality.score_documents(docs, table(spark, SF, "labels")).collect()}
    assert {r.doc_id for r in at[1].collect()} == {i for i, p in scores.items() if p}
    rows = [(r.doc_id, r.text) for r in at[1].collect()]
    assert sorted(r.doc_id for r in at[2].collect()) == sorted(i for i, _, k in brute.near_duplicates(rows) if i == k)
    rows = [(r.doc_id, r.text) for r in at[2].collect()]
    kept = {r.doc_id: r.text for r in at[3].collect()}
    assert kept == brute.all_without_passages(dict(rows)) and any(kept[i] != t for i, t in rows)
    plan = {r.doc_id: r.taken for r in mixing.mix(at[3]).collect()}
    taken: dict = {}
    for r in at[4].collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(brute.words(r.text))
    assert taken == {i: n for i, n in plan.items() if n}
    own = sentencepiece_backend.PieceEncoder(tokenizer_file("piece_bpe_32k.model"))
    got = sorted((r.doc_id, tuple(r.ids)) for r in at[5].collect())
    assert got == sorted((r.doc_id, tuple(own.encode_texts([r.text])[0].tolist())) for r in at[4].collect()) and at[5].where(~F.col("round_trip")).count() == 0


def edge_rows():
    """Rows with nulls, ties, copies and long texts, a passage of 51 to 60 words in several of them, and columns whose names the stages use."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ba", "de", "mi", "lo", "ru", "tan", "sel", "vor"]) for _ in range(rng.randint(1, 4)))
    shared = [[word() for _ in range(51 + k)] for k in range(10)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(60, 200))]
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = shared[i // 3 % 10]
        rows.append((i, " ".join(w), rng.choice(["a", "b", None])))
    rows += [(100, rows[1][1], "a"), (101, rows[1][1] + " more", "b"), (102, None, "a"), (103, "", "b"), (104, " \n", None), (105, rows[2][1], "a"), (105, rows[2][1], "a"), (106, "one", "c"), (None, " ".join(word() for _ in range(80)), "a"), (107, " ".join(word() for _ in range(60_000)), "b")]
    return rows


EDGE = "doc_id long, text string, lang string, source string, n_chars long, text_md5 string, kept_id long, wordless boolean, size long, hash long, spans string, ids string, n_tokens string, carried string, row string"


def test_stages_on_edge_cases(spark, tmp_path):
    import corpus_pipeline as c
    from patternlens.llm import mixing

    rows = edge_rows()
    full = [(i, t, "en", s, len(t or ""), "m", 7, True, -1, -2, "s", "i", "n", "c", "r") for i, t, s in rows]
    spark.createDataFrame(full, EDGE).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = c.keep_good(spark, docs, str(tmp_path))
    assert good.columns == docs.columns and good.count() <= docs.count()
    one = c.one_of_each(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and {(r.text_md5, r.kept_id, r.wordless, r.row) for r in one.collect()} == {("m", 7, True, "r")}
    least = {}
    for i, _, k in brute.near_duplicates([(i, t) for i, t, _ in rows]):
        least.setdefault(i, k)
    assert sorted(map(repr, [r.doc_id for r in one.collect()])) == sorted(map(repr, {i for i, _, _ in rows if least[i] == i}))
    cut = c.without_repeats(spark, one, str(tmp_path))
    left = [(r.doc_id, r.text) for r in one.collect()]
    want = brute.all_without_passages(dict(left))
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()} == want and {r.hash for r in cut.collect()} == {-2}
    assert sum(want[i] != t for i, t in left) >= 20 and {r.n_chars for r in cut.where("doc_id < 60").collect()} == {len(t) for i, t in want.items() if i is not None and i < 60}
    taken = c.mixed(spark, cut, str(tmp_path))
    plan = {r.doc_id: r.taken for r in mixing.mix(cut).collect()}
    words = {}
    for r in taken.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.words(r.text))
    assert taken.columns == docs.columns and words == {i: n for i, n in plan.items() if n}
    out = c.encoded(spark, taken, str(tmp_path))
    assert out.count() == taken.count() and out.where("not round_trip").count() == 0
    empty = docs.limit(0)
    for _, stage in c.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
    assert c.sentencepiece_backend.encode_documents(docs.where("doc_id = 106"), c.tokenizer_file("piece_bpe_32k.model"), keep=("doc_id", "ids")).first().kept_ids == "i"


def test_everything_is_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
    assert set(e.oracle_sql()) <= set(names)
