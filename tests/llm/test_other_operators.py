import math
import random

import numpy as np
import pytest

from patternlens.llm import embedding_dedup, graph, html_extract, topk

from . import brute
from .layouts import PAGES

VECS = "vec_id long, embedding array<float>, label int, id string, cls string, vec string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], VECS).repartition(3)


def some_vectors(seed=1, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(40):
        base = rng.normal(size=dim)
        for c in range(rng.integers(1, 6)):
            rows.append((int(100 * k + c), [float(x) for x in np.float32(base + 0.05 * rng.normal(size=dim))]))
    same = rows[0][1]
    return rows + [(9000, same), (9000, same), (9001, [2 * x for x in same]), (9002, None), (9003, [0.0] * dim), (9004, [math.nan] * dim), (9005, [math.inf] + same[1:]), (9006, [None] + same[1:]), (9007, []), (None, same), (9100, [0.5] * 4)]


def dense(rows, dim):
    out = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v)
        out.append(np.array(list(v) + [0.0] * (dim - len(v))) if ok else None)
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicate_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = some_vectors()
    full = [v if v is not None and v.any() else None for v in dense(rows, 16)]
    n = len(rows)
    near = [[j for j in range(n) if j != i and full[i] is not None and full[j] is not None and full[i] @ full[j] / np.sqrt((full[i] @ full[i]) * (full[j] @ full[j])) >= 0.95] for i in range(n)]
    of = brute.roots(n, [(i, j) for i in range(n) for j in near[i]])
    least = {r: min((rows[i][0] for i in range(n) if of[i] == r and rows[i][0] is not None), default=None) for r in set(of)}
    want = [(rows[i][0], len(near[i]), least[of[i]], rows[i][0] == least[of[i]]) for i in range(n)]
    got = [tuple(r) for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


def unit(rows):
    return rows / np.linalg.norm(rows, axis=-1, keepdims=True)


def around(centre, rng, n, low, high):
    """Unit vectors at a cosine from low to high to the centre, in directions of their own."""
    side = rng.normal(size=(n, len(centre)))
    side = unit(side - (side @ centre)[:, None] * centre)
    cos = rng.uniform(low, high, size=(n, 1))
    return cos * centre + np.sqrt(1 - cos**2) * side


def linked(spark, rows):
    """(n_links, component_id) of each row by the operator and by brute force."""
    rows = np.float32(rows)
    full = unit(rows.astype(float))
    near = full @ full.T >= 0.95
    np.fill_diagonal(near, False)
    of = brute.roots(len(rows), np.argwhere(near).tolist())
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vectors(spark, list(enumerate(rows.tolist())))).collect()}
    return got, {i: (int(near[i].sum()), of[i]) for i in range(len(rows))}


def test_vectors_around_one(spark):
    rng = np.random.default_rng(4)
    centre = unit(rng.normal(size=256))
    got, want = linked(spark, np.concatenate([around(centre, rng, 1_200, 0.951, 0.965), centre[None]]))
    assert want[1_200] == (1_200, 0) and {n for n, _ in want.values()} == {1, 1_200}
    assert got == want


def test_pairs_in_a_dense_topic(spark):
    rng = np.random.default_rng(7)
    topic, rows = unit(rng.normal(size=64)), unit(rng.normal(size=(4_000, 64)))
    rows[:2_000] = unit(math.sqrt(0.85) * topic + math.sqrt(0.15) * unit(rng.normal(size=(2_000, 64))))
    rows[2_000:2_300] = [around(r, rng, 1, 0.95, 0.98)[0] for r in rows[:300]]
    got, want = linked(spark, rows)
    assert sum(n for n, _ in want.values()) >= 600
    assert got == want


def test_near_duplicate_vectors_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rng = np.random.default_rng(8)
    rows = unit(rng.normal(size=(40, 32)))
    rows[20:] = [around(r, rng, 1, 0.951, 0.955)[0] for r in rows[:20]]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "480")
        got, want = linked(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


def test_close_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    rows = unit(rng.normal(size=(300, 8)))
    rows[150:] = around(rows[0], rng, 150, 0.95 - 1e-7, 0.95 + 1e-7)
    want = {(i, j) for i, j in np.argwhere(np.einsum("ik,jk->ij", rows, rows) >= 0.95).tolist() if i < j}
    assert 20 < sum(i == 0 for i, _ in want) < 130
    assert {(int(x), int(y)) for i, j in embedding_dedup.close_pairs(rows, None, 0.95) for x, y in zip(i, j, strict=True)} == want
    two = {(int(x), int(y) + 150) for i, j in embedding_dedup.close_pairs(rows[:150], rows[150:], 0.95) for x, y in zip(i, j, strict=True)}
    assert two == {(i, j) for i, j in want if i < 150 <= j}


@pytest.mark.parametrize("annulus", [1024, 8])
def test_top_k(spark, annulus, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", annulus)
    monkeypatch.setattr(topk, "QUERY_BYTES", annulus * 64)
    rows = some_vectors(2)
    full = dense(rows, 16)
    whole = [None if v is None else [int(math.floor(1024 * float(x))) for x in v] for v in full]
    want = []
    for q in sorted({r[0] for r in rows if r[0] is not None and r[0] % 100 == 0}):
        mine = min((w for (i, _), w in zip(rows, whole, strict=True) if i == q and w is not None), key=lambda w: np.array(w, float).tobytes(), default=None)
        if mine is not None:
            scored = sorted((-sum(a * b for a, b in zip(mine, w, strict=True)), i is None, i or 0) for (i, _), w in zip(rows, whole, strict=True) if w is not None and i != q)
            want += [(q, k, None if none else i, -s) for k, (s, none, i) in enumerate(scored[:10], 1)]
    got = [tuple(r) for r in topk.search(vectors(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert topk.search(vectors(spark, [])).count() == 0
    few = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])]
    assert [tuple(r) for r in topk.search(vectors(spark, few)).orderBy("rank").collect()] == [(0, 1, 1, 3 << 20), (0, 2, 2, 3 << 20)]
    big = [(0, [1e15, 1.0]), (1, [1e15, -1.0])]
    assert topk.search(vectors(spark, big)).collect()[0].score == (1 << 63) - 1


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200, k) for k in range(201, 240)] + [(3, 3)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    of = brute.roots(240, links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: of[x] for x in nodes}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><header><p>Site</p></header><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li><li><a href="/c">c</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies here.</p></div><article><h1>Head  line &amp; more</h1><p><b>First&nbsp;para with words, and more of them in this one.<br><p>Second &quot;para&quot;
over lines that is long enough to matter.</p><div class="ad">Buy now! Great offer</div><p>Third one.</p></article><aside class="sidebar"><p>Related things</p></aside>
<section class="comments"><div class="comment"><p>Nice article, thank you</p></div></section><form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_extraction(spark):
    trees = html_extract.train()
    want = 'Head line & more\nFirst para with words, and more of them in this one.\nSecond "para" over lines that is long enough to matter.\nThird one.'
    assert html_extract.extract_all([PAGE], trees) == [want]
    pages = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "plain < words", "x"), (None, "u", "<p", "x"), (5, "u", "<div>" * 3000 + "deep", "x"), (6, "u", "<article><p>" + "long words, many. " * 20_000, "x")]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string"), trees=trees).collect()
    by = {r.page_id: r for r in got if r.page_id != 3}
    assert len(got) == 7 and by[1].text == want and by[1].n_chars == len(want) and by[2].text == "" and by[None].n_chars == 0 and by[6].n_chars == 18 * 20_000 - 1
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), trees=trees).count() == 0


def test_generated_pages_held_out():
    trees, right, n = html_extract.train(), 0, 0
    for page, main in html_extract.generated(150, seed=77):
        if page.endswith("</html>"):
            n += 1
            right += set(html_extract.extract_all([page], trees)[0].split("\n")) - {""} == {" ".join(m.split()) for m in main}
    assert right >= 0.95 * n


def test_decoding_never_contradicts():
    nodes, events = html_extract.parse("<div><section><p>a</p></section></div><div><p>b</p></div>")
    rng = random.Random(1)
    for _ in range(50):
        score = {id(x): rng.uniform(-3, 3) for x in nodes[1:]}
        left = html_extract.decode(nodes, score)
        assert all(id(x) in left for x in nodes[1:] if id(x.parent) in left)


@pytest.mark.parametrize("n", [3_000, 30_000])
def test_recall_of_passes(n):
    """Pairs at 0.95 to 0.97, in a topic of a third of all rows and outside: met in a window, or both ends known as dense."""
    rng = np.random.default_rng(n)
    rows = unit(rng.normal(size=(n, 64)))
    rows[: n // 3] = unit(math.sqrt(0.8) * unit(rng.normal(size=64)) + math.sqrt(0.2) * unit(rng.normal(size=(n // 3, 64))))
    at = np.r_[0:200, n // 2 : n // 2 + 200]
    full = np.concatenate([rows, [around(rows[i], rng, 1, 0.95, 0.97)[0] for i in at]])
    turns = embedding_dedup.passes_for(len(full), 0.95)
    met, depth = np.zeros(400, bool), []
    for turn in range(turns):
        key = embedding_dedup.keys_of(full, turn)
        order = np.argsort(key, kind="stable")
        rank, own = np.empty(len(full), int), np.empty(len(full))
        rank[order], own[order] = np.arange(len(full)), embedding_dedup.depths(key[order])
        met |= np.abs(rank[at] - rank[n:]) <= embedding_dedup.WINDOW
        depth.append(own)
    missed = (1 - embedding_dedup.same_bit(0.95) ** np.quantile(depth, 0.75, axis=0)) ** turns
    dense = missed > 1 - embedding_dedup.RECALL
    assert (met | (dense[at] & dense[n:])).mean() >= 0.995
    assert dense[n // 3 : n].mean() < 0.05  # only the dense place goes the other way


@pytest.mark.parametrize("kind,most", [("clusters", 0.15), ("one direction", 0.9), ("random", 1.0)])
def test_share_of_rows_that_a_search_multiplies(spark, kind, most):
    rng = np.random.default_rng(3)
    n, dim = 12_000, 64
    if kind == "clusters":
        rows = rng.normal(size=(60, dim))[rng.integers(0, 60, n)] + 0.15 * rng.normal(size=(n, dim))
    elif kind == "random":
        rows = unit(rng.normal(size=(n, dim)))
    else:
        rows = unit(rng.normal(size=dim)) * rng.exponential(size=(n, 1)) + 0.05 * rng.normal(size=(n, dim))
    seen = spark.sparkContext.accumulator(0)
    got = topk.search(vectors(spark, list(enumerate(np.float32(rows).tolist()))), seen=seen).collect()
    full = np.floor(1024 * np.float32(rows).astype(float))
    want = []
    for q in range(0, n, 100):
        score = full @ full[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(n), -score))[:10]
        want += [(q, k, int(i), int(score[i])) for k, i in enumerate(order, 1)]
    assert sorted(tuple(r) for r in got) == want
    share = seen.value / (n * (n // 100))
    print(f"{kind}: {share:.3f} of all pairs")
    assert share <= most


def test_layouts_written_by_hand():
    """Pages of other shapes than the training pages; the whole text must be right."""
    trees = html_extract.train()
    right = {name: html_extract.extract_all([page], trees)[0].split("\n") == want for name, (page, want) in PAGES.items()}
    print(f"{sum(right.values())} of {len(right)} layouts right", right)
    assert all(right.values())


def test_decoding_finds_the_likeliest_choice():
    """Against every choice in which nothing stands in what is left out."""
    import itertools

    nodes, _ = html_extract.parse("<div><p>a</p><section><p>b</p><p>c</p></section></div><p>d</p>")
    inner, rng = nodes[1:], random.Random(4)
    for _ in range(60):
        score = {id(x): rng.uniform(-3, 3) for x in inner}
        best = -math.inf
        for kept in itertools.product([True, False], repeat=len(inner)):
            of = {id(x): k for x, k in zip(inner, kept, strict=True)}
            if all(of[id(x)] <= of.get(id(x.parent), True) for x in inner):
                best = max(best, sum(-math.log1p(math.exp(-score[i] if k else score[i])) for i, k in of.items()))
        left = html_extract.decode(nodes, score)
        assert abs(sum(-math.log1p(math.exp(score[id(x)] if id(x) in left else -score[id(x)])) for x in inner) - best) < 1e-9


def test_operators_from_another_folder(tmp_path):
    """A plain DataFrame, a driver that alone knows where the package lies, another working folder."""
    import os
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "run.py").write_text(f"""
import sys
sys.path.insert(0, {top!r})
from pyspark.sql import SparkSession
from patternlens.llm import html_extract, ngram_join, suffix_dedup, embedding_dedup, topk, common
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x " * 300)], "doc_id long, text string")
print("N", ngram_join.representatives(docs).count(), suffix_dedup.deduplicated(docs).count(), html_extract.extract(spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string")).count())
vecs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
print("V", embedding_dedup.near_duplicates(vecs).count(), topk.search(vecs).count())
common.clear(spark)
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert "N 2 3 1" in done.stdout and "V 5 4" in done.stdout, done.stdout + done.stderr[-3000:]
    assert not list((tmp_path / "shared").rglob("*.parquet"))
