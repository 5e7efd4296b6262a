"""The llm operators against brute force, round trips, and odd rows."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import chat, html, langid, mixing, neardup, packing, registry, sharding, textops, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def docs_of(spark, rows):
    """Rows (doc_id, text, lang, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.5, "x") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and white texts, repeated rows, ties, a long text."""
    rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, "", "en", "a"), (3, None, None, None), (None, "one two three four five six", "de", None), (4, " \t\n ", "de", "b"), (5, "word " * 50_000, "en", "b"), (6, "123 456", None, "b"), (7, "Žluťoučký kůň 中文 it's we'll", "fr", "c")]
    return docs_of(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0).cache()


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


# ---- mixing


def water_fill(sizes: dict, weights=(1, 2, 3), cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(w[s] for s in names if s not in capped)
        lam = (total - cap * sum(sizes[s] for s in capped)) / free if free else 0
        more = {s for s in names if s not in capped and lam * w[s] > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in capped else lam * w[s] for s in names}
        capped |= more


def test_mix_targets_and_bounds(spark, documents):
    extra = docs_of(spark, [(9001, "few words", "en", "zz"), (9002, "and more words here", "en", None)])
    rows = documents.unionByName(extra.select(documents.columns))
    got = mixing.mix_sources(rows).collect()
    sizes: dict = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = water_fill(sizes)
    most = max(r["size"] for r in got)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(want[s])
        assert all(r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= most
    assert all(r.taken <= 3 * r["size"] for r in got)
    told = lambda rs: sorted(map(repr, rs))
    assert None in sizes and told(got) == told(mixing.mix_sources(rows.repartition(7)).collect())


def test_mix_keeps_every_document(spark):
    """Ids beyond 2**53 beside null ids, repeated rows, and columns with the operator's own names lose nothing."""
    rows = [((1 << 60) + i if i else None, "w " * (i % 7 + 1), "en", "ab"[i % 2]) for i in range(402)]
    rows += [(None, "x y", "en", "a")] * 50 + [(5, "hot words again", "en", "c")] * 500
    df = docs_of(spark, rows)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 7
    hot = [r.copies for r in got if r.source == "c"]
    assert max(hot) - min(hot) <= 1
    clash = df.select(*df.columns, *[F.lit(7).alias(c) for c in ("copies", "_size", "_k", "size", "th", "n", "base", "more", "_rank")])
    taken = mixing.apply_mix(clash)
    assert taken.columns == clash.columns
    assert taken.where("copies <> 7 or _k <> 7 or size <> 7").count() == 0
    want: dict = {}
    for r in got:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()} == {i: n for i, n in want.items() if n}


def test_mix_word_count(spark):
    texts = ["a b\tc\nd\x0be\x0cf\rg", "\x1cx\x85y z", None, "  "]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count().alias("n"))
    assert [r.n for r in df.collect()] == [7, 1, 0, 0]


def test_pivotal_keeps_mass():
    rng = np.random.default_rng(1)
    s = rng.integers(1, 100, 200).astype(float)
    p, last = mixing._pivot(list(range(200)), np.full(200, 0.3), s, rng)
    assert (p * s).sum() == pytest.approx(0.3 * s.sum())
    assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != last)


def test_mix_odd_rows(odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count()
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.apply_mix(odd).columns == odd.columns
    assert mixing.apply_mix(odd).count() == sum(r.copies for r in got if r["size"] > 0 or r.copies)
    assert mixing.mix_sources(empty).count() == mixing.apply_mix(empty).count() == 0


# ---- language, toxicity


def test_language_learns(documents):
    model = langid.fit(documents.where(~langid.held_out()))
    got = langid.identify(documents.select("doc_id", "lang", langid.held_out().alias("h"), "text"), model, ["doc_id", "lang", "h"]).where("h").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_steps_are_whole(monkeypatch):
    """500 steps at least, 6 epochs of the four fifths that are trained on: rows drawn in steps, by the generator's calls."""
    drawn = []

    class Counting:
        def __init__(self, seed):
            self.rng = np.random.RandomState(seed)

        def integers(self, low, high, n):
            drawn.append(n)
            return self.rng.randint(low, high, n)

        def __getattr__(self, name):
            return getattr(self.rng, name)

    monkeypatch.setattr(langid.np.random, "default_rng", Counting)
    sample = [("a" if i % 2 else "b", np.array([i % 2, 5]), np.ones(2, np.float32)) for i in range(5000)]
    for n, steps in ((50, 500), (5000, 6 * 4000 // 32)):
        drawn.clear()
        langid.train(sample[:n])
        assert len(drawn) == steps


def test_language_odd_rows(documents, odd, empty):
    model = langid.fit(documents)
    got = {(r.doc_id, r.lang_pred == "und") for r in langid.identify(odd, model, ["doc_id"]).collect()}
    assert {i for i, und in got if und} == {2, 3, 4, 6}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} <= {1, 5, 7, None}
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(odd, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(empty, model, ["doc_id"]).count() == 0


def test_subwords_do_not_cross_documents():
    texts = [b"abc", b"", b"de", b"fghij"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = [sorted(np.concatenate([g[0][textops.doc_of(g[1], offsets) == i] for g in langid.subwords(data, offsets)]).tolist()) for i in range(4)]
    alone = [sorted(np.concatenate([np.zeros(0, np.int64), *[g[0] for g in langid.subwords(np.frombuffer(t, np.uint8), np.array([0, len(t)]))]]).tolist()) for t in texts]
    assert whole == alone


def test_toxicity_learns_a_pair(spark):
    """Neither word tells alone; together they do. An additive model cannot."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(200)}x" for _ in range(8)] + ["klutz"] * a + ["folk"] * b
        rows.append((i, " ".join(words), int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score_toxicity(df, toxicity.fit(df), ["doc_id", "toxic"]).collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.98 * len(got)


def test_toxicity_learns_exclusive_or(spark):
    """Each word alone, and how many there are, tells nothing: only the pair does."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(200)}x" for _ in range(8)] + ["klutz"] * a + ["folk"] * b
        rows.append((i, " ".join(words), int(a != b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id % 3 <> 0"))
    got = toxicity.score_toxicity(df.where("doc_id % 3 = 0"), model, ["doc_id", "toxic"]).collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)


def test_toxicity_scores_by_the_formula(documents, odd):
    """bias + sum of w_i + sum over pairs of v_i.v_j * PAIRS / n, over a document's distinct known terms, one by one."""
    labels = documents.select("doc_id", F.col("text").contains("e").cast("int").alias("toxic"), "text").limit(150)
    model = toxicity.fit(labels.withColumn("toxic", (F.col("doc_id") % 3 == 0).cast("int")))
    place = {int(t): i for i, t in enumerate(model["terms"])}

    def plainly(text):
        words = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (text or "")).encode().lower().split()
        has = set()
        for w in words:
            for n in (None, *toxicity.PREFIXES):
                if n is None or len(w) > n:
                    raw = np.frombuffer(w[:n] if n else w, np.uint8)
                    h = textops.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
                    h = int(h) ^ (n * 0x9E3779B97F4A7C15 & (1 << 64) - 1 if n else 0)
                    has.add(h >> 64 - toxicity.BITS)
        at = sorted(place[t] for t in has if t in place)
        z = model["bias"] + sum(model["w"][i] for i in at)
        pairs = sum(float(model["v"][i] @ model["v"][j]) for i, j in itertools.combinations(at, 2))
        z += toxicity.PAIRS * pairs / len(at) if at else 0
        return 1 / (1 + np.exp(-min(30, max(-30, z))))

    rows = documents.select("doc_id", "text").limit(25).collect() + [r for r in odd.select("doc_id", "text").collect() if len(r.text or "") < 1000]
    got = toxicity.score_toxicity(odd.sparkSession.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "i long, text string"), model, ["i"])
    for r in got.collect():
        assert r.score == pytest.approx(plainly(rows[r.i].text), rel=1e-6)


def test_toxicity_odd_rows(odd, empty):
    model = toxicity.fit_on_labels(odd, odd.select("doc_id", F.lit(0).alias("toxic")))
    got = toxicity.score_toxicity(odd, model, ["doc_id"]).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.keep_clean(empty, toxicity.fit(empty.withColumn("toxic", F.lit(1)))).count() == 0


# ---- vectors


def links_by_force(vs, t):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vs]
    unit = [np.array(v, np.float64) / np.linalg.norm(v) if o else None for v, o in zip(vs, ok, strict=True)]
    return [(i, j) for i, j in itertools.combinations(range(len(vs)), 2) if ok[i] and ok[j] and len(vs[i]) == len(vs[j]) and unit[i] @ unit[j] >= t]


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_links(spark, monkeypatch, block):
    """Also with so small blocks that buckets have pivots and components have cores."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    near = base[:60] + 0.08 * rng.normal(size=(60, 16))
    hub = base[0] + 0.05 * rng.normal(size=(60, 16))
    vs: list = [list(map(float, v)) for v in [*base, *near, *hub]] + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [1.0] * 8, [2.0] * 8, list(map(float, base[5])), list(map(float, base[5]))]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vs)], "vec_id long, embedding array<double>, kept string")
    pairs = links_by_force(vs, 0.9)
    low = list(range(len(vs)))
    for _ in vs:
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    n = [sum(i in p for p in pairs) for i in range(len(vs))]
    got = {r.vec_id: r for r in vectors.near_duplicate_vectors(df).collect()}
    assert [got[i].n_links for i in range(len(vs))] == n
    assert [got[i].component_id for i in range(len(vs))] == low
    assert all(got[i].kept == (low[i] == i) for i in got)
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_that_repeat_an_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.001, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_cores_are_linked_throughout(spark, monkeypatch):
    """Cores hold most of a group of near vectors, whatever member comes first, and only vectors that are all linked."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=32)
    vs = np.vstack([centre + 1.0 * rng.normal(size=(3, 32)), centre + 0.15 * rng.normal(size=(200, 32))])
    rows = [(i, 1, [float(x) for x in v], 0, 32) for i, v in enumerate(vs)]
    members = spark.createDataFrame(rows, "id long, n long, embedding array<double>, component long, dim int")
    core = vectors._cores(members, 0.9, 50).collect()
    ids = [r.id for r in core]
    unit = vs / np.linalg.norm(vs, axis=1)[:, None]
    assert len(ids) > 150 and (unit[ids] @ unit[ids].T >= 0.9).all()
    assert {(r.low, r.total) for r in core} == {(min(ids), len(ids))}
    assert vectors._cores(members, 0.9, 300) is None


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12)) * rng.choice([0.1, 1, 5], (400, 1))
    x[50:90] = x[0] + 0.01 * rng.normal(size=(40, 12))
    vs: list = [list(map(float, v)) for v in x] + [None, [float("inf")] * 12, [1.0] * 5, list(map(float, x[3]))]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vs)], "vec_id long, embedding array<double>, score int")
    q = np.floor(1024 * x).astype(np.int64)
    all_q = np.vstack([q, q[3]])
    ids = [*range(400), 403]
    want = set()
    for i in range(0, 400, 25):
        best = sorted((-int(all_q[i] @ all_q[j]), ids[j]) for j in range(len(ids)) if j != i)[:10]
        want |= {(i, r + 1, v, -s) for r, (s, v) in enumerate(best)}
    got = {tuple(r) for r in vectors.exact_top_k(df, F.col("vec_id") % 25 == 0).collect()}
    assert {g for g in got if g[0] < 400} == want
    assert vectors.exact_top_k(df.limit(0), F.col("vec_id") % 25 == 0).count() == 0


def test_top_k_of_huge_components(spark):
    vs = [(100, [1e300, 1.0]), (1, [2e300, 1.0]), (2, [1e300, 5.0]), (3, [-1e300, 2.0]), (4, [1.0, 1.0])]
    got = vectors.exact_top_k(spark.createDataFrame(vs, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, 2**63 - 1), (4, 2**63 - 1), (3, -(2**63))]


@pytest.mark.parametrize("dim", [64, 384])
@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_recall_at_the_threshold(dim, k):
    """Isolated pairs at cosine 0.9 share a bucket, or one's bucket is the other's probe, whatever the number of rotations."""
    rng = np.random.default_rng(dim + k)
    x = rng.normal(size=(300, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1)[:, None]
    tables = next(t for c in range(40) for kk, t in [vectors.table_shape(2**c)] if kk == k)
    a, pa_ = vectors.cross_polytope(x, tables, k)
    b, pb = vectors.cross_polytope(y, tables, k)
    pa_, pb = pa_.reshape(len(x), tables, k), pb.reshape(len(x), tables, k)
    met = (a == b) | (pa_ == b[:, :, None]).any(2) | (pb == a[:, :, None]).any(2)
    assert met.any(1).mean() >= 0.9


# ---- chat


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "", "a\nb</turn>\n### user\n", "\\b\\h\\l<#\\", "é\U0001f600", None]
    rows = [(c, t, r, said[(c + t) % 6], "x") for c in range(6) for t, r in enumerate(("system", "user", "assistant", "assistant"))] + [(None, None, None, None, "x"), (7, 0, "we\nird#", "t", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chat(chat.canonical_turns(df)).select("conv_id", chat.read_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in out.collect()}
    want: dict = {}
    for c, _, r, t, _ in rows:
        want.setdefault(c, []).append((r or "", t or ""))
    assert got == {c: (ts, "".join(t for r, t in ts if r == "assistant")) for c, ts in want.items()}
    assert chat.canonical_turns(df.limit(0)).count() == 0


def test_layouts(spark):
    asked = {
        "id long, messages array<struct<role:string,content:string>>": [(1, [("user", "q"), ("assistant", "a")])],
        "id long, conversations array<struct<from:string,value:string>>, extra int": [(1, [("human", "q"), ("gpt", "a")], 5)],
        "id long, instruction string, output string": [(1, "q", "a")],
        "id long, prompt string, completion string": [(1, "q", "a")],
        "id long, question string, answer string": [(1, "q", "a")],
    }
    for shape, rows in asked.items():
        got = chat.canonical_turns(spark.createDataFrame(rows, shape), "id").first()
        assert [tuple(t) for t in got.turns] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "id long, other string"), "id")


def test_json_layouts(spark):
    rows = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"prompt":"q","response":"a"}', '{"instruction":"q","input":"","output":"a","id":3}', '{"other":1}', "no json", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "conv_id long, rec string")
    got = {r.conv_id: r for r in chat.canonical_json_turns(df, "rec").collect()}
    assert [got[i].layout for i in range(6)] == ["messages", "prompt_response", "instruction_input", None, None, None]
    assert all([tuple(t) for t in got[i].turns] == [("user", "q"), ("assistant", "a")] for i in range(3))
    assert got[3].turns is None


# ---- pages


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<nav>m</nav><article><h1>T &amp; t</h1><p>a<br>b<p>c &lt;i&gt;</article><footer>f</footer>", "T & t\n\na b\n\nc <i>"),
        ("<article><p><b>x<br><p>y</article>", "x\n\ny"),
        ("<main><div class='cookie-banner'>c</div><p>a</p><form>f</form><section id=comments><p>z</p></section></main>", "a"),
        ("<article><script>var a='</p>';</script><style>p{}</style><p>q<!-- no -->r</p>", "qr"),
        ("<body class='has-sidebar'><aside>s</aside><article><header><h1>h</h1>by</header><p>p</p><div role=navigation>n</div></article>", "h\n\np"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p title=it's>Hello there</p><p>It isn't lost</p></article>", "Hello there\n\nIt isn't lost"),
        ("<article><p ' x>a</p><p class=\"a>b\">b</p><p data-x='>'>c</p><p \">d</p></article>", "a\n\nb\n\nc\n\nd"),
        ("<article><p title=\"never closed>a</p><p>b</p></article>", "a\n\nb"),
        ("<article><ul><li>1<li>2</ul><p hidden>h</p><p>\n a \t b\n</p></article>", "1\n\n2\n\na b"),
        ("", ""),
    ],
)
def test_article_text(spark, page, want):
    found = html.blocks(page)
    best = max((k for k, _ in found), default=0)
    assert "\n\n".join(t for k, t in found if k == best and k > 1) == want


def test_repeated_passages_go(spark):
    """Pages without an article: what a host's pages share goes, unique runs stay, copies of a page do not erase each other."""
    same = "this site uses many small cakes and you agree to every one of them"
    own = {i: " ".join(f"u{i}w{j}" for j in range(30)) for i in range(4)}
    rows = [(i, "http://h.example/%d" % i, f"<div>{same}</div><div>{own[i]}</div><div>tiny {i}</div>") for i in range(4)]
    rows += [(4, "http://h.example/copy", rows[0][2]), (5, "http://other.example/", f"<div>{same}</div>"), (6, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(df, ["page_id"]).collect()}
    assert got == {**{i: f"{own[i]}\n\ntiny {i}" for i in range(4)}, 4: f"{own[0]}\n\ntiny 0", 5: same, 6: ""}
    assert html.main_text(df.limit(0), ["page_id"]).count() == 0


def test_quotes_and_near_copies_stay(spark):
    """Pages without an article: copies that differ in an advert or date and a passage that few pages quote keep their text."""
    menu = " ".join(f"menu{j}" for j in range(12))
    own = {i: " ".join(f"u{i}w{j}" for j in range(90)) for i in range(9)}
    quote = " ".join(f"q{j}" for j in range(60))
    page = lambda i, ad, *more: f"<div>{menu}</div><div class=ad>{ad}</div>" + "".join(f"<div>{t}</div>" for t in more)
    texts = {i: [own[i], f"day {i}"] for i in range(6)}
    texts[1].insert(1, quote)
    texts[2].insert(1, quote)
    copies = {10 + i: [own[7], f"printed on day {i}"] for i in range(8)}
    rows = [(i, f"http://h.example/{i}", page(i, f"buy number {i} of these very good cakes today", *t)) for i, t in (texts | copies).items()]
    # two hosts of copies alone: of a host's only article with other adverts, and without any
    alone = {20 + i: [own[8], f"day {i}"] for i in range(4)}
    rows += [(i, "http://one.example/", page(i, f"advert {i}", *t)) for i, t in alone.items()]
    pair = {30 + i: [own[6], " ".join(f"unmarked{i}ad{j}" for j in range(9))] for i in range(2)}
    rows += [(i, "http://two.example/", "".join(f"<div>{t}</div>" for t in ts)) for i, ts in pair.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(df, ["page_id"]).collect()}
    want = {i: "\n\n".join(t) for i, t in (texts | copies | pair).items()} | {i: "\n\n".join([menu, *t]) for i, t in alone.items()}
    assert got == want


# ---- sharding


def test_shards(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, f"group {rng.randrange(60)}" if i % 3 else f"single {i}", "en", "s") for i in range(900)] + [(2000 + i, "hot", "en", "s") for i in range(450)]
    got = sharding.shard_documents(docs_of(spark, rows)).collect()
    held: dict = {}
    for r in got:
        held.setdefault(r.shard, []).append(r.slot)
    assert set(held) == set(range(8)) and max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    text = {i: t for i, t, _, _ in rows}
    spread: dict = {}
    for r in got:
        spread.setdefault(text[r.doc_id], set()).add(r.shard)
    cut = [t for t, v in spread.items() if len(v) > 1 and t != "hot"]
    assert len(cut) <= 7  # one a bound at most; at random, about all of 60
    assert all(r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    again = sharding.shard_documents(odd).collect()
    assert len(again) == odd.count() and max(r.shard for r in again) <= 7
    assert sharding.shard_documents(empty).count() == 0


# ---- packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_tokenizer_is_exact(tokenizer):
    t, rng = packing.WordTokenizer(tokenizer), random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "!", "'", "'s", "-", "Ā", "ß", " the", "\r\n", "\x0b", "\x1c", "\x85", "²", "　", "中", "😀", "'ll", "_", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)] + ["", "x" * 500, " " * 300]
    assert [x.tolist() for x in t.encode(texts)] == [t.whole(x).tolist() if x else [] for x in texts]


def packed_well(docs, got, tokenizer, length=2048):
    t = packing.WordTokenizer(tokenizer)
    want: dict = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(np.r_[t.whole(r.text or ""), np.uint16(1)].astype("<u4"))
    seqs: dict = {}
    for p in got:
        assert any(len(w) == p.doc_tokens and zlib.crc32(w[p.start : p.start + p.length]) == p.ids_crc32 for w in want[p.doc_id])
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, v in seqs.items():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == length or i == max(seqs)
    assert sum(p.length for p in got) == sum(len(w) for ws in want.values() for w in ws)


def test_packing(documents, odd, empty, tokenizer):
    packed_well(documents, packing.pack(documents, tokenizer).collect(), tokenizer)
    packed_well(odd, packing.pack(odd, tokenizer, window=4096).collect(), tokenizer)
    assert packing.pack(empty, tokenizer).count() == 0


def test_packing_of_many_sources(spark, tokenizer):
    """5,000 sources with weights of their own: every token once, and each window within a token of every source's share."""
    rows = [(2 * i + j, "word " * (3 + i % 5), "en", f"s{i}") for i in range(5000) for j in range(2)]
    df = docs_of(spark, rows)
    weights = {f"s{i}": 1.0 + i % 3 for i in range(5000)}
    got = packing.pack(df, tokenizer, weights=weights, window=65_536).collect()
    packed_well(df, got, tokenizer)
    source = {i: s for i, _, _, s in rows}
    totals, first = {}, {}
    for p in got:
        totals[source[p.doc_id]] = totals.get(source[p.doc_id], 0) + p.length
    names = sorted(totals)
    r = packing.Rounds([totals[s] for s in names], 65_536, [weights[s] for s in names])
    want = r.served(1)[0]
    for p in got:
        if p.sequence_id * 2048 + p.offset < want.sum():  # the first window: fractions of tokens are carried to the next
            first[source[p.doc_id]] = first.get(source[p.doc_id], 0) + p.length
    assert [first.get(s, 0) for s in names] == pytest.approx(want.tolist(), abs=1)
    assert want.sum() > 65_536 - 5000
    shares = {s: first.get(s, 0) / weights[s] for s in names if first.get(s, 0) < totals[s]}
    assert max(shares.values()) - min(shares.values()) <= 1


def test_long_texts_are_cut_without_a_trace(tokenizer, monkeypatch):
    t, rng = packing.WordTokenizer(tokenizer), random.Random(2)
    parts = ["a", " ", "  ", "\n", " \n", "it's", "1", "!", "é", "中", "x" * 9, " \t "]
    texts = ["".join(rng.choices(parts, k=400)) for _ in range(60)] + ["".join(rng.choices(parts[:8], k=400)) for _ in range(60)] + ["y" * 900]
    want = [t.whole(x).tolist() for x in texts]
    monkeypatch.setattr(packing, "PIECE", 50)
    assert [x.tolist() for x in t.encode(texts)] == want


def test_rounds_keep_proportions():
    for weights in (None, [1.0, 5.0, 2.0]):
        r = packing.Rounds([10_000, 3_000, 500], 1000, weights)
        seen = np.zeros(13_500, int)
        for q, n in enumerate([10_000, 3_000, 500]):
            for a in range(0, n, 77):
                for start, size, place in r.pieces(q, a, min(77, n - a)):
                    seen[place : place + size] += 1
                    assert start + size <= 77
        assert (seen == 1).all()
        early = r.served(1)[0]
        share = np.array(weights or [10_000, 3_000, 500]) / sum(weights or [10_000, 3_000, 500])
        assert np.abs(early - np.minimum(1000 * share, [10_000, 3_000, 500])).max() <= (1 if weights is None else 200)


# ---- near duplicates


def groups_by_force(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}
    pairs = [(i, j) for i, j in itertools.combinations(sorted(sets), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in range(8):
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    return {i: (len(sets[i]), low[i]) for i in sets}


def test_near_duplicates(spark, documents):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = [(r.doc_id, r.text) for r in documents.limit(80).collect()]
    for g in range(12):
        base = rng.choices(words, k=120)
        for k in range(8):
            w = list(base)
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(99)
            rows.append((1000 + 10 * g + k, " ".join(w)))
    rows += [(5000, "A b C"), (5001, "a B c"), (5002, "a b d"), (5003, ""), (5004, None), (5005, " \n"), (5006, "é É")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept int")
    for percent in (85, 80):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, percent).collect()}
        assert got == groups_by_force(rows, percent)


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Chains, near copies and half-like texts in components and buckets beyond every block: the same as all pairs."""
    r = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(3000)])
    texts = []
    for g, edits in enumerate([1, 4, 3, 6]):
        base = list(r.choice(words, 400))
        now = base[:]
        for i in range(45):
            t = (base if g < 2 else now)[:]
            for _ in range(edits):
                t[int(r.integers(len(t)))] = f"x{g}-{i}"
            if g == 3 and i % 3 == 0:
                t = t[: 400 - 2 * i]
            now = t
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    low = list(range(len(texts)))
    find = lambda i: i if low[i] == i else find(low[i])
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(texts))}
    assert 4 < len(set(want.values())) < len(texts) - 50
    for block in (neardup.BLOCK, 80, 16):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert {x.doc_id: x.component_id for x in neardup.near_duplicates(df, 85).collect()} == want


def test_near_duplicates_odd_rows(odd, empty):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r.kept for r in got)
    stay = neardup.drop_near_duplicates(odd)
    assert stay.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in stay.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert neardup.near_duplicates(empty).count() == neardup.drop_near_duplicates(empty).count() == 0


# ---- SQL, pipeline


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for t in ("conversations", "documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, data)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, want.select(*[f'"{x}"' for x in cols]).fetchall())) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def test_pipeline_stages(spark, data, documents):
    import corpus_pipeline as p

    docs, counts = documents, [documents.count()]
    for i, (_, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, data).cache()
        counts.append(docs.count())
        if i < len(p.STAGES) - 1:
            assert docs.columns == documents.columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    ends = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.where("start = 0").collect())
    whole = p.run(spark, data)
    assert ends(whole) == ends(docs)
    assert whole.agg(F.sum("length")).first()[0] == sum(n for _, n in ends(docs))


def test_pipeline_keeps_and_drops(spark, tmp_path):
    """Brute force for the first three stages: insults go, documents without letters go, one of each group of copies stays."""
    import corpus_pipeline as p

    rng = random.Random(6)
    kinds = {"en": "the of and to in that is was for on".split(), "de": "der die und das nicht ist von den mit sich".split()}
    rows, labels = [], []
    for i in range(600):
        lang = ("en", "de")[i % 2]
        words = [rng.choice(kinds[lang]) + rng.choice("abcdefgh") for _ in range(60)]
        toxic = i % 10 == 3
        if toxic:
            words[rng.randrange(60)] = "insultum"
        rows.append((i, " ".join(words), lang, f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(700, "12345 678", "en", "s0", 0), (701, "", "de", "s0", 0)]
    rows += [(800 + k, rows[20][1] + (" extra" if k == 2 else ""), "en", "s1", 0) for k in range(3)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in p.STAGES[:3]:
        docs = stage(spark, docs, d)
    assert {r.doc_id for r in docs.collect()} == {i for i in range(600) if i % 10 != 3}
