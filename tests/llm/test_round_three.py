"""Whitening, language identification and periodic runs: brute force, held-out accuracy, edge tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from blockloom.llm import language_id, periodic_runs, queries, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, runs string, collapsed int, score double, rejected string"
LONG = "lorem ipsum dolor sit " * 20_000 + "end"
EDGE = [(1, None, "en"), (2, "", None), (3, "one", "en"), (4, "one", "de"), (4, "one", "de"), (None, "a b " * 9, "fr"), (None, None, None), (7, LONG, "en"), (8, "1234 5678 --", "en"), (9, "x\x1cy z " * 8, None), (20, "\t\n ", "en")]


def folder(spark, path, rows):
    data = [(i, t, lang, "s", len(t or ""), "r", 1, 0.5, "no") for i, t, lang in rows]
    spark.createDataFrame(data, DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_row(i, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(b"" if i is None else str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hexed(lines), hexed(" ".join(x for k, x in enumerate(w) if k not in gone)))


def periodic(r):
    w = [r.choice("abcdefghijklmnop"[: r.choice([1, 2, 4, 16])]) for _ in range(r.choice([0, 1, 5, 6, 7, 8, 9, 30, 90, 200]))]
    for _ in range(r.randrange(4)):
        if len(w) > 10:
            a, p = r.randrange(len(w)), r.randrange(1, 1 + len(w) // 4)
            for k in range(a, min(len(w), a + r.randrange(1, len(w)))):
                w[k] = w[a + (k - a) % p]
    return w


def test_cover_has_all_differences():
    for v in (8, 32, 57):
        residues, number, ahead = periodic_runs.cover(v)
        assert {(a - b) % v for a in residues.tolist() for b in residues.tolist()} == set(range(v)) and len(residues) < 2.5 * math.sqrt(v)
        assert all(number[(i + ahead[i, d]) % v] >= 0 and number[(i + d + ahead[i, d]) % v] >= 0 for i in range(v) for d in range(v))


def test_extensions_against_comparison():
    r = random.Random(2)
    for v in (8, 32):
        for _ in range(20):
            x = np.array([r.randrange(r.choice([1, 2, 9])) for _ in range(r.choice([2, 31, 200, 700]))] + [99])
            i = np.array([r.randrange(len(x) - 1) for _ in range(300)])
            j = np.array([r.choice([k for k in (0, len(x) // 2, len(x) - 1) if k != a]) for a in i.tolist()])
            want = [next(k for k in range(len(x) + 1) if max(a, b) + k >= len(x) or x[a + k] != x[b + k]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
            assert periodic_runs.Extensions(x, v).of(i, j).tolist() == want


def test_runs_against_brute_force():
    r = random.Random(3)
    for block in (1, 9, 1 << 20):
        for _ in range(60):
            texts = [np.array([ord(c) for c in periodic(r)], np.int64) for _ in range(r.choice([1, 3, 8]))]
            assert [[tuple(x) for x in g.tolist()] for g in periodic_runs.runs_of(texts, block)] == [brute_runs(t.tolist()) for t in texts]
    assert periodic_runs.runs_of([]) == [] and periodic_runs.runs_of([np.zeros(70_000, np.int64)])[0].tolist() == [[0, 70_000, 1]]


def test_periodic_runs_query_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    gaps = [" ", "\n", "  ", "\t\x0b", "\r\n"]
    rows = [(i, "".join(w + r.choice(gaps) for w in periodic(r)), "en") for i in range(400)]
    rows += [(1000 + i, t, lang) for i, (_, t, lang) in enumerate(EDGE) if t != LONG] + EDGE[:7] + [(7, "p q r s " * 40 + "end", "en")] * 2 + EDGE[8:]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t, _ in rows if t) > 20
    got = [tuple(x) for x in queries.op13_periodic_runs(spark, folder(spark, tmp_path, rows)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    assert sorted(got, key=key) == sorted((brute_row(i, t) for i, t, _ in rows), key=key)


@pytest.mark.parametrize("rows", [EDGE, []], ids=["edge", "empty"])
def test_edges_of_texts(spark, tmp_path, rows):
    sf = folder(spark, tmp_path, rows)
    langs = [tuple(x) for x in queries.op12_language_id(spark, sf).select("doc_id", "lang_pred", "score").collect()]
    assert len(langs) == len(rows) and all(0 <= s <= 1 for *_, s in langs)
    for i, t, _ in rows:
        mine = [(p, s) for d, p, s in langs if d == i]
        if t is None or not any(c.isalpha() for c in t):
            assert ("und", 0.0) in mine
        else:
            assert {p for p, s in mine} & {"en", "de", "fr"}
    runs = {x.doc_id: x for x in queries.op13_periodic_runs(spark, sf).collect()}
    assert not rows or (runs[7].n_runs, runs[7].start, runs[7].length, runs[7].period) == (1, 0, 80_000, 4)


def test_find_runs_gives_texts(spark):
    df = spark.createDataFrame([(1, "say it " * 5 + "now", 8), (2, None, 9)], "start int, text string, period int")
    got = {x.start: x for x in periodic_runs.find_runs(df, keep=("start", "period")).collect()}
    assert (got[1].runs, got[1].collapsed, got[1].period) == ([(0, 10, 2)], "say it now", 8) and (got[2].runs, got[2].collapsed) == ([], "")


def eigen(x):
    v = np.cov(x, rowvar=False, bias=True)
    values, q = np.linalg.eigh(v)
    return values[::-1], q[:, ::-1], np.trace(v)


@pytest.mark.parametrize("kind", ["plain", "repeated", "flat", "one", "two", "far"])
def test_leading_against_eigh(kind):
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    values = {"plain": np.arange(40.0), "repeated": np.repeat([9.0, 5, 5, 1], 10), "flat": np.ones(40), "far": 10.0 ** np.arange(-30, 10)}.get(kind)
    a = (q * values) @ q.T if values is not None else np.array([[3.0]]) if kind == "one" else np.array([[2.0, 1], [1, 2]])
    a = (a + a.T) / 2
    k = min(8, len(a))
    e, u = whitening.leading(a, k)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1][:k], rtol=1e-11, atol=1e-13 * np.abs(a).max())
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12 and np.abs(a @ u - u * e).max() < 1e-12 * np.abs(a).max() * len(a)


def embeddings(spark, path, rows, kind="float"):
    spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int, n string, whitened string").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_whitening_query_against_eigh(spark, tmp_path):
    rng = np.random.default_rng(7)
    base = (rng.standard_normal((500, 12)) * np.linspace(0.1, 2, 12)).astype(np.float32)
    vectors = [*base.tolist(), base[0].tolist(), base[0].tolist(), None, [], [0.0] * 12, [1.0, None] + [0.0] * 10, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1.0, 2.0]]
    got = queries.op11_embedding_whitening(spark, embeddings(spark, tmp_path, [(i, v, 1, "x", "y") for i, v in enumerate(vectors)])).collect()
    used = {i: v for i, v in enumerate(vectors) if v is not None and len(v) == 12 and all(c is not None and math.isfinite(c) for c in v)}
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in used.values()])
    n, sums = len(x), x.sum(axis=0)
    values, q, trace = eigen(x)
    assert sorted((r.vec_id, r.component) for r in got) == [(i, k) for i in used for k in range(1, 9)]
    place = {i: k for k, i in enumerate(used)}
    for c in range(8):
        mine = sorted((r for r in got if r.component == c + 1), key=lambda r: r.vec_id)
        w = np.array([r.whitened for r in mine])
        want = ((x - sums / n) @ q[:, c]) / math.sqrt(values[c])
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-8 and abs(mine[0].explained - values[c] / trace) < 1e-12
    for r in got:
        assert (r.n, r.deviation) == (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[place[r.vec_id]], sums, strict=True))) and r.identity_error < 1e-10


@pytest.mark.parametrize("vectors", [[], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[0.0, 1.0], [0.0, 3.0]], [[1e300, -1e300], [0.0, 5.0], [7.0, 0.0]]], ids=["empty", "unusable", "one", "equal", "line", "far"])
def test_whitening_edges(spark, tmp_path, vectors):
    got = queries.op11_embedding_whitening(spark, embeddings(spark, tmp_path, [(i, v, 1, "x", "y") for i, v in enumerate(vectors)], "double")).collect()
    rank = {2: 1, 3: 1 if vectors[:1] != [[1.0, 2.0]] else 0}.get(len(vectors), 0) if vectors[:1] != [None] else 0
    assert len(got) == rank * len(vectors) and all(r.identity_error < 1e-6 for r in got)
    if len(vectors) == 3 and rank:
        assert [r.deviation for r in got if r.vec_id == 0] == [None]


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.99 and held.score.between(0, 1).all()
    assert abs(held.score.mean() - (held.lang == held.lang_pred).mean()) < 0.05  # calibrated


def test_rejection_and_repeatability():
    rng = np.random.default_rng(8)
    texts = [("abc" if k % 2 else "xyz", k % 2) for k in range(60)]
    texts = [(" ".join("".join(rng.permutation(list(a))) for _ in range(20)), y) for a, y in texts] + [("qqq qqq", k % 2) for k in range(20)]
    rows = []
    for t, _ in texts:
        s = language_id.shares(t)
        rows.append((np.flatnonzero(s), s[s > 0]))
    y = np.array([k for _, k in texts])
    one, two = (language_id.train(rows, y, ["a", "b"]) for _ in range(2))
    assert (one.weight == two.weight).all() and one.threshold == two.threshold
    p = one.probabilities(np.stack([language_id.shares(t) for t in ("abc cab", "xyz zyx", "qqq")])).max(axis=1)
    assert p[0] >= one.threshold and p[1] >= one.threshold and p[2] < one.threshold


def test_subwords_against_plain():
    for text in ["Aé b", "", None, "one, two3three", "日本 x"]:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        want = sum(1 for w in words for n in range(1, 5) for s in range(len(w) + 3 - n) if (n > 1 or 0 < s <= len(w)))
        assert len(language_id.subwords(text)) == want, text


def test_lm_score_of_many_shares(spark, monkeypatch):
    """Shares learnt apart keep most of what one learns; splits and partitions don't matter."""
    from blockloom.llm import lm_score
    from blockloom.llm.common import id_crc

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", (id_crc() % 10 == 0).alias("held_out"), "text")

    def run(share, table=docs):
        monkeypatch.setattr(lm_score, "SHARE_TOKENS", share)
        got = lm_score.score_texts(table, ~table.held_out, keep=("doc_id", "held_out")).toPandas().sort_values("doc_id")
        held = got[got.held_out]
        return got, (held.score - held.base_score).sum() / math.log10(2) / held.n_tokens.sum()

    one, gain = run(4_000_000)
    five, of_five = run(5_600)
    assert gain > 0.6 and of_five > 0.7 * gain, (gain, of_five)
    again, _ = run(5_600, docs.repartition(7, "text"))
    assert np.allclose(five.score, again.score, rtol=1e-6)
    assert run(1_200)[1] > 0.7 * gain  # 19 shares


def test_noise_follows_the_shares():
    from blockloom.llm import lm_score

    v = lm_score.vocabulary([(f"t{k}".encode(), 5000 // (k + 1) + 1) for k in range(lm_score.WIDTH + 40)], {})
    trainer = lm_score.Trainer(lm_score.LogBilinear.start(v), v, 0.1, 1, k_token=1)
    for cls, size in ((0, lm_score.WIDTH), (1, 40)):
        drawn = np.bincount(trainer._noise(np.full(200_000, cls))[:, 0], minlength=v.own) / 200_000
        want = np.where(v.class_of(np.arange(v.own)) == cls, v.share, 0)
        assert (drawn[want == 0] == 0).all() and np.abs(drawn - want).max() < 0.005 and (want > 0).sum() == size


def test_toxicity_against_plain_counts(spark):
    """Counts, ratios, chi-squares (ties among them), the optimum and scores, from strings of n-grams."""
    from blockloom.llm import toxicity

    r = random.Random(9)
    texts = [(i, " ".join(r.choices(["vile", "foul", "good", "day", "é"], [3, 3, 1, 1, 1] if i % 3 == 0 else [0.3, 0.3, 3, 3, 1], k=12)), int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in texts] + [(99, "not labelled vile", "x"), (None, None, "x")], "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(0, 0), (1, None), (500, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, features=40)

    def grams(t):
        c = f" {t.lower()} "
        return {c[k : k + n] for n in toxicity.SIZES for k in range(len(c) - n + 1)}

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * int(toxicity._MULTIPLIER) + ord(c) + 1) % (1 << 64)
        return ((h ^ (h >> 29)) * int(toxicity._MIX)) % (1 << 64) >> (64 - toxicity.BITS)

    of = {i: {bucket(g) for g in grams(t)} for i, t, _ in texts}
    p, q = 20, 40
    a = {b: sum(b in of[i] for i, _, y in texts if y) for b in set().union(*of.values())}
    n = {b: sum(b in of[i] for i, _, y in texts if not y) for b in a}
    chi = {b: (a[b] * (q - n[b]) - n[b] * (p - a[b])) ** 2 / ((a[b] + n[b]) * (p + q - a[b] - n[b] + 1e-9)) for b in a}
    best = sorted(a, key=lambda b: (-chi[b], b))[:40]
    assert len({chi[b] for b in a}) < len(a) and model.bucket.tolist() == best
    ratio = np.array([math.log((a[b] + 1) / (p + 2)) - math.log((n[b] + 1) / (q + 2)) for b in best])
    x, y = np.array([[b in of[i] for b in best] for i, _, _ in texts], float), np.array([y for *_, y in texts])
    z = model.bias + x @ model.coefficient
    gap = (1 / (1 + np.exp(-z)) - y) / len(y)
    weight = model.coefficient / ratio
    assert np.abs((gap @ x) * ratio + 1e-3 * weight).max() < 5e-3 and abs(gap.sum()) < 5e-3  # near the optimum
    got = {s.doc_id: s for s in toxicity.score(docs, model, keep=("doc_id",)).collect()}
    assert all(math.isclose(got[i].score, 1 / (1 + math.exp(-v)), rel_tol=1e-9) and got[i].predicted == int(got[i].score >= 0.3) for (i, *_), v in zip(texts, z, strict=True))
    assert math.isclose(got[None].score, 1 / (1 + math.exp(-model.bias))) and len(got) == 62


def test_pieces_of_columns_by_any_name(spark):
    from blockloom.llm import packing

    rows = [(k, f"w{k} " * (k % 7), k, "a") for k in range(40)]
    df = spark.createDataFrame(rows, "left_over bigint, text string, ids int, __group string")
    got = packing.pack_documents(df, "text", queries.vocabulary("byte_bpe_50k.json"), keep=("left_over", "ids", "__group")).collect()
    assert {(r.left_over, r.ids, r["__group"]) for r in got} == {(k, k, "a") for k in range(40)}


@pytest.mark.parametrize("rows", [[], [(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (4, [2.0, 4.0], 1), (5, [1.0, 2.0], None), (5, None, 1)]], ids=["empty", "nulls"])
def test_embedding_edges(spark, tmp_path, rows):
    data = [(i, v, label, 7, "x") for i, v, label in rows]
    spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int, node int, links string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op3_embedding_dedup(spark, str(tmp_path)).collect()
    links = sorted((r.vec_id is not None, r.vec_id or 0, r.n_links, r.component_id) for r in got)
    want = [(False, 0, 3, 3), (False, 0, 3, 3), (True, 3, 3, 3), (True, 4, 3, 3), (True, 5, 0, 5), (True, 5, 0, 5)] if rows else []
    assert links == want


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (2, ""), (3, "http://a.net"), (3, "http://a.net"), (4, "http://x.org/fr/" + "a/" * 50_000), (5, "no scheme"), (None, "HTTP://B.COM/?q")]], ids=["empty", "edges"])
def test_url_edges(spark, tmp_path, rows):
    spark.createDataFrame([(i, u, "h", "net/", 1) for i, u in rows], "page_id bigint, url string, html string, rule string, verdict int").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id or 0, r.host, len(r.path), r.rule, r.verdict) for r in queries.op7_url_filter(spark, str(tmp_path)).collect()), key=str)
    assert len(got) == len(rows)
    if rows:
        assert [g[:4] for g in got].count((3, "a.net", 0, None)) == 2 and sum(g[0] == 1 for g in got) == 2
        assert next(g for g in got if g[0] == 4)[1:] == ("x.org", 100_004, "org/fr/", "allow")
        assert next(g for g in got if g[0] == 0)[1:4] == ("b.com", 1, None)


def test_large_buckets_are_parted_without_losing_links(spark):
    """9,500 fingerprints near each other's first 43 bits: one bucket, parted by runs of bits; planted links are all found."""
    from blockloom.llm import components, simhash

    rng = np.random.default_rng(21)
    base = rng.integers(0, 1 << 21, 9_500, dtype=np.uint64) << np.uint64(43) | np.uint64(0x5A5A5A5A5A5)
    near = base[:60] ^ np.uint64(1 << 45) ^ np.uint64(1 << 3) ^ np.uint64(1 << 30) ^ np.uint64(1 << 63)
    fp = np.unique(np.concatenate((base, near)))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in components.connected_components(simhash.fingerprint_links(df)).collect()}
    root = np.arange(len(fp))
    order = np.zeros(len(fp), np.int64)
    for k in range(len(fp)):  # brute force, a row at a time
        hit = np.flatnonzero(np.bitwise_count(fp ^ fp[k]) <= 4)
        order[k] = hit.min()
        low = root[hit].min()
        for old in np.unique(root[hit]):
            root[root == old] = low
    got = np.array([roots.get(int(x), int(x)) for x in fp.view(np.int64)])
    assert len(set(zip(root.tolist(), got.tolist(), strict=True))) == len(set(root.tolist())) == len(set(got.tolist()))


def test_mixing_against_plain_order_sampling(spark, tmp_path):
    """Whole copies, Pareto ranks and the document at each source's cut, recomputed from the formulas."""
    import struct

    import xxhash

    from blockloom.llm import mixing

    r = random.Random(13)
    rows = [(i, " ".join(r.choices(["a", "bb", "ccc"], k=r.choice([0, 1, 3, 7, 20, 60]))), r.choice("ppppqqr")) for i in range(160)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t), "x", 1, 0.1, "y") for i, t, s in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op4_mixing(spark, str(tmp_path)).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    parts = 0
    for source in "pqr":
        mine = [(i, t) for i, t, s in rows if s == source]
        target = got[mine[0][0]].target
        measure = {i: math.floor(math.log2(size[i] + 1)) + 1 for i, _ in mine}
        lo, hi = 0.0, 3.0
        for _ in range(200):  # the rate at which expected words reach the target
            rate = (lo + hi) / 2
            lo, hi = (rate, hi) if sum(size[i] * min(3.0, rate * measure[i]) for i, _ in mine) < target else (lo, rate)
        copies = {i: min(3.0, hi * measure[i]) for i, _ in mine}
        whole = {i: math.floor(c + 1e-9) for i, c in copies.items()}
        left = target - sum(whole[i] * size[i] for i, _ in mine)
        ranks = []
        for i, t in mine:
            p = copies[i] - whole[i]
            if p > 1e-9 and size[i]:
                text = xxhash.xxh64_intdigest(t.encode(), 42)
                h = xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), 42)
                h = xxhash.xxh64_intdigest(struct.pack("<q", i), h)
                h = xxhash.xxh64_intdigest(struct.pack("<Q", text), h)
                u = ((h >> 11) + 0.5) / (1 << 53)
                odds = (u / (1 - u)) / (p / (1 - p))
                ranks.append((odds / (1 + odds), i))
        for _, i in sorted(ranks):
            part = math.floor(max(0.0, min(left, size[i])) + 1e-6)
            assert got[i].taken == whole[i] * size[i] + part, i
            parts += 0 < part < size[i]
            left -= size[i]
        ranked = {i for _, i in ranks}
        assert all(got[i].taken == whole[i] * size[i] for i, _ in mine if i not in ranked)
    assert parts >= 1
