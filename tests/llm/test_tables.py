"""Operators 1, 4, 6, 7 and 10, components and the pipeline against brute force and SQL."""

import base64
import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.conftest import ODD, SF

from tempora.llm import chat, cover_tree, queries, simhash, warc, wrapper
from tempora.llm.common import shared_dir, table
from tempora.llm.components import components


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_a_cluster_needs_a_shared_folder(spark):
    class Elsewhere:
        conf, sparkContext = {}, type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere())


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(300, 380)] + [(400, i) for i in range(401, 450)]
    want = groups(450, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(want[i] == c for i, c in got.items())
    assert {i for x in links if x[0] != x[1] for i in x} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint_by_contract(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_by_brute_force(rows):
    fp = np.asarray([fingerprint_by_contract(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp) <= 4
    of = groups(len(rows), np.argwhere(np.triu(near, 1)).tolist())
    least = {}
    for (i, _), g in zip(rows, of, strict=True):
        least[g] = min(x for x in (least.get(g), i) if x is not None) if i is not None or g in least else None
    return Counter((i, f"{int(f):016x}", least[g]) for (i, _), f, g in zip(rows, fp, of, strict=True))


def test_op6(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    assert Counter(map(tuple, queries.op6_simhash(spark, "/root/testdata/sf0.01").collect())) == simhash_by_brute_force(rows)
    assert Counter(map(tuple, simhash.near_duplicates(odd).collect())) == simhash_by_brute_force([(i, t) for i, t, _ in ODD])
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    assert Counter(r["doc_id"] for r in simhash.keep_one(odd).collect()) == {1: 1, 4: 1, 5: 1, 6: 1, 7: 1}


def test_keep_one_loses_no_text_to_a_shared_id(documents):
    a, b = (" ".join(f"{w}{i}" for i in range(80)) for w in "ab")
    rows = [(1, a, "s"), (1, b, "s"), (2, a, "s"), (None, b, "s"), (None, a + " c", "s"), (3, "other words", "s"), (3, "other words", "s"), (None, "alone here", "s"), (None, None, "s")]
    kept = simhash.keep_one(documents(rows))
    assert kept.columns == documents(rows).columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == {(1, a): 1, (1, b): 1, (3, "other words"): 1, (None, "alone here"): 1, (None, None): 1}


@pytest.mark.parametrize("n", [0, 1 << 24, 1 << 30, 1 << 40])
def test_near_fingerprints_share_a_bucket_at_any_size(spark, n):
    k = simhash.agreeing(n, 4)
    assert k == {0: 2, 1 << 24: 3, 1 << 30: 4, 1 << 40: 5}[n]
    rng = np.random.default_rng(n % 97)
    pairs = [(i, x, x ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False))) for i, x in enumerate(rng.integers(0, 2**62, 100).tolist())]
    df = spark.createDataFrame(pairs, "i long, a long, b long")
    got = df.select(*(F.array(*simhash.buckets(c, 4, k)).alias(c) for c in "ab")).collect()
    assert all(any(x == y for x, y in zip(r["a"], r["b"], strict=True)) for r in got)
    assert sum(x == y for r in got for x, y in zip(r["a"], got[0]["b"], strict=True)) < len(got) + 130  # and others hardly meet


def test_op6_with_wider_keys(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 0)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{i % 20}x{j}" if rng.random() > 0.02 else "z" for j in range(80)), "a") for i in range(200)]
    assert Counter(map(tuple, simhash.near_duplicates(documents(rows)).collect())) == simhash_by_brute_force([(i, t) for i, t, _ in rows])


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**63, 200).astype(np.uint64)
    for k in range(100, 200):
        fps[k] = fps[k - 100] ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 9), replace=False))
    want = np.bitwise_count(fps[:, None] ^ fps) <= radius
    got = np.unpackbits(simhash.within(simhash.planes_of(fps), fps, radius).view(np.uint8), axis=1, bitorder="little")[:, :200].astype(bool)
    assert (got == want).all()
    assert groups(200, simhash.spanning(fps, radius)) == groups(200, np.argwhere(want).tolist())


def test_chunks_of_a_hot_bucket_lose_no_link(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(5)
    text = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else "z" for w in text), "a") for i in range(120)]
    assert Counter(map(tuple, simhash.near_duplicates(documents(rows)).collect())) == simhash_by_brute_force([(i, t) for i, t, _ in rows])


def vectors_by_brute_force(rows, threshold=0.93):
    ok = [l is not None and i is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, l in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.asarray(rows[k][1], np.float32).astype(float) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.append((a, b))
    of, n = groups(len(rows), links), Counter(k for x in links for k in x)
    least = {}
    for k, g in enumerate(of):
        if rows[k][0] is not None:
            least[g] = min(least.get(g, rows[k][0]), rows[k][0])
    return Counter((i, n[k], least.get(of[k]), i is not None and i == least.get(of[k])) for k, (i, _, _) in enumerate(rows))


def test_op10(spark, monkeypatch):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, SF, "embeddings").collect()]
    assert Counter(map(tuple, queries.op10_cover_tree(spark, SF).collect())) == vectors_by_brute_force(rows)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    many = [(i, [float(np.float32(x)) for x in centers[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.3])], int(rng.integers(2))) for i in range(300)]
    many += [(300 + i, many[i % 3][1], many[i % 3][2]) for i in range(40)]
    many += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, [1.0] * 8, None), (404, [], 1), (405, [1.0, None], 1), (406, [1.0, 2.0], 1), (407, [1.0, 2.0], 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame([(*x, 1, "c") for x in many], "vec_id long, embedding array<float>, label int, n int, cell string")
    want = vectors_by_brute_force(many)
    assert Counter(map(tuple, cover_tree.near_duplicates(df).collect())) == want
    monkeypatch.setattr(cover_tree, "CELL", 16)
    monkeypatch.setattr(cover_tree, "PER_PIVOT", 20)
    monkeypatch.setattr(cover_tree, "LEAF", 4)
    assert Counter(map(tuple, cover_tree.near_duplicates(df).collect())) == want
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0


def test_cover_tree_prunes_and_takes_any_size(spark):
    rng = np.random.default_rng(4)
    near = rng.normal(size=(30, 64)).repeat(60, 0) + 0.03 * rng.normal(size=(1800, 64))
    for v in (near, rng.normal(size=(1500, 4)), rng.normal(size=(600, 64))):
        u = v / np.linalg.norm(v, axis=1)[:, None]
        want = u @ u.T >= 0.93
        np.fill_diagonal(want, False)
        w = rng.integers(1, 4, len(v))
        for k in (0, len(v) // 3):
            part = want.copy()
            if k:
                part[:k, :k] = part[k:, k:] = False
            got = cover_tree.Links(v[:k] if k else v, v[k:] if k else None, w, 0.93)
            assert (got.n == part @ w).all()
            assert [int(x) for x in got.root] == groups(len(v), np.argwhere(np.triu(part, 1)).tolist())
            assert got.computed < (0.25 if len(v) > 600 else 1.01) * len(v) ** 2  # of random vectors of 64 components none can be pruned
    huge = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [1.0, 2.1], 1), (4, [-1.0, -2.0], 1), (5, [5e-324, 0.0], 2), (6, [1e308, 1.0], 2)]
    got = cover_tree.near_duplicates(spark.createDataFrame(huge, "vec_id long, embedding array<double>, label int"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)}


def test_op10_visits_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "PER_PIVOT", 10)
    monkeypatch.setattr(cover_tree, "CELL", 7)
    rng = np.random.default_rng(8)
    for dim in (2, 3, 40):
        rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)], i % 2) for i in range(200)]
        rows += [(200 + i, [float(np.float32(x)) for x in np.asarray(rows[i % 4][1]) + 0.02 * rng.normal(size=dim)], rows[i % 4][2]) for i in range(60)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        assert Counter(map(tuple, cover_tree.near_duplicates(df).collect())) == vectors_by_brute_force(rows)


def test_op1(spark):
    want = duckdb.sql(chat.ORACLE.replace("from conversations", f"from '{SF}/conversations.parquet'")).fetchall()
    assert Counter(map(tuple, queries.op1_chat_rotation(spark, SF).collect())) == Counter(want)
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 1, "bob", "yo"), (1, None, None, None), (1, 70, "ann", "late"), (2, 0, "system", "s"), (None, 0, "ann", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, segs string")
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, s, p) for s in ("ann", "bob", "unknown") for p in (-1, 0, 1)} | {(None, "ann", 0)}
    r = got[1, "bob", 0]
    assert r["text"] == "<|im_start|>user name=ann\nhi<|im_end|>\n" + "<|im_start|>assistant\nyo<|im_end|>\n" * 2 and r["n_own_turns"] == 2
    assert [r["text"][slice(*map(int, x.split(":")))] for x in r["target_spans"].split(",")] == ["yo<|im_end|>"] * 2
    assert chat.rotate(df.limit(0)).count() == 0
    assert "Python" not in chat.rotate(df)._jdf.queryExecution().toString()


def test_op4(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as from '{SF}/pages.parquet'")
    assert Counter(map(tuple, queries.op4_wrapper_text(spark, SF).collect())) == Counter(con.sql(wrapper.ORACLE).fetchall())
    page = "<html><body><div class=top>Site of things</div><div class='c'><p>{0} one &amp; two<br>three<p>more {0}</div><p>Always the same line</p><form>f</form><div class='post-comments'>no</div></body></html>"
    rows = [(i, f"http://h.org/{i}", page.format(f"text{i} is long enough to matter here")) for i in range(12)]
    rows += [(50, None, None), (51, "x", ""), (52, "http://h.org/", "<p>un<b>closed"), (53, "http://o.org/", "<div><span>a</span>b <script>x</script></div>c<!-- d"), (53, "http://o.org/", "<br><hr></p>"), (54, "http://o.org", "<p>" * 300 + "deep")]
    df = spark.createDataFrame([(*r, "h", 3) for r in rows], "page_id long, url string, html string, host string, n int")
    got = {r["page_id"]: r["text"] for r in wrapper.extract(df.where("page_id <> 53")).collect()}
    assert got[3] == "text3 is long enough to matter here one & two three more text3 is long enough to matter here"
    assert got[50] == got[51] == "" and got[52] == "unclosed" and got[54] == "deep"
    assert wrapper.extract(df).count() == len(rows) and wrapper.extract(df.limit(0)).count() == 0
    small, wrapper.SMALL = wrapper.SMALL, -1
    try:
        assert {r["page_id"]: r["text"] for r in wrapper.extract(df.where("page_id <> 53")).collect()} == got
    finally:
        wrapper.SMALL = small
    assert [t for _, t in wrapper.blocks(wrapper.parse("<div><span>a</span>b <script>x</script></div>c<!-- d"))] == ["ab", "c"]


def test_op4_aligns_pages_of_a_host_across_partitions(spark, monkeypatch):
    page = "<body><div>Site of things</div><p>text {0} of its own kind {0}</p><div>All rights kept</div></body>"
    rows = [(10 * h + i, f"http://h{h}.org/{i}", page.format(f"w{h}x{i}")) for i in range(6) for h in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r[0]: f"text {w} of its own kind {w}" for r in rows for w in [f"w{r[0] // 10}x{r[0] % 10}"]}
    for n in (1, 7, 120):
        assert {r["page_id"]: r["text"] for r in wrapper.extract(df.repartition(n)).collect()} == want
    monkeypatch.setattr(wrapper, "CHUNK", 3)
    one = df.withColumn("url", F.lit("http://one.org/"))
    assert {r["page_id"]: r["text"] for r in wrapper.extract(one.repartition(40)).collect()} == want


def test_op4_takes_article_as_evidence(spark):
    body = "the real body of page {0} stands here and is much longer than what it teases {0}"
    kinds = {
        "a": f"<div class=top>Site of things</div><article class='comment first'>reader {{0}} says</article><div class=c>{body}</div>",
        "b": f"<div class=top>Site of things</div><article class=teaser>teaser {{0}}</article><div class=c>{body}</div>",
        "c": f"<div class=top>Site of things</div><article class='post category-social'><h1>title {{0}}</h1><p>{body}</p></article><div class=c>aside {{0}}</div>",
    }
    rows = [(100 * k + i, f"http://{h}.org/{i}", html.format(f"x{k}y{i}")) for k, (h, html) in enumerate(kinds.items()) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == body.format(f"x0y{i}")
        assert got[100 + i] == f"teaser x1y{i} " + body.format(f"x1y{i}")
        assert got[200 + i] == f"title x2y{i} " + body.format(f"x2y{i}")


def test_simple_tree_matching_aligns_in_order():
    a, b = wrapper.parse("<ul><li>a<li>x<li>c</ul><p>k"), wrapper.parse("<ul><li>a<li>c</ul><p>k")
    score, pairs = wrapper.align(a, b)
    assert [(s, t) for _, s, t in pairs if s == t] == [("k", "k"), ("c", "c"), ("a", "a")]


def test_op7(spark):
    def want(rows):
        last = {}
        for i, _, h in rows:
            last[h or ""] = max((x for x in (last.get(h or ""), i) if x is not None), default=None)
        out = Counter()
        for i, _, h in rows:
            b, first = (h or "").encode(), last[h or ""]
            out[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first] += 1
        return out

    rows = [tuple(r) for r in table(spark, SF, "pages").select("page_id", "url", "html").collect()]
    assert Counter(map(tuple, queries.op7_warc(spark, SF).collect())) == want(rows)
    odd = [(1, "http://a/ b%\n", "x\r\n\r\ny"), (2, None, None), (3, "u", ""), (4, "u", "é" * 90_000), (4, "u", "é" * 90_000), (None, "u", "x\r\n\r\ny")]
    df = spark.createDataFrame([(*r, "a", 1) for r in odd], "page_id long, url string, html string, archive string, offset int")
    assert Counter(map(tuple, warc.round_trip(df).collect())) == want(odd)
    index = warc.write(df)
    back = warc.read(index.where("record_type = 'response'")).collect()
    assert {(r["page_id"], r["url"], r["payload"]) for r in back} == {(1, "http://a/ b%\n", "x\r\n\r\ny"), (3, "u", ""), (4, "u", "é" * 90_000)}
    assert warc.round_trip(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.sql(f"create view pages as from '{SF}/pages.parquet'")
    assert Counter(con.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({queries.OP7_SQL})").fetchall()) == want(rows)


def test_ranges_are_coalesced():
    assert list(warc.ranges([(0, 10), (10, 5), (warc.GAP + 16, 4), (20 * warc.GAP, 1)])) == [(0, 2, 0, 15), (2, 3, warc.GAP + 16, warc.GAP + 20), (3, 4, 20 * warc.GAP, 20 * warc.GAP + 1)]


def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == table(spark, SF, "documents").columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= before
    left = {r["doc_id"] for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == left
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
