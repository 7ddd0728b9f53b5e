import base64
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloakwork.llm import cutting_stock, dom_boost, nn_descent, warc_merge

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB éÉñ'sſİ́\u0085 \n\t<|endoftext|>1२.,\x1c"), max_size=40))
def test_word_ids_are_text_ids(text):
    tok = test_word_ids_are_text_ids.__dict__.setdefault("tok", (Tokenizer.from_file(PATH), cutting_stock.WordTokenizer(PATH)))
    assert np.frombuffer(tok[1].ids(text), "<u4").tolist() == tok[0].encode(text, add_special_tokens=False).ids


def test_other_tokenizers_read_whole_texts():
    """A file without the properties that encoding by words rests on."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    tok, want = cutting_stock.WordTokenizer(other), Tokenizer.from_file(other)
    assert cutting_stock.WordTokenizer(PATH).by_words and not tok.by_words
    for text in ("Hello  World's\n\tHELLO é 12", "", None, " x"):
        assert np.frombuffer(tok.ids(text), "<u4").tolist() == want.encode(text or "", add_special_tokens=False).ids


def test_packing(spark, words):
    rows = [(i, words.text(words.r.randint(0, 2500))) for i in range(150)] + [(200, None), (201, ""), (202, words.text(30_000)), (5, "twice")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, length int")
    got = [r.asDict() for r in cutting_stock.pack_documents(df, PATH, with_ids=True).collect()]
    tok = Tokenizer.from_file(PATH)
    want = collections.Counter((d, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for d, t in rows)
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for g in got:
        assert zlib.crc32(np.array(g["ids"], "<u4").tobytes()) == g["ids_crc32"] and len(g["ids"]) == g["length"]
        docs[g["doc_id"], g["doc_tokens"]].append(g)
        seqs[g["sequence_id"]].append((g["offset"], g["length"]))
    found = collections.Counter()
    for (d, n), ps in docs.items():
        ids = [x for p in sorted(ps, key=lambda p: p["start"]) for x in p["ids"]]
        assert len(ids) == n
        found[d, zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert found == want
    used = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
        used += at
    assert used / (len(seqs) * 4096) > 0.9
    assert cutting_stock.pack_documents(df.limit(0), PATH).count() == 0


def test_patterns():
    r = np.random.default_rng(1)
    hist = dict(collections.Counter((r.gamma(2, 20, 3000).astype(int) % 128 + 1).tolist()))
    plan = cutting_stock.plan_patterns(hist, 128)
    held = collections.Counter()
    for slots, n in plan:
        assert sum(slots) <= 128
        held.update({k: v * n for k, v in collections.Counter(slots).items()})
    assert held == collections.Counter(hist)
    assert sum(n for _, n in plan) <= 1.02 * sum(k * v for k, v in hist.items()) / 128 + 1
    assert cutting_stock.plan_patterns({}, 128) == []


def test_near_vectors(spark):
    r = np.random.default_rng(2)
    rows, dim = [], 32
    for i in range(300):
        rows.append((r.normal(size=dim).tolist(), int(i % 3)))
    for i in range(40):
        rows.append(((np.array(rows[i][0]) + r.normal(0, 0.03, dim)).tolist(), rows[i][1]))
    hot = r.normal(size=dim)
    rows += [((hot + r.normal(0, 0.02, dim)).tolist(), 1) for _ in range(120)] + [(hot.tolist(), 1)] * 30 + [((hot * 2).tolist(), 1), (hot.tolist(), 2)]
    nan = [float("nan")] + [1.0] * (dim - 1)
    rows += [(None, 1), ([0.0] * dim, 1), (nan, 1), ([None] + [1.0] * (dim - 1), 1), (hot.tolist(), None), ([1.0, 2.0], 1), ([1.0, 2.0], 1), ([], 1)]
    df = spark.createDataFrame([(i, v, k, 0) for i, (v, k) in enumerate(rows)], "vec_id long, embedding array<double>, label int, v int")
    run = nn_descent.NearVectors(df)
    got = {x["vec_id"]: x for x in run.run().collect()}
    ok = [i for i, (v, k) in enumerate(rows) if v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    n, parent = collections.Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][0]), np.array(rows[b][0])
            if a < b and rows[a][1] == rows[b][1] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                n[a] += 1
                n[b] += 1
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    total = sum(n.values())
    assert len(got) == len(rows) and run.recall >= 0.95
    assert all(got[i]["n_links"] <= n[i] + 1 for i in got)
    assert sum(g["n_links"] for g in got.values()) >= 0.97 * total
    assert np.mean([got[i]["component_id"] == find(i) for i in got]) > 0.97
    assert all(g["kept"] == (g["component_id"] == i) for i, g in got.items())
    assert nn_descent.near_vectors(df.limit(0)).count() == 0


def sphere(r, dim, near, cosine):
    """A unit vector at this cosine from near."""
    y = r.normal(size=dim)
    y -= (y @ near) * near
    return cosine * near + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def links(x, threshold=0.98):
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    return hit


def test_groups_that_link_only_to_each_other(spark):
    # all neighbours in the lists are of the own group, every link across is beyond them
    r = np.random.default_rng(5)
    dim = 64
    one = sphere(r, dim, np.eye(dim)[0], 0.0)
    two = sphere(r, dim, one, 0.9865)
    x = np.array([sphere(r, dim, c, 0.9993) for c in (one, two) for _ in range(100)])
    hit = links(x)
    inside, across = (x @ x.T)[:100, :100], (x @ x.T)[:100, 100:]
    assert inside.min() > across.max() and across.min() >= 0.98
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {g["vec_id"]: g for g in nn_descent.near_vectors(df).collect()}
    assert [got[i]["n_links"] for i in range(200)] == hit.sum(1).tolist()
    assert all(g["component_id"] == 0 and g["kept"] == (i == 0) for i, g in got.items())


@pytest.mark.parametrize("threshold", [0.5, 0.98])
def test_every_label_size_meets(threshold):
    # a pair at the threshold meets in a table with the probability of its angle, to the power of the bits
    plan = nn_descent.plans(threshold)
    assert [k for k, _ in plan] == list(range(len(plan))) and plan[0] == (0, 1)
    for bits, tables in plan:
        assert 1 - (1 - (1 - np.arccos(threshold) / np.pi) ** bits) ** tables >= 0.99
    # at 0.98 the buckets stay small up to labels of hundreds of thousands of vertices
    assert threshold < 0.98 or 1_000_000 / 2 ** plan[-1][0] <= nn_descent.MEAN


def test_lost_pairs_are_audited(spark, monkeypatch):
    # far too many bits: pairs are lost, which a dense group's links must not hide
    monkeypatch.setattr(nn_descent, "MEAN", 1e-9)
    monkeypatch.setattr(nn_descent, "MEETS", 1e-9)
    r = np.random.default_rng(6)
    far = [sphere(r, 64, np.eye(64)[0], 0.0) for _ in range(300)]
    x = np.array(far + [sphere(r, 64, f, 0.983) for f in far[:150]] + [sphere(r, 64, far[0], 0.998) for _ in range(200)])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    run = nn_descent.NearVectors(df)
    seen, audit = [], run._audit
    monkeypatch.setattr(run, "_audit", lambda: seen.append(audit()) or seen[-1])
    got = {g["vec_id"]: g["n_links"] for g in run.run().collect()}
    assert seen[0] < 0.5 and run.recall == 1.0
    assert [got[i] for i in range(len(x))] == links(x).sum(1).tolist()
    monkeypatch.setattr(run, "_audit", lambda: 0.5)
    with pytest.raises(RuntimeError):
        run.run()


def pages():
    rows = [(i, f"http://www.h{i % 7}.example.com/p/{i % 11}?q=é {i}", f"<p>page {i % 40}</p>" * (i % 5)) for i in range(300)]
    return rows + [(400, None, None), (401, "not a url\n", ""), (402, "http://[bad", "x" * 200_000), (-3, "http://a.example/", "neg"), (None, "http://a.example/", "neg")]


@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, least):
    rows = pages()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int").repartition(5)
    got = warc_merge.capture_histories(df, least).collect()
    first: dict = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= least:
            first[b] = min(first.get(b, i), i)
    want = set()
    for i, _, h in rows:
        b = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        ref = first.get(b) if i is not None and first.get(b) != i else None
        want.add((i, len(b), d, "response" if ref is None else "revisit", ref))
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want and len(got) == len(rows)
    order = [(r["urlkey"], r["captured"]) for r in sorted(got, key=lambda r: (r["range"], r["place"]))]
    assert order == sorted(order)
    assert warc_merge.capture_histories(df.limit(0)).count() == 0


def test_merge_levels(spark, monkeypatch):
    monkeypatch.setattr(warc_merge, "FAN_IN", 3)
    monkeypatch.setattr(warc_merge, "RANGE_LINES", 40)
    df = spark.createDataFrame(pages()[:300], "page_id long, url string, html string").repartition(8)
    got = sorted(warc_merge.capture_histories(df).collect(), key=lambda r: (r["range"], r["place"]))
    assert len(got) == 300 and len({r["range"] for r in got}) > 2
    order = [(r["urlkey"], r["captured"], r["page_id"]) for r in got]
    assert order == sorted(order)


def test_loser_tree(tmp_path):
    r = np.random.default_rng(3)
    row = lambda k: (f"k{k:05d}", "2024", k, 1, "D", "response", None, "a", int(k))
    for k in (1, 2, 3, 5, 8):
        runs = [sorted(r.integers(0, 500, r.integers(0, 90)).tolist()) for _ in range(k)]
        got = [x[2] for x in warc_merge.LoserTree([iter([row(v) for v in run]) for run in runs])]
        assert got == sorted(v for run in runs for v in run)
    assert list(warc_merge.LoserTree([])) == []
    name = f"file://{tmp_path}/run.cdx"
    rows = [row(v) for v in range(0, 3000, 3)]
    warc_merge._write_run(name, iter(rows))
    assert pafs.FileSystem.from_uri(name)[0].type_name == "local"
    for lo, hi in ((0, 3000), (5, 17), (2999, 4000), (1500, 1500)):
        cut = warc_merge._slice(name, warc_merge._order(row(lo)), warc_merge._order(row(hi)))
        assert [x[2] for x in cut] == [v for v in range(0, 3000, 3) if lo <= v < hi]


def test_html(spark):
    model = dom_boost.trained()
    maker = dom_boost._Maker(99)
    wrong = 0
    for _ in range(60):
        page = dom_boost.Page(maker.page())
        truth = ["data-main" in a for a in page.attrs]
        keep = dom_boost.decode(page, model.margin(dom_boost.features(page)))
        assert all(not k or i == 0 or keep[page.parent[i]] for i, k in enumerate(keep))
        wrong += dom_boost.text_of(page, keep) != dom_boost.text_of(page, [i == 0 or t and not s for i, (t, s) in enumerate(zip(truth, page.silent, strict=True))])
    assert wrong <= 6
    body = "<h1>T &amp; U</h1><p>One  two,\n three four five six seven.<p>Next <b>bold</b> block of this page, with words.</p>"
    odd = [
        "<html><body><nav><a href=x>Menu</a></nav><article>" + body + "</article><footer>&copy; x</footer></body></html>",
        None, "", "<script>var a='<p>x</p>'</script>", "<!-- only -->", "</p></div><", "<div>" * 5000 + "deep" + "</div>" * 5000,
        "<p" + " a='b'" * 20_000,
    ]
    df = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(odd)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in dom_boost.extract_main(df).collect()}
    assert got[0]["text"] == "T & U\nOne two, three four five six seven.\nNext bold block of this page, with words."
    assert all(got[i]["text"] == "" for i in (1, 2, 3, 4)) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert dom_boost.extract_main(df.limit(0)).count() == 0
