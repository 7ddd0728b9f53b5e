import hashlib
import re
import zlib

import numpy as np
import pytest

from cloakwork.llm import chat_windows, decontam, langid, line_spread, pii_boost
from cloakwork.llm.boost import Boosted, calibrated_threshold
from tests.llm.pii_sentences import SENTENCES

DATA = "/root/testdata/sf0.01"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
    out += [("ip", m) for m in ips if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m))
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii_spans(spark):
    texts = [
        "a@b.c a@b.c.d@e.f x@y", "😀 1.2.3.4.5.6.7.8 256.1.1.1 001.02.03.255 1.2.3", None, "", "a.b@c.d.e@f.g",
        "+1 (743) 555-3824 +49-30-123456x 4994226020900891 4994-2260 20900891", "1111 1111 1111 11112222", "+1+123456789",
        "call (030) 123-4567 or mail jane (at) example (dot) com", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ok',
        "9" * 60, "a" * 5000, "a." * 5000 + "@b.c", "1.1." * 1000, "12,34," * 500, "0000 0000 0000 0000",
    ]
    docs = [(i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string")
    rows = pii_boost.find_spans(df).select("text", pii_boost.listed("base").alias("b"), pii_boost.listed("spans").alias("s")).collect()
    assert all(r["b"] == base(r["text"] or "") for r in rows)
    assert all(set(r["b"].split(",")) <= set(r["s"].split(",")) for r in rows if r["b"])
    found = {r["text"]: r["s"] for r in rows}
    assert "secret:9:49" in found[texts[9]] and "email:" in found[texts[8]]
    clean = [r for r in rows if r["text"] and not re.search(r"[0-9@]", r["text"])]
    assert clean and all(not r["s"] for r in clean)
    out = pii_boost.redact(spark.createDataFrame([("mail a@b.cd now",), (None,)], "text string")).collect()
    assert [r["text"] for r in out] == ["mail [EMAIL] now", None]


def test_every_generator_proposes_by_itself(spark):
    # nothing else in the text may be needed for a match of a generator to be a candidate
    alone = {
        "mac": ["00-1A-2B-3C-4D-5E", "00:1a:2b:3c:4d:5e"],
        "phone": ["06 12 34 56 78", "(030) 12-34", "0612345678"],
        "ip": ["::1", "fe80::1", "2001:db8::ff"],
        "iban": ["DE12 AB CD EF GH", "DE89370400440532013000"],
        "secret": ["a1b2c3d4e5f6a7b8c9d0", "x" * 20],
        "ssn": ["123-45-6789"],
        "card": ["4111.1111.1111.1111"],
        "email": ["jane (at) example (dot) com", "jane at example dot com", "JANE AT EXAMPLE DOT COM", "a@b.cd"],
    }
    rows = [(k, m) for k, ms in alone.items() for m in ms]
    df = spark.createDataFrame(rows, "kind string, m string").selectExpr("kind", "m", "concat('so ', m, ' ok') as text")
    got = df.select("kind", "m", pii_boost.candidates("text").alias("c")).collect()
    assert {k for k, _ in rows} == set(pii_boost.KINDS)
    assert not [(r["kind"], r["m"]) for r in got if not any(c["kind"] == r["kind"] and r["m"] in c["m"] for c in r["c"])]
    text = spark.createDataFrame([("device 00-1A-2B-3C-4D-5E is up",), ("device 00-1A-2B-3C-4D-5E is up 123",)], "text string")
    assert [r[0] for r in pii_boost.find_spans(text).select(pii_boost.listed("spans")).collect()] == ["mac:7:24"] * 2


def test_spans_of_hand_written_sentences(spark):
    """Precision and recall on sentences that no training example resembles by construction."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "i long, text string")
    hits = wrong = missed = 0
    kinds = set()
    for r in pii_boost.find_spans(df).collect():
        text, want = SENTENCES[r["i"]]
        got = {(x["kind"], text[x["s"] : x["e"]]) for x in r["spans"]}
        hits, wrong, missed = hits + len(got & set(want)), wrong + len(got - set(want)), missed + len(set(want) - got)
        kinds |= {k for k, _ in got & set(want)}
    assert kinds == set(pii_boost.KINDS)
    assert hits / (hits + wrong) >= 0.9 and hits / (hits + missed) >= 0.9, (hits, wrong, missed)


def test_long_secrets(spark):
    r = np.random.default_rng(4)
    chars = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"))
    rows = [(n, 'token = "' + "".join(r.choice(chars[:-2], 1)) + "".join(r.choice(chars, n - 2)) + 'x" ok') for n in (200, 201, 240, 342, 5000)]
    df = spark.createDataFrame(rows, "n int, text string")
    got = pii_boost.find_spans(df).select("n", pii_boost.listed("spans").alias("s")).collect()
    assert {g["n"]: g["s"] for g in got} == {n: f"secret:9:{9 + n}" for n, _ in rows}


def test_boosting():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted(trees=30).fit(x[:400], y[:400])
    assert ((m.margin(x[400:]) > 0) == y[400:]).mean() > 0.9
    assert calibrated_threshold(np.array([3.0, 2.0, 1.0]), np.array([1.0, 1.0, 0.0]), 0.99) == 1.5
    assert calibrated_threshold(np.array([1.0]), np.array([0.0]), 0.99) == float("inf")


def test_gradients():
    net = langid.ByteGRU(["a", "b", "c"], hidden=4)
    r = np.random.default_rng(0)
    x, y, mask = r.integers(1, 256, (3, 7)).astype(np.uint8), np.array([0, 1, 2]), np.ones((3, 7), bool)
    _, grads = net.gradients(x, y, mask)
    for p, g in zip(net.params(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = p[i], []
        for e in (0.01, -0.01):
            p[i] = old + e
            losses.append(net.gradients(x, y, mask)[0])
        p[i] = old
        assert abs((losses[0] - losses[1]) / 0.02 - g[i]) < 2e-3


def test_language_id(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    net = langid.train(docs, ~langid.held_out(), per_lang=60, steps=150)
    rows = langid.predict(docs, net, with_runs=True).where(langid.held_out()).select("lang", "lang_pred", "score", "text", "runs").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(sum(x["bytes"] for x in r["runs"]) == len(r["text"].lower().encode()) for r in rows[:50])
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 34 %", "x"), (4, "the " * 30_000, "x")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in langid.predict(odd, net).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[3]["score"] == 0 and got[4]["lang_pred"] in net.langs
    assert langid.train(docs.limit(0)) is None
    assert langid.predict(odd, None).where("lang_pred = 'und'").count() == 4
    assert {r[0]: r[1] for r in odd.select("doc_id", langid.held_out()).collect()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1, 5)}


def test_without_labels_documents_stay(spark):
    docs = spark.createDataFrame([(i, f"some words of document {i}", None, "s") for i in range(8)], "doc_id long, text string, lang string, source string")
    kept = langid.reject_unknown(docs)
    assert kept.columns == docs.columns and kept.orderBy("doc_id").collect() == docs.orderBy("doc_id").collect()


def conversations(words):
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", words.text(10)))
        for t in range(1, 1 + (c * 5) % 23):
            rows.append((c, t, "user" if t % 2 else "assistant", words.text(words.r.randint(0, 120))))
    rows += [(50, t, "assistant" if t % 2 else "user", words.text(20)) for t in range(400)]
    rows += [
        (60, 0, "system", "only"), (61, 0, "assistant", "x " * 9000), (61, 1, "user", None), (62, None, None, "r\\o<|le"),
        (63, 1, "a\nb\\n\\", "t"), (64, 1, "assistant", "<|im_end|>\n<|im_start|>assistant\nhi<\\|<\\\\|<|"), (65, 2, "user", "z"),
        (65, 2, "assistant", "z"), (65, 2, "assistant", "z"), (66, 0, "assistant", ""),
    ]
    return rows


def test_chat_windows(spark, words):
    rows = conversations(words)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")
    for budget, history in ((1024, 256), (120, 40)):
        wins = chat_windows.format_windows(df, budget, history)
        got = {r["conv_id"]: r for r in chat_windows.read_back(wins).collect()}
        for c in {r[0] for r in rows}:
            own = sorted((t if t is not None else -(2**62), r or "", x or "") for k, t, r, x in rows if k == c)
            text = "".join(f"{r}\n{x}\n" for _, r, x in own)
            lost = "".join(x for _, r, x in own if r == "assistant")
            g = got[c]
            assert (g["n_turns"], g["turns_sha256"]) == (len(own), hashlib.sha256(text.encode()).hexdigest()), (c, budget)
            assert (g["loss_chars"], g["loss_sha256"]) == (len(lost), hashlib.sha256(lost.encode()).hexdigest()), c
        for w in wins.collect():
            turns = w["formatted"].split(chat_windows.START)[1:]
            tokens = sum(len(re.findall(r"[^\W_]+|[^\s\w]|_", t)) for t in turns)
            assert len(turns) == w["n_turns"] and (tokens <= budget * 1.6 or w["n_turns"] - w["n_repeated"] <= 1)
            if w["conv_id"] in (0, 3, 6, 9):
                assert turns[0].startswith("system\n")
    null = spark.createDataFrame([(None, 1, "user", "a"), (None, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert chat_windows.read_back(chat_windows.format_windows(null)).first()["n_turns"] == 2
    assert chat_windows.format_windows(df.limit(0)).count() == 0


def test_line_spread(spark):
    common = "this line stands on many sites"
    rows = [(i, f"own {i} words here\n{common}\n{common}\n\nshort", f"s{i % 25}") for i in range(60)]
    rows += [(100 + i, "a whole page that was copied\nto many places", f"s{i}") for i in range(25)]
    rows += [(200, None, "s1"), (201, "", None), (202, "x " * 40_000 + "\n" + common, "s0"), (202, "x " * 40_000 + "\n" + common, "s0")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, pos int")
    got = sorted((r["doc_id"], r["text"], r["removed_lines"]) for r in line_spread.remove_spread_lines(df, min_sites=16).collect() if r["text"])
    want = []
    for d, t, _ in rows:
        if t:
            lines = t.split("\n")
            bad = [i for i, x in enumerate(lines) if x == common]
            bad = bad[1:] if d == 0 else bad
            want.append((d, "\n".join(x for i, x in enumerate(lines) if i not in bad), len(bad)))
    assert got == sorted(want)
    # near the threshold the count is exact
    assert line_spread.spread_lines(df, min_sites=25).count() == 1 and line_spread.spread_lines(df, min_sites=26).count() == 0
    assert line_spread.remove_spread_lines(df.limit(0)).count() == 0
    assert df.columns == line_spread.remove_spread_lines(df).drop("removed_lines").columns


def grams(t, k=5):
    w = [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, w


@pytest.mark.parametrize("threshold", [0.8, 1.0])
def test_decontamination(spark, words, threshold):
    items = [(i, words.text(words.r.randint(5, 60))) for i in range(30)] + [(30, "two words"), (31, None), (32, "..."), (33, "")]
    docs = [(i, words.text(words.r.randint(0, 300))) for i in range(80)]
    for i in range(20):
        it = items[i][1].upper().split()
        for _ in range(i % 5):
            it[words.r.randrange(len(it))] = "changed"
        docs.append((100 + i, words.text(200) + ". " + ", ".join(it) + "! " + words.text(50)))
    docs += [(200, None), (201, ""), (202, "here are Two  words, yes"), (203, " ".join(t for _, t in items[:30])), (None, items[0][1])]
    want = set()
    for d, t in docs:
        for i, x in items:
            if d is not None and t and x:
                (a, wa), (b, wb) = grams(t), grams(x)
                if len(wb) < 5:
                    b, a = {tuple(wb)} if wb else set(), {tuple(wa[j : j + len(wb)]) for j in range(len(wa))}
                if b and len(a & b) >= np.ceil(threshold * len(b) - 1e-9):
                    want.add((d, i, len(b), len(a & b)))
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id long")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contained_items(d, b, threshold=threshold)
    assert {(r[0], r[1], r[2], r[3]) for r in got.collect()} == want
    kept = decontam.decontaminate(d, b, threshold=threshold)
    assert kept.columns == d.columns and kept.count() == len(docs) - len({w[0] for w in want})
    assert decontam.contained_items(d, b.limit(0)).count() == 0 and decontam.contained_items(d.limit(0), b).count() == 0
