"""The numbered operators against plain versions, round trips and edge cases."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import _links, audio, bpe, digest, html, langid, mixing, neardup, quality, queries, sharding, warc
from strandline.llm._words import text_slices

WORDS = "the of and to in is was for that with river stone light garden winter summer market engine paper silver".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")


EDGES = [None, "", "  \t\n", "One", "Zwei Wörter", "The  QUICK brown fox", "a b c d e", "a b c d e", "é", "é", "word " * 30_000, "x" * 200_000, "日本語 テキスト", "<|endoftext|> end", "it's I'll we'VE 'tis '", "12345 ½ Ⅷ"]


def shingles(text, w):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)} if len(ws) >= w else ({tuple(ws)} if ws else set())


def test_neardup_equals_brute_force(spark):
    rng, texts = random.Random(5), list(EDGES)
    for _ in range(30):
        t = prose(rng, rng.choice([3, 5, 8, 12, 30, 90, 400])).split()
        texts.append(" ".join(t))
        for _ in range(rng.choice([0, 1, 4, 9])):
            c = list(t)
            for _ in range(max(1, rng.randint(0, len(t) // 14))):
                c[rng.randrange(len(c))] = rng.choice(WORDS) + "x"
            texts.append(" ".join(c))
    for w in (4, 5):
        sets = [shingles(t, w) for t in texts]
        parent = list(range(len(texts)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(texts)):
            for j in range(i):
                k = len(sets[i] & sets[j])
                if sets[i] and 100 * k >= 80 * len(sets[i] | sets[j]) and k:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        got = {r.doc_id: r for r in neardup.near_duplicates(corpus(spark, texts), width=w).collect()}
        assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in got} == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def test_neardup_edges(spark):
    assert neardup.near_duplicates(corpus(spark, [])).count() == 0
    twice = corpus(spark, ["a b c d e f", "a b c d e f", None])
    twice = twice.unionByName(twice)
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(twice).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert sorted(r.doc_id for r in neardup.keep_one(twice).collect()) == [0, 2]


def test_run_lengths_hold_for_all_small_unions():
    for u in range(1, 120):
        i = -(-80 * u // 100)
        longest = -(-i // (u - i + 1))
        for n in range(i, u + 1):
            assert any(x <= longest for x in neardup.run_lengths(n, 80))


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(queries.vocab_path())
    rng = random.Random(1)
    bits = ["a", "ab", "the", " ", "  ", "\n", "é", "ß", "語", "😀", "1", "½", "'s", "'ll", "'", "!?", "\x85", "\x1c", "　", "अि", "<|endoftext|>", "zzz"]
    texts = EDGES + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = corpus(spark, texts)
    got = {r.doc_id: r for r in bpe.encode(df, queries.vocab_path(), keep=("doc_id",), decoded_col="back").collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].back == lib.decode(ids, skip_special_tokens=False) == (t or "")
    again = bpe.decode(bpe.encode(df, queries.vocab_path(), keep=("doc_id",)), queries.vocab_path(), keep=("doc_id",))
    assert {r.doc_id: r.text for r in again.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0), queries.vocab_path()).count() == 0


def test_plain_and_sliced_encoding_agree():
    b = bpe.Bpe(open(queries.vocab_path(), encoding="utf-8").read())
    texts = [t or "" for t in EDGES]
    out = []
    for _, _, data, offsets in text_slices(pa.array(texts)):
        ids, bounds = b.encode_many(data, offsets)
        out += [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])]
    assert out == [b.encode(t) for t in texts]


def test_fingerprints(spark):
    df = corpus(spark, EDGES)
    got = {r.doc_id: r for r in digest.fingerprints(df).collect()}
    same = lambda a, b: got[a].fingerprint == got[b].fingerprint
    assert same(6, 7) and same(0, 1) and same(1, 2) and same(8, 9) and not same(3, 4)
    assert got[7].group_id == 6 and got[2].group_id == 0 and got[9].group_id == 8
    spaced = spark.createDataFrame([(1, "The Quick\tfox \n"), (2, "the  quick fox"), (3, "STRASSE"), (4, "straße"), (5, "the quickfox")], "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in digest.fingerprints(spaced).collect()}
    assert f[1] == f[2] != f[5] and f[3] == f[4]


def test_edited_fingerprints_follow_the_next_document(spark, monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 20)) for _ in range(57)] + [None, ""]
    ids = rng.sample(range(1000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    for rows in (20_000, 5):  # one range, then several
        monkeypatch.setattr(digest, "RANGE_ROWS", rows)
        order = sorted(zip(ids, texts), key=lambda r: -r[0])
        want = {}
        for k, (i, t) in enumerate(order):
            t, x = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(t) // 2
            want[i] = (len(t), hashlib.sha256((t[: len(t) - half] + x[:half]).encode()).hexdigest())
        got = digest.edited_fingerprints(df).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(texts)
        assert all((r.group_id == r.doc_id) == (r.fingerprint not in [x.fingerprint for x in got if x.doc_id < r.doc_id]) for r in got)
    assert digest.edited_fingerprints(df.limit(0)).count() == 0
    assert digest.edited_fingerprints(df.where(f"doc_id = {ids[0]}")).first().near_next == 1.0


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(digest, "digest", lambda c: F.substring(c, 1, 1))
    rows = [(1, "ab"), (2, "ac"), (3, "AB "), (None, "ac"), (None, "x"), (4, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, "a", 1), (2, "a", 2), (3, "a", 1), (None, "a", 2), (None, "x", None), (4, "y", 4)], key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.group_id) for r in digest.fingerprints(df).collect()), key=str) == want
    assert sorted(((r.doc_id, r.fingerprint, r.group_id) for r in digest.edited_fingerprints(df).collect()), key=str) == want
    monkeypatch.undo()
    assert {(r.doc_id, r.group_id) for r in digest.edited_fingerprints(df).collect()} == {(1, 1), (2, 2), (3, 1), (None, 2), (None, None), (4, 4)}


def test_mixing(spark):
    rng = random.Random(3)
    df = corpus(spark, EDGES + [prose(rng, rng.randint(1, 60)) for _ in range(200)])
    rows = mixing.mix(df).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(r.text for r in df.orderBy("doc_id").collect())}
    assert {r.doc_id: r.size for r in rows} == size
    source = {r.doc_id: r.source for r in df.collect()}
    by = {}
    for r in rows:
        by.setdefault(source[r.doc_id], []).append(r)
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.part <= r.size
    total = sum(size.values())
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 1 and rs[0].target <= 3 * rs[0].source_size + 1e-6
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(total)
    assert sorted(mixing.mix(df.repartition(5)).collect()) == sorted(rows)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(corpus(spark, [None, ""])).agg({"taken": "sum"}).first()[0] == 0
    assert mixing.mixed_documents(df).columns == df.columns


def test_mixing_targets_with_caps(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 5)], "s string, n long")
    got = {r.s: r.target for r in mixing.targets(s, "s", "n").collect()}
    assert got["b"] == 30 and got["c"] == 30 and got[None] == 15 and got["a"] == pytest.approx(950)


def test_language_and_quality(spark):
    rng = random.Random(4)
    other = "le la les des une dans pour avec être sur rivière pierre lumière jardin hiver été marché moteur papier argent".split()
    texts = [prose(rng, 40) if i % 2 else " ".join(rng.choice(other) for _ in range(40)) for i in range(300)]
    junk = [i % 5 == 0 for i in range(300)]
    texts = [" ".join(w + "%%%###" for w in t.split()) if j else t for t, j in zip(texts, junk)]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", f"s{i % 4}", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(df.where(~langid.held_out()))
    edges = spark.createDataFrame([(1000, None), (1001, ""), (1002, "12 !?"), (1003, "word " * 50_000)], "doc_id long, text string").selectExpr("*", "cast(null as string) lang", "'s' source", "0L n_chars")
    out = {r.doc_id: r for r in langid.predict(df.unionByName(edges), model).collect()}
    assert sum(out[i].lang_pred == ("en" if i % 2 else "fr") for i in range(300)) >= 297
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and out[i].rejected for i in (1000, 1001, 1002)) and out[1003].lang_pred in ("en", "fr")
    assert langid.predict(df, langid.train(df.limit(0))).first().lang_pred == "und" and langid.predict(df.limit(0), model).count() == 0
    labels = spark.createDataFrame([(i, int(not j), 0) for i, j in enumerate(junk) if i % 3], "doc_id long, quality int, toxic int")
    q = quality.train(df, labels)
    rows = {r.doc_id: r for r in quality.hierarchical_quality(df.unionByName(edges), q).collect()}
    assert [rows[i].rejected for i in range(300)] == junk and rows[1000].evidence == 0.5
    assert quality.keep_good(df, q).count() == 240 and quality.hierarchical_quality(df.limit(0), q).count() == 0
    assert not quality.hierarchical_quality(df, quality.train(df, labels.limit(0))).where("rejected").count()


def test_site_posteriors_equal_a_plain_version(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(14)
    rows = [(i, f"{rng.betavariate(4, 1 + i % 3):.6f}", f"p{i % 2}" if i % 9 else None, f"h{i % 3}" if i % 7 else None) for i in range(60)] + [(60, "0.5", "p9", "alone")]
    monkeypatch.setattr(quality, "evidence", lambda fitted, text: F.col(text).cast("double"))
    got = {r.doc_id: r for r in quality.hierarchical_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), quality.QualityModel(None)).collect()}
    p = {i: float(t) for i, t, _, _ in rows}
    site = {i: (h, lang) for i, _, lang, h in rows}

    def strength(groups):
        kept = [g for g in groups if len(g) >= 2]
        n, k = sum(map(len, kept)), sum(map(sum, kept))
        means = [sum(g) / len(g) for g in kept]
        mu = k / n
        spread = sum(m * m for m in means) / len(means) - (sum(means) / len(means)) ** 2 - mu * (1 - mu) * sum(1 / len(g) for g in kept) / len(kept)
        return min(max(mu * (1 - mu) / max(spread, 1e-9) - 1, 1), 1e4)

    hosts, paths = {}, {}
    for i, s in site.items():
        hosts.setdefault(s[0], []).append(p[i])
        paths.setdefault(s, []).append(p[i])
    mu, mh, mp = sum(p.values()) / len(p), strength(hosts.values()), strength(paths.values())
    logit = lambda x: np.log(x / (1 - x))
    for i, s in site.items():
        host = (sum(hosts[s[0]]) - p[i] + mh * mu) / (len(hosts[s[0]]) - 1 + mh)
        path = (sum(paths[s]) - p[i] + mp * host) / (len(paths[s]) - 1 + mp)
        score = 1 / (1 + np.exp(-(logit(p[i]) + logit(path) - logit(mu))))
        assert (got[i].host_posterior, got[i].path_posterior, got[i].score) == (pytest.approx(host), pytest.approx(path), pytest.approx(score)) and not got[i].rejected


def test_few_rows_of_a_label_are_learnt_all_the_same():
    assert langid.held([("a",)] * 6 + [("b",)]) == [False] * 4 + [True, False, False]


def test_warc_round_trip_and_salvage(spark, tmp_path):
    pages = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, "u3\r\nX: y", None), (4, None, ""), (5, "u5", "é" * 100_000), (None, "u6", "WARC/1.1\r\n\r\n\r\n"), (7, "u7", "<p>a</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.archived(df).collect()
    assert len(got) == 7 and all(r.kind == "record" for r in got)
    by = {r.record_id: r for r in got}
    assert by["<urn:page:1>"].record_type == by["<urn:page:2>"].record_type == "revisit" and by["<urn:page:1>"].refers_to == "<urn:page:7>"
    assert by["<urn:page:3>"].refers_to == "<urn:page:4>" and by["<urn:page:5>"].payload == ("é" * 100_000).encode() and by[None].payload == b"WARC/1.1\r\n\r\n\r\n"
    assert by["<urn:page:1>"].payload_digest == base64.b32encode(hashlib.sha1(b"<p>a</p>").digest()).decode() and by["<urn:page:1>"].payload_bytes == 8
    assert warc.archived(df.limit(0)).count() == 0
    for compress in (True, False):
        parts = [warc.record_bytes([("WARC-Type", "response"), ("WARC-Payload-Digest", f"sha1:{warc.base32_sha1(b'p%d' % i)}")], b"p%d" % i, compress) for i in range(5)]
        data = bytearray(b"".join(parts))
        at = len(parts[0]) + len(parts[1]) // 2
        data[at] ^= 0x55
        del data[-7:]
        found = list(warc.salvage(bytes(data)))
        assert [f[5] for f in found if f[0] == "record"] == [b"p0", b"p2", b"p3"] + [b"p4"] * compress  # only the member's own checksum is cut off
        assert [f[1:3] for f in found if f[0] == "gap"] == [(len(parts[0]), len(parts[0]) + len(parts[1])), (sum(map(len, parts[:4])), len(data))]


def test_salvage_reads_foreign_and_damaged_archives():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>body"
    rec = lambda i, **more: warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", i), *more.items()], b"x%d" % i, False)
    r = warc.record_bytes([("WARC-Type", "response"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + warc.base32_sha1(b"<p>body"))], http)
    assert [f[5] for f in warc.salvage(r)] == [b"<p>body"]
    bad = rec(2, **{"WARC-Block-Digest": "sha1:" + warc.base32_sha1(b"other")})
    import gzip

    many = gzip.compress(b"\r\n" + rec(1) + bad + rec(3) + b"\r\n\r\n")
    found = list(warc.salvage(many + gzip.compress(rec(4))))
    assert [f[5] for f in found if f[0] == "record"] == [b"x1", b"x3", b"x4"] and [f[3] for f in found if f[0] == "gap"] == [2 + len(rec(1))]
    long = gzip.compress(b"".join(rec(i) for i in range(2000)), 1)
    cut = [f[5] for f in warc.salvage(long[: len(long) * 3 // 4]) if f[0] == "record"]
    assert len(cut) > 1000 and cut == [b"x%d" % i for i in range(len(cut))]
    for text in ("\u00b2", "9" * 5000, "-1", "1.5", ""):
        plain = f"WARC/1.1\r\nContent-Length: {text}\r\nX-Payload-Length: {text}\r\n\r\nab\r\n\r\n".encode()
        assert [f[0] for f in warc.salvage(plain + rec(5))] == ["gap", "record"]
    rng = random.Random(9)
    parts = [rec(i) if i % 2 else gzip.compress(rec(i) + rec(i + 100)) for i in range(6)]
    for _ in range(1000):
        data = bytearray(b"".join(rng.sample(parts, 4)))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data))
            data[at : at + rng.randint(0, 3)] = rng.randbytes(rng.randint(0, 3))
        places = [(f[1], f[2]) for f in warc.salvage(bytes(data)) if f[3] is None or f[0] == "record"]
        assert all(0 <= a < b <= len(data) for a, b in places)


def test_reading_takes_linear_time():
    import time

    took = []
    for n in (500, 4000):
        data = b"".join(warc.record_bytes([("WARC-Type", "response")], random.Random(i).randbytes(2000)) for i in range(n))
        began = time.process_time()
        assert sum(f[0] == "record" for f in warc.salvage(data)) == n
        took.append((time.process_time() - began) / n)
    assert took[1] < 3 * took[0]


def test_html_never_fails():
    rng = random.Random(10)
    bits = "<table> </table> <tr> <td> <td\tcolspan=\u00b2\trowspan=3> </td> <form> <div> </div> <p> <li> <ul> </ul> <ol\treversed> <![ <![foo[bar]]> <!-- --> <! <? > < & &amp; &#x; &#99999999999; <b> </b> <a> </a> <head> <body> <caption> <colgroup> <col> <select> <option> <script> </script> <textarea> <title> <svg> </svg> <pre> text \u00b2 <br> <img\talt=x> <dl> <dt> <dd> <button> <ruby> <rt> </p> <h1\thidden> <tbody> </html> a='".split(" ")
    for _ in range(10_000):
        html.render("".join(rng.choice(bits) for _ in range(rng.randint(1, 60))))
    digits = "9" * 5000
    assert html.render(f"<table><tr><td colspan={digits} rowspan=\u00b2>a<td>b</table>") == "a  b" and html.render("<![foo[bar]]>x") == "x"
    assert "z" in html.render("<table><tr><td>" * 1500 + "z") and html.render("<ul><li>" * 300 + "z").endswith("- z")


def test_html_spans_visibility_and_numbers():
    assert html.render("<table><tr><td rowspan=2>one<td>b<tr><td>c<tr><td>d<td>e</table>") == "one  b\n     c\nd    e"
    assert html.render("<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>c</table>") == "wide cell  x\na  b  c"
    assert html.render("<p style='visibility: hidden'>no<b style='VISIBILITY:visible'>yes</b><p>z<p style='color:red;visibility:hidden'>no<img alt=no>") == "yes\n\nz"
    assert html.render("<ol reversed><li>a<li value=9>b<li>c</ol><ol><li value=5>d<li>e</ol>") == "3. a\n9. b\n8. c\n\n5. d\n6. e"
    assert html.render("<div style='display:none'><b style='visibility:visible'>no</b></div>a") == "a"


def test_html():
    page = "<title>t</title><p>a<p>b <b>c</b><ul><li>one<li>two</ul><ol start=3><li>x<li>y</ol><table><tr><th>Name<th>N<tr><td>long name<td>1</table><div hidden>no</div><p style='display:none'>no<pre> a\n  b</pre>&copy;<script>no</script>"
    assert html.render(page) == "a\n\nb c\n\n- one\n- two\n\n3. x\n4. y\n\nName       N\nlong name  1\n\n a\n  b\n\n©"
    assert html.render(None) == html.render("") == "" and html.render("<div>" * 20_000 + "x") == "x"
    assert html.render("a<br><br>b &lt; c") == "a\n\nb < c" and "z" in html.render("<table><tr><td>" * 300 + "z")


def test_html_loses_no_visible_text():
    cells = "a  b\n\nc  d"
    for page, want in [
        ("<table><form><tr><td>a</td><td>b</td></tr></form></table>", "a  b"),
        ("<table><tr><form><td>a<td>b</form></table>", "a  b"),
        ("<table><div>text</div><tr><td>a<td>b</table>", "text\n\na  b"),
        ("<table><div>text<tr><td>a<td>b</table>", "text\n\na  b"),
        ("<table><tr><a href=x>link</a><td>a</table>z", "link\n\na\n\nz"),
        ("<table><colgroup><col>text<tr><td>a</table>", "text\n\na"),
        ("<table><tr><td>a<td>b<table><tr><td>c</table></table>", "a  b\n   \n   c"),
        ("<table><tr><td>a<td>b<tr><table><tr><td>c<td>d</table>", cells),
        ("<html><head><title>t</title>first <b>bold</b><p>x", "first bold\n\nx"),
        ("<head><meta charset=x><span>s</span> t", "s t"),
        ("<p>x <math><mi>y</mi><annotation>no</annotation></math>", "x y"),
        ("<tr>text", "text"), ("<tbody>text<p>x", "text\n\nx"), ("<div><tfoot>text", "text"),
    ]:
        got = html.render(page)
        assert [x.split() for x in got.splitlines() if x.strip()] == [x.split() for x in want.splitlines() if x.strip()], (page, got)


def test_html_column(spark):
    df = spark.createDataFrame([(1, None), (2, "<p>x")], "page_id long, html string")
    assert {r.page_id: r.text for r in html.page_texts(df).collect()} == {1: "", 2: "x"}


def test_sharding(spark):
    df = corpus(spark, EDGES + ["same"] * 400)
    rows = sharding.shards_of(df).collect()
    import zlib

    for r, t in ((r, (EDGES + ["same"] * 400)[r.doc_id]) for r in rows):
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({r.shard for r in rows}) == 8 and sorted(sharding.shards_of(df.repartition(3)).collect()) == sorted(rows)
    assert sharding.shards_of(df.limit(0)).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = corpus(spark, ["x"] * 2000)
    for shards in (1, 3, 7, 8, 11):
        rows = sharding.shards_of(df, shards=shards).collect()
        assert all(r.grown_shard in (r.shard, shards) for r in rows) and {r.shard for r in rows} == set(range(shards))
        moved = sum(r.grown_shard == shards for r in rows)
        assert abs(moved / 2000 - 1 / (shards + 1)) < 0.05
    grown = {r.doc_id: r.shard for r in sharding.shards_of(df, shards=8, founded=7).collect()}
    assert grown == {r.doc_id: r.grown_shard for r in sharding.shards_of(df, shards=7).collect()}


def test_slots_and_places_equal_a_plain_version(spark):
    from pyspark.sql import functions as F

    df = corpus(spark, ["t%d" % i for i in range(300)])
    got = {r.doc_id: r for r in sharding.shards_of(df).collect()}
    key = F.col("doc_id").cast("string")
    names = {f"{n}": n for n in ["r0", "r1", *[f"r{r}/k{k}" for r in (0, 1) for k in (2 * r, 2 * r + 1)], *[f"r{s // 4}/k{s // 2}/{s}" for s in range(8)]]}
    hashes = df.select("doc_id", *[F.xxhash64(F.lit(n), key).alias(a) for a, n in names.items()]).collect()
    draw = lambda h, w: -np.log((((h % 2**64) >> 11) + 0.5) / 2**53) / w
    for row in hashes:
        region = min(("r0", "r1"), key=lambda n: draw(row[n], 4.0))
        rack = min([f"{region}/k{k}" for k in (0, 1, 2, 3) if f"{region}/k{k}" in names], key=lambda n: draw(row[n], 2.0))
        shard = min([n for n in names if n.startswith(rack + "/")], key=lambda n: draw(row[n], 1.0))
        assert got[row.doc_id].shard == int(shard.rsplit("/")[-1])


def test_weights_move_rows_into_the_changed_subtree_only(spark):
    from pyspark.sql import functions as F

    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    a, b = sharding.tree_of(8), sharding.tree_of(8, weights={5: 3.0})
    moved = keys.select(sharding.place(F.col("k"), a).alias("a"), sharding.place(F.col("k"), b).alias("b")).where("a <> b")
    assert moved.count() > 100 and moved.where("b < 4").count() == 0  # shard 5 lies in the region of shards 4 to 7
    share = keys.select(sharding.place(F.col("k"), b).alias("b")).groupBy("b").count().collect()
    assert abs({r.b: r["count"] for r in share}[5] / 4000 - 0.3) < 0.03


def test_audio(spark):
    p = audio.TEXT_AS_AUDIO
    rng = random.Random(6)
    one, two = prose(rng, 600), prose(rng, 600)
    near = one[:1500] + "zz" + one[1500:]
    x, y, z = (audio.fingerprint(audio.samples_of(t.encode(), "u8"), p) for t in (one, near, two))
    assert audio.align(x, x) == (0, len(x), 0.0) and audio.align(x[5:], x)[0] == -5
    assert audio.aligned(x, y, p) and not audio.aligned(x, z, p)
    df = spark.createDataFrame([(1, one.encode()), (2, near.encode()), (3, two.encode()), (4, one.encode()), (5, None), (6, b""), (7, b"short")], "doc_id long, audio binary")
    got = {r.doc_id: r for r in audio.recordings(df, params=p).collect()}
    assert {i: (r.class_id, r.recording_id) for i, r in got.items()} == {1: (1, 1), 2: (2, 1), 3: (3, 3), 4: (1, 1), 5: (5, 5), 6: (6, 6), 7: (7, 7)}
    assert got[1].links == got[2].links == 1 and got[2].bit_error < 0.2 and got[5].offset is None
    assert audio.recordings(df.limit(0), params=p).count() == 0
    tone = (np.sin(np.arange(60000) * 2 * np.pi * 440 / 11025) * 20000).astype("<i2").tobytes()
    assert len(audio.fingerprint(audio.samples_of(b"RIFF0000WAVEfmt xxxxdata" + len(tone).to_bytes(4, "little") + tone, "s16"), audio.Chroma())) > 0


def plain_recordings(texts, p):
    """(recording, links) of texts with distinct fingerprints by aligning all pairs."""
    prints = [audio.fingerprint(audio.samples_of(t.encode(), "u8"), p) for t in texts]
    label, links = list(range(len(texts))), [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if audio.aligned(prints[j], prints[i], p):
                links[i] += 1
                links[j] += 1
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label, links


def variants(rng, n):
    """Texts, each with copies of a few edits and excerpts at any place."""
    texts = []
    for _ in range(n):
        t = prose(rng, rng.randint(500, 1_500))
        texts.append(t)
        for edits in (1, 3, 10):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(WORDS) + "x" * rng.randint(0, 3)
            texts.append(" ".join(w))
        for _ in range(3):
            size = rng.randint(len(t) // 3, len(t))
            at = rng.randint(0, len(t) - size)
            texts.append(t[at : at + size])
    return texts


def test_audio_finds_nine_of_ten_links(spark):
    p, rng = audio.TEXT_AS_AUDIO, random.Random(7)
    texts = variants(rng, 28) + [prose(rng, k) for k in range(1, 8)]
    prints = [audio.fingerprint(audio.samples_of(t.encode(), "u8"), p) for t in texts]
    got = {r.doc_id: r for r in audio.recordings(spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "doc_id long, audio binary"), params=p).collect()}
    found = links = 0
    for i in range(len(texts)):
        for j in range(i):
            if audio.aligned(prints[j], prints[i], p):
                assert i // 7 == j // 7  # no link between unrelated texts
                links += 1
                found += got[i].recording_id == got[j].recording_id
            assert i // 7 == j // 7 or got[i].recording_id != got[j].recording_id
    assert links > 400 and found >= 0.9 * links


def test_audio_finds_links_of_the_documents(spark):
    p = audio.TEXT_AS_AUDIO
    got = {r.doc_id: r for r in queries.op1_chroma(spark, "/root/testdata/sf0.01").collect()}
    first: dict = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        x = audio.fingerprint(audio.samples_of((r.text or "").encode(), p.sample), p)
        if len(x) >= p.least:
            first.setdefault(x.tobytes(), (r.doc_id, x))
    ids, prints = zip(*first.values())
    shelf, links, found, true = audio.Shelf(list(prints)), 0, 0, dict.fromkeys(ids, 0)
    for i, x in enumerate(prints):
        later = np.arange(i + 1, len(prints))
        for j in later[shelf.aligned(x, later, p)].tolist():
            links += 1
            found += got[ids[i]].recording_id == got[ids[j]].recording_id
            true[ids[i]] += 1
            true[ids[j]] += 1
    assert links >= 20 and found >= 0.9 * links
    assert sum(got[d].links == n for d, n in true.items()) >= 0.99 * len(true)


def test_audio_counts_every_link(spark, monkeypatch):
    p, rng = audio.TEXT_AS_AUDIO, random.Random(8)
    one, long = prose(rng, 900), prose(rng, 20_000)
    texts = [one[: 2_500 + 7 * k] + "zq"[k % 2] * (1 + k) + one[2_500 + 7 * k :] for k in range(12)]
    texts += [long] + [long[p.hop * k : p.hop * k + 4_300] for k in (300, 900, 1_500, 2_000)] + [prose(rng, 30)]
    label, links = plain_recordings(texts, p)
    df = spark.createDataFrame([(i, t.encode(), i) for i, t in enumerate(texts)], "doc_id long, audio binary, node long")
    df = df.unionByName(df.where("doc_id < 4"))
    assert max(links[:12]) > 2 and label[12:17] == [12] * 5
    for block, hot in ((5, 32), (2048, 3)):  # lists in blocks, and lists dealt out in parts
        monkeypatch.setattr(_links, "BLOCK", block)
        monkeypatch.setattr(audio, "BLOCK", block)
        monkeypatch.setattr(audio, "COUNTED", block)
        monkeypatch.setattr(audio, "HOT", hot)
        got = audio.recordings(df, params=p).collect()
        assert len(got) == len(texts) + 4 and all((r.recording_id, r.links) == (label[r.doc_id], links[r.doc_id]) for r in got)


def test_all_equal_words_vote():
    rng = np.random.default_rng(1)
    # The common value says offset 0 or more; 300 rare ones, each in both once, say 40.
    rare = rng.integers(1, 1 << 32, 340, dtype=np.uint32)
    a = np.concatenate([rare[:40], np.repeat(np.uint32(0), 400), rare[40:]])
    assert audio.align(a, a[40:])[0] == 40 and audio.align(np.zeros(3000, np.uint32), np.zeros(2000, np.uint32)) == (0, 2000, 0.0)
    assert audio.words(np.array([0xAAAAAAAA, 0x55555555, 0x80000002], np.uint32)).tolist() == [0xFFFF, 0, 0x8001]
    p = audio.TEXT_AS_AUDIO
    for _ in range(20):
        x, y = (np.minimum(rng.integers(0, 4, rng.integers(1, 1500)), 2).astype(np.uint32) * np.uint32(0x80000001) for _ in range(2))
        u, v = audio.words(x), audio.words(y)
        plain = np.array([int((u[max(k, 0) :][: len(v) - max(-k, 0)] == v[max(-k, 0) :][: len(u) - max(k, 0)]).sum()) for k in range(1 - len(v), len(u))])
        assert audio._votes(u, v).tolist() == plain.tolist()
        assert audio.Shelf([y, x]).aligned(x, np.arange(2), p).tolist() == [audio.aligned(x, y, p), audio.aligned(x, x, p)]
        many = audio._aligned_many([x, y, x, x[:0]], [y, x, x, y])
        assert np.array(many).T.tolist() == [list(audio._aligned(u, v)) for u, v in ((x, y), (y, x), (x, x), (x[:0], y))]


def test_alike_joins_chains_within_lists():
    p = audio.TEXT_AS_AUDIO
    around = np.array([0, 0b1, -1, 0b1111 << 8 | 1, 0, 0], np.int64)
    there = np.full(6, -1, np.int8)
    assert audio.alike(np.array([1, 1, 1, 1, 2, 3]), around, there, p).tolist() == [0, 0, 2, 0, 4, 5]
    assert audio.alike(np.zeros(0, np.int64), around[:0], there[:0], p).tolist() == []
    pairs: list = []
    audio.alike(np.array([1, 1, 1, 1, 2, 3]), around, there, p, pairs)
    assert sorted(zip(*(x.tolist() for x in pairs))) == [(0, 1), (0, 3), (1, 3)]
    copies: list = []
    assert audio.alike(np.ones(40, np.int64), np.zeros(40, np.int64), np.full(40, -1, np.int8), p, copies).tolist() == [0] * 40 and not len(copies[0])
    assert audio.alike(np.array([1, 1]), around[[0, 2]], np.zeros(2, np.int8), p).tolist() == [0, 0]  # nothing around to tell them apart


def test_keep_one_decides_by_row(spark):
    rng = random.Random(11)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    near = a + " more"
    rows = [(1, a), (None, near), (None, b), (None, c), (None, c), (2, d), (2, e), (2, e), (3, None), (3, None), (None, None), (None, ""), (None, " ")]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(map(tuple, got), key=key) == sorted([(1, a), (None, b), (None, c), (2, d), (2, e), (3, None), (None, None), (None, ""), (None, " ")], key=key)


def stage_corpus(spark, path, texts, labels):
    df = corpus(spark, texts).drop("node")
    df.unionByName(df.where("doc_id between 40 and 44")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_mixed_stage_samples_by_quality(spark, tmp_path):
    from math import log

    import corpus_pipeline as cp

    rng = random.Random(12)
    texts = [None, ""] + [prose(rng, rng.randint(1, 60)) for _ in range(150)]
    quality_of = {i: i % 2 for i in range(0, 152) if i % 5}
    path = stage_corpus(spark, tmp_path, texts, [(i, q, 0) for i, q in quality_of.items()] + [(3, 0, 0)])
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id not between 40 and 44")
    rows = docs.collect()
    goals = {r.source: r for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()}
    want = []
    for source in {r.source for r in rows}:
        key = lambda r: -log((int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / {1: 2.0, 0: 0.5, None: 1.0}[quality_of.get(r.doc_id)]
        goal, start = goals[source], 0
        rest = round(goal.target) - goal.epochs * goal.source_size
        for r in sorted((r for r in rows if r.source == source), key=key):
            n = len((r.text or "").split())
            want += [r.doc_id] * (n and goal.epochs + (2 * min(max(rest - start, 0), n) >= n))
            start += n
    assert sorted(r.doc_id for r in cp.mixed(spark, docs, path).collect()) == sorted(want)
    assert cp.mixed(spark, docs.limit(0), path).count() == 0


def test_pipeline_runs_all_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(13)
    texts = [None, ""] + [prose(rng, 40) for _ in range(120)]
    texts += [texts[50] + " end", texts[51]]
    path = stage_corpus(spark, tmp_path / "some", texts, [(i, 1, 0) for i in range(2, 60)])
    rows = cp.run(spark, path).collect()
    assert rows and all(r.round_trip for r in rows) and {r.doc_id for r in rows} <= set(range(2, 122))
    empty = stage_corpus(spark, tmp_path / "none", [], [])
    assert cp.run(spark, empty).count() == 0
