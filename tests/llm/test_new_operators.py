"""Operators 11 to 13 against plain versions and edge cases."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import hardneg, lattice, queries, ranked

EDGES = [None, "", "  \t\n", "One", "Zwei Wörter", "The  QUICK brown fox", "a b c d e", "a b c d e", "é", "word " * 30_000, "x" * 60_000, "日本語 テキスト", "it's I'll - '", "▁low ▁ ▁▁line"]
WORDS = "the of and to in is was for that with river stone light garden winter summer market engine paper silver".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


# --- hard negatives ---


def plain_negatives(rows, every, positives=5, negatives=5):
    """rows: (id, vector, label) with fit vectors."""
    quant = [(i, [math.floor(256 * float(x)) for x in v], (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]
    out = []
    for i, q, lab in quant:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, r)), j, other == lab) for j, r, other in quant if j != i]
        for ps, p, _ in sorted(x for x in scored if x[2])[:positives]:
            fit = sorted((s, j) for s, j, same in scored if not same and 80 * -ps <= 100 * -s <= 100 * -ps)[:negatives]
            out += [(i, p, k + 1, j, -ps, -s) for k, (s, j) in enumerate(fit)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, q string, piece int")


def mined(df, every=10):
    from pyspark.sql import functions as F

    out = hardneg.mine(df, F.col("vec_id") % every == 0, noise=F.col("vec_id") % 7 == 0)
    return sorted(map(tuple, out.collect()))


def test_hard_negatives_equal_brute_force_with_lengths_ties_and_copies(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    x = (centres[rng.integers(0, 6, 400)] + 0.15 * rng.normal(size=(400, 16))) * rng.choice([0.3, 1, 1, 2], 400)[:, None]
    x[50:90] = x[50]  # copies
    x[200:220] = np.round(x[200:220], 1)  # ties
    x[300] = 0
    rows = [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, 10))) for i, v in enumerate(x)]
    want = plain_negatives(rows, 10)
    assert len(want) > 100
    monkeypatch.setattr(hardneg, "PIECE", 64)
    monkeypatch.setattr(hardneg, "GROUP", 16)
    assert mined(vectors(spark, rows)) == want


def test_coordinate_ranges_lose_no_row_and_prune():
    rng = np.random.default_rng(8)
    rows = np.floor(256 * (np.repeat(rng.normal(size=(40, 12)), 50, axis=0) + 0.1 * rng.normal(size=(2000, 12))))
    buckets, asked, seen = hardneg.Buckets(rows), np.full(20, 0.0), 0
    anchors = rows[::100]
    exact = hardneg._products(anchors, rows)
    asked = np.sort(exact, axis=1)[:, -20].astype(float)
    found = set()

    def take(i, j, s):
        nonlocal seen
        seen += len(i)
        assert (exact[i, j] == s).all()
        found.update(zip(i.tolist(), j.tolist()))

    hardneg.search(anchors, asked, buckets, take)
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero(exact >= asked[:, None]))} <= found
    few = [buckets.candidates(k, a / np.linalg.norm(a), np.argsort(-np.abs(a))[:4], 0.95) for k in range(len(buckets.cuts)) for a in anchors]
    assert sum(x is not None for x in few) > len(few) // 2


def test_hard_negatives_edges(spark):
    ok = [(0, [1.0, 0.0], 1), (2, [0.9, 0.1], 1), (3, [0.8, 0.2], 2), (4, [0.85, 0.1], 3), (10, [0.2, 1.0], 1)]
    bad = [(20, None, 1), (30, [1.0, None], 1), (40, [float("nan"), 1.0], 1), (50, [float("inf"), 1.0], 1), (60, [1.0, 0.0], None), (None, [0.1, 0.1], 5)]
    assert mined(vectors(spark, ok + bad)) == plain_negatives(ok, 10)
    assert mined(vectors(spark, [])) == []
    assert mined(vectors(spark, [(0, [1.0], 1)])) == []
    # Vectors of several lengths compare by what both have; numbers beyond a double's exact range stay exact.
    odd = [(0, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0], 1), (3, [1.0], 2), (4, [], 2), (5, [1.0, 2.0, 0.0, 9.0], 3), (10, [], 1)]
    assert mined(vectors(spark, odd)) == plain_negatives(odd, 10)
    big = np.array([[2.0**30 + 1, 3.0]])
    assert hardneg._products(big, big)[0, 0] == (2**30 + 1) ** 2 + 9
    # A repeated anchor counts once; repeated rows each count.
    again = [ok[4], *ok, ok[2], ok[3]]
    want = sorted(set(plain_negatives(again, 10)))
    assert mined(vectors(spark, again)) == want and any(x[3] == y[3] and x[2] != y[2] and x[:2] == y[:2] for x in want for y in want)


# --- ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=20):
    bags = [terms(t) for _, t in docs]
    n, total = sum(map(bool, bags)), sum(map(len, bags))
    df = {}
    for b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for (doc, _), b in zip(docs, bags):
            s = 0
            for t in terms(text):
                tf = b.count(t)
                if tf:
                    m = 75 + (25 * len(b) * n) // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, shard int, term string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ranked.search(ranked.build_index(d), q, k).collect()), key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, t) for i, t in enumerate(EDGES)] + [(100 + i, prose(rng, rng.choice([3, 20, 60, 200]))) for i in range(400)]
    docs += [(1000 + i, "silver paper engine" + " silver" * (i % 3)) for i in range(60)]
    items = [(i, prose(rng, rng.choice([1, 3, 12]))) for i in range(12)] + [(20, None), (21, ""), (22, "absent"), (23, "silver Silver PAPER paper wört"), (24, "日本語 é")]
    want = plain_search(docs, items)
    monkeypatch.setattr(ranked, "BLOCK", 4)
    monkeypatch.setattr(ranked, "FIRST_WINDOW", 8)
    monkeypatch.setattr(ranked, "SHARD_DOCUMENTS", 100)
    monkeypatch.setattr(ranked, "ITEMS", 5)
    assert searched(spark, docs, items) == want


def test_search_rejects_blocks_unread():
    ids = np.arange(20_000)
    text = ["common rare" if i % 97 == 5 else "common filler" if i % 2 else "common other filler filler" for i in range(20_000)]
    words = pa.array(["common", "rare", "filler", "other"], pa.large_string())
    at = {w.as_py(): k for k, w in enumerate(words)}
    docs = np.concatenate([np.full(len(t.split()), i) for i, t in enumerate(text)])
    of = np.array([at[w] for t in text for w in t.split()])
    sizes = np.array([len(t.split()) for t in text])
    rows = ranked._shard(0, ids, sizes, docs, of, words).to_pylist()
    lists = {r["term"]: ranked._List(r["ends"], r["peaks"], r["cuts"], r["data"]) for r in rows[1:]}
    shard = ranked.Searcher(ids, sizes, lists, 20_000, int(sizes.sum()))
    got = shard.top([("rare", 6000), ("common", 1)], 20)
    assert [ids[p] % 97 for p, _ in got] == [5] * 20 and got[0][0] == 5
    assert len(lists["common"].open) < len(lists["common"].ends) // 2


def test_search_edges(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, None), (2, " - ")], [(1, "a")]) == []
    assert searched(spark, [(1, "a b")], []) == []
    # Repeated documents each take a rank, a null id comes last, an item in every document weighs nothing but is no error.
    docs = [(5, "blue fish"), (5, "blue fish"), (None, "blue fish"), (7, "red"), (8, "red"), (9, "red"), (10, "green")]
    items = [(1, "blue"), (1, "blue"), (2, "BLUE blue"), (None, "red")]
    assert searched(spark, docs, items) == plain_search(docs, [items[0], *items[2:]])


# --- lattice likelihood ---


def plain_lattice(items, logp, word):
    """Sum over all segmentations, by listing them."""
    at, total, text = {x: p for x, p in zip(items, np.exp(logp))}, 0.0, b" " + word
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        p, start = 1.0, 0
        for i, c in enumerate([*cuts, 1]):
            if c:
                p *= at.get(text[start : i + 1], 0.0)
                start = i + 1
        total += p
    return total


def small_pieces(seed=0):
    items = tuple([bytes([c]) for c in range(256)] + [b" a", b" ab", b"ab", b"ba", b"bab", b" ba", "é".encode(), b"aaa"])
    p = np.random.default_rng(seed).random(len(items))
    return items, np.log(p / p.sum())


def test_forward_sums_equal_all_segmentations_and_backward_counts_agree():
    items, logp = small_pieces()
    words = ["abab", "a", "babab", "é", "aaaaab", "bé"]
    got = lattice.word_logs(items, logp[None], pa.array(words))[0]
    for w, x in zip(words, got):
        assert math.isclose(math.exp(x), plain_lattice(items, logp, w.encode()), rel_tol=1e-9)
    # Expected counts are derivatives of the log likelihood.
    counts = lattice.expected_counts(items, logp, pa.array(words), np.array([3.0, 1, 2, 1, 1, 1]))
    for k in (ord("a"), 257, 258, 260):
        moved = logp.copy()
        moved[k] += 1e-6
        up = lattice.word_logs(items, moved[None], pa.array(words))[0]
        assert math.isclose(((up - got) * [3, 1, 2, 1, 1, 1]).sum() / 1e-6, counts[k], rel_tol=1e-4, abs_tol=1e-6)


def test_word_probabilities_add_up_to_one():
    """Over an alphabet of two bytes, words of up to n bytes hold all but what longer ones do."""
    items = (*(bytes([c]) for c in range(256)), b" a", b" ab", b"ab", b"ba")
    p = np.zeros(len(items))
    p[[0x20, ord("a"), ord("b"), 256, 257, 258, 259]] = [0.1, 0.1, 0.05, 0.3, 0.2, 0.15, 0.1]
    with np.errstate(divide="ignore"):
        logp = np.log(p)
    words = ["".join(w) for n in range(1, 13) for w in itertools.product("ab", repeat=n)]
    low = np.exp(lattice.word_logs(items, logp[None], pa.array(words))[0])
    assert 0.99 < low.sum() + p[0x20] * 0.6 / (1 - 0.4) * 0 + p[0x20] <= 1.0 + 1e-9


def scored(spark, texts, hold=lambda i: False, **options):
    rows = [(i, t, "en" if i % 2 else "de", 0, 0.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, base double").repartition(3)
    kept = [i for i in range(len(texts)) if not hold(i)]
    model, counts = lattice.train(df.where(df.doc_id.isin(kept)) if len(kept) < len(texts) else df, queries.piece_path(), **options)
    return model, {r.doc_id: r for r in lattice.score(df, model, counts).collect()}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("head", [1 << 16, 5, 0])
def test_scores_equal_a_plain_version(spark, monkeypatch, head):
    """Whatever share of the words the tasks hold: the same numbers."""
    monkeypatch.setattr(lattice, "HEAD_WORDS", head)
    rng = random.Random(2)
    texts = EDGES + [prose(rng, rng.choice([5, 30, 100])) for _ in range(60)] + ["rareword Anothér"]
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2} | {len(texts) - 1}
    model, got = scored(spark, texts, held.__contains__)
    counts, n, kinds = {}, 0, {}
    for i, t in enumerate(texts):
        if i not in held:
            for w in [*tokens(t), None]:
                counts[w] = counts.get(w, 0) + 1
                n += 1
                kinds[w] = kinds.get(w, np.zeros(2)) + np.eye(2)[0 if i % 2 == 0 else 1]
    names = [{"de": 0, "en": 1}[x] for x in model.names]
    v = len(counts)
    assert model.total() == n and model.documents == counts[None]
    logs = {}
    for w in {w for t in texts for w in tokens(t)}:
        c = np.array([[counts.get(w, 0)], *[[kinds.get(w, np.zeros(2))[z]] for z in names]], float)
        logs[w] = model.word_logs(pa.array([w]), c)[:, 0]
    end = counts[None] / n
    for i, t in enumerate(texts):
        r, ws = got[i], [*tokens(t), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws), abs_tol=2e-6, rel_tol=1e-9)
        ways = []
        for z in range(3):
            for u in model.urns:
                total, seen = model.prior[z] - math.log(len(model.urns)), {}
                for k, w in enumerate(ws[:-1]):
                    total += math.log((u * math.exp(logs[w][z]) + seen.get(w, 0)) / (u + k)) if logs[w][z] > -600 or w in seen else logs[w][z] + math.log(u / (u + k))
                    seen[w] = seen.get(w, 0) + 1
                ways.append(total)
        top = max(ways)
        want = (top + math.log(sum(math.exp(w - top) for w in ways)) + math.log(end) + (len(ws) - 1) * math.log1p(-end)) / math.log(10)
        assert math.isclose(r.score, want, abs_tol=1e-4, rel_tol=1e-7), (i, r.score, want)


def test_held_out_texts_do_not_teach_and_the_model_beats_the_base(spark):
    rng = random.Random(9)
    halves = WORDS[:10], WORDS[10:]  # each language has words of its own
    texts = [" ".join(rng.choice(halves[i % 2]) + rng.choice(["", "s"]) for _ in range(80)) for i in range(120)]
    _, got = scored(spark, [*texts, "unheard"], lambda i: i >= 100)
    assert got[120].n_known == 1
    assert sum(got[i].score for i in range(100, 120)) > sum(got[i].base_score for i in range(100, 120))
    # Shuffled letters are less likely than words, by the lattice alone.
    _, got = scored(spark, [*texts, "gardenstone lightriver", "drngaetseno rghtlieivr"], lambda i: i >= 120)
    assert got[120].score > got[121].score


def test_likelihood_edges(spark):
    _, got = scored(spark, [])
    assert got == {}
    model, got = scored(spark, ["a b", None], lambda i: True)  # nothing to learn from
    assert got[0].base_score == 0 and got[1].n_tokens == 1 and got[0].score < got[1].score <= 0
    model, got = scored(spark, [None, "", " "])
    assert model.total() == 3 and got[0].score == 0.0 or got[0].score > -1


# --- hostile input of earlier operators ---


def test_deep_and_broken_pages_take_linear_time():
    import time

    from strandline.llm import html

    began = time.time()
    assert html.render("<div>" * 100_000 + "x") == "x"
    assert html.render("<p><button>" + "<div>" * 50_000 + "x") == "x"
    assert html.render("a" + "<!--" * 50_000) == "a"
    assert time.time() - began < 30


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<input type=checkbox value=7><input type=PASSWORD value=s><input value=5>", "5"),
        ("a<!-- b", "a"), ("a<!-->b<!--->c<!-- --!>d", "abcd"),
        ("<details><summary>s</summary>body</details>", "s"), ("<details open><summary>s</summary>body</details>", "s\nbody"), ("x<details>body</details>", "x"),
        ("<textarea><b>x</b> &amp; y</textarea>", "<b>x</b> & y"), ("<textarea>open", "open"), ("<xmp><b>q</b></xmp>", "<b>q</b>"), ("<plaintext><b>q", "<b>q"),
        ('a<span style="display:block">b</span>c', "a\nb\nc"), ("<p>a<div>b</p>c", "a\n\nbc"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a  b\nc"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"), ("<a>x<a>y</a>z", "xyz"), ("<b><td>x</b>y", "xy"),
    ],
)
def test_what_pages_show(page, text):
    from strandline.llm import html

    assert [x for x in html.render(page).split("\n") if x] == [x for x in text.split("\n") if x]


def test_hostile_archives_take_linear_time_and_bounded_memory(monkeypatch):
    import gzip
    import time

    from strandline.llm import warc

    good = warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1>"), ("WARC-Payload-Digest", f"sha1:{warc.base32_sha1(b'hi')}")], b"hi")
    began = time.time()
    for junk in (b"WARC/1.1\r\n" * 200_000, b"WARC/1.1\r\na:b\r\n" * 100_000, b"\x1f\x8b\x08" * 400_000, b"\x1f\x8b\x08\x1f" * 200_000, random.Random(1).randbytes(2_000_000)):
        found = list(warc.salvage(junk + good + junk))
        assert [f[0] for f in found if f[0] == "record"] == ["record"] and sum(f[2] - f[1] for f in found) == 2 * len(junk) + len(good)
    assert time.time() - began < 60
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1 << 20)
    found = list(warc.salvage(gzip.compress(bytes(1 << 24)) + good))
    assert [f[0] for f in found] == ["gap", "record"]
