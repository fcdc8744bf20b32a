import hashlib
import itertools
import random
import re
import textwrap
import time
from html import escape

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import bpe, graph, html, langid, licenses, mixing, quality, rules, simhash, textstats, topk, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, fingerprint string, hits int"
LABELS = "doc_id bigint, quality int, toxic int"
A = "the quick brown fox jumps over the lazy dog and then it runs through the green wood until the night falls"
B = "der schnelle braune fuchs springt über den faulen hund und läuft dann durch den grünen wald bis in die nacht"


def rows():
    rng = random.Random(3)
    out = []
    for i in range(60):
        base, lang = ((A, "en"), (B, "de"))[i % 2]
        w = base.split()
        rng.shuffle(w)
        out.append((i, " ".join(w) if i % 5 else "## ".join(w), lang, f"src{i % 4}", 1, "x", "y", 7))
    odd = [(None, A, "en", None, None, None, None, None), (60, None, None, None, 0, "x", "y", 1), (61, "", "en", "src1", 0, "x", "y", 1), (62, "1 2 3\n\n", None, "src1", 5, None, None, None)]
    twice = [(63, A, "en", "src2", 1, "x", "y", 7)] * 2
    return out + odd + twice + [(64, (A + "\n") * 3000, "en", "src3", 1, "x", "y", 7), (65, "x" * 200_000, "en", "src3", 1, "x", "y", 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)] + [(61, None, None), (None, 1, 0)], LABELS)


def test_bpe(spark, docs):
    got = bpe.decode(bpe.encode(docs))
    for r in got.select("text", "ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256", "score").collect():
        raw = (r["text"] or "").encode()
        assert bytes(r["decoded"]) == raw and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(raw).hexdigest() and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
    assert bpe.encode(docs.limit(0)).count() == 0


def test_bpe_stretches():
    import public_tokenizers

    enc = bpe.encoder(bpe.rank_path(), public_tokenizers.PATTERN)
    rng = random.Random(1)
    text = "".join(rng.choice(["a", "Z9", " ", "\n", "é", "'s", "!", "  ", "日", "\t"]) for _ in range(4000))
    for size in (1, 7, 50):
        parts = bpe.stretches(text, size)
        assert max(map(len, parts)) < size + 200
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_bpe_white_space(monkeypatch):
    """Runs of white space that go to the library as single pieces; a run that its expression can't take."""
    import public_tokenizers

    enc = bpe.encoder(bpe.rank_path(), public_tokenizers.PATTERN)
    for text in (" " * 1_000_000, "a" + "\n" * 1_000_000 + "b"):
        assert enc.decode_bytes(bpe.encode_text(enc, text)) == text.encode()
    monkeypatch.setattr(bpe, "_BLANK", re.compile(bpe._BLANK.pattern.replace("16384", "3")))
    monkeypatch.setattr(bpe, "STRETCH", 40)
    rnd = random.Random(1)
    parts = ["a", "é", "1", "'s", ".", " ", "  ", "\n", "\r", "\t", "\x1c", "\u3000", "\xa0", "\x85", "    ", "\n\n\n", "\u200b"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(40, 120)))
        assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)


def test_language(spark, docs):
    model = langid.fit(docs)
    got = langid.identify(docs, model)
    assert got.columns[-5:] == ["lang_pred", "_score", "rejected", "cross_entropy", "n_letters"]
    got = got.drop("score").withColumnRenamed("_score", "score")
    r = {x["doc_id"]: x for x in got.collect()}
    assert got.count() == docs.count()
    assert all(r[i]["lang_pred"] == ("en", "de")[i % 2] and not r[i]["rejected"] and 0 <= r[i]["score"] <= 1 for i in range(60))
    assert [(r[i]["lang_pred"], r[i]["score"], r[i]["rejected"]) for i in (60, 61, 62)] == [("und", 0, True)] * 3
    kept = langid.accept(docs, model)
    assert kept.columns == docs.columns and {60, 61, 62}.isdisjoint(x["doc_id"] for x in kept.collect())
    none = langid.fit(docs.limit(0))
    assert {x[0] for x in langid.identify(docs, none).select("lang_pred").collect()} == {"und"}


def test_language_probabilities_sum_to_one():
    """Interpolated Kneser-Ney: over all next characters, known or not."""
    text = " the then there this that thin "
    counts = {}
    for i in range(len(text) - 3):
        counts[text[i : i + 4]] = counts.get(text[i : i + 4], 0) + 1
    model = langid.compile_model({"x": counts})
    known = sorted({c for g in counts for c in g})
    for ctx in (" th", "the", "zzz", "hen", "~~~", "xth"):
        p = [model.log_probs(np.array([ord(c) for c in ctx + k], np.uint32))[0, 0] for k in [*known, "~"]]
        assert sum(np.exp(p)) == pytest.approx(1, abs=1e-5)


def brute_repeats(words, width=5):
    seen = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + width)})


def test_statistics():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "c\n", "\n", "é#", " \x0b", "\xa0", "$ "]) for _ in range(rng.randint(0, 60)))
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        s = dict(zip(textstats.NAMES, textstats.stats(text), strict=True))
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), brute_repeats(w))
    assert textstats.stats(None) == textstats.stats("")


def test_quality(spark, docs, labels):
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [(r["score"], r["doc_id"] % 5 > 0) for r in got if r["held_out"] and r["doc_id"] < 60]
    assert np.mean([s >= 0.7 if good else s < 0.7 for s, good in held]) > 0.85
    assert all(r["score"] == pytest.approx(0.5, abs=0.01) for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_isotonic():
    y, w = np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8]), np.array([1, 1, 1, 2, 1, 1.0])
    got = quality.isotonic(y, w)
    assert (np.diff(got) >= -1e-12).all() and got[1] == pytest.approx(0.3) and got[4] == pytest.approx(0.85)


def test_rules(spark, docs, labels):
    got = {r["doc_id"]: r for r in rules.judge(docs, labels).collect()}
    assert not any(got[i]["kept"] for i in range(0, 60, 5)) and all(got[i]["kept"] for i in range(60) if i % 5)
    assert not got[60]["kept"] and not got[61]["kept"] and not got[64]["kept"]
    kept = rules.accept(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rules.judge(docs, labels).collect() if r["kept"])
    assert rules.judge(docs, labels.limit(0)).filter("rule > 0").count() == 0
    assert rules.accept(docs.limit(0), labels).count() == 0


def roots_of(n, edges):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for i, j in edges:
        a, b = find(i), find(j)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("n", [2, 4, 30, 700])
def test_links_of_a_cell(n):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 2**63, 6, dtype=np.uint64)[rng.integers(0, 6, n)]
    for _ in range(4):
        fps ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    fps = np.unique(fps)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3, 1))
    got = simhash.links(fps)
    assert all(int(fps[i] ^ fps[j]).bit_count() <= 3 for i, j in got)
    assert roots_of(len(fps), got) == roots_of(len(fps), near)


@pytest.mark.parametrize(("block", "segments"), [(4096, None), (16, 4), (16, 5), (100, 6)])
def test_links_of_classes(spark, block, segments):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64, 8, dtype=np.uint64)[rng.integers(0, 8, 400)]
    for _ in range(5):
        fps ^= np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64)
    fps = np.unique(fps)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got = [(place[r["u"]], place[r["v"]]) for r in simhash.link_classes(df, block, segments).collect()]
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3, 1))
    assert roots_of(len(fps), got) == roots_of(len(fps), near)


def test_simhash(spark, docs):
    import xxhash

    text = "Ab cd\tEF gh Ab cd ef"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(len(w) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest("a b", seed=42) and simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    got = simhash.groups(docs).collect()
    fps = np.array([r["fp"] for r in got], np.int64).view(np.uint64)
    root = roots_of(len(got), np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3, 1)))
    least = {}
    for r, k in zip(got, root, strict=True):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert len(got) == docs.count() and all(r["component_id"] == least.get(k) for r, k in zip(got, root, strict=True))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert simhash.groups(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_near_dedup_without_ids(spark):
    """Groups whose rows have null or repeated ids are not taken for one group."""
    texts = ["one two three four five", "six seven eight nine ten", "", None]
    rows = [(i, t) for i in (None, 5) for t in texts] + [(None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.keep_one(docs).collect()
    assert sorted(r["text"] or "" for r in kept) == sorted(texts[:3]) and all(r["doc_id"] == 5 for r in kept)
    none = simhash.keep_one(docs.filter("doc_id is null")).collect()
    assert sorted(r["text"] or "" for r in none) == sorted(texts[:3])


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(50)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    want = roots_of(200, edges)
    assert got == {i: want[i] for e in edges for i in e if e[0] != e[1] or any(i in x and x[0] != x[1] for x in edges)}


def fill(sizes, weights, total, cap):
    left, out = dict(sizes), {}
    while left:
        w = sum(weights[s] for s in left)
        room = total - sum(out.values())
        over = [s for s in left if room * weights[s] / w > cap * sizes[s]]
        if not over:
            return out | {s: room * weights[s] / w for s in left}
        for s in over:
            out[s] = cap * sizes[s]
            del left[s]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02}": rng.choice([1, 10, 100, 5000]) for i in range(rng.randint(1, 9))}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()), 2)
    assert {r["source"]: r["target"] for r in mixing.targets(df).collect()} == pytest.approx(want)


def test_mixing(spark, docs):
    plan = mixing.plan(docs).collect()
    assert len(plan) == docs.count() and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in plan)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_licenses(spark, docs):
    texts = ["a\nReleased under the MIT licence\nb", "RELEASED   under the MIT License!", licenses.NOTICES["MIT-grant"].replace(" ", "\n", 9), "released under", "", None, "under the license released mit", A + "\nLicensed under CC BY-NC 4.0."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("hits", F.lit(1))
    got = {r["doc_id"]: (r["license"], r["n_hits"]) for r in licenses.scan(df).collect()}

    def brute(t):
        best, n = None, 0
        lines = (t or "").split("\n")
        for u in lines + [" ".join(lines)] * (len(lines) > 1):
            b = set(licenses.bigrams_of(u))
            d = [(2 * len(b & set(x)) / (len(b) + len(x)), -i, k) for i, (k, v) in enumerate(sorted(licenses.templates_of().items())) for x in [licenses.bigrams_of(v)] if b]
            if d and max(d)[0] >= 0.8:
                n, best = n + 1, max(best or max(d), max(d))
        return best and best[2], n

    assert got == {i: brute(t) for i, t in enumerate(texts)} and got[1][0] == "MIT" and got[7][0] == "CC-BY-NC-4.0"
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(docs.limit(0)).count() == 0


def test_languages_of_few_documents_are_in_the_model(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij" if k % 2 else "klmnopqrst", k=6)) for _ in range(60)) for k in range(10)]
    df = spark.createDataFrame([(k, t, f"l{k}") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    model = langid.fit(df, learn=F.lit(True))
    assert sorted(model.langs) == sorted(f"l{k}" for k in range(10))
    assert all(r["lang"] == r["lang_pred"] and not r["rejected"] for r in langid.identify(df, model).collect())


def test_licenses_wrapped_or_among_other_words(spark):
    some = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    wrap = lambda name, n=6: "\n".join(" * " + " ".join(w[i : i + n]) for w in [licenses.NOTICES[name].split()] for i in range(0, len(w), n))
    long = "\n".join(some(9, k) for k in range(40))
    cases = [
        ("See the docs for more. The code here is licensed under the Apache License, Version 2.0.", "Apache-2.0", 1, 1.0),
        (f"{long}\n{wrap('Apache-2.0-header')}\n{long}", "Apache-2.0-header", 1, 1.0),
        (f"MIT License\n\nCopyright (c) 2020 A B\n\n{wrap('MIT-grant', 12)}\n\n{long}", "MIT-grant", 1, 1.0),
        (f"{some(30, 1)} {licenses.NOTICES['GPL-3.0-header']} {some(30, 2)}", "GPL-3.0-header", 1, 1.0),
        (f"{long}\n{wrap('MIT-grant').replace('sublicense', 'x')}\n{long}", "MIT-grant", 1, 2 * 60 / 124),
        (f"{long}\nReleased under the MIT License.\n{long}\n{wrap('GPL-3.0-header')}\n{some(5, 3)} {licenses.NOTICES['MIT']} {some(9, 4)}", "GPL-3.0-header", 3, 1.0),
        (f"{long} the license, the license; of the general public license", None, 0, None),
        ("of the license the license " * 3000 + long, None, 0, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id int, text string")
    got = {r["doc_id"]: (r["license"], r["n_hits"], r["dice"]) for r in licenses.scan(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_topk(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 24)).astype(float)
    v[100:160] = v[0]
    v[200:230] = np.abs(v[200])
    data = [(i, v[i].tolist(), i) for i in range(300)] + [(5, v[5].tolist(), 1), (400, None, 0), (420, [], 0), (None, v[1].tolist(), 0), (440, [1.0, None], 0), (460, [1.0, -1.0], 0)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, rank int")
    codes = topk.codes(df)
    got = topk.search(codes, codes.filter("id % 20 = 0"), 7, cell=64)
    ids, bits = np.array([*range(300), 5]), np.vstack([v > 0, v[5:6] > 0])
    want = []
    for q in range(0, 300, 20):
        d = (bits != bits[q]).sum(1)
        for k, i in enumerate(sorted(range(301), key=lambda i: (d[i], ids[i]))[:7], 1):
            want.append((q, k, int(ids[i]), int(d[i])))
    want.append((460, 1, 460, 0))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(codes.limit(0), codes.limit(0)).count() == 0


def test_topk_where_neighbours_are_far(spark):
    """Wide codes of few rows: more values at a radius than entries."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((60, 150))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "vec_id bigint, embedding array<double>")
    codes = topk.codes(df)
    got = sorted(map(tuple, topk.search(codes, codes.filter("id % 20 = 0"), 3, cell=16).collect()))
    bits = v > 0
    d = lambda q, i: int((bits[q] != bits[i]).sum())
    assert got == [(q, k, i, d(q, i)) for q in (0, 20, 40) for k, i in enumerate(sorted(range(60), key=lambda i: (d(q, i), i))[:3], 1)]


PAGES = "page_id bigint, url string, html string, text string"


def test_warc(spark):
    data = [(i, f"http://www.h{i % 3}.example.com:80/P{i}?q", f"<p>page {i % 7} ä</p>\r\n\r\nWARC/1.1\r\n", "x") for i in range(40)]
    data += [(40, None, None, None), (41, "odd\nurl", "", "y"), (None, "http://a/", "<p>page 1 ä</p>\r\n\r\nWARC/1.1\r\n", None), (42, "http://b/", "z" * 300_000, "x")]
    df = spark.createDataFrame(data, PAGES)
    got = warc.archive(df).collect()
    first = {}
    for i, _, h, _ in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    import base64

    for r in got:
        h = next(x[2] for x in data if x[0] == r["page_id"]) or ""
        raw = h.encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h] == r["page_id"] else ("revisit", first[h]))
    keys = [warc.key(tuple(r)) for r in sorted(got, key=lambda r: (r["part"], r["seq"]))]
    assert len(got) == len(data) and keys == sorted(keys)
    assert warc.archive(df.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in range(7):
        runs = [sorted([(rng.choice("abc"), str(rng.randrange(9)), rng.choice([None, 1, 2])) for _ in range(rng.randrange(9))], key=warc.key) for _ in range(k)]
        assert [warc.key(x) for x in warc.LoserTree([iter(r) for r in runs])] == sorted(warc.key(x) for r in runs for x in r)


def test_ranges_of_the_merge(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 5}.com/{i}", f"p{i}", "") for i in range(200)], PAGES)
    from lexloom.llm.common import shared_dir

    path = shared_dir(spark, "test")
    warc.write(df.repartition(5), path)
    got = sorted(warc.merged(warc.captures(spark, path), range_rows=20).collect(), key=lambda r: (r["part"], r["seq"]))
    keys = [warc.key(tuple(r)) for r in got]
    assert len(got) == 200 and keys == sorted(keys) and len({r["part"] for r in got}) > 3


P1, P2, P3 = ("First paragraph of the story, with a good many words in it & more.", "Second paragraph <of> the story that is as long as the other one was.", "Third one, which is long enough to be seen as a paragraph of its own.")


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        "<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Head</h1><p>{0}<p><b>{1}<br><p>{2}</article><footer>f</footer>",
        "<div id=wrap><div class=menu>menu words that are long enough to look like a text of their own</div><div class='post-content'><h1>Head</h1><p>{0}</p>\n<div><p>{1}</p></div><p>{2}</p></div><div class='comments'><p>a comment that is long enough to look like a paragraph</p></div></div>",
        "<header><h1>Site name</h1></header><main><article><header><h1>Head</h1><p>by someone</p></header><section><p>{0}</p></section><section><p>{1}</p></section><section><p>{2}</p></section><aside>rel</aside><form>q</form></article></main>",
        "<div class='cookie-notice'>we use cookies and say so at some length in this sentence here</div><div role=main><h1>Head</h1><p>{0}</p><div class=ad><p>buy this fine thing today, it is cheap</p></div><p>{1}</p><p>{2}</p></div><div id=sidebar><p>more long words of no use to anyone who reads</p></div>",
    ],
)
def test_html(spark, body):
    df = spark.createDataFrame([(i, f"http://h.com/{i}", page(body.format(*map(escape, (P1, P2, P3)))), "x") for i in range(3)], PAGES)
    got = html.extract(df).collect()
    assert [r["text"] for r in got] == ["\n".join(["Head", P1, P2, P3])] * 3 and got[0]["n_chars"] == len(got[0]["text"])


@pytest.mark.parametrize("tag", ["article", "main", "div role=main"])
def test_html_keeps_what_is_beside_the_content_of_an_article(spark, tag):
    body = "<div class=menu>menu words that are long enough to look like a text</div><{0}><h1>Head</h1><p>A short lead.</p><div class='content'><p>{1}</p><p>{2}</p></div><aside>rel</aside></{3}><p>after</p>"
    df = spark.createDataFrame([(i, f"http://h.com/{i}", page(body.format(tag, escape(P1), escape(P2), tag.split()[0])), "x") for i in range(2)], PAGES)
    assert [r["text"] for r in html.extract(df).collect()] == ["\n".join(["Head", "A short lead.", P1, P2])] * 2


def test_html_odd(spark):
    data = [(1, None, None, ""), (2, "x", "", ""), (3, "http://a/", "plain  text\n&amp; more", ""), (4, "http://a/", "<p>a<!-- x --><b>b</b>&nbsp; c<p>d<scr", ""), (5, None, "<div " * 5000, ""), (6, "http://a/", "<p x=\"" * 3000, "")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(data, PAGES)).collect()}
    assert got[1] == got[2] == "" and got[3] == "plain text & more" and got[4] == "ab c\nd"
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    "raw, text",
    [
        ("<p>kept words</p>" + "<a " * 20_000, "kept words"),
        ("<p>kept words</p>" + "<a '" * 20_000, "kept words"),
        ("<div>" * 50_000 + "<p>kept words</p>", "kept words"),
        ("<p>kept words</p><!-- <b>gone</b>", "kept words"),
        ("<p>kept words</p><!-- gone", "kept words"),
        ("<p>kept words</p><script>gone <b>gone</b> gone", "kept words"),
        ("<p>kept words</p><script>gone</script>", "kept words"),
        ("<p>kept words</p><!-- gone -->", "kept words"),
        ("<p>kept words</p><!-- gone --> too", "kept words\ntoo"),
    ],
)
def test_html_long_or_cut_off(raw, text):
    began = time.time()
    assert html.Page(raw).extract(None)[0] == text
    assert time.time() - began < 5


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    from lexloom.llm.common import materialise

    for name, stage in c.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] >= seen[1] > seen[2] > seen[3] > 0
    last = c.STAGES[-1][1](spark, docs, sf)
    assert last.count() == seen[-1] and last.filter("n_tokens < 10").count() == 0
    assert list(itertools.islice(last.columns, 2)) == ["doc_id", "source"]
    assert c.run(spark, sf).count() == seen[-1]


CLASHES = "doc_id bigint, text string, source string, lang string, score int, Ids int, license int, dice int, n_hits int, fp int, n_words int, kept int, predicted int, goal_size int, lang_pred int, n_tokens int, component_id int, `a.b` int"


def test_columns_of_the_same_names(spark):
    """Outputs whose names exist get underscores; what was there stays as it was."""
    df = spark.createDataFrame([(i, f"{A} {i}", "s", "en", *range(14)) for i in range(1, 9)], CLASHES)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], LABELS)
    was = df.orderBy("doc_id").collect()
    done = [
        bpe.encode(df), licenses.scan(df), simhash.fingerprints(df), quality.statistics(df, keep=df.columns), langid.identify(df, langid.fit(df)),
        bpe.decode(bpe.encode(df, ids="x").drop("ids_sha256"), "x", out="Score"),
    ]
    for out in done:
        assert len({c.lower() for c in out.columns}) == len(out.columns) and set(df.columns) <= set(out.columns)
        assert out.select([f"`{c}`" for c in df.columns]).orderBy("doc_id").collect() == was
    assert {"_license", "_dice", "_n_hits"} <= set(done[1].columns) and "_fp" in done[2].columns and "_ids" in {c.lower() for c in done[0].columns}
    for same in (rules.accept(df, labels), simhash.keep_one(df), mixing.mix(df), langid.accept(df, langid.fit(df))):
        assert same.columns == df.columns and set(same.collect()) <= set(was)
    assert all(f(df, labels).count() == 8 for f in (rules.judge, quality.classify)) and simhash.groups(df).count() == mixing.plan(df).count() == 8


def para(k):
    return f"Paragraph number {k} of the page has words enough to be looked at as one, and then a few more."


def test_html_names_inside_the_article():
    body = (
        f'<article><h1>T</h1><p>{para(1)}<h2 id="related-work">Related work</h2><section id="discussion"><p>{para(2)}</section><p class="share-price">The share price rose.</p><div class="notice-period"><p>{para(3)}</div>'
        f"<p>a<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> and <object>an object</object>.<span class=ad>BUY</span><span hidden>SECRET</span> <b class='promo-box'>NOW</b>end"
        f'<div class="related-posts"><p>{para(4)}</div><div class="share-buttons">share it</div><x-note>own tag</x-note> stays<p class="notice">We use your data.</p><div aria-label="Advertisement">buy</div><ins class="adsbygoogle">buy</ins></article><section id="comments"><p>{para(5)}</section>'
    )
    text, path = html.Page(body).extract(None)
    assert text.split("\n") == ["T", para(1), "Related work", para(2), "The share price rose.", para(3), "ax=2 and an object. end", "own tag stays"] and path == "article"


def test_html_names_that_hold_the_page():
    """A block that its name alone tells to be of no article, but that has the page's text or its heading."""
    for name, inside in (("content-sidebar-wrap", "<h1>T</h1>"), ("notice", "")):
        text, _ = html.Page(f"<div class='{name}'>{inside}<p>{para(1)}<p>{para(2)}</div><p>short end").extract(None)
        assert para(1) in text and para(2) in text
    assert html.Page(f"<div class=comments><p>{para(1)}<p>{para(2)}</div><p>{para(3)}").extract(None)[0] == para(3)
    deep = "<div class=a><div class='b c d e f'>" * 20
    assert html.Page(f"{deep}<p>{para(1)}").extract(None)[1].endswith(">div.b.c.d.e.f")


def test_html_votes_of_a_host(spark):
    """On one page the other container is the larger; the host's vote decides. Equal votes: the first digest."""
    story, other = "<div class='story s{0}'><p>{1}</div>", "<div class=extra><p>{1}</div>"
    pages = [(i, f"http://one.com/{i}", "<body>" + story.format(i, para(i) * 2) + other.format(i, para(90 + i)), "") for i in range(4)]
    odd = "<body>" + story.format(7, para(7)) + other.format(7, para(97) * 9)
    pages += [(7, "http://one.com/7", odd, ""), (8, "http://two.com/7", odd, ""), (9, "http://one.com/x", "<body><table><tr><td><p>" + para(9) + "</table>", "")]
    df = spark.createDataFrame(pages, PAGES)
    got = {r["page_id"]: (r["text"], r["path"]) for r in html.extract(df).collect()}
    assert got[7] == (para(7), "body>div.s#.story") and got[0] == (para(0) * 2, "body>div.s#.story")
    assert got[8] == (para(97) * 9, "body>div.extra") and got[9] == (para(9), "body>td")
    held = {}
    for i, url, h, _ in pages:
        for n, share in html.Page(h).best():
            key = (url.split("/")[2], n.key)
            held[key] = held.get(key, 0) + round(share * 1e6)
    want = {host: min((-v, k) for (x, k), v in held.items() if x == host)[1] for host in ("one.com", "two.com")}
    assert {r["host"]: bytes(r["path"]) for r in html.host_paths(df.repartition(3)).collect()} == want
    tie = spark.createDataFrame([(1, "http://t/1", "<body><div class=a><p>" + para(1) + "</div>", ""), (2, "http://t/2", "<body><div class=b><p>" + para(2) + "</div>", "")], PAGES)
    keys = sorted(n.key for i in "ab" for n, _ in html.Page(f"<body><div class={i}><p>{para(1)}</div>").best())
    assert bytes(html.host_paths(tie).first()["path"]) in keys


def test_quality_against_a_plain_fit(spark):
    """Weights by one least-squares problem over all rows; the isotonic fit by its min-max form."""
    rng = np.random.default_rng(3)
    n = 240
    x = rng.standard_normal((n, len(quality.INPUTS)))
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.standard_normal(n) > 0.7).astype(int)
    rows = [(*map(float, a), int(b), int(i % 3)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in quality.INPUTS) + ", label int, fold int").repartition(5)
    got = quality.fit(df)
    f, fold, size = got.features(x), np.arange(n) % 3, len(got.weights)
    halves = [np.arange(size - 1) < quality.FEATURES, np.arange(size - 1) >= quality.FEATURES, np.ones(size - 1, bool)]

    def solve(rows, half, ridge):
        use = np.append(half, True)
        w, d = np.zeros(size), np.append(np.full(half.sum(), ridge), 1e-6)
        # Penalties as further rows of the problem.
        w[use] = np.linalg.lstsq(np.vstack([f[rows][:, use], np.diag(np.sqrt(d))]), np.append(y[rows], np.zeros(len(d))), rcond=None)[0]
        return w

    errors = {(i, r): sum(((y[fold == k] - f[fold == k] @ solve(fold != k, halves[i], r)) ** 2).sum() for k in range(3)) for i in range(3) for r in quality.RIDGE}
    i, r = min(errors, key=errors.get)
    assert np.allclose(got.weights, solve(np.ones(n, bool), halves[i], r), atol=1e-4)
    without = {k: solve(fold != k, halves[i], r) for k in range(3)}
    raw = np.round(np.clip([a @ without[k] for a, k in zip(f, fold, strict=True)], -1, 2) * (quality.STEPS / 3)).astype(int)
    at = np.unique(raw)
    share, weight = np.array([y[raw == a].mean() for a in at]), np.array([(raw == a).sum() for a in at])
    mean = lambda a, b: np.average(share[a : b + 1], weights=weight[a : b + 1])
    want = [max(min(mean(a, b) for b in range(j, len(at))) for a in range(j + 1)) for j in range(len(at))]
    assert len(got.raw) == len(at) and np.mean(np.isclose(got.shares, want, atol=1e-6)) > 0.98
    z = rng.random(40)
    iso = quality.isotonic(z, np.ones(40))
    assert np.allclose(iso, [max(min(z[a : b + 1].mean() for b in range(j, 40)) for a in range(j + 1)) for j in range(40)])


def test_quality_of_odd_texts(spark):
    odd = [None, "", " ", "word " * 300_000, "x" * 1_000_000, "\n" * 1000, "a b"]
    docs = spark.createDataFrame([(i, t, "en", "s", i) for i, t in enumerate(odd)] + [(3, odd[3], "en", "s", 3)], "doc_id bigint, text string, lang string, source string, score int")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 0, 0), (None, 1, 0)], LABELS)
    got = quality.classify(docs, labels).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    judged = rules.judge(docs, labels).collect()
    assert len(judged) == 8 and {r["doc_id"]: r["n_words"] for r in judged}[3] == 300_000


def test_rules_against_an_exhaustive_search():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = {k: rng.integers(0, 6, 25).astype(float) for k in "ab"}
        bad = (x["a"] > 3) & (x["b"] < 4) | (rng.random(25) < 0.1)
        if bad.all() or not bad.any():
            continue
        rule, now = rules.grow(x, bad), np.ones(25, bool)
        for c in rule:  # each condition has the largest gain among all there are
            gains = []
            for k in "ab":
                v = np.unique(x[k][now])
                for at in (v[1:] + v[:-1]) / 2:
                    for above in (False, True):
                        hit = now & (x[k] >= at if above else x[k] <= at)
                        p1, n1, p, n = (hit & bad).sum(), (hit & ~bad).sum(), (now & bad).sum(), (now & ~bad).sum()
                        gains.append(p1 * (np.log2((p1 + 1e-9) / (p1 + n1)) - np.log2(p / (p + n))))
            before = now.copy()
            now &= c.holds(x)
            p1, n1, p, n = (now & bad).sum(), (now & ~bad).sum(), (before & bad).sum(), (before & ~bad).sum()
            assert p1 * (np.log2((p1 + 1e-9) / (p1 + n1)) - np.log2(p / (p + n))) == pytest.approx(max(gains))
        part = np.arange(25) % 3 > 0
        for learned in rules.learn(x, bad, part):
            c = rules.covers(learned, x)
            assert (c & bad).any()


def test_tokens_of_whole_texts(spark, docs, tmp_path):
    """The registered query against the library on whole texts."""
    import public_tokenizers

    from lexloom.llm import queries

    enc = bpe.encoder(bpe.rank_path(), public_tokenizers.PATTERN)
    for d in ("/root/testdata/sf0.001", str(tmp_path)):
        if d == str(tmp_path):
            docs.write.parquet(f"{d}/documents.parquet")
        texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
        want = sorted((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts for ids in [enc.encode_ordinary(t or "")])
        got = queries.op7_byte_bpe(spark, d)
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == want


def kneser_ney(counts, order=langid.ORDER, size=1):
    """Interpolated Kneser-Ney by dictionaries: log p of a character after others."""
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / size
        level = levels[n]
        ones, twos = (sum(c == k for c in level.values()) for k in (1, 2))
        cut = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5
        same = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        return max(level.get(gram, 0) - cut, 0) / total + cut * len(same) / total * p(gram[1:])

    return p


def test_languages_against_dictionaries():
    rng = random.Random(4)
    train = {"aa": "the cat sat on the mat and the dog ran ", "bb": "der hund und die katze sind auf der matte ", "cc": "le chat est sur le tapis et le chien court "}
    counts = {}
    for lang, text in train.items():
        counts[lang] = {}
        for i in range(len(text) - langid.ORDER + 1):
            counts[lang][text[i : i + langid.ORDER]] = counts[lang].get(text[i : i + langid.ORDER], 0) + 1
    model = langid.compile_model(counts)
    size = len({c for g in counts.values() for x in g for c in x}) + 1
    models = [kneser_ney(counts[x], size=size) for x in sorted(counts)]
    texts = ["".join(rng.choices("abcdehlmnrstu zé", k=rng.randint(1, 40))) + "x" for _ in range(60)] + list(train.values())
    h, n = model.score(texts)
    for t, row, k in zip(texts, h, n, strict=True):
        clean = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        chars = "\0\0\0" + clean
        want = [-np.mean([np.log(p(chars[i - 3 : i + 1])) for i in range(3, len(chars))]) for p in models]
        assert k == len(clean) and np.allclose(row, want, atol=1e-4)
        assert model.predict([t])[0][0].as_py() == sorted(counts)[int(np.argmin(want))]


def test_licences_in_whole_files(spark):
    rng = random.Random(2)
    fill = lambda n: "\n".join(" ".join(rng.choice(["alpha", "of", "the", "software", "in", "with", *(f"w{i}" for i in range(200))]) for _ in range(10)) for _ in range(n // 10))
    wrap = lambda t, w=72, lead="": "\n".join(lead + x for x in textwrap.wrap(" ".join(t.split()), w))
    cases = []
    for name, text in licenses.templates_of().items():
        if name.endswith("-text"):
            cases += [(text, name), (wrap(text), name), (wrap(text, 60, " * ") + "\nint main() {}\n" + fill(300), name), (fill(600) + "\n\nCopyright (c) 2020 A B\n\n" + wrap(text, 72, "# ") + "\n\n" + fill(900), name)]
    cases += [(fill(5000), None), ("The code is released under the MIT License and goes on with other words after that.", "MIT")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id int, text string").repartition(4)
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_hits"]) for r in licenses.scan(df).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: c[1] for i, c in enumerate(cases)}
    assert all(v[1] >= 0.8 and v[2] >= 1 for v in got.values() if v[0])


def test_telling_pieces_lose_nothing():
    long = [b for v in licenses.templates_of().values() if len(b := licenses.bigrams_of(v)) > licenses.LONG]
    pieces = licenses._telling(long, 0.8)
    for b in long:
        without = [x for x in b if not any(p in x for p in pieces)]
        assert len(without) < licenses._bounds(len(b), 0.8)[0]


def test_archives_are_bounded_by_bytes(spark):
    from lexloom.llm.common import shared_dir

    rng = np.random.default_rng(1)
    noise = lambda n: "".join(map(chr, rng.integers(33, 126, n)))
    data = [(i, f"http://h{i % 2}.com/{i}", noise(200_000 if i % 5 else 10), "") for i in range(40)] + [(7, "http://h/again", "dup", ""), (7, "http://h/again", "dup", ""), (3, "http://h/x", "dup", "")]
    df = spark.createDataFrame(data, PAGES).coalesce(1)
    path = shared_dir(spark, "test")
    warc.write(df, path, archive_bytes=500_000)
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) > 8 and max(sizes) < 500_000 + 210_000
    got = warc.merged(warc.captures(spark, path), range_rows=10).collect()
    assert len(got) == len(data) and sorted(r["payload_bytes"] for r in got) == sorted(len(h) for _, _, h, _ in data)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 3) == [(3, "response", None), (7, "revisit", 3), (7, "revisit", 3)]
    binary = {r["path"].rpartition("/")[2]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()}
    first = next(r for r in got if r["page_id"] == 1)
    assert warc.read_record(binary[first["archive"]], first["offset"], first["length"]).decode() == data[1][2]


def test_null_ids_are_cut_as_they_sort(spark):
    df = spark.createDataFrame([(None if i % 3 else i, "http://same/", f"p{i}", "") for i in range(60)], PAGES)
    got = sorted(warc.archive(df).collect(), key=lambda r: (r["part"], r["seq"]))
    keys = [warc.key(tuple(r)) for r in got]
    assert keys == sorted(keys) and len(keys) == 60


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(6)
    docs = [(f"{s}-{i}", "w " * int(rng.lognormvariate(4, 1.2) + 1), s) for s in ("a", "b", "c", None) for i in range(30)] + [("z", None, "d"), ("y", "", "d")]
    df = spark.createDataFrame(docs, "doc_id string, text string, source string")
    plan = mixing.plan(df)
    by = plan.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("n")).collect()
    assert len(by) == 5 and all(abs(r["taken"] - r["target"]) <= 0.08 * r["target"] for r in by if r["n"])
    assert sorted(map(str, plan.collect())) == sorted(map(str, mixing.plan(df.repartition(9)).collect()))
    mixed = mixing.mix(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in mixed} == {r["doc_id"]: r["copies"] for r in plan.collect() if r["copies"]}
    # Over like documents the chance is the fraction.
    many = spark.createDataFrame([(i, "w " * (1 + i % 40), f"s{i % 3}") for i in range(3000)], "doc_id int, text string, source string")
    rates = mixing.plan(many).groupBy(F.floor(F.col("size") / 10).alias("part"), "target").agg(F.avg("copies").alias("got"), F.avg(F.col("target") / F.col("source_size")).alias("want")).collect()
    assert len(rates) == 15 and all(abs(r["got"] - r["want"]) < 0.12 for r in rates)


def test_pipeline_against_brute_force(spark):
    """The whole pipeline in plain Python over the same models: row by row, all pairs, the library's ids."""
    import corpus_pipeline as c
    import public_tokenizers

    sf = "/root/testdata/sf0.001"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = [r.asDict() for r in table.collect()]
    model = langid.fit(table)
    docs = [d for d in docs if not model.predict([d["text"]])[2][0].as_py()]

    drawn = {r["doc_id"]: (r["label"], r["h"]) for r in rules.sampled(labels).collect()}
    x = {d["doc_id"]: dict(zip(textstats.NAMES, textstats.stats(d["text"]), strict=True)) for d in docs}
    failed = {i for i, s in x.items() if s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]}
    known = sorted((drawn[i][1], *(x[i][k] for k in rules.INPUTS), drawn[i][0]) for i in drawn if i in x and i not in failed)
    columns = {k: np.array([r[1 + j] for r in known]) for j, k in enumerate(rules.INPUTS)}
    learned = rules.learn(columns, np.array([r[-1] == 0 for r in known]), np.array([r[0] % 3 != 0 for r in known]))
    bad = {i for i, s in x.items() if any(all(s[k.name] >= k.at if k.above else s[k.name] <= k.at for k in rule) for rule in learned)}
    docs = [d for d in docs if d["doc_id"] not in failed | bad]

    fps = np.array([simhash.fingerprint(d["text"]) for d in docs], np.uint64)
    root = roots_of(len(docs), np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3, 1)))
    least = {}
    for d, r in zip(docs, root, strict=True):
        least[r] = min(least.get(r, d["doc_id"]), d["doc_id"])
    docs = [d for d in docs if d["doc_id"] in least.values()]

    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    total = {}
    for d in docs:
        total[d["source"]] = total.get(d["source"], 0) + size[d["doc_id"]]
    goal = fill(total, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}, 1.5 * sum(total.values()), 2)
    part = lambda *a: int(hashlib.md5(":".join(["mix-1", *map(str, a)]).encode()).hexdigest()[:8], 16) / 2**32
    mixed = []
    for s, n in total.items():
        rate, want, got = goal[s] / n, 0.0, 0.0
        kind = lambda z: max(z.bit_length(), 1) * 512 + (z >> max(0, z.bit_length() - 9))
        own = [d for d in docs if d["source"] == s]
        for k in sorted({kind(size[d["doc_id"]]) for d in own}, reverse=True):
            those = [d for d in own if kind(size[d["doc_id"]]) == k]
            words = sum(size[d["doc_id"]] for d in those)
            want += (rate - int(rate + 1e-9)) * words if abs(rate - round(rate)) > 1e-9 else 0
            more = min(len(those), max(0, int(np.floor((want - got) / (words / len(those)) + part(s, k)))))
            got += more * words / len(those)
            for d in those:
                mixed += [d] * (int(rate + 1e-9) + (part(s, d["doc_id"]) < more / len(those)))

    enc = bpe.encoder(bpe.rank_path(), public_tokenizers.PATTERN)
    want = sorted((d["doc_id"], d["source"], tuple(enc.encode_ordinary(d["text"]))) for d in mixed)
    assert sorted((r["doc_id"], r["source"], tuple(r["ids"])) for r in c.run(spark, sf).collect()) == want
