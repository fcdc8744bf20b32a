import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom import registry
from lexloom.functions import text as T
from lexloom.functions import urls as U
from lexloom.operators import model as M
from lexloom.sources import corpus
from lexloom.sources import model_files as MF


@pytest.mark.parametrize(("cut", "kept"), [(None, "ABCDE"), (0, "ABCDE"), (1, "ABCD"), (10, "AB"), (20, "AB"), (50, "A")])
def test_cut(spark, cut, kept):
    df = spark.createDataFrame([("x", t, n) for t, n in zip("ABCDE", (50, 30, 15, 4, 1), strict=True)], "lang string, term string, freq bigint")
    got = M.probabilities(df, cut).orderBy(F.desc("freq")).collect()
    assert "".join(r["term"] for r in got) == kept and got[0]["prob"] == 0.5


def test_cut_within_equal_counts(spark):
    df = spark.createDataFrame([("x", t, 10) for t in "DCBA"], "lang string, term string, freq bigint")
    assert sorted(r["term"] for r in M.probabilities(df, 40.0).collect()) == ["A", "B"]


def brute_grams(words, n):
    return sorted(" ".join(g) for k in range(1, n + 1) for g in zip(*(words[i:] for i in range(k)), strict=False) if None not in g)


def test_ngrams_stop_at_dropped_words(spark, monkeypatch):
    texts = [[], ["A"], ["A", "B", None, "C"], [None], ["A", "A", "A", "A", "A"], [None, "B", "C", None, None, "D", "E", "F", "G", "H"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, words array<string>")
    for n, window in ((1, 9), (2, 9), (4, 9), (4, 2), (3, 1)):
        monkeypatch.setattr(M, "_WINDOW", window)
        got = {i: [] for i in range(len(texts))}
        for r in M.gram_counts(df, n, ("id",)).collect():
            got[r["id"]] += [r["term"]] * r["freq"]
        assert {i: sorted(v) for i, v in got.items()} == {i: brute_grams(t, n) for i, t in enumerate(texts)}


def test_ngrams_go_over_lines_and_splits(spark):
    lines = [["A", "B"], [], ["C"], ["D"], ["E"], ["F", "G", "H", "I", "J"], ["K"], [], ["L"], ["M"]]
    rows = [("f", (0, 0, 0, 7, 7, 7, 9, 9, 9, 9)[i], i, w) for i, w in enumerate(lines)] + [("g", 0, 0, ["X"]), ("g", 0, 1, ["Y"])]
    df = spark.createDataFrame(rows, "file string, split long, line_no long, words array<string>").repartition(5)
    for n in (1, 2, 4):
        model = M.build_ngrams(M.with_carry(df, n).withColumn("lang", F.lit("x")), n, carry="carry")
        got = sorted(t for r in model.collect() for t in [r["term"]] * r["freq"])
        assert got == sorted(brute_grams([w for x in lines for w in x], n) + brute_grams(["X", "Y"], n))


def test_ngram_model_has_words_of_up_to_100(spark, tmp_path):
    long, over = "Donaudampfschiff" * 6 + "ABCD", "x" * 101
    docs = [(1, f"one {long} two {over} three", "de"), (2, "one two", "de")]
    spark.createDataFrame(docs, "doc_id int, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["term"]: (r["freq"], r["prob"]) for r in registry.QUERIES["ngram_model"](spark, str(tmp_path)).collect()}
    a = long.upper()
    assert got == {"ONE": (2, 2 / 6), "TWO": (2, 2 / 6), a: (1, 1 / 6), "THREE": (1, 1 / 6), f"ONE {a}": (1, 1 / 6), f"{a} TWO": (1, 1 / 6), f"ONE {a} TWO": (1, 1 / 6), "ONE TWO": (1, 1 / 6)}


def test_model_text(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("#\thdr\n#x\nA\t0.5\nB\t\t1.5E-07\n")
    assert {r["term"]: r["prob"] for r in MF.read_text(spark, str(path)).collect()} == {"A": 0.5, "B": 1.500000053056283e-07}
    for bad in ("A\t0.5\n\nB\t1\n", "A\n", "A\tB\t1\n", " \t1\n", "A\t-0.5\n", "A\tabc\n", "A\t1\n#x\n"):
        path.write_text(bad)
        with pytest.raises(Exception, match="wrong line"):
            MF.read_text(spark, str(path)).collect()


def test_model_round_trips(spark, tmp_path):
    model = spark.createDataFrame([("en", "B", 0.25), ("en", "A", 0.25), ("en", "C", 0.5), ("en", "Z", 0.0)], "lang string, term string, prob double")
    MF.write_text(model, str(tmp_path / "t"), "'x' (ngram_1-cut_1%)")
    text = next((tmp_path / "t").glob("part-*")).read_text()
    assert [x.split("\t")[0] for x in text.splitlines()] == ["#", "C", "A", "B"]
    assert M.differences(model.filter("prob > 0"), MF.read_text(spark, str(tmp_path / "t"), "en")).count() == 0
    MF.write_parquet(model, str(tmp_path / "p"), 20)
    assert M.differences(model, MF.read_parquet(spark, str(tmp_path / "p"))).count() == 0
    assert MF.read_parquet(spark, str(tmp_path / "p"), str(tmp_path / "P")).count() == 4  # paths that differ in case alone
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "m-1.bin").write_bytes(MF.encode_record("A", 0.5) + MF.encode_record("ÄB", 0.25))
    (tmp_path / "b" / "m-2.bin").write_bytes(MF.encode_record("A", 0.125))
    got = M.first_wins(MF.read_shards(spark, str(tmp_path / "b")))
    assert {r["term"]: r["prob"] for r in got.collect()} == {"A": 0.5, "ÄB": 0.25}
    with pytest.raises(ValueError, match="empty"):
        MF.write_parquet(model.limit(0), str(tmp_path / "e"))
    with pytest.raises(Exception, match="duplicate term"):
        M.require_unique(model.unionByName(model)).collect()


def test_folded_text(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_bytes("\ufeff# a\r\n\r\n#b\n  straße \t 0.25 \n\n#C\t0.5\n".encode())
    assert {r["term"]: r["prob"] for r in MF.read_text_folded(spark, str(path)).collect()} == {"STRAßE": 0.25, "#C": 0.5}
    for bad in ("A\n", "A\tB\t1\n", "\t1\n", "A\t-0.5\n", "A\tabc\n"):
        path.write_text(bad)
        with pytest.raises(Exception, match="wrong line"):
            MF.read_text_folded(spark, str(path)).collect()
    path.write_text("")
    assert MF.read_text_folded(spark, str(path)).count() == MF.read_text(spark, str(path)).count() == 0


def test_paths_of():
    assert MF.paths_of(" a.bin; ;b.bin;A.BIN;", "/m/") == ["/m/a.bin", "/m/b.bin"] and MF.paths_of("") == []


@pytest.mark.parametrize("limit", [0, 1, 30, 10_000])
def test_shards(spark, tmp_path, limit):
    rows = [("en", f"TERM{i}", 1 / (1 + i % 5)) for i in range(12)]
    model = spark.createDataFrame(rows, "lang string, term string, prob double")
    paths = MF.write_shards(model, str(tmp_path), "m", limit)
    order = sorted(((t, p) for _, t, p in rows), key=lambda x: (-x[1], x[0]))
    want, held = [], b""
    for t, p in order:
        held += MF.encode_record(t, p)
        if limit and len(held) >= limit:
            want.append(held)
            held = b""
    want += [held] if held else []
    names = ["m.bin"] if len(want) == 1 else [f"m-{i + 1}.bin" for i in range(len(want))]
    assert [p.rpartition("/")[2] for p in paths] == names and [open(p, "rb").read() for p in paths] == want
    assert {(r["term"], r["prob"]) for r in MF.read_shards(spark, str(tmp_path)).collect()} == set(order)
    with pytest.raises(ValueError, match="empty"):
        MF.write_shards(model.limit(0), str(tmp_path), "e")


def test_build_from_folder(spark, tmp_path):
    from lexloom.plans.build import build_from_folder, write_model

    with pytest.raises(ValueError, match="no .txt"):
        build_from_folder(spark, str(tmp_path))
    (tmp_path / "big one.txt").write_text("\ufeffOne two, see http://x.org/y now.\n\nThree 12 four\n" * 3)
    (tmp_path / "small.txt").write_text("one two\n")
    lines = ["ONE", "TWO", "SEE", "NOW", "THREE", "FOUR"]
    for n in (1, 3):
        got = {r["term"]: r["freq"] for r in build_from_folder(spark, str(tmp_path), "en", n).collect()}
        want = brute_grams(lines * 3, n) + brute_grams(["ONE", "TWO"], n)
        assert got == {t: want.count(t) for t in want}
    path = write_model(spark, str(tmp_path), str(tmp_path / "out"), cut_percent=1.0)
    assert path.endswith("/big one-(ngram_1-cut_1%).txt") and MF.read_text(spark, path).count() > 0
    got = corpus.lines(spark, str(tmp_path), "*.txt").filter("file like '%small%'").collect() + corpus.lines(spark, str(tmp_path), "big*").orderBy("line_no").collect()
    assert [r["line_no"] for r in got] == [0, *range(9)] and got[1]["text"].startswith("One")
    (tmp_path / "odd.txt").write_text("... 12 \n")
    with pytest.raises(ValueError, match="no words"):
        build_from_folder(spark, str(tmp_path))


def test_files_by_size(spark, tmp_path):
    for name, n in (("a.txt", 3), ("b.txt", 9), ("c.dat", 99)):
        (tmp_path / name).write_text("x" * n)
    assert [r["path"].rpartition("/")[2] for r in corpus.files(spark, str(tmp_path)).collect()] == ["b.txt", "a.txt"]
    assert corpus.output_name("/x/b.txt", 1, 1.0) == "b-(ngram_1-cut_1%).txt"
    (tmp_path / "d.txt").write_bytes("é\nb".encode("latin-1"))
    assert sorted(r["text"] for r in corpus.lines(spark, str(tmp_path), "d.txt", "iso-8859-1").collect()) == ["b", "é"]


def test_fold():
    assert T.fold("straße ёж Ёж éa") == "STRAßE ЕЖ ЕЖ ÉA"


@pytest.mark.parametrize("percent", [0, 1, 50, 70, 100])
def test_cyrillic_share(spark, percent):
    def brute(t):
        cyr, letters = sum("А" <= c <= "я" for c in t), sum(c.isalpha() for c in t)
        least = [int(np.float32(percent) / np.float32(100) * np.float32(n)) for n in (len(t), letters)]
        return percent <= 0 or (cyr > 0 and cyr >= least[0]) or cyr >= least[1]

    texts = ["", "1", "a", "ab", "ё", "ёё", "аё", "аb", "аbc", "абвc", "а1 2 3 4", "ab аб", "абв где", "аbcdefghij", "АЯаяЀѐЁё", "привет, world 2020!", "а" * 7 + "b" * 3, "а" * 69 + "b" * 31, "аbc" + "1" * 17, "1234"]
    df = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    assert [r[0] for r in df.orderBy("item_id").select(T.has_cyrillic_letters(F.col("text"), percent)).collect()] == [brute(t) for t in texts]
    assert percent <= 0 or spark.createDataFrame([(None,)], "text string").select(T.has_cyrillic_letters(F.col("text"), percent)).first()[0] is None


@pytest.fixture(scope="module")
def names():
    return U.default_names()


def test_domains(names):
    assert len(names.domains) == 272 and len(names.schemes) == 51


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("www.x.org", [(0, 9)]), ("go x.com now", [(3, 5)]), ("x.co.uk/path ok", [(0, 12)]), ("mailto:a@b", [(0, 10)]), ("(see x.org).", [(5, 5)]), ("http://a.b/c, d", [(0, 12)]),
        ("AWWW.q.z", [(1, 7)]), ("x.com.foo.com", [(0, 5), (0, 13)]), ("ed2k:x", []), (".com", []), ("", []),
    ],
)
def test_urls(names, text, want):
    assert U.spans(text, names) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Hello, world", "HELLO WORLD"), ("a.b o'neil", "A.B O'NEIL"), ("foo(bar", "FOO BAR"), ("123 abc", "ABC"), ("abc 123", "ABC 123"), (" -a", ""), ("a", "A"), ("! -a", "A"),
        ("abc 123\tx", "ABC 123 X"), ("123! x", "123 X"), ("1/2 x", "1 X"), ("ёж", "ЕЖ"), ("see http://x.org/y now", "SEE NOW"),
    ],
)
def test_words(names, text, want):
    assert " ".join(U.words(text, names)) == want


def slow_spans(text, names):
    """URLs by looking at one character after the other."""
    stop = lambda c: U.kind(c) == "S" or c == "\0" or U.kind(c) == "P" and c > "\x7f"
    out, at, text = [], 0, text.partition("\0")[0]

    def right(at, least):
        end = at
        while end < len(text) and not stop(text[end]):
            end += 1
        end -= 1
        while end > least and text[end] != "/" and U.kind(text[end]) == "P":
            end -= 1
        return max(end, least)

    def domain(dot):
        end = dot + 1
        while end < len(text) and U.kind(text[end]) == "L":
            end += 1
        return end if T.fold(text[dot + 1 : end]) in names.domains else 0

    while at < len(text):
        p, at = at, at + 1
        if text[p] == ":":
            a = p
            while a and (text[a - 1] == "-" or text[a - 1].isascii() and text[a - 1].isalpha()):
                a -= 1
            if a == p or p - a > max(map(len, names.schemes)) + 1:
                continue
            if T.fold(text[a:p]) not in names.schemes:
                at = p + 2
                continue
            end = right(p, p)
        elif text[p] == "." and T.fold(text[max(0, p - 3) : p]) == "WWW":
            a, end = p - 3, right(p, p)
        elif text[p] == ".":
            dots = [p]
            if not domain(p):
                at = p + 2
                continue
            while domain(dots[-1]) < len(text) and text[domain(dots[-1])] in ".\uffff" and domain(domain(dots[-1])):
                dots.append(domain(dots[-1]))
            a = dots[-1]
            while a and not stop(text[a - 1]):
                a -= 1
            while a < dots[-1] and text[a] != "/" and U.kind(text[a]) in "PS":
                a += 1
            if a == dots[-1]:
                continue
            end = domain(dots[-1])
            end = right(end - 1, dots[-1]) if end < len(text) and text[end] in "/\\" else end - 1
        else:
            continue
        out.append((a, end + 1 - a))
        at = end + 2
    return out


def slow_words(text, names):
    """Words by looking at one character after the other."""
    text = text.partition("\0")[0]
    urls, run, at, out = slow_spans(text, names), "", 0, []
    ends = lambda c: (U.kind(c) == "P" or c in U.ENDS_WORD) and c not in U.IN_WORD
    number = lambda c: U.kind(c) == "D" or c in U.IN_NUMBER

    def close(after):
        alnum = [i for i, c in enumerate(run) if U.kind(c) in "LD"]
        if run and alnum and not (after and all(map(number, run + after))):
            w = run[alnum[0] : alnum[-1] + 1]
            if len(w) > 1 or len(run) == 1:
                out.append(T.fold(w))

    while at < len(text):
        if urls and urls[0][0] <= at:
            close(text[at])
            a, n = urls.pop(0)
            run, at = "", a + n
        elif U.kind(text[at]) == "S":
            close(text[at])
            run, at = "", at + 1
        elif ends(text[at]):
            close("")
            run, at = "", at + 1
            while at < len(text) and U.kind(text[at]) in "PS":
                at += 1
        else:
            run, at = run + text[at], at + 1
    close("")
    return out


def test_spans_and_words_at_random(names):
    rng = random.Random(1)
    parts = "a b1 WWW www . .. : / \\ com co uk ru http mailto // - ' é ё рф , ! ( ) “ „ x 12 3 < > & € ٣ 日 _ – ed2k \uffff # @ ?".split() + [" ", "\t", "\n", "\u00ad", "\0"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert U.spans(text, names) == slow_spans(text, names) and list(U.words(text, names)) == slow_words(text, names), repr(text)


@pytest.mark.parametrize("text", ["x." + "com." * 50_000, "a.com," * 30_000, "www." * 50_000, "http:" * 50_000, "x.com/" + "," * 200_000 + "y.com", "!" * 300_000, "a-" * 100_000, "1 " * 200_000, "x." * 100_000])
def test_long_unbroken_texts_take_linear_time(names, text):
    began = time.time()
    U.spans(text, names)
    sum(1 for _ in U.words(text, names))
    assert time.time() - began < 5


def test_columns_that_exist_are_not_hidden(spark):
    df = spark.createDataFrame([("a", 1)], "text string, Words int")
    with pytest.raises(ValueError, match="already"):
        U.with_words(df)
    assert U.with_words(df, out="w").first()["w"] == ["A"]


def test_request_text(spark):
    df = spark.createDataFrame([("\ufeff \t" + "é" * 101 + "\xa0\n",)], "text string")
    a, b, c = df.select(T.trim_text(F.col("text")), T.wrap_text(F.lit("x" * 100)), T.limit_text(F.col("text"), 7)).first()
    assert (a, b, c) == ("é" * 101, ("x" * 50 + "<wbr/>") * 2, "é" * 7)


def test_shared_tables(spark, monkeypatch, tmp_path):
    from types import SimpleNamespace as Of

    from lexloom.sources import shared

    monkeypatch.setattr(shared, "session_dir", lambda _: str(tmp_path / "own"))
    kept = shared.materialise(spark.range(5), "five")
    assert kept.count() == 5 and len(list((tmp_path / "own").iterdir())) == 1
    shared.release(spark)
    assert not (tmp_path / "own").exists()
    unset = Of(isDefined=lambda: False)
    cluster = Of(conf=Of(get=lambda *_: None), sparkContext=Of(master="spark://x", _jsc=Of(sc=lambda: Of(getCheckpointDir=lambda: unset))))
    with pytest.raises(RuntimeError, match="is not set"):
        shared._base(cluster)


def test_the_cut_and_the_order_need_no_task_of_a_whole_language(spark):
    """All terms of one count, or of a language, went to one task."""
    rng = random.Random(3)
    rows = {(lang, "".join(rng.choices("ABÉ", k=rng.randint(1, 9)))): rng.choice([1, 1, 1, 1, 2, 3, 40]) for lang in ("x", "y", "z") for _ in range(400)}
    df = spark.createDataFrame([(a, t, n) for (a, t), n in rows.items()], "lang string, term string, freq bigint")
    for cut in (0.0, 1.0, 12.0, 30.0, 77.0, 100.0):
        want = set()
        for lang in ("x", "y", "z"):
            total, run = sum(n for (a, _), n in rows.items() if a == lang), 0
            for n, t in sorted((-n, t.encode()) for (a, t), n in rows.items() if a == lang):
                run -= n
                if run <= float(np.float32(total) * np.float32(100 - cut)) / 100:
                    want.add((lang, t.decode(), -n, -n / total))
        assert {tuple(r) for r in M.probabilities(df, cut).collect()} == want
    model = M.probabilities(df).select("lang", "term", "prob")
    got = {(r["lang"], r["place"]): r["term"] for r in M.places(model).collect()}
    assert len(got) == len(rows) and all([got[lang, i + 1] for i in range(len(s))] == s for lang in ("x", "y", "z") for s in [[t for _, t in sorted((-n, t) for (a, t), n in rows.items() if a == lang)]])
    plan = M.probabilities(df, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (" not in plan or plan.count("strategy=broadcast") >= plan.count("Join Inner")


def test_words_are_found_by_one_expression(spark):
    """Each word was cut out and trimmed by expressions of its own."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("aé ß-1\t\x1e\x1fЯ　\x85.", k=rng.randint(0, 14))) for _ in range(500)]

    def plain(t):
        out = []
        for w in re.split("[\x00-\x1e\x20\x85\xa0　]+", t):
            k = [i for i, c in enumerate(w) if c.isalpha()]
            if k and (k[-1] > k[0] or len(w) == 1):
                out.append(w[k[0] : k[-1] + 1])
        return out

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.simple_tokens(F.col("t")).alias("w"))
    assert all(r["w"] == plain(r["t"]) for r in df.collect())
    assert "regexp_replace" not in df._jdf.queryExecution().toString()


def test_fold_takes_short_ways_alike():
    table = T._fold_table()
    assert all(T.fold(f"aß{chr(c)}") == f"aß{chr(c)}".translate(table) for c in range(0x110000))
    assert T._odd().search("ёж") and not T._odd().search("straße, été, мир")
