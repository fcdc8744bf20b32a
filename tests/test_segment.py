import random
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom import registry
from lexloom.operators import segment as S
from lexloom.plans import requests as R

TOY = {"IT": 0.01, "IS": 0.02, "A": 0.02, "AB": 0.0004, "B": 0.02, "TO": 0.03, "READ": 0.0005}


def brute(text, model):
    t, n = S.T.fold(text), len(text)
    p, back = [1.0] + [0.0] * n, [0] * (n + 1)
    for i in range(1, n + 1):
        for j in range(i):
            g = 1.0 if i - j == 1 and S._free(t[j]) else model.get(t[j:i], 0.0)
            if p[i] <= p[j] * g:
                p[i], back[i] = p[j] * g, j
    out, i = [], n
    while i:
        out.append((back[i], i - back[i], p[i]))
        i = back[i]
    return out[::-1]


def lex(model, lang="x"):
    return S.Lexicon.of(pa.table({"lang": [lang] * len(model), "term": list(model), "prob": pa.array(model.values(), pa.float64())}))


def run(texts, lexicon, lang="x"):
    (w,) = S.viterbi(texts, lexicon, [lang])
    out = [[] for _ in texts]
    for t, a, n, p in zip(w.text.tolist(), w.start.tolist(), w.length.tolist(), w.prob.tolist(), strict=True):
        out[t].append((a, n, p))
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ITIS", "IT IS"), ("TOREAD", "TO READ"), ("IT_IS", "IT _ IS"), ("A-B", "A - B"), ("A–B", "A – B"), ("12", "1 2"), ("X", "X"), ("ITXIS", "IT X I S"), ("itis", "IT IS"),
    ],
)
def test_words(text, want):
    (got,) = run([S.T.fold(text)], lex(TOY))
    assert " ".join(S.T.fold(text)[a : a + n] for a, n, _ in got) == want
    assert got == brute(text, TOY)


def test_ties_take_the_shorter_last_word():
    assert [n for _, n, _ in run(["AB"], lex({"A": 0.5, "B": 0.5, "AB": 0.25}))[0]] == [1, 1]


def test_underflow_ends_in_single_characters():
    m = {"TO": 3e-4, "READ": 5e-6, "E": 1e-4, "RE": 1e-5, "AD": 1e-5, "TOR": 1e-6}
    (got,) = run(["TOREAD" * 60], lex(m))
    zero = [n for _, n, p in got if p == 0]
    assert len(zero) == 142 and set(zero) == {1}


@pytest.mark.parametrize("block", [4096, 3, 1])
def test_against_the_recurrence(monkeypatch, block):
    monkeypatch.setattr(S, "_BLOCK", block)
    rng = random.Random(1)
    model = {"".join(rng.choices("ABCÄ-𐀀", k=rng.randint(1, 5))): rng.random() for _ in range(60)}
    texts = ["".join(rng.choices("ABCÄ-1 𐀀", k=rng.randint(0, 40))) for _ in range(60)]
    assert run(texts, lex(model)) == [brute(t, model) for t in texts]
    assert all(run([t], lex(model)) == [brute(t, model)] for t in texts)
    long = "".join(rng.choices("ABCÄ1", k=3000))
    assert run([long, long[:2000]], lex(model)) == [brute(long, model), brute(long[:2000], model)]


def test_empty_model_and_equal_terms():
    assert run(["AB1", ""], lex({"Q": 0.5})) == [brute("AB1", {}), []]
    two = pa.table({"lang": ["a", "b", "a", "b"], "term": ["IT", "IT", "IS", "IT"], "prob": [0.1, 0.2, 0.3, 0.4]})
    both = S.Lexicon.of(two)
    assert both.langs == ["a", "b"] and run(["ITIS"], both, "a") == [brute("ITIS", {"IT": 0.1, "IS": 0.3})] and run(["ITIS"], both, "b") == [brute("ITIS", {"IT": 0.2})]


def test_long_line_in_bounded_memory():
    """A line of ten million characters, in a process of its own."""
    code = """
import random, resource, pyarrow as pa
from lexloom.operators import segment as S
rng = random.Random(1)
terms = {"".join(rng.choices("ABCDE", k=rng.randint(1, 100))) for _ in range(5000)} | set("ABCDE")
lex = S.Lexicon.of(pa.table({"lang": ["x"] * len(terms), "term": sorted(terms), "prob": [0.5] * len(terms)}))
text = "".join(rng.choices("ABCDE", k=1000)) * 10_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
(w,) = S.viterbi([text], lex, ["x"])
assert int(w.length.sum()) == len(text) and len(w.start) > 5_000_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 1024


def test_own_language_and_terms(spark):
    rows = [("a", "IT", 0.01), ("a", "IS", 0.02), ("b", "ITIS", 0.001), ("b", "ÉÜ", 0.02)]
    model = spark.createDataFrame(rows, "lang string, term string, prob double")
    df = spark.createDataFrame([(1, "ITIS", "a"), (2, "itis", "b"), (3, "éü1ßx", "b"), (4, None, "a")], "n int, text string, lang string")
    for plan in (S.lexicon(model), model):
        got = {r["n"]: r["results"] for r in S.segment(df, plan, own="lang", terms=True).collect()}
        assert {k: [x["lang"] for x in v] for k, v in got.items()} == {1: ["a"], 2: ["b"], 3: ["b"], 4: ["a"]}
        assert {k: [t["term"] for t in v[0]["tps"]] for k, v in got.items()} == {1: ["IT", "IS"], 2: ["ITIS"], 3: ["ÉÜ", "1", "ß", "X"], 4: []}
        every = S.segment(df, plan, terms=True).filter("n = 3").first()["results"]
        assert [[t["term"] for t in r["tps"]] for r in every] == [["É", "Ü", "1", "ß", "X"], ["ÉÜ", "1", "ß", "X"]]
        with pytest.raises(Exception, match="language not found"):
            S.segment(df.withColumn("lang", F.lit("z")), plan, own="lang").collect()


def test_languages(spark):
    rows = [("a", "IT", 0.01), ("a", "IS", 0.02), ("b", "ITIS", 0.001), ("b", "IT", 0.02), ("c", "IT", 0.05)]
    model = spark.createDataFrame(rows, "lang string, term string, prob double")
    df = spark.createDataFrame([("ITIS",), (None,), ("  ",)], "text string")
    got = S.segment(df, model).withColumn("best", S.best()).withColumn("shares", S.shares()).collect()
    assert got[0]["best"]["lang"] == "b"
    assert [r["score"] for r in got[0]["results"]] == pytest.approx([-13.12236337740433, -6.907755278982137, S.MINIMUM])
    assert [r["share"] for r in got[0]["shares"]] == pytest.approx([0.422319, 0.422319, 0.155362], abs=1e-6)
    assert [r["best"]["lang"] for r in got[1:]] == ["c", "c"] and not got[1]["best"]["tps"]
    same = model.filter("lang = 'a'").unionByName(model.filter("lang = 'a'").withColumn("lang", F.lit("z")))
    assert S.segment(df.limit(1), same).select(S.best()["lang"]).first()[0] == "z"
    assert S.segment(df.limit(1), model).select(S.routed("results", F.lit("a"))["lang"]).first()[0] == "a"
    with pytest.raises(Exception, match="language not found"):
        S.segment(df.limit(1), model).select(S.routed("results", F.lit("x"))).collect()
    with pytest.raises(ValueError, match="use segment_by_join"):
        S.lexicon(model, max_terms=2)


def test_join_form_agrees(spark):
    model = spark.createDataFrame(list(TOY.items()), "term string, prob double")
    texts = ["ITIS", "toread", "IT_IS", "A–B", "X", "ITXIS", "", None, "ITISATOREADAB"]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    got = {r["text_id"]: [tuple(x) for x in r["tps"]] for r in S.segment_by_join(df, model).collect()}
    assert got == {i: brute(t, TOY) if t else [] for i, t in enumerate(texts)}


def test_large_models_take_the_join(spark, monkeypatch):
    rows = [("a", "IT", 0.01), ("a", "IS", 0.02), ("b", "ITIS", 0.001), ("b", "IT", 0.02), ("c", "IT", 0.05)]
    model = spark.createDataFrame(rows, "lang string, term string, prob double")
    df = spark.createDataFrame([(1, "ITIS"), (2, "itis"), (2, "itis"), (3, None), (4, "  "), (5, ""), (6, "it is–X 1"), (7, "isit" * 30)], "n int, text string")

    def plain(langs):
        return sorted((r["n"], r["text"] or "", [(x["lang_idx"], x["lang"], round(x["score"], 9), [tuple(t) for t in x["tps"]]) for x in r["results"]]) for r in S.segment(df, model, langs=langs).collect())

    want = [plain(None), plain(["c", "a"])]
    schema = S.segment(df, model).schema["results"].dataType.simpleString()
    monkeypatch.setattr(S, "MAX_TERMS", 4)
    assert "Join" in S.segment(df, model)._jdf.queryExecution().toString()
    own = df.withColumn("own", F.when(F.col("n") % 2 == 0, "a").otherwise("c"))
    joined = [sorted(map(str, S.segment(own, m, own="own", terms=True).collect())) for m in (model, S.lexicon(model, 99))]
    assert joined[0] == joined[1]
    for give in ("best", "scores"):
        rounded = lambda m: sorted((r["n"], r["text"] or "", [(x["lang_idx"], x["lang"], round(x["score"], 9), x.asDict().get("tps")) for x in ([r["results"]] if give == "best" else r["results"])]) for r in S.segment(df, m, give=give).collect())  # noqa: B023, E731
        assert rounded(model) == rounded(S.lexicon(model, 99))
    both = S.segment(df, S.lexicon(model, 99)).withColumn("best", S.best()).select("n", "best").collect()
    assert sorted(map(str, both)) == sorted(map(str, S.segment(df, S.lexicon(model, 99), out="best", give="best").select("n", "best").collect()))
    assert [plain(None), plain(["c", "a"])] == want and S.segment(df, model).schema["results"].dataType.simpleString() == schema
    with pytest.raises(ValueError, match="language not found"):
        S.segment(df, model, langs=["x"])


def test_queries_with_large_models(spark, monkeypatch, tmp_path):
    docs = [(1, "it is to read\nto read it", "en"), (2, "es ist gut zu lesen\n\ngut", "de"), (3, None, "en"), (4, "it is good", "en")]
    spark.createDataFrame(docs, "doc_id int, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    talks = [("c1", 0, "itis toread"), ("c1", 1, "esistgut"), ("c2", 0, " "), ("c2", 1, "gut, 1x")]
    spark.createDataFrame(talks, "conv_id string, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    names = ["segment_text", "segment_best", "segment_all", "viterbi_terms", "best_language", "all_languages", "routed_language", "console_lines", "share_lines", "result_strings", "line_segments", "request_responses"]
    rows = lambda: {k: sorted(map(str, registry.QUERIES[k](spark, str(tmp_path)).collect())) for k in names}
    want = rows()
    monkeypatch.setattr(S, "MAX_TERMS", 3)
    assert all(want.values()) and rows() == want
    assert all("Join" in registry.QUERIES[k](spark, str(tmp_path))._jdf.queryExecution().toString() for k in names)


def test_each_row_of_conversations_is_answered(spark, tmp_path):
    spark.createDataFrame([(1, "it is", "en")], "doc_id int, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    talks = [("3", 3, "itis"), ("3", 3, "itis"), ("3", 3, "itis"), (None, 3, "it"), ("3", None, "it"), (None, None, None), (None, None, None)]
    spark.createDataFrame(talks, "conv_id string, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["request_id"]: r["response"] for r in registry.QUERIES["request_responses"](spark, str(tmp_path)).collect()}
    assert len(got) == len(talks) and sorted(k.rpartition("#")[2] for k in got if "#" in k) == ["2", "2", "3"]
    assert sorted(k[:8] for k in got if "null" in k) == ["3-<null>", "<null>-3", "<null>-<", "<null>-<"]
    assert sum('"text":"itis"' in v for v in got.values()) == 3 and sum('"err"' in v for v in got.values()) == 2


def test_responses(spark):
    model = spark.createDataFrame([("en", "IT", 0.01), ("en", "IS", 0.02), ("de", "ES", 0.1)], "lang string, term string, prob double")
    df = spark.createDataFrame([(1, "Itis itis", "EN"), (2, " ", "any"), (3, "es", None)], "request_id int, text string, lang string")
    got = {r[0]: r[1] for r in R.respond(df, model, ["de", "en"]).collect()}
    assert '"text":"Itis","lang":"en","tps":[{"term":"It","prob":0.01}' in got[1]
    assert '"err"' in got[2] and '"err"' not in got[1] and '"lang":"de"' in got[3]


def test_stream(spark, tmp_path):
    from lexloom.streaming.segments import segment_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ITIS\nTOREAD\n")
    model = spark.createDataFrame([("en", t, p) for t, p in TOY.items()], "lang string, term string, prob double")
    out = segment_stream(spark.readStream.text(str(tmp_path / "in")), model, "value")
    q = out.writeStream.format("memory").queryName("seg").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r[0] for r in spark.sql("select size(best.tps) from seg").collect()) == [2, 2]


def test_views(spark):
    model = spark.createDataFrame([("EN", "IT", 0.01), ("EN", "IS", 0.02), ("DE", "ITIS", 0.5)], "lang string, term string, prob double")
    df = S.segment(spark.createDataFrame([("itis",), ("",)], "text string"), model, terms=True)
    got = [tuple(r) for r in df.select(R.line_view(S.best()), R.result_view(S.routed("results", F.lit("EN"))), R.share_view(S.shares())).collect()]
    assert got[0][:2] == ("'ITIS' (DE)", "'EN', ('IT': 0.01, 'IS': 2.0E-4)") and got[1][:2] == ("EMPTY", "'EN', ()")
    assert [x.split("  ")[0] for x in got[0][2].split("\n")] == ["(DE)", "(EN)"] and got[0][2].endswith("'IT IS'")


def test_counts_of_a_stream(spark, tmp_path):
    from lexloom.streaming.segments import term_counts

    path = tmp_path / "in"
    spark.createDataFrame([("en", "one two one", "2024-01-01 00:10:00"), ("en", "one", "2024-01-01 01:10:00")], "lang string, text string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(path))
    q = term_counts(spark.readStream.schema("lang string, text string, at timestamp").parquet(str(path)), "at").writeStream.format("memory").outputMode("complete").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["window"]["start"].hour, r["term"]): r["freq"] for r in spark.sql("select * from counts").collect()}
    assert got == {(0, "ONE"): 2, (0, "TWO"): 1, (1, "ONE"): 1}


def test_the_join_has_no_row_for_a_place(spark):
    """Substrings were rows of whole length from each place, on a side that Spark took for small and broadcast."""
    model = spark.createDataFrame([*TOY.items(), ("A" * 90, 0.1)], "term string, prob double")
    df = spark.createDataFrame([(1, "itistoread" * 30), (2, "itistoread" * 30), (3, None)], "text_id int, text string")
    done = S.segment_by_join(df, model)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "BroadcastHashJoin" not in plan
    got = {r["text_id"]: [tuple(x) for x in r["tps"]] for r in done.collect()}
    assert got == {1: brute("itistoread" * 30, TOY), 2: brute("itistoread" * 30, TOY), 3: []}


def test_tables_of_the_join_may_be_full(spark, monkeypatch):
    monkeypatch.setattr(S, "_BITS", 10)
    monkeypatch.setattr(S, "_PART", 50)
    terms = {f"{a}{b}{c}": 0.001 for a in "ABCDEFGH" for b in "ABCDEFGH" for c in "ABCDEFGH"}
    df = spark.createDataFrame([(i, "HEADBEADGA"[i % 7 :] * (1 + i % 5)) for i in range(20)], "text_id int, text string")
    model = spark.createDataFrame(list(terms.items()), "term string, prob double")
    got = {r["text_id"]: [tuple(x) for x in r["tps"]] for r in S.segment_by_join(df, model).collect()}
    assert got == {r["text_id"]: brute(r["text"], terms) for r in df.collect()}


def test_pieces_of_requests_stay_in_their_row(spark, monkeypatch):
    """Each piece was a row that had its request's whole text with it and came back in every language."""
    model = spark.createDataFrame([("en", "IT", 0.01), ("en", "IS", 0.02), ("de", "ES", 0.1)], "lang string, term string, prob double")
    rows = [(1, "Itis itis\nes éß", "EN"), (1, "es", "any"), (2, " ", "any"), (3, None, None), (4, "\x1c \x1c", "de"), (None, "es itis es", "De ")]
    df = spark.createDataFrame(rows, "request_id int, text string, lang string").coalesce(1)
    plain = R.respond(df, model, ["de", "en"])
    assert "Generate" not in plain._jdf.queryExecution().toString()
    want = {r[0]: r[1].partition('"ttps"')[2] for r in plain.collect()}
    assert '"text":"éß","lang":"en","tps":[{"term":"é","prob":0.0},{"term":"ß","prob":0.0}]' in want[1] and '{"term":"\\u001C","prob":1.0}' in want[4] and not want[2]
    monkeypatch.setattr(S, "MAX_TERMS", 1)
    assert {r[0]: r[1].partition('"ttps"')[2] for r in R.respond(df, model, ["de", "en"]).collect()} == want


@pytest.mark.parametrize("dense", [1 << 25, 0])
def test_own_languages_go_side_by_side(monkeypatch, dense):
    """Each language was a run of its own through the recurrence, dense in the lengths of words."""
    monkeypatch.setattr(S, "_DENSE", dense)
    rng = random.Random(2)
    models = {x: {"".join(rng.choices("ABC", k=rng.randint(1, 4))): rng.random() for _ in range(30)} for x in "pqr"}
    rows = [(x, t, p) for x, m in models.items() for t, p in m.items()]
    both = S.Lexicon.of(pa.table(dict(zip(("lang", "term", "prob"), map(list, zip(*rows, strict=True)), strict=True))))
    texts = ["".join(rng.choices("ABC1D", k=rng.randint(0, 30))) for _ in range(90)]
    owns, runs, group = [rng.choice("pqr") for _ in texts], [], S._group
    monkeypatch.setattr(S, "_group", lambda *a: runs.append(a) or group(*a))
    got = S._results(texts, owns, both, both.langs, "all", False).to_pylist()
    assert len(runs) == 1
    assert [[(x["start"], x["len"], x["prob"]) for x in r[0]["tps"]] for r in got] == [brute(t, models[o]) for t, o in zip(texts, owns, strict=True)]
    for give in ("best", "scores"):
        want = S._results(texts, None, both, both.langs, "all", False).to_pylist()
        some = S._results(texts, None, both, both.langs, give, False).to_pylist()
        assert some == ([max(w, key=lambda r: (r["score"], r["lang_idx"])) for w in want] if give == "best" else [[{k: v for k, v in r.items() if k != "tps"} for r in w] for w in want])


@pytest.mark.parametrize("letters", [40, 90, 5000])
def test_models_of_many_characters(letters):
    """Characters beyond the frequent ones are several symbols in the tree of terms."""
    rng = random.Random(3)
    some = [chr(0x4E00 + i) for i in range(letters)]
    model = {x: rng.random() for x in some} | {"".join(rng.choices(some, k=rng.randint(1, 5))): rng.random() for _ in range(3 * letters)}
    lexicon = lex(model)
    assert lexicon.digits == {40: 0, 90: 1, 5000: 3}[letters]
    terms = list(model)
    texts = ["".join(rng.choices([*terms, "1", "Q", "鿿"], k=8)) for _ in range(30)]
    assert run(texts, lexicon) == [brute(t, model) for t in texts]


def test_no_term_is_looked_for_where_nothing_leads(monkeypatch):
    """Texts of probability 0 from some place on were gone over to their ends, as long as others beside them were not."""
    asked, walk = [], S.Lexicon.walk
    monkeypatch.setattr(S.Lexicon, "walk", lambda self, a, b, at, stride: asked.append(len(at)) or walk(self, a, b, at, stride))
    monkeypatch.setattr(S, "_BLOCK", 8)
    texts = ["Q" * 800, "Q" * 800, "1" * 800, "A" * 800]
    assert run(texts, lex({"A": 1.0, "AA": 0.5})) == [brute(t, {"A": 1.0, "AA": 0.5}) for t in texts]
    assert sum(asked) == 2 * 800 + 2 * 8


def test_texts_are_tokenized_once_for_the_model(spark, tmp_path):
    """The cut's passes over the counts each went back to the texts."""
    spark.createDataFrame([(1, "it is to read it", "en"), (2, "es ist gut", "de")], "doc_id int, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    made = registry._counted_model(spark, str(tmp_path))
    assert "documents.parquet" not in made._jdf.queryExecution().toString()
    assert sorted(made.collect()) == sorted(registry._model(spark, str(tmp_path)).collect())


_ODD = [(1, "it is good", "en"), (2, "es ist gut\nJe ne sais pas 漢字 😀", "de"), (3, "", "en"), (4, "it 😀 is\n\nto-day 12", "en"), (5, "q" * 40, "de")]


def _tables(spark, folder):
    spark.createDataFrame(_ODD, "doc_id bigint, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("most", [S.MAX_TERMS, 0])
def test_best_words_leave_the_task_as_a_string(spark, tmp_path, monkeypatch, most):
    """The words of segment_best went through arrays of structs that were joined outside the task."""
    monkeypatch.setattr(S, "MAX_TERMS", most)
    folder = _tables(spark, tmp_path)
    made = registry.segment_best(spark, folder)
    assert "tps" not in made._jdf.queryExecution().toString()
    done = S.segment(registry._lines(spark, folder), registry._counted_model(spark, folder), terms=True, give="best").collect()
    assert sorted(made.collect()) == sorted((r["doc_id"], r["line_no"], r["results"]["lang"], " ".join(w["term"] for w in r["results"]["tps"])) for r in done)
    blank = S.segment(spark.createDataFrame([(" ",), (None,)], "text string"), registry._counted_model(spark, folder), give="best", view="words")
    assert [r["results"]["words"] for r in blank.collect()] == ["", ""]


@pytest.mark.parametrize("most", [S.MAX_TERMS, 0])
def test_rows_of_words_leave_the_task_as_they_are(spark, tmp_path, monkeypatch, most):
    """The rows of segment_text were exploded from arrays of structs."""
    monkeypatch.setattr(S, "MAX_TERMS", most)
    monkeypatch.setattr(S, "_WORDS", 3)
    folder = _tables(spark, tmp_path)
    made = registry.segment_text(spark, folder)
    assert ("tps" in made._jdf.queryExecution().toString()) == (most == 0)
    done = S.segment(registry._lines(spark, folder), registry._counted_model(spark, folder), own="lang", terms=True).collect()
    assert sorted(made.collect()) == sorted((r["doc_id"], r["line_no"], k, w["start"], w["len"], w["term"], w["prob"]) for r in done for k, w in enumerate(r["results"][0]["tps"]))
    with pytest.raises(Exception, match="language not found"):
        S.segment_rows(spark.createDataFrame([("A", "xx")], "text string, lang string"), registry._counted_model(spark, folder), [], "lang").collect()


@pytest.mark.parametrize("most", [S.MAX_TERMS, 0])
def test_line_segments_need_no_words(spark, tmp_path, monkeypatch, most):
    """All words left the task for their number and the last one's probability."""
    monkeypatch.setattr(S, "MAX_TERMS", most)
    folder = _tables(spark, tmp_path)
    made = registry.line_segments(spark, folder)
    assert "tps" not in made._jdf.queryExecution().toString()
    done = S.segment(registry._lines(spark, folder), registry._counted_model(spark, folder), own="lang").collect()
    assert sorted(made.collect()) == sorted((r["doc_id"], r["line_no"], r["lang"], len(x), x[-1]["prob"]) for r in done for x in [r["results"][0]["tps"]])
    blank = S.segment(spark.createDataFrame([(" ",), (None,)], "text string"), registry._counted_model(spark, folder), give="best", view="last")
    assert [(r["results"]["n_terms"], r["results"]["prob"]) for r in blank.collect()] == [(0, None), (0, None)]
