"""The registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import urls as U
from .operators import model as M
from .operators import segment as S
from .plans import requests as R
from .plans.build import build_from_folder
from .sources import model_files as MF
from .sources.shared import materialise, shared_dir, spread

CUT = 1.0
#: Bytes of a shard in shard_files.
SHARD_BYTES = 200_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, doc_id, pos, word of all documents: folded as whole texts, which leaves every character in its place."""
    return _docs(spark, sf_dir).select("lang", "doc_id", F.posexplode(T.simple_tokens(T.fold_upper(F.col("text")))).alias("pos", "word"))


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.build(_words(spark, sf_dir), CUT)


def _counted_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_model() from counts that are written once, so that no text is tokenized again for the cut."""
    words = _words(spark, sf_dir)
    freqs = materialise(M.counts(M.clean_words(words).withColumnRenamed("word", "term")), "term-counts")
    return M.probabilities(freqs, CUT)


_FOLD = T.fold_upper_sql("text")
#: The simple tokenizer in SQL; RE2 knows the same letters, and white space is spelt out.
_TOKENS = r"""
pieces AS MATERIALIZED (SELECT lang, doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) AS i FROM (SELECT lang, doc_id, regexp_split_to_array(regexp_replace(FOLD, '[\x00-\x1E]', ' ', 'g'), '[\t-\r \x{85}\x{A0}\p{Z}]+') AS ps FROM documents)),
cut AS (SELECT lang, doc_id, i, t, regexp_replace(t, '^[^\p{L}]+|[^\p{L}]+$', '', 'g') AS w FROM pieces WHERE t <> ''),
words AS MATERIALIZED (SELECT lang, doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, w AS word FROM cut WHERE w <> '' AND (w = t OR length(w) > 1))
""".replace("FOLD", _FOLD)
_COUNTS = _TOKENS + ", freqs AS (SELECT lang, word AS term, count(*) AS freq FROM words WHERE length(word) <= 100 GROUP BY ALL)"
_MODEL = _COUNTS + f""", ranked AS (SELECT *, sum(freq) OVER (PARTITION BY lang) AS total, sum(freq) OVER (PARTITION BY lang ORDER BY freq DESC, term ROWS UNBOUNDED PRECEDING) AS running FROM freqs),
model AS MATERIALIZED (SELECT lang, term, freq, freq::DOUBLE / total AS prob FROM ranked WHERE running <= (total::FLOAT * {100 - CUT}::FLOAT)::DOUBLE / 100)
"""


@query(f"SELECT doc_id, {_FOLD} AS folded, length(text)::INT AS n FROM documents")
def fold_upper(spark, sf_dir):
    """Upper case, a character for a character."""
    return _docs(spark, sf_dir).select("doc_id", T.fold_upper(F.col("text")).alias("folded"), F.length("text").alias("n"))


#: Texts of kinds that the tables lack, with ids below zero.
SAMPLES = (
    (-1, "ru", "Мама мыла раму 2020 раза"), (-2, "ru", "ёж и Ёлка"), (-3, "ru", "аbc12345678901234567"), (-4, "ru", "1234"), (-5, "ru", "привет, world! да-да"), (-6, "ru", "абв12 xyz9 где"),
    (-7, "ru", "Я"), (-8, "ru", "‒–—―"), (-9, "ru", "слово–слово"), (-10, "ru", ""), (-11, "ru", "АЯаяЀѐ"), (-12, "ru", "abcабв"), (-13, "ru", "Q"), (-14, "ru", "а1 б2 в3 г4 д5"), (-15, "ru", "x2y а3б ёж"),
)
_SAMPLES = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{lang}', '{t}')" for i, lang, t in SAMPLES) + ") AS v(doc_id, lang, text)"
_WITH_SAMPLES = f"(SELECT doc_id, lang, text FROM documents UNION ALL {_SAMPLES})"


def _with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "text")
    return docs.unionByName(spark.createDataFrame(SAMPLES, "doc_id bigint, lang string, text string"))


def _share(n: str) -> str:
    return f"floor((0.5::FLOAT * {n}::FLOAT)::DOUBLE)"


_LETTERS = r"len(regexp_extract_all(text, '\p{L}'))"
_CYR = "len(regexp_extract_all(text, '[А-я]'))"


@query(rf"""SELECT doc_id, regexp_matches(text, '[0-9]') AS digits, regexp_matches(text, '[А-яЁё]') AS cyrillics, regexp_matches(text, '[0-9А-яЁё]') AS both_kinds,
regexp_matches(text, '^\p{{L}}+$') AS letters, regexp_matches(text, '^[\p{{L}}‒-―]+$') AS letters_dash, regexp_matches(text, '\p{{L}}') AS some_letter,
({_CYR} > 0 AND {_CYR} >= {_share('length(text)')}) OR {_CYR} >= {_share(_LETTERS)} AS cyrillic_share FROM {_WITH_SAMPLES}""")
def char_predicates(spark, sf_dir):
    """Tests of character classes, on all documents and on SAMPLES."""
    t = F.col("text")
    return _with_samples(spark, sf_dir).select("doc_id", T.has_digits(t).alias("digits"), T.has_cyrillics(t).alias("cyrillics"), T.has_cyrillics_or_digits(t).alias("both_kinds"), T.is_letters(t).alias("letters"), T.is_letters_or_dash(t).alias("letters_dash"), T.has_letters(t).alias("some_letter"), T.has_cyrillic_letters(t, 50).alias("cyrillic_share"))


SIZES = (0, 1023, 1024, 1025, 1536, 1 << 20, (1 << 20) + 1, 5_000_000, 1 << 30, (1 << 30) + 1, 1_234_567_890_123)


@query("SELECT n, CASE WHEN n > 1073741824 THEN format('{:,.2f}', n / 1073741824.0::DOUBLE) || ' GB' WHEN n > 1048576 THEN format('{:,.2f}', n / 1048576.0::DOUBLE) || ' MB' WHEN n > 1024 THEN format('{:,.2f}', n / 1024.0::DOUBLE) || ' KB' ELSE n || ' bytes' END AS size FROM "
    + "(SELECT strlen(text)::BIGINT AS n FROM documents UNION ALL VALUES " + ", ".join(f"({n}::BIGINT)" for n in SIZES) + ")")
def size_display(spark, sf_dir):
    """Sizes of all documents and of SIZES, which reach every unit."""
    n = _docs(spark, sf_dir).select(F.octet_length("text").cast("bigint").alias("n")).unionByName(spark.createDataFrame([(x,) for x in SIZES], "n bigint"))
    return n.select("n", T.display_size(F.col("n")).alias("size"))


_TRIMMED = r"regexp_replace(text, '^[\t-\r \x{FEFF}\p{Z}]+|[\t-\r \x{FEFF}\p{Z}]+$', '', 'g')"


@query(rf"SELECT doc_id, length({_TRIMMED})::INT AS trimmed, md5(regexp_replace(text, '(?s)(.{{50}})', '\1<wbr/>', 'g')) AS wrapped, length(substr({_TRIMMED}, 1, 10000))::INT AS limited FROM documents")
def input_limits(spark, sf_dir):
    """Trimmed and wrapped texts, and the recommended most of a request's text."""
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.length(T.trim_text(t)).alias("trimmed"), F.md5(T.wrap_text(t).cast("binary")).alias("wrapped"), F.length(T.limit_text(t)).alias("limited"))


@query(r'''SELECT page_id, 0 AS n, 0 AS start, length(v)::INT AS len, v AS value FROM (SELECT page_id, regexp_replace(url, '[!"#%&''()*,\-.:;?@\[\\\]_{}]+$', '') AS v FROM pages WHERE regexp_matches(url, '^(?i)https?://[!-~]+$'))''')
def scheme_urls(spark, sf_dir):
    """UR5, UR6 on a restricted pattern: addresses of pages that are one URL with a scheme."""
    found = U.with_urls(_table(spark, sf_dir, "pages").filter(F.col("url").rlike(r"^(?i)https?://[!-~]+\z")).select("page_id", "url"), "url")
    return found.select("page_id", F.posexplode("urls").alias("n", "u")).select("page_id", "n", "u.start", "u.len", "u.value")


@query(rf"""SELECT c, regexp_matches(c, '^\p{{L}}$') AS letter, regexp_matches(c, '^\p{{Nd}}$') AS digit, regexp_matches(c, '^[\t-\r \x{{85}}\x{{A0}}\p{{Z}}]$') AS space, regexp_matches(c, '^\p{{P}}$') AS punct,
regexp_matches(c, '^[\t-\r \x{{85}}\x{{A0}}\p{{Z}}]$') OR c = chr(0) OR (regexp_matches(c, '^\p{{P}}$') AND ord(c) > 127) AS url_break, regexp_matches(c, '^[A-Za-z-]$') AS scheme, c IN ('.', chr(65535)) AS dot, c IN ('/', '\') AS slash
FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM (SELECT text FROM {_WITH_SAMPLES} UNION ALL SELECT html FROM pages)) WHERE c <> ''""")
def char_classes(spark, sf_dir):
    """What each character of the documents, the pages and SAMPLES is."""
    texts = _with_samples(spark, sf_dir).select("text").unionByName(_table(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    # Characters of one text first, so that few rows are shuffled.
    chars = texts.select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).filter("c <> ''").distinct()
    return chars.select("c", T.char_kinds(F.col("c")).alias("k")).select("c", "k.*")


@query(r"""SELECT conv_id, turn, lower(text) AS low, replace(text, ' ', '') AS joined, regexp_replace(text, '[\x00-\x1E]', ' ', 'g') AS visible, NOT regexp_matches(text, '[^\t-\r \x{85}\x{A0}\p{Z}]') AS blank,
CASE WHEN strlen(text) > 1024 THEN format('{:,.2f}', strlen(text) / 1024.0::DOUBLE) || ' KB' ELSE strlen(text) || ' bytes' END AS size FROM conversations""")
def string_functions(spark, sf_dir):
    """Lower case, joining, visible characters, blank texts, sizes."""
    t = F.col("text")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(t).alias("low"), T.no_spaces(t).alias("joined"), T.replace_invisible(t).alias("visible"), T.is_blank(t).alias("blank"), T.display_size(F.octet_length(t)).alias("size"))


@query(f"WITH {_TOKENS} SELECT lang, doc_id, pos, word FROM words")
def simple_tokenizer(spark, sf_dir):
    """TK5: words trimmed to letters."""
    return _words(spark, sf_dir)


@query(r"""SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INT AS row_no, piece FROM
(SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[\r\n ]')) AS piece, generate_subscripts(regexp_split_to_array(text, '[\r\n ]'), 1) AS i FROM conversations) WHERE regexp_matches(piece, '[^\t-\r \x{85}\x{A0}\p{Z}]')""")
def request_rows(spark, sf_dir):
    """A row for each piece of a request."""
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.split_rows(F.col("text"))).alias("row_no", "piece"))


@query(f"WITH {_COUNTS} SELECT lang, term, freq FROM freqs")
def term_counts(spark, sf_dir):
    """A1, A2, F1: occurrences of each term."""
    return M.counts(M.clean_words(_words(spark, sf_dir)).withColumnRenamed("word", "term"))


@query(f"""WITH {_TOKENS.replace('FROM documents', f'FROM {_WITH_SAMPLES}')} SELECT lang, count(*) AS n_all, count(*) FILTER (length(word) <= 10) AS n_short, count(*) FILTER (NOT regexp_matches(word, '[А-яЁё]')) AS n_no_cyrillics,
count(*) FILTER (NOT regexp_matches(word, '[0-9]')) AS n_no_digits, count(*) FILTER (NOT regexp_matches(word, '[0-9А-яЁё]')) AS n_neither FROM words GROUP BY lang""")
def word_filters(spark, sf_dir):
    """Words that each set of filters keeps, of all documents and of SAMPLES."""
    w = F.col("word")
    n = lambda ok: F.count(F.when(ok, 1))
    words = _with_samples(spark, sf_dir).select("lang", F.explode(T.simple_tokens(T.fold_upper(F.col("text")))).alias("word"))
    return words.groupBy("lang").agg(F.count(F.lit(1)).alias("n_all"), n(M.kept(w, 10)).alias("n_short"), n(M.kept(w, 1 << 30, True)).alias("n_no_cyrillics"), n(M.kept(w, 1 << 30, False, True)).alias("n_no_digits"), n(M.kept(w, 1 << 30, True, True)).alias("n_neither"))


@query(f"WITH {_COUNTS} SELECT lang, term, freq, freq::DOUBLE / sum(freq) OVER (PARTITION BY lang) AS prob FROM freqs")
def term_probabilities(spark, sf_dir):
    """Probabilities without a cut."""
    return M.build(_words(spark, sf_dir)).select("lang", "term", "freq", "prob")


@query(f"WITH {_MODEL} SELECT lang, term, freq, prob FROM model")
def unigram_model(spark, sf_dir):
    """A5-A10: the model of each language with its rare tail cut."""
    return _model(spark, sf_dir).select("lang", "term", "freq", "prob")


@query(f"WITH {_MODEL} SELECT lang, term, prob, row_number() OVER (PARTITION BY lang ORDER BY prob DESC, term)::INT AS place FROM model")
def model_order(spark, sf_dir):
    """O1-O3, K1: the order of records in a model file."""
    return M.places(_model(spark, sf_dir).select("lang", "term", "prob"))


@query(f"""WITH {_TOKENS}, marked AS (SELECT *, length(word) <= 100 AS ok FROM words), runs AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY lang, doc_id ORDER BY pos) AS run FROM marked),
kept AS (SELECT *, lag(word, 1) OVER w AS b1, lag(word, 2) OVER w AS b2, lag(word, 3) OVER w AS b3 FROM runs WHERE ok WINDOW w AS (PARTITION BY lang, doc_id, run ORDER BY pos)),
grams AS (SELECT lang, word AS term FROM kept UNION ALL SELECT lang, b1 || ' ' || word FROM kept WHERE b1 IS NOT NULL UNION ALL SELECT lang, b2 || ' ' || b1 || ' ' || word FROM kept WHERE b2 IS NOT NULL
UNION ALL SELECT lang, b3 || ' ' || b2 || ' ' || b1 || ' ' || word FROM kept WHERE b3 IS NOT NULL),
u AS (SELECT lang, count(*) AS n FROM kept GROUP BY lang) SELECT lang, term, count(*) AS freq, count(*)::DOUBLE / any_value(n) AS prob FROM grams JOIN u USING (lang) GROUP BY lang, term""")
def ngram_model(spark, sf_dir):
    """A3: n-grams of 1 to 4 words of up to 100 characters; none goes over a word that is left out."""
    tokens = _docs(spark, sf_dir).select("lang", T.simple_tokens(T.fold_upper(F.col("text"))).alias("words"))
    return M.build_ngrams(tokens, 4).select("lang", "term", "freq", "prob")


def _shards(model: DataFrame) -> DataFrame:
    """Each record twice, the second time in a later shard with another probability."""
    first = model.select(F.lit(0).alias("shard_no"), F.length("term").cast("long").alias("pos"), "lang", "term", "prob")
    return first.unionByName(first.withColumn("shard_no", F.lit(1)).withColumn("prob", F.col("prob") / 2))


@query(f"WITH {_MODEL} SELECT lang, term, prob FROM model")
def shard_union(spark, sf_dir):
    """Shards together, the first record of a term."""
    return M.first_wins(_shards(_model(spark, sf_dir))).select("lang", "term", "prob")


@query(f"WITH {_MODEL} SELECT lang, term, prob FROM model WHERE lang = 'en'")
def shard_files(spark, sf_dir):
    """A model written as binary shards of a bounded size and read again."""
    folder = shared_dir(spark, "shards")
    MF.write_shards(_model(spark, sf_dir).filter("lang = 'en'"), folder, "model", SHARD_BYTES)
    return M.first_wins(MF.read_shards(spark, folder, "en")).select("lang", "term", "prob")


@query(f"WITH {_MODEL} SELECT lang, term, prob::FLOAT::DOUBLE AS prob FROM model WHERE lang = 'de'")
def text_files(spark, sf_dir):
    """K1, S3: a model written as a text file, in order, and read again."""
    path = shared_dir(spark, "model-text")
    MF.write_text(_model(spark, sf_dir).filter("lang = 'de'"), path, "'de' (ngram_1-cut_1%)")
    return MF.read_text(spark, path, "de")


@query(f"WITH {_MODEL} SELECT lang, term, freq, prob FROM model WHERE lang = 'fr'")
def folder_model(spark, sf_dir):
    """The documents of a language as text files, and the model of their folder, by the simple tokenizer."""
    folder = shared_dir(spark, "corpus")
    _docs(spark, sf_dir).filter("lang = 'fr'").select("text").repartition(3).write.text(folder)
    simple = lambda lines: lines.withColumn("words", T.simple_tokens(T.fold_upper(F.col("text"))))
    return build_from_folder(spark, folder, "fr", cut_percent=CUT, tokenize=simple).select("lang", "term", "freq", "prob")


@query(f"WITH {_MODEL} SELECT lang, term, prob::FLOAT::DOUBLE AS prob FROM model")
def model_lines(spark, sf_dir):
    """Records written as lines and parsed again, in single precision; no term twice."""
    line = F.concat_ws("\t", "term", F.col("prob").cast("string"))
    parsed = _model(spark, sf_dir).select("lang", MF.parse_line(line).alias("r")).select("lang", "r.term", "r.prob")
    return M.require_unique(parsed)


@query(f"""WITH {_MODEL}, other AS (SELECT lang, term, prob FROM model WHERE length(term) > 3 UNION ALL SELECT lang, term, prob * 2 FROM model WHERE length(term) = 3)
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.term, b.term) AS term, a.prob AS prob_a, b.prob AS prob_b FROM model a FULL JOIN other b ON a.lang = b.lang AND a.term = b.term WHERE a.prob IS DISTINCT FROM b.prob""")
def model_compare(spark, sf_dir):
    """Records in which two models differ."""
    a = _model(spark, sf_dir)
    b = a.filter(F.length("term") > 3).unionByName(a.filter(F.length("term") == 3).withColumn("prob", F.col("prob") * 2))
    return M.differences(a, b)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct piece of the conversations."""
    return _table(spark, sf_dir, "conversations").select(F.explode(T.split_rows(F.col("text"))).alias("text")).distinct()


_BLANK = r"[^\t-\r \x{85}\x{A0}\p{Z}]"
_PIECES = rf"""pieces2 AS (SELECT DISTINCT piece AS text FROM (SELECT unnest(regexp_split_to_array(text, '[\r\n ]')) AS piece FROM conversations) WHERE regexp_matches(piece, '{_BLANK}')),
texts AS (SELECT text, {_FOLD} AS t, length(text) AS n FROM pieces2)"""


@query(f"WITH {_MODEL}, {_PIECES} SELECT text, lang, CASE WHEN length(text) = 1 AND NOT regexp_matches(text, '^[\\p{{L}}‒-―]$') THEN 1.0::DOUBLE ELSE coalesce(prob, 0.0)::DOUBLE END AS weight FROM texts CROSS JOIN (SELECT DISTINCT lang AS lang FROM model) l LEFT JOIN (SELECT lang AS ml, term, prob FROM model) m ON ml = l.lang AND term = t")
def model_lookup(spark, sf_dir):
    """The weight of each piece as one word, in each language."""
    model = _model(spark, sf_dir)
    langs = _docs(spark, sf_dir).select("lang").distinct()  # a row a language
    asked = _pieces(spark, sf_dir).withColumn("term", T.fold_upper(F.col("text"))).join(F.broadcast(langs))
    joined = asked.join(model.select("lang", "term", "prob"), ["lang", "term"], "left")
    free = (F.length("text") == 1) & ~T.is_letters_or_dash(F.col("text"))
    return joined.select("text", "lang", F.when(free, 1.0).otherwise(F.coalesce("prob", F.lit(0.0))).alias("weight"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, line_no, text: each line of all documents without its spaces, if it isn't blank."""
    lines = _docs(spark, sf_dir).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "lang", "line_no", T.no_spaces(F.col("line")).alias("text")).filter(~T.is_blank(F.col("text")))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct line of the conversations without its spaces."""
    lines = _table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("line"))
    # Texts are costly: a number of parts of its own keeps them from being put together for their few bytes.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return lines.select(T.no_spaces(F.col("line")).alias("text")).filter(~T.is_blank(F.col("text"))).repartition(parts, "text").distinct()


_LINES = rf"""lines AS MATERIALIZED (SELECT doc_id, lang AS own, line_no::INT AS line_no, replace(line, ' ', '') AS text FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) WHERE regexp_matches(replace(line, ' ', ''), '{_BLANK}'))"""
#: Documents without a language have no language of their own.
_OWN_LINES = _LINES.replace("FROM documents)", "FROM documents WHERE lang IS NOT NULL)")
_TURNS = rf"""lines AS MATERIALIZED (SELECT DISTINCT replace(line, ' ', '') AS text FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE regexp_matches(replace(line, ' ', ''), '{_BLANK}'))"""


def _viterbi(lines: str, own: bool = False) -> str:
    """The recurrence in SQL: substrings from windows of each distinct text, then a fold with P and the lengths of last words in lists."""
    same, word = ("AND lang = own", "l.lang = own") if own else ("", "TRUE")
    return rf"""WITH {_MODEL}, {lines},
texts AS MATERIALIZED (SELECT row_number() OVER () AS id, own, text, {_FOLD} AS t, length(text) AS n FROM (SELECT DISTINCT {'own' if own else 'NULL AS own'}, text FROM lines)),
wins AS (SELECT id, own, s, n, substr(t, s + 1, 256 + longest) AS w, longest FROM (SELECT id, own, t, n, unnest(range(0, n, 256)) AS s FROM texts), (SELECT max(length(term)) AS longest FROM model)),
starts AS (SELECT *, unnest(range(0, least(256, n - s))) AS o FROM wins),
subs AS (SELECT id, own, s + o + k AS e, k, substr(w, o + 1, k) AS term FROM (SELECT *, unnest(range(1, least(longest, n - s - o) + 1)) AS k FROM starts)),
found AS (SELECT id, lang, e, k, prob AS g FROM subs JOIN model USING (term) WHERE k > 1 {same}
  UNION ALL SELECT id, l.lang, e, k, CASE WHEN NOT regexp_matches(subs.term, '^[\p{{L}}‒-―]$') THEN 1.0::DOUBLE ELSE coalesce(m.prob, 0.0)::DOUBLE END
  FROM subs JOIN (SELECT DISTINCT lang FROM model) l ON {word} LEFT JOIN model m ON m.lang = l.lang AND m.term = subs.term WHERE k = 1),
ends AS MATERIALIZED (SELECT id, lang, list({{'p': NULL::DOUBLE[], 'b': NULL::BIGINT[], 'c': c}} ORDER BY e) AS xs FROM (SELECT id, lang, e, list({{'k': k, 'g': g}} ORDER BY k DESC) AS c FROM found GROUP BY id, lang, e) GROUP BY id, lang),
walks AS MATERIALIZED (SELECT id, lang, list_reduce(xs, lambda a, x: list_transform([list_reduce(list_transform(x.c, lambda y: {{'q': a.p[len(a.p) - y.k + 1] * y.g, 'k': y.k}}), lambda u, v: CASE WHEN u.q <= v.q THEN v ELSE u END)],
  lambda best: {{'p': list_append(a.p, best.q), 'b': list_append(a.b, best.k), 'c': x.c[1:0]}})[1], {{'p': [1.0::DOUBLE], 'b': [0::BIGINT], 'c': xs[1].c}}) AS r FROM ends),
backs AS (SELECT id, lang, r, list_reduce(list_transform(range(len(r.b) - 1), lambda i: {{'at': i, 'o': NULL::BIGINT[]}}), lambda a, x: CASE WHEN a.at = 0 THEN a ELSE {{'at': a.at - r.b[a.at + 1], 'o': list_append(a.o, a.at)}} END, {{'at': len(r.b) - 1, 'o': []::BIGINT[]}}).o AS o FROM walks),
tps AS MATERIALIZED (SELECT id, lang, list_transform(list_reverse(o), lambda e: {{'start': e - r.b[e + 1], 'len': r.b[e + 1], 'prob': r.p[e + 1]}}) AS tps FROM backs),
scores AS (SELECT own, text, lang, list_transform(tps, lambda x: {{'term': substr(t, x.start + 1, x.len), 'start': x.start, 'len': x.len, 'prob': x.prob}}) AS tps, row_number() OVER (PARTITION BY id ORDER BY lang) - 1 AS lang_idx, array_to_string(list_transform(tps, lambda x: substr(t, x.start + 1, x.len)), ' ') AS words,
  CASE WHEN list_min(list_transform(tps, lambda x: x.prob)) = 0 THEN -1.7976931348623157e308::DOUBLE ELSE list_sum(list_transform(tps, lambda x: CASE WHEN x.prob = 0 THEN 0 ELSE ln(x.prob) END)) END AS score FROM tps JOIN texts USING (id)),
shares AS (SELECT *, x / sum(x) OVER (PARTITION BY text) AS share FROM (SELECT *, CASE WHEN min(score) OVER (PARTITION BY text) = 0 THEN 'NaN'::DOUBLE ELSE exp(score / abs(min(score) OVER (PARTITION BY text))) END AS x FROM scores)),
bests AS (SELECT text, max_by(lang, (score, lang_idx)) AS lang, max_by(words, (score, lang_idx)) AS words FROM scores GROUP BY text)
"""


def _joined_words(tps: Column) -> Column:
    return F.array_join(F.transform(tps, lambda w: w["term"]), " ")


@query(_viterbi(_OWN_LINES, True) + "SELECT doc_id, line_no, (generate_subscripts(tps, 1) - 1)::INT AS place, unnest(tps).start::INT AS start, unnest(tps).len::INT AS len, unnest(tps).term AS term, unnest(tps).prob AS prob FROM scores JOIN lines USING (own, text)")
def segment_text(spark, sf_dir):
    """The words of each document's lines without their spaces, in its own language (of documents that have one); start and len are in the joined line."""
    return S.segment_rows(_lines(spark, sf_dir).filter("lang IS NOT NULL"), _counted_model(spark, sf_dir), ["doc_id", "line_no"], "lang")


@query(_viterbi(_LINES) + "SELECT doc_id, line_no, lang, words FROM lines JOIN bests USING (text)")
def segment_best(spark, sf_dir):
    """The best language of each document's lines without their spaces, and the words."""
    done = S.segment(_lines(spark, sf_dir).drop("lang"), _counted_model(spark, sf_dir), out="best", give="best", view="words")
    return done.select("doc_id", "line_no", "best.lang", "best.words")


@query(_viterbi(_LINES) + "SELECT doc_id, line_no, lang, lang_idx::INT AS lang_idx, CASE WHEN score > -1e300 THEN round(score, 3) ELSE score END AS score, round(share, 6) AS share FROM lines JOIN shares USING (text)")
def segment_all(spark, sf_dir):
    """The score and share of each language for each document's lines without their spaces."""
    done = S.segment(_lines(spark, sf_dir).drop("lang"), _counted_model(spark, sf_dir), give="scores")
    rows = done.select("doc_id", "line_no", F.explode(S.shares(tps=False)).alias("r"))
    score = F.when(F.col("r.score") > -1e300, F.round("r.score", 3)).otherwise(F.col("r.score"))
    return rows.select("doc_id", "line_no", "r.lang", "r.lang_idx", score.alias("score"), F.round("r.share", 6).alias("share"))


@query(_viterbi(_OWN_LINES, True) + "SELECT doc_id, line_no, lang, len(tps)::INT AS n_terms, tps[-1].prob AS prob FROM scores JOIN lines USING (own, text)")
def line_segments(spark, sf_dir):
    """How many words each document's lines without their spaces have in its own language, and their probability."""
    done = S.segment(_lines(spark, sf_dir).filter("lang IS NOT NULL"), _counted_model(spark, sf_dir), own="lang", view="last")
    return done.select("doc_id", "line_no", "lang", F.col("results")[0]["n_terms"].alias("n_terms"), F.col("results")[0]["prob"].alias("prob"))


def _segmented(spark: SparkSession, sf_dir: str, **asked) -> DataFrame:
    return S.segment(_turns(spark, sf_dir), _counted_model(spark, sf_dir), **({"terms": True} | asked))


@query(_viterbi(_TURNS) + "SELECT text, lang, (generate_subscripts(tps, 1) - 1)::INT AS place, unnest(tps).start::INT AS start, unnest(tps).len::INT AS len, unnest(tps).term AS term, unnest(tps).prob AS prob FROM scores")
def viterbi_terms(spark, sf_dir):
    """V2-V5, V7: the words of each line of the conversations in each language, with offsets and prefix probabilities."""
    rows = _segmented(spark, sf_dir).select("text", F.explode("results").alias("r"))
    rows = rows.select("text", "r.lang", F.posexplode("r.tps").alias("place", "w"))
    return rows.select("text", "lang", "place", "w.start", "w.len", "w.term", "w.prob")


@query(_viterbi(_TURNS) + "SELECT text, lang, words FROM bests")
def best_language(spark, sf_dir):
    """The best language of each line of the conversations and its words."""
    top = S.segment(_turns(spark, sf_dir), _counted_model(spark, sf_dir), out="best", give="best", view="words")
    return top.select("text", "best.lang", "best.words")


@query(_viterbi(_TURNS) + "SELECT text, lang, lang_idx::INT AS lang_idx, CASE WHEN score > -1e300 THEN round(score, 3) ELSE score END AS score, round(share, 6) AS share FROM shares")
def all_languages(spark, sf_dir):
    """The score and share of each language for each line of the conversations."""
    rows = _segmented(spark, sf_dir, terms=False, give="scores").select("text", F.explode(S.shares(tps=False)).alias("r"))
    score = F.when(F.col("r.score") > -1e300, F.round("r.score", 3)).otherwise(F.col("r.score"))
    return rows.select("text", "r.lang", "r.lang_idx", score.alias("score"), F.round("r.share", 6).alias("share"))


@query(_viterbi(_TURNS) + "SELECT text, lang, words FROM scores WHERE lang = 'de'")
def routed_language(spark, sf_dir):
    """One language's words."""
    one = S.routed("results", F.lit("de"))
    return _segmented(spark, sf_dir, langs=["de"]).select("text", one["lang"].alias("lang"), _joined_words(one["tps"]).alias("words"))


@query(_viterbi(_TURNS) + "SELECT text, '''' || words || ''' (' || lang || ')' AS line FROM bests")
def console_lines(spark, sf_dir):
    """K5: the best words and language as a line."""
    return _segmented(spark, sf_dir, give="best").select("text", R.line_view(F.col("results")).alias("line"))


@query(_viterbi(_TURNS) + "SELECT text, string_agg('(' || lang || ')  ' || format('{:,.2f}', share * 100) || '%  ''' || words || '''', chr(10) ORDER BY share DESC, lang_idx) AS lines FROM (SELECT * REPLACE (round(share, 9) AS share) FROM shares) GROUP BY text")
def share_lines(spark, sf_dir):
    """All languages by falling share, with percent and words."""
    rounded = F.transform(S.shares(), lambda r: r.withField("share", F.round(r["share"], 9)))
    return _segmented(spark, sf_dir).select("text", R.share_view(rounded).alias("lines"))


@query(_viterbi(_TURNS) + "SELECT text, '''' || lang || ''', (' || array_to_string(list_transform(tps, lambda x: '''' || x.term || ''''), ', ') || ')' AS result FROM scores JOIN bests USING (text, lang)")
def result_strings(spark, sf_dir):
    """A result as a string, here without the probabilities, which engines write in their own ways."""
    return _segmented(spark, sf_dir, give="best").select("text", R.result_view(F.col("results"), probs=False).alias("result"))


@query(_viterbi(_TURNS) + "SELECT text, (generate_subscripts(tps, 1) - 1)::INT AS place, unnest(tps).start::INT AS start, unnest(tps).len::INT AS len, unnest(tps).prob AS prob FROM scores WHERE lang = 'es'")
def segment_join(spark, sf_dir):
    """V2-V4, J1 by the plan for models of any size: words of each line of the conversations in one language."""
    done = S.segment_by_join(_turns(spark, sf_dir), _model(spark, sf_dir).filter("lang = 'es'"), id_col="text")
    return done.select("text", F.posexplode("tps").alias("place", "x")).select("text", "place", "x.start", "x.len", "x.prob")


@query()
def request_responses(spark, sf_dir):
    """A JSON response for each row of conversations, any language.

    The id has conv_id, turn (<null> for a null) and the text's hash; the second and later rows of one id have their number too.
    """
    text_hash = F.xxhash64("text").cast("string")
    parts = [*[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in ("conv_id", "turn")], text_hash]
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws("-", *parts).alias("id"), "text")
    place = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    asked = turns.withColumn("k", place).select(F.when(F.col("k") > 1, F.concat("id", F.lit("#"), "k")).otherwise(F.col("id")).alias("request_id"), "text", F.lit("any").alias("lang"))
    model = S.prepared(_model(spark, sf_dir))
    return R.respond(asked, model, S.languages(model))


_ASKED = rf"""lines AS MATERIALIZED (SELECT DISTINCT text FROM (SELECT unnest(regexp_split_to_array(text, '[\r\n ]')) AS text FROM conversations) WHERE regexp_matches(text, '{_BLANK}')),
asked AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS row_no, text FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[\r\n ]')) AS text, generate_subscripts(regexp_split_to_array(text, '[\r\n ]'), 1) AS i FROM conversations) WHERE regexp_matches(text, '{_BLANK}'))"""


@query(_viterbi(_ASKED) + """, top AS (SELECT scores.text, scores.lang, tps FROM scores JOIN bests USING (text, lang))
SELECT conv_id, turn, row_no::INT AS row_no, text, lang, array_to_string(list_transform(tps, lambda x: substr(text, x.start + 1, x.len)), ' ') AS words, tps[-1].prob AS prob, NULL::VARCHAR AS err FROM asked JOIN top USING (text)
UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, NULL, NULL, 'text is blank' FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.conv_id = c.conv_id AND a.turn = c.turn)""")
def response_rows(spark, sf_dir):
    """The fields of the JSON responses to each turn of the conversations, a row for each of its pieces or an error."""
    asked = _table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), "text", F.lit("any").alias("lang"))
    model = S.prepared(_model(spark, sf_dir))
    kind = "ip struct<text:string,lang:string>, ttps array<struct<text:string,lang:string,tps:array<struct<term:string,prob:double>>>>, err string"
    rows = R.respond(asked, model, S.languages(model)).select("request_id", F.from_json("response", kind).alias("r")).select("request_id", "r.err", F.posexplode_outer("r.ttps").alias("row_no", "x"))
    id_part = lambda k: F.split("request_id", "-")[k].cast("bigint")
    words = F.array_join(F.transform("x.tps", lambda t: t["term"]), " ")
    return rows.select(id_part(0).alias("conv_id"), id_part(1).alias("turn"), "row_no", "x.text", "x.lang", words.alias("words"), F.try_element_at("x.tps", F.lit(-1))["prob"].alias("prob"), "err")


@query(r"""WITH l AS (SELECT doc_id, (generate_subscripts(ls, 1) - 1)::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
w AS (SELECT doc_id, line_no, i, t, regexp_replace(t, '\.+$', '') AS w FROM (SELECT doc_id, line_no, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, line_no, regexp_extract_all(FOLD, '[^ ,]+') AS ws FROM l WHERE line <> '' AND NOT regexp_matches(line, '[^\p{L} ,.]|\.[^ ]'))))
SELECT doc_id, line_no, (row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1)::INT AS pos, w AS word FROM w WHERE w <> '' AND (w = t OR length(w) > 1)""".replace("FOLD", T.fold_upper_sql("line")))
def exact_tokenizer_plain(spark, sf_dir):
    """TK1, TK3, TK4 on a restricted pattern: lines of letters, spaces and commas, with full stops before a space or the end."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    plain = lines.filter((F.col("line") != "") & ~F.col("line").rlike(r"[^\p{L} ,.]|\.[^ ]"))
    return U.with_words(plain, "line").select("doc_id", "line_no", F.posexplode("words").alias("pos", "word"))


@query()
def url_spans(spark, sf_dir):
    """UR1-UR8: URLs in the source of each page."""
    found = U.with_urls(_table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return found.select("page_id", F.posexplode("urls").alias("n", "u")).select("page_id", "n", "u.start", "u.len", "u.value")


@query()
def exact_tokenizer(spark, sf_dir):
    """TK1-TK4: words of each document by the exact rules."""
    return U.with_words(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.posexplode("words").alias("pos", "word"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of all languages from the documents, then the words of each document's lines without their spaces in its own language."""
    return segment_text(spark, sf_dir)
