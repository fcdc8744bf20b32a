"""Requests for segmentation and their views."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, split_rows
from ..operators import segment as S

EMPTY = "-= EMPTY =-"


def pieces(requests: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """id, row_no, piece: a row for each piece of a request, in order."""
    return requests.select(id_col, F.posexplode(split_rows(F.col(text))).alias("row_no", "piece"))


_ITEMS = "array<struct<row:int,text:string,lang:string,tps:array<struct<term:string,prob:double>>>>"


def respond(requests: DataFrame, model, langs: list[str], id_col: str = "request_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id, response (JSON without nulls) of requests (id, text, lang); lang is any of `langs`, in any case, or else all are tried.

    A blank text gives an error message. With a model sent to executors a
    request's pieces never leave its row; each distinct piece of a batch is
    segmented once.
    """
    asked = F.upper(F.trim(F.col(lang)))
    known = {x.upper(): x for x in langs}
    code = F.element_at(F.create_map(*[F.lit(v) for kv in known.items() for v in kv]), asked)
    model = model if isinstance(model, S.Lexicon) else S.prepared(model)
    first = [F.first("_text").alias("_text"), F.first("_lang").alias("_lang")]
    plain = requests.select(F.col(id_col), F.col(text).alias("_text"), F.col(lang).alias("_lang"), code.alias("_code"), split_rows(F.col(text)).alias("_pieces"))
    if isinstance(model, S.Lexicon):
        answered = _answered(plain, model, langs, id_col)
        grouped = answered.groupBy(id_col).agg(*first, F.sort_array(F.flatten(F.collect_list("_items"))).alias("_items"))  # a request's own pieces
    else:
        rows = plain.select(id_col, "_code", F.posexplode("_pieces").alias("_row", "_piece"))
        done = S.segment(rows, model, "_piece", langs)
        result = F.when(F.col("_code").isNull(), S.best()).otherwise(S.routed("results", F.col("_code")))
        words = S.terms(F.col("_piece"), result["tps"], folded=False)
        none = F.array(F.struct(F.lit(EMPTY).alias("term"), F.lit(0.0).alias("prob")))
        item = F.struct(F.col("_row").alias("row"), F.col("_piece").alias("text"), result["lang"].alias("lang"), F.when(F.size(words) > 0, words).otherwise(none).alias("tps"))
        items = done.select(F.col(id_col).alias("_id"), item.alias("item")).groupBy("_id").agg(F.sort_array(F.collect_list("item")).alias("_items"))
        # Texts meet their pieces at the end, so that they aren't sent along with each.
        heads = plain.groupBy(id_col).agg(*first)
        grouped = heads.join(items, F.col(id_col).eqNullSafe(F.col("_id")), "left").withColumn("_items", F.coalesce("_items", F.array().cast(_ITEMS)))
    ttps = F.transform("_items", lambda x: F.struct(x["text"].alias("text"), x["lang"].alias("lang"), x["tps"].alias("tps")))
    err = F.when(F.size("_items") == 0, F.lit("text is blank"))
    response = F.struct(F.struct(F.col("_text").alias("text"), F.col("_lang").alias("lang")).alias("ip"), F.when(err.isNull(), ttps).alias("ttps"), err.alias("err"))
    return grouped.select(id_col, F.to_json(response).alias("response"))


def _answered(plain: DataFrame, lex: S.Lexicon, langs: list[str], id_col: str) -> DataFrame:
    """id, _text, _lang, _items of id, _text, _lang, _code, _pieces, row by row."""
    if not langs:
        raise ValueError("no language models")
    if missing := [x for x in langs if x not in lex.langs]:
        raise ValueError(f"language not found: {missing}")
    shared = plain.sparkSession.sparkContext.broadcast(lex)  # bounded by MAX_TERMS
    term = pa.struct([("term", pa.string()), ("prob", pa.float64())])
    kind = [("text", pa.string()), ("lang", pa.string()), ("tps", pa.list_(term))]

    def results(texts: list[str], code: str | None) -> pa.StructArray:
        """text, lang, tps of pieces in one language or the best."""
        folded = ["" if S.blank(t) else fold(t) for t in texts]
        got = S._results(folded, None, shared.value, langs if code is None else [code], "best", False)
        tps = got.field("tps")
        words = S._cut([t if f else "" for t, f in zip(texts, folded, strict=True)], 1, np.asarray(tps.values.field("len")).astype(np.int64))
        tps = pa.ListArray.from_arrays(tps.offsets, pa.StructArray.from_arrays([words, tps.values.field("prob")], ["term", "prob"]))
        if not all(folded):
            tps = pa.array([x or [{"term": EMPTY, "prob": 0.0}] for x in tps.to_pylist()], pa.list_(term))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), got.field("lang"), tps], [k for k, _ in kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                lists = b.column(4)
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten()
                codes = np.repeat(np.array(b.column(3).to_pylist(), object), size)
                place, parts, n = np.zeros(len(flat), np.int64), [pa.array([], pa.struct(kind))], 0
                for code in {*codes.tolist()}:
                    own = np.flatnonzero(codes == code)
                    once = flat.take(pa.array(own)).dictionary_encode()
                    texts = once.dictionary.to_pylist()
                    place[own] = np.asarray(once.indices) + n
                    n += len(texts)
                    parts += [results(texts[lo:hi], code) for lo, hi in S._slices(b, texts)]
                found = pa.concat_arrays(parts).take(pa.array(place))
                first = np.cumsum(size) - size
                row = pa.array(np.arange(len(flat)) - np.repeat(first, size), pa.int32())
                items = pa.StructArray.from_arrays([row, *found.flatten()], ["row", *(k for k, _ in kind)])
                offsets = pa.array(np.append(first, size.sum()), pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(offsets, items)], names=[*b.schema.names[:3], "_items"])

    return plain.mapInArrow(run, f"`{id_col}` {plain.schema[id_col].dataType.simpleString()}, _text string, _lang string, _items {_ITEMS}")


def _words(tps: Column) -> Column:
    return F.concat(F.lit("'"), F.array_join(F.transform(tps, lambda w: w["term"]), " "), F.lit("'"))


def line_view(result: Column) -> Column:
    """A result with terms: the words in quotes, joined by a space, and the language; EMPTY if there are none."""
    return F.when(F.size(result["tps"]) > 0, F.concat(_words(result["tps"]), F.lit(" ("), result["lang"], F.lit(")"))).otherwise(F.lit("EMPTY"))


def share_view(shared: Column) -> Column:
    """A line for each language by falling share (equal ones in their order): the language, percent with two decimals, the words."""
    order = F.sort_array(F.transform(shared, lambda r: F.struct((-r["share"]).alias("s"), r["lang_idx"].alias("i"), r["lang"].alias("lang"), r["tps"].alias("tps"))))
    line = lambda r: F.concat(F.lit("("), r["lang"], F.lit(")  "), F.format_number(-r["s"] * 100, 2), F.lit("%  "), _words(r["tps"]))
    return F.when(F.size(shared) > 0, F.array_join(F.transform(order, line), "\n")).otherwise(F.lit("EMPTY"))


def result_view(result: Column, probs: bool = True) -> Column:
    """The language and the terms, each with its prefix probability if wanted: 'EN', ('IT': 0.01, 'IS': 2.0E-4)."""
    term = lambda w: F.concat(F.lit("'"), w["term"], F.lit("'"), *([F.lit(": "), w["prob"].cast("string")] if probs else []))
    return F.concat(F.lit("'"), result["lang"], F.lit("', ("), F.array_join(F.transform(result["tps"], term), ", "), F.lit(")"))
