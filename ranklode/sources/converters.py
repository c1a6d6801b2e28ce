"""Collections to entries: DOCNO and text fields, from lines of the formats they come in.

A converter is a projection of lines (column ``value``); what doesn't fit is dropped, as noted.
``text`` is lower-cased words, ``text_raw`` what the source says. Filters and judgements that a
source carries come as tables of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklode.functions import text as T
from ranklode.functions.parse import qa_record

#: Prefix of query ids that come from click logs, a fixed value.
CLICK_PREFIX = "orcas_"


def plain(c) -> Column:
    return F.array_join(T.tokens(c), " ")


def _fields(lines: DataFrame, n: int) -> DataFrame:
    """Column f of the lines that have n tab-separated parts."""
    return lines.select(F.split("value", "\t", -1).alias("f")).filter(F.size("f") == n)


def _entry(key: Column, fields: dict[str, Column], raw: Column, order: list[str]) -> list[Column]:
    both = F.trim(F.concat_ws(" ", *(plain(fields[k]) for k in order)))
    return [key.cast("string").alias("DOCNO"), *(plain(c).alias(k) for k, c in fields.items()), both.alias("text"), raw.alias("text_raw")]


def documents(lines: DataFrame, most: int | None = None) -> DataFrame:
    """'id url title body', lines cut to ``most`` characters on demand."""
    x = _fields(lines if most is None else lines.select(F.substring("value", 1, most).alias("value")), 4)
    url, title, body = (F.col("f")[k] for k in (1, 2, 3))
    return x.select(*_entry(F.col("f")[0], {"url": T.pretokenize_url(url), "title": title, "body": body}, F.concat_ws(" ", url, title, body), ["url", "title", "body"]))


def passages(lines: DataFrame) -> DataFrame:
    """'id text'."""
    return _fields(lines, 2).select(F.col("f")[0].alias("DOCNO"), plain(F.col("f")[1]).alias("text"), F.col("f")[1].alias("text_raw"))


def queries(lines: DataFrame, least_words: int = 0) -> DataFrame:
    """'id text'; queries of fewer words go."""
    return passages(lines).filter(F.size(T.words("text")) >= least_words).filter("text <> ''")


def clicks(lines: DataFrame, ignore: DataFrame | None = None, least_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """'query-id query doc-id url': the queries, one a query id, and a judgement of grade 1 for each
    click. Queries whose text is in ``ignore`` (text) go."""
    x = _fields(lines, 4).select(F.concat(F.lit(CLICK_PREFIX), F.col("f")[0]).alias("query_id"), plain(F.col("f")[1]).alias("text"), F.col("f")[1].alias("text_raw"), F.col("f")[2].alias("doc_id"))
    x = x.filter((F.col("text") != "") & (F.size(T.words("text")) >= least_words))
    if ignore is not None:
        x = x.join(ignore.select("text").distinct(), "text", "left_anti")
    one = x.groupBy(F.col("query_id").alias("DOCNO")).agg(F.min(F.struct("text", "text_raw")).alias("_t")).select("DOCNO", "_t.text", "_t.text_raw")
    return one, x.select("query_id", "doc_id", F.lit(1.0).alias("grade")).distinct()


def documents_v2(lines: DataFrame) -> DataFrame:
    """JSON objects of docid, url, title, headings, body."""
    x = lines.select(F.from_json("value", "docid string, url string, title string, headings string, body string").alias("j")).filter("j.docid is not null").select("j.*")
    return x.select(*_entry(F.col("docid"), {"url": T.pretokenize_url("url"), "headings": F.col("headings"), "title": F.col("title"), "body": F.col("body")}, F.concat_ws(" ", "url", "headings", "title", "body"), ["url", "headings", "title", "body"]))


def passages_v2(lines: DataFrame) -> DataFrame:
    """JSON objects of pid, passage, docid."""
    x = lines.select(F.from_json("value", "pid string, passage string, docid string").alias("j")).filter("j.pid is not null").select("j.*")
    return x.select(F.col("pid").alias("DOCNO"), plain("passage").alias("text"), F.col("passage").alias("text_raw"), F.col("docid").alias("parent"))


def encyclopedia_passages(lines: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """'id text title' below a head line; on demand only given ids (id)."""
    x = _fields(lines, 3).filter("f[0] <> 'id'").select(F.col("f")[0].alias("DOCNO"), F.col("f")[1].alias("body"), F.col("f")[2].alias("title"))
    if keep is not None:
        x = x.join(keep.select(F.col("id").alias("DOCNO")).distinct(), "DOCNO", "left_semi")
    return x.select("DOCNO", plain("title").alias("title"), F.concat_ws(" ", plain("title"), plain("body")).alias("text"), F.concat_ws(" ", "title", "body").alias("text_raw"))


def questions(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Question records (value): question entries, answer entries, and judgements of the answers,
    grade 1, the best one 2."""
    x = records.select(qa_record("value").alias("q"))
    ask = F.concat_ws(" ", "q.subject", "q.content")
    answers = x.select("q.uri", "q.best", F.posexplode("q.answers").alias("at", "answer"))
    key = F.concat_ws("-", "uri", "at")
    return (
        x.select(F.col("q.uri").alias("DOCNO"), plain(ask).alias("text"), F.trim(ask).alias("text_raw")),
        answers.select(key.alias("DOCNO"), plain("answer").alias("text"), F.col("answer").alias("text_raw")),
        answers.select(F.col("uri").alias("query_id"), key.alias("doc_id"), F.when(F.col("at") == F.col("best"), 2.0).otherwise(1.0).alias("grade")),
    )


def abstracts(records: DataFrame) -> DataFrame:
    """Rows id, title, author, source, body of an abstract collection."""
    names = ["title", "author", "source", "body"]
    return records.select(*_entry(F.col("id"), {k: F.col(k) for k in names}, F.concat_ws(" ", *names), names))
