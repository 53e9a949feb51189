"""The text that goes to a model and what comes back: prompts by batch, answers as rows, fields fanned out and in again.

The model itself is a :mod:`gleaner.plans.scorer`; nothing here calls one. Prompts are bounded by the batch size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text


def batch_size(n: Column, size: int, threshold: int) -> Column:
    """The size of a batch: ``size``, times ``ceil(log2(n / threshold) + 1)`` for more rows than the threshold."""
    return F.when(n > threshold, size * F.ceil(F.log2(n / F.lit(threshold)) + 1)).otherwise(F.lit(size)).cast("int")


def batched(rows: DataFrame, group: str, key: str, size: int, threshold: int = 32) -> DataFrame:
    """``rows`` with their ``batch`` and ``place`` in it, batches counted within the group in order of the key."""
    per = Window.partitionBy(group)
    at = F.row_number().over(per.orderBy(key)) - 1
    rows = rows.withColumns({"_size": batch_size(F.count("*").over(per), size, threshold), "_at": at})
    return rows.withColumns({"batch": F.floor(F.col("_at") / F.col("_size")).cast("int"), "place": (F.col("_at") % F.col("_size")).cast("int")}).drop("_size", "_at")


def prompts(rows: DataFrame, group: str, head: str, line: Column) -> DataFrame:
    """``group, batch, prompt``: the head and one line a row, in order. A batch is bounded by its size, and so is what is gathered for it."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(group, "batch").agg(F.concat(F.lit(head + "\n"), joined).alias("prompt"))


def title_line(number: str = "number", title: str = "title") -> Column:
    return F.concat(F.col(number), F.lit(": "), text.clean_text(title))


def abstract_line(number: str = "number", title: str = "title", abstract: str = "abstract", limit: int = 4000) -> Column:
    """A paper's block: number, title and the first ``limit`` characters of the abstract, as the model is asked to read no more."""
    return F.concat(F.lit("ArXiv ID: "), F.col(number), F.lit("\nTitle: "), text.clean_text(title), F.lit("\nAbstract: "), F.substring(text.clean_text(abstract), 1, limit))


def split_by_answer(rows: DataFrame, answers: DataFrame, key: str, answer: str) -> tuple[DataFrame, DataFrame]:
    """Rows kept and rejected by answers that hold a list of rejected keys, in or without a fence; an answer that is no list rejects nothing."""
    body = F.regexp_extract(F.coalesce(F.col(answer), F.lit("")), r"(?s)(\[.*\])", 1)
    out = answers.select(F.explode(F.from_json(body, "array<string>")).alias(key)).distinct()
    return rows.join(out, key, "left_anti"), rows.join(out, key, "left_semi")


def scores_of(answers: DataFrame, answer: str) -> DataFrame:
    """``number, relevance, novelty, comment`` of answers with one JSON object a line; lines that do not parse are left out, the first of a number counts."""
    lines = answers.select(F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(answer), F.lit("")), r"```(?:json[l]?)?", ""), r"\n")).alias("pos", "line"))
    fixed = F.regexp_replace(F.trim("line"), r",\s*\}$", "}")
    row = F.from_json(fixed, "ARXIVID string, RELEVANCE string, NOVELTY string, COMMENT string")
    number = lambda c: F.regexp_extract(c, r"(-?\d+)", 1).try_cast("int")
    rows = lines.select("pos", row.alias("r")).filter("r.ARXIVID is not null").select(F.trim("r.ARXIVID").alias("number"), number(F.col("r.RELEVANCE")).alias("relevance"), number(F.col("r.NOVELTY")).alias("novelty"), text.clean_text(F.col("r.COMMENT")).alias("comment"), "pos")
    return rows.groupBy("number").agg(F.min_by(F.struct("relevance", "novelty", "comment"), "pos").alias("s")).select("number", "s.*")


def texts_of(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Every distinct non-blank text of the fields, by hash: what there is to translate, each once."""
    longs = rows.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("body")).filter("body is not null and trim(body) <> ''")
    return longs.select(F.sha2("body", 256).alias("hash"), "body").dropDuplicates(["hash"])


def translated(rows: DataFrame, fields: list[str], translations: DataFrame) -> DataFrame:
    """The fields with their translations (``hash, body``) laid over; a text without one, or with a blank one, stays as it is."""
    known = translations.filter("body is not null and trim(body) <> ''").select("hash", "body")
    for f in fields:
        t = known.select(F.col("hash").alias("_h"), F.col("body").alias("_b"))
        rows = rows.join(t, F.sha2(f, 256) == F.col("_h"), "left").withColumn(f, F.coalesce("_b", f)).drop("_h", "_b")
    return rows
