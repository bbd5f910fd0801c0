"""Terms of a text, block ranking and admission, ranges of positions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import ship

_CJK = r"[一-鿿]"


def terms(text: Column) -> Column:
    """Distinct terms: words of two or more letters, digits or underscores; of a Chinese run, itself and its pairs of characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"([a-z0-9_]{2,})"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(rf"({_CJK}+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(words, runs, pairs))


def overlap(a: Column, b: Column) -> Column:
    """Number of common terms."""
    return F.size(F.array_intersect(a, b))


def position_ranges(df: DataFrame, key: str, position: str, output: str = "ranges") -> DataFrame:
    """Runs of successive positions of each key as ``b000001..b000004``: gaps and islands."""
    w = Window.partitionBy(key).orderBy(position)
    marked = df.select(key, position).distinct().withColumn("__island", F.col(position) - F.row_number().over(w))
    runs = marked.groupBy(key, "__island").agg(F.min(position).alias("__a"), F.max(position).alias("__b"))
    text = F.format_string("b%06d..b%06d", "__a", "__b")
    return runs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__a", text.alias("t")))), lambda x: x["t"]).alias(output))


MAX_TERMS = 2000


def rank_blocks(blocks: DataFrame, questions: DataFrame, block_key: list[str], heading_weight: int = 1, min_matches: int = 1, excluded_kinds: tuple[str, ...] = ()) -> DataFrame:
    """Blocks by the terms they share with each question: question_id, the block key, score and rank.

    ``blocks`` has document_id, position, kind, headings and text; ``questions``
    question_id and text.  Both are exploded to terms and joined on them, so only
    blocks with a common term meet a question: no cross join.  Up to
    ``MAX_TERMS`` distinct terms of the questions are known before: then terms
    that no question has are dropped within the scan.
    """
    usable = blocks.where(~F.coalesce(F.col("kind").isin(list(excluded_kinds)), F.lit(False))) if excluded_kinds else blocks
    title = F.array_join("headings", " ")
    q = questions.select("question_id", F.explode(terms(F.col("text"))).alias("term"))
    asked = [r[0] for r in q.select("term").distinct().limit(MAX_TERMS + 1).collect()]
    held = F.array(*[F.lit(x) for x in sorted(asked)]).cast("array<string>") if len(asked) <= MAX_TERMS else None

    def wanted(text: Column) -> Column:
        return terms(text) if held is None else F.array_intersect(terms(text), held)

    b = usable.select(*block_key, F.explode(wanted(F.concat(title, F.lit(" "), F.coalesce("text", F.lit(""))))).alias("term"))
    scored = b.join(q, "term").groupBy("question_id", *block_key).agg(F.count(F.lit(1)).alias("score")).where(F.col("score") >= min_matches)
    if heading_weight > 1:
        h = usable.select(*block_key, F.explode(wanted(title)).alias("term"))
        extra = h.join(q, "term").groupBy("question_id", *block_key).agg(F.count(F.lit(1)).alias("extra"))
        scored = scored.join(extra, ["question_id", *block_key], "left").withColumn("score", F.col("score") + (heading_weight - 1) * F.coalesce("extra", F.lit(0))).drop("extra")
    w = Window.partitionBy("question_id", block_key[0]).orderBy(F.desc("score"), *block_key[1:])
    return scored.withColumn("rank", F.row_number().over(w))


def admit_blocks(ranked: DataFrame, cost: str, budget: int, document: str = "document_id", position: str = "position") -> DataFrame:
    """Whole blocks for each question within ``budget``: a fair share for every document first, then by strength.

    ``ranked`` holds question_id, the document, position, score, rank and a cost.
    The admission of one question looks at its candidates in sequence and holds
    a sum for each document.
    """
    ship(ranked.sparkSession)
    kept = ranked.select("question_id", document, position, "score", "rank", F.col(cost).cast("long").alias("cost"))
    schema = kept.withColumn("admitted", F.lit(True)).schema

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        strength: dict = {}
        for r in rows:
            strength[r[document]] = max(strength.get(r[document], 0), r["score"])
        docs = sorted(strength, key=lambda d: (-strength[d], str(d)))
        turn = {d: i for i, d in enumerate(docs)}
        share = budget // max(1, len(docs))
        order = sorted(rows, key=lambda r: (r["rank"], turn[r[document]]))
        spent = dict.fromkeys(docs, 0)
        total, chosen = 0, set()
        for fair in (True, False):
            for i, r in enumerate(order):
                room = min(budget - total, share - spent[r[document]]) if fair else budget - total
                if i not in chosen and r["cost"] <= room:
                    chosen.add(i)
                    total += r["cost"]
                    spent[r[document]] += r["cost"]
        out = [{**r, "admitted": i in chosen} for i, r in enumerate(order)]
        return pa.Table.from_pylist(out, schema=t.schema.append(pa.field("admitted", pa.bool_())))

    return kept.groupBy("question_id").applyInArrow(run, schema)


def section_blocks(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Blocks of the asked sections: from a heading to before the next heading of its level or above.

    ``sections`` has document_id and block_id of headings.
    """
    w = Window.partitionBy("document_id", "section_id").orderBy("position")
    heads = blocks.where("kind = 'heading'").join(sections.withColumnRenamed("block_id", "section_id"), "document_id")
    start = heads.where("block_id = section_id").select("document_id", "section_id", F.col("position").alias("__from"), F.col("heading_level").alias("__level"))
    after = heads.join(start, ["document_id", "section_id"]).where((F.col("position") > F.col("__from")) & (F.col("heading_level") <= F.col("__level")))
    end = after.groupBy("document_id", "section_id").agg(F.min("position").alias("__to"))
    span = start.join(end, ["document_id", "section_id"], "left")
    inside = blocks.join(span, "document_id").where((F.col("position") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("position") < F.col("__to"))))
    return inside.withColumn("section_index", F.row_number().over(w)).drop("__from", "__to", "__level")


def canonical_json(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """JSON text with keys in alphabetical order and explicit nulls."""
    return df.withColumn(name, F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def texts_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[str | None]]:
    for b in batches:
        yield b.column(column).to_pylist()
