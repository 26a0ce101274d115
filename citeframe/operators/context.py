"""Context paragraphs, context blocks and prompts for retrieved records."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..session import cut, part_of, store
from ..sources.catalog import shown, whole
from .joins import for_each_asker, lookup_join

if TYPE_CHECKING:
    from .retrieve import Retrieval

# Between two paragraphs of a context
SEPARATOR = "\n\n"


def paragraph() -> Column:
    """One record, labelled with its id, every figure verbatim."""
    return F.concat(
        F.lit("["), shown("record_id"), F.lit("] "), shown("name"), F.lit(" | "), shown("city"),
        F.lit(", "), shown("state"), F.lit(" | "), shown("type"),
        F.lit("\n  courses: "), F.coalesce(F.array_join("course_list", ", "), F.lit(v.MISSING)),
        F.lit("\n  annual_fees_inr: "), shown("fee"), F.lit(" (per year)"),
        F.lit("\n  last_year_cutoff_pct: "), whole("cutoff"),
        F.lit("\n  total_seats: "), shown("seats"),
        F.lit(" | hostel_available: "), F.initcap(shown("flag")),
        F.lit("\n  naac_grade: "), shown("grade"),
        F.lit(" | avg_placement_lpa: "), shown("placement"),
        F.lit("\n  established_year: "), shown("established"),
        F.lit("\n  about: "), shown("about"),
    )


def paragraphs(ranked: DataFrame, records: DataFrame, **shown: Column) -> DataFrame:
    """(uq, rn, text): a row per ranked record. An exhaustive question's context is read in this
    form: it is as long as its pool, so it is never put together in one row.

    ``shown``: what to give in place of the text, as expressions over ``text``; worked out once a record, however many
    questions show it, so that the text itself does not travel.
    """
    shown = shown or {"text": F.col("text")}
    texts = records.select("row_idx", paragraph().alias("text")).select("row_idx", *[c.alias(name) for name, c in shown.items()])
    return lookup_join(ranked.select("uq", "rn", "row_idx"), cut(texts), ["row_idx"], ["uq"]).select("uq", "rn", *shown)


def context_blocks(ranked: DataFrame, records: DataFrame) -> DataFrame:
    """(uq, n_records, context) of bounded questions: their k paragraphs in rank order, a blank line
    between them. Only texts of records that some question shows are written."""
    top = cut(ranked.select("uq", "rn", "row_idx"))
    some = lookup_join(records, part_of(top.select("row_idx").distinct(), top), ["row_idx"], ["row_idx"], "left_semi")
    return (
        paragraphs(top, some).groupBy("uq")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("_p"))
        .select("uq", F.size("_p").cast("long").alias("n_records"), F.array_join(F.col("_p.text"), SEPARATOR).alias("context"))
    )


def contexts_for(unique: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every question's block; the placeholder where nothing was retrieved."""
    return unique.select("uq").join(blocks, "uq", "left").select(
        "uq",
        F.coalesce("n_records", F.lit(0)).cast("long").alias("n_records"),
        F.coalesce("context", F.lit(v.EMPTY_CONTEXT)).alias("context"),
    )


def prompts(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, prompt) for each question that has a block."""
    filled = F.concat(
        F.lit(v.PROMPT_HEAD), F.col("context"), F.lit(v.PROMPT_QUESTION), F.coalesce("question", F.lit("")),
        F.lit(v.PROMPT_TAIL),
    )
    return lookup_join(questions, blocks, ["uq"], ["qid"]).select("qid", filled.alias("prompt"))


def _none() -> dict[str, Column]:
    """Columns of a part that is no range."""
    return {"pool": F.lit(None).cast("string"), "first": F.lit(None).cast("long"), "last": F.lit(None).cast("long")}


def _shown(df: DataFrame, shown: dict[str, Column]) -> DataFrame:
    """What is ``shown``, worked out from the column ``text``, in that column's place."""
    return df.select(*[c for c in df.columns if c != "text"], *[c.alias(name) for name, c in shown.items()])


def _bodies(run: Retrieval, k: int, **shown: Column) -> DataFrame:
    """(uid, part, kind, pool, first, last, n_chars, n) and what is ``shown``: the parts between head and question, which equal
    questions share; ``n`` is the number of records a part stands for. Texts are made and looked at once a record."""
    # a paragraph that leads, and one that follows another
    ways = [F.struct(F.lit(leads).alias("leads"), F.concat(F.lit(lead), "text").alias("text")) for leads, lead in ((True, ""), (False, SEPARATOR))]
    texts = run.records.select("row_idx", paragraph().alias("text")).select("row_idx", F.explode(F.array(*ways)).alias("w"))
    texts = cut(_shown(texts.select("row_idx", "w.*").withColumn("n_chars", F.length("text").cast("long")), shown))
    bounded = run.ranked_by_number(k).withColumn("rn", F.col("rn").cast("long"))
    rows = bounded.select("uid", "rn", "row_idx").unionByName(run.whole.scored.select("uid", F.col("rn").cast("long"), "row_idx"))
    rows = store(rows.withColumn("leads", F.col("rn") <= 1), "rows")
    records = lookup_join(rows, texts, ["row_idx", "leads"], ["uid"]).select(
        "uid", F.col("rn").alias("part"), F.lit("record").alias("kind"), "n_chars", *shown
    )
    records = records.withColumns({**_none(), "n": F.lit(1).cast("long")})
    size = F.col("last") - F.col("first") + 1
    gaps = len(SEPARATOR) * (size - F.when(F.col("rn") == 1, 1).otherwise(0))
    ranges = run.whole.ranges().select(
        "uid", F.col("rn").cast("long").alias("part"), F.lit("range").alias("kind"), F.lit(None).cast("string").alias("text"), "pool",
        "first", "last", (F.col("chars") + gaps).alias("n_chars"), size.alias("n"),
    )
    return records.unionByName(_shown(ranges, shown))


def _tail() -> Column:
    return F.concat(F.lit(v.PROMPT_QUESTION), F.coalesce("question", F.lit("")), F.lit(v.PROMPT_TAIL))


def prompt_parts(run: Retrieval, k: int, **shown: Column) -> DataFrame:
    """(qid, part, kind, pool, first, last, n_chars, text) for each question that has records, bounded or exhaustive; its
    prompt is its parts in order.

    Part 0 is the head; a part of kind ``record`` has the number of its record's rank; one of kind ``range`` stands for
    the places ``first`` to ``last`` of ``pool``, in order, and has the rank of the first of them; the question comes
    last. A paragraph that is not the first brings the blank line before it along. So a prompt is complete without
    being put together in one row, and pools that questions share are not written out for each.

    ``shown``: what to give in place of the text, as expressions over ``text``; worked out once a record, however many
    questions show it.
    """
    shown = shown or {"text": F.col("text")}
    body = store(_bodies(run, k, **shown), "parts")
    sizes = cut(body.groupBy("uid").agg(F.sum("n").alias("n")))
    asked = cut(lookup_join(run.askers(), sizes, ["uid"], ["qid"]))
    ends = F.explode(
        F.array(
            F.struct(F.lit(0).cast("long").alias("part"), F.lit("head").alias("kind"), F.lit(v.PROMPT_HEAD).alias("text")),
            F.struct(
                (F.col("n") + 1).alias("part"), F.lit("question").alias("kind"),
                _tail().alias("text"),
            ),
        )
    )
    frame = asked.select("qid", ends.alias("e")).select("qid", "e.*").withColumns({**_none(), "n_chars": F.length("text").cast("long")})
    shared = for_each_asker(body.drop("n"), asked, "uid", "qid", ["part"])
    columns = ("qid", "part", "kind", "pool", "first", "last", "n_chars", *shown)
    return _shown(frame, shown).select(*columns).unionByName(shared.select(*columns))


def prompt_sizes(run: Retrieval, k: int) -> DataFrame:
    """(qid, n_chars, n_records) of each question that has records: the length of its prompt, and how many records it shows.
    Parts are added up once for all equal questions, before the questions' own ends join."""
    sizes = cut(_bodies(run, k).groupBy("uid").agg(F.sum("n_chars").alias("body"), F.sum("n").alias("n")))
    asked = lookup_join(run.askers(), sizes, ["uid"], ["qid"])
    whole_length = F.lit(len(v.PROMPT_HEAD)) + F.col("body") + F.length(_tail())
    return asked.groupBy("qid").agg(F.sum(whole_length).alias("n_chars"), F.max("n").alias("n_records"))


def pool_texts(run: Retrieval) -> DataFrame:
    """(pool, place, text): what the ranges of ``prompt_parts`` stand for."""
    texts = cut(run.records.select("row_idx", paragraph().alias("text")))
    return lookup_join(run.whole.dictionary, texts, ["row_idx"], ["pool"]).select("pool", "place", "text")


def no_match_answers(negatives: DataFrame) -> DataFrame:
    """The fixed answer for questions whose constraints nothing meets."""
    return negatives.select(
        "qid",
        F.lit(v.NO_MATCH_ANSWER).alias("answer"),
        F.array().cast("array<string>").alias("citations"),
        F.lit(False).alias("answered"),
        F.lit(v.NO_MATCH_REASON).alias("reason_if_unanswered"),
    )
