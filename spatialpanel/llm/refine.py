"""Duplicates hidden by formatting: progressive partition refinement.

Records that state the same edge agree in every invariant of the writing. Keys
are applied from the cheapest to the costliest, each only inside the classes of
the one before that have several members: first length and histogram of the
letters and digits (labels and weight apart) with the weight as a number, then
the parsed edge. Histogram and weight make one level because each alone leaves
almost all records in classes of several; more levels go into LEVELS.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_group_facts
from ..session import discard, materialise

#: How a label is written once case is ignored (fixed patterns).
LABELS = {"src_zip": "src[^a-z0-9]*zip", "dst_zip": "dst[^a-z0-9]*zip", "weight": "weight"}
ZIP_LABEL = f"{LABELS['src_zip']}|{LABELS['dst_zip']}"
ANY_LABEL = "|".join(LABELS.values())
NUMBER = "([-+\\u2212]?(?:[0-9][0-9,]*(?:\\.[0-9]+)?|\\.[0-9]+)(?:e[-+]?[0-9]+)?)"


def invariants(record: Column) -> Column:
    """Cheap key: stripped length and histogram of letters and digits, without the labels and the weight's field.

    Case, blanks, punctuation, field order and every way to write the weight
    leave it unchanged, so equal edges have equal keys.
    """
    stripped = F.regexp_replace(F.lower(record), f"(?s)weight.*?(?={ZIP_LABEL}|$)|{ZIP_LABEL}|[^\\p{{L}}\\p{{N}}]+", "")
    return F.xxhash64(F.length(stripped), F.array_join(F.array_sort(F.split(stripped, "")), ""))


def _canonical(df: DataFrame, field: str, out: str) -> DataFrame:
    """Adds ``out``: a lower-case field's first number as canonical text, '' if blank, else its letters and digits.

    Thousands commas, a plus sign, exponents and zeros around the number are
    levelled. Numbers that 38 digits with 12 decimals cannot hold compare as
    doubles. Each step is a column of its own, so that it is computed once.
    """
    text = F.translate(F.regexp_extract(field, NUMBER, 1), "−,+", "-")
    steps = df.withColumn("_text", text).withColumn("_exact", F.col("_text").try_cast("decimal(38,12)")).withColumn("_double", F.col("_text").try_cast("double"))
    plain = F.regexp_replace(F.col("_exact").cast("string"), "\\.?0+$", "")
    steps = steps.withColumn("_plain", F.when(F.col("_exact").cast("double") == F.col("_double"), plain).otherwise(F.col("_double").cast("string")))
    other = F.regexp_replace(field, "[^\\p{L}\\p{N}.-]+", "")
    return steps.withColumn(out, F.when(F.col("_plain").isin("-0", "-", ""), "0").otherwise(F.coalesce("_plain", other))).drop("_text", "_exact", "_double", "_plain")


def with_parsed_edge(df: DataFrame) -> DataFrame:
    """Adds src_zip, dst_zip and weight of a labelled edge line ``record``, in any layout and order.

    A field's text runs from its label to the next label or the end. Zips keep
    their letters and digits in lower case; weight becomes canonical number text
    ('' if blank; text that is no number stays as its letters and digits). All
    three are NULL unless the line has each label exactly once.

    One pattern cuts the line at its labels; each step is a column of its own,
    so that the optimizer does not repeat it where it is used.
    """
    cut = "\x01"
    line = f"(?s)^.*?({ANY_LABEL})(.*?)({ANY_LABEL})(.*?)({ANY_LABEL})(.*)$"
    marked = F.regexp_replace(F.translate(F.lower("record"), cut, " "), line, cut.join(f"${i}" for i in range(1, 7)))
    out = df.withColumn("_parts", F.split(marked, cut))
    part = lambda i: F.get("_parts", F.lit(i))
    for name in LABELS:
        text = F.lit(None).cast("string")
        for i in (4, 2, 0):
            text = F.when(F.startswith(part(i), F.lit(name[0])), part(i + 1)).otherwise(text)
        out = out.withColumn(f"_{name}", F.when(F.size("_parts") == 6, text))
    once = F.col("_src_zip").isNotNull() & F.col("_dst_zip").isNotNull() & F.col("_weight").isNotNull() & ~F.rlike(part(5), F.lit(ANY_LABEL))
    out = _canonical(out.withColumn("_known", F.coalesce(once, F.lit(False))), "_weight", "_number")
    only = lambda c: F.when(F.col("_known"), c)
    bare = lambda c: F.regexp_replace(c, "[^\\p{L}\\p{N}]+", "")
    out = out.withColumns({"src_zip": only(bare("_src_zip")), "dst_zip": only(bare("_dst_zip")), "weight": only(F.col("_number"))})
    return out.select(*df.columns, "src_zip", "dst_zip", "weight")


def _by_writing(rows: DataFrame) -> DataFrame:
    field = F.regexp_extract(F.lower("record"), f"(?s)weight(.*?)(?:{ZIP_LABEL}|$)", 1)
    return _canonical(rows.withColumn("_field", field), "_field", "_w").withColumn("_k", F.xxhash64(invariants(F.col("record")), "_w")).drop("_field", "_w")


#: The keys before the edge itself, cheapest first, each added to the one before in ``_k``; equal edges agree in each.
LEVELS: tuple[Callable[[DataFrame], DataFrame], ...] = (_by_writing,)


def _keyed(df: DataFrame) -> DataFrame:
    """(record_id, key): the edge as one text, or '!' with the class and the letters and digits of an unlabelled line."""
    letters = F.concat_ws("|", F.lit("!"), F.col("_k").cast("string"), F.regexp_replace(F.lower("record"), "[^\\p{L}\\p{N}]+", ""))
    edge = F.concat_ws("|", *LABELS)
    return with_parsed_edge(df.select("record_id", "record", "_k")).select("record_id", F.when(F.col("weight").isNotNull(), edge).otherwise(letters).alias("key"))


def _refine(records: DataFrame, alone_too: bool) -> tuple[DataFrame, DataFrame | None]:
    """(parsed members of the classes with several members at every level, likewise those alone in theirs)."""
    rows = records.filter(F.col("record_id").isNotNull() & F.col("record").isNotNull()).select("record_id", "record")
    alone, before = [], None
    for level in LEVELS:
        rows = materialise(level(rows), "records")
        discard(before)
        before = rows
        sizes = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), *([F.min(F.struct("record_id", "record")).alias("_one")] if alone_too else []))
        if alone_too:
            alone.append(materialise(_keyed(sizes.filter("_n = 1").select("_one.*", "_k")), "alone"))
        rows = join_group_facts(rows, sizes.filter("_n > 1").select("_k", "_n"), "_k", "_n", rows.count()).drop("_n")
    members = materialise(_keyed(rows), "members")
    discard(before)
    return members, reduce(DataFrame.unionByName, alone) if alone_too else None


def _sets(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.min("record_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def duplicate_pairs(records: DataFrame) -> DataFrame:
    """(keep_id, record_id): every further record of an edge with the edge's smallest record_id.

    ``records`` is (record_id, record, ...) with unique ids. Rows with a NULL id
    or record are left out; lines that have not each label once state no edge and
    match nothing here. Further columns are ignored. A set holding any share of
    the rows is handled: sets are found by partially aggregated keys and joined
    back with the hot ones broadcast (at most 1000).
    """
    members, _ = _refine(records, alone_too=False)
    joined = join_group_facts(members, _sets(members).filter("n > 1 AND NOT startswith(key, '!')"), "key", "n", members.count())
    return joined.filter("record_id <> keep_id").select("keep_id", "record_id")


def collapsed_records(records: DataFrame) -> DataFrame:
    """(keep_id, src_zip, dst_zip, weight, n_copies): one row per distinct record.

    weight is canonical number text, '' if blank. A line that states no edge is
    collapsed with those of equal letters and digits that write labels alike,
    and has NULL fields.
    """
    members, alone = _refine(records, alone_too=True)
    one = alone.select("key", F.col("record_id").alias("keep_id"), F.lit(1).cast("bigint").alias("n")).unionByName(_sets(members))
    part = F.split("key", "\\|")
    known = ~F.startswith("key", F.lit("!"))
    return one.select("keep_id", *[F.when(known, F.get(part, F.lit(i))).alias(n) for i, n in enumerate(LABELS)], F.col("n").alias("n_copies"))
