"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source is a flow. Its documents queue in a shuffled order (by the MD5 of id, pass, text and copy), one pass after
another; a document's virtual finish time is the words of its source up to and with it, divided by the source's
target. All documents of all flows are sorted by virtual finish time, and the sorted mix is truncated at the total
budget. All flows progress at the same virtual speed and have served their targets at virtual time 1, which is where
the budget ends. A document in service at that time is queued in at most ``PACKETS`` parts, each with a finish time of
its own, so a source comes within a part and a word of its target however long its documents are.

No task gathers a source or the whole mix: the shuffle key and the virtual time are cut into ranges of about
``bucket_rows`` documents, sums of ranges are prefixed in small tables (in two steps, so that the one task that
sees all of it sees one row for a million documents), and windows run within a range. Sources are few: the table of
targets, a row for each, is one task's work.

Null text counts no words and takes none, a null source is a source of its own (last in order), null or repeated ids
are ordinary rows. Rows that repeat a document count as copies of it, with a place in the queue for each, so no key
gathers them. Ties in finish time go by source, then by place in its queue. Texts of any length are read whole. An
empty table gives an empty mix. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.llm.common import hashable, unused, written

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a document that is in service when the budget ends.
PACKETS = 1024


def n_words(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    rows: DataFrame, budget_ratio: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), passes: int = 2
) -> DataFrame:
    """(source, source_size, n_rows, flow, target): budget shared by weight, no target above passes x size.

    Water-filling in closed form: sources sorted by cap / weight; the first one whose ratio reaches the level
    that the rest of the budget gives to it and all later ones ends the capped sources.
    """
    src = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    src = src.withColumn("flow", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    src = src.withColumn("weight", F.element_at(cycle, ((F.col("flow") - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * passes).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy(F.lit(0))
    upto = Window.orderBy("ratio", "flow").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    src = (
        src.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(budget_ratio)))
        .withColumn("cap_before", F.sum("cap").over(upto) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("level", F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "flow"))).over(whole))
    )
    target = F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("cap").cast("double")).otherwise(
        F.col("level") * F.col("weight")
    )
    return src.select("source", "source_size", "n_rows", "flow", target.alias("target"))


def _before(rows: DataFrame, bucket: str, words: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bucket, words_before): the words in all lower buckets (of the same ``by``)."""
    sums = rows.groupBy(*by, bucket).agg(F.sum(words).alias("w")).withColumn("wide", F.floor(F.col(bucket) / 1024))
    wide = sums.groupBy(*by, "wide").agg(F.sum("w").alias("all"))
    lower = Window.partitionBy(*by).orderBy("wide").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.select(*by, "wide", F.coalesce(F.sum("all").over(lower), F.lit(0)).alias("lower"))
    within = Window.partitionBy(*by, "wide").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("w", F.coalesce(F.sum("w").over(within), F.lit(0))).join(wide, [*by, "wide"])
    return sums.select(*by, bucket, (F.col("w") + F.col("lower")).alias("words_before"))


def _begin(rows: DataFrame, p: int, bucket_rows: int) -> DataFrame:
    """Adds begin_p: words of the flow that queue before the row in pass p."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "mark", "copy")]
    key = F.md5(F.concat(name[0], F.lit(f":{p}:"), name[1], F.lit(":"), name[2], F.when(F.col("more") != 0, F.concat(F.lit(":"), F.col("more"))).otherwise("")).cast("binary"))
    ranges = F.ceil(F.col("n_rows") / bucket_rows)
    rows = rows.withColumn("key", key).withColumn(
        "range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * ranges).cast("long")
    )
    within = Window.partitionBy("flow", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("words_before") + F.col("source_size") * (p - 1)
    rows = rows.join(_before(rows, "range", "size", ("flow",)), ["flow", "range"]).withColumn(f"begin_{p}", begin)
    return (rows.withColumn("row", F.col("key")) if p == 1 else rows).drop("key", "range", "words_before")


def queue(docs: DataFrame, weights: tuple[float, ...], budget_ratio: float, passes: int, bucket_rows: int, more: Column) -> DataFrame:
    """A row for each row of ``docs`` and pass: row (its name), doc_id, mark, more, n (rows that repeat it), size,
    source_size, target, flow, pass, begin, and the virtual times start and finish."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5("text").alias("mark"), more.alias("more"))
    rows = rows.groupBy("doc_id", "source", "size", "mark", "more").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows, "mix-rows").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    flows = written(source_targets(rows, budget_ratio, weights, passes), "mix-targets").withColumnRenamed("source", "src")
    rows = rows.join(flows, F.col("source").eqNullSafe(F.col("src"))).drop("src", "source")
    for p in range(1, passes + 1):
        rows = _begin(rows, p, bucket_rows)
    turns = F.array(*[F.struct(F.lit(p).alias("pass"), F.col(f"begin_{p}").alias("begin")) for p in range(1, passes + 1)])
    rows = rows.select("row", "doc_id", "mark", "more", "n", "size", "source_size", "target", "flow", F.explode(turns).alias("turn"))
    target = F.nullif(F.col("target"), F.lit(0.0))
    time = lambda words: F.coalesce(words / target, F.lit(0.0))
    rows = rows.withColumn("pass", F.col("turn.pass")).withColumn("begin", F.col("turn.begin")).drop("turn")
    return rows.withColumn("start", time(F.col("begin"))).withColumn("finish", time(F.col("begin") + F.col("size")))


def served(turns: DataFrame, n_rows: int, budget: int, bucket_rows: int) -> DataFrame:
    """The turns of documents with words, each (or each part of it) with the words that the mix takes: ``words``.

    The global order is cut into ranges of virtual time, in which about equally many words finish.
    """
    parts = F.when((F.col("start") < 1) & (F.col("finish") > 1), F.least("size", F.lit(PACKETS).cast("long"))).otherwise(F.lit(1).cast("long"))
    rows = turns.where("size > 0 and target > 0").withColumn("parts", parts)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))))
    rows = rows.withColumn("to", F.expr("size * part div parts")).withColumn("words", F.expr("to - size * (part - 1) div parts"))
    rows = rows.withColumn("end", F.col("begin") + F.col("to")).withColumn("vfinish", F.col("end") / F.col("target"))
    rows = rows.withColumn("range", F.floor(F.col("vfinish") * max(1, -(-n_rows // bucket_rows))))
    within = Window.partitionBy("range").orderBy("vfinish", "flow", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(within), F.lit(0)) + F.col("words_before")
    rows = rows.join(_before(rows, "range", "words"), "range")
    return rows.withColumn("words", F.greatest(F.lit(0).cast("long"), F.least("words", F.lit(budget).cast("long") - before))).drop("range", "words_before")


def _mix(docs: DataFrame, budget_ratio: float, weights: tuple[float, ...], passes: int, bucket_rows: int, more: Column) -> tuple[DataFrame, DataFrame]:
    """(turns, served): ``served`` has a row for each part of a turn with words."""
    turns = written(queue(docs, weights, budget_ratio, passes, bucket_rows, more), "mix-turns")
    n, words = turns.where("pass = 1").agg(F.count(F.lit(1)), F.sum("size")).first()
    return turns, served(turns, n * passes, math.floor((words or 0) * budget_ratio), bucket_rows)


def mixed(docs: DataFrame, budget_ratio: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), passes: int = 2, bucket_rows: int = 1000) -> DataFrame:
    """The mix itself: the documents' rows as often as it takes them, range-sorted by virtual finish time.

    Documents that the mix cuts stay when at least half of their words are taken; documents without words stay once
    if their turn comes before virtual time 1. Texts stay out of the queues and join the turns once.
    """
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    more = F.xxhash64(*hashable(docs, *others)) if others else F.lit(0).cast("long")
    turns, parts = _mix(docs, budget_ratio, weights, passes, bucket_rows, more)
    whole = parts.groupBy("row", "pass", "doc_id", "mark", "more", "n", "size", "finish").agg(F.sum("words").alias("words")).where("2 * words >= size")
    empty = turns.where("size = 0 and pass = 1 and finish <= 1")
    names = {c: unused(f"mix_{c}", docs) for c in ("doc_id", "mark", "more", "n", "finish")}
    taken = whole.select(*names).union(empty.select(*names)).toDF(*names.values())
    i, mark, other, n, finish = names.values()
    same = docs["doc_id"].eqNullSafe(F.col(i)) & F.md5(docs["text"]).eqNullSafe(F.col(mark)) & (more == F.col(other))
    rows = docs.join(taken.where(F.col(n) == 1), same)
    repeats = turns.where("pass = 1 and n > 1").select(*list(names)[:3]).distinct().toDF(i, mark, other)
    if not repeats.isEmpty():  # one of the rows that repeat a document stands for each of its turns
        one = docs.join(repeats, same).dropDuplicates([i, mark, other])
        again = taken.where(F.col(n) > 1)
        keys = [one[c].eqNullSafe(again[c]) for c in (i, mark, other)]
        rows = rows.select(*docs.columns, finish).union(one.join(again, keys[0] & keys[1] & keys[2]).select(*docs.columns, finish))
    count = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(count, finish, "doc_id").sortWithinPartitions(finish, "doc_id").select(*docs.columns)


def mix_table(docs: DataFrame, budget_ratio: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), passes: int = 2, bucket_rows: int = 1000) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the sorted and truncated mix takes of each row of ``docs``."""
    turns, parts = _mix(docs, budget_ratio, weights, passes, bucket_rows, F.lit(0).cast("long"))
    some = parts.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken")).drop("row")
    none = turns.where("pass = 1 and not (size > 0 and target > 0)")
    return some.union(none.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


#: The same mix in DuckDB's SQL.
MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(md5(text), '') || ':' || (row_number() OVER (PARTITION BY doc_id, source, text) - 1) AS mark
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS flow
  FROM rows GROUP BY source),
capped AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((flow - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM src),
levels AS (
  SELECT *, cap / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * 1.5
     - (sum(cap) OVER (ORDER BY cap / weight, flow ROWS UNBOUNDED PRECEDING) - cap)::DOUBLE)
    / (sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, flow ROWS UNBOUNDED PRECEDING) + weight) AS level
  FROM capped),
first AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio >= level),
targets AS (
  SELECT source, source_size, flow,
    CASE WHEN f.level IS NULL OR ratio < f.level THEN cap::DOUBLE ELSE f.level * weight END AS target
  FROM levels, first f),
queued AS (
  SELECT r.*, t.source_size, t.target, t.flow, p, (coalesce(sum(size) OVER (PARTITION BY t.flow, p
      ORDER BY md5(coalesce(r.doc_id::VARCHAR, '') || ':' || p || ':' || mark), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + t.source_size * (p - 1))::BIGINT AS b
  FROM (SELECT rows.*, unnest([1, 2]) AS p FROM rows) r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, unnest(range(1, (CASE WHEN b / target < 1 AND (b + size) / target > 1 THEN least(size, 1024) ELSE 1 END) + 1)) AS i,
    CASE WHEN b / target < 1 AND (b + size) / target > 1 THEN least(size, 1024) ELSE 1 END AS k
  FROM queued WHERE size > 0 AND target > 0),
parts AS (SELECT *, b + size * i // k AS e, size * i // k - size * (i - 1) // k AS w FROM cut),
served AS (
  SELECT doc_id, mark, flow, greatest(0, least(w, (SELECT floor(sum(size) * 1.5)::BIGINT FROM rows)
    - coalesce(sum(w) OVER (ORDER BY e / target, flow, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS w
  FROM parts),
sums AS (SELECT doc_id, mark, flow, sum(w)::BIGINT AS taken FROM served GROUP BY 1, 2, 3)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(s.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN sums s ON q.doc_id IS NOT DISTINCT FROM s.doc_id AND q.mark = s.mark AND q.flow = s.flow WHERE q.p = 1
"""
