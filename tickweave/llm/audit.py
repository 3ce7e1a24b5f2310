"""How filters of a corpus interact: what each removes in every order, alone, in vain and at what cost.

Which filters a document fails is a mask of one bit for each filter. All that any order of the filters does follows from how many
documents of a part have which mask, so the corpus is read once: native expressions make the masks, a grouping by text says which
documents repeat one with a smaller id, and an aggregate leaves at most 2^5 cells for each part. Orders are enumerated from the cells.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_defaults

#: Filters in the order of their bits.
FILTERS = "ABCDE"

_WORD = r"[^\x20\x09-\x0D]+"
_REPEAT = 1 << FILTERS.index("E")


def text_mask(text: Column, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> Column:
    """Bits A to D of a text without nulls: too few words, too few distinct ones, too many capitals, a mark of `#$%&*|`."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    n = F.size(words)
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))  # a byte each
    failed = (n < min_words, 100 * F.size(F.array_distinct(words)) < distinct_percent * n, 100 * capitals.cast("long") > capital_percent * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for each row of doc_id, text and source, repeated rows included.

    part is the source, empty where it is null; a null text is empty. A row fails E if an equal text has a smaller doc_id: rows of one
    id don't repeat each other, and a row without an id repeats nothing and is not repeated. Texts are told apart by their SHA-256.
    """
    docs = with_defaults(docs, doc_id="long", text="string", source="string")
    text = F.coalesce("text", F.lit(""))
    rows = materialize(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_mask(text).cast("int").alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "masks", hashes=True)
    # texts that only one id has need no join: their rows meet nothing
    # written first: a join of two bare scans is dealt anew where one text has many rows
    firsts = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "firsts", hashes=True)
    met = rows.join(firsts, "digest", "left")
    return met.select("doc_id", "part", F.when(F.col("doc_id") > F.col("first"), F.col("mask") + _REPEAT).otherwise(F.col("mask")).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, and how many of them any row of labels calls good or toxic."""
    labels = with_defaults(labels, doc_id="long", quality="int", toxic="int").where("quality = 1 or toxic = 1")
    marks = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # an id without labels, or none, is met by nothing: labelled rows are counted apart, so that no row without an id is dealt by it
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n")).select("*", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    marked = masks.join(marks, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).select("part", "mask", F.lit(0).cast("long").alias("n"), "good", "toxic")
    return counts.unionByName(marked).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _steps() -> Column:
    """Every step of every order as an array of structs: the order, the step, its filter's bit, the bits before it."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            steps.append(("".join(order), step, bit, before))
            before |= bit
    kinds = "array<struct<filter_order string, step int, bit int, before int>>"
    return F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{s},"bit":{b},"before":{k}}}' for o, s, b, k in steps) + "]"), kinds)


def order_effects(cells: DataFrame) -> DataFrame:
    """A row for each part, order and step, from at most 32 cells of a part; see interaction_report()."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = parts.withColumn("_at", F.explode(_steps()))
    bit, before = F.col("_at.bit"), F.col("_at.before")

    def total(what: str, holds) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(holds(c["mask"]), c[what]).otherwise(F.lit(0).cast("long")))

    fails = lambda m: m.bitwiseAND(bit) != 0
    reached = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & reached(m)
    # a document that fails k filters is removed by each of them in one k-th of all orders
    share = lambda c: (c["n"] * 120 / F.bit_count(c["mask"])).cast("long")
    return rows.select(
        "part",
        F.col("_at.filter_order").alias("filter_order"),
        F.col("_at.step").alias("step"),
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & ~reached(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(fails(c["mask"]), share(c)).otherwise(F.lit(0).cast("long"))).alias("shapley"),
    )


def interaction_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part.

    shapley is what the step's filter removes, summed over all orders. Nulls and repeated rows: see failure_masks(). Labels of ids
    that several rows of docs have count for each; repeated labels count once. Empty docs give no rows; other columns are ignored.
    """
    return order_effects(mask_cells(materialize(failure_masks(docs), "failures", hashes=True), labels))


def oracle() -> str:
    """DuckDB SQL for interaction_report() over the views documents and labels."""
    bit = lambda letter: f"(1 << (ascii({letter}) - 65))"
    return f"""with docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
  repeats as (select text, min(doc_id) as first from docs group by text),
  masks as (select d.doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
      + 4 * (100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text))::int + 8 * regexp_matches(d.text, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > first, false)::int as mask
    from docs d join repeats r on d.text = r.text),
  marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
  cells as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from masks left join marks using (doc_id) group by all),
  letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
  orders as (select a.x || b.x || c.x || d.x || e.x as o from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  steps as (select o, s.range as step, {bit("o[s.range]")} as bit, list_sum(list_transform(range(1, s.range), lambda i: {bit("o[i::int]")})) as before from orders, range(1, 6) s),
  effects as (select part, o as filter_order, step, bit,
      sum(case when mask & (coalesce(before, 0)::int | bit::int) = 0 then n else 0 end) as kept,
      sum(case when mask & bit::int <> 0 and mask & coalesce(before, 0)::int = 0 then n else 0 end) as removed,
      sum(case when mask & bit::int <> 0 and mask & coalesce(before, 0)::int <> 0 then n else 0 end) as redundant,
      sum(case when mask = bit then n else 0 end) as unique_fails,
      sum(case when mask & bit::int <> 0 and mask & coalesce(before, 0)::int = 0 then good else 0 end) as good_lost,
      sum(case when mask & bit::int <> 0 and mask & coalesce(before, 0)::int = 0 then toxic else 0 end) as toxic_lost
    from cells, steps group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from effects"""
