"""URL filter: host and path rules first, a character language-model ratio for the rest. DataFrame functions only.

Two smoothed variable-order Markov models are counted over all URLs that a rule accepts or rejects. Symbols are letters,
one digit class, `/`, `.`, `-`, one class for the rest and a boundary: 32 in all, so a place with its three symbols of
context is a number below 2^20. The probability of a symbol interpolates contexts of 3, 2, 1 and 0 symbols
(Witten-Bell); a context that was never seen passes on to the shorter one. The log ratio for each of the 2^20 numbers
is one array of that fixed size. A URL's score is the mean log ratio of its places, and the cut is where normal curves
fitted to the scores of accepted and rejected URLs err equally often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_defaults

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Symbols 1 to 31; 0 is the boundary, `_` stands for anything else.
SYMBOLS = LOWER + "0/.-_"

ORDER, RADIX = 3, 32
SIZE = RADIX ** (ORDER + 1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a URL without `://`."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1))
    after = F.substring_index(after, "?", 1)
    slash = F.instr(after, "/")
    host = F.when(slash > 0, F.substr(after, F.lit(1), slash - 1)).otherwise(after)
    path = F.when(slash > 0, F.substr(after, slash)).otherwise("")
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(F.when(after.isNotNull(), path), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def places_of(urls: DataFrame) -> DataFrame:
    """A row for each place of `key`, the end included, with its number (gram): symbol and three before it, in base 32."""
    folded = F.regexp_replace(F.regexp_replace(F.translate("key", UPPER, LOWER), "[0-9]", "0"), r"[^a-z0/.\-]", "_")
    rows = urls.withColumn("text", F.concat(F.lit("^" * ORDER), folded, F.lit("^")))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("text") - ORDER)))
    gram = sum(F.instr(F.lit(SYMBOLS), F.substr("text", F.col("at") + k, F.lit(1))) * RADIX ** (ORDER - k) for k in range(ORDER + 1))
    return rows.select(*urls.columns, gram.alias("gram"))


def _model(counts: DataFrame) -> DataFrame:
    """(gram, a, b) counts of accepted and rejected -> (code, ratio) for each code below SIZE."""
    spark, below = counts.sparkSession, None
    for order in range(ORDER + 1):
        size = RADIX ** (order + 1)
        seen = counts.groupBy((F.col("gram") % size).alias("code")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = seen.groupBy(F.floor(F.col("code") / RADIX).alias("context")).agg(*[f(c).alias(f"{n}{c}") for c in ("a", "b") for n, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))])
        grid = spark.range(size).select(F.col("id").alias("code"), F.floor(F.col("id") / RADIX).alias("context"), (F.col("id") % (size // RADIX)).alias("suffix"))
        grid = grid.join(seen, "code", "left").join(context, "context", "left")
        grid = grid.join(below, "suffix") if below is not None else grid.withColumns({"pa": F.lit(1 / RADIX), "pb": F.lit(1 / RADIX)})
        mixed = lambda c: F.coalesce((F.coalesce(F.col(c), F.lit(0)) + F.col(f"t{c}") * F.col(f"p{c}")) / F.nullif(F.col(f"n{c}") + F.col(f"t{c}"), F.lit(0)), F.col(f"p{c}"))
        below = grid.select(F.col("code").alias("suffix"), mixed("a").alias("pa"), mixed("b").alias("pb"))
    return below.select(F.col("suffix").alias("code"), F.ln(F.col("pa") / F.col("pb")).alias("ratio"))


def _as_array(model: DataFrame) -> DataFrame:
    """One row: the ratios as 1024 arrays of 1024."""
    rows = model.groupBy(F.floor(F.col("code") / 1024).alias("row")).agg(F.array_sort(F.collect_list(F.struct("code", "ratio"))).alias("cells"))
    rows = rows.select("row", F.transform("cells", lambda x: x["ratio"]).alias("cells"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("table"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score per row of pages.

    score is the URL's mean log ratio (null counts as the empty URL); verdict is the rule's, else allow if the score is
    at least the cut. Where no rule accepts or none rejects any URL, the cut is 0. Repeated rows, null and repeated ids
    stay as they are; extra columns are ignored; empty input gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = with_defaults(pages, page_id="long", url="string").withColumns({"host": host, "path": path})
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled, "key": F.coalesce("url", F.lit(""))})

    urls = rows.groupBy("key", "ruled").agg(F.count("*").alias("n"))
    places = places_of(urls)
    of = lambda v: F.sum(F.when(F.col("ruled") == v, F.col("n")).otherwise(0))
    counts = materialize(places.where("ruled is not null").groupBy("gram").agg(of("allow").alias("a"), of("block").alias("b")), "grams")
    table = materialize(_as_array(_model(counts)), "ratios").scalar()
    ratio = F.element_at(F.element_at(table, (F.floor(F.col("gram") / 1024) + 1).cast("int")), (F.col("gram") % 1024 + 1).cast("int"))
    scored = materialize(places.withColumn("ratio", ratio).groupBy("key", "ruled").agg(F.first("n").alias("n"), F.avg("ratio").alias("score")), "scores")

    weighted = lambda v: [F.sum(F.when(F.col("ruled") == v, x)) for x in (F.col("n"), F.col("n") * F.col("score"), F.col("n") * F.col("score") ** 2)]
    sums = scored.agg(*[x.alias(f"{v}{i}") for v in ("allow", "block") for i, x in enumerate(weighted(v))])
    mean = {v: F.col(f"{v}1") / F.col(f"{v}0") for v in ("allow", "block")}
    spread = {v: F.sqrt(F.greatest(F.col(f"{v}2") / F.col(f"{v}0") - mean[v] ** 2, F.lit(1e-12))) for v in mean}
    cut = sums.select(F.coalesce((mean["allow"] * spread["block"] + mean["block"] * spread["allow"]) / (spread["allow"] + spread["block"]), F.lit(0.0)).alias("cut"))

    judged = rows.join(scored.select(F.col("key"), "score").dropDuplicates(["key"]), "key")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= cut.scalar(), "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))


def oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL for judge_urls() over the view pages."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h + p}'" for h, p, _ in ordered) + " end"
    ruled = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in ordered) + " end"
    levels = []
    for order in range(ORDER + 1):
        size = RADIX ** (order + 1)
        mixed = lambda c: f"coalesce((coalesce({c}, 0) + t{c} * p{c}) / nullif(n{c} + t{c}, 0), p{c})"
        below = f"join m{order - 1} using (suffix)" if order else f"cross join (select 1.0 / {RADIX} as pa, 1.0 / {RADIX} as pb)"
        levels.append(f"""
  s{order} as (select gram % {size} as code, sum(a) as a, sum(b) as b from counts group by 1),
  c{order} as (select code // {RADIX} as context, sum(a) as na, count_if(a > 0) as ta, sum(b) as nb, count_if(b > 0) as tb from s{order} group by 1),
  m{order} as (select code as suffix, {mixed("a")}::double as pa, {mixed("b")}::double as pb
    from (select range as code, range // {RADIX} as context, range % {size // RADIX} as suffix from range({size})) g
    left join s{order} using (code) left join c{order} using (context) {below})""")
    return f"""with parts as (
    select page_id, coalesce(url, '') as key, case when instr(url, '://') > 0 then split_part(split_part(substr(url, instr(url, '://') + 3), '#', 1), '?', 1) end as after from pages),
  hosts as (select page_id, key, coalesce(translate(case when instr(after, '/') > 0 then substr(after, 1, instr(after, '/') - 1) else after end, '{UPPER}', '{LOWER}'), '') as host,
    coalesce(case when instr(after, '/') > 0 then substr(after, instr(after, '/')) else '' end, '') as path from parts),
  ruled_rows as (select *, {rule} as rule, {ruled} as ruled from hosts),
  urls as (select key, ruled, count(*) as n from ruled_rows group by 1, 2),
  folded as (select key, ruled, n, regexp_replace(translate(key, '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g') as text from urls),
  coded as (select key, ruled, n, list_concat([0, 0, 0], list_transform(range(1, length(text) + 1), lambda i: case when instr('{SYMBOLS}', substr(text, i, 1)) > 0 then instr('{SYMBOLS}', substr(text, i, 1)) else 31 end), [0]) as x from folded),
  places as (select key, ruled, n, unnest(list_transform(range(1, len(x) - 2), lambda i: x[i] * 32768 + x[i + 1] * 1024 + x[i + 2] * 32 + x[i + 3])) as gram from coded),
  counts as (select gram, sum(case when ruled = 'allow' then n else 0 end) as a, sum(case when ruled = 'block' then n else 0 end) as b from places where ruled is not null group by 1),{",".join(levels)},
  scored as (select key, ruled, any_value(n) as n, avg(ln(pa / pb)) as score from places join m{ORDER} on gram = suffix group by 1, 2),
  sums as (select ruled, sum(n * score) / sum(n) as mean, sqrt(greatest(sum(n * score * score) / sum(n) - (sum(n * score) / sum(n)) ** 2, 1e-12)) as spread from scored where ruled is not null group by 1),
  cut as (select coalesce((select (x.mean * y.spread + y.mean * x.spread) / (x.spread + y.spread) from sums x, sums y where x.ruled = 'allow' and y.ruled = 'block'), 0) as cut)
select page_id, host, path, rule, coalesce(r.ruled, case when score >= (select cut from cut) then 'allow' else 'block' end) as verdict, round(score, 6) as score
from ruled_rows r join (select distinct key, score from scored) s using (key)"""
