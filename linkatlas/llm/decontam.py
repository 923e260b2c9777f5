r"""Benchmark decontamination by typed templates.

Texts become tokens (maximal runs of letters and digits, lower-cased; points and commas between digits do not
part them); tokens that begin with a digit, capitalised words, wherever they stand, and units after a number
become the placeholders number, name and unit. Windows of ``WINDOW`` template tokens are hashed and joined
with the benchmark's, so that a question matches whatever its parameters. A window of placeholders alone says nothing
of the question and is hashed by its words. Aligned occurrences then have their slots compared: each
value of the benchmark's slots must always stand for one value in the document, changed or not. All of
it is DataFrame functions; windows travel as hashes, texts never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

WINDOW, SHARE, LONG, INCONSISTENT = 5, 0.5, 16, 0.2
#: Benchmark windows up to this many are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A capitalised word and what parts it from the one before; and a mark between two digits.
NAME, MARK = r"([^\p{L}\p{N}]|^)(\p{Lu}\p{Ll}+)", r"(\p{N})[.,](\p{N})"
#: Units of measure and currency that follow a number.
UNITS = "mm|cm|m|km|mg|g|kg|t|ml|l|s|ms|min|h|hours|minutes|seconds|days|weeks|months|years|inches|feet|miles|pounds|ounces|dollars|euros|percent|degrees|watts|volts|hz|mb|gb"


def plain(text: Column) -> Column:
    """The text's words with names marked by \x01, parted by single spaces."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), MARK, "$1$2"), NAME, "$1\u0001$2")
    return F.trim(F.regexp_replace(marked, "[^\\p{L}\\p{N}\u0001]+", " "))


def slotted(flat: Column) -> Column:
    """Lower case, with placeholders \\x02 for names and \\x03 for numbers."""
    named = F.when(flat.contains("\u0001"), F.regexp_replace(flat, "\u0001[^ ]+", "\u0002")).otherwise(flat)
    return F.regexp_replace(F.lower(named), r"(^| )\p{N}[^ ]*", "$1\u0003")


def template(numbered: Column) -> Column:
    """The same with \\x04 for units."""
    return F.when(numbered.contains("\u0003"), F.regexp_replace(numbered, f"\u0003 ({UNITS})( |$)", "\u0003 \u0004$2")).otherwise(numbered)


def windows(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, h, value) for every window; value has the window's words where the text has placeholders."""
    # Each step goes through a generator of one row, so that no step's pattern is evaluated again by a later one.
    once = lambda **cols: F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    flat = rows.select(key, once(flat=plain(F.col("text"))))
    t = flat.select(key, once(numbered=slotted(F.col("flat")), words=F.lower(F.translate("flat", "\u0001", ""))))
    t = t.select(key, "words", once(template=template(F.col("numbered"))))
    t = t.select(key, once(t=F.split("template", " "), w=F.when(F.col("template").rlike("[\u0002-\u0004]"), F.split("words", " "))))
    t = t.where(F.size("t") >= WINDOW)
    kinds = ("\u0002", "\u0003", "\u0004")

    def window(i: Column) -> Column:
        at = range(WINDOW)
        bare = F.col("w").isNotNull()
        for k in at:
            bare &= F.get("t", i + k).isin(*kinds)
        h = F.when(bare, F.xxhash64(F.lit("words"), *[F.get("w", i + k) for k in at])).otherwise(F.xxhash64(*[F.get("t", i + k) for k in at]))
        value = F.when(F.col("w").isNotNull(), F.array(*[F.when(F.get("t", i + k).isin(*kinds), F.get("w", i + k)) for k in at]))
        return F.struct(i.alias("pos"), h.alias("h"), value.alias("value"))

    return t.select(key, F.inline(F.transform(F.sequence(F.lit(0), F.size("t") - WINDOW), window)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds the item: matched, windows, share, slots, changed.

    Held means at least ``SHARE`` of the item's windows or ``LONG`` of them match, and at most
    ``INCONSISTENT`` of the aligned slots stand for two values at once, in any one alignment (a shift, or
    a cluster of shifts with gaps of up to ``WINDOW``, as insertions make) or over all of them. The
    counts that are returned are over all alignments. ``changed`` counts slots whose
    value differs from the benchmark's: above zero, the question was re-parameterised. Texts or items
    that are null or have fewer than five tokens never match. Rows that share an id count as one
    document (or item), null ids included; empty tables give no rows; other columns are ignored.
    """
    return leaks_by("doc_id", docs.select(F.col("doc_id").cast("long"), "text"), benchmark)


def leaks_by(key: str, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``leaks`` of ``docs`` (key, text), where rows that share a key, of any type, count as one document."""
    items = windows(benchmark.select(F.col("item_id").cast("long"), "text"), "item_id").select("item_id", F.col("pos").alias("ipos"), "h", F.col("value").alias("ivalue"))
    sizes = items.groupBy("item_id").agg(F.countDistinct("h").alias("windows")).withColumnRenamed("item_id", "of")
    items = items.join(sizes, F.col("item_id").eqNullSafe(F.col("of"))).drop("of")
    if items.count() <= BROADCAST_ROWS:
        items = F.broadcast(items)
    hits = windows(docs.select(key, "text"), key).join(items, "h")
    pair = [key, "item_id"]
    # Kept, since it is read several times. One row per pair and distinct window first, so that a repeated window is one row after pre-aggregation.
    slot = F.when(F.col("ivalue").isNotNull() & F.col("value").isNotNull(), F.filter(F.arrays_zip(F.col("ivalue").alias("i"), F.col("value").alias("d"), F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.col("ipos") + k).alias("at")), lambda x: x["i"].isNotNull()))
    aligned = kept(hits.select(*pair, "h", "windows", (F.col("pos") - F.col("ipos")).alias("shift"), slot.alias("slots")), "aligned")
    seen = aligned.groupBy(*pair, "h").agg(F.first("windows").alias("windows")).groupBy(*pair).agg(F.count("*").alias("matched"), F.first("windows").alias("windows"))
    values = aligned.where("slots is not null").select(*pair, "shift", F.explode("slots").alias("s")).select(*pair, "shift", "s.i", "s.d", "s.at").distinct()
    values = kept(values.groupBy(*pair, "shift", "i").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")), "values")
    sound = _sound(aligned, values, pair)
    values = values.groupBy(*pair).agg(
        F.sum("n").alias("slots"), F.sum(F.when(F.col("lo") != F.col("hi"), F.col("n")).otherwise(0)).alias("torn"),
        F.sum(F.when((F.col("lo") == F.col("hi")) & (F.col("lo") != F.col("i")), F.col("n")).otherwise(0)).alias("changed"),
    )
    same = lambda a, b: F.col(key).eqNullSafe(F.col(a)) & F.col("item_id").eqNullSafe(F.col(b))
    both = seen.join(values.withColumnsRenamed({key: "vd", "item_id": "vi"}), same("vd", "vi"), "left")
    none = F.lit(0).cast("long")
    both = both.select(*pair, "matched", "windows", (F.col("matched") / F.col("windows")).alias("share"), F.coalesce("slots", none).alias("slots"), F.coalesce("changed", none).alias("changed"), F.coalesce("torn", none).alias("torn"))
    both = both.join(sound, same("d", "i"), "left")
    held = ((F.col("share") >= SHARE) | (F.col("matched") >= LONG)) & ((F.col("torn") <= F.col("slots") * INCONSISTENT) | F.col("sound").isNotNull())
    return both.where(held).drop("torn", "d", "i", "sound")


def _sound(aligned: DataFrame, values: DataFrame, pair: list[str]) -> DataFrame:
    """The pairs (d, i) that one alignment holds by itself: a shift, or a cluster of neighbouring shifts."""
    key = pair[0]
    order = Window.partitionBy(*pair).orderBy("shift")
    gap = F.col("shift") - F.lag("shift").over(order)
    shifts = aligned.select(*pair, "shift").distinct().withColumn("new", F.when(gap <= WINDOW, 0).otherwise(1))
    shifts = shifts.select(*pair, "shift", F.sum("new").over(order).alias("cluster"))
    each = F.array(F.struct(F.lit(0).alias("kind"), F.col("shift").cast("long").alias("at")), F.struct(F.lit(1).alias("kind"), F.col("cluster").alias("at")))
    shifts = kept(shifts.select(F.col(key).alias("d0"), F.col("item_id").alias("i0"), F.col("shift").alias("s0"), F.explode(each).alias("alignment")), "alignments")
    own = F.col(key).eqNullSafe(F.col("d0")) & F.col("item_id").eqNullSafe(F.col("i0"))
    here = own & (F.col("shift") == F.col("s0"))
    by = [*pair, "alignment"]
    full = aligned.join(shifts, here).groupBy(*by, "h").agg(F.first("windows").alias("windows")).groupBy(*by).agg(F.count("*").alias("matched"), F.first("windows").alias("windows"))
    full = full.where((F.col("matched") >= SHARE * F.col("windows")) | (F.col("matched") >= LONG)).select(*by)
    torn = values.join(shifts, here).groupBy(*by).agg(F.sum("n").alias("slots"), F.sum(F.when(F.col("lo") != F.col("hi"), F.col("n")).otherwise(0)).alias("torn"))
    torn = torn.where(F.col("torn") > F.col("slots") * INCONSISTENT).select(F.col(key).alias("d0"), F.col("item_id").alias("i0"), F.col("alignment").alias("a0"))
    bad = own & (F.col("alignment") == F.col("a0"))
    return full.join(torn, bad, "left_anti").select(F.col(key).alias("d"), F.col("item_id").alias("i"), F.lit(True).alias("sound")).distinct()


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql_windows(table: str, key: str) -> str:
    flat = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(\p{N})[.,](\p{N})', '\1\2', 'g'), '([^\p{L}\p{N}]|^)(\p{Lu}\p{Ll}+)', '\1' || chr(1) || '\2', 'g'), '[^\p{L}\p{N}\x01]+', ' ', 'g'))"
    num = r"'(^| )\p{N}[^ ]*', '\1' || chr(3), 'g'"
    t = rf"regexp_replace(regexp_replace(lower(regexp_replace(flat, '\x01[^ ]+', chr(2), 'g')), {num}), {num})"
    t = rf"regexp_replace({t}, '\x03 ({UNITS})( |$)', chr(3) || ' ' || chr(4) || '\2', 'g')"
    kinds = "(chr(2), chr(3), chr(4))"
    bare = " and ".join(f"t[pos + {k}] in {kinds}" for k in range(1, WINDOW + 1))
    return f"""
    select {key}, pos, case when {bare} then ['words'] || list_slice(w, pos + 1, pos + {WINDOW}) else list_slice(t, pos + 1, pos + {WINDOW}) end as h,
      list_transform(range(1, {WINDOW + 1}), lambda k: case when t[pos + k] in {kinds} then w[pos + k] end) as value
    from (select {key}, t, w, unnest(range(0, len(t) - {WINDOW - 1})) as pos from (
      select {key}, string_split({t}, ' ') as t, string_split(lower(replace(flat, chr(1), '')), ' ') as w
      from (select {key}, {flat} as flat from {table})) where len(t) >= {WINDOW})"""


OP1_SQL = f"""
with d as ({_sql_windows("documents", "doc_id")}),
i as ({_sql_windows("benchmark", "item_id")}),
n as (select item_id, count(distinct h) as windows from i group by item_id),
hit as materialized (select d.doc_id, i.item_id, d.h, d.pos - i.pos as shift, i.pos as ipos, d.value as dv, i.value as iv from d join i using (h)),
seen as (select doc_id, item_id, count(distinct h) as matched from hit group by doc_id, item_id),
v as (select distinct doc_id, item_id, shift, ipos + k as at, iv[k] as i, dv[k] as dd from (select *, unnest(range(1, {WINDOW + 1})) as k from hit) where iv[k] is not null),
g as materialized (select doc_id, item_id, shift, i, min(dd) as lo, max(dd) as hi, count(*) as n from v group by all),
s as (select doc_id, item_id, cast(sum(n) as bigint) as slots, cast(sum(case when lo <> hi then n else 0 end) as bigint) as torn,
  cast(sum(case when lo = hi and lo <> i then n else 0 end) as bigint) as changed from g group by all),
ends as (select *, case when shift - lag(shift) over (partition by doc_id, item_id order by shift) <= {WINDOW} then 0 else 1 end as new from (select distinct doc_id, item_id, shift from hit)),
a as materialized (select doc_id, item_id, shift, 0 as kind, shift as place from ends
  union all select doc_id, item_id, shift, 1, sum(new) over (partition by doc_id, item_id order by shift) from ends),
f as (select doc_id, item_id, kind, place, count(distinct h) as matched from hit join a using (doc_id, item_id, shift) group by all),
t as (select doc_id, item_id, kind, place, sum(n) as slots, sum(case when lo <> hi then n else 0 end) as torn from g join a using (doc_id, item_id, shift) group by all),
sound as (select distinct f.doc_id, f.item_id from f join n using (item_id) left join t using (doc_id, item_id, kind, place)
  where (f.matched / n.windows >= {SHARE} or f.matched >= {LONG}) and coalesce(t.torn, 0) <= coalesce(t.slots, 0) * {INCONSISTENT})
select seen.doc_id, seen.item_id, matched, windows, matched / windows as share, coalesce(slots, 0) as slots, coalesce(changed, 0) as changed
from seen join n on n.item_id = seen.item_id left join s on s.doc_id = seen.doc_id and s.item_id = seen.item_id
left join sound on sound.doc_id = seen.doc_id and sound.item_id = seen.item_id
where (matched / windows >= {SHARE} or matched >= {LONG}) and (coalesce(torn, 0) <= coalesce(slots, 0) * {INCONSISTENT} or sound.doc_id is not null)
"""
