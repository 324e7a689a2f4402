"""Sharding by proportional stratified interleaving.

The rows of each source are ranked in a seeded shuffle. Row r of n gets the fraction
(r - u) / n, where u, between 0 and 1, is drawn by a hash for each source, so that sources of one
size do not step together. All rows are put in the order of their fractions, and the order is cut
into equal runs. Any run then holds of each source its share of the rows, to within
rounding, and the sizes of shards differ by one row at most (law ``rows``).

The shuffled order within a source is that of md5(seed, doc_id). A null source is a
source of its own, apart from the empty one. Null ids are one key, and rows that repeat an id are ordered by
size and checksum; rows alike in all of these may change places, which changes no result.
Null text has size 8 and the checksum of empty text. Empty input gives no rows.

All on DataFrame functions. Nothing of unbounded size meets in one task: ranks are
counted within slices of the shuffle key and added to the counts of the slices before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one slice, about; and the fewest slices.
SLICE_ROWS, LEAST_SLICES = 20_000, 256
SEED = "lodeframe"


def _ranked(rows: DataFrame, by: list[str], slice_: str, order: list, name: str) -> DataFrame:
    """``name``: the place of the row (from 1) within ``by``, and __n, the rows there; slices follow each other in that order."""
    before = Window.partitionBy(*by).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, slice_).agg(F.count(F.lit(1)).alias("__c"))
    offsets = counts.select(*by, slice_, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy(*by)).alias("__n"))
    within = F.row_number().over(Window.partitionBy(*by, slice_).orderBy(*order))
    return rows.withColumn("__within", within).join(offsets.hint("shuffle_merge"), [*by, slice_]).withColumn(name, F.col("__before") + F.col("__within")).drop("__before", "__within")


def _slice_of_key(slices: int) -> Column:
    return (F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * slices / F.lit(1 << 32)).cast("long")


def _start(seed: str) -> Column:
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "__source")), 1, 8), 16, 10).cast("double")
    return (drawn + 0.5) / F.lit(float(1 << 32))


def shard(docs: DataFrame, shards: int = 24, seed: str = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and source of every row."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    n = docs.count()
    slices = max(LEAST_SLICES, -(-n // slice_rows))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("__source"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("__key"),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    ).withColumn("__slice", _slice_of_key(slices))
    ranked = _ranked(rows, ["__source"], "__slice", ["__key", "doc_id", "size", "text_crc32"], "__rank").drop("__slice")
    rows = ranked.withColumn("__fraction", (F.col("__rank") - _start(seed)) / F.col("__n")).drop("__rank", "__n")
    rows = rows.withColumn("__slice", (F.col("__fraction") * slices).cast("long")).withColumn("__all", F.lit(0))
    placed = _ranked(rows, ["__all"], "__slice", ["__fraction", "__source", "__key", "doc_id", "size", "text_crc32"], "__place")
    at = F.col("__place") - 1
    number = F.expr(f"(__place - 1) * {shards} div __n")
    first = F.expr(f"(((__place - 1) * {shards} div __n) * __n + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        number.cast("int").alias("shard"),
        (at - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.expr("if(__source = '', null, substring(__source, 2))").alias("source"),
    )


ORACLE = f"""
with recursive table_(i, v, step) as (
  select i, i, 0 from range(256) t(i)
  union all
  select i, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, step + 1 from table_ where step < 8),
crc_table as (select list(v order by i) as c from table_ where step = 8),
bytes_ as (
  select distinct text, list_transform(range(1, octet_length(encode(text)) + 1), lambda i: ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::bigint) as b
  from documents where text is not null),
crcs as (
  select text, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, b), lambda h, x: xor(h // 256, c[xor(h % 256, x) + 1]))) as crc from bytes_, crc_table),
rows_ as (
  select doc_id, source, md5('{SEED}:' || coalesce(doc_id::varchar, '')) as k,
         octet_length(encode(coalesce(text, ''))) + 8 as size, coalesce(crc, 0)::bigint as text_crc32
  from documents left join crcs using (text)),
ranked as (
  select *, (('0x' || substr(md5('{SEED}:' || coalesce('=' || source, '')), 1, 8))::bigint::double + 0.5) / 4294967296::double as u, row_number() over (partition by source order by k, doc_id, size, text_crc32) as r, count(*) over (partition by source) as n from rows_),
placed as (
  select *, row_number() over (order by (r::double - u) / n::double, source, k, doc_id, size, text_crc32) - 1 as p, count(*) over () as total from ranked)
select doc_id, size::bigint as size, text_crc32, 'rows' as law, (p * 24 // total)::int as shard,
       (p - ((p * 24 // total) * total + 23) // 24)::bigint as slot, null::int as grown_shard, source
from placed
"""
