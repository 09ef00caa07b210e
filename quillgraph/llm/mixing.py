"""Mixing sources to target weights, with DataFrame functions alone.

Sources get targets by weight, none above ``MAX_REPEATS`` times its words.
Sainte-Laguë then hands out blocks of equal words by highest quotient
``target / (2 k + 1)``: first among the sources, then among the groups of a
source, then among the shards of a group.  In a shard, documents stand in a
seeded order and a seeded run of blocks, as long as the shard's quota, is
taken; whole rounds repeat the shard.  Shards of short texts have more
documents, so that they hold many blocks; one that still holds few (its texts
differ much in size) is counted in words instead of blocks, and what a full
shard can't take goes to the others of its source.

The highest quotients are found without listing a block: seats that a party is
sure of follow from its share, and only the few seats about its share compete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import WORD, read_table, written

MAX_REPEATS = 3
#: Blocks that the smallest source is cut into, if its words allow.
LEAST_BLOCKS = 512
#: Words of a block at most.
BLOCK_WORDS = 2048
#: Documents of a shard, blocks that a shard holds at least, and shards of a group, about.
SHARD_DOCS = 256
SHARD_BLOCKS = 32
GROUP_SHARDS = 1024


def _hash(seed: int, *columns: Column) -> Column:
    """The first 8 hex digits of an md5 as a number: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *columns)), 1, 8), 16, 10).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """Add ``weight`` and ``target`` to rows of (source, source_size).

    Weights 1, 2, 3 repeat over sources by code point, null last.  Targets
    share all words by weight; what exceeds a source's limit is shared anew
    among the others.  The level at which that ends is where the sources,
    ordered by limit per weight, stop being limited (further on it only falls).  One row per source: the
    windows hold as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("limit", F.col("source_size") * MAX_REPEATS)
    ratio = F.col("limit") / F.col("weight")
    low_first = Window.orderBy(ratio, F.col("source").isNull(), "source")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    limited = F.coalesce(F.sum("limit").over(low_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lighter = F.coalesce(F.sum("weight").over(low_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("level", (F.col("total") - limited) / (F.col("weights") - lighter)).withColumn("is_free", ratio >= F.col("level"))
    s = s.withColumn("level", F.max(F.when(F.col("is_free"), F.col("level"))).over(every))
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0)))
    return s.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "source_size", "weight", "target", "total")


def sainte_lague(parties: DataFrame, keys: list[str], seats: str, size: str, order: list[str]) -> DataFrame:
    """Add ``quota``: how many of ``seats`` (equal within ``keys``) each party gets by the highest quotients size / (2 k + 1).

    Ties go by ``order``; a party of size 0 gets none.
    """
    group = Window.partitionBy(*keys)
    p = parties.withColumn("share", F.when(F.sum(size).over(group) > 0, F.col(size) * F.col(seats) / F.sum(size).over(group)).otherwise(0.0)).withColumn("n_parties", F.count(F.lit(1)).over(group))
    # the divisor moves the share by at most share * parties / (2 seats), rounding by a half
    slack = F.when(F.col(seats) > 0, F.ceil(F.col("share") * F.col("n_parties") / (2 * F.col(seats)))).otherwise(0) + 2
    p = p.withColumn("sure", F.greatest(F.floor("share") - slack, F.lit(0)).cast("long")).withColumn("open", (F.ceil("share") + slack - F.col("sure")).cast("int"))
    p = p.withColumn("left", F.col(seats) - F.sum(F.when(F.col(size) > 0, F.col("sure")).otherwise(0)).over(group))
    names = [c for c in p.columns]
    q = p.withColumn("k", F.explode(F.when(F.col(size) > 0, F.sequence(F.lit(0), F.col("open"))).otherwise(F.array(F.lit(0)))))
    q = q.withColumn("quotient", F.col(size) / (2 * (F.col("sure") + F.col("k")) + 1))
    best = Window.partitionBy(*keys).orderBy(F.col("quotient").desc(), *order)
    q = q.withColumn("won", F.when((F.col(size) > 0) & (F.row_number().over(best) <= F.col("left")), 1).otherwise(0))
    kept = [c for c in parties.columns if c not in (*keys, *order)]
    q = q.groupBy(*keys, *order).agg(*[F.first(c).alias(c) for c in kept], (F.first(F.when(F.col(size) > 0, F.col("sure")).otherwise(0)) + F.sum("won")).cast("long").alias("quota"))
    return q.select(*parties.columns, "quota")


def _dealt_out(parts: DataFrame) -> DataFrame:
    """Cap each shard's quota at ``MAX_REPEATS`` rounds and share the words that this cuts off among the source's other shards, by their room.

    A shard that gets some is counted in words from then on.  The window holds
    a source's shards, not its documents.
    """
    source, upto = Window.partitionBy("src"), Window.partitionBy("src").orderBy("grp", "shard").rowsBetween(Window.unboundedPreceding, 0)
    most = F.col("shard_size") * MAX_REPEATS
    p = parts.withColumn("want", F.floor(F.col("quota") * F.col("shard_size") / F.col("blocks")))
    p = p.withColumn("room", F.greatest(most - F.col("want"), F.lit(0))).withColumn("room_to", F.sum("room").over(upto)).withColumn("room_all", F.sum("room").over(source))
    p = p.withColumn("cut", F.least(F.sum(F.greatest(F.col("want") - most, F.lit(0))).over(source), F.col("room_all")))
    upto_ = lambda room: F.floor(F.col("cut").cast("decimal(19,0)") * room / F.col("room_all"))
    p = p.withColumn("extra", F.when(F.col("cut") > 0, upto_(F.col("room_to")) - upto_(F.col("room_to") - F.col("room"))).otherwise(0).cast("long"))
    some = F.col("extra") > 0
    p = p.withColumn("quota", F.when(some, F.col("want") + F.col("extra")).otherwise(F.col("quota"))).withColumn("blocks", F.when(some, F.col("shard_size")).otherwise(F.col("blocks")))
    return p.withColumn("quota", F.least("quota", F.col("blocks") * MAX_REPEATS)).select(*parts.columns)


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, copies, lead, lead_start, tail`` for each row of ``docs``.

    ``taken`` counts the words the mix takes from a row, repeats included:
    ``copies`` whole rounds, plus the words [lead_start, lead_start + lead)
    and the first ``tail`` words.  Null texts count as empty, a null source is
    a source of its own, a null id is hashed as an empty string, equal rows
    keep their number; without any word all targets are 0; an empty table
    gives no rows.
    """
    d = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    d = written(d.withColumn("h", _hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")
    sources = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size"))).drop("weight")
    counts = d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    sources = sources.join(counts, sources.source.eqNullSafe(counts.source)).drop(counts.source)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.coalesce(least, F.lit(1)) / LEAST_BLOCKS))).cast("long")
    shards = F.greatest(F.lit(1), F.least(F.ceil(F.col("n_docs") / SHARD_DOCS), F.floor(F.col("source_size") / (block * SHARD_BLOCKS))))
    sources = sources.withColumns({"block": block, "n_shards": shards, "n_groups": F.ceil(shards / GROUP_SHARDS), "root": F.lit(0)})
    sources = sources.withColumn("seats", F.round(F.col("total") / F.col("block")).cast("long")).withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))
    sources = sainte_lague(sources, ["root"], "seats", "target", ["src"]).withColumnRenamed("quota", "source_quota")

    # Spark broadcasts the sources if their measured size allows, and splits a hot source otherwise
    d = d.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))
    d = d.join(sources.select("src", "source_size", "target", "n_docs", "block", "n_shards", "n_groups", "source_quota"), "src")
    d = d.withColumn("shard", F.col("h") % F.col("n_shards")).withColumn("grp", F.col("shard") % F.col("n_groups"))
    # else the windows below would keep the join's partitioning by source, with a hot source in one task
    # documents without a word take nothing and stand apart, as there may be any number of them to a shard
    d = d.withColumn("apart", F.when(F.col("size") == 0, F.col("h") % F.ceil(F.col("n_docs") / SHARD_DOCS) + 1).otherwise(0))
    d = d.repartition("src", "shard", "apart")
    parts = d.groupBy("src", "grp", "shard").agg(F.sum("size").alias("shard_size"), F.first("block").alias("block"), F.first("source_quota").alias("source_quota"))
    groups = parts.groupBy("src", "grp").agg(F.sum("shard_size").alias("grp_size"), F.first("source_quota").alias("source_quota"))
    groups = sainte_lague(groups, ["src"], "source_quota", "grp_size", ["grp"]).select("src", "grp", F.col("quota").alias("grp_quota"))
    parts = sainte_lague(parts.join(groups, ["src", "grp"]), ["src", "grp"], "grp_quota", "shard_size", ["shard"])
    few = F.col("shard_size") < F.col("block") * SHARD_BLOCKS
    parts = parts.withColumn("quota", F.when(few, F.col("quota") * F.col("block")).otherwise(F.col("quota")))
    parts = parts.withColumn("blocks", F.greatest(F.lit(1), F.when(few, F.col("shard_size")).otherwise(F.round(F.col("shard_size") / F.col("block")))).cast("long"))
    parts = _dealt_out(parts)
    start = _hash(seed, F.col("src"), F.col("shard").cast("string")) % F.col("blocks")
    run = F.col("quota") % F.col("blocks")
    edge = lambda block: F.floor(block * F.col("shard_size") / F.col("blocks"))
    parts = parts.select(
        "src",
        "shard",
        F.floor(F.col("quota") / F.col("blocks")).alias("copies"),
        edge(start).alias("from_"),
        edge(F.least(start + run, F.col("blocks"))).alias("to_"),
        edge(F.greatest(start + run - F.col("blocks"), F.lit(0))).alias("wrap"),
    )
    seeded = Window.partitionBy("src", "shard", "apart").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("end", F.sum("size").over(seeded)).join(parts, ["src", "shard"])
    a = F.col("end") - F.col("size")
    lead_from = F.greatest(a, F.col("from_"))
    lead = F.greatest(F.least(F.col("end"), F.col("to_")) - lead_from, F.lit(0))
    tail = F.greatest(F.least(F.col("end"), F.col("wrap")) - a, F.lit(0))
    return d.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size") + lead + tail).cast("long").alias("taken"),
        F.col("copies").cast("long").alias("copies"),
        lead.cast("long").alias("lead"),
        F.when(lead > 0, lead_from - a).otherwise(0).cast("long").alias("lead_start"),
        tail.cast("long").alias("tail"),
    )


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row for each whole round and one for each cut part, n_chars counted anew.

    A cut part holds the taken words with the white space between them.  A
    document without a word is in no block; it stays once, as it uses none of
    the budget.  The rows of a repeated doc_id are told apart by size, and
    those of equal size are given their parts in the order of their other
    columns.  A null id is an id as any other, a null source a source of its
    own, a null text has no word; an empty table gives no rows.
    """
    alike = Window.partitionBy("doc_id", "source", "size")
    parts = mix(docs.select("doc_id", "text", "source"), seed)
    n = docs.count()
    taken = written(parts.withColumn("alike", F.count(F.lit(1)).over(alike)).withColumn("number", F.row_number().over(alike.orderBy("copies", "lead", "lead_start", "tail"))), "mix-taken", 10 * n)
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    # a row's columns stand apart, as they may have any names
    d = docs.select(docs["doc_id"], docs["source"].cast("string").alias("source"), size.alias("size"), F.struct(*[docs[c] for c in docs.columns]).alias("row")).alias("d")
    # a row for each document: never broadcast, however small its file is when compressed; and texts needn't be sorted
    t = taken.where("alike = 1").hint("shuffle_hash").alias("t")
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.size") == F.col("t.size"))
    j = d.join(t, same).select("d.row", "t.size", "t.copies", "t.lead", "t.lead_start", "t.tail")
    # only rows that repeat are numbered, so that the other texts needn't be sorted
    u = taken.where("alike > 1").alias("t")
    order = [F.col("row").getField(c) for c in ("text", *docs.columns) if not isinstance(docs.schema[c].dataType, MapType)]
    repeated = d.join(u.where("number = 1"), same, "left_semi").withColumn("number", F.row_number().over(alike.orderBy(*order))).alias("d")
    j = j.unionByName(repeated.join(u, same & (F.col("d.number") == F.col("t.number"))).select("d.row", "t.size", "t.copies", "t.lead", "t.lead_start", "t.tail"))
    part = lambda start, n: F.struct(start.cast("int").alias("start"), n.cast("int").alias("n"))
    none = F.array().cast("array<struct<start:int,n:int>>")
    cut = F.concat(
        F.array_repeat(part(F.lit(0), F.col("size")), F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")),
        F.when(F.col("lead") > 0, F.array(part(F.col("lead_start"), F.col("lead")))).otherwise(none),
        F.when(F.col("tail") > 0, F.array(part(F.lit(0), F.col("tail")))).otherwise(none),
    )
    j = j.select("row", "size", F.explode(cut).alias("cut"))
    text = F.col("row").getField("text")
    words_ = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    part_ = F.regexp_replace(F.array_join(F.slice(words_, F.col("cut.start") + 1, F.col("cut.n")), ""), r"^[\x20\x09-\x0D]+", "")
    whole = F.col("cut.n") == F.col("size")
    j = j.withColumn("text", F.when(whole, text).otherwise(part_))
    value = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in value:
        value["n_chars"] = F.when(whole, value["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return j.select(*(value[c].alias(c) for c in docs.columns))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _sql_hash(*columns: str, seed: int = 7) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 1, 8) AS BIGINT)"


def _sql_sainte_lague(parties: str, keys: str, seats: str, size: str, order: str) -> str:
    """Highest quotients, with every seat of every party listed."""
    return f"""(SELECT {keys}, {order}, coalesce(sum(CASE WHEN place <= seats_ AND quotient > 0 THEN 1 ELSE 0 END), 0) AS quota FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY quotient DESC, {order}) AS place FROM (
        SELECT {keys}, {order}, {seats} AS seats_, {size} / (2 * k + 1) AS quotient
        FROM (SELECT *, unnest(range(CAST(least({seats}, ceil(1.2 * {size} * {seats} / nullif(sum({size}) OVER (PARTITION BY {keys}), 0)) + 50) + 1 AS BIGINT))) AS k FROM {parties})))
      GROUP BY {keys}, {order})"""


OP1_SQL = rf"""
WITH d0 AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    {_sql_hash("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h, coalesce('s' || source, 't') AS src FROM documents),
s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d0 GROUP BY src),
s1 AS (SELECT *, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS weight, source_size * {MAX_REPEATS} AS limit_ FROM s0),
s2 AS (
  SELECT *, sum(source_size) OVER () AS total, (sum(source_size) OVER () - coalesce(sum(limit_) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level_
  FROM s1 WINDOW w AS (ORDER BY limit_ / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(level_) FILTER (limit_ / weight >= level_) OVER () AS level1 FROM s2),
s4 AS (
  SELECT 0 AS root, src, source_size, n_docs, total, coalesce(least(CAST(limit_ AS DOUBLE), weight * coalesce(level1, 0)), 0) AS target,
    CAST(greatest(1, least({BLOCK_WORDS}, floor(coalesce(min(nullif(source_size, 0)) OVER (), 1) / {LEAST_BLOCKS}))) AS BIGINT) AS block_ FROM s3),
s4b AS (SELECT *, CAST(greatest(1, least(ceil(n_docs / {SHARD_DOCS}), floor(source_size / (block_ * {SHARD_BLOCKS})))) AS BIGINT) AS n_shards FROM s4),
s5 AS (SELECT *, CAST(round(total / block_) AS BIGINT) AS seats, CAST(ceil(n_shards / {GROUP_SHARDS}) AS BIGINT) AS n_groups FROM s4b),
s6 AS (SELECT s5.*, q.quota AS source_quota FROM s5 JOIN {_sql_sainte_lague("s5", "root", "seats", "target", "src")} q USING (src)),
d1 AS (SELECT d0.*, source_size, target, block_, source_quota, h % n_shards AS shard, (h % n_shards) % n_groups AS grp FROM d0 JOIN s6 USING (src)),
p0 AS (SELECT src, grp, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(block_) AS block_, any_value(source_quota) AS source_quota FROM d1 GROUP BY ALL),
g0 AS (SELECT src, grp, CAST(sum(shard_size) AS BIGINT) AS grp_size, any_value(source_quota) AS source_quota FROM p0 GROUP BY ALL),
g1 AS (SELECT src, grp, quota AS grp_quota FROM {_sql_sainte_lague("g0", "src", "source_quota", "grp_size", "grp")}),
p1 AS (SELECT p0.*, grp_quota FROM p0 JOIN g1 USING (src, grp)),
p2 AS (
  SELECT p1.*, CASE WHEN shard_size < block_ * {SHARD_BLOCKS} THEN q.quota * block_ ELSE q.quota END AS quota, CAST(greatest(1, CASE WHEN shard_size < block_ * {SHARD_BLOCKS} THEN shard_size ELSE round(shard_size / block_) END) AS BIGINT) AS blocks FROM p1 JOIN {_sql_sainte_lague("p1", "src, grp", "grp_quota", "shard_size", "shard")} q USING (src, grp, shard)),
o1 AS (SELECT *, CAST(floor(quota * shard_size / blocks) AS BIGINT) AS want, shard_size * {MAX_REPEATS} AS most FROM p2),
o2 AS (SELECT *, greatest(most - want, 0) AS room, sum(greatest(want - most, 0)) OVER (PARTITION BY src) AS over_ FROM o1),
o3 AS (SELECT *, sum(room) OVER (PARTITION BY src ORDER BY grp, shard) AS room_to, sum(room) OVER (PARTITION BY src) AS room_all FROM o2),
o4 AS (SELECT *, CASE WHEN least(over_, room_all) > 0 THEN CAST((least(over_, room_all)::HUGEINT * room_to) // room_all - (least(over_, room_all)::HUGEINT * (room_to - room)) // room_all AS BIGINT) ELSE 0 END AS extra FROM o3),
o5 AS (SELECT src, shard, shard_size, CASE WHEN extra > 0 THEN want + extra ELSE quota END AS quota, CASE WHEN extra > 0 THEN shard_size ELSE blocks END AS blocks FROM o4),
p3 AS (SELECT *, least(quota, blocks * {MAX_REPEATS}) AS quota1, {_sql_hash("src", "CAST(shard AS VARCHAR)")} % blocks AS start_ FROM o5),
p4 AS (
  SELECT src, shard, quota1 // blocks AS copies, floor(start_ * shard_size / blocks) AS from_, floor(least(start_ + quota1 % blocks, blocks) * shard_size / blocks) AS to_,
    floor(greatest(start_ + quota1 % blocks - blocks, 0) * shard_size / blocks) AS wrap_ FROM p3),
d2 AS (SELECT *, sum(size) OVER (PARTITION BY src, shard ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS end_ FROM d1)
SELECT doc_id, size, source_size, target,
  CAST(copies * size + greatest(least(end_, to_) - greatest(end_ - size, from_), 0) + greatest(least(end_, wrap_) - (end_ - size), 0) AS BIGINT) AS taken
FROM d2 JOIN p4 USING (src, shard)
"""
