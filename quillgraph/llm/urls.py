"""URL filtering by stated rules and by association rules.

Stated rules name a host and a path prefix.  Where none fits, mined rules
decide: single tokens and, by FP-growth over the blocked URLs, combinations of
tokens that labelled URLs have together with the label "block".  Those with
enough support and confidence that chance doesn't explain, and without a more
general rule, match URLs through an inverted index on their rarest token.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read_table, written

#: (host, path, verdict)
STATED_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Share of the labelled URLs, and number of them, that a rule blocks rightly at least.
MIN_SUPPORT = 0.002
MIN_PAGES = 5
MIN_CONFIDENCE = 0.5
#: Chance at most that any rule is mined where labels don't follow URLs.
CHANCE = 0.01
#: Items of a URL that combinations are made of, those that come with the label most: bounds the combinations of a long URL.
COMBINED = 12
#: Labelled URLs that are learned from at most, drawn by hash; of rules that are broadcast at most (some 50 MB).
LEARNED, FEW_RULES = 1_000_000, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, ASCII letters in lower case; empty for null or no ``://``."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; empty for null or no ``://``."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)), F.lit(""))


def stated_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = STATED_RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits host (or one of its parents) and path; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments and query keys, digits as ``#``."""
    host, path = host_of(url), path_of(url)
    plain = lambda c: F.regexp_replace(c, r"[0-9]+", "#")
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda kv: F.substring_index(kv, "=", 1))
    scheme = F.when(F.contains(url, F.lit("://")), F.array(F.substring_index(url, "://", 1))).otherwise(F.array(F.lit("")))
    found = F.concat(tagged("s:", scheme), tagged("h:", F.split(plain(host), r"\.")), tagged("p:", F.split(plain(path), "/")), tagged("q:", keys))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def _telling(n: Column, blocked: Column, least: int, base: float, tests: int, min_confidence: float) -> Column:
    """Whether ``blocked`` of ``n`` URLs are enough, many enough of them, and more than chance gives at the rate ``base`` in ``tests`` tests (Chernoff's bound)."""
    p = blocked / n
    apart = p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / max(1 - base, 1e-300))).otherwise(0.0)
    return (blocked >= least) & (p >= min_confidence) & (p > base) & (n * apart >= math.log(max(tests, 1) / CHANCE))


def _rarest(rules: DataFrame, key: str) -> DataFrame:
    """Add ``token`` to rows of (key, tokens): the token of each rule that fewest rules share, its only posting in the index."""
    t = rules.withColumn("token", F.explode("tokens"))
    per_token = t.groupBy("token").agg(F.count(F.lit(1)).alias("n_"))
    return rules.join(t.join(per_token, "token").groupBy(key).agg(F.min_by("token", F.struct("n_", "token")).alias("token")), key)


def _has(tokens: str, all_: str) -> Column:
    return F.size(F.array_except(tokens, all_)) == 0


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``tokens, confidence, support`` from rows of (url, blocked); of nested rules only the most general stays.

    A token that is telling by itself is a rule.  Of the others, those that
    the same blocked URLs have are one item, and FP-growth over the blocked
    URLs finds the combinations of items; their confidence is counted over all
    labelled URLs.  Null urls and null labels teach nothing; repeated rows
    count as often as they stand; of more than LEARNED rows a part is drawn by
    url.  An empty table gives no rule.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    rows = labelled.where("url is not null and blocked is not null").select(F.monotonically_increasing_id().alias("row"), F.col("blocked").cast("boolean").alias("blocked"), F.xxhash64("url").alias("h"), url_tokens(F.col("url")).alias("all"))
    share = min(1.0, LEARNED / max(1, labelled.count()))
    rows = written(rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))), "url-labelled")
    n_rows, n_blocked = rows.agg(F.count(F.lit(1)), F.count_if("blocked")).first()
    if not n_blocked:
        return none
    base, least = n_blocked / n_rows, max(MIN_PAGES, math.ceil(min_support * n_rows))
    t = rows.select("row", "blocked", "h", F.explode("all").alias("token"))
    # sums of hashes tell whether two tokens stand in the same blocked urls
    same = [F.sum(F.when(F.col("blocked"), F.pmod(F.xxhash64("h", F.lit(k)), F.lit(1 << 30)))).alias(f"s{k}") for k in (1, 2)]
    tokens = written(t.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("b"), *same).where(F.col("b") >= least), "url-tokens")
    n_tokens = tokens.count()
    telling = _telling(F.col("n"), F.col("b"), least, base, n_tokens, min_confidence)
    rule = lambda df: df.select("tokens", (F.col("b") / F.col("n")).alias("confidence"), (F.col("b") / n_rows).alias("support"))
    single = rule(tokens.where(telling).withColumn("tokens", F.array("token")))

    item = F.min("token").over(Window.partitionBy("b", "s1", "s2"))
    items = written(tokens.where(~telling).withColumn("item", item), "url-items")
    found = t.where("blocked").join(items, "token").groupBy("row", "item").agg(F.max(F.col("b") / F.col("n")).alias("p"))
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("p"), "item"))
    baskets = found.withColumn("place", best).where(F.col("place") <= COMBINED).groupBy("row").agg(F.collect_list("item").alias("items"))
    baskets = written(baskets.select("items"), "url-baskets")
    if not (n_baskets := baskets.count()):
        return written(single, "url-rules")
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n_baskets)).fit(baskets).freqItemsets
    sets = sets.select(F.xxhash64(F.array_sort("items")).alias("set"), F.explode("items").alias("item")).join(items.select("item", "token"), "item")
    sets = written(sets.groupBy("set").agg(F.array_sort(F.collect_list("token")).alias("tokens")).where(F.size("tokens") > 1), "url-sets")
    n_sets, index = sets.count(), _rarest(sets, "set")
    hits = rows.select("blocked", "all", F.explode("all").alias("token")).join(F.broadcast(index) if n_sets <= FEW_RULES else index, "token").where(_has("tokens", "all"))
    counts = hits.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("b"))
    several = sets.join(counts, "set").where(_telling(F.col("n"), F.col("b"), least, base, n_tokens + n_sets, min_confidence))
    several = written(several, "url-several")
    inner = _rarest(several.select("set", "tokens"), "set").select(F.col("tokens").alias("inner"), "token")
    covered = several.select("set", F.col("tokens").alias("all"), F.explode("tokens").alias("token")).join(inner, "token").where((F.size("inner") < F.size("all")) & _has("inner", "all")).select("set").distinct()
    rules = written(single.unionByName(rule(several.join(covered, "set", "left_anti"))), "url-rules")
    discard(rows, tokens, items, baskets, sets, several)
    return rules


def blocked_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that a mined rule matches, with the best rule's confidence.

    The index has one posting for each rule, under the token that fewest rules
    share; a url looks its tokens up and the posting's other tokens are checked
    on the spot, so a url meets few rules and no list of urls is gathered.
    """
    index = _rarest(rules.withColumn("rule_key", F.array_join("tokens", " ")), "rule_key").select("tokens", "confidence", "token")
    found = urls.select("url", url_tokens(F.col("url")).alias("all")).withColumn("token", F.explode("all")).join(index, "token")
    return found.where(_has("tokens", "all")).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, confidence`` for every row of ``pages``.

    ``labelled`` has (url, blocked).  A null url, or one without ``://``, has
    empty host and path and no rule; without a mined match the verdict is
    allow.  Repeated rows are all returned; further columns are ignored; an
    empty table gives no rows.
    """
    p = pages.select(pages[id_col].alias(id_col), pages[url_col].cast("string").alias("url"))
    p = p.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = stated_rule(F.col("host"), F.col("path"))
    p = p.withColumn("rule", rule).withColumn("stated", verdict)
    mined = blocked_urls(p.where("rule is null and url is not null").select("url").distinct(), mine_rules(labelled))
    p = p.join(mined, "url", "left")
    return p.select(id_col, "host", "path", "rule", F.coalesce("stated", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages; rules are mined from the pages whose document has a quality label, 0 meaning block.

    Page i is taken for the page of document i, as pages have no other key to
    labels.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("blocked"))
    return judge(pages, pages.join(labels, "page_id"))
