"""URL filters by association rules.

Spark's FP-growth mines, in labelled URLs, which combinations of URL tokens go with the label block. Rules are kept by
support, confidence, and what they add to the share of blocked URLs: lift, and how far beyond chance it is. A URL is judged by an inverted index: each rule is filed under its rarest token, a URL's tokens
look up the rules filed under them, and a rule holds if the URL has all its tokens. Explicit rules for hosts and paths
come first. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch, packed, unpacked

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = "label=block"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: the labels of its host and their parts, the folders of the path, the ending of its last name,
    and the names of query parameters. Runs of digits are written as #, and what is nothing else is left out."""

    def marked(parts: Column, mark: str) -> Column:
        named = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "[0-9]+", "#")), lambda x: ~x.isin("", "#"))
        return F.transform(named, lambda x: F.concat(F.lit(mark), x))

    h, p = host(url), path(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_replace(x, "(?s)=.*", ""))
    hyphened = F.flatten(F.transform(F.filter(F.split(h, r"\."), lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    ending = F.regexp_extract(p, r"\.([A-Za-z0-9]{1,5})$", 1)
    folders = F.split(F.regexp_replace(F.lower(p), r"\.[a-z0-9]{1,5}$", ""), "/")
    return F.array_distinct(F.concat(marked(F.split(h, r"\."), "label="), marked(hyphened, "part="), marked(folders, "folder="), marked(F.array(F.lower(ending)), "ending="), marked(names, "query=")))


def mine(labelled: DataFrame, min_count: int = 8, min_confidence: float = 0.75, min_support: float = 0.0005, min_lift: float = 1.5, min_z: float = 4.0, rows: int = 50_000, seed: int = 3) -> DataFrame:
    """Rules (rule, confidence, lift, z, n_blocked, n_urls, token): antecedents of the label block, as sorted arrays of tokens, with their rarest token.

    labelled: url string, blocked boolean; at most `rows` of them are mined, those with the smallest hashes. A rule
    needs min_support of them, and min_count, as blocked URLs; min_confidence of those that it fits; min_lift times the
    share of blocked URLs; and z, the standard deviations by which it has more than that share, of min_z at least: so many
    combinations are tried that lower ones come by chance. Null URLs and labels don't count; repeated rows do.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "rule array<string>, confidence double, lift double, z double, n_blocked long, n_urls long, token string")
    fine = labelled.select("url", "blocked").where("url is not null and blocked is not null")
    fine = fine.orderBy(F.xxhash64("url", F.lit(seed)), "url", "blocked").limit(rows)
    own = tokens(F.col("url"))
    items = fine.select(F.when(F.col("blocked"), F.array_append(own, F.lit(_BLOCK))).otherwise(own).alias("items"), "blocked")
    scratch = Scratch(spark, "rules")
    items = scratch.table(items.repartition(16), "labelled")
    n, n_blocked = items.agg(F.count("*"), F.count(F.when(F.col("blocked"), 1))).first()
    if not n_blocked:
        return none
    least = max(min_count, -(-int(min_support * n * 1000) // 1000))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n)).fit(items.select("items")).freqItemsets
    sets = scratch.table(found.select(F.array_sort("items").alias("items"), "freq"), "sets")
    # Confidence: how often a set stands with the label, of how often it stands at all.
    blocked = sets.where(F.array_contains("items", _BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", _BLOCK).alias("rule"), F.col("freq").alias("n_blocked"))
    base = n_blocked / n
    confidence = (F.col("n_blocked") / F.col("freq")).alias("confidence")
    z = ((F.col("n_blocked") - F.col("freq") * base) / F.sqrt(F.col("freq") * (base * (1 - base) or 1e-9))).alias("z")
    rules = blocked.join(sets, F.col("rule") == F.col("items")).select("rule", confidence, (F.col("n_blocked") / F.col("freq") / base).alias("lift"), z, "n_blocked", F.col("freq").alias("n_urls"))
    rules = rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift) & (F.col("z") >= min_z) & (F.col("n_blocked") >= least))
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    filed = rules.withColumn("token", F.explode("rule")).join(single, "token")
    rarest = filed.groupBy(*(c for c in none.columns if c != "token")).agg(F.min(F.struct("freq", "token")).alias("rarest"))
    # Written, so that its size is known when a join with it is planned.
    return scratch.table(rarest.select(*(c for c in none.columns if c != "token"), F.col("rarest.token").alias("token")), "rules")


def held_out(labelled: DataFrame, share: int = 4, seed: int = 9, **options: object) -> dict[str, float]:
    """How rules mined in all but one of `share` parts of the labelled URLs do in that part: rules, urls, base (share of blocked), fitted, precision, recall."""
    fine = labelled.select("url", "blocked").where("url is not null and blocked is not null")
    part = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(share)) == 0
    rules = mine(fine.where(~part), **options)
    kept = fine.where(part)
    fits = kept.join(matches(kept, rules).select("url", "confidence"), "url", "left")
    met = F.col("confidence").isNotNull()
    n, bad, fitted, right = fits.agg(F.count("*"), F.count(F.when(F.col("blocked"), 1)), F.count(F.when(met, 1)), F.count(F.when(met & F.col("blocked"), 1))).first()
    return {"rules": rules.count(), "urls": n, "base": bad / max(1, n), "fitted": fitted, "precision": right / max(1, fitted), "recall": right / max(1, bad)}


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and confidence (of the best rule that it fits) of the distinct URLs that fit a rule."""
    own = urls.select("url").where("url is not null").distinct().select("url", tokens(F.col("url")).alias("own"))
    met = own.select("url", "own", F.explode("own").alias("token")).join(rules.select("rule", "confidence", "token"), "token")
    return met.where(F.size(F.array_except("rule", "own")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: DataFrame, explicit: list[tuple[str, str, str]] = ()) -> DataFrame:
    """pages with host, path, rule, verdict and confidence (of a mined rule; else null).

    pages: url string, and any others; columns with the names of the result are replaced. explicit: (verdict, host,
    path) rules, each for its host and all subdomains where the path starts with the rule's; the longest that fits wins
    (the first of equally long ones), and rule names it as host and path. Without one, rule is null and the verdict is
    block where a mined rule fits, else allow. A null URL, or one without ://, has an empty host and path and is allowed
    but for mined rules. Repeated rows are each judged; an empty table gives an empty result. URLs that fit mined rules
    aren't broadcast, as their number grows with the pages.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "confidence")
    df = packed(pages, "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for _, (verdict, h, p) in sorted(enumerate(explicit), key=lambda r: (len(r[1][1]) + len(r[1][2]), -r[0])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    df = df.withColumn("_found", found)
    mined = matches(df.where("_found is null"), rules).select(F.col("url").alias("_url"), F.col("confidence")).hint("merge")
    df = df.join(mined, df["url"] == mined["_url"], "left")
    verdict = F.coalesce("_found.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    confidence = F.when(F.col("_found").isNull(), F.col("confidence"))
    return df.select(*unpacked(pages.columns, "url"), "host", "path", F.col("_found.rule").alias("rule"), verdict.alias("verdict"), confidence.alias("confidence"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked): pages whose last number in the path is a labelled doc_id; blocked if of low quality or toxic."""
    number = F.expr(r"try_cast(regexp_extract(url, '(?s)^.*?://[^?#]*/([0-9]{1,18})[^0-9/?#]*/?(?:[?#].*)?$', 1) as bigint)")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("blocked"))
    return pages.select("url", number.alias("_number")).join(marks.hint("merge"), F.col("_number") == marks["doc_id"]).select("url", "blocked")
