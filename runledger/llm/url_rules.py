"""URL filter: hand-written rules first, then association rules mined from the URLs that those rules judge.

* Tokens: the set of a URL's scheme, top domain, site (last two labels), every further host label, every folder, the words of the last
  part and its form, every query key, and whether there is a fragment.
* Mining: single tokens are counted first, and only those that are frequent among the examples go on; of tokens that are in the very
  same examples, one stands for all.  FP-growth over these and the label; rules token set -> label stay if support, confidence and lift
  are high enough.
* Matching: an inverted index from a rule's rarest token to the rule; distinct token sets, not rows, look up each of their
  tokens (those that rules know) and keep the rules they contain.  The best rule by confidence, support and length decides; without one, ``default``.

Null URLs and those without ``://`` have an empty host and path, match no hand-written rule and get the default.  Repeated rows
are judged alike.  Without any labelled URL nothing is mined.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. ``rules``: (verdict, host/path), written by hand."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """All tokens of a URL, distinct, each with its kind."""
    labels, address = F.split(host, r"\."), F.coalesce(url, F.lit(""))
    last = F.regexp_extract(path, r"([^/]*)/?$", 1)
    form = (F.when(path == "", "none").when(path.endswith("/"), "folder").when(last.rlike(r"^[0-9]+$"), "number")
            .when(last.rlike(r"\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("."), F.regexp_extract(last, r"\.([A-Za-z0-9]{1,5})$", 1))).otherwise("name"))
    one = {"scheme": F.lower(F.regexp_extract(address, r"^([A-Za-z][A-Za-z0-9+.-]{0,15})://", 1)), "top": F.element_at(labels, -1),
           "site": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."), "form": form,
           "mark": F.when(F.instr(address, "#") > 0, "yes").otherwise("")}
    query = F.regexp_extract(address, r"^[^?#]*\?([^#]*)", 1)
    many = {"label": F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))), "folder": F.regexp_extract_all(path, F.lit(r"([^/]+)/"), F.lit(1)),
            "word": F.regexp_extract_all(last, F.lit(r"([A-Za-z0-9]+)"), F.lit(1)), "key": F.regexp_extract_all(query, F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))}
    named = lambda kind, values: F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(kind + "="), v))
    return F.array_distinct(F.concat(*[named(k, F.array(v)) for k, v in one.items()], *[named(k, v) for k, v in many.items()]))


def telling(labelled: DataFrame, least: int) -> DataFrame:
    """(token): tokens in at least ``least`` examples; of tokens in the same examples the first by name."""
    sets = labelled.select(F.xxhash64("tokens").cast("decimal(38,0)").alias("h"), F.xxhash64("tokens", F.lit(1)).alias("x"), F.explode("tokens").alias("token"))
    marks = sets.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("sum"), F.bit_xor("x").alias("xor")).filter(F.col("n") >= least)
    return marks.groupBy("n", "sum", "xor").agg(F.min("token").alias("token")).select("token")


def restrict(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct ``tokens`` of the rows with ``own``, their tokens among the known ones, in order."""
    sets = rows.select("tokens").distinct()
    kept = sets.withColumn("token", F.explode("tokens")).join(known, "token", "left_semi").groupBy("tokens").agg(F.sort_array(F.collect_list("token")).alias("own"))
    return sets.join(kept, "tokens", "left").select("tokens", F.coalesce("own", F.array().cast("array<string>")).alias("own"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_lift: float = 1.05,
         min_rows: int = 5) -> DataFrame:
    """Rules (antecedent, label, confidence, support, key) from rows (tokens, label); ``key`` is the rarest token."""
    labelled = cut_lineage(labelled.select("tokens", "label"))
    rows = labelled.count()
    none = labelled.sparkSession.createDataFrame(
        [], "antecedent array<string>, label string, confidence double, support double, key string")
    least = max(math.ceil(min_support * rows), min_rows)
    if rows < least:  # too few examples for any rule; FP-growth takes no support above 1
        return none
    own = restrict(labelled, cut_lineage(telling(labelled, least)))
    baskets = cut_lineage(labelled.join(own, "tokens").select(F.concat("own", F.array(F.concat(F.lit("verdict="), "label"))).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows, minConfidence=min_confidence).fit(baskets)
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("_item"), "freq")
    kept = (model.associationRules.filter(F.col("consequent")[0].startswith("verdict=") & (F.col("lift") >= min_lift))
            .select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 9, 1000).alias("label"),
                    "confidence", "support"))
    rarest = (kept.select("antecedent", F.explode("antecedent").alias("_item")).join(single, "_item").groupBy("antecedent")
              .agg(F.min(F.struct("freq", "_item"))["_item"].alias("key")))
    return cut_lineage(kept.join(rarest, "antecedent"))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule of each distinct token set: tokens, mined (label, confidence, support, antecedent)."""
    own = restrict(sets, rules.select(F.explode("antecedent").alias("token")).distinct())
    looked = own.select("own").distinct().withColumn("key", F.explode("own")).join(rules, "key")
    best = F.max(F.struct("confidence", "support", F.size("antecedent").alias("length"), "label", "antecedent"))
    found = looked.filter(F.size(F.array_except("antecedent", "own")) == 0).groupBy("own").agg(best.alias("mined"))
    return own.join(found, "own").select("tokens", "mined")


def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, default: str = "allow", **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence, because (the mined rule's tokens).

    ``labels`` (tokens, label) replaces the rows that the hand-written rules judge as the examples to learn from.
    """
    url = F.col("url").cast("string")
    parts = pages.select("page_id", url.alias("url"))
    host, path = host_and_path(F.col("url"))
    seen = cut_lineage(parts.withColumn("host", host).withColumn("path", path)
                       .withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
                       .withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).drop("url"))
    if labels is None:
        labels = seen.filter("found IS NOT NULL").select("tokens", F.col("found.verdict").alias("label"))
    mined = match(seen.filter("found IS NULL"), mine(labels, **mining))
    return seen.join(mined, "tokens", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", "mined.label", F.lit(default)).alias("verdict"),
        F.when(F.col("found").isNull(), F.col("mined.confidence")).alias("confidence"),
        F.when(F.col("found").isNull(), F.array_join("mined.antecedent", " ")).alias("because"))
