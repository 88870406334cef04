"""URL filter: a list of host and path rules, and association rules for the urls that the list leaves open.

A list rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's; the
longest one wins. Urls that a list rule decides are the labelled ones: their tokens (labels of the host, path segments
with digits folded, query keys, scheme, fragment) and their verdict are the items of Spark's FP-growth. Of its
association rules those that conclude a verdict with enough support and confidence are kept, without rules to which a
smaller one with the same verdict and no less confidence applies.

Matching goes through an inverted index: each rule stands under its rarest token, so a url meets only the rules of its
own tokens, and keeps those whose other tokens it also has. The most confident rule decides, then the one with most
support, then the one with most tokens; a url that none fits is allowed.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes on up
to ``?``, ``#`` or the end. A NULL url, or one without ``://``, has empty host and path. Equal urls are judged once and
joined back, so a repeated url or row costs nothing. Without labelled urls of a kind there are no rules for it. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import written

# Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SUPPORT, CONFIDENCE = 0.01, 0.9
VERDICT = "verdict="


def parted(pages: DataFrame) -> DataFrame:
    """``pages`` (``page_id, url``) with ``host`` and ``path``, and ``_rest`` behind them."""
    rest = pages.withColumn("_rest", F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END"))
    rest = rest.withColumn("_host", F.expr("regexp_extract(_rest, '^[^/?#]*', 0)"))
    rest = rest.withColumn("_rest", F.expr("substring(_rest, length(_host) + 1)"))
    rest = rest.withColumn("path", F.expr("regexp_extract(_rest, '^[^?#]*', 0)")).withColumn("_rest", F.expr("substring(_rest, length(path) + 1)"))
    return rest.withColumn("host", F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).drop("_host")


def listed(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits ``host`` and ``path``, as (size, rule, verdict); NULL if none does."""
    fits = [
        F.when(((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits))


TOKENS = r"""array_distinct(filter(concat(
    array(concat('s:', substring_index(url, '://', 1))),
    transform(split(host, '\\.'), x -> concat('h:', x)),
    transform(filter(split(path, '/'), x -> x <> ''), x -> concat('p:', regexp_replace(x, '[0-9]+', '#'))),
    CASE WHEN _rest LIKE '?%' THEN transform(split(substring(substring_index(_rest, '#', 1), 2), '&'), x -> concat('q:', substring_index(x, '=', 1))) ELSE array() END,
    CASE WHEN _rest LIKE '%#%' THEN array('f:') ELSE array() END
), x -> x IS NOT NULL))"""


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``antecedent, verdict, confidence, support, key``: rules from ``tokens`` and ``verdict``. ``key`` is the rarest token."""
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(VERDICT), "verdict")).alias("items"))
    model = FPGrowth(minSupport=support, minConfidence=confidence, itemsCol="items").fit(items)
    rules = model.associationRules.where(F.col("consequent")[0].startswith(VERDICT))
    rules = rules.selectExpr("array_sort(antecedent) AS antecedent", f"substring(consequent[0], {len(VERDICT) + 1}) AS verdict", "confidence", "support")
    alone = model.freqItemsets.where("size(items) = 1").selectExpr("items[0] AS token", "freq")
    rarest = rules.select("antecedent", "verdict", F.explode("antecedent").alias("token")).join(alone, "token").groupBy("antecedent", "verdict")
    keyed = written(rules.join(rarest.agg(F.min(F.struct("freq", "token"))["token"].alias("key")), ["antecedent", "verdict"]))
    # A rule is idle where a smaller one says the same with no less confidence.
    wider = keyed.selectExpr("antecedent AS tokens", "verdict AS v", "confidence AS c")
    idle = matches(wider, keyed).where("verdict = v AND confidence >= c AND size(antecedent) < size(tokens)").selectExpr("tokens AS antecedent", "v AS verdict").distinct()
    return keyed.join(idle, ["antecedent", "verdict"], "left_anti")


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Each of ``rows`` (with ``tokens``) beside each rule whose tokens it has all, by the index of key tokens."""
    met = rows.withColumn("_token", F.explode("tokens")).join(rules, F.expr("_token = key"))
    return met.where("size(array_except(antecedent, tokens)) = 0").drop("_token")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict, evidence`` for each row of ``pages`` (``page_id, url``)."""
    rows = parted(pages.select("page_id", "url")).withColumn("_listed", listed(rules))
    urls = parted(pages.select("url").where("url IS NOT NULL").distinct()).withColumn("_listed", listed(rules)).withColumn("tokens", F.expr(TOKENS))
    mined_rules = mined(urls.where("_listed IS NOT NULL").selectExpr("tokens", "_listed.verdict AS verdict"), support, confidence)
    found = matches(urls.where("_listed IS NULL").select("url", "tokens"), mined_rules)
    best = F.max(F.struct("confidence", "support", F.size("antecedent").alias("size"), "antecedent", "verdict"))
    chosen = found.groupBy("url").agg(best.alias("_best")).selectExpr("url AS _url", "_best")
    return rows.join(chosen, F.expr("url = _url"), "left").selectExpr(
        "page_id", "host", "path", "_listed.rule AS rule", "coalesce(_listed.verdict, _best.verdict, 'allow') AS verdict",
        "CASE WHEN _listed IS NULL THEN array_join(_best.antecedent, ' ') END AS evidence",
    )
