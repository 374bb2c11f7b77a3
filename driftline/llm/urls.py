"""URL filters: longest fitting rule, else logistic regression on hashed character n-grams.

Everything on the data path is a Spark SQL expression. The classifier is fitted once, in plain
Python, to the small labelled table below; its weights enter the plan as one array literal.

Defined cases: a null url or one without `://` has empty host and path, fits no rule, and is judged by
the classifier on empty strings (allowed); repeated rows and null ids each give their own row; equally long
rules that both fit (same text) cannot differ; an empty table gives an empty result; very long urls are
judged whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import string
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, GRAM = 4096, 4

#: The production rules, (host/path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The labelled table: names seen in unwanted and in wanted addresses, set into the same address shapes.
UNWANTED = "casino-royal royalcasino pills-shop best-pills best-bets bets-online spam-links spammers ads-click adserver win-casino winner-prize cheap-meds cheap-watches free-casino free-prizes link-farm content-farm track-ads tracker poker-win viagra-shop xxx-cams loan-fast payday-loans adult-chat click-bait buy-followers replica-bags lottery-win slots-free".split()
WANTED = "harbour-news weather city-library museum openmaps gardening railway-times cookbook physics-notes brother another stories parkrun mathforum chess-club village-school orchard riverside theatre northern council historians birdwatch knitting leathercraft motherhood together feathers nation-atlas station".split()
SHAPES = ("https://www.{}.example.com/en/{}.html", "http://{}.example.org/fr/{}?page=2&ref=x", "https://blog.{}.example.net/de/{}#top", "http://m.{}.example.com/es/{}/")


def labelled_urls() -> list[tuple[str, int]]:
    return [(shape.format(name, 100 + 7 * i), blocked) for blocked, names in ((1, UNWANTED), (0, WANTED)) for i, name in enumerate(names) for shape in SHAPES]


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, path = rest[:end].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), rest[end:]
    return host, path[: min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))]


def marked(host: str, path: str) -> tuple[str, str]:
    return f"^{host}$", f"{path}$"


def buckets_of(host: str, path: str) -> list[int]:
    """Distinct buckets of the character n-grams of host and path: the first 12 bits of an md5."""
    grams = [tag + s[i : i + GRAM] for tag, s in zip("hp", marked(host, path), strict=True) for i in range(max(1, len(s) - GRAM + 1))]
    return sorted({int(hashlib.md5(g.encode()).hexdigest()[:3], 16) for g in grams})


@lru_cache(maxsize=1)
def weights() -> tuple[tuple[float, ...], float]:
    """(weight of each bucket, bias): gradient descent on the regularised logistic loss, rounded so that sums agree everywhere."""
    rows = [(buckets_of(*split_url(u)), y) for u, y in labelled_urls()]
    w, b = [0.0] * BUCKETS, 0.0
    for _ in range(150):
        grad, gb = {}, 0.0
        for f, y in rows:
            e = 1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(w[i] for i in f))))) - y
            gb += e
            for i in f:
                grad[i] = grad.get(i, 0.0) + e
        b -= 0.5 * gb / len(rows)
        for i, g in grad.items():
            w[i] -= 0.5 * (g / len(rows) + 1e-4 * w[i])
    return tuple(round(x, 4) for x in w), round(b, 4)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """Text of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, text).otherwise(out)
    return out


def grams(tag: str, s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - (GRAM - 1))), lambda i: F.concat(F.lit(tag), F.substring(s, i, GRAM)))


def classifier_score(host: Column, path: Column) -> Column:
    w, b = weights()
    table = F.lit(list(w))
    both = F.concat(grams("h", F.concat(F.lit("^"), host, F.lit("$"))), grams("p", F.concat(path, F.lit("$"))))
    found = F.array_distinct(F.transform(both, lambda g: F.conv(F.substring(F.md5(g), 1, 3), 16, 10).cast("int")))
    return F.aggregate(found, F.lit(b), lambda a, i: a + F.element_at(table, i + 1))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) per row; score is the classifier's log odds of block where no rule fits."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    scored = ruled.withColumn("score", F.when(F.col("rule").isNull(), classifier_score(F.col("host"), F.col("path"))))
    verdict = F.when(F.col("score") > 0, "block").when(F.col("score").isNotNull(), "allow")
    for text, what in rules:
        verdict = F.when(F.col("rule") == text, what).otherwise(verdict)
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")


def oracle() -> str:
    """DuckDB SQL for (page_id, host, path, rule, verdict) over pages."""
    w, b = weights()
    rules = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = lambda text: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')".format(text.split("/", 1)[0], "/" + text.split("/", 1)[1])
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for t, _ in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{t}' THEN '{v}'" for t, v in rules) + f" WHEN {b} + coalesce(list_sum(list_transform(list_distinct(list_transform(list_concat(" + ", ".join(f"list_transform(range(1, greatest(1, length({s}) - {GRAM - 1}) + 1), lambda i: '{tag}' || substr({s}, i, {GRAM}))" for tag, s in (("h", "('^' || host || '$')"), ("p", "(path || '$')"))) + f"), lambda g: ('0x' || substr(md5(g), 1, 3))::INT)), lambda k: w[k + 1])), 0) > 0 THEN 'block' ELSE 'allow' END"
    return f"""WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (SELECT *, {rule} AS rule FROM cut),
model AS (SELECT [{', '.join(map(str, w))}]::DOUBLE[] AS w)
SELECT page_id, host, path, rule, {verdict} AS verdict FROM ruled, model"""
