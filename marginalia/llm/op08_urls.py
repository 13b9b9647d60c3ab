"""URL filters: logistic regression on hashed character n-grams of host and path, with rules that come first. DataFrame functions only.

A URL's host and path, each between marks, give their character n-grams; each n-gram, with the part it is from, is hashed into one of
BUCKETS. The model is trained once from a small labelled table, whose rows get their buckets by the same expressions. The weights then
stand in the plan as one array literal, and a row's score is a sum over its n-grams.

Rules are (verdict, host and path). A rule fits its host and all subdomains of it, if the path begins with the rule's; the longest wins.

Defined results: a null URL, or one without "://", has an empty host and path, which no rule fits, and gets the model's verdict for
empty parts; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BUCKETS = 4096
SIZES = (3, 4, 5)
STEPS = 24

#: The labelled table: names of hosts and beginnings of paths that are blocked and allowed; label() pairs them up.
BLOCKED_HOSTS = (
    "discount-pills buy-pills online-pharmacy spam-farm link-farm free-casino casino-bonus poker-slots bet-win-now payday-loans fast-loans replica-watches fake-id "
    "xxx-videos adult-cams hot-singles crack-keygen warez-download torrent-hub malware-drop phishing-login win-prizes free-gift-cards click-farm seo-spam "
    "viagra-store miracle-diet crypto-doubler get-rich-quick escort-list spam-links pills-shop casino-spins cheap-meds spam-network"
).split()
ALLOWED_HOSTS = (
    "news library university docs museum weather recipes garden history science journal city-council school observatory archive theatre forum "
    "wiki cooking travel-notes nature poetry chess astronomy hospital charity radio orchestra gallery railway harbour bakery cycling mountains "
    "parliament kindergarten fishing knitting volcano architecture translation violin beekeeping lighthouse"
).split()
BLOCKED_PATHS = ("/buy-now/pills", "/free-casino-bonus", "/win-prize?id=4", "/crack/keygen.html", "/cheap/viagra", "/xxx/video", "/loan-offer", "/spam/links")
ALLOWED_PATHS = ("/articles/7", "/about.html", "/docs/intro", "/2021/05/notes", "/story/881", "/guide/42.html", "/", "/archive/index.html")


def label() -> list[tuple[str, int]]:
    """The labelled table: each host under several domains, half the time with a plain path, so that only the names tell."""
    out = []
    domains, prefixes, plain = ("example.com", "example.net", "example.org", "com", "org"), ("", "www.", "m.", "blog."), ("/page/{n}", "/{n}/", "/item-{n}.html", "/p/{n}")
    for klass, hosts, paths in ((1, BLOCKED_HOSTS, BLOCKED_PATHS), (0, ALLOWED_HOSTS, ALLOWED_PATHS)):
        for i, host in enumerate(hosts):
            for k in range(3):
                n = 7 * i + k
                path = plain[n % 4].format(n=13 * n % 997) if k < 2 else paths[i % len(paths)]
                out.append((f"https://{prefixes[n % 4]}{host}.{domains[n % 5]}{path}", klass))
    return out



def parts(urls: DataFrame) -> DataFrame:
    """Adds host and path to a table with a column url."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the longest last, so outermost
        cut = text.index("/")
        name, begin = text[:cut], text[cut:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def buckets(host: Column, path: Column) -> Column:
    """The buckets of all n-grams of both parts, repeated as they repeat."""
    found = []
    for mark, part in (("h", host), ("p", path)):
        text = F.concat(F.lit("^"), part, F.lit("$"))
        for n in SIZES:
            found.append(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), _bucket(mark, text, n)))
    return F.concat(*found)


def _bucket(mark: str, text: Column, n: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(mark), text.substr(i, F.lit(n))), F.lit(BUCKETS)).cast("int")


def _score(weights: list[float], bias: float, cells: Column) -> Column:
    """The probability of label 1; the mean weight of the n-grams, scaled by the root of their number."""
    table = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")  # folded to one literal
    total = F.aggregate(cells, F.lit(0.0), lambda s, b: s + F.get(table, b))
    return 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.size(cells).cast("double")))))


def train(spark: SparkSession, table: list[tuple[str, int]], steps: int = STEPS, rate: float = 3.0, decay: float = 0.002) -> tuple[list[float], float]:
    """(weights by bucket, bias) by full-batch gradient steps with momentum. The labelled table is small and fixed, so its rows' buckets come to the driver."""
    values = ", ".join(f"('{url}', {klass})" for url, klass in table)
    source = spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)") if table else spark.sql("SELECT '' AS url, 0 AS label WHERE false")
    known = parts(source).orderBy("url").select("label", buckets(F.col("host"), F.col("path")).alias("cells")).collect()
    weights, bias, speed = [0.0] * BUCKETS, 0.0, [0.0] * (BUCKETS + 1)
    for _ in range(steps):
        grad = [0.0] * (BUCKETS + 1)
        for y, cells in known:
            scale = len(cells) ** 0.5
            error = y - 1 / (1 + math.exp(-(bias + sum(weights[b] for b in cells) / scale)))
            grad[BUCKETS] += error
            for b in cells:
                grad[b] += error / scale
        for b in range(BUCKETS):
            speed[b] = 0.8 * speed[b] + grad[b] / max(1, len(known)) - decay * weights[b]
            weights[b] += rate * speed[b]
        speed[BUCKETS] = 0.8 * speed[BUCKETS] + (grad[BUCKETS] / len(known) if known else 0)
        bias += rate * speed[BUCKETS]
    return [round(w, 9) for w in weights], round(bias, 9)


_trained: dict[tuple, tuple[list[float], float]] = {}


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, table: list[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability of block)."""
    spark = pages.sparkSession
    table = label() if table is None else table
    key = (tuple(table), spark.sparkContext.applicationId)
    if key not in _trained:
        _trained[key] = train(spark, table)
    weights, bias = _trained[key]
    rows = parts(pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url")))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    scored = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), _score(weights, bias, buckets(F.col("host"), F.col("path"))).alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
