"""URL filters: rules of hosts and path prefixes, and where no rule fits, a
logistic regression on hashed character n-grams of host and path.

The model is trained from a small table of labelled URLs. Descent from zero
never leaves the span of the labelled rows, so it runs on one number per row and
the rows' inner products: those are a join of the rows' n-grams, the steps one
expression. The coefficients then become weights of buckets, of which a model
has no more than its hash has values; every URL adds up the weights of its own
n-grams. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeloom.llm.common import ascii_lower, settle

Rule = tuple[str, str, str]  #: verdict, host, path prefix
ROWS = 1_000  #: labelled URLs that a model is trained from, at most


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host (A-Z in lower case) and path of url; both empty without "://"."""
    part = lambda p: F.coalesce(F.regexp_extract("url", p, 1), F.lit(""))
    return urls.withColumn("host", ascii_lower(part("://([^/?#]*)"))).withColumn("path", part("://[^/?#]*([^?#]*)"))


def ruled(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else null. A
    rule fits its host and all subdomains where the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # a longer one overrules
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(rows: DataFrame, key: str, orders: tuple[int, ...], buckets: int) -> DataFrame:
    """key and bucket of every n-gram of host and of path (each with a mark of its
    part and of its ends); a row without any has none."""
    signs = lambda part: F.split(F.concat(F.lit("^"), F.col(part), F.lit("$")), "")
    parts = rows.select(key, F.explode(F.array(*[F.struct(F.lit(part[0]).alias("part"), signs(part).alias("c")) for part in ("host", "path")])).alias("x"))
    parts = parts.select(key, "x.part", "x.c", F.size("x.c").alias("n"))

    def of(k: int) -> Column:
        gram = lambda i: F.concat("part", *[F.element_at("c", i + j) for j in range(k)])
        return F.when(F.col("n") >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - (k - 1), F.lit(1))), gram)).otherwise(F.array().cast("array<string>"))

    each = parts.select(key, F.explode(F.concat(*[of(k) for k in orders])).alias("gram"))
    return each.select(key, (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int").alias("bucket"))


def train(labelled: DataFrame, orders: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 14, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> DataFrame:
    """Weights of a logistic regression: bucket, weight; the bucket -1 is the constant.

    labelled: url, bad (boolean), at most ROWS rows (more are an error; rows with
    a null in either are left out). A row is the counts of its n-grams over the
    root of the sum of their squares. Descent over all rows: steps of rate, with
    weights decaying by rate * decay.
    """
    rows = with_parts(labelled.where("url is not null and bad is not null").select("url", "bad"))
    rows = settle(rows.select(F.row_number().over(W.orderBy("url", "bad")).alias("row"), "host", "path", F.col("bad").cast("double").alias("y")), "labelled")  # ROWS at most
    if rows.count() > ROWS:
        raise ValueError(f"at most {ROWS} labelled URLs")
    counts = grams(rows, "row", orders, buckets).groupBy("row", "bucket").agg(F.count(F.lit(1)).alias("n"))
    norms = counts.groupBy("row").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    x = settle(counts.join(norms, "row").select("row", "bucket", (F.col("n") / F.col("norm")).alias("x")), "features")
    a, b = (x.select(F.col("row").alias(f"row{k}"), "bucket", F.col("x").alias(f"x{k}")) for k in "12")
    products = a.join(b, "bucket").groupBy("row1", "row2").agg(F.sum(F.expr("x1 * x2")).alias("g"))
    products = products.groupBy(F.col("row1").alias("row")).agg(F.array_sort(F.collect_list(F.struct("row2", "g"))).alias("g"))
    whole = rows.join(products, "row", "left").agg(F.array_sort(F.collect_list(F.struct("row", "y", F.coalesce("g", F.array().cast("array<struct<row2:int,g:double>>")).alias("g")))).alias("rows"))
    m = F.greatest(F.size("rows"), F.lit(1))

    def margin(g: Column, a: Column) -> Column:
        return F.aggregate(g, F.lit(0.0), lambda s, p: s + p["g"] * F.element_at(a, p["row2"]))

    def step(state: Column, _: Column) -> Column:
        """state: the rows' coefficients a, and the constant c."""
        miss = F.transform("rows", lambda r: r["y"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-(margin(r["g"], state["a"]) + state["c"]))))
        return F.struct(F.zip_with(state["a"], miss, lambda v, e: v * (1 - rate * decay) + rate * e).alias("a"), (state["c"] + rate / m * F.aggregate(miss, F.lit(0.0), lambda s, e: s + e)).alias("c"))

    start = F.struct(F.transform("rows", lambda r: F.lit(0.0)).alias("a"), F.lit(0.0).alias("c"))
    fitted = whole.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("fit"))
    fitted = settle(fitted.select("fit.c", F.arrays_zip(F.transform("rows", lambda r: r["row"]).alias("row"), F.col("fit.a").alias("a")).alias("each")), "fit")
    alphas = fitted.select(F.explode("each").alias("e")).select("e.row", "e.a")
    weights = x.join(alphas, "row").groupBy("bucket").agg(F.sum(F.expr("x * a")).alias("weight"))
    return settle(weights.unionByName(fitted.select(F.lit(-1).alias("bucket"), F.col("c").alias("weight"))), "weights")


def judge(pages: DataFrame, rules: list[Rule], weights: DataFrame, orders: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 14, bar: float = 0.5) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score (the
    model's probability that the URL is bad).

    The verdict is that of the longest rule that fits; where none does, block if
    the score is at least bar, else allow. A null url, or one without "://", has
    an empty host and path, which the model judges like any other. Rows that
    repeat a page_id are rows of their own. An empty table gives an empty result.
    Other columns are not read. orders and buckets have to be those of train.
    """
    rows = settle(with_parts(pages.select("page_id", "url").withColumn("row", F.monotonically_increasing_id())).drop("url"), "urls")
    constant = weights.where("bucket = -1").first()
    own = F.broadcast(weights.where("bucket >= 0"))  # at most buckets rows
    counts = grams(rows, "row", orders, buckets).groupBy("row", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.join(own, "bucket", "left").groupBy("row").agg((F.sum(F.col("n") * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(F.col("n") * F.col("n")))).alias("z"))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.coalesce("z", F.lit(0.0)) + F.lit(float(constant["weight"]) if constant else 0.0))))
    rule, says = ruled(rules)
    out = rows.join(sums, "row", "left").withColumn("score", score)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("score") >= bar, "block").otherwise("allow")).alias("verdict"), "score")
