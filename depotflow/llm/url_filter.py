"""Verdicts on URLs: rules by host and path, and boosted trees over lexical features for the rest."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from .common import smallest_hashes, write_shared

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))


@dataclass(frozen=True)
class Trees:
    """Training parameters. At most `most_rows` labelled rows are learned from, those with the smallest URL hash."""

    rounds: int = 8
    depth: int = 3
    most_rows: int = 20_000
    least_rows: int = 20
    block_at: float = 0.5
    seed: int = 5


_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url):
    """Host (A-Z lower-cased) and path of a URL column; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), *_LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_columns(host, path, rules=RULES):
    """Struct of the longest fitting rule and its verdict, or null. Ties: the rule listed first."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _features(rows):
    """Adds lexical features of `url`, `host`, `path`."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url)
    letters = F.array_distinct(F.split(url, ""))
    share = lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.transform(F.filter(letters, lambda c: c != ""), lambda c: -share(c) * F.log2(share(c))),
                          F.lit(0.0), lambda s, x: s + x)
    marks = lambda c: F.length(F.regexp_replace(url, c, ""))
    return rows.withColumns({
        "f_length": size.cast("double"), "f_host_length": F.length("host").cast("double"),
        "f_path_length": F.length("path").cast("double"),
        "f_depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
        "f_labels": F.length(F.regexp_replace("host", "[^.]", "")).cast("double"),
        "f_digits": F.when(size > 0, marks("[^0-9]") / size).otherwise(0.0),
        "f_marks": marks("[^-_%~]").cast("double"), "f_parameters": marks("[^=]").cast("double"),
        "f_entropy": F.when(size > 0, entropy).otherwise(0.0),
        "f_secure": url.startswith("https:").cast("double"),
    })


def judge_urls(pages, labelled, id="page_id", url="url", rules=RULES, trees=Trees()):
    """`id`, `host`, `path`, `rule`, `verdict`, `score` of every row.

    The longest rule that fits decides; other URLs are judged by gradient-boosted
    trees over lexical features: lengths, depth, labels, digit ratio, marks, parameters, character
    entropy, and statistics of the host's last two labels (how many rows have it, share of
    blocked ones among the labelled, leaving the row itself out). `score` is the
    trees' probability of `block`.

    `labelled` has `id` and `blocked` (0 or 1; others and nulls are ignored; of several the
    highest counts). With fewer than `least_rows` labelled rows or one class only, the score is the
    share of blocked rows, one half without any. A null URL has empty host and path. Repeated rows
    each get a row; an empty table gives no rows; other columns are ignored.
    Suffix counts are combined in the map tasks and joined by suffix.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -2))
    known = labelled.where("blocked in (0, 1)").groupBy(F.col(id).alias("id")).agg(F.max("blocked").cast("double").alias("y"))
    rows = write_shared(_features(rows).join(known, "id", "left"), "urls")
    suffixes = rows.groupBy("suffix").agg(F.count("*").alias("n"), F.count("y").alias("seen"), F.sum("y").alias("bad"))
    prior = 4.0
    rate = rows.agg(F.avg("y").alias("rate"), F.count("y").alias("n"), F.sum("y").alias("bad")).first()
    share = rate["rate"] if rate["rate"] is not None else 0.5
    bad = F.coalesce("bad", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
    seen = F.col("seen") - F.when(F.col("y").isNotNull(), 1).otherwise(0)
    full = rows.join(suffixes, "suffix").withColumns({
        "f_suffix_rows": F.log1p("n"), "f_suffix_bad": (bad + prior * share) / (seen + prior)})
    names = [c for c in full.columns if c.startswith("f_")]
    if rate["n"] >= trees.least_rows and 0 < rate["bad"] < rate["n"]:
        assembler = VectorAssembler(inputCols=names, outputCol="x")
        sampled = smallest_hashes(full.where("y is not null").select("id", "url", "y", *names), ["id", "url"], trees.most_rows)
        sample = write_shared(assembler.transform(sampled).select("x", "y"), "url-sample")
        model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees.rounds, maxDepth=trees.depth,
                              seed=trees.seed).fit(sample)
        scored = model.transform(assembler.transform(full)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = full.withColumn("score", F.lit(float(share)))
    decided = rule_columns(F.col("host"), F.col("path"), rules)
    return scored.withColumn("r", decided).select(
        F.col("id").alias(id), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("score") >= trees.block_at, "block").otherwise("allow")).alias("verdict"),
        "score")
