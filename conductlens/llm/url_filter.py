"""URL filter: host and path rules first, gradient-boosted trees for the rest.

Labelled URLs are the ones that a rule decides; the trees learn the verdict
from lexical features (lengths, depth, digit ratio, character entropy, counts
of parameters and separators) and block rates of the host's suffix, of suffix
and first path segment, of that segment and of the first host label, and judge
every URL without a rule.  A labelled URL's rates come from the other folds of
the labelled URLs; a key that they do not hold counts as unseen, with a rate of
one half, and folds of the training rows take part with keys withheld, so that the
trees know what to do where nothing is known.  Both classes weigh the same.
All steps are DataFrame expressions and Spark ML's boosted trees, which run in the JVM.

Defined cases: a null URL or one without ``://`` has an empty host and path, so
no rule fits and the trees judge it.  Rules of equal length that both fit are
taken in the order given.  With no labelled URL, or labels of one class only,
the verdict is that class (``allow`` when there is none).  Repeated rows are
judged alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conductlens.llm.common import ascii_lower, stage

Rule = tuple[str, str]  # (verdict, "host/path")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) columns of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, else null.  The rule list is a short, fixed parameter."""
    out = F.lit(None).cast("string")
    ordered = sorted(enumerate(rules), key=lambda x: (-len(x[1][1]), x[0]))
    for _, (_, text) in reversed(ordered):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def lexical_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the feature columns to a frame with url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    letters = F.split(url, "")
    n = F.length(url)
    counts = F.transform(
        F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)).cast("double") / F.size(letters)
    )
    entropy = F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    labels = F.split(F.col("host"), r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    columns = {
        "f_length": n,
        "f_host_length": F.length("host"),
        "f_path_length": F.length("path"),
        "f_depth": F.regexp_count("path", F.lit("/[^/]")),
        "f_digit_ratio": _ratio(F.regexp_count(url, F.lit("[0-9]")), n),
        "f_entropy": F.when(n > 0, entropy).otherwise(0.0),
        "f_parameters": F.when(F.length(query) > 0, F.regexp_count(query, F.lit("&")) + 1).otherwise(0),
        "f_fragment": F.contains(url, F.lit("#")).cast("int"),
        "f_hyphens": F.regexp_count(url, F.lit("-")),
        "f_host_labels": F.size(labels),
        "f_secure": url.startswith("https://").cast("int"),
    }
    out = df.withColumns({k: v.cast("double") for k, v in columns.items()}).withColumns(
        {
            "suffix": F.coalesce(F.element_at(labels, -1), F.lit("")),
            "section": F.concat_ws("/", F.element_at(labels, -1), F.regexp_extract("path", r"^/([^/]*)", 1)),
            "lead": F.regexp_extract("path", r"^/([^/]*)", 1),
            "front": F.coalesce(F.element_at(labels, 1), F.lit("")),
        }
    )
    return out, list(columns)


FOLDS = 10
KEYS = ("suffix", "section", "lead", "front")
#: Which keys are withheld from the training rows of a fold, as if they had never been seen.
WITHHELD = {0: ("suffix", "section"), 1: ("lead", "front"), 2: KEYS}
SMOOTHING = 5.0


def key_rates(labelled: DataFrame, key: str) -> DataFrame:
    """(key, blocked, total): the weights of its labelled URLs, those of each fold and those of all, over all of them."""
    fold = lambda value: F.array(*[F.sum(F.when(F.col("fold") == k, value).otherwise(0.0)) for k in range(FOLDS)], F.sum(value))
    return labelled.groupBy(key).agg(fold(F.col("label") * F.col("weight")).alias("blocked"), fold(F.col("weight")).alias("total"))


def with_rates(rows: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """Adds ``f_rate_<key>``, smoothed towards one half, and ``f_seen_<key>``; labelled rows are judged by the other folds."""
    # written, so that a frequent key is split in the join and not made in one task with its aggregation
    out = rows.join(stage(key_rates(labelled, key)), key, "left")
    mine = lambda c: F.when(F.col("label").isNotNull(), F.get(c, F.col("fold"))).otherwise(0.0)
    left = lambda c: F.coalesce(F.get(F.col(c), F.lit(FOLDS)) - mine(F.col(c)), F.lit(0.0))
    withheld = F.col("label").isNotNull() & F.col("fold").isin([k for k, keys in WITHHELD.items() if key in keys])
    # differences of sums are not exact: a class weighs more than one half, so what is left is that much or nothing
    seen = ~withheld & (left("total") > 0.25)
    rate = F.when(seen, (left("blocked") + SMOOTHING / 2) / (left("total") + SMOOTHING)).otherwise(0.5)
    return out.withColumns({f"f_rate_{key}": rate, f"f_seen_{key}": seen.cast("double")}).drop("blocked", "total")


def url_filter(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    max_train_rows: int = 20_000,
    rounds: int = 15,
    depth: int = 3,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, by_rule (the rule's verdict, null where the trees judged), score (of the trees, towards block; null if there are none).

    ``max_train_rows`` bounds the labelled URLs that the trees are fitted on,
    taken in the order of a hash of the URL; suffix statistics and verdicts
    cover every row.
    """
    url = F.col(url_col)
    host, path = url_parts(url)
    parts = pages.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    said = reduce(lambda acc, r: F.when(F.col("rule") == r[1], F.lit(r[0])).otherwise(acc), reversed(rules), F.lit(None).cast("string"))
    parts = parts.withColumn("by_rule", said)
    rows, names = lexical_features(parts)
    rows = stage(rows.withColumn("label", F.when(F.col("by_rule").isNotNull(), (F.col("by_rule") == "block").cast("double"))))
    labelled = rows.where("label is not null")
    tally = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")).first()

    columns = [F.col("id").alias(id_col), "host", "path", "rule"]
    if tally.n == 0 or tally.blocked in (0.0, float(tally.n)):
        rest = F.lit("block" if tally.n and tally.blocked else "allow")
        return rows.select(*columns, F.coalesce("by_rule", rest).alias("verdict"), "by_rule", F.lit(None).cast("double").alias("score"))
    weight = F.when(F.col("label") == 1, tally.n / (2 * tally.blocked)).otherwise(tally.n / (2 * (tally.n - tally.blocked)))
    # copies of a URL are in one fold
    dealt = lambda df: df.withColumns({"weight": weight, "fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")})
    rows, labelled = dealt(rows), dealt(labelled)
    for key in KEYS:
        rows = with_rates(rows, labelled, key)
        names = [*names, f"f_rate_{key}", f"f_seen_{key}"]
    rows = stage(rows.select("id", "url", "host", "path", "rule", "by_rule", "label", "weight", *names))
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    train = rows.where("label is not null").withColumn("_at", F.xxhash64("url", "id")).orderBy("_at", "id").limit(max_train_rows)
    train = assembler.transform(stage(train.select(*names, "label", "weight")).coalesce(2)).select("features", "label", "weight")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=7, cacheNodeIds=False, weightCol="weight").fit(train)
    judged = model.transform(assembler.transform(rows))
    verdict = F.coalesce("by_rule", F.when(F.col("prediction") >= 0.5, "block").otherwise("allow"))
    return judged.select(*columns, verdict.alias("verdict"), "by_rule", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
