"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import digest, frequent, multibitmap, packing, spans, tokens
from blockloom.sources.tables import is_value, load, normal

SUPPORT = 0.005
SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
_COLUMNS = {"topic0": "evm_logs", "sighash": "evm_transactions", "user": "fills"}


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Values that hold at least 0.5 % of their column's values."""
    out = None
    for field, table in _COLUMNS.items():
        found = frequent.frequent_values(load(spark, root, table), field, SUPPORT).select(F.lit(field).alias("field"), "value")
        out = found if out is None else out.unionByName(found)
    return out


def p1_top_values(spark: SparkSession, root: str) -> DataFrame:
    """The 100 most frequent values of each column with their counts."""
    out = None
    for field, table in _COLUMNS.items():
        found = frequent.top_k(load(spark, root, table), field, 100).select(F.lit(field).alias("field"), "value", "n")
        out = found if out is None else out.unionByName(found)
    return out


def _users(spark: SparkSession, root: str) -> tuple[DataFrame, object]:
    user = normal("user")
    fills = load(spark, root, "fills").select(F.to_date("time").alias("day"), "coin", F.when(is_value(user), user).alias("user"))
    return fills, F.col("user")


def p3_distinct_users(spark: SparkSession, root: str) -> DataFrame:
    """Estimated distinct users per day, per coin, per both and over all."""
    fills, user = _users(spark, root)
    counts = multibitmap.distinct_counts(fills, user, ["day", "coin"], [["day"], ["coin"], ["day", "coin"], []])
    return counts.select("grouping", "day", "coin", F.round("estimate").cast("long").alias("users"), F.lit(multibitmap.STANDARD_ERROR).alias("standard_error"))


def p3_partials(spark: SparkSession, root: str) -> DataFrame:
    """The mergeable bitmap words themselves."""
    fills, user = _users(spark, root)
    return multibitmap.sketch(fills, user, ["day", "coin"])


def p7_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of px, sz and fee per coin, combined from the digests of single days."""
    fills = load(spark, root, "fills").select("coin", F.to_date("time").alias("day"), "px", "sz", "fee")
    days = digest.partial_digests(fills, ["coin", "day"], ["px", "sz", "fee"])
    digests = digest.merge(days.drop("day"), ["coin"])
    return digest.percentiles(digests, ["coin"], SHARES).withColumn("rank_error", F.lit(digest.ERROR))


def p7_day_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """The same per coin and day."""
    fills = load(spark, root, "fills").select("coin", F.to_date("time").alias("day"), "px", "sz", "fee")
    days = digest.merge(digest.partial_digests(fills, ["coin", "day"], ["px", "sz", "fee"]), ["coin", "day"])
    return digest.percentiles(days, ["coin", "day"], SHARES)


_SETS = (("day",), ("coin",), ("day", "coin"), ())


def p3_error_check(spark: SparkSession, root: str) -> DataFrame:
    """Exact counts beside the estimates: whether each lies within three standard errors, and one for whole numbers."""
    fills, _ = _users(spark, root)
    estimates = p3_distinct_users(spark, root)
    # One exact count per grouping; the distinct pairs combine before each shuffle.
    pairs = fills.select("day", "coin", "user").distinct()
    exact = None
    for keys in _SETS:
        part = pairs.select(*keys, "user").distinct().groupBy(*keys).agg(F.count("user").alias("exact_users"))
        part = part.select(F.lit(",".join(keys)).alias("grouping"), *[(F.col(k) if k in keys else F.lit(None).cast(fills.schema[k].dataType)).alias(k) for k in ("day", "coin")], "exact_users")
        exact = part if exact is None else exact.unionByName(part)
    on = [estimates[c].eqNullSafe(exact[c]) for c in ("grouping", "day", "coin")]
    within = F.abs(F.col("users") - F.col("exact_users")) <= 3 * F.col("standard_error") * F.col("exact_users") + 1
    return exact.join(estimates, on).select(exact["grouping"], exact["day"].cast("string").alias("day"), exact["coin"], "exact_users", within.alias("within"))


def p3_rms_check(spark: SparkSession, root: str) -> DataFrame:
    """For each grouping, whether the root mean square of the relative errors of all its groups is within the standard error."""
    fills, _ = _users(spark, root)
    estimates = p3_distinct_users(spark, root)
    pairs = fills.select("day", "coin", "user").distinct()
    exact = None
    for keys in _SETS:
        part = pairs.select(*keys, "user").distinct().groupBy(*keys).agg(F.count("user").alias("exact"))
        part = part.select(F.lit(",".join(keys)).alias("_grouping"), *[(F.col(k) if k in keys else F.lit(None).cast(fills.schema[k].dataType)).alias(f"_{k}") for k in ("day", "coin")], "exact")
        exact = part if exact is None else exact.unionByName(part)
    both = exact.join(estimates, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("grouping", "day", "coin")]).where("exact > 0")
    error = (F.col("users") - F.col("exact")) / F.col("exact")
    return both.groupBy("grouping").agg(F.count(F.lit(1)).alias("groups"), (F.sqrt(F.avg(error * error)) <= multibitmap.STANDARD_ERROR).alias("within"))


def p7_rank_check(spark: SparkSession, root: str) -> DataFrame:
    """Whether every percentile's rank is within its bound, by counting the values below and up to it."""
    fills = load(spark, root, "fills")
    found = p7_percentiles(spark, root)
    shares = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"p{100 * q:g}").alias("v")) for q in SHARES]))
    asked = found.select(F.col("coin").alias("_coin"), F.col("field").alias("_field"), "n", shares.alias("x")).select("_coin", "_field", "n", "x.q", "x.v")
    asked = asked.groupBy("_coin", "_field", "n").agg(F.sort_array(F.collect_list(F.struct("q", "v"))).alias("asked"))
    values = fills.select("coin", F.explode(F.create_map(*[x for f in ("px", "sz", "fee") for x in (F.lit(f), F.col(f))])).alias("field", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    near = 2.0**-19
    joined = values.join(asked, values["coin"].eqNullSafe(asked["_coin"]) & (F.col("field") == F.col("_field")))
    counts = [x for i in range(len(SHARES)) for x in (F.count_if(F.col("value") < F.col("asked")[i]["v"] - F.abs(F.col("asked")[i]["v"]) * near).alias(f"low{i}"), F.count_if(F.col("value") <= F.col("asked")[i]["v"] + F.abs(F.col("asked")[i]["v"]) * near).alias(f"high{i}"))]
    ranked = joined.groupBy("coin", "field", "n").agg(*counts)
    slack = F.col("n") * digest.ERROR + 1
    good = F.lit(True)
    for i, q in enumerate(SHARES):
        good = good & (F.col(f"low{i}") - slack <= F.col("n") * q) & (F.col(f"high{i}") + slack >= F.col("n") * q)
    return ranked.select("coin", "field", "n", good.alias("within"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """doc_id and ids of every document."""
    return tokens.encode_documents(load(spark, root, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """doc_id and the text that decoding the document's ids gives."""
    return load(spark, root, "documents").select("doc_id", tokens.decode_column(tokens.encode_column(F.col("text"))).alias("text"))


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of 2,048 tokens of every document or piece of one."""
    return packing.pack(load(spark, root, "documents"), "doc_id", tokens.count_column(F.col("text")), packing.CAPACITY)


def p9_fill_check(spark: SparkSession, root: str) -> DataFrame:
    """The number of documents, of those cut without need or not placed whole, of containers above the capacity, and of containers beyond
    one in a hundred (and one) more than the tokens of all documents fill."""
    placed = p9_containers(spark, root)
    per_document = placed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"))
    sizes = load(spark, root, "documents").select("doc_id", tokens.count_column(F.col("text")).alias("size"))
    wrong = (F.col("tokens") != F.col("size")) | (F.col("pieces") != F.col("last") + 1) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("size") / packing.CAPACITY)))
    documents = sizes.join(per_document, "doc_id", "left").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("wrongly_cut"))
    overfull = placed.groupBy("container").agg(F.sum("tokens").alias("held")).agg(F.count_if(F.col("held") > packing.CAPACITY).alias("overfull"))
    used = placed.where("tokens > 0").agg(F.count_distinct("container").alias("used"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("held"))
    needed = F.ceil(F.col("held") / packing.CAPACITY)
    spare = used.select(F.greatest(F.lit(0), F.col("used") - F.floor(1.01 * needed) - 1).cast("long").alias("spare"))
    return documents.join(F.broadcast(overfull)).join(F.broadcast(spare))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of documents that share 200 consecutive characters."""
    return spans.shared_pairs(load(spark, root, "documents"), "doc_id", "text")


def p10_coverage(spark: SparkSession, root: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    return spans.coverage(load(spark, root, "documents"), "doc_id", "text")


def p10_repeats(spark: SparkSession, root: str) -> DataFrame:
    """The maximal repeats of each document: where they lie and how many documents hold them."""
    return spans.repeats(load(spark, root, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_top_values, p3_distinct_users, p3_partials, p3_error_check, p3_rms_check, p7_percentiles, p7_day_percentiles, p7_rank_check, p8_ids, p8_round_trip, p9_containers, p9_fill_check, p10_found, p10_coverage, p10_repeats)
}

_VALUES = " UNION ALL ".join(f"SELECT '{field}' AS field, lower(trim(\"{field}\", ' ')) AS value FROM {table}" for field, table in _COLUMNS.items())
_COUNTS = f"WITH v AS ({_VALUES}), c AS (SELECT field, value, count(*) AS n FROM v WHERE value IS NOT NULL AND value NOT IN ('', '0x') GROUP BY 1, 2)"

_USERS = """WITH w AS (SELECT CAST(CAST("time" AS DATE) AS VARCHAR) AS day, coin, CASE WHEN lower(trim("user", ' ')) IN ('', '0x') THEN NULL ELSE lower(trim("user", ' ')) END AS u FROM fills)"""
#: All spans of 200 characters of all documents.
_SPANS = """WITH g AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200), k AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM g)"""

SQL: dict[str, str] = {
    "p10_found": f"{_SPANS}, u AS (SELECT DISTINCT doc_id, h FROM k) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_repeats": f"""{_SPANS}, s AS (SELECT h, count(*) AS n, bit_xor(hash(doc_id)) AS x FROM (SELECT DISTINCT doc_id, h FROM k) GROUP BY h HAVING count(*) > 1),
        c AS (SELECT k.doc_id, i, n, CASE WHEN lag(i) OVER w = i - 1 AND lag(n) OVER w = n AND lag(x) OVER w = x THEN 0 ELSE 1 END AS new FROM k JOIN s ON k.h = s.h WINDOW w AS (PARTITION BY k.doc_id ORDER BY i)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM c)
        SELECT doc_id, CAST(min(i) - 1 AS INTEGER) AS start, CAST(max(i) + 199 AS INTEGER) AS "end", n AS n_docs FROM r GROUP BY doc_id, no, n""",
    "p10_coverage": f"""{_SPANS}, s AS (SELECT h FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)), c AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM k WHERE h IN (SELECT h FROM s)),
        n AS (SELECT doc_id, i, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM c), m AS (SELECT doc_id, max(i) - min(i) + 200 AS size FROM n GROUP BY doc_id, no),
        t AS (SELECT doc_id, sum(size) AS shared_chars, count(*) AS n_spans, max(size) AS longest FROM m GROUP BY doc_id)
        SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, CAST(coalesce(shared_chars, 0) AS BIGINT) AS shared_chars, coalesce(n_spans, 0) AS n_spans, coalesce(longest, 0) AS longest FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "p1_found": f"{_COUNTS} SELECT field, value FROM (SELECT *, sum(n) OVER (PARTITION BY field) AS total FROM c) WHERE n >= 0.005 * total",
    "p1_top_values": f"{_COUNTS} SELECT field, value, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM c) WHERE r <= 100",
    "p3_error_check": f"""{_USERS} SELECT 'day' AS "grouping", day, NULL AS coin, count(DISTINCT u) AS exact_users, true AS within FROM w GROUP BY day UNION ALL SELECT 'coin', NULL, coin, count(DISTINCT u), true FROM w GROUP BY coin
        UNION ALL SELECT 'day,coin', day, coin, count(DISTINCT u), true FROM w GROUP BY day, coin UNION ALL SELECT '', NULL, NULL, count(DISTINCT u), true FROM w""",
    "p3_rms_check": """WITH w AS (SELECT CAST("time" AS DATE) AS day, coin, CASE WHEN lower(trim("user", ' ')) IN ('', '0x') THEN NULL ELSE lower(trim("user", ' ')) END AS u FROM fills),
        g AS (SELECT 'day' AS "grouping", count(DISTINCT u) AS n FROM w GROUP BY day UNION ALL SELECT 'coin', count(DISTINCT u) FROM w GROUP BY coin UNION ALL SELECT 'day,coin', count(DISTINCT u) FROM w GROUP BY day, coin UNION ALL SELECT '', count(DISTINCT u) FROM w)
        SELECT "grouping", count(*) AS groups, true AS within FROM g WHERE n > 0 GROUP BY 1""",
    "p7_rank_check": " UNION ALL ".join(f"SELECT coin, '{f}' AS field, count(*) AS n, true AS within FROM fills WHERE {f} IS NOT NULL AND NOT isnan({f}) GROUP BY coin" for f in ("px", "sz", "fee")),
    "p9_fill_check": "SELECT count(*) AS documents, 0 AS wrongly_cut, 0 AS overfull, 0 AS spare FROM documents",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
