"""Label audits: intervals, agreement, shares by group, and file digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The verdicts, and the normal quantile of a 95 percent interval.
VERDICTS = ("label_correct", "ambiguous", "label_wrong", "convention")
PROBLEMS = ("ambiguous", "label_wrong", "convention")
Z = 1.959963984540054


def wilson(k: Column, n: Column) -> Column:
    """The 95 percent score interval of k of n; [0, 0] for none."""
    p = k / n
    middle = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    lo, hi = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.when(n > 0, F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")))


def kappa(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Observed agreement corrected for chance; null where chance agreement is complete."""
    cells = rows.groupBy(*by, a, b).agg(F.count("*").alias("c"))
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("same"))
    one = cells.groupBy(*by, F.col(a).alias("v")).agg(F.sum("c").alias("na"))
    two = cells.groupBy(*by, F.col(b).alias("v")).agg(F.sum("c").alias("nb"))
    chance = one.join(two, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("both"))
    j = total.join(chance, by, "left")
    pe = F.coalesce("both", F.lit(0)) / (F.col("n") * F.col("n"))
    po = F.col("same") / F.col("n")
    return j.select(*by, "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def in_groups(rows: DataFrame) -> DataFrame:
    """One row for each group that a row belongs to (``a+b`` belongs to both), and one for ``all``."""
    return rows.withColumn("group", F.explode(F.array_append(F.split("group", r"\+"), "all")))


def shares(rows: DataFrame, by: list[str], verdict: str) -> DataFrame:
    """Count, share and interval of each verdict and of any problem."""
    problem = F.col(verdict).isin(*PROBLEMS)
    n = F.count("*")
    one = rows.groupBy(*by).agg(n.alias("n"), F.array(*[F.struct(F.lit(v).alias("verdict"), F.sum((F.col(verdict) == v).cast("long")).alias("count")) for v in VERDICTS],
                                                      F.struct(F.lit("any_label_problem").alias("verdict"), F.sum(problem.cast("long")).alias("count"))).alias("v"))
    long = one.select(*by, "n", F.explode("v").alias("v")).select(*by, "n", "v.verdict", "v.count")
    ci = wilson(F.col("count"), F.col("n"))
    return long.select(*by, "n", "verdict", "count", (F.col("count") / F.col("n")).alias("share"), ci["lo"].alias("lo"), ci["hi"].alias("hi"))


def disagreements(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(F.col(a) != F.col(b))


def audit_sheet(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of several samples, memberships of a row joined by ``+``."""
    out = None
    for name, rows in parts.items():
        one = rows.select(key, F.lit(name).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("part")), "+").alias("group"))


def file_digests(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """The sha256 of each file under a folder, named by its path below it, read by Spark's own readers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path)
    below = F.element_at(F.split("path", F.lit("/" + path.rstrip("/").split("/")[-1] + "/")), -1)
    return files.select(below.alias("name"), F.sha2("content", 256).alias("sha256"), "length")


def digest_mismatches(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded digests that have no file or another digest."""
    f = found.select("name", F.col("sha256").alias("now"))
    return recorded.join(f, "name", "left").where(F.col("now").isNull() | (F.col("now") != F.col("sha256"))).select("name", "sha256", "now")


def _row_digest(columns: list[str]) -> Column:
    """128 bits of a row: of each column's name and value, nulls apart from every value."""
    each = [F.md5(F.concat(F.lit(c), F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))).cast("binary")) for c in columns]
    return F.md5(F.concat(*each).cast("binary"))


_SUMS = ["n", "sum_a", "sum_b", "xor_a", "xor_b"]


def _digested(sums: DataFrame) -> DataFrame:
    return sums.withColumn("digest", F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in _SUMS]).cast("binary")))


def table_digests(df: DataFrame, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """One digest of the rows of each part of a table, which neither their order nor their layout changes.

    Each row is hashed where it is; sums and exclusive ors of both halves of the hashes, and the count, are
    aggregated partially and combine in any order. A changed, missing or repeated row changes the sums.
    """
    h = df.select(*(by or []), _row_digest(columns or sorted(df.columns)).alias("h"))
    a, b = (F.conv(F.substring("h", i, 15), 16, 10).cast("long") for i in (1, 17))
    whole = lambda x: F.sum(x.cast("decimal(20,0)")).cast("decimal(38,0)")
    return _digested(h.groupBy(*(by or [])).agg(F.count("*").alias("n"), whole(a).alias("sum_a"), whole(b).alias("sum_b"), F.bit_xor(a).alias("xor_a"), F.bit_xor(b).alias("xor_b")))


def combined_digest(parts: DataFrame) -> DataFrame:
    """The digest of the whole from those of its parts, without another pass over the rows."""
    return _digested(parts.agg(F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in _SUMS[1:3]], *[F.bit_xor(c).alias(c) for c in _SUMS[3:]]))


def pin_mismatches(found: DataFrame, pinned: DataFrame, by: list[str]) -> DataFrame:
    """Parts whose digest is not the pinned one, parts that are gone, and parts that were not pinned."""
    a, b = found.select(*by, F.col("digest").alias("now")), pinned.select(*by, F.col("digest").alias("pinned"))
    return a.join(b, by, "full_outer").where(~F.col("now").eqNullSafe(F.col("pinned")))
