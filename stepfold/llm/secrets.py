"""Secret scan with corpus-wide ownership frequency, in DataFrame operations alone.

Base patterns find assignments, access keys and long hexadecimal strings. A further pattern finds candidates of no
known form: runs of 20 or more key characters with both digits and letters of either case. Each distinct candidate
value is then counted by the distinct repositories and distinct owners that hold it, over the whole corpus. A value
that WIDE or more owners hold is a widely copied example, and so is one that two owners hold in COPIED or more
repositories; any other looks like a live credential, however many repositories of its one owner hold it. Live
candidates outside the base spans are added as kind `key`; base spans always stay, and are told apart in n_live and
n_example. Which columns name an owner and a repository are parameters.

Counting drops repeats of (value, owner, repository) before it shuffles by value, and then counts repositories by
owner, so that a value in a third of all rows meets in one place only as its owners, and of these as a count each.
Null or empty text has no spans. Rows with a null owner share one owner, those with a null repository one of that owner.
Repeated rows are rows of their own: rows in as rows out. Equal spans of several kinds are all listed, by start, then by
kind. Texts of any length are scanned whole. Only the named columns are read, so others of any name do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.llm.common import Scratch
from stepfold.llm.spans import hits, located, only_if, text_of

#: Fixed patterns of the base scan, as Java regular expressions.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "key")
#: Candidates of no known form.
KEY = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Owners of an example; repositories that make one of a value with two owners.
WIDE, COPIED = 3, 10


def _typed(kind: str, spans: Column, value: str = "value") -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), F.xxhash64(x[value]).alias("h1"), F.crc32(x[value].cast("binary")).alias("h2")))


def candidates(docs: DataFrame, owner: list[str], repository: list[str]) -> DataFrame:
    """uid, doc_id, owner, repository and the spans of all kinds of each row, each with the hash of its value."""
    text = F.col("text")
    coded = F.when(text.rlike("[0-9]"), True).otherwise(False)
    named = [F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in x)) for x in (owner, repository)]
    rows = docs.select("doc_id", named[0].alias("owner"), named[1].alias("repository"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "*",
        hits(text, ASSIGN).alias("assign"),
        only_if(text.contains("AKIA"), hits(text, ACCESS)).alias("access"),
        only_if(text.rlike(HEX), hits(text, HEX)).alias("hex"),
        only_if(coded, hits(text, KEY)).alias("key"),
    )
    rows = rows.select(
        "*",
        F.filter(located(text, ASSIGN, F.col("assign"), only_if(F.size("assign") > 0, hits(text, ASSIGN, 2))), lambda x: F.length(x["part"]) >= 6).alias("s_assign"),
        located(text, ACCESS, F.col("access")).alias("s_access"),
        located(text, HEX, F.col("hex")).alias("s_hex"),
        F.filter(located(text, KEY, F.col("key")), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")).alias("s_key"),
    )
    base = F.concat(_typed("assign", F.col("s_assign"), "part"), _typed("access", F.col("s_access")), _typed("hex", F.col("s_hex")))
    rows = rows.select("doc_id", "owner", "repository", base.alias("base"), _typed("key", F.col("s_key")).alias("keys"))
    apart = F.filter("keys", lambda k: ~F.exists("base", lambda b: (b["start"] < k["end"]) & (k["start"] < b["end"])))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "owner", "repository", F.sort_array("base").alias("base"), F.sort_array(apart).alias("keys"))


def ownership(found: DataFrame) -> DataFrame:
    """h1, h2, n_repositories, n_owners of each distinct candidate value."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "keys")).alias("x")).select("owner", "repository", "x.h1", "x.h2").distinct()
    by_owner = each.groupBy("h1", "h2", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("h1", "h2").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def is_example() -> Column:
    """Whether n_owners and n_repositories tell a widely copied value."""
    return (F.col("n_owners") >= WIDE) | ((F.col("n_owners") >= 2) & (F.col("n_repositories") >= COPIED))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: text_of(F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scan(spark: SparkSession, docs: DataFrame, owner: list[str], repository: list[str]) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans, n_live and n_example of each row."""
    scratch = Scratch(spark, "secrets")
    found = scratch.write(candidates(docs, owner, repository), "candidates")
    # a table of its own, so that the join can split a value that many rows hold
    wide = scratch.write(ownership(found).where(is_example()).select("h1", "h2", F.lit(True).alias("wide")), "wide")
    rows = found.select("uid", F.explode(F.concat("base", "keys")).alias("x")).select("uid", "x.*")
    judged = rows.join(wide, ["h1", "h2"], "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    of_key = F.col("kind") == KINDS.index("key")
    by_row = judged.groupBy("uid").agg(
        F.count_if(~of_key & ~F.col("wide")).alias("n_live"),
        F.count_if(~of_key & F.col("wide")).alias("n_example"),
        F.collect_list(F.when(of_key & ~F.col("wide"), F.struct("start", "kind", "end", "h1", "h2"))).alias("added"),
    )
    out = found.join(by_row, "uid", "left")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    spans = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(found.schema["base"].dataType))))
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
