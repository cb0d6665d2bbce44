"""Secret scans over a content-addressed ledger of blobs.

Every historical version of every path is a row (path, text).  A text's blob
id is its SHA-256, so a blob that many paths or versions share is one blob.
The ledger is two Parquet tables in a shared folder: the (blob, rule version)
pairs already scanned, and the findings.  A scan

1. hashes every version and takes the pairs that the ledger lacks, naming one
   version that holds each such blob,
2. fetches the text of those versions only and applies the rules,
3. appends findings, then pairs (a scan that dies in between repeats the
   pairs; findings are de-duplicated on reading),
4. joins findings back to all paths that hold the blob.

Positions are code points: a text is split at a rule's matches, and the
lengths of what lies between and of the matches add up to starts and ends, by
a running sum over a text's matches.
Everything is DataFrame operations and Column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausefold.llm.common import shared_folder


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches (Java syntax);
    ``anchor`` is a cheaper pattern that every text with a match contains.
    Matches whose ``group`` has fewer than ``least`` code points are dropped
    after matching.  A changed rule needs a new ``version``."""

    kind: str
    version: int
    pattern: str
    anchor: str
    group: int = 0
    least: int = 1


# The three base patterns, then those of this method.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"(?i:passw|secret|token|api_?key)", group=2, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA", least=20),
    Rule("hex", 1, r"[0-9a-f]+", r"[0-9a-f]{24}", least=24),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", r"PRIVATE KEY-----"),
    Rule("forge_token", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", r"gh[opsur]_"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-"),
    # these two begin where a run of their characters begins and take it whole,
    # so a long run is read once and not from each of its places
    Rule("web_token", 2, r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*eyJ[A-Za-z0-9_-]{8})[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", r"\.eyJ"),
    Rule("url_login", 2, r"(?<![a-z0-9+.-])(?=[0-9+.-]*+[a-z])[a-z0-9+.-]++://[^\s/:@]++:[^\s/:@]++@", r"://[^\s/:@]++:[^\s/:@]++@"),
)


def _steps(text: Column, rule: Rule) -> Column:
    """array<struct<kind, gap, n, judged, least>> of a rule's matches in order:
    the code points since the match before, its length, and that of the group
    that is judged."""
    # a maximal run of at least n is found by {n,} as by + and a filter; it
    # only keeps the many short runs from being listed
    pattern, least = rule.pattern, rule.least
    if rule.kind == "hex":
        pattern = f"[0-9a-f]{{{least},}}"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s).cast("long"))
    lengths = F.zip_with(whole, judged, lambda w, j: F.struct(F.length(w).cast("long").alias("n"), F.length(j).alias("judged")))
    steps = F.zip_with(gaps, lengths, lambda g, m: F.struct(
        F.lit(rule.kind).alias("kind"), g.alias("gap"), m["n"].alias("n"), m["judged"].alias("judged"), F.lit(least).alias("least")))
    # the last gap has no match behind it: its n is null and it is left out
    matched = F.filter(steps, lambda x: x["n"].isNotNull())
    return F.when(text.rlike(rule.anchor), matched).otherwise(F.array().cast("array<struct<kind:string,gap:bigint,n:bigint,judged:int,least:int>>"))


class BlobLedger:
    """The two tables of a ledger in ``folder``; a new folder is an empty
    ledger.  Any Spark path will do."""

    PAIRS = "blob string, kind string, version int"
    FINDINGS = "blob string, kind string, version int, start bigint, end bigint"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        for name, schema in (("pairs", self.PAIRS), ("findings", self.FINDINGS)):
            # an append of no rows makes the table exist
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/{name}")

    def pairs(self) -> DataFrame:
        return self.spark.read.schema(self.PAIRS).parquet(f"{self.folder}/pairs")

    def findings(self) -> DataFrame:
        return self.spark.read.schema(self.FINDINGS).parquet(f"{self.folder}/findings").distinct()

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what the ledger lacks of ``versions`` (path, text) and return
        (path, blob) of all of them.

        Null texts are empty texts.  Repeated rows and shared blobs are
        scanned once.  The blob of the most common text may be in any number
        of rows: only its id and one path are ever grouped.
        """
        text = F.coalesce(F.col("text"), F.lit(""))
        hashed = versions.select("path", F.sha2(text, 256).alias("blob"))
        wanted = self.spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
        known = self.pairs().join(F.broadcast(wanted), ["kind", "version"]).groupBy("blob").agg(F.collect_set("kind").alias("seen"))
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        todo = (hashed.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("n"), "path")).alias("holder"))
                .join(known, "blob", "left")
                .select("blob", F.col("holder.path").alias("held_by"), F.array_except(kinds, F.coalesce("seen", F.array().cast("array<string>"))).alias("kinds"))
                .where(F.size("kinds") > 0))
        # text stays with its version until it is known to be needed
        texts = versions.select(F.col("path").alias("held_by"), text.alias("text")).withColumn("blob", F.sha2("text", 256))
        fetched = texts.join(todo, texts["held_by"].eqNullSafe(todo["held_by"]) & (texts["blob"] == todo["blob"])).select(todo["blob"], "kinds", "text")
        each = [F.when(F.array_contains("kinds", r.kind), _steps(F.col("text"), r)) for r in rules]
        number = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
        steps = F.flatten(F.filter(F.array(*each), lambda s: s.isNotNull()))
        # lengths add up to places, match by match; only matches are shuffled
        rows = fetched.select("blob", F.posexplode(steps).alias("at", "s")).select("blob", "at", "s.*")
        so_far = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # repeated rows hold a blob together: one of their lists counts
        rows = rows.repartition("blob", "kind").dropDuplicates(["blob", "kind", "at"])
        placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(so_far)).where(F.col("judged") >= F.col("least"))
        found = placed.select("blob", "kind", number[F.col("kind")].cast("int").alias("version"), (F.col("end") - F.col("n")).alias("start"), "end")
        found.write.mode("append").parquet(f"{self.folder}/findings")
        done = todo.select("blob", F.explode("kinds").alias("kind")).select("blob", "kind", number[F.col("kind")].cast("int").alias("version"))
        done.write.mode("append").parquet(f"{self.folder}/pairs")
        return hashed

    def report(self, hashed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """One row per row of ``hashed`` (path, blob) with ``spans``: its
        findings by start, then by the rules' order."""
        wanted = self.spark.createDataFrame([(r.kind, r.version, i) for i, r in enumerate(rules)], "kind string, version int, rule int")
        own = self.findings().join(F.broadcast(wanted), ["kind", "version"])
        by_blob = own.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rule", "end", "kind"))).alias("spans"))
        none = F.array().cast("array<struct<start:bigint,rule:int,end:bigint,kind:string>>")
        return hashed.join(by_blob, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every
    document; without a ledger, a new one in the shared folder.

    A null text is an empty one and has no spans.  Repeated rows are returned
    one by one; an empty table gives no rows; other columns play no part."""
    ledger = ledger or BlobLedger(docs.sparkSession, shared_folder(docs.sparkSession, "blob-ledger"))
    hashed = ledger.scan(docs.select(F.col("doc_id").alias("path"), "text"))
    found = ledger.report(hashed)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("path").alias("doc_id"), *[count(k) for k in BASE_KINDS], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
