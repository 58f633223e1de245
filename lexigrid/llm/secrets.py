"""Secret scans: an incremental ledger of content-addressed blobs.

DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import durable, meet, shared_folder, table

FINDINGS = "array<struct<start: bigint, kind_no: int, kind: string, end: bigint>>"
LEDGER = f"blob string, rules array<string>, findings {FINDINGS}"


@dataclass(frozen=True)
class SecretRule:
    """Matches of the pattern, leftmost and not overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        """What the ledger knows the rule by: kind, version and what it matches, so that no changed rule passes for an old one."""
        matched = hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:16]
        return f"{self.kind}/{self.version}/{matched}"


#: Kinds, patterns and least lengths.
RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12),
    SecretRule("access", r"AKIA[A-Z0-9]+", least=18),
    SecretRule("hex", r"[0-9a-f]{16,}"),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def _spans(text: Column, rule: SecretRule, number: int) -> Column:
    """The rule's findings in a text, with code-point offsets; texts without a match cost one search."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast(FINDINGS)
    matched = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    start = lambda a, m: a["at"] + F.length(m["gap"])
    end = lambda a, m: start(a, m) + F.length(m["whole"])
    found = lambda a, m: F.array(F.struct(start(a, m).alias("start"), F.lit(number).alias("kind_no"), F.lit(rule.kind).alias("kind"), end(a, m).alias("end")))
    walk = F.aggregate(
        matched,
        F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")),
        lambda a, m: F.struct(
            F.coalesce(end(a, m), a["at"]).alias("at"),
            F.when(F.length(m["value"]) >= rule.least, F.concat(a["out"], found(a, m))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.rlike(text, pattern), walk).otherwise(none)


def addresses(versions: DataFrame, text: str = "text") -> DataFrame:
    """versions with blob, the content address: SHA-256 of the whole text (null as empty)."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _names(rules: tuple[SecretRule, ...]) -> Column:
    return F.array(*(F.lit(r.name) for r in rules))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rules, findings) for the pairs of blob and rule version not in the ledger.

    Each distinct text is scanned once whatever the number of its paths and
    versions, and only by rules whose version the ledger does not name for it. A
    row names the rules it was scanned by, findings or not; append the rows to
    the ledger table. Copies meet after map-side aggregation.
    """
    texts = addresses(versions, text).select("blob", F.coalesce(F.col(text), F.lit("")).alias("t")).dropDuplicates(["blob"])
    if ledger is None:
        todo = texts.withColumn("rules", _names(rules))
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = texts.join(seen, "blob", "left").withColumn("rules", F.array_except(_names(rules), F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    none = F.array().cast(FINDINGS)
    found = [F.when(F.array_contains("rules", r.name), _spans(F.col("t"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return todo.select("blob", "rules", F.array_sort(F.concat(*found)).alias("findings"))


def findings_of_paths(versions: DataFrame, ledger: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(key, blob, findings) for each row of versions: what the ledger says of its blob.

    Only what the given versions of the rules found counts, each span once,
    ordered by start, then by the order of the rules. A blob the ledger does not
    know has no findings. Rows of the ledger for one blob are joined together;
    they are as many as it had scans. A blob with very many paths is met by
    broadcast, see ``meet``.
    """
    number = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    version = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.name)))
    current = F.filter("findings", lambda f: F.array_contains("rules", F.try_element_at(version, f["kind"])))
    known = ledger.where(F.size("findings") > 0).select("blob", F.explode(current).alias("f"))
    known = known.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(F.col("f.start"), F.try_element_at(number, F.col("f.kind")).alias("kind_no"), F.col("f.kind"), F.col("f.end")))).alias("found"))
    paths = durable(addresses(versions, text).select(key, "blob"))
    groups = durable(paths.groupBy("blob").agg(F.count("*").alias("n")).join(known, "blob", "left"))
    return meet(paths, groups, "blob").select(key, "blob", F.coalesce("found", F.array().cast(FINDINGS)).alias("findings"))


def ledger_place(spark: SparkSession) -> str:
    """Where the ledger table is: in the shared folder, unless the session names another place."""
    return spark.conf.get("lexigrid.secrets.ledger", None) or f"{shared_folder(spark)}/secret-ledger"


def read_ledger(spark: SparkSession, place: str) -> DataFrame | None:
    """The ledger table, None where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(place)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_versions(versions: DataFrame, place: str, key: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """findings_of_paths by the ledger at ``place``, after a scan of what it has not seen, which is added to it.

    A run that fails leaves the ledger as it was; two at once may scan a blob
    twice, which changes no finding.
    """
    spark = versions.sparkSession
    scan_unseen(versions, read_ledger(spark, place), text, rules).write.mode("append").parquet(place)
    return findings_of_paths(versions, spark.read.schema(LEDGER).parquet(place), key, text, rules)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_versions(docs, ledger_place(spark))
    of = lambda *kinds: F.filter("findings", lambda f: f["kind"].isin(*kinds))
    spell = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(spell(of("assign", "access", "hex")), 256).alias("base_sha256"),
        spell("findings").alias("spans"),
    )


def _oracle() -> str:
    """Places of matches as the running lengths of what lies between and of the matches."""
    scans = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        scans.append(
            f"SELECT doc_id, {i} AS kind_no, '{r.kind}' AS kind, string_split_regex(t, '{p}') AS gaps, "
            f"regexp_extract_all(t, '{p}') AS wholes, regexp_extract_all(t, '{p}', {r.group}) AS vals, {r.least} AS least FROM d WHERE regexp_matches(t, '{p}')"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(scans)}),
e AS (SELECT *, unnest(range(1, len(wholes) + 1)) AS i FROM m),
p AS (
    SELECT doc_id, kind_no, kind, length(vals[i]) >= least AS fits,
           list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x)))
           + coalesce(list_sum(list_transform(list_slice(wholes, 1, i - 1), lambda x: length(x))), 0) AS start, length(wholes[i]) AS size
    FROM e
),
s AS (SELECT doc_id, kind_no, kind, cast(start AS bigint) AS start, cast(start + size AS bigint) AS stop FROM p WHERE fits),
g AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind IN ('assign', 'access', 'hex')) AS base,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS spans
    FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle()
