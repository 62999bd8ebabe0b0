"""Secret scan by multipart credential linking (native).

Three base detectors find strong spans.  Weak parts - labelled identifiers, mail addresses, unlabelled high-entropy strings,
URLs, ip addresses - mean nothing alone: an interval join pairs each with the nearest complementary part within SCOPE code points of the same document, and
only linked parts are reported.  The join is a sort-merge sweep over each document's parts (the nearest part of a class
before and after), so a document with many parts costs their sort, not their square.

Defined results: null or empty text has no spans; a repeated row or doc_id is scanned by itself, one result per row; null
doc_id is carried; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bind, pieces, table
from .pii import EMAIL, IP

#: Strong detectors in their fixed order: kind, pattern (possessive where that can't change a match), part class.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
#: Weak parts: labelled identifiers, unlabelled base64-like strings of 24 or more code points, URLs; and mail and ip addresses.
WEAK_ID = r"""(?i:client_?id|user(?:name)?|login|account|access_?id)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9._@-]{3,}+"""
WEAK_KEY = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])[A-Za-z0-9+/_=-]{24,}+"
ENDPOINT = r"(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{4,}+"
KINDS = ("assign", "access", "hex", "weak_id", "weak_key", "endpoint", "mail", "address")
#: The kinds of each part of a credential.
IDENTIFIERS, SECRETS, ENDPOINTS = (1, 3, 6), (0, 2, 4), (5, 7)
#: Largest gap, in code points, between the parts of one credential.
SCOPE = 200

_PART = "array<struct<s:int,k:int,e:int>>"


def _found(text: Column, pattern: str, kind: int, likely: Column, keep=None) -> Column:
    """Parts of one kind; the positions are worked out only where the pattern can match at all."""
    spans = pieces(text, pattern)
    if keep is not None:
        spans = F.filter(spans, keep)
    return F.when(likely, F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))).otherwise(F.array().cast(_PART))


def parts(text: Column) -> Column:
    """All strong and weak parts of a text as one array of (start, kind, end), by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    found = [
        _found(text, ASSIGN, 0, text.rlike(ASSIGN), lambda x: F.length(F.regexp_replace(x["m"], ASSIGN_HEAD, "")) >= 8),
        _found(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))),
        _found(text, HEX, 2, text.rlike(HEX)),
        _found(text, WEAK_ID, 3, text.rlike(WEAK_ID)),
        _found(text, WEAK_KEY, 4, text.rlike(WEAK_KEY)),
        _found(text, ENDPOINT, 5, F.contains(text, F.lit("://"))),
        _found(text, EMAIL, 6, F.contains(text, F.lit("@"))),
        _found(text, IP, 7, text.rlike(IP)),
    ]
    return F.array_sort(F.concat(*found))


def _once(rows: Column) -> Column:
    """Sorted and each once; array_distinct would compare all pairs of structs."""
    return bind(F.array_sort(rows), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def _list(rows: Column) -> Column:
    """kind:start:end, comma-joined, of an array of (start, kind, end)."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(rows, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def link(docs: DataFrame, scope: int = SCOPE, text: str = "text") -> DataFrame:
    """One row per document row: doc_id, base (strong spans) and found (those and the linked weak ones), by start, then kind.

    Identifiers (access, weak_id, mail) and endpoints (endpoint, address) need a secret (assign, hex, weak_key); secrets
    need an identifier or an endpoint.  Overlapping parts don't complement each other.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", parts(F.col(text)).alias("parts"))
    one = rows.select("row", "doc_id", F.explode_outer("parts").alias("p"))
    # Each part opens at its start and closes at its end; sweeping over both gives the nearest neighbours on either side.
    both = F.array(F.struct(F.col("p.s").alias("at"), F.lit(1).alias("opens")), F.struct(F.col("p.e").alias("at"), F.lit(0).alias("opens")))
    ends = one.select("row", "doc_id", "p", F.explode(both).alias("x")).select("row", "doc_id", "p", "x.*")
    forth = Window.partitionBy("row").orderBy("at", "opens").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("row").orderBy(F.desc("at"), F.desc("opens")).rowsBetween(Window.unboundedPreceding, 0)
    classes = {"id": F.col("p.k").isin(*IDENTIFIERS), "key": F.col("p.k").isin(*SECRETS), "end": F.col("p.k").isin(*ENDPOINTS)}
    for name, cls in classes.items():
        ends = ends.withColumn(f"{name}_before", F.max(F.when(cls & (F.col("opens") == 0), F.col("at"))).over(forth))
    for name, cls in classes.items():
        ends = ends.withColumn(f"{name}_after", F.min(F.when(cls & (F.col("opens") == 1), F.col("at"))).over(back))

    def near(name: str) -> Column:
        gap = F.when(F.col("opens") == 1, F.col("at") - F.col(f"{name}_before")).otherwise(F.col(f"{name}_after") - F.col("at"))
        return F.coalesce(gap <= scope, F.lit(False))

    joined = F.when(classes["key"], near("id") | near("end")).otherwise(near("key"))
    spans = ends.groupBy("row", "doc_id").agg(
        _once(F.collect_list(F.when(F.col("p.k") <= 2, F.col("p")))).alias("base"),
        _once(F.collect_list(F.when((F.col("p.k") <= 2) | joined, F.col("p")))).alias("found"),
    )
    return spans.select("doc_id", "base", "found")


def scan(docs: DataFrame, scope: int = SCOPE, text: str = "text") -> DataFrame:
    """link() with its spans as text and the base spans counted and digested."""
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return link(docs, scope, text).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_list(F.col("base")), 256).alias("base_sha256"), _list(F.col("found")).alias("spans"),
        (F.size("found") - F.size("base")).cast("long").alias("n_linked"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
