"""Personal data: detection and information-theoretic sanitisation (native).

Detected values are the protected entities, and so are their telling parts: an address's host, the net of an ip, the issuer
of a card, a phone number but for its last four digits.  Over the whole corpus, the co-occurrence of a term with an entity
estimates how strongly the term reveals it: PMI(t; e) = log2(p(e | t) / p(e)), with document frequencies; the context of an
entity is the whole text.  p(e | t) is smoothed as if the term stood in PRIOR more documents, where the entity is as frequent
as anywhere, so a pair seen once proves little.  What a reader of the term doesn't know yet of the entity is IC(e) - PMI(t; e)
bits, IC(e) = -log2 p(e).  A term that leaves at most REMOVE bits open is removed wherever it stands, in texts without the
entity too; one that leaves at most GENERALISE is replaced by its class.

Defined results: null or empty text has no spans (a null text stays null when sanitised); each row counts as one document,
repeated rows included, and gives one result; null doc_id is carried; an empty table gives an empty result; other columns
are carried by `sanitise` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, pieces, rewrite, spread_join, staged, table

#: Detectors in their fixed order.  Each starts at the head of its run or where the last match ended, so a long run is
#: walked once; possessive repeats keep the stack flat.  Neither changes what matches.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})"
KINDS = ("email", "ip", "card", "phone", "term")
#: A term: a run of letters; shorter ones are function words.
TERM = r"(?<!\p{L})\p{L}{4,}+"
#: Stands for each code point of a mention while terms are looked for; a noncharacter, which texts don't interchange.
MASK = "\uffff"
#: A term of a masked text: one that a mention touches is none.
FREE = rf"(?<![\p{{L}}{MASK}])\p{{L}}{{4,}}+(?!{MASK})"
PRIOR = 2.0
#: Up to so many characters, the revealing words of all rows go to the texts.
BROADCAST = 4 << 20
REMOVE, GENERALISE = 0.85, 1.35

_SPANS = "array<struct<s:int,k:int,e:int,m:string>>"


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: (F.try_to_number(x, F.lit("9")).cast("int")) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _as_kind(rows: Column, kind: int) -> Column:
    return F.transform(rows, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), x["m"].alias("m")))


def spans(text: Column) -> Column:
    """Detected personal data as array<struct<s,k,e,m>> by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    tests = (
        (EMAIL, F.contains(text, F.lit("@")), None),
        (IP, text.rlike(IP), lambda x: x["m"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        (CARD, text.rlike(r"[0-9](?:[\x20-]?+[0-9]){15}"), lambda x: F.when(F.length(digits(x["m"])).between(16, 19), _luhn(digits(x["m"]))).otherwise(F.lit(False))),
        (PHONE, text.rlike(r"\+[0-9]"), lambda x: F.length(digits(x["m"])).between(8, 15)),
    )
    found = []
    for k, (pattern, likely, keep) in enumerate(tests):
        rows = pieces(text, pattern)
        rows = F.filter(rows, keep) if keep else rows
        found.append(F.when(likely, _as_kind(rows, k)).otherwise(F.array().cast(_SPANS)))
    return F.array_sort(F.concat(*found))


def _entities(x: Column) -> Column:
    """Numbers of a mention's entities: its normal form, and the part of it that others share."""
    digits = F.regexp_replace(x["m"], "[^0-9]", "")
    value = F.when(x["k"] == 0, F.lower(x["m"])).when(x["k"] == 1, x["m"]).otherwise(digits)
    part = F.when(x["k"] == 0, F.substring_index(F.lower(x["m"]), "@", -1)).when(x["k"] == 1, F.substring_index(x["m"], ".", 2))
    part = part.when(x["k"] == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 4))
    return F.array(F.xxhash64(x["k"], value), F.xxhash64(x["k"] + len(KINDS), part))


def _masked(text: Column, found: Column) -> Column:
    """text with as many MASKs in the place of each mention."""
    return rewrite(F.coalesce(text, F.lit("")), found, lambda x, begin: F.repeat(F.lit(MASK), x["e"] - begin))


def _mentions(docs: DataFrame, text: str, keep: bool) -> DataFrame:
    """Every row with its mentions and its text, t; keep: and with all its columns."""
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")] if keep else [F.col(text).alias("t")]
    rows = docs.select("doc_id", spans(F.col(text)).alias("spans"), *whole)
    rows = staged(rows.select(F.monotonically_increasing_id().alias("row"), *rows.columns), "pii-mentions")
    return rows.withColumn("t", F.col(f"whole.`{text}`")) if keep else rows


def _words(mentions: DataFrame, of: Column) -> DataFrame:
    """(row, word, term): the distinct forms of words in `of`, and the numbers of their terms."""
    return mentions.select("row", F.explode(F.array_distinct(of)).alias("word")).withColumn("term", F.xxhash64(F.lower("word")))


def disclosure(mentions: DataFrame) -> DataFrame:
    """(ent, term, level): the terms that reveal an entity; level 1 is generalised, 2 removed."""
    n = float(mentions.count())
    ents = mentions.select("row", F.explode(F.array_distinct(F.flatten(F.transform("spans", _entities)))).alias("ent"))
    often = ents.groupBy("ent").agg(F.count(F.lit(1)).alias("n_ent"))

    def open_bits(both: Column, n_term: Column) -> Column:
        """IC - PMI."""
        return -F.log2((both + PRIOR * F.col("n_ent") / n) / (n_term + PRIOR))

    # both <= n_ent and both <= n_term: what can't come to GENERALISE with equality there needs no counting; a little slack for rounding.
    enough = GENERALISE + 1e-9
    often = staged(often.where(open_bits(F.col("n_ent"), F.col("n_ent")) <= enough), "pii-entities")
    ents = staged(spread_join(ents, often, ["ent"], hot_keys(often, ["ent"], "n_ent"), F.col("row")), "pii-places")
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.col("t")), F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(w)))
    terms = mentions.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    most = often.agg(F.max("n_ent")).first()[0] or 0
    terms = staged(terms.where(F.col("n_term") <= (most + PRIOR * most / max(n, 1.0)) * 2**enough), "pii-counts")
    texts = mentions.join(ents.select("row").distinct(), "row", "left_semi")
    here = _words(texts, F.regexp_extract_all(_masked(F.col("t"), F.col("spans")), F.lit(FREE), F.lit(0))).select("row", "term").distinct()
    here = spread_join(here, terms, ["term"], hot_keys(terms, ["term"], "n_term"), F.col("row"))
    pairs = ents.join(here, "row").where(open_bits(F.col("n_ent"), F.col("n_term")) <= enough)
    pairs = pairs.groupBy("ent", "term", "n_ent", "n_term").agg(F.count(F.lit(1)).alias("both"))
    left = open_bits(F.col("both"), F.greatest("n_term", "both"))
    return pairs.select("ent", "term", F.when(left <= REMOVE, 2).when(left <= GENERALISE, 1).alias("level")).where("level is not null")


def _revealing(mentions: DataFrame) -> DataFrame:
    """row -> more: the spans of revealing terms in each row, as array<struct<s,k,e,m>>; m is the replacement."""
    levels = staged(disclosure(mentions).groupBy("term").agg(F.max("level").alias("level")), "pii-terms")
    masked = _masked(F.col("t"), F.col("spans"))
    hits = _words(mentions, F.regexp_extract_all(masked, F.lit(FREE), F.lit(0))).join(levels, "term")
    hits = staged(hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "level"))).alias("hits")), "pii-hits")
    held = hits.agg(F.sum(F.length(F.array_join(F.map_keys("hits"), "    ")) + 32)).first()[0] or 0
    hits = F.broadcast(hits) if held <= BROADCAST else hits  # beyond that, texts go to their hits
    # Words are letters only, so they are patterns of themselves.
    pattern = F.concat(F.lit(rf"(?<![\p{{L}}{MASK}])(?:"), F.array_join(F.map_keys("hits"), "|"), F.lit(rf")(?![\p{{L}}{MASK}])"))
    rows = mentions.select("row", masked.alias("t")).join(hits, "row").withColumn("pattern", pattern)
    new = lambda x: F.when(F.element_at("hits", x["m"]) == 2, "").otherwise("[TERM]")
    more = F.transform(pieces(F.col("t"), F.col("pattern")), lambda x: F.struct(x["s"].alias("s"), F.lit(4).alias("k"), x["e"].alias("e"), new(x).alias("m")))
    return rows.select("row", more.alias("more"))


def _list(rows: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    by_kind = F.array_sort(F.transform(rows, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.concat_ws(",", F.array_distinct(F.transform(by_kind, line)))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document row: counts and digest of the detected spans, and all spans with the revealing terms."""
    mentions = _mentions(docs, text, keep=False)
    all_ = mentions.select("row", "doc_id", "spans").join(_revealing(mentions), "row", "left")
    n = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return all_.select(
        "doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"),
        F.sha2(_list(F.col("spans")), 256).alias("base_sha256"),
        _list(F.concat("spans", F.coalesce("more", F.array().cast(_SPANS)))).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """All documents with their columns; personal data replaced by its kind in brackets, revealing terms generalised or removed."""
    mentions = _mentions(docs, text, keep=True)
    rows = mentions.select("row", "spans", "whole").join(_revealing(mentions.select("row", "spans", "t")), "row", "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.element_at(names, x["k"] + 1).alias("m")))
    new = rewrite(F.col(f"whole.`{text}`"), F.array_sort(F.concat(base, F.coalesce("more", F.array().cast(_SPANS)))))
    return rows.select(F.col("whole").withField(f"`{text}`", new).alias("whole")).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
