"""Personal data: fixed patterns, and terms that reveal a protected entity, by co-occurrence in the corpus.

DataFrame functions only. An entity e is a matched value. A term t near it discloses as much of it as their
pointwise mutual information, PMI(e; t) = log(n(e, t) N / (n(e) n(t))), against what there is to disclose,
IC(e) = log(N / n(e)). A share above REMOVE removes the term, one above GENERALISE generalises it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import body, hinted, store
from isohyet.llm.spans import add_matches, outside, ranked, written

KINDS = ["email", "ip", "card", "phone", "term"]
# Equivalent to the stated patterns, with possessive repeats. A run of local-part characters or digits is tried from
# its start only (or from where the match before ended), as all later starts fail alike.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
TERM = r"[\p{L}][\p{L}\p{N}]++"

#: Characters on either side of a mention where terms count as its company.
NEAR = 160
#: Half the squared normal quantile of a one-sided 95% bound: the log-likelihood that a bound gives away.
DOUBT = 1.3528
BISECTIONS = 30
GENERALISE, REMOVE = 0.7, 0.9


def _luhn(digits: Column) -> Column:
    def digit(i: Column) -> Column:
        value = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        double = 2 * value
        return F.when(i % 2 == 0, value).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + digit(i)) % 10 == 0


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    df = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    for name, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        df = add_matches(df, "text", name, pattern)
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    count = lambda x: F.length(digits(x))
    card = lambda x: F.when(count(x).between(14, 19), _luhn(digits(x))).otherwise(False)
    return df.withColumns({
        "ip": F.filter("ip", lambda x: x["value"].rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")),
        "card": F.filter("card", card), "phone": F.filter("phone", lambda x: count(x).between(10, 15)),
    })


def mentions(found: DataFrame) -> DataFrame:
    """One row per base span: its text's row key, entity, and the distinct terms near it."""
    entity = lambda kind: F.transform(
        kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit(f"{kind}:"), F.lower(x["value"])).alias("entity"))
    )
    each = found.withColumn("size", F.length("text")).select("row", "text", "size", F.explode(F.concat(*[entity(k) for k in KINDS[:4]])).alias("x"))
    # One character more on either side tells whether the window cuts a term.
    lo, hi = F.greatest(F.col("x.start") - NEAR - 1, F.lit(0)), F.least(F.col("x.end") + NEAR + 1, F.col("size"))
    each = each.select("row", "size", "x.start", "x.end", "x.entity", lo.alias("lo"), hi.alias("hi"), F.substring(F.col("text"), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("window"))
    each = add_matches(each, "window", "terms", TERM)
    each = each.withColumn("cut", F.when(F.col("lo") > 0, F.length(F.regexp_extract("window", r"^[\p{L}\p{N}]*+", 0))).otherwise(0))
    # Terms cut by the window's edge and those inside the entity do not count.
    inner = lambda t: (t["start"] >= F.col("cut")) & ((t["end"] + F.col("lo") < F.col("hi")) | (F.col("hi") == F.col("size"))) & (
        (t["end"] + F.col("lo") <= F.col("start")) | (t["start"] + F.col("lo") >= F.col("end"))
    )
    return each.select("row", "entity", F.array_distinct(F.transform(F.filter("terms", inner), lambda t: F.lower(t["value"]))).alias("terms"))


def log_bound(hits: Column, tries: Column) -> Column:
    """Log of the likelihood-ratio lower bound of a share of `hits` in `tries`, both at least 1.

    -DOUBT / tries where all hit; else the root below hits / tries of the log-likelihood less DOUBT, by bisection.
    """
    top, missed = F.log(hits / tries), tries - hits
    low = top - DOUBT / hits - 1.0
    likely = lambda x: hits * (x - top) + missed * (F.log1p(-F.exp(x)) - F.log(missed / tries)) >= -DOUBT

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        return F.struct(F.when(likely(middle), s["low"]).otherwise(middle).alias("low"), F.when(likely(middle), middle).otherwise(s["high"]).alias("high"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), F.struct(low.alias("low"), top.alias("high")), halve)["low"]
    return F.when(missed <= 0, -DOUBT / tries).otherwise(root)


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def text_counts(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, float]:
    """Of each term, the number of distinct texts that hold it, and the number of distinct texts.

    A copied text counts as a whole: each of its copies has one share of it, and sums of shares are rounded.
    """
    key = F.sha2(body(text_col), 256).alias("key")
    copies = docs.select(key).groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = store(copies, "pii_copies")
    extra = copies.agg(F.sum(F.col("copies") - 1)).first()[0] or 0
    each = docs.select(key, _words(body(text_col)).alias("terms")).join(hinted(copies, 100), "key", "left")
    each = each.select(F.explode_outer("terms").alias("term"), (1.0 / F.coalesce("copies", F.lit(1))).alias("part"))
    return each.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_term")), float(docs.count() - extra)


def disclosures(docs: DataFrame, met: DataFrame, text_col: str = "text") -> DataFrame:
    """entity, term and the share of the entity's information that the term discloses, where above GENERALISE.

    All four counts are of distinct texts; a pair meets in a text if the term is near any mention. So repeats inside a text and copies of a text are one meeting. Every pair that meets is scored. PMI is IC(e) plus
    the log of n(e, t) / n(t), for which its lower bound stands: few meetings give away little, however rare the term.
    """
    pairs = met.select("entity", "row", F.explode("terms").alias("term")).distinct()
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    pairs = store(pairs, "pii_pairs")
    seen = store(met.select("entity", "row").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")), "pii_entities")
    counts, n = text_counts(docs, text_col)
    wanted = pairs.select("term").distinct()
    counts = store(counts.join(wanted, "term", "left_semi"), "pii_terms")
    found = pairs.join(counts, "term").join(seen, "entity").filter(F.col("n_entity") < n).withColumn("n_term", F.greatest("n_term", "both"))
    share = lambda log: 1.0 + log / F.log(F.lit(n) / F.col("n_entity"))
    # The bound lies below the plain share, so that sorts out most pairs first.
    found = found.filter(share(F.log(F.col("both") / F.col("n_term"))) >= GENERALISE)
    return found.select("entity", "term", share(log_bound(F.col("both"), F.col("n_term"))).alias("share")).filter(F.col("share") >= GENERALISE)


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and the arrays email, ip, card, phone and term of (start, end, value).

    For `term`, the value is `remove` or `generalise`; such spans lie anywhere in a text that holds the entity that
    they reveal, outside the other spans. Null text counts as empty; rows that repeat are scanned alike; a corpus in
    which every row holds an entity, or none does, has no terms; no rows give no rows.
    """
    base = _base(docs, id_col, text_col)
    private = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    base = base.withColumn("row", F.when(private, F.sha2("text", 256))).withColumn("text", F.when(private, F.col("text")))
    found = store(base, "pii_base")
    texts = found.filter("row is not null").dropDuplicates(["row"])
    met = store(mentions(texts), "pii_mentions")
    telling = store(disclosures(docs, met, text_col), "pii_disclosures")
    # Outer: an inner one would push a filter on the size below the matches and evaluate them once per match.
    placed = add_matches(texts.select("row", "text"), "text", "terms", TERM).select("row", F.explode_outer("terms").alias("t"))
    placed = placed.select("row", "t.start", "t.end", F.lower("t.value").alias("term"))
    # Wherever a telling term stands in a text that holds its entity.
    near = placed.join(hinted(telling, 120), "term").join(met.select("row", "entity").distinct(), ["row", "entity"], "left_semi")
    near = near.groupBy("row", "start", "end").agg(F.when(F.max("share") >= REMOVE, "remove").otherwise("generalise").alias("value"))
    spans = store(near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "value"))).alias("term")), "pii_spans")
    out = found.join(spans, "row", "left")
    out = out.withColumn("term", F.coalesce("term", F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")))
    return out.withColumn("term", outside("term", KINDS[:4])).select("doc_id", *KINDS)


def pii_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts and digests of the spans of `pii_scan`."""
    parts = [ranked(k, i) for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(written(parts[:4], KINDS), 256).alias("base_sha256"), written(parts, KINDS).alias("spans"),
    )
