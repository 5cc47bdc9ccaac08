"""Canonical document fingerprints, in DataFrame and SQL functions only.

A text is put into one canonical form: Unicode normalisation (NFKC), default case
folding, white space runs to one space, none at the ends. The normaliser and the
folding are those that Spark itself ships for its collations, called by Spark's SQL
function ``java_method``. The fingerprint is a 128-bit xxhash of that form, in hex.

Groups are exact: rows meet by their hash, and where a bucket has several rows the
canonical texts themselves are compared, so a collision never joins two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlog.llm.common import NULL_KEY, doc_id, drop, keyed, save

_FOLD = "java_method('com.ibm.icu.lang.UCharacter', 'foldCase', java_method('com.ibm.icu.text.Normalizer', 'compose', {0}, true), true)"


_WHITE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def canonical(col: str) -> Column:
    """The canonical form. NFKC once more after folding, for folding can undo it. An
    ASCII text needs no normaliser: lower case is its folding."""
    plain = F.octet_length(col) == F.char_length(col)
    full = F.expr("java_method('com.ibm.icu.text.Normalizer', 'compose', " + _FOLD.format(f"`{col}`") + ", true)")
    folded = F.when(plain, F.lower(col)).otherwise(full)
    # A single space stays as it is, which spares a replacement for every word.
    return F.trim(F.regexp_replace(folded, rf"[{_WHITE}&&[^ ]][{_WHITE}]*| [{_WHITE}]+", " "))


def digest(canon: str | Column) -> tuple[Column, Column]:
    """Two independent 64-bit halves: the hash runs on from a different seed in each."""
    return F.xxhash64(F.lit(1), canon), F.xxhash64(F.lit(2), canon)


def _hex(a: str, b: str) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(a)), 16, "0"), F.lpad(F.lower(F.hex(b)), 16, "0"))


def prints(docs: DataFrame) -> DataFrame:
    """A saved row for each document: key, code points, and the halves of the digest."""
    h1, h2 = digest("canon")
    d = keyed(docs).withColumn("canon", canonical("text"))
    return save(d.select("k", F.char_length("text").cast("long").alias("n"), h1.alias("h1"), h2.alias("h2")), "prints")


def groups(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, fingerprint, group_id, n_copies``: documents of equal canonical texts,
    compared byte by byte, share the least id among them.

    Null, empty and blank texts are equal. Repeated rows count as copies. ``known``:
    ``prints`` of the documents, where they are at hand.
    """
    ids = prints(docs) if known is None else known
    d = keyed(docs).withColumn("canon", canonical("text"))
    h1, h2 = digest("canon")
    d = d.select("k", "canon", h1.alias("h1"), h2.alias("h2"))
    # Bytes are compared inside equal buckets only. Each task sends the distinct texts it has,
    # so a text that very many documents share is never gathered.
    exact = d.groupBy("h1", "h2", "canon").agg(F.min("k").alias("low"), F.count("*").alias("n"))
    full = save(exact.groupBy("h1", "h2").agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.count("*").alias("texts")), "buckets")
    cols = ["k", "h1", "h2", "low", "n"]
    out = ids.select("k", "h1", "h2").join(full, ["h1", "h2"]).where("texts = 1").select(*cols)
    mixed = full.where("texts > 1").select("h1", "h2")
    if not mixed.isEmpty():
        out = out.unionByName(d.join(mixed, ["h1", "h2"]).join(exact, ["h1", "h2", "canon"]).select(*cols))
    return out.select(doc_id(), _hex("h1", "h2").alias("fingerprint"), F.when(F.col("low") != NULL_KEY, F.col("low")).alias("group_id"), F.col("n").alias("n_copies"))


def edited_fingerprints(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness.

    A text of n code points loses its last ``n // 2``; in their place come as many of
    the first code points of the next document's text, or all it has. Next is the
    document of the next greater id, after the last the first; where rows repeat an id,
    the least text among them speaks for it. A single document is its own next.

    Returns per row ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The likeness of two exact fingerprints is 1 or 0. Null
    texts count as empty. Null ids sort first. ``known``: ``prints`` of the documents.
    """
    d = keyed(docs)
    n = F.char_length("text").cast("long")
    # ``times``: rows of the id. A repeated id's digest is not known from the id alone.
    one = (prints(docs) if known is None else known).groupBy("k").agg(F.max("n").alias("n"), F.count("*").alias("times"), F.max("h1").alias("h1"), F.max("h2").alias("h2"))
    halves = one.select("k", F.floor(F.col("n") / 2).alias("need"), "times", "h1", "h2")
    # The order of all ids, by ranges: each range looks ahead by itself, and a row for
    # each range carries the first id of the next. Ids alone are shuffled.
    ranged = halves.repartitionByRange("k").withColumn("part", F.spark_partition_id())
    ids = save(ranged, "ids")
    heads = ids.groupBy("part").agg(F.min("k").alias("head"))
    order = Window.orderBy("part")
    first = F.min("head").over(Window.partitionBy())
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), first).alias("after"))
    nexts = ids.withColumn("then", F.lead("k").over(Window.partitionBy("part").orderBy("k")))
    nexts = nexts.join(heads, "part").select("k", "need", "times", "h1", "h2", F.coalesce("then", "after").alias("next"))
    nexts = save(nexts, "next")
    drop(ids)

    # Digests that are known by id go along; only rows of a repeated id need their text's again.
    own = nexts.select("k", "times", "h1", "h2")
    wanted = nexts.select(F.col("next").alias("k"), F.col("k").alias("for"), "need").join(own, "k")
    n1, n2 = (F.when(F.col("times") == 1, F.col(h)).otherwise(x) for h, x in zip(("h1", "h2"), digest(canonical("text"))))
    given = d.join(wanted, "k").select("for", F.expr("left(text, cast(need as int))").alias("tail"), n1.alias("n1"), n2.alias("n2"))
    given = given.groupBy("for").agg(F.min(F.struct("tail", "n1", "n2")).alias("g")).select(F.col("for").alias("k"), "g.*")
    both = d.join(own, "k").join(given, "k")
    half = F.floor(n / 2).cast("int")
    both = both.select("k", n.alias("n_chars"), "text", "n1", "n2", n1.alias("a"), n2.alias("b"), half.alias("half"), "tail")
    both = both.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars as int) - half)"), F.expr("left(tail, half)")))
    both = both.select("k", "n_chars", "n1", "n2", "a", "b", "text", F.sha2("edited", 256).alias("edited_sha256"), canonical("edited").alias("other"))
    e, f = digest("other")
    both = both.select("k", "n_chars", "edited_sha256", "n1", "n2", "a", "b", "text", "other", e.alias("e"), f.alias("f"))
    # Equal digests are settled by the bytes.
    equal = (F.col("a") == F.col("e")) & (F.col("b") == F.col("f"))
    both = both.withColumn("same", F.when(equal, canonical("text") == F.col("other")).otherwise(False))
    return both.select(
        doc_id(),
        "n_chars",
        "edited_sha256",
        _hex("a", "b").alias("fingerprint"),
        _hex("e", "f").alias("edited_fingerprint"),
        F.when(F.col("same"), 1.0).otherwise(0.0).alias("near_edited"),
        F.when((F.col("a") == F.col("n1")) & (F.col("b") == F.col("n2")), 1.0).otherwise(0.0).alias("near_next"),
    )
