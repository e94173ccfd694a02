"""Benchmark decontamination by a prefix-filtered join of word shingles."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotag.llm.common import fresh, let, staged

WINDOW = 10
SHINGLE = 4
#: Benchmark shingles (two longs each) are broadcast up to this number, about
#: 64 MB of hash table; a larger benchmark is joined by shuffling.
BROADCAST_SHINGLES = 1_000_000
#: Copies of a larger benchmark's shingles, so that a common one meets documents in many tasks.
SALTS = 32
#: The hash that stands for "this document exists"; it joins like a shingle.
PRESENT = -1
_SEPARATORS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def words(text: Column) -> Column:
    """Words of the lower-cased (A-Z only) text: digits, a-z and everything
    beyond ASCII; an empty array for null."""
    spaced = F.trim(F.translate(text, string.ascii_uppercase + _SEPARATORS, string.ascii_lowercase + " " * len(_SEPARATORS)))
    none = F.expr("cast(array() as array<string>)")
    return let(spaced, lambda t: F.when(F.length(t) > 0, F.split(t, " +")).otherwise(none))


def _shingles(w: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, by position."""
    none = F.expr("cast(array() as array<bigint>)")

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - size)
        return F.when(F.size(w) >= size, F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)), F.lit(size)))).otherwise(none)

    return let(w, hashed)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item, or the whole of a
    shorter item.  Its shingles (``shingle`` words; 64-bit hashes) are looked
    up in one pass over the documents; the positions found give each shingle's
    frequency over all documents.  A window is joined on its rarest shingle
    alone, since exact containment makes a prefix of one token necessary and
    enough; candidates must lie within the document (positional and length
    bound) and are verified against all shingles of the window.

    Null texts and texts without words give n_words 0.  Items without words
    have no window; items are told apart by item_id, null being an id, which is
    written as the empty text.  Whole texts of any length are read, as one array
    of words each.  Repeated document rows are reported alike; an empty
    benchmark gives n_hit 0, an empty table of documents an empty result; other
    columns, whatever their names, are ignored.  Shingles are compared by 64-bit
    hashes.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)

    def windows(w: Column) -> Column:
        length = F.least(F.size(w), F.lit(window))
        return F.transform(F.sequence(F.lit(1), F.size(w) - length + 1), lambda i: F.struct(length.alias("len"), F.array_join(F.slice(w, i, length), " ").alias("win")))

    wins = items.select("item_id", F.inline(let(F.col("w"), windows)))
    wins = staged(wins.distinct(), "benchmark-windows")
    sizes = [r[0] for r in wins.select(F.least("len", F.lit(shingle))).distinct().collect()]  # at most `shingle` values
    split = F.split("win", " ")
    parts = wins.select("win", "len").distinct()
    if sizes:
        by_size = F.expr("cast(array() as array<bigint>)")
        for s in sizes:
            by_size = F.when(F.least("len", F.lit(shingle)) == s, _shingles(split, s)).otherwise(by_size)
    else:
        by_size = F.expr("cast(array() as array<bigint>)")
    parts = staged(parts.select("win", "len", F.posexplode(by_size).alias("at", "h")), "benchmark-shingles")
    vocabulary = parts.select("h").union(docs.sparkSession.sql(f"SELECT {PRESENT}L")).distinct()
    small = parts.count() <= BROADCAST_SHINGLES

    w = words(F.col(text_col))
    present = F.array(F.lit(PRESENT).cast("long"))
    # one array of all shingles, one size after the other, behind the document's own mark
    read = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("text_hash"),
        let(w, lambda v: F.struct(F.size(v).alias("n"), F.concat(present, *(_shingles(v, s) for s in sizes)).alias("all"))).alias("r"),
    )
    posted = read.select("doc_id", "text_hash", F.col("r.n").alias("n_words"), F.posexplode("r.all").alias("pos", "h"))
    before, pos = F.lit(1), F.lit(0)
    for s in sizes:
        pos = F.when(F.col("pos") >= before, F.col("pos") - before).otherwise(pos)
        before = before + F.greatest(F.lit(0), F.col("n_words") - s + 1)
    posted = posted.withColumn("pos", pos)
    if small:
        posted = posted.join(F.broadcast(vocabulary), "h")
    else:  # a shingle may be in every document: documents are dealt to copies of it
        salts = F.array(*(F.lit(i) for i in range(SALTS)))
        salted = posted.where(F.col("h") != PRESENT).withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
        met = salted.join(vocabulary.withColumn("salt", F.explode(salts)), ["h", "salt"]).select(posted.columns)
        posted = met.union(posted.where(F.col("h") == PRESENT).select(posted.columns))
    posted = staged(posted, "shingle-postings")

    base = posted.where(F.col("h") == PRESENT)
    matches = posted.where(F.col("h") != PRESENT).distinct()
    rarity = matches.groupBy("h").agg(F.count("*").alias("df"))
    hint = F.broadcast if small else (lambda d: d)
    ranked = parts.join(rarity, "h", "left").withColumn("r", F.row_number().over(Window.partitionBy("win").orderBy(F.coalesce("df", F.lit(0)), "at")))
    prefix = ranked.where((F.col("r") == 1) & F.col("df").isNotNull()).select("win", "len", "h", "at")
    start = F.col("pos") - F.col("at")
    candidates = matches.join(hint(prefix), "h").select("doc_id", "text_hash", "win", "len", start.alias("start"), "n_words").where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    wanted = candidates.join(hint(parts.drop("len")), "win").select("doc_id", "text_hash", "win", "len", "start", (F.col("start") + F.col("at")).alias("pos"), "h")
    a, b = wanted.alias("a"), matches.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    for c in ("text_hash", "pos", "h"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    occurs = (
        a.join(b, same, "left_semi")
        .groupBy("doc_id", "text_hash", "win", "len", "start")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == F.col("len") - F.least("len", F.lit(shingle)) + 1)
    )
    occurs = staged(occurs.drop("n"), "benchmark-occurrences")
    key = ["doc_id", "text_hash"]
    earlier = Window.partitionBy(*key).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    hit = occurs.select(*key, "start", "len").distinct().withColumn("to", F.coalesce(F.max(end).over(earlier), F.lit(0)))
    hit = hit.groupBy(key).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "to"))).alias("n_hit"))
    named = occurs.select(*key, "win").distinct().join(hint(wins.select("win", "item_id")), "win").select(*key, "item_id").distinct()
    named = named.groupBy(key).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.coalesce("item_id", F.lit("")))), ",").alias("items"))
    out = base
    for name, side in (("x", hit), ("y", named)):
        side = side.withColumnsRenamed({"doc_id": f"{name}_id", "text_hash": f"{name}_hash"})
        out = out.join(side, F.col("doc_id").eqNullSafe(F.col(f"{name}_id")) & (F.col("text_hash") == F.col(f"{name}_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "text_hash",
    )


#: Contaminated documents that are broadcast, at most (two longs each).
BROADCAST_DOCS = 1_000_000


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of the benchmark.

    Rows with null ids, null or empty texts and repeated rows are judged like any
    other; columns may have any names; empty tables give nothing to reject.
    """
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col).where("contaminated")
    i, h = fresh("_id", docs), fresh("_hash", docs)
    gone = staged(found.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct(), "contaminated")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_DOCS else gone
    return docs.join(gone, (F.xxhash64(text_col) == F.col(h)) & F.col(id_col).eqNullSafe(F.col(i)), "left_anti")


_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dp AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
b AS (SELECT row_number() OVER () AS r, item_id, {_WORDS} AS w FROM benchmark),
bp AS (SELECT r, item_id, least(len(w), {WINDOW}) AS l, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, win FROM (
  SELECT item_id, l, string_agg(x, ' ') OVER f AS win, count(*) OVER f AS n FROM bp
  WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND l - 1 FOLLOWING)) WHERE n = l),
dw AS (SELECT r, l, i, win FROM (
  SELECT r, l, i, string_agg(x, ' ') OVER f AS win, count(*) OVER f AS n FROM dp, (SELECT DISTINCT l FROM bw)
  WINDOW f AS (PARTITION BY r, l ORDER BY i ROWS BETWEEN CURRENT ROW AND l - 1 FOLLOWING)) WHERE n = l),
o AS (SELECT dw.r, dw.l, dw.i, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM o) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
