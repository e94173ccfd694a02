"""Secret scanning with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotag.llm.common import fresh, join_hot, let, staged

#: Base kinds in their fixed order.  Maximal runs need no test of length
#: afterwards; the value of an assignment does, since a match that fails it
#: has still used up its text.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
}
LEAST_VALUE = 6
#: Bare tokens that may be credentials though no base pattern has them; those
#: without any digit are left out.
OWNED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = (*PATTERNS, "owned")
#: A value that more owners than this hold is a widely copied example.
MOST_OWNERS = 3
#: start and end in code points; from and to in bytes.
SPAN = "struct<start:int,kind:int,end:int,value:string,from:int,to:int>"


def _matches(text: Column, kind: str) -> Column:
    """The matches of a kind as an array of SPAN.

    The pieces between matches and the matches alternate, so sums of their
    lengths are the offsets.  They are summed within groups of about the square
    root of their number, and the groups' sums once more, so that the work does
    not grow with the square of the matches.
    """
    pattern, number = PATTERNS.get(kind, OWNED), KINDS.index(kind)
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in ((0, 1) if kind == "assign" else (0,))]
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found[0].alias("own"), *(v.alias("value") for v in found[1:]))
    parts = F.filter(parts, lambda p: p["own"].isNotNull())
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    zero = F.lit(0)

    def span(p: Column, at: Column, byte: Column) -> Column:
        start, lo = at + F.length(p["gap"]), byte + F.octet_length(p["gap"])
        value = p["value" if kind == "assign" else "own"]
        return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.length(p["own"])).alias("end"), value.alias("value"), lo.alias("from"), (lo + F.octet_length(p["own"])).alias("to"))

    def within(group: Column) -> Column:  # spans from the group's own start, and where it ends
        first = F.struct(zero.alias("at"), zero.alias("byte"), none.alias("out"))

        def step(a: Column, p: Column) -> Column:
            return let(span(p, a["at"], a["byte"]), lambda s: F.struct(s["end"].alias("at"), s["to"].alias("byte"), F.concat(a["out"], F.array(s)).alias("out")))

        return F.aggregate(group, first, step)

    def placed(groups: Column) -> Column:
        starts = F.aggregate(
            groups,
            F.expr("array(named_struct('at', 0, 'byte', 0))"),
            lambda a, g: F.concat(a, F.array(let(F.element_at(a, -1), lambda e: F.struct((e["at"] + g["at"]).alias("at"), (e["byte"] + g["byte"]).alias("byte"))))),
        )
        def moved(s: Column, by: Column) -> Column:
            return F.struct(
                (s["start"] + by["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + by["at"]).alias("end"),
                s["value"].alias("value"), (s["from"] + by["byte"]).alias("from"), (s["to"] + by["byte"]).alias("to"),
            )

        pairs = let(starts, lambda at: F.transform(groups, lambda g, i: let(F.get(at, i), lambda by: F.transform(g["out"], lambda s: moved(s, by)))))
        return F.flatten(pairs)

    def walked(p: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(p))).cast("int")
        groups = let(size, lambda k: F.transform(F.sequence(zero, F.floor((F.size(p) - 1) / k).cast("int")), lambda i: within(F.slice(p, i * k + 1, k))))
        return F.when(F.size(p) > 0, let(groups, placed)).otherwise(none)

    out = F.when(text.rlike(pattern), let(parts, walked)).otherwise(none)
    if kind == "assign":
        return F.filter(out, lambda m: F.length(m["value"]) >= LEAST_VALUE)
    return F.filter(out, lambda m: m["value"].rlike("[0-9]")) if kind == "owned" else out


def find_candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str | None) -> DataFrame:
    """(doc_id, text_hash, repo, owner, base, any): the spans of each row; any
    has bare tokens, which base spans may overlap."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(repo_col).alias("repo"), F.col(owner_col or repo_col).alias("owner"))
        .select("*", F.xxhash64("text").alias("text_hash"), F.concat(*(_matches(F.col("text"), k) for k in PATTERNS)).alias("base"), _matches(F.col("text"), "owned").alias("any"))
        .drop("text")
    )


def _clear(spans: DataFrame) -> DataFrame:
    """``spans`` without the bare tokens that a base span of the text overlaps:
    in order of start, no base span before reaches in and none behind begins
    before its end."""
    base = F.col("kind") < len(PATTERNS)
    row = Window.partitionBy("doc_id", "text_hash")
    order = row.orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(base, F.col("start"))).over(row.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_before", before).withColumn("_behind", behind)
    clear = (F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.col("_behind").isNull() | (F.col("_behind") >= F.col("end")))
    return marked.where(base | clear).drop("_before", "_behind")


def ownership(spans: DataFrame) -> DataFrame:
    """For each value hash, how many owners and repositories hold it and whether
    a base pattern found it anywhere.

    Counts are combined per (hash, owner, repository) before they meet per hash,
    so a value in a third of all rows moves as one row for each task.
    """
    each = spans.groupBy("hash", "owner", "repo").agg(F.max(F.col("kind") < len(PATTERNS)).alias("base"))
    return each.groupBy("hash").agg(F.countDistinct(F.struct("owner")).alias("n_owners"), F.countDistinct(F.struct("repo")).alias("n_repos"), F.max("base").alias("base_somewhere"))


def judge(candidates: DataFrame, most_owners: int) -> DataFrame:
    """(doc_id, text_hash, live, copied, owned): what ownership makes of each
    document's spans, for the documents that have any."""
    rows = candidates.where((F.size("base") > 0) | (F.size("any") > 0)).select("doc_id", "text_hash", "repo", "owner", F.inline(F.concat("base", "any")))
    # a row's repetitions in other repositories count there, not as further spans
    texts = _clear(rows.select("doc_id", "text_hash", "start", "kind", "end", "value", "from", "to").distinct()).withColumn("hash", F.sha2("value", 256))
    texts = staged(texts, "secret-texts")
    where = candidates.select("doc_id", "text_hash", "repo", "owner").where((F.size("base") > 0) | (F.size("any") > 0)).distinct()
    held = texts.select("doc_id", "text_hash", "hash", "kind").join(where.withColumnRenamed("doc_id", "_d"), (F.col("doc_id").eqNullSafe(F.col("_d"))) & (texts["text_hash"] == where["text_hash"]))
    own = ownership(held.select("hash", "owner", "repo", "kind"))
    varied = F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[0-9]")
    few, base = F.col("n_owners") <= most_owners, F.col("kind") < len(PATTERNS)
    told = join_hot(texts, staged(own, "secret-owners"), "hash", "inner", "secret").select(
        "doc_id",
        "text_hash",
        F.struct("start", "kind", "end", "from", "to").alias("s"),
        F.when(base & few, "live").when(base, "copied").when(few & (F.col("base_somewhere") | varied), "owned").alias("is"),
    )
    kept = lambda what: F.sort_array(F.collect_list(F.when(F.col("is") == what, F.col("s")))).alias(what)
    return told.groupBy("doc_id", "text_hash").agg(kept("live"), kept("copied"), kept("owned"))


def _written(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, most_owners: int = MOST_OWNERS) -> DataFrame:
    """Find secrets in whole texts and weigh each by who owns its value.

    Base spans (assign, access, hex) are always reported.  The value of every
    span, and every bare token of 20 and more characters with a digit, is
    hashed and counted over all documents by distinct owner and repository.
    Base values of at most ``most_owners`` owners are live, the others copied
    examples.  Bare tokens of so few owners that a base pattern caught anywhere
    else, or that mix upper case, lower case and digits, are added as kind
    ``owned``.  Without an owner column the repository stands for the owner;
    null is an owner like any other.

    Null texts are empty and have no span.  One row for each input row, repeated
    rows and null ids included; an empty table gives an empty result; other
    columns, whatever their names, are ignored.  Whole texts are searched; the
    work grows with a text's matches and not with their square.
    """
    candidates = staged(find_candidates(docs, id_col, text_col, repo_col, owner_col), "secret-candidates")
    judged = judge(candidates, most_owners)
    base = F.sort_array(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    short = F.transform("j.owned", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    c, j = candidates.withColumn("b", base).alias("c"), judged.alias("j")
    return c.join(j, F.col("c.doc_id").eqNullSafe(F.col("j.doc_id")) & (F.col("c.text_hash") == F.col("j.text_hash")), "left").select(
        "c.doc_id",
        *((F.size("b") - F.size(F.array_remove(F.col("b.kind"), i))).cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)),
        F.sha2(_written(F.col("b")), 256).alias("base_sha256"),
        _written(F.sort_array(F.concat("b", F.coalesce(short, none)))).alias("spans"),
        F.coalesce(F.size("j.live"), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.size("j.copied"), F.lit(0)).cast("long").alias("n_copied"),
        F.coalesce(F.size("j.owned"), F.lit(0)).cast("long").alias("n_owned"),
    )


def redact_live(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, most_owners: int = MOST_OWNERS) -> DataFrame:
    """``docs`` with every live and owned span replaced by ``mark``.

    All rows stay, and so do texts without such spans, copied examples included;
    spans that overlap are one.  Rows in which no pattern occurs are passed on
    without a shuffle.  Null ids and null, empty and repeated texts are rows like
    any other; columns may have any names; an empty table gives an empty one.
    Texts are cut at byte offsets, so a long text is copied once.
    """
    i, h, c = (fresh(n, docs) for n in ("_id", "_hash", "_cut"))
    candidates = staged(find_candidates(docs, id_col, text_col, repo_col, owner_col).where((F.size("base") > 0) | (F.size("any") > 0)), "secret-candidates")
    spans = judge(candidates, most_owners).select("doc_id", "text_hash", F.inline(F.concat("live", "owned")))
    reach = F.max("to").over(Window.partitionBy("doc_id", "text_hash").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1))
    ends = spans.withColumn("_reach", F.coalesce(reach, F.lit(0))).where(F.col("to") > F.col("_reach"))
    piece = F.struct(F.greatest("from", "_reach").alias("from"), "to", (F.col("from") >= F.col("_reach")).alias("new"))
    cuts = ends.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(piece)).alias(c)).withColumnsRenamed({"doc_id": i, "text_hash": h})
    text = F.col(text_col)
    may = F.coalesce(text.rlike("|".join((*PATTERNS.values(), OWNED))), F.lit(False))

    def redacted(all_: Column, raw: Column) -> Column:
        bytes_ = lambda lo, n: F.decode(F.substring(raw, lo + 1, n), "UTF-8")
        end = lambda k: F.when(k > 0, F.get(all_, k - 1)["to"]).otherwise(0)
        pieces = F.transform(all_, lambda s, k: F.concat(bytes_(end(k), s["from"] - end(k)), F.when(s["new"], mark).otherwise("")))
        return F.concat(F.array_join(pieces, ""), bytes_(F.element_at(all_, -1)["to"], F.octet_length(raw)))

    cut = let(F.col(c), lambda all_: let(F.encode(text, "UTF-8"), lambda raw: redacted(all_, raw)))
    hit = docs.where(may).join(cuts, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(h)), "left")
    hit = hit.withColumn(text_col, F.when(F.col(c).isNull(), text).otherwise(cut)).select(docs.columns)
    return docs.where(~may).unionByName(hit)


def _oracle() -> str:
    """The query's SQL: spans from the lengths of matches and of what is between them."""
    spans = []
    for k, kind in enumerate(KINDS):
        pattern = {**PATTERNS, "owned": OWNED}[kind].replace("}+", "}").replace("(?<![A-Za-z0-9+/_=-])", "").replace("'", "''")
        value = f"regexp_extract_all(t, '{pattern}', 1)" if kind == "assign" else "own"
        good = {"assign": f"length(value) >= {LEAST_VALUE}", "owned": "regexp_matches(value, '[0-9]')"}.get(kind, "true")
        spans.append(f"""SELECT r, src, {k} AS kind, CAST(p AS BIGINT) AS lo, CAST(p + length(own) AS BIGINT) AS hi, value FROM (
  SELECT r, src, own, value, sum(length(gap) + coalesce(length(before), 0)) OVER (PARTITION BY r ORDER BY i) AS p FROM (
    SELECT r, src, i, own, value, gap, lag(own) OVER (PARTITION BY r ORDER BY i) AS before FROM (
      SELECT r, src, unnest(range(len(own))) AS i, unnest(own) AS own, unnest(value) AS value, unnest(gap[1:len(own)]) AS gap FROM (
        SELECT r, src, own, {value} AS value, string_split_regex(t, '{pattern}') AS gap FROM (SELECT r, src, t, regexp_extract_all(t, '{pattern}') AS own FROM d))))) WHERE {good}""")
    bare = len(PATTERNS)
    names = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END || ':' || lo || ':' || hi"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{n}" for k, n in enumerate(PATTERNS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(0) || 'null') AS src FROM documents),
a AS ({" UNION ALL ".join(spans)}),
s AS (SELECT * FROM a WHERE kind < {bare} UNION ALL SELECT * FROM a WHERE kind = {bare} AND NOT EXISTS (SELECT 1 FROM a b WHERE b.r = a.r AND b.kind < {bare} AND b.lo < a.hi AND a.lo < b.hi)),
v AS (SELECT value, count(DISTINCT src) AS n, bool_or(kind < {bare}) AS base FROM s GROUP BY value),
j AS (SELECT r, kind, lo, hi, CASE WHEN kind < {bare} AND n <= {MOST_OWNERS} THEN 'live' WHEN kind < {bare} THEN 'copied'
  WHEN n <= {MOST_OWNERS} AND (base OR regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')) THEN 'owned' END AS is_ FROM s JOIN v USING (value)),
o AS (SELECT r, {counts}, string_agg({names}, ',' ORDER BY lo, kind) FILTER (kind < {bare}) AS base, string_agg({names}, ',' ORDER BY lo, kind) AS spans,
  count(*) FILTER (is_ = 'live') AS n_live, count(*) FILTER (is_ = 'copied') AS n_copied, count(*) FILTER (is_ = 'owned') AS n_owned FROM j WHERE is_ IS NOT NULL GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_owned, 0) AS n_owned FROM d LEFT JOIN o USING (r)
"""


ORACLE_SQL = _oracle()
