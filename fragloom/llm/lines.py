"""Line dedup on content-defined chunks of lines. Only DataFrame functions.

A rolling hash over the hashes of two consecutive lines cuts a text behind about every third line, so equal passages
are cut alike wherever they stand. A chunk of two or more lines with content that occurs in several places stays in
its first one (smallest document id, then place) and goes elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fragloom.llm.common import staged, texts

FACTOR = 1_000_003
MODULUS = 2_147_483_647
DIVISOR = 3  # one line in three ends a chunk


def line_hash(line: Column) -> Column:
    """28 bits of the line's md5, a value that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def with_chunks(rows: DataFrame) -> DataFrame:
    """Adds ``_lines`` and ``_ends`` (place of each chunk's last line) to rows with ``_text``."""
    rows = rows.withColumn("_lines", F.split("_text", "\n"))
    rows = rows.withColumn("_hashes", F.transform("_lines", line_hash))
    h, n = F.col("_hashes"), F.size("_hashes")
    rolled = lambda i: (F.get(h, i) + F.lit(FACTOR) * F.coalesce(F.get(h, i - 1), F.lit(0))) % MODULUS
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (rolled(i) % DIVISOR == 0))
    return rows.withColumn("_ends", F.when(F.col("_text").isNotNull(), ends)).drop("_hashes")


def chunk_start(k: Column) -> Column:
    return F.coalesce(F.get(F.col("_ends"), k - 1) + 1, F.lit(0))


def chunk_lines(k: Column) -> Column:
    start = chunk_start(k)
    return F.slice(F.col("_lines"), start + 1, F.get(F.col("_ends"), k) - start + 1)


def candidates(rows: DataFrame) -> DataFrame:
    """(_id, _tie, _k, _h, _chunk): chunks with two or more lines that have a character other than white space."""
    cut = with_chunks(rows).where("_text is not null")
    numbers = F.filter(F.sequence(F.lit(0), F.size("_ends") - 1), lambda k: F.get(F.col("_ends"), k) > chunk_start(k))
    out = cut.select("_id", "_tie", F.explode(F.transform(numbers, lambda k: F.struct(k.alias("k"), chunk_lines(k).alias("l")))).alias("_c"))
    out = out.where(F.size(F.filter(F.col("_c.l"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))) >= 2)
    out = out.select("_id", "_tie", F.col("_c.k").alias("_k"), F.array_join("_c.l", "\n").alias("_chunk"))
    return out.select("_id", "_tie", "_k", F.xxhash64("_chunk").alias("_h"), "_chunk")


def repeats(rows: DataFrame) -> DataFrame:
    """(_id, _tie, _k) of every chunk that is byte for byte equal to an earlier one.

    Grouping by hash and whole bytes is the comparison; equal chunks meet in the map tasks first, so a chunk that a
    third of all documents hold is one row per task in the shuffle. Occurrences then meet their first place by hash
    alone, in narrow rows, except for hashes that several byte strings share: those meet by the bytes as well.
    """
    found = candidates(rows)
    place = F.struct(F.col("_id").isNotNull().alias("has"), "_id", "_tie", "_k")
    groups = found.groupBy("_h", "_chunk").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    per_hash = staged(groups.groupBy("_h").agg(F.count("*").alias("byte_strings"), F.max("n").alias("n"), F.min("first").alias("first")).where("n > 1 or byte_strings > 1"), "chunks")
    later = lambda df: df.where(~place.eqNullSafe(F.col("first"))).select("_id", "_tie", "_k")
    gone = later(found.drop("_chunk").join(per_hash.where("byte_strings = 1").select("_h", "first"), "_h"))
    shared = per_hash.where("byte_strings > 1").select("_h")
    if shared.limit(1).count():  # two byte strings with one hash: hardly ever, and then worth another pass
        gone = gone.unionByName(later(found.join(groups.where("n > 1").join(shared, "_h").select("_h", "_chunk", "first"), ["_h", "_chunk"])))
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with repeated chunks taken out of the text, and ``n_lines``, ``n_chunks`` and
    ``n_removed`` (chunks) beside them; such names already in ``docs`` give way.

    Null text stays null with zeros; an empty text is one empty line and stays. Rows with equal id and equal text are one document and
    get one result; equal ids with other texts and null ids are documents of their own (null comes first). A text may
    become empty; its row stays. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_chunks", "n_removed")]
    # the text travels once, under its own name
    keyed = docs.select(*(F.col(f"`{c}`").alias("_text" if c == text_col else f"_c{i}") for i, c in enumerate(own)), F.col(f"`{id_col}`").alias("_id"))
    keyed = keyed.withColumn("_tie", F.xxhash64("_text"))
    gone = repeats(texts(docs, id_col, text_col).withColumn("_tie", F.xxhash64("_text")))
    gone = gone.groupBy("_id", "_tie").agg(F.collect_set("_k").alias("_gone")).withColumnsRenamed({"_id": "_gid", "_tie": "_gtie"})
    rows = keyed.join(gone, (F.col("_tie") == F.col("_gtie")) & F.col("_id").eqNullSafe(F.col("_gid")), "left")
    cut = with_chunks(rows)
    n_chunks = F.coalesce(F.size("_ends"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_ends") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(F.transform(kept, chunk_lines)), "\n"))
    return cut.select(
        *((text if c == text_col else F.col(f"_c{i}")).alias(c) for i, c in enumerate(own)),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_text").isNull(), 0).otherwise(n_chunks).cast("long").alias("n_chunks"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE_SQL = r"""
with cut as (
  select doc_id, text, string_split(text, chr(10)) as ls,
         list_transform(string_split(text, chr(10)), lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) as hs
  from documents where text is not null),
ended as (
  select doc_id, ls, list_filter(range(len(ls)), lambda i: i = len(ls) - 1 or ((hs[i + 1] + 1000003 * coalesce(hs[i], 0)) % 2147483647) % 3 = 0) as ends
  from cut),
numbered as (select doc_id, ls, ends, unnest(range(len(ends))) as k from ended),
chunks as (
  select doc_id, k, ls[coalesce(ends[k] + 1, 0) + 1 : ends[k + 1] + 1] as part from numbered),
judged as (
  select doc_id, k, array_to_string(part, chr(10)) as chunk,
         len(list_filter(part, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) >= 2 as many from chunks),
ranked as (
  select doc_id, k, chunk, many and row_number() over (partition by many, chunk order by doc_id, k) > 1 as gone from judged),
kept as (
  select doc_id, count(*) as n_chunks, count(*) filter (where gone) as n_removed,
         coalesce(string_agg(chunk, chr(10) order by k) filter (where not gone), '') as text
  from ranked group by doc_id)
select d.doc_id, (case when d.text is null then 0 else len(string_split(d.text, chr(10))) end)::BIGINT as n_lines,
       coalesce(n_chunks, 0)::BIGINT as n_chunks, coalesce(n_removed, 0)::BIGINT as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join kept k using (doc_id)
"""
