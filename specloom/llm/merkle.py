"""Document fingerprints: a Merkle tree of each text, in DataFrame functions only.

Levels, from the leaves: blocks of at most `BLOCK` characters of a paragraph, counted from its
start; paragraphs (lines); sections (runs of paragraphs that end where a paragraph's own hash
says so, so that an edit moves no other section's borders); the root. A paragraph's hash is the
SHA-256 of its text, a section's that of its paragraphs' hashes, the root that of the sections'.
Equal roots mean equal texts; differing branches lead to the edits.

A fingerprint is the root, a colon, and the tree below it: each section as eight digits and, in
square brackets, its paragraphs, each as eight digits and, in round ones, its blocks' eight digits.
The likeness of two fingerprints is 1 if their roots are equal. Else it goes down where they
differ: branches that both have count with all their blocks; of the sections that only one has the
paragraphs are compared, and of the paragraphs that only one has the blocks. It is the Dice
coefficient of what was found alike at its level, and needs the two strings alone.

Neighbours by descending doc_id come from one shuffle of the texts by ranges of doc_id, of about
`RANGE_BYTES` each; the top row of each range is also dealt to the range above it. Null doc_ids and
those that hold more than one in `COARSE` of all rows are dealt further, by their texts' hashes.

Cases: null texts are empty; an empty text has one empty paragraph and no block; two texts without
a block in common have likeness 0; null doc_ids come last; rows with equal doc_ids follow in the
order of their texts' MD5; a single row is its own next; an empty table gives no rows; doc_ids may
be any long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, text_bytes

BLOCK = 32
RANGE_BYTES, PART_BYTES = 1 << 20, 64 << 20
MOST_RANGES = 200_000
COARSE = 64


def paragraph_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p.cast("binary"), 256))


def sections(hashes: Column) -> Column:
    """Each section as its paragraphs' hashes, space-parted."""
    return F.split(F.regexp_replace(F.array_join(hashes, " "), "([0-3]) ", "$1|"), "\\|", -1)


def section_hashes(parts: Column) -> Column:
    return F.transform(parts, lambda s: F.sha2(s.cast("binary"), 256))


def _root(parts: Column) -> Column:
    return F.sha2(F.array_join(section_hashes(parts), " ").cast("binary"), 256)


def root(text: Column) -> Column:
    return _root(sections(paragraph_hashes(text)))


def _blocks(paragraph: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(paragraph, F.lit(f"[^\\n]{{1,{BLOCK}}}"), F.lit(0)), lambda b: F.substring(F.md5(b.cast("binary")), 1, 8)), " ")


def fingerprint(text: Column) -> Column:
    # paragraphs as hash(blocks); a section ends where a hash does in 0 to 3
    whole = F.array_join(F.transform(F.split(text, "\n", -1), lambda p: F.concat(F.sha2(p.cast("binary"), 256), F.lit("("), _blocks(p), F.lit(")"))), ";")
    parts = F.split(F.regexp_replace(whole, "([0-3]\\([^)]*\\));", "$1|"), "\\|", -1)
    hash_of = lambda s: F.sha2(F.replace(F.regexp_replace(s, "\\([^)]*\\)", ""), F.lit(";"), F.lit(" ")).cast("binary"), 256)
    hashed = F.transform(parts, lambda s: F.struct(hash_of(s).alias("h"), F.regexp_replace(s, "([0-9a-f]{8})[0-9a-f]{56}\\(", "$1(").alias("s")))
    joined = F.transform(F.array(hashed), lambda x: F.concat(F.sha2(F.array_join(F.transform(x, lambda s: s["h"]), " ").cast("binary"), 256), F.lit(":"), F.array_join(F.transform(x, lambda s: F.concat(F.substring(s["h"], 1, 8), F.lit("["), s["s"], F.lit("]"))), "")))
    return F.element_at(joined, 1)


def _sections_of(fp: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.substring(fp, 66, 1 << 30), "\\]"), lambda s: s != ""))


def _paragraphs_of(parts: Column) -> Column:
    return F.array_distinct(F.filter(F.flatten(F.transform(parts, lambda s: F.split(F.substring(s, 10, 1 << 30), ";"))), lambda p: p != ""))


def _blocks_of(paragraphs: Column) -> Column:
    return F.filter(F.flatten(F.transform(paragraphs, lambda p: F.split(F.regexp_extract(p, "\\(([^)]*)\\)", 1), " "))), lambda b: b != "")


def _in_both(x: Column, y: Column) -> Column:
    return F.array_intersect(x, y)


def likeness(a: Column, b: Column) -> Column:
    step = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  each level is worked out once

    def levels(s: Column) -> Column:
        alike = F.size(_blocks_of(_paragraphs_of(_in_both(s["x"], s["y"]))))
        return F.struct(alike.alias("n"), _paragraphs_of(F.array_except(s["x"], s["y"])).alias("x"), _paragraphs_of(F.array_except(s["y"], s["x"])).alias("y"))

    def lower(p: Column) -> Column:
        alike = p["n"] + F.size(_blocks_of(_in_both(p["x"], p["y"])))
        return F.struct(alike.alias("n"), F.array_distinct(_blocks_of(F.array_except(p["x"], p["y"]))).alias("x"), F.array_distinct(_blocks_of(F.array_except(p["y"], p["x"]))).alias("y"))

    def dice(q: Column) -> Column:
        both = (q["n"] + F.size(_in_both(q["x"], q["y"]))).cast("double") * 2.0
        return F.coalesce(F.try_divide(both, (q["n"] * 2 + F.size(q["x"]) + F.size(q["y"])).cast("double")), F.lit(0.0))

    top = F.struct(_sections_of(a).alias("x"), _sections_of(b).alias("y"))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(step(step(step(top, levels), lower), dice))


def trees(docs: DataFrame) -> DataFrame:
    """doc_id, root and the tree itself: sections with their hash and their paragraphs' hashes."""
    return documents(docs).select("doc_id", sections(paragraph_hashes(F.coalesce("text", F.lit("")))).alias("_s")).select(
        "doc_id",
        _root(F.col("_s")).alias("root"),
        F.transform("_s", lambda s: F.struct(F.sha2(s.cast("binary"), 256).alias("hash"), F.split(s, " ").alias("paragraphs"))).alias("sections"),
    )


def locate_edits(a: Column, b: Column) -> Column:
    """Of two `sections` columns: numbers of the paragraphs of the second that lie in sections the first hasn't, and aren't in the first."""
    old = F.transform(a, lambda s: s["hash"])
    known = F.flatten(F.transform(a, lambda s: s["paragraphs"]))
    marked = F.flatten(F.transform(b, lambda s: F.transform(s["paragraphs"], lambda p: ~F.array_contains(old, s["hash"]) & ~F.array_contains(known, p))))
    return F.filter(F.transform(marked, lambda m, k: F.when(m, k)), lambda k: k.isNotNull())


def with_next(own: DataFrame, columns: list[str]) -> DataFrame:
    """own (doc_id, text without nulls, more columns), each row with `next_<column>` of the next row by descending doc_id; the last row's next is the first."""
    total = text_bytes(own)
    ranges = max(1, min(MOST_RANGES, total // RANGE_BYTES))
    found = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in own.approxQuantile("doc_id", [k / COARSE for k in range(COARSE + 1)], 0.001)]
    edges, often = sorted({*found}), sorted({x for x, y in zip(found, found[1:]) if x == y})
    number = F.col("doc_id").cast("double")  # in doubles nothing overflows, and order is kept
    if len(edges) > 1:
        fine = -(-ranges // (len(edges) - 1))
        cuts = F.array(*[F.lit(x).cast("long") for x in edges[:-1]])
        widths = F.array(*[F.lit(float(b - a)) for a, b in zip(edges, edges[1:])])
        at = F.greatest(F.lit(1), F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))))
        part = ((number - F.element_at(cuts, at).cast("double")) * fine / F.element_at(widths, at)).cast("long")
        range_of = at.cast("long") * fine + F.greatest(F.lit(0).cast("long"), F.least(F.lit(fine - 1).cast("long"), part))
    else:
        range_of = F.lit(0).cast("long")
    range_of = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(range_of)  # greatest() and least() pass over nulls
    # a range of its own for each frequent doc_id, between those below and above it, and 256 by hash inside
    is_often = F.array_contains(F.array(*[F.lit(x).cast("long") for x in often]).cast("array<long>"), F.col("doc_id")) if often else F.lit(False)
    above = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in often]).cast("array<long>"), lambda x: x < F.col("doc_id"))).cast("long") if often else F.lit(0).cast("long")
    order_of = range_of * (2 * len(often) + 2) + F.when(F.col("doc_id").isNull(), 0).otherwise(2 * above + is_often.cast("int"))
    by_hash = F.when(F.coalesce(is_often, F.lit(True)), 255 - F.conv(F.substring("_md5", 1, 2), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    own = own.withColumn("_md5", F.md5(F.col("text").cast("binary")))
    own = own.withColumn("_range", order_of * 256 + by_hash)
    first = F.min(F.struct(F.bitwise_not("doc_id").alias("minus"), "_md5"))  # the highest doc_id: ~x falls as x rises
    tops = own.groupBy("_range").agg(first.alias("m")).collect()  # one row a range
    tops = sorted((row["_range"], row["m"]["minus"], row["m"]["_md5"]) for row in tops)
    extra = [(None if minus is None else ~minus, md5, r, tops[k + 1][0] if k + 1 < len(tops) else tops[0][0], int(k + 1 == len(tops))) for k, (r, minus, md5) in enumerate(tops)]
    extra = own.sparkSession.createDataFrame(extra, "_top long, _hash string, _of long, _to long, _wrap int")
    place = lambda r, copy, wrap: F.struct(r.alias("range"), F.lit(copy).alias("copy"), wrap.alias("wrap"))
    once, again = place(F.col("_range"), 0, F.lit(0)), place(F.col("_to"), 1, F.col("_wrap"))
    dealt = (
        own.join(F.broadcast(extra), (F.col("_range") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_top")) & (F.col("_md5") == F.col("_hash")), "left")
        .withColumn("_place", F.explode(F.when(F.col("_to").isNull(), F.array(once)).otherwise(F.array(once, again))))
        .select(*own.columns, F.col("_place.range").alias("_r"), F.col("_place.copy").alias("_copy"), F.col("_place.wrap").alias("_w"))
    )
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))  # a task's share stays the same
    dealt = dealt.repartition(parts, "_r")
    order = Window.partitionBy("_r").orderBy("_w", F.col("doc_id").desc_nulls_last(), "_md5", "text", "_copy")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("_copy = 0").drop("_r", "_copy", "_w", "_md5", "_range")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last half replaced from the next document), with their likenesses."""
    own = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    own = own.withColumns({"n_chars": F.char_length("text").cast("long"), "fingerprint": fingerprint(F.col("text"))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    out = with_next(own, ["text", "fingerprint"]).withColumn("_edited", edited)
    out = out.withColumns({"edited_sha256": F.sha2(F.col("_edited").cast("binary"), 256), "edited_fingerprint": fingerprint(F.col("_edited"))})
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _sql_fp(x: str) -> str:
    hashes = f"list_transform(string_split({x}, chr(10)), lambda p: sha256(p) || '(' || array_to_string(list_transform(regexp_extract_all(p, '[^\\n]{{1,{BLOCK}}}'), lambda b: left(md5(b), 8)), ' ') || ')')"
    parts = f"string_split(regexp_replace(array_to_string({hashes}, ';'), '([0-3]\\([^)]*\\));', '\\1|', 'g'), '|')"
    of = "sha256(replace(regexp_replace(s, '\\([^)]*\\)', '', 'g'), ';', ' '))"
    tree = f"array_to_string(list_transform({parts}, lambda s: left({of}, 8) || '[' || regexp_replace(s, '([0-9a-f]{{8}})[0-9a-f]{{56}}\\(', '\\1(', 'g') || ']'), '')"
    return f"sha256(array_to_string(list_transform({parts}, lambda s: {of}), ' ')) || ':' || {tree}"


def _sql_near(a: str, b: str) -> str:
    """A subquery: sections, paragraphs of the sections that differ, blocks of the paragraphs that differ."""
    sections_of = lambda f: f"list_distinct(list_filter(string_split(substr({f}, 66), ']'), lambda s: s <> ''))"
    paragraphs = lambda x: f"list_distinct(list_filter(flatten(list_transform({x}, lambda s: string_split(substr(s, 10), ';'))), lambda p: p <> ''))"
    blocks_of = lambda x: f"list_filter(flatten(list_transform({x}, lambda p: string_split(regexp_extract(p, '\\(([^)]*)\\)', 1), ' '))), lambda b: b <> '')"
    less = lambda x, y: f"list_filter({x}, lambda i: NOT list_contains({y}, i))"
    p1, p2 = paragraphs(less("x", "y")), paragraphs(less("y", "x"))
    return f"""CASE WHEN left({a}, 64) = left({b}, 64) THEN 1.0::DOUBLE ELSE (
      SELECT coalesce((n + len(list_intersect(u, v)))::DOUBLE * 2.0 / nullif(n * 2 + len(u) + len(v), 0)::DOUBLE, 0.0) FROM (
        SELECT n + len({blocks_of("list_intersect(p, q)")}) AS n, list_distinct({blocks_of(less("p", "q"))}) AS u, list_distinct({blocks_of(less("q", "p"))}) AS v FROM (
          SELECT len({blocks_of(paragraphs("list_intersect(x, y)"))}) AS n, {p1} AS p, {p2} AS q FROM (SELECT {sections_of(a)} AS x, {sections_of(b)} AS y)))) END"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(text), text) AS r, length(text) AS n FROM d),
e AS (SELECT a.doc_id, a.n, a.text, b.text AS nxt, substr(a.text, 1, a.n - a.n // 2) || substr(b.text, 1, a.n // 2) AS edited
      FROM o a JOIN o b ON b.r = CASE WHEN a.r = (SELECT max(r) FROM o) THEN 1 ELSE a.r + 1 END),
f AS (SELECT doc_id, n, sha256(edited) AS edited_sha256, {_sql_fp("text")} AS fingerprint, {_sql_fp("edited")} AS edited_fingerprint, {_sql_fp("nxt")} AS nf FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
       {_sql_near("fingerprint", "edited_fingerprint")} AS near_edited, {_sql_near("fingerprint", "nf")} AS near_next FROM f
"""
