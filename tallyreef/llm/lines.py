"""Near-duplicate lines within an edit distance, by even segments and substring indexes, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C


#: White space around lines.
_BLANKS = " \t\r\f\v\u0085 "

#: Bytes of a character in UTF-32, in which substrings are found by arithmetic rather than by walking the text.
_WIDE = 4


def _segment(length: Column, i: Column, parts: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th (from 0) of even segments; the last ones are the longer ones."""
    short = F.floor(length / parts).cast("int")
    even = parts - length % parts
    return (i * short + F.greatest(F.lit(0), i - even)).cast("int"), (short + F.when(i >= even, 1).otherwise(0)).cast("int")


def _key(before: Column, i: Column, wide: Column, at: Column, size: Column) -> Column:
    return F.xxhash64(before.cast("long"), i, F.substr(wide, at * _WIDE + 1, size * _WIDE))


def _keyed(lines: DataFrame, edits: int) -> DataFrame:
    """Rows (id, key, probe) of lines: their segments, and the substrings that can match a segment of a line of less
    characters or as many.

    With i segments before it and edits - i after it, a segment's match is shifted by i at most seen from the left, and by
    edits - i from the right; only shifts within both are probed. What stands unshifted in a line of the same length is
    the line's own segment, and is given once. Ways are rows rather than expressions: the method that Spark generates for
    an expression of each is too long for the JVM to compile.
    """
    shifts = (lambda less, i: range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1))
    ways = F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less in range(edits + 1) for i in range(edits + 1) for shift in shifts(less, i)])
    # explode of a single array: the text is turned once and not for every way
    rows = lines.select("id", "n", F.explode(F.array(F.encode("line", "UTF-32"))).alias("wide")).select("*", F.explode(ways).alias("w")).select("id", "n", "wide", "w.*")
    start, size = _segment(F.col("n") - F.col("less"), F.col("i"), F.lit(edits + 1))
    rows = rows.withColumns({"from": start, "size": size}).withColumn("at", F.col("from") + F.col("shift")).where(f"n - less > {edits} AND at >= 0 AND at + size <= n")
    return rows.select("id", _key(F.col("n") - F.col("less"), F.col("i"), F.col("wide"), F.col("at"), F.col("size")).alias("key"), F.expr("less > 0 OR shift <> 0").alias("probe"))


def _finer(rows: DataFrame, wide: DataFrame, edits: int) -> DataFrame:
    """Rows (id, key, probe, regions) whose keys are split by what the first region of rows holds.

    A region is a stretch still to be compared: own characters from start on, against so many of theirs, those of the indexed line,
    within so many edits. It is cut as a line is. Beside the segment that matches, the stretch before it has as many edits
    as segments, and the one after it the others, so both are regions. Those too short to be cut are left open.
    """
    ways = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for t in range(1, edits + 1) for i in range(t + 1) for shift in range(-i, i + 1)])
    rows = rows.select("*", F.get("regions", F.lit(0)).alias("r"), F.slice("regions", 2, F.size("regions")).alias("others")).select("id", "key", "probe", "r.*", "others")
    rows = rows.join(wide, "id").select("*", F.explode(ways).alias("w")).select("*", "w.*").where("edits = t AND abs(own - theirs - shift) <= t - i")
    start, size = _segment(F.col("theirs"), F.col("i"), F.col("t") + 1)
    rows = rows.withColumns({"from": start, "size": size}).withColumn("at", F.col("from") + F.col("shift")).where("at >= 0 AND at + size <= own")
    left = F.struct("start", F.col("at").alias("own"), F.col("from").alias("theirs"), F.col("i").alias("edits"))
    right = F.struct(F.expr("start + at + size").alias("start"), F.expr("own - at - size").alias("own"), F.expr("theirs - from - size").alias("theirs"), F.expr("t - i").alias("edits"))
    rows = rows.select("id", _key(F.col("key"), F.col("i"), F.col("wide"), F.col("start") + F.col("at"), F.col("size")).alias("key"), F.expr("probe OR shift <> 0").alias("probe"), F.concat("others", F.array(left, right)).alias("regions"))
    return rows.withColumn("regions", F.filter("regions", lambda r: (r.edits > 0) & (r.theirs > r.edits)))


def _shared(rows: DataFrame) -> DataFrame:
    """key, members: keys under which lines can meet, and how many lines have them as their own segments."""
    own, probes = F.count_if(~F.col("probe")).alias("members"), F.count_if("probe").alias("probes")
    return rows.groupBy("key").agg(own, probes).where("members > 1 OR (members > 0 AND probes > 0)").drop("probes")


#: Characters that are counted together. Any classes would do; these are of like frequency in Latin text.
_CLASSES = ["eE", "tT", "aA", "oO", "iI", "nN", "sS", "hHrR", "dDlL", "uUcC", "wWmMfFgGyY", "pPbBvVkKjJxXqQzZ", "0123456789", " "]


def _counted(lines: DataFrame) -> DataFrame:
    """Lines with how many characters of each class they hold: an edit changes two of the counts by one at most."""
    return lines.withColumns({f"c{k}": F.length("line") - F.length(F.translate("line", of, "")) for k, of in enumerate(_CLASSES)})


def _near(rows: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """(a, b), a < b, of lines under one key, own segments with each other and with probes, that are within edits edits."""
    told = rows.select("key", "id", "probe").join(lines.drop("n"), "id").repartition(C.n_partitions(lines.sparkSession), "key")
    one, two = told.where(~F.col("probe")).alias("one"), told.alias("two")
    met = "one.key = two.key AND (one.id < two.id OR two.probe AND one.id <> two.id)"
    apart = " + ".join(f"abs(one.c{k} - two.c{k})" for k in range(len(_CLASSES)))
    near = one.join(two, F.expr(f"{met} AND {apart} <= {2 * edits}") & (F.levenshtein("one.line", "two.line", edits) >= 0))
    return near.select(F.least("one.id", "two.id").alias("a"), F.greatest("one.id", "two.id").alias("b"))


def links(lines: DataFrame, edits: int, crowd: int = 64) -> DataFrame:
    """Pairs (a, b) of ids of lines (id, n, line) that are within edits edits, as a table of the shared folder.

    Keys are counted first, so that only rows under a key that lines share are dealt and verified. A key that is the own segment
    of more than crowd lines is split by segments of what stands before and after the one that matched, in rounds,
    until crowd or fewer are left or no more than edits characters of each stretch are open. So what is verified grows with
    rows and not with the square of a key's lines, and no pair within edits is lost. Counts of characters settle most pairs
    before their edits are counted. Keys grow with the lines, so no step needs all of them in one place.
    """
    rows = _keyed(lines, edits)
    shared = C.keep(_shared(rows), "keys")
    met = C.keep(rows.join(shared.hint("merge"), "key"), "met")
    held = C.keep(_counted(lines.join(met.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")), "held")
    found = [C.keep(_near(met.where(F.col("members") <= crowd), held, edits), "near")]
    crowded, spare = met.where(F.col("members") > crowd), [shared, met, held]
    if not crowded.isEmpty():
        wide, less = held.select("id", F.encode("line", "UTF-32").alias("wide")), F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("less")
        whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("own"), (F.col("n") - F.col("less")).alias("theirs"), F.lit(edits).alias("edits")))
        rows = held.join(crowded.select("id").distinct(), "id", "left_semi").select("id", "n", less)
        rows = rows.select("id", (F.col("n") - F.col("less")).cast("long").alias("key"), (F.col("less") > 0).alias("probe"), whole.alias("regions"))
        met = C.keep(_finer(rows, wide, edits).join(crowded.select("key").distinct(), "key", "left_semi"), "rows")
        full = F.size("regions") > 0
        while True:
            spare.append(met)
            found.append(C.keep(_near(met.where(~full), held, edits), "near"))
            rows = met.where(full)
            if rows.isEmpty():
                break
            finer = C.keep(_finer(rows, wide, edits), "rows")
            met = C.keep(finer.join(_shared(finer), "key"), "met")
            spare.append(finer)
            full = (F.col("members") > crowd) & (F.size("regions") > 0)
    out = C.keep(reduce(DataFrame.unionByName, found).distinct(), "linked")
    C.drop(*spare, *found)
    return out


def classes(docs: DataFrame, edits: int = 2, least: int | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, times, line_id, class_id, keep: one row for each different line of each document.

    Lines are what stands between line ends, without white space around; blank ones are left out. line_no is the line's
    first place in the document from 0, times how often it stands there, line_id its 64-bit hash. Lines are linked if one
    becomes the other by edits or fewer insertions, deletions and replacements of characters; lines of fewer than least
    characters are linked to equal ones only: without least those of edits characters or fewer, as any two of them are within
    edits. class_id is the least line_id of those joined by links. keep is true for
    one line of each class: of the documents with the least id the line of the least hash; the others repeat it. Null and
    empty texts have no lines; rows that repeat an id are one document; a null id counts as one, and is less than
    any other; further columns are left out.

    Equal lines become one before any are compared. A line's edits + 1 even segments, by its length, are its index; other lines
    probe with the substrings that could match one of them (edits touch at most as many segments, so one is whole); crowded
    segments are split by what stands beside them. Those that meet are verified where they meet with the built-in edit distance, which
    looks at a band as wide as the threshold. Links are joined into classes by rounds of joins.
    """
    least = edits + 1 if least is None else least
    ident = F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63)))
    lines = docs.select(ident.alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "raw"))
    lines = lines.select("doc_id", "line_no", F.trim("raw", F.lit(_BLANKS)).alias("line")).where("line <> ''")
    texts = lines.groupBy("line").agg(F.min("doc_id").alias("first_doc"))
    texts = C.keep(texts.select(F.xxhash64("line").alias("id"), F.length("line").alias("n"), "first_doc", "line"), "lines")
    whole = texts.where(F.col("n") >= least).select("id", "n", "line")
    linked = links(whole, edits)
    roots = C.components(linked)
    known = texts.select("id", "n", "first_doc").join(roots, texts.id == roots.node, "left").select("id", "n", "first_doc", F.coalesce("root", "id").alias("class_id"))
    joined = known.join(roots.select(F.col("root").alias("class_id")).distinct(), "class_id", "left_semi")
    low = joined.groupBy(F.col("class_id").alias("low_class")).agg(F.min("first_doc").alias("low_doc"))
    first = joined.join(low, (F.col("class_id") == F.col("low_class")) & (F.col("first_doc") == F.col("low_doc"))).groupBy("low_class").agg(F.min("id").alias("keep_id"), F.min("low_doc").alias("keep_doc"))
    known = known.join(first, F.col("class_id") == F.col("low_class"), "left").select("id", "n", "class_id", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("keep_doc", "first_doc").alias("keep_doc"))
    at = lines.select("doc_id", "line_no", F.xxhash64("line").alias("id"), F.length("line").alias("n")).groupBy("doc_id", "id", "n").agg(F.min("line_no").cast("long").alias("line_no"), F.count("*").alias("times"))
    out = at.join(known, ["id", "n"]).select(F.nullif("doc_id", F.lit(-(2**63))).alias("doc_id"), "line_no", "times", F.col("id").alias("line_id"), "class_id", ((F.col("doc_id") == F.col("keep_doc")) & (F.col("id") == F.col("keep_id"))).alias("keep"))
    out = C.keep(out, "line-classes")
    C.drop(texts, linked, roots)
    return out
