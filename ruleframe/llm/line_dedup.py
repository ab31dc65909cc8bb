"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two lines within ``edits`` insertions, deletions and substitutions share one of ``edits + 1`` segments of the shorter line, at
a place in the longer one that its length and the segment's number bound. So every distinct line is an entry of ``edits + 1``
index lists, keyed by (length, segment number, segment), and probes those of each length it may meet with the few substrings
that can match. Where many lines share a segment, a pair leaves the join only if its 3-grams differ by no more than the edits
can change. Pairs that most pieces of one line bear out are verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.llm.common import Scratch, checked_broadcast


def segment(chars: Column, number: int, edits: int) -> tuple[Column, Column]:
    """(start from 1, length) of segment ``number`` (from 0) of a line of ``chars`` characters; the last segments take the rest."""
    parts = edits + 1
    base, extra = F.floor(chars / parts).cast("int"), (chars % parts).cast("int")
    longer = number - (parts - extra)
    return 1 + number * base + F.greatest(longer, F.lit(0)), base + F.when(longer >= 0, 1).otherwise(0)


def keys(line: Column, chars: Column, edits: int, shorter: int, probes: bool) -> list[Column]:
    """The index keys of a line; with ``probes``, the keys of its substrings that the segments of a line ``shorter`` characters
    shorter can match."""
    out = []
    for number in range(edits + 1):
        start, size = segment(chars - shorter, number, edits)
        low, high = max(-number, shorter - (edits - number)), min(number, shorter + edits - number)
        out += [F.xxhash64(chars - shorter, F.lit(number), F.substring(line, start + shift, size)) for shift in (range(low, high + 1) if probes else [0])]
    return out


#: Index lists of more lines than this are hot.
HOT_LINES = 8


def gram_bits(line: Column, longs: int = 4) -> Column:
    """Parity bits of a line's 3-grams, 64 a field w0, w1, ...: on if an odd number of 3-grams has the bit. An edit takes three 3-grams away and
    brings three at most, so it turns six bits at most."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(line) - 2, F.lit(1))), lambda i: F.xxhash64(F.substring(line, i, F.lit(3))))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    part = lambda h: F.pmod(F.shiftright(h, 6), F.lit(longs))
    zero = F.struct(*(F.lit(0).cast("long").alias(f"w{k}") for k in range(longs)))
    return F.aggregate(grams, zero, lambda s, h: F.struct(*(s[f"w{k}"].bitwiseXOR(F.when(part(h) == k, bit(h)).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(longs))))


def pieces_found(a: Column, b: Column, edits: int) -> Column:
    """How many of ``2 * (edits + 2)`` pieces of ``a`` stand in ``b`` where up to ``edits`` edits can have moved them. An edit spoils one piece at most."""
    parts, n = 2 * (edits + 2), F.length(a)
    out = F.lit(0)
    for k in range(parts):
        start, end = F.floor(n * k / parts).cast("int") + 1, F.floor(n * (k + 1) / parts).cast("int") + 1
        piece = F.substring(a, start, end - start)
        hits = [(start + shift >= 1) & (F.substring(b, start + shift, end - start) == piece) for shift in range(-edits, edits + 1)]
        found = hits[0]
        for h in hits[1:]:
            found = found | h
        out = out + F.when(found, 1).otherwise(0)
    return out


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of ``a`` and ``b`` is at most ``edits``; the lengths differ by no more than that and exceed it.

    One word holds the band: at text position i, bit k stands for pattern row i - edits - 1 + k. The vertical differences move
    down the diagonal with each character, the distance follows the band's lowest row, and then the last row."""
    # the characters are bound once by a lambda, as an expression would be computed anew at each use
    return F.element_at(F.transform(F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"))), lambda s: banded(s["x"], s["y"], edits)), 1)


def banded(x: Column, y: Column, edits: int) -> Column:
    rows, width = F.size(x), 2 * edits + 2
    full, top = (1 << width) - 1, width - 1

    def match(c: Column, i: Column) -> Column:
        bits = [F.when(F.get(x, i - edits + k) == c, F.lit(1 << (k + 1)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(2 * edits + 1)]
        total = bits[0]
        for bit in bits[1:]:
            total = total.bitwiseOR(bit)
        return F.struct(total.alias("m"), i.alias("i"))

    def step(s: Column, e: Column) -> Column:
        m, vp, vn = e["m"], s["vp"], s["vn"]
        d0 = ((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(F.lit(full).cast("long"))

        def moved(d: Column) -> Column:
            hp = vn.bitwiseOR(F.lit(full).cast("long") - d.bitwiseOR(vp))
            hn = d.bitwiseAND(vp)
            half = F.shiftright(d, 1)
            past = e["i"] - (rows - edits)  # steps since the band's lowest row passed the last row
            last = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(top - 1 - past, F.lit(0)))
            across = F.when(hp.bitwiseAND(last) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(last) != 0, 1).otherwise(0)
            down = F.when(d.bitwiseAND(F.lit(1 << top).cast("long")) != 0, 0).otherwise(1)
            return F.struct(hn.bitwiseOR(F.lit(full).cast("long") - half.bitwiseOR(hp)).alias("vp"), half.bitwiseAND(hp).alias("vn"), (s["d"] + F.when(past < 0, down).otherwise(across)).alias("d"))

        return F.element_at(F.transform(F.array(d0), moved), 1)

    start = F.struct(F.lit(full - (1 << (top - edits)) + 1).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).alias("d"))
    return F.aggregate(F.transform(y, match), start, step)["d"] <= edits


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, text_hash, place, h1, h2, chars, line)`` for every line of at least ``min_chars`` characters, outer space trimmed."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).withColumn("line", F.btrim("line"))
    return cut.filter(F.length("line") >= min_chars).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "chars": F.length("line")})


def near_line_pairs(docs: DataFrame, scratch: Scratch, edits: int = 2, min_chars: int = 20) -> DataFrame:
    """``(a1, a2, b1, b2)``: the 128-bit names of all pairs of distinct lines within ``edits``."""
    if min_chars < 4 * (edits + 1):
        raise ValueError("lines must have four characters a segment at least")

    lines = lines_of(docs, min_chars).select("h1", "line", "chars")
    listed = lambda ks: F.posexplode(F.array(*ks)).alias("pos", "key")
    index = lines.select("h1", listed(keys(F.col("line"), F.col("chars"), edits, 0, False)))
    index = scratch.keep(index.groupBy("key", F.col("h1").alias("a1")).agg(F.lit(1).alias("n")).select("key", "a1"), "index")
    probing = [keys(F.col("line"), F.col("chars"), edits, shorter, True) for shorter in range(edits + 1)]
    probe = lines.select(F.col("h1").alias("b1"), listed([k for ks in probing for k in ks]))
    # lines of one length probe one another, so one of the two ways is enough
    once = (F.col("pos") >= len(probing[0])) & (F.col("a1") != F.col("b1")) | (F.col("a1") < F.col("b1"))
    # a hot list takes part as one row without a line, which finds its probes
    hot = scratch.keep(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_LINES).select("key"), "hot")
    few = checked_broadcast(hot, hot.count())
    lists = index.join(few, "key", "left_anti").unionAll(hot.select("key", F.lit(None).cast("long").alias("a1")))
    found = scratch.keep(probe.join(lists, "key").filter(F.col("a1").isNull() | once), "found")
    # its lines share a segment and often nothing else: pairs whose 3-grams differ too much never leave the join
    probes = scratch.keep(found.filter("a1 is null").select("key", "pos", "b1").distinct(), "hot-probes")
    lists = scratch.keep(index.join(few, "key", "left_semi"), "hot-lists")
    needed = scratch.keep(probes.select(F.col("b1").alias("h1")).union(lists.select("a1")).distinct(), "hot-lines")
    bits = lines.select("h1", "line").join(checked_broadcast(needed, needed.count()), "h1", "left_semi").groupBy("h1").agg(F.min("line").alias("line"))
    bits = scratch.keep(bits.select("h1", gram_bits(F.col("line")).alias("bits")), "hot-bits")
    left = probes.join(bits.select(F.col("h1").alias("b1"), F.col("bits").alias("b_bits")), "b1")
    right = lists.join(bits.select(F.col("h1").alias("a1"), F.col("bits").alias("a_bits")), "a1").withColumnRenamed("key", "list")
    apart = sum((F.bit_count(F.col(f"a_bits.w{k}").bitwiseXOR(F.col(f"b_bits.w{k}"))) for k in range(4)), F.lit(0))
    met = found.filter("a1 is not null").select("a1", "b1").unionAll(left.join(right, (F.col("key") == F.col("list")) & once & (apart <= 6 * edits)).select("a1", "b1"))
    met = scratch.keep(met.select(F.least("a1", "b1").alias("a1"), F.greatest("a1", "b1").alias("b1")).distinct(), "met")
    wanted = scratch.keep(met.select(F.col("a1").alias("h1")).union(met.select("b1")).distinct(), "wanted")
    texts = lines_of(docs, min_chars).select("h1", "h2", "line").join(checked_broadcast(wanted, wanted.count()), "h1", "left_semi").groupBy("h1", "h2").agg(F.min("line").alias("line"))
    texts = scratch.keep(texts, "texts")
    a, b = (texts.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("line").alias(f"{x}_line")) for x in "ab")
    # lines that share a first hash have texts of their own here, and these decide
    pairs = met.join(a, "a1").join(b, "b1").filter(F.abs(F.length("a_line") - F.length("b_line")) <= edits)
    pairs = pairs.filter(pieces_found(F.col("a_line"), F.col("b_line"), edits) >= edits + 4)
    return scratch.keep(pairs.filter(within(F.col("a_line"), F.col("b_line"), edits)).select("a1", "a2", "b1", "b2"), "near")


def repeated_lines(docs: DataFrame, scratch: Scratch, edits: int = 2, min_chars: int = 20) -> DataFrame:
    """``(doc_id, text_hash, gone)``: for each document that loses lines, the numbers of these lines from 0.

    A line goes when an equal line, or one within ``edits``, stands before it in order of (doc_id, text's hash, line number)."""
    near = near_line_pairs(docs, scratch, edits, min_chars)
    lines = scratch.keep(lines_of(docs, 1).select("doc_id", "text_hash", "place", "h1", "h2"), "lines")
    spot = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "place")
    firsts = lines.groupBy("h1", "h2").agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("n"))
    a, b = (firsts.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("first").alias(f"{x}_first")) for x in "ab")
    later = near.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    after = F.col("a_first") > F.col("b_first")
    later = later.select(F.when(after, F.col("a1")).otherwise(F.col("b1")).alias("h1"), F.when(after, F.col("a2")).otherwise(F.col("b2")).alias("h2")).distinct()
    known = firsts.join(later.withColumn("late", F.lit(True)), ["h1", "h2"], "left").filter("n > 1 or late").select("h1", "h2", "first", "late")
    known = scratch.keep(known, "known")
    gone = lines.join(checked_broadcast(known, known.count()), ["h1", "h2"]).filter(F.col("late") | (spot != F.col("first")))
    return scratch.keep(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("gone")), "gone")  # at most one document's lines


def dedup_lines(docs: DataFrame, scratch: Scratch, edits: int = 2, min_chars: int = 20) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``lines_gone``: how many.

    Compared are lines between line feeds, outer white space trimmed. A line of at least ``min_chars`` characters goes when an equal one or
    one within ``edits`` stands before it, in any document; a shorter one only when an equal one does, as two edits can make another word
    of it; empty lines stay. A line can go because of one that goes itself: of "report 10", "report 12", "report 1234" with two edits each
    from one to the next, only the first stays. A null
    text stays null; a text may become empty. Rows that repeat doc_id and text are one document and get the same text. All
    columns of ``docs`` are kept; ``lines_gone`` replaces a column of that name. No rows give no rows.
    """
    gone = repeated_lines(docs.select("doc_id", "text"), scratch, edits, min_chars)
    found = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("gone").alias("__gone"))
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    out = out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))
    return out.withColumn("lines_gone", F.coalesce(F.size("__gone"), F.lit(0))).drop("__id", "__hash", "__gone")


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"), Scratch(spark, "op1"))
    return out.select("doc_id", "lines_gone", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those that have nothing left but white space go."""
    out = dedup_lines(docs, Scratch(spark, "line-stage")).drop("lines_gone")
    return out.withColumn("n_chars", F.length("text").cast("long")).filter(F.btrim("text") != "").select(*docs.columns)
