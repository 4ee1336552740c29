"""Mixing sources to target weights by Pareto order sampling."""

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.rank import number_rows
from ..session import written

#: Most copies of a document, and so the cap of a source's target over its size.
MOST = 3
#: Classes of ranks in which words are counted before single documents are looked at.
BINS = 1 << 16


def words(text: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, source_rows, target) of every source of (source, size), as a written table.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes; what exceeds
    MOST times a source's size is shared anew by weight. Each round needs two sums over the sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("source_rows"))
    numbered = number_rows(sources, [F.col("source").asc_nulls_last()], "_rn")
    place = F.pmod(F.col("_rn") - 1, F.lit(len(weights))).cast("int")
    sources = written(numbered.select("source", "source_size", "source_rows", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long").alias("weight")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, None
    while True:
        # A source's fair part only grows from round to round, so the capped ones only get more.
        full = F.col("source_size") * MOST <= F.col("weight") * F.lit(share)
        row = sources.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped, share = row["n"], (total - MOST * row["size"]) / row["weight"]
    cap = (F.col("source_size") * MOST).cast("double")
    return sources.select("source", "source_size", "source_rows", F.least(cap, F.col("weight") * F.lit(share)).cast("double").alias("target"))


def copies(
    docs: DataFrame, weights=(1, 2, 3), seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, row, size, source_size, target, copies.

    A source whose target is r times its size takes floor(r) certain copies of each document. The rest of its words comes
    from one more copy of some documents, by Pareto order sampling: with u from a seeded hash of id and text, documents
    rank by (u / (1 - u)) over the odds of their inclusion. These odds are in proportion to their words; the factor that
    makes the sample fill the rest is the same for a whole source and so leaves the order as it is. The first documents are
    taken while their words fit, then, still in rank order, those that fit what is left, until no document of the source does.

    The cut is found by counting words per class of ranks; only the class with the cut is looked at row by row, so no task
    holds a source. What is left then is less than one document, and as few documents as can fill it are gone through in order.

    Null and empty texts have size 0 and take no room. Rows without id are ranked by their text; a null source is a
    source of its own. ``row`` numbers the input rows (or is ``row_col``), so that each of several equal rows has its own decision.
    """
    text = docs[text_col].cast("string")
    row = F.monotonically_increasing_id() if row_col is None else docs[row_col]
    sized = written(
        docs.select(docs[id_col].cast("long").alias("doc_id"), row.alias("row"), docs[source_col].cast("string").alias("source"), words(text).alias("size"),
                    F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc")), "sized",
    )
    goals = targets(sized, weights)
    s, g = sized.alias("s"), goals.alias("g")
    joined = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source")), "left").select("s.*", "source_size", "source_rows", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # 53 random bits, never 0 or 1.
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "crc"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    f = F.col("fraction")
    # Odds of 1 for a document of average length; those without words are of no weight either way.
    odds = F.when(F.col("size") > 0, F.col("size") * F.col("source_rows") / F.col("source_size")).otherwise(1.0)
    ranked = (
        joined.withColumn("certain", F.floor(ratio).cast("int")).withColumn("fraction", ratio - F.col("certain"))
        .withColumn("rank", F.when(f > 0, (u / (1 - u)) / odds))
        .withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
    )
    # Words wanted beyond the certain copies, and the class of ranks in which they are reached.
    classes = ranked.where("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("size"), F.max(f * F.col("source_size")).alias("wanted"))
    upto = Window.partitionBy("source").orderBy("bin")
    cut = (
        classes.withColumn("upto", F.sum("size").over(upto)).where("upto > wanted")
        .groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("before"), "wanted")).alias("cut"))
        .select("source", F.col("cut.bin").alias("cut_bin"), (F.col("cut.wanted") - F.col("cut.before")).alias("rest"))
    )
    cut = written(cut, "cut")
    r, c = ranked.alias("r"), cut.alias("c")
    placed = r.join(c, F.col("r.source").eqNullSafe(F.col("c.source")), "left").select("r.*", "cut_bin", "rest")
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "crc", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = written(placed.where("bin = cut_bin").withColumn("upto", F.sum("size").over(order)), "edge")
    fits = F.when(F.col("upto") <= F.col("rest"), F.col("upto"))
    gaps = edge.groupBy("source").agg((F.max("rest") - F.coalesce(F.max(fits), F.lit(0))).alias("gap"))
    open_ = ["source", "size", "rank", "bin", "doc_id", "crc", "row"]
    left = placed.where("bin > cut_bin").select(*open_).unionByName(edge.where("upto > rest").select(*open_))
    more = _filled(left.where("size > 0"), written(gaps, "gaps"))
    out = ["doc_id", "row", "size", "source_size", "target", "certain"]
    first = F.coalesce(F.col("bin") < F.col("cut_bin"), F.col("rank").isNotNull())
    decided = placed.where("cut_bin is null or bin is null or bin <> cut_bin").select(*out, first.alias("extra")).unionByName(
        edge.select(*out, (F.col("upto") <= F.col("rest")).alias("extra"))
    )
    extra = F.col("extra") | F.col("filler").isNotNull()
    decided = decided.join(more.select(F.col("row").alias("filler")), F.col("row") == F.col("filler"), "left")
    return decided.select("doc_id", "row", "size", "source_size", "target", (F.col("certain") + extra.cast("int")).alias("copies"))


def _filled(left: DataFrame, gaps: DataFrame) -> DataFrame:
    """(source, size, row) of the rows that fill the gaps (source, gap), in rank order.

    Of each source, and of sizes within a factor of 2, only the first ones whose words would fill the gap alone can matter.
    They are gone through in order, which leaves a smaller gap; a shorter document further on may still fit, so this is
    repeated until none does. A row that was gone through is taken or longer than the gap from then on, so what a round leaves
    are the later classes of ranks, as far as they still fit; each round writes them, and they get fewer.
    """
    found, seen = None, None
    left = left.withColumn("octave", F.floor(F.log2("size")).cast("int"))
    own = left.columns
    while True:
        rows = left.alias("l").join(gaps.alias("g"), F.col("l.source").eqNullSafe(F.col("g.source"))).where("size <= gap").select("l.*", "gap")
        if seen is not None:
            same = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.octave") == F.col("s.octave"))
            rows = rows.alias("r").join(seen.alias("s"), same, "left").where("_last is null or bin > _last").select("r.*")
        rows = written(rows, "open")
        upto = Window.partitionBy("source", "octave").orderBy("bin")
        bins = rows.groupBy("source", "octave", "bin").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
        enough = bins.withColumn("upto", F.sum("words").over(upto)).where("upto - words < gap").select(
            F.col("source").alias("_source"), F.col("octave").alias("_octave"), F.col("bin").alias("_bin")
        )
        near = F.col("source").eqNullSafe(F.col("_source")) & (F.col("octave") == F.col("_octave")) & (F.col("bin") == F.col("_bin"))
        wanted = rows.join(enough, near, "left_semi").select("source", "size", "rank", "doc_id", "crc", "row", "gap")
        ordered = wanted.repartition("source").sortWithinPartitions("source", "rank", "doc_id", "crc", "row")
        taken = written(ordered.mapInArrow(_in_order, ordered.select("source", "size", "row").schema), "filled")
        found = taken if found is None else found.unionByName(taken)
        if taken.isEmpty():
            return found
        used = taken.groupBy("source").agg(F.sum("size").alias("used"))
        g, t = gaps.alias("g"), used.alias("t")
        gaps = g.join(t, F.col("g.source").eqNullSafe(F.col("t.source"))).select("g.source", (F.col("gap") - F.col("used")).alias("gap"))
        gaps = written(gaps, "gaps")
        seen = written(enough.groupBy(F.col("_source").alias("source"), F.col("_octave").alias("octave")).agg(F.max("_bin").alias("_last")), "seen")
        left = rows.select(*own)


def _in_order(batches):
    """The rows that fit, of rows ordered by source and rank."""
    source, gap, started = None, 0.0, False
    for batch in batches:
        at = []
        sources, sizes, gaps = (batch.column(c).to_pylist() for c in ("source", "size", "gap"))
        for k, (own, size, room) in enumerate(zip(sources, sizes, gaps)):
            if not started or own != source:
                source, gap, started = own, room, True
            if size <= gap:
                gap -= size
                at.append(k)
        yield batch.select(["source", "size", "row"]).take(pa.array(at, pa.int64()))


def mix(docs: DataFrame, weights=(1, 2, 3), seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Rows are told apart by their place in their files, so each of several equal rows follows its own decision.
    """
    rows = _placed(docs)
    chosen = copies(rows, weights, seed, id_col, text_col, source_col, "_mix_row").where("copies > 0").select(F.col("row").alias("_mix_own"), F.col("copies").alias("_mix_n"))
    taken = rows.join(chosen, F.col("_mix_row") == F.col("_mix_own"))
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), "_mix_n"))).select(*[rows[c] for c in docs.columns])


def _placed(docs: DataFrame) -> DataFrame:
    """The rows with ``_mix_row``, which stays the same when they are read again: file and place in it, for a table that is
    read from Parquet files; the result of other work is written and numbered first."""
    try:
        return docs.withColumn("_mix_row", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    except AnalysisException:
        return written(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mixed")
