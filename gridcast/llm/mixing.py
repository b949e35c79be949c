"""Mixing sources to target weights by Pareto order sampling.

Targets. Every source has a weight and wants its share of the total; none gets more than `MOST`
times its own words, and what is over is shared again by weight (a water level). The same level
rule then divides a source's target among its length classes, whose documents are wanted the less
often the longer they are.

Sampling. A document wanted 1.3 times is taken once for certain and once more with inclusion
probability 0.3. The documents of a source are ranked by the odds of a random number divided by the
odds of their inclusion probability (Pareto order sampling), and the first ones are taken, as many
as fit into the words that the certain copies leave. Where the sample ends, a few documents that
fit into the remaining gap close it.

The size of the sample is a position in an order over a whole source, and a source may hold a third
of all rows. Ranks are therefore binned; sums per bin, combined on the map side, tell in which bin a
source's sample ends, and rows are ordered within bins only.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast.llm.common import WORD, materialize, uniform
from gridcast.llm.registry import register, table

#: Weights of the sources in code-point order, repeating; null is the last source.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a multiple of all words, and the most that a source or document gives.
SHARE = 1.5
MOST = 2
#: Wanted copies fall by this power of two with every doubling of a document's length.
LENGTH_POWER = 0.125
#: Documents per source that may be added to close the gap at the end of its sample.
CLOSING_ROUNDS = 3
SEED = "mix"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _level(group: list[str], total: Column, cap: Column, weight: Column, tie: Column) -> Column:
    """The largest of these per group is the level at which min(cap, level x weight) sums to `total`, or to all caps.

    Rows stand in ascending cap / weight. With all rows before the k-th at their cap, the rest shares
    what is left by weight; that level rises as long as rows reach their cap and falls after it.
    """
    ranked = Window.partitionBy(*group).orderBy(cap / weight, tie)
    capped = F.coalesce(F.sum(cap).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(weight).over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (total - capped) / left


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target. `sized` has source and size.

    The rank of a source and the level look at all sources at once: a table of one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    weighed = sources.withColumn("weight", F.get(weights, (rank % len(WEIGHTS)).cast("int")))
    everything = Window.partitionBy()
    weighed = weighed.withColumn("total", F.sum("source_size").over(everything) * SHARE).where("source_size > 0")
    cap = F.col("source_size") * float(MOST)
    level = _level([], F.col("total"), cap, F.col("weight"), F.asc_nulls_last("source"))
    raised = weighed.withColumn("level", level).withColumn(
        "target", F.least(cap, F.max("level").over(everything) * F.col("weight"))
    )
    return sources.join(
        raised.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s")), "left"
    ).select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def class_copies(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source and length class: wanted copies per document (`copies`), and the source's columns."""
    classes = sized.where("size > 0").groupBy("source", "class").agg(F.sum("size").alias("class_size"))
    both = targets.select(F.col("source").alias("_s"), "source_size", "target")
    classes = classes.join(both, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cap = F.col("class_size") * float(MOST)
    weight = F.col("class_size") * F.pow(F.lit(2.0), F.col("class") * -LENGTH_POWER)
    level = _level(["source"], F.col("target"), cap, weight, F.col("class"))
    classes = classes.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy("source")))
    return classes.withColumn("copies", F.least(cap, F.col("level") * weight) / F.col("class_size"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    `size` is the number of words (0 for a null text), `target` that of the document's source, and
    `taken` = copies x size with copies of 0, 1 or 2. Null sources are one source, the last one. The
    random numbers are a digest of seed and id, so reruns agree; rows that repeat an id share them and
    are told apart by their place in the written table. Documents without words are never taken. No
    rows give no rows; other columns are ignored.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    sized = sized.withColumn("class", F.length(F.bin("size")) - 1).withColumn("row", F.monotonically_increasing_id())
    sized = materialize(sized, "sized")
    targets = materialize(source_targets(sized), "targets")
    copies = materialize(class_copies(sized, targets), "copies")

    wanted = copies.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "copies")
    sure = copies.groupBy("source").agg(F.sum(F.floor("copies") * F.col("class_size")).alias("sure"))
    room = targets.join(sure.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_t"), (F.round("target") - F.coalesce("sure", F.lit(0))).cast("long").alias("room")
    )
    pi = F.col("copies") - F.floor("copies")
    u = uniform("doc_id", seed=SEED)
    drawn = (
        sized.join(wanted, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c")))
        .where("size > 0")
        .select("row", "doc_id", "source", "size", F.floor("copies").alias("whole"), pi.alias("pi"))
        .withColumn("rank", F.when(F.col("pi") > 0, (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))))
    )
    chosen = materialize(_first_words(drawn, room, sized.count()), "chosen")
    closing = _closed(chosen, room)

    extra = chosen.select("row", (F.col("whole") + F.col("picked").cast("long")).alias("copies"))
    added = closing.select(F.col("row").alias("_row"))
    extra = extra.join(added, F.col("row") == F.col("_row"), "left").select(
        "row", (F.col("copies") + F.col("_row").isNotNull().cast("long")).alias("copies")
    )
    final = sized.join(extra, "row", "left").join(
        targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    )
    count = F.coalesce("copies", F.lit(0)).cast("long")
    return final.select("doc_id", "source", "size", "source_size", "target", count.alias("copies"), (count * F.col("size")).alias("taken"))


def _first_words(drawn: DataFrame, room: DataFrame, rows: int) -> DataFrame:
    """`drawn` with room (of its source) and picked: whether it is among the first by rank that fit into it."""
    bins = max(64, int(rows**0.5))
    place = F.col("rank") / (1 + F.col("rank"))
    binned = drawn.withColumn("bin", F.coalesce(F.least(F.floor(place * bins), F.lit(bins - 1)), F.lit(bins)))
    # rows of no chance stand in the bin after the last
    sums = binned.where("rank IS NOT NULL").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    sums = sums.withColumn(
        "before", F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words")
    ).select(F.col("source").alias("_s"), F.col("bin").alias("_b"), "before")
    joined = binned.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")), "left").drop("_s", "_b")
    joined = joined.join(room, F.col("source").eqNullSafe(F.col("_t"))).drop("_t")
    within = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    ends_here = (F.col("before") <= F.col("room")) & F.col("rank").isNotNull()
    ordered = joined.where(ends_here).withColumn("reached", F.col("before") + F.sum("size").over(within))
    ordered = ordered.withColumn("picked", F.col("reached") <= F.col("room")).drop("reached")
    return ordered.unionByName(joined.where(~F.coalesce(ends_here, F.lit(False))).withColumn("picked", F.lit(False)))


def _closed(chosen: DataFrame, room: DataFrame) -> DataFrame:
    """Rows (source, row, size) that are added: round by round the largest that fits into what is left of the room."""
    used = chosen.where("picked").groupBy("source").agg(F.sum("size").alias("used"))
    gaps = room.join(used, F.col("_t").eqNullSafe(F.col("source")), "left").select(
        F.col("_t"), (F.col("room") - F.coalesce("used", F.lit(0))).alias("gap")
    )
    free = chosen.where(~F.col("picked") & (F.col("whole") < MOST)).select("source", "row", "doc_id", "size", "rank")
    added = None
    for _ in range(CLOSING_ROUNDS):
        open_rows = free if added is None else free.join(added.select("row"), "row", "left_anti")
        fits = open_rows.join(gaps, F.col("source").eqNullSafe(F.col("_t"))).where("size <= gap")
        first = F.struct(-F.col("size"), F.col("rank").isNull(), "rank", "doc_id", "row")
        best = fits.groupBy("source").agg(F.min_by(F.struct("row", "size"), first).alias("best")).select("source", "best.*")
        best = materialize(best, "closing")  # one row per source
        added = best if added is None else added.unionByName(best)
        spent = best.select(F.col("source").alias("_u"), F.col("size").alias("spent"))
        gaps = gaps.join(spent, F.col("_t").eqNullSafe(F.col("_u")), "left").select(
            "_t", (F.col("gap") - F.coalesce("spent", F.lit(0))).alias("gap")
        )
    return added


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with their columns.

    Rows that repeat id and source get their common copies in equal parts, rounded down.
    """
    taken = mix(docs).groupBy("doc_id", "source").agg(F.floor(F.sum("copies") / F.count(F.lit(1))).cast("int").alias("_copies"))
    taken = taken.where("_copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "_copies")
    same = docs["doc_id"].eqNullSafe(taken["_id"]) & docs["source"].eqNullSafe(taken["_source"])
    repeats = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    return docs.join(taken, same).withColumn("_copy", repeats).select(*(docs[c] for c in docs.columns))


def _sql() -> str:
    weights = f"[{', '.join(map(str, map(float, WEIGHTS)))}]"
    rounds, gap, added = [], "gap0", "SELECT NULL::BIGINT AS doc_id WHERE false"
    for k in range(CLOSING_ROUNDS):
        rounds.append(f"""
        best{k} AS (
          SELECT source, doc_id, size FROM (
            SELECT c.source, c.doc_id, c.size, row_number() OVER (PARTITION BY c.source ORDER BY c.size DESC, c.rank NULLS LAST, c.doc_id) AS k
            FROM chosen c JOIN {gap} g ON c.source IS NOT DISTINCT FROM g.source
            WHERE NOT c.picked AND c.whole < {MOST} AND c.size <= g.gap AND c.doc_id NOT IN ({added})
          ) WHERE k = 1
        ),
        gap{k + 1} AS (
          SELECT g.source, g.gap - coalesce(b.size, 0) AS gap FROM {gap} g LEFT JOIN best{k} b ON g.source IS NOT DISTINCT FROM b.source
        )""")
        gap = f"gap{k + 1}"
        added = " UNION ALL ".join(f"SELECT doc_id FROM best{j}" for j in range(k + 1))
    return f"""
    WITH sized AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
    ), sources AS (
      SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
    ), weighed AS (
      SELECT *, {weights}[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight,
             sum(source_size) OVER () * {SHARE}::DOUBLE AS total
      FROM sources
    ), levels AS (
      SELECT *, (total - coalesce(sum(source_size * {MOST}.0::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight::DOUBLE) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM weighed WHERE source_size > 0
      WINDOW w AS (ORDER BY source_size * {MOST}.0::DOUBLE / weight::DOUBLE, encode(source) NULLS LAST)
    ), raised AS (
      SELECT source, least(source_size * {MOST}.0::DOUBLE, max(level) OVER () * weight::DOUBLE) AS target FROM levels
    ), targets AS (
      SELECT s.source, s.source_size, coalesce(r.target, 0.0::DOUBLE) AS target
      FROM sources s LEFT JOIN raised r ON s.source IS NOT DISTINCT FROM r.source
    ), classes AS (
      SELECT z.source, length(bin(z.size)) - 1 AS class, sum(z.size)::BIGINT AS class_size, any_value(t.target) AS target
      FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source WHERE z.size > 0 GROUP BY 1, 2
    ), weights AS (
      SELECT *, class_size * {MOST}.0::DOUBLE AS cap, class_size * pow(2.0::DOUBLE, class * -{LENGTH_POWER}::DOUBLE) AS weight FROM classes
    ), class_levels AS (
      SELECT *, (target - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM weights WINDOW w AS (PARTITION BY source ORDER BY cap / weight, class)
    ), copies AS (
      SELECT source, class, class_size, least(cap, max(level) OVER (PARTITION BY source) * weight) / class_size AS copies FROM class_levels
    ), room AS (
      SELECT t.source, (round(t.target) - coalesce(sum(floor(c.copies) * c.class_size), 0))::BIGINT AS room
      FROM targets t LEFT JOIN copies c ON t.source IS NOT DISTINCT FROM c.source GROUP BY t.source, t.target
    ), drawn AS (
      SELECT z.doc_id, z.source, z.size, floor(c.copies)::BIGINT AS whole, c.copies - floor(c.copies) AS pi,
             (('0x' || substr(md5('{SEED}:' || z.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(16**13)!r}::DOUBLE AS u
      FROM sized z JOIN copies c ON z.source IS NOT DISTINCT FROM c.source AND length(bin(z.size)) - 1 = c.class
      WHERE z.size > 0
    ), ranked AS (
      SELECT *, CASE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS rank FROM drawn
    ), chosen AS (
      SELECT d.*, coalesce(d.rank IS NOT NULL AND sum(CASE WHEN d.rank IS NOT NULL THEN d.size END) OVER (
               PARTITION BY d.source ORDER BY d.rank NULLS LAST, d.doc_id ROWS UNBOUNDED PRECEDING) <= r.room, false) AS picked
      FROM ranked d JOIN room r ON d.source IS NOT DISTINCT FROM r.source
    ), gap0 AS (
      SELECT r.source, r.room - coalesce(sum(c.size) FILTER (c.picked), 0) AS gap
      FROM room r LEFT JOIN chosen c ON r.source IS NOT DISTINCT FROM c.source GROUP BY r.source, r.room
    ), {",".join(rounds)}, added AS ({added})
    SELECT z.doc_id, z.source, z.size, t.source_size, t.target,
           (coalesce(c.whole + c.picked::BIGINT, 0) + (z.doc_id IN (SELECT doc_id FROM added))::BIGINT)::BIGINT AS copies,
           ((coalesce(c.whole + c.picked::BIGINT, 0) + (z.doc_id IN (SELECT doc_id FROM added))::BIGINT) * z.size)::BIGINT AS taken
    FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source LEFT JOIN chosen c ON z.doc_id = c.doc_id
    """


@register("op3_mix_sources", _sql())
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
