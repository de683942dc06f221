"""Filling containers of fixed capacity with documents (p7): bulk-synchronous best fit, largest first.

A text larger than the capacity is cut into full pieces, each with a container of its own, and a rest; nothing else is cut.
Very small pieces are tied into bundles of at most an eighth of the capacity. Units of one size can stand for each other, and
so can containers of one history, so the sweeps run over runs: a size with the ranks of its units, a gap with the numbers of
its containers. Runs number at most as many as the capacity has tokens, times the sweeps, whatever the corpus holds; the rows
themselves are ranked and joined with the runs' placements once, at the end.

Per octave of sizes from the largest down, a sweep sorts units and open gaps by size; every unit seeks the next larger gap,
conflicts are settled by rank, and the gaps shrink. Sweeps repeat until no unit fits any open gap; only then do the largest
open as few containers as could do, and the sweeps go on; what then still waits is laid into containers end to end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.sizes import sized
from quarryline.session import cut, new_folder, running_start

OCTAVES = 4
BUCKETS = 256
_RUNS = "what string, kind string, capacity int, value int, run string, at long, n long, start long"


def pieces(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """``kind, capacity, doc_id, piece, tokens, whole``: per container kind, every document's pieces. ``containers`` has one
    row a kind; kinds that are null or hold nothing are left aside. A text without tokens has one empty piece."""
    kinds = containers.where("container_kind is not null and capacity_tokens > 0").groupBy(F.col("container_kind").alias("kind")).agg(F.max("capacity_tokens").cast("int").alias("capacity")).collect()
    each = F.explode(F.array(*[F.struct(F.lit(r["kind"]).alias("kind"), F.lit(r["capacity"]).alias("capacity")) for r in kinds]) if kinds else F.array().cast("array<struct<kind:string,capacity:int>>"))
    rows = sizes.select("doc_id", "tokens", each.alias("k")).select("doc_id", "tokens", "k.kind", "k.capacity")
    last = F.floor(F.greatest(F.col("tokens") - 1, F.lit(0)) / F.col("capacity")).cast("int")
    rows = rows.withColumn("last", last).withColumn("piece", F.explode(F.sequence(F.lit(0), "last")))
    held = F.when(F.col("piece") < F.col("last"), F.col("capacity")).otherwise(F.col("tokens") - F.col("last") * F.col("capacity")).cast("int")
    return rows.select("kind", "capacity", "doc_id", "piece", held.alias("tokens")).withColumn("whole", F.col("tokens") == F.col("capacity"))


# One statement, so it is analysed once a sweep. At equal sizes the gap comes first, as "gap" sorts before "unit".
_SWEEP = """
WITH placed AS (
  SELECT *, sum(if(what = 'gap', n, -n)) OVER (PARTITION BY kind ORDER BY value DESC, what, run, at ROWS UNBOUNDED PRECEDING) - if(what = 'gap', n, 0L) AS low FROM {runs}),
leveled AS (
  SELECT *, greatest(1, floor((max(low + n) OVER (PARTITION BY kind) - min(low) OVER (PARTITION BY kind)) / 256)) AS width FROM placed),
ends AS (
  SELECT kind, point, floor(point / width) AS stretch, lead(point) OVER (PARTITION BY kind ORDER BY point) - point AS length
  FROM (SELECT DISTINCT kind, width, explode(array(low, low + n)) AS point FROM leveled)),
parts AS (
  SELECT /*+ BROADCAST(e) */ l.what, l.kind, l.capacity, l.value, l.run, l.at + e.point - l.low AS at, e.point, e.length
  FROM (SELECT *, explode(sequence(floor(low / width), floor((low + n - 1) / width))) AS stretch FROM leveled) l
  JOIN ends e ON l.kind = e.kind AND l.stretch = e.stretch AND e.point >= l.low AND e.point < l.low + l.n WHERE e.length > 0),
beside AS (
  SELECT *, lag(struct(what, run, at)) OVER place AS before, lead(struct(what, value)) OVER place AS next FROM parts
  WINDOW place AS (PARTITION BY kind, point ORDER BY value DESC, what, run, at)),
after AS (
  SELECT if(what = 'unit' AND before.what = 'gap', 'placed', what) AS what, kind, capacity,
    int(if(what = 'gap' AND next.what = 'unit', value - next.value, value)) AS value,
    CASE WHEN what = 'gap' THEN run WHEN before.what = 'gap' THEN before.run END AS run,
    at, length AS n, if(what = 'unit' AND before.what = 'gap', before.at, NULL) AS start FROM beside),
marked AS (
  SELECT *, if(lag(at + n) OVER own = at AND lag(coalesce(at - start, 0L)) OVER own = coalesce(at - start, 0L), 0, 1) AS fresh
  FROM after WHERE value > 0 WINDOW own AS (PARTITION BY kind, what, value, run ORDER BY at, start)),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY kind, what, value, run ORDER BY at, start ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT what, kind, capacity, value, run, min(at) AS at, sum(n) AS n, min(start) AS start FROM islands GROUP BY kind, what, capacity, value, run, island
"""


def _swept(runs: DataFrame) -> DataFrame:
    """One sweep: from large to small, every unit takes the smallest gap that holds it and that no unit before it took.

    That is how brackets match: gaps open, units close. The count of gaps less units before a run gives the levels that the
    run covers; the levels are cut where any run begins or ends, and on each stretch a unit's gap is the run right before it.
    Runs that continue each other become one again. All of it is partitioned by kind, as ``runs`` are; the ends that are
    broadcast are two a run at most, and runs are bounded by the capacity.
    """
    return runs.sparkSession.sql(_SWEEP, runs=runs)


def _opened(runs: DataFrame, step: str, most: int | None) -> DataFrame:
    """The largest units open containers, as few as could hold all units that wait; a container holds at most ``most``."""
    units = runs.where("what = 'unit'")
    before = Window.partitionBy("kind").orderBy(F.desc("value"), "at").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("kind")
    least = F.ceil(F.sum(F.col("value") * F.col("n")).over(everything) / F.col("capacity"))
    if most:
        least = F.greatest(least, F.ceil(F.sum("n").over(everything) / F.lit(most)))
    ranked = units.withColumn("_least", least).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = ranked.withColumn("opens", F.greatest(F.least(F.col("n"), F.col("_least") - F.col("_before")), F.lit(0)))
    name = F.concat_ws(".", F.lit(step), F.col("value").cast("string"), F.col("at").cast("string"))
    nothing = F.lit(None).cast("long")
    placed = F.struct(F.lit("placed").alias("what"), F.col("value"), name.alias("run"), F.col("at"), F.col("opens").alias("n"), F.lit(0).cast("long").alias("start"))
    gap = F.struct(F.lit("gap").alias("what"), (F.col("capacity") - F.col("value")).cast("int").alias("value"), name.alias("run"), F.lit(0).cast("long").alias("at"), F.col("opens").alias("n"), nothing.alias("start"))
    waits = F.struct(F.lit("unit").alias("what"), F.col("value"), F.lit(None).cast("string").alias("run"), (F.col("at") + F.col("opens")).alias("at"), (F.col("n") - F.col("opens")).alias("n"), nothing.alias("start"))
    made = ranked.select("kind", "capacity", F.explode(F.array(placed, gap, waits)).alias("x")).select("x.what", "kind", "capacity", "x.value", "x.run", "x.at", "x.n", "x.start")
    return made.where("n > 0 and value > 0").unionByName(runs.where("what = 'gap'"))


def _reopened(runs: DataFrame, step: str) -> DataFrame:
    """Opens containers for all units that still wait: as many of a size as a container holds share one; what is left of each
    size, fewer units than that, is laid end to end and cut by containers. Units on a cut wait."""
    units = runs.where("what = 'unit'").withColumn("_q", F.floor(F.col("capacity") / F.col("value"))).withColumn("_bins", F.floor(F.col("n") / F.col("_q")))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    name = F.concat_ws(".", F.lit(step), F.col("value").cast("string"), F.col("at").cast("string"))
    shared = F.when(F.col("_bins") > 0, F.transform(F.sequence(F.lit(0), F.col("_q") - 1), lambda i: F.struct(F.lit("placed").alias("what"), F.col("value"), name.alias("run"), (F.col("at") + i * F.col("_bins")).alias("at"), F.col("_bins").alias("n"), zero.alias("start"))))
    gap = F.when(F.col("_bins") > 0, F.array(F.struct(F.lit("gap").alias("what"), (F.col("capacity") - F.col("_q") * F.col("value")).cast("int").alias("value"), name.alias("run"), zero.alias("at"), F.col("_bins").alias("n"), none.alias("start"))))
    empty = F.array().cast("array<struct<what:string,value:int,run:string,at:bigint,n:bigint,start:bigint>>")
    full = units.select("kind", "capacity", F.explode(F.concat(F.coalesce(shared, empty), F.coalesce(gap, empty))).alias("x"))
    rest = units.withColumn("_left", F.col("n") - F.col("_bins") * F.col("_q")).where("_left > 0").withColumn("at", F.explode(F.sequence(F.col("at") + F.col("_bins") * F.col("_q"), F.col("at") + F.col("n") - 1)))
    before = Window.partitionBy("kind").orderBy(F.desc("value"), "at").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("_from", F.coalesce(F.sum("value").over(before), F.lit(0))).withColumn("start", F.floor(F.col("_from") / F.col("capacity")))
    rest = rest.withColumn("_fits", F.floor((F.col("_from") + F.col("value") - 1) / F.col("capacity")) == F.col("start"))
    held = F.sum(F.when(F.col("_fits"), F.col("value")).otherwise(0)).over(Window.partitionBy("kind", "start"))
    rest = rest.withColumn("_room", (F.col("capacity") - held).cast("int")).withColumn("_first", F.row_number().over(Window.partitionBy("kind", "start").orderBy(F.desc("_fits"), F.desc("value"), "at")) == 1)
    one, row = F.lit(1).cast("long"), F.lit(f"{step}.rest")
    unit = F.struct(F.when(F.col("_fits"), "placed").otherwise("unit").alias("what"), F.col("value"), F.when(F.col("_fits"), row).alias("run"), F.col("at"), one.alias("n"), F.when(F.col("_fits"), F.col("start")).alias("start"))
    room = F.struct(F.lit("gap").alias("what"), F.col("_room").alias("value"), row.alias("run"), F.col("start").alias("at"), one.alias("n"), none.alias("start"))
    laid = rest.select("kind", "capacity", F.explode(F.when(F.col("_first") & F.col("_fits"), F.array(unit, room)).otherwise(F.array(unit))).alias("x"))
    made = full.unionByName(laid).select("x.what", "kind", "capacity", "x.value", "x.run", "x.at", "x.n", "x.start").where("value > 0")
    return made.unionByName(runs.where("what = 'gap'"))


def _standing(kinds: list[str]) -> list[Column]:
    """Per kind, the least unit that waits and the largest open gap, as aggregates."""
    ends = ((F.min, "unit", "least"), (F.max, "gap", "most"))
    return [f(F.when((F.col("kind") == k) & (F.col("what") == what), F.col("value"))).alias(f"{name}_{i}") for i, k in enumerate(kinds) for f, what, name in ends]


def _judged(found: dict) -> tuple[bool, bool]:
    """Whether units wait, and whether one of them fits an open gap."""
    least = {k.removeprefix("least_"): v for k, v in found.items() if k.startswith("least_") and v is not None}
    return bool(least), any((found[f"most_{i}"] or 0) >= v for i, v in least.items())


def _plain(spark: SparkSession, kinds: int) -> SparkSession:
    """A session of its own for the sweeps. Their plans are small, alike and many, so planning them anew while they run would
    cost the driver more than the sweeps."""
    own = spark.newSession()
    for name, value in {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(kinds), "spark.sql.ui.explainMode": "simple"}.items():
        own.conf.set(name, value)
    return own


def placements(sizes: DataFrame) -> DataFrame:
    """``kind, value, at, n, run, start``: the units of a size with ranks from ``at`` go, one each, into the ``n`` containers
    of ``run`` from number ``start``. ``sizes`` has ``kind, capacity, value, n``, one row a size."""
    spark, at = sizes.sparkSession, new_folder(sizes.sparkSession)
    kinds = sorted(r["kind"] for r in cut(sizes, at).select("kind").distinct().collect())
    own = _plain(spark, max(1, len(kinds)))
    sizes, state = own.read.schema(sizes.schema).parquet(at), own.createDataFrame([], _RUNS)
    folder, parts = new_folder(spark), 0
    for octave in range(OCTAVES if kinds else 0):
        last = octave == OCTAVES - 1
        sized_so = F.col("value") <= F.col("capacity") / 2**octave
        if not last:
            sized_so = sized_so & (F.col("value") > F.col("capacity") / 2 ** (octave + 1))
        units = sizes.where(sized_so).select(F.lit("unit").alias("what"), "kind", "capacity", "value", F.lit(None).cast("string").alias("run"), F.lit(0).cast("long").alias("at"), "n", F.lit(None).cast("long").alias("start"))
        state = state.unionByName(units)
        openings = 0
        waiting, fits = _judged(state.coalesce(1).agg(*_standing(kinds)).first().asDict())
        while waiting:
            state = state.repartition(len(kinds), "kind")  # the one shuffle of a sweep
            if fits:
                made = _swept(state)
            else:
                step = f"{octave}.{openings}"
                made = _reopened(state, step) if openings else _opened(state, step, None if last else 2 ** (octave + 1) - 1)
                openings += 1
            seen = Observation()  # what stands after a sweep is seen while it is written
            made, parts = cut(made.observe(seen, *_standing(kinds)), f"{folder}/{parts:04d}"), parts + 1
            state = made.where("what <> 'placed'")
            waiting, fits = _judged(seen.get)
    every = spark.read.schema(_RUNS).parquet(f"{folder}/*") if parts else spark.createDataFrame([], _RUNS)  # one scan
    return every.where("what = 'placed'").select("kind", "value", "at", "n", "run", "start")


def fitted(units: DataFrame) -> DataFrame:
    """``kind, id, container`` for ``units`` (``kind, capacity, id, value``), each smaller than the capacity.

    Units are ranked within their size by hash buckets, so a size that most of them share is spread over all tasks.
    """
    placed = cut(placements(units.groupBy("kind", "capacity", "value").agg(F.count("*").alias("n"))))
    ranked = running_start(units.select("kind", "id", "value"), ["kind", "value"], F.pmod(F.xxhash64("id"), F.lit(BUCKETS)), [F.col("id")], F.lit(1), BUCKETS)
    rank = F.col("r.start")
    both = ranked.alias("r").join(placed.alias("p"), (F.col("r.kind") == F.col("p.kind")) & (F.col("r.value") == F.col("p.value")) & (rank >= F.col("p.at")) & (rank < F.col("p.at") + F.col("p.n")))
    number = F.col("p.start") + rank - F.col("p.at")
    return both.select("r.kind", "r.id", F.concat_ws(":", F.col("r.kind"), F.col("p.run"), number.cast("string")).alias("container"))


def packed(documents: DataFrame, containers: DataFrame, path: str | None = None) -> DataFrame:
    """``container_kind, container_id, doc_id, piece, tokens``: every piece of every document, once per container kind.

    A text without tokens takes no room and has a null container. Documents of equal id are taken as they come; null ids
    are left aside; an empty table gives no rows.
    """
    all_pieces = cut(pieces(sized(documents, path=path), containers))
    own = F.concat_ws(":", "kind", F.col("doc_id").cast("string"), F.col("piece").cast("string"))
    alone = all_pieces.where("whole or tokens = 0").withColumn("container", F.when(F.col("whole"), own))
    loose = all_pieces.where("not whole and tokens > 0")
    small = F.col("tokens") * 16 <= F.col("capacity")
    chunk = running_start(loose.where(small), ["kind"], F.pmod(F.xxhash64("doc_id"), F.lit(256)), [F.col("doc_id"), F.col("piece")], F.col("tokens"))
    bundled = chunk.withColumn("id", F.concat_ws(":", F.lit("bundle"), "kind", F.floor(F.col("start") * 16 / F.col("capacity")).cast("string"))).drop("start")
    units = cut(loose.where(~small).withColumn("id", own).unionByName(bundled))
    whole = units.groupBy("kind", "capacity", "id").agg(F.sum("tokens").cast("int").alias("value"))
    placed = units.join(fitted(cut(whole)), ["kind", "id"]).drop("id")
    rows = alone.unionByName(placed.select(*alone.columns))
    return rows.select(F.col("kind").alias("container_kind"), F.col("container").alias("container_id"), "doc_id", "piece", "tokens")


def fill(packed_rows: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container kind: containers, the least number that could do, tokens and the share of room used."""
    totals = packed_rows.where("container_id is not null").groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"))
    kinds = totals.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    joined = kinds.join(containers.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity")), "container_kind")
    return joined.select("container_kind", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
