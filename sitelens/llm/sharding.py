"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix. DataFrame operations only.

Who sends how many rows to whom is drawn first: a matrix with the sizes of the input's partitions as row sums and those of
the shards as column sums, as a uniform permutation of all rows would give it. Each partition then permutes its rows and
deals them out by its row of the matrix, and each shard permutes what it got. Every draw is a hash of the seed and of what
it is drawn for, so a task that runs again gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import saved


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def uniform(*parts) -> Column:
    """A number of [0, 1) from a hash of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def hypergeometric(good: Column, bad: Column, n: Column, u: Column) -> Column:
    """How many of ``n`` things, drawn from ``good`` and ``bad`` ones, are good, by inversion at ``u`` of [0, 1).

    Weights go from the likeliest number outwards, each from the last by the ratio of the two, as far as ten standard
    deviations: what lies beyond is less than ``u`` can tell.
    """
    d = lambda c: c.cast("double")
    all_ = d(good) + d(bad)
    sd = F.sqrt(d(n) * (d(good) / all_) * (d(bad) / all_) * ((all_ - d(n)) / F.greatest(all_ - 1, F.lit(1.0))))
    low, high = F.greatest(F.lit(0).cast("long"), n - bad), F.least(n, good)
    middle = F.least(high, F.greatest(low, F.floor((d(n) + 1) * (d(good) + 1) / (all_ + 2)).cast("long")))
    known = F.struct(good.alias("good"), bad.alias("bad"), n.alias("n"), u.alias("u"), low.alias("low"), high.alias("high"), middle.alias("middle"), (F.ceil(sd * 10) + 10).cast("long").alias("reach"))

    def up(x, k):  # the weight of k + 1 over that of k
        return d(x["good"] - k) * d(x["n"] - k) / (d(k + 1) * d(x["bad"] - x["n"] + k + 1))

    none = F.array().cast("array<bigint>")
    step = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

    def draw(x):
        above = F.sequence(x["middle"], F.least(x["high"], x["middle"] + x["reach"]))
        last = F.greatest(x["low"], x["middle"] - x["reach"])
        below = F.when(last < x["middle"], F.sequence(x["middle"] - 1, last, F.lit(-1).cast("long"))).otherwise(none)
        add_above = lambda a, k: F.struct((a["w"] * up(x, k)).alias("w"), (a["sum"] + a["w"]).alias("sum"))
        add_below = lambda a, k: F.struct((a["w"] / up(x, k)).alias("w"), (a["sum"] + a["w"] / up(x, k)).alias("sum"))
        sums = F.struct(F.aggregate(above, step, add_above)["sum"].alias("above"), F.aggregate(below, step, add_below)["sum"].alias("below"))

        def place(s):
            target = x["u"] * (s["above"] + s["below"])
            # How many of the running sums the target has passed is how far from the middle it stands.
            passed = lambda numbers, add, goal: F.aggregate(numbers, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k")), lambda a, k: _let(add(a, k), lambda y: F.struct(y["w"].alias("w"), y["sum"].alias("sum"), (a["k"] + F.when(y["sum"] <= goal, 1).otherwise(0)).alias("k"))))["k"]
            return F.when(target < s["above"], F.least(x["middle"] + passed(above, add_above, target), x["high"])).otherwise(F.greatest(x["middle"] - 1 - passed(below, add_below, target - s["above"]), x["low"]))

        return _let(sums, place)

    return F.when((n == 0) | (good == 0), F.lit(0).cast("long")).when(bad == 0, n).otherwise(_let(known, draw))


def split_counts(wanted: Column, n: Column, *seed) -> Column:
    """Of a population with ``wanted`` rows for each shard, how many for each shard are among ``n`` rows: one draw a shard."""
    start = F.struct(n.alias("n"), F.aggregate(wanted, F.lit(0).cast("long"), lambda a, c: a + c).alias("rest"), F.array().cast("array<bigint>").alias("out"))

    def step(a, j):
        good = F.get(wanted, j)
        return _let(hypergeometric(good, a["rest"] - good, a["n"], uniform(*seed, j)), lambda k: F.struct((a["n"] - k).alias("n"), (a["rest"] - good).alias("rest"), F.concat(a["out"], F.array(k)).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(wanted) - 1), start, step)["out"]


def communication_matrix(sizes: DataFrame, wanted: list[int], seed: int = 0) -> DataFrame:
    """(source, counts): how many rows each source (source from 0 on without gaps, rows) sends to each shard; exact sums both ways.

    By halves: of a range of sources, the counts of the first half are drawn, the second half gets the rest, and so on down
    to single sources, so that no draw waits for more than as many others as the number of sources has binary digits.
    """
    n = sizes.count()
    levels = max(0, (n - 1).bit_length())
    nodes = sizes.sparkSession.range(1).select(F.col("id").alias("node"), F.array(*[F.lit(int(w)).cast("long") for w in wanted]).alias("counts"))
    for level in reversed(range(levels)):
        width = 1 << level
        first = sizes.filter(F.floor(F.col("source") / width) % 2 == 0).groupBy(F.floor(F.col("source") / (2 * width)).cast("long").alias("node")).agg(F.sum("rows").alias("half"))
        drawn = nodes.join(first, "node").withColumn("left", split_counts(F.col("counts"), F.col("half"), F.lit(seed), F.lit(level), F.col("node")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("counts", "left", lambda c, x: c - x).alias("counts")))
        nodes = drawn.select(F.explode(halves).alias("h")).select("h.*").filter(F.col("node") * width < n)
        if level % 6 == 0 and level:
            nodes = saved(nodes, "matrix")  # so that no plan holds more than six levels
    return nodes.select(F.col("node").alias("source"), "counts")


def shuffle_into_shards(rows: DataFrame, shards: int, *, seed: int = 0, rows_a_task: int = 50_000) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (its place there, gapless from 0): a uniform shuffle, shards at most one row apart.

    Repeated rows and nulls of any column are rows as all others; equal rows are dealt singly, as sizes could not be exact
    otherwise. Columns of the names shard and slot are replaced. An empty table gives no rows. A shard is permuted in parts
    of about ``rows_a_task`` rows that lie next to one another by their random keys, so none is ever in one task.
    """
    rows = rows.drop("shard", "slot")
    spark = rows.sparkSession
    numbered = saved(rows.withColumns({"_source": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "numbered")
    found = numbered.groupBy("_source").agg(F.count("*").alias("rows"))
    sizes = saved(found.withColumn("source", (F.row_number().over(Window.orderBy("_source")) - 1).cast("long")), "sources")  # one row for each input partition
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    if not total:
        return numbered.select(*rows.columns, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    wanted = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix(sizes.select("source", "rows"), wanted, seed)
    upto = F.aggregate("counts", F.array(F.lit(0).cast("long")), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c)))
    dealt = sizes.select("_source", "source").join(matrix, "source").select("_source", F.slice(upto, 2, shards).alias("_upto"))
    # Within each source: a random order, of which the first go to the first shard, and so on.
    key = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "_row")
    placed = numbered.select("_source", "_row").withColumn("_k", F.row_number().over(Window.partitionBy("_source").orderBy(key("deal"), "_row")) - 1)
    sent = placed.join(dealt, "_source").select("_row", F.size(F.filter("_upto", lambda e: e <= F.col("_k"))).alias("shard"), key("slot").alias("_key"))
    # Within each shard: another random order, by ranges of the keys.
    bits = max(0, (total // (shards * rows_a_task)).bit_length())
    sent = saved(sent.withColumn("_part", F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0).cast("long")), "sent")
    before = sent.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    slots = sent.withColumn("_at", F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_key", "_row"))).join(before, ["shard", "_part"])
    slots = slots.select("_row", "shard", (F.coalesce("_before", F.lit(0)) + F.col("_at") - 1).alias("slot"))
    return numbered.join(slots, "_row").select(*rows.columns, "shard", "slot")


def write_shards(shuffled: DataFrame, path: str, *, rows_a_file: int = 1_000_000) -> None:
    """Writes shuffled rows as Parquet by shard, each file a run of slots in order."""
    dealt = shuffled.repartition("shard", F.floor(F.col("slot") / rows_a_file)).sortWithinPartitions("shard", "slot")
    dealt.write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)


def op11_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards, counts at most one apart. A null text has the size 1 and the checksum of the empty one."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(docs, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
