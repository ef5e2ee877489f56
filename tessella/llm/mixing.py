"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Every source is a stream of words: its documents in hashed order, repeated up to ``most`` times.  The part the
mix takes is cut into equal blocks.  Slots of the mix are points of the golden-ratio sequence; a point falls
into the interval of one source among the cumulative shares, and the r-th slot of a source takes its r-th block
in shuffled order.  So every stretch of the mix is close to the shares, and each source gives exactly its target.

No window is over a whole source: positions are sums over (source, hash prefix) groups plus sums within a group,
slot ranks likewise over runs of slots.  Only the table with one row per source is ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, kept
from tessella.session import join_side_table

#: Points are n * GOLDEN modulo ONE: 2^31 divided by the golden ratio, made odd so that no point comes twice.
ONE, GOLDEN = 2**31, 1327217885
RUN = 4096


def _numbered(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of ``docs`` as the column doc, and a row_id."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.monotonically_increasing_id().alias("row_id"))


def _measured(rows: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("doc.text", F.lit(WORD)), F.lit(0)).cast("long")
    sk = F.coalesce(F.concat(F.lit("0"), F.col("doc.source").cast("string")), F.lit("1"))
    key = F.md5(F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")))
    return kept(rows.select("doc.doc_id", "doc.source", sk.alias("sk"), size.alias("size"), key.alias("key"), F.xxhash64("doc.text").alias("h"), "row_id"))


def sized(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, sk (orders sources by code point, null last), size in words, order key.

    A null text has size 0.  Rows that repeat a doc_id stay rows of their own (row_id); a null doc_id is ordered
    as if it were the empty text.
    """
    return _measured(_numbered(docs, ["doc_id", "source", "text"]))


def targets(rows: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sk, source_size, weight and target of every source.

    Sources in order weigh ``weights``, repeating, and share all words.  A target stops at ``most`` times its
    source, and the excess goes to the others by weight: with sources ordered by limit / weight, the level at
    which nobody exceeds is the largest of (words left) / (weight left).
    """
    per = rows.groupBy("sk").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("sk")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    before = Window.orderBy(F.col("limit") / F.col("weight"), "sk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words_left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", words_left.cast("double") / weight_left.cast("double"))
    per = per.withColumn("level", F.max("level").over(whole))
    target = F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight"))
    return per.select("sk", "source_size", "weight", target.alias("target"))


def positions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``begin``, the words of its source that come before it in hashed order."""
    digits = max(1, math.ceil(math.log(max(rows.count(), 1) / RUN, 16)))
    rows = rows.withColumn("part", F.substring("key", 1, digits))
    sums = rows.groupBy("sk", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sk").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("sk", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("sk", "part").orderBy("key", "h", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.join(base, ["sk", "part"]).withColumn("begin", F.col("base") + F.col("within")).drop("part", "base", "within")


def schedule(per: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Slots of the mix (slot, sk and the block of the source it takes), and per source its taken words and block width."""
    spark = per.sparkSession
    live = per.withColumn("taken", F.round("target").cast("long")).where("taken > 0")
    order = Window.orderBy("sk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = F.sum("taken").over(order).cast("double") / F.sum("taken").over(whole)
    live = live.withColumn("hi", F.floor(upto * ONE).cast("long")).withColumn("nth", F.row_number().over(Window.orderBy("sk")))
    live = kept(live.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sk")), F.lit(0))))
    words, sources = live.agg(F.coalesce(F.sum("taken"), F.lit(0)), F.count("*")).first()
    slots = -(-words // block_words)
    cell = ONE >> max(10, math.ceil(math.log2(max(sources, 1))) + 2)
    point = (F.col("id") % ONE) * GOLDEN % ONE
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.floor(F.col("x") / cell))
    cells = live.where("hi > lo").select("sk", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell"))
    hit = points.join(cells, "cell").where("x >= lo AND x < hi").select("slot", "sk")
    # one more slot for every source at the end, so that none with a target stays without
    hit = hit.unionByName(live.select((F.col("nth") + slots).alias("slot"), "sk"))
    hit = kept(hit.withColumn("run", F.floor(F.col("slot") / RUN)))
    runs = hit.groupBy("sk", "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sk").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = hit.withColumn("nth", F.row_number().over(Window.partitionBy("sk", "run").orderBy("slot")) - 1).join(runs, ["sk", "run"])
    counts = hit.groupBy("sk").agg(F.count("*").alias("slots"))
    wide = live.join(counts, "sk").select("sk", "taken", "slots", F.expr("ceil(taken / slots)").cast("long").alias("width"))
    # a stride without a common divisor visits every block once
    stride = F.when(F.col("slots") % 1_000_003 == 0, F.lit(998_244_353)).otherwise(F.lit(1_000_003)).cast("long")
    rank = F.col("base") + F.col("nth")
    return join_side_table(ranked, wide, ["sk"], "inner", ["slot"]).select("slot", "sk", ((rank * stride) % F.col("slots")).alias("block")), wide


def mix(rows: DataFrame, per: DataFrame, block_words: int = 256) -> DataFrame:
    """The mix as pieces of documents: slot, row_id, doc_id, source, repeat, first_word, words; order by slot.

    rows: ``sized``; per: ``targets``.  An empty table gives no pieces; documents without words are in none.
    """
    slots, wide = schedule(per, block_words)
    of_source = wide.select("sk", "taken", "width").join(per.select("sk", "source_size"), "sk")
    placed = join_side_table(positions(rows).where("size > 0"), of_source, ["sk"], "inner", ["row_id"])
    turn = F.explode(F.expr("sequence(0L, (taken - 1) div source_size)")).alias("repeat")
    turns = placed.select("row_id", "doc_id", "source", "sk", "taken", "width", "source_size", "begin", "size", turn)
    turns = turns.withColumn("from", F.col("begin") + F.col("repeat") * F.col("source_size")).where("from < taken")
    turns = turns.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("taken")))
    pieces = turns.select("*", F.explode(F.expr("sequence(`from` div width, (`to` - 1) div width)")).alias("block"))
    start, end = F.expr("greatest(`from`, block * width)"), F.expr("least(`to`, (block + 1) * width)")
    pieces = pieces.select("row_id", "doc_id", "source", "sk", "repeat", "block", (start - F.col("from")).alias("first_word"), (end - start).alias("words"))
    return pieces.join(slots, ["sk", "block"]).select("slot", "row_id", "doc_id", "source", "repeat", "first_word", "words")


def mix_report(docs: DataFrame, block_words: int = 256, most: int = 3) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    rows = sized(docs)
    per = kept(targets(rows, most))
    taken = mix(rows, per, block_words).groupBy("row_id").agg(F.sum("words").alias("taken"))
    out = join_side_table(rows.join(taken, "row_id", "left"), per, ["sk"], "inner", ["row_id"])
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = 256, most: int = 3) -> DataFrame:
    """``docs`` as the mix takes them: a document comes once for each whole turn, and once more, cut to its first
    words, if its source's last turn ends inside it; documents that are not taken go.  Rows that repeat are rows of their own.

    The columns stay; n_chars of a cut document is counted anew.
    """
    base = kept(_numbered(docs, docs.columns))
    rows = _measured(base)
    per = kept(targets(rows, most))
    turns = mix(rows, per, block_words).groupBy("row_id", "repeat").agg(F.sum("words").alias("words")).join(rows.select("row_id", "size"), "row_id")
    whole, part = F.col("words") == F.col("size"), F.when(F.col("words") < F.col("size"), F.col("words"))
    turns = turns.groupBy("row_id").agg(F.sum(whole.cast("int")).cast("int").alias("whole"), F.max(part).alias("part"))
    copies = F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("whole")), F.when(F.col("part").isNotNull(), F.array("part")).otherwise(F.array().cast("array<bigint>")))
    out = base.join(turns, "row_id").select("doc", F.explode(copies).alias("words")).select("doc.*", F.col("words").alias("_words"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_words").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("_words").isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_words").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
