"""Streams of symbols: move-to-front ranks and exact bits under a given code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.functions.pointwise import hybrid_uint
from tesselark.operators.orderstats import lehmer
from tesselark.operators.running import running

#: The place after which a symbol does not come again lies behind all places.
NEVER = 1 << 62


def move_to_front(rows: DataFrame) -> DataFrame:
    """(grp, pos, symbol, rank): a symbol's place in a list that begins in order and brings each symbol met to its front.

    ``rows`` has grp, pos (different in a group, not negative) and symbol (not
    negative).  No list is walked.  What lies before a symbol that was met
    before are the symbols met since: of all met before, those that some place
    up to its last one still holds, which are the places before that whose next
    use comes later.  That is a count of inversions among the uses, by the merge
    count that permutations have.  What lies before a symbol not met yet are the
    smaller ones, and the larger ones met.
    """
    order = Window.partitionBy("grp", "symbol").orderBy("pos")
    used = rows.select("grp", "pos", "symbol", F.lag("pos").over(order).alias("last"), F.lead("pos").over(order).alias("next"))
    used = used.withColumn("new", F.col("last").isNull().cast("long"))
    met = running(used, ["grp"], ["pos"], "new").drop("__total")
    # for each use, the uses before it whose next one comes after its own next one
    turned = used.select("grp", (-F.col("pos")).alias("pos"), (-F.coalesce("next", F.lit(NEVER) - F.col("pos"))).alias("value"))
    older = lehmer(turned).select("grp", (-F.col("pos")).alias("last"), F.col("code").alias("held"))
    again = met.where("new = 0").join(older, ["grp", "last"]).select("grp", "pos", "symbol", (F.col("__before") - 1 - F.col("held")).alias("rank"))
    # for each first use, the larger symbols first used before it
    firsts = used.where("new = 1").select("grp", (-F.col("pos")).alias("pos"), (-F.col("symbol")).alias("value"))
    larger = lehmer(firsts).select("grp", (-F.col("pos")).alias("pos"), "code")
    first = used.where("new = 1").join(larger, ["grp", "pos"]).select("grp", "pos", "symbol", (F.col("symbol") + F.col("code")).alias("rank"))
    return again.unionByName(first)


def shannon_code(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, symbol, depth) of a prefix code: each depth is the entropy of its symbol, rounded up; a lone symbol takes none.

    Depths of ceil(log2(total / n)) keep Kraft's bound, so a code with them exists.
    """
    w = Window.partitionBy(*keys)
    shared = counts.withColumn("total", F.sum("n").over(w)).withColumn("kinds", F.count("*").over(w))
    # whole numbers only: the least k with n << k >= total
    depth = F.length(F.bin(F.expr("(total - 1) div n")))
    return shared.select(*keys, "symbol", F.when(F.col("kinds") == 1, 0).otherwise(F.greatest(depth, F.lit(1))).cast("long").alias("depth"))


def symbol_counts(tokens: DataFrame, mapping: DataFrame) -> DataFrame:
    """(cluster, symbol, n) of tokens (context, value, n) under a context map."""
    clustered = tokens.join(mapping, "context")
    return clustered.groupBy("cluster", hybrid_uint(F.col("value")).getField("symbol").alias("symbol")).agg(F.sum("n").alias("n"))


def code_bits(tokens: DataFrame, mapping: DataFrame, code: DataFrame, sections: list[str]) -> DataFrame:
    """(sections, tokens, bits) that streams of tokens take under a code: depths of symbols and extra bits.

    ``tokens`` has the section columns, context, value and n (how often);
    ``mapping`` a cluster for each context, ``code`` cluster, symbol, depth (a
    table of contexts and symbols, not of data).  Equal tokens of a section are
    counted before they move.  A context that has no cluster and a symbol that
    has no code are errors.
    """
    counts = tokens.groupBy(*sections, "context", "value").agg(F.sum("n").alias("n"))
    told = counts.join(mapping.select("context", "cluster"), "context", "left").withColumn("h", hybrid_uint(F.col("value")))
    told = told.withColumn("symbol", F.col("h.symbol")).join(code.select("cluster", "symbol", "depth"), ["cluster", "symbol"], "left")
    depth = F.coalesce("depth", F.raise_error(F.concat(F.lit("no code for value "), F.col("value").cast("string"), F.lit(" of context "), F.col("context").cast("string"))).cast("long"))
    bits = F.col("n") * (depth + F.col("h.extra_count"))
    return told.groupBy(*sections).agg(F.sum("n").alias("tokens"), F.sum(bits).cast("long").alias("bits"))
