"""Inverted index, term statistics and TF-IDF ranking."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofind.functions.scalars import let
from chronofind.operators.grouping import counted, with_positions
from chronofind.plans.compiler import tokens_of


def postings(items: DataFrame, fields: tuple[str, ...] = ("content", "path", "message", "externals")) -> DataFrame:
    """(field, term, id, tf, positions): positions in order. Terms are grouped batch by batch: nothing is shuffled."""
    every = [items.select("id", tokens_of(f).alias("tokens")).mapInArrow(with_positions, "term string, id string, positions array<int>").withColumn("field", F.lit(f)) for f in fields]
    return reduce(lambda a, b: a.unionByName(b), every).select("field", "term", "id", F.size("positions").alias("tf"), "positions")


def term_stats(items: DataFrame, field: str = "content") -> DataFrame:
    """(term, df, tf): the items that hold a term, and how often it stands; one exchange, of sums by task."""
    each = items.select(tokens_of(field).alias("tokens")).mapInArrow(counted, "term string, df long, tf long")
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def ranked(items: DataFrame, terms: list[str], field: str = "content") -> DataFrame:
    """items that hold any of the terms, with a `score`: sum of sqrt(tf) * idf^2 / sqrt(length); idf = 1 + ln(N / (df + 1)).
    One pass counts documents and document frequencies, the second scores: no join. Each pass makes the tokens of a row once."""
    facts = let(tokens_of(field), lambda x: F.struct(F.size(x).alias("n"), *[(F.size(x) - F.size(F.array_remove(x, t))).alias(f"tf{i}") for i, t in enumerate(terms)]))
    tf = [F.col("_facts")[f"tf{i}"] for i in range(len(terms))]
    counts = items.select(facts.alias("_facts")).agg(F.count("*").alias("n"), *[F.count_if(f > 0).alias(f"df{i}") for i, f in enumerate(tf)])
    scored = items.withColumn("_facts", facts).crossJoin(F.broadcast(counts))  # one row of counts
    total = F.lit(0.0)
    for i, f in enumerate(tf):
        idf = 1 + F.ln(F.col("n") / (F.col(f"df{i}") + 1))
        total = total + F.sqrt(f) * idf * idf
    # the test names a count, so that it stays above the join: below it the tokens would be made once more for it
    scored = scored.filter(F.when(F.col("n") > 0, reduce(or_, [f > 0 for f in tf])))
    return scored.withColumn("score", total / F.sqrt(F.col("_facts")["n"])).drop("_facts", "n", *[f"df{i}" for i in range(len(terms))])
