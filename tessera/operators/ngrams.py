"""A character n-gram model as tables, and beam search with it, a step of all sequences at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import table

BEGIN = "\u0002"  # stands before each text


class BackOff:
    """Witten-Bell back-off model of single characters given the `order` - 1 before them.

    `grams` holds (h, c, p) for each seen pair of a context h and a next character c, p being its log10 probability; `weights` holds (h, w) for each seen
    context, the log10 weight that its unseen characters take to the context without its first character. A character that
    was never seen has the share of one new character of the shortest context, `unseen`."""

    def __init__(self, texts: DataFrame, order: int = 3):
        self.order = order
        t = texts.select(F.concat(F.lit(BEGIN), "text").alias("t")).filter("t is not null")
        grams = weights = below = None
        for n in range(1, order + 1):
            # a pattern that only looks ahead finds overlapping runs in one pass; the runs are counted before they are shuffled
            runs = t.select(F.explode(F.regexp_extract_all("t", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))).alias("g"))
            seen = runs.groupBy("g").agg(F.count("*").alias("n")).select(F.expr(f"substring(g, 1, {n - 1})").alias("h"), F.expr("right(g, 1)").alias("c"), "n").filter(F.col("c") != BEGIN)
            seen = table(seen)
            total = seen.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            if n == 1:
                kinds, count = seen.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
                self.unseen = 1 / (kinds + 1)
                rest = seen.withColumn("q", F.lit(self.unseen))
                self.unseen *= kinds / max(1, count + kinds)
            else:
                rest = seen.withColumn("s", F.expr("substring(h, 2)")).join(below.select(F.col("h").alias("s"), "c", F.col("p").alias("q")), ["s", "c"])
            level = table(rest.join(total, "h").select("h", "c", ((F.col("n") + F.col("kinds") * F.col("q")) / (F.col("total") + F.col("kinds"))).alias("p")))
            weight = total.select("h", F.log10(F.col("kinds") / (F.col("total") + F.col("kinds"))).alias("w")).filter("h <> ''")
            grams, weights = (level, weight) if grams is None else (grams.unionByName(level), weights.unionByName(weight))
            below = level
        self.grams, self.weights = table(grams.withColumn("p", F.log10("p"))), table(weights)

    def scored(self, rows: DataFrame) -> DataFrame:
        """`rows` (context: what stands before, c, ...) with `lm`: the log10 probability of c."""
        out = rows
        for k in range(self.order - 1, -1, -1):
            out = out.withColumn("_h", F.right("context", F.lit(k)) if k else F.lit(""))
            # a context shorter than k has been looked up already
            out = out.withColumn("_h", F.when(F.length("_h") == k, F.col("_h")))
            out = out.join(self.grams.select(F.col("h").alias("_h"), "c", F.col("p").alias(f"_p{k}")), ["_h", "c"], "left")
            out = out.join(self.weights.select(F.col("h").alias("_h"), F.col("w").alias(f"_w{k}")), "_h", "left").drop("_h")
        score = F.coalesce("_p0", F.lit(self.unseen_log()))
        for k in range(1, self.order):
            score = F.coalesce(F.col(f"_p{k}"), F.coalesce(f"_w{k}", F.lit(0.0)) + score)
        return out.withColumn("lm", score).drop(*(f"_{x}{k}" for x in "pw" for k in range(self.order)))

    def unseen_log(self) -> float:
        import math

        return math.log10(self.unseen) if self.unseen > 0 else -99.0


def beam_decode(emissions: DataFrame, model: BackOff, width: int = 5, labels: int = 10, weight: float = 1.0, id_col: str = "id") -> DataFrame:
    """(id, text, score): the best text of each sequence of emissions (id, step from 0, c, p: natural log probability of the character).

    Each step goes on with the `labels` likeliest characters, digits left out; a text's score is the sum of its characters' log
    probabilities and of `weight` times their log10 probabilities by the model. `width` texts are kept a step, those first in the alphabet among
    equals. All sequences take a step in one job; a sequence that has no further step, or only digits, keeps its texts."""
    best = Window.partitionBy(id_col, "step").orderBy(F.desc("p"), "c")
    allowed = emissions.withColumn("k", F.row_number().over(best)).filter((F.col("k") <= labels) & ~F.col("c").rlike("^[0-9]$"))
    allowed = table(allowed.select(id_col, "step", "c", "p"))
    beam = emissions.select(id_col).distinct().select(id_col, F.lit("").alias("text"), F.lit(0.0).alias("score"))
    last = allowed.agg(F.max("step")).first()[0]
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), "text")
    for step in range(0 if last is None else last + 1):
        now = allowed.filter(F.col("step") == step).select(id_col, "c", "p")
        on = beam.join(now, id_col).withColumn("context", F.right(F.concat(F.lit(BEGIN), "text"), F.lit(max(1, model.order - 1))))
        on = model.scored(on).select(id_col, F.concat("text", "c").alias("text"), (F.col("score") + F.col("p") + weight * F.col("lm")).alias("score"))
        kept = on.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= width).drop("k")
        beam = table(kept.unionByName(beam.join(now.select(id_col).distinct(), id_col, "left_anti")))
    return beam.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def spaced(text: Column) -> Column:
    """Text as the model takes it: lower case, blanks as &."""
    return F.replace(F.lower(text), F.lit(" "), F.lit("&"))
