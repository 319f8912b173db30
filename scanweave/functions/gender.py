"""Gender from tick-box scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanweave.functions.text import let


def resolve_gender(scores: Column) -> Column:
    """``scores``: array of struct<label, score> in template order, at most one per label.
    Transgender wins only with a clear lead.  Returns struct<gender, confidence>."""

    def of(entries, label):
        return F.coalesce(F.get(F.filter(entries, lambda e: e["label"] == label), F.lit(0))["score"], F.lit(0.0))

    def ranked(entries):
        keyed = F.transform(entries, lambda e, i: F.struct(
            (-e["score"]).alias("k"), i.alias("i"), e["label"].alias("label"), e["score"].alias("score")))
        return F.array_sort(keyed)

    def resolve(entries):
        male, female, third = of(entries, "Male"), of(entries, "Female"), of(entries, "Transgender")
        other = F.greatest(male, female)
        top = ranked(entries)
        first, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
        weak = (first["label"] == "Transgender") & (third < F.greatest(F.lit(0.32), other * 1.35))
        best = F.when(weak, other).otherwise(F.coalesce(first["score"], F.lit(0.0)))
        next_best = F.when(weak, third).otherwise(F.coalesce(second["score"], F.lit(0.0)))
        label = F.when(weak, F.when(male >= female, F.lit("Male")).otherwise(F.lit("Female"))).otherwise(
            F.coalesce(first["label"], F.lit("Male"))
        )
        half = F.least(F.lit(0.99), best / 2.0)
        lead = F.greatest(F.lit(0.0), best - next_best) / 4.0
        return F.struct(
            label.alias("gender"), F.least(F.lit(0.99), half + lead).alias("confidence")
        )

    none = F.array().cast("array<struct<label:string,score:double>>")
    return let(F.coalesce(scores, none), resolve)


def merge_confidence(read_confidence: Column, tick_confidence: Column) -> Column:
    return F.bround(F.greatest(read_confidence, tick_confidence), 4)
