"""Corruption statistics: mutations of archive bytes, classes of outcomes, campaign cells with score intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def xor_byte(content, at: Column, mask: int = 255) -> Column:
    """The bytes with the one at a 0-based place changed."""
    c = F.col(content) if isinstance(content, str) else content
    place = (at + 1).cast("int")
    old = F.conv(F.hex(F.substring(c, place, F.lit(1))), 16, 10).cast("int")
    new = F.unhex(F.lpad(F.hex(old.bitwiseXOR(F.lit(mask))), 2, "0"))
    return F.concat(F.substring(c, F.lit(1), at.cast("int")), new, F.substring(c, place + 1, F.octet_length(c)))


def drop_suffix(content, n: Column) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.substring(c, F.lit(1), F.greatest(F.lit(0), F.octet_length(c) - n).cast("int"))


def sniper_positions(size: Column) -> Column:
    """The first byte, those at each quarter, and the last, of a payload of ``size`` bytes."""
    quarter = lambda k: (size * k - F.pmod(size * k, F.lit(4))) / 4
    return F.array(F.lit(0).cast("long"), *(quarter(k).cast("long") for k in (1, 2, 3)), (size - 1).cast("long"))


def sample_size(z: float, margin: Column) -> Column:
    """Trials for a score interval of half width ``margin`` at rate one half."""
    return F.ceil(F.lit(z * z) / (4 * margin * margin)).cast("long")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """(low, high) of the Wilson score interval of k of n, 0 and 1 exactly at the ends."""
    p, z2 = k / n, z * z
    centre, spread = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = (centre - spread) / (1 + z2 / n), (centre + spread) / (1 + z2 / n)
    return F.struct(F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low)).alias("low"), F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), high)).alias("high"))


def tool_class(code: Column) -> Column:
    """What a tool's exit code says of an archive."""
    return F.when(code == 0, "valid").when(code == 1, "damaged").when(code == 69, "unverifiable").otherwise("tool-error")


def tool_verdict(code: Column, output: Column) -> Column:
    """As ``tool_class``, if the output has exactly one line with a verdict; a tool that says nothing, or twice, has failed."""
    lines = F.size(F.filter(F.split(output, "\\r?\\n"), lambda x: x.startswith("Validation:")))
    return F.when(lines == 1, tool_class(code)).otherwise("tool-error")


def reference_class(code: Column, diagnostics: Column) -> Column:
    """What another reader's exit code and messages say of an archive. Codes: 0 no error, 1 a warning, 3 a checksum differs, 13 the file
    can't be read."""
    lines = F.split(diagnostics, "\\r?\\n")
    says = lambda text: F.coalesce(F.array_contains(lines, text), F.lit(False))
    ends, comment = says("Unexpected end of archive"), says("The archive comment is corrupt")  # fixed values: messages of that reader
    bad = F.coalesce(F.exists(lines, lambda x: x.rlike("^ERROR: Bad archive .")), F.lit(False))
    damaged = ((code == 0) & comment) | (code == 3) | ((code == 1) & ends) | ((code == 13) & bad)
    return F.when(damaged, "damaged").when((code == 0) & ~ends, "valid").otherwise("tool-error")


def mutation_pair(reference: Column, tool: Column) -> Column:
    """Verdicts on one mutant by a reference and by a tool that are both meant to be strict."""
    both = reference.isin("valid", "damaged") & tool.isin("valid", "damaged")
    good = F.when(tool == "valid", "benign").otherwise("stricter")
    return F.when(~both, "inconclusive").when(reference == "valid", good).when(tool == "valid", "missed").otherwise("detected")


def until_target(trials: DataFrame, *by: str, order: str, target: int = 385) -> DataFrame:
    """The trials that a campaign runs: in each cell, in their order, up to the one that brings the eligible ones (detected, missed or
    unverifiable) to ``target``, and at most four times as many."""
    w = Window.partitionBy(*by).orderBy(order)
    eligible = F.when(F.col("outcome").isin("detected", "missed", "unverifiable"), 1).otherwise(0)
    before = F.sum(eligible).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = trials.withColumns({"_before": F.coalesce(before, F.lit(0)), "_at": F.row_number().over(w)})
    return rows.filter((F.col("_before") < target) & (F.col("_at") <= 4 * target)).drop("_before", "_at")


def execution_class(code: Column) -> Column:
    """How a process ended that didn't end by itself; null otherwise."""
    return F.when(code == 124, "timeout").when(code == 137, "killed").when(code.between(134, 139), "crash").when(code.between(125, 127), "launch")


def pair_outcome(tool: Column, reference: Column) -> Column:
    """A tool's verdict on a mutant beside that of a reference."""
    return (
        F.when(~reference.isin("valid", "damaged") | (tool == "tool-error"), "inconclusive").when((reference == "damaged") & (tool == "damaged"), "detected").when((reference == "damaged") & (tool == "unverifiable"), "unverifiable")
        .when(reference == "damaged", "missed").when(tool == "valid", "survived").otherwise("disagreement")
    )


def cells(trials: DataFrame, *by: str, target: int = 385, z: float = 1.959963984540054) -> DataFrame:
    """Counts of outcomes, detection rate and its interval for each cell of a campaign."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    rows = trials.groupBy(*by).agg(F.count("*").alias("trials"), n("detected").alias("detected"), n("missed").alias("missed"), n("unverifiable").alias("unverifiable"), n("detected", "missed", "unverifiable").alias("eligible"))
    interval = wilson(F.col("detected"), F.col("eligible"), z)
    rows = rows.withColumn("rate", F.when(F.col("eligible") > 0, F.col("detected") / F.col("eligible"))).withColumn("i", F.when(F.col("eligible") > 0, interval))
    return rows.select("*", F.col("i.low").alias("low"), F.col("i.high").alias("high"), (F.col("eligible") >= target).alias("precision_met")).drop("i")


def z_of(confidence: float) -> float:
    """The two-sided normal quantile, by bisection on the error function."""
    lo, hi = 0.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid / math.sqrt(2)) < confidence else (lo, mid)
    return (lo + hi) / 2
