"""URL verdicts by host and path rules, and by two smoothed variable-order Markov models for the rest.

URLs that a rule allows or blocks are the accepted and the rejected ones. Of each, the counts of every
character after up to two others give Witten-Bell estimates: an estimate leans on the longest context
as far as it was seen and on the next shorter one for the rest. A URL's score is the difference of the
two log-likelihoods, divided by its length; the threshold is calibrated on ruled URLs that were left out
of the counts. Everything is DataFrame operations. The model is an array of ``SIZE ** 3`` log ratios,
whatever the input, and stands in the plan as a constant; a URL is scored by one fold over its
characters, in its row: no join, no exchange.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import materialize

#: The rules of the query, host and path, with their verdicts.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: '^' stands before the first character, '0' for digits, '~' for any other character.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0/.-_~"
SIZE = len(ALPHABET)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Width of a calibration bin, and the bins' range.
BIN, MOST = 0.02, 500
#: Ruled URLs whose digest begins with one of these are left out of the counts, for the calibration.
LEFT_OUT = "012"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host (or a parent of it) and the begin of the path, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one overrides
        own, slash, below = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + below)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def codes_of(host: Column, path: Column) -> Column:
    """The codes of a URL's characters."""
    text = F.translate(F.concat(host, path), UPPER + "0123456789", LOWER + "0000000000")
    plain = F.regexp_replace(text, "[^a-z0/._-]", "~")
    return F.transform(F.filter(F.split(plain, ""), lambda x: x != ""), lambda x: F.instr(F.lit(ALPHABET), x) - 1)


def _grams(urls: DataFrame) -> DataFrame:
    """urls with a row for each character of host and path: gram is made of its code and of the two before it."""
    coded = urls.withColumn("__codes", codes_of(F.col("host"), F.col("path")))

    def before(i, n):
        return F.coalesce(F.get("__codes", i - n), F.lit(0))

    grams = F.transform("__codes", lambda x, i: (before(i, 2) * SIZE + before(i, 1)) * SIZE + x)
    return coded.withColumn("gram", F.explode(F.transform(grams, lambda g: g.cast("long")))).drop("__codes")


def score_of(codes: Column, ratios: list[float]) -> Column:
    """The mean log ratio of a URL's characters; null without one."""
    model = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # folded to one constant

    def step(state, code):
        gram = (state["context"] * SIZE + code) % SIZE**3
        return F.struct(gram.alias("context"), (state["total"] + F.get(model, gram)).alias("total"))

    folded = F.aggregate(codes, F.struct(F.lit(0).alias("context"), F.lit(0.0).alias("total")), step)
    return F.when(F.size(codes) > 0, folded["total"] / F.size(codes))


def log_ratios(labelled: DataFrame) -> DataFrame:
    """gram -> llr of all SIZE ** 3 grams, from a table (verdict, gram) of allow and block."""
    spark = labelled.sparkSession
    counts = labelled.groupBy("verdict", "gram").agg(F.count(F.lit(1)).alias("n3"))
    seen = materialize(counts.select("verdict", F.expr(f"gram div {SIZE * SIZE}").alias("a"), F.expr(f"(gram div {SIZE}) % {SIZE}").alias("b"), F.expr(f"gram % {SIZE}").alias("c"), "n3"), "grams")
    two = seen.groupBy("verdict", "b", "c").agg(F.sum("n3").alias("n2"))
    one = seen.groupBy("verdict", "c").agg(F.sum("n3").alias("n1"))
    after3 = seen.groupBy("verdict", "a", "b").agg(F.sum("n3").alias("t3"), F.count(F.lit(1)).alias("u3"))
    after2 = two.groupBy("verdict", "b").agg(F.sum("n2").alias("t2"), F.count(F.lit(1)).alias("u2"))
    after1 = one.groupBy("verdict").agg(F.sum("n1").alias("t1"))
    grid = spark.range(SIZE**3).select(
        F.col("id").alias("gram"), F.expr(f"id div {SIZE * SIZE}").alias("a"), F.expr(f"(id div {SIZE}) % {SIZE}").alias("b"), F.expr(f"id % {SIZE}").alias("c"), F.explode(F.array(F.lit("allow"), F.lit("block"))).alias("verdict")
    )
    for part, keys in ((seen, ["verdict", "a", "b", "c"]), (two, ["verdict", "b", "c"]), (one, ["verdict", "c"]), (after3, ["verdict", "a", "b"]), (after2, ["verdict", "b"]), (after1, ["verdict"])):
        grid = grid.join(F.broadcast(part), keys, "left")
    filled = grid.fillna(0, ["n1", "n2", "n3", "t1", "t2", "t3", "u2", "u3"])
    p1 = (F.col("n1") + 1) / (F.col("t1") + SIZE)
    p2 = (F.col("n2") + F.col("u2") * p1) / (F.col("t2") + F.col("u2"))
    estimated = filled.withColumn("p1", p1).withColumn("p2", F.when(F.col("t2") > 0, p2).otherwise(F.col("p1")))
    p3 = (F.col("n3") + F.col("u3") * F.col("p2")) / (F.col("t3") + F.col("u3"))
    logs = estimated.select("gram", "verdict", F.ln(F.when(F.col("t3") > 0, p3).otherwise(F.col("p2"))).alias("l"))
    return logs.groupBy("gram").agg(F.sum(F.when(F.col("verdict") == "allow", F.col("l")).otherwise(-F.col("l"))).alias("llr"))


def threshold_of(scored: DataFrame) -> float:
    """The bin border that misjudges the fewest of (verdict, score), each verdict weighing 1; the middle one on ties.

    0 if one of the verdicts has no score.
    """
    at = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.col("score") / BIN))).cast("int")
    found = scored.where("score is not null").groupBy(at.alias("bin"), "verdict").agg(F.count(F.lit(1)).alias("n")).collect()
    total = {v: sum(r["n"] for r in found if r["verdict"] == v) for v in ("allow", "block")}
    if not all(total.values()):
        return 0.0
    wrong = []
    for border in range(-MOST, MOST + 2):
        lost = sum(r["n"] for r in found if r["verdict"] == "allow" and r["bin"] < border) / total["allow"]
        let = sum(r["n"] for r in found if r["verdict"] == "block" and r["bin"] >= border) / total["block"]
        wrong.append((round(lost + let, 9), border))
    best = [border for lost, border in wrong if lost == min(wrong)[0]]
    return best[(len(best) - 1) // 2] * BIN


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of pages.

    Rules decide where one fits, else the models: allow from the calibrated threshold on. A url without
    host and path has no score and is blocked. Repeated rows are judged each; other columns aren't read.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("rule", name).withColumn("says", says)
    left_out = F.substring(F.md5(F.concat("host", "path")), 1, 1).isin(list(LEFT_OUT))
    taught = ruled.where("says is not null")
    ratios = log_ratios(_grams(taught.where(~left_out)).select(F.col("says").alias("verdict"), "gram")).orderBy("gram").collect()  # SIZE ** 3 rows
    score = score_of(codes_of(F.col("host"), F.col("path")), [r["llr"] for r in ratios])
    threshold = threshold_of(taught.where(left_out).select(F.col("says").alias("verdict"), score.alias("score")))
    learnt = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return ruled.withColumn("score", score).select("page_id", "host", "path", "rule", F.coalesce("says", learnt).alias("verdict"), "score")
