"""Filter interaction audit: what each filter removes in every order in which a set of filters can run.

Each filter's failing rows are a stored table of row numbers. What is left after a prefix of an order
depends on the set of filters in it alone, so ``2 ** n`` sets stand for all ``n!`` orders:

* survivors of a set: left-anti joins with the tables of its filters, one after the other;
* removals of a filter behind a set: survivors of the set, left-semi joined with the filter's table.

All joins are on the row number, which is unique, so no key is hot and one exchange serves every join.
Redundancies, exclusive failures, label losses and Shapley sums are sums over these counts.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import stored

BLANKS = "[\\x20\\x09-\\x0D]+"
COUNTS = ("n", "good", "toxic")
HEAVY_GROUPS = 1000


def contract_conditions(text: str = "text") -> dict[str, Column]:
    """Failure conditions A to D of a text; a missing text is empty. (E needs the whole table.)"""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, BLANKS), lambda w: w != "")
    n = F.size("_words")
    return {"_words": words,
            "A": n < 200,
            "B": 100 * F.size(F.array_distinct("_words")) < 50 * n,
            "C": 100 * F.regexp_count(body, F.lit("[A-Z]")) > 2 * F.length(body),
            "D": body.rlike("[#$%&*|]")}


def later_copies(rows: DataFrame, digest: str = "_digest", key: str = "_key") -> DataFrame:
    """Row numbers of rows whose text a smaller key has too. A missing key is not compared.

    Groups of one key are dropped before anything is joined back. A group of more than a thousandth of
    all rows is one of at most a thousand, which are broadcast; only the others are shuffled by digest.
    """
    groups = stored(rows.groupBy(digest).agg(F.min(key).alias("_first"), F.max(key).alias("_last"), F.count(F.lit(1)).alias("_n")),
                    "audit-groups")
    total = groups.agg(F.sum("_n")).first()[0] or 0
    several = groups.where("_first < _last").withColumn("_heavy", F.col("_n") * HEAVY_GROUPS > total)
    found = [rows.join(F.broadcast(several.where("_heavy")), digest), rows.join(several.where("not _heavy"), digest)]
    return found[0].unionByName(found[1]).where(F.col(key) > F.col("_first")).select("_row")


def failing_relations(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                      part: str = "source") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(rows with part and label flags, failing row numbers by filter) for the conditions A to E.

    Every row counts by itself, whatever its key: rows are numbered and the numbers stored. A missing part
    is the empty string. A row is good if any label of its key says quality 1, toxic if any says toxic 1.
    Columns of ``docs`` other than these three are not read, so their names do not matter.
    """
    clean = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(F.col(part), F.lit("")).alias("part"))
    conditions = contract_conditions("_text")
    flagged = clean.withColumn("_words", conditions.pop("_words")).select(
        F.monotonically_increasing_id().alias("_row"), "_key", "part",
        F.unhex(F.sha2(F.coalesce(F.col("_text"), F.lit("")), 256)).alias("_digest"),
        *[c.alias(name) for name, c in conditions.items()])
    rows = stored(flagged, "audit-rows")
    fails = {name: stored(rows.where(name).select("_row"), f"audit-fails-{name}") for name in conditions}
    fails["E"] = stored(later_copies(rows.select("_row", "_key", "_digest")), "audit-fails-E")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    base = rows.select("_row", "_key", "part").join(marks.where("good or toxic"), "_key", "left").select(
        "_row", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return stored(base, "audit-base"), fails


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def _survivors(rows: DataFrame, fails: Mapping[str, DataFrame], bits: Mapping[str, int], skip: str = "") -> DataFrame:
    """Rows with ``mask`` for every set of filters (without ``skip``) that they survive."""
    out = rows.withColumn("mask", F.lit(0))
    for name, ids in fails.items():
        if name == skip:
            continue
        # each row goes on once without the filter and once through it
        out = out.withColumn("_through", F.explode(F.array(F.lit(False), F.lit(True))))
        hit = ids.select(F.col("_row").alias("_hit")).hint("shuffle_hash")
        out = out.join(hit, (F.col("_row") == F.col("_hit")) & F.col("_through"), "left_anti")
        out = out.withColumn("mask", F.col("mask") + F.when(F.col("_through"), bits[name]).otherwise(0)).drop("_through")
    return out


def interactions(rows: DataFrame, fails: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(survivors by part and set of filters, removals by part, set of earlier filters and filter).

    ``rows`` has _row, part, good and toxic; ``mask`` holds one bit per filter, in the order of ``fails``.
    """
    bits = {name: 1 << i for i, name in enumerate(fails)}
    at = rows.repartition("_row")
    parted = {name: ids.repartition("_row") for name, ids in fails.items()}
    kept = stored(_counted(_survivors(at, parted, bits)), "audit-kept")
    removed = None
    for name, ids in parted.items():
        gone = _survivors(at, parted, bits, skip=name).join(ids.hint("shuffle_hash"), "_row", "left_semi")
        counts = _counted(gone).withColumn("filter", F.lit(name))
        removed = counts if removed is None else removed.unionByName(counts)
    return kept, stored(removed, "audit-removed")


def audit(rows: DataFrame, fails: Mapping[str, DataFrame]) -> DataFrame:
    """One row per part, order of the filters and step, zeros included; an empty table has no part and no row."""
    names = list(fails)
    bits = {name: 1 << i for i, name in enumerate(names)}
    full = (1 << len(names)) - 1
    kept, removed = interactions(rows, fails)
    size = len(names)
    before = F.bit_count("mask")
    orders = sum((F.when(before == k, factorial(k) * factorial(size - 1 - k)).otherwise(0) for k in range(size)), F.lit(0))
    own = F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), F.lit(bits[n]))]), F.col("filter"))
    whole = removed.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("mask") == 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("mask") == full - own, F.col("n")).otherwise(0)).alias("unique_fails"),
        F.sum(orders * F.col("n")).alias("shapley"))
    steps = [{"filter_order": "".join(o), "step": i + 1, "filter": name, "before": sum(bits[x] for x in o[:i]),
              "after": sum(bits[x] for x in o[:i + 1])} for o in permutations(names) for i, name in enumerate(o)]
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, filter string, before int, after int>>")
    # parts with all their steps: the part list is read from the survivors of no filter, which every part has
    grid = kept.where("mask = 0").select("part", F.explode(table).alias("_s")).select("part", "_s.*")
    gone = removed.select("part", "filter", F.col("mask").alias("before"), F.col("n").alias("removed"),
                          F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"))
    left = kept.select("part", F.col("mask").alias("after"), F.col("n").alias("kept"))
    out = grid.join(gone, ["part", "filter", "before"], "left").join(left, ["part", "after"], "left").join(whole, ["part", "filter"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in
            ("kept", "removed", "fails", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    return out.select("part", "filter_order", "step", zero["kept"].alias("kept"), zero["removed"].alias("removed"),
                      (zero["fails"] - zero["removed"]).alias("redundant"),
                      *[zero[c].alias(c) for c in ("unique_fails", "good_lost", "toxic_lost", "shapley")])
