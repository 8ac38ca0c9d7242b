"""Quality figures of extraction, graph and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators.rollups import ratio
from sparkloom.storage import small, stored

COUNTERS = ("refs_sent", "refs_returned", "refs_missing", "refs_unknown", "raw_entities", "unknown_types", "invalid_names", "duplicates", "over_limit", "mentions", "entities")
DISCARDS = ("unknown_types", "invalid_names", "duplicates", "over_limit")
HUBS = (10, 50, 100, 500)
ENUM_MARKS = 8
MIN_CHARS = 40


#: Rows of a key that are ordered in one window at most; above, selection goes on.
ORDERED = 100_000
#: Of percentile_approx: its ranks are off by a row in so many.
ACCURACY = 10_000


def nearest_rank(df: DataFrame, value: str, shares: tuple[float, ...], keys: tuple[str, ...] = (), ordered: int = ORDERED, accuracy: int = ACCURACY) -> DataFrame:
    """The values at place round(q * (n - 1)), half to even, from 0, one column a share; exact, by selection in passes.

    A pass cuts the distinct values that are left for a place into some 32 bins (by a mergeable sketch, combined before the shuffle),
    counts the rows of each bin exactly and keeps the one bin that holds the place. Once no place has more than `ordered` distinct values
    left, these are ordered, with their counts. So neither rows nor all distinct values of a key ever meet in one task. Null values don't
    count; a key without values isn't there, but without keys there is one row of nulls."""
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = stored(df.filter(F.col(value).isNotNull()).groupBy(*own, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    totals = rows.groupBy(*names).agg(F.sum("_n").alias("_all")).filter("_all IS NOT NULL")
    at = F.array(*(F.struct(F.lit(i).alias("i"), F.least(F.bround(q * (F.col("_all") - 1), 0), F.col("_all") - 1).cast("bigint").alias("at")) for i, q in enumerate(shares)))
    # a place: the rank wanted among the values that are left (of rows, not of distinct values)
    places = stored(totals.select(*names, F.explode(at).alias("x")).select(*names, F.col("x.i").alias("_i"), F.col("x.at").alias("_at")))
    by = [*names, "_i"]
    left = _joined(rows, places.select(*by), names)
    while True:
        sizes = left.groupBy(*by).agg(F.count(F.lit(1)).alias("_d"))
        crowded = stored(sizes.filter(F.col("_d") > ordered).select(*by))
        if crowded.isEmpty():
            break
        # shares of distinct values: their counts' sums tell the true places of the bounds
        many = _joined(left, crowded, by)
        bounds = many.groupBy(*by).agg(F.percentile_approx("_v", [k / 32 for k in range(33)], accuracy).alias("_b"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        bounds = stored(bounds.select(*by, F.array_distinct(F.concat(F.array("_lo"), "_b", F.array("_hi"))).alias("_b")))
        binned = _joined(many, bounds, by).withColumn("_bin", F.size(F.filter("_b", lambda x: x <= F.col("_v"))))
        counts = stored(binned.groupBy(*by, "_bin").agg(F.sum("_n").alias("_s")))
        upto = F.sum("_s").over(Window.partitionBy(*by).orderBy("_bin"))  # 35 bins at most
        chosen = _joined(counts.withColumn("_upto", upto), places, by).filter((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_s")))
        chosen = stored(chosen.select(*by, F.col("_bin").alias("_in"), (F.col("_at") - F.col("_upto") + F.col("_s")).alias("_new")))
        kept = _joined(binned, chosen, by).filter(F.col("_bin") == F.col("_in")).select(*by, "_v", "_n")
        left = stored(kept.unionByName(_joined(left, crowded, by, "left_anti").select(*by, "_v", "_n")))
        places = stored(_joined(places, chosen, by, "left").select(*by, F.coalesce("_new", "_at").alias("_at")))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    hit = _joined(left.withColumn("_upto", upto), places, by).filter(F.col("_upto") > F.col("_at"))
    hit = hit.groupBy(*by).agg(F.min("_v").alias("_v"))
    return hit.groupBy(*(F.col(n).alias(k) for n, k in zip(names, keys))).agg(*(F.min(F.when(F.col("_i") == i, F.col("_v"))).alias(f"p{round(100 * q)}") for i, q in enumerate(shares)))


def _joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, nulls being equal; without keys every row meets the right side's, which then has one row a place at most."""
    renamed = right.withColumnsRenamed({k: f"_r{k}" for k in by})
    on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in by]
    out = left.join(F.broadcast(renamed) if not by else small(renamed), on if on else F.lit(True), how)
    return out.drop(*(f"_r{k}" for k in by))


def degree_summary(degrees: DataFrame, hubs: tuple[int, ...] = HUBS) -> DataFrame:
    """One row: entities, singletons, percentiles, largest, mean, and entities at or above each hub size (degrees: degree)."""
    d = F.col("degree")
    sums = degrees.agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(d == 1).alias("singleton"), F.max(d).alias("largest"), F.avg(d).alias("mean"), *(F.count_if(d >= h).alias(f"hub_{h}") for h in hubs)
    )
    return sums.withColumn("singleton_ratio", ratio(F.col("singleton"), F.col("entities"))).crossJoin(F.broadcast(nearest_rank(degrees, "degree", (0.5, 0.9, 0.99))))


def hub_entities(mentions: DataFrame, top: int = 15) -> DataFrame:
    """entity_id, degree: the most mentioned."""
    return mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "entity_id").limit(top)


def type_counts(mentions: DataFrame) -> DataFrame:
    """type, entities, singletons."""
    by = mentions.groupBy("type", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("type").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n") == 1).alias("singletons"))


def graph_counts(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """kind (node or edge), name, n."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), F.lit(name).alias("name"), "n") for k, group in (("node", nodes), ("edge", edges)) for name, df in group.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def extraction_ledger(results: DataFrame) -> DataFrame:
    """One row over documents' last results (doc_id, ord, status and the counters): sums over successful ones, documents by outcome,
    discards and their ratio, and the ratio of references lost."""
    last = results.filter(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "")
    last = last.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("ord")))).filter("_r = 1")
    ok = F.col("status") == "ok"
    sums = last.agg(
        F.count(F.lit(1)).alias("docs_total"), F.count_if(ok).alias("docs_ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("docs_error"),
        *(F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS if c in results.columns),
    )
    sums = sums.withColumn("discarded", sum((F.col(c) for c in DISCARDS), F.lit(0)))
    return sums.withColumn("discard_ratio", ratio(F.col("discarded"), F.col("raw_entities"))).withColumn("ref_loss", ratio(F.col("refs_missing"), F.col("refs_sent")))


def mention_counts(mentions: DataFrame) -> DataFrame:
    return mentions.filter(F.coalesce(F.col("clause_id").cast("string"), F.lit("")) != "").groupBy("clause_id").agg(F.count(F.lit(1)).alias("n"))


def anchor_histogram(clauses: DataFrame, counts: DataFrame, marks: int = ENUM_MARKS, mark: str = "、") -> DataFrame:
    """kind (enumeration or plain), bucket, clauses: by number of mentions; clauses without one count as 0."""
    rows = clauses.join(counts, "clause_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    many = F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit(""))) >= marks
    bucket = F.when(F.col("n") <= 0, "0").when(F.col("n") <= 2, "1-2").when(F.col("n") <= 5, "3-5").otherwise("6+")
    return rows.groupBy(F.when(many, "enumeration").otherwise("plain").alias("kind"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("clauses"))


def degree_band(degree: Column) -> Column:
    return F.when(degree >= 50, "50+").when(degree >= 10, "10-49").when(degree >= 4, "4-9").when(degree >= 2, "2-3").otherwise("1")


def audited_mentions(mentions: DataFrame, clauses: DataFrame) -> DataFrame:
    """Mentions (ord, clause_id, type, name) with degree and kind (exact, partial, absent; null: its clause is unknown)."""
    # a name is cleaned once, however often it is mentioned
    degrees = mentions.groupBy("type", "name").agg(F.count(F.lit(1)).alias("degree"))
    degrees = stored(degrees.withColumn("_clean", X.entity_name(F.col("name"))))
    texts = clauses.select("clause_id", X.squeezed(F.col("text")).alias("squeezed"))
    rows = mentions.join(small(degrees), ["type", "name"]).join(texts, "clause_id", "left")
    kind = F.when(F.col("squeezed").isNotNull(), X.mention_kind(F.col("_clean"), F.col("squeezed"), clean=True))
    return rows.withColumn("kind", kind).drop("squeezed", "_clean")


def literal_audit(audited: DataFrame) -> DataFrame:
    """table (all, type, degree), key, exact, partial, absent, unresolved, absent_ratio."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("exact", "partial", "absent")] + [F.count_if(F.col("kind").isNull()).alias("unresolved")]
    rows = audited.select("type", degree_band(F.col("degree")).alias("band"), "kind")
    sets = [[], [F.col("type")], [F.col("band")]]
    rows = rows.groupingSets(sets, F.col("type"), F.col("band")).agg(F.grouping_id().alias("gid"), *kinds)
    table = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "type").otherwise("degree")
    key = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, F.col("type")).otherwise(F.col("band"))
    rows = rows.select(table.alias("table"), key.alias("key"), "exact", "partial", "absent", "unresolved")
    return rows.withColumn("absent_ratio", ratio(F.col("absent"), F.col("exact") + F.col("partial") + F.col("absent")))


def audit_samples(audited: DataFrame, most: int = 5) -> DataFrame:
    """The first mentions of each kind that isn't exact, in input order: one pass for both kinds, of which each task keeps `most`."""
    rows = audited.filter("kind IN ('partial', 'absent')")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy("ord"))).filter(F.col("_r") <= most).drop("_r")


def anchor_coverage(clauses: DataFrame, anchored: DataFrame, failed: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """layer, clauses, anchored, coverage: all; without failed documents; without short texts; without procedural ones; then the
    procedural ones dropped, and the anchors whose clause is unknown (orphans)."""
    ids = anchored.select("clause_id").distinct()
    rows = clauses.join(ids.withColumn("a", F.lit(True)), "clause_id", "left").join(failed.select("doc_id").distinct().withColumn("f", F.lit(True)), "doc_id", "left")
    ok, long = F.col("f").isNull(), F.length(F.coalesce("text", F.lit(""))) >= min_chars
    dull = X.is_procedural(F.coalesce("text", F.lit("")))
    layers = {"1_all": F.lit(True), "2_extracted": ok, "3_long": ok & long, "4_substantial": ok & long & ~dull, "5_procedural": ok & long & dull}
    sums = rows.agg(*(x for k, c in layers.items() for x in (F.count_if(c).alias(f"{k}_n"), F.count_if(c & F.col("a").isNotNull()).alias(f"{k}_a"))))
    stacked = sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("layer"), F.col(f"{k}_n").alias("clauses"), F.col(f"{k}_a").alias("anchored")) for k in layers))).alias("x")).select("x.*")
    orphans = ids.join(clauses.select("clause_id"), "clause_id", "left_anti").agg(F.count(F.lit(1)).alias("clauses")).select(F.lit("6_orphans").alias("layer"), "clauses", F.col("clauses").alias("anchored"))
    return stacked.unionByName(orphans).withColumn("coverage", ratio(F.col("anchored"), F.col("clauses")))


def target_ranks(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, total, hits, first_rank (null: none) of ranked lists (query_id, id, rank) against wanted ids."""
    want = targets.select("query_id", "id").distinct().withColumn("w", F.lit(True))
    rows = hits.join(want, ["query_id", "id"], "left")
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("w").isNotNull()).alias("hits"), F.min(F.when(F.col("w").isNotNull(), F.col("rank"))).alias("first_rank"))


def evaluation_means(items: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """metric, mean (four places, of scored rows only), scored, skipped, errored, reasons (distinct, sorted). items: id, status, plan
    array, scores map to struct<value,error>, errors map."""
    rows = items.select("*", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    score, own = F.try_element_at("scores", F.col("metric")), F.try_element_at("errors", F.col("metric"))
    state = F.when(F.col("status") != "scored", "skipped").when(~F.array_contains("plan", F.col("metric")), "skipped").when(score["value"].isNull(), "errored").otherwise("scored")
    why = (
        F.when(F.col("status") != "scored", F.coalesce(F.try_element_at("errors", F.lit("answer")), F.lit("answer generation failed")))
        .when(~F.array_contains("plan", F.col("metric")), "sample has no reference answer")
        .when(score["value"].isNull(), F.coalesce(F.nullif(score["error"], F.lit("")), F.nullif(own, F.lit("")), F.lit("judge returned no value")))
    )
    rows = rows.select("metric", state.alias("state"), F.when(state == "scored", score["value"]).alias("value"), F.nullif(why, F.lit("")).alias("why"))
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rows.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("mean"), n("scored"), n("skipped"), n("errored"), F.sort_array(F.collect_set("why")).alias("reasons"))


def arm_comparison(rows: DataFrame) -> DataFrame:
    """arm, group (null: all), targets, hits, contexts, graph_contexts of arm results (arm, group, hit, contexts, graph_contexts)."""
    sums = [F.count(F.lit(1)).alias("targets"), F.count_if("hit").alias("hits"), F.sum("contexts").cast("bigint").alias("contexts"), F.sum("graph_contexts").cast("bigint").alias("graph_contexts")]
    return rows.groupingSets([[F.col("arm"), F.col("group")], [F.col("arm")]], F.col("arm"), F.col("group")).agg(*sums)


def validated_entities(answers: DataFrame, most: int = 5, low: int = 2, high: int = 20) -> DataFrame:
    """answers (doc_id, ref, clause_id, place, type, name; place: order within the answer) with `verdict`: kept, repeated_ref, unknown_ref,
    unknown_types, invalid_names, duplicates or over_limit, the first that holds in this order. A ref given again is ignored.

    What an answer keeps are the first `most` of its distinct entities by the place where each comes first: a few rows, which all rows
    meet. Rows themselves are never ordered, so an answer's size bounds no task."""
    # a name is cleaned once, however often it is given
    names = answers.select("type", "name").distinct().withColumn("kind", X.entity_type(F.col("type"))).withColumn("clean", X.entity_name(F.col("name")))
    rows = _joined(answers, stored(names), ["type", "name"], "left")
    bad_type, bad_name = F.col("kind").isNull(), ~F.length("clean").between(low, high)
    keys = ["doc_id", "ref", "kind", "clean"]
    # a struct, since a place may be null and then comes first; equal first places are told apart by their number
    places = rows.filter(~bad_type & ~bad_name).groupBy(*keys).agg(F.min(F.struct("place")).alias("_first"))
    order = Window.partitionBy("doc_id", "ref").orderBy("_first", "kind", "clean")
    kept = stored(places.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r"))
    rows = _joined(rows, kept, keys, "left")
    at_first = F.struct("place") == F.col("_first")
    verdict = (
        F.when(F.col("clause_id").isNull(), "unknown_ref")
        .when(bad_type, "unknown_types")
        .when(bad_name, "invalid_names")
        .when(F.col("_first").isNull(), "over_limit")
        .when(~at_first, "duplicates")
        .otherwise("kept")
    )
    rows = rows.withColumn("verdict", verdict)
    # of rows that share an entity's first place one is kept; only such rows are numbered, if there are any
    here = F.col("_first").isNotNull() & F.coalesce(at_first, F.lit(False))
    if rows.filter(here).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return rows.drop("_first")
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("clause_id").isNull())) > 1
    first = rows.filter(here).withColumn("_again", again).withColumn("verdict", F.when(F.col("_again") & (F.col("verdict") == "kept"), "duplicates").otherwise(F.col("verdict")))
    return rows.filter(~here).unionByName(first.drop("_again")).drop("_first")


