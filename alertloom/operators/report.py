"""Reports over triaged alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from alertloom.operators.materialize import staged
from alertloom.operators.score import TIERS, order_keys

# Fixed texts.
EMPTY_BATCH = "No alerts to summarize."
QUIET_BATCH = "No P1/P2 alerts in this batch — likely routine noise, spot-check P3s."
CLOSING_NOTE = "\n[Note: generated from a template.]"


def tier_counts(triaged: DataFrame) -> DataFrame:
    """(tier, alerts): P1..P4, zero where there is none, and the total. One global aggregate."""
    counts = triaged.agg(
        *[F.count_if(F.col("priority_tier") == t).alias(t) for t in TIERS], F.count("*").alias("total")
    )
    rows = [F.struct(F.lit(t).alias("tier"), F.col(t).alias("alerts")) for t in [*TIERS, "total"]]
    return counts.select(F.inline(F.array(*rows)))


def top_incident(triaged: DataFrame) -> DataFrame:
    """The first alert in priority order as a card of text fields."""
    techniques = F.transform(
        "mitre", lambda m: F.concat(m["technique_id"], F.lit(" — "), m["technique"])
    )

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None")).alias(name)

    return (
        triaged.orderBy(*order_keys())
        .limit(1)
        .select(
            text("signature"),
            text("priority_tier"),
            text("priority_score"),
            text("src_ip"),
            text("dest_ip"),
            F.when(F.size(F.coalesce("mitre", F.array())) > 0, F.array_join(techniques, ", "))
            .otherwise(F.lit("No MITRE technique matched"))
            .alias("mitre_attack"),
        )
    )


def _or_none(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def summary_lines(triaged: DataFrame) -> DataFrame:
    """The incident summary as ordered lines: (section, priority_score, bucket_seq, seq, line).

    Order by section, priority_score descending, bucket_seq, seq to read it. Bullets stay rows, so
    a batch with any number of urgent alerts is summarised whole without passing one task.
    """
    counts = triaged.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("priority_tier") == "P1").alias("p1"),
        F.count_if(F.col("priority_tier") == "P2").alias("p2"),
    )

    def line(section: int, when: Column, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(section).alias("section"), text.alias("line")))

    n, p1, p2 = F.col("n"), F.col("p1"), F.col("p2")
    some = n > 0
    headings = F.array_compact(
        F.array(
            line(0, ~some, F.lit(EMPTY_BATCH)),
            line(0, some, F.format_string("Incident batch: %d alerts after dedup.", n)),
            line(1, p1 > 0, F.format_string("\n%d P1 (critical) alert(s):", p1)),
            line(3, p2 > 0, F.format_string("\n%d P2 (high) alert(s):", p2)),
            line(5, some & (p1 == 0) & (p2 == 0), F.lit(QUIET_BATCH)),
            line(6, some, F.lit(CLOSING_NOTE)),
        )
    )
    fixed = counts.select(F.inline(headings)).select(
        "section",
        F.lit(None).cast("int").alias("priority_score"),
        F.lit(None).cast("bigint").alias("bucket_seq"),
        F.lit(None).cast("bigint").alias("seq"),
        "line",
    )
    is_p1 = F.col("priority_tier") == "P1"
    bullet = F.concat(
        F.lit("  - ["), F.col("priority_score").cast("string"), F.lit("] "), _or_none("signature"),
        F.lit(" src="), _or_none("src_ip"), F.lit(" dest="), _or_none("dest_ip"),
        F.when(is_p1, F.concat(F.lit(" (x"), F.coalesce("occurrence_count", F.lit(1)).cast("string"), F.lit(")")))
        .otherwise(F.lit("")),
    )
    bullets = triaged.filter(F.col("priority_tier").isin("P1", "P2")).select(
        F.when(is_p1, F.lit(2)).otherwise(F.lit(4)).alias("section"),
        "priority_score",
        F.col("bucket_seq").cast("bigint").alias("bucket_seq"),
        F.col("seq").cast("bigint").alias("seq"),
        bullet.alias("line"),
    )
    return fixed.unionByName(bullets)


def reading_order() -> list[Column]:
    return [F.asc("section"), F.desc("priority_score"), F.asc("bucket_seq"), F.asc("seq")]


def ranked_lines(lines: DataFrame) -> DataFrame:
    """(line_no, section, line): the summary's lines numbered from 0 in reading order.

    A range sort gives every task a stretch of the order; the stretches' sizes (a row per task) give
    the number each begins with. No task sees all lines.
    """
    order = reading_order()
    laid = staged(
        lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ).withColumn("stretch", F.shiftright("at", 33))
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("stretch").agg(F.count("*").alias("n"))
    begins = sizes.select("stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(F.broadcast(begins), "stretch").select((F.col("begin") + place).alias("line_no"), "section", "line")


def summary_text(lines: DataFrame, part_lines: int = 10_000) -> DataFrame:
    """(part, summary): the text in order, in parts of so many lines; most batches are one part."""
    numbered = ranked_lines(lines).withColumn("part", F.floor(F.col("line_no") / part_lines))
    own = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return numbered.groupBy("part").agg(F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("summary"))


def compact_top(triaged: DataFrame, max_alerts: int = 25) -> DataFrame:
    """(rank, compact): the first alerts in priority order as small JSON records.

    A verdict is given for the source and target address; for the grouped slots only the slot's
    presence is (as null).
    """
    ordered = triaged.orderBy(*order_keys()).limit(max_alerts)
    columns = [
        "id", "priority_tier", "priority_score", "signature", "severity",
        F.coalesce("occurrence_count", F.lit(1)).alias("occurrence_count"),
        "src_ip", "dest_ip", "user", "mitre",
    ]
    if "enrichment" in triaged.columns:
        e = F.col("enrichment")
        slots = [
            F.when(e[s].isNotNull(), F.struct(F.lit(s).alias("key"), v.alias("value")))
            for s, v in [
                ("src_ip", e["src_ip"]["verdict"]),
                ("dest_ip", e["dest_ip"]["verdict"]),
                *[(s, F.lit(None).cast("string")) for s in ("ips", "domains", "hashes")],
            ]
        ]
        columns.append(F.map_from_entries(F.array_compact(F.array(*slots))).alias("enrichment_verdicts"))
    columns.append(F.substring(F.coalesce("message", F.lit("")), 1, 200).alias("message"))
    rank = F.struct(
        (-F.col("priority_score")).alias("score"), F.col("bucket_seq"), F.col("seq"),
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("compact"),
    )
    return ordered.agg(F.array_sort(F.collect_list(rank)).alias("rows")).select(
        F.posexplode("rows").alias("pos", "row")
    ).select((F.col("pos") + 1).alias("rank"), F.col("row.compact").alias("compact"))


def triage_listing(triaged: DataFrame) -> DataFrame:
    """Priority, score, signature, source and target of every alert, as text, in order."""

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default))

    return triaged.orderBy(*order_keys()).select(
        text("priority_tier", "P4").alias("priority"),
        text("priority_score", "0").alias("score"),
        text("signature", "Unknown").alias("signature"),
        text("src_ip", "None").alias("source"),
        text("dest_ip", "None").alias("target"),
    )
