"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kennelflow.io import cut_lineage, latest_rows, table
from kennelflow.llm import mixing as M
from kennelflow.llm import packing as P
from kennelflow.llm import personal as I
from kennelflow.llm import survivors as V
from kennelflow.llm import vocabulary as C
from kennelflow.llm.tokens import count_tokens


def _members(spark: SparkSession, d: str) -> DataFrame:
    cols = ["canonical_dog_id", "name", "description", "photo_urls", "last_seen_at"]
    return latest_rows(table(spark, d, "dog_listings"), "id", "updated_at", cols).select(
        F.col("canonical_dog_id").alias("gid"), "id", "name", F.col("description").alias("text"), F.col("photo_urls").alias("urls"), F.col("last_seen_at").alias("seen_at")
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    s = V.survivors(_members(spark, d))
    rows = F.explode(
        F.array(
            F.struct(F.lit("description").alias("field_name"), F.col("text_id").alias("listing_id")),
            F.struct(F.lit("photo_urls").alias("field_name"), F.col("urls_id").alias("listing_id")),
            F.struct(F.lit("display_listing_id").alias("field_name"), F.col("display_id").alias("listing_id")),
        )
    )
    return s.select(F.col("gid").alias("canonical_dog_id"), rows.alias("r")).select("canonical_dog_id", "r.*").filter("listing_id is not null")


#: Fields of a surviving record besides its text and pictures.
SURVIVING = ["name", "sex", "breed_raw", "age_raw", "weight_raw", "color_raw", "city"]


def p1_golden(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per dog with the listing that each value comes from; sources of higher priority come first."""
    cols = ["canonical_dog_id", "source_id", "description", "photo_urls", "last_seen_at", *SURVIVING]
    rank = F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), F.col("priority")).cast("int")
    sources = table(spark, d, "adoption_sources").filter("id is not null").groupBy(F.col("id").alias("source_id")).agg(F.max(rank).alias("priority"))
    rows = latest_rows(table(spark, d, "dog_listings"), "id", "updated_at", cols).join(sources, "source_id", "left")
    return V.golden_records(rows.withColumnsRenamed({"canonical_dog_id": "gid", "description": "text", "photo_urls": "urls", "last_seen_at": "seen_at"}), SURVIVING)


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = latest_rows(table(spark, d, "dog_listings"), "id", "updated_at", ["canonical_dog_id", "breed_raw", "breed_normalized", "color_raw"]).withColumnRenamed("canonical_dog_id", "gid")
    breeds = C.reference_names(table(spark, d, "ref_breeds"), "breed", "breed_id", "breed_name", "also_known_as")
    colors = C.reference_names(table(spark, d, "ref_colors"), "color", "color_id", "color_name", "also_known_as")
    return C.map_values(rows, {"breed": "breed_raw", "color": "color_raw"}, breeds.unionByName(colors), {"breed": "breed_normalized"})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d)[0].withColumnRenamed("id", "listing_id")


def p6_learnt(spark: SparkSession, d: str) -> DataFrame:
    """Names that the reference lists lack, with their entry and the votes for it."""
    return _named(spark, d)[1]


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that name something outside the lists, with the number of listings that have them."""
    rows = latest_rows(table(spark, d, "dog_listings"), "id", "updated_at", ["breed_raw", "color_raw"])
    none = _named(spark, d)[0].filter("ref_id = 0").join(rows, "id")
    return none.groupBy("field_name", F.when(F.col("field_name") == "breed", F.col("breed_raw")).otherwise(F.col("color_raw")).alias("value")).agg(F.count("*").alias("listings"))


#: Different sources in one container at most.
MOST_SOURCES = 6


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, part_no, from_token, size, container: every document's tokens in containers of 2,048."""
    docs = table(spark, d, "documents").withColumn("cluster", P.text_cluster(F.col("text")))
    items = cut_lineage(P.split_long(count_tokens(docs, ["doc_id", "source", "cluster"]), P.CAPACITY))
    packed = P.pack(items, P.CAPACITY, most_sources=MOST_SOURCES)
    return packed.withColumn("from_token", F.col("part_no").cast("bigint") * P.CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return P.fill_report(p8_containers(spark, d))


def _sizes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return M.countable(count_tokens(table(spark, d, "documents"), ["doc_id", "source"])), table(spark, d, "mix_targets")


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, pass_no, block, place, tokens of the mix with the target shares, as large as the limits allow."""
    return M.mix(*_sizes(spark, d))[0]


def p9_tempered(spark: SparkSession, d: str) -> DataFrame:
    """As p9_selection, of natural shares tempered to the entropy of the target shares."""
    docs, targets = _sizes(spark, d)
    return M.mix(docs, targets, target_entropy=_entropy(targets))[0]


def _entropy(targets: DataFrame) -> float:
    x = F.col("target_share")
    return targets.filter("target_share > 0").agg(-F.sum(x * F.log(x))).first()[0] or 0.0


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per way of mixing and source the weight, the bisected exponent, the reached share and the repeats.

    Ways: ``shares`` (target shares, greatest total), ``entropy`` (natural shares tempered to the entropy of the targets) and
    ``total`` (half as many tokens as all documents have, as near to the target shares as the limits allow).
    """
    docs, targets = _sizes(spark, d)
    everything = docs.agg(F.sum("tokens")).first()[0] or 0
    ways = {"shares": {}, "entropy": {"target_entropy": _entropy(targets)}, "total": {"total": everything / 2}}
    out = None
    for way, how in ways.items():
        report = M.mix(docs, targets, **how)[1].select(F.lit(way).alias("way"), "*")
        out = report if out is None else out.unionByName(report)
    return out


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return I.personal_information(table(spark, d, "documents")).select("doc_id", "kind", "start_pos")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text with typed placeholders."""
    docs = table(spark, d, "documents")
    return I.redact(docs, I.personal_information(docs))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_selection": p9_selection, "p9_tempered": p9_tempered, "p9_shares": p9_shares, "p1_found": p1_found, "p1_golden": p1_golden, "p6_found": p6_found, "p6_learnt": p6_learnt, "p6_unmatched": p6_unmatched}
SQL: dict[str, str] = {}
